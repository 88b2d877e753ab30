"""Personal data: base spans by pattern, and more spans by a character-level BiLSTM-CRF trained on labelled spans.

Any span of the four kinds holds a digit, an @ sign or an "at" in brackets, so the model reads the stretches around
those, and around a "dot" in brackets, in overlapping windows; a stretch goes on while the signs of an address go on.
Each place takes its tag from the window in which it lies deepest, and spans are read from the joined tags, so a span may
run through several windows.

Defined results: a null text is empty; texts of any length are scanned in time proportional to their length; a null
doc_id stays null; repeated rows give equal results; without any span in the table there is no model and no added span;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilattice.llm.rows import as_texts, chunks, pick
from epilattice.llm.sequence_model import Tagger
from epilattice.session import settle

KINDS = ("email", "ip", "card", "phone")
TRIGGER = re.compile(r"[0-9@]|[(\[](?:[Aa][Tt]|[Dd][Oo][Tt])[)\]]")
#: Signs of a window, the step between windows, and the context on either side of a stretch.
WIDTH, STEP, CONTEXT = 96, 48, 24
#: Windows the model is trained on (those with the smallest hashes), and made-up variants of each.
TRAIN_WINDOWS, VARIANTS = 320, 4

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ sign outwards, so that a long run of letters is looked at once."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append((start, domain.end()))
            end = domain.end()
        else:
            end = at + 1  # no later address reaches across an @ sign
        at = text.find("@", max(end, at + 1))
    return spans


def addresses(text: str) -> list[tuple[int, int]]:
    """Numbers joined by dots, four at a time from the left."""
    spans = []
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + len(".".join(four))
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in four):
                spans.append((at, end))
            at = end + 1
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by pattern, by kind as listed and then by start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    found += [("ip", a, b) for a, b in addresses(text)]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return found


def _signs_only(text: str, a: int, b: int) -> bool:
    return _RUN.match(text, a).end() >= b


def _run_start(text: str, least: int, at: int) -> int:
    """The first place of the run of address signs that ends at ``at``."""
    return least + len(text[least:at].rstrip(_LOCAL))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a span may lie: triggers with their context, as far as the address signs at its edges go on, merged.

    A run of address signs is looked at once for all triggers that reach it, so time stays proportional to the text.
    """
    merged: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        high = merged[-1][1] if merged else -1
        if high >= b:
            continue  # the stretch before reaches beyond this context
        # Blanks beside the sign belong to an address, as in "name (at) mail".
        edge = m.start() - (text[m.start() - 1 : m.start()] == " ")
        if a > high and _signs_only(text, a, edge):
            a = _run_start(text, max(high, 0), a)
        end = m.end() + (text[m.end() : m.end() + 1] == " ")
        if _signs_only(text, end, b):
            b = _RUN.match(text, b).end()
        if merged and a <= high:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def window_starts(length: int) -> list[int]:
    return [0, *range(STEP, max(length - WIDTH + STEP, 1), STEP)]


def sign_ids(text: str) -> np.ndarray:
    """ASCII signs are themselves; other letters, other signs and the filling have a number each."""
    ids = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where(ids < 128, ids, np.where(ids < 0x2000, 128, 129))


SIGNS, FILLING = 131, 130


def span_tags(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0 outside, 2k + 1 at the start of kind k, 2k + 2 inside it."""
    tags = np.zeros(length, dtype=np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


def tag_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of equal kind; a span begins at its first place even where the start tag is missing."""
    spans, start, kind = [], 0, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        now = (tag - 1) // 2 if tag else -1
        if now != kind or (tag and tag % 2):
            if kind >= 0:
                spans.append((KINDS[kind], start, i))
            start, kind = i, now
    return spans


def fill(rows: list[np.ndarray], value: int) -> np.ndarray:
    out = np.full((len(rows), WIDTH), value, dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def plausible(kind: str, text: str) -> bool:
    """The check that a span of the model has to pass."""
    digits = digits_of(text)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+", text, re.IGNORECASE))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?: ?[.:] ?[0-9]{1,3}){3}", text)) and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]+(?:[ ./_-]{0,2}[0-9]+)*", text)) and 16 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"(?:\+ ?)?\(?[0-9][ ().0-9/-]+[0-9]", text)) and 10 <= len(digits) <= 15 and bool(re.search(r"[^0-9.]", text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, starts, parts``: base spans of each whole text as ``kind:start:end``, and its stretches; stored."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            base, starts, parts = [], [], []
            for text in as_texts(part.column(1)):
                where = stretches(text) if TRIGGER.search(text) else []
                base.append([f"{k}:{a}:{b}" for k, a, b in base_spans(text)] if where else [])
                starts.append([a for a, _ in where])
                parts.append([text[a:b] for a, b in where])
            kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip((base, starts, parts), kinds, strict=True))], names=["doc_id", "base", "starts", "parts"])

    return settle(rows.mapInArrow(look, "doc_id long, base array<string>, starts array<long>, parts array<string>"), "personal-data")


def parse_span(text: str) -> tuple[str, int, int]:
    kind, a, b = text.split(":")
    return kind, int(a), int(b)


def variants(text: str, spans: list[tuple[str, int, int]], pool: list[tuple[str, str]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The same stretch with its spans written in other ways, spans from other stretches beside them, and other numbers."""
    out, made, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        out += text[at:a]
        said = text[a:b]
        if kind == "email":
            said = said.replace("@", str(rng.choice(["@", " (at) ", " [at] ", "(at)"])))
            said = said if rng.random() < 0.5 else said.replace(".", str(rng.choice([".", " (dot) ", "[dot]"])))
        elif kind == "card":
            digits = digits_of(said)
            said = str(rng.choice(["", ".", "-", " ", "/"])).join(digits[k : k + 4] for k in range(0, len(digits), 4))
        elif kind == "phone":
            said = str(rng.choice([said, said.removeprefix("+"), said[said.find("(") :] if "(" in said else said, said.replace(" ", "/")]))
        elif rng.random() < 0.5:
            said = said.replace(".", str(rng.choice([".", ":", " . "])))
        made.append((kind, len(out), len(out) + len(said)))
        out, at = out + said, b
        while rng.random() < 0.4:
            kind, said = pool[rng.integers(len(pool))]
            made.append((kind, len(out) + 1, len(out) + 1 + len(said)))
            out += " " + said
    out += text[at:]
    strewn = str(rng.choice([str(rng.integers(1, 10**6)), "12:30", "2024-05-17", "3.14", "v1.2.3", "$1,250.00", f"{rng.integers(10**9, 10**12)}", "user@", "@name"]))
    return out + " " + strewn + " ", made


def training_rows(found: DataFrame, windows: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Signs and tags of a bounded sample of stretches, those with the smallest hashes."""
    part = F.explode(F.arrays_zip("starts", "parts"))
    rows = found.filter("size(base) > 0").select("base", part.alias("p")).select("base", "p.starts", "p.parts", F.length("p.parts").alias("n"))
    rows = rows.filter(F.col("n") <= 4 * WIDTH).withColumn("h", F.xxhash64("parts")).orderBy("h", "parts", "starts").limit(windows)
    rng, signs, tags, drawn = np.random.default_rng(11), [], [], []
    for row in rows.collect():
        a, text = row["starts"], row["parts"]
        own = [(k, x - a, y - a) for k, x, y in map(parse_span, row["base"]) if a <= x and y <= a + len(text)]
        drawn.append((text, [s for s in own if not any(t != s and t[1] <= s[1] < t[2] for t in own)]))
    pool = [(kind, text[x:y]) for text, own in drawn for kind, x, y in own]
    for text, own in drawn:
        for version in [(text, own)] + [variants(text, own, pool, rng) for _ in range(VARIANTS)]:
            ids, marks = sign_ids(version[0]), span_tags(len(version[0]), version[1])
            for start in window_starts(len(ids)):
                signs.append(ids[start : start + WIDTH])
                tags.append(marks[start : start + WIDTH])
    return fill(signs, FILLING), fill(tags, 0)


def train(found: DataFrame) -> Tagger | None:
    signs, tags = training_rows(found)
    if not len(signs):
        return None
    tagger = Tagger.new(SIGNS, 2 * len(KINDS) + 1)
    tagger.fit(signs, tags)
    return tagger


def tagged(texts: list[str], tagger: Tagger, batch: int = 512) -> list[np.ndarray]:
    """Tags of whole stretches: overlapping windows are decoded, each place follows the window it is deepest in."""
    ids = [sign_ids(text) for text in texts]
    places = [(i, start) for i, row in enumerate(ids) for start in window_starts(len(row))]
    tags, depth = [np.zeros(len(r), dtype=np.int64) for r in ids], [np.full(len(r), -1) for r in ids]
    inside = np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1])
    for at in range(0, len(places), batch):
        some = places[at : at + batch]
        decoded = tagger.decode(fill([ids[i][start : start + WIDTH] for i, start in some], FILLING))
        for (i, start), got in zip(some, decoded, strict=True):
            n = min(WIDTH, len(ids[i]) - start)
            own = inside[:n].copy()
            if start == 0:
                own[: WIDTH // 2] = WIDTH
            if start + n == len(ids[i]):
                own[max(0, n - WIDTH // 2) :] = WIDTH
            better = own > depth[i][start : start + n]
            tags[i][start : start + n][better] = got[:n][better]
            depth[i][start : start + n][better] = own[better]
    return tags


def added_spans(base: list[tuple[str, int, int]], starts: list[int], texts: list[str], tags: list[np.ndarray]) -> list[tuple[str, int, int]]:
    """Spans of the model that are plausible and touch no base span."""
    found = []
    for a, text, marks in zip(starts, texts, tags, strict=True):
        for kind, x, y in tag_spans(marks):
            said = text[x:y]
            x, y = x + len(said) - len(said.lstrip(" .,")), y - (len(said) - len(said.rstrip(" .,")))
            if x < y and plausible(kind, text[x:y]) and not any(p < a + y and a + x < q for _, p, q in base):
                found.append((kind, a + x, a + y))
    return found


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row of ``SPANS`` per document: counts and digest of the base spans, and all spans.

    Texts are read once; the model is trained on the driver from a bounded sample of stretches, and only stretches are
    read again. Nothing is shuffled.
    """
    found = scan(docs)
    tagger = tagger or train(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = list(zip(*(part.column(i).to_pylist() for i in range(1, 4)), strict=True))
            texts = [text for _, _, parts in rows for text in parts]
            tags = iter(tagged(texts, tagger) if tagger and texts else [])
            columns = [[] for _ in range(7)]
            for said, starts, parts in rows:
                base = [parse_span(x) for x in said]
                more = added_spans(base, starts, parts, [next(tags) for _ in parts]) if tagger else []
                every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                values = [*(sum(s[0] == kind for s in base) for kind in KINDS), hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in every), len(more)]
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SPANS.split(", ")])

    return found.mapInArrow(decide, SPANS)
