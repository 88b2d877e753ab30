"""A folder of files whose columns differ."""

import pytest

from epilattice.sources import readers

TYPES = {"id": "i", "x": "d", "day": "D"}


def test_a_thousand_files_of_three_shapes_take_three_scans(spark, tmp_path):
    shapes = ["id,x", "x,id,name", 'day,id,"a, b"']
    for i in range(1000):
        row = [f"{i},{i}.5", f"{i}.5,{i},n{i}", f"2021-01-03,{i},NA"][i % 3]
        (tmp_path / f"part {i:04d}.csv").write_text(f"{shapes[i % 3]}\n{row}\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header only.csv").write_text("id,x\n")
    table = readers.read_union(spark, str(tmp_path), TYPES)
    assert dict(table.dtypes) == {"id": "int", "x": "double", "name": "string", "day": "date", "a, b": "string"}
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" csv") == 3
    rows = {r.id: r for r in table.collect()}
    assert sorted(rows) == list(range(1000))
    assert (rows[0].x, rows[1].name, rows[1].x, rows[2].x, rows[2]["a, b"]) == (0.5, "n1", 1.5, None, None)
    assert str(rows[2].day) == "2021-01-03"


def test_values_that_do_not_fit_are_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\nseven,1.5\n8,\n")
    assert {tuple(r) for r in readers.read_union(spark, str(tmp_path), TYPES).collect()} == {(None, 1.5), (8, None)}


def test_a_folder_without_headers_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError):
        readers.read_union(spark, str(tmp_path))
