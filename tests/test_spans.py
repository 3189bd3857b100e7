"""Records over lines and splits against the standard library, with splits of a few bytes."""

import csv
import json
import random

import pytest

from gridsmith.sources import files, records, spans


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for name, value in zip(names, ("300", "1", "1"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def grid_rows(spark, path, width):
    grid = files.read_grid(spark, str(path)).orderBy("block", "seq")
    cells = [c for c in grid.columns if c not in ("table_id", "block", "seq")]
    return [[r[c] for c in cells][:width] for r in grid.collect()], grid


@pytest.mark.parametrize("sep", [";", ",", "\t", "|"])
def test_quoted_cells_over_lines_in_tiny_splits(spark, tmp_path, tiny_splits, sep):
    rng = random.Random(sep)
    cell = lambda: "".join(rng.choices(["a", "bc", '"', '""', "\n", sep, " ", "é", "x\r\ny", "\n\n"], k=rng.choice([0, 1, 2, 5, 9, 60])))
    rows = [[f"k{i}", cell(), cell(), "end"] for i in range(160)]
    with open(tmp_path / "q.csv", "w", encoding="utf-8", newline="") as f:
        f.write("\ufeff")
        csv.writer(f, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
    got, grid = grid_rows(spark, tmp_path / "q.csv", 4)
    assert got == [[c.replace("\r\n", "\n") or None for c in r] for r in rows]
    assert grid.select("block").distinct().count() > 10
    assert grid.select("table_id").distinct().count() == 1


def test_quote_marks_that_open_nothing(spark, tmp_path, tiny_splits):
    lines = ['5" pipe;1', '"two', 'lines";2', 'a"b;"c;', 'd" junk;3', '"";4', '"""";5', '"x""', '";6', 'last;"7']
    (tmp_path / "q.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    pieces = spans.read_pieces(spark, [str(tmp_path / "q.csv")], "\n")
    found = [r.record for r in spans.quoted_records(pieces, ";").orderBy("block", "seq").collect()]
    assert found == ['5" pipe;1', '"two\nlines";2', 'a"b;"c;\nd" junk;3', '"";4', '"""";5', '"x""\n";6', 'last;"7']


def test_windows_texts_over_lines(spark, tmp_path, tiny_splits):
    text = "".join(f'"caf\xe9 {i}\n€";{i}\n' for i in range(300))
    (tmp_path / "w.csv").write_bytes(text.encode("cp1252"))
    got, _ = grid_rows(spark, tmp_path / "w.csv", 2)
    assert got == [[f"caf\xe9 {i}\n€", str(i)] for i in range(300)]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_in_tiny_splits(spark, tmp_path, tiny_splits, indent):
    rng = random.Random(indent)
    text = lambda: "".join(rng.choices(["a", '"', "\\", "}", "{", "[", "]", ",", "\n", "é", "\\\"", "  ", "}]"], k=rng.choice([0, 3, 20])))
    nested = lambda d: {text() or "k": nested(d - 1), "l": [text(), {"m": [{}, []]}, 3]} if d else text()
    rows = [{"question": text(), "db_id": str(i), "other": nested(rng.randrange(3))} for i in range(120)]
    (tmp_path / "a.json").write_text("\ufeff " + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(" [\n] ", encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"question": "only"}]', encoding="utf-8")
    got = records.read_questions(spark, [str(tmp_path / f"{n}.json") for n in "abc"]).orderBy("pos").collect()
    assert [(r.pos, r.question, r.db_id) for r in got] == [(i, r["question"], str(i)) for i, r in enumerate(rows)] + [(120, "only", None)]
    pieces = spans.read_pieces(spark, [str(tmp_path / "a.json")], "}")
    assert pieces.select("block").distinct().count() > 10
    elements = spans.array_elements(pieces).orderBy("block", "seq").collect()
    assert [json.loads(e.element) for e in elements if e.element is not None] == rows and all(e.sound for e in elements)


def test_no_window_looks_ahead_for_every_piece(spark, tmp_path, monkeypatch):
    """A frame with an open end is gone through again for each row: the time of a split would be quadratic."""
    plans = []
    monkeypatch.setattr(spans, "staged", lambda df, label: plans.append(df._jdf.queryExecution().analyzed().toString()) or df)
    (tmp_path / "a.json").write_text('[{"question": "a"}, {"question": "b"}]', encoding="utf-8")
    elements = spans.array_elements(spans.read_pieces(spark, [str(tmp_path / "a.json")], "}"))
    plans.append(elements._jdf.queryExecution().analyzed().toString())
    assert elements.where("sound").count() == 3
    assert all("windowspecdefinition" in p for p in plans[:1]) and not any("unboundedfollowing" in p for p in plans)


@pytest.mark.parametrize("text", ['[{"question": "a"},]', '[{"question": "a"} {"question": "b"}]', '[{"question": "a"}', '[{"question": "a}]',
                                  '[{"question": "a"}] {}', '[, {"question": "a"}]', '[{"question": a}]', '[{"question": "a"}}]'])
def test_arrays_that_are_not_sound_are_refused_whole(spark, tmp_path, tiny_splits, text):
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    (tmp_path / "y.json").write_text('[{"question": "fine"}]', encoding="utf-8")
    paths = [str(tmp_path / "x.json"), str(tmp_path / "y.json")]
    got = records.read_questions(spark, paths, broken="report").collect()
    assert [r.question for r in got if r.file.endswith("y.json")] == ["fine"]
    assert [(r.question, r.corrupt) for r in got if r.file.endswith("x.json")] == [(None, text)]
    with pytest.raises(Exception, match="no valid JSON in"):
        records.read_questions(spark, paths).collect()
