"""Inputs that once lost or mixed data without a word."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridsmith import session
from gridsmith.operators import batches
from gridsmith.operators.answers import parsed_answers
from gridsmith.operators.describe import describe_tables
from gridsmith.plans import cleaning, execute, submission
from gridsmith.plans.execute import as_query, run_queries
from gridsmith.sources import files, records, tables
from gridsmith.sources.responses import read_responses
from gridsmith.streaming import responses
from gridsmith.streaming.responses import collected, follow_last_answers, follow_responses


def test_encoding_of_the_whole_file(spark, tmp_path):
    late = b"k;v\n" + b"abc;5\n" * 30_000 + "café €;6\n".encode("cp1252")
    (tmp_path / "late.csv").write_bytes(late)
    found = files.sniff_files(spark, str(tmp_path)).first()
    assert (found.encoding, found.sep, found.width) == ("cp1252", ";", 2)
    rows = files.read_grid(spark, str(tmp_path)).where("c1 = '6'").collect()
    assert [(r.c0, r.c1) for r in rows] == [("café €", "6")]


def test_delimiter_of_the_whole_file(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a, b, c\n" * 40 + "x;1\n" * 5000, encoding="utf-8")
    (tmp_path / "tie.csv").write_text("a;b,c\n1;2,3\n", encoding="utf-8")
    seps = {r.path.rsplit("/", 1)[1]: r.sep for r in files.sniff_files(spark, str(tmp_path)).collect()}
    assert seps == {"late.csv": ";", "tie.csv": ","}


def test_delimiters_inside_quotes_make_no_width(spark, tmp_path):
    (tmp_path / "q.csv").write_text('k,v\n"' + "a," * 300 + '",1\n"x ""y"", z",2\n5" pipe,3\n', encoding="utf-8")
    grid = files.read_grid(spark, str(tmp_path / "q.csv"))
    assert len([c for c in grid.columns if c.startswith("c")]) == 2
    assert {(r.c0, r.c1) for r in grid.collect()} == {("k", "v"), ("a," * 300, "1"), ('x "y", z', "2"), ('5" pipe', "3")}


def test_colliding_and_missing_files(spark, tmp_path):
    for i, name in enumerate(("a-b.csv", "a.b.csv", "a_b.csv")):
        (tmp_path / name).write_text(f"k,v\nx{i},5\n", encoding="utf-8")
    out = str(tmp_path / "out")
    status = cleaning.clean_corpus(spark, [str(tmp_path / "*.csv"), str(tmp_path / "gone.csv")], out).collect()
    assert sorted(r.status for r in status) == ["failed", "failed", "failed", "published"]
    assert sorted((r.error or "")[:18] for r in status)[1:] == ["file not found: " + str(tmp_path)[:2], "table name a_b is ", "table name a_b is "]
    assert [r.k for r in spark.read.parquet(f"{out}/a_b").collect()] == ["x0"]


def test_publishing_an_empty_table_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.range(0)
    for _ in range(2):
        with pytest.raises(ValueError, match="no data"):
            tables.publish(empty, "t", path=path)
    (tmp_path / "t").mkdir()  # a write that died has no success mark
    assert tables.publish(spark.range(3), "t", path=path) == "published"
    with pytest.raises(ValueError, match="no data"):
        tables.publish(empty, "t", overwrite=True, path=path)
    assert spark.read.parquet(path).count() == 3 and tables.publish(spark.range(9), "t", path=path) == "skipped"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_records_of_mixed_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"question": "1"},\n {"question": "2"}\n]', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"question": "3"}\n\n{"question": "4"}\n', encoding="utf-8")
    (tmp_path / "c.json").write_text("\n", encoding="utf-8")
    rows = records.read_questions(spark, str(tmp_path))
    assert [(r.pos, r.question) for r in rows.orderBy("pos").collect()] == [(i, str(i + 1)) for i in range(4)]
    (tmp_path / "d.json").write_text('[{"question": "5"},]', encoding="utf-8")
    (tmp_path / "e.json").write_text('{"question": "6"}\n{"question": \n', encoding="utf-8")
    with pytest.raises(Exception, match="no valid JSON in"):
        records.read_questions(spark, str(tmp_path)).collect()
    told = records.read_questions(spark, str(tmp_path), broken="report")
    assert {r.file.rsplit("/", 1)[1] for r in told.where("corrupt IS NOT NULL").collect()} == {"d.json", "e.json"}
    assert told.where("corrupt IS NULL").count() == 5


def test_answers_have_no_largest_size(spark):
    text = F.concat(F.lit("["), F.repeat(F.lit('[12345678,"abcdefgh"],'), 6_500_000), F.lit('[1,"z"]]'))
    one = parsed_answers(spark.range(1).select(text.alias("exec_answer"))).select("n_rows", "n_cols", "error").first()
    assert tuple(one) == (6_500_001, 2, None)


def test_stored_order_and_own_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(20_000).withColumn("at", -F.col("id")), "t", path=path, order=["at"])
    asked = [("plain", "SELECT id FROM t"), ("some", "SELECT id FROM t WHERE id % 3 = 0; -- all;"), ("text", "SELECT ';--' AS c FROM t WHERE id = 1;;"),
             ("file", "SELECT count(*) FROM text.`/etc/hostname`"), ("sub", f"SELECT (SELECT max(id) FROM parquet.`{path}`)")]
    answers, cells = run_queries(spark, spark.createDataFrame([(i, "d", s) for i, s in asked], "instance_id string, db_id string, sql string"),
                                 {"d": {"t": path}})
    assert {r.instance_id for r in answers.where("error IS NOT NULL").collect()} == {"file", "sub"}
    for name, step in (("plain", 1), ("some", 3)):
        got = [r.num for r in cells.where(F.col("instance_id") == name).orderBy("row_idx").collect()]
        assert got == [float(i) for i in range(19_999, -1, -1) if i % step == 0]
    assert cells.where("instance_id = 'text'").first().str == ";--"
    assert as_query("SELECT 1 /* ; */ ; /* x */ -- y\n") == "SELECT * FROM (\nSELECT 1 /* ; */\n)"


def test_part_files_beyond_five_digits(spark, tmp_path):
    """Part 100000 comes after part 99999, as it was written, for statements and for descriptions."""
    folder = tmp_path / "t"
    folder.mkdir()
    for number, value in (("99999", "first"), ("100000", "second")):
        spark.createDataFrame([(value,)], "word string").coalesce(1).write.parquet(str(tmp_path / value))
        (written,) = (tmp_path / value).glob("part-*.parquet")
        (folder / f"part-{number}-x.c000.parquet").write_bytes(written.read_bytes())
    asked = spark.createDataFrame([("q", "d", "SELECT word FROM t")], "instance_id string, db_id string, sql string")
    _, cells = run_queries(spark, asked, {"d": {"t": str(folder)}})
    assert [r.str for r in cells.orderBy("row_idx").collect()] == ["first", "second"]
    assert "Examples: ['first', 'second']" in describe_tables(spark, {"t": str(folder)}).first().text


def chat(iid, sql):
    return json.dumps({"custom_id": iid, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": sql}}]}}})


def test_response_files_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join([chat("a", "old"), chat("b", "b1"), chat("a", "new")]) + "\n", encoding="utf-8")
    last = batches.last_response(read_responses(spark, str(folder), "chat_completions"))
    assert {(r.instance_id, r.raw_response) for r in last.collect()} == {("a", "new"), ("b", "b1")}
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    follow_responses(spark, str(folder), "chat_completions", out, marks).awaitTermination()
    assert {(r.instance_id, r.sql) for r in collected(spark.read.parquet(out)).collect()} == {("a", "new"), ("b", "b1")}
    for layout in ("inline", "other"):
        with pytest.raises(ValueError):
            follow_responses(spark, str(folder), layout, out, marks)
        with pytest.raises(ValueError):
            read_responses(spark, str(folder), layout)


def test_last_answers_are_state(spark, tmp_path, monkeypatch):
    """Nothing readable, answers, a run that dies before its table is in place, the same again, later answers, nothing new."""
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()

    def follow():
        follow_last_answers(spark, str(folder), "chat_completions", out, marks).awaitTermination()
        return {(r.instance_id, r.sql) for r in spark.read.parquet(out).collect()}

    (folder / "0.jsonl").write_text("no answer\n", encoding="utf-8")
    assert follow() == set()
    (folder / "1.jsonl").write_text("\n".join([chat("a", "old"), chat("b", "b1"), chat("a", "new")]) + "\n", encoding="utf-8")

    def dies(*_, **__):
        raise OSError("gone")

    monkeypatch.setattr(responses, "replace_folder", dies)
    with pytest.raises(StreamingQueryException):
        follow()
    assert spark.read.parquet(out).count() == 0
    monkeypatch.undo()
    assert follow() == {("a", "new"), ("b", "b1")}
    (folder / "2.jsonl").write_text("\n".join([chat("c", "c1"), chat("b", "b2")]) + "\n", encoding="utf-8")
    assert follow() == {("a", "new"), ("b", "b2"), ("c", "c1")} == follow()


def test_statements_in_packs(spark, tmp_path, monkeypatch):
    """Short statements share a job; one that fails in it, or is long, ends up alone, and no answer changes."""
    path = str(tmp_path / "t")
    spark.range(40).selectExpr("id", "id % 3 AS k").repartition(3).write.parquet(path)
    texts = {f"q{i}": f"SELECT id, k FROM t WHERE id >= {i} ORDER BY id DESC" for i in range(38)}
    texts |= {"zero": "SELECT id % (id - 7) FROM t", "gone": "SELECT x FROM t", "same": texts["q5"], "none": "SELECT id FROM t WHERE id > 99"}
    queries = spark.createDataFrame([(i, "db", s) for i, s in texts.items()] + [("other", "nowhere", "SELECT 1")], "instance_id string, db_id string, sql string")
    found = []
    for short, chunk in ((execute.SHORT_BYTES, 256), (0, 256), (execute.SHORT_BYTES, 7)):
        monkeypatch.setattr(execute, "SHORT_BYTES", short)
        monkeypatch.setattr(execute, "CHUNK", chunk)
        base = str(tmp_path / f"answers-{short}-{chunk}")
        monkeypatch.setattr(execute, "fresh_path", lambda _, label, base=base: f"{base}/{label}")
        answers, cells = run_queries(spark, queries, {"db": {"t": path}})
        status = {r.instance_id: (r.n_rows, r.n_cols, bool(r.error)) for r in answers.collect()}
        rows = {}
        for r in cells.orderBy("instance_id", "row_idx", "col_idx").collect():
            rows.setdefault(r.instance_id, []).append((r.row_idx, r.col_idx, r.num))
        found.append((status, rows, len(list((tmp_path / f"answers-{short}-{chunk}" / "answers").glob("*/_SUCCESS")))))
    status, rows, n_folders = found[0]
    assert status["zero"] == status["gone"] == status["other"] == (None, None, True)
    assert status["none"] == (0, 1, False) and all(status[f"q{i}"] == (40 - i, 2, False) for i in range(38))
    assert rows["same"] == rows["q5"] == [(n, c, float((39 - n) if c == 0 else (39 - n) % 3)) for n in range(35) for c in (0, 1)]
    assert all(f[:2] == found[0][:2] for f in found[1:])
    # Three packs, of which that of the failing statement was halved four times.
    assert n_folders <= 6 and found[1][2] == 39


def test_many_failing_statements_cost_the_others_few_runs(spark, tmp_path, monkeypatch):
    """Where many statements fail, packs are not halved again and again, and shrink."""
    path, submitted = str(tmp_path / "t"), []
    spark.range(4).write.parquet(path)
    texts = [f"SELECT id % (id - 3) + {i} FROM t" if i % 10 == 9 else f"SELECT count(*) + {i} FROM t" for i in range(60)]
    queries = spark.createDataFrame([(i, "db", s) for i, s in enumerate(texts)], "instance_id long, db_id string, sql string")

    def each(items, job, workers=4):
        items = list(items)
        submitted.extend(s.number for pack in items if isinstance(pack, list) for s in pack)
        return submission.each(items, job, workers)

    monkeypatch.setattr(execute, "each", each)
    monkeypatch.setattr(execute, "CHUNK", 20)
    answers, cells = run_queries(spark, queries, {"db": {"t": path}})
    assert {r.instance_id for r in answers.where("error IS NOT NULL").collect()} == set(range(9, 60, 10))
    assert {r.instance_id: r.num for r in cells.collect()} == {i: 4.0 + i for i in range(60) if i % 10 != 9}
    assert max(map(submitted.count, submitted)) <= 3 and len(submitted) < 130
    assert execute.pack_size(0, 0) == execute.PACK and execute.pack_size(160, 16) == 3 and execute.pack_size(5, 5) == 1


def test_statements_that_fail_alike_leave_the_packs_of_others_whole(spark, tmp_path, monkeypatch):
    # Statements of a shape with failures run apart; others share full packs, over tables that are not split.
    path, jobs = str(tmp_path / "t"), []
    spark.range(0, 90, 1, 3).selectExpr("id", "concat('x', id) AS name").write.parquet(path)
    texts = [f"SELECT CAST(name AS INT) + {i} FROM t" if i % 10 == 9 else f"SELECT id + {i}, '{i}' FROM t WHERE id % 45 = {i % 45}" for i in range(80)]
    queries = spark.createDataFrame([(i, "db", s) for i, s in enumerate(texts)], "instance_id long, db_id string, sql string")

    def each(items, job, workers=4):
        items = list(items)
        jobs.extend(pack for pack in items if isinstance(pack, list))
        return submission.each(items, job, workers)

    monkeypatch.setattr(execute, "each", each)
    found = []
    for small in (execute.SMALL_BYTES, 0):
        monkeypatch.setattr(execute, "SMALL_BYTES", small)
        jobs.clear()
        answers, cells = run_queries(spark, queries, {"db": {"t": path}})
        assert {r.instance_id for r in answers.where("error IS NOT NULL").collect()} == set(range(9, 80, 10))
        found.append(sorted((r.instance_id, r.row_idx, r.col_idx, r.num, r.str) for r in cells.collect()))
        # Two packs of the right ones; those that fail share one, its halves, and then run alone.
        assert len(jobs) <= 2 + 1 + 2 + 8
    right = [i for i in range(80) if i % 10 != 9]
    expected = [cell for i in right for n, k in enumerate((i % 45, i % 45 + 45)) for cell in ((i, n, 0, float(k + i), None), (i, n, 1, None, str(i)))]
    assert found[0] == found[1] == expected
    opened = execute.open_database(spark, {"t": path})
    assert opened.small.table("t").rdd.getNumPartitions() == 1 and opened.session.table("t").rdd.getNumPartitions() > 1
    assert execute.shape("d", "SELECT 'a', 5.0 FROM c1") == execute.shape("d", "SELECT 'b', 17 FROM c1") != execute.shape("d", "SELECT 'a', 5 FROM c2")


def test_pending_batches_and_unavailable_schemas(spark, tmp_path):
    path = str(tmp_path / "pending")
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    batches.record_pending(requests.where("instance_id <> 'c'"), path, "batch-1")
    done = spark.createDataFrame([("a",)], "instance_id string")
    assert [tuple(r) for r in batches.read_pending(spark, path, done).collect()] == [("batch-1", "b")]
    text = describe_tables(spark, {"gone": str(tmp_path / "gone")}).first().text
    assert text.startswith("(schema unavailable: ")


def test_scratch_can_be_dropped(spark):
    staged = session.staged(spark.range(3))
    root = session.run_root(spark)
    system, where = session.file_system(spark, root)
    assert staged.count() == 3 and system.exists(where)


def test_a_replacement_that_dies_half_way_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.publish(spark.range(3), "t", path=path)
    real = tables.file_system

    class Dying:
        """A file system that fails to move the new table to its place."""

        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def rename(self, source, target):
            if target.toString().endswith("/t"):
                raise OSError("died")
            return self.system.rename(source, target)

    monkeypatch.setattr(tables, "file_system", lambda s, p: (Dying(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError, match="died"):
        tables.publish(spark.range(5), "t", overwrite=True, path=path)
    monkeypatch.undo()
    assert not (tmp_path / "t").exists()
    assert tables.is_published(spark, path) and spark.read.parquet(path).count() == 3
    assert tables.publish(spark.range(5), "t", overwrite=True, path=path) == "published"
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_the_catalog_keeps_its_table_until_the_new_one_is_there(spark):
    from bindings.files import own_database

    with own_database(spark) as database:
        name = f"{database}.kept"
        tables.publish(spark.range(3), name)
        with pytest.raises(ValueError, match="no data"):
            tables.publish(spark.range(0), name, overwrite=True)
        assert spark.table(name).count() == 3
        # As after a run that died between the renames.
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}{tables.OLD}")
        assert tables.publish(spark.range(7), name) == "skipped" and spark.table(name).count() == 3
        assert tables.publish(spark.range(7), name, overwrite=True) == "published" and spark.table(name).count() == 7
        assert [t.name for t in spark.catalog.listTables(database)] == ["kept"]


def test_names_with_blanks_accents_and_dots_in_the_catalog(spark, tmp_path):
    from bindings.files import own_database

    for name in ("sales 2020.csv", "điểm thi.csv", "a.b-c.csv", "a b-c.csv"):
        (tmp_path / name).write_text("k;v\nx;5\ny;6\n", encoding="utf-8")
    with own_database(spark) as database:
        status = cleaning.clean_corpus(spark, str(tmp_path), database=database).collect()
        assert sorted((r.table_name, r.status) for r in status) == [
            ("a_b_c", "failed"), ("a_b_c", "published"), ("diem_thi", "published"), ("sales_2020", "published")]
        assert spark.table(f"{database}.sales_2020").count() == 2


def test_entry_without_a_module_of_the_text_operators(monkeypatch):
    import importlib
    import sys

    for module in [m for m in sys.modules if m.startswith("gridsmith.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "cleaned_revenue" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_cells_of_a_statement_are_not_gathered_by_it(spark, tmp_path):
    """The result of one statement is as long as its table: it meets its offsets where it stands."""
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    asked = spark.createDataFrame([("a", "d", "SELECT id FROM t"), ("b", "d", "SELECT id FROM t"), ("a", "d", "SELECT 5")],
                                  "instance_id string, db_id string, sql string")
    answers, cells = run_queries(spark, asked, {"d": {"t": path}})
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    got = sorted((r.instance_id, r.row_idx, r.num) for r in cells.collect())
    assert got == sorted([(i, k, float(k)) for i in "ab" for k in range(1000)] + [("a", 0, 5.0)])
    assert sorted((r.instance_id, r.n_rows) for r in answers.collect()) == [("a", 1), ("a", 1000), ("b", 1000)]
