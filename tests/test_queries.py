"""Registered queries against their SQL counterparts, and their plans.

By default a spread of quick queries; all of them with GRIDSMITH_ALL=1.
"""

import os

import check
import pytest

from bindings import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = [
    "vn_numbers", "auto_numbers", "percentages", "currencies", "dates", "booleans", "unicode_nfc", "whitespace", "excel_errors",
    "na_tokens", "leading_zeros", "number_styles", "type_votes", "typed_columns", "dedup_rows", "cleaned_revenue", "row_types",
    "header_rows_strict", "merged_headers", "unique_names", "ditto_marks", "drop_empty_columns", "raw_grid_quoted", "table_names",
    "example_values", "schema_text", "prompts", "minibatches_lines", "chat_requests", "extracted_sql", "collected_results",
    "query_status", "column_ranks", "execution_accuracy", "reparsed_cells", "late_windows_text", "quoted_commas",
    "mixed_question_folder", "broken_question_file", "empty_table_twice", "unordered_gold", "foreign_tables", "pending_recorded",
    "wide_beside_narrow", "streamed_last_answer", "packed_statements"]
PLANS = ["cleaned_revenue", "ditto_marks", "header_rows", "prompts", "column_ranks", "execution_accuracy", "collected_results",
         "minibatches_lines", "dedup_rows"]


def test_every_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES) and set(QUICK) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("GRIDSMITH_ALL") else QUICK)
def test_same_rows_as_sql(spark, con, name):
    _, text, ok = check.compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, text


@pytest.mark.parametrize("name", PLANS)
def test_no_cross_join(spark, con, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_is_needed(spark, con):
    from gridsmith.operators import typing as T

    df = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_partkey > 100")
    plan = T.drop_duplicates(df, ["l_returnflag"])._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan =="):]
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in scan and "GreaterThan(l_partkey,100)" in scan


@pytest.mark.parametrize("name, least", [("quoted_lines_split", 1), ("late_windows_text", 4), ("quoted_commas", 8)])
def test_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch, name, least):
    """A larger table is written into more files, so no task writes or reads a fixed share of it."""
    from bindings import files, registry

    text = "concat('a \"b\"', chr(10), repeat('text ', 20), id) AS text"
    spark.range(600).selectExpr("id AS doc_id", text, "'en' AS lang", "'web' AS source").repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(files, "fresh_path", lambda _, label: str(tmp_path / label))
    monkeypatch.setattr(files, "SPLIT_BYTES", 2000)
    monkeypatch.setattr(registry.file_count, "__defaults__", (1, 1000))
    got = {r.c0: r.c1 for r in QUERIES[name](spark, str(tmp_path)).collect()}
    kept = '\n' if name == "quoted_lines_split" else " "
    assert got.pop("last", None) == ("café 5 €" if name == "late_windows_text" else None)
    assert got == {str(i): f'a "b"{kept}' + "text " * 20 + str(i) for i in range(600)}
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) > least


def test_array_files_share_folders(spark, tmp_path, monkeypatch):
    """A file for each conversation, but a folder for two hundred: folders are looked up by a task each."""
    from bindings import files

    spark.range(900).selectExpr("id DIV 2 AS conv_id", "id % 2 AS turn", "'user' AS role", "concat('q', id) AS text").repartition(5).write.parquet(
        str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(files, "fresh_path", lambda _, label: str(tmp_path / label))
    rows = QUERIES["questions_array"](spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.question) for r in rows] == [(i, f"q{i}") for i in range(900)]
    assert len(list((tmp_path / "questions").glob("*"))) <= 5 and len(list((tmp_path / "questions").glob("*/part-*"))) == 450


def test_blank_files_beside_arrays_and_lines(spark, tmp_path):
    """Files of one layout are read by their folder; one of blanks alone is no record in either."""
    from gridsmith.sources import records

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.json").write_text('[{"question": "a"}, {"question": "b"}]', encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"question": "c"}]', encoding="utf-8")
    asked = lambda: [(r.pos, r.question) for r in records.read_questions(spark, str(tmp_path)).orderBy("pos").collect()]
    assert asked() == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "d.json").write_text(" \n\n", encoding="utf-8")
    (tmp_path / "e.json").write_text("", encoding="utf-8")
    assert asked() == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "f.json").write_text('\n{"question": "d"}\n', encoding="utf-8")
    assert asked() == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
