"""From a messy file to a score: clean, publish, describe, ask, collect, run, compare."""

import json

from pyspark.sql import functions as F

from gridsmith.operators import batches, describe
from gridsmith.operators import questions as Q
from gridsmith.plans import cleaning, collect, scoring
from gridsmith.plans.execute import gold_answers
from gridsmith.sources import records, tables

CSV = "BẢNG GIÁ;;\nMã;Tên;Giá\n001;Bút;1.500,5\n002;nt;2.000,0\n003;Vở;n/a\n"


def test_whole_way(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "Bảng-giá.csv").write_text(CSV, encoding="utf-8")
    out = str(tmp_path / "out")
    status = cleaning.clean_corpus(spark, str(source), out).first()
    assert (status.table_name, status.status) == ("bang_gia", "published")
    published = tables.with_scan_order(spark.read.parquet(f"{out}/bang_gia"))
    schema = describe.m_schema(published, "bang_gia", ["block", "seq"])
    assert schema.first().text == (
        "【DB_ID】 bang_gia\n【Schema】\n# Table: bang_gia\n[\n(mã:TEXT, Examples: ['001', '002', '003']),\n"
        "(tên:TEXT, Examples: ['Bút', 'Vở']),\n(giá:REAL, Examples: [1500.5, 2000.0]),\n]\n"
        "Sample rows from `bang_gia`:\n001, Bút, 1500.5\n002, Bút, 2000.0\n003, Vở, NULL")

    path = tmp_path / "questions.json"
    path.write_text(json.dumps([
        {"db_id": "bang_gia", "question": "Bao nhiêu dòng?", "sql": "SELECT count(*) FROM bang_gia"},
        {"db_id": "bang_gia", "question": "Tên?", "sql": "SELECT `tên` FROM bang_gia", "external_knowledge": "cột tên"},
        {"db_id": "bang_gia", "question": "Giá?", "sql": "SELECT `giá` FROM bang_gia"},
        {"db_id": "missing", "question": "?", "sql": "SELECT 1"}], ensure_ascii=False), encoding="utf-8")
    questions = Q.normalize(records.read_questions(spark, str(path)))
    schemas = schema.select(F.col("table_name").alias("db_id"), "text")
    requests, failed = collect.prepare(questions, schemas, None, "chat_completions", "m", size=2)
    assert {r.instance_id for r in failed.collect()} == {"missing_3"}
    assert sorted((r.instance_id, r.batch) for r in requests.collect()) == [("bang_gia_0", 0), ("bang_gia_1", 0), ("bang_gia_2", 1)]
    assert "Evidence: cột tên\nTên?" in json.loads(requests.where("pos = 1").first().line)["body"]["messages"][0]["content"]

    def answer(iid, sql):
        return json.dumps({"custom_id": iid, "response": {"status_code": 200, "body": {
            "choices": [{"message": {"content": f"Here:\n```sql\n{sql}\n```"}}]}}}, ensure_ascii=False)

    lines = spark.createDataFrame([
        (0, answer("bang_gia_0", "SELECT count(1), 'x' FROM bang_gia")), (1, answer("bang_gia_1", "SELECT nothing FROM bang_gia")),
        (2, answer("bang_gia_2", "SELECT `giá` FROM bang_gia ORDER BY `giá` DESC"))], "pos bigint, value string")
    results = batches.collect_results(requests.select("instance_id"), batches.parse_chat(lines), "chat_completions")
    database = {"bang_gia": {"bang_gia": f"{out}/bang_gia"}}
    predictions, cells = collect.merge_results(spark, results, questions, database)
    gold, gold_cells, summary = gold_answers(spark, questions, database)
    assert summary.first().asDict()["n_errors"] == 1
    pred = predictions.withColumn("pred_id", F.col("instance_id")).withColumn("model", F.lit("m"))
    details = scoring.verdicts(
        pred.select("pred_id", "model", "instance_id", "sql_answer", "n_rows", "n_cols", "error"),
        cells.withColumnRenamed("instance_id", "pred_id"),
        gold.withColumnRenamed("pos", "gold_id"), gold_cells.withColumnRenamed("pos", "gold_id"))
    got = {r.instance_id: (r.correct, r.error is not None) for r in details.collect()}
    assert got == {"bang_gia_0": (True, False), "bang_gia_1": (False, True), "bang_gia_2": (False, False)}
    assert scoring.scoreboard(details, ["model"]).first().asDict() == {"model": "m", "score": 0.3333, "correct": 1, "total": 3}
