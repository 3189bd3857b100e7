import json

import pytest

from gridsmith.operators import batches as B
from gridsmith.operators import questions as Q
from gridsmith.plans import collect
from gridsmith.plans.execute import run_queries
from gridsmith.sources import tables
from gridsmith.streaming.responses import follow_responses


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([(0, "a", 'say "hà"\n'), (1, "b", "x"), (2, "c", None)], "pos bigint, instance_id string, prompt string")


def test_request_lines(spark, prompts):
    def lines(layout, **options):
        return [json.loads(r.line) for r in B.to_batch_requests(prompts, layout, **options).orderBy("pos").collect()]

    message = [{"role": "user", "content": 'say "hà"\n'}]
    assert lines("chat_completions", model="m")[0] == {
        "custom_id": "a", "method": "POST", "url": "/v1/chat/completions",
        "body": {"model": "m", "messages": message, "max_tokens": 4096}}
    assert lines("messages", model="m", max_tokens=7)[0] == {
        "custom_id": "a", "params": {"model": "m", "max_tokens": 7, "messages": message}}
    assert lines("inline") == [{"contents": [{"parts": [{"text": 'say "hà"\n'}]}]}, {"contents": [{"parts": [{"text": "x"}]}]}]


def response(iid, status=200, content="```\nSELECT 1\n```", message=None):
    body = {"choices": [{"message": {"content": content}}]} if status == 200 else {"error": {"message": message}} if message else {}
    return json.dumps({"custom_id": iid, "response": {"status_code": status, "body": body}})


def test_chat_responses(spark, prompts):
    rows = [response("a", 500, message="old"), response("a"), response("b", 429, message="slow"), "{broken", "", response("zz"),
            json.dumps({"custom_id": "c", "response": {"status_code": 200, "body": {}}}), json.dumps({"no": "id"})]
    lines = spark.createDataFrame(list(enumerate(rows)), "pos bigint, value string")
    got = {r.instance_id: (r.sql, r.error) for r in B.collect_results(
        prompts.select("instance_id"), B.parse_chat(lines), "chat_completions").collect()}
    assert got == {"a": ("SELECT 1", None), "b": ("", "slow"), "c": ("", "missing from batch output")}


def test_failed_batch(spark, prompts):
    asked = B.minibatches(prompts, 2).select("instance_id", "batch")
    failed = spark.createDataFrame([(0, "batch status: expired")], "batch bigint, error string")
    lines = spark.createDataFrame([(0, response("a")), (1, response("c"))], "pos bigint, value string")
    got = {r.instance_id: (r.sql, r.error) for r in B.collect_results(
        asked, B.parse_chat(lines), "chat_completions", failed).collect()}
    assert got == {"a": ("", "batch status: expired"), "b": ("", "batch status: expired"), "c": ("SELECT 1", None)}


def test_prompt_text(spark):
    q = spark.createDataFrame([(0, "d", "Q {EVIDENCE}?", " hint ", "i"), (1, "d", "R", "  ", "j"), (2, "x", "S", "", "k")],
                              "pos int, db_id string, question string, evidence string, instance_id string")
    schemas = spark.createDataFrame([("d", "T {QUESTION}")], "db_id string, text string")
    got = [(r.prompt, r.error) for r in Q.build_prompts(q, schemas, "{DATABASE SCHEMA}|{EVIDENCE}{QUESTION}").orderBy("pos").collect()]
    # Replacement is literal and in order: a placeholder inside the schema is filled, one inside a question is not.
    assert got == [("T Q {EVIDENCE}?|Evidence: hint\nQ {EVIDENCE}?", None), ("T R|R", None), (None, "SQLite conversion failed")]


def test_prepare_and_resume(spark, tmp_path):
    q = spark.createDataFrame([(i, f"i{i}", "d" if i else "gone", "Q", "") for i in range(5)],
                              "pos bigint, instance_id string, db_id string, question string, evidence string")
    schemas = spark.createDataFrame([("d", "T")], "db_id string, text string")
    requests, failed = collect.prepare(q, schemas, None, "messages", "m", size=2)
    assert [r.instance_id for r in failed.collect()] == ["i0"] and requests.count() == 4
    store = str(tmp_path / "results")
    collect.append_results(failed, store)
    again, none = collect.prepare(q, schemas, spark.read.parquet(store), "messages", "m", size=2)
    assert again.count() == 4 and none.count() == 0


def test_stream_collects_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = (str(inbox), "chat_completions", str(tmp_path / "out"), str(tmp_path / "marks"))
    for name, iid in (("1", "a"), ("2", "b")):
        (inbox / name).write_text(response(iid) + "\n{bad\n")
        follow_responses(spark, *paths).awaitTermination()
    follow_responses(spark, *paths).awaitTermination()
    assert sorted(r.instance_id for r in spark.read.parquet(paths[2]).collect()) == ["a", "b"]


def test_run_queries_keeps_order_and_errors(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 AS g", "CAST(id AS STRING) AS s", "id > 5 AS b").write.parquet(path)
    sql = [("all", "d", "SELECT s, id, b FROM t ORDER BY id DESC"), ("twin", "d", "SELECT s, id, b FROM t ORDER BY id DESC"),
           ("names", "d", "SELECT 1 AS a, 2 AS a -- note"), ("empty", "d", "SELECT id FROM t WHERE id < 0"),
           ("bad", "d", "SELECT * FROM u"), ("drop", "d", "DROP VIEW t"), ("late", "d", "SELECT CAST(s || 'x' AS INT) FROM t"),
           ("nodb", "e", "SELECT 1")]
    answers, cells = run_queries(spark, spark.createDataFrame(sql, "instance_id string, db_id string, sql string"), {"d": {"t": path}})
    got = {r.instance_id: r for r in answers.collect()}
    assert {k: (r.n_rows, r.n_cols) for k, r in got.items() if not r.error} == {
        "all": (1000, 3), "twin": (1000, 3), "names": (1, 2), "empty": (0, 1)}
    assert {k for k, r in got.items() if r.error} == {"bad", "drop", "late", "nodb"}
    rows = cells.where("instance_id = 'twin'").collect()
    assert {(r.row_idx, r.num) for r in rows if r.col_idx == 1} == {(999 - i, float(i)) for i in range(1000)}
    assert {r.num for r in rows if r.col_idx == 2} == {0.0, 1.0}


def test_publish(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "seq int, v string")
    assert tables.publish(df, "p", path=path, order=["seq"]) == "published"
    assert [r.v for r in spark.read.parquet(path).collect()] == ["a", "b", "c"]
    assert tables.publish(df.where("seq > 5"), "p", path=path) == "skipped"
    with pytest.raises(ValueError, match="no data"):
        tables.publish(df.where("seq > 5"), "p", path=path, overwrite=True)


def test_resume_moves_no_results(spark):
    """Results of several runs stay in their buckets: the plan shuffles the questions only."""
    name = "resumed.results"
    where = spark.sparkContext.getCheckpointDir() + "/resumed"
    spark.sql(f"CREATE DATABASE resumed LOCATION '{where}'")
    asked = spark.range(1000).selectExpr("cast(id as string) as instance_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert collect.done(spark, name) is None
        assert B.remaining(asked, collect.done(spark, name)).count() == 1000
        # The second run asks for other buckets and meets those of the first; NULL ids are never done.
        for run, buckets in ((0, 6), (1, 50)):
            part = asked.where(f"cast(instance_id as int) % 3 = {run}").selectExpr("instance_id", "'s' as sql")
            collect.append_bucketed(part.unionByName(part.limit(1)).unionByName(part.limit(1).selectExpr("cast(null as string) as instance_id", "sql")), name, buckets)
        left = B.remaining(asked, collect.done(spark, name))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(instance_id" in plan and ", 6)" in plan
        assert {int(r.instance_id) for r in left.collect()} == set(range(2, 1000, 3))
        spark.sql("CREATE TABLE resumed.plain (instance_id string) USING parquet")
        with pytest.raises(ValueError):
            collect.append_bucketed(asked, "resumed.plain")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE resumed CASCADE")
