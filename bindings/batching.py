"""Request lines, response lines, extraction, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.files import own_database
from bindings.registry import case, query, table
from gridsmith.functions.statements import extract_sql
from gridsmith.operators import batches as B
from gridsmith.plans import collect
from gridsmith.plans.scoring import score_run
from gridsmith.session import fresh_path, staged
from gridsmith.sources import records
from gridsmith.sources.responses import read_responses
from gridsmith.streaming import responses as R


def requests(spark, sf):
    """Every conversation turn as a request; positions have gaps, as after a resume."""
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("instance_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.col("text").alias("prompt"), "conv_id", "turn")


BASE = "WITH r AS (SELECT conv_id || '-' || turn AS instance_id, conv_id * 100 + turn AS pos, text AS prompt, conv_id, turn FROM conversations) "


@query("minibatches", BASE + """
    SELECT instance_id, ((row_number() OVER (ORDER BY pos) - 1) // 50)::BIGINT AS batch FROM r""")
def minibatches(spark, sf):
    return B.minibatches(requests(spark, sf)).select("instance_id", "batch")


@query("minibatches_lines", """
    SELECT l_orderkey // 1000 AS part, count(*) AS n, sum(batch)::BIGINT AS batches FROM (
      SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey) - 1) // 50 AS batch FROM lineitem) GROUP BY 1""")
def minibatches_lines(spark, sf):
    """The same over every line item, in chunks of a thousand orders."""
    lines = B.numbered(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey", "at", chunk_rows=1000)
    return lines.groupBy(F.floor(F.col("l_orderkey") / 1000).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("at") / 50)).alias("batches"))


def _lines(spark, sf, layout):
    return B.to_batch_requests(requests(spark, sf), layout, "some-model").select("instance_id", "line")


@query("chat_requests", BASE + """
    SELECT instance_id, '{"custom_id":' || to_json(instance_id) || ',"method":"POST","url":"/v1/chat/completions","body":{"model":"some-model","messages":[{"role":"user","content":'
           || to_json(prompt) || '}],"max_tokens":4096}}' AS line FROM r""")
def chat_requests(spark, sf):
    return _lines(spark, sf, "chat_completions")


@query("messages_requests", BASE + """
    SELECT instance_id, '{"custom_id":' || to_json(instance_id) || ',"params":{"model":"some-model","max_tokens":4096,"messages":[{"role":"user","content":'
           || to_json(prompt) || '}]}}' AS line FROM r""")
def messages_requests(spark, sf):
    return _lines(spark, sf, "messages")


@query("inline_requests", BASE + """
    SELECT instance_id, '{"contents":[{"parts":[{"text":' || to_json(prompt) || '}]}]}' AS line FROM r""")
def inline_requests(spark, sf):
    return _lines(spark, sf, "inline")


@query("request_files", BASE + """
    SELECT CAST(((row_number() OVER (ORDER BY pos) - 1) // 50) AS INTEGER) AS batch, '{"contents":[{"parts":[{"text":' || to_json(prompt) || '}]}]}' AS value FROM r""")
def request_files(spark, sf):
    path = fresh_path(spark, "requests")
    B.write_requests(B.to_batch_requests(requests(spark, sf), "inline"), path)
    return spark.read.text(path).select("batch", "value")


def fenced(text):
    return F.concat(F.lit("Sure:\n```sql\n-- Your SQL query\n"), text, F.lit("\n```\nDone."))


@query("extracted_sql", BASE + """
    SELECT instance_id, CASE WHEN turn % 5 = 3 THEN '-- SELECT old' || chr(10) ELSE '' END || CASE WHEN turn % 5 = 4 THEN '' ELSE
           trim(prompt, chr(9)||chr(10)||chr(13)||chr(32)) END AS sql FROM r""")
def extracted_sql(spark, sf):
    """Whole turns in fences with and without tag, placeholder comments, a real comment, nothing."""
    r = requests(spark, sf)
    body = F.col("prompt")
    wrapped = case(
        F.col("turn") % 5, fenced(body), F.concat(F.lit("```\n"), body, F.lit("\n```")),
        F.concat(F.lit("```SQLite\n-- write your query here\n"), body, F.lit("\n  --SQL query\n```")),
        F.concat(F.lit("```sql\n-- SELECT old\n"), body, F.lit("\n```")), "")
    return r.select("instance_id", extract_sql(wrapped).alias("sql"))


@query("plain_sql", """SELECT doc_id, trim(text, chr(9)||chr(10)||chr(13)||chr(32)) AS sql FROM documents""")
def plain_sql(spark, sf):
    """Whole documents without a fence are taken as they are."""
    return table(spark, sf, "documents").select("doc_id", extract_sql(F.col("text")).alias("sql"))


def chat_lines(r):
    """A response line per request: most succeed, some fail with or without a message, some are broken."""
    pick = F.col("conv_id") % 6
    message = F.struct(F.struct(F.col("prompt").alias("content")).alias("message"))
    good = F.to_json(F.struct(F.col("instance_id").alias("custom_id"), F.struct(
        F.lit(200).alias("status_code"), F.struct(F.array(message).alias("choices")).alias("body")).alias("response")))
    bad = F.to_json(F.struct(F.col("instance_id").alias("custom_id"), F.struct(
        F.lit(429).alias("status_code"),
        F.struct(F.struct(F.lit("slow down").alias("message")).alias("error")).alias("body")).alias("response")))
    bare = F.to_json(F.struct(F.col("instance_id").alias("custom_id"), F.struct(F.lit(500).alias("status_code")).alias("response")))
    return r.select("instance_id", "pos", "conv_id", case(
        pick, good, good, good, bad, bare, F.concat(F.lit("{broken "), "prompt")).alias("value"))


@query("chat_responses", BASE + """
    SELECT instance_id, CASE WHEN conv_id % 6 < 3 THEN prompt ELSE '' END AS raw_response,
           CASE conv_id % 6 WHEN 3 THEN 'slow down' WHEN 4 THEN 'unknown error' END AS error FROM r WHERE conv_id % 6 < 5""")
def chat_responses(spark, sf):
    return B.parse_chat(chat_lines(requests(spark, sf))).select("instance_id", "raw_response", "error")


def message_lines(r):
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("prompt").alias("text")))
    good = F.to_json(F.struct(F.col("instance_id").alias("custom_id"), F.struct(
        F.lit("succeeded").alias("type"), F.struct(text.alias("content")).alias("message")).alias("result")))
    failed = F.to_json(F.struct(F.col("instance_id").alias("custom_id"), F.struct(
        F.lit("errored").alias("type"), F.struct(F.lit("invalid").alias("type")).alias("error")).alias("result")))
    expired = F.to_json(F.struct(F.col("instance_id").alias("custom_id"), F.struct(F.lit("expired").alias("type")).alias("result")))
    return r.select("instance_id", "pos", case(F.col("conv_id") % 4, good, good, failed, expired).alias("value"))


@query("messages_responses", BASE + """
    SELECT instance_id, CASE WHEN conv_id % 4 < 2 THEN prompt ELSE '' END AS raw_response,
           CASE conv_id % 4 WHEN 2 THEN 'errored: {"type":"invalid"}' WHEN 3 THEN 'expired: expired' END AS error FROM r""")
def messages_responses(spark, sf):
    return B.parse_messages(message_lines(requests(spark, sf))).select("instance_id", "raw_response", "error")


INLINE_SQL = BASE + """, p AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM r)
    SELECT instance_id, CASE WHEN i * 10 < n * 9 AND conv_id % 5 <> 4 THEN trim(prompt, chr(9)||chr(10)||chr(13)||chr(32)) ELSE '' END AS sql,
           CASE WHEN i * 10 >= n * 9 THEN 'missing from batch responses' WHEN conv_id % 5 = 4 THEN 'blocked' END AS error FROM p"""


@query("inline_responses", INLINE_SQL)
def inline_responses(spark, sf):
    """Answers by place only; the list is a tenth too short."""
    r = B.numbered(requests(spark, sf), "pos", "at").drop("pos").withColumnRenamed("at", "pos")
    n = r.count()
    good = F.to_json(F.struct(F.struct(F.col("prompt").alias("text")).alias("response")))
    bad = F.to_json(F.struct(F.lit("blocked").alias("error")))
    lines = r.where(F.col("pos") * 10 < n * 9).select(
        "pos", F.when(F.col("conv_id") % 5 == 4, bad).otherwise(good).alias("value"))
    asked = r.select("instance_id", "pos")
    return B.collect_results(asked, B.parse_inline(lines, asked), "inline").select("instance_id", "sql", "error")


COLLECT_SQL = BASE + """, b AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 50 AS batch FROM r)
    SELECT instance_id, CASE WHEN batch % 4 <> 3 AND conv_id % 6 < 3 THEN 'again ' || turn ELSE '' END AS sql,
           CASE WHEN batch % 4 = 3 THEN 'batch status: expired'
                WHEN conv_id % 6 = 3 THEN 'slow down' WHEN conv_id % 6 = 4 THEN 'unknown error'
                WHEN conv_id % 6 = 5 THEN 'missing from batch output' END AS error FROM b"""


def collected(spark, sf):
    """Each good answer comes twice, the last one counts; every fourth batch failed as a whole."""
    r = B.minibatches(requests(spark, sf))
    twice = chat_lines(r).unionByName(chat_lines(r.where("conv_id % 6 < 3").withColumn(
        "prompt", F.concat(F.lit("again "), F.col("turn").cast("string"))).withColumn("pos", F.col("pos") + 1000000)))
    failed = r.select("batch").distinct().where("batch % 4 = 3").withColumn("error", F.lit("batch status: expired"))
    return B.collect_results(r.select("instance_id", "batch"), B.parse_chat(twice), "chat_completions", failed)


@query("collected_results", COLLECT_SQL)
def collected_results(spark, sf):
    return collected(spark, sf).select("instance_id", "sql", "error")


@query("remaining_questions", BASE + "SELECT instance_id FROM r WHERE conv_id % 3 <> 0 OR turn > 1")
def remaining_questions(spark, sf):
    r = requests(spark, sf)
    done = r.where("conv_id % 3 = 0 AND turn <= 1").select("instance_id")
    return B.remaining(r, done).select("instance_id")


@query("remaining_bucketed", BASE + """
    SELECT instance_id, CAST(conv_id % 4 AS INTEGER) AS run FROM r WHERE conv_id % 4 < 3
    UNION ALL SELECT instance_id, 3 FROM r WHERE conv_id % 4 = 3""")
def remaining_bucketed(spark, sf):
    """Three runs that append to one bucketed table, each a part of what remains; a last look finds the rest.

    Every row of ``run`` is a request that was still open then and done by it, or open after all.
    """
    asked = requests(spark, sf).select("instance_id", "conv_id")
    with own_database(spark) as database:
        results = f"{database}.results"
        for run in range(3):
            todo = B.remaining(asked, collect.done(spark, results))
            collect.append_bucketed(todo.where(F.col("conv_id") % 4 == run).select("instance_id", F.lit(run).alias("run")), results, 8)
        left = B.remaining(asked, collect.done(spark, results)).select("instance_id", F.lit(3).alias("run"))
        return staged(spark.table(results).select("instance_id", "run").unionByName(left))


@query("pending_split", BASE + """
    SELECT instance_id, CASE WHEN conv_id % 4 = 1 THEN 'collect' ELSE 'send' END AS way FROM r""")
def pending_split(spark, sf):
    """Two unfinished batches, one of them lost: its requests are sent again."""
    r = requests(spark, sf)
    pending = r.where("conv_id % 4 IN (1, 2)").select(
        F.concat(F.lit("batch-"), (F.col("conv_id") % 4).cast("string")).alias("batch_id"), "instance_id")
    lost = pending.where("batch_id = 'batch-2'").select("batch_id").distinct()
    to_collect, to_send = B.split_pending(r, pending, lost)
    return to_collect.select("instance_id", F.lit("collect").alias("way")).unionByName(
        to_send.select("instance_id", F.lit("send").alias("way")))


@query("streamed_responses", BASE + """
    SELECT instance_id, CASE WHEN conv_id % 6 < 3 THEN trim(prompt, chr(9)||chr(10)||chr(13)||chr(32)) ELSE '' END AS sql,
           CASE conv_id % 6 WHEN 3 THEN 'slow down' WHEN 4 THEN 'unknown error' END AS error FROM r WHERE conv_id % 6 < 5""")
def streamed_responses(spark, sf):
    """Response files in two deliveries, collected by two runs that share a checkpoint."""
    inbox, results, marks = (fresh_path(spark, n) for n in ("inbox", "results", "marks"))
    lines = chat_lines(requests(spark, sf))
    for delivery in (0, 1):
        lines.where(F.col("conv_id") % 2 == delivery).select("value").write.mode("append").text(inbox)
        R.follow_responses(spark, inbox, "chat_completions", results, marks).awaitTermination()
    return R.collected(spark.read.parquet(results)).select("instance_id", "sql", "error")


@query("streamed_last_answer", BASE + """
    SELECT instance_id, trim(prompt, chr(9)||chr(10)||chr(13)||chr(32)) || ' -- ' || (conv_id % 3) AS sql,
           NULL AS error FROM r WHERE conv_id % 9 >= 3
    UNION ALL SELECT instance_id, '', 'missing from batch output' FROM r WHERE conv_id % 9 < 3""")
def streamed_last_answer(spark, sf):
    """Three deliveries that answer most requests again, each twice in a file: the state keeps the last answer of each."""
    inbox, results, marks = (fresh_path(spark, n) for n in ("inbox", "results", "marks"))
    asked = requests(spark, sf)
    for delivery in range(3):
        answers = F.array(F.lit("SELECT 0"), F.concat(F.trim("prompt", F.lit("\t\n\r ")), F.lit(f" -- {delivery}")))
        rows = asked.where((F.col("conv_id") % 9 >= 3) & (F.col("conv_id") % 3 >= delivery)).select(
            F.col("instance_id").alias("custom_id"), F.explode(answers).alias("text"))
        body = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
        response = F.struct(F.lit(200).alias("status_code"), body.alias("body"))
        rows.select(F.to_json(F.struct("custom_id", response.alias("response"))).alias("value")).write.mode("append").text(inbox)
        R.follow_last_answers(spark, inbox, "chat_completions", results, marks).awaitTermination()
    last = spark.read.parquet(results).withColumn("pos", F.lit(0))
    return B.collect_results(asked.select("instance_id"), last, "chat_completions").select("instance_id", "sql", "error")


@query("response_files", BASE + """
    SELECT 'chat_completions' AS layout, instance_id, trim(prompt, chr(9)||chr(10)||chr(13)||chr(32)) AS sql FROM r
    UNION ALL SELECT 'messages', instance_id, trim(prompt, chr(9)||chr(10)||chr(13)||chr(32)) FROM r
    UNION ALL SELECT 'inline', instance_id, trim(prompt, chr(9)||chr(10)||chr(13)||chr(32)) FROM r""")
def response_files(spark, sf):
    """The three layouts as files, read back; keyed ones answer each id twice, and the last counts."""
    asked = requests(spark, sf)
    out = None
    for layout in ("chat_completions", "messages", "inline"):
        folder = fresh_path(spark, "responses")
        if layout == "inline":
            numbered = B.numbered(asked, "pos", "at").drop("pos").withColumnRenamed("at", "pos")
            lines = numbered.select("pos", F.to_json(F.struct(F.struct(F.col("prompt").alias("text")).alias("response"))).alias("value"))
            lines.repartitionByRange(3, "pos").sortWithinPartitions("pos").select("value").write.text(folder)
            found = read_responses(spark, folder, layout, numbered.select("instance_id", "pos"))
        else:
            for n, text in enumerate((F.lit("SELECT 0"), F.col("prompt"))):
                content = F.struct(text.alias("text"))
                if layout == "messages":
                    body = F.struct("instance_id", F.struct(F.lit("succeeded").alias("type"), F.struct(
                        F.array(content).alias("content")).alias("message")).alias("result"))
                else:
                    body = F.struct("instance_id", F.struct(F.lit(200).alias("status_code"), F.struct(F.array(F.struct(
                        F.struct(text.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response"))
                line = F.replace(F.to_json(body), F.lit('"instance_id"'), F.lit('"custom_id"'))
                asked.select(line.alias("value")).write.text(f"{folder}/{n}")
            found = read_responses(spark, folder, layout)
        part = B.collect_results(asked.select("instance_id"), found, layout).select(
            F.lit(layout).alias("layout"), "instance_id", "sql")
        out = part if out is None else out.unionByName(part)
    return out


@query("pending_recorded", BASE + """
    SELECT instance_id, CASE WHEN conv_id % 4 = 1 THEN 'collect' WHEN conv_id % 4 = 2 THEN 'done' ELSE 'send' END AS way FROM r""")
def pending_recorded(spark, sf):
    """Two batches are noted before they go out; one is done when the next run looks."""
    path = fresh_path(spark, "pending")
    r = requests(spark, sf)
    for k in (1, 2):
        B.record_pending(r.where(F.col("conv_id") % 4 == k), path, f"batch-{k}")
    done = r.where("conv_id % 4 = 2").select("instance_id")
    to_collect, to_send = B.split_pending(B.remaining(r, done), B.read_pending(spark, path, done))
    ways = [(to_collect, "collect"), (to_send, "send"), (done, "done")]
    parts = [rows.select("instance_id", F.lit(way).alias("way")) for rows, way in ways]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def part_questions(spark, sf):
    """A question per part about its own row, over a database of the part table."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("instance_id"),
        F.lit("parts").alias("db_id"), "p_size")


@query("merged_results", """
    WITH c AS (SELECT p_size AS s, count(*) AS n FROM part GROUP BY 1)
    SELECT 'q' || p_partkey AS instance_id,
           CASE p_partkey % 5 WHEN 3 THEN '' WHEN 4 THEN 'SELECT 1' ELSE 'SELECT count(*) FROM part WHERE p_size = ' || (p_size % 10) END AS sql_answer,
           CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 1::BIGINT END AS n_rows,
           CASE p_partkey % 5 WHEN 3 THEN 'no SQL generated' WHEN 4 THEN 'rate limit' END AS error,
           CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE coalesce((SELECT n FROM c WHERE s = p_size % 10), 0)::DOUBLE END AS answer
    FROM part""")
def merged_results(spark, sf):
    """Results joined to their questions: equal statements run once, for all questions that share them."""
    q = part_questions(spark, sf)
    kind = F.col("pos") % 5
    statement = F.concat(F.lit("SELECT count(*) FROM part WHERE p_size = "), (F.col("p_size") % 10).cast("string"))
    results = q.select(
        "instance_id", F.when(kind == 3, "").when(kind == 4, "SELECT 1").otherwise(statement).alias("sql"),
        F.when(kind == 4, "rate limit").alias("error"))
    stray = results.limit(1).withColumn("instance_id", F.lit("unknown"))
    predictions, cells = collect.merge_results(
        spark, results.unionByName(stray), q, {"parts": {"part": f"{sf}/part.parquet"}})
    return predictions.join(cells.select("instance_id", F.col("num").alias("answer")), "instance_id", "left").select(
        "instance_id", "sql_answer", "n_rows", "error", "answer")


@query("whole_scoring", """
    WITH c AS (SELECT k, (SELECT count(*) FROM part WHERE p_size = k) AS n, (SELECT count(*) FROM part WHERE p_size = (k + 3) % 10) AS other
               FROM range(10) t(k)),
    d AS (SELECT 'json' AS model, CASE WHEN p_partkey % 3 = 0 THEN true ELSE false END AS correct, false AS failed FROM part
      UNION ALL SELECT 'tables', CASE p_partkey % 5 WHEN 2 THEN n = other WHEN 3 THEN false WHEN 4 THEN false ELSE true END,
             p_partkey % 5 IN (3, 4) FROM part JOIN c ON k = p_size % 10)
    SELECT model, round(count(*) FILTER (correct) / count(*), 4) AS score, count(*) FILTER (correct) AS correct, count(*) AS total,
           count(*) FILTER (failed) AS pred_errors, count(*) FILTER (NOT correct AND NOT failed) AS wrong_results, 0::BIGINT AS no_gold
    FROM d GROUP BY model""")
def whole_scoring(spark, sf):
    """Gold statements run, two models read (a JSON record and saved tables), compared and reported in one plan."""
    folder, database = fresh_path(spark, "predictions"), {"parts": {"part": f"{sf}/part.parquet"}}
    size = lambda c: F.concat(F.lit("SELECT count(*) FROM part WHERE p_size = "), (c % 10).cast("string"))
    asked = part_questions(spark, sf).withColumn("sql", size(F.col("p_size")))
    asked = asked.withColumns({c: F.lit(None).cast("string") for c in ("sql_gold", "query", "gold_sql")})
    kind = F.col("pos") % 5
    results = asked.select(
        "instance_id", F.when(kind == 3, "").when(kind == 2, size(F.col("p_size") + 3)).otherwise(size(F.col("p_size"))).alias("sql"),
        F.when(kind == 4, "rate limit").alias("error"))
    records.save_predictions(*collect.merge_results(spark, results, part_questions(spark, sf), database), folder, "tables")
    counts = table(spark, sf, "part").groupBy((F.col("p_size") - 0).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    right = asked.withColumn("size", F.col("p_size") % 10).join(counts, "size", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    right.select("instance_id", "db_id", F.col("sql").alias("sql_answer"), F.to_json(F.array(F.array(
        F.when(F.col("pos") % 3 == 0, F.col("n")).otherwise(F.col("n") + 7)))).alias("exec_answer")).write.json(f"{folder}/json.json")
    run = score_run(spark, asked, folder, ["json", "tables", "absent"], database)
    return run.scoreboard.join(run.breakdown.drop("correct"), "model")


@query("predictions_round_trip", """
    WITH c AS (SELECT p_size AS s, count(*) AS n FROM part GROUP BY 1)
    SELECT 'q' || p_partkey AS instance_id, p_partkey AS pos, 1::BIGINT AS n_rows, coalesce(n, 0)::DOUBLE AS answer
    FROM part LEFT JOIN c ON s = p_size % 10""")
def predictions_round_trip(spark, sf):
    """Answers saved as tables and loaded again: every cell in its place."""
    folder = fresh_path(spark, "predictions")
    asked = part_questions(spark, sf)
    results = asked.select("instance_id", F.concat(F.lit("SELECT count(*) FROM part WHERE p_size = "), (F.col("p_size") % 10).cast("string"))
                           .alias("sql"), F.lit(None).cast("string").alias("error"))
    records.save_predictions(*collect.merge_results(
        spark, results, asked, {"parts": {"part": f"{sf}/part.parquet"}}), folder, "m")
    rows, cells = records.load_predictions(spark, folder, ["m", "absent"])
    return rows.join(cells.select("instance_id", F.col("num").alias("answer")), "instance_id").select("instance_id", "pos", "n_rows", "answer")
