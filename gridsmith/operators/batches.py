"""Batch requests and responses as tables.

Three layouts: ``chat_completions`` (keyed lines with a status code), ``messages`` (keyed lines with
a result type) and ``inline`` (positional, without keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.functions.statements import extract_sql
from gridsmith.operators.ordering import numbered

# Error texts of answers that never came.
MISSING = {
    "chat_completions": "missing from batch output",
    "messages": "missing from batch results",
    "inline": "missing from batch responses",
}

CHAT_RESPONSE = (
    "custom_id string, response struct<status_code: int, body: struct<choices: array<struct<message: "
    "struct<content: string>>>, error: struct<message: string>>>"
)
MESSAGES_RESPONSE = (
    "custom_id string, result struct<type: string, message: struct<content: array<struct<text: string>>>, "
    "error: string>"
)
INLINE_RESPONSE = "response struct<text: string>, error string"


def minibatches(requests: DataFrame, size: int = V.MINIBATCH_SIZE, order: str = "pos") -> DataFrame:
    """Add ``batch``: consecutive groups of ``size`` in file order, numbered without a global sort."""
    return numbered(requests, order, "_at").withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def request_line(layout: str, model: str, max_tokens: int | None = None) -> Column:
    """One request of ``instance_id, prompt`` as a JSON text."""
    limit = F.lit(V.MAX_TOKENS[layout] if max_tokens is None else max_tokens)
    if layout == "inline":
        parts = F.array(F.struct(F.col("prompt").alias("text")))
        return F.to_json(F.struct(F.array(F.struct(parts.alias("parts"))).alias("contents")))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages")
    if layout == "messages":
        params = F.struct(F.lit(model).alias("model"), limit.alias("max_tokens"), messages)
        return F.to_json(F.struct(F.col("instance_id").alias("custom_id"), params.alias("params")))
    body = F.struct(F.lit(model).alias("model"), messages, limit.alias("max_tokens"))
    return F.to_json(F.struct(
        F.col("instance_id").alias("custom_id"), F.lit("POST").alias("method"),
        F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def to_batch_requests(prompts: DataFrame, layout: str, model: str = "", max_tokens: int | None = None,
                      size: int = V.MINIBATCH_SIZE) -> DataFrame:
    """``batch, pos, instance_id, line`` for the prompts that have a table."""
    ready = prompts.where(F.col("prompt").isNotNull())
    return minibatches(ready, size).select(
        "batch", "pos", "instance_id", request_line(layout, model, max_tokens).alias("line"))


def write_requests(requests: DataFrame, path: str) -> None:
    """A folder of JSON lines per minibatch, in request order.

    A range shuffle by position keeps each minibatch together and spreads the whole evenly.
    """
    requests.repartitionByRange("batch", "pos").sortWithinPartitions("batch", "pos").select(
        "batch", "line").write.mode("overwrite").partitionBy("batch").text(path)


def parse_chat(lines: DataFrame) -> DataFrame:
    """Keyed responses with a status code; a line that is no JSON, or has no id, is skipped."""
    r = F.from_json("value", CHAT_RESPONSE)
    parsed = lines.select("pos", r.alias("r")).where("r.custom_id IS NOT NULL")
    ok = F.coalesce(F.col("r.response.status_code") == 200, F.lit(False))
    answer = F.get(F.col("r.response.body.choices"), F.lit(0))["message"]
    # A success without any message is a line that cannot be read.
    return parsed.where(~ok | answer.isNotNull()).select(
        "pos", F.col("r.custom_id").alias("instance_id"),
        F.when(ok, F.coalesce(answer["content"], F.lit(""))).otherwise("").alias("raw_response"),
        F.when(~ok, F.coalesce("r.response.body.error.message", F.lit("unknown error"))).alias("error"))


def parse_messages(lines: DataFrame) -> DataFrame:
    """Keyed responses with a result type: the first text block, or ``<type>: <error>``."""
    r = F.from_json("value", MESSAGES_RESPONSE)
    parsed = lines.select("pos", r.alias("r")).where("r.custom_id IS NOT NULL")
    ok = F.coalesce(F.col("r.result.type") == "succeeded", F.lit(False))
    content = F.get(F.col("r.result.message.content"), F.lit(0))["text"]
    failure = F.concat_ws(": ", "r.result.type", F.coalesce("r.result.error", "r.result.type"))
    return parsed.select(
        "pos", F.col("r.custom_id").alias("instance_id"),
        F.when(ok, F.coalesce(content, F.lit(""))).otherwise("").alias("raw_response"),
        F.when(~ok, failure).alias("error"))


def parse_inline(lines: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Positional responses: the i-th belongs to the i-th request. Both sides carry ``keys``, the
    place in the request list, as ``pos`` or as batch and place."""
    r = F.from_json("value", INLINE_RESPONSE)
    parsed = lines.select(*keys, r.alias("r"))
    text = F.col("r.response.text")
    return requests.select("instance_id", *keys).join(parsed, list(keys)).select(
        "pos", "instance_id", F.coalesce(text, F.lit("")).alias("raw_response"),
        F.when(text.isNull(), F.coalesce("r.error", F.lit("no response text"))).alias("error"))


def parse_responses(lines: DataFrame, layout: str, requests: DataFrame | None = None) -> DataFrame:
    if layout not in MISSING:
        raise ValueError(f"unknown layout: {layout}")
    if layout == "inline":
        return parse_inline(lines, requests)
    return parse_chat(lines) if layout == "chat_completions" else parse_messages(lines)


def last_response(responses: DataFrame) -> DataFrame:
    """The last response of each id. Duplicates meet map-side, so a hot id is no hot task."""
    last = responses.groupBy("instance_id").agg(
        F.max_by(F.struct("raw_response", "error"), "pos").alias("r"))
    return last.select("instance_id", "r.raw_response", "r.error")


def collect_results(requests: DataFrame, responses: DataFrame, layout: str,
                    failed: DataFrame | None = None) -> DataFrame:
    """``instance_id, sql, raw_response, error`` for every request.

    A request without a response gets the layout's error text. ``failed`` (``batch, error``) names
    batches that ended badly: all their requests carry that error.
    """
    joined = requests.join(last_response(responses).withColumn("_here", F.lit(True)), "instance_id", "left")
    error = F.when(F.col("_here").isNull(), F.lit(MISSING[layout])).otherwise(F.col("error"))
    raw = F.coalesce("raw_response", F.lit(""))
    out = joined.select(*requests.columns, raw.alias("raw_response"), error.alias("error"))
    if failed is not None:
        out = out.join(failed.select("batch", F.col("error").alias("_failed")), "batch", "left").select(
            *requests.columns,
            F.when(F.col("_failed").isNotNull(), "").otherwise(F.col("raw_response")).alias("raw_response"),
            F.coalesce("_failed", "error").alias("error"))
    sql = F.when(F.col("error").isNull(), extract_sql(F.col("raw_response"))).otherwise("")
    return out.select("instance_id", sql.alias("sql"), "raw_response", "error")


def remaining(questions: DataFrame, done: DataFrame | None, fresh: bool = False) -> DataFrame:
    """Questions without a result yet; ``fresh`` starts over."""
    if fresh or done is None:
        return questions
    return questions.join(done.select("instance_id"), "instance_id", "left_anti")


def split_pending(requests: DataFrame, pending: DataFrame, lost: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(to_collect, to_send)``: requests of an unfinished batch are collected, not sent again.

    ``pending`` is ``batch_id, instance_id``; ``lost`` holds the ``batch_id`` of batches that could not be
    collected, whose requests are sent again.
    """
    live = pending if lost is None else pending.join(lost.select("batch_id"), "batch_id", "left_anti")
    ids = live.select("instance_id").distinct()
    return requests.join(ids, "instance_id", "left_semi"), requests.join(ids, "instance_id", "left_anti")


def record_pending(requests: DataFrame, path: str, batch_id: str) -> None:
    """Note which requests go out as a batch, before they are sent: a run that dies while it waits
    finds them by ``read_pending`` and collects the batch."""
    requests.select(F.lit(batch_id).alias("batch_id"), "instance_id").write.mode("append").parquet(path)


def read_pending(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """``batch_id, instance_id`` of the requests sent and not done yet."""
    rows = spark.read.parquet(path)
    left = rows if done is None else rows.join(done.select("instance_id"), "instance_id", "left_anti")
    return left.select("batch_id", "instance_id")
