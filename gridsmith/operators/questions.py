"""Questions: defaults, prompts, gold statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.text import strip

# The three placeholders of a prompt template.
SCHEMA_SLOT, EVIDENCE_SLOT, QUESTION_SLOT = "{DATABASE SCHEMA}", "{EVIDENCE}", "{QUESTION}"

DEFAULT_TEMPLATE = (
    "Write one SQL query that answers the question below.\n\n"
    "Tables:\n{DATABASE SCHEMA}\n\nQuestion:\n{EVIDENCE}{QUESTION}\n\n"
    "Return exactly the columns asked for, in a fenced block:\n```\n-- Your SQL query\n```\n"
)
# Fixed value: the error of a question whose table is not there.
NO_TABLE = "SQLite conversion failed"


def normalize(questions: DataFrame) -> DataFrame:
    """Fill file name, evidence and id where they are missing; ``pos`` is the place in the file."""
    return (
        questions
        .withColumn("csv_file", F.coalesce("csv_file", F.concat("db_id", F.lit(".csv"))))
        .withColumn("evidence", F.coalesce("evidence", "external_knowledge", F.lit("")))
        .withColumn("instance_id", F.coalesce("instance_id", F.concat_ws("_", "db_id", F.col("pos").cast("string"))))
    )


def first_questions(questions: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` by position; a top-n per task, then one of the short lists."""
    return questions if n is None else questions.orderBy("pos").limit(n)


def input_files(questions: DataFrame) -> DataFrame:
    """Every input file once, sorted."""
    file = F.coalesce("csv_file", F.concat("db_id", F.lit(".csv")))
    return questions.select(file.alias("csv_file")).distinct().orderBy("csv_file")


def prompt_text(template: str, schema: Column, evidence: Column, question: Column) -> Column:
    """Schema, then evidence, then question, put literally into the template."""
    block = F.when(
        F.coalesce(strip(evidence), F.lit("")) != "", F.concat(F.lit("Evidence: "), strip(evidence), F.lit("\n"))
    ).otherwise("")
    out = F.replace(F.lit(template), F.lit(SCHEMA_SLOT), schema)
    out = F.replace(out, F.lit(EVIDENCE_SLOT), block)
    return F.replace(out, F.lit(QUESTION_SLOT), question)


def build_prompts(questions: DataFrame, schemas: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``instance_id, prompt, error`` per question; a question without a table gets the error.

    ``schemas`` is ``db_id, text``, described once per table. The join carries no broadcast hint:
    adaptive execution broadcasts the schemas if their measured size allows, and otherwise
    splits the questions of a hot database over several tasks.
    """
    joined = questions.join(schemas.select("db_id", F.col("text").alias("_schema")), "db_id", "left")
    prompt = prompt_text(template, F.col("_schema"), F.col("evidence"), F.col("question"))
    return joined.select(
        *questions.columns, F.when(F.col("_schema").isNotNull(), prompt).alias("prompt"),
        F.when(F.col("_schema").isNull(), NO_TABLE).alias("error"))


def gold_sql(questions: DataFrame) -> DataFrame:
    """Add ``gold``: the first non-empty of the four names a gold statement may have."""
    names = ["sql", "sql_gold", "query", "gold_sql"]
    return questions.withColumn("gold", F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names]))
