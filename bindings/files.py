"""Files: the tables are written in messy layouts to the shared folder and read back."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindings.registry import SPLIT_BYTES, file_count, query, table, vn_text
from gridsmith.plans import cleaning
from gridsmith.session import file_system, fresh_path, staged
from gridsmith.sources import files, records, tables

DELIMITERS = [",", ";", "\t", "|"]


def _write_delimited(df, path, sep, encoding="UTF-8"):
    df.write.option("sep", sep).option("escape", '"').option("header", True).option("encoding", encoding).csv(path)


def _order_files(spark, sf):
    """Orders in four folders, one per delimiter, several files each."""
    base = fresh_path(spark, "csv")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.concat(F.lit("Khách "), F.col("o_custkey").cast("string")).alias("name"),
        "o_orderpriority")
    for i, sep in enumerate(DELIMITERS):
        _write_delimited(orders.where(F.col("o_custkey") % 4 == i).repartition(3, "o_orderkey"), f"{base}/d{i}", sep)
    return base


@query("sniffed_files", """
    SELECT 'd' || (o_custkey % 4) AS folder, [',', ';', chr(9), '|'][o_custkey % 4 + 1] AS sep, 'UTF-8' AS encoding,
           false AS quoted_newlines, 4 AS width, CAST(NULL AS VARCHAR) AS error, 3::BIGINT AS files FROM orders GROUP BY o_custkey % 4""")
def sniffed_files(spark, sf):
    base = _order_files(spark, sf)
    found = files.sniff_files(spark, [f"{base}/d{i}" for i in range(4)])
    return found.groupBy(
        F.regexp_extract("path", r"/(d[0-9])/[^/]*$", 1).alias("folder"), "sep", "encoding", "quoted_newlines", "width",
        "error").agg(F.count(F.lit(1)).alias("files"))


@query("raw_grid", """
    SELECT CAST(o_orderkey AS VARCHAR) AS c0, CAST(o_custkey AS VARCHAR) AS c1, 'Khách ' || o_custkey AS c2, o_orderpriority AS c3
    FROM orders""")
def raw_grid(spark, sf):
    """Four delimiters read in one go; the header line of each file is a row like any other."""
    base = _order_files(spark, sf)
    grid = files.read_grid(spark, [f"{base}/d{i}" for i in range(4)])
    return grid.where("c0 <> 'o_orderkey'").select("c0", "c1", "c2", "c3")


@query("raw_grid_quoted", "SELECT CAST(doc_id AS VARCHAR) AS c0, text AS c1, lang AS c2 FROM documents")
def raw_grid_quoted(spark, sf):
    """Whole texts with line breaks and delimiters inside quoted cells."""
    path = fresh_path(spark, "csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    docs.repartition(file_count(spark, sf, "documents", 8), "doc_id").write.option("sep", ";").option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_grid(spark, path).select("c0", "c1", "c2")


@query("quoted_lines_split", "SELECT CAST(doc_id AS VARCHAR) AS c0, text AS c1, lang AS c2, source AS c3 FROM documents")
def quoted_lines_split(spark, sf):
    """All texts, line breaks and quote marks included, in one file for each two splits of the table; several tasks read each."""
    path = fresh_path(spark, "csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")
    docs.coalesce(file_count(spark, sf, "documents", 1, 2 * SPLIT_BYTES)).write.option("sep", ";").option("escape", '"').csv(path)
    return files.read_grid(spark, path).select("c0", "c1", "c2", "c3")


@query("raw_grid_windows", """
    SELECT CAST(doc_id AS VARCHAR) AS c0, replace(text, chr(10), ' ') || ' €' AS c1 FROM documents""")
def raw_grid_windows(spark, sf):
    """Windows-1252 texts: the euro sign sits where Latin-1 has a control character."""
    path = fresh_path(spark, "csv")
    control = bytes([0x80]).decode("latin-1")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" " + control)).alias("text"))
    docs.repartition(file_count(spark, sf, "documents", 8), "doc_id").write.option("sep", "|").option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return files.read_grid(spark, path).select("c0", "c1")


@query("late_windows_text", """
    SELECT CAST(doc_id AS VARCHAR) AS c0, translate(replace(text, chr(10), ' '), 'áéíóúñçèêäöüßàâëîïôùûœÄÖÜÉÈÊÇÑÁÍÓÚ', repeat('x', 37)) AS c1
    FROM documents WHERE doc_id >= 0 UNION ALL SELECT 'last', 'café 5 €'""")
def late_windows_text(spark, sf):
    """Texts without accents, and one Windows-1252 line after all of them: far beyond any head."""
    path = fresh_path(spark, "csv")
    accents = "áéíóúñçèêäöüßàâëîïôùûœÄÖÜÉÈÊÇÑÁÍÓÚ"
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.translate(F.replace("text", F.lit("\n"), F.lit(" ")), accents, "x" * len(accents)).alias("text"), "doc_id")
    euro = bytes([0x80]).decode("latin-1")
    last = spark.range(1).select(F.lit("last"), F.lit(f"café 5 {euro}"), F.lit(None).cast("bigint"))
    rows = docs.toDF("c0", "c1", "at").unionByName(last.toDF("c0", "c1", "at"))
    # Four files or more, the special line at the end of the last.
    rows.repartitionByRange(file_count(spark, sf, "documents", 4), F.col("at").asc_nulls_last()).sortWithinPartitions(F.col("at").asc_nulls_last()).drop("at").write.option(
        "sep", "|").option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return files.read_grid(spark, path).select("c0", "c1")


@query("quoted_commas", """
    SELECT CAST(doc_id AS VARCHAR) AS c0, replace(text, chr(10), ' ') AS c1, lang AS c2, 3 AS width FROM documents""")
def quoted_commas(spark, sf):
    """Prose in a comma file: the commas inside quoted cells make no columns."""
    path = fresh_path(spark, "csv")
    table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), "lang").repartition(
        file_count(spark, sf, "documents", 8), "doc_id").write.option("escape", '"').csv(path)
    grid = files.read_grid(spark, path)
    return grid.select("c0", "c1", "c2", F.lit(len(grid.columns) - 3).alias("width"))


def _messy_customers(spark, sf, n_files=4):
    """Customers with NA tokens, spreadsheet errors and copies, in several files with a header each."""
    path = fresh_path(spark, "csv")
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    rows = c.select(
        F.lpad(key.cast("string"), 9, "0").alias("Mã khách"),
        F.col("c_name").alias("Tên  khách"), F.when(key % 6 == 5, "n/a").otherwise(vn_text(F.col("c_acctbal") + 1000)).alias("Số dư (VNĐ)"),
        F.when(key % 9 == 7, "#REF!").otherwise(F.concat((key % 50).cast("string"), F.lit("%"))).alias("Chiết khấu"),
        F.when(key % 2 == 0, "Có").otherwise("Không").alias("Hoạt động"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 300).cast("int")), "dd/MM/yyyy").alias("Ngày tạo"),
        F.explode(F.sequence(F.lit(1), F.when(key % 4 == 0, 2).otherwise(1))).alias("_copy"))
    rows = rows.drop("_copy").repartitionByRange(n_files, "Mã khách").sortWithinPartitions("Mã khách")
    _write_delimited(rows, path, ";")
    return path


CUSTOMER_SQL = """
    SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS mã_khách, c_name AS tên_khách,
           CASE WHEN c_custkey % 6 <> 5 THEN round(c_acctbal + 1000, 2) END AS số_dư_vnđ,
           CASE WHEN c_custkey % 9 <> 7 THEN round((c_custkey % 50) / 100.0, 6)::DOUBLE END AS chiết_khấu,
           CAST(1 - c_custkey % 2 AS INTEGER) AS hoạt_động,
           strftime(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') AS ngày_tạo
    FROM customer"""


@query("cleaned_table", CUSTOMER_SQL)
def cleaned_table(spark, sf):
    """Two files, each cleaned on its own as one table."""
    names = files.list_files(spark, _messy_customers(spark, sf, 2)).collect()
    return reduce(DataFrame.unionByName, [cleaning.clean_table(spark, r.uri) for r in names])


@query("cleaned_files", CUSTOMER_SQL)
def cleaned_files(spark, sf):
    """Every file of the folder to a published table: header, dittos, tokens, types, copies; all read back."""
    out = fresh_path(spark, "published")
    status = cleaning.clean_corpus(spark, _messy_customers(spark, sf), out)
    paths = [f"{out}/{r.table_name}" for r in status.where("status = 'published'").collect()]
    return spark.read.parquet(*paths)


@query("cleaning_status", """
    SELECT 'published' AS status, 6 AS n_columns, 4::BIGINT AS n FROM customer HAVING count(*) > 0
    UNION ALL SELECT 'skipped', 6, 4 FROM customer HAVING count(*) > 0
    UNION ALL SELECT 'failed', CAST(NULL AS INTEGER), 1 FROM customer HAVING count(*) > 0""")
def cleaning_status(spark, sf):
    """The same folder twice, plus a file with a header only: published, then skipped; one failure."""
    path = _messy_customers(spark, sf)
    out = fresh_path(spark, "published")
    first = cleaning.clean_corpus(spark, path, out)
    lone = fresh_path(spark, "csv")
    table(spark, sf, "region").agg(F.max("r_name").alias("x")).write.csv(lone)
    second = cleaning.clean_corpus(spark, [path, lone], out)
    both = first.unionByName(second)
    return both.groupBy("status", "n_columns").agg(F.count(F.lit(1)).alias("n"))


@query("missing_input_file", """
    SELECT 'published' AS status, CAST(NULL AS VARCHAR) AS error, 4::BIGINT AS n FROM customer HAVING count(*) > 0
    UNION ALL SELECT 'failed', 'file not found', 2 FROM customer HAVING count(*) > 0""")
def missing_input_file(spark, sf):
    """Two requested files that are not there are status rows; the folder is cleaned all the same."""
    path = _messy_customers(spark, sf)
    gone = [f"{path}/gone-{i}.csv" for i in range(2)]
    status = cleaning.clean_corpus(spark, [path, *gone], fresh_path(spark, "published"))
    error = F.regexp_extract("error", "^file not found", 0)
    return status.groupBy("status", F.when(F.col("error").isNotNull(), error).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("colliding_names", """
    SELECT c_custkey, c_name, 'failed,failed,published' AS statuses FROM customer WHERE c_custkey % 3 = 0""")
def colliding_names(spark, sf):
    """Three files of one table name: the first by path is published, whole and alone."""
    base, out = fresh_path(spark, "csv"), fresh_path(spark, "published")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    for i, name in enumerate(("a-b.csv", "a.b.csv", "a_b.csv")):
        part = f"{base}/part{i}"
        _write_delimited(customers.where(F.col("c_custkey") % 3 == i).repartition(1), part, ";")
        system, source = file_system(spark, spark.read.format("binaryFile").load(part).inputFiles()[0])
        system.rename(source, file_system(spark, f"{base}/{name}")[1])
    status = cleaning.clean_corpus(spark, f"{base}/*.csv", out).agg(
        F.array_join(F.array_sort(F.collect_list("status")), ",")).first()[0]
    return spark.read.parquet(f"{out}/a_b").withColumn("statuses", F.lit(status))


@query("empty_table_twice", """
    SELECT p_partkey, p_name, 'error,error,published,skipped' AS runs FROM part""")
def empty_table_twice(spark, sf):
    """An empty table is an error each time and leaves nothing; then the table itself is published."""
    path = fresh_path(spark, "published")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    runs = []
    for rows in (part.where("p_partkey < 0"), part.where("p_partkey < 0"), part, part):
        try:
            runs.append(tables.publish(rows, "part", path=path))
        except ValueError:
            runs.append("error")
    return spark.read.parquet(path).withColumn("runs", F.lit(",".join(runs)))


@query("published_table", """
    SELECT p_partkey, p_name, p_retailprice, 'skipped' AS second_run FROM part""")
def published_table(spark, sf):
    """A second run finds the table and leaves it."""
    path = fresh_path(spark, "published")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    tables.publish(part, "part", path=path)
    again = tables.publish(part.where("p_partkey < 0"), "part", path=path)
    return spark.read.parquet(path).withColumn("second_run", F.lit(again))


@contextmanager
def own_database(spark):
    """A catalog database for one query."""
    base = fresh_path(spark, "db")
    name = "gs_" + base.rsplit("-", 1)[1][:12]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{base}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


@query("first_table", "SELECT s_suppkey, s_name FROM supplier")
def first_table(spark, sf):
    """The first table of a database holds the suppliers; a later name does not."""
    with own_database(spark) as database:
        tables.publish(table(spark, sf, "supplier").select("s_suppkey", "s_name"), f"{database}.b_suppliers")
        tables.publish(table(spark, sf, "part").select("p_partkey"), f"{database}.c_parts")
        return staged(spark.table(f"{database}.{tables.first_table(spark, database)}"))


@query("replaced_table", """
    SELECT place, p_partkey, p_name || ' new' AS p_name, 'published,error,skipped,published,error' AS runs
    FROM part, (VALUES ('catalog'), ('folder')) AS v(place) WHERE p_partkey % 3 <> 0""")
def replaced_table(spark, sf):
    """Published, not replaced by an empty table, skipped, replaced; as a folder and in the catalog."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    new = part.where("p_partkey % 3 <> 0").withColumn("p_name", F.concat("p_name", F.lit(" new")))
    none = part.where("p_partkey < 0")
    with own_database(spark) as database:
        out = []
        for place, path in (("catalog", None), ("folder", fresh_path(spark, "published"))):
            runs = []
            for rows, overwrite in ((part, False), (none, True), (new, False), (new, True), (none, True)):
                try:
                    runs.append(tables.publish(rows, f"{database}.part", overwrite, path))
                except ValueError:
                    runs.append("error")
            found = spark.read.parquet(path) if path else spark.table(f"{database}.part")
            out.append(found.select(F.lit(place).alias("place"), "p_partkey", "p_name", F.lit(",".join(runs)).alias("runs")))
        return staged(out[0].union(out[1]))


@query("catalog_names", """
    SELECT CASE c_custkey % 3 WHEN 0 THEN 'sales_2020' WHEN 1 THEN 'diem_thi_v2' ELSE 'table_of_all' END AS table_name, c_custkey, c_name FROM customer""")
def catalog_names(spark, sf):
    """Files with blanks, accents and dots in their names, published to the catalog."""
    base = fresh_path(spark, "csv")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    for i, name in enumerate(("sales 2020.csv", "điểm thi.v2.csv", "Table of-all.csv")):
        part = f"{base}/part{i}"
        _write_delimited(customers.where(F.col("c_custkey") % 3 == i).repartition(1), part, ";")
        system, source = file_system(spark, spark.read.format("binaryFile").load(part).inputFiles()[0])
        system.rename(source, file_system(spark, f"{base}/{name}")[1])
    with own_database(spark) as database:
        status = cleaning.clean_corpus(spark, f"{base}/*.csv", database=database).where("status = 'published'").collect()
        return staged(reduce(DataFrame.unionByName, [
            spark.table(f"{database}.{r.table_name}").withColumn("table_name", F.lit(r.table_name)) for r in status]))


@query("many_tables", """
    SELECT c_nationkey + 10 AS nation, c_mktsegment AS segment, c_custkey + 1000 AS customer, c_name AS name,
           (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer) AS n_published FROM customer""")
def many_tables(spark, sf):
    """A file for each nation and segment, every one a table of its own; those of one schema are written by one job."""
    base, out = fresh_path(spark, "csv"), fresh_path(spark, "published")
    # Every customer twice, so that no file is too short for a table; no number reads as a truth value.
    customers = table(spark, sf, "customer").select(
        (F.col("c_nationkey") + 10).alias("nation"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") + 1000).alias("customer"),
        F.col("c_name").alias("name"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("_copy"))
    key = F.concat_ws("_", F.lit("t"), F.col("nation").cast("string"), F.regexp_replace("segment", "[^A-Za-z]", "")).alias("file")
    rows = customers.drop("_copy").withColumn("file", key).repartition(8, "file")
    rows.write.partitionBy("file").option("sep", ";").option("header", True).csv(base)
    for name in spark.read.format("binaryFile").load(base).inputFiles():
        system, source = file_system(spark, name)
        system.rename(source, file_system(spark, f"{base}/{name.split('/file=')[1].split('/')[0]}.csv")[1])
    status = cleaning.clean_corpus(spark, f"{base}/*.csv", out).where("status = 'published'").collect()
    read = spark.read.schema("nation long, segment string, customer long, name string").parquet(*[f"{out}/{r.table_name}" for r in status])
    return read.withColumn("n_published", F.lit(len(status)).cast("long"))


@query("marked_beside_plain", """
    SELECT 'marked' AS table_name, c_custkey + 1000 AS id, 'nation ' || c_nationkey AS label FROM customer
    UNION ALL SELECT 'plain', o_orderkey + 1000, o_orderpriority FROM orders""")
def marked_beside_plain(spark, sf):
    """A table with ditto marks beside a larger one without: only the first passes the window that fills them."""
    base, out = fresh_path(spark, "csv"), fresh_path(spark, "published")
    above = F.lag("c_nationkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    marked = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000).alias("id"), F.when(above.isNotNull(), "nt").otherwise(
            F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).alias("label"), "c_nationkey")
    plain = table(spark, sf, "orders").select((F.col("o_orderkey") + 1000).alias("id"), F.col("o_orderpriority").alias("label"))
    for name, rows in (("marked", marked.repartition(1).sortWithinPartitions("c_nationkey", "id").drop("c_nationkey")),
                       ("plain", plain.repartition(1))):
        _write_delimited(rows, f"{base}/{name}", ";")
        system, source = file_system(spark, spark.read.format("binaryFile").load(f"{base}/{name}").inputFiles()[0])
        system.rename(source, file_system(spark, f"{base}/{name}.csv")[1])
    status = cleaning.clean_corpus(spark, f"{base}/*.csv", out).where("status = 'published'").collect()
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{out}/{r.table_name}").select(
        F.lit(r.table_name).alias("table_name"), "id", "label") for r in status])


WIDE = 120


@query("wide_beside_narrow", f"""
    SELECT 'wide' AS table_name, c_custkey + 1000 AS id, {WIDE} * (c_custkey * 200 + 1000) + {WIDE * (WIDE - 1) // 2} AS total FROM customer
    UNION ALL SELECT 'narrow', o_orderkey + 1000, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders""")
def wide_beside_narrow(spark, sf):
    """A file of many columns beside a longer one of two: each is cleaned in a grid of its own width."""
    base, out = fresh_path(spark, "csv"), fresh_path(spark, "published")
    measures = [f"m{i}" for i in range(WIDE)]
    wide = table(spark, sf, "customer").select((F.col("c_custkey") + 1000).alias("id"), *[
        (F.col("c_custkey") * 200 + 1000 + i).alias(m) for i, m in enumerate(measures)])
    narrow = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1000).alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    for name, rows in (("wide", wide), ("narrow", narrow)):
        _write_delimited(rows.repartition(1), f"{base}/{name}", ";")
        system, source = file_system(spark, spark.read.format("binaryFile").load(f"{base}/{name}").inputFiles()[0])
        system.rename(source, file_system(spark, f"{base}/{name}.csv")[1])
    cleaning.clean_corpus(spark, f"{base}/*.csv", out)
    total = reduce(lambda a, b: a + b, [F.col(m) for m in measures])
    return spark.read.parquet(f"{out}/wide").select(F.lit("wide").alias("table_name"), "id", total.alias("total")).unionByName(
        spark.read.parquet(f"{out}/narrow").select(F.lit("narrow").alias("table_name"), "id", F.col("cents").alias("total")))


QUESTION_FILE_SQL = """
    SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS pos, 'db_' || (conv_id % 7) AS db_id, text AS question,
           CASE WHEN turn % 3 = 0 THEN 'hint ' || turn END AS external_knowledge
    FROM conversations"""


def question_records(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("db_"), (F.col("conv_id") % 7).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("hint "), F.col("turn").cast("string"))).alias("external_knowledge"))


@query("questions_file", QUESTION_FILE_SQL)
def questions_file(spark, sf):
    """Question lines over several files; a question's position is its place in file order."""
    path = fresh_path(spark, "questions")
    question_records(spark, sf).repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").drop(
        "conv_id", "turn").write.json(path)
    return records.read_questions(spark, path).select("pos", "db_id", "question", "external_knowledge")


@query("questions_array", QUESTION_FILE_SQL)
def questions_array(spark, sf):
    """The same questions as JSON arrays, one per conversation; positions continue over the files."""
    path = fresh_path(spark, "questions")
    _array_files(question_records(spark, sf), path, sf)
    return records.read_questions(spark, path).select("pos", "db_id", "question", "external_knowledge")


@query("questions_array_split", QUESTION_FILE_SQL)
def questions_array_split(spark, sf):
    """All questions as one indented JSON array that several tasks read: positions as in the array."""
    path = fresh_path(spark, "questions")
    rows = question_records(spark, sf).withColumn("of", F.struct(F.lit("{").alias("open"), F.array(F.lit("]")).alias("shut")))
    ordered = rows.repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    line = F.to_json(F.struct("db_id", "question", "external_knowledge", "of"), {"pretty": "true"})
    first = rows.agg(F.min(F.struct("conv_id", "turn"))).first()[0]
    opens = (F.col("conv_id") == first.conv_id) & (F.col("turn") == first.turn)
    texts = ordered.select(F.concat(F.when(opens, "[\n").otherwise(",\n"), line).alias("value"))
    end = spark.range(1).select(F.lit("\n]").alias("value"))
    texts.union(end).coalesce(1).write.option("lineSep", "\n").text(path)
    return records.read_questions(spark, path).select("pos", "db_id", "question", "external_knowledge")


def _array_files(rows, path, sf):
    """A JSON array per conversation, a few turns each, in a file of its own."""
    per_file = rows.groupBy("conv_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "db_id", "question", "external_knowledge"))),
        lambda q: F.struct(q["db_id"].alias("db_id"), q["question"].alias("question"),
                           q["external_knowledge"].alias("external_knowledge")))).alias("value"))
    # A folder for two hundred ids at most, as Spark looks each folder up by a task. Every task moves its own files to their
    # place: one after the other, the driver would take longer than the tasks.
    folder = F.format_string("%08d", F.floor(F.col("conv_id") / 200)).alias("convs")
    per_file.select("conv_id", folder, "value").repartition(file_count(rows.sparkSession, sf, "conversations", 8, 1 << 20), "convs").sortWithinPartitions(
        "convs", "conv_id").select("convs", "value").write.partitionBy("convs").option("maxRecordsPerFile", 1).option(
        "lineSep", "\n").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


@query("mixed_question_folder", QUESTION_FILE_SQL.replace("ORDER BY conv_id, turn", "ORDER BY conv_id % 2, conv_id, turn"))
def mixed_question_folder(spark, sf):
    """Line files and array files side by side: each is read in its own layout."""
    path = fresh_path(spark, "questions")
    rows = question_records(spark, sf)
    rows.where("conv_id % 2 = 0").repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").drop(
        "conv_id", "turn").write.json(f"{path}/lines")
    _array_files(rows.where("conv_id % 2 = 1"), f"{path}/second", sf)
    return records.read_questions(spark, [f"{path}/lines", f"{path}/second"]).select(
        "pos", "db_id", "question", "external_knowledge")


@query("broken_question_file", """
    SELECT count(*) FILTER (turn % 3 <> 2) AS good, count(*) FILTER (turn % 3 = 2) + 1 AS broken, true AS refused FROM conversations""")
def broken_question_file(spark, sf):
    """Every third turn is no JSON, and one array has a comma too many: all are reported, none is lost."""
    path = fresh_path(spark, "questions")
    turns = table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.col("text").alias("question")))
    turns.select(F.when(F.col("turn") % 3 == 2, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(f"{path}/lines")
    turns.agg(F.concat(F.lit("["), F.max(line), F.lit(",]")).alias("value")).write.text(f"{path}/array")
    both = [f"{path}/lines", f"{path}/array"]
    try:
        records.read_questions(spark, both).agg(F.max("question")).collect()
        refused = False
    except Exception as error:  # noqa: BLE001 - the job names the file
        refused = "no valid JSON in" in str(error)
    return records.read_questions(spark, both, broken="report").agg(
        F.count_if(F.col("corrupt").isNull()).alias("good"), F.count("corrupt").alias("broken")).withColumn("refused", F.lit(refused))


@query("prediction_files", """
    SELECT 'standard' AS layout, 'alpha' AS model, count(*) AS n, sum(length(text)) ::BIGINT AS chars FROM conversations
    UNION ALL SELECT 'reparsed', 'beta', count(*), sum(length(text))::BIGINT FROM conversations""")
def prediction_files(spark, sf):
    """One model with standard predictions, one with reparsed ones, one with none."""
    path = fresh_path(spark, "predictions")
    turns = table(spark, sf, "conversations")
    turns.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("instance_id"),
        F.col("text").alias("sql_answer"), F.array(F.array(F.col("turn"))).alias("exec_answer")).write.json(f"{path}/alpha.json")
    turns.select(F.col("turn").alias("index"), F.lit("d").alias("db_id"), F.col("text").alias("sql"),
                 F.lit("[1]").alias("result")).write.json(f"{path}/beta.reparsed.json")
    found = records.read_predictions(spark, path, ["alpha", "beta", "gamma"])
    out = None
    for layout, sql in (("standard", "sql_answer"), ("reparsed", "sql")):
        part = found[layout].groupBy(F.lit(layout).alias("layout"), "model").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length(sql)).alias("chars"))
        out = part if out is None else out.unionByName(part)
    return out


@query("result_records", "SELECT doc_id, text, lang FROM documents")
def result_records(spark, sf):
    path = fresh_path(spark, "records")
    records.write_records(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id bigint, text string, lang string").json(path)
