import random

import pytest
from pyspark.sql import functions as F

from gridsmith.operators import grid as G
from gridsmith.plans import cleaning
from gridsmith.sources import files


def write(folder, name, content, encoding="utf-8"):
    path = folder / name
    path.write_bytes(content.encode(encoding))
    return str(path)


GRID_A = """BÁO CÁO DOANH THU;;;;
Mã số;Tên hàng;Số lượng;Đơn giá;Ngày bán
001;Bút bi;10;1.500,50;05/01/2024
002;nt;12;2.000,00;06/01/2024
003;Vở;n/a;12.500,00;07/01/2024
004;Thước;7;#REF!;08/01/2024
005;Gôm;15;3.250,75;09/01/2024
006;Mực;20;1.234.567,89;10/01/2024
006;Mực;20;1.234.567,89;10/01/2024
"""
GRID_B = "Khu vực,Doanh thu,Doanh thu,Chi phí\nTỉnh,Quý 1,Quý 2,Cả năm\nHà Nội,10,20,5\nHuế,30,40,6\n"


@pytest.mark.parametrize("strict", [False, True])
def test_title_header_dittos_and_tokens(spark, tmp_path, strict):
    path = write(tmp_path, "a.csv", GRID_A)
    df = cleaning.clean_table(spark, path, strict=strict, keep_order=True)
    assert df.dtypes == [("mã_số", "string"), ("tên_hàng", "string"), ("số_lượng", "bigint"), ("đơn_giá", "double"),
                         ("ngày_bán", "string"), ("block", "bigint"), ("seq", "bigint")]
    rows = [tuple(r)[:5] for r in df.orderBy("block", "seq").collect()]
    assert rows[0] == ("001", "Bút bi", 10, 1500.5, "2024-01-05")
    assert rows[1][1] == "Bút bi" and rows[2][2] is None and rows[3][3] is None
    assert len(rows) == 6 and rows[5] == ("006", "Mực", 20, 1234567.89, "2024-01-10")


def test_two_header_rows(spark, tmp_path):
    path = write(tmp_path, "b.csv", GRID_B)
    df = cleaning.clean_table(spark, path)
    assert df.dtypes == [("khu_vực_tỉnh", "string"), ("doanh_thu_quý_1", "bigint"), ("doanh_thu_quý_2", "bigint"),
                         ("chi_phí_cả_năm", "bigint")]
    assert df.count() == 2
    strict = cleaning.clean_table(spark, path, strict=True)
    assert strict.dtypes == [(n, "string") for n in ("khu_vực", "doanh_thu", "doanh_thu_2", "chi_phí")]
    assert strict.count() == 3


@pytest.mark.parametrize("strict", [False, True])
def test_two_columns(spark, tmp_path, strict):
    path = write(tmp_path, "c.csv", "k,v\na,5\nb,6\n")
    df = cleaning.clean_table(spark, path, strict=strict)
    assert df.dtypes == [("k", "string"), ("v", "bigint")] and df.count() == 2


def test_empty_rows_and_columns(spark, tmp_path):
    path = write(tmp_path, "d.csv", "\nname,amount,note,\n , ,,\nx,5,,\n\ny,6,,\n")
    df = cleaning.clean_table(spark, path)
    assert df.dtypes == [("name", "string"), ("amount", "bigint"), ("note", "string")]
    assert sorted(tuple(r) for r in df.collect()) == [("x", 5, None), ("y", 6, None)]


def test_no_data(spark, tmp_path):
    assert cleaning.clean_table(spark, write(tmp_path, "one.csv", "a,b\n")).columns == []
    assert cleaning.clean_table(spark, write(tmp_path, "none.csv", "")).columns == []


def test_encodings(spark, tmp_path):
    rows = "tên;giá\ncà phê;5\nbánh mì €;6\n"
    expected = {("cà phê", 5), ("bánh mì €", 6)}
    for name, encoding in (("u8.csv", "utf-8"), ("bom.csv", "utf-8-sig"), ("u16.csv", "utf-16")):
        df = cleaning.clean_table(spark, write(tmp_path, name, rows, encoding))
        assert df.columns == ["tên", "giá"] and {tuple(r) for r in df.collect()} == expected, name
    df = cleaning.clean_table(spark, write(tmp_path, "w.csv", "nom|prix\ncafé “x”|5\nthé €|6\n", "cp1252"))
    assert {tuple(r) for r in df.collect()} == {("café “x”", 5), ("thé €", 6)}


def test_quoted_cells_over_lines(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'k,v,w\n"a\nb, c",5,"say ""hi"""\n"d",6,x\n')
    df = cleaning.clean_table(spark, path)
    assert {tuple(r) for r in df.collect()} == {("a\nb, c", 5, 'say "hi"'), ("d", 6, "x")}


def test_title_does_not_cut_the_width(spark, tmp_path):
    path = write(tmp_path, "t.csv", "Report\na,b,c\nx,1,2\ny,3,4,extra\n")
    df = cleaning.clean_table(spark, path)
    assert df.columns == ["a", "b", "c", "col_3"] and df.count() == 2


def test_corpus(spark, tmp_path):
    write(tmp_path, "a.csv", GRID_A)
    write(tmp_path, "Đơn hàng-2024.csv", "k\tv\nx\t5\ny\t6\n")
    write(tmp_path, "plus+and space.csv", "k,v\nx,5\ny,6\n")
    write(tmp_path, "none.csv", "")
    write(tmp_path, "lone.csv", "just one line\n")
    out = str(tmp_path / "out")
    status = {r.table_name: r for r in cleaning.clean_corpus(spark, str(tmp_path / "*.csv"), out).collect()}
    assert {n: r.status for n, r in status.items()} == {
        "a": "published", "don hang_2024": "published", "plus+and space": "published", "none": "failed", "lone": "failed"}
    assert "no data after cleaning" in status["lone"].error
    assert spark.read.parquet(f"{out}/don hang_2024").count() == 2
    again = cleaning.clean_corpus(spark, str(tmp_path / "*.csv"), out)
    assert again.where("status = 'skipped'").count() == 3
    # Rows keep their order in the published files.
    assert [r[0] for r in spark.read.parquet(f"{out}/a").collect()] == ["001", "002", "003", "004", "005", "006"]


def test_tables_take_the_way_they_need(spark, tmp_path):
    """Ditto marks, decomposed letters, both, neither: each table as if it were alone, read once in its own folder."""
    decomposed = "te\u0302n"
    write(tmp_path, "plain.csv", "k;v\nx;5\ny;6\nz;7\n")
    write(tmp_path, "marked.csv", "k;v\nx;5\nnt;6\nz;7\n")
    write(tmp_path, "composed.csv", f"k;v\n{decomposed};5\ny;6\nz;7\n")
    write(tmp_path, "both.csv", f"k;v\n{decomposed};5\nnt;6\nz;7\n")
    grid = cleaning.stage_grid(cleaning.read_grid(spark, str(tmp_path / "*.csv")))
    shapes = cleaning.table_shapes(grid.drop("table_key"))
    rows = cleaning.cleaned_rows(grid, shapes)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("table_key#") >= 4
    status = cleaning.clean_corpus(spark, str(tmp_path / "*.csv"), str(tmp_path / "out")).collect()
    assert {r.status for r in status} == {"published"}
    first = {r.table_name: [x[0] for x in spark.read.parquet(str(tmp_path / "out" / r.table_name)).collect()] for r in status}
    assert first == {"plain": ["x", "y", "z"], "marked": ["x", "x", "z"], "composed": ["t\u00ean", "y", "z"], "both": ["t\u00ean", "t\u00ean", "z"]}


def test_wide_files_cost_narrow_ones_nothing(spark, tmp_path):
    """Files of 2, 40 and 2,000 columns, one of them wide by a record that spans lines only: a grid for each class."""
    many = ";".join(f"c{i}" for i in range(2000))
    write(tmp_path, "wide.csv", many + "\n" + ";".join(["7"] * 2000) + "\n")
    write(tmp_path, "narrow.csv", "k;v\nx;5\ny;6\n")
    write(tmp_path, "middle.csv", ";".join("abcd" * 10) + "\n" + ";".join(["3"] * 40) + "\n")
    cells = ";".join(f'"{i}\n{i}"' for i in range(30))
    write(tmp_path, "lines.csv", "k;v\n" + cells + "\n")
    write(tmp_path, "plain_lines.csv", 'k;v\n"a\nb";5\n')
    write(tmp_path, "words.csv", "k;v\n" + cells + "\n", "utf-16")
    sniffed = files.sniff_files(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.width for r in sniffed}["lines.csv"] < 30
    found = [({i.rsplit("/", 1)[1] for i in ids}, len(G.cell_columns(grid)), grid) for ids, grid in files.read_grids(spark, sniffed)]
    assert [(names, width) for names, width, _ in found] == [
        ({"narrow.csv", "plain_lines.csv"}, 2), ({"middle.csv", "lines.csv", "words.csv"}, 40), ({"wide.csv"}, 2000)]
    whole = files.read_grid(spark, str(tmp_path), sniffed)
    for _, width, grid in found:
        columns = ["table_id", "block", *[f"c{i}" for i in range(width)]]
        mine = grid.select("table_id").distinct()
        assert sorted(map(tuple, grid.select(columns).collect()), key=str) == sorted(
            map(tuple, whole.join(mine, "table_id").select(columns).collect()), key=str)
    assert files.read_grids(spark, []) == []


def test_a_class_that_fails_is_its_files_status(spark, tmp_path, monkeypatch):
    write(tmp_path, "narrow.csv", "k;v\nx;5\ny;6\n")
    write(tmp_path, "wide.csv", ";".join(f"c{i}" for i in range(40)) + "\n" + ";".join(["7"] * 40) + "\n" + ";".join(["8"] * 40) + "\n")
    shapes = cleaning.table_shapes

    def failing(grid, *rest):
        if len(G.cell_columns(grid)) == 40:
            raise OSError("disk gone")
        return shapes(grid, *rest)

    monkeypatch.setattr(cleaning, "table_shapes", failing)
    status = cleaning.clean_corpus(spark, str(tmp_path / "*.csv"), str(tmp_path / "out")).collect()
    assert {(r.table_name, r.status, r.error) for r in status} == {("narrow", "published", None), ("wide", "failed", "disk gone")}
    monkeypatch.undo()
    status = cleaning.clean_corpus(spark, str(tmp_path / "*.csv"), str(tmp_path / "out")).collect()
    assert {(r.table_name, r.status, r.n_columns) for r in status} == {("narrow", "skipped", 2), ("wide", "published", 40)}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "wide")).collect()] == [(7,) * 40, (8,) * 40]


def test_unique_names(spark):
    for given, expected in ((["a", "a", "b", "a"], ["a", "a_2", "b", "a_3"]), (["a", "a", "a_2"], None)):
        df = spark.createDataFrame([("t", i, n) for i, n in enumerate(given)], "table_id string, idx int, name string")
        got = [r.name for r in G.unique_names(df).orderBy("idx").collect()]
        assert len(set(got)) == len(given) and (expected is None or got == expected)


def header_by_rules(types):
    """The header rules, row by row, on the row types of one table."""
    i, headers = 0, []
    while i < len(types) and types[i] in "ET":
        i += 1
    while i < len(types) and types[i] in "HA" and len(headers) < 6:
        if types[i] == "H" or headers:
            headers.append(i)
        i += 1
    if len(headers) >= 6:
        headers, i = headers[:1], headers[0] + 1
    while i < len(types) and types[i] == "E":
        i += 1
    if headers and i < len(types):
        return headers, i, "auto"
    if "D" in types and types.index("D") > 0:
        above = types.index("D") - 1
        while above > 0 and types[above] == "E":
            above -= 1
        if types[above] != "E":
            return [above], types.index("D"), "fallback"
    return ([0], 1, "fallback") if len(types) > 1 else ([], 0, "fallback")


def test_header_rules_on_random_tables(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice(rng.choice(["ETHDA", "HD", "TH", "HA", "ED"])) for _ in range(rng.randint(1, 30)))
             for _ in range(1500)]
    full = {"E": "empty", "T": "title", "H": "header_candidate", "D": "data", "A": "ambiguous"}
    rows = [(str(t), i, full[x]) for t, w in enumerate(words) for i, x in enumerate(w)]
    df = spark.createDataFrame(rows, "table_id string, row_no int, row_type string")
    got = {r.table_id: (r.header_idx, r.data_start, r.method) for r in G.detect_header(df).collect()}
    for t, w in enumerate(words):
        assert got[str(t)] == header_by_rules(w), w


def test_ditto_in_order(spark):
    rows = [("t", 0, i, v) for i, v in enumerate(["nt", "a", '"', None, "'"])]
    df = spark.createDataFrame(rows, "table_id string, block int, seq int, c0 string")
    assert [r.c0 for r in G.fill_ditto(df, ["c0"]).orderBy("seq").collect()] == ["nt", "a", "a", None, "a"]


def test_ditto_across_blocks_and_tables(spark):
    """Many blocks, long runs of marks over whole blocks, one table with a third of all rows and more."""
    rng = random.Random(5)
    rows, expected = [], {}
    for t, n in (("hot", 3000), ("b", 400), ("c", 7)):
        last = {0: None, 1: None}
        for i in range(n):
            cells = [rng.choice(["nt", '"', "nt", None, f"v{i}"]) if (i // 90) % 3 else rng.choice(["nt", None, "như trên"])
                     for _ in range(2)]
            rows.append((t, i // 25, i, *cells))
            for c, v in enumerate(cells):
                mark = v in ("nt", '"', "như trên")
                expected[t, i, c] = (last[c] if last[c] is not None else v) if mark else v
                if v is not None and not mark:
                    last[c] = v
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "table_id string, block int, seq int, c0 string, c1 string")
    for r in G.fill_ditto(df, ["c0", "c1"]).collect():
        assert (r.c0, r.c1) == (expected[r.table_id, r.seq, 0], expected[r.table_id, r.seq, 1])


def test_ditto_within_long_blocks(spark, monkeypatch):
    """A block of many short rows is no single window: marks are carried from piece to piece."""
    monkeypatch.setattr(G, "PIECE_ROWS", 10)
    rows = [("t", 0, i, "nt" if i % 25 else f"v{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "table_id string, block int, seq int, c0 string")
    filled = G.fill_ditto(df, ["c0"])
    assert [r.c0 for r in filled.orderBy("seq").collect()] == [f"v{i - i % 25}" for i in range(100)]
    assert filled.columns == df.columns


def test_row_types(spark):
    rows = [
        (["x", None, None], "title"), (["x", "x", "x"], "title"), (["x", "y", None], "title"), (["x", "y", "x"], "header_candidate"),
        (["x", "y", "z"], "header_candidate"), (["x", "5", "z"], "data"), (["5%", "a", "b"], "data"), (["$5", "a", "b"], "data"),
        ([None, None, None], "empty"), (["1a", "b", "c"], "header_candidate"), (["10,5", None, None], "data")]
    df = spark.createDataFrame([("t", 0, i, *c) for i, (c, _) in enumerate(rows)],
                               "table_id string, block int, seq int, c0 string, c1 string, c2 string")
    assert [r.row_type for r in G.classify_rows(df).orderBy("seq").collect()] == [k for _, k in rows]
    strict = [r.row_type for r in G.classify_rows(df, strict=True).orderBy("seq").collect()]
    assert "data" not in strict and strict[5] == "header_candidate"


def test_file_split_over_many_tasks(spark, tmp_path):
    """Row order survives a file that many tasks read, with dittos across the splits."""
    n = 5000
    lines = ["code,name,value"] + [f"k{i:05d},{'nt' if i % 50 else f'name {i}'},{i}.5" for i in range(n)]
    path = write(tmp_path, "big.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = cleaning.clean_table(spark, path, keep_order=True).orderBy("block", "seq")
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.block for r in rows}) > 5
    assert [r.code for r in rows] == [f"k{i:05d}" for i in range(n)]
    assert [r.name for r in rows] == [f"name {i - i % 50}" for i in range(n)]
    assert df.schema["value"].dataType.simpleString() == "double" and rows[7].value == 7.5
    assert rows[0].block == 0 and F is not None


def test_data_rows_stay_where_they_are(spark, tmp_path):
    """First rows are broadcast to the grid, not the grid to them, and no task gathers or sorts a table."""
    write(tmp_path, "one.csv", "k;v\n" + "".join(f"x{i};{i + 5}\n" for i in range(500)))
    facts = files.line_facts(spark, str(tmp_path))
    assert "SortAggregate" not in facts._jdf.queryExecution().executedPlan().toString()
    (ids, grid), = files.read_grids(spark, files.sniff_files(spark, str(tmp_path)).collect())
    alone, parted = cleaning.stage_grid(grid, ids), cleaning.stage_grid(grid)
    assert alone.schema == parted.schema and sorted(alone.collect()) == sorted(parted.collect())
    assert alone.where(F.col("table_key") == cleaning.folder_key(ids[0])).count() == 501
    rows = cleaning.cleaned_rows(alone, cleaning.table_shapes(alone.drop("table_key")))
    join = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert len(join) == 1 and "BroadcastHashJoin" in join[0] and "BuildRight" in join[0]
    assert sorted(r.c0 for r in rows.collect()) == sorted(f"x{i}" for i in range(500))


@pytest.mark.parametrize("encoding, marked", [("utf-16", True), ("utf-8", False), ("utf-8-sig", False)])
def test_mark_of_the_first_line_only(spark, tmp_path, encoding, marked):
    write(tmp_path, "one.csv", "k;v\nx;5\n", encoding)
    (tmp_path / "two.csv").write_bytes(b"k;v\n\xff\xfex;5\n")
    found = {r.file_id.rsplit("/", 1)[1]: r.marked for r in files.line_facts(spark, str(tmp_path)).collect()}
    assert found == {"one.csv": marked, "two.csv": False}
