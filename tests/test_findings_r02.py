"""What the findings of round 2 named, on small tables that show it."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks
from paperloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


def same(spark, name, folder, *tables):
    """Asserts that a query equals its SQL over the folder's tables; the rows."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, str(folder)), con.sql(registry.ORACLE_SQL[name])
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    at = [want.columns.index(c) for c in sorted(got.columns)]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    return rows


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Documents that come again under the same name, source and content."""
    folder = tmp_path_factory.mktemp("copied")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Names follow from ids modulo 9,000 and less; 9,000 * 7 * 6 keeps every modulus of the queries, 9,000 moves some.
    again = [docs.withColumn("doc_id", F.col("doc_id") + n) for n in (0, 9000, 9000 * 7, 9000 * 7 * 6)]
    out = again[0]
    for a in again[1:]:
        out = out.unionByName(a)
    out.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_f12_version_assignments_of_copies(spark, copied):
    rows = same(spark, "version_assignments", copied, "documents")
    assert len(rows) > len(set(rows))  # two of four copies reuse one version by one decision


def test_f11_route_assignments_of_copies(spark, copied):
    same(spark, "route_assignments", copied, "documents")


def test_f8_assignment_counts_of_copies(spark, copied):
    same(spark, "assignment_counts", copied, "documents")


def test_f7_route_counts_of_copies(spark, copied):
    same(spark, "route_counts", copied, "documents")


def test_f3_decision_violations_of_copies(spark, copied):
    same(spark, "decision_violations", copied, "documents")


def test_f6_review_violations_of_copies(spark, copied):
    same(spark, "review_violations", copied, "documents")


def test_f10_reviewed_decisions_of_copies(spark, copied):
    same(spark, "reviewed_decisions", copied, "documents")


def test_f1_names_of_large_groups(spark):
    """Thousands of files of one name: time in proportion to them, where each went through all names before."""
    n = 20000
    kind = F.col("id") % 4
    name = F.when(kind == 0, F.concat(F.lit("a-"), (F.col("id") % 4000).cast("string"), F.lit(".pdf"))).otherwise(F.lit("a.pdf"))
    rows = spark.range(n).select(F.format_string("%07d", "id").alias("path"), name.alias("name"), F.col("id").cast("string").alias("sha256"))
    start = time.monotonic()
    got = [r["copy_name"] for r in checks.free_names(rows).orderBy("path").collect()]
    assert time.monotonic() - start < 60
    taken, want, reached = set(), [], {}
    for k in range(n):
        stem = f"a-{k % 4000}" if k % 4 == 0 else "a"
        free = f"{stem}.pdf"
        while free in taken:
            reached[stem] = reached.get(stem, 0) + 1
            free = f"{stem}-{reached[stem]}.pdf"
        taken.add(free)
        want.append(free)
    assert got == want


#: Parts of the tied lines in the order in which they are stored; boxes are as wide as these modulo 90, less 5.
TIED = [50, 40, 80, 20, 70, 30, 60, 10, *[k for k in range(1000, 1200) if k % 90 > 5]]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Order lines of one page that share key, number and place, stored in no order of their texts; Spark reads the larger second file first."""
    folder = tmp_path_factory.mktemp("tied")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(1)
    con = duckdb.connect()
    row = lines.withColumns({"l_orderkey": F.lit(3).cast("long"), "l_linenumber": F.lit(1).cast(lines.schema["l_linenumber"].dataType), "l_quantity": F.lit(10).cast(lines.schema["l_quantity"].dataType), "l_extendedprice": F.lit(30).cast(lines.schema["l_extendedprice"].dataType), "l_discount": F.lit(0.1).cast(lines.schema["l_discount"].dataType)})
    con.register("row", row.toArrow())
    (folder / "lineitem.parquet").mkdir()
    for part, keys in (("a", "[50, 40, 80]"), ("b", "[20, 70, 30, 60, 10] || range(1000, 1200)")):
        con.sql(f"COPY (SELECT r.* REPLACE (k::BIGINT AS l_partkey) FROM row r, (SELECT unnest({keys}) AS k)) TO '{folder}/lineitem.parquet/{part}.parquet' (FORMAT parquet)")
    return folder


def test_f2_ties_come_as_stored(spark, tied):
    got = registry.QUERIES["clean_detections"](spark, str(tied)).orderBy("nth").collect()
    assert [int(r["text"][2:]) for r in got] == TIED
    assert [r["nth"] for r in got] == list(range(1, len(TIED) + 1))


def test_f4_cells_hold_ties_as_stored(spark, tied, tmp_path):
    # Two boxes of one id and place, in two columns by their widths: the query puts both texts in either cell.
    (tmp_path / "lineitem.parquet").mkdir()
    two = f"SELECT * REPLACE (9 AS l_quantity) FROM read_parquet('{tied}/lineitem.parquet/a.parquet') WHERE l_partkey IN (50, 40)"
    duckdb.connect().sql(f"COPY ({two}) TO '{tmp_path}/lineitem.parquet/a.parquet' (FORMAT parquet)")
    rows = same(spark, "grid_markdown", tmp_path, "lineitem")
    cells = rows[0][1].split("\n")[0].split("|")[2:4]
    assert [[int(t.strip()[2:]) for t in c.split("<br>")] for c in cells] == [[50, 40], [50, 40]]
