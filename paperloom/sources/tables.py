"""The driver's tables seen as the engine's inputs, with the same views in DuckDB.

* files: one source file a document, named in the ways that document codes come in
* known: registered versions (every fourth document), the rest arrives
* elements: lines of documents as typed, paged, boxed elements
* detections: boxes of recognised text on pages, from order lines
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: Written alike in both dialects.
FILES = """SELECT doc_id, source || '/' || name AS source_path, name AS source_name, text, lang FROM (SELECT *,
  CASE doc_id % 5 WHEN 0 THEN 'QT.TCKT.' || (doc_id % 90)::STRING || ' - Quy trình' WHEN 1 THEN 'Quyết định ID' || (doc_id % 300)::STRING
    WHEN 2 THEN (doc_id % 60)::STRING || ' HDQT Quy chế' WHEN 3 THEN 'QD ' || (doc_id % 500)::STRING ELSE 'Tài liệu Đặc biệt ' || lang || ' ' || (doc_id % 250)::STRING END ||
  CASE doc_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' WHEN 3 THEN '.png' WHEN 4 THEN '.jpg' WHEN 5 THEN '.PDF' WHEN 6 THEN '.txt' WHEN 7 THEN '.docx' ELSE '.pdf' END AS name
  FROM documents) d"""

ELEMENTS = """SELECT doc_id, pos, CAST(floor(pos / 5) AS INT) + 1 AS page,
  CASE WHEN pos = 0 THEN 'TITLE' WHEN pos % 9 = 4 THEN 'HEADING' WHEN pos % 7 = 3 THEN 'TABLE' WHEN pos % 6 = 5 THEN 'LIST' WHEN pos % 11 = 8 THEN 'IMAGE' ELSE 'PARAGRAPH' END AS type,
  1 + (pos * 2) % 5 AS level, content, CAST(doc_id % 50 AS INT) AS x0, (pos % 5) * 100 AS y0, CAST(doc_id % 50 AS INT) + least(length(content), 500) AS x1, (pos % 5) * 100 + 10 + length(content) % 60 AS y1
  FROM lines"""

DETECTIONS = """SELECT CAST(floor(l_orderkey / 16) AS INT) AS page, l_orderkey * 10 + l_linenumber AS det_id, l_returnflag || l_linestatus || l_partkey::STRING AS text, l_discount * 10 AS confidence,
  CAST(floor(l_quantity) AS INT) * 20 AS x0, CAST(floor(l_extendedprice) AS INT) % 1500 AS y0, CAST(floor(l_quantity) AS INT) * 20 + CAST(l_partkey % 90 AS INT) - 5 AS x1, CAST(floor(l_extendedprice) AS INT) % 1500 + 12 + l_linenumber AS y1
  FROM lineitem"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over frames named in braces, so that queries leave no views behind."""
    for name in frames:
        query = query.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(query.replace("::STRING", "::string"), **frames)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_path, source_name, text, lang"""
    return _sql(spark, FILES, documents=table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos (from 0), content: lines of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, ELEMENTS, lines=lines(spark, sf_dir))


#: Where a row is stored: what sets rows in order that are alike in all that a query orders by.
STORED = ("stored_file", "stored_row")


def detections(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """Boxes of recognised text, with STORED if asked."""
    rows = table(spark, sf_dir, "lineitem")
    if not stored:
        return _sql(spark, DETECTIONS, lineitem=rows)
    at = rows.select("*", *[F.col(f"_metadata.{c}").alias(n) for n, c in zip(STORED, ("file_path", "row_index"), strict=True)])
    return _sql(spark, DETECTIONS.replace("\n  FROM lineitem", f", {', '.join(STORED)}\n  FROM lineitem"), lineitem=at)


def named(frame: DataFrame) -> DataFrame:
    """Adds sha256, normalized_name, document_code and family_id to files."""
    folded = frame.withColumn("folded", T.ascii_fold(T.stem(F.col("source_name"))))
    code, name = T.document_code(F.col("folded")), T.normalized_name(F.col("folded"))
    out = folded.withColumns({"sha256": F.sha2("text", 256), "normalized_name": name, "document_code": code})
    return out.withColumn("family_id", T.family_id(F.col("document_code"), F.col("normalized_name"))).drop("folded")


#: DuckDB's common tables; ``{...}`` names what each needs.
LINES_SQL = "lines AS (SELECT doc_id, (k - 1)::INT AS pos, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents))"
ELEMENTS_SQL = f"{LINES_SQL}, elements AS ({ELEMENTS})"
FILES_SQL = f"files AS ({FILES})"
DETECTIONS_SQL = f"detections AS ({DETECTIONS})"
_CODES = "upper(folded)"
NAMED_SQL = f"""{FILES_SQL}, named0 AS (SELECT *, strip_accents(replace(replace(regexp_replace(source_name, '\\.[^.]+$', ''), 'Đ', 'D'), 'đ', 'd')) AS folded FROM files),
named1 AS (SELECT doc_id, source_path, source_name, text, lang, sha256(text) AS sha256, trim(regexp_replace(lower(folded), '[^a-z0-9]+', ' ', 'g')) AS normalized_name,
  CASE WHEN regexp_matches({_CODES}, '(^|[^A-Z0-9])QT[\\s._-]+[A-Z][A-Z0-9]{{1,15}}[\\s._-]+[0-9]{{1,4}}($|[^0-9])')
      THEN 'qt-' || lower(regexp_extract({_CODES}, 'QT[\\s._-]+([A-Z][A-Z0-9]{{1,15}})[\\s._-]+([0-9]{{1,4}})', 1)) || '-' || regexp_extract({_CODES}, 'QT[\\s._-]+([A-Z][A-Z0-9]{{1,15}})[\\s._-]+([0-9]{{1,4}})', 2)
    WHEN regexp_matches({_CODES}, 'ID[\\s._-]*[0-9]{{1,10}}($|[^0-9])') THEN 'id' || regexp_extract({_CODES}, 'ID[\\s._-]*([0-9]{{1,10}})', 1)
    WHEN regexp_matches({_CODES}, '(^|[^0-9])[0-9]{{1,6}}[\\s._-]*HDQT($|[^A-Z])') THEN regexp_extract({_CODES}, '([0-9]{{1,6}})[\\s._-]*HDQT', 1) || '-hdqt'
    WHEN regexp_matches({_CODES}, '(^|[^A-Z0-9])QD[\\s._-]*[0-9]{{1,30}}($|[^0-9])') THEN 'qd-' || regexp_extract({_CODES}, 'QD[\\s._-]*([0-9]{{1,30}})', 1) END AS document_code FROM named0),
named AS (SELECT *, coalesce(document_code, 'doc-' || regexp_replace(substr(replace(normalized_name, ' ', '-'), 1, 40), '^-+|-+$', '', 'g') || '-' || substr(sha256(normalized_name), 1, 8)) AS family_id FROM named1)"""
