"""Chunks of three elements each over the driver's documents, their citations, and faults strewn in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import citing
from paperloom.plans.elements_plans import _TOKEN_SQL
from paperloom.plans.registry import query
from paperloom.sources.tables import ELEMENTS_SQL, elements


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = F.col("doc_id"), F.col("pos")
    name = lambda of: F.concat(F.lit(of), d, F.lit("-"), p)
    own = elements(spark, sf_dir).where(F.trim("content") != "")
    return own.withColumns({"chunk_id": F.concat(F.lit("c"), d, F.lit("-"), F.floor(p / 3)), **{n: name(n[0]) for n in ("block_id", "element_id", "span_id", "anchor_id")}})


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(segments, blocks, elements, chunks)"""
    base, d, p, size = _base(spark, sf_dir), F.col("doc_id"), F.col("pos"), F.length("content")
    wrong = lambda test, value, c: F.when(test, value).otherwise(c)
    segments = base.select(
        "chunk_id", p.alias("nth"), wrong(p % 41 == 7, "none", F.col("block_id")).alias("block_id"), wrong(p % 43 == 5, "none", F.col("element_id")).alias("element_id"), wrong(p % 47 == 11, "x", F.col("span_id")).alias("span_id"),
        wrong(p % 53 == 13, "x", F.col("anchor_id")).alias("anchor_id"), wrong(p % 59 == 17, "UNKNOWN", F.col("type")).alias("type"), F.lit(0).alias("start"), wrong(p % 61 == 19, size + 5, size).alias("end"), wrong(p % 67 == 23, "x", F.sha2("content", 256)).alias("raw_sha256"),
    )
    blocks = base.select("block_id", "doc_id", "element_id", "span_id", "anchor_id", F.col("content").alias("markdown"), wrong(p % 71 == 29, "q", F.lit("p")).alias("path"))
    found = base.select("element_id", "type", F.when(p % 37 != 3, F.col("page")).alias("page"), (p % 31 != 2).alias("boxed"), (p % 73 == 31).alias("filtered"))
    every = F.array_sort(F.collect_list(F.struct("pos", F.trim("content").alias("t"), "anchor_id")))
    per = base.groupBy("chunk_id", "doc_id").agg(every.alias("e"))
    pages = elements(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("last"))
    joined, anchors = F.array_join(F.transform("e", lambda x: x["t"]), "\n\n"), F.transform("e", lambda x: x["anchor_id"])
    chunks = per.join(pages, "doc_id").withColumn("text", wrong(d % 23 == 4, F.concat(joined, F.lit("!")), joined))
    tokens = text.token_count(F.col("text")) + wrong(d % 29 == 3, 1, F.lit(0))
    return segments, blocks, found, chunks.select("chunk_id", "doc_id", F.concat(F.lit("f"), d, F.lit("-v001")).alias("version_id"), "text", tokens.alias("tokens"), wrong(d % 31 == 8, F.reverse(anchors), anchors).alias("anchors"), F.lit("p").alias("path"), (F.col("last") - (d % 19 == 6).cast("int")).alias("page_count"))


_CITED = f"""{ELEMENTS_SQL}, base AS (SELECT *, 'c' || doc_id::VARCHAR || '-' || (pos // 3)::VARCHAR AS chunk_id, doc_id::VARCHAR || '-' || pos::VARCHAR AS name FROM elements WHERE trim(content) <> ''),
last AS (SELECT doc_id, max(page) AS last FROM elements GROUP BY doc_id),
chunked AS (SELECT chunk_id, doc_id, string_agg(trim(content), chr(10) || chr(10) ORDER BY pos) AS joined, list('a' || name ORDER BY pos) AS anchors, bool_and(pos % 41 <> 7 AND pos % 43 <> 5) AS whole, bool_or(pos % 71 = 29) AS turned,
  list_sort(list_distinct(list(CASE WHEN pos % 37 <> 3 AND pos % 43 <> 5 THEN page END))) AS pages, bool_and(pos % 31 <> 2 AND pos % 43 <> 5) AS boxed, string_agg(CASE WHEN pos % 67 = 23 THEN 'x' ELSE sha256(content) END, ',' ORDER BY pos) AS hashes,
  string_agg('a' || name, ',' ORDER BY pos) FILTER (WHERE pos % 41 <> 7) AS cited, count(*) FILTER (WHERE pos % 41 <> 7) AS n_cited FROM base GROUP BY chunk_id, doc_id),
chunks AS (SELECT *, CASE WHEN doc_id % 23 = 4 THEN joined || '!' ELSE joined END AS text FROM chunked JOIN last USING (doc_id)), counted AS (SELECT *, len(regexp_extract_all(text, '{_TOKEN_SQL}')) + (doc_id % 29 = 3)::INT AS tokens FROM chunks)"""


@query(
    f"""WITH {_CITED}, s AS (SELECT DISTINCT chunk_id, unnest(list_filter([CASE WHEN pos % 41 = 7 THEN 'block_absent' END, CASE WHEN pos % 43 = 5 THEN 'element_absent' END, CASE WHEN pos % 43 <> 5 AND pos % 73 = 31 THEN 'filtered_element_leaked' END, CASE WHEN pos % 41 <> 7 AND pos % 43 = 5 THEN 'element_differs_from_block' END,
      CASE WHEN pos % 41 <> 7 AND pos % 47 = 11 THEN 'span_differs_from_block' END, CASE WHEN pos % 41 <> 7 AND pos % 53 = 13 THEN 'anchor_differs_from_block' END, CASE WHEN pos % 43 <> 5 AND pos % 59 = 17 THEN 'type_differs_from_element' END, CASE WHEN pos % 41 <> 7 AND pos % 61 = 19 THEN 'range_exceeds_block' END, CASE WHEN pos % 41 <> 7 AND pos % 67 = 23 THEN 'range_hash_differs' END], lambda x: x IS NOT NULL)) AS problem FROM base),
    c AS (SELECT chunk_id, unnest(list_filter([CASE WHEN whole AND doc_id % 23 = 4 THEN 'text_differs_from_ranges' END, CASE WHEN whole AND doc_id % 31 = 8 AND len(anchors) > 1 THEN 'anchors_differ_from_ranges' END, CASE WHEN whole AND turned THEN 'path_differs_from_block' END, CASE WHEN doc_id % 29 = 3 THEN 'token_count_wrong' END, CASE WHEN tokens > 2048 THEN 'too_many_tokens' END,
      CASE WHEN len(list_filter(pages, lambda p: p IS NOT NULL)) = 0 THEN 'no_page' END, CASE WHEN NOT boxed THEN 'no_box' END, CASE WHEN list_max(pages) > last - (doc_id % 19 = 6)::INT THEN 'page_out_of_document' END], lambda x: x IS NOT NULL)) AS problem FROM counted)
    SELECT * FROM s UNION ALL SELECT * FROM c"""
)
def citation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, blocks, found, chunks = _parts(spark, sf_dir)
    chain = citing.resolved(segments, blocks, found)
    return citing.segment_problems(chain).unionByName(citing.chunk_problems(chunks, citing.cited(chain)))


@query(f"WITH {ELEMENTS_SQL} SELECT 'b' || doc_id::VARCHAR || '-' || pos::VARCHAR AS block_id, doc_id FROM elements WHERE trim(content) <> '' AND pos % 41 = 7")
def uncited_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, blocks, _, _ = _parts(spark, sf_dir)
    return citing.uncited_blocks(blocks, segments)


_RECORDS = f"""{_CITED}, ids AS (SELECT *, 'citation-' || substr(sha256('f' || doc_id::VARCHAR || '-v001::' || chunk_id || '|' || coalesce(cited, '') || '|' || hashes), 1, 24) AS citation_id, sha256(text) AS content_sha256, list_filter(pages, lambda p: p IS NOT NULL) AS ps FROM counted),
records AS (SELECT *, 'index-record-' || substr(sha256('f' || doc_id::VARCHAR || '-v001::' || chunk_id || '|' || content_sha256 || '|' || citation_id), 1, 24) AS index_record_id, CASE len(ps) WHEN 1 THEN 'p. ' ELSE 'pp. ' END || array_to_string(ps, ', ') AS locator FROM ids)"""


@query(f"WITH {_RECORDS} SELECT chunk_id, doc_id, citation_id, index_record_id, content_sha256, locator, tokens FROM records")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, blocks, found, chunks = _parts(spark, sf_dir)
    return citing.records(chunks, citing.cited(citing.resolved(segments, blocks, found))).drop("pages", "cited_anchors")


@query(
    f"""WITH {_RECORDS}, g AS (SELECT doc_id, content_sha256, count(*) AS n FROM records GROUP BY ALL), h AS (SELECT doc_id, count(*) FILTER (WHERE n > 1) AS repeated_groups, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS repeated_records FROM g GROUP BY doc_id)
    SELECT doc_id, count(*) AS records, sum(tokens)::BIGINT AS tokens, min(tokens) AS fewest, max(tokens) AS most_tokens, repeated_groups, repeated_records, sum(n_cited)::BIGINT AS anchors, len(list_distinct(flatten(list(ps)))) AS pages FROM records JOIN h USING (doc_id) GROUP BY doc_id, repeated_groups, repeated_records"""
)
def citation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, blocks, found, chunks = _parts(spark, sf_dir)
    return citing.report(citing.records(chunks, citing.cited(citing.resolved(segments, blocks, found))))
