"""Citations of chunks: each segment's chain from block to element and anchor, checked, and what the chunk says against it.

* segments: chunk_id, nth, block_id, element_id, span_id, anchor_id, type, start, end, raw_sha256
* blocks: block_id, doc_id, element_id, span_id, anchor_id, markdown, path
* elements: element_id, type, page, boxed, filtered
* chunks: chunk_id, doc_id, text, tokens, anchors, path, page_count

Keys of the joins are ids, which are spread evenly; a chunk's segments bound its group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids, text

#: Fixed value: tokens of an index record at most.
MOST_TOKENS = 2048


def resolved(segments: DataFrame, blocks: DataFrame, elements: DataFrame) -> DataFrame:
    """The segments with what their block (b) and element (e) say (null if absent), and ``raw``, the block's text at their range."""
    b = blocks.select("block_id", F.struct("element_id", "span_id", "anchor_id", "markdown", "path").alias("b"))
    e = elements.select("element_id", F.struct("type", "page", "boxed", "filtered").alias("e"))
    raw = F.substring("b.markdown", F.col("start") + 1, F.col("end") - F.col("start"))
    return segments.join(b, "block_id", "left").join(e, "element_id", "left").withColumn("raw", raw)


def segment_problems(chain: DataFrame) -> DataFrame:
    """chunk_id, problem of the links of ``resolved`` that don't hold; ``filtered_element_leaked`` must never occur."""
    c = F.col
    known = c("b").isNotNull()
    checks = {
        "block_absent": ~known,
        "element_absent": c("e").isNull(),
        "filtered_element_leaked": c("e.filtered"),
        "element_differs_from_block": known & (c("b.element_id") != c("element_id")),
        "span_differs_from_block": known & (c("b.span_id") != c("span_id")),
        "anchor_differs_from_block": known & (c("b.anchor_id") != c("anchor_id")),
        "type_differs_from_element": c("e.type") != c("type"),
        "range_exceeds_block": c("end") > F.length("b.markdown"),
        "range_hash_differs": F.sha2("raw", 256) != c("raw_sha256"),
        "range_is_empty": F.regexp_replace("raw", r"^\s+|\s+$", "") == "",
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in checks.items()]))
    return chain.select("chunk_id", F.explode(found).alias("problem")).distinct()


def cited(chain: DataFrame) -> DataFrame:
    """chunk_id, whole (all segments resolve), text, anchors (each once, in order), paths, pages, boxed, hashes: what a chunk's segments amount to."""
    own = F.struct("nth", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("t"), F.col("b.anchor_id").alias("anchor"), "raw_sha256")
    per = chain.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(own)).alias("s"), F.bool_and(F.col("b").isNotNull() & F.col("e").isNotNull()).alias("whole"), F.collect_set("b.path").alias("paths"),
        F.array_sort(F.collect_set("e.page")).alias("pages"), F.bool_and(F.coalesce("e.boxed", F.lit(False))).alias("boxed"),
    )
    part = lambda f: F.transform("s", lambda x: x[f])
    return per.select("chunk_id", "whole", F.array_join(part("t"), "\n\n").alias("cited_text"), F.array_distinct(F.array_compact(part("anchor"))).alias("cited_anchors"), "paths", "pages", "boxed", part("raw_sha256").alias("hashes"))


def chunk_problems(chunks: DataFrame, sums: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """chunk_id, problem of chunks against ``cited``; the text, anchors and path of a chunk with an unresolved segment are not judged."""
    c, whole = F.col, F.coalesce("whole", F.lit(False))
    pages = F.coalesce("pages", F.array().cast("array<int>"))
    checks = {
        "no_segments": c("cited_text").isNull(),
        "text_differs_from_ranges": whole & (c("cited_text") != c("text")),
        "anchors_differ_from_ranges": whole & (c("cited_anchors") != c("anchors")),
        "path_differs_from_block": whole & F.exists("paths", lambda p: p != c("path")),
        "token_count_wrong": text.token_count(c("text")) != c("tokens"),
        "too_many_tokens": c("tokens") > most,
        "no_page": F.size(pages) == 0,
        "no_box": ~F.coalesce("boxed", F.lit(False)),
        "page_out_of_document": (F.array_min(pages) < 1) | (F.array_max(pages) > c("page_count")),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in checks.items()]))
    return chunks.join(sums, "chunk_id", "left").select("chunk_id", F.explode(found).alias("problem"))


def uncited_blocks(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """block_id, doc_id of blocks that no segment cites."""
    return blocks.join(segments, "block_id", "left_anti").select("block_id", "doc_id")


def records(chunks: DataFrame, sums: DataFrame) -> DataFrame:
    """chunk_id, doc_id, citation_id, index_record_id, content_sha256, locator: a citation and an index record a chunk."""
    j = chunks.join(sums, "chunk_id")
    instance = F.concat("version_id", F.lit("::"), "chunk_id")
    citation = ids.digest_id("citation", instance, F.array_join("cited_anchors", ","), F.array_join("hashes", ","))
    out = j.withColumns({"citation_id": citation, "content_sha256": F.sha2("text", 256)})
    record = ids.digest_id("index-record", instance, F.col("content_sha256"), F.col("citation_id"))
    return out.select("chunk_id", "doc_id", "citation_id", record.alias("index_record_id"), "content_sha256", text.page_locator(F.col("pages").cast("array<string>")).alias("locator"), "tokens", "pages", "cited_anchors")


def report(found: DataFrame) -> DataFrame:
    """doc_id, records, tokens, fewest, most_tokens, anchors, pages, repeated_groups and repeated_records (records whose content another one of the document has)."""
    same = found.groupBy("doc_id", "content_sha256").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("repeated_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_records"))
    anchors = found.select("doc_id", F.explode("cited_anchors").alias("a")).groupBy("doc_id").agg(F.count_distinct("a").alias("anchors"))
    pages = found.select("doc_id", F.explode("pages").alias("p")).groupBy("doc_id").agg(F.count_distinct("p").alias("pages"))
    per = found.groupBy("doc_id").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("fewest"), F.max("tokens").alias("most_tokens"))
    return per.join(same, "doc_id").join(anchors, "doc_id", "left").join(pages, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("anchors", "pages")})
