"""Chunks of retrieval size, their citations and checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.functions import ids, text

TARGET, MOST, STRUCTURAL = 350, 512, 2048
STRUCTURES = ("TABLE", "LIST", "FLOWCHART")
_TOKEN = re.compile(r"\w+(?:['’]\w+)*|[^\w\s]")


def split_ranges(t: str, most: int = MOST) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of contiguous parts of at most ``most`` tokens that cover the text.

    A part ends after the last token in the final 40 % of the room that is a sentence mark or the last of its line, else at the room's end."""
    spans, out, first, start = [m.span() for m in _TOKEN.finditer(t)], [], 0, 0
    while len(spans) - first > most:
        def stops(k: int) -> bool:
            a, b = spans[k - 1]
            return t[a:b] in ".!?;:" or "\n" in t[b : spans[k][0]]

        end = next((k for k in range(first + most, first + max(1, int(most * 0.6)) - 1, -1) if stops(k)), first + most)
        out.append((start, spans[end - 1][1], end - first))
        first, start = end, spans[end - 1][1]
    out.append((start, len(t), len(spans) - first))
    return out


def segments(elements: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, pos, part, type, path, start, end, tokens, content: structural elements whole, other text in ranges."""

    @F.pandas_udf("array<struct<start:int,end:int,tokens:int>>")
    def ranges(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: [{"start": a, "end": b, "tokens": n} for a, b, n in split_ranges(c or "", most)])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("content").alias("end"), text.token_count(F.col("content")).alias("tokens")))
    # Only text that is too long leaves the JVM.
    few = (text.token_count(F.col("content")) <= most) | F.col("type").isin(*STRUCTURES)
    short, long = elements.where(few).withColumn("r", whole), elements.where(~few).withColumn("r", ranges("content"))
    cut = short.unionByName(long).select("doc_id", "pos", "type", "path", "content", F.posexplode("r").alias("part", "r"))
    return cut.select("doc_id", "pos", "part", "type", "path", "r.start", "r.end", "r.tokens", F.substring("content", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("content"))


def group(parts: DataFrame, target: int = TARGET) -> DataFrame:
    """Adds ``chunk`` (from 1): a structural part is alone; a heading or another path begins a chunk, as does what would pass the target; a part above the target is alone as well.

    An ordered fold over a document's parts inside the JVM, which carries the rows along and looks at sizes and paths only."""
    row = F.struct("pos", "part", F.struct(*[c for c in parts.columns if c not in ("doc_id", "pos", "part")]).alias("rest"))
    docs = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("int").alias("size"), F.lit(True).alias("closed"), F.lit("").alias("path"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        r = x["rest"]
        path, alone = F.array_join(r["path"], "\u001f"), r["type"].isin(*STRUCTURES)
        new = s["closed"] | alone | r["type"].isin("HEADING", "TITLE") | (s["path"] != path) | (s["size"] + r["tokens"] > target)
        size = F.when(new, r["tokens"]).otherwise(s["size"] + r["tokens"])
        chunk = s["chunk"] + new.cast("int")
        return F.struct(chunk.alias("chunk"), size.alias("size"), (alone | (r["tokens"] > target)).alias("closed"), path.alias("path"), F.array_append(s["out"], chunk).alias("out"))

    numbered = docs.select("doc_id", "rows", F.aggregate("rows", start, step, lambda s: s["out"]).alias("chunks"))
    return numbered.select("doc_id", F.explode(F.arrays_zip("rows", "chunks")).alias("x")).select("doc_id", "x.rows.pos", "x.rows.part", "x.rows.rest.*", F.col("x.chunks").alias("chunk"))


def segment_ids(grouped: DataFrame) -> DataFrame:
    """Adds the ids that a part's chain goes by: block_id, element_id, span_id, anchor_id; ``grouped`` has source_sha256."""
    name = lambda of, *more: ids.digest_id(of, F.col("source_sha256"), F.col("pos"), *more)
    return grouped.withColumns({"block_id": name("block"), "element_id": name("element", F.col("type")), "span_id": name("span", F.col("type")), "anchor_id": name("anchor", F.col("type"))})


def canonical(value: Column) -> Column:
    """JSON of a struct with its fields in the order of their names, nulls written, control characters in small hexadecimal digits."""
    text_ = F.to_json(value, {"ignoreNullFields": "false"})
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        text_ = F.regexp_replace(text_, rf"(?<!\\)((?:\\\\)*)\\u00{code:02X}", rf"$1\\u00{code:02x}")
    return text_


def chunks(grouped: DataFrame) -> DataFrame:
    """doc_id, chunk, parts, tokens, first_pos, last_pos, text, content_hash, chunk_id: the id is the family's and a digest of the canonical JSON of source, path, text and segments.

    ``grouped`` has family_id, source_sha256 and the ids of ``segment_ids``."""
    segment = {"block_id": F.col("block_id"), "char_end": F.col("end"), "char_start": F.col("start"), "element_type": F.col("type"), "normalized_span_id": F.col("span_id"), "raw_sha256": F.sha2("content", 256), "source_anchor_id": F.col("anchor_id"), "source_element_id": F.col("element_id")}
    every = F.array_sort(F.collect_list(F.struct("pos", "part", F.regexp_replace("content", r"^\s+|\s+$", "").alias("t"), F.struct(*[c.alias(n) for n, c in segment.items()]).alias("segment"), "path")))
    per = grouped.groupBy("doc_id", "chunk").agg(every.alias("s"), F.sum("tokens").alias("tokens"), F.min("family_id").alias("family_id"), F.min("source_sha256").alias("source_sha256"))
    out = per.withColumn("text", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"))
    payload = F.struct(F.get("s", F.lit(0))["path"].alias("heading_path"), F.transform("s", lambda x: x["segment"]).alias("segments"), "source_sha256", "text")
    name = F.concat("family_id", F.lit("#semantic-"), F.substring(F.sha2(canonical(payload), 256), 1, 32))
    return out.select("doc_id", "chunk", F.size("s").alias("parts"), "tokens", F.get("s", F.lit(0))["pos"].alias("first_pos"), F.element_at("s", -1)["pos"].alias("last_pos"), "text", F.sha2("text", 256).alias("content_hash"), name.alias("chunk_id"))


def oversize(parts: DataFrame, most: int = STRUCTURAL) -> DataFrame:
    """doc_id, pos, tokens of structural elements over their limit, which can't be cut: a document that has one is not to be chunked."""
    return parts.where(F.col("type").isin(*STRUCTURES) & (F.col("tokens") > most)).select("doc_id", "pos", "tokens")


def report(c: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, chunks, tokens, fewest, most_tokens, oversize, repeated (chunks whose text another chunk of the document has)."""
    again = c.groupBy("doc_id", "content_hash").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))
    per = c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("fewest"), F.max("tokens").alias("most_tokens"), F.count_if(F.col("tokens") > most).alias("oversize"))
    return per.join(again, "doc_id")


def range_gaps(parts: DataFrame) -> DataFrame:
    """Elements whose ranges don't cover them: a first start above 0, a start that isn't the end before, a last end before the length."""
    w = W.partitionBy("doc_id", "pos").orderBy("part")
    rows = parts.withColumns({"before": F.lag("end", 1, 0).over(w), "after": F.lead("start").over(w)})
    return rows.where((F.col("start") != F.col("before")) | (F.col("after").isNull() & (F.col("end") != F.col("size")))).select("doc_id", "pos", "part")


def citations(grouped: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, chunk, pages, locator, anchors, sound: the chain from part to element, checked by the hash of the text at the part's range."""
    e = elements.select("doc_id", "pos", "page", F.col("content").alias("whole"))
    chain = grouped.join(e, ["doc_id", "pos"], "left")
    there = F.sha2(F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")), 256) == F.sha2("content", 256)
    per = chain.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count_distinct("pos").alias("anchors"), F.min(F.coalesce(there, F.lit(False))).alias("sound"))
    return per.select("doc_id", "chunk", F.array_join("pages", ",").alias("pages"), text.page_locator(F.col("pages")).alias("locator"), "anchors", "sound")


def zip_mismatches(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Ordinals at which two 1:1 tables differ in any of the columns, or only one has a row."""
    a = left.select("ordinal", F.struct(*columns).alias("a"))
    b = right.select("ordinal", F.struct(*columns).alias("b"))
    return a.join(b, "ordinal", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("ordinal")
