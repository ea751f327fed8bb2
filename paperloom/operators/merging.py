"""Merging page results, assets, inventories and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def replace_pages(pages: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id, page, markdown, replaced: the replacement where there is one."""
    r = replacements.select("doc_id", "page", F.col("markdown").alias("new"))
    return pages.join(r, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("new", "markdown").alias("markdown"), F.col("new").isNotNull().alias("replaced"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, markdown: pages in order under their markers."""
    each = F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.regexp_replace("markdown", r"^\s+|\s+$", ""))
    per = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", each.alias("t")))).alias("p"))
    return per.select("doc_id", F.concat(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("markdown"))


def replace_page_elements(elements: DataFrame, fresh: DataFrame) -> DataFrame:
    """A document's elements with those of the fresh pages in place of the old ones, numbered anew; a page that is new goes by its number."""
    pages = fresh.select("doc_id", "page").distinct()
    old = elements.join(pages, ["doc_id", "page"], "left_anti").select("doc_id", "page", "pos", "content", F.lit(False).alias("fresh"))
    every = old.unionByName(fresh.select("doc_id", "page", "pos", "content", F.lit(True).alias("fresh")))
    return every.withColumn("new_pos", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "pos")) - 1).drop("pos")


def merge_assets(left: DataFrame, right: DataFrame) -> DataFrame:
    """asset_id, content_hash, paths, refs, conflict: full outer merge; paths in both orders of first sight, the right side's references win by id."""
    a = left.select("asset_id", F.col("content_hash").alias("ha"), F.col("paths").alias("pa"), F.col("refs").alias("ra"))
    b = right.select("asset_id", F.col("content_hash").alias("hb"), F.col("paths").alias("pb"), F.col("refs").alias("rb"))
    j = a.join(b, "asset_id", "full_outer")
    none = F.array().cast("array<string>")
    kept = F.map_filter("ra", lambda k, v: ~F.array_contains(F.map_keys("rb"), k))
    refs = F.when(F.col("ra").isNull(), F.col("rb")).when(F.col("rb").isNull(), F.col("ra")).otherwise(F.map_concat(kept, "rb"))
    return j.select("asset_id", F.coalesce("ha", "hb").alias("content_hash"), F.array_distinct(F.concat(F.coalesce("pa", none), F.coalesce("pb", none))).alias("paths"), refs.alias("refs"), F.coalesce(F.col("ha") != F.col("hb"), F.lit(False)).alias("conflict"))


def run_gaps(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, page, gap: planned pages without a run, and runs that weren't planned."""
    missing = planned.select("doc_id", "page").distinct().join(runs, ["doc_id", "page"], "left_anti").withColumn("gap", F.lit("missing"))
    extra = runs.select("doc_id", "page").distinct().join(planned, ["doc_id", "page"], "left_anti").withColumn("gap", F.lit("unplanned"))
    return missing.unionByName(extra)


def merge_split_tables(rows: DataFrame, expected: int) -> DataFrame:
    """doc_id, cells, sound: body rows of a table split over pages by their key (first cell); sound if the keys are 1 to ``expected``, each once."""
    per = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min_by("cell", F.struct("page", "pos")).alias("cell"))
    out = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "cell"))).alias("r"), F.max("n").alias("n"))
    keys = F.transform("r", lambda x: x["key"])
    return out.select("doc_id", F.array_join(F.transform("r", lambda x: x["cell"]), " / ").alias("cells"), ((F.col("n") == 1) & (keys == F.sequence(F.lit(1), F.lit(expected)))).alias("sound"))


def inventory_diff(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, difference: full outer comparison of an inventory with what is there: missing, unexpected, size, sha256."""
    m = manifest.select("path", F.col("size").alias("ms"), F.col("sha256").alias("mh"))
    f = found.select("path", F.col("size").alias("fs"), F.col("sha256").alias("fh"))
    d = F.when(F.col("fs").isNull(), "missing").when(F.col("ms").isNull(), "unexpected").when(F.col("ms") != F.col("fs"), "size").when(F.col("mh") != F.col("fh"), "sha256")
    return m.join(f, "path", "full_outer").select("path", d.alias("difference")).where("difference IS NOT NULL")


def image_files(references: DataFrame, files: DataFrame, within: Column | None = None) -> DataFrame:
    """ref_id, path: the file of the same path, else the only file of the same folded name (of equal ``within``, an expression of path), else null."""
    base = F.struct(within if within is not None else F.lit(""), F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1)))
    exact = references.join(files.select("path", F.lit(True).alias("is")).distinct(), "path", "left")
    only = files.select(base.alias("base"), F.col("path").alias("by_name")).groupBy("base").agg(F.count("*").alias("n"), F.min("by_name").alias("by_name")).where("n = 1")
    return exact.withColumn("base", base).join(only, "base", "left").select("ref_id", F.when(F.col("is"), F.col("path")).otherwise(F.col("by_name")).alias("path"))


def markdown_only_images(markdown: DataFrame, files: DataFrame, structured: DataFrame) -> DataFrame:
    """doc_id, path of the files (doc_id, path) that a document's Markdown (doc_id, markdown) names and its structure (doc_id, path) doesn't refer to."""
    named = F.explode(F.regexp_extract_all("markdown", F.lit(r"!\[[^\]]*\]\(\s*<?([^)>]*?)>?\s*\)"), F.lit(1))).alias("target")
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    said = markdown.select("doc_id", named).select("doc_id", base("target").alias("base")).distinct()
    return files.withColumn("base", base("path")).join(said, ["doc_id", "base"], "left_semi").join(structured, ["doc_id", "path"], "left_anti").select("doc_id", "path")


def content_groups(files: DataFrame) -> DataFrame:
    """sha256, files, first_path, copies: files of equal content."""
    return files.groupBy("sha256").agg(F.count("*").alias("files"), F.min("path").alias("first_path"), (F.count("*") - 1).alias("copies"))


def graph_parts(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges) of ``payloads`` (graph_id, payload as JSON): nodes by their ``id`` and ``type``, edges by ``source`` or ``from`` and ``target`` or ``to``; what is no object has null columns only."""
    kind = "struct<nodes:array<string>,edges:array<string>>"
    p = payloads.select("graph_id", F.from_json("payload", kind).alias("p")).select("graph_id", "p.*")
    field = lambda c, *names: F.trim(F.coalesce(*[F.nullif(F.get_json_object(c, f"$.{n}"), F.lit("")) for n in names], F.lit("")))
    is_object = lambda c: F.col(c).startswith("{")
    graphs = p.select("graph_id", (F.coalesce(F.size("nodes"), F.lit(0)) > 0).alias("has_nodes"), F.col("edges").isNotNull().alias("has_edges"))
    nodes = p.select("graph_id", F.posexplode("nodes").alias("place", "n")).select("graph_id", "place", F.when(is_object("n"), field("n", "id")).alias("node_id"), F.lower(F.get_json_object("n", "$.type")).alias("kind"))
    edges = p.select("graph_id", F.posexplode("edges").alias("place", "e")).select("graph_id", "place", F.when(is_object("e"), field("e", "source", "from")).alias("source"), F.when(is_object("e"), field("e", "target", "to")).alias("target"))
    return graphs, nodes, edges


def graph_issues(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, code, id of what makes a graph's topology unsound; a decision needs two edges out whose ends are both nodes, to one target or several.

    ``graphs`` has graph_id, has_nodes, has_edges; a null node_id or source is an entry that is no object, an empty node_id a node without one."""
    keyed = nodes.where("node_id <> ''").select("graph_id", "node_id").distinct()
    known = edges.where("source IS NOT NULL").join(keyed.withColumnRenamed("node_id", "source").withColumn("a", F.lit(True)), ["graph_id", "source"], "left")
    known = known.join(keyed.withColumnRenamed("node_id", "target").withColumn("b", F.lit(True)), ["graph_id", "target"], "left").withColumn("sound", F.coalesce(F.col("a") & F.col("b"), F.lit(False)))
    ways = known.where("sound").groupBy("graph_id", F.col("source").alias("node_id")).agg(F.count("*").alias("ways"))
    decisions = nodes.where("kind = 'decision' AND node_id <> ''").select("graph_id", "node_id").distinct()
    said = lambda frame, code, of: frame.select("graph_id", F.lit(code).alias("code"), of.alias("id"))
    none = F.lit("")
    parts = [
        said(graphs.where("NOT has_nodes"), "nodes_missing_or_empty", none), said(graphs.where("NOT has_edges"), "edges_missing", none),
        said(nodes.where("node_id IS NULL"), "node_not_object", none), said(nodes.where("node_id = ''"), "node_id_missing", none), said(edges.where("source IS NULL"), "edge_not_object", none),
        said(nodes.where("node_id <> ''").groupBy("graph_id", "node_id").count().where("count > 1"), "duplicate_node_id", F.col("node_id")),
        said(known.where("NOT sound"), "edge_endpoint_missing", F.concat("source", F.lit(">"), "target")),
        said(decisions.join(ways, ["graph_id", "node_id"], "left").where(F.coalesce("ways", F.lit(0)) < 2), "decision_branch_count_invalid", F.col("node_id")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


def spaced_sample(rows: DataFrame, count: int) -> DataFrame:
    """``count`` rows of each document at evenly spaced places, round(i (n - 1) / (count - 1)) with halves to even; all, if there are no more."""
    w = W.partitionBy("doc_id")
    at = rows.withColumns({"k": F.row_number().over(w.orderBy("pos")) - 1, "n": F.count("*").over(w)})
    spots = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (count - 1)).cast("int"))
    return at.where((F.col("n") <= count) | F.array_contains(spots, F.col("k"))).drop("k", "n")


def between_markers(lines: DataFrame, start: str, end: str) -> DataFrame:
    """doc_id, first, last, lines: from the first line with the start pattern to the first later one with the end pattern."""
    a = lines.where(F.col("content").rlike(start)).groupBy("doc_id").agg(F.min("pos").alias("first"))
    b = lines.where(F.col("content").rlike(end)).join(a, "doc_id").where(F.col("pos") > F.col("first")).groupBy("doc_id", "first").agg(F.min("pos").alias("last"))
    return lines.join(b, "doc_id").where(F.col("pos").between(F.col("first"), F.col("last"))).groupBy("doc_id", "first", "last").agg(F.count("*").alias("lines"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their counts, that only one of two tables has; empty if a recomputed stage equals the stored one."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
