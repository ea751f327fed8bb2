"""Ordered element tables: structure, selection and quality of extracted documents.

Windows are per document, whose element count bounds a task's group; nothing is ordered globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.functions import ids, text


def _doc(*order: str) -> W:
    return W.partitionBy("doc_id").orderBy(*(order or ("pos",)))


def _so_far(*order: str) -> W:
    return _doc(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def with_heading_paths(elements: DataFrame) -> DataFrame:
    """``elements`` and path: at most two levels. A title resets the path to itself; else the first heading is the root, and each later one the second level."""
    own = F.struct("pos", "content")
    root = F.coalesce(F.last(F.when(F.col("type") == "TITLE", own), True).over(_so_far()), F.first(F.when(F.col("type") == "HEADING", own), True).over(_so_far()))
    rows = elements.withColumn("root", root).withColumn("second", F.last(F.when(F.col("type") == "HEADING", own), True).over(_so_far()))
    path = F.when(F.col("root").isNull(), F.array().cast("array<string>")).when(F.col("second.pos") > F.col("root.pos"), F.array("root.content", "second.content")).otherwise(F.array("root.content"))
    return rows.select(*elements.columns, F.filter(F.transform(path, text.compact), lambda x: x != "").alias("path"))


def heading_paths(elements: DataFrame) -> DataFrame:
    """doc_id, pos, path of ``with_heading_paths``."""
    return with_heading_paths(elements.select("doc_id", "pos", "type", "content")).select("doc_id", "pos", "path")


def heading_stack(elements: DataFrame, deepest: int = 6) -> DataFrame:
    """doc_id, pos, path: for each level the last heading, unless one of a higher level came after it; blanks are left out."""
    rows, levels = elements, []
    for k in range(1, deepest + 1):
        here = F.when((F.col("type") == "HEADING") & (F.col("level") == k), F.struct("pos", "content"))
        rows = rows.withColumn(f"h{k}", F.last(here, True).over(_so_far()))
    for k in range(1, deepest + 1):
        above = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"h{j}.pos"), F.lit(-1)) for j in range(1, k)]) if k > 1 else F.lit(-1)
        levels.append(F.when(F.col(f"h{k}.pos") > above, F.col(f"h{k}.content")))
    return rows.select("doc_id", "pos", F.filter(F.array(*levels), lambda x: x.isNotNull() & (x != "")).alias("path"))


def heading_jumps(elements: DataFrame) -> DataFrame:
    """Headings more than one level under the heading before; headings without a level are passed over."""
    h = elements.where((F.col("type") == "HEADING") & F.col("level").isNotNull())
    return h.withColumn("before", F.lag("level").over(_doc())).where(F.col("level") > F.col("before") + 1).select("doc_id", "pos", "before", "level")


def order_breaks(elements: DataFrame, order: str = "pos", block: str = "block") -> DataFrame:
    """Rows whose block number is not above the one before."""
    return elements.withColumn("before", F.lag(block).over(_doc(order))).where(F.col("before") >= F.col(block)).select("doc_id", order, "before", block)


def sections(elements: DataFrame, is_break: Column) -> DataFrame:
    """Adds ``section``: the breaks before the row."""
    before = _doc().rowsBetween(W.unboundedPreceding, -1)
    return elements.withColumn("section", F.coalesce(F.sum(is_break.cast("int")).over(before), F.lit(0)))


def list_runs(elements: DataFrame) -> DataFrame:
    """Runs of neighbouring LIST rows as one element: first position, items, text with a number for each item."""
    rows = elements.withColumn("run", F.sum((F.col("type") != "LIST").cast("int")).over(_so_far()))
    items = rows.where((F.col("type") == "LIST") & (F.trim("content") != ""))
    items = items.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "run").orderBy("pos")))
    grouped = items.groupBy("doc_id", "run").agg(F.min("pos").alias("pos"), F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct("pos", F.concat(F.col("nth").cast("string"), F.lit(". "), F.col("content")).alias("t")))).alias("all"))
    return grouped.select("doc_id", "pos", "items", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("markdown"))


def item_numbers(elements: DataFrame) -> DataFrame:
    """Number of each LIST row since the last heading or plain paragraph; tables and blank rows don't reset it."""
    reset = F.col("type").isin("TITLE", "HEADING", "PARAGRAPH") & (F.trim("content") != "")
    rows = elements.withColumn("run", F.sum(reset.cast("int")).over(_so_far()))
    return rows.where("type = 'LIST'").select("doc_id", "pos", F.row_number().over(W.partitionBy("doc_id", "run").orderBy("pos")).alias("number"))


def selection(elements: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, pos, fate: visuals are filtered if decorative by class or role, their own or else their asset's, else pending; the rest is indexable unless marked."""
    held = elements.join(assets.select("asset_id", F.col("classification").alias("asset_class"), F.col("role").alias("asset_role")), "asset_id", "left")
    first = lambda own, theirs: F.upper(F.coalesce(F.nullif(F.col(own), F.lit("")), F.col(theirs), F.lit("")))
    decorative = (first("classification", "asset_class") == "DECORATIVE") | first("role", "asset_role").isin("BRAND_LOGO", "PAGE_DECORATION")
    fate = F.when(F.col("type").isin("IMAGE", "FLOWCHART"), F.when(decorative, "filtered").otherwise("pending_visual")).when(~F.coalesce(F.col("indexable"), F.lit(True)), "filtered").otherwise("indexable")
    return held.select("doc_id", "pos", "type", fate.alias("fate"))


def page_gaps(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Pages from 1 to ``pages`` without an element."""
    expected = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    return expected.join(elements.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def repetition(elements: DataFrame, least: int = 8) -> DataFrame:
    """doc_id, lines, ratio: repeats among folded lines, 0 under ``least`` lines. Counted in two steps, so a line that repeats a lot is combined before it moves."""
    lines = elements.where(F.col("type").isin("TITLE", "HEADING", "PARAGRAPH", "CAPTION")).select("doc_id", F.lower(text.compact(F.col("content"))).alias("line")).where("line <> ''")
    per = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.sum(F.col("n") - 1).alias("again")).select("doc_id", "lines", F.when(F.col("lines") < least, 0.0).otherwise(F.col("again") / F.col("lines")).alias("ratio"))


def boilerplate(lines: DataFrame, pages: DataFrame, share: float = 0.6, longest: int = 120) -> DataFrame:
    """Folded lines on at least max(3, half-up share) of a document's pages."""
    folded = lines.select("doc_id", "page", F.lower(text.compact(F.col("content"))).alias("line")).where((F.col("line") != "") & (F.length("line") <= longest))
    per = folded.distinct().groupBy("doc_id", "line").agg(F.count("*").alias("on_pages"))
    need = F.greatest(F.lit(3), F.floor(share * F.col("pages") + 0.5))
    return per.join(pages, "doc_id").where(F.col("on_pages") >= need).select("doc_id", "line", "on_pages")


def without_boilerplate(lines: DataFrame, share: float = 0.6, longest: int = 120) -> DataFrame:
    """Rows whose folded line isn't ``boilerplate`` of its document, whose last page tells how many pages there are; one shuffle by document."""
    line, w = F.lower(text.compact(F.col("content"))), W.partitionBy("doc_id", "_line")
    keyed = lines.withColumn("_line", line)
    seen = keyed.withColumns({"_on": F.size(F.collect_set("page").over(w)), "_pages": F.max("page").over(W.partitionBy("doc_id"))})
    repeated = (F.col("_line") != "") & (F.length("_line") <= longest) & (F.col("_on") >= F.greatest(F.lit(3), F.floor(share * F.col("_pages") + 0.5)))
    return seen.where(~repeated).select(*lines.columns)


def margin_boilerplate(rows: DataFrame, height: int, margin: float = 0.11, fewest: int = 4) -> DataFrame:
    """Texts of 3 to 160 characters in the top or bottom margin on max(3, round(0.6 pages)) pages, halves to even; none under ``fewest`` pages."""
    total = rows.agg(F.count_distinct("page").alias("pages"))
    edge = rows.where((F.col("y1") <= height * margin) | (F.col("y0") >= height * (1 - margin)))
    folded = edge.select("page", F.lower(text.compact(F.col("text"))).alias("line")).where(F.length("line").between(3, 160)).distinct()
    per = folded.groupBy("line").agg(F.count("*").alias("on_pages")).crossJoin(F.broadcast(total))  # total is one row
    return per.where((F.col("pages") >= fewest) & (F.col("on_pages") >= F.greatest(F.lit(3), F.bround(0.6 * F.col("pages"))))).select("line", "on_pages")


def anchor_issues(elements: DataFrame, farthest: int = 100_000) -> DataFrame:
    """doc_id, pos, code of anchors that are unsound: no page, page out of range, no box, box out of range, repeated."""
    again = F.row_number().over(W.partitionBy("doc_id", "page", "x0", "y0", "x1", "y1").orderBy("pos")) > 1
    boxed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    codes = F.array(
        F.when(F.col("page").isNull(), "source_anchor_page_missing"),
        F.when((F.col("page") < 1) | (F.col("page") > F.col("pages")), "source_anchor_page_out_of_range"),
        F.when(~boxed, "source_anchor_bbox_missing"),
        F.when(boxed & ((F.greatest("x1", "y1") > farthest) | (F.least("x0", "y0") < 0) | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))), "source_anchor_bbox_out_of_range"),
        F.when(F.col("again") & boxed, "duplicate_source_anchor"),
    )
    return elements.withColumn("again", again).select("doc_id", "pos", F.explode(F.array_compact(codes)).alias("code"))


def duplicate_anchors(elements: DataFrame) -> DataFrame:
    """doc_id, first_pos, pos: each later element with an anchor and the first that had it."""
    w = W.partitionBy("doc_id", "page", "x0", "y0", "x1", "y1").orderBy("pos")
    rows = elements.select("doc_id", "pos", F.first("pos").over(w).alias("first_pos"), F.row_number().over(w).alias("nth"))
    return rows.where("nth > 1").select("doc_id", "first_pos", "pos")


#: Code, severity, domain, whether it asks for a fallback.
RULES = (
    ("empty_page", "ERROR", "TEXT", True),
    ("page_text_too_short", "WARNING", "TEXT", True),
    ("page_mojibake_ratio_exceeded", "ERROR", "TEXT", True),
    ("page_text_repetition_abnormal", "WARNING", "TEXT", True),
    ("reading_order_invalid", "ERROR", "TEXT", True),
    ("heading_hierarchy_jump", "WARNING", "TEXT", True),
    ("table_grid_invalid", "ERROR", "TABLE", True),
    ("markdown_encoding_error", "ERROR", "TEXT", True),
    ("page_count_mismatch", "ERROR", "PROVENANCE", True),
    ("pages_without_mapped_elements", "WARNING", "PROVENANCE", True),
    ("insufficient_bbox_coverage", "ERROR", "PROVENANCE", True),
    ("no_mapped_elements", "ERROR", "TEXT", True),
    ("repeated_decorative_asset", "WARNING", "VISUAL", False),
    ("repeated_brand_logo", "WARNING", "VISUAL", False),
    ("unreferenced_extracted_assets", "WARNING", "VISUAL", False),
    ("graph_topology_invalid", "ERROR", "VISUAL", True),
)
#: Limits of the page rules.
SHORT_TEXT, MOST_MOJIBAKE, REPEATED_TEXT, REPEATED_LINES, MOST_REPEATED, LEAST_BOXED = 12, 0.02, 300, 8, 0.70, 0.98


def page_issues(elements: DataFrame, scopes: DataFrame | None = None, block: str = "pos") -> DataFrame:
    """issue_id, doc_id, page, code, severity, domain, fallback of the rules that look at one page; ``scopes`` (doc_id, page) are the pages that should be there."""
    texts = ~F.col("type").isin("IMAGE", "FLOWCHART", "HEADER", "FOOTER") & (F.col("content") != "")
    line = F.when(F.col("type").isin("TITLE", "HEADING", "PARAGRAPH", "CAPTION"), F.nullif(F.lower(text.compact(F.col("content"))), F.lit("")))
    bad_table = (F.col("type") == "TABLE") & ~text.gfm_table(F.col("content"))
    broken = F.col(block) <= F.lag(block).over(W.partitionBy("doc_id", "page").orderBy("pos"))
    rows = elements.withColumns({"part": F.when(texts, F.struct("pos", "content")), "line": line, "bad_table": bad_table, "broken": F.coalesce(broken, F.lit(False)), "rich": F.col("type").isin("TABLE", "LIST", "IMAGE", "FLOWCHART")})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["content"]), "\n")
    pages = rows.groupBy("doc_id", "page").agg(joined.alias("t"), F.max("rich").alias("rich"), F.max("bad_table").alias("bad_table"), F.max("broken").alias("broken"), F.collect_list("line").alias("lines"))
    again = F.size("lines") - F.size(F.array_distinct("lines"))
    ratio = F.when(F.size("lines") < REPEATED_LINES, 0.0).otherwise(again / F.size("lines"))
    codes = F.array(
        F.when((F.length(F.regexp_replace("t", r"^\s+|\s+$", "")) < SHORT_TEXT) & ~F.col("rich"), "page_text_too_short"),
        F.when(text.mojibake_ratio(F.col("t")) > MOST_MOJIBAKE, "page_mojibake_ratio_exceeded"),
        F.when((F.length("t") >= REPEATED_TEXT) & (ratio > MOST_REPEATED), "page_text_repetition_abnormal"),
        F.when(F.col("broken"), "reading_order_invalid"),
        F.when(F.col("bad_table"), "table_grid_invalid"),
    )
    found = pages.select("doc_id", "page", F.explode(F.array_compact(codes)).alias("code"))
    jumps = heading_jumps(elements).join(elements.select("doc_id", "pos", "page"), ["doc_id", "pos"]).select("doc_id", "page", F.lit("heading_hierarchy_jump").alias("code")).distinct()
    found = found.unionByName(jumps)
    if scopes is not None:
        found = found.unionByName(scopes.join(pages, ["doc_id", "page"], "left_anti").select("doc_id", "page", F.lit("empty_page").alias("code")))
    return with_rules(found)


def document_issues(documents: DataFrame, elements: DataFrame, assets: DataFrame) -> DataFrame:
    """issue_id, doc_id, page (null), code, severity, domain, fallback of the rules that look at a whole extraction.

    ``documents`` has doc_id, pages, manifest_pages, broken (replacement characters); ``elements`` doc_id, page, boxed;
    ``assets`` doc_id, asset_id, classification, role, files and referenced (numbers of physical files and of those referred to)."""
    per = elements.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("boxed").alias("boxed"), F.collect_set("page").alias("on"))
    d = documents.join(per, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    missing = F.exists(F.when(F.col("manifest_pages") > 0, F.sequence(F.lit(1), F.col("manifest_pages"))).otherwise(F.array().cast("array<int>")), lambda p: ~F.array_contains(F.coalesce("on", F.array().cast("array<int>")), p))
    codes = F.array(
        F.when(F.col("broken") > 0, "markdown_encoding_error"),
        F.when(F.col("pages") != F.col("manifest_pages"), "page_count_mismatch"),
        F.when(missing, "pages_without_mapped_elements"),
        F.when(F.when(F.col("n") > 0, F.col("boxed") / F.col("n")).otherwise(0.0) < LEAST_BOXED, "insufficient_bbox_coverage"),
        F.when(F.col("n") == 0, "no_mapped_elements"),
    )
    logo = F.when(F.col("role") == "BRAND_LOGO", "repeated_brand_logo").otherwise("repeated_decorative_asset")
    visual = F.array(F.when((F.col("classification") == "DECORATIVE") & (F.col("files") > 1), logo), F.when(F.col("files") > F.col("referenced"), "unreferenced_extracted_assets"))
    found = d.select("doc_id", F.lit("").alias("asset_id"), F.explode(F.array_compact(codes)).alias("code")).unionByName(assets.select("doc_id", F.col("asset_id").cast("string").alias("asset_id"), F.explode(F.array_compact(visual)).alias("code")))
    return _ruled(found.withColumn("page", F.lit(None).cast("int")), "asset_id")


def with_rules(found: DataFrame) -> DataFrame:
    return _ruled(found, "page")


def _ruled(found: DataFrame, of: str) -> DataFrame:
    rules = found.sparkSession.createDataFrame(list(RULES), "code string, severity string, domain string, fallback boolean")
    own = found.join(F.broadcast(rules), "code").withColumn("issue_id", ids.digest_id("quality-issue", F.col("code"), F.col("doc_id"), F.col(of)))
    return own.select("issue_id", "doc_id", "page", "code", "severity", "domain", "fallback")


def report(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, issues, errors, warnings, fallbacks, disposition: a fallback that is asked for, else the gravest issue."""
    per = issues.groupBy("doc_id").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), F.count_if("fallback").alias("fallbacks"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("issues", "errors", "warnings", "fallbacks")}
    out = documents.select("doc_id").join(per, "doc_id", "left").withColumns(zero)
    fate = F.when(F.col("fallbacks") > 0, "FALLBACK_REQUIRED").when(F.col("errors") > 0, "QUARANTINE_REQUIRED").when(F.col("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return out.withColumn("disposition", fate)


def issue_scopes(issues: DataFrame, scopes: DataFrame) -> DataFrame:
    """issue_id, scope_id: the least scope of the issue's document that shares a page or an element with it; unscoped issues go to the document's least scope.

    The two overlaps are equi-joins on exploded members, so no pair without a match is looked at."""
    i = issues.select("issue_id", "doc_id", "pages", "elements")
    by_page = i.select("issue_id", "doc_id", F.explode("pages").alias("page")).join(scopes.select("scope_id", "doc_id", F.explode("pages").alias("page")), ["doc_id", "page"])
    by_element = i.select("issue_id", "doc_id", F.explode("elements").alias("e")).join(scopes.select("scope_id", "doc_id", F.explode("elements").alias("e")), ["doc_id", "e"])
    bare = i.where((F.size("pages") == 0) & (F.size("elements") == 0)).join(scopes.select("doc_id", "scope_id"), "doc_id")
    every = by_page.select("issue_id", "scope_id").unionByName(by_element.select("issue_id", "scope_id")).unionByName(bare.select("issue_id", "scope_id"))
    return i.select("issue_id").join(every.groupBy("issue_id").agg(F.min("scope_id").alias("scope_id")), "issue_id", "left")


#: Kind of route -> ordered (action, attempts, engine, condition).
PLANS = {
    "TEXT_TABLE": (
        ("ODL_HYBRID", 1, "OPENDATALOADER_HYBRID", "local_page_failed"),
        ("REVERIFY", 1, None, "after_odl_hybrid"),
        ("MINERU_PAGE", 1, "MINERU", "odl_hybrid_reverify_failed"),
        ("REVERIFY", 1, None, "after_mineru_page"),
        ("EXTRACTION_QUARANTINE", 0, None, "mineru_reverify_failed"),
    ),
    "PROVENANCE": (
        ("PROVENANCE_REPAIR", 2, None, "source_anchor_validation_failed"),
        ("PROVENANCE_VERIFY", 1, None, "after_provenance_repair"),
        ("EXTRACTION_QUARANTINE", 0, None, "source_anchor_mapping_failed"),
    ),
    "GRAPH_TOPOLOGY": (
        ("QWEN_FLOWCHART", 2, "QWEN3_VL", "graph_topology_invalid"),
        ("GRAPH_VERIFY", 1, None, "after_qwen_flowchart"),
        ("EXTRACTION_QUARANTINE", 0, None, "qwen_retry_cap_exhausted"),
    ),
    "VISUAL_NARRATIVE": (
        ("NARRATIVE_SUBSTITUTION", 1, None, "narrative_coverage_verified"),
        ("PROVENANCE_VERIFY", 1, None, "after_narrative_substitution"),
        ("PASS", 0, None, "substitution_provenance_valid"),
    ),
    "VISUAL_QWEN": (
        ("QWEN_FLOWCHART", 2, "QWEN3_VL", "narrative_coverage_insufficient"),
        ("GRAPH_VERIFY", 1, None, "after_qwen_flowchart"),
        ("PROVENANCE_VERIFY", 1, None, "graph_topology_valid"),
        ("EXTRACTION_QUARANTINE", 0, None, "graph_or_provenance_invalid_after_retry"),
    ),
    "PASS": (("PASS", 0, None, "quality_gate_passed"),),
}
#: Kinds that need no fallback, and those whose engine is an external model.
SETTLED, EXTERNAL = ("PASS", "VISUAL_NARRATIVE"), ("GRAPH_TOPOLOGY", "VISUAL_QWEN")


def scope_routes(issues: DataFrame, narratives: DataFrame, scopes: DataFrame) -> DataFrame:
    """route_id, doc_id, scope_id, page, kind, reasons, fallback, external, ordinal (in the plan: pages before what has none, then by scope and kind).

    ``issues`` has doc_id, scope_id, code, domain, fallback; ``narratives`` doc_id, scope_id, sufficient of visuals, whose
    routes are one each; ``scopes`` doc_id, scope_id, page and source_sha256.  A scope that no route covers passes."""
    i = issues.where("fallback")
    kinds = F.array_compact(F.array(
        F.when(F.col("domain").isin("TEXT", "TABLE"), "TEXT_TABLE"), F.when(F.col("domain") == "PROVENANCE", "PROVENANCE"), F.when(F.col("code") == "graph_topology_invalid", "GRAPH_TOPOLOGY"),
    ))
    by_kind = i.select("doc_id", "scope_id", "code", F.explode(kinds).alias("kind")).groupBy("doc_id", "scope_id", "kind").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("reasons"))
    enough = F.col("sufficient")
    visual = narratives.select(
        "doc_id", "scope_id", F.when(enough, "VISUAL_NARRATIVE").otherwise("VISUAL_QWEN").alias("kind"), F.concat(F.lit("visual_narrative_coverage_"), F.when(enough, "sufficient").otherwise("insufficient")).alias("reasons")
    )
    asked = by_kind.unionByName(visual)
    passed = scopes.join(asked, ["doc_id", "scope_id"], "left_anti").select("doc_id", "scope_id", F.lit("PASS").alias("kind"), F.lit("").alias("reasons"))
    rows = asked.unionByName(passed).join(scopes, ["doc_id", "scope_id"])
    route = F.substring(F.sha2(F.concat_ws("|", "source_sha256", "scope_id", "kind", "reasons"), 256), 1, 24)
    ordinal = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("page").asc_nulls_last(), "scope_id", "kind", "reasons"))
    return rows.select(F.concat(F.lit("fallback-route-"), route).alias("route_id"), "doc_id", "scope_id", "page", "kind", "reasons", (~F.col("kind").isin(*SETTLED)).alias("fallback"), F.col("kind").isin(*EXTERNAL).alias("external"), ordinal.alias("ordinal"))


def route_steps(routes: DataFrame) -> DataFrame:
    """One row a step: the route's columns, step (from 1), action, attempts, engine, condition."""
    rows = [(k, n, *s) for k, plan in PLANS.items() for n, s in enumerate(plan, 1)]
    steps = routes.sparkSession.createDataFrame(rows, "kind string, step int, action string, attempts int, engine string, condition string")
    return routes.join(F.broadcast(steps), "kind")


def fallback_engine(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """doc_id, engine: the first engine of the plan's fallback routes that isn't the last of the document's chain (doc_id, last_engine), else MANUAL."""
    asked = steps.where("fallback AND engine IS NOT NULL").join(chains, "doc_id").where(F.col("engine") != F.col("last_engine"))
    first = asked.groupBy("doc_id").agg(F.min_by("engine", F.struct("ordinal", "step")).alias("engine"))
    needs = steps.where("fallback").select("doc_id").distinct()
    return needs.join(first, "doc_id", "left").select("doc_id", F.coalesce("engine", F.lit("MANUAL")).alias("engine"))


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


#: Words that tell of a process, in folded form.
PROCESS_WORDS = ("lưu đồ", "quy trình", "bước", "nếu", "đạt", "không đạt", "nhánh", "tiếp theo", "flowchart", "process")
#: Marks by which an extraction has judged a visual itself.
SUFFICIENT, INSUFFICIENT = ("true", "sufficient", "complete", "pass", "đủ"), ("false", "insufficient", "missing", "fail", "thiếu")


def narrative(elements: DataFrame, apart: int = 4, least: int = 60, least_score: float = 0.65) -> DataFrame:
    """doc_id, pos, characters, keywords, coverage, sufficient, overridden of visuals, by the text within ``apart`` blocks on their page, or in their section if they have no page.

    ``elements`` has doc_id, pos, page, section, type, content and told (a visual's own mark, which overrides)."""
    key = lambda page, section: F.when(page.isNotNull(), F.concat(F.lit("p"), page)).otherwise(F.concat(F.lit("s"), F.coalesce(section.cast("string"), F.lit("none"))))
    v = elements.where(F.col("type").isin("IMAGE", "FLOWCHART")).select("doc_id", F.col("pos").alias("vpos"), key(F.col("page"), F.col("section")).alias("near"), F.lower(F.trim("told")).alias("told"))
    t = elements.where(F.col("type").isin("PARAGRAPH", "CAPTION", "LIST", "HEADING")).select("doc_id", "pos", F.regexp_replace("content", r"^\s+|\s+$", "").alias("t"), "page", "section").where("t <> ''")
    none = F.lit(None).cast("int")
    t = t.select("doc_id", "pos", "t", F.explode(F.array_compact(F.array(F.when(F.col("page").isNotNull(), F.concat(F.lit("p"), "page")), key(none, F.col("section"))))).alias("near"))
    found = v.join(t, ["doc_id", "near"]).where(F.abs(F.col("vpos") - F.col("pos")) <= apart)
    per = found.groupBy("doc_id", "vpos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n").alias("all"))
    out = v.join(per, ["doc_id", "vpos"], "left").withColumn("all", F.coalesce("all", F.lit("")))
    words = sum((F.lower("all").contains(w).cast("int") for w in PROCESS_WORDS), F.lit(0))
    marked = F.col("told").isin(*SUFFICIENT, *INSUFFICIENT)
    out = out.select("doc_id", F.col("vpos").alias("pos"), F.coalesce(marked, F.lit(False)).alias("overridden"), F.col("told").isin(*SUFFICIENT).alias("yes"), F.length("all").alias("n"), words.alias("k"))
    score = 0.6 * F.least(F.col("n") / least, F.lit(1.0)) + 0.4 * F.least(F.col("k") / 3, F.lit(1.0))
    own = F.col("overridden")
    return out.select(
        "doc_id", "pos", F.when(own, 0).otherwise(F.col("n")).alias("characters"), F.when(own, 0).otherwise(F.col("k")).alias("keywords"),
        F.when(own, F.col("yes").cast("double")).otherwise(F.round(score, 6)).alias("coverage"), F.when(own, F.col("yes")).otherwise((F.col("n") >= least) & (score >= least_score)).alias("sufficient"), own.alias("overridden"),
    )
