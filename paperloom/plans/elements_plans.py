"""Structure, quality and chunks of element tables over the driver's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import chunking, merging
from paperloom.operators import elements as E
from paperloom.plans.registry import query
from paperloom.sources.tables import ELEMENTS_SQL, LINES_SQL, elements, lines, table

#: Compaction of ASCII white space, which is all that the tables hold.
_COMPACT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _compact(x: str) -> str:
    return _COMPACT.format(x)


@query(
    f"""WITH {ELEMENTS_SQL}, r AS (SELECT *, coalesce(last_value(CASE WHEN type = 'TITLE' THEN (pos, content) END IGNORE NULLS) OVER w, first_value(CASE WHEN type = 'HEADING' THEN (pos, content) END IGNORE NULLS) OVER w) AS root,
    last_value(CASE WHEN type = 'HEADING' THEN (pos, content) END IGNORE NULLS) OVER w AS second FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, pos, array_to_string(list_filter([{_compact("root[2]")}, CASE WHEN second[1] > root[1] THEN {_compact("second[2]")} ELSE '' END], lambda x: x <> ''), ' > ') AS path FROM r"""
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.heading_paths(elements(spark, sf_dir)).withColumn("path", F.array_join("path", " > "))


@query(
    f"""WITH {ELEMENTS_SQL}, h AS (SELECT doc_id, pos, level, content FROM elements WHERE type = 'HEADING'),
    live AS (SELECT *, (SELECT min(g.pos) FROM h g WHERE g.doc_id = h.doc_id AND g.pos > h.pos AND g.level <= h.level) AS until FROM h)
    SELECT e.doc_id, e.pos, coalesce(string_agg(l.content, ' > ' ORDER BY l.level) FILTER (WHERE l.content <> ''), '') AS path
    FROM elements e LEFT JOIN live l ON l.doc_id = e.doc_id AND l.pos <= e.pos AND (l.until IS NULL OR l.until > e.pos) GROUP BY e.doc_id, e.pos"""
)
def heading_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.heading_stack(elements(spark, sf_dir)).withColumn("path", F.array_join("path", " > "))


@query(f"WITH {ELEMENTS_SQL}, h AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM elements WHERE type = 'HEADING') SELECT doc_id, pos, before, level FROM h WHERE level > before + 1")
def heading_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.heading_jumps(elements(spark, sf_dir))


@query(f"WITH {ELEMENTS_SQL}, b AS (SELECT doc_id, pos, y0 AS block, lag(y0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM elements) SELECT doc_id, pos, before, block FROM b WHERE before >= block")
def reading_order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.order_breaks(elements(spark, sf_dir).withColumn("block", F.col("y0")))


@query(f"WITH {ELEMENTS_SQL} SELECT doc_id, pos, coalesce(sum((pos % 8 = 6)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section FROM elements")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sections(elements(spark, sf_dir), F.col("pos") % 8 == 6).select("doc_id", "pos", "section")


_RUNS = "sum((type <> 'LIST')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"


@query(
    f"""WITH {ELEMENTS_SQL}, r AS (SELECT *, {_RUNS} AS run FROM elements), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS nth FROM r WHERE type = 'LIST' AND trim(content) <> '')
    SELECT doc_id, min(pos) AS pos, count(*) AS items, string_agg(nth::VARCHAR || '. ' || content, chr(10) ORDER BY pos) AS markdown FROM i GROUP BY doc_id, run"""
)
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.list_runs(elements(spark, sf_dir))


@query(
    f"""WITH {ELEMENTS_SQL}, r AS (SELECT *, sum((type IN ('TITLE', 'HEADING', 'PARAGRAPH') AND trim(content) <> '')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM elements)
    SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS number FROM r WHERE type = 'LIST'"""
)
def item_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.item_numbers(elements(spark, sf_dir))


@query(
    f"""WITH {ELEMENTS_SQL}, e AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'decorative' ELSE '' END AS c, CASE WHEN pos % 5 = 0 THEN 'brand_logo' WHEN pos % 7 = 2 THEN 'FIGURE' ELSE '' END AS r FROM elements),
    a AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'DECORATIVE' WHEN 1 THEN 'INFORMATIVE' ELSE 'UNKNOWN' END AS ac, CASE item_id % 4 WHEN 0 THEN 'PAGE_DECORATION' ELSE 'UNKNOWN' END AS ar FROM benchmark)
    SELECT doc_id, pos, type, CASE WHEN type = 'IMAGE' THEN CASE WHEN upper(coalesce(nullif(c, ''), ac, '')) = 'DECORATIVE' OR upper(coalesce(nullif(r, ''), ar, '')) IN ('BRAND_LOGO', 'PAGE_DECORATION') THEN 'filtered' ELSE 'pending_visual' END WHEN pos % 13 = 7 THEN 'filtered' ELSE 'indexable' END AS fate
    FROM e LEFT JOIN a ON a.item_id = e.doc_id % 60"""
)
def element_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = F.col("pos"), F.col("item_id")
    role = F.when(p % 5 == 0, "brand_logo").when(p % 7 == 2, "FIGURE").otherwise("")
    own = elements(spark, sf_dir).withColumns({"asset_id": F.col("doc_id") % 60, "classification": F.when(p % 3 == 0, "decorative").otherwise(""), "role": role, "indexable": p % 13 != 7})
    kind = F.when(i % 3 == 0, "DECORATIVE").when(i % 3 == 1, "INFORMATIVE").otherwise("UNKNOWN")
    return E.selection(own, table(spark, sf_dir, "benchmark").select(i.alias("asset_id"), kind.alias("classification"), F.when(i % 4 == 0, "PAGE_DECORATION").otherwise("UNKNOWN").alias("role")))


@query(f"WITH {ELEMENTS_SQL}, d AS (SELECT doc_id, max(page) + 1 AS pages FROM elements GROUP BY doc_id), x AS (SELECT doc_id, unnest(range(1, pages + 1))::INT AS page FROM d) SELECT doc_id, page FROM x ANTI JOIN (SELECT DISTINCT doc_id, page FROM elements WHERE page % 3 <> 2) USING (doc_id, page)")
def page_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    return E.page_gaps(own.groupBy("doc_id").agg((F.max("page") + 1).alias("pages")), own.where("page % 3 <> 2"))


@query(
    f"""WITH {ELEMENTS_SQL}, l AS (SELECT doc_id, lower({_compact("content")}) AS line, count(*) AS n FROM elements WHERE type IN ('TITLE', 'HEADING', 'PARAGRAPH', 'CAPTION') GROUP BY ALL HAVING line <> '')
    SELECT doc_id, sum(n)::BIGINT AS lines, CASE WHEN sum(n) < 8 THEN 0.0 ELSE sum(n - 1) / sum(n) END::DOUBLE AS ratio FROM l GROUP BY doc_id"""
)
def repetition_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.repetition(elements(spark, sf_dir))


_FOLDED = f"{ELEMENTS_SQL}, total AS (SELECT doc_id, max(page) AS pages FROM elements GROUP BY doc_id), folded AS (SELECT DISTINCT doc_id, page, lower({_compact('content')}) AS line FROM elements), rep AS (SELECT doc_id, line, count(*) AS on_pages FROM folded JOIN total USING (doc_id) WHERE line <> '' AND length(line) <= 120 GROUP BY doc_id, line, pages HAVING count(*) >= greatest(3, floor(0.6 * pages + 0.5)))"


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    return E.boilerplate(own, own.groupBy("doc_id").agg(F.max("page").alias("pages")))


@query(f"WITH {_FOLDED} SELECT * FROM rep")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir)


@query(f"WITH {_FOLDED} SELECT e.doc_id, e.pos, e.content FROM elements e ANTI JOIN rep ON e.doc_id = rep.doc_id AND lower({_compact('e.content')}) = rep.line")
def without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.without_boilerplate(elements(spark, sf_dir)).select("doc_id", "pos", "content")


_ANCHORS = f"""{ELEMENTS_SQL}, total AS (SELECT doc_id, max(page) AS pages FROM elements GROUP BY doc_id),
anchored AS (SELECT e.doc_id, pos, CASE WHEN pos % 17 = 5 THEN NULL WHEN pos % 19 = 4 THEN pages + 1 ELSE page END AS page, pages, CASE WHEN pos % 23 = 2 THEN NULL ELSE x0 END AS x0, pos % 2 AS y0, CASE WHEN pos % 29 = 3 THEN x0 ELSE x0 + 5 END AS x1, 10 AS y1 FROM elements e JOIN total USING (doc_id))"""


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    pages = own.groupBy("doc_id").agg(F.max("page").alias("pages"))
    p = F.col("pos")
    return own.join(pages, "doc_id").select(
        "doc_id", "pos", F.when(p % 17 == 5, None).when(p % 19 == 4, F.col("pages") + 1).otherwise(F.col("page")).alias("page"), "pages",
        F.when(p % 23 == 2, None).otherwise(F.col("x0")).alias("x0"), (p % 2).alias("y0"), F.when(p % 29 == 3, F.col("x0")).otherwise(F.col("x0") + 5).alias("x1"), F.lit(10).alias("y1"),
    )


@query(
    f"""WITH {_ANCHORS}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, x0, y0, x1, y1 ORDER BY pos) > 1 AS again FROM anchored)
    SELECT doc_id, pos, unnest(list_filter([CASE WHEN page IS NULL THEN 'source_anchor_page_missing' END, CASE WHEN page < 1 OR page > pages THEN 'source_anchor_page_out_of_range' END, CASE WHEN x0 IS NULL THEN 'source_anchor_bbox_missing' END,
      CASE WHEN x0 IS NOT NULL AND (greatest(x1, y1) > 100000 OR x1 <= x0 OR y1 <= y0) THEN 'source_anchor_bbox_out_of_range' END, CASE WHEN again AND x0 IS NOT NULL THEN 'duplicate_source_anchor' END], lambda x: x IS NOT NULL)) AS code FROM a"""
)
def anchor_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.anchor_issues(_anchored(spark, sf_dir))


@query(f"WITH {_ANCHORS}, a AS (SELECT doc_id, pos, min(pos) OVER w AS first_pos FROM anchored WINDOW w AS (PARTITION BY doc_id, page, x0, y0, x1, y1)) SELECT doc_id, first_pos, pos FROM a WHERE pos > first_pos")
def duplicate_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.duplicate_anchors(_anchored(spark, sf_dir))


@query(f"WITH {_ANCHORS} SELECT doc_id, count(*) AS elements, round(count(x0) / count(*), 6) AS box_coverage, round(count(*) FILTER (WHERE page BETWEEN 1 AND pages) / count(*), 6) AS anchor_coverage, count(x0) / count(*) >= 0.98 AS sufficient FROM anchored GROUP BY doc_id")
def provenance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, boxed = F.count("*"), F.count("x0")
    return _anchored(spark, sf_dir).groupBy("doc_id").agg(n.alias("elements"), F.round(boxed / n, 6).alias("box_coverage"), F.round(F.count_if(F.col("page").between(1, F.col("pages"))) / n, 6).alias("anchor_coverage"), (boxed / n >= 0.98).alias("sufficient"))


_RULES_SQL = "(VALUES " + ", ".join(f"('{c}', '{s}', '{d}', {str(f).lower()})" for c, s, d, f in E.RULES) + ") AS rules(code, severity, domain, fallback)"
#: GFM: every line a row of one width with a bar in it, dashes in the second.
_ISSUES = f"""{ELEMENTS_SQL}, tabled AS (SELECT * REPLACE (CASE WHEN type = 'TABLE' AND pos % 2 = 1 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(content, '|', '/') || ' | x |' ELSE content END AS content), CASE WHEN pos % 31 = 17 THEN pos - 2 ELSE pos END AS block FROM elements),
scopes AS (SELECT doc_id, unnest(range(1, pages + 1))::INT AS page FROM (SELECT doc_id, max(page) + (doc_id % 10 = 0)::INT AS pages FROM elements GROUP BY doc_id)),
t AS (SELECT doc_id, page, coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (WHERE type <> 'IMAGE' AND content <> ''), '') AS t, bool_or(type IN ('TABLE', 'LIST', 'IMAGE')) AS rich, bool_or(type = 'TABLE' AND pos % 2 = 0) AS bad_table FROM tabled GROUP BY doc_id, page),
jumps AS (SELECT DISTINCT doc_id, page FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM elements WHERE type = 'HEADING') WHERE level > before + 1),
breaks AS (SELECT DISTINCT doc_id, page FROM (SELECT *, lag(block) OVER (PARTITION BY doc_id, page ORDER BY pos) AS before FROM tabled) WHERE block <= before),
issues0 AS (SELECT doc_id, page, 'empty_page' AS code FROM scopes ANTI JOIN t USING (doc_id, page) UNION ALL SELECT doc_id, page, 'page_text_too_short' FROM t WHERE length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 12 AND NOT rich
  UNION ALL SELECT doc_id, page, 'page_mojibake_ratio_exceeded' FROM t WHERE length(t) > 0 AND ((length(t) - length(replace(t, 'Ã', ''))) + (length(t) - length(replace(t, 'Â', ''))) + (length(t) - length(replace(t, 'â€', ''))) / 2 + (length(t) - length(replace(t, 'ðŸ', ''))) / 2 + (length(t) - length(replace(t, '�', '')))) / length(t) > 0.02
  UNION ALL SELECT doc_id, page, 'table_grid_invalid' FROM t WHERE bad_table UNION ALL SELECT doc_id, page, 'heading_hierarchy_jump' FROM jumps UNION ALL SELECT doc_id, page, 'reading_order_invalid' FROM breaks),
issues AS (SELECT 'quality-issue-' || substr(sha256(code || '|' || doc_id::VARCHAR || '|' || page::VARCHAR), 1, 24) AS issue_id, doc_id, page, code, severity, domain, fallback FROM issues0 JOIN {_RULES_SQL} USING (code))"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other table is sound, some blocks are out of order, and some documents lack their last page."""
    own, p = elements(spark, sf_dir), F.col("pos")
    table_ = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.replace("content", F.lit("|"), F.lit("/")), F.lit(" | x |"))
    made = own.withColumns({"content": F.when((F.col("type") == "TABLE") & (p % 2 == 1), table_).otherwise(F.col("content")), "block": F.when(p % 31 == 17, p - 2).otherwise(p)})
    last = own.groupBy("doc_id").agg(F.max("page").alias("last")).withColumn("last", F.col("last") + (F.col("doc_id") % 10 == 0).cast("int"))
    return E.page_issues(made, last.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page")), "block")


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(
    f"""WITH {ELEMENTS_SQL}, d AS (SELECT doc_id, max(page) AS pages, max(page) + (doc_id % 9 = 4)::INT AS mp, sum(length(content) - length(replace(content, 'q', ''))) % 5 = 1 AS broken, count(*) AS n, count(*) FILTER (WHERE pos % 40 <> 3) AS boxed FROM elements WHERE doc_id % 17 <> 5 GROUP BY doc_id
      UNION ALL SELECT doc_id, 1, 1, false, 0, 0 FROM documents WHERE doc_id % 17 = 5),
    a AS (SELECT item_id, item_id % 3 AS c, item_id % 2 AS r, item_id % 4 AS f, item_id % 3 AS u FROM benchmark),
    i AS (SELECT doc_id, '' AS asset, 'markdown_encoding_error' AS code FROM d WHERE broken UNION ALL SELECT doc_id, '', 'page_count_mismatch' FROM d WHERE pages <> mp UNION ALL SELECT doc_id, '', 'pages_without_mapped_elements' FROM d WHERE n = 0 OR mp > pages
      UNION ALL SELECT doc_id, '', 'insufficient_bbox_coverage' FROM d WHERE n = 0 OR boxed / n < 0.98 UNION ALL SELECT doc_id, '', 'no_mapped_elements' FROM d WHERE n = 0
      UNION ALL SELECT item_id, item_id::VARCHAR, CASE WHEN r = 0 THEN 'repeated_brand_logo' ELSE 'repeated_decorative_asset' END FROM a WHERE c = 0 AND f > 1 UNION ALL SELECT item_id, item_id::VARCHAR, 'unreferenced_extracted_assets' FROM a WHERE f > u)
    SELECT 'quality-issue-' || substr(sha256(code || '|' || doc_id::VARCHAR || '|' || asset), 1, 24) AS issue_id, doc_id, code, severity, domain, fallback FROM i JOIN {_RULES_SQL} USING (code)"""
)
def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, i, d = elements(spark, sf_dir).where("doc_id % 17 <> 5"), F.col("item_id"), F.col("doc_id")
    q = F.length("content") - F.length(F.replace("content", F.lit("q"), F.lit("")))
    docs = own.groupBy("doc_id").agg(F.max("page").alias("pages"), (F.sum(q) % 5 == 1).cast("int").alias("broken")).withColumn("manifest_pages", F.col("pages") + (d % 9 == 4).cast("int"))
    bare = table(spark, sf_dir, "documents").where("doc_id % 17 = 5").select("doc_id", F.lit(1).alias("pages"), F.lit(0).alias("broken"), F.lit(1).alias("manifest_pages"))
    assets = table(spark, sf_dir, "benchmark").select(
        i.alias("doc_id"), i.alias("asset_id"), F.when(i % 3 == 0, "DECORATIVE").otherwise("INFORMATIVE").alias("classification"), F.when(i % 2 == 0, "BRAND_LOGO").otherwise("FIGURE").alias("role"), (i % 4).alias("files"), (i % 3).alias("referenced")
    )
    return E.document_issues(docs.unionByName(bare), own.withColumn("boxed", F.col("pos") % 40 != 3), assets).drop("page")


@query(
    f"""WITH {_ISSUES} SELECT doc_id, count(issue_id) AS issues, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, count(*) FILTER (WHERE fallback) AS fallbacks, CASE WHEN count(*) FILTER (WHERE fallback) > 0 THEN 'FALLBACK_REQUIRED' ELSE 'PASS' END AS disposition FROM documents LEFT JOIN issues USING (doc_id) GROUP BY doc_id"""
)
def quality_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(table(spark, sf_dir, "documents"), _issues(spark, sf_dir))


_STEPS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {n} AS step, '{s}' AS action, {a} AS attempts, {f"'{e}'" if e else 'NULL'} AS engine, '{c}' AS condition" for k, plan in E.PLANS.items() for n, (s, a, e, c) in enumerate(plan, 1))
_ROUTES = f"""{_ISSUES}, scoped AS (SELECT DISTINCT s.doc_id, 'page-' || lpad(s.page::VARCHAR, 5, '0') AS scope_id, s.page, sha256(text) AS sha FROM scopes s JOIN documents USING (doc_id)),
by_kind AS (SELECT doc_id, 'page-' || lpad(page::VARCHAR, 5, '0') AS scope_id, 'TEXT_TABLE' AS kind, array_to_string(list_sort(list(DISTINCT code)), ',') AS reasons FROM issues GROUP BY doc_id, page),
visual AS (SELECT doc_id, 'page-' || lpad(page::VARCHAR, 5, '0') AS scope_id, CASE WHEN pos % 2 = 0 THEN 'VISUAL_NARRATIVE' ELSE 'VISUAL_QWEN' END AS kind, CASE WHEN pos % 2 = 0 THEN 'visual_narrative_coverage_sufficient' ELSE 'visual_narrative_coverage_insufficient' END AS reasons FROM elements WHERE type = 'IMAGE'),
asked AS (SELECT * FROM by_kind UNION ALL SELECT * FROM visual), every AS (SELECT * FROM asked UNION ALL SELECT doc_id, scope_id, 'PASS', '' FROM scoped ANTI JOIN asked USING (doc_id, scope_id)),
routes AS (SELECT 'fallback-route-' || substr(sha256(sha || '|' || scope_id || '|' || kind || '|' || reasons), 1, 24) AS route_id, doc_id, scope_id, page, kind, reasons, kind NOT IN ('PASS', 'VISUAL_NARRATIVE') AS fallback, kind IN ('GRAPH_TOPOLOGY', 'VISUAL_QWEN') AS external, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS LAST, scope_id, kind, reasons) AS ordinal FROM every JOIN scoped USING (doc_id, scope_id)),
steps AS (SELECT * FROM routes JOIN ({_STEPS}) USING (kind))"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other visual counts as told by its text."""
    own, scope = elements(spark, sf_dir), F.format_string("page-%05d", "page")
    last = own.groupBy("doc_id").agg(F.max("page").alias("last")).withColumn("last", F.col("last") + (F.col("doc_id") % 10 == 0).cast("int"))
    scopes = last.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page")).join(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_sha256")), "doc_id")
    visuals = own.where("type = 'IMAGE'").select("doc_id", scope.alias("scope_id"), (F.col("pos") % 2 == 0).alias("sufficient"))
    return E.route_steps(E.scope_routes(_issues(spark, sf_dir).withColumn("scope_id", scope), visuals, scopes.withColumn("scope_id", scope)))


@query(f"WITH {_ROUTES} SELECT route_id, doc_id, scope_id, page, kind, reasons, fallback, external, ordinal, step, action, attempts, engine, condition FROM steps")
def fallback_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("route_id", "doc_id", "scope_id", "page", "kind", "reasons", "fallback", "external", "ordinal", "step", "action", "attempts", "engine", "condition")


@query(f"WITH {_ROUTES} SELECT action, count(*) AS steps, count(DISTINCT doc_id) AS documents FROM steps GROUP BY action")
def route_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).groupBy("action").agg(F.count("*").alias("steps"), F.count_distinct("doc_id").alias("documents"))


@query(
    f"""WITH {_ROUTES}, e AS (SELECT doc_id, arg_min(engine, (ordinal, step)) FILTER (WHERE engine IS NOT NULL AND engine <> CASE doc_id % 3 WHEN 0 THEN 'OPENDATALOADER_HYBRID' WHEN 1 THEN 'QWEN3_VL' ELSE 'OPENDATALOADER_LOCAL' END) AS engine FROM steps WHERE fallback GROUP BY doc_id) SELECT doc_id, coalesce(engine, 'MANUAL') AS engine FROM e"""
)
def fallback_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    chains = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 3 == 0, "OPENDATALOADER_HYBRID").when(d % 3 == 1, "QWEN3_VL").otherwise("OPENDATALOADER_LOCAL").alias("last_engine"))
    return E.fallback_engine(_routes(spark, sf_dir), chains)


@query(
    f"""WITH {ELEMENTS_SQL}, i AS (SELECT 'i' || doc_id::VARCHAR || '-' || pos::VARCHAR AS issue_id, doc_id, CASE WHEN pos % 3 = 0 THEN [page] ELSE []::INT[] END AS pages, CASE WHEN pos % 3 = 1 THEN [pos] ELSE []::INT[] END AS els FROM elements),
    s AS (SELECT 's' || lpad(page::VARCHAR, 4, '0') AS scope_id, doc_id, [page] AS pages, list_sort(list(pos)) AS els FROM elements GROUP BY doc_id, page)
    SELECT issue_id, min(scope_id) AS scope_id FROM i LEFT JOIN s ON i.doc_id = s.doc_id AND (list_has_any(i.pages, s.pages) OR list_has_any(i.els, s.els) OR (len(i.pages) = 0 AND len(i.els) = 0)) GROUP BY issue_id"""
)
def issue_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    none = F.array().cast("array<int>")
    i = own.select(F.concat(F.lit("i"), "doc_id", F.lit("-"), "pos").alias("issue_id"), "doc_id", F.when(F.col("pos") % 3 == 0, F.array("page")).otherwise(none).alias("pages"), F.when(F.col("pos") % 3 == 1, F.array("pos")).otherwise(none).alias("elements"))
    s = own.groupBy("doc_id", "page").agg(F.collect_list("pos").alias("elements")).select(F.format_string("s%04d", "page").alias("scope_id"), "doc_id", F.array("page").alias("pages"), "elements")
    return E.issue_scopes(i, s)


@query(f"WITH {ELEMENTS_SQL}, k AS (SELECT doc_id, pos, type, lower({_compact('content')}) AS folded, row_number() OVER (PARTITION BY doc_id, lower({_compact('content')}) ORDER BY pos) AS nth FROM elements) SELECT doc_id, pos, type, folded FROM k WHERE nth = 1")
def first_seen_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir).select("doc_id", "pos", "type", F.lower(text.compact(F.col("content"))).alias("folded"))
    return E.keep_first(own, ["doc_id", "folded"], ["pos"])


_WORDS_SQL = " + ".join(f"contains(lower(t), '{w}')::INT" for w in E.PROCESS_WORDS)


@query(
    f"""WITH {ELEMENTS_SQL}, e AS (SELECT doc_id, pos, CASE WHEN type = 'IMAGE' AND doc_id % 4 = 0 THEN NULL ELSE page END AS page, pos // 12 AS section, CASE WHEN pos % 10 = 6 THEN 'CAPTION' ELSE type END AS type, CASE WHEN pos % 4 = 1 THEN content || ' Quy trình: bước một, nếu ĐẠT' ELSE content END AS content, CASE WHEN pos % 22 = 8 THEN ' Sufficient' WHEN pos % 33 = 19 THEN 'thiếu' ELSE '' END AS told FROM elements),
    v AS (SELECT doc_id, page, section, pos AS vpos, lower(trim(told)) AS told FROM e WHERE type = 'IMAGE'), n AS (SELECT v.doc_id, vpos, any_value(v.told) AS told, coalesce(string_agg(regexp_replace(e.content, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY e.pos) FILTER (WHERE regexp_replace(e.content, '^\\s+|\\s+$', '', 'g') <> ''), '') AS t
      FROM v LEFT JOIN e ON e.doc_id = v.doc_id AND (v.page = e.page OR (v.page IS NULL AND v.section = e.section)) AND e.type IN ('PARAGRAPH', 'CAPTION', 'LIST', 'HEADING') AND abs(e.pos - vpos) <= 4 GROUP BY v.doc_id, vpos),
    c AS (SELECT doc_id, vpos AS pos, told IN ('sufficient', 'thiếu') AS o, told, length(t)::INT AS n, ({_WORDS_SQL})::INT AS k FROM n), s AS (SELECT *, 0.6::DOUBLE * least(n / 60, 1.0::DOUBLE) + 0.4::DOUBLE * least(k / 3, 1.0::DOUBLE) AS s FROM c)
    SELECT doc_id, pos, CASE WHEN o THEN 0 ELSE n END AS characters, CASE WHEN o THEN 0 ELSE k END AS keywords, CASE WHEN o THEN (told = 'sufficient')::INT::DOUBLE ELSE round(s, 6) END AS coverage, CASE WHEN o THEN told = 'sufficient' ELSE n >= 60 AND s >= 0.65 END AS sufficient, o AS overridden FROM s"""
)
def narrative_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visuals of every fourth document have no page, some texts tell of a process, some visuals are marked."""
    p, content = F.col("pos"), F.col("content")
    own = elements(spark, sf_dir).select(
        "doc_id", "pos", F.when(~((F.col("type") == "IMAGE") & (F.col("doc_id") % 4 == 0)), F.col("page")).alias("page"), F.floor(p / 12).alias("section"), F.when(p % 10 == 6, "CAPTION").otherwise(F.col("type")).alias("type"),
        F.when(p % 4 == 1, F.concat(content, F.lit(" Quy trình: bước một, nếu ĐẠT"))).otherwise(content).alias("content"), F.when(p % 22 == 8, " Sufficient").when(p % 33 == 19, "thiếu").otherwise("").alias("told"),
    )
    return E.narrative(own)


_TOKEN_SQL = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"


@query(f"WITH {ELEMENTS_SQL} SELECT doc_id, type, count(*) AS elements, sum(len(regexp_extract_all(content, '{_TOKEN_SQL}')))::BIGINT AS tokens, sum(length(content))::BIGINT AS characters, count(DISTINCT page) AS pages FROM elements GROUP BY doc_id, type")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    return own.groupBy("doc_id", "type").agg(F.count("*").alias("elements"), F.sum(text.token_count(F.col("content"))).alias("tokens"), F.sum(F.length("content")).cast("long").alias("characters"), F.count_distinct("page").alias("pages"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    pathed = E.with_heading_paths(own).where(F.trim("content") != "")
    return chunking.group(chunking.segments(pathed))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_sha256"), F.concat(F.lit("doc-"), "doc_id").alias("family_id"))
    return chunking.segment_ids(_grouped(spark, sf_dir).join(sources, "doc_id"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-bounded ranges and the ordered grouping; a test compares both with plain loops."""
    return chunking.chunks(_identified(spark, sf_dir)).select("doc_id", "chunk", "parts", "tokens", "first_pos", "last_pos", "content_hash", "chunk_id")


@query()
def chunk_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.report(chunking.chunks(_identified(spark, sf_dir)))


@query()
def chunk_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.citations(_grouped(spark, sf_dir), elements(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {ELEMENTS_SQL}, n AS (SELECT doc_id, pos, type IN ('TABLE', 'LIST', 'FLOWCHART') AS alone, type IN ('HEADING', 'TITLE') AS head, len(regexp_extract_all(content, '{_TOKEN_SQL}'))::INT AS tokens FROM elements),
    r AS (SELECT doc_id, pos, 1 AS chunk, tokens AS size, alone OR tokens > 60 AS closed FROM n WHERE pos = 0
      UNION ALL SELECT n.doc_id, n.pos, r.chunk + (closed OR alone OR head OR size + tokens > 60)::INT, CASE WHEN closed OR alone OR head OR size + tokens > 60 THEN tokens ELSE size + tokens END, alone OR tokens > 60 FROM r JOIN n ON n.doc_id = r.doc_id AND n.pos = r.pos + 1)
    SELECT doc_id, pos, chunk FROM r"""
)
def semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered grouping alone, at a small target, without paths."""
    own = elements(spark, sf_dir).select("doc_id", "pos", F.lit(0).alias("part"), "type", F.array().cast("array<string>").alias("path"), text.token_count(F.col("content")).alias("tokens"))
    return chunking.group(own, 60).select("doc_id", "pos", "chunk")


@query(f"WITH {ELEMENTS_SQL}, p AS (SELECT doc_id, pos, unnest(range(0, 3)) AS part, length(content)::INT AS size FROM elements), q AS (SELECT doc_id, pos, part, size, CASE WHEN pos % 5 = 1 AND part = 1 THEN size // 3 + 1 ELSE part * size // 3 END AS s, CASE WHEN pos % 7 = 2 AND part = 2 THEN size - 1 ELSE (part + 1) * size // 3 END AS e FROM p), w AS (SELECT *, coalesce(lag(e) OVER v, 0) AS before, lead(s) OVER v AS after FROM q WINDOW v AS (PARTITION BY doc_id, pos ORDER BY part)) SELECT doc_id, pos, part FROM w WHERE s <> before OR (after IS NULL AND e <> size)")
def range_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = elements(spark, sf_dir).select("doc_id", "pos", F.length("content").alias("size"), F.explode(F.expr("sequence(0L, 2L)")).alias("part"))
    third = lambda n: F.floor(n * F.col("size") / 3)
    start = F.when((F.col("pos") % 5 == 1) & (F.col("part") == 1), F.floor(F.col("size") / 3) + 1).otherwise(third(F.col("part")))
    end = F.when((F.col("pos") % 7 == 2) & (F.col("part") == 2), F.col("size") - 1).otherwise(third(F.col("part") + 1))
    return chunking.range_gaps(p.withColumns({"start": start, "end": end}))


@query(f"WITH {LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) SELECT doc_id, pos FROM n WHERE n <= 4 OR list_contains([0, round_even((n - 1) / 3, 0)::INT, round_even(2 * (n - 1) / 3, 0)::INT, n - 1], k)")
def spaced_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.spaced_sample(lines(spark, sf_dir), 4).select("doc_id", "pos")


@query(f"WITH {LINES_SQL}, a AS (SELECT doc_id, min(pos) AS first FROM lines WHERE regexp_matches(content, '^The') GROUP BY doc_id), b AS (SELECT doc_id, first, min(pos) AS last FROM lines JOIN a USING (doc_id) WHERE pos > first AND regexp_matches(content, '^An') GROUP BY ALL) SELECT doc_id, first, last, count(*) AS lines FROM lines JOIN b USING (doc_id) WHERE pos BETWEEN first AND last GROUP BY ALL")
def marker_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.between_markers(lines(spark, sf_dir), "^The", "^An")
