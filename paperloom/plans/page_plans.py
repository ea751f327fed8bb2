"""Recognised pages, question pages, merging and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import geometry, text
from paperloom.operators import math_pages as M
from paperloom.operators import checks, merging, ocr
from paperloom.operators import elements as E
from paperloom.plans.registry import query
from paperloom.sources.files import walk_tree
from paperloom.sources.tables import DETECTIONS_SQL, ELEMENTS_SQL, LINES_SQL, STORED, detections, elements, lines, table

_CLEAN = f"{DETECTIONS_SQL}, clean AS (SELECT page, det_id, text, least(1.0, greatest(0.0, confidence)) AS confidence, x0, y0, x1, y1 FROM detections WHERE confidence >= 0.18 AND x1 > x0 AND y1 > y0)"


def _clean(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    return ocr.clean(detections(spark, sf_dir, stored), ties=STORED if stored else ())


@query(f"WITH {_CLEAN} SELECT page, det_id, text, confidence, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY y0, x0, det_id) AS nth FROM clean")
def clean_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes alike in place and id come as they are stored."""
    return _clean(spark, sf_dir, stored=True).select("page", "det_id", "text", "confidence", "x0", "y0", "x1", "y1", "nth")


@query(f"WITH {_CLEAN}, m AS (SELECT DISTINCT page, y0 AS mark FROM clean), s AS (SELECT *, (mark - lag(mark) OVER w > 3)::INT AS new FROM m WINDOW w AS (PARTITION BY page ORDER BY mark)), r AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY page ORDER BY mark) AS run FROM s) SELECT page, round_even(median(mark), 0)::INT AS centre, count(*) AS members FROM r GROUP BY page, run")
def projection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.projection_groups(_clean(spark, sf_dir).select("page", F.col("y0").alias("mark")))


#: Two grids a page; lines that touch make edge ties.
_GRIDS = "grids AS (SELECT page, g AS grid_id, [g * 400, g * 400 + 100, g * 400 + 200, g * 400 + 300] AS xs, [page % 40 * 5 + g * 300, page % 40 * 5 + g * 300 + 50, page % 40 * 5 + g * 300 + 120] AS ys FROM (SELECT DISTINCT page FROM clean), (SELECT unnest([0, 1]) AS g))"


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = F.col("grid_id"), F.col("page")
    pages = _clean(spark, sf_dir).select("page").distinct().withColumn("grid_id", F.explode(F.array(F.lit(0), F.lit(1))))
    return pages.select("page", "grid_id", F.array(*[g * 400 + k for k in (0, 100, 200, 300)]).alias("xs"), F.array(*[p % 40 * 5 + g * 300 + k for k in (0, 50, 120)]).alias("ys"))


_CELLS = f"""{_CLEAN}, {_GRIDS}, spots AS (SELECT c.*, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM clean c),
cells AS (SELECT spots.page, grid_id, det_id, list_min(list_filter([0, 1], lambda k: cy BETWEEN ys[k + 1] AND ys[k + 2])) AS row, list_min(list_filter([0, 1, 2], lambda k: cx BETWEEN xs[k + 1] AND xs[k + 2])) AS col FROM spots JOIN grids USING (page) WHERE cx BETWEEN xs[1] - 2 AND xs[4] + 2 AND cy BETWEEN ys[1] - 2 AND ys[3] + 2)"""


@query(f"WITH {_CELLS} SELECT * FROM cells WHERE row IS NOT NULL AND col IS NOT NULL")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.grid_cells(_clean(spark, sf_dir), _grids(spark, sf_dir))


@query(
    f"""WITH {_CELLS}, t AS (SELECT c.page, grid_id, row, col, string_agg(d.text, '<br>' ORDER BY y0, x0, d.det_id) AS t FROM cells c JOIN clean d USING (page, det_id) WHERE row IS NOT NULL AND col IS NOT NULL GROUP BY ALL),
    slots AS (SELECT page, grid_id, row, col FROM (SELECT DISTINCT page, grid_id FROM t), (SELECT unnest([0, 1]) AS row), (SELECT unnest([0, 1, 2]) AS col)),
    r AS (SELECT page, grid_id, row, '| ' || string_agg(coalesce(t, ''), ' | ' ORDER BY col) || ' |' AS l FROM slots LEFT JOIN t USING (page, grid_id, row, col) GROUP BY page, grid_id, row)
    SELECT page, grid_id, string_agg(CASE WHEN row = 0 THEN l || chr(10) || '| --- | --- | --- |' ELSE l END, chr(10) ORDER BY row) AS markdown FROM r GROUP BY page, grid_id"""
)
def grid_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, grids = _clean(spark, sf_dir), _grids(spark, sf_dir)
    return ocr.grid_markdown(ocr.grid_cells(own, grids), _clean(spark, sf_dir, stored=True), grids, STORED)


@query(f"WITH {_CELLS} SELECT page, det_id, text FROM spots WHERE NOT EXISTS (SELECT 1 FROM grids WHERE grids.page = spots.page AND cx BETWEEN xs[1] - 2 AND xs[4] + 2 AND cy BETWEEN ys[1] - 2 AND ys[3] + 2)")
def outside_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.outside_grids(_clean(spark, sf_dir), _grids(spark, sf_dir)).select("page", "det_id", "text")


@query()
def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row clustering depends on what was clustered before; a test compares it with a plain loop."""
    return ocr.cluster_rows(_clean(spark, sf_dir)).withColumns({"confidence": F.round("confidence", 6)})


@query()
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.paragraphs(ocr.row_markdown(ocr.cluster_rows(_clean(spark, sf_dir)), 1100))


@query(f"WITH {_CLEAN} SELECT page, count(*) AS boxes, round(avg(confidence), 6) AS mean, round(sum(confidence * length(text)) / sum(length(text)), 6) AS weighted, round(avg(confidence), 6) < 0.46 AS low FROM clean GROUP BY page")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.page_confidence(_clean(spark, sf_dir))


@query(f"WITH {_CLEAN}, f AS (SELECT DISTINCT page, CASE WHEN det_id % 3 = 0 THEN lower(text) ELSE 'footer ' || (det_id % 5)::VARCHAR END AS line FROM clean WHERE y1 <= 1500 * 0.11 OR y0 >= 1500 * 0.89), p AS (SELECT count(DISTINCT page) AS pages FROM clean) SELECT line, count(*) AS on_pages FROM f, p WHERE length(line) BETWEEN 3 AND 160 GROUP BY line, pages HAVING pages >= 4 AND count(*) >= greatest(3, round_even(0.6 * pages, 0))")
def margin_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("det_id")
    return E.margin_boilerplate(_clean(spark, sf_dir).withColumn("text", F.when(d % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Footer "), d % 5))), 1500)


@query(f"WITH {ELEMENTS_SQL}, p AS (SELECT doc_id, page, sum(len(regexp_extract_all(content, '[A-Za-z0-9]'))) AS alnum, (page * 37 % 100) / 100 AS r FROM (SELECT * REPLACE (CASE WHEN (doc_id + page) % 3 = 0 THEN 'x' ELSE content END AS content) FROM elements) GROUP BY doc_id, page), d AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE alnum >= 40) AS text_pages, count(*) FILTER (WHERE alnum < 40 AND r >= 0.6) AS image_pages FROM p GROUP BY doc_id) SELECT *, image_pages = pages OR (image_pages >= 2 AND image_pages / pages >= 0.2) AS requires_ocr FROM d")
def scan_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = elements(spark, sf_dir).withColumn("content", F.when((F.col("doc_id") + F.col("page")) % 3 == 0, "x").otherwise(F.col("content")))
    own = seen.groupBy("doc_id", "page").agg(F.sum(F.regexp_count("content", F.lit("[A-Za-z0-9]"))).alias("alnum"))
    return ocr.scan_kind(own.withColumn("image_ratio", F.pmod(F.col("page") * 37, F.lit(100)) / 100))


@query(f"WITH {DETECTIONS_SQL} SELECT page, det_id, (x0 >= 0 AND y0 >= 0 AND x1 > x0 AND y1 > y0) AS valid, round(greatest(0, least(y1, 900) - greatest(y0, 600)) / greatest(1, least(y1 - y0, 300)), 6)::DOUBLE AS overlap, (least(61, 24 + round_even(37 * page / 40, 0)))::INT AS percent FROM detections")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return detections(spark, sf_dir).select("page", "det_id", geometry.valid_box(c("x0"), c("y0"), c("x1"), c("y1")).alias("valid"), F.round(geometry.vertical_overlap(c("y0"), c("y1"), F.lit(600), F.lit(900)), 6).alias("overlap"), geometry.progress(c("page"), F.lit(40)).alias("percent"))


def _math_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lines with questions and options strewn in."""
    own = lines(spark, sf_dir)
    p = F.col("pos")
    line = F.when(p % 6 == 1, F.concat(F.lit("Câu "), (F.floor(p / 6) + 1).cast("string"))).when(p % 6 == 2, F.concat(F.lit("A. "), "content")).when(p % 6 == 3, F.concat(F.lit("B. "), "content")).when(p % 6 == 4, F.concat(F.when(F.col("doc_id") % 5 == 0, "B. ").otherwise("C. "), "content")).when(p % 12 == 5, F.lit("1 2 3 det A")).otherwise(F.col("content"))
    rows = own.select("doc_id", F.floor(p / 8).cast("int").alias("page"), "pos", line.alias("t"))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n").alias("markdown"))


_MATH = f"""{LINES_SQL}, strewn AS (SELECT doc_id, (pos // 8)::INT AS page, pos, CASE WHEN pos % 6 = 1 THEN 'Câu ' || (pos // 6 + 1)::VARCHAR WHEN pos % 6 = 2 THEN 'A. ' || content WHEN pos % 6 = 3 THEN 'B. ' || content WHEN pos % 6 = 4 THEN CASE WHEN doc_id % 5 = 0 THEN 'B. ' ELSE 'C. ' END || content WHEN pos % 12 = 5 THEN '1 2 3 det A' ELSE content END AS t FROM lines),
math AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY pos) AS markdown FROM strewn GROUP BY doc_id, page)"""


@query()
def math_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with look-around; a test compares the features with Python's regular expressions."""
    return M.risk(_math_pages(spark, sf_dir))


@query(f"WITH {_MATH} SELECT doc_id, page, len(regexp_extract_all(markdown, '(?mi)^\\s*(?:#{{1,6}}\\s*)?(?:\\*{{0,2}})?Câu\\s+(\\d+)\\b', 1))::INT AS questions, len(regexp_extract_all(markdown, '(?mi)^\\s*(?:[-*+]\\s*)?(?:\\*{{0,2}})?([A-D])[.)]\\*{{0,2}}\\s+', 1))::INT AS options FROM math")
def question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _math_pages(spark, sf_dir)
    return own.select("doc_id", "page", F.size(M.occurrences(F.col("markdown"), M.QUESTION)).alias("questions"), F.size(M.occurrences(F.col("markdown"), M.OPTION)).alias("options"))


@query()
def math_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.errors(_math_pages(spark, sf_dir))


@query()
def math_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _math_pages(spark, sf_dir).select("doc_id", "page", F.md5(M.normalized(F.col("markdown"))).alias("md5"))


@query(f"WITH {ELEMENTS_SQL}, s AS (SELECT doc_id, page, (doc_id * 7 + page * 13) % 11 AS score FROM elements GROUP BY doc_id, page) SELECT doc_id, page, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page) <= 3")
def riskiest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir).select("doc_id", "page").distinct().withColumn("score", (F.col("doc_id") * 7 + F.col("page") * 13) % 11)
    return M.top_pages(own, 3)


#: Each line three times, so that lines and blocks run away.
@query(
    """WITH l AS (SELECT conv_id AS doc_id, 1 AS page, lower(trim(regexp_replace(x.line, '\\s+', ' ', 'g'))) AS line, x.k AS pos FROM (SELECT conv_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM (SELECT conv_id, string_agg(repeat(text || chr(10), 1 + (turn % 4)::INT), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)) x),
    c AS (SELECT * FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(?:\\$\\$|---+|<!--.*-->|\\|[\\s|:\\-]+\\|)$')), t AS (SELECT doc_id, page, [line, lead(line, 1) OVER w, lead(line, 2) OVER w] AS b FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT DISTINCT doc_id, page, 'runaway_repeated_line' AS code FROM c WHERE length(line) >= 24 GROUP BY doc_id, page, line HAVING count(*) >= 4 UNION ALL SELECT DISTINCT doc_id, page, 'runaway_repeated_block' FROM t WHERE b[3] IS NOT NULL AND length(b[1]) + length(b[2]) + length(b[3]) >= 120 GROUP BY doc_id, page, b HAVING count(*) >= 3"""
)
def runaway_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.expr("repeat(concat(text, '\n'), cast(1 + turn % 4 as int))").alias("t")))).alias("ts"))
    return M.runaway(turns.select("doc_id", F.lit(1).alias("page"), F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("markdown")))


@query(
    """WITH s AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[a-z0-9]+')) AS token FROM documents), sc AS (SELECT doc_id, token, count(*) AS n FROM s GROUP BY ALL),
    o AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(replace(lower(replace(replace(text, ' the ', ' '), ' de ', ' ')), 'ß', 'ss')), '[a-z0-9]+')) AS token FROM documents), oc AS (SELECT doc_id, token, count(*) AS n FROM o GROUP BY ALL)
    SELECT doc_id, sum(coalesce(sc.n, 0))::BIGINT AS source_tokens, sum(coalesce(oc.n, 0))::BIGINT AS output_tokens, round(sum(least(coalesce(sc.n, 0), coalesce(oc.n, 0))) / greatest(1, sum(coalesce(sc.n, 0))), 6) AS recall FROM sc FULL JOIN oc USING (doc_id, token) GROUP BY doc_id"""
)
def bag_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.bag_recall(docs, docs.withColumn("text", F.expr("replace(replace(text, ' the ', ' '), ' de ', ' ')")))


_PAGES = f"{ELEMENTS_SQL}, pages0 AS (SELECT doc_id, page, string_agg(content, chr(10) ORDER BY pos) AS markdown FROM elements GROUP BY doc_id, page)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    return own.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("markdown"))


@query(f"WITH {_PAGES} SELECT doc_id, page, md5(CASE WHEN (doc_id + page) % 3 = 0 THEN 'x' || markdown ELSE markdown END) AS md5, (doc_id + page) % 3 = 0 AS replaced FROM pages0")
def replaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages(spark, sf_dir)
    fresh = own.where((F.col("doc_id") + F.col("page")) % 3 == 0).withColumn("markdown", F.concat(F.lit("x"), "markdown"))
    return merging.replace_pages(own, fresh).select("doc_id", "page", F.md5("markdown").alias("md5"), "replaced")


@query(f"WITH {_PAGES} SELECT doc_id, md5(string_agg('<!-- page: ' || page::VARCHAR || ' -->' || chr(10) || chr(10) || regexp_replace(markdown, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page) || chr(10)) AS md5 FROM pages0 GROUP BY doc_id")
def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.joined_pages(_pages(spark, sf_dir)).select("doc_id", F.md5("markdown").alias("md5"))


@query(
    f"""WITH {ELEMENTS_SQL}, f AS (SELECT doc_id, page, pos + 1000 AS pos, 'new ' || pos::VARCHAR AS content FROM elements WHERE page % 4 = 2), u AS (SELECT doc_id, page, pos, content, false AS fresh FROM elements WHERE page % 4 <> 2 UNION ALL SELECT *, true FROM f)
    SELECT doc_id, page, content, fresh, (row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1)::INT AS new_pos FROM u"""
)
def replaced_page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    fresh = own.where("page % 4 = 2").select("doc_id", "page", (F.col("pos") + 1000).alias("pos"), F.concat(F.lit("new "), "pos").alias("content"))
    return merging.replace_page_elements(own, fresh)


@query(
    """WITH a AS (SELECT item_id AS asset_id, md5(text) AS ha, ['a/' || item_id::VARCHAR, 's/' || item_id::VARCHAR] AS pa FROM benchmark WHERE item_id % 3 <> 0), b AS (SELECT item_id AS asset_id, CASE WHEN item_id % 7 = 1 THEN 'other' ELSE md5(text) END AS hb, ['s/' || item_id::VARCHAR, 'b/' || item_id::VARCHAR] AS pb FROM benchmark WHERE item_id % 4 <> 0)
    SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, coalesce(ha, hb) AS content_hash, CASE WHEN ha IS NULL THEN array_to_string(pb, ',') WHEN hb IS NULL THEN array_to_string(pa, ',') ELSE array_to_string([pa[1], pa[2], pb[2]], ',') END AS paths, CASE WHEN ha IS NULL THEN 'r1=right' WHEN hb IS NULL THEN 'r0=left,r1=left' ELSE 'r0=left,r1=right' END AS refs, coalesce(ha <> hb, false) AS conflict FROM a FULL JOIN b ON a.asset_id = b.asset_id"""
)
def merged_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    path = lambda p: F.concat(F.lit(f"{p}/"), i)
    left = b.where(i % 3 != 0).select(i.alias("asset_id"), F.md5("text").alias("content_hash"), F.array(path("a"), path("s")).alias("paths"), F.create_map(F.lit("r0"), F.lit("left"), F.lit("r1"), F.lit("left")).alias("refs"))
    right = b.where(i % 4 != 0).select(i.alias("asset_id"), F.when(i % 7 == 1, "other").otherwise(F.md5("text")).alias("content_hash"), F.array(path("s"), path("b")).alias("paths"), F.create_map(F.lit("r1"), F.lit("right")).alias("refs"))
    refs = F.array_join(F.transform(F.array_sort(F.map_entries("refs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return merging.merge_assets(left, right).withColumns({"paths": F.array_join("paths", ","), "refs": refs})


@query(f"WITH {ELEMENTS_SQL}, p AS (SELECT DISTINCT doc_id, page FROM elements WHERE (doc_id + page) % 4 <> 1), r AS (SELECT DISTINCT doc_id, page FROM elements WHERE (doc_id * page) % 5 <> 2) SELECT *, 'missing' AS gap FROM p ANTI JOIN r USING (doc_id, page) UNION ALL SELECT *, 'unplanned' FROM r ANTI JOIN p USING (doc_id, page)")
def run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir).select("doc_id", "page").distinct()
    return merging.run_gaps(own.where((F.col("doc_id") + F.col("page")) % 4 != 1), own.where((F.col("doc_id") * F.col("page")) % 5 != 2))


@query(
    f"""WITH {ELEMENTS_SQL}, t AS (SELECT doc_id, page, pos, (CASE WHEN doc_id % 3 = 0 THEN pos % 5 ELSE pos END + 1)::INT AS key, 'c' || (pos % 5)::VARCHAR || '@' || page::VARCHAR AS cell FROM elements), k AS (SELECT doc_id, key, count(*) AS n, arg_min(cell, (page, pos)) AS cell FROM t GROUP BY ALL)
    SELECT doc_id, string_agg(cell, ' / ' ORDER BY key) AS cells, max(n) = 1 AND list(key ORDER BY key) = [1, 2, 3, 4, 5] AS sound FROM k GROUP BY doc_id"""
)
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pos")
    rows = elements(spark, sf_dir).select("doc_id", "page", "pos", (F.when(F.col("doc_id") % 3 == 0, p % 5).otherwise(p) + 1).alias("key"), F.concat(F.lit("c"), p % 5, F.lit("@"), "page").alias("cell"))
    return merging.merge_split_tables(rows, 5)


#: A graph for each customer: a fifth of the nodes is asked for but missing, some are repeated, entries of other kinds are strewn in.
@query(
    """WITH g AS (SELECT c_custkey AS graph_id, c_custkey % 11 <> 3 AS hn, c_custkey % 13 <> 5 AS he FROM customer),
    n0 AS (SELECT graph_id, unnest(range(0, 6)) AS k FROM g WHERE hn UNION ALL SELECT graph_id, 2 FROM g WHERE hn AND graph_id % 7 = 1), n AS (SELECT graph_id, CASE WHEN graph_id % 17 = 4 AND k = 5 THEN '' WHEN graph_id % 19 = 6 AND k = 4 THEN NULL ELSE 'n' || k::VARCHAR END AS node_id, k % 3 = 0 AS d FROM n0),
    e AS (SELECT o_custkey AS graph_id, CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE 'n' || (o_orderkey % 7)::VARCHAR END AS s, 'n' || (o_orderkey // 7 % 6)::VARCHAR AS t FROM orders JOIN g ON graph_id = o_custkey WHERE he),
    k AS (SELECT DISTINCT graph_id, node_id FROM n WHERE node_id <> ''), j AS (SELECT e.*, a.node_id IS NOT NULL AND b.node_id IS NOT NULL AS ok FROM e LEFT JOIN k a ON a.graph_id = e.graph_id AND a.node_id = s LEFT JOIN k b ON b.graph_id = e.graph_id AND b.node_id = t WHERE s IS NOT NULL), w AS (SELECT graph_id, s, count(*) AS ways FROM j WHERE ok GROUP BY ALL)
    SELECT graph_id, 'nodes_missing_or_empty' AS code, '' AS id FROM g WHERE NOT hn UNION SELECT graph_id, 'edges_missing', '' FROM g WHERE NOT he UNION SELECT graph_id, 'node_not_object', '' FROM n WHERE node_id IS NULL UNION SELECT graph_id, 'node_id_missing', '' FROM n WHERE node_id = ''
    UNION SELECT graph_id, 'edge_not_object', '' FROM e WHERE s IS NULL UNION SELECT graph_id, 'duplicate_node_id', node_id FROM n WHERE node_id <> '' GROUP BY ALL HAVING count(*) > 1 UNION SELECT graph_id, 'edge_endpoint_missing', s || '>' || t FROM j WHERE NOT ok
    UNION SELECT d.graph_id, 'decision_branch_count_invalid', d.node_id FROM (SELECT DISTINCT graph_id, node_id FROM n WHERE d AND node_id <> '') d LEFT JOIN w ON w.graph_id = d.graph_id AND w.s = d.node_id WHERE coalesce(ways, 0) < 2"""
)
def graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads are built as JSON, with either name for an edge's ends, and read again."""
    g, k, o = F.col("graph_id"), F.col("k"), F.col("o_orderkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    custom = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"))
    plain = custom.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).unionByName(custom.where("graph_id % 7 = 1").withColumn("k", F.lit(2)))
    node_id = F.when((g % 17 == 4) & (k == 5), "").otherwise(F.concat(F.lit("n"), k))
    node = F.when((g % 19 == 6) & (k == 4), F.lit('"text"')).otherwise(F.concat(F.lit('{"id":'), quoted(node_id), F.lit(',"type":'), F.when(k % 3 == 0, '"Decision"').otherwise('"step"'), F.lit("}")))
    ends = F.when(o % 2 == 0, F.array(F.lit('{"source":'), F.lit(',"target":'))).otherwise(F.array(F.lit('{"from":'), F.lit(',"to":')))
    start, end = F.concat(F.lit("n"), o % 7), F.concat(F.lit("n"), F.floor(o / 7) % 6)
    edge = F.when(o % 97 == 5, F.lit("7")).otherwise(F.concat(F.get(ends, F.lit(0)), quoted(start), F.get(ends, F.lit(1)), quoted(end), F.lit("}")))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(c)), ","), F.lit("]"))
    nodes = plain.groupBy("graph_id").agg(listed(node).alias("nodes"))
    edges = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("graph_id")).agg(listed(edge).alias("edges"))
    own = custom.join(nodes, "graph_id").join(edges, "graph_id", "left")
    fields = F.array_compact(F.array(F.when(g % 11 != 3, F.concat(F.lit('"nodes":'), "nodes")), F.when(g % 13 != 5, F.concat(F.lit('"edges":'), F.coalesce("edges", F.lit("[]"))))))
    return merging.graph_issues(*merging.graph_parts(own.select("graph_id", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("payload"))))


@query(
    """WITH p AS (SELECT DISTINCT p_partkey % 5000 AS n, p_partkey % 6 AS k FROM part), r AS (SELECT *, repeat('m', (n // 1000)::INT) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS roman,
      CASE WHEN n > 702 THEN chr((97 + (n - 703) // 676)::INT) ELSE '' END || CASE WHEN n > 26 THEN chr((97 + (n - 27) // 26 % 26)::INT) ELSE '' END || chr((97 + (n - 1) % 26)::INT) AS letters FROM p WHERE n > 0 UNION ALL SELECT 0, k, 'i', 'a' FROM (SELECT unnest(range(0, 6)) AS k))
    SELECT n, k, CASE k WHEN 0 THEN upper(letters) || '.' WHEN 1 THEN letters || '.' WHEN 2 THEN '-' WHEN 3 THEN roman || '.' WHEN 4 THEN n::VARCHAR || '.' ELSE '-' END AS marker FROM r"""
)
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    own = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5000).alias("n"), (F.col("p_partkey") % 6).alias("k")).where("n > 0").distinct()
    own = own.unionByName(spark.range(6).select(F.lit(0).cast("long").alias("n"), F.col("id").alias("k")))
    style = F.when(k == 0, "English  letters UPPER case").when(k == 1, "english letters").when(k == 2, "Unordered list").when(k == 3, "roman numbers upper case").when(k == 4, "arabic")
    return own.select("n", "k", text.list_marker(style, n).alias("marker"))


@query(
    """WITH t AS (SELECT p_partkey, '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '|--|--|' ELSE '| --- | :---: |' END || chr(10) || '| ' || p_type || ' | ' || CASE WHEN p_size % 5 = 0 THEN 'x | y' ELSE p_size::VARCHAR END || ' |' AS md, p_size FROM part)
    SELECT p_partkey, p_size % 3 <> 0 AND p_size % 5 <> 0 AS valid, CASE WHEN p_size % 2 = 0 THEN false ELSE p_size % 3 <> 0 AND p_size % 5 <> 0 END AS strict_with_blank, p_size % 3 <> 0 AND p_size % 5 <> 0 AS loose_with_blank, replace(replace(trim(md), '|', '\\|'), chr(10), '<br>') AS escaped FROM t"""
)
def gfm_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    md = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\n"), F.when(n % 3 == 0, "|--|--|").otherwise("| --- | :---: |"), F.lit("\n| "), "p_type", F.lit(" | "), F.when(n % 5 == 0, "x | y").otherwise(n.cast("string")), F.lit(" |"))
    blank = F.when(n % 2 == 0, F.regexp_replace("md", "\n", "\n\n")).otherwise(F.col("md"))
    own = table(spark, sf_dir, "part").withColumn("md", md).withColumn("blank", blank)
    return own.select("p_partkey", text.gfm_table(F.col("md")).alias("valid"), text.gfm_table(F.col("blank")).alias("strict_with_blank"), text.gfm_table(F.col("blank"), loose=True).alias("loose_with_blank"), text.escape_cell(F.col("md")).alias("escaped"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS compacted, regexp_matches(text, '^\\s*(?:[-+*•·]|[0-9]+[.)]|[A-Za-z]{1,5}[.)])[ \\t]+\\S') AS is_list FROM documents")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compact(t)).alias("compacted"), text.markdown_list(t).alias("is_list"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size WHEN p_size % 4 = 1 THEN NULL WHEN p_size % 4 = 2 THEN p_size ELSE p_size END::BIGINT AS level, CASE WHEN p_size % 2 = 0 THEN 'p. ' || p_size::VARCHAR ELSE 'pp. ' || p_size::VARCHAR || ', ' || (p_size + 1)::VARCHAR END AS locator FROM part")
def levels_and_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    level = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, "true").when(n % 4 == 2, F.concat(n.cast("string"), F.lit(".0")))
    raw = F.when(n % 4 == 3, F.concat(F.lit("Heading "), n)).otherwise("none")
    pages = F.when(n % 2 == 0, F.array(n)).otherwise(F.array(n, n + 1))
    return table(spark, sf_dir, "part").select("p_partkey", text.heading_level(level, raw).alias("level"), text.page_locator(pages.cast("array<string>")).alias("locator"))


@query(
    """SELECT conv_id, turn, 0 AS node, -1 AS parent, 'document' AS type, 0 AS page, '' AS content FROM conversations UNION ALL SELECT conv_id, turn, 1, 0, 'heading', (turn + 1)::INT, role FROM conversations UNION ALL SELECT conv_id, turn, 2, 0, 'paragraph', (turn + 1)::INT, text FROM conversations"""
)
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor trees whose keys differ in case, blanks and dashes."""
    own = table(spark, sf_dir, "conversations")
    page = F.col("turn") + 1
    head = F.struct(F.lit("heading").alias("Type"), page.alias("page number"), F.col("role").alias("content"))
    body = F.struct(F.lit("Paragraph").alias("type"), page.cast("string").alias("Page-Number"), F.col("text").alias("CONTENT"))
    tree = F.concat(F.lit('{"type":"document","kids":['), F.to_json(head), F.lit(","), F.to_json(body), F.lit("]}"))
    nodes = own.select("conv_id", "turn", F.explode(walk_tree(tree)).alias("n"))
    return nodes.select("conv_id", "turn", "n.node", F.coalesce("n.parent", F.lit(-1)).alias("parent"), "n.type", F.coalesce("n.page", F.lit(0)).alias("page"), F.coalesce("n.content", F.lit("")).alias("content"))


#: Documents of the profile's kind: every third says all of its titles, others a part; some lack one mark or two.
_PROFILE = [("h", p) for p in checks.HARD_MARKS] + [("s", p) for p in checks.SOFT_MARKS]


def _profile_text(doc: str, join: str) -> list[tuple[str, str]]:
    return [(x, f"({doc} % 3 = 0 AND ({doc} + {k}) % 14 <> 1) OR {doc} % {k + 2} = 0") for k, x in enumerate(checks.PROFILE_LINES)]


@query(
    f"""WITH t AS (SELECT doc_id, concat_ws(chr(10), text, {", ".join(f"CASE WHEN {w} THEN '{x}' END" for x, w in _profile_text("doc_id", ""))}) AS t FROM documents),
    m AS (SELECT doc_id, {" + ".join(f"regexp_matches(t, '{checks.re2(p)}')::INT" for k, p in _PROFILE if k == "h")} AS hard, {" + ".join(f"regexp_matches(t, '{checks.re2(p)}')::INT" for k, p in _PROFILE if k == "s")} AS soft FROM t)
    SELECT doc_id, hard, soft, round((hard + soft) / 12, 4) AS score, hard = 6 AND soft >= 5 AS matched FROM m"""
)
def fingerprint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = [F.when(F.expr(w), x) for x, w in _profile_text("doc_id", "")]
    return checks.fingerprint(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", *extra).alias("markdown")))
