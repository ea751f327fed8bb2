"""Lineage, invariants and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import checks as C
from paperloom.operators import elements as E
from paperloom.plans.ingest_plans import _DECIDED, decided
from paperloom.plans.registry import query
from paperloom.sources.tables import ELEMENTS_SQL, FILES_SQL, LINES_SQL, elements, files, lines, table


@query(
    f"""WITH {_DECIDED}, d AS (SELECT decision_id, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE family_id END AS f, CASE WHEN doc_id % 7 = 2 THEN 'CONFLICT' ELSE outcome END AS o, matched_version_id AS m, outcome = 'CONFLICT' AS r, candidates AS c, CASE WHEN doc_id % 11 = 3 THEN 1.5 ELSE confidence END AS conf FROM decided)
    SELECT decision_id, 'same_version_needs_references' AS rule FROM d WHERE o = 'SAME_VERSION' AND (f IS NULL OR m IS NULL) UNION ALL SELECT decision_id, 'family_required' FROM d WHERE o IN ('NEW_VERSION', 'UNRELATED') AND f IS NULL
    UNION ALL SELECT decision_id, 'conflict_needs_review' FROM d WHERE o = 'CONFLICT' AND NOT (r AND c <> '') UNION ALL SELECT decision_id, 'confidence_in_range' FROM d WHERE conf NOT BETWEEN 0 AND 1"""
)
def decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    i = F.col("doc_id")
    broken = {"family_id": F.when(i % 6 != 1, F.col("family_id")), "outcome": F.when(i % 7 == 2, "CONFLICT").otherwise(F.col("outcome")), "confidence": F.when(i % 11 == 3, 1.5).otherwise(F.col("confidence"))}
    return C.violations(d.withColumns(broken), "decision_id", C.decision_rules())


@query(
    """WITH s AS (SELECT o_orderkey AS id, o_orderdate AS a, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 HOUR END AS b, (o_custkey % 4)::INT AS n, o_orderstatus AS st, CASE WHEN o_orderkey % 3 = 0 THEN 'q' END AS q FROM orders)
    SELECT id, 'finished_after_start' AS rule FROM s WHERE b < a UNION ALL SELECT id, 'attempts_in_limit' FROM s WHERE n > 2 UNION ALL SELECT id, 'quarantined_has_id' FROM s WHERE st = 'F' AND q IS NULL"""
)
def stage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderdate").alias("started_at"), F.when(k % 5 == 0, F.expr("o_orderdate - INTERVAL 1 DAY")).otherwise(F.expr("o_orderdate + INTERVAL 1 HOUR")).alias("finished_at"), (F.col("o_custkey") % 4).alias("attempts"), F.lit(2).alias("most_attempts"), F.when(F.col("o_orderstatus") == "F", "QUARANTINED").otherwise("DONE").alias("status"), F.when(k % 3 == 0, "q").alias("quarantine_id"))
    return C.violations(s, "id", C.stage_rules())


@query("WITH c AS (SELECT o_orderkey AS run_id, o_custkey * 2 AS input_run, CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE md5((o_custkey * 2)::VARCHAR) END AS s FROM orders), i AS (SELECT c_custkey AS input_run, md5(c_custkey::VARCHAR) AS f FROM customer) SELECT run_id, CASE WHEN f IS NULL THEN 'input_missing' ELSE 'input_changed' END AS problem FROM c LEFT JOIN i USING (input_run) WHERE f IS NULL OR f <> s")
def lineage_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.col("o_custkey") * 2
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), used.alias("input_run"), F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise(F.md5(used.cast("string"))).alias("input_sha256"))
    i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.md5(F.col("c_custkey").cast("string")).alias("manifest_sha256"))
    return C.lineage(c, i)


@query(
    f"""WITH RECURSIVE {FILES_SQL}, f AS (SELECT source_path || '#' || doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 = 1 THEN regexp_replace(source_name, '(\\.[^.]+)$', '-' || (doc_id % 3)::VARCHAR || '\\1') ELSE source_name END AS name, sha256(text) AS sha256 FROM files),
    u AS (SELECT *, regexp_extract(name, '^(.+?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(name, '^(.+?)(\\.[^.]*)?$', 2) AS suffix FROM f QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY path) = 1),
    g AS (SELECT *, regexp_replace(stem, '(-[0-9]+)+$', '') AS root FROM u), n AS (SELECT *, row_number() OVER (PARTITION BY root, suffix ORDER BY path) AS k FROM g),
    r AS (SELECT root, suffix, 0::BIGINT AS k, '' AS path, '' AS sha256, '' AS copy_name, []::VARCHAR[] AS taken FROM (SELECT DISTINCT root, suffix FROM n)
      UNION ALL SELECT root, suffix, k, path, sha256, c, list_append(taken, c) FROM (SELECT n.root, n.suffix, n.k, n.path, n.sha256, r.taken, list_filter(list_prepend(n.name, list_transform(range(1, len(r.taken) + 2), lambda i: n.stem || '-' || i::VARCHAR || n.suffix)), lambda x: NOT list_contains(r.taken, x))[1] AS c FROM r JOIN n ON n.root = r.root AND n.suffix = r.suffix AND n.k = r.k + 1))
    SELECT path, sha256, copy_name FROM r WHERE k > 0"""
)
def asset_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files have a name that others get when theirs is taken."""
    d, n = F.col("doc_id"), F.col("source_name")
    name = F.when(d % 4 == 1, F.concat(F.regexp_replace(n, r"\.[^.]+$", ""), F.lit("-"), d % 3, F.regexp_extract(n, r"(\.[^.]+)$", 1))).otherwise(n)
    return C.free_names(files(spark, sf_dir).select(F.concat("source_path", F.lit("#"), "doc_id").alias("path"), name.alias("name"), F.sha2("text", 256).alias("sha256")))


@query(f"WITH {ELEMENTS_SQL}, s AS (SELECT doc_id, pos, content, 8 + (length(content) * 7 + pos) % 13 AS size, pos % 9 = 4 AS bold FROM elements), m AS (SELECT doc_id, median(size)::DOUBLE AS median FROM s GROUP BY doc_id) SELECT doc_id, pos, size, median FROM s JOIN m USING (doc_id) WHERE length(content) <= 140 AND (size >= median + 1.8 OR bold)")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir).select("doc_id", "pos", "content", (8 + (F.length("content") * 7 + F.col("pos")) % 13).alias("size"), (F.col("pos") % 9 == 4).alias("bold"))
    return C.heading_lines(own)


@query(
    """WITH c AS (SELECT l_orderkey AS table_id, 1 + l_linenumber // 3 AS row, 1 + l_linenumber % 3 AS col, 1 + (l_partkey % 17 = 0)::INT AS rs, 1 + (l_suppkey % 13 = 0)::INT AS cs, 3 AS rows, 3 AS cols FROM lineitem), v AS (SELECT *, row + rs - 1 > rows OR col + cs - 1 > cols AS bad FROM c),
    z AS (SELECT table_id, count(*) FILTER (WHERE rs > 1 OR cs > 1) AS merged, count(*) FILTER (WHERE bad) AS invalid FROM v GROUP BY table_id), s AS (SELECT table_id, r, k, count(*) AS n FROM v, unnest(range(0, rs)) AS a(i), unnest(range(0, cs)) AS b(j), LATERAL (SELECT row + i AS r, col + j AS k) WHERE NOT bad GROUP BY ALL), t AS (SELECT table_id, count(*) AS actual, count(*) FILTER (WHERE n > 1) AS collisions FROM s GROUP BY table_id)
    SELECT table_id, 9 AS declared, coalesce(actual, 0) AS actual, merged, invalid, coalesce(collisions, 0) AS collisions, 9 - coalesce(actual, 0) AS missing, invalid = 0 AND coalesce(collisions, 0) = 0 AND coalesce(actual, 0) = 9 AS sound FROM z LEFT JOIN t USING (table_id)"""
)
def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), (1 + F.floor(n / 3)).cast("int").alias("row"), (1 + n % 3).alias("col"), (1 + (F.col("l_partkey") % 17 == 0).cast("int")).alias("row_span"), (1 + (F.col("l_suppkey") % 13 == 0).cast("int")).alias("col_span"), F.lit(3).alias("rows"), F.lit(3).alias("cols"))
    return C.grid_metrics(c)


@query(f"WITH {ELEMENTS_SQL}, p AS (SELECT doc_id, page, count(*) AS candidates, count(*) FILTER (WHERE pos % 11 <> 6) AS covered, page % 7 <> 3 AS passed FROM elements GROUP BY doc_id, page), i AS (SELECT DISTINCT doc_id, page, true AS bad FROM elements WHERE pos % 13 = 5) SELECT doc_id, page, passed AND covered = candidates AND NOT coalesce(bad, false) AS accepted FROM p LEFT JOIN i USING (doc_id, page)")
def accepted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir)
    p = own.groupBy("doc_id", "page").agg(F.count("*").alias("candidates"), F.count_if(F.col("pos") % 11 != 6).alias("covered")).withColumn("passed", F.col("page") % 7 != 3)
    return C.accepted_pages(p, own.where("pos % 13 = 5").select("doc_id", "page", F.lit("ERROR").alias("severity"), F.lit(False).alias("fallback")))


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey % 50 = 1) SELECT k FROM (SELECT k FROM a EXCEPT SELECT k FROM r) UNION SELECT k FROM h")
def unresolved_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    asked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return C.unresolved(asked, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), o.where("o_custkey % 50 = 1").select(F.col("o_orderkey").alias("k")))


@query(f"WITH {LINES_SQL}, s AS (SELECT *, CASE WHEN regexp_matches(content, '^The') THEN 'group_1' WHEN regexp_matches(content, '^An') THEN 'group_2' WHEN regexp_matches(content, '^Or') THEN 'none' END AS m FROM lines) SELECT doc_id, pos, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'awaiting') AS state FROM s")
def section_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.section_states(lines(spark, sf_dir), {"group_1": "^The", "group_2": "^An", "none": "^Or"}).select("doc_id", "pos", "state")


@query("SELECT item_id, 'f#semantic-' || substr(sha256('{\"chunk\":' || item_id::VARCHAR || ',\"family\":\"đ\",\"path\":[\"a\",\"b\"],\"version\":null}'), 1, 32) AS chunk_id FROM benchmark")
def canonical_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = C.canonical_json({"version": F.lit(None).cast("string"), "family": F.lit("đ"), "chunk": F.col("item_id"), "path": F.array(F.lit("a"), F.lit("b"))})
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("f#semantic-"), F.substring(F.sha2(payload, 256), 1, 32)).alias("chunk_id"))


@query("SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '[*$%&#]{3}') THEN 'junk_marks' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license_line' END], lambda x: x IS NOT NULL)) AS code FROM documents")
def forbidden_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.forbidden(table(spark, sf_dir, "documents"), {"junk_marks": "[*$%&#]{3}", "shouting": "!!", "license_line": "(?i)license"})


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S_%f') || '_' || substr(sha256(event_type || '|' || user_id::VARCHAR), 1, 8) AS stamp FROM events")
def run_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.run_stamp(F.col("ts"), F.col("event_type"), F.col("user_id").cast("string")).alias("stamp"))


@query(f"WITH {LINES_SQL}, s AS (SELECT *, regexp_matches(content, '^The') AS hit, regexp_matches(content, '^An') AS goal FROM lines), c AS (SELECT *, count(*) FILTER (WHERE hit) OVER w AS nh, count(*) FILTER (WHERE goal) OVER w AS ng, max(CASE WHEN goal THEN pos END) OVER w AS g FROM s WINDOW w AS (PARTITION BY doc_id)) SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN nh = 1 AND ng = 1 AND hit AND NOT goal THEN g + 0.5 ELSE pos END) - 1)::INT AS new_pos FROM c")
def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.moved_lines(lines(spark, sf_dir), "^The", "^An")


@query(f"WITH {ELEMENTS_SQL}, a AS (SELECT doc_id, page, 1 AS src, pos, 'c' || (pos % 4)::VARCHAR AS code FROM elements WHERE pos % 3 = 0), b AS (SELECT doc_id, page, 2, pos, 'c' || (pos % 4)::VARCHAR FROM elements WHERE pos % 2 = 0), u AS (SELECT *, 'quality-issue-' || substr(sha256(code || '|' || doc_id::VARCHAR || '|' || page::VARCHAR), 1, 24) AS issue_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT issue_id, doc_id, page, src, pos, code FROM u QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY src, pos) = 1")
def merged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = elements(spark, sf_dir).select("doc_id", "page", "pos", F.concat(F.lit("c"), F.col("pos") % 4).alias("code"))
    both = own.where("pos % 3 = 0").withColumn("src", F.lit(1)).unionByName(own.where("pos % 2 = 0").withColumn("src", F.lit(2)))
    return E.keep_first(both.withColumn("issue_id", C.issue_id(F.col("code"), F.col("doc_id"), F.col("page"))), ["issue_id"], ["src", "pos"])
