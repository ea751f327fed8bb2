"""Catalog, resolution, versions and routes over the driver's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.functions import ids, text
from paperloom.functions.ids import uuid5_sql
from paperloom.operators import catalog, merging, resolve, route, versions
from paperloom.plans.registry import query
from paperloom.sources import scratch
from paperloom.sources.tables import FILES_SQL, NAMED_SQL, files, named, table

_FORMAT = "CASE WHEN lower(source_name) LIKE '%.pdf' THEN 'PDF' WHEN lower(source_name) LIKE '%.docx' THEN 'DOCX' WHEN lower(source_name) LIKE '%.doc' THEN 'DOC' WHEN lower(source_name) LIKE '%.png' OR lower(source_name) LIKE '%.jpg' THEN 'IMAGE' ELSE 'UNKNOWN' END"
_MIME = "CASE WHEN lower(source_name) LIKE '%.pdf' THEN 'application/pdf' WHEN lower(source_name) LIKE '%.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN lower(source_name) LIKE '%.doc' THEN 'application/msword' WHEN lower(source_name) LIKE '%.png' THEN 'image/png' WHEN lower(source_name) LIKE '%.jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END"
_ENTRY = uuid5_sql(f"'{ids.CATALOG_PREFIX}' || lower(source_path) || ':' || sha256(text)")
_CATALOG = f"{FILES_SQL}, catalog AS (SELECT doc_id, 'cat-' || {_ENTRY} AS catalog_id, source_name, source_path, {_FORMAT} AS file_format, sha256(text) AS source_sha256, octet_length(encode(text)) AS size_bytes, {_MIME} AS mime_type FROM files)"


@query(f"WITH {_CATALOG} SELECT catalog_id, source_name, source_path, file_format, source_sha256, size_bytes, mime_type FROM catalog")
def catalog_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog(files(spark, sf_dir), F.col("text")).drop("modified_at")


@query(f"WITH {_CATALOG} SELECT file_format, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(DISTINCT source_sha256) AS contents FROM catalog GROUP BY file_format")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = catalog.catalog(files(spark, sf_dir), F.col("text"))
    return own.groupBy("file_format").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count_distinct("source_sha256").alias("contents")).orderBy("file_format")


@query(f"WITH {_CATALOG} SELECT source_sha256 AS sha256, count(*) AS files, min(source_path) AS first_path, count(*) - 1 AS copies FROM catalog GROUP BY source_sha256")
def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = catalog.catalog(files(spark, sf_dir), F.col("text"))
    return merging.content_groups(own.select(F.col("source_sha256").alias("sha256"), F.col("source_path").alias("path")))


@query(
    f"""SELECT item_id, 'res-' || {uuid5_sql("item_id::VARCHAR || '|SAME_VERSION||a,b'")} AS uuid, 'el-' || substr(sha256(item_id::VARCHAR || '|None|x'), 1, 24) AS barred, 'el-' || substr(sha256(item_id::VARCHAR || chr(31) || 'p'), 1, 24) AS unit_separated,
    'v' || lpad((item_id + 1)::VARCHAR, 3, '0') AS label, 'f-v' || lpad((item_id + 1)::VARCHAR, 3, '0') || '-' || substr(sha256(text), 1, 12) AS version_id FROM benchmark"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    n = (F.col("item_id") + 1).cast("int")
    return b.select(
        "item_id", ids.prefixed_uuid("res", F.col("item_id"), F.lit("SAME_VERSION"), F.lit(None), F.lit("a,b")).alias("uuid"), ids.digest_id("el", F.col("item_id"), F.lit(None), F.lit("x")).alias("barred"),
        ids.digest_id("el", F.col("item_id"), F.lit("p"), separator="\x1f").alias("unit_separated"), ids.version_label(n).alias("label"), ids.version_id(F.lit("f"), n, F.sha2("text", 256)).alias("version_id"),
    )


@query(f"WITH {NAMED_SQL} SELECT doc_id, source_name, normalized_name, document_code, family_id FROM named")
def document_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(files(spark, sf_dir)).select("doc_id", "source_name", "normalized_name", "document_code", "family_id")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their identity, for the rules that each look at another part of it."""
    return scratch.once(spark, "named-files", sf_dir, lambda: named(files(spark, sf_dir)).drop("text", "lang"))


def known_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document is registered, some under a second family; a family's versions are numbered by id and the last is ACTIVE."""
    own = _named(spark, sf_dir).where("doc_id % 4 = 0")
    own = own.withColumn("family_id", F.when(F.col("doc_id") % 16 == 0, F.concat("family_id", F.lit("-alt"))).otherwise(F.col("family_id")))
    w = W.partitionBy("family_id")
    rows = own.withColumns({"version_number": F.row_number().over(w.orderBy("doc_id")).cast("int"), "n": F.count("*").over(w)})
    rows = rows.withColumn("publication_state", F.when(F.col("version_number") == F.col("n"), "ACTIVE").otherwise("SUPERSEDED"))
    v = ids.version_id(F.col("family_id"), F.col("version_number"), F.col("sha256"))
    return rows.select("family_id", v.alias("version_id"), "sha256", "version_number", ids.version_label(F.col("version_number")).alias("version_label"), "publication_state", F.lit(None).cast("string").alias("supersedes_version_id"), "normalized_name", "document_code")


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _named(spark, sf_dir).where("doc_id % 4 <> 0")
    return own.withColumn("catalog_id", ids.catalog_id(F.col("source_path"), F.col("sha256"))).select("doc_id", "catalog_id", "source_name", "sha256", "document_code", "normalized_name", "family_id")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules: content, code, name, similar name, new family; a row each file, copies under one path too."""
    entries, known = arriving(spark, sf_dir), known_versions(spark, sf_dir)
    return scratch.once(spark, "decisions", sf_dir, lambda: resolve.resolve(entries, known, resolve.name_scores(entries, known), keep=("doc_id", "sha256")))


_KNOWN = f"""{NAMED_SQL}, known0 AS (SELECT *, (row_number() OVER (PARTITION BY family_id ORDER BY doc_id))::INT AS version_number, count(*) OVER (PARTITION BY family_id) AS n FROM (SELECT * REPLACE (CASE WHEN doc_id % 16 = 0 THEN family_id || '-alt' ELSE family_id END AS family_id) FROM named WHERE doc_id % 4 = 0)),
known AS (SELECT family_id, family_id || '-v' || lpad(version_number::VARCHAR, 3, '0') || '-' || substr(sha256, 1, 12) AS version_id, sha256, version_number, 'v' || lpad(version_number::VARCHAR, 3, '0') AS version_label, CASE WHEN version_number = n THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS publication_state, normalized_name, document_code FROM known0),
arriving AS (SELECT doc_id, 'cat-' || {uuid5_sql(f"'{ids.CATALOG_PREFIX}' || lower(source_path) || ':' || sha256")} AS catalog_id, source_name, sha256, document_code, normalized_name, family_id FROM named WHERE doc_id % 4 <> 0)"""


def _rule_sql(key: str, entry: str, name: str) -> str:
    return f"{name} AS (SELECT a.catalog_id, list_sort(list(DISTINCT k.family_id)) AS fams, min(k.version_id) AS ver FROM arriving a JOIN known k ON {entry} = k.{key} GROUP BY a.catalog_id)"


def _lcs(p: str, q: str) -> str:
    """Longest common subsequence of two names of up to 62 characters, by bit-parallel rows."""
    full = f"((1::BIGINT << length({p})) - 1)"
    mask = f"coalesce(list_sum(list_transform(range(0, length({p})), lambda i: CASE WHEN substring({p}, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0 END)), 0)::BIGINT"
    rows = f"list_prepend({full}, list_transform(string_split({q}, ''), lambda c: {mask}))"
    return f"bit_count(xor({full}, list_reduce({rows}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def _scores_sql(names: str) -> str:
    """scored: name, family_id, score from 87 on, over a table's names and the known ones."""
    words = "list_sort(list_distinct(list_filter(string_split(normalized_name, ' '), lambda x: x <> '')))"
    part = lambda x: f"200.0::DOUBLE * length(c) / (length(c) + length({x}))"
    return f"""wn AS (SELECT DISTINCT normalized_name AS a, {words} AS x FROM {names} WHERE normalized_name <> ''), wk AS (SELECT DISTINCT normalized_name AS b, {words} AS y FROM known WHERE normalized_name <> ''),
both0 AS (SELECT a, b, list_sort(list_intersect(x, y)) AS c, list_filter(x, lambda w: NOT list_contains(y, w)) AS ox, list_filter(y, lambda w: NOT list_contains(x, w)) AS oy FROM wn, wk),
both1 AS (SELECT a, b, len(c) > 0 AND (len(ox) = 0 OR len(oy) = 0) AS inside, array_to_string(c, ' ') AS c, array_to_string(list_concat(c, ox), ' ') AS p, array_to_string(list_concat(c, oy), ' ') AS q FROM both0),
both2 AS (SELECT a, b, CASE WHEN inside THEN 100.0 WHEN 200.0 * least(length(p), length(q)) / (length(p) + length(q)) < 87 THEN greatest({part("p")}, {part("q")}) ELSE greatest({part("p")}, {part("q")}, 200.0::DOUBLE * {_lcs("p", "q")} / (length(p) + length(q))) END AS score FROM both1),
scored AS (SELECT a AS normalized_name, family_id, max(score) AS score FROM both2 JOIN (SELECT DISTINCT normalized_name AS b, family_id FROM known) USING (b) WHERE score >= 87 GROUP BY ALL),
tops AS (SELECT normalized_name, max(score) AS best FROM scored GROUP BY normalized_name HAVING max(score) >= 90),
fuzzy AS (SELECT normalized_name, best, list_sort(list(DISTINCT family_id)) AS fams FROM scored JOIN tops USING (normalized_name) WHERE score >= greatest(90.0, best - 3) GROUP BY normalized_name, best)"""


_DECIDED = f"""{_KNOWN}, {_rule_sql("sha256", "a.sha256", "r1")}, {_rule_sql("document_code", "a.document_code", "r2")}, {_rule_sql("normalized_name", "a.normalized_name", "r3")},
judged0 AS (SELECT a.*, coalesce(r1.fams, r2.fams, r3.fams) AS fams, CASE WHEN r1.fams IS NOT NULL THEN 1 WHEN r2.fams IS NOT NULL THEN 2 WHEN r3.fams IS NOT NULL THEN 3 ELSE 5 END AS rule, r1.ver FROM arriving a LEFT JOIN r1 USING (catalog_id) LEFT JOIN r2 USING (catalog_id) LEFT JOIN r3 USING (catalog_id)),
unnamed AS (SELECT normalized_name FROM judged0 WHERE rule = 5), {_scores_sql('unnamed')},
judged AS (SELECT j.* REPLACE (CASE WHEN rule = 5 AND f.fams IS NOT NULL THEN 4 ELSE rule END AS rule, CASE WHEN rule = 5 THEN f.fams ELSE j.fams END AS fams), best FROM judged0 j LEFT JOIN fuzzy f ON f.normalized_name = j.normalized_name),
decided0 AS (SELECT doc_id, sha256, catalog_id, CASE WHEN rule = 5 THEN 'UNRELATED' WHEN rule = 4 OR len(fams) > 1 THEN 'CONFLICT' WHEN rule = 1 THEN 'SAME_VERSION' ELSE 'NEW_VERSION' END AS outcome,
  CASE WHEN rule = 5 THEN family_id WHEN rule < 4 AND len(fams) = 1 THEN fams[1] END AS family_id, CASE WHEN rule = 1 AND len(fams) = 1 THEN ver END AS matched_version_id, CASE WHEN rule = 4 OR (rule < 4 AND len(fams) > 1) THEN array_to_string(fams, ',') ELSE '' END AS candidates,
  CASE rule WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.98::DOUBLE WHEN 3 THEN 0.93::DOUBLE WHEN 4 THEN best / 100 ELSE CASE WHEN document_code IS NULL THEN 0.8 ELSE 1.0 END END::DOUBLE AS confidence,
  CASE rule WHEN 1 THEN 'exact_sha256_match' WHEN 2 THEN 'document_code_match' WHEN 3 THEN 'normalized_name_match' WHEN 4 THEN 'fuzzy_name_match_requires_review' ELSE 'no_known_family_match' END || CASE WHEN rule < 4 AND len(fams) > 1 THEN '_conflict' ELSE '' END AS reason_code FROM judged),
decided AS (SELECT *, 'res-' || {uuid5_sql("catalog_id || '|' || outcome || '|' || reason_code || '|' || coalesce(family_id, '') || '|' || candidates")} AS decision_id FROM decided0)"""


@query(f"WITH {_DECIDED} SELECT decision_id, catalog_id, outcome, family_id, matched_version_id, candidates, confidence, reason_code, outcome = 'CONFLICT' AS requires_human_review FROM decided")
def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    return d.select("decision_id", "catalog_id", "outcome", "family_id", "matched_version_id", F.array_join("candidate_family_ids", ",").alias("candidates"), "confidence", "reason_code", "requires_human_review")


@query(f"WITH {_DECIDED} SELECT outcome, reason_code, CASE WHEN outcome = 'CONFLICT' THEN 'quarantine' ELSE 'continue' END AS destination, count(*) AS entries FROM decided GROUP BY ALL")
def resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.partition(decided(spark, sf_dir)).groupBy("outcome", "reason_code", "destination").agg(F.count("*").alias("entries")).orderBy("outcome", "reason_code")


@query(f"WITH {_DECIDED} SELECT 'qr-' || {uuid5_sql("'resolver-quarantine:' || decision_id")} AS quarantine_id, 'VERSION_REVIEW' AS queue, catalog_id, reason_code FROM decided WHERE outcome = 'CONFLICT'")
def resolution_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.quarantine(decided(spark, sf_dir))


@query(f"WITH {_KNOWN}, {_scores_sql('arriving')} SELECT DISTINCT catalog_id, round(best, 4) AS best, array_to_string(fams, ',') AS families FROM arriving JOIN fuzzy USING (normalized_name)")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of similar names for review."""
    return resolve.fuzzy_candidates(resolve.name_scores(arriving(spark, sf_dir), known_versions(spark, sf_dir))).select("catalog_id", F.round("best", 4).alias("best"), F.array_join("fuzzy", ",").alias("families"))


@query(
    f"""WITH {_DECIDED}, reviewed AS (SELECT *, 'rv-' || decision_id AS review_id, split_part(candidates, ',', 1) AS pick FROM decided WHERE outcome = 'CONFLICT' AND doc_id % 2 = 1)
    SELECT CASE WHEN r.review_id IS NULL THEN d.decision_id ELSE 'res-' || {uuid5_sql("d.decision_id || '|' || r.review_id || '|NEW_VERSION'")} END AS decision_id, d.catalog_id, CASE WHEN r.review_id IS NULL THEN d.outcome ELSE 'NEW_VERSION' END AS outcome,
    CASE WHEN r.review_id IS NULL THEN d.family_id ELSE r.pick END AS family_id, CASE WHEN r.review_id IS NULL THEN d.matched_version_id END AS matched_version_id, r.review_id IS NULL AND d.outcome = 'CONFLICT' AS requires_human_review FROM decided d LEFT JOIN reviewed r USING (decision_id)"""
)
def reviewed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    r = d.where("outcome = 'CONFLICT' AND doc_id % 2 = 1").select(F.concat(F.lit("rv-"), "decision_id").alias("review_id"), F.col("decision_id").alias("original_decision_id"), F.lit("NEW_VERSION").alias("outcome"), F.get("candidate_family_ids", F.lit(0)).alias("family_id"), F.lit(None).cast("string").alias("matched_version_id"))
    return resolve.apply_reviews(d.drop("doc_id"), r)[0]


@query(
    f"""WITH {_DECIDED}, reviews AS (SELECT decision_id, 'rv1-' || decision_id AS review_id, outcome FROM decided WHERE doc_id % 7 = 1 UNION ALL SELECT decision_id, 'rv2-' || decision_id, outcome FROM decided WHERE doc_id % 21 = 1 UNION ALL SELECT 'none', 'rv3-' || decision_id, NULL FROM decided WHERE doc_id % 50 = 1),
    counted AS (SELECT *, count(*) OVER (PARTITION BY decision_id) AS n FROM reviews) SELECT review_id, CASE WHEN decision_id = 'none' THEN 'unknown_decision' WHEN n > 1 THEN 'duplicate_review' ELSE 'not_a_conflict' END AS violation FROM counted WHERE decision_id = 'none' OR n > 1 OR outcome <> 'CONFLICT'"""
)
def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    cols = [F.lit("NEW_VERSION").alias("outcome"), F.col("family_id"), F.lit(None).cast("string").alias("matched_version_id")]
    own = lambda n, test, of: d.where(test).select(F.concat(F.lit(f"rv{n}-"), "decision_id").alias("review_id"), of.alias("original_decision_id"), *cols)
    r = own(1, "doc_id % 7 = 1", F.col("decision_id")).unionByName(own(2, "doc_id % 21 = 1", F.col("decision_id"))).unionByName(own(3, "doc_id % 50 = 1", F.lit("none")))
    return resolve.apply_reviews(d.drop("doc_id"), r)[1]


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir).where("outcome <> 'CONFLICT'").withColumnRenamed("doc_id", "pos")
    return scratch.once(spark, "assignments", sf_dir, lambda: versions.assign(d, known_versions(spark, sf_dir)))


_ASSIGNED = f"""{_DECIDED}, todo AS (SELECT * FROM decided WHERE outcome <> 'CONFLICT'), held AS (SELECT family_id, sha256, min((version_number, version_id)) AS h FROM known GROUP BY ALL),
lasts AS (SELECT family_id, max(version_number) AS last, max(CASE WHEN publication_state = 'ACTIVE' THEN version_id END) AS active FROM known GROUP BY family_id), firsts AS (SELECT family_id, sha256, min(doc_id) AS fp FROM todo GROUP BY ALL),
numbered AS (SELECT f.*, row_number() OVER (PARTITION BY f.family_id ORDER BY fp) AS nth FROM firsts f ANTI JOIN held h ON f.family_id = h.family_id AND f.sha256 = h.sha256),
assigned0 AS (SELECT t.*, (CASE WHEN held.h IS NOT NULL THEN held.h[1] ELSE coalesce(last, 0) + nth END)::INT AS version_number, held.h, fp, nth, last, active FROM todo t LEFT JOIN held USING (family_id, sha256) LEFT JOIN numbered USING (family_id, sha256) LEFT JOIN lasts USING (family_id)),
assigned1 AS (SELECT *, 'v' || lpad(version_number::VARCHAR, 3, '0') AS version_label, CASE WHEN h IS NOT NULL THEN h[2] ELSE family_id || '-v' || lpad(version_number::VARCHAR, 3, '0') || '-' || substr(sha256, 1, 12) END AS version_id,
  CASE WHEN h IS NULL AND doc_id = fp AND last IS NULL AND nth = 1 THEN 'CREATE_FAMILY_AND_VERSION' WHEN h IS NULL AND doc_id = fp THEN 'CREATE_VERSION' ELSE 'REUSE_VERSION' END AS action FROM assigned0),
assigned AS (SELECT 'va-' || {uuid5_sql("decision_id || '|' || version_id || '|' || action")} AS assignment_id, catalog_id, decision_id, family_id, version_id, version_number, version_label, sha256, action, CASE WHEN action <> 'REUSE_VERSION' THEN active END AS supersedes_version_id FROM assigned1)"""


@query(f"WITH {_ASSIGNED} SELECT * FROM assigned")
def version_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir)


@query(f"WITH {_ASSIGNED} SELECT action, count(*) AS assignments, count(DISTINCT family_id) AS families, max(version_number) AS highest FROM assigned GROUP BY action")
def assignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).groupBy("action").agg(F.count("*").alias("assignments"), F.count_distinct("family_id").alias("families"), F.max("version_number").alias("highest"))


@query(
    f"""WITH {_ASSIGNED}, b AS (SELECT version_id, any_value(sha256) AS new_sha, any_value(family_id) AS new_family FROM assigned GROUP BY version_id), s AS (SELECT sha256, min(version_id) AS sv FROM known GROUP BY sha256)
    SELECT coalesce(k.version_id, b.version_id) AS version_id, coalesce(k.family_id, new_family) AS family_id, coalesce(k.sha256, new_sha) AS sha256, CASE WHEN new_sha IS NULL THEN 'kept' WHEN k.sha256 = new_sha THEN 'unchanged' WHEN k.sha256 IS NOT NULL OR s.sv IS NOT NULL THEN 'conflict' ELSE 'inserted' END AS change
    FROM known k FULL JOIN b ON k.version_id = b.version_id LEFT JOIN s ON s.sha256 = b.new_sha"""
)
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = assigned(spark, sf_dir).select("version_id", "sha256", "family_id").dropDuplicates(["version_id"])
    return versions.upsert_index(known_versions(spark, sf_dir), new)


@query(
    f"""WITH {_DECIDED}, fams AS (SELECT DISTINCT family_id FROM known WHERE length(family_id) % 13 <> 0)
    SELECT 'family_missing' AS kind, version_id AS id FROM known ANTI JOIN fams USING (family_id) UNION ALL SELECT 'version_id_repeated', version_id FROM known GROUP BY version_id HAVING count(*) > 1
    UNION ALL SELECT 'sha256_in_several_families', sha256 FROM known GROUP BY sha256 HAVING count(DISTINCT family_id) > 1 UNION ALL SELECT 'undecided', catalog_id FROM arriving WHERE doc_id % 10 = 1"""
)
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_versions(spark, sf_dir)
    families = known.select("family_id").where(F.length("family_id") % 13 != 0).distinct()
    entries = arriving(spark, sf_dir)
    d = decided(spark, sf_dir).join(entries.where("doc_id % 10 <> 1").select("catalog_id"), "catalog_id", "left_semi")
    return versions.violations(families, known, d, entries)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = catalog.catalog(files(spark, sf_dir), F.col("text"))
    return route.routes(assigned(spark, sf_dir), entries)


_ROUTED = f"""{_ASSIGNED}, kinds AS (SELECT catalog_id, {_FORMAT} AS file_format, text FROM (SELECT 'cat-' || {_ENTRY} AS catalog_id, source_name, text FROM files)),
routed0 AS (SELECT a.*, file_format, CASE file_format WHEN 'PDF' THEN 'PDF_OPENDATALOADER' WHEN 'DOCX' THEN 'DOCX_NATIVE' WHEN 'DOC' THEN 'DOC_CONVERT' WHEN 'IMAGE' THEN 'IMAGE_VISUAL' ELSE 'UNSUPPORTED' END AS route_type FROM assigned a JOIN kinds USING (catalog_id)),
routed AS (SELECT 'route-' || {uuid5_sql("catalog_id || '|' || version_id || '|' || route_type")} AS route_id, catalog_id, version_id, file_format, route_type, CASE route_type WHEN 'PDF_OPENDATALOADER' THEN 'OPENDATALOADER_LOCAL' WHEN 'DOCX_NATIVE' THEN 'DOCX_NATIVE' WHEN 'DOC_CONVERT' THEN 'LIBREOFFICE' WHEN 'IMAGE_VISUAL' THEN 'QWEN3_VL' ELSE 'MANUAL' END AS primary_engine,
  CASE route_type WHEN 'PDF_OPENDATALOADER' THEN 'OPENDATALOADER_HYBRID,MINERU' WHEN 'DOC_CONVERT' THEN 'MANUAL' WHEN 'IMAGE_VISUAL' THEN 'MANUAL' ELSE '' END AS fallback_engines, CASE WHEN action = 'REUSE_VERSION' THEN 'reused' WHEN route_type = 'UNSUPPORTED' THEN 'unsupported' ELSE 'extract' END AS destination FROM routed0)"""


@query(f"WITH {_ROUTED} SELECT *, CASE WHEN destination = 'unsupported' THEN 'qr-' || {uuid5_sql("'routing-quarantine:' || route_id")} END AS quarantine_id FROM routed")
def route_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir)


@query(f"WITH {_ROUTED} SELECT route_type, destination, count(*) AS routes FROM routed GROUP BY ALL")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).groupBy("route_type", "destination").agg(F.count("*").alias("routes"))


@query(
    f"""WITH {_CATALOG}, m AS (SELECT source_path AS path, size_bytes AS s, source_sha256 AS h FROM catalog WHERE doc_id % 9 <> 1 AND doc_id % 5 <> 9), f AS (SELECT source_path AS path, CASE WHEN doc_id % 11 = 2 THEN size_bytes + 1 ELSE size_bytes END AS s, CASE WHEN doc_id % 17 = 3 THEN 'x' ELSE source_sha256 END AS h FROM catalog WHERE doc_id % 13 <> 4),
    u1 AS (SELECT path, min(s) AS s, min(h) AS h FROM m GROUP BY path), u2 AS (SELECT path, min(s) AS s, min(h) AS h FROM f GROUP BY path)
    SELECT path, CASE WHEN u2.s IS NULL THEN 'missing' WHEN u1.s IS NULL THEN 'unexpected' WHEN u1.s <> u2.s THEN 'size' ELSE 'sha256' END AS difference FROM u1 FULL JOIN u2 USING (path) WHERE u1.s IS NULL OR u2.s IS NULL OR u1.s <> u2.s OR u1.h <> u2.h"""
)
def inventory_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).select("doc_id", F.col("source_path").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    one = lambda d: d.groupBy("path").agg(F.min("size").alias("size"), F.min("sha256").alias("sha256"))
    m = own.where("doc_id % 9 <> 1")
    f = own.where("doc_id % 13 <> 4").withColumns({"size": F.when(F.col("doc_id") % 11 == 2, F.col("size") + 1).otherwise(F.col("size")), "sha256": F.when(F.col("doc_id") % 17 == 3, "x").otherwise(F.col("sha256"))})
    return merging.inventory_diff(one(m), one(f))


@query(
    f"""WITH {FILES_SQL}, refs AS (SELECT doc_id AS ref_id, CASE WHEN doc_id % 3 = 0 THEN source_path ELSE 'images/' || upper(source_name) END AS path FROM files WHERE doc_id % 2 = 0), f AS (SELECT DISTINCT source_path AS path FROM files WHERE doc_id % 5 <> 1),
    only_ AS (SELECT lower(regexp_extract(path, '([^/]*)$', 1)) AS base, min(path) AS by_name FROM f GROUP BY 1 HAVING count(*) = 1)
    SELECT ref_id, CASE WHEN f.path IS NOT NULL THEN r.path ELSE by_name END AS path FROM refs r LEFT JOIN f ON f.path = r.path LEFT JOIN only_ ON lower(regexp_extract(r.path, '([^/]*)$', 1)) = base"""
)
def image_reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    refs = own.where("doc_id % 2 = 0").select(F.col("doc_id").alias("ref_id"), F.when(F.col("doc_id") % 3 == 0, F.col("source_path")).otherwise(F.concat(F.lit("images/"), F.upper("source_name"))).alias("path"))
    return merging.image_files(refs, own.where("doc_id % 5 <> 1").select(F.col("source_path").alias("path")).distinct())


@query(
    f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN NOT regexp_matches(lower(source_name), '[.](pdf|docx)$') THEN 'unsupported_suffix' WHEN octet_length(encode(text)) > 20000 THEN 'too_large' WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN lower(source_name) LIKE '%.pdf' THEN 'not_a_pdf' ELSE 'not_a_docx' END AS refused FROM files"""
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.sources.files import upload_facts, upload_verdict

    own = files(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8")).withColumn("facts", upload_facts("content"))
    return own.select("doc_id", upload_verdict(F.col("source_name"), F.octet_length("content"), F.col("facts"), 20000).alias("refused"))


@query(f"WITH {FILES_SQL} SELECT doc_id, source_name, regexp_replace(source_name, '\\.[^.]+$', '') AS stem, lower(regexp_extract(source_name, '(\\.[^.]+)$', 1)) AS suffix FROM files")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_name")
    return files(spark, sf_dir).select("doc_id", text.basename(F.col("source_path")).alias("source_name"), text.stem(n).alias("stem"), text.suffix(n).alias("suffix"))
