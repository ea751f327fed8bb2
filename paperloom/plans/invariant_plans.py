"""Records of each kind made from the driver's tables, some of them unsound, and the rules that they break.

A fixture is one SELECT that both dialects read; lists are texts joined by commas there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import checks, invariants
from paperloom.plans.registry import query
from paperloom.sources.tables import table

#: kind -> (table, key, columns, list columns, {rule: the same in DuckDB, true for a sound row})
KINDS: dict[str, tuple[str, str, dict[str, str], tuple[str, ...], dict[str, str]]] = {
    "bounding_box": ("lineitem", "l_orderkey * 10 + l_linenumber", {"x0": "l_partkey % 50 - 1", "y0": "l_suppkey % 40", "x1": "l_partkey % 45", "y1": "l_suppkey % 37 + 5"}, (), {
        "coordinates_not_negative": "least(x0, y0, x1, y1) >= 0", "width_positive": "x1 > x0", "height_positive": "y1 > y0",
    }),
    "family": ("part", "p_partkey", {"family_id": "CASE WHEN p_partkey % 7 = 3 THEN concat('Fam-', p_partkey) WHEN p_partkey % 11 = 5 THEN concat('x', repeat('y', 64)) ELSE concat('doc-', p_partkey) END", "aliases": "CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'a,b,a' ELSE 'a,b' END"}, ("aliases",), {
        "family_id_pattern": "regexp_matches(family_id, '^[a-z0-9][a-z0-9-]{0,63}$')", "aliases_present": "aliases <> ''", "aliases_distinct": "len(list_distinct(string_split(aliases, ','))) = len(string_split(aliases, ','))",
    }),
    "review": ("orders", "o_orderkey", {"outcome": "CASE o_orderkey % 5 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'SAME_VERSION' WHEN 2 THEN 'NEW_VERSION' WHEN 3 THEN 'UNRELATED' ELSE 'REJECTED' END", "family_id": "CASE WHEN o_custkey % 3 > 0 THEN 'f' END", "matched_version_id": "CASE WHEN o_custkey % 2 > 0 THEN 'v' END"}, (), {
        "no_conflict": "outcome <> 'CONFLICT'", "same_version_needs_references": "outcome <> 'SAME_VERSION' OR (family_id IS NOT NULL AND matched_version_id IS NOT NULL)", "family_required": "outcome NOT IN ('NEW_VERSION', 'UNRELATED') OR family_id IS NOT NULL",
        "only_same_version_matches": "outcome NOT IN ('NEW_VERSION', 'UNRELATED') OR matched_version_id IS NULL", "rejected_assigns_nothing": "outcome <> 'REJECTED' OR (family_id IS NULL AND matched_version_id IS NULL)",
    }),
    "route": ("orders", "o_orderkey", {"route_type": "CASE o_orderkey % 3 WHEN 0 THEN 'PDF_OPENDATALOADER' WHEN 1 THEN 'DOC_CONVERT' ELSE 'IMAGE_VISUAL' END", "file_format": "CASE o_custkey % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOC' ELSE 'IMAGE' END", "primary_engine": "CASE o_custkey % 4 WHEN 0 THEN 'OPENDATALOADER_LOCAL' WHEN 1 THEN 'LIBREOFFICE' WHEN 2 THEN 'QWEN3_VL' ELSE 'MANUAL' END", "fallback_engines": "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'MINERU,MINERU' ELSE 'MINERU' END"}, ("fallback_engines",), {
        "primary_not_a_fallback": "NOT list_contains(string_split(fallback_engines, ','), primary_engine)", "fallbacks_distinct": "fallback_engines <> 'MINERU,MINERU'",
        "format_of_route": "file_format = CASE route_type WHEN 'PDF_OPENDATALOADER' THEN 'PDF' WHEN 'DOC_CONVERT' THEN 'DOC' ELSE 'IMAGE' END", "engine_of_route": "primary_engine = CASE route_type WHEN 'PDF_OPENDATALOADER' THEN 'OPENDATALOADER_LOCAL' WHEN 'DOC_CONVERT' THEN 'LIBREOFFICE' ELSE 'QWEN3_VL' END",
    }),
    "asset_reference": ("part", "p_partkey", {"in_markdown": "p_partkey % 2 = 0", "in_structure": "p_partkey % 3 = 0", "anchor_id": "CASE WHEN p_size % 4 > 0 THEN 'a' END"}, (), {"referred_to_somewhere": "in_markdown OR in_structure", "structure_needs_anchor": "NOT in_structure OR anchor_id IS NOT NULL"}),
    "asset": ("part", "p_partkey", {
        "sha256": "concat('s', p_partkey % 9)", "classification": "CASE p_partkey % 3 WHEN 0 THEN 'INFORMATIVE' WHEN 1 THEN 'DECORATIVE' ELSE 'UNKNOWN' END", "role": "CASE p_size % 4 WHEN 0 THEN 'BRAND_LOGO' WHEN 1 THEN 'PAGE_DECORATION' ELSE 'FIGURE' END", "paths": "CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'a,a' ELSE 'a,b' END",
        "reference_ids": "CASE p_size % 6 WHEN 0 THEN '1,1' ELSE '1,2' END", "reference_paths": "CASE p_size % 7 WHEN 0 THEN 'a,c' WHEN 1 THEN '' ELSE 'a' END", "anchor_shas": "concat('s', p_partkey % 9, ',s', p_partkey % 10)", "retain_raw": "p_partkey % 13 <> 4", "indexable": "p_partkey % 5 = 0",
    }, ("paths", "reference_ids", "reference_paths", "anchor_shas"), {
        "paths_present": "paths <> ''", "paths_distinct": "paths <> 'a,a'", "reference_ids_distinct": "reference_ids <> '1,1'", "references_to_own_paths": "reference_paths = '' OR list_has_all(string_split(paths, ','), string_split(reference_paths, ','))",
        "anchors_of_same_source": "len(list_filter(string_split(anchor_shas, ','), lambda x: x <> sha256)) = 0", "decorative_role_needs_class": "role = 'FIGURE' OR classification = 'DECORATIVE'", "only_informative_indexable": "NOT indexable OR classification = 'INFORMATIVE'", "raw_retained": "retain_raw",
    }),
    "source_element": ("part", "p_partkey", {"type": "CASE p_size % 3 WHEN 0 THEN 'IMAGE' ELSE 'PARAGRAPH' END", "content": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END", "confidence": "CASE WHEN p_partkey % 5 > 0 THEN p_size / 40.0 END"}, (), {"content_unless_visual": "type = 'IMAGE' OR content <> ''", "confidence_in_range": "confidence IS NULL OR (confidence >= 0 AND confidence <= 1)"}),
    "document": ("part", "p_partkey", {
        "sha256": "concat('s', p_partkey % 6)", "page_count": "CASE WHEN p_size % 9 > 0 THEN p_size % 9 END", "engines": "CASE WHEN p_partkey % 14 = 3 THEN '' ELSE 'OPENDATALOADER_LOCAL' END", "element_ids": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'e1,e2,e1' ELSE 'e1,e2' END",
        "asset_ids": "CASE WHEN p_size % 4 = 1 THEN 'a,a' ELSE 'a' END", "anchor_shas": "concat('s', p_partkey % 6, ',s', p_size % 6)", "anchor_pages": "concat('1,', p_partkey % 8 + 1)",
    }, ("engines", "element_ids", "asset_ids", "anchor_shas", "anchor_pages"), {
        "engines_present": "engines <> ''", "elements_present": "element_ids <> ''", "element_ids_distinct": "element_ids <> 'e1,e2,e1'", "asset_ids_distinct": "asset_ids <> 'a,a'", "anchors_of_same_source": "list_distinct(string_split(anchor_shas, ',')) = [sha256]",
        "pages_in_document": "page_count IS NULL OR list_max(list_transform(string_split(anchor_pages, ','), lambda x: x::INT)) <= page_count",
    }),
    "quality_issue": ("orders", "o_orderkey", {"severity": "CASE o_orderkey % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' ELSE 'ERROR' END", "fallback": "o_custkey % 2 = 0", "pages": "CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '0,2' WHEN 2 THEN '3,3' ELSE '1,2' END", "element_ids": "CASE o_orderkey % 7 WHEN 0 THEN 'e,e' ELSE 'e,f' END", "asset_ids": "CASE o_orderkey % 11 WHEN 0 THEN 'a,a' WHEN 1 THEN '' ELSE 'a' END"}, ("pages", "element_ids", "asset_ids"), {
        "pages_from_one": "pages <> '0,2'", "pages_distinct": "pages <> '3,3'", "elements_distinct": "element_ids <> 'e,e'", "assets_distinct": "asset_ids <> 'a,a'", "info_asks_no_fallback": "severity <> 'INFO' OR NOT fallback",
    }),
    "quality_report": ("orders", "o_orderkey", {"disposition": "CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS_WITH_WARNINGS' WHEN 2 THEN 'FALLBACK_REQUIRED' ELSE 'QUARANTINE_REQUIRED' END", "warnings": "o_custkey % 2", "errors": "o_custkey % 3", "fallbacks": "o_custkey % 5", "engine": "'A'", "fallback_engine": "CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END"}, (), {
        "pass_is_clean": "disposition <> 'PASS' OR warnings + errors + fallbacks = 0", "warnings_present": "disposition <> 'PASS_WITH_WARNINGS' OR warnings > 0", "warnings_only": "disposition <> 'PASS_WITH_WARNINGS' OR errors + fallbacks = 0", "fallback_has_issue": "disposition <> 'FALLBACK_REQUIRED' OR fallbacks > 0",
        "fallback_has_engine": "disposition <> 'FALLBACK_REQUIRED' OR fallback_engine IS NOT NULL", "fallback_engine_differs": "disposition <> 'FALLBACK_REQUIRED' OR fallback_engine IS NULL OR fallback_engine <> engine", "quarantine_has_error": "disposition <> 'QUARANTINE_REQUIRED' OR errors > 0",
        "engine_only_for_fallback": "disposition = 'FALLBACK_REQUIRED' OR fallback_engine IS NULL",
    }),
    "span": ("part", "p_partkey", {"start": "p_partkey % 20 - 1", "end": "p_size % 25", "size": "20"}, (), {"starts_in_text": "\"start\" >= 0", "end_after_start": "\"end\" > \"start\"", "ends_in_text": "\"end\" <= size"}),
    "block": ("part", "p_partkey", {"markdown": "CASE WHEN p_partkey % 6 = 2 THEN '' ELSE p_name END", "span_ids": "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 's,s' ELSE 's,t' END"}, ("span_ids",), {"markdown_present": "markdown <> ''", "spans_present": "span_ids <> ''", "spans_distinct": "span_ids <> 's,s'"}),
    "chunk": ("part", "p_partkey", {"family_id": "concat('f', p_partkey % 10)", "version_id": "concat('f', p_partkey % 10, '-v001-x')", "chunk_id": "concat('f', p_partkey % 10, CASE WHEN p_size % 6 = 0 THEN 'x' ELSE '' END, '#semantic-1')", "chunk_instance_id": "concat('f', p_partkey % 10, '-v001-x', CASE WHEN p_size % 7 = 0 THEN ':' ELSE '::' END, 'f', p_partkey % 10, '#semantic-1')", "ordinal": "p_size % 5", "tokens": "p_partkey % 4", "anchor_ids": "CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'a' END"}, ("anchor_ids",), {
        "id_of_family": "starts_with(chunk_id, family_id || '#')", "instance_of_version": "chunk_instance_id = version_id || '::' || chunk_id", "ordinal_from_one": "ordinal >= 1", "tokens_present": "tokens >= 1", "anchors_present": "anchor_ids <> ''",
    }),
    "chunk_policy": ("part", "p_partkey", {"target": "p_size * 2", "most": "p_partkey % 90", "structural": "p_size + 40"}, (), {"target_from_32": "target >= 32", "target_within_most": "target <= most", "most_within_structural": "most <= structural"}),
    "quarantine": ("orders", "o_orderkey", {"attempts": "o_custkey % 5 - 1", "most_attempts": "o_orderkey % 4"}, (), {"attempts_not_negative": "least(attempts, most_attempts) >= 0", "attempts_in_limit": "attempts <= most_attempts"}),
    "publish_receipt": ("orders", "o_orderkey", {"state": "CASE o_orderkey % 6 WHEN 0 THEN 'DRAFT' ELSE 'ACTIVE' END", "version_id": "concat('v', o_custkey % 4)", "previous_version_id": "CASE WHEN o_orderkey % 5 > 0 THEN concat('v', o_orderkey % 4) END"}, (), {"state_active": "state = 'ACTIVE'", "versions_differ": "previous_version_id IS NULL OR previous_version_id <> version_id"}),
    "page_scope": ("orders", "o_orderkey", {"requested": "o_custkey % 4 + 1", "found": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('', o_custkey % 4 + 1) ELSE '2,3' END", "reasons": "CASE o_custkey % 5 WHEN 0 THEN 'b,a' WHEN 1 THEN 'a,a' WHEN 2 THEN '' ELSE 'a,b' END", "url": "CASE o_orderkey % 7 WHEN 0 THEN 'http://example.org/x' WHEN 1 THEN 'http://localhost' ELSE 'http://127.0.0.1:5002/v1' END"}, ("found", "reasons"), {
        "only_requested_page": "found = '' OR list_distinct(list_transform(string_split(found, ','), lambda x: try_cast(x AS BIGINT))) = [requested]", "evidence_present": "found <> ''", "reasons_sorted_distinct": "reasons = 'a,b'", "local_engine": "url <> 'http://example.org/x'",
    }),
    "reverification": ("orders", "o_orderkey", {"passed": "o_custkey % 2 = 0", "decision": "CASE WHEN o_orderkey % 3 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END", "unresolved": "CASE o_custkey % 3 WHEN 0 THEN '' ELSE '1,2' END", "next_engine_pages": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '3' ELSE '2' END", "action": "CASE o_orderkey % 5 WHEN 0 THEN 'NORMALIZE' ELSE 'RUN_MINERU_PAGES' END"}, ("unresolved", "next_engine_pages"), {
        "decision_is_passed": "passed = (decision = 'ACCEPTED')", "pages_for_next_engine": "(action = 'RUN_MINERU_PAGES') = (next_engine_pages <> '')", "normalize_leaves_nothing": "action <> 'NORMALIZE' OR unresolved = ''", "next_pages_unresolved": "next_engine_pages = '' OR (next_engine_pages = '2' AND unresolved = '1,2')",
    }),
}
_NUMBERS = ("pages", "anchor_pages", "found")


def _register(kind: str) -> None:
    name, key, columns, lists, sound = KINDS[kind]
    fixture = f"SELECT {key} AS id, " + ", ".join(f'{e} AS {{0}}{c}{{0}}' for c, e in columns.items()) + f" FROM {name}"
    broken = " UNION ALL ".join(f"SELECT id, '{rule}' AS rule FROM f WHERE NOT coalesce({test}, false)" for rule, test in sound.items())

    def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.sql(fixture.format("`").replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))

        def listed(c: str) -> Column:
            items = F.filter(F.split(c, ","), lambda x: x != "")
            return items.cast("array<bigint>") if c in _NUMBERS else items

        return checks.violations(rows.withColumns({c: listed(c) for c in lists}) if lists else rows, "id", getattr(invariants, kind)())

    violations.__name__ = f"{kind}_invariants"
    query(f"WITH f AS ({fixture.format(chr(34))}) {broken}")(violations)


for _kind in KINDS:
    _register(_kind)
