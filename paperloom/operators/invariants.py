"""What must hold within one record of each kind, as rules over columns; ``checks.violations`` names the rules that a row breaks.

Arrays may be null, which counts as empty.  A rule is a condition that is true for a sound row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import ids

#: Route -> format, primary engine.
ROUTE_PAIRS = {
    "PDF_OPENDATALOADER": ("PDF", "OPENDATALOADER_LOCAL"),
    "DOCX_NATIVE": ("DOCX", "DOCX_NATIVE"),
    "DOC_CONVERT": ("DOC", "LIBREOFFICE"),
    "IMAGE_VISUAL": ("IMAGE", "QWEN3_VL"),
    "UNSUPPORTED": ("UNKNOWN", "MANUAL"),
}
DECORATIVE_ROLES = ("BRAND_LOGO", "PAGE_DECORATION")


def _unless(condition: Column, needed: Column) -> Column:
    """``needed`` where the condition holds."""
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(needed, F.lit(False))


def _none(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) == 0


def _distinct(name: str) -> Column:
    return _none(name) | (F.size(F.array_distinct(name)) == F.size(name))


def _said(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def bounding_box() -> dict[str, Column]:
    """x0, y0, x1, y1"""
    c = F.col
    return {"coordinates_not_negative": F.least("x0", "y0", "x1", "y1") >= 0, "width_positive": c("x1") > c("x0"), "height_positive": c("y1") > c("y0")}


def family() -> dict[str, Column]:
    """family_id, aliases"""
    return {"family_id_pattern": F.col("family_id").rlike("^[a-z0-9][a-z0-9-]{0,63}$"), "aliases_present": ~_none("aliases"), "aliases_distinct": _distinct("aliases")}


def version() -> dict[str, Column]:
    """family_id, version_id, sha256, version_number, version_label, supersedes_version_id"""
    c, n = F.col, F.col("version_number")
    return {
        "number_from_one": n >= 1,
        "label_of_number": c("version_label") == ids.version_label(n),
        "id_of_family_label_content": c("version_id") == ids.version_id(c("family_id"), n, c("sha256")),
        "not_superseding_itself": ~c("supersedes_version_id").eqNullSafe(c("version_id")),
    }


def review() -> dict[str, Column]:
    """outcome, family_id, matched_version_id"""
    out, matched = F.col("outcome"), F.col("matched_version_id")
    kept = out.isin("NEW_VERSION", "UNRELATED")
    return {
        "no_conflict": out != "CONFLICT",
        "same_version_needs_references": _unless(out == "SAME_VERSION", _said("family_id") & _said("matched_version_id")),
        "family_required": _unless(kept, _said("family_id")),
        "only_same_version_matches": _unless(kept, matched.isNull()),
        "rejected_assigns_nothing": _unless(out == "REJECTED", F.col("family_id").isNull() & matched.isNull()),
    }


def route() -> dict[str, Column]:
    """route_type, file_format, primary_engine, fallback_engines"""
    pair = lambda k: F.element_at(F.create_map(*[F.lit(x) for r, p in ROUTE_PAIRS.items() for x in (r, p[k])]), F.col("route_type"))
    return {
        "primary_not_a_fallback": _none("fallback_engines") | ~F.array_contains("fallback_engines", F.col("primary_engine")),
        "fallbacks_distinct": _distinct("fallback_engines"),
        "format_of_route": F.col("file_format") == pair(0),
        "engine_of_route": F.col("primary_engine") == pair(1),
    }


def asset_reference() -> dict[str, Column]:
    """in_markdown, in_structure, anchor_id"""
    return {"referred_to_somewhere": F.col("in_markdown") | F.col("in_structure"), "structure_needs_anchor": _unless(F.col("in_structure"), F.col("anchor_id").isNotNull())}


def asset() -> dict[str, Column]:
    """sha256, classification, role, paths, reference_ids, reference_paths, anchor_shas, retain_raw, indexable"""
    kind = F.col("classification")
    return {
        "paths_present": ~_none("paths"),
        "paths_distinct": _distinct("paths"),
        "reference_ids_distinct": _distinct("reference_ids"),
        "references_to_own_paths": _none("reference_paths") | (F.size(F.array_except("reference_paths", "paths")) == 0),
        "anchors_of_same_source": _none("anchor_shas") | F.forall("anchor_shas", lambda s: s.isNull() | (s == F.col("sha256"))),
        "decorative_role_needs_class": _unless(F.col("role").isin(*DECORATIVE_ROLES), kind == "DECORATIVE"),
        "only_informative_indexable": _unless(F.col("indexable"), kind == "INFORMATIVE"),
        "raw_retained": F.col("retain_raw"),
    }


def source_element() -> dict[str, Column]:
    """type, content, confidence"""
    return {"content_unless_visual": F.col("type").isin("IMAGE", "FLOWCHART") | _said("content"), "confidence_in_range": F.col("confidence").isNull() | F.col("confidence").between(0, 1)}


def document() -> dict[str, Column]:
    """sha256, page_count, engines, element_ids, asset_ids, anchor_shas, anchor_pages"""
    return {
        "engines_present": ~_none("engines"),
        "elements_present": ~_none("element_ids"),
        "element_ids_distinct": _distinct("element_ids"),
        "asset_ids_distinct": _distinct("asset_ids"),
        "anchors_of_same_source": _none("anchor_shas") | F.forall("anchor_shas", lambda s: s == F.col("sha256")),
        "pages_in_document": F.col("page_count").isNull() | _none("anchor_pages") | (F.array_max("anchor_pages") <= F.col("page_count")),
    }


def quality_issue() -> dict[str, Column]:
    """severity, fallback, pages, element_ids, asset_ids"""
    return {
        "pages_from_one": _none("pages") | (F.array_min("pages") >= 1),
        "pages_distinct": _distinct("pages"),
        "elements_distinct": _distinct("element_ids"),
        "assets_distinct": _distinct("asset_ids"),
        "info_asks_no_fallback": ~(F.col("fallback") & (F.col("severity") == "INFO")),
    }


def quality_report() -> dict[str, Column]:
    """disposition, warnings, errors, fallbacks (numbers of issues), engine, fallback_engine"""
    d, c = F.col("disposition"), F.col
    asked = d == "FALLBACK_REQUIRED"
    return {
        "pass_is_clean": _unless(d == "PASS", (c("warnings") == 0) & (c("errors") == 0) & (c("fallbacks") == 0)),
        "warnings_present": _unless(d == "PASS_WITH_WARNINGS", c("warnings") > 0),
        "warnings_only": _unless(d == "PASS_WITH_WARNINGS", (c("errors") == 0) & (c("fallbacks") == 0)),
        "fallback_has_issue": _unless(asked, c("fallbacks") > 0),
        "fallback_has_engine": _unless(asked, c("fallback_engine").isNotNull()),
        "fallback_engine_differs": _unless(asked & c("fallback_engine").isNotNull(), c("fallback_engine") != c("engine")),
        "quarantine_has_error": _unless(d == "QUARANTINE_REQUIRED", c("errors") > 0),
        "engine_only_for_fallback": _unless(~asked, c("fallback_engine").isNull()),
    }


def span() -> dict[str, Column]:
    """start, end, size (characters of the block)"""
    return {"starts_in_text": F.col("start") >= 0, "end_after_start": F.col("end") > F.col("start"), "ends_in_text": F.col("end") <= F.col("size")}


def block() -> dict[str, Column]:
    """markdown, span_ids"""
    return {"markdown_present": _said("markdown"), "spans_present": ~_none("span_ids"), "spans_distinct": _distinct("span_ids")}


def chunk() -> dict[str, Column]:
    """family_id, version_id, chunk_id, chunk_instance_id, ordinal, tokens, anchor_ids"""
    c = F.col
    return {
        "id_of_family": F.startswith(c("chunk_id"), F.concat("family_id", F.lit("#"))),
        "instance_of_version": c("chunk_instance_id") == F.concat("version_id", F.lit("::"), "chunk_id"),
        "ordinal_from_one": c("ordinal") >= 1,
        "tokens_present": c("tokens") >= 1,
        "anchors_present": ~_none("anchor_ids"),
    }


def chunk_policy() -> dict[str, Column]:
    """target, most, structural (tokens)"""
    return {"target_from_32": F.col("target") >= 32, "target_within_most": F.col("target") <= F.col("most"), "most_within_structural": F.col("most") <= F.col("structural")}


def quarantine() -> dict[str, Column]:
    """attempts, most_attempts"""
    return {"attempts_not_negative": F.least("attempts", "most_attempts") >= 0, "attempts_in_limit": F.col("attempts") <= F.col("most_attempts")}


def publish_receipt() -> dict[str, Column]:
    """state, version_id, previous_version_id"""
    return {"state_active": F.col("state") == "ACTIVE", "versions_differ": ~F.col("previous_version_id").eqNullSafe(F.col("version_id"))}


def page_scope() -> dict[str, Column]:
    """requested, found (pages), reasons, url: one page asked of an engine, and what it says it did"""
    return {
        "only_requested_page": _none("found") | (F.size(F.array_except("found", F.array("requested"))) == 0),
        "evidence_present": ~_none("found"),
        "reasons_sorted_distinct": ~_none("reasons") & (F.array_sort(F.array_distinct("reasons")) == F.col("reasons")),
        "local_engine": F.col("url").rlike(r"^https?://(127\.0\.0\.1|localhost|\[::1\])(:\d+)?(/|$)"),
    }


def reverification() -> dict[str, Column]:
    """passed, decision, unresolved (pages), next_engine_pages, action"""
    accepted, none = F.col("decision") == "ACCEPTED", _none("unresolved")
    return {
        "decision_is_passed": F.col("passed") == accepted,
        "pages_for_next_engine": (F.col("action") == "RUN_MINERU_PAGES") == ~_none("next_engine_pages"),
        "normalize_leaves_nothing": _unless(F.col("action") == "NORMALIZE", none),
        "next_pages_unresolved": _none("next_engine_pages") | (F.size(F.array_except("next_engine_pages", "unresolved")) == 0),
    }
