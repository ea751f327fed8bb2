"""Routing assigned versions to extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids

#: Format, route, primary engine, fallbacks.
ROUTES = (
    ("PDF", "PDF_OPENDATALOADER", "OPENDATALOADER_LOCAL", ["OPENDATALOADER_HYBRID", "MINERU"]),
    ("DOCX", "DOCX_NATIVE", "DOCX_NATIVE", []),
    ("DOC", "DOC_CONVERT", "LIBREOFFICE", ["MANUAL"]),
    ("IMAGE", "IMAGE_VISUAL", "QWEN3_VL", ["MANUAL"]),
    ("UNKNOWN", "UNSUPPORTED", "MANUAL", []),
)


def routes(assignments: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row an assignment with its destination: reused, mismatch (content differs), unsupported (quarantined), extract."""
    dim = assignments.sparkSession.createDataFrame(list(ROUTES), "file_format string, route_type string, primary_engine string, fallback_engines array<string>")
    rows = assignments.join(catalog.select("catalog_id", "file_format", F.col("source_sha256").alias("found_sha")), "catalog_id").join(F.broadcast(dim), "file_format", "left")
    fate = F.when(F.col("found_sha") != F.col("sha256"), "mismatch").when(F.col("action") == "REUSE_VERSION", "reused").when(F.col("route_type") == "UNSUPPORTED", "unsupported").otherwise("extract")
    rows = rows.withColumns({"destination": fate, "route_id": ids.prefixed_uuid("route", F.col("catalog_id"), F.col("version_id"), F.col("route_type"))})
    queued = F.when(F.col("destination") == "unsupported", ids.prefixed_uuid("qr", F.concat(F.lit("routing-quarantine:"), F.col("route_id"))))
    return rows.select("route_id", "catalog_id", "version_id", "file_format", "route_type", "primary_engine", F.array_join("fallback_engines", ",").alias("fallback_engines"), "destination", queued.alias("quarantine_id"))
