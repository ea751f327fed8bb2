"""Catalog of source files."""

from __future__ import annotations

import os
import posixpath
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from paperloom.functions import ids, text

#: Suffixes, their formats and media types.
FORMATS = {".pdf": "PDF", ".docx": "DOCX", ".doc": "DOC", ".png": "IMAGE", ".jpg": "IMAGE", ".jpeg": "IMAGE", ".tif": "IMAGE", ".tiff": "IMAGE", ".bmp": "IMAGE"}
MEDIA = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp"}


def _looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def file_format(name: Column) -> Column:
    return _looked_up(text.suffix(name), FORMATS, "UNKNOWN")


def media_type(name: Column) -> Column:
    return _looked_up(text.suffix(name), MEDIA, "application/octet-stream")


def _is_link(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: os.path.islink(unquote(urlsplit(p).path)))


def scan_predicate(name: Column) -> Column:
    """Regular source files: not the office programs' lock files, of a known suffix."""
    return ~F.startswith(text.basename(name), F.lit("~$")) & (file_format(name) != "UNKNOWN")


def scan(spark: SparkSession, root: str, recursive: bool = True, part: str | None = None) -> DataFrame:
    """Catalog of the files under ``root``, or under ``part``, a folder in it, by their paths from ``root``: Spark lists and reads them, whatever the store.

    On a local disk symbolic links are left out."""
    if part is not None and not f"{posixpath.normpath(part)}/".startswith(f"{posixpath.normpath(root)}/"):
        raise ValueError(f"{part} is not under {root}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(part or root)
    base = root.split("://")[-1].strip("/") + "/"
    if "://" not in root or root.startswith("file:"):
        found = found.where(~F.pandas_udf(_is_link, BooleanType())(F.col("path")))
    relative = F.substring_index(F.col("path"), base, -1)
    rows = found.select(relative.alias("source_path"), "length", "modificationTime", "content")
    if not recursive:
        rows = rows.where(~F.col("source_path").contains("/"))
    return catalog(rows.where(scan_predicate(F.col("source_path"))).where("length > 0"), F.col("content"), F.col("modificationTime"))


def catalog(files: DataFrame, content: Column, modified: Column | None = None) -> DataFrame:
    """catalog_id, source_name, source_path, file_format, source_sha256, size_bytes, mime_type, modified_at by folded path."""
    rows = files.select("source_path", content.cast("binary").alias("content"), (modified if modified is not None else F.lit(None).cast("timestamp")).alias("modified_at"))
    rows = rows.withColumns({"source_sha256": F.sha2("content", 256), "size_bytes": F.octet_length("content").cast("long"), "source_name": text.basename(F.col("source_path"))}).drop("content")
    out = rows.select(ids.catalog_id(F.col("source_path"), F.col("source_sha256")).alias("catalog_id"), "source_name", "source_path", file_format(F.col("source_name")).alias("file_format"), "source_sha256", "size_bytes", media_type(F.col("source_name")).alias("mime_type"), "modified_at")
    return out.orderBy(F.lower("source_path"), "source_path")
