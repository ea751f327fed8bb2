"""Extractor trees (JSON) to elements with anchors, and what in them can't be mapped.

A tree's root lists its blocks.  Keys are read without case, blanks, dashes and underscores.  A block
is a paragraph, heading, list, table, image or caption; its text is made of what it says itself and of
its children, each text once.  One document is mapped in one call of Python, since rendering recurses;
heading paths, ids, issues and assets are DataFrame operations on the rows that come out."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import ids
from paperloom.operators import elements as E
from paperloom.operators import merging
from paperloom.sources.files import key_of

#: Kind of block -> type of element; headings of this level are titles.
TYPES = {"paragraph": "PARAGRAPH", "text block": "PARAGRAPH", "list": "LIST", "table": "TABLE", "image": "IMAGE", "caption": "CAPTION", "heading": "HEADING"}
TITLE_LEVEL = "doctitle"
_DIGITS = (("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"))


def plain(value: object) -> str:
    """Composed text with single blanks; empty for nothing, false and zero."""
    return " ".join(unicodedata.normalize("NFC", str(value or "")).split())


def whole(value: object) -> int | None:
    """A whole number, also as text or 3.0; booleans are none."""
    try:
        number = None if isinstance(value, bool) else float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return int(number) if number is not None and number == number // 1 and abs(number) != float("inf") else None


class Node:
    """A JSON object by folded keys; of keys that fold alike the first counts."""

    def __init__(self, raw: dict):
        self.raw = {key_of(k): v for k, v in reversed(raw.items())} if raw else {}
        self._order = [key_of(k) for k in raw]

    def get(self, *names: str) -> object:
        wanted = {key_of(n) for n in names}
        return next((self.raw[k] for k in self._order if k in wanted), None)

    def kind(self) -> str | None:
        value = self.get("type", "element type")
        return value.strip().casefold() if isinstance(value, str) and value.strip() else None

    def nodes(self, *names: str) -> list[Node]:
        value = self.get(*names)
        return [Node(v) for v in value if isinstance(v, dict)] if isinstance(value, list) else []

    def own_text(self) -> str:
        value = self.get("content", "text", "value")
        return plain(value) if isinstance(value, str) else ""


def once(texts: list[str]) -> list[str]:
    """Texts that say something, each folded one the first time."""
    seen: dict[str, str] = {}
    for t in filter(None, map(str.strip, texts)):
        seen.setdefault(plain(t).casefold(), t)
    return list(seen.values())


def node_text(node: Node) -> str:
    render = {"list": list_text, "table": lambda n: table_parts(n)["markdown"]}
    children = [render.get(c.kind() or "", node_text)(c) for c in node.nodes("kids", "children")]
    return "\n".join(once([node.own_text(), *children]))


def marker(style: object, n: int) -> str:
    """As ``functions.text.list_marker``, for the n-th item from 1."""
    s = plain(style).casefold()
    if not s or "unordered" in s:
        return "-"
    if "english letters" in s:
        letters, rest = "", n
        while rest:
            rest, digit = divmod(rest - 1, 26)
            letters = chr(97 + digit) + letters
        return (letters.upper() if "upper case" in s else letters) + "."
    if "roman" in s:
        return "m" * (n // 1000) + "".join(_DIGITS[k][n // 10**k % 10] for k in (2, 1, 0)) + "."
    return f"{n}."


def list_text(node: Node) -> str:
    """A line an item under its marker; what an item says beside and its lists follow, indented by two."""
    style, lines = node.get("numbering style"), []
    items = node.get("list items", "items")
    for n, raw in enumerate(items if isinstance(items, list) else [], 1):
        if not isinstance(raw, dict):
            continue
        item = Node(raw)
        children = item.nodes("kids", "children")
        said = once([item.own_text(), *(node_text(c) for c in children if c.kind() != "list")])
        under = [*said[1:], *(list_text(c) for c in children if c.kind() == "list")]
        lines.append(f"{marker(style, n)} {said[0] if said else ''}".rstrip())
        lines += [f"  {line}" for block in under for line in block.splitlines()]
    return "\n".join(lines).strip()


def table_parts(node: Node) -> dict:
    """GFM of a table of cells with spans (the first row is the header), and how its grid adds up."""
    height, width = whole(node.get("number of rows")) or 0, whole(node.get("number of columns")) or 0
    rows = node.get("rows")
    rows = rows if isinstance(rows, list) else []
    cells = [c for r in rows if isinstance(r, dict) for c in Node(r).nodes("cells")]
    at = [(whole(c.get("row number")), whole(c.get("column number"))) for c in cells]
    # Numbers count from 0 if any cell has a 0 there, else from 1.
    base = [0 if min((p[k] for p in at if p[k] is not None), default=1) == 0 else 1 for k in (0, 1)]
    taken: dict[tuple[int, int], str] = {}
    out = {"rows": height, "cols": width, "actual_rows": len(rows), "cells": len(cells), "merged": 0, "invalid": 0, "collisions": 0}
    for cell, (r, k) in zip(cells, at, strict=True):
        if r is None or k is None:
            out["invalid"] += 1
            continue
        down, across = whole(cell.get("row span")) or 1, whole(cell.get("column span")) or 1
        out["merged"] += down > 1 or across > 1
        top, left = r - base[0], k - base[1]
        if min(top, left) < 0 or top + down > height or left + across > width:
            out["invalid"] += 1
            continue
        slots = [(y, x) for y in range(top, top + down) for x in range(left, left + across)]
        out["collisions"] += sum(s in taken for s in slots)
        text = node_text(cell)
        for s in slots:
            taken.setdefault(s, text if s == slots[0] else "")
    line = lambda y: "| " + " | ".join(taken.get((y, x), "").replace("|", "\\|").replace("\n", "<br>").strip() for x in range(width)) + " |"
    lines = [line(y) for y in range(height)] if width > 0 else []
    if lines:
        lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return out | {"missing": height * width - len(taken) if height > 0 and width > 0 else 0, "markdown": "\n".join(lines)}


def box(node: Node) -> tuple[list[float] | None, bool]:
    """Four coordinates, and whether what is there is sound (nothing is)."""
    raw = node.get("bounding box", "bbox")
    if raw is None:
        return None, True
    if not isinstance(raw, list) or len(raw) != 4 or not all(isinstance(v, int | float) for v in raw):
        return None, False
    x0, y0, x1, y1 = map(float, raw)
    return ([x0, y0, x1, y1], True) if min(x0, y0, x1, y1) >= 0 and x1 > x0 and y1 > y0 else (None, False)


BLOCK = "pos int, kind string, type string, page int, level string, content string, source string, bbox array<double>, codes array<string>, rows int, cols int, merged int, flaws int"


def blocks(tree: str) -> Iterator[dict]:
    """A row for each object among the root's blocks, in order; those without text have the code empty_mapped_source_block."""
    root = json.loads(tree)
    top = Node(root).get("kids", "children") if isinstance(root, dict) else None
    if not isinstance(top, list):
        raise ValueError("the root has no list of blocks")
    for pos, raw in enumerate(top):
        if not isinstance(raw, dict):
            continue
        node = Node(raw)
        kind = node.kind() or "unknown"
        level = plain(node.get("heading level", "level")) if kind == "heading" else None
        bbox, sound = box(node)
        grid = table_parts(node) if kind == "table" else {}
        content = grid["markdown"] if grid else list_text(node) if kind == "list" else "" if kind == "image" else node_text(node)
        flaws = sum(grid.get(k, 0) for k in ("invalid", "collisions", "missing"))
        codes = [] if sound else ["invalid_source_bbox"]
        codes += ["table_grid_mapping_failed"] if grid and (flaws or grid["actual_rows"] != grid["rows"]) else []
        codes += ["empty_mapped_source_block"] if not content and kind != "image" else []
        source = node.get("source")
        kind_of = "TITLE" if level is not None and level.casefold() == TITLE_LEVEL else TYPES.get(kind, "UNKNOWN")
        yield {
            "pos": pos, "kind": kind, "type": kind_of, "page": whole(node.get("page number", "page")), "level": level, "content": content, "source": source if isinstance(source, str) else None,
            "bbox": bbox, "codes": codes, "rows": grid.get("rows"), "cols": grid.get("cols"), "merged": grid.get("merged"), "flaws": flaws if grid else None,
        }


def _mapped(trees: pd.Series) -> pd.Series:
    def one(t: str | None) -> list[dict] | None:
        try:
            return None if t is None else list(blocks(t))
        except ValueError:
            return None

    return trees.map(one)


def mapped(trees: Column) -> Column:
    """``blocks`` of each JSON text, as an array of BLOCK; a null or unsound tree gives null."""
    return F.pandas_udf(_mapped, T.ArrayType(T.StructType.fromDDL(BLOCK)))(trees)


def tree_elements(documents: DataFrame) -> DataFrame:
    """Elements of ``documents`` (doc_id, source_sha256, tree): element_id, anchor_id, doc_id, pos, page, type, content, path, bbox and the block's other columns; blocks without text are left out."""
    rows = documents.select("doc_id", "source_sha256", F.explode(mapped(F.col("tree"))).alias("b")).select("doc_id", "source_sha256", "b.*")
    paths = E.heading_paths(rows.where((F.col("content") != "") | ~F.col("type").isin("TITLE", "HEADING")).select("doc_id", "pos", "type", "content"))
    kept = rows.where((F.col("content") != "") | (F.col("type") == "IMAGE")).join(paths, ["doc_id", "pos"])
    name = lambda p: ids.digest_id(p, F.col("source_sha256"), F.col("pos"), F.col("page"), F.col("kind"))
    return kept.select(name("element").alias("element_id"), name("anchor").alias("anchor_id"), "doc_id", "source_sha256", "pos", "page", "type", "kind", "content", "path", "bbox", "level", "source", "rows", "cols", "merged", "flaws")


def tree_issues(documents: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, pos, page, code of blocks that can't be mapped without loss; ``images`` (doc_id, path) are the files that image blocks may name."""
    rows = documents.select("doc_id", F.explode(mapped(F.col("tree"))).alias("b")).select("doc_id", "b.*")
    found = rows.select("doc_id", "pos", "page", F.explode("codes").alias("code"))
    asked = rows.where("type = 'IMAGE'").select("doc_id", "page", F.struct("doc_id", "pos").alias("ref_id"), F.coalesce("source", F.lit("")).alias("path"))
    there = _by_document(asked, images)
    lost = asked.join(there, "ref_id").where("file IS NULL").select("ref_id.doc_id", "ref_id.pos", "page", F.lit("unresolved_image_reference").alias("code"))
    return found.unionByName(lost)


def _by_document(asked: DataFrame, images: DataFrame) -> DataFrame:
    """ref_id, file: ``merging.image_files`` within each document."""
    tag = lambda c: F.concat("doc_id", F.lit("\u001f/"), c)
    base = merging.image_files(asked.select("ref_id", tag("path").alias("path")), images.select(tag("path").alias("path")), F.regexp_extract("path", "^([^\u001f]*)", 1))
    return base.select("ref_id", F.col("path").alias("file"))


def tree_assets(images: DataFrame, elements: DataFrame, policies: DataFrame) -> DataFrame:
    """asset_id, doc_id, content_sha256, paths, elements, classification, role, indexable: a document's image files by content, the elements that refer to them, and the policy of their content.

    ``images`` has doc_id, path, sha256; ``policies`` content_sha256, classification, role, indexable; content without one is UNKNOWN and not indexable."""
    held = images.groupBy("doc_id", F.col("sha256").alias("content_sha256")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    refs = elements.where("type = 'IMAGE'").select("doc_id", F.struct("doc_id", "element_id").alias("ref_id"), F.coalesce("source", F.lit("")).alias("path"))
    found = _by_document(refs, images).where("file IS NOT NULL").select("ref_id.doc_id", "ref_id.element_id", F.regexp_extract("file", "\u001f/(.*)$", 1).alias("path"))
    per = found.join(images, ["doc_id", "path"]).groupBy("doc_id", F.col("sha256").alias("content_sha256")).agg(F.array_sort(F.collect_set("element_id")).alias("elements"))
    out = held.join(per, ["doc_id", "content_sha256"], "left").join(policies, "content_sha256", "left")
    return out.select(
        ids.digest_id("asset", F.col("doc_id"), F.col("content_sha256")).alias("asset_id"), "doc_id", "content_sha256", "paths", F.coalesce("elements", F.array().cast("array<string>")).alias("elements"),
        F.coalesce("classification", F.lit("UNKNOWN")).alias("classification"), F.coalesce("role", F.lit("UNKNOWN")).alias("role"), F.coalesce("indexable", F.lit(False)).alias("indexable"),
    )
