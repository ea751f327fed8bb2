"""Sources and sinks: JSON lines, committed runs, documents, extractor trees, bundles."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import multiprocessing
import os
import re
import signal
import uuid
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import merging


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped, a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """line, unexpected: lines that are no JSON object or have keys the schema doesn't."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    extra = F.array_except(keys, F.array(*[F.lit(f.name) for f in schema.fields]))
    return lines.select(F.col("value").alias("line"), F.when(keys.isNull(), F.array(F.lit("not_an_object"))).otherwise(extra).alias("unexpected")).where(F.size("unexpected") > 0)


def write_jsonl(frame: DataFrame, path: str) -> None:
    """New files only; Spark's commit makes them visible together."""
    frame.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A typed Parquet table; a missing column or other type is an error, not a null."""
    found = spark.read.parquet(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in found.schema}
    if wrong := [f.name for f in wanted if have.get(f.name) != f.dataType]:
        raise ValueError(f"{path}: columns {wrong} are missing or of another type")
    return found.select(*[f.name for f in wanted])


def write_commit(tables: dict[str, DataFrame], path: str) -> None:
    """A run's tables and their manifest, under a name of their own until all has been read back as written; only then the run has its path. Nothing is overwritten."""
    spark = next(iter(tables.values())).sparkSession
    place, staged = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(place):
        raise FileExistsError(f"{path} is committed already")
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        for name, frame in tables.items():
            frame.write.mode("errorifexists").parquet(f"{staged}/{name}")
        inventory(spark, staged, list(tables)).coalesce(1).write.mode("errorifexists").json(f"{staged}/manifest")
        read_commit(spark, staged, list(tables))
        if not system.rename(hidden, place):
            raise FileExistsError(f"{path} could not be committed")
    finally:
        system.delete(hidden, True)


def inventory(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """path (within the run), size, sha256 of the artifacts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load([f"{path}/{n}" for n in names])
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_commit(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a committed run whose files are those of its manifest, byte for byte."""
    manifest = spark.read.schema("path string, size long, sha256 string").json(f"{path}/manifest")
    if bad := merging.inventory_diff(manifest, inventory(spark, path, names)).limit(5).collect():
        raise ValueError(f"{path} is not as committed: {[(r['path'], r['difference']) for r in bad]}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def verify_recomputed(stored: DataFrame, recomputed: DataFrame) -> None:
    """Raises unless the stored stage equals what its input gives now."""
    if not merging.differences(stored, recomputed).isEmpty():
        raise ValueError("the stored stage is not what its input gives")


#: Facts about an upload; the limits are predicates on them.
FACTS = "kind string, members long, total long, largest long, ratio double, document boolean"


def upload_facts(content: Column) -> Column:
    """What a file is by its bytes, and the sizes its archive claims."""
    return F.pandas_udf(_facts, T.StructType.fromDDL(FACTS))(content)


def _facts(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        kind = "pdf" if c[:5] == b"%PDF-" else "zip" if zipfile.is_zipfile(io.BytesIO(c)) else "other"
        sizes, packed, names = [], 0, set()
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                sizes, packed, names = [i.file_size for i in z.infolist()], sum(i.compress_size for i in z.infolist()), set(z.namelist())
        rows.append((kind, len(sizes), sum(sizes), max(sizes, default=0), sum(sizes) / max(1, packed) if sizes else 0.0, "word/document.xml" in names and "[Content_Types].xml" in names))
    return pd.DataFrame(rows, columns=["kind", "members", "total", "largest", "ratio", "document"])


def upload_verdict(name: Column, size: Column, facts: Column, most: int = 100_000_000) -> Column:
    """Why an upload is refused, or null."""
    pdf, docx = F.endswith(F.lower(name), F.lit(".pdf")), F.endswith(F.lower(name), F.lit(".docx"))
    return (
        F.when(~(pdf | docx), "unsupported_suffix").when(size > most, "too_large").when(size == 0, "empty").when(pdf & (facts["kind"] != "pdf"), "not_a_pdf").when(docx & ~((facts["kind"] == "zip") & facts["document"]), "not_a_docx")
        .when((facts["members"] > 10_000) | (facts["total"] > 500_000_000) | (facts["largest"] > 100_000_000) | (facts["ratio"] > 250), "archive_limits")
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
DOCX_ROWS = "pos int, type string, level int, section int, content string"
#: What a section's headers and footers are for, in the order in which they count.
_MARGINS = [(tag, use) for tag in ("header", "footer") for use in ("default", "first", "even")]


def _docx_text(e: ElementTree.Element) -> str:
    marks = {f"{_W}br": "\n", f"{_W}tab": "\t"}
    return "".join(marks.get(t.tag) or t.text or "" for t in e.iter() if t.tag in (f"{_W}t", *marks)).strip()


def _docx_table(table: ElementTree.Element) -> str:
    """GFM; a cell over several columns is followed by empty ones, one that goes on from above is empty."""
    rows = []
    for r in table.findall(f"{_W}tr"):
        cells: list[str] = []
        for c in r.findall(f"{_W}tc"):
            span, down = c.find(f"{_W}tcPr/{_W}gridSpan"), c.find(f"{_W}tcPr/{_W}vMerge")
            goes_on = down is not None and down.get(f"{_W}val") != "restart"
            cells.append("" if goes_on else _docx_text(c).replace("|", "\\|").replace("\n", "<br>"))
            cells += [""] * (int(span.get(f"{_W}val") or 1) - 1 if span is not None else 0)
        rows.append(cells)
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if width else ""


def _docx_parts(z: zipfile.ZipFile) -> dict[str, str]:
    """Id -> part, of the document's relations."""
    if "word/_rels/document.xml.rels" not in z.namelist():
        return {}
    return {r.get("Id"): "word/" + r.get("Target", "").removeprefix("/word/") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}


def docx_elements(content: bytes) -> list[tuple]:
    """(pos, type, level, section, content) of a DOCX body: headings by style or outline, lists, tables as GFM, paragraphs; then the texts of headers and footers, each once by its use and part.

    A section that names no header of its own goes on with the one before, which is there already."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        ends = [] if body is None else list(body.iter(f"{_W}sectPr"))
        parts, held = _docx_parts(z), set(z.namelist())
        named = [(s, tag, use, parts.get(ref.get(f"{_R}id"))) for s, end in enumerate(ends) for tag, use in _MARGINS for ref in end.findall(f"{_W}{tag}Reference") if ref.get(f"{_W}type", "default") == use]
        margins = {p: ElementTree.fromstring(z.read(p)) for _, _, _, p in named if p in held}
    out, section = [], 0
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style, outline, numbered = (e.find(f"{_W}pPr/{_W}{n}") for n in ("pStyle", "outlineLvl", "numPr"))
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            m, t = re.search(r"heading\s*(\d)", name), _docx_text(e)
            level = int(m[1]) if m else int(outline.get(f"{_W}val")) + 1 if outline is not None else None
            kind = "TITLE" if name == "title" else "HEADING" if level else "LIST" if numbered is not None or name.startswith("list") else "CAPTION" if "caption" in name else "PARAGRAPH"
            if t:
                out.append((len(out), kind, level, section, t))
            section += e.find(f"{_W}pPr/{_W}sectPr") is not None
        elif e.tag == f"{_W}tbl" and (t := _docx_table(e)):
            out.append((len(out), "TABLE", None, section, t))
    seen = set()
    for s, tag, use, part in named:
        for p in margins[part].iter(f"{_W}p") if part in margins else ():
            t = _docx_text(p)
            if t and (tag, use, part, t) not in seen:
                seen.add((tag, use, part, t))
                out.append((len(out), tag.upper(), None, s, t))
    return out


def docx_assets(content: bytes) -> list[tuple]:
    """(part, sha256, size, references) of the images in a DOCX body, in order of part."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts, held = _docx_parts(z), set(z.namelist())
        used = Counter(parts.get(b.get(f"{_R}embed")) for b in ElementTree.fromstring(z.read("word/document.xml")).iter(_BLIP))
        blobs = {p: z.read(p) for p in used if p in held}
    return [(p, hashlib.sha256(b).hexdigest(), len(b), used[p]) for p, b in sorted(blobs.items())]


def read_docx_assets(files: DataFrame) -> DataFrame:
    """path, part, sha256, size, refs of the images in the DOCX files of a binaryFile frame; damaged files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with contextlib.suppress(zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = [(path, *r) for r in docx_assets(content.as_py())]
                    yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(("path", "part", "sha256", "size", "refs"))}, schema=pa.schema([("path", pa.string()), ("part", pa.string()), ("sha256", pa.string()), ("size", pa.int64()), ("refs", pa.int32())]))

    return files.select("path", "content").mapInArrow(run, "path string, part string, sha256 string, size long, refs int")


def read_docx(files: DataFrame) -> DataFrame:
    """path and DOCX_ROWS of the DOCX files of a binaryFile frame; a damaged file gives one row of type ERROR."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, *r) for r in docx_elements(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, 0, "ERROR", None, 0, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "pos", "type", "level", "section", "content"]).astype({"level": "Int32"})

    return files.select("path", "content").mapInPandas(run, f"path string, {DOCX_ROWS}")


def extract(routed: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Elements of all routed files: each route's reader over its files, together; a route without a reader is an error."""
    if lost := [r["route_type"] for r in routed.select("route_type").distinct().collect() if r["route_type"] not in readers]:
        raise ValueError(f"no reader for {sorted(lost)}")
    parts = [reader(routed.where(F.col("route_type") == route)) for route, reader in readers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


NODE_ROWS = "node int, parent int, depth int, type string, page int, level string, content string"


def key_of(name: str) -> str:
    """A key without case, blanks, dashes and underscores."""
    return re.sub(r"[\s_-]+", "", name).lower()


def tree_nodes(tree: str) -> list[tuple]:
    """(node, parent, depth, type, page, level, content) of a JSON tree's typed nodes, parents first, in the order of the text."""
    out: list[tuple] = []

    def whole(x: object) -> int | None:
        return int(x) if not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer() or isinstance(x, str) and re.fullmatch(r"-?\d+", x.strip())) else None

    todo = [(json.loads(tree), None, 0)]
    while todo:
        x, parent, depth = todo.pop()
        if isinstance(x, list):
            todo += [(y, parent, depth) for y in reversed(x)]
        elif isinstance(x, dict):
            keys = {key_of(k): v for k, v in reversed(x.items())}
            if isinstance(keys.get("type"), str):
                level, content = keys.get("headinglevel"), keys.get("content")
                out.append((len(out), parent, depth, keys["type"].strip().lower(), whole(keys.get("pagenumber")), None if level is None else str(level), content if isinstance(content, str) else None))
                parent, depth = len(out) - 1, depth + 1
            todo += [(v, parent, depth) for v in reversed(x.values()) if isinstance(v, dict | list)]
    return out


def _walk(trees: pd.Series) -> pd.Series:
    names = [c.split(" ")[0] for c in NODE_ROWS.split(", ")]
    return trees.map(lambda t: None if t is None else [dict(zip(names, r, strict=True)) for r in tree_nodes(t)])


def walk_tree(trees: Column) -> Column:
    """tree_nodes of each JSON text, as an array of NODE_ROWS."""
    return F.pandas_udf(_walk, T.ArrayType(T.StructType.fromDDL(NODE_ROWS)))(trees)


def bundle(files: dict[str, bytes]) -> bytes:
    """A ZIP of a result's small files, the same bytes for the same content."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name), files[name])
    return out.getvalue()


def limited(engine: Callable[[bytes], tuple[str, str]], content: bytes, seconds: float | None) -> tuple[str, str]:
    """The engine's result; with a limit, in a process of its own group, which is killed with all that it started when the time is over."""
    if seconds is None:
        return engine(content)
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)

    def work() -> None:
        os.setsid()
        try:
            there.send((True, engine(content)))
        except BaseException as e:  # noqa: BLE001  handed to the parent
            there.send((False, f"{type(e).__name__}: {e}"))

    child = context.Process(target=work, daemon=True)
    child.start()
    there.close()
    try:
        if not here.poll(seconds):
            raise TimeoutError(f"no result in {seconds:g} s")
        sound, found = here.recv()
    except EOFError:
        raise RuntimeError("the engine ended without a result") from None
    finally:
        with contextlib.suppress(ProcessLookupError):
            os.killpg(child.pid, signal.SIGKILL)
        child.kill()
        child.join(5)
        here.close()
    if not sound:
        raise RuntimeError(found)
    return found


def run_engine(files: DataFrame, engine: Callable[[bytes], tuple[str, str]], attempts: int = 1, seconds: float | None = None, faults: Callable[[str, str], list[str]] | None = None) -> DataFrame:
    """path, markdown, tree, error, attempts: an engine plugged in over a binaryFile frame, with its failures as rows.

    A result with ``faults`` (names of what is wrong with it) counts as a failure and is asked for again, up to
    ``attempts`` times; ``seconds`` is the limit of one attempt.  Reads a file at a time."""

    def one(content: bytes) -> tuple:
        error = None
        for k in range(1, attempts + 1):
            try:
                markdown, tree = limited(engine, content, seconds)
                if not (wrong := faults(markdown, tree) if faults else []):
                    return markdown, tree, None, k
                error = f"faults: {', '.join(wrong)}"
            except Exception as e:  # the engine's own errors are data here
                error = f"{type(e).__name__}: {e}"[:400]
        return None, None, error, attempts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                row = (path, *one(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (*[pa.string()] * 4, pa.int32()), strict=True)], names=["path", "markdown", "tree", "error", "attempts"])

    return files.select("path", "content").mapInArrow(run, "path string, markdown string, tree string, error string, attempts int")
