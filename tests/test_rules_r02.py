"""Rules by their documented values and by plain loops, where the registered queries' SQL can't reach."""

import hashlib
import io
import json
import random
import time
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import catalog, checks, chunking, math_pages, merging, ocr, route, versions
from paperloom.operators import elements as E
from paperloom.plans import registry
from paperloom.sources import files, trees

SF = "/root/testdata/sf0.001"


def test_routes(spark):
    kinds = ["PDF", "DOCX", "DOC", "IMAGE", "UNKNOWN"]
    assigned = spark.createDataFrame([(f"c{k}", f"v{k}", "s", "CREATE_VERSION") for k in range(5)] + [("c0", "v9", "x", "CREATE_VERSION"), ("c1", "v8", "s", "REUSE_VERSION")], "catalog_id string, version_id string, sha256 string, action string")
    catalog = spark.createDataFrame([(f"c{k}", f, "s") for k, f in enumerate(kinds)], "catalog_id string, file_format string, source_sha256 string")
    got = {(r["catalog_id"], r["version_id"]): (r["route_type"], r["primary_engine"], r["fallback_engines"], r["destination"]) for r in route.routes(assigned, catalog).collect()}
    assert got["c0", "v0"] == ("PDF_OPENDATALOADER", "OPENDATALOADER_LOCAL", "OPENDATALOADER_HYBRID,MINERU", "extract")
    assert got["c2", "v2"] == ("DOC_CONVERT", "LIBREOFFICE", "MANUAL", "extract") and got["c3", "v3"] == ("IMAGE_VISUAL", "QWEN3_VL", "MANUAL", "extract")
    assert got["c4", "v4"] == ("UNSUPPORTED", "MANUAL", "", "unsupported") and got["c0", "v9"][3] == "mismatch" and got["c1", "v8"][3] == "reused"


def test_foreign_content_is_refused(spark):
    known = spark.createDataFrame([("f", "f-v001-s", "s1", 1, "ACTIVE")], "family_id string, version_id string, sha256 string, version_number int, publication_state string")
    decided = spark.createDataFrame([("c1", "d1", 1, "NEW_VERSION", "g", None, "s1"), ("c2", "d2", 2, "UNRELATED", "g", None, "s2"), ("c3", "d3", 3, "NEW_VERSION", "f", None, "s1")], "catalog_id string, decision_id string, pos int, outcome string, family_id string, matched_version_id string, sha256 string")
    assert [tuple(r) for r in versions.foreign_content(decided, known).collect()] == [("c1", "g", "s1", "f")]
    assert {r["catalog_id"]: r["action"] for r in versions.assign(decided, known).collect()} == {"c2": "CREATE_FAMILY_AND_VERSION", "c3": "REUSE_VERSION"}


def test_free_names_count_on(spark):
    rng = random.Random(3)
    names = ["a.pdf", "a.pdf", "a-1.pdf", "a-1.pdf", "a", "a-1", "a", ".x", ".x", "b.tar.gz", "b.tar.gz", "a-1-1.pdf", "a.pdf"] + [f"{rng.choice('ab')}{rng.choice(['', '-1', '-2', '-1-1'])}.pdf" for _ in range(25)]
    rows = [(f"{k:03}/{n}", n, f"s{k}") for k, n in enumerate(names)]
    taken, want = set(), {}
    for path, name, _ in rows:
        dot = name.rfind(".")
        stem, suffix = (name, "") if dot <= 0 else (name[:dot], name[dot:])
        k, free = 1, name
        while free in taken:
            free, k = f"{stem}-{k}{suffix}", k + 1
        taken.add(free)
        want[path] = free
    got = checks.free_names(spark.createDataFrame(rows, "path string, name string, sha256 string")).collect()
    assert {r["path"]: r["copy_name"] for r in got} == want


def test_graph_counts_edges_to_one_target(spark):
    def of(**payload):
        return json.dumps(payload)

    sound = of(nodes=[{"id": "a", "type": "Decision"}, {"id": "b"}], edges=[{"from": "a", "to": "b"}, {"source": "a", "target": "b"}])
    alone = of(nodes=[{"id": "a", "type": "decision"}, {"id": "b"}], edges=[{"from": "a", "to": "b"}, {"from": "a", "to": "z"}, {"from": "b", "to": "b"}])
    odd = of(nodes=[{"id": ""}, 3, {"id": "x"}, {"id": "x"}], edges=[7])
    df = spark.createDataFrame([(1, sound), (2, alone), (3, odd), (4, "{}")], "graph_id long, payload string")
    got = sorted((r["graph_id"], r["code"], r["id"]) for r in merging.graph_issues(*merging.graph_parts(df)).collect())
    assert got == [(2, "decision_branch_count_invalid", "a"), (2, "edge_endpoint_missing", "a>z"), (3, "duplicate_node_id", "x"), (3, "edge_not_object", ""), (3, "node_id_missing", ""), (3, "node_not_object", ""), (4, "edges_missing", ""), (4, "nodes_missing_or_empty", "")]


def test_page_rules(spark):
    same = "the very same line again and again"
    rows = [(1, k, 1, "PARAGRAPH", 1, same) for k in range(12)] + [(2, 0, 1, "PARAGRAPH", 1, "short"), (2, 1, 2, "TABLE", 1, "| a |\n| --- |\n| b |"), (2, 2, 2, "TABLE", 1, "| a |"), (3, 0, 1, "IMAGE", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, page int, type string, level int, content string")
    scopes = df.select("doc_id", "page").distinct().unionByName(spark.createDataFrame([(3, 2)], "doc_id long, page int"))
    got = sorted((r["doc_id"], r["page"], r["code"]) for r in E.page_issues(df, scopes).collect())
    assert got == [(1, 1, "page_text_repetition_abnormal"), (2, 1, "page_text_too_short"), (2, 2, "table_grid_invalid"), (3, 2, "empty_page")]
    issues = E.page_issues(df, scopes).withColumn("severity", F.lit("ERROR")).withColumn("fallback", F.lit(False))
    assert {r["disposition"] for r in E.report(df.select("doc_id").distinct(), issues).collect()} == {"QUARANTINE_REQUIRED"}


def test_letter_case_and_composition(spark):
    said = ["CÂU 12\nA. một\nB. hai\nC. ba\nD. bốn", "câu 3", "HƯỚNG DẪN GIẢI", "[hướng DẪN giải]", "β1 2 3", "x"]
    df = spark.createDataFrame([(k, 1, unicodedata.normalize(f, t)) for k, t in enumerate(said) for f in ("NFC", "NFD")][::2] + [(9, 1, unicodedata.normalize("NFD", said[0]))], "doc_id int, page int, markdown string")
    risk = {r["doc_id"]: r for r in math_pages.risk(df).collect()}
    assert risk[0]["questions"] == 1 and risk[1]["questions"] == 1 and risk[9]["questions"] == 1 and risk[9]["score"] == risk[0]["score"]
    fixed = {r["doc_id"]: r["n"] for r in df.select("doc_id", math_pages.normalized(F.col("markdown")).alias("n")).collect()}
    assert fixed[2] == fixed[3] == "### [Hướng dẫn giải]\n" and fixed[1] == "## Câu 3\n"
    assert df.where("doc_id = 4").select(F.size(math_pages.occurrences(F.col("markdown"), f"({math_pages.NUMBER})")).alias("n")).first()["n"] == 2


def test_list_markers(spark):
    asked = [("", 3), ("Unordered list", 3), ("english letters", 28), ("English letters, upper case", 703), ("english letters", 0), ("Roman numbers, upper case", 1994), ("roman", 0), ("roman", 4001), ("anything", 7), ("english letters", 475255)]
    df = spark.createDataFrame(asked, "s string, n long").select(text.list_marker(F.col("s"), F.col("n")).alias("m"))
    assert [r["m"] for r in df.collect()] == ["-", "-", "ab.", "AAA.", "a.", "mcmxciv.", "i.", "mmmmi.", "7.", "aaaaa."]
    assert [trees.marker(s, n) for s, n in asked if n] == ["-", "-", "ab.", "AAA.", "mcmxciv.", "mmmmi.", "7.", "aaaaa."]


def test_chunk_ids_by_json(spark):
    contents = ['Say "it"\t\\ \x0b \x1f é 😀 \\u000B', "second / part\nof two", "x"]
    rows = [(1, k, 0, "PARAGRAPH", ["A", "B"], 0, len(c), 3, c, 1, "fam", "sha") for k, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, part int, type string, path array<string>, start int, end int, tokens int, content string, chunk int, family_id string, source_sha256 string")
    got = chunking.chunks(chunking.segment_ids(df)).first()

    def name(of, *parts):
        return f"{of}-{hashlib.sha256('|'.join(map(str, parts)).encode()).hexdigest()[:24]}"

    segments = [{"block_id": name("block", "sha", k), "source_element_id": name("element", "sha", k, "PARAGRAPH"), "element_type": "PARAGRAPH", "normalized_span_id": name("span", "sha", k, "PARAGRAPH"), "source_anchor_id": name("anchor", "sha", k, "PARAGRAPH"), "char_start": 0, "char_end": len(c), "raw_sha256": hashlib.sha256(c.encode()).hexdigest()} for k, c in enumerate(contents)]
    payload = {"source_sha256": "sha", "heading_path": ["A", "B"], "text": "\n\n".join(contents), "segments": segments}
    digest = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got["text"] == payload["text"] and got["chunk_id"] == f"fam#semantic-{digest[:32]}"


def test_trees():
    def doc(*kids):
        return json.dumps({"kids": list(kids)})

    table = {"type": "table", "number of rows": 2, "number of columns": "2", "rows": [{"cells": [{"row number": 0, "column number": 0, "row span": 2, "content": "a|b"}, {"row number": 0, "column number": 1, "kids": [{"type": "paragraph", "content": "x"}, {"type": "paragraph", "content": "X"}, {"type": "paragraph", "content": "y"}]}]}, {"cells": [{"row number": 1, "column number": 1, "content": ""}, {"row number": 1, "column number": 5}]}]}
    (got,) = trees.blocks(doc(table))
    assert got["content"] == "| a\\|b | x<br>y |\n| --- | --- |\n|  |  |" and (got["merged"], got["flaws"]) == (1, 1) and got["codes"] == ["table_grid_mapping_failed"]
    nested = {"TYPE": "List", "numbering-style": "english letters", "list items": [{"content": "one", "kids": [{"type": "paragraph", "content": "more"}, {"type": "list", "list items": [{"content": "in"}]}]}, {"content": " one\n two "}, "no item", {}]}
    (got,) = trees.blocks(doc(nested))
    assert got["content"] == "a. one\n  more\n  - in\nb. one two\nd."
    got = list(trees.blocks(doc(3, {"type": "heading", "heading level": "DocTitle", "content": "T", "bbox": [0, 0, 1, 1]}, {"type": "paragraph", "bounding box": [0, 0, 0, 1], "page": True}, {"type": "odd", "text": "t", "page": "2.0"})))
    assert [(g["pos"], g["type"], g["page"], g["bbox"], g["codes"]) for g in got] == [(1, "TITLE", None, [0, 0, 1, 1], []), (2, "PARAGRAPH", None, None, ["invalid_source_bbox", "empty_mapped_source_block"]), (3, "UNKNOWN", 2, None, [])]
    with pytest.raises(ValueError):
        list(trees.blocks("{}"))


def test_docx_margins_tables_and_images(spark):
    w, r = ('xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"')
    p = lambda t, more="": f"<w:p>{more}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    end = lambda *refs: "<w:sectPr>" + "".join(f'<w:{tag}Reference w:type="{use}" r:id="{i}"/>' for tag, use, i in refs) + "</w:sectPr>"
    table = f"""<w:tbl><w:tr>{cell("a", '<w:gridSpan w:val="2"/>')}</w:tr><w:tr>{cell("b", '<w:vMerge w:val="restart"/>')}{cell("c")}</w:tr><w:tr>{cell("gone", "<w:vMerge/>")}{cell("d")}</w:tr></w:tbl>"""
    blip = '<w:p><w:r><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="i1"/></w:r></w:p>'
    body = p("one", f"<w:pPr>{end(('header', 'default', 'h1'), ('footer', 'default', 'f1'))}</w:pPr>") + table + blip + blip + p("two") + end(("header", "first", "h1"), ("footer", "default", "f1"))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w} {r}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="h1" Target="header1.xml"/><Relationship Id="f1" Target="footer1.xml"/><Relationship Id="i1" Target="media/image1.png"/></Relationships>')
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('Head')}{p('Head')}{p(' ')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{p('Foot')}</w:ftr>")
        z.writestr("word/media/image1.png", b"png")
    df = spark.createDataFrame([("x.docx", raw.getvalue()), ("bad.docx", b"no")], "path string, content binary")
    got = [(r["type"], r["section"], r["content"]) for r in files.read_docx(df).where("path = 'x.docx'").orderBy("pos").collect()]
    assert got == [("PARAGRAPH", 0, "one"), ("TABLE", 1, "| a |  |\n| --- | --- |\n| b | c |\n|  | d |"), ("PARAGRAPH", 1, "two"), ("HEADER", 0, "Head"), ("FOOTER", 0, "Foot"), ("HEADER", 1, "Head")]
    assert [tuple(r) for r in files.read_docx_assets(df).collect()] == [("x.docx", "word/media/image1.png", hashlib.sha256(b"png").hexdigest(), 3, 2)]


def test_engines_have_limits_and_are_asked_again(spark, tmp_path):
    df = spark.createDataFrame([("slow", b"s"), ("bad", b"b"), ("dies", b"d"), ("good", b"g")], "path string, content binary").coalesce(1)

    def engine(c):
        if c == b"s":
            time.sleep(60)
        if c == b"d":
            import os

            os._exit(3)
        if c == b"b" and not (tmp_path / "asked").exists():
            (tmp_path / "asked").write_text("x")
            return "�", "{}"
        return "# fine", "{}"

    began = time.time()
    got = {r["path"]: r for r in files.run_engine(df, engine, 2, 1.5, lambda m, t: ["replacement_character"] if "�" in m else []).collect()}
    assert time.time() - began < 40
    assert "TimeoutError" in got["slow"]["error"] and got["slow"]["attempts"] == 2 and "without a result" in got["dies"]["error"]
    assert (got["bad"]["markdown"], got["bad"]["attempts"]) == ("# fine", 2) and (got["good"]["markdown"], got["good"]["attempts"]) == ("# fine", 1)


def test_commits_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/run"
    files.write_commit({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("y")}, path)
    assert {n: t.count() for n, t in files.read_commit(spark, path, ["a", "b"]).items()} == {"a": 3, "b": 2}
    with pytest.raises(FileExistsError):
        files.write_commit({"a": spark.range(3).toDF("x")}, path)

    def fails(*_):
        raise ValueError("not as committed")

    monkeypatch.setattr(files, "read_commit", fails)
    with pytest.raises(ValueError):
        files.write_commit({"a": spark.range(3).toDF("x")}, f"{tmp_path}/other")
    assert [p.name for p in tmp_path.iterdir()] == ["run"]


def test_texts(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(text.structured(F.lit("\n\ne\u0301a\tb\r\n\tc  \n\n"))) == "éa  b\n  c" and one(text.structured(F.lit("ab\tc"))) == "ab  c" and one(text.structured(F.lit("a\tc"))) == "a c"
    assert one(text.clean_markdown(F.lit("* • a\n\n\n\nb  "))) == "- a\n\nb\n"
    assert one(text.page_list(F.lit("3,, 1 ,3"))) == [1, 3] and one(text.page_list(F.lit("0,1"))) is None and one(text.page_list(F.lit(" "))) is None
    assert one(text.display_name(F.lit("C:\\x\\Á b?.pdf"))) == "_ b_.pdf" and one(text.display_name(F.lit(None).cast("string"))) == "document"
    assert one(text.rewritten_markers(F.lit("1. 2. x\n4. 4. y"))) == "1. 2. x\n4. y"


def test_scan_stays_under_its_root(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "é a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.pdf").write_bytes(b"y")
    (tmp_path / "c.pdf").write_bytes(b"z")
    (tmp_path / "in" / "sub" / "link.pdf").symlink_to(tmp_path / "c.pdf")
    paths = lambda **more: [r["source_path"] for r in catalog.scan(spark, f"{tmp_path}/in", **more).collect()]
    assert paths() == ["b.pdf", "sub/é a.pdf"] and paths(part=f"{tmp_path}/in/sub") == ["sub/é a.pdf"]
    for outside in (f"{tmp_path}", f"{tmp_path}/in/../x", f"{tmp_path}/inside"):
        with pytest.raises(ValueError):
            paths(part=outside)


def test_signatures_are_no_headings(spark):
    said = ["ĐẠI DIỆN BÊN GIAO", "KT. giám đốc", "CHƯƠNG ABC", "người lập", "điều 5 x", "• a"]
    rows = [(1, k, 500, 600, 10.0, t) for k, t in enumerate(said)]
    df = spark.createDataFrame(rows, "page int, row int, x0 int, x1 int, height double, text string")
    got = [r["markdown"] for r in ocr.row_markdown(df, 5000).orderBy("row").collect()]
    assert got == ["ĐẠI DIỆN BÊN GIAO", "KT. giám đốc", "## CHƯƠNG ABC", "người lập", "## điều 5 x", "- a"]


def test_whole_tables_are_read(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", "\n"))).count()
    for name, column in (("semantic_groups", None), ("issue_scopes", None)):
        assert registry.QUERIES[name](spark, SF).count() == lines, (name, column)
