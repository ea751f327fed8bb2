"""Operators that SQL can't check, against plain loops and the fixtures of the survey."""

import io
import json
import random
import re
import statistics
import zipfile

import pytest
from urllib.parse import unquote
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import geometry, ids, text
from paperloom.operators import catalog, chunking, math_pages, merging, ocr, resolve
from paperloom.sources import files
from paperloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_names_and_codes(spark):
    cases = {
        "Quy chế lựa chọn nhà thầu.pdf": ("quy che lua chon nha thau", None),
        "QT.TCKT.01 - QT QL VAT TU.pdf": ("qt tckt 01 qt ql vat tu", "qt-tckt-01"),
        "QD 171100920181630437521ID627.pdf": ("qd 171100920181630437521id627", "id627"),
        "34 HDQT Quy che lua chon nha thau.pdf": ("34 hdqt quy che lua chon nha thau", "34-hdqt"),
        "Đặc biệt đ QD-12.docx": ("dac biet d qd 12", "qd-12"),
        ".hidden": ("hidden", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string").withColumn("f", text.ascii_fold(text.stem(F.col("n"))))
    for r in df.select("n", text.normalized_name(F.col("f")).alias("a"), text.document_code(F.col("f")).alias("b")).collect():
        assert (r["a"], r["b"]) == cases[r["n"]], r


def test_uuid5(spark):
    import uuid

    for x in ("", "abc", "Đường/ü.pdf"):
        assert one(spark, x, ids.uuid5_hex) == uuid.uuid5(uuid.NAMESPACE_URL, x).hex


def test_text_forms(spark):
    assert one(spark, " a \n b\t", text.compact) == "a b"
    assert one(spark, "\n\na\r\nb\t \r\n\n", text.structured) == "a\nb"
    assert one(spark, "x\n\n\n\n- • y  \n", text.clean_markdown) == "x\n\n- y\n"
    assert one(spark, "", text.clean_markdown) == ""
    assert one(spark, "don’t stop, now!", text.token_count) == 5
    assert one(spark, "14", lambda c: text.roman(c.cast("int"))) == "xiv"
    assert one(spark, "1994", lambda c: text.roman(c.cast("int"))) == "mcmxciv"
    assert one(spark, "28", lambda c: text.alphabetic(c.cast("int"))) == "ab"
    assert [one(spark, x, text.lenient_int) for x in ("3", "3.0", "3.5", "true", "x")] == [3, 3, None, None, None]
    assert one(spark, "| a \\| b | c |", text.cells) == ["a \\| b", "c"]
    assert one(spark, "AbC d1", text.uppercase_ratio) == 0.5


def test_geometry(spark):
    r = spark.sql("SELECT array(0.5D, 2.5D, 3.5D) xs, array(1.0D, 9.4D, 2D) ys").select(geometry.box_of_points(F.col("xs"), F.col("ys")).alias("b")).first()["b"]
    assert tuple(r) == (0, 1, 4, 9)


@pytest.fixture(scope="module")
def known(spark):
    rows = [("fa", "fa-v001", "s1", "qt-a-1", "mua sam vat tu"), ("fb", "fb-v001", "s2", "id5", "quy che tai chinh"), ("fc", "fc-v001", "s3", "id5", "quy che nhan su"), ("fa", "fa-v002", "s4", "qt-a-1", "mua sam vat tu")]
    return spark.createDataFrame(rows, "family_id string, version_id string, sha256 string, document_code string, normalized_name string")


def test_resolution_rules(spark, known):
    rows = [("c1", "s1", None, "renamed", "f"), ("c2", "n1", "qt-a-1", "other", "f"), ("c3", "n2", "id5", "x", "f"), ("c4", "n3", None, "mua sam vat tu", "f"), ("c5", "n4", None, "quy che tai chinh moi", "doc-x"), ("c6", "n5", "qd-9", "new thing", "qd-9"), ("c7", "n6", None, "wholly different", "doc-y")]
    entries = spark.createDataFrame(rows, "catalog_id string, sha256 string, document_code string, normalized_name string, family_id string")
    got = {r["catalog_id"]: r for r in resolve.resolve(entries, known, resolve.name_scores(entries, known)).collect()}
    want = {"c1": ("SAME_VERSION", "fa", 1.0), "c2": ("NEW_VERSION", "fa", 0.98), "c3": ("CONFLICT", None, 0.98), "c4": ("NEW_VERSION", "fa", 0.93), "c5": ("CONFLICT", None, 1.0), "c6": ("UNRELATED", "qd-9", 1.0), "c7": ("UNRELATED", "doc-y", 0.8)}
    assert {k: (r["outcome"], r["family_id"], r["confidence"]) for k, r in got.items()} == want
    assert got["c1"]["matched_version_id"] == "fa-v001" and got["c3"]["candidate_family_ids"] == ["fb", "fc"] and got["c5"]["candidate_family_ids"] == ["fb"]


def test_name_scores_lose_no_pair(spark, known):
    rng = random.Random(1)
    words = ["quy", "che", "tai", "chinh", "mua", "sam", "vat", "tu", "nhan", "su"]
    names = {" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)}
    entries = spark.createDataFrame([(n, n) for n in names], "catalog_id string, normalized_name string")
    got = {(r["catalog_id"], r["family_id"]): r["score"] for r in resolve.name_scores(entries, known).collect()}
    want = {}
    for n in names:
        for f, m in {(r["family_id"], r["normalized_name"]) for r in known.collect()}:
            if (s := resolve.token_set_ratio(n, m)) >= 87:
                want[n, f] = max(s, want.get((n, f), 0))
    assert got == want


def test_split_ranges_cover_and_stop_at_sentences():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choices(["word ", "it’s ", "x. ", "y\n", "! ", "  ", "é"], k=rng.randint(0, 80)))
        parts = chunking.split_ranges(t, 10)
        assert parts[0][0] == 0 and parts[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(n <= 10 and n == len(re.findall(r"\w+(?:['’]\w+)*|[^\w\s]", t[a:b])) for a, b, n in parts)
    assert chunking.split_ranges("a b c d e f g. h i j k", 10)[0][2] == 8


def test_grouping_by_loop(spark):
    rng = random.Random(3)
    rows = [(d, p, 0, rng.choice(["PARAGRAPH", "PARAGRAPH", "HEADING", "TABLE"]), [rng.choice("ab")], rng.randint(1, 50)) for d in range(6) for p in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, part int, type string, path array<string>, tokens int")
    got = {(r["doc_id"], r["pos"]): r["chunk"] for r in chunking.group(df, 60).collect()}
    for d in range(6):
        chunk, size, closed, path = 0, 0, True, None
        for _, p, _, kind, own, n in [r for r in rows if r[0] == d]:
            alone = kind == "TABLE"
            if closed or alone or kind == "HEADING" or own != path or size + n > 60:
                chunk, size = chunk + 1, 0
            size, closed, path = size + n, alone or n > 60, own
            assert got[d, p] == chunk


def test_rows_by_loop(spark):
    boxes = [(1, 1, "b", 0.9, 50, 10, 90, 22), (1, 2, "a", 0.5, 0, 12, 40, 24), (1, 3, "next", 1.0, 0, 40, 60, 52), (1, 4, "far", 1.0, 0, 200, 60, 212), (2, 5, "only", 0.2, 5, 5, 9, 9)]
    df = spark.createDataFrame(boxes, "page int, det_id long, text string, confidence double, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r["page"], r["row"], r["text"], r["centre"]) for r in ocr.cluster_rows(df).collect())
    assert got == [(1, 0, "a b", statistics.median([16, 18])), (1, 1, "next", 46.0), (1, 2, "far", 206.0), (2, 0, "only", 7.0)]
    marked = ocr.paragraphs(ocr.row_markdown(ocr.cluster_rows(df), 100))
    assert [r["markdown"] for r in marked.where("page = 1").orderBy("nth").collect()] == ["a b", "next", "far"]


def test_math_pages(spark):
    page = "Câu 1\nA. x\nB. y\nB. z\n\\begin{matrix}\nCâu 1:\n1 2 3\n\n4 5 6\nT T\n[Hướng dẫn giải]\nA. B. twice"
    df = spark.createDataFrame([(1, 1, page), (1, 2, "plain text that is long enough to pass")], "doc_id int, page int, markdown string")
    r = {r["page"]: r for r in math_pages.risk(df).collect()}
    assert r[1]["reasons"].split(",") == ["question_numbering", "math_or_matrix_terms", "multiple_choice_options", "duplicate_option_prefix", "noncanonical_option_order", "orphan_matrix_glyph", "flattened_numeric_grid", "inconsistent_solution_heading"]
    assert r[1]["score"] == 3 + 1 + 2 + 5 + 4 + 4 + 3 + 2 and r[2]["score"] == 0
    assert [x["page"] for x in math_pages.flagged(math_pages.risk(df), k=8).collect()] == [1]
    codes = {x["page"]: x["codes"] for x in math_pages.errors(df).collect()}
    assert codes[1].split(",") == ["duplicate_option_prefix", "noncanonical_option_order", "orphan_matrix_glyph", "duplicate_question_block", "unbalanced_matrix"] and codes[2] == ""
    assert one(spark, "```md\nCâu 2.\n a. x \n```", math_pages.normalized) == "## Câu 2\n- **A.** x\n"


def test_repeated_sentence_is_runaway(spark):
    df = spark.createDataFrame([(1, 1, "\n".join(["the same long sentence again and again and again"] * 101)), (1, 2, "the same long sentence again and again and again")], "doc_id int, page int, markdown string")
    assert [(r["page"], r["code"]) for r in math_pages.runaway(df).orderBy("code").collect()] == [(1, "runaway_repeated_block"), (1, "runaway_repeated_line")]


def test_jsonl(spark, tmp_path):
    schema = T.StructType.fromDDL("a long, b string")
    path = f"{tmp_path}/x"
    files.write_jsonl(spark.createDataFrame([(1, "é"), (None, None)], schema), path)
    assert sorted(map(tuple, files.read_jsonl(spark, path, schema).collect()), key=str) == [(1, "é"), (None, None)]
    with pytest.raises(Exception, match="already exists"):
        files.write_jsonl(spark.createDataFrame([(1, "x")], schema), path)
    (tmp_path / "bad.json").write_text('{"a": 1, "c": 2}\n\nnot json\n')
    assert sorted(r["unexpected"][0] for r in files.bad_lines(spark, f"{tmp_path}/bad.json", schema).collect()) == ["c", "not_an_object"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/bad.json", schema).collect()
    with pytest.raises(ValueError, match="b"):
        spark.createDataFrame([(1, 2)], "a long, b long").write.parquet(f"{tmp_path}/p")
        files.read_table(spark, f"{tmp_path}/p", schema)


def test_commits(spark, tmp_path):
    a, b = spark.range(5).toDF("x"), spark.createDataFrame([("é", 1)], "s string, n int")
    files.write_commit({"a": a, "b": b}, f"{tmp_path}/run")
    got = files.read_commit(spark, f"{tmp_path}/run", ["a", "b"])
    files.verify_recomputed(got["a"], a)
    with pytest.raises(ValueError):
        files.verify_recomputed(got["a"], spark.range(4).toDF("x"))
    (tmp_path / "run" / "a" / "part-extra.parquet").write_bytes(b"x")
    with pytest.raises(ValueError, match="unexpected"):
        files.read_commit(spark, f"{tmp_path}/run", ["a", "b"])


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(paragraphs)}</w:body></w:document>")
    return out.getvalue()


def p(t, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"


def test_docx_scan_and_catalog(spark, tmp_path):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = [p("T", '<w:pStyle w:val="Title"/>'), p("H", '<w:pStyle w:val="Heading2"/>'), p(""), p("text", "<w:sectPr/>"), p("item", "<w:numPr/>"), f"<w:tbl><w:tr>{cell('a')}{cell('b|c')}</w:tr><w:tr>{cell('d')}</w:tr></w:tbl>"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Á b.docx").write_bytes(docx(*body))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "~$lock.docx").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"x")
    (tmp_path / "empty.pdf").write_bytes(b"")
    found = catalog.scan(spark, f"{tmp_path}")
    assert [r["source_path"] for r in found.collect()] == ["bad.docx", "sub/Á b.docx"]
    assert [r["source_path"] for r in catalog.scan(spark, f"{tmp_path}", recursive=False).collect()] == ["bad.docx"]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(f"{tmp_path}").where("path NOT LIKE '%~%'")
    rows = files.read_docx(raw).collect()
    assert [(r["type"], r["level"], r["section"], r["content"]) for r in rows if "sub" in r["path"]] == [("TITLE", None, 0, "T"), ("HEADING", 2, 0, "H"), ("PARAGRAPH", None, 0, "text"), ("LIST", None, 1, "item"), ("TABLE", None, 1, "| a | b\\|c |\n| --- | --- |\n| d |  |")]
    assert [r["type"] for r in rows if "bad" in r["path"]] == ["ERROR"]
    facts = raw.select("path", files.upload_verdict(F.col("path"), F.col("length"), files.upload_facts(F.col("content"))).alias("v"))
    assert {unquote(r["path"].rsplit("/", 1)[1]): r["v"] for r in facts.collect()} == {"bad.docx": "not_a_docx", "Á b.docx": None}


def test_engines_and_routes(spark):
    df = spark.createDataFrame([("a", b"1", "X"), ("b", b"", "X")], "path string, content binary, route_type string")

    def engine(c):
        if not c:
            raise RuntimeError("empty")
        return "# md", "{}"

    got = {r["path"]: r for r in files.run_engine(df, engine, 2).collect()}
    assert got["a"]["markdown"] == "# md" and got["b"]["error"] == "RuntimeError: empty"
    assert files.extract(df, {"X": lambda d: files.run_engine(d, engine)}).count() == 2
    with pytest.raises(ValueError, match="no reader"):
        files.extract(df, {})


def test_tree_and_bundle():
    tree = json.dumps({"file name": "x", "number of pages": 2, "kids": [{"type": "Heading", "page number": "1", "heading level": 2, "content": "h", "kids": [{"TYPE": "list", "Page-Number": 2.0, "list items": [{"type": "list item", "content": "i"}]}]}, {"type": "image", "page_number": True}]})
    assert files.tree_nodes(tree) == [(0, None, 0, "heading", 1, "2", "h"), (1, 0, 1, "list", 2, None, None), (2, 1, 2, "list item", None, None, "i"), (3, None, 0, "image", None, None, None)]
    assert files.bundle({"b": b"2", "a": b"1"}) == files.bundle({"a": b"1", "b": b"2"})


def test_zip_and_differences(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "ordinal int, t string"), spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "ordinal int, t string")
    assert sorted(r["ordinal"] for r in chunking.zip_mismatches(a, b, ["t"]).collect()) == [1, 3]
    assert merging.differences(a, a).isEmpty()


def test_job_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(2):  # files arrive in order of events
        events.where((F.col("event_id") < 500) == F.lit(k == 0)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = []
    q = jobs.states(source, "NoTimeout").writeStream.outputMode("update").foreachBatch(lambda df, _: found.append({r["job"]: tuple(r) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    latest = {}
    for f in found:
        latest |= f
    assert latest == {r["job"]: tuple(r) for r in jobs.states_batch(events).collect()}


def test_ingest_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    run = lambda: jobs.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/c", lambda df, _: seen.extend(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())).awaitTermination(60)
    (tmp_path / "in" / "a.pdf").write_bytes(b"1")
    run()
    (tmp_path / "in" / "b.pdf").write_bytes(b"2")
    run()
    run()
    assert sorted(seen) == ["a.pdf", "b.pdf"]
