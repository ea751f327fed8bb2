"""The pipeline's stages: columns, effects, and groups against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_keep_columns_and_shrink(spark, stages):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    for k, after in enumerate(stages[:-1]):
        assert after.columns == COLUMNS
        assert after.join(before, "doc_id", "left_anti").count() == 0
        if k != 2:
            assert after.join(before, ["doc_id", "text"], "left_anti").count() == 0
        before = after
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_quality_stage_follows_the_labels(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = stages[0].join(labels, "doc_id").join(stages[1].select("doc_id", F.lit(True).alias("kept")), "doc_id", "left")
    good = judged.where("quality = 1")
    assert good.where("kept").count() >= 0.95 * good.count()


def test_one_document_of_each_group_stays(stages):
    from test_llm_operators import brute_components

    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {d for d, _, c in brute_components(rows, P.SHINGLE, P.SIMILAR) if d == c}
    assert {r["doc_id"] for r in stages[3].collect()} == want


def test_packed(stages):
    from test_llm_operators import _checked_packing

    rows = stages[-1].collect()
    for parts in _checked_packing(rows, P.SEQUENCE).values():
        assert len(parts) <= P.MOST_DOCS and sum(n * n for _, n in parts) <= P.MOST_ATTENTION
    assert max(r["length"] for r in rows) <= P.LONGEST
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[3].collect()}


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "the and of the and that", "en", "s", 5), (3, "the and of the\nand that", "en", "s", 5), (3, "the and of the\nand that", "en", "s", 5)]
    for name, rows in (("none", []), ("odd", odd)):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (3, 1, 0), (None, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = P.run(spark, d)
        assert got.count() <= len(rows)


def test_null_and_repeated_ids(spark):
    """Rows are judged one by one: an odd row elsewhere changes nothing for the rest."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "wvu")
    rows = [(1, a), (1, a), (None, a + " x"), (None, b), (1, b + " y"), (7, "alone"), (7, "alone"), (8, "alone too now"), (30, c), (20, c + " z"), (25, c)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), k, "extra") for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, known int, row string")
    got = P.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(1, a), (1, b + " y"), (7, "alone"), (8, "alone too now"), (20, c + " z")])


def test_long_texts_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    longest = docs.orderBy(F.length("text").desc()).limit(1).withColumns({"doc_id": F.lit(10**9), "text": F.repeat("text", 3), "lang": F.lit(None).cast("string")})
    more = {c: F.lit(1) for c in ("score", "lang_pred", "quality_score", "known", "text_hash", "row", "h", "first", "kept", "bucket", "_lines")}
    docs.unionByName(longest).withColumns(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in got}) > 0.5 * docs.count()


def test_gibberish_and_unlearned_languages_go(spark):
    import random

    rng = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=600)) for _ in range(10)]
    odd += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."]
    rows = docs.unionByName(spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(odd)], docs.schema))
    kept = P.language(spark, rows, SF)
    assert kept.where("doc_id >= 1000000").count() == 0
    assert kept.count() >= 0.97 * docs.where("text RLIKE '[a-z]'").count()


def test_clean_removes_what_was_written(spark):
    from paperloom.llm import shared

    kept, shared._made[:] = list(shared._made), []
    table = shared.written(spark.range(3).toDF("x"), "test")
    assert table.count() == 3
    path = shared._made[0]
    shared.clean(spark)
    shared._made[:] = kept
    try:
        spark.read.parquet(path)
        raise AssertionError("still there")
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e)
