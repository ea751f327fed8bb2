"""From ``documents`` to packed training sequences in five stages.

Each stage works on every row the one before kept, written as Parquet in the shared folder and
read again.  All but the last return the columns of ``documents``.

Null texts and texts without a letter go in the first stage; ``lang`` is read from learning rows only,
so its nulls keep nothing out.  Very long texts go through whole.  Empty tables give an empty result;
other columns of ``documents`` pass through to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import jaccard_trie, language_id, line_dedup, packing, quality_knn
from paperloom.llm.shared import clean, crc_rest, made, written

#: Documents under this language score, or without a letter, go: under all learned ones (0.42 at least of 5,000), over random letters (0.15 to 0.3) and unlearned languages (about 0.23).
LEAST_LANGUAGE = 0.33
#: Documents under this quality score go.
LEAST_QUALITY = 0.3
#: Words of a shingle and percent of Jaccard similarity of near duplicates.
SHINGLE, SIMILAR = 5, 80
SEQUENCE, END = 1024, 2
#: A sequence's other capacities, the longest piece, and the weights of tokens, pieces and attention.
MOST_DOCS, MOST_ATTENTION, LONGEST, WEIGHTS = 32, 6 * 1024 * 1024 // 10, 768, (1.0, 0.02, 0.05)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the labelled ones show."""
    profiles = language_id.fit(docs, crc_rest("doc_id", 4) != 2)
    judged = language_id.predict(docs, profiles)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the neighbours' vote scores low."""
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_rest("doc_id", 5) != 0)
    return quality_knn.predict(docs, model).where(F.col("quality_score") >= LEAST_QUALITY).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated and nearly repeated lines, and documents of which only white space stays; n_chars follows."""
    clean = line_dedup.dedup(docs).where(F.trim("text") != "")
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of least id of each group of near duplicates: null ids come last, rows that repeat an id go by a hash of the text, and of rows that repeat id and text one stays."""
    stays = jaccard_trie.representatives(docs, SHINGLE, SIMILAR)
    key = {"known": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long"))}
    # The columns travel in one struct, so that their names don't matter here.
    rows = docs.select(*[c.alias(n) for n, c in key.items()], F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    names = [*key, "text_hash"]
    one = rows.join(stays.select(*[c.alias(n) for n, c in key.items()], "text_hash").hint("merge"), names, "left_semi")
    return one.groupBy(*names).agg(F.any_value("row").alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of SEQUENCE tokens, MOST_DOCS pieces and MOST_ATTENTION of squared lengths."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END, SEQUENCE, MOST_DOCS, MOST_ATTENTION, LONGEST, WEIGHTS)


STAGES = [("language ID", language), ("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", pack)]

#: Profiles, votes and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        clean(spark, since, newest=1)  # nothing reads what this stage made on its way, nor the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
