"""Resolving arriving files against registered versions: rules from the strictest to a new family."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.functions import ids


def _families(index: DataFrame, key: str) -> DataFrame:
    """One row a key: its families in order, and the least version."""
    known = index.where(F.col(key).isNotNull())
    return known.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set("family_id")).alias("families"), F.min("version_id").alias("version"))


def _rule(families: Column, version: Column, outcome: str, reason: str, confidence: float) -> Column:
    """What a rule decides where it found families; null where it found none."""
    one = F.size(families) == 1
    return F.when(
        families.isNotNull(),
        F.struct(
            F.when(one, outcome).otherwise("CONFLICT").alias("outcome"),
            F.when(one, F.get(families, F.lit(0))).alias("family_id"),
            F.when(one & F.lit(outcome == "SAME_VERSION"), version).alias("matched_version_id"),
            F.when(one, F.array().cast("array<string>")).otherwise(families).alias("candidate_family_ids"),
            F.lit(confidence).alias("confidence"),
            F.when(one, reason).otherwise(reason + "_conflict").alias("reason_code"),
        ),
    )


def resolve(entries: DataFrame, index: DataFrame, scores: DataFrame | None = None, threshold: float = 90.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """entries (catalog_id, sha256, document_code, normalized_name, family_id proposed) -> one decision each, with the entry's columns named in ``keep``.

    Entries of the same path and content share a catalog_id, so what else is known of one can't be joined back by it.

    Rules: equal content, equal code, equal name, similar name (``scores`` of ``name_scores``: always a
    conflict for review), else a new family.  Index keys are grouped before the joins, which are ordinary
    equi-joins, so a key with many versions adds no rows."""
    by_sha, by_code, by_name = (_families(index, k) for k in ("sha256", "document_code", "normalized_name"))
    out = entries
    for name, by, key in (("sha", by_sha, F.col("sha256")), ("code", by_code, F.lower("document_code")), ("name", by_name, F.col("normalized_name"))):
        named = by.select(F.col("key").alias(f"{name}_key"), F.col("families").alias(f"{name}_families"), F.col("version").alias(f"{name}_version"))
        out = out.join(named, key == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    rules = [
        _rule(F.col("sha_families"), F.col("sha_version"), "SAME_VERSION", "exact_sha256_match", 1.0),
        _rule(F.col("code_families"), F.col("code_version"), "NEW_VERSION", "document_code_match", 0.98),
        _rule(F.col("name_families"), F.col("name_version"), "NEW_VERSION", "normalized_name_match", 0.93),
    ]
    if scores is not None:
        out = out.join(fuzzy_candidates(scores, threshold), "catalog_id", "left")
        rules.append(F.when(F.col("fuzzy").isNotNull(), F.struct(F.lit("CONFLICT").alias("outcome"), F.lit(None).cast("string").alias("family_id"), F.lit(None).cast("string").alias("matched_version_id"), F.col("fuzzy").alias("candidate_family_ids"), (F.col("best") / 100).alias("confidence"), F.lit("fuzzy_name_match_requires_review").alias("reason_code"))))
    rules.append(F.struct(F.lit("UNRELATED").alias("outcome"), F.col("family_id").alias("family_id"), F.lit(None).cast("string").alias("matched_version_id"), F.array().cast("array<string>").alias("candidate_family_ids"), F.when(F.col("document_code").isNotNull(), 1.0).otherwise(0.8).alias("confidence"), F.lit("no_known_family_match").alias("reason_code")))
    d = out.select("catalog_id", *keep, F.coalesce(*rules).alias("d")).select("catalog_id", *keep, "d.*").withColumn("requires_human_review", F.col("outcome") == "CONFLICT")
    return d.withColumn("decision_id", ids.prefixed_uuid("res", F.col("catalog_id"), F.col("outcome"), F.col("reason_code"), F.col("family_id"), F.array_join(F.array_sort("candidate_family_ids"), ",")))


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best indel similarity among the shared words and each side's words in order; 100 if one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0

    def like(p: str, q: str) -> float:
        if not p and not q:
            return 100.0
        # Longest common subsequence by bit-parallel rows.
        at: dict[str, int] = {}
        for k, c in enumerate(p):
            at[c] = at.get(c, 0) | 1 << k
        full = (1 << len(p)) - 1
        v = full
        for c in q:
            u = v & at.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return 200.0 * bin(~v & full).count("1") / (len(p) + len(q))

    common, with_x, with_y = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    own = like(" ".join(only_x), " ".join(only_y)) if not both else like(with_x, with_y)
    return max([own, *((like(common, with_x), like(common, with_y)) if both else ())])


def name_scores(entries: DataFrame, index: DataFrame, least: float = 87.0) -> DataFrame:
    """catalog_id, family_id, score of the distinct name pairs that can reach ``least``.

    Names meet by a shared word.  Without one the score is the indel similarity of the ordered words, so
    ``least`` bounds the indels by the known name's length: cut into one segment more than that, one of
    them is whole in the other name, moved by no more than the indels."""
    if not 70 <= least < 100:
        raise ValueError("segments bound scores from 70 to under 100")
    by_length = (1 - least / 100) * 200 / least
    longest = math.ceil(1 / by_length)

    def names(frame: DataFrame, name: str) -> DataFrame:
        words = F.array_sort(F.array_distinct(F.filter(F.split("normalized_name", " "), lambda x: x != "")))
        return frame.where("normalized_name <> ''").select(F.col("normalized_name").alias(name), words.alias("words")).distinct().withColumn("line", F.array_join("words", " "))

    def parts(size: Column) -> Column:
        return F.floor(size * by_length + 1e-9).cast("int") + 1

    left, right = names(entries, "normalized_name"), names(index, "known_name")
    # Only distinct names meet, and adaptive execution splits the words that very many of them have.
    by_word = left.select("normalized_name", F.explode("words").alias("key")).join(right.select("known_name", F.explode("words").alias("key")), "key").select("normalized_name", "known_name")
    line, n = F.col("line"), F.length("line")

    def bound(j: Column) -> Column:
        return F.floor(n * j / parts(n)).cast("int")

    cut = F.transform(F.sequence(F.lit(0), parts(n) - 1), lambda j: F.struct(F.substring(line, bound(j) + 1, bound(j + 1) - bound(j)).alias("key"), bound(j).alias("at")))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - k)), lambda m: F.struct(F.substring(line, k + 1, m).alias("key"), k.alias("at")))))
    a = left.select("normalized_name", F.col("words").alias("x"), n.alias("nx"), F.explode(runs).alias("e")).select("*", "e.key", F.col("e.at").alias("ax"))
    b = right.select("known_name", F.col("words").alias("y"), n.alias("ny"), F.explode(cut).alias("e")).select("*", "e.key", F.col("e.at").alias("ay"))
    both = F.col("nx") + F.col("ny")
    close = (200 * F.least("nx", "ny") + 1e-6 >= least * both) & (F.abs(F.col("ax") - F.col("ay")) <= (1 - least / 100) * both + 1e-6)
    by_segment = a.drop("e").join(b.drop("e"), "key").where(close & ~F.arrays_overlap("x", "y")).select("normalized_name", "known_name")
    pairs = by_word.unionByName(by_segment).distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = [token_set_ratio(x, y) for x, y in zip(b["normalized_name"], b["known_name"], strict=True)]
            yield b[b["score"] >= least]

    scored = pairs.mapInPandas(score, "normalized_name string, known_name string, score double")
    known = index.select(F.col("normalized_name").alias("known_name"), "family_id").distinct()
    # Names are fewer than entries: each family's best score is taken before entries join.
    best = scored.join(known, "known_name").groupBy("normalized_name", "family_id").agg(F.max("score").alias("score"))
    return entries.select("catalog_id", "normalized_name").distinct().join(best, "normalized_name").groupBy("catalog_id", "family_id").agg(F.max("score").alias("score"))


def fuzzy_candidates(scores: DataFrame, threshold: float = 90.0, band: float = 3.0) -> DataFrame:
    """catalog_id, best, fuzzy: families within ``band`` of the best score, where that reaches the threshold."""
    best = scores.groupBy("catalog_id").agg(F.max("score").alias("best")).where(F.col("best") >= threshold)
    near = scores.join(best, "catalog_id").where(F.col("score") >= F.greatest(F.lit(threshold), F.col("best") - band))
    return near.groupBy("catalog_id", "best").agg(F.array_sort(F.collect_set("family_id")).alias("fuzzy"))


def partition(decisions: DataFrame) -> DataFrame:
    """Adds ``destination``: quarantine for conflicts, terminal for the rejected, else continue."""
    return decisions.withColumn("destination", F.when(F.col("outcome") == "CONFLICT", "quarantine").when(F.col("outcome") == "REJECTED", "terminal").otherwise("continue"))


def quarantine(decisions: DataFrame) -> DataFrame:
    return partition(decisions).where("destination = 'quarantine'").select(ids.prefixed_uuid("qr", F.concat(F.lit("resolver-quarantine:"), F.col("decision_id"))).alias("quarantine_id"), F.lit("VERSION_REVIEW").alias("queue"), "catalog_id", "reason_code")


def apply_reviews(decisions: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with their reviews applied, violations: unknown decision, several reviews, not a conflict).

    A decision that was made for several copies has a row each.  A review that comes once a copy and says the same is noted
    as repeated but applied to them; others of which a decision has several are not applied."""
    r = reviews.select(F.col("original_decision_id").alias("decision_id"), "review_id", F.col("outcome").alias("r_outcome"), F.col("family_id").alias("r_family"), F.col("matched_version_id").alias("r_version"))
    of, said = W.partitionBy("decision_id"), F.struct(*r.columns)
    counted = r.withColumns({"n": F.count("*").over(of), "alike": F.min(said).over(of).eqNullSafe(F.max(said).over(of))})
    known = decisions.groupBy("decision_id", F.col("outcome").alias("was")).agg(F.count("*").alias("copies"))
    judged = counted.join(known, "decision_id", "left").withColumn("violation", F.when(F.col("was").isNull(), "unknown_decision").when(F.col("n") > 1, "duplicate_review").when(F.col("was") != "CONFLICT", "not_a_conflict"))
    bad = judged.where("violation IS NOT NULL").select("review_id", "violation")
    good = judged.where("was = 'CONFLICT' AND alike AND n <= copies").select(*r.columns)
    out = decisions.join(good, "decision_id", "left")
    new = F.col("review_id").isNotNull()
    applied = out.select(
        F.when(new, ids.prefixed_uuid("res", F.col("decision_id"), F.col("review_id"), F.col("r_outcome"))).otherwise(F.col("decision_id")).alias("decision_id"),
        "catalog_id", F.coalesce("r_outcome", "outcome").alias("outcome"), F.when(new, F.col("r_family")).otherwise(F.col("family_id")).alias("family_id"),
        F.when(new, F.col("r_version")).otherwise(F.col("matched_version_id")).alias("matched_version_id"), F.when(new, F.lit(False)).otherwise(F.col("requires_human_review")).alias("requires_human_review"),
    )
    return applied, bad
