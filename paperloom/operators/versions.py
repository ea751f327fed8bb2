"""The registry of families and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.functions import ids


def assign(decided: DataFrame, versions: DataFrame) -> DataFrame:
    """decided (catalog_id, decision_id, pos, outcome, family_id, matched_version_id, sha256) -> a version each.

    Content that the family has already, in the registry or earlier in the batch, reuses that version;
    new content gets the family's next number in order of ``pos`` and supersedes its ACTIVE version.
    Content that only another family has is refused: ``foreign_content`` names it."""
    decided = decided.join(foreign_content(decided, versions).select("catalog_id"), "catalog_id", "left_anti")
    own = versions.groupBy("family_id", "sha256").agg(F.min(F.struct("version_number", "version_id")).alias("held"))
    last = versions.groupBy("family_id").agg(F.max("version_number").alias("last"), F.max(F.when(F.col("publication_state") == "ACTIVE", F.col("version_id"))).alias("active"))
    firsts = decided.groupBy("family_id", "sha256").agg(F.min("pos").alias("first_pos"))
    fresh = firsts.join(own, ["family_id", "sha256"], "left_anti")
    numbered = fresh.withColumn("nth", F.row_number().over(W.partitionBy("family_id").orderBy("first_pos")))
    rows = decided.join(own, ["family_id", "sha256"], "left").join(numbered, ["family_id", "sha256"], "left").join(last, "family_id", "left")
    number = F.coalesce("held.version_number", F.coalesce("last", F.lit(0)) + F.col("nth"))
    vid = F.coalesce("held.version_id", ids.version_id(F.col("family_id"), number, F.col("sha256")))
    created = F.col("held").isNull() & (F.col("pos") == F.col("first_pos"))
    action = F.when(created & F.col("last").isNull() & (F.col("nth") == 1), "CREATE_FAMILY_AND_VERSION").when(created, "CREATE_VERSION").otherwise("REUSE_VERSION")
    rows = rows.withColumns({"number": number.cast("int"), "version_id": vid, "action": action})
    return rows.select(
        ids.prefixed_uuid("va", F.col("decision_id"), F.col("version_id"), F.col("action")).alias("assignment_id"), "catalog_id", "decision_id", "family_id", "version_id",
        F.col("number").alias("version_number"), ids.version_label(F.col("number")).alias("version_label"), "sha256", "action", F.when(F.col("action") != "REUSE_VERSION", F.col("active")).alias("supersedes_version_id"),
    )


def foreign_content(decided: DataFrame, versions: DataFrame) -> DataFrame:
    """catalog_id, family_id, sha256, known_family: decisions whose content is registered under other families only."""
    known = versions.groupBy("sha256").agg(F.array_sort(F.collect_set("family_id")).alias("families"))
    j = decided.join(known, "sha256").where(~F.array_contains("families", F.col("family_id")))
    return j.select("catalog_id", "family_id", "sha256", F.get("families", F.lit(0)).alias("known_family"))


def violations(families: DataFrame, versions: DataFrame, decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """kind, id of everything that breaks the registry's rules; empty when sound."""
    def of(kind: str, frame: DataFrame, column: str) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id"))

    def repeated(frame: DataFrame, column: str) -> DataFrame:
        return frame.groupBy(column).count().where("count > 1")

    keys = catalog.select("catalog_id", F.lit(1).alias("c")).join(decisions.select("catalog_id", F.lit(1).alias("d")), "catalog_id", "full_outer")
    parts = [
        of("family_missing", versions.join(families, "family_id", "left_anti"), "version_id"),
        of("version_id_repeated", repeated(versions, "version_id"), "version_id"),
        of("sha256_in_several_families", versions.groupBy("sha256").agg(F.count_distinct("family_id").alias("n")).where("n > 1"), "sha256"),
        of("several_active", versions.where("publication_state = 'ACTIVE'").groupBy("family_id").count().where("count > 1"), "family_id"),
        of("undecided", keys.where("d IS NULL"), "catalog_id"),
        of("decision_without_entry", keys.where("c IS NULL"), "catalog_id"),
        of("self_superseding", versions.where("supersedes_version_id = version_id"), "version_id"),
        of("label_mismatch", versions.where(F.col("version_label") != ids.version_label(F.col("version_number"))), "version_id"),
        of("same_version_mismatch", decisions.where("outcome = 'SAME_VERSION'").join(versions.select(F.col("version_id").alias("matched_version_id"), F.col("family_id").alias("vf")), "matched_version_id", "left").where("vf IS NULL OR vf <> family_id"), "catalog_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_index(index: DataFrame, arriving: DataFrame) -> DataFrame:
    """Full outer upsert by version: ``change`` is kept, inserted, unchanged or conflict (other content under a known version, or known content under another)."""
    a = index.select("version_id", F.col("sha256").alias("old_sha"), F.col("family_id").alias("old_family"))
    b = arriving.select("version_id", F.col("sha256").alias("new_sha"), F.col("family_id").alias("new_family"))
    held = index.groupBy("sha256").agg(F.min("version_id").alias("sha_version")).withColumnRenamed("sha256", "new_sha")
    both = a.join(b, "version_id", "full_outer").join(held, "new_sha", "left")
    change = F.when(F.col("new_sha").isNull(), "kept").when(F.col("old_sha").isNotNull() & (F.col("old_sha") == F.col("new_sha")), "unchanged").when(F.col("old_sha").isNotNull() | F.col("sha_version").isNotNull(), "conflict").otherwise("inserted")
    return both.select("version_id", F.coalesce("old_family", "new_family").alias("family_id"), F.coalesce("old_sha", "new_sha").alias("sha256"), change.alias("change"))
