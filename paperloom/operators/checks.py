"""Lineage, invariants and gates between stages, as frames of violations or flags."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.functions import ids, text


def violations(frame: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: the rules that a row breaks; a rule that is null for a row is broken as well."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return frame.select(F.col(key), F.explode(broken).alias("rule"))


def decision_rules() -> dict[str, Column]:
    c = F.col
    return {
        "same_version_needs_references": (c("outcome") != "SAME_VERSION") | (c("family_id").isNotNull() & c("matched_version_id").isNotNull()),
        "family_required": ~c("outcome").isin("NEW_VERSION", "UNRELATED") | c("family_id").isNotNull(),
        "conflict_needs_review": (c("outcome") != "CONFLICT") | (c("requires_human_review") & (F.size("candidate_family_ids") > 0)),
        "candidates_distinct": F.size(F.array_distinct("candidate_family_ids")) == F.size("candidate_family_ids"),
        "confidence_in_range": c("confidence").between(0, 1),
    }


def stage_rules() -> dict[str, Column]:
    c = F.col
    return {"finished_after_start": c("finished_at") >= c("started_at"), "attempts_in_limit": c("attempts") <= c("most_attempts"), "quarantined_has_id": (c("status") != "QUARANTINED") | c("quarantine_id").isNotNull()}


def lineage(commits: DataFrame, inputs: DataFrame) -> DataFrame:
    """Commits whose named input run isn't there or has another manifest."""
    i = inputs.select(F.col("run_id").alias("input_run"), F.col("manifest_sha256").alias("found"))
    j = commits.join(i, "input_run", "left")
    return j.select("run_id", F.when(F.col("found").isNull(), "input_missing").when(F.col("found") != F.col("input_sha256"), "input_changed").alias("problem")).where("problem IS NOT NULL")


def free_names(files: DataFrame) -> DataFrame:
    """One copy of each content under a name of its own, in order of path: the first file of a content; a taken name gets -1, -2, ... before its suffix, as long as that is taken too.

    Only names that are equal but for such endings can meet, so they are gone through together, in order, as a stream:
    what is held is the names taken so far and, by stem, the number that was reached, as a taken name stays taken."""
    first = files.withColumn("nth", F.row_number().over(W.partitionBy("sha256").orderBy("path"))).where("nth = 1").drop("nth")
    stem, suffix = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 2)
    own = first.select("path", "sha256", "name", stem.alias("stem"), suffix.alias("suffix")).withColumn("root", F.regexp_replace("stem", r"(-\d+)+$", ""))
    ordered = own.repartition("root", "suffix").sortWithinPartitions("root", "suffix", "path", "sha256", "name")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, reached = None, set(), {}
        for b in batches:
            names = []
            for name, stem, suffix, root in zip(*(b.column(c).to_pylist() for c in ("name", "stem", "suffix", "root")), strict=True):
                if group != (root, suffix):
                    group, taken, reached = (root, suffix), set(), {}
                free = name
                if name in taken:
                    k = reached.get(stem, 1)
                    while (free := f"{stem}-{k}{suffix}") in taken:
                        k += 1
                    reached[stem] = k + 1
                if name is not None:
                    taken.add(free)
                names.append(free)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("sha256"), pa.array(names, pa.string())], names=["path", "sha256", "copy_name"])

    return ordered.mapInArrow(named, "path string, sha256 string, copy_name string")


def heading_lines(lines: DataFrame, above: float = 1.8, longest: int = 140) -> DataFrame:
    """Lines of up to ``longest`` characters whose size is at least ``above`` over the median size of their document's lines (11 where none has a size), or which are bold."""
    per = lines.groupBy("doc_id").agg(F.median(F.when(F.col("size") > 0, F.col("size"))).alias("median"))
    j = lines.join(per, "doc_id").withColumn("median", F.coalesce("median", F.lit(11.0)))
    return j.where((F.length("content") <= longest) & ((F.col("size") >= F.col("median") + above) | F.col("bold"))).select("doc_id", "pos", "size", "median")


def grid_metrics(cells: DataFrame) -> DataFrame:
    """table_id, declared, actual, merged, invalid, collisions, missing, sound: slots that cells with spans take, against the declared size."""
    c = cells.withColumns({"invalid": (F.col("row") < 1) | (F.col("col") < 1) | (F.col("row_span") < 1) | (F.col("col_span") < 1) | (F.col("row") + F.col("row_span") - 1 > F.col("rows")) | (F.col("col") + F.col("col_span") - 1 > F.col("cols"))})
    size = c.groupBy("table_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.count("*").alias("cells"), F.count_if((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("merged"), F.count_if("invalid").alias("invalid"))
    span = lambda at, n: F.sequence(F.col(at), F.col(at) + F.col(n) - 1)
    slots = c.where("NOT invalid").select("table_id", F.explode(span("row", "row_span")).alias("r"), "col", "col_span").select("table_id", "r", F.explode(span("col", "col_span")).alias("k"))
    taken = slots.groupBy("table_id", "r", "k").agg(F.count("*").alias("n")).groupBy("table_id").agg(F.count("*").alias("actual"), F.count_if(F.col("n") > 1).alias("collisions"))
    out = size.join(taken, "table_id", "left").withColumns({"declared": F.col("rows") * F.col("cols"), "actual": F.coalesce("actual", F.lit(0)), "collisions": F.coalesce("collisions", F.lit(0))})
    out = out.withColumn("missing", F.col("declared") - F.col("actual"))
    return out.select("table_id", "declared", "actual", "merged", "invalid", "collisions", "missing", ((F.col("declared") > 0) & (F.col("invalid") == 0) & (F.col("collisions") == 0) & (F.col("missing") == 0)).alias("sound"))


def accepted_pages(scopes: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, page, accepted: the page passed, all candidates are covered, and no issue on it is an error or asks for a fallback."""
    bad = issues.groupBy("doc_id", "page").agg(F.max(F.col("fallback") | (F.col("severity") == "ERROR")).alias("bad"))
    return scopes.join(bad, ["doc_id", "page"], "left").select("doc_id", "page", (F.col("passed") & (F.col("covered") == F.col("candidates")) & ~F.coalesce("bad", F.lit(False))).alias("accepted"))


def unresolved(asked: DataFrame, resolved: DataFrame, handed_on: DataFrame) -> DataFrame:
    """Routes that asked for a fallback and weren't resolved, and those handed on to the next engine."""
    return asked.subtract(resolved).union(handed_on).distinct()


def section_states(lines: DataFrame, markers: dict[str, str], start: str = "awaiting") -> DataFrame:
    """Adds ``state``: that of the last line up to here which holds a marker's pattern."""
    state = F.lit(None).cast("string")
    for name, pattern in reversed(markers.items()):
        state = F.when(F.col("content").rlike(pattern), name).otherwise(state)
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("state", F.coalesce(F.last(state, True).over(w), F.lit(start)))


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and plain Unicode; nulls are written."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def forbidden(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, code of every pattern that a finished text still holds."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), code) for code, p in patterns.items()]))
    return documents.select("doc_id", F.explode(hits).alias("code"))


#: The marks of one kind of document, all of the first and five of the second, and lines that hold each.
HARD_MARKS = (
    r"(?miU)^\s*#{0,6}\s*QUY TRÌNH QUẢN LÝ VẬT TƯ\s*$",
    r"(?iU)\(QT\.TCKT\.01\)",
    r"(?iU)BM\.QT\.TCKT\.01",
    r"(?iU)BM\.QT\.TCKT\.05",
    r"(?iU)\bV\.\s*LƯU ĐỒ\b",
    r"(?iU)\bVI\.\s*DIỄN GIẢI LƯU ĐỒ\b",
)
SOFT_MARKS = (
    r"(?iU)CÔNG TY CỔ PHẦN NHIÊN LIỆU BAY PETROLIMEX",
    r"(?miU)^\s*(?:[-+*]\s+)?Vật tư:",
    r"(?miU)^\s*(?:[-+*]\s+)?Kho vật tư:",
    r"(?iU)BM\.QT\.TCKT\.03",
    r"(?iU)BM\.QT\.TCKT\.06",
    r"(?iU)P\.KT-TH",
)
PROFILE_LINES = (
    "## quy trình quản lý vật tư", "(qt.tckt.01)", "BM.QT.TCKT.01", "bm.qt.tckt.05", "V. Lưu đồ", "VI.  diễn giải lưu đồ",
    "Công ty cổ phần nhiên liệu bay Petrolimex", "- VẬT TƯ: x", "Kho vật tư: y", "BM.QT.TCKT.03", "BM.QT.TCKT.06", "p.kt-th",
)


def re2(pattern: str) -> str:
    """The same pattern for DuckDB, which folds case beyond ASCII by itself and has no Unicode word ends."""
    return pattern.replace("U)", ")", 1).replace(r"\b", r"(?:^|[^\p{L}\p{N}_]|$)")


def fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id, hard, soft (marks found in the composed text), score, matched: all hard marks and five soft ones."""
    t = text.nfc(F.col("markdown"))
    found = lambda marks: sum((F.col("t").rlike(p).cast("int") for p in marks), F.lit(0))
    out = documents.select("doc_id", t.alias("t")).select("doc_id", found(HARD_MARKS).alias("hard"), found(SOFT_MARKS).alias("soft"))
    total = len(HARD_MARKS) + len(SOFT_MARKS)
    return out.withColumns({"score": F.round((F.col("hard") + F.col("soft")) / total, 4), "matched": (F.col("hard") == len(HARD_MARKS)) & (F.col("soft") >= 5)})


def run_stamp(at: Column, *parts: Column) -> Column:
    """YYYYmmdd_HHMMSS_ffffff and 8 hex digits of the parts' SHA-256."""
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS"), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8))


def moved_lines(lines: DataFrame, what: str, after: str) -> DataFrame:
    """doc_id, pos, new_pos: the only line with the first pattern goes behind the only line with the second; other documents stay as they are."""
    w = W.partitionBy("doc_id")
    hit, goal = F.col("content").rlike(what), F.col("content").rlike(after)
    rows = lines.withColumns({"n_hit": F.count_if(hit).over(w), "n_goal": F.count_if(goal).over(w), "goal": F.max(F.when(goal, F.col("pos"))).over(w)})
    moves = (F.col("n_hit") == 1) & (F.col("n_goal") == 1) & hit & ~goal
    key = F.when(moves, F.col("goal") + 0.5).otherwise(F.col("pos").cast("double"))
    return rows.withColumn("key", key).select("doc_id", "pos", (F.row_number().over(w.orderBy("key")) - 1).alias("new_pos"))


def issue_id(*parts: Column) -> Column:
    return ids.digest_id("quality-issue", *parts)

