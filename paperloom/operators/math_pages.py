"""Risk scores and checks of Markdown pages with questions and formulas."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from paperloom.functions import text

# The patterns of questions, options, terms, stray glyphs and solution headings.
QUESTION = r"(?miU)^\s*(?:#{1,6}\s*)?(?:\*{0,2})?Câu\s+(\d+)\b"
OPTION = r"(?miU)^\s*(?:[-*+]\s*)?(?:\*{0,2})?([A-D])[.)]\*{0,2}\s+"
DOUBLE_OPTION = r"(?miU)^\s*(?:[-*+]\s*)?(?:\*{0,2})?[A-D][.)]\*{0,2}\s+(?:[◯○⃝]\s*)?(?:\*{0,2})?[A-D][.)]"
TERMS = (
    r"(?iU)\bma trận\b",
    r"(?iU)\bđịnh thức\b",
    r"(?iU)\bdet\s*[A-Za-z]?\b",
    r"(?iU)\bvector\b|\bvectơ\b",
    r"(?iU)\bspan\s*\(",
    r"(?iU)\bhệ phương trình\b",
    r"(?iU)\bkhông gian vector\b|\bkhông gian vectơ\b",
    r"(?iU)\b(?:F|v)\s*[_\[]?\d",
    r"(?iU)\[[^\]\n]{1,8}\]_[A-Za-z0-9]",
    r"(?iU)\\begin\{(?:bmatrix|pmatrix|vmatrix|matrix)\}",
    r"(?iU)[αβγλμ]|\\(?:alpha|beta|gamma|lambda|mu)\b",
)
STRAY = r"(?miU)^\s*(?:ï|ò|ó|T|⌈|⌉|⌊|⌋|⎡|⎤|⎣|⎦)(?:\s+(?:ï|ò|ó|T))*\s*$"
SOLUTION = r"(?miU)^\s*(?:#{1,6}\s*)?\[?Hướng\s+dẫn\s+giải\]?\s*:?[ \t]*$"
SOUND_SOLUTION = r"(?miU)^\s*#{2,3}\s+\[Hướng dẫn giải\]\s*$"
NUMBER = r"(?U)(?<!\w)[+−-]?(?:\d+(?:[.,]\d+)?|[αβγλμ])(?!\w)"
IGNORED = r"(?U)^(?:\$\$|---+|<!--.*-->|\|[\s|:\-]+\|)$"
ENVIRONMENTS = ("bmatrix", "pmatrix", "vmatrix", "matrix", "aligned")


def occurrences(markdown: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(markdown, F.lit(pattern), F.lit(group))


def bodies(markdown: Column) -> Column:
    """The text under each question; without questions, the whole."""
    parts = F.split(markdown, QUESTION)
    return F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts))).otherwise(F.array(markdown))


def option_letters(body: Column) -> Column:
    return F.transform(occurrences(body, OPTION), lambda x: F.upper(x))


def options_out_of_order(markdown: Column) -> Column:
    """Whether a question's three or more options repeat a letter or aren't ascending."""
    return F.exists(bodies(markdown), lambda b: (F.size(option_letters(b)) >= 3) & ((F.size(F.array_distinct(option_letters(b))) != F.size(option_letters(b))) | (F.array_sort(option_letters(b)) != option_letters(b))))


def numeric_grid(markdown: Column) -> Column:
    """Whether two neighbouring lines (blank ones aside) hold three numbers each and no bar."""
    kept = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x) != "")
    flags = F.transform(kept, lambda x: (F.size(occurrences(x, f"({NUMBER})")) >= 3) & ~x.contains("|"))
    return F.exists(F.zip_with(F.slice(flags, 1, F.greatest(F.size(flags) - 1, F.lit(0))), F.slice(flags, 2, F.greatest(F.size(flags) - 1, F.lit(0))), lambda a, b: a & b), lambda x: x)


def risk(pages: DataFrame) -> DataFrame:
    """doc_id, page, questions, terms, score, reasons: capped features of the composed text add up."""
    t = F.col("markdown")
    made = pages.withColumn("markdown", text.nfc(t)).withColumns({
        "questions": F.size(occurrences(t, QUESTION)),
        "terms": sum((t.rlike(p).cast("int") for p in TERMS), F.lit(0)),
        "options": F.size(occurrences(t, OPTION)),
        "double": t.rlike(DOUBLE_OPTION),
        "order": options_out_of_order(t),
        "stray": t.rlike(STRAY),
        "grid": numeric_grid(t),
        "heading": t.contains("[Hướng dẫn giải]") & ~t.rlike(SOUND_SOLUTION),
    })
    c = F.col
    features = (
        (c("questions") > 0, F.least(F.lit(3), c("questions") + 1), "question_numbering"),
        (c("terms") > 0, F.least(F.lit(4), c("terms")), "math_or_matrix_terms"),
        (c("options") >= 4, F.lit(2), "multiple_choice_options"),
        (c("double"), F.lit(5), "duplicate_option_prefix"),
        (c("order"), F.lit(4), "noncanonical_option_order"),
        (c("stray"), F.lit(4), "orphan_matrix_glyph"),
        (c("grid"), F.lit(3), "flattened_numeric_grid"),
        (c("heading"), F.lit(2), "inconsistent_solution_heading"),
    )
    score = sum((F.when(test, points).otherwise(0) for test, points, _ in features), F.lit(0)) + c("options").isin(2, 3).cast("int")
    reasons = F.array_compact(F.array(*[F.when(test, why) for test, _, why in features]))
    return made.select("doc_id", "page", "questions", "terms", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


def flagged(risks: DataFrame, threshold: int = 6, k: int | None = None) -> DataFrame:
    """Pages at the threshold of documents with two questions and a page with terms; of each document the ``k`` riskiest."""
    docs = risks.groupBy("doc_id").agg((F.sum("questions") >= 2).alias("a"), (F.count_if(F.col("terms") > 0) >= 1).alias("b")).where("a AND b")
    rows = risks.join(docs.select("doc_id"), "doc_id", "left_semi").where(F.col("score") >= threshold)
    return rows if k is None else top_pages(rows, k)


def top_pages(risks: DataFrame, k: int = 8) -> DataFrame:
    """The k pages of the highest score of each document, ties to the lower page."""
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "page")
    return risks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def normalized(markdown: Column) -> Column:
    """Canonical Markdown: no code fence around it, one form of solution headings, questions and options, two line feeds at most."""
    t = F.regexp_replace(F.regexp_replace(markdown, "\r\n?", "\n"), r"^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:markdown|md)?\s*\n", ""), r"\n```\s*$", "")
    t = F.regexp_replace(t, SOLUTION, "### [Hướng dẫn giải]")
    t = F.regexp_replace(t, r"(?miU)^\s*(?:#{1,6}\s*)?Câu\s+(\d+)\s*[:.]?\s*$", "## Câu $1")
    for letter in "ABCD":
        t = F.regexp_replace(t, rf"(?miU)^\s*(?:[-*+]\s*)?{letter}[.)]\s+(.*\S)[ \t]*$", f"- **{letter}.** $1")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def content_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos, line: compacted, folded lines that say something."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.lower(text.compact(F.col("line"))))
    return rows.where((F.col("line") != "") & ~F.col("line").rlike(IGNORED))


def runaway(pages: DataFrame) -> DataFrame:
    """doc_id, page, code: a line of 24 characters four times on a page, or three lines of 120 together three times.

    Counts are by page and text, combined before they move, so a line that repeats everywhere is no hot key."""
    lines = content_lines(pages)
    w = W.partitionBy("doc_id", "page").orderBy("pos")
    three = lines.select("doc_id", "page", F.array("line", F.lead("line", 1).over(w), F.lead("line", 2).over(w)).alias("l")).where(F.get("l", F.lit(2)).isNotNull())
    three = three.where(F.aggregate("l", F.lit(0), lambda s, x: s + F.length(x)) >= 120)
    one = lines.where(F.length("line") >= 24).groupBy("doc_id", "page", "line").count().where("count >= 4").select("doc_id", "page", F.lit("runaway_repeated_line").alias("code"))
    many = three.groupBy("doc_id", "page", "l").count().where("count >= 3").select("doc_id", "page", F.lit("runaway_repeated_block").alias("code"))
    return one.unionByName(many).distinct()


def _bare(s: pd.Series) -> pd.Series:
    def of(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x and x.lower()
        return "".join(c for c in unicodedata.normalize("NFD", x.casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d")

    return s.map(of)


def bare(column: Column) -> Column:
    """Folded, decomposed, without marks, đ as d."""
    return F.pandas_udf(_bare, StringType())(column)


def lexical_tokens(column: Column) -> Column:
    return F.regexp_extract_all(bare(column), F.lit("([a-z0-9]+)"), F.lit(1))


def bag_recall(source: DataFrame, output: DataFrame) -> DataFrame:
    """doc_id, source_tokens, output_tokens, recall: the share of the source's tokens, with their counts, that the output has."""
    def bag(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("doc_id", F.explode(lexical_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias(name))

    both = bag(source, "s").join(bag(output, "o"), ["doc_id", "token"], "full_outer")
    zero = F.lit(0)
    per = both.groupBy("doc_id").agg(F.sum(F.coalesce("s", zero)).alias("source_tokens"), F.sum(F.coalesce("o", zero)).alias("output_tokens"), F.sum(F.least(F.coalesce("s", zero), F.coalesce("o", zero))).alias("matched"))
    return per.select("doc_id", "source_tokens", "output_tokens", F.round(F.col("matched") / F.greatest(F.lit(1), F.col("source_tokens")), 6).alias("recall"))


def errors(pages: DataFrame) -> DataFrame:
    """doc_id, page, codes: what is wrong with each page's Markdown by itself, in a fixed order."""
    t = F.col("markdown")
    numbers = F.transform(occurrences(t, QUESTION), lambda x: x.cast("long"))
    sets = F.transform(bodies(t), lambda b: F.array_sort(F.array_distinct(option_letters(b))))
    full = F.array(*[F.lit(x) for x in "ABCD"])
    asked = F.size(numbers) > 0
    counted = lambda s: F.size(F.split(t, f"\\Q{s}\\E")) - 1
    checks = [
        (F.length(F.trim(t)) < 20, "output_too_short"), (t.contains("�"), "replacement_character"), (t.contains("```"), "markdown_code_fence"), (t.rlike(DOUBLE_OPTION), "duplicate_option_prefix"),
        (options_out_of_order(t), "noncanonical_option_order"), (t.rlike(STRAY), "orphan_matrix_glyph"),
        (F.size(numbers) != F.size(F.array_distinct(numbers)), "duplicate_question_block"), (F.array_sort(numbers) != numbers, "nonmonotonic_question_order"),
        (asked & F.exists(sets, lambda s: s == full) & F.exists(sets, lambda s: (F.size(s) > 0) & (s != full)), "incomplete_option_set"),
        *[(counted(f"\\begin{{{e}}}") != counted(f"\\end{{{e}}}"), f"unbalanced_{e}") for e in ENVIRONMENTS], (F.pmod(counted("$$"), F.lit(2)) == 1, "unbalanced_display_math"),
    ]
    return pages.select("doc_id", "page", F.array_join(F.array_compact(F.array(*[F.when(test, code) for test, code in checks])), ",").alias("codes"))
