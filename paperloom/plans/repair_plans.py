"""Repairs of recognised text over the driver's lines, with the faults strewn in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.plans.registry import query
from paperloom.sources.tables import FILES_SQL, LINES_SQL, files, lines, table


@query(
    f"""WITH {LINES_SQL} SELECT doc_id, pos, CASE pos % 7 WHEN 0 THEN 'II. ' || content WHEN 1 THEN '  3. ' || content WHEN 2 THEN '- ' || content WHEN 3 THEN 'a<br>− ' || content WHEN 4 THEN '12. 13. ' || content WHEN 5 THEN 'BM.QT.TCKT.01<br>BM.QT.TCKT.02 ' || content ELSE '<br>- ' || content END AS content
    FROM lines WHERE content = '' OR regexp_matches(content, '^[A-Za-z]')"""
)
def marker_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, c = lines(spark, sf_dir).where("content = '' OR content RLIKE '^[A-Za-z]'"), F.col("content")
    starts = ("ii. II. ", "  3.  3. ", "* - ", "a<br> A. – ", "12. 13. ", "1. BM.QT.TCKT.01 , <br>2.BM.QT.TCKT.02 ", "<br>- +  ")
    start = F.element_at(F.array(*map(F.lit, starts)), F.col("pos") % 7 + 1)
    return own.select("doc_id", "pos", text.rewritten_markers(F.concat(start, c)).alias("content"))


@query(
    f"""WITH {LINES_SQL}, s AS (SELECT *, pos % 9 AS k FROM lines) SELECT doc_id, pos, k IN (1, 2) AS noise, k IN (3, 4) AS interpretation FROM s"""
)
def noise_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stray items, logos, and tables of four columns: a known header, numbered rows, another header, rows of three."""
    k, c = F.col("pos") % 9, F.translate("content", "|", "/")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rule = F.lit("\n| --- | --- | --- | --- |\n")
    last = row(F.lit("1"), c, F.lit("x"), F.lit(""))
    said = (
        F.when(k == 1, " A.  X").when(k == 2, "Petrolimex   AVIATION ").when(k == 3, F.concat(row(*map(F.lit, ("TT", "Nội dung", "DIỄN GIẢI", "Hồ sơ"))), rule, last)).when(k == 4, F.concat(last, rule, last))
        .when(k == 5, F.concat(row(*map(F.lit, ("a", "b", "c", "d"))), rule, last)).when(k == 6, F.concat(last, rule, row(F.lit("2"), c, F.lit("y")))).when(k == 7, "a. x y").otherwise(F.concat(F.lit("- "), c))
    )
    return lines(spark, sf_dir).select("doc_id", "pos", text.is_noise(said).alias("noise"), text.is_interpretation_table(said).alias("interpretation"))


@query(f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'document' ELSE substr(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN repeat('x', 170) ELSE '' END || source_name, '[^A-Za-z0-9._ -]+', '_', 'g'), 1, 180) END AS display FROM files")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, name = F.col("doc_id"), F.concat(F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("x"), 170)).otherwise(""), "source_name")
    path = F.when(d % 50 == 7, F.when(d % 100 == 7, F.lit(None).cast("string")).otherwise("")).otherwise(F.concat(F.lit("C:\\up\\load/ "), name, F.lit(" ")))
    return files(spark, sf_dir).select("doc_id", text.display_name(path).alias("display"))


_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"SELECT conv_id, turn, CASE WHEN {_TRIMMED} = '' THEN '' ELSE {_TRIMMED} || chr(10) END AS answer, CASE turn % 4 WHEN 0 THEN '1,3,' || (turn + 4)::VARCHAR WHEN 1 THEN '2' END AS pages FROM conversations")
def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, turn = F.col("text"), F.col("turn")
    said = F.when(turn % 3 == 0, F.concat(F.lit(" ```markdown \n"), t, F.lit("\n```  "))).when(turn % 3 == 1, F.concat(t, F.lit("\n```"))).otherwise(F.concat(F.lit("\n "), t))
    asked = F.when(turn % 4 == 0, F.concat(F.lit(" 3, 1,,"), turn + 4, F.lit(" ,3"))).when(turn % 4 == 1, "2").when(turn % 4 == 2, "1, 0").otherwise("a,2")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.stripped_response(said).alias("answer"), F.array_join(text.page_list(asked), ",").alias("pages"))


_ENDS = r"regexp_replace(replace(text, chr(9), ' '), '[ \x0b\x0c]+(\n|$)', '\1', 'g')"


@query(
    f"""WITH s AS (SELECT doc_id, 'é' || chr(10) || regexp_replace(regexp_replace({_ENDS}, '^\\n+', ''), '\\n+$', '') AS t FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(9)) AND NOT contains(text, chr(13)))
    SELECT doc_id, md5(t || chr(10) || 'ab  c d') AS structured FROM s"""
)
def structured_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks apart from their letters, other line ends and tabs around each text that has none."""
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL AND NOT contains(text, '\t') AND NOT contains(text, '\r')")
    inner = F.regexp_replace(F.regexp_replace(text.structured(F.col("text")), "\n", "\r\n"), "^", "")
    return own.select("doc_id", F.md5(text.structured(F.concat(F.lit("\r\ne\u0301 \r"), inner, F.lit("\rab\tc\td \n\n")))).alias("structured"))


@query(
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS t FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13)))
    SELECT doc_id, md5(CASE WHEN t = '' THEN '' ELSE t || chr(10) END || CASE WHEN t = '' THEN '- é' ELSE '' END) AS cleaned FROM s"""
)
def cleaned_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL AND NOT contains(text, '\r')")
    clean = text.clean_markdown(F.concat(F.lit("\n \n"), t, F.lit("  \n\n\n\n")))
    return own.select("doc_id", F.md5(F.when(clean == "", F.rtrim(F.regexp_replace(text.clean_markdown(F.lit("* • e\u0301")), "\n", ""))).otherwise(clean)).alias("cleaned"))
