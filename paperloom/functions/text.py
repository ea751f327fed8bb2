"""Text expressions; Python only where Spark has no Unicode normaliser."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that plain compaction joins.
BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Marks of text decoded by the wrong code page.
MOJIBAKE = ("Ã", "Â", "â€", "ðŸ", "�")


def _bare(x: str | None) -> str | None:
    if x is None:
        return None
    x = unicodedata.normalize("NFKD", x.replace("Đ", "D").replace("đ", "d"))
    return "".join(c for c in x if not unicodedata.combining(c))


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else _bare(x))


def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def ascii_fold(column: Column) -> Column:
    """Đ and đ to D and d, then compatibility decomposition without combining marks."""
    return F.pandas_udf(_folded, StringType())(column)


def nfc(column: Column) -> Column:
    return F.pandas_udf(_composed, StringType())(column)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(name: Column) -> Column:
    """The name without its last suffix; a leading point begins no suffix."""
    return F.regexp_replace(basename(name), r"(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(basename(name), r".(\.[^.]+)$", 1))


def normalized_name(folded_stem: Column) -> Column:
    """Runs of anything but a-z and 0-9 to one space, of a folded stem."""
    return F.trim(F.regexp_replace(F.lower(folded_stem), "[^a-z0-9]+", " "))


def document_code(folded_stem: Column) -> Column:
    """The first kind of code that the stem holds: QT dept number, ID number, number HDQT, QD number; else null."""
    s, join = F.upper(folded_stem), r"[\s._-]"
    qt = rf"(?<![A-Z0-9])QT{join}+([A-Z][A-Z0-9]{{1,15}}){join}+(\d{{1,4}})(?!\d)"
    kinds = (
        (qt, F.concat(F.lit("qt-"), F.lower(F.regexp_extract(s, qt, 1)), F.lit("-"), F.regexp_extract(s, qt, 2))),
        (rf"ID{join}*(\d{{1,10}})(?!\d)", None),
        (rf"(?<!\d)(\d{{1,6}}){join}*HDQT(?![A-Z])", None),
        (rf"(?<![A-Z0-9])QD{join}*(\d{{1,30}})(?!\d)", None),
    )
    shapes = (None, "id%s", "%s-hdqt", "qd-%s")
    return F.coalesce(*[F.when(s.rlike(p), made if made is not None else F.format_string(shape, F.regexp_extract(s, p, 1))) for (p, made), shape in zip(kinds, shapes, strict=True)])


def family_id(code: Column, normalized: Column) -> Column:
    """The code, else a slug of the name with 8 hex digits of its SHA-256."""
    slug = F.regexp_replace(F.substring(F.replace(normalized, F.lit(" "), F.lit("-")), 1, 40), "^-+|-+$", "")
    return F.coalesce(code, F.concat(F.lit("doc-"), F.when(slug == "", "document").otherwise(slug), F.lit("-"), F.substring(F.sha2(normalized, 256), 1, 8)))


def compact(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def _widened(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or "\t" not in x else x.expandtabs(2))


def structured(text: Column) -> Column:
    """Composed text with line ends as LF, tabs to the next even column, no white space at line ends, no blank lines at either end."""
    t = F.pandas_udf(_widened, StringType())(nfc(F.regexp_replace(text, "\r\n?", "\n")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "(?m)[ \\x{0b}\\x{0c}]+$", ""), "^\n+", ""), "\n+$", "")


def clean_markdown(text: Column) -> Column:
    """Composed text with no doubled bullet, two line feeds at most, one at the end (none if empty)."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(nfc(text), "\r\n?", "\n"), "(?m)[ \t]+$", ""), r"(?m)^(\s*)[-*+]\s+[•·]\s*", "$1- ")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


# Markers that recognition doubles or invents, and what they become.
DOUBLED = (
    (r"(?mi)^(\s*)(?:i|ii|iii|iv|v|vi|vii)\.\s+((?:I|II|III|IV|V|VI|VII)\.\s*)", "$1$2"),
    (r"(?m)^(\s*)(\d+)\.\s+\2\.\s+", "$1$2. "),
    (r"(?m)^(\s*)[-+*]\s+[-+*]\s+", "$1- "),
    (r"(?i)<br>\s*[-+*]\s+[-+*]\s+", "<br>- "),
    (r"(?i)<br>\s*[AB]\.\s*[−–-]\s*", "<br>− "),
)
INVENTED = (r"(?i)1\.\s*(BM\.QT\.TCKT\.01)\s*,?\s*<br>\s*2\.\s*(BM\.QT\.TCKT\.02)", "$1<br>$2")
NOISE, INTERPRETATION = ("petrolimex aviation",), ("tt", "nội dung", "diễn giải", "hồ sơ")


def rewritten_markers(text: Column) -> Column:
    """Each doubled or invented marker once, as it was meant."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    for pattern, becomes in (*DOUBLED, INVENTED):
        t = F.regexp_replace(t, pattern, becomes)
    return t


def is_noise(content: Column) -> Column:
    """A stray item ``a. x`` or a logo's text alone."""
    c = F.lower(compact(content))
    return c.rlike(r"^a\.\s*x$") | c.isin(*NOISE)


def is_interpretation_table(content: Column) -> Column:
    """GFM rows of four cells each, whose first is the known header or begins with a number; the row of dashes doesn't count."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    rows = F.filter(F.transform(lines, cells), lambda r: ~is_separator(r))
    first = F.transform(F.get(rows, F.lit(0)), F.lower)
    known = (first == F.array(*map(F.lit, INTERPRETATION))) | F.get(first, F.lit(0)).rlike(r"^\d+$")
    return F.coalesce((F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == 4) & known, F.lit(False))


def display_name(path: Column, longest: int = 180) -> Column:
    """A file's name in plain characters, cut to ``longest``; ``document`` for none."""
    name = F.regexp_replace(F.trim(basename(F.coalesce(F.nullif(path, F.lit("")), F.lit("document")))), r"[^A-Za-z0-9._ -]+", "_")
    return F.coalesce(F.nullif(F.substring(name, 1, longest), F.lit("")), F.lit("document"))


def stripped_response(text: Column) -> Column:
    """An engine's answer without a code fence around it and with one line feed at the end; empty if nothing is left."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    t = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[^\n]*\n", ""), r"```$", ""))
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def page_list(text: Column) -> Column:
    """array<int>, ascending, of distinct pages in a text like ``3, 1,3``; null if there is none or one is no page."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    pages = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when((F.size(parts) > 0) & F.forall(pages, lambda p: F.coalesce(p >= 1, F.lit(False))), F.array_sort(F.array_distinct(pages)))


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


#: A word with inner apostrophes or hyphens, or one mark.
TOKEN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def mojibake_ratio(text: Column) -> Column:
    """Occurrences of the marks by character; 0 for an empty text."""
    hits = sum((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m) for m in MOJIBAKE)
    return F.when(F.length(text) > 0, hits / F.length(text)).otherwise(0.0)


def uppercase_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def lenient_int(text: Column) -> Column:
    """A whole number, also as 3.0; null for anything else, booleans included."""
    d = text.try_cast("double")
    return F.when(d == F.floor(d), d.cast("long"))


def heading_level(level: Column, raw: Column) -> Column:
    """A whole level, else the digits of the raw text."""
    return F.coalesce(lenient_int(level), F.nullif(F.regexp_extract(raw, r"(\d+)", 1), F.lit("")).try_cast("long"))


def page_locator(pages: Column) -> Column:
    return F.when(F.size(pages) == 1, F.concat(F.lit("p. "), F.array_join(pages, ""))).otherwise(F.concat(F.lit("pp. "), F.array_join(pages, ", ")))


def alphabetic(n: Column) -> Column:
    """Bijective base 26 (a, ..., z, aa, ...) of whole numbers of any size; a for what is under 1."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("out"))

    def step(s: Column, _: Column) -> Column:
        digit = F.chr(F.lit(97) + F.pmod(s["rest"] - 1, F.lit(26)))
        more = s["rest"] > 0
        return F.struct(F.when(more, F.floor((s["rest"] - 1) / 26)).otherwise(s["rest"]).cast("long").alias("rest"), F.when(more, F.concat(digit, s["out"])).otherwise(s["out"]).alias("out"))

    letters = F.greatest(F.lit(1), F.ceil(F.log(26.0, F.greatest(n, F.lit(1)) + 1)).cast("int") + 1)
    out = F.aggregate(F.sequence(F.lit(1), letters), start, step, lambda s: s["out"])
    return F.when(n < 1, "a").otherwise(out)


def roman(n: Column) -> Column:
    """Lower-case Roman numeral, with as many m as there are thousands; i for what is under 1."""
    out = [F.repeat(F.lit("m"), F.floor(n / 1000).cast("int"))]
    for k, (one, five, ten) in enumerate((("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x"))):
        d = F.pmod(F.floor(n / 10 ** (2 - k)), F.lit(10)).cast("int")
        out.append(F.when(d == 9, one + ten).when(d == 4, one + five).when(d >= 5, F.concat(F.lit(five), F.repeat(F.lit(one), d - 5))).otherwise(F.repeat(F.lit(one), d)))
    return F.when(n < 1, "i").otherwise(F.concat(*out))


def list_marker(style: Column, n: Column) -> Column:
    """Marker of the n-th item under a numbering style: a dash where it is unordered or not told, letters, Roman numbers (always small), else the number."""
    s = F.lower(compact(F.coalesce(style, F.lit(""))))
    letters = F.when(s.contains("upper case"), F.upper(alphabetic(n))).otherwise(alphabetic(n))
    return (
        F.when((s == "") | s.contains("unordered"), "-")
        .when(s.contains("english letters"), F.concat(letters, F.lit(".")))
        .when(s.contains("roman"), F.concat(roman(n), F.lit(".")))
        .otherwise(F.concat(n.cast("string"), F.lit(".")))
    )


def cells(line: Column) -> Column:
    """Cells of a pipe row: split at bars that no backslash escapes, outer bars and blanks away."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.trim(c))


def is_separator(parts: Column) -> Column:
    return F.forall(parts, lambda c: c.rlike("^:?-{3,}:?$"))


def gfm_table(text: Column, loose: bool = False) -> Column:
    """Whether the text is one GFM table: two lines at least, rows of one width, dashes in the second.  ``loose`` skips blank lines, which else are an error."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")
    if loose:
        lines = F.filter(lines, lambda x: F.trim(x) != "")
    rows = F.transform(lines, cells)
    sound = (F.size(lines) >= 2) & is_separator(F.get(rows, F.lit(1))) & F.forall(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0))))
    return F.coalesce(sound & F.forall(lines, lambda x: (F.trim(x) != "") & x.contains("|")), F.lit(False))


def markdown_list(text: Column) -> Column:
    """Whether the first line that isn't blank begins with a list marker."""
    return F.coalesce(F.regexp_extract(text, r"(?m)^[ \t]*(\S.*)$", 1).rlike(r"^(?:[-+*•·]|\d+[.)]|[A-Za-z]{1,5}[.)])\s+\S"), F.lit(False))
