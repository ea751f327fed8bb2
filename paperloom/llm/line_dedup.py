"""Line deduplication by a segment-partition edit join.

Lines are cut at line feeds.  Of equal lines the first occurrence stays (by doc_id, then place);
of lines near a line whose first occurrence is earlier, none stays.  Blank lines always stay.
Two lines are near if their edit distance is at most what the shorter's length allows: one edit
for every PER_EDIT characters, at least one and at most ``most`` (a parameter; 2 unless said).

Two strings within distance t agree on at least one of any t + 1 consecutive segments of the
shorter.  Each distinct line indexes its t + 1 segments under its length and probes the indexes
of its own length and of up to t less, with the substrings that a shift by some of the length
difference and the edits left on either side allow.  The first and the last segment can't shift
against their ends, and have one size for a range of lengths, so one key of each does for most
lengths.  Lines that meet are compared by the parities of their characters and of their pairs of
characters, of which an edit changes two and four at most; what is left is verified by a banded
bit-parallel automaton, one long for each number of errors, one bit a diagonal, between the
common ends, which gives up when all its bits are gone.

A key that more than CROWDED lines share is passed over: its lines come again with FINER segments,
of which all but t agree, in keys of all those together.  Keys that are crowded even then are dealt
to blocks of lines, and each two blocks are compared; that alone grows with the square of a
group, of lines that agree on all but t of the finest segments, and holds CROWDED lines at a time.

All is DataFrame expressions.  Distinct lines are kept once, bucketed by their hashes, so that
only keys are shuffled and the texts of candidates are read in place.  Rows that repeat doc_id
and text are one document, and all get its result.  Null ids come first.  Null texts stay null
with no lines; an empty text is one blank line; an empty table gives an empty one.  Ties: a line
is earlier by (doc_id, hash of the text, place), so no two distinct lines are equally early.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import bucketed, clean, made, written

PLACE = ["known", "doc", "version", "line_no"]
#: A line's name in keys and pairs: 96 bits of hashes.
LINE = ["h", "c"]

MOST, PER_EDIT = 2, 10
CROWDED = 512
#: Segments of the rounds after the first.
FINER = (8, 24)
#: The outer segments' size changes with the length by steps of this, from twice this length on.
STEP = 16


def allowed(length: Column, most: int) -> Column:
    """Edits that a line of this length, the shorter of a pair, allows."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(length / PER_EDIT).cast("int")))


def places(docs: DataFrame) -> DataFrame:
    """known, doc, version (a document's identity without nulls, in its order) and text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc")
    return docs.where("text IS NOT NULL").select(F.col("doc_id").isNotNull().alias("known"), doc, F.xxhash64("text").alias("version"), "text")


def patterns(edits: int, segments: int) -> list[dict]:
    """What a line of length l + ``longer`` keeps of one of length l within ``edits``: all but as many of the shorter's segments.

    ``kept`` are ranges of segments and by how much they are shifted in the longer.  ``own`` is the
    shorter's side itself, and ``part`` names what is kept."""
    out = []
    for longer in range(edits + 1):
        # The shift changes at each segment left out, by as many edits as it takes.
        ways = [(0, *s, longer) for s in product(range(-edits, edits + 1), repeat=edits - 1)]
        ways = [s for s in ways if sum(abs(x - y) for x, y in zip(s, s[1:], strict=False)) <= edits]
        for part, left_out in enumerate(combinations(range(segments), edits)):
            cuts = (-1, *left_out, segments)
            for shifts in ways:
                kept = [(x + 1, y, s) for x, y, s in zip(cuts, cuts[1:], shifts, strict=False) if y > x + 1]
                out.append({"part": part, "longer": longer, "own": not any(shifts), "kept": kept})
    return out


def with_keys(lines: DataFrame, most: int) -> DataFrame:
    """``lines`` (with line) and ``keys``, array<struct<key, own>>: the line's keys as the shorter (own) and as the longer of a pair, one of edits + 1 segments each; null where a key doesn't apply.

    What the keys share is computed once, in columns of its own."""
    names, line = lines.columns, F.col("line")
    out = lines.withColumn("_n", F.length("line"))
    out = out.withColumns({f"_size{k}": F.col("_n") - k for k in range(-1, most + 1)})
    out = out.withColumns({f"_step{k}": F.when(F.col(f"_size{k}") < 2 * STEP, F.col(f"_size{k}")).otherwise(F.col(f"_size{k}") - F.pmod(F.col(f"_size{k}"), F.lit(STEP))) for k in range(-1, most + 1)})
    out = out.withColumns({f"_most{k}": F.when(F.col(f"_size{k}") > 0, allowed(F.col(f"_size{k}"), most)).otherwise(0) for k in range(-1, most + 1)})
    kinds = [(edits, longer) for edits in range(1, most + 1) for longer in range(edits + 1)]
    out = out.withColumns({f"_ends{e}_{k}": F.floor(F.col(f"_step{k}") / (e + 1)).cast("int") for e, k in kinds})
    # The outer keys of the next longer size are the same where nothing changes between.
    new = lambda k: F.lit(True) if k == 0 else (F.col(f"_step{k}") != F.col(f"_step{k - 1}")) | (F.col(f"_most{k}") != F.col(f"_most{k - 1}"))
    out = out.withColumns({f"_new{k}": new(k) for k in range(most + 1)})

    def keys(edits: int, longer: int, certain: bool) -> list[Column]:
        n, size, step, ends = F.col("_n"), F.col(f"_size{longer}"), F.col(f"_step{longer}"), F.col(f"_ends{edits}_{longer}")
        fits = F.lit(True) if certain else F.col(f"_most{longer}") == edits

        def key(own: bool, test: Column | None, part: int, length: Column, text: Column) -> Column:
            made = F.struct(F.xxhash64(F.lit(edits), F.lit(part), length, text).alias("key"), F.lit(own).alias("own"))
            return made if test is None else F.when(test, made)

        outer = None if certain and not longer else fits & F.col(f"_new{longer}")
        found = [key(not longer, outer, 0, step, F.substring(line, F.lit(1), ends)), key(not longer, outer, edits, step, F.substring(line, n - ends + 1, ends))]
        for k in range(1, edits):
            # Between the outer segments the rest is cut evenly.
            start = ends if k == 1 else ends + F.floor((size - 2 * ends) * (k - 1) / (edits - 1)).cast("int")
            width = size - 2 * ends if edits == 2 else ends + F.floor((size - 2 * ends) * k / (edits - 1)).cast("int") - start
            for shift in range(max(-k, longer - (edits - k)), min(k, longer + edits - k) + 1):
                found.append(key(longer == shift == 0, None if certain else fits, k, size, F.substring(line, start + shift + 1, width)))
        return found

    # Lines that are long enough for all edits at every length they may have as the longer need no tests.
    usual = F.array(*[x for k in range(most + 1) for x in keys(most, k, True)])
    others = F.array(*[x for e, k in kinds for x in keys(e, k, False)])
    return out.select(*names, F.when(F.col(f"_most{most}") == most, usual).otherwise(others).alias("keys"))


def finer_keys(line: Column, segments: int, most: int) -> Column:
    """The same with more segments, of which all but the edits are kept."""
    n, out = F.length(line), []
    kind = "array<struct<part:int,longer:int,own:boolean,kept:array<struct<x:int,y:int,shift:int>>>>"

    def entries(edits: int) -> Column:
        text = json.dumps([p | {"kept": [dict(zip(("x", "y", "shift"), k, strict=True)) for k in p["kept"]]} for p in patterns(edits, segments)])

        def entry(p: Column) -> Column:
            size = n - p["longer"]

            def piece(k: Column) -> Column:
                start = F.floor(size * k["x"] / segments).cast("int")
                return F.substring(line, start + k["shift"] + 1, F.floor(size * k["y"] / segments).cast("int") - start)

            kept = F.concat_ws("\n", F.transform(p["kept"], piece))
            return F.struct(F.xxhash64(size, F.lit(edits), F.lit(segments), p["part"], kept).alias("key"), p["own"].alias("own"))

        return F.transform(F.filter(F.from_json(F.lit(text), kind), lambda p: (n > p["longer"]) & (allowed(n - p["longer"], most) == edits)), entry)

    for edits in range(1, most + 1):
        out.append(entries(edits))
    return F.concat(*out)


def codes(line: Column) -> Column:
    """array<int> of the line's characters."""
    return F.transform(F.split(line, ""), lambda c: F.ascii(c))


def parities(items: Column) -> Column:
    """One bit for each of 64 kinds of items: whether there is an odd number of them."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)))))


#: Steps after which the automaton looks whether it can still succeed.
PROBE = 32


def within(x: Column, y: Column, most: int = 1) -> Column:
    """Whether two arrays are within edit distance ``most``: a banded bit-parallel automaton.

    Bit k of word d: the first j + k - most elements of ``x`` and the first j of ``y`` are within d edits."""
    width, full = 2 * most + 1, F.lit((1 << (2 * most + 1)) - 1).cast("long")
    m, n, none = F.size(x), F.size(y), F.lit(0).cast("long")
    start = F.array(*[F.lit(sum(1 << k for k in range(most, most + d + 1))).cast("long") for d in range(most + 1)])

    def step(state: Column, j: Column) -> Column:
        here, same = F.get(y, j), none
        for k in range(width):
            same = same.bitwiseOR(F.when(F.get(x, j + (k - most)) == here, F.lit(1 << k).cast("long")).otherwise(none))
        words: list[Column] = []
        for d in range(most + 1):
            new = F.get(state, F.lit(d)).bitwiseAND(same)
            if d:
                less = F.get(state, F.lit(d - 1))
                new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(new.bitwiseAND(full))
        return F.array(*words)

    def accepts(state: Column) -> Column:
        return F.call_function("shiftright", F.get(state, F.lit(most)), m - n + most).bitwiseAND(F.lit(1).cast("long")) == 1

    def rest(state: Column) -> Column:
        over = F.aggregate(F.sequence(F.lit(PROBE), n - 1), state, step)
        return F.when(F.get(state, F.lit(most)) == 0, False).when(n <= PROBE, accepts(state)).otherwise(accepts(over))

    first = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(PROBE)) - 1), start, step)).otherwise(start)
    return (F.abs(m - n) <= most) & let(first, rest)


def common(x: Column, y: Column) -> Column:
    """How many elements the heads of two arrays share."""
    n = F.least(F.size(x), F.size(y))
    at = F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: a == b), False)
    return F.when(at > 0, at.cast("int") - 1).otherwise(n)


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of ``value``, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def near_codes(x: Column, y: Column, most: int) -> Column:
    """Whether two lines' codes are within the distance that the shorter allows; common ends, which don't change it, go first."""

    def without_heads(a: Column, b: Column) -> Column:
        return let(common(a, b), lambda n: F.struct(F.reverse(F.slice(a, n + 1, F.size(a))).alias("x"), F.reverse(F.slice(b, n + 1, F.size(b))).alias("y")))

    def judged(p: Column) -> Column:
        out = F.lit(False)
        for k in range(1, most + 1):
            out = F.when(allowed(F.least(F.size(x), F.size(y)), most) == k, within(p["x"], p["y"], k)).otherwise(out)
        return out

    return let(without_heads(x, y), lambda p: let(without_heads(p["x"], p["y"]), judged))


def verified(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """h, c of the later line of each pair (a, b) of line names that is near; ``texts`` has first and codes by h, c."""
    t = texts.select(F.struct(*LINE).alias("line"), F.struct("first", "codes").alias("t"))
    both = pairs.join(t.select(F.col("line").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("line").alias("b"), F.col("t").alias("tb")), "b")
    both = both.select("a", "b", (F.col("ta.first") < F.col("tb.first")).alias("forward"), F.col("ta.codes").alias("x"), F.col("tb.codes").alias("y"))
    both = both.where(F.abs(F.size("x") - F.size("y")) <= most).where(near_codes(F.col("x"), F.col("y"), most))
    return both.select(F.when(F.col("forward"), F.col("b")).otherwise(F.col("a")).alias("line")).select("line.*")


def met(entries: DataFrame) -> DataFrame:
    """The entries (h, c, key, own) of keys where two lines meet, one of them as its own; with ``n``, how many."""
    one = F.lit(1).cast("long") + F.when(F.col("own"), F.lit(1 << 32)).otherwise(0)
    keys = entries.groupBy("key").agg(F.sum(one).alias("w")).select("key", F.col("w").bitwiseAND(F.lit((1 << 32) - 1)).alias("n"), F.shiftright("w", 32).alias("mine")).where("n > 1 AND mine > 0")
    # Both sides grow with the data, so the join is a sort-merge join at any size.
    return written(entries.join(keys.select("key", "n").hint("merge"), "key"), "line-keys")


def close_pairs(groups: DataFrame, most: int) -> DataFrame:
    """a, b: names of the lines of a group (``of``; CROWDED at most) that parities and lengths let be near, the lesser first."""
    member = F.struct(*LINE, "own", "size", "chars", "twos")
    per = groups.groupBy("of").agg(F.collect_list(member).alias("g"))
    name = lambda e: F.struct(*[e[k].alias(k) for k in LINE])

    def may(a: Column, b: Column) -> Column:
        far = lambda k: F.bit_count(a[k].bitwiseXOR(b[k]))
        return (F.abs(a["size"] - b["size"]) <= most) & (far("chars") <= 2 * most) & (far("twos") <= 4 * most) & ((a["h"] < b["h"]) | ((a["h"] == b["h"]) & (a["c"] < b["c"])) | (~b["own"] & ((a["h"] != b["h"]) | (a["c"] != b["c"]))))

    def of(a: Column) -> Column:
        return F.transform(F.filter("g", lambda b: may(a, b)), lambda b: F.struct(F.least(name(a), name(b)).alias("a"), F.greatest(name(a), name(b)).alias("b")))

    pairs = F.flatten(F.transform(F.filter("g", lambda a: a["own"]), of))
    return per.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def in_blocks(crowded: DataFrame) -> DataFrame:
    """Entries of crowded keys in groups of CROWDED at most: blocks of each key's lines, two by two."""
    blocks = F.ceil(F.col("n") * 3 / CROWDED)  # blocks are uneven by chance
    own = F.pmod(F.xxhash64(*LINE, F.lit(7)), blocks)
    rows = crowded.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.withColumn("of", F.struct("key", F.least(own, "k").alias("x"), F.greatest(own, "k").alias("y")))


def near_lines(lines: DataFrame, most: int) -> DataFrame:
    """h, c of the distinct ``lines`` (h, c, first, line, keys) that are near an earlier one."""
    since, entries, found = made(), lines.select(*LINE, F.explode("keys").alias("e")).where("e IS NOT NULL").select(*LINE, "e.*"), []
    for segments in (*FINER, None):
        shared = met(entries)
        asked = shared.groupBy(*LINE).agg(F.max(F.col("n") > CROWDED).alias("crowded"))
        texts = lines.join(asked.hint("merge"), LINE).select(*LINE, "first", "line", codes(F.col("line")).alias("codes"), "crowded")
        twos = F.zip_with(F.slice("codes", F.lit(1), F.greatest(F.size("codes") - 1, F.lit(0))), F.slice("codes", F.lit(2), F.size("codes")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        texts = written(texts.withColumns({"chars": parities(F.col("codes")), "twos": parities(twos)}), "line-texts")
        marks = texts.select(*LINE, F.size("codes").alias("size"), "chars", "twos")
        known = shared.join(marks, LINE)
        groups = known.where(F.col("n") <= CROWDED).withColumn("of", F.struct("key", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
        if segments is None:
            groups = groups.unionByName(in_blocks(known.where(F.col("n") > CROWDED)).select(*groups.columns))
        found.append(verified(written(close_pairs(groups, most), "line-pairs"), texts, most))
        again = texts.where("crowded")
        if segments is None or again.isEmpty():
            break
        entries = again.select(*LINE, F.explode(finer_keys(F.col("line"), segments, most)).alias("e")).select(*LINE, "e.*")
    out = written(reduce(DataFrame.unionByName, found).distinct(), "near-lines")
    clean(lines.sparkSession, since, newest=1)
    return out


def kept_places(docs: DataFrame, most: int) -> DataFrame:
    """known, doc, version, kept and firsts: of each document, the places of its lines that stay, and of those that occur there first."""
    rows = places(docs).select("known", "doc", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    rows = rows.select(F.xxhash64("line").alias("h"), F.hash("line").alias("c"), F.struct(*PLACE).alias("first"), "line")
    distinct = rows.groupBy(*LINE).agg(F.min("first").alias("first"), F.any_value("line").alias("line"))
    lines = bucketed(with_keys(distinct, most), "distinct-lines", *LINE)
    near = near_lines(lines, most).withColumn("near", F.lit(True))
    marked = lines.select(*LINE, "first").join(near.hint("merge"), LINE, "left")
    return marked.groupBy("first.known", "first.doc", "first.version").agg(F.count("*").alias("firsts"), F.collect_list(F.when(F.col("near").isNull(), F.col("first.line_no"))).alias("kept"))


def dedup(docs: DataFrame, most: int = MOST) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and any others), ``text`` without the lines that go, with _lines, _blank, _exact and _near: numbers of lines, of blank ones, and of those gone as copies and as near copies (columns of these names are replaced)."""
    # Other columns travel in one struct, so that their names don't matter here.
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))
    kept = kept_places(docs.select("doc_id", "text"), most)
    same = (F.col("doc_id").isNotNull() == F.col("known")) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")) == F.col("doc")) & (F.xxhash64("text") == F.col("version"))
    out = rows.join(kept.hint("merge"), same, "left").withColumns({"cut": F.split("text", "\n"), "kept": F.coalesce("kept", F.array().cast("array<int>"))})
    out = out.withColumn("empty", F.filter(F.transform("cut", lambda x, k: F.when(F.trim(x) == "", k)), lambda k: k.isNotNull()))
    stays = F.transform(F.array_sort(F.concat("kept", "empty")), lambda k: F.get("cut", k))
    zero = F.lit(0)
    counts = {"_lines": F.coalesce(F.size("cut"), zero), "_blank": F.coalesce(F.size("empty"), zero), "firsts": F.coalesce("firsts", zero), "clean": F.when(F.col("text").isNotNull(), F.array_join(stays, "\n"))}
    gone = {"_exact": F.when(F.col("text").isNull(), 0).otherwise(F.col("_lines") - F.col("_blank") - F.col("firsts")), "_near": F.col("firsts") - F.size("kept")}
    out = out.withColumns(counts).withColumns(gone)
    own = {"doc_id": F.col("doc_id"), "text": F.col("clean").alias("text")}
    new = ("_lines", "_blank", "_exact", "_near")
    return out.select(*[own[c] if c in own else F.col("rest")[c].alias(c) for c in docs.columns if c not in new], *new)


def _without_head(a: str, b: str) -> str:
    """DuckDB: how many characters the heads of two strings share."""
    return f"list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda i: substring({a}, 1, i) = substring({b}, 1, i)))"


def oracle(most: int = MOST) -> str:
    """doc_id, n_lines, n_exact, n_near and text_md5 over DuckDB's ``documents`` with distinct, known ids, every pair of lines of like length compared.

    DuckDB's levenshtein counts bytes, so pairs it leaves (4 bytes a character) are judged again by characters: after the
    heads that two lines share, each way of one edit leads to a pair that has one edit less to go."""
    step, cases = [], []
    for k in range(most):
        a, b = f"a{k}", f"b{k}"
        ways = [(f"substring({a}, h + 2)", f"substring({b}, h + 2)"), (f"substring({a}, h + 2)", f"substring({b}, h + 1)"), (f"substring({a}, h + 1)", f"substring({b}, h + 2)")]
        cut = f"(SELECT *, {_without_head(a, b)} AS h FROM s{k})"
        step.append(f"s{k + 1} AS (" + " UNION ".join(f"SELECT id, later, edits, {x} AS a{k + 1}, {y} AS b{k + 1} FROM {cut}" for x, y in ways) + ")")
        cases.append(f"SELECT later FROM s{k + 1} WHERE edits >= {k + 1} AND a{k + 1} = b{k + 1}")
    return f"""
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
firsts AS (SELECT line, length(line) AS n, min((doc_id, k)) AS f FROM cut WHERE trim(line, ' ') <> '' GROUP BY line),
s0 AS (SELECT row_number() OVER () AS id, b.line AS later, least({most}, greatest(1, least(a.n, b.n) // {PER_EDIT})) AS edits, a.line AS a0, b.line AS b0
  FROM firsts a JOIN firsts b ON a.n BETWEEN b.n - {most} AND b.n + {most} AND a.f < b.f WHERE levenshtein(a.line, b.line) <= {4 * most}),
{", ".join(step)},
near AS ({" UNION ".join(cases)}),
judged AS (SELECT cut.*, trim(line, ' ') = '' AS blank, f = (doc_id, k) AS is_first, line IN (SELECT later FROM near) AS is_near FROM cut LEFT JOIN firsts USING (line))
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(t, '')) END AS text_md5
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (WHERE NOT blank AND NOT is_first))::BIGINT AS n_exact, (count(*) FILTER (WHERE NOT blank AND is_first AND is_near))::BIGINT AS n_near,
    string_agg(line, chr(10) ORDER BY k) FILTER (WHERE blank OR (is_first AND NOT is_near)) AS t
  FROM judged GROUP BY doc_id) USING (doc_id)"""
