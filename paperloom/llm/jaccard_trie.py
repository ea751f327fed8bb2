"""Components of documents whose word-shingle sets are similar: an exact prefix-tree join.

1. Documents with equal sets form a class; from here on a class is one set.
2. Filter.  In a set's tokens by hash order, two sets that link share at least as many tokens of
   their extended prefixes as ``needed`` says.  The tokens of these prefixes, packed into one
   buffer a task and hash bucket, meet in reducers that credit a class for each token some other
   class has; a task sends a token once, however many of its classes hold it.  Classes with too
   few credits link with nothing.
   The rest, usually few, is named in a Bloom filter of bounded size, so that the pass that
   makes every row's class keeps the sets of (nearly) only those.  Up to here a class goes by the
   first 64 bits of its 128-bit digest, and classes that share them only pass too easily; from
   here by a number of its own.
3. These get a global order: tokens nobody shares, then by document frequency,
   then by hash.  Classes that share a prefix token of that order are candidates, if one of them
   shares tokens enough to link with a set of its own size or more.  The least such class of a
   token is its hub, so there are as many edges as postings, and the connected components of
   these edges are supersets of the true ones.
4. A component is dealt to blocks of about BLOCK classes.  In a block the ordered sets form a
   prefix tree of compressed paths; every set traverses it, sharing the overlap counted along a
   path, and leaves a subtree when the shorter of the remaining lengths cannot bring the overlap
   to what the sizes ask for, or when all of it is in the set's own component already, so a group
   of near copies costs about one traversal each.
5. Components of several blocks are finished exactly: first some representatives of each block's
   result are joined; then classes of different results that share a prefix token and whose sizes
   allow it are compared one by one.  So a set travels once to its block, and again for each class
   of another result that shares one of its rarest tokens, never to a whole component.

Only components are found, not all pairs.  Null ids and repeated rows: a row is judged by its
text, and equal sets share a component, whose id is the least id in it (null if it has none).
Null, empty or blank texts have no shingles and are linked with nothing.  An empty table gives an
empty one; other columns of the input, whatever their names, are not read.

Cost: the filter has 2^28 bits at most.  Beyond some 17 million candidate classes it lets others
through too (about a quarter of them at 100 million, nearly all at a billion), whose sets are then
written and dropped in step 3: results stay the same, the written sets grow to those of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import arrow_schema, by_batch, tidy, written

BLOCK = 1000
#: Representatives of each result of a block.
ENVOYS = 16
#: Tokens that a task of step 2 gathers before it sends them, and that a bucket holds about.
CHUNK, BUCKET = 1 << 19, 1 << 18
#: Words whose hashes a worker keeps at most.
MOST_WORDS = 100_000
_words: dict[bytes, int] = {}


class Threshold:
    """Jaccard at least ``least`` of a hundred, in integers."""

    def __init__(self, least: int):
        self.least = least

    def links(self, overlap: int, n: int, m: int) -> bool:
        return 100 * overlap >= self.least * (n + m - overlap)

    def overlap(self, n: int, m: int) -> int:
        """Least overlap of linked sets of n and m tokens."""
        return -(-self.least * (n + m) // (100 + self.least))

    def prefix(self, n):
        """Tokens of which a set shares at least one with any it links with."""
        return n - -(-self.least * n // 100) + 1

    def extended(self, n):
        """Twice the tokens that may be missing, and one."""
        return 2 * (self.prefix(n) - 1) + 1

    def partner(self, shared: Column, n: Column) -> Column:
        """Tokens of the largest set that one of n tokens, ``shared`` of which others have, can link with."""
        return F.floor(shared * (100 + self.least) / self.least) - n

    def needed(self, n):
        """Tokens of its extended prefix that a set must share with one it links with, whose size may be smaller."""
        return self.prefix(-(-self.least * n // 100))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the ``size``-word shingles of a text; of fewer words, one of them all."""
    words = text.encode().lower().split() if text else ()  # bytes: A-Z, and white space 09-0D and 20
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MOST_WORDS:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = _mixed(h[: len(h) - size + 1] + np.uint64(size))
    for k in range(1, size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else b""


def short(d: bytes) -> int:
    """The first 64 bits, never 0."""
    return int.from_bytes(d[:8], "little", signed=True) or 1


def credits(docs: DataFrame, size: int, limit: Threshold, buckets: int, text_col: str) -> DataFrame:
    """short, credit, needed: how many tokens of each class's extended prefix another class has in its own, and how many that must be."""
    sent = arrow_schema("bucket long, blob binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, held, needs = [], [], 0, {}

        def send() -> pa.RecordBatch:
            pair = np.empty((held, 2), np.uint64)
            pair[:, 0], pair[:, 1] = np.concatenate(tokens), np.concatenate(owners)
            pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
            pair = pair[np.append(True, (pair[1:] != pair[:-1]).any(axis=1))]
            first = np.append(True, pair[1:, 0] != pair[:-1, 0])
            many = np.diff(np.append(np.flatnonzero(first), len(pair))) > 1
            # A token of several classes here: each gets its credit now, and the token goes out once, owned by 0.
            shared = np.repeat(many, np.diff(np.append(np.flatnonzero(first), len(pair))))
            out = pair[first]
            out[many, 1] = 0
            who, n = np.unique(pair[shared, 1], return_counts=True)
            bucket = _mixed(out[:, 0]) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(b, out[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            given = np.array([(o, k) for o, k in needs.items()], np.uint64).reshape(-1, 2)
            given = np.column_stack([given, np.zeros(len(given), np.uint64)])
            given = given[np.argsort(given[:, 0])]
            given[np.searchsorted(given[:, 0], who), 2] = n
            rows.append((-1 - int(given[0, 0] % np.uint64(buckets)), given.tobytes()))
            return pa.RecordBatch.from_pydict({"bucket": [b for b, _ in rows], "blob": [x for _, x in rows]}, schema=sent)

        for b in batches:
            for text in b.column(0):
                own = shingles(text.as_py(), size)
                if not len(own):
                    continue
                owner = np.int64(short(digest(own))).astype(np.uint64)
                size_of = len(own)
                own = own[: limit.extended(size_of)]
                needs[int(owner)] = min(limit.needed(size_of), needs.get(int(owner), size_of))
                tokens.append(own), owners.append(np.full(len(own), owner))
                held += len(own)
                if held >= CHUNK:
                    yield send()
                    tokens, owners, held, needs = [], [], 0, {}
        if held:
            yield send()
        tokens, owners, needs = [], [], {}
        tidy()

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # what each class needs, and the credits given already
            own = np.frombuffer(b"".join(rows["blob"]), np.int64).reshape(-1, 3)
            return pd.DataFrame({"short": own[:, 0], "credit": own[:, 2], "needed": own[:, 1]})
        pair = np.frombuffer(b"".join(rows["blob"]), np.uint64).reshape(-1, 2)
        pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
        new = np.append(True, pair[1:, 0] != pair[:-1, 0])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(pair)))
        # Two owners, or the owner 0 of several: the least and the greatest differ, or the least is 0.
        several = (pair[at, 1] == 0) | (pair[at, 1] != pair[at + size - 1, 1])
        own = pair[np.repeat(several, size)]
        own = own[np.append(True, (own[1:] != own[:-1]).any(axis=1))] if len(own) else own
        who, n = np.unique(own[own[:, 1] != 0, 1], return_counts=True)
        del pair, own
        tidy()
        return pd.DataFrame({"short": who.view(np.int64), "credit": n.astype(np.int64), "needed": np.zeros(len(n), np.int64)})

    blobs = docs.select(F.col(text_col).alias("t")).mapInArrow(gather, "bucket long, blob binary")
    # Partitions follow the data: two or so buckets each.
    met = blobs.repartition(max(1, buckets), "bucket").groupBy("bucket").applyInPandas(meet, "short long, credit long, needed long")
    return met.groupBy("short").agg(F.sum("credit").alias("credit"), F.min(F.when(F.col("needed") > 0, F.col("needed"))).alias("needed"))


class Filter:
    """Bloom filter of two bits an entry, between 2^16 and 2^28 bits; executors make its parts, of 2^15 bits each."""

    PART = 1 << 15

    def __init__(self, ids: DataFrame, column: str):
        self.bits = 1 << min(28, max(16, (16 * ids.count()).bit_length()))
        x = F.col(column)
        # Two slices of the hash, counted from 1 as the bitmap functions do.
        places = F.explode(F.array(*[F.shiftrightunsigned(x, k).bitwiseAND(F.lit(self.bits - 1)) + 1 for k in (0, 32)])).alias("p")
        parts = ids.select(places).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("blob"))
        self.held = np.zeros((self.bits // self.PART, self.PART // 8), np.uint8)
        for r in parts.collect():  # 32 MB at most
            self.held[r["part"] - 1] = np.frombuffer(r["blob"], np.uint8)
        self.held = self.held.ravel()

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = ids.astype(np.int64).view(np.uint64)
        return tuple(((x >> np.uint64(k)) & np.uint64(self.bits - 1)).astype(np.int64) for k in (0, 32))

    def holds(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in self.places(ids):
            out &= (self.held[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


def members(docs: DataFrame, size: int, wanted: Filter, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n, digest and short (null without shingles), hashes (of classes that the filter holds) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # 32 MB at most

    def run(c: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t, size) for t in c["t"]]
        digests = [digest(s) or None for s in sets]
        shorts = [short(d) if d else 0 for d in digests]
        some = held.value.holds(np.array(shorts, np.int64))
        hashes = [s.view(np.int64) if h and len(s) else None for s, h in zip(sets, some, strict=True)]
        return {"doc_id": c["i"], "text_hash": c["x"], "n": list(map(len, sets)), "digest": digests, "short": [x or None for x in shorts], "hashes": hashes}

    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("x"))
    return by_batch(own, run, "doc_id long, text_hash long, n long, digest binary, short long, hashes array<long>")


def connected(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the least node reachable over (a, b) edges, by alternating large and small stars; each round is a table in the shared folder."""
    both = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        # Large star: a node's greater neighbours go to the least of its neighbourhood.
        ways = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        both = written(large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), name)
        now = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


class Tree:
    """Prefix tree of sets, as ascending ranks in the global order, with paths compressed; leaves are in the order of the sets."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.sets, self.sizes = [sets[k] for k in self.order], sizes[self.order]
        lens = [len(s) for s in self.sets]
        # (first leaf, leaf after, depth before, depth after): built from the common prefixes of neighbours.
        self.common = [self._shared(a, b) for a, b in zip(self.sets, self.sets[1:], strict=False)]
        self.lens = lens
        self.root = self._node(0, len(sets), 0)

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return int(other[0]) if len(other) else n

    def _node(self, lo: int, hi: int, depth: int) -> tuple:
        """(lo, hi, segment, deepest remaining length, least size, children)"""
        todo, made = [(lo, hi, depth, None)], None
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = min(self.common[lo : hi - 1]) if hi - lo > 1 else self.lens[lo]
            node = (lo, hi, self.sets[lo][depth:end], max(self.lens[lo:hi]) - end, int(self.sizes[lo:hi].min()), [])
            if parent is None:
                made = node
            else:
                parent[5].append(node)
            if hi - lo > 1:
                cuts = [lo, *(k + 1 for k in range(lo, hi - 1) if self.common[k] == end), hi]
                todo += [(x, y, end, node) for x, y in zip(cuts, cuts[1:], strict=False)]
        return made


def tree_join(sets: list[np.ndarray], sizes: np.ndarray, limit: Threshold, known: np.ndarray | None = None) -> np.ndarray:
    """The component (least position) of each set; ``known`` are components that are known before.

    ``sets`` hold the ranks of the tokens that some other set may share, ``sizes`` count all tokens."""
    tree, n = Tree(sets, sizes), len(sets)
    part = np.array(tree.order) if known is None else known[tree.order]
    changes = None
    for k in range(n - 1):
        x, size, remaining = tree.sets[k], int(tree.sizes[k]), len(tree.sets[k])
        if changes is None:
            changes = np.cumsum(np.append(0, part[1:] != part[:-1]))
        todo, merged = [(tree.root, 0)], False
        while todo:
            (lo, hi, segment, deepest, least, children), overlap = todo.pop()
            if hi <= k + 1 or (changes[hi - 1] == changes[lo] and part[lo] == part[k]):
                continue
            if len(segment):
                at = np.searchsorted(x, segment)
                overlap += int((x[np.minimum(at, remaining - 1)] == segment).sum()) if remaining else 0
                rest = remaining - int(np.searchsorted(x, segment[-1], "right"))
            else:
                rest = remaining
            if overlap + min(rest, deepest) < limit.overlap(size, least):
                continue
            if children:
                todo += [(c, overlap) for c in children]
            else:
                for j in range(max(lo, k + 1), hi):
                    if part[j] != part[k] and limit.links(overlap, size, int(tree.sizes[j])):
                        a, b = sorted((part[j], part[k]))
                        part[part == b] = a
                        merged = True
                if merged:
                    changes, merged = np.cumsum(np.append(0, part[1:] != part[:-1])), False
    out = np.empty(n, part.dtype)
    out[tree.order] = part
    return out


def ranked_sets(frame: pd.DataFrame) -> list[np.ndarray]:
    """Each row's tokens as ranks of (frequency, token) among the frame's."""
    pairs = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in frame["tokens"]]
    every = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    kinds, back = np.unique(every, axis=0, return_inverse=True)
    return [np.sort(x) for x in np.split(back.ravel(), np.cumsum([len(p) for p in pairs])[:-1])]


def _joined(limit: Threshold, column: str):
    """applyInPandas function: cid, other, for the links that join the parts named in ``column`` (or single rows)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid", ignore_index=True).drop_duplicates("cid", ignore_index=True)
        names = rows[column]
        start = pd.factorize(names)[0]
        first = {}
        for k, s in enumerate(start.tolist()):
            first.setdefault(s, k)
        known = np.array([first[s] for s in start.tolist()])
        found = tree_join(ranked_sets(rows), rows["n"].to_numpy(), limit, known)
        return pd.DataFrame({"cid": rows["cid"], "part": rows["cid"].to_numpy()[found] if column == "cid" else names.to_numpy()[found], "was": names})

    return run


def linked_pairs(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """a, b: the parts of the pairs (x, y, a, b) of classes that link; ``sets`` has cid, n, tokens."""
    both = pairs
    for k in ("x", "y"):
        both = both.join(sets.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")), k)

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, n, m, s, t in zip(*(c[k] for k in ("a", "b", "nx", "ny", "tx", "ty")), strict=True):
            s, t = (np.frombuffer(v, np.int64).reshape(-1, 2)[:, 1] for v in (s, t))
            if limit.links(len(np.intersect1d(s, t, assume_unique=True)), n, m):
                out["a"].append(a), out["b"].append(b)
        return out

    return by_batch(both.select("a", "b", "nx", "ny", "tx", "ty"), run, "a long, b long")


def components(sets: DataFrame, edges_by: DataFrame, heads: DataFrame, limit: Threshold) -> DataFrame:
    """cid, root of the classes in candidate components.

    ``sets`` has cid, n, tokens; ``edges_by`` cid, root of candidates; ``heads`` cid, n, most (size of the largest partner), token."""
    kind = "cid long, part long, was long"
    # Both sides grow with the data, so the join is a sort-merge join at any size.
    own = sets.join(edges_by.groupBy("root").agg(F.count("*").alias("size")).join(edges_by, "root").hint("merge"), "cid")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = written(own.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), blocks)), "candidate-sets")
    first = written(own.groupBy("root", "block").applyInPandas(_joined(limit, "cid"), kind), "block-parts").select("cid", "part")
    large = own.where("blocks > 1")
    if large.isEmpty():
        return first.select("cid", F.col("part").alias("root"))
    # Envoys: a few classes of each block's results, by hash, dealt to blocks of their own.
    parts = large.select("cid", "root", "block").join(first, "cid")
    low = parts.groupBy("root", "block", "part").agg(F.count("*").alias("k"))
    envoys = parts.join(low, ["root", "block", "part"]).where(F.pmod(F.xxhash64("cid", F.lit(1)), F.col("k")) < ENVOYS)
    per = envoys.groupBy("root").agg(F.count("*").alias("e"))
    envoys = envoys.join(per, "root").withColumn("deal", F.pmod(F.xxhash64("cid", F.lit(2)), F.ceil(F.col("e") / (2 * BLOCK))))
    envoys = envoys.select("cid", "root", "deal", "part").join(large.select("cid", "n", "tokens"), "cid")
    met = written(envoys.groupBy("root", "deal").applyInPandas(_joined(limit, "part"), kind), "envoy-parts").where("part <> was").select(F.col("was").alias("a"), F.col("part").alias("b"))
    merged = connected(met, "envoy-stars").select(F.col("node").alias("part"), F.col("root").alias("to"))
    parts = written(parts.select("cid", "part").join(merged, "part", "left").select("cid", F.coalesce("to", "part").alias("part")), "envoyed")
    # Exact rest: prefix tokens that several parts hold, and their classes of like size two by two.
    posts = heads.join(parts, "cid")
    mixed = posts.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    live = written(posts.join(mixed.hint("merge"), "token"), "mixed-postings")
    x, y = (live.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("cid", "n", "most", "part")]) for k in "xy")
    fits = (F.col("part_x") != F.col("part_y")) & (F.struct("n_x", "cid_x") < F.struct("n_y", "cid_y")) & (F.col("n_y") <= F.col("most_x")) & (F.col("n_x") <= F.col("most_y"))
    pairs = written(x.join(y, "token").where(fits).select(*[F.col(f"{c}_{k}").alias(z) for c, k, z in (("cid", "x", "x"), ("cid", "y", "y"), ("part", "x", "a"), ("part", "y", "b"))]).distinct(), "rest-pairs")
    links = linked_pairs(pairs, large.select("cid", "n", "tokens"), limit)
    final = connected(met.unionByName(links), "rest-stars").select(F.col("node").alias("part"), F.col("root").alias("to"))
    return first.join(final, "part", "left").select("cid", F.coalesce("to", "part").alias("root"))


def similar_components(docs: DataFrame, size: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets of ``size``-word shingles link from a Jaccard of ``least`` percent."""
    rows, ids = _judged(docs, size, least, F.col("doc_id"), id_col, text_col)
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    return rows.join(ids, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), own)


def representatives(docs: DataFrame, size: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64) of the row of each component that has the least id, null ids last, and of rows with that id the least hash; rows without shingles are components of their own."""
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    rows, ids = _judged(docs, size, least, row, id_col, text_col)
    alone = rows.where("digest IS NULL").select("doc_id", "text_hash")
    return ids.select("least.doc_id", "least.text_hash").unionByName(alone).distinct()


def _judged(docs: DataFrame, size: int, least: int, own: Column, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, n, digest), and by digest the least ``own`` of its component."""
    limit = Threshold(least)
    amount = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # about six bytes a word
    earned = credits(docs, size, limit, max(1, amount // 6 // BUCKET), text_col)
    left = written(earned.where(F.col("credit") >= F.col("needed")).select("short"), "candidates")
    rows = written(members(docs, size, Filter(left, "short"), id_col, text_col), "members")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(own).alias("least"))
    missing = lambda n: n - F.ceil(n * least / 100)
    # The few sets that only the filter lets through share too little and go below.
    some = rows.where("hashes IS NOT NULL").select("digest", "n", "hashes").dropDuplicates(["digest"])
    sets = written(some.withColumn("cid", F.monotonically_increasing_id()), "candidate-hashes")
    tokens = sets.select("cid", F.explode("hashes").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    shared = tokens.join(often, "token").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared")).join(sets.select("cid", "n"), "cid")
    shared = shared.where(F.size("shared") * 100 >= F.col("n") * least)
    alone = F.col("n") - F.size("shared")
    reach = F.greatest(F.lit(0), missing(F.col("n")) + 1 - alone).cast("int")
    shared = shared.withColumn("head", F.transform(F.slice("shared", F.lit(1), reach), lambda s: s["token"]))
    shared = written(shared.withColumn("most", limit.partner(F.size("shared"), F.col("n"))), "ordered-sets")
    heads = shared.select("cid", "n", "most", F.explode("head").alias("token"))
    # Of two sets that link the lesser has a partner of its own size or more.
    hubs = heads.where("most >= n").groupBy("token").agg(F.min("cid").alias("hub"))
    near = connected(heads.join(hubs, "token").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")), "candidate-stars")
    every = near.select(F.col("node").alias("cid"), "root").unionByName(near.select(F.col("root").alias("cid"), "root").distinct())

    def packed(c: dict[str, list]) -> dict[str, list]:
        return {"cid": c["cid"], "n": c["n"], "tokens": [np.array([(s["df"], s["token"]) for s in x], np.int64).tobytes() for x in c["shared"]]}

    ready = by_batch(shared.select("cid", "n", "shared"), packed, "cid long, n long, tokens binary")
    found = components(ready, every, heads, limit)
    joined = classes.join(sets.select("digest", "cid").join(found, "cid"), "digest")
    roots = joined.groupBy("root").agg(F.min("least").alias("of_all"))
    moved = joined.join(roots, "root").select("digest", "of_all")
    return rows, classes.join(moved, "digest", "left").select("digest", F.coalesce("of_all", "least").alias("least"))


def oracle(size: int = 4, least: int = 85) -> str:
    """Over DuckDB's ``documents`` with distinct ids: all pairs that share a shingle, then all that is reachable."""
    return f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i : i + {size - 1}], ' ')) END) AS s FROM worded),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= {least} * (a.n + b.n - count(*))),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.y, reach.root FROM reach JOIN ways ON ways.x = reach.doc_id)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""
