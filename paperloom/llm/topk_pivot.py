"""Exact top-k inner products by pivot-table elimination.

Vectors are made integer: floor(SCALE * x).  A table holds each vector's Euclidean distances to
PIVOTS pivots, chosen farthest-first from a bounded sample.  For a query the greatest difference
of their distances to a pivot bounds the distance from below, and with the norms the inner product
from above:  <q, c> <= (|q|^2 + |c|^2 - bound^2) / 2.  Bounds carry a margin for rounding, scores are exact.

1. Rows are dealt by ranges of (nearest pivot, distance to it), so a crowded pivot is split, and
   packed into blocks of BLOCK with the least and greatest distances to each pivot; queries, into
   packs of PACK with the same and each one's floor, its k-th score within its own block.
2. A pack meets a block only if the bound of these ranges reaches the least floor of the pack.
   Packs are dealt to slices, so a task holds one block and some SLICE packs.
3. In a task, a query's candidates of sufficient bound are evaluated in falling order of it, in
   growing steps, until it is under the k-th score found.  Each task's k best are merged.

Nothing of the vectors goes through the driver but the pivots' sample.  Where no bound excludes
anything, every pack meets every block: queries are copied once for each block of rows, in blocks.

Vectors that are null or empty, hold null or non-finite components, or have a null id take no
part; vectors of other lengths than a query's are no candidates of it.  Every row but the query's
own is a candidate, so rows that repeat its id are, and of rows that repeat a query's id each is a
query with its own ranks.  Ties go to the lesser vec_id.  Scores beyond 64 bits are cut to the
least or greatest such integer.  An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.llm.shared import arrow_schema, written

PIVOTS, SAMPLE, SCALE = 32, 1000, 256
#: Rows of a block, queries of a pack, packs of a slice (about).
BLOCK, PACK, SLICE = 4096, 512, 8
#: Sample vectors in a group that gets a pivot of its own, at least.
CROWD = 3
#: Candidates evaluated first in bound order; each step has four times as many as the one before.
STEP = 64
#: Beyond this, products of floats are no longer exact integers.
EXACT = 2.0**53


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<long>) of the rows that take part."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By vector length, up to ``count`` pivots among about ``sample`` vectors of least hashed id: first those with most others near, each group once, as a near pivot tells all far vectors apart; then farthest-first."""
    n = max(1, vectors.count())
    low = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * sample / n))
    by: dict[int, list] = {}
    for r in vectors.where(low).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for size, rows in by.items():
        x = np.array(rows, np.float64)
        apart = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * x @ x.T))
        close, at = apart < np.median(apart) / 2, []
        while len(at) < count // 2 and (held := close.sum(axis=1)).max() >= CROWD:
            at.append(int(held.argmax()))
            close &= ~close[at[-1]]  # its group is covered
        at = at or [0]
        far = apart[at].min(axis=0)
        while len(at) < min(count, len(x)) and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, apart[at[-1]])
        out[size] = x[at]
    return out


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray], is_query: Column) -> DataFrame:
    """vec_id, v, row (a number of its own), asks, d (distances to its length's pivots; none if there are none), cell (the nearest pivot) and near (distance to it)."""
    ddl = "vec_id long, v array<long>, row long, asks boolean, d array<double>, cell long, near double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("v").to_pylist()
            d: list = [[] for _ in rows]
            for size in {len(r) for r in rows} & pivots.keys():
                at = [k for k, r in enumerate(rows) if len(r) == size]
                for k, x in zip(at, to_pivots(np.array([rows[k] for k in at], np.float64), pivots[size]), strict=True):
                    d[k] = x
            cell = [int(np.argmin(x)) if len(x) else 0 for x in d]
            given = {c: b.column(c) for c in ("vec_id", "v", "row", "asks")}
            yield pa.RecordBatch.from_pydict(given | {"d": d, "cell": cell, "near": [float(x[k]) if len(x) else 0.0 for x, k in zip(d, cell, strict=True)]}, schema=schema)

    numbered = vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    return numbered.mapInArrow(run, ddl)


class Best:
    """The k best (score, id, row) of a query: by falling score, then id, then row."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.rows = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s, i, r = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
        at = np.lexsort((r, i, ~s))[: self.k]  # ~s falls as s rises, over all 64 bits
        self.scores, self.ids, self.rows = s[at], i[at], r[at]


class Pack:
    """Vectors of one length: ids, rows, v (integers; x is the same as floats), d, and floors (of queries)."""

    def __init__(self, size: int, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, d: np.ndarray, floors: np.ndarray):
        self.size, self.ids, self.rows, self.v, self.d, self.floors = size, ids, rows, v, d, floors
        self.x = v.astype(np.float64)

    def bytes(self) -> bytes:
        return b"".join(np.ascontiguousarray(a).tobytes() for a in (self.ids, self.rows, self.v, self.d, self.floors))

    @classmethod
    def read(cls, size: int, n: int, blob: bytes) -> Pack:
        at, out = 0, []
        width = (len(blob) // 8 - 3 * n) // n
        for kind, many in ((np.int64, 1), (np.int64, 1), (np.int64, size), (np.float64, width - size), (np.float64, 1)):
            out.append(np.frombuffer(blob, kind, n * many, at).reshape(n, many))
            at += 8 * n * many
        return cls(size, out[0].ravel(), out[1].ravel(), out[2], out[3], out[4].ravel())


def search_block(c: Pack, q: Pack, best: list[Best]) -> int:
    """Offers a block of candidates to queries of the same length; returns how many products were computed."""
    safe = max(1.0, np.abs(c.x).max()) * max(1.0, np.abs(q.x).max()) * c.size < EXACT
    exact_c = None if safe else c.v.tolist()
    nx, nq, done = (c.x * c.x).sum(axis=1), (q.x * q.x).sum(axis=1), 0
    for k, own in enumerate(best):
        floor = max(q.floors[k], own.floor())
        bound = np.abs(c.d - q.d[k]).max(axis=1, initial=0.0)
        top = (nq[k] + nx - bound * bound) / 2 + 1e-9 * (nq[k] + nx) + 1e-3
        order = np.flatnonzero((top >= floor) & (c.rows != q.rows[k]))
        order, at, step = order[np.argsort(-top[order], kind="stable")], 0, STEP
        while at < len(order) and top[order[at]] >= floor:
            now = order[at : at + step]
            if safe:
                scores = (c.x[now] @ q.x[k]).astype(np.int64)
            else:
                mine = q.v[k].tolist()
                scores = np.array([min(max(sum(x * y for x, y in zip(exact_c[j], mine, strict=True)), -(1 << 63)), (1 << 63) - 1) for j in now], np.int64)
            some = scores >= floor
            own.add(scores[some], c.ids[now][some], c.rows[now][some])
            floor, done, at, step = max(floor, own.floor()), done + len(now), at + len(now), 4 * step
    return done


def packs(table: DataFrame, k: int) -> DataFrame:
    """kind (0 block, 1 pack of queries), block, size, n, lo and hi (distances to pivots), norm (greatest square), floor (least), blob."""
    ddl = "kind long, block long, size long, n long, lo array<double>, hi array<double>, norm double, floor double, blob binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        asked: list[Pack] = []

        def out(kind: int, p: Pack) -> pa.RecordBatch:
            nonlocal number
            number += 1
            row = (kind, number, p.size, len(p.ids), p.d.min(axis=0), p.d.max(axis=0), float((p.x * p.x).sum(axis=1).max()), float(p.floors.min()), p.bytes())
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, [[v] for v in row], strict=True)), schema=schema)

        def asked_for() -> pa.RecordBatch:
            p = Pack(asked[0].size, *(np.concatenate([getattr(a, f) for a in asked]) for f in ("ids", "rows", "v", "d", "floors")))
            asked.clear()
            return out(1, p)

        def close() -> Iterator[pa.RecordBatch]:
            ids, row, asks = (np.array([r[j] for r in rows]) for j in (0, 2, 3))
            p = Pack(len(rows[0][1]), ids, row, np.array([r[1] for r in rows], np.int64), np.array([r[4] for r in rows], np.float64).reshape(len(rows), -1), np.full(len(rows), -np.inf))
            rows.clear()
            yield out(0, p)
            if asks.any():
                if asked and asked[0].size != p.size:
                    yield asked_for()
                q = Pack(p.size, p.ids[asks], p.rows[asks], p.v[asks], p.d[asks], p.floors[asks])
                best = [Best(k) for _ in q.ids]
                search_block(p, q, best)
                q.floors = np.array([b.floor() for b in best])
                asked.append(q)
                if sum(len(a.ids) for a in asked) >= PACK:
                    yield asked_for()

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("vec_id", "v", "row", "asks", "d")), strict=True):
                if rows and (len(rows) >= BLOCK or len(rows[0][1]) != len(r[1])):
                    yield from close()
                rows.append(r)
        if rows:
            yield from close()
        if asked:
            yield asked_for()

    ranged = table.repartitionByRange(F.size("v"), "cell", "near", "row").sortWithinPartitions(F.size("v"), "cell", "near", "row")
    return ranged.select("vec_id", "v", "row", "asks", "d").mapInArrow(run, ddl)


def found_in(packed: DataFrame, k: int) -> DataFrame:
    """asker (the query's row), query_id, vec_id, score, row: the k best of each task for each query; rows with no asker tell in ``score`` how many products a task computed."""
    q = packed.where("kind = 1")
    slices = -(-max(1, q.count()) // SLICE)
    mine = q.select("size", F.col("block").alias("pack"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), F.col("norm").alias("qnorm"), "floor", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"))
    blocks = packed.where("kind = 0").select("size", "block", "lo", "hi", "norm").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    apart = F.zip_with(F.zip_with("qlo", "hi", lambda x, y: x - y), F.zip_with("lo", "qhi", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    bound = F.greatest(F.lit(0.0), F.coalesce(F.array_max(apart), F.lit(0.0)))
    norms = F.col("norm") + F.col("qnorm")
    some = written(blocks.join(mine, ["size", "slice"]).where((norms - bound * bound) / 2 + 1e-9 * norms + 1e-3 >= F.col("floor")).select("block", "slice", "pack"), "block-pairs")
    left = some.select("block", "slice").distinct().join(packed.where("kind = 0").select("block", "size", "n", "blob"), "block").select("block", "slice", "size", "n", "blob")
    right = some.join(q.select(F.col("block").alias("pack"), "size", "n", "blob"), "pack").select("block", "slice", "size", "n", "blob").toDF("to", "of", "qsize", "qn", "qblob")

    def search(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        c, out, done = Pack.read(int(here["size"][0]), int(here["n"][0]), here["blob"][0]), [], 0
        for size, n, blob in zip(there["qsize"], there["qn"], there["qblob"], strict=True):
            q = Pack.read(int(size), int(n), blob)
            best = [Best(k) for _ in q.ids]
            done += search_block(c, q, best)
            out += [(row, i, *x) for row, i, b in zip(q.rows, q.ids, best, strict=True) for x in zip(b.ids, b.scores, b.rows, strict=True)]
        frame = pd.DataFrame(out, columns=["asker", "query_id", "vec_id", "score", "row"]).astype("Int64")
        return pd.concat([frame, pd.DataFrame({"score": [done]}, dtype="Int64").reindex(columns=frame.columns).astype("Int64")])

    return left.groupBy("block", "slice").cogroup(right.groupBy("to", "of")).applyInPandas(search, "asker long, query_id long, vec_id long, score long, row long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ``is_query`` is a condition on vec_id."""
    return ranked(candidates(vectors, is_query, k, id_col, vector_col, scale), k)


def candidates(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """As ``found_in``, written."""
    own = integer_vectors(vectors, id_col, vector_col, scale)
    table = written(pivot_table(own, choose_pivots(own), is_query), "pivot-table")
    return written(found_in(written(packs(table, k), "vector-packs"), k), "top-k")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    return found.where("asker IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def products(found: DataFrame) -> int:
    """Products that the tasks computed."""
    return found.where("asker IS NULL").agg(F.sum("score")).first()[0] or 0


def oracle(k: int = 5, every: int = 50, scale: int = SCALE) -> str:
    """Brute force over DuckDB's ``embeddings``."""
    return f"""
WITH own AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r AS asker, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM own q JOIN own c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id) <= {k}"""
