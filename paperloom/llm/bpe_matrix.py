"""Byte-level BPE by numpy matrices, in the manner of a ranks file.

Distinct pieces of a batch are dealt to matrices by byte length, a power of two wide and padded.
Each round, every row that still can merges its leftmost pair of least rank: ranks of pairs come
from an open-addressing hash table over the packed pair, the row is compacted one place to the
left, and only the two pairs beside the merge are looked up anew.  Rows that have no pair left
leave their matrix.  Pieces longer than LONGEST bytes, which would make a round dear, merge by a
heap over a linked list, to the same result.

Nulls: null text is empty text (no ids).  Special tokens are ordinary text.  Null ids and rows that
repeat are each encoded; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import by_batch
from paperloom.llm.units import _PLAIN, _UNIT, LONGEST_KEPT

LONGEST = 512
#: No pair: greater than any rank.
NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Merged id of a pair of ids, NONE where the ranks have none; linear probing, a third full at most."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.bits = max(4, (3 * len(found)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        self.pairs = found
        keys, ids = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.ids[at[free]] = keys[free], ids[free]
            lost = self.keys[at] != keys  # taken before, or by another of this round
            keys, ids, at = keys[lost], ids[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at, out = self._slots(keys), np.full(keys.shape, NONE, np.int64)
        out, keys, at = out.ravel(), keys.ravel(), at.ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class MatrixBpe:
    """Encoder and decoder by one ranks file and piece pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_kept: int = 250_000):
        import regex

        self.ranks, self.pieces, self.table, self.most_kept = ranks, regex.compile(pattern).findall, PairTable(ranks), most_kept
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}
        held = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            held[r] = t
        self.lengths = np.array([len(t) for t in held], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(held), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: gathered from all tokens' bytes laid end to end."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.blob[at].tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = np.array([whole])
            elif len(p) > LONGEST:
                out[k] = self._by_heap(p)
            else:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for width, rows in by_width.items():
            block = max(1, (1 << 20) // width)
            for s in range(0, len(rows), block):
                self._matrix([pieces[k] for k in rows[s : s + block]], width, rows[s : s + block], out)
        return out

    def _matrix(self, pieces: list[bytes], width: int, places: list[int], out: list) -> None:
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        sizes = np.array([len(p) for p in pieces])
        ids[np.arange(width + 1) < sizes[:, None]] = self.bytes_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank, place = self.table.look(ids[:, :-1], ids[:, 1:]), np.array(places)
        col = np.arange(width + 1)
        while len(ids):
            at = rank.argmin(axis=1)  # the first of the least
            best = rank[np.arange(len(ids)), at]
            if (done := best == NONE).any():
                for k in np.flatnonzero(done):
                    out[place[k]] = ids[k][ids[k] >= 0]
                go = ~done
                ids, rank, place, at, best = ids[go], rank[go], place[go], at[go], best[go]
                if not len(ids):
                    break
                width = max(1, int((ids >= 0).sum(axis=1).max()))
                ids, rank, col = ids[:, : width + 1], rank[:, :width], np.arange(width + 1)
            row = np.arange(len(ids))
            ids[row, at] = best
            take = np.minimum(col + (col > at[:, None]), width)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, take[:, :-1].clip(max=width - 1), 1)
            rank[:, -1] = NONE
            rank[row, at] = self.table.look(best, ids[row, at + 1])
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.table.look(ids[before, at[before] - 1], best[before])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        ids = self.bytes_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.table.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := pairs.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if ids[k] < 0 or (m := after[k]) < 0 or pairs.get(ids[k] << 32 | ids[m]) != r:
                continue
            ids[k], ids[m], after[k] = r, -1, after[m]
            if after[k] >= 0:
                before[after[k]] = k
                if (x := pairs.get(r << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (x, k))
            if (b := before[k]) >= 0 and (x := pairs.get(ids[b] << 32 | r)) is not None:
                heapq.heappush(heap, (x, b))
        return np.array([i for i in ids if i >= 0], np.int64)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text; the units that the worker hasn't met yet go through the matrices together."""
        if len(self.known) > self.most_kept:
            self.known.clear()
        cut, odd = [], re.compile(_PLAIN.pattern).fullmatch
        fresh: dict[str, None] = {}
        for t in texts:
            head, *parts = (t or "").replace("\n", " \n").split(" ")
            units = [p if p[:1] == "\n" else f" {p}" for p in parts]
            new = [u for u in units if u not in self.known and u not in fresh]
            if (head and not odd(head)) or not all(odd(u[1:] if u[0] == " " else u) for u in new):
                units = _UNIT.findall(t)
                new = [u for u in units if u not in self.known]
            elif head:
                units.insert(0, head)
                new.append(head)
            fresh.update(dict.fromkeys(new))
            cut.append(units)
        todo = [u for u in fresh if u not in self.known]
        in_units = [[p.encode() for p in self.pieces(u)] for u in todo]
        distinct = list(dict.fromkeys(p for ps in in_units for p in ps))
        ids = {p: i.astype("<u4").tobytes() for p, i in zip(distinct, self.encode_pieces(distinct), strict=True)}
        own = {u: b"".join(map(ids.__getitem__, ps)) for u, ps in zip(todo, in_units, strict=True)}
        long = {u: own.pop(u) for u in todo if len(u) > LONGEST_KEPT}
        self.known.update(own)
        known = self.known
        return [np.frombuffer(b"".join(known[u] if u in known else long[u] for u in units), "<u4") for units in cut]


_held: dict[tuple[str, str], MatrixBpe] = {}


def held(path: str, pattern: str) -> MatrixBpe:
    """The worker's own codec."""
    if (path, pattern) not in _held:
        _held[path, pattern] = MatrixBpe(read_ranks(path), pattern)
    return _held[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers) of every whole text."""

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["i"], "ids": [x.tobytes() for x in held(path, pattern).encode(c["t"])]}

    return by_batch(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, bytes: what the ids stand for."""

    def run(c: dict[str, list]) -> dict[str, list]:
        codec = held(path, pattern)
        return c | {"bytes": [codec.decode(np.frombuffer(i, "<u4").astype(np.int64)) for i in c["ids"]]}

    return by_batch(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, bytes binary")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
