"""Token-id files: one zstandard frame a document under a shared dictionary, with an offset index.

A token file set is a Parquet table of containers, which Spark's commit protocol makes safe
against lost tasks.  A container holds consecutive documents in ascending id order:

* ``shard, container``: place of the container; shards are ascending ranges of ids
* ``first_id, last_id, docs, tokens, start``: ids covered, sizes, and ids before it in its shard
* ``dictionary``: SHA-256 of the dictionary its frames need (table ``dictionary`` beside it)
* ``index``: packed ``ENTRY`` records; ``body``: the frames, each of ids as ``width``-byte little-endian integers

A short document is read by one container's index entry and one frame.
Nulls: a null text counts as empty (one end id); null document ids come first.  Rows that
repeat an id are all kept, next to each other, ordered by a hash of their text.  An empty table
gives an empty set.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.llm.shared import arrow_schema, by_batch, tidy
from paperloom.llm.units import library_encoder, library_table

ENTRY = np.dtype([("id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u4")])
CONTAINER = "shard int, container int, first_id long, last_id long, docs int, tokens long, start long, width int, dictionary string, index binary, body binary"
#: Bounds of the dictionary's training sample: documents, characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 4000
DICTIONARY_BYTES = 64 << 10
BODY_BYTES = 1 << 20


def width_for(vocabulary: str, end_id: int) -> int:
    """Bytes that every id of the vocabulary and the end id fit in: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(vocabulary).get_vocab().values()) < 1 << 16 else 4


def packed(ids: np.ndarray, width: int) -> bytes:
    if width == 2 and len(ids) and ids.max() >= 1 << 16:
        raise ValueError(f"id {ids.max()} does not fit in 2 bytes")
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, width: int) -> bytes:
    """A dictionary from a bounded sample: up to SAMPLE_DOCS documents of low hashed id, the first SAMPLE_CHARS characters of each.  Empty if the sample is too small to train on."""
    few = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count())))  # so that tasks send few rows
    rows = docs.where(few & (F.length(text_col) > 0)).select(F.xxhash64(id_col).alias("h"), F.substring(text_col, 1, SAMPLE_CHARS).alias("t")).orderBy("h", "t").limit(SAMPLE_DOCS).collect()
    samples = [packed(np.append(np.frombuffer(b, "<u4"), end_id), width) for b in library_encoder(vocabulary)([r.t for r in rows])]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int | None = None, id_col: str = "doc_id", text_col: str = "text", body_bytes: int = BODY_BYTES) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the set at ``path`` (``containers`` and ``dictionary``).

    ``width`` is by default 2 where all ids are below 65,536, else 4.  One range shuffle of the texts orders
    them; encoding, compression and packing run in the shuffle's reducers, a batch at a time."""
    spark, width = docs.sparkSession, width or width_for(vocabulary, end_id)
    dictionary = train_dictionary(docs, vocabulary, end_id, id_col, text_col, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    schema = arrow_schema(CONTAINER)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3, write_content_size=True, **_codec(dictionary)).compress
        encode, shard, number, start = library_table(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids, sizes, counts, frames, held = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            index = np.zeros(len(ids), ENTRY)
            index["id"], index["has_id"] = [i or 0 for i in ids], [i is not None for i in ids]
            index["size"], index["n"] = sizes, counts
            index["offset"] = np.cumsum([0, *sizes[:-1]])
            known = [i for i in ids if i is not None]
            row = (shard, number, known[0] if known else None, known[-1] if known else None, len(ids), sum(counts), start, width, sha, index.tobytes(), b"".join(frames))
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, [[x] for x in row], strict=True)), schema=schema)

        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                own = np.append(np.frombuffer(got, "<u4"), np.uint32(end_id))
                frame = compress(packed(own, width))
                ids.append(doc), sizes.append(len(frame)), counts.append(len(own)), frames.append(frame)
                held += len(frame)
                if held >= body_bytes:
                    yield close()
                    number, start = number + 1, start + sum(counts)
                    ids, sizes, counts, frames, held = [], [], [], [], 0
        if ids:
            yield close()
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    ranged = rows.repartitionByRange("i", F.xxhash64("t")).sortWithinPartitions("i", F.xxhash64("t"))
    ranged.mapInArrow(pack, CONTAINER).write.option("compression", "uncompressed").parquet(f"{path}/containers")


def dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    """By hash; one set has one, of DICTIONARY_BYTES at most."""
    out = {r.dictionary: bytes(r.bytes) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    for sha, held in out.items():
        if hashlib.sha256(held).hexdigest() != sha:
            raise ValueError(f"dictionary {sha} is damaged")
    return out


def frames_of(index: bytes, body: bytes, width: int, dictionary: bytes, wanted: set | None = None) -> Iterator[tuple]:
    """(id, ids before it in the container, ids as u4 array) of each document in a container, or of the wanted ids only."""
    decompress, before = zstandard.ZstdDecompressor(**_codec(dictionary)).decompress, 0
    for e in np.frombuffer(index, ENTRY):
        doc = int(e["id"]) if e["has_id"] else None
        if wanted is None or doc in wanted:
            at = int(e["offset"])
            yield doc, before, np.frombuffer(decompress(body[at : at + int(e["size"])]), f"<u{width}").astype("<u4")
        before += int(e["n"])


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    held, table = dictionaries(spark, path), spark.read.parquet(f"{path}/containers")

    def digest(c: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "shard": [], "near": [], "n_tokens": [], "ids_crc32": []}
        for shard, start, width, sha, index, body in zip(*(c[k] for k in ("shard", "start", "width", "dictionary", "index", "body")), strict=True):
            for doc, before, ids in frames_of(index, body, width, held[sha]):
                for k, v in zip(out, (doc, shard, start + before, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                    out[k].append(v)
        return out

    rows = by_batch(table.select("shard", "start", "width", "dictionary", "index", "body"), digest, "doc_id long, shard int, near long, n_tokens long, ids_crc32 long")
    # One row a shard, as many as the writing tasks.
    bases = table.groupBy("shard").agg(F.sum("tokens").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("near")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of a short list of documents: only containers whose id range meets it are read, only their frames decompressed."""
    held, ids = dictionaries(spark, path), set(wanted)
    near = F.lit(False)
    for i in sorted(ids):
        near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))

    def pick(c: dict[str, list]) -> dict[str, list]:
        found = [(d, x.tolist()) for w, s, i, b in zip(c["width"], c["dictionary"], c["index"], c["body"], strict=True) for d, _, x in frames_of(i, b, w, held[s], ids)]
        return {"doc_id": [d for d, _ in found], "ids": [x for _, x in found]}

    return by_batch(spark.read.parquet(f"{path}/containers").where(near).select("width", "dictionary", "index", "body"), pick, "doc_id long, ids array<long>")
