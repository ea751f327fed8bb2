"""Media columns: WAV files, their spectra, and fingerprints of spectral-peak pairs.

Payload bytes are the unsigned 8-bit samples of a mono WAV file (binary column ``media``).
Reading goes through the ``wave`` module; frames of FRAME samples, a HOP apart and with silence
before and after the payload, are transformed, the PEAKS strongest bins of each are kept, and each peak is paired with the others of its frame and the peaks of the next FAN frames.
A pair is the time-coded integer  frame << 32 | hash,  hash = bin << 17 | bin of the later << 3 | frames between.
Null is empty text: payload of one frame of filler.  Equal payloads give equal files and features.
Null ids stay null, rows that repeat an id are each fingerprinted, an empty table gives an empty one,
and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import by_batch

FRAME, RATE, FILLER = 576, 8000, 255
#: Samples from one frame to the next, half a frame: a byte at the end of one is in the middle of another.
HOP = 288
PEAKS, FAN = 3, 3


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def padded(data: bytes, block: int = FRAME) -> bytes:
    return data + bytes([FILLER]) * (-len(data) % block or block * (not data))


def peaks(samples: bytes, frame: int = FRAME, kept: int = PEAKS, hop: int = HOP) -> np.ndarray:
    """Frames x kept: the strongest bins of each frame's spectrum, ascending; ties go to the lower bin.

    Frames start every ``hop`` samples, the first and the last reaching over the ends."""
    ends = np.pad(np.frombuffer(samples, np.uint8), (frame - hop, frame - hop + -len(samples) % hop), constant_values=128)
    whole, window, out = np.lib.stride_tricks.sliding_window_view(ends, frame)[::hop], np.hanning(frame), []
    for k in range(0, len(whole), 1024):
        power = np.abs(np.fft.rfft((whole[k : k + 1024] - 128.0) * window, axis=1))[:, 1:].round(3)
        out.append(np.sort(np.argsort(-power, axis=1, kind="stable")[:, :kept], axis=1) + 1)
    return np.concatenate(out)


def pairs(bins: np.ndarray, fan: int = FAN) -> np.ndarray:
    """Time-coded hashes of all peak pairs up to ``fan`` frames, that is hops, apart (0: both in one frame, the lower bin first), ascending."""
    low, high = np.triu_indices(bins.shape[1], 1)
    whole = bins.astype(np.int64)
    out = [(np.arange(len(bins), dtype=np.int64)[:, None] << 32 | whole[:, low] << 17 | whole[:, high] << 3).ravel()]
    for gap in range(1, min(fan, len(bins) - 1) + 1):
        first, later = bins[:-gap, :, None].astype(np.int64), bins[gap:, None, :].astype(np.int64)
        at = np.arange(len(first), dtype=np.int64)[:, None, None]
        out.append((at << 32 | first << 17 | later << 3 | gap).ravel())
    return np.sort(np.concatenate(out))


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes as a WAV file."""

    def store(c: dict[str, list]) -> dict[str, list]:
        raw = [(t or "").encode() for t in c["t"]]
        return {"doc_id": c["i"], "n_bytes": list(map(len, raw)), "media": [to_wav(padded(r)) for r in raw]}

    return by_batch(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), store, "doc_id long, n_bytes long, media binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """Reads the WAV files: doc_id, n_bytes, payload and file digests, and ``landmarks``, the time-coded pairs."""

    def read(c: dict[str, list]) -> dict[str, list]:
        out = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "landmarks")}
        for m in c["media"]:
            p = from_wav(m)
            found = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), pairs(peaks(p)))
            for name, v in zip(out, found, strict=True):
                out[name].append(v)
        return {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"]} | out

    return by_batch(media.select("doc_id", "n_bytes", "media"), read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, landmarks array<long>")
