"""Fingerprints see every byte and survive a shift."""

import random

import numpy as np

from paperloom.llm import media


def test_op7_edge_bytes_have_weight():
    """The first and last byte of each of ten frames, which the window of a frame without overlap blots out."""
    text = bytes(random.Random(2).choices(range(97, 123), k=media.FRAME * 10))
    other = bytearray(text)
    other[:: media.FRAME] = other[media.FRAME - 1 :: media.FRAME] = bytes([255]) * 10
    assert (media.peaks(text) != media.peaks(bytes(other))).any()


def test_op7_pairs_survive_a_shift():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]
    text = " ".join(rng.choices(words, k=3000)).encode()
    text = text[: len(text) // media.FRAME * media.FRAME]

    def hashes(data):
        return set((media.pairs(media.peaks(media.padded(data))) & 0xFFFFFFFF).tolist())

    own, moved = hashes(text), hashes(bytes([32]) * 288 + text)
    assert len(own & moved) > 0.9 * len(own)
    assert len(media.peaks(text)) == len(text) // media.HOP + 1
    assert np.diff(media.pairs(media.peaks(text))).min() >= 0
