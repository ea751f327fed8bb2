"""Cached byte-level BPE of whole texts, unit by unit.

With the usual pre-tokenizer pattern no piece holds a character that is not white space
followed by one that is.  A text may therefore be cut in front of any white space that
follows something else, each unit be encoded alone, and the ids be put together: the
result equals the encoding of the whole text.  Units repeat a lot, so an encoder keeps the
packed ids of those it has met.  Where units are not of the plain kind (one space or one
line feed, then no white space) the text is cut by a slower, general rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White_Space of Unicode, which ``\\s`` means in the tokenizers' patterns; Python's own ``\\s`` also has U+001C to U+001F.
SPACE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_PLAIN = re.compile(f"\n?[^{SPACE}]+")
#: For Arrow: texts with a unit that isn't plain; and words that end in a mark, which is a piece of its own.
_ROUGH = "[{}]|[ \n][ \n]|[ \n]$".format("".join(f"\\x{{{ord(c):x}}}" for c in SPACE if c not in " \n"))
_MARKS = ",."
_MARKED = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{_MARKS}]$"

#: Units longer than this many characters are encoded but not kept.
LONGEST_KEPT = 48
#: Units kept for good (those met twice) and for the time being; both bound a worker's memory (about 0.2 KB a unit).
MOST_KEPT, MOST_YOUNG = 300_000, 150_000
#: Units that a table keeps between stretches (about 0.1 KB a unit), and bytes of texts that are a stretch.
MOST_TABLED, STRETCH = 450_000, 16 << 20


class UnitEncoder:
    """Packed ids of texts; ``encode_unit`` turns a unit into its ids, little-endian unsigned 32-bit integers."""

    def __init__(self, encode_unit: Callable[[str], bytes], most: int = MOST_KEPT, young: int = MOST_YOUNG):
        self._encode_unit, self._most, self._most_young, self._known, self._young = encode_unit, most, young, {}, {}

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's packed ids; null is as empty."""
        return [self.one(t) if t else b"" for t in texts]

    def _general(self, text: str) -> bytes:
        known, young, encode, out = self._known, self._young, self._encode_unit, []
        for u in _UNIT.findall(text):
            p = u if u[0] == "\n" else u[1:] if u[0] == " " and u[1:2] != "\n" else ""  # what ``one`` knows a plain unit by
            if (ids := known.get(p)) is None:
                if (ids := young.get(p)) is None:
                    ids = encode(u)
                    if len(p) <= LONGEST_KEPT and _PLAIN.fullmatch(p):
                        young[p] = ids
                elif len(known) < self._most:
                    known[p] = young.pop(p)
            out.append(ids)
        return b"".join(out)

    def one(self, text: str) -> bytes:
        known, young, encode = self._known, self._young, self._encode_unit
        if len(young) > self._most_young:
            young.clear()
        head, *parts = text.replace("\n", " \n").split(" ")
        found = list(map(known.get, parts))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None and (ids := known.get(p := parts[k])) is None:
                    if (ids := young.get(p)) is None:
                        if not _PLAIN.fullmatch(p):
                            return self._general(text)
                        ids = encode(p if p[0] == "\n" else f" {p}")
                        if len(p) <= LONGEST_KEPT:
                            young[p] = ids
                    elif len(known) < self._most:
                        known[p] = young.pop(p)
                found[k] = ids
        if head:
            if not _PLAIN.fullmatch(head):
                return self._general(text)
            found.insert(0, encode(head))
        return b"".join(found)


class UnitTable:
    """Packed ids of Arrow arrays of texts: Arrow cuts them and finds their units among those met, so that only new ones become Python strings.

    Texts with other units than plain ones go to ``encoder``."""

    def __init__(self, encoder: UnitEncoder, most: int = MOST_TABLED):
        self._encoder, self._most = encoder, most
        self._units, self._ids, self._sizes, self._seen = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, "i4"), np.empty(0, "i8")

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's packed ids; null is as empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="i8")
        starts = np.flatnonzero(np.diff(ends // STRETCH, prepend=-1))
        for a, b in pairwise([*starts.tolist(), len(texts)]):
            yield from self._stretch(pc.fill_null(texts.slice(a, b - a), "").cast(pa.string()))

    def _stretch(self, texts: pa.Array) -> Iterator[bytes]:
        rough = pc.match_substring_regex(texts, _ROUGH)
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(rough, "", texts), "\n", " \n"), " ")
        units, bounds = cut.values, cut.offsets.to_numpy()
        found = pc.index_in(units, value_set=self._units)
        new = units.filter(found.is_null()).dictionary_encode()
        at = found.fill_null(0).to_numpy().copy()
        at[found.is_null().to_numpy(zero_copy_only=False)] = new.indices.to_numpy() + len(self._units)
        self._add(new.dictionary)
        self._seen += np.bincount(at, minlength=len(self._seen))
        sizes, starts = self._sizes[at], np.cumsum(self._sizes, dtype="i4") - self._sizes
        sizes[bounds[:-1]] = 0  # heads have no space before them
        ends = np.cumsum(sizes, dtype="i4")
        places = np.repeat(starts[at] - (ends - sizes), sizes)
        places += np.arange(len(places), dtype="i4")
        ids, lasts, encoder = self._ids[places], [0, *ends[bounds[1:] - 1].tolist()], self._encoder
        del places, sizes, starts, ends, at, found
        self._forget()
        for k, (general, first) in enumerate(zip(rough.to_pylist(), bounds[:-1].tolist(), strict=True)):
            if general:
                yield encoder.one(texts[k].as_py())
            else:
                yield encoder.one(units[first].as_py()) + ids[lasts[k] : lasts[k + 1]].tobytes()

    def _add(self, new: pa.Array) -> None:
        """New units with their ids; a word with a mark after it gets them from both, so that words are encoded once."""
        marked = pc.match_substring_regex(new, _MARKED)
        words = pc.if_else(marked, pc.utf8_slice_codeunits(new, 0, -1), new).dictionary_encode()
        encode, ends = self._encoder._encode_unit, {m: encoded for m in _MARKS if (encoded := self._encoder._encode_unit(m))}
        known, last, flat = pc.index_in(words.dictionary, value_set=self._units), np.append(0, np.cumsum(self._sizes, dtype="i8")) * 4, self._ids.tobytes()
        places = pc.fill_null(known, 0).to_numpy()
        held = [
            flat[a:b] if there else encode(p if p[0] == "\n" else f" {p}") if p else b""
            for p, there, a, b in zip(words.dictionary.to_pylist(), known.is_valid().to_pylist(), last[places].tolist(), last[np.minimum(places + 1, len(last) - 1)].tolist(), strict=True)
        ]
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(new, -1), None).to_pylist()
        own = [held[k] + ends[m] if m else held[k] for k, m in zip(words.indices.to_pylist(), marks, strict=True)]
        self._units = pa.concat_arrays([self._units, new])
        self._ids = np.append(self._ids, np.frombuffer(b"".join(own), "<u4"))
        self._sizes = np.append(self._sizes, np.fromiter(map(len, own), "i4", len(own)) // 4)
        self._seen = np.append(self._seen, np.zeros(len(own), "i8"))

    def _forget(self) -> None:
        """Drops long units, and where there are too many all but the two thirds of ``most`` that were met most; what was met long ago counts less."""
        kept = pc.less_equal(pc.utf8_length(self._units), LONGEST_KEPT).to_numpy(zero_copy_only=False)
        if len(kept) > self._most:
            kept[np.argsort(-self._seen, kind="stable")[self._most * 2 // 3 :]] = False
            self._seen //= 2
        if not kept.all():
            self._ids = self._ids[np.repeat(kept, self._sizes)]
            self._units, self._sizes, self._seen = self._units.filter(pa.array(kept)), self._sizes[kept], self._seen[kept]


def byte_letters() -> dict[int, str]:
    """The usual one-to-one map of bytes to printable letters: printable Latin-1 stays, the rest follow from U+0100 on."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in stays]
    return {b: chr(b) for b in stays} | {b: chr(256 + k) for k, b in enumerate(moved)}


_encoders: dict[str, UnitEncoder] = {}
_tables: dict[str, UnitTable] = {}


def library_encoder(path: str) -> UnitEncoder:
    """The worker's encoder by the ``tokenizers`` library for the byte-level BPE file at ``path``.

    As in the library, strings of special tokens in a text become these tokens, and none are
    added.  Units in the Latin script are cut by the vocabulary's pattern here and go to the
    library's BPE model piece by piece; all others, and those with a special token's string, go
    through the library whole."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from array import array

        import regex
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        specials = [t.content for t in own.get_added_tokens_decoder().values()]
        if any(set(t) & set(SPACE) or t.isalpha() for t in specials):
            raise ValueError("an added token holds white space, where texts are cut, or is a word by itself")
        special = re.compile("|".join(map(re.escape, specials)) or "(?!)").search
        pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        latin = re.compile("[\n -~À-ſ]*").fullmatch
        word = re.compile("( [A-Za-zÀ-ÖØ-öø-ÿ]+)([,.]?)").fullmatch
        letters, tokens = byte_letters(), own.model.tokenize

        def piece(p: str) -> bytes:
            mapped = p.replace(" ", letters[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters)
            return array("I", [t.id for t in tokens(mapped)]).tobytes()

        tails = {p: piece(p) for p in ",."} | {"": b""}

        def unit(u: str) -> bytes:
            if len(u) <= LONGEST_KEPT:
                if m := word(u):  # letters alone hold no special token
                    return piece(m[1]) + tails[m[2]]
                if latin(u) and not special(u):
                    return b"".join(map(piece, pieces(u)))
            return array("I", own.encode(u, add_special_tokens=False).ids).tobytes()

        _encoders[path] = UnitEncoder(unit)
    return _encoders[path]


def library_table(path: str) -> UnitTable:
    """The worker's table over ``library_encoder``."""
    if path not in _tables:
        _tables[path] = UnitTable(library_encoder(path))
    return _tables[path]
