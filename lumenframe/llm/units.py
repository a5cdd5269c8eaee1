"""Encodes whole texts with a public tokenizer, each distinct unit of a text once.

Both tokenizer kinds split a text before they merge anything, and no split piece spans a unit's boundary: units begin
before the first of a run of white space, and at a punctuation mark after a letter or digit. A text therefore encodes as its
units do, one by one. Units are cut, numbered and looked up as Arrow arrays without a Python object for each; only units
that aren't in the table of known ones are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenframe.llm.common import spans

#: Units in a worker's table before it drops the half that fewest batches held (some 40 MB), and bytes of the longest kept.
KEPT, LONGEST = 1_000_000, 200
#: White space of one byte; marks that a unit may begin with, all of ASCII but the one inside special tokens.
_WHITE, _MARKS = b"\t\n\v\f\r ", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"
#: Two- and three-byte white space.
_ODD_WHITE = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Letters of Latin blocks that every library's Unicode version has, as are their lower cases.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 white space, 2 mark, 3 letter or digit, 4 part of a longer character, 5 separators that libraries differ on
_KIND[list(_WHITE)], _KIND[list(_MARKS)] = 1, 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 3
_KIND[128:] = 4
_KIND[28:32] = 5
#: By the kinds of two neighbouring bytes: 1 a unit begins between them, 2 it depends on the character before.
_CUT = np.zeros(48, np.uint8)
_CUT[[0 * 8 + 1, 2 * 8 + 1, 3 * 8 + 1, 3 * 8 + 2]] = 1
_CUT[[4 * 8 + 1, 4 * 8 + 2]] = 2


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, which share the texts' bytes, and each text's number of units; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return pa.array([], pa.string()), np.zeros(n, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    begins = np.zeros(last - first + 1, bool)
    if len(raw) > 1:
        kind = _KIND[raw]
        pair = kind[:-1] << np.uint8(3)
        pair |= kind[1:]
        found = _CUT[pair]
        begins[1:-1] = found == 1
        at = np.flatnonzero(found == 2)
        two = raw[np.maximum(at - 1, 0)].astype(np.int32) << 8 | raw[at]
        odd = np.isin(two, _ODD_WHITE) | np.isin(raw[np.maximum(at - 2, 0)].astype(np.int32) << 16 | two, _ODD_WHITE)
        letter = (two >> 8 == 0xC3) & (two != 0xC397) & (two != 0xC3B7)  # of the Latin-1 block
        begins[at + 1] = np.where(kind[at + 1] == 1, ~odd, letter)
    begins[offsets - first] = True
    starts = np.flatnonzero(begins[:-1])
    counts = np.diff(np.searchsorted(starts, offsets - first))
    bounds = np.append(starts, last - first).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), texts.buffers()[2].slice(first)), counts


class UnitEncoder:
    """``encode_many(texts)`` returns the flat token ids of all texts and each text's number of ids.

    ``encode_words(units)`` gives the ids of single units. Texts are an Arrow array or a sequence of strings.
    """

    def __init__(self, encode_words: Callable[[list[str]], Sequence[Sequence[int]]], kept: int = KEPT, kind: type = np.uint16) -> None:
        self.encode_words, self.kept = encode_words, kept
        self.known = pa.array([], pa.string())
        self.start, self.length, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, kind)

    def _drop_cold(self) -> None:
        """Keeps the half of the table that most batches held; of equals the older ones."""
        order = np.sort(np.argsort(-self.hits, kind="stable")[: self.kept // 2])
        self.known = self.known.take(pa.array(order))
        start, self.length = self.start[order], self.length[order]
        self.flat = self.flat[spans(start, self.length)]
        self.start = np.cumsum(self.length) - self.length
        self.hits = self.hits[order] >> 1

    def encode_many(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        units, counts = split_units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = units.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        number = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hits[number[number >= 0]] += 1
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            fresh = fresh[np.argsort(pc.binary_length(words).to_numpy()[fresh] > LONGEST, kind="stable")]  # long ones last
            new = words.take(pa.array(fresh))
            stay = int((pc.binary_length(new).to_numpy() <= LONGEST).sum())
            ids = self.encode_words(new.to_numpy(zero_copy_only=False).tolist())
            number[fresh] = len(self.known) + np.arange(len(fresh))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), self.flat.dtype, int(size.sum()))
            held = len(self.flat)
            self.flat = np.concatenate((self.flat, flat))
            self.start, self.length = np.concatenate((self.start, held + np.cumsum(size) - size)), np.concatenate((self.length, size))
        each = number[index]
        length = self.length[each]
        out = self.flat[spans(self.start[each], length)]
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(counts)))]
        if len(fresh):  # what is too long to keep leaves
            self.known = pa.concat_arrays([self.known, new.slice(0, stay)])
            self.hits = np.concatenate((self.hits, np.ones(stay, np.int32)))
            self.start, self.length = self.start[: len(self.known)], self.length[: len(self.known)]
            self.flat = self.flat[: held + int(size[:stay].sum())].copy() if stay < len(size) else self.flat
            if len(self.known) > self.kept:
                self._drop_cold()
        return out, np.diff(ends)


def _printable() -> dict[int, str]:
    """For str.translate: the character that byte-level vocabularies print for each byte."""
    from lumenframe.llm.bpe import byte_letters

    return dict(enumerate(byte_letters()))


class LibraryWords:
    """Ids of single units by the tokenizers library, for the two kinds of files in use.

    A unit of plain Latin letters, with the space before it or without, is one piece, which goes to the library's BPE
    model at once; every other unit goes through the library whole.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, self.letters, self.spaced = self.tok.model, _printable(), spaced

    def _piece(self, unit: str) -> str | None:
        """What the model gets for a plain unit, None for another one."""
        if not unit:
            return None
        first = unit[0]
        word = unit[1:] if first == " " or not self.spaced and first == "\n" else unit
        if _PLAIN.fullmatch(word) is None:
            return None
        if not self.spaced:
            word = word.lower()
            return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        word = unit if first == " " else word
        return word.replace(" ", self.letters[32], 1) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def __call__(self, units: list[str]) -> list[list[int]]:
        pieces = [self._piece(u) for u in units]
        tokenize = self.model.tokenize
        out = [None if p is None else [t.id for t in tokenize(p)] for p in pieces]
        rest = [i for i, p in enumerate(pieces) if p is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


_ENCODERS: dict[tuple[str, bool], UnitEncoder] = {}


def library_encoder(path: str, spaced: bool, kept: int = KEPT) -> UnitEncoder:
    """The encoder over the tokenizers library for a vocabulary file, one for each worker process; the first call's ``kept`` holds.

    ``spaced`` says that a piece takes the space before it, as in byte-level vocabularies; else pieces drop white space.
    """
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = UnitEncoder(LibraryWords(path, spaced), kept)
    return _ENCODERS[path, spaced]
