"""Byte-level BPE in batched numpy merge rounds, and decoding by table lookup."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import by_bytes, map_arrow, ragged, spans
from lumenframe.llm.units import UnitEncoder

#: Fixed value: how byte-level BPE vocabularies of this kind split a text before any merge.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of pieces that share one flat array of merge rounds.
ROUND_BYTES = 1 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """A byte-level vocabulary file: ``encode_many(texts)`` and ``decode(ids, sizes)``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        size = max([*vocab.values(), *self.special.values()]) + 1
        said = [b""] * size
        for token, i in vocab.items():
            said[i] = bytes(map(byte_of.__getitem__, token))
        for token, i in self.special.items():
            said[i] = token.encode()
        self.said_length = np.fromiter(map(len, said), np.int64, size)
        self.said_start = np.cumsum(self.said_length) - self.said_length
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.units = UnitEncoder(self.encode_units)

    def merge(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces and each piece's number of ids.

        In a round, every piece merges the pair of lowest rank that it holds, wherever it holds it, from left to
        right; ranks come from a binary search of all neighbours at once over the sorted pair keys.
        """
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        done_sym, done_owner = [], []
        none = len(self.key)
        while len(sym):
            key = sym[:-1] << 20 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), none - 1)
            rank = np.where((self.key[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none) if none else np.zeros(0, np.int64)
            rank = np.append(rank, none)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(sym)))
            live = np.repeat(least < none, size)
            if not live.all():  # finished pieces leave the rounds
                done_sym.append(sym[~live])
                done_owner.append(owner[~live])
                sym, owner, rank = sym[live], owner[live], rank[live]
                least = np.repeat(least, size)[live]
            else:
                least = np.repeat(least, size)
            if not len(sym):
                break
            hit = np.flatnonzero(rank == least)
            run = np.r_[True, np.diff(hit) > 1]  # of neighbouring hits, as in "aaa", every other one from the left
            place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[place % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, owner = sym[keep], owner[keep]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(pieces))

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of each word; words are split, and each distinct piece of the batch is merged once."""
        number: dict[str, int] = {}
        parts = [[number.setdefault(p, len(number)) for p in SPLIT.findall(w)] for w in words]
        ids: list[list[int]] = []
        batch: list[bytes] = []
        weight = 0

        def flush() -> None:
            flat, size = self.merge(batch)
            end = np.cumsum(size)
            flat_list = flat.tolist()
            ids.extend(flat_list[e - s : e] for e, s in zip(end.tolist(), size.tolist(), strict=True))

        for p in number:
            batch.append(p.encode("utf-8", "surrogatepass"))
            weight += len(batch[-1])
            if weight >= ROUND_BYTES:
                flush()
                batch, weight = [], 0
        flush()
        return [ids[x[0]] if len(x) == 1 else [t for i in x for t in ids[i]] for x in parts]

    def encode_units(self, units: Sequence[str]) -> list[list[int]]:
        """Ids of each unit, of those with the beginning of a special token by ``encode_whole``."""
        whole = {i: self.encode_whole(u) for i, u in enumerate(units) if "<|" in u}
        plain = iter(self.encode_words([u for i, u in enumerate(units) if i not in whole] if whole else units))
        return [whole[i] if i in whole else next(plain) for i in range(len(units))] if whole else list(plain)

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens in it are those tokens."""
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += self.encode_words([text[at : m.start()]])[0] + [self.special[m.group()]]
            at = m.end()
        return out + self.encode_words([text[at:]])[0] if at < len(text) else out

    def encode_many(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.units.encode_many(texts)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        length = self.said_length[ids]
        flat = self.said[spans(self.said_start[ids], length)].tobytes()
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(sizes)))]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary at ``path``, read once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def token_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text: id, n_tokens, ids array<int>, decoded.

    With ``digests``, ids and decoded text are given as hex SHA-256 of the ids in decimal, joined by commas, and of
    the decoded text in UTF-8. Null and empty texts have no ids and decode to the empty text. ``path`` must be
    readable on every worker. Rows are taken one by one; repeated rows and an empty table need no care.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        name = [str(i) for i in range(len(bpe.said_length))]
        for b in by_bytes(batches, "t"):
            ids, sizes = bpe.encode_many(b["t"])
            decoded = bpe.decode(ids, sizes)
            ends = np.cumsum(sizes)
            cut = (ids[e - s : e].tolist() for e, s in zip(ends, sizes, strict=True))
            if digests:
                first = pa.array([hashlib.sha256(",".join(map(name.__getitem__, x)).encode()).hexdigest() for x in cut], pa.string())
                second = pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string())
            else:
                first, second = ragged(ids.astype(np.int32), sizes), pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(sizes, pa.int64()), first, second], ["id", "n_tokens", "ids", "decoded"])

    kind = dict(df.dtypes)[id_col]
    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")), run, f"id {kind}, n_tokens long, ids {'string' if digests else 'array<int>'}, decoded string")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("ids").alias("ids_sha256" if digests else "ids"), F.col("decoded").alias("decoded_sha256" if digests else "decoded"))
