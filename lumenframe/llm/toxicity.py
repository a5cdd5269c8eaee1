"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import bucket_of, by_bytes, give_back, map_arrow, ragged, spans, stage
from lumenframe.llm.units import UnitEncoder

#: The fit's documented bounds: at most so many labelled texts are examples (the smallest hashes), with so many distinct
#: words in all, and so many of them calibrate the votes.
EXAMPLES, EXAMPLE_WORDS, CALIBRATION = 4096, 4_000_000, 1024
#: Neighbours that vote, examples in one block of the index, and the weight of the prior beside the votes.
K, BLOCK, PRIOR_WEIGHT = 15, 64, 0.25
#: A term must be in so many examples at least to be tested; how many times their TF-IDF terms that tell label 1 may weigh.
LEAST_DF, TELLING_WEIGHTS = 3, (1.0, 4.0, 16.0, 64.0)
#: Terms that one in so many examples has, and as many examples at least, are dense rows; texts whose scores by them are one product.
COMMON, TOGETHER = 16, 128
#: Blocks that are opened before there is a cosine to beat.
FIRST = 4
#: Units in a task's table of those seen.
KEPT = 300_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits, whole."""
    return _WORD.findall(text.lower())


def beginnings(word: str) -> list[str]:
    """A word's beginnings of four to eight letters, which its inflected forms share."""
    return [word[:n] for n in range(4, min(len(word), 8) + 1)]


def telling(df: np.ndarray, ones: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Which terms tell label 1, by their numbers of examples and of label-1 examples among the ``n`` and ``pos``.

    Label 1 must be in more than half of a term's examples, and so large a share, by Chernoff's bound, must be
    expected of less than one term in all if the labels were dealt at random.
    """
    df, ones = np.asarray(df, float), np.asarray(ones, float)
    share, rate = ones / df, pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        log_p = -df * (share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0))
    return (share > max(0.5, rate)) & (log_p + math.log(max(len(df), 1)) <= 0)


@dataclass
class Vocabulary:
    """Numbers of all words of the examples, then of the beginnings that tell label 1; and which numbers tell it."""

    words: dict[str, int]
    heads: dict[str, int]
    tells: np.ndarray

    def __post_init__(self) -> None:
        self.stems = {h[:4] for h in self.heads}

    def __len__(self) -> int:
        return len(self.words) + len(self.heads)

    def encode(self, units: Sequence[str]) -> list[list[int]]:
        """Term numbers of each unit's words; a word of no example gets a number of its own behind all others."""
        import xxhash

        out = []
        for u in units:
            found = []
            lower = u.strip().lower()
            for w in (lower,) if lower.isalpha() else _WORD.findall(lower):
                n = self.words.get(w)
                found.append(len(self) + (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & 0xFFFFFFFFF) if n is None else n)
                if w[:4] in self.stems:
                    found += [self.heads[h] for h in beginnings(w) if h in self.heads]
            out.append(found)
        return out


@dataclass
class Examples:
    """Examples in order, with their distinct words as places in ``words``, sorted: those of example i from ends[i] to ends[i + 1]."""

    ids: np.ndarray
    y: np.ndarray
    words: list[str]
    index: np.ndarray
    counts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def learn_vocabulary(examples: Examples) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary of examples, and the numbers of each word's telling beginnings, flat with each word's number of them.

    A beginning counts once for each example that has it.
    """
    words, labels = examples.words, examples.y
    heads: dict[str, int] = {}
    size = np.fromiter((max(0, min(len(w), 8) - 3) for w in words), np.int64, len(words))
    flat = np.fromiter((heads.setdefault(h, len(heads)) for w in words for h in beginnings(w)), np.int64, int(size.sum()))
    start = np.cumsum(size) - size
    df, ones = np.zeros(len(words) + len(heads), np.int64), np.zeros(len(words) + len(heads), np.int64)
    for i, y in enumerate(labels.tolist()):
        at = examples.index[examples.ends[i] : examples.ends[i + 1]]
        at = np.concatenate((at, len(words) + np.unique(flat[spans(start[at], size[at])])))
        df[at] += 1
        if y:
            ones[at] += 1
    tells, n, pos = np.zeros(len(df), bool), len(labels), int(labels.sum())
    seen = np.flatnonzero(df >= LEAST_DF)
    if 0 < pos < n and len(seen):
        tells[seen] = telling(df[seen], ones[seen], n, pos)
    kept = sorted(h for h, i in heads.items() if tells[len(words) + i])
    number = np.full(len(heads), -1, np.int64)
    number[[heads[h] for h in kept]] = len(words) + np.arange(len(kept))
    own = number[flat]
    per_word = np.bincount(np.repeat(np.arange(len(words)), size)[own >= 0], minlength=len(words))
    vocabulary = Vocabulary({w: i for i, w in enumerate(words)}, {h: len(words) + i for i, h in enumerate(kept)}, np.concatenate((tells[: len(words)], np.ones(len(kept), bool))))
    return vocabulary, own[own >= 0], per_word


def counted(vocabulary: Vocabulary, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the known terms in order and their counts, flat with each text's number of them, and ``other``.

    ``other`` is the sum of squares of the damped counts of words of no example, which are part of a text's norm.
    """
    key = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 38 | flat)
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(key)))
    text, term = key[begin] >> 38, key[begin] & (1 << 38) - 1
    known = term < len(vocabulary)
    other = np.bincount(text[~known], weights=(1 + np.log(count[~known])) ** 2, minlength=len(sizes)).astype(np.float64)
    return term[known].astype(np.int32), count[known].astype(np.int32), np.bincount(text[known], minlength=len(sizes)), other


@dataclass
class Weights:
    """TF-IDF weights of the terms: idf over all documents, times one of ``TELLING_WEIGHTS`` for terms that tell label 1."""

    idf: np.ndarray
    unseen: float

    def unit(self, term: np.ndarray, count: np.ndarray, other: float) -> np.ndarray:
        """The known terms' weights, divided by the norm of the whole text."""
        w = (1 + np.log(count)) * self.idf[term]
        norm = math.sqrt(float(w @ w) + other * self.unseen**2)
        return w / norm if norm else w


@dataclass
class Index:
    """Block-max inverted index of unit example vectors.

    Terms of many examples are dense rows of weights. Postings of the others stand by term and row; for each term and
    block that has it, an entry holds the largest weight in the block and the postings' place.
    """

    ids: np.ndarray
    labels: np.ndarray
    common: np.ndarray  # the dense row of each term, or -1
    dense: np.ndarray  # (common terms, blocks * size)
    row: np.ndarray
    weight: np.ndarray
    first: np.ndarray  # entries of each term
    block: np.ndarray
    most: np.ndarray
    start: np.ndarray
    length: np.ndarray
    size: int = BLOCK  # examples in a block

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (term, weight) rows and cosines of the ``k`` most similar examples with a cosine above 0, exact, ties to smaller ids.

        The row that ``but`` names for a vector takes no part.
        """
        out = []
        for low in range(0, len(vectors), TOGETHER):
            part = vectors[low : low + TOGETHER]
            query = np.zeros((len(part), len(self.dense)))
            for i, (t, w) in enumerate(part):
                at = self.common[t]
                query[i, at[at >= 0]] = w[at >= 0]
            for i, (score, (t, w)) in enumerate(zip(query @ self.dense, part, strict=True)):
                rare = self.common[t] < 0
                out.append(self._best(score, t[rare], w[rare], k, but[low + i] if but else -1))
        return out

    def _best(self, score: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """The search from the common terms' ``score`` of each row on.

        A block's upper bound is the best score in it and the other terms' block maxima. The blocks with the highest
        bounds are opened first, then those whose bound isn't below the k-th best cosine found there; only postings in
        opened blocks are read.
        """
        if but >= 0:
            score[but] = -2.0
        n = self.first[term + 1] - self.first[term]
        entry, mine = spans(self.first[term], n), np.repeat(weight, n)
        block = self.block[entry]
        bound = score.reshape(-1, self.size).max(axis=1) + np.bincount(block, weights=mine * self.most[entry], minlength=len(score) // self.size)
        order = np.argsort(-bound, kind="stable")
        rows, best = np.zeros(0, np.int64), np.zeros(0)
        now = order[:FIRST]
        left = order[FIRST:]
        while len(now):
            opened = np.zeros(len(bound), bool)
            opened[now] = True
            read = opened[block]
            size = self.length[entry[read]]
            post = spans(self.start[entry[read]], size)
            score += np.bincount(self.row[post], weights=np.repeat(mine[read], size) * self.weight[post], minlength=len(score))
            inside = (now[:, None] * self.size + np.arange(self.size)).ravel()
            fresh = np.round(score[inside], 12)
            bar = max(best[-1] if len(best) == k else 0.0, 0.0)
            stay = (fresh >= bar) & (fresh > 0)
            rows, best = np.concatenate((rows, inside[stay])), np.concatenate((best, fresh[stay]))
            keep = np.lexsort((rows, self.ids[rows], -best))[:k]
            rows, best = rows[keep], best[keep]
            reach = bound[left] >= (best[-1] - 1e-9 if len(best) == k else 0.0)
            now, left = left[reach], left[~reach][:0]
        return rows, best


def build(vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, terms: int) -> Index:
    """Index of unit vectors (term, weight). Like examples stand together, so that blocks have tight bounds.

    Examples are in order of their heaviest term if label 1 is told by it, then of their most frequent term that less
    than half of the examples have, which is mostly a word of their language.
    """
    df = np.bincount(np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64), minlength=terms)
    usual_df = np.where(df * 2 < max(len(vectors), 1), df, -1)
    heavy = [int(t[w.argmax()]) if len(t) and w.max() > 0.3 else terms for t, w in vectors]
    usual = [int(t[usual_df[t].argmax()]) if len(t) else terms for t, _ in vectors]
    rows = sorted(range(len(vectors)), key=lambda i: (heavy[i], usual[i], int(ids[i]), vectors[i][0].tolist()))
    size = np.array([len(vectors[i][0]) for i in rows], np.int64)
    term = np.concatenate([vectors[i][0] for i in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    weight = np.concatenate([vectors[i][1] for i in rows]) if rows else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), size)
    often = np.flatnonzero(df * COMMON >= max(len(vectors), COMMON * COMMON))
    common = np.full(terms, -1, np.int32)
    common[often] = np.arange(len(often))
    dense = np.zeros((len(often), max(1, -(-len(rows) // BLOCK)) * BLOCK))
    is_common = common[term] >= 0
    dense[common[term[is_common]], row[is_common]] = weight[is_common]
    term, weight, row = term[~is_common], weight[~is_common], row[~is_common]
    order = np.lexsort((row, term))
    term, weight, row = term[order], weight[order], row[order]
    start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] // BLOCK != row[:-1] // BLOCK)]) if len(term) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(term)))
    most = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
    pad = dense.shape[1]  # places without an example have no postings
    named = np.concatenate((np.asarray(ids)[rows], np.zeros(pad - len(rows), np.int64))) if rows else np.zeros(pad, np.int64)
    marked = np.concatenate((np.asarray(labels, float)[rows], np.zeros(pad - len(rows)))) if rows else np.zeros(pad)
    return Index(named, marked, common, dense, row.astype(np.int32), weight, np.searchsorted(term[start], np.arange(terms + 1)), (row[start] // BLOCK).astype(np.int32), most, start, length, BLOCK)


@dataclass
class Scorer:
    """Votes of the nearest examples, calibrated: ``raw`` and ``real`` are points of a rising curve from votes to scores.

    ``rate`` is the share of label 1, ``rate_without`` that among examples without a term that tells it.
    """

    weights: Weights
    index: Index
    rate: float
    rate_without: float
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    real: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def vote(self, row: np.ndarray, cosine: np.ndarray) -> float:
        """The label-1 share of the votes: cosine to the fourth over the distance, with the prior as one more vote."""
        w = cosine**4 / (1.05 - np.minimum(cosine, 1.0))
        return float((w @ self.index.labels[row] + PRIOR_WEIGHT * self.rate) / (w.sum() + PRIOR_WEIGHT))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fits the curve to votes and labels of examples by pooling neighbours until shares of label 1 rise with the votes."""
        if not 0 < labels.sum() < len(labels):
            return
        pools: list[list[float]] = []  # sum of labels, number, sum of votes
        for v, y in sorted(zip(votes.tolist(), labels.tolist(), strict=True)):
            pools.append([y, 1.0, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.raw = np.array([v / n for _, n, v in pools])
        self.real = np.maximum.accumulate([(y + self.rate) / (n + 1) for y, n, _ in pools])

    def __call__(self, texts: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, the examples' ids (evidence) and their cosines of each (term, count, other); without a word of an example, the rate without."""
        out = []
        for row, cosine in self.index.nearest([(t.astype(np.int64), self.weights.unit(t, c, o)) for t, c, o in texts]):
            score = float(np.interp(self.vote(row, cosine), self.raw, self.real)) if len(row) else self.rate_without
            out.append((score, self.index.ids[row], cosine))
        return out


def clean_labels(labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row (id, y) for each labelled id: null ids and labels are no labels, and 1 wins if they differ."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))


def train_rows(labels: DataFrame, rows: int = EXAMPLES) -> DataFrame:
    """At most about ``rows`` of clean labels: those with the smallest id hashes, (id, y)."""
    n = labels.count()
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    return labels.where(place < F.lit(min(1.0, rows / max(n, 1) if n > rows else 1.0)))


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches, "t"):
        found = [sorted(Counter(words_of(t or "")).items()) for t in b["t"].to_pylist()]
        words, counts = ([[x[i] for x in f] for f in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b["id"], b["y"], b["place"], pa.array(list(map(len, found)), pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], ["id", "y", "place", "n", "words", "counts"])


def _examples(df: DataFrame, labels: DataFrame, rows: int) -> Examples:
    """Examples in order of a hash of id and text: the smallest ones, within the bounds on rows and words."""
    chosen = F.broadcast(train_rows(labels, rows))  # about ``rows`` rows
    read = df.select(F.col("id"), F.xxhash64("id", "t").alias("place"), F.col("t")).join(chosen, "id").dropDuplicates(["id", "place"])  # equal rows are one example
    found = stage(map_arrow(read.select("id", "y", "place", "t"), _example_words, "id long, y int, place long, n long, words array<string>, counts array<int>"), "tox-examples")
    sizes = found.select("place", "n").orderBy("place").limit(rows).collect()
    last, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > EXAMPLE_WORDS and last is not None:
            break
        last = r["place"]
    taken = found.where((F.col("place") <= F.lit(last).cast("long")) & (F.col("n") <= EXAMPLE_WORDS)).orderBy("place").limit(rows)
    table = taken.select("id", "y", "words", "counts").toArrow().combine_chunks()  # within the bounds; none without a last one
    lists, counts = (pa.chunked_array(table[c].chunks, table[c].type).combine_chunks() for c in ("words", "counts"))
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # by bytes, as by code points
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return Examples(table["id"].to_numpy(), table["y"].to_numpy().astype(np.int64), coded.dictionary.take(pa.array(order)).to_pylist(), place[coded.indices.to_numpy()], counts.flatten().to_numpy().astype(np.int64), ends)


def score_texts(df: DataFrame, labels: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", rows: int = EXAMPLES) -> DataFrame:
    """``keep`` columns, score (0 to 1), predicted (0 or 1) and the evidence of every row's whole text.

    ``labels`` (id, y) are the labels to learn from, as ``clean_labels`` makes them; about ``rows`` of them at most
    become examples. Terms are all words of a text and those word beginnings that tell label 1; terms that tell it
    weigh a number of times their TF-IDF that the examples choose (``choose_weight``). Norms are over whole texts: a word of no example weighs as one that
    is in no other document. Document frequencies are counted over all of ``df``. Scores are votes of the ``K``
    nearest examples, calibrated on votes on examples by the others. Evidence is the ids and cosines of these nearest.

    Null and empty texts, and texts without a word of an example, get the smoothed rate of label 1 among examples
    without a term that tells it, which is 0 without any examples, and no evidence. Repeated rows get equal scores; a repeated id among the examples' texts counts
    with each different text.
    """
    spark = df.sparkSession
    names = [f"k{i}" for i in range(len(keep))]
    read = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), *([] if text in keep else [F.col(text).alias("t")]))
    types, words = dict(read.dtypes), f"k{keep.index(text)}" if text in keep else "t"
    examples = _examples(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")), labels, rows)
    y = examples.y
    vocabulary, heads, n_heads = learn_vocabulary(examples)
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    shared = spark.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        encoder = UnitEncoder(known.encode, KEPT, np.int64)
        for b in by_bytes(batches, words):
            term, count, size, other = counted(known, *encoder.encode_many(b[words]))
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), ragged(term, size), ragged(count, size), pa.array(other)], [*names, "term", "cnt", "other"])
        del encoder
        give_back()

    schema = "".join(f"{n} {types[n]}, " for n in names) + "term array<int>, cnt array<int>, other double"
    sparse = stage(map_arrow(read, vectors, schema), "tox-vectors")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), np.int64)
        for b in batches:
            n += np.bincount(b["term"].flatten().to_numpy(), minlength=len(n))
        seen = np.flatnonzero(n)
        for low in range(0, len(seen), 1 << 16):
            part = seen[low : low + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.int32()), "n": pa.array(n[part])})

    total = sparse.count()
    seen = map_arrow(sparse.select("term"), frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the vocabulary
    df_ = np.zeros(len(vocabulary))
    df_[seen["term"].to_numpy()] = seen["n"].to_numpy()
    idf, unseen = np.log((total + 1) / (df_ + 1)) + 1, math.log(total + 1) + 1

    first = np.cumsum(n_heads) - n_heads
    arrays = []
    for a, b in zip(examples.ends[:-1].tolist(), examples.ends[1:].tolist(), strict=True):  # all their words are known
        at, count = examples.index[a:b], examples.counts[a:b]
        term, number = np.unique(np.concatenate((at, heads[spans(first[at], n_heads[at])])), return_inverse=True)
        arrays.append((term, np.bincount(number, weights=np.concatenate((count, np.repeat(count, n_heads[at]))), minlength=len(term)).astype(np.float64)))
    ids = examples.ids
    weights = Weights(idf * np.where(vocabulary.tells, choose_weight(arrays, ids, y, idf, unseen), 1.0), unseen)
    index = build([(t, weights.unit(t, c, 0.0)) for t, c in arrays], ids, y, len(vocabulary))
    plain = np.array([not vocabulary.tells[t].any() for t, _ in arrays], bool)
    scorer = Scorer(weights, index, float(rate), float((y[plain].sum() + rate) / (plain.sum() + 1)))
    _calibrate(scorer, examples, arrays)
    told = spark.sparkContext.broadcast(scorer)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, term, cnt = np.asarray(b["term"].offsets), np.asarray(b["term"].values), np.asarray(b["cnt"].values)
            out = told.value([(term[e:f], cnt[e:f].astype(np.float64), o) for e, f, o in zip(ends[:-1].tolist(), ends[1:].tolist(), b["other"].to_pylist(), strict=True)])
            score = np.array([x[0] for x in out], np.float64)
            size = np.array([len(x[1]) for x in out], np.int64)
            flat = lambda i, kind: np.concatenate([x[i] for x in out]).astype(kind) if out else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), ragged(flat(1, np.int64), size), ragged(np.round(flat(2, np.float64), 9), size)], [*names, "score", "predicted", "evidence_ids", "evidence_cosines"])
        give_back()

    schema = "".join(f"{n} {types[n]}, " for n in names) + "score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>"
    return map_arrow(sparse, scores, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "score", "predicted", "evidence_ids", "evidence_cosines")


def choose_weight(arrays: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, y: np.ndarray, idf: np.ndarray, unseen: float) -> float:
    """How many times their TF-IDF terms that tell label 1 are to weigh: what foretells labels of examples best.

    Every other example votes on the ones between, at most ``CALIBRATION`` // 2 of them, and its labels alone say which
    terms tell label 1. The option whose calibrated votes have the least mean squared error wins, the smallest of equal ones.
    """
    known, asked = range(0, len(arrays), 2), [i for i in range(1, len(arrays), 2) if len(arrays[i][0])][: CALIBRATION // 2]
    if len(TELLING_WEIGHTS) == 1 or not asked:
        return TELLING_WEIGHTS[0]
    term = np.concatenate([arrays[i][0] for i in known])
    df = np.bincount(term, minlength=len(idf))
    ones = np.bincount(term, weights=np.repeat(y[::2], [len(arrays[i][0]) for i in known]), minlength=len(idf)).astype(np.int64)
    tells, n, pos = np.zeros(len(idf), bool), len(known), int(y[::2].sum())
    seen = np.flatnonzero(df >= LEAST_DF)
    if 0 < pos < n and len(seen):
        tells[seen] = telling(df[seen], ones[seen], n, pos)
    errors = []
    for option in TELLING_WEIGHTS:
        weights = Weights(idf * np.where(tells, option, 1.0), unseen)
        index = build([(arrays[i][0], weights.unit(*arrays[i], 0.0)) for i in known], ids[::2], y[::2], len(idf))
        scorer = Scorer(weights, index, (pos + 0.5) / (n + 1), (pos + 0.5) / (n + 1))
        near = index.nearest([(arrays[i][0], weights.unit(*arrays[i], 0.0)) for i in asked])
        votes, labels = np.array([scorer.vote(*x) for x in near]), y[asked]
        scorer.calibrate(votes, labels)
        errors.append((round(float(((np.interp(votes, scorer.raw, scorer.real) - labels) ** 2).mean()), 6), option))
    return min(errors)[1]


def _calibrate(scorer: Scorer, examples: Examples, arrays: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Calibrates on the votes that the first ``CALIBRATION`` examples get from the other ones."""
    place: dict[int, list[int]] = {}
    for i, x in enumerate(scorer.index.ids[: len(examples)].tolist()):
        place.setdefault(x, []).append(i)
    chosen = [(y, t, c, place[i][0]) for y, i, (t, c) in zip(examples.y[:CALIBRATION].tolist(), examples.ids.tolist(), arrays, strict=False) if len(t) and len(place[i]) == 1]  # an id with several texts votes on itself
    near = scorer.index.nearest([(t, scorer.weights.unit(t, c, 0.0)) for _, t, c, _ in chosen], but=[p for *_, p in chosen])
    scorer.calibrate(np.array([scorer.vote(*x) for x in near]), np.array([y for y, *_ in chosen]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label is kept from learning: crc32 of its id's text, modulo 5, is 0."""
    return bucket_of(id_col, 5) == 0
