"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import bucket_of, map_arrow, texts_of

#: Hashed character 1- to 3-grams fall into so many features.
FEATURES = 4096
#: At most so many labelled documents train the model, dealt evenly over the languages. A model fit needs no more;
#: which documents these are depends only on a hash of their id.
TRAIN_ROWS = 3000
#: Text is turned into features in pieces of so many code points, which bounds memory and changes nothing.
PIECE = 1 << 20
UNKNOWN = "und"

#: The family of each language code; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indic": "hi ur bn pa gu mr ne",
    "iranian": "fa ps ku tg",
    "celtic": "ga gd cy br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def features(text: str) -> np.ndarray | None:
    """Unit vector of damped counts of hashed character n-grams (float32), None if the text has no letter.

    Case is folded; every run of other characters counts as one word boundary.
    """
    counts = np.zeros(FEATURES)
    low = text.lower()
    tail, before, seen = np.zeros(1, np.uint32), True, False  # the boundary before the text; then the last two of a piece
    for at in range(0, len(low), PIECE):
        code = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[np.minimum(code, sys.maxunicode)]
        seen = seen or bool(letter.any())
        code = np.where(letter, code, 0)[letter | np.r_[before, letter[:-1]]].astype(np.uint32)  # one boundary for a run
        before = bool(letter[-1])
        tail = _add_grams(counts, tail, code)
    if not seen:
        return None
    _add_grams(counts, tail, np.zeros(1, np.uint32))
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def _add_grams(counts: np.ndarray, tail: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Counts the 1- to 3-grams that end in ``code``, which follows ``tail``, and returns the last two codes."""
    both = np.concatenate((tail, code))
    one = both * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + one[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + one[2:]
    for gram in (one[len(tail) :][code > 0], two[max(len(two) - len(code), 0) :], three[max(len(three) - len(code), 0) :]):
        counts += np.bincount(((gram * np.uint32(0x2C1B3C6D)) >> np.uint32(20)).astype(np.int64), minlength=FEATURES)
    return both[-2:]


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of an L2-regularised hinge-loss SVM, by dual coordinate descent; y holds -1 and 1.

    Errors of the two sides weigh alike in sum, whatever their numbers of rows.
    """
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    side = np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1)) * c
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slope = y[i] * (x[i] @ w + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), side[i])  # |x| is 1, the bias feature too
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias).astype(np.float32)


@dataclass
class Model:
    """Families, the languages of each, and an SVM for each pair of families and each pair of languages in one."""

    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def _vote(names: list[str], svms: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of each row and its confidence: pairwise logistic margins are summed, ties to the first."""
        if len(names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        won = np.zeros((len(x), len(names)))
        for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
            w = svms[a, b]
            p = 1 / (1 + np.exp(np.clip(-3.0 * (x @ w[:-1] + w[-1]), -30, 30)))
            won[:, i] += p
            won[:, j] += 1 - p
        best = won.argmax(axis=1)
        return best, won[np.arange(len(x)), best] / (len(names) - 1)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        names = list(self.families)
        if not names:
            return [(UNKNOWN, 0.0)] * len(x)
        family, sure = self._vote(names, self.between, x)
        out: list[tuple[str, float]] = [("", 0.0)] * len(x)
        for f, name in enumerate(names):
            rows = np.flatnonzero(family == f)
            lang, p = self._vote(self.families[name], self.within, x[rows])
            for r, i, q in zip(rows, lang, p, strict=True):
                out[r] = (self.families[name][i], float(sure[r] * q))
        return out


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Trains the family stage and the stage inside each family."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    model = Model(dict(sorted(families.items())))
    of = np.array(langs, dtype=object)
    fam = np.array([FAMILY_OF.get(x, x) for x in langs], dtype=object)
    for names, labels, svms in [(list(model.families), fam, model.between), *((v, of, model.within) for v in model.families.values())]:
        for a, b in itertools.combinations(names, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            svms[a, b] = linear_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
    return model


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(i, lang, x) for i, lang, x in zip(b["h"].to_pylist(), b["lang"].to_pylist(), map(features, texts_of(b["text"])), strict=True) if x is not None]
        yield pa.RecordBatch.from_pydict({"h": pa.array([x[0] for x in found], pa.int64()), "lang": pa.array([x[1] for x in found], pa.string()), "x": pa.array([x[2].astype(np.float16).tobytes() for x in found], pa.binary())})


def train(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fits a model to at most ``rows`` labelled rows, the ones with the smallest hashes of id and text of each language.

    Null and repeated ids are rows like others. No more than ``rows`` rows come to the driver, however many have one
    hash; of such equal rows any may be taken. ``rows`` also bounds the languages: the ``rows`` // 4 most frequent ones
    are learned, of four rows each at least.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(id_col), F.col(text)).alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows // 4).collect()}
    if not counts:
        return Model({})
    each = rows // len(counts)
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, 1.1 * each / n))) for k, n in counts.items()))
    place = (F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))).cast("double")
    chosen = labelled.where(place < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11)))).where(F.col("rank") <= each)
    found = map_arrow(chosen, _featurize, "h long, lang string, x binary").toArrow()
    seen: dict[str, int] = {}
    langs, xs = [], []
    for i in sorted(range(len(found)), key=lambda i: (found["lang"][i].as_py(), found["h"][i].as_py() & (1 << 64) - 1)):
        lang = found["lang"][i].as_py()
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= each:
            langs.append(lang)
            xs.append(np.frombuffer(found["x"][i].as_buffer(), np.float16))
    return fit(np.array(xs, np.float32), langs) if langs else Model({})


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1) of every row's whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the model knows no
    language. Ties go to the name that sorts first. Rows are taken one by one: repeated rows give repeated rows,
    an empty table an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(k).alias(f"k{i}") for i, k in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [features(t) for t in texts_of(b["t"])]
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(xs)
            rows = [i for i, x in enumerate(xs) if x is not None]
            for low in range(0, len(rows), 256):
                part = rows[low : low + 256]
                for i, found in zip(part, shared.value.predict(np.stack([xs[i] for i in part])), strict=True):
                    out[i] = found
            names = [f"k{i}" for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*names, "lang_pred", "score"])

    types = dict(df.select(*kept).dtypes)
    schema = ", ".join([*(f"k{i} {types[f'k{i}']}" for i in range(len(keep))), "lang_pred string", "score double"])
    found = map_arrow(df.select(*kept, F.col(text).alias("t")), run, schema)
    return found.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id's text, modulo 4, is 2."""
    return bucket_of(id_col, 4) == 2
