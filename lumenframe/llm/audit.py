"""How text filters overlap: what each removes at each place of every order, by signed parity sums."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import join_hot, stage

#: Words lie between runs of these characters.
GAP = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10  # words; per cent of words; per cent of code points
FILTERS = "ABCDE"
#: The labels that losses are counted for, besides all documents.
LABELS = ("good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (repeated words), C (capitals) and D (symbols); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def bit_mask(failures: list[Column]) -> Column:
    """Bit i is set where the i-th failure holds."""
    return sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(failures)), F.lit(0))


def _known(found: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; rows without a key, which may be many, are not shuffled."""
    none = found.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(t).alias(c) for c, t in other.dtypes if c != key])
    return join_hot(found.where(F.col(key).isNotNull()), other, [key], "left").select(none.columns).unionByName(none)


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bits A to E), good, toxic of each row of ``docs``.

    E is set where a row with a smaller id has the same text: texts meet as digests and lengths, and only digests that
    occur more than once are joined back. Labels of one id are one label: 1 if any row says 1.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bit_mask(text_failures(F.col(text_col))).alias("mask"),
    )
    rows = stage(rows, "audit-rows")
    copies = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = join_hot(rows, copies, ["digest"], "left")
    repeated = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    rows = stage(rows.select("id", "part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask")), "audit-masks")
    known = labels.where(F.col("doc_id").isNotNull() & (F.expr("quality = 1 OR toxic = 1")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    found = _known(rows, known, "id")
    return found.select("part", "mask", *[F.coalesce(x, F.lit(False)).alias(x) for x in LABELS])


def parity_sums(masks: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """part, label (all, good, toxic), sums: for each subset s of the filters, the rows with an even number of failures in s less those with an odd one."""
    kinds = F.explode(F.filter(F.array(F.lit("all"), *[F.when(F.col(x), F.lit(x)) for x in LABELS]), lambda x: x.isNotNull())).alias("label")
    sign = lambda s: F.lit(1) - 2 * F.bit_count(F.col("mask").bitwiseAND(F.lit(s))).bitwiseAND(F.lit(1))
    counted = masks.select("part", "mask", kinds).groupBy("part", "label").agg(*[F.sum(sign(s)).alias(f"s{s}") for s in range(1 << bits)])
    return counted.select("part", "label", F.array(*[f"s{s}" for s in range(1 << bits)]).alias("sums"))


def mask_cells(sums: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """part, label, cells: the number of rows with each mask, from the parity sums by the inverse transform, exactly."""
    signed = lambda m: F.transform("sums", lambda x, s: F.when(F.bit_count(s.bitwiseAND(m)).bitwiseAND(F.lit(1)) == 0, x).otherwise(-x))
    cell = lambda m: F.shiftright(F.aggregate(signed(m), F.lit(0).cast("long"), lambda a, x: a + x), bits)
    return sums.select("part", "label", F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), cell).alias("cells"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, one row per part, filter_order and step.

    Rows of ``docs`` become masks of failed filters (``failure_masks``); a part's rows of a label are counted as 32
    signed parity sums and these are inverted to the counts of the 32 masks, so no order is ever run over the rows.
    A filter first removes a row failing it in 120 / (number of filters it fails) orders, which gives ``shapley``.

    A null text is empty, a null part the empty string. Null ids fail no E, make no other row fail it and have no
    label; rows that repeat an id and text don't fail E for each other. No rows: no parts and so no rows. Columns
    other than the id, text and part, whatever their names, are not read.
    """
    n = 1 << len(FILTERS)
    cells = mask_cells(parity_sums(failure_masks(docs, labels, **columns)))
    zero = F.array(*[F.lit(0).cast("long")] * n)
    of = lambda x: F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), zero).alias(x)
    parts = cells.groupBy("part").agg(*[of(x) for x in ("all", *LABELS)])
    bit = {x: 1 << i for i, x in enumerate(FILTERS)}
    steps = [("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[order[k]]) for order in permutations(FILTERS) for k in range(len(order))]
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")  # 600 rows
    rows = parts.join(F.broadcast(table))
    mask = lambda i, c: i.bitwiseAND(F.col(c)) != 0
    total = lambda c, take: F.aggregate(F.transform(F.col(c), lambda x, i: F.when(take(i), x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    removed = lambda c: total(c, lambda i: mask(i, "own") & ~mask(i, "before"))
    orders = F.array(*[F.lit(factorial(len(FILTERS)) // max(1, m.bit_count())).cast("long") for m in range(n)])
    share = F.aggregate(F.transform(F.col("all"), lambda x, i: F.when(mask(i, "own"), x * F.get(orders, i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda i: ~mask(i, "own") & ~mask(i, "before")).alias("kept"),
        removed("all").alias("removed"),
        total("all", lambda i: mask(i, "own") & mask(i, "before")).alias("redundant"),
        F.element_at("all", F.col("own") + 1).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )
