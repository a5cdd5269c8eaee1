"""A corpus pipeline of four stages; each stage's documents are written as Parquet and reread by the next.

Language ID drops documents without a language, toxicity drops toxic ones, the n-gram join keeps one document of
each group of copies and near copies, and packing cuts what is left into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import jaccard, langid, packing, toxicity
from lumenframe.llm.common import stage, without_listed
from lumenframe.llm.sources import table, tokenizer_path


def _inner(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that no operator gives to a column of its own, and these names by the columns' own."""
    names = [f"in{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def _outer(found: DataFrame, inner: dict[str, str]) -> DataFrame:
    return found.select(*(F.col(x).alias(name) for name, x in inner.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no text, or no letter in it) and sets ``lang`` to the language found.

    If no row has a language to learn from, documents with a letter stay as they are. No score is too low to stay.
    """
    model = langid.train(docs)
    rows, inner = _inner(docs)
    text, lang = inner["text"], inner["lang"]
    if not model.families:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.identify(rows, model, text=text, keep=tuple(rows.columns))
    return _outer(found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn(lang, F.col("lang_pred")), inner)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more; every row is judged by its own text, whatever its id."""
    rows, inner = _inner(docs)
    labels = toxicity.clean_labels(table(spark, sf_dir, "labels"))
    found = toxicity.score_texts(rows, labels, text=inner["text"], keep=tuple(rows.columns), id_col=inner["doc_id"])
    return _outer(found.where("predicted = 0"), inner)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of copies and near copies: that with the smallest id, nulls last, then the first in order.

    Rows are told apart by a number of their own, so rows of one id or without one are compared as all others are.
    """
    rows, inner = _inner(docs)
    doc_id, text = inner["doc_id"], inner["text"]
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    linked = stage(jaccard.ngram_join(rows, id_col="_row", text=text).where("n_links > 0").select(F.col("id").alias("_row"), "class_id"), "pipeline-links")
    named = linked.join(rows.select("_row", doc_id), "_row")
    stay = named.groupBy("class_id").agg(F.min(F.struct(F.col(doc_id).isNull(), doc_id, "_row")).alias("s")).select("s._row")
    gone = stage(linked.select("_row").join(stay, "_row", "left_anti"), "pipeline-gone")
    return _outer(without_listed(rows, "_row", gone), inner)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("toxicity", toxic), ("ngram_join", near_duplicates), ("packing", packed)]

#: Neither a learned model nor a tokenizer can be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
