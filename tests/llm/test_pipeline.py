"""The pipeline's stages on a small corpus, against what they are to keep."""

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import pipeline as corpus_pipeline
from lumenframe.llm import queries, toxicity
from tests.llm.test_text_and_tokens import brute_join, check_packing

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "src0", 0), (90_002, "12 34 !!", None, "src0", 8)], docs.schema)
    first = corpus_pipeline.language(spark, docs.unionByName(extra), SF)
    assert first.columns == docs.columns and {r[0] for r in first.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    clean = corpus_pipeline.toxic(spark, first, SF)
    labels = toxicity.clean_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score_texts(first, labels).collect() if r["score"] >= 0.5}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in first.collect()} - bad
    unique = corpus_pipeline.near_duplicates(spark, clean, SF)
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    want = {a for a, root, *_ in brute_join(rows) if a == root}
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == want
    packed = corpus_pipeline.packed(spark, unique, SF)
    check_packing(packed.collect(), [(i, None) for i in want])


def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_join", "packing"]
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    all_ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids and ids <= all_ids


@pytest.mark.parametrize("word", ["language", "toxic", "near_duplicates", "packed"])
def test_empty_corpus(spark, word):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    assert getattr(corpus_pipeline, word)(spark, docs, SF).count() == 0


def test_without_languages_to_learn_from_texts_with_a_letter_stay(spark):
    docs = spark.createDataFrame([(1, "das haus"), (2, "12 !"), (3, None), (4, "дом")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()) == [1, 4]


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    a, b = "one two three four five six seven eight nine ten " * 4, "red green blue white black pink brown grey lime teal " * 4
    rows = [(7, a), (7, a), (None, a + "extra"), (3, b), (None, b), (None, b), (9, b), (9, "a text of its own that nobody copied"), (None, "another text of its own"), (7, "a third text that is no copy of any"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit("clash"))
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == sorted([(7, a), (3, b), (9, rows[7][1]), (0, rows[8][1]), (7, rows[9][1]), (4, "")])


def test_the_root_file_names_the_same_pipeline():
    import corpus_pipeline as root

    assert root.STAGES is corpus_pipeline.STAGES and root.run is corpus_pipeline.run and queries.queries()["pipeline"] is root.run


def test_rows_without_an_id_are_judged_by_their_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(None, "what an idiot and a moron and a loser you are", "en", "src0", 45), (None, "the and of the in a", "en", "src0", 19), (0, None, "en", None, 0)], docs.schema)
    kept = corpus_pipeline.toxic(spark, docs.unionByName(odd), "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["n_chars"]) for r in kept.collect()]
    assert (None, 45) not in rows and (None, 19) in rows and (0, 0) in rows


@pytest.mark.parametrize("name", ["score", "lang_pred", "predicted", "evidence_ids", "evidence_cosines", "_row", "class_id", "id", "row", "t", "k0", "in1", "n_links", "_bits"])
def test_columns_of_any_name_come_through_unchanged(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn(name, F.concat(F.lit("own "), F.col("doc_id")))
    for step in (corpus_pipeline.language, corpus_pipeline.toxic, corpus_pipeline.near_duplicates):
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.select("doc_id", name).collect()
        assert rows and all(r[name] == f"own {r['doc_id']}" for r in rows)


def test_the_pipeline_runs_with_all_clashes_and_odd_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long"))
    clashes = {c: F.lit("x") for c in ("score", "lang_pred", "predicted", "evidence_ids", "evidence_cosines", "_row", "text_", "start", "length", "sequence_id")}
    docs.unionByName(odd).withColumns(clashes).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
