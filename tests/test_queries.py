import pytest

from lumenframe.plans import catalog
from tests.helpers import collected, oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert collected(catalog.queries()[name](spark, SF)) == oracle(SF, catalog.oracle_sql()[name])


def test_every_video_gets_one_split(spark):
    rows = catalog.queries()["greedy_video_split"](spark, SF).collect()
    assert len({r["video"] for r in rows}) == len(rows) > 0
    assert {r["split"] for r in rows} <= {"train", "val", "test"}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["zs_argmax"](spark, SF).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_label_gets_a_head_of_the_whole_grid(spark, monkeypatch):
    from lumenframe.operators import fits

    tried, fit = [], fits.fit
    monkeypatch.setattr(fits, "fit", lambda rows, models, dim: tried.append([(m.target, m.c) for m in models]) or fit(rows, models, dim))
    monkeypatch.setattr(fits, "PASSES", 3)
    got = catalog.queries()["train_heads"](spark, SF).collect()
    labels = {r["label"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("label").distinct().collect()}
    assert [r["class"] for r in got] == sorted(labels) and len(labels) == 10
    assert len(tried) == 1 and sorted(tried[0]) == [(i, c) for i in range(10) for c in (0.01, 0.1, 1.0)]


def test_the_probe_tries_every_c_in_five_folds(spark, monkeypatch):
    from lumenframe.operators import fits

    tried, fit = [], fits.fit
    monkeypatch.setattr(fits, "fit", lambda rows, models, dim: tried.append([(m.c, m.without) for m in models]) or fit(rows, models, dim))
    monkeypatch.setattr(fits, "PASSES", 3)
    got = catalog.queries()["linear_probe"](spark, SF).collect()
    assert len(got) == 10 and len(tried) == 1
    assert sorted(x for x in tried[0] if x[1] is not None) == [(c, f) for c in (0.1, 1.0, 10.0, 100.0) for f in range(5)]
