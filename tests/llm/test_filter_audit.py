"""The filter audit against a plain loop over rows and orders, and on odd tables."""

import re
from itertools import permutations

from lumenframe.llm import audit, queries
from tests.helpers import collected, oracle

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        earlier = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), earlier)
        failed.append((lang or "", i, {k for k, x in zip("ABCDE", tests, strict=True) if x}))
    out = []
    for part in {p for p, _, _ in failed}:
        own, shapley, rows = [(i, f) for p, i, f in failed if p == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                rows.append((part, order, k + 1, len(stay), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
                shapley[x] += len(gone)
                left = stay
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def run(spark, docs, labels):
    found = audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(map(tuple, found.collect()))


LONG = " ".join(f"w{i}" for i in range(120))


def test_audit_equals_sql(spark):
    assert collected(queries.op13_filter_audit(spark, SF)) == oracle(SF, queries.oracle_sql()["op13_filter_audit"])


def test_every_mask_equals_brute_force(spark):
    """One text for each set of failures, several in two parts and some of them labelled."""
    docs = []
    for m in range(16):
        words = ["word"] * (30 if m & 1 else 150) if m & 2 else [f"x{i}" for i in range(40 if m & 1 else 150)]
        text = " ".join(words) + (" " + "ABC" * 120 if m & 4 else "") + (" #" if m & 8 else "")
        docs += [(m * 4 + c, text, ("en", "de")[c % 2] if m % 5 else None) for c in range(3)]
    labels = [(d[0], d[0] % 2, int(d[0] % 3 == 0)) for d in docs if d[0] % 4 < 2]
    got = run(spark, docs, labels)
    assert got == brute(docs, labels) and len(got) == 600 * 3
    assert all(type(x) is int for r in got for x in r[2:])


def test_audit_of_odd_rows(spark):
    docs = [
        (1, None, None), (2, "", ""), (None, "", "en"), (None, "", "en"), (3, LONG, "en"), (3, LONG, "en"), (4, LONG, None), (5, LONG + " ", "en"),
        (6, "a\x0bb\x1cc  " * 60, "en"), (7, "É" * 50 + " %", "fr"), (8, "w" * 300_000 + " " + "Ab " * 50_000, "fr"), (9, LONG.upper(), "fr"),
    ]
    labels = [(1, 1, None), (3, None, 1), (3, 1, 0), (4, 0, 0), (None, 1, 1), (99, 1, 1), (9, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_audit_without_rows_and_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, LONG, "en", 5, "x", True, 2)], "doc_id long, text string, lang string, id int, part string, good boolean, mask int")
    labels = spark.createDataFrame([(1, 1, 0, "y")], "doc_id long, quality int, toxic int, part string")
    assert audit.filter_audit(docs.limit(0), labels).collect() == []
    rows = audit.filter_audit(docs, labels.limit(0)).collect()
    assert len(rows) == 600 and {r["kept"] for r in rows} == {1} and {r["good_lost"] for r in rows} == {0}
    assert audit.filter_audit(docs, labels).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_copies_across_many_rows_are_one_group(spark, monkeypatch):
    from lumenframe.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    docs = [(i, "same" if i % 3 else f"own {i}", "en") for i in range(60)]
    assert run(spark, docs, [(i, 1, 1) for i in range(10)]) == brute(docs, [(i, 1, 1) for i in range(10)])
