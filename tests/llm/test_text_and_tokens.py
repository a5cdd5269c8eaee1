"""Media, pages, tokens, packing and the n-gram join against libraries, brute force and on odd inputs."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import bpe, common, htmltext, jaccard, media, packing, queries, tokenio, units
from tests.helpers import collected, oracle

SF = "/root/testdata/sf0.001"
BYTES, WORDS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
ODD = ["", "a", "It's 12,5 <|endoftext|> x", "É İx ﬁ!! áb \x1c q\x85z", "hello  world\n\nfoo \n bar\tq ", " lead", "don't,. x.., 3.14. a　b", "x" * 3000, "日本語 テキスト", "a\0b c", "\n", "aaaa aaa aaaaa", "🙂 é tail,"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "s") for i, t in enumerate(ODD)] + [(None, "no id", "s"), (5, None, "s"), (3, "a", "s"), (700, "word and more words " * 60_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").withColumn("n_tokens", F.lit("clash"))


@lru_cache
def library(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Blank lines, tabs, runs of spaces, contractions, special tokens and white space that libraries read in different ways.
GAPS = [
    "a\n\nb", "a \n b", "a\t\tb  c", "  a", "a  ", "\n\n", "a\u00a0 b", "a\u00a0b", "é\u2003 b", "b\u3000 c", "a\x1c b", "a\x85 b", "don't we'll l'homme O'S", "a<|endoftext|>b", "a <|endoftext|> b<|startoftext|>.", "3.14, 1,000!! x_y",
    "e\u0301 a\u0308b", "<\u0338 =\u0338", "İstanbul ıı ŒUVRE œuvre ß", "naïve, café; où?", "x×y÷z.", "ΑΣ ΟΔΟΣ. Ж, й", "\u180e \u200b x", "a.\u0301 b",
]


@pytest.mark.parametrize("kept", [1_000_000, 6])
@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_units_encode_as_whole_texts_do(path, spaced, kept):
    texts = [*ODD, *GAPS, *(g.join(ODD) for g in (" ", "\n\n", "\t", "  ")), "y " * 300, "z" * 250 + " z"]
    encoder, tok = units.UnitEncoder(units.LibraryWords(path, spaced), kept=kept), library(path)
    for _ in range(3):  # known units, and a table that drops some
        ids, sizes = encoder.encode_many(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.known) <= max(kept, 6) and encoder.encode_many([])[0].size == 0


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_words_encode_as_whole_texts_do(path, spaced):
    import duckdb

    texts = ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    ids, sizes = units.library_encoder(path, spaced).encode_many(texts)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    assert [x.tolist() for x in got] == [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cé.,'\n\t12!s<|>İ́日\u00a0\u2003\u0338="), max_size=30), min_size=1, max_size=4))
def test_numpy_bpe_equals_the_library(texts):
    tok, own = library(BYTES), bpe.load(BYTES)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = own.encode_many(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert own.decode(ids, sizes) == [tok.decode(x, skip_special_tokens=False) for x in want]
    lib, lib_sizes = units.library_encoder(WORDS, False).encode_many(texts)
    assert [x.tolist() for x in np.split(lib, np.cumsum(lib_sizes)[:-1])] == [e.ids for e in library(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_broken_bytes_decode_with_replacement():
    own = bpe.load(BYTES)
    ids = own.first[[0xE2, 0x82]]
    assert own.decode(ids, np.array([2])) == ["�"]


def test_round_trip_query(spark, docs):
    tok = library(BYTES)
    got = sorted(map(tuple, bpe.token_round_trip(docs, BYTES, digests=True).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.token_round_trip(docs.limit(0), BYTES).count() == 0
    plain = bpe.token_round_trip(docs.where("doc_id = 6"), BYTES).first()
    assert plain["decoded"] == ODD[2] and len(plain["ids"]) == plain["n_tokens"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_rank_code_round_trip(ranks):
    x = np.array(ranks, np.uint32)
    assert tokenio.unpack_ranks(*tokenio.pack_ranks(x), len(x)).tolist() == ranks


def test_token_files(spark, docs, tmp_path):
    tok = library(BYTES)
    tokenio.write_tokens(docs, str(tmp_path / "t"), BYTES, 2)
    rows = sorted(tokenio.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    at, seen = 0, []
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
        seen.append((r["doc_id"], tuple(r["ids"])))
    assert [i for i, _ in seen] == sorted((i for i, _ in seen), key=lambda i: -1 if i is None else i)
    want = [(r["doc_id"], (*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2)) for r in docs.collect()]
    assert Counter(seen) == Counter(want)
    tokenio.write_tokens(docs.limit(0), str(tmp_path / "e"), BYTES, 2)
    assert tokenio.read_tokens(spark, str(tmp_path / "e")).count() == 0


def check_packing(rows, want):
    """Every id in exactly one piece; windows gapless; no padding but to a power of two."""
    spans, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    total = Counter()
    for (doc, n), pieces in spans.items():
        copies, left = divmod(sum(p[1] for p in pieces), n)
        assert not left
        total[doc] += copies
    assert total == Counter(k for k, _ in want)
    return spans


def test_batches_by_bytes():
    batches = [pa.RecordBatch.from_pydict({"i": list(range(k, k + 5)), "t": ["x" * n for n in sizes]}) for k, sizes in ((0, (1, 1, 1, 1, 1)), (5, (30, 1, 9, 2, 8)), (10, (0, 0, 0, 0, 0)))]
    got = [(b["i"].to_pylist(), sum(map(len, b["t"].to_pylist()))) for b in common.by_bytes(iter(batches), "t", 10)]
    assert [i for x, _ in got for i in x] == list(range(15)) and [n for _, n in got] == [35, 10, 10, 0]
    assert list(common.by_bytes(iter([]), "t")) == []


def test_packing_of_odd_documents(spark, docs):
    tok = library(WORDS)
    want = [(r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    spans = check_packing(packing.pack(docs, WORDS).collect(), want)
    by = dict(want)
    for (doc, n), pieces in spans.items():
        if sum(k == doc for k, _ in want) == 1:
            for s, length, crc in pieces:
                assert crc == zlib.crc32(np.array(by[doc][s : s + length], "<u4").tobytes()) and n == len(by[doc])
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_packing_query(spark):
    rows = queries.op9_packing(spark, SF).collect()
    docs = [(r["doc_id"], None) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    check_packing(rows, docs)
    groups = Counter()
    for r in {(r["sequence_id"], r["sequence_length"], r["step_group"]) for r in rows}:
        groups[r[2]] += r[1]
    assert sum(n != packing.STEP_IDS for n in groups.values()) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=60))
def test_packer(sizes):
    p = packing.Packer()
    half = len(sizes) // 2
    out = p.add(list(enumerate(sizes[:half]))) + p.add(list(enumerate(sizes))[half:]) + p.close()
    cover = defaultdict(list)
    for s in out:
        n = sum(x[2] for x in s)
        assert n & (n - 1) == 0 and n <= 2048
        for doc, start, length in s:
            cover[doc] += range(start, start + length)
    assert {d: sorted(x) for d, x in cover.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_media(spark, docs):
    stored = media.audio_features(docs)
    rows = {(r["id"], r["n_bytes"]): r for r in media.describe(stored).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        got = rows[r["doc_id"], len(raw)]
        assert got["payload_bytes"] == len(payload) and got["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got["tail_crc32"] == zlib.crc32(payload[-16:])
        assert got["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest() and got["media_bytes"] == 44 + len(payload)
    for r in stored.where("n_bytes > 1000").collect():
        table = media.from_arrow(r["tensors"])
        assert table["tensor"].type.shape == [media.TENSOR, media.MELS] and sum(table["n_frames"].to_pylist()) == r["n_frames"]
        begins, ends = table["t_begin"].to_pylist(), table["t_end"].to_pylist()
        assert begins[0] == 0 and begins[1:] == ends[:-1] and abs(ends[-1] - r["n_frames"] * media.STEP) < 1e-9
        assert all(0 <= s["t_begin"] < s["t_end"] <= ends[-1] + 1e-9 for s in r["segments"])
    assert media.describe(media.audio_features(docs.limit(0))).count() == 0


def test_log_mel_against_plain_loops(monkeypatch):
    x = np.random.default_rng(3).integers(0, 256, 2000).astype(np.uint8)
    y = media.resample((x.astype(np.float32) - 128) / 128)
    mel, energy = media.log_mel(x)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + media.RATE * 2 / 3 / 2 / 700), media.MELS + 2)]
    assert len(mel) == 1 + -(-(len(y) - media.FRAME) // media.HOP)
    for f in range(len(mel)):
        part = [float(y[f * media.HOP + i]) * (0.5 - 0.5 * np.cos(2 * np.pi * i / media.FRAME)) if f * media.HOP + i < len(y) else 0.0 for i in range(media.FRAME)]
        assert abs(energy[f] - 10 * np.log10(sum(v * v for v in part) / media.FRAME)) < 1e-3
        power = [abs(sum(v * np.exp(-2j * np.pi * k * i / media.FRAME) for i, v in enumerate(part))) ** 2 for k in range(media.FRAME // 2 + 1)]
        for m in range(media.MELS):
            total = 0.0
            for k, p in enumerate(power):
                hz = k * (media.RATE * 2 / 3) / media.FRAME
                total += p * max(0.0, min((hz - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - hz) / (edges[m + 2] - edges[m + 1])))
            assert abs(mel[f, m] - np.log10(max(total, 1e-8))) < 1e-2
    monkeypatch.setattr(media, "SLAB", 3)  # slabs change nothing
    again, loud = media.log_mel(x)
    assert np.allclose(again, mel, atol=1e-5) and np.allclose(loud, energy, atol=1e-4)


def test_signal_steps_against_plain_loops():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(500).astype(np.float32)
    padded, y = np.pad(x, (8, 40)), media.resample(x)
    want = [float(padded[m * 3 // 2 : m * 3 // 2 + media.TAPS] @ media._phases()[m * 3 % 2]) for m in range(len(y))]
    assert len(y) == -(-500 * 2 // 3) and np.allclose(y, want, atol=1e-5)
    flat = media.resample(np.full(300, 0.5, np.float32))
    assert np.allclose(flat[10:-10], 0.5, atol=1e-3)
    energy = np.array([-9.0, -4, -1, -4, -7, -4, 0, -2])
    state, out = False, []
    for i, e in enumerate(energy):
        now = e >= -3 or state and e >= -6
        if now and not state:
            out.append([i, i])
        if now:
            out[-1][1] = i + 1
        state = now
    assert media.segments(energy).tolist() == out == [[2, 4], [6, 8]]
    payload = bytes(range(192))
    assert media.from_wav(media.to_wav(payload)) == (payload, media.RATE)
    with pytest.raises(ValueError):
        media.from_wav(b"no wav")


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on the site and that is for you to know.</p></div><article><h1>On &amp; on</h1><p>The first of the
  lines is <b>long</b> enough, and it has the words that a text has: it is on the page for all of the people who are here, and they read it.<p>Short &copy; one.
<form><p>Name</p><input></form><aside>Related: the other of the texts that is on the site for you</aside><p>x &lt; y<br>z</p><div id="comments"><p>I like the text and the people that are in it.</p></div></article>
<footer>Imprint</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_main_text():
    want = "On & on\nThe first of the lines is long enough, and it has the words that a text has: it is on the page for all of the people who are here, and they read it.\nShort © one.\nx < y z"
    assert htmltext.main_text(PAGE) == want
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == ""
    assert htmltext.main_text("plain < text & more") == "plain < text & more"
    assert htmltext.main_text("<nav>" * 3000 + "<p>" * 3000) == ""


def test_pages_give_their_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, "<article><p>hi</article>")], "page_id int, url string, html string")
    assert sorted(r["text"] for r in htmltext.extract(odd).collect()) == ["", "", "hi"]


def brute_join(rows, n=5, similarity=0.8):
    grams = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        grams[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    links = defaultdict(set)
    for a in grams:
        for b in grams:
            if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]):
                links[a].add(b)
                links[b].add(a)
    out = set()
    for a in grams:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        same = [b for b in grams if grams[b] == grams[a]] if grams[a] else [a]
        out.add((a, min(seen), min(same), len(same), len({grams[b] for b in links[a]} - {grams[a]}), len(links[a])))
    return out


def test_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 30])):
            w = list(b)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000, "one two"), (2001, "One, two!"), (2002, None), (2003, ""), (2004, "..."), (2005, "long words here " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {tuple(r) for r in jaccard.ngram_join(df).collect()}
    assert got == brute_join(rows)
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # components fall into several block pairs
    monkeypatch.setattr(common, "HOT_ROWS", 3)  # and some keys count as hot
    assert {tuple(r) for r in jaccard.ngram_join(df).collect()} == got
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 100)
    assert {tuple(r) for r in jaccard.ngram_join(df).collect()} == got
    assert jaccard.ngram_join(df.limit(0)).count() == 0


def test_join_takes_repeated_rows_as_copies(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.ngram_join(df).collect()) == [(1, 1, 1, 3, 0, 2), (1, 1, 1, 3, 0, 2), (2, 1, 1, 3, 0, 2)]


def brute_rows(rows, n=5, similarity=0.8):
    """As ``brute_join``, row by row: an id may have several texts."""
    keyed = brute_join([(k, t) for k, (_, t) in enumerate(rows)], n, similarity)
    id_of = [i for i, _ in rows]
    classes, sets = defaultdict(list), defaultdict(list)
    for k, c, s, *_ in keyed:
        classes[c].append(id_of[k])
        sets[s].append(id_of[k])
    return sorted((id_of[k], min(classes[c]), min(sets[s]), *rest) for k, c, s, *rest in keyed)


def test_one_id_with_several_texts(spark, monkeypatch):
    rng = random.Random(3)
    a, b = ([rng.choice("abcdefghijkl") + str(rng.randrange(99)) for _ in range(60)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*b, "more"])), (7, " ".join([*a, "more"])), (5, " ".join(a)), (2, " ".join([*a, "other"])), (5, None), (5, ""), (9, " ".join(b).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_rows(rows)
    assert sorted(map(tuple, jaccard.ngram_join(df).collect())) == want
    assert {r[1] for r in want if r[0] == 6} == {5} and {r[1] for r in want if r[0] == 7} == {2}
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    assert sorted(map(tuple, jaccard.ngram_join(df).collect())) == want


def test_recall_just_above_the_threshold():
    """Of pairs with a similarity of 0.80 to 0.85, by the hash functions in use, 0.99 or more share a band."""
    rng = np.random.default_rng(8)
    bands, rows = jaccard.bands_for()
    hit = total = 0
    for _ in range(300):
        shared = int(rng.integers(160, 400))
        extra = int(shared * rng.uniform(0.18, 0.249))
        words = [f"w{x}" for x in rng.integers(0, 10**9, shared + extra)]
        one = int(rng.integers(0, extra + 1))
        left, right = (np.unique(np.concatenate([jaccard.ngrams(w, 1) for w in part])) for part in (words[: shared + one], words[:shared] + words[shared + one :]))
        jac = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
        if 0.8 <= jac <= 0.85:
            total += 1
            hit += bool((jaccard.signature(left, bands, rows) == jaccard.signature(right, bands, rows)).any())
    assert total > 200 and hit / total >= 0.99


def test_components_with_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(40), 0), **dict.fromkeys(range(100, 161), 100), 200: 200, 201: 200}


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_for()
    assert (1 - jaccard.SIMILARITY**rows) ** bands <= 1 - jaccard.RECALL and bands * rows <= jaccard.FUNCTIONS


def test_join_query_equals_sql(spark):
    assert collected(queries.op10_ngram_join(spark, SF)) == oracle(SF, queries.oracle_sql()["op10_ngram_join"])


@pytest.mark.parametrize("page", ["<div class='" * 20_000, '<a href="' * 20_000 + "x", "<" * 100_000, "<div>" * 20_000 + "x", "<svg>a" * 20_000, "<a<b" * 30_000, '<a ' + '"<a "' * 20_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 20


def test_tags_with_many_attributes():
    assert htmltext.main_text("<p " + " ".join(f'a{i}="x>y"' for i in range(6000)) + ">text of it</p>") == "text of it"


def test_scripts_and_inline_adverts():
    page = '<article><p>before <script>if (a<b && c == "x") { d = "</p>" }</script>after <span class="ad">buy <span>this</span> now</span></p><p>end</p></article>'
    assert htmltext.main_text(page) == "before after\nend"


ENGLISH = "The first of the lines is long enough, and it has the words that a text has: it is on the page for all of the people who are here, and they read it."
OTHERS = [
    "Каждое утро старый смотритель поднимался на башню маяка, протирал стёкла большой лампы, записывал погоду в толстую тетрадь, потом долго смотрел вдаль, где проходили корабли.",
    "Każdego ranka stary latarnik wchodził powoli po schodach, czyścił szkła wielkiej lampy, zapisywał pogodę w grubym zeszycie, potem długo patrzył w dal, gdzie przepływały statki.",
    "每天早晨，年老的灯塔看守人都会爬上高高的灯塔，擦拭那盏巨大的灯，把天气写进厚厚的本子里，然后久久地望着远方来往的船只。" * 3,
]


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="overflow-hidden"><article><p>{}</p></article></div></body>',
        '<body><div class="layout has-sidebar"><article><p>{}</p></article><div class="sidebar"><p>Other.</p></div></div></body>',
        '<body><article class="post no-comments"><p>{}</p><div id="comments"><p>I like it.</p></div></article></body>',
        '<body><div class="page-header-wrap related"><article><p>{}</p></article></div></body>',
        '<body><div class="header-layout"><p>{}</p></div><div class="cookie-notice"><p>We use cookies.</p></div></body>',
        '<body><p title="The hidden valley">{}</p></body>',
        '<body><div data-hidden="false"><p>{}</p></div><div hidden><p>Gone.</p></div></body>',
        '<body><nav><a href=/>Home</a></nav><div><p>{}</p></div><div class="related"><article><p>Other news.</p></article></div><footer>Imprint</footer></body>',
    ],
)
def test_names_of_elements_do_not_hide_the_article(page):
    assert htmltext.main_text(page.format(ENGLISH)) == ENGLISH


@pytest.mark.parametrize("text", OTHERS)
def test_text_without_known_stop_words_stays(text):
    page = f"<body><nav><a href=/>Home</a></nav><div><p>{text}</p><p>{text}</p></div><div><a href=/x>{text}</a></div><footer>Imprint</footer></body>"
    assert htmltext.main_text(page) == f"{text}\n{text}"


def test_densities_decide(monkeypatch):
    links = "<p>" + " ".join(f'<a href="/{i}">the story of the day</a>' for i in range(12)) + " and</p>"
    numbers = "<p>" + " ".join(f'<a href="/{i}">{i}{i}{i}{i}</a> {i}9,{i}7' for i in range(30)) + "</p>"
    for page in (f"<article><p>{ENGLISH}</p>{links}{numbers}<p>{ENGLISH}</p></article>", f"<body><p>{ENGLISH}</p>{links}{numbers}<p>{ENGLISH}</p></body>"):
        assert htmltext.main_text(page) == f"{ENGLISH}\n{ENGLISH}"
    loose = f"<body><p>{ENGLISH}</p>{links}</body>"
    assert "story" not in htmltext.main_text(loose)
    monkeypatch.setattr(htmltext, "LINKED", 1.0)
    assert "story" in htmltext.main_text(loose)
    monkeypatch.setattr(htmltext, "LINKED_MAIN", 1.0)
    assert "story" in htmltext.main_text(f"<article><p>{ENGLISH}</p>{links}</article>")
    monkeypatch.undo()
    short = f"<body><p>{ENGLISH}</p><p>ok</p><nav><p>x</p></nav></body>"
    assert htmltext.main_text(short).endswith("ok")
    monkeypatch.setattr(htmltext, "STOP_HIGH", 2.0)
    monkeypatch.setattr(htmltext, "LONG", 10_000)
    assert htmltext.main_text(short) != ENGLISH + "\nok"


def test_ambiguous_blocks_go_with_the_nearest_decided_ones():
    menu = '<div><a href="/a">one of the links of the site that is here for you</a></div>'
    page = f"<body>{menu}<div>Near the menu</div>{menu}<h2>A heading</h2><p>{ENGLISH}</p><div>In between</div><p>{ENGLISH}</p>{menu}</body>"
    assert htmltext.main_text(page) == f"A heading\n{ENGLISH}\nIn between\n{ENGLISH}"


def test_a_stray_teaser_is_not_the_article():
    body = f"<div><h1>On it</h1>{f'<p>{ENGLISH}</p>' * 8}</div>"
    assert htmltext.main_text(f"<body>{body}<article><p>Other news.</p></article></body>").startswith("On it\n" + ENGLISH)
    assert htmltext.main_text(f"<body><article><p>Only this.</p></article><div><p>{ENGLISH}</p></div></body>") == "Only this."


COMMENT = "I think that this is not what the writer of the piece had in mind, and it is a pity that all of the others on the site say the same of it."


@pytest.mark.parametrize("kind", ['div class="comments"', 'section class="comments"', 'div class="sidebar"', 'div class="cookie-notice"', 'div class="newsletter"', 'div class="ad"'])
@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_what_an_element_is_counts_not_its_weight(kind, n):
    junk = f"<{kind}>" + "".join(f"<p>{COMMENT} {i}</p>" for i in range(n)) + f"</{kind.split()[0]}>"
    for page in ("<article><p>{}</p></article>{j}", "{j}<article><p>{}</p></article>", "<article><p>{}</p>{j}</article>", "<article>{j}<p>{}</p></article>", "<div><p>{}</p></div>{j}", "{j}<p>{}</p>"):
        assert htmltext.main_text(f"<body>{page.format(ENGLISH, j=junk)}</body>") == ENGLISH
    for page in ("<article><h1>T</h1><p>Short.</p>{j}</article>", "<h1>T</h1><p>Short.</p>{j}"):
        assert htmltext.main_text(f"<body>{page.format(j=junk)}</body>") == "T\nShort."
    wrapped = f'<body><div class="{kind.split(chr(34))[1]}-layout"><article><h1>T</h1><p>{ENGLISH}</p>{junk}</article></div></body>'
    assert htmltext.main_text(wrapped) == f"T\n{ENGLISH}"


@pytest.mark.parametrize("level", [0, 1, 2])
def test_densities_find_the_article_without_semantic_tags(level):
    """Pages with <article> renamed, then without class, id and role, then without any semantic tag keep their text."""
    import re

    import duckdb

    same = total = 0
    for (page,) in duckdb.sql(f"SELECT html FROM read_parquet('{SF.replace('0.001', '0.01')}/pages.parquet')").fetchall():
        plain = re.sub(r"<(/?)article\b", r"<\1div", page)
        plain = re.sub(r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", plain) if level else plain
        plain = re.sub(r"<(/?)(nav|footer|header|aside|main|section|form)\b", r"<\1div", plain) if level > 1 else plain
        same, total = same + (htmltext.main_text(plain) == htmltext.main_text(page)), total + 1
    assert same >= 0.98 * total > 200


def test_nearest_decided_blocks_equal_a_plain_reading():
    rng = random.Random(3)
    for _ in range(300):
        blocks = [htmltext.Block("x", 0, False, False, rng.choice([0, 0, 0, 1, 3]), box=rng.randrange(3), label=rng.choice([None, None, True, False])) for _ in range(rng.randrange(1, 12))]
        for i, (p, q) in enumerate(htmltext._nearest(blocks)):
            before = [(i - j, b.label) for j, b in enumerate(blocks[:i]) if b.label is not None][::-1]
            after = [(j - i, b.label) for j, b in enumerate(blocks) if j > i and b.label is not None and not any(x.heading for x in blocks[i + 1 : j + 1])]
            own_before = [(i - j, b.label) for j, b in enumerate(blocks[:i]) if b.label is not None and b.box == blocks[i].box][::-1]
            own_after = [(j - i, b.label) for j, b in enumerate(blocks) if j > i and b.label is not None and b.box == blocks[i].box]
            want = (own_before, own_after) if own_before or own_after else (before, after)
            assert (p, q) == tuple(x[0] if x else None for x in want)


def test_deep_soft_elements_take_linear_time():
    import time

    began = time.process_time()
    for tag in ('<div class="ad">', '<article class="ad">', "<article>"):
        htmltext.main_text(f"{tag}<p>{ENGLISH}</p>" * 10_000)
    assert time.process_time() - began < 30


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{ENGLISH}</p>", "t", 5)], "page_id int, url string, html string, text string, n_chars int").withColumn("h", F.lit("x")).withColumn("k0", F.lit(1))
    assert htmltext.extract(df).select("text", "n_chars").first() == (ENGLISH, len(ENGLISH))
    assert htmltext.extract(df.limit(0)).count() == 0


def test_boilerplate_by_class_stays_out():
    junk = "".join(f'<div class="{c}"><p>All of the news that is on the site for you and for the people who are here.</p></div>' for c in ("site-footer", "ad", "cookie-notice", "related posts"))
    assert htmltext.main_text(f"<body><p>{ENGLISH}</p><p>{ENGLISH}</p><p>{ENGLISH}</p>{junk}</body>") == "\n".join([ENGLISH] * 3)


def test_staging_needs_a_shared_folder_off_local_mode():
    from types import SimpleNamespace

    class Conf(dict):
        set = dict.__setitem__

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.stage_dir(SimpleNamespace(conf=Conf({"spark.master": master})))
    assert common.stage_dir(SimpleNamespace(conf=Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"}))) == "hdfs:///x"
    local = Conf({"spark.master": "local[2]"})
    assert common.stage_dir(SimpleNamespace(conf=local)) == local["spark.checkpoint.dir"]


def test_very_long_texts():
    text = "The quick words of a very long text, and more of them. " * 200_000  # 11 MB
    tok = library(WORDS)
    one = tok.encode("The quick words of a very long text, and more of them.", add_special_tokens=False).ids
    ids, sizes = units.UnitEncoder(units.LibraryWords(WORDS, False)).encode_many([text, "a"])
    assert sizes.tolist() == [200_000 * len(one), 1] and (ids[:-1].reshape(200_000, -1) == one).all()
    assert len(jaccard.ngrams(text)) == 12
    mel, energy = media.log_mel(np.frombuffer(media.payload_of(text), np.uint8))
    assert len(mel) == len(energy) and len(media.from_arrow(media.to_arrow(mel))) == -(-len(mel) // media.TENSOR)
    assert htmltext.main_text(f"<article><p>{text}</p></article>") == text.strip()
