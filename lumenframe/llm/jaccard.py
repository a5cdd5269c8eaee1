"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Equal sets are one node from the start, whatever their ids. The nodes' signatures are shuffled on band hashes, band
mates are chained into candidate components, and a component's texts come together to count intersections of their
n-gram sets by matrix products. A large component falls into blocks of nodes that share a band, and only pairs of
blocks with band mates in both are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import by_bytes, components, give_back, join_hot, map_arrow, mix64, only_listed, ragged, stage, texts_of

#: Words of an n-gram and the least similarity of a link.
NGRAM, SIMILARITY = 5, 0.8
#: The share of links at the least similarity that banding must find, and the hash functions it may take for that.
RECALL, FUNCTIONS = 0.9999, 256
#: Nodes of one side of a block pair in verification, and about the n-grams of all of them; a larger node stands alone.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, functions: int = FUNCTIONS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, that reach ``recall`` with ``functions``."""
    best = (functions, 1)
    for rows in range(1, functions + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows > functions:
            break
        best = (bands, rows)
    return best


class _WordHash(dict):
    """64-bit hashes of words, kept."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_hash_of = _WordHash()


def ngrams(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word n-grams (case folded; a shorter text is one n-gram)."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * _SEED
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


@lru_cache
def _functions(count: int) -> np.ndarray:
    """Odd factors of the hash functions: (factor * low half) xor high half of an n-gram's hash."""
    return np.random.default_rng(20240229).integers(1, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the MinHash signature (signed, as Spark keeps it)."""
    factor = _functions(bands * rows)[:, None]
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 512):  # the products of one slice stay in the processor's cache
        work = factor * low[at : at + 512]
        work ^= high[at : at + 512]
        np.minimum(least, work.min(axis=1), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _SEED
    for part in least.reshape(bands, rows).T:
        out = mix64(out ^ part)
    return out.view(np.int64)


def _signatures(bands: int, rows: int, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t"):
            one, two, size, sig = [], [], [], []
            for t in texts_of(b["t"]):
                g = ngrams(t, n)
                size.append(len(g))
                one.append(int(g.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mix64(g ^ _SEED)).view(np.int64)) if len(g) else 0)
                sig.append(signature(g, bands, rows) if len(g) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b["id"], b["h"], pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int32()), ragged(np.concatenate(sig) if sig else np.zeros(0, np.int64), np.array([len(s) for s in sig]))], ["id", "h", "set1", "set2", "size", "bands"])
        _hash_of.clear()
        give_back()

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|A and B| for all pairs: products of 0/1 matrices over the n-grams that both sides have, a slice at a time."""
    out = np.zeros((len(left), len(right)))
    lg = np.concatenate(left) if left else np.zeros(0, np.uint64)
    rg = np.concatenate(right) if right else np.zeros(0, np.uint64)
    lr = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rr = np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(lg, rg)
    if left is right:
        u, c = np.unique(lg, return_counts=True)
        shared = u[c > 1]
        np.fill_diagonal(out, 0)
    lp, rp = np.searchsorted(shared, lg), np.searchsorted(shared, rg)
    lp[lp == len(shared)] = 0
    rp[rp == len(shared)] = 0
    lh, rh = (shared[lp] == lg, shared[rp] == rg) if len(shared) else (np.zeros(len(lg), bool), np.zeros(len(rg), bool))
    lp, lr, rp, rr = lp[lh], lr[lh], rp[rh], rr[rh]
    lo, ro = np.argsort(lp, kind="stable"), np.argsort(rp, kind="stable")
    lp, lr, rp, rr = lp[lo], lr[lo], rp[ro], rr[ro]
    for at in range(0, len(shared), 4096):
        l0, l1 = np.searchsorted(lp, [at, at + 4096])
        r0, r1 = np.searchsorted(rp, [at, at + 4096])
        width = min(4096, len(shared) - at)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        a[lr[l0:l1], lp[l0:l1] - at] = 1
        b[rr[r0:r1], rp[r0:r1] - at] = 1
        out += a @ b.T
    return out


def _links(similarity: float, n: int) -> Callable:
    """Links of the nodes of one block pair: (node, links to nodes, links to documents, least linked node of its part)."""

    def run(table: pa.Table) -> pa.Table:
        ids, side, copies = (table[c].to_numpy() for c in ("node", "side", "copies"))
        grams = [ngrams(t, n) for t in texts_of(table["t"].combine_chunks())]
        size = np.array([len(g) for g in grams])
        li, ri = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(ri)
        ri = li if same else ri
        left = [grams[i] for i in li]
        both = intersections(left, left if same else [grams[i] for i in ri])
        grams.clear()
        linked = np.zeros(both.shape, bool)
        classes, documents = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        rows = [np.arange(low, min(low + 256, len(li))) for low in range(0, len(li), 256)]
        for part in rows:
            union = size[li[part]][:, None] + size[ri][None, :] - both[part]
            mine = both[part] >= similarity * union - 1e-9
            if same:
                mine[np.arange(len(part)), part] = False
            linked[part] = mine
            classes[li[part]] += mine.sum(axis=1)
            documents[li[part]] += mine @ copies[ri]
            if not same:
                classes[ri] += mine.sum(axis=0)
                documents[ri] += mine.T @ copies[li[part]]
        del both
        root, none = ids.copy(), np.iinfo(np.int64).max
        while True:
            was = root.copy()
            for part in rows:
                near, own = root[ri], root[li[part]]
                root[li[part]] = np.minimum(own, np.where(linked[part], near[None], none).min(axis=1, initial=none))
                root[ri] = np.minimum(root[ri], np.where(linked[part], root[li[part]][:, None], none).min(axis=0, initial=none))
            if (was == root).all():
                break
        return pa.table({"node": ids, "links": classes, "documents": documents, "root": root})

    return run


def _block_pairs(members: DataFrame, bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root, block) of all members and the (root, i, j) to verify, from members (node, root, size) and bands (node, band).

    A component of one block is verified whole. In others nodes with an equal first band stand in one block, or in the
    parts of one that would be too large; blocks i and j meet if a band has nodes in both.
    """
    amount = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_GRAMS))).cast("long")
    blocks = members.groupBy("root").agg(amount.alias("blocks"))
    one = stage(join_hot(members, blocks, ["root"]).withColumn("bucket", F.pmod(F.xxhash64("band0"), F.col("blocks"))), "join-buckets")
    parts = one.groupBy("root", "bucket").agg(amount.alias("parts"))
    dealt = join_hot(one, parts, ["root", "bucket"]).withColumn("block", F.when(F.col("blocks") > 1, F.shiftleft("bucket", 20) + F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0)).cast("long"))
    dealt = stage(dealt.select("node", "root", "blocks", "block"), "join-blocks")
    single = dealt.where("blocks = 1").select("root", F.col("block").alias("i"), F.col("block").alias("j")).distinct()
    seen = bands.join(dealt.where("blocks > 1"), "node").select("root", "band", "block").distinct()
    seen = stage(seen, "join-band-blocks")
    more = seen.join(seen.select("root", "band", F.col("block").alias("other")), ["root", "band"]).where("block <= other").select("root", F.col("block").alias("i"), F.col("other").alias("j")).distinct()
    return dealt.select("node", "root", "block"), single.unionByName(more)


def _linked_sets(read: DataFrame, named: DataFrame, sets: DataFrame, mates: DataFrame, edges: DataFrame, similarity: float, n: int) -> DataFrame:
    """``named`` sets with class_id, n_set_links and n_links: candidates are gathered, verified by block pairs and joined to classes."""
    candidates = components(edges, "join-candidates")

    members = stage(candidates.join(sets.select("node", "n_copies", "size", F.element_at("bands", 1).alias("band0"), F.col("rep.id").alias("id"), F.col("rep.h").alias("h")), "node"), "join-members")
    dealt, pairs = _block_pairs(members.select("node", "root", "size", "band0"), mates)
    near = only_listed(read, "h", members.select("h"))  # few texts have candidates; the others aren't shuffled
    texts = near.groupBy("id", "h").agg(F.first("t").alias("t")).join(members.select("id", "h", "node", "n_copies").hint("merge"), ["id", "h"])
    texts = stage(texts.join(dealt, "node").select("node", "root", "block", F.col("n_copies").alias("copies"), "t"), "join-texts")
    left = pairs.join(texts, (pairs["root"] == texts["root"]) & (pairs["i"] == texts["block"])).select(pairs["root"], "i", "j", F.lit(0).alias("side"), "node", "copies", "t")
    right = pairs.where("i < j").join(texts, (pairs["root"] == texts["root"]) & (pairs["j"] == texts["block"])).select(pairs["root"], "i", "j", F.lit(1).alias("side"), "node", "copies", "t")
    found = stage(left.unionByName(right).groupBy("root", "i", "j").applyInArrow(_links(similarity, n), "node long, links long, documents long, root long"), "join-links")

    linked = found.groupBy("node").agg(F.sum("links").alias("n_set_links"), F.sum("documents").alias("linked")).where("n_set_links > 0")
    roots = stage(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "join-classes").join(sets.select("node", F.col("rep.id").alias("set_id")), "node"), "join-roots")
    least = roots.groupBy("root").agg(F.min("set_id").alias("class_id"))
    inside = join_hot(roots, least, ["root"]).select("node", "class_id")
    classes = named.join(linked, "node", "left").join(inside, "node", "left")
    return stage(classes.select("set1", "set2", "set_id", "n_copies", F.coalesce("class_id", "set_id").alias("class_id"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"), (F.coalesce("linked", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")), "join-sets-linked")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL, functions: int = FUNCTIONS) -> DataFrame:
    """Links between the documents whose word n-gram sets have a Jaccard similarity of ``similarity`` or more.

    One row for each row of ``df`` with a non-null id: id, class_id (the smallest id it is linked with, directly or
    through others), set_id (the smallest id with the same n-gram set), n_copies (rows of that set), n_set_links
    (other sets linked with this one) and n_links (other rows linked with this one, copies included).

    Words are runs of letters, digits and underscores, case folded. Texts of fewer than ``n`` words have all their
    words as their only n-gram. Null texts, and texts without a word, have no n-gram and no link: each is a class
    of its own. Repeated rows are copies like any other, with the same ids. Rows of one id with different texts
    are rows of their own, each with the links of its text. Rows with a null id are left out.
    """
    bands, rows = bands_for(similarity, recall, functions)
    read = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    signed = stage(map_arrow(read, _signatures(bands, rows, n), "id long, h long, set1 long, set2 long, size int, bands array<long>"), "join-signatures")
    # The signature is the same for all copies, so any of them will do; partial aggregation merges hot groups before the shuffle.
    same = signed.where("size > 0").groupBy("set1", "set2").agg(F.min(F.struct("id", "h")).alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    sets = stage(same.select(F.monotonically_increasing_id().alias("node"), "set1", "set2", "rep", "n_copies", "size", "bands"), "join-sets")
    mates = stage(sets.select("node", F.explode("bands").alias("band")), "join-bands")
    stars = mates.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("mates")).where("mates > 1")
    edges = stage(join_hot(mates, stars, ["band"]).where("node <> a").select("a", F.col("node").alias("b")).distinct(), "join-candidate-edges")
    named = sets.select("node", "set1", "set2", F.col("rep.id").alias("set_id"), "n_copies")
    if edges.limit(1).count() == 0:
        classes = named.withColumns({"class_id": F.col("set_id"), "n_set_links": F.lit(0).cast("long"), "n_links": F.col("n_copies") - 1})
    else:
        classes = _linked_sets(read, named, sets, mates, edges, similarity, n)

    out = ["id", "class_id", "set_id", "n_copies", "n_set_links", "n_links"]
    found = join_hot(signed.where("size > 0").select("id", "set1", "set2"), classes, ["set1", "set2"])
    none = signed.where("size = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("set_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_set_links"), F.lit(0).cast("long").alias("n_links"))
    return found.select(out).unionByName(none)
