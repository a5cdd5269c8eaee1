"""All registered queries of the library's own operators, with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import grids, names, vectors
from lumenframe.operators import blocked, classify, curves, heads, index, intervals, matching, reports, retrieval, sampling, trajectory, tuning, validate
from lumenframe.operators.staging import folder, stage
from lumenframe.plans import inputs as I
from lumenframe.plans.inputs import CHUNK, MIN_OVERLAP, NEGATIVE
from lumenframe.plans.sql import GRID, match_sql, prf_sql, runs_sql, select

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
VIOLATIONS = [t[0] for t in I.TAXONOMY if t[0] != NEGATIVE]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Classification


@query(select("SELECT item, label, pred, round(score, 6) AS score FROM pred"))
def zs_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return I.predictions(spark, sf).select("item", "label", "pred", vectors.half_up("score", 6).alias("score"))


@query(select("SELECT item, class, round(score, 6) AS score FROM scores"))
def zs_scores_long(spark: SparkSession, sf: str) -> DataFrame:
    return I.scores_long(spark, sf).select("item", "class", vectors.half_up("score", 6).alias("score"))


@query(select("SELECT count(*) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM pred WHERE split = 'val'"))
def zs_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return classify.accuracy(I.predictions(spark, sf).where("split = 'val'"))


@query(select("SELECT a.class AS label, b.class AS pred, count(p.item) AS n FROM classes a CROSS JOIN classes b LEFT JOIN pred p ON p.label = a.class AND p.pred = b.class GROUP BY ALL"))
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return classify.confusion(I.predictions(spark, sf), I.classes(spark, sf))


@query(select("SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support, predicted FROM per_class"))
def per_class_prf(spark: SparkSession, sf: str) -> DataFrame:
    return classify.per_class(classify.confusion(I.predictions(spark, sf), I.classes(spark, sf)))


@query(
    select(
        """SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(p) FILTER (support > 0 OR predicted > 0), 6) AS macro_precision, round(avg(r) FILTER (support > 0 OR predicted > 0), 6) AS macro_recall, round(avg(f) FILTER (support > 0 OR predicted > 0), 6) AS macro_f1,
  round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM per_class"""
    )
)
def macro_weighted_prf(spark: SparkSession, sf: str) -> DataFrame:
    return classify.averages(classify.confusion(I.predictions(spark, sf), I.classes(spark, sf)))


@query(select("SELECT round(avg(CAST(pred = label AS INTEGER)) FILTER (split = 'val'), 6) AS val_accuracy, round(avg(CAST(pred = label AS INTEGER)) FILTER (split = 'train'), 6) AS train_accuracy FROM pred"))
def other_split_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.col("pred") == F.col("label")).cast("double")
    return I.predictions(spark, sf).agg(*(vectors.half_up(F.avg(F.when(F.col("split") == s, hit)), 6).alias(f"{s}_accuracy") for s in ("val", "train")))


@query(select("SELECT vec_id AS item, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS squared, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS u FROM embeddings)"))
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    u = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), vectors.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("item", vectors.half_up(vectors.dot(F.col("u"), F.col("u")), 6).alias("squared"), vectors.half_up(F.element_at("u", 1), 6).alias("first"))


@query(
    select(
        "SELECT p.item, CAST(row_number() OVER (ORDER BY p.item) - 1 AS BIGINT) AS idx, p.label, p.pred, CAST(p.label = p.pred AS INTEGER) AS correct, "
        + ", ".join(f"round(s.s{c}, 6) AS s{c}" for c in range(10))
        + " FROM pred p JOIN (SELECT item, "
        + ", ".join(f"max(score) FILTER (class = {c}) AS s{c}" for c in range(10))
        + " FROM scores GROUP BY item) s USING (item) WHERE p.split = 'val'"
    )
)
def sim_scores(spark: SparkSession, sf: str) -> DataFrame:
    wide = I.scores_long(spark, sf).where("split = 'val'").groupBy("item").pivot("class", list(range(10))).agg(vectors.half_up(F.first("score"), 6))
    pred = I.predictions(spark, sf).where("split = 'val'").select("item", "label", "pred", (F.col("label") == F.col("pred")).cast("int").alias("correct"))
    named = wide.select("item", *(F.col(str(c)).alias(f"s{c}") for c in range(10)))
    return sampling.numbered(pred, "item").join(named, "item")


# Retrieval


@query(select("SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST(rank <= {k} AS INTEGER)), 6) AS r_at_{k}" for k in (1, 3, 5, 10)) + " FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, class) AS rank FROM scores) WHERE class = label"))
def v2t_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.item_recall(I.scores_long(spark, sf))


_RANKED = """r AS (SELECT class, item, label, row_number() OVER (PARTITION BY class ORDER BY score DESC, item) AS rank FROM scores),
m AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY rank) AS m FROM r WHERE class = label),
c AS (SELECT class, min(rank) AS first_rank, avg(m / rank) AS ap FROM m GROUP BY class)"""


@query(select(f"{', '.join(f'round(avg(CAST(first_rank <= {k} AS INTEGER)), 6) AS r_at_{k}' for k in (1, 5, 10))}, round(avg(ap), 6) AS map, median(first_rank) AS median_first_rank FROM c", _RANKED, "SELECT "))
def t2v_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.class_recall(I.scores_long(spark, sf))


@query(select("SELECT item, label, rank, class, round(score, 6) AS score, CAST(class = label AS INTEGER) AS hit FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, class) AS INTEGER) AS rank FROM scores) WHERE rank <= 10"))
def retrieval_log_top10(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.retrieval_log(I.scores_long(spark, sf))


@query("SELECT item, CAST(row_number() OVER (ORDER BY score DESC, item) AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT e.vec_id AS item, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 1 ORDER BY score DESC, item LIMIT 5)")
def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    return retrieval.search(e, e.where("item = 1"), 5).select("item", F.col("rank").cast("int").alias("rank"), vectors.half_up("score", 6).alias("score"))


@query(
    "SELECT item, class AS pred, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, class) AS r FROM ("
    "SELECT i.vec_id AS item, p.vec_id AS class, list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM embeddings i, embeddings p WHERE i.vec_id % 2 = 1 AND p.vec_id % 2 = 0)) WHERE r = 1"
)
def zs_many_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt for every other row of the table: as many prompts as items."""
    e = I.table(spark, sf, "embeddings")
    items = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("item"), "embedding")
    best = blocked.top_prompts(items, e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("class"), "embedding"))
    return best.select("item", F.col("class").alias("pred"), vectors.half_up("score", 6).alias("score"))


@query(
    "SELECT query, CAST(r AS INTEGER) AS rank, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS r FROM ("
    "SELECT q.vec_id AS query, e.vec_id AS item, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 25 = 0)) WHERE r <= 5"
)
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all vectors, and the five nearest rows of every 25th."""
    e = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    index.build(e, path)
    found, _ = index.search_many(spark, path, e.where("item % 25 = 0").withColumnRenamed("item", "query"), 5)
    return found.withColumn("score", vectors.half_up("score", 6))


# Splits and samples


@query("SELECT doc_id, lang, CASE WHEN rank <= greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.fraction_split(I.table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.2, 3)


_FIXED = "(SELECT vec_id AS item, label, CASE WHEN rank <= 22 THEN 'train' WHEN rank <= 24 THEN 'val' ELSE 'test' END AS split, rank AS position FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS rank FROM embeddings) WHERE rank <= 30)"


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.count_split(I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "label"), "label", "item", {"train": 22, "val": 2, "test": 6})


@query(f"SELECT item, label, split, position, printf('%d_%04d', label, position) AS video_id FROM {_FIXED}")
def fixed_count_split(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).select("item", "label", "split", "position", names.numbered_id(F.col("label").cast("string"), F.col("position")).alias("video_id"))


@query(f"SELECT bool_and(tr AND va AND te) AS ok FROM (SELECT label, count(*) FILTER (split = 'train') = 22 AS tr, count(*) FILTER (split = 'val') = 2 AS va, count(*) FILTER (split = 'test') = 6 AS te FROM {_FIXED} GROUP BY label)")
def split_gate(spark: SparkSession, sf: str) -> DataFrame:
    return validate.counts_hold(_fixed(spark, sf), "label", {"train": 22, "val": 2, "test": 6})


@query(select("SELECT label, count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM items GROUP BY label"))
def split_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_stats(I.items(spark, sf), "label")


def _chunks(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """Tumbling windows with labels: chunk_id, video, split, start_sec, end_sec, labels."""
    days = known if known is not None else I.days(spark, sf)
    tiles = I.durations(spark, sf, days).select("video", F.explode(grids.tumbling_starts(F.col("duration"), CHUNK)).alias("start_sec"))
    labelled = intervals.overlap_labels(tiles, I.annotations(spark, sf, days).where(F.col("class") != NEGATIVE), CHUNK, MIN_OVERLAP, NEGATIVE)
    split = F.when(F.pmod(F.col("video"), F.lit(5)) == 0, "val").otherwise("train")
    return labelled.select(names.chunk_id(F.col("video"), F.col("start_sec")).alias("chunk_id"), "video", split.alias("split"), "start_sec", (F.col("start_sec") + CHUNK).alias("end_sec"), "labels")


@query(
    select(
        f"""SELECT chunk_id, video, split, array_to_string(labels, ';') AS labels FROM (
  SELECT *, row_number() OVER (PARTITION BY video, split, neg ORDER BY md5('42:' || chunk_id), chunk_id) AS rank, floor(4.0 * greatest(sum(1 - neg) OVER (PARTITION BY video, split), 1)) AS keep
  FROM (SELECT *, CAST(list_contains(labels, '{NEGATIVE}') AS INTEGER) AS neg FROM chunks)) WHERE split <> 'train' OR neg = 0 OR rank <= keep""",
        GRID,
    )
)
def neg_downsample(spark: SparkSession, sf: str) -> DataFrame:
    c = stage(_chunks(spark, sf), "chunks")
    kept = sampling.downsample_negatives(c, ~F.array_contains("labels", NEGATIVE), "video", "chunk_id")
    return kept.select("chunk_id", "video", "split", F.array_join("labels", ";").alias("labels"))


def _greedy_sql() -> str:
    """The sequential rule: a row after the other, with the splits' sizes and classes so far."""
    names, shares = ("train", "val", "test"), (0.72, 0.08, 0.2)
    lacks = ", ".join(f"len(list_filter(o.classes, lambda c: NOT list_contains(h{i}, c))) AS l{i}, {f}::DOUBLE * o.total - s{i} AS r{i}" for i, f in enumerate(shares))
    better = lambda i, j: f"(l{i} > l{j} OR l{i} = l{j} AND r{i} >= r{j})"
    pick = f"CASE WHEN {better(0, 1)} AND {better(0, 2)} THEN 0 WHEN {better(1, 2)} THEN 1 ELSE 2 END"
    state = ", ".join(f"s{i} + CAST(pick = {i} AS INTEGER) AS s{i}, CASE WHEN pick = {i} THEN list_distinct(list_concat(h{i}, classes)) ELSE h{i} END AS h{i}" for i in range(3))
    return f"""cl AS (SELECT DISTINCT video, class FROM annotations),
fr AS (SELECT class, count(*) AS k FROM cl GROUP BY class),
ov AS (SELECT video, list(class) AS classes, min(k) AS rare FROM cl JOIN fr USING (class) GROUP BY video),
o AS (SELECT *, row_number() OVER (ORDER BY rare, md5('42:' || video), video) AS place, count(*) OVER () AS total FROM ov),
g AS (SELECT 0::BIGINT AS place, NULL::BIGINT AS video, -1 AS pick, {", ".join(f"0 AS s{i}, []::VARCHAR[] AS h{i}" for i in range(3))}
  UNION ALL SELECT place, video, pick, {state} FROM (SELECT *, {pick} AS pick FROM (SELECT o.place, o.video, o.classes, s0, s1, s2, h0, h1, h2, {lacks} FROM g JOIN o ON o.place = g.place + 1)))
SELECT video, [{", ".join(f"'{n}'" for n in names)}][pick + 1] AS split FROM g WHERE place > 0"""


@query(select(_greedy_sql().rsplit("\n", 1)[1], _greedy_sql().rsplit("\n", 1)[0]))
def greedy_video_split(spark: SparkSession, sf: str) -> DataFrame:
    videos = stage(I.annotations(spark, sf).groupBy("video").agg(F.array_sort(F.collect_set("class")).alias("classes")), "videos")
    return sampling.greedy_split(videos, {"train": 0.72, "val": 0.08, "test": 0.2})


# Windows and intervals


@query(select("SELECT video, start_sec, start_sec + 2.0 AS end_sec, chunk_id FROM chunks", GRID))
def chunk_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("video", "start_sec", "end_sec", "chunk_id")


def _sliding(spark: SparkSession, sf: str) -> DataFrame:
    return I.durations(spark, sf).select("video", F.explode(grids.sliding_starts(F.col("duration"), CHUNK, 1.0)).alias("start_sec"))


@query(select("SELECT video, start_sec FROM sliding", GRID))
def sliding_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _sliding(spark, sf)


@query(select("SELECT video, start_sec, array_to_string(labels, ';') AS labels FROM chunks", GRID))
def overlap_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("video", "start_sec", F.array_join("labels", ";").alias("labels"))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and labels of the dense grid: video, class, start_sec, score, y; the negative class has no events."""
    days = I.days(spark, sf)
    return intervals.label_matrix(I.trajectories(spark, sf, days), I.annotations(spark, sf, days).where(F.col("class") != NEGATIVE), CHUNK, MIN_OVERLAP)


@query(select("SELECT video, class, start_sec, round(score, 6) AS score, y FROM matrix", GRID))
def label_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf).withColumn("score", vectors.half_up("score", 6))


@query(select(f"SELECT video, start_sec, '{NEGATIVE}' AS class, 1 - max(y) AS y FROM matrix WHERE class <> '{NEGATIVE}' GROUP BY ALL", GRID))
def complement_label(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.complement_label(_matrix(spark, sf), NEGATIVE)


@query(select("SELECT video, class, start_sec, end_sec FROM annotations a WHERE NOT EXISTS (FROM chunks w WHERE w.video = a.video AND least(w.start_sec + 2.0, a.end_sec) - greatest(w.start_sec, a.start_sec) >= 1.5)", GRID))
def uncovered_events(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    return intervals.uncovered_events(_chunks(spark, sf, days), I.annotations(spark, sf, days), CHUNK, 1.5)


@query(select("SELECT DISTINCT video FROM annotations WHERE video NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"))
def missing_videos(spark: SparkSession, sf: str) -> DataFrame:
    known = I.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("video"))
    return validate.missing(I.annotations(spark, sf), known, ["video"])


@query(
    select(
        f"""SELECT chunk_id, video, split, start_sec, start_sec + 2.0 AS end_sec, array_to_string(labels, ';') AS labels FROM (
  SELECT m.video, split, m.start_sec, printf('%d_%07d', m.video, CAST(round_even(m.start_sec * 1000, 0) AS BIGINT)) AS chunk_id, list_sort(list(DISTINCT a.class)) AS labels
  FROM (SELECT chunk_id AS source, video, split, start_sec + d AS start_sec FROM chunks, (VALUES (-0.5::DOUBLE), (0.5::DOUBLE)) t(d) WHERE split = 'train' AND NOT list_contains(labels, '{NEGATIVE}')) m
  JOIN durations u ON u.video = m.video AND m.start_sec >= 0 AND m.start_sec + 2.0 <= u.duration
  JOIN annotations a ON a.video = m.video AND a.class <> '{NEGATIVE}' AND least(m.start_sec + 2.0, a.end_sec) - greatest(m.start_sec, a.start_sec) >= 0.5 GROUP BY source, m.video, split, m.start_sec)""",
        GRID,
    )
)
def jitter_augment(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    out = intervals.jitter(_chunks(spark, sf, days), _truth(spark, sf, days), I.durations(spark, sf, days), 0.5, CHUNK, MIN_OVERLAP, NEGATIVE)
    return out.select("chunk_id", "video", "split", "start_sec", "end_sec", F.array_join("labels", ";").alias("labels"))


@query(select("SELECT chunk_id || '#' || label AS key, chunk_id, label FROM (SELECT chunk_id, unnest(labels) AS label FROM chunks)", GRID))
def multilabel_explode(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.explode_labels(_chunks(spark, sf))


@query(
    "SELECT video, class, floor(e - d) AS start_sec, ceil(e) AS end_sec FROM (SELECT user_id AS video, event_type AS class, d, sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS e"
    f" FROM (SELECT *, floor(value) / 4 + 1 AS d FROM events)) WHERE class <> '{NEGATIVE}'"
)
def lesson_intervals(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events")
    cls = F.when(F.col("event_type") != NEGATIVE, F.col("event_type"))
    return intervals.from_durations(e.select(F.col("user_id").alias("video"), F.col("event_id").alias("pos"), cls.alias("class"), (F.floor("value") / 4 + 1).alias("duration")))


# Trajectories


@query(select("SELECT video, class, start_sec, round(median(score) OVER (PARTITION BY video, class ORDER BY start_sec ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS score FROM trajectories"))
def median_filter(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.smooth(I.trajectories(spark, sf), 3).withColumn("score", vectors.half_up("score", 6))


@query(select(f"SELECT video, class, start_sec, score FROM trajectories WHERE class <> '{NEGATIVE}'"))
def concatenated_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Wide tables of two halves of the videos, as two scorers leave them, put together."""
    long = stage(I.trajectories(spark, sf), "trajectories")
    halves = [trajectory.wide(long.where(F.pmod("video", F.lit(2)) == i), VIOLATIONS, "score") for i in (0, 1)]
    return trajectory.concatenated(halves, VIOLATIONS)


_EVENT = "SELECT video, class, start_sec, end_sec, round(peak, 6) AS peak, round(mean, 6) AS mean, n_windows FROM "


@query(select(_EVENT + "isolated"))
def events_isolated(spark: SparkSession, sf: str) -> DataFrame:
    return I.events(spark, sf, "isolated")


@query(select(_EVENT + "glue"))
def events_glue(spark: SparkSession, sf: str) -> DataFrame:
    return I.events(spark, sf, "glue")


@query(select("SELECT video, start_sec, " + ", ".join(f"max(CAST(score >= threshold AS INTEGER)) FILTER (class = '{c}') AS {c}" for c in VIOLATIONS) + " FROM trajectories JOIN taxonomy USING (class) GROUP BY ALL"))
def flags_wide(spark: SparkSession, sf: str) -> DataFrame:
    long = trajectory.flags(I.trajectories(spark, sf).where(F.col("class") != NEGATIVE), I.thresholds(spark))
    return trajectory.wide(long, VIOLATIONS, "flag")


#: The band of scores that counts as unknown, for trajectories.
_BAND = (0.2, 0.6)


def _unknown(spark: SparkSession, sf: str) -> DataFrame:
    bands = I.taxonomy(spark).select("class", F.lit(_BAND[0]).alias("t_lo"), F.lit(_BAND[1]).alias("t_hi"))
    return trajectory.unknown_flags(I.trajectories(spark, sf), bands)


_UNKNOWN = runs_sql("unknown", "trajectories", f"score >= {_BAND[0]} AND score < {_BAND[1]}")


@query(select("SELECT video, class, start_sec, end_sec, n_windows FROM unknown", _UNKNOWN))
def unknown_runs(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.runs(_unknown(spark, sf), F.col("unknown") == 1, chunk=CHUNK).select("video", "class", "start_sec", "end_sec", "n_windows")


@query(select(f"SELECT *, row_number() OVER (ORDER BY peak_p DESC, video, class, start_sec) AS rank FROM (SELECT video, class, start_sec, end_sec, round(peak, 6) AS peak_p FROM unknown WHERE n_windows >= 2 AND class <> '{NEGATIVE}')", _UNKNOWN))
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.review_queue(_unknown(spark, sf), NEGATIVE, 2, CHUNK)


@query(select(f"SELECT class, round(avg(u), 4) AS unknown_rate, CAST(avg(u) > 0.2 AS INTEGER) AS warn FROM (SELECT class, CAST(score >= {_BAND[0]} AND score < {_BAND[1]} AS INTEGER) AS u FROM trajectories) GROUP BY class"))
def unknown_rate(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.unknown_rate(_unknown(spark, sf))


# Events against annotations


def _truth(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    return I.annotations(spark, sf, known).where(F.col("class") != NEGATIVE)


_MATCH = match_sql("matches", "glue", f"(SELECT * FROM annotations WHERE class <> '{NEGATIVE}')", ["video", "class"])


@query(select("SELECT video, class, tp, fp, fn FROM matches", _MATCH))
def event_match(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    return matching.match_events(I.events(spark, sf, "glue", days), _truth(spark, sf, days))


@query(select(f"SELECT coalesce(class, 'micro') AS class, tp, fp, fn, {prf_sql()} FROM (SELECT class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM matches GROUP BY ROLLUP (class))", _MATCH))
def event_prf(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    return matching.event_scores(matching.match_events(I.events(spark, sf, "glue", days), _truth(spark, sf, days)))


_CURVE = GRID + """, g AS (SELECT class, score AS threshold, sum(y) AS hits, count(*) AS k FROM matrix GROUP BY ALL),
curve AS (SELECT class, threshold, hits, CAST(sum(hits) OVER w AS BIGINT) AS tp, CAST(sum(k) OVER w AS BIGINT) AS n, CAST(sum(hits) OVER (PARTITION BY class) AS BIGINT) AS npos FROM g WINDOW w AS (PARTITION BY class ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, tp / n AS p, CASE WHEN npos > 0 THEN tp / npos END AS r FROM curve)"""


@query(select("SELECT class, round(threshold, 6) AS threshold, tp, n, round(p, 6) AS precision, round(r, 6) AS recall FROM c", _CURVE))
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curves.pr_curve(_matrix(spark, sf)).select("class", vectors.half_up("threshold", 6).alias("threshold"), "tp", "n", vectors.half_up("precision", 6).alias("precision"), vectors.half_up("recall", 6).alias("recall"))


@query(select("SELECT class, max(npos) AS support, CASE WHEN max(npos) > 0 THEN round(sum(hits / npos * p), 4) END AS ap FROM c GROUP BY class", _CURVE))
def chunk_ap(spark: SparkSession, sf: str) -> DataFrame:
    return curves.average_precision(curves.pr_curve(_matrix(spark, sf)))


@query(select("SELECT round(avg(ap), 4) AS map FROM (SELECT CASE WHEN max(npos) > 0 THEN round(sum(hits / npos * p), 4) END AS ap FROM c GROUP BY class)", _CURVE))
def chunk_map(spark: SparkSession, sf: str) -> DataFrame:
    return curves.mean_ap(curves.average_precision(curves.pr_curve(_matrix(spark, sf))))


@query(select("SELECT class, CASE WHEN max(npos) > 0 THEN round(coalesce(max(p) FILTER (r >= 0.9), 0), 4) END AS precision_at_recall FROM c GROUP BY class", _CURVE))
def precision_at_recall(spark: SparkSession, sf: str) -> DataFrame:
    return curves.precision_at_recall(curves.pr_curve(_matrix(spark, sf)), 0.9)


@query(select("SELECT class, round(lo, 6) AS t_lo, round(hi, 6) AS t_hi, CAST(lo >= hi AS INTEGER) AS crossed FROM (SELECT class, coalesce(max(threshold) FILTER (r >= 0.95), 0.0) AS lo, coalesce(min(threshold) FILTER (p >= 0.9), 1.0) AS hi FROM c GROUP BY class)", _CURVE))
def unknown_band(spark: SparkSession, sf: str) -> DataFrame:
    return curves.unknown_band(curves.pr_curve(_matrix(spark, sf))).select("class", vectors.half_up("t_lo", 6).alias("t_lo"), vectors.half_up("t_hi", 6).alias("t_hi"), "crossed")


@query(select(f"SELECT a.class AS i, b.class AS j, CAST(sum(a.y * CAST(b.score >= coalesce(t.threshold, 0.25) AS INTEGER)) AS BIGINT) AS n FROM matrix a JOIN matrix b ON a.video = b.video AND a.start_sec = b.start_sec LEFT JOIN taxonomy t ON t.class = b.class WHERE a.class <> '{NEGATIVE}' AND b.class <> '{NEGATIVE}' GROUP BY ALL", GRID))
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return curves.cooccurrence(_matrix(spark, sf).where(F.col("class") != NEGATIVE), I.thresholds(spark))


_THR, _WIN, _K = [0.2, 0.35, 0.5, 0.65, 0.8], [1, 3], [1, 2]


def _tune_sql(_THR: list[float] = _THR, _WIN: list[int] = _WIN, _K: list[int] = _K) -> str:  # noqa: N803
    smooth = " UNION ALL ".join(f"SELECT video, class, {i} AS wi, start_sec, " + ("score" if w <= 1 else f"round(median(score) OVER (PARTITION BY video, class ORDER BY start_sec ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING), 9)") + " AS score FROM trajectories" for i, w in enumerate(_WIN))
    thr = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(_THR))
    ks = ", ".join(f"({i}, {k})" for i, k in enumerate(_K))
    keys = ["video", "class", "wi", "ti", "ki"]
    return ", ".join(
        [
            f"sm AS (SELECT * FROM ({smooth}) WHERE class <> '{NEGATIVE}')",
            f"fl AS (SELECT sm.*, ti, t FROM sm, (VALUES {thr}) x(ti, t))",
            runs_sql("rn", "fl", "score >= t", ["video", "class", "wi", "ti"]),
            f"ks AS (SELECT * FROM (VALUES {ks}) x(ki, k))",
            "pr AS (SELECT rn.*, ki FROM rn JOIN ks ON n_windows >= k)",
            f"cf AS (SELECT wi, ti, ki FROM (SELECT unnest(range({len(_WIN)})) AS wi), (SELECT unnest(range({len(_THR)})) AS ti), ks)",
            f"tr AS (SELECT a.*, wi, ti, ki FROM annotations a, cf WHERE class <> '{NEGATIVE}')",
            match_sql("ma", "pr", "tr", keys),
            "su AS (SELECT class, wi, ti, ki, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ma GROUP BY ALL)",
            f"fu AS (SELECT s.class, cf.wi, cf.ti, cf.ki, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT DISTINCT class FROM sm) s CROSS JOIN cf LEFT JOIN su ON su.class = s.class AND su.wi = cf.wi AND su.ti = cf.ti AND su.ki = cf.ki)",
            f"sc AS (SELECT *, {prf_sql()} FROM fu)",
            "be AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, wi, ti, ki) AS r FROM sc)",
        ]
    )


@query(select(f"SELECT class, {_THR}[ti + 1]::DOUBLE AS threshold, {_WIN}[wi + 1] AS \"window\", {_K}[ki + 1] AS min_consec, f1 AS val_f1, CAST(tp AS BIGINT) AS val_tp, CAST(fp AS BIGINT) AS val_fp, CAST(fn AS BIGINT) AS val_fn FROM be WHERE r = 1", _tune_sql()))
def tune_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    return tuning.tune(I.trajectories(spark, sf, days).where(F.col("class") != NEGATIVE), _truth(spark, sf, days), _THR, _WIN, _K, chunk=CHUNK)


#: The whole grid, 492 combinations a class. It has no SQL: that of ``tune_thresholds`` is for its 20 combinations.
FULL_THR, FULL_WIN, FULL_K = grids.parse_grid("0.10:0.50:0.01"), grids.parse_list("1,3,5,9"), grids.parse_list("1,2,3")


@query()
def tune_thresholds_full(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    return tuning.tune(I.trajectories(spark, sf, days).where(F.col("class") != NEGATIVE), _truth(spark, sf, days), FULL_THR, FULL_WIN, FULL_K, chunk=CHUNK)


# Heads and reports


_HEADS = "hs AS (SELECT item, label, class, 1 / (1 + exp(-(10 * score - 5))) AS p FROM scores)"


@query(select("SELECT item, label, class, round(p, 6) AS score FROM hs", _HEADS))
def head_score(spark: SparkSession, sf: str) -> DataFrame:
    return heads.apply_heads(I.items(spark, sf).drop("split"), I.heads(spark, sf)).withColumn("score", vectors.half_up("score", 6))


@query(select("SELECT item, class, CASE WHEN p >= 0.6 THEN 'positive' WHEN p >= 0.2 THEN 'unknown' ELSE 'negative' END AS decision FROM hs", _HEADS))
def head_decision(spark: SparkSession, sf: str) -> DataFrame:
    scored = heads.apply_heads(I.items(spark, sf).drop("split"), I.heads(spark, sf))
    return trajectory.unknown_flags(scored, I.heads(spark, sf)).select("item", "class", "decision")


@query(
    select(
        "SELECT b.metric, b.v AS base, t.v AS tuned, round(t.v - b.v, 6) AS delta, CAST(abs(round(t.v - b.v, 6)) > 0.01 AS INTEGER) AS differs FROM (UNPIVOT (SELECT n, r1 FROM x WHERE split = 'train') ON n, r1 INTO NAME metric VALUE v) b JOIN (UNPIVOT (SELECT n, r1 FROM x WHERE split = 'val') ON n, r1 INTO NAME metric VALUE v) t USING (metric)",
        "x AS (SELECT split, CAST(count(*) AS DOUBLE) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS r1 FROM pred GROUP BY split)",
    )
)
def phase_compare(spark: SparkSession, sf: str) -> DataFrame:
    p = I.predictions(spark, sf)
    part = lambda s: reports.long_metrics(classify.accuracy(p.where(F.col("split") == s)).withColumnRenamed("accuracy", "r1"), s)
    return reports.compare(part("train"), part("val"))


@query(
    select(
        "SELECT mode, max(f1) FILTER (phase = 'loose') AS loose, max(f1) FILTER (phase = 'strict') AS strict FROM ("
        + " UNION ALL ".join(f"SELECT '{p}' AS phase, '{m}' AS mode, f1 FROM (SELECT {prf_sql()} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m_{p}_{m}))" for p in ("loose", "strict") for m in ("isolated", "glue"))
        + ") GROUP BY mode",
        ", ".join(match_sql(f"m_{p}_{m}", m, f"(SELECT * FROM annotations WHERE class <> '{NEGATIVE}')", ["video", "class"], t) for p, t in (("loose", 0.3), ("strict", 0.6)) for m in ("isolated", "glue")),
    )
)
def run_matrix_2x2(spark: SparkSession, sf: str) -> DataFrame:
    rows, days = None, I.days(spark, sf)
    found = {mode: stage(I.events(spark, sf, mode, days), "events") for mode in ("isolated", "glue")}
    truth = stage(_truth(spark, sf, days), "truth")
    for phase, iou in (("loose", 0.3), ("strict", 0.6)):
        for mode in ("isolated", "glue"):
            m = matching.event_scores(matching.match_events(found[mode], truth, iou)).where("class = 'micro'")
            row = m.select(F.lit(phase).alias("phase"), F.lit(mode).alias("mode"), "f1")
            rows = row if rows is None else rows.unionByName(row)
    return reports.run_matrix(rows, ["loose", "strict"])


@query("SELECT count(DISTINCT source) AS n_encoders, CAST(count(DISTINCT source) = 1 AS INTEGER) AS ok FROM documents")
def encoder_lineage_check(spark: SparkSession, sf: str) -> DataFrame:
    return validate.same_encoder(I.table(spark, sf, "documents").select(F.col("source").alias("encoder")))


@query("SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1")
def ambiguous_captions(spark: SparkSession, sf: str) -> DataFrame:
    return validate.ambiguous(I.table(spark, sf, "documents"), "lang", "source")


@query(select(f"SELECT split, count(DISTINCT video) AS videos, count(*) AS chunks, count(*) FILTER (NOT list_contains(labels, '{NEGATIVE}')) AS positives FROM chunks GROUP BY split", GRID))
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy("split").agg(F.count_distinct("video").alias("videos"), F.count(F.lit(1)).alias("chunks"), F.count_if(~F.array_contains("labels", NEGATIVE)).alias("positives"))


@query(
    select(
        """SELECT v.video, coalesce(events, '{}') AS events FROM (SELECT DISTINCT video FROM durations) v LEFT JOIN (
  SELECT video, '{' || string_agg('"' || class || '":[' || e || ']', ',' ORDER BY class) || '}' AS events FROM (
    SELECT video, class, string_agg('{"start_sec":' || start_sec || ',"end_sec":' || end_sec || ',"peak":' || round(peak, 6) || ',"mean":' || round(mean, 6) || ',"n_windows":' || n_windows || '}', ',' ORDER BY start_sec) AS e
    FROM glue GROUP BY ALL) GROUP BY video) USING (video)"""
    )
)
def events_json(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    return reports.events_document(I.events(spark, sf, "glue", days), I.durations(spark, sf, days))


@query()
def linear_probe(spark: SparkSession, sf: str) -> DataFrame:
    weights, c = heads.linear_probe(I.items(spark, sf).where("split = 'train'").drop("split"))
    return weights.select("class", vectors.half_up("b", 6).alias("b"), F.size("w").alias("dim"), F.lit(c).alias("best_c"))


@query()
def train_heads(spark: SparkSession, sf: str) -> DataFrame:
    items = I.items(spark, sf).withColumn("labels", F.array("label"))
    labels = sorted(r["label"] for r in items.select("label").distinct().collect())  # a row for each class
    out = heads.train_heads(items.where("split = 'train'"), items.where("split = 'val'"), labels)
    return out.select("class", F.size("w").alias("dim"), vectors.half_up("b", 6).alias("b"), vectors.half_up("t_lo", 6).alias("t_lo"), vectors.half_up("t_hi", 6).alias("t_hi"), "c_reg")




@query(select("SELECT c.class, count(*) FILTER (split = 'train' AND label = c.class) AS train_pos, count(*) FILTER (split = 'val' AND label = c.class) AS val_pos, CAST(count(*) FILTER (split = 'train' AND label = c.class) < 50 AS INTEGER) AS warn FROM classes c CROSS JOIN items GROUP BY c.class"))
def head_positives(spark: SparkSession, sf: str) -> DataFrame:
    return heads.positives(I.items(spark, sf).withColumn("labels", F.array("label")), I.classes(spark, sf), 50)


_ORIGIN = GRID + f""", tr AS (SELECT *, CAST(list_contains(labels, '{NEGATIVE}') AS INTEGER) AS neg FROM chunks WHERE split = 'train'),
rk AS (SELECT *, row_number() OVER (PARTITION BY video, neg ORDER BY md5('42:' || chunk_id), chunk_id) AS rank, floor(4.0 * greatest(sum(1 - neg) OVER (PARTITION BY video), 1)) AS keep FROM tr),
kept AS (SELECT chunk_id, video, 0 AS jitter, CASE WHEN neg = 1 THEN 'negative' ELSE 'positive' END AS origin FROM rk WHERE neg = 0 OR rank <= keep),
mv AS (SELECT m.video, m.start_sec, printf('%d_%07d', m.video, CAST(round_even(m.start_sec * 1000, 0) AS BIGINT)) AS chunk_id
  FROM (SELECT video, start_sec + d AS start_sec FROM tr, (VALUES (-0.5::DOUBLE), (0.5::DOUBLE)) t(d) WHERE neg = 0) m JOIN durations u ON u.video = m.video AND m.start_sec >= 0 AND m.start_sec + 2.0 <= u.duration
  WHERE EXISTS (FROM annotations a WHERE a.video = m.video AND a.class <> '{NEGATIVE}' AND least(m.start_sec + 2.0, a.end_sec) - greatest(m.start_sec, a.start_sec) >= 0.5))"""


@query(select("SELECT * FROM kept UNION ALL SELECT chunk_id, video, 1 AS jitter, 'jitter' AS origin FROM mv", _ORIGIN))
def training_set(spark: SparkSession, sf: str) -> DataFrame:
    days = I.days(spark, sf)
    c = stage(_chunks(spark, sf, days).where("split = 'train'"), "chunks")
    moved = intervals.jitter(c, _truth(spark, sf, days), I.durations(spark, sf, days), 0.5, CHUNK, MIN_OVERLAP, NEGATIVE)
    return sampling.training_set(c, ~F.array_contains("labels", NEGATIVE), moved, "video", "chunk_id").select("chunk_id", "video", "jitter", "origin")


@query(select("SELECT chunk_id, CASE WHEN split = 'val' THEN 'held' ELSE 'fit' END AS split FROM chunks WHERE split IN ('val', 'train')", GRID))
def joined_splits(spark: SparkSession, sf: str) -> DataFrame:
    c = stage(_chunks(spark, sf).select("chunk_id", "split"), "chunks")
    return sampling.joined_splits(c, ("val",), "held").unionByName(sampling.joined_splits(c, ("train", "test"), "fit"))


@query(select("SELECT item, label, caption FROM items LEFT JOIN (SELECT CAST(i - 1 AS INTEGER) AS label, c AS caption FROM (SELECT generate_subscripts(l, 1) AS i, unnest(l) AS c FROM (SELECT ['zero', 'one', 'two', 'three', 'four'] AS l))) USING (label)"))
def caption_lookup(spark: SparkSession, sf: str) -> DataFrame:
    captions = spark.createDataFrame(list(enumerate(("zero", "one", "two", "three", "four"))), "label int, caption string")
    return classify.with_captions(I.items(spark, sf).select("item", "label"), captions)


#: A fixed probe that never saw the last two classes: ten times the prompts, without a bias.
_PROBE = """lg AS (SELECT item, label, split, class, CASE WHEN class < 8 THEN 10 * score ELSE 0.0 END AS z FROM scores),
pp AS (SELECT item, label, class AS pred FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY z DESC, class) AS r FROM lg WHERE split = 'val') WHERE r = 1),
ev AS (SELECT 'probe' AS name, label, pred FROM pp UNION ALL SELECT 'zeroshot', label, pred FROM pred WHERE split = 'val'),
ct AS (SELECT n.name, c.class, (SELECT count(*) FROM ev WHERE ev.name = n.name AND label = c.class) AS support, (SELECT count(*) FROM ev WHERE ev.name = n.name AND ev.pred = c.class) AS predicted, (SELECT count(*) FROM ev WHERE ev.name = n.name AND ev.pred = c.class AND label = c.class) AS tp FROM classes c, (SELECT DISTINCT name FROM ev) n),
sm AS (SELECT name, round(sum(tp) / sum(support), 6) AS a, round(avg(CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END) FILTER (support > 0 OR predicted > 0), 6) AS f FROM ct GROUP BY name)"""


@query(select("SELECT p.a AS probe_accuracy, p.f AS probe_macro_f1, z.a AS zeroshot_accuracy, z.f AS zeroshot_macro_f1, round(p.a - z.a, 6) AS accuracy_lift, round(p.f - z.f, 6) AS macro_f1_lift FROM sm p, sm z WHERE p.name = 'probe' AND z.name = 'zeroshot'", _PROBE))
def probe_lift(spark: SparkSession, sf: str) -> DataFrame:
    seen = I.prompts(spark, sf).where("class < 8").select("class", F.transform("embedding", lambda x: x * 10).alias("w"), F.lit(0.0).alias("b"))
    val = I.items(spark, sf).where("split = 'val'")
    probe = heads.probe_predictions(val, heads.by_class_index(seen, 10, 64))
    return reports.lift(probe, I.predictions(spark, sf).where("split = 'val'"), I.classes(spark, sf))


@query(
    "SELECT event_id, unnest(['event.k', 'meta.deep.user', 'meta.value']) AS key, unnest([json_extract(props, '$.k')::DOUBLE, user_id::DOUBLE, value::DOUBLE]) AS value FROM events"
)
def flatten_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of a nested document for each event, whose text and empty list are left out."""
    deep = F.struct(F.col("user_id").alias("User"), F.col("event_type").alias("type"))
    rest = F.to_json(F.struct(F.col("value").alias("Value"), deep.alias("Deep"), F.array().cast("array<int>").alias("tags")))
    document = F.concat(F.lit('{"Event":'), F.col("props"), F.lit(',"Meta":'), rest, F.lit("}"))
    flat = I.table(spark, sf, "events").select("event_id", reports.flatten_json(document).alias("flat"))
    # The outer form, since for the inner one Spark would add a filter on the map's size, and flatten each document for that too.
    return flat.select("event_id", F.explode_outer("flat").alias("key", "value")).where("key IS NOT NULL")
