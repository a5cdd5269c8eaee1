"""The test tables as the abstractions that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import classify, sampling, trajectory
from lumenframe.operators.staging import stage

#: (class, caption, kind, window, threshold, min_consec); the first class is the negative one.
TAXONOMY = [("view", "a page is viewed", "state", 3, 0.5, 2), ("click", "a link is clicked", "action", 3, 0.3, 2), ("error", "an error is shown", "action", 1, 0.5, 1), ("purchase", "goods are bought", "state", 3, 0.4, 2), ("signup", "an account is made", "action", 4, 0.35, 1)]
NEGATIVE = "view"
CHUNK, MIN_OVERLAP, SEED = 2.0, 0.5, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "class string, caption string, kind string, window int, threshold double, min_consec int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, label, embedding, split: a fifth of each label is val."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").select(F.col("vec_id").alias("item"), "label", "embedding")
    return sampling.fraction_split(e, "label", "item", 0.2, SEED)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prototype vectors of the train split."""
    return classify.class_prototypes(items(spark, sf_dir).where("split = 'train'"))


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against prompts: item, label, split, class, score."""
    return classify.scores(items(spark, sf_dir), prompts(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.zero_shot(items(spark, sf_dir), prompts(spark, sf_dir))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("label").alias("class")).distinct()


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value of each user, type and day: video, class, day, value, a staged table. Days count from the table's first."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL")
    origin = F.broadcast(e.agg(F.to_date(F.min("ts")).alias("origin")))  # one row
    day = F.datediff(F.to_date("ts"), F.col("origin"))
    return stage(e.join(origin).groupBy(F.col("user_id").alias("video"), F.col("event_type").alias("class"), day.alias("day")).agg(F.max("value").alias("value")), "days")


def trajectories(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Dense daily scores of each user and type: video, class, start_sec, score. ``known`` are the ``days``, if they are at hand."""
    d = known if known is not None else days(spark, sf_dir)
    last = d.agg(F.max("day").alias("last"), F.array_sort(F.collect_set("class")).alias("classes")).first()  # one row of few classes
    grid = d.select("video").distinct().select("video", F.explode(F.array(*map(F.lit, last["classes"] or [])).cast("array<string>")).alias("class"))
    grid = grid.select("video", "class", F.explode(F.sequence(F.lit(0), F.lit(last["last"] or 0))).alias("day"))
    return grid.join(d, ["video", "class", "day"], "left").select("video", "class", F.col("day").cast("double").alias("start_sec"), (F.coalesce("value", F.lit(0.0)) / 100).alias("score"))


def annotations(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Runs of active days as intervals: video, class, start_sec, end_sec, pos."""
    from pyspark.sql import Window

    d = known if known is not None else days(spark, sf_dir)
    active = d.select("video", "class", F.col("day").cast("double").alias("start_sec"))
    w = Window.partitionBy("video", "class").orderBy("start_sec")
    islands = active.withColumn("_run", F.col("start_sec") - F.row_number().over(w)).groupBy("video", "class", "_run").agg(F.min("start_sec").alias("start_sec"), (F.max("start_sec") + 1).alias("end_sec"))
    return islands.drop("_run").withColumn("pos", F.row_number().over(w))


def durations(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    d = known if known is not None else days(spark, sf_dir)
    return d.groupBy("video").agg((F.max("day") + 1).cast("double").alias("duration"))


def thresholds(spark: SparkSession) -> DataFrame:
    return taxonomy(spark).select("class", "threshold", "window", "min_consec")


def events(spark: SparkSession, sf_dir: str, mode: str, known: DataFrame | None = None) -> DataFrame:
    """Events of the violation classes."""
    return trajectory.events(trajectories(spark, sf_dir, known).where(F.col("class") != NEGATIVE), thresholds(spark), mode, CHUNK)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed heads: ten times the prompts, b = -5, an unknown band from 0.2 to 0.6."""
    return prompts(spark, sf_dir).select("class", F.transform("embedding", lambda x: x * 10).alias("w"), F.lit(-5.0).alias("b"), F.lit(0.2).alias("t_lo"), F.lit(0.6).alias("t_hi"))
