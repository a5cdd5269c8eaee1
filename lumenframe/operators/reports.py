"""Comparing runs: metrics side by side, deltas, cross-checks and small documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.names import clamp
from lumenframe.functions.vectors import half_up
from lumenframe.operators.classify import averages, confusion

#: The metrics that a comparison shows first, in this order.
HEADLINE = (
    "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1",
    "v2t_r_at_1", "v2t_r_at_3", "v2t_r_at_5", "v2t_r_at_10", "t2v_r_at_1", "t2v_r_at_5", "t2v_r_at_10", "map", "median_first_rank",
)


def long_metrics(metrics: DataFrame, phase: str) -> DataFrame:
    """A one-row table of numbers as rows: phase, metric, value."""
    wide = metrics.select(*(F.col(c).cast("double").alias(c) for c in metrics.columns))
    return wide.unpivot([], wide.columns, "metric", "value").select(F.lit(phase).alias("phase"), "metric", "value")


def compare(base: DataFrame, tuned: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Metrics that both long tables have: metric, base, tuned, delta, and whether |delta| exceeds ``tolerance``."""
    b, t = base.select("metric", F.col("value").alias("base")), tuned.select("metric", F.col("value").alias("tuned"))
    delta = half_up(F.col("tuned") - F.col("base"), 6)
    return b.join(t, "metric").select("metric", "base", "tuned", delta.alias("delta"), (F.abs(delta) > tolerance).cast("int").alias("differs"))


def run_matrix(reports: DataFrame, phases: list[str], metric: str = "f1") -> DataFrame:
    """(phase, mode, ...) reports as a table with a row for each mode and a column for each phase."""
    return reports.groupBy("mode").pivot("phase", phases).agg(F.first(metric))


def flatten_json(text: Column) -> Column:
    """A JSON document of nested objects as map of dotted lower-case keys to numbers, at any depth; true and false are 1 and 0.

    Text, lists and nulls are left out; of equal keys, lower-case and dotted, the deepest counts and then the one that
    sorts last. Null and empty documents are null; malformed ones, and objects with a key twice, are errors. The document is parsed once, as a variant, and
    each step of a fold opens the objects of one level; it has no more levels than braces. Each value's kind is looked at once,
    and what several expressions read is bound to a lambda's variable: Spark evaluates what stands in a lambda anew for each mention.
    """
    text, opened = F.nullif(text, F.lit("")), "struct<p: string, m: map<string, variant>, n: double>"
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def seen(p: Column, v: Column) -> Column:
        """A value at ``p``: ``m`` if it is an object, ``n`` if it is a number, neither for all others."""
        number = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$")
        kinds = lambda m: F.struct(p.alias("p"), m.alias("m"), F.when(m.isNull() & number, v.try_cast("double")).alias("n"))
        return bound(v.try_cast("map<string, variant>"), kinds)

    def step(state: Column, _: Column) -> Column:
        inside = lambda x: F.transform(F.map_entries(x["m"]), lambda e: seen(F.lower(F.concat(x["p"], e["key"], F.lit("."))), e["value"]))
        objects = F.filter(state["todo"], lambda x: x["m"].isNotNull())
        found = F.transform(F.filter(state["todo"], lambda x: x["n"].isNotNull()), lambda x: F.struct(F.rtrim(x["p"], F.lit(".")).alias("key"), x["n"].alias("value")))
        return F.struct(F.flatten(F.transform(objects, inside)).cast(f"array<{opened}>").alias("todo"), F.concat(state["done"], found).alias("done"))

    def as_map(done: Column) -> Column:
        last = F.filter(done, lambda x, i: ~F.exists(F.slice(done, i + 2, F.size(done)), lambda y: y["key"] == x["key"]))
        whole = F.size(F.array_distinct(F.transform(done, lambda x: x["key"]))) == F.size(done)
        return F.map_from_entries(F.when(whole, done).otherwise(last))

    def flat(t: Column) -> Column:
        first = F.struct(F.array(bound(F.parse_json(t), lambda v: seen(F.lit(""), v))).cast(f"array<{opened}>").alias("todo"), F.array().cast("array<struct<key: string, value: double>>").alias("done"))
        return bound(F.aggregate(F.sequence(F.lit(0), F.regexp_count(t, F.lit(r"\{"))), first, step, lambda s: s["done"]), as_map)

    return F.when(text.isNotNull(), bound(text, flat))


def keys_like(flat: Column, part: str) -> Column:
    return F.map_filter(flat, lambda k, _: k.contains(part))


def markdown(comparison: DataFrame) -> str:
    """A comparison as a Markdown table, headline metrics first; the table has a row for each metric."""
    order = {m: i for i, m in enumerate(HEADLINE)}
    rows = sorted(comparison.collect(), key=lambda r: (order.get(r["metric"], len(order)), r["metric"]))
    lines = ["| metric | base | tuned | delta |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {r['metric']} | {r['base']:.4f} | {r['tuned']:.4f} | {r['delta']:+.4f} |" for r in rows])


def events_document(events: DataFrame, videos: DataFrame) -> DataFrame:
    """One JSON object of events by class for each video; videos without events have {}: video, events."""
    each = F.struct("start_sec", "end_sec", "peak", "mean", "n_windows")
    by_class = events.groupBy("video", "class").agg(F.array_sort(F.collect_list(each)).alias("e"))
    doc = by_class.groupBy("video").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "e"))))).alias("events"))
    return videos.select("video").distinct().join(doc, "video", "left").select("video", F.coalesce("events", F.lit("{}")).alias("events"))


def trajectory_payload(scores: DataFrame, events: DataFrame | None = None, chunk: float = 2.0) -> DataFrame:
    """What a viewer asks for, a JSON object for each video: starts, classes (scores by class, in order), chunk_sec, events by class.

    ``starts`` are the distinct starts of the video's windows; a class without a score at one has null there.
    """
    starts = scores.groupBy("video").agg(F.array_sort(F.collect_set("start_sec")).alias("starts"))
    each = scores.groupBy("video", "class").agg(F.map_from_entries(F.collect_list(F.struct("start_sec", "score"))).alias("at"))
    lists = each.join(starts, "video").select("video", "starts", "class", F.transform("starts", lambda s: F.try_element_at("at", s)).alias("t"))
    doc = lists.groupBy("video").agg(F.first("starts").alias("starts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "t")))).alias("classes"))
    found = F.lit("{}")
    if events is not None:
        doc, found = doc.join(events_document(events, scores), "video", "left"), F.coalesce("events", F.lit("{}"))
    body = F.to_json(F.struct("starts", "classes", F.lit(chunk).alias("chunk_sec")), {"ignoreNullFields": "false"})
    return doc.select("video", F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"events":'), found, F.lit("}")).alias("payload"))


def lift(probe: DataFrame, zero_shot: DataFrame, classes: DataFrame) -> DataFrame:
    """Accuracy and macro F1 of a probe's and of zero-shot predictions (label, pred) of the same items, and the differences: one row."""
    part = lambda p, name: averages(confusion(p, classes)).select(F.col("accuracy").alias(f"{name}_accuracy"), F.col("macro_f1").alias(f"{name}_macro_f1"))
    both = part(probe, "probe").join(part(zero_shot, "zeroshot"))  # one row each
    rises = [half_up(F.col(f"probe_{m}") - F.col(f"zeroshot_{m}"), 6).alias(f"{m}_lift") for m in ("accuracy", "macro_f1")]
    return both.select("*", *rises)


def search_request(k: Column | int) -> Column:
    """The number of hits that a request gets: 1 to 24."""
    return clamp(F.lit(k) if isinstance(k, int) else k)
