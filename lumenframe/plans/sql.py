"""SQL for DuckDB that the queries' oracles share: the test tables as the operators' inputs."""

from __future__ import annotations

from lumenframe.plans.inputs import NEGATIVE, SEED, TAXONOMY


def runs_sql(name: str, source: str, flag: str, keys: list[str] | None = None, chunk: float = 2.0) -> str:
    """A common table expression of maximal runs of flagged rows of ``source``."""
    k = ", ".join(keys or ["video", "class"])
    return f"""{name} AS (SELECT {k}, min(start_sec) AS start_sec, max(start_sec) + {chunk} AS end_sec, max(score) AS peak, avg(score) AS mean, count(*) AS n_windows FROM (
  SELECT *, place - row_number() OVER (PARTITION BY {k} ORDER BY start_sec) AS run FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY start_sec) AS place FROM {source}) WHERE {flag}) GROUP BY {k}, run)"""


def match_sql(name: str, pred: str, truth: str, keys: list[str], iou: float = 0.3) -> str:
    """Common table expressions up to ``name``: tp, fp, fn of the greedy matching by keys."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    key = ", ".join(f"coalesce(p.{x}, t.{x}) AS {x}" for x in keys)
    score = "greatest(0.0, least(p.e[r.i + 1], g.e) - greatest(p.s[r.i + 1], g.s)) / (greatest(p.e[r.i + 1], g.e) - least(p.s[r.i + 1], g.s))"
    score = score.replace("p.e", "r.pe").replace("p.s", "r.ps")
    best = f"list_sort(list_filter(list_transform(r.free, lambda g: {{'iou': {score}, 'pos': g.pos}}), lambda x: x.iou >= {iou}))[-1].pos"
    return f"""{name}_p AS (SELECT {k}, list(CAST(start_sec AS DOUBLE) ORDER BY peak DESC, start_sec) AS ps, list(CAST(end_sec AS DOUBLE) ORDER BY peak DESC, start_sec) AS pe FROM {pred} GROUP BY {k}),
{name}_t AS (SELECT {k}, list({{'pos': CAST(pos AS BIGINT), 's': CAST(start_sec AS DOUBLE), 'e': CAST(end_sec AS DOUBLE)}} ORDER BY pos) AS free FROM {truth} x GROUP BY {k}),
{name}_b AS (SELECT {key}, coalesce(ps, []) AS ps, coalesce(pe, []) AS pe, coalesce(free, []) AS free, coalesce(len(free), 0) AS nt FROM {name}_p p FULL JOIN {name}_t t ON {on("p", "t")}),
{name}_r AS (SELECT {k}, ps, pe, free, nt, 0 AS i FROM {name}_b UNION ALL
  SELECT {k}, ps, pe, list_filter(free, lambda g: best IS NULL OR g.pos <> best), nt, i + 1 FROM (SELECT r.*, {best} AS best FROM {name}_r r WHERE i < len(ps))),
{name} AS (SELECT {k}, CAST(nt - len(free) AS BIGINT) AS tp, CAST(len(ps) - (nt - len(free)) AS BIGINT) AS fp, CAST(len(free) AS BIGINT) AS fn FROM {name}_r WHERE i = len(ps))"""


def prf_sql() -> str:
    """Precision, recall and F1, rounded, from columns tp, fp and fn."""
    p, r = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
    f = f"CASE WHEN ({p}) + ({r}) > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"
    return f"round({p}, 4) AS precision, round({r}, 4) AS recall, round({f}, 4) AS f1"


_TAXONOMY = ", ".join(f"('{c}', {w}, {t}::DOUBLE, {k})" for c, _, _, w, t, k in TAXONOMY)
_SIZES = sorted({t[3] for t in TAXONOMY if t[3] > 1})
_SMOOTH = " ".join(f"WHEN \"window\" = {w} THEN round(median(score) OVER (PARTITION BY video, class ORDER BY start_sec ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING), 9)" for w in _SIZES)

BASE = f"""items AS (SELECT vec_id AS item, label, CAST(embedding AS DOUBLE[]) AS embedding, CASE WHEN rn <= greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)),
means AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM items WHERE split = 'train') GROUP BY ALL),
prompts AS (SELECT label AS class, list(x / norm ORDER BY i) AS embedding FROM (SELECT *, greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12) AS norm FROM means) GROUP BY label),
scores AS (SELECT item, label, split, class, list_dot_product(i.embedding, p.embedding) AS score FROM items i, prompts p),
pred AS (SELECT item, label, split, class AS pred, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, class) AS r FROM scores) WHERE r = 1),
classes AS (SELECT DISTINCT label AS class FROM embeddings),
per_class AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r, CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END AS f
  FROM (SELECT class, (SELECT count(*) FROM pred WHERE label = class) AS support, (SELECT count(*) FROM pred WHERE pred = class) AS predicted, (SELECT count(*) FROM pred WHERE pred = class AND label = class) AS tp FROM classes)),
days AS (SELECT user_id AS video, event_type AS class, date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) AS day, max(value) AS value FROM events GROUP BY ALL),
trajectories AS (SELECT u.video, c.class, CAST(d.day AS DOUBLE) AS start_sec, coalesce(x.value, 0.0) / 100 AS score
  FROM (SELECT DISTINCT video FROM days) u CROSS JOIN (SELECT DISTINCT class FROM days) c CROSS JOIN (SELECT unnest(range((SELECT max(day) FROM days) + 1)) AS day) d LEFT JOIN days x ON x.video = u.video AND x.class = c.class AND x.day = d.day),
annotations AS (SELECT *, row_number() OVER (PARTITION BY video, class ORDER BY start_sec) AS pos FROM (SELECT video, class, CAST(min(day) AS DOUBLE) AS start_sec, CAST(max(day) + 1 AS DOUBLE) AS end_sec
  FROM (SELECT *, day - row_number() OVER (PARTITION BY video, class ORDER BY day) AS run FROM days) GROUP BY video, class, run)),
durations AS (SELECT video, CAST(max(day) + 1 AS DOUBLE) AS duration FROM days GROUP BY video),
taxonomy AS (SELECT * FROM (VALUES {_TAXONOMY}) t(class, "window", threshold, min_consec)),
smoothed AS (SELECT video, class, start_sec, threshold, min_consec, CASE {_SMOOTH} ELSE score END AS score FROM trajectories JOIN taxonomy USING (class)),
raw AS (SELECT * FROM trajectories JOIN taxonomy USING (class) WHERE class <> '{NEGATIVE}'),
{runs_sql("isolated", "raw", "score >= threshold")},
{runs_sql("glued", "smoothed", "score >= threshold")},
glue AS (SELECT g.* FROM glued g JOIN taxonomy t USING (class) WHERE n_windows >= min_consec AND class <> '{NEGATIVE}')"""

GRID = f"""tiles AS (SELECT video, CAST(unnest(range(CAST(floor((duration - 2) / 2 + 1e-9) AS BIGINT) + 1)) * 2 AS DOUBLE) AS start_sec FROM durations WHERE duration >= 2),
chunks AS (SELECT printf('%d_%07d', video, CAST(start_sec * 1000 AS BIGINT)) AS chunk_id, video, CASE WHEN video % 5 = 0 THEN 'val' ELSE 'train' END AS split, start_sec, CASE WHEN len(found) = 0 THEN ['{NEGATIVE}'] ELSE found END AS labels
  FROM (SELECT w.video, w.start_sec, list_sort(coalesce(list(DISTINCT a.class) FILTER (a.class IS NOT NULL), [])) AS found FROM tiles w LEFT JOIN annotations a ON a.video = w.video AND a.class <> '{NEGATIVE}' AND least(w.start_sec + 2.0, a.end_sec) - greatest(w.start_sec, a.start_sec) >= 0.5 GROUP BY ALL)),
sliding AS (SELECT video, CAST(unnest(CASE WHEN duration + 1e-6 < 2 THEN [0] ELSE range(CAST(floor(duration - 2 + 1e-6) AS BIGINT) + 1) END) AS DOUBLE) AS start_sec FROM durations),
matrix AS (SELECT t.video, t.class, t.start_sec, t.score, CAST(count(a.pos) > 0 AS INTEGER) AS y FROM trajectories t LEFT JOIN annotations a ON a.video = t.video AND a.class = t.class AND a.class <> '{NEGATIVE}' AND least(t.start_sec + 2.0, a.end_sec) - greatest(t.start_sec, a.start_sec) >= 0.5 GROUP BY ALL)"""


def select(body: str, more: str = "", head: str = "") -> str:
    """``body`` over the base tables and ``more`` common table expressions."""
    return f"WITH RECURSIVE {BASE}{', ' + more if more else ''}\n{head}{body}"
