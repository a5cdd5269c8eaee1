"""The operators' registered queries over their whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import audit, bpe, htmltext, jaccard, langid, licenses, media, negatives, packing, pipeline, tokenio, topk, toxicity, warc
from lumenframe.llm.common import stage
from lumenframe.llm.sources import table, tokenizer_path


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def document_path() -> Column:
    """The place of a document in a virtual tree: /source/thousands/hundreds/id.txt.

    A document of at most 40 words stands for the licence file of its thousand.
    """
    source = F.coalesce("source", F.lit("none"))
    thousand, hundred = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100)
    short = F.size(F.split(F.coalesce("text", F.lit("")), " ")) <= 40
    name = F.when(short, F.format_string("/%s/%d/LICENSE.%d", source, thousand, F.col("doc_id"))).otherwise(F.format_string("/%s/%d/%d/%d.txt", source, thousand, hundred, F.col("doc_id")))
    return F.when(F.col("doc_id").isNotNull(), name)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), document_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.clean_labels(table(spark, sf_dir, "labels"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score_texts(docs, labels.where(~toxicity.held_out("id")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence_ids")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.audio_features(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), digests=True)


def op8_tokenio(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = tokenio.new_folder(spark)
    tokenio.write_tokens(table(spark, sf_dir, "documents"), where, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return tokenio.read_tokens(spark, where, ids=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = warc.new_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), where)
    found = warc.resolve(stage(warc.read_records(spark, where), "warc-read"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk, op2_langid, op3_licenses, op4_toxicity, op5_media, op6_html, op7_bpe, op8_tokenio, op9_packing, op10_ngram_join, op11_warc, op12_hard_negatives, op13_filter_audit)
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _licenses_sql() -> str:
    every = licenses.templates()
    values = ", ".join(f"({i}, '{t.license}', {t.level}, {t.need}, {t.marks()[0]}, {t.marks()[1]}, '{t.text}')" for i, t in enumerate(every))
    marks = ", ".join(f"('{w}', {bits})" for w, bits in licenses.mark_bits().items())
    gap, statement, sentence, clause = licenses.GAP, licenses.STATEMENT.replace("\\n", "\n"), licenses.SENTENCE, licenses.CLAUSE
    split = lambda x: f"list_filter(string_split_regex(lower({x}), '{gap}'), lambda w: w <> '')"
    wrapped = f"regexp_replace(text, '{licenses.WRAP}', ' \\1', 'g')"
    return f"""
WITH RECURSIVE tpl AS (SELECT * FROM (VALUES {values}) t(id, license, level, need, bits, care, t)),
marks AS (SELECT * FROM (VALUES {marks}) t(w, mark)),
tw AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest({split("t")}) AS w FROM tpl) GROUP BY ALL),
docs AS (SELECT doc_id, source, text, len(string_split(coalesce(text, ''), ' ')) <= 40 AS short FROM documents),
df AS (SELECT w, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({split("text")})) AS w FROM docs) WHERE w IN (SELECT w FROM tw) GROUP BY w),
total AS (SELECT count(*) AS n FROM docs),
idf AS (SELECT t.w, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS v FROM (SELECT DISTINCT w FROM tw) t LEFT JOIN df USING (w), total),
size AS (SELECT id, sqrt(sum((c * v) ** 2)) AS s FROM tw JOIN idf USING (w) GROUP BY id),
st AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS s
  FROM (SELECT doc_id, list_distinct(list_concat(string_split_regex(text, '{statement}'), string_split_regex({wrapped}, '{sentence}'), string_split_regex({wrapped}, '{clause}'))) AS l FROM docs WHERE regexp_matches(text, '{licenses.HINT}'))
),
sw AS (SELECT doc_id, pos, w, count(*) AS c FROM (SELECT doc_id, pos, unnest({split("s")}) AS w FROM st) GROUP BY ALL),
norm AS (SELECT doc_id, pos, sqrt(sum((c * coalesce(v, ln(total.n + 1) + 1)) ** 2)) AS s, bit_or(coalesce(mark, 0)) AS marks FROM sw LEFT JOIN idf USING (w) LEFT JOIN marks USING (w), total GROUP BY ALL),
cosine AS (
  SELECT sw.doc_id, license, level, round(sum(sw.c * tw.c * v * v) / (any_value(norm.s) * any_value(size.s)), 6) AS cosine
  FROM sw JOIN tw USING (w) JOIN idf USING (w) JOIN size ON size.id = tw.id JOIN norm ON norm.doc_id = sw.doc_id AND norm.pos = sw.pos JOIN tpl ON tpl.id = tw.id AND norm.marks & care = bits
  GROUP BY sw.doc_id, sw.pos, tpl.id, license, level, need HAVING count(CASE WHEN w <> 'the' THEN 1 END) >= need
),
own AS (
  SELECT doc_id, license AS own_license, cosine AS own_cosine
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level, cosine DESC, license) AS r FROM cosine WHERE cosine >= {licenses.THRESHOLD}) WHERE r = 1
),
files AS (
  SELECT doc_id, short, own_license, own_cosine, '/' || coalesce(source, 'none') || '/' || (doc_id // 1000) AS thousand,
    CASE WHEN short THEN '/LICENSE.' || doc_id ELSE '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS rest
  FROM docs LEFT JOIN own USING (doc_id)
),
dirs AS (SELECT thousand, first(own_license ORDER BY own_cosine DESC, own_license) AS found FROM files WHERE short AND own_license IS NOT NULL GROUP BY thousand)
SELECT doc_id, files.thousand || rest AS path, own_license, own_cosine, coalesce(own_license, found) AS license,
  CASE WHEN own_license IS NOT NULL THEN files.thousand || rest WHEN found IS NOT NULL THEN files.thousand END AS license_from
FROM files LEFT JOIN dirs USING (thousand)
"""


def near_sql(source: str = "documents") -> str:
    """Common table expressions up to ``near`` (doc_id, class_id, set_id, n_copies, n_set_links, n_links) over ``source``."""
    return f"""
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS l FROM {source}),
g AS (
  SELECT doc_id, CASE WHEN coalesce(len(l), 0) = 0 THEN [] WHEN len(l) < {jaccard.NGRAM} THEN [array_to_string(l, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(l) - {jaccard.NGRAM - 2}), lambda i: array_to_string(l[i:i + {jaccard.NGRAM - 1}], ' ')))) END AS g FROM w
),
sets AS (SELECT g, min(doc_id) AS set_id, count(*) AS n_copies FROM g WHERE len(g) > 0 GROUP BY g),
grams AS (SELECT set_id, unnest(g) AS x FROM sets),
pairs AS (
  SELECT a, b FROM (SELECT p.set_id AS a, q.set_id AS b, count(*) AS c FROM grams p JOIN grams q ON p.x = q.x AND p.set_id < q.set_id GROUP BY ALL)
  JOIN sets s ON s.set_id = a JOIN sets t ON t.set_id = b WHERE c >= {jaccard.SIMILARITY} * (len(s.g) + len(t.g) - c) - 1e-9
),
mated AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS root FROM mated UNION SELECT mated.b, reach.root FROM reach JOIN mated ON mated.a = reach.node),
roots AS (SELECT node AS set_id, min(root) AS class_id FROM reach GROUP BY node),
links AS (SELECT a AS set_id, count(*) AS n_set_links, sum(n_copies) AS linked FROM mated JOIN sets ON sets.set_id = b GROUP BY a),
near AS (
  SELECT g.doc_id, coalesce(class_id, s.set_id, g.doc_id) AS class_id, coalesce(s.set_id, g.doc_id) AS set_id, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies,
    CAST(coalesce(n_set_links, 0) AS BIGINT) AS n_set_links, CAST(coalesce(linked, 0) + coalesce(n_copies, 1) - 1 AS BIGINT) AS n_links
  FROM g LEFT JOIN sets s ON s.g = g.g LEFT JOIN roots ON roots.set_id = s.set_id LEFT JOIN links ON links.set_id = s.set_id
)"""


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id <> top THEN top END AS refers_to
FROM d
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND r <= 5 AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), m AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
run AS (
  SELECT part, o, failed, n, good, toxic, list_min(list_transform(string_split(failed, ''), lambda c: strpos(o, c))) AS place FROM m, o WHERE failed <> ''
  UNION ALL SELECT part, o, failed, n, good, toxic, 6 FROM m, o WHERE failed = ''
), steps AS (SELECT o, CAST(s AS INTEGER) AS step, o[s] AS own FROM o, range(1, 6) r(s)),
base AS (
  SELECT part, r.o, step, own, sum(CASE WHEN place > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN place < step AND contains(failed, own) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN place = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM run r JOIN steps s ON s.o = r.o GROUP BY ALL
)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM base
"""


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_topk": OP1_SQL,
        "op3_licenses": _licenses_sql(),
        "op11_warc": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
        "op10_ngram_join": f"WITH RECURSIVE {near_sql()} SELECT doc_id, class_id, set_id, n_copies, n_set_links, n_links FROM near",
    }
    return found | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
