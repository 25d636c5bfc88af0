"""Registered queries of the corpus operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdyn.llm import align, decontam, exact, fingerprint, html, jaccard, language, mixing, negatives, secrets, sharding, suffix, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op2_sharding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    shard, depth, size, total = sharding.added(docs)
    return sharding.shard(docs).select(
        "doc_id", F.col(shard).alias("shard"), F.col(depth).alias("depth"),
        F.col(size).alias("n_bytes"), F.col(total).alias("shard_bytes"))


ORACLES["op2_sharding"] = f"""
WITH k AS (
  SELECT *, md5(concat_ws('|',
           coalesce('+' || CAST(doc_id AS VARCHAR), '-'), coalesce('+' || text, '-'),
           coalesce('+' || lang, '-'), coalesce('+' || source, '-'),
           coalesce('+' || CAST(n_chars AS VARCHAR), '-'))) AS dig,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
h AS (SELECT doc_id, dig, n_bytes, CAST('0x' || substr(dig, 1, 15) AS BIGINT) AS h FROM k),
up AS (SELECT h.*, d, h >> (60 - d) AS p FROM h, (SELECT unnest(range(0, 61)) AS d)),
node AS (SELECT d, p, sum(n_bytes) AS b, count(*) AS n, min(h) AS lo, max(h) AS hi FROM up GROUP BY d, p),
fit AS (SELECT * FROM node WHERE b <= {sharding.LIMIT} OR lo = hi),
pick AS (SELECT up.doc_id, up.dig, up.h, up.n_bytes, up.d, up.p, fit.b, fit.n, fit.lo, fit.hi
         FROM up JOIN fit USING (d, p)
         QUALIFY up.d = min(up.d) OVER (PARTITION BY up.h)),
num AS (SELECT *, row_number() OVER (PARTITION BY dig) - 1 AS o,
               greatest(1, {sharding.LIMIT} // greatest(1, n_bytes)) AS per FROM pick),
named AS (SELECT *, CASE WHEN d = 0 THEN '' ELSE right(format('{{:060b}}', p), d) END AS bits,
                 lo = hi AND b > {sharding.LIMIT} AND n > 1 AS over FROM num)
SELECT doc_id, CASE WHEN over THEN bits || '+' || CAST(o // per AS VARCHAR) ELSE bits END AS shard,
       CAST(d AS INTEGER) AS depth, n_bytes,
       CAST(CASE WHEN over THEN n_bytes * least(per, n - o // per * per) ELSE b END AS BIGINT) AS shard_bytes
FROM named
"""


@_register
def op9_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size, source_size, target, copies = mixing.added(docs)
    return mixing.rates(docs).select(
        "doc_id", F.col(size).alias("size"), F.col(source_size).alias("source_size"),
        F.col(target).alias("target"), (F.col(size) * F.col(copies)).alias("taken"))


ORACLES["op9_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY source),
w AS (SELECT source, CAST(size AS BIGINT) AS size, 3.0::DOUBLE * size AS most,
             CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM s),
c AS (SELECT *, CAST(sum(size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w,
             coalesce(sum(most) OVER o, 0) AS most_before, coalesce(sum(w) OVER o, 0) AS w_before FROM w
      WINDOW o AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * (all_w - w_before) < w * (total - most_before) AS capped FROM c),
t AS (SELECT source, size AS source_size, CASE WHEN capped THEN most ELSE w * (
        (total - coalesce(sum(most) FILTER (WHERE capped) OVER (), 0))
        / (all_w - coalesce(sum(w) FILTER (WHERE capped) OVER (), 0))) END AS target FROM f),
r AS (SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
               / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""


@_register
def op10_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op10_exact_dedup"] = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@_register
def op7_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.filter(~out), "text", "lang", "doc_id")
    pred, score = language.added(docs)
    return language.predict(docs, model, keep=("doc_id",)).select(
        "doc_id", out.alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"))


@_register
def op1_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language.held_out(F.col("doc_id"), 5, 0)
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~out)
    model = toxicity.fit(docs, labels, "text", "toxic", "doc_id")
    name, = toxicity.added(docs)
    return toxicity.score(docs, model, keep=("doc_id",)).select(
        "doc_id", out.alias("held_out"), F.col(name).alias("score"),
        (F.col(name) >= 0.5).cast("int").alias("predicted"))


@_register
def op6_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    name, = secrets.added(docs)
    found = secrets.scan(docs, keep=("doc_id",)).withColumnRenamed(name, "found")
    joined = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    n = {k: F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)") for k in secrets.KINDS}
    return found.select(
        "doc_id", *(n[k].alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(F.expr(joined.format("filter(found, s -> s.kind != 'novel')")), 256).alias("base_sha256"),
        F.expr(joined.format("found")).alias("spans"), n["novel"].alias("n_novel"))


@_register
def op3_decontamination(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    name, = decontam.added(docs)
    found = decontam.find(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode(name).alias("m")).select(
        "doc_id", F.col("m.item").alias("item_id"), F.col("m.similarity").alias("similarity"),
        F.col("m.first_word").alias("first_word"), F.col("m.n_words").alias("n_words"))


@_register
def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register
def op4_html_extraction(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    name, = html.added(pages)
    text = F.concat_ws(" ", F.col(name))
    return html.extract(pages, html.fit(pages), keep=("page_id", "url")).select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@_register
def op8_suffix_dedup(spark, sf_dir):
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "concat_ws(',', transform(spans, s -> concat(s.start, ':', s.end)))"
    return found.withColumn("spans", F.expr(joined))


@_register
def op11_alignment(spark, sf_dir):
    return align.align(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register
def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", F.col("id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
       AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@_register
def op13_fingerprints(spark, sf_dir):
    return fingerprint.edit_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))
