"""Registered queries: sources and sinks, scalars, connectivity, consensus, graphs, similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphdyn.functions import scalars as fn
from graphdyn.operators import compare as cmp
from graphdyn.operators import connectivity as con
from graphdyn.operators import consensus as cns
from graphdyn.operators import graphs as gr
from graphdyn.operators import prep
from graphdyn.operators import stats as st
from graphdyn.plans import cohort
from graphdyn.plans import oracle_parts as o
from graphdyn.plans.catalog import query
from graphdyn.schema import AGREEMENT
from graphdyn.session import cut_lineage, shared_folder
from graphdyn.sources import fixtures as fx
from graphdyn.sources import readers as rd
from graphdyn.sources import writers as wr

N1 = 64


def _scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _edges(spark, d):
    return con.pearson_edges(fx.frames_embeddings(spark, d))


def _binar(spark, d):
    return cns.consensus_binarize(_edges(spark, d))


def _graph(spark, d):
    """Distance consensus of F1 with c, w and g; small, so written once."""
    cons = cut_lineage(_binar(spark, d))
    g = cns.distance_consensus(cons, fx.channel_layout(spark, N1), 0.15)
    return cut_lineage(cons.select("grp", "i", "j", "c", "w", "w_full").join(
        g.select("grp", "i", "j", "g"), ["grp", "i", "j"]))


# -- sources and sinks ------------------------------------------------------------

@query("subject_id grp channel:i t:l value:r6", f"WITH {o.EVENTS} SELECT * FROM ev")
def read_signals(spark, d):
    path = _scratch(spark, "signals")
    fx.signals_events(spark, d).select("subject_id", "grp", "channel", "t", "value") \
        .write.parquet(path)
    return rd.read_signals(spark, path)


@query("subject_id grp channel:i t:l value:r6", f"""WITH {o.EVENTS}
SELECT 'sub-id=' || subject_id AS subject_id, CASE WHEN grp = 'A' THEN 'AD' ELSE 'HC' END AS grp,
       channel, t, value FROM ev""")
def read_cohort(spark, d):
    path = _scratch(spark, "cohort")
    (fx.signals_events(spark, d).select(
        F.when(F.col("grp") == "A", "AD").otherwise("HC").alias("arm"),
        F.col("subject_id").alias("sub-id"), "channel", "t", "value")
     .write.option("header", True).partitionBy("arm", "sub-id").csv(path))
    signals, _ = rd.read_cohort(spark, path, id_rule="bids", group_depth=2)
    return signals


@query("subject_id grp status reason detail_1", f"""WITH {o.EVENTS},
n AS (SELECT subject_id, grp, max(t) + 1 AS n FROM ev GROUP BY ALL)
SELECT 'sub-id=' || subject_id AS subject_id, CASE WHEN grp = 'A' THEN 'AD' ELSE 'HC' END AS grp,
       'FAILED' AS status, 'EEG_loading_error' AS reason,
       CASE WHEN subject_id = '3' THEN 'bad_rows=1' ELSE 'n_samples=' || n || '/' || (n + 1) END AS detail_1
FROM n WHERE subject_id IN ('3', '7')""")
def cohort_rejects(spark, d):
    """One recording with a broken row, one that is a sample short of its manifest."""
    path = _scratch(spark, "cohort")
    sig = fx.signals_events(spark, d)
    files = sig.select(F.when(F.col("grp") == "A", "AD").otherwise("HC").alias("arm"),
                       F.col("subject_id").alias("sub-id"),
                       F.concat_ws(",", "channel", "t", "value").alias("line"))
    broken = files.filter("`sub-id` = '3'").select("arm", "sub-id").distinct().withColumn(
        "line", F.lit("x,y,oops"))
    files.unionByName(broken).write.partitionBy("arm", "sub-id").text(path)
    late = (F.col("subject_id") == "7").cast("int")
    want = sig.groupBy("subject_id").agg((F.max("t") + 1).alias("n")).select(
        F.concat(F.lit("sub-id="), "subject_id").alias("subject_id"), (F.col("n") + late).alias("n_samples"))
    _, rejects = rd.read_cohort(spark, path, id_rule="bids", group_depth=2, header=False, expected=want)
    return rejects


@query("graph_id i:i j:i w:r6", f"""WITH {o.EDGES}, {o.MEAN}
SELECT grp AS graph_id, i, j, w FROM cmean""")
def read_graph(spark, d):
    path = _scratch(spark, "graph")
    cns.consensus_mean(_edges(spark, d)).select(
        F.col("grp").alias("graph_id"), "i", "j", "w").write.parquet(path)
    return rd.read_graph(spark, path)


@query("channel:i", f"""WITH {o.F1}
SELECT DISTINCT channel FROM f1 WHERE channel NOT IN (SELECT range FROM range(60))""")
def missing_channels(spark, d):
    path = _scratch(spark, "layout")
    fx.channel_layout(spark, 60).write.parquet(path)
    return rd.missing_channels(fx.signals_embeddings(spark, d),
                               rd.read_channel_locations(spark, path))


_SCORES = f"""{o.EDGES}, {o.MEAN},
al AS (SELECT e.subject_id, e.grp, e.i, e.j, e.w AS a, c.w AS b
       FROM edges e JOIN cmean c USING (grp, i, j)),
rk AS (SELECT *, rank() OVER (PARTITION BY subject_id ORDER BY a DESC) AS pa,
              rank() OVER (PARTITION BY subject_id ORDER BY b DESC) AS pb,
              rank() OVER (PARTITION BY subject_id ORDER BY a)
                + (count(*) OVER (PARTITION BY subject_id, a) - 1) / 2.0::DOUBLE AS ra,
              rank() OVER (PARTITION BY subject_id ORDER BY b)
                + (count(*) OVER (PARTITION BY subject_id, b) - 1) / 2.0::DOUBLE AS rb,
              count(*) OVER (PARTITION BY subject_id) AS e FROM al),
fl AS (SELECT *, pa <= floor(0.15 * e) + 1 AS in_a, pb <= floor(0.15 * e) + 1 AS in_b FROM rk),
scores AS (
  SELECT subject_id, grp, corr(a, b) AS pearson_r, corr(ra, rb) AS spearman_rho,
         count_if(in_a AND in_b) / count_if(in_a OR in_b) AS jaccard,
         sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS cosine,
         avg(abs(a - b)) AS mean_abs_diff, sqrt(avg((a - b) * (a - b))) AS rmsd,
         count_if(in_a AND in_b) AS shared_edges, count_if(in_a) AS subject_edges,
         count_if(in_b) AS consensus_edges, count(*) AS n_edges
  FROM fl GROUP BY ALL)"""


def _scores(spark, d):
    e = cut_lineage(_edges(spark, d))
    return cmp.subject_vs_consensus(e, cns.consensus_mean(e))


@query("Subject Group Pearson_r:r6 Jaccard:r6 Shared_Edges:i Subject_Edges:i Consensus_Edges:i",
       f"""WITH {_SCORES}
SELECT subject_id AS Subject, grp AS "Group", pearson_r AS Pearson_r, jaccard AS Jaccard,
       shared_edges AS Shared_Edges, subject_edges AS Subject_Edges,
       consensus_edges AS Consensus_Edges FROM scores""")
def read_results(spark, d):
    path = _scratch(spark, "agreement")
    s = _scores(spark, d).select(
        F.col("subject_id").alias("Subject"), F.col("grp").alias("Group"),
        F.col("pearson_r").alias("Pearson_r"), F.col("jaccard").alias("Jaccard"),
        F.col("shared_edges").alias("Shared_Edges"),
        F.col("subject_edges").alias("Subject_Edges"),
        F.col("consensus_edges").alias("Consensus_Edges"))
    wr.write_table(s, path)
    return rd.read_results(spark, path, AGREEMENT)


@query("grp i:i j:i c:r6 w:r6 w_full:r6", f"WITH {o.EDGES}, {o.BINARIZE} SELECT * FROM binar")
def write_consensus(spark, d):
    path = _scratch(spark, "consensus")
    e = cut_lineage(_edges(spark, d))
    wr.write_consensus(cns.consensus_binarize(e).drop("mean_sparsity"), path, e)
    return spark.read.parquet(f"{path}/consensus")


@query("subject_id grp pearson_r:r6 jaccard:r6 table_name", f"""WITH {_SCORES}
SELECT subject_id, grp, pearson_r, jaccard, 'ranks' AS table_name FROM scores UNION ALL
SELECT '-', grp, avg(pearson_r), avg(jaccard), 'groups' FROM scores GROUP BY grp""")
def write_tables(spark, d):
    path = _scratch(spark, "tables")
    s = cut_lineage(_scores(spark, d))
    wr.write_tables({
        "ranks": s.select("subject_id", "grp", "pearson_r", "jaccard"),
        "groups": s.groupBy("grp").agg(F.avg("pearson_r").alias("pearson_r"),
                                       F.avg("jaccard").alias("jaccard"))}, path)
    schema = "subject_id string, grp string, pearson_r double, jaccard double"
    ranks = rd.read_results(spark, f"{path}/ranks", schema)
    groups = rd.read_results(spark, f"{path}/groups",
                             "grp string, pearson_r double, jaccard double")
    return ranks.withColumn("table_name", F.lit("ranks")).unionByName(
        groups.select(F.lit("-").alias("subject_id"), "grp", "pearson_r", "jaccard",
                      F.lit("groups").alias("table_name")))


_AGREE_COLS = ("grp n:l r_mean:r6 r_std:r6 r_min:r6 r_max:r6 j_mean:r6 j_std:r6 j_min:r6 j_max:r6"
               " n_r_above:l share_r_above:r6 n_j_good:l share_j_good:r6 n_j_ok:l share_j_ok:r6")
_AGREE_SQL = f"""WITH {_SCORES}
SELECT grp, count(*) AS n, avg(pearson_r) AS r_mean, stddev_pop(pearson_r) AS r_std,
       min(pearson_r) AS r_min, max(pearson_r) AS r_max, avg(jaccard) AS j_mean,
       stddev_pop(jaccard) AS j_std, min(jaccard) AS j_min, max(jaccard) AS j_max,
       count_if(pearson_r > 0.5) AS n_r_above,
       count_if(pearson_r > 0.5) / count(*) AS share_r_above,
       count_if(jaccard > 0.5) AS n_j_good, count_if(jaccard > 0.5) / count(*) AS share_j_good,
       count_if(jaccard > 0.3) AS n_j_ok, count_if(jaccard > 0.3) / count(*) AS share_j_ok
FROM scores GROUP BY grp"""


@query(_AGREE_COLS, _AGREE_SQL)
def write_stats_json(spark, d):
    path = _scratch(spark, "stats")
    s = cmp.agreement_summary(_scores(spark, d))
    wr.write_stats_json(s, path)
    return spark.read.schema(s.schema).json(path)


_DROPPED = """kept3 AS (SELECT * FROM led WHERE NOT (subject_id IN ('3', '12') AND channel = 0)),
chan AS (SELECT subject_id, grp, count(DISTINCT channel) AS n FROM kept3 GROUP BY ALL)"""


def _ledger_with_gap(spark, d):
    gap = F.col("subject_id").isin("3", "12") & (F.col("channel") == 0)
    return fx.signals_ledger(spark, d).filter(~gap)


@query("subject_id grp status reason detail_1 detail_2 detail_3", f"""WITH {o.LEDGER}, {_DROPPED}
SELECT subject_id, grp, 'SUCCESS' AS status, 'Completed' AS reason, 'n=' || n AS detail_1,
       NULL AS detail_2, NULL AS detail_3 FROM chan WHERE n = 7 UNION ALL
SELECT subject_id, grp, 'REJECT', 'Channel_mismatch', 'L=7', 'EEG=' || n, NULL
FROM chan WHERE n <> 7""")
def append_qc_log(spark, d):
    path = _scratch(spark, "log")
    kept, rejected = cohort.channel_compatibility(_ledger_with_gap(spark, d), 7)
    done = kept.groupBy("subject_id", "grp").agg(F.count_distinct("channel").alias("n")).select(
        "subject_id", "grp", F.lit("SUCCESS").alias("status"), F.lit("Completed").alias("reason"),
        F.concat(F.lit("n="), "n").alias("detail_1"), F.lit("").alias("detail_2"),
        F.lit("").alias("detail_3"))
    # every job is run twice; a repeated run replaces its rows
    for _ in range(2):
        wr.append_qc_log(path, done, run="done")
        wr.append_qc_log(path, rejected, run="rejected")
    return rd.read_qc_log(spark, path)


@query("subject_id grp n_rows:l total:r4", f"""WITH {o.LEDGER}, {_DROPPED}
SELECT k.subject_id, k.grp, count(*) AS n_rows, sum(value) AS total
FROM kept3 k JOIN chan c ON c.subject_id = k.subject_id AND c.n = 7 GROUP BY ALL""")
def channel_compatibility(spark, d):
    kept, _ = cohort.channel_compatibility(_ledger_with_gap(spark, d), 7)
    return kept.groupBy("subject_id", "grp").agg(F.count(F.lit(1)).alias("n_rows"),
                                                 F.sum("value").alias("total"))


# -- scalars and labels -------------------------------------------------------------

@query("event_id:l v:r6", """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0
       ELSE value END AS v FROM events""")
def nan_to_num(spark, d):
    r = F.col("event_id") % 10
    v = (F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r == 2, float("-inf"))
         .when(r == 3, F.lit(None)).otherwise(F.col("value")))
    return fx.table(spark, d, "events").select("event_id", fn.nan_to_num(v).alias("v"))


@query("subject_id i:i j:i z:r6 back:r6", f"""WITH {o.F1}, {o.SIGNED}
SELECT subject_id, i, j, {o.fisher('r')} AS z, tanh({o.fisher('r')}) AS back FROM signed""")
def fisher_z(spark, d):
    e = con.pearson_edges(fx.frames_embeddings(spark, d), absolute=False)
    z = fn.fisher_z("w")
    return e.select("subject_id", "i", "j", z.alias("z"), fn.fisher_z_inv(z).alias("back"))


@query("subject_id i:i j:i w:r6", f"""WITH {o.F1}, {o.SIGNED}
SELECT subject_id, i, j, r AS w FROM signed""")
def signed_correlation(spark, d):
    return con.pearson_edges(fx.frames_embeddings(spark, d), absolute=False)


_PATHS = """paths AS (
  SELECT doc_id, '/data/' || CASE doc_id % 3 WHEN 0 THEN 'ad_group' WHEN 1 THEN 'HC'
         ELSE 'misc' END || '/' || CASE WHEN doc_id % 2 = 0 THEN 'sub-' || doc_id || '/' ELSE ''
         END || 's6_' || source || '_' || doc_id
         || CASE WHEN doc_id % 5 < 3 THEN '_rs-hep_eeg' ELSE '_rs_eeg' END || '.set' AS path
  FROM documents)"""


@query("doc_id:l id_strip id_bids id_stem", f"""WITH {_PATHS},
st AS (SELECT doc_id, path, replace(string_split(path, '/')[-1], '.set', '') AS stem FROM paths)
SELECT doc_id, replace(replace(replace(stem, 's6_', ''), '_rs-hep_eeg', ''), '_rs_eeg', '')
       AS id_strip, CASE WHEN path LIKE '%/sub-%' THEN string_split(path, '/')[4] ELSE stem END
       AS id_bids, stem AS id_stem FROM st""")
def subject_id_from_path(spark, d):
    return fx.recording_paths(spark, d).select(
        "doc_id", *[fn.subject_id_from_path("path", r).alias(f"id_{r}")
                    for r in ("strip", "bids", "stem")])


@query("doc_id:l grp", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AD' WHEN 1 THEN 'HC' END AS grp
FROM documents""")
def group_from_path(spark, d):
    return fx.recording_paths(spark, d).select("doc_id", fn.group_from_path("path", depth=2).alias("grp"))


@query("grp mean_sparsity:r6 k:l", f"""WITH {o.EDGES}, {o.BINARIZE}
SELECT grp, mean_sparsity, greatest(1, least(2016, CAST(round_even(mean_sparsity * 2016, 0)
       AS BIGINT))) AS k FROM share""")
def resolve_sparsity(spark, d):
    per = _binar(spark, d).groupBy("grp").agg(F.first("mean_sparsity").alias("mean_sparsity"),
                                              F.count(F.lit(1)).alias("n"))
    return per.withColumn("k", cns.k_target(F.col("mean_sparsity"), F.col("n")))


_TAIL = f"""{o.EDGES}, tail AS (
  SELECT subject_id, i, j, w, rank() OVER (PARTITION BY subject_id ORDER BY w DESC)
         / count(*) OVER (PARTITION BY subject_id) AS p_value FROM edges)"""


def _tail(spark, d):
    """Empirical tail share of every edge within its subject's graph."""
    w = Window.partitionBy("subject_id")
    return _edges(spark, d).withColumn(
        "p_value", F.rank().over(w.orderBy(F.col("w").desc())) / F.count(F.lit(1)).over(w))


@query("subject_id i:i j:i p_value:r6 stars", f"""WITH {_TAIL}
SELECT *, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**'
              WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS stars FROM tail""")
def significance_stars(spark, d):
    return _tail(spark, d).withColumn("stars", fn.significance_stars("p_value"))


@query("subject_id kind n:l", f"""WITH {_TAIL}
SELECT subject_id, 'significant' AS kind, count(*) AS n FROM tail WHERE p_value < 0.05
GROUP BY ALL UNION ALL
SELECT subject_id, 'trend', count(*) FROM tail WHERE p_value >= 0.05 AND p_value < 0.10
GROUP BY ALL""")
def significance_filters(spark, d):
    t = cut_lineage(_tail(spark, d))
    parts = [f(t).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("kind", F.lit(k))
             for k, f in (("significant", fn.significant_only), ("trend", fn.trends_only))]
    return parts[0].unionByName(parts[1])


@query("i:i j:i cohens_d:r6 effect direction", f"""WITH {o.EDGES},
{o.two_groups('edges', 'i, j', 'w')},
cd AS (SELECT *, (mean_a - mean_b) / (sqrt((std_a*std_a + std_b*std_b) / 2) + 1e-10) AS cohens_d
       FROM gm)
SELECT i, j, cohens_d, CASE WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8
       THEN 'medium' ELSE 'large' END AS effect,
       CASE WHEN mean_a > mean_b THEN 'A > B' ELSE 'B > A' END AS direction FROM cd""")
def effect_labels(spark, d):
    t = st.two_group_test(_edges(spark, d), ["i", "j"], value="w", p_values=False)
    return t.withColumn("effect", fn.effect_label("cohens_d")).withColumn(
        "direction", fn.direction_label("mean_a", "mean_b"))


@query("subject_id verdict overlap", f"""WITH {_SCORES}
SELECT subject_id, CASE WHEN pearson_r > 0.7 AND jaccard > 0.5 THEN 'SIMILAR'
       WHEN pearson_r > 0.5 THEN 'MODERATE' ELSE 'DIFFERENT' END AS verdict,
       CASE WHEN jaccard > 0.5 THEN 'Good' WHEN jaccard > 0.3 THEN 'OK' ELSE 'Low' END AS overlap
FROM scores""")
def similarity_verdict(spark, d):
    return _scores(spark, d).select(
        "subject_id", fn.similarity_verdict("pearson_r", "jaccard").alias("verdict"),
        fn.overlap_verdict("jaccard").alias("overlap"))


@query("mean_a:r6 mean_b:r6 verdict", f"""WITH {_SCORES},
m AS (SELECT avg(CASE WHEN grp = 'A' THEN pearson_r END) AS mean_a,
             avg(CASE WHEN grp = 'B' THEN pearson_r END) AS mean_b FROM scores)
SELECT *, CASE WHEN mean_a > 0.5 AND mean_b > 0.5 THEN 'VALIDATED'
       WHEN mean_a > 0.3 AND mean_b > 0.3 THEN 'MODERATE' ELSE 'WEAK' END AS verdict FROM m""")
def validation_verdict(spark, d):
    m = _scores(spark, d).agg(
        F.avg(F.when(F.col("grp") == "A", F.col("pearson_r"))).alias("mean_a"),
        F.avg(F.when(F.col("grp") == "B", F.col("pearson_r"))).alias("mean_b"))
    return m.withColumn("verdict", fn.validation_verdict("mean_a", "mean_b"))


# -- connectivity ---------------------------------------------------------------------

@query("subject_id i:i j:i n:l cov:r6", f"""WITH {o.F1}
SELECT a.subject_id, a.channel AS i, b.channel AS j, count(*) AS n,
       covar_pop(a.value, b.value) AS cov
FROM f1 a JOIN f1 b ON a.subject_id = b.subject_id AND a.t = b.t AND a.channel < b.channel
GROUP BY ALL""")
def channel_pair_moments(spark, d):
    return con.pair_moments(fx.frames_embeddings(spark, d)).withColumn(
        "cov", F.col("cij") / F.col("n"))


@query("subject_id grp i:i j:i w:r6", f"WITH {o.EDGES} SELECT * FROM edges")
def pearson_edges(spark, d):
    return _edges(spark, d)


@query("subject_id grp i:i j:i w:r6", f"""WITH {o.LEDGER_DENSE}
SELECT a.subject_id, a.grp, a.channel AS i, b.channel AS j, abs(corr(a.value, b.value)) AS w
FROM grid a JOIN grid b ON a.subject_id = b.subject_id AND a.t = b.t AND a.channel < b.channel
GROUP BY ALL""")
def pearson_edges_long(spark, d):
    sig = fx.signals_ledger(spark, d)
    return con.pearson_edges(con.to_frames(sig, fx.LEDGER_CHANNELS),
                             lengths=prep.recording_lengths(sig))


@query("subject_id i:i j:i keep:b w_kept:r6", f"""WITH {o.EDGES}, {o.BINARIZE}
SELECT subject_id, i, j, keep, CASE WHEN keep THEN w ELSE 0.0 END AS w_kept FROM flags""")
def proportional_threshold(spark, d):
    return con.threshold(_edges(spark, d), "proportional")


def _rank_rule(extra):
    return f"""WITH {o.EDGES}
SELECT subject_id, i, j, rank() OVER (PARTITION BY subject_id ORDER BY w DESC)
       <= floor(0.15 * count(*) OVER (PARTITION BY subject_id)) + {extra} AS keep FROM edges"""


@query("subject_id i:i j:i keep:b", _rank_rule(1))
def threshold_ge_kplus1(spark, d):
    return con.threshold(_edges(spark, d), "ge_kplus1")


@query("subject_id i:i j:i keep:b", _rank_rule(0))
def threshold_ge_k(spark, d):
    return con.threshold(_edges(spark, d), "ge_k")


@query("subject_id i:i j:i keep:b", f"WITH {o.EDGES} SELECT *, w > 0.2 AS keep FROM edges")
def threshold_value(spark, d):
    return con.threshold(_edges(spark, d), "value", value=0.2)


# -- consensus ------------------------------------------------------------------------

@query("grp i:i j:i c:r6 w:r6 w_full:r6", f"WITH {o.EDGES}, {o.DIRECT} SELECT * FROM direct")
def consensus_direct(spark, d):
    return cns.consensus_direct(_edges(spark, d))


@query("grp i:i j:i c:r6 w:r6 w_full:r6", f"""WITH {o.EDGES}, {o.DIRECT}
SELECT grp, i, j, CAST(w_full > 0 AS DOUBLE) AS c, w_full AS w, w_full FROM direct""")
def consensus_direct_dense(spark, d):
    return cns.consensus_direct(_edges(spark, d), None)


@query("grp i:i j:i c:r6 w:r6 w_full:r6 mean_sparsity:r6", f"""WITH {o.EDGES}, {o.BINARIZE}
SELECT * FROM binar JOIN share USING (grp)""")
def consensus_binarize(spark, d):
    return _binar(spark, d)


@query("grp i:i j:i w:r6", f"WITH {o.EDGES}, {o.MEAN} SELECT * FROM cmean")
def consensus_mean(spark, d):
    return cns.consensus_mean(_edges(spark, d))


@query("method grp n_kept:l w_sum:r6", f"""WITH {o.EDGES}, {o.BINARIZE}, {o.DIRECT}
SELECT 'binarize' AS method, grp, count_if(c > 0) AS n_kept, sum(w) AS w_sum FROM binar GROUP BY ALL
UNION ALL SELECT 'direct', grp, count_if(c > 0), sum(w) FROM direct GROUP BY ALL""")
def consensus_dispatch(spark, d):
    e = cut_lineage(_edges(spark, d))
    parts = [cns.consensus(e, m).groupBy("grp").agg(
        F.count_if(F.col("c") > 0).alias("n_kept"), F.sum("w").alias("w_sum"))
        .withColumn("method", F.lit(m)) for m in ("direct", "binarize")]
    return parts[0].unionByName(parts[1])


@query("i:i j:i dist:r6", f"""WITH {o.F1},
spot AS (SELECT channel, 1000 * avg(value) FILTER (WHERE CAST(subject_id AS INT) % 3 = 0) AS x,
                1000 * avg(value) FILTER (WHERE CAST(subject_id AS INT) % 3 = 1) AS y,
                1000 * avg(value) FILTER (WHERE CAST(subject_id AS INT) % 3 = 2) AS z FROM f1 GROUP BY channel)
SELECT a.channel AS i, b.channel AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist
FROM spot a JOIN spot b ON a.channel < b.channel""")
def channel_distance(spark, d):
    """Distances between positions that the data give: a channel's means over three thirds of the subjects."""
    part = F.col("subject_id").cast("int") % 3
    spots = fx.signals_embeddings(spark, d).groupBy("channel").agg(*[
        (1000 * F.avg(F.when(part == k, F.col("value")))).alias(axis) for k, axis in enumerate("xyz")])
    return cns.channel_distance(spots)


@query("subject_id i:i j:i a:r6 b:r6", f"""WITH {_SCORES} SELECT subject_id, i, j, a, b FROM al""")
def edge_alignment(spark, d):
    e = cut_lineage(_edges(spark, d))
    return cmp.align(e, cns.consensus_mean(e), ["grp"])


@query("subject_id i:i j:i a:r6 b:r6", f"""WITH {o.EDGES},
mean AS (SELECT grp, i, j, avg(w) AS b FROM edges GROUP BY ALL)
SELECT e.subject_id, e.i, e.j, CASE WHEN e.w > 0.2 THEN e.w ELSE 0 END AS a,
       CASE WHEN b > 0.1 THEN b ELSE 0 END AS b
FROM edges e JOIN mean USING (grp, i, j) WHERE e.w > 0.2 OR b > 0.1""")
def sparse_alignment(spark, d):
    """Both sides lack edges; an absent edge counts as weight 0."""
    e = _edges(spark, d)
    return cmp.align(e.filter("w > 0.2"), cns.consensus_mean(e).filter("w > 0.1"), ["grp"])



@query("grp i:i j:i w:r6 dist:r6", f"""WITH {o.EDGES}, {o.MEAN}, {o.layout(64)}
SELECT grp, i, j, w, dist FROM cmean JOIN dists USING (i, j)""")
def distance_attach(spark, d):
    return cns.consensus_mean(_edges(spark, d)).join(
        cns.channel_distance(fx.channel_layout(spark, N1)), ["i", "j"])


@query("grp bin:i n:l w_sum:r6 d_min:r6 d_max:r6", f"""WITH {o.EDGES}, {o.MEAN}, {o.layout(64)}
SELECT grp, bin, count(*) AS n, sum(w) AS w_sum, min(dist) AS d_min, max(dist) AS d_max
FROM cmean JOIN binned USING (i, j) GROUP BY ALL""")
def distance_bin_join(spark, d):
    b = cns.distance_bins(cns.channel_distance(fx.channel_layout(spark, N1)))
    return (cns.consensus_mean(_edges(spark, d)).join(b, ["i", "j"]).groupBy("grp", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w_sum"),
                 F.min("dist").alias("d_min"), F.max("dist").alias("d_max")))


def _distance_sql(k: str) -> str:
    return f"""{o.EDGES}, {o.BINARIZE}, {o.layout(64)},
sc AS (SELECT b.*, dist, bin, b.c + 0.1 * b.w AS score, {k} AS k
       FROM binar b JOIN binned USING (i, j) JOIN share USING (grp)),
pos AS (SELECT *, row_number() OVER (PARTITION BY grp, bin, c <> 0 ORDER BY score DESC, i, j) AS rn
        FROM sc),
first_pick AS (SELECT *, c <> 0 AND rn <= k // 10 + CASE WHEN bin < k % 10 THEN 1 ELSE 0 END AS f
               FROM pos),
filled AS (SELECT grp, count_if(f) AS used FROM first_pick GROUP BY grp),
rest AS (SELECT p.grp, p.i, p.j, row_number() OVER (PARTITION BY p.grp ORDER BY score DESC, p.i, p.j)
         AS rn2 FROM first_pick p WHERE NOT f AND c <> 0 AND score > 0),
dist_graph AS (
  SELECT p.*, f OR coalesce(rn2 <= k - used, FALSE) AS selected,
         CASE WHEN f OR coalesce(rn2 <= k - used, FALSE) THEN w ELSE 0.0 END AS g
  FROM first_pick p JOIN filled USING (grp) LEFT JOIN rest r USING (grp, i, j))"""


_K15 = "CAST(round_even(0.15 * 2016, 0) AS BIGINT)"
_GRAPH = _distance_sql(_K15)


@query("grp i:i j:i bin:i score:r6 selected:b g:r6", f"WITH {_GRAPH} SELECT * FROM dist_graph")
def distance_consensus(spark, d):
    return cns.distance_consensus(cut_lineage(_binar(spark, d)), fx.channel_layout(spark, N1))


_KSUBJ = "CAST(round_even(mean_sparsity * 2016, 0) AS BIGINT)"


@query("grp i:i j:i selected:b g:r6", f"WITH {_distance_sql(_KSUBJ)} SELECT * FROM dist_graph")
def distance_consensus_match_subject(spark, d):
    return cns.distance_consensus(cut_lineage(_binar(spark, d)), fx.channel_layout(spark, N1),
                                  "match_subject")


@query("grp i:i j:i g:r6", f"""WITH {o.EDGES}, {o.BINARIZE}
SELECT grp, i, j, CASE WHEN c > 0 AND w_full > 0 THEN w_full ELSE 0.0 END AS g FROM binar""")
def distance_consensus_dense(spark, d):
    return cns.distance_consensus(_binar(spark, d), fx.channel_layout(spark, N1), None)


@query("grp i:i j:i selected:b g:r6", f"""WITH {o.EDGES}, {o.BINARIZE},
p AS (SELECT *, row_number() OVER (PARTITION BY grp, c > 0 ORDER BY c DESC, i, j) AS rn FROM binar)
SELECT *, c > 0 AND rn <= {_K15} AS selected,
       CASE WHEN c > 0 AND rn <= {_K15} THEN w ELSE 0.0 END AS g FROM p""")
def uniform_consensus(spark, d):
    return cns.uniform_consensus(_binar(spark, d))


@query("grp c_min:r6 c_max:r6 c_mean:r6 c_median:r6 n_c_pos:l n_c_half:l n_c_one:l w_min:r6 w_max:r6"
       " w_mean:r6 w_median:r6 n_edges:l sparsity:r6 g_min:r6 g_max:r6 g_mean:r6 deg_min:l deg_max:l"
       " deg_mean:r6 deg_std:r6", f"""WITH {_GRAPH},
ends AS (SELECT grp, i AS node, g FROM dist_graph UNION ALL SELECT grp, j, g FROM dist_graph),
deg AS (SELECT grp, node, count_if(g > 0) AS dg FROM ends GROUP BY ALL),
ds AS (SELECT grp, min(dg) AS deg_min, max(dg) AS deg_max, avg(dg) AS deg_mean,
              stddev_pop(dg) AS deg_std FROM deg GROUP BY grp),
es AS (SELECT grp, min(c) AS c_min, max(c) AS c_max, avg(c) AS c_mean,
  quantile_cont(c, 0.5) AS c_median, count_if(c > 0) AS n_c_pos, count_if(c > 0.5) AS n_c_half,
  count_if(c = 1) AS n_c_one, min(w) FILTER (w > 0) AS w_min, max(w) AS w_max,
  avg(w) FILTER (w > 0) AS w_mean, quantile_cont(w, 0.5) FILTER (w > 0) AS w_median,
  count_if(g > 0) AS n_edges, count_if(g > 0) / count(*) AS sparsity,
  min(g) FILTER (g > 0) AS g_min, max(g) FILTER (g > 0) AS g_max, avg(g) FILTER (g > 0) AS g_mean
  FROM dist_graph GROUP BY grp)
SELECT * FROM es JOIN ds USING (grp)""")
def consensus_properties(spark, d):
    return cns.consensus_properties(_graph(spark, d))


@query("cohort i:i j:i n_subjects:l w_full:r6 w:r6", f"""WITH {o.EDGES},
lv AS (
  SELECT grp || CASE WHEN CAST(subject_id AS INT) < 5 THEN '_AR' ELSE '_CL' END AS cohort, * FROM edges
  UNION ALL SELECT grp, * FROM edges UNION ALL SELECT 'ALL', * FROM edges),
dn AS (SELECT cohort, i, j, count(*) AS n_subjects, abs(tanh(avg({o.fisher('w')}))) AS w_full
       FROM lv GROUP BY cohort, i, j),
lm AS (SELECT cohort, list_reverse_sort(list(w_full))[303] AS s FROM dn GROUP BY cohort)
SELECT dn.*, CASE WHEN w_full > s THEN w_full ELSE 0.0 END AS w FROM dn JOIN lm USING (cohort)""")
def consensus_by_subgroup(spark, d):
    arm = F.when(F.col("subject_id").cast("int") < 5, "AR").otherwise("CL")
    return cns.consensus_by_subgroup(_edges(spark, d).withColumn("subgroup", arm))


@query("grp bin:i n:l lo:r6 hi:r6 c_mean:r6 c_median:r6", f"""WITH {o.EDGES}, {o.BINARIZE},
pos AS (SELECT grp, c FROM binar WHERE c > 0),
sp AS (SELECT grp, min(c) AS lo, max(c) AS hi, avg(c) AS c_mean, quantile_cont(c, 0.5) AS c_median
       FROM pos GROUP BY grp)
SELECT grp, least(CAST(floor((c - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin, count(*) AS n,
       lo, hi, c_mean, c_median FROM pos JOIN sp USING (grp) GROUP BY ALL""")
def consensus_histogram(spark, d):
    return cns.consensus_histogram(_binar(spark, d))


@query("grp n_recovered:r6 n_truth:r6 jaccard:r6", f"""WITH {_GRAPH}, {o.MEAN},
fl AS (SELECT grp, CAST(g > 0 AS INT) AS a, CAST(m.w > 0.15 AS INT) AS b
       FROM dist_graph JOIN cmean m USING (grp, i, j))
SELECT grp, sum(a) AS n_recovered, sum(b) AS n_truth,
       sum(a * b) / nullif(sum(a + b - a * b), 0) AS jaccard FROM fl GROUP BY grp""")
def recovery_jaccard(spark, d):
    truth = cns.consensus_mean(_edges(spark, d)).filter("w > 0.15")
    return cns.recovery_jaccard(_graph(spark, d).filter("g > 0"), truth, 0.15)


# -- graphs ---------------------------------------------------------------------------

_ARCS = """arcs AS (SELECT grp, i, j, g AS w FROM dist_graph
         UNION ALL SELECT grp, j, i, g FROM dist_graph),
deg AS (SELECT grp, i AS node, count_if(w > 0) AS degree, sum(w) AS strength FROM arcs GROUP BY ALL)"""


@query("grp node:i degree:l strength:r6", f"WITH {_GRAPH}, {_ARCS} SELECT * FROM deg")
def degree_strength(spark, d):
    return gr.degree_strength(_graph(spark, d), w="g")


@query("grp degree_min:l degree_median:r6 degree_max:l degree_std:r6 strength_min:r6"
       " strength_median:r6 strength_max:r6", f"""WITH {_GRAPH}, {_ARCS}
SELECT grp, min(degree) AS degree_min, quantile_cont(degree, 0.5) AS degree_median,
       max(degree) AS degree_max, stddev_pop(degree) AS degree_std, min(strength) AS strength_min,
       quantile_cont(strength, 0.5) AS strength_median, max(strength) AS strength_max
FROM deg GROUP BY grp""")
def degree_summary(spark, d):
    return gr.degree_summary(_graph(spark, d), w="g")


@query("grp n_edges:l n_possible:l sparsity_pct:r6 consensus_mean:r6 consensus_median:r6",
       f"""WITH {_GRAPH}
SELECT grp, count_if(g > 0) AS n_edges, count(*) AS n_possible,
       100.0 * count_if(g > 0) / count(*) AS sparsity_pct, avg(c) FILTER (g > 0) AS consensus_mean,
       quantile_cont(c, 0.5) FILTER (g > 0) AS consensus_median FROM dist_graph GROUP BY grp""")
def edge_density(spark, d):
    return gr.edge_density(_graph(spark, d))


_LAP = "lap AS (SELECT grp, i, j, -w AS v FROM arcs UNION ALL SELECT grp, node, node, strength FROM deg)"
_NORM = """nlap AS (SELECT a.grp, a.i, a.j, -a.w / sqrt(p.strength * q.strength) AS v FROM arcs a
  JOIN deg p ON p.grp = a.grp AND p.node = a.i JOIN deg q ON q.grp = a.grp AND q.node = a.j
  UNION ALL SELECT grp, node, node, 1.0 FROM deg)"""


@query("grp i:i j:i v:r6", f"WITH {_GRAPH}, {_ARCS}, {_LAP} SELECT * FROM lap")
def laplacian(spark, d):
    return gr.laplacian(_graph(spark, d), w="g")


@query("kind grp i:i j:i v:r6", f"""WITH {_GRAPH}, {_ARCS}, {_NORM}
SELECT 'adjacency' AS kind, * FROM nlap UNION ALL SELECT 'laplacian', * FROM nlap""")
def laplacian_normalised(spark, d):
    """Both branches: an adjacency matrix and a Laplacian give the same result here."""
    g = _graph(spark, d)
    adj = gr.both_ways(g, w="g").withColumnRenamed("w", "v")
    full = adj.unionByName(g.select("grp", F.explode(F.array("i", "j")).alias("i")).distinct()
                           .select("grp", "i", F.col("i").alias("j"), F.lit(0.0).alias("v")))
    lap = gr.laplacian(g, w="g")
    both = full.withColumn("grp", F.concat(F.lit("adjacency-"), "grp")).unionByName(
        lap.withColumn("grp", F.concat(F.lit("laplacian-"), "grp")))
    out = gr.laplacian_normalised(both)
    return out.select(F.split("grp", "-")[0].alias("kind"), F.split("grp", "-")[1].alias("grp"),
                      "i", "j", "v")


def _basis(spark, d):
    return gr.graph_fourier_basis(gr.normalised_from_edges(_graph(spark, d), w="g"))


@query("grp i:i j:i v:r6", f"WITH {_GRAPH}, {_ARCS}, {_NORM} SELECT * FROM nlap")
def graph_fourier_basis(spark, d):
    """Rebuilds L = U diag(lambda) U' from the eigenpairs; checked against L."""
    b = _basis(spark, d).select("grp", "mode", "lambda", F.posexplode("u").alias("i", "ui"), "u")
    cells = b.select("grp", "i", F.posexplode("u").alias("j", "uj"),
                     (F.col("lambda") * F.col("ui")).alias("x"))
    return cells.groupBy("grp", "i", "j").agg(F.sum(F.col("x") * F.col("uj")).alias("v"))


@query("grp mode:i lambda:r6")
def graph_spectrum(spark, d):
    return _basis(spark, d)


@query("grp trace:r6 energy:r6 near_zero:l", f"""WITH {_GRAPH}, {_ARCS}, {_LAP}
SELECT grp, sum(CASE WHEN i = j THEN v ELSE 0 END) AS trace, sum(v * v) AS energy,
       1 AS near_zero FROM lap GROUP BY grp""")
def spectrum_invariants(spark, d):
    """Sum and square sum of the Laplacian eigenvalues; one zero per component."""
    b = gr.graph_fourier_basis(gr.laplacian(_graph(spark, d), w="g"))
    s = gr.spectrum_summary(b).select("grp", "near_zero")
    return b.groupBy("grp").agg(F.sum("lambda").alias("trace"),
                                F.sum(F.col("lambda") * F.col("lambda")).alias("energy")) \
        .join(s, "grp")


@query("grp lambda_min:r6 lambda_two:r6 lambda_max:r6 lambda_q3:r6 near_zero:l")
def laplacian_spectrum_summary(spark, d):
    return gr.spectrum_summary(gr.graph_fourier_basis(gr.laplacian(_graph(spark, d), w="g")))


_CIRCULANT = f"""{o.EDGES}, {o.BINARIZE},
wd AS (SELECT grp, least(j - i, 64 - (j - i)) AS d, avg(w_full) AS w FROM binar GROUP BY ALL),
ev AS (SELECT grp, k.range AS k, sum(CASE WHEN d = 32 THEN 1 ELSE 2 END * w
         * (1 - cos(2 * pi() * k.range * d / 64))) AS lam FROM wd, range(64) k GROUP BY ALL),
sp AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY lam) - 1 AS mode, lam FROM ev)"""


def _circulant_basis(spark, d):
    """Every pair carries the mean weight at its ring distance, so eigenvalues are cosine sums."""
    gap = F.col("j") - F.col("i")
    same = Window.partitionBy("grp", F.least(gap, N1 - gap))
    ring = _binar(spark, d).select("grp", "i", "j", F.avg("w_full").over(same).alias("w"))
    return gr.graph_fourier_basis(gr.laplacian(cut_lineage(ring)))


@query("grp mode:i lambda:r6", f"""WITH {_CIRCULANT} SELECT grp, mode, lam AS "lambda" FROM sp""")
def circulant_spectrum(spark, d):
    return _circulant_basis(spark, d)


@query("grp lambda_min:r6 lambda_two:r6 lambda_max:r6 lambda_q3:r6 near_zero:l", f"""WITH {_CIRCULANT}
SELECT grp, min(lam) AS lambda_min, max(lam) FILTER (WHERE mode = 1) AS lambda_two, max(lam) AS lambda_max,
       quantile_cont(lam, 0.75) AS lambda_q3, count_if(lam < 1e-5) AS near_zero FROM sp GROUP BY grp""")
def circulant_spectrum_summary(spark, d):
    return gr.spectrum_summary(_circulant_basis(spark, d))


@query("spectrum_r:r6 spectrum_distance:r6", f"""WITH {_CIRCULANT}
SELECT corr(a.lam, b.lam) AS spectrum_r, sqrt(sum((a.lam - b.lam) * (a.lam - b.lam))) AS spectrum_distance
FROM sp a JOIN sp b USING (mode) WHERE a.grp = 'A' AND b.grp = 'B'""")
def circulant_similarity(spark, d):
    return cmp.spectrum_similarity(cut_lineage(_circulant_basis(spark, d)), "A", "B")


@query("grp i:i j:i v:r6", f"""WITH {_CIRCULANT},
low AS (SELECT grp, least(0.0, min(lam)) AS low FROM (SELECT grp, lam - 1.0 AS lam FROM ev) GROUP BY grp),
cell AS (SELECT grp, i, j, -w AS v FROM (SELECT grp, i, j, least(abs(j - i), 64 - abs(j - i)) AS d FROM
           (SELECT DISTINCT grp FROM binar), (SELECT range AS i FROM range(64)), (SELECT range AS j FROM range(64)))
         JOIN wd USING (grp, d)),
diag AS (SELECT grp, i, -sum(v) AS deg FROM cell GROUP BY ALL)
SELECT grp, i, j, v FROM cell
UNION ALL SELECT grp, i, i, deg - 1.0 - low FROM diag JOIN low USING (grp)""")
def psd_shift_lifts(spark, d):
    """The Laplacian less the identity has the eigenvalue -1, so the shift must lift it by that."""
    gap = F.col("j") - F.col("i")
    same = Window.partitionBy("grp", F.least(gap, N1 - gap))
    ring = cut_lineage(_binar(spark, d).select("grp", "i", "j", F.avg("w_full").over(same).alias("w")))
    lap = gr.laplacian(ring).withColumn("v", F.col("v") - (F.col("i") == F.col("j")).cast("double"))
    return gr.psd_shift(lap)


@query("grp i:i j:i v:r6", f"""WITH {_GRAPH}, {_ARCS}, {_LAP} SELECT * FROM lap""")
def psd_shift(spark, d):
    """A Laplacian has no negative eigenvalue, so the shift must leave it as it is."""
    return gr.psd_shift(gr.laplacian(_graph(spark, d), w="g"))


_PAIRS = """pr0 AS (SELECT grp, i, j, w AS d, 1 AS h FROM arcs WHERE w > 0
  UNION ALL SELECT grp, node, node, 0.0, 0 FROM deg)""" + "".join(f""",
pr{k} AS (SELECT a.grp, a.i, b.j, min(a.d + b.d) AS d, min(a.h + b.h) AS h
  FROM pr{k - 1} a JOIN pr{k - 1} b ON a.grp = b.grp AND a.j = b.i GROUP BY ALL)"""
                                                           for k in range(1, 7))


def _pairs(spark, d):
    return gr.all_pairs(_graph(spark, d), w="g")


@query("grp i:i j:i d:r6 h:i", f"WITH {_GRAPH}, {_ARCS}, {_PAIRS} SELECT * FROM pr6")
def all_shortest_paths(spark, d):
    return _pairs(spark, d)


@query("grp path_length:r6 hop_length:r6", f"""WITH {_GRAPH}, {_ARCS}, {_PAIRS}
SELECT grp, avg(d) AS path_length, avg(h) AS hop_length FROM pr6 WHERE i <> j GROUP BY grp""")
def avg_shortest_path(spark, d):
    return gr.avg_shortest_path(_pairs(spark, d))


def _strong(spark, d):
    """A sparser graph that falls into several components."""
    g = _graph(spark, d)
    return g.withColumn("g", F.when(F.col("w_full") > 0.2, F.col("w_full")).otherwise(0.0))


@query("grp component_count:l largest_size:l largest_fraction:r6", f"""WITH RECURSIVE {o.EDGES},
{o.BINARIZE}, st AS (SELECT grp, i, j FROM binar WHERE w_full > 0.2
  UNION ALL SELECT grp, j, i FROM binar WHERE w_full > 0.2),
reach(grp, i, j) AS (
  SELECT DISTINCT grp, i, i FROM (SELECT grp, i FROM binar UNION ALL SELECT grp, j FROM binar)
  UNION SELECT r.grp, r.i, st.j FROM reach r JOIN st ON st.grp = r.grp AND st.i = r.j),
lb AS (SELECT grp, i, min(j) AS c FROM reach GROUP BY ALL),
sz AS (SELECT grp, c, count(*) AS n FROM lb GROUP BY ALL)
SELECT grp, count(*) AS component_count, max(n) AS largest_size, max(n) / sum(n)
       AS largest_fraction FROM sz GROUP BY grp""")
def connected_components(spark, d):
    return gr.component_summary(_strong(spark, d), w="g")


_TRI = """top AS (SELECT grp, max(w) AS m FROM arcs GROUP BY grp),
tri AS (SELECT a.grp, a.i, sum(cbrt(a.w * b.w * c.w)) AS t
        FROM arcs a JOIN arcs b ON a.grp = b.grp AND a.j = b.i
        JOIN arcs c ON c.grp = b.grp AND c.i = b.j AND c.j = a.i
        WHERE a.w > 0 AND b.w > 0 AND c.w > 0 GROUP BY ALL),
clus AS (SELECT d.grp, d.node, CASE WHEN degree > 1 THEN coalesce(t, 0) / m
                / (degree * (degree - 1)) ELSE 0 END AS clustering
         FROM deg d JOIN top USING (grp) LEFT JOIN tri ON tri.grp = d.grp AND tri.i = d.node)"""


@query("grp node:i clustering:r6", f"WITH {_GRAPH}, {_ARCS}, {_TRI} SELECT * FROM clus")
def triangle_clustering(spark, d):
    return gr.clustering_weighted(_graph(spark, d), w="g")


@query("grp clustering:r6", f"""WITH {_GRAPH}, {_ARCS}, {_TRI}
SELECT grp, avg(clustering) AS clustering FROM clus GROUP BY grp""")
def clustering_weighted(spark, d):
    return gr.average_clustering(_graph(spark, d), w="g")


_FLAT = _ARCS.replace("g AS w", "CAST(g > 0 AS DOUBLE) AS w").replace(
    "grp, j, i, g FROM", "grp, j, i, CAST(g > 0 AS DOUBLE) FROM")


@query("grp mean_degree:r6 clustering:r6 hop_length:r6 sigma:r6",
       f"""WITH {_GRAPH}, {_FLAT}, {_PAIRS}, {_TRI},
k AS (SELECT grp, avg(degree) AS k, count(*) AS n FROM deg GROUP BY grp),
c AS (SELECT grp, avg(clustering) AS c FROM clus GROUP BY grp),
l AS (SELECT grp, avg(h) AS l FROM pr6 WHERE i <> j GROUP BY grp)
SELECT grp, k AS mean_degree, c AS clustering, l AS hop_length,
       (c / (k / n)) / (l / (ln(n) / ln(k))) AS sigma FROM k JOIN c USING (grp) JOIN l USING (grp)""")
def small_world_index(spark, d):
    g = _graph(spark, d)
    return gr.small_world_index(g, gr.all_pairs(g, w="g"), w="g")


@query("grp sparsity_pct:r6 n_edges:l n_possible:l degree_min:l degree_median:r6 degree_max:l"
       " degree_std:r6 strength_min:r6 strength_median:r6 strength_max:r6 consensus_mean:r6"
       " consensus_median:r6 clustering:r6 path_length:r6 small_world_sigma:r6 component_count:l"
       " largest_fraction:r6 lambda_min:r6 lambda_two:r6 lambda_max:r6 lambda_q3:r6 near_zero:l")
def graph_summary(spark, d):
    return gr.graph_summary(_graph(spark, d))


_RING = f"""{_CIRCULANT.split('ev AS (')[0].rstrip().rstrip(',')},
dist_graph AS (SELECT b.grp, i, j, wd.w AS c, CASE WHEN wd.d <= 9 THEN wd.w ELSE 0.0 END AS g
  FROM binar b JOIN wd ON wd.grp = b.grp AND wd.d = least(b.j - b.i, 64 - (b.j - b.i))), {_ARCS}, {_PAIRS}, {_TRI},
flat AS (SELECT d.grp, avg(coalesce(n, 0) / (degree * (degree - 1.0))) AS c FROM deg d LEFT JOIN
  (SELECT a.grp, a.i, count(*) AS n FROM arcs a JOIN arcs b ON a.grp = b.grp AND a.j = b.i
   JOIN arcs c ON c.grp = b.grp AND c.i = b.j AND c.j = a.i WHERE a.w > 0 AND b.w > 0 AND c.w > 0 GROUP BY ALL) t
  ON t.grp = d.grp AND t.i = d.node GROUP BY d.grp),
ev AS (SELECT grp, k.range AS k, sum(2 * w * (1 - cos(2 * pi() * k.range * d / 64))) AS lam
       FROM wd, range(64) k WHERE d <= 9 GROUP BY ALL),
sp AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY lam) - 1 AS mode, lam FROM ev),
parts AS (SELECT grp,
  (SELECT struct_pack(sparsity_pct := 100.0 * count_if(g > 0) / count(*), n_edges := count_if(g > 0), n_possible := count(*),
     consensus_mean := avg(c) FILTER (WHERE g > 0), consensus_median := quantile_cont(c, 0.5) FILTER (WHERE g > 0))
   FROM dist_graph x WHERE x.grp = q.grp) AS e,
  (SELECT struct_pack(degree_min := min(degree), degree_median := quantile_cont(degree, 0.5), degree_max := max(degree),
     degree_std := stddev_pop(degree), strength_min := min(strength), strength_median := quantile_cont(strength, 0.5),
     strength_max := max(strength), k := avg(degree), n := count(*)) FROM deg x WHERE x.grp = q.grp) AS s,
  (SELECT avg(clustering) FROM clus x WHERE x.grp = q.grp) AS clustering,
  (SELECT struct_pack(d := avg(d), h := avg(h)) FROM pr6 x WHERE x.grp = q.grp AND i <> j) AS p,
  (SELECT struct_pack(lambda_min := min(lam), lambda_two := max(lam) FILTER (WHERE mode = 1), lambda_max := max(lam),
     lambda_q3 := quantile_cont(lam, 0.75), near_zero := count_if(lam < 1e-5)) FROM sp x WHERE x.grp = q.grp) AS v,
  (SELECT c FROM flat x WHERE x.grp = q.grp) AS c
  FROM (SELECT DISTINCT grp FROM deg) q)"""


@query("grp sparsity_pct:r6 n_edges:l n_possible:l degree_min:l degree_median:r6 degree_max:l"
       " degree_std:r6 strength_min:r6 strength_median:r6 strength_max:r6 consensus_mean:r6"
       " consensus_median:r6 clustering:r6 path_length:r6 small_world_sigma:r6 component_count:l"
       " largest_fraction:r6 lambda_min:r6 lambda_two:r6 lambda_max:r6 lambda_q3:r6 near_zero:l", f"""WITH {_RING}
SELECT grp, e.*, s.*, clustering, p.d AS path_length,
       (c / (s.k / s.n)) / (p.h / (ln(s.n) / ln(s.k))) AS small_world_sigma, 1 AS component_count,
       1.0 AS largest_fraction, v.* FROM parts""")
def graph_summary_circulant(spark, d):
    """The whole summary on ring graphs of the data's mean weights, where every metric has a closed form."""
    gap = F.least(F.col("j") - F.col("i"), N1 - (F.col("j") - F.col("i")))
    same = Window.partitionBy("grp", gap)
    ring = _binar(spark, d).select("grp", "i", "j", F.avg("w_full").over(same).alias("c"))
    return gr.graph_summary(ring.withColumn("g", F.when(gap <= 9, F.col("c")).otherwise(0.0)))


# -- similarity -------------------------------------------------------------------------

@query("subject_id grp pearson_r:r6 spearman_rho:r6 jaccard:r6 cosine:r6 mean_abs_diff:r6 rmsd:r6"
       " shared_edges:l subject_edges:l consensus_edges:l n_edges:l",
       f"WITH {_SCORES} SELECT * FROM scores")
def subject_vs_consensus(spark, d):
    return _scores(spark, d)


@query("subject_id grp pearson_r:r6 pearson_p:r6", f"""WITH {_SCORES},
tt AS (SELECT subject_id, grp, pearson_r, n_edges - 2.0 AS df,
         pearson_r * sqrt((n_edges - 2) / greatest(1 - pearson_r * pearson_r, 1e-300)) AS t_stat FROM scores)
SELECT subject_id, grp, pearson_r, {o.t_tail()} AS pearson_p FROM tt""")
def subject_correlation_p(spark, d):
    return cmp.pearson_p(_scores(spark, d))


def _pair_metric(cols, expr, prep=None):
    def run(spark, d):
        e = cut_lineage(_edges(spark, d))
        al = cmp.align(e, cns.consensus_mean(e), ["grp"])
        al = prep(al) if prep else al
        return al.groupBy("subject_id").agg(*[x.alias(n) for n, x in zip(cols, expr())])
    return run


query("subject_id pearson_r:r6", f"WITH {_SCORES} SELECT subject_id, pearson_r FROM scores",
      "pearson")(_pair_metric(["pearson_r"], lambda: [cmp.pearson()]))
query("subject_id spearman_rho:r6", f"WITH {_SCORES} SELECT subject_id, spearman_rho FROM scores",
      "spearman")(_pair_metric(["spearman_rho"], lambda: [cmp.spearman()],
                               lambda al: cmp.with_ranks(al, ["subject_id"])))
query("subject_id cosine:r6", f"WITH {_SCORES} SELECT subject_id, cosine FROM scores",
      "cosine")(_pair_metric(["cosine"], lambda: [cmp.cosine()]))
query("subject_id mean_abs_diff:r6 rmsd:r6",
      f"WITH {_SCORES} SELECT subject_id, mean_abs_diff, rmsd FROM scores",
      "mean_abs_diff_rmsd")(_pair_metric(["mean_abs_diff", "rmsd"],
                                         lambda: [cmp.mean_abs_diff(), cmp.rmsd()]))
query("subject_id frobenius:r6 frobenius_rel:r6", f"""WITH {_SCORES}
SELECT subject_id, sqrt(2 * sum((a-b)*(a-b))) AS frobenius,
       sqrt(2 * sum((a-b)*(a-b))) / sqrt(2 * sum(a*a)) AS frobenius_rel FROM al GROUP BY ALL""",
      "frobenius")(_pair_metric(["frobenius", "frobenius_rel"],
                                lambda: [cmp.frobenius(), cmp.frobenius(True)]))


@query("rule subject_id jaccard:r6", f"""WITH {_SCORES},
lim AS (SELECT subject_id, list_reverse_sort(list(a)) AS sa, list_reverse_sort(list(b)) AS sb
        FROM al GROUP BY ALL),
fr AS (
  SELECT 'strict_kplus1' AS rule, subject_id, a > sa[303] AS x, b > sb[303] AS y FROM al JOIN lim USING (subject_id)
  UNION ALL SELECT 'ge_kplus1', subject_id, a >= sa[303], b >= sb[303] FROM al JOIN lim USING (subject_id)
  UNION ALL SELECT 'ge_k', subject_id, a >= sa[302], b >= sb[302] FROM al JOIN lim USING (subject_id)
  UNION ALL SELECT 'value', subject_id, a > 0.1, b > 0.1 FROM al)
SELECT rule, subject_id, count_if(x AND y) / nullif(count_if(x OR y), 0) AS jaccard
FROM fr GROUP BY ALL""")
def jaccard_rules(spark, d):
    e = cut_lineage(_edges(spark, d))
    al = cut_lineage(cmp.align(e, cns.consensus_mean(e), ["grp"]))
    out = None
    for rule in ("strict_kplus1", "ge_kplus1", "ge_k", "value"):
        part = cmp.with_kept(al, ["subject_id"], rule, value=0.1).groupBy("subject_id").agg(
            cmp.jaccard(empty=None).alias("jaccard")).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out


@query("subject_id n_any:l n_both:l only_left:l jaccard:r6", f"""WITH {_SCORES}
SELECT subject_id, count_if(a > 0.2 OR b > 0.2) AS n_any, count_if(a > 0.2 AND b > 0.2) AS n_both,
       count_if(a > 0.2 AND NOT b > 0.2) AS only_left,
       count_if(a > 0.2 AND b > 0.2) / count_if(a > 0.2 OR b > 0.2) AS jaccard
FROM al GROUP BY ALL HAVING count_if(a > 0.2 OR b > 0.2) > 0""")
def edge_set_jaccard(spark, d):
    e = cut_lineage(_edges(spark, d))
    al = cut_lineage(cmp.align(e, cns.consensus_mean(e), ["grp"]))
    return cmp.edge_set_jaccard(al.filter("a > 0.2"), al.filter("b > 0.2"), ["subject_id"])


@query("subject_id edges_a:l edges_b:l n_both:l only_a:l only_b:l n_any:l agreement:r6 jaccard:r6 dice:r6"
       " overlap:r6", f"""WITH {_SCORES},
f2 AS (SELECT subject_id, pa <= floor(0.15 * e) AS x, pb <= floor(0.15 * e) AS y FROM rk),
ct AS (SELECT subject_id, count_if(x) AS edges_a, count_if(y) AS edges_b, count_if(x AND y) AS n_both,
  count_if(x AND NOT y) AS only_a, count_if(NOT x AND y) AS only_b, count_if(x OR y) AS n_any,
  avg(CAST(x = y AS INT)) AS agreement FROM f2 GROUP BY ALL)
SELECT *, n_both / n_any AS jaccard, 2.0 * n_both / (edges_a + edges_b) AS dice,
       n_both / least(edges_a, edges_b) AS overlap FROM ct""")
def binary_overlap(spark, d):
    e = cut_lineage(_edges(spark, d))
    al = cmp.align(e, cns.consensus_mean(e), ["grp"])
    return cmp.binary_overlap(cmp.with_kept(al, ["subject_id"], "ge_k"), ["subject_id"])


@query("subject_id mean_diff:r6 std_diff:r6 max_abs_diff:r6 n_different:l pct_different:r6 t_stat:r6",
       f"""WITH {_SCORES},
sd AS (SELECT subject_id, stddev_pop(a) AS s FROM al GROUP BY ALL)
SELECT subject_id, avg(a - b) AS mean_diff, stddev_pop(a - b) AS std_diff,
       max(abs(a - b)) AS max_abs_diff, count_if(abs(a - b) > s) AS n_different,
       100.0 * count_if(abs(a - b) > s) / count(*) AS pct_different,
       avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t_stat
FROM al JOIN sd USING (subject_id) GROUP BY ALL""")
def edge_diff_stats(spark, d):
    e = cut_lineage(_edges(spark, d))
    return cmp.edge_diff_stats(cmp.align(e, cns.consensus_mean(e), ["grp"]), ["subject_id"])


@query("spectrum_r:r6 spectrum_distance:r6")
def spectrum_similarity(spark, d):
    b = cut_lineage(gr.graph_fourier_basis(gr.laplacian(_graph(spark, d), w="g")))
    return cmp.spectrum_similarity(b, "A", "B")


_GVG = f"""{o.EDGES}, {o.MEAN},
al AS (SELECT i, j, x.w AS a, y.w AS b FROM cmean x JOIN cmean y USING (i, j)
       WHERE x.grp = 'A' AND y.grp = 'B'),
rk AS (SELECT *, rank() OVER (ORDER BY a DESC) <= 302 AS in_a, rank() OVER (ORDER BY b DESC) <= 302 AS in_b,
       rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM al),
gvg AS (SELECT 'A-B' AS pair, corr(a, b) AS pearson_r, corr(ra, rb) AS spearman_rho,
  count_if(in_a AND in_b) / count_if(in_a OR in_b) AS jaccard,
  sum(a*b) / (sqrt(sum(a*a)) * sqrt(sum(b*b))) AS cosine, avg(abs(a-b)) AS mean_abs_diff,
  sqrt(avg((a-b)*(a-b))) AS rmsd, sqrt(2*sum((a-b)*(a-b))) AS frobenius,
  sqrt(2*sum((a-b)*(a-b))) / sqrt(2*sum(a*a)) AS frobenius_rel FROM rk)"""


@query("pair pearson_r:r6 spearman_rho:r6 jaccard:r6 cosine:r6 mean_abs_diff:r6 rmsd:r6 frobenius:r6"
       " frobenius_rel:r6", f"WITH {_GVG} SELECT * FROM gvg")
def group_vs_group(spark, d):
    return cmp.group_vs_group(cut_lineage(cns.consensus_mean(_edges(spark, d))), "A", "B")


@query("pair verdict_r verdict_cosine verdict_jaccard verdict_frobenius verdict_overall differ:b",
       f"""WITH {_GVG}
SELECT pair, CASE WHEN pearson_r < 0.7 THEN 'DIFFERENT' ELSE 'SIMILAR' END AS verdict_r,
  CASE WHEN cosine < 0.8 THEN 'DIFFERENT' ELSE 'SIMILAR' END AS verdict_cosine,
  CASE WHEN jaccard < 0.5 THEN 'DIFFERENT' ELSE 'SIMILAR' END AS verdict_jaccard,
  CASE WHEN frobenius_rel > 0.3 THEN 'DIFFERENT' ELSE 'SIMILAR' END AS verdict_frobenius,
  CASE WHEN pearson_r > 0.7 AND jaccard > 0.5 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS verdict_overall,
  pearson_r < 0.5 AS differ FROM gvg""")
def group_verdicts(spark, d):
    g = cmp.group_vs_group(cut_lineage(cns.consensus_mean(_edges(spark, d))), "A", "B")
    labels = fn.metric_verdicts("pearson_r", "cosine", "jaccard", "frobenius_rel")
    return g.select("pair", *[c.alias(n) for n, c in labels.items()],
                    fn.groups_differ("pearson_r").alias("differ"))


@query("subject_id grp pearson_r:r6 jaccard:r6 cosine:r6", "WITH " + _SCORES.replace(
    "JOIN cmean c USING (grp, i, j)",
    "JOIN cmean c ON c.i = e.i AND c.j = e.j AND c.grp <> e.grp") + " SELECT * FROM scores")
def cross_group(spark, d):
    e = cut_lineage(_edges(spark, d))
    return cmp.cross_group(e, cns.consensus_mean(e), {"A": "B", "B": "A"})


_RANKED = f"{_SCORES}, ranked AS (SELECT *, row_number() OVER (ORDER BY pearson_r DESC, subject_id)" \
          " AS rank FROM scores)"


@query("subject_id pearson_r:r6 rank:l", f"WITH {_RANKED} SELECT * FROM ranked")
def rank_subjects(spark, d):
    return cmp.rank_subjects(_scores(spark, d))


@query("subject_id rank:l part", f"""WITH {_RANKED}
SELECT subject_id, rank, 'top' AS part FROM ranked WHERE rank <= 10 UNION ALL
SELECT subject_id, rank, 'bottom' FROM ranked WHERE rank > (SELECT count(*) FROM ranked) - 5""")
def top_and_bottom(spark, d):
    return cmp.top_and_bottom(cmp.rank_subjects(_scores(spark, d)))


@query("subject_id rank:l pick", f"""WITH {_RANKED}, n AS (SELECT count(*) AS n FROM ranked)
SELECT subject_id, rank, CASE WHEN rank = 1 THEN 'best' WHEN rank - 1 = n // 3 THEN 'upper_median'
  WHEN rank - 1 = 2 * n // 3 THEN 'lower_median' ELSE 'worst' END AS pick
FROM ranked, n WHERE rank - 1 IN (0, n // 3, 2 * n // 3, n - 1)""")
def example_picks(spark, d):
    return cmp.example_picks(cmp.rank_subjects(_scores(spark, d)))


@query(_AGREE_COLS, _AGREE_SQL)
def agreement_summary(spark, d):
    return cmp.agreement_summary(_scores(spark, d))


@query("grp bin:i n:l", f"""WITH {_SCORES},
sp AS (SELECT grp, min(pearson_r) AS lo, max(pearson_r) AS hi FROM scores GROUP BY grp)
SELECT grp, least(CAST(floor((pearson_r - lo) / ((hi - lo) / 20)) AS INTEGER), 19) AS bin, count(*) AS n
FROM scores JOIN sp USING (grp) GROUP BY ALL""")
def agreement_histogram(spark, d):
    return cmp.agreement_histogram(cut_lineage(_scores(spark, d)))
