"""Curves, thresholds, reports, sweeps, divergences and tests on a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import SCORED_SQL, logs, on_logs, query, rounded, scored, table
from oddrows.checks.profile import CLASS, union_of
from oddrows.operators import infoloss as il
from oddrows.operators import metrics as mt
from oddrows.operators import stats as st

CURVE = """SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM (
  SELECT score, count(*) FILTER (WHERE evil = 1) AS pos, count(*) FILTER (WHERE evil = 0) AS neg FROM s GROUP BY score)
  WINDOW w AS (ORDER BY score DESC)"""


def on_curve(body, **ctes):
    return on_logs(body, s=SCORED_SQL, c=CURVE, **ctes)


@query("roc_points", on_curve("SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM c"))
def roc_points(spark, sf_dir):
    return rounded(mt.roc_points(scored(spark, sf_dir), "score", "evil"))


@query("pr_points", on_curve("SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM c"))
def pr_points(spark, sf_dir):
    return rounded(mt.pr_points(scored(spark, sf_dir), "score", "evil"))


@query("roc_auc", on_curve("SELECT round(sum(neg / N * (tp + tp - pos) / 2 / P), 6) AS roc_auc FROM c"))
def roc_auc(spark, sf_dir):
    return rounded(mt.roc_auc(scored(spark, sf_dir), "score", "evil"))


@query("average_precision", on_curve("SELECT round(sum(pos / P * tp / (tp + fp)), 6) AS average_precision FROM c"))
def average_precision(spark, sf_dir):
    return rounded(mt.average_precision(scored(spark, sf_dir), "score", "evil"))


PR_STEPS = "SELECT tp / P AS r, tp / (tp + fp) AS p, coalesce(lag(tp / P) OVER (ORDER BY score DESC), 0) AS r0, coalesce(lag(tp / (tp + fp)) OVER (ORDER BY score DESC), 1) AS p0 FROM c"


@query("pr_auc", on_curve("SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS pr_auc FROM pr", pr=PR_STEPS))
def pr_auc(spark, sf_dir):
    return rounded(mt.pr_auc(scored(spark, sf_dir), "score", "evil"))


@query("best_f1_threshold", on_curve("SELECT score AS threshold, round(2 * tp / (P + tp + fp), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM c ORDER BY 2 * tp / (P + tp + fp) DESC, score DESC LIMIT 1"))
def best_f1_threshold(spark, sf_dir):
    return rounded(mt.best_f1_threshold(scored(spark, sf_dir), "score", "evil"))


def grid_sql(n, hi):
    return f"""SELECT threshold, sum(evil) FILTER (WHERE score > threshold) AS tp, count(*) FILTER (WHERE score > threshold) AS flagged, sum(evil) AS P
      FROM s, (SELECT lo + i * ((hi - lo) / {n - 1}) AS threshold FROM (SELECT min(score) AS lo, {hi} AS hi FROM s), (SELECT unnest(range({n})) AS i)) GROUP BY threshold"""


GRID_OUT = "SELECT round(threshold, 9) AS threshold, coalesce(round(CASE WHEN flagged > 0 THEN tp / flagged ELSE 0 END, 6), 0) AS precision, coalesce(round(tp / P, 6), 0) AS recall, coalesce(round(2 * tp / (P + flagged), 6), 0) AS f1 FROM g"


@query("threshold_grid", on_logs(GRID_OUT, s=SCORED_SQL, g=grid_sql(100, "max(score)")))
def threshold_grid(spark, sf_dir):
    df = mt.threshold_grid(scored(spark, sf_dir), "score", "evil", 100)
    return df.select(F.round("threshold", 9).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("best_f1_grid", on_logs(GRID_OUT + " ORDER BY coalesce(2 * tp / (P + flagged), 0) DESC, g.threshold LIMIT 1", s=SCORED_SQL, g=grid_sql(1000, "quantile_cont(score, 0.999)")))
def best_f1_grid(spark, sf_dir):
    df = mt.best_f1_threshold(scored(spark, sf_dir), "score", "evil", mode="grid", n=1000, upper_pct=99.9)
    return df.select(F.round("threshold", 9).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


PRED = "SELECT *, CAST(score > 1 AS INT) AS pred FROM s"
CONF = "SELECT count(*) FILTER (WHERE evil = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE evil = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE evil = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE evil = 1 AND pred = 1) AS tp FROM p"


def predicted(spark, sf_dir):
    return mt.apply_threshold(scored(spark, sf_dir), "score", 1.0, inclusive=False)


@query("apply_threshold", on_logs("SELECT id, pred FROM p", s=SCORED_SQL, p=PRED))
def apply_threshold(spark, sf_dir):
    return predicted(spark, sf_dir).select("id", "pred")


@query("confusion", on_logs(CONF, s=SCORED_SQL, p=PRED))
def confusion(spark, sf_dir):
    return mt.confusion(predicted(spark, sf_dir), "evil", "pred")


@query("confusion_shares", on_logs("SELECT evil AS label, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY evil), 6) AS share FROM p GROUP BY 1, 2", s=SCORED_SQL, p=PRED))
def confusion_shares(spark, sf_dir):
    return rounded(mt.confusion_shares(predicted(spark, sf_dir), "evil", "pred"))


@query("binary_report", on_logs("SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c", s=SCORED_SQL, p=PRED, c=CONF))
def binary_report(spark, sf_dir):
    return rounded(mt.binary_report(predicted(spark, sf_dir), "evil", "pred"))


REPORT = """SELECT class, precision, recall, f1, support FROM r
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r
 UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM r"""
REPORT_ROWS = """SELECT k AS class, tp / pred AS precision, tp / support AS recall, 2 * tp / (pred + support) AS f1, support, tp FROM (
  SELECT k, count(*) FILTER (WHERE y = k AND p = k) AS tp, count(*) FILTER (WHERE p = k) AS pred, count(*) FILTER (WHERE y = k) AS support
  FROM labels2, (SELECT DISTINCT y AS k FROM labels2) GROUP BY k)"""


@query(
    "class_report",
    f"WITH labels2 AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p FROM labels), r AS ({REPORT_ROWS}) SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM ({REPORT})",
)
def class_report(spark, sf_dir):
    return rounded(mt.class_report(table(spark, sf_dir, "labels"), "quality", "toxic"))


def mi_sql(source, a, b):
    return f"SELECT greatest(sum(n / t * ln(n * t / (na * nb))), 0) AS mi FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t, sum(count(*)) OVER (PARTITION BY {a}) AS na, sum(count(*)) OVER (PARTITION BY {b}) AS nb FROM {source} GROUP BY {a}, {b})"


POSNEG = """round(tp / (tp + fp), 6) AS precision_pos, round(tp / (tp + fn), 6) AS recall_pos, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_pos,
  round(tn / (tn + fn), 6) AS precision_neg, round(tn / (tn + fp), 6) AS recall_neg, round(2 * tn / (2 * tn + fp + fn), 6) AS f1_neg"""


@query("posneg_metrics", on_logs(f"SELECT {POSNEG}, round((SELECT mi FROM m), 6) + 0.0 AS mutual_info FROM c", s=SCORED_SQL, p=PRED, c=CONF, m=mi_sql("p", "evil", "pred")))
def posneg_metrics(spark, sf_dir):
    return rounded(mt.posneg_metrics(predicted(spark, sf_dir), "evil", "pred"))


@query("mutual_information", f"SELECT round(mi, 6) + 0.0 AS mi FROM ({mi_sql('labels', 'quality', 'toxic')})")
def mutual_information(spark, sf_dir):
    return rounded(mt.mutual_information(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("percentile_detection_rates", on_logs(f"SELECT CAST(p AS INT) AS percentile, class, round(avg(CAST(score > cut AS INT)), 6) AS rate FROM (SELECT {CLASS} AS class, score FROM s), q GROUP BY p, class", s=SCORED_SQL, q="SELECT unnest(range(100)) AS p, unnest((SELECT quantile_cont(score, " + str([p / 100 for p in range(100)]) + ") FROM s)) AS cut"))
def percentile_detection_rates(spark, sf_dir):
    return rounded(mt.percentile_detection_rates(scored(spark, sf_dir), "score"))


SWEEP = """SELECT cutoff, count(*) FILTER (WHERE evil = 0 AND NOT f) AS tn, count(*) FILTER (WHERE evil = 0 AND f) AS fp,
  count(*) FILTER (WHERE evil = 1 AND NOT f) AS fn, count(*) FILTER (WHERE evil = 1 AND f) AS tp FROM flagged GROUP BY cutoff"""
FRACS = "SELECT i / 100 AS cutoff FROM (SELECT unnest(range(1, 100)) AS i)"


def _mi_term(j, a, b):
    return f"CASE WHEN {j} > 0 THEN {j} / n * ln({j} * n / (({a}) * ({b}))) ELSE 0 END"


SWEEP_MI = " + ".join([_mi_term("tp", "tp + fn", "tp + fp"), _mi_term("fn", "tp + fn", "fn + tn"), _mi_term("fp", "fp + tn", "tp + fp"), _mi_term("tn", "fp + tn", "fn + tn")])
SAFE = POSNEG
for _d in ("(tp + fp)", "(tn + fn)"):
    SAFE = SAFE.replace(f"tp / {_d}", f"CASE WHEN {_d} = 0 THEN 0 ELSE tp / {_d} END").replace(f"tn / {_d}", f"CASE WHEN {_d} = 0 THEN 0 ELSE tn / {_d} END")
SWEEP_OUT = f"SELECT cutoff, {SAFE}, round(greatest({SWEEP_MI}, 0), 6) + 0.0 AS mutual_info FROM (SELECT *, tn + fp + fn + tp AS n FROM w)"


@query(
    "cutoff_sweep",
    on_logs(
        SWEEP_OUT, s=SCORED_SQL, k="SELECT evil, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS total FROM s",
        flagged=f"SELECT cutoff, evil, r <= greatest(1, floor(cutoff * total)) AS f FROM k, ({FRACS})", w=SWEEP,
    ),
)
def cutoff_sweep(spark, sf_dir):
    return rounded(mt.cutoff_sweep(scored(spark, sf_dir), "score", "evil", "id"))


@query(
    "quantile_sweep",
    on_logs(
        SWEEP_OUT, s=SCORED_SQL, q="SELECT unnest(" + str([p / 100 for p in range(1, 100)]) + ") AS cutoff, unnest((SELECT quantile_cont(-score, " + str([p / 100 for p in range(1, 100)]) + ") FROM s)) AS cut",
        flagged="SELECT CAST(cutoff AS DOUBLE) AS cutoff, evil, -score < cut AS f FROM s, q", w=SWEEP,
    ),
)
def quantile_sweep(spark, sf_dir):
    return rounded(mt.quantile_sweep(scored(spark, sf_dir).withColumn("ll", -F.col("score")), "ll", "evil"))


@query("membership_sweep", on_logs(SWEEP_OUT, s=SCORED_SQL, flagged=f"SELECT cutoff, evil, 1 / (1 + score) < cutoff AS f FROM s, ({FRACS})", w=SWEEP))
def membership_sweep(spark, sf_dir):
    return rounded(mt.membership_sweep(scored(spark, sf_dir).withColumn("u", 1 / (1 + F.col("score"))), "u", "evil"))


RUN_SWEEPS = "SELECT run, cutoff, sum(evil) FILTER (WHERE f) AS tp, count(*) FILTER (WHERE f) AS fl, sum(evil) AS P FROM flagged GROUP BY run, cutoff"


@query(
    "best_cutoff",
    on_logs(
        "SELECT cutoff, round(f1, 6) AS f1_pos, round(r, 6) AS recall_pos FROM (SELECT cutoff, avg(2 * tp / (P + fl)) AS f1, avg(tp / P) AS r FROM w GROUP BY cutoff) ORDER BY f1 DESC, cutoff LIMIT 1",
        s=SCORED_SQL,
        flagged=f"SELECT id % 3 AS run, cutoff, evil, 1 / (1 + score) < cutoff AS f FROM s, ({FRACS})",
        w="SELECT run, cutoff, coalesce(tp, 0) AS tp, fl, P FROM (" + RUN_SWEEPS + ")",
    ),
)
def best_cutoff(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"u": 1 / (1 + F.col("score")), "run": F.col("id") % 3})
    runs = None
    for r in range(3):
        sweep = mt.membership_sweep(df.filter(F.col("run") == r), "u", "evil")
        runs = sweep if runs is None else runs.unionByName(sweep)
    return rounded(mt.best_cutoff(runs, metrics=["recall_pos"]))


@query("outcome_scores", on_logs("SELECT CASE WHEN evil = 1 AND pred = 1 THEN 'TP' WHEN pred = 1 THEN 'FP' WHEN evil = 0 THEN 'TN' ELSE 'FN' END AS outcome, count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median FROM p GROUP BY 1", s=SCORED_SQL, p=PRED))
def outcome_scores(spark, sf_dir):
    return rounded(mt.outcome_scores(predicted(spark, sf_dir), "score", "evil", "pred"))


RUN_TABLE = "SELECT eventId AS setting, processId % 5 AS run, avg(evil) AS silhouette, avg(amount) / 100 AS mi, sum(sus) AS noise, count(*) AS n, count(DISTINCT userId) AS n_clusters_found FROM logs GROUP BY 1, 2"


@query(
    "combined_score",
    on_logs(
        "SELECT setting, "
        + ", ".join(
            f"round(avg({e}), 6) AS {c}_mean, round(stddev_pop({e}), 6) + 0.0 AS {c}_std"
            for c, e in (("n_clusters_found", "n_clusters_found"), ("silhouette", "silhouette"), ("mi", "mi"), ("combined_score", "silhouette + mi"), ("noise_percentage", "noise * 100.0 / n"))
        )
        + " FROM t GROUP BY setting",
        t=RUN_TABLE,
    ),
)
def combined_score(spark, sf_dir):
    t = logs(spark, sf_dir).groupBy(F.col("eventId").alias("setting"), (F.col("processId") % 5).alias("run")).agg(
        F.avg("evil").alias("silhouette"), (F.avg("amount") / 100).alias("mi"), F.sum("sus").alias("noise"), F.count("*").alias("n"), F.count_distinct("userId").alias("n_clusters_found")
    )
    return rounded(mt.combined_score(t, ["setting"]))


SETTINGS = "SELECT eventId AS setting, round(avg(evil) + avg(sus), 6) AS m1, round(avg(amount), 6) AS m2 FROM logs GROUP BY 1"
NORMAL = "SELECT setting, (m1 - min(m1) OVER ()) / (max(m1) OVER () - min(m1) OVER ()) + (m2 - min(m2) OVER ()) / (max(m2) OVER () - min(m2) OVER ()) AS v FROM t"


@query(
    "best_settings",
    on_logs(
        "SELECT * FROM (SELECT 'm1' AS metric, setting, m1 AS value FROM t ORDER BY m1 DESC, setting DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'm2', setting, m2 FROM t ORDER BY m2 DESC, setting DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'normalized sum', setting, round(v, 6) FROM n ORDER BY v DESC, setting DESC LIMIT 1)",
        t=SETTINGS,
        n=NORMAL,
    ),
)
def best_settings(spark, sf_dir):
    t = logs(spark, sf_dir).groupBy(F.col("eventId").alias("setting")).agg(F.round(F.avg("evil") + F.avg("sus"), 6).alias("m1"), F.round(F.avg("amount"), 6).alias("m2"))
    return rounded(mt.best_settings(t, "setting", ["m1", "m2"]))


EMBED = "SELECT label, round(avg(quality), 6) AS silhouette, round(avg(toxic), 6) AS same_class, round(count(*) / 100, 6) AS separation FROM (SELECT doc_id % 9 AS label, quality, toxic FROM labels) GROUP BY label"
EMBED_METRICS = ["silhouette", "same_class", "separation"]
EMBED_BEST = " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, label, {m} AS value FROM t ORDER BY {m} DESC, label DESC LIMIT 1)" for m in EMBED_METRICS)
EMBED_SUM = " + ".join(f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())" for m in EMBED_METRICS)


@query("embedding_best", f"WITH t AS ({EMBED}), n AS (SELECT label, {EMBED_SUM} AS v FROM t) {EMBED_BEST} UNION ALL SELECT * FROM (SELECT 'normalized sum', label, round(v, 6) FROM n ORDER BY v DESC, label DESC LIMIT 1)")
def embedding_best(spark, sf_dir):
    """Settings (here: shards of the label table) compared by three embedding-quality figures."""
    t = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 9).alias("label")).agg(
        F.round(F.avg("quality"), 6).alias("silhouette"), F.round(F.avg("toxic"), 6).alias("same_class"), F.round(F.count("*") / 100, 6).alias("separation")
    )
    return rounded(mt.best_settings(t, "label", EMBED_METRICS))


DETECTORS = {"distance": "score", "returned": "abs(returnValue)", "event": "eventId"}
LONG = " UNION ALL ".join(f"SELECT '{k}' AS detector, CAST({e} AS DOUBLE) AS score, evil FROM j" for k, e in DETECTORS.items())
DCURVE = """SELECT detector, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg, sum(pos) OVER a AS P, sum(neg) OVER a AS N FROM (
  SELECT detector, score, count(*) FILTER (WHERE evil = 1) AS pos, count(*) FILTER (WHERE evil = 0) AS neg FROM l GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY detector ORDER BY score DESC), a AS (PARTITION BY detector)"""
DSTEPS = "SELECT *, 2 * tp / (P + tp + fp) AS f, coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY detector ORDER BY score DESC), 1) AS p0 FROM c"


def detectors(spark, sf_dir):
    more = logs(spark, sf_dir).select("id", F.abs("returnValue").cast("double").alias("returned"), F.col("eventId").cast("double").alias("event"))
    return scored(spark, sf_dir).withColumnRenamed("score", "distance").join(more, "id")


def on_detectors(body):
    return on_logs(body, s=SCORED_SQL, j="SELECT s.*, returnValue, eventId FROM s JOIN logs USING (id)", l=LONG, c=DCURVE, d=DSTEPS)


@query(
    "compare_detectors",
    on_detectors(
        "SELECT detector, round(sum(neg / N * (2 * tp - pos) / 2 / P), 6) AS roc_auc, round(sum(pos / P * tp / (tp + fp)), 6) AS average_precision, round(sum(pos / P * (tp / (tp + fp) + p0) / 2), 6) AS pr_auc, round(max(f), 6) AS best_f1, round(arg_max(score, (f, score)), 6) AS best_threshold FROM d GROUP BY detector"
    ),
)
def compare_detectors(spark, sf_dir):
    return rounded(mt.detector_table(detectors(spark, sf_dir), list(DETECTORS), "evil", "id"))


@query("detector_curves", on_detectors("SELECT detector, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM c"))
def detector_curves(spark, sf_dir):
    return rounded(mt.detector_curves(detectors(spark, sf_dir), list(DETECTORS), "evil", "id"))


# --- information loss ----------------------------------------------------------------------------

NUM = ["amount", "returnValue", "argsNum"]
HALF = "id % 3 = 0 OR amount > 80"


@query("histogram", on_logs("SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(49)) AS b) LEFT JOIN (SELECT CAST(least(48, floor(amount / 245.0 * 49)) AS BIGINT) AS b, count(*) AS n FROM logs WHERE amount BETWEEN 0 AND 245 GROUP BY 1) USING (b)"))
def histogram(spark, sf_dir):
    return il.histogram(logs(spark, sf_dir), "amount", 0.0, 245.0)


def _density(c):
    return f"""SELECT '{c}' AS feature, b, n_a / sum(n_a) OVER () / width + 1e-10 AS a, n_b / sum(n_b) OVER () / width + 1e-10 AS b2 FROM (
      SELECT i AS b, (hi - lo) / 49 AS width, count(*) FILTER (WHERE cell = i) AS n_a, count(*) FILTER (WHERE cell = i AND half) AS n_b FROM
      (SELECT lo, hi, {HALF} AS half, least(48, floor(({c} - lo) / (hi - lo) * 49)) AS cell FROM logs, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM logs)), (SELECT unnest(range(49)) AS i) GROUP BY i, lo, hi)"""


DENSITY = " UNION ALL ".join(_density(c) for c in NUM)
PQ = "SELECT feature, a / sum(a) OVER (PARTITION BY feature) AS p, b2 / sum(b2) OVER (PARTITION BY feature) AS q FROM dens"


def halves(spark, sf_dir):
    df = logs(spark, sf_dir)
    return df, df.filter(HALF)


@query("kl_divergence", on_logs("SELECT feature, round(sum(p * ln(p / q)), 6) AS kl FROM pq GROUP BY feature", dens=DENSITY, pq=PQ))
def kl_divergence(spark, sf_dir):
    return rounded(il.kl_divergence(*halves(spark, sf_dir), NUM))


@query("js_divergence", on_logs("SELECT feature, round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 6) AS js FROM pq GROUP BY feature", dens=DENSITY, pq=PQ))
def js_divergence(spark, sf_dir):
    return rounded(il.js_divergence(*halves(spark, sf_dir), NUM))


@query("class_ratio_diff", on_logs(f"SELECT round(a, 6) AS ratio_a, round(b, 6) AS ratio_b, round(abs(a - b), 6) AS class_ratio_diff FROM (SELECT avg(evil) AS a, avg(evil) FILTER (WHERE {HALF}) AS b FROM logs)"))
def class_ratio_diff(spark, sf_dir):
    return rounded(il.class_ratio_diff(*halves(spark, sf_dir), "evil"))


# --- tests ---------------------------------------------------------------------------------------

WELCH = """SELECT '{c}' AS feature, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
  power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS dof, abs((a.m - b.m) / (sqrt(a.v) + 1e-6)) AS effect_size
  FROM (SELECT avg({c}) AS m, var_samp({c}) AS v, count(*) AS n FROM logs WHERE evil = 1) a, (SELECT avg({c}) AS m, var_samp({c}) AS v, count(*) AS n FROM logs WHERE evil = 0) b"""


@query("welch_t", on_logs("SELECT feature, round(t, 6) AS t, round(dof, 4) AS dof, round(effect_size, 6) AS effect_size FROM (" + union_of(NUM, WELCH) + ")"))
def welch_t(spark, sf_dir):
    out = st.welch_t(logs(spark, sf_dir), "evil", NUM)
    return out.select("feature", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"), F.round("effect_size", 6).alias("effect_size"))


CHI = """SELECT sum(power(abs(o - e) - least({y}, abs(o - e)), 2) / e) AS chi2 FROM (SELECT g.x, g.z, coalesce(o, 0) AS o, g.r * g.c / g.t AS e FROM
  (SELECT * FROM (SELECT {a} AS x, count(*) AS r FROM {s} GROUP BY 1), (SELECT {b} AS z, count(*) AS c FROM {s} GROUP BY 1), (SELECT count(*) AS t FROM {s})) g
  LEFT JOIN (SELECT {a} AS x, {b} AS z, count(*) AS o FROM {s} GROUP BY 1, 2) h ON g.x = h.x AND g.z = h.z)"""


@query("chi2_independence", f"SELECT round(chi2, 6) AS chi2, 1.0::DOUBLE AS dof FROM ({CHI.format(y=0.5, a='quality', b='toxic', s='labels')})")
def chi2_independence(spark, sf_dir):
    return rounded(st.chi2_independence(table(spark, sf_dir, "labels"), "quality", "toxic").select("chi2", "dof"))


@query("chi2_wide", on_logs(f"SELECT round(chi2, 6) AS chi2, 4.0::DOUBLE AS dof FROM ({CHI.format(y=0, a='sus', b='processName', s='logs')})"))
def chi2_wide(spark, sf_dir):
    return rounded(st.chi2_independence(logs(spark, sf_dir), "sus", "processName").select("chi2", "dof"))


EFFECTS = (
    " UNION ALL ".join(f"SELECT feature, 'numeric' AS type, effect_size FROM ({WELCH.format(c=c)})" for c in ("amount", "returnValue"))
    + f" UNION ALL SELECT 'argsNum', 'categorical', chi2 FROM ({CHI.format(y=0, a='evil', b='argsNum', s='logs')})"
    + f" UNION ALL SELECT 'sus', 'categorical', chi2 FROM ({CHI.format(y=0.5, a='evil', b='sus', s='logs')})"
)


@query("cluster_feature_effects", on_logs(f"SELECT 1 AS cluster, feature, type, round(effect_size, 5) AS effect_size FROM ({EFFECTS})"))
def cluster_feature_effects(spark, sf_dir):
    """The tests' effects; the cluster is that of the malicious rows."""
    tests = cluster_feature_tests(spark, sf_dir)
    return tests.select("cluster", "feature", "type", F.round("effect_size", 5).alias("effect_size"))


@query("cluster_feature_tests")
def cluster_feature_tests(spark, sf_dir):
    df = logs(spark, sf_dir).withColumn("cluster", F.when(F.col("eventId") == 1010, 1).otherwise(0))
    return st.cluster_feature_tests(df, "cluster", ["amount", "returnValue", "argsNum", "sus"], [1])


@query(
    "anova_oneway",
    on_logs("SELECT round((sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f FROM (SELECT processName, count(*) AS n, avg(amount) AS m, var_pop(amount) AS v, (SELECT avg(amount) FROM logs) AS g FROM logs GROUP BY processName)"),
)
def anova_oneway(spark, sf_dir):
    return rounded(st.anova_oneway(logs(spark, sf_dir), "processName", "amount").select("f"))


@query(
    "paired_t",
    on_logs(
        "SELECT a, b, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS dof FROM (SELECT p.hostName AS a, q.hostName AS b, p.v - q.v AS d FROM m p JOIN m q ON p.k = q.k AND p.hostName < q.hostName) GROUP BY a, b",
        m="SELECT hostName, processId AS k, avg(amount) AS v FROM logs GROUP BY 1, 2",
    ),
)
def paired_t(spark, sf_dir):
    m = logs(spark, sf_dir).groupBy("hostName", F.col("processId").alias("k")).agg(F.avg("amount").alias("v"))
    return rounded(st.paired_t(m, "hostName", "k", "v").select("a", "b", "t", "dof"))


SHIFT = """SELECT '{c}' AS feature, a.m AS mean_in, b.m AS mean_out, a.m - b.m AS diff, a.s / (b.s + 1e-10) AS std_ratio
  FROM (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM logs WHERE evil = 1) a, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM logs WHERE evil = 0) b"""


@query("cluster_feature_shift", on_logs("SELECT feature, round(mean_in, 6) + 0.0 AS mean_in, round(mean_out, 6) + 0.0 AS mean_out, round(diff, 6) + 0.0 AS diff, round(std_ratio, 6) AS std_ratio, round(abs(diff) * (1 + abs(1 - std_ratio)), 6) AS importance FROM (" + union_of(NUM, SHIFT) + ")"))
def cluster_feature_shift(spark, sf_dir):
    return rounded(st.cluster_feature_shift(logs(spark, sf_dir), "evil", NUM))
