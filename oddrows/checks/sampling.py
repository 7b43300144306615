"""Seeded samples and splits: md5 order on both engines, so the rows themselves are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import logs, on_logs, query, rounded
from oddrows.operators import sampling as sp
from oddrows.operators.profile import mean_std_over_runs


def key(seed, col="id"):
    return f"md5('{seed}:' || {col})"


def ranked(seed, part="", source="logs", col="id"):
    by = f"PARTITION BY {part} " if part else ""
    return f"SELECT *, row_number() OVER ({by}ORDER BY {key(seed, col)}, {col}) AS r FROM {source}"


@query("sample_n", on_logs("SELECT id, evil FROM ranked WHERE r <= 700", ranked=ranked(42)))
def sample_n(spark, sf_dir):
    return sp.sample_n(logs(spark, sf_dir).select("id", "evil"), "id", 700)


@query("sample_entities", on_logs("SELECT userId, id FROM logs WHERE userId IN (SELECT userId FROM u WHERE r <= 25)", ids="SELECT DISTINCT userId FROM logs", u=ranked(42, source="ids", col="userId")))
def sample_entities(spark, sf_dir):
    return sp.sample_entities(logs(spark, sf_dir).select("userId", "id"), "userId", 25)


# positives: floor of the share; negatives: the rest
STRAT = "SELECT id, evil FROM ranked, (SELECT count(*) AS n, sum(evil) AS p FROM logs) WHERE r <= CASE WHEN evil = 1 THEN floor({n} * (p / n)) ELSE {n} - floor({n} * (p / n)) END"


@query("stratified_sample", on_logs(STRAT.format(n=1500), ranked=ranked(42, "evil")))
def stratified_sample(spark, sf_dir):
    return sp.stratified_sample(logs(spark, sf_dir).select("id", "evil"), "id", "evil", 1500)


CLASS = "CASE WHEN evil = 1 THEN 2 WHEN sus = 1 THEN 1 ELSE 0 END"
# three classes of very different size: floor of 10 % each, then proportional, remainder to the largest first
BALANCED = """SELECT id, cls FROM ranked JOIN (
  SELECT cls, least(c, 60 + floor(c / total * 420) + CASE WHEN place <= 420 - sum(floor(c / total * 420)) OVER () THEN 1 ELSE 0 END) AS q
  FROM (SELECT cls, count(*) AS c, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, cls) AS place FROM k GROUP BY cls)
) USING (cls) WHERE r <= q"""


@query("balanced_stratified_sample", on_logs(BALANCED, k=f"SELECT id, CAST({CLASS} AS INT) AS cls FROM logs", ranked=ranked(7, "cls", "k")))
def balanced_stratified_sample(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", F.when(F.col("evil") == 1, 2).when(F.col("sus") == 1, 1).otherwise(0).alias("cls"))
    return sp.balanced_stratified_sample(df, "id", "cls", 600, seed=7)


# two classes of similar size: rounded share, the larger class takes the difference
PLAIN = """SELECT id, evil FROM ranked, (SELECT round_even(sum(evil) / count(*) * 2000, 0) AS p FROM logs)
  WHERE r <= CASE WHEN evil = 1 THEN p ELSE 2000 - p END"""


@query("balanced_stratified_sample_plain", on_logs(PLAIN, ranked=ranked(42, "evil")))
def balanced_stratified_sample_plain(spark, sf_dir):
    return sp.balanced_stratified_sample(logs(spark, sf_dir).select("id", "evil"), "id", "evil", 2000)


@query("disjoint_split", on_logs("SELECT id, CASE WHEN r <= 500 THEN 'cluster' WHEN r <= 800 THEN 'label' ELSE 'test' END AS part FROM ranked WHERE r <= 1400", ranked=ranked(42)))
def disjoint_split(spark, sf_dir):
    return sp.disjoint_split(logs(spark, sf_dir).select("id"), "id", {"cluster": 500, "label": 300, "test": 600})


@query("train_test", on_logs("SELECT id, evil, CASE WHEN r <= floor(count(*) OVER (PARTITION BY evil) * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS part FROM ranked", ranked=ranked(42, "evil")))
def train_test(spark, sf_dir):
    return sp.train_test(logs(spark, sf_dir).select("id", "evil"), "id", 0.25, "evil")


@query("train_test_plain", on_logs("SELECT id, CASE WHEN r <= floor(count(*) OVER () * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM ranked", ranked=ranked(5)))
def train_test_plain(spark, sf_dir):
    return sp.train_test(logs(spark, sf_dir).select("id"), "id", 0.2, seed=5)


@query("capped_stratified", on_logs(STRAT.format(n=900), ranked=ranked(42, "evil")))
def capped_stratified(spark, sf_dir):
    return sp.capped_stratified(logs(spark, sf_dir).select("id", "evil"), "id", "evil", 900)


# strata: default mount x event-id range of ten x label, at least one row each
STRATA = "SELECT id, evil, CAST(mountNamespace = 4026531840 AS INT) AS flag, CAST(CASE WHEN eventId < 50 THEN floor(eventId / 10) END AS INT) AS ev FROM logs"
MULTI = "SELECT id FROM t UNION ALL SELECT id FROM (" + ranked(43, "", "(SELECT * FROM z WHERE id NOT IN (SELECT id FROM t))") + ") WHERE r <= 800 - (SELECT count(*) FROM t)"


@query(
    "multi_feature_sample",
    on_logs(
        MULTI,
        z=STRATA,
        ranked=ranked(42, "flag, ev, evil", "z"),
        t="SELECT id FROM ranked JOIN (SELECT flag, ev, evil, greatest(1, floor(count(*) / (SELECT count(*) FROM logs) * 800)) AS q FROM z WHERE ev IS NOT NULL GROUP BY ALL) USING (flag, ev, evil) WHERE r <= q",
    ),
)
def multi_feature_sample(spark, sf_dir):
    df = logs(spark, sf_dir).selectExpr(
        "id", "evil", "CAST(mountNamespace = 4026531840 AS INT) AS flag", "CAST(CASE WHEN eventId < 50 THEN floor(eventId / 10) END AS INT) AS ev"
    )
    return sp.multi_feature_sample(df, "id", ["flag", "ev", "evil"], 800).select("id")


ADJUST = """SELECT id, evil, CAST(copy AS INT) AS copy FROM (
  SELECT id, evil, r, c, w, unnest(range(CAST(w // c + CASE WHEN r <= w % c THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM (
    SELECT *, count(*) OVER (PARTITION BY evil) AS c, CASE WHEN evil = 1 THEN 3000 ELSE 2000 END AS w FROM ranked))"""


@query("adjust_class_ratio", on_logs(ADJUST, k="SELECT id, evil FROM logs", ranked=ranked(42, "evil", "k")))
def adjust_class_ratio(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", "evil")
    return sp.adjust_class_ratio(df, "id", "evil", 5000, 0.6)


@query(
    "sample_report",
    on_logs(
        "SELECT class, a.n AS n_original, round(a.n * 100.0 / sum(a.n) OVER (), 6) AS percent_original, coalesce(b.n, 0) AS n_sample, coalesce(round(b.n * 100.0 / sum(b.n) OVER (), 6), 0) AS percent_sample FROM (SELECT evil AS class, count(*) AS n FROM logs GROUP BY 1) a LEFT JOIN (SELECT evil AS class, count(*) AS n FROM ranked WHERE r <= 700 GROUP BY 1) b USING (class)",
        ranked=ranked(42),
    ),
)
def sample_report(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", "evil")
    return rounded(sp.sample_report(df, sp.sample_n(df, "id", 700), "evil"))


REPEAT = " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS repeat, avg(amount) AS amount, avg(returnValue) AS returned FROM ({STRAT.format(n=1000).replace('SELECT id, evil', 'SELECT amount, returnValue').replace('ranked', f'r{i}')})"
    for i in range(3)
)


@query(
    "repeat_samples",
    on_logs(
        "SELECT round(avg(amount), 6) AS amount_mean, round(stddev_pop(amount), 6) AS amount_std, round(avg(returned), 6) + 0.0 AS returned_mean, round(stddev_pop(returned), 6) AS returned_std FROM p",
        **{f"r{i}": ranked(42 + i, "evil") for i in range(3)},
        p=REPEAT,
    ),
)
def repeat_samples(spark, sf_dir):
    def measure(s):
        return s.agg(F.avg("amount").alias("amount"), F.avg("returnValue").alias("returned"))

    df = logs(spark, sf_dir).select("id", "evil", "amount", "returnValue")
    return rounded(mean_std_over_runs(sp.repeat_samples(df, "id", "evil", 1000, 3, measure), [], ["amount", "returned"]))
