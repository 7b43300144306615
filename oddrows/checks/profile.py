"""Profiling, entities, periods, sequences and top-k reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import BASE_COLS, RAW_BASE_SQL, SCORED_SQL, logs, on_logs, query, rounded, scored, table
from oddrows.operators import features as ft
from oddrows.operators import profile as pf
from oddrows.operators import sequences as sq
from oddrows.operators import topk
from oddrows.operators.joins import nearest_centers as closest_centers

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union_of(cols, body):
    """One SELECT per column, ``{c}`` filled in."""
    return " UNION ALL ".join(body.format(c=c) for c in cols)


@query("table_overview", "SELECT fact, CAST(value AS BIGINT) AS value FROM (SELECT 'rows' AS fact, count(*) AS value FROM lineitem UNION ALL SELECT * FROM (VALUES ('columns', 11), ('type:bigint', 3), ('type:double', 4), ('type:int', 1), ('type:string', 2), ('type:timestamp_ntz', 1)))")
def table_overview(spark, sf_dir):
    return pf.table_overview(table(spark, sf_dir, "lineitem"))


FIRST = " UNION ALL ".join(
    f"SELECT row, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM t" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
)


@query(
    "first_rows",
    "WITH t AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INT) AS row, * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)) " + FIRST,
)
def first_rows(spark, sf_dir):
    return pf.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


DOC = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    "column_bytes",
    union_of(["text", "lang", "source"], "SELECT '{c}' AS feature, CAST(coalesce(sum(octet_length(encode({c}))), 0) AS BIGINT) AS bytes FROM documents")
    + " UNION ALL "
    + union_of(["doc_id", "n_chars"], "SELECT '{c}', CAST(8 * count({c}) AS BIGINT) FROM documents"),
)
def column_bytes(spark, sf_dir):
    return pf.column_bytes(table(spark, sf_dir, "documents"))


@query("duplicate_rows", on_logs(f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) * 100.0 / sum(n), 6) AS percent FROM (SELECT count(*) AS n FROM raw_base GROUP BY {', '.join(BASE_COLS)})", raw_base=RAW_BASE_SQL))
def duplicate_rows(spark, sf_dir):
    return rounded(pf.duplicate_rows(ft.raw_base_features(logs(spark, sf_dir)), BASE_COLS))


@query(
    "missing_profile",
    "SELECT * FROM ("
    + union_of(
        ["quality", "toxic", "n_chars", "lang"],
        "SELECT '{c}' AS feature, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS percent FROM documents LEFT JOIN labels USING (doc_id)",
    )
    + ") WHERE missing > 0",
)
def missing_profile(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(pf.missing_profile(df, ["quality", "toxic", "n_chars", "lang"]))


DESCRIBE = (
    "SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,"
    " round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3,"
    " round(max({c}) - min({c}), 4) AS range, round(stddev_samp({c}) / avg({c}), 4) AS cv FROM "
)


@query("describe_numeric", union_of(LINE, DESCRIBE + "lineitem"))
def describe_numeric(spark, sf_dir):
    return rounded(pf.describe_numeric(table(spark, sf_dir, "lineitem"), LINE), 4)


SKEW = (
    "SELECT '{c}' AS feature, round(avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5), 6) AS skewness"
    " FROM logs, (SELECT avg({c}) AS m FROM logs)"
)


@query("skew_profile", on_logs("SELECT * FROM (" + union_of(["amount", "returnValue", "eventId", "argsNum"], SKEW) + ") WHERE abs(skewness) > 1"))
def skew_profile(spark, sf_dir):
    return rounded(pf.skew_profile(logs(spark, sf_dir), ["amount", "returnValue", "eventId", "argsNum"]))


@query("value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return pf.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("value_counts_top", "SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_counts_top(spark, sf_dir):
    return pf.value_counts(table(spark, sf_dir, "lineitem"), "l_suppkey")


@query(
    "categorical_profile",
    union_of(
        ["lang", "source"],
        "SELECT * FROM (SELECT '{c}' AS feature, (SELECT count(DISTINCT {c}) FROM documents) AS unique_values, {c} AS top_value, count(*) AS top_count, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS top_percent FROM documents WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY top_count DESC, top_value LIMIT 1)",
    ),
)
def categorical_profile(spark, sf_dir):
    return rounded(pf.categorical_profile(table(spark, sf_dir, "documents"), ["lang", "source"]))


@query("feature_ranges", on_logs(union_of(BASE_COLS, "SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, count(DISTINCT {c}) AS distinct_values FROM raw_base"), raw_base=RAW_BASE_SQL))
def feature_ranges(spark, sf_dir):
    return pf.feature_ranges(ft.raw_base_features(logs(spark, sf_dir)), BASE_COLS)


@query("target_distribution", on_logs("SELECT evil AS target, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, round(min(count(*)) OVER () / max(count(*)) OVER (), 6) AS imbalance FROM logs GROUP BY evil"))
def target_distribution(spark, sf_dir):
    return rounded(pf.target_distribution(logs(spark, sf_dir), "evil"))


CLASS = "CASE WHEN evil = 1 THEN 'malicious' WHEN sus = 1 THEN 'suspicious' ELSE 'benign' END"


@query("class_distribution", on_logs(f"SELECT {CLASS} AS class, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM logs GROUP BY 1"))
def class_distribution(spark, sf_dir):
    return rounded(pf.class_distribution(logs(spark, sf_dir)))


CORR_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
    for i, a in enumerate(LINE)
    for j, b in enumerate(LINE)
)


@query("correlation_matrix", CORR_PAIRS)
def correlation_matrix(spark, sf_dir):
    return rounded(pf.correlation_matrix(table(spark, sf_dir, "lineitem"), LINE))


SIGNALS = ["amount", "returnValue", "eventId", "sus", "evil"]
HIGH = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM logs" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :]
)


HOLES = {"l_quantity": "l_linenumber = 2", "l_discount": "l_linenumber = 3", "l_tax": "l_orderkey % 5 = 0"}
HOLED = "SELECT " + ", ".join(f"CASE WHEN {t} THEN NULL ELSE {c} END AS {c}" for c, t in HOLES.items()) + ", l_extendedprice FROM lineitem"


@query(
    "correlation_matrix_nulls",
    f"WITH t AS ({HOLED}) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, round(corr({a}, {b}), 6) + 0.0 AS r FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate([*HOLES, "l_extendedprice"]) for j, b in enumerate([*HOLES, "l_extendedprice"])
    ),
)
def correlation_matrix_nulls(spark, sf_dir):
    holed = table(spark, sf_dir, "lineitem").selectExpr(*[f"CASE WHEN {t} THEN NULL ELSE {c} END AS {c}" for c, t in HOLES.items()], "l_extendedprice")
    return rounded(pf.correlation_matrix(holed, [*HOLES, "l_extendedprice"]))


@query("high_correlations", on_logs(f"SELECT * FROM ({HIGH}) WHERE abs(r) > 0.8"))
def high_correlations(spark, sf_dir):
    return rounded(pf.high_correlations(logs(spark, sf_dir), SIGNALS))


@query("correlation_with", on_logs(union_of(["amount", "returnValue", "argsNum"], "SELECT '{c}' AS feature, round(corr({c}, evil), 6) + 0.0 AS r, round(abs(corr({c}, evil)), 6) AS abs_r FROM logs")))
def correlation_with(spark, sf_dir):
    return rounded(pf.correlation_with(logs(spark, sf_dir), ["amount", "returnValue", "argsNum"], "evil"))


@query("unique_entities", on_logs("SELECT count(DISTINCT userId) AS n_entities FROM logs"))
def unique_entities(spark, sf_dir):
    return pf.unique_entities(logs(spark, sf_dir), "userId")


ENTITY = "SELECT userId, count(*) AS actions, CAST(sum(evil) AS BIGINT) AS evil_actions, avg(evil) AS evil_ratio FROM logs GROUP BY userId"


@query("entity_stats", on_logs("SELECT * REPLACE (round(evil_ratio, 6) AS evil_ratio) FROM e", e=ENTITY))
def entity_stats(spark, sf_dir):
    return rounded(pf.entity_stats(logs(spark, sf_dir), "userId", "evil"))


@query("describe_entities", on_logs(union_of(["actions", "evil_actions", "evil_ratio"], DESCRIBE + "e"), e=ENTITY))
def describe_entities(spark, sf_dir):
    return rounded(pf.describe_entities(logs(spark, sf_dir), "userId", "evil"), 4)


@query("suspicious_entities", on_logs("SELECT * REPLACE (round(evil_ratio, 6) AS evil_ratio) FROM e WHERE evil_ratio > 0.25", e=ENTITY))
def suspicious_entities(spark, sf_dir):
    return rounded(pf.suspicious_entities(logs(spark, sf_dir), "userId", "evil", cut=0.25))


@query(
    "period_activity",
    on_logs(
        "SELECT CAST(p.period AS INT) AS period, coalesce(n_rows, 0) AS n_rows, coalesce(evil_ratio, 0) AS evil_ratio FROM (SELECT unnest(range(1, 25)) AS period) p LEFT JOIN (SELECT CAST(least(24, greatest(1, ceil((timestamp - lo) / ((hi - lo) / 24)))) AS BIGINT) AS period, count(*) AS n_rows, round(avg(evil), 6) AS evil_ratio FROM logs, r GROUP BY 1) b USING (period)",
        r="SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM logs",
    ),
)
def period_activity(spark, sf_dir):
    return rounded(pf.period_activity(logs(spark, sf_dir), "timestamp", "evil"))


@query("hourly_ratio", on_logs("SELECT CAST(ceil(h) AS INT) AS hour_bin, round(avg(evil), 6) AS evil_ratio, count(*) AS n_rows FROM (SELECT evil, (timestamp / 3600.0) % 24 AS h FROM logs) WHERE h > 0 GROUP BY 1"))
def hourly_ratio(spark, sf_dir):
    return rounded(pf.hourly_ratio(logs(spark, sf_dir), "timestamp", "evil"))


@query("time_range", on_logs("SELECT min(timestamp) AS first_time, max(timestamp) AS last_time FROM logs"))
def time_range(spark, sf_dir):
    return pf.time_range(logs(spark, sf_dir), "timestamp")


@query(
    "score_by_class",
    on_logs(
        "SELECT class, count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median FROM b GROUP BY class",
        s=SCORED_SQL,
        b=f"SELECT {CLASS} AS class, score FROM s UNION ALL SELECT 'all', score FROM s",
    ),
)
def score_by_class(spark, sf_dir):
    return rounded(pf.score_by_class(scored(spark, sf_dir), "score"))


@query("crosstab", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab(spark, sf_dir):
    return pf.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


RUNS = "SELECT processName, hostName, avg(amount) AS amount, avg(evil) AS ratio FROM logs GROUP BY 1, 2"


@query("mean_std_over_runs", on_logs("SELECT processName, round(avg(amount), 6) AS amount_mean, round(stddev_pop(amount), 6) AS amount_std, round(avg(ratio), 6) AS ratio_mean, round(stddev_pop(ratio), 6) AS ratio_std FROM runs GROUP BY 1", runs=RUNS))
def mean_std_over_runs(spark, sf_dir):
    runs = logs(spark, sf_dir).groupBy("processName", "hostName").agg(F.avg("amount").alias("amount"), F.avg("evil").alias("ratio"))
    return rounded(pf.mean_std_over_runs(runs, ["processName"], ["amount", "ratio"]))


@query(
    "cluster_composition",
    on_logs("SELECT cluster, count(*) AS n, CAST(sum(evil) AS BIGINT) AS evil_n, round(avg(evil) * 100, 6) AS evil_percent, CAST(avg(evil) * 100 >= 90 AND count(*) >= 20 AND cluster <> -1 AS INT) AS is_evil_cluster FROM (SELECT evil, CAST(CASE WHEN eventId = 1010 THEN 1 WHEN eventId = 42 THEN -1 ELSE 0 END AS INT) AS cluster FROM logs) GROUP BY cluster"),
)
def cluster_composition(spark, sf_dir):
    df = logs(spark, sf_dir).withColumn("cluster", F.when(F.col("eventId") == 1010, 1).when(F.col("eventId") == 42, -1).otherwise(0))
    return rounded(pf.cluster_composition(df, "cluster", "evil"))


@query("label_shares", "SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM embeddings GROUP BY label")
def label_shares(spark, sf_dir):
    return rounded(pf.label_shares(table(spark, sf_dir, "embeddings"), "label"))


DIMS = 64  # components of the given embeddings
AXES = [f"x{i}" for i in range(DIMS)]
EMB = "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS)) + " FROM embeddings"


def embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(AXES)])


@query(
    "centroid_spread",
    "SELECT label, count(*) AS n, " + ", ".join(f"round(avg({x}), 6) + 0.0 AS {x}_mean, round(stddev_samp({x}), 6) AS {x}_std" for x in AXES) + f" FROM ({EMB}) GROUP BY label",
)
def centroid_spread(spark, sf_dir):
    return rounded(pf.centroid_spread(embedded(spark, sf_dir), "label", AXES))


@query(
    "axis_ranges",
    f"WITH e AS ({EMB}) " + union_of(AXES, "SELECT '{c}' AS axis, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(max({c}) - min({c}), 6) AS range, round((max(x0) - min(x0)) / (max({c}) - min({c})), 6) AS aspect FROM e"),
)
def axis_ranges(spark, sf_dir):
    return rounded(pf.axis_ranges(embedded(spark, sf_dir), AXES))


IQR = (
    "SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,"
    " round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6) AS percent"
    " FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"
)


@query("iqr_outliers", union_of(LINE, IQR))
def iqr_outliers(spark, sf_dir):
    return rounded(pf.iqr_outliers(table(spark, sf_dir, "lineitem"), LINE))


@query(
    "feature_group_effects",
    on_logs(
        "SELECT grp, round(total_effect, 6) AS total_effect, n, round(total_effect / n, 6) AS normalized FROM (SELECT split_part(feature, '_', 1) AS grp, sum(effect_size) AS total_effect, count(*) AS n FROM t WHERE p < 0.05 GROUP BY 1) ORDER BY total_effect / n DESC, grp LIMIT 3",
        t="SELECT processName || '_' || hostName AS feature, avg(evil) / 4 AS p, avg(amount) AS effect_size FROM logs GROUP BY 1",
    ),
)
def feature_group_effects(spark, sf_dir):
    t = logs(spark, sf_dir).groupBy(F.concat_ws("_", "processName", "hostName").alias("feature")).agg((F.avg("evil") / 4).alias("p"), F.avg("amount").alias("effect_size"))
    return rounded(pf.feature_group_effects(t))


@query(
    "eda_facts",
    on_logs(
        "SELECT 'rows' AS fact, CAST(count(*) AS DOUBLE) AS value FROM logs UNION ALL SELECT 'columns', 16.0::DOUBLE UNION ALL SELECT 'class ' || evil, CAST(count(*) AS DOUBLE) FROM logs GROUP BY evil UNION ALL SELECT 'entities', CAST(count(DISTINCT userId) AS DOUBLE) FROM logs UNION ALL SELECT 'suspicious entities', CAST(count(*) AS DOUBLE) FROM e WHERE evil_ratio > 0.25",
        e=ENTITY,
    ),
)
def eda_facts(spark, sf_dir):
    return pf.eda_facts(logs(spark, sf_dir), "userId", "evil", cut=0.25)


# --- sequences and reports -----------------------------------------------------------------------

SEQ = "SELECT userId, count(*) AS n, count(*) FILTER (WHERE evil = 1 AND prev = 1) AS consecutive FROM (SELECT userId, evil, lag(evil) OVER (PARTITION BY userId ORDER BY timestamp, id) AS prev FROM logs) GROUP BY userId HAVING count(*) > 1"


@query("consecutive_events", on_logs("SELECT *, round(consecutive / (n - 1), 6) AS ratio FROM q", q=SEQ))
def consecutive_events(spark, sf_dir):
    return rounded(sq.consecutive_events(logs(spark, sf_dir), "userId", "timestamp", "evil", "id"))


@query("suspicious_sequences", on_logs("SELECT *, round(consecutive / (n - 1), 6) AS ratio FROM q WHERE consecutive / (n - 1) > 0.05", q=SEQ))
def suspicious_sequences(spark, sf_dir):
    seq = sq.consecutive_events(logs(spark, sf_dir), "userId", "timestamp", "evil", "id")
    return rounded(sq.suspicious_sequences(seq, "userId", 0.05))


@query("order_sequences", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE f = 1 AND prev = 1) AS consecutive, round(count(*) FILTER (WHERE f = 1 AND prev = 1) / (count(*) - 1), 6) AS ratio FROM (SELECT *, lag(f) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM (SELECT *, CAST(o_orderstatus = 'F' AS INT) AS f FROM orders)) GROUP BY 1 HAVING count(*) > 1")
def order_sequences(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumns({"f": (F.col("o_orderstatus") == "F").cast("int"), "t": F.unix_date(F.col("o_orderdate").cast("date"))})
    return rounded(sq.consecutive_events(df, "o_custkey", "t", "f", "o_orderkey"))


@query("top_anomalies", on_logs("SELECT id, score, evil FROM s ORDER BY score DESC, id LIMIT 20", s=SCORED_SQL))
def top_anomalies(spark, sf_dir):
    return topk.top_anomalies(scored(spark, sf_dir).select("id", "score", "evil"), "score", "id")


@query("flag_top_fraction", on_logs("SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) <= greatest(1, CAST(floor(0.07 * count(*) OVER ()) AS BIGINT)) AS INT) AS pred FROM s", s=SCORED_SQL))
def flag_top_fraction(spark, sf_dir):
    return topk.flag_top_fraction(scored(spark, sf_dir), "score", "id", 0.07).select("id", "pred")


@query("flag_top_fraction_ties", "SELECT l_orderkey, CAST(row_number() OVER (ORDER BY q DESC, l_orderkey) <= CAST(floor(0.13 * count(*) OVER ()) AS BIGINT) AS INT) AS pred FROM (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1)")
def flag_top_fraction_ties(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
    return topk.flag_top_fraction(df, "q", "l_orderkey", 0.13).select("l_orderkey", "pred")


CORR_FRAME = union_of(["amount", "returnValue", "argsNum"], "SELECT '{c}' AS feature, round(corr({c}, evil), 6) + 0.0 AS importance FROM logs")


def corr_frame(spark, sf_dir):
    c = pf.correlation_with(logs(spark, sf_dir), ["amount", "returnValue", "argsNum"], "evil")
    return rounded(c.select("feature", F.col("r").alias("importance")))


@query("rank_features", on_logs("SELECT *, CAST(row_number() OVER (ORDER BY abs(importance) DESC, feature) AS INT) AS rank FROM c", c=CORR_FRAME))
def rank_features(spark, sf_dir):
    return topk.rank_features(corr_frame(spark, sf_dir))


@query("top_features", on_logs("SELECT * FROM c ORDER BY importance DESC, feature LIMIT 2", c=CORR_FRAME))
def top_features(spark, sf_dir):
    return topk.top_features(corr_frame(spark, sf_dir), 2)


@query("top_variance_dims", f"WITH e AS ({EMB}) SELECT feature, round(v, 9) AS variance FROM (" + union_of(AXES, "SELECT '{c}' AS feature, var_samp({c}) AS v FROM e") + ") ORDER BY v DESC, feature LIMIT 2")
def top_variance_dims(spark, sf_dir):
    return rounded(topk.top_variance_dims(embedded(spark, sf_dir), AXES), 9)


@query("closest_to_center", on_logs("SELECT userId, score, id FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY score, id) AS r FROM s) WHERE r = 1", s=SCORED_SQL))
def closest_to_center(spark, sf_dir):
    return topk.closest_to_center(scored(spark, sf_dir), "userId", "score", "id")


CENTER_SQL = (
    f"WITH c AS (SELECT label, {', '.join(f'avg({x}) AS {x}' for x in AXES)} FROM ({EMB}) GROUP BY label), "
    f"d AS (SELECT p.label AS a, q.label AS b, sqrt({' + '.join(f'power(p.{x} - q.{x}, 2)' for x in AXES)}) AS distance FROM c p, c q) "
)


def label_centers(spark, sf_dir):
    return embedded(spark, sf_dir).groupBy("label").agg(*[F.avg(x).alias(x) for x in AXES])


@query("nearest_centers", CENTER_SQL + "SELECT a, b, round(distance, 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM d WHERE a <> b) WHERE r <= 3")
def nearest_centers(spark, sf_dir):
    return rounded(closest_centers(label_centers(spark, sf_dir), "label", AXES, 3))
