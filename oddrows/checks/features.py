"""Feature derivation, filling, encoding, arguments, time."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import BASE_COLS, BASE_SQL, RAW_BASE_SQL, SCORED_SQL, logs, on_logs, query, rounded, scored, standardized_sql, table
from oddrows.functions import columns as fx
from oddrows.operators import features as ft
from oddrows.operators.order import column_stats, unpivot

NUM = ["amount", "returnValue", "argsNum"]
# Gaps on purpose: one value in seven is missing, one in eleven infinite.
GAPS_SQL = "SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN CAST('inf' AS DOUBLE) WHEN id % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE amount END AS amount, CASE WHEN id % 5 = 0 THEN NULL ELSE processName END AS processName FROM logs"


def gaps(spark, sf_dir):
    return logs(spark, sf_dir).selectExpr(
        "id",
        "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN double('inf') WHEN id % 13 = 0 THEN double('nan') ELSE amount END AS amount",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE processName END AS processName",
    )


@query("flag_in", on_logs("SELECT id, CAST(processId IN (0,1,2) AS INT) AS sys, CAST(processName IN ('bash','ssh','systemd','ls','cat') AS INT) AS common FROM logs"))
def flag_in(spark, sf_dir):
    df = ft.flag_in(logs(spark, sf_dir), "processId", fx.SYSTEM_IDS, "sys")
    return ft.flag_in(df, "processName", fx.COMMON_PROCESSES, "common").select("id", "sys", "common")


@query("flag_threshold", on_logs("SELECT id, CAST(userId < 1000 AS INT) AS sys_user, CAST(userId >= 1000 AS INT) AS real_user FROM logs"))
def flag_threshold(spark, sf_dir):
    df = ft.flag_threshold(logs(spark, sf_dir), "userId", "<", 1000, "sys_user")
    return ft.flag_threshold(df, "userId", ">=", 1000, "real_user").select("id", "sys_user", "real_user")


@query("flag_equals", on_logs("SELECT id, CAST(mountNamespace = 4026531840 AS INT) AS default_mount FROM logs"))
def flag_equals(spark, sf_dir):
    return ft.flag_equals(logs(spark, sf_dir), "mountNamespace", fx.DEFAULT_MOUNT_NAMESPACE, "default_mount").select("id", "default_mount")


@query("sign_bucket", on_logs("SELECT id, CAST(sign(returnValue) AS INT) AS cat FROM logs"))
def sign_bucket(spark, sf_dir):
    return ft.sign_bucket(logs(spark, sf_dir), "returnValue", "cat").select("id", "cat")


@query("flag_error", on_logs("SELECT id, CAST(returnValue < 0 AS INT) AS has_error FROM logs"))
def flag_error(spark, sf_dir):
    return ft.flag_error(logs(spark, sf_dir)).select("id", "has_error")


@query("flag_interaction", on_logs("SELECT id, CAST(userId >= 1000 AND processName IN ('sudo','su','bash') AS INT) AS user_system_process FROM logs"))
def flag_interaction(spark, sf_dir):
    return ft.flag_interaction(logs(spark, sf_dir)).select("id", "user_system_process")


CLASS_SQL = "CASE WHEN evil = 1 THEN 'malicious' WHEN sus = 1 THEN 'suspicious' ELSE 'benign' END"


@query("class3", on_logs(f"SELECT id, {CLASS_SQL} AS class FROM logs"))
def class3(spark, sf_dir):
    return ft.class3(logs(spark, sf_dir)).select("id", "class")


_KINDS = {"processName": "categorical", "hostName": "categorical", "eventName": "categorical", "args": "categorical"}
_LOG = "id timestamp processId parentProcessId userId mountNamespace processName hostName eventId eventName argsNum returnValue args amount sus evil".split()


@query("column_kinds", on_logs(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS non_null, '{_KINDS.get(c, 'numeric')}' AS kind FROM logs" for c in _LOG)))
def column_kinds(spark, sf_dir):
    df = logs(spark, sf_dir)
    long = df.select(*[F.col(c).isNotNull().cast("long").alias(c) for c in df.columns]).unpivot([], df.columns, "feature", "v")
    kind = F.when(F.col("feature").isin(ft.numeric_columns(df)), "numeric").when(F.col("feature").isin(ft.categorical_columns(df)), "categorical")
    return long.groupBy("feature").agg(F.sum("v").alias("non_null")).withColumn("kind", kind)


@query("numeric_columns", on_logs(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean FROM logs" for c in ("processId", "parentProcessId", "userId", "eventId", "argsNum", "returnValue", "amount", "sus", "evil"))))
def numeric_columns(spark, sf_dir):
    df = logs(spark, sf_dir).drop("id", "timestamp", "mountNamespace")
    return rounded(column_stats(df, ft.numeric_columns(df), {"mean": F.avg}), 4)


@query("categorical_columns", on_logs(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n FROM logs" for c in _KINDS)))
def categorical_columns(spark, sf_dir):
    df = logs(spark, sf_dir)
    return unpivot(df, ft.categorical_columns(df), as_type="string").groupBy("feature").agg(F.count_distinct("value").alias("n"))


@query("select_features", on_logs("SELECT id, processId, processName FROM logs"))
def select_features(spark, sf_dir):
    return ft.select_features(logs(spark, sf_dir), prefix="process", keep=["id"])


@query("select_time_features", on_logs("SELECT id, round(timestamp, 6) AS timestamp FROM logs"))
def select_time_features(spark, sf_dir):
    return rounded(ft.select_features(logs(spark, sf_dir), contains=["time", "date"], keep=["id"]))


@query("prefix_columns", on_logs("SELECT id, argsNum AS scaled_argsNum, returnValue AS scaled_returnValue FROM logs"))
def prefix_columns(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", "argsNum", "returnValue")
    return ft.prefix_columns(df, ["argsNum", "returnValue"], "scaled_")


@query("assemble_columns", on_logs("SELECT id, amount, CAST(returnValue < 0 AS INT) AS has_error, evil FROM logs"))
def assemble_columns(spark, sf_dir):
    df = logs(spark, sf_dir)
    return ft.assemble_columns([df.select("id", "amount"), ft.flag_error(df).select("id", "has_error"), df.select("id", "evil")], "id")


@query("train_filter_benign", on_logs("SELECT count(*) AS n, round(avg(amount), 6) AS mean_amount FROM logs WHERE evil = 0 AND sus = 0"))
def train_filter_benign(spark, sf_dir):
    return rounded(ft.train_filter_benign(logs(spark, sf_dir)).agg(F.count("*").alias("n"), F.avg("amount").alias("mean_amount")))


@query(
    "standardize",
    on_logs(f"SELECT id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in NUM)} FROM (SELECT id, {standardized_sql(NUM, 'logs')} FROM logs)"),
)
def standardize(spark, sf_dir):
    return rounded(ft.standardize(logs(spark, sf_dir), NUM).select("id", *NUM))


@query(
    "standardize_if_needed",
    on_logs(
        "SELECT feature, round(m, 6) + 0.0 AS mean, round(s, 6) AS std, CAST(1 AS INT) AS changed FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS m, stddev_pop({c}) AS s FROM z" for c in NUM)
        + ")",
        z=f"SELECT {standardized_sql(NUM, 'logs')} FROM logs",
    ),
)
def standardize_if_needed(spark, sf_dir):
    df, changed = ft.standardize_if_needed(logs(spark, sf_dir), NUM)
    return rounded(ft.scaling_report(df, NUM)).withColumn("changed", F.lit(int(changed)))


@query(
    "inf_to_null",
    on_logs("SELECT id, CASE WHEN isinf(amount) OR isnan(amount) THEN NULL ELSE amount END AS amount, CAST(coalesce(isnan(amount), false) AS INT) AS is_nan FROM gaps", gaps=GAPS_SQL),
)
def inf_to_null(spark, sf_dir):
    # a NaN stays as it is; it is shown by a flag, as engines print it differently
    df = ft.inf_to_null(gaps(spark, sf_dir), ["amount"])
    return df.select("id", F.nanvl("amount", F.lit(None)).alias("amount"), F.coalesce(F.isnan("amount"), F.lit(False)).cast("int").alias("is_nan"))


CLEAN_SQL = "SELECT id, CASE WHEN isinf(amount) OR isnan(amount) THEN NULL ELSE amount END AS amount, processName FROM gaps"


@query(
    "impute_median",
    on_logs("SELECT id, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM clean)), 6) AS amount FROM clean", gaps=GAPS_SQL, clean=CLEAN_SQL),
)
def impute_median(spark, sf_dir):
    return rounded(ft.impute_median(gaps(spark, sf_dir), ["amount"]).select("id", "amount"))


@query(
    "filled_cells",
    on_logs("SELECT 'amount' AS feature, round(quantile_cont(amount, 0.5), 6) AS median, count(*) - count(amount) AS filled FROM clean", gaps=GAPS_SQL, clean=CLEAN_SQL),
)
def filled_cells(spark, sf_dir):
    return rounded(ft.filled_cells(gaps(spark, sf_dir), ["amount"]))


@query(
    "impute_mode",
    on_logs(
        "SELECT id, coalesce(processName, (SELECT processName FROM gaps WHERE processName IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS processName FROM gaps",
        gaps=GAPS_SQL,
    ),
)
def impute_mode(spark, sf_dir):
    return ft.impute_mode(gaps(spark, sf_dir), ["processName"]).select("id", "processName")


@query(
    "nan_to_zero",
    on_logs(
        "SELECT id, CASE WHEN amount IS NULL OR isnan(amount) THEN 0.0 WHEN isinf(amount) THEN NULL ELSE amount END AS amount, CAST(coalesce(isinf(amount), false) AS INT) AS is_inf FROM gaps",
        gaps=GAPS_SQL,
    ),
)
def nan_to_zero(spark, sf_dir):
    df = ft.nan_to_zero(gaps(spark, sf_dir), ["amount"])
    endless = F.abs("amount") == float("inf")
    return df.select("id", F.when(~endless, F.col("amount")).alias("amount"), endless.cast("int").alias("is_inf"))


@query(
    "label_encode",
    on_logs("SELECT id, processName, p.c AS processName_code, hostName, h.c AS hostName_code FROM logs JOIN (SELECT processName AS v, row_number() OVER (ORDER BY processName) - 1 AS c FROM logs GROUP BY 1) p ON processName = p.v JOIN (SELECT hostName AS v, row_number() OVER (ORDER BY hostName) - 1 AS c FROM logs GROUP BY 1) h ON hostName = h.v"),
)
def label_encode(spark, sf_dir):
    return ft.label_encode(logs(spark, sf_dir).select("id", "processName", "hostName"), ["processName", "hostName"])


# 0/1 text per known value in sorted order
HOT = "SELECT id, p.hot AS process_hot, e.hot AS event_hot FROM logs JOIN (SELECT v, (SELECT string_agg(CASE WHEN o.v = k.v THEN '1' ELSE '0' END, ',' ORDER BY o.v) FROM ps o) AS hot FROM ps k) p ON processName = p.v JOIN (SELECT v, (SELECT string_agg(CASE WHEN o.v = k.v THEN '1' ELSE '0' END, ',' ORDER BY o.v) FROM es o) AS hot FROM es k) e ON eventName = e.v"


@query("one_hot", on_logs(HOT, ps="SELECT DISTINCT processName AS v FROM logs", es="SELECT DISTINCT eventName AS v FROM logs"))
def one_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = ft.one_hot(logs(spark, sf_dir).select("id", "processName", "eventName"), ["processName", "eventName"])
    bits = lambda c: F.array_join(F.transform(vector_to_array(c), lambda v: v.cast("int").cast("string")), ",")
    return df.select("id", bits("processName_hot").alias("process_hot"), bits("eventName_hot").alias("event_hot"))


IMPORTANCE = {"amount": 0.5, "returnValue": 0.2, "argsNum": 0.3}


@query("weight_features", on_logs("SELECT id, round(amount * 3.5, 6) AS amount, CAST(returnValue AS DOUBLE) AS returnValue, CAST(argsNum AS DOUBLE) AS argsNum FROM logs"))
def weight_features(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", *[F.col(c).cast("double").alias(c) for c in NUM])
    return rounded(ft.weight_features(df, IMPORTANCE))


@query("log1p_columns", on_logs("SELECT id, round(ln(1 + score), 6) AS score FROM s", s=SCORED_SQL))
def log1p_columns(spark, sf_dir):
    return rounded(ft.log1p_columns(scored(spark, sf_dir).select("id", "score"), ["score"]))


# --- arguments: the log text always holds an int argument and a path argument, or nothing
ARG_VALUES = "regexp_extract_all(args, '''value'': ''?([^''}]*)', 1)"
ARG_NAMES = "regexp_extract_all(args, '''name'': ''?([^''}]*)''', 1)"
ARG_TYPES = "regexp_extract_all(args, '''type'': ''?([^''}]*)''', 1)"
ARGS_SQL = f"SELECT id, {ARG_NAMES} AS names, {ARG_TYPES} AS types, {ARG_VALUES} AS vals FROM logs"


@query("parse_args", on_logs("SELECT id, len(vals) AS n, array_to_string(names, '|') AS names, array_to_string(types, '|') AS types, array_to_string(vals, '|') AS vals FROM a", a=ARGS_SQL))
def parse_args(spark, sf_dir):
    df = ft.parse_args(logs(spark, sf_dir))
    return df.select(
        "id", F.size("parsed").cast("long").alias("n"), *[F.array_join(F.col(f"parsed.{f}"), "|").alias(o) for f, o in (("name", "names"), ("type", "types"), ("value", "vals"))]
    )


@query(
    "flatten_args",
    on_logs("SELECT id, " + ", ".join(f"types[{i + 1}] AS args_type_{i}, vals[{i + 1}] AS args_value_{i}, names[{i + 1}] AS args_name_{i}" for i in range(3)) + " FROM a", a=ARGS_SQL),
)
def flatten_args(spark, sf_dir):
    df = ft.flatten_args(ft.parse_args(logs(spark, sf_dir)), 3)
    return df.select("id", *[f"args_{f}_{i}" for i in range(3) for f in ("type", "value", "name")])


@query(
    "explode_args",
    on_logs(
        "SELECT id, CAST(CASE WHEN len(vals) = 0 THEN NULL ELSE p END AS INT) AS position, names[p + 1] AS name, types[p + 1] AS type, vals[p + 1] AS value FROM (SELECT *, unnest(range(greatest(len(vals), 1))) AS p FROM a)",
        a=ARGS_SQL,
    ),
)
def explode_args(spark, sf_dir):
    return ft.explode_args(ft.parse_args(logs(spark, sf_dir)), "id")


# The same log with a third argument whose value is no JSON, and one more behind it.
ODD_VALUES = ("None", "True", "0x1f", "[1, 2]", "-5")
ODD_PICK = "CASE id % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(ODD_VALUES)) + " END"


@query(
    "parse_odd_args",
    on_logs(
        "SELECT id, len(vals) + 2 AS n, vals[1] AS first_value, replace(" + ODD_PICK + ", '[1, 2]', '[1,2]') AS odd_value, 'odd' AS odd_name, '7' AS last_value FROM a",
        a=ARGS_SQL,
    ),
)
def parse_odd_args(spark, sf_dir):
    odd = F.concat(F.lit("{'name': 'odd', 'type': 'any', 'value': "), F.expr(ODD_PICK), F.lit("}, {'name': 'last', 'type': 'int', 'value': 7}]"))
    text = F.when(F.col("args") == "[]", F.concat(F.lit("["), odd)).otherwise(F.concat(F.regexp_replace("args", r"\]$", ", "), odd))
    df = ft.parse_args(logs(spark, sf_dir).withColumn("args", text))
    at = lambda k, f: F.element_at("parsed", k)[f]
    first = F.when(F.size("parsed") > 2, at(1, "value"))
    return df.select("id", F.size("parsed").cast("long").alias("n"), first.alias("first_value"), at(-2, "value").alias("odd_value"), at(-2, "name").alias("odd_name"), at(-1, "value").alias("last_value"))


@query("args_to_numeric", on_logs("SELECT id, coalesce(TRY_CAST(vals[1] AS DOUBLE), 0) AS args_value_0, coalesce(TRY_CAST(vals[2] AS DOUBLE), 0) AS args_value_1 FROM a", a=ARGS_SQL))
def args_to_numeric(spark, sf_dir):
    cols = ["args_value_0", "args_value_1"]
    return ft.args_to_numeric(ft.flatten_args(ft.parse_args(logs(spark, sf_dir)), 2), cols).select("id", *cols)


PATTERN = fx.SUSPICIOUS_PATTERN


@query("flag_pattern", on_logs(f"SELECT id, CAST(coalesce(regexp_matches(vals[2], '(?i){PATTERN}'), false) AS INT) AS args_value_1_suspicious FROM a", a=ARGS_SQL))
def flag_pattern(spark, sf_dir):
    df = ft.flatten_args(ft.parse_args(logs(spark, sf_dir)), 2)
    return ft.flag_pattern(df, ["args_value_1"]).select("id", "args_value_1_suspicious")


@query("flag_pattern_text", f"SELECT doc_id, CAST(regexp_matches(text, '(?i){PATTERN}') AS INT) AS text_suspicious FROM documents")
def flag_pattern_text(spark, sf_dir):
    return ft.flag_pattern(table(spark, sf_dir, "documents"), ["text"]).select("doc_id", "text_suspicious")


@query("feature_group", on_logs("SELECT split_part(hostName || '_' || processName, '_', 1) AS grp, count(*) AS n FROM logs GROUP BY 1"))
def feature_group(spark, sf_dir):
    name = F.concat_ws("_", "hostName", "processName")
    return logs(spark, sf_dir).groupBy(ft.feature_group(name).alias("grp")).agg(F.count("*").alias("n"))


@query("hour_of_day", on_logs("SELECT id, round((timestamp / 3600.0) % 24, 6) AS hour FROM logs"))
def hour_of_day(spark, sf_dir):
    return rounded(ft.hour_of_day(logs(spark, sf_dir), "timestamp").select("id", "hour"))


@query("to_time", "SELECT event_id AS id, strftime(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'broken' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP), '%Y/%m/%d %H:%M') AS t FROM events")
def to_time(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("raw"))
    return ft.to_time(df, "raw", "parsed").select("id", F.date_format("parsed", "yyyy/MM/dd HH:mm").alias("t"))


RANGE_SQL = "SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM logs"


@query("cut_equal_width", on_logs("SELECT id, CAST(least(24, greatest(1, ceil((timestamp - lo) / ((hi - lo) / 24)))) AS INT) AS bin FROM logs, r", r=RANGE_SQL))
def cut_equal_width(spark, sf_dir):
    return ft.cut_equal_width(logs(spark, sf_dir), "timestamp", 24).select("id", "bin")


@query("cut_edges", on_logs("SELECT id, CAST(CASE WHEN amount > 0 AND amount <= 10 THEN 1 WHEN amount > 10 AND amount <= 50 THEN 2 WHEN amount > 50 AND amount <= 100 THEN 3 END AS INT) AS bin FROM logs"))
def cut_edges(spark, sf_dir):
    return ft.cut_edges(logs(spark, sf_dir), "amount", [0.0, 10.0, 50.0, 100.0]).select("id", "bin")


@query("squared_error", on_logs("SELECT id, round(power(amount - 50, 2) + power(returnValue - 1, 2), 6) AS total, round((power(amount - 50, 2) + power(returnValue - 1, 2)) / 2, 6) AS mean FROM logs"))
def squared_error(spark, sf_dir):
    x, h = [F.col("amount"), F.col("returnValue").cast("double")], [F.lit(50.0), F.lit(1.0)]
    df = logs(spark, sf_dir).select("id", fx.squared_error(x, h).alias("total"), fx.squared_error_arrays(F.array(*x), F.array(*h), mean=True).alias("mean"))
    return rounded(df)


@query("mse_row", on_logs("SELECT id, round((power(amount - 50, 2) + power(returnValue - 1, 2) + power(argsNum - 2, 2)) / 3, 6) AS mse FROM logs"))
def mse_row(spark, sf_dir):
    x, h = [F.col(c).cast("double") for c in NUM], [F.lit(50.0), F.lit(1.0), F.lit(2.0)]
    return rounded(logs(spark, sf_dir).select("id", fx.squared_error(x, h, mean=True).alias("mse")))


@query(
    "kl_gauss",
    on_logs("SELECT id, round(-0.5 * ((1 + lv - m * m - exp(lv)) + (1 - lv - m * m / 4 - exp(-lv))), 6) + 0.0 AS kl FROM (SELECT id, amount / 100 AS m, returnValue / 50.0 AS lv FROM logs)"),
)
def kl_gauss(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", (F.col("amount") / 100).alias("m"), (F.col("returnValue") / 50.0).alias("lv"))
    return rounded(df.select("id", fx.kl_gauss(F.array("m", F.col("m") / -2), F.array("lv", -F.col("lv"))).alias("kl")))


@query("euclidean", on_logs("SELECT id, round(sqrt(power(amount, 2) + power(returnValue, 2)), 6) AS d0, round(least(sqrt(power(amount, 2) + power(returnValue, 2)), sqrt(power(amount - 100, 2) + power(returnValue - 20, 2))), 6) AS dmin FROM logs"))
def euclidean(spark, sf_dir):
    df = logs(spark, sf_dir).withColumn("rv", F.col("returnValue").cast("double"))
    near = F.array_min(fx.center_distances_array(["amount", "rv"], [[0.0, 0.0], [100.0, 20.0]]))
    return rounded(df.select("id", fx.distance_to(["amount", "rv"], [0.0, 0.0]).alias("d0"), near.alias("dmin")))


BASE_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in BASE_COLS)


@query("base_features", on_logs(f"SELECT id, {BASE_ROUNDED}, sus, evil FROM base", raw_base=RAW_BASE_SQL, base=BASE_SQL))
def base_features(spark, sf_dir):
    return rounded(ft.base_features(logs(spark, sf_dir)))
