"""Feature derivation, scaling, imputation, encoding, argument parsing and time buckets.

Everything that works row by row is a projection, so it also accepts a streaming frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.columns import (
    ARGS_TYPE,
    DEFAULT_MOUNT_NAMESPACE,
    FIRST_REAL_USER,
    INTERACTIVE_PROCESSES,
    SUSPICIOUS_PATTERN,
    SYSTEM_IDS,
    class3 as class3_expr,
    clean_number,
)
from oddrows.operators.order import column_stats, exact_quantiles, quantile_values, row_index, unpivot
from oddrows.session import TASK_ROWS, TASK_ROWS_KEY, at_most, setting, small_join

_COMPARE = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


# --- flags and classes ---------------------------------------------------------------------------


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def flag_in(df: DataFrame, col: str, values: Sequence, out: str) -> DataFrame:
    return df.withColumn(out, _flag(F.col(col).isin(list(values))))


def flag_threshold(df: DataFrame, col: str, op: str, value, out: str) -> DataFrame:
    return df.withColumn(out, _flag(_COMPARE[op](F.col(col), F.lit(value))))


def flag_equals(df: DataFrame, col: str, value, out: str) -> DataFrame:
    return df.withColumn(out, _flag(F.col(col) == F.lit(value)))


def sign_bucket(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.signum(col), F.lit(0.0)).cast("int"))


def flag_error(df: DataFrame, col: str = "returnValue", out: str = "has_error") -> DataFrame:
    return df.withColumn(out, _flag(F.col(col) < 0))


def flag_interaction(
    df: DataFrame, user: str = "userId", process: str = "processName", out: str = "user_system_process"
) -> DataFrame:
    return df.withColumn(out, _flag((F.col(user) >= FIRST_REAL_USER) & F.col(process).isin(list(INTERACTIVE_PROCESSES))))


def class3(df: DataFrame, out: str = "class") -> DataFrame:
    return df.withColumn(out, class3_expr())


def train_filter_benign(df: DataFrame, evil: str = "evil", sus: str | None = "sus") -> DataFrame:
    keep = F.col(evil) == 0
    return df.filter(keep & (F.col(sus) == 0) if sus else keep)


# --- choosing and arranging columns --------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def select_features(
    df: DataFrame,
    exclude: Sequence[str] = ("evil", "sus", "split", "source_file"),
    prefix: str | None = None,
    contains: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """All columns but labels and provenance, or those matched by name prefix / substring."""
    cols = [c for c in df.columns if c not in set(exclude)]
    if prefix is not None:
        cols = [c for c in cols if c.startswith(prefix)]
    if contains:
        cols = [c for c in cols if any(p in c.lower() for p in contains)]
    return df.select(*[k for k in keep if k not in cols], *cols)


def prefix_columns(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in cols})


def assemble_columns(parts: Sequence[DataFrame], id_col: str) -> DataFrame:
    """Put feature blocks of the same rows side by side by key. The keys are unique, so nothing is skewed."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, id_col, "inner")
    return out


def weight_features(
    df: DataFrame, importance: Mapping[str, float], scale: float = 5.0
) -> DataFrame:
    """Multiply features above the median importance by ``importance * scale + 1``."""
    ranked = sorted(importance.values())
    mid = len(ranked) // 2
    median = ranked[mid] if len(ranked) % 2 else (ranked[mid - 1] + ranked[mid]) / 2
    chosen = {c: w * scale + 1 for c, w in importance.items() if w > median}
    cols = [(F.col(c) * F.lit(chosen[c])).alias(c) if c in chosen else F.col(c) for c in df.columns]
    return df.select(*cols)


def log1p_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in cols})


# --- scaling and filling -------------------------------------------------------------------------


def scaling(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one aggregate; constant columns get divisor 1."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    row = df.agg(*aggs).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in cols}


def apply_scaling(df: DataFrame, stats: Mapping[str, tuple[float, float]], prefix: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """(x - mean) / population deviation. The statistics become literals, so scoring is a projection."""
    return apply_scaling(df, scaling(fit_on if fit_on is not None else df, cols), prefix)


def standardize_if_needed(df: DataFrame, cols: Sequence[str], tol: float = 0.01) -> tuple[DataFrame, bool]:
    """Standardize unless the columns already have mean 0 and deviation 1 on average."""
    stats = scaling(df, cols)
    n = len(cols)
    mean_of_means = sum(m for m, _ in stats.values()) / n
    mean_std = sum(s for _, s in stats.values()) / n
    if abs(mean_of_means) < tol and abs(mean_std - 1) < tol:
        return df, False
    return apply_scaling(df, stats), True


def scaling_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, as rows."""
    return column_stats(df, cols, {"mean": F.avg, "std": F.stddev_pop})


def inf_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).cast("double").isin(float("inf"), float("-inf")), F.col(c)) for c in cols})


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cleaned = df.withColumns({c: clean_number(F.col(c)) for c in cols})
    medians = {c: q[0] for c, q in quantile_values(cleaned, cols, [0.5]).items()}
    return cleaned.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()})


def filled_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median used and number of cells it fills, per column that has gaps."""
    cleaned = df.withColumns({c: clean_number(F.col(c)) for c in cols})
    gaps = column_stats(cleaned, cols, {"filled": lambda c: F.count_if(c.isNull())})
    medians = exact_quantiles(cleaned, cols, [0.5]).select("feature", F.col("value").alias("median"))
    return gaps.filter("filled > 0").join(medians, "feature", "left").select("feature", "median", "filled")


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column, smallest on ties: ``(feature, value, n)``."""
    counts = unpivot(df, cols, as_type="string").filter("value is not null").groupBy("feature", "value").count()
    best = F.min_by(F.struct("value", "count"), F.struct((-F.col("count")).alias("c"), "value"))
    return counts.groupBy("feature").agg(best.alias("b")).select("feature", F.col("b.value").alias("value"), F.col("b.count").alias("n"))


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    modes = {r["feature"]: r["value"] for r in most_frequent(df, cols).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c))) for c in cols})


def nan_to_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols})


# --- encoding ------------------------------------------------------------------------------------


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """``(value, code)``: 0..k-1 in sorted order of the values."""
    values = df.select(F.col(col).alias("value")).filter("value is not null").distinct()
    if at_most(values, setting(df.sparkSession, TASK_ROWS_KEY, TASK_ROWS)):
        rank = F.row_number().over(Window.orderBy("value")) - 1  # checked: few distinct values
        return values.select("value", rank.cast("long").alias("code"))
    return row_index(values, "value", out="code")


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Text to code by lookup; the code table is broadcast when its checked size allows."""
    for c in cols:
        codes = label_codes(df, c).select(F.col("value").alias(c), F.col("code").alias(f"{c}{suffix}"))
        df = small_join(df, codes, c)
    return df


def one_hot(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None):
    """Sparse one-hot vectors ``<col>_hot``; a value not seen in the fit becomes the all-zero vector."""
    index = StringIndexer(
        inputCols=list(cols),
        outputCols=[f"{c}_idx" for c in cols],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_hot" for c in cols], dropLast=True, handleInvalid="error"
    )
    model = Pipeline(stages=[index, hot]).fit(fit_on if fit_on is not None else df)
    return model.transform(df).drop(*[f"{c}_idx" for c in cols])


# --- arguments -----------------------------------------------------------------------------------


# One item of an argument list; braces inside of quotes are text.
ARG_ITEM = r"""\{(?:[^{}'"]|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")*\}"""


def _loose_field(item: Column, name: str) -> Column:
    """A field of an item that is no JSON: quoted text, a bracketed list, or whatever stands before the next comma."""
    key = f"""['"]{name}['"]\\s*:\\s*"""
    forms = (r"'((?:[^'\\]|\\.)*)'", r'"((?:[^"\\]|\\.)*)"', r"(\[[^\]]*\]|\([^)]*\))", r"""([^\s,}'"\[(][^,}]*)""")
    found = [F.regexp_extract(item, key + form, 1) for form in forms]
    there = [F.regexp_like(item, F.lit(key + form)) for form in forms]
    out = F.lit(None).cast("string")
    for has, text in reversed(list(zip(there, found))):
        out = F.when(has, F.trim(text)).otherwise(out)
    return out


def parse_args(df: DataFrame, col: str = "args", out: str = "parsed") -> DataFrame:
    """Text list of ``{name, type, value}`` dicts to an array of structs, item by item.

    An item that is no JSON (a value like ``None``, ``True`` or ``0x1f``) is read field by field and keeps such values as text;
    it does not touch its neighbours. Text without items gives an empty array.
    """

    def parsed(item: Column) -> Column:
        # once for all fields: inside of a lambda common expressions are not shared
        json = F.from_json(item, "struct<name: string, type: string, value: string>", {"allowSingleQuotes": "true"})
        return F.struct(item.alias("item"), json.alias("json"))

    def read(both: Column) -> Column:
        return F.struct(*[F.coalesce(both["json"][f], _loose_field(both["item"], f)).alias(f) for f in ("name", "type", "value")])

    items = F.regexp_extract_all(F.col(col), F.lit(ARG_ITEM), F.lit(0))
    return df.withColumn(out, F.coalesce(F.transform(F.transform(items, parsed), read), F.array().cast(ARGS_TYPE)))


def flatten_args(df: DataFrame, max_args: int | None = None, parsed: str = "parsed") -> DataFrame:
    """Positional ``args_type_i / args_value_i / args_name_i`` columns, as many as the longest list has, or ``max_args``."""
    if max_args is None:
        max_args = df.agg(F.max(F.size(parsed))).first()[0] or 0
    cols = {}
    for i in range(max_args):
        item = F.get(F.col(parsed), F.lit(i))
        for field in ("type", "value", "name"):
            cols[f"args_{field}_{i}"] = item[field]
    return df.withColumns(cols)


def explode_args(df: DataFrame, id_col: str, parsed: str = "parsed") -> DataFrame:
    return df.select(id_col, F.posexplode_outer(parsed).alias("position", "arg")).select(
        id_col, "position", "arg.name", "arg.type", "arg.value"
    )


def args_to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in cols})


def flag_pattern(df: DataFrame, cols: Sequence[str], pattern: str = SUSPICIOUS_PATTERN, suffix: str = "_suspicious") -> DataFrame:
    """Case-insensitive regex flag on the raw text."""
    return df.withColumns({f"{c}{suffix}": _flag(F.col(c).rlike(f"(?i){pattern}")) for c in cols})


def feature_group(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


# --- time ----------------------------------------------------------------------------------------


def hour_of_day(df: DataFrame, secs: str, out: str = "hour") -> DataFrame:
    return df.withColumn(out, F.pmod(F.col(secs) / 3600.0, F.lit(24.0)))


def to_time(df: DataFrame, col: str, out: str, fmt: str | None = None) -> DataFrame:
    parsed = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(col))
    return df.withColumn(out, parsed)


def cut_equal_width(df: DataFrame, col: str, n: int, out: str = "bin") -> DataFrame:
    """Right-closed equal-width bins 1..n over the column's range; the minimum falls in bin 1."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None or hi == lo:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(1)))
    width = (float(hi) - float(lo)) / n
    spot = F.ceil((F.col(col) - F.lit(float(lo))) / F.lit(width))
    return df.withColumn(out, F.least(F.lit(n), F.greatest(F.lit(1), spot)).cast("int"))


def cut_edges(df: DataFrame, col: str, edges: Sequence[float], out: str = "bin") -> DataFrame:
    """Right-closed bins between explicit edges, numbered from 1; values outside (or on the first edge) are null."""
    expr = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        expr = F.when((F.col(col) > F.lit(edges[i - 1])) & (F.col(col) <= F.lit(edges[i])), F.lit(i)).otherwise(expr)
    return df.withColumn(out, expr)


# --- the base feature table ----------------------------------------------------------------------

BASE_FEATURES = (
    "isSystemProcess",
    "isSystemParentProcess",
    "isSystemUser",
    "isDefaultMountNamespace",
    "eventId",
    "argsNum",
    "returnValueCat",
)


def raw_base_features(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The seven base features before scaling, with the labels."""
    d = flag_in(df, "processId", SYSTEM_IDS, "isSystemProcess")
    d = flag_in(d, "parentProcessId", SYSTEM_IDS, "isSystemParentProcess")
    d = flag_threshold(d, "userId", "<", FIRST_REAL_USER, "isSystemUser")
    d = flag_equals(d, "mountNamespace", DEFAULT_MOUNT_NAMESPACE, "isDefaultMountNamespace")
    d = sign_bucket(d, "returnValue", "returnValueCat")
    return d.select(id_col, *[F.col(c).cast("double").alias(c) for c in BASE_FEATURES], "sus", "evil")


def base_features(df: DataFrame, id_col: str = "id") -> DataFrame:
    return standardize(raw_base_features(df, id_col), BASE_FEATURES)
