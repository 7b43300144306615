"""Ranking curves, thresholds, confusion-based reports, mutual information.

Curves group equal scores first (map-side combine), then use range-split running totals; a threshold sweep
never rescans the table per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrows.functions.columns import class3, leading, ratio
from oddrows.operators.order import exact_quantiles, quantile_values, range_bounds, running_totals, unpivot

# --- curves --------------------------------------------------------------------------------------


def _score_counts(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("_y"))
    rows = rows.filter("score is not null and not isnan(score)")
    return rows.groupBy(*by, "score").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))


def _class_totals(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return rows.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("_P"), F.count_if(F.col(label) == 0).alias("_N")
    )


def _with_totals(curve: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Curves with the totals of their group; the size met at run time decides on a broadcast."""
    if by:
        return curve.join(totals, list(by))
    p, n = totals.first() or (0, 0)
    return curve.withColumns({"_P": F.lit(p), "_N": F.lit(n)})


def _curve(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    by = list(by)
    counts = _score_counts(df, score, label, by)
    totals = running_totals(counts, "score", ["pos", "neg"], by, descending=True, bounds=range_bounds(df, score))
    return _with_totals(totals, _class_totals(df, score, label, by), by)


def roc_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, highest first: ``(score, tp, fp, tpr, fpr)``."""
    c = _curve(df, score, label, by)
    return c.select(
        *by,
        "score",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        ratio(F.col("cum_pos"), F.col("_P")).alias("tpr"),
        ratio(F.col("cum_neg"), F.col("_N")).alias("fpr"),
    )


def pr_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall when everything at or above each distinct score is flagged."""
    c = _curve(df, score, label, by)
    return c.select(
        *by,
        "score",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        ratio(F.col("cum_pos"), F.col("_P")).alias("recall"),
    )


def _areas(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """ROC area, average precision, PR trapezoid and the best F1, all from one pass over the curve.

    A point's predecessor is its own running total less its own counts, so no second window is needed;
    only the PR trapezoid's anchor (recall 0, precision 1) is special.
    """
    c = _curve(df, score, label, by)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prec0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    d_recall = ratio(F.col("pos"), F.col("_P"))
    f1 = 2 * tp / (F.col("_P") + tp + fp)
    return c.groupBy(*by).agg(
        ratio(F.sum(F.col("neg").cast("double") * (tp + tp0)), F.max(2.0 * F.col("_P") * F.col("_N"))).alias("roc_auc"),
        F.sum(d_recall * prec).alias("average_precision"),
        F.sum(d_recall * (prec + prec0) / 2).alias("pr_auc"),
        F.max_by(F.struct("score", f1.alias("f1"), prec.alias("precision"), ratio(tp, F.col("_P")).alias("recall")), F.struct(f1, "score")).alias("best"),
    )


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return _areas(df, score, label, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return _areas(df, score, label, by).select(*by, "average_precision")


def pr_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return _areas(df, score, label, by).select(*by, "pr_auc")


def best_f1_threshold(
    df: DataFrame, score: str, label: str, mode: str = "scores", n: int = 100, upper_pct: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Threshold of the best F1.

    ``scores``: every distinct score, flagged with ``>=``; the highest such score on ties. ``grid``: n equal
    steps from the minimum to the maximum (or an upper percentile), flagged with ``>``; the lowest on ties.
    """
    if mode == "scores":
        best = _areas(df, score, label, by)
        return best.select(*by, F.col("best.score").alias("threshold"), "best.f1", "best.precision", "best.recall")
    grid = threshold_grid(df, score, label, n, upper_pct)
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold")))
    return grid.agg(best.alias("b")).select("b.*")


def threshold_grid(df: DataFrame, score: str, label: str, n: int = 100, upper_pct: float | None = None) -> DataFrame:
    """Precision, recall and F1 at n equally spaced thresholds (strictly above), from one pass.

    Each row is counted once in the highest threshold it exceeds; reverse running sums over n cells do the rest.
    """
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    if upper_pct is not None:
        hi = quantile_values(df.select(F.col(score).alias("s")), ["s"], [upper_pct / 100.0])["s"][0]
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    spark = df.sparkSession
    grid = spark.range(n).select(F.col("id").alias("i"), (F.lit(float(lo)) + F.col("id") * F.lit(step)).alias("threshold"))
    s = F.col(score).cast("double")

    def edge(k: Column) -> Column:
        return F.lit(float(lo)) + k * F.lit(step)

    guess = F.when(F.lit(step) > 0, F.floor((s - F.lit(float(lo))) / F.lit(step or 1.0))).otherwise(F.lit(n - 1)).cast("long")
    guess = F.least(F.greatest(guess, F.lit(-1)), F.lit(n - 1))
    # division may land one cell off the multiplied-out edge: settle against the edges themselves
    cell = (
        F.when((guess + 1 <= n - 1) & (s > edge(guess + 1)), guess + 1).when((guess >= 0) & ~(s > edge(guess)), guess - 1).otherwise(guess)
    )
    counts = df.groupBy(cell.alias("i")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    every = grid.join(F.broadcast(counts), "i", "full")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("i"))  # n + 1 cells
    run = every.select(
        "i", "threshold", F.sum(F.coalesce("pos", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(w).alias("fp"),
        F.sum(F.coalesce("pos", F.lit(0))).over(Window.partitionBy(F.lit(1))).alias("P"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    return run.filter("i >= 0").select(
        "threshold", ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("P")).alias("recall"), ratio(2 * tp, F.col("P") + tp + fp).alias("f1")
    )


# --- predictions ---------------------------------------------------------------------------------


def apply_threshold(df: DataFrame, score: str, threshold: float, inclusive: bool = True, out: str = "pred") -> DataFrame:
    cond = F.col(score) >= F.lit(threshold) if inclusive else F.col(score) > F.lit(threshold)
    return df.withColumn(out, F.coalesce(cond, F.lit(False)).cast("int"))


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")
    )


def confusion_shares(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Row-normalized confusion: the share of each true class per prediction."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")  # one row per predicted class
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def scores_from_confusion(c: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select(
        *keep,
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def binary_report(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return scores_from_confusion(confusion(df, label, pred, by), by)


def posneg_from_confusion(c: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def mi_term(joint, a, b):
        return F.when(joint > 0, joint / n * F.ln(joint * n / (a * b))).otherwise(0.0)

    mi = (
        mi_term(tp, tp + fn, tp + fp) + mi_term(fn, tp + fn, fn + tn) + mi_term(fp, fp + tn, tp + fp) + mi_term(tn, fp + tn, fn + tn)
    )
    return c.select(
        *keep,
        ratio(tp, tp + fp).alias("precision_pos"),
        ratio(tp, tp + fn).alias("recall_pos"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_pos"),
        ratio(tn, tn + fn).alias("precision_neg"),
        ratio(tn, tn + fp).alias("recall_neg"),
        ratio(2 * tn, 2 * tn + fp + fn).alias("f1_neg"),
        F.greatest(mi, F.lit(0.0)).alias("mutual_info"),
    )


def posneg_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 for both classes, and the mutual information of label and prediction."""
    return posneg_from_confusion(confusion(df, label, pred, by), by)


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with their macro and weighted means and the accuracy."""
    cells = df.groupBy(F.col(label).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("y") == F.col("p")
    roles = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(hit, F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        )
    )
    per = roles.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    per = per.select(
        "class",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )
    ms = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in ms], F.sum("support").alias("support"))
    share = F.col("support") / F.sum("support")
    weighted = per.agg(
        F.lit("weighted avg").alias("class"), *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ms], F.sum("support").alias("support")
    )
    acc = F.sum("tp") / F.sum("support")
    accuracy = per.agg(F.lit("accuracy").alias("class"), *[acc.alias(m) for m in ms], F.sum("support").alias("support"))
    return per.drop("tp").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Natural-log mutual information of two label columns; all counts and margins from one cube."""
    counts = df.select(F.col(a).alias("a"), F.col(b).alias("b")).cube("a", "b").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # sum over pairs of n ln n, less the same over both margins, plus that of the total, all divided by the total
    sign = F.when(F.col("g").isin(0, 3), 1.0).otherwise(-1.0)
    terms = counts.agg(F.sum(sign * F.col("n") * F.ln("n")).alias("s"), F.max(F.when(F.col("g") == 3, F.col("n"))).alias("n"))
    return terms.select(F.greatest(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)), F.lit(0.0)).alias("mi"))


# --- sweeps --------------------------------------------------------------------------------------


def percentile_detection_rates(df: DataFrame, score: str, percentiles: Sequence[int] = tuple(range(100))) -> DataFrame:
    """Share of each class above every percentile of the score: ``(percentile, class, rate)``."""
    cuts = quantile_values(df.select(F.col(score).alias("s")), ["s"], [p / 100 for p in percentiles])["s"]
    classed = df.select(class3().alias("class"), F.col(score).cast("double").alias("s"))
    return _rates_above(classed, list(zip(percentiles, cuts)))


def _above_count(s: Column, cuts: Sequence[float], strict: bool = True) -> Column:
    """How many of the ascending cuts the value exceeds."""
    return leading([F.lit(float(c)) < s if strict else F.lit(float(c)) <= s for c in cuts])


def _rates_above(classed: DataFrame, cuts) -> DataFrame:
    values = [c for _, c in cuts]
    counts = classed.groupBy("class", _above_count(F.col("s"), values).alias("k")).agg(F.count("*").alias("n"))
    # counts: classes x (cuts + 1) rows; a row in cell k is above the first k cuts
    at = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("percentile"), F.lit(i).alias("i")) for i, (p, _) in enumerate(cuts)]))
    spread = counts.withColumn("at", at).select("class", "k", "n", "at.*")
    return spread.groupBy("percentile", "class").agg(
        (F.sum(F.when(F.col("k") > F.col("i"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate")
    )


def _sweep(df: DataFrame, cell: Column, label: str, cuts: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Confusion at every cut from one pass: ``cell`` is the number of leading cuts that flag the row."""
    counts = df.groupBy(*by, cell.alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    listed = counts.withColumn(
        "cut", F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.lit(i).alias("i")) for i, c in enumerate(cuts)]))
    )
    on = F.col("k") > F.col("cut.i")
    c = listed.groupBy(*by, F.col("cut.cut").alias("cutoff")).agg(
        F.sum(F.when(on, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(on, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(on, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(on, 0).otherwise(F.col("neg"))).alias("tn"),
    )
    return posneg_from_confusion(c, [*by, "cutoff"])


FRACTIONS = tuple(i / 100 for i in range(1, 100))


def cutoff_sweep(df: DataFrame, score: str, label: str, id_col: str, fracs: Sequence[float] = FRACTIONS) -> DataFrame:
    """Both-class metrics when the N = max(1, int(frac * n)) highest scores are flagged, ties by key.

    Cut scores are order statistics. Rows tied with a cut score straddle it in key order: a tie value that
    matters gets its key boundaries as order statistics too, so the sweep stays one projection.
    """
    from oddrows.operators.order import order_statistics

    takes: dict = {}

    def ranks(sizes):
        n = sizes.get((0,), 0)
        takes.update({f: max(1, int(f * n)) for f in fracs})
        takes["n"] = n
        return {(0,): [n - takes[f] + 1 for f in fracs]} if n else {}

    stats = {r["rank"]: r for r in order_statistics(df, score, ranks).collect()}
    n = takes["n"]
    cut_of, tie_ranks = {}, {}
    for f in fracs:
        row = stats[n - takes[f] + 1]
        want = takes[f] - (n - row["below"] - row["equal"])
        cut_of[f] = (row["value"], want)
        tie_ranks.setdefault((row["value"],), []).append(want)
    ties = df.filter(F.col(score).isin([v for (v,) in tie_ranks]))
    keys = {(r[score], r["rank"]): r["value"] for r in order_statistics(ties, id_col, lambda s: {g: tie_ranks[g] for g in s}, [score]).collect()}
    ordered = sorted(fracs, key=lambda f: takes[f], reverse=True)
    # flagged sets are nested: the k widest sets that contain the row come first
    s, i = F.col(score), F.col(id_col)
    bounds = [(F.lit(float(cut_of[f][0])), F.lit(keys[cut_of[f]])) for f in ordered]
    cell = leading([(s > at) | ((s == at) & (i <= last)) for at, last in bounds])
    return _sweep(df, cell, label, ordered)


def quantile_sweep(df: DataFrame, loglik: str, label: str, fracs: Sequence[float] = FRACTIONS) -> DataFrame:
    """Metrics when rows below the frac-quantile of a log-likelihood are flagged."""
    cuts = quantile_values(df.select(F.col(loglik).alias("s")), ["s"], list(fracs))["s"]
    ordered = sorted(zip(cuts, fracs), reverse=True)
    s = F.col(loglik).cast("double")
    return _sweep(df, leading([s < F.lit(float(c)) for c, _ in ordered]), label, [f for _, f in ordered])


def membership_sweep(df: DataFrame, membership: str, label: str, fracs: Sequence[float] = FRACTIONS) -> DataFrame:
    """Metrics when rows whose largest membership is below frac are flagged."""
    ordered = sorted(fracs, reverse=True)
    s = F.col(membership).cast("double")
    return _sweep(df, leading([s < F.lit(float(c)) for c in ordered]), label, ordered)


def best_cutoff(runs: DataFrame, cutoff: str = "cutoff", f1: str = "f1_pos", metrics: Sequence[str] = ()) -> DataFrame:
    """Cutoff with the best F1 averaged over runs (lowest on ties) and the averaged metrics there."""
    names = [f1, *[m for m in metrics if m != f1]]
    means = runs.groupBy(cutoff).agg(*[F.avg(m).alias(m) for m in names])
    best = F.max_by(F.struct(cutoff, *names), F.struct(f1, -F.col(cutoff)))
    return means.agg(best.alias("b")).select("b.*")


def outcome(label: str, pred: str) -> Column:
    return (
        F.when((F.col(label) == 1) & (F.col(pred) == 1), "TP")
        .when((F.col(label) == 0) & (F.col(pred) == 1), "FP")
        .when((F.col(label) == 0) & (F.col(pred) == 0), "TN")
        .otherwise("FN")
    )


def outcome_scores(df: DataFrame, score: str, label: str, pred: str) -> DataFrame:
    """Score distribution by outcome: rows, extremes, mean, median."""
    rows = df.select(outcome(label, pred).alias("outcome"), F.col(score).cast("double").alias("score"))
    stats = rows.groupBy("outcome").agg(
        F.count("*").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean")
    )
    med = exact_quantiles(rows, ["score"], [0.5], ["outcome"]).select("outcome", F.col("value").alias("median"))
    return stats.join(F.broadcast(med), "outcome", "left")


def combined_score(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Silhouette plus mutual information and the noise share, averaged over repeats."""
    from oddrows.operators.profile import mean_std_over_runs

    scored = runs.withColumns(
        {"combined_score": F.col("silhouette") + F.col("mi"), "noise_percentage": F.col("noise") * 100.0 / F.col("n")}
    )
    return mean_std_over_runs(scored, keys, ["n_clusters_found", "silhouette", "mi", "combined_score", "noise_percentage"])


def best_settings(table: DataFrame, setting: str, metrics: Sequence[str]) -> DataFrame:
    """Setting with the highest value per metric, and by the sum of min-max normalized metrics."""
    w = Window.partitionBy("metric")  # one row per setting
    long = table.unpivot([setting], list(metrics), "metric", "v")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    normal = long.withColumn("u", F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(0.0))
    best = F.max_by(F.struct(setting, "v"), F.struct("v", setting)).alias("b")
    each = long.groupBy("metric").agg(best).select("metric", f"b.{setting}", F.col("b.v").alias("value"))
    sums = normal.groupBy(setting).agg(F.sum("u").alias("v"))
    total = sums.agg(best).select(F.lit("normalized sum").alias("metric"), f"b.{setting}", F.col("b.v").alias("value"))
    return each.unionByName(total)


def detector_table(df: DataFrame, scores: Sequence[str], label: str, id_col: str) -> DataFrame:
    """Several score columns evaluated together: AUC, AP and best F1 per detector."""
    long = unpivot(df, scores, [id_col, label]).withColumnsRenamed({"feature": "detector", "value": "score"})
    a = _areas(long, "score", label, ["detector"])
    return a.select(
        "detector", "roc_auc", "average_precision", "pr_auc", F.col("best.f1").alias("best_f1"), F.col("best.score").alias("best_threshold")
    )


def detector_curves(df: DataFrame, scores: Sequence[str], label: str, id_col: str) -> DataFrame:
    long = unpivot(df, scores, [id_col, label]).withColumnsRenamed({"feature": "detector", "value": "score"})
    return roc_points(long, "score", label, ["detector"])
