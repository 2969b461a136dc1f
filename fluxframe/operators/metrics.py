"""Measures of a binary classifier and of denoising."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import guarded


def confusion(scored: DataFrame) -> DataFrame:
    """One row (tp, fp, tn, fn) of scored(y_true, y_pred)."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return scored.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def classification_metrics(scored: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall, f1, 0 where they are undefined; specificity and counts only if both classes occur."""
    c = confusion(scored)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    both = ((tp + fn + fp) > 0) & ((tn + fp + fn) > 0)
    count = lambda x: F.when(both, F.col(x))
    return c.select(
        guarded(tp + tn, tp + fp + tn + fn, 0.0).alias("accuracy"), guarded(tp, tp + fp, 0.0).alias("precision"), guarded(tp, tp + fn, 0.0).alias("recall"), guarded(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        F.when(both, guarded(tn, tn + fp, 0.0)).alias("specificity"), count("tp").alias("true_positives"), count("fp").alias("false_positives"), count("tn").alias("true_negatives"), count("fn").alias("false_negatives"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """(y_prob, pos, neg): distinct scores, which is what both curves need; far fewer rows than were scored where scores repeat."""
    return scored.groupBy("y_prob").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))


def _running(counts: DataFrame, buckets: int = 64) -> DataFrame:
    """counts with pos_above and neg_above, inclusive sums from the highest score down, and totals.

    Scores are ranged into buckets of about as many distinct ones, however they lie; each is summed on its own and starts
    from the totals of the buckets above it, so no task orders all scores. Rows without a score are left out.
    """
    counts = counts.filter("y_prob is not null")
    bounds = sorted(set(counts.approxQuantile("y_prob", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    d = counts.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("y_prob"))) if bounds else F.lit(0))
    by = Window.orderBy(F.desc("_b"))
    totals = d.groupBy("_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    base = totals.select("_b", (F.sum("_p").over(by) - F.col("_p")).alias("_p0"), (F.sum("_n").over(by) - F.col("_n")).alias("_n0"), F.sum("_p").over(Window.partitionBy()).alias("P"), F.sum("_n").over(Window.partitionBy()).alias("N"))
    own = Window.partitionBy("_b").orderBy(F.desc("y_prob"))
    return d.join(base, "_b").select("y_prob", "pos", "neg", (F.col("_p0") + F.sum("pos").over(own)).alias("pos_above"), (F.col("_n0") + F.sum("neg").over(own)).alias("neg_above"), "P", "N")


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row auc_roc of scored(y_true, y_prob): a tie counts half. Null where one class is absent."""
    r = _running(_by_score(scored))
    won = F.col("neg") * (F.col("pos_above") - F.col("pos") / 2.0)  # positives above each negative
    return r.agg(F.try_divide(F.sum(won), F.max(F.col("P").cast("double") * F.col("N"))).alias("auc_roc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row average_precision: precision at each distinct score, weighted by the recall that it adds."""
    r = _running(_by_score(scored))
    part = F.col("pos") * F.col("pos_above") / (F.col("pos_above") + F.col("neg_above"))
    return r.agg(F.try_divide(F.sum(part), F.max("P").cast("double")).alias("average_precision"))


def all_metrics(scored: DataFrame) -> DataFrame:
    return classification_metrics(scored).crossJoin(roc_auc(scored)).crossJoin(average_precision(scored))


def metrics_report(scored: DataFrame, names: tuple[str, str] = ("No Transit", "Transit")) -> str:
    """Precision, recall and F1 of both classes as text."""
    r = confusion(scored).first()
    lines = [f"{'':>12}{'precision':>11}{'recall':>11}{'f1-score':>11}{'support':>11}"]
    for name, tp, fp, fn in ((names[0], r["tn"], r["fn"], r["fp"]), (names[1], r["tp"], r["fp"], r["fn"])):
        share = lambda a, b: a / b if b else 0.0
        lines.append(f"{name:>12}{share(tp, tp + fp):>11.2f}{share(tp, tp + fn):>11.2f}{share(2 * tp, 2 * tp + fp + fn):>11.2f}{tp + fn:>11}")
    return "\n".join(lines)


def denoise_quality(pairs: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, mse, noise_reduction_pct) of pairs(key, raw, denoised[, clean]): squared error, and how much the deviation fell."""
    clean = F.col("clean") if "clean" in pairs.columns else F.col("raw")
    raw, new = F.stddev_pop("raw"), F.stddev_pop("denoised")
    return pairs.groupBy(key).agg(F.avg((F.col("denoised") - clean) * (F.col("denoised") - clean)).alias("mse"), guarded(100.0 * (raw - new), raw).alias("noise_reduction_pct"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(label).alias("positive_share"), F.count(F.lit(1)).alias("n"))
