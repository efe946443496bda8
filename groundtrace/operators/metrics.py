"""Counts, metrics and summaries (A1-A11, A14, A15, L6). One aggregation per result."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.functions.text import ratio


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage per label; the total is taken over the few aggregated rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", share.alias("percent"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.select("label", "n", weight.alias("weight"))


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def confusion_cells(truth: Column, predicted: Column, prefix: str = "") -> list[Column]:
    """The four cells as aggregate columns; absent combinations count zero."""
    positive, called = truth == v.MALICIOUS, predicted == v.MALICIOUS
    negative, cleared = truth == v.BENIGN, predicted == v.BENIGN
    return [
        _count_if(positive & called).alias(prefix + "tp"),
        _count_if(negative & called).alias(prefix + "fp"),
        _count_if(negative & cleared).alias(prefix + "tn"),
        _count_if(positive & cleared).alias(prefix + "fn"),
    ]


def rates(prefix: str = "") -> list[Column]:
    """accuracy, precision, recall and F1 from the cells; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(prefix + c) for c in ("tp", "fp", "tn", "fn"))
    return [
        ratio(tp + tn, tp + fp + tn + fn).alias(prefix + "accuracy"),
        ratio(tp, tp + fp).alias(prefix + "precision"),
        ratio(tp, tp + fn).alias(prefix + "recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias(prefix + "f1"),
    ]


def binary_metrics(df: DataFrame, truth: str = "label", predicted: str = "prediction",
                   by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion cells and the four rates, overall or per group."""
    cells = confusion_cells(F.col(truth), F.col(predicted))
    grouped = df.groupBy(*by).agg(*cells)
    return grouped.select("*", *rates())


def class_report(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1 and support plus accuracy, macro and weighted rows (A4)."""
    cells = df.agg(*confusion_cells(F.col(truth), F.col(predicted)))

    def row(name: str, hit: str, false_call: str, miss: str) -> Column:
        h, c, m = F.col(hit), F.col(false_call), F.col(miss)
        return F.struct(
            F.lit(name).alias("row"), ratio(h, h + c).alias("precision"),
            ratio(h, h + m).alias("recall"), ratio(2 * h, 2 * h + c + m).alias("f1"),
            (h + m).alias("support"))

    both = cells.select("*", row(v.BENIGN, "tn", "fn", "fp").alias("neg"),
                        row(v.MALICIOUS, "tp", "fp", "fn").alias("pos"))
    n = F.col("neg")["support"] + F.col("pos")["support"]
    accuracy = ratio(F.col("tp") + F.col("tn"), n)

    def mean(name: str) -> Column:
        return ((F.col("neg")[name] + F.col("pos")[name]) / 2).alias(name)

    def weighted(name: str) -> Column:
        return ratio(F.col("neg")[name] * F.col("neg")["support"]
                     + F.col("pos")[name] * F.col("pos")["support"], n).alias(name)

    names = ("precision", "recall", "f1")
    summary = [
        F.struct(F.lit("accuracy").alias("row"), *[accuracy.alias(x) for x in names],
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), *[mean(x) for x in names], n.alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), *[weighted(x) for x in names],
                 n.alias("support")),
    ]
    return both.select(F.inline(F.array(F.col("neg"), F.col("pos"), *summary)))


def fold_averages(per_fold: DataFrame) -> DataFrame:
    """Mean of the four metrics and the population deviation of F1 over folds (A5)."""
    return per_fold.agg(
        *[F.avg(m).alias(m) for m in ("accuracy", "precision", "recall", "f1")],
        F.stddev_pop("f1").alias("f1_std"))


def outcome_counts(scored: DataFrame) -> DataFrame:
    """Rows per outcome."""
    return scored.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def disagreements_by_technique(disagreements: DataFrame) -> DataFrame:
    """Disagreement count per attack technique, "" where there is none."""
    return disagreements.groupBy("attack_technique").agg(F.count(F.lit(1)).alias("n"))


def first_cases(disagreements: DataFrame, per_technique: int = 5,
                order_by: str = "event_key") -> DataFrame:
    """First cases per technique (W4); each task keeps its own first rows before the shuffle."""
    window = Window.partitionBy("attack_technique").orderBy(order_by)
    return disagreements.withColumn("case_no", F.row_number().over(window)).filter(
        F.col("case_no") <= per_technique)


def z_scores(df: DataFrame, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    """(x - mean) / population deviation, deviation 0 counts as 1.

    The statistics are one row of 2 x columns numbers, read by the driver and used as literals.
    """
    stats = feature_statistics(df, columns)
    return df.select(*keep, *[standardised(c, *stats[c]).alias(c) for c in columns])


TOGETHER = 6  # columns of one aggregation: the code of many more is too long to be compiled to machine code


def feature_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per column. A few columns are read at a time, so ``df`` is best a stored table."""
    found = {}
    for at in range(0, len(columns), TOGETHER):
        some = columns[at:at + TOGETHER]
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(some)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(some)]).first()
        found |= {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(some)}
    return found


def standardised(column: str, mean: float, deviation: float) -> Column:
    # A constant column can leave a rounding residue as its deviation; it counts as 0.
    scale = deviation if deviation > 1e-12 * max(1.0, abs(mean)) else 1.0
    return (F.col(column).cast("double") - F.lit(float(mean))) / F.lit(float(scale))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Per stage: mean, population deviation, extremes, time per row and throughput.

    ``timings`` holds (stage, rows, ms), one row per run.
    """
    spent = F.sum("ms")
    return timings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("ms").alias("mean_ms"),
        F.stddev_pop("ms").alias("std_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        (spent / F.nullif(F.sum("rows"), F.lit(0))).alias("ms_per_row"),
        (F.sum("rows") / F.nullif(spent / 1000.0, F.lit(0.0))).alias("rows_per_sec"),
    )


def cost_comparison(df: DataFrame, reviewer_rate: float = v.REVIEWER_COST_PER_ALERT,
                    model_rate: float = v.MODEL_COST_PER_ALERT) -> DataFrame:
    """Cost of the counted alerts and per million, saving and reduction factor."""
    n = F.col("alerts")
    million = 1_000_000.0
    return df.agg(F.count(F.lit(1)).alias("alerts")).select(
        n,
        (n * reviewer_rate).alias("reviewer_total"),
        (n * model_rate).alias("model_total"),
        F.lit(reviewer_rate * million).alias("reviewer_cost_per_million"),
        F.lit(model_rate * million).alias("model_cost_per_million"),
        F.lit((reviewer_rate - model_rate) * million).alias("savings_per_million"),
        F.lit(reviewer_rate / model_rate).alias("cost_reduction_factor"),
    )


def best_by_f1(sweep: DataFrame, model_id: str = "model_id") -> DataFrame:
    """The model of a sweep with the highest F1; equal scores go to the smaller id."""
    best = F.min_by(F.struct(F.col(model_id), F.col("f1")),
                    F.struct((-F.col("f1")).alias("s"), F.col(model_id).alias("m")))
    return sweep.agg(best.alias("b")).select(
        F.col("b")[model_id].alias(model_id), F.col("b")["f1"].alias("f1"))
