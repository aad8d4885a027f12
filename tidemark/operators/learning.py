"""Scores and labels: thresholds, signals, their backtest, classification figures, and the boosted-tree model."""

from __future__ import annotations

import json
import random
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series

#: Threshold search: from 0.51 down to 0.49 in 21 steps.
CANDIDATES = tuple(round(0.51 - 0.001 * k, 3) for k in range(21))
#: Ranges of scores that curves are accumulated in.
RANGES = 64
DEFAULTS = {"long": 0.55, "short": 0.45}


def threshold_table(df: DataFrame, score: str = "score", ret: str = "return_pct", candidates: tuple[float, ...] = CANDIDATES, cost: float = 0.0) -> DataFrame:
    """For each candidate and side (long above it, short below), over returns less ``cost``: trades, win rate, mean, Sharpe, profit factor (0
    without a loss) and combined score, 0.4 mean + 0.4 Sharpe + 0.2 profit factor.

    Rows are counted by how many candidates lie below and above their score, at most two more bins than candidates; a candidate's
    figures are merged from the bins beyond it."""
    places = F.array(*map(F.lit, candidates))
    below, above = F.size(F.filter(places, lambda t: F.col(score) > t)), F.size(F.filter(places, lambda t: F.col(score) < t))
    gains = {"long": F.col(ret) - cost, "short": -F.col(ret) - cost}
    figures = []
    for side, g in gains.items():
        figures += [F.count_if(g > 0).alias(f"{side}_wins"), F.sum(F.when(g > 0, g).otherwise(0.0)).alias(f"{side}_won"), F.sum(F.when(g < 0, -g).otherwise(0.0)).alias(f"{side}_lost"), F.avg(g).alias(f"{side}_m"), F.var_pop(g).alias(f"{side}_v")]
    bins = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).groupBy(below.alias("below"), above.alias("above")).agg(F.count("*").alias("n"), *figures)
    rank = [sum(u < t for u in candidates) for t in candidates]  # a score exceeds t if it exceeds all that are less and t itself
    tries = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold"), F.lit(r).alias("rank")) for k, (t, r) in enumerate(zip(candidates, rank, strict=True)))))
    tried = bins.withColumn("c", tries).select("*", "c.*")
    sides = [tried.where(F.col("below") > F.col("rank") if side == "long" else F.col("above") >= len(candidates) - F.col("rank")).select("k", "threshold", F.lit(side).alias("side"), "n", *(F.col(f"{side}_{c}").alias(c) for c in ("wins", "won", "lost", "m", "v"))) for side in gains]
    both = sides[0].unionByName(sides[1])
    keys = ["k", "threshold", "side"]
    total = both.groupBy(*keys).agg(F.sum("n").alias("all"), F.sum("wins").alias("wins"), F.sum("won").alias("won"), F.sum("lost").alias("lost"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean_return"))
    apart = both.select(*keys, "n", "m", "v").join(total.select(*keys, "mean_return"), keys).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("v") + F.pow(F.col("m") - F.col("mean_return"), F.lit(2)))).alias("squares"))
    out = total.join(apart, keys).withColumn("sd", F.sqrt(F.try_divide("squares", F.col("all") - 1)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns({"sharpe": zero(series.safe_div(F.col("mean_return"), F.col("sd"))), "profit_factor": zero(series.safe_div(F.col("won"), F.col("lost")))})
    combined = 0.4 * F.col("mean_return") + 0.4 * F.col("sharpe") + 0.2 * F.col("profit_factor")
    return out.select(*keys, F.col("all").alias("n"), (F.col("wins") / F.col("all")).alias("win_rate"), "mean_return", "sharpe", "profit_factor", combined.alias("score"))


def best_thresholds(table: DataFrame) -> DataFrame:
    """side, threshold: the best score, of equal ones the first candidate; the default where none is above 0."""
    best = table.groupBy("side").agg(F.max(F.struct("score", (-F.col("k")).alias("k"), "threshold")).alias("b"))
    sides = table.sparkSession.createDataFrame(list(DEFAULTS.items()), "side string, fallback double")
    return sides.join(best, "side", "left").select("side", F.when(F.col("b.score") > 0, F.col("b.threshold")).otherwise(F.col("fallback")).alias("threshold"))


def with_signals(df: DataFrame, long: float, short: float, score: str = "score") -> DataFrame:
    return df.withColumns({"signal_long": (F.col(score) >= long).cast("int"), "signal_short": (F.col(score) <= short).cast("int")})


def signal_backtest(df: DataFrame, keys: list[str], order: list[str], cost: float = 0.0, ret: str = "return_pct") -> DataFrame:
    """Adds pnl (long and short both count), correct flags, and the cumulative P&L, its peak and the drawdown, all additive."""
    gain = F.when(F.col("signal_long") == 1, F.col(ret) - cost).otherwise(0.0) + F.when(F.col("signal_short") == 1, -F.col(ret) - cost).otherwise(0.0)
    so_far = series.ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"pnl": gain, "correct_long": ((F.col("signal_long") == 1) & (F.col(ret) > cost)).cast("int"), "correct_short": ((F.col("signal_short") == 1) & (F.col(ret) < -cost)).cast("int")})
    df = df.withColumn("cum_pnl", F.sum("pnl").over(so_far))
    df = df.withColumn("peak", F.max("cum_pnl").over(so_far))
    return df.withColumn("drawdown", F.col("peak") - F.col("cum_pnl"))


def backtest_metrics(df: DataFrame, keys: list[str], order: str, label: str | None = None, score: str | None = None) -> DataFrame:
    """Figures of a signal backtest by key, ``order`` being a time in microseconds. A row with both signals is two trades; the mean return is over
    all rows, trades or not; without a loss the profit factor is infinite where something was won, else 0. With a label the precision of both
    sides, with a score as well the area under its ROC curve. The annualised return is 0 where all rows have one time."""
    p, zero = F.col("pnl"), lambda c: F.coalesce(c, F.lit(0.0))
    hits = [] if label is None else [F.avg(F.when(F.col("signal_long") == 1, F.col(label).cast("double"))).alias("long_precision"), F.avg(F.when(F.col("signal_short") == 1, 1.0 - F.col(label))).alias("short_precision")]
    out = df.groupBy(*keys).agg(
        F.sum(F.col("signal_long") + F.col("signal_short")).alias("total_trades"), F.sum(F.col("correct_long") + F.col("correct_short")).alias("right"), F.avg("pnl").alias("avg_trade_return"),
        zero(F.avg(F.when(p > 0, p))).alias("avg_win"), zero(F.avg(F.when(p < 0, p))).alias("avg_loss"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("won"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("lost"),
        F.max(F.struct(order, "cum_pnl")).alias("end"), F.max("drawdown").alias("max_drawdown"), F.stddev_samp("pnl").alias("sd"), ((F.max(order) - F.min(order)) / 86_400_000_000).alias("days"), *hits)
    part = lambda a, b: zero(series.safe_div(F.col(a), F.col(b)))
    factor = F.when(F.col("lost") > 0, part("won", "lost")).when(F.col("won") > 0, F.lit(float("inf"))).otherwise(0.0)
    grown = 1 + F.col("end.cum_pnl")
    # a loss of more than everything has no real root
    annual = F.when(F.col("days") > 0, F.when(grown >= 0, F.pow(grown, F.try_divide(F.lit(365.0), F.col("days"))) - 1)).otherwise(0.0)
    out = out.select(*keys, "total_trades", part("right", "total_trades").alias("win_rate"), "avg_trade_return", "avg_win", "avg_loss", factor.alias("profit_factor"), F.col("end.cum_pnl").alias("final_pnl"), "max_drawdown", (part("avg_trade_return", "sd") * 252**0.5).alias("sharpe"), annual.alias("annualised_return"), *(zero(F.col(c)).alias(c) for c in ("long_precision", "short_precision")[: len(hits)]))
    return out.join(auc(df, label, score, keys).select(*keys, "roc_auc"), keys, "left") if label and score else out


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class of the label or prediction."""
    cells = confusion(df, label, predicted)
    both = cells.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("e")).select("e.*")
    out = both.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns({"precision": zero(series.safe_div(F.col("hit"), F.col("called"))), "recall": zero(series.safe_div(F.col("hit"), F.col("support")))})
    return out.select("class", "precision", "recall", zero(series.safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).alias("f1"), "support")


def roc_points(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """score, tp, fp by key: rows of either class at or above each distinct score, with pos and neg of the score itself. The counts a score are
    combined first; ranges of scores, cut at their quantiles, are then accumulated side by side and joined with the totals of the ranges above."""
    keys = keys or []
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    cuts = df.agg(F.percentile_approx(score, [k / RANGES for k in range(1, RANGES)]).alias("cuts"))  # one row
    ranged = counts.join(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("cuts", lambda c: c <= F.col("score")))).drop("cuts")
    totals = ranged.groupBy(*keys, "_r").agg(F.sum("pos").alias("tp_above"), F.sum("neg").alias("fp_above"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = totals.select(*keys, "_r", F.coalesce(F.sum("tp_above").over(above), F.lit(0)).alias("tp_above"), F.coalesce(F.sum("fp_above").over(above), F.lit(0)).alias("fp_above"))
    within = Window.partitionBy(*keys, "_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({"tp": F.sum("pos").over(within), "fp": F.sum("neg").over(within)}).join(carried, [*keys, "_r"])
    return own.select(*keys, "score", (F.col("tp") + F.col("tp_above")).alias("tp"), (F.col("fp") + F.col("fp_above")).alias("fp"), "pos", "neg")


def curves(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Points of the ROC and the precision-recall curve by key, one a distinct score: false and true positive rate, precision and recall."""
    keys = keys or []
    points = roc_points(df, label, score, keys)
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    both = points.join(totals, keys) if keys else points.join(F.broadcast(totals))
    return both.select(*keys, "score", series.safe_div(F.col("fp"), F.col("n_neg")).alias("fpr"), series.safe_div(F.col("tp"), F.col("n_pos")).alias("tpr"), series.safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """By key (one row without keys): ROC AUC (ties count half), the area under the precision-recall curve by trapezoids (from recall 0 with precision
    1), and average precision. A point's predecessor on the curve follows from its own counts, so no row waits for another."""
    keys = keys or []
    points = roc_points(df, label, score, keys)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, n0 = F.col("tp") - F.col("pos"), F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")
    p0 = F.when(n0 > 0, F.try_divide(tp0, n0)).otherwise(1.0)
    out = points.groupBy(*keys).agg(F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg")).alias("area"), F.sum(p * F.col("pos")).alias("steps"), F.sum((p + p0) / 2 * F.col("pos")).alias("slopes"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*keys, series.safe_div(F.col("area"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"), series.safe_div(F.col("slopes"), F.col("n_pos")).alias("pr_auc"), series.safe_div(F.col("steps"), F.col("n_pos")).alias("average_precision"), "n_pos", "n_neg")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    return df.agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("positives"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("negatives")).withColumn("weight", F.col("negatives") / F.greatest("positives", F.lit(1)))


def boosted_trees(train: DataFrame, features: list[str], label: str = "label", rounds: int = 50, validation: str | None = None, depth: int = 6, rate: float = 0.05, rows: float = 0.8, least: int = 20):
    """A fitted pipeline of assembler and gradient-boosted trees (depth 6, rate 0.05, row and column subsampling 0.8), classes
    weighted by their balance; with a ``validation`` flag column, training stops early."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    weight = class_balance(train, label).first()["weight"]
    weighted = train.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(1.0))
    trees = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", maxDepth=depth, stepSize=rate, subsamplingRate=rows, featureSubsetStrategy="0.8", maxIter=rounds, minInstancesPerNode=least, seed=42)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), trees]).fit(weighted)


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def top_features_model(train: DataFrame, features: list[str], keep: int = 15, **options):
    """Fits on all features, then again on the ``keep`` most important ones; gives the model and their names."""
    first = boosted_trees(train, features, **options)
    chosen = [f for f, _ in importances(first, features)[:keep]]
    return boosted_trees(train, chosen, **options), chosen


def scored(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    columns = df.columns
    return model.transform(df).select(*columns, vector_to_array("probability")[1].alias(name))


def importance_table(model, spark: SparkSession, features: list[str], top: int | None = None) -> DataFrame:
    """feature, importance, rank: a row a feature, the most important first, all or the ``top``."""
    ranked = importances(model, features)[:top]
    return spark.createDataFrame([(f, float(g), k) for k, (f, g) in enumerate(ranked, 1)], "feature string, importance double, rank int")


def objective(scored_rows: DataFrame, label: str = "label", score: str = "score", ret: str = "return_pct", cost: float = 0.0) -> float:
    """0.4 AUC + 6 times the best mean return of long or short signals over eleven thresholds from 0.4 to 0.6, or 0 where none gains."""
    area = auc(scored_rows, label, score).first()["roc_auc"] or 0.0
    best = threshold_table(scored_rows, score, ret, tuple(round(0.6 - 0.02 * k, 2) for k in range(11)), cost).agg(F.max("mean_return")).first()[0]
    return 0.4 * area + 6 * max(0.0, best or 0.0)


def search(train: DataFrame, valid: DataFrame, features: list[str], trials: int = 30, seed: int = 42, seconds: float = 1200.0, **options) -> tuple[dict, list[tuple[dict, float]]]:
    """Random search over depth, rate, rounds, subsampling and least rows a leaf: the best settings by ``objective`` on ``valid``, and all trials.

    Trials are drawn by the seed and stop after ``seconds``; each is one distributed fit."""
    draw, began, tried = random.Random(seed), time.monotonic(), []
    for _ in range(trials):
        settings = {"depth": draw.randint(3, 8), "rate": 10 ** draw.uniform(-2, -0.7), "rounds": draw.choice([20, 50, 100]), "rows": draw.uniform(0.5, 1.0), "least": draw.choice([5, 20, 50])}
        if tried and time.monotonic() - began > seconds:
            break
        tried.append((settings, objective(scored(boosted_trees(train, features, **settings, **options), valid))))
    return max(tried, key=lambda t: t[1])[0], tried


def save_bundle(model, spark: SparkSession, path: str, features: list[str], thresholds: DataFrame, statistics: DataFrame, metrics: DataFrame, config: dict) -> None:
    """The model and what scoring needs with it, each in a folder of ``path``: model, importance (CSV), thresholds, normalisation, metrics and config
    (JSON)."""
    model.write().overwrite().save(f"{path}/model")
    importance_table(model, spark, features).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/importance")
    config_row = spark.createDataFrame([(json.dumps({**config, "features": features}, sort_keys=True),)], "value string")
    config_row.coalesce(1).write.mode("overwrite").text(f"{path}/config")
    for name, table in (("thresholds", thresholds), ("normalisation", statistics), ("metrics", metrics)):
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")  # a few rows each


def load_bundle(spark: SparkSession, path: str) -> dict:
    """model, config (a dict with the features), thresholds (side to threshold), and the tables of normalisation, metrics and importance."""
    from pyspark.ml import PipelineModel

    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    thresholds = {r["side"]: r["threshold"] for r in spark.read.json(f"{path}/thresholds").collect()}
    tables = {n: spark.read.json(f"{path}/{n}") for n in ("normalisation", "metrics")}
    return {"model": PipelineModel.load(f"{path}/model"), "config": config, "thresholds": thresholds, "importance": spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/importance"), **tables}


def write_reports(df: DataFrame, path: str, label: str, predicted: str, score: str) -> None:
    """The class report as JSON and CSV, the confusion matrix as CSV, and the areas under both curves as text, each in a folder of ``path``."""
    report = class_report(df, label, predicted).orderBy("class").coalesce(1)
    report.write.mode("overwrite").json(f"{path}/report_json")
    report.write.mode("overwrite").option("header", True).csv(f"{path}/report_csv")
    confusion(df, label, predicted).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/confusion_csv")
    areas = auc(df, label, score)
    for name in ("roc_auc", "pr_auc"):
        areas.select(F.col(name).cast("string")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
