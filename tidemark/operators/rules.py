"""Rules with state: alarms that are raised after breaches in a row, held, escalated by tier and released after quiet time.

A value breaches the tiers whose limits it exceeds; a missing value breaches none. Breaches in a row are consecutive rows of a key, less than the quiet time
apart. The row that completes ``in_row`` of them raises the key's alarm. An alarm holds while breaches, in a row or not, come less than the quiet time after one another; its tier
is the highest breached since the first of them, and a row that takes it higher escalates it. It is released the quiet time after its last breach.

Here breaches are counted over stored rows, in chunks of time side by side; ``tidemark.streaming.rules`` keeps the same alarms as state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.sources.shared import stored

#: Chunks of time in which rows are counted side by side, in microseconds.
DAY = 86_400_000_000


def level(value: str, limits: Sequence[float]) -> Column:
    """How many of the ascending limits the value exceeds."""
    if not limits or list(limits) != sorted(set(limits)):
        raise ValueError("limits must ascend")
    return sum((F.coalesce(F.col(value) > x, F.lit(False)).cast("int") for x in limits), F.lit(0))


def actions(df: DataFrame, keys: list[str], at: str, tie: str, value: str, limits: Sequence[float], in_row: int, quiet: int, until: Column | None = None, chunk: int = DAY) -> DataFrame:
    """keys, us, action (raise, escalate or release), tier of all alarms; rows are in the order of ``at`` (microseconds, kept as us) and ``tie``.

    With ``until``, a time, only what has happened by then: later rows, and releases due later, aren't there."""
    if in_row < 1 or quiet < 1:
        raise ValueError("in_row and quiet must be positive")
    order = ["us", "_tie"]
    rows = df.select(*keys, F.col(at).alias("us"), F.col(tie).alias("_tie"), level(value, limits).alias("_level"), *([] if until is None else [until.alias("_until")]))
    if until is not None:
        rows = rows.where(F.col("us") <= F.col("_until"))
    # breaches between the same clean rows are consecutive
    counted = series.running(rows.withColumn("_clean", (F.col("_level") == 0).cast("long")), keys, order, "us", chunk, {"_between": ("sum", "_clean")})
    breaches = stored(counted.where("_level > 0").drop("_clean").withColumn("_one", F.lit(1).cast("long")), "breaches")
    near = series.beside(breaches, keys, order, "us", chunk, {"_before": "us", "_before_between": "_between"}, {})
    apart = F.coalesce(F.col("us") - F.col("_before") >= quiet, F.lit(True))
    marked = near.withColumns({"_apart": apart, "_anew": apart | (F.col("_between") != F.col("_before_between"))})
    placed = stored(series.running(marked, keys, order, "us", chunk, {"_n": ("sum", "_one")}), "breaches")
    placed = series.latest(placed, keys, order, "us", chunk, {"_alarm": F.when(F.col("_apart"), F.col("_n")), "_run": F.when(F.col("_anew"), F.col("_n"))})
    place = F.struct(*order)
    firsts = [F.min(F.when(F.col("_level") >= k, place)) for k in range(1, len(limits) + 1)]
    found = placed.groupBy(*keys, "_alarm").agg(F.min(F.when(F.col("_n") - F.col("_run") + 1 >= in_row, place)).alias("_raised"), F.max("us").alias("_last"), F.array(*firsts).alias("_firsts"), *([] if until is None else [F.first("_until").alias("_until")]))
    raised = found.where("_raised is not null")
    tier = lambda by: F.size(F.filter("_firsts", by))
    event = lambda us, action, t: F.struct(us.alias("us"), F.lit(action).alias("action"), t.cast("int").alias("tier"))
    later = F.array_distinct(F.filter("_firsts", lambda f: f > F.col("_raised")))
    escalations = F.transform(later, lambda at: event(at["us"], "escalate", F.size(F.filter("_firsts", lambda f: f <= at))))
    over = F.col("_last") + quiet
    released = F.array(event(over, "release", tier(lambda f: f.isNotNull())))
    if until is not None:
        released = F.filter(released, lambda x: x["us"] <= F.col("_until"))
    first = F.array(event(F.col("_raised.us"), "raise", tier(lambda f: f <= F.col("_raised"))))
    return raised.select(*keys, F.explode(F.concat(first, escalations, released)).alias("_e")).select(*keys, "_e.*")
