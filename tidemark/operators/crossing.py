"""First crossings: from a row on, the first later row at which some value is at most a limit of the asking row.

A range join would pair every limit with all rows up to its crossing. Instead rows are grouped by ``FAN`` into blocks, those by ``FAN`` into larger
ones and so on, and each block holds the least values of its parts. A limit climbs: in the block of its row it looks at the parts behind its
own, and in the block around that one likewise; the lowest block with a part that has a value within the limit holds the crossing. From there it descends, at
each height to the first such part. Most limits are crossed soon: those that find it in the lowest block climb no further. Everything meets by equality, in proportion to the rows and to the limits times the heights, of which there are
log(rows) / log(FAN). Blocks above the lowest are few, and are repeated ``SALTS`` times, as many limits meet there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

FAN, SALTS = 64, 16


def _nodes(values: DataFrame, keys: list[str], row: str, columns: list[str], top: int, fan: int) -> DataFrame:
    """(keys, height from 1, number, parts): parts are structs of their number c in the block and their least values."""
    level = values.select(*keys, F.col(row).alias("_i"), *(F.when(~F.isnan(c), F.col(c)).alias(f"_v{k}") for k, c in enumerate(columns)))
    out = []
    for h in range(1, top + 1):
        part = F.struct((F.col("_i") % fan).alias("c"), *(F.col(f"_v{k}") for k in range(len(columns))))
        block = level.groupBy(*keys, F.floor(F.col("_i") / fan).cast("long").alias("_i")).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
        block = stored(block, "crossing-blocks")
        out.append(block.withColumn("_h", F.lit(h)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1 if h > 1 else 0)))))
        level = block.select(*keys, "_i", *(F.array_min(f"_parts._v{k}").alias(f"_v{k}") for k in range(len(columns))))
    return reduce(DataFrame.unionByName, out)


def _first_part(limits: list[Column], least: Column) -> Column:
    """The number of the first part from ``least`` on with a value within a limit."""
    within = lambda p: reduce(lambda a, b: a | b, (F.coalesce(p[f"_v{k}"] <= l, F.lit(False)) for k, l in enumerate(limits)))
    return F.get(F.filter("_parts", lambda p: (p["c"] >= least) & within(p)), F.lit(0))["c"]


def first_at_most(limits: DataFrame, values: DataFrame, keys: list[str], ids: list[str], since: str, row: str, columns: dict[str, str], name: str, fan: int = FAN) -> DataFrame:
    """(keys, ids, ``name``) for every limit: the first row of ``values`` from ``since`` on whose value is at most the limit, in any of ``columns``
    (value column -> limit column); null if there is none. A null or NaN value or limit crosses nothing.

    ``ids`` tell limits of a key apart; rows are whole numbers from 0. Values that must be at least a limit enter negated, with the limit negated."""
    last = values.agg(F.max(row)).first()[0]
    if last is None:
        return limits.select(*keys, *ids, F.lit(None).cast("long").alias(name))
    top = 1
    while fan**top <= last:
        top += 1
    nodes = _nodes(values, keys, row, list(columns), top, fan)
    own = [F.when(~F.isnan(c), F.col(c)).alias(f"_l{k}") for k, c in enumerate(columns.values())]
    held = [f"_l{k}" for k in range(len(columns))]
    at = F.col("_s")
    climb = [F.struct(F.lit(h).alias("_h"), F.floor(at / fan**h).cast("long").alias("_i"), (F.floor(at / fan ** (h - 1)) % fan + int(h > 1)).cast("long").alias("_least"), (F.pmod(at, F.lit(SALTS)) if h > 1 else F.lit(0)).cast("int").alias("_salt")) for h in range(1, top + 1)]
    asking = limits.select(*keys, *ids, *own, F.greatest(F.col(since), F.lit(0)).cast("long").alias("_s"))
    lowest = nodes.where("_h = 1").drop("_h", "_salt")
    near = asking.withColumns({"_i": climb[0]["_i"], "_least": climb[0]["_least"]}).join(lowest, [*keys, "_i"], "left")
    near = stored(near.select(*keys, *ids, *held, "_s", (F.col("_i") * fan + _first_part([F.col(c) for c in held], F.col("_least"))).alias("_at")), "crossing-near")
    if top == 1:
        return near.select(*keys, *ids, F.col("_at").alias(name))
    asks = near.where("_at is null").withColumn("_c", F.explode(F.array(*climb[1:]))).select(*keys, *ids, *held, "_c.*")
    met = asks.join(nodes, [*keys, "_h", "_i", "_salt"]).withColumn("_part", _first_part([F.col(c) for c in held], F.col("_least"))).where("_part is not null")
    found = met.groupBy(*keys, *ids).agg(F.min(F.struct("_h", (F.col("_i") * fan + F.col("_part")).alias("_at"), *held)).alias("_f")).select(*keys, *ids, "_f.*")
    for h in range(top, 1, -1):  # from a block of height h - 1 to its part
        below = nodes.where(F.col("_h") == h - 1).drop("_h").withColumnRenamed("_i", "_block")
        # those that are lower already meet nothing, each at a number of its own
        going = found.withColumns({"_block": F.when(F.col("_h") == h, F.col("_at")).otherwise(-1 - F.col("_at")), "_salt": F.when((F.col("_h") == h) & F.lit(h > 2), F.pmod("_at", F.lit(SALTS))).otherwise(0).cast("int")})
        met = going.join(below, [*keys, "_block", "_salt"], "left")
        found = met.select(*keys, *ids, F.when(F.col("_h") == h, h - 1).otherwise(F.col("_h")).alias("_h"), F.when(F.col("_h") == h, F.col("_at") * fan + _first_part([F.col(c) for c in held], F.lit(0))).otherwise(F.col("_at")).alias("_at"), *held)
    far = near.where("_at is null").select(*keys, *ids).join(found.select(*keys, *ids, F.col("_at").alias(name)), [*keys, *ids], "left")
    return near.where("_at is not null").select(*keys, *ids, F.col("_at").alias(name)).unionByName(far)


def first_reach(limits: DataFrame, states: DataFrame, keys: list[str], ids: list[str], since: str, order: str, name: str) -> DataFrame:
    """For limits with price and side ('buy' or 'sell'): the first book state, by ``order`` (numbered from 0), from ``since`` on whose opposite best price
    reaches the limit: a best ask at most a buy's price, a best bid at least a sell's."""
    of = limits.withColumns({"_buy": F.when(F.col("side") == "buy", F.col("price")), "_sell": F.when(F.col("side") == "sell", -F.col("price"))})
    rows = states.select(*keys, order, F.col("best_ask").alias("_ask"), (-F.col("best_bid")).alias("_bid"))
    return first_at_most(of, rows, keys, ids, since, order, {"_ask": "_buy", "_bid": "_sell"}, name)
