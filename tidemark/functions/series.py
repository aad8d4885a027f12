"""Columns over ordered series: rolling, lagged, filled and cumulative values, and windows that scale beyond one task a series.

Every function takes the window's keys and its order explicitly; ties in time need a tie-breaker in the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]


def ordered(keys: Keys, order: Keys) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def guarded(x: Column, small: float = 1e-10) -> Column:
    """x, with zero read as ``small``."""
    return F.when(x == 0, F.lit(small)).otherwise(x)


def rolling(aggregate: Callable[[str], Column], column: str, window: WindowSpec, rows: int, least: int | None = None) -> Column:
    """An aggregate over the last ``rows`` rows, null below ``least`` values (all ``rows`` by default)."""
    frame = window.rowsBetween(-(rows - 1), 0)
    least = rows if least is None else least
    value = aggregate(column).over(frame)
    return value if least <= 1 else F.when(F.count(column).over(frame) >= least, value)


def over_time(aggregate: Column, keys: Keys, micros: str, span: int) -> Column:
    """An aggregate over (t - span, t], with t and span in microseconds; each row reads its whole span, so ``trailing`` suits long ones."""
    return aggregate.over(Window.partitionBy(*keys).orderBy(micros).rangeBetween(-(span - 1), 0))


def change(column: str, window: WindowSpec, periods: int = 1) -> Column:
    """Relative change against the value ``periods`` rows before."""
    return safe_div(F.col(column), F.lag(column, periods).over(window)) - 1


def filled(column: str, window: WindowSpec, default: float = 0.0) -> Column:
    """Forward fill, then the series' first value for the rows before it, then the default."""
    before = F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    # one value for the whole partition: a frame that ends at its end but moves its beginning would be read anew for every row
    first = F.first(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(before, first, F.lit(default))


def first_rows(df: DataFrame, keys: Keys, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order. Only a struct minimum per key is kept, combined before the shuffle."""
    ranks = [f"_o{k}" for k in range(len(order))]
    columns = df.columns
    ordered_first = F.struct(*(F.col(o).alias(r) if isinstance(o, str) else o.alias(r) for o, r in zip(order, ranks, strict=True)), F.struct(*columns).alias("_row"))
    return df.groupBy(*keys).agg(F.min(ordered_first).alias("_first")).select("_first._row.*")


def with_halo(df: DataFrame, micros: str, chunk: int, halo: int, body: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Applies ``body`` chunk by chunk of time, each chunk preceded by the rows of the ``halo`` microseconds before it.

    body(df, "chunk") adds columns by windows that also partition by the chunk column and reach back at most ``halo``; the halo's
    rows are dropped afterwards. A single series is so spread over as many tasks as it has chunks, at the cost of reading
    halo / chunk of the rows twice; rows of the halo alone enter one further chunk for each chunk length it spans."""
    copies = -(-halo // chunk)
    own = F.floor(F.col(micros) / chunk).cast("long")
    places = F.filter(F.sequence(own, own + copies), lambda c: (c == own) | (F.col(micros) > c * chunk - halo))
    spread = df.withColumn("chunk", F.explode(places)).withColumn("in_halo", F.col("chunk") > own)
    return body(spread, "chunk").where(~F.col("in_halo")).drop("chunk", "in_halo")


def running(df: DataFrame, keys: Keys, order: Keys, micros: str, chunk: int, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Cumulative sums and extremes from each series' beginning: name -> (sum, max or min; column).

    Chunks of time are accumulated side by side; their totals (a row a chunk) are accumulated per series and carried in."""
    spread = df.withColumn("_chunk", F.floor(F.col(micros) / chunk).cast("long"))
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    totals = spread.groupBy(*keys, "_chunk").agg(*(kinds[kind](c).alias(f"_{name}") for name, (kind, c) in columns.items()))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", *(kinds[kind](f"_{name}").over(earlier).alias(f"_{name}") for name, (kind, _) in columns.items()))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
    out = spread.withColumns({name: kinds[kind](c).over(within) for name, (kind, c) in columns.items()}).join(carried, [*keys, "_chunk"])
    return out.withColumns({name: join[kind](F.col(name), F.col(f"_{name}")) for name, (kind, _) in columns.items()}).drop("_chunk", *(f"_{name}" for name in columns))


def lagged(df: DataFrame, keys: Keys, order: Keys, micros: str, chunk: int, column: str, name: str) -> DataFrame:
    """``df`` with the column's previous value in each series. Chunks of time are ordered side by side; a chunk's first row takes
    the last value of the chunk before it, of which there is a row a chunk."""
    spread = df.withColumn("_chunk", F.floor(F.col(micros) / chunk).cast("long"))
    ends = spread.groupBy(*keys, "_chunk").agg(F.max(F.struct(*order, F.col(column).alias("_end"))).alias("_last"))
    carried = ends.select(*keys, "_chunk", F.lag("_last._end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    marked = spread.withColumns({"_own": F.lag(column).over(within), "_n": F.row_number().over(within)})
    return marked.join(carried, [*keys, "_chunk"]).withColumn(name, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_own"))).drop("_chunk", "_own", "_n", "_carried")


def beside(df: DataFrame, keys: Keys, order: Keys, at: str, chunk: int, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """``df`` with values of the row before and of the row after in each series (name -> column). Chunks of ``at`` are ordered side by side; their first
    and last rows take the neighbours' values from a row a chunk, and the rows are dealt once."""
    spread = df.withColumn("_chunk", F.floor(F.col(at) / chunk).cast("long"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    own = spread.withColumns({f"_b_{n}": F.lag(F.struct(c)).over(within) for n, c in before.items()} | {f"_a_{n}": F.lead(F.struct(c)).over(within) for n, c in after.items()})
    place = F.struct(*order)
    ends = spread.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*before.values()), place).alias("_last"), F.min_by(F.struct(*after.values()), place).alias("_first"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    carried = ends.select(*keys, "_chunk", F.lag("_last").over(by_chunk).alias("_last"), F.lead("_first").over(by_chunk).alias("_first"))
    value = lambda side, end, n, c: F.when(F.col(f"{side}{n}").isNotNull(), F.col(f"{side}{n}.{c}")).otherwise(F.col(f"{end}.{c}"))
    out = own.join(carried, [*keys, "_chunk"])
    out = out.withColumns({n: value("_b_", "_last", n, c) for n, c in before.items()} | {n: value("_a_", "_first", n, c) for n, c in after.items()})
    return out.drop("_chunk", "_last", "_first", *(f"_b_{n}" for n in before), *(f"_a_{n}" for n in after))


def around(df: DataFrame, keys: Keys, order: Keys, at: str, chunk: int, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """``df`` with each column of ``before`` (null where a row has none) taken from the last row up to this one in the order that has it, and each
    of ``after`` from the first row from this one on. ``order`` begins with the time ``at``.

    Chunks of time are ordered side by side; each chunk's last and first values, a row a chunk, are carried to the chunks after and before it.
    Rows are dealt once for both directions."""
    found = before | after
    spread = df.withColumn("_chunk", F.floor(F.col(at) / chunk).cast("long")).withColumns({f"_v_{n}": c for n, c in found.items()})
    end = lambda n: (F.min_by if n in after else F.max_by)(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}")
    ends = spread.groupBy(*keys, "_chunk").agg(*map(end, found))

    def last(name: str, n: str, place: Sequence[str], by: Keys, to: int) -> Column:
        turn = F.desc if n in after else F.asc
        return F.last(name, ignorenulls=True).over(Window.partitionBy(*place).orderBy(*map(turn, by)).rowsBetween(Window.unboundedPreceding, to))

    carried = ends.select(*keys, "_chunk", *(last(f"_e_{n}", n, keys, ["_chunk"], -1).alias(f"_c_{n}") for n in found))
    own = spread.withColumns({n: last(f"_v_{n}", n, [*keys, "_chunk"], order, 0) for n in found}).join(carried, [*keys, "_chunk"])
    return own.withColumns({n: F.coalesce(n, f"_c_{n}") for n in found}).drop("_chunk", *(f"{p}_{n}" for n in found for p in ("_v", "_c")))


def latest(df: DataFrame, keys: Keys, order: Keys, at: str, chunk: int, found: dict[str, Column], ahead: bool = False) -> DataFrame:
    """``around`` in one direction: each column from the last row up to this one that has it, or with ``ahead`` from the first from this one on."""
    return around(df, keys, order, at, chunk, *(({}, found) if ahead else (found, {})))


#: An aggregate over a trailing span of time: kind (sum, count, min, max, stddev_samp, stddev_pop), column, span in microseconds.
Trailing = tuple[str, str, int]


#: Rows of a series that a chunk of time should hold at most, and a task on average.
CHUNK_ROWS = 50_000


def chunk_for(df: DataFrame, keys: Keys, at: str, most: int, rows: int = CHUNK_ROWS) -> tuple[int, int]:
    """The longest of ``most``, its half, its quarter and so on (2^-16 at least) whose chunks of ``at`` hold at most ``rows`` rows of a series each; and how many tasks,
    the session's shuffle partitions at least, that many rows apiece make.

    Rows are counted by the finest chunks and these counts added up; the answer is a row a length."""
    finest = max(1, most >> 16)
    cells = df.groupBy(*keys, F.floor(F.col(at) / finest).cast("long").alias("_cell")).agg(F.count("*").alias("_n"))
    halved = cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(16)))).groupBy(*keys, "_k", F.floor(F.col("_cell") / F.pow(F.lit(2), F.col("_k"))).cast("long").alias("_cell")).agg(F.sum("_n").alias("_n"))
    found = halved.groupBy("_k").agg(F.max("_n").alias("_n"), F.sum("_n").alias("_all")).collect()
    k = max((r["_k"] for r in found if r["_n"] <= rows), default=0) if found else 16
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found[0]["_all"] // rows) if found else 1)
    return most if k == 16 else finest << k, tasks


def _dealt(rows: DataFrame, place: Keys, tasks: int | None) -> DataFrame:
    return rows.repartition(tasks, *place) if tasks else rows.repartition(*place)


def trailing(df: DataFrame, keys: Keys, at: str, chunk: int, asked: dict[str, Trailing], tasks: int | None = None) -> DataFrame:
    """``df`` with aggregates over (t - span, t] by key, where t is the row's time ``at``; rows of one time see each other.

    A span reaches over at most two of the blocks of its length that time is cut into: from its beginning to the end of one, and from the
    beginning of the next to t. Both parts are running aggregates, forwards and backwards, so a row costs the same whatever the span holds,
    and nothing is ever subtracted. Rows are dealt by key and chunk of time once, each chunk with the rows of the longest span
    before it. Spans longer than a chunk take whole chunks from a row a chunk instead (``_across``), so that chunks may be short where ticks are dense."""
    spans: dict[int, dict[str, Trailing]] = {}
    for name, item in asked.items():
        spans.setdefault(item[2], {})[f"_r_{name}"] = item
    short, long = ([(span, items) for span, items in sorted(spans.items()) if (span > chunk) == far] for far in (False, True))

    def body(rows: DataFrame, chunk_column: str) -> DataFrame:
        place = [*keys, chunk_column]
        rows = _dealt(rows, place, tasks)
        for span, items in short:
            rows = _trailing(rows, place, at, span, items)
        return rows

    rows = with_halo(df, at, chunk, short[-1][0], body) if short else df
    for span, items in long:
        rows = _across(rows, keys, at, chunk, span, items, tasks)
    return rows.drop(*asked).withColumnsRenamed({f"_r_{n}": n for n in asked})  # a result may have the name of a column it is made of


def _across(rows: DataFrame, keys: Keys, at: str, chunk: int, span: int, items: dict[str, Trailing], tasks: int | None) -> DataFrame:
    """Aggregates over spans longer than a chunk: the rest of the chunk in which a span begins, the chunks between, and its last chunk up to t.

    Every row is dealt as itself and once more to the chunk of its span's beginning; between lie span / chunk chunks or one more or less, of which there is a row each."""
    place = F.floor(F.col(at) / chunk).cast("long")
    kinds = {n: (kind, column) for n, (kind, column, _) in items.items()}
    totals = rows.groupBy(*keys, place.alias("_chunk")).agg(*(f(F.col(column)).alias(f"{n}_{p}") for n, (kind, column) in kinds.items() for p, f in _functions(kind).items()))
    reach, by_chunk = span // chunk, Window.partitionBy(*keys).orderBy("_chunk")

    def between(n: str, kind: str, chunks: int) -> dict[str, Column]:
        parts = list(_functions(kind))
        if chunks < 1:
            return {p: F.lit(None).cast(dict(totals.dtypes)[f"{n}_{p}"]) for p in parts}
        frame = by_chunk.rangeBetween(-chunks, -1)
        if parts == ["s"]:
            return {"s": {"min": F.min, "max": F.max}.get(kind, F.sum)(f"{n}_s").over(frame)}
        held = F.collect_list(F.struct(*(F.coalesce(f"{n}_{p}", F.lit(0)).cast("double").alias(p) for p in parts))).over(frame)
        none = F.struct(*(F.lit(0.0).alias(p) for p in parts))
        one = F.aggregate(held, none, lambda a, b: F.struct(*(v.alias(p) for p, v in zip(parts, _pooled([a[p] for p in parts], [b[p] for p in parts]), strict=True))))
        return {p: one[p] for p in parts}

    # a span that begins in chunk c - d holds the d - 1 chunks between; d is span / chunk, rounded down or up
    carried = totals.select(*keys, "_chunk", *(c.alias(f"_{side}_{n}_{p}") for n, (kind, _) in kinds.items() for side, d in (("p", reach - 1), ("q", reach)) for p, c in between(n, kind, d).items()))
    spread = rows.withColumns({"_chunk": place})
    up_to = Window.partitionBy(*keys, "_chunk").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    spread = _dealt(spread, [*keys, "_chunk"], tasks).withColumns({k: c for n, (kind, column) in kinds.items() for k, c in _parts(kind, F.col(column), up_to, f"_b_{n}").items()}).join(carried, [*keys, "_chunk"])
    begun = F.floor((F.col(at) - span) / chunk).cast("long")
    near = F.col("_chunk") - begun == reach
    spread = spread.withColumns({f"_m_{n}_{p}": F.when(near, F.col(f"_p_{n}_{p}")).otherwise(F.col(f"_q_{n}_{p}")) for n, (kind, _) in kinds.items() for p in _functions(kind)}).drop(*(c for c in carried.columns if c.startswith(("_p_", "_q_"))))
    needed = [column for _, column in kinds.values()]
    values = [F.struct(*dict.fromkeys(needed)).alias("_values"), F.struct(*spread.columns).alias("_row")]
    data = spread.select(*keys, "_chunk", F.col(at).alias("_at"), F.lit(False).alias("_asks"), values[0], F.lit(None).cast(spread.select(values[1]).schema[0].dataType).alias("_row"))
    asks = spread.select(*keys, begun.alias("_chunk"), (F.col(at) - span).alias("_at"), F.lit(True).alias("_asks"), F.lit(None).cast(data.schema["_values"].dataType).alias("_values"), values[1])
    after = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_at"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    both = _dealt(data.unionByName(asks), [*keys, "_chunk"], tasks)
    told = both.withColumns({k: c for n, (kind, column) in kinds.items() for k, c in _parts(kind, F.col(f"_values.{column}"), after, f"_a_{n}").items()}).where("_asks").select("_row.*", *(f"_a_{n}_{p}" for n, (kind, _) in kinds.items() for p in _functions(kind)))
    out = told.withColumns({k: c for n, (kind, _) in kinds.items() for k, c in _both(kind, f"_a_{n}", f"_m_{n}").items()})
    out = out.withColumns({n: _merged(kind, f"_a_{n}", f"_b_{n}") for n, (kind, _) in kinds.items()})
    return out.select(*rows.columns, *kinds)


def _functions(kind: str) -> dict[str, Callable[[Column], Column]]:
    return {"sum": {"s": F.sum}, "count": {"s": F.count}, "min": {"s": F.min}, "max": {"s": F.max}}.get(kind, {"n": F.count, "m": F.avg, "v": F.var_pop})


def _parts(kind: str, column: Column, window: WindowSpec, name: str) -> dict[str, Column]:
    return {f"{name}_{p}": f(column).over(window) for p, f in _functions(kind).items()}


def _pooled(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Count, mean and variance of two sets together, of those of each (0 where empty)."""
    (n1, m1, v1), (n2, m2, v2) = a, b
    n = n1 + n2
    some = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    return n, some(m1 * n1 + m2 * n2), some(v1 * n1 + v2 * n2 + F.coalesce(F.try_divide(F.pow(m1 - m2, F.lit(2)) * n1 * n2, n), F.lit(0.0)))


def _both(kind: str, a: str, b: str) -> dict[str, Column]:
    """The parts of two sets together, under the names of the first's."""
    if kind in ("sum", "count", "min", "max"):
        return {f"{a}_s": _merged(kind, a, b)}
    zero = lambda x: [F.coalesce(f"{x}_{p}", F.lit(0)).cast("double") for p in "nmv"]
    return {f"{a}_{p}": c for p, c in zip("nmv", _pooled(zero(a), zero(b)), strict=True)}


def _merged(kind: str, a: str, b: str) -> Column:
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(f"{a}_s", f"{b}_s")
    if kind == "count":
        return F.coalesce(f"{a}_s", F.lit(0)) + F.coalesce(f"{b}_s", F.lit(0))
    if kind == "sum":
        return F.when(F.col(f"{a}_s").isNotNull() | F.col(f"{b}_s").isNotNull(), F.coalesce(f"{a}_s", F.lit(0)) + F.coalesce(f"{b}_s", F.lit(0)))
    (n1, m1, v1), (n2, m2, v2) = ([F.coalesce(f"{x}_{p}", F.lit(0)) for p in "nmv"] for x in (a, b))
    n = n1 + n2
    squares = v1 * n1 + v2 * n2 + F.try_divide(F.pow(m1 - m2, F.lit(2)) * n1 * n2, n)
    least = 1 if kind == "stddev_samp" else 0
    return F.when(n > least, F.sqrt(F.greatest(squares, F.lit(0.0)) / F.when(n > least, n - least)))


def trailing_of(df: DataFrame, keys: Keys, at: str, chunk: int, span: str, longest: int, asked: dict[str, tuple[str, str]]) -> DataFrame:
    """``trailing`` over spans that a column has, the same within a key and at most ``longest``: asked is name -> (kind, column)."""
    items = {f"_r_{n}": (kind, column, 0) for n, (kind, column) in asked.items()}
    body = lambda d, c: _trailing(d.repartition(*keys, c), [*keys, c], at, F.col(span), items)
    return with_halo(df, at, chunk, longest, body).drop(*asked).withColumnsRenamed({f"_r_{n}": n for n in asked})


def _trailing(rows: DataFrame, place: list[str], at: str, span: int | Column, items: dict[str, Trailing]) -> DataFrame:
    block = lambda t: F.floor(t / span).cast("long")
    forwards = Window.partitionBy(*place, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    backwards = Window.partitionBy(*place, "_block").orderBy(F.desc("_at"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_block", block(F.col(at)))
    rows = rows.withColumns({k: c for n, (kind, column, _) in items.items() for k, c in _parts(kind, F.col(column), forwards, f"_b_{n}").items()})
    # every row is there as itself, and once more at its span's beginning, where it asks for what comes after in that block
    sides = F.array(F.struct(F.col(at).alias("_at"), F.lit(False).alias("_asks")), F.struct((F.col(at) - span).alias("_at"), F.lit(True).alias("_asks")))
    both = rows.select(*rows.columns, F.explode(sides).alias("_side")).select(*rows.columns, "_side.*").withColumn("_block", block(F.col("_at")))
    after = {k: c for n, (kind, column, _) in items.items() for k, c in _parts(kind, F.when(~F.col("_asks"), F.col(column)), backwards, f"_a_{n}").items()}
    asking = both.withColumns(after).where("_asks")
    out = asking.withColumns({n: _merged(kind, f"_a_{n}", f"_b_{n}") for n, (kind, _, _) in items.items()})
    return out.drop("_block", "_at", "_asks", *(c for c in out.columns if c.startswith(("_a_", "_b_"))))


def in_row_chunks(df: DataFrame, keys: Keys, order: Keys, at: str, chunk: int, rows: int, halo: int, body: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """Applies ``body`` (with a window by key and order) to runs of ``rows`` rows, each preceded by the ``halo`` rows before it, for
    windows that reach back by a number of rows; a single series is so spread over many tasks."""
    numbered = running(df.withColumn("_one", F.lit(1)), keys, order, at, chunk, {"_row": ("sum", "_one")}).drop("_one")
    return with_halo(numbered, "_row", rows, halo + 1, lambda d, c: body(d, ordered([*keys, c], ["_row"]))).drop("_row")


def rolled(df: DataFrame, keys: Keys, order: Keys, at: str, chunk: int, rows: int, halo: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """``in_row_chunks`` for columns that are expressions of the window."""
    return in_row_chunks(df, keys, order, at, chunk, rows, halo, lambda d, w: d.withColumns({n: c(w) for n, c in columns.items()}))
