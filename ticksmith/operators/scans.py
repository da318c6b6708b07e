"""Ordered scans that split hot keys: running sums, extremes and last known values, frames of rows and of time, and the as-of join.

A window over a key runs in one task, so a key with a third of all rows would be one task's. Here such keys are cut into
chunks by time: each chunk is scanned as if it were a key, the few totals of chunks are scanned in turn, and what comes
before a chunk is added to its rows. That works for what composes: sums, largest and smallest values, the lowest running
sum, the last value that isn't null. Only keys with more than ``split_rows`` rows are cut; others are one chunk.

Rows are shuffled once, by key and chunk. The hot keys are at most ``HOT_KEYS``: any other key has fewer rows than each
of these, so under one in ``HOT_KEYS`` of all. Therefore what is broadcast is bounded: ``HOT_KEYS`` times ``PIECES`` rows.

Whether any key is hot is counted when a scan is made, a job that moves one row a key and task. Without hot keys the scan
is a plain window; else the rows are read three times more, for the ends of chunks, their totals and the scan. The ends
are taken when the scan is made as well, and go through the driver: a row of ``PIECES`` numbers for each hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1000
#: Chunks of a hot key.
PIECES = 32
SPLIT_ROWS = 1_000_000

_CHUNK = "_chunk"
_KINDS = {"sum": F.sum, "max": F.max, "min": F.min, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True), "last_before": lambda c: F.last(c, ignorenulls=True), "low": F.min, "low_before": F.min}


def _number(rows: DataFrame, at: str) -> Column:
    """``at`` as a number that rises with it."""
    kind = dict(rows.dtypes)[at]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(at).cast("timestamp"))
    return F.unix_date(at).cast("long") if kind == "date" else F.col(at)


def _hot_keys(rows: DataFrame, by: list[str], split_rows: int) -> DataFrame:
    """The keys with more than ``split_rows`` rows, the largest ``HOT_KEYS`` of them."""
    return rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > split_rows).orderBy(F.desc("_n")).limit(HOT_KEYS)


def _with_chunks(rows: DataFrame, by: list[str], at: str, large: DataFrame, pieces: int) -> DataFrame:
    """Add the chunk of each row, and whether its key is cut: chunks rise with ``at``, nulls first, and split no tie."""
    number = _number(rows, at)
    ends = F.percentile_approx("_at", [k / pieces for k in range(1, pieces)], 1000)
    slim = rows.select(*by, number.alias("_at"))
    large = F.broadcast(large.drop("_n") if by else large)
    held = slim.join(large, by, "left_semi") if by else slim.join(large.select(), how="left_semi")
    hot = held.groupBy(*by).agg(F.array_distinct(ends).alias("_ends"))
    # taken once: such percentiles vary with the order in which their parts arrive, and totals and scan need the same chunks
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot.toArrow(), hot.schema))
    # without keys one row by all rows
    out = rows.join(hot, by, "left") if by else rows.join(hot, F.lit(True), "left")
    chunk = F.coalesce(F.size(F.filter("_ends", lambda end: end < number)), F.lit(0))
    return out.withColumns({_CHUNK: F.when(F.col("_ends").isNotNull(), chunk).otherwise(0), "_hot": F.col("_ends").isNotNull()}).drop("_ends")


def with_running(rows: DataFrame, by: list[str], order: list[str], given: dict[str, tuple[str, Column]], split_rows: int = SPLIT_ROWS, pieces: int = PIECES) -> DataFrame:
    """Add running values over the rows of each key up to this one, ordered by ``order``, which begins with a time or number.

    ``given``: name -> (kind, column), where kind is sum, max, min, first or last (values that aren't null), last_before
    (the last without this row), low (the least running sum) or low_before (that without this row; null at the first). Of
    a low the running sum starts from 0, which doesn't count as a value itself. Rows with a null key are one key that is
    never cut.
    """
    if unknown := {k for k, _ in given.values()} - _KINDS.keys():
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    large = _hot_keys(rows, by, split_rows)
    cut = not large.isEmpty()
    keys = [*by, _CHUNK] if cut else by
    w = Window.partitionBy(*keys).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    lows = {n: c for n, (k, c) in given.items() if k.startswith("low")}

    def scanned(part: DataFrame) -> DataFrame:
        """Running values within chunks."""
        part = part.withColumns({f"_sum_{n}": F.sum(c).over(upto) for n, c in lows.items()})
        values = {n: _KINDS[k](F.col(f"_sum_{n}") if n in lows else c).over(before if k.endswith("_before") else upto) for n, (k, c) in given.items()}
        return part.withColumns({f"_run_{n}": c for n, c in values.items()})

    if not cut:
        out = scanned(rows)
        return out.select(*(F.col(c) for c in rows.columns), *(F.col(f"_run_{n}").alias(n) for n in given))
    chunked = _with_chunks(rows, by, order[0], large, pieces)
    # a chunk's totals, and what all chunks before it come to
    totals = []
    for n, (k, c) in given.items():
        if k.startswith("low"):
            totals += [F.sum(c).alias(f"_all_{n}"), F.min(f"_sum_{n}").alias(f"_low_{n}")]
        elif k in ("first", "last", "last_before"):
            totals.append((F.min_by if k == "first" else F.max_by)(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"_all_{n}"))
        else:
            totals.append(_KINDS[k](c).alias(f"_all_{n}"))
    parts = chunked.where("_hot")
    parts = parts.withColumns({f"_sum_{n}": F.sum(c).over(upto) for n, c in lows.items()}).groupBy(*keys).agg(*totals)
    earlier = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_in_{n}": (F.sum if n in lows else _KINDS[k])(F.col(f"_all_{n}")).over(earlier) for n, (k, _) in given.items()}
    parts = parts.withColumns(carried)
    parts = parts.withColumns({f"_in_low_{n}": F.min(F.coalesce(f"_in_{n}", F.col(f"_all_{n}") * 0) + F.col(f"_low_{n}")).over(earlier) for n in lows})
    parts = F.broadcast(parts.select(*keys, *(c for c in parts.columns if c.startswith("_in_"))))
    out = scanned(chunked).join(parts, keys, "left")

    def whole(n: str, kind: str) -> Column:
        here, given_in = F.col(f"_run_{n}"), F.col(f"_in_{n}")
        if kind in ("max", "min"):
            return (F.greatest if kind == "max" else F.least)(here, given_in)
        if kind in ("last", "last_before"):
            return F.coalesce(here, given_in)
        if kind == "first":
            return F.coalesce(given_in, here)
        if kind == "sum":
            return F.when(here.isNull() | given_in.isNull(), F.coalesce(here, given_in)).otherwise(here + given_in)
        return F.least(F.when(given_in.isNull(), here).otherwise(here + given_in), F.col(f"_in_low_{n}"))

    return out.select(*(F.col(c) for c in rows.columns), *(whole(n, k).alias(n) for n, (k, _) in given.items()))


def with_trailing(rows: DataFrame, by: list[str], order: list[str], count: int, given: dict[str, Column], split_rows: int = SPLIT_ROWS, pieces: int = PIECES) -> DataFrame:
    """Add aggregates over each row and at most ``count - 1`` rows before it, of its key and ordered as in ``with_running``.

    ``given``: name -> aggregate. Each chunk of a hot key also gets the ``count - 1`` rows before it, wherever they lie.
    """
    if count < 1:
        raise ValueError("a frame has one row at least")
    large = _hot_keys(rows, by, split_rows)
    cut = not large.isEmpty()
    keys = [*by, _CHUNK] if cut else by
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - count, 0)
    values = {n: c.over(frame) for n, c in given.items()}
    if not cut:
        return rows.withColumns(values)
    chunked = _with_chunks(rows, by, order[0], large, pieces)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*map(F.desc, order)))
    newest = lambda part: part.withColumn("_place", place).where(F.col("_place") < count)
    # a chunk may be shorter than a frame, so its newest rows go to all later chunks, which keep the newest of these
    ends = newest(chunked.where("_hot")).where(F.col(_CHUNK) < pieces - 1)
    before = newest(ends.withColumn(_CHUNK, F.explode(F.sequence(F.col(_CHUNK) + 1, F.lit(pieces - 1)))))
    both = chunked.withColumn("_own", F.lit(True)).unionByName(before.drop("_place").withColumn("_own", F.lit(False)))
    return both.withColumns(values).where("_own").select(*(F.col(c) for c in rows.columns), *given)


def with_oldest(rows: DataFrame, by: list[str], order: list[str], seconds: float, given: dict[str, str], split_rows: int = SPLIT_ROWS, pieces: int = PIECES) -> DataFrame:
    """Add what columns are in the oldest row of the ``seconds`` up to each row, of its key and ordered as in ``with_running``.

    ``given``: name -> column; ``order`` begins with a time. Each row stands twice in one scan from the newest time to the
    oldest: at its time, where it is met, and ``seconds`` before that, where it takes the oldest row met so far. So all rows
    within the time are looked through, but work grows with rows, not with how many lie within the time. Rows without a
    time are compared among themselves.
    """
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    # rows without a time are met first, and are never the oldest of others
    met = F.struct(at.isNull().alias("timeless"), F.struct(*order).alias("place"), F.struct(*(F.col(c).alias(n) for n, c in given.items())).alias("values"))
    own = F.struct("*")
    none = lambda column: F.lit(None).cast(rows.select(column).schema[0].dataType)
    places = F.array(
        F.struct((-at).alias("_back"), F.lit(0).alias("_side"), met.alias("_met"), none(own).alias("_row")),
        F.struct((F.lit(int(seconds * 1_000_000)) - at).alias("_back"), F.lit(1).alias("_side"), none(met).alias("_met"), own.alias("_row")),
    )
    both = rows.select(*by, F.inline(places))
    found = with_running(both, by, ["_back", "_side"], {"_found": ("min", F.col("_met"))}, split_rows, pieces).where("_side = 1")
    return found.select("_row.*", *(F.col("_found.values")[n].alias(n) for n in given))


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str = "ts", values: list[str] | None = None, order: list[str] | None = None, tolerance_seconds: float | None = None, strictly: bool = False, split_rows: int = SPLIT_ROWS, pieces: int = PIECES) -> DataFrame:
    """Add to each row of ``left`` the ``values`` of the newest row of ``right`` with its key at or before its time.

    ``strictly``: before its time. ``order``: columns of ``right`` that order rows of one time; the last counts.
    ``tolerance_seconds``: older rows than that don't count. Values are null where nothing counts; a right row's null
    values are taken as they are. The time of the row taken is ``right_<at>``. Null keys match null keys, rows of
    ``left`` with a null time match nothing, those of ``right`` are never taken.

    Both sides are one union, so neither is joined to the other: one shuffle and a scan for the last row known.
    """
    values = [c for c in right.columns if c not in (*by, at)] if values is None else values
    order = order or []
    taken = F.struct(F.col(at), *map(F.col, values))
    tag = 2 if strictly else 0
    known = right.where(F.col(at).isNotNull()).select(*by, F.col(at), F.struct(*map(F.col, order or [at])).alias("_order"), F.lit(tag).alias("_side"), taken.alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    none = {f.name: f.dataType for f in known.schema}
    asked = left.select(*by, F.col(at), F.lit(None).cast(none["_order"]).alias("_order"), F.lit(1).alias("_side"), F.lit(None).cast(none["_right"]).alias("_right"), F.struct("*").alias("_left"))
    both = known.unionByName(asked)
    found = with_running(both, by, [at, "_side", "_order"], {"_found": ("last", F.col("_right"))}, split_rows, pieces).where("_side = 1")
    fits = F.col(f"_left.{at}").isNotNull()
    if tolerance_seconds is not None:
        age = F.unix_micros(F.col(f"_left.{at}").cast("timestamp")) - F.unix_micros(F.col(f"_found.{at}").cast("timestamp"))
        fits = fits & (age <= int(tolerance_seconds * 1_000_000))
    return found.select("_left.*", F.when(fits, F.col(f"_found.{at}")).alias(f"right_{at}"), *(F.when(fits, F.col(f"_found.{v}")).alias(v) for v in values))


def reflected(total: Column, low: Column, start: Column | float = 0) -> Column:
    """A running sum that is floored at 0: with s the start and all before, ``s - min(0, min s)``."""
    first = start if isinstance(start, Column) else F.lit(start)
    return total + first - F.least(F.lit(0), low + first)
