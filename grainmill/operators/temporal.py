"""Joins by time and by ranges: the last row before a moment, intervals that overlap, points in ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commands import CommandError
from .ids import discard, spread, stored

DIRECTIONS = ("backward", "forward", "nearest")
#: Bucket widths of the interval join grow by this factor.
STEP = 4
#: Rows of a side in a cell of a crowded bucket, about: a bucket whose sides make more than the square of it in pairs is dealt to cells.
CELL = 4000


def _require(df: DataFrame, columns: list[str]) -> None:
    for c in columns:
        if c not in df.columns:
            raise CommandError("COLUMN_NOT_FOUND", f"no column {c}")


def _measure(c: Column, kind: T.DataType) -> Column:
    """A number that grows with a moment: microseconds, days, or the number itself."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") if isinstance(kind, T.DateType) else c


def _unit(kind: T.DataType) -> int:
    """How many steps of :func:`_measure` make one of the caller's units: seconds, days, or one."""
    return 1_000_000 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else 1


def _names(left: DataFrame, right: DataFrame, leave: list[str]) -> dict[str, str]:
    """The right columns that the result has, with ``_right`` behind a name that is taken."""
    taken, out = set(left.columns), {}
    for c in right.columns:
        if c not in leave:
            name = c
            while name in taken:
                name += "_right"
            taken.add(name)
            out[c] = name
    return out


def _nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, forward: bool, exact: bool, order: list[str], name: str, values: dict[str, str]) -> DataFrame:
    """``left`` with a struct column: the columns ``values`` and the time ``at`` of the nearest right row in one direction.

    Both sides are put in order together by ranges of key and time.  What stands between equal
    times, and so what a range brings along to the next, follows from the order: rows of
    the left come after those of the right that count for them, and of right rows
    at one time the last by ``order`` is the closest.
    """
    u = uuid.uuid4().hex[:8]
    row, at, side, part, tie, carry = (f"_{x}_{u}" for x in ("row", "at", "side", "part", "tie", "carry"))
    keys = [f"_k{i}_{u}" for i in range(len(by))]
    kinds = [left.schema[b].dataType for b in by]
    l = left.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], _measure(F.col(f"`{on}`"), left.schema[on].dataType).alias(at), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias(row))
    moment = _measure(F.col(f"`{right_on}`"), right.schema[right_on].dataType)
    found = F.struct(moment.alias("at"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in values.items()]).alias("row"))
    r = right.select(*[F.col(f"`{c}`").cast(kind).alias(k) for c, k, kind in zip(by, keys, kinds, strict=True)], moment.alias(at), found.alias(name), F.struct(*[F.col(f"`{c}`") for c in order], F.lit(0)).alias(tie))
    sound = F.col(at).isNotNull()
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    left_first = forward == exact  # in ascending order: whether rights at the left's own time come after it
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = l.where(sound).select(*keys, at, F.lit(0 if left_first else 1).alias(side), row, nothing(r, name), nothing(r, tie))
    both = both.unionByName(r.where(sound).select(*keys, at, F.lit(1 if left_first else 0).alias(side), nothing(l, row), name, tie))
    sort = [*[F.col(k) for k in keys], F.col(at), F.col(side), F.col(tie).desc() if forward else F.col(tie).asc()]
    whole = stored(both.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(part, F.shiftrightunsigned(F.monotonically_increasing_id(), 33)))
    way = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(part, *keys).orderBy(way(at), way(side), F.col(tie).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the right row that each range would bring along for a key, and then what all ranges before it bring
    ends = whole.where(F.col(name).isNotNull()).groupBy(part, *keys).agg(F.max_by(name, F.struct(-F.col(at) if forward else F.col(at), tie)).alias(carry))
    ranges = whole.select(part, *keys).distinct().join(ends, [part, *keys], "left")
    before = Window.partitionBy(*keys).orderBy(way(part)).rowsBetween(Window.unboundedPreceding, -1)
    brought = stored(ranges.select(part, *keys, F.last(carry, ignorenulls=True).over(before).alias(carry)))
    seen = whole.withColumn(name, F.last(name, ignorenulls=True).over(inside)).where(F.col(row).isNotNull()).join(brought, [part, *keys], "left")
    told = seen.select(F.col(f"{row}.*"), F.coalesce(name, carry).alias(name))
    alone = l.where(~F.coalesce(sound, F.lit(False))).select(F.col(f"{row}.*"), nothing(r, name))
    return told.unionByName(alone)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str | None = None, direction: str = "backward", tolerance: float | None = None, exact: bool = True, order: list[str] = (), how: str = "left") -> DataFrame:
    """Every left row with the right row of its key that is nearest to it in time.

    ``backward``: the last right row at or before the left one's ``on``; ``forward``: the
    first at or after it; ``nearest``: the closer of both, the earlier if they are
    equally far.  ``exact=False`` leaves out equal times.  Of several right rows at one
    time the last by ``order`` counts, without an order any.  ``tolerance``: how far away
    at most, in seconds for timestamps, in days for dates.  ``how``: ``left`` or ``inner``.
    A null key or time meets nothing.  Right columns but ``by`` follow the left ones, with
    ``_right`` behind names that are taken.

    A key of any number of rows is spread over tasks by ranges of time; only the last row
    of each key goes from range to range, in a table of one row for each key in each.
    """
    right_on = right_on or on
    if direction not in DIRECTIONS:
        raise CommandError("BAD_DIRECTION", f"unknown direction: {direction}")
    if how not in ("left", "inner"):
        raise CommandError("BAD_JOIN", f"unknown join: {how}")
    _require(left, [*by, on])
    _require(right, [*by, right_on, *order])
    values, kind, u = _names(left, right, list(by)), left.schema[on].dataType, uuid.uuid4().hex[:8]
    back, ahead = f"_back_{u}", f"_ahead_{u}"
    gap = lambda c: F.abs(F.col(f"{c}.at") - _measure(F.col(f"`{on}`"), kind))
    seen = left
    for name, forward in ((back, False), (ahead, True)):
        if direction != ("backward" if forward else "forward"):
            seen = _nearest(seen, right, list(by), on, right_on, forward, exact, list(order), name, values)
    if direction == "nearest":
        seen = seen.withColumn(back, F.when(F.col(back).isNull() | (gap(ahead) < gap(back)), F.col(ahead)).otherwise(F.col(back))).drop(ahead)
    found = ahead if direction == "forward" else back
    if tolerance is not None:
        seen = seen.withColumn(found, F.when(gap(found) <= tolerance * _unit(kind), F.col(found)))
    if how == "inner":
        seen = seen.where(F.col(found).isNotNull())
    return seen.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(found)["row"][n].alias(n) for n in values.values()])


def place(column: str) -> Column:
    """A value for the choice of buckets alone: a double, the largest ones and infinity drawn in."""
    return F.greatest(F.least(F.col(column).cast("double"), F.lit(2.0**1021)), F.lit(-(2.0**1021)))


def _level(length: Column) -> Column:
    """The least power of ``STEP`` that a length does not exceed, from 0 on."""
    level = F.when(length <= 1, 0).otherwise(F.ceil(F.log(float(STEP), length) - 1e-9)).cast("int")
    return F.when(F.pow(F.lit(float(STEP)), level) < length, level + 1).otherwise(level)  # a logarithm may round down


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], closed: bool = True) -> DataFrame:
    """Pairs of rows of one key whose intervals overlap; ``closed``: common ends are enough.

    An interval's level is the power of ``STEP`` that its length does not exceed; at its
    level it lies in two buckets at most, and so does any shorter one.  Two intervals meet at the
    higher of their levels, in the bucket where the later of them starts, once.  So a long interval costs
    no more rows than a short one, and there is no width to choose.  A bucket in which very many meet is dealt to cells
    of some rows of either side (see :func:`_cells`), so that no task has it alone.  A null end or key, or an end before the start,
    meets nothing; a point is an interval whose ends are equal.  Right columns but ``by`` follow the left ones, with ``_right`` behind names that are taken.
    """
    _require(left, [*by, *left_span])
    _require(right, [*by, *right_span])
    names = _names(left, right, list(by))
    u = uuid.uuid4().hex[:8]
    keys = [f"_k{i}_{u}" for i in range(max(len(by), 1))]
    own = {"a": (left, left_span), "b": (right, right_span)}
    values = {side: {c: f"_{side}{i}_{u}" for i, c in enumerate(df.columns)} for side, (df, _) in own.items()}

    def spans(side: str) -> DataFrame:
        df, ends = own[side]
        lo, hi = (_measure(F.col(f"`{c}`"), df.schema[c].dataType) for c in ends)
        key = [F.col(f"`{c}`").cast(left.schema[c].dataType).alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias(keys[0])]
        # each column by itself, so that those nobody reads are left out
        rows = df.select(*key, lo.alias(f"{side}_lo"), hi.alias(f"{side}_hi"), *[F.col(f"`{c}`").alias(n) for c, n in values[side].items()])
        sound = F.col(f"{side}_lo") <= F.col(f"{side}_hi")
        for k in keys:
            sound = sound & F.col(k).isNotNull()
        return rows.where(sound).withColumn("level", _level(place(f"{side}_hi") - place(f"{side}_lo")))

    sides = {side: spans(side) for side in own}
    counts = {side: stored(rows.groupBy(*keys, "level").agg(F.count("*").alias("n"))) for side, rows in sides.items()}
    # a few tens at most, as widths grow by ``STEP``
    levels = {side: sorted(r[0] for r in c.select("level").distinct().collect()) for side, c in counts.items()}

    def dealt(side: str, rows: DataFrame) -> DataFrame:
        """At its own level where the other side has intervals as short, and at those of the other's levels that are above."""
        others = levels["b" if side == "a" else "a"] or [0]
        higher = F.filter(F.array(*[F.lit(k) for k in others]), lambda k: k > F.col("level"))
        wide = rows.withColumn("at", F.explode(F.concat(F.when(F.col("level") >= others[0], F.array("level")).otherwise(F.array().cast("array<int>")), higher)))
        bucket = lambda c: F.floor(place(c) / F.pow(F.lit(float(STEP)), F.col("at")))
        each = wide.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(f"{side}_lo"), bucket(f"{side}_hi")))))
        return each.withColumn(f"{side}_own", F.col("at") == F.col("level")).withColumn(f"{side}_starts", F.col("bucket") == bucket(f"{side}_lo")).drop("level")

    cells = _cells(keys, sides, counts, dealt)
    discard(*counts.values())
    on = [*keys, "at", "bucket"]
    if cells is None:
        a, b = dealt("a", sides["a"]), dealt("b", sides["b"])
    else:
        a, b = (_in_cells(dealt(side, rows.withColumn("_dice", F.rand(i))), side, on, cells) for i, (side, rows) in enumerate(sides.items()))
        on = [*on, "a_cell", "b_cell"]
    pairs = a.join(spread(b), on)
    meet = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) if closed else (F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi"))
    # at the higher level, in the bucket where the later one starts
    once = (F.col("a_own") | F.col("b_own")) & (F.col("a_starts") | F.col("b_starts"))
    return pairs.where(meet & once).select(*[F.col(values["a"][c]).alias(c) for c in left.columns], *[F.col(values["b"][c]).alias(n) for c, n in names.items()])


def _cells(keys: list[str], sides: dict[str, DataFrame], counts: dict[str, DataFrame], dealt) -> DataFrame | None:
    """(keys, at, bucket, a_cells, b_cells) of the buckets in which too many rows meet for one task; None without any.

    Only keys with as many pairs are counted by bucket, and these are few: each has some ``CELL`` rows of a side.
    """
    crowd = F.col("a_n").cast("double") * F.col("b_n") > float(CELL) ** 2
    of_key = [c.groupBy(*keys).agg(F.sum("n").alias(f"{side}_n")) for side, c in counts.items()]
    hot = stored(of_key[0].join(spread(of_key[1]), keys).where(crowd).select(*keys))
    if hot.isEmpty():
        discard(hot)
        return None
    of_bucket = [dealt(side, rows.join(hot, keys, "left_semi")).groupBy(*keys, "at", "bucket").agg(F.count("*").alias(f"{side}_n")) for side, rows in sides.items()]
    parts = [F.ceil(F.col(f"{side}_n") / CELL).cast("int").alias(f"{side}_cells") for side in sides]
    cells = stored(of_bucket[0].join(spread(of_bucket[1]), [*keys, "at", "bucket"]).where(crowd).select(*keys, "at", "bucket", *parts))
    discard(hot)
    if cells.isEmpty():
        discard(cells)
        return None
    return cells


def _in_cells(rows: DataFrame, side: str, on: list[str], cells: DataFrame) -> DataFrame:
    """Each row in one row or column of its bucket's cells, drawn by ``_dice``, so every pair meets in one cell."""
    other = "b" if side == "a" else "a"
    known = rows.join(cells, on, "left")
    drawn = F.floor(F.col("_dice") * F.coalesce(f"{side}_cells", F.lit(1))).cast("int").alias(f"{side}_cell")
    met = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_cells", F.lit(1)) - 1)).alias(f"{other}_cell")
    return known.select(*rows.columns, drawn, met).drop("_dice")


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], on: str, span: tuple[str, str], closed: bool = True) -> DataFrame:
    """Every point with the ranges of its key that hold it; see :func:`interval_join`.  ``closed=False`` leaves out the ends."""
    return interval_join(points, ranges, by, (on, on), span, closed)
