"""Interval algebra on DataFrames of half-open intervals.

Nothing here puts a whole contig into one task. Operations along an axis work in two levels: inside
fixed blocks of coordinates, which are spread over the cluster, and over one summary row per block,
whose running values are joined back (a merge takes them in as rows). Operations between two sets join on bins of coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import axis, keys
from ..storage import is_kept

BLOCK = 1 << 18  # coordinates of a block
BIN = 1 << 12  # coordinates of a join bin

_BEFORE = (W.unboundedPreceding, -1)
_SO_FAR = (W.unboundedPreceding, W.currentRow)


def _block(position: Column, block: int) -> Column:
    return F.floor(position / F.lit(block)).cast("long")


def _carried(df: DataFrame, by: list[str], name: str, value: Column) -> DataFrame:
    """df with `name`: the aggregate of value, a maximum, over the earlier blocks of its axis."""
    heads = df.groupBy(*by, "_block").agg(value.alias("_value"))
    heads = heads.select(*by, "_block", F.max("_value").over(W.partitionBy(*by).orderBy("_block").rowsBetween(*_BEFORE)).alias(name))
    return _rejoined(df, heads, [*by, "_block"])


def _rejoined(df: DataFrame, heads: DataFrame, on: list[str]) -> DataFrame:
    h = heads.select(*[F.col(c).alias("_h" + c) if c in on else F.col(c) for c in heads.columns])
    match = F.lit(True)
    for c in on:
        match = match & df[c].eqNullSafe(h["_h" + c])
    return df.join(h, match, "left").drop(*["_h" + c for c in on])


# --- one set -------------------------------------------------------------------------------------


def merge(df: DataFrame, distance: int = 0, block: int = BLOCK) -> DataFrame:
    """Join intervals of an axis that are at most `distance` apart; empty ones go. Nulls in keys are values.

    A new interval begins where start - distance lies beyond all earlier ends, so 0 also joins
    intervals that touch, and -1 (the least) only those that overlap. Rows are shuffled and sorted once, and
    of their pieces only those at the ends of a block go on from there.
    """
    if distance < -1:
        raise ValueError("the distance must be -1 at least")
    by = keys(df)
    rows = df.filter(F.col("end") > F.col("start")).select(*by, "start", "end", _block(F.col("start"), block).alias("_block"))
    # what reached furthest before a block comes into it as a row without a start, which sorts first
    heads = rows.groupBy(*by, "_block").agg(F.max("end").alias("_end"))
    heads = heads.select(*by, "_block", F.lit(None).cast("long").alias("start"), F.max("_end").over(W.partitionBy(*by).orderBy("_block").rowsBetween(*_BEFORE)).alias("end"))
    rows = rows.unionByName(heads.filter(F.col("end") + distance >= F.col("_block") * block))
    local = W.partitionBy(*by, "_block").orderBy("start", "end")
    rows = rows.withColumns({"_reach": F.max("end").over(local.rowsBetween(*_SO_FAR)), "_lowest": F.first("start").over(local.rowsBetween(*_SO_FAR)), "_next": F.lead("start").over(local)})
    # the last rows of the pieces of a block: each begins at what followed the one before
    rows = rows.filter(F.col("_next").isNull() | (F.col("_next") - distance > F.col("_reach")))
    pieces = rows.select(*by, "_block", F.coalesce(F.lag("_next").over(local), "_lowest").alias("start"), F.col("_reach").alias("end"), F.col("_next").isNull().alias("_last"))
    # over block borders: a piece without a start goes on from the last one of an earlier block that has one.
    # Only the first and last piece of a block can be parts of others
    so_far = W.partitionBy(*by).orderBy("_block", "start").rowsBetween(*_SO_FAR)
    ends = pieces.filter("start is null or _last").select(*by, F.max("start").over(so_far).alias("start"), "end")
    ends = ends.groupBy(*by, "start").agg(F.max("end").alias("end"))
    return pieces.filter("start is not null and not _last").select(*by, "start", "end").unionByName(ends)


def normalize(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sorted disjoint intervals: empty ones go, overlapping ones join, touching ones stay apart."""
    return merge(df, -1, block)


def sort(df: DataFrame) -> DataFrame:
    """Total order by axis, then start, ties by end."""
    return df.orderBy(*keys(df), "start", "end")


def violations(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows that are empty, or begin before an earlier row of their axis ends. Touching is allowed."""
    by = keys(df)
    rows = df.withColumn("_block", _block(F.col("start"), block))
    rows = _carried(rows, by, "_reach", F.max("end"))
    before = F.greatest(F.max("end").over(W.partitionBy(*by, "_block").orderBy("start", "end").rowsBetween(*_BEFORE)), F.col("_reach"))
    return rows.withColumn("_before", before).filter((F.col("end") <= F.col("start")) | (F.col("start") < F.col("_before"))).select(*df.columns)


def check(df: DataFrame) -> DataFrame:
    """df, which is known to be normalized; else ValueError."""
    bad = violations(df).take(1)
    if bad:
        raise ValueError(f"empty or overlapping interval: {bad[0].asDict()}")
    return df


def extend(df: DataFrame, size: int) -> DataFrame:
    """Longer by size at both ends, not below 0."""
    return df.withColumn("start", F.greatest(F.col("start") - size, F.lit(0).cast("long"))).withColumn("end", F.col("end") + size)


def expand(df: DataFrame, ratio: float) -> DataFrame:
    """Longer by a ratio around the middle, not below 0."""
    if ratio <= 0:
        raise ValueError("the ratio must be positive")
    more = F.floor((F.col("end") - F.col("start")) * F.lit(float(ratio) - 1) / 2).cast("long")
    return df.withColumn("_more", more).withColumn("start", F.greatest(F.col("start") - F.col("_more"), F.lit(0).cast("long"))).withColumn("end", F.col("end") + F.col("_more")).drop("_more")


def shift(df: DataFrame, offset: int) -> DataFrame:
    """Moved by offset; a start below 0 is an error when the row is read."""
    moved = F.col("start") + offset
    legal = F.when(moved < 0, F.raise_error(F.lit("shifted below 0")).cast("long")).otherwise(moved)
    return df.withColumn("end", F.col("end") + offset).withColumn("start", legal)


def truncate(df: DataFrame, start: int, end: int) -> DataFrame:
    """The parts within one range, normalized."""
    cut = df.withColumn("start", F.greatest("start", F.lit(start).cast("long"))).withColumn("end", F.least("end", F.lit(end).cast("long")))
    return normalize(cut)


def _ordinal(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Normalized df with `_c`, the bases of its axis before each row."""
    by, length = keys(df), F.col("end") - F.col("start")
    rows = df.filter("end > start").select(*by, "start", "end", _block(F.col("start"), block).alias("_block"))
    heads = rows.groupBy(*by, "_block").agg(F.sum(length).alias("_n"))
    heads = heads.select(*by, "_block", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_block").rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(length).over(W.partitionBy(*by, "_block").orderBy("start").rowsBetween(*_BEFORE)), F.lit(0))
    return _rejoined(rows, heads, [*by, "_block"]).withColumn("_c", F.col("_base") + own).drop("_base", "_block")


def _circular(df: DataFrame, begin: Column, size: int, keep: bool) -> DataFrame:
    """The `size` bases of each axis from its base number `begin` (an aggregate), wrapping at the end; or all others."""
    by = keys(df)
    ends = df.filter("end > start").groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("_total"), begin.alias("_begin"))
    ends = ends.withColumn("_size", F.least(F.lit(size).cast("long"), F.col("_total"))).withColumn("_begin", F.pmod("_begin", "_total"))
    rows = _rejoined(_ordinal(df), ends, by)
    stop = F.col("_begin") + F.col("_size")
    wrapped = F.greatest(stop - F.col("_total"), F.lit(0).cast("long"))
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    ranges = [part(F.col("_begin"), F.least(stop, F.col("_total"))), part(F.lit(0).cast("long"), wrapped)] if keep else [part(wrapped, F.col("_begin")), part(F.least(stop, F.col("_total")), F.col("_total"))]
    pieces = rows.withColumn("_r", F.explode(F.array(*ranges)))
    lo, hi = F.greatest(F.col("_c"), F.col("_r.lo")), F.least(F.col("_c") + F.col("end") - F.col("start"), F.col("_r.hi"))
    return pieces.withColumns({"_lo": lo, "_hi": hi}).filter("_hi > _lo").select(*by, (F.col("start") + F.col("_lo") - F.col("_c")).alias("start"), (F.col("start") + F.col("_hi") - F.col("_c")).alias("end"))


def _bases_below(pos: int) -> Column:
    return F.sum(F.greatest(F.least(F.col("end"), F.lit(pos)) - F.col("start"), F.lit(0)))


def trim(df: DataFrame, pos: int, size: int) -> DataFrame:
    """Normalized intervals without the `size` bases of each axis from position pos on, wrapping; may split an interval."""
    return _circular(df, _bases_below(pos), size, False)


def trim_ends(df: DataFrame, pos: int, size: int, forward: bool = True) -> DataFrame:
    """Without `size` bases from the start of the interval that holds or follows pos (or back from its end), wrapping."""
    before = F.coalesce(F.sum(F.when(F.col("end") <= pos, F.col("end") - F.col("start"))), F.lit(0))
    if forward:
        return _circular(df, before, size, False)
    at = F.coalesce(F.min(F.when(F.col("end") > pos, F.struct("start", "end"))), F.min(F.struct("start", "end")))
    before = F.when(F.max("end") > pos, before).otherwise(0)
    return _circular(df, before + at["end"] - at["start"] - size, size, False)


def fill_from_start(df: DataFrame, start: int, size: int) -> DataFrame:
    """The first `size` bases of each axis from position start on, wrapping; all of a shorter one."""
    return _circular(df, _bases_below(start), size, True)


def fill_from_end(df: DataFrame, end: int, size: int) -> DataFrame:
    """The last `size` bases of each axis before position end, wrapping; all of a shorter one."""
    return _circular(df, _bases_below(end) - size, size, True)


def midpoints(df: DataFrame, method: str = "midpoint") -> DataFrame:
    """Points at the midpoint, start or end of intervals; empty ones go."""
    at = {"midpoint": F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long"), "start": F.col("start"), "end": F.col("end")}
    if method not in at:
        raise ValueError(f"method must be one of {sorted(at)}")
    return df.filter("end > start").withColumn("pos", at[method]).drop("start", "end")


def _gaps_before(df: DataFrame, lowest: int, block: int) -> DataFrame:
    """The gap, if any, that ends where a row begins."""
    by = keys(df)
    rows = df.filter("end > start").select(*by, "start", "end", _block(F.col("start"), block).alias("_block"))
    rows = _carried(rows, by, "_reach", F.max("end"))
    before = F.coalesce(F.greatest(F.max("end").over(W.partitionBy(*by, "_block").orderBy("start", "end").rowsBetween(*_BEFORE)), F.col("_reach")), F.lit(lowest).cast("long"))
    return rows.select(*by, before.alias("_from"), F.col("start").alias("end")).select(*by, F.col("_from").alias("start"), "end").filter("end > start")


def gaps(df: DataFrame, lowest: int = 0, highest: int = (1 << 31) - 1, block: int = BLOCK) -> DataFrame:
    """What intervals leave of [lowest, highest) on each axis that has any."""
    by = keys(df)
    after = df.filter("end > start").groupBy(*by).agg(F.max("end").alias("start")).select(*by, "start", F.lit(highest).cast("long").alias("end"))
    return _gaps_before(df, lowest, block).unionByName(after.filter("end > start"))


# --- two sets ------------------------------------------------------------------------------------


_LEVELS = 4  # each with bins 32 times as wide as those of the one below
_WIDER = 5


def _level(df: DataFrame, suffix: str, width: int) -> Column:
    """The narrowest level at which an interval touches no more than 33 bins; 0 of points."""
    if "pos" + suffix in df.columns:
        return F.lit(0)
    length = F.col("end" + suffix) - F.col("start" + suffix)
    out = F.lit(_LEVELS - 1)
    for k in range(_LEVELS - 2, -1, -1):
        out = F.when(length <= width << (_WIDER * (k + 1)), F.lit(k)).otherwise(out)
    return out


def _highest(df: DataFrame, width: int) -> Column:
    """The highest level of any row, as a scalar subquery."""
    if "pos" in df.columns:
        return F.lit(0)
    return F.coalesce(df.agg(F.max(_level(df, "", width))).scalar(), F.lit(0))


def _binned(df: DataFrame, width: int, highest: Column | None = None) -> DataFrame:
    """A row per bin that the interval (or point) touches; with `highest`, at its own level and all above that are in use."""
    first, last = (F.col("pos"), F.col("pos")) if "pos" in df.columns else (F.col("start"), F.col("end") - 1)
    rows = df if "pos" in df.columns else df.filter("end > start")
    if highest is None:
        return rows.withColumn("_bin", F.explode(F.sequence(_block(first, width), _block(last, width))))
    own, none = _level(df, "", width), F.array().cast("array<bigint>")
    parts = []
    for k in range(_LEVELS):
        at = lambda x, k=k: _block(x, width << (_WIDER * k)) * _LEVELS + k
        parts.append(F.when((own <= k) & (highest >= k), F.sequence(at(first), at(last), F.lit(_LEVELS).cast("long"))).otherwise(none))
    return rows.withColumn("_bin", F.explode(F.concat(*parts)))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN, suffix: str = "_b", nested: bool | None = None) -> DataFrame:
    """All pairs that overlap on a common contig (and isochore, if both have it); points lie in intervals.

    Right columns get the suffix. With nested bins two intervals meet at the level of the longer, so a long one takes
    some dozen rows at most, and a short one a row or two more for each level that any row of either side needs;
    that takes the largest length first, so by default bins are nested where both sides are kept tables, in
    which it costs little, and of one width otherwise. A pair that shares several bins is kept in its first common one.
    """
    on = [c for c in axis(left) if c in right.columns]
    if nested is None:
        nested = is_kept(left) and is_kept(right)
    highest = F.greatest(_highest(left, width), _highest(right, width)) if nested else None
    a = _binned(left, width, highest)
    b = _binned(right, width, highest)
    b = b.select(*[F.col(c).alias(c + suffix) for c in b.columns])
    bounds = lambda cols, s: (F.col("pos" + s), F.col("pos" + s) + 1) if "pos" + s in cols else (F.col("start" + s), F.col("end" + s))
    (s1, e1), (s2, e2) = bounds(a.columns, ""), bounds(b.columns, suffix)
    match = a["_bin"] == b["_bin" + suffix]
    for c in on:
        match = match & (a[c].eqNullSafe(b[c + suffix]) if c == "isochore" else a[c] == b[c + suffix])
    first = _block(F.greatest(s1, s2), width)
    if nested:
        level = F.greatest(_level(a, "", width), _level(b, suffix, width))
        first = F.lit(None).cast("long")
        for k in range(_LEVELS):
            first = F.when(level == k, _block(F.greatest(s1, s2), width << (_WIDER * k)) * _LEVELS + k).otherwise(first)
    # files of repeated names are a small part of their rows' size, so by size either side might pass for a broadcast,
    # which the driver would have to hold
    pairs = a.join(b.hint("merge"), match & (s1 < e2) & (s2 < e1) & (a["_bin"] == first))
    return pairs.drop("_bin", "_bin" + suffix)


def intersect(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """The common part of every pair that overlaps; left columns stay."""
    pairs = overlap_join(left, right, width)
    return pairs.withColumns({"start": F.greatest("start", "start_b"), "end": F.least("end", "end_b")}).select(*left.columns)


def overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Left rows, whole, that overlap any right row (semi join); repeated rows stay repeated."""
    return _semi(left, overlap_join(left, right, width), "left_semi")


def not_overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Left rows that overlap no right row (anti join)."""
    return _semi(left, overlap_join(left, right, width), "left_anti")


def _semi(left: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    of = [*keys(left), *(c for c in ("start", "end", "pos") if c in left.columns)]
    hit = pairs.select(*[F.col(c).alias("_" + c) for c in of]).distinct()
    match = F.lit(True)
    for c in of:
        match = match & (left[c].eqNullSafe(hit["_" + c]) if c in keys(left) else left[c] == hit["_" + c])
    return left.join(hit.hint("merge"), match, how)  # as in overlap_join


def midpoint_in(left: DataFrame, right: DataFrame, width: int = BIN, first_only: bool = False) -> DataFrame:
    """Left rows whose midpoint lies in any right row; or in the first that overlaps them."""
    mid = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long")
    pairs = overlap_join(left, right, width)
    if first_only:
        of = [*keys(left), "start", "end"]
        pairs = pairs.groupBy(*of).agg(F.min_by(F.struct("start_b", "end_b"), F.struct("start_b", "end_b")).alias("_f")).withColumns({"start_b": F.col("_f.start_b"), "end_b": F.col("_f.end_b")})
    return _semi(left, pairs.filter((mid >= F.col("start_b")) & (mid < F.col("end_b"))), "left_semi")


def subtract(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """What right leaves of the left rows: their common parts with right's gaps, and what lies beyond its end.

    Right may overlap itself.
    """
    on = [c for c in axis(left) if c in right.columns]
    other = right.select(*on, "start", "end")
    rows = left.filter("end > start")
    pieces = intersect(rows, _gaps_before(other, 0, BLOCK), width)
    last = other.filter("end > start").groupBy(*on).agg(F.max("end").alias("_last"))
    rest = _rejoined(rows, last, on).withColumn("start", F.greatest("start", "_last")).filter("end > start")
    return pieces.unionByName(rest.select(*left.columns))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sets' rows, not normalized."""
    return left.unionByName(right, allowMissingColumns=True)


# --- look-ups along an axis ------------------------------------------------------------------------


def lookup(points: DataFrame, rows: DataFrame, on: list[str], block: int = BLOCK) -> DataFrame:
    """points (with pos) and `before`, the last row of their axis with start <= pos, and `after`, the first beyond it.

    Rows are structs of their columns, null where there is none. Both sides are dealt out once, by blocks of
    coordinates; what lies before and after a block comes into it as two rows. Nulls in `on` are values.
    """
    row = F.struct("start", *[c for c in rows.columns if c != "start" and c not in on])
    r = rows.select(*on, F.col("start").alias("_pos"), F.lit(0).alias("_ord"), row.alias("_row")).withColumn("_block", _block(F.col("_pos"), block))
    p = points.select(*on, F.col("pos").alias("_pos"), F.lit(1).alias("_ord"), F.struct(*points.columns).alias("_pt")).withColumn("_block", _block(F.col("_pos"), block))
    heads = r.groupBy(*on, "_block").agg(F.max("_row").alias("_l"), F.min("_row").alias("_f"))
    heads = heads.unionByName(p.select(*on, "_block").distinct(), allowMissingColumns=True).groupBy(*on, "_block").agg(F.max("_l").alias("_l"), F.min("_f").alias("_f"))
    order = W.partitionBy(*on).orderBy("_block")
    heads = heads.select(*on, "_block", F.last("_l", ignorenulls=True).over(order.rowsBetween(*_BEFORE)).alias("_l"), F.last("_f", ignorenulls=True).over(W.partitionBy(*on).orderBy(F.desc("_block")).rowsBetween(*_BEFORE)).alias("_f"))
    ends = F.array(F.struct(F.lit(-1).alias("_ord"), F.col("_l").alias("_row")), F.struct(F.lit(2).alias("_ord"), F.col("_f").alias("_row")))
    carried = heads.select(*on, "_block", F.inline(ends)).filter("_row is not null").withColumn("_pos", F.when(F.col("_ord") < 0, F.col("_block") * block).otherwise(F.col("_block") * block + block))
    every = r.unionByName(carried).unionByName(p, allowMissingColumns=True)
    # a window that runs backwards, as one that looks ahead would read the rest of the block for every row
    onward = W.partitionBy(*on, "_block").orderBy("_pos", "_ord", "_row").rowsBetween(*_SO_FAR)
    back = W.partitionBy(*on, "_block").orderBy(F.desc("_pos"), F.desc("_ord"), F.desc("_row")).rowsBetween(*_SO_FAR)
    found = every.withColumns({"before": F.last("_row", ignorenulls=True).over(onward), "after": F.last("_row", ignorenulls=True).over(back)})
    return found.filter("_pt is not null").select("_pt.*", "before", "after")


def numbered(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Normalized intervals with `n` and `bases`, the intervals and bases of their axis before them, and `gaps`: the gaps up to their start."""
    by, length = keys(df), F.col("end") - F.col("start")
    rows = df.filter("end > start").select(*by, "start", "end", _block(F.col("start"), block).alias("_block"))
    local = W.partitionBy(*by, "_block").orderBy("start")
    zero = F.lit(0).cast("long")
    before = local.rowsBetween(*_BEFORE)
    prior = F.max("end").over(before)
    rows = rows.withColumn("_gap", F.when(prior.isNotNull() & (F.col("start") > prior), 1).otherwise(0))
    heads = rows.groupBy(*by, "_block").agg(F.sum(length).alias("_b"), F.count("*").alias("_k"), F.sum("_gap").alias("_g"), F.min("start").alias("_s"), F.max("end").alias("_e"))
    order = W.partitionBy(*by).orderBy("_block").rowsBetween(*_BEFORE)
    heads = heads.withColumn("_open", (F.col("_s") > F.coalesce(F.max("_e").over(order), zero)).cast("int"))
    sums = [F.coalesce(F.sum(c).over(order), zero).alias(name) for c, name in (("_b", "_bases"), ("_k", "_n"))]
    heads = heads.select(*by, "_block", *sums, (F.coalesce(F.sum(F.col("_g") + F.col("_open")).over(order), zero) + F.col("_open")).alias("_gaps"))
    own = lambda c: F.coalesce(F.sum(c).over(before), zero)
    found = _rejoined(rows, heads, [*by, "_block"])
    return found.select(*by, "start", "end", (F.col("_n") + own(F.lit(1))).alias("n"), (F.col("_bases") + own(length)).alias("bases"), (F.col("_gaps") + F.sum("_gap").over(local.rowsBetween(*_SO_FAR))).alias("gaps"))


def insertion_points(df: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (contig, pos and others) and `insertion_point` in each track's normalized intervals: -1 before the first,
    their number beyond the last, else the number of the interval that holds or precedes the position."""
    on = [c for c in keys(df) if c != "track"]
    tracks = df.select("track").distinct()  # names only
    points = positions.join(tracks)
    rows = numbered(df)
    size = rows.groupBy(*keys(df)).agg(F.count("*").alias("_size"), F.max("end").alias("_end"))
    found = lookup(points, rows, ["track", *on])
    out = _rejoined(found, size, keys(df))
    at = F.when(F.col("before").isNull(), F.lit(-1).cast("long")).when(F.col("pos") >= F.col("_end"), F.col("_size")).otherwise(F.col("before.n"))
    return out.filter("_size is not null").select(*points.columns, at.alias("insertion_point"))


def in_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows that overlap one range."""
    if "pos" in df.columns:
        return df.filter((F.col("pos") >= start) & (F.col("pos") < end))
    return df.filter((F.col("start") < end) & (F.col("end") > start))


def overlap_with_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Per axis: bases within one range (points: their number)."""
    rows = in_range(df, start, end)
    size = F.count("*") if "pos" in df.columns else F.sum(F.least("end", F.lit(end)) - F.greatest("start", F.lit(start)))
    return rows.groupBy(*keys(df)).agg(size.cast("long").alias("overlap"))


def depths(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stretches of each axis with `n`, how many rows cover them; axes: the columns of keys(df)."""
    by = keys(df)
    rows = df.filter("end > start")
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
    events = rows.select(*by, F.inline(ends)).groupBy(*by, "pos").agg(F.sum("d").alias("d")).filter("d <> 0").withColumn("_block", _block(F.col("pos"), block))
    heads = events.groupBy(*by, "_block").agg(F.sum("d").alias("_d"), F.min("pos").alias("_at"))
    order = W.partitionBy(*by).orderBy("_block")
    heads = heads.select(*by, "_block", F.coalesce(F.sum("_d").over(order.rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"), F.lead("_at").over(order).alias("_after"))
    local = W.partitionBy(*by, "_block").orderBy("pos")
    events = _rejoined(events, heads, [*by, "_block"])
    deep = events.select(*by, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(local), F.col("_after")).alias("end"), (F.sum("d").over(local.rowsBetween(*_SO_FAR)) + F.col("_base")).alias("n"))
    return deep.filter("end is not null and n > 0")


def coverage(df: DataFrame, depth: int | Column, block: int = BLOCK) -> DataFrame:
    """Maximal stretches that at least `depth` rows of an axis cover; axes: the columns of keys(df)."""
    return merge(depths(df, block).filter(F.col("n") >= depth), 0, block)


def equal(left: DataFrame, right: DataFrame) -> bool:
    """The same rows, each as often."""
    names = [*keys(left), "start", "end"]
    a, b = left.select(*names), right.select(*names)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
