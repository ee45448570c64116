"""Running values over long ordered histories, without one task per key.

A plain window over one camera puts the whole history of that camera into one task,
and one camera may hold a third of all rows. Here the history is cut into time slices:
a window runs inside each (key, slice); each slice is also reduced to one summary row
(with map-side combine), a window over the summaries finds what enters each slice, and
an equi-join adds it. A key has one summary row per slice, so the second window holds at
most (span of the archive / slice width) rows per key, whatever the number of rows.

Where a window inside the slices costs much, or few of its rows are wanted, its result is
written (`session.cut`), and a slice's summary is then the last of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightings.functions.columns import as_column
from sightings.functions.timing import HOUR, time_bucket
from sightings.session import cut


@dataclass(frozen=True)
class Running:
    """One running value: `how` is last, before, lag, total or highest."""

    how: str
    value: Column


def last(value: Column | str) -> Running:
    """Last non-null value up to and including the row."""
    return Running("last", as_column(value))


def before(value: Column | str) -> Running:
    """Last non-null value strictly before the row."""
    return Running("before", as_column(value))


def lag(value: Column | str) -> Running:
    """Value of the row before; null only if that value is null or there is no such row."""
    return Running("lag", F.struct(as_column(value).alias("v")))


def total(value: Column | str) -> Running:
    """Sum up to and including the row."""
    return Running("total", as_column(value))


def highest(value: Column | str) -> Running:
    """Maximum up to and including the row."""
    return Running("highest", as_column(value))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Running],
    slice_s: int = HOUR,
    reverse: bool = False,
    keep: Column | None = None,
) -> DataFrame:
    """Add running values to `df`, per `keys`, in the order of `order` (a time column first).

    With `reverse` the order is descending, so "last" reads "next". With `keep` only those rows
    are returned, the others just hand on their values; `df` is then read once and a job is run.
    """
    keys, order = list(keys), list(order)
    part = [*keys, "_slice"]
    d = df.withColumn("_slice", time_bucket(order[0], slice_s))
    for name, r in values.items():
        d = d.withColumn(f"_in_{name}", r.value)

    def sort(names):
        return [F.desc(n) if reverse else F.asc(n) for n in names]

    inside = Window.partitionBy(*part).orderBy(*sort(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys) if keys else Window
    across = across.orderBy(*sort(["_slice"])).rowsBetween(Window.unboundedPreceding, -1)

    place = F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    summary, entering, local = [], [], {}
    for name, r in values.items():
        v = F.col(f"_in_{name}")
        if r.how in ("last", "before", "lag"):
            summary.append(pick(v, F.when(v.isNotNull(), place)).alias(name))
            entering.append(F.last(name, ignorenulls=True).over(across).alias(f"_pre_{name}"))
            frame = upto if r.how == "last" else earlier
            local[f"_loc_{name}"] = (
                F.lag(v).over(inside)
                if r.how == "lag"
                else F.last(v, ignorenulls=True).over(frame)
            )
        elif r.how == "total":
            summary.append(F.sum(v).alias(name))
            entering.append(F.sum(name).over(across).alias(f"_pre_{name}"))
            local[f"_loc_{name}"] = F.sum(v).over(upto)
        else:
            summary.append(F.max(v).alias(name))
            entering.append(F.max(name).over(across).alias(f"_pre_{name}"))
            local[f"_loc_{name}"] = F.max(v).over(upto)

    if keep is None:
        sums, out = d.groupBy(*part).agg(*summary), d.withColumns(local)
    else:
        ends = {
            f"_end_{name}": F.last(F.col(f"_in_{name}"), ignorenulls=True).over(upto)
            for name, r in values.items()
            if r.how in ("before", "lag")
        }
        out = d.withColumns({"_tail": F.lead(F.lit(1)).over(inside).isNull(), "_keep": F.coalesce(keep, F.lit(False))})
        out = out.withColumns({**local, **ends}).filter(F.col("_tail") | F.col("_keep"))
        out = cut(out.drop(*[f"_in_{name}" for name in values]))
        at_end = [F.col(e if (e := f"_end_{name}") in ends else f"_loc_{name}").alias(name) for name in values]
        sums = out.filter("_tail").select(*part, *at_end)
        out = out.filter("_keep").drop("_tail", "_keep", *ends)
    out = out.join(sums.select(*part, *entering), part, "left")
    for name, r in values.items():
        here, pre = F.col(f"_loc_{name}"), F.col(f"_pre_{name}")
        if r.how == "total":
            zero = F.lit(0)
            both = F.when(
                here.isNotNull() | pre.isNotNull(),
                F.coalesce(here, zero) + F.coalesce(pre, zero),
            )
        elif r.how == "highest":
            both = F.greatest(here, pre)
        else:
            both = F.coalesce(here, pre)
        out = out.withColumn(name, both["v"] if r.how == "lag" else both)
    return out.drop(
        "_slice", *[f"{p}{n}" for n in values for p in ("_in_", "_loc_", "_pre_")]
    )


def rows_since(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reset: Column,
    out: str,
    slice_s: int = HOUR,
) -> DataFrame:
    """Number of rows after the last one with `reset` (from the start where there is none)."""
    keys, order = list(keys), list(order)
    part = [*keys, "_slice"]
    d = df.withColumn("_slice", time_bucket(order[0], slice_s)).withColumn("_reset", reset)
    inside = Window.partitionBy(*part).orderBy(*order)
    d = d.withColumn("_pos", F.row_number().over(inside))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_at", F.max(F.when(F.col("_reset"), F.col("_pos"))).over(upto))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = d.groupBy(*part).agg(F.max("_pos").alias("_n"), F.max("_at").alias("_end_at"))
    sums = sums.withColumn("_rows", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    place = F.max(F.col("_rows") + F.col("_end_at")).over(across)
    sums = sums.withColumn("_carried", F.col("_rows") - F.coalesce(place, F.lit(0)))
    since = F.col("_pos") - F.coalesce("_at", -F.col("_carried"))
    return (
        d.join(sums.select(*part, "_carried"), part, "left")
        .withColumn(out, since)
        .drop("_slice", "_reset", "_pos", "_at", "_carried")
    )


def held(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: Column,
    row_id: str,
    prev_id: str,
    out: str,
    slice_s: int = HOUR,
) -> DataFrame:
    """Whether `flag` was set in the unbroken run of rows that ends here.

    A row continues the run of the row before it if that row's `row_id` is its `prev_id`. Rows
    with a column `_slice` have their slice already. Runs a job, as the rows are written.
    """
    keys, order = list(keys), list(order)
    part = [*keys, "_slice"]
    d = df if "_slice" in df.columns else df.withColumn("_slice", time_bucket(order[0], slice_s))
    d = d.withColumn("_flag", flag)
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_pos", F.row_number().over(inside)).withColumn(
        "_before", F.lag(row_id).over(inside)
    )
    joined = F.col("_before").eqNullSafe(F.col(prev_id))
    # First row of the current run, 0 where the run may reach back into an earlier slice.
    d = d.withColumn(
        "_from",
        F.max(
            F.when(F.col("_pos") == 1, F.lit(0)).when(~joined, F.col("_pos")).otherwise(0)
        ).over(upto),
    )
    d = d.withColumn("_set", F.max(F.when(F.col("_flag"), F.col("_pos"))).over(upto))
    d = d.withColumn("_here", F.coalesce(F.col("_set") >= F.greatest("_from", F.lit(1)), F.lit(False)))
    d = d.withColumn("_tail", F.lead(F.lit(1)).over(inside).isNull())
    d = cut(d.withColumn("_first_prev", F.first(prev_id).over(upto)).drop("_flag", "_pos", "_before", "_set"))
    sums = d.filter("_tail").select(
        *part,
        "_first_prev",
        F.col(row_id).alias("_last_id"),
        F.col("_from").alias("_end_from"),
        F.col("_here").alias("_end_here"),
    )
    steps = Window.partitionBy(*keys).orderBy("_slice")
    past = steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = F.coalesce(F.lag("_last_id").over(steps) == F.col("_first_prev"), F.lit(False))
    sums = sums.withColumn("_linked", linked)
    through = F.col("_linked") & (F.col("_end_from") == 0)
    sums = sums.withColumn("_lost", F.max(F.when(~through, F.col("_slice"))).over(past))
    sums = sums.withColumn("_won", F.max(F.when(F.col("_end_here"), F.col("_slice"))).over(past))
    end = F.coalesce(F.col("_won") >= F.col("_lost"), F.lit(False)) | (
        F.col("_won").isNotNull() & F.col("_lost").isNull()
    )
    sums = sums.withColumn("_end", end)
    entering = F.col("_linked") & F.coalesce(F.lag("_end").over(steps), F.lit(False))
    sums = sums.select(*part, entering.alias("_enter"))
    return (
        d.join(sums, part, "left")
        .withColumn(out, F.col("_here") | ((F.col("_from") == 0) & F.col("_enter")))
        .drop("_slice", "_from", "_here", "_tail", "_first_prev", "_enter")
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    time: str,
    values: Sequence[str],
    right_time: str | None = None,
    forward: bool = False,
    tie: Sequence[str] = (),
    slice_s: int = HOUR,
) -> DataFrame:
    """As-of join without a range join: the latest right row at or before each left row.

    With `forward`, the first right row strictly after it. `tie` orders right rows of equal
    time. Left rows without a match get nulls.
    """
    right_time = right_time or time
    lcols = left.columns
    lrow = F.struct(*[F.col(c) for c in lcols]).alias("_left")
    rrow = F.struct(*[F.col(c) for c in values]).alias("_right")
    ties = [F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)]
    no_tie = [
        F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(tie)
    ]
    l = left.select(*on, F.col(time).alias("_time"), F.lit(1).alias("_side"), lrow, *no_tie)
    r = right.select(*on, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), rrow, *ties)
    both = l.unionByName(r, allowMissingColumns=True)
    order = ["_time", "_side", *[f"_tie{i}" for i in range(len(tie))]]
    own = F.col("_side") == 1
    hit = running(both, on, order, {"_hit": last("_right")}, slice_s, reverse=forward, keep=own)
    return hit.select(
        "_left.*", *[F.col("_hit")[v].alias(v) for v in values]
    )
