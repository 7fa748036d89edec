"""Sets of intervals [start, end) over texts, by windows: no join of spans with spans.

Every operator works within the columns `keys`, one text; a text's spans are sorted once, and a running
maximum of ends answers what a range join would. Rows without start or end are treated as lying nowhere. Columns that an operator adds
replace input columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column of `taken` has it."""
    while name in taken:
        name += "_"
    return name


def contained(spans: DataFrame, keys: list[str], out: str = "contained", ties: list[str] | None = None) -> DataFrame:
    """spans with `out`: whether another span holds the row's; of equal spans the first by `ties` counts as the outer one."""
    order = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), F.col("end").desc_nulls_last(), *(ties or []))
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn(out, F.coalesce(reached >= F.col("end"), F.lit(False)))


def outermost(spans: DataFrame, keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """The spans that no other span holds, one of each set of equal ones: wide ones are claimed first."""
    name = free_name("held", spans.columns)
    return contained(spans, keys, name, ties).where(~F.col(name)).drop(name)


def covered(points: DataFrame, spans: DataFrame, keys: list[str], out: str = "covered", whole: bool = False) -> DataFrame:
    """points (keys, start, end) with `out`: whether a span holds their start or, if `whole`, shares any place with them.

    Both tables go through one sweep in order of place; a point meets the running maximum of the ends before it, and, if `whole`, the next start.
    """
    rest = [c for c in points.columns if c not in (*keys, out)]
    side, held, found_ = (free_name(n, keys) for n in ("side", "held", "found"))
    a = points.select(*keys, "start", "end", F.lit(1).alias(side), F.struct(*(points[f"`{c}`"].alias(c) for c in rest)).alias(held))
    b = spans.select(*keys, "start", "end", F.lit(0).alias(side), F.lit(None).cast(a.schema[held].dataType).alias(held))
    w = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), side)
    reached = F.max(F.when(F.col(side) == 0, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = reached > F.col("start")
    if whole:
        following = F.min(F.when(F.col(side) == 0, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
        found = F.coalesce(found, F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    swept = a.unionByName(b).withColumn(found_, F.coalesce(found, F.lit(False))).where(F.col(side) == 1)
    columns = [F.col(k) if k in keys else F.col(held)[k].alias(k) for k in points.columns if k != out]
    return swept.select(*columns, F.col(found_).alias(out))


def closed(tags: DataFrame, keys: list[str], out: str = "close") -> DataFrame:
    """Opening tags (name, start, end, opens) with `out`: the end of the tag that closes them, null where none does.

    A running sum of openings less closings is the depth; an opening is closed by the next tag of its name and depth.
    """
    by_name = Window.partitionBy(*keys, "name")
    step = F.when(F.col("opens"), 1).otherwise(-1)
    depth = F.sum(step).over(by_name.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("opens"), 0).otherwise(1)
    level = free_name("depth", tags.columns)
    deep = tags.withColumn(level, depth)
    following = Window.partitionBy(*keys, "name", level).orderBy("start")
    end = F.when(~F.lead("opens").over(following), F.lead("end").over(following))
    return deep.withColumn(out, end).where("opens").drop(level)


def _chosen(starts, ends):
    """For each list of starts and ends, in order, whether a span begins where the last chosen one has ended."""
    import pandas as pd

    out = []
    for s, e in zip(starts, ends):
        upto, flags = -1, []
        for a, b in zip(s, e):
            flags.append(bool(a >= upto))
            upto = b if flags[-1] else upto
        out.append(flags)
    return pd.Series(out, dtype=object)


def first_come(spans: DataFrame, keys: list[str], ties: list[str] | None = None, out: str = "chosen") -> DataFrame:
    """spans with `out`: taken from the left, whether a span begins at or after the end of the last one taken.

    Unlike containment this depends on every choice before, so a text's spans are folded in order; at one start, `ties` decide.
    """
    rest = [c for c in spans.columns if c not in (*keys, out, "start", *(ties or []))]
    order = ["start", *(ties or []), *rest]
    rows = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order)), _by(["start", *(ties or [])])).alias("rows"))  # of one text
    choose = F.pandas_udf(_chosen, T.ArrayType(T.BooleanType()))
    rows = rows.withColumn("flags", choose(F.col("rows.start"), F.col("rows.end")))
    found = rows.select(*keys, F.explode(F.arrays_zip("rows", "flags")).alias("x"))
    return found.select(*(F.col(c) if c in keys else F.col("x.rows")[c].alias(c) for c in spans.columns if c != out), F.col("x.flags").alias(out))


def _by(names: list[str]):
    """A comparison of structs by the named fields."""

    def compare(a: Column, b: Column) -> Column:
        found = F.lit(0)
        for n in reversed(names):
            found = F.when(a[n] < b[n], -1).when(a[n] > b[n], 1).otherwise(found)
        return found

    return compare
