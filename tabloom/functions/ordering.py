"""Exact positions and quantiles without sorting a whole group in one task.

A group (a series, a class, a column) may hold a third of all rows.  Both helpers cut it
into ordered buckets, count per bucket with map-side combining, and only order rows
inside a bucket; the running bucket totals supply the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.stats import unpivot
from tabloom.session import durable

def with_position(
    df: DataFrame,
    group: list[str],
    order: list[str],
    bucket: Column | list[Column],
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row within its group, in `order`.

    `bucket` must never decrease along `order`; a list goes from coarse to fine, so that a busy
    coarse bucket is split by the next level.  One task orders one finest bucket, not one group,
    and the running totals of a level are taken within the level above.
    """
    levels = bucket if isinstance(bucket, list) else [bucket]
    names = [f"_b{i}" for i in range(len(levels))]
    # One struct key serves the count, the join and the window, so the rows move once; a null
    # inside a struct equals another null.
    keyed = df.withColumn("_key", F.struct(*group, *[b.alias(n) for b, n in zip(levels, names)]))
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    part = lambda depth: F.struct(*[F.col("_key")[c].alias(c) for c in [*group, *names[:depth]]])
    above = lambda at, depth: Window.partitionBy(*[F.col(at)[c] for c in [*group, *names[:depth]]])
    before = lambda at, depth, n: F.sum(n).over(above(at, depth).orderBy(F.col(at)[names[depth]])) - F.col(n)
    whole = lambda at, n: [F.sum(n).over(above(at, 0)).alias(total)] if total else []
    # every level reads the same counts, so Spark computes and shuffles them once
    last = len(names) - 1
    offsets = counts.select("_key", before("_key", last, "_n").alias("_offset"), *(whole("_key", "_n") if last == 0 else []))
    for depth in range(last):
        level = counts.groupBy(part(depth + 1).alias("_at")).agg(F.sum("_n").alias("_m"))
        level = level.select("_at", before("_at", depth, "_m").alias("_before"), *(whole("_at", "_m") if depth == 0 else []))
        offsets = offsets.withColumn("_at", part(depth + 1)).join(level, "_at").withColumn(
            "_offset", F.col("_offset") + F.col("_before")).drop("_at", "_before")
    inside = Window.partitionBy("_key").orderBy(*order)
    return (
        keyed.join(offsets, "_key")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_key", "_offset")
    )


def dense_number(values: DataFrame, group: list[str], col: str, name: str) -> DataFrame:
    """0..k−1 in the order of a group's distinct values.

    The values are dealt by ranges and written with the number of their range; numbers are offsets per
    range, so no group is ordered by one task.
    """
    dealt = values.select(*group, col).repartitionByRange(*group, col).withColumn("_p", F.spark_partition_id())
    whole = durable(dealt, "numbered").withColumn("_g", F.lit(0))
    return with_position(whole, group or ["_g"], [col], F.col("_p"), name).drop("_g", "_p")


def hash_order(key: Column | str, seed: int = 42) -> Column:
    """Portable pseudo-random order of a key: 60 bits of an MD5 as a long."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


#: Parts of equal width into which the values between two bounds are cut in a round.
PARTS = 1 << 12


def _part(value: Column, lo: Column, hi: Column) -> Column:
    """The part of a value between two bounds; the least value lies in the first part, the greatest in the last."""
    half = F.lit(0.5)  # the width of all doubles is no double
    width = hi * half - lo * half
    share = F.when(width > 0, (value * half - lo * half) / width).when(value == hi, 1.0).otherwise(0.0)
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles as rows (by…, column, p, q).

    The values between the least and the greatest one are cut into parts of equal width and counted with map-side
    combining; the parts that hold a wanted rank are cut between their own least and greatest value, until they hold
    one value: a few rounds on usual data, more only where most values crowd beside a few far ones.  Counts, not values,
    meet in a task, so neither a hot group nor a crowded part is ever ordered.  From the third round on, the rows left
    are written.  NaN is above all numbers.
    """
    key = F.struct(*by, "column").alias("_key")
    cells = unpivot(df, cols, "double", by).filter("value is not null").select(key, (F.col("value") + 0.0).alias("value"))
    count = [F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi")]
    kind = F.when(F.isnan("value"), 2).when(F.col("value") == float("inf"), 1).when(F.col("value") == float("-inf"), -1).otherwise(0)
    whole = cells.groupBy("_key", kind.alias("_slice")).agg(*count)
    upto = Window.partitionBy("_key").orderBy("_slice")
    ranks = F.explode(F.flatten(F.array(*[F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("at"),
                 fn(F.lit(float(p)) * (F.col("_total") - 1)).alias("rank")) for side, fn in (("lo", F.floor), ("hi", F.ceil))])
        for p in probs])))
    placed = whole.withColumn("_end", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(Window.partitionBy("_key")))
    found = placed.withColumn("_w", ranks).withColumn("_before", F.col("_end") - F.col("_n")).filter(
        F.col("_w.rank").between(F.col("_before"), F.col("_end") - 1))
    state = ["_key", "_w", "_before", "_lo", "_hi"]
    found = durable(found.select(*state), "ranks")
    done, left, rounds = found.filter("_lo <=> _hi"), cells, 0
    while True:
        open_ = found.filter("not (_lo <=> _hi)").withColumnsRenamed({"_lo": "_from", "_hi": "_to"})
        if open_.limit(1).count() == 0:
            break
        # open parts of a key do not overlap, so a value lies in one of them at most; a key has no more than wanted ranks
        spots = open_.select("_key", "_from", "_to").distinct()
        rows = left.join(spots, "_key").filter("value >= _from and value <= _to")
        rounds += 1
        if rounds > 2:
            rows = durable(rows, "slices")
            left = rows.select("_key", "value")
        finer = rows.groupBy("_key", "_from", "_to", _part(F.col("value"), F.col("_from"), F.col("_to")).alias("_part")).agg(*count)
        running = Window.partitionBy("_key", "_from", "_to").orderBy("_part")
        finer = finer.withColumn("_end", F.sum("_n").over(running)).join(open_, ["_key", "_from", "_to"])
        first = F.col("_before") + F.col("_end") - F.col("_n")
        hit = finer.filter(F.col("_w.rank").between(first, F.col("_before") + F.col("_end") - 1))
        found = durable(hit.select("_key", "_w", first.alias("_before"), "_lo", "_hi"), "ranks")
        done = done.unionByName(found.filter("_lo <=> _hi"))
    value = lambda side: F.max(F.when(F.col("_w.side") == side, F.col("_lo")))
    share = F.first(F.col("_w.at") - F.floor(F.col("_w.at")))
    return done.groupBy("_key", F.col("_w.p").alias("p")).agg(
        (value("lo") + F.when(value("hi") == value("lo"), 0.0).otherwise((value("hi") - value("lo")) * share)).alias("q")).select(
        "_key.*", "p", "q")


def quantile_columns(df: DataFrame, cols: list[str], probs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per column (and group) with a named quantile in each output column."""
    long = exact_quantiles(df, cols, sorted(set(probs.values())), by)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for n, p in probs.items()]
    return long.groupBy(*by, "column").agg(*aggs)


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row, one exact median per column."""
    long = exact_quantiles(df, cols, [0.5])
    return long.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in cols])
