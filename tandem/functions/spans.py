"""Trailing windows whose length is a column, in one plan whatever the number of lengths.

The length of a frame is part of a plan, so frames need one plan per length. Here each series is cut into blocks of its
own window length k. The k rows that end at a row are those of its own block so far and, of the block before, those after the row
k places earlier. Sums over both are running sums inside blocks, one forwards, one backwards, and nothing is ever subtracted; the
two are put together by the rule for joining means and central moments, so each part keeps its own origin. The row k places
earlier is the one before among rows of the same place modulo k: a lag, no join.

Windows are by (series, block) and (series, place modulo k), so a long series spreads over tasks. The backward sums read later
rows of a block, but arrive k rows later only, where all of them are past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a series that are numbered in one task.
BLOCK = 8192


def numbered(rows: DataFrame, keys: tuple[str, ...], name: str = "place", by: str = "idx", block: int = BLOCK) -> DataFrame:
    """``rows`` with their number, from 0, among the rows of their series in the order of ``by``, a number that doesn't repeat in a
    series. Only one row for each ``block`` values of it meets the others of its series."""
    part = rows.withColumn("_part", F.floor(F.col(by) / block))
    counts = part.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    starts = counts.select(*keys, "_part", before.alias("_start"))
    within = part.withColumn("_within", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(by)) - 1)
    return within.join(starts, [*keys, "_part"]).withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_part", "_start", "_within")


def moments(rows: DataFrame, k: str, x: str, y: str | None = None, keys: tuple[str, ...] = ("pair_id",), place: str = "place") -> DataFrame:
    """``rows`` with the struct ``span``: n, mean_x and var_x (and mean_y, var_y, cov) over the last ``k`` rows; null before so
    many are there or where one of them has no value. ``place`` numbers the rows of a series from 0."""
    cut = rows.withColumns({"_block": F.floor(F.col(place) / F.col(k)), "_turn": F.pmod(F.col(place), F.col(k))})
    so_far = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "_block").orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)

    def part(w) -> Column:
        own = [F.count(x if y is None else F.col(x) + F.col(y)).over(w).alias("n"), F.avg(x).over(w).alias("mean_x"), (F.var_pop(x).over(w) * F.count(x).over(w)).alias("xx")]
        if y is not None:
            own += [F.avg(y).over(w).alias("mean_y"), (F.var_pop(y).over(w) * F.count(y).over(w)).alias("yy"), (F.covar_pop(x, y).over(w) * F.count(y).over(w)).alias("xy")]
        return F.struct(*own)

    both = cut.withColumns({"_own": part(so_far), "_rest": part(after)})
    # of the row k places earlier what comes after it in its block; rows of one turn are k places apart
    both = both.withColumn("_rest", F.lag("_rest").over(Window.partitionBy(*keys, "_turn").orderBy(place)))
    n1, n2 = F.coalesce(F.col("_rest.n"), F.lit(0)), F.col("_own.n")
    n = n1 + n2

    def mean(c: str) -> Column:
        return F.when(n1 == 0, F.col(f"_own.{c}")).otherwise(F.col(f"_rest.{c}") + (F.col(f"_own.{c}") - F.col(f"_rest.{c}")) * n2 / n)

    def central(c: str, u: str, v: str) -> Column:
        apart = (F.col(f"_own.{u}") - F.col(f"_rest.{u}")) * (F.col(f"_own.{v}") - F.col(f"_rest.{v}")) * n1 * n2 / n
        return F.when(n1 == 0, F.col(f"_own.{c}")).otherwise(F.col(f"_rest.{c}") + F.col(f"_own.{c}") + apart) / n

    found = [n.alias("n"), mean("mean_x").alias("mean_x"), central("xx", "mean_x", "mean_x").alias("var_x")]
    if y is not None:
        found += [mean("mean_y").alias("mean_y"), central("yy", "mean_y", "mean_y").alias("var_y"), central("xy", "mean_x", "mean_y").alias("cov")]
    return both.withColumn("span", F.when(n == F.col(k), F.struct(*found))).drop("_block", "_turn", "_own", "_rest")
