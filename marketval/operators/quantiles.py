"""Exact medians and percentiles, distributed, for groups of any size.

The built-in aggregates hold one value map per group in one buffer, which a market with a third of
all rows does not fit. Percentiles go by rank instead, in two readings of narrow stored values. The
first counts values per cell, a narrow slice of the value axis, with map-side combine; a group has as
many cells as its range of values, whatever the number of its rows. Cumulative counts say which cell
holds each wanted rank. The second takes the rows of those cells alone and puts them in order. There
is one plan, whatever the size; its numbers equal those of the built-in `percentile`.

Groups may overlap: rows belong to atoms, and `members` lists the atoms of each group. A row is then
counted once per atom, and a group's counts are sums over its atoms.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketval.operators.sizing import Dim, written

# Cells per e-fold of the value: about 0.2 % of the value in width. The different values of a cell
# that holds a wanted rank are put in order by one task.
CELLS_PER_EFOLD = 512
_CELL_OFFSET = 440_000
# Infinities have cells of their own, and NaN, the greatest value, the last one.
_INFINITE, _NAN = 1 << 40, 1 << 41


def value_cell(value: Column) -> Column:
    """Order-preserving slice number of a double."""
    v = value.cast("double")
    size = F.abs(v)
    finite = ~F.isnan(v) & (size != float("inf"))
    depth = F.floor(F.ln(F.when(finite, size)) * CELLS_PER_EFOLD).cast("long") + _CELL_OFFSET
    cell = F.when(v == 0, F.lit(0)).when(finite, depth).otherwise(_INFINITE)
    return F.when(F.isnan(v), F.lit(_NAN)).when(v < 0, -cell).otherwise(cell).cast("long")


@dataclass
class Members:
    """The atoms of each group: `table` has the columns `atom` and `group`, each pair once."""

    table: DataFrame
    atom: list[str]
    group: list[str]


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, NULL being a value like any other. Right columns named alike go."""
    other = right.toDF(*[f"_on_{c}" if c in on else c for c in right.columns])
    match = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(other, match, how).drop(*[f"_on_{c}" for c in on])


def _ranked(
    rows: DataFrame, by: list[str], ranks: Callable[[Column], Column], members: Members | None
) -> DataFrame:
    """`rows` has the atoms (or `by`) and `_v`; it is read twice and should be cheap to read."""
    atom = members.atom if members else by
    # Columns that are not the group's own tell values apart inside it, in atom and group alike.
    extra = [c for c in by if members and c not in members.group]
    celled = rows.where(F.col("_v").isNotNull()).withColumn("_cell", value_cell(F.col("_v")))
    counts = celled.groupBy(*atom, *extra, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    if members:
        counts = meet(counts, members.table, atom).groupBy(*by, "_cell").agg(F.sum("_n").alias("_n"))
    in_order = Window.partitionBy(*by).orderBy("_cell")
    rank, before = F.col("_want.rank"), F.col("_upto") - F.col("_n")
    wanted = Dim(written(
        counts.withColumn("_upto", F.sum("_n").over(in_order))
        .withColumn("total", F.sum("_n").over(Window.partitionBy(*by)))
        .withColumn("_want", F.explode(ranks(F.col("total"))))
        .where((rank >= before) & (rank < F.col("_upto")))
        .select(*by, "_cell", F.col("_want.slot").alias("slot"), rank.alias("rank"), "total", before.alias("_before"))
    ))
    side = Dim(meet(wanted.df, members.table, members.group)) if members else wanted
    want = [*by, "slot", "rank", "total", "_before"]
    here = meet(celled, side.small(), [*atom, *extra, "_cell"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "slot").orderBy("_v"))
    return (
        here.groupBy(*want, "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_to", upto)
        .where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("_n")))
        .select(*by, "slot", "rank", "total", F.col("_v").alias("value"))
    )


def values_at_ranks(
    df: DataFrame, by: list[str], value: Column, ranks: Callable[[Column], Column]
) -> DataFrame:
    """The values at chosen zero-based ranks of each group: by + (slot, rank, total, value).

    `ranks` maps the column holding the group's size to array<struct<slot, rank>>. NULL values do
    not count, and NULL keys are a group like any other.
    """
    return _ranked(written(df.select(*by, value.alias("_v"))), by, ranks, None)


def percentiles(
    df: DataFrame, by: list[str], points: dict[str, tuple[Column, float]], members: Members | None = None
) -> DataFrame:
    """Exact percentiles {name: (value, q)} of each group that has a value; `df` should be cheap to
    read. With `members`, `df` has their atoms, and `by` is their group."""
    values: dict[str, int] = {}
    columns = []
    for c, _ in points.values():
        if str(c) not in values:
            values[str(c)] = len(columns)
            columns.append(F.struct(F.lit(len(columns)).alias("_i"), c.cast("double").alias("_x")))
    atom = members.atom if members else by
    stacked = df.select(*atom, F.explode(F.array(*columns)).alias("_e")).select(*atom, "_e._i", F.col("_e._x").alias("_v"))
    asked = sorted({q for _, q in points.values()})

    def ranks(total: Column) -> Column:
        ends = [f(F.lit(q) * (total - 1)).cast("long") for q in asked for f in (F.floor, F.ceil)]
        both = F.array_distinct(F.array(*ends))
        return F.transform(both, lambda r: F.struct(r.alias("slot"), r.alias("rank")))

    found = _ranked(stacked, [*by, "_i"], ranks, members)
    results = []
    for name, (c, q) in points.items():
        mine = F.col("_i") == values[str(c)]
        at = F.lit(q) * (F.max(F.when(mine, F.col("total"))) - 1)
        point = F.lit(q) * (F.col("total") - 1)
        lo, hi = (F.max(F.when(mine & (F.col("rank") == f(point)), F.col("value"))) for f in (F.floor, F.ceil))
        # weighed as the built-in percentile weighs, so that both give the same double
        between = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        results.append(F.when((F.floor(at) == F.ceil(at)) | (lo == hi), lo).otherwise(between).alias(name))
    return found.groupBy(*by).agg(*results)


def aggregate(
    df: DataFrame, by: list[str], aggs: list[Column], points: dict[str, tuple[Column, float]]
) -> DataFrame:
    """groupBy with ordinary aggregates and exact percentiles {name: (value, q)}.

    `df` is computed once and stored, so it should have no other columns than these need.
    """
    return aggregate_stored(written(df), by, aggs, points)


def aggregate_stored(
    kept: DataFrame, by: list[str], aggs: list[Column], points: dict[str, tuple[Column, float]]
) -> DataFrame:
    """`aggregate` of rows that are stored already."""
    out = kept.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    return meet(out, percentiles(kept, by, points), by, "left").drop("_rows")
