"""Ranks inside groups of any size, without sorting a whole group in one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketval.operators.sizing import cut_lineage


def rank_in_group(
    df: DataFrame, by: list[str], order: list[Column], name: str
) -> DataFrame:
    """1-based position in `order` within `by`. The order must leave no ties.

    All groups are cut into ranges of the order. Rows are numbered inside a range, and the
    sizes of the ranges before it, a table of one row per range and group, give the offset.
    """
    cols = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, cols)])
    # Stored, so that a row's range cannot change between the two readings below.
    ranged = cut_lineage(
        keyed.repartitionByRange(*[F.col(b) for b in by], *cols)
        .withColumn("_range", F.spark_partition_id())
    )
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range"))
    offsets = sizes.select(
        *[F.col(b).alias(f"_k_{b}") for b in by], F.col("_range").alias("_k_range"),
        (upto - F.col("_n")).alias("_before"),
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*cols))
    match = [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by]
    return (
        ranged.withColumn("_pos", inside)
        .join(offsets, [*match, F.col("_range") == F.col("_k_range")])
        .withColumn(name, (F.col("_before") + F.col("_pos")).cast("long"))
        .select(*df.columns, name)
    )


def first_per_group(df: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each group; Spark limits each input partition to n before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n)


def last_per_key(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key: a map-side combined maximum, not a window."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest])
