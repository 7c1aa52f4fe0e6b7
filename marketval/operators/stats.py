"""Side statistics, sold-to-ask, attribution and the caveats that travel with them.

Inputs carry the columns of `sold_measures` / `active_measures`.
"""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.operators.quantiles import aggregate
from marketval.operators.sizing import DATASET


def _side(rows: DataFrame, price: str, by: list[str]) -> DataFrame:
    core = F.when(F.col("core"), F.col("ppsf"))
    out = aggregate(
        rows.select(*by, "ppsf", price, "metric_size", "core"),
        by,
        [
            F.count(F.lit(1)).alias("count"),
            F.avg("ppsf").alias("avg_ppsf"),
            F.avg(price).alias("avg_price"),
            F.avg("metric_size").alias("avg_size"),
            F.min("ppsf").alias("min_ppsf"),
            F.max("ppsf").alias("max_ppsf"),
            F.count(core).alias("core_count"),
            F.avg(core).alias("core_avg_ppsf"),
            F.count_if(F.col("ppsf").isNull()).alias("missing_metric_count"),
        ],
        {
            "median_ppsf": (F.col("ppsf"), 0.5),
            "median_price": (F.col(price), 0.5),
            "core_median_ppsf": (core, 0.5),
        },
    )
    return out.select(
        *by, "count", "avg_ppsf", "median_ppsf", "avg_price", "median_price", "avg_size",
        "min_ppsf", "max_ppsf", "core_count", "core_avg_ppsf", "core_median_ppsf",
        "missing_metric_count",
    )


def sold_stats(sold: DataFrame, by: list[str] = DATASET) -> DataFrame:
    return _side(sold, "sold_price", by)


def active_stats(active: DataFrame, by: list[str] = DATASET) -> DataFrame:
    return _side(active, "list_price", by)


def sold_to_ask(sold: DataFrame, by: list[str] = DATASET) -> DataFrame:
    """The distribution of sold over final list; reductions are counted over every sale."""
    r = F.col("ratio")
    out = aggregate(
        sold.select(*by, "ratio", "reduced"),
        by,
        [
            F.count(r).alias("count"),
            F.avg(r).alias("mean_ratio"),
            F.count_if(r >= 1.0).alias("at_or_above_ask"),
            F.count_if(r >= 1.05).alias("at_or_above_105"),
            F.count_if(r < 0.90).alias("below_90"),
            F.max(r).alias("max_ratio"),
            F.min(r).alias("min_ratio"),
            F.count_if(F.col("reduced")).alias("reduced_count"),
        ],
        {"median_ratio": (r, 0.5)},
    )
    return out.withColumn(
        "share_at_or_above_ask", F.try_divide(F.col("at_or_above_ask"), F.col("count"))
    )


def is_attributed() -> Column:
    return (F.coalesce("brokerage", F.lit("")) != "") | (F.coalesce("agent", F.lit("")) != "")


def attribution_coverage(sold: DataFrame, by: list[str] = DATASET) -> DataFrame:
    return sold.groupBy(*by).agg(
        F.count_if(is_attributed()).alias("attributed"), F.count(F.lit(1)).alias("total")
    )


def caveats(sold: DataFrame, stats: DataFrame, by: list[str] = DATASET) -> DataFrame:
    """Rows (by, code, n): statements that must travel with the numbers."""
    rounded = sold.groupBy(*by).agg(F.count_if(F.col("lot_size_is_rounded")).alias("_rounded"))
    items = F.array(
        F.when(
            F.col("_rounded") > 0,
            F.struct(F.lit("rounded_acreage").alias("code"), F.col("_rounded").alias("n")),
        ),
        F.when(
            F.col("missing_metric_count") > 0,
            F.struct(F.lit("no_usable_size").alias("code"), F.col("missing_metric_count").alias("n")),
        ),
        F.when(
            (F.col("avg_ppsf") != 0) & (F.col("median_ppsf") > F.col("avg_ppsf")),
            F.struct(F.lit("median_above_mean").alias("code"), F.lit(1).cast("long").alias("n")),
        ),
    )
    return (
        stats.join(rounded, by)
        .select(*by, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("_i"))
        .select(*by, "_i.code", "_i.n")
    )
