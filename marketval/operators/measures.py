"""Rows joined to the profile they are read under, and the figures every table is built on."""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.functions import rates
from marketval.functions.address import canonical_street, street_words, unit_part
from marketval.operators.sizing import DATASET, Dim, as_dim


def with_profile(rows: DataFrame, profiles: Dim | DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Rows plus chosen columns of their (market, profile) settings."""
    dim = as_dim(profiles)
    side = dim.small(dim.df.select(*DATASET, *[c.alias(n) for n, c in fields.items()]))
    return rows.join(side, DATASET)


def with_keys(rows: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """Adds addr_key (under the profile's unit rule), addr_key_unit and addr_key_bare."""
    keep = F.coalesce(F.col("identification.unit_suffix_is_significant"), F.lit(False))
    # Plain columns: each is used several times, so Catalyst computes it once per row.
    return (
        with_profile(rows, profiles, {"_keep": keep})
        .withColumn("_words", street_words(F.col("address")))
        .withColumn("_unit", unit_part(F.col("address")))
        .withColumn("_street", canonical_street(F.col("_words")))
        .withColumn("_whole", F.concat_ws(" ", F.nullif(F.col("_street"), F.lit("")), F.nullif(F.col("_unit"), F.lit(""))))
        .withColumn("addr_key", F.when(F.col("_keep"), F.col("_whole")).otherwise(F.col("_street")))
        .withColumn("addr_key_unit", F.col("_whole"))
        .withColumn("addr_key_bare", F.col("_street"))
        .drop("_words", "_unit", "_street", "_whole", "_keep")
    )


def _core(rate: Column) -> Column:
    return rates.in_core(rate, F.col("_core_min"), F.col("_core_max"))


def _with_size(rows: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    fields = {
        "_metric": F.col("metric"),
        "_core_min": F.col("exclusions.core_min_ppsf"),
        "_core_max": F.col("exclusions.core_max_ppsf"),
    }
    return with_profile(rows, profiles, fields).withColumn(
        "metric_size", rates.metric_size(F.col("_metric"), F.col("lot_sqft"), F.col("living_sqft"))
    )


def sold_measures(sold: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """Adds metric_size, ppsf, ratio, reduced and core to sold rows."""
    return (
        _with_size(sold, profiles)
        .withColumn("ppsf", rates.per_sqft(F.col("sold_price"), F.col("metric_size")))
        .withColumn("ratio", rates.sold_to_ask(F.col("sold_price"), F.col("final_list_price")))
        .withColumn(
            "reduced", rates.was_reduced(F.col("original_list_price"), F.col("final_list_price"))
        )
        .withColumn("core", _core(F.col("ppsf")))
        .drop("_metric", "_core_min", "_core_max")
    )


def active_measures(active: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """Adds metric_size, ppsf and core to active rows."""
    return (
        _with_size(active, profiles)
        .withColumn("ppsf", rates.per_sqft(F.col("list_price"), F.col("metric_size")))
        .withColumn("core", _core(F.col("ppsf")))
        .drop("_metric", "_core_min", "_core_max")
    )
