"""Windows, exclusion, reconciliation and lookup selection."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketval.functions import rates
from marketval.functions.text import grouped
from marketval.operators.dedup import resolve_sales
from marketval.operators.measures import with_profile
from marketval.operators.quantiles import values_at_ranks
from marketval.operators.sizing import DATASET, Dim, as_dim



def window_bounds(end: Column, window_days: Column) -> Column:
    """struct(start, end) of the look-back window, both ends included."""
    return F.struct(F.date_sub(end, window_days).alias("start"), end.alias("end"))


def in_window(sold: DataFrame, profiles: Dim | DataFrame, end: Column) -> DataFrame:
    """Sold rows inside the profile's window; a sale without a date stays."""
    bounds = window_bounds(end, F.col("window_days"))
    fields = {"_start": bounds["start"], "_end": bounds["end"]}
    day = F.col("sold_date")
    return (
        with_profile(sold, profiles, fields)
        .where(day.isNull() | day.between(F.col("_start"), F.col("_end")))
        .drop("_start", "_end")
    )


def matches_type(identification: Column, has_beds: Column, label: Column) -> Column:
    """A type label found in the row's own label decides; otherwise the bed/bath rule does."""
    low = F.lower(F.coalesce(label, F.lit("")))
    labelled = (low != "") & F.exists(
        identification["type_labels"], lambda t: F.contains(low, F.lower(t))
    )
    by_beds = F.when(identification["requires_absent_bed_bath"], ~has_beds).otherwise(has_beds)
    return F.coalesce(labelled, F.lit(False)) | by_beds


def of_profile_type(rows: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """Rows that are the kind of property their profile compares."""
    rule = matches_type(F.col("_id"), F.col("beds").isNotNull(), F.col("property_type"))
    return with_profile(rows, profiles, {"_id": F.col("identification")}).where(rule).drop("_id")


def exclusion_reason(lot: Column, low: Column, high: Column, listed: Column) -> Column:
    """Why a parcel leaves the dataset, or NULL. A parcel of unknown size never leaves."""
    above = F.concat(
        F.lit("lot "), grouped(lot), F.lit(" sqft exceeds the "), grouped(high), F.lit(" sqft cap")
    )
    below = F.concat(
        F.lit("lot "), grouped(lot), F.lit(" sqft is below the "), grouped(low), F.lit(" sqft floor")
    )
    return (
        F.when(listed, "on the market's explicit exclusion list")
        .when(lot > high, above)
        .when(lot < low, below)
    )


def with_reason(rows: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """Adds `reason` (NULL when the row stays) and `missing_metric`.

    The explicit keys of a profile are exploded and joined, so a long list stays a join.
    """
    dim = as_dim(profiles)
    listed = dim.df.select(
        *DATASET, F.explode("exclusions.explicit_address_keys").alias("addr_key")
    ).distinct().withColumn("_listed", F.lit(True))
    fields = {
        "_low": F.col("exclusions.min_lot_sqft"), "_high": F.col("exclusions.max_lot_sqft"),
        "_metric": F.col("metric"),
    }
    size = rates.metric_size(F.col("_metric"), F.col("lot_sqft"), F.col("living_sqft"))
    return (
        with_profile(rows, dim, fields)
        .join(listed, [*DATASET, "addr_key"], "left")
        .withColumn(
            "reason",
            exclusion_reason(
                F.col("lot_sqft"), F.col("_low"), F.col("_high"),
                F.coalesce(F.col("_listed"), F.lit(False)),
            ),
        )
        .withColumn("missing_metric", F.col("reason").isNull() & size.isNull())
        .drop("_low", "_high", "_metric", "_listed")
    )


def reconcile(active: DataFrame, sold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(still active, closed): a listing whose key is among all sold keys has closed."""
    keys = sold.select(*DATASET, "addr_key").distinct()
    on = [*DATASET, "addr_key"]
    return active.join(keys, on, "left_anti"), active.join(keys, on, "left_semi")


@dataclass
class Cleaned:
    sold: DataFrame
    active: DataFrame
    excluded: DataFrame
    reconciled: DataFrame
    duplicates: DataFrame
    missing_metric: DataFrame
    shared_addresses: DataFrame


def shared_addresses(resolved: DataFrame, key: str = "addr_key") -> DataFrame:
    """Addresses under which more than one distinct sale was kept."""
    kept = resolved.where("is_kept")
    return (
        kept.groupBy(*DATASET, key)
        .agg(
            F.count(F.lit(1)).alias("n_sales"),
            F.min_by("address", "slot_ord").alias("address"),
        )
        .where("n_sales > 1")
        .withColumn(
            "note",
            F.concat("address", F.lit(": "), F.col("n_sales").cast("string"),
                     F.lit(" distinct sales share this address")),
        )
    )


def clean(sold: DataFrame, active: DataFrame, profiles: Dim | DataFrame) -> Cleaned:
    """Merge, exclude, reconcile, in that order. Inputs carry the columns of `with_keys`."""
    dim = as_dim(profiles)
    resolved = resolve_sales(sold)
    judged_sold = with_reason(resolved.where("is_kept").drop("is_kept", "is_duplicate"), dim)
    open_, closed = reconcile(active, sold)
    judged_active = with_reason(open_, dim)
    log = [*DATASET, "row_ord", "address"]
    excluded = (
        judged_sold.where(F.col("reason").isNotNull())
        .select(F.lit("sold").alias("side"), *log, "reason")
        .unionByName(
            judged_active.where(F.col("reason").isNotNull()).select(
                F.lit("active").alias("side"), *log, "reason"
            )
        )
    )
    missing = (
        judged_sold.where("missing_metric").select(F.lit("sold").alias("side"), *log)
        .unionByName(
            judged_active.where("missing_metric").select(F.lit("active").alias("side"), *log)
        )
    )
    return Cleaned(
        sold=judged_sold.where(F.col("reason").isNull()).drop("reason"),
        active=judged_active.where(F.col("reason").isNull()).drop("reason"),
        excluded=excluded,
        reconciled=closed.select(*log),
        duplicates=resolved.where("is_duplicate").select(*log, "slot_ord"),
        missing_metric=missing,
        shared_addresses=shared_addresses(resolved),
    )


def needs_lookup(sold: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """Sold rows that have somewhere to look and something to look for."""
    size = rates.metric_size(F.col("_metric"), F.col("lot_sqft"), F.col("living_sqft"))
    gap = (
        F.col("agent").isNull() | F.col("brokerage").isNull()
        | F.col("final_list_price").isNull() | size.isNull()
    )
    return (
        with_profile(sold, profiles, {"_metric": F.col("metric")})
        .where((F.size("sources") > 0) & gap)
        .drop("_metric")
    )


def lookup_targets(targets: DataFrame, limit: int) -> DataFrame:
    """The first `limit` targets of each dataset: the ceiling a run was given."""
    # The last allowed row_ord is selected by rank, so no dataset is sorted in one task.
    last = values_at_ranks(
        targets, DATASET, F.col("row_ord"),
        lambda n: F.array(
            F.struct(F.lit("last").alias("slot"), (F.least(n, F.lit(limit)) - 1).alias("rank"))
        ),
    )
    return targets.join(last.select(*DATASET, F.col("value").alias("_last")), DATASET).where(
        F.col("row_ord") <= F.col("_last")
    ).drop("_last")


def lookups_skipped(targets: DataFrame, limit: int) -> DataFrame:
    """How many targets the ceiling left out, per dataset."""
    return (
        targets.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("n"))
        .select(*DATASET, F.greatest(F.col("n") - limit, F.lit(0)).alias("skipped"))
    )


def fill_original_price(sold: DataFrame) -> DataFrame:
    """A listing that was never reduced has one price, kept in both columns."""
    return sold.withColumn(
        "original_list_price",
        F.coalesce("original_list_price", rates.nonzero(F.col("final_list_price"))),
    )


def repeat_sales(sold: DataFrame, key: str = "addr_key_bare") -> DataFrame:
    """Rows that differ in price or date from the first row under their bare address."""
    first = (
        sold.groupBy(*DATASET, key)
        .agg(
            F.min_by(F.struct("sold_price", "sold_date"), F.col("row_ord")).alias("_first"),
            F.min("row_ord").alias("_first_ord"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where("_n > 1")
    )
    same = rates.prices_match(F.col("_first.sold_price"), F.col("sold_price")) & rates.dates_match(
        F.col("_first.sold_date"), F.col("sold_date")
    )
    return (
        sold.join(first, [*DATASET, key])
        .where((F.col("row_ord") > F.col("_first_ord")) & ~same)
        .select(
            *DATASET, "row_ord", "address",
            F.col("_first.sold_date").alias("first_date"),
            F.col("_first.sold_price").alias("first_price"),
            "sold_date", "sold_price",
        )
    )

