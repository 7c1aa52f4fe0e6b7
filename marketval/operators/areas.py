"""Quadrants from coordinates, and the area table."""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.constants import BORDERLINE_DEGREES, EAST, QUADRANTS, WEST
from marketval.operators.quantiles import Members, meet, percentiles
from marketval.operators.sizing import DATASET, Dim, as_dim, written


def divider_legs(waypoints: Column) -> Column:
    """The divider as legs (lo, hi, lat_lo, lat_hi, flat), the held ends first.

    Worked out once per market, so that a row only has to find its leg.
    """
    inf = float("inf")
    ordered = F.array_sort(
        waypoints,
        lambda x, y: F.when(x["lon"] < y["lon"], -1).when(x["lon"] > y["lon"], 1).otherwise(0),
    )

    def leg(lo, hi, lat_lo, lat_hi, flat) -> Column:
        return F.struct(
            lo.alias("lo"), hi.alias("hi"), lat_lo.alias("lat_lo"), lat_hi.alias("lat_hi"),
            flat.alias("flat"),
        )

    def legs(points: Column) -> Column:
        first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
        ends = F.array(
            leg(F.lit(-inf), first["lon"], first["lat"], first["lat"], F.lit(True)),
            leg(last["lon"], F.lit(inf), last["lat"], last["lat"], F.lit(True)),
        )
        single = F.array(leg(F.lit(-inf), F.lit(inf), first["lat"], first["lat"], F.lit(True)))
        between = F.zip_with(
            F.slice(points, 1, F.size(points) - 1),
            F.slice(points, 2, F.size(points)),
            lambda a, b: leg(a["lon"], b["lon"], a["lat"], b["lat"], a["lon"] == b["lon"]),
        )
        return F.when(F.size(points) == 1, single).otherwise(F.concat(ends, between))

    return F.when(F.size(waypoints) > 0, F.transform(F.array(ordered), legs)[0])


def divider_lat(legs: Column, lon: Column) -> Column:
    """Latitude of the divider at a longitude."""
    leg = F.try_element_at(F.filter(legs, lambda s: (s["lo"] <= lon) & (lon <= s["hi"])), F.lit(1))
    return F.transform(
        F.array(leg),
        lambda g: F.when(g["flat"], g["lat_lo"]).otherwise(
            g["lat_lo"] + (g["lat_hi"] - g["lat_lo"]) * ((lon - g["lo"]) / (g["hi"] - g["lo"]))
        ),
    )[0]


def classify(rows: DataFrame, geometry: Dim | DataFrame) -> DataFrame:
    """Adds divider_lat, computed_area and borderline from each row's own coordinates."""
    dim = as_dim(geometry)
    side = dim.small(
        dim.df.select(
            "market", divider_legs(F.col("ns_centerline")).alias("_legs"),
            F.col("ew_longitude").alias("_ew"),
        )
    )
    configured = F.col("_legs").isNotNull() & F.col("_ew").isNotNull()
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull() & configured
    ns = F.when(F.col("lat") >= F.col("divider_lat"), "N").otherwise("S")
    ew = F.when(F.col("lon") >= F.col("_ew"), "E").otherwise("W")
    near = (F.abs(F.col("lat") - F.col("divider_lat")) < BORDERLINE_DEGREES) | (
        F.abs(F.col("lon") - F.col("_ew")) < BORDERLINE_DEGREES
    )
    return (
        rows.join(side, "market", "left")
        .withColumn("divider_lat", F.when(placed, divider_lat(F.col("_legs"), F.col("lon"))))
        .withColumn("computed_area", F.when(F.col("divider_lat").isNotNull(), F.concat(ns, ew)))
        .withColumn("borderline", F.coalesce(F.col("divider_lat").isNotNull() & near, F.lit(False)))
        .drop("_legs", "_ew")
    )


BORDERLINE_NOTE = (
    "Borderline: on or beside a divider street; assigned by geocoded side "
    "(ties resolve north and east)"
)


def classify_all(rows: DataFrame, geometry: Dim | DataFrame) -> DataFrame:
    """Rows with `area` set from coordinates where possible; a supplied area is kept otherwise."""
    return (
        classify(rows, geometry)
        .withColumn("area", F.coalesce("computed_area", "area"))
        .withColumn(
            "notes",
            F.when(F.col("borderline"), F.array_append("notes", F.lit(BORDERLINE_NOTE))).otherwise(
                F.col("notes")
            ),
        )
        .drop("divider_lat", "computed_area")
    )


def _labels(area: Column) -> Column:
    side = F.when(F.substring(area, 2, 1) == "E", EAST).otherwise(WEST)
    return F.array(area, side)


def area_table(
    sold: DataFrame, active: DataFrame, profiles: Dim | DataFrame
) -> DataFrame:
    """Six rows per dataset, four quadrants and two sides, empty ones included.

    Inputs carry measures and `area`.
    """
    dim = as_dim(profiles)
    by, atom = [*DATASET, "label"], [*DATASET, "area"]
    # Sales are counted by quadrant, once; a label is the sum of its quadrants.
    rows = written(
        sold.where(F.col("area").isNotNull()).select(*atom, "ppsf", "metric_size", "sold_price")
    )
    tallies = rows.groupBy(*atom).agg(
        F.count(F.lit(1)).alias("n"), F.count("ppsf").alias("rated"), F.sum("ppsf").alias("rates"),
        F.count("metric_size").alias("sized"), F.sum("metric_size").alias("sizes"),
    )
    labelled = written(tallies.withColumn("label", F.explode(_labels(F.col("area")))))
    middles = percentiles(
        rows, by,
        {"sold_median_ppsf": (F.col("ppsf"), 0.5), "sold_median_price": (F.col("sold_price"), 0.5)},
        Members(labelled.select(*DATASET, "area", "label"), atom, by),
    )
    sums = labelled.groupBy(*by).agg(
        F.sum("n").alias("sold_count"),
        F.try_divide(F.sum("rates"), F.sum("rated")).alias("sold_avg_ppsf"),
        F.try_divide(F.sum("sizes"), F.sum("sized")).alias("sold_avg_size"),
    )
    sides = meet(sums, middles, by, "left")
    asks = (
        active.where(F.col("area").isNotNull())
        .withColumn("label", F.explode(_labels(F.col("area"))))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("active_count"), F.avg("ppsf").alias("active_avg_ppsf"))
    )
    labels = [*QUADRANTS, EAST, WEST]
    skeleton = dim.df.select(
        *DATASET, F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("position", "label")
    )
    return (
        skeleton.join(sides, by, "left")
        .join(asks, by, "left")
        .select(
            *DATASET, "position", F.col("label").alias("area"),
            F.coalesce("sold_count", F.lit(0)).alias("sold_count"),
            "sold_avg_ppsf", "sold_median_ppsf", "sold_median_price", "sold_avg_size",
            F.coalesce("active_count", F.lit(0)).alias("active_count"),
            "active_avg_ppsf",
        )
    )


def unclassified(sold: DataFrame, active: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """Rows without an area, counted per dataset and side."""
    none = F.count_if(F.col("area").isNull())
    base = as_dim(profiles).df.select(*DATASET)
    return (
        base.join(sold.groupBy(*DATASET).agg(none.alias("s")), DATASET, "left")
        .join(active.groupBy(*DATASET).agg(none.alias("a")), DATASET, "left")
        .select(
            *DATASET,
            F.coalesce("s", F.lit(0)).alias("unclassified_sold"),
            F.coalesce("a", F.lit(0)).alias("unclassified_active"),
        )
    )
