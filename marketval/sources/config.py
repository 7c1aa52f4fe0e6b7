"""Configuration as tables: profiles, subjects, geometry and sources, with their defaults."""

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from marketval import schemas

# Defaults of a source declaration, and the two built-in profiles below.
DEFAULT_RATE_LIMIT_SECONDS = 2.0


def vacant_land(profile: str = "empty-lots", market: str | None = None, **changes) -> dict[str, Any]:
    """The built-in land profile."""
    row = dict(
        market=market, profile=profile, property_type="vacant_land", metric="lot_sqft",
        window_days=90, attributes=[],
        identification=dict(
            requires_absent_bed_bath=True, type_labels=["LOT", "LAND"],
            exclude_habitable_structure=True, unit_suffix_is_significant=False,
        ),
        similar_bracket=dict(
            attribute="lot_sqft", tolerance=0.25, explicit_low=None, explicit_high=None,
            match_bed_count=False,
        ),
        exclusions=dict(
            max_lot_sqft=43560.0, min_lot_sqft=None, explicit_address_keys=[],
            core_min_ppsf=30.0, core_max_ppsf=150.0,
        ),
    )
    return _changed(row, changes)


def improved(
    profile: str, property_type: str = "single_family", market: str | None = None, **changes
) -> dict[str, Any]:
    """The built-in starting point for houses: living area, no caps, no core bounds."""
    row = dict(
        market=market, profile=profile, property_type=property_type, metric="living_sqft",
        window_days=90, attributes=["beds", "baths", "year_built"],
        identification=dict(
            requires_absent_bed_bath=False, type_labels=["SINGLE_FAMILY", "HOUSE", "SFR"],
            exclude_habitable_structure=False, unit_suffix_is_significant=False,
        ),
        similar_bracket=dict(
            attribute="living_sqft", tolerance=0.25, explicit_low=None, explicit_high=None,
            match_bed_count=False,
        ),
        exclusions=dict(
            max_lot_sqft=None, min_lot_sqft=None, explicit_address_keys=[],
            core_min_ppsf=None, core_max_ppsf=None,
        ),
    )
    return _changed(row, changes)


def _changed(row: dict, changes: dict) -> dict:
    for name, value in changes.items():
        row[name] = {**row[name], **value} if isinstance(row.get(name), dict) else value
    return row


def profiles_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.PROFILE)


def builtin_profiles(markets: DataFrame) -> DataFrame:
    """The built-in profile offered to every market."""
    row = F.from_json(F.lit(json.dumps(vacant_land())), schemas.PROFILE)
    return (
        markets.select("market").distinct().withColumn("_p", row)
        .select("market", *[f"_p.{f.name}" for f in schemas.PROFILE if f.name != "market"])
    )


def resolve_profiles(yours: DataFrame, shipped: DataFrame, builtin: DataFrame) -> DataFrame:
    """One row per (market, profile): yours before the market's before the built-in; adds origin."""
    stacked = (
        yours.withColumn("_prio", F.lit(0)).withColumn("origin", F.lit("yours"))
        .unionByName(shipped.withColumn("_prio", F.lit(1)).withColumn("origin", F.lit("market")))
        .unionByName(builtin.withColumn("_prio", F.lit(2)).withColumn("origin", F.lit("built-in")))
    )
    order = Window.partitionBy("market", "profile").orderBy("_prio")
    return (
        stacked.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "_prio")
    )


def sources_table(declared: DataFrame) -> DataFrame:
    """Source declarations with their defaults; anything else a row holds stays in `config`."""
    return declared.select(
        "market", "source",
        F.coalesce("adapter", F.lit("")).alias("adapter"),
        F.coalesce("role", F.lit("")).alias("role"),
        "url",
        F.coalesce("quirks", F.array().cast("array<string>")).alias("quirks"),
        F.coalesce("rate_limit_seconds", F.lit(DEFAULT_RATE_LIMIT_SECONDS)).alias("rate_limit_seconds"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("side", F.lit("sold")).alias("side"),
        F.coalesce("config", F.create_map().cast("map<string,string>")).alias("config"),
    )


# Settings as read from a file: names and, as text or JSON text, values.
_SETTINGS = "map<string,string>"
_MARKET_FILE = "market map<string,string>, profiles map<string,string>, geometry string, sources array<map<string,string>>"


def _settings(text: Column) -> Column:
    return F.coalesce(F.from_json(text, _SETTINGS), F.create_map().cast(_SETTINGS))


def _overlaid(default: Column, given: Column) -> Column:
    """`given` over `default`; a setting given as null is null, not the default."""
    return F.map_concat(F.map_filter(default, lambda k, v: ~F.map_contains_key(given, k)), given)


def _typed(settings: Column, schema: StructType) -> Column:
    """The settings that a schema names, each in its type; others are left out."""
    def read(f):
        value = F.try_element_at(settings, F.lit(f.name))
        return F.from_json(value, f.dataType) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else value.cast(f.dataType)

    return F.struct(*[read(f).alias(f.name) for f in schema])


def _profile(market: Column, name: Column, given: Column) -> Column:
    """A profile's row: its settings, section by section, over the built-in ones."""
    base = vacant_land()
    top = _overlaid(_settings(F.lit(json.dumps(base))), given)
    cells = {"market": market, "profile": name}
    whole = _typed(top, schemas.PROFILE)
    for f in schemas.PROFILE:
        if isinstance(f.dataType, StructType):
            section = _settings(F.try_element_at(given, F.lit(f.name)))
            ends = F.from_json(F.try_element_at(section, F.lit("explicit_range")), "array<string>")
            ranged = F.create_map(F.lit("explicit_low"), F.get(ends, 0), F.lit("explicit_high"), F.get(ends, 1))
            section = F.when(ends.isNotNull(), _overlaid(section, ranged)).otherwise(section)
            cells[f.name] = _typed(_overlaid(_settings(F.lit(json.dumps(base[f.name]))), section), f.dataType)
    return F.struct(*[cells.get(f.name, whole[f.name]).alias(f.name) for f in schemas.PROFILE])


def market_tables(spark: SparkSession, raw: dict[str, Any]) -> dict[str, DataFrame]:
    """A parsed market file as dimension rows: market, profiles, subjects, geometry, sources.

    A source's further settings stay in its `config`, nested ones as JSON text.
    """
    if not (raw.get("market") or {}).get("name"):
        raise ValueError("[market] needs a name")
    text = spark.createDataFrame([(json.dumps(raw, default=str),)], "text string")
    file = text.select(F.from_json("text", _MARKET_FILE).alias("f")).select(F.col("f.market")["name"].alias("market"), "f.*")
    file = file.toDF("name", *file.columns[1:])
    name = F.col("name")

    def section(column: str, default: str) -> Column:
        return F.coalesce(F.col("market")[column], F.lit(default)).alias(column)

    each = file.select("name", F.posexplode(F.map_entries("profiles")).alias("at", "p")).select(
        "name", "at", "p.key", _settings(F.col("p.value")).alias("given"))
    each = each.withColumn("label", F.coalesce(F.try_element_at("given", F.lit("name")), "key"))
    subject = each.select(
        F.map_concat(
            F.map_filter(_settings(F.try_element_at("given", F.lit("subject"))), lambda k, v: ~k.isin("market", "profile", "subject_id")),
            F.create_map(F.lit("market"), name, F.lit("profile"), F.col("label"), F.lit("subject_id"), F.col("at").cast("string")),
        ).alias("s"))
    shape = F.from_json(F.coalesce("geometry", F.lit("{}")), schemas.GEOMETRY)
    points = F.coalesce(shape["ns_centerline"], F.array().cast(schemas.GEOMETRY["ns_centerline"].dataType))
    named = F.transform(points, lambda w: w.withField("name", F.coalesce(w["name"], F.lit(""))))
    own = [f.name for f in schemas.SOURCE if f.name not in ("market", "source", "config")] + ["name"]
    declared = file.select("name", F.explode("sources").alias("s"))
    listed = declared.select(name, F.col("s"), _typed(F.col("s"), schemas.SOURCE).alias("t"))
    return {
        "markets": file.select(
            name.alias("market"), section("description", ""), section("default_profile", ""),
            section("fixture_dir", "fixtures"), section("data_dir", "data")),
        "profiles": each.select(_profile(name, F.col("label"), F.col("given")).alias("p")).select("p.*"),
        "subjects": subject.select(_typed(F.col("s"), schemas.SUBJECT).alias("s")).select("s.*")
            .withColumn("label", F.coalesce("label", F.lit("Your property"))),
        "geometry": file.select(
            name.alias("market"), named.alias("ns_centerline"), shape["ew_longitude"].alias("ew_longitude"),
            *[F.coalesce(shape[d], F.lit("")).alias(d) for d in ("ns_divider_name", "ew_divider_name")]),
        "sources": sources_table(listed.select(
            name.alias("market"), F.coalesce(F.col("s")["name"], F.lit("")).alias("source"),
            *[F.col("t")[c].alias(c) for c in own if c != "name"],
            F.map_filter("s", lambda k, v: ~k.isin(*own)).alias("config"))),
    }
