"""Table schemas. Every table carries `market` and an explicit input order `row_ord`."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


S, D, I, L, B = StringType(), DoubleType(), IntegerType(), LongType(), BooleanType()

# As recorded in JSON: dates are text, flags and lists may be absent.
_RECORDED = dict(
    address=S, lot_sqft=D, living_sqft=D, beds=D, baths=D, year_built=I, condition=S,
    brokerage=S, agent=S, area=S, lat=D, lon=D, lot_size_is_rounded=B,
    sources=ArrayType(S), notes=ArrayType(S),
)
RECORDED_SOLD = _struct(
    **_RECORDED, sold_date=S, sold_price=D, final_list_price=D, original_list_price=D, buyer_agent=S
)
RECORDED_ACTIVE = _struct(**_RECORDED, list_price=D, listed_date=S)

IDENTIFICATION = _struct(
    requires_absent_bed_bath=B, type_labels=ArrayType(S), exclude_habitable_structure=B,
    unit_suffix_is_significant=B,
)
SIMILAR_BRACKET = _struct(
    attribute=S, tolerance=D, explicit_low=D, explicit_high=D, match_bed_count=B
)
EXCLUSIONS = _struct(
    max_lot_sqft=D, min_lot_sqft=D, explicit_address_keys=ArrayType(S),
    core_min_ppsf=D, core_max_ppsf=D,
)
PROFILE = _struct(
    market=S, profile=S, property_type=S, metric=S, window_days=I, attributes=ArrayType(S),
    identification=IDENTIFICATION, similar_bracket=SIMILAR_BRACKET, exclusions=EXCLUSIONS,
)
SUBJECT = _struct(
    market=S, profile=S, subject_id=L, lot_sqft=D, living_sqft=D, beds=D, baths=D,
    year_built=I, label=S,
)
WAYPOINT = _struct(name=S, lon=D, lat=D)
GEOMETRY = _struct(
    market=S, ns_centerline=ArrayType(WAYPOINT), ew_longitude=D, ns_divider_name=S, ew_divider_name=S
)
SOURCE = _struct(
    market=S, source=S, adapter=S, role=S, url=S, quirks=ArrayType(S), rate_limit_seconds=D,
    enabled=B, side=S, config=MapType(S, S),
)
PAGE = _struct(
    url=S, adapter_version=S, status=I, html=S, fetched_at=TimestampType(),
)
CLAIM = _struct(
    market=S, profile=S, claim_ord=L, address=S, field_name=S, value=S, source_url=S,
    claimed_price=D, claimed_date=DateType(),
)
FACTS = _struct(
    market=S, profile=S, row_ord=L, address=S, url=S, listing_agent=S, listing_brokerage=S,
    buyer_agent=S, buyer_brokerage=S, dual_agency_stated=B, stated_sold_price=D,
    stated_sold_date=S, final_list_price=D, original_list_price=D, lot_sqft=D, living_sqft=D,
    page_is_about_a_different_property=B, notes=S,
)
GEOCODE = _struct(query=S, service=S, lat=D, lon=D, matched_address=S, score=D)
