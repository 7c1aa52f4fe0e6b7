"""Small tables for tests."""

import datetime as dt

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from marketval import schemas
from marketval.sources import config

S, D, L = StringType(), DoubleType(), LongType()
COMMON = dict(
    market=S, profile=S, row_ord=L, address=S, lot_sqft=D, living_sqft=D, beds=D, baths=D,
    year_built=IntegerType(), condition=S, brokerage=S, agent=S, area=S, lat=D, lon=D,
    lot_size_is_rounded=BooleanType(), sources=ArrayType(S), notes=ArrayType(S),
)
SOLD = StructType([StructField(n, t) for n, t in {
    **COMMON, "sold_date": DateType(), "sold_price": D, "final_list_price": D, "original_list_price": D,
    "buyer_agent": S}.items()])
ACTIVE = StructType([StructField(n, t) for n, t in {
    **COMMON, "list_price": D, "listed_date": DateType()}.items()])
FLOATS = {n for n, t in {**COMMON, "sold_price": D, "final_list_price": D, "original_list_price": D,
                         "list_price": D}.items() if t is D}


def _rows(schema, rows):
    out = []
    for i, r in enumerate(rows):
        full = {"market": "m", "profile": "lots", "row_ord": i, "lot_size_is_rounded": False,
                "sources": [], "notes": [], "address": f"{i} Elm St", **r}
        out.append(tuple(
            float(full[f.name]) if f.name in FLOATS and full.get(f.name) is not None else full.get(f.name)
            for f in schema.fields))
    return out


def sold(spark, rows):
    return spark.createDataFrame(_rows(SOLD, rows), SOLD)


def active(spark, rows):
    return spark.createDataFrame(_rows(ACTIVE, rows), ACTIVE)


def profiles(spark, *rows):
    rows = rows or (config.vacant_land("lots", "m"),)
    return spark.createDataFrame(list(rows), schemas.PROFILE)


def subjects(spark, *rows):
    full = [dict(market="m", profile="lots", subject_id=i, lot_sqft=None, living_sqft=None, beds=None,
                 baths=None, year_built=None, label="Your lot") | r for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.SUBJECT)


def geometry(spark, points=((-100.1, 40.02), (-100.0, 40.01), (-99.9, 40.02)), ew=-100.0):
    line = [dict(name=f"w{i}", lon=x, lat=y) for i, (x, y) in enumerate(points)]
    row = dict(market="m", ns_centerline=line, ew_longitude=ew, ns_divider_name="Main", ew_divider_name="Centre")
    return spark.createDataFrame([row], schemas.GEOMETRY)


def day(text):
    return dt.date.fromisoformat(text)
