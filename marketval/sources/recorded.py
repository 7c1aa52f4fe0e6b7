"""Recorded sold and active rows: JSON arrays of objects, from files or from a text column."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from marketval.functions.parse import iso_date
from marketval.operators.quality import valid_area
from marketval.operators.ranking import rank_in_group
from marketval.operators.sizing import DATASET
from marketval.schemas import RECORDED_ACTIVE, RECORDED_SOLD

DATES = {"sold_date", "listed_date"}


def coerce(rows: DataFrame, schema: StructType) -> DataFrame:
    """Recorded types to table types: dates parsed, absent flags and lists given their default."""
    none = F.array().cast("array<string>")
    special = {
        "lot_size_is_rounded": F.coalesce("lot_size_is_rounded", F.lit(False)),
        "sources": F.coalesce("sources", none),
        "notes": F.coalesce("notes", none),
        "area": valid_area(F.col("area")),
        **{d: iso_date(F.col(d)) for d in DATES},
    }
    known = {f.name for f in schema.fields}
    return rows.select(
        *[c for c in rows.columns if c not in known],
        *[special.get(f.name, F.col(f.name)).alias(f.name) for f in schema.fields],
    )


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    # A multi-line file is one split and is read in order, so the generated id keeps its order.
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return coerce(rows.withColumn("row_ord", F.monotonically_increasing_id()), schema)


def read_sold(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RECORDED_SOLD)


def read_active(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RECORDED_ACTIVE)


def parse_recorded(texts: DataFrame, text: Column, schema: StructType, keep: list[str]) -> DataFrame:
    """One row per object of a JSON array held in a text column: keep + position + fields."""
    rows = texts.select(*keep, F.posexplode(F.from_json(text, ArrayType(schema))).alias("position", "_r"))
    return coerce(rows.select(*keep, "position", "_r.*"), schema)


class RecordingMissing(FileNotFoundError):
    """A market has no recorded sold rows for a profile."""


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_recording(
    spark: SparkSession, folder: str, market: str, profile: str
) -> tuple[DataFrame, DataFrame]:
    """(sold, active) of one dataset: the profile's own files if there are any, else the shared
    ones. A missing active file is an empty table; a missing sold file is an error."""
    sold, active = f"{folder}/{profile}.sold.json", f"{folder}/{profile}.active.json"
    if not _exists(spark, sold):
        sold, active = f"{folder}/sold.json", f"{folder}/active.json"
    if not _exists(spark, sold):
        raise RecordingMissing(f"no recorded sales for profile {profile!r} in {folder}")
    tag = {"market": F.lit(market), "profile": F.lit(profile)}
    listed = (
        read_active(spark, active)
        if _exists(spark, active)
        else coerce(
            spark.createDataFrame([], RECORDED_ACTIVE).withColumn("row_ord", F.lit(0).cast("long")),
            RECORDED_ACTIVE,
        )
    )
    return read_sold(spark, sold).withColumns(tag), listed.withColumns(tag)


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """Sources stacked in declared order. Rows are numbered anew, from 0 and without gaps in each
    dataset, by source and then by their order in it, so that later joins by row_ord stay one to one."""
    out = None
    for rank, part in enumerate(parts):
        one = part.withColumn("source_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    placed = rank_in_group(out, DATASET, [F.col("source_rank"), F.col("row_ord")], "_place")
    return placed.withColumn("row_ord", F.col("_place") - 1).drop("_place")
