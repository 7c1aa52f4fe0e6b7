"""The archive of runs: one partitioned Parquet table per result, keyed by market, profile, run.

A run is market, profile and a UTC stamp, and all three are partition columns, so listing and
reading a run never opens another run's files.
"""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketval.constants import SCHEMA_VERSION
from marketval.functions.clock import local_date
from marketval.functions.text import safe_name
from marketval.operators import measures
from marketval.operators.sizing import DATASET, Dim, freed
from marketval.plans.analysis import Tables, analyze

RUN = [*DATASET, "run_at"]
RUNS = "runs"
STAMP = "yyyyMMdd'T'HHmmss'Z'"


class SnapshotIncompatible(ValueError):
    """An archived run that another schema version wrote."""


class SnapshotUnreadable(ValueError):
    """An archived run without its metadata."""


class RunsExist(FileExistsError):
    """A rename whose target already holds runs."""


def run_stamp(moment: Column) -> Column:
    return F.date_format(moment, STAMP)


def run_folder(market: Column, profile: Column, moment: Column) -> Column:
    """'<market>__<profile>/<UTC stamp>' with unsafe characters replaced."""
    return F.concat(safe_name(market), F.lit("__"), safe_name(profile), F.lit("/"), run_stamp(moment))


def folder_name(name: Column) -> Column:
    """A name as a partition value, escaped so that no two names share one; '%' is the empty name."""
    return F.when(name == "", F.lit("%")).otherwise(F.replace(F.url_encode(name), F.lit("*"), F.lit("%2A")))


def named_by(folder: Column) -> Column:
    """The name that `folder_name` escaped."""
    return F.when(folder == "%", F.lit("")).otherwise(F.try_url_decode(folder))


def _folder(spark: SparkSession, name: str | None) -> str:
    """The directory part of a name: the writer escapes the sign of the escapes once more."""
    if name is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return spark.range(1).select(folder_name(F.lit(name)).alias("f")).first()["f"].replace("%", "%25")


def _tagged(rows: DataFrame, stamp: str) -> DataFrame:
    return rows.withColumns({
        **{c: folder_name(F.col(c)) for c in DATASET}, "run_at": F.lit(stamp),
    })


def _partitions(spark: SparkSession, root: str, name: str, stamp: str) -> list:
    """Folders of one stamp in the tables that match `name`, as paths of the file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/market=*/profile=*/run_at={stamp}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(files, f.getPath()) for f in files.globStatus(path) or []]


def _withdraw(tables: Tables, root: str, stamp: str) -> None:
    """Remove what an earlier write left under this stamp for this run's datasets; the run rows go
    first, so that a run which is being written anew is not listed."""
    spark = tables.sold.sparkSession
    there = _partitions(spark, root, RUNS, stamp) + _partitions(spark, root, "*", stamp)
    if not there:
        return
    named = _tagged(tables.profiles.df, stamp).select(*DATASET).distinct().toLocalIterator()
    shown = lambda f: "__HIVE_DEFAULT_PARTITION__" if f is None else f.replace("%", "%25")
    mine = {f"market={shown(r['market'])}/profile={shown(r['profile'])}/run_at={stamp}" for r in named}
    for files, path in there:
        if "/".join(str(path.toString()).rsplit("/", 3)[1:]) in mine:
            files.delete(path, True)


def write_run(
    results: dict[str, DataFrame], tables: Tables, root: str, stamp: str,
    window: tuple[str, str], researcher: str = "",
) -> None:
    """Write every result table, and the run rows last: a run is listed once it is whole.

    Writing a run again replaces its own partitions and no others, a table that has no rows this
    time included. The run rows name every table with its schema, so an empty one reads as empty."""
    stored = {**results, "subjects": tables.subjects.df}
    schemas = F.create_map(*[F.lit(x) for n, rows in stored.items() for x in (n, _tagged(rows, stamp).schema.json())])
    runs = (
        tables.profiles.df.withColumn("schema_version", F.lit(SCHEMA_VERSION))
        .withColumn("window_start", F.lit(window[0]).cast("date"))
        .withColumn("window_end", F.lit(window[1]).cast("date"))
        .withColumn("researcher", F.lit(researcher))
        .withColumn("tables", schemas)
    )
    _withdraw(tables, root, stamp)
    for name, rows in stored.items():
        _put(_tagged(rows, stamp), f"{root}/{name}")
    _put(_tagged(runs, stamp), f"{root}/{RUNS}")


def _put(rows: DataFrame, path: str) -> None:
    # A task writes the datasets that it holds, one after the other: whole rows are not shuffled for it.
    with freed(rows.sparkSession):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy(*RUN).parquet(path))


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored table whose keys are text, whatever a folder's name looks like. One that has never
    had a row is empty, with the schema that its run names."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], StructType.fromJson(json.loads(schema)))
    fields = [StructField(f.name, StringType()) if f.name in RUN else f for f in found.fields]
    stored = spark.read.schema(StructType(fields)).parquet(path)
    return stored.withColumns({c: named_by(F.col(c)) for c in DATASET})


def check_version(runs: DataFrame) -> None:
    bad = runs.where(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION)).select(*RUN, "schema_version").first()
    if bad is not None:
        raise SnapshotIncompatible(
            f"{bad['market']}/{bad['profile']} {bad['run_at']} was written by schema "
            f"v{bad['schema_version']}; this build reads v{SCHEMA_VERSION}"
        )


def _picked(rows: DataFrame, market: str | None, profile: str | None, stamp: str | None) -> DataFrame:
    for column, value in (("market", market), ("profile", profile)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows if stamp is None else rows.where(F.col("run_at") == stamp)


def read_stored(
    spark: SparkSession, root: str, name: str, market: str | None = None,
    profile: str | None = None, stamp: str | None = None,
) -> DataFrame:
    """A result table exactly as the runs reported it. Nothing is recomputed."""
    runs = _picked(_read(spark, f"{root}/{RUNS}"), market, profile, stamp)
    check_version(runs)
    if "tables" not in runs.columns:  # written before runs named their tables
        return _picked(_read(spark, f"{root}/{name}"), market, profile, stamp)
    named = runs.select(F.try_element_at("tables", F.lit(name)).alias("schema")).where("schema IS NOT NULL").first()
    return _picked(_read(spark, f"{root}/{name}", named and named["schema"]), market, profile, stamp)


def list_runs(
    spark: SparkSession, root: str, market: str | None = None, profile: str | None = None
) -> DataFrame:
    """Archived runs, newest first; none where nothing was ever archived."""
    try:
        stored = _read(spark, f"{root}/{RUNS}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*RUN, "researcher"]))
    runs = stored.select(*RUN, "researcher")
    runs = _picked(runs, market, profile, None).distinct()
    return runs.orderBy(F.col("run_at").desc(), "market", "profile")


def history(runs: DataFrame, limit: int = 20) -> tuple[DataFrame, int]:
    """The newest runs, and how many more there are; runs of one moment go by market and profile."""
    return runs.orderBy(F.col("run_at").desc(), "market", "profile").limit(limit), max(runs.count() - limit, 0)


def latest_run(runs: DataFrame, before: Column | None = None) -> DataFrame:
    """Per dataset the latest run, strictly before a moment when one is given."""
    rows = runs if before is None else runs.where(F.col("run_at") < before)
    return rows.groupBy(*DATASET).agg(F.max("run_at").alias("run_at"))


def runs_on(runs: DataFrame, day: Column, zone: str) -> DataFrame:
    """Per dataset the newest run listed under a local date."""
    moment = F.try_to_timestamp("run_at", F.lit(STAMP))
    return latest_run(runs.where(local_date(moment, zone) == day))


def profiles_with_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*DATASET).agg(F.count_distinct("run_at").alias("runs"))


def run_summary(runs: DataFrame, sold: DataFrame, active: DataFrame) -> DataFrame:
    """Per run its collector and how many rows of each side it holds."""
    n = F.count(F.lit(1))
    return (
        runs.join(sold.groupBy(*RUN).agg(n.alias("sold")), RUN, "left")
        .join(active.groupBy(*RUN).agg(n.alias("active")), RUN, "left")
        .select(*RUN, "researcher", F.coalesce("sold", F.lit(0)).alias("sold"),
                F.coalesce("active", F.lit(0)).alias("active"))
    )


def rename_profile(spark: SparkSession, root: str, market: str, old: str, new: str) -> int:
    """Move a profile's runs to a new name; returns how many. An occupied name is refused."""
    runs = list_runs(spark, root, market, old)
    moved = runs.count()
    if not moved:
        return 0
    if not list_runs(spark, root, market, new).isEmpty():
        raise RunsExist(f"{market}/{new} already holds runs")
    there, before, after = (_folder(spark, x) for x in (market, old, new))
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    # Directory moves, the listing of runs last, so a rename that stops half-way can be repeated.
    tables = sorted((f.getPath().getName() for f in fs.listStatus(top)), key=lambda t: t == RUNS)
    for table in tables:
        source = path(f"{root}/{table}/market={there}/profile={before}")
        if fs.exists(source):
            target = path(f"{root}/{table}/market={there}/profile={after}")
            if not fs.rename(source, target):
                raise OSError(f"could not move {source} to {target}")
    return moved


def collected(
    spark: SparkSession, root: str, geometry: DataFrame, market: str | None = None,
    profile: str | None = None, stamp: str | None = None,
) -> Tables:
    """The rows and settings of the archived runs under a stamp, ready to be analyzed again."""
    runs = read_stored(spark, root, RUNS, market, profile, stamp)
    if runs.isEmpty():
        raise SnapshotUnreadable(f"no run metadata for {market}/{profile} {stamp}")
    # What the analysis adds to a row, and adds again.
    drop = ["addr_key", "addr_key_unit", "addr_key_bare", "metric_size", "ppsf", "ratio", "reduced",
            "core", "borderline", "missing_metric", "list_ord", "grp_ord", "slot_ord"]

    def rows(name: str) -> DataFrame:
        return read_stored(spark, root, name, market, profile, stamp).drop("run_at", *drop)

    settings = runs.drop("run_at", "schema_version", "window_start", "window_end", "researcher")
    subjects = read_stored(spark, root, "subjects", market, profile, stamp).drop("run_at")
    return Tables(rows("sold"), rows("active"), settings, subjects, geometry)


def reopen(
    archived: Tables, profiles: DataFrame | None = None,
    exclude_addresses: DataFrame | None = None, keep: bool = True,
) -> dict[str, DataFrame]:
    """Analyze archived rows again, under their own settings or substituted ones.

    `exclude_addresses` has market, profile, address; both sides lose those rows by the key
    that keeps the unit.
    """
    settings = archived.profiles if profiles is None else Dim(profiles)
    sold, active = archived.sold, archived.active
    if exclude_addresses is not None:
        drops = measures.with_keys(exclude_addresses, settings).select(*DATASET, "addr_key_unit")
        sold = drop_rows(measures.with_keys(sold, settings), drops)
        active = drop_rows(measures.with_keys(active, settings), drops)
        extra = ["addr_key", "addr_key_unit", "addr_key_bare"]
        sold, active = sold.drop(*extra), active.drop(*extra)
    tables = Tables(
        sold, active, settings, archived.subjects, archived.geometry, archived.families
    )
    out = analyze(tables, keep)
    if profiles is not None or exclude_addresses is not None:
        note = settings.df.select(
            *DATASET, F.lit("reanalyzed_with_changed_settings").alias("code"),
            F.lit(1).cast("long").alias("n"),
        )
        out["caveats"] = out["caveats"].unionByName(note)
    return out


def drop_rows(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """Rows whose unit-keeping key is not in the drop list."""
    return rows.join(drops.distinct(), [*DATASET, "addr_key_unit"], "left_anti")
