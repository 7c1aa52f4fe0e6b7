"""Run quality as rows: what a run could not see, what it was asked for, what to be wary of."""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.constants import CACHE_READ_FACTOR, CACHE_WRITE_FACTOR, QUADRANTS
from marketval.operators.sizing import DATASET, Dim, as_dim

FEW_SALES = 10
NAMED_SHARE = 0.8


def _problems(*rules: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(rule, code) for code, rule in rules]), lambda x: x.isNotNull())


def profile_problems(profiles: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows (market, profile, subject_id, problem) for settings that no run may use."""
    improved = F.col("property_type") != "vacant_land"
    low, high = F.col("exclusions.core_min_ppsf"), F.col("exclusions.core_max_ppsf")
    size = F.when(F.col("metric") == "living_sqft", F.col("s_living")).otherwise(F.col("s_lot"))
    side = subjects.select(
        *DATASET, "subject_id", F.col("lot_sqft").alias("s_lot"), F.col("living_sqft").alias("s_living")
    )
    found = _problems(
        ("profile needs a name", F.coalesce("profile", F.lit("")) == ""),
        (
            "improved property types should price on living-area sq ft, not lot sq ft",
            improved & (F.col("metric") == "lot_sqft"),
        ),
        (
            "vacant land has no living area; metric must be lot_sqft",
            ~improved & (F.col("metric") == "living_sqft"),
        ),
        ("subject size is required to value the subject property", size.isNull()),
        ("window_days must be positive", F.col("window_days") <= 0),
        ("core view lower bound must be below the upper bound", low >= high),
    )
    return (
        profiles.join(side, DATASET, "left")
        .select(*DATASET, "subject_id", F.explode(found).alias("problem"))
    )


def market_problems(
    markets: DataFrame, profiles: DataFrame, geometry: DataFrame, sources: DataFrame
) -> DataFrame:
    """Conformance of the dimension tables: rows (market, severity, code).

    `markets` has market, default_profile, fixture_dir, data_dir.
    """
    lons = F.transform("ns_centerline", lambda w: w["lon"])
    up = F.array_sort(lons)
    points = F.coalesce(F.size("ns_centerline"), F.lit(0))
    shape = geometry.select(
        "market", F.col("ew_longitude"), points.alias("points"),
        ((lons == up) | (lons == F.reverse(up))).alias("in_order"),
        F.array_min(lons).alias("west"), F.array_max(lons).alias("east"),
    )
    named = profiles.groupBy("market").agg(F.count(F.lit(1)).alias("n_profiles"))
    default = profiles.select("market", F.col("profile").alias("default_profile")).distinct()
    fed = sources.groupBy("market").agg(F.count(F.lit(1)).alias("n_sources"))
    base = (
        markets.join(named, "market", "left")
        .join(
            default.withColumn("default_found", F.lit(True)), ["market", "default_profile"], "left"
        )
        .join(shape, "market", "left")
        .join(fed, "market", "left")
    )
    configured = (F.coalesce("points", F.lit(0)) > 0) & F.col("ew_longitude").isNotNull()
    asked = F.coalesce("default_profile", F.lit("")) != ""

    def row(severity: str, code: str, rule: Column) -> Column:
        return F.when(
            F.coalesce(rule, F.lit(False)),
            F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")),
        )

    found = F.array(
        row("problem", "market has no name", F.coalesce("market", F.lit("")) == ""),
        row("problem", "ships no profiles", F.coalesce("n_profiles", F.lit(0)) == 0),
        row("problem", "default profile is unknown", asked & F.col("default_found").isNull()),
        row("warning", "no quadrant geometry", ~configured),
        row("warning", "centerline not in longitude order", configured & ~F.col("in_order")),
        row("warning", "single waypoint", configured & (F.col("points") < 2)),
        row(
            "warning", "E/W divider outside the centerline",
            configured & ~F.col("ew_longitude").between(F.col("west"), F.col("east")),
        ),
        row("warning", "declares no sources", F.coalesce("n_sources", F.lit(0)) == 0),
        row("warning", "no recorded data", F.coalesce("fixture_dir", F.lit("")) == ""),
        row("problem", "no data directory", F.coalesce("data_dir", F.lit("")) == ""),
    )
    return base.select(
        "market", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f")
    ).select("market", "_f.*")


def profile_conformance(profiles: DataFrame) -> DataFrame:
    """Profile settings that are legal but unusual: rows (market, profile, severity, code)."""
    land = F.col("property_type") == "vacant_land"
    found = F.array(
        F.when(
            land & (F.col("metric") != "lot_sqft"),
            F.struct(F.lit("problem").alias("severity"), F.lit("land must price on lot_sqft").alias("code")),
        ),
        F.when(
            land & ~F.col("identification.requires_absent_bed_bath"),
            F.struct(
                F.lit("warning").alias("severity"),
                F.lit("land normally identifies on absent bed/bath counts").alias("code"),
            ),
        ),
        F.when(
            ~land & (F.col("metric") != "living_sqft"),
            F.struct(
                F.lit("warning").alias("severity"),
                F.lit("improved types normally price on living area").alias("code"),
            ),
        ),
    )
    return profiles.select(
        *DATASET, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f")
    ).select(*DATASET, "_f.*")


def empty_runs(profiles: Dim | DataFrame, stats: DataFrame) -> DataFrame:
    """Run-level conformance: per dataset the sold count and whether the run holds any sale."""
    return (
        as_dim(profiles).df.select(*DATASET)
        .join(stats.select(*DATASET, "count"), DATASET, "left")
        .select(
            *DATASET, F.coalesce("count", F.lit(0)).alias("sold_count"),
            (F.coalesce("count", F.lit(0)) > 0).alias("passes"),
        )
    )


def reach(sold: DataFrame, windows: DataFrame) -> DataFrame:
    """Days at the start of the asked window that no source reached. `windows` has start, end."""
    earliest = sold.groupBy(*DATASET).agg(F.min("sold_date").alias("earliest"))
    return (
        windows.join(earliest, DATASET)
        .where(F.col("earliest") > F.col("start"))
        .select(*DATASET, "start", "earliest", F.datediff("earliest", "start").alias("missing_days"))
    )


def active_attribution(active: DataFrame) -> DataFrame:
    """Datasets where fewer than four listings in five name an agent."""
    return (
        active.groupBy(*DATASET)
        .agg(
            F.count(F.lit(1)).alias("listings"),
            F.count_if(F.coalesce("agent", F.lit("")) != "").alias("named"),
        )
        .where(F.col("named") < F.col("listings") * NAMED_SHARE)
    )


def window_loss(recorded: DataFrame, windows: DataFrame) -> DataFrame:
    """Recorded sales outside the asked window, and the days the recording covers."""
    day = F.col("sold_date")
    out = day.isNotNull() & ~day.between(F.col("start"), F.col("end"))
    return (
        recorded.join(windows, DATASET)
        .groupBy(*DATASET)
        .agg(
            F.count_if(out).alias("dropped"), F.count(F.lit(1)).alias("recorded"),
            F.min(day).alias("first_sale"), F.max(day).alias("last_sale"),
        )
        .where("dropped > 0")
    )


def span_note(sold: DataFrame, windows: DataFrame) -> DataFrame:
    """Found dates against the asked window; short_days only when it is more than one."""
    found = sold.groupBy(*DATASET).agg(F.min("sold_date").alias("first"), F.max("sold_date").alias("last"))
    short = F.datediff("first", "start")
    return (
        found.where(F.col("first").isNotNull())
        .join(windows, DATASET)
        .select(
            *DATASET, "start", "end", "first", "last",
            F.when(short > 1, short).alias("short_days"),
        )
    )


def usage_cost(usage: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """Reading cost per run: cached reads and writes are weighted; an unpriced model is NULL.

    `usage` has by + model and token counts; `prices` has model, input_rate, output_rate
    in dollars per million tokens.
    """
    billable = (
        F.col("input_tokens")
        + F.col("cache_read_tokens") * CACHE_READ_FACTOR
        + F.col("cache_write_tokens") * CACHE_WRITE_FACTOR
    )
    summed = usage.groupBy(*by, "model").agg(
        *[
            F.sum(c).alias(c)
            for c in ("calls", "input_tokens", "output_tokens", "cache_read_tokens",
                      "cache_write_tokens", "failures")
        ]
    )
    return summed.join(prices, "model", "left").select(
        *by, "model", "calls", "input_tokens", "output_tokens", "failures",
        (
            (billable * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6
        ).alias("cost_usd"),
    )


def run_warnings(profiles: Dim | DataFrame, sold_stats: DataFrame, active_stats: DataFrame) -> DataFrame:
    """Rows (market, profile, code) a reader of the run must see."""
    s, a = F.coalesce("sold_count", F.lit(0)), F.coalesce("active_count", F.lit(0))
    found = _problems(
        ("experimental profile", F.col("property_type") != "vacant_land"),
        ("no active listings", (a == 0) & (s > 0)),
        ("no sold comps", s == 0),
        ("few sold comps", (s > 0) & (s < FEW_SALES)),
    )
    return (
        as_dim(profiles).df.select(*DATASET, "property_type")
        .join(sold_stats.select(*DATASET, F.col("count").alias("sold_count")), DATASET, "left")
        .join(active_stats.select(*DATASET, F.col("count").alias("active_count")), DATASET, "left")
        .select(*DATASET, F.explode(found).alias("code"))
    )


def empty_active(profiles: Dim | DataFrame, active: DataFrame, sources: DataFrame) -> DataFrame:
    """Why a dataset has no listings: its active sources gave none (a row for each), or it has none."""
    has = F.contains(F.lower(F.coalesce("role", F.lit(""))), F.lit("active")) | F.contains(
        F.lower("source"), F.lit("active")
    )
    configured = (
        sources.where(has).select("market", "source").distinct()
    )
    return (
        as_dim(profiles).df.select(*DATASET)
        .join(active.select(*DATASET).distinct(), DATASET, "left_anti")
        .join(configured, "market", "left")
        .select(
            *DATASET,
            F.when(F.col("source").isNotNull(), "configured sources gave none")
            .otherwise("no active source configured").alias("diagnosis"),
            "source",
        )
    )


def diagnostics(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """The run-quality ledger: {kind: (rows, message)} stacked as (market, profile, kind, message)."""
    out = None
    for kind, (rows, message) in parts.items():
        one = rows.select(*DATASET, F.lit(kind).alias("kind"), message.cast("string").alias("message"))
        out = one if out is None else out.unionByName(one)
    return out


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*DATASET, "kind").agg(F.count(F.lit(1)).alias("n"))


def valid_area(area: Column) -> Column:
    return F.when(area.isin(QUADRANTS), area)
