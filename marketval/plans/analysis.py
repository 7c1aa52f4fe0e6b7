"""The full analysis of collected rows, for every dataset and subject at once."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from marketval.constants import BROKERAGE_FAMILIES
from marketval.operators import agents, areas, cleaning, guidance, measures, quality, stats, valuation
from marketval.operators.sizing import DATASET, Dim, as_dim, written


@dataclass
class Tables:
    """What one run reads. Rows carry market, profile and row_ord."""

    sold: DataFrame
    active: DataFrame
    profiles: Dim | DataFrame
    subjects: Dim | DataFrame
    geometry: Dim | DataFrame
    families: list[tuple[str, list[str]]] = field(default_factory=lambda: BROKERAGE_FAMILIES)

    def __post_init__(self) -> None:
        self.profiles = as_dim(self.profiles)
        self.subjects = as_dim(self.subjects)
        self.geometry = as_dim(self.geometry)


class ProfileInvalid(ValueError):
    """A profile that no run may use."""


@dataclass
class Prepared:
    """Cleaned, classified and measured rows, and the cleaning logs."""

    sold: DataFrame
    active: DataFrame
    cleaned: cleaning.Cleaned


def prepare(tables: Tables, keep: bool = False) -> Prepared:
    """Key, merge, exclude, reconcile, classify, measure. `keep` stores the two results, which
    every later table reads."""
    # Stored at once: the merge, the reconciliation and the final rows all read them.
    sold = written(measures.with_keys(tables.sold, tables.profiles))
    active = written(measures.with_keys(tables.active, tables.profiles))
    cleaned = cleaning.clean(sold, active, tables.profiles)
    placed_sold = areas.classify_all(cleaned.sold, tables.geometry)
    placed_active = areas.classify_all(cleaned.active, tables.geometry)
    out_sold = measures.sold_measures(placed_sold, tables.profiles)
    out_active = measures.active_measures(placed_active, tables.profiles)
    # Kept sales are listed by address group, then by the sale's first row.
    out_sold = out_sold.withColumn("list_ord", F.struct("grp_ord", "slot_ord"))
    if keep:
        out_sold, out_active = written(out_sold), written(out_active)
    return Prepared(out_sold, out_active, cleaned)


def analyze(
    tables: Tables, keep: bool = True, prepared: Prepared | None = None
) -> dict[str, DataFrame]:
    """Every result table of a run, keyed by name. Stage order is part of the meaning:
    merging and reconciliation come before any statistic, areas after exclusion."""
    ready = prepared or prepare(tables, keep)
    sold, active = ready.sold, ready.active
    prof, subj = tables.profiles, tables.subjects
    side_sold = stats.sold_stats(sold)
    side_active = stats.active_stats(active)
    valued = valuation.value_subjects(sold, active, subj, prof)
    ladder = valuation.bracket_ladder(sold, subj, prof)
    bands = valuation.size_bands(sold, subj, prof)
    who = agents.agent_table(sold, active, tables.families, order="list_ord")
    return {
        "sold": sold,
        "active": active,
        "sold_stats": side_sold,
        "active_stats": side_active,
        "sold_to_ask": stats.sold_to_ask(sold),
        "valuation": valued,
        "valuation_warnings": valuation.valuation_warnings(valued),
        "guidance": guidance.build_guidance(valued, guidance.ratio_points(sold), prof),
        "areas": areas.area_table(sold, active, prof),
        "unclassified": areas.unclassified(sold, active, prof),
        "size_bands": bands,
        "size_trend": valuation.size_trend(bands),
        "ladder": ladder,
        "ladder_spread": valuation.ladder_spread(ladder),
        "agents": agents.interview_order(who),
        "brokerages": agents.brokerage_order(agents.brokerage_table(sold, active, tables.families)),
        "attribution": stats.attribution_coverage(sold),
        "excluded": ready.cleaned.excluded,
        "reconciled": ready.cleaned.reconciled,
        "duplicates": ready.cleaned.duplicates,
        "missing_metric": ready.cleaned.missing_metric,
        "shared_addresses": ready.cleaned.shared_addresses,
        "caveats": stats.caveats(sold, side_sold),
        "warnings": quality.run_warnings(prof, side_sold, side_active),
    }


def run(tables: Tables, end: Column) -> dict[str, DataFrame]:
    """Window, then analyze. Settings that fail validation stop the run before any row is read."""
    bad = quality.profile_problems(tables.profiles.df, tables.subjects.df)
    first = bad.first()
    if first is not None:
        raise ProfileInvalid(f"{first['market']}/{first['profile']}: {first['problem']}")
    windowed = Tables(
        cleaning.in_window(tables.sold, tables.profiles, end), tables.active, tables.profiles,
        tables.subjects, tables.geometry, tables.families,
    )
    return analyze(windowed)


def scenarios_of(tables: Tables, scenarios: Dim | DataFrame) -> Tables:
    """Many what-ifs as one run: each scenario becomes a profile of its own.

    `scenarios` has market, profile, scenario_id, subject_size and exclude_keys (unit-keeping
    address keys to leave out). A size replaces the subject's size under the profile's metric.
    """
    dim = as_dim(scenarios)
    named = dim.df.withColumn(
        "_name", F.concat("profile", F.lit("#"), F.col("scenario_id").cast("string"))
    )
    names = dim.small(named.select(*DATASET, "_name"))
    keys = named.select("market", F.col("_name").alias("profile"),
                        F.explode("exclude_keys").alias("addr_key_unit"))
    drops = Dim(keys).small(keys)

    def spread(rows: DataFrame) -> DataFrame:
        return rows.join(names, DATASET).withColumn("profile", F.col("_name")).drop("_name")

    def keyed(rows: DataFrame) -> DataFrame:
        wide = measures.with_keys(spread(rows), profiles)
        return wide.join(drops, [*DATASET, "addr_key_unit"], "left_anti").drop(
            "addr_key", "addr_key_unit", "addr_key_bare"
        )

    base = tables.profiles.df.join(named.select(*DATASET, "_name"), DATASET)
    profiles = Dim(base.withColumn("profile", F.col("_name")).drop("_name"), dim)
    sized = tables.subjects.df.join(
        named.select(*DATASET, "_name", "subject_size"), DATASET
    ).join(tables.profiles.df.select(*DATASET, "metric"), DATASET)
    new = F.col("subject_size")
    subjects = (
        sized.withColumn(
            "lot_sqft", F.when((F.col("metric") == "lot_sqft") & new.isNotNull(), new)
            .otherwise(F.col("lot_sqft"))
        )
        .withColumn(
            "living_sqft", F.when((F.col("metric") == "living_sqft") & new.isNotNull(), new)
            .otherwise(F.col("living_sqft"))
        )
        .withColumn("profile", F.col("_name"))
        .drop("_name", "subject_size", "metric")
    )
    return Tables(
        keyed(tables.sold), keyed(tables.active), profiles, Dim(subjects, tables.subjects),
        tables.geometry, tables.families,
    )
