"""What a subject is worth: the similar-size bracket, five bases, the ladder and the bands.

Sold and active inputs carry measures. Ranges of sizes are met through size slices, an equality
join whose range side is broadcast after a size check. A subject's ranges are cut at all their ends
into rings; a sale falls into one ring of each different set of ranges, is counted there once, and
what a range holds is the sum of its rings.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketval.constants import (
    LADDER_SAME_WIDTH,
    LADDER_THIN,
    LADDER_WIDTHS,
    MAX_BANDS,
    MIN_BAND,
    MIN_BRACKET,
)
from marketval.functions import rates
from marketval.functions.text import grouped, percent
from marketval.operators.quantiles import Members, aggregate, meet, percentiles, values_at_ranks
from marketval.operators.sizing import DATASET, Dim, as_dim, written

SUBJECT = [*DATASET, "subject_id"]


def subject_brackets(subjects: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """One row per subject: its size under the profile, its bracket and its bed rule."""
    dim = as_dim(profiles)
    settings = dim.small(dim.df.select(*DATASET, "metric", "similar_bracket"))
    b = F.col("similar_bracket")
    center = rates.metric_size(b["attribute"], F.col("lot_sqft"), F.col("living_sqft"))
    bounds = rates.bracket_bounds(
        F.col("center"), b["tolerance"], b["explicit_low"], b["explicit_high"]
    )
    return (
        subjects.join(settings, DATASET)
        .withColumn("center", center)
        .withColumn(
            "subject_size",
            rates.metric_size(F.col("metric"), F.col("lot_sqft"), F.col("living_sqft")),
        )
        .withColumn("_b", bounds)
        .select(
            *SUBJECT, "subject_size", "center",
            F.col("_b.low").alias("bracket_low"), F.col("_b.high").alias("bracket_high"),
            b["attribute"].alias("attribute"),
            F.when(b["match_bed_count"], F.col("beds")).alias("bed_rule"),
        )
    )


# Slices per e-fold of size. A range is met at the finest level at which it spans few slices, so
# narrow and wide ranges both stay equality joins.
_LEVELS = [10.0, 1.0, 0.1]
_MAX_SLICES = 64
_LOG_FLOOR = -746.0


def _slice_of(size: Column, level: float) -> Column:
    log = F.when(size > 0, F.ln(size)).otherwise(F.lit(_LOG_FLOOR))
    return F.floor(log * level).cast("int")


def size_range_join(sold: DataFrame, ranges: Dim, rule: Column) -> DataFrame:
    """Sold rows with every range of their dataset that holds their size.

    `ranges` has market, profile, attribute, low, high and other columns of its own.
    """
    size = rates.metric_size(F.col("attribute"), F.col("lot_sqft"), F.col("living_sqft"))
    inside = (size >= F.col("low")) & (size <= F.col("high")) & rule
    spans = [
        F.struct(
            F.lit(i).alias("level"), _slice_of(F.col("low"), x).alias("lo"),
            _slice_of(F.col("high"), x).alias("hi"),
        )
        for i, x in enumerate(_LEVELS)
    ]
    coarsest = len(_LEVELS) - 1
    chosen = F.try_element_at(
        F.filter(
            F.array(*spans), lambda s: (s["hi"] - s["lo"] <= _MAX_SLICES) | (s["level"] == coarsest)
        ),
        F.lit(1),
    )
    cut = (
        ranges.df.where(F.col("low") <= F.col("high"))
        .withColumn("_s", chosen)
        .withColumn("_level", F.col("_s.level"))
        .withColumn("_slice", F.explode(F.sequence("_s.lo", "_s.hi")))
        .drop("_s")
    )
    places = F.array(
        *[F.struct(F.lit(i).alias("_level"), _slice_of(F.col("_at"), x).alias("_slice")) for i, x in enumerate(_LEVELS)]
    )
    read = Dim(ranges.df.select(*DATASET, "attribute").distinct(), ranges).small()
    met = (
        sold.join(read, DATASET).withColumn("_at", size).where(F.col("_at").isNotNull())
        .withColumn("_p", F.explode(places)).select("*", "_p.*").drop("_p", "_at")
    )
    side = Dim(cut, ranges).small()
    return met.join(side, [*DATASET, "attribute", "_level", "_slice"]).where(inside).drop(
        "_level", "_slice"
    )


def _same_beds() -> Column:
    return F.col("bed_rule").isNull() | F.coalesce(F.col("beds") == F.col("bed_rule"), F.lit(False))


@dataclass
class Rings:
    """Sales by ring: `sales` has the ring's columns and ppsf, `members` the rings of each range."""

    sales: DataFrame
    members: Members

    def sums(self, points: dict[str, tuple[Column, float]]) -> DataFrame:
        """Per range that holds a sale: count, rated, avg_ppsf and the percentiles."""
        by = self.members.group
        tallies = self.sales.groupBy(*self.members.atom).agg(
            F.count(F.lit(1)).alias("n"), F.count("ppsf").alias("r"), F.sum("ppsf").alias("s")
        )
        found = meet(self.members.table, tallies, self.members.atom).groupBy(*by).agg(
            F.sum("n").alias("count"), F.sum("r").alias("rated"),
            F.try_divide(F.sum("s"), F.sum("r")).alias("avg_ppsf"),
        )
        return meet(found, percentiles(self.sales, by, points, self.members), by, "left")


def rings(sold: DataFrame, ranges: DataFrame, key: list[str], dims: Dim) -> Rings:
    """Sales by the rings that each subject's ranges are cut into at their ends.

    `ranges` has `key` (SUBJECT and more), attribute, bed_rule, low and high. Subjects whose ranges
    are alike share a set, so there is one pair for a sale and a different set. A ring is an end
    itself (odd numbers) or what lies between two ends (even ones).
    """
    rule = ["attribute", "bed_rule"]
    sound = ranges.where(F.col("low") <= F.col("high"))
    ends = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("low", "high")))))
    bounds = sound.groupBy(*SUBJECT, *rule).agg(ends.alias("bounds"))
    sets = written(meet(
        bounds, bounds.groupBy(*DATASET, *rule, "bounds").agg(F.min("subject_id").alias("set")),
        [*DATASET, *rule, "bounds"],
    ))
    hulls = sets.where(F.col("subject_id") == F.col("set")).select(
        *DATASET, *rule, "set", "bounds", F.element_at("bounds", 1).alias("low"), F.element_at("bounds", -1).alias("high")
    )
    size = rates.metric_size(F.col("attribute"), F.col("lot_sqft"), F.col("living_sqft"))
    below = F.size(F.filter("bounds", lambda b: b < size))
    ring = 2 * below + F.coalesce(F.get("bounds", below) == size, F.lit(False)).cast("int")
    met = size_range_join(sold, Dim(hulls, dims), _same_beds())
    sales = written(met.select(*DATASET, "set", ring.alias("ring"), "ppsf"))
    at = F.array_position
    spans = F.sequence((2 * at("bounds", F.col("low")) - 1).cast("int"), (2 * at("bounds", F.col("high")) - 1).cast("int"))
    table = meet(sound, sets, [*SUBJECT, *rule]).select(*key, "set", F.explode(spans).alias("ring"))
    return Rings(sales, Members(written(table), [*DATASET, "set", "ring"], key))


def bracket_pairs(sold: DataFrame, subjects: Dim | DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """The similar-size sales of each subject."""
    dim = as_dim(subjects)
    ranges = subject_brackets(dim.df, profiles).select(
        *SUBJECT, "attribute", "bed_rule",
        F.col("bracket_low").alias("low"), F.col("bracket_high").alias("high"),
    )
    return size_range_join(sold, Dim(ranges, dim), _same_beds())


BASES = [
    ("similar_size_median", True),
    ("similar_size_avg", False),
    ("all_sold_median", False),
    ("all_sold_avg", False),
    ("active_median", False),
]


def value_subjects(
    sold: DataFrame,
    active: DataFrame,
    subjects: Dim | DataFrame,
    profiles: Dim | DataFrame,
) -> DataFrame:
    """Five bases per subject: rate, value, sample size; the first is the primary one."""
    dims, prof = as_dim(subjects), as_dim(profiles)
    rated, middle = F.count("ppsf"), (F.col("ppsf"), 0.5)
    rows = written(sold.select(*DATASET, "lot_sqft", "living_sqft", "beds", "ppsf"))
    brackets = subject_brackets(dims.df, prof)
    ranges = brackets.select(
        *SUBJECT, "attribute", "bed_rule", F.col("bracket_low").alias("low"), F.col("bracket_high").alias("high")
    )
    bracket = rings(rows, ranges, SUBJECT, dims).sums({"_r0": middle}).select(
        *SUBJECT, F.col("rated").alias("_n0"), F.col("avg_ppsf").alias("_r1"), "_r0"
    )
    market = aggregate(
        rows.select(*DATASET, "ppsf"), DATASET, [rated.alias("_n2"), F.avg("ppsf").alias("_r3")], {"_r2": middle}
    )
    asks = aggregate(active.select(*DATASET, "ppsf"), DATASET, [rated.alias("_n4")], {"_r4": middle})
    n0 = F.coalesce("_n0", F.lit(0))
    bases = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(key).alias("basis"),
                F.col(f"_r{i}").alias("ppsf"), n.alias("sample_size"),
                F.lit(primary).alias("is_primary"),
            )
            for i, ((key, primary), n) in enumerate(
                zip(
                    BASES,
                    [n0, n0, F.coalesce("_n2", F.lit(0)), F.coalesce("_n2", F.lit(0)),
                     F.coalesce("_n4", F.lit(0))],
                )
            )
        ]
    )
    return (
        brackets.join(bracket, SUBJECT, "left")
        .join(prof.small(market), DATASET, "left")
        .join(prof.small(asks), DATASET, "left")
        .select(
            *SUBJECT, "subject_size", "bracket_low", "bracket_high",
            n0.alias("bracket_count"), F.explode(bases).alias("_b"),
        )
        .select(
            *SUBJECT, "subject_size", "bracket_low", "bracket_high", "bracket_count", "_b.*",
            (F.col("_b.ppsf") * rates.nonzero(F.col("subject_size"))).alias("value"),
        )
    )


def valuation_warnings(valued: DataFrame) -> DataFrame:
    """Rows (subject, code, n): no subject size, or a thin bracket."""
    items = F.array(
        F.when(
            F.col("subject_size").isNull(),
            F.struct(F.lit("no_subject_size").alias("code"), F.lit(0).cast("long").alias("n")),
        ),
        F.when(
            F.col("bracket_count") < MIN_BRACKET,
            F.struct(F.lit("thin_bracket").alias("code"), F.col("bracket_count").cast("long").alias("n")),
        ),
    )
    return (
        valued.where("is_primary")
        .select(*SUBJECT, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("_i"))
        .select(*SUBJECT, "_i.code", "_i.n")
    )


def ladder_rungs(subjects: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """The rungs of each subject in widening order: fixed widths and the profile's own bracket."""
    base = subject_brackets(subjects, profiles).where(
        F.col("center").isNotNull() & F.col("subject_size").isNotNull()
    )
    c, low, high = F.col("center"), F.col("bracket_low"), F.col("bracket_high")
    own = F.greatest(F.abs(high - c), F.abs(c - low)) / c

    def rung(width: Column, lo: Column, hi: Column, name: Column, mine: bool) -> Column:
        return F.struct(
            width.alias("width"), F.lit(mine).alias("is_profile_bracket"), lo.alias("low"),
            hi.alias("high"), name.alias("name"),
        )

    fixed = F.array(
        *[
            rung(
                F.lit(w), c * F.lit(1 - w), c * F.lit(1 + w),
                F.concat(F.lit("+/-"), percent(F.lit(w))), False,
            )
            for w in LADDER_WIDTHS
        ]
    )
    rungs = F.array_sort(
        F.concat(
            F.filter(fixed, lambda r: F.abs(r["width"] - F.col("_own")) > LADDER_SAME_WIDTH),
            F.array(rung(F.col("_own"), low, high, F.lit("this search"), True)),
        )
    )
    return (
        base.withColumn("_own", own)
        .select(*SUBJECT, "subject_size", "attribute", F.posexplode(rungs).alias("position", "_r"))
        .select(
            *SUBJECT, "subject_size", "attribute", "position", "_r.width", "_r.low", "_r.high",
            "_r.is_profile_bracket",
            F.concat(
                "_r.name", F.lit("  ("), grouped(F.col("_r.low")), F.lit("-"),
                grouped(F.col("_r.high")), F.lit(" sqft)"),
            ).alias("label"),
        )
    )


def bracket_ladder(
    sold: DataFrame,
    subjects: Dim | DataFrame,
    profiles: Dim | DataFrame,
) -> DataFrame:
    """Rates and values per rung, then every sale of the dataset as the last row."""
    dims, prof = as_dim(subjects), as_dim(profiles)
    rungs = ladder_rungs(dims.df, prof)
    key = [*SUBJECT, "position"]
    plain = [F.count(F.lit(1)).alias("count"), F.avg("ppsf").alias("avg_ppsf")]
    middle = {"median_ppsf": (F.col("ppsf"), 0.5)}
    sales = written(sold.select(*DATASET, "lot_sqft", "living_sqft", "beds", "ppsf"))
    ranges = rungs.select(*key, "attribute", F.lit(None).cast("double").alias("bed_rule"), "low", "high")
    found = rings(sales, ranges, key, dims).sums(middle)
    rows = rungs.join(found, key, "left").select(
        *SUBJECT, "position", "label", "low", "high", "subject_size",
        F.coalesce("count", F.lit(0)).alias("count"), "median_ppsf", "avg_ppsf",
        "is_profile_bracket", F.lit(False).alias("is_all_sold"),
    )
    everything = aggregate(sales.select(*DATASET, "ppsf"), DATASET, plain, middle)
    last = (
        rungs.groupBy(*SUBJECT)
        .agg(F.max("position").alias("_last"), F.max("subject_size").alias("subject_size"))
        .join(prof.small(everything), DATASET, "left")
    )
    total = F.coalesce("count", F.lit(0))
    none = F.lit(None).cast("double")
    last = last.select(
        *SUBJECT, (F.col("_last") + 1).alias("position"),
        F.concat(F.lit("every sale ("), total.cast("string"), F.lit(")")).alias("label"),
        none.alias("low"), none.alias("high"), "subject_size", total.alias("count"),
        "median_ppsf", "avg_ppsf", F.lit(False).alias("is_profile_bracket"),
        F.lit(True).alias("is_all_sold"),
    )
    return (
        rows.unionByName(last)
        .withColumn("value_from_median", F.col("median_ppsf") * F.col("subject_size"))
        .withColumn("value_from_avg", F.col("avg_ppsf") * F.col("subject_size"))
        .withColumn("is_thin", F.col("count") < LADDER_THIN)
        .drop("subject_size")
    )


def ladder_spread(ladder: DataFrame) -> DataFrame:
    """How far the estimate travels across readable rungs, as a share of the headline rung."""
    value = F.col("value_from_avg")
    readable = F.when(~F.col("is_thin") & ~F.col("is_all_sold"), value)
    out = ladder.groupBy(*SUBJECT).agg(
        F.count(readable).alias("readable_rungs"),
        F.min(readable).alias("low_value"),
        F.max(readable).alias("high_value"),
        F.max(F.when(F.col("is_profile_bracket"), value)).alias("_anchor"),
    )
    spread = F.try_divide(F.col("high_value") - F.col("low_value"), rates.nonzero(F.col("_anchor")))
    return out.withColumn(
        "spread_pct", F.when(F.col("readable_rungs") >= 2, spread * 100.0)
    ).drop("_anchor")


def band_edges(sold: DataFrame) -> DataFrame:
    """Per dataset the number of bands and their bounds: near-equal counts, cut at values."""
    size = F.col("metric_size")

    def bands(n: Column) -> Column:
        return F.greatest(F.least(F.lit(MAX_BANDS), F.floor(n / MIN_BAND).cast("int")), F.lit(1))

    def ranks(n: Column) -> Column:
        # A cut sits at the half-even rounded position i * n / bands; the ends are min and max.
        k = bands(n)
        return F.transform(
            F.sequence(F.lit(0), k),
            lambda i: F.struct(
                i.cast("string").alias("slot"),
                F.when(i == k, n - 1)
                .otherwise(F.bround(i * n / k, 0).cast("long"))
                .alias("rank"),
            ),
        )

    cuts = values_at_ranks(sold, DATASET, size, ranks)
    bounds = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("slot").cast("int").alias("i"), F.col("value")))),
        lambda s: s["value"].cast("double"),
    )
    return cuts.groupBy(*DATASET).agg(
        bounds.alias("bounds"), F.max("total").alias("n_sized"), (F.count(F.lit(1)) - 1).alias("bands")
    )


def size_bands(
    sold: DataFrame,
    subjects: Dim | DataFrame,
    profiles: Dim | DataFrame,
) -> DataFrame:
    """Rates by size band per dataset; `subjects_in_band` counts the subjects a band holds."""
    dims, prof = as_dim(subjects), as_dim(profiles)
    sold = written(sold.select(*DATASET, "metric_size", "ppsf", "sold_price"))
    edges = written(band_edges(sold))

    def place(x: Column) -> Column:
        # The band whose half-open range holds x; the last band also holds its upper end.
        held = F.filter(
            F.sequence(F.lit(0), F.col("bands").cast("int") - 1),
            lambda i: (F.get(F.col("bounds"), i) <= x)
            & (
                (x < F.get(F.col("bounds"), i + 1))
                | ((i == F.col("bands") - 1) & (x <= F.get(F.col("bounds"), i + 1)))
            ),
        )
        return F.try_element_at(held, F.lit(1))

    small_edges = prof.small(edges)
    by = [*DATASET, "band"]
    banded = (
        sold.where(F.col("metric_size").isNotNull())
        .join(small_edges, DATASET)
        .withColumn("band", place(F.col("metric_size")))
        .drop("bounds", "bands", "n_sized")
    )
    found = aggregate(
        banded, by,
        [F.count(F.lit(1)).alias("count"), F.avg("ppsf").alias("avg_ppsf")],
        {
            "median_ppsf": (F.col("ppsf"), 0.5),
            "median_size": (F.col("metric_size"), 0.5),
            "median_price": (F.col("sold_price"), 0.5),
        },
    )
    held = (
        subject_brackets(dims.df, prof)
        .join(small_edges, DATASET)
        .withColumn("band", place(F.col("subject_size")))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_held"))
    )
    low, high = F.get("bounds", F.col("band")), F.get("bounds", F.col("band") + 1)
    return (
        found.join(small_edges, DATASET)
        .join(held, by, "left")
        .select(
            *by,
            F.concat(grouped(low), F.lit("-"), grouped(high), F.lit(" sqft")).alias("label"),
            low.alias("low"), high.alias("high"), "count", "median_ppsf", "avg_ppsf",
            "median_size", "median_price",
            F.coalesce("_held", F.lit(0)).alias("subjects_in_band"),
        )
    )


def size_trend(bands: DataFrame) -> DataFrame:
    """Smallest band's rate against the largest's, in percent; NULL when it cannot be read."""
    rate = F.col("median_ppsf")
    rated = F.col("median_ppsf").isNotNull()
    out = bands.groupBy(*DATASET).agg(
        F.count(rate).alias("rated_bands"),
        F.min_by(rate, F.when(rated, F.col("band"))).alias("smallest"),
        F.max_by(rate, F.when(rated, F.col("band"))).alias("largest"),
    )
    pct = F.try_divide(F.col("smallest") - F.col("largest"), rates.nonzero(F.col("largest"))) * 100.0
    return out.withColumn("trend_pct", F.when(F.col("rated_bands") >= 2, pct))


def without_size(sold: DataFrame, by: list[str] = DATASET) -> DataFrame:
    return sold.groupBy(*by).agg(F.count_if(F.col("metric_size").isNull()).alias("without_size"))

