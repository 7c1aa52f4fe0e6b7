"""Report tables: comp sheets, the summary, guidance, agents, changes, and their orders."""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.constants import NOT_FOUND
from marketval.functions.text import grouped, text_safe
from marketval.operators.compare import delta_text, first_names
from marketval.operators.guidance import expected_text
from marketval.operators.sizing import DATASET, Dim, as_dim
from marketval.operators.valuation import SUBJECT, subject_brackets

ATTRIBUTE_COLUMNS = ["beds", "baths", "year_built", "condition"]


def sheet_columns(metric: str, attributes: list[str], sold: bool) -> list[str]:
    """Columns of a comp sheet for one profile; living-area profiles keep the lot as a second size."""
    middle = ["metric_size", "ppsf", *[a for a in attributes if a in ATTRIBUTE_COLUMNS]]
    if metric == "living_sqft":
        middle.append("lot_sqft")
    if not sold:
        return ["address", "list_price", *middle, "brokerage", "agent", "area"]
    return [
        "address", "sold_date", "sold_price", *middle, "brokerage", "agent", "final_list_price",
        "original_list_price", "ratio", "area", "bracket_ppsf",
    ]


def sold_sheet(
    sold: DataFrame, subjects: Dim | DataFrame, profiles: Dim | DataFrame,
    attributes: list[str] = ATTRIBUTE_COLUMNS,
) -> DataFrame:
    """Sold rows with their rate inside the dataset's first subject's bracket beside them.

    Every column any of the profiles shows; those a profile does not show are NULL.
    """
    dims, prof = as_dim(subjects), as_dim(profiles)
    bounds = subject_brackets(dims.df, prof).groupBy(*DATASET).agg(
        F.min_by(F.struct("attribute", "bracket_low", "bracket_high"), F.col("subject_id")).alias("_b")
    )
    shown = prof.small(prof.df.select(*DATASET, "metric", F.col("attributes").alias("_shown")))
    size = F.when(F.col("_b.attribute") == "living_sqft", F.col("living_sqft")).otherwise(F.col("lot_sqft"))
    inside = size.between(F.col("_b.bracket_low"), F.col("_b.bracket_high"))
    extra = [
        F.when(F.array_contains("_shown", a), F.col(a)).alias(a) for a in attributes
    ]
    return sold.join(shown, DATASET).join(prof.small(bounds), DATASET, "left").select(
        *DATASET, "row_ord", "address", "sold_date", "sold_price", "metric_size", "ppsf", *extra,
        F.when(F.col("metric") == "living_sqft", F.col("lot_sqft")).alias("second_size"),
        "brokerage", "agent", "final_list_price", "original_list_price", "ratio", "area",
        F.when(inside, F.col("ppsf")).alias("bracket_ppsf"),
    )


def active_sheet(active: DataFrame) -> DataFrame:
    return active.select(
        *DATASET, "row_ord", "address", "list_price", "metric_size", "ppsf", "brokerage", "agent", "area"
    )


def for_export(rows: DataFrame) -> DataFrame:
    """Text columns made safe for a spreadsheet that reads a leading = + - @ as a formula."""
    return rows.select(
        *[text_safe(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes]
    )


def write_csv(rows: DataFrame, path: str) -> None:
    for_export(rows).write.mode("overwrite").option("header", True).csv(path)


STAT_ROWS = [
    ("count", "Number of properties"), ("avg_ppsf", "Average $/sq ft"),
    ("median_ppsf", "Median $/sq ft"), ("avg_price", "Average price"),
    ("median_price", "Median price"), ("avg_size", "Average size"),
    ("min_ppsf", "Min $/sq ft"), ("max_ppsf", "Max $/sq ft"),
]
CORE_ROWS = [
    ("core_count", "Properties inside the bounds"), ("core_avg_ppsf", "Core average $/sq ft"),
    ("core_median_ppsf", "Core median $/sq ft"),
]
RATIO_ROWS = [
    ("mean_ratio", "Average sold-to-ask ratio"), ("share_at_or_above_ask", "Sold at or above final ask"),
]


BRACKET_FIGURES = {
    "subject_size": "Size", "bracket_low": "Similar-size bracket low", "bracket_high": "Similar-size bracket high",
    "bracket_count": "Comps in bracket", "ppsf": "Bracket median $/sq ft",
}
LADDER_FIGURES = ["count", "median_ppsf", "avg_ppsf", "value_from_median", "value_from_avg"]
BAND_FIGURES = ["count", "median_ppsf", "avg_ppsf", "median_size", "median_price"]
# Figure of an area: its column among sales and among listings.
AREA_FIGURES = {
    "count": ("sold_count", "active_count"), "avg_ppsf": ("sold_avg_ppsf", "active_avg_ppsf"),
    "median_ppsf": ("sold_median_ppsf", None), "median_price": ("sold_median_price", None),
    "avg_size": ("sold_avg_size", None),
}


def _figures(
    rows: DataFrame, section: str, at: list[str], figures: dict[str, tuple[Column | str, str, str | None]]
) -> DataFrame:
    """Summary rows of a table: {figure: (label, column among sales, column among listings)}, keyed
    by the row's `at` and the figure."""
    number = lambda c: (F.lit(None) if c is None else F.col(c)).cast("double")
    items = [
        F.struct(
            F.concat_ws(":", *[F.col(c).cast("string") for c in at], F.lit(figure)).alias("key"),
            (F.lit(label) if isinstance(label, str) else label).alias("label"),
            number(sold).alias("sold"), number(active).alias("active"),
        )
        for figure, (label, sold, active) in figures.items()
    ]
    return rows.select(*DATASET, F.lit(section).alias("section"), F.inline(F.array(*items)))


def bracket_block(valued: DataFrame) -> DataFrame:
    """Each subject's size, the bracket round it, the sales in there and their median rate."""
    figures = {k: (label, k, None) for k, label in BRACKET_FIGURES.items()}
    return _figures(valued.where("is_primary"), "bracket", ["subject_id"], figures)


def ladder_block(ladder: DataFrame) -> DataFrame:
    figures = {k: (F.col("label"), k, None) for k in LADDER_FIGURES}
    return _figures(ladder, "ladder", ["subject_id", "position"], figures)


def band_block(bands: DataFrame) -> DataFrame:
    """The size bands; one that holds a subject says so."""
    mark = F.when(F.col("subjects_in_band") > 0, "  <- your property").otherwise("")
    figures = {k: (F.concat("label", mark), k, None) for k in BAND_FIGURES}
    return _figures(bands, "bands", ["band"], figures)


def area_block(areas: DataFrame) -> DataFrame:
    figures = {k: (F.col("area"), *columns) for k, columns in AREA_FIGURES.items()}
    return _figures(areas, "areas", ["position"], figures)


def summary(
    sold_stats: DataFrame, active_stats: DataFrame, ratios: DataFrame, valued: DataFrame,
    ladder: DataFrame | None = None, bands: DataFrame | None = None, areas: DataFrame | None = None,
) -> DataFrame:
    """Long rows (market, profile, section, key, label, sold, active); one section per block.

    The last three tables add their sections where they are given; an empty one adds no rows.
    """

    def long(rows: DataFrame, section: str, items: list[tuple[str, str]], name: str) -> DataFrame:
        stack = F.array(
            *[
                F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"),
                         F.lit(lab).alias("label"), F.col(k).cast("double").alias(name))
                for k, lab in items
            ]
        )
        return rows.select(*DATASET, F.explode(stack).alias("_i")).select(*DATASET, "_i.*")

    on = [*DATASET, "section", "key", "label"]
    both = None
    for section, items in (("stats", STAT_ROWS), ("core", CORE_ROWS)):
        part = long(sold_stats, section, items, "sold").join(
            long(active_stats, section, items, "active"), on, "full_outer"
        )
        both = part if both is None else both.unionByName(part)
    none = F.lit(None).cast("double")
    ratio = long(ratios, "stats", RATIO_ROWS, "sold").withColumn("active", none)
    value = valued.select(
        *DATASET, F.lit("value").alias("section"),
        F.concat(F.col("subject_id").cast("string"), F.lit(":"), "basis").alias("key"),
        F.col("basis").alias("label"), F.col("value").alias("sold"), none.alias("active"),
    )
    out = both.unionByName(ratio).unionByName(value).unionByName(bracket_block(valued))
    for block, rows in ((ladder_block, ladder), (band_block, bands), (area_block, areas)):
        if rows is not None:
            out = out.unionByName(block(rows))
    return out


def guidance_report(guided: DataFrame) -> DataFrame:
    """One row per strategy with its expected range as text."""
    return guided.select(
        *SUBJECT, "position", "label", "list_price",
        expected_text(F.col("expected_low"), F.col("expected_high")).alias("expected_range"),
        "recommended", "floor",
    )


def agents_report(agents: DataFrame) -> DataFrame:
    dual = F.when(F.col("dual_agency"), " - dual agency").otherwise("")
    return agents.select(
        *DATASET, "interview_rank", text_safe(F.col("agent")).alias("agent"),
        text_safe(F.coalesce("brokerage", F.lit(NOT_FOUND))).alias("brokerage"),
        "closings", "avg_sold_to_ask", "avg_ppsf", "avg_size",
        F.concat("flag", dual).alias("pattern"),
    )


def brokerages_report(brokerages: DataFrame) -> DataFrame:
    return brokerages.select(*DATASET, text_safe(F.col("family")).alias("family"), "closings", "share")


CHANGE_LABELS = {
    "new_sale": "New sales", "newly_closed": "Listings that closed", "new_active": "New listings",
    "gone": "Listings withdrawn", "price_cut": "Price cuts",
}
NAMED_CHANGES = ["new_sale", "newly_closed", "new_active"]


def change_report(changes: DataFrame, deltas: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, section, label, n, detail) for each of `pairs` (by, prior_label), changed or not.

    Section `rows` names the earlier run, the first addresses of three categories ("none" where there
    are none) and the first price cuts, if any; `counts` counts all five; `figures` has the deltas.
    """
    names = first_names(changes.where(F.col("category").isin(NAMED_CHANGES)), [*by, "category"], "address")
    totals = changes.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n"))

    def slots(categories: list[str], section: str) -> DataFrame:
        each = [F.struct(F.lit(c).alias("category"), F.lit(CHANGE_LABELS[c]).alias("label")) for c in categories]
        return pairs.select(*by, F.lit(section).alias("section"), F.inline(F.array(*each)))

    def shaped(rows: DataFrame, n: Column, detail: Column) -> DataFrame:
        return rows.select(*by, "section", "label", n.cast("long").alias("n"), detail.cast("string").alias("detail"))

    none = F.lit(None)
    prior = pairs.withColumn("section", F.lit("rows")).withColumn("label", F.lit("Compared with"))
    compared = shaped(prior, none, F.coalesce(F.nullif("prior_label", F.lit("")), F.lit("—")))
    listed = shaped(
        slots(NAMED_CHANGES, "rows").join(names, [*by, "category"], "left"),
        F.coalesce("n", F.lit(0)), F.coalesce("detail", F.lit("none")),
    )
    counted = shaped(
        slots(list(CHANGE_LABELS), "counts").join(totals, [*by, "category"], "left"),
        F.coalesce("n", F.lit(0)), none,
    )
    cut = changes.where("category = 'price_cut'").withColumn(
        "_text",
        F.concat("address", F.lit(" $"), grouped(F.col("before")), F.lit(" to $"),
                 grouped(F.col("after"))),
    )
    shown = first_names(cut, by, "_text", order=F.col("after") - F.col("before"), separator="; ", counted=False)
    title = shown.withColumn("section", F.lit("rows")).withColumn("label", F.lit(CHANGE_LABELS["price_cut"]))
    cuts = shaped(title, F.col("n"), F.col("detail"))
    figures = shaped(
        deltas.withColumn("section", F.lit("figures")), none,
        delta_text(F.col("before"), F.col("after"), F.col("pct_change")),
    )
    return compared.unionByName(listed).unionByName(counted).unionByName(cuts).unionByName(figures)


def comp_rows(sold: DataFrame) -> DataFrame:
    """The sold side as shown."""
    return sold.select(
        *DATASET, "row_ord", "address", "sold_date", "sold_price", "lot_sqft", "brokerage", "agent",
        "final_list_price", "area",
    )


def active_rows(active: DataFrame) -> DataFrame:
    """The asking side as shown; kept apart, since an ask is a claim and a sale is a fact."""
    return active.select(
        *DATASET, "row_ord", "address", "list_price", "lot_sqft", "lot_size_is_rounded",
        "brokerage", "agent", "area",
    )


def core_figures(sold_stats: DataFrame, active_stats: DataFrame, profiles: Dim | DataFrame) -> DataFrame:
    """The market with extreme rates set aside; no row where a profile sets no bounds."""
    low, high = F.col("exclusions.core_min_ppsf"), F.col("exclusions.core_max_ppsf")
    bounds = as_dim(profiles).df.select(*DATASET, low.alias("low"), high.alias("high"))
    s = sold_stats.select(
        *DATASET, F.col("count").alias("sold_total"), F.col("core_count").alias("sold_count"),
        F.col("core_median_ppsf").alias("sold_median_ppsf"), F.col("core_avg_ppsf").alias("sold_avg_ppsf"),
    )
    a = active_stats.select(
        *DATASET, F.col("count").alias("active_total"), F.col("core_count").alias("active_count"),
        F.col("core_median_ppsf").alias("active_median_ppsf"),
    )
    return (
        bounds.where(F.col("low").isNotNull() | F.col("high").isNotNull())
        .join(s, DATASET).join(a, DATASET, "left")
    )


def headline(
    sold_stats: DataFrame, active_stats: DataFrame, valued: DataFrame, guided: DataFrame
) -> DataFrame:
    """The few numbers that answer what a subject is worth."""
    primary = valued.where("is_primary").select(
        *SUBJECT, F.col("value").alias("valuation"), F.col("sample_size").alias("bracket_count")
    )
    prices = guided.groupBy(*SUBJECT).agg(
        F.max(F.when(F.col("recommended"), F.col("list_price"))).alias("suggested_list"),
        F.max(F.when(F.col("strategy") == "at_market", F.col("list_price"))).alias("at_market"),
        F.max("floor").alias("floor"),
    )
    s = sold_stats.select(*DATASET, F.col("count").alias("sold_count"), "median_ppsf")
    a = active_stats.select(*DATASET, F.col("count").alias("active_count"))
    return (
        primary.join(s, DATASET, "left").join(a, DATASET, "left").join(prices, SUBJECT, "left")
        .withColumn("active_count", F.coalesce("active_count", F.lit(0)))
    )


def _order(rows: DataFrame, column: str, descending: bool) -> Column:
    c = F.col(column)
    key = F.lower(c) if dict(rows.dtypes)[column] == "string" else c
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


def sorted_comps(
    rows: DataFrame, column: str = "sold_date", descending: bool = True, tie: str = "row_ord"
) -> DataFrame:
    """Comps by any column, texts without regard to case, rows without it last either way."""
    return rows.orderBy(_order(rows, column, descending), tie)


def sorted_agents(rows: DataFrame, column: str | None = None, descending: bool = True) -> DataFrame:
    """Agents by any column, then by interview rank; without a column by that rank alone."""
    chosen = [] if column is None else [_order(rows, column, descending)]
    return rows.orderBy(*chosen, "interview_rank")


def price_cut_order(cuts: DataFrame) -> DataFrame:
    """Deepest cut first."""
    return cuts.orderBy(F.col("after") - F.col("before"), "address")
