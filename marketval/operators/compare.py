"""Run-over-run comparison: which rows came, went or changed between two runs.

Both sides carry the pair's key columns (`by`), addr_key_unit, address and row_ord. A key's
last row stands for it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.functions import rates
from marketval.functions.text import grouped
from marketval.operators.ranking import first_per_group

KEY = "addr_key_unit"
PAIR = ["market", "profile", "run_at"]


def seen(by: list[str], **sides: DataFrame) -> DataFrame:
    """One row per key that any side has: for each side, its last row as (address, price), else NULL.

    The sides are stacked as narrow rows and reduced together, copies before the shuffle, so the
    keys move once whatever is asked of them. A missing address is one key, like any other.
    """
    stacked = None
    for name, rows in sides.items():
        price = F.col("list_price") if "list_price" in rows.columns else F.lit(None)
        narrow = rows.select(
            *by, KEY, F.lit(name).alias("_side"), "row_ord",
            F.struct("address", price.cast("double").alias("price")).alias("_row"),
        )
        stacked = narrow if stacked is None else stacked.unionByName(narrow)
    last = [
        F.max_by("_row", F.when(F.col("_side") == name, F.col("row_ord"))).alias(name) for name in sides
    ]
    return stacked.groupBy(*by, KEY).agg(*last)


# Category: (which keys are in it, the side that names the address)
CATEGORIES = {
    "new_sale": ("prior_sold IS NULL AND current_sold IS NOT NULL", "current_sold"),
    "newly_closed": (
        "prior_sold IS NULL AND current_sold IS NOT NULL AND prior_active IS NOT NULL", "current_sold"
    ),
    "new_active": ("prior_active IS NULL AND current_active IS NOT NULL", "current_active"),
    "gone": ("prior_active IS NOT NULL AND current_active IS NULL AND current_sold IS NULL", "prior_active"),
    "price_cut": (
        "prior_active.price <> 0 AND current_active.price <> 0 AND current_active.price < prior_active.price",
        "current_active",
    ),
}


def _asks() -> tuple[Column, Column]:
    return F.col("prior_active.price"), F.col("current_active.price")


def _only(category: str, by: list[str], **sides: DataFrame) -> DataFrame:
    belongs, row = CATEGORIES[category]
    return seen(by, **sides).where(belongs).withColumn("address", F.col(f"{row}.address"))


def new_sales(prior_sold: DataFrame, current_sold: DataFrame, by: list[str] = PAIR) -> DataFrame:
    rows = _only("new_sale", by, prior_sold=prior_sold, current_sold=current_sold)
    return rows.select(*by, KEY, "address")


def newly_closed(
    prior_sold: DataFrame, prior_active: DataFrame, current_sold: DataFrame, by: list[str] = PAIR
) -> DataFrame:
    rows = _only(
        "newly_closed", by, prior_sold=prior_sold, prior_active=prior_active, current_sold=current_sold
    )
    return rows.select(*by, KEY, "address")


def new_active(prior_active: DataFrame, current_active: DataFrame, by: list[str] = PAIR) -> DataFrame:
    rows = _only("new_active", by, prior_active=prior_active, current_active=current_active)
    return rows.select(*by, KEY, "address")


def gone_from_active(
    prior_active: DataFrame,
    current_active: DataFrame,
    current_sold: DataFrame,
    by: list[str] = PAIR,
) -> DataFrame:
    rows = _only(
        "gone", by, prior_active=prior_active, current_active=current_active, current_sold=current_sold
    )
    return rows.select(*by, KEY, "address")


def price_cuts(prior_active: DataFrame, current_active: DataFrame, by: list[str] = PAIR) -> DataFrame:
    """Listings in both runs whose ask fell."""
    before, after = _asks()
    rows = _only("price_cut", by, prior_active=prior_active, current_active=current_active)
    return rows.select(
        *by, KEY, "address", before.alias("before"), after.alias("after"), (after - before).alias("change")
    )


def changes(
    prior_sold: DataFrame,
    prior_active: DataFrame,
    current_sold: DataFrame,
    current_active: DataFrame,
    by: list[str] = PAIR,
) -> DataFrame:
    """All five categories as rows (by, category, address, before, after), from one pass."""
    keys = seen(by, prior_sold=prior_sold, prior_active=prior_active,
                current_sold=current_sold, current_active=current_active)

    before, after = _asks()

    def item(name: str) -> Column:
        belongs, row = CATEGORIES[name]
        cut = F.lit(name == "price_cut")
        return F.when(F.expr(belongs), F.struct(
            F.lit(name).alias("category"), F.col(f"{row}.address").alias("address"),
            F.when(cut, before).alias("before"), F.when(cut, after).alias("after"),
        ))

    items = F.array_compact(F.array(*[item(name) for name in CATEGORIES]))
    return keys.select(*by, F.inline(items))


def deltas(before: DataFrame, after: DataFrame, on: list[str], figures: dict[str, str]) -> DataFrame:
    """Rows (on, label, before, after, change, pct_change) for {label: column}."""

    def long(rows: DataFrame, name: str) -> DataFrame:
        items = F.array(
            *[
                F.struct(F.lit(lab).alias("label"), F.col(c).cast("double").alias(name))
                for lab, c in figures.items()
            ]
        )
        return rows.select(*on, F.explode(items).alias("_i")).select(*on, "_i.*")

    b, a = F.col("before"), F.col("after")
    return (
        long(before, "before").join(long(after, "after"), [*on, "label"], "full_outer")
        .withColumn("change", a - b)
        .withColumn("pct_change", F.try_divide(a - b, rates.nonzero(b)))
    )


def first_names(
    rows: DataFrame, by: list[str], name: str, limit: int = 8, order: Column | None = None,
    separator: str = ", ", counted: bool = True,
) -> DataFrame:
    """Per group the count and the first names joined, if `counted` with '(+n more)' when there are more.

    Only `limit` rows of a group are ever brought together.
    """
    sort = [F.col(name)] if order is None else [order, F.col(name)]
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    shown = (
        first_per_group(rows, by, limit, sort)
        .groupBy(*by)
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_at", name))), lambda s: s[name]),
                separator,
            ).alias("_shown")
        )
    )
    more = F.concat(F.lit(" (+"), (F.col("n") - limit).cast("string"), F.lit(" more)"))
    return total.join(shown, by).select(
        *by, "n",
        F.concat("_shown", F.when(F.lit(counted) & (F.col("n") > limit), more).otherwise("")).alias("detail"),
    )


def delta_text(before: Column, after: Column, pct: Column) -> Column:
    """'100.00 to 110.00 (+10.0%)', or the dash when a side is missing."""
    sign = F.when(after - before >= 0, "+").otherwise("")
    share = F.when(
        pct.isNotNull(),
        F.concat(F.lit(" ("), sign, F.format_number(pct * 100, 1), F.lit("%)")),
    ).otherwise("")
    return F.when(before.isNull() | after.isNull(), F.lit("—")).otherwise(
        F.concat(grouped(before, 2), F.lit(" to "), grouped(after, 2), share)
    )
