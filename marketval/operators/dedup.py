"""One sale, one row: the order-dependent merge of rows that share an address key.

Rows of a key are walked in input order. A row joins the earliest kept sale it is the same
sale as, and takes its place only when it is strictly more complete; otherwise it is kept as
a distinct sale. The match is not transitive and a kept row may be replaced, so this is a
fold, not a ranking.

Keys are walked in order as sorted streams. What is held is the kept sales of a key, found by price
and size. A key of many rows is split first, so that no walk takes it whole; the walk is the same:

* Prices further apart than the tolerance cut a key where no price lies between, and so do
  sizes. Rows on two sides of a cut never match, so each part is a walk of its own. A row
  without a price matches all prices of its size, so it holds the parts of its size together;
  likewise without a size. A key with rows of both kinds stays whole.
* Where all known figures of a part match each other, every row joins the first one, and the
  fullest row, the earliest of those, takes its place. That is an aggregate; copies of one sale,
  however many, end here.
"""

from bisect import bisect_left, insort
from math import floor, inf, isfinite, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketval.constants import SAME_PRICE_TOLERANCE, SAME_SIZE_TOLERANCE
from marketval.functions.rates import close, completeness
from marketval.operators.sizing import DATASET, Dim, written
from marketval.shipping import ship

#: Keys of more rows are split. Fates do not depend on it.
SPLIT_ROWS = 10_000

#: So many kept sales are looked through one by one.
FEW = 24

#: Kinds of a figure; only figures of one kind can match, apart from a missing one.
MISSING, POSITIVE, NEGATIVE, ZERO, INFINITE, NEGATIVE_INFINITE, NOT_A_NUMBER = range(7)


def row_completeness() -> Column:
    """How many of the fields the analysis needs a sold row carries."""
    names = ["lot_sqft", "living_sqft", "brokerage", "agent", "final_list_price", "sold_date", "lat"]
    return completeness([F.col(n) for n in names])


def step(tolerance: float) -> float:
    """Logarithms of two figures that match differ by no more, rounding included."""
    return -log(1 - tolerance) * (1 + 1e-9)


def kind(x: Column) -> Column:
    return (
        F.when(x.isNull(), MISSING).when(F.isnan(x), NOT_A_NUMBER).when(x == float("inf"), INFINITE)
        .when(x == float("-inf"), NEGATIVE_INFINITE).when(x > 0, POSITIVE).when(x < 0, NEGATIVE)
        .otherwise(ZERO)
    )


def cell(x: Column, tolerance: float) -> Column:
    """Figures that match lie in one cell or in neighbouring ones, whose numbers follow."""
    return F.when(
        kind(x).isin(POSITIVE, NEGATIVE), F.floor(F.log(F.abs(x)) / F.lit(step(tolerance)))
    ).otherwise(F.lit(0)).cast("long")


def _all_match(low: str, high: str, tolerance: float) -> Column:
    """Whether all known figures match each other, from the least and the greatest."""
    return F.coalesce(close(F.col(low), F.col(high), tolerance), F.lit(True))


_SUMMARY = ["_low_price", "_high_price", "_low_size", "_high_size", "_first", "_best"]


def _summary() -> list[Column]:
    # The fullest row, the earliest of those; scores are small.
    best = F.min(F.struct((-F.col("_score")).alias("score"), F.col("_ord").alias("at")))
    return [
        F.min("_price").alias("_low_price"), F.max("_price").alias("_high_price"),
        F.min("_size").alias("_low_size"), F.max("_size").alias("_high_size"),
        F.min("_ord").alias("_first"), best.alias("_best"),
    ]


def _merged() -> list[Column]:
    lowest, greatest = F.min, F.max
    return [
        (greatest if "high" in c else lowest)(c).alias(c) for c in _SUMMARY
    ]


def _is_one_sale() -> Column:
    return _all_match("_low_price", "_high_price", SAME_PRICE_TOLERANCE) & _all_match(
        "_low_size", "_high_size", SAME_SIZE_TOLERANCE
    )


def _runs(rows: DataFrame, key: list[str], figure: str, tolerance: float) -> DataFrame:
    """Which run each occupied cell of a key belongs to; runs are further apart than the tolerance.

    Cells come from an aggregate. A key has as many as its range of figures has steps, whatever
    the number of its rows.
    """
    name = figure.strip("_")
    x, by = F.abs(F.col(figure)), [*key, f"_{name}_kind"]
    cells = (
        rows.where(F.col(figure).isNotNull()).groupBy(*by, f"_{name}_cell")
        .agg(F.min(x).alias("low"), F.max(x).alias("high"))
    )
    in_order = W.partitionBy(*by).orderBy(f"_{name}_cell")
    joined = (F.col(f"_{name}_cell") - F.lag(f"_{name}_cell").over(in_order) <= 1) & close(
        F.lag("high").over(in_order), F.col("low"), tolerance
    )
    cut = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    return cells.withColumn("_cut", cut).select(
        *by, f"_{name}_cell",
        (F.col(f"_{name}_kind") * F.lit(1 << 40) + F.sum("_cut").over(in_order)).alias(f"_{name}_run"),
    )


def _parts(rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows` with the summary of the part they are walked in."""
    placed = rows.select(
        "*",
        kind(F.col("_price")).alias("_price_kind"), cell(F.col("_price"), SAME_PRICE_TOLERANCE).alias("_price_cell"),
        kind(F.col("_size")).alias("_size_kind"), cell(F.col("_size"), SAME_SIZE_TOLERANCE).alias("_size_cell"),
    )
    for figure, tolerance in (("_price", SAME_PRICE_TOLERANCE), ("_size", SAME_SIZE_TOLERANCE)):
        runs = _runs(placed, key, figure, tolerance)
        on = [*key, f"{figure}_kind", f"{figure}_cell"]
        placed = placed.join(runs, on, "left").drop(f"{figure}_kind", f"{figure}_cell").fillna({f"{figure}_run": 0})
    placed = written(placed)
    run = ["_price_run", "_size_run"]
    cells = written(placed.groupBy(*key, *run).agg(*_summary()))
    no_price, no_size = F.col("_price_run") == 0, F.col("_size_run") == 0
    mixed = cells.groupBy(*key).agg((F.max(no_price) & F.max(no_size)).alias("_whole"))
    flags = cells.join(mixed, key)
    holds_prices = F.max(no_price).over(W.partitionBy(*key, "_size_run"))
    holds_sizes = F.max(no_size).over(W.partitionBy(*key, "_price_run"))
    part = {
        "_price_part": F.when(F.col("_whole") | F.col("_holds_prices"), 0).otherwise(F.col("_price_run")),
        "_size_part": F.when(F.col("_whole") | F.col("_holds_sizes"), 0).otherwise(F.col("_size_run")),
    }
    parted = written(
        flags.withColumn("_holds_prices", holds_prices).withColumn("_holds_sizes", holds_sizes).withColumns(part)
    )
    summaries = parted.groupBy(*key, *part).agg(*_merged())
    of_cell = parted.select(*key, *run, *part).join(summaries, [*key, *part]).drop(*part)
    return placed.join(of_cell, [*key, *run]).drop(*run)


class Kept:
    """Kept sales of one walk, found by the cells of their figures."""

    def __init__(self) -> None:
        self.slots: list[list] = []  # opened by, row, price, size, score
        self.places: dict[tuple, list[int]] | None = None  # once there are more than a few

    @staticmethod
    def place(x: float | None, tolerance: float) -> tuple[int, int]:
        if x is None:
            return MISSING, 0
        if x != x:
            return NOT_A_NUMBER, 0
        if not isfinite(x):
            return (INFINITE if x > 0 else NEGATIVE_INFINITE), 0
        if x == 0:
            return ZERO, 0
        return (POSITIVE if x > 0 else NEGATIVE), floor(log(abs(x)) / step(tolerance))

    @classmethod
    def keys(cls, price: float | None, size: float | None) -> list[tuple]:
        """Where a sale is filed: by both figures, by size alone, by price alone, and among all."""
        p, s = cls.place(price, SAME_PRICE_TOLERANCE), cls.place(size, SAME_SIZE_TOLERANCE)
        return [(p, s), (None, s), (p, None), (None, None)]

    @staticmethod
    def around(place: tuple[int, int], known: bool) -> list:
        """Places of sales that may match, a sale without the figure among them; None for all."""
        if not known:
            return [None]
        of, at = place
        near = [(of, at - 1), place, (of, at + 1)] if of in (POSITIVE, NEGATIVE) else [place]
        return [*near, (MISSING, 0)]

    @staticmethod
    def near(a: float | None, b: float | None, tolerance: float) -> bool:
        """`rates.close`, with True where a figure is missing: it contradicts nothing."""
        if a is None or b is None or a == b:
            return True
        if a != a or b != b:
            return a != a and b != b
        return abs(a - b) / max(abs(a), abs(b)) <= tolerance

    def twin(self, price: float | None, size: float | None) -> int | None:
        """The earliest sale that a row matches."""
        if self.places is None:
            # `near` for the common case, written out: nearly all pairs of rows at an address come here.
            for k, (_, _, p, s, _) in enumerate(self.slots):
                if p is not None and price is not None and p != price:
                    if 0 < p < price < inf:
                        if (price - p) / price > SAME_PRICE_TOLERANCE:
                            continue
                    elif 0 < price < p < inf:
                        if (p - price) / p > SAME_PRICE_TOLERANCE:
                            continue
                    elif not self.near(p, price, SAME_PRICE_TOLERANCE):
                        continue
                if self.near(s, size, SAME_SIZE_TOLERANCE):
                    return k
            return None
        (p, s), *_ = self.keys(price, size)
        best = None
        for x in self.around(p, price is not None):
            for y in self.around(s, size is not None):
                for k in self.places.get((x, y), ()):
                    if best is not None and k >= best:
                        break
                    slot = self.slots[k]
                    if self.near(slot[2], price, SAME_PRICE_TOLERANCE) and self.near(slot[3], size, SAME_SIZE_TOLERANCE):
                        best = k
                        break
        return best

    def add(self, at: int, price: float | None, size: float | None, score: int) -> tuple[int, bool]:
        """The row that opened the row's sale, and whether the row joined one that was there."""
        k = self.twin(price, size)
        if k is None:
            k = len(self.slots)
            self.slots.append([at, at, price, size, score])
        elif score > self.slots[k][4]:
            for key in self.keys(*self.slots[k][2:4]) if self.places is not None else ():
                of = self.places[key]
                of.pop(bisect_left(of, k))
            self.slots[k][1:] = [at, price, size, score]
        else:
            return self.slots[k][0], True
        if self.places is not None:
            self.file(k)
        elif len(self.slots) > FEW:
            self.places = {}
            for each in range(len(self.slots)):
                self.file(each)
        return self.slots[k][0], self.slots[k][0] != at

    def file(self, k: int) -> None:
        for key in self.keys(*self.slots[k][2:4]):
            insort(self.places.setdefault(key, []), k)


def _walked(rows: DataFrame, group: list[str]) -> DataFrame:
    """Fates of rows, walked group by group in order, as sorted streams.

    A row's fate is sent when its group ends or more than `SPLIT_ROWS` rows are held. A row that was
    sent before and stays in the end is sent once more, with `is_kept` alone.
    """
    ship(rows.sparkSession)
    figures = ["_ord", "_price", "_size", "_score"]
    names = [*DATASET, "_ord", "slot_ord", "is_duplicate", "is_kept", "_first"]

    def walk(batches):
        now, kept, first, held, ready = None, Kept(), 0, [], []

        def close_group() -> None:
            stays = {s[1]: s[0] for s in kept.slots}
            for at, slot, joined in held:
                ready.append((*now[:2], at, slot, joined, stays.pop(at, None) is not None, first))
            ready.extend((*now[:2], at, None, None, True, None) for at in stays)
            held.clear()

        def sent():
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*ready), types)], names=names)
            ready.clear()
            return made

        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in group]))
            for key, row in zip(keys, zip(*[b.column(c).to_pylist() for c in figures])):
                if key != now:
                    if now is not None:
                        close_group()
                    now, kept, first = key, Kept(), row[0]
                held.append((row[0], *kept.add(*row)))
                if len(held) > SPLIT_ROWS:  # of a split key: others end before
                    ready.extend((*now[:2], *x, False, first) for x in held)
                    held.clear()
                if len(ready) >= SPLIT_ROWS:
                    yield sent()
        if now is not None:
            close_group()
        if ready:
            yield sent()

    in_order = rows.select(*group, *figures).repartition(*group).sortWithinPartitions(*group, "_ord")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in DATASET)
    return in_order.mapInArrow(walk, f"{schema}, _ord long, slot_ord long, is_duplicate boolean, is_kept boolean, _first long")


def _split_fates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Fates under keys of many rows: split, closed by an aggregate where that is enough, else walked."""
    parts = written(_parts(rows, key))
    closed = parts.where(_is_one_sale()).select(
        *DATASET, "_ord", F.col("_first").alias("slot_ord"), (F.col("_ord") != F.col("_first")).alias("is_duplicate"),
        (F.col("_ord") == F.col("_best.at")).alias("is_kept"), "grp_ord",
    )
    open_ = parts.where(~_is_one_sale())
    said = ["slot_ord", "is_duplicate", "is_kept"]
    walked = _walked(open_, [*DATASET, "_first"]).groupBy(*DATASET, "_ord").agg(*[F.max(c).alias(c) for c in said])
    return closed.unionByName(walked.join(open_.select(*DATASET, "_ord", "grp_ord"), [*DATASET, "_ord"]))


def resolve_sales(sold: DataFrame, key: str = "addr_key") -> DataFrame:
    """All sold rows with their fate: slot_ord, is_duplicate, is_kept, and grp_ord.

    `slot_ord` is the row that opened the sale, `grp_ord` the first row of the address key;
    (grp_ord, slot_ord) is the order in which kept sales are listed. Only narrow columns are
    grouped; whole rows are shuffled once, by row_ord, so a hot key spreads evenly.
    """
    keys = [*DATASET, "_key"]
    slim = written(sold.select(
        *DATASET, F.coalesce(F.col(key), F.lit("")).alias("_key"), F.col("row_ord").alias("_ord"),
        F.col("sold_price").cast("double").alias("_price"), F.col("lot_sqft").cast("double").alias("_size"),
        row_completeness().alias("_score"),
    ))
    counts = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_ord").alias("grp_ord"))
    hot = Dim(written(counts.where(F.col("_rows") > SPLIT_ROWS).drop("_rows")))
    if hot.df.isEmpty():
        fates = _walked(slim, keys).withColumnRenamed("_first", "grp_ord")
    else:
        rest = slim.join(hot.small(hot.df.select(*keys)), keys, "left_anti")
        fates = _walked(rest, keys).withColumnRenamed("_first", "grp_ord").unionByName(
            _split_fates(slim.join(hot.small(), keys), keys)
        )
    rows = sold.join(fates.withColumnRenamed("_ord", "row_ord"), [*DATASET, "row_ord"])
    return rows.select(*sold.columns, "grp_ord", "slot_ord", "is_duplicate", "is_kept")
