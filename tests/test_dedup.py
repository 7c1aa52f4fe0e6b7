import random

import pytest
from pyspark.sql import functions as F

import helpers as h
from marketval.operators import cleaning, dedup, measures


def resolved(spark, rows, **options):
    keyed = measures.with_keys(h.sold(spark, rows), h.profiles(spark))
    return dedup.resolve_sales(keyed, **options)


def kept(df):
    return sorted(r["row_ord"] for r in df.where("is_kept").collect())


def by_hand(rows):
    """The walk itself: (row, slot, joined, kept) for rows of one address in order."""
    def near(a, b, tol):
        return a is None or b is None or a == b or abs(a - b) / max(abs(a), abs(b)) <= tol

    slots, fates = [], []
    for i, (price, size, score) in enumerate(rows):
        twin = next((s for s in slots if near(s["p"], price, 0.005) and near(s["s"], size, 0.05)), None)
        if twin is None:
            slots.append({"slot": i, "o": i, "p": price, "s": size, "c": score})
        elif score > twin["c"]:
            twin.update(o=i, p=price, s=size, c=score)
        fates.append((i, i if twin is None else twin["slot"], twin is not None))
    final = {s["o"] for s in slots}
    return [(i, slot, joined, i in final) for i, slot, joined in fates]


def test_a_dollar_apart_keeps_the_fuller_row(spark):
    df = resolved(spark, [
        {"address": "125 W Thorn St", "sold_price": 500000, "lot_sqft": 6000},
        {"address": "125 W Thorn St #18", "sold_price": 500001, "lot_sqft": 6000, "agent": "A", "brokerage": "B"},
    ])
    assert kept(df) == [1]
    assert [r["row_ord"] for r in df.where("is_duplicate").collect()] == [1]


def test_two_parcels_at_one_address_are_both_kept_and_reported(spark):
    df = resolved(spark, [
        {"address": "0 Hill Rd", "sold_price": 400000, "lot_sqft": 170000},
        {"address": "0 Hill Rd", "sold_price": 750000, "lot_sqft": 223000},
    ])
    assert kept(df) == [0, 1]
    assert cleaning.shared_addresses(df).first()["note"] == "0 Hill Rd: 2 distinct sales share this address"


def test_rows_that_cannot_be_compared_collapse(spark):
    assert kept(resolved(spark, [{"address": "1 A St"}, {"address": "1 A St"}])) == [0]


def test_size_alone_separates_rows_without_a_price(spark):
    df = resolved(spark, [{"address": "1 A St", "lot_sqft": 5000}, {"address": "1 A St", "lot_sqft": 9000}])
    assert kept(df) == [0, 1]


def _random_rows(rng, n):
    prices = [None, 0.0, 100000.0, 100400.0, 100800.0, 101200.0, 300000.0, 301000.0, 302900.0]
    sizes = [None, 0.0, 5000.0, 5200.0, 5400.0, 5650.0, 9000.0]
    return [(rng.choice(prices), rng.choice(sizes), rng.randint(0, 4)) for _ in range(n)]


def _as_sold(group, rows):
    """Score is raised by fields that the fold does not read otherwise."""
    extra = [("brokerage", "b"), ("agent", "a"), ("final_list_price", 1), ("lat", 1)]
    return [
        {"address": f"{group} Elm St", "sold_price": p, "lot_sqft": s, **dict(extra[:score])}
        for p, s, score in rows
    ]


@pytest.mark.parametrize("partial, split", [(True, 10_000), (True, 4), (False, 4)])
def test_against_the_walk_in_any_partitioning(spark, partial, split, monkeypatch):
    """Chains of near figures, with and without rows that lack one; fates do not depend on splitting."""
    monkeypatch.setattr(dedup, "SPLIT_ROWS", split)
    rng = random.Random(11)
    groups = {g: _random_rows(rng, n) for g, n in enumerate([1, 2, 7, 20, 60, 150, 301, 3, 3, 4, 4, 5, 5, 6])}
    if not partial:
        groups = {g: [r for r in rows if None not in r[:2]] or [(1.0, 1.0, 0)] for g, rows in groups.items()}
    groups[90] = [(p, s, c) for p, s, c in _random_rows(rng, 80) if s is not None]  # prices are missing alone
    groups[91] = [(p, s, c) for p, s, c in _random_rows(rng, 80) if p is not None]  # sizes are missing alone
    groups[92] = [(-p if p else p, s, c) for p, s, c in _random_rows(rng, 60) if p is not None and s is not None]
    flat, want, at = [], {}, 0
    for g, rows in groups.items():
        sold_rows = _as_sold(g, rows)
        scored = [(p, s, score + (s is not None)) for p, s, score in rows]
        for i, slot, joined, keep in by_hand(scored):
            want[at + i] = (at, at + slot, joined, keep)
        flat += sold_rows
        at += len(rows)
    keyed = measures.with_keys(h.sold(spark, flat), h.profiles(spark)).repartition(7)
    got = {
        r["row_ord"]: (r["grp_ord"], r["slot_ord"], r["is_duplicate"], r["is_kept"])
        for r in dedup.resolve_sales(keyed).collect()
    }
    assert got == want


@pytest.mark.parametrize("split", [10_000, 2])
def test_not_a_number_is_not_missing(spark, split, monkeypatch):
    """NaN is like itself only; infinities too."""
    monkeypatch.setattr(dedup, "SPLIT_ROWS", split)
    nan, rng = float("nan"), random.Random(12)
    three = [{"address": "1 Oak St", "sold_price": p, "lot_sqft": 5000.0} for p in (100.0, nan, 200.0)]
    odd = [(rng.choice([p, nan, float("inf")]), rng.choice([s, nan, 0.0]), c) for p, s, c in _random_rows(rng, 120)]
    got = resolved(spark, three + _as_sold(1, odd))
    assert kept(got)[:3] == [0, 1, 2]
    fates = [tuple(r) for r in got.select("row_ord", "grp_ord", "slot_ord", "is_duplicate", "is_kept").orderBy("row_ord").collect()]

    def near(a, b, tol):
        if a is None or b is None or a == b or a != a and b != b:
            return True
        return a == a and b == b and abs(a - b) / max(abs(a), abs(b)) <= tol

    slots, want = [], []
    for i, (p, s, c) in enumerate(odd, 3):
        c += s is not None
        twin = next((k for k in slots if near(k["p"], p, 0.005) and near(k["s"], s, 0.05)), None)
        want.append((i, 3, i if twin is None else twin["slot"], twin is not None))
        if twin is None:
            slots.append({"slot": i, "o": i, "p": p, "s": s, "c": c})
        elif c > twin["c"]:
            twin.update(o=i, p=p, s=s, c=c)
    final = {k["o"] for k in slots}
    assert fates[3:] == [(*w, w[0] in final) for w in want]


def test_exclusion_reasons_and_reconciliation(spark):
    from marketval.sources import config

    prof = h.profiles(spark, config.vacant_land("lots", "m", exclusions={
        "min_lot_sqft": 1000.0, "explicit_address_keys": ["7 oak st"]}))
    s = measures.with_keys(h.sold(spark, [
        {"address": "1 Elm St", "lot_sqft": 63000, "sold_price": 1}, {"address": "2 Elm St", "lot_sqft": 500},
        {"address": "7 Oak Street", "lot_sqft": 5000}, {"address": "8 Oak St"},
        {"address": "9 Oak St", "lot_sqft": 43560},
    ]), prof)
    a = measures.with_keys(h.active(spark, [
        {"address": "1 Elm Street, Town", "lot_sqft": 63000}, {"address": "5 Elm St", "lot_sqft": 217800},
        {"address": "6 Elm St", "lot_sqft": 5000, "list_price": 5},
    ]), prof)
    out = cleaning.clean(s, a, prof)
    assert {(r["side"], r["address"], r["reason"]) for r in out.excluded.collect()} == {
        ("sold", "1 Elm St", "lot 63,000 sqft exceeds the 43,560 sqft cap"),
        ("sold", "2 Elm St", "lot 500 sqft is below the 1,000 sqft floor"),
        ("sold", "7 Oak Street", "on the market's explicit exclusion list"),
        ("active", "5 Elm St", "lot 217,800 sqft exceeds the 43,560 sqft cap"),
    }
    assert [r["address"] for r in out.reconciled.collect()] == ["1 Elm Street, Town"]
    assert sorted(r["address"] for r in out.sold.collect()) == ["8 Oak St", "9 Oak St"]
    assert [r["address"] for r in out.active.collect()] == ["6 Elm St"]
    assert [r["address"] for r in out.missing_metric.collect()] == ["8 Oak St"]


def test_repeat_sales_compare_with_the_first_row(spark):
    keyed = measures.with_keys(h.sold(spark, [
        {"address": "1 Elm St", "sold_price": 500000, "sold_date": h.day("2026-08-01")},
        {"address": "1 Elm St #4", "sold_price": 500001, "sold_date": h.day("2026-08-03")},
        {"address": "1 Elm St", "sold_price": 700000, "sold_date": h.day("2026-08-03")},
        {"address": "1 Elm St", "sold_date": h.day("2026-08-01")},
    ]), h.profiles(spark))
    assert sorted(r["row_ord"] for r in cleaning.repeat_sales(keyed).collect()) == [2, 3]


def test_lookup_ceiling_by_rank(spark):
    rows = h.sold(spark, [{"sources": ["u"], "lot_sqft": 1} for _ in range(30)]).repartition(5)
    targets = cleaning.needs_lookup(rows, h.profiles(spark))
    assert sorted(r["row_ord"] for r in cleaning.lookup_targets(targets, 7).collect()) == list(range(7))
    assert cleaning.lookups_skipped(targets, 7).select(F.col("skipped")).first()[0] == 23


def _slim(spark, n, price, size):
    """n rows at one address, as the merge reads them; figures are columns of `id`."""
    return spark.range(n).select(
        F.lit("m").alias("market"), F.lit("p").alias("profile"), F.lit("1 elm st").alias("addr_key"), F.col("id").alias("row_ord"),
        price.cast("double").alias("sold_price"), size.cast("double").alias("lot_sqft"),
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("living_sqft", "double"), ("brokerage", "string"), ("agent", "string"), ("final_list_price", "double"),
            ("sold_date", "date"), ("lat", "double"))],
    )


def test_a_million_different_sales_at_one_address(spark):
    """The key is cut into its sales; no task walks them together, and no walk is needed at all."""
    price = F.pow(F.lit(1.01), F.col("id") % 2000)
    size = F.pow(F.lit(1.1), F.floor(F.col("id") / 2000))
    sold = _slim(spark, 1_000_000, price, size)
    got = dedup.resolve_sales(sold)
    assert got.where("is_kept AND NOT is_duplicate AND slot_ord = row_ord AND grp_ord = 0").count() == 1_000_000
    slim = sold.select("market", "profile", F.col("addr_key").alias("_key"), F.col("row_ord").alias("_ord"),
                       F.col("sold_price").alias("_price"), F.col("lot_sqft").alias("_size"), F.lit(1).alias("_score"),
                       F.lit(0).cast("long").alias("grp_ord"))
    parts = dedup._parts(slim, ["market", "profile", "_key"])
    assert parts.select("_first").distinct().count() == 1_000_000 and parts.where(~dedup._is_one_sale()).isEmpty()


def test_copies_of_a_sale_and_rows_without_price_end_in_an_aggregate(spark):
    """200,000 rows of three sales at one address, some without a price: sizes keep them apart."""
    price = F.when(F.col("id") % 5 == 4, None).otherwise(100_000 + F.col("id") % 3 * 100)
    size = F.element_at(F.array(F.lit(1000), F.lit(2000), F.lit(4000)), (F.col("id") % 3 + 1).cast("int"))
    got = dedup.resolve_sales(_slim(spark, 200_000, price, size))
    assert sorted(r["row_ord"] for r in got.where("is_kept").collect()) == [0, 1, 2]
    assert got.where(F.col("slot_ord") != F.col("row_ord") % 3).isEmpty()


@pytest.mark.parametrize("split", [10_000, 50])
def test_a_long_chain_is_walked_as_a_stream(spark, split, monkeypatch):
    """Neighbouring prices match and others do not: one part, whose kept sales alone are held."""
    monkeypatch.setattr(dedup, "SPLIT_ROWS", split)
    rows = [(100000.0 * 1.004 ** (k * 7 % 500), 5000.0, 0) for k in range(3000)]
    want = by_hand([(p, s, 1) for p, s, _ in rows])
    got = dedup.resolve_sales(measures.with_keys(h.sold(spark, _as_sold(0, rows)), h.profiles(spark)).repartition(6))
    found = [tuple(r) for r in got.select("row_ord", "slot_ord", "is_duplicate", "is_kept").orderBy("row_ord").collect()]
    assert found == want


def test_the_walk_compares_plain_prices_without_a_call(monkeypatch):
    from itertools import product

    from marketval.constants import SAME_PRICE_TOLERANCE, SAME_SIZE_TOLERANCE

    near, asked = dedup.Kept.near, []
    figures = [None, 0.0, 100.0, 100.4, 101.0, -100.0, -100.4, 1e300, float("inf"), float("-inf"), float("nan")]
    for a, b in product(product(figures, repeat=2), repeat=2):
        kept = dedup.Kept()
        kept.slots.append([0, 0, *a, 1])
        same = near(a[0], b[0], SAME_PRICE_TOLERANCE) and near(a[1], b[1], SAME_SIZE_TOLERANCE)
        assert kept.twin(*b) == (0 if same else None)
    monkeypatch.setattr(dedup.Kept, "near", staticmethod(lambda *x: asked.append(x) or near(*x)))
    kept = dedup.Kept()
    for i in range(10):
        kept.add(i, 1000.0 * 2**i, 5000.0, 1)
    assert len(kept.slots) == 10 and not asked
