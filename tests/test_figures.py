import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers as h
from marketval.operators import agents, areas, guidance, measures, quantiles, ranking, stats, valuation
from marketval.operators.sizing import Dim
from marketval.sources import config


def measured(spark, rows, prof=None):
    return measures.sold_measures(h.sold(spark, rows), prof or h.profiles(spark))


def no_active(spark, prof=None):
    return measures.active_measures(h.active(spark, []), prof or h.profiles(spark))


def test_percentiles_of_any_values(spark):
    rng = random.Random(5)
    data = {"a": [rng.lognormvariate(4, 3) * rng.choice([-1, 1, 1]) for _ in range(997)] + [0.0] * 40,
            "b": [7.0] * 500 + [8.0], "c": [3.5], "d": [1.0, 2.0], "e": []}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = quantiles.aggregate(
        df, ["g"], [F.count("x").alias("n")],
        {"mid": (F.col("x"), 0.5), "p15": (F.col("x"), 0.15), "p90": (F.col("x"), 0.9)})
    for r in got.collect():
        xs = data[r["g"]]
        assert r["n"] == len(xs)
        want = [None] * 3 if not xs else [statistics.median(xs), *np.percentile(xs, [15, 90])]
        assert [r["mid"], r["p15"], r["p90"]] == pytest.approx(want)


def test_percentiles_equal_the_built_in_ones_bit_by_bit(spark):
    rng = random.Random(7)
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1.7e308]
    rows = [(rng.choice(["a", "b", None]), rng.uniform(-9e5, 9e5), rng.uniform(0, 2)) for _ in range(3000)]
    rows += [(g, x, x) for g, n in (("nan", 3), ("inf", 7)) for x in odd[:n]] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    points = {f"{c}{int(q * 100)}": (F.col(c), q) for c in "xy" for q in (0.0, 0.15, 0.45, 0.5, 0.9, 1.0)}
    want = df.groupBy("g").agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in points.items()])
    plain = lambda d: sorted(map(repr, d.select("g", *points).collect()))
    for parts in (1, 7):
        assert plain(quantiles.aggregate(df.repartition(parts), ["g"], [], points)) == plain(want)


def test_rank_in_group_agrees_with_a_sort(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 5), rng.choice("abc") + str(i)) for i, g in enumerate("xy" * 200)]
    df = spark.createDataFrame(rows, "g string, n int, t string").repartition(5)
    got = ranking.rank_in_group(df, ["g"], [-F.col("n"), F.col("t")], "r").collect()
    for g in "xy":
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])
        assert [r["t"] for r in mine] == [r[2] for r in want]
        assert [r["r"] for r in mine] == list(range(1, len(want) + 1))


def test_side_figures_and_core(spark):
    rows = [{"sold_price": p, "lot_sqft": s} for p, s in
            [(500000, 5000), (100000, 5000), (0, 5000), (900000, None), (300000, 0), (2000000, 5000)]]
    got = stats.sold_stats(measured(spark, rows)).first().asDict()
    assert got["count"] == 6 and got["missing_metric_count"] == 3
    assert got["median_ppsf"] == 100.0 and got["avg_ppsf"] == pytest.approx((100 + 20 + 400) / 3)
    assert got["avg_size"] == 4000.0  # a zero size is a size
    assert (got["core_count"], got["core_median_ppsf"]) == (1, 100.0)


def test_sold_to_ask(spark):
    rows = [{"sold_price": s, "final_list_price": f, "original_list_price": o} for s, f, o in
            [(122, 100, 100), (100, 100, 110), (85, 100, None), (500, None, None)]]
    got = stats.sold_to_ask(measured(spark, rows)).first()
    assert (got["count"], got["at_or_above_ask"], got["at_or_above_105"], got["below_90"]) == (3, 2, 1, 1)
    assert got["max_ratio"] == 1.22 and got["reduced_count"] == 1


def test_valuation_is_unrounded(spark):
    rows = [{"sold_price": 480000, "lot_sqft": 6000}, {"sold_price": 550347.2, "lot_sqft": 6500},
            {"sold_price": 100, "lot_sqft": 20000}]
    prof = h.profiles(spark)
    got = {r["basis"]: r for r in valuation.value_subjects(
        measured(spark, rows), no_active(spark), h.subjects(spark, {"lot_sqft": 6450.0}), prof).collect()}
    rate = (80.0 + 550347.2 / 6500) / 2
    assert got["similar_size_median"]["value"] == pytest.approx(6450 * rate, abs=1e-6)
    assert got["similar_size_median"]["is_primary"] and got["similar_size_median"]["sample_size"] == 2
    assert got["active_median"]["value"] is None and got["active_median"]["sample_size"] == 0


def test_bracket_ends_are_included_and_beds_must_match(spark):
    rows = [{"lot_sqft": x, "sold_price": 1, "beds": b} for x, b in
            [(4000, 3), (4500, 3), (6000, 3), (7500, 3), (8000, 3), (6000, 2), (6000, None)]]
    prof = h.profiles(spark, config.vacant_land("lots", "m", similar_bracket={"match_bed_count": True}))
    subj = h.subjects(spark, {"lot_sqft": 6000.0, "beds": 3.0}, {"lot_sqft": 6000.0}, {"lot_sqft": None})
    pairs = valuation.bracket_pairs(measured(spark, rows, prof), subj, prof)
    got = {}
    for r in pairs.collect():
        got.setdefault(r["subject_id"], []).append(r["row_ord"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [1, 2, 3], 1: [1, 2, 3, 5, 6]}


def test_size_slices_find_the_same_pairs(spark):
    rng = random.Random(9)
    rows = [{"lot_sqft": rng.choice([0, 1, 50, 4999.5, 5000, 70000, None, rng.uniform(1, 1e5)])} for _ in range(200)]
    prof = h.profiles(spark, config.vacant_land("lots", "m", similar_bracket={"tolerance": 1.0}),
                      config.vacant_land("tight", "m", similar_bracket={"tolerance": 0.01}))
    subj = h.subjects(spark, {"lot_sqft": 5000.0}, {"lot_sqft": 70000.0}, {"lot_sqft": 1e300},
                      {"lot_sqft": 50.0, "profile": "tight"})
    s = measured(spark, rows + [{**r, "profile": "tight"} for r in rows], prof)
    far = Dim(subj)
    far.__dict__["fits"] = False
    pairs = lambda d: sorted((r["profile"], r["subject_id"], r["row_ord"])
                             for r in valuation.bracket_pairs(s, d, prof).collect())
    assert pairs(Dim(subj)) == pairs(far) != []


@pytest.mark.parametrize("n, bands", [(20, 5), (7, 2), (4, 1)])
def test_band_counts(spark, n, bands):
    rows = [{"lot_sqft": 1000 + i, "sold_price": 1000} for i in range(n)]
    got = valuation.size_bands(measured(spark, rows), h.subjects(spark, {"lot_sqft": 1000.0}), h.profiles(spark))
    assert got.count() == bands and got.agg(F.sum("count")).first()[0] == n


def test_ties_on_an_edge_fall_in_one_band(spark):
    sizes = [1000] * 4 + [5000] * 9 + [9000] * 2
    rows = [{"lot_sqft": x, "sold_price": x * 100} for x in sizes]
    got = valuation.size_bands(
        measured(spark, rows), h.subjects(spark, {"lot_sqft": 9000.0}), h.profiles(spark)).orderBy("band").collect()
    assert sum(r["count"] for r in got) == len(sizes)
    assert [(r["low"], r["count"], r["subjects_in_band"]) for r in got] == [(1000, 4, 0), (5000, 11, 1)]


def test_size_trend(spark):
    rows = [{"lot_sqft": 1000 + i, "sold_price": (1000 + i) * 100} for i in range(5)]
    rows += [{"lot_sqft": 9000 + i, "sold_price": (9000 + i) * 50} for i in range(5)]
    bands = valuation.size_bands(measured(spark, rows), h.subjects(spark, {}), h.profiles(spark))
    assert valuation.size_trend(bands).first()["trend_pct"] == pytest.approx(100.0)


def ladder_of(spark, tolerance=0.25):
    rng = random.Random(1)
    rows = [{"lot_sqft": s, "sold_price": s * (160 - s / 100)} for s in
            [rng.uniform(2000, 12000) for _ in range(80)]] + [{"sold_price": 5}]
    prof = h.profiles(spark, config.vacant_land("lots", "m", similar_bracket={"tolerance": tolerance}))
    subj = h.subjects(spark, {"lot_sqft": 6450.0})
    s = measured(spark, rows, prof)
    return (valuation.bracket_ladder(s, subj, prof).orderBy("position").collect(),
            {r["basis"]: r for r in valuation.value_subjects(s, no_active(spark, prof), subj, prof).collect()})


def test_ladder_agrees_with_the_bases(spark):
    rungs, bases = ladder_of(spark)
    assert len(rungs) == 7  # a coinciding width replaces its rung
    assert rungs[-1]["is_all_sold"] and rungs[-1]["label"] == "every sale (81)"
    assert rungs[-1]["value_from_median"] == bases["all_sold_median"]["value"]
    assert rungs[-1]["value_from_avg"] == pytest.approx(bases["all_sold_avg"]["value"])
    mine = next(r for r in rungs if r["is_profile_bracket"])
    assert mine["value_from_median"] == bases["similar_size_median"]["value"]
    assert mine["label"] == "this search  (4,838-8,062 sqft)"
    counts = [r["count"] for r in rungs]
    assert counts == sorted(counts)


def test_own_width_is_inserted_in_order(spark):
    rungs, _ = ladder_of(spark, 0.30)
    assert [r["label"].split("  ")[0] for r in rungs][:5] == ["+/-10%", "+/-15%", "+/-25%", "this search", "+/-40%"]


@pytest.mark.parametrize("anchor, compete", [(544720, 499000), (549999, 499000), (551000, 549000)])
def test_price_to_compete(spark, anchor, compete):
    df = spark.createDataFrame([(float(anchor),)], "v double")
    assert df.select(guidance.band_floor(F.col("v")) - 1000).first()[0] == compete


def _guide(spark, anchor):
    valued = spark.createDataFrame(
        [("m", "lots", 0, True, float(anchor))],
        "market string, profile string, subject_id long, is_primary boolean, value double")
    points = guidance.ratio_points(measured(spark, [
        {"sold_price": 100 * r, "final_list_price": 100} for r in (0.9, 1.0, 1.02, 1.1)]))
    return {r["strategy"]: r for r in guidance.build_guidance(valued, points, h.profiles(spark)).collect()}


def test_limit_beats_tactic(spark):
    low = _guide(spark, 501000)
    assert low["compete"]["list_price"] == 499000 and low["compete"]["floor"] == 476000
    assert low["compete"]["recommended"] and not low["at_market"]["recommended"]
    edge = _guide(spark, 549999)
    assert edge["compete"]["below_floor"] and edge["at_market"]["recommended"]
    assert edge["compete"]["label"] == "A. Price to compete (below your floor)"
    assert edge["at_market"]["list_price"] == 539000


def test_what_a_strategy_trades(spark):
    got = _guide(spark, 544720)
    low, mid, high = (got[k] for k in ("compete", "at_market", "anchor_high"))
    assert (low["tradeoff"], low["cutoff"], low["under_estimate"]) == ("under_search_cutoff", 500000.0, 45720.0)
    assert low["under_share"] == pytest.approx(45720 / 544720) and low["floor_basis"] == "5% below the estimate"
    assert (mid["min_ratio"], mid["max_ratio"], mid["cutoff"]) == (0.9, 1.1, None)
    assert (high["tradeoff"], high["premium"], high["under_estimate"]) == ("over_estimate", 0.055, 544720 - 569000)


def test_guidance_notes(spark):
    valued = spark.createDataFrame(
        [("m", "lots", k, True, v) for k, v in enumerate((549999.0, 501000.0, None))],
        "market string, profile string, subject_id long, is_primary boolean, value double")
    points = guidance.ratio_points(measured(spark, [{"sold_price": 100, "final_list_price": 100}]))
    guided = guidance.build_guidance(valued, points, h.profiles(spark))
    got = {r["subject_id"]: tuple(r)[3:] for r in guidance.guidance_notes(valued, guided).collect()}
    assert got == {0: ("compete_below_floor", 499000.0, 522000.0, 539000.0), 2: ("no_primary_valuation", None, None, None)}


def test_expected_ranges_round_half_even(spark):
    got = _guide(spark, 544720)["compete"]
    ratios = [0.9, 1.0, 1.02, 1.1]
    lo, hi = (round(499000 * float(np.percentile(ratios, q)), -3) for q in (45, 90))
    assert (got["expected_low"], got["expected_high"]) == (lo, hi)


def test_quadrants_follow_the_polyline(spark):
    rows = [
        {"lat": 40.016, "lon": -100.05}, {"lat": 40.014, "lon": -100.05}, {"lat": 40.5, "lon": -99.0},
        {"lat": 40.0, "lon": -101.0}, {"lat": None, "lon": -100.0, "area": "SW"},
        {"lat": 40.0101, "lon": -100.0}, {"lat": 40.02, "lon": -99.9},
    ]
    got = areas.classify_all(h.sold(spark, rows), h.geometry(spark)).orderBy("row_ord").collect()
    assert [r["area"] for r in got] == ["NW", "SW", "NE", "SW", "SW", "NE", "NE"]
    assert [r["borderline"] for r in got] == [False, False, False, False, False, True, True]
    assert got[5]["notes"] == [areas.BORDERLINE_NOTE] and got[0]["notes"] == []


def test_single_waypoint_and_missing_geometry(spark):
    rows = [{"lat": 40.5, "lon": -100.5, "area": "SE"}]
    one = areas.classify_all(h.sold(spark, rows), h.geometry(spark, ((-100.0, 40.0),)))
    assert one.first()["area"] == "NW"
    none = areas.classify_all(h.sold(spark, rows), h.geometry(spark, (), None))
    assert none.first()["area"] == "SE"


def test_area_table_always_has_six_rows(spark):
    s = measured(spark, [{"area": "NE", "sold_price": 10, "lot_sqft": 1}, {"area": "SE", "sold_price": 20, "lot_sqft": 1}, {}])
    got = areas.area_table(s, no_active(spark), h.profiles(spark)).orderBy("position").collect()
    assert [(r["area"], r["sold_count"]) for r in got] == [
        ("NE", 1), ("NW", 0), ("SE", 1), ("SW", 0), (areas.EAST, 2), (areas.WEST, 0)]
    assert got[4]["sold_median_ppsf"] == 15.0 and got[1]["sold_avg_ppsf"] is None


def test_agents_flags_firms_and_interview_order(spark):
    def sale(agent, sold, ask, **k):
        return {"agent": agent, "sold_price": sold, "final_list_price": ask, "original_list_price": ask, "lot_sqft": 10, **k}

    s = measured(spark, [
        sale("Solo", 150, 100), sale("Pair", 101, 100, brokerage=None), sale("Pair", 100, 100, brokerage="BHHS West"),
        sale("Pair", 100, 100, brokerage="Compass"), sale("Cut", 80, 100, original_list_price=120),
        sale("Dual", 99, 100, buyer_agent=" Dual "), sale("", 1, 1, brokerage="KW X"), sale(None, 1, 1),
    ])
    a = measures.active_measures(
        h.active(spark, [{"agent": "New", "brokerage": "Compass"}, {"agent": "Pair"}]), h.profiles(spark))
    table = agents.agent_table(s, a)
    got = {r["agent"]: r for r in agents.interview_order(table).collect()}
    assert {k: r["flag"] for k, r in got.items()} == {
        "Solo": "", "Pair": "shortlist", "Cut": "caution", "Dual": "", "New": ""}
    assert got["Pair"]["brokerage"] == "Berkshire Hathaway HomeServices" and got["Pair"]["active_listings"] == 1
    assert got["Dual"]["dual_agency"] and got["New"]["closings"] == 0
    assert sorted(got, key=lambda k: got[k]["interview_rank"]) == ["Pair", "Solo", "Dual", "Cut", "New"]
    firms = {r["family"]: (r["closings"], r["active_listings"], r["share"]) for r in agents.brokerage_table(s, a).collect()}
    assert firms["Compass"] == (1, 1, pytest.approx(1 / 7)) and firms["Keller Williams"] == (1, 0, pytest.approx(1 / 7))


def test_agents_firms_are_found_without_sorting_rows(spark):
    rows = [("m", "lots", None, 1), ("m", "lots", "", 2), ("m", "lots", "KW Z", 9), ("m", "lots", "Compass Y", 4),
            ("m", "lots", "KW Z", 3), (None, "lots", "Nobody", 7)]
    sold = spark.createDataFrame(
        [(m, p, "Ann", b, o, None, 0.9, 10.0, 5.0, False) for m, p, b, o in rows] + [
            ("m", "lots", "Bob", "", 5, None, 1.0, 1.0, 1.0, True)],
        "market string, profile string, agent string, brokerage string, row_ord long, buyer_agent string, "
        "ratio double, ppsf double, metric_size double, reduced boolean")
    active = spark.createDataFrame([], "market string, profile string, agent string")
    table = agents.agent_table(sold, active, [])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "SortAggregate" in x and "count(" in x]  # of firms alone
    assert {(r["market"], r["agent"], r["brokerage"], r["closings"]) for r in table.collect()} == {
        ("m", "Ann", "KW Z", 5), ("m", "Bob", None, 1), (None, "Ann", "Nobody", 1)}
