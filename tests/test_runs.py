import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

import helpers as h
from marketval.operators import compare, measures
from marketval.operators.sizing import CLEANUP, DATASET, written
from marketval.plans import analysis, archive, reports
from marketval.sources import config

def end():
    return F.lit("2026-08-31").cast("date")


def market_tables(spark, n=60, tolerance=0.25):
    rng = random.Random(4)
    sold = [
        {"address": f"{i} Elm St", "sold_price": rng.randint(200, 900) * 1000, "lot_sqft": rng.choice([None, *range(3000, 9000, 350)]),
         "sold_date": dt.date(2026, 8, 30) - dt.timedelta(days=i % 80), "agent": f"Agent {i % 7}", "brokerage": "Compass",
         "final_list_price": rng.randint(200, 900) * 1000, "lat": 40 + rng.random() / 20, "lon": -100 + rng.random() / 10 - 0.05}
        for i in range(n)]
    sold.append({**sold[0], "address": "0 Elm Street #9", "sold_date": None})
    active = [{"address": f"{i} Elm St", "list_price": rng.randint(200, 900) * 1000, "lot_sqft": 5000} for i in range(n - 3, n + 12)]
    prof = h.profiles(spark, config.vacant_land("lots", "m", similar_bracket={"tolerance": tolerance}))
    return analysis.Tables(h.sold(spark, sold), h.active(spark, active), prof,
                           h.subjects(spark, {"lot_sqft": 6450.0}), h.geometry(spark))


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("archive"))
    tables = market_tables(spark)
    results = analysis.run(tables, end())
    keep = {k: results[k] for k in ("sold", "active", "sold_stats", "valuation", "excluded")}
    for stamp in ("20260801T000000Z", "20260905T053000Z"):
        archive.write_run(keep, tables, root, stamp, ("2026-06-02", "2026-08-31"), "recorded")
    return root, results


def test_every_result_of_a_run_can_be_read(archived):
    _, results = archived
    counts = {k: v.count() for k, v in results.items()}
    assert counts["sold"] == 60 and counts["duplicates"] == 1 and counts["reconciled"] == 3
    assert counts["valuation"] == 5 and counts["areas"] == 6 and counts["guidance"] == 3
    assert counts["agents"] == 7 and counts["ladder"] == 7


def test_cross_checks_hold(archived):
    _, r = archived
    primary = r["valuation"].where("is_primary").first()
    mine = r["ladder"].where("is_profile_bracket").first()
    assert mine["value_from_median"] == primary["value"]
    everything = r["ladder"].where("is_all_sold").first()
    assert everything["value_from_median"] == r["valuation"].where("basis = 'all_sold_median'").first()["value"]
    assert r["guidance"].where("strategy = 'compete'").first()["list_price"] % 50000 == 49000
    in_bands = r["size_bands"].agg(F.sum("count")).first()[0]
    assert in_bands == r["sold"].where("metric_size IS NOT NULL").count()


def test_a_run_listed_read_and_found(spark, archived):
    root, _ = archived
    runs = archive.list_runs(spark, root, "m", "lots")
    assert [r["run_at"] for r in runs.collect()] == ["20260905T053000Z", "20260801T000000Z"]
    assert archive.latest_run(runs, F.lit("20260905T053000Z")).first()["run_at"] == "20260801T000000Z"
    found = archive.runs_on(runs, F.lit("2026-09-04").cast("date"), "America/Los_Angeles")
    assert found.first()["run_at"] == "20260905T053000Z"
    assert archive.profiles_with_runs(runs).first()["runs"] == 2
    shown, more = archive.history(runs, 1)
    assert shown.count() == 1 and more == 1
    assert archive.read_stored(spark, root, "valuation", "m", "lots", "20260801T000000Z").count() == 5


def test_reopening_gives_the_original_figures(spark, archived):
    root, results = archived
    tables = archive.collected(spark, root, h.geometry(spark), "m", "lots", "20260801T000000Z")
    again = archive.reopen(tables, keep=False)
    value = lambda r: {x["basis"]: x["value"] for x in r["valuation"].collect()}
    assert value(again) == pytest.approx(value(results))
    drops = spark.createDataFrame([("m", "lots", "5 Elm Street")], "market string, profile string, address string")
    fewer = archive.reopen(tables, exclude_addresses=drops, keep=False)
    assert fewer["sold"].count() == again["sold"].count() - 1
    assert fewer["caveats"].where("code = 'reanalyzed_with_changed_settings'").count() == 1


def test_another_version_and_missing_metadata_are_refused(spark, archived, tmp_path):
    root, _ = archived
    runs = spark.read.parquet(f"{root}/runs")
    with pytest.raises(archive.SnapshotIncompatible):
        archive.check_version(runs.withColumn("schema_version", F.lit(99)))
    with pytest.raises(archive.SnapshotUnreadable):
        archive.collected(spark, root, h.geometry(spark), "m", "nothing", "20260801T000000Z")


def test_writing_again_leaves_nothing_of_the_first_write(spark, tmp_path):
    """Fewer rows, then none, in a table; another market's run under the same stamp stays."""
    root, stamp = str(tmp_path / "archive"), "20260801T000000Z"
    tables = market_tables(spark, 5)
    sold = measures.sold_measures(tables.sold, tables.profiles)
    elsewhere = lambda df: df.withColumn("market", F.lit("other"))
    other = analysis.Tables(*[elsewhere(x) for x in (tables.sold, tables.active, tables.profiles.df, tables.subjects.df)], tables.geometry)
    archive.write_run({"sold": elsewhere(sold), "log": elsewhere(sold)}, other, root, stamp, ("2026-06-02", "2026-08-31"))
    n = sold.count()
    for rows in (sold, sold.where("row_ord < 2"), sold.limit(0), sold):
        archive.write_run({"sold": rows, "log": sold, "never": sold.limit(0)}, tables, root, stamp, ("2026-06-02", "2026-08-31"))
        assert archive.read_stored(spark, root, "sold", "m", "lots", stamp).count() == rows.count()
        assert archive.read_stored(spark, root, "log", "m", "lots", stamp).count() == n
        never = archive.read_stored(spark, root, "never", "m", "lots", stamp)
        assert never.count() == 0 and set(sold.columns) <= set(never.columns)
        assert archive.read_stored(spark, root, "sold", "other", "lots", stamp).count() == n
        assert archive.list_runs(spark, root, "m", "lots").count() == 1


def test_an_archive_is_written_by_the_tasks_that_hold_its_rows(spark, tmp_path):
    """Whole rows are not shuffled for the write, and all of them arrive."""
    root, stamp = str(tmp_path / "archive"), "20260801T000000Z"
    tables = market_tables(spark, 40)
    rows = measures.sold_measures(tables.sold, tables.profiles).repartition(3, "row_ord")
    archive.write_run({"sold": rows}, tables, root, stamp, ("2026-06-02", "2026-08-31"))
    files = list((tmp_path / "archive" / "sold").rglob("*.zstd.parquet"))
    assert len(files) == 3
    back = archive.read_stored(spark, root, "sold", "m", "lots", stamp)
    shown = [c for c in rows.columns if c != "notes"]
    assert back.select(*shown).exceptAll(rows.select(*shown)).isEmpty() and back.count() == rows.count()


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in map(str, disk.getAllFiles().mkString(" ").split()) if "shuffle_" in f}
    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    kept = written(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 9_000).alias("k")).count())
    for _ in range(50):
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and kept.count() == 9_000 and spark.conf.get(CLEANUP, None) == setting


def test_renaming_moves_every_run(spark, tmp_path):
    root = str(tmp_path / "archive")
    tables = market_tables(spark, 5)
    sold = measures.sold_measures(tables.sold, tables.profiles)
    archive.write_run({"sold": sold}, tables, root, "20260801T000000Z", ("2026-06-02", "2026-08-31"))
    assert archive.rename_profile(spark, root, "m", "none", "x") == 0
    with pytest.raises(archive.RunsExist):
        archive.rename_profile(spark, root, "m", "lots", "lots")
    assert archive.rename_profile(spark, root, "m", "lots", "my lots") == 1
    assert archive.list_runs(spark, root, "m", "lots").count() == 0
    assert archive.read_stored(spark, root, "sold", "m", "my lots").count() == 6


def test_like_names_are_stored_apart(spark, tmp_path):
    """Names that differ in blanks, signs, escapes or case of punctuation keep their own runs."""
    root, stamp = str(tmp_path / "archive"), "20260801T000000Z"
    tables = market_tables(spark, 3)
    names = ["A B", "A-B", "A+B", "A%20B", "a/b", "*", "", "é=1", "{x}", "..", "unnamed"]
    copies = F.explode(F.array(*[F.lit(n) for n in names]))
    spread = lambda df: df.drop("market").withColumn("market", copies)
    many = analysis.Tables(*[spread(x) for x in (tables.sold, tables.active, tables.profiles.df, tables.subjects.df)], tables.geometry)
    for _ in range(2):  # written again, nothing doubles
        archive.write_run({"sold": many.sold}, many, root, stamp, ("2026-06-02", "2026-08-31"))
    runs = archive.list_runs(spark, root)
    assert sorted(r["market"] for r in runs.collect()) == sorted(names)
    n = tables.sold.count()
    counts = archive.read_stored(spark, root, "sold").groupBy("market").count().collect()
    assert {r["market"]: r["count"] for r in counts} == dict.fromkeys(names, n)
    assert archive.rename_profile(spark, root, "A+B", "lots", "50% off *") == 1
    left = archive.read_stored(spark, root, "sold", "A+B").select("profile").distinct().collect()
    assert [r["profile"] for r in left] == ["50% off *"]
    assert archive.read_stored(spark, root, "sold", "A B", "lots", stamp).count() == n


def test_an_invalid_profile_stops_the_run(spark):
    tables = market_tables(spark, 3)
    bad = config.vacant_land("lots", "m", window_days=0)
    with pytest.raises(analysis.ProfileInvalid):
        analysis.run(analysis.Tables(tables.sold, tables.active, h.profiles(spark, bad), tables.subjects, tables.geometry), end())


def test_what_ifs_run_together(spark):
    tables = market_tables(spark, 20)
    what = spark.createDataFrame(
        [("m", "lots", 1, 4000.0, []), ("m", "lots", 2, None, ["3 elm st"])],
        "market string, profile string, scenario_id int, subject_size double, exclude_keys array<string>")
    many = analysis.scenarios_of(tables, what)
    ready = analysis.prepare(many)
    counts = {r["profile"]: r["count"] for r in ready.sold.groupBy("profile").count().collect()}
    assert counts == {"lots#1": 20, "lots#2": 19}
    sizes = {r["profile"]: r["lot_sqft"] for r in many.subjects.df.collect()}
    assert sizes == {"lots#1": 4000.0, "lots#2": 6450.0}


def test_changes_between_two_runs(spark):
    key = lambda df: df.withColumn("addr_key_unit", F.lower("address"))
    before_s = key(h.sold(spark, [{"address": "a"}, {"address": "b"}]))
    after_s = key(h.sold(spark, [{"address": "a"}, {"address": "c"}, {"address": "d"}]))
    before_a = key(h.active(spark, [{"address": "c", "list_price": 5}, {"address": "e", "list_price": 9}, {"address": "f", "list_price": 7}]))
    after_a = key(h.active(spark, [{"address": "e", "list_price": 8}, {"address": "g"}, {"address": "e", "list_price": 6}]))
    got = {}
    for r in compare.changes(before_s, before_a, after_s, after_a, DATASET).collect():
        got.setdefault(r["category"], set()).add((r["address"], r["before"], r["after"]))
    none = lambda *xs: {(x, None, None) for x in xs}
    assert got == {"new_sale": none("c", "d"), "newly_closed": none("c"), "new_active": none("g"),
                   "gone": none("f"), "price_cut": {("e", 9.0, 6.0)}}


def test_a_change_report_names_every_pair(spark):
    """A pair without changes, a withdrawn listing, and price cuts in order of their size."""
    pairs = spark.createDataFrame([("m", "lots", "1 July"), ("m", "homes", None)], "market string, profile string, prior_label string")
    rows = [("m", "lots", "gone", "z", None, None)] + [
        ("m", "lots", "price_cut", f"{c} St", 2000.0, 1000.0 + k) for k, c in enumerate("jihgfedcba")]
    made = spark.createDataFrame(rows, "market string, profile string, category string, address string, before double, after double")
    none = spark.createDataFrame([], "market string, profile string, label string, before double, after double, pct_change double")
    report = {}
    for r in reports.change_report(made, none, pairs, DATASET).collect():
        report[r["profile"], r["section"], r["label"]] = (r["n"], r["detail"])
    assert report["lots", "rows", "Compared with"][1] == "1 July" and report["homes", "rows", "Compared with"][1] == "—"
    assert report["lots", "rows", "New sales"] == (0, "none") and report["lots", "counts", "Listings withdrawn"] == (1, None)
    assert report["homes", "counts", "Price cuts"] == (0, None) and ("homes", "rows", "Price cuts") not in report
    n, shown = report["lots", "rows", "Price cuts"]
    assert n == 10 and shown == "; ".join(f"{c} St $2,000 to ${1000 + k:,}" for k, c in enumerate("jihgfedc"))


def test_summary_blocks(spark):
    band = spark.createDataFrame([("m", "lots", 0, "1-2 sqft", 3, 1.0, 2.0, 1.5, None, 2), ("m", "lots", 1, "2-4 sqft", 3, 1.0, 2.0, 3.0, 9.0, 0)],
        "market string, profile string, band long, label string, count long, median_ppsf double, avg_ppsf double, median_size double, "
        "median_price double, subjects_in_band long")
    got = {r["key"]: (r["label"], r["sold"], r["active"]) for r in reports.band_block(band).collect()}
    assert len(got) == 10 and got["0:count"] == ("1-2 sqft  <- your property", 3.0, None)
    assert got["0:median_price"][1] is None and got["1:median_price"] == ("2-4 sqft", 9.0, None)
    area = spark.createDataFrame([("m", "lots", 0, "NE", 4, 1.0, 2.0, 3.0, 5.0, 7, 8.0)],
        "market string, profile string, position int, area string, sold_count long, sold_avg_ppsf double, sold_median_ppsf double, "
        "sold_median_price double, sold_avg_size double, active_count long, active_avg_ppsf double")
    got = {r["key"]: (r["label"], r["sold"], r["active"]) for r in reports.area_block(area).collect()}
    assert got["0:count"] == ("NE", 4.0, 7.0) and got["0:avg_ppsf"] == ("NE", 1.0, 8.0) and got["0:avg_size"] == ("NE", 5.0, None)
    assert reports.band_block(band.limit(0)).count() == 0


def test_a_missing_address_is_one_key(spark):
    key = lambda df: df.withColumn("addr_key_unit", F.lower("address"))
    one, two = key(h.sold(spark, [{"address": None}])), key(h.sold(spark, [{"address": None}, {"address": None}]))
    empty = key(h.active(spark, [{"address": "x"}])).limit(0)
    assert compare.changes(one, empty, two, empty, DATASET).count() == 0
    assert compare.new_sales(one.limit(0), two, DATASET).count() == 1


def test_first_names_are_capped(spark):
    rows = h.sold(spark, [{"address": f"{c} St"} for c in "kjihgfedcba"])
    got = compare.first_names(rows, DATASET, "address").first()
    assert got["n"] == 11 and got["detail"] == "a St, b St, c St, d St, e St, f St, g St, h St (+3 more)"


def test_delta_text(spark):
    df = spark.createDataFrame([(100.0, 110.0, 0.1), (100.0, 95.5, -0.045), (None, 1.0, None)], "b double, a double, p double")
    got = [r[0] for r in df.select(compare.delta_text(F.col("b"), F.col("a"), F.col("p"))).collect()]
    assert got == ["100.00 to 110.00 (+10.0%)", "100.00 to 95.50 (-4.5%)", "—"]


def test_missing_sorts_last_both_ways(spark):
    rows = h.sold(spark, [{"agent": "beta"}, {"agent": None}, {"agent": "Alpha"}, {"agent": "Gamma"}])
    up = [r["agent"] for r in reports.sorted_comps(rows, "agent", descending=False).collect()]
    assert up == ["Alpha", "beta", "Gamma", None]
    price = h.sold(spark, [{"sold_price": 1}, {}, {"sold_price": 3}])
    assert [r["sold_price"] for r in reports.sorted_comps(price, "sold_price").collect()] == [3.0, 1.0, None]


def test_sheet_columns_follow_the_profile():
    assert reports.sheet_columns("lot_sqft", [], True)[3:5] == ["metric_size", "ppsf"]
    assert "lot_sqft" in reports.sheet_columns("living_sqft", ["beds"], True)
    assert reports.sheet_columns("living_sqft", ["beds", "odd"], False)[2:6] == ["metric_size", "ppsf", "beds", "lot_sqft"]


def test_export_keeps_text_as_text(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 2.0)], "agent string, x double")
    reports.write_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert (back["agent"], back["x"]) == ("'=1+1", "2.0")


def test_names_stay_text_and_a_run_can_be_written_again(spark, tmp_path):
    root = str(tmp_path / "archive")
    assert archive.list_runs(spark, root).count() == 0
    tables = market_tables(spark, 5)
    for name in ("007", "2026-08-31"):
        def named(df, name=name):
            return df.withColumns({"market": F.lit("94110"), "profile": F.lit(name)})

        own = analysis.Tables(named(tables.sold), named(tables.active), named(tables.profiles.df),
                              named(tables.subjects.df), tables.geometry)
        for _ in range(2):
            archive.write_run({"sold": own.sold}, own, root, "20260801T000000Z", ("2026-06-02", "2026-08-31"))
    runs = archive.list_runs(spark, root)
    assert [(r["market"], r["profile"]) for r in runs.collect()] == [("94110", "007"), ("94110", "2026-08-31")]
    assert archive.read_stored(spark, root, "sold", "94110", "007").count() == tables.sold.count()
    shown, more = archive.history(runs, 1)
    assert shown.first()["profile"] == "007" and more == 1


def test_a_run_without_version_is_refused(spark):
    runs = spark.createDataFrame([("m", "p", "x", None)], "market string, profile string, run_at string, schema_version int")
    with pytest.raises(archive.SnapshotIncompatible):
        archive.check_version(runs)
