import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import helpers as h
from marketval import schemas
from marketval.operators import measures, verify
from marketval.operators.sizing import WRITTEN
from marketval.sources import config, embedded, pages, recorded

RECORDS = [
    {"addr": {"line": "12 Elm St"}, "price": "$550,000", "tags": [{"formattedName": "SOLD"}, {"formattedName": "AUG 28, 2026"}],
     "size": "0.27 Acres", "url": "/p/1", "by": "Jane Roe DRE # 1, Some Firm", "geo": [40.5, -100.5], "beds": None},
    {"addr": {"line": "14 Elm St"}, "price": 610000, "tags": ["NEW"], "size": 5227, "url": "https://IDX.example/p/2",
     "by": "Sender Realty, Inc.", "geo": [], "beds": 3},
    {"addr": {}, "price": None, "url": "http://169.254.169.254/x"},
    {"addr": {"line": "16 Elm St"}, "price": "$1.2M", "size": "1" * 200 + " acres", "url": "ftp://idx.example/p"},
]
SPEC = embedded.Layout(
    records="props.0.records", total="props.0.total", base="https://idx.example/",
    rules=[("address", "addr.line", "text"), ("sold_price", "price", "money"), ("sold_date", "tags", "tag_date"),
           ("lot_sqft", "size", "sqft"), ("lat", "geo.0", "float"), ("beds", "beds", "float"), ("source_url", "url", "raw"),
           ("agent", "by", "attribution_agent"), ("brokerage", "by", "attribution_brokerage")])


def test_layouts_come_from_settings_kept_as_text(spark):
    """Rules are paths or objects; a source without rules or with unreadable settings has defaults."""
    said = [("a", json.dumps({"records_path": "x.y", "url_base": "https://h/", "fields": {
                "address": {"path": "addr.line", "transform": "text"}, "beds": "b", "lat": {"path": "geo.0"}}})),
            ("b", json.dumps({"data_path": "d", "script_id": "S", "total_path": "t"})), ("c", "not json"), ("d", None)]
    rows = embedded.layout_rows(spark.createDataFrame(said, "source string, settings string"), F.col("settings"))
    assert embedded.layout_of(rows, "a") == embedded.Layout(
        "x.y", [("address", "addr.line", "text"), ("beds", "b", "raw"), ("lat", "geo.0", "raw")], "", "https://h/")
    assert embedded.layout_of(rows, "b") == embedded.Layout("d", [], "t", "", "S")
    assert embedded.layout_of(rows, "c") == embedded.layout_of(rows, "d") == embedded.Layout("", [])
    assert embedded.layout_of(rows, "a").rule("agent") == ("", "raw")


def page(body, script_id="__NEXT_DATA__"):
    text = body if isinstance(body, str) else json.dumps(body)
    return f'<html><SCRIPT id="x">1</SCRIPT><script type="a" id="{script_id}">{text}</script></html>'


def frame(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def test_records_from_a_page(spark):
    df = frame(spark, page({"props": [{"records": RECORDS, "total": 9}]}))
    got = embedded.extract_records(df, F.col("html"), SPEC, ["page_id"]).orderBy("position").collect()
    a, b, c, d = got
    assert (a["address"], a["sold_price"], a["sold_date"], a["lat"]) == ("12 Elm St", 550000.0, dt.date(2026, 8, 28), 40.5)
    assert a["lot_sqft"] == pytest.approx(0.27 * 43560) and a["lot_size_is_rounded"]
    assert (a["agent"], a["brokerage"], a["source_url"]) == ("Jane Roe", "Some Firm", "https://idx.example/p/1")
    assert (b["sold_price"], b["lot_sqft"], b["lot_size_is_rounded"], b["lat"], b["beds"]) == (610000.0, 5227.0, False, None, 3.0)
    assert (b["agent"], b["brokerage"], b["source_url"]) == (None, "Sender Realty, Inc.", "https://IDX.example/p/2")
    assert not c["has_address"] and c["source_url"] is None and c["url_problem"].startswith("dropped a URL pointing away")
    assert (d["sold_price"], d["lot_sqft"], d["url_problem"]) == (1200000.0, None, "dropped a ftp URL")


def test_page_outcomes(spark):
    good = {"props": [{"records": RECORDS, "total": 3}]}
    df = frame(
        spark, page(good), page({"props": [{"records": RECORDS[:2], "total": "166 homes"}]}), page("{oops"),
        page({"props": [{"records": "none", "total": 1}]}), page({"props": [{"records": [], "total": True}]}),
        "<p>Pardon our Interruption</p>" + page(good))
    got = embedded.page_outcomes(df, F.col("html"), SPEC, ["page_id"]).orderBy("page_id").collect()
    assert [r["problem"] for r in got] == [
        None, "incomplete page", "no readable script block", "no list of records", "unusable total", "challenge page"]
    assert [r["records"] for r in got] == [3, 2, 0, 0, 0, 0] and got[1]["claimed_total"] == 166


def test_first_script_of_an_id_decides(spark):
    html = page("{bad") + page({"props": []})
    assert frame(spark, html).select(embedded.script_block(F.col("html"), "__NEXT_DATA__").isNull()).first()[0]


def test_index_side_is_declared(spark):
    df = frame(spark, page({"props": [{"records": RECORDS, "total": 3}]}))
    ident = F.struct(F.lit(True).alias("requires_absent_bed_bath"), F.array(F.lit("LAND")).alias("type_labels"))
    args = (df, F.col("html"), SPEC, ident)
    sold = embedded.read_index(*args, "sold", ["page_id"]).orderBy("position").collect()
    assert [r["address"] for r in sold] == ["12 Elm St", "16 Elm St"] and sold[0]["sources"] == ["https://idx.example/p/1"]
    listed = embedded.read_index(*args, "active", ["page_id"]).orderBy("position").collect()
    assert listed[0]["list_price"] == 550000.0 and listed[0]["agent"] == "Jane Roe"


def test_ld_json_blocks_skip_the_unreadable(spark):
    tag = '<script type="application/ld+json">'
    df = frame(spark, f'{tag}{{"a":[{{"b":5}}]}}</script>{tag}{{x</script>{tag}[1]</script>')
    got = embedded.ld_json_blocks(df, F.col("html"), ["page_id"])
    rows = got.select("position", embedded.dig(F.col("block"), "a.0.b").alias("v")).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [(0, "5"), (2, None)]


def test_reduced_page(spark):
    html = (
        "<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>var x='<p>no</p>';</script>"
        "<p>One   two</p><svg><p>hidden</p></svg><table><tr><td>3</td><td>4</td></tr></table>\n\n\n"
        '<script type="application/ld+json"> {"k": 1} </script><noscript>off</noscript><div>end</div></body></html>')
    rows = frame(spark, html).withColumn("k", F.lit(1))
    got = pages.reduced_pages(rows, ["k"]).first()["body"]
    assert got.startswith("PAGE TITLE: A & B\n\nA & B\n")
    assert got.endswith('end\n\nEMBEDDED STRUCTURED DATA:\n{"k": 1}')
    assert "One two" in got and "3\n\n4" in got and not any(x in got for x in ("hidden", "off", "var x", "p{}"))
    short = pages.reduced_pages(rows, ["k"], max_chars=10).first()["body"]
    assert short == got[:10] + "\n\n[TRUNCATED - page exceeded the size limit]"
    assert not pages.reduced_pages(rows, ["k"], keep_data_blocks=False).first()["body"].endswith("}")


@pytest.mark.parametrize("html, body", [
    (None, None), ("", ""), ("plain", "plain"), ("1 < 2 <b>x</b>", "1 < 2 x"),
    ("a<svg><svg>b</svg>c</svg>d", "a d"),                       # nested
    ("a</svg></iframe>b<template>c</template>d", "a b d"),       # closings of nothing do not count
    ("a<svg>b<p>c", "a"), ("a<svg/>b", "a b"),                   # never closed; closed at once
    ('<a title="x > y">z</a>', "z"), ("a<!-- <p>b --><p>c", "a\nc"), ("a<!-- b", "a"),
    ("<script>if (a < b) { '<p>' }</script>c", "c"), ("<script>open", ""),
    ('<script id=n type="application/json"></script>', ""),
    ("<title>T &lt; U</title>", "PAGE TITLE: T < U\n\nT < U"),
    ("&#65;&#x42;&#x80;&#0;&#xD800;&#1114112;&#x1F600;", "AB\u20ac\ufffd\ufffd\ufffd\U0001f600"),
    ("&ampfoo; &notit; &nope; & &copy x", "&foo; \u00acit; &nope; & \u00a9 x"),
    ("a<br/>b<br>c<p", "a\n\nb\nc"),
])
def test_page_text_of_broken_markup(spark, html, body):
    rows = spark.createDataFrame([(1, html)], "k int, html string")
    assert pages.reduced_pages(rows, ["k"]).first()["body"] == body


def test_long_page_is_read_to_its_end(spark):
    html = "<p>x</p>" * 30_000 + '<script type="application/ld+json">{"k": 1}</script>'
    got = pages.reduced_pages(frame(spark, html).withColumn("k", F.lit(1)), ["k"]).first()["body"]
    assert got.count("x") == 30_000 and got.endswith('DATA:\n{"k": 1}')


def test_freshest_page_within_its_time(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, "u", "1", at(0)), (2, "u", "1", at(100)), (3, "u", "2", at(50)), (4, "v", "1", at(-21600)), (5, "w", "1", at(500))]
    df = spark.createDataFrame(rows, "page_id int, url string, adapter_version string, fetched_at timestamp")
    fresh = pages.fresh_pages(df, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    assert sorted(r["page_id"] for r in fresh.collect()) == [2, 3, 5]
    asked = spark.createDataFrame([("u", "1"), ("v", "1"), ("q", "9")], "url string, adapter_version string")
    assert tuple(pages.cache_counters(asked.withColumn("k", F.lit(1)), fresh, ["k"]).first()) == (1, 1, 2)


def test_recorded_files(spark, tmp_path):
    (tmp_path / "sold.json").write_text(json.dumps([
        {"address": "1 Elm St", "sold_date": "2026-06-04T10:00:00", "sold_price": 5, "lot_sqft": None, "extra": 1},
        {"address": "2 Elm St", "area": "NE", "lot_size_is_rounded": True, "sources": ["s"]}], indent=1))
    (tmp_path / "homes.sold.json").write_text('[{"address": "9 Oak St", "beds": 3}]')
    (tmp_path / "active.json").write_text('[{"address": "3 Elm St", "list_price": 7, "listed_date": "2026-01-02"}]')
    folder = str(tmp_path)
    sold, active = recorded.read_recording(spark, folder, "m", "lots")
    a, b = sold.orderBy("row_ord").collect()
    assert (a["address"], a["sold_date"], a["sold_price"], a["lot_sqft"], a["sources"]) == (
        "1 Elm St", dt.date(2026, 6, 4), 5.0, None, [])
    assert (b["area"], b["lot_size_is_rounded"], a["lot_size_is_rounded"], b["sources"]) == ("NE", True, False, ["s"])
    assert active.first()["listed_date"] == dt.date(2026, 1, 2)
    homes, none = recorded.read_recording(spark, folder, "m", "homes")
    assert homes.first()["address"] == "9 Oak St" and none.count() == 0
    with pytest.raises(recorded.RecordingMissing):
        recorded.read_recording(spark, str(tmp_path / "nowhere"), "m", "lots")


def claims(spark, *rows):
    full = [dict(market="m", profile="lots", claim_ord=i, address="1 Elm St", field_name="agent", value="Jo",
                 source_url=f"u{i}", claimed_price=None, claimed_date=None) | r for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.CLAIM)


def judged(spark, *rows, **options):
    prof = h.profiles(spark)
    base = measures.with_keys(h.sold(spark, [
        {"address": "1 Elm St", "sold_price": 550000, "sold_date": h.day("2026-08-10")},
        {"address": "2 Elm St", "sold_price": None, "agent": "Known"}]), prof)
    return base, verify.judge_claims(base, claims(spark, *rows), prof, **options)


def test_verdicts(spark):
    ok = {"claimed_price": 550100.0}
    _, got = judged(
        spark, ok, {**ok, "value": "Ann"}, {"claimed_price": 500000.0}, {}, {"claimed_date": h.day("2026-08-10")},
        {**ok, "claimed_date": h.day("1998-01-01")}, {**ok, "value": "Out Of Area Out Of Area"}, {**ok, "address": "9 Far St"},
        {**ok, "field_name": "lot_sqft", "value": "-"}, {**ok, "address": "2 Elm Street"},
        {**ok, "address": "1 Elm St #5", "field_name": "lot_sqft", "value": "5000", "claimed_date": h.day("2026-08-28")})
    rows = got.orderBy("claim_ord").collect()
    assert [r["outcome"] for r in rows] == [
        "accepted", "known", "rejected", "rejected", "rejected", "rejected", "rejected", "unverifiable", "skipped",
        "rejected", "accepted"]
    assert rows[2]["reason"] == "price 500,000 does not match the known 550,000"
    assert rows[3]["reason"] == "no evidence offered: neither a price nor a date"
    assert rows[4]["reason"] == "no price offered, and a date alone is not enough"
    assert "far from the known 2026-08-10" in rows[5]["reason"]
    assert rows[6]["reason"] == "placeholder name, not a real party"
    assert rows[9]["reason"] == "no known price to check"


def test_a_date_alone_on_request(spark):
    _, got = judged(spark, {"claimed_date": h.day("2026-08-13")}, {"claimed_date": h.day("2026-08-14")}, require_date=True)
    assert [r["outcome"] for r in got.orderBy("claim_ord").collect()] == ["accepted", "rejected"]


def test_claims_fill_and_never_overwrite(spark):
    ok = {"claimed_price": 550000.0}
    base, got = judged(spark, ok, {**ok, "value": "Ann"}, {**ok, "field_name": "lot_sqft", "value": "5000", "source_url": "u0"})
    one = verify.apply_claims(base, got).orderBy("row_ord").first()
    assert (one["agent"], one["lot_sqft"], one["sources"]) == ("Jo", 5000.0, ["u0"])


def test_facts_become_claims(spark):
    base = dict.fromkeys(f.name for f in schemas.FACTS.fields) | dict(
        market="m", profile="lots", row_ord=3, address="1 Elm St", url="u", stated_sold_price=5.0)
    rows = [
        {**base, "listing_agent": "Jo", "dual_agency_stated": True, "lot_sqft": 50.0, "buyer_agent": "", "stated_sold_date": "2026-08-01x"},
        {**base, "listing_agent": "Al", "page_is_about_a_different_property": True}]
    got = verify.claims_from_facts(spark.createDataFrame(rows, schemas.FACTS)).orderBy("claim_ord").collect()
    assert [(r["field_name"], r["value"]) for r in got] == [("agent", "Jo"), ("lot_sqft", "50.0"), ("buyer_agent", "Jo")]
    assert got[0]["claimed_date"] == dt.date(2026, 8, 1)


def test_claims_are_keyed_once_per_page_and_checked_once(spark):
    prof = h.profiles(spark)
    base = measures.with_keys(h.sold(spark, [{"address": "1 Elm St", "sold_price": 550000}]), prof)
    page = {f.name: None for f in schemas.FACTS} | {
        "market": "m", "profile": "lots", "address": "1 Elm Street", "stated_sold_price": 550100.0, "lot_sqft": 50.0}
    pages_ = spark.createDataFrame(
        [{**page, "row_ord": 0, "listing_agent": "Jo"}, {**page, "row_ord": 1, "listing_agent": "Al"}], schemas.FACTS)
    keyed = verify.claims_from_facts(pages_, prof)
    assert {r["addr_key"] for r in keyed.collect()} == {"1 elm st"}
    got = verify.judge_claims(base, keyed, prof)
    plain = verify.judge_claims(base, verify.claims_from_facts(pages_), prof)
    order = ["claim_ord", "outcome"]
    assert got.orderBy(*order).collect() == plain.orderBy(*order).collect()
    assert [r["outcome"] for r in got.orderBy("claim_ord").collect()] == ["accepted", "accepted", "known", "known"]
    # The outcomes come from what was stored, so nothing is read or checked a second time.
    assert got.inputFiles() and all(WRITTEN in f for f in got.inputFiles())


def test_a_page_meets_the_known_sale_before_it_becomes_claims(spark):
    """One row per page is joined, its claims are judged as before, and only what is asked for is stored."""
    prof = h.profiles(spark)
    base = measures.with_keys(h.sold(spark, [
        {"address": "1 Elm St", "sold_price": 550000, "agent": "Known"}, {"address": "2 Elm St", "sold_price": 410000},
        {"address": "2 Elm Street", "sold_price": 300000, "sold_date": h.day("2026-08-10"), "lot_sqft": 5.0},
        {"address": "3 Elm St"}]), prof)
    page = {f.name: None for f in schemas.FACTS} | {"market": "m", "profile": "lots", "url": "u"}
    said = [
        {"address": "1 Elm St", "stated_sold_price": 550100.0, "listing_agent": "Jo", "buyer_agent": "", "lot_sqft": 50.0},
        {"address": "1 Elm St #4", "stated_sold_price": 550100.0, "listing_agent": "Al", "dual_agency_stated": True, "lot_sqft": 60.0},
        {"address": "2 Elm St", "stated_sold_price": 300100.0, "listing_agent": "N/A  n/a", "listing_brokerage": "\u2014", "buyer_agent": " . "},
        {"address": "2 Elm St", "stated_sold_price": 300100.0, "listing_agent": "out of area. Out  of Area", "dual_agency_stated": True,
         "living_sqft": float("nan"), "lot_sqft": 7.0, "stated_sold_date": "1999-01-01"},
        {"address": "2 Elm St", "stated_sold_price": 410000.0, "listing_agent": "Jo", "final_list_price": 5.0},
        {"address": "3 Elm St", "stated_sold_price": 1.0, "listing_agent": "Jo"},
        {"address": "9 Far St", "stated_sold_price": 1.0, "listing_agent": "Jo", "dual_agency_stated": True},
        {"address": None, "listing_agent": "Jo"}, {"address": "1 Elm St", "listing_brokerage": "Firm", "stated_sold_date": "2026-08-10"}]
    pages_ = spark.createDataFrame([{**page, "row_ord": i, **x} for i, x in enumerate(said)], schemas.FACTS)
    plain = verify.judge_claims(base, verify.claims_from_facts(pages_), prof)
    met = verify.claims_from_facts(pages_, prof, base)
    got = verify.judge_claims(base, met, prof)
    row = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
    assert row(got) == row(plain) and plain.count() == 19
    joins = [x for x in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x or "Join LeftOuter" in x]
    assert "Generate" in joins[0] and "LeftOuter" in joins[1]
    some = verify.judge_claims(base, met, prof, ["value"], ["accepted"])
    assert some.columns == ["market", "profile", "claim_ord", "row_ord", "field_name", "value", "outcome"]
    both = lambda df: sorted(tuple(r) for r in df.where("outcome = 'accepted'").select("claim_ord", "value").collect())
    assert both(some) == both(plain)
    stored = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in some.inputFiles()})
    assert {r["outcome"] for r in stored.select("outcome").collect()} == {"accepted"}


def test_geocodes_take_the_fallback_only_when_needed(spark):
    rows = [
        ("m", "1 Elm St", "primary", "1 Elm St", 1.0, 1.0, "1 ELM ST", None), ("m", "1 Elm St", "fallback", "1 Elm St", 2.0, 2.0, "1 ELM ST", 99.0),
        ("m", "2 Elm Vista Rd", "primary", "2 Elm Vista Rd", 1.0, 1.0, "2 ELM ST", None),
        ("m", "2 Elm Vista Rd", "fallback", "2 Elm Vista Rd", 2.0, 2.0, "2 ELM VISTA", 90.0),
        ("m", "3 Oak St", "primary", "3 Oak St", None, None, "", None), ("m", "3 Oak St", "fallback", "3 Oak St", 2.0, 2.0, "3 OAK", 84.4),
        ("m", "4 Fir St", "primary", "4 Fir St", 9.0, 9.0, "4 FIR", None)]
    answers = verify.judge_geocodes(spark.createDataFrame(
        rows, "market string, address string, service string, query string, lat double, lon double, matched_address string, score double"))
    sold = h.sold(spark, [{"address": "1 Elm St"}, {"address": "2 Elm Vista Rd", "lat": 5}, {"address": "3 Oak St"},
                          {"address": "4 Fir St", "lat": 7, "lon": 7}])
    got = verify.fill_geocodes(sold, answers).orderBy("row_ord").collect()
    assert [(r["lat"], r["geocoded"]) for r in got] == [(1.0, True), (2.0, True), (None, False), (7.0, False)]
    gone = {(r["address"], r["service"]): r["rejected"] for r in verify.geocode_rejections(sold, answers).collect()}
    assert gone == {
        ("2 Elm Vista Rd", "primary"): "matched a different street: 2 ELM ST", ("3 Oak St", "primary"): "no match",
        ("3 Oak St", "fallback"): "low confidence (84)"}


def test_market_file_as_tables(spark):
    t = config.market_tables(spark, {
        "market": {"name": "m", "default_profile": "a"},
        "profiles": {"a": {"window_days": 60, "subject": {"lot_sqft": 6450}, "similar_bracket": {"explicit_range": [5000, 8000]}},
                     "b": {"metric": "living_sqft", "exclusions": {"max_lot_sqft": None}}},
        "geometry": {"ns_centerline": [{"lon": -100, "lat": 40}], "ew_longitude": -100},
        "sources": [{"name": "idx", "side": "active", "search": "x", "embedded": {"fields": {"beds": "b"}}}]})
    rows = {r["profile"]: r for r in t["profiles"].collect()}
    assert (rows["a"]["similar_bracket"]["explicit_low"], rows["a"]["window_days"]) == (5000.0, 60)
    assert rows["b"]["exclusions"]["max_lot_sqft"] is None and rows["b"]["exclusions"]["core_max_ppsf"] == 150.0
    s = t["sources"].first()
    assert (s["enabled"], s["rate_limit_seconds"], s["side"], s["config"]) == (True, 2.0, "active", {"search": "x", "embedded": '{"fields":{"beds":"b"}}'})
    assert rows["b"]["similar_bracket"]["tolerance"] == 0.25 and rows["b"]["metric"] == "living_sqft"
    first, second = t["subjects"].orderBy("subject_id").collect()
    assert (first["lot_sqft"], first["label"], first["profile"]) == (6450.0, "Your property", "a")
    assert (second["lot_sqft"], second["profile"], second["market"]) == (None, "b", "m")
    g = t["geometry"].first()
    assert (g["ew_longitude"], g["ns_centerline"][0].asDict()) == (-100.0, {"name": "", "lon": -100.0, "lat": 40.0})
    assert t["markets"].first()["fixture_dir"] == "fixtures"
    with pytest.raises(ValueError):
        config.market_tables(spark, {"market": {}})


def test_only_answers_that_a_gap_asks_for_are_judged(spark):
    rows = spark.createDataFrame(
        [("m", "1 Elm St", None, 1.0), ("m", "2 Elm St", 1.0, 1.0), ("m", None, None, None), ("n", "1 Elm St", 1.0, 1.0)],
        "market string, address string, lat double, lon double")
    answers = spark.createDataFrame(
        [(m, a, s, a, 40.0, -100.0, a and a.upper(), None) for m, a in (("m", "1 Elm St"), ("m", "2 Elm St"), ("m", None), ("n", "1 Elm St"))
         for s in ("primary", "fallback")],
        "market string, address string, service string, query string, lat double, lon double, matched_address string, score double")
    asked = verify.asked_geocodes(rows, answers)
    assert sorted((r["market"], r["address"], r["service"]) for r in asked.collect()) == [
        ("m", "1 Elm St", "fallback"), ("m", "1 Elm St", "primary")]
    wrong = answers.withColumn("matched_address", F.lit("9 Oak St"))
    whole, fewer = (verify.geocode_rejections(rows, verify.judge_geocodes(x)).collect()
                    for x in (wrong, verify.asked_geocodes(rows, wrong)))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, fewer)) and len(whole) == 2
