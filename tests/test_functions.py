import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketval.functions import address, clock, parse, rates, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def each(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_addresses_that_are_one_identity(spark):
    keys = each(spark, address.normalize_address, [
        "0 N Alder Ave", "0 North Alder Avenue", "0 N. Alder Ave.", "  0  n alder   av ",
        "9100 Quarry Rd, Townsville, ZZ 00000", "410 Bell Rd #2", "410 Bell Rd, Apt 2, Townsville",
        "410 Bell Road Unit 2", "", None, "12 Main St W", "5 Street Avenue", "10 East West Rd", "7 Cyn Rd",
    ])
    assert keys == [
        "0 n alder ave"] * 4 + ["9100 quarry rd", "410 bell rd #2", "410 bell rd #2", "410 bell rd #2",
        "", "", "12 main st w", "5 street ave", "10 e west rd", "7 cyn rd"]


def test_street_words_by_place_against_plain_python(spark):
    from itertools import product

    from marketval.constants import DIRECTIONS, STREET_TYPES

    said = ["", *(" ".join(x) for n in (1, 2, 3, 4) for x in product(["7", "north", "street", "east", "elm"], repeat=n))]

    def plain(text):
        words, out = text.split(), []
        for i, w in enumerate(words):
            last = i == len(words) - 1
            to = DIRECTIONS.get(w) if i <= 1 or last else None
            out.append(to or (STREET_TYPES.get(w) if last else None) or w)
        return " ".join(out)

    assert each(spark, address.street_part, said) == [plain(x) for x in said]


def test_keys_run_no_function_over_word_lists(spark):
    from marketval.operators import measures

    schema = "market string, profile string, identification struct<unit_suffix_is_significant: boolean>"
    profiles = spark.createDataFrame([("m", "lots", (True,)), ("m", "homes", (None,))], schema)
    rows = spark.createDataFrame(
        [("m", "lots", "5 North Elm Street #2"), ("m", "homes", "5 N Elm St #2"), ("m", "lots", None), ("m", "homes", "#2")],
        "market string, profile string, address string")
    keyed = measures.with_keys(rows, profiles)
    assert "lambda" not in keyed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert keyed.columns == ["market", "profile", "address", "addr_key", "addr_key_unit", "addr_key_bare"]
    assert {tuple(r)[1:] for r in keyed.collect()} == {
        ("lots", "5 North Elm Street #2", "5 n elm st #2", "5 n elm st #2", "5 n elm st"),
        ("homes", "5 N Elm St #2", "5 n elm st", "5 n elm st #2", "5 n elm st"),
        ("lots", None, "", "", ""), ("homes", "#2", "", "#2", ""),
    }


def test_unit_is_dropped_on_request(spark):
    assert each(spark, lambda c: address.normalize_address(c, False), ["410 Bell Rd #2", "#7"]) == ["410 bell rd", ""]


def test_street_match_needs_every_asked_word(spark):
    df = spark.createDataFrame(
        [("12 Larch Vista Rd", "12 LARCH ST"), ("12 N Larch Vista Rd", "LARCH VISTA ROAD, TOWN"), ("12", "x")],
        "q string, m string")
    got = [r[0] for r in df.select(address.street_matches(F.col("q"), F.col("m"))).collect()]
    assert got == [False, True, True]


@pytest.mark.parametrize("said, want", [
    ("$550,000", 550000.0), ("$1.2M", 1200000.0), ("$550K", 550000.0), ("", None), ("call us", None),
    ("-3.5", -3.5), (" 1,234,567 ", 1234567.0), (".5m", 500000.0)])
def test_money(spark, said, want):
    assert one(spark, parse.as_money(F.col("v")), v=said) == want


def test_dates(spark):
    d = dt.date(2026, 8, 28)
    got = each(spark, parse.as_date, [
        "2026-08-28", "AUG 28, 2026", "August 28, 2026", "8/28/2026", "Aug. 28, 2026", "28 Aug 2026",
        "2026-13-01", " Aug 28, 2026 ", "Aug 28,2026", None])
    assert got == [d, d, d, d, None, None, None, d, None, None]


def test_sizes(spark):
    got = [tuple(x) for x in each(spark, parse.as_sqft, [
        "0.27 acres", "5,227 sq ft", "1 ac lot", "900 square feet", "12", "1" * 120 + " acres", None])]
    assert got == [(0.27 * 43560, True), (5227.0, False), (43560.0, True), (900.0, False), (None, False),
                   (float("1" * 120) * 43560, True), (None, False)]
    long = ["x" * 120 + " 5,227 sq ft", "1 ac"]
    assert [x[0] for x in each(spark, lambda c: parse.as_sqft(c, 100), long)] == [None, 43560.0]
    assert [x[0] for x in each(spark, parse.as_sqft, ["1," * 200_000 + "x 2 acres"])] == [2 * 43560.0]


def test_attribution(spark):
    got = [tuple(x) for x in each(spark, parse.split_attribution, [
        "Jane Roe DRE # 01234567, Some Brokerage", "Sender Realty, Inc.", "Jo Li Lic. 5", "", "  ",
        "CalBRE 9, Firm, Inc.", "Alice Deere"])]
    assert got == [("Jane Roe", "Some Brokerage"), (None, "Sender Realty, Inc."), ("Jo Li", None),
                   (None, None), (None, None), (None, "Firm, Inc."), (None, "Alice Deere")]


def test_names(spark):
    got = each(spark, text.clean_name, [
        "Out Of Area", "out of area Out Of Area", " unknown  unknown ", "N/A.", "Jane  Roe", "", None, "—", "Anna Anna"])
    assert got == [None, None, None, None, "Jane Roe", None, None, None, "Anna Anna"]


def test_families_take_the_first_rule(spark):
    rules = [("A", ["Alpha*", "[xy]?z"]), ("B", ["Al*"]), ("C", ["*[!0-9]"])]
    got = each(spark, lambda c: text.family_of(c, rules), ["alpha one", "Alto", "xaz", "house 7", "word", "", None])
    assert got == ["A", "B", "A", "house 7", "C", None, None]


def test_formula_text_and_safe_names(spark):
    assert each(spark, text.text_safe, ["=A1", "+1", "-x", "@y", "ok", " =A1", None]) == [
        "'=A1", "'+1", "'-x", "'@y", "ok", " =A1", None]
    assert each(spark, text.safe_name, ["a b/c", "..", " x. ", "-é-"]) == ["a-b-c", "unnamed", "x", "unnamed"]


def test_rates_treat_zero_as_missing(spark):
    assert one(spark, rates.per_sqft(F.col("p"), F.col("s")), p=100.0, s=0.0) is None
    assert one(spark, rates.per_sqft(F.col("p"), F.col("s")), p=0.0, s=5.0) is None
    assert one(spark, rates.sold_to_ask(F.col("p"), F.col("s")), p=122.0, s=100.0) == 1.22


def test_closeness_is_three_valued(spark):
    pairs = [(100.0, 100.4), (100.0, 101.0), (None, 1.0), (0.0, 0.0), (0.0, 1.0), (-5.0, 5.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    got = [r[1] for r in df.select("i", rates.close(F.col("a"), F.col("b"), 0.005)).orderBy("i").collect()]
    assert got == [True, False, None, True, False, False]


def test_claimed_price_and_date(spark):
    df = spark.createDataFrame(
        [(0, 550000.0, 550100.0), (1, 550000.0, 500000.0), (2, None, 1.0), (3, 0.0, 0.0), (4, 0.0, 1.0)],
        "i int, k double, c double")
    got = [r[1] for r in df.select("i", rates.prices_match(F.col("k"), F.col("c"))).orderBy("i").collect()]
    assert got == [True, False, False, True, False]
    base = F.lit("2026-08-10").cast("date")
    days = [one(spark, rates.dates_match(base, F.date_add(base, n)), v="") for n in (0, 3, 4, -2)]
    assert days == [True, True, False, True]


def test_clock(spark):
    moment = F.lit("2026-09-05 05:30:00").cast("timestamp")
    assert one(spark, clock.local_stamp(moment, "America/Los_Angeles"), v="") == "2026-09-04 10:30 PM"
    assert one(spark, clock.local_date(moment, "America/Los_Angeles"), v="") == dt.date(2026, 9, 4)


def _focus(body, terms, window, max_chars, head, short=None):
    """Brute force: every hit by search, windows merged, cut at the limit."""
    if len(body) <= (max_chars if short is None else short):
        return body
    spans = [(0, min(head, len(body)))]
    for term in terms:
        at = body.lower().find(term)
        while at >= 0:
            spans.append((max(0, at - window // 2), min(len(body), at + window)))
            at = body.lower().find(term, at + len(term))
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    pieces, left = [], max_chars
    for a, b in out:
        if left <= 0:
            break
        pieces.append(body[a:b][:left])
        left -= len(pieces[-1])
    return "\n[...]\n".join(pieces)


def test_focus_text_against_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["sold by", "Sq Ft", "lorem", "é", "ipsum dolor", "x" * 40, "listing agent", "acresacres", "\n"]
    bodies = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 5, 60, 200, 400, 900)]
    terms = ["sold by", "sq ft", "listing agent", "acres"]
    for args in [(terms, 60, 500, 50), (terms, 31, 200, 0), (["zzz"], 60, 100, 70)]:
        got = each(spark, lambda c: text.focus_text(c, *args), bodies)
        assert got == [_focus(b, *args) for b in bodies]
    whole = each(spark, lambda c: text.focus_text(c, terms, 60, None, 50, short=100), bodies)
    assert whole == [_focus(b, terms, 60, 10**6, 50, 100) for b in bodies]


def test_block_signals_are_plain_text_searched_without_a_pattern(spark):
    signs = ["please solve the CAPTCHA", "Access Denied", "x" * 4000 + "captcha", "captch", "", None]
    assert each(spark, text.is_block_page, signs) == [True, True, False, False, False, None]
    shown = spark.range(1).select(text.is_block_page(F.concat(F.lit("id "), F.col("id").cast("string"))))
    assert "RLIKE" not in shown._jdf.queryExecution().toString().upper()
