"""Queries over rows: keys, predicates, merging, windows, verification, geocodes."""

from pyspark.sql import functions as F

from marketval.constants import MAX_DIMENSION_CHARS
from marketval.functions import address as adr
from marketval.functions import clock, parse, rates, text
from marketval.operators import areas, cleaning, compare, dedup, measures, quality, verify
from marketval.operators.sizing import DATASET, written
from workload import tables as t
from workload.oracle import (
    EARLIER,
    FACTS,
    clean_name_sql,
    family_sql,
    lastkey_sql,
    missing_from,
    reason_sql,
    street_sql,
    unit_sql,
)
from workload.registry import query
from workload.tables import Workload

ID = "market, profile, row_ord"


def sold_k(w: Workload):
    return measures.with_keys(w.sold, w.profiles)


def active_k(w: Workload):
    return measures.with_keys(w.active, w.profiles)


def sold_m(w: Workload):
    return measures.sold_measures(w.sold, w.profiles)


def active_m(w: Workload):
    return measures.active_measures(w.active, w.profiles)


def end():
    return F.lit(t.END).cast("date")


# -- scalars -----------------------------------------------------------------------------------

@query("sca1_normalize_address", f"""
SELECT {ID}, address, concat_ws(' ', nullif({street_sql("address")}, ''), nullif({unit_sql("address")}, '')) AS with_unit,
  {street_sql("address")} AS without_unit FROM sold""")
def _(w):
    a = F.col("address")
    return w.sold.select(
        *DATASET, "row_ord", "address", adr.normalize_address(a, True).alias("with_unit"),
        adr.normalize_address(a, False).alias("without_unit"),
    )


@query("sca2_keys_by_profile", f"SELECT {ID}, addr_key, addr_key_unit, addr_key_bare FROM active_k")
def _(w):
    return active_k(w).select(*DATASET, "row_ord", "addr_key", "addr_key_unit", "addr_key_bare")


@query("sca3_acres_to_sqft", "SELECT p_partkey, p_size * 43560e0 AS sqft FROM part", "sqft")
def _(w):
    return w.raw("part").select("p_partkey", rates.acres_to_sqft(F.col("p_size")).alias("sqft"))


@query("sca4_completeness", """
SELECT market, profile, score, count(*) AS n FROM (
  SELECT market, profile, CAST(lot_sqft IS NOT NULL AS INT) + CAST(living_sqft IS NOT NULL AS INT)
    + CAST(brokerage IS NOT NULL AS INT) + CAST(agent IS NOT NULL AS INT)
    + CAST(final_list_price IS NOT NULL AS INT) + CAST(sold_date IS NOT NULL AS INT)
    + CAST(lat IS NOT NULL AS INT) AS score FROM sold) GROUP BY ALL""")
def _(w):
    rows = w.sold.select(*DATASET, dedup.row_completeness().alias("score"))
    return rows.groupBy(*DATASET, "score").agg(F.count(F.lit(1)).alias("n"))


@query("sca5_three_valued_closeness", """
SELECT market, profile, verdict, count(*) AS n FROM (
  SELECT market, profile, CASE WHEN sold_price IS NULL OR final_list_price IS NULL THEN 'unknown'
    WHEN sold_price = final_list_price OR coalesce(abs(sold_price - final_list_price) /
      nullif(greatest(abs(sold_price), abs(final_list_price)), 0) <= 0.05e0, FALSE) THEN 'close'
    ELSE 'apart' END AS verdict FROM sold) GROUP BY ALL""")
def _(w):
    near = rates.close(F.col("sold_price"), F.col("final_list_price"), 0.05)
    word = F.when(near.isNull(), "unknown").when(near, "close").otherwise("apart")
    return w.sold.select(*DATASET, word.alias("verdict")).groupBy(*DATASET, "verdict").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("sca6_same_sale_as_key_opener", """
SELECT s.market, s.profile, s.row_ord, coalesce(CASE WHEN s.sold_price IS NULL OR f.p IS NULL THEN NULL
    WHEN s.sold_price = f.p THEN TRUE ELSE coalesce(abs(s.sold_price - f.p) /
      nullif(greatest(abs(s.sold_price), abs(f.p)), 0) <= 0.005e0, FALSE) END, TRUE)
  AND coalesce(CASE WHEN s.lot_sqft IS NULL OR f.s IS NULL THEN NULL WHEN s.lot_sqft = f.s THEN TRUE
    ELSE coalesce(abs(s.lot_sqft - f.s) / nullif(greatest(abs(s.lot_sqft), abs(f.s)), 0) <= 0.05e0, FALSE)
    END, TRUE) AS same
FROM sold_k s JOIN (SELECT market, profile, addr_key, arg_min({'p': sold_price, 's': lot_sqft}, row_ord).p AS p,
    arg_min({'p': sold_price, 's': lot_sqft}, row_ord).s AS s FROM sold_k GROUP BY ALL) f USING (market, profile, addr_key)""")
def _(w):
    rows = sold_k(w)
    key = [*DATASET, "addr_key"]
    first = rows.groupBy(*key).agg(
        F.min_by(F.struct("sold_price", "lot_sqft"), F.col("row_ord")).alias("_f")
    )
    same = rates.same_sale(
        F.col("_f.sold_price"), F.col("_f.lot_sqft"), F.col("sold_price"), F.col("lot_sqft")
    )
    return rows.join(first, key).select(*DATASET, "row_ord", same.alias("same"))


@query("sca8_money_text", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice / 1000) * 1000
  WHEN 2 THEN floor(o_totalprice / 100000) / 10 * 1000000 END AS amount FROM orders""", "amount")
def _(w):
    p = F.col("o_totalprice")
    said = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("$"), F.format_number(F.floor(p), 0)))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" $"), F.floor(p / 1000).cast("string"), F.lit("K ")))
        .when(
            F.col("o_orderkey") % 4 == 2,
            F.concat(F.lit("about $"), (F.floor(p / 100000) / 10).cast("string"), F.lit("M")),
        )
        .otherwise(F.lit("price on request"))
    )
    return w.raw("orders").select("o_orderkey", parse.as_money(said).alias("amount"))


@query("sca9_sca10_date_text", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS tag_day FROM orders""")
def _(w):
    d = F.col("o_orderdate")
    said = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 1, F.upper(F.date_format(d, "MMM d, yyyy")))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(d, "MMMM dd, yyyy"))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(d, "M/d/yyyy"))
        .otherwise(F.date_format(d, "d MMMM yyyy"))
    )
    tag = F.upper(F.date_format(d, "MMM d, yyyy"))
    tags = (
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("SOLD"), F.date_format(d, "yyyy-MM-dd")))
        .when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("SOLD"), F.lit("No Date"), tag))
        .otherwise(F.array(tag, F.lit("NEW")))
    )
    return w.raw("orders").select(
        "o_orderkey", parse.as_date(said).alias("day"), parse.as_tag_date(tags).alias("tag_day")
    )


@query("sca11_dimension_text", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 0.25e0 * 43560e0 WHEN 1 THEN p_size * 1000e0 END AS sqft,
  p_partkey % 4 = 0 AS from_acres FROM part""", "sqft")
def _(w):
    n = F.col("p_size")
    said = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("lot "), (n * 0.25).cast("string"), F.lit(" Acres")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.format_number(n * 1000, 0), F.lit(" sq ft")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.repeat(F.lit("1"), F.lit(120)), F.lit(" acres")))
        .otherwise(F.lit("size unknown"))
    )
    size = parse.as_sqft(said, MAX_DIMENSION_CHARS)
    return w.raw("part").select("p_partkey", size["sqft"].alias("sqft"), size["from_acres"].alias("from_acres"))


@query("sca12_attribution_text", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 IN (0, 1) THEN s_name END AS agent,
  CASE s_suppkey % 4 WHEN 0 THEN 'Harbor Realty, Inc.' WHEN 2 THEN s_name || ' Realty, Inc.' END AS brokerage
FROM supplier""")
def _(w):
    n = F.col("s_name")
    said = (
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(n, F.lit("  DRE # 0123, Harbor Realty, Inc.")))
        .when(F.col("s_suppkey") % 4 == 1, F.concat(n, F.lit(", License 99")))
        .when(F.col("s_suppkey") % 4 == 2, F.concat(n, F.lit("  Realty, Inc.")))
        .otherwise(F.lit("   "))
    )
    who = parse.split_attribution(said)
    return w.raw("supplier").select("s_suppkey", who["agent"].alias("agent"), who["brokerage"].alias("brokerage"))


@query("sca16_clean_name", f"""
SELECT o_orderkey, {clean_name_sql("said")} AS name FROM (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Out Of  Area' WHEN 1 THEN ' UNKNOWN unknown '
    WHEN 2 THEN 'N/A.' WHEN 3 THEN '  Jane   ' || o_orderpriority WHEN 4 THEN 'listing agent' ELSE o_orderpriority END AS said
  FROM orders)""")
def _(w):
    k, p = F.col("o_orderkey") % 6, F.col("o_orderpriority")
    said = (
        F.when(k == 0, "Out Of  Area").when(k == 1, " UNKNOWN unknown ").when(k == 2, "N/A.")
        .when(k == 3, F.concat(F.lit("  Jane   "), p)).when(k == 4, "listing agent").otherwise(p)
    )
    return w.raw("orders").select("o_orderkey", text.clean_name(said).alias("name"))


@query("sca17_join4_family_lookup", f"SELECT {ID}, brokerage, {family_sql('brokerage')} AS family FROM sold")
def _(w):
    from marketval.constants import BROKERAGE_FAMILIES

    return w.sold.select(
        *DATASET, "row_ord", "brokerage",
        text.family_of(F.col("brokerage"), BROKERAGE_FAMILIES).alias("family"),
    )


@query("sca18_join5_quadrants", f"""
SELECT {ID}, divider_lat, computed_area, coalesce(borderline, FALSE) AS borderline FROM sold_q""", "divider_lat")
def _(w):
    placed = areas.classify(w.sold, w.geometry)
    return placed.select(*DATASET, "row_ord", "divider_lat", "computed_area", "borderline")


@query("sca19_apply_classification", f"""
SELECT {ID}, area, CASE WHEN coalesce(borderline, FALSE) THEN 1 ELSE 0 END AS n_notes FROM sold_a""")
def _(w):
    placed = areas.classify_all(w.sold, w.geometry)
    return placed.select(*DATASET, "row_ord", "area", F.size("notes").alias("n_notes"))


@query("sca20_sca21_price_and_date_match", """
SELECT market, profile, price_ok, date_ok, loose_ok, count(*) AS n FROM (
  SELECT market, profile, coalesce(CASE WHEN sold_price = 0 THEN stated_sold_price = 0 ELSE
      abs(sold_price - stated_sold_price) / abs(nullif(sold_price, 0)) <= 0.005e0 END, FALSE) AS price_ok,
    coalesce(abs(sold_date - (sold_date + CAST(row_ord % 30 AS INT))) <= 3, FALSE) AS date_ok,
    coalesce(abs(sold_date - (sold_date + CAST(row_ord % 30 AS INT))) <= 21, FALSE) AS loose_ok
  FROM (SELECT s.*, f.stated_sold_price FROM sold s JOIN facts f USING (market, profile, row_ord))) GROUP BY ALL""")
def _(w):
    stated = facts(w).select(*DATASET, "row_ord", "stated_sold_price")
    rows = w.sold.join(stated, [*DATASET, "row_ord"])
    later = F.date_add("sold_date", (F.col("row_ord") % 30).cast("int"))
    return rows.select(
        *DATASET,
        rates.prices_match(F.col("sold_price"), F.col("stated_sold_price")).alias("price_ok"),
        rates.dates_match(F.col("sold_date"), later).alias("date_ok"),
        rates.dates_match(F.col("sold_date"), later, 21).alias("loose_ok"),
    ).groupBy(*DATASET, "price_ok", "date_ok", "loose_ok").agg(F.count(F.lit(1)).alias("n"))


_TOKENS = """list_sort(list_distinct(list_filter(CASE WHEN regexp_matches(ws[1], '^[0-9]+$') THEN ws[2:] ELSE ws END,
  lambda x: NOT starts_with(x, '#') AND x NOT IN ('st','ave','rd','dr','blvd','ln','ct','pl','ter','way','cir',
  'trl','canyon','pkwy','hwy','sq','loop','row','walk','path','n','s','e','w','ne','nw','se','sw',''))))"""


@query("sca22_street_tokens", f"""
SELECT {ID}, array_to_string({_TOKENS}, ' ') AS tokens FROM (
  SELECT {ID}, string_split(addr_key_unit, ' ') AS ws FROM sold_k)""")
def _(w):
    words = F.array_sort(adr.street_tokens(F.col("address")))
    return w.sold.select(*DATASET, "row_ord", F.array_join(words, " ").alias("tokens"))


@query("sca24_recorded_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(w):
    said = F.when(
        F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise("not a date")
    return w.raw("orders").select("o_orderkey", parse.iso_date(said).alias("day"))


@query("sca26_local_clock", """
SELECT event_id, CAST(loc AS DATE) AS local_day, strftime(loc, '%Y-%m-%d %-I:%M %p') AS stamp FROM (
  SELECT event_id, CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS loc FROM events)""")
def _(w):
    zone = "America/Los_Angeles"
    return w.raw("events").select(
        "event_id", clock.local_date(F.col("ts"), zone).alias("local_day"),
        clock.local_stamp(F.col("ts"), zone).alias("stamp"),
    )


@query("sca27_ratio_percent", f"SELECT {ID}, (ratio - 1.0) * 100.0 AS pct FROM sold_m", "pct")
def _(w):
    return sold_m(w).select(*DATASET, "row_ord", rates.ratio_percent(F.col("ratio")).alias("pct"))


# -- predicates --------------------------------------------------------------------------------

@query("pred1_window_bounds", f"""
SELECT market, profile, DATE '{t.END}' - window_days AS "start", DATE '{t.END}' AS "end" FROM profiles""")
def _(w):
    return windows(w)


def windows(w: Workload):
    b = cleaning.window_bounds(end(), F.col("window_days"))
    return w.profiles.df.select(*DATASET, b["start"].alias("start"), b["end"].alias("end"))


@query("pred2_in_window", f"SELECT {ID}, sold_date FROM w_sold")
def _(w):
    return cleaning.in_window(w.sold, w.profiles, end()).select(*DATASET, "row_ord", "sold_date")


@query("pred3_type_identification", """
SELECT s.market, s.profile, s.row_ord FROM (
  SELECT *, CASE row_ord % 3 WHEN 0 THEN 'Vacant land' WHEN 1 THEN 'single_family home' END AS label,
    CASE WHEN row_ord % 2 = 0 THEN beds END AS b FROM sold) s
WHERE coalesce(CASE WHEN profile = 'homes' THEN lower(label) LIKE '%single#_family%' ESCAPE '#' OR lower(label) LIKE '%house%'
    OR lower(label) LIKE '%sfr%' ELSE lower(label) LIKE '%lot%' OR lower(label) LIKE '%land%' END, FALSE)
  OR (CASE WHEN profile = 'lots' THEN b IS NULL ELSE b IS NOT NULL END)""")
def _(w):
    label = F.when(F.col("row_ord") % 3 == 0, "Vacant land").when(F.col("row_ord") % 3 == 1, "single_family home")
    rows = w.sold.withColumn("property_type", label).withColumn(
        "beds", F.when(F.col("row_ord") % 2 == 0, F.col("beds"))
    )
    return cleaning.of_profile_type(rows, w.profiles).select(*DATASET, "row_ord")


@query("pred4_pred5_rates", f"SELECT {ID}, metric_size, ppsf FROM sold_m", "metric_size ppsf")
def _(w):
    return sold_m(w).select(*DATASET, "row_ord", "metric_size", "ppsf")


@query("pred5_active_rates", f"SELECT {ID}, metric_size, ppsf FROM active_m", "metric_size ppsf")
def _(w):
    return active_m(w).select(*DATASET, "row_ord", "metric_size", "ppsf")


@query("pred6_pred7_sold_to_ask_and_reduced", f"SELECT {ID}, ratio, reduced FROM sold_m", "ratio")
def _(w):
    return sold_m(w).select(*DATASET, "row_ord", "ratio", "reduced")


@query("pred8_join7_exclusion_reason", f"SELECT {ID}, reason FROM ({reason_sql('sold_k')}) WHERE reason IS NOT NULL")
def _(w):
    judged = cleaning.with_reason(sold_k(w), w.profiles)
    return judged.where(F.col("reason").isNotNull()).select(*DATASET, "row_ord", "reason")


@query("pred9_exclude_and_log", """
SELECT 'sold' AS side, market, profile, count(*) AS n, count(*) FILTER (reason IS NOT NULL) AS excluded,
  count(*) FILTER (missing_metric) AS missing FROM judged_sold GROUP BY market, profile
UNION ALL
SELECT 'active', market, profile, count(*), count(*) FILTER (reason IS NOT NULL), count(*) FILTER (missing_metric)
FROM judged_active GROUP BY market, profile""")
def _(w):
    resolved = dedup.resolve_sales(sold_k(w))
    kept = cleaning.with_reason(resolved.where("is_kept"), w.profiles)
    still, _ = cleaning.reconcile(active_k(w), sold_k(w))
    asks = cleaning.with_reason(still, w.profiles)

    def tally(rows, side):
        return rows.groupBy(F.lit(side).alias("side"), *DATASET).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("reason").isNotNull()).alias("excluded"),
            F.count_if(F.col("missing_metric")).alias("missing"),
        )

    return tally(kept, "sold").unionByName(tally(asks, "active"))


@query("pred10_core_view", f"SELECT {ID}, ppsf FROM sold_m WHERE core", "ppsf")
def _(w):
    return sold_m(w).where("core").select(*DATASET, "row_ord", "ppsf")


@query("pred12_needs_lookup", f"""
SELECT s.market, s.profile, s.row_ord FROM sold_m s WHERE len(sources) > 0
  AND (agent IS NULL OR brokerage IS NULL OR final_list_price IS NULL OR metric_size IS NULL)""")
def _(w):
    return cleaning.needs_lookup(w.sold, w.profiles).select(*DATASET, "row_ord")


@query("pred13_lookup_ceiling", """
SELECT market, profile, row_ord FROM sold_m WHERE len(sources) > 0
  AND (agent IS NULL OR brokerage IS NULL OR final_list_price IS NULL OR metric_size IS NULL)
QUALIFY row_number() OVER (PARTITION BY market, profile ORDER BY row_ord) <= 40""")
def _(w):
    targets = cleaning.needs_lookup(w.sold, w.profiles)
    return cleaning.lookup_targets(targets, 40).select(*DATASET, "row_ord")


@query("pred13_lookups_skipped", """
SELECT market, profile, greatest(count(*) - 40, 0) AS skipped FROM sold_m WHERE len(sources) > 0
  AND (agent IS NULL OR brokerage IS NULL OR final_list_price IS NULL OR metric_size IS NULL)
GROUP BY market, profile""")
def _(w):
    return cleaning.lookups_skipped(cleaning.needs_lookup(w.sold, w.profiles), 40)


@query("pred14_block_pages", """
SELECT page_id, regexp_matches(lower(left(said, 4000)), 'verify you are a human|verifying you are human|are you a robot|captcha|unusual traffic|access denied|request blocked|enable javascript and cookies to continue|checking your browser|cf-browser-verification|pardon our interruption') AS blocked
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(html, '<body>', '<body>Access DENIED ')
  WHEN 1 THEN html || ' captcha' ELSE html END AS said FROM pages)""")
def _(w):
    h, k = F.col("html"), F.col("page_id") % 3
    said = (
        F.when(k == 0, F.replace(h, F.lit("<body>"), F.lit("<body>Access DENIED ")))
        .when(k == 1, F.concat(h, F.lit(" captcha"))).otherwise(h)
    )
    return w.raw("pages").select("page_id", text.is_block_page(said).alias("blocked"))


@query("pred15_fill_original_price", f"""
SELECT {ID}, coalesce(original_list_price, nullif(final_list_price, 0)) AS original_list_price FROM sold""",
       "original_list_price")
def _(w):
    return cleaning.fill_original_price(w.sold).select(*DATASET, "row_ord", "original_list_price")


@query("pred16_join8_drop_by_address", """
SELECT market, profile, row_ord FROM sold_k c WHERE NOT EXISTS (
  SELECT 1 FROM active_k o WHERE o.market = c.market AND o.profile = c.profile AND o.addr_key_unit = c.addr_key_unit)""")
def _(w):
    from marketval.plans.archive import drop_rows

    drops = active_k(w).select(*DATASET, "addr_key_unit")
    return drop_rows(sold_k(w), drops).select(*DATASET, "row_ord")


@query("pred17_profile_validation", """
SELECT market, profile, subject_id, problem FROM (
  SELECT p.market, p.profile, s.subject_id, unnest([
    CASE WHEN coalesce(p.profile, '') = '' THEN 'profile needs a name' END,
    CASE WHEN p.profile = 'homes' AND p.m2 = 'lot_sqft' THEN 'improved property types should price on living-area sq ft, not lot sq ft' END,
    CASE WHEN p.profile = 'lots' AND p.m2 = 'living_sqft' THEN 'vacant land has no living area; metric must be lot_sqft' END,
    CASE WHEN (CASE WHEN p.m2 = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END) IS NULL
      THEN 'subject size is required to value the subject property' END,
    CASE WHEN p.w2 <= 0 THEN 'window_days must be positive' END,
    CASE WHEN core_min >= core_max THEN 'core view lower bound must be below the upper bound' END]) AS problem
  FROM (SELECT *, CASE WHEN rk = 1 THEN 'lot_sqft' WHEN rk = 2 THEN 'living_sqft' ELSE metric END AS m2,
    CASE WHEN rk = 3 THEN 0 ELSE window_days END AS w2 FROM profiles) p
  LEFT JOIN subjects s ON s.market = p.market AND s.profile = p.profile) WHERE problem IS NOT NULL""")
def _(w):
    rk = w.raw("region").select(F.col("r_name").alias("market"), F.col("r_regionkey").alias("rk"))
    odd = (
        w.profiles.df.join(rk, "market")
        .withColumn(
            "metric",
            F.when(F.col("rk") == 1, "lot_sqft").when(F.col("rk") == 2, "living_sqft").otherwise(F.col("metric")),
        )
        .withColumn("window_days", F.when(F.col("rk") == 3, 0).otherwise(F.col("window_days")))
        .drop("rk")
    )
    return quality.profile_problems(odd, w.subjects.df)


@query("pred18_market_conformance", """
SELECT r_name AS market, u.severity, u.code FROM (SELECT *, unnest([
  CASE WHEN r_regionkey = 1 THEN {'severity': 'problem', 'code': 'default profile is unknown'} END,
  CASE WHEN r_regionkey = 3 THEN {'severity': 'warning', 'code': 'no quadrant geometry'} END,
  CASE WHEN r_regionkey = 2 THEN {'severity': 'warning', 'code': 'no recorded data'} END,
  CASE WHEN r_regionkey = 4 THEN {'severity': 'problem', 'code': 'no data directory'} END,
  CASE WHEN NOT EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE n_regionkey = r_regionkey) THEN {'severity': 'warning', 'code': 'declares no sources'} END]) AS u
  FROM region) WHERE u IS NOT NULL""")
def _(w):
    rk = F.col("r_regionkey")
    markets = w.raw("region").select(
        F.col("r_name").alias("market"),
        F.when(rk == 1, "missing").otherwise("lots").alias("default_profile"),
        F.when(rk == 2, "").otherwise("recorded").alias("fixture_dir"),
        F.when(rk == 4, "").otherwise("data").alias("data_dir"),
    )
    return quality.market_problems(markets, w.profiles.df, w.geometry.df, sources(w))


def sources(w: Workload):
    from marketval.sources.config import sources_table

    return sources_table(declared(w))


def declared(w: Workload):
    k = F.col("s_suppkey")
    return (
        w.raw("supplier").join(w.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(w.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("market"), F.col("s_name").alias("source"),
            F.when(k % 3 != 0, "embedded").alias("adapter"),
            F.when(k % 4 == 0, "Active listings").alias("role"),
            F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/")).alias("url"),
            F.when(k % 2 == 0, F.array(F.lit("lags"))).alias("quirks"),
            F.when(k % 5 == 0, F.col("s_acctbal")).alias("rate_limit_seconds"),
            F.when(k % 6 == 0, F.lit(False)).alias("enabled"),
            F.when(k % 4 == 0, "active").alias("side"),
            F.lit(None).cast("map<string,string>").alias("config"),
        )
    )


@query("src12_source_defaults", """
SELECT r_name AS market, s_name AS source, CASE WHEN s_suppkey % 3 <> 0 THEN 'embedded' ELSE '' END AS adapter,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Active listings' ELSE '' END AS role,
  CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS n_quirks,
  CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal ELSE 2e0 END AS rate_limit_seconds, s_suppkey % 6 <> 0 AS enabled,
  CASE WHEN s_suppkey % 4 = 0 THEN 'active' ELSE 'sold' END AS side
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
       "rate_limit_seconds")
def _(w):
    return sources(w).select(
        "market", "source", "adapter", "role", F.size("quirks").alias("n_quirks"),
        "rate_limit_seconds", "enabled", "side",
    )


@query("pred22_comp_rows", f"""
SELECT {ID}, address, sold_date, sold_price, lot_sqft, brokerage, agent, final_list_price, area FROM sold_a""",
       "sold_price lot_sqft final_list_price")
def _(w):
    from marketval.plans.reports import comp_rows

    return comp_rows(areas.classify_all(w.sold, w.geometry))


@query("pred22_active_rows", f"""
SELECT {ID}, address, list_price, lot_sqft, lot_size_is_rounded, brokerage, agent, area FROM active_a""",
       "list_price lot_sqft")
def _(w):
    from marketval.plans.reports import active_rows

    return active_rows(areas.classify_all(w.active, w.geometry))


# -- merging, reconciliation, windows ----------------------------------------------------------

@query("win1_merge_same_sales", """
SELECT s.market, s.profile, s.row_ord, f.grp_ord,
  list_contains(list_transform(f.kept, lambda k: k.o), s.row_ord) AS is_kept,
  NOT list_contains(list_transform(f.kept, lambda k: k.slot), s.row_ord) AS is_duplicate,
  list_filter(f.kept, lambda k: k.o = s.row_ord)[1].slot AS kept_slot
FROM sold_k s JOIN fold f USING (market, profile, addr_key)""")
def _(w):
    return dedup.resolve_sales(sold_k(w)).select(
        *DATASET, "row_ord", "grp_ord", "is_kept", "is_duplicate",
        F.when(F.col("is_kept"), F.col("slot_ord")).alias("kept_slot"),
    )


@query("win1_shared_addresses", """
SELECT f.market, f.profile, f.addr_key, len(kept) AS n_sales,
  s.address || ': ' || len(kept) || ' distinct sales share this address' AS note
FROM fold f JOIN sold_k s ON s.market = f.market AND s.profile = f.profile AND s.row_ord = f.kept[1].o
WHERE len(kept) > 1""")
def _(w):
    shared = cleaning.shared_addresses(dedup.resolve_sales(sold_k(w)))
    return shared.select(*DATASET, "addr_key", "n_sales", "note")


@query("win2_repeat_sales", """
SELECT s.market, s.profile, s.row_ord, f.first_date, f.first_price, s.sold_date, s.sold_price
FROM sold_k s JOIN (SELECT market, profile, addr_key_bare, min(row_ord) AS o,
    arg_min({'d': sold_date, 'p': sold_price}, row_ord).d AS first_date,
    arg_min({'d': sold_date, 'p': sold_price}, row_ord).p AS first_price
  FROM sold_k GROUP BY ALL) f USING (market, profile, addr_key_bare)
WHERE s.row_ord > f.o AND NOT (
  coalesce(CASE WHEN first_price = 0 THEN s.sold_price = 0
    ELSE abs(first_price - s.sold_price) / abs(nullif(first_price, 0)) <= 0.005e0 END, FALSE)
  AND coalesce(abs(first_date - s.sold_date) <= 3, FALSE))""", "first_price sold_price")
def _(w):
    return cleaning.repeat_sales(sold_k(w)).drop("address")


@query("join1_reconcile", """
SELECT a.market, a.profile, a.row_ord, EXISTS (SELECT 1 FROM sold_k s WHERE s.market = a.market
  AND s.profile = a.profile AND s.addr_key = a.addr_key) AS closed FROM active_k a""")
def _(w):
    still, closed = cleaning.reconcile(active_k(w), sold_k(w))
    cols = [*DATASET, "row_ord"]
    return still.select(*cols, F.lit(False).alias("closed")).unionByName(
        closed.select(*cols, F.lit(True).alias("closed"))
    )


# -- verification ------------------------------------------------------------------------------

def facts(w: Workload, sold=None):
    sql = FACTS.format(url="https://page.example/", s="STRING", src="{sold}")
    return w.spark.sql(sql, sold=w.sold if sold is None else sold)


def checked_sales(w: Workload, *shown: str):
    """Sold rows with what the checks read of them, stored: facts, targets and fills read them."""
    return written(w.sold.select(
        *DATASET, "row_ord", "address", "sold_price", "sold_date", verify.known_fields().alias("known"), *shown,
    ))


@query("set8_facts_to_claims", """
SELECT market, profile, claim_ord, field_name, CASE WHEN field_name IN ('agent', 'brokerage', 'buyer_agent') THEN value END AS name,
  CASE WHEN field_name NOT IN ('agent', 'brokerage', 'buyer_agent') THEN CAST(value AS DOUBLE) END AS number,
  source_url, claimed_price, claimed_date FROM claims""", "number claimed_price")
def _(w):
    party = F.col("field_name").isin("agent", "brokerage", "buyer_agent")
    return verify.claims_from_facts(facts(w)).select(
        *DATASET, "claim_ord", "field_name", F.when(party, F.col("value")).alias("name"),
        F.when(~party, F.col("value").try_cast("double")).alias("number"),
        "source_url", "claimed_price", "claimed_date",
    )


def judged(w: Workload, details=(), sales=None, only=None):
    sales = checked_sales(w) if sales is None else sales
    keyed = measures.with_keys(sales, w.profiles)
    claims = verify.claims_from_facts(facts(w, sales), w.profiles, keyed)
    return verify.judge_claims(keyed, claims, w.profiles, details, only)


@query("join2_sca25_judge_claims", """
SELECT market, profile, claim_ord, row_ord, field_name, outcome, reason FROM judged""")
def _(w):
    return judged(w, ["reason"]).select(*DATASET, "claim_ord", "row_ord", "field_name", "outcome", "reason")


@query("join2_apply_claims", """
SELECT s.market, s.profile, s.row_ord, coalesce(s.agent, c.agent) AS agent, coalesce(s.brokerage, c.brokerage) AS brokerage,
  coalesce(s.buyer_agent, c.buyer_agent) AS buyer_agent,
  coalesce(s.final_list_price, CAST(c.flp AS DOUBLE)) AS final_list_price,
  coalesce(s.original_list_price, CAST(c.olp AS DOUBLE)) AS original_list_price,
  coalesce(s.lot_sqft, CAST(c.lot AS DOUBLE)) AS lot_sqft, len(s.sources) + coalesce(n_urls, 0) AS n_sources
FROM sold_k s LEFT JOIN (SELECT market, profile, row_ord, count(DISTINCT source_url) AS n_urls,
    max(clean_value) FILTER (field_name = 'agent') AS agent, max(clean_value) FILTER (field_name = 'brokerage') AS brokerage,
    max(clean_value) FILTER (field_name = 'buyer_agent') AS buyer_agent,
    max(clean_value) FILTER (field_name = 'final_list_price') AS flp,
    max(clean_value) FILTER (field_name = 'original_list_price') AS olp,
    max(clean_value) FILTER (field_name = 'lot_sqft') AS lot
  FROM judged WHERE outcome = 'accepted' GROUP BY ALL) c USING (market, profile, row_ord)""",
       "final_list_price original_list_price lot_sqft")
def _(w):
    sales = checked_sales(w, *verify.KNOWN_FIELDS, "sources")
    # Only accepted claims fill a row, so of all that are judged only those are stored.
    accepted = judged(w, ["clean_value", "source_url"], sales, ["accepted"])
    filled = verify.apply_claims(measures.with_keys(sales, w.profiles), accepted)
    return filled.select(
        *DATASET, "row_ord", "agent", "brokerage", "buyer_agent", "final_list_price",
        "original_list_price", "lot_sqft", F.size("sources").alias("n_sources"),
    )


@query("agg24_verification_summary", """
SELECT market, profile, count(*) FILTER (outcome = 'accepted') AS accepted,
  count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'unverifiable') AS unverifiable
FROM judged GROUP BY market, profile""")
def _(w):
    return verify.verification_summary(judged(w))


def geocodes(w: Workload):
    """Two answers per listing address: the primary's and the fallback's."""
    a = w.active.select(*DATASET, "row_ord", "address")
    k = F.col("row_ord")
    primary = a.select(
        "market", "address", F.lit("primary").alias("service"), F.col("address").alias("query"),
        F.when(k % 4 != 0, 40.5).alias("lat"), F.when(k % 4 != 0, -100.5).alias("lon"),
        F.when(k % 3 == 0, F.regexp_replace("address", "(Alder|Birch|Cedar)", "Willow")).otherwise(
            F.col("address")).alias("matched_address"),
        F.lit(None).cast("double").alias("score"), "row_ord",
    )
    fallback = a.select(
        "market", "address", F.lit("fallback").alias("service"), F.col("address").alias("query"),
        F.lit(40.7).alias("lat"), F.lit(-100.7).alias("lon"), F.upper("address").alias("matched_address"),
        (F.lit(80.0) + k % 12).alias("score"), "row_ord",
    )
    return primary.unionByName(fallback)


_GEO = f"""
SELECT *, CASE WHEN lat IS NULL THEN 'no match' WHEN score < 85 THEN 'low confidence (' || format('{{:,.0f}}', score) || ')'
  WHEN wrong THEN 'matched a different street: ' || matched END AS rejected
FROM (
  SELECT market, profile, row_ord, address, 'primary' AS service, CASE WHEN row_ord % 4 <> 0 THEN 40.5e0 END AS lat,
    CASE WHEN row_ord % 4 <> 0 THEN -100.5e0 END AS lon, CAST(NULL AS DOUBLE) AS score,
    CASE WHEN row_ord % 3 = 0 THEN regexp_replace(address, '(Alder|Birch|Cedar)', 'Willow', 'g') ELSE address END AS matched,
    row_ord % 3 = 0 AND regexp_matches(address, '(Alder|Birch|Cedar)') AS wrong FROM active
  UNION ALL
  SELECT market, profile, row_ord, address, 'fallback', 40.7e0, -100.7e0, 80e0 + row_ord % 12, upper(address), FALSE FROM active)"""


@query("sca23_judge_geocodes", f"SELECT market, row_ord, service, rejected FROM ({_GEO})")
def _(w):
    return verify.judge_geocodes(geocodes(w)).select("market", "row_ord", "service", "rejected")


@query("join12_fill_geocodes", f"""
SELECT a.market, a.profile, a.row_ord, CASE WHEN use THEN g.lat ELSE a.lat END AS lat,
  CASE WHEN use THEN g.lon ELSE a.lon END AS lon, use AS geocoded
FROM (SELECT a.*, g.lat AS glat, g.lon AS glon, (a.lat IS NULL OR a.lon IS NULL) AND g.lat IS NOT NULL AS use
  FROM active a LEFT JOIN (SELECT market, address,
      coalesce(max(lat) FILTER (service = 'primary' AND rejected IS NULL), max(lat) FILTER (service = 'fallback' AND rejected IS NULL)) AS lat,
      coalesce(max(lon) FILTER (service = 'primary' AND rejected IS NULL), max(lon) FILTER (service = 'fallback' AND rejected IS NULL)) AS lon
    FROM ({_GEO}) GROUP BY market, address) g ON g.market = a.market AND g.address = a.address) a,
  LATERAL (SELECT a.glat AS lat, a.glon AS lon) g""", "lat lon")
def _(w):
    filled = verify.fill_geocodes(w.active, verify.judge_geocodes(geocodes(w)))
    return filled.select(*DATASET, "row_ord", "lat", "lon", "geocoded")


@query("join12_geocode_rejections", f"""
WITH geo AS ({_GEO.replace("FROM active", "FROM (" + t.active_sql("VARCHAR", "CAST([] AS VARCHAR[])", "[{}]") + ")")}),
 act AS ({t.active_sql("VARCHAR", "CAST([] AS VARCHAR[])", "[{}]")})
SELECT market, service, split_part(rejected, ':', 1) AS why, count(*) AS n FROM geo g WHERE rejected IS NOT NULL
  AND EXISTS (SELECT 1 FROM act a WHERE a.market = g.market AND a.address = g.address AND (a.lat IS NULL OR a.lon IS NULL))
  AND NOT EXISTS (SELECT 1 FROM geo p WHERE p.market = g.market AND p.address = g.address AND p.service = 'primary' AND p.rejected IS NULL)
GROUP BY ALL""")
def _(w):
    # A listing with both coordinates asks for nothing, so no answer to it is judged.
    asked = verify.asked_geocodes(w.active, geocodes(w))
    gone = verify.geocode_rejections(w.active, verify.judge_geocodes(asked))
    why = F.split_part("rejected", F.lit(":"), F.lit(1))
    return gone.groupBy("market", "service", why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


# -- comparison of two runs --------------------------------------------------------------------

def two_runs(w: Workload):
    """(before sold, before active, after sold, after active): the rows known by a day, and all of them."""
    s, a = sold_k(w), active_k(w)
    early = F.lit(EARLIER).cast("date")
    known = lambda day: day.isNull() | (day <= early)
    lower = F.when(F.col("row_ord") % 3 == 0, 0.97).otherwise(1.0)
    stays = (F.col("row_ord") % 10 != 0) | (F.col("listed_date") > early)
    return (
        s.where(known(F.col("sold_date"))), a.where(known(F.col("listed_date"))),
        s, a.where(stays).withColumn("list_price", F.col("list_price") * lower),
    )


_C = "SELECT market, profile, addr_key_unit, address FROM"


@query("set1_new_sales", f"{_C} ({lastkey_sql('after_sold')}) c WHERE {missing_from('before_sold')}")
def _(w):
    bs, _, as_, _ = two_runs(w)
    return compare.new_sales(bs, as_, DATASET)


@query("set2_newly_closed", f"""{_C} ({lastkey_sql('after_sold')}) c
WHERE {missing_from('before_sold')} AND {missing_from('before_active')[4:]}""")
def _(w):
    bs, ba, as_, _ = two_runs(w)
    return compare.newly_closed(bs, ba, as_, DATASET)


@query("set3_new_active", f"{_C} ({lastkey_sql('after_active')}) c WHERE {missing_from('before_active')}")
def _(w):
    _, ba, _, aa = two_runs(w)
    return compare.new_active(ba, aa, DATASET)


@query("set4_gone_from_active", f"""{_C} ({lastkey_sql('before_active')}) c
WHERE {missing_from('after_active')} AND {missing_from('after_sold')}""")
def _(w):
    _, ba, as_, aa = two_runs(w)
    return compare.gone_from_active(ba, aa, as_, DATASET)


@query("set5_srt4_price_cuts", f"""
SELECT market, profile, addr_key_unit, a.address, b.list_price AS before, a.list_price AS after,
  a.list_price - b.list_price AS change
FROM ({lastkey_sql("after_active")}) a JOIN ({lastkey_sql("before_active")}) b USING (market, profile, addr_key_unit)
WHERE b.list_price <> 0 AND a.list_price <> 0 AND a.list_price < b.list_price""", "before after change")
def _(w):
    from marketval.plans.reports import price_cut_order

    _, ba, _, aa = two_runs(w)
    return price_cut_order(compare.price_cuts(ba, aa, DATASET))


@query("join6_all_changes", "SELECT market, profile, category, address, before, after FROM changes", "before after")
def _(w):
    return compare.changes(*two_runs(w), DATASET)


_FIG = {
    "Sold count": "count", "Sold median $/sqft": "median_ppsf", "Sold median price": "median_price",
}


def _stat_cut(w, rows):
    from marketval.operators import stats

    return stats.sold_stats(measures.sold_measures(rows, w.profiles))


def stat_cut_sql(known: str) -> str:
    return f"""SELECT market, profile, unnest([{{'label': 'Sold count', 'v': CAST(count(*) AS DOUBLE)}},
  {{'label': 'Sold median $/sqft', 'v': median(ppsf)}}, {{'label': 'Sold median price', 'v': median(sold_price)}}]) AS u
FROM sold_m WHERE {known} GROUP BY market, profile"""


KNOWN_SALE = f"(sold_date IS NULL OR sold_date <= DATE '{EARLIER}')"
DELTAS = f"""
SELECT market, profile, a.u.label AS label, b.u.v AS before, a.u.v AS after, a.u.v - b.u.v AS change,
  (a.u.v - b.u.v) / nullif(b.u.v, 0) AS pct_change
FROM ({stat_cut_sql("true")}) a JOIN ({stat_cut_sql(KNOWN_SALE)}) b
  USING (market, profile) WHERE a.u.label = b.u.label"""


def deltas(w: Workload):
    bs, _, as_, _ = two_runs(w)
    return compare.deltas(_stat_cut(w, bs), _stat_cut(w, as_), DATASET, _FIG)


@query("set6_deltas", DELTAS, "before after change pct_change")
def _(w):
    return deltas(w)


@query("srt6_first_names", """
SELECT market, profile, n, array_to_string(xs[1:8], ', ') || CASE WHEN n > 8 THEN ' (+' || (n - 8) || ' more)' ELSE '' END AS detail
FROM (SELECT market, profile, count(*) AS n, list(address ORDER BY address) AS xs FROM active GROUP BY market, profile)""")
def _(w):
    return compare.first_names(w.active, DATASET, "address")


@query("snk11_change_report", f"""
SELECT * FROM (WITH slots AS (SELECT market, profile, unnest([{{'c': 'new_sale', 'label': 'New sales'}}, {{'c': 'newly_closed', 'label': 'Listings that closed'}},
    {{'c': 'new_active', 'label': 'New listings'}}, {{'c': 'gone', 'label': 'Listings withdrawn'}}, {{'c': 'price_cut', 'label': 'Price cuts'}}]) AS u
  FROM profiles),
 groups AS (SELECT market, profile, category AS c, count(*) AS n, array_to_string(list(address ORDER BY address)[1:8], ', ')
    || CASE WHEN count(*) > 8 THEN ' (+' || (count(*) - 8) || ' more)' ELSE '' END AS detail FROM changes GROUP BY ALL)
SELECT market, profile, 'rows' AS section, 'Compared with' AS label, CAST(NULL AS BIGINT) AS n, '{EARLIER}' AS detail FROM profiles
UNION ALL SELECT s.market, s.profile, 'rows', s.u.label, coalesce(n, 0), coalesce(detail, 'none')
FROM slots s LEFT JOIN groups g ON g.market = s.market AND g.profile = s.profile AND g.c = s.u.c
WHERE s.u.c IN ('new_sale', 'newly_closed', 'new_active')
UNION ALL SELECT s.market, s.profile, 'counts', s.u.label, coalesce(n, 0), NULL
FROM slots s LEFT JOIN groups g ON g.market = s.market AND g.profile = s.profile AND g.c = s.u.c
UNION ALL
SELECT market, profile, 'rows', 'Price cuts', count(*), array_to_string(list(txt ORDER BY after - before, txt)[1:8], '; ')
FROM (SELECT *, address || ' $' || format('{{:,.0f}}', before) || ' to $' || format('{{:,.0f}}', after) AS txt FROM changes
  WHERE category = 'price_cut') GROUP BY market, profile
UNION ALL
SELECT market, profile, 'figures', label, NULL, format('{{:,.2f}}', before) || ' to ' || format('{{:,.2f}}', after) || ' ('
  || CASE WHEN change >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', pct_change * 100) || '%)' FROM ({DELTAS}))""")
def _(w):
    from marketval.plans.reports import change_report

    pairs = w.profiles.df.select(*DATASET, F.lit(EARLIER).alias("prior_label"))
    return change_report(compare.changes(*two_runs(w), DATASET), deltas(w), pairs, DATASET)
