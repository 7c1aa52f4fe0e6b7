"""Queries over figures: statistics, valuation, guidance, areas, agents, quality, reports, runs."""

from uuid import uuid4

from pyspark.sql import functions as F

from marketval.operators import agents, areas, guidance, measures, quality, sizing, stats, valuation
from marketval.operators.cleaning import in_window
from marketval.operators.sizing import DATASET
from marketval.plans import analysis, archive, reports
from marketval.sources import config
from workload import tables as t
from workload.oracle import EARLIER, agents_sql, areas_sql, stats_sql, valuation_sql
from workload.registry import query
from workload.rows import KNOWN_SALE, active_k, active_m, judged, sold_k, sold_m, sources, two_runs, windows
from workload.tables import Workload

_STAT = ("avg_ppsf median_ppsf avg_price median_price avg_size min_ppsf max_ppsf core_avg_ppsf "
         "core_median_ppsf")
_RATIO = "mean_ratio median_ratio max_ratio min_ratio share_at_or_above_ask"
_VAL = "subject_size bracket_low bracket_high ppsf value"


# -- statistics --------------------------------------------------------------------------------

@query("agg1_sold_stats", "SELECT * FROM sold_stats", _STAT)
def _(w):
    return stats.sold_stats(sold_m(w))


@query("agg1_sold_stats_by_rank", "SELECT * FROM sold_stats", _STAT)
def _(w):
    """Under its earlier name; every size takes this plan."""
    return stats.sold_stats(sold_m(w))


@query("agg2_active_stats", "SELECT * FROM active_stats", _STAT)
def _(w):
    return stats.active_stats(active_m(w))


@query("agg3_sold_to_ask", "SELECT * FROM ratios", _RATIO)
def _(w):
    return stats.sold_to_ask(sold_m(w))


@query("agg4_attribution_coverage", """
SELECT market, profile, count(*) FILTER (coalesce(brokerage, '') <> '' OR coalesce(agent, '') <> '') AS attributed,
  count(*) AS total FROM sold GROUP BY market, profile""")
def _(w):
    return stats.attribution_coverage(w.sold)


@query("agg5_caveats", """
SELECT market, profile, u.code, u.n FROM (SELECT s.market, s.profile, unnest([
  CASE WHEN r > 0 THEN {'code': 'rounded_acreage', 'n': r} END,
  CASE WHEN missing_metric_count > 0 THEN {'code': 'no_usable_size', 'n': missing_metric_count} END,
  CASE WHEN avg_ppsf <> 0 AND median_ppsf > avg_ppsf THEN {'code': 'median_above_mean', 'n': 1} END]) AS u
  FROM sold_stats s JOIN (SELECT market, profile, count(*) FILTER (lot_size_is_rounded) AS r FROM sold GROUP BY ALL)
  USING (market, profile)) WHERE u IS NOT NULL""")
def _(w):
    rows = sold_m(w)
    return stats.caveats(rows, stats.sold_stats(rows))


# -- valuation ---------------------------------------------------------------------------------

@query("pred11_bracket_bounds", """
SELECT market, profile, subject_id, subject_size, center, bracket_low, bracket_high, attribute, bed_rule FROM brackets""",
       "subject_size center bracket_low bracket_high bed_rule")
def _(w):
    return valuation.subject_brackets(w.subjects.df, w.profiles)


_PAIRS = """
SELECT b.market, b.profile, b.subject_id, count(*) AS n, sum(s.ppsf) AS total FROM sold_m s JOIN brackets b
  USING (market, profile)
WHERE (CASE WHEN b.attribute = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END) BETWEEN b.bracket_low
  AND b.bracket_high AND (b.bed_rule IS NULL OR coalesce(s.beds = b.bed_rule, FALSE)) GROUP BY ALL"""


def _pair_totals(pairs):
    return pairs.groupBy(*valuation.SUBJECT).agg(F.count(F.lit(1)).alias("n"), F.sum("ppsf").alias("total"))


@query("join3_bracket_join", _PAIRS, "total")
def _(w):
    return _pair_totals(valuation.bracket_pairs(sold_m(w), w.subjects, w.profiles))


@query("join3_bracket_join_by_slices", _PAIRS, "total")
def _(w):
    """The plan for subject tables too large to broadcast: size slices, an equality join."""
    many = sizing.Dim(w.subjects.df)
    many.__dict__["fits"] = False
    return _pair_totals(valuation.bracket_pairs(sold_m(w), many, w.profiles))


def valued(w: Workload):
    return valuation.value_subjects(sold_m(w), active_m(w), w.subjects, w.profiles)


@query("agg6_valuation", "SELECT * FROM valued", _VAL)
def _(w):
    return valued(w)


@query("agg6_valuation_by_rank", "SELECT * FROM valued", _VAL)
def _(w):
    return valuation.value_subjects(sold_m(w), active_m(w), w.subjects, w.profiles)


@query("agg7_valuation_warnings", """
SELECT market, profile, subject_id, u.code, u.n FROM (SELECT market, profile, subject_id, unnest([
  CASE WHEN subject_size IS NULL THEN {'code': 'no_subject_size', 'n': CAST(0 AS BIGINT)} END,
  CASE WHEN bracket_count < 5 THEN {'code': 'thin_bracket', 'n': bracket_count} END]) AS u
  FROM valued WHERE is_primary) WHERE u IS NOT NULL""")
def _(w):
    return valuation.valuation_warnings(valued(w))


_EDGES = """
SELECT market, profile, bands, n_sized, idx - 1 AS i, edge FROM (
  SELECT market, profile, bands, n_sized, generate_subscripts(bounds, 1) AS idx, unnest(bounds) AS edge FROM edges)"""


def _edges(edges):
    return edges.select(*DATASET, "bands", "n_sized", F.posexplode("bounds").alias("i", "edge"))


@query("win3_band_edges", _EDGES, "edge")
def _(w):
    return _edges(valuation.band_edges(sold_m(w)))


@query("win3_band_edges_by_rank", _EDGES, "edge")
def _(w):
    return _edges(valuation.band_edges(sold_m(w)))


@query("agg8_size_bands", "SELECT * FROM bands", "low high median_ppsf avg_ppsf median_size median_price")
def _(w):
    return valuation.size_bands(sold_m(w), w.subjects, w.profiles)


@query("agg9_size_trend", """
SELECT market, profile, count(median_ppsf) AS rated_bands,
  arg_min(median_ppsf, band) FILTER (median_ppsf IS NOT NULL) AS smallest,
  arg_max(median_ppsf, band) FILTER (median_ppsf IS NOT NULL) AS largest,
  CASE WHEN count(median_ppsf) >= 2 THEN (smallest - largest) / nullif(largest, 0) * 100 END AS trend_pct
FROM bands GROUP BY market, profile""", "smallest largest trend_pct")
def _(w):
    return valuation.size_trend(valuation.size_bands(sold_m(w), w.subjects, w.profiles))


_LAD = "low high median_ppsf avg_ppsf value_from_median value_from_avg"


def ladder(w: Workload):
    return valuation.bracket_ladder(sold_m(w), w.subjects, w.profiles)


@query("agg10_agg11_bracket_ladder", "SELECT * FROM ladder", _LAD)
def _(w):
    return ladder(w)


@query("agg12_ladder_spread", """
SELECT market, profile, subject_id, count(v) AS readable_rungs, min(v) AS low_value, max(v) AS high_value,
  CASE WHEN count(v) >= 2 THEN (max(v) - min(v)) / nullif(max(value_from_avg) FILTER (is_profile_bracket), 0) * 100 END AS spread_pct
FROM (SELECT *, CASE WHEN NOT is_thin AND NOT is_all_sold THEN value_from_avg END AS v FROM ladder)
GROUP BY market, profile, subject_id""", "low_value high_value spread_pct")
def _(w):
    return valuation.ladder_spread(ladder(w))


# -- guidance ----------------------------------------------------------------------------------

@query("agg18_ratio_percentiles", "SELECT * FROM points", "min_ratio max_ratio p15 p45 p60 p90")
def _(w):
    return guidance.ratio_points(sold_m(w))


@query("agg18_ratio_percentiles_by_rank", "SELECT * FROM points", "min_ratio max_ratio p15 p45 p60 p90")
def _(w):
    return guidance.ratio_points(sold_m(w))


@query("gui1_gui2_price_edges", """
SELECT o_orderkey, floor(trunc(o_totalprice) / 50000) * 50000 AS band, floor(trunc(o_totalprice) / 10000) * 10000 - 1000
  AS under FROM orders""", "band under")
def _(w):
    p = F.col("o_totalprice")
    return w.raw("orders").select(
        "o_orderkey", guidance.band_floor(p).alias("band"), guidance.under_ten_k(p).alias("under")
    )


def guided(w: Workload):
    return guidance.build_guidance(valued(w), guidance.ratio_points(sold_m(w)), w.profiles)


@query("gui3_gui4_gui5_guidance", "SELECT * FROM guided",
       "anchor floor list_price expected_low expected_high cutoff under_estimate under_share min_ratio max_ratio premium")
def _(w):
    return guided(w)


@query("gui3_guidance_notes", """
SELECT market, profile, subject_id, CASE WHEN value IS NULL THEN 'no_primary_valuation' ELSE 'compete_below_floor' END AS code,
  g.compete, g."floor", g.at_market
FROM valued v LEFT JOIN (SELECT market, profile, subject_id, bool_or(below_floor) AS under, max("floor") AS "floor",
  max(list_price) FILTER (strategy = 'compete') AS compete, max(list_price) FILTER (strategy = 'at_market') AS at_market
  FROM guided GROUP BY ALL HAVING bool_or(below_floor)) g USING (market, profile, subject_id)
WHERE is_primary AND (value IS NULL OR under)""", "compete floor at_market")
def _(w):
    value = valued(w)
    points = guidance.ratio_points(sold_m(w))
    return guidance.guidance_notes(value, guidance.build_guidance(value, points, w.profiles))


# -- areas -------------------------------------------------------------------------------------

def placed(w: Workload):
    return areas.classify_all(sold_m(w), w.geometry), areas.classify_all(active_m(w), w.geometry)


_AREA = "sold_avg_ppsf sold_median_ppsf sold_median_price sold_avg_size active_avg_ppsf"


@query("agg13_agg14_join11_area_table", "SELECT * FROM area_table", _AREA)
def _(w):
    s, a = placed(w)
    return areas.area_table(s, a, w.profiles)


@query("agg14_unclassified", """
SELECT p.market, p.profile, (SELECT count(*) FROM sold_a s WHERE s.market = p.market AND s.profile = p.profile AND s.area IS NULL)
  AS unclassified_sold, (SELECT count(*) FROM active_a s WHERE s.market = p.market AND s.profile = p.profile AND s.area IS NULL)
  AS unclassified_active FROM profiles p""")
def _(w):
    s, a = placed(w)
    return areas.unclassified(s, a, w.profiles)


# -- agents ------------------------------------------------------------------------------------

_AG = "avg_sold_to_ask median_sold_to_ask avg_ppsf avg_size median_size"


def agent_rows(w: Workload):
    return agents.agent_table(sold_m(w), active_m(w))


@query("agg15_agg16_join9_agents", "SELECT * FROM agents", _AG)
def _(w):
    return agent_rows(w)


@query("agg16_agents_by_rank", "SELECT * FROM agents", _AG)
def _(w):
    return agent_rows(w)


@query("win4_interview_order", "SELECT market, profile, agent, interview_rank FROM agents_ranked")
def _(w):
    return agents.interview_order(agent_rows(w)).select(*DATASET, "agent", "interview_rank")


@query("win4_interview_order_by_range", "SELECT market, profile, agent, interview_rank FROM agents_ranked")
def _(w):
    """Under its earlier name; every size takes this plan."""
    return agents.interview_order(agent_rows(w)).select(*DATASET, "agent", "interview_rank")


@query("agg17_join10_brokerages", "SELECT * FROM brokerages", "share")
def _(w):
    return agents.brokerage_table(w.sold, w.active)


@query("srt1_brokerage_order", """
SELECT market, profile, family, row_number() OVER (PARTITION BY market, profile ORDER BY closings DESC, family) AS position
FROM brokerages""")
def _(w):
    ranked = agents.brokerage_order(agents.brokerage_table(w.sold, w.active))
    return ranked.select(*DATASET, "family", "position")


@query("srt2_comp_order", """
SELECT market, profile, row_ord, agent FROM sold ORDER BY lower(agent) ASC NULLS LAST, row_ord""")
def _(w):
    return reports.sorted_comps(w.sold, "agent", descending=False).select(*DATASET, "row_ord", "agent")


@query("srt3_agent_order", """
SELECT market, profile, agent, active_listings, interview_rank FROM agents_ranked
ORDER BY active_listings DESC NULLS LAST, interview_rank""")
def _(w):
    ranked = agents.interview_order(agent_rows(w))
    return reports.sorted_agents(ranked, "active_listings").select(*DATASET, "agent", "active_listings", "interview_rank")


# -- quality -----------------------------------------------------------------------------------

@query("pred19_agg28_run_conformance", """
SELECT p.market, p.profile, coalesce(n, 0) AS sold_count, coalesce(n, 0) > 0 AS passes FROM profiles p
LEFT JOIN (SELECT market, profile, count(*) AS n FROM sold GROUP BY ALL) USING (market, profile)""")
def _(w):
    return quality.empty_runs(w.profiles, stats.sold_stats(sold_m(w)))


@query("pred18_profile_conformance", """
SELECT market, profile, 'warning' AS severity, 'improved types normally price on living area' AS code
FROM profiles WHERE profile = 'homes' AND rk = 1
UNION ALL SELECT market, profile, 'problem', 'land must price on lot_sqft' FROM profiles WHERE profile = 'lots' AND rk = 2""")
def _(w):
    rk = w.raw("region").select(F.col("r_name").alias("market"), F.col("r_regionkey").alias("rk"))
    odd = w.profiles.df.join(rk, "market").withColumn(
        "metric",
        F.when(F.col("rk") == 1, "lot_sqft").when(F.col("rk") == 2, "living_sqft").otherwise(F.col("metric")),
    )
    return quality.profile_conformance(odd)


@query("agg20_reach", f"""
SELECT market, profile, "start", earliest, earliest - "start" AS missing_days FROM (
  SELECT market, profile, DATE '{t.END}' - 2500 AS "start", min(sold_date) AS earliest FROM sold GROUP BY market, profile)
WHERE earliest > "start" """)
def _(w):
    early = F.date_sub(F.lit(t.END).cast("date"), 2500)
    return quality.reach(w.sold, windows(w).withColumn("start", early))


@query("agg21_active_attribution", """
SELECT market, profile, count(*) AS listings, count(*) FILTER (coalesce(agent, '') <> '') AS named
FROM active GROUP BY market, profile HAVING count(*) FILTER (coalesce(agent, '') <> '') < count(*) * 0.8""")
def _(w):
    return quality.active_attribution(w.active)


@query("agg22_window_loss", f"""
SELECT market, profile, count(*) FILTER (sold_date NOT BETWEEN DATE '{t.END}' - {t.WINDOW_DAYS} AND DATE '{t.END}') AS dropped,
  count(*) AS recorded, min(sold_date) AS first_sale, max(sold_date) AS last_sale FROM sold GROUP BY market, profile
HAVING dropped > 0""")
def _(w):
    return quality.window_loss(w.sold, windows(w))


@query("agg23_span_note", f"""
SELECT market, profile, DATE '{t.END}' - {t.WINDOW_DAYS} AS "start", DATE '{t.END}' AS "end", min(sold_date) AS "first",
  max(sold_date) AS "last", CASE WHEN min(sold_date) - (DATE '{t.END}' - {t.WINDOW_DAYS}) > 1
    THEN min(sold_date) - (DATE '{t.END}' - {t.WINDOW_DAYS}) END AS short_days FROM sold GROUP BY market, profile""")
def _(w):
    return quality.span_note(w.sold, windows(w))


@query("agg25_core_figures", """
SELECT p.market, p.profile, core_min AS low, core_max AS high, s."count" AS sold_total, s.core_count AS sold_count,
  s.core_median_ppsf AS sold_median_ppsf, s.core_avg_ppsf AS sold_avg_ppsf, a."count" AS active_total,
  a.core_count AS active_count, a.core_median_ppsf AS active_median_ppsf
FROM profiles p JOIN sold_stats s USING (market, profile) LEFT JOIN active_stats a USING (market, profile)
WHERE core_min IS NOT NULL OR core_max IS NOT NULL""", "low high sold_median_ppsf sold_avg_ppsf active_median_ppsf")
def _(w):
    return reports.core_figures(
        stats.sold_stats(sold_m(w)), stats.active_stats(active_m(w)), w.profiles
    )


@query("agg26_headline", """
SELECT v.market, v.profile, v.subject_id, v.value AS valuation, v.sample_size AS bracket_count, s."count" AS sold_count,
  s.median_ppsf, coalesce(a."count", 0) AS active_count, g.suggested_list, g.at_market, g.floor_price AS "floor"
FROM (SELECT * FROM valued WHERE is_primary) v LEFT JOIN sold_stats s USING (market, profile)
LEFT JOIN active_stats a USING (market, profile)
LEFT JOIN (SELECT market, profile, subject_id, max(list_price) FILTER (recommended) AS suggested_list,
  max(list_price) FILTER (strategy = 'at_market') AS at_market, max("floor") AS floor_price FROM guided GROUP BY ALL) g
  USING (market, profile, subject_id)""", "valuation median_ppsf suggested_list at_market floor")
def _(w):
    return reports.headline(
        stats.sold_stats(sold_m(w)), stats.active_stats(active_m(w)), valued(w), guided(w)
    )


@query("agg27_reading_cost", """
SELECT day, model, count(*) AS calls, CAST(sum(user_id * 10) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens,
  count(*) FILTER (model = 'error') AS failures,
  (sum(user_id * 10) + sum(user_id) * 0.1e0 + sum(user_id % 7) * 1.25e0) * any_value(i) / 1e6
    + sum(user_id) * any_value(o) / 1e6 AS cost_usd
FROM (SELECT CAST(ts AS DATE) AS day, event_type AS model, user_id,
    CASE event_type WHEN 'click' THEN 2e0 WHEN 'view' THEN 5e0 END AS i,
    CASE event_type WHEN 'click' THEN 10e0 WHEN 'view' THEN 25e0 END AS o FROM events) GROUP BY day, model""", "cost_usd")
def _(w):
    u = F.col("user_id")
    usage = w.raw("events").select(
        F.col("ts").cast("date").alias("day"), F.col("event_type").alias("model"),
        F.lit(1).cast("long").alias("calls"), (u * 10).alias("input_tokens"), u.alias("output_tokens"),
        u.alias("cache_read_tokens"), (u % 7).alias("cache_write_tokens"),
        (F.col("event_type") == "error").cast("long").alias("failures"),
    )
    prices = w.spark.createDataFrame(
        [("click", 2.0, 10.0), ("view", 5.0, 25.0)], "model string, input_rate double, output_rate double"
    )
    return quality.usage_cost(usage, prices, ["day"])


@query("agg28_run_warnings", """
SELECT market, profile, 'experimental profile' AS code FROM profiles WHERE profile = 'homes'
UNION ALL SELECT p.market, p.profile, 'no active listings' FROM profiles p WHERE EXISTS (SELECT 1 FROM sold s
  WHERE s.market = p.market AND s.profile = p.profile) AND NOT EXISTS (SELECT 1 FROM active a WHERE a.market = p.market AND a.profile = p.profile)
UNION ALL SELECT p.market, p.profile, 'no sold comps' FROM profiles p WHERE NOT EXISTS (SELECT 1 FROM sold s
  WHERE s.market = p.market AND s.profile = p.profile)
UNION ALL SELECT market, profile, 'few sold comps' FROM sold GROUP BY market, profile HAVING count(*) < 10""")
def _(w):
    return quality.run_warnings(
        w.profiles, stats.sold_stats(sold_m(w)), stats.active_stats(active_m(w))
    )


@query("agg30_empty_active", """
SELECT p.market, p.profile, CASE WHEN s.name IS NOT NULL THEN 'configured sources gave none'
  ELSE 'no active source configured' END AS diagnosis, s.name AS source
FROM (SELECT market, profile FROM profiles UNION ALL SELECT r_name, 'condos' FROM region) p
LEFT JOIN (SELECT DISTINCT r_name AS market, s_name AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_suppkey % 4 = 0) s USING (market)
WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.market = p.market AND a.profile = p.profile)""")
def _(w):
    searched = w.profiles.df.select(*DATASET)
    condos = w.raw("region").select(F.col("r_name").alias("market"), F.lit("condos").alias("profile"))
    return quality.empty_active(searched.unionByName(condos), w.active, sources(w))


@query("snk10_run_ledger", """
SELECT market, profile, kind, count(*) AS n FROM (
  SELECT market, profile, 'rejected' AS kind FROM judged WHERE outcome = 'rejected'
  UNION ALL SELECT market, profile, 'not found' FROM judged WHERE outcome = 'unverifiable'
  UNION ALL SELECT market, profile, 'attribution' FROM active GROUP BY market, profile
    HAVING count(*) FILTER (coalesce(agent, '') <> '') < count(*) * 0.8) GROUP BY ALL""")
def _(w):
    claims = judged(w, ["reason"])
    return quality.ledger_counts(
        quality.diagnostics(
            {
                "rejected": (claims.where("outcome = 'rejected'"), F.col("reason")),
                "not found": (claims.where("outcome = 'unverifiable'"), F.col("reason")),
                "attribution": (quality.active_attribution(w.active), F.col("named")),
            }
        )
    )


# -- reports -----------------------------------------------------------------------------------

@query("snk5_sold_sheet", """
SELECT s.market, s.profile, s.row_ord, s.address, s.sold_date, s.sold_price, s.metric_size, s.ppsf,
  CASE WHEN s.profile = 'homes' THEN s.beds END AS beds, CASE WHEN s.profile = 'homes' THEN s.baths END AS baths,
  CASE WHEN s.profile = 'homes' THEN s.year_built END AS year_built, CAST(NULL AS VARCHAR) AS condition,
  CASE WHEN s.profile = 'homes' THEN s.lot_sqft END AS second_size, s.brokerage, s.agent, s.final_list_price,
  s.original_list_price, s.ratio, s.area,
  CASE WHEN (CASE WHEN b.attribute = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END) BETWEEN b.bracket_low
    AND b.bracket_high THEN s.ppsf END AS bracket_ppsf
FROM sold_a s LEFT JOIN (SELECT * FROM brackets QUALIFY row_number() OVER (PARTITION BY market, profile ORDER BY subject_id) = 1) b
  USING (market, profile)""",
       "sold_price metric_size ppsf beds baths second_size final_list_price original_list_price ratio bracket_ppsf")
def _(w):
    s, _ = placed(w)
    return reports.sold_sheet(s, w.subjects, w.profiles)


@query("snk5_active_sheet", """
SELECT market, profile, row_ord, address, list_price, metric_size, ppsf, brokerage, agent, area FROM active_a""",
       "list_price metric_size ppsf")
def _(w):
    return reports.active_sheet(placed(w)[1])


def _long(names: list[tuple[str, str]], section: str, source: str, alias: str) -> str:
    items = ", ".join(f"{{'key': '{k}', 'label': '{lab}', 'v': CAST(\"{k}\" AS DOUBLE)}}" for k, lab in names)
    return f"(SELECT market, profile, '{section}' AS section, unnest([{items}]) AS u FROM {source}) {alias}"


def _both(names, section):
    return f"""SELECT s.market, s.profile, s.section, s.u.key AS key, s.u.label AS label, s.u.v AS sold, a.u.v AS active
FROM {_long(names, section, "sold_stats", "s")} JOIN {_long(names, section, "active_stats", "a")}
  ON s.market = a.market AND s.profile = a.profile AND s.u.key = a.u.key"""


@query("snk6_summary", f"""
{_both(reports.STAT_ROWS, "stats")} UNION ALL {_both(reports.CORE_ROWS, "core")}
UNION ALL SELECT market, profile, section, u.key, u.label, u.v, NULL FROM {_long(reports.RATIO_ROWS, "stats", "ratios", "r")}
UNION ALL SELECT market, profile, 'value', subject_id || ':' || basis, basis, value, NULL FROM valued
UNION ALL SELECT market, profile, 'bracket', subject_id || ':' || u.key, u.label, u.v, NULL FROM (
  SELECT market, profile, subject_id, unnest([
    {{'key': 'subject_size', 'label': 'Size', 'v': subject_size}},
    {{'key': 'bracket_low', 'label': 'Similar-size bracket low', 'v': bracket_low}},
    {{'key': 'bracket_high', 'label': 'Similar-size bracket high', 'v': bracket_high}},
    {{'key': 'bracket_count', 'label': 'Comps in bracket', 'v': bracket_count::DOUBLE}},
    {{'key': 'ppsf', 'label': 'Bracket median $/sq ft', 'v': ppsf}}]) AS u FROM valued WHERE is_primary)""", "sold active")
def _(w):
    return reports.summary(
        stats.sold_stats(sold_m(w)), stats.active_stats(active_m(w)), stats.sold_to_ask(sold_m(w)), valued(w),
    )


@query("snk6_summary_tables", f"""
SELECT market, profile, 'ladder' AS section, subject_id || ':' || position || ':' || u.key AS key, label, u.v AS sold,
  CAST(NULL AS DOUBLE) AS active FROM (
  SELECT market, profile, subject_id, position, label, unnest([
    {{'key': 'count', 'v': "count"::DOUBLE}}, {{'key': 'median_ppsf', 'v': median_ppsf}}, {{'key': 'avg_ppsf', 'v': avg_ppsf}},
    {{'key': 'value_from_median', 'v': value_from_median}}, {{'key': 'value_from_avg', 'v': value_from_avg}}]) AS u FROM ladder)
UNION ALL SELECT market, profile, 'bands', band || ':' || u.key, label, u.v, NULL FROM (
  SELECT market, profile, band, label || CASE WHEN subjects_in_band > 0 THEN '  <- your property' ELSE '' END AS label, unnest([
    {{'key': 'count', 'v': "count"::DOUBLE}}, {{'key': 'median_ppsf', 'v': median_ppsf}}, {{'key': 'avg_ppsf', 'v': avg_ppsf}},
    {{'key': 'median_size', 'v': median_size}}, {{'key': 'median_price', 'v': median_price}}]) AS u FROM bands)
UNION ALL SELECT market, profile, 'areas', position || ':' || u.key, area, u.s, u.a FROM (
  SELECT market, profile, position, area, unnest([
    {{'key': 'count', 's': sold_count::DOUBLE, 'a': active_count::DOUBLE}},
    {{'key': 'avg_ppsf', 's': sold_avg_ppsf, 'a': active_avg_ppsf}}, {{'key': 'median_ppsf', 's': sold_median_ppsf, 'a': NULL}},
    {{'key': 'median_price', 's': sold_median_price, 'a': NULL}}, {{'key': 'avg_size', 's': sold_avg_size, 'a': NULL}}]) AS u
  FROM area_table)""", "sold active")
def _(w):
    bands = valuation.size_bands(sold_m(w), w.subjects, w.profiles)
    blocks = reports.ladder_block(ladder(w)).unionByName(reports.band_block(bands))
    return blocks.unionByName(reports.area_block(areas.area_table(*placed(w), w.profiles)))


@query("snk7_guidance_report", """
SELECT market, profile, subject_id, position, label, list_price, CASE WHEN expected_low <> 0 AND expected_high <> 0
  THEN '$' || format('{:,.0f}', expected_low) || ' - $' || format('{:,.0f}', expected_high) ELSE '—' END AS expected_range,
  recommended, "floor" FROM guided""", "list_price floor")
def _(w):
    return reports.guidance_report(guided(w))


@query("snk8_agents_report", """
SELECT market, profile, interview_rank, agent, coalesce(brokerage, '—') AS brokerage, closings, avg_sold_to_ask, avg_ppsf,
  avg_size, flag || CASE WHEN dual_agency THEN ' - dual agency' ELSE '' END AS pattern FROM agents_ranked""",
       "avg_sold_to_ask avg_ppsf avg_size")
def _(w):
    return reports.agents_report(agents.interview_order(agent_rows(w)))


@query("snk8_brokerages_report", "SELECT market, profile, family, closings, share FROM brokerages", "share")
def _(w):
    return reports.brokerages_report(agents.brokerage_table(w.sold, w.active))


@query("snk9_text_safety", """
SELECT c_custkey, CASE WHEN regexp_matches(said, '^[=+@-]') THEN '''' || said ELSE said END AS said FROM (
  SELECT c_custkey, (CASE c_custkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN ' ='
    ELSE '' END) || c_name AS said FROM customer)""")
def _(w):
    k = F.col("c_custkey") % 6
    lead = (F.when(k == 0, "=").when(k == 1, "+").when(k == 2, "-").when(k == 3, "@").when(k == 4, " =").otherwise(""))
    return reports.for_export(w.raw("customer").select("c_custkey", F.concat(lead, "c_name").alias("said")))


# -- runs --------------------------------------------------------------------------------------

def prepared(w: Workload) -> analysis.Prepared:
    """The rows of a whole run: window, merge, exclude, reconcile, classify, measure."""
    tables = w.tables()
    tables.sold = in_window(tables.sold, tables.profiles, F.lit(t.END).cast("date"))
    return analysis.prepare(tables)


@query("run1_run_sold_stats", f"SELECT * FROM ({stats_sql('r_sold', 'sold_price')})", _STAT)
def _(w):
    return stats.sold_stats(prepared(w).sold)


@query("run1_run_active_stats", f"SELECT * FROM ({stats_sql('r_active', 'list_price')})", _STAT)
def _(w):
    return stats.active_stats(prepared(w).active)


@query("run1_run_valuation", "SELECT * FROM r_valued", _VAL)
def _(w):
    ready = prepared(w)
    return valuation.value_subjects(ready.sold, ready.active, w.subjects, w.profiles)


@query("run1_run_areas", f"SELECT * FROM ({areas_sql('r_sold', 'r_active')})", _AREA)
def _(w):
    ready = prepared(w)
    return areas.area_table(ready.sold, ready.active, w.profiles)


@query("run1_run_agents", f"SELECT * FROM ({agents_sql('r_sold', 'r_active', 'grp_ord, slot_ord')})", _AG)
def _(w):
    ready = prepared(w)
    return agents.agent_table(ready.sold, ready.active, order="list_ord")


@query("run6_excluded", """
SELECT 'sold' AS side, market, profile, row_ord, address, reason FROM w_judged WHERE reason IS NOT NULL
UNION ALL SELECT 'active', market, profile, row_ord, address, reason FROM w_ajudged WHERE reason IS NOT NULL""")
def _(w):
    return prepared(w).cleaned.excluded


@query("run6_reconciled", """
SELECT market, profile, row_ord, address FROM active_k a WHERE EXISTS (SELECT 1 FROM w_sold s WHERE s.market = a.market
  AND s.profile = a.profile AND s.addr_key = a.addr_key)""")
def _(w):
    return prepared(w).cleaned.reconciled


def scenario_rows(w: Workload):
    """Two what-ifs per dataset: a smaller subject, and the market without one address group."""
    p = w.profiles.df.select(*DATASET)
    none = F.array().cast("array<string>")
    smaller = p.select(
        *DATASET, F.lit(1).alias("scenario_id"), F.lit(3500.0).alias("subject_size"), none.alias("exclude_keys")
    )
    without = p.select(
        *DATASET, F.lit(2).alias("scenario_id"), F.lit(None).cast("double").alias("subject_size"),
        F.array(F.lit("5 kauri rd"), F.lit("11 n birch blvd"), F.lit("9 w kauri dr")).alias("exclude_keys"),
    )
    return smaller.unionByName(without)


@query("run5_what_if", """
SELECT s.market, s.profile || '#2' AS profile, count(*) AS n_sales FROM sold_k s
WHERE addr_key_unit NOT IN ('5 kauri rd', '11 n birch blvd', '9 w kauri dr') GROUP BY s.market, s.profile
UNION ALL SELECT market, profile || '#1', count(*) FROM sold_k GROUP BY market, profile""")
def _(w):
    many = analysis.scenarios_of(w.tables(), scenario_rows(w))
    return many.sold.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("n_sales"))


@query("run5_what_if_values", f"""
SELECT * REPLACE (profile || '#1' AS profile) FROM ({valuation_sql("sold_m", "active_m", "resized")})
UNION ALL SELECT * REPLACE (profile || '#2' AS profile) FROM ({valuation_sql("fewer_sold", "fewer_active")})""", _VAL)
def _(w):
    many = analysis.scenarios_of(w.tables(), scenario_rows(w))
    s = measures.sold_measures(many.sold, many.profiles)
    a = measures.active_measures(many.active, many.profiles)
    return valuation.value_subjects(s, a, many.subjects, many.profiles)


def _archived(w: Workload, *names: str) -> str:
    """Two runs of every dataset, written to the shared folder with the named result tables."""
    root = f"{sizing.shared_folder(w.spark)}/archive-{uuid4()}"
    bs, ba, as_, aa = two_runs(w)
    for stamp, s, a, day in (
        ("20000701T000000Z", bs, ba, EARLIER), ("20010701T013000Z", as_, aa, "2001-06-30"),
    ):
        tables = analysis.Tables(s, a, w.profiles, w.subjects, w.geometry)
        sm = measures.sold_measures(s, w.profiles)
        am = measures.active_measures(a, w.profiles)
        results = {"sold": sm, "active": am, "sold_stats": stats.sold_stats(sm)}
        chosen = {n: results[n] for n in names}
        archive.write_run(chosen, tables, root, stamp, ("1995-01-01", day), "recorded")
    return root


@query("snk1_snk2_run3_archive_roundtrip", f"""
SELECT market, profile, '20000701T000000Z' AS run_at, "count", avg_ppsf, median_ppsf, avg_price, median_price, avg_size,
  min_ppsf, max_ppsf, core_count, core_avg_ppsf, core_median_ppsf, missing_metric_count
FROM (SELECT market, * EXCLUDE (market)
      FROM ({stats_sql(f"(SELECT * FROM sold_m WHERE {KNOWN_SALE})", 'sold_price')}))
UNION ALL
SELECT market, profile, '20010701T013000Z', * EXCLUDE (market, profile)
FROM ({stats_sql("sold_m", 'sold_price')})""", _STAT)
def _(w):
    return archive.read_stored(w.spark, _archived(w, "sold_stats"), "sold_stats")


_RUN_COUNTS = "\nUNION ALL\n".join(
    f"""SELECT p.market, p.profile, '{stamp}' AS run_at, 'recorded' AS researcher,
  (SELECT count(*) FROM {tag}_sold s WHERE s.market = p.market AND s.profile = p.profile) AS sold,
  (SELECT count(*) FROM {tag}_active s WHERE s.market = p.market AND s.profile = p.profile) AS active FROM profiles p"""
    for stamp, tag in (("20000701T000000Z", "before"), ("20010701T013000Z", "after"))
)


@query("agg29_win5_run_summary", _RUN_COUNTS)
def _(w):
    root = _archived(w, "sold", "active")
    runs = archive.list_runs(w.spark, root)
    rows = lambda n: archive.read_stored(w.spark, root, n)
    return archive.run_summary(runs, rows("sold"), rows("active"))


@query("agg19_win6_runs_per_profile", """
SELECT market, profile, 2 AS runs, '20000701T000000Z' AS previous FROM profiles""")
def _(w):
    runs = archive.list_runs(w.spark, _archived(w))
    before = archive.latest_run(runs, F.lit("20010701T013000Z")).withColumnRenamed("run_at", "previous")
    return archive.profiles_with_runs(runs).join(before, DATASET)


@query("win7_run_of_local_day", """
SELECT market, profile, '20010701T013000Z' AS run_at FROM profiles""")
def _(w):
    runs = archive.list_runs(w.spark, _archived(w))
    return archive.runs_on(runs, F.lit("2001-06-30").cast("date"), "America/Los_Angeles")


@query("snk3_archive_names", """
SELECT o_orderkey, trim(regexp_replace(trim(o_orderpriority), '[^A-Za-z0-9._-]+', '-', 'g'), '-.') || '__'
  || coalesce(nullif(trim(regexp_replace(trim(o_orderstatus || ' !'), '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), ''), 'unnamed')
  || '/' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS folder FROM orders""")
def _(w):
    return w.raw("orders").select(
        "o_orderkey",
        archive.run_folder(
            F.col("o_orderpriority"), F.concat("o_orderstatus", F.lit(" !")), F.col("o_orderdate")
        ).alias("folder"),
    )


@query("snk4_rename_profile", """
SELECT market, CASE WHEN market = 'MIDDLE EAST' AND profile = 'lots' THEN 'lots & acreage' ELSE profile END AS profile,
  run_at, 'recorded' AS researcher FROM profiles, (SELECT unnest(['20000701T000000Z', '20010701T013000Z']) AS run_at)""")
def _(w):
    root = _archived(w)
    archive.rename_profile(w.spark, root, "MIDDLE EAST", "lots", "lots & acreage")
    return archive.list_runs(w.spark, root)


@query("srt5_history", """
SELECT market, profile, '20010701T013000Z' AS run_at, row_number() OVER (ORDER BY market, profile) - 1 AS position,
  (SELECT 2 * count(*) - 5 FROM profiles) AS more FROM profiles QUALIFY position < 5""")
def _(w):
    shown, more = archive.history(archive.list_runs(w.spark, _archived(w)), 5)
    return shown.select(*DATASET, "run_at", F.monotonically_increasing_id().alias("position"), F.lit(more).alias("more"))


@query("run4_run7_run8_reopen", f"SELECT * FROM ({stats_sql('o_sold', 'sold_price')})", _STAT)
def _(w):
    tables = archive.collected(w.spark, _archived(w, "sold", "active"), w.geometry.df, stamp="20010701T013000Z")
    return archive.reopen(tables)["sold_stats"]


@query("join13_src13_resolve_profiles", """
SELECT market, profile, origin, window_days, metric FROM (
  SELECT r_name AS market, 'lots' AS profile, 'yours' AS origin, 30 AS window_days, 'lot_sqft' AS metric FROM region WHERE r_regionkey < 2
  UNION ALL SELECT market, profile, 'market', window_days, metric FROM profiles WHERE NOT (profile = 'lots' AND rk < 2)
  UNION ALL SELECT r_name, 'empty-lots', 'built-in', 90, 'lot_sqft' FROM region)""")
def _(w):
    regions = w.raw("region").select(F.col("r_name").alias("market"), "r_regionkey")
    shipped = w.profiles.df
    yours = shipped.join(regions.where("r_regionkey < 2").select("market"), "market").where(
        "profile = 'lots'"
    ).withColumn("window_days", F.lit(30))
    merged = config.resolve_profiles(yours, shipped, config.builtin_profiles(regions))
    return merged.select(*DATASET, "origin", "window_days", "metric")


_FAMILY = ("CASE WHEN upper(brokerage) LIKE 'B%' THEN 'B firms' WHEN upper(brokerage) LIKE '%_3%' ESCAPE '#' "
           "THEN 'Nation 3' ELSE brokerage END")


@query("udf2_caller_families", f"""
SELECT market, profile, family, coalesce(c, 0) AS closings, coalesce(c, 0) / nullif(attributed, 0) AS share,
  coalesce(l, 0) AS active_listings
FROM (SELECT market, profile, {_FAMILY} AS family, count(*) AS c FROM sold WHERE coalesce(brokerage, '') <> '' GROUP BY ALL)
FULL OUTER JOIN (SELECT market, profile, {_FAMILY} AS family, count(*) AS l FROM active
  WHERE coalesce(brokerage, '') <> '' GROUP BY ALL) USING (market, profile, family)
LEFT JOIN (SELECT market, profile, count(*) FILTER (coalesce(brokerage, '') <> '' OR coalesce(agent, '') <> '') AS attributed
  FROM sold GROUP BY ALL) USING (market, profile)""", "share")
def _(w):
    return agents.brokerage_table(w.sold, w.active, [("B firms", ["b*"]), ("Nation 3", ["*?3*"])])
