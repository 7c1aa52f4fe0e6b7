"""SQL building blocks of the oracle: the same inputs and steps as common table expressions."""

import re

from marketval.constants import (
    DIRECTIONS,
    PLACEHOLDER_NAMES,
    STREET_TYPES,
    UNIT_PATTERN,
)
from workload import tables as t

_CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(word: str, pairs: dict[str, str]) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def close_sql(a: str, b: str, tolerance: float) -> str:
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN TRUE WHEN {a} = {b} THEN TRUE "
        f"ELSE coalesce(abs({a} - {b}) / nullif(greatest(abs({a}), abs({b})), 0) <= {tolerance}e0, FALSE) END)"
    )


def same_sale_sql(k: str, x: str) -> str:
    return f"({close_sql(f'{k}.p', f'{x}.p', 0.005)} AND {close_sql(f'{k}.s', f'{x}.s', 0.05)})"


def street_sql(address: str) -> str:
    """Canonical street words of an address expression."""
    low = f"lower(coalesce({address}, ''))"
    body = f"string_split(regexp_replace({low}, '(?s){UNIT_PATTERN}.*$', ''), ',')[1]"
    words = f"list_filter(string_split(translate({body}, '.', ' '), ' '), lambda w: w <> '')"
    return (
        f"list_transform([{words}], lambda ws: array_to_string(list_transform(ws, lambda w, i: coalesce("
        f"CASE WHEN i <= 2 OR i = len(ws) THEN {_case('w', DIRECTIONS)} END, "
        f"CASE WHEN i = len(ws) THEN {_case('w', STREET_TYPES)} END, w)), ' '))[1]"
    )


def unit_sql(address: str) -> str:
    unit = f"regexp_extract(lower(coalesce({address}, '')), '{UNIT_PATTERN}', 1)"
    return f"CASE WHEN {unit} <> '' THEN '#' || {unit} ELSE '' END"


def join_sql(street: str, unit: str, keep: str) -> str:
    return f"concat_ws(' ', nullif({street}, ''), CASE WHEN {keep} THEN nullif({unit}, '') END)"


def keyed_sql(source: str) -> str:
    return f"""
SELECT k.* EXCLUDE (street, unit), {join_sql("street", "unit", "p.keep_unit")} AS addr_key,
  {join_sql("street", "unit", "TRUE")} AS addr_key_unit, street AS addr_key_bare
FROM (SELECT *, {street_sql("address")} AS street, {unit_sql("address")} AS unit FROM {source}) k
JOIN profiles p USING (market, profile)"""


def fold_sql(source: str) -> str:
    """Kept sales per address key: arrays of structs with o (row), slot (opening row), p, s, c."""
    return f"""
SELECT market, profile, addr_key, list_reduce(list_transform(rows, lambda r: [r]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda k: {same_sale_sql("k", "x[1]")})) = 0 THEN acc || x
  ELSE list_transform(acc, lambda k:
    CASE WHEN k.slot = list_filter(acc, lambda z: {same_sale_sql("z", "x[1]")})[1].slot AND x[1].c > k.c
    THEN {{'o': x[1].o, 'slot': k.slot, 'p': x[1].p, 's': x[1].s, 'c': x[1].c}} ELSE k END) END) AS kept,
  rows[1].o AS grp_ord
FROM (
  SELECT market, profile, addr_key,
    list({{'o': row_ord, 'slot': row_ord, 'p': sold_price, 's': lot_sqft, 'c': {SCORE}}} ORDER BY row_ord) AS rows
  FROM {source} GROUP BY ALL
)"""


SCORE = " + ".join(
    f"CAST({c} IS NOT NULL AS INT)"
    for c in ("lot_sqft", "living_sqft", "brokerage", "agent", "final_list_price", "sold_date", "lat")
)

ARR = "CAST([] AS VARCHAR[])"
cte("sold", t.sold_sql("VARCHAR", ARR, "[{}]"))
cte("active", t.active_sql("VARCHAR", ARR, "[{}]"))
cte("profiles", t.PROFILES_FLAT)
cte("subjects", t.SUBJECTS)
cte("sold_k", keyed_sql("sold"))
cte("active_k", keyed_sql("active"))


def measured_sql(source: str, price: str, sold: bool) -> str:
    ratio = (
        ", nullif(sold_price, 0) / nullif(final_list_price, 0) AS ratio, "
        "coalesce(original_list_price > final_list_price, FALSE) AS reduced"
        if sold
        else ""
    )
    return f"""
SELECT *, coalesce(ppsf IS NOT NULL AND (core_min IS NULL OR ppsf >= core_min)
  AND (core_max IS NULL OR ppsf <= core_max), FALSE) AS core
FROM (
  SELECT *, nullif({price}, 0) / nullif(metric_size, 0) AS ppsf {ratio}
  FROM (
    SELECT s.*, CASE WHEN p.metric = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END AS metric_size,
      p.metric, p.core_min, p.core_max
    FROM {source} s JOIN profiles p USING (market, profile)))"""


cte("sold_m", measured_sql("sold", "sold_price", True))
cte("active_m", measured_sql("active", "list_price", False))
cte("sold_mk", measured_sql("sold_k", "sold_price", True))

cte("fold", fold_sql("sold_k"))
cte("kept", """
SELECT s.*, f.grp_ord, k.slot AS slot_ord
FROM (SELECT market, profile, grp_ord, unnest(kept) AS k FROM fold) f
JOIN sold_k s ON s.market = f.market AND s.profile = f.profile AND s.row_ord = k.o""")


def reason_sql(source: str) -> str:
    keys = quoted(t.EXCLUDED_KEYS)
    return f"""
SELECT *, reason IS NULL AND size IS NULL AS missing_metric FROM (
  SELECT s.*, CASE WHEN p.metric = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END AS size,
    CASE WHEN s.profile = 'lots' AND s.addr_key IN ({keys}) THEN 'on the market''s explicit exclusion list'
      WHEN s.lot_sqft > p.max_lot THEN 'lot ' || format('{{:,.0f}}', s.lot_sqft) || ' sqft exceeds the '
        || format('{{:,.0f}}', p.max_lot) || ' sqft cap'
      WHEN s.lot_sqft < p.min_lot THEN 'lot ' || format('{{:,.0f}}', s.lot_sqft) || ' sqft is below the '
        || format('{{:,.0f}}', p.min_lot) || ' sqft floor' END AS reason
  FROM {source} s JOIN profiles p USING (market, profile))"""


def open_sql(active: str, sold: str) -> str:
    return (f"SELECT * FROM {active} a WHERE NOT EXISTS (SELECT 1 FROM {sold} s WHERE "
            "s.market = a.market AND s.profile = a.profile AND s.addr_key = a.addr_key)")


cte("judged_sold", reason_sql("kept"))
cte("open_active", open_sql("active_k", "sold_k"))
cte("judged_active", reason_sql("open_active"))

_LEGS = ", ".join(
    f"{{'a': {a[0]}e0, 'y': {a[1]}e0, 'b': {b[0]}e0, 'z': {b[1]}e0}}"
    for a, b in zip(t.WAYPOINTS, t.WAYPOINTS[1:])
)
_FIRST, _LAST = t.WAYPOINTS[0], t.WAYPOINTS[-1]


def placed_sql(source: str) -> str:
    """Rows with divider_lat, computed_area and borderline."""
    shift = "(rk * 0.001e0)"
    return f"""
SELECT * EXCLUDE (rk, leg, on_map),
  CASE WHEN on_map THEN (CASE WHEN lat >= divider_lat THEN 'N' ELSE 'S' END)
    || (CASE WHEN lon >= -100e0 THEN 'E' ELSE 'W' END) END AS computed_area,
  on_map AND (abs(lat - divider_lat) < 0.0002e0 OR abs(lon + 100e0) < 0.0002e0) AS borderline
FROM (
  SELECT *, CASE WHEN NOT on_map THEN NULL
    WHEN lon <= {_FIRST[0]}e0 THEN {_FIRST[1]}e0 + {shift}
    WHEN lon >= {_LAST[0]}e0 THEN {_LAST[1]}e0 + {shift}
    ELSE (leg.y + {shift}) + ((leg.z + {shift}) - (leg.y + {shift})) * ((lon - leg.a) / (leg.b - leg.a))
    END AS divider_lat
  FROM (
    SELECT s.*, r_regionkey AS rk,
      lat IS NOT NULL AND lon IS NOT NULL AND r_regionkey <> 3 AS on_map,
      list_filter([{_LEGS}], lambda g: g.a <= lon AND lon <= g.b)[1] AS leg
    FROM {source} s JOIN region ON market = r_name))"""


cte("sold_q", placed_sql("sold_m"))
cte("sold_a", "SELECT * REPLACE (coalesce(computed_area, area) AS area) FROM sold_q")
cte("active_a", "SELECT * REPLACE (coalesce(computed_area, area) AS area) FROM ("
    + placed_sql("active_m") + ")")

# The whole run: window, merge, exclude, reconcile, classify, measure.
cte("w_sold", f"""
SELECT * FROM sold_k WHERE sold_date IS NULL OR sold_date BETWEEN
  DATE '{t.END}' - {t.WINDOW_DAYS} AND DATE '{t.END}'""")
cte("w_fold", fold_sql("w_sold"))
cte("w_kept", """
SELECT s.*, f.grp_ord, k.slot AS slot_ord
FROM (SELECT market, profile, grp_ord, unnest(kept) AS k FROM w_fold) f
JOIN w_sold s ON s.market = f.market AND s.profile = f.profile AND s.row_ord = k.o""")
cte("w_judged", reason_sql("w_kept"))
cte("w_in", "SELECT * EXCLUDE (reason, missing_metric, size) FROM w_judged WHERE reason IS NULL")
cte("r_sold", "SELECT * REPLACE (coalesce(computed_area, area) AS area) FROM ("
    + placed_sql("(" + measured_sql("w_in", "sold_price", True) + ")") + ")")
cte("w_open", open_sql("active_k", "w_sold"))
cte("w_ajudged", reason_sql("w_open"))
cte("w_ain", "SELECT * EXCLUDE (reason, missing_metric, size) FROM w_ajudged WHERE reason IS NULL")
cte("r_active", "SELECT * REPLACE (coalesce(computed_area, area) AS area) FROM ("
    + placed_sql("(" + measured_sql("w_ain", "list_price", False) + ")") + ")")

def brackets_sql(subjects: str) -> str:
    return f"""
SELECT market, profile, subject_id, subject_size, center, attribute,
  CASE WHEN center IS NULL THEN NULL WHEN explicit_low IS NOT NULL THEN explicit_low
    ELSE center * (1 - tolerance) END AS bracket_low,
  CASE WHEN center IS NULL THEN NULL WHEN explicit_high IS NOT NULL THEN explicit_high
    ELSE center * (1 + tolerance) END AS bracket_high,
  CASE WHEN match_beds THEN beds END AS bed_rule
FROM (
  SELECT s.*, p.attribute, p.tolerance, p.explicit_low, p.explicit_high, p.match_beds,
    CASE WHEN p.attribute = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END AS center,
    CASE WHEN p.metric = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END AS subject_size
  FROM {subjects} s JOIN profiles p USING (market, profile))"""


cte("brackets", brackets_sql("subjects"))
# What-ifs: a subject of another size, and a market without some addresses.
cte("resized", brackets_sql("""(SELECT s.* REPLACE (CASE WHEN p.metric = 'lot_sqft' THEN 3500e0 ELSE s.lot_sqft END AS lot_sqft,
  CASE WHEN p.metric = 'living_sqft' THEN 3500e0 ELSE s.living_sqft END AS living_sqft)
  FROM subjects s JOIN profiles p ON p.market = s.market AND p.profile = s.profile)"""))
FEWER = "addr_key_unit NOT IN ('5 kauri rd', '11 n birch blvd', '9 w kauri dr')"
cte("fewer_sold", measured_sql(f"(SELECT * FROM sold_k WHERE {FEWER})", "sold_price", True))
cte("fewer_active", measured_sql(f"(SELECT * FROM active_k WHERE {FEWER})", "list_price", False))


def pairs_sql(sold: str, brackets: str = "brackets") -> str:
    return f"""
SELECT b.*, s.row_ord, s.ppsf FROM {sold} s JOIN {brackets} b USING (market, profile)
WHERE (CASE WHEN b.attribute = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END)
  BETWEEN b.bracket_low AND b.bracket_high
  AND (b.bed_rule IS NULL OR coalesce(s.beds = b.bed_rule, FALSE))"""


def valuation_sql(sold: str, active: str, brackets: str = "brackets") -> str:
    return f"""
SELECT market, profile, subject_id, subject_size, bracket_low, bracket_high, bracket_count,
  u.position, u.basis, u.ppsf, u.sample_size, u.position = 0 AS is_primary,
  u.ppsf * nullif(subject_size, 0) AS value
FROM (
  SELECT b.*, coalesce(n0, 0) AS bracket_count, unnest([
    {{'position': 0, 'basis': 'similar_size_median', 'ppsf': r0, 'sample_size': coalesce(n0, 0)}},
    {{'position': 1, 'basis': 'similar_size_avg', 'ppsf': r1, 'sample_size': coalesce(n0, 0)}},
    {{'position': 2, 'basis': 'all_sold_median', 'ppsf': r2, 'sample_size': coalesce(n2, 0)}},
    {{'position': 3, 'basis': 'all_sold_avg', 'ppsf': r3, 'sample_size': coalesce(n2, 0)}},
    {{'position': 4, 'basis': 'active_median', 'ppsf': r4, 'sample_size': coalesce(n4, 0)}}]) AS u
  FROM {brackets} b
  LEFT JOIN (SELECT market, profile, subject_id, count(ppsf) AS n0, median(ppsf) AS r0, avg(ppsf) AS r1
    FROM ({pairs_sql(sold, brackets)}) GROUP BY ALL) x USING (market, profile, subject_id)
  LEFT JOIN (SELECT market, profile, count(ppsf) AS n2, median(ppsf) AS r2, avg(ppsf) AS r3
    FROM {sold} GROUP BY ALL) y USING (market, profile)
  LEFT JOIN (SELECT market, profile, count(ppsf) AS n4, median(ppsf) AS r4
    FROM {active} GROUP BY ALL) z USING (market, profile))"""


cte("valued", valuation_sql("sold_m", "active_m"))
cte("r_valued", valuation_sql("r_sold", "r_active"))


def stats_sql(source: str, price: str) -> str:
    return f"""
SELECT market, profile, count(*) AS "count", avg(ppsf) AS avg_ppsf, median(ppsf) AS median_ppsf,
  avg({price}) AS avg_price, median({price}) AS median_price, avg(metric_size) AS avg_size,
  min(ppsf) AS min_ppsf, max(ppsf) AS max_ppsf, count(*) FILTER (core) AS core_count,
  avg(ppsf) FILTER (core) AS core_avg_ppsf, median(ppsf) FILTER (core) AS core_median_ppsf,
  count(*) FILTER (ppsf IS NULL) AS missing_metric_count
FROM {source} GROUP BY market, profile"""


cte("sold_stats", stats_sql("sold_m", "sold_price"))
cte("active_stats", stats_sql("active_m", "list_price"))
cte("r_sold_stats", stats_sql("r_sold", "sold_price"))
cte("r_active_stats", stats_sql("r_active", "list_price"))


def ratios_sql(source: str) -> str:
    return f"""
SELECT market, profile, count(ratio) AS "count", avg(ratio) AS mean_ratio, median(ratio) AS median_ratio,
  count(*) FILTER (ratio >= 1.0) AS at_or_above_ask, count(*) FILTER (ratio >= 1.05e0) AS at_or_above_105,
  count(*) FILTER (ratio < 0.9e0) AS below_90, max(ratio) AS max_ratio, min(ratio) AS min_ratio,
  count(*) FILTER (reduced) AS reduced_count,
  count(*) FILTER (ratio >= 1.0) / nullif(count(ratio), 0) AS share_at_or_above_ask
FROM {source} GROUP BY market, profile"""


cte("ratios", ratios_sql("sold_m"))
cte("points", """
SELECT market, profile, count(ratio) AS n_ratios, min(ratio) AS min_ratio, max(ratio) AS max_ratio,
  quantile_cont(ratio, 0.15) AS p15, quantile_cont(ratio, 0.45) AS p45, quantile_cont(ratio, 0.60) AS p60,
  quantile_cont(ratio, 0.90) AS p90
FROM sold_m GROUP BY market, profile""")

_K = "round_even({} / 1000, 0) * 1000"


def guidance_sql(valued: str, points: str = "points") -> str:
    band = "floor(trunc(anchor) / 50000) * 50000 - 1000"
    market = "floor(trunc(anchor) / 10000) * 10000 - 1000"
    high = "floor(trunc(anchor * (1 + 0.055e0)) / 10000) * 10000 - 1000"
    return f"""
SELECT market, profile, subject_id, anchor, floor_price AS "floor", u.position, u.strategy, u.list_price,
  u.expected_low, u.expected_high, coalesce(compete < floor_price, FALSE) AS below_floor,
  CASE WHEN u.position = 0 AND compete < floor_price THEN 'A. Price to compete (below your floor)'
    WHEN u.position = 0 THEN 'A. Price to compete (recommended)'
    WHEN u.position = 1 THEN 'B. Price at market' ELSE 'C. Anchor high' END AS label,
  CASE WHEN compete < floor_price THEN u.position = 1 ELSE u.position = 0 END AS recommended,
  CASE u.position WHEN 0 THEN 'under_search_cutoff' WHEN 1 THEN 'near_estimate' ELSE 'over_estimate' END AS tradeoff,
  CASE WHEN u.position = 0 THEN compete + 1000 END AS cutoff, anchor - u.list_price AS under_estimate,
  (anchor - u.list_price) / nullif(anchor, 0) AS under_share, CASE WHEN u.position = 1 THEN min_ratio END AS min_ratio,
  CASE WHEN u.position = 1 THEN max_ratio END AS max_ratio, CASE WHEN u.position = 2 THEN 0.055e0 END AS premium,
  CASE WHEN anchor <> 0 THEN '5% below the estimate' END AS floor_basis
FROM (
  SELECT *, unnest([
    {{'position': 0, 'strategy': 'compete', 'list_price': compete,
      'expected_low': {_K.format("(compete * p45)")}, 'expected_high': {_K.format("(compete * p90)")}}},
    {{'position': 1, 'strategy': 'at_market', 'list_price': at_market,
      'expected_low': {_K.format("(at_market * p15)")}, 'expected_high': {_K.format("(at_market * p60)")}}},
    {{'position': 2, 'strategy': 'anchor_high', 'list_price': high,
      'expected_low': {_K.format("(high * p15)")}, 'expected_high': {_K.format("(high * p60)")}}}]) AS u
  FROM (
    SELECT v.market, v.profile, v.subject_id, v.value AS anchor, {band.replace("anchor", "v.value")} AS compete,
      {market.replace("anchor", "v.value")} AS at_market, {high.replace("anchor", "v.value")} AS high,
      {_K.format("(v.value * (1 - 0.05e0))")} AS floor_price, p.* EXCLUDE (market, profile)
    FROM {valued} v LEFT JOIN {points} p USING (market, profile)
    WHERE v.is_primary AND v.value IS NOT NULL))"""


cte("guided", guidance_sql("valued"))


def family_sql(name: str) -> str:
    u = f"upper({name})"
    return (
        f"CASE WHEN coalesce({name}, '') = '' THEN NULL "
        f"WHEN {u} LIKE 'BERKSHIRE%' OR {u} LIKE 'BHHS%' THEN 'Berkshire Hathaway HomeServices' "
        f"WHEN {u} LIKE 'KELLER WILLIAMS%' OR {u} LIKE 'KW%' THEN 'Keller Williams' "
        f"WHEN {u} LIKE 'EXP%' THEN 'eXp Realty' "
        f"WHEN {u} LIKE '%SOTHEBY%' THEN 'Sotheby''s International Realty' "
        f"WHEN {u} LIKE 'COLDWELL BANKER%' THEN 'Coldwell Banker' "
        f"WHEN {u} LIKE 'COMPASS%' THEN 'Compass' "
        f"WHEN {u} LIKE 'RE/MAX%' OR {u} LIKE 'REMAX%' THEN 'RE/MAX' "
        f"WHEN {u} LIKE 'THE AGENCY%' THEN 'The Agency' ELSE {name} END"
    )


def agents_sql(sold: str, active: str, order: str) -> str:
    return f"""
SELECT market, profile, agent, {family_sql("firm")} AS brokerage, coalesce(closings, 0) AS closings,
  avg_sold_to_ask, median_sold_to_ask, avg_ppsf, avg_size, median_size,
  coalesce(active_listings, 0) AS active_listings,
  CASE WHEN avg_sold_to_ask IS NULL THEN ''
    WHEN coalesce(closings, 0) >= 2 AND avg_sold_to_ask >= 1 THEN 'shortlist'
    WHEN coalesce(any_reduced, FALSE) AND avg_sold_to_ask < 0.95e0 THEN 'caution' ELSE '' END AS flag,
  coalesce(dual, FALSE) AS dual_agency
FROM (
  SELECT market, profile, agent, count(*) AS closings, avg(ratio) AS avg_sold_to_ask,
    median(ratio) AS median_sold_to_ask, avg(ppsf) AS avg_ppsf, avg(metric_size) AS avg_size,
    median(metric_size) AS median_size, bool_or(reduced) AS any_reduced,
    first(brokerage ORDER BY {order}) FILTER (coalesce(brokerage, '') <> '') AS firm,
    bool_or(coalesce(coalesce(buyer_agent, '') <> '' AND trim(buyer_agent) = trim(agent), FALSE)) AS dual
  FROM {sold} WHERE coalesce(agent, '') <> '' GROUP BY market, profile, agent)
FULL OUTER JOIN (
  SELECT market, profile, agent, count(*) AS active_listings FROM {active}
  WHERE coalesce(agent, '') <> '' GROUP BY market, profile, agent) USING (market, profile, agent)"""


RANK = ("row_number() OVER (PARTITION BY market, profile ORDER BY flag <> 'shortlist', closings DESC, "
        "coalesce(median_sold_to_ask, 0) DESC, agent)")
cte("agents", agents_sql("sold_m", "active_m", "row_ord"))
cte("agents_ranked", f"SELECT *, {RANK} AS interview_rank FROM agents")
cte("brokerages", f"""
SELECT market, profile, family, coalesce(c, 0) AS closings, coalesce(c, 0) / nullif(attributed, 0) AS share,
  coalesce(l, 0) AS active_listings
FROM (SELECT market, profile, {family_sql("brokerage")} AS family, count(*) AS c FROM sold_m
      WHERE coalesce(brokerage, '') <> '' GROUP BY ALL)
FULL OUTER JOIN (SELECT market, profile, {family_sql("brokerage")} AS family, count(*) AS l FROM active_m
      WHERE coalesce(brokerage, '') <> '' GROUP BY ALL) USING (market, profile, family)
LEFT JOIN (SELECT market, profile, count(*) FILTER (coalesce(brokerage, '') <> '' OR coalesce(agent, '') <> '')
      AS attributed FROM sold_m GROUP BY ALL) USING (market, profile)""")


def edges_sql(sold: str) -> str:
    return f"""
SELECT market, profile, greatest(least(5, n // 3), 1) AS bands, n AS n_sized, list_transform(
  range(0, greatest(least(5, n // 3), 1) + 1), lambda i: CASE WHEN i = greatest(least(5, n // 3), 1)
    THEN xs[n] ELSE xs[CAST(round_even(i * n / greatest(least(5, n // 3), 1), 0) AS BIGINT) + 1] END) AS bounds
FROM (SELECT market, profile, count(*) AS n, list(metric_size ORDER BY metric_size) AS xs FROM {sold}
      WHERE metric_size IS NOT NULL GROUP BY market, profile)"""


def place_sql(x: str) -> str:
    return (f"list_filter(range(0, bands), lambda i: bounds[i + 1] <= {x} AND ({x} < bounds[i + 2] OR "
            f"(i = bands - 1 AND {x} <= bounds[i + 2])))[1]")


def bands_sql(sold: str) -> str:
    return f"""
SELECT m.market, m.profile, band, format('{{:,.0f}}', e.bounds[band + 1]) || '-'
    || format('{{:,.0f}}', e.bounds[band + 2]) || ' sqft' AS label,
  e.bounds[band + 1] AS low, e.bounds[band + 2] AS high, m."count", median_ppsf, avg_ppsf, median_size,
  median_price, coalesce(held, 0) AS subjects_in_band
FROM (
  SELECT s.market, s.profile, {place_sql("s.metric_size")} AS band, count(*) AS "count",
    median(ppsf) AS median_ppsf, avg(ppsf) AS avg_ppsf, median(metric_size) AS median_size,
    median(sold_price) AS median_price
  FROM {sold} s JOIN edges USING (market, profile) WHERE metric_size IS NOT NULL GROUP BY ALL) m
JOIN edges e USING (market, profile)
LEFT JOIN (
  SELECT market, profile, {place_sql("subject_size")} AS band, count(*) AS held
  FROM brackets JOIN edges USING (market, profile) GROUP BY ALL) h USING (market, profile, band)"""


cte("edges", edges_sql("sold_m"))
cte("bands", bands_sql("sold_m"))

_RUNGS = ", ".join(
    f"{{'width': {w}e0, 'mine': FALSE, 'lo': center * {1 - w!r}e0, 'hi': center * {1 + w!r}e0, 'name': '+/-{w:.0%}'}}"
    for w in (0.10, 0.15, 0.25, 0.40, 0.60, 1.00)
)
cte("rungs", f"""
SELECT market, profile, subject_id, subject_size, attribute, idx - 1 AS position, r.lo AS low, r.hi AS high,
  r.mine AS is_profile_bracket, r.name || '  (' || format('{{:,.0f}}', r.lo) || '-'
    || format('{{:,.0f}}', r.hi) || ' sqft)' AS label
FROM (
  SELECT *, generate_subscripts(rs, 1) AS idx, unnest(rs) AS r FROM (
    SELECT *, list_sort(list_filter([{_RUNGS}], lambda r: abs(r.width - own) > 0.005e0)
      || [{{'width': own, 'mine': TRUE, 'lo': bracket_low, 'hi': bracket_high, 'name': 'this search'}}]) AS rs
    FROM (SELECT *, greatest(abs(bracket_high - center), abs(center - bracket_low)) / center AS own
          FROM brackets WHERE center IS NOT NULL AND subject_size IS NOT NULL)))""")
cte("ladder", """
SELECT market, profile, subject_id, position, label, low, high, "count", median_ppsf, avg_ppsf,
  is_profile_bracket, is_all_sold, median_ppsf * subject_size AS value_from_median,
  avg_ppsf * subject_size AS value_from_avg, "count" < 3 AS is_thin
FROM (
  SELECT r.market, r.profile, r.subject_id, r.position, label, low, high, subject_size,
    coalesce(n, 0) AS "count", median_ppsf, avg_ppsf, is_profile_bracket, FALSE AS is_all_sold
  FROM rungs r LEFT JOIN (
    SELECT q.market, q.profile, q.subject_id, q.position, count(*) AS n, median(ppsf) AS median_ppsf,
      avg(ppsf) AS avg_ppsf
    FROM sold_m s JOIN rungs q USING (market, profile)
    WHERE (CASE WHEN q.attribute = 'living_sqft' THEN s.living_sqft ELSE s.lot_sqft END)
      BETWEEN q.low AND q.high GROUP BY ALL) f USING (market, profile, subject_id, position)
  UNION ALL
  SELECT market, profile, subject_id, max(position) + 1, 'every sale (' || any_value(n) || ')', NULL, NULL,
    max(subject_size), any_value(n), any_value(median_ppsf), any_value(avg_ppsf), FALSE, TRUE
  FROM rungs JOIN (SELECT market, profile, count(*) AS n, median(ppsf) AS median_ppsf, avg(ppsf) AS avg_ppsf
                   FROM sold_m GROUP BY ALL) USING (market, profile)
  GROUP BY market, profile, subject_id)""")


def areas_sql(sold: str, active: str) -> str:
    label = "CASE WHEN area IN ('NE', 'SE') THEN 'East of divider' ELSE 'West of divider' END"
    both = "SELECT *, unnest([area, {l}]) AS lab FROM {s} WHERE area IS NOT NULL"
    return f"""
SELECT k.market, k.profile, k.position, k.lab AS area, coalesce(sold_count, 0) AS sold_count, sold_avg_ppsf,
  sold_median_ppsf, sold_median_price, sold_avg_size, coalesce(active_count, 0) AS active_count, active_avg_ppsf
FROM (SELECT market, profile, unnest([0, 1, 2, 3, 4, 5]) AS position,
        unnest(['NE', 'NW', 'SE', 'SW', 'East of divider', 'West of divider']) AS lab FROM profiles) k
LEFT JOIN (SELECT market, profile, lab, count(*) AS sold_count, avg(ppsf) AS sold_avg_ppsf,
    median(ppsf) AS sold_median_ppsf, median(sold_price) AS sold_median_price, avg(metric_size) AS sold_avg_size
  FROM ({both.format(l=label, s=sold)}) GROUP BY market, profile, lab) USING (market, profile, lab)
LEFT JOIN (SELECT market, profile, lab, count(*) AS active_count, avg(ppsf) AS active_avg_ppsf
  FROM ({both.format(l=label, s=active)}) GROUP BY market, profile, lab) USING (market, profile, lab)"""


cte("area_table", areas_sql("sold_a", "active_a"))

# Claims: facts that a reader of each sale's page would have landed.
FACTS = """
SELECT market, profile, row_ord, address, '{url}' || CAST(row_ord % 1000 AS {s}) AS url,
  CASE WHEN row_ord % 7 = 0 THEN 'Out Of Area Out Of Area' WHEN row_ord % 11 = 0 THEN 'unknown'
       ELSE 'Agent ' || CAST(row_ord % 50 AS {s}) END AS listing_agent,
  CASE WHEN row_ord % 5 <> 0 THEN 'Firm  ' || CAST(row_ord % 20 AS {s}) END AS listing_brokerage,
  CASE WHEN row_ord % 9 = 0 THEN 'Buyer ' || CAST(row_ord % 30 AS {s}) WHEN row_ord % 9 = 1 THEN '' END AS buyer_agent,
  CAST(NULL AS {s}) AS buyer_brokerage, row_ord % 17 = 0 AS dual_agency_stated,
  CASE WHEN row_ord % 13 = 0 THEN NULL WHEN row_ord % 19 = 0 THEN sold_price * 2
       ELSE sold_price + 100 END AS stated_sold_price,
  CASE WHEN row_ord % 6 <> 0 THEN CAST(sold_date AS {s}) || 'T00:00:00'
       WHEN row_ord % 4 = 0 THEN '1998-05-05' END AS stated_sold_date,
  CASE WHEN row_ord % 3 <> 0 THEN floor(sold_price * 1.01e0) END AS final_list_price,
  CASE WHEN row_ord % 4 <> 0 THEN floor(sold_price * 1.05e0) END AS original_list_price,
  CASE WHEN row_ord % 2 = 0 THEN 5000e0 END AS lot_sqft, CAST(NULL AS DOUBLE) AS living_sqft,
  row_ord % 23 = 0 AS page_is_about_a_different_property, CAST(NULL AS {s}) AS notes
FROM {src}"""
cte("facts", FACTS.format(url="https://page.example/", s="VARCHAR", src="sold"))
cte("claims", """
SELECT market, profile, row_ord * 8 + c.i AS claim_ord, address, c.f AS field_name, c.v AS value,
  url AS source_url, stated_sold_price AS claimed_price,
  try_cast(left(stated_sold_date, 10) AS DATE) AS claimed_date
FROM (SELECT *, unnest([
    {'i': 0, 'f': 'agent', 'v': listing_agent}, {'i': 1, 'f': 'brokerage', 'v': listing_brokerage},
    {'i': 2, 'f': 'buyer_agent', 'v': buyer_agent},
    {'i': 3, 'f': 'final_list_price', 'v': CAST(final_list_price AS VARCHAR)},
    {'i': 4, 'f': 'original_list_price', 'v': CAST(original_list_price AS VARCHAR)},
    {'i': 5, 'f': 'lot_sqft', 'v': CAST(lot_sqft AS VARCHAR)},
    {'i': 6, 'f': 'living_sqft', 'v': CAST(living_sqft AS VARCHAR)},
    {'i': 7, 'f': 'buyer_agent', 'v': CASE WHEN dual_agency_stated THEN listing_agent END}]) AS c
  FROM facts WHERE NOT coalesce(page_is_about_a_different_property, FALSE))
WHERE coalesce(c.v, '') <> ''""")


def clean_name_sql(x: str) -> str:
    text = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    plain = f"regexp_replace(lower({text}), '^[ .,]+|[ .,]+$', '', 'g')"
    words = f"string_split({plain}, ' ')"
    half = f"array_to_string(list_slice({words}, 1, len({words}) // 2), ' ')"
    rest = f"array_to_string(list_slice({words}, len({words}) // 2 + 1, len({words})), ' ')"
    bad = quoted(PLACEHOLDER_NAMES)
    return (
        f"CASE WHEN {text} = '' OR {plain} IN ({bad}) OR (len({words}) % 2 = 0 AND {half} = {rest} "
        f"AND {half} IN ({bad})) THEN NULL ELSE {text} END"
    )


def verdict_sql(price: str, day: str) -> str:
    """'' when accepted, else the reason."""
    miss = (f"NOT coalesce(CASE WHEN {price} = 0 THEN claimed_price = 0 ELSE "
            f"abs({price} - claimed_price) / abs(nullif({price}, 0)) <= 0.005e0 END, FALSE)")
    return f"""CASE WHEN claimed_price IS NULL AND claimed_date IS NULL THEN 'no evidence offered: neither a price nor a date'
  WHEN claimed_price IS NOT NULL AND {miss} AND coalesce({price}, 0) = 0 THEN 'no known price to check'
  WHEN claimed_price IS NOT NULL AND {miss} THEN 'price ' || format('{{:,.0f}}', claimed_price)
    || ' does not match the known ' || format('{{:,.0f}}', {price})
  WHEN claimed_price IS NOT NULL AND claimed_date IS NOT NULL AND {day} IS NOT NULL
    AND abs({day} - claimed_date) > 21 THEN 'price matches but the date ' || CAST(claimed_date AS VARCHAR)
    || ' is far from the known ' || CAST({day} AS VARCHAR) || '; probably a different transaction'
  WHEN claimed_price IS NOT NULL THEN ''
  ELSE 'no price offered, and a date alone is not enough' END"""


cte("claims_k", keyed_sql("claims"))
cte("judged0", f"""
SELECT c.*, t.row_ord, {clean_name_sql("value")} AS named, {verdict_sql("t.sold_price", "t.sold_date")} AS why,
  CASE field_name WHEN 'agent' THEN t.agent WHEN 'brokerage' THEN t.brokerage
    WHEN 'buyer_agent' THEN t.buyer_agent WHEN 'final_list_price' THEN CAST(t.final_list_price AS VARCHAR)
    WHEN 'original_list_price' THEN CAST(t.original_list_price AS VARCHAR)
    WHEN 'lot_sqft' THEN CAST(t.lot_sqft AS VARCHAR)
    WHEN 'living_sqft' THEN CAST(t.living_sqft AS VARCHAR) END AS existing,
  field_name IN ('agent', 'brokerage', 'buyer_agent') AS party
FROM claims_k c LEFT JOIN (
  SELECT * FROM sold_k QUALIFY row_number() OVER (PARTITION BY market, profile, addr_key ORDER BY row_ord DESC) = 1
) t ON c.market = t.market AND c.profile = t.profile AND c.addr_key = t.addr_key""")
cte("judged", """
SELECT * REPLACE (CASE WHEN outcome = 'accepted' AND claim_ord <> min(claim_ord) FILTER (outcome = 'accepted')
    OVER (PARTITION BY market, profile, row_ord, field_name) THEN 'known' ELSE outcome END AS outcome)
FROM (
  SELECT market, profile, claim_ord, row_ord, field_name, CASE WHEN party THEN named ELSE value END AS clean_value,
    source_url,
    CASE WHEN row_ord IS NULL THEN 'unverifiable' WHEN party AND named IS NULL AND value <> '' THEN 'rejected'
      WHEN (CASE WHEN party THEN named ELSE value END) IN ('', '-', '—') THEN 'skipped'
      WHEN why <> '' THEN 'rejected' WHEN existing IS NOT NULL THEN 'known' ELSE 'accepted' END AS outcome,
    CASE WHEN row_ord IS NULL THEN 'no comp with that address in this run'
      WHEN party AND named IS NULL AND value <> '' THEN 'placeholder name, not a real party'
      WHEN why <> '' THEN why END AS reason
  FROM judged0)""")

# Two runs: all rows, and those known by a day before, undated ones in both. Since then every tenth
# listing was withdrawn and every third ask lowered.
EARLIER = "2000-06-30"
cte("before_sold", f"SELECT * FROM sold_k WHERE sold_date IS NULL OR sold_date <= DATE '{EARLIER}'")
cte("after_sold", "SELECT * FROM sold_k")
cte("before_active", f"SELECT * FROM active_k WHERE listed_date IS NULL OR listed_date <= DATE '{EARLIER}'")
cte("after_active", f"""SELECT * REPLACE (list_price * (CASE WHEN row_ord % 3 = 0 THEN 0.97e0 ELSE 1e0 END) AS list_price)
FROM active_k WHERE row_ord % 10 <> 0 OR listed_date > DATE '{EARLIER}'""")

# The later run's rows analyzed again.
cte("o_fold", fold_sql("after_sold"))
cte("o_kept", """
SELECT s.*, f.grp_ord, k.slot AS slot_ord
FROM (SELECT market, profile, grp_ord, unnest(kept) AS k FROM o_fold) f
JOIN after_sold s ON s.market = f.market AND s.profile = f.profile AND s.row_ord = k.o""")
cte("o_judged", reason_sql("o_kept"))
cte("o_in", "SELECT * EXCLUDE (reason, missing_metric, size) FROM o_judged WHERE reason IS NULL")
cte("o_sold", measured_sql("o_in", "sold_price", True))


def lastkey_sql(source: str) -> str:
    return (f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY market, profile, addr_key_unit "
            "ORDER BY row_ord DESC) = 1")


def missing_from(source: str) -> str:
    return (f"NOT EXISTS (SELECT 1 FROM {source} o WHERE o.market = c.market AND o.profile = c.profile "
            "AND o.addr_key_unit = c.addr_key_unit)")


cte("changes", f"""
SELECT market, profile, 'new_sale' AS category, address, CAST(NULL AS DOUBLE) AS before, CAST(NULL AS DOUBLE) AS after
FROM ({lastkey_sql("after_sold")}) c WHERE {missing_from("before_sold")}
UNION ALL SELECT market, profile, 'newly_closed', address, NULL, NULL
FROM ({lastkey_sql("after_sold")}) c WHERE {missing_from("before_sold")} AND {missing_from("before_active")[4:]}
UNION ALL SELECT market, profile, 'new_active', address, NULL, NULL
FROM ({lastkey_sql("after_active")}) c WHERE {missing_from("before_active")}
UNION ALL SELECT market, profile, 'gone', address, NULL, NULL
FROM ({lastkey_sql("before_active")}) c WHERE {missing_from("after_active")} AND {missing_from("after_sold")}
UNION ALL SELECT market, profile, 'price_cut', a.address, b.list_price, a.list_price
FROM ({lastkey_sql("after_active")}) a JOIN ({lastkey_sql("before_active")}) b
  USING (market, profile, addr_key_unit)
WHERE b.list_price <> 0 AND a.list_price <> 0 AND a.list_price < b.list_price""")


_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def with_ctes(body: str) -> str:
    """The body under every common table expression it needs, in order of definition."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(_WORD.findall(sql)):
            if word in _CTES and word not in needed and re.search(rf"(FROM|JOIN)\s+\(*{word}\b", sql):
                needed.add(word)
                visit(_CTES[word])

    visit(body)
    if not needed:
        return body
    heads = ",\n".join(f"{n} AS ({_CTES[n]})" for n in _CTES if n in needed)
    return f"WITH {heads}\n{body}"


def rounded(body: str, columns: str) -> str:
    """The body with its floating columns rounded as the queries round theirs."""
    if not columns:
        return body
    items = ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns.split())
    return f"SELECT * REPLACE ({items}) FROM ({body})"
