"""The driver's tables as sold rows, listings and settings.

Line items are sales, parts are properties, suppliers are agents, open orders are listings,
regions are markets and nations hold the subjects. The row derivations are plain SQL that
Spark and the oracle both run; only type names and array literals differ.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from marketval.operators.sizing import Dim
from marketval.plans.analysis import Tables

END = "2001-10-31"
WINDOW_DAYS = 2300

STREETS = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Ginkgo", "Hazel", "Juniper", "Kauri"]
KINDS = [("St", "Street"), ("Ave", "Avenue"), ("Rd", "Road"), ("Dr", "Drive"), ("Ln", "Lane"),
         ("Blvd", "Boulevard")]
SIDES = [("", ""), ("N", "North"), ("E", "East"), ("S", "South"), ("W", "West")]
FIRMS = [("Berkshire Hathaway ", ""), ("BHHS ", ""), ("KW ", ""), ("Keller Williams ", ""), ("eXp ", ""),
         ("Compass ", ""), ("REMAX ", ""), ("", " Sotheby Realty"), ("coldwell banker ", ""), ("", " Homes")]
WAYPOINTS = [(-100.06, 40.019), (-100.03, 40.0165), (-100.0, 40.015), (-99.97, 40.0158), (-99.94, 40.0162)]


def _pick(expr: str, values: list[str]) -> str:
    return f"split_part('{'|'.join(values)}', '|', CAST({expr} % {len(values)} AS INT) + 1)"


def address_sql(num: str, style: str, string: str) -> str:
    """An address whose spelling varies with `style` while its identity depends on `num`."""
    side = (f"CASE WHEN {style} % 2 = 0 THEN {_pick(num, [s for _, s in SIDES])} "
            f"ELSE {_pick(num, [s for s, _ in SIDES])} END")
    kind = (f"CASE WHEN {style} % 3 = 0 THEN {_pick(num, [k for _, k in KINDS])} "
            f"ELSE {_pick(num, [k for k, _ in KINDS])} END")
    unit = f"CASE WHEN {style} % 4 = 3 THEN ' #' || CAST({style} AS {string}) ELSE '' END"
    tail = f"CASE WHEN {style} % 5 = 2 THEN ', Townsville, ZZ 00000' ELSE '' END"
    return (f"CAST({num} AS {string}) || ' ' || {side} || ' ' || {_pick(num, STREETS)} || ' ' || "
            f"{kind} || {unit} || {tail}")


def firm_sql(expr: str, nation: str) -> str:
    before, after = [b for b, _ in FIRMS], [a for _, a in FIRMS]
    return f"{_pick(f'({expr})', before)} || {nation} || {_pick(f'({expr})', after)}"


def sold_sql(string: str, empty: str, one: str) -> str:
    """`empty` is an empty text array; `one` formats an array of one expression."""
    url = one.format(f"'https://idx.example/sold/' || CAST(l_orderkey AS {string})")
    return f"""
SELECT market, profile, row_ord, address, sold_date, sold_price, lot_sqft, living_sqft, beds, baths,
       year_built, CAST(NULL AS {string}) AS condition, brokerage, agent, buyer_agent,
       final_list_price, CASE WHEN l_orderkey % 41 <> 0 THEN final_list_price * (1 + l_discount) END
         AS original_list_price,
       area, lat, lon, lot_size_is_rounded, sources, {empty} AS notes
FROM (
  SELECT *, CASE WHEN l_orderkey % 37 <> 0 THEN ask_base * (1.15e0 - 0.006e0 * l_quantity) END
         AS final_list_price,
         CASE WHEN l_orderkey % 67 = 0 THEN NULL WHEN l_orderkey % 211 = 0 THEN 0e0 ELSE ask_base END
         AS sold_price
  FROM (
    SELECT l_orderkey, l_discount, l_quantity, r_name AS market,
      CASE WHEN l_partkey % 3 = 0 THEN 'homes' ELSE 'lots' END AS profile,
      (l_orderkey * 10 + l_linenumber) * 1000000
        + (CAST(round(l_extendedprice * 100) AS BIGINT) * 31 + l_partkey * 7 + l_suppkey) % 1000000 AS row_ord,
      {address_sql("l_partkey", "l_linenumber", string)} AS address,
      CASE WHEN l_orderkey % 59 <> 0 THEN CAST(l_shipdate AS DATE) END AS sold_date,
      (floor(l_extendedprice / 20000e0) + 1) * 150000e0 + (l_partkey % 997) * 100 + l_linenumber
        AS ask_base,
      CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_orderkey % 223 = 0 THEN 0e0
           WHEN l_suppkey % 11 = 0 AND l_linenumber = 7 THEN p_size * 8000e0
           ELSE p_size * 200e0 + l_linenumber * 10 END AS lot_sqft,
      CASE WHEN l_partkey % 3 = 0 AND l_orderkey % 61 <> 0 THEN 600e0 + p_size * 50 + l_linenumber END
        AS living_sqft,
      CASE WHEN l_partkey % 3 = 0 THEN 1e0 + p_size % 5 END AS beds,
      CASE WHEN l_partkey % 3 = 0 THEN 1e0 + (p_size % 4) * 0.5e0 END AS baths,
      CASE WHEN l_partkey % 3 = 0 THEN 1950 + p_size END AS year_built,
      CASE WHEN l_orderkey % 47 = 0 THEN NULL WHEN l_orderkey % 83 = 0 THEN ''
           ELSE {firm_sql("l_suppkey + l_linenumber", "n_name")} END AS brokerage,
      CASE WHEN l_orderkey % 43 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN '' ELSE s_name END AS agent,
      CASE WHEN l_quantity > 49 AND l_suppkey % 4 = 0 THEN ' ' || s_name
           WHEN l_quantity > 45 THEN 'Buyer ' || CAST(l_linenumber AS {string}) END AS buyer_agent,
      CASE WHEN l_orderkey % 31 = 0 THEN 'NE' END AS area,
      CASE WHEN l_orderkey % 29 <> 0 THEN 40.015e0 + ((l_partkey * 53) % 1601 - 800) * 0.00005e0 END AS lat,
      CASE WHEN l_orderkey % 29 <> 0 THEN -100e0 + ((l_partkey * 37) % 2001 - 1000) * 0.0001e0 END AS lon,
      l_linenumber % 4 = 1 AS lot_size_is_rounded,
      CASE WHEN l_orderkey % 13 <> 0 THEN {url} ELSE {empty} END AS sources
    FROM lineitem
    JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  ) a
) b"""


def active_sql(string: str, empty: str, one: str) -> str:
    url = one.format(f"'https://idx.example/active/' || CAST(o_orderkey AS {string})")
    return f"""
SELECT market, CASE WHEN num % 3 = 0 THEN 'homes' ELSE 'lots' END AS profile, o_orderkey AS row_ord,
  {address_sql("num", "(o_orderkey % 7)", string)} AS address,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE floor(o_totalprice * 1.5e0) + 100000e0 END AS list_price,
  CAST(o_orderdate AS DATE) AS listed_date,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 71 = 0 THEN 50000e0
       ELSE 200e0 * (1 + o_custkey % 50) + o_orderkey % 7 END AS lot_sqft,
  CASE WHEN num % 3 = 0 THEN 600e0 + 50 * (1 + o_custkey % 50) END AS living_sqft,
  CASE WHEN num % 3 = 0 THEN 1e0 + o_custkey % 5 END AS beds,
  CASE WHEN num % 3 = 0 THEN 2e0 END AS baths,
  CASE WHEN num % 3 = 0 THEN CAST(1950 + o_custkey % 50 AS INT) END AS year_built,
  CAST(NULL AS {string}) AS condition,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {firm_sql("o_custkey + o_orderkey", "n_name")} END AS brokerage,
  CASE WHEN o_orderkey % 5 < 2 THEN NULL
       ELSE 'Supplier#' || lpad(CAST(o_custkey % 150 AS {string}), 9, '0') END AS agent,
  CASE WHEN o_orderkey % 31 = 0 THEN 'SW' END AS area,
  CASE WHEN o_orderkey % 29 <> 0 THEN 40.015e0 + ((num * 53) % 1601 - 800) * 0.00005e0 END AS lat,
  CASE WHEN o_orderkey % 29 <> 0 THEN -100e0 + ((num * 37) % 2001 - 1000) * 0.0001e0 END AS lon,
  o_orderkey % 4 = 1 AS lot_size_is_rounded,
  CASE WHEN o_orderkey % 13 <> 0 THEN {url} ELSE {empty} END AS sources, {empty} AS notes
FROM (
  SELECT *, o_custkey * 4 + o_orderkey % 4 AS num, r_name AS market
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderstatus = 'O'
) a"""


PROFILES_FLAT = f"""
SELECT r_name AS market, 'lots' AS profile, r_regionkey AS rk, 'vacant_land' AS property_type,
  'lot_sqft' AS metric, {WINDOW_DAYS} AS window_days, true AS absent_beds, false AS keep_unit,
  'lot_sqft' AS attribute, 0.25e0 AS tolerance,
  CASE WHEN r_regionkey % 2 = 0 THEN 5000e0 END AS explicit_low,
  CASE WHEN r_regionkey % 2 = 0 THEN 8000e0 END AS explicit_high, false AS match_beds,
  43560e0 AS max_lot, CAST(NULL AS DOUBLE) AS min_lot, 30e0 AS core_min, 150e0 AS core_max
FROM region
UNION ALL
SELECT r_name, 'homes', r_regionkey, 'single_family', 'living_sqft', {WINDOW_DAYS}, false, true,
  'living_sqft', 0.25e0, NULL, NULL, r_regionkey % 2 = 0, NULL, 500e0, 200e0,
  CASE WHEN r_regionkey <> 4 THEN 900e0 END
FROM region"""

SUBJECTS = """
SELECT r_name AS market, CASE WHEN n_nationkey % 2 = 0 THEN 'lots' ELSE 'homes' END AS profile,
  CAST(n_nationkey AS BIGINT) AS subject_id,
  CASE WHEN n_nationkey <> 24 THEN 4000e0 + n_nationkey * 250 END AS lot_sqft,
  CASE WHEN n_nationkey <> 23 THEN 1200e0 + n_nationkey * 60 END AS living_sqft,
  CASE WHEN n_nationkey % 3 <> 0 THEN 3e0 END AS beds, 2e0 AS baths, 1990 AS year_built,
  'Subject ' || n_name AS label
FROM nation JOIN region ON n_regionkey = r_regionkey"""

EXCLUDED_KEYS = ["1 n birch ave", "7 e hazel ave", "13 s dogwood ave"]


SPREAD = {
    "lineitem": "l_orderkey", "orders": "o_orderkey", "documents": "doc_id", "pages": "page_id",
    "events": "event_id",
}


@dataclass
class Workload:
    """The driver's tables at one scale, as the engine's inputs."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        """One table. A large one that is read as fewer splits than there are cores is dealt
        out by key first; at scale it has many splits and is left as it is."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in SPREAD and rows.rdd.getNumPartitions() < cores:
            return rows.repartition(cores, SPREAD[name])
        return rows

    def _sql(self, text: str, *names: str) -> DataFrame:
        # Views are named per folder, so that two scales can be open in one session.
        for n in names:
            text = _rename(text, n, f"{{{n}}}")
        return self.spark.sql(text, **{n: self.raw(n) for n in names})

    @cached_property
    def sold(self) -> DataFrame:
        text = sold_sql("STRING", "CAST(array() AS ARRAY<STRING>)", "array({})")
        return self._sql(text, "lineitem", "part", "supplier", "nation", "region")

    @cached_property
    def active(self) -> DataFrame:
        text = active_sql("STRING", "CAST(array() AS ARRAY<STRING>)", "array({})")
        return self._sql(text, "orders", "customer", "nation", "region")

    @cached_property
    def profiles(self) -> Dim:
        flat = self._sql(PROFILES_FLAT, "region")
        keys = ", ".join(f"'{k}'" for k in EXCLUDED_KEYS)
        return Dim(
            flat.selectExpr(
                "market", "profile", "property_type", "metric", "window_days",
                "CASE WHEN profile = 'homes' THEN array('beds', 'baths', 'year_built') "
                "ELSE CAST(array() AS ARRAY<STRING>) END AS attributes",
                "named_struct('requires_absent_bed_bath', absent_beds, 'type_labels', "
                "CASE WHEN profile = 'homes' THEN array('SINGLE_FAMILY', 'HOUSE', 'SFR') "
                "ELSE array('LOT', 'LAND') END, 'exclude_habitable_structure', absent_beds, "
                "'unit_suffix_is_significant', keep_unit) AS identification",
                "named_struct('attribute', attribute, 'tolerance', tolerance, 'explicit_low', "
                "explicit_low, 'explicit_high', explicit_high, 'match_bed_count', match_beds) "
                "AS similar_bracket",
                "named_struct('max_lot_sqft', max_lot, 'min_lot_sqft', min_lot, "
                f"'explicit_address_keys', CASE WHEN profile = 'lots' THEN array({keys}) "
                "ELSE CAST(array() AS ARRAY<STRING>) END, 'core_min_ppsf', core_min, "
                "'core_max_ppsf', core_max) AS exclusions",
            )
        )

    @cached_property
    def subjects(self) -> Dim:
        return Dim(self._sql(SUBJECTS, "nation", "region"))

    @cached_property
    def geometry(self) -> Dim:
        """One market has no east/west divider, so its rows keep the area they came with."""
        points = ", ".join(
            f"named_struct('name', 'w{i}', 'lon', {lon}e0, 'lat', {lat}e0 + r_regionkey * 0.001e0)"
            for i, (lon, lat) in enumerate(WAYPOINTS)
        )
        return Dim(
            self._sql(
                f"SELECT r_name AS market, array({points}) AS ns_centerline, "
                "CASE WHEN r_regionkey <> 3 THEN -100e0 END AS ew_longitude, "
                "'Main St' AS ns_divider_name, 'Centre Ave' AS ew_divider_name FROM region",
                "region",
            )
        )

    def tables(self) -> Tables:
        return Tables(self.sold, self.active, self.profiles, self.subjects, self.geometry)


def _rename(text: str, name: str, to: str) -> str:
    import re

    return re.sub(rf"(?<=FROM ){name}\b|(?<=JOIN ){name}\b", lambda _: to, text)
