"""Queries over collected material: recorded JSON, page data, page text, fetched pages."""

from pyspark.sql import functions as F

from marketval.constants import FOCUS_HEAD, FOCUS_MAX_CHARS, FOCUS_TERMS, FOCUS_WINDOW
from marketval.functions import text
from marketval.schemas import RECORDED_ACTIVE, RECORDED_SOLD
from marketval.sources import embedded, pages, recorded
from workload.registry import query
from workload.tables import Workload

ID = "market, profile, row_ord"
DATASET_ID = ["market", "profile", "row_ord"]


# -- recorded rows -----------------------------------------------------------------------------

def _recorded_text(rows, fields: list[str]):
    """Each row as a JSON array of two records, as a recording would hold them."""
    flag = F.when(F.col("row_ord") % 3 == 0, F.col("lot_size_is_rounded")).alias("lot_size_is_rounded")
    area = F.when(F.col("row_ord") % 5 == 0, "XX").otherwise(F.col("area")).alias("area")
    one = F.struct(*[F.col(f) for f in fields], flag, area)
    two = F.struct(F.concat(F.lit("copy of "), "address").alias("address"), flag, area)
    return rows.select(
        *DATASET_ID,
        F.concat(F.lit("["), F.to_json(one), F.lit(", "), F.to_json(two), F.lit("]")).alias("body"),
    )


@query("src1_src3_recorded_sold", f"""
SELECT {ID}, 0 AS position, address, sold_date, sold_price, lot_sqft, agent, row_ord % 3 = 0 AND lot_size_is_rounded AS lot_size_is_rounded,
  CASE WHEN row_ord % 5 <> 0 THEN area END AS area, len(sources) AS n_sources, 0 AS n_notes FROM sold
UNION ALL SELECT {ID}, 1, 'copy of ' || address, NULL, NULL, NULL, NULL, row_ord % 3 = 0 AND lot_size_is_rounded,
  CASE WHEN row_ord % 5 <> 0 THEN area END, 0, 0 FROM sold""", "sold_price lot_sqft")
def _(w):
    said = _recorded_text(w.sold, ["address", "sold_date", "sold_price", "lot_sqft", "agent", "sources"])
    rows = recorded.parse_recorded(said, F.col("body"), RECORDED_SOLD, DATASET_ID)
    return rows.select(
        *DATASET_ID, "position", "address", "sold_date", "sold_price", "lot_sqft", "agent",
        "lot_size_is_rounded", "area", F.size("sources").alias("n_sources"), F.size("notes").alias("n_notes"),
    )


@query("src2_recorded_active", f"""
SELECT {ID}, 0 AS position, address, listed_date, list_price FROM active
UNION ALL SELECT {ID}, 1, 'copy of ' || address, NULL, NULL FROM active""", "list_price")
def _(w):
    said = _recorded_text(w.active, ["address", "listed_date", "list_price"])
    rows = recorded.parse_recorded(said, F.col("body"), RECORDED_ACTIVE, DATASET_ID)
    return rows.select(*DATASET_ID, "position", "address", "listed_date", "list_price")


@query("set7_union_in_order", f"""
SELECT market, profile, row_number() OVER (PARTITION BY market, profile ORDER BY source_rank, row_ord) - 1 AS row_ord,
  address, source_rank
FROM (SELECT market, profile, row_ord, address, 0 AS source_rank FROM sold
  UNION ALL SELECT market, profile, row_ord, address, 1 FROM active)""")
def _(w):
    cols = [*DATASET_ID, "address"]
    return recorded.union_in_order([w.sold.select(*cols), w.active.select(*cols)])


# -- page data ---------------------------------------------------------------------------------

SPEC = embedded.Layout(
    records="props.search.records", total="props.total", base="https://idx.example/",
    rules=[
        ("address", "addr.line", "text"), ("sold_price", "price", "money"), ("sold_date", "tags", "tag_date"),
        ("lot_sqft", "size", "sqft"), ("property_type", "type", "raw"), ("beds", "beds", "float"),
        ("lat", "geo.0", "float"), ("lon", "geo.1", "float"), ("source_url", "url", "raw"),
        ("agent", "by", "attribution_agent"), ("brokerage", "by", "attribution_brokerage"),
    ],
)


def index_pages(w: Workload):
    """One index page per order: up to three records in its script block, some pages faulty."""
    o = F.col("o_orderkey")

    def record(i: int):
        k = o * 3 + i
        amount = (k % 500 + 1) * 1000
        price = (
            F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number(amount, 0)))
            .when(k % 3 == 1, F.concat(F.lit("#"), amount.cast("string"), F.lit("#")))
            .otherwise(F.concat(F.lit("$"), (k % 500 + 1).cast("string"), F.lit("K")))
        )
        day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int"))
        size = F.when(
            k % 2 == 0, F.concat(F.format_number((k % 50 + 1) * 5 / 100, 2), F.lit(" Acres"))
        ).otherwise(F.concat(F.format_number(k % 9000 + 100, 0), F.lit(" sq ft")))
        url = (
            F.when(k % 4 == 0, F.concat(F.lit("/p/"), k.cast("string")))
            .when(k % 4 == 1, F.concat(F.lit("https://idx.example/p/"), k.cast("string")))
            .when(k % 4 == 2, "http://169.254.169.254/latest").otherwise("ftp://idx.example/p")
        )
        by = F.when(
            k % 2 == 0,
            F.concat(F.lit("Agent "), (k % 7).cast("string"), F.lit(" DRE # 1, Firm "), (k % 5).cast("string")),
        ).otherwise(F.concat(F.lit("Firm "), (k % 5).cast("string"), F.lit(", Inc.")))
        return F.struct(
            F.struct(
                F.when(k % 11 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(" Elm St"))).alias("line")
            ).alias("addr"),
            price.alias("price"),
            F.array(
                F.struct(F.lit("SOLD").alias("formattedName")),
                F.struct(F.upper(F.date_format(day, "MMM d, yyyy")).alias("formattedName")),
            ).alias("tags"),
            size.alias("size"),
            F.when(k % 4 == 0, "land").when(k % 4 == 1, "HOUSE").alias("type"),
            F.when(k % 5 != 0, 3).alias("beds"),
            F.array(F.lit(40.5), F.lit(-100.5)).alias("geo"),
            url.alias("url"),
            by.alias("by"),
        )

    n = (o % 3 + 1).cast("int")
    records = F.regexp_replace(
        F.to_json(F.slice(F.array(record(0), record(1), record(2)), F.lit(1), n)), '"#([0-9]+)#"', "$1"
    )
    total = (
        F.when(o % 4 == 1, '"3 results"').when(o % 4 == 3, "null").otherwise(n.cast("string"))
    )
    body = F.concat(
        F.lit('{"props":{"search":{"records":'), F.when(o % 23 == 0, '"none"').otherwise(records),
        F.lit('},"total":'), total, F.when(o % 17 == 0, F.lit("")).otherwise(F.lit("}}")),
    )
    return w.raw("orders").select(
        "o_orderkey",
        F.concat(
            F.when(o % 19 == 0, "<html><p>Please complete the CAPTCHA</p>").otherwise("<html>"),
            F.lit('<script id="other">var x;</script><script id="__NEXT_DATA__" type="application/json">'),
            body, F.lit("</script></html>"),
        ).alias("html"),
    )


RECS = """
SELECT o_orderkey, i AS position, k, CASE WHEN k % 11 <> 0 THEN k || ' Elm St' END AS address, (k % 500 + 1) * 1000e0 AS sold_price,
  DATE '2020-01-01' + CAST(k % 700 AS INT) AS sold_date,
  CASE WHEN k % 2 = 0 THEN CAST(format('{:.2f}', (k % 50 + 1) * 5 / 100e0) AS DOUBLE) * 43560e0 ELSE k % 9000 + 100e0 END AS lot_sqft,
  k % 2 = 0 AS lot_size_is_rounded, CASE k % 4 WHEN 0 THEN 'land' WHEN 1 THEN 'HOUSE' END AS property_type,
  CASE WHEN k % 5 <> 0 THEN 3e0 END AS beds,
  CASE k % 4 WHEN 0 THEN 'https://idx.example/p/' || k WHEN 1 THEN 'https://idx.example/p/' || k END AS source_url,
  CASE k % 4 WHEN 2 THEN 'dropped a URL pointing away from idx.example' WHEN 3 THEN 'dropped a ftp URL' END AS url_problem,
  CASE WHEN k % 2 = 0 THEN 'Agent ' || (k % 7) END AS agent,
  CASE WHEN k % 2 = 0 THEN 'Firm ' || (k % 5) ELSE 'Firm ' || (k % 5) || ', Inc.' END AS brokerage
FROM (SELECT o_orderkey, i, o_orderkey * 3 + i AS k FROM orders, LATERAL (SELECT unnest(range(0, o_orderkey % 3 + 1)) AS i)
  WHERE o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0)"""


@query("src5_src6_sca13_extract_records", f"""
SELECT o_orderkey, position, coalesce(address, '') AS address, sold_price, sold_date, lot_sqft, lot_size_is_rounded,
  property_type, beds, 40.5e0 AS lat, source_url, agent, brokerage FROM ({RECS})""", "sold_price lot_sqft beds lat")
def _(w):
    rows = embedded.extract_records(index_pages(w), F.col("html"), SPEC, ["o_orderkey"])
    return rows.select(
        "o_orderkey", "position", F.coalesce("address", F.lit("")).alias("address"), "sold_price", "sold_date",
        "lot_sqft", "lot_size_is_rounded", "property_type", "beds", "lat", "source_url", "agent", "brokerage",
    )


@query("pred21_same_host_links", f"SELECT o_orderkey, position, source_url, url_problem FROM ({RECS})")
def _(w):
    rows = embedded.extract_records(index_pages(w), F.col("html"), SPEC, ["o_orderkey"])
    return rows.select("o_orderkey", "position", "source_url", "url_problem")


def _index(w: Workload, side: str):
    lots = w.profiles.df.where("market = 'ASIA' AND profile = 'lots'").select("identification").first()[0]
    rule = F.struct(
        F.lit(lots["requires_absent_bed_bath"]).alias("requires_absent_bed_bath"),
        F.array(*[F.lit(x) for x in lots["type_labels"]]).alias("type_labels"),
    )
    return embedded.read_index(index_pages(w), F.col("html"), SPEC, rule, side, ["o_orderkey"])


_TYPED = f"""(SELECT * FROM ({RECS}) WHERE address IS NOT NULL AND o_orderkey % 19 <> 0
  AND (coalesce(lower(property_type) LIKE '%land%', FALSE) OR beds IS NULL))"""


@query("src8_src9_index_sold", f"""
SELECT o_orderkey, position, address, sold_date, sold_price, lot_sqft, beds, len(list_filter([source_url], lambda u: u IS NOT NULL)) AS n_sources
FROM {_TYPED}""", "sold_price lot_sqft beds")
def _(w):
    return _index(w, "sold").select(
        "o_orderkey", "position", "address", "sold_date", "sold_price", "lot_sqft", "beds",
        F.size("sources").alias("n_sources"),
    )


@query("src10_index_active", f"""
SELECT o_orderkey, position, address, sold_price AS list_price, agent, brokerage FROM {_TYPED}""", "list_price")
def _(w):
    return _index(w, "active").select("o_orderkey", "position", "address", "list_price", "agent", "brokerage")


_OUTCOMES = """
SELECT o_orderkey, blocked, records, claimed_total, coalesce(records < claimed_total, FALSE) AS is_short,
  CASE WHEN blocked THEN 'challenge page' WHEN o_orderkey % 17 = 0 THEN 'no readable script block'
    WHEN o_orderkey % 23 = 0 THEN 'no list of records' WHEN claimed_total IS NULL THEN 'unusable total'
    WHEN records < claimed_total THEN 'incomplete page' END AS problem
FROM (SELECT o_orderkey, o_orderkey % 19 = 0 AS blocked,
  CASE WHEN listed THEN len(list_filter(range(0, o_orderkey % 3 + 1), lambda i: (o_orderkey * 3 + i) % 11 <> 0)) ELSE 0 END AS records,
  CASE WHEN NOT listed THEN NULL WHEN o_orderkey % 4 = 1 THEN 3 WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 3 + 1 END AS claimed_total
  FROM (SELECT o_orderkey, o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 19 <> 0 AS listed FROM orders))"""


def outcomes(w: Workload):
    return embedded.page_outcomes(index_pages(w), F.col("html"), SPEC, ["o_orderkey"])


@query("pred20_claimed_totals", _OUTCOMES)
def _(w):
    return outcomes(w)


@query("agg24_source_outcomes", f"""
SELECT o_orderkey % 7 AS source, count(*) AS pages, CAST(sum(records) AS BIGINT) AS records, count(problem) AS failed,
  count(*) FILTER (is_short) AS short_pages FROM ({_OUTCOMES}) GROUP BY ALL""")
def _(w):
    rows = outcomes(w).withColumn("source", F.col("o_orderkey") % 7)
    return embedded.source_outcomes(rows, ["source"])


def _ld_pages(w: Workload):
    o = F.col("o_orderkey")
    good = F.to_json(F.struct(F.array(F.struct(F.col("o_orderstatus").alias("status"))).alias("offers"),
                              F.col("o_totalprice").alias("price")))
    block = '<script type="application/ld+json">'
    return w.raw("orders").select(
        "o_orderkey",
        F.concat(
            F.lit(f"<html>{block}"), F.when(o % 2 == 0, "{broken").otherwise(good),
            F.lit(f"</script><script>var y;</script>{block}"), good, F.lit("</script></html>"),
        ).alias("html"),
    )


@query("src7_sca7_ld_json", """
SELECT o_orderkey, i AS position, o_orderstatus AS status, o_totalprice AS price, CAST(NULL AS VARCHAR) AS missing
FROM orders, LATERAL (SELECT unnest([0, 1]) AS i) WHERE NOT (o_orderkey % 2 = 0 AND i = 0)""", "price")
def _(w):
    blocks = embedded.ld_json_blocks(_ld_pages(w), F.col("html"), ["o_orderkey"])
    b = F.col("block")
    return blocks.select(
        "o_orderkey", "position", embedded.dig(b, "offers.0.status").alias("status"),
        embedded.dig(b, "price", "double").alias("price"), embedded.dig(b, "offers.7.status.x").alias("missing"),
    )


# -- fetched pages -----------------------------------------------------------------------------

def fetched(w: Workload):
    return w.raw("events").select(
        F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_type").alias("adapter_version"), F.col("event_id").alias("page_id"),
        F.col("ts").alias("fetched_at"), F.col("props").alias("html"),
    )


AS_OF = "2024-01-08 00:00:00"
_FRESH = f"""
SELECT page_id, url, adapter_version FROM (
  SELECT event_id AS page_id, 'https://x.example/' || user_id AS url, event_type AS adapter_version, ts FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
WHERE greatest(epoch(TIMESTAMP '{AS_OF}') - epoch(ts), 0) < 21600"""


@query("src11_fresh_pages", f"SELECT *, sha256(adapter_version || chr(0) || url) AS key FROM ({_FRESH})")
def _(w):
    fresh = pages.fresh_pages(fetched(w), F.lit(AS_OF).cast("timestamp"))
    return fresh.select(
        "page_id", "url", "adapter_version", pages.page_key(F.col("url"), F.col("adapter_version")).alias("key")
    )


@query("src11_cache_counters", f"""
SELECT event_type AS adapter_version, count(f.url) AS hits, count(*) - count(f.url) AS misses
FROM events e LEFT JOIN ({_FRESH}) f ON f.url = 'https://x.example/' || e.user_id AND f.adapter_version = e.event_type
GROUP BY event_type""")
def _(w):
    rows = fetched(w)
    fresh = pages.fresh_pages(rows, F.lit(AS_OF).cast("timestamp"))
    return pages.cache_counters(rows, fresh, ["adapter_version"])


# -- page text ---------------------------------------------------------------------------------

def reduce_sql() -> str:
    """Whole elements replaced one kind after another; the pages hold no nested dropped elements and
    no references but the five below."""
    parts = "regexp_replace(html, '(?is)<!--.*?(-->|\\z)', chr(1), 'g')"
    for tag in "script style noscript svg canvas template iframe".split():
        parts = f"regexp_replace({parts}, '(?is)<{tag}(\\s[^>]*)?>.*?(</{tag}\\s*>|\\z)', chr(1), 'g')"
    breaks = ("p|div|br|li|tr|td|th|section|article|header|footer|h[1-6]|table|ul|ol|dl|dd|dt|figure|figcaption|main|nav"
              "|aside|form")
    parts = f"regexp_replace({parts}, '(?i)</?({breaks})(\\s[^>]*)?>', chr(1) || chr(2) || chr(1), 'g')"
    parts = f"regexp_replace({parts}, '(?i)<[/!]?[a-z][^>]*(>|\\z)', chr(1), 'g')"
    plain = "{}"
    for name, code in (("quot", 34), ("copy", 169), ("middot", 183), ("amp", 38)):
        plain = f"regexp_replace({plain}, '&{name};?', chr({code}), 'g')"
    blank = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
    title = plain.format("regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)")
    data = ("array_to_string(list_filter(list_transform(regexp_extract_all(html, "
            "'(?is)<script[^>]*type=\"application/(?:ld[+])?json\"[^>]*>(.*?)</script', 1), lambda x: trim(x, "
            f"{blank})), lambda x: x <> ''), chr(10) || chr(10))")
    return f"""
WITH cut AS (SELECT page_id, html, trim({title}, {blank}) AS title, {data} AS data, string_split({plain.format(parts)}, chr(1)) AS pieces FROM pages),
put AS (SELECT page_id, html, title, data, array_to_string(list_transform(pieces, lambda x: CASE WHEN x = chr(2) THEN chr(10)
    WHEN trim(x, {blank}) = '' THEN '' ELSE trim(x, {blank}) || ' ' END), '') AS body FROM cut),
tidy AS (SELECT page_id, html, title, data, trim(regexp_replace(regexp_replace(regexp_replace(body, '[ \\t]{{2,}}', ' ', 'g'),
    '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {blank}) AS body FROM put)
SELECT page_id, CASE WHEN html IS NOT NULL THEN concat_ws(chr(10) || chr(10), CASE WHEN title <> '' THEN 'PAGE TITLE: ' || title END,
    nullif(body, ''), CASE WHEN data <> '' THEN 'EMBEDDED STRUCTURED DATA:' || chr(10) || data END) END AS body
FROM tidy"""


@query("sca14_reduce_html", reduce_sql())
def _(w):
    return pages.reduced_pages(w.raw("pages"), ["page_id"])


def focus_sql(terms: list[str], window: int, max_chars: int, head: int) -> str:
    names = ", ".join("'" + x.replace("'", "''") + "'" for x in terms)
    hits = f"""flatten(list_transform([{names}], lambda term: list_transform([string_split(lower(text), term)], lambda ps:
      list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * length(term)))[1]))"""
    return f"""
SELECT doc_id, CASE WHEN length(text) <= {max_chars} THEN text ELSE array_to_string(list_filter(list_transform(merged, lambda s, i:
    CASE WHEN coalesce(list_sum(list_transform(merged[1:i - 1], lambda z: z.b - z.a)), 0) < {max_chars} THEN
    substr(text, CAST(s.a + 1 AS BIGINT), CAST(least(s.b - s.a, {max_chars} - coalesce(list_sum(list_transform(merged[1:i - 1], lambda z: z.b - z.a)), 0)) AS BIGINT)) END),
    lambda x: x IS NOT NULL), chr(10) || '[...]' || chr(10)) END AS focused
FROM (SELECT *, list_reduce(list_transform(spans, lambda s: [s]), lambda acc, x: CASE WHEN x[1].a <= acc[len(acc)].b
    THEN acc[1:len(acc) - 1] || [{{'a': acc[len(acc)].a, 'b': greatest(acc[len(acc)].b, x[1].b)}}] ELSE acc || x END) AS merged
  FROM (SELECT doc_id, text, list_sort([{{'a': CAST(0 AS HUGEINT), 'b': CAST(least({head}, length(text)) AS HUGEINT)}}]
      || list_transform({hits}, lambda p: {{'a': CAST(greatest(0, p - {window // 2}) AS HUGEINT), 'b': CAST(least(length(text), p + {window}) AS HUGEINT)}})) AS spans
    FROM documents))"""


@query("sca15_focus_text", focus_sql(FOCUS_TERMS, FOCUS_WINDOW, FOCUS_MAX_CHARS, FOCUS_HEAD))
def _(w):
    return w.raw("documents").select("doc_id", text.focus_text(F.col("text"), max_chars=FOCUS_MAX_CHARS).alias("focused"))


@query("udf5_focus_with_own_terms", focus_sql(["the and", "tion ", "que le"], 120, 1500, 200))
def _(w):
    own = text.focus_text(F.col("text"), ["the and", "tion ", "que le"], 120, 1500, 200)
    return w.raw("documents").select("doc_id", own.alias("focused"))
