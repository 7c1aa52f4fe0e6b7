"""Claims checked against known sales before they may fill a gap, and geocodes likewise."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marketval.constants import (
    DATE_TOLERANCE_DAYS,
    GEOCODE_MIN_SCORE,
    LOOSE_DATE_TOLERANCE_DAYS,
    NOT_FOUND,
)
from marketval.functions import rates
from marketval.functions.address import street_matches
from marketval.functions.parse import iso_date
from marketval.functions.text import clean_name, grouped
from marketval.operators.measures import with_keys
from marketval.operators.ranking import last_per_key
from marketval.operators.sizing import DATASET, Dim, written

PARTY_FIELDS = ["agent", "brokerage", "buyer_agent", "buyer_brokerage"]
TEXT_FIELDS = ["agent", "brokerage", "buyer_agent"]
NUMBER_FIELDS = ["final_list_price", "original_list_price", "lot_sqft", "living_sqft"]


#: Fields that a claim may fill.
KNOWN_FIELDS = [*TEXT_FIELDS, *NUMBER_FIELDS]

#: What a claim's value is worth, before anything is compared: not told, a filler name, a blank, a value.
UNTOLD, FILLER, BLANK, OFFERED = range(4)

#: What a judged claim can carry besides its key, field and outcome.
CLAIM_DETAILS = ["address", "value", "clean_value", "source_url", "claimed_price", "claimed_date", "reason"]


def standing(field_name: Column, value: Column) -> Column:
    """What a value is worth as a claim to a field: a filler name, a blank, or a value."""
    party = field_name.isin(PARTY_FIELDS)
    clean = clean_value(field_name, value)
    told = F.coalesce(value, F.lit("")) != ""
    blank = clean.isNull() | clean.isin("", "-", NOT_FOUND)
    return F.when(party & clean.isNull() & told, FILLER).when(blank, BLANK).otherwise(OFFERED)


def worth(clean: Column) -> Column:
    """The standing of a party's name that is not empty, from its clean form."""
    return F.when(clean.isNull(), FILLER).when(clean.isin("", "-", NOT_FOUND), BLANK).otherwise(OFFERED)


def clean_value(field_name: Column, value: Column) -> Column:
    return F.when(field_name.isin(PARTY_FIELDS), clean_name(value)).otherwise(value)


def known_fields() -> Column:
    """The fields that a sold row has, as a set of bits."""
    has = [F.when(F.col(n).isNotNull(), 1 << k).otherwise(0) for k, n in enumerate(KNOWN_FIELDS)]
    return reduce(lambda a, b: a.bitwiseOR(b), has)


def known_sales(sold: DataFrame) -> DataFrame:
    """The last sold row of each address key, stored, as `_t`: its figures, and the fields it has.

    Sold rows that carry `known` need not carry the fields.
    """
    known = F.col("known") if "known" in sold.columns else known_fields()
    target = last_per_key(
        sold.select(*DATASET, "addr_key", "row_ord", "sold_price", "sold_date", known.alias("known"))
        .withColumn("_order", F.col("row_ord")),
        [*DATASET, "addr_key"],
        "_order",
    )
    stored = written(target.drop("_order"))
    return stored.select(
        *DATASET, "addr_key", F.struct("row_ord", "sold_price", "sold_date", "known").alias("_t")
    )


def claims_from_facts(
    facts: DataFrame, profiles: Dim | DataFrame | None = None, sold: DataFrame | None = None
) -> DataFrame:
    """One row per stated fact, carrying the price and date offered as evidence.

    Facts read from a page about another property yield nothing. With `profiles`, claims carry
    `addr_key`, worked out once per page and not once per claim. With `sold` (keyed) as well, a page
    meets the known sale of its address before it becomes claims, so that one row of it is shuffled, with
    only those of its columns that are read later.
    """
    named = [
        ("agent", F.col("listing_agent")),
        ("brokerage", F.col("listing_brokerage")),
        ("buyer_agent", F.col("buyer_agent")),
        *[(n, F.col(n).cast("string")) for n in NUMBER_FIELDS],
        ("buyer_agent", F.when(F.col("dual_agency_stated"), F.col("listing_agent"))),
    ]
    told = facts.where(~F.coalesce("page_is_about_a_different_property", F.lit(False)))
    told = told.withColumn("_day", iso_date(F.col("stated_sold_date")))
    if profiles is not None:
        told = with_keys(told, profiles)
    there = [v != "" for _, v in named]
    if sold is not None:
        # Two bits for each fact: what it is worth is known before its text is needed. A number is never blank.
        clean = {f"_clean_{c}": clean_name(F.col(c)) for c in ("listing_agent", "listing_brokerage", "buyer_agent")}
        agent, brokerage, buyer = [F.when(F.col(c[7:]) != "", worth(F.col(c))).otherwise(UNTOLD) for c in clean]
        dual = F.when(F.col("dual_agency_stated"), agent).otherwise(UNTOLD)
        numbers = [F.when(F.col(n).isNotNull(), OFFERED).otherwise(UNTOLD) for n in NUMBER_FIELDS]
        bits = [F.shiftleft(w, 2 * i) for i, w in enumerate([agent, brokerage, buyer, *numbers, dual])]
        told = told.withColumns(clean).withColumn("_worth", reduce(lambda a, b: a.bitwiseOR(b), bits))
        told = told.join(known_sales(sold), [*DATASET, "addr_key"], "left")
        there = [F.col("_worth").bitwiseAND(3 << 2 * i) != UNTOLD for i in range(len(named))]
    told = told.withColumn("_i", F.explode(F.array_compact(F.array(*[F.when(x, i) for i, x in enumerate(there)]))))
    at = F.col("_i")
    names = F.array(*[F.lit(n) for n, _ in named])
    carried = [c for c in ("addr_key", "_t") if c in told.columns]
    return told.select(
        *DATASET, *carried,
        (F.col("row_ord") * len(named) + at).alias("claim_ord"),
        "address",
        F.get(names, at).alias("field_name"),
        F.coalesce(*[F.when(at == i, v) for i, (_, v) in enumerate(named)]).alias("value"),
        F.col("url").alias("source_url"),
        F.col("stated_sold_price").alias("claimed_price"),
        F.col("_day").alias("claimed_date"),
        *([] if sold is None else [F.expr("shiftright(_worth, 2 * _i) & 3").alias("_standing")]),
    )


def verdict(
    price: Column,
    day: Column,
    claimed_price: Column,
    claimed_date: Column,
    date_tolerance: int = DATE_TOLERANCE_DAYS,
    require_date: bool = False,
) -> Column:
    """struct(accepted, reason). The price decides; a date alone is enough only on request."""
    no_evidence = claimed_price.isNull() & claimed_date.isNull()
    wrong_price = claimed_price.isNotNull() & ~rates.prices_match(price, claimed_price)
    wrong_event = (
        claimed_price.isNotNull()
        & claimed_date.isNotNull()
        & day.isNotNull()
        & ~rates.dates_match(day, claimed_date, LOOSE_DATE_TOLERANCE_DAYS)
    )
    by_date = rates.dates_match(day, claimed_date, date_tolerance)

    def answer(accepted: bool, *reason) -> Column:
        text = [x if isinstance(x, Column) else F.lit(x) for x in reason]
        return F.struct(F.lit(accepted).alias("accepted"), F.concat(*text).alias("reason"))

    def shown(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit("None"))

    # The texts of the reasons, which readers of the results match.
    out = (
        F.when(no_evidence, answer(False, "no evidence offered: neither a price nor a date"))
        .when(
            wrong_price & (F.coalesce(price, F.lit(0.0)) == 0),
            answer(False, "no known price to check"),
        )
        .when(
            wrong_price,
            answer(
                False, "price ", grouped(claimed_price), " does not match the known ", grouped(price)
            ),
        )
        .when(
            wrong_event,
            answer(
                False, "price matches but the date ", shown(claimed_date),
                " is far from the known ", shown(day), "; probably a different transaction",
            ),
        )
        .when(claimed_price.isNotNull(), answer(True, ""))
    )
    if not require_date:
        return out.otherwise(answer(False, "no price offered, and a date alone is not enough"))
    return out.when(by_date, answer(True, "matched on date alone; weaker evidence")).otherwise(
        answer(False, "date ", shown(claimed_date), " does not match the known ", shown(day))
    )


def judge_claims(
    sold: DataFrame, claims: DataFrame, profiles: Dim | DataFrame,
    details: list[str] = CLAIM_DETAILS, only: list[str] | None = None, **options,
) -> DataFrame:
    """Every claim with its outcome: unverifiable, rejected, skipped, known or accepted.

    Claims meet the last sold row of their address key. Among accepted claims to one empty
    field the first in claim order fills it; the others find it known. Claims that carry `addr_key`
    are not keyed again, and those whose page has met the known sale do not meet it again. What was
    checked is stored, with the `details` that are read later, and only accepted claims meet each other.
    All claims are checked; `only` names the outcomes of that check which are stored.
    """
    if "_t" in claims.columns:
        met = claims
    else:
        keyed = claims if "addr_key" in claims.columns else with_keys(claims, profiles)
        met = keyed.join(known_sales(sold), [*DATASET, "addr_key"], "left").withColumn(
            "_standing", standing(F.col("field_name"), F.col("value"))
        )
    existing = F.coalesce(*[
        F.when(F.col("field_name") == n, F.col("_t.known").bitwiseAND(1 << k) != 0)
        for k, n in enumerate(KNOWN_FIELDS)
    ])
    checked = (
        met.withColumn(
            "_verdict",
            verdict(
                F.col("_t.sold_price"), F.col("_t.sold_date"),
                F.col("claimed_price"), F.col("claimed_date"), **options,
            ),
        )
        .withColumn(
            "outcome",
            F.when(F.col("_t").isNull(), "unverifiable")
            .when(F.col("_standing") == FILLER, "rejected")
            .when(F.col("_standing") != OFFERED, "skipped")
            .when(~F.col("_verdict.accepted"), "rejected")
            .when(existing, "known")
            .otherwise("accepted"),
        )
    )
    if only is not None:
        checked = checked.where(F.col("outcome").isin(only))
    checked = (
        checked.withColumn(
            "reason",
            F.when(F.col("outcome") == "unverifiable", "no comp with that address in this run")
            .when(
                (F.col("outcome") == "rejected") & (F.col("_standing") == FILLER),
                "placeholder name, not a real party",
            )
            .when(F.col("outcome") == "rejected", F.col("_verdict.reason")),
        )
        .withColumn("clean_value", clean_value(F.col("field_name"), F.col("value")))
        .withColumn("row_ord", F.col("_t.row_ord"))
    )
    columns = [
        *DATASET, "claim_ord", "row_ord", "address", "field_name", "value", "clean_value",
        "source_url", "claimed_price", "claimed_date", "outcome", "reason",
    ]
    checked = written(checked.select(*[c for c in columns if c not in CLAIM_DETAILS or c in details]))
    accepted = checked.where("outcome = 'accepted'")
    first = accepted.groupBy(*DATASET, "row_ord", "field_name").agg(F.min("claim_ord").alias("_winner"))
    decided = (
        accepted.join(first, [*DATASET, "row_ord", "field_name"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("claim_ord") != F.col("_winner"), "known").otherwise(F.col("outcome")),
        )
        .drop("_winner")
    )
    return checked.where("outcome <> 'accepted'").unionByName(decided)


def apply_claims(sold: DataFrame, judged: DataFrame) -> DataFrame:
    """Sold rows with accepted claims filled in and their sources noted once each."""
    accepted = judged.where("outcome = 'accepted'")
    fills = [
        F.max(F.when(F.col("field_name") == n, F.col("clean_value"))).alias(f"_c_{n}")
        for n in KNOWN_FIELDS
    ]
    # At most one accepted claim per field, so the list of sources is short.
    urls = F.transform(
        F.array_sort(F.collect_list(F.struct("claim_ord", "source_url"))), lambda c: c["source_url"]
    )
    wide = accepted.groupBy(*DATASET, "row_ord").agg(*fills, urls.alias("_urls"))
    out = sold.join(wide, [*DATASET, "row_ord"], "left")
    for n in TEXT_FIELDS:
        out = out.withColumn(n, F.coalesce(n, f"_c_{n}"))
    for n in NUMBER_FIELDS:
        out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"_c_{n}").try_cast("double")))
    fresh = F.filter(F.array_distinct("_urls"), lambda u: (u.isNotNull()) & (u != ""))
    out = out.withColumn(
        "sources",
        F.when(
            F.col("_urls").isNotNull(),
            F.concat("sources", F.array_except(fresh, F.col("sources"))),
        ).otherwise(F.col("sources")),
    )
    return out.drop("_urls", *[f"_c_{n}" for n in KNOWN_FIELDS])


def verification_summary(judged: DataFrame) -> DataFrame:
    counted = [
        F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "rejected", "unverifiable")
    ]
    return judged.groupBy(*DATASET).agg(*counted)


def judge_geocodes(geocodes: DataFrame, min_score: float = GEOCODE_MIN_SCORE) -> DataFrame:
    """Adds `rejected`: why an answer may not be used, or NULL."""
    same = street_matches(F.col("query"), F.col("matched_address"))
    return geocodes.withColumn("_same", same).withColumn(
        "rejected",
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no match")
        .when(
            F.col("score") < min_score,
            F.concat(F.lit("low confidence ("), grouped(F.col("score")), F.lit(")")),
        )
        .when(
            ~F.col("_same"),
            F.concat(F.lit("matched a different street: "), F.col("matched_address")),
        ),
    ).drop("_same")


def fill_geocodes(sold: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows lacking a coordinate take the primary answer, else the fallback's, else stay.

    `judged` has one row per (market, address, service); service is 'primary' or 'fallback'.
    """
    good = F.col("rejected").isNull()

    def answer(service: str) -> Column:
        hit = (F.col("service") == service) & good
        return F.max(F.when(hit, F.struct("lat", "lon")))

    picked = judged.groupBy("market", "address").agg(
        F.coalesce(answer("primary"), answer("fallback")).alias("_geo")
    )
    gap = F.col("lat").isNull() | F.col("lon").isNull()
    use = gap & F.col("_geo").isNotNull()
    return (
        sold.join(picked, ["market", "address"], "left")
        .withColumn("geocoded", F.coalesce(use, F.lit(False)))
        .withColumn("_lat", F.when(use, F.col("_geo.lat")).otherwise(F.col("lat")))
        .withColumn("lon", F.when(use, F.col("_geo.lon")).otherwise(F.col("lon")))
        .withColumn("lat", F.col("_lat"))
        .drop("_lat", "_geo")
    )


def asked_geocodes(sold: DataFrame, geocodes: DataFrame) -> DataFrame:
    """The answers to addresses of rows that lack a coordinate, stored, so that only they are judged."""
    gaps = sold.where(F.col("lat").isNull() | F.col("lon").isNull())
    asked = gaps.select("market", "address").distinct()
    return written(geocodes.join(asked, ["market", "address"], "left_semi"))


def geocode_rejections(sold: DataFrame, judged: DataFrame) -> DataFrame:
    """The rejected answers a gap-fill would have met, in the order it asks."""
    gaps = sold.where(F.col("lat").isNull() | F.col("lon").isNull())
    asked = gaps.select("market", "address").distinct()
    used = (
        judged.where((F.col("service") == "primary") & F.col("rejected").isNull())
        .select("market", "address")
        .distinct()
    )
    return (
        judged.where(F.col("rejected").isNotNull())
        .join(asked, ["market", "address"], "left_semi")
        .join(used, ["market", "address"], "left_anti")
        .select("market", "address", "service", "rejected")
    )
