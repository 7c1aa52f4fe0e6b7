"""Field transforms over values found in page data: money, dates, sizes, attributions."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from marketval.constants import (
    DIMENSION_PATTERN,
    LICENCE_PATTERN,
    MAX_DIMENSION_CHARS,
    MONEY_PATTERN,
    SQFT_PER_ACRE,
    TAG_DATE_PATTERN,
)
from marketval.functions.text import squeeze, strip


def as_money(x: Column) -> Column:
    """'$550K' -> 550000.0; NULL when no number is found."""
    text = strip(x)
    suffix = F.upper(F.right(text, F.lit(1)))
    scale = F.when(suffix == "K", 1000.0).when(suffix == "M", 1000000.0).otherwise(1.0)
    body = F.when(suffix.isin("K", "M"), F.regexp_replace(text, r"(?s).$", "")).otherwise(text)
    number = F.regexp_extract(F.regexp_replace(body, ",", ""), MONEY_PATTERN, 0)
    return number.try_cast("double") * scale


def as_date(x: Column) -> Column:
    """ISO, 'Aug 28, 2026', 'August 28, 2026' or '8/28/2026'; NULL otherwise."""
    text = strip(x)
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "y-M-d"))
    us = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/y"))
    # Month names are cut to their first three letters once their spelling is checked.
    months = {
        "jan": "january", "feb": "february", "mar": "march", "apr": "april", "may": "may",
        "jun": "june", "jul": "july", "aug": "august", "sep": "september", "oct": "october",
        "nov": "november", "dec": "december",
    }
    names = "|".join(sorted({*months, *months.values()}, key=len, reverse=True))
    pattern = rf"(?i)^({names})\s+(\d{{1,2}}),\s+(\d{{4}})$"
    number = F.array_position(
        F.array(*[F.lit(m) for m in months]),
        F.substring(F.lower(F.regexp_extract(text, pattern, 1)), 1, 3),
    )
    named = F.when(
        text.rlike(pattern),
        F.try_to_date(
            F.concat_ws(
                "-",
                F.regexp_extract(text, pattern, 3),
                number.cast("string"),
                F.regexp_extract(text, pattern, 2),
            ),
            "y-M-d",
        ),
    )
    return F.coalesce(iso, named, us)


def as_tag_date(tags: Column) -> Column:
    """The first tag that has the shape of a date and parses as one."""
    return F.try_element_at(
        F.filter(
            F.transform(tags, lambda t: F.when(strip(t).rlike(TAG_DATE_PATTERN), as_date(t))),
            lambda d: d.isNotNull(),
        ),
        F.lit(1),
    )


def as_sqft(x: Column, max_chars: int | None = None) -> Column:
    """struct(sqft, from_acres); with `max_chars`, a longer text is not searched. The pattern reads each
    character a bounded number of times."""
    pattern = "(?i)" + DIMENSION_PATTERN
    number = F.regexp_replace(F.regexp_extract(x, pattern, 1), ",", "").try_cast("double")
    acres = F.lower(F.regexp_extract(x, pattern, 2)).startswith("ac")
    searched = x.isNotNull() if max_chars is None else F.length(x) <= max_chars
    found = F.when(
        searched, F.when(acres, number * F.lit(SQFT_PER_ACRE)).otherwise(number)
    )
    return F.struct(
        found.alias("sqft"),
        F.coalesce(searched & acres & number.isNotNull(), F.lit(False)).alias("from_acres"),
    )


def _trim_marks(x: Column) -> Column:
    return F.trim(x, F.lit(" .,#"))


def split_attribution(x: Column) -> Column:
    """struct(agent, brokerage): a person is named only ahead of a licence label."""
    pattern = "(?iU)" + LICENCE_PATTERN
    text = squeeze(x)
    parts = F.split(text, pattern, 2)
    labelled = F.size(parts) > 1
    name = _trim_marks(parts[0])
    firm = F.when(labelled, F.regexp_extract(F.try_element_at(parts, F.lit(2)), r"(?s)^[^,]*,(.*)$", 1))
    firm = strip(firm)
    return F.struct(
        F.when(labelled & (name != ""), name).alias("agent"),
        F.when(labelled, F.when(firm != "", firm)).otherwise(F.when(text != "", text)).alias(
            "brokerage"
        ),
    )


# Named transforms a source spec may choose per field. Callers may add entries.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "money": as_money,
    "date": as_date,
    "sqft": lambda x: as_sqft(x, MAX_DIMENSION_CHARS),
    "text": lambda x: strip(F.nullif(x, F.lit(""))),
    "attribution_agent": lambda x: split_attribution(x)["agent"],
    "attribution_brokerage": lambda x: split_attribution(x)["brokerage"],
    "float": lambda x: strip(x).try_cast("double"),
    "raw": lambda x: x,
}


def iso_date(x: Column) -> Column:
    """First ten characters as an ISO date; NULL for a missing or unreadable one."""
    return F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")
