"""Address identity and street comparison."""

from pyspark.sql import Column, functions as F

from marketval.constants import (
    DIRECTIONS,
    GEOCODE_DIRECTIONS,
    GEOCODE_STREET_TYPES,
    STREET_TYPES,
    UNIT_PATTERN,
)
from marketval.functions.text import WHITE

# \w, \s and \b are meant as Unicode classes, which Java reads only under the slow (?U). In ASCII text
# both readings are the same.
_UNICODE = "(?U)"
_UNIT_WORDS = ["#", "apt", "apartment", "unit", "ste", "suite"]
_BLANKED = WHITE + "."


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _may_have_unit(text: Column) -> Column:
    """A plain substring test that spares most addresses the unit pattern."""
    found = F.lit(False)
    for word in _UNIT_WORDS:
        found = found | F.contains(text, F.lit(word))
    return found


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def unit_part(raw: Column) -> Column:
    """'#unit' of an address, '' when it has none."""
    text = F.lower(F.coalesce(raw, F.lit("")))
    unit = F.when(_is_ascii(text), F.regexp_extract(text, UNIT_PATTERN, 1)).otherwise(
        F.regexp_extract(text, _UNICODE + UNIT_PATTERN, 1)
    )
    # A unit has no '#' in it, so a trim takes off the mark that stands alone; each pattern is read once.
    return F.when(
        _may_have_unit(text), F.rtrim(F.concat(F.lit("#"), unit), F.lit("#"))
    ).otherwise("")


def street_words(raw: Column) -> Column:
    """The lower-case words of an address, without unit, city or punctuation."""
    # No pattern runs on an ordinary address: translate and a one-character split are enough.
    text = F.lower(F.coalesce(raw, F.lit("")))
    rest = "(?s)" + UNIT_PATTERN + ".*$"
    cut = (
        F.when(~_may_have_unit(text), text)
        .when(_is_ascii(text), F.regexp_replace(text, rest, ""))
        .otherwise(F.regexp_replace(text, _UNICODE + rest, ""))
    )
    spaced = F.translate(F.substring_index(cut, ",", 1), _BLANKED, " " * len(_BLANKED))
    return F.array_remove(F.split(spaced, " "), "")


def canonical_street(words: Column) -> Column:
    """The canonical spelling of street words. `words` is best a plain column: it is named often.

    Only the first two words and the last one can be a direction, and the last one a street type;
    they are looked up by place, so no function runs over the word list.
    """
    n = F.size(words)

    def named(word: Column, pairs: dict[str, str]) -> Column:
        return F.coalesce(F.try_element_at(_lookup(pairs), word), word)

    return F.concat_ws(
        " ",
        named(F.when(n > 1, F.get(words, F.lit(0))), DIRECTIONS),
        named(F.when(n > 2, F.get(words, F.lit(1))), DIRECTIONS),
        F.slice(words, 3, F.greatest(n - 3, F.lit(0))),
        named(F.try_element_at(words, F.lit(-1)), {**STREET_TYPES, **DIRECTIONS}),
    )


def street_part(raw: Column) -> Column:
    """The canonical street words of an address, without unit, city or punctuation."""
    # transform over a one-element array names the word list once.
    return F.transform(F.array(street_words(raw)), canonical_street)[0]


def join_parts(street: Column, unit: Column, keep_unit: Column | bool) -> Column:
    keep = keep_unit if isinstance(keep_unit, Column) else F.lit(keep_unit)
    # Each part is named once, so that it is worked out once.
    parts = F.array(street, F.when(keep, unit).otherwise(""))
    return F.array_join(F.array_remove(parts, ""), " ")


def normalize_address(raw: Column, keep_unit: Column | bool = True) -> Column:
    """Canonical lower-case key of an address; '' when there is none."""
    return join_parts(street_part(raw), unit_part(raw), keep_unit)


def street_tokens(raw: Column) -> Column:
    """Distinctive words of a street name: no number, type, direction or unit."""
    ignored = F.array(*[F.lit(x) for x in [*GEOCODE_STREET_TYPES, *GEOCODE_DIRECTIONS, ""]])

    def distinctive(words: Column) -> Column:
        numbered = words[0].rlike(r"^\d+$")
        named = F.filter(words, lambda w, i: ~w.startswith("#") & ~(numbered & (i == 0)))
        return F.array_except(named, ignored)

    # transform over a one-element array names the word list once.
    return F.transform(F.array(F.split(normalize_address(raw, True), " ")), distinctive)[0]


def street_matches(query: Column, matched: Column) -> Column:
    """Whether every distinctive word that was asked for is in the answer."""
    return F.size(F.array_except(street_tokens(query), street_tokens(matched))) == 0
