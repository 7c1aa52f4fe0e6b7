"""Text helpers: number formatting, names, globs, export safety, focus windows."""

import re

from pyspark.sql import Column, functions as F

from marketval.constants import (
    BLOCK_PAGE_HEAD,
    BLOCK_SIGNALS,
    FOCUS_HEAD,
    FOCUS_MAX_CHARS,
    FOCUS_TERMS,
    FOCUS_WINDOW,
    NOT_FOUND,
    PLACEHOLDER_NAMES,
)

# Every Unicode white space character. Trimming by this list is a plain character scan, where
# Java's \s would need the slow Unicode mode.
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)


def strip(x: Column) -> Column:
    """No white space at either end."""
    return F.trim(x, F.lit(WHITE))


def grouped(x: Column, places: int = 0) -> Column:
    """1234567.5 -> '1,234,568', half to even."""
    return F.format_number(x, places)


def percent(x: Column, places: int = 0) -> Column:
    return F.concat(F.format_number(x * 100, places), F.lit("%"))


def or_dash(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(NOT_FOUND))


def squeeze(x: Column) -> Column:
    """Whitespace collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, f"[{WHITE}]+", " "))


def clean_name(x: Column) -> Column:
    """A real party's name, or NULL for a filler name, doubled or not."""
    text = squeeze(x)
    plain = F.trim(F.lower(text), F.lit(" .,"))
    filler = plain.isin([*PLACEHOLDER_NAMES, *[f"{n} {n}" for n in PLACEHOLDER_NAMES]])
    return F.when((text != "") & ~filler, text)


def glob_regex(glob: str) -> str:
    """An upper-cased, anchored regular expression for a shell glob."""
    out, i = [], 0
    text = glob.upper()
    while i < len(text):
        c = text[i]
        end = text.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = text[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def family_of(name: Column, families: list[tuple[str, list[str]]]) -> Column:
    """First family, in priority order, with a glob that fits the name; else the name."""
    upper = F.upper(name)
    expr = None
    for family, globs in families:
        rule = upper.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
        expr = F.when(rule, family) if expr is None else expr.when(rule, family)
    picked = name if expr is None else expr.otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) != "", picked)


def text_safe(x: Column) -> Column:
    """Text that a spreadsheet would read as a formula is marked as text."""
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def safe_name(x: Column) -> Column:
    """A market or profile name usable as a directory name."""
    tidy = F.regexp_replace(strip(x), r"[^A-Za-z0-9._-]+", "-")
    tidy = F.trim(tidy, F.lit("-."))
    return F.when(tidy != "", tidy).otherwise(F.lit("unnamed"))


def is_block_page(html: Column) -> Column:
    """Whether the head of a page carries a challenge or refusal phrase."""
    head = F.lower(F.substring(html, 1, BLOCK_PAGE_HEAD))
    said = F.contains(head, F.lit(BLOCK_SIGNALS[0]))
    for signal in BLOCK_SIGNALS[1:]:
        said = said | F.contains(head, F.lit(signal))
    return said


def focus_text(
    text: Column,
    terms: list[str] = FOCUS_TERMS,
    window: int = FOCUS_WINDOW,
    max_chars: int | None = None,
    head: int = FOCUS_HEAD,
    short: int | None = None,
) -> Column:
    """The head of a long text and a window round every term; short text unchanged.

    Each term's hits are read off the lengths of the pieces that the term splits the text
    into, so the work stays in the JVM. Windows that touch are merged. With `max_chars`, pieces
    are cut so that together they hold that many characters at most. A text of up to `short`
    characters (`max_chars` where given) is short.
    """
    if short is None:
        short = FOCUS_MAX_CHARS if max_chars is None else max_chars
    max_chars = 2**31 - 1 if max_chars is None else max_chars
    size = F.length(text)
    low = F.lower(text)

    def hits(term: str) -> Column:
        pieces = F.split(low, "\\Q" + term + "\\E", -1)
        before = F.slice(pieces, 1, F.size(pieces) - 1)
        start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("next"))
        walked = F.aggregate(
            before,
            start,
            lambda acc, piece: F.struct(
                F.array_append(acc["at"], acc["next"] + F.length(piece)).alias("at"),
                (acc["next"] + F.length(piece) + F.lit(len(term))).alias("next"),
            ),
        )
        return walked["at"]

    spans = F.array_sort(
        F.concat(
            F.array(F.struct(F.lit(0).alias("a"), F.least(F.lit(head), size).alias("b"))),
            F.transform(
                F.flatten(F.array(*[hits(t) for t in terms])),
                lambda p: F.struct(
                    F.greatest(F.lit(0), p - window // 2).alias("a"),
                    F.least(size, p + window).alias("b"),
                ),
            ),
        )
    )
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))),
        )
        return F.when(F.size(acc) == 0, F.array(s)).when(s["a"] <= last["b"], joined).otherwise(
            F.concat(acc, F.array(s))
        )

    merged = F.aggregate(spans, empty, merge)
    taken = F.aggregate(
        merged,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n")),
        lambda acc, s: F.when(acc["n"] >= max_chars, acc).otherwise(
            F.struct(
                F.array_append(
                    acc["out"],
                    F.substr(
                        text, s["a"] + 1, F.least(s["b"] - s["a"], F.lit(max_chars) - acc["n"])
                    ),
                ).alias("out"),
                (acc["n"] + F.least(s["b"] - s["a"], F.lit(max_chars) - acc["n"])).alias("n"),
            )
        ),
    )["out"]
    return F.when(size <= short, text).otherwise(F.array_join(taken, "\n[...]\n"))
