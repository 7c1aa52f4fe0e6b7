r"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame
functions only.

A text is cut into paragraphs at line breaks and sentence ends; each different paragraph has a
64-bit digest. A sketch of size s has three rows of s cells; every digest falls into one cell of
each row, and a cell holds a count, the exclusive or of its digests, and that of their check hashes.
Two sketches of one size subtract cell by cell, common digests vanish, and peeling recovers the
rest: a cell with one digest left (its check tells) gives it up, and it is taken out of the other
rows, row by row in turn. If cells remain, the pair is tried again with sketches twice as large.

The likeness of two texts is what their digests have in common over all their digests, from the
counts and the recovered differences; two texts without paragraphs are alike (1). The fingerprint
written out is the sketch of size `BASE`, its cells in hexadecimal behind the number of digests.

Null texts are empty and have no paragraphs. Documents follow each other by descending doc_id (nulls
last), then by text; repeated rows follow each other. A single document is its own next.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketval.llm.common import numbered, partitions, stored, table
from marketval.llm.registry import query

PARAGRAPH = r"[\n\r]+|(?<=[.!?])[ \t]+"
BASE = 4
#: Turns of peeling, each over one of the three rows, before a larger sketch is tried.
TURNS = 15
#: Documents whose ids differ in the last 8 bits at most are dealt together.
SPAN_BITS = 8
ROWS = 3


def digests(text: Column) -> Column:
    found = F.transform(F.split(text, PARAGRAPH), lambda p: F.when(F.trim(p) != "", F.xxhash64(F.trim(p))))
    return F.array_distinct(F.filter(found, lambda h: h.isNotNull()))


def check_of(digest: Column) -> Column:
    return F.hash(digest, F.lit(97)).cast("long")


def cell_of(digest: Column, row: Column | int, size: Column | int) -> Column:
    row, size = (F.lit(x) if isinstance(x, int) else x for x in (row, size))
    return (row * size + F.pmod(F.xxhash64(digest, row.cast("int")), size)).cast("int")


def written(found: Column, size: int = BASE) -> Column:
    """A sketch as text: the number of digests, then per cell its count and its digests' exclusive or."""
    def cell(c: Column) -> Column:
        return F.aggregate(F.filter(found, lambda d: cell_of(d, F.call_function("div", c, F.lit(size)).cast("int"), size) == c),
                           F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("x")),
                           lambda s, d: F.struct((s["n"] + 1).alias("n"), s["x"].bitwiseXOR(d).alias("x")),
                           lambda s: F.concat(F.lpad(F.hex(s["n"]), 4, "0"), F.lpad(F.hex(s["x"]), 16, "0")))

    cells = F.transform(F.sequence(F.lit(0), F.lit(ROWS * size - 1)), cell)
    return F.lower(F.concat(F.hex(F.size(found).cast("long")), F.lit(":"), F.array_join(cells, "")))


def size_for(n: Column) -> Column:
    """The least power of two of cells a row that may hold the differences of texts of `n` digests."""
    return F.greatest(F.lit(BASE).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(1.0) + n * 0.75))).cast("long"))


def peeled(pairs: DataFrame, key: list[str]) -> DataFrame:
    """`pairs(key, left, right, size)` to `key, differing, open`: the recovered digests that only
    one side has, and how many cells could not be resolved. `pairs` come partitioned by the key's
    first column, so that no step moves rows."""
    sides = F.array(F.struct(F.lit(1).alias("sign"), F.col("left").alias("of")), F.struct(F.lit(-1).alias("sign"), F.col("right").alias("of")))
    each = pairs.select(*key, "size", F.explode(sides).alias("side")).select(*key, "size", "side.sign", F.explode("side.of").alias("digest"))
    falls = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), cell_of(F.col("digest"), r, F.col("size")).alias("cell")) for r in range(ROWS)]))
    cells = each.select(*key, "size", "sign", "digest", check_of(F.col("digest")).alias("check"), falls.alias("f")).select(
        *key, "size", "f.row", "f.cell", "sign", "digest", "check")

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy(*key, "size", "row", "cell").agg(
            F.sum("sign").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"),
            F.sum("found").alias("found"))

    state = summed(cells.withColumn("found", F.lit(0).cast("long")))
    for turn in range(TURNS):
        row = turn % ROWS
        empty = (F.col("n") == 0) & (F.col("digest") == 0) & (F.col("check") == 0) & (F.col("found") == 0)
        pure = (F.col("row") == row) & (F.abs("n") == 1) & (check_of(F.col("digest")) == F.col("check"))

        def out(r: int) -> Column:
            return F.struct(F.lit(r).alias("row"), cell_of(F.col("digest"), r, F.col("size")).alias("cell"), (-F.col("n")).alias("sign"),
                            "digest", "check", F.lit(0).cast("long").alias("found"))

        zero = F.lit(0).cast("long")
        done = F.struct(F.lit(row).alias("row"), F.col("cell"), zero.alias("sign"), zero.alias("digest"), zero.alias("check"),
                        (F.col("found") + 1).alias("found"))
        same = F.struct("row", "cell", F.col("n").alias("sign"), "digest", "check", "found")
        shown = F.when(pure, F.array(done, *[out(r) for r in range(ROWS) if r != row])).otherwise(F.array(same))
        state = summed(state.where(~empty).select(*key, "size", F.explode(shown).alias("s")).select(*key, "size", "s.*"))
    unresolved = (F.col("n") != 0) | (F.col("digest") != 0) | (F.col("check") != 0)
    return state.groupBy(*key).agg(F.sum("found").alias("differing"), F.sum(unresolved.cast("long")).alias("open"))


def in_blocks(docs: DataFrame) -> DataFrame:
    """`doc_id, text, block, first, next_text`: texts move once, dealt by blocks of ids. The last
    document of a block has no next one yet; `first` marks the one that a block begins with."""
    # null ids go last: they form the lowest block
    block = F.coalesce(F.shiftright("doc_id", SPAN_BITS), F.lit(-(1 << 62)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("block", block)
    order = W.partitionBy("block").orderBy(F.desc("doc_id"), "text")
    return rows.repartition(partitions(docs.sparkSession), "block").select(
        "*", F.lag(F.lit(True)).over(order).isNull().alias("first"), F.lead("text").over(order).alias("next_text"))


def described(rows: DataFrame, keep: list[str | Column]) -> DataFrame:
    """What the comparison needs of each text, of its edited text and of the next document's."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    found = rows.withColumn("edited", edited).select(
        *keep, "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("next"))
    counts = {f"n_{k}": F.size(k) for k in ("own", "changed", "next")}
    return found.withColumns(counts | {"fingerprint": written(F.col("own")), "edited_fingerprint": written(F.col("changed"))})


def with_digests(docs: DataFrame) -> DataFrame:
    """Every document `described`, with an `id` of its row. Where a block ends, the next document is
    the first of the next block: only the texts at both ends of a block are kept for that."""
    last = F.col("next_text").isNull()
    ends = F.when(F.col("first") | last, F.col("text")).alias("text")
    kept = stored(described(in_blocks(docs), ["block", "first", last.alias("last"), ends, F.monotonically_increasing_id().alias("id")]))
    ordered, n = numbered(kept.select("block").distinct(), [F.desc("block")], "at")
    ordered = stored(ordered)
    following = ordered.select(F.pmod(F.col("at") - 1, F.lit(max(n, 1)).cast("long")).alias("at"), F.col("block").alias("next_block"))
    heads = kept.where("first").select(F.col("block").alias("next_block"), F.col("text").alias("next_text"))
    tails = (kept.where("last").select("id", "doc_id", "block", "text")
             .join(ordered.select("block", "at").join(following, "at"), "block").join(heads, "next_block"))
    rest = kept.where(~F.col("last")).drop("block", "first", "last", "text")
    return rest.unionByName(stored(described(tails, ["id"])))


def likenesses(docs: DataFrame) -> DataFrame:
    """One row per document: the contract's columns."""
    kept = with_digests(docs)
    settled, level = [], 0
    waiting = kept.select("id", "own", "changed", "next", F.array(F.lit("edited"), F.lit("next")).alias("todo"))
    while True:
        # the first attempt holds the cells of all texts: parts small enough to aggregate in memory
        parts = partitions(docs.sparkSession) * (1 if level else 4)
        right = F.when(F.col("pair") == "edited", F.col("changed")).otherwise(F.col("next"))
        tried = waiting.repartition(parts, "id").withColumn("pair", F.explode("todo")).select(
            "id", "pair", F.col("own").alias("left"), right.alias("right"))
        size = size_for(F.greatest(F.size("left"), F.size("right"))) * (1 << level)
        result = stored(peeled(tried.withColumn("size", size), ["id", "pair"]))
        settled.append(result.where("open = 0"))
        again = stored(result.where("open > 0").groupBy("id").agg(F.collect_set("pair").alias("todo")))
        if again.isEmpty():
            break
        waiting, level = stored(waiting.drop("todo").join(again, "id")), level + 1
    found = reduce(DataFrame.unionByName, settled).groupBy("id").agg(
        *[F.max(F.when(F.col("pair") == k, F.col("differing"))).alias(f"apart_{k}") for k in ("edited", "next")])

    def near(other: str, differing: str) -> Column:
        both, apart = F.col("n_own") + F.col(other), F.coalesce(differing, F.lit(0).cast("long"))
        return F.when(both == 0, 1.0).otherwise((both - apart) / (both + apart))

    return kept.join(found, "id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near("n_changed", "apart_edited").alias("near_edited"), near("n_next", "apart_next").alias("near_next"))


@query("op2_lookup_sketch")
def op2(spark, folder):
    return likenesses(table(spark, folder, "documents"))
