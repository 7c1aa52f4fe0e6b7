"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only.

Row number i of N goes to place p(i), a permutation of 0..N-1; shard p % shards, slot p div shards.
So shard sizes differ by one row at most, slots have no gaps, and either direction is arithmetic:
`original` tells which row lies at a shard and slot.

Row numbers follow (doc_id, crc32, size), nulls first. Rows equal in all three are interchangeable.
A null text has no bytes and the crc32 of the empty text. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.llm.common import numbered, table
from marketval.llm.registry import query

ROUNDS = 6
SHARDS = 40
SEED = 20260
#: The grid has fewer than sqrt(N) + 1 cells beyond N, and a walk visits none twice. So 64 steps
#: always end below 4,096 rows; beyond, a walk is longer with a chance under 64 ** -64.
WALK = 64


def _sides(n: int) -> tuple[int, int]:
    a = max(1, int(n ** 0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _once(x: Column, n: int, seed: int, forward: bool) -> Column:
    """One pass of the network over the a x b grid: the halves take turns to shift each other."""
    a, b = _sides(n)

    def step(halves: Column, k: Column) -> Column:
        left, right = halves["left"], halves["right"]
        by_right = F.pmod(F.xxhash64(right, F.lit(seed), k), F.lit(a))
        by_left = F.pmod(F.xxhash64(left, F.lit(seed), k), F.lit(b))
        if not forward:
            by_right, by_left = -by_right, -by_left
        even = k % 2 == 0
        return F.struct(F.when(even, F.pmod(left + by_right, F.lit(a))).otherwise(left).alias("left"),
                        F.when(even, right).otherwise(F.pmod(right + by_left, F.lit(b))).alias("right"))

    rounds = F.array(*[F.lit(k) for k in (range(ROUNDS) if forward else reversed(range(ROUNDS)))])
    right = F.pmod(x, F.lit(b))
    start = F.struct(F.call_function("div", x - right, F.lit(b)).alias("left"), right.cast("long").alias("right"))
    return F.aggregate(rounds, start, step, lambda h: h["left"] * F.lit(b) + h["right"])


def _walk(x: Column, n: int, seed: int, forward: bool) -> Column:
    steps = F.sequence(F.lit(1), F.lit(WALK))
    once = _once(x, n, seed, forward)
    return F.aggregate(steps, once, lambda v, _: F.when(v >= n, _once(v, n, seed, forward)).otherwise(v),
                       lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("walk too long")).cast("long")))


def permuted(row: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number `row` among `n`."""
    return _walk(row, n, seed, True)


def original(place: Column, n: int, seed: int = SEED) -> Column:
    """The row number at `place`: the inverse of `permuted`."""
    return _walk(place, n, seed, False)


def shard(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`df` with `row`, `shard` and `slot`."""
    rows, n = numbered(df, [F.col(c) for c in order], "row")
    return (rows.withColumn("place", permuted(F.col("row"), max(n, 1), seed))
            .withColumn("shard", (F.col("place") % shards).cast("int"))
            .withColumn("slot", F.call_function("div", F.col("place"), F.lit(shards))).drop("place"))


@query("op10_feistel_shards")
def op10(spark, folder):
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(narrow, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
