"""Mixing sources to target weights by fitting subset sums.

Sources in code point order (null last) weigh 5, 2, 1, repeating. They share `scale` times all
words; a source's target stops at twice its words, and the excess is shared anew by weight. A source
gives whole passes over its documents, then fills the remaining budget with distinct documents:
from counts per exact length it takes the same share of each length, then the longest that still
fit, and a bounded-knapsack dynamic programme over the remaining lengths, however long, closes the
last `window` words. Where that misses the budget, less is taken ahead and the programme is run
again over `WIDEN` times the window, in the end over the whole budget, so that the fill is as near
as that of any subset. Within a length the documents with the least seeded hash are taken.

Per source, one task holds the counts per length, which are as many as there are different lengths,
however many documents there are. Documents are ranked in 4,096 hash ranges per length, so that a
length that many documents share is never one group.

Null texts have size 0. Documents without words cost nothing and are taken as often as the whole
passes of their source. Rows that share a doc_id are ranked next to each other and each count.
An empty table gives an empty result; a source without words has target 0.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from marketval.llm.common import numbered, numbered_rows, small_batches, stored, table
from marketval.llm.registry import query

WEIGHTS = (5, 2, 1)
SCALE = 1.5
REPEATS = 2
#: Words that the dynamic programme closes at first; its tables take six bytes for each.
WINDOW = 8192
WIDEN = 8
SEED = 7
RANGES = 4096
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, from the column's UTF-8 bytes at once."""
    texts = texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    at = offsets - offsets[0]
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    begins[firsts] = inside[firsts]  # a text begins anew, whatever the text before ends with
    upto = np.concatenate([[0], np.cumsum(begins)])
    return upto[at[1:]] - upto[at[:-1]]


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and `size`, the words of the text."""
    small_batches(docs.sparkSession, 4000)

    def count(batches):
        for b in batches:
            n = word_counts(b.column("text_to_count").fill_null(""))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*keep, "size"])

    chosen = docs.select(F.col("text").alias("text_to_count"), *keep)
    types = dict(chosen.dtypes)
    return chosen.mapInArrow(count, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", size long")


def targets(sizes: DataFrame, weights=WEIGHTS, scale: float = SCALE, repeats: int = REPEATS) -> DataFrame:
    """`sizes(source, size)`, one row per source, to `source, size, weight, target`."""
    ordered, _ = numbered(sizes, [F.col("source").isNull(), F.col("source").cast("binary")], "rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    open_ = stored(ordered.select("source", "size", weight.alias("weight")))
    total = open_.agg(F.sum("size")).first()[0] or 0
    left, level, full = scale * total, 0.0, F.lit(False)
    limit = F.col("size") * float(repeats)
    while True:
        rest = open_.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, limit))).first()
        if not rest[0]:
            break
        new = (left - (rest[1] or 0.0)) / rest[0]
        over = limit <= F.col("weight") * new
        if open_.where(over & ~full).isEmpty():
            level = new
            break
        level, full = new, over
    return open_.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)) if rest[0] else limit)


def fit(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many of each length to take so that their sum comes as near to `budget` from below as
    any choice can; `lengths` descend and are positive."""
    if budget >= sum(n * c for n, c in zip(lengths, counts)):
        return list(counts)
    unit = math.gcd(*lengths)  # sums between its multiples do not exist
    lengths, budget = [n // unit for n in lengths], budget // unit
    while True:
        taken, gap = closed(lengths, counts, budget, window)
        if not gap or window >= budget:  # met, or nothing was taken ahead of the programme
            return taken
        window *= WIDEN


def closed(lengths: list[int], counts: list[int], budget: int, window: int) -> tuple[list[int], int]:
    """As `fit`, with all but about the last `window` words taken ahead of the programme, and how
    much of the budget is left; the best there is where the window holds the budget."""
    whole = sum(n * c for n, c in zip(lengths, counts))
    taken = [c * budget // whole if budget > window else 0 for c in counts]
    left = budget - sum(n * k for n, k in zip(lengths, taken))
    for i, n in enumerate(lengths):
        if left <= window:
            break
        more = min(counts[i] - taken[i], (left - window // 2) // n)
        taken[i] += more
        left -= n * more
    # lengths that are left over may be longer than the window: the programme covers all of `left`
    reach, by = np.zeros(left + 1, bool), np.zeros(left + 1, np.int32)
    reach[0], steps = True, []
    for i, n in enumerate(lengths):
        room, piece = min(counts[i] - taken[i], left // n), 1
        while room > 0 and not reach[left]:
            k = min(piece, room)
            new = np.flatnonzero(reach[:left + 1 - n * k] & ~reach[n * k:]) + n * k
            reach[new], by[new] = True, len(steps)
            steps.append((i, k))
            room -= k
            piece *= 2
    at = int(np.flatnonzero(reach)[-1])
    gap = left - at
    while at:  # what a step reached first comes from a sum that an earlier step reached
        i, k = steps[by[at]]
        taken[i] += k
        at -= lengths[i] * k
    return taken, gap


def mix(docs: DataFrame, keep: list[str], weights=WEIGHTS, scale: float = SCALE, repeats: int = REPEATS,
        seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """`keep` (with `doc_id` and `source`) and `size, source_size, target, copies, taken`."""
    rows = stored(sized(docs, keep))
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, scale, repeats)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    plan = stored(by_source.select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target", whole.alias("passes"),
        F.floor(F.col("target") - whole * F.col("size")).cast("long").alias("budget")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        lengths, counts = pdf["size"].tolist(), pdf["n"].tolist()
        return pdf.assign(chosen=fit(lengths, counts, int(pdf["budget"].iloc[0]), window))[["source", "size", "chosen"]]

    counts = (rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
              .join(plan.select("of", "budget"), F.col("source").eqNullSafe(F.col("of"))).drop("of").where("budget > 0"))
    source = f"source {dict(rows.dtypes)['source']}"
    chosen = stored(counts.groupBy("source").applyInPandas(choose, f"{source}, size long, chosen long").where("chosen > 0"))

    hash_, range_ = F.xxhash64("doc_id", F.lit(seed)), F.col("hash_range")
    ranged = rows.withColumn("seeded", hash_).withColumn("hash_range", F.pmod(F.shiftright("seeded", 40), F.lit(RANGES)))
    per_range = ranged.where("size > 0").groupBy("source", "size", "hash_range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("source", "size").orderBy("hash_range"))
    c = chosen.select(F.col("source").alias("of"), F.col("size").alias("of_size"), "chosen")
    edges = (per_range.withColumn("left_over", upto)
             .join(c, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")))
             .select("of", "of_size", range_.alias("of_range"), (F.col("chosen") - F.col("left_over") + F.col("n")).alias("quota"))
             .where("quota > 0"))
    rank = F.row_number().over(W.partitionBy("source", "size", "hash_range").orderBy("seeded", "doc_id"))
    out = (ranged.withColumn("rank", rank)
           .join(edges, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
                 & (range_ == F.col("of_range")), "left")
           .drop("of").join(plan, F.col("source").eqNullSafe(F.col("of")), "left"))
    copies = F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)
    return (out.withColumn("copies", copies)
            .select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Rows stand for themselves: of rows that
    share a doc_id, or are alike, each is taken as often as its own place in the mix says."""
    whole = stored(numbered_rows(docs))
    taken = mix(whole.select("row.doc_id", "row.source", "row.text", "at"), ["doc_id", "source", "at"], **how)
    often = taken.where("copies > 0").select("at", "copies")
    return whole.join(often, "at").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


@query("op6_subset_sum_mix")
def op6(spark, folder):
    return mix(table(spark, folder, "documents"), ["doc_id", "source"]).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")
