"""Near-duplicate vectors by sorted projection passes.

In each of `passes` passes every vector gets a string of random hash bits (the sides of random
hyperplanes) and vectors of one label are put in the order of these strings; a vector is compared
with its neighbours in that order. The window is the run of neighbours that share the string's first
t bits, where t grows with the logarithm of the label's size, so that a run of unrelated vectors
holds about `window` of them at any size; labels of up to window * 2 ** `SHARED` vectors have one t. A window of a fixed number of places would drop links
among many close vectors; a run has no such limit. Runs over `block` vectors are cut into blocks and
each pair of blocks is compared on its own, so no task holds a whole run.

A pair is counted in the first pass whose run it shares, which both vectors' hash strings tell, so
nothing is counted twice and pairs are never written out: a comparison gives each vector its number
of links and the least vector of its part of the run. These join up to components. Two vectors at cosine 0.98 share
a bit with a chance p of 0.936, so t bits in one of the passes with 1 - (1 - p ** t) ** passes. The
passes of a label grow with its t so that a pair at the least cosine is missed with a chance of
`MISS` at most, at any size: 20 for t up to 10, 28 for t = 14, 60 for t = 24. Where that would take
more than `MOST` passes, t is less and the runs are longer.

Equal vectors of a label are one node with a multiplicity. Vectors that are null, empty, zero or hold a null
or a number that is not finite, and rows without a label, link with nothing and stay. Vectors of different
lengths never link. Rows that share a vec_id count as separate vectors; a null vec_id is never the
name of a component that has another. An empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketval.llm.common import components, partitions, small_batches, stored, table
from marketval.llm.registry import query

COSINE = 0.98
#: Passes at least, and at most.
PASSES, MOST = 20, 128
#: Chance at most that a pair at the least cosine shares no run.
MISS = 1e-6
WINDOW = 64
SHARED = 9
BLOCK = 1024
SEED = 5
BITS = 30


def passes(t: int, cosine: float = COSINE) -> float:
    """Passes in which a pair at `cosine` shares `t` bits in one, but for a chance of `MISS`."""
    share = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** t
    if share == 1:
        return PASSES if t else 1
    return max(PASSES, math.ceil(math.log(MISS) / math.log1p(-share))) if share > 1e-9 else math.inf


def bits(size: int, window: float, cosine: float = COSINE) -> int:
    """Bits that the vectors of a run share in a label of `size` vectors."""
    t = min(BITS, max(0, math.ceil(math.log2(max(1.0, size / window)))))
    while passes(t, cosine) > MOST:
        t -= 1
    return t


def _planes(dim: int, block: int) -> np.ndarray:
    """Planes of `PASSES` passes, the `block`th of their kind."""
    return np.random.default_rng([SEED, dim, block] if block else [SEED, dim]).standard_normal((dim, PASSES * BITS))


def hashes(vectors: list[np.ndarray], wanted: list[int]) -> list[list[int]]:
    """The hash strings of each vector, one number of `BITS` bits for each pass that is wanted of
    it, first bit highest."""
    out: list[list[int]] = [[] for _ in vectors]
    weight = np.int64(1) << np.arange(BITS - 1, -1, -1)
    sizes, wanted = np.array([len(v) for v in vectors]), np.array(wanted)
    for dim in np.unique(sizes):
        for block in range(-(-int(wanted[sizes == dim].max()) // PASSES)):
            rows = np.flatnonzero((sizes == dim) & (wanted > block * PASSES))
            sides = np.stack([vectors[i] for i in rows]) @ _planes(int(dim), block) >= 0
            for i, strings in zip(rows, (sides.reshape(len(rows), PASSES, BITS) @ weight).tolist()):
                out[i] += strings[:wanted[i] - block * PASSES]
    return out


def compare(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, before: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of x, j of y) at the cosine or above that share no run in the passes before."""
    norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
    i, j = np.nonzero((x @ y.T) / norm >= cosine)
    first = ~(of_x[i, :before] == of_y[j, :before]).any(1)
    return i[first], j[first]


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each can reach by the links."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def usable(vector: str = "embedding", label: str = "label"):
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull(), F.lit(False))


def linked(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """`vectors(vec_id, embedding, label)` to `vec_id, n_links, component_id, kept`."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).withColumn("ok", usable("v"))
    rows = stored(rows.select("*", F.xxhash64("v").alias("h1"), F.hash("v", F.lit(SEED)).alias("h2")))
    good = rows.where("ok")
    nodes = (good.groupBy("label", "h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"),
                                                   F.any_value("v").alias("v")))
    sizes = stored(good.select("label", "h1", "h2").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    big = sizes.where(F.col("size") > window * 2.0 ** SHARED)  # so few that they can be sent everywhere
    t_of = F.udf(lambda size: bits(size, window, cosine), "int")
    rest = bits(sizes.where(F.col("size") <= window * 2.0 ** SHARED).agg(F.max("size")).first()[0] or 1, window, cosine)
    nodes = (nodes.withColumn("node", F.xxhash64("label", "h1", "h2"))
             .join(F.broadcast(big.select("label", t_of("size").alias("t"))), "label", "left").withColumn("t", F.coalesce("t", F.lit(rest))))

    def hashed(batches):
        for b in batches:
            vs = [np.asarray(v, float) for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes(vs, [passes(t, cosine) for t in b.column("t").to_pylist()]), pa.list_(pa.int64()))], names=[*b.schema.names, "hashes"])

    types = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    nodes = stored(nodes.mapInArrow(hashed, types + ", hashes array<bigint>"))

    places = nodes.select("node", "label", "t", F.size("v").alias("dim"), F.posexplode("hashes").alias("pass", "hash"))
    run = ["pass", "label", "dim", "prefix"]
    places = places.withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - t)")).drop("hash", "t")
    large = places.groupBy(*run).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = large.select(*run, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = places.join(large, run, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*run, "low", "high"]
    cut = cut.select("node", *run, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    placed = cut.join(nodes.select("node", "v", "hashes", "times", "t"), "node")
    n = max(partitions(spark), 1)
    placed = placed.repartition(n, *key).sortWithinPartitions(*key, "hashes", "node")

    def compared(batches):
        shown: dict = {"key": None, "rows": []}

        def finish():
            found = shown["rows"]
            if len(found) < 2:
                return None
            k = shown["key"]
            ids = np.array([r[0] for r in found], np.int64)
            x = np.stack([r[2] for r in found])
            prefixes = np.stack([r[3] for r in found]) >> (BITS - found[0][5])  # one label, so one t
            times = np.array([r[4] for r in found])
            side = np.array([r[1] == k[5] for r in found])  # in the higher block
            a, c = (np.flatnonzero(~side), np.flatnonzero(side)) if k[4] != k[5] else (np.arange(len(ids)),) * 2
            count, ends = np.zeros(len(ids), np.int64), ([], [])
            for p in range(0, len(a), 512):
                for q in range(0, len(c), 512):
                    aa, cc = a[p:p + 512], c[q:q + 512]
                    if k[4] == k[5] and q < p:
                        continue
                    i, j = compare(x[aa], x[cc], prefixes[aa], prefixes[cc], k[0], cosine)
                    i, j = aa[i], cc[j]
                    if k[4] == k[5]:
                        i, j = i[i < j], j[i < j]
                    np.add.at(count, i, times[j])
                    np.add.at(count, j, times[i])
                    # links of this tile are only kept as far as they join something
                    low = least_linked(len(ids), i, j)
                    joined = np.flatnonzero(low != np.arange(len(ids)))
                    ends[0].append(joined)
                    ends[1].append(low[joined])
            low = least_linked(len(ids), np.concatenate(ends[0] or [[]]).astype(int), np.concatenate(ends[1] or [[]]).astype(int))
            with_links = np.flatnonzero(count > 0)
            if not len(with_links):
                return None
            return pa.RecordBatch.from_pydict({"node": ids[with_links], "links": count[with_links], "low": ids[low[with_links]]})

        for b in batches:
            cols = [b.column(c).to_pylist() for c in key]
            own_, node = b.column("own").to_pylist(), b.column("node").to_pylist()
            vs, hs, ts = b.column("v"), b.column("hashes"), b.column("times").to_pylist()
            bits_ = b.column("t").to_pylist()
            for r, k in enumerate(zip(*cols)):
                if k != shown["key"]:
                    if (done := finish()) is not None:
                        yield done
                    shown["key"], shown["rows"] = k, []
                shown["rows"].append((node[r], own_[r], np.asarray(vs[r].values), np.asarray(hs[r].values), ts[r], bits_[r]))
        if (done := finish()) is not None:
            yield done

    parts = stored(placed.mapInArrow(compared, "node long, links long, low long"))
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"))
    names = components(parts.select(F.col("node").alias("a"), F.col("low").alias("b")))
    classes = (nodes.select("node", "label", "h1", "h2", "times", "least").join(counts, "node", "left").join(names, "node", "left")
               .withColumn("root", F.coalesce("component", "node")))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(classes.join(roots, "root").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), "h1", "h2").join(classes, ["label", "h1", "h2"], "left")
    name = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"),
                      F.coalesce(F.col("vec_id") == name, F.lit(True)).alias("kept"))


@query("op4_sorted_projections")
def op4(spark, folder):
    return linked(table(spark, folder, "embeddings"))
