"""SimHash near-duplicates by a generalised pigeonhole over partitions of correlated bits.

A fingerprint bit is set if over half of a text's shingle hashes have it set. Two fingerprints that
differ in at most 3 of 64 bits differ, in some partition i of m, in at most t[i] bits whenever the
thresholds sum to 3 - m + 1 (-1 leaves a partition out). So a fingerprint probes each partition with
every value within its own t[i], and each candidate is verified on all bits.

Bits that vary together share a partition: groups grow greedily by the correlation measured over
all fingerprints. Each fingerprint's thresholds come from a dynamic programme over the partitions
that minimises probes plus estimated candidates; the estimate convolves the measured distributions of bytes
of a partition's value. The number of partitions with the least total cost over all fingerprints is
used, so the plan follows the data; any choice finds every pair.

Texts with equal fingerprints are one node, so copies never meet in a join. The pair with the larger
fingerprint as prober is kept, each once.

A null text has no words and so fingerprint zero, like any text without words. Rows with a null
doc_id take part, and the component takes its name from the least doc_id that is not null. Rows that
share a doc_id each get a row. An empty table gives an empty result.
"""

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marketval.llm.common import components, numbered_rows, small_batches, stored, table
from marketval.llm.registry import query

BITS, DISTANCE = 64, 3
PARTITIONS = (2, 3, 4)
#: Relative costs of shipping a probe and of verifying a candidate.
PROBE, CANDIDATE = 1.0, 0.5
BLOCK = 1 << 16
UPPER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def shingles(text: str, words: int = 3):
    """Hashes of the space-joined shingles of a text, in blocks."""
    found = text.encode().translate(UPPER).split()  # bytes.split parts at 0x20 and 0x09 to 0x0D
    digest = xxhash.xxh64_intdigest
    if not found:
        return
    if len(found) < words:
        yield np.array([digest(b" ".join(found), 42)], np.uint64)
        return
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ends = (starts[words:] - 1).tolist()
    starts = starts[:len(ends)].tolist()
    for k in range(0, len(ends), BLOCK):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[k:k + BLOCK], ends[k:k + BLOCK])], np.uint64)


def fingerprint(text: str) -> int:
    """The unsigned fingerprint of a text; bit i of it is bit i of the hashes' majority."""
    total, n = np.zeros(BITS, np.int64), 0
    for hashes in shingles(text):
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and `bits`, the fingerprint as a signed long."""
    small_batches(docs.sparkSession, 1000)

    def each(batches):
        for b in batches:
            of = np.array([fingerprint(t or "") for t in b.column("text_to_hash").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(of.view(np.int64))], names=[*keep, "bits"])

    chosen = docs.select(F.col("text").alias("text_to_hash"), *keep)
    types = dict(chosen.dtypes)
    return chosen.mapInArrow(each, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "bits long"]))


def _bits(column) -> np.ndarray:
    of = np.asarray(column).astype(np.int64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(of, axis=1, bitorder="little")


def _summed(nodes: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all nodes of `add(bits)`, a vector of `size` numbers: that many reach the driver."""
    def partial(batches):
        total = np.zeros(size)
        for b in batches:
            total += add(_bits(b.column("bits")))
        yield pa.RecordBatch.from_pydict({"at": np.arange(size), "value": total})

    rows = nodes.select("bits").mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(size)
    for r in rows:
        total[r["at"]] = r["value"]
    return total


def groups(together: np.ndarray, n: float, m: int) -> list[list[int]]:
    """Bits in `m` groups of about equal size; each grows by the bit most correlated with it."""
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        order = sorted(free)
        group = [max(order, key=lambda i: (corr[i, order].sum(), -i))]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda i: corr[i, group].mean())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


class Plan:
    """Partitions for each m, and the histograms of the bytes of their values."""

    def __init__(self, parts: dict[int, list[list[int]]], histogram: np.ndarray, n: float):
        self.parts, self.n = parts, n
        self.near = []  # per byte of bits: share of fingerprints at distance 0..3 from each value
        apart = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
        for of in histogram.reshape(-1, 256):
            self.near.append(np.stack([(of * (apart == e)).sum(1) for e in range(DISTANCE + 1)], 1) / max(n, 1))

    @staticmethod
    def chunks(part: list[int]) -> list[list[int]]:
        return [part[k:k + 8] for k in range(0, len(part), 8)]

    @staticmethod
    def histogram(parts: dict[int, list[list[int]]], bits: np.ndarray) -> np.ndarray:
        out = []
        for m in PARTITIONS:
            for part in parts[m]:
                for chunk in Plan.chunks(part):
                    value = bits[:, chunk] @ (1 << np.arange(len(chunk)))
                    out.append(np.bincount(value, minlength=256))
        return np.concatenate(out).astype(float)

    def thresholds(self, bits: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Per fingerprint its thresholds, one per partition, and their estimated cost."""
        first = sum(len(self.chunks(p)) for k in PARTITIONS if k < m for p in self.parts[k])
        n, budget = len(bits), DISTANCE - m + 1
        least = np.full((n, DISTANCE + m + 2), np.inf)  # by sum of thresholds, shifted by m
        least[:, m] = 0
        picks = []
        for part in self.parts[m]:
            at = np.zeros((n, DISTANCE + 1))
            at[:, 0] = 1
            for chunk in self.chunks(part):
                here = self.near[first][bits[:, chunk] @ (1 << np.arange(len(chunk)))]
                first += 1
                at = np.stack([sum(at[:, i] * here[:, e - i] for i in range(e + 1)) for e in range(DISTANCE + 1)], 1)
            upto = np.cumsum(at, 1) * self.n
            probes = np.cumsum([comb(len(part), e) for e in range(DISTANCE + 1)])
            cost = np.concatenate([np.zeros((n, 1)), upto * CANDIDATE + probes * PROBE], 1)  # t = -1, 0, .. 3
            new, pick = np.full_like(least, np.inf), np.zeros(least.shape, np.int8)
            for t in range(-1, DISTANCE + 1):
                moved = np.full_like(least, np.inf)
                moved[:, max(t, 0):least.shape[1] + min(t, 0)] = least[:, max(-t, 0):least.shape[1] - max(t, 0)] + cost[:, [t + 1]]
                better = moved < new
                new, pick = np.where(better, moved, new), np.where(better, t, pick)
            least = new
            picks.append(pick)
        at, chosen = np.full(n, budget + m), []
        for pick in reversed(picks):
            t = pick[np.arange(n), at]
            chosen.append(t)
            at = at - t
        return np.stack(chosen[::-1], 1), least[:, budget + m]

    def keys(self, bits: np.ndarray, m: int) -> list[np.ndarray]:
        """The value of each partition."""
        return [bits[:, part].astype(np.int64) @ (np.int64(1) << np.arange(len(part))) for part in self.parts[m]]


def flips(width: int, distance: int) -> np.ndarray:
    """All masks of exactly `distance` of `width` bits."""
    masks = [0]
    for _ in range(distance):
        masks = sorted({x | 1 << b for x in masks for b in range(width) if not x >> b & 1})
    return np.array(masks, np.int64)


def links(nodes: DataFrame) -> DataFrame:
    """`nodes(bits)`, distinct, to `(a, b)`: the pairs that differ in at most 3 bits."""
    corr = _summed(nodes, BITS * BITS + 1, lambda x: np.append((x.T.astype(np.float64) @ x).ravel(), len(x)))
    n = max(corr[-1], 1)
    parts = {m: groups(corr[:-1].reshape(BITS, BITS), n, m) for m in PARTITIONS}
    size = 256 * sum(len(Plan.chunks(p)) for m in PARTITIONS for p in parts[m])
    plan = Plan(parts, _summed(nodes, size, lambda x: Plan.histogram(parts, x)), n)
    costs = _summed(nodes, len(PARTITIONS), lambda x: np.array([plan.thresholds(x, m)[1].sum() for m in PARTITIONS]))
    m = PARTITIONS[int(costs.argmin())]
    masks = {w: [flips(w, e) for e in range(DISTANCE + 1)] for w in {len(p) for p in parts[m]}}

    def emit(part, key, bits):
        return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "key": pa.array(key, pa.int64()), "bits": pa.array(bits, pa.int64())})

    def index(batches):
        for b in batches:
            own = np.asarray(b.column("bits"))
            for i, key in enumerate(plan.keys(_bits(b.column("bits")), m)):
                yield emit(np.full(len(own), i), key, own)

    def probe(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                own, bits = np.asarray(b.column("bits"))[k:k + 256], _bits(b.column("bits"))[k:k + 256]
                t = plan.thresholds(bits, m)[0]
                for i, key in enumerate(plan.keys(bits, m)):
                    for e in range(DISTANCE + 1):
                        go = t[:, i] >= e
                        if go.any():
                            mask = masks[len(plan.parts[m][i])][e]
                            yield emit(np.full(go.sum() * len(mask), i), (key[go][:, None] ^ mask).ravel(), np.repeat(own[go], len(mask)))

    schema = "part int, key long, bits long"
    known = nodes.select("bits").mapInArrow(index, schema)
    probes = nodes.select("bits").mapInArrow(probe, schema).withColumnRenamed("bits", "other")
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= DISTANCE
    return (known.hint("shuffle_merge").join(probes, ["part", "key"]).where(near & (F.col("other") > F.col("bits")))
            .select(F.col("bits").alias("a"), F.col("other").alias("b")))


def classes(rows: DataFrame) -> DataFrame:
    """`rows(bits, doc_id)` to `(bits, root, component_id)`, one row per fingerprint."""
    nodes = stored(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = components(links(nodes)).withColumnRenamed("node", "bits")
    named = nodes.join(linked, "bits", "left").withColumn("root", F.coalesce("component", "bits"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(named.join(least, "root").select("bits", "root", "component_id"))


def grouped(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns (with `doc_id`), `fingerprint` and `component_id`."""
    rows = stored(fingerprints(docs, keep))
    return (rows.join(classes(rows).drop("root"), "bits").withColumn("fingerprint", F.lower(F.lpad(F.hex("bits"), 16, "0")))
            .select(*keep, "fingerprint", "component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of near-duplicates: the one with the least doc_id, a null id
    after all others. Rows stand for themselves, whatever id they carry: of rows that share the
    least id one stays, and rows that share an id in different groups do not touch each other."""
    whole = stored(numbered_rows(docs))
    rows = stored(fingerprints(whole.select("row.text", "row.doc_id", "at"), ["doc_id", "at"]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at"))
    kept = rows.join(classes(rows).select("bits", "root"), "bits").groupBy("root").agg(first.alias("first"))
    return whole.join(kept.select("first.at"), "at", "left_semi").select("row.*")


@query("op1_simhash_pigeonhole")
def op1(spark, folder):
    return grouped(table(spark, folder, "documents"), ["doc_id"])
