"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics (shares of kinds of signs, of words
shown in capitals, of repeated words, lengths). Per class the labelled rows give a mean and a
covariance, summed over all of them in Spark (a few hundred numbers reach the driver, however many
rows there are), shrunk towards the pooled diagonal. The score is the share of class 1 in the two
densities, from Mahalanobis distances by cached Cholesky factors.

Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2. A null or empty text has
the statistics of a text without signs and gets a score. Rows with a null doc_id are scored, count
as not held out, and meet no label. Repeated rows each get a row; a doc_id with several label rows
counts each. Without labels of both classes the score is 0.5 throughout.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketval.llm.common import small_batches, stored, table
from marketval.llm.registry import query

SHRINK = 0.1
ACCEPT = 0.7
KINDS = ("letter", "capital", "digit", "space", "stop", "shout", "symbol", "bar", "other")


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("symbol"), np.uint8)
    for name, signs in {"letter": bytes(range(0x61, 0x7B)), "capital": bytes(range(0x41, 0x5B)), "digit": b"0123456789",
                        "space": b" \t\n\v\f\r", "stop": b".,;:'\"-()", "shout": b"!?", "bar": b"|"}.items():
        kind[list(signs)] = KINDS.index(name)
    kind[0x80:] = KINDS.index("other")  # bytes of letters beyond ASCII, mostly
    return kind


KIND = _kinds()
N_FEATURES = 14


def statistics(text: str) -> np.ndarray:
    """The vector of one text; logarithms of shares keep their tails moderate."""
    data = text.encode()
    counts = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=len(KINDS)).astype(float)
    n = max(len(data), 1)
    words = data.split()
    w = max(len(words), 1)
    lower = data.lower().split() if words else []
    distinct = len(set(lower))
    twins = sum(map(bytes.__eq__, lower, lower[1:])) if len(lower) > 1 else 0
    lines = data.count(b"\n") + 1
    letters = max(counts[0] + counts[1] + counts[8], 1.0)
    # a share is drawn to `usual` by `drawn` signs or words, so that short texts are not extreme
    share = lambda x, of, usual, drawn: np.log((x + usual * drawn) / (of + drawn))
    return np.array([
        share(counts[1], letters, 0.03, 60), share(counts[2], n, 0.005, 60), share(counts[3], n, 0.15, 60),
        share(counts[4], n, 0.03, 60), share(counts[5], w, 0.01, 30), share(counts[6], w, 0.01, 30),
        share(counts[7], w, 0.01, 30), share(counts[8], n, 0.03, 60), share(twins, w, 0.02, 30),
        np.log(distinct + 10.0) / np.log(w + 10.0), np.log((n + 180) / (w + 30)), np.log(w + 30.0),
        share(lines, w, 0.03, 30), share(data.count(b".\n") + data.endswith(b"."), lines, 0.9, 10)])


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and `stats`, the vector of each text."""
    small_batches(docs.sparkSession, 1000)

    def describe(batches):
        for b in batches:
            rows = [statistics(t or "") for t in b.column("text_to_describe").to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_FEATURES, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], stats], names=[*keep, "stats"])

    chosen = docs.select(F.col("text").alias("text_to_describe"), *keep)
    types = dict(chosen.dtypes)
    return chosen.mapInArrow(describe, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "stats array<double>"]))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products per class of `labelled(stats, quality)`, summed in Spark."""
    def add(batches):
        size = 1 + N_FEATURES + N_FEATURES ** 2
        total = np.zeros((2, size))
        for b in batches:
            y = np.asarray(b.column("quality"))
            x = np.asarray(b.column("stats").flatten()).reshape(len(y), N_FEATURES)
            for c in (0, 1):
                of = x[y == c]
                total[c] += np.concatenate([[len(of)], of.sum(0), (of.T @ of).ravel()])
        yield pa.RecordBatch.from_pydict({"cls": np.repeat([0, 1], size), "at": np.tile(np.arange(size), 2), "value": total.ravel()})

    sums = (labelled.select("stats", "quality").mapInArrow(add, "cls long, at long, value double")
            .groupBy("cls", "at").agg(F.sum("value").alias("value")).collect())
    out = {}
    for c in (0, 1):
        v = np.array([r["value"] for r in sorted((r for r in sums if r["cls"] == c), key=lambda r: r["at"])])
        out[c] = (v[0], v[1:1 + N_FEATURES], v[1 + N_FEATURES:].reshape(N_FEATURES, N_FEATURES)) if len(v) else (0.0, None, None)
    return out


def fit(sums: dict, shrink: float = SHRINK) -> dict | None:
    """Per class: log prior plus log determinant term, mean, and the inverse Cholesky factor."""
    if min(sums[0][0], sums[1][0]) < 2:
        return None
    means = {c: s / n for c, (n, s, _) in sums.items()}
    covs = {c: p / n - np.outer(means[c], means[c]) for c, (n, _, p) in sums.items()}
    total = sums[0][0] + sums[1][0]
    pooled = np.diag(np.diag(sum(covs[c] * sums[c][0] for c in (0, 1)) / total)) + 1e-6 * np.eye(N_FEATURES)
    model = {}
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * covs[c] + shrink * pooled)
        model[c] = (np.log(sums[c][0] / total) - np.log(np.diag(factor)).sum(), means[c], np.linalg.inv(factor))
    return model


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    logs = [of[0] - 0.5 * (((x - of[1]) @ of[2].T) ** 2).sum(1) for of in (model[0], model[1])]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(described_: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> dict | None:
    """The model of `described_(doc_id, stats)` and `labels(doc_id, quality)`, held-out rows left out."""
    learn = labels.select("doc_id", "quality").where("quality in (0, 1)")
    return fit(moments(described_.where(~held_out()).join(learn, "doc_id").select("stats", F.col("quality").cast("int"))), shrink)


def accepted(docs: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """The rows of `docs` whose text scores `ACCEPT` or more. Only vectors are moved; texts are
    read a second time rather than shuffled."""
    model = learned(described(docs, ["doc_id"]), labels, shrink)

    def choose(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), N_FEATURES)
            yield b.filter(pa.array(score(model, x) >= ACCEPT))

    return docs.mapInArrow(choose, docs.schema)


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], shrink: float = SHRINK) -> DataFrame:
    """`keep` columns (with `doc_id`), `held_out`, `score` and `predicted`."""
    described_ = stored(described(docs, keep))
    model = learned(described_, labels, shrink)

    def rate(batches):
        for b in batches:
            x = np.asarray(b.column("stats").flatten()).reshape(b.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score(model, x))], names=[*keep, "score"])

    types = dict(described_.dtypes)
    rated = described_.select("stats", *keep).mapInArrow(rate, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double"]))
    return rated.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


@query("op5_quadratic_quality")
def op5(spark, folder):
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"]).select(
        "doc_id", "held_out", "score", "predicted")
