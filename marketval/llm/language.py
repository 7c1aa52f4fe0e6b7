"""Language identification: word first, backing off to shorter and shorter character n-grams.

A word that the model knows adds its log frequency in each language. A word it does not know is
read from the left: at each place the longest known n-gram (four letters down to one) adds its log
frequency, scaled to its length; letters never seen add nothing. The language with the highest sum
wins; on a tie, the first by code point.

Learned from a sample of labelled texts, whole: up to about `per_language` documents of each
language, drawn by a hash of doc_id, from documents whose crc32(doc_id as text) mod 5 is not 0. The
model keeps the `max_words` most frequent words and `max_grams` n-grams of each length.

A null text, or one without a letter, is `und` with score 0. Without any labelled document every
text is `und`. Null languages teach nothing. Repeated rows each get a row.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from marketval.llm.common import small_batches, stored, table
from marketval.llm.registry import query

ORDERS = (4, 3, 2, 1)
PER_LANGUAGE = 4000
MAX_WORDS = 100_000
MAX_GRAMS = 50_000
SEED = 11
#: Chunks that a task keeps the sums of.
CACHE = 100_000
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    def __init__(self, langs: list[str], tables: dict[int, dict[str, np.ndarray]]):
        self.langs, self.tables = langs, tables
        self.at: dict[str, int] = {}
        self.sums = np.zeros((CACHE + 1, len(langs)))
        self.has_letter = np.zeros(CACHE + 1, bool)

    def word(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return known
        marked, total, i = f"^{word}$", np.zeros(len(self.langs)), 0
        while i < len(marked):
            for n in ORDERS:
                found = self.tables[n].get(marked[i:i + n]) if i + n <= len(marked) else None
                if found is not None:
                    total, i = total + found, i + max(1, n - 1)
                    break
            else:
                i += 1
        return total

    def chunk(self, chunk: str) -> int:
        """Row of the sums of a chunk without white space."""
        row = self.at[chunk] = len(self.at)
        words = words_of(chunk)
        self.sums[row] = sum((self.word(w) for w in words), np.zeros(len(self.langs)))
        self.has_letter[row] = bool(words)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        total, letters = np.zeros(len(self.langs)), False
        chunks = (text or "").split()
        for k in range(0, len(chunks), CACHE // 2):
            part = chunks[k:k + CACHE // 2]
            if len(self.at) > CACHE // 2:
                self.at.clear()
            get = self.at.get
            rows = [r if (r := get(c)) is not None else self.chunk(c) for c in part]
            total, letters = total + self.sums[rows].sum(0), letters or self.has_letter[rows].any()
        if not letters or not self.langs:
            return "und", 0.0
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def counted(sample: DataFrame) -> DataFrame:
    """`size, gram, lang, n`: words (size 0) and n-grams of the sample, counted in each task first."""
    def count(batches):
        seen: dict[tuple, int] = {}

        def flush():
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({
                "size": pa.array([k[0] for k in keys], pa.int32()), "gram": pa.array([k[1] for k in keys], pa.string()),
                "lang": pa.array([k[2] for k in keys], pa.string()), "n": pa.array([seen[k] for k in keys], pa.int64())})
            seen.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word in words_of(text or ""):
                    seen[0, word, lang] = seen.get((0, word, lang), 0) + 1
            words = [(k[1], k[2], n) for k, n in seen.items() if k[0] == 0]
            for word, lang, n in words:
                for size in ORDERS:
                    for gram in grams_of(word, size):
                        seen[size, gram, lang] = seen.get((size, gram, lang), 0) + n
            yield from flush()

    return (sample.select("text", "lang").mapInArrow(count, "size int, gram string, lang string, n long")
            .groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_words: int = MAX_WORDS,
          max_grams: int = MAX_GRAMS) -> Model:
    small_batches(docs.sparkSession, 500)
    learn = docs.where(F.col("lang").isNotNull() & ~held_out())
    share = learn.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    kept = {r["lang"]: r["share"] for r in share.collect()}  # one row per language
    if not kept:
        return Model([], {n: {} for n in (0, *ORDERS)})
    at_most = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(s)) for lang, s in sorted(kept.items())])
    counts = stored(counted(learn.where(drawn < at_most)))
    totals = {(r["size"], r["lang"]): r["n"] for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    langs, tables = sorted(kept), {}
    for size in (0, *ORDERS):
        of = counts.where(F.col("size") == size).groupBy("gram").agg(
            F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
        if size == 0:
            of = of.where("n > 1")
        top = of.orderBy(F.desc("n"), "gram").limit(max_words if size == 0 else max_grams)
        floor = 0.5
        base = np.log([totals.get((size, lang), 0) + 1.0 for lang in langs])
        scale = 1.0 if size == 0 else max(1, size - 1) / size
        tables[size] = {r["gram"]: scale * (np.log([r["by"].get(lang, 0) + floor for lang in langs]) - base) for r in top.collect()}
    return Model(langs, tables)


def identified(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns, `lang_pred` and `score`."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    sent = spark.sparkContext.broadcast((model.langs, model.tables))

    def identify(batches):
        own = Model(*sent.value)
        for b in batches:
            found = [own.predict(t) for t in b.column("text_to_identify").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, "lang_pred", "score"])

    chosen = docs.select(F.col("text").alias("text_to_identify"), *keep)
    types = dict(chosen.dtypes)
    return chosen.mapInArrow(identify, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string", "score double"]))


@query("op7_word_first_language")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    return identified(docs, train(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
