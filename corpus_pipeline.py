"""A training corpus from raw documents: five stages, each over all that the one before has kept.

Quality filter, one document of each group of near-duplicates, repeated passages cut, sources mixed
to target weights, tokens. Every stage but the last returns the columns of its input; where a stage
shortens texts, `n_chars` is the new length. Nulls, empty texts, repeated rows and further columns
are handled as the operators' own descriptions say; an empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketval.llm import bpe, mixing, quality, simhash, substrings
from marketval.llm.common import stored, table, unfolded, whole_row


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.repeats(whole_row(docs), ["row"], texts=True)
    return unfolded(cut, docs, F.col("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = whole_row(docs)
    out = bpe.encoded(rows.select("doc_id", "source", "text"), bpe.vocabulary(), ["doc_id", "source"], with_ids=True)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", tokenize),
]

#: Classifier scores, hashes and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
