"""What several operators share: tables in the shared folder, global row numbers, components."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marketval.operators.sizing import shared_folder
from marketval.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: lineage ends there, and a
    lost executor costs one read. The folder is the one that `spark.checkpoint.dir` names."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in small Arrow batches, so a worker's memory stays bounded."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """`df` with its global row number from 0 in the given order, and the number of rows.

    A range partitioning orders the rows; each partition numbers its own, and the offsets (one row
    per partition) are added. The order is extended by the row's place in its input partition, so a
    value that many rows share is split over partitions; rows equal in `order` come in no set order.
    """
    tie, row = f"{name}_tie", f"{name}_row"
    n = partitions(df.sparkSession)
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    kept = stored(ranged.withColumn(row, F.monotonically_increasing_id()))
    part, at = F.shiftright(row, 33), F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    out = kept.withColumn("part", part).join(F.broadcast(before), "part").drop("part")  # one row per partition
    return out.withColumn(name, F.col("before") + at).drop("before", row), kept.count()


def components(links: DataFrame) -> DataFrame:
    """`links(a, b)` to `(node, component)`: the least node that each linked node can reach.

    Each round sends every node to the least neighbour of its least neighbour and rewrites the links
    in those terms: an image of a link is a link of the images, so nothing is lost, and the least
    node of a component always stays itself. Links shrink every round; each round's table is stored.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return stored(df.where(F.col("a") != F.col("b"))
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    edges, steps = tidy(links), []
    empty = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        over = up.select(F.col("a").alias("to"), F.col("to").alias("over"))
        step = stored(up.join(over, "to").select("a", F.col("over").alias("to")))
        steps.append(step)
        ends = step.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        edges = tidy(edges.join(step, "a").join(ends, "b").select(F.col("to").alias("a"), F.col("b_to").alias("b")))
    if not steps:
        return empty
    def follow(labels: DataFrame, step: DataFrame) -> DataFrame:
        on = step.select(F.col("a").alias("component"), F.col("to").alias("next"))
        return labels.join(on, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return reduce(follow, steps[1:], steps[0].select(F.col("a").alias("node"), F.col("to").alias("component")))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """`row`, a struct of every column, and `at`, a number that no other row has. Store it before
    use: a second reading of `docs` may number the rows otherwise."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))


def whole_row(docs: DataFrame) -> DataFrame:
    """`doc_id, source, text` and `row`, a struct of every other column, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))


def unfolded(df: DataFrame, like: DataFrame, text: Column) -> DataFrame:
    """The columns of `like` again, with another text and its length in `n_chars`."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in like.columns])
