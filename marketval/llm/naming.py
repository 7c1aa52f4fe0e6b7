"""Exact duplicates by deterministic block naming, in DataFrame functions alone.

A text is cut into blocks of `block` bytes of its UTF-8 form. All different blocks are put in order
and numbered: two blocks have one name if and only if they are equal. Then names of adjacent blocks
are paired, all different pairs are put in order and numbered, and so on until a document has one
name left; that name and the round it came in are its identity, and no two different texts share it.

Only the naming of blocks moves text, each different block once. Names find their way back to the
documents by a 16-byte key of the block. The ordered blocks prove the key: where two of them share
one, the next salt is tried, so the join by key is as exact as one by block.

A document that holds a name which occurs once anywhere has no copy and goes no further. Copies
collapse before every shuffle of the naming, and the joins back are between plain tables, which
adaptive execution splits where a name is hot.

A null text is empty; empty texts are equal to each other. Of equal texts the row with the largest
doc_id stays; null ids lose to all others, and `keep_id` is null where every id of a group is. Rows
that share a doc_id are rows of their own: they count in `group_size`, and of rows that share the
largest doc_id one stays. Other columns are not read. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, functions as F

from marketval.llm.common import stored, table
from marketval.llm.registry import query

BLOCK = 1024


def text_bytes() -> Column:
    return F.coalesce("text", F.lit("")).cast("binary")


def blocks(size: int) -> Column:
    """The blocks of column `bytes` in order; an empty text has one empty block."""
    last = F.greatest(F.ceil(F.octet_length("bytes") / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("bytes", i * size + 1, F.lit(size)))


def block_key(block: Column, salt: int) -> list[Column]:
    """Two 64-bit hashes of a block; a salt gives another pair."""
    return [F.xxhash64(block, F.lit(2 * salt)), F.xxhash64(block, F.lit(2 * salt + 1))]


def named(df: DataFrame, by: list[str]) -> DataFrame:
    """The different values of `by`, in order within their partition, with a `name` of their own and
    the number of their rows, `n`."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*by)
            .withColumn("name", F.monotonically_increasing_id()))


def block_names(texts: DataFrame, size: int, key=block_key) -> tuple[DataFrame, int]:
    """`texts(bytes)` to `(a, b, name, n)`, one row per different block, and the salt of the key."""
    salt = 0
    while True:
        each = named(texts.select(F.explode(blocks(size)).alias("block")), ["block"])
        a, b = key(F.col("block"), salt)
        names = stored(each.select(a.alias("a"), b.alias("b"), "name", "n"))
        if names.groupBy("a", "b").agg(F.count(F.lit(1)).alias("of")).where("of > 1").isEmpty():
            return names, salt
        salt += 1


def with_copies(names: DataFrame) -> DataFrame:
    """`names(row, at, name, n)` without the rows that hold a name which occurs once."""
    shared = names.groupBy("row").agg(F.min("n").alias("n")).where("n > 1").select("row")
    return stored(names.drop("n").join(shared, "row", "left_semi"))


def identities(rows: DataFrame, names: DataFrame) -> DataFrame:
    """`rows(row, keys)` to `(row, round, name)` for each row that may have a copy."""
    at = rows.select("row", F.posexplode("keys").alias("at", "key")).select("row", "at", "key.a", "key.b")
    current = with_copies(at.join(names, ["a", "b"]).select("row", "at", "name", "n"))
    found, done = None, 0
    while True:
        size = current.groupBy("row").agg(F.max("at").alias("last"))
        whole = size.where("last = 0").select("row")
        ends = current.join(whole, "row", "left_semi").select("row", F.lit(done).alias("round"), "name")
        found = ends if found is None else found.unionByName(ends)
        open_ = current.join(size.where("last > 0").select("row"), "row", "left_semi")
        pair = [F.max(F.when(F.col("at") % 2 == side, F.col("name"))).alias(c) for side, c in enumerate("ab")]
        pairs = stored(open_.groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(*pair)
                       .withColumn("b", F.coalesce("b", F.lit(-1))))
        if pairs.isEmpty():
            return found
        done += 1
        current = with_copies(pairs.join(stored(named(pairs, ["a", "b"])), ["a", "b"]).select("row", "at", "name", "n"))


def copies(docs: DataFrame, keep: list[str], block: int = BLOCK, key=block_key) -> DataFrame:
    """`keep` (with `doc_id`), `keep_id`, `group_size`, `kept` and `text_sha256`, for each row."""
    texts = docs.select(*keep, text_bytes().alias("bytes"))
    names, salt = block_names(texts, block, key)
    keys = F.transform(blocks(block), lambda x: F.struct(*[k.alias(c) for k, c in zip(key(x, salt), "ab")]))
    own = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own")
    rows = stored(texts.select(own, F.sha2("bytes", 256).alias("text_sha256"), keys.alias("keys"),
                               F.monotonically_increasing_id().alias("row")))
    whole = stored(identities(rows, names).join(rows.select("row", F.col("own.doc_id").alias("id")), "row"))
    last = F.max(F.struct("id", "row"))
    groups = stored(whole.groupBy("round", "name").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size")))
    of = (whole.select("row", "round", "name").join(groups.where("group_size > 1"), ["round", "name"])
          .select("row", "group_size", "last"))
    alone = F.col("last").isNull()
    return rows.drop("keys").join(of, "row", "left").select(
        "own.*", F.when(alone, F.col("own.doc_id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("last.row") == F.col("row"))).alias("kept"), "text_sha256")


OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""


@query("op13_block_naming", OP13_SQL)
def op13(spark, folder):
    return copies(table(spark, folder, "documents"), ["doc_id"])
