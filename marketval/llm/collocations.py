"""Phrase collocations by counting in a HAT-trie.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words.
A word is known by a 64-bit id, a hash of its language and bytes. The exact counts of all words prove
the ids: where a word that is frequent enough for a phrase shares its id with another, the next seed
is tried.

Three passes read the texts. The first counts words, as bytes. The second counts pairs of adjacent
frequent words by 40 bits of a hash, which tells the pairs that can be frequent. The third counts the
windows of two to five words all of whose pairs can be: a phrase occurs no more often than any part of
it, so nothing is lost, and it counts by the ids of every word, so nothing is confused. Which hashes
are frequent reaches the tasks as a bitmap of fixed size (16 MB at any size of the input); a false hit
there only counts a phrase that is too rare in the end.

Each task counts in a trie whose upper levels go by word ids and whose leaves are hash containers. A
container that grows too large bursts into one per next word. When the trie is full, its largest
subtrees leave whole, as sorted runs of (word ids, count). Runs meet phrase by phrase, each window for
every phrase that it begins with, so that no prefix, however frequent, is one group.

A null text has no words; a null language is `und`. Repeated rows count each time. Other columns are
not read. An empty table gives an empty result.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketval.llm.common import small_batches, stored, table
from marketval.llm.registry import query

LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Bytes of text read at a time, entries of a container before it bursts, entries of a trie.
STEP, BURST, ROOM = 1 << 21, 8192, 400_000
#: Bits of a hash that pairs are counted by, and of the place in the map, which every executor gets.
HASH_BITS, MAP_BITS = 40, 27
SALTS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
#: Texts in bytes to words between blanks.
BLANKED = bytes(0x20 if KIND[b] else LOWER[b] for b in range(256))
IDS = [f"w{k}" for k in range(1, LONGEST + 1)]
#: Exact while its products stay below 10 to the 38th.
SCORE = "CAST(CAST(1000 AS DECIMAL(38, 0)) * a * n DIV (CAST(l AS DECIMAL(38, 0)) * r) AS LONG)"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_ids(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """An id for each word of `data`, from its bytes, eight at a time, and its `salt`; never zero."""
    loads = np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    ids = mixed(salt ^ lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, min(int(lengths.max(initial=0)), 64), 8):
        of = slice(None) if at == 0 else np.flatnonzero(lengths > at)
        left = np.minimum(lengths[of] - at, 8).astype(np.uint64)
        kept = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        ids[of] = mixed(ids[of] ^ loads[starts[of] + at] & kept)
    for k in np.flatnonzero(lengths > 64).tolist():
        word = data[starts[k]:starts[k] + lengths[k]].tobytes()
        ids[k] = xxhash.xxh64_intdigest(word, int(salt[k]))
    ids[ids == 0] = 1
    return ids


def read_words(texts: pa.Array, langs: list, seed: int):
    """Blocks of the words of a batch, in order: ids, piece numbers, starts and lengths of the words in
    the block's bytes, those bytes, and the row of each word. Words of one piece share its number."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    salts = {x: xxhash.xxh64_intdigest(x.encode(), seed) for x in set(langs)}
    salt = np.array([salts[x] for x in langs], np.uint64)
    begin, breaks = 0, 0
    while begin < len(data):
        end = min(begin + STEP, len(data))
        border = offsets[np.searchsorted(offsets, end)]
        while end < border and KIND[data[end]] == WORD:  # a block ends where a word or a text does
            found = np.flatnonzero(KIND[data[end:min(end + 4096, border)]])
            end = end + int(found[0]) if len(found) else min(end + 4096, int(border))
        part = LOWER[data[begin:end]]
        kind = KIND[part]
        inside = kind == WORD
        first = np.zeros(len(part) + 1, bool)
        first[offsets[np.searchsorted(offsets, begin):np.searchsorted(offsets, end, "right")] - begin] = True
        first[[0, -1]] = True
        starts = np.flatnonzero(inside & (first[:-1] | np.append(True, ~inside[:-1])))
        lengths = np.flatnonzero(inside & (first[1:] | np.append(~inside[1:], True))) + 1 - starts
        row = np.searchsorted(offsets, starts + begin, "right") - 1
        broken = np.cumsum(kind == BREAK, dtype=np.int32)
        pieces = broken[starts] + row + breaks
        breaks += int(broken[-1])
        begin = end
        if len(starts):
            yield word_ids(part, starts, lengths, salt[row]), pieces, starts, lengths, part, row


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair's hash: ids are hashes already."""
    return a ^ (b << np.uint64(17) | b >> np.uint64(47))


def hashed(ids: np.ndarray) -> np.ndarray:
    return ids >> np.uint64(20) & np.uint64((1 << HASH_BITS) - 1)


def marked(ids: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = hashed(ids) & np.uint64((1 << MAP_BITS) - 1)
    return bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def frequent_map(of: DataFrame, hash_: Column) -> bytes:
    """The map of the hashes in a table; it comes to the driver in pieces, 16 MB in all at most."""
    place = hash_.bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    parts = of.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(0x7FFF)).alias("bit"))
    out = bytearray(1 << MAP_BITS - 3)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["part"] << 12:(r["part"] << 12) + 4096] = r["bits"]
    return bytes(out)


class HatTrie:
    """Counts of keys of `width` word ids. The root goes by the first id; below it is a container,
    from the bytes of the other ids to a count, or, burst, a container per second id."""

    def __init__(self, width: int, burst: int = BURST, room: int = ROOM):
        self.width, self.burst, self.room = width, burst, room
        self.root: dict[int, dict] = {}
        self.split: set[int] = set()
        self.entries = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """`keys` are rows of ids in ascending order, each once."""
        tails, step = keys[:, 1:].astype(">u8").tobytes(), 8 * (self.width - 1)
        borders = np.flatnonzero(np.append(True, keys[1:, 0] != keys[:-1, 0])).tolist() + [len(keys)]
        counts = counts.tolist()
        for lo, hi in zip(borders, borders[1:]):
            first = int(keys[lo, 0])
            node = self.root.setdefault(first, {})
            if first in self.split:
                for k in range(lo, hi):
                    leaf = node.setdefault(tails[k * step:k * step + 8], {})
                    tail, had = tails[k * step + 8:(k + 1) * step], len(leaf)
                    leaf[tail] = leaf.get(tail, 0) + counts[k]
                    self.entries += len(leaf) - had
                continue
            had = len(node)
            for k in range(lo, hi):
                tail = tails[k * step:(k + 1) * step]
                node[tail] = node.get(tail, 0) + counts[k]
            self.entries += len(node) - had
            if len(node) > self.burst and self.width > 2:
                leaves: dict[bytes, dict] = {}
                for tail, n in node.items():
                    leaves.setdefault(tail[:8], {})[tail[8:]] = n
                self.root[first] = leaves
                self.split.add(first)

    def size(self, first: int) -> int:
        node = self.root[first]
        return sum(map(len, node.values())) if first in self.split else len(node)

    def run(self, firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Take whole subtrees out: their keys in order, and counts."""
        heads, tails, counts = [], [], []
        for first in sorted(firsts):
            node = self.root.pop(first)
            if first in self.split:
                self.split.remove(first)
                node = {second + tail: n for second, leaf in node.items() for tail, n in leaf.items()}
            tails += sorted(node)
            counts += map(node.__getitem__, sorted(node))
            heads += [first] * len(node)
            self.entries -= len(node)
        rest = np.frombuffer(b"".join(tails), ">u8").astype(np.uint64).reshape(len(heads), self.width - 1)
        return np.concatenate([np.array(heads, np.uint64)[:, None], rest], 1), np.array(counts, np.int64)

    def spill(self):
        """Sorted runs of the largest subtrees, until half the room is free."""
        if self.entries > self.room:
            left, chosen = self.entries, []
            for first in sorted(self.root, key=self.size, reverse=True):
                if left <= self.room // 2:
                    break
                left -= self.size(first)
                chosen.append(first)
            yield self.run(chosen)

    def rest(self):
        if self.root:
            yield self.run(list(self.root))


def grouped_rows(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring rows that are equal, once, with the sum of their counts."""
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    return keys[new], np.add.reduceat(counts, new)


def windows(blocks, longest: int, linked):
    """The phrases of two words or more that begin at each word, as long as can be up to `longest`, as
    rows of ids filled up with zeros, for each block. `linked` tells which neighbours may stand in one."""
    reach = longest - 1
    ids, pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows(ids, pieces, starts):
        link = pieces[1:] == pieces[:-1]
        link[link] = linked(ids[:-1][link], ids[1:][link])
        link, ids = np.append(link, np.zeros(reach, bool)), np.append(ids, np.zeros(reach, np.uint64))
        at = np.flatnonzero(link[:starts])
        alive, columns = np.ones(len(at), bool), [ids[at]]
        for k in range(1, longest):
            alive = alive & link[at + k - 1]
            columns.append(np.where(alive, ids[at + k], np.uint64(0)))
        keys = np.stack(columns, 1)
        keys = keys[np.lexsort(keys.T[::-1])]
        return grouped_rows(keys, np.ones(len(keys), np.int64)) if len(keys) else None

    for block in blocks:
        ids, pieces = np.append(ids, block[0]), np.append(pieces, block[1])
        if len(ids) > reach:
            made = rows(ids, pieces, len(ids) - reach)
            ids, pieces = ids[-reach:], pieces[-reach:]
            if made:
                yield made
    if len(ids) and (made := rows(ids, pieces, len(ids))):
        yield made


def plain(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame) -> DataFrame:
    """`(lang, word, n)` of every word."""
    def each(batches):
        counts: dict[str, Counter] = {}

        def taken():
            for lang, of in counts.items():
                words = list(of)
                for k in range(0, len(words), 1 << 16):
                    some = words[k:k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                         pa.array(map(of.__getitem__, some), pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                data, begin = (text or "").encode().translate(BLANKED), 0
                while begin < len(data):
                    end = data.find(b" ", begin + STEP) if len(data) - begin > STEP else -1
                    end = len(data) if end < 0 else end
                    counts.setdefault(lang, Counter()).update(data[begin:end].split())
                    begin = end
                    if sum(map(len, counts.values())) > ROOM:
                        yield from taken()
        yield from taken()

    made = plain(docs).mapInArrow(each, "lang string, word string, n long")
    return made.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(words: DataFrame, seed: int) -> DataFrame:
    """`words` with `id`, by which the words of texts are known in the other passes."""
    def each(batches):
        for b in batches:
            given = [w.encode() for w in b.column("word").to_pylist()]
            lengths = np.array(list(map(len, given)), np.int64)
            salts = {x: xxhash.xxh64_intdigest(x.encode(), seed) for x in set(b.column("lang").to_pylist())}
            salt = np.array([salts[x] for x in b.column("lang").to_pylist()], np.uint64)
            ids = word_ids(np.frombuffer(b"".join(given), np.uint8), np.cumsum(lengths) - lengths, lengths, salt)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids.view(np.int64))], names=["lang", "word", "n", "id"])

    return words.select("lang", "word", "n").mapInArrow(each, "lang string, word string, n long, id long")


def words_and_seed(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Counts of all words with their ids, and a seed under which no frequent word shares its id."""
    counts, seed = stored(word_counts(docs)), 0
    while True:
        words = stored(with_ids(counts, seed))
        shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("of"), F.max("n").alias("n"))
        if shared.where((F.col("of") > 1) & (F.col("n") >= least)).isEmpty():
            return words, seed
        seed += 1


def counted(docs: DataFrame, seed: int, longest: int, bitmap: bytes, linked, emitted, schema: str) -> DataFrame:
    """Rows that `emitted` makes of the sorted runs of each task's trie of windows."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def each(batches):
        bits, trie = np.frombuffer(sent.value, np.uint8), HatTrie(longest)
        for b in batches:
            read = read_words(b.column("text"), b.column("lang").to_pylist(), seed)
            for made in windows(read, longest, lambda x, y: linked(x, y, bits)):
                trie.add(*made)
                for run in trie.spill():
                    yield from emitted(*run)
        for run in trie.rest():
            yield from emitted(*run)

    return plain(docs).mapInArrow(each, schema)


def sliced(batch: pa.RecordBatch):
    for k in range(0, batch.num_rows, 1 << 16):
        yield batch.slice(k, 1 << 16)


def frequent_pairs(docs: DataFrame, seed: int, least: int, bitmap: bytes) -> DataFrame:
    """`hash` of the pairs of frequent words that may occur `least` times."""
    def linked(a, b, bits):
        return marked(a, bits) & marked(b, bits)

    def emitted(keys, n):
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(hashed(pair(keys[:, 0], keys[:, 1])).view(np.int64)), pa.array(n)], names=["hash", "n"]))

    rows = counted(docs, seed, 2, bitmap, linked, emitted, "hash long, n long")
    return rows.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")


def phrase_counts(docs: DataFrame, seed: int, least: int, bitmap: bytes) -> DataFrame:
    """`(w1 .. w5, n)` of the phrases that occur at least `least` times; short ones end in zeros."""
    def linked(a, b, bits):
        return marked(pair(a, b), bits)

    def emitted(keys, n):
        columns = [keys[:, k].copy().view(np.int64) for k in range(LONGEST)]
        yield from sliced(pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], names=[*IDS, "n"]))

    rows = counted(docs, seed, LONGEST, bitmap, linked, emitted, ", ".join(f"{c} long" for c in [*IDS, "n"]))
    longest = F.array_size(F.filter(F.array(*IDS), lambda x: x != 0))
    sized = rows.select("*", F.explode(F.sequence(F.lit(2), longest)).alias("size"))
    phrase = [F.when(F.lit(k) <= F.col("size"), F.col(c)).otherwise(F.lit(0)).alias(c) for k, c in enumerate(IDS, 1)]
    return sized.select(*phrase, "n").groupBy(*IDS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mined(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the `top` phrases of each language by score.

    A phrase of two to five words that occurs `a` times, `least` at least, scores 1000 a n / (l r),
    rounded down, at the cut where that is lowest (then the first cut); `n` is the number of words of
    the language, `l` and `r` the counts of the two sides. A phrase inside a longer one that has
    `share` per cent of its occurrences is left out."""
    small_batches(docs.sparkSession, 4000)
    words, seed = words_and_seed(docs, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stored(words.where(F.col("n") >= least))
    of_word = F.shiftrightunsigned("id", 20).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    pairs = stored(frequent_pairs(docs, seed, least, frequent_map(frequent, of_word)))
    ids = F.filter(F.array(*IDS), lambda x: x != 0)
    counted_ = phrase_counts(docs, seed, least, frequent_map(pairs, F.col("hash")))
    phrases = stored(counted_.select(ids.alias("ids"), F.col("n").alias("a")))
    counts = phrases.unionByName(frequent.select(F.array("id").alias("ids"), F.col("n").alias("a")))

    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    sides = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
                        F.slice("ids", F.col("k") + 1, F.size("ids")).alias("right"))
    known = (sides.join(counts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
             .join(counts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right"))
    spoken = (known.withColumn("id", F.col("ids")[0]).join(frequent.select("id", "lang"), "id")
              .join(totals, "lang"))
    best = (spoken.withColumn("score", F.expr(SCORE)).groupBy("ids")
            .agg(F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("cut")).select("ids", "cut.*"))

    # a phrase in a longer one also is in one that has one word more and occurs as often at least
    sub = F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids")))
    around = (phrases.where(F.size("ids") > 2).select("a", F.explode(sub).alias("ids"))
              .groupBy("ids").agg(F.max("a").alias("around")))
    kept = stored(best.join(around, "ids", "left").where(
        F.col("around").isNull() | (100 * F.col("around") < F.lit(share) * F.col("a"))).drop("around", "k"))

    spelled = (kept.select("ids", F.posexplode("ids").alias("at", "id")).join(frequent.select("id", "word"), "id")
               .groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words")))
    phrase = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    named = kept.join(spelled.select("ids", phrase.alias("phrase")), "ids")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    first = (named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("some", some)
             .where(F.col("some") <= top))
    return (first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), sentences AS (
  SELECT lang, ws, len(ws) AS m FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces) WHERE len(ws) > 0
), occurrences AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, m - size + 2)) AS i FROM sentences, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE m >= size)
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM occurrences GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM candidates c, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS f
  FROM candidates, (SELECT unnest([1, 2, 3, 4, 5]) AS i), (SELECT unnest([1, 2, 3, 4, 5]) AS j)
  WHERE j <= size AND j > i AND j - i + 1 < size GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE o.f IS NULL OR 100 * o.f < 100 * a
QUALIFY rank <= 2000
"""


@query("op12_hat_trie_collocations", OP12_SQL)
def op12(spark, folder):
    return mined(table(spark, folder, "documents"))
