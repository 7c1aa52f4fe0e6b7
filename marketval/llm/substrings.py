"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over 16 bytes triggers the parse: every string of `length` bytes has a trigger, the
place of the least hash in it, and the starts that share a trigger form a phrase, which reaches
`length` - 1 bytes beyond its last start. So phrases overlap by `length` - 1 bytes, each string of
`length` bytes lies inside exactly one phrase, and what decides a phrase is inside it: equal texts
parse equally wherever they stand. The dictionary holds each different phrase with its least
document; in any later document all strings of that phrase are repeats. What is left are
strings shared by different phrases: only phrases with a common trigger can have any, and for their first
instances the dictionary's suffixes, cut to `length` bytes, are put in order with their documents.
Since no string outreaches its phrase, the order of the parse beyond phrases is not needed.

Documents are dealt into packed groups, a bucketed table in the shared folder, so that the three
passes (phrases, suffixes, removal) read them without moving a text again. Between the passes only
hashes move, packed by ranges of hashes; each group sends a phrase or suffix once, so one that a
third of all documents share is sent once per group. Hashes have 128 bits in all.

A string is a repeat if it also starts in a document with a smaller doc_id. Rows with one doc_id are
one document in this sense: they do not shorten each other. A null doc_id counts as the largest. Null
texts are empty. A text shorter than `length` bytes stays whole. An empty table gives an empty result.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from marketval.llm.common import partitions, small_batches, stored, table
from marketval.llm.registry import query
from marketval.operators.sizing import shared_folder

LENGTH, TRIGGER = 50, 16
#: Bytes of text in a group and in one range of hashes, on average; at least so many of either.
GROUP_BYTES, RANGE_BYTES, LEAST = 4 << 20, 8 << 20, 64
#: Bytes that are hashed at once.
STEP = 1 << 18
LAST = (1 << 63) - 1
#: A string with the trigger in it has so many bytes more on one side at least.
SIDE = (LENGTH - TRIGGER) // 2
NO_SIDE = np.uint64(1 << 16)
_random = np.random.default_rng(20)
SIGNS = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _random.integers(0, 1 << 63, (2, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * FACTORS[0, 6 + k]
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of TRIGGER and of LENGTH bytes, by doubling."""
    f = FACTORS[family]

    def joined(a, b, shift, k):
        n = len(b) - shift
        return a[:n] * f[k] + b[shift:]

    h1 = SIGNS[family][data]
    h2 = joined(h1, h1, 1, 0)
    h4 = joined(h2, h2, 2, 1)
    h8 = mixed(joined(h4, h4, 4, 2))
    h16 = mixed(joined(h8, h8, 8, 3))
    h32 = joined(h16, h16, 16, 4)
    h48 = joined(h32, h16, 32, 5)
    return h16, mixed(joined(h48, h2, 48, 0), 1)


def blocks(ends: np.ndarray):
    """(first byte, last byte, first document, last document) of what is hashed at once: whole
    documents, or parts of a long one that overlap by LENGTH - 1 bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    d = 0
    while d < len(ends):
        if ends[d] - starts[d] > STEP:
            for a in range(int(starts[d]), int(ends[d]) - LENGTH + 1, STEP):
                yield a, min(a + STEP + LENGTH - 1, int(ends[d])), d, d + 1
            d += 1
            continue
        e = max(d + 1, int(np.searchsorted(ends, starts[d] + STEP, "right")))
        yield int(starts[d]), int(ends[e - 1]), d, e
        d = e


def phrases(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Of every phrase: its document's place, first and last start, its trigger's place and hash, its
    content's hash, and hashes of what stands SIDE bytes left and right of the trigger."""
    out = {k: [] for k in ("doc", "first", "last", "at", "trigger", "content", "sides")}
    for a, b, d, e in blocks(ends):
        if b - a < LENGTH:
            continue
        small, long_ = rolling(data[a:b], 0)
        least = (small & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(small), dtype=np.uint64)
        for shift in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-shift], least[shift:])
        least = np.minimum(least[:-3], least[3:])  # over LENGTH - TRIGGER + 1 = 35 places
        stops = np.clip(ends[d:e], a, b) - a
        begins = np.concatenate([[0], stops[:-1]])
        stop_of = np.repeat(stops, stops - begins)[:len(least)]
        at = np.flatnonzero(np.arange(len(least)) + LENGTH <= stop_of)
        if not len(at):
            continue
        trigger = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(at) != 1))
        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        trigger = trigger[np.concatenate([[0], cut + 1])]
        out["doc"].append(d + np.searchsorted(stops, first, "right"))
        out["first"].append(first + a)
        out["last"].append(last + a)
        out["at"].append(trigger + a)
        left = np.where(trigger - first >= SIDE, mixed(small[np.maximum(trigger - SIDE, 0)]) >> np.uint64(48), NO_SIDE)
        right = np.where(last + LENGTH - TRIGGER - trigger >= SIDE, mixed(small[np.minimum(trigger + SIDE, len(small) - 1)]) >> np.uint64(48), NO_SIDE)
        out["sides"].append(left | right << np.uint64(20))
        out["trigger"].append(mixed(small[trigger], 1))
        out["content"].append(mixed(long_[first] * FACTORS[1, 6] + mixed(long_[last]) * FACTORS[1, 7] + (last - first).astype(np.uint64)))
    kinds = {k: np.uint64 if k in ("trigger", "content", "sides") else np.int64 for k in out}
    return {k: np.concatenate([np.zeros(0, kinds[k]), *v]).astype(kinds[k]) for k, v in out.items()}


class Distinct:
    """Different pairs of hashes in order, each with its least document and the rest that equal pairs
    have in common; `of` gives each row's place."""

    def __init__(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray, rest: np.ndarray | None = None):
        order = np.lexsort((doc, two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.one, self.two, self.doc = a[new], b[new], doc[order][new]
        self.rest = np.zeros(new.sum(), np.uint64) if rest is None else rest[order][new]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers as compressed planes of bytes."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in data]


def ranges_of(one: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes each falls into; it grows with the hash."""
    return ((one >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def sent(of: Distinct, group: int, ranges: int):
    """Rows `range, grp, place, blob`: what one group says about each range of hashes."""
    own = ranges_of(of.one, ranges)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(own.view(np.int64))) + 1, [len(own)]])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if hi > lo:
            yield int(own[lo]), group, lo, packed(of.one[lo:hi], of.two[lo:hi], of.doc[lo:hi], of.rest[lo:hi])


SENT = "range long, grp long, place long, blob binary"


def sent_batches(rows, batch: int = 64):
    rows = list(rows)
    for k in range(0, len(rows), batch):
        part = list(zip(*rows[k:k + batch]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()),
                                          pa.array(part[3], pa.binary())], names=["range", "grp", "place", "blob"])


def sides_shared(one: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For different contents in order of their triggers: 1 if another content of the trigger has the
    same left side, plus 2 for the right side."""
    shared = np.zeros(len(one), np.uint64)
    if not sides.any():  # suffixes have none
        return shared
    trigger = np.concatenate([[0], np.cumsum(one[1:] != one[:-1])]).astype(np.uint64)
    for bit, side in ((1, sides & np.uint64(0xFFFFF)), (2, sides >> np.uint64(20))):
        there = np.flatnonzero(side != NO_SIDE)
        _, at, n = np.unique(trigger[there] << np.uint64(20) | side[there], return_inverse=True, return_counts=True)
        shared[there[n[at] > 1]] += np.uint64(bit)
    return shared


def settled(rows: pa.Table) -> pa.Table:
    """What one range of hashes answers each group: the places that are repeats, and the places, four
    times and with the sides added, where another content of the trigger has a side in common."""
    groups, places = rows.column("grp").to_pylist(), rows.column("place").to_pylist()
    parts = [unpacked(b, 4) for b in rows.column("blob").to_pylist()]
    sizes = [len(p[0]) for p in parts]
    one, two, doc, sides = (np.concatenate([p[k] for p in parts]) for k in range(4))
    place = np.concatenate([np.arange(lo, lo + n, dtype=np.uint64) for lo, n in zip(places, sizes)])
    source = np.repeat(np.array(groups, np.int64), sizes)
    order = np.lexsort((doc.view(np.int64), two, one))
    one, two, doc, source, place, sides = one[order], two[order], doc[order].view(np.int64), source[order], place[order], sides[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at = np.flatnonzero(new)
    repeat = doc > doc[at][np.cumsum(new) - 1]
    shared = np.zeros(len(order), np.uint64)
    shared[at] = sides_shared(one[at], sides[at])
    by_group = np.argsort(source, kind="stable")
    owner, out = source[by_group], []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
    for lo, hi in zip(cut[:-1], cut[1:]):
        own = by_group[lo:hi]
        r, s = own[repeat[own]], own[shared[own] > 0]
        if len(r) or len(s):
            out.append((int(owner[lo]), packed(np.sort(place[r])), packed(np.sort(place[s] << np.uint64(2) | shared[s]))))
    cols = list(zip(*out)) or [(), (), ()]
    return pa.table({"grp": pa.array(cols[0], pa.int64()), "repeats": pa.array(cols[1], pa.binary()), "shared": pa.array(cols[2], pa.binary())})


def answers(rows: DataFrame) -> DataFrame:
    """Per group all answers, as lists of packed places."""
    said = rows.groupBy("range").applyInArrow(settled, "grp long, repeats binary, shared binary")
    return stored(said.groupBy("grp").agg(F.collect_list("repeats").alias("repeats"), F.collect_list("shared").alias("shared")))


def places(blobs) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[unpacked(b, 1)[0].view(np.int64) for b in blobs or []]])


class Group:
    """One group's texts, phrases and, once they are known, the answers about them."""

    def __init__(self, row: dict):
        rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all()
        self.rest = rest.drop_columns(["key_of_row", "bytes_of_row"])
        self.ids = np.asarray(rest.column("key_of_row"))
        self.ends = np.cumsum(np.asarray(rest.column("bytes_of_row")))
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(self.ends[-1]))), np.uint8)
        self.grp = row["grp"]
        self.p = phrases(self.data, self.ends)
        self.p_doc = self.ids[self.p["doc"]]
        self.known = Distinct(self.p["trigger"], self.p["content"], self.p_doc, self.p["sides"])

    def repeated_phrases(self, row: dict) -> np.ndarray:
        later = np.zeros(len(self.known.one), bool)
        later[places(row["repeats"])] = True
        return later[self.known.of] | (self.p_doc > self.known.doc[self.known.of])

    def open_suffixes(self, row: dict, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, Distinct]:
        """Starts and documents of the strings that other phrases may share, and their hashes."""
        shared = np.zeros(len(self.known.one), np.int64)
        told = places(row["shared"])
        shared[told >> 2] = told & 3
        sides = shared[self.known.of]
        chosen = np.flatnonzero((sides > 0) & ~repeated)
        # starts whose string holds SIDE bytes left of the trigger, or right of it, where that is shared
        middle = self.p["at"][chosen] - SIDE
        first = np.where(sides[chosen] & 1, self.p["first"][chosen], np.maximum(self.p["first"][chosen], middle))
        last = np.where(sides[chosen] & 2, self.p["last"][chosen], np.minimum(self.p["last"][chosen], middle))
        n = np.maximum(last - first + 1, 0)
        start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        doc = np.repeat(self.p_doc[chosen], n)
        hashes = np.zeros((2, len(start)), np.uint64)
        by_start = np.argsort(start, kind="stable")
        ordered = start[by_start]
        for a, b, _, _ in blocks(self.ends):
            lo, hi = np.searchsorted(ordered, [a, b - LENGTH + 1])
            if hi > lo:
                for family in (0, 1):
                    hashes[family, by_start[lo:hi]] = rolling(self.data[a:b], family)[1][ordered[lo:hi] - a]
        return start, doc, Distinct(mixed(hashes[0], 1), hashes[1], doc)

    def removed(self, row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per document the first and last (exclusive) byte of each removed run."""
        repeated = self.repeated_phrases(row)
        start, doc, suffixes = self.open_suffixes(row, repeated)
        later = np.zeros(len(suffixes.one), bool)
        later[places(row["repeats2"])] = True
        single = start[later[suffixes.of] | (doc > suffixes.doc[suffixes.of])]
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, self.p["first"][repeated], 1)
        np.add.at(change, self.p["last"][repeated] + LENGTH, -1)
        np.add.at(change, single, 1)
        np.add.at(change, single + LENGTH, -1)
        covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
        edge = np.diff(covered)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # two documents that both end and begin removed are two runs
        return first, last


def runs_by_document(first: np.ndarray, last: np.ndarray, ends: np.ndarray):
    """Yield (start of the document, its end, firsts, lasts), runs cut at document ends."""
    begin = 0
    for end in ends.tolist():
        lo, hi = np.searchsorted(last, begin, "right"), np.searchsorted(first, end, "left")
        a, b = np.maximum(first[lo:hi], begin), np.minimum(last[lo:hi], end)
        some = a < b  # a run over the place of an empty document holds nothing of it
        yield begin, end, a[some], b[some]
        begin = end


def grouped(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int]:
    """The packed groups, and how many ranges of hashes suit their size."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(LEAST, -(-total // GROUP_BYTES))
    key = F.coalesce("doc_id", F.lit(LAST)).cast("long")
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("bytes_of_row"), key.alias("key_of_row"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).alias("grp"), *keep)

    def squeeze(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield b.set_column(0, "bytes_of_row", pa.array([press.compress(t) for t in b.column(0).to_pylist()], pa.binary()))

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key_of_row")
        open_ = zstandard.ZstdDecompressor()
        texts = [open_.decompress(t) for t in rows.column("bytes_of_row").to_pylist()]
        rest = rows.select([*keep, "key_of_row"]).append_column("bytes_of_row", pa.array([len(t) for t in texts], pa.int64()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_table(rest)
        press = zstandard.ZstdCompressor(level=3)
        return pa.table({"grp": rows.column("grp").slice(0, 1), "data": pa.array([press.compress(b"".join(texts))], pa.binary()),
                         "rest": pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary())})

    groups = rows.mapInArrow(squeeze, types).groupBy("grp").applyInArrow(pack, "grp long, data binary, rest binary")
    name = f"groups_{uuid.uuid4().hex}"
    (groups.write.bucketBy(partitions(spark), "grp").sortBy("grp").option("compression", "uncompressed")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name), max(LEAST, -(-total // RANGE_BYTES))


def rows_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}


def repeats(docs: DataFrame, keep: list[str], texts: bool = False) -> DataFrame:
    """`keep` columns, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`; with `texts` also `kept`,
    what remains as text, where a sign that is cut in part stays whole, and `spans`, the removed
    runs as (start, length) in bytes."""
    groups, ranges = grouped(docs, keep)

    def first_pass(batches):
        for row in rows_of(batches):
            group = Group(row)
            yield from sent_batches(sent(group.known, group.grp, ranges))

    said = answers(groups.mapInArrow(first_pass, SENT))
    told = groups.join(said, "grp", "left")

    def second_pass(batches):
        for row in rows_of(batches):
            group = Group(row)
            open_ = group.open_suffixes(row, group.repeated_phrases(row))[2]
            yield from sent_batches(sent(open_, group.grp, ranges))

    more = answers(told.mapInArrow(second_pass, SENT)).select("grp", F.col("repeats").alias("repeats2"))
    told = told.join(more, "grp", "left")

    def whole(data: bytes, a: int, b: int) -> tuple[int, int]:
        """The run without signs that it holds only in part."""
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        return a, b

    def third_pass(batches):
        for row in rows_of(batches):
            group = Group(row)
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for begin, end, first, last in runs_by_document(*group.removed(row), group.ends):
                data = group.data[begin:end].tobytes()
                runs = list(zip((first - begin).tolist(), (last - begin).tolist()))
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    edges = [0, *(x for r in runs for x in whole(data, *r)), len(data)]
                    out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode())
                    out["spans"].append([{"start": a, "length": b - a} for a, b in runs])
            columns = [c.combine_chunks() if not isinstance(c, pa.ChunkedArray) else pa.concat_arrays(c.chunks) for c in group.rest.columns]
            columns += [pa.array(out[k], t) for k, t in produced.items()]
            batch = pa.RecordBatch.from_arrays(columns, names=[*keep, *produced])
            for k in range(0, batch.num_rows, 1000):
                yield batch.slice(k, 1000)

    produced = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        produced |= {"kept": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))}
        schema += ", kept string, spans array<struct<start:long,length:long>>"
    types = dict(docs.select(*keep).dtypes)
    return told.mapInArrow(third_pass, ", ".join([*(f"`{c}` {types[c]}" for c in keep), schema]))


@query("op9_prefix_free_repeats")
def op9(spark, folder):
    return repeats(table(spark, folder, "documents"), ["doc_id"])
