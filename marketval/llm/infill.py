"""Fill-in-middle: texts cut at unit borders into prefix, middle and suffix, and put in another order.

A unit is a run of ASCII letters or any other single code point. The UTF-8 bytes of a whole batch of
texts are viewed as 64-bit words. Eight bytes at a time, arithmetic marks each byte that ends a unit:
one whose successor begins a code point, unless both are letters; the last byte of a text always
ends one. The marks of a word are packed into a byte and counted, a cumulative sum over words finds
the word that holds the k-th mark, and a select inside the word gives its place. So no text is cut
into a list of units, and a batch takes about its own size again in memory.

Cuts and forms follow from the doc_id alone, by its digest: reruns agree.

A null text is empty, and an empty text is plain. A null doc_id is digested as an empty string; rows
that share a doc_id are drawn alike, each on its own text. A text that holds a marker stays plain,
since it could not be read back. An empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketval.llm.common import small_batches, table
from marketval.llm.registry import query

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Share of texts, in per cent, that are transformed, and of those that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: Words that are marked at a time.
STEP = 1 << 18

ONES, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
BYTE, PACK = np.uint64(8), np.uint64(0x0102040810204080)
#: SELECT[m, k]: place of the k-th set bit (from 1) of the byte m.
SELECT = np.zeros((256, 9), np.int64)
for _m in range(256):
    for _k, _place in enumerate([p for p in range(8) if _m >> p & 1], 1):
        SELECT[_m, _k] = _place


def letters(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is an ASCII letter."""
    low = (words & ~HIGH) | ONES * np.uint64(0x20)
    from_a, past_z = low + ONES * np.uint64(0x80 - 0x61), low + ONES * np.uint64(0x80 - 0x7B)
    return from_a & ~past_z & ~words & HIGH


def after(flags: np.ndarray, first_of_next: np.uint64) -> np.ndarray:
    """Each byte's flag taken from the byte behind it."""
    return flags >> BYTE | np.append(flags[1:], first_of_next) << np.uint64(56)


class Units:
    """Unit ends in the bytes of many texts that lie one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = len(data)
        words = np.zeros(size // 8 + 2, np.uint64)
        words.view(np.uint8)[:size] = data
        self.marks = np.zeros(len(words), np.uint8)
        for k in range(0, len(words) - 1, STEP):
            part = words[k:min(k + STEP, len(words) - 1)]
            behind = words[k + len(part):k + len(part) + 1]
            letter, inner = letters(part), part & ~(part << np.uint64(1)) & HIGH  # inner: 10xxxxxx
            next_letter, next_inner = letters(behind)[0], (behind & ~(behind << np.uint64(1)) & HIGH)[0]
            ends = ~after(inner, next_inner) & ~(letter & after(letter, next_letter)) & HIGH
            self.marks[k:k + len(part)] = (ends >> np.uint64(7)) * PACK >> np.uint64(56)
        # the packing puts the mark of byte p at bit p
        tail = np.arange(size // 8, len(words))
        self.marks[tail] &= ((1 << np.clip(size - tail * 8, 0, 8)) - 1).astype(np.uint8)
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        np.bitwise_or.at(self.marks, last >> 3, (1 << (last & 7)).astype(np.uint8))
        self.upto = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)

    def before(self, place: np.ndarray) -> np.ndarray:
        """Unit ends before each byte."""
        word, below = place >> 3, ((1 << (place & 7)) - 1).astype(np.uint8)
        own = np.bitwise_count(self.marks[word])
        return self.upto[word] - own + np.bitwise_count(self.marks[word] & below)

    def end(self, k: np.ndarray) -> np.ndarray:
        """The byte behind the k-th unit end, counted from 1."""
        word = np.searchsorted(self.upto, k)
        within = k - (self.upto[word] - np.bitwise_count(self.marks[word]))
        return word * 8 + SELECT[self.marks[word], within] + 1


def drawn(ids: list, seed: int) -> np.ndarray:
    """Four numbers for each id: the first 32-bit groups of a digest."""
    digests = b"".join([hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids])
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def transformed_batch(texts: pa.Array, ids: list, seed: int, rate: int, suffix_first: int) -> dict:
    """Columns `n`, `form`, `prefix_chars`, `middle_chars` and `output` of a batch of texts."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] if len(offsets) else 0:offsets[-1] if len(offsets) else 0]
    at = offsets - offsets[0]
    data = np.frombuffer(raw, np.uint8)
    units = Units(data, at)
    first = units.before(at[:-1])
    n = units.before(at[1:]) - first
    h = drawn(ids, seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    inside = cuts > 0
    places = np.broadcast_to(at[:-1, None], cuts.shape).copy()
    places[inside] = units.end((first[:, None] + cuts)[inside])
    starts_code_point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.diff(starts_code_point[np.concatenate([at[:-1, None], places], 1)], axis=1)
    marked = np.zeros(len(texts), bool)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= np.asarray(pa.compute.match_substring(texts, marker))
    plain = (n == 0) | marked | (h[:, 2] % 100 >= rate)
    spm = h[:, 3] % 100 < suffix_first
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    output = []
    for a, (b, c), d, whole, turned in zip(at[:-1].tolist(), places.tolist(), at[1:].tolist(), plain.tolist(), spm.tolist()):
        if whole:
            output.append(bytes(raw[a:d]))
        elif turned:
            output.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            output.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return {"n": pa.array(n), "form": pa.array(form.tolist(), pa.string()),
            "prefix_chars": pa.array(chars[:, 0], mask=plain), "middle_chars": pa.array(chars[:, 1], mask=plain),
            "output": pa.array(output, pa.binary()).cast(pa.string())}


def transformed(docs: DataFrame, keep: list[str], seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`keep` columns, `n` (units), `form` (plain, psm or spm), `prefix_chars`, `middle_chars` (code
    points, null where plain) and `output`."""
    small_batches(docs.sparkSession, 2000)
    added = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

    def each(batches):
        for b in batches:
            made = transformed_batch(b.column("text_to_cut"), b.column("id_to_draw").to_pylist(), seed, rate, suffix_first)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *made.values()], names=[*keep, *made])

    chosen = docs.select(F.col("text").alias("text_to_cut"), F.col("doc_id").alias("id_to_draw"), *[F.col(f"`{c}`") for c in keep])
    types = dict(chosen.dtypes)
    return chosen.mapInArrow(each, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {t}" for c, t in added.items())]))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form. Texts hold no marker, and no marker can begin
    inside a text and end in the next marker, so the first and last of each are the ones put in."""
    def between(head: str, tail: str) -> Column:
        return F.substring_index(F.substring_index(output, tail, 1), head, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(output))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || doc_id::VARCHAR) AS d,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents
), h AS (
  SELECT doc_id, body, units, len(units) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
         ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k1, greatest(h1 % (n + 1), h2 % (n + 1)) AS k2,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(units[1:k1], '') AS pre, array_to_string(units[k1 + 1:k2], '') AS mid, array_to_string(units[k2 + 1:], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""


@query("op11_unit_infill", OP11_SQL)
def op11(spark, folder):
    made = transformed(table(spark, folder, "documents"), ["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
