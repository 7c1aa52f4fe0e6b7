"""BPE encoding and decoding with the word vocabulary, by a contiguous array of ranks.

Encoding equals the tokenizers library's with the same file: special strings in a text become their
ids, the rest is NFC, white space is one blank, letters are lower case; words, digits and runs of
other signs are merged as bytes with an end-of-word mark. Decoding joins the tokens with blanks,
since the file has no decoder.

A word always gives the same ids, so each Python worker keeps the words it has met in two bounded
generations, and only words it does not hold are merged.

A null text is empty: no ids, an empty decoded text. Repeated rows each get a row.
"""

import hashlib
import heapq
import json
import re
import unicodedata
from collections import ChainMap
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from marketval.llm.common import small_batches, table
from marketval.llm.registry import query

#: Words of a generation. Words that are met again stay, others leave with the older generation.
GENERATION = 150_000
#: Words that are encoded together, if a text does not hold more.
PART = 200_000
#: Words with more parts than this are merged with a heap: same result, no repeated scans.
SHORT = 64
NONE = 1 << 60


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """One vocabulary file; `pairs` gives the rank of adjacent ids, `merged` the id a rank makes."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.pairs = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.keys, self.key_ranks = (np.array(x, np.int64) for x in zip(*sorted(self.pairs.items())))
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]])
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs])
        self.last = np.array([vocab[s + self.end] for s in signs])
        self.special_ids = {s: (i,) for s, i in self.special.items()}
        self.numbers = list(range(max(self.tokens) + 1))
        self.decimal = list(map(str, self.numbers))
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE for pairs that never merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def short_words(self, words: list[bytes]) -> list[list[int]]:
        """Encode words of about one length together: a row of parts and one of adjacent ranks for
        each. Every pass scans each row for its least rank, deletes that boundary and refreshes the
        ranks beside it; a row without a rank is done."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        column = np.arange(width)
        inside = column < sizes[:, None]
        data = np.zeros((len(words), width), np.uint8)
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        parts = np.where(inside, np.where(column == sizes[:, None] - 1, self.last[data], self.inner[data]), -1)
        found: list = [None] * len(words)
        row = np.arange(len(words))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while True:
            if parts.shape[1] > 1:
                least_at = ranks.argmin(1)
                least = ranks[np.arange(len(row)), least_at]
                live = least < NONE
            else:
                live = np.zeros(len(row), bool)
            for r, ids in zip(row[~live].tolist(), parts[~live].tolist()):
                found[r] = [i for i in ids if i >= 0]
            if not live.any():
                return found
            row, parts, ranks, i, least = row[live], parts[live], ranks[live], least_at[live], least[live]
            n, each = np.arange(len(row)), np.arange(parts.shape[1] - 1)
            parts[n, i] = self.merged[least]
            parts = np.take_along_axis(parts, each + (each > i[:, None]), 1)
            ranks = np.take_along_axis(ranks, each[:-1] + (each[:-1] >= i[:, None]), 1)
            if parts.shape[1] > 1:
                left, right = i > 0, i < ranks.shape[1]
                ranks[n[left], i[left] - 1] = self.ranks(parts[n[left], i[left] - 1], parts[n[left], i[left]])
                ranks[n[right], i[right]] = self.ranks(parts[n[right], i[right]], parts[n[right], i[right] + 1])

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, short ones by classes of length."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            classes.setdefault(max(2, (len(data) - 1).bit_length()), []).append((word, data))
        shared = self.numbers.__getitem__
        for size, members in classes.items():
            if 1 << size <= SHORT:
                encoded = self.short_words([data for _, data in members])
            else:
                encoded = [self.heap([*self.inner[list(data[:-1])].tolist(), int(self.last[data[-1]])]) for _, data in members]
            for (word, _), ids in zip(members, encoded):
                self.young[word] = tuple(map(shared, ids))

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: least rank first, leftmost first, over linked parts."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = lambda a, b: self.pairs.get(a << 32 | b, NONE)
        waiting = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) < NONE]
        heapq.heapify(waiting)
        while waiting:
            least, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[least]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (r := rank(parts[left], parts[right])) < NONE:
                    heapq.heappush(waiting, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def read(self, words: set[str]) -> None:
        """Make all these words young: move those that are old, encode the others."""
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        words = words - young.keys()
        for w in words & old.keys():
            young[w] = old.pop(w)
        self.learn([w for w in words if w not in young])

    def split(self, text: str) -> list[str]:
        """The words of a text, special strings among them as they are."""
        if not any(s in text for s in self.special):
            return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        pieces = self.by_special.split(text)
        return [w for p in pieces for w in ((p,) if p in self.special else self.split(p))]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        out: list[list[int]] = []
        while len(out) < len(texts):
            split, size = [], 0
            while len(out) + len(split) < len(texts) and size < PART:
                split.append(self.split(texts[len(out) + len(split)]))
                size += len(split[-1])
            met = {w for words in split for w in words}
            self.read(met - self.special.keys())
            known = self.young if met.isdisjoint(self.special) else ChainMap(self.special_ids, self.young)
            out += [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
        return out

    def ids_text(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids and tokens of a text, the latter joined with blanks."""
        ids = self.encode_batch([text])[0]
        return len(ids), self.ids_text(ids), self.decode(ids)

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(1)
def encoder(file: str) -> WordBpe:
    """One per Python worker: its words are kept from task to task."""
    return WordBpe(file)


def encoded(docs: DataFrame, file: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """`keep` columns, `n_tokens`, `ids_sha256`, `decoded_sha256`, and the `ids` on request.

    `file` is the text of a vocabulary file; it is sent once to each executor."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    sent = spark.sparkContext.broadcast(file)

    def encode(batches):
        bpe = encoder(sent.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            found = bpe.encode_batch([t or "" for t in b.column("text_to_encode").to_pylist()])
            columns = [*b.columns[1:], pa.array(list(map(len, found)), pa.int64()),
                       pa.array([sha(bpe.ids_text(ids)) for ids in found], pa.string()),
                       pa.array([sha(bpe.decode(ids)) for ids in found], pa.string())]
            if with_ids:
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    chosen = docs.select(F.col("text").alias("text_to_encode"), *keep)
    types = dict(chosen.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string",
                        *["ids array<int>"] * with_ids])
    return chosen.mapInArrow(encode, schema)


def vocabulary(path: str | None = None) -> str:
    """The text of a vocabulary file; the word vocabulary of the public tokenizers by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@query("op3_rank_array_bpe")
def op3(spark, folder):
    return encoded(table(spark, folder, "documents"), vocabulary(), ["doc_id"])
