"""Infilling, phrase mining and exact copies against plain Python and their SQL, odd rows included."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check
from marketval.llm import collocations, infill, naming

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", ["op11_unit_infill", "op12_hat_trie_collocations", "op13_block_naming"])
def test_query_agrees_with_its_sql(spark, name):
    said = check.compare(spark, check.database(FOLDER), name, FOLDER)
    assert said.startswith("ok") and "TYPES" not in said, said


def odd_texts(seed, n):
    rng = random.Random(seed)
    signs = ["a", "Zz", "word", " ", "\n", "\t", "é", "日", "𝄞", "[", "`", "{", "@", "\x00", "1", "<", "P>", "S>", "M>", "́"]
    out = [None, "", "a", "é", "𝄞", "<P>", "x <M> y", "<S", ">", "abc" * 500, "日" * 300]
    return out + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def cut(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, d = len(units), sha(f"1:{'' if i is None else i}")
    h = [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_against_plain_python(spark):
    data = [(None if k % 50 == 7 else k - k % 3 // 2, t, "en", "x", "n", True) for k, t in enumerate(odd_texts(1, 400))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, n string, form string, output boolean")
    got = infill.transformed(docs.select("doc_id", "text", F.col("n").alias("left")), ["doc_id", "text", "left"])
    got = rows(got.withColumn("back", infill.restored(F.col("output"), F.col("form"))))
    of = ["n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple(map(str, r))
    want = sorted(((i, t, *cut(i, t)) for i, t, *_ in data), key=key)
    assert sorted(((r["doc_id"], r["text"], *(r[c] for c in of)) for r in got), key=key) == want
    assert all(r["back"] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert rows(infill.transformed(spark.createDataFrame([], SCHEMA), ["doc_id"])) == []
    assert len(rows(infill.transformed(docs.drop("n", "form", "output"), ["doc_id", "lang"]))) == len(data)


def test_unit_ends_over_words_and_parts(monkeypatch):
    """Texts that begin and end anywhere in a word, and parts of few words."""
    texts = [t or "" for t in odd_texts(2, 300)]
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    offsets = np.cumsum([0, *map(len, encoded)])
    for step in (1, 3, 1 << 18):
        monkeypatch.setattr(infill, "STEP", step)
        units = infill.Units(data, offsets)
        before = units.before(offsets)
        for k, t in enumerate(texts):
            found = [m.group() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", t)]
            ends = offsets[k] + np.cumsum([len(u.encode()) for u in found], dtype=int)
            assert before[k + 1] - before[k] == len(found)
            assert units.end(before[k] + np.arange(1, len(found) + 1)).tolist() == ends.tolist()


def test_units_of_an_empty_batch():
    made = infill.transformed_batch(pa.array([None, ""], pa.string()), [1, None], 1, 90, 20)
    assert made["n"].to_pylist() == [0, 0] and made["output"].to_pylist() == ["", ""]


COPIES = ["abcdefgh", "abcdefgh", "abcdefghabcdefgh", "abcdefghabcdefgx", "ab", "ab", "abc", "abcabc", "abc" * 40, "abc" * 40,
          "abc" * 39 + "abd", None, "", None, "éa", "éa", "é", "日本日本日本", "日本日本日本", "x" * 5000, "x" * 5000, "x" * 5001]


@pytest.mark.parametrize("block", [1, 3, 8, 1024])
def test_copies_against_plain_groups(spark, block):
    data = [(None if k == 1 else k // 2 if k in (8, 9) else k, t, "s", 5, "own") for k, t in enumerate(COPIES)]
    docs = spark.createDataFrame(data, "doc_id long, text string, row string, bytes int, own string").repartition(3)
    got = rows(naming.copies(docs, ["doc_id", "row"], block=block))
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[sha(t or "")].append(i)
    want = Counter((i, max((x for x in of if x is not None), default=None), len(of), h) for h, of in groups.items() for i in of)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    for h, of in groupby(sorted(got, key=lambda r: r["text_sha256"]), lambda r: r["text_sha256"]):
        kept = [r for r in of if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]


def test_names_stay_exact_under_a_weak_key(spark):
    """The first two salts give a key that different blocks share; the third does not."""
    salts = []

    def weak(block, salt):
        salts.append(salt)
        return naming.block_key(block, salt) if salt > 1 else [F.crc32(block) % (3 + salt), F.lit(0).cast("long")]

    data = [(k, t) for k, t in enumerate(COPIES)]
    got = rows(naming.copies(spark.createDataFrame(data, "doc_id long, text string"), ["doc_id"], block=2, key=weak))
    assert max(salts) == 2
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(i, max(j for j, u in data if (u or "") == (t or ""))) for i, t in data}


def test_copies_of_rows_without_ids_and_of_nothing(spark):
    got = rows(naming.copies(spark.createDataFrame([(None, "a b")] * 3 + [(None, "c")], "doc_id long, text string"), ["doc_id"]))
    assert sorted((r["group_size"], r["kept"], r["keep_id"]) for r in got) == [
        (1, True, None), (3, False, None), (3, False, None), (3, True, None)]
    assert rows(naming.copies(spark.createDataFrame([], SCHEMA), ["doc_id"])) == []


def test_a_hot_text_is_named_once(spark):
    """A third of the rows share a text; its blocks reach the naming once per input partition."""
    data = [(k, "same line\n" * 300 if k % 3 == 0 else f"own {k}") for k in range(900)]
    got = rows(naming.copies(spark.createDataFrame(data, "doc_id long, text string"), ["doc_id"], block=64))
    assert Counter(r["group_size"] for r in got) == {300: 300, 1: 600}
    assert [r["doc_id"] for r in got if r["kept"] and r["group_size"] == 300] == [897]


def mined_plainly(data, least, share, top):
    total, f = Counter(), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for size in range(1, 6):
                for i in range(len(ws) - size + 1):
                    f[lang, tuple(ws[i:i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, ws), a in candidates.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                covered[lang, ws[i:i + size]] = max(a, covered[lang, ws[i:i + size]])
    found = defaultdict(list)
    for (lang, ws), a in candidates.items():
        if 100 * covered[lang, ws] < share * a:
            n = total[lang]
            score, k = min((1000 * a * n // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            found[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]], n))
    return {(lang, rank, p.decode(), -a, left, right, n, -s) for lang, of in found.items()
            for rank, (s, a, p, left, right, n) in enumerate(sorted(of)[:top], 1)}


def spoken(seed, n):
    rng = random.Random(seed)
    words = ["a", "Is", "the", "é", "日本", "x" * 9, "y" * 80, "y" * 79 + "z", "\x1c", "p-q", "#", "longer"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\x0b ", "!"]
    weight = [9, 6, 9, 5, 3, 3, 2, 2, 1, 2, 1, 1]
    out = [(None, "en"), ("", None), ("...", "en"), ("the is a " * 40, "en"), ("the is a " * 40, "en"), ("A IS THE", None)]
    for _ in range(n):
        text = "".join(rng.choices(words, weight)[0] + rng.choices(marks, [20, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(40)))
        out.append((text, rng.choice(["en", "de", None, "und", ""])))
    return out


@pytest.mark.parametrize("least, share, top", [(3, 100, 2000), (5, 80, 7), (1, 100, 50)])
def test_phrases_against_plain_counts(spark, least, share, top):
    data = spoken(3, 250)
    docs = spark.createDataFrame([(t, x, 1, "w") for t, x in data], "text string, lang string, n int, word string").repartition(3)
    got = collocations.mined(docs, least, share, top).collect()
    assert {tuple(r) for r in got} == mined_plainly(data, least, share, top) and len(got) > 10
    assert collocations.mined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_full_trie_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    whole, want, runs = collocations.HatTrie(4, burst=5, room=200), Counter(), []
    for _ in range(40):
        keys = rng.integers(1, [4, 6, 9, 30], (60, 4)).astype(np.uint64) << np.uint64(57)
        keys, n = collocations.grouped_rows(keys[np.lexsort(keys.T[::-1])], np.ones(60, np.int64))
        want.update({tuple(k): int(c) for k, c in zip(keys.tolist(), n)})
        whole.add(keys, n)
        assert whole.entries == sum(map(whole.size, whole.root))
        runs += whole.spill()
        assert whole.entries <= whole.room
    assert whole.split and len(runs) > 3
    got = Counter()
    for keys, n in [*runs, *whole.rest()]:
        assert [tuple(k) for k in keys.tolist()] == sorted(map(tuple, keys.tolist()))
        got.update({tuple(k): int(c) for k, c in zip(keys.tolist(), n)})
    assert got == want and whole.entries == 0 and not list(whole.rest())


@pytest.mark.parametrize("step", [1, 7, 100, 1 << 21])
def test_words_and_windows_over_block_ends(monkeypatch, step):
    monkeypatch.setattr(collocations, "STEP", step)
    data = spoken(4, 60)
    texts, langs = pa.array([t for t, _ in data], pa.string()), [x or "und" for _, x in data]
    read = list(collocations.read_words(texts, langs, 0))
    words = [(int(r), part[s:s + n].tobytes()) for _, _, starts, lengths, part, row in read for s, n, r in zip(starts, lengths, row)]
    want, spans = [], []
    for k, (t, _) in enumerate(data):
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (t or "").encode().translate(bytes(collocations.LOWER))):
            spans.append([(k, w) for w in re.findall(rb"[^\x20\x09]+", piece)])
            want += spans[-1]
    assert words == want
    name = {(langs[r], w): int(i) for (r, w), i in zip(words, (i for block in read for i in block[0]))}
    assert len(set(name.values())) == len(name)
    got = Counter()
    for keys, n in collocations.windows(iter(read), 5, lambda a, b: np.ones(len(a), bool)):
        got.update({tuple(k): int(c) for k, c in zip(keys.tolist(), n)})
    plain = Counter()
    for of in spans:
        ids = [name[langs[r], w] for r, w in of]
        plain.update(tuple((ids[i:i + 5] + [0] * 5)[:5]) for i in range(len(ids) - 1))
    assert got == plain


def test_a_seed_that_names_two_words_alike_is_left(spark, monkeypatch):
    ids = collocations.with_ids

    def shared(words, seed):
        made = ids(words, seed)
        return made.withColumn("id", F.lit(7).cast("long")) if seed < 2 else made

    monkeypatch.setattr(collocations, "with_ids", shared)
    docs = spark.createDataFrame([("a b a b a b", "en")], "text string, lang string")
    words, seed = collocations.words_and_seed(docs, 2)
    assert seed == 2 and words.count() == 2


def test_scores_pass_64_bits(spark):
    a, n, left, right = 10 ** 12 + 7, 10 ** 13 + 9, 3 * 10 ** 12 + 1, 2 * 10 ** 12 + 3
    df = spark.createDataFrame([(a, n, left, right), (100, 1, 100, 100)], "a long, n long, l long, r long")
    assert [r[0] for r in df.select(F.expr(collocations.SCORE)).collect()] == [1000 * a * n // (left * right), 10]
