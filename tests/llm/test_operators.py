"""The ten operators against brute force, exact round trips and held-out accuracy, odd rows included."""

import hashlib
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketval.llm import bpe, chat, embeddings, feistel, language, mixing, quality, simhash, sketch, substrings
from marketval.llm.common import components, table
from marketval.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "b", 0), (2, "", None, None, 0), (3, "one two", "en", "b", 7), (4, "one two", "en", "a", 7),
       (4, "one two", "en", "a", 7), (None, "A line.\nÜber b\x1fc", "de", "b", 5), (6, "w " * 3000 + "end", "en", "c", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def unions(n, pairs):
    low = list(range(n))
    for i, j in pairs:
        a, b = min(low[i], low[j]), max(low[i], low[j])
        low = [a if x == b else x for x in low]
    return low


def test_components_equal_a_plain_union(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 360)]
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(pairs, "a long, b long")))}
    low = unions(400, pairs)
    assert got == {n: low[n] for p in pairs if p[0] != p[1] for n in p}


def near(rng, f, n):
    for b in rng.choice(64, n, replace=False):
        f ^= 1 << int(b)
    return f


def test_pigeonhole_finds_every_pair(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    found = sorted({near(rng, f, k) for f in base for k in (0, 1, 2, 3, 4)} | {near(rng, base[0], k % 4) for k in range(60)})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in found]
    got = {(r["a"], r["b"]) for r in rows(simhash.links(spark.createDataFrame([(x,) for x in signed], "bits long")).distinct())}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_simhash_rows(spark, docs):
    plain = rows(simhash.grouped(odd(spark), ["doc_id"]))
    assert len(plain) == len(ODD) and {r["fingerprint"] for r in plain if r["doc_id"] in (1, 2)} == {"0" * 16}
    assert {r["component_id"] for r in plain if r["doc_id"] in (3, 4)} == {3}
    assert rows(simhash.grouped(empty(spark), ["doc_id"])) == []
    kept = simhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 1, 3, 6]


def test_sketch_against_sets(spark):
    small = spark.createDataFrame([r[:2] for r in ODD if r[0] != 4] + [(9, "A b. C d.\nE f."), (8, "A b. X y.\nE f."), (700, "z")], "doc_id long, text string")
    order = sorted(((r["doc_id"], r["text"] or "") for r in rows(small)), key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in rows(sketch.likenesses(small))}

    def paragraphs(t):
        return {p.strip(" ") for p in re.split(sketch.PARAGRAPH, t) if p.strip(" ")}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_next"] == pytest.approx(like(paragraphs(t), paragraphs(after)))
        assert got[i]["near_edited"] == pytest.approx(like(paragraphs(t), paragraphs(edited)))
    assert rows(sketch.likenesses(empty(spark))) == []


def test_sketch_of_repeated_rows_over_block_ends(spark):
    """Repeated rows follow each other, blocks of ids of one row meet, clashing columns are not read."""
    ids = [5, 5, 300, 900, None]
    data = [(i, f"A {i or 0}. Both.", "x", True, 1) for i in ids]
    got = rows(sketch.likenesses(spark.createDataFrame(data, "doc_id long, text string, block string, first boolean, id int")))
    like = sorted((r["doc_id"] or 0, round(r["near_next"], 6)) for r in got)
    assert like == [(0, 0.333333), (5, 0.333333), (5, 1.0), (300, 0.333333), (900, 0.333333)]
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 5}) == 1


def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    own = bpe.WordBpe(bpe.vocabulary())
    odd_texts = ["", "HELLO  it's 'RE", "ΑΣ Σ", "İ", "a<|endoftext|>b <|startoftext|>", "é ́x", "a\x1cb\x85c", "x" * 900, "²³ Ⅷ 4५"]
    for t in [*odd_texts, *texts(docs).values()]:
        want = library.encode(t, add_special_tokens=False)
        n, ids, tokens = own.encode(t)
        assert (n, ids) == (len(want.ids), " ".join(map(str, want.ids)))
        assert tokens == library.decode(want.ids, skip_special_tokens=False) == own.decode(want.ids)
    made = rows(bpe.encoded(odd(spark), bpe.vocabulary(), ["doc_id", "size"], with_ids=True))
    assert len(made) == len(ODD) and all(r["ids_sha256"] == sha(" ".join(map(str, r["ids"]))) for r in made)
    assert rows(bpe.encoded(empty(spark), bpe.vocabulary(), ["doc_id"])) == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_token_query_equals_the_library_on_every_row(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    want = {}
    for i, t in texts(docs).items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    got = rows(QUERIES["op3_rank_array_bpe"](spark, FOLDER))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


@pytest.mark.parametrize("generation, part", [(1, 1), (40, 10), (3000, 500)])
def test_words_that_leave_are_encoded_again(docs, monkeypatch, generation, part):
    """The two generations stay bounded, and ids do not depend on what is remembered."""
    monkeypatch.setattr(bpe, "GENERATION", generation)
    monkeypatch.setattr(bpe, "PART", part)
    some = [*list(texts(docs).values())[:30], "a <|endoftext|> a<|startoftext|>", "", "x" * 200] * 2
    own = bpe.WordBpe(bpe.vocabulary())
    fresh = [bpe.WordBpe.encode_batch(own, [t])[0] for t in some]
    most = max(len({*own.split(t)}) for t in some)
    assert own.encode_batch(some) == fresh and len(own.young) + len(own.old) <= 2 * (generation + part + most)


def test_special_strings_of_any_form(docs):
    """A file may name other special strings; they are looked up by its own list."""
    import json

    spec = json.loads(bpe.vocabulary())
    spec["added_tokens"][0]["content"] = "[start]"
    own = bpe.WordBpe(json.dumps(spec))
    assert own.encode_batch(["a[start] b[START]"])[0][1] == spec["added_tokens"][0]["id"]
    assert own.encode_batch(["a[start]"])[0].count(spec["added_tokens"][0]["id"]) == 1


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_against_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    v = np.concatenate([centres, centres[:20] + 0.02 * rng.standard_normal((20, 24)), np.repeat(centres[:1], 30, 0) + 0.01 * rng.standard_normal((30, 24)),
                        centres[:3]])
    label = [int(k) % 2 for k in range(len(v))]
    data = [(k, x.tolist(), c) for k, (x, c) in enumerate(zip(v, label))]
    data += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] * 24, 1), (203, [1.0, None], 1), (204, v[0].tolist(), None)]
    got = {r["vec_id"]: r for r in rows(embeddings.linked(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), block=block))}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if label[i] == label[j] and unit[i] @ unit[j] >= 0.98]
    low = unions(len(v), pairs)
    for i in range(len(v)):
        assert got[i]["n_links"] == sum(i in p for p in pairs) and got[i]["component_id"] == low[i] and got[i]["kept"] == (low[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 205))


def test_no_close_pair_is_lost_in_a_large_label(spark):
    """A window far below one stands for a label so large that runs share all bits of the strings."""
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, 400, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y *= np.sqrt(1 - 0.9805 ** 2) / np.linalg.norm(y, axis=1)[:, None]
    v = np.concatenate([x, 0.9805 * x + y])
    data = [(k, z.tolist(), int(k % 400 < 3)) for k, z in enumerate(v)]
    got = rows(embeddings.linked(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), window=2.0 ** -20))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(k, 1, k % 400) for k in range(800)]


def test_passes_hold_the_chance_of_a_miss():
    share = 1 - np.arccos(0.98) / np.pi
    for size in (1, 64, 100, 10 ** 4, 10 ** 6, 34 * 10 ** 6, 10 ** 9, 10 ** 14):
        t = embeddings.bits(size, 64)
        assert (1 - share ** t) ** embeddings.passes(t) <= 1e-6
    assert [embeddings.passes(embeddings.bits(64 << t, 64)) for t in (0, 1, 10, 14, 24, 30)] == [1, 20, 20, 28, 60, 93]
    assert embeddings.bits(10 ** 9, 64, -1.0) == 0


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = rows(QUERIES["op5_quadratic_quality"](spark, folder).join(table(spark, folder, "labels"), "doc_id"))
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rows(quality.scored(odd(spark), labels, ["doc_id"]))} == {0.5}
    assert quality.accepted(odd(spark), labels).columns == odd(spark).columns


def test_mix_meets_targets(spark, docs):
    got = rows(mixing.mix(docs, ["doc_id", "source"]))
    want = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for i, t in texts(docs).items()}
    assert {r["doc_id"]: r["size"] for r in got} == want
    for _, of in groupby(sorted(got, key=lambda r: r["source"]), lambda r: r["source"]):
        of = list(of)
        assert of[0]["source_size"] == sum(r["size"] for r in of) and of[0]["target"] <= 2 * of[0]["source_size"]
        sums, budget = {0}, int(of[0]["target"] - of[0]["target"] // of[0]["source_size"] * of[0]["source_size"])
        for r in of:
            sums |= {s + r["size"] for s in sums}
        assert sum(r["taken"] for r in of) % of[0]["source_size"] == max(s for s in sums if s <= budget) % of[0]["source_size"]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in of)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(want.values()))
    assert len(rows(mixing.mix(odd(spark), ["doc_id", "source"]))) == len(ODD) and rows(mixing.mix(empty(spark), ["doc_id", "source"])) == []
    assert mixing.mixture(odd(spark)).columns == odd(spark).columns


def test_subset_sums_are_the_best_there_are():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = sorted({int(x) for x in rng.integers(1, 40, 5)}, reverse=True)
        counts, sums = [int(x) for x in rng.integers(1, 4, len(lengths))], {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, max(sums) + 5))
        taken = mixing.fit(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(taken, counts))
        assert sum(n * k for n, k in zip(lengths, taken)) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("lengths, budget, best", [
    ([50000, 40000, 30000], 72000, 70000), ([20000, 15000, 14000, 3000], 29500, 29000), ([9000, 7000, 6000], 13500, 13000)])
def test_subset_sums_of_long_documents(lengths, budget, best):
    taken = mixing.fit(lengths, [1] * len(lengths), budget)
    assert max(taken) <= 1 and sum(n * k for n, k in zip(lengths, taken)) == best


def test_subset_sums_beyond_the_window_are_the_best_there_are():
    rng = np.random.default_rng(8)
    for most in (3000, 20_000, 100_000):
        for _ in range(30):
            lengths = sorted({int(x) for x in rng.integers(most // 4, most, 5)}, reverse=True)
            counts, sums = [int(x) for x in rng.integers(1, 4, len(lengths))], {0}
            for n, c in zip(lengths, counts):
                sums = {s + n * k for s in sums for k in range(c + 1)}
            budget = int(rng.integers(0, max(sums) + 5))
            taken = mixing.fit(lengths, counts, budget)
            assert all(0 <= k <= c for k, c in zip(taken, counts))
            assert sum(n * k for n, k in zip(lengths, taken)) == max(s for s in sums if s <= budget)


def test_language_on_held_out_rows(spark, docs):
    got = rows(QUERIES["op7_word_first_language"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id"))
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    plain = {r["doc_id"]: r for r in rows(language.identified(odd(spark), language.train(docs), ["doc_id"]))}
    assert plain[1]["lang_pred"] == plain[2]["lang_pred"] == "und" and plain[3]["lang_pred"] in ("en", "de", "fr", "es")
    assert rows(language.identified(odd(spark), language.train(empty(spark)), ["doc_id"]))[0]["lang_pred"] == "und"


def test_chat_round_trip_and_windows(spark):
    odd_texts = ["\\### </turn> ok", "\\", "<says>\n</turn>\n", "<turn>\\n", None, "w " * 400, ""]
    data = [(5, k, "system" if k == 0 else ("user", "assistant", None)[k % 3], odd_texts[k % len(odd_texts)]) for k in range(40)]
    data += [(None, 1, "assistant", "a"), (6, 1, "user", "b"), (6, 1, "user", "b")]
    made = chat.windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    back = sorted((r for r in rows(chat.read_back(made)) if r["conv_id"] == 5), key=lambda r: r["window"])
    assert len(back) > 3 and all(r["formatted"].count("w ") < 400 * 4 for r in rows(made))
    turns = [(t["role"], t["text"]) for r in back for t in r["turns"]]
    assert turns == [(r or "", t or "") for c, _, r, t in data if c == 5]
    assert [x for r in back for x in r["learned"]] == [t or "" for c, _, r, t in data if c == 5 and r == "assistant"]


def covered(docs, length=substrings.LENGTH):
    seen, out = {}, {}
    for i, t in sorted(docs.items()):
        b, mark = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p:p + length], i) < i:
                mark[p:p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[i] = (len(b), len(b) - len(kept), sum(1 for k, _ in groupby(mark) if k), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_all_strings(spark, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(substrings.repeats(docs, ["doc_id"]))}
    assert got == covered(texts(docs))
    assert len(rows(substrings.repeats(odd(spark), ["doc_id", "size"], texts=True))) == len(ODD)
    assert rows(substrings.repeats(empty(spark), ["doc_id"])) == []


def test_runs_leave_out_empty_documents():
    cut = substrings.runs_by_document(np.array([0]), np.array([160]), np.array([80, 80, 160]))
    assert [(a, b, f.tolist(), l.tolist()) for a, b, f, l in cut] == [(0, 80, [0], [80]), (80, 80, [], []), (80, 160, [80], [160])]


def test_repeats_with_empty_texts_between_copies(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST", 1)  # all in one group, in the order of the ids
    copy = "".join(map(chr, np.random.default_rng(9).integers(97, 123, 80)))
    data = [(1, copy), (2, copy), (3, ""), (4, copy), (5, None), (6, copy), (7, "x" + copy[:60]), (8, ""), (9, copy[5:70] + "y")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in rows(substrings.repeats(spark.createDataFrame(data, "doc_id long, text string"), ["doc_id"]))}
    assert got == covered({i: t or "" for i, t in data}) and got[3][1:3] == got[5][1:3] == (0, 0)


def test_long_documents_are_hashed_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([3000, 3040, 5000])

    def starts():
        p = substrings.phrases(data, ends)
        return sorted(s for a, b in zip(p["first"], p["last"]) for s in range(a, b + 1))

    whole = starts()
    monkeypatch.setattr(substrings, "STEP", 700)
    assert starts() == whole == [*range(2951), *range(3040, 4951)]


@pytest.mark.parametrize("n", [1, 2, 3, 39, 40, 41, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = rows(spark.range(n).select("id", feistel.permuted(F.col("id"), n).alias("p")).select("*", feistel.original(F.col("p"), n).alias("back")))
    assert sorted(r["p"] for r in got) == list(range(n)) and all(r["back"] == r["id"] for r in got)


def test_shards(spark):
    got = rows(QUERIES["op10_feistel_shards"](spark, FOLDER))
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(40)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert len(rows(feistel.shard(odd(spark).select("doc_id"), ["doc_id"]))) == len(ODD)
    assert rows(feistel.shard(empty(spark).select("doc_id"), ["doc_id"])) == []


def test_pipeline_keeps_columns_and_clean_rows(spark):
    import corpus_pipeline

    sources = odd(spark).drop("row").withColumn("kept", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (sources, empty(spark)):
            out = stage(spark, given, FOLDER)
            assert out.columns == given.columns, name
            assert (out.count() == 0) == (given.count() == 0) or name == "quality classifier"
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
