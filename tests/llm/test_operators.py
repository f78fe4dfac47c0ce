"""Operators of the training-data subpackage against brute force, on a small
table of hard cases: nulls, empty and long texts, repeated rows, ties, null and
repeated ids, further columns with clashing names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from upkeep.llm import (components, decontaminate, language_id, lm_score, near_duplicates, quality, sentencepiece_bpe, substring_dedup, token_files, topk,
                        url_filter)

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

LONG = " ".join(f"w{i % 977}" for i in range(5000))
BASE = " ".join(f"b{i}" for i in range(120))
NEAR = BASE.replace("b60", "changed")
TEXTS = [
    (1, BASE), (2, NEAR), (3, BASE), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "One Two three"), (9, "one two three"), (10, LONG), (11, LONG + " tail"),
    (12, "Ünï cödé ▁ text\x00 <|endoftext|> </s> 日本 é́ 😀"), (13, "   lead  and   trail   "), (14, " ".join(["same"] * 60)), (15, "x " + BASE[:200]),
    (16, "x " * 300), (17, "1234 5678"), (18, " ".join(f"q{i}" for i in range(30)) + " " + " ".join(f"b{i}" for i in range(20, 70))),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "src", "clash", "clash", i) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string, hits string, uid int").repartition(3).cache()


def words_of(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130))


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(sentencepiece_bpe.encode_documents(docs, PIECES, with_ids=True))
    assert len(got) == len(TEXTS)
    for i, text in TEXTS:
        ids = library.encode(text or "", add_eos=True)
        assert (list(got[i]["ids"]), got[i]["n_tokens"], got[i]["decoded"]) == (ids, len(ids), library.decode(ids))
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_sentencepiece_on_random_strings():
    import random

    import sentencepiece

    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_bpe.load(PIECES), random.Random(3)
    parts = ["a", "e", "th", "ing", " ", "   ", "\n", "é", "梦", "😀", "▁", "<0x0A>", "</s>", "the", "1", "́", "\0", "tion", " " * 17]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(WORDS), 0
    got = by_id(token_files.token_table(docs, WORDS))
    for i, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    odd = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (2, None)], "doc_id long, text string")
    assert sorted((r["start"], r["doc_id"]) for r in token_files.token_table(odd, WORDS).collect()) == [(0, None), (2, 2), (3, 3), (5, 3)]


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = words_of(text, lower=True)
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            label[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, size):
    import random

    rng, rows = random.Random(size), list(TEXTS)
    for k in range(60):  # near copies around the limit, some joined only through others
        w = BASE.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(near_duplicates.near_duplicates(df, size=size))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, size, 80)
    kept = near_duplicates.deduplicated(df, size=size)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])


@pytest.mark.parametrize(("with_base", "deal"), [(True, 2000), (False, 2000), (True, 20)])
def test_near_copies_not_linked_to_a_hub_equal_brute_force(spark, monkeypatch, with_base, deal):
    """With one task for all of a hub's classes, and with eleven."""
    import random

    monkeypatch.setattr(near_duplicates, "DEAL", deal)
    rng, base = random.Random(7), [f"g{i}" for i in range(150)]
    rows = [(0, " ".join(base))] if with_base else []
    for k in range(1, 220):  # one to fourteen changes, a third of them shared by some; some cut short
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            at = rng.randrange(len(w))
            w[at] = f"z{at // 40}" if rng.random() < 0.3 else f"z{rng.random()}"
        rows.append((k, " ".join(w[:rng.choice([150, 150, 150, 140, 125])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(near_duplicates.near_duplicates(df))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, 4, 80)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "z"), (2, "a b c d e")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df).collect()}
    assert got == {None: None, 1: 1, 2: 1}
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def brute_substrings(rows, length):
    first, out = {}, {}
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            first[key] = min(first.get(key, i), i)
    for i, text in rows:
        w = words_of(text)
        gone = {k + j for k in range(len(w) - length + 1) if first[tuple(w[k:k + length])] < i for j in range(length)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("length", "shard"), [(13, 100_000), (40, 100_000), (13, 150)])
def test_substrings_equal_brute_force(spark, docs, monkeypatch, length, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    got = {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in by_id(substring_dedup.substring_dedup(docs, length)).items()}
    assert got == brute_substrings(TEXTS, length)
    left = substring_dedup.without_repeats(docs, length)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, (n, gone, _) in got.items() if gone < n or not n}


def test_substrings_with_null_and_repeated_ids(spark):
    text = " ".join(f"k{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20)]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_suffix_automaton_statistics():
    import random

    rng = random.Random(5)
    automaton, seen = substring_dedup.SuffixAutomaton(), []
    for _ in range(30):
        s = [rng.choice("ab") for _ in range(rng.randint(0, 12))]
        parts = {tuple(x[i:j]) for x in seen for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max([n for n in range(1, k + 2) if tuple(s[k + 1 - n:k + 1]) in parts], default=0) for k in range(len(s))]
        assert automaton.statistics(s) == want
        automaton.add(s)
        seen.append(s)


@pytest.mark.parametrize("bound", [decontaminate.MAX_SET, 0])
def test_decontamination_equals_brute_force(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_SET", bound)
    items = [(1, " ".join(f"B{i}" for i in range(30, 55))), (2, "ONE, two"), (3, None), (4, "it's \\ 'x'"), (10, "one two"), (None, "w1 w2 w3")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    letters = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = [(i, tuple(w[k:k + min(10, len(w))])) for i, t in items for w in [letters.findall((t or "").translate(LOWER))] if w for k in range(len(w) - min(10, len(w)) + 1)]
    got = by_id(decontaminate.report(docs, benchmark))
    for i, text in TEXTS:
        w = letters.findall((text or "").translate(LOWER))
        hits = [(k, len(x), item) for item, x in windows for k in range(len(w) - len(x) + 1) if tuple(w[k:k + len(x)]) == x]
        ids = sorted({str(item) for *_, item in hits if item is not None})
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len({k + j for k, n, _ in hits for j in range(n)}), len(ids))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest() and got[i]["contaminated"] == bool(hits)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["contaminated"]}
    spans = by_id(decontaminate.decontaminate(docs, benchmark, remove="spans"))
    assert spans[8]["text"] == "three" and spans[13]["text"] == TEXTS[12][1]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(200)] + [(200 + i, [0.1] * 8) for i in range(60)]
    odd = [(300, None), (320, [1.0, None] + [0.0] * 6), (340, [float("nan")] + [0.0] * 7), (360, [float("inf")] + [0.0] * 7), (380, [1.0]), (381, [2.0]), (400, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows + [(380, [1.0]), (381, [2.0])]}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:20])]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_url_rules_and_method(spark):
    urls = ["http://a.ORG/x", "https://example.org/es/1", "http://m.example.org/en/12?q", "http://z.com/fr/", "http://z.com/de/9", "http://notorg/", None, "no scheme",
            "https://www.casino-win.example.com/en/4", "https://library.example.com/en/4", "x://h?p=/org/", "a://b.org", "u://v://w.org/"]
    got = by_id(url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert [got[i]["rule"] for i in range(6)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None]
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 6, 7, 10, 11)] == [("a.org", "/x"), ("", ""), ("", ""), ("h", ""), ("b.org", "")]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 8, 9)] == ["allow", "block", "block", "allow", "block", "block", "allow"]
    assert got[11]["rule"] is None and len(got) == len(urls)


def test_quality_orders_grades(spark):
    import random

    rng, rows, grades = random.Random(2), [], []
    for i in range(600):
        g = i % 3
        w = [f"v{rng.randrange(50)}" for _ in range(30)] + (["awful"] if g == 0 else [x + "%%%" for x in "abcdefgh"] if g == 1 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        grades.append((i, 1 if g else 0, int(g == 0)) if g != 1 else (i, 0, 0))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.grades_of(labels))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = by_id(quality.judge(docs, model))
    right = sum(got[i]["kept"] == (i % 3 == 2) for i in range(600))
    assert right >= 570 and len(got) == 602 and 0 <= got[1000]["p_tail"] <= 1
    empty = quality.train(docs, quality.grades_of(labels.limit(0)))
    assert quality.judge(docs.limit(0), empty).count() == 0
    assert quality.kept_documents(docs, model).columns == docs.columns


def test_language_gradients_and_hard_cases(spark):
    tagger = language_id.ByteTagger(["a", "b"], hidden=3)
    data, target = np.array([[97, 98], [99, 100], [101, 98]], np.uint8), np.array([0, 1])

    def loss():
        p = tagger.labels(data)[0].astype(np.float64)
        return -np.log(p[:, np.arange(2), target]).sum() / data.size

    for own, grads in zip((tagger.ahead.p, tagger.behind.p, tagger.out), tagger.gradients(data, target), strict=True):
        for name, g in grads.items():
            at = np.unravel_index(np.abs(g).argmax(), g.shape)
            was = own[name][at]
            own[name][at] = was + 1e-2
            high = loss()
            own[name][at] = was - 1e-2
            low = loss()
            own[name][at] = was
            assert abs((high - low) / 2e-2 - g[at]) < 2e-3
    rows = [(i, f"{'das ist gut und schön' if i % 2 else 'this is the thing of it'} {i}", "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !", "en"), (902, "x" * 5000, None), (903, "", None)], "doc_id long, text string, lang string")
    got = by_id(language_id.language_id(docs))
    assert [got[i]["lang_pred"] for i in (900, 901, 903)] == ["und"] * 3 and got[900]["score"] == 0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in range(200) if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in held) >= 0.95 * len(held)
    assert set(r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()) == {"und"}


def test_language_model_counts_and_scores(spark, docs):
    got = by_id(lm_score.score_documents(docs))
    tokens = {i: [*words_of(t, lower=True), None] for i, t in TEXTS}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(own), sum(counts[w] > 0 for w in own), total, held[i])
        assert abs(got[i]["base_score"] - base) < 1e-6 * len(own) and -60 * len(own) < got[i]["score"] < 0
    nothing = lm_score.score_documents(docs.limit(0))
    assert nothing.count() == 0


def test_language_model_is_a_distribution(spark):
    words = [f"w{i}".encode() for i in range(3000)]
    v = lm_score.Vocabulary([lm_score.END, *words], list(range(3001, 0, -1)), sum(range(1, 3002)) + 50, 3001 + 40)
    model = lm_score.Model(v)
    state = np.random.default_rng(0).normal(0, 0.5, (1, lm_score.HIDDEN)).astype(np.float32)
    every = np.arange(v.rest + 1)
    found, _ = model.outputs(np.repeat(state, len(every), 0), every, v)
    assert abs(np.exp(found.astype(np.float64)).sum() - 1) < 1e-3


def test_language_model_learns_inside_the_classes_of_all_listed_words():
    words = [f"w{i}".encode() for i in range(9000)]
    v = lm_score.Vocabulary([lm_score.END, *words], list(range(9001, 0, -1)), sum(range(1, 9002)) + 50, 9001 + 40)
    model, rng = lm_score.Model(v), np.random.default_rng(0)
    states = rng.normal(0, 0.5, (2, lm_score.HIDDEN)).astype(np.float32)
    pairs = np.array([[r, r + 1] for r in range(1, v.rest - 1, 97) if v.class_of[r] == v.class_of[r + 1]])
    apart = [np.subtract(*(model.outputs(np.repeat(s[None], len(pairs), 0), pairs[:, i], v)[0] for i in (0, 1))) for s in states]
    assert (np.abs(apart[0] - apart[1]) > 1e-5).mean() > 0.99  # the state, not the count alone, tells words of a class apart
    target, gradient = np.array([5, 3000, 7000, 7001, 8999]), np.zeros_like(model.flat)
    many = rng.normal(0, 0.5, (len(target), lm_score.HIDDEN)).astype(np.float32)
    model.outputs(many, target, v, model.views(gradient))
    for i in np.argsort(-np.abs(gradient))[:60]:
        was, ends = model.flat[i], []
        for step in (1e-2, -1e-2):
            model.flat[i] = was + np.float32(step)
            ends.append(-model.outputs(many, target, v)[0].astype(np.float64).sum())
        model.flat[i] = was
        assert abs((ends[0] - ends[1]) / 2e-2 - gradient[i]) < 5e-3


def test_language_model_grows_with_the_input_and_not_with_its_partitions(spark, monkeypatch):
    assert lm_score.list_length(50_000_000) > 10 * lm_score.LISTED and lm_score.list_length(10) == lm_score.LISTED
    assert lm_score.dealt(1) == (1, 1) and lm_score.dealt(100 * lm_score.TASK) == (10, 10) and lm_score.dealt(400 * lm_score.TASK)[0] == 20
    monkeypatch.setattr(lm_score, "TASK", 1500)
    rows = [(i, " ".join(f"w{(i * k) % 50}" for k in range(40))) for i in range(200)]
    one, many = (by_id(lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(n))) for n in (1, 12))
    assert all(abs(one[i]["score"] - many[i]["score"]) < 1e-4 * one[i]["n_tokens"] for i in one)


def test_deduplicated_keeps_distinct_texts_of_repeated_ids(spark):
    other = " ".join(f"o{i}" for i in range(80))
    rows = [(5, None, "x"), (5, BASE, "y"), (9, BASE, "z"), (9, other, "w"), (4, other + " end", "v"), (7, "one two three four five six", "u"),
            (7, "seven eight nine ten eleven twelve", "t"), (7, "one two three four five six", "u"), (None, BASE, "s"), (None, BASE, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(4)
    kept = sorted(r["more"] for r in near_duplicates.deduplicated(df).collect())
    assert kept == ["r", "s", "t", "u", "v", "x", "y"]
    got = near_duplicates.near_duplicates(df)
    assert got.count() == len(rows) and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got.where("doc_id IS NOT NULL").collect()) == [
        (4, 4, True), (5, 5, True), (5, 5, True), (7, 7, False), (7, 7, True), (7, 7, True), (9, 4, False), (9, 5, False)]
