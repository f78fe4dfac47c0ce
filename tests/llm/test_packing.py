"""Packing and token units against the library and plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import TEXTS

from upkeep.llm import packing, unit_ids

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
PARTS = ["a", "B", "é", "é", " ", "  ", "\n", "\t", " ", "　", " ", "\x85", "\x1c", ".", "!", "<", "(", "'s", "'", "\x01", " \x01", "1", "23",
         "<|endoftext|>", "日本", "😀", "\x00", "́", "\r\n", "​", "x" * 90]


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_units_equal_the_library(path):
    random.seed(5)
    texts = [t for _, t in TEXTS] + ["".join(random.choices(PARTS, k=random.randint(0, 30))) for _ in range(3000)] + [" ", "\n\n", "q" * 50_000, None]
    got = []
    for lo, hi, ids, bounds in unit_ids.encoded_blocks(pa.array(texts, pa.string()), path, 1):
        got += [ids[bounds[i]:bounds[i + 1]].tolist() for i in range(hi - lo)]
    assert got == library(path, texts)


def plain_scores(docs, query):
    """BM25 with weights floored at 0, as a plain double loop."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = collections.Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        tf = collections.Counter(d)
        out.append(sum(max(0, math.log((n - df[t] + 0.5) / (df[t] + 0.5))) * tf[t] * (packing.K1 + 1)
                       / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in set(docs[query]) if tf[t]))
    return out


def test_index_scores():
    random.seed(2)
    docs = [[random.choice(range(1, 40)) ** 2 for _ in range(random.randint(0, 30))] for _ in range(25)]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    index = packing.Index(doc, np.array([t for d in docs for t in d], np.uint64), len(docs))
    df = collections.Counter(t for d in docs for t in set(d))
    for q in range(len(docs)):
        want = plain_scores(docs, q)
        alone = sum(max(0, math.log((25 - 0.5) / 1.5)) for t in set(docs[q]) if df[t] == 1)
        got = index.scores(q)
        assert np.allclose(np.delete(got, q), np.delete(want, q)) and (got[q] <= want[q] + 1e-9) and (alone or np.isclose(got[q], want[q]))


def test_windows_take_the_best_unused_neighbours():
    words = [["a", "b", "c"], ["x", "y", "z"], ["a", "b", "c"], ["x", "y", "w"], ["a", "q", "c"], ["n"], ["m"], ["o"]]
    code = {w: i for i, w in enumerate(sorted({w for d in words for w in d}))}
    index = packing.Index(np.repeat(np.arange(8), [len(d) for d in words]), np.array([code[w] for d in words for w in d], np.uint64), 8)
    windows = list(packing.fill(index, np.array([4, 4, 4, 4, 4, 4, 4, 0]), 10))
    assert windows == [[(0, 0, 4), (2, 0, 4), (4, 0, 2)], [(4, 2, 2), (1, 0, 4), (3, 0, 4)], [(5, 0, 4), (6, 0, 4)]]


def test_tail_windows_need_no_padding():
    rows = [{"doc_id": i, "start": 10 * i, "length": n, "doc_tokens": 99, "tail": np.arange(n, dtype="<u4").tobytes()} for i, n in enumerate([5, 7, 1, 9])]
    out = packing.tail_windows(rows, 3, 8)
    sums = collections.Counter()
    for r in out:
        assert r[7] == sums[r[6]]
        sums[r[6]] += r[2]
    assert [sums[k] for k in sorted(sums)] == [8, 8, 4, 2]


def check_pieces(rows, texts, window):
    """Every id of every document in one piece; sequences without gaps or padding."""
    ids = dict(zip([i for i, _ in texts], library(BYTES, [t for _, t in texts]), strict=True))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            cut = ids[i][at:at + r["length"]]
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0
    return sequences


def test_pack_small_table(spark):
    texts = TEXTS + [(None, "a row without an id"), (30, "w " * 30_000)]
    frame = spark.createDataFrame([(i, t, 1, "x", b"y", 2) for i, t in texts], "doc_id long, text string, part int, ids string, tail binary, sequence int").repartition(3)
    rows = packing.pack(frame, BYTES, window=64, shard_tokens=500).collect()
    check_pieces(rows, texts, 64)


def test_pack_repeats_and_nothing(spark):
    rows = packing.pack(spark.createDataFrame([(1, "one two"), (1, "one two"), (1, None)], "doc_id long, text string"), BYTES).collect()
    assert sorted((r["start"], r["length"]) for r in rows if r["doc_tokens"] == 1) == [(0, 1)]
    assert sum(r["length"] for r in rows) == 1 + 2 * rows[0]["doc_tokens"] or sum(r["length"] for r in rows) == 1 + 2 * max(r["doc_tokens"] for r in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).collect() == []


def test_pack_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, BYTES).collect()
    sequences = check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    short = [own for own in sequences.values() if sum(r["length"] for r in own) < 2048]
    assert len(short) <= 11


def test_neighbours_share_words(spark):
    """Documents of the same vocabulary meet in a window more often than by chance."""
    random.seed(3)
    topics = [[f"{c}{random.randint(0, 10 ** 6)}" for _ in range(60)] for c in "abcdefgh"]
    texts = [(i, " ".join(random.choices(topics[i % 8], k=40))) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), BYTES, window=512).collect()
    together = collections.defaultdict(set)
    for r in rows:
        together[r["sequence_id"]].add(r["doc_id"])
    pairs = [(a, b) for own in together.values() for a in own for b in own if a < b]
    assert sum(a % 8 == b % 8 for a, b in pairs) > 0.7 * len(pairs)
