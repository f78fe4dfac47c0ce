"""Filter interaction and source divergence audits against plain versions."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from test_operators import LOWER, TEXTS, WORD

from upkeep.llm import divergence, filter_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(docs, labels):
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
             "E": i is not None and i > firsts[t]}
        fails.append((i, s or "", {k for k, v in f.items() if v}))
    out = {}
    for part in {s for _, s, _ in fails}:
        own = [(i, f) for i, s, f in fails if s == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order):
                gone = [(i, f) for i, f in left if c in f]
                before = sum(c in f for i, f in own) - len(gone)
                left = [(i, f) for i, f in left if c not in f]
                shapley[c] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), before, sum(f == {c} for _, f in own), sum(i in good for i, _ in gone),
                                                        sum(i in toxic for i, _ in gone), c]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_intervals_are_the_orders():
    for mask in range(1, 32):
        seen = {}
        for step, lo, hi in filter_audit.intervals(mask):
            for rank in range(lo, hi):
                assert rank not in seen
                seen[rank] = step
        want = {r: next(k for k, c in enumerate(o) if mask >> "ABCDE".index(c) & 1) for r, o in enumerate(filter_audit.ORDERS)}
        assert seen == want
    assert not list(filter_audit.intervals(0))


def test_filter_audit_brute_force(spark):
    random.seed(4)
    rows = [(i, t, ["s", None, "", "t"][i % 4]) for i, t in TEXTS] + [(None, TEXTS[0][1], "s"), (None, None, "t"), (1, TEXTS[0][1], "s"), (40, TEXTS[0][1], "t")]
    rows += [(50 + i, " ".join(random.choices(["Aa", "b", "C$", "é", "ok"], k=random.randint(30, 70))), "u") for i in range(30)]
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 80, 2)] + [(2, 1, None), (None, 1, 1), (4, None, None)]
    docs = spark.createDataFrame([(*r, 1, b"x", "z") for r in rows], "doc_id long, text string, source string, mask int, digest binary, part string").repartition(4)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == brute_audit(rows, labels) and len(got) == 600 * 4


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(one) == 600 and {(r["removed"], r["filter_order"][r["step"] - 1]) for r in one} == {(0, "B"), (0, "C"), (0, "D"), (0, "E"), (1, "A")}


def brute_divergence(docs, least, top):
    words = [(lang or "", s or "", TERM.findall((t or "").translate(LOWER))) for t, lang, s in docs]
    out = []
    for lang in {x[0] for x in words}:
        own = [(s, w) for x, s, w in words if x == lang]
        df = collections.Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        v = len(kept)
        count = {s: collections.Counter(t for x, w in own if x == s for t in w) for s in {s for s, _ in own}}

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: shares(c) for s, c in count.items()}
        q = shares(sum(count.values(), collections.Counter()))
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(found) if part == "pair" or r < top]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 256])
def test_divergence_brute_force(spark, monkeypatch, block):
    """With one source to a block every comparison is one across blocks."""
    random.seed(6)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 7)
    vocabulary = [f"{a}{b}" for a in ["longer_than8bytes", "longer", "é", "日本", "X"] for b in "abcdefgh"] + ["longerthaneightbytes" + c for c in "abz"]
    docs = [(" ".join(random.choices(vocabulary, k=random.randint(0, 60))), ["en", "de", None][i % 3], f"s{i % 7}") for i in range(120)]
    docs += [(None, None, None), ("", "xx", "alone"), ("Solo solo", "xx", "other"), (TEXTS[9][1], "en", "s1"), ("a" * 70_000, "en", "s2"), ("A-a_a1a", "en", None)]
    frame = spark.createDataFrame([(*d, 1, "t", 2) for d in docs], "text string, lang string, source string, n int, term string, docs int").repartition(5)
    got = divergence.divergence(frame, least_docs=9, top=4)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_divergence(docs, 9, 4)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 64)
    random.seed(7)
    words = [bytes(random.choices(b"ab\xc3", k=random.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(300)]
    words = random.choices(words, k=5000)
    data = np.frombuffer(b" ".join(words), np.uint8)
    at, length = divergence.words_at(data, np.array([0, len(data)]))
    order, first = divergence.sorted_runs(data, at, length)
    assert [words[i] for i in order] == sorted(words) and [words[order[i]] for i in first] == sorted(set(words))
