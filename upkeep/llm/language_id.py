"""Language identification with a bidirectional gated recurrent network over bytes.

The sequence is a word (white-space separated, cut into pieces of ``PIECE``
bytes): one network reads its bytes forwards, one backwards, and both states label
every byte with language probabilities. A document's probabilities are the mean
over all its bytes; the most probable language wins. State does not cross words:
that makes the labels of a word the same wherever it stands, so a worker keeps
them in a bounded memo and the cost follows the distinct words of a text.

Training (numpy, back-propagation through time, Adam) takes ``PER_LANGUAGE``
documents of each language on average, chosen by the hash of the id, and from each
the ``WORDS`` distinct words of the smallest hashes, wherever they stand. Held-out
documents (crc32 of the id as text, modulo 4, is 2) never take part. Prediction
sees the text alone.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or if
there was no document to learn from; repeated rows are judged one by one; a null id
counts as the empty text for the hold-out; an empty table gives no rows; other
columns do not matter. Of equally probable languages the first by name wins.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns
from upkeep.llm.words import runs

PIECE = 32
PER_LANGUAGE = 600
WORDS = 48
MAX_LANGUAGES = 200
HIDDEN = 16
EPOCHS = 3
BATCH = 256
MEMO_WORDS = 200_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction: gates z, r and candidate n from the byte and the last state."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.p = {
            "x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden)).astype(np.float32),
        }

    def run(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (length, batch, hidden) for bytes (length, batch)."""
        h2, u = 2 * self.h, self.p["u"]
        state = np.zeros((data.shape[1], self.h), np.float32)
        states, trace = np.empty((*data.shape, self.h), np.float32), []
        for t in range(len(data)):
            x = self.p["x"][data[t]]
            gates = _sigmoid(x[:, :h2] + state @ u[:, :h2])
            z, r = gates[:, :self.h], gates[:, self.h:]
            n = np.tanh(x[:, h2:] + (r * state) @ u[:, h2:])
            if keep:
                trace.append((state, z, r, n))
            state = n + z * (state - n)
            states[t] = state
        return states, trace

    def back(self, data: np.ndarray, trace: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by back-propagation through time."""
        h, h2, u = self.h, 2 * self.h, self.p["u"]
        g_in = np.empty((*data.shape, 3 * h), np.float32)
        g_u = np.zeros_like(u)
        d = np.zeros_like(trace[0][0])
        for t in range(len(data) - 1, -1, -1):
            before, z, r, n = trace[t]
            d = d + d_states[t]
            d_n = d * (1 - z) * (1 - n * n)
            d_rs = d_n @ u[:, h2:].T
            d_gates = np.concatenate([d * (before - n) * z * (1 - z), d_rs * before * r * (1 - r)], axis=1)
            g_u[:, :h2] += before.T @ d_gates
            g_u[:, h2:] += (r * before).T @ d_n
            g_in[t, :, :h2], g_in[t, :, h2:] = d_gates, d_n
            d = d * z + d_rs * r + d_gates @ u[:, :h2].T
        flat, rows = data.ravel(), g_in.reshape(-1, 3 * h)
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        g_x = np.zeros_like(self.p["x"])
        g_x[used] = np.add.reduceat(rows[order], first, axis=0)
        return {"x": g_x, "u": g_u}


class ByteTagger:
    """Both directions and the labels of every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Gru(rng, hidden), Gru(rng, hidden)
        self.out = {"w": rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def labels(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probabilities (length, batch, languages) for bytes (length, batch)."""
        one, trace_one = self.ahead.run(data, keep)
        two, trace_two = self.behind.run(data[::-1], keep)
        both = np.concatenate([one, two[::-1]], axis=2)
        scores = both @ self.out["w"] + self.out["b"]
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True), (both, trace_one, trace_two)

    def gradients(self, data: np.ndarray, target: np.ndarray) -> list[dict[str, np.ndarray]]:
        probabilities, (both, one, two) = self.labels(data, keep=True)
        d = probabilities
        d[:, np.arange(len(target)), target] -= 1
        d /= data.size
        flat = d.reshape(-1, d.shape[2])
        out = {"w": both.reshape(len(flat), -1).T @ flat, "b": flat.sum(axis=0)}
        d_both = d @ self.out["w"].T
        h = self.ahead.h
        return [self.ahead.back(data, one, d_both[:, :, :h]), self.behind.back(data[::-1], two, d_both[::-1, :, h:]), out]


def train(words: list[bytes], target: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> ByteTagger:
    """Adam over batches of words of one length."""
    tagger = ByteTagger(languages, seed=seed)
    rng = np.random.default_rng(seed)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    parts = [tagger.ahead.p, tagger.behind.p, tagger.out]
    moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()} for p in parts]
    step = 0
    total = epochs * sum(-(-len(v) // BATCH) for v in by_length.values())
    for _ in range(epochs):
        batches = []
        for rows in by_length.values():
            rows = rng.permutation(rows)
            batches += [rows[i:i + BATCH] for i in range(0, len(rows), BATCH)]
        for k in rng.permutation(len(batches)):
            data = np.array([list(words[i]) for i in batches[k]], np.uint8).T
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for own, grads, moment in zip(parts, tagger.gradients(data, target[batches[k]]), moments, strict=True):
                for name, g in grads.items():
                    m, v = moment[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    own[name] -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return tagger


class WordLabels:
    """Summed byte probabilities of words, kept by word."""

    def __init__(self, tagger: ByteTagger):
        self.tagger = tagger
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((4096, len(self.tagger.languages) + 1))

    def learn(self, words: set[bytes]) -> None:
        if len(self.row) + len(words) > MEMO_WORDS:
            self.clear()
        fresh = list(words.difference(self.row))
        first = len(self.row)
        while first + len(fresh) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        own = np.zeros((len(fresh), self.sums.shape[1]))
        pieces = [(w[j:j + PIECE], i) for i, w in enumerate(fresh) for j in range(0, len(w), PIECE)]
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        for piece in pieces:
            by_length.setdefault(len(piece[0]), []).append(piece)
        for length, group in by_length.items():
            for k in range(0, len(group), 8192):
                part = group[k:k + 8192]
                data = np.frombuffer(b"".join([p for p, _ in part]), np.uint8).reshape(-1, length).T
                found = self.tagger.labels(data)[0].sum(axis=0)
                np.add.at(own, [i for _, i in part], np.column_stack([found, np.full(len(part), length)]))
        self.sums[first:first + len(fresh)] = own
        self.row.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def text(self, words: list[bytes]) -> np.ndarray:
        """Mean label probabilities over a text's bytes."""
        total = self.sums[[self.row[w] for w in words]].sum(axis=0)
        return total[:-1] / total[-1]


_kept: dict[str, WordLabels] = {}


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def training_words(docs: DataFrame) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Words, their language numbers and the languages, from (doc_id, text, lang)."""
    usable = docs.where(~_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return [], np.zeros(0, np.int64), []
    languages = [r["lang"] for r in counts]
    share = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, PER_LANGUAGE / r["count"])))), F.col("lang"))
    chosen = usable.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi, block in runs(batch.column(1)):
                for i in range(hi - lo):
                    pieces = {w[j:j + PIECE] for w in block.strings(i) for j in range(0, len(w), PIECE)}
                    found.append(sorted(pieces, key=lambda w: (zlib.crc32(w), w))[:WORDS])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["lang", "words"])

    rows = chosen.select("lang", "text").mapInArrow(run, "lang string, words array<binary>").collect()
    number = {name: k for k, name in enumerate(languages)}
    pairs = sorted((bytes(w), number[r["lang"]]) for r in rows for w in r["words"])  # in an order of their own
    return [w for w, _ in pairs], np.array([k for _, k in pairs], np.int64), languages


def identify(docs: DataFrame, tagger: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and probabilities (language -> mean probability)."""
    check_columns(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    key = uuid.uuid4().hex  # a worker that outlives this call must not use its memo for another model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _kept:
            _kept.clear()
            _kept[key] = WordLabels(shared.value) if shared.value is not None else None
        labels = _kept[key]
        for batch in batches:
            for lo, hi, block in runs(batch.column(1)):
                texts = [block.strings(i) for i in range(hi - lo)]
                if labels is not None:
                    labels.learn({w for words in texts for w in words})
                languages, scores, each = [], [], []
                for i, words in enumerate(texts):
                    text = batch.column(1)[lo + i].as_py() or ""
                    if labels is None or not any(map(str.isalpha, text)):
                        languages.append("und")
                        scores.append(0.0)
                        each.append([])
                        continue
                    mean = labels.text(words)
                    best = int(mean.argmax())
                    languages.append(labels.tagger.languages[best])
                    scores.append(min(1.0, float(mean[best])))
                    each.append(list(zip(labels.tagger.languages, mean.tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(each, pa.map_(pa.string(), pa.float64()))],
                                                 ["doc_id", "lang_pred", "score", "probabilities"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = found.mapInArrow(run, "doc_id long, lang_pred string, score double, probabilities map<string,double>")
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "probabilities")


def language_id(docs: DataFrame) -> DataFrame:
    """Train on (doc_id, text, lang) and identify every document."""
    check_columns(docs, "doc_id", "text", "lang")
    words, target, languages = training_words(docs.select("doc_id", "text", "lang"))
    return identify(docs, train(words, target, languages) if words else None)
