"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The merge-type model joins, again and again, the adjacent pair whose joined
piece has the best score. The result is found here without merging the text:
an Aho-Corasick automaton over the pieces gives the longest piece starting at
each place; pieces are laid from left to right, longest first, and a piece is
accepted if it and the piece before it are *compatible* (merging their joined
string again gives just these two). A bit field marks places from which no
continuation exists, so backtracking never tries one twice. A sequence whose
neighbours are all compatible is the merge result, and it is unique.

This needs pieces with distinct scores. The runs of the space symbol share
one score in some models; their run is merged directly (``_space_run``). The
constructor checks that no other scores tie, that no piece has the space
symbol after another character, and that the library normalises by escaping
spaces alone, and raises otherwise.

A text is cut where a space symbol follows another character (no piece spans
such a place). Cuts repeat a lot, so a worker keeps a bounded memo.

Defined cases: a null or empty text encodes to the end id alone and decodes
to ''; ids and repeated rows are kept as they are; unknown characters use the
byte pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, handed_back

SPACE = "▁"
MEMO_WORDS = 150_000


def merge(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """Join the best adjacent pair (highest rank, then leftmost) until none can be."""
    n = len(symbols)
    out: list[str | None] = list(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue: list[tuple[float, int, str, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n:
            joined = out[a] + out[b]
            if joined in rank:
                heapq.heappush(queue, (-rank[joined], a, joined, b))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, a, joined, b = heapq.heappop(queue)
        if out[a] is None or right[a] != b or out[b] is None or out[a] + out[b] != joined:
            continue
        out[a], out[b] = joined, None
        right[a] = right[b]
        if right[a] < n:
            left[right[a]] = a
        offer(left[a], a)
        offer(a, right[a])
    return [s for s in out if s is not None]


class PieceModel:
    """The pieces of a merge-type model and the backtracking encoder over them."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a éＡ\t\nb́ "
        if library.normalize(probe) != (" " + probe).replace(" ", SPACE):
            raise ValueError("the model's normaliser does more than escape spaces")
        self.end_id = library.eos_id()
        self.byte = {}
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.piece: dict[int, str] = {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.rank[piece], self.id[piece], self.piece[i] = library.get_score(i), i, piece
        self.from_byte = {i: b for b, i in self.byte.items()}
        joined = [p for p in self.rank if len(p) > 1 and p.strip(SPACE)]
        if len({self.rank[p] for p in joined}) < len(joined):
            raise ValueError("pieces with equal scores")
        if any(SPACE in p[1:] for p in joined):
            raise ValueError("a piece spans a space")
        if len(self.byte) < 256:
            raise ValueError("byte pieces are missing")
        # a piece that its own characters do not merge to can never be laid
        self.split = {p: self._last_merge(p) for p in joined}
        usable = [p for p in joined if self.split[p]] + [p for p in self.rank if len(p) == 1]
        if any(len(part) > 1 and self.rank[part] <= self.rank[p] for p in joined for part in self.split[p]):
            raise ValueError("a piece scores better than one it is made of")
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, (p, len(p) - 1))
        self.automaton.make_automaton()
        known = set(usable)
        self.characters = {p for p in usable if len(p) == 1}
        self.shorter = {p: self._prefix(p, known) for p in usable}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    @staticmethod
    def _prefix(piece: str, usable: set[str]) -> str | None:
        return next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in usable), None)

    def _last_merge(self, piece: str) -> tuple[str, ...]:
        """The two parts that are joined last when ``piece`` is merged from its
        characters; empty if they do not merge to it."""
        score = self.rank.pop(piece)
        parts = merge(list(piece), self.rank)
        self.rank[piece] = score
        return tuple(parts) if len(parts) == 2 else ()

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b gives [a, b]. The merges are
        replayed backwards at the seam: ``l`` and ``r`` are the symbols that
        touch there, ``l_until`` and ``r_until`` the scores of the merges that
        use them up. If their joined piece would be merged before both of
        these, the seam does not hold; equal scores go from left to right."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        rank, never = self.rank, float("-inf")
        l, r, l_until, r_until, holds = a, b, never, never, True
        while True:
            score = rank.get(l + r)
            if score is not None and score > l_until and score >= r_until:
                holds = False
                break
            if len(l) > 1 and (len(r) == 1 or rank[l] < rank[r]):
                l, l_until = self.split[l][1], rank[l]
            elif len(r) > 1:
                r, r_until = self.split[r][0], rank[r]
            else:
                break
        if len(self.pairs) > 4 * MEMO_WORDS:
            self.pairs.clear()
        self.pairs[a, b] = holds
        return holds

    def lay(self, text: str) -> list[str]:
        """Pieces of a run of known characters."""
        n = len(text)
        longest: list[str | None] = [None] * (n + 1)
        for end, (piece, back) in self.automaton.iter(text):
            longest[end - back] = piece  # ends ascend: the last one from a place is the longest
        failed, far = 0, bytearray(n + 1) if n > 1000 else None
        compatible, shorter, pairs = self.compatible, self.shorter, self.pairs
        laid: list[str] = []
        at, before, piece = 0, None, longest[0]
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not (far[end] if far else failed >> end & 1):
                    if before is None:
                        break
                    holds = pairs.get((before, piece))
                    if holds or holds is None and compatible(before, piece):
                        break
                piece = shorter[piece]
            if piece is None:
                if far:
                    far[at] = 1
                else:
                    failed |= 1 << at
                piece = laid.pop()
                at -= len(piece)
                piece = shorter[piece]
                before = laid[-1] if laid else None
            else:
                laid.append(piece)
                at, before, piece = end, piece, longest[end]
        return laid

    def _space_run(self, n: int) -> list[int]:
        if n not in self.runs:
            self.runs[n] = [self.id[p] for p in merge([SPACE] * n, self.rank)]
        return self.runs[n]

    def segment(self, text: str) -> list[int]:
        """Ids of a segment: a run of space symbols, then other characters."""
        body = text.lstrip(SPACE)
        spaces = len(text) - len(body)
        if not body:
            return self._space_run(spaces)
        ids: list[int] = []
        if spaces:
            body = SPACE + body
        start = 0
        if not self.characters.issuperset(body):
            for i, c in enumerate(body):
                if c not in self.characters:
                    ids += [self.id[p] for p in self.lay(body[start:i])]
                    ids += [self.byte[b] for b in c.encode()]
                    start = i + 1
        ids += [self.id[p] for p in self.lay(body[start:])]
        if spaces and ids[0] == self.id[SPACE]:  # the last space stayed alone: it belongs to the run
            return self._space_run(spaces) + ids[1:]
        return (self._space_run(spaces - 1) if spaces > 1 else []) + ids

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids, spaces in front included; a run of byte pieces is read as UTF-8."""
        if self.from_byte.keys().isdisjoint(ids):
            return "".join([self.piece.get(i, "") for i in ids]).replace(SPACE, " ")
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.from_byte:
                raw.append(self.from_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.piece:
                out.append(self.piece[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_pieces(ids).removeprefix(" ")

    def cut(self, text: str) -> list[str]:
        """Segments of a text: cut in front of each space symbol after another character."""
        if not text:
            return []
        parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)
        out, run = [], 0
        for p in parts[1:]:
            run += 1
            if p:
                out.append(SPACE * run + p)
                run = 0
        if run:
            out.append(SPACE * run)
        return out

    def known(self, segment: str) -> tuple[str, int, str]:
        """(ids as decimal text, number of ids, decoded text) of a segment, from the memo."""
        entry = self.old.get(segment)
        if entry is None:
            ids = self.segment(segment)
            entry = (" ".join(map(str, ids)), len(ids), self.decode_pieces(ids))
        if len(segment) <= 64:
            if len(self.young) > MEMO_WORDS:
                self.old, self.young = self.young, {}
            self.young[segment] = entry
        return entry

    def rest(self) -> None:
        """Keep only the young words between partitions: the worker's next task may
        be of another operator."""
        self.old = {}
        self.pairs.clear()

    def encode(self, text: str) -> list[int]:
        return [i for s in self.cut(text) for i in self.segment(s)] + [self.end_id]


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens (end id
    included), ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    check_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [_encode_row(model, t.as_py() or "", with_ids) for t in part.column(1)]
                columns = [part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)
        model.rest()
        handed_back()

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int64())), pa.field("decoded", pa.string())]
        schema += ", ids array<long>, decoded string"
    names = ["doc_id", *(f.name for f in fields)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _encode_row(model: PieceModel, text: str, with_ids: bool) -> tuple:
    found = [model.young.get(s) or model.known(s) for s in model.cut(text)]
    ids = " ".join([*(e[0] for e in found), str(model.end_id)])
    decoded = "".join([e[2] for e in found]).removeprefix(" ")
    row = (sum([e[1] for e in found]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return (*row, np.array(ids.split(), np.int64), decoded) if with_ids else row
