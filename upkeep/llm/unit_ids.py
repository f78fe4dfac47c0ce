"""Token ids of whole texts through a dictionary of their distinct units.

A unit is a run of ASCII white space with the run of other bytes after it, cut
once more where ASCII punctuation follows an ASCII letter. Units lie end to end
and need no copying: Arrow's dictionary encoding finds the
distinct ones of a block exactly, the tokenizers library encodes each once, and
numpy gathers the ids of the text from there.

Cutting before white space that follows something else changes no id: with
byte-level pre-tokenizing no piece holds white space after other characters,
and a pre-tokenizer that drops white space sees the same words. One case is
different: white space outside ASCII before ASCII white space is one run to the
pre-tokenizer. Such texts are left uncut. Nor does any piece hold punctuation
after a letter; apostrophes and the characters of added tokens, which are
matched first, are not cut at.

Units up to ``SHORT`` bytes are kept in a memo of two generations of at most
``MEMO_UNITS`` entries; longer ones are encoded each time. Null texts are empty.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_UNITS = 250_000
SHORT = 64
BLOCK = 1 << 22
BORDER = b" \x01"
SPACE_LETTER = "\u0120"
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}][ \x09-\x0D]"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_loaded: dict[tuple[str, str], UnitIds] = {}


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
        yield row, stop
        row = stop


def byte_strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binary array of the slices of ``data`` between ``bounds``."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_list(array: pa.Array) -> list[bytes]:
    """The values of a large-binary array without nulls."""
    raw = array.buffers()[2]
    raw = raw.to_pybytes() if raw is not None else b""
    cut = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1].tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def run_positions(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the runs ``start .. start + length - 1``, one run after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class UnitIds:
    def __init__(self, path: str, dtype: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"token ids do not fit {dtype}")
        joined = "'" + "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.point = np.zeros(256, bool)
        self.point[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in joined]] = True
        self.border = self._library([BORDER])[0]
        # tokens that begin with a space, spelt as byte-level vocabularies spell it
        spelt = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lead = np.zeros(1 + max(spelt.values()), bool)
        if any(SPACE_LETTER in self.tokenizer.id_to_token(int(i)) for i in self.border):
            self.lead[[i for t, i in spelt.items() if t.startswith(SPACE_LETTER)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, units: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]

    def _encode(self, units: list[bytes]) -> list[bytes]:
        """Ids of units. Those that begin with one space and end without go
        through the library in one text. The first token of each carries the space,
        and no other one; where the vocabulary has no such tokens, a border unit
        in between marks the units. Each other unit is encoded alone, and so are
        all if the marks don't come out as many."""
        inner = [i for i, u in enumerate(units) if u[0] == 0x20 and not (len(u) == 1 or _SPACE[u[1]])]
        joined = [units[i] for i in inner]
        size = self.dtype.itemsize
        found: dict[int, bytes] = {}
        if inner and self.lead.any():
            ids = self._library([b"".join(joined)])[0]
            at = np.flatnonzero(self.lead[ids])
            if len(at) == len(inner):
                raw, cut = ids.tobytes(), [*(at * size).tolist(), len(ids) * size]
                found = {i: raw[a:b] for i, a, b in zip(inner, cut[:-1], cut[1:], strict=True)}
        elif inner:
            ids = self._library([BORDER.join(joined)])[0]
            width = len(self.border)
            at = np.arange(max(0, len(ids) - width + 1))
            for k in range(width):
                at = at[ids[at + k] == self.border[k]]
            if len(at) == len(inner) - 1:
                raw = ids.tobytes()
                found = {i: raw[a * size:b * size] for i, a, b in zip(inner, [0, *(at + width).tolist()], [*at.tolist(), len(ids)], strict=True)}
        alone = [i for i in range(len(units)) if i not in found]
        found |= {i: ids.tobytes() for i, ids in zip(alone, self._library([units[i] for i in alone]), strict=True)}
        return [found[i] for i in range(len(units))]

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        if len(self.young) > MEMO_UNITS:
            self.old, self.young = self.young, {}
        known = [self.young.get(u) for u in units]
        fresh = []
        for i, ids in enumerate(known):
            if ids is None:
                ids = known[i] = self.old.get(units[i])
                if ids is None:
                    fresh.append(i)
                else:
                    self.young[units[i]] = ids
        for i, ids in zip(fresh, self._encode([units[i] for i in fresh]), strict=True):
            known[i] = ids
            if len(units[i]) <= SHORT:
                self.young[units[i]] = ids
        return known

    def block(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, each with its end id, and their bounds."""
        cut = _SPACE[data]
        cut[1:] &= ~cut[:-1]
        cut[1:] |= _LETTER[data[:-1]] & self.point[data[1:]]
        for r in whole:
            cut[offsets[r]:offsets[r + 1]] = False
        starts = offsets[:-1]
        cut[starts[starts < offsets[1:]]] = True
        at = np.flatnonzero(cut)
        coded = byte_strings(data, np.append(at, len(data))).dictionary_encode()
        parts = [*self.ids_of(bytes_list(coded.dictionary)), np.array([end_id], self.dtype).tobytes()]
        size = self.dtype.itemsize
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // size
        start = np.cumsum(length) - length
        last = np.searchsorted(at, offsets[1:])
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), last, len(parts) - 1)
        ids = np.frombuffer(b"".join(parts), self.dtype)[run_positions(start[codes], length[codes])]
        ends = np.cumsum(length[codes])[last + np.arange(len(last))]
        return ids, np.concatenate([[0], ends])


def unit_ids(path: str, dtype: str = "<u2") -> UnitIds:
    """The worker's encoder for a tokenizer file."""
    if (path, dtype) not in _loaded:
        _loaded[path, dtype] = UnitIds(path, dtype)
    return _loaded[path, dtype]


def encoded_blocks(column: pa.Array | pa.ChunkedArray, path: str, end_id: int, dtype: str = "<u2") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, bounds) of blocks of whole texts."""
    encoder = unit_ids(path, dtype)
    flags = pc.match_substring_regex(column, WIDE_SPACE)
    odd = np.flatnonzero(flags.fill_null(False).to_numpy(zero_copy_only=False))
    offsets, data = text_buffers(column)
    for lo, hi in blocks(offsets, BLOCK):
        whole = odd[(odd >= lo) & (odd < hi)] - lo
        yield lo, hi, *encoder.block(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], whole, end_id)
