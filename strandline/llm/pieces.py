"""Token ids of many texts by the library, each distinct piece encoded once.

A tokenizer first splits a text by a pattern and then encodes the parts one by one, so a
text may be cut wherever its pattern always cuts. Three such places are used here; what
stands left and right of them must be plain (see ``_cuts``), else the text stays whole:

- before a single space between two characters that aren't white space,
- before and after a single newline between two such characters,
- between a letter and one of ``AFTER_LETTERS``.

They hold for byte-level BPE with the usual pattern and for word BPE that drops white
space. Pieces repeat often, so those of a chunk are made distinct with Arrow, together
with a bounded memo of what earlier chunks had; only new ones reach the library. The
memo, its ids and the lookups are arrays: no piece becomes a Python object unless it is
new and not a plain word.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: What ends a word and begins a piece. The apostrophe and the signs of special tokens (``<|>``) aren't among them.
AFTER_LETTERS = b".,;:!?#$%&*+=@/^_~()[]{}\"`-"
#: Bytes of text in a chunk, pieces in the memo of a worker, and plain pieces that the library gets in one string.
CHUNK_BYTES = 12 << 20
MEMO = 400_000
GROUP = 400

_AFTER = np.zeros(256, dtype=bool)
_AFTER[list(AFTER_LETTERS)] = True


def _letter_ends(b: np.ndarray) -> np.ndarray:
    """For each byte, whether a letter of ASCII or of the two-byte range that starts with C3 ends there."""
    out = ((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A) & (b < 0x80)
    if len(b) > 1:
        out[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0xC0) & (b[1:] != 0x97) & (b[1:] != 0xB7)
    return out


def _cuts(b: np.ndarray) -> np.ndarray:
    """For each byte, whether a piece may begin there."""
    cut = np.zeros(len(b), dtype=bool)
    if len(b) < 3:
        return cut
    cut[1:] = _letter_ends(b)[:-1]
    cut[1:] &= _AFTER[b[1:]]
    wide = (b >= 0xC3) & (b <= 0xDF)  # first of two bytes; no white space among these characters
    shown = (b > 0x20) & (b < 0x7F)
    right = shown | wide  # a character that isn't white space begins here
    left = shown  # or ends here
    left[1:] |= wide[:-1] & (b[1:] >= 0x80) & (b[1:] < 0xC0)
    alone = np.zeros(len(b), dtype=bool)
    np.logical_and(left[:-2], right[2:], out=alone[1:-1])
    cut |= alone & (b == 0x20)
    alone &= b == 0x0A
    cut |= alone
    cut[1:] |= alone[:-1]
    return cut


def split_long(text: bytes, limit: int) -> list[bytes]:
    """Parts of about ``limit`` bytes, cut before a space between two letters; the whole text where there is none."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])").search(text, at + limit)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def _buffers(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array without nulls."""
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class PieceEncoder:
    """Encodes with a tokenizer file, without added special tokens, truncation or padding."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = memo
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.word_ends = model.get("end_of_word_suffix")
        vocabulary = model["vocab"]
        #: Which ids begin (byte level) or end (word level) a plain piece, and the id of a newline.
        self.marks = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith(self.word_ends) if self.word_ends else token.startswith("Ġ")
        self.newline = np.zeros(len(self.marks), dtype=bool)
        self.newline[vocabulary.get("Ċ", [])] = True
        #: The memo: pieces, the number of ids of each, and the ids of all one after the other.
        self.memo = pa.array([], pa.large_binary())
        self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, new: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids. Plain ones go many at a time, and marks in the ids tell them apart."""
        at, data = _buffers(new)
        if not len(new):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        data = data[at[0] : at[-1]]
        at = at - at[0]
        own = _letter_ends(data)
        own[:-1] |= own[1:] & (data[:-1] == 0xC3)
        spaced = data[at[:-1]] == 0x20
        plain = (np.add.reduceat(~own, at[:-1], dtype=np.int64) == spaced) & (np.diff(at) > spaced)
        where: list[np.ndarray] = []
        found: list[np.ndarray] = []
        sizes = np.zeros(len(new), np.int64)
        rest = [np.flatnonzero(~plain)]
        for lead, marks in ((b" ", self.marks), (b" " if self.word_ends else b"\n", self.marks if self.word_ends else self.newline)):
            which = np.flatnonzero(plain & (spaced if not where else ~spaced))
            where.append(which)
            some = new.take(pa.array(which))
            if len(where) == 2:
                some = pc.binary_join_element_wise(pa.scalar(lead, pa.large_binary()), some, pa.scalar(b"", pa.large_binary()))
            edge, raw = _buffers(some)
            firsts = list(range(0, len(which), GROUP))
            joined = [raw[edge[i] : edge[min(i + GROUP, len(which))]].tobytes().decode() for i in firsts]
            for i, ids in zip(firsts, self._library(joined), strict=True):
                group = which[i : i + GROUP]
                hit = np.flatnonzero(marks[ids])
                if len(hit) != len(group):
                    rest.append(group)
                    found.append(np.zeros(0, "<u4"))
                    continue
                if self.word_ends:
                    sizes[group] = np.diff(hit, prepend=-1)
                else:
                    sizes[group] = np.diff(hit, append=len(ids))
                    if lead == b"\n":
                        sizes[group] -= 1
                        ids = np.delete(ids, hit)
                found.append(ids)
        alone = np.concatenate(rest)
        for i, ids in zip(alone, self._library([x.decode("utf-8", "replace") for x in new.take(pa.array(alone)).to_pylist()]), strict=True):
            sizes[i] = len(ids)
            found.append(ids)
        # ``found`` has the ids in the order of these pieces; bring them into the order of ``new``.
        failed = np.zeros(len(new), dtype=bool)
        failed[alone] = True
        order = np.concatenate([*(w[~failed[w]] for w in where), alone])
        flat = np.concatenate(found)
        starts = np.zeros(len(new), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, flat[self._index(starts, sizes)]

    @staticmethod
    def _index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Positions of runs of ``sizes`` from ``starts``."""
        upto = np.cumsum(sizes)
        return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)

    def encode(self, texts: list[bytes], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of tokens of each text, and all ids one after the other (None if not ``ids``)."""
        parts = [split_long(t, CHUNK_BYTES) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        ends = np.cumsum([len(x) for x in flat], dtype=np.int64) if flat else np.zeros(0, np.int64)
        data = b"".join(flat)
        if not data:
            return np.zeros(len(texts), np.int64), np.zeros(0, "<u4") if ids else None
        first = np.concatenate(([0], ends[:-1]))
        cut = _cuts(np.frombuffer(data, np.uint8))
        cut[first[first < len(data)]] = True
        starts = np.flatnonzero(cut)
        offsets = np.concatenate((starts, [len(data)])).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        # The memo's pieces come first and are distinct, so they keep their numbers.
        coded = pa.concat_arrays([self.memo, pieces]).dictionary_encode()
        which = coded.indices.to_numpy()[len(self.memo) :]
        sizes, fresh = self._encode_new(coded.dictionary.slice(len(self.memo)))
        sizes, pool = np.concatenate((self.sizes, sizes)), np.concatenate((self.pool, fresh))
        each = sizes[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        of_part = upto[np.searchsorted(starts, ends)] - upto[np.searchsorted(starts, first)]
        counts = np.bincount(owner, weights=of_part, minlength=len(texts)).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        self._remember(coded.dictionary, sizes, pool, begins, which)
        return counts, pool[self._index(begins[which], each)] if ids else None

    def _remember(self, pieces: pa.LargeBinaryArray, sizes: np.ndarray, pool: np.ndarray, begins: np.ndarray, used: np.ndarray) -> None:
        """Keep all pieces, or, if that is over the bound, those of the last chunk, the most frequent first."""
        if len(pieces) > self.most:
            often = np.bincount(used, minlength=len(pieces))
            kept = np.sort(np.argsort(-often, kind="stable")[: min(self.most, np.count_nonzero(often))])
            pieces = pieces.take(pa.array(kept))
            sizes, pool = sizes[kept], pool[self._index(begins[kept], sizes[kept])]
        self.memo, self.sizes, self.pool = pieces, sizes, pool


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about equal bytes of text, and their texts (null: empty)."""
    text = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_binary())
    sizes = pc.binary_length(text).to_numpy().astype(np.int64)
    before = np.cumsum(sizes) - sizes
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(before, before[at] + limit)))
        yield batch.slice(at, to - at), text.slice(at, to - at).to_pylist()
        at = to


#: A worker process keeps one encoder of each file.
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
