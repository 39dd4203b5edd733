"""Encoding whole texts with files of the ``tokenizers`` library: chunks are looked up in a table, new ones are encoded."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import common

#: White space other than space and line feed (and the separators that some engines count as such), in UTF-8.
_ONE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_SEVERAL = tuple(c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


# How byte-level vocabularies write bytes; those without a visible character are numbered from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
_MARKS = tuple(",.;:!?")


def other_space(data: np.ndarray) -> np.ndarray:
    """Places of white space other than space and line feed."""
    found = [np.flatnonzero(_ONE[data])]
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        raw = np.r_[data, np.zeros(2, np.uint8)]
        three = raw[lead].astype(np.int64) << 16 | raw[lead + 1].astype(np.int64) << 8 | raw[lead + 2]
        for c in _SEVERAL:
            code = int.from_bytes(c, "big")
            found.append(lead[three == code] if len(c) == 3 else lead[three >> 8 == code])
    return np.concatenate(found)


def chunk_spans(data: np.ndarray, cuts: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether it is a whole text) of the chunks that are encoded alone as they are in the text.

    A chunk is white space and what follows up to the next white space, which byte-level pre-tokenizers always
    cut before, or with ``words`` (white space is dropped) what is between white space.  A text with other white
    space is one chunk.
    """
    inside = (data != 32) & (data != 10)
    if words:
        starts, ends = common.runs_of(inside, cuts)
    else:
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = ~inside[1:] & inside[:-1]
        first[cuts] = True
        bounds = np.flatnonzero(first)
        starts, ends = bounds[:-1], bounds[1:]
    whole = np.zeros(len(starts), bool)
    odd = other_space(data)
    if len(odd):
        texts = np.unique(np.searchsorted(cuts, odd, "right") - 1)
        keep = ~np.isin(np.searchsorted(cuts, starts, "right") - 1, texts)
        starts, ends = np.r_[starts[keep], cuts[texts]], np.r_[ends[keep], cuts[texts + 1]]
        whole = np.r_[whole[keep], np.ones(len(texts), bool)]
        order = np.argsort(starts, kind="stable")
        starts, ends, whole = starts[order], ends[order], whole[order]
    return starts, ends, whole


class ChunkTable:
    """Chunks and their ids: an open-addressed table of at most ``cap`` chunks (14 bytes each, and their ids).

    A chunk is known by 95 bits of two hashes whose keys each table draws for itself: ``keys`` tell its slot, ``checks``
    that it is the chunk.
    """

    def __init__(self, dtype: np.dtype, cap: int):
        self.cap, self.n, self.dtype = cap, 0, dtype
        size = 1 << (2 * cap - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.checks = np.zeros(size, np.uint64), np.zeros(size, np.uint32)
        self.seeds = tuple(int.from_bytes(os.urandom(8), "little") for _ in range(2))
        self.start, self.count = np.zeros(size, np.int32), np.zeros(size, np.uint16)
        self.pool, self.used = np.zeros(1 << 16, dtype), 0

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot that holds the key or is free for it, whether it holds the key)."""
        at = (keys & self.mask).astype(np.int64)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(self.mask)
            now = self.keys[at[todo]]
            todo = todo[(now != keys[todo]) & (now != 0)]
        return at, self.keys[at] == keys

    def append(self, ids: np.ndarray) -> int:
        """Puts ids into the pool; where."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(ids), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Distinct new chunks."""
        todo = np.arange(len(keys))
        while len(todo):
            at, _ = self.slots(keys[todo])
            _, first = np.unique(at, return_index=True)
            now = todo[first]
            self.keys[at[first]], self.checks[at[first]], self.start[at[first]], self.count[at[first]] = keys[now], checks[now], starts[now], counts[now]
            todo = np.delete(todo, first)
        self.n += len(keys)


class ChunkEncoder:
    """Texts to little-endian ids (2 bytes each where the vocabulary allows it, else 4).

    ``words``: the tokenizer drops white space, so the chunks are plain words.  The table holds at most ``cap``
    chunks of at most 64 bytes; others are encoded for each block of texts that has them.  Special tokens'
    strings in a text are ordinary text.
    """

    def __init__(self, path: str, words: bool, cap: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.words, self.dtype = words, np.dtype("<u2" if size <= 65536 else "<u4")
        self.table = ChunkTable(self.dtype, cap)
        self.single: dict[bytes, list[int]] = {}

    def _pieces(self, chunk: bytes) -> list[bytes] | None:
        """The pieces that the pre-tokenizer makes of a plain chunk (Latin-1 letters, perhaps one mark at the end), else None."""
        text = chunk.decode()
        if not text.isascii() and max(text) > "\xff":
            return None
        if self.words:
            text = text.lower()
            chunk = text.encode()
        elif text[0] == " ":
            text = text[1:]
        if text.isalpha():
            return [chunk]
        return [chunk[:-1], chunk[-1:]] if text[-1:] in _MARKS and text[:-1].isalpha() else None

    def _piece(self, piece: bytes) -> list[int]:
        if len(piece) > 1:
            return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(_BYTES))]
        if piece not in self.single:
            self.single[piece] = [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(_BYTES))]
        return self.single[piece]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, chunks: list[bytes], whole: list[bool]) -> list[list[int]]:
        """Ids of new chunks: of plain ones piece by piece by the tokenizer's model, of others by all of its steps."""
        out: list = [None] * len(chunks)
        rest = []
        for k, c in enumerate(chunks):
            pieces = None if whole[k] else self._pieces(c)
            if pieces is None:
                rest.append(k)
            else:
                out[k] = self._piece(pieces[0]) if len(pieces) == 1 else self._piece(pieces[0]) + self._piece(pieces[1])
        for k, ids in zip(rest, self._encode([chunks[k].decode() for k in rest])):
            out[k] = ids
        return out

    def _block(self, data: np.ndarray, cuts: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, whole = chunk_spans(data, cuts, self.words)
        table = self.table
        keys = common.span_hashes(data, starts, ends, table.seeds[0]) | np.uint64(1)
        checks = common.span_hashes(data, starts, ends, table.seeds[1]).astype(np.uint32)
        at, hit = table.slots(keys)
        if (table.checks[at][hit] != checks[hit]).any():
            return self._anew(data, cuts, end)
        start, count = table.start[at].astype(np.int64), table.count[at].astype(np.int64)
        kept = table.used
        if not hit.all():
            missed = np.flatnonzero(~hit)
            new, first, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            where = missed[first]
            if (checks[where][back] != checks[missed]).any():
                return self._anew(data, cuts, end)
            raw = data.tobytes()
            found = self.learn([raw[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist())], whole[where].tolist())
            counts = np.array([len(x) for x in found], np.int64)
            room = (ends[where] - starts[where] <= 64) & ~whole[where]
            room &= np.cumsum(room) <= table.cap - table.n
            order = np.r_[np.flatnonzero(room), np.flatnonzero(~room)]
            begins = np.empty(len(new), np.int64)
            flat = np.fromiter((i for k in order.tolist() for i in found[k]), self.dtype, int(counts.sum()))
            begins[order] = np.cumsum(counts[order]) - counts[order] + table.append(flat)
            table.add(new[room], checks[where][room], begins[room], counts[room])
            start[missed], count[missed] = begins[back], counts[back]
            kept += int(counts[room].sum())
        # Each text's ids, and after them the end.
        owner = np.searchsorted(cuts, starts, "right") - 1
        sizes = np.bincount(owner, count, len(cuts) - 1).astype(np.int64)
        before = np.cumsum(count) - count
        ids = table.pool[np.repeat(start - before, count) + np.arange(int(count.sum()))]
        table.used = kept  # what has no room in the table leaves the pool
        if end:
            ids = np.insert(ids, np.repeat(np.cumsum(sizes), len(end)), np.array(end * len(sizes), self.dtype))
            sizes += len(end)
        return ids, sizes

    def _anew(self, data: np.ndarray, cuts: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The block with an empty table of other keys, after two chunks had one key."""
        self.table = ChunkTable(self.dtype, self.table.cap)
        return self._block(data, cuts, end)

    def encode(self, rows: pa.Array, end: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); ``end``: ids appended to every text."""
        whole, offsets = common.string_bytes(rows)
        parts = [self._block(whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end or []) for i, j in common.text_blocks(offsets)]
        return np.concatenate([np.empty(0, self.dtype), *(p[0] for p in parts)]), np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])


def encoder(path: str, words: bool = False) -> ChunkEncoder:
    """The worker's encoder for a file."""
    own = common.kept("tokens")
    if (path, words) not in own:
        own[path, words] = ChunkEncoder(path, words)
    return own[path, words]


def binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ids of each text as one binary value."""
    offsets = np.r_[0, np.cumsum(sizes) * ids.dtype.itemsize].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
