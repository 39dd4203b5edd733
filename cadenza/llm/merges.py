"""Byte-level BPE by merge replay over the words of a whole block of corpus, and decoding.

A task takes its slice of the corpus in blocks.  The distinct pieces that a block has and that the worker has
not met are laid out as one array of byte tokens; an inverted index leads from each token pair to the word
positions that hold it.  Merges are applied in rank order to all words at once: popping a rank merges all of
its positions from left to right and updates only the pairs of the touched neighbours.  Each word then has
its ids, and a document's ids are those of its pieces in order.  A word in which a merge brings up a pair of
no higher rank is replayed alone, lowest rank and leftmost first, which is the definition.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from . import common

#: White space other than space and line feed (and the separators that some engines count as such).
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: White space, then what follows up to the next white space: the pattern always cuts before white space that
#: follows something else, so these chunks are encoded alone as they are in the text.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_alone(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[k : k + 1] for k in range(len(word))]
    while len(parts) > 1:
        rank, k = min((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of every word: all merges in rank order over an inverted index from pair to positions."""
    first = [ranks[bytes([b])] for b in range(256)]
    starts, token, follow, before, home = [], [], [], [], []
    done: dict[int, list[int]] = {}
    for w, word in enumerate(words):
        starts.append(len(token))
        if word in ranks:  # a piece that is a token is that token
            done[w] = [ranks[word]]
            continue
        base, n = len(token), len(word)
        token.extend(first[b] for b in word)
        home.extend([w] * n)
        before.extend(range(base - 1, base + n - 1))
        follow.extend(range(base + 1, base + n + 1))
        if n:
            before[base], follow[-1] = -1, -1
    value = {r: b for b, r in ranks.items()}
    joined: dict[tuple[int, int], int | None] = {}

    def rank_of(a: int, b: int) -> int | None:
        if (a, b) not in joined:
            joined[a, b] = ranks.get(value[a] + value[b])
        return joined[a, b]

    index: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, after in enumerate(follow):
        if after >= 0 and (r := rank_of(token[k], token[after])) is not None:
            index[r][token[k], token[after]].append(k)
    queue = list(index)
    heapq.heapify(queue)
    odd: set[int] = set()
    while queue:
        rank = heapq.heappop(queue)
        for (a, b), places in index.pop(rank, {}).items():
            places.sort()
            for k in places:
                after = follow[k]
                if token[k] != a or after < 0 or token[after] != b or home[k] in odd:
                    continue  # a neighbour's merge took one of the two
                token[k], token[after] = rank, -1
                follow[k] = beyond = follow[after]
                if beyond >= 0:
                    before[beyond] = k
                for left, right in ((before[k], k), (k, beyond)):
                    if left < 0 or right < 0:
                        continue
                    r = rank_of(token[left], token[right])
                    if r is None:
                        continue
                    if r <= rank:
                        odd.add(home[k])
                        continue
                    if r not in index:
                        heapq.heappush(queue, r)
                    index[r][token[left], token[right]].append(left)
    out = []
    for w, word in enumerate(words):
        if w in done or w in odd:
            out.append(done.get(w) or encode_alone(word, ranks))
            continue
        ids, k = [], starts[w] if word else -1
        while k >= 0:
            ids.append(token[k])
            k = follow[k]
        out.append(ids)
    return out


class MergeEncoder:
    """A worker's pieces and their ids; keeps at most ``cap`` chunks of text between blocks."""

    def __init__(self, path: str, pattern: str, cap: int = 500_000):
        import regex

        self.ranks, self.find, self.cap = load_ranks(path), regex.compile(pattern).findall, cap
        self.known: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.value = [b""] * size
        for b, r in self.ranks.items():
            self.value[r] = b

    def _chunks(self, text: str) -> list[str]:
        return [text] if _OTHER_SPACE.search(text) else _CHUNK.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        split = [self._chunks(t) for t in texts]
        new = list({c for chunks in split for c in chunks if c not in known})
        pieces = [[p.encode() for p in self.find(c)] for c in new]
        ids = self.words
        words = list({p for found in pieces for p in found if p not in ids})
        ids.update(zip(words, (np.array(x, self.dtype).tobytes() for x in replay(words, self.ranks))))
        known.update((c, b"".join([ids[p] for p in found])) for c, found in zip(new, pieces))
        out = [np.frombuffer(b"".join(map(known.__getitem__, chunks)), self.dtype) for chunks in split]
        for items, kept in ((new, known), (words, ids)):
            full = len(kept) > self.cap
            for c in items:
                if full or len(c) > 40:
                    del kept[c]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.value.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple, MergeEncoder] = {}


def encoder(path: str, pattern: str) -> MergeEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = MergeEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text.  Nulls: a null text has no ids; null and repeated ids stay, one row each."""
    schema = f"doc_id {common.id_type(df, id_col)}, ids array<int>"
    return common.map_rows(common.texts(df, id_col, text_col), lambda ids, rows: [ids, [x.tolist() for x in encoder(ranks, pattern).encode(rows.to_pylist())]], schema)


def decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text binary: the bytes that the ids stand for (null ids: no bytes)."""
    arrow = common.arrow_of(f"doc_id {common.id_type(df, id_col)}, text binary")

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield common.batch_of(arrow, [ids, [encoder(ranks, pattern).decode(np.array(x or [], np.int64)) for x in rows]])

    return df.select(id_col, ids_col).mapInArrow(run, f"doc_id {common.id_type(df, id_col)}, text binary")


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every text in one pass over the table."""

    def run(ids, rows):
        e = encoder(ranks, pattern)
        found = e.encode(rows.to_pylist())
        return [ids, [len(x) for x in found], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], [hashlib.sha256(e.decode(x)).hexdigest() for x in found]]

    schema = f"doc_id {common.id_type(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.map_rows(common.texts(df, id_col, text_col), run, schema, max_bytes=4_000_000)
