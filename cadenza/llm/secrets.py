"""Secret scans: exact patterns, and a linear-chain conditional random field over white-space tokens.

The field tags each token as O (outside), B (begins a secret) or I (inside one) from the shape of the token,
the shapes of its neighbours (two before, one after) and features of the whole document, and is decoded by
Viterbi.  It is trained here: the patterns' own spans in a bounded sample of documents (``max_documents``, the
lowest id hashes among those that hold a key word) are the positive tags.

A token's shape is a set of flags; distinct tokens are looked up in a worker's cache, so that scoring a text
is a few gathers.  Decoding is exact but only runs where it can matter: a token whose score for O beats B and
I by more than any transition can give back is O in the best path, and the stretches between such tokens are
decoded alone.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEY = r"(password|passwd|secret|token|api_?key)"
# The three patterns of the contract.
_ASSIGN = re.compile(_KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
ORDER = {"assign": 0, "access": 1, "hex": 2, "crf": 3}
O, B, I = 0, 1, 2


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, leftmost and non-overlapping per kind, in code points, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS) or not text.isascii():
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


# ---- features ----

_CORE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_TOKEN = re.compile(common.WORD)
N_SHAPE, N_FILE = 24, 8


def core(token: str) -> tuple[int, int]:
    """The longest run of secret characters in a token, the first of equals; (0, 0) if it has none."""
    best = max(_CORE.finditer(token), key=lambda m: (m.end() - m.start(), -m.start()), default=None)
    return best.span() if best else (0, 0)


def shape(token: str) -> int:
    """Flags of a token as bits."""
    a, b = core(token)
    c = token[a:b]
    n = len(c)
    digits = sum(x.isdigit() for x in c)
    uppers, lowers = sum(x.isupper() for x in c), sum(x.islower() for x in c)
    low = token.lower()
    flags = (
        n < 4, 4 <= n < 8, 8 <= n < 16, 16 <= n < 24, 24 <= n < 36, n >= 36,
        digits == 0, 0 < digits < n * 0.3, n * 0.3 <= digits < n, n > 0 and digits == n,
        uppers > 0 and lowers > 0 and digits > 0, uppers + digits == n and uppers > 0 and digits > 0, lowers + digits == n and lowers > 0 and digits > 0,
        n >= 8 and not c.strip("0123456789abcdef"), n >= 8 and len(set(c)) > 0.6 * min(n, 20),
        any(k in low for k in KEYWORDS), low.rstrip("\"'") in ("=", ":") or (bool(low) and low[-1] in ":="), token[:1] in "\"'" or token[-1:] in "\"'",
        "@" in token, "/" in token, c.count(".") > 0, "-" in c or "_" in c or "+" in c, len(token) - n > 2, c.startswith(("AKIA", "sk", "gh", "xox", "eyJ")),
    )
    return sum(1 << k for k, f in enumerate(flags) if f)


def file_features(masks: np.ndarray) -> np.ndarray:
    """Of the whole document, from its tokens' shapes: bias, size, share of key words, digits, long tokens."""
    n = max(1, len(masks))
    share = lambda bit: float(((masks >> bit) & 1).sum()) / n
    return np.array([1.0, min(1.0, np.log1p(n) / 12), share(15) > 0, min(1.0, 20 * share(15)), min(1.0, 5 * share(9)), min(1.0, 20 * share(4)), min(1.0, 20 * share(5)), share(22)])


def bits_of(masks: np.ndarray) -> np.ndarray:
    return ((masks[..., None] >> np.arange(N_SHAPE)) & 1).astype(np.float64)


# ---- the field ----


@dataclass(frozen=True)
class Field:
    """``shape``: weights [place (this, one before, two before, one after), flag, tag]; ``file`` [feature, tag]; ``step`` [tag, tag]."""

    shape: np.ndarray
    file: np.ndarray
    step: np.ndarray

    def tables(self, masks: np.ndarray) -> np.ndarray:
        """Scores [place, mask, tag] of distinct shapes."""
        return np.einsum("mf,pft->pmt", bits_of(masks), self.shape)

    def slack(self) -> np.ndarray:
        """For B and I: the most that two transitions can gain over those of O in the same place."""
        into, out = self.step, self.step
        return np.array([(into[:, s] - into[:, O]).max() + (out[s] - out[O]).max() for s in (B, I)])


def viterbi(scores: np.ndarray, step: np.ndarray, first: bool, last: bool) -> list[int]:
    """The best path; unless at the document's ends it starts after and ends before a token that is O."""
    best = scores[0] + (0 if first else step[O])
    back = []
    for row in scores[1:]:
        all_ = best[:, None] + step
        back.append(all_.argmax(axis=0))
        best = all_.max(axis=0) + row
    tag = int((best if last else best + step[:, O]).argmax())
    path = [tag]
    for choice in reversed(back):
        tag = int(choice[tag])
        path.append(tag)
    return path[::-1]


def decode(scores: np.ndarray, field: Field) -> np.ndarray:
    """Tags of a whole document."""
    tags = np.zeros(len(scores), np.int64)
    open_ = (scores[:, 1:] + field.slack() >= scores[:, :1]).any(axis=1)
    at = np.flatnonzero(open_)
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        a, b = int(run[0]), int(run[-1]) + 1
        tags[a:b] = viterbi(scores[a:b], field.step, a == 0, b == len(scores))
    return tags


def train(masks: np.ndarray, files: np.ndarray, tags: np.ndarray, rounds: int = 80, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """Maximum likelihood of whole tag sequences by gradient ascent (Adam), with forward and backward sums.

    ``masks``, ``tags``: [sequence, token] windows of one length; ``files``: [sequence, feature].
    """
    n, length = masks.shape
    pad = np.pad(masks, ((0, 0), (2, 1)))
    places = np.stack([bits_of(pad[:, 2:-1]), bits_of(pad[:, 1:-2]), bits_of(pad[:, :-3]), bits_of(pad[:, 3:])], axis=2)
    x = np.concatenate([places.reshape(n, length, -1), np.repeat(files[:, None, :], length, axis=1)], axis=2)
    gold = np.eye(3)[tags]
    pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    w, step = np.zeros((x.shape[2], 3)), np.zeros((3, 3))
    flat = x.reshape(n * length, -1)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]
    lse = lambda v, axis: (m := v.max(axis=axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis=axis))
    for k in range(1, rounds + 1):
        scores = (flat @ w).reshape(n, length, 3)
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, length):
            ahead[:, t] = scores[:, t] + lse(ahead[:, t - 1, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            behind[:, t] = lse(step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = lse(ahead[:, -1], 1)
        single = np.exp(ahead + behind - total[:, None, None])
        double = np.exp(ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        grads = (flat.T @ (gold - single).reshape(-1, 3) / n - l2 * w, (pairs - double) / n - l2 * step)
        for g, p, m, v in zip(grads, (w, step), moments[::2], moments[1::2]):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(w[: 4 * N_SHAPE].reshape(4, N_SHAPE, 3), w[4 * N_SHAPE :], step)


WINDOW = 21
_SEPARATOR, _WORD = 1 << 16, 1 << 15
#: Cues that a window is also shown without: the separator; the separator and the key word.
_HIDDEN = (0, _SEPARATOR, _WORD | _SEPARATOR)
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = (_LETTERS + _LETTERS.upper() + _DIGITS, _LETTERS + _LETTERS.upper() + _DIGITS + "-_", _LETTERS + _DIGITS, _LETTERS.upper() + _DIGITS, _LETTERS + _LETTERS.upper() + _DIGITS + "-_.")


def drawn(rng: random.Random, short: bool) -> str:
    """A made-up value: of 8 to 14 characters or of 18 to 60, perhaps in quotes or behind a prefix."""
    alphabet = _ALPHABETS[0] if short else rng.choice(_ALPHABETS)
    value = "".join(rng.choice(alphabet) for _ in range(rng.randrange(8, 15) if short else rng.randrange(18, 61)))
    value = rng.choice(("", "", "", "sk-", "ghp_")) + value if not short else value + rng.choice(_DIGITS)
    return f'"{value}"' if rng.random() < 0.3 else value


def windows(text: str, most: int = 6) -> list[tuple[list[int], list[float], list[int]]]:
    """Training windows of a document: around ``most`` pattern spans, and at even distances elsewhere.

    The patterns' own values are all alike, so each window around a span is also given without separators, without
    key words, with a word between the key word and the value, and with made-up values of several alphabets in
    the place of its own: the field has to learn what secrets look like, not what the patterns match.
    """
    found = list(_TOKEN.finditer(text))
    masks = [shape(m[0]) for m in found]
    tags = [O] * len(found)
    hits = []
    starts = np.array([m.start() for m in found], np.int64)
    for kind, a, b in pattern_spans(text):
        if kind == "assign":
            a = _ASSIGN.match(text, a).start(2)
        first, last = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        tags[first] = B if tags[first] == O else tags[first]
        tags[first + 1 : last] = [I] * (last - first - 1)
        hits.append(first)
    file = file_features(np.array(masks, np.int64))
    rng = random.Random(zlib.crc32(text.encode()))
    out = []

    def add(m: list[int], t: list[int], hidden: int = 0) -> None:
        if not t or t[0] == I:
            return
        m, t, seen = m[:WINDOW], t[:WINDOW], file.copy()
        seen[2:4] *= not hidden & _WORD
        short = WINDOW - len(m)
        out.append(([x & ~hidden for x in m] + [0] * short, seen.tolist(), t + [O] * short))

    for at in hits[:most]:
        a = max(0, min(at - WINDOW // 2, len(found) - WINDOW))
        m, t, k = masks[a : a + WINDOW], tags[a : a + WINDOW], at - a
        for hidden in _HIDDEN:
            add(m, t, hidden)
            add(m[:k] + [shape(drawn(rng, False))] + m[k + 1 :], t, hidden)
        if k:
            for hidden, short in ((_SEPARATOR, True), (_SEPARATOR, False)):
                add(m[:k] + [shape("is"), shape(drawn(rng, short))] + m[k + 1 :], t[:k] + [O] + t[k:], hidden)
    for at in range(0, len(found), max(1, len(found) // (2 * min(len(hits), most) + 2))):
        a = max(0, min(at - WINDOW // 2, len(found) - WINDOW))
        add(masks[a : a + WINDOW], tags[a : a + WINDOW])
    return out


def fit(df: DataFrame, max_documents: int = 200, max_windows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Trains the field on at most ``max_documents`` documents, and on windows around ``max_windows`` spans of each.

    Of rows that share an id the text of least hash counts.  Without any such document the field tags everything O.
    """
    docs = common.texts(df, id_col, text_col)
    low = F.lower("text")
    hint = F.contains("text", F.lit("AKIA"))
    for k in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        hint = hint | F.contains(low, F.lit(k))
    kind = common.id_type(df, id_col)
    ids = docs.where(hint & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    # At most ``max_documents`` rows: one text of each id.
    chosen = docs.where(hint).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    arrow = common.arrow_of(f"doc_id {kind}, masks array<long>, file array<double>, tags array<int>")

    def run(batches):
        for ids, rows in common.row_batches(batches):
            out = [(i, *w) for i, t in zip(ids.to_pylist(), rows.to_pylist()) for w in windows(t, max_windows)]
            if out:
                yield common.batch_of(arrow, [*zip(*out)])

    got = chosen.mapInArrow(run, f"doc_id {kind}, masks array<long>, file array<double>, tags array<int>").toPandas()
    if got.empty:
        return Field(np.zeros((4, N_SHAPE, 3)), np.zeros((N_FILE, 3)), np.array([[0, -99, -99], [0, -99, -99], [0, -99, -99]], float))
    got = got.assign(key=[str(m) + str(t) for m, t in zip(got["masks"], got["tags"])]).sort_values(["doc_id", "key"], kind="stable")
    return train(*(np.array([np.asarray(v) for v in got[c]]) for c in ("masks", "file", "tags")))


class Tagger:
    """A worker's field with the shapes of the tokens it has met (at most ``cap`` kept)."""

    def __init__(self, field: Field, cap: int = 150_000):
        self.field, self.cap, self.known = field, cap, {}
        self.masks: dict[int, int] = {}
        self.list: list[int] = []
        self.table = np.zeros((4, 0, 3))

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in set(words) if w not in known]
        for w in new:
            m = shape(w)
            if m not in self.masks:
                self.masks[m] = len(self.list)
                self.list.append(m)
            known[w] = self.masks[m]
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        full = len(known) > self.cap
        for w in new:
            if full or len(w) > 60:
                del known[w]
        if self.table.shape[1] < len(self.list):
            self.table = self.field.tables(np.array(self.list))
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """The field's secrets as code-point spans: from the core of the first token to that of the last."""
        words = [w.decode() for w in text.encode().split()] if not text.isascii() else [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        if not words:
            return []
        x = self.ids(words)
        t = self.table
        scores = t[0, x]
        scores[1:] += t[1, x[:-1]]
        scores[2:] += t[2, x[:-2]]
        scores[:-1] += t[3, x[1:]]
        scores += file_features(np.array(self.list)[x]) @ self.field.file
        tags = decode(scores, self.field)
        at = np.flatnonzero(tags)
        if not len(at):
            return []
        found = list(_TOKEN.finditer(text))
        out = []
        for first in np.flatnonzero((tags == B) | ((tags == I) & (np.r_[O, tags[:-1]] == O))).tolist():
            last = first
            while last + 1 < len(tags) and tags[last + 1] == I:
                last += 1
            a, b = core(found[first][0])[0], core(found[last][0])[1]
            start, end = found[first].start() + a, found[last].start() + b
            if end > start:
                out.append(("crf", start, end))
        return out


def outside(span: tuple[str, int, int], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The parts of a span outside the others; a name that an assignment begins inside of is no part."""
    kind, at, end = span
    out = []
    for k, a, b in sorted(base, key=lambda s: (s[1], s[2])):
        if b > at and a < end:
            out += [(kind, at, a)] if a > at and k != "assign" else []
            at = b
    return out + ([(kind, at, end)] if at < end else [])


def all_spans(text: str, tagger: Tagger) -> tuple[list, list]:
    """(pattern spans, all spans): of the field's spans what no pattern span covers."""
    base = pattern_spans(text)
    return base, base + [part for s in tagger.spans(text) for part in outside(s, base)]


def marked(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with a mark for each run of overlapping or adjoining spans."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> (code points, end exclusive) of every whole text.

    A null or empty text has no spans.  Repeated rows get equal rows; an empty table an empty result.
    """
    return _scanned(df, field, id_col, text_col, lambda base, every, text: [[{"kind": k, "start": a, "end": b} for k, a, b in sorted(every, key=lambda s: (s[1], ORDER[s[0]], s[2]))]], "spans array<struct<kind:string,start:long,end:long>>")


def digests(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def row(base, every, text):
        kinds = [k for k, _, _ in base]
        return [kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)]

    return _scanned(df, field, id_col, text_col, row, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, field: Field, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``df`` with every secret of its text replaced by ``mark`` (overlapping and adjoining spans once); null texts stay null."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    key = uuid.uuid4().hex

    def clean(text: str) -> str:
        return marked(text, all_spans(text, _tagger(key, shared))[1], mark)

    @F.arrow_udf("string")
    def cleaned(text: pa.Array) -> pa.Array:
        parts = []
        _, offsets = common.string_bytes(text)
        for i, j in common.text_blocks(offsets, 1_000_000):
            parts.append(pa.array([None if t is None else clean(t) for t in text.slice(i, j - i).to_pylist()], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return df.withColumn(text_col, cleaned(F.col(text_col)))


def _tagger(key: str, shared) -> Tagger:
    """The tagger of one scan; a worker keeps no other."""
    own = common.kept("secrets")
    if key not in own:
        own.clear()
        own[key] = Tagger(shared.value)
    return own[key]


def _scanned(df: DataFrame, field: Field, id_col: str, text_col: str, row, columns: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(field)
    key = uuid.uuid4().hex

    def run(ids, rows):
        tagger = _tagger(key, shared)
        return [ids, *zip(*(row(*all_spans(t, tagger), t) for t in rows.to_pylist()))]

    return common.map_rows(common.texts(df, id_col, text_col), run, f"doc_id {common.id_type(df, id_col)}, {columns}")
