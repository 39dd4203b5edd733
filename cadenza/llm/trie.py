"""Prefix trie of conversations by a splitter skeleton.

A turn is known by 16 bytes of the SHA-256 of its role and text, a conversation by its path: its turns' keys end to
end.  Paths are sorted into range shards by splitters taken from a sample of paths.  A node whose members lie in
more than one shard is a prefix of a splitter; the trie of the splitters' prefixes is the skeleton, and a shard
needs only the two splitters that bound it to tell which of its nodes are in it.  Each shard is walked once in sorted
order with a stack: nodes outside the skeleton are finished there, nodes of the skeleton send one partial row a shard,
which are summed; then the skeleton, at most ``PART + 1`` nodes a splitter, is closed from its ends to its roots.

Splitters hold the conversation's id besides its path, so copies of one conversation are split over shards too.
Members that end in a node lie side by side in the order of their ids, so their digest is a running hash; where such a
run is cut by shards, its ids go as short chunks to one running hash.

Bounds.  Conversations are cut into segments of ``PART`` turns; segment k of a conversation hangs below the node that
its first k segments lead to, so rows and splitters are at most ``16 * (PART + 1)`` bytes and a conversation of any
length streams through a task.  Segments that one conversation alone reaches are finished in one pass; the others
from the deepest up, one round for each ``PART`` turns of the longest prefix that two conversations share.
Splitters come from at most ``SAMPLE`` rows.

Rows are ordered by turn, null first, equal turns by their keys.  Null roles and texts are empty; rows without an id
are left out.  Repeated rows are turns like others.  An empty table gives an empty result.  Ids are integers.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KEY, PART, SAMPLE, ROWS, CHUNK = 16, 64, 20_000, 50_000, 2_000
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(KEY)

SEGMENTS = "conv_id long, level int, path binary, sizes array<long>, ends boolean, next binary"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Kinds of rows that a shard sends: finished nodes, finished nodes whose parent is in the skeleton, partial rows of
#: skeleton nodes, chunks of ids that end in skeleton nodes, and what a level's root adds to the node it hangs below.
NODE, ORPHAN, PARTIAL, ENDS, ABOVE = range(5)
_SENT = f"kind int, {NODES}, node binary, parent binary, size long, shard int, seq int, ids string, above array<long>"


def turn_keys(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, key (16 bytes), size (bytes of the text) of every row with an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = df.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.unhex(F.substring(whole, 1, 2 * KEY)).alias("key"), F.octet_length(text).cast("long").alias("size"))


def shared_turns(conv_id: int) -> int:
    """How many of its family's first turns a rebuilt conversation starts with."""
    return zlib.crc32(str(conv_id).encode()) % 9


def _rows(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return common.batch_of(arrow, list(zip(*rows)) if rows else [[] for _ in arrow])


def segments(turns: DataFrame, family: int | None = None, shared: Callable[[int], int] = shared_turns, most: int = 8, part: int = PART) -> DataFrame:
    """Written table of the conversations' segments.

    ``family``: conversation c is rebuilt to start with the first ``shared(c)``, at most ``most``, turns of
    conversation c - c % family (the sign is that of c), followed by its own after as many.  A family meets in one task, its first
    conversation ahead, so those turns are at hand.
    """
    of = F.col("conv_id") - F.col("conv_id") % family if family else F.col("conv_id")
    rows = turns.withColumn("family", of).repartition("family")
    rows = rows.sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "key")
    arrow = common.arrow_of(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, head_of, head = None, None, []
        skip = level = 0
        prefix, keys, sizes = ROOT, [], []

        def add(key: bytes, size: int) -> None:
            if len(keys) == part:
                cut(False)
            keys.append(key)
            sizes.append(size)

        def cut(ends: bool) -> None:
            nonlocal level, prefix, keys, sizes
            path = prefix + b"".join(keys)
            following = hashlib.sha256(path).digest()[:KEY] if len(keys) == part else None
            out.append((now, level, path, sizes, ends, following))
            level, prefix, keys, sizes = level + 1, following, [], []

        def close() -> None:
            if now is not None:
                cut(True)
                if prefix:  # it ends with a full segment, and is a member of the root of what hangs below that
                    cut(True)

        for batch in batches:
            for fam, conv, key, size in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    close()
                    now, level, prefix, keys, sizes = conv, 0, ROOT, [], []
                    skip = 0
                    if family:
                        if fam != head_of:
                            head_of, head = fam, []
                        skip = min(shared(conv), most)
                        if conv != fam:
                            for k, s in head[:skip]:
                                add(k, s)
                if family and conv == fam:
                    if len(head) < most:
                        head.append((key, size))
                    add(key, size)
                elif skip:
                    skip -= 1
                else:
                    add(key, size)
                if len(out) >= 1000:
                    yield _rows(arrow, out)
                    out.clear()
        close()
        yield _rows(arrow, out)

    return common.written(rows.select("family", "conv_id", "key", "size").mapInArrow(run, SEGMENTS), "trie-segments", compression="zstd")


def splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Up to ``shards - 1`` ascending (path, conv_id) that cut the rows into about even shards, from a hashed sample."""
    n = min(SAMPLE, 32 * shards)
    found = sorted((bytes(r.path), r.conv_id) for r in rows.select("path", "conv_id").orderBy(F.xxhash64("conv_id", "path"), "conv_id").limit(n).collect())
    return sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []


def common_items(a: bytes, b: bytes) -> int:
    """How many whole keys two paths have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    at = int(np.argmax(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)))
    return at // KEY


class _Node:
    __slots__ = ("members", "least", "children", "leaves", "saved", "size", "digest", "ids", "above", "pending")

    def __init__(self, size: int):
        self.members, self.least, self.children, self.leaves, self.saved, self.size = 0, None, 0, 0, 0, size
        self.digest, self.ids, self.above, self.pending = None, [], None, []


class _Walk:
    """One shard, its rows in sorted order; ``sent`` gathers what it finishes."""

    def __init__(self, base: int, shard: int, bounds: list[bytes]):
        self.base, self.shard, self.bounds = base, shard, bounds  # base: depth of the roots
        self.stack: list[_Node] = []
        self.path, self.open = b"", 0  # open: how many nodes of the stack are in the skeleton
        self.sent: list[tuple] = []
        self.seq = 0

    def row(self, conv: int, path: bytes, sizes: list[int], ends: bool, above: tuple | None) -> None:
        keep = common_items(path, self.path)
        while len(self.stack) > keep:
            self.pop()
        items = len(path) // KEY
        for k in range(keep, items):
            self.stack.append(_Node(sizes[k - 1] if k else 0))
        if path != self.path:
            self.path, self.open = path, max((common_items(path, b) for b in self.bounds), default=0)
        top = self.stack[-1]
        top.members += 1
        top.least = conv if top.least is None else min(conv, top.least)
        top.above = above or top.above
        if ends:
            if len(self.stack) <= self.open:
                top.ids.append(str(conv))
                if len(top.ids) >= CHUNK:
                    self.chunk(top, len(self.stack))
            elif top.digest is None:
                top.digest = hashlib.sha256(str(conv).encode())
            else:
                top.digest.update(b",%d" % conv)

    def name(self, items: int) -> bytes:
        return hashlib.sha256(self.path[: KEY * items]).digest()[:KEY]

    def send(self, kind: int, node: tuple = (None,) * 8, of: bytes | None = None, parent: bytes | None = None, size: int | None = None, seq: int | None = None, ids: str | None = None, above: list | None = None) -> None:
        self.sent.append((kind, *node, of, parent, size, self.shard, seq, ids, above))

    def chunk(self, node: _Node, items: int) -> None:
        self.send(ENDS, of=self.name(items), seq=self.seq, ids=",".join(node.ids))
        self.seq += 1
        node.ids = []

    def pop(self) -> None:
        items, node = len(self.stack), self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent:
            parent.members += node.members
            parent.least = node.least if parent.least is None else min(node.least, parent.least)
        depth = self.base + items - 1
        if items <= self.open:
            if node.ids:
                self.chunk(node, items)
            partial = (node.least, depth, None, node.members, node.children, node.leaves, node.saved, None)
            self.send(PARTIAL, partial, self.name(items), self.name(items - 1) if parent else self.path[:KEY], node.size, above=node.above)
            return
        if node.above:  # what hangs below in the next segment
            node.children, node.leaves, node.saved = (x + y for x, y in zip((node.children, node.leaves, node.saved), node.above))
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.size
        row = [node.least, depth, None, node.members, node.children, leaves, saved, node.digest.hexdigest() if node.digest else EMPTY]
        for x in node.pending:
            x[2] = node.least
            self.send(NODE, tuple(x))
        if parent is None:
            if self.base:
                self.send(ABOVE, tuple(row), self.path[:KEY])
            else:
                self.send(NODE, tuple(row))
            return
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        if items - 1 <= self.open:
            self.send(ORPHAN, tuple(row), parent=self.name(items - 1))
        else:
            parent.pending.append(row)


def _walked(rows: DataFrame, base: int, shards: int) -> DataFrame:
    """Written table of what the shards of one level send; ``rows`` have columns of SEGMENTS and above."""
    cuts = splitters(rows, shards)
    arrow = common.arrow_of(_SENT)
    placed = common.arrow_of("shard int, conv_id long, path binary, sizes array<long>, ends boolean, above array<long>")

    def place(batches):
        for batch in batches:
            convs, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shard = pa.array([bisect_right(cuts, x) for x in zip(paths, convs)], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *(c.cast(f.type) for c, f in zip(batch.columns, list(placed)[1:]))], schema=placed)

    def walk(batches):
        at = None
        for batch in batches:
            for shard, conv, path, sizes, ends, above in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at.shard != shard:
                    if at is not None:
                        while at.stack:
                            at.pop()
                        yield _rows(arrow, at.sent)
                    at = _Walk(base, shard, [cuts[k][0] for k in (shard - 1, shard) if 0 <= k < len(cuts)])
                at.row(conv, path, sizes, ends, above)
                if len(at.sent) >= 2000:
                    yield _rows(arrow, at.sent)
                    at.sent = []
        if at is not None:
            while at.stack:
                at.pop()
            yield _rows(arrow, at.sent)

    dealt = rows.select("conv_id", "path", "sizes", "ends", "above").mapInArrow(place, "shard int, conv_id long, path binary, sizes array<long>, ends boolean, above array<long>")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return common.written(dealt.mapInArrow(walk, _SENT), "trie-walk", compression="zstd")


def _running(sent: DataFrame) -> DataFrame:
    """node, ends: digests of the ids of skeleton nodes, chunk after chunk."""
    arrow = common.arrow_of("node binary, ends string")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            for node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    yield common.batch_of(arrow, [[now], [digest.hexdigest()]])
                now, digest = node, hashlib.sha256(ids.encode())
        if now is not None:
            yield common.batch_of(arrow, [[now], [digest.hexdigest()]])

    chunks = sent.where(F.col("kind") == ENDS).repartition("node").sortWithinPartitions("node", "shard", "seq").select("node", "ids")
    return chunks.mapInArrow(run, "node binary, ends string")


def skeleton(sent: DataFrame) -> list[dict]:
    """The skeleton's nodes with whole aggregates, from the sums of their partial rows; at most ``PART + 1`` a splitter."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = sent.where(F.col("kind") == PARTIAL).groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("size").alias("size"), F.max("above").alias("above"), *sums)
    nodes = {bytes(r.node): r.asDict() for r in partial.join(_running(sent), "node", "left").collect()}
    for r in nodes.values():
        for c, more in zip(("n_children", "n_leaves", "saved_tokens"), r["above"] or ()):
            r[c] += more
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):  # children before their parents
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        above = nodes.get(bytes(r["parent"]))
        r["parent_conv_id"] = above["conv_id"] if above else None
        if above:
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    return list(nodes.values())


def _level(rows: DataFrame, base: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, what each root adds to the node it hangs below) of one level."""
    spark = rows.sparkSession
    sent = _walked(rows, base, shards)
    columns = [c.split()[0] for c in NODES.split(", ")]
    bones = skeleton(sent)
    # At most PART + 1 rows of two keys a splitter, whatever the corpus.
    parents = F.broadcast(spark.createDataFrame([(bytes(r["node"]), r["conv_id"]) for r in bones], "parent binary, parent_conv_id long"))
    done = sent.where(F.col("kind") == NODE).select(columns)
    orphans = sent.where(F.col("kind") == ORPHAN).drop("parent_conv_id").join(parents, "parent").select(columns)
    own = [r for r in bones if not base or r["depth"] > base]
    whole = spark.createDataFrame([tuple(r[c] if c != "ends_sha256" else r["ends"] or EMPTY for c in columns) for r in own], NODES)
    roots = [(bytes(r["parent"]), r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in bones if base and r["depth"] == base]
    adds = sent.where(F.col("kind") == ABOVE).select(F.col("node").alias("next"), "n_children", "n_leaves", "saved_tokens")
    adds = adds.unionAll(spark.createDataFrame(roots, "next binary, n_children long, n_leaves long, saved_tokens long"))
    return done.unionAll(orphans).unionAll(whole), adds


def _alone(rows: DataFrame, part: int) -> DataFrame:
    """Nodes of segments that one conversation alone reaches."""
    arrow = common.arrow_of(NODES)

    def run(batches):
        for batch in batches:
            for conv, level, sizes, ends in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(sizes)
                last = hashlib.sha256(str(conv).encode()).hexdigest()
                if n:
                    yield common.batch_of(arrow, [[conv] * n, np.arange(n) + level * part + 1, [conv] * n, [1] * n, [1] * (n - 1) + [0 if ends else 1], [1] * n, [0] * n, [EMPTY] * (n - 1) + [last if ends else EMPTY]])

    return rows.select("conv_id", "level", "sizes", "ends").mapInArrow(run, NODES)


def trie(parts: DataFrame, shards: int | None = None, part: int = PART) -> DataFrame:
    """One row a node: the columns of NODES.  ``parts``: written segments of ``part`` turns; ``shards``: range shards of a level."""
    spark = parts.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = F.substring("path", 1, KEY)
    deep = parts.where("level > 0").groupBy(root.alias("root"), "level").agg(F.count("*").alias("members"))
    several = common.written(deep.where("members > 1").select("root", "level"), "trie-shared")
    top = several.agg(F.max("level")).first()[0] or 0
    nothing = spark.createDataFrame([], "next binary, n_children long, n_leaves long, saved_tokens long")
    lone = parts.where("level > 0").join(several.select("root"), root == F.col("root"), "left_anti")
    # A segment that is full leads on; one that another conversation does not reach ends at a leaf of its own.
    ends_alone = lone.select(root.alias("next"), (F.size("sizes") > 0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "level")
    found, adds = [_alone(lone, part)], nothing
    for level in range(top, -1, -1):
        rows = parts.where(F.col("level") == level)
        if level:
            rows = rows.join(several.where(F.col("level") == level).select("root"), root == F.col("root"), "left_semi")
        known = adds.unionAll(ends_alone.where(F.col("level") == level + 1).drop("level"))
        known = known.select("next", F.when(F.col("n_children") > 0, F.array("n_children", "n_leaves", "saved_tokens")).alias("above"))
        rows = common.written(rows.join(known, "next", "left").select("conv_id", "path", "sizes", "ends", "above"), "trie-level", compression="zstd")
        n = shards or max(least, -(-rows.count() // ROWS))
        nodes, adds = _level(rows, level * part, n)
        found.append(nodes)
    out = found[0]
    for df in found[1:]:
        out = out.unionAll(df)
    return out


def prefix_trie(df: DataFrame, family: int | None = None, shards: int | None = None, part: int = PART) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text), rebuilt by families of ids if ``family`` is given."""
    return trie(segments(turn_keys(df), family, part=part), shards, part)
