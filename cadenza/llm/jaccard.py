"""N-gram Jaccard join by token-combination prefixes, exact for every pair of texts but for hashes that coincide.

Tokens are hashed word shingles (keyed, by a key that each run draws, so that no text can be made to coincide with another), ordered by (frequency class, hash), rare ones first.  Let a set of n tokens be
linked with another at ``percent``: at most d = n - ceil(percent * n / 100) of its tokens are not shared, and at
most D = n * (100 - percent) // percent tokens of the two sets together.

* Single tokens.  One of the first d + 1 tokens is shared.  Rare tokens among these are indexed alone.
* Combinations.  If all f rare tokens of a set are not shared, all that is shared is frequent.  The first
  L = d - f + (k - 1) * (D - f) + k frequent tokens hold at least L - (d - f) shared ones, and each token that is
  not shared can part at most k - 1 of their runs of k; so one run of k neighbours is the same in both prefixes
  extended to L.  These runs are indexed instead of the frequent tokens: keys grow with the prefix, not with its
  power.  Sets with fewer than L frequent tokens are indexed by single ones besides.

What meets in a key is first held against parity sketches of 512 bits, of 8,192 for long sets (the sets differ in at least as many tokens
as their sketches in bits, so nothing is lost), then verified on the whole sets.

Frequencies are occurrences in ``2**CELL_BITS`` cells, counted over all texts.  A token is frequent where its cell
holds more than twice the mean and 4 more, so less than half of the cells are frequent at any size, a rare
token's key is bounded by that, and the table of one byte a cell is all that is broadcast.

No group is expanded into all pairs.  Equal sets are one node.  A key's nodes are compared with one leader (a
star) and links are closed into components.  Keys whose nodes are then still apart compare those in different
components, if that is at most ``PAIRS`` comparisons of sketches for each row of a key.  Otherwise keys of at
most ``GROUP`` nodes do so; larger ones compare one node of each component with one of the largest, for as long
as that joins many; nodes that are still apart in such a key are indexed again by longer combinations
(``LONGER``), and what shares even the longest is compared where it is still apart.  How large keys are decides
only what it costs.
Components are found by alternating large and small stars on written tables; nothing of the graph comes to
the driver, and tables are deleted when their successors are written.

Null and empty texts have no shingles and are linked with nothing.  A null id is returned with a null
component and links nothing.  Repeated rows are equal sets; rows with one id and different texts share their
component, as the sets of one id are linked.  An empty table gives an empty result.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELL_BITS, CHUNK_BITS, FAN_IN = 22, 16, 256
CLASS_SHIFT = 59  # a token is its class above 59 bits of its hash
SKETCH, LONG, LONG_SKETCH = 8, 2000, 128  # words of 64 bits; sets of LONG tokens have a second, larger sketch
GROUP, PAIRS, TURNS, LONGER, SALT, FIRST = 16, 1024, 6, (4, 8), 1024, 8
FILTER_BITS = 28
_NODE = "n int, " + ", ".join(f"s{k} long" for k in range(SKETCH)) + ", more array<long>"


# ---- sets ----


def shingles(rows: pa.Array, n: int, key: int = common.KEY) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-word shingles, one text after the other; shingles of each text); a shorter text is one shingle."""
    hashes, sizes = common.hashed_words(rows, key=key)
    inside, _ = common.gram_owner(sizes, n)
    found = common.chain(hashes, n)[inside] if len(hashes) >= n else np.empty(0, np.uint64)
    counts = np.maximum(sizes - n + 1, 0)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        first, at = np.cumsum(sizes) - sizes, (np.cumsum(counts) - counts)[short]
        alone = [common.fmix(common.chain(hashes[first[k] : first[k] + sizes[k]], int(sizes[k])) + np.uint64(sizes[k])) for k in short]
        found = np.insert(found, at, np.concatenate(alone))
        counts[short] = 1
    return found, counts


def _cell(found: np.ndarray) -> np.ndarray:
    return found >> np.uint64(64 - CELL_BITS)


def token_sets(rows: pa.Array, n: int, shared: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """The distinct tokens of each text, ascending: rare classes first.  ``shared``: the classes, the key of the hashes."""
    classes, key = shared
    found, counts = shingles(rows, n, key)
    low = np.uint64((1 << CLASS_SHIFT) - 1)
    tokens = classes[_cell(found)].astype(np.uint64) << np.uint64(CLASS_SHIFT) | found & low
    out, ends = [], np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        x = np.sort(tokens[a:b])
        out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) > 1 else x)
    return out


def frequency_classes(docs: DataFrame, n: int, key: int = common.KEY) -> tuple[np.ndarray, int]:
    """([cell] log2 of the shingles in that cell, the least frequent class), over all texts.

    A task keeps one dense table and sends it in compressed chunks of ``2**CHUNK_BITS`` cells, at most
    ``FAN_IN`` of which are summed in one group, level after level; one chunk each comes to the driver.
    """
    schema = "chunk int, part int, counts binary"
    arrow = common.arrow_of(schema)
    chunks = 1 << CELL_BITS - CHUNK_BITS

    def count(batches):
        from pyspark import TaskContext

        table = np.zeros(1 << CELL_BITS, np.int64)
        for _, rows in common.row_batches(batches):
            cells, times = np.unique(_cell(shingles(rows, n, key)[0]).astype(np.uint32), return_counts=True)
            table[cells] += times
        part = TaskContext.get().partitionId()
        for k, counts in enumerate(table.reshape(chunks, -1)):
            if counts.any():
                yield common.batch_of(arrow, [[k], [part], [common.pack(counts)]])

    def total(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        counts = np.sum([common.unpack(x, np.int64) for x in rows["counts"]], axis=0)
        return pa.Table.from_batches([common.batch_of(arrow, [rows["chunk"][:1], [rows["part"][0] // FAN_IN], [common.pack(counts)]])])

    table = common.written(docs.mapInArrow(count, schema), "jaccard-counts")
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    tables = [table]
    while True:
        tables.append(common.written(tables[-1].groupBy("chunk", F.floor(F.col("part") / FAN_IN)).applyInArrow(total, schema), "jaccard-counts"))
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    counts = np.zeros((chunks, 1 << CHUNK_BITS), np.int64)
    for row in tables[-1].collect():
        counts[row["chunk"]] = common.unpack(row["counts"], np.int64)
    common.drop(*tables)
    classes = np.minimum(np.log2(counts.ravel() + 1), 31).astype(np.uint8)
    return classes, int(np.ceil(np.log2(2 * counts.mean() + 4)))


def prefix_keys(tokens: np.ndarray, percent: int, frequent: int, run: int) -> np.ndarray:
    """The keys of a set: single rare tokens, and runs of ``run`` frequent ones.  ``frequent`` 0: all are."""
    n = len(tokens)
    if 100 * n < percent * (n + 1):  # no other set is similar enough
        return tokens[:0]
    spare, both = n + -percent * n // 100, n * (100 - percent) // percent
    rare = int(np.searchsorted(tokens, np.uint64(frequent << CLASS_SHIFT))) if frequent < 32 else n
    if rare > spare:
        return tokens[: spare + 1]
    often = tokens[rare:]
    length = spare - rare + (run - 1) * max(0, both - rare) + run
    runs = often[:length]
    mixed = common.fmix(common.chain(runs, run) + np.uint64(run))
    singles = tokens[: spare + 1] if length > len(often) else tokens[:rare]
    return np.concatenate([singles, mixed])


def sketch(tokens: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity of the tokens in each of ``words`` * 64 cells."""
    odd = np.bincount((tokens & np.uint64(64 * words - 1)).view(np.int64), minlength=64 * words).astype(np.uint8) & np.uint8(1)
    return np.packbits(odd).view(np.int64)


def node_ids(sets: list[np.ndarray]) -> pa.Array:
    """A hash of each set, null if empty."""
    import xxhash

    return pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) if len(x) else None for x in sets], pa.int64())


def _node_columns(sets: list[np.ndarray]) -> list:
    sketches = np.array([sketch(x) for x in sets], np.int64).reshape(-1, SKETCH)
    more = pa.array([sketch(x, LONG_SKETCH) if len(x) >= LONG else None for x in sets], pa.list_(pa.int64()))
    return [[len(x) for x in sets], *(np.ascontiguousarray(sketches[:, k]) for k in range(SKETCH)), more]


def _keys_column(keys: list[np.ndarray]) -> pa.Array:
    return common.lists(np.array([len(k) for k in keys], np.int64), np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64))


def prefix_index(docs: DataFrame, n: int, percent: int, shared, frequent: int, run: int) -> DataFrame:
    """Written table, one row a document: doc_id, node, n, s0.., keys."""

    def rows_of(ids, rows):
        sets = token_sets(rows, n, shared.value)
        return [ids, node_ids(sets), *_node_columns(sets), _keys_column([prefix_keys(x, percent, frequent, run) for x in sets])]

    schema = f"doc_id {common.id_type(docs, 'doc_id')}, node long, {_NODE}, keys array<long>"
    return common.written(common.map_rows(docs, rows_of, schema), "jaccard-index", compression="zstd")


def id_filter(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(bit table that has the hash of every id, its number of bits): 256 bits an id, ``2**FILTER_BITS`` at most; false alarms only."""
    bits = min(FILTER_BITS, max(16, n.bit_length() + 8))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("w")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[words["at"].to_numpy()] = words["w"].to_numpy()
    return table.view(np.uint64), bits


def held(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int, shared) -> DataFrame:
    """Written table (node, tokens: 8 bytes each, ascending) of the nodes asked for, from one document of each.

    Texts stay where they are: a bit table of the ids asked for tells which to cut; a false alarm adds a set
    that no pair asks for.  More ids than the table has room for are found by a join instead.
    """
    ids = common.written(nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("doc_id")), "jaccard-ids")
    count = ids.count()
    if count > 1 << FILTER_BITS - 2:
        docs = docs.join(ids, "doc_id", "left_semi")
    table, bits = id_filter(ids, count)
    filter_ = docs.sparkSession.sparkContext.broadcast(table)
    arrow = common.arrow_of("node long, tokens binary")

    def run(batches):
        for batch in batches:
            hit = batch.filter(pa.array(held(filter_.value, batch.column(0).to_numpy())))
            for _, rows in common.row_batches([hit]):
                sets = token_sets(rows, n, shared.value)
                yield common.batch_of(arrow, [node_ids(sets), [x.tobytes() for x in sets]])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    out = common.written(docs.where("doc_id is not null").select(at.alias("at"), "text").mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"]), "jaccard-sets")
    common.drop(ids)
    return out


# ---- candidates ----


def met(index: DataFrame) -> DataFrame:
    """key, node, leader, rows of the keys that more than one node has: the keys are shuffled once."""
    each = index.where("node is not null").select("node", F.explode("keys").alias("key"))
    w = Window.partitionBy("key")
    told = each.select("key", "node", F.min("node").over(w).alias("leader"), F.max("node").over(w).alias("_last"), F.count("*").over(w).alias("rows"))
    return told.where("leader <> _last").drop("_last").dropDuplicates(["key", "node"])


def shared_keys(index: DataFrame) -> DataFrame:
    """Written table (key, node, leader, rows) of the keys that more than one node has; ``rows`` counts repeated sets too."""
    return common.written(met(index), "jaccard-keys", compression="zstd")


def _side(nodes: DataFrame, c: str, node: str) -> DataFrame:
    """node, and its size and sketch as ``c``n, ``c``0.. ."""
    return nodes.select(F.col("node").alias(node), F.col("n").alias(f"{c}n"), *(F.col(f"s{k}").alias(f"{c}{k}") for k in range(SKETCH)))


def _able(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and sketches of two sides allow the similarity."""
    na, nb, differ = F.col(f"{a}n"), F.col(f"{b}n"), F.lit(0)
    for k in range(SKETCH):
        differ = differ + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= _most(na, nb, percent))


def _most(na: Column, nb: Column, percent: int) -> Column:
    """In how many tokens linked sets can differ."""
    return na + nb - 2 * F.ceil(F.lit(percent) * (na + nb) / (100 + percent))


def _of_long(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the larger sketches of long sets allow too."""
    side = lambda c: nodes.where("more is not null").select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("more").alias(f"more{c}"))
    differ = F.aggregate(F.zip_with("morea", "moreb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce(differ <= _most(F.col("na"), F.col("nb"), percent), F.lit(True))).select("a", "b")


def viable(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    return _of_long(pairs.join(_side(nodes, "x", "a"), "a").join(_side(nodes, "y", "b"), "b").where(_able("x", "y", percent)).select("a", "b"), nodes, percent)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written table (a, b) of the pairs whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    arrow = common.arrow_of("a long, b long")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                merged = np.sort(np.concatenate([x, y]))
                same = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(100 * same >= percent * (len(merged) - same))
            yield pa.RecordBatch.from_arrays(list(batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).columns), schema=arrow)

    return common.written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """Written table (node, label) of all linked nodes but the labels themselves; a label is its component's least node.

    Alternating large and small stars: a round is two aggregations and joins over at most the links there are.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = common.written(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = common.written(small, "components")
        common.drop(large, *([before] if before is not None else []))
        before = edges
        # Done when every node has one edge, to a label that has none of its own.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("own")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("own")))
        if ends.groupBy("x").agg(F.sum("own").alias("own"), F.count("*").alias("all")).where("own > 1 or own = 1 and all > 1").isEmpty():
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            out.written_path = edges.written_path
            return out


def id_links(index: DataFrame) -> DataFrame:
    """(a, b): of each id with several nodes, the least with every other."""
    each = index.where("node is not null").select("doc_id", "node")
    several = each.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    return each.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


# ---- the join ----


class _Search:
    """The components found so far, and the steps that add links to them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, percent: int, shared):
        self.docs, self.nodes, self.n, self.percent, self.shared = docs, nodes, n, percent, shared
        self.labels: DataFrame | None = None
        self.sets: list[DataFrame] = []

    def labelled(self, keys: DataFrame) -> DataFrame:
        if self.labels is None:
            return keys.withColumn("label", F.col("node"))
        return keys.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def close(self, links: DataFrame) -> None:
        """Joins the components that the links connect."""
        old = self.labels
        self.labels = components(links if old is None else links.unionAll(old.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        if old is not None:
            common.drop(old)

    def compare(self, pairs: DataFrame, more: DataFrame | None = None) -> bool:
        """Verifies candidate pairs; True if any is linked.  ``more``: links that are known without it."""
        able = common.written(pairs, "jaccard-pairs")
        asked = able.select(F.col("a").alias("node")).unionAll(able.select(F.col("b").alias("node"))).distinct()
        sets = sets_of(self.docs, self.nodes, asked, self.n, self.shared)
        links = verified(able, sets, self.percent)
        common.drop(able, sets)
        every = links if more is None else links.unionAll(more)
        some = not every.isEmpty()
        if some or self.labels is None:
            self.close(every)
        common.drop(links)
        return some

    def apart(self, keys: DataFrame) -> DataFrame:
        """Written table (key, node, label, nodes) of the keys of three nodes or more that are in more than one component."""
        w = Window.partitionBy("key")
        each = self.labelled(keys.select("key", "node")).select("key", "node", "label", F.min("label").over(w).alias("_x"), F.max("label").over(w).alias("_y"), F.count("*").over(w).alias("nodes"))
        out = common.written(each.where("_x <> _y and nodes > 2").drop("_x", "_y"), "jaccard-apart", compression="zstd")  # the star was all of two
        common.drop(keys)
        return out

    def star(self, keys: DataFrame) -> DataFrame:
        """Each node of a key with the key's leader."""
        return viable(_ordered(keys.select(F.col("node").alias("x"), F.col("leader").alias("y"))), self.nodes, self.percent)

    def all_pairs(self, keys: DataFrame) -> DataFrame:
        """The nodes of one key that are in different components and whose sketches allow it.

        A key of more than ``SALT`` nodes is dealt in blocks: each of its nodes meets the others block by block.  A
        pair that is sure to meet in a lower key too, one of the ``FIRST`` lowest of both nodes, is left to that one.
        """
        first = keys.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST).alias("first"))
        each = keys.select("key", "node", "label", F.ceil(F.col("nodes") / SALT).cast("int").alias("blocks")).join(first, "node")
        dealt = each.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        left = dealt.select("key", "block", "node", F.col("label").alias("l"), F.col("first").alias("p")).join(_side(self.nodes, "x", "node"), "node").withColumnRenamed("node", "x")
        right = each.withColumnRenamed("label", "m").withColumnRenamed("first", "q").join(_side(self.nodes, "y", "node"), "node").withColumnRenamed("node", "y")
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        met = _ordered(left.join(right, ["key", "block"]).where((F.col("l") < F.col("m")) & _able("x", "y", self.percent) & ~F.exists(F.array_intersect("p", "q"), lambda k: k < F.col("key"))).select("x", "y"))
        return _of_long(met, self.nodes, self.percent)

    def drawn(self, keys: DataFrame, turn: int) -> DataFrame:
        """Of each key, one node of every component with one of the component that has most of it; others each turn."""
        draw = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node")
        each = keys.groupBy("key", "label").agg(F.min(draw).alias("d"), F.count("*").alias("size"))
        leader = each.groupBy("key").agg(F.max(F.struct("size", "d")).alias("m")).select("key", F.col("m.d.node").alias("y"))
        return viable(_ordered(each.select("key", F.col("d.node").alias("x")).join(leader, "key")), self.nodes, self.percent)

    def search(self, keys: DataFrame) -> DataFrame | None:
        """Links what meets in the keys after their stars; returns (written) the large keys that are still apart, or None."""
        keys, last = self.apart(keys), None
        for turn in range(TURNS):
            each = keys.groupBy("key", "label").count().groupBy("key").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("same"))
            rows, pairs = (int(x or 0) for x in each.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("same")) / 2)).first())
            if pairs <= PAIRS * rows:
                if rows:
                    self.compare(self.all_pairs(keys))
                common.drop(keys)
                return None
            if last is not None and 3 * rows > 2 * last:
                break
            if last is None:
                self.compare(self.all_pairs(keys.where(F.col("nodes") <= GROUP)))
                large = common.written(keys.where(F.col("nodes") > GROUP), "jaccard-large")
                common.drop(keys)
                keys = self.apart(large)
            last = rows
            self.compare(self.drawn(keys, turn))
            keys = self.apart(keys)
        return keys

    def longer(self, keys: DataFrame, run: int) -> DataFrame:
        """The keys by runs of ``run`` of all tokens, for the nodes of the given keys."""
        sets = sets_of(self.docs, self.nodes, keys.select("node").distinct(), self.n, self.shared)
        percent = self.percent
        arrow = common.arrow_of("node long, keys array<long>")

        def cut(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    found = [prefix_keys(np.frombuffer(x.as_buffer(), np.uint64), percent, 0, run) for x in part.column(1)]
                    yield common.batch_of(arrow, [part.column(0), _keys_column(found)])

        out = shared_keys(sets.mapInArrow(cut, "node long, keys array<long>"))
        common.drop(sets, keys)
        return out


def join(df: DataFrame, n: int = 3, percent: int = 90, run: int = 2, frequent: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links of ``100 * shared >= percent * union``).

    ``run``: tokens of a combination.  ``frequent``: the least class (log2 of its cell's occurrences) that is
    indexed by combinations; by default set from the mean.  Neither changes the result.
    """
    docs = common.texts(df, id_col, text_col)
    key = int.from_bytes(os.urandom(8), "little")
    classes, above = frequency_classes(docs, n, key)
    shared = docs.sparkSession.sparkContext.broadcast((classes, key))
    index = prefix_index(docs, n, percent, shared, above if frequent is None else frequent, run)
    known = index.where("node is not null and doc_id is not null")
    sketches = [F.min(c).alias(c) for c in ("n", *(f"s{k}" for k in range(SKETCH)), "more")]
    nodes = common.written(known.groupBy("node").agg(F.min("doc_id").alias("least"), *sketches), "jaccard-nodes")
    search = _Search(docs, nodes, n, percent, shared)
    keys = shared_keys(known)
    search.compare(search.star(keys), id_links(known))
    left = search.search(keys)
    for longer in LONGER:
        if left is None:
            break
        keys = search.longer(left, longer)
        search.compare(search.star(keys))
        left = search.search(keys)
    if left is not None:
        search.compare(search.all_pairs(left))
        common.drop(left)
    placed = search.labelled(nodes.select("node", "least"))
    roots = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    out = index.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), "node").join(placed.join(roots, "label").select("node", "component_id"), "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without near copies: of each component one stays.

    That is the document of least id, of one id's texts the one of least hash; documents without an id come
    last but count like others.  So an id with several texts keeps each that is no copy of another document.
    Rows that repeat both id and text stay once.  Texts without words are linked with nothing and stay, each of them
    where they have no id.

    Documents that surely stay are not shuffled: a bit table of those that may go picks what is joined.
    """
    own = common.fresh(df, "own")
    named = df.withColumn(own, F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    parts = join(named, n, percent, id_col=own, text_col=text_col)
    asked = parts.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("component_id").alias("least")).where("rows > 1 or least <> doc_id")
    asked = common.written(asked.select("doc_id", (F.col("least") != F.col("doc_id")).alias("goes")), "jaccard-asked")
    table, bits = id_filter(asked, asked.count())
    filter_ = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_go(at):
        return at.__class__(held(filter_.value, at.to_numpy()))

    hit = may_go(F.pmod(F.xxhash64(own), F.lit(1 << bits)))
    gone = asked.where("goes").select(F.col("doc_id").alias(own))
    bare = F.col(id_col).isNull() & ~F.coalesce(F.col(text_col), F.lit("")).rlike(common.WORD)
    some = named.where(hit & ~bare).join(gone, own, "left_anti").dropDuplicates([own])
    return named.where(~hit | bare).unionByName(some).select(*df.columns)
