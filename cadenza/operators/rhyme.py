"""Rhymes of lines by their vowel skeletons.

``lines``: a key (one song), ``ordinal`` and ``skel``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A pair of letters that comes again, overlapping or not.
PAIR_TWICE = r"(?s)(?=(..)).(?=.*\1)"


def groups(lines: DataFrame, key: str, n: int = 2) -> DataFrame:
    """key, rhyme, members (ordinals), size of the lines that share their last n skeleton letters with another."""
    at = lines.where(F.length("skel") >= n).groupBy(key, F.right("skel", F.lit(n)).alias("rhyme"))
    return at.agg(F.sort_array(F.collect_list("ordinal")).alias("members"), F.count("*").alias("size")).where("size >= 2")


#: Letters whose repeated parts are looked for at once.
LETTERS = 200_000

#: Runs of repeated parts that are numbered at once; bytes of the parts of one row of them, and of the rows sent at once.
ROWS, BYTES = 100_000, 1_000_000


def blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """(from, to) of runs of sizes that add up to ``most`` at most; a larger one is alone."""
    out, begin, held = [], 0, 0
    for k, x in enumerate(sizes):
        if k > begin and held + x > most:
            out.append((begin, k))
            begin, held = k, 0
        held += x
    return [*out, (begin, len(sizes))] if sizes else []


def shared_letters(letters, line, tops):
    """(places in the order of their suffixes within their lines, letters that each of them shares with the one before it).

    ``letters``: codes from 1, and 0 behind each line; ``line``: each place's line; ``tops``: how many letters at most are
    asked for there.  Places are sorted by as many first letters as fit in a number; those that this leaves together are
    told apart by twice as many, and so on.
    """
    import numpy as np

    n, bits = len(letters), int(letters.max()).bit_length()
    width = q = max(1, min(52, 62 - int(line[-1]).bit_length()) // bits)
    packed, padded = line.copy(), np.concatenate([letters, np.zeros(q, np.int64)])
    for k in range(q):
        packed = packed << bits | padded[k : k + n]
    order = np.argsort(packed)
    new = np.concatenate([[True], packed[order[1:]] != packed[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = [rank]
    while len(at := np.flatnonzero(~(new & np.append(new[1:], True)) & (tops[order] > width))):
        key = rank[order[at]] * n + rank[order[at] + width]
        by = np.argsort(key)
        order[at], key = order[at][by], key[by]
        new[at] = apart = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[order[at]] = np.maximum.accumulate(np.where(apart, at, 0))
        ranks.append(rank)
        width *= 2
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.where(new, 0, n)
    some = np.flatnonzero(new[1:] & (ranks[0][a] == ranks[0][b]))
    for rank in reversed(ranks):
        same = some[rank[a[some]] == rank[b[some]]]
        for x in (a, b):
            x[same] += width
        shared[1 + same] += width
        width //= 2
    differ = np.frexp((packed[a] ^ packed[b]).astype(np.float64))[1]
    shared[1:] += np.maximum(0, (q * bits - differ) // bits)
    return order, np.minimum(shared, tops[order])


def repeats(shared, n: int):
    """(at, low, high, times): the parts of low + 1 to high letters at the ``at``-th suffix come as many times.

    ``shared``: letters that sorted suffixes share with the one before.  All repeated parts of n letters or more, each once:
    parts that come at the same places are one row.
    """
    import numpy as np

    shared = np.append(shared, 0)
    before, after = np.arange(len(shared)) - 1, np.arange(len(shared)) + 1
    at = np.flatnonzero(shared >= n)
    some = at[shared[at - 1] > shared[at]]
    while len(some):
        before[some] = before[before[some]]
        some = some[shared[before[some]] > shared[some]]
    some = at[shared[at + 1] >= shared[at]]
    while len(some):
        after[some] = after[after[some]]
        some = some[shared[after[some]] >= shared[some]]
    at = at[shared[before[at]] < shared[at]]
    return at, np.maximum(n - 1, np.maximum(shared[before[at]], shared[after[at]])), shared[at], after[at] - before[at]


def cut(sizes, most: int):
    """(from, to) of runs of sizes that add up to ``most`` and one more size at most."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)]) if len(sizes) else []


def part_runs(skels: list[str], n: int, longest: int | None = None):
    """Batches (numbers of the skeletons, where the runs of each begin and end, at, low, high, times) of the parts of n
    letters or more that a skeleton has twice or more: the bytes from ``at`` on, low + 1 to high of them, come so often.

    Parts are as long as half the skeleton at most.  A skeleton is there again as often as the parts of its runs take
    about ``BYTES``, so that no row stands for much more, however many parts a skeleton has.
    """
    import numpy as np

    if not any(skels):
        return
    sizes, n, text = np.array([len(x) for x in skels], np.int64), max(n, 1), "\n".join(skels) + "\n"
    heads, codes = np.cumsum(sizes + 1) - sizes - 1, np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds, letters = np.unique(codes, return_inverse=True)
    letters += 1
    letters[heads + sizes] = 0
    line = np.repeat(np.arange(len(skels)), sizes + 1)
    order, shared = shared_letters(letters, line, np.minimum(sizes // 2, len(text) if longest is None else longest)[line])
    at, low, high, times = repeats(shared, n)
    starts = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
    plain = starts[-1] == len(codes)  # else each part is a run, as its letters take more bytes or fewer
    step = np.maximum(1, BYTES // high) if plain else np.ones_like(high)
    pieces = -(-(high - low) // step)
    for i, j in cut(pieces, ROWS):
        each = np.repeat(np.arange(i, j), pieces[i:j])
        nth = np.arange(len(each)) - (np.cumsum(pieces[i:j]) - pieces[i:j])[each - i]
        place, lower = order[at[each]], low[each] + nth * step[each]
        upper = np.minimum(high[each], lower + step[each])
        if not plain:
            upper = starts[place + upper] - starts[place]
            lower = upper - 1
        owner = line[place]
        row = np.cumsum((upper * (upper + 1) - lower * (lower + 1)) // 2 + 64 * (upper - lower)) // BYTES
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])]))
        ends, begin = np.append(first, len(each)), starts[place] - starts[heads[owner]]
        for x, y in cut(sizes[owner[first]] + 20 * np.diff(ends), BYTES):
            p, q = ends[x], ends[y]
            yield owner[first[x:y]], ends[x : y + 1] - p, begin[p:q], lower[p:q], upper[p:q], times[each[p:q]]


def repeated_parts(skels: list[str], n: int, longest: int | None = None) -> tuple[list[int], list[str], list[int]]:
    """``part_runs`` part by part: (number of the skeleton, part, times)."""
    out = ([], [], [])
    for owners, ends, *runs in part_runs(skels, n, longest):
        owners = [k for k, m in zip(owners.tolist(), (ends[1:] - ends[:-1]).tolist()) for _ in range(m)]
        for k, at, low, high, times in zip(owners, *(x.tolist() for x in runs)):
            for m in range(low + 1, high + 1):
                for x, y in zip(out, (k, skels[k].encode()[at : at + m].decode(), times)):
                    x.append(y)
    return out


def internal(lines: DataFrame, key: str, n: int = 2, longest: int | None = None) -> DataFrame:
    """key, ordinal, part, times of each skeleton part of n letters or more that a line has twice (overlap counts).

    Parts are as long as half the skeleton at most; ``longest`` bounds them further.  An Arrow function finds where they
    are, for some lines of a batch at once: ``LETTERS`` letters, or one line.  A line of few letters' turns has as many
    parts as the square of its length, so that they leave Python as runs and become text a row of about ``BYTES`` at a time.
    """
    kinds = [lines.schema[x].dataType.simpleString() for x in (key, "ordinal")]
    schema = f"{key} {kinds[0]}, ordinal {kinds[1]}, _skel binary, _runs array<struct<_at:int,_low:int,_high:int,times:long>>"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for i, j in blocks(pc.utf8_length(batch.column(2)).to_pylist(), LETTERS):
                some = batch.slice(i, j - i)
                skels = some.column(2).cast(pa.binary())
                for owners, ends, *runs, times in part_runs(some.column(2).to_pylist(), n, longest):
                    owners = pa.array(owners)
                    each = pa.StructArray.from_arrays([*(pa.array(x.astype(np.int32)) for x in runs), pa.array(times)], ["_at", "_low", "_high", "times"])
                    each = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(owners), some.column(1).take(owners), skels.take(owners), each], names=[key, "ordinal", "_skel", "_runs"])

    found = lines.where(F.length("skel") >= 2 * n).select(key, "ordinal", "skel").mapInArrow(run, schema)
    found = found.select(key, "ordinal", "_skel", F.inline("_runs")).select("*", F.explode(F.sequence(F.col("_low") + 1, "_high")).alias("_m"))
    return found.select(key, "ordinal", F.substring("_skel", F.col("_at") + 1, F.col("_m")).cast("string").alias("part"), "times")


def shared_start(a: str, b: str) -> int:
    """How many first letters two words share."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Peel:
    """Longest-first groups of skeletons that come reversed and sorted.

    The stack holds the endings that the last skeleton shares with those before it.  An ending is closed when a
    skeleton without it comes; of those under it that no longer ending has grouped, two or more are its group, and one
    is left to the ending below.  So an open ending holds one skeleton at most, and memory is one stack.
    """

    def __init__(self, least: int):
        self.least, self.stack, self.last, self.out = least, [], None, []

    def _add(self, node: list, item: tuple | None) -> None:
        """``node``: length, the one free skeleton, whether the group is open."""
        if item is None or node[0] < self.least:
            return
        if node[2]:
            self.out.append((*item[:2], node[0], item[2][: node[0]][::-1]))
        elif node[1] is None:
            node[1] = item
        else:
            first, node[1], node[2] = node[1], None, True
            self._add(node, first)
            self._add(node, item)

    def close(self, length: int = 0) -> None:
        while self.stack and self.stack[-1][0] > length:
            node = self.stack.pop()
            if not self.stack or self.stack[-1][0] < length:
                self.stack.append([length, None, False])
            self._add(self.stack[-1], node[1])

    def line(self, key: object, ordinal: int, reversed_: str) -> None:
        if self.last is None or self.last[0] != key:
            self.close()
            self.stack = []
            length = -1
        else:
            length = shared_start(self.last[1], reversed_)
            self.close(length)
        self.last = (key, reversed_)
        if length == len(reversed_):
            self._add(self.stack[-1], (key, ordinal, reversed_))
        else:
            self.stack.append([len(reversed_), (key, ordinal, reversed_), False])


def assigned(lines: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, ordinal, match_length, suffix of the lines that the longest-first assignment groups: from the longest ending
    down, lines still free that share it are a group.

    Lines that share their last ``least`` letters come to one task sorted by their reversed skeletons and stream
    through it; what it holds is bounded by the longest skeleton, not by the song.
    """
    kind = lines.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ordinal int, match_length int, suffix string"
    rows = lines.where(F.length("skel") >= least).select(key, F.col("ordinal").cast("int").alias("ordinal"), F.reverse("skel").alias("_r"))
    dealt = rows.repartition(key, F.left("_r", F.lit(least))).sortWithinPartitions(key, "_r")

    def run(batches):
        import pyarrow as pa

        peel, names = Peel(least), [key, "ordinal", "match_length", "suffix"]
        kinds: list = [None, pa.int32(), pa.int32(), pa.string()]

        def sent() -> pa.RecordBatch:
            columns = list(zip(*peel.out)) if peel.out else [[]] * 4
            peel.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                peel.line(*row)
                if len(peel.out) >= 4096:
                    yield sent()
        peel.close()
        if peel.out:
            yield sent()

    return dealt.mapInArrow(run, schema)


def factor(lines: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, rhyme_factor: matched skeleton letters over all of them."""
    whole = lines.groupBy(key).agg(F.sum(F.length("skel")).alias("_all"))
    matched = found.groupBy(key).agg(F.sum("match_length").alias("_hit"))
    return whole.join(matched, key, "left").select(key, F.when(F.col("_all") > 0, F.round(F.coalesce("_hit", F.lit(0)) / F.col("_all"), 4)).otherwise(0.0).alias("rhyme_factor"))


def scheme(lines: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, scheme array<int> by line: groups are numbered by their first line, lines alone come after; and letters.

    ``letters`` has A-Z for the first 26 numbers and ? beyond, and is ``free`` when no line rhymes.
    """
    first = found.groupBy(key, "suffix", "match_length").agg(F.min("ordinal").alias("_first"))
    numbered = first.withColumn("_g", F.row_number().over(Window.partitionBy(key).orderBy("_first")))
    placed = lines.select(key, "ordinal").join(found, [key, "ordinal"], "left").join(numbered, [key, "suffix", "match_length"], "left")
    w = Window.partitionBy(key)
    alone = F.row_number().over(w.orderBy(F.col("_g").isNotNull(), "ordinal"))
    placed = placed.withColumn("_groups", F.coalesce(F.max("_g").over(w), F.lit(0))).withColumn("_c", F.coalesce("_g", F.col("_groups") + alone))
    codes = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "_c"))), lambda s: s["_c"])
    out = placed.groupBy(key).agg(codes.alias("scheme"), F.max("_groups").alias("_groups"))
    alphabet = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")
    letters = F.array_join(F.transform("scheme", lambda c: F.coalesce(F.get(F.filter(alphabet, lambda a: a != ""), c - 1), F.lit("?"))), "")
    return out.select(key, "scheme", F.when(F.col("_groups") == 0, "free").otherwise(letters).alias("letters"))


def song_metrics(lines: DataFrame, found: DataFrame, key: str, long_: int = 3) -> DataFrame:
    """key, end_rows, pct_multis (assigned lines of ``long_`` letters or more), internal_rate (lines with an inner repeat)."""
    has = F.col("skel").rlike(PAIR_TWICE)
    inner = lines.select(key, F.when(F.length("skel") >= 4, has).otherwise(False).alias("_in")).groupBy(key).agg(F.round(F.avg(F.col("_in").cast("int")), 4).alias("internal_rate"))
    ends = found.groupBy(key).agg(F.count("*").alias("end_rows"), F.round(F.avg((F.col("match_length") >= long_).cast("int")), 4).alias("pct_multis"))
    return inner.join(ends, key, "left").select(key, F.coalesce("end_rows", F.lit(0)).alias("end_rows"), F.coalesce("pct_multis", F.lit(0.0)).alias("pct_multis"), "internal_rate")


def profile(lines: DataFrame, found: DataFrame, key: str, long_: int = 3) -> DataFrame:
    """``factor`` and ``song_metrics`` side by side, from one pass over the lines and one over what was found."""
    has = F.col("skel").rlike(PAIR_TWICE)
    whole = lines.groupBy(key).agg(F.sum(F.length("skel")).alias("_all"), F.round(F.avg(F.when(F.length("skel") >= 4, has).otherwise(False).cast("int")), 4).alias("internal_rate"))
    hits = found.groupBy(key).agg(F.sum("match_length").alias("_hit"), F.count("*").alias("end_rows"), F.round(F.avg((F.col("match_length") >= long_).cast("int")), 4).alias("pct_multis"))
    share = F.when(F.col("_all") > 0, F.round(F.coalesce("_hit", F.lit(0)) / F.col("_all"), 4)).otherwise(0.0)
    return whole.join(hits, key, "left").select(key, F.coalesce("end_rows", F.lit(0)).alias("end_rows"), F.coalesce("pct_multis", F.lit(0.0)).alias("pct_multis"), "internal_rate", share.alias("rhyme_factor"))


def suffix_words(forms: DataFrame, skel: str = "skel", n: int = 2) -> DataFrame:
    """Words with ``rhyme``, the last n letters of their skeletons; shorter skeletons rhyme with nothing."""
    return forms.withColumn("rhyme", F.right(skel, F.lit(n))).where(F.length(skel) >= n)
