"""Chat formatting by assembly of token ids.

Each text is encoded on its own and reserved ids, which no text can yield, are spliced around it: a turn is its
role's opening id, the ids of the text and the closing id.  Other roles than those of ``ROLES`` are written out::

    <s>system</s>  [INST]user[/INST]  ...  [ROLE]any other role[TEXT]its text[/TEXT]

As text the reserved ids read as the strings of ``CONTROLS``.  So that no text can pose as one, a control string inside a
text gets a backslash after its first character, and one that has backslashes there already gets one more; taking
one away again restores any text.  Every control string has a ``[`` or ``<`` first and nowhere else, so neither two
texts nor a text and a control string can form another.

The loss mask is a bit for each id: +1 where an assistant's text begins, -1 behind its end, and the sum over all
ids before.  Reserved ids are not under the mask.

Records.  Turns are sorted by ranges of (id, turn), so that a long conversation is cut over several tasks; a record is
whole turns of one conversation, closed at ``RECORD`` ids, numbered by (shard, part).  The records are a written table,
from which ``read`` streams each conversation's records in order, a record at a time.

Null texts and roles are empty.  Rows without an id form one conversation without an id.  Rows are ordered by turn, null
first, then role, then text; repeated rows are turns like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/TEXT]")
#: Opening and closing string of each known role.
ROLES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
LEARNED = "assistant"
RECORD = 16_384

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
POSES = rf"([<\[])(\\*)({_REST})"
POSED = re.compile(rf"([<\[])(\\*)\\({_REST})")


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, POSES, r"\1\2\\\3")


def unescaped(text: str) -> str:
    return POSED.sub(r"\1\2\3", text)


class Ids:
    """Reserved ids behind the vocabulary, and the bytes of every id."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.first = tokens.encoder(path).tokenizer.get_vocab_size()
        back = {c: b for b, c in tokens._BYTES.items()}
        self.bytes: list[bytes] = [b""] * (self.first + len(CONTROLS))
        for token, i in vocabulary.items():
            if all(c in back for c in token):
                self.bytes[i] = bytes(back[c] for c in token)
        self.of = {c: self.first + k for k, c in enumerate(CONTROLS)}

    def text(self, ids: np.ndarray) -> str:
        """The text of ids of one piece of content."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode()


def ids_of(path: str) -> Ids:
    own = common.kept("tokens")
    if ("chat", path) not in own:
        own["chat", path] = Ids(path)
    return own["chat", path]


def assembled(path: str, roles: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all turns end to end, whether each is under the loss, number of ids of each turn)."""
    of = ids_of(path).of
    encoder = tokens.encoder(path)
    other = [r not in ROLES for r in roles]
    found, sizes = encoder.encode(escaped(texts))
    named, name_sizes = encoder.encode(escaped(pa.array([r if o else "" for r, o in zip(roles, other)], pa.string())))
    other = np.array(other, bool)
    # Turn: opening id, [role, "[TEXT]"], text, closing id.
    before = np.where(other, name_sizes + 2, 1)
    lengths = before + sizes + 1
    starts = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), "<u4")
    text_at = starts + before
    at = lambda first, n: np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    out[at(text_at, sizes)] = found
    out[at(starts + 1, name_sizes)] = named
    out[starts] = [of[ROLES[r][0]] if r in ROLES else of["[ROLE]"] for r in roles]
    out[text_at[other] - 1] = of["[TEXT]"]
    out[starts + lengths - 1] = [of[ROLES[r][1]] if r in ROLES else of["[/TEXT]"] for r in roles]
    learned = np.array([r == LEARNED for r in roles], bool)
    steps = np.zeros(len(out) + 1, np.int8)
    np.add.at(steps, text_at[learned], 1)
    np.add.at(steps, (text_at + sizes)[learned], -1)
    return out, np.cumsum(steps[:-1], dtype=np.int8).astype(bool), lengths


def formatted(df: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Written table of records: conv_id, shard, part, n_turns, ids (4 bytes each), loss (a bit for each id)."""
    spark = df.sparkSession
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    order = ["conv_id", "turn", "role", "text"]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Boundaries between equal turns fall by the texts' first characters, so that no whole text is in a boundary.
    dealt = rows.repartitionByRange(least, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order).select("conv_id", "role", "text")
    schema = f"conv_id {common.id_type(df, conv_col)}, shard int, part int, n_turns long, ids binary, loss binary"
    arrow = common.arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = common.string_bytes(batch.column(2))
            for i, j in common.text_blocks(offsets, 1_000_000):
                convs, roles = (batch.column(k).slice(i, j - i).to_pylist() for k in (0, 1))
                ids, loss, lengths = assembled(tokenizer, roles, batch.column(2).slice(i, j - i))
                ends = np.cumsum(lengths).tolist()
                out, first, start = [], 0, 0
                for t in range(len(convs)):
                    if t + 1 == len(convs) or convs[t + 1] != convs[t] or ends[t] - start >= RECORD:
                        out.append((convs[t], shard, part, t + 1 - first, ids[start : ends[t]].tobytes(), np.packbits(loss[start : ends[t]]).tobytes()))
                        first, start, part = t + 1, ends[t], part + 1
                yield common.batch_of(arrow, list(zip(*out)))

    return common.written(dealt.mapInArrow(run, schema), "chat", compression="zstd")


def turns(ids: np.ndarray, loss: np.ndarray, table: Ids) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss, code points as written) of each turn of a record."""
    opens = {table.of[a]: (r, table.of[b]) for r, (a, b) in ROLES.items()}
    marks = np.flatnonzero(ids >= table.first).tolist()
    k = 0
    while k < len(marks):
        mark = int(ids[marks[k]])
        role, chars = None, len(CONTROLS[mark - table.first])
        if mark in opens:
            role, close = opens[mark]
        elif mark == table.of["[ROLE]"] and k + 1 < len(marks) and ids[marks[k + 1]] == table.of["[TEXT]"]:
            written = table.text(ids[marks[k] + 1 : marks[k + 1]])
            role, close, k = unescaped(written), table.of["[/TEXT]"], k + 1
            chars += len(written) + len("[TEXT]")
        if role is None or k + 1 >= len(marks) or ids[marks[k + 1]] != close:
            raise ValueError("not a formatted turn")
        a, b = marks[k] + 1, marks[k + 1]
        written = table.text(ids[a:b])
        under = loss[a:b]
        learned = unescaped(table.text(ids[a:b][under])) if under.any() else ""
        yield role, unescaped(written), learned, chars + len(written) + len(CONTROLS[close - table.first])
        k += 2


def read(records: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens of every conversation, from its records."""
    kind = common.id_type(records, "conv_id")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    arrow = common.arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ids_of(tokenizer)
        now, state, out = None, None, []

        def close() -> None:
            if state is not None:
                n, whole, chars, learned, written, n_tokens, n_loss = state
                out.append((now, n, whole.hexdigest(), chars, learned.hexdigest(), written, n_tokens, n_loss))

        for batch in batches:
            for conv, raw, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids = np.frombuffer(raw, "<u4")
                loss = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids)).astype(bool)
                for role, text, learned, written in turns(ids, loss, table):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                    state[4] += written
                state[5] += len(ids)
                state[6] += int(loss.sum())
            if len(out) >= 1000:
                yield common.batch_of(arrow, list(zip(*out)))
                out.clear()
        close()
        yield common.batch_of(arrow, list(zip(*out)) if out else [[] for _ in arrow])

    dealt = records.repartition("conv_id").sortWithinPartitions("conv_id", "shard", "part")
    return dealt.select("conv_id", "ids", "loss").mapInArrow(run, schema)


def texts(records: DataFrame, tokenizer: str) -> DataFrame:
    """The records as text: conv_id, shard, part, text with control strings in place of reserved ids."""
    schema = f"conv_id {common.id_type(records, 'conv_id')}, shard int, part int, text string"
    arrow = common.arrow_of(schema)

    def run(batches):
        for batch in batches:
            table = ids_of(tokenizer)
            names = table.bytes[: table.first] + [c.encode() for c in CONTROLS]
            written = [b"".join([names[i] for i in np.frombuffer(raw, "<u4").tolist()]).decode() for raw in batch.column(3).to_pylist()]
            yield common.batch_of(arrow, [*batch.columns[:3], written])

    return records.select("conv_id", "shard", "part", "ids").mapInArrow(run, schema)


def oracle(conversations: str = "conversations") -> str:
    """The same digests in DuckDB's SQL."""
    opening = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in ROLES.items())
    escape = lambda c: rf"regexp_replace({c}, '{POSES}', '\1\2\\\3', 'g')"
    other = len("[ROLE]") + len("[TEXT]") + len("[/TEXT]")
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum(length({escape('text')}) + CASE {opening} ELSE {other} + length({escape('role')}) END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""
