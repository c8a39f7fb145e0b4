"""Operator 7: chat formatting by token-level assembly.

Each turn's text is escaped and encoded on its own; the turn's row of tokens is spliced together from reserved ids and
these tokens, and its loss mask is the running sum of +1 and -1 at the ends of what is learned. Running sums over a
conversation give every turn's place in it, so a conversation of any length stays a run of rows and is read as a stream.

The template: ``<s>`` at a conversation's start; then per turn ``[ROLE]role[/ROLE]text</s>``. The five control
strings (with ``[INST]`` and ``[/INST]``, which other templates use) are reserved ids. In texts and role names a
backslash becomes two, and a control string gets a backslash after its first character, so no control string is left.

Defined results: turns stand in the order of turn (null first), then role, then text; null text and null role count as
empty; rows of a null conv_id form one conversation; a repeated turn is a turn of its own; only the role ``assistant``
is learned from, and its mask covers the text's tokens alone; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Codec, rank_file
from .common import only, table

#: Control strings, whose ids follow those of the rank file in this order.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
BEGIN, END, ROLE, AFTER_ROLE = range(4)
_NEEDS = re.compile(r"\\|(?:" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS) + ")")
_MARKED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _NEEDS.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def assemble(segments: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of segments (ids, learned)."""
    lengths = np.array([len(ids) for ids, _ in segments], np.int64)
    ends = np.cumsum(lengths)
    step = np.zeros(int(ends[-1]) + 1, np.int64)
    for (_, learned), a, b in zip(segments, ends - lengths, ends, strict=True):
        if learned:
            step[a] += 1
            step[b] -= 1
    return np.concatenate([np.asarray(ids, np.int32) for ids, _ in segments]), np.cumsum(step[:-1]).astype(np.int8)


def format_chats(conversations: DataFrame, ranks: bytes) -> DataFrame:
    """One row a turn: conv_id, place (from 0), first_token (of the turn in its conversation), ids, loss_mask.

    The rows come partitioned by conv_id and sorted by place.
    """
    of = conversations.sparkSession.sparkContext.broadcast(ranks)  # a megabyte or so, whatever the conversations

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(of.value)
        special = [[codec.size + i] for i in range(len(CONTROLS))]
        for batch in batches:
            ids, masks = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                learned = codec.encode(escape(text))
                one, mask = assemble([(special[ROLE], False), (codec.encode(escape(role)), False), (special[AFTER_ROLE], False), (learned, role == "assistant"), (special[END], False)])
                ids.append(one)
                masks.append(mask)
            lengths = pa.array([len(x) for x in ids], pa.int64())
            columns = [batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"), lengths, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "n", "ids", "loss_mask"])

    rows = only(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, n long, ids array<int>, loss_mask array<byte>")
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"place": F.row_number().over(in_order) - 1, "so_far": F.sum("n").over(so_far)})
    begin = F.when(F.col("place") == 0, 1).otherwise(0)
    start = F.lit(len_of(ranks) + BEGIN)
    return rows.select(
        "conv_id",
        F.col("place").cast("long").alias("place"),
        (F.col("so_far") - F.col("n") + 1 - begin).alias("first_token"),
        F.when(F.col("place") == 0, F.concat(F.array(start), "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(F.col("place") == 0, F.concat(F.array(F.lit(0).cast("byte")), "loss_mask")).otherwise(F.col("loss_mask")).alias("loss_mask"),
    )


def len_of(ranks: bytes) -> int:
    return Codec.of(ranks).size


def read_back(formatted: DataFrame, ranks: bytes) -> DataFrame:
    """A row a conversation, read from its tokens and masks alone, as a stream that holds one turn and three digests."""
    of = formatted.sparkSession.sparkContext.broadcast(ranks)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(of.value)
        found: list[tuple] = []
        now: list | None = None

        def text(ids: np.ndarray) -> str:
            return codec.decode(ids.tolist()).decode()

        def done() -> None:
            found.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            lists = []
            for name in ("ids", "loss_mask"):
                column = batch.column(name)
                lists.append((np.asarray(column.offsets) - column.offsets[0].as_py(), np.asarray(column.flatten())))
            (at, all_ids), (_, all_masks) = lists
            for i, (conv, place) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                ids, mask = all_ids[at[i] : at[i + 1]], all_masks[at[i] : at[i + 1]]
                if place == 0:
                    if now:
                        done()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                special = np.flatnonzero(ids >= codec.size)
                kinds = ids[special] - codec.size
                role_at, after, end = (int(special[kinds == k][0]) for k in (ROLE, AFTER_ROLE, END))
                role, body = text(ids[role_at + 1 : after]), text(ids[after + 1 : end])
                learned = unescape(text(ids[mask > 0]))
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += len(role) + len(body) + sum(len(CONTROLS[k]) for k in kinds.tolist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=schema)
                found.clear()
        if now:
            done()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=schema)

    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_chats(rows, ranks), ranks)
