"""Packing: vector bin packing by the dot-product heuristic under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents that it reads, in bounded buffers, so nothing is shuffled and a lost task is simply run
again. A bin takes, again and again, the item that fits and has the largest dot product of its size vector (each dimension
over its limit) with the bin's free room; ties go to the item that waits at the lower place. With cutting, the longest item
is cut to the rest of a bin that nothing else fits, and a bin that another limit closes early, or a task's last one, goes to
sequences whose lengths are powers of two, so that nothing is padded.

Defined cases: a null or empty text has only the end id; a null doc_id is kept; repeated rows are packed each; a very long
text fills whole sequences (with cut off, a text beyond a limit is an error); an empty table gives no piece; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common
from framelake.llm.tokens import BATCH_CHARS, Encoder, batches


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


#: Items that one buffer holds at most, and bytes of their ids.
BUFFER_ITEMS, BUFFER_BYTES = 2000, 48 << 20


@dataclass
class Piece:
    """Tokens start to start + length of item, of which the last loss ones bear loss."""

    item: int
    start: int
    length: int
    loss: int


def _cut(piece: Piece, length: int) -> tuple[Piece, Piece]:
    """The first length tokens and the rest; loss-bearing tokens are the last ones of an item."""
    after = min(piece.loss, piece.length - length)
    return Piece(piece.item, piece.start, length, piece.loss - after), Piece(piece.item, piece.start + length, piece.length - length, after)


def pack(items: list[Piece], limits: Limits, cut: bool, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Bins of pieces, and the pieces that wait for more items (none if last)."""
    room = np.array([limits.tokens, limits.segments, limits.loss], float)
    bins: list[list[Piece]] = []
    waiting: list[Piece] = []
    for x in items:  # whole sequences of long items
        while x.length > limits.tokens or x.loss > limits.loss:
            if not cut:
                raise ValueError(f"an item of {x.length} tokens, {x.loss} of them with loss, fits no sequence")
            head = min(limits.tokens, x.length - x.loss + limits.loss)
            first, x = _cut(x, head)
            if first.length == limits.tokens:
                bins.append([first])
            else:
                waiting.append(first)
        waiting.append(x)
    size = np.array([[x.length, 1, x.loss] for x in waiting], float).reshape(-1, 3)
    share = size / room
    total = size[:, 0].sum()

    def remove(k):  # the last item takes its place
        nonlocal size, share
        waiting[k] = waiting[-1]
        waiting.pop()
        size[k], share[k] = size[-1], share[-1]
        size, share = size[:-1], share[:-1]

    while waiting and (last or total >= 2 * limits.tokens):
        free, content = room.copy(), []
        while waiting and free[0] >= 1 and free[1] >= 1:
            score = np.where((size[:, 0] <= free[0]) & (size[:, 2] <= free[2]), share @ (free / room), 0)
            best = int(score.argmax())
            if score[best] > 0:
                x = waiting[best]
                remove(best)
            elif cut:  # nothing fits as it is: the longest item fills the rest
                best = int(size[:, 0].argmax())
                x, rest = _cut(waiting[best], min(int(free[0]), waiting[best].length - 1))
                if x.loss > free[2] or x.length < 1:
                    break
                waiting[best] = rest
                size[best] = rest.length, 1, rest.loss
                share[best] = size[best] / room
            else:
                break
            content.append(x)
            free -= (x.length, 1, x.loss)
            total -= x.length
        # a bin that closes early, by another limit or at the end, is cut to powers of two, so that nothing is padded
        bins += _powers(content) if cut and free[0] else [content]
    return bins, waiting


def _powers(content: list[Piece]) -> list[list[Piece]]:
    """One bin as bins whose lengths are its length's powers of two."""
    left, out = sum(x.length for x in content), []
    queue = content[::-1]
    while left:
        need, own = 1 << (left.bit_length() - 1), []
        left -= need
        while need:
            x = queue.pop()
            if x.length > need:
                x, rest = _cut(x, need)
                queue.append(rest)
            own.append(x)
            need -= x.length
        out.append(own)
    return out


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])


def pack_documents(docs: DataFrame, path: str, end_id: int, limits: Limits = Limits(), cut: bool = True, prompt_col: str | None = None) -> DataFrame:
    """A row for each piece. prompt_col: leading text without loss (instruction data); all tokens of text bear loss.

    sequence_id is the task's number times 2^32 plus the sequence's number in it.
    """
    common.small_batches(docs.sparkSession)
    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    end = np.array([end_id], "<u4").tobytes()

    def run(parts):
        encoder, base, made = Encoder.of(path), TaskContext.get().partitionId() << 32, 0
        doc_of: dict[int, tuple] = {}
        buffer: list[Piece] = []
        serial = held = 0

        def flush(last):
            nonlocal buffer, made, held, doc_of
            bins, buffer = pack(buffer, limits, cut, last)
            rows = []
            for content in bins:
                at = 0
                for x in content:
                    doc, ids = doc_of[x.item]
                    rows.append((doc, x.start, x.length, zlib.crc32(ids[4 * x.start : 4 * (x.start + x.length)]), len(ids) // 4, base + made, at, x.loss))
                    at += x.length
                made += 1
            doc_of = {x.item: doc_of[x.item] for x in buffer}
            held = sum(len(ids) for _, ids in doc_of.values())
            for lo in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 20_000], strict=True)], schema=SCHEMA)

        for part in parts:
            for rows in batches(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True), lambda r: r[2], BATCH_CHARS, 10_000):
                heads = encoder.encode([r[1] for r in rows]) if prompt_col else [b""] * len(rows)
                for (doc, _, _), head, ids in zip(rows, heads, encoder.encode([r[2] for r in rows]), strict=True):
                    ids = head + ids + end
                    doc_of[serial] = doc, ids
                    buffer.append(Piece(serial, 0, len(ids) // 4, (len(ids) - len(head)) // 4))
                    serial += 1
                    held += len(ids)
                    if len(buffer) >= BUFFER_ITEMS or held >= BUFFER_BYTES:
                        yield from flush(False)
        yield from flush(True)
        common.trim()

    shape = ", ".join(f"`{n}` long" for n in SCHEMA.names)
    return docs.select(F.col("doc_id").cast("long"), prompt.alias("prompt"), "text").mapInArrow(run, shape)


def instruction_rows(conversations: DataFrame) -> DataFrame:
    """doc_id (conv_id times 2^24 plus the turn), prompt and text of each user turn and the assistant turn that follows it."""
    own = conversations.select("conv_id", "turn", "role", "text")
    asked = own.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return own.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select((F.shiftleft("conv_id", 24) + F.col("turn") - 1).alias("doc_id"), "prompt", "text")


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data, where limits on tokens, segments and loss-bearing tokens all bind."""
    import public_tokenizers

    rows = instruction_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return pack_documents(rows, public_tokenizers.path("byte_bpe_50k.json"), 1, Limits(2048, 16, 1024), prompt_col="prompt")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1)
