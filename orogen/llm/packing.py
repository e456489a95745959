"""Best-fit packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import default_tokenizer, encoder
from orogen.llm.common import stored, texts

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Cut each document's ids (closed by ``end_id``) into pieces of ``size``; only the first may be shorter."""
    path = path or default_tokenizer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Packing may be the last of many stages whose workers and heap are still there, so it holds few words and little text at a time.
        pa.default_memory_pool().release_unused()
        own = encoder(path, limit=300_000)
        for frame in frames:
            out = []
            for i, ids in zip(frame["doc_id"], own.encode_many(frame["text"], chars=2_000_000), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                first = (len(ids) - 1) % size + 1
                cuts = [0, *range(first, len(ids) + 1, size)]
                out += [(i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()

    return texts(docs).mapInPandas(run, PIECE)


def best_fit(lengths: np.ndarray, size: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Vector best-fit decreasing of one block: (bin, offset) of each item.

    A bin has three capacities: tokens, documents and attention cost (the sum of squared
    lengths). Items go by falling length, ties by position. Of the open bins whose residual
    holds the item in every dimension, ``norm`` takes the one whose weighted residual after
    placement, each dimension as a share of its capacity, has the least norm; ``dot`` takes the
    one with the largest weighted dot product of item and residual. Ties go to the oldest bin. A
    new bin opens only if none fits. Bins without room for a token or a document close.
    """
    full = np.array([size, max_docs, max_attention], np.int64)
    item = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1).astype(np.int64)
    if (item > full).any():
        raise ValueError("an item exceeds a bin's capacity")
    w = np.array(weights) / full
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # Bins with the same residual are alike: one row for each, with a queue of its bins.
    rest = np.empty((64, 3), np.int64)
    row_of: dict[tuple[int, int, int], int] = {}
    queue: list[list[int]] = []
    spare: list[int] = []
    used = n_bins = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = item[k]
        fits = (rest[:used] >= need).all(1)
        at = np.flatnonzero(fits)
        if len(at):
            left = (rest[at] - need) * w if rule == "norm" else -(rest[at] * w) * (need * w)
            value = (left * left).sum(1) if rule == "norm" else left.sum(1)
            best = at[value == value.min()]
            row = min(best.tolist(), key=lambda r: queue[r][0])
            b = queue[row].pop(0)
            now = rest[row] - need
            offset[k] = size - rest[row, 0]
            if not queue[row]:
                del row_of[tuple(rest[row].tolist())]
                rest[row] = -1
                spare.append(row)
        else:
            b, now = n_bins, full - need
            n_bins += 1
            offset[k] = 0
        place[k] = b
        if now[0] > 0 and now[1] > 0:
            key = tuple(now.tolist())
            row = row_of.get(key)
            if row is None:
                if spare:
                    row = spare.pop()
                else:
                    row = used
                    used += 1
                    queue.append([])
                    if used > len(rest):
                        rest = np.concatenate((rest, np.empty_like(rest)))
                row_of[key] = row
                rest[row] = now
            queue[row].append(b)
            queue[row].sort()
    return place, offset


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0, max_docs: int = 2048, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), block: int = 16_384, rule: str = "norm") -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Full pieces are sequences of their own. The rest (one piece a document at most) is dealt at
    random, by a hash, into blocks of about ``block`` pieces, each packed by vector best-fit in a
    task; a block leaves one sequence part empty or so, which costs about 1 in ``block`` / 2.

    ``weights`` are those of tokens, documents and attention cost in the residual norm (or dot
    product) that picks a sequence; by default all three count alike. ``max_docs`` and ``max_attention`` (default:
    the square of ``size``) are constraints of their own. Their defaults are the least that any set of
    pieces within ``size`` tokens keeps, since the fewest sequences are asked for; lower ones hold
    too, unless one piece alone exceeds them, which raises.

    A null or empty text is its end id alone. Repeated rows are packed as documents of their own; a null
    doc_id stays null. A text of any length is cut, never shortened. An empty table gives no rows; other columns are not
    read. Blocks are told by row places in the stored pieces, so that equal rows spread too.
    """
    cut = stored(pieces(docs, path, end_id, size), "pieces")
    max_attention = max_attention or size * size
    spread = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())
    full = cut.where(F.col("length") == size)
    rest = cut.where(F.col("length") < size)
    blocks = max(1, -(-rest.count() // block))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        place, offset = best_fit(frame["length"].to_numpy(np.int64), size, max_docs, max_attention, weights, rule)
        return frame.drop(columns="block").assign(sequence_id=(place << 31) + int(key[0]), offset=offset)

    out = f"{PIECE}, sequence_id long, offset long"
    shared = rest.withColumn("block", F.pmod(spread, F.lit(blocks))).groupBy("block").applyInPandas(packed, out)
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return shared.unionByName(alone)
