"""Token-id files with Re-Pair grammar compression, written and read by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.llm.bpe import default_tokenizer, encoder
from orogen.llm.common import chars_of, new_table, texts

SHARD = "part int, shard int, n_docs long, n_nulls long, n_ids long, first_rule int, doc_ids binary, lengths binary, rules binary, expansions binary, symbols binary"


def _narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds ``a``."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _bytes(a: np.ndarray) -> bytes:
    """A type code and the values, compressed."""
    a = _narrow(np.asarray(a))
    return bytes([a.itemsize]) + zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _array(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), f"<u{b[0]}").astype(np.int64)


def _frequent(seq: np.ndarray, live: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Among the pairs at places ``live``, those found at least ``least`` times, most frequent first, ties to the smaller: left and right symbols, and each place with its pair's rank."""
    bits, wide = np.uint64(symbols.bit_length()), np.uint64(len(seq).bit_length())
    keys = seq[live].astype(np.uint64)
    keys <<= bits
    keys |= seq[live + 1]
    packed = 2 * int(bits) + int(wide) <= 64  # pair and place sort as one number
    if packed:
        keys <<= wide
        keys |= live.astype(np.uint64)
        keys.sort()
        at, keys = keys, keys >> wide
    else:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], live[order]
    # In sorted order, a pair is frequent where the one ``least - 1`` places on is the same.
    runs = np.flatnonzero(keys[: len(keys) - least + 1] == keys[least - 1 :]) if len(keys) >= least else np.zeros(0, np.int64)
    found = keys[runs]
    new = np.ones(len(runs), bool)
    new[1:] = found[1:] != found[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(runs))) + least - 1
    starts = runs[starts]
    rank = np.argsort(-counts, kind="stable")
    rank_of = np.empty(len(rank), np.int64)
    rank_of[rank] = np.arange(len(rank))
    ends = np.cumsum(counts)
    at = at[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]
    if packed:
        at = (at & np.uint64((1 << int(wide)) - 1)).astype(np.int64)
    found = keys[starts[rank]]
    return (found >> bits).astype(np.int64), (found & np.uint64((1 << int(bits)) - 1)).astype(np.int64), at, np.repeat(rank_of, counts)


def repair(ids: np.ndarray, first_rule: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair of one shard: (symbols, rules), where rule k makes symbol ``first_rule + k`` of a pair.

    Each round counts pairs of neighbours exactly and replaces frequent ones (at least ``least``
    times) by new symbols, until no pair is that frequent; neither rounds nor rules are bounded. A
    symbol takes the side that it has in its most frequent pair, ties to the smaller pair, and a round
    replaces the pairs whose symbols both stand on their sides, so that replacements never overlap;
    the most frequent pair is always among them. A pair of equal symbols goes when it is the most
    frequent of its symbol, from the start of each run. Counts of old pairs only fall, so after the
    first round only places with a new symbol or with a frequent pair left over are counted.
    """
    seq, rules, nxt = ids.astype(np.uint32), [], first_rule
    live = np.arange(max(0, len(seq) - 1))
    while len(live):
        left, right, at, pair = _frequent(seq, live, nxt, least)
        n = len(left)
        if not n:
            break
        k = np.arange(n)
        best = np.full((2, nxt), n)  # each symbol's best rank as left and as right
        best[0, left[::-1]] = k[::-1]
        best[1, right[::-1]] = k[::-1]
        # A symbol whose best pair is of itself alone has two equal ranks, and so no side in other pairs.
        taken = (best[0, left] < best[1, left]) & (best[1, right] < best[0, right])
        taken |= (left == right) & (best[0, left] == k) & (best[1, left] == k)
        number = np.cumsum(taken) - 1
        waiting = at[~taken[pair]]
        at, pair = at[taken[pair]], pair[taken[pair]]
        equal = np.flatnonzero(left[pair] == right[pair])
        if len(equal):  # runs of a repeated symbol: every other place, from the run's start
            equal = equal[np.argsort(at[equal])]
            place = at[equal]
            first = np.concatenate(([True], (np.diff(place) != 1) | (seq[place[1:]] != seq[place[:-1]])))
            begin = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            keep = np.ones(len(at), bool)
            keep[equal[(np.arange(len(place)) - begin) % 2 == 1]] = False
            at, pair = at[keep], pair[keep]
        seq[at] = (nxt + number[pair]).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        seq = seq[stay]
        touched = np.zeros(len(seq), bool)
        touched[place[waiting[stay[waiting]]]] = touched[place[at]] = True
        touched[np.maximum(place[at] - 1, 0)] = True
        live = np.flatnonzero(touched[:-1])
        rules.append(np.stack((left[taken], right[taken]), 1))
        nxt += int(taken.sum())
    return seq.astype(np.int64), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansions(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for."""
    size: list[int] = []
    for a, b in rules.tolist():
        size.append((size[a - first_rule] if a >= first_rule else 1) + (size[b - first_rule] if b >= first_rule else 1))
    return np.array(size, np.int64)


def _by_level(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for, a level of rules at a time."""
    while len(rules):
        is_rule = symbols >= first_rule
        if not is_rule.any():
            break
        at = np.cumsum(1 + is_rule) - 1 - is_rule
        out = np.empty(len(symbols) + int(is_rule.sum()), np.int64)
        out[at[~is_rule]] = symbols[~is_rule]
        pair = rules[symbols[is_rule] - first_rule]
        out[at[is_rule]], out[at[is_rule] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for. With the rules' expansion lengths, and where those sum to no more than a few times the symbols, each rule is expanded once and then copied."""
    if sizes is None or not len(rules) or sizes.sum() > 8 * len(symbols):
        return _by_level(symbols, rules, first_rule)
    used = np.flatnonzero(np.bincount(symbols[symbols < first_rule], minlength=1))
    table = np.concatenate((used, _by_level(np.arange(first_rule, first_rule + len(rules)), rules, first_rule)))
    row = np.zeros(first_rule + len(rules), np.int64)
    row[used] = np.arange(len(used))
    row[first_rule:] = len(used) + np.arange(len(rules))
    lists = pa.LargeListArray.from_arrays(np.concatenate((np.arange(len(used)), len(used) + np.concatenate(([0], np.cumsum(sizes))))), pa.array(table.astype(np.uint32)))
    return lists.take(pa.array(row[symbols])).flatten().to_numpy().astype(np.int64)


def slice_ids(row, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard row without expanding the rest: expansion lengths find the symbols."""
    symbols, size, rules, first = _array(row["symbols"]), _array(row["expansions"]), _array(row["rules"]).reshape(-1, 2), row["first_rule"]
    length = np.ones(len(symbols), np.int64)
    length[symbols >= first] = size[symbols[symbols >= first] - first]
    ends = np.cumsum(length)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, first)[start - before : stop - before]


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, shard_ids: int = 1_000_000, part_chars: int = 16_000_000) -> None:
    """Write the ids of all documents, each closed by ``end_id``, in ascending doc_id order.

    Documents are range-partitioned and sorted by doc_id (then text, for repeated ids; null ids
    first). Each task cuts its documents into shards of at least ``shard_ids`` ids; a shard is one
    row of a Parquet file: its documents' ids and lengths, and a Re-Pair grammar (rules,
    expansion lengths, symbols). Nulls and empty texts hold ``end_id`` alone. Repeated rows are documents of
    their own; a text longer than a shard is a shard by itself; other columns are not read.
    """
    path = path or default_tokenizer()
    layout = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SHARD.split(", ")])
    docs = texts(docs)
    _, chars = chars_of(docs)
    n = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-chars // part_chars))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(path)
        first = max(own.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        end = np.array([end_id], own.type)
        part, number, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard():
            symbols, rules = repair(np.concatenate(held), first)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [number], "n_docs": [len(ids)], "n_nulls": [sum(i is None for i in ids)], "n_ids": [size], "first_rule": [first], "doc_ids": [np.array([i or 0 for i in ids], "<i8").tobytes()], "lengths": [_bytes([len(x) for x in held])], "rules": [_bytes(rules.ravel())], "expansions": [_bytes(expansions(rules, first))], "symbols": [_bytes(symbols)]}, layout)

        for batch in batches:
            for i, found in zip(batch.column("doc_id").to_pylist(), own.encode_many(batch.column("text").to_pylist()), strict=True):
                ids.append(i)
                held.append(np.concatenate((found, end)))
                size += len(held[-1])
                if size >= shard_ids:
                    yield shard()
                    number, ids, held, size = number + 1, [], [], 0
        if ids:
            yield shard()

    docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shards, SHARD).write.parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of files by ``write``."""
    rows = spark.read.parquet(path)
    # Ids before each shard: running sums within parts, within blocks of a thousand parts, and over the blocks' totals.
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("block", F.expr("part div 1000"))
    blocks = totals.groupBy("block").agg(F.sum("ids").alias("all")).withColumn("ahead", F.sum("all").over(Window.orderBy("block")) - F.col("all"))
    before = totals.withColumn("inside", F.sum("ids").over(Window.partitionBy("block").orderBy("part")) - F.col("ids")).join(blocks, "block").select("part", (F.col("ahead") + F.col("inside")).alias("before"))
    within = Window.partitionBy("part").orderBy("shard")
    placed = rows.select("part", "shard", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("inside")).join(before, "part")
    starts = placed.select("part", "shard", (F.col("before") + F.col("inside")).alias("first"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(_array(row["symbols"]), _array(row["rules"]).reshape(-1, 2), row["first_rule"], _array(row["expansions"])).astype("<u4")
                lengths = _array(row["lengths"])
                ends = np.cumsum(lengths)
                names = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.arange(row["n_docs"]) < row["n_nulls"])
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.join(starts, ["part", "shard"]).mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files into the shared folder and return what ``read`` gets from them."""
    spark = docs.sparkSession
    out = new_table(spark, "token-files")
    write(docs, out, path)
    return read(spark, out)
