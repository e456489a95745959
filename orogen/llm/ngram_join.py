"""Similarity join of documents on word shingles, with count-vector R-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import _texts_by_chunk, packed, unpacked
from orogen.llm.common import chars_of, stored, texts
from orogen.llm.graph import components

#: A pair links when 7 times the intersection reaches 3 times the sum of the sizes: a Jaccard similarity of 0.75.
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; word hashes are kept for the task, up to a bound."""

    def __init__(self, size: int = 5, limit: int = 400_000):
        self.size, self.limit, self.kept = size, limit, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.frombuffer(xxhash.xxh3_64_digest(b" ".join(words), 1), ">u8").astype(np.uint64)
        kept = self.kept
        if len(kept) > self.limit:
            kept.clear()
        try:
            run = b"".join([kept[w] for w in words])
        except KeyError:
            for w in words:
                if w not in kept:
                    kept[w] = xxhash.xxh3_64_digest(w)
            run = b"".join([kept[w] for w in words])
        one = np.frombuffer(run, ">u8").astype(np.uint64)
        n = len(one) - self.size + 1
        mix = one[:n].copy()
        for k in range(1, self.size):
            mix *= _MUL
            mix ^= mix >> np.uint64(29)
            mix += one[k : k + n]
        mix *= _MUL
        mix ^= mix >> np.uint64(32)
        mix *= _MUL
        return np.unique(mix)


def _sign(own: np.ndarray) -> int:
    """A set's share of its chunk's sum."""
    return xxhash.xxh3_64_intdigest(own.tobytes())


# ----- which documents may link at all -----------------------------------------------------


def shingled(docs: DataFrame, chunk_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_shingles, and for documents that may link ``digest`` and ``hashes`` of the set.

    A document that links has at most a quarter of its shingles to itself. Chunks of documents
    send their distinct shingles, packed by range, to where each range meets; those seen in two chunks
    go back to the chunks that hold them, with how many do. Each chunk then counts, for every document,
    the shingles that another document has (here or elsewhere): documents with too few are out. A common
    shingle moves once a chunk, however many documents hold it. ``hashes`` begin with the set's
    prefix, its ``n // 4 + 1`` first shingles by number of chunks and hash, rare ones first.

    The documents are read twice, and a chunk is a run of a task's rows, so ``docs`` should be a stored table. Each
    chunk sends a sum over its sets along; a second reading that meets other rows raises instead of losing links.
    """
    docs = texts(docs)
    _, chars = chars_of(docs)
    bits = max(8, int(np.ceil(np.log2(max(2, chars / 3_000_000)))))
    low = np.uint64((1 << (48 - bits)) - 1)

    def pack(a: np.ndarray) -> bytes:
        return np.ascontiguousarray((a & low).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()

    def unpack(b: bytes) -> np.ndarray:
        wide = np.zeros((len(b) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
        return wide.view("<u8").ravel()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, parts, total = Shingler(), [], 0

        def flush(number: int) -> pa.RecordBatch:
            every = np.unique(np.concatenate(parts))
            bucket = (every >> np.uint64(48 - bits)).astype(np.int64)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            values = [pack(every[a:b]) for a, b in zip(edges, [*edges[1:], len(every)][: len(edges)], strict=True)]
            # The chunk's sum goes by a bucket of its own, of some thousand.
            buckets, values = [*bucket[edges].tolist(), -1 - number % 4096], [*values, total.to_bytes(8, "little")]
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(np.full(len(values), number)), pa.array(values, pa.binary())], ["bucket", "chunk", "values"])

        for number, last, _, t in _texts_by_chunk(batches, chunk_chars):
            own = shingle(t)
            total = (total + _sign(own)) % 2**64
            parts.append(own >> np.uint64(16))
            if last:
                yield flush(number)
                parts, total = [], 0
        if parts:
            yield flush(number)

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] < 0:
            return frame.assign(held=b"")
        parts = [unpack(b) for b in frame["values"]]
        every = np.sort(np.concatenate(parts))
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        counts = np.diff(np.append(starts, len(every)))
        twice, counts = every[starts[counts > 1]], np.minimum(counts[counts > 1], 65_535).astype("<u2")
        values, held = [], []
        for p in parts:
            at = np.searchsorted(twice, p)
            at[at == len(twice)] = 0
            hit = twice[at] == p if len(twice) else np.zeros(len(p), bool)
            values.append(pack(p[hit]))
            held.append(counts[at[hit]].tobytes())
        return frame[["bucket", "chunk"]].assign(values=values, held=held)[[len(v) > 0 for v in values]]

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("hashes", pa.binary())])

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        signs = right.filter(pc.less(right["bucket"], 0))["values"].to_pylist()
        right = right.filter(pc.greater_equal(right["bucket"], 0))
        far = [unpack(v) | np.uint64(b << (48 - bits)) for b, v in zip(right["bucket"].to_pylist(), right["values"].to_pylist(), strict=True)]
        far = np.concatenate(far) if far else np.zeros(0, np.uint64)
        held = np.frombuffer(b"".join(right["held"].to_pylist()), "<u2").astype(np.int64)
        order = np.argsort(far)
        far, held = far[order], held[order]
        shingle, rows = Shingler(), {"doc_id": [], "n_shingles": [], "digest": [], "hashes": []}
        ids, sets = [], []
        for payload in left["payload"]:
            for i, t in unpacked(payload.as_py()):
                ids.append(i)
                sets.append(shingle(t))
        if signs != [(sum(map(_sign, sets)) % 2**64).to_bytes(8, "little")]:
            raise RuntimeError("a second reading of the documents met other rows: store them first")
        near = np.sort(np.concatenate(sets) >> np.uint64(16)) if sets else far
        near = near[1:][near[1:] == near[:-1]]
        for i, full in zip(ids, sets, strict=True):
            own = full >> np.uint64(16)
            at, by = np.searchsorted(far, own), np.searchsorted(near, own)
            at[at == len(far)] = 0
            by[by == len(near)] = 0
            abroad = far[at] == own if len(far) else np.zeros(len(own), bool)
            here = near[by] == own if len(near) else np.zeros(len(own), bool)
            may = len(full) > 0 and i is not None and int((abroad | here).sum()) >= len(full) - len(full) // 4
            rows["doc_id"].append(i)
            rows["n_shingles"].append(len(full))
            rows["digest"].append(xxhash.xxh3_128_digest(full.tobytes()) if may else None)
            if may:
                full = full[np.lexsort((full, np.where(abroad, held[at], 1)))] if len(far) else full
            rows["hashes"].append(full.tobytes() if may else None)
        return pa.table(rows, schema=schema)

    back = docs.mapInArrow(sent, "bucket long, chunk long, values binary").groupBy("bucket").applyInPandas(lambda f: met(f), "bucket long, chunk long, values binary, held binary")
    return packed(docs, chunk_chars).groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(judged, "doc_id long, n_shingles long, digest binary, hashes binary")


# ----- count vectors ------------------------------------------------------------------------


class CountTree:
    """R-tree over count vectors: shingle hashes fall into ``groups`` groups, a set is the point of its group counts.

    Points are packed by size into leaves of ``fan``, leaves into nodes of ``fan``. The overlap of a
    query with any set below a node is at most the sum of the smaller coordinates of the query and
    the node's upper corner.
    """

    def __init__(self, sets: list[np.ndarray], groups: int = 64, fan: int = 16):
        self.sets, self.fan = sets, fan
        self.size = np.array([len(s) for s in sets], np.int64)
        self.points = np.stack([np.bincount(((s >> np.uint64(11)) % np.uint64(groups)).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)
        self.order = np.lexsort((*self.points[:, :4].T, self.size))
        cut = np.arange(0, len(sets), fan)
        self.leaf_high = np.maximum.reduceat(self.points[self.order], cut)
        self.leaf_least, self.leaf_most = (f.reduceat(self.size[self.order], cut) for f in (np.minimum, np.maximum))
        cut = np.arange(0, len(cut), fan)
        self.node_high = np.maximum.reduceat(self.leaf_high, cut)
        self.node_least, self.node_most = np.minimum.reduceat(self.leaf_least, cut), np.maximum.reduceat(self.leaf_most, cut)

    @staticmethod
    def _may(q: np.ndarray, n: int, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        fits = (4 * most >= 3 * n) & (3 * least <= 4 * n)
        return fits & (7 * np.minimum(high, q).sum(1) >= 3 * (n + least))

    def near(self, q: np.ndarray, n: int) -> np.ndarray:
        """Members whose bound reaches what a link with a set of size ``n`` at point ``q`` needs."""
        nodes = np.flatnonzero(self._may(q, n, self.node_high, self.node_least, self.node_most))
        if not len(nodes):
            return nodes
        leaves = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
        leaves = leaves[leaves < len(self.leaf_high)]
        leaves = leaves[self._may(q, n, self.leaf_high[leaves], self.leaf_least[leaves], self.leaf_most[leaves])]
        at = (leaves[:, None] * self.fan + np.arange(self.fan)).ravel()
        at = self.order[at[at < len(self.order)]]
        return at[self._may(q, n, self.points[at], self.size[at], self.size[at])]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def joined(sets: list[np.ndarray], group: np.ndarray, asks: np.ndarray | None = None) -> np.ndarray:
    """``group`` with groups of linked sets merged (to the least number); only pairs in different groups are verified, one side of them in ``asks``."""
    group = group.copy()
    tree = CountTree(sets)
    for i in range(len(sets)) if asks is None else asks.tolist():
        near = tree.near(tree.points[i], int(tree.size[i]))
        while len(near := near[group[near] != group[i]]):
            j = int(near[0])
            near = near[1:]
            if 7 * _overlap(sets[i], sets[j]) >= 3 * int(tree.size[i] + tree.size[j]):
                a, b = sorted((int(group[i]), int(group[j])))
                group[group == b] = a
    return group


def _sets(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.sort(np.frombuffer(b, np.uint64)) for b in frame["hashes"]]


# ----- the join -----------------------------------------------------------------------------


def families(may: DataFrame, classes: DataFrame) -> DataFrame:
    """node (a doc_id) and component: documents whose sets are equal or share a prefix shingle, directly or through others.

    Sets that link share one of the first ``n - ceil(3n / 4) + 1`` shingles of each in any one
    order of all shingles, so no link leaves a family. A shingle ties its documents to the least of them.
    """
    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            own = [np.frombuffer(b, np.int64)[: len(b) // 32 + 1] for b in frame["hashes"]]
            yield pd.DataFrame({"h": np.concatenate(own), "node": np.repeat(frame["doc_id"].to_numpy(), list(map(len, own)))})

    rows = may.select("doc_id", "hashes").mapInPandas(prefixes, "h long, node long")
    least = rows.groupBy("h").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m < x").select("h", "m")
    tied = rows.join(least, "h").select(F.col("node").alias("a"), F.col("m").alias("b"))
    equal = may.select("digest", F.col("doc_id").alias("a")).join(classes, "digest").select("a", F.col("node").alias("b"))
    return components(tied.union(equal))


def link(docs: DataFrame, small: int = 1024, block: int = 512) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link at a Jaccard similarity of 0.75 or more of their sets of five-word shingles;
    a component is named by its least doc_id. 1. Documents that can't link are set aside
    (``shingled``). 2. Equal sets become one class, at its least doc_id. 3. Classes fall into families that
    no link leaves. 4. A family of up to ``small`` classes is joined in one task, with many
    others: an R-tree over count vectors gives, for each set, those whose overlap bound
    suffices, and these are verified exactly unless already connected. 5. Larger families are dealt
    into blocks of about ``block``; each is joined along with the family's first block. Classes then
    outside the family's largest component are held against every block whose sets are of a size that may
    link with theirs. So a group of near copies of any size takes time in proportion to it, and no link is lost.

    Null or empty texts have no shingles and link with nothing; a null doc_id has no component.
    Rows that repeat a doc_id are one document to links.
    """
    rows = stored(shingled(docs), "shingled")
    may = rows.where("digest is not null")
    classes = stored(may.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    found = families(may, classes).join(classes.select("node").distinct(), "node")
    found = stored(found.join(found.groupBy("component").agg(F.count("*").alias("members")).where("members > 1"), "component"), "families")
    counts = found.agg(F.count_if(F.col("members") <= small).alias("many"), F.count_if(F.col("members") > small).alias("large")).first()
    # Of equal sets only the class's document goes on.
    members = stored(may.join(found, F.col("doc_id") == F.col("node")).join(classes.withColumnRenamed("node", "first"), "digest").where("first = doc_id").select("node", "component", "members", "digest", "hashes").dropDuplicates(["node", "digest"]).drop("digest"), "members")
    many = members.where(F.col("members") <= small)
    blocks = max(256, -(-counts["many"] // 1000))

    def alone(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.groupby("component", sort=False):
            own = own.sort_values("node", ignore_index=True)
            names, same = np.unique(own["node"].to_numpy(), return_inverse=True)
            out.append(pd.DataFrame({"a": own["node"], "b": names[joined(_sets(own), same)]}))
        return pd.concat(out)

    tied = many.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks))).groupBy("block").applyInPandas(lambda f: alone(f), "a long, b long")
    tied = stored(tied.where("a <> b"), "tied")
    large = members.where(F.col("members") > small)
    if not counts["large"]:
        labels = tied.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    else:
        labels = tied.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(_large(large, block))
    labels = labels.dropDuplicates(["node"])
    named = may.join(classes.select("digest", "node"), "digest").join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "node").alias("component_id"))
    return named.union(rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _large(members: DataFrame, block: int) -> DataFrame:
    """node and component_id of families of any size."""
    count = F.ceil(F.col("members") / block)
    own = members.withColumn("block", F.pmod(F.xxhash64("node"), count))
    hub = own.where("block = 0").withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), count - 1)))
    cols = ["component", "block", "node", "hashes"]

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        names, same = np.unique(frame["node"].to_numpy(), return_inverse=True)
        return pd.DataFrame({"a": frame["node"], "b": names[joined(_sets(frame), same)]})

    first = own.select(cols).union(hub.select(cols)).groupBy("component", "block").applyInPandas(lambda f: together(f), "a long, b long")
    label = stored(components(first).withColumnRenamed("component", "label"), "labels")
    placed = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    weight = placed.groupBy("component", "label").agg(F.count("*").alias("k"))
    main = weight.groupBy("component").agg(F.max(F.struct("k", (-F.col("label")).alias("l"))).alias("m")).select("component", (-F.col("m.l")).alias("main"))
    placed = stored(placed.join(main, "component"), "placed")
    # Sets that link differ in size by a factor of 4 / 3 at most, so by one such class at most.
    size_class = F.floor(F.log(F.octet_length("hashes") / 8) / math.log(4 / 3 * (1 + 1e-9))).cast("int")
    placed_by_size = placed.withColumn("size_class", size_class)
    outside = placed_by_size.where("label <> main")
    near = F.explode(F.array(*[F.col("size_class") + k for k in (-1, 0, 1)])).alias("met")
    number = lambda rows: rows.groupBy("component", "size_class").agg(F.ceil(F.count("*") / block).alias("n"))
    blocks, asks = number(placed_by_size), number(outside)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own_block, own_ask = F.pmod(F.xxhash64("node"), F.col("n")), F.pmod(F.xxhash64("label", "node"), F.col("n"))
    cols = ["component", "class", "block", "asking", "ask", "side", "node", "label", "hashes"]
    # A task holds one block of a size class and one asking block of the same or a neighbouring class.
    left = outside.join(asks, ["component", "size_class"]).withColumn("ask", own_ask).drop("n").select("*", near)
    left = left.withColumnRenamed("size_class", "asking").join(blocks.withColumnRenamed("size_class", "met"), ["component", "met"])
    left = left.withColumn("block", every("n")).withColumn("side", F.lit(0)).withColumnRenamed("met", "class")
    right = placed_by_size.join(blocks, ["component", "size_class"]).withColumn("block", own_block).drop("n").select("*", near)
    right = right.withColumnRenamed("size_class", "class").join(asks.withColumnRenamed("size_class", "met"), ["component", "met"])
    right = right.withColumn("ask", every("n")).withColumn("side", F.lit(1)).withColumnRenamed("met", "asking")

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        asking = frame["side"].to_numpy() == 0
        if not asking.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        names, group = np.unique(frame["label"].to_numpy(), return_inverse=True)
        new = joined(_sets(frame), group, np.flatnonzero(asking))
        return pd.DataFrame({"a": names[group], "b": names[new]}).drop_duplicates()

    extra = left.select(cols).union(right.select(cols)).groupBy("component", "class", "block", "asking", "ask").applyInPandas(lambda f: across(f), "a long, b long")
    merged = components(extra).select(F.col("node").alias("label"), F.col("component").alias("to"))
    return placed.select("node", "label").join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("component_id"))
