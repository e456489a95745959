"""Prefix trie of conversations: LCP-aware mergesort in ranges, a stack of open nodes, and ranges combined along their edges."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import stored

#: Turns of a sorted run.
RUN = 20_000
#: Neighbouring ranges whose edges are combined by one task.
FAN = 64
#: Conversations of one block of a node's ends, where the node spans ranges.
BLOCK = 50_000

Record = tuple[list[bytes], int, list[int]]  # turns' digests, conv_id, turns' words


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``: digest (16 bytes of SHA-256 over role and text) and number of words of each turn, in order.

    Turns are ordered by turn, null first, then by digest. A null role or text becomes an empty one; rows without a conv_id belong to no
    conversation. Digests are taken before rows move, so no text is shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, 16)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.cast("int").alias("words")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return slim.groupBy("conv_id").agg(ordered.alias("turns"))


def shared_starts(found: DataFrame, step: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % ``step``, h = crc32(c) % ``most``.

    All of them if it has fewer, none if it is absent; then the own turns after the first h follow.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = found.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = found.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % step)
    start = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(dict(found.dtypes)["turns"]))
    return own.join(heads, "base", "left").select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def common_length(a: list[bytes], b: list[bytes], at: int = 0) -> int:
    """Turns that two sequences share at their start, of which the first ``at`` are known to be equal."""
    most = min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    return at


def sorted_run(records: list[Record]) -> list[tuple[Record, int]]:
    """The records in order of their turns, then of conv_id, each with the number of turns it shares with the one before."""
    records.sort(key=lambda r: r[:2])
    return [(r, common_length(records[i - 1][0], r[0]) if i else 0) for i, r in enumerate(records)]


def merged(runs: list[list[tuple[Record, int]]]) -> Iterator[tuple[Record, int]]:
    """The records of sorted runs in order, each with the number of turns it shares with the one before, by a loser tree.

    Every contender carries how much it shares with the last record put out. Of two contenders the one
    that shares more comes first, without a look at the turns; where they share the same, turns are compared from there on and
    the loser keeps what it shares with the winner. Turns known to be equal are never compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    now: list[Record | None] = [None] * k
    lcp = [0] * k

    def advance(i: int) -> None:
        got = next(streams[i], None)
        now[i], lcp[i] = got if got else (None, 0)

    def plays(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        m = common_length(x[0], y[0], lcp[a])
        first = (x[0][m : m + 1], x[1]) <= (y[0][m : m + 1], y[1])
        a, b = (a, b) if first else (b, a)
        lcp[b] = m
        return a, b

    for i in range(k):
        advance(i)
    losers = [0] * k
    level = list(range(k))
    while len(level) > 1:  # the first tournament: leaves k..2k-1, inner nodes k-1..1
        at, winners = len(level) // 2, []
        for j in range(at):
            w, losers[at + j] = plays(level[2 * j], level[2 * j + 1])
            winners.append(w)
        level = winners
    w = level[0]
    while now[w] is not None:
        yield now[w], lcp[w]
        advance(w)
        j = (w + k) // 2
        while j:
            w, losers[j] = plays(w, losers[j])
            j //= 2


@dataclass
class Node:
    """An open node of the trie: what its closed children and its ending conversations add up to."""

    depth: int
    words: int
    edge: bool
    convs: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: array = field(default_factory=lambda: array("q"))
    below: list = field(default_factory=list)  # rows of closed children, which wait for this node's least conv_id

    def join(self, conv_id: int, n: int) -> None:
        self.convs += n
        self.least = conv_id if self.least is None else min(self.least, conv_id)


def path_ids(keys: list[bytes]) -> list[bytes]:
    """For each depth an id of the sequence of turns up to it: hashes of 16 bytes, chained."""
    out = [b"\0" * 16]
    for k in keys:
        out.append(hashlib.blake2b(out[-1] + k, digest_size=16).digest())
    return out


def ends_digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


#: Rows of ranges: whole nodes ("node"; ``parent`` only where the parent is an edge), nodes on a range's edges ("edge"), and ends of those ("ends").
_ROWS = pa.schema([
    ("kind", pa.string()), ("part", pa.int64()), ("id", pa.binary()), ("parent", pa.binary()), ("on_first", pa.bool_()), ("on_last", pa.bool_()), ("words", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary()),
])
_DDL = "kind string, part long, id binary, parent binary, on_first boolean, on_last boolean, words long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
_EDGE = [c.split()[0] for c in _DDL.split(", ") if c.split()[0] not in ("kind", "parent_conv_id", "ends_sha256", "ends")]


def nodes_of(stream: Iterator[tuple[Record, int]], part: int) -> Iterator[dict]:
    """Rows of the trie over one range of sorted records.

    A stack holds the path of the last record. A node is finished when a record comes that doesn't share
    it; it then adds to its parent and waits there until the parent is finished too. Nodes on the path of the range's first or last
    record may go on in other ranges: they leave their sums as edge rows, to be combined.
    """
    stack: list[Node] = []
    first: list[bytes] = []
    first_ids: list[bytes] = []
    last: list[bytes] = []

    def close(ids: list[bytes] | None) -> Iterator[dict]:
        """Close the deepest node; ``ids`` are those of the last record's path where it lies on that."""
        node = stack.pop()
        above = stack[-1] if stack else None
        if above:
            above.join(node.least, node.convs)
        if not node.edge and ids is None:
            leaves = node.leaves or 1
            saved = node.saved + (node.convs - 1) * node.words
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            for row in node.below:
                yield row | {"parent_conv_id": node.least}
            above.below.append({"kind": "node", "part": part, "conv_id": node.least, "depth": node.depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends_digest(node.ends)})
            return
        own = first_ids if node.edge else ids
        d = node.depth
        for row in node.below:
            yield row | {"parent": own[d]}
        on_last = ids is not None and (not node.edge or ids[d] == first_ids[d])
        yield {"kind": "edge", "part": part, "id": own[d], "parent": own[d - 1] if d else None, "on_first": node.edge, "on_last": on_last, "words": node.words, "conv_id": node.least, "depth": d, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        for at in range(0, len(node.ends), BLOCK):
            block = node.ends[at : at + BLOCK]
            yield {"kind": "ends", "part": part, "id": own[d], "conv_id": block[0], "ends": block.tobytes()}

    for (keys, conv_id, words), shared in stream:
        if not stack:
            first, first_ids = keys, path_ids(keys)
            stack.append(Node(0, 0, True))
            stack += [Node(d + 1, w, True) for d, w in enumerate(words)]
        else:
            while stack[-1].depth > shared:
                yield from close(None)
            stack += [Node(d + 1, words[d], False) for d in range(shared, len(keys))]
        stack[-1].join(conv_id, 1)
        stack[-1].ends.append(conv_id)
        last = keys
    ids = first_ids if last is first else path_ids(last)
    while stack:
        yield from close(ids)


def ranges(found: DataFrame, partitions: int) -> DataFrame:
    """Rows of all ranges (``_ROWS``): conversations go to ranges of equal size by turns and conv_id; each range is sorted and merged in its task."""
    keyed = found.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple[Record, int]]] = []
        held: list[Record] = []
        size = 0
        for batch in batches:
            for keys, conv_id, words in zip(batch.column("keys").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                held.append((keys, conv_id, words))
                size += len(keys) + 1
                if size >= RUN:
                    runs.append(sorted_run(held))
                    held, size = [], 0
        if held:
            runs.append(sorted_run(held))
        rows: list[dict] = []
        for row in nodes_of(merged(runs), TaskContext.get().partitionId()) if runs else ():
            rows.append(row)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    return keyed.repartitionByRange(partitions, "keys", "conv_id").mapInArrow(run, _DDL)


def combined(rows: list[dict], last_round: bool) -> list[dict]:
    """Edge rows of neighbouring ranges as those of one range; those within it, and all in the last round, are finished (``kind`` node)."""
    rows.sort(key=lambda r: (r["part"], r["depth"]))
    low, high = rows[0]["part"], rows[-1]["part"]
    nodes: dict[bytes, dict] = {}
    for r in rows:
        on_first, on_last = r["on_first"] and r["part"] == low, r["on_last"] and r["part"] == high
        n = nodes.get(r["id"])
        if n is None:
            nodes[r["id"]] = r | {"on_first": on_first, "on_last": on_last}
            continue
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            n[c] += r[c]
        n["conv_id"] = min(n["conv_id"], r["conv_id"])
        n["on_first"] |= on_first
        n["on_last"] |= on_last
    for n in sorted(nodes.values(), key=lambda n: -n["depth"]):
        if not last_round and (n["on_first"] or n["on_last"]):
            n["kind"] = "edge"
            continue
        n["kind"] = "node"
        n["n_leaves"] = n["n_leaves"] or 1
        n["saved_tokens"] += (n["n_convs"] - 1) * n["words"]
        above = nodes.get(n["parent"])
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += n["n_leaves"]
            above["saved_tokens"] += n["saved_tokens"]
    return list(nodes.values())


def _combining(final: bool):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(combined(frame.to_dict("records"), final), columns=["kind", *_EDGE]).assign(part=int(key[0]))

    return run


def settled(edges: DataFrame, partitions: int) -> DataFrame:
    """The nodes on ranges' edges, each once: ``FAN`` neighbouring ranges at a time are combined, until one is left."""
    types = dict(x.split() for x in _DDL.split(", "))
    schema = "kind string, " + ", ".join(f"{c} {types[c]}" for c in _EDGE)
    done = None
    while True:
        partitions = -(-partitions // FAN)
        final = partitions <= 1

        wide = edges.select(*_EDGE).groupBy(F.floor(F.col("part") / FAN).alias("wide"))
        rows = stored(wide.applyInPandas(_combining(final), schema), "trie-edges")
        nodes = rows.where("kind = 'node'")
        done = nodes if done is None else done.unionByName(nodes)
        if final:
            return done
        edges = rows.where("kind = 'edge'")


def hex_of(ends: DataFrame) -> DataFrame:
    """id and ends_sha256: blocks of a node stream through one task in order, as a digest has to; memory is bounded by a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, hashlib.sha256(), []
        for batch in batches:
            for key, block in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key != held:
                    if held is not None:
                        out.append((held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, array("q", block))).encode())
        if held is not None:
            out.append((held, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out], pa.string())], names=["id", "ends_sha256"])

    return ends.select("id", "part", "conv_id", "ends").repartition("id").sortWithinPartitions("id", "part", "conv_id").select("id", "ends").mapInArrow(run, "id binary, ends_sha256 string")


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(found: DataFrame, partitions: int | None = None, size: int = 250_000) -> DataFrame:
    """A row for each distinct sequence of first turns of the conversations in ``found`` (conv_id, turns as from ``turns``).

    conv_id (least member), depth, parent_conv_id (least member of the node a turn shorter; null at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, words of a node's last turn times its other members) and ends_sha256 of the conversations
    that end there. Conversations without turns end at the root. An empty table gives no rows.

    Conversations are dealt to ranges of their turns' order of about ``size`` turns, so one sequence that a third of all
    conversations share spans many ranges; what lies across ranges is combined along their edges, ``FAN`` at a time. A conversation's digests
    (some 24 bytes a turn) have to fit a task, its texts needn't.
    """
    spark = found.sparkSession
    found = stored(found, "trie-turns")
    n = found.agg(F.coalesce(F.sum(F.size("turns") + 1), F.lit(0)).alias("n")).first()["n"]
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // size))
    rows = stored(ranges(found, partitions), "trie-rows")
    edges = settled(rows.where("kind = 'edge'"), partitions).select("id", "parent", *[c for c in _EDGE if c in _RESULT])
    edges = stored(edges, "trie-spans")
    above = edges.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(ends_digest(()))
    spans = edges.join(above, "parent", "left").join(hex_of(rows.where("kind = 'ends'")), "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    inner = rows.where("kind = 'node'")
    # Children of a node that spans ranges: the node is looked up once for each range, so no key holds more than a range's rows.
    loose = inner.where("parent is not null").drop("parent_conv_id")
    told = loose.select("part", "parent").distinct().join(above, "parent")
    known = loose.join(told, ["part", "parent"]).select(_RESULT)
    return inner.where("parent is null").select(_RESULT).unionByName(known).unionByName(spans.select(_RESULT))
