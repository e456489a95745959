"""Periodic runs of words: branching tandem repeats of a suffix tree, merged into maximal runs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix) of a text of numbers, by doubling; a suffix that ends comes before one that goes on."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        later = np.zeros(n, np.int64)
        if width < n:
            later[:-width] = rank[width:]
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        held = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, held[1:] != held[:-1]])
        if rank[order[-1]] == n:
            return order, rank - 1
        width *= 2


def shared_lengths(ids: list[int], order: list[int], rank: list[int]) -> list[int]:
    """For each suffix in order, how many words it shares with the one before."""
    n, k, out = len(ids), 0, [0] * len(ids)
    for i in range(n):
        r = rank[i]
        if not r:
            k = 0
            continue
        j = order[r - 1]
        while i + k < n and j + k < n and ids[i + k] == ids[j + k]:
            k += 1
        out[r] = k
        if k:
            k -= 1
    return out


def suffix_tree(lcp: list[int]) -> tuple[list[int], list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """Depth, leaves (first and last rank) and children's leaves of the inner nodes of a suffix tree, from neighbours' shared lengths.

    Leaves that end at a node stand first among its own; each leaf outside the inner children is a child by itself.
    """
    depth, leaves, children = [], [], []
    stack: list[tuple[int, int, list[tuple[int, int]]]] = [(0, 0, [])]  # depth, first leaf, inner children closed so far
    for r in range(1, len(lcp) + 1):
        k = lcp[r] if r < len(lcp) else -1
        first = r - 1
        closed: tuple[int, int] | None = None
        while stack and stack[-1][0] > k:
            d, first, own = stack.pop()
            if closed:
                own.append(closed)
            depth.append(d)
            leaves.append((first, r - 1))
            children.append(own)
            closed = (first, r - 1)
        if k < 0:
            break
        if stack[-1][0] < k:
            stack.append((k, first, []))
        if closed:
            stack[-1][2].append(closed)
    return depth, leaves, children


def _smaller_halves(first: int, last: int, inner: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Leaf lists (as rank ranges) of all children of a node but the one with the most leaves."""
    out, at = [], first
    most = max(inner, key=lambda c: c[1] - c[0]) if inner else (first, first)
    for a, b in inner:
        if at < a:
            out.append((at, a - 1))
        if (a, b) != most:
            out.append((a, b))
        at = b + 1
    if at <= last:
        out.append((at, last))
    if not inner:
        out = [(first + 1, last)]
    return out


def branching_repeats(ids: np.ndarray, least_period: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every branching tandem repeat: two equal halves of ``period`` words whose next words differ.

    At each node of the suffix tree the leaves of all children but the largest are tried, each with the leaf a
    node's depth on and the leaf a node's depth before, so a leaf is tried at most log2(n) times.
    """
    n = len(ids)
    order, rank = suffix_array(ids)
    depth, leaves, children = suffix_tree(shared_lengths(ids.tolist(), order.tolist(), rank.tolist()))
    at, node = [], []
    for v, d in enumerate(depth):
        if d < least_period:
            continue
        for a, b in _smaller_halves(*leaves[v], children[v]):
            at.append((a, b))
            node.append(v)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.array(at, np.int64).T
    sizes = high - low + 1
    ranks = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    d = np.repeat(np.array(depth, np.int64)[node], sizes)
    first, last = (np.repeat(np.array(leaves, np.int64)[node, k], sizes) for k in (0, 1))
    here = order[ranks]
    rank, ids = np.r_[rank, np.full(1, -1)], np.r_[ids, -1]  # what lies behind the text equals nothing

    def starts(i: np.ndarray) -> np.ndarray:
        on = i + d
        fits = (i >= 0) & (on < n)
        i, on = np.where(fits, i, n), np.where(fits, on, n)
        other = rank[np.where(i == here, on, i)]  # the leaf that goes with the one tried
        return fits & (other >= first) & (other <= last) & (ids[on] != np.where(on + d < n, ids[np.minimum(on + d, n)], -2))

    ahead, back = starts(here), starts(here - d)
    pairs = np.unique(np.stack((np.r_[here[ahead], here[back] - d[back]], np.r_[d[ahead], d[back]])), axis=1)
    return pairs[0], pairs[1]


def _left_of(ids: np.ndarray, start: int, period: int) -> int:
    """How far left the period still holds: each word further is a rotation of the repeat."""
    step = 64
    while start:
        low = max(0, start - step)
        differs = np.flatnonzero(ids[low:start] != ids[low + period : start + period])
        if len(differs):
            return low + int(differs[-1]) + 1
        start, step = low, step * 2
    return 0


def _stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of words in windows of ``window`` words whose hash is that of another window."""
    n = len(ids)
    if n <= window:
        return []
    h, width = (ids.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    h ^= h >> np.uint64(31)
    while width < window:
        step = min(width, window - width)
        h = (h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93)) + (h[step:] ^ (h[step:] >> np.uint64(29))) * _ODD
        width += step
    held = np.sort(h)
    twice = held[1:][held[1:] == held[:-1]]
    if not len(twice):
        return []
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0]
    change = np.flatnonzero(np.diff(covered))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def runs_of(words: list[str], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``least`` words and ``times`` periods (twice or more), by start, then period.

    Such a run with period q shows each word of it in a window of w = ``least`` - ``least`` // ``times`` words that stands
    again q words further, so only stretches of repeated windows get a suffix tree; most texts have none. A
    run's right end holds one branching repeat of its period (the next word breaks it); rotating that to the left finds its
    start. Repeats of multiples of a run's period end where it ends and lie in it: they are merged into it.
    """
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return []
    found = []
    for low, high in _stretches(ids, max(1, least - least // times)):
        part = ids[low:high]
        places, periods = branching_repeats(part)
        ends: dict[int, list[tuple[int, int]]] = {}
        for k in np.lexsort((places, periods)).tolist():
            i, q = int(places[k]), int(periods[k])
            known = ends.setdefault(i + 2 * q, [])
            if any(q % p == 0 and i >= s for s, p in known):
                continue
            start = _left_of(part, i, q)
            known.append((start, q))
            if i + 2 * q - start >= max(least, times * q):
                found.append((low + start, i + 2 * q - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that any run repeats after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone] if runs else words


def looped(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a document as they are or, for a tenth of the doc_ids (by crc32), with a tail that repeats its first words."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def find(docs: DataFrame, loops: bool = False, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), digests of all runs and of the words left, n_words, n_dropped.

    With ``loops``, words are taken as ``looped`` gives them. Of runs with equal exponents the first counts, then the one of lesser
    period. Null and empty texts have no words and no run: four nulls, and the digests of empty texts. Texts of any length are
    taken whole, in time n log n. Rows that repeat give repeated results, a null doc_id stays null and is never looped. An empty
    table gives no rows; other columns are not read. Each row is worked on by itself; nothing is shuffled.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                words = words_of(text)
                if loops:
                    words = looped(words, doc_id)
                runs = runs_of(words, least, times)
                left = collapsed(words, runs)
                best = None
                for r in runs:
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                out.append((doc_id, len(runs), *told, _sha("".join("%d,%d,%d\n" % r for r in runs)), _sha(" ".join(left)), len(words), len(words) - len(left)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")], dtype=object)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, _OUT)
