"""Language identification by n-gram filters: bit-sliced Bloom filters whose slots hold a bit for each language."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import stored

#: Odd multipliers that mix the letters of an n-gram and a gram's hash into slots.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Characters that are worked on at once; longer texts are still one piece.
_CHARS = 200_000
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space where it is no letter."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every letter n-gram of the texts.

    Case doesn't count, each run of other characters is one space, and texts begin and end with one, so that
    beginnings and ends of words have n-grams of their own. An n-gram holds a space at its ends only.
    """
    parts = [_codes(t) for t in texts]
    edge = np.array([_SPACE], np.uint32)
    whole = np.concatenate([x for p in parts for x in (edge, p, edge)]) if parts else edge[:0]
    owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
    blank = whole == _SPACE
    keep = np.ones(len(whole), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    whole, owner, blank = whole[keep].astype(np.uint64), owner[keep], blank[keep]
    hashes, numbers = [], []
    for n in sizes:
        m = len(whole) - n + 1
        if m <= 0:
            continue
        h, bad = np.full(m, n, np.uint64), owner[:m] != owner[n - 1 :]
        for k in range(n):
            h = (h ^ whole[k : m + k]) * _MIX[k % len(_MIX)]
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                bad |= blank[k : m + k]
        hashes.append(h[~bad])
        numbers.append(owner[:m][~bad])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(numbers)


def slots_of(hashes: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    """The ``probes`` slots of each hash, by double hashing; ``slots`` is a power of two."""
    one = hashes * _MIX[1]
    two = ((hashes * _MIX[2]) >> np.uint64(31)) | np.uint64(1)
    one = one >> np.uint64(17)
    return [((one + np.uint64(k) * two) & np.uint64(slots - 1)).astype(np.int64) for k in range(probes)]


@dataclass
class Filters:
    """``table[slot]`` holds the bits of all languages, 64 to a word: one probe reads the slot of every language's filter at once."""

    languages: list[str]
    shares: list[float]
    table: np.ndarray
    sizes: tuple[int, ...]
    probes: int

    def __post_init__(self):
        words = np.arange(len(self.languages))
        self._bits = [(int(i) // 64, np.uint64(int(i) % 64)) for i in words]
        fill = [float(((self.table[:, w] >> b) & np.uint64(1)).mean()) for w, b in self._bits]
        #: Share of foreign n-grams that each language's filter takes for its own.
        self.false = np.array([f**self.probes for f in fill])

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages that contain it (and, rarely, of some that don't)."""
        at = slots_of(hashes, len(self.table), self.probes)
        found = self.table[at[0]]
        for a in at[1:]:
            found &= self.table[a]
        return found

    def decide(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, score and number of n-grams of each text.

        A language's count of n-grams is corrected for the expected false positives; the greatest count decides,
        ties go to the commoner language of the training texts, then to the lesser name. The score is its share of the counts
        of all languages.
        """
        hashes, owner = grams([t or "" for t in texts], self.sizes)
        n = np.bincount(owner, minlength=len(texts))
        if not self.languages:
            return [("und", 0.0, int(x)) for x in n]
        found = self.masks(hashes)
        counts = np.stack([np.bincount(owner, (found[:, w] >> b & np.uint64(1)).astype(float), len(texts)) for w, b in self._bits], 1)
        counts = np.maximum(0.0, (counts - n[:, None] * self.false) / np.maximum(1 - self.false, 1e-9))
        order = sorted(range(len(self.languages)), key=lambda i: (-self.shares[i], self.languages[i]))
        best = np.array(order)[np.argmax(counts[:, order], 1)]
        total = counts.sum(1)
        out = []
        for i, k in enumerate(best.tolist()):
            score = float(counts[i, k] / total[i]) if total[i] > 0 else 0.0
            out.append((self.languages[k], score, int(n[i])) if n[i] else ("und", 0.0, 0))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _blocks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pieces of a batch with about ``_CHARS`` characters."""
    at = frame["text"].str.len().fillna(0).cumsum() // _CHARS
    for _, part in frame.groupby(at.to_numpy(), sort=True):
        yield part


def fit(docs: DataFrame, sizes: tuple[int, ...] = (3, 4), least: float = 0.1, least_count: int = 3, slots: int = 1 << 20, probes: int = 3, sample: int = 30_000) -> Filters:
    """Learn the filters from the text and non-null ``lang`` of documents that aren't held out.

    At most ``sample`` documents are learned from, those of the least hashes of the doc_id; their ids are broadcast, under
    half a megabyte. Tasks count n-grams by language and Spark sums them up. A language contains an n-gram that
    it has ``least_count`` times and at ``least`` times the rate of the language that has it most, so foreign quotations leave no bits.
    Spark also gathers the bits: the driver gets a row for each of the ``slots`` at most.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    drawn = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).groupBy("doc_id").agg(F.min("lang").alias("learned")), "language-sample")
    names = [(r["learned"], r["n"]) for r in drawn.groupBy("learned").agg(F.count("*").alias("n")).orderBy("learned").collect()]
    words = max(1, -(-len(names) // 64))
    table = np.zeros((slots, words), np.uint64)
    if not names:
        return Filters([], [], table, sizes, probes)
    number = {name: i for i, (name, _) in enumerate(names)}
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null").join(F.broadcast(drawn), "doc_id").where("lang = learned").select("text", "lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _blocks(frame):
                tongue = np.array([number[x] for x in part["lang"]])
                hashes, owner = grams(part["text"].tolist(), sizes)
                order = np.lexsort((tongue[owner], hashes))
                h, t = hashes[order], tongue[owner][order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, int)
                if len(first):
                    yield pd.DataFrame({"gram": h[first].view(np.int64), "language": t[first].astype(np.int32), "n": np.diff(np.r_[first, len(h)]).astype(np.int64)})

    counted = stored(train.mapInPandas(count, "gram long, language int, n long").groupBy("gram", "language").agg(F.sum("n").alias("n")), "language-grams")
    totals = {r["language"]: r["n"] for r in counted.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    rates = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))]) if totals else F.create_map(F.lit(-1), F.lit(1.0))
    rated = counted.withColumn("rate", F.col("n") / rates[F.col("language")])
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("language", "n", "rate")).alias("seen"))
    holds = most.select("gram", F.explode("seen").alias("s"), "most").where((F.col("s.n") >= least_count) & (F.col("s.rate") >= least * F.col("most"))).select("gram", F.col("s.language").alias("language"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                at = slots_of(frame["gram"].to_numpy(np.int64).view(np.uint64), slots, probes)
                tongue = frame["language"].to_numpy(np.int64)
                bit = (np.uint64(1) << (tongue % 64).astype(np.uint64)).view(np.int64)
                yield pd.DataFrame({"slot": np.concatenate(at), "word": np.tile((tongue // 64).astype(np.int32), probes), "bit": np.tile(bit, probes)})

    got = holds.mapInPandas(place, "slot long, word int, bit long").groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table[got["slot"].to_numpy(int), got["word"].to_numpy(int)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Filters([name for name, _ in names], [n for _, n in names], table, sizes, probes)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_grams of every document.

    A null text and a text without a letter are ``und`` with score 0; so is every text where nothing was learned. A text with
    letters, but without any known n-gram, gets the commonest language, with score 0. Whole texts are read, whatever
    their length. Rows that repeat give repeated results; a null doc_id stays null and isn't held out. An empty table gives no rows;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for frame in frames:
            for part in _blocks(frame):
                found = known.decide(part["text"].tolist())
                yield pd.DataFrame(found, columns=["lang_pred", "score", "n_grams"]).assign(doc_id=part["doc_id"].astype("Int64").to_numpy(dtype=object), held_out=part["held_out"].to_numpy())

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return slim.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, n_grams long")
