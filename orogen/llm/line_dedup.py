"""Removal of lines that many documents share, by DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.llm.common import SPACES, fresh

#: Bits of a keep bitmap's word that are used; the sign bit stays free.
BITS = 60
#: Shares of the documents that a frequent key's lines are dealt to.
SALTS = 16
#: A word of a bitmap whose lines all stay.
FULL = (1 << BITS) - 1


def line_key(line: Column) -> Column:
    """A line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z (only) in lower case."""
    line = F.btrim(line, F.lit(SPACES))
    lower = F.when(F.octet_length(line) == F.char_length(line), F.lower(line))
    return lower.otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def wide_hash(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of differing seeds, 128 bits together, so that equal hashes mean equal values at any table size."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def row_key(docs: DataFrame) -> DataFrame:
    """r1 and r2, a document's key (rows that repeat a doc_id with another text stay apart), with doc_id and text."""
    r1, r2 = wide_hash(F.col("doc_id"), F.col("text"))
    return docs.select(r1.alias("r1"), r2.alias("r2"), "doc_id", "text")


def key_hashes(docs: DataFrame) -> DataFrame:
    """r1, r2, doc_id and ``keys``: position and hashes (h1, h2) of each line of a document whose key isn't empty, in order."""
    found = F.transform(F.transform(lines_of(F.col("text")), line_key), lambda k, i: F.struct(i.alias("pos"), *(h.alias(n) for h, n in zip(wide_hash(k), ("h1", "h2"), strict=True)), (k == "").alias("blank")))
    keys = F.filter(found, lambda k: ~k["blank"])
    return row_key(docs).select("r1", "r2", "doc_id", keys.alias("keys"))


def occurrences(docs: DataFrame) -> DataFrame:
    """h1, h2, pos, r1, r2 and doc_id, a row for each line whose key isn't empty."""
    return key_hashes(docs).select("r1", "r2", "doc_id", F.explode("keys").alias("k")).select("k.h1", "k.h2", "k.pos", "r1", "r2", "doc_id")


def streamed(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """h1, h2, n_docs and first (doc_id, pos, r1, r2) of every key.

    Occurrences are range-partitioned by hash and a slot of the document, and sorted by hash, slot,
    document and position. A key's documents fall into as many slots as there are partitions, so one
    that stands in a third of all lines spans many ranges; any other lies in one. The stream of each key
    and slot tells first occurrences by the row before: an occurrence begins a document if the row before
    has another doc_id, and begins the slot if there is none. What is left of a range is a row for each of its keys,
    which the exchange that brings a key's ranges together sums up. Rows of one doc_id are one document; a
    null doc_id counts as one too.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = Window.partitionBy("h1", "h2", "slot").orderBy("doc_id", "pos", "r1", "r2")
    before = F.lag(F.struct("doc_id")).over(stream)
    return (
        occurrences(docs)
        .withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
        .repartitionByRange(n, "h1", "slot")
        .withColumn("before", before)
        .select("h1", "h2", F.struct("doc_id", "pos", "r1", "r2").alias("here"), F.col("before").isNull().alias("begins"), (~F.struct("doc_id").eqNullSafe(F.col("before"))).alias("new_doc"))
        .groupBy("h1", "h2")
        .agg(F.count_if("new_doc").alias("n_docs"), F.min(F.when(F.col("begins"), F.col("here"))).alias("first"))
    )


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, first_stays: bool = False, partitions: int | None = None) -> DataFrame:
    """r1, r2 and a compressed bitmap of the lines that stay, for documents that lose any.

    A line is dropped if its key stands in at least ``least_docs`` documents (``streamed``); with
    ``first_stays`` its first occurrence (least doc_id, then position) stays. Only hashes move. The
    join that takes the frequent keys back to their lines holds each key ``SALTS`` times, once for each
    share of the documents, so no task gets all lines of one key.

    The bitmap is compressed: ``words`` maps a word's number to its ``BITS`` bits, position
    ``BITS * word + bit``; words whose lines all stay are left out.
    """
    often = streamed(docs, partitions).where(F.col("n_docs") >= least_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = occurrences(docs).withColumn("salt", F.pmod(F.col("r1"), F.lit(SALTS)).cast("int")).join(often, ["h1", "h2", "salt"])
    if first_stays:
        dropped = dropped.where((F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2")) | (F.col("pos") != F.col("first.pos")))
    word = (F.col("pos") / BITS).cast("long").alias("word")
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {BITS} as int))")).bitwiseXOR(F.lit(FULL)).alias("bits")
    return dropped.groupBy("r1", "r2", word).agg(bits).groupBy("r1", "r2").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def kept_at(pos: Column, words: Column) -> Column:
    """Whether a bitmap keeps a position."""
    word = F.coalesce(F.try_element_at(words, F.floor(pos / BITS)), F.lit(FULL))
    return F.call_function("getbit", word, (pos % BITS).cast("int")) == 1


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines that stay, joined by newlines, and the numbers of lines before and dropped, under ``names``."""
    r1, r2, words, lines, left = fresh(docs, "r1", "r2", "words", "lines", "left")
    h1, h2 = wide_hash(F.col("doc_id"), F.col("text"))
    marked = docs.withColumns({r1: h1, r2: h2}).join(bitmaps.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("words").alias(words)), [r1, r2], "left")
    stay = F.filter(F.col(lines), lambda x, i: kept_at(i, F.col(words)))
    out = marked.withColumn(lines, lines_of(F.col("text"))).withColumn(left, F.when(F.col(words).isNull(), F.col(lines)).otherwise(stay))
    kept, n_lines, n_dropped = names
    made = {kept: F.array_join(left, "\n"), n_lines: F.size(lines).cast("long"), n_dropped: (F.size(lines) - F.size(left)).cast("long")}
    return out.select(*[c for c in docs.columns if c not in names], *[v.alias(k) for k, v in made.items()])


def dedup(docs: DataFrame, least_docs: int = 10, first_stays: bool = False, names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the text that stays, the number of its lines before, and how many are dropped, as columns ``names``.

    Text is split at newlines; null or empty text is one empty line. Empty keys are never
    dropped. Documents are told apart by doc_id: rows that repeat one count once, and lose the same
    lines. A text of any length is one array of lines in its row. An empty table stays empty. Other columns stay
    as they are, whatever their names, but those named as in ``names`` are replaced.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), least_docs, first_stays), names)
