"""Byte-level BPE: words, a cached encoder, and the distinct-word encoder and decoder.

A *word* is a run of white space and the run of other characters after it. Text may be cut
before any white space that follows another character without changing its tokens, because
byte-level pre-tokens never reach over such a place; a document's ids are therefore its words'
ids, one after another. Special tokens hold no white space and so lie within one word.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import texts

#: White space as Unicode has it (White_Space), which byte-level pre-tokenizers split at.
_OTHER = [chr(c) for c in (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]
_WS = " \n" + "".join(_OTHER)
#: What can't follow the space that a key leaves out: nothing, a newline, the mark itself.
_SPECIAL = ("", "\n", "\1")
_WORD = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


def default_tokenizer() -> str:
    """The public byte-level vocabulary; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_keys(text: str) -> list[str]:
    """The words of a text as keys: a word without its one leading space, or as it is if it begins with a newline, or else after ``\\1``."""
    if "\1" not in text and not any(c in text for c in _OTHER):
        parts = text.replace("\n", " \n").split(" ")
        if "" not in parts and "\n" not in parts:
            parts[0] = "\1" + parts[0]
            return parts
    return [key_of(w) for w in _WORD.findall(text)]


def key_of(word: str) -> str:
    return word[1:] if word[0] == " " and word[1:2] not in _SPECIAL else word if word[0] == "\n" else "\1" + word


def word_of(key: str) -> str:
    return key[1:] if key[0] == "\1" else key if key[0] == "\n" else " " + key


def split_words(text: str) -> list[str]:
    """The words of a text; joined they are the text."""
    return [word_of(k) for k in split_keys(text)]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordEncoder:
    """Encodes texts by the tokenizers library, each word once while it stays in the cache.

    Words are found and made distinct in Arrow, some megabytes of text at a time, so that Python sees a
    word once for all its places there. ``limit`` bounds the cache's words; words over ``longest``
    characters are never kept.
    """

    def __init__(self, path: str, limit: int = 1_390_000, longest: int = 64):
        self.tokenizer = load_tokenizer(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u4" if size > 65_536 else "<u2")
        self.limit, self.longest, self.words = limit, longest, {}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():  # a byte-level piece has a character for each byte
            self.bytes_of[i] = len(piece.encode()) if piece in added else len(piece)

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return next(iter(self.encode_many([text])))

    def encode_many(self, several: Iterable[str], chars: int = 8_000_000) -> Iterator[np.ndarray]:
        """The ids of each text; some ``chars`` characters at a time share one call for their new words."""
        held, size = [], 0
        for t in several:
            held.append(t)
            size += len(t)
            if size >= chars:
                yield from self._encode(held)
                held, size = [], 0
        if held:
            yield from self._encode(held)

    def _encode(self, several: list[str]) -> list[np.ndarray]:
        odd = [not t or "\1" in t or any(c in t for c in (_OTHER_ASCII if t.isascii() else _OTHER)) for t in several]
        plain = [i for i, x in enumerate(odd) if not x]
        out: list = [None] * len(several)
        if plain:
            split = pc.split_pattern(pc.replace_substring(pa.array(["\1" + several[i] for i in plain], pa.large_string()), "\n", " \n"), " ")
            words, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()[1:]
            keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            at = words.indices.to_numpy()
            bad = [k for k, key in enumerate(keys) if key in ("", "\n", "\1")]
            if bad:  # runs of white space: these texts go by their words as Python splits them
                wrong = set(np.searchsorted(ends, np.flatnonzero(np.isin(at, bad)), "right").tolist())
                for k in wrong:
                    odd[plain[k]] = True
                keep = np.ones(len(plain), bool)
                keep[list(wrong)] = False
                at = at[np.repeat(keep, np.diff(ends, prepend=0))]
                ends = np.cumsum(np.diff(ends, prepend=0)[keep])
                plain = [i for k, i in enumerate(plain) if keep[k]]
                used, at = np.unique(at, return_inverse=True)
                keys = [keys[k] for k in used.tolist()]
            for i, ids in zip(plain, self._placed(keys, at, ends), strict=True):
                out[i] = ids
        rest = [i for i, x in enumerate(odd) if x]
        if rest:
            split = [split_keys(several[i]) for i in rest]
            number: dict[str, int] = {}
            at = np.array([number.setdefault(k, len(number)) for keys in split for k in keys], np.int64)
            for i, ids in zip(rest, self._placed(list(number), at, np.cumsum(list(map(len, split)))), strict=True):
                out[i] = ids
        return out

    def _placed(self, keys: list[str], at: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of texts whose words are ``keys[at]``, up to ``ends`` each."""
        known = self.words
        found = list(map(known.get, keys))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            missing = [keys[k] for k in new]
            if len(known) + len(missing) > self.limit:
                known.clear()
            for k, key, ids in zip(new, missing, self.ids_of(missing), strict=True):
                found[k] = ids
                if len(key) <= self.longest:
                    known[key] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), pa.array(np.frombuffer(b"".join(found), self.type)))
        flat = lists.take(pa.array(at)).flatten().to_numpy()
        cuts = np.concatenate(([0], np.cumsum(sizes[at])))[np.concatenate(([0], ends)).astype(np.int64)].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids_of(self, keys: list[str], together: int = 2000) -> list[bytes]:
        """Ids of words, as bytes. Words that begin with white space and end without are encoded ``together`` in one text and told apart by their bytes."""
        out: dict[int, bytes] = {}
        alone, runs = [], []
        for k, key in enumerate(keys):
            (alone if key[0] == "\1" or key[-1].isspace() else runs).append(k)
        for at in range(0, len(runs), 40 * together):
            part = runs[at : at + 40 * together]
            words = [word_of(keys[k]) for k in part]
            sizes = pc.binary_length(pa.array(words, pa.large_string())).to_numpy()
            texts_ = ["".join(words[a : a + together]) for a in range(0, len(words), together)]
            for j, e in enumerate(self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)):
                own, ids = part[j * together : (j + 1) * together], np.array(e.ids, np.int64)
                ends, got = np.cumsum(sizes[j * together : (j + 1) * together]), np.cumsum(self.bytes_of[ids])
                cut = np.searchsorted(got, ends)
                if not len(got) or cut[-1] >= len(got) or (got[cut] != ends).any() or got[-1] != ends[-1]:
                    alone += own
                    continue
                blob, cut = ids.astype(self.type).tobytes(), ((cut + 1) * self.type.itemsize).tolist()
                out.update(zip(own, [blob[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))
        for at in range(0, len(alone), 20_000):
            part = alone[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast([word_of(keys[k]) for k in part], add_special_tokens=False)
            out.update(zip(part, [np.array(e.ids, self.type).tobytes() for e in found], strict=True))
        return [out[k] for k in range(len(keys))]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, limit: int = 1_390_000) -> WordEncoder:
    """This worker process's encoder, kept between tasks; it holds ``limit`` words at most."""
    if (path, limit) not in _encoders:
        _encoders.clear()
        _encoders[path, limit] = WordEncoder(path, limit)
    return _encoders[path, limit]


# ----- the distinct-word table -------------------------------------------------------------


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and ``piece`` (bytes) of a byte-level vocabulary, as large as the vocabulary."""
    tokenizer = load_tokenizer(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
    rest = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    rows = [(i, p.encode() if p in added else bytes(byte[c] for c in p)) for p, i in tokenizer.get_vocab(with_added_tokens=True).items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def _texts_by_chunk(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[int, bool, int | None, str]]:
    """(chunk, last of the chunk, doc_id, text) of a task's rows; a chunk is a run of rows with about ``chars`` characters.

    Chunks are numbered by task and order, and depend on nothing but the rows, so that a
    repeated task and another pass over the same input make the same ones.
    """
    from pyspark import TaskContext

    number, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            t = t.as_py()
            size += len(t) + 8
            yield number, size >= chars, i, t
            if size >= chars:
                number, size = number + 1, 0


def _chunk_words(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[int, set[str]]]:
    """(chunk, its distinct words)."""
    found: set[str] = set()
    number = None
    for number, last, _, t in _texts_by_chunk(batches, chars):
        found.update(split_words(t))
        if last:
            found.discard("")
            yield number, found
            found = set()
    found.discard("")
    if found:
        yield number, found


def packed(docs: DataFrame, chars: int) -> DataFrame:
    """chunk and payload: a chunk's documents (doc_id, text), compressed in pieces of some megabytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, ids, held, size = zstandard.ZstdCompressor(level=9), [], [], 0

        def flush(number: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([squeeze.compress(pickle.dumps((ids, held)))], pa.binary())], ["chunk", "payload"])

        for number, last, i, t in _texts_by_chunk(batches, chars):
            ids.append(i)
            held.append(t)
            size += len(t)
            if last or size > 8_000_000:
                yield flush(number)
                ids, held, size = [], [], 0
        if ids:
            yield flush(number)

    return docs.mapInArrow(run, "chunk long, payload binary")


def unpacked(payload: bytes) -> Iterator[tuple[int | None, str]]:
    return zip(*pickle.loads(zstandard.ZstdDecompressor().decompress(payload)), strict=True)


def encode_decode(docs: DataFrame, path: str | None = None, chunk_chars: int = 32_000_000, group_chunks: int = 4096) -> DataFrame:
    """Ids and decoded text of every document, as digests.

    1. Words: each chunk of documents gives its distinct words, grouped into one table of
       distinct words with the chunks that hold each. A group takes the chunks of ``group_chunks`` tasks, so
       no row's list outgrows those.
    2. Each distinct word is encoded once, by the tokenizers library.
    3. Its ids are joined to the vocabulary's pieces, which are broadcast (a table as large as
       the vocabulary), and the pieces in order are the decoded word.
    4. Both go back to the chunks, packed, where the documents' words look them up by position.

    Documents keep their input split and travel once, compressed. They are read twice, and a chunk is a run of a
    task's rows, so ``docs`` should be a stored table; a second reading that meets other words raises. A null
    text counts as empty; a document without text has no ids. A text of any length is one of its chunk's. Repeated
    rows give repeated results, a null doc_id stays null, other columns are not read. Returns doc_id, n_tokens,
    ids_sha256, decoded_sha256, n_words and n_bytes.
    """
    path = path or default_tokenizer()
    spark = docs.sparkSession
    docs = texts(docs)
    table = pieces(spark, path).orderBy("id").toPandas()
    by_id = [b""] * (int(table["id"].max()) + 1)
    for i, piece in zip(table["id"], table["piece"], strict=True):
        by_id[i] = bytes(piece)
    vocabulary = spark.sparkContext.broadcast(by_id)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, found in _chunk_words(batches, chunk_chars):
            found = sorted(found)
            for at in range(0, len(found), 50_000):
                words = pa.array(found[at : at + 50_000], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), words], ["chunk", "word"])

    by_word = (
        docs.mapInArrow(words_of, "chunk long, word string")
        .withColumn("part", F.expr(f"shiftright(chunk, 24) div {group_chunks}"))
        .repartition("word", "part")
        .groupBy("word", "part")
        .agg(F.collect_list("chunk").alias("chunks"))
    )

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encode a task's words, join their ids to pieces, and pack the rows by chunk, so that they travel compressed."""
        own, squeeze = encoder(path), zstandard.ZstdCompressor(level=9)
        piece = pa.array(vocabulary.value, pa.large_binary())
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("word")
            words, lists = rows["word"].to_pylist(), rows["chunks"].combine_chunks()
            chunk, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = own.ids_of([key_of(w) for w in words])
            ends = np.cumsum([0, *map(len, ids)]) // own.type.itemsize
            got = piece.take(pa.array(np.frombuffer(b"".join(ids), own.type)))
            at = np.frombuffer(got.buffers()[1], np.int64)[ends]
            text = got.buffers()[2].to_pybytes()
            decoded = [text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            blobs = []
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                mine = row[order[a:b]].tolist()
                blobs.append(squeeze.compress(_columns([words[k].encode() for k in mine], [ids[k] for k in mine], [decoded[k] for k in mine])))
            return pa.RecordBatch.from_arrays([pa.array(chunk[order[edges]]), pa.array(blobs, pa.binary())], ["chunk", "blob"])

        for batch in batches:
            held.append(batch)
            size += len(batch.column("chunks").flatten())
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_words": [], "n_bytes": []}
        wide = "<u4" if len(vocabulary.value) > 65_536 else "<u2"
        shown, plain = {}, {}
        for blob in right["blob"]:
            words, ids, decoded = _parts(zstandard.ZstdDecompressor().decompress(blob.as_py()))
            words = [w.decode() for w in words]
            shown.update(zip(words, [",".join(map(str, np.frombuffer(i, wide).tolist())) + "," for i in ids], strict=True))
            plain.update(zip(words, decoded, strict=True))
        for payload in left["payload"]:
            for i, t in unpacked(payload.as_py()):
                own = split_words(t) if t else []
                ids = "".join([shown[w] for w in own])
                decoded = b"".join([plain[w] for w in own]).decode("utf-8", "replace").encode()
                rows["doc_id"].append(i)
                rows["n_tokens"].append(ids.count(","))
                rows["ids_sha256"].append(hashlib.sha256(ids[:-1].encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                rows["n_words"].append(len(own))
                rows["n_bytes"].append(len(decoded))
        return pa.table(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_words", pa.int64()), ("n_bytes", pa.int64())]))

    back = by_word.select("word", "chunks").mapInArrow(by_chunk, "chunk long, blob binary")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long, n_bytes long"
    return packed(docs, chunk_chars).groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(joined, out)


def _columns(*columns: list[bytes]) -> bytes:
    """Lists of byte strings, each as lengths and one run of bytes."""
    return pickle.dumps([(np.array(list(map(len, c)), "<u4").tobytes(), b"".join(c)) for c in columns])


def _parts(blob: bytes) -> list[list[bytes]]:
    out = []
    for lengths, run in pickle.loads(blob):
        ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
        out.append([run[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    return out


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every document, words encoded once per worker while cached."""
    path = path or default_tokenizer()

    def run(frames):
        own = encoder(path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": [ids.astype("int32") for ids in own.encode_many(frame["text"])]})

    return texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded bytes of a table of doc_id and ids, by a join of ids to pieces; doc_id must be unique."""
    table = pieces(ids.sparkSession, path or default_tokenizer())
    return (
        ids.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
        .join(F.broadcast(table), "id", "left")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("got"))
        .select("doc_id", F.expr("unhex(array_join(transform(got, x -> hex(x.piece)), ''))").alias("decoded"))
    )
