"""Token ids of documents in binary files: tokenised, packed with Simple-8b, and read back."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.settings import setting
from tickloom.llm.simple8b import BLOCK, pack, unpack

MAGIC = b"TLTOK8B1"
#: words, escapes, documents, ids, blocks, checksum of all before
TRAILER = struct.Struct("<5QI8s")
#: Ids that are packed together, ids after which a new file is begun, and pieces whose ids a worker remembers.
PORTION, FILE, REMEMBERED = 256 * BLOCK, 1 << 26, 1_000_000
#: Characters that are tokenised together, and bytes of an Arrow batch.
TEXTS, BATCH = 1 << 19, "4m"


def open_at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path inside it; plain paths and any scheme that Arrow knows."""
    return fs.FileSystem.from_uri(uri)


class Writer:
    """One token file. Layout: magic, words of all blocks, escapes, then the index (document ids, their null marks,
    ids per document, first word and first escape of every block), then the trailer. Numbers are little-endian."""

    def __init__(self, out) -> None:
        self.out, self.crc, self.n = out, 0, 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.rest = np.zeros(0, np.uint64)
        self.escapes: list[np.ndarray] = []
        self.first, self.first_escape = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.out.write(data)

    def _pack(self, ids: np.ndarray) -> None:
        words, first, escapes, first_escape = pack(ids)
        self.first.append(self.first[-1][-1] + first[1:])
        self.first_escape.append(self.first_escape[-1][-1] + first_escape[1:])
        self.escapes.append(escapes)
        self._put(words.astype("<u8").tobytes())

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids laid end to end."""
        self.docs += doc_ids
        self.counts += counts.tolist()
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(self.rest) // PORTION * PORTION
        for at in range(0, whole, PORTION):
            self._pack(self.rest[at : at + PORTION])
        self.rest = self.rest[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._pack(self.rest)
        first, first_escape = np.concatenate(self.first), np.concatenate(self.first_escape)
        escapes = np.concatenate([np.zeros(0, np.uint64), *self.escapes])
        self._put(escapes.astype("<u8").tobytes())
        self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs))
        self._put(np.array(self.counts, "<u8").tobytes())
        self._put(first.astype("<u8").tobytes() + first_escape.astype("<u8").tobytes())
        self.out.write(TRAILER.pack(int(first[-1]), len(escapes), len(self.docs), self.n, len(first) - 1, self.crc, MAGIC))
        self.out.close()


class Reader:
    """Random access to a token file by its index; ``file`` can be read and sought."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        head, (words, n_escapes, docs, self.n, self.blocks, self.crc, tail) = self._at(0, len(MAGIC)), TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if head != MAGIC or tail != MAGIC:
            raise ValueError("not a token file, or cut short")
        at = len(MAGIC) + 8 * words
        take = lambda n, kind: np.frombuffer(self._at(at, n * np.dtype(kind).itemsize), kind)
        self.escapes = take(n_escapes, "<u8")
        at += 8 * n_escapes
        ids = take(docs, "<i8")
        at += 8 * docs
        self.docs = [None if null else int(i) for i, null in zip(ids, take(docs, "u1"), strict=True)]
        at += docs
        self.counts = take(docs, "<u8").astype(np.int64)
        at += 8 * docs
        self.first = take(self.blocks + 1, "<u8").astype(np.int64)
        at += 8 * (self.blocks + 1)
        self.first_escape = take(self.blocks + 1, "<u8").astype(np.int64)

    def _at(self, pos: int, n: int) -> bytes:
        self.file.seek(pos)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("token file is cut short")
        return data

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file, decoding only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        a, b = start // BLOCK, -(-stop // BLOCK)
        words = np.frombuffer(self._at(len(MAGIC) + 8 * int(self.first[a]), 8 * int(self.first[b] - self.first[a])), "<u8")
        got = unpack(words, self.first[a : b + 1] - self.first[a], self.escapes[self.first_escape[a] : self.first_escape[b]], min(b * BLOCK, self.n) - a * BLOCK)
        return got[start - a * BLOCK : stop - a * BLOCK]


def _letters() -> dict[int, int]:
    """Byte-level BPE writes every byte as a letter: printable ones as themselves, the others from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}


LETTER_OF = _letters()
SPACE = chr(LETTER_OF[0x20])


class _Places(dict):
    """Numbers keys as they come and notes the new ones."""

    def __init__(self, fresh: list[str]) -> None:
        super().__init__()
        self.fresh = fresh

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        self.fresh.append(key)
        return place


class PieceCache:
    """Ids of texts, tokenised piece by piece; pieces already seen are looked up.

    The tokenizer never joins a letter to the punctuation after it, nor a character that is not white space to white
    space after it, so a text may be cut there and its pieces be encoded alone: the ids are those of the whole text.
    Texts with the separators 0x1C to 0x1F, which only Python takes for white space, are encoded whole, and so are all
    texts if the tokenizer is no byte-level BPE. Once
    ``REMEMBERED`` pieces are known, later ones are tokenised again each time, which changes no result.
    """

    piece = re.compile(r" ?[A-Za-z]++(?=[\s.,;:!?]|$)| ?\S+|\s+(?!\S)|\s+")
    word = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
    odd = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str) -> None:
        # Spark runs a task per core; threads of the tokenizer's own would only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        form = json.loads(self.tokenizer.to_str())
        step = form["pre_tokenizer"] or {}
        # only a byte-level BPE that cuts words itself and changes nothing before can be taken piece by piece
        self.by_piece = form["model"]["type"] == "BPE" and form["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        self.fresh: list[str] = []
        self.places = _Places(self.fresh)
        # ids of all pieces in a row, and where those of each begin; the arrays double when they are full
        self.known = self.used = 0
        self.lengths, self.starts, self.pool = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    @staticmethod
    def _room(a: np.ndarray, size: int) -> np.ndarray:
        """``a`` with room for ``size`` entries."""
        return a if size <= len(a) else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)])

    def _learn(self) -> None:
        """Tokenises the new pieces: words of Latin letters by the model alone, the others by the whole tokenizer."""
        ids: list[list[int]] = [[]] * len(self.fresh)
        other, is_word, tokenize = [], self.word.fullmatch, self.model.tokenize
        for k, p in enumerate(self.fresh):
            if is_word(p):
                letters = p.replace(" ", SPACE) if p.isascii() else p.encode().decode("latin-1").translate(LETTER_OF)
                ids[k] = [t.id for t in tokenize(letters)]
            else:
                other.append(k)
        for k, e in zip(other, self.tokenizer.encode_batch_fast([self.fresh[k] for k in other], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        count, total = self.known + len(n), self.used + int(n.sum())
        self.lengths, self.starts, self.pool = self._room(self.lengths, count), self._room(self.starts, count), self._room(self.pool, total)
        self.lengths[self.known : count] = n
        self.starts[self.known : count] = self.used + np.cumsum(n) - n
        self.pool[self.used : total] = np.fromiter(chain.from_iterable(ids), np.uint32, total - self.used)
        self.known, self.used = count, total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, ids laid end to end)."""
        pieces = [self.piece.findall(t) if self.by_piece and not self.odd.search(t) else [t] for t in texts]
        n_pieces = np.fromiter(map(len, pieces), np.int64, len(pieces))
        known, used = self.known, self.used
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(pieces)), np.int64, int(n_pieces.sum()))
        if self.fresh:
            self._learn()
        n = self.lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        # half the memory traffic, where 32 bits hold the places
        kind = np.int32 if total + self.used < 1 << 31 else np.int64
        first = (self.starts[at] - ends + n).astype(kind)
        ids = self.pool[np.repeat(first, n) + np.arange(total, dtype=kind)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_pieces)])]
        if len(self.places) > REMEMBERED:
            for piece in self.fresh:
                del self.places[piece]
            # their places are taken by the next ones
            self.known, self.used = known, used
        self.fresh.clear()
        return np.diff(upto), ids


_CACHES: dict[str, PieceCache] = {}


def bpe(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """An encoder for ``write``: the tokenizer file at ``path``, no special tokens added; one cache per worker."""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if path not in _CACHES:
            _CACHES[path] = PieceCache(path)
        return _CACHES[path].encode(texts)

    return encode


def _portions(texts: list[str], most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with some ``most`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


FILES = "file string, first struct<id:long,h:long,tie:long>, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents into files under ``folder`` and returns (file, start, n_docs, n_ids) of each.

    ``end_id`` closes every document. Documents ascend by id (null first) within a file and from file to file; of
    equal ids, by a hash of the text; ``start`` is the number of ids in earlier files. Null and empty texts have the
    end id only, bytes that are no UTF-8 become U+FFFD, repeated rows are documents of their own, other columns are
    ignored, an empty table writes no file. Documents are dealt by ranges of (id, hash), equal rows over several parts;
    a task holds one batch of texts and a portion of ids. A file gets its final name when it is complete, so a task that
    runs again leaves the same files.
    """
    spark = docs.sparkSession
    t = F.col(f"`{text_col}`").cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("h"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)).alias("tie"), t.alias("t"))
    where, base = open_at(folder)
    where.create_dir(base, recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_at(folder)
        # a task's number, and its attempt for names that no other attempt uses
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out, name, done, made = None, "", 0, []

        def finish() -> None:
            out.close()
            where.move(f"{base}/.{attempt}-{name}", f"{base}/{name}")
            made[-1] = (name, *made[-1][1:], len(out.docs), out.n)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [(x or b"").decode("utf-8", "replace") for x in b.column(3).to_pylist()]
            for i, j in _portions(texts):
                counts, tokens = encode(texts[i:j])
                # one end id after each document
                closed = np.insert(tokens, np.cumsum(counts), end_id)
                if out is None:
                    name = f"part-{part:06d}-{done:04d}.s8b"
                    out = Writer(where.open_output_stream(f"{base}/.{attempt}-{name}"))
                    made.append((name, {"id": ids[i], "h": b.column(1)[i].as_py(), "tie": b.column(2)[i].as_py()}))
                out.add(ids[i:j], counts + 1, closed)
                if out.n >= FILE:
                    finish()
                    out, done = None, done + 1
        if out is not None:
            finish()
        first = pa.struct([("id", pa.int64()), ("h", pa.int64()), ("tie", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), first, pa.int64(), pa.int64()))], ["file", "first", "n_docs", "n_ids"])

    keys = ["id", "h", "tie"]
    # both sides hold an Arrow batch several times over
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(save, FILES).write.parquet(f"{folder}/files")
    # one row per file
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    start = F.coalesce(F.sum("n_ids").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.select("file", start.alias("start"), "n_docs", "n_ids")


def read(files: DataFrame, folder: str, part: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, decoded ``part`` ids at a time.

    ``start`` counts the ids of all earlier documents; the checksum is that of the ids as little-endian 32-bit numbers.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_at(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                with where.open_input_file(path) as file:
                    r = Reader(file, where.get_file_info(path).size)
                    ends = np.cumsum(r.counts)
                    begins = ends - r.counts
                    crc = np.zeros(len(ends), np.int64)
                    for a in range(0, r.n, part):
                        z = min(a + part, r.n)
                        data = memoryview(r.read(a, z).astype("<u4").tobytes())
                        for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, z, "left"))):
                            crc[k] = zlib.crc32(data[4 * (max(begins[k], a) - a) : 4 * (min(ends[k], z) - a)], int(crc[k]))
                    for i in range(0, len(ends), 1 << 16):
                        j = slice(i, i + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(r.docs[j], pa.int64()), pa.array(start + begins[j]), pa.array(r.counts[j]), pa.array(crc[j])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = files.count()
    return files.select("file", "start").repartition(max(n, 1), "file").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``write`` with a tokenizer file, then ``read``."""
    return read(write(docs, folder, bpe(tokenizer), end_id, id_col, text_col), folder)
