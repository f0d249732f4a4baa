"""Token ids in fixed-width bit-packed files, with random access to blocks and documents.

File: the ids of a run of documents, each in the fewest bits that hold the vocabulary, in blocks of ``BLOCK`` ids; every
block starts on a whole byte, and eight ids always fill ``bits`` bytes, so numpy packs and unpacks a block by columns.
Then three arrays of little-endian 64-bit integers: the byte offset of each block, each document's id, and the index of
each document's first id (one more entry than documents).  The last 48 bytes are a footer: magic, bits, ids, documents,
blocks, offset of the arrays.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from .common import LETTERS, UNIT, UnitCache, in_arrow, kept

MAGIC = b"PACKIDS1"
FOOTER = struct.Struct("<8s5q")
BLOCK = 1 << 14
READ_IDS = 1 << 20
#: Units in the cache of a worker: one that comes again after more others than these is encoded anew.
CACHED = 400_000
#: The array type of four bytes.
IDS = "I" if array("I").itemsize == 4 else "L"

#: Byte-level files write a byte that is no printable Latin-1 character as the next character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
WORD = re.compile(f" ?[{LETTERS}]+")


def bits_for(size: int) -> int:
    """The fewest bits that hold the ids of a vocabulary of ``size`` entries."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bits first."""
    groups = -(-len(ids) // 8)
    rows = np.zeros(groups * 8, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(groups, 8)
    out = np.zeros((groups, bits), np.uint8)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        moved = rows[:, j] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, first + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The ``count`` ids of ``pack``."""
    groups = -(-count // 8)
    rows = np.zeros(groups * bits, np.uint8)
    rows[: len(data)] = np.frombuffer(data, np.uint8)
    rows = rows.reshape(groups, bits)
    out = np.zeros((groups, 8), np.uint64)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        for k in range(-(-(shift + bits) // 8)):
            out[:, j] |= rows[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] >>= np.uint64(shift)
    return (out.reshape(-1)[:count] & np.uint64((1 << bits) - 1)).astype(np.uint32)


class PackWriter:
    """Writes one file as ids come; only the unfinished block and the two index arrays are held."""

    def __init__(self, out: io.RawIOBase, bits: int):
        self.out, self.bits = out, bits
        self.docs: list[int] = []
        self.starts, self.offsets = [0], [0]
        self.rest: list[np.ndarray] = []
        self.held = self.count = 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.count += len(ids)
        self.starts.append(self.count)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(ids[at : at + BLOCK])
            self.rest, self.held = [ids[whole:].copy()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        at = self.offsets.pop()
        for values in (self.offsets, self.docs, self.starts):
            self.out.write(np.array(values, "<i8").tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.bits, self.count, len(self.docs), len(self.offsets), at))
        self.out.close()


class PackReader:
    """Random access to one file: any run of ids, any document."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        magic, self.bits, self.count, docs, blocks, at = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        file.seek(at)
        index = np.frombuffer(file.read(8 * (blocks + docs + docs + 1)), "<i8")
        self.offsets = np.append(index[:blocks], at)
        self.docs, self.starts = index[blocks : blocks + docs], index[blocks + docs :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``; only the blocks that hold them are read."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        found = []
        for k in range(first, last + 1):
            a, b = (int(self.offsets[i] - self.offsets[first]) for i in (k, k + 1))
            found.append(unpack(data[a:b], min(BLOCK, self.count - k * BLOCK), self.bits))
        return np.concatenate(found)[start - first * BLOCK : end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def runs(self) -> Iterator[tuple[int, int]]:
        """Documents in runs of about ``READ_IDS`` ids, so that a file is read with bounded memory."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + READ_IDS, "right")) - 1)
            yield i, min(j, n)
            i = j


class JsonTokenizer:
    """The tokenizers library behind a cache of units.

    The split of a byte-level file cuts at the borders of units, whatever stands around them, so units are encoded alone.
    One of letters is one match of that split and goes to the library's model at once; others are encoded many at once.
    A text that holds a special string, and every text of another kind of file, goes to the library whole.  The library
    runs without threads of its own, as Spark has a task for each core."""

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        split = plan.get("pre_tokenizer") or {}
        self.by_unit = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not plan.get("normalizer")
        self.special = [token["content"] for token in plan.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bits = bits_for(self.size)
        self.units = UnitCache(lambda unit: self._units([unit])[0], CACHED)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        words = [w is not None for w in map(WORD.fullmatch, units)]
        others = [u for u, w in zip(units, words, strict=True) if not w]
        done = iter(self._library(others) if others else ())
        out = []
        for unit, word in zip(units, words, strict=True):
            if not word:
                out.append(next(done).tobytes())
                continue
            if unit.isascii():  # only the space is written as another character
                unit = BYTE_LEVEL[32] + unit[1:] if unit[0] == " " else unit
            else:
                unit = unit.encode().decode("latin-1").translate(BYTE_LEVEL)
            out.append(array(IDS, [t.id for t in tokenize(unit)]).tobytes())
        return out

    def _fill(self, units: set[str]) -> None:
        """Puts the ids of ``units`` into the cache: those it had before at once, the others many at a time."""
        old = self.units.old
        missing = [u for u in units if u not in old]
        known = [(u, old[u]) for u in units if u in old]
        for unit, ids in chain(known, zip(missing, self._units(missing), strict=True)):
            self.units.put(unit, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        get, found, missing, again = self.units.get, [], set(), []
        for text in texts:
            if not self.by_unit or any(s in text for s in self.special):
                found.append(self._library([text])[0])
                continue
            units = UNIT.findall(text)
            ids = list(map(get, units))
            if None in ids:
                missing.update(u for u, x in zip(units, ids, strict=True) if x is None)
                again.append((len(found), units))
                found.append(None)
            else:
                found.append(np.frombuffer(b"".join(ids), np.uint32))
        self._fill(missing)
        for i, units in again:
            found[i] = np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.uint32)
        return found


@kept
def tokenizer(path: str) -> JsonTokenizer:
    return JsonTokenizer(path)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_packed(df: DataFrame, folder: str, path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending ``id_col`` order; returns (file, part, n_docs, n_ids) of each file.

    ``folder`` must be reachable by every executor.  Each task writes one file under a name of its own attempt and then
    renames it, so a task that runs again leaves the same file.  A null text is empty; ``end_id`` (none if None) follows
    every document; rows with equal ids are ordered by text and all kept; null ids come first and are stored as the
    smallest 64-bit integer."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, where, part = tokenizer(path), _open(folder), TaskContext.get().partitionId()
        writer = partial = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                if writer is None:
                    partial = posixpath.join(where[1], f"_part-{part:06d}-{uuid.uuid4().hex}")
                    writer = PackWriter(where[0].open_output_stream(partial), coder.bits)
                for doc, ids in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1).to_pylist()), strict=True):
                    writer.add(doc, ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            final = posixpath.join(where[1], f"part-{part:06d}.ids")
            where[0].move(partial, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [final], "n_docs": [len(writer.docs)], "n_ids": [writer.count]})

    where, inner = _open(folder)
    where.create_dir(inner, recursive=True)
    return materialize(in_arrow(placed, run, "part long, file string, n_docs long, n_ids long"), "packed")


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """(id, start, ids binary) of every document of the files of ``manifest``: ``start`` counts the ids of all documents
    before it, ``ids`` are its ids as little-endian unsigned 32-bit integers.  Files are read in runs of bounded size."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("base"))  # as many rows as files
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = _open(folder)[0]
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with where.open_input_file(name) as file:
                    reader = PackReader(file)
                    for i, j in reader.runs():
                        data = reader.ids(int(reader.starts[i]), int(reader.starts[j])).astype("<u4").tobytes()
                        cuts = (reader.starts[i : j + 1] - reader.starts[i]) * 4
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[i:j]), pa.array(base + reader.starts[i:j]), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                            names=["id", "start", "ids"],
                        )

    return in_arrow(files.repartition(parts, "file"), run, "id long, start long, ids binary")


def packed_ids(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` in a new folder of the shared one, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    found = read_packed(write_packed(docs, folder, path), folder)
    return found.select(F.when(F.col("id") != F.lit(-(1 << 63)), F.col("id")).alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
