"""Byte-level BPE by backtracking over dictionary matches.

Bytes are read as Latin-1 characters, so that pyahocorasick finds every vocabulary entry in a piece in one pass.  From
each position the longest entry is tried first; two neighbours are allowed if merging their bytes by rank would give
just those two, which is remembered for each pair of ids.  A position from which nothing fits is marked and never
entered again, so a piece takes time in proportion to its length.  The ids equal those of merging by rank.
"""

from __future__ import annotations

import base64
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNIT, UnitCache, kept, map_batches

# Letters and numbers that the regex module knows and the tokenizer library, being older, does not.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
#: Stands for them while pieces are cut: a private-use character is neither letter, number nor white space.
_OTHER = "\ue000"


@kept
def words_of(path: str) -> dict[int, bytes]:
    """The bytes of each id of a rank file; all that decoding needs."""
    with open(path, "rb") as file:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}


class ByteBpe:
    """Encoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.words = words_of(path)
        self.ranks = ranks = {word: rank for rank, word in self.words.items()}
        self.length = {rank: len(word) for word, rank in ranks.items()}
        #: The longest entry that an entry begins with, other than itself.
        self.shorter = {rank: next((ranks[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in ranks), None) for word, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.kind = "H" if max(ranks.values(), default=0) < 1 << 16 else "I"
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, rank in ranks.items():
            self.found.add_word(word.decode("latin-1"), rank)
        self.found.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank in sorted(self.words):
            self._learn(rank)
        self.fits.clear()  # what was asked while later merges were unknown
        self.units = UnitCache(self._unit)

    def _learn(self, rank: int) -> None:
        """The two entries whose merge makes this one; an entry of one byte, or one never merged, is its own halves."""
        word = self.words[rank]
        self.halves[rank] = (rank, rank)
        for cut in range(1, len(word)):
            left, right = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
            if left is not None and right is not None and left < rank and right < rank and self._neighbours(left, right):
                self.halves[rank] = (left, right)
                self.joined[left, right] = rank
                return

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of ``left`` and ``right`` together gives just these two ids.

        Undo the later of the two last merges again and again, looking at the ids that face each other over the border:
        if they could have merged before that, the border would not have survived."""
        before = 1 << 62
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < before:
                return False
            if left > right:
                before, left = left, self.halves[left][1]
                if left != before:
                    continue
                before, old = right + 1, right
                right = self.halves[right][0]
                if right == old:
                    return True
            else:
                before, old = right + 1, right
                right = self.halves[right][0]
                if right != old:
                    continue
                before, old = left, left
                left = self.halves[left][1]
                if left == old:
                    return True

    def _compatible(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 120_000:
                self.fits.clear()
            known = self.fits[left, right] = self._neighbours(left, right)
        return known

    def piece(self, word: bytes) -> list[int]:
        """The ids of one match of the split pattern."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        size, length, shorter, compatible = len(word), self.length, self.shorter, self._compatible
        longest = [-1] * size  # the longest entry from each position; every single byte is one
        for end, rank in self.found.iter(word.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank
        closed, out, at = bytearray(size + 1), [], 0
        rank = longest[0]
        while True:
            while rank is not None and (closed[at + length[rank]] or out and not compatible(out[-1], rank)):
                rank = shorter[rank]
            if rank is None:
                closed[at] = 1
                last = out.pop()
                at -= length[last]
                rank = shorter[last]
            else:
                out.append(rank)
                at += length[rank]
                if at == size:
                    return out
                rank = longest[at]

    def pieces(self, text: str) -> list[str]:
        """The matches of the split pattern, cut as the library's older tables of letters would."""
        if text.isascii() or not _NEWER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_NEWER.sub(_OTHER, text))]

    def _unit(self, text: str) -> bytes:
        ids = [rank for piece in self.pieces(text) for rank in self.piece(piece.encode())]
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.units.__getitem__, UNIT.findall(text))), self.kind)

@kept
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each Python worker."""
    return ByteBpe(path, pattern)


def _encoded(bpe: ByteBpe, texts: list[str | None]) -> pa.ListArray:
    found = [bpe.encode(text) if text else np.empty(0, bpe.kind) for text in texts]
    ends = np.cumsum([0, *map(len, found)])
    flat = np.concatenate([np.empty(0, np.int32), *found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _decoded(words: dict[int, bytes], lists: pa.ListArray) -> list[bytes]:
    ends = [0, *np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()]
    ids = lists.flatten().to_numpy().tolist()
    return [b"".join(map(words.__getitem__, ids[a:b])) for a, b in zip(ends, ends[1:], strict=False)]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): one row per row of ``df``, whole texts; a null or empty text has an empty list.

    Repeated rows give repeated results, null ids stay null, other columns are not looked at."""

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), _encoded(coder(path, pattern), batch.column(1).to_pylist())]

    return map_batches(_texts(df, id_col, text_col), run, "id long, ids array<int>", 1000).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded binary): the bytes of each list of ids; a null list has no bytes."""

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), batch.column(1), _decoded(words_of(path), batch.column(1))]

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), run, "id long, ids array<int>, decoded binary", 1000).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode`` makes of ``encode``, in one pass: a task has one Python worker with one set of tables, not two."""

    def run(batch: pa.RecordBatch) -> list:
        bpe = coder(path, pattern)
        ids = _encoded(bpe, batch.column(1).to_pylist())
        return [batch.column(0), ids, _decoded(bpe.words, ids)]

    return map_batches(_texts(df, id_col, text_col), run, "id long, ids array<int>, decoded binary", 250).withColumnRenamed("id", id_col)


def digests(df: DataFrame) -> DataFrame:
    """Lengths and digests of what ``decode`` returns."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
