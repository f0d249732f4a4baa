"""Token counts of a piece model, by merging with a heap over linked symbols.

Only the number of merges is kept: a text has as many tokens as symbols at first, less one for each merge, and no id is
ever looked up or emitted.  A symbol that stays a character outside the vocabulary counts its UTF-8 bytes.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, kept, map_batches

SPACE = "\u2581"


class PieceCounter:
    """Counts for one model whose entries hold the space mark only as a run at their start."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize, self.rank = model.normalize, {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("an entry of the model goes over the start of a word")
        # A run of spaces with the word behind it: no merge joins a word to the space after it, nor a line break that
        # no entry holds to anything.
        alone = "" if any("\n" in piece for piece in self.rank) else "\n"
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}+" if alone else ""))
        # The library first turns a text into what it merges: by an identity model only spaces change, and one is put
        # in front.  Another kind of model is normalised by the library itself.
        probe = " a  e\u0301\xe9\u3000\uff21\t\n "
        plain = SPACE + probe.replace(" ", SPACE)
        self.identity = self.normalize(probe).replace(" ", SPACE) == plain
        self.units = UnitCache(self.count_unit)

    def count_unit(self, unit: str) -> int:
        rank = self.rank
        size = len(unit)
        symbols: list[str | None] = list(unit)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            score = rank.get(unit[i : i + 2])
            if score is not None:
                heap.append((score, i, i + 1, 2))
        heapify(heap)
        merges = 0
        while heap:
            _, left, right, length = heappop(heap)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != length:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = whole, _ = a + b, None
            merges += 1
            follower = after[left] = after[right]
            if follower < size:
                before[follower] = left
                score = rank.get(whole + symbols[follower])
                if score is not None:
                    heappush(heap, (score, left, follower, length + len(symbols[follower])))
            leader = before[left]
            if leader >= 0:
                score = rank.get(symbols[leader] + whole)
                if score is not None:
                    heappush(heap, (score, leader, left, len(symbols[leader]) + length))
        unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in rank)
        return size - merges + unknown

    def count(self, text: str) -> int:
        if not text:
            return 0
        plain = SPACE + text.replace(" ", SPACE) if self.identity else self.normalize(text).replace(" ", SPACE)
        return sum(map(self.units.__getitem__, self.unit.findall(plain)))


@kept
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row; a null text counts as empty: no bytes, no tokens.

    Repeated rows give repeated results, null ids stay null, other columns are not looked at, no text is cut."""

    def run(batch: pa.RecordBatch) -> list:
        count = counter(path).count
        texts = batch.column(1).to_pylist()
        tokens = [count(text) if text else 0 for text in texts]
        return [batch.column(0), [len((text or "").encode()) for text in texts], tokens, [n > limit for n in tokens]]

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, n_bytes long, n_tokens long, over_limit boolean", 2000).withColumnRenamed("id", id_col)
