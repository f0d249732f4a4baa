"""Gram bags as exact 64-bit ids, for joins.

A slice of two to four UTF-16 units packs into one integer without loss, so the ids never collide and the gram
joins run on longs.  Spark prepares the marked text in the JVM and decides the partitioning; the slicing is array
arithmetic inside the tasks, with Arrow batches in and flat rows out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Ship these helpers with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_ROWS = "it binary, ot binary, inner_shared bigint, inner_total bigint, outer_shared bigint, outer_total bigint"


def marked_texts(c: Column) -> tuple[Column, Column]:
    """The marked text and, where there is Hangul, its letter-level spelling."""
    base = F.trim(T.mask_numbers(c))
    return T.marked(base), F.when(base.rlike(f"[{T.HANGUL}]"), T.marked(T.flatten_jamo(base)))


def _slice_ids(marked: str) -> np.ndarray:
    u = np.frombuffer(marked.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint64)
    two = (u[:-1] << np.uint64(16)) | u[1:]
    three = (two[:-1] << np.uint64(16)) | u[2:]
    four = (three[:-1] << np.uint64(16)) | u[3:]
    return np.concatenate([two, three, four]).view(np.int64)


def bag(plain: str, letters: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and integer weights: 2 per plain slice and 1 per letter-level slice; 3 where both are the same."""
    if letters is None:
        ids, n = np.unique(_slice_ids(plain), return_counts=True)
        return ids, n * 3
    a = _slice_ids(plain)
    return np.unique(np.concatenate([a, a, _slice_ids(letters)]), return_counts=True)


#: Lines that are scored at once, and grams that many fragments hold and that go through one matrix product.
CHUNK = 256
DENSE = 2048


class FragmentBlock:
    """A bounded block of question fragments: for each gram the fragments that hold it, with their weights.

    The longest lists are rows of a matrix, so that a chunk of lines meets them in one product; the others are walked.
    Sums of weights are whole numbers and exact in either way."""

    def __init__(self, rows: list[tuple]):
        """rows: (q, weight, plain, letters, size) of each fragment."""
        number: dict = {}
        for r in rows:
            number.setdefault(r[0], len(number))
        rows = sorted(rows, key=lambda r: number[r[0]])
        self.names = list(number)
        self.question = np.array([number[r[0]] for r in rows])
        self.factor = np.array([r[1] for r in rows], np.float64)
        self.length = np.array([r[4] for r in rows])
        bags = [bag(r[2], r[3]) for r in rows]
        grams, weights = np.concatenate([g for g, _ in bags]), np.concatenate([n for _, n in bags])
        owner = np.repeat(np.arange(len(bags)), [len(g) for g, _ in bags])
        order = np.argsort(grams, kind="stable")
        self.owner, self.weight = owner[order], weights[order].astype(np.float64)
        self.grams, self.start = np.unique(grams[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(grams)))
        self.total = np.array([n.sum() for _, n in bags], np.float64)
        self.distinct = np.array([len(g) for g, _ in bags])
        # What the d heaviest grams of a fragment weigh, for every d.
        heavy = [np.cumsum(np.sort(n)[::-1]) for _, n in bags]
        self.heavy, self.heavy_start = np.concatenate(heavy).astype(np.float64), np.cumsum([0, *(len(h) for h in heavy)])[:-1]
        often = np.argsort(-self.count, kind="stable")[:DENSE]
        often = often[self.count[often] >= max(8, len(rows) // 32)]
        self.column = np.full(len(self.grams), -1)
        self.column[often] = np.arange(len(often))
        self.there, self.heft = np.zeros((len(often), len(rows)), np.float32), np.zeros((len(often), len(rows)), np.float32)
        place, sizes = self._places(often)
        row = np.repeat(np.arange(len(often)), sizes)
        self.there[row, self.owner[place]] = 1
        self.heft[row, self.owner[place]] = self.weight[place]

    @cached_property
    def tables(self) -> "GramTables":
        return GramTables(self)

    def _places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the lists of the grams ``at`` one after another, how many each gram has)."""
        sizes = self.count[at]
        ends = np.cumsum(sizes)
        return np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0), sizes

    def bounds(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each fragment a score that no line of the chunk exceeds, from numbers and weights of grams alone."""
        most = max(len(g) for g, _ in bags)
        outer = self.heavy[self.heavy_start + np.minimum(self.distinct, most) - 1] / self.total
        inner = np.zeros(len(self.total))
        for _, n in bags:
            heavy = np.cumsum(np.sort(n)[::-1])
            np.maximum(inner, heavy[np.minimum(self.distinct, len(heavy)) - 1] / heavy[-1], out=inner)
        return np.sqrt(inner * outer) * self.factor + 1e-9

    def overlaps(self, bags: list[tuple[np.ndarray, np.ndarray]], active: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(inner, outer, total): what each line shares with each ``active`` fragment by the line's weights and, if ``both``,
        by the fragment's, and the weight of each line."""
        many, wide = len(bags), len(active)
        ids, n = np.concatenate([g for g, _ in bags]), np.concatenate([c for _, c in bags])
        line = np.repeat(np.arange(many), [len(g) for g, _ in bags])
        at = np.minimum(np.searchsorted(self.grams, ids), len(self.grams) - 1)
        hit = self.grams[at] == ids
        at, n, line = at[hit], n[hit], line[hit]
        total = np.array([c.sum() for _, c in bags], np.float64)
        exact = np.float32 if max(total.max(), self.total.max()) < 1 << 24 else np.float64
        column = self.column[at]
        dense = column >= 0
        all_of = wide == len(self.total)
        cell = line[dense] * len(self.there) + column[dense]

        def product(values: np.ndarray | float, side: np.ndarray) -> np.ndarray:
            rows = np.zeros(many * len(side), exact)
            rows[cell] = values
            return (rows.reshape(many, -1) @ (side if all_of else side[:, active]).astype(exact, copy=False)).astype(np.float64)

        inner = product(n[dense], self.there)
        outer = product(1, self.heft) if both else None
        place, sizes = self._places(at[~dense])
        owner = self.owner[place]
        row, mine_n = np.repeat(line[~dense], sizes), np.repeat(n[~dense], sizes)
        if not all_of:
            where = np.full(len(self.total), -1)
            where[active] = np.arange(wide)
            owner = where[owner]
            keep = owner >= 0
            owner, row, mine_n, place = owner[keep], row[keep], mine_n[keep], place[keep]
        cell = row * wide + owner
        inner += np.bincount(cell, mine_n, many * wide).reshape(many, wide)
        if both:
            outer += np.bincount(cell, self.weight[place], many * wide).reshape(many, wide)
        return inner, outer, total

    def scores(self, bags: list[tuple[np.ndarray, np.ndarray]], active: np.ndarray) -> np.ndarray:
        """Geometric score of each line against each ``active`` fragment, -1 where they share no gram."""
        inner, outer, total = self.overlaps(bags, active)
        score = np.sqrt((inner / total[:, None]) * (outer / self.total[active]))
        score[inner == 0] = -1.0
        return score


class GramTables:
    """Tables by which a chunk of lines finds the grams of a block, and what bounds and scores its pairs of line and fragment.

    A gram is looked up by its first slice and its next unit, so every place of a text costs a few array reads.  First the
    lines meet whole questions (a gram counts if any fragment of the question holds it), which bounds every fragment of
    the question; only pairs whose bound reaches the bar are scored, by the grams of the fragment."""

    #: Cells of a chunk's matrix and of a table, grams of pairs that are read at once, steps by which a line's grams are counted.
    CELLS, TABLE, READ, STEPS = 1 << 22, 1 << 24, 1 << 20, 4

    def __init__(self, block: FragmentBlock):
        self.block = b = block
        self.many = int(b.question.max()) + 1
        gram = np.repeat(np.arange(len(b.grams)), b.count)
        held = np.unique(gram * self.many + b.question[b.owner])
        of, question = held // self.many, held % self.many
        count = np.bincount(of, minlength=len(b.grams))
        # The grams of most questions come first, so that those for the matrix product lie side by side.
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.dense = int(min(DENSE, (count >= max(4, self.many // 32)).sum()))
        self.held = np.zeros((self.dense, self.many), np.float32)
        first = rank[of] < self.dense
        self.held[rank[of[first]], question[first]] = 1
        by = np.argsort(rank[of], kind="stable")
        self.owners, self.sizes = question[by], count[order]
        self.start = np.cumsum(self.sizes) - self.sizes
        by = np.argsort(b.owner, kind="stable")
        self.frag_gram, self.frag_heft = rank[gram[by]], b.weight[by]
        self.frag_start = np.cumsum(b.distinct) - b.distinct
        self._tables(b.grams.view(np.uint64), rank)

    def _tables(self, ids: np.ndarray, rank: np.ndarray) -> None:
        size = np.where(ids >> np.uint64(32) == 0, 2, np.where(ids >> np.uint64(48) == 0, 3, 4))
        units = np.unique(np.concatenate([(ids >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(2)]))
        self.code = np.zeros(1 << 16, np.int64)
        self.code[units.astype(np.int64)] = np.arange(1, len(units) + 1)
        self.wide = wide = len(units) + 1
        last = lambda x: self.code[(x & np.uint64(0xFFFF)).astype(np.int64)]
        self.next, self.gram = [], []
        prefixes, numbers = units, np.arange(1, len(units) + 1)
        self.small = True
        for k in (2, 3, 4):
            mine = ids[size == k]
            # One text's slices hold the first units of each of them, so there is a row for every one.
            row = numbers[np.searchsorted(prefixes, mine >> np.uint64(16))]
            if (len(prefixes) + 1) * wide > self.TABLE:
                self.small, self.grams, self.rank = False, self.block.grams, rank
                return
            table = np.zeros((len(prefixes) + 1) * wide, np.int32)
            table[row * wide + last(mine)] = np.arange(1, len(mine) + 1)
            self.next.append(table)
            self.gram.append(np.concatenate([[-1], rank[size == k]]))
            prefixes, numbers = mine, np.arange(1, len(mine) + 1)

    def matrix(self, texts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cells, total, line, gram, weight): what each gram of the block weighs in each text (plain, letters), what a text weighs in all,
        and what is added to which cell."""
        pieces, owner, heft = [], [], []
        for i, (plain, letters) in enumerate(texts):
            pieces.append(plain)
            owner.append(i)
            heft.append(3 if letters is None else 2)
            if letters is not None:
                pieces.append(letters)
                owner.append(i)
                heft.append(1)
        # No marked text holds a zero.
        u = np.frombuffer(("\0".join(pieces) + "\0").encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        ends = np.flatnonzero(u == 0)
        length = np.diff(np.concatenate([[-1], ends])) - 1
        owner, heft = np.array(owner), np.array(heft)
        total = np.bincount(owner, heft * sum(np.maximum(length - k, 0) for k in (1, 2, 3)), len(texts))
        piece = np.repeat(np.arange(len(pieces)), length + 1)
        at, where = [], []
        if self.small:
            code = self.code[u]
            node = code
            for k in range(3):
                node = self.next[k][node[: len(u) - k - 1] * self.wide + code[k + 1 :]]
                spot = np.flatnonzero(node)
                at.append(self.gram[k][node[spot]])
                where.append(piece[spot])
        else:
            x = u.astype(np.uint64)
            slice_, ok = x, u != 0
            for k in range(3):
                slice_, ok = (slice_[:-1] << np.uint64(16)) | x[k + 1 :], ok[:-1] & (u[k + 1 :] != 0)
                spot = np.flatnonzero(ok)
                own = slice_[spot].view(np.int64)
                near = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                hit = self.grams[near] == own
                at.append(self.rank[near[hit]])
                where.append(piece[spot[hit]])
        gram, piece = np.concatenate(at), np.concatenate(where)
        line, weight = owner[piece], heft[piece]
        exact = np.float32 if max(total.max(), self.block.total.max()) < 1 << 24 else np.float64
        cells = np.zeros(len(texts) * len(self.sizes), exact)
        np.add.at(cells, line * len(self.sizes) + gram, weight.astype(exact))
        return cells.reshape(len(texts), -1), total, line, gram, weight

    def pairs(self, texts: list[tuple], bar: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(line, fragment, score) of all pairs that may reach the bar of their question; -1 where no gram is shared.  None if
        they are so many that one product of all costs less."""
        b = self.block
        cells, total, line, gram, weight = self.matrix(texts)
        shared = (cells[:, : self.dense] @ self.held.astype(cells.dtype, copy=False)).astype(np.float64)
        rare = gram >= self.dense
        sizes = self.sizes[gram[rare]]
        ends = np.cumsum(sizes)
        place = np.repeat(self.start[gram[rare]] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        spot = np.repeat(line[rare], sizes) * self.many + self.owners[place]
        shared += np.bincount(spot, np.repeat(weight[rare], sizes), shared.size).reshape(shared.shape)
        # At most so many grams are shared: rare ones may count twice.
        value, post = cells.ravel().take(line * cells.shape[1] + gram).astype(np.float64), line
        share = weight / value
        most = ((cells[:, : self.dense] > 0).astype(np.float32) @ self.held).astype(np.int64) + np.bincount(spot, minlength=shared.size).reshape(shared.shape)
        inner = shared / total[:, None]
        # An outer part is at most one, so most questions go before their fragments are looked at.
        some_line, some = np.nonzero(np.sqrt(inner) * self.top + room + 1e-9 >= bar)
        n = self.frags[some]
        ends = np.cumsum(n)
        frag = np.repeat(self.first[some] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        line, question = np.repeat(some_line, n), np.repeat(some, n)
        c = np.minimum(most[line, question], b.distinct[frag])
        outer = b.heavy[b.heavy_start[frag] + np.maximum(c, 1) - 1] / b.total[frag]
        keep = np.sqrt(inner[line, question] * outer) * b.factor[frag] + room + 1e-9 >= bar[question]
        line, frag, question, c, outer = line[keep], frag[keep], question[keep], c[keep], outer[keep]
        # What the c heaviest grams of a text weigh at most: grams by how often they are there, in a few steps.
        unit = np.array([3 if letters is None else 1 for _, letters in texts], np.float64)
        heaviest, left = np.zeros(len(line)), cells.sum(axis=1, dtype=np.float64)
        for step in range(self.STEPS):
            more = value > unit[post] * step
            n = np.bincount(post[more], share[more], len(texts))  # the shares of a gram's places add up to one
            heaviest += np.minimum(c, n[line]) * unit[line]
            left -= n * unit
        keep = np.sqrt(np.minimum(inner[line, question], (heaviest + np.maximum(left, 0)[line] + 1e-6) / total[line]) * outer) * b.factor[frag] + room + 1e-9 >= bar[question]
        line, frag = line[keep], frag[keep]
        if len(line) * 10 > len(texts) * len(b.total):
            return None
        score = np.empty(len(line))
        flat, ends = cells.ravel(), np.cumsum(b.distinct[frag])
        cut = [0, *np.searchsorted(ends, np.arange(self.READ, int(ends[-1]) if len(ends) else 0, self.READ)), len(line)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            i, f = line[lo:hi], frag[lo:hi]
            n = b.distinct[f]
            begin = np.cumsum(n) - n
            place = np.repeat(self.frag_start[f] - begin, n) + np.arange(int(n.sum()))
            mine = flat.take(np.repeat(i * cells.shape[1], n) + self.frag_gram[place]).astype(np.float64)
            ins, outs = np.add.reduceat(mine, begin), np.add.reduceat(np.where(mine > 0, self.frag_heft[place], 0.0), begin)
            score[lo:hi] = np.where(ins == 0, -1.0, np.sqrt((ins / total[i]) * (outs / b.total[f])))
        return line, frag, score

    @property
    def first(self) -> np.ndarray:
        return self._by_question[0]

    @property
    def frags(self) -> np.ndarray:
        return self._by_question[1]

    @property
    def top(self) -> np.ndarray:
        return self._by_question[2]

    @cached_property
    def _by_question(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each question the first fragment, how many it has, and the largest weight of one."""
        first = np.searchsorted(self.block.question, np.arange(self.many))
        return first, np.diff(np.append(first, len(self.block.question))), np.maximum.reduceat(self.block.factor, first)


class _Best:
    """The ``keep`` best nodes of one source for each question so far; ``bars`` (of questions, by name) are scores that as many
    nodes reach elsewhere, ``least`` one below which no node counts."""

    def __init__(self, block: FragmentBlock, keep: int, digits: int | None = None, bars: dict | None = None, least: float | None = None):
        self.block, self.keep, self.digits = block, keep, digits
        self.found: list[list[tuple]] = [[] for _ in block.names]
        self.bar = np.full(len(block.names), -1.0 if least is None else least)
        for k, name in enumerate(block.names):
            self.bar[k] = max(self.bar[k], (bars or {}).get(name, -1.0))

    def add(self, lines: list[tuple], short: int, scale: float) -> None:
        """lines: (node, plain, letters, size); a line that no question's last best one is below is not scored."""
        step = max(1, min(len(lines), GramTables.CELLS // len(self.block.grams)))
        for lo in range(0, len(lines), step):
            if (self.bar > 0).mean() < 0.5 or not self._few(lines[lo : lo + step], short, scale):
                self._all(lines[lo : lo + step], short, scale)

    def _few(self, lines: list[tuple], short: int, scale: float) -> bool:
        b = self.block
        texts: dict[tuple, list] = {}
        for node, *text in lines:
            texts.setdefault(tuple(text), []).append(node)
        size = np.array([x[2] for x in texts])
        found = b.tables.pairs([x[:2] for x in texts], self.bar, 0.0 if self.digits is None else 10.0**-self.digits)
        if found is None:
            return False
        line, frag, score = found
        guarded = (size[line] < short) & (b.length[frag] > scale * size[line])
        score = np.where(guarded & (score > 0), 0.0, score)
        value = np.where(score < 0, -1.0, score * b.factor[frag])
        if self.digits is not None:
            value = np.round(value, self.digits)
        nodes = list(texts.values())
        for k in np.flatnonzero((value >= 0) & (value >= self.bar[b.question[frag]])):
            q = int(b.question[frag[k]])
            if value[k] >= self.bar[q]:
                for node in nodes[line[k]]:
                    self._put(q, float(value[k]), node)
        return True

    def _all(self, lines: list[tuple], short: int, scale: float) -> None:
        b = self.block
        texts = {x: i for i, x in enumerate(dict.fromkeys(x[1:] for x in lines))}
        bags = [bag(plain, letters) for plain, letters, _ in texts]
        active = np.flatnonzero(b.bounds(bags) + (0.0 if self.digits is None else 10.0**-self.digits) >= self.bar[b.question])
        if not len(active):
            return
        scores = b.scores(bags, active)
        size = np.array([x[2] for x in texts])
        guarded = (size < short)[:, None] & (b.length[active] > scale * size[:, None])
        scores[guarded & (scores > 0)] = 0.0
        values = np.where(scores < 0, -1.0, scores * b.factor[active])
        if self.digits is not None:
            values = np.round(values, self.digits)
        question = b.question[active]
        first = np.flatnonzero(np.concatenate([[True], question[1:] != question[:-1]]))
        values, question = np.maximum.reduceat(values, first, axis=1), question[first]
        nodes = sorted({x[0] for x in lines})
        rank = {x: i for i, x in enumerate(nodes)}
        of = np.array([rank[x[0]] for x in lines])
        order = np.argsort(of, kind="stable")
        text = np.array([texts[x[1:]] for x in lines])[order]
        # Nodes are in order, so the first of equal scores is the smallest node.
        values = np.maximum.reduceat(values[text], np.searchsorted(of[order], np.arange(len(nodes))), axis=0)
        each = np.arange(len(question))
        for _ in range(min(self.keep, len(nodes))):
            top = values.argmax(axis=0)
            score = values[top, each]
            values[top, each] = -2.0
            for k in np.flatnonzero((score >= 0) & (score >= self.bar[question])):
                self._put(int(question[k]), float(score[k]), nodes[top[k]])

    def _put(self, q: int, score: float, node) -> None:
        held = dict((n, -s) for s, n in self.found[q])
        held[node] = max(score, held.get(node, -1.0))
        self.found[q] = sorted((-s, n) for n, s in held.items())[: self.keep]
        if len(self.found[q]) == self.keep:
            self.bar[q] = max(self.bar[q], -self.found[q][-1][0])


def best_nodes(dealt: DataFrame, keep: int, short: int, scale: float, schema: str, digits: int | None = None, least: float | None = None) -> DataFrame:
    """(q, source, node, score): per question and source the best nodes of each group (tile, block) of ``dealt``, whose
    rows come in order with the fragments of the block before the lines of the tile, lines by source.

    Columns: tile, block, kind (0 a fragment, 1 a line), q, weight, source, node, plain, letters, size.  A fragment without
    text is a bar: that ``keep`` nodes of the source reach the score ``weight`` for the question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, bars, block, source, best, lines, kinds = None, [], {}, None, None, None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None:
                if lines:
                    best.add(lines, short, scale)
                rows = [(q, source, n, -s) for q, held in zip(best.block.names, best.found, strict=True) for s, n in held]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["q", "source", "node", "score"])

        for batch in batches:
            kinds = [batch["q"].type, batch["source"].type, batch["node"].type, pa.float64()]
            for tile, blk, kind, q, weight, src, node, plain, letters, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (tile, blk):
                    yield from out()
                    group, asked, bars, block, source, best, lines = (tile, blk), [], {}, None, None, None, []
                if kind == 0:
                    if plain is None:
                        bars.setdefault(src, {})[q] = weight
                    else:
                        asked.append((q, weight, plain, letters, size))
                    continue
                if not asked:
                    continue
                block = block or FragmentBlock(asked)
                if best is None or src != source:
                    yield from out()
                    source, best, lines = src, _Best(block, keep, digits, bars.get(src), least), []
                lines.append((node, plain, letters, size))
                if len(lines) >= CHUNK:
                    best.add(lines, short, scale)
                    lines = []
        yield from out()

    return dealt.mapInArrow(run, schema)


# --- pairs of texts by coverage: tiles of inner texts run past blocks of outer ones ---

#: Rows of a batch of pairs.
OUT = 1 << 16
#: Grams of a tile's texts that are kept from one block to the next; those of further texts are counted anew for each.
HELD = 12 << 20


def _past_blocks(batches: Iterator[pa.RecordBatch], size: int, start, take, done) -> Iterator[pa.RecordBatch]:
    """Rows (tile, block, kind, tid, plain, letters, ...) in order by tile, block and kind.  A group's outer texts (kind 0) make
    blocks of ``size``, past which its inner ones (kind 1) run: ``start(asked, rows)`` for each group, ``take(block, lo, rows, at,
    bags)`` of each chunk of inner texts, where ``lo`` and ``at`` are the places of the first outer and inner one in the group,
    and ``done(block)`` after the last chunk of a block."""
    group, asked, rows = None, [], []

    def meet() -> Iterator[pa.RecordBatch]:
        if not asked or not rows:
            return
        start(asked, rows)
        held, room = {}, HELD
        for lo in range(0, len(asked), size):
            block = FragmentBlock(asked[lo : lo + size])
            for at in range(0, len(rows), CHUNK):
                chunk, bags = rows[at : at + CHUNK], held.get(at)
                if bags is None:
                    bags = [(g, n.astype(np.int32)) for g, n in (bag(r[1], r[2]) for r in chunk)]
                    if room > 0 and lo + size < len(asked):
                        held[at] = bags
                        room -= sum(len(g) for g, _ in bags)
                yield from take(block, lo, chunk, at, bags)
            yield from done(block)

    for batch in batches:
        for tile, blk, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != (tile, blk):
                yield from meet()
                group, asked, rows = (tile, blk), [], []
            if kind == 0:
                asked.append((row[0], 1.0, row[1], row[2], 0))
            elif asked:
                rows.append(row)
    yield from meet()


class _Forest:
    """Which of a group's texts its links connect so far; a text that is both an outer and an inner one is one node."""

    def __init__(self, asked: list, rows: list):
        where = {a[0]: k for k, a in enumerate(asked)}
        self.own = np.array([where.get(r[0], len(asked) + i) for i, r in enumerate(rows)])
        self.root = np.arange(len(asked) + len(rows))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return int(x)

    def links(self, line: np.ndarray, col: np.ndarray, lo: int, at: int, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Of hits (line, col), in order by line, those that connect what earlier ones do not: fewer in all than there are nodes."""
        kept = []
        first = np.searchsorted(line, np.arange(many + 1))
        for i in np.flatnonzero(np.diff(first)):
            own, mine = self.find(self.own[at + i]), col[first[i] : first[i + 1]]
            labels, of = np.unique(self.root[lo + mine], return_index=True)
            for label, k in zip(labels.tolist(), of.tolist(), strict=True):
                other = self.find(label)
                if other != own:
                    self.root[other] = own
                    kept.append((i, mine[k]))
        while (self.root != (flat := self.root[self.root])).any():
            self.root = flat
        return tuple(np.array(kept, np.int64).reshape(-1, 2).T)


def block_pairs(dealt: DataFrame, size: int, threshold: float, geometric: float = 0.0, forest: bool = False) -> DataFrame:
    """Shared and total weights of the pairs of each group (tile, block) that share a gram and whose inner coverage reaches
    ``threshold`` and geometric score ``geometric``.  With ``forest`` only those that connect texts which earlier pairs of
    the group do not, none of a text with itself: fewer than a group has texts, however many pairs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None

        def start(asked: list, rows: list) -> None:
            nonlocal trees
            trees = _Forest(asked, rows) if forest else None

        def take(block: FragmentBlock, lo: int, rows: list, at: int, bags: list) -> Iterator[pa.RecordBatch]:
            both = not forest or geometric > 0
            inner, outer, total = block.overlaps(bags, np.arange(len(block.total)), both)
            hit = (inner > 0) & (inner >= total[:, None] * threshold)
            if geometric > 0:
                hit &= np.sqrt((inner / total[:, None]) * (outer / block.total)) >= geometric - 1e-9
            line, col = np.nonzero(hit)
            if forest:
                line, col = trees.links(line, col, lo, at, len(rows))
            its, ots = pa.array([r[0] for r in rows], pa.binary()), pa.array(block.names, pa.binary())
            for lo in range(0, len(line), OUT):
                i, k = line[lo : lo + OUT], col[lo : lo + OUT]
                of = [inner[i, k], total[i], outer[i, k] if both else np.zeros(len(i)), block.total[k]]
                yield pa.RecordBatch.from_arrays(
                    [its.take(pa.array(i)), ots.take(pa.array(k)), *[pa.array(v.astype(np.int64)) for v in of]],
                    names=["it", "ot", "inner_shared", "inner_total", "outer_shared", "outer_total"])

        yield from _past_blocks(batches, size, start, take, lambda block: iter(()))

    return dealt.select("tile", "block", "kind", "tid", "plain", "letters").mapInArrow(run, PAIR_ROWS)


def block_best(dealt: DataFrame, size: int, threshold: float) -> DataFrame:
    """(ot, id, coverage, score): of each group (tile, block) and outer text the best inner text whose coverage reaches
    ``threshold``, by coverage plus ``form`` plus ``marks``; equal scores by the smaller ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def take(block: FragmentBlock, lo: int, rows: list, at: int, bags: list) -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(rows)), key=lambda i: rows[i][3])  # the first of equal scores is the smallest id
            rows, bags = [rows[i] for i in order], [bags[i] for i in order]
            inner, _, total = block.overlaps(bags, np.arange(len(block.total)), False)
            coverage = inner / total[:, None]
            score = coverage + np.array([r[4] for r in rows])[:, None] + np.array([r[5] for r in rows])[:, None]
            score[(inner == 0) | (inner < total[:, None] * threshold)] = -1.0
            top = score.argmax(axis=0)
            for k in np.flatnonzero(score[top, np.arange(len(top))] >= 0):
                i = top[k]
                new = (-float(score[i, k]), rows[i][3], float(coverage[i, k]))
                if k not in held or new < held[k]:
                    held[k] = new
            return iter(())

        def done(block: FragmentBlock) -> Iterator[pa.RecordBatch]:
            if held:
                score, of, coverage = zip(*held.values(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.names[k] for k in held], pa.binary()), pa.array(of, pa.int64()), pa.array(coverage), pa.array([-x for x in score])],
                    names=["ot", "id", "coverage", "score"])
            held.clear()

        yield from _past_blocks(batches, size, lambda asked, rows: None, take, done)

    return dealt.select("tile", "block", "kind", "tid", "plain", "letters", "id", "form", "marks").mapInArrow(run, "ot binary, id bigint, coverage double, score double")


def block_tops(dealt: DataFrame, size: int, threshold: float) -> DataFrame:
    """(ot, source, score): of each group (tile, block), outer text and ``source`` of the inner ones the best geometric score, if it
    reaches ``threshold``.  A group's inner texts come by source, so what is held is one row of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, best = None, None

        def out(block: FragmentBlock) -> Iterator[pa.RecordBatch]:
            hit = np.flatnonzero(best >= threshold) if best is not None else []
            if len(hit):
                names = pa.array(block.names, pa.binary()).take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([names, pa.array([source] * len(hit), pa.string()), pa.array(best[hit])], names=["ot", "source", "score"])

        def take(block: FragmentBlock, lo: int, rows: list, at: int, bags: list) -> Iterator[pa.RecordBatch]:
            nonlocal source, best
            of = [r[3] for r in rows]
            first = [i for i in range(len(of)) if i == 0 or of[i] != of[i - 1]]
            # What a text has to exceed: of one source, what the lines before it reach.
            bar = best if best is not None and of[-1] == source and len(first) == 1 else -1.0
            active = np.flatnonzero(block.bounds(bags) >= np.maximum(bar, threshold))
            if len(active) > 0.8 * len(block.total):  # picking most columns costs more than it saves
                active = np.arange(len(block.total))
            score = block.scores(bags, active)
            for lo, k in enumerate(first):
                if best is None or of[k] != source:
                    yield from out(block)
                    source, best = of[k], np.full(len(block.total), -1.0)
                end = first[lo + 1] if lo + 1 < len(first) else len(of)
                if len(active):
                    best[active] = np.maximum(best[active], score[k:end].max(axis=0))

        def done(block: FragmentBlock) -> Iterator[pa.RecordBatch]:
            nonlocal best
            yield from out(block)
            best = None

        yield from _past_blocks(batches, size, lambda asked, rows: None, take, done)

    return dealt.select("tile", "block", "kind", "tid", "plain", "letters", "source").mapInArrow(run, "ot binary, source string, score double")


# --- anchors: rare slices by which a text is looked at for a phrase ---

ANCHOR = 4


def slices(text: str, size: int) -> np.ndarray:
    """Distinct slices of ``size`` UTF-16 units, packed; a text shorter than that has none."""
    u = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint64)
    n = len(u) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = u[:n].copy()
    for k in range(1, size):
        out = out << np.uint64(16) | u[k : n + k]
    return np.unique(out).view(np.int64)


def phrase_slices(phrases: DataFrame) -> DataFrame:
    """(f, size, gram): the slices of each phrase of phrases(f), of ``ANCHOR`` units or of all that a shorter one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, size, gram = [], [], []
            for text in batch.column(0).to_pylist():
                k = min(ANCHOR, len(text.encode("utf-16-le", "surrogatepass")) // 2)
                found = slices(text, k).tolist() if k else []
                f += [text] * len(found)
                size += [k] * len(found)
                gram += found
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(size, pa.int32()), pa.array(gram, pa.int64())], names=["f", "size", "gram"])

    return phrases.select("f").mapInArrow(run, "f string, size int, gram bigint")


def _found(text: str, wanted: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    for size, grams in wanted.items():
        own = slices(text, size)
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        yield size, at[grams[at] == own]


def slice_counts(texts: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(size, gram, n): how many texts of texts(tid, t) hold each wanted slice (sorted arrays by size), summed in each task."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)  # the slices of a bounded block of phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {size: np.zeros(len(grams), np.int64) for size, grams in sent.value.items()}
        for batch in batches:
            for text in batch.column("t").to_pylist():
                for size, at in _found(text, sent.value):
                    counts[size][at] += 1
        for size, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(sent.value[size][some]), pa.array(n[some])], names=["size", "gram", "n"])

    return texts.select("t").mapInArrow(run, "size int, gram bigint, n bigint").groupBy("size", "gram").agg(F.sum("n").alias("n"))


def slice_hits(texts: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(tid, size, gram): the wanted slices that each text of texts(tid, t) holds."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size_of, gram = [], [], []
            for k, text in enumerate(batch.column("t").to_pylist()):
                for size, at in _found(text, sent.value):
                    row += [k] * len(at)
                    size_of += [size] * len(at)
                    gram += sent.value[size][at].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(row, pa.int64())), pa.array(size_of, pa.int32()), pa.array(gram, pa.int64())], names=["tid", "size", "gram"])

    return texts.select("tid", "t").mapInArrow(run, "tid binary, size int, gram bigint")
