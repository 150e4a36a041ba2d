"""Periodic run detection by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is
long enough (`least` words and `exponent` periods) and that no neighbouring word extends.

The words of some documents, one after the other with a separator of its own before each, are
recompressed into a run-length grammar: block compression replaces each maximal block of one symbol
by a symbol for (symbol, count), then pair compression deals all symbols into left and right ones and
replaces each left-right pair by a symbol for it; both alternate until every document is one symbol.
Which blocks and pairs are replaced depends on the symbols alone, so equal stretches of words are
parsed alike but for a few symbols at their ends. That answers how far two places agree (longest
common extension, LCE): climb while both nodes and both parents are equal, step over equal
neighbours (whole blocks at once), and go down where they differ, a few steps on each level.

A run of at least three periods p holds a place x on the grid of step (exponent - 1) * p together with
x + p, so for each p only the pairs (x, x + p) of that grid with equal words are asked: n / (3 p) pairs
for exponent 4, which is harmonic and sums up to n log n. Extensions to both sides give the exact run of
the pair. The same stretch found for several periods keeps the smallest, which divides the others.

All counts are per document; long texts are a group of their own, short ones share a grammar up to
`GROUP` bytes. Words are compared as bytes. Null, empty and blank texts have no words and no runs. Each
row gives one row, repeated rows and null ids too. An empty table gives an empty result. Only doc_id
and text of documents are read, so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, portions, texts

GROUP = 4 << 20  # bytes of text that share a grammar
ASKED = 1 << 18  # pairs of places that are extended at once

#: May give a document other words before its runs are sought: (doc_id, words) -> words.
Change = Callable[[int | None, list[bytes]], list[bytes]]


class Grammar:
    """Levels of a recompressed sequence, one after the other in flat arrays.

    Negative symbols are separators: they stay as they are on every level. `size` is the number of
    words below a node, `ahead` and `behind` what is left of its block in either direction, itself
    included; `first` and `last` say whether it is the first or last child of its parent.
    """

    def __init__(self, words: np.ndarray, seed: int = 11):
        parts: dict[str, list[np.ndarray]] = {
            n: [] for n in ("symbol", "size", "parent", "first", "last", "ahead", "behind", "head", "tail")
        }
        random = np.random.default_rng(seed)
        symbol = words.astype(np.int32)
        size = np.ones(len(symbol), np.int32)
        head = tail = np.zeros(len(symbol), np.int32)
        names = int(symbol.max(initial=-1)) + 1
        # Separators, and one symbol for each document that has words.
        whole = int((symbol < 0).sum() + ((symbol[1:] >= 0) & (symbol[:-1] < 0)).sum())
        offset = 0
        blocks_next = True
        while True:
            done = len(symbol) <= whole
            if blocks_next or done:
                begin = np.ones(len(symbol), bool)
                begin[1:] = symbol[1:] != symbol[:-1]
            else:
                begin, made = self._pairs(symbol, random)
                if not len(made):
                    continue  # other sides, another try
            start = np.flatnonzero(begin).astype(np.int32)
            if blocks_next and not done and len(start) == len(symbol):
                blocks_next = False  # no blocks: no level for them
                continue
            stop = np.append(start[1:], np.int32(len(symbol)))
            group = np.cumsum(begin, dtype=np.int32) - 1
            place = np.arange(len(symbol), dtype=np.int32)
            last = np.ones(len(symbol), bool)
            last[:-1] = begin[1:]
            one = np.ones(len(symbol), np.int32)
            parts["symbol"].append(symbol)
            parts["size"].append(size)
            parts["first"].append(begin & (not done))
            parts["last"].append(last & (not done))
            parts["ahead"].append(stop[group] - place if blocks_next else one)
            parts["behind"].append(place - start[group] + 1 if blocks_next else one)
            parts["head"].append(head)
            parts["tail"].append(tail)
            parts["parent"].append(group + np.int32(0 if done else offset + len(symbol)))
            if done:
                break
            head, tail = start + np.int32(offset), stop - 1 + np.int32(offset)
            offset += len(symbol)
            if blocks_next:
                count = stop - start
                made, second = np.flatnonzero(count > 1), count
            else:
                made, second = group[made], symbol[np.minimum(start + 1, len(symbol) - 1)]
            above = symbol[start]
            key = above[made].astype(np.int64) << 32 | second[made]
            distinct, number = np.unique(key, return_inverse=True)
            above[made] = names + number
            names += len(distinct)
            size = np.add.reduceat(size, start)
            symbol = above
            blocks_next = not blocks_next
        for name, arrays in parts.items():
            setattr(self, name, np.concatenate(arrays))
        self.words = len(words)

    @staticmethod
    def _pairs(symbol: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Where nodes of the next level begin, and the places of the left symbols of pairs."""
        factor = np.uint32(random.integers(1 << 31) * 2 + 1)
        side = (symbol.astype(np.uint32) * factor) >> np.uint32(31)
        side[symbol < 0] = 2
        there, back = ((side[:-1] == a) & (side[1:] == 1 - a) for a in (0, 1))
        chosen = there if there.sum() >= back.sum() else back
        begin = np.ones(len(symbol), bool)
        begin[1:] = ~chosen
        return begin, np.flatnonzero(chosen)

    def extend(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from places a and b on (backward: up to them), a < b."""
        edge, child = (self.first, self.head) if forward else (self.last, self.tail)
        block, sign = (self.ahead, 1) if forward else (self.behind, -1)
        agreed = np.zeros(len(a), np.int64)
        ask = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        climbing = np.ones(len(a), bool)
        while len(ask):
            same = self.symbol[a] == self.symbol[b]
            climbing &= same
            # Climb: both begin their parents and these are equal.
            high_a, high_b = self.parent[a], self.parent[b]
            climb = climbing & edge[a] & edge[b] & (self.symbol[high_a] == self.symbol[high_b])
            step = np.minimum(block[a], block[b]).astype(np.int64)
            over = same & ~climb
            agreed[ask] += np.where(over, step * self.size[a], 0)
            going = same | (a >= self.words)  # the others differ in a word: done
            a = np.where(climb, high_a, np.where(over, a + sign * step, child[a]))
            b = np.where(climb, high_b, np.where(over, b + sign * step, child[b]))
            if not going.all():
                a, b, ask, climbing = a[going], b[going], ask[going], climbing[going]
        return agreed


def _asked(words: np.ndarray, lengths: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x and periods p of the grid with equal words at x and x + p, in bounded portions.

    The documents stand from long to short, so those that can hold a run of period p come first.
    """
    ends = np.cumsum(lengths + 1)
    held_x: list[np.ndarray] = []
    held_p: list[int] = []
    held = 0
    n = len(lengths)
    for p in range(1, int(lengths.max(initial=0)) // exponent + 1):
        while n and lengths[n - 1] < exponent * p:
            n -= 1
        stop, step = int(ends[n - 1]), (exponent - 1) * p
        x = np.flatnonzero(words[: stop - p : step] == words[p:stop:step]) * step
        # x and x + p are of one document if no document begins in between.
        x = x[np.searchsorted(ends[:n], x, side="right") == np.searchsorted(ends[:n], x + p, side="right")]
        if len(x):
            held_x.append(x)
            held_p.append(p)
            held += len(x)
        if held >= ASKED:
            yield np.concatenate(held_x), np.repeat(held_p, [len(x) for x in held_x])
            held_x, held_p, held = [], [], 0
    if held:
        yield np.concatenate(held_x), np.repeat(held_p, [len(x) for x in held_x])


def runs_of(documents: list[list[bytes]], least: int = 6, exponent: int = 4) -> list[np.ndarray]:
    """For each document its runs as rows (start, length, period), by start, then period."""
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    lengths = np.array([len(documents[d]) for d in order], np.int64)

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            return n

    number = Numbers().__getitem__
    words = np.empty(int(lengths.sum()) + len(order) + 1, np.int32)
    begins = np.cumsum(lengths + 1) - lengths  # first word of each document
    for at, d in enumerate(order):
        begin = begins[at]
        words[begin - 1] = -1 - at
        words[begin : begin + lengths[at]] = np.fromiter(map(number, documents[d]), np.int32, lengths[at])
    words[-1] = -1 - len(order)
    found = [np.zeros((0, 3), np.int64)]
    grammar = None
    for x, p in _asked(words, lengths, exponent):
        grammar = grammar or Grammar(words)
        after = grammar.extend(x, x + p, forward=True)
        before = grammar.extend(x - 1, x + p - 1, forward=False)
        length = p + after + before
        keep = length >= np.maximum(least, exponent * p)
        found.append(np.stack([x - before, length, p], axis=1)[keep])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)  # the same stretch: only the smallest period
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[new]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    of = np.searchsorted(begins, every[:, 0], side="right") - 1
    every[:, 0] -= begins[of]
    cuts = np.searchsorted(of, np.arange(len(order) + 1))
    result: list[np.ndarray] = [every[:0]] * len(documents)
    for at, d in enumerate(order):
        result[d] = every[cuts[at] : cuts[at + 1]]
    return result


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def find(docs: DataFrame, least: int = 6, exponent: int = 4, change: Change | None = None) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and the collapsed text."""
    assert exponent >= 2 and least >= 1

    def work():
        def each(batch):
            ids = batch.column("doc_id").to_pylist()
            every = batch.column("text").cast(pa.binary())
            all_runs, all_texts = [], []
            for part in portions(pc.binary_length(every).to_pylist(), GROUP):
                documents = [every[n].as_py().split() for n in part]
                if change:
                    documents = [change(ids[n], w) for n, w in zip(part, documents, strict=True)]
                found = runs_of(documents, least, exponent)
                all_texts += [collapsed(w, r) for w, r in zip(documents, found, strict=True)]
                all_runs += found
            ends = np.cumsum([0, *map(len, all_runs)]).astype(np.int32)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *all_runs])
            columns = [pa.array(np.ascontiguousarray(flat[:, n])) for n in range(3)]
            rows = pa.StructArray.from_arrays(columns, names=["start", "length", "period"])
            return {
                "doc_id": batch.column("doc_id"),
                "runs": pa.ListArray.from_arrays(pa.array(ends), rows),
                "collapsed": pa.array(all_texts, pa.binary()),
            }

        return each

    ddl = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return by_batch(texts(docs), work, ddl)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that query op13 looks at: one document in ten repeats a stretch to its end.

    A document without an id keeps its words.
    """
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(b"%d" % doc_id), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op13."""

    def better(a: Column, b: Column) -> Column:
        """Of two runs the one with more periods; runs come by start, then period, so ties go to a."""
        return F.when(
            a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b
        ).otherwise(a)

    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.reduce("runs", nothing, better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
