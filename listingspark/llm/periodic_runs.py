"""Periodic runs of words, by recompression.

A run is a stretch of consecutive words with smallest period q, no shorter than ``Shape`` asks, that cannot be made
longer at either end without losing that period. The words of a group of texts become numbers, and block compression
(a symbol repeated) and pair compression (a symbol of one side followed by one of the other) alternate until each text
is one symbol. Both only look at a symbol's neighbours, so equal stretches are compressed alike but for their ends;
how far two places agree, to the right or to the left, is then found level by level, in a few steps each.

A run of period q spans a place of the grid of step ``Shape.step(q)`` together with the place q words on. All grid places
of all periods are a harmonic sum: n log n. Those whose words agree are extended both ways by the grammar, exactly.

Every row gives one row, in its own task, without a shuffle. Null and empty texts have no words and no runs; repeated rows and
rows without an id count as any other row. A text of any length is taken whole; it is held in memory with about 100
bytes a word. Of further columns of the table only those named ``doc_id`` and ``text`` are read, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .texts import WHITE, mix, own_columns, text_chunks, words

#: Bytes of text whose words share one grammar; a longer text has one of its own.
GROUP_BYTES = 4 << 20
#: Grid places that are looked at together.
PLACES = 1 << 21
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Shape:
    """Runs have ``least`` words and ``times`` periods, or more."""

    least: int = 6
    times: int = 4

    def length(self, period):
        return np.maximum(self.least, self.times * period)

    def step(self, period):
        """How far apart grid places may be so that one lies in each run with its neighbour a period on."""
        return self.length(period) - period


class Grammar:
    """The levels of a run-length grammar over symbols; 0 is the border, at both ends and between the texts."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = [symbols.astype(np.int32)]
        self.first: list[np.ndarray] = []  # of each symbol of the next level, the first symbol it is made of; then the end
        self.parent: list[np.ndarray] = []
        self.blocks: list[bool] = []
        self._fresh = int(symbols.max(initial=0)) + 1
        self._seed = 0
        while self._longest() > 1:
            if not self._compress_blocks():
                self._compress_pairs()

    def _longest(self) -> int:
        return int(np.diff(np.flatnonzero(self.symbols[-1] == 0)).max(initial=1)) - 1

    def _push(self, firsts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        size = len(self.symbols[-1])
        begins = np.zeros(size, dtype=np.int32)
        begins[firsts[1:]] = 1
        self.first.append(np.append(firsts, size).astype(np.int32))
        self.parent.append(np.cumsum(begins, dtype=np.int32))
        self.symbols.append(symbols.astype(np.int32))
        self.blocks.append(blocks)

    def _named(self, codes: np.ndarray) -> np.ndarray:
        names, values = pd.factorize(codes)
        names += self._fresh
        self._fresh += len(values)
        return names

    def _compress_blocks(self) -> bool:
        now = self.symbols[-1]
        firsts = np.concatenate([[0], np.flatnonzero(now[1:] != now[:-1]) + 1])
        if len(firsts) == len(now):
            return False
        lengths = np.diff(firsts, append=len(now))
        symbols = now[firsts]
        long = np.flatnonzero(lengths > 1)
        symbols[long] = self._named((symbols[long].astype(np.int64) << 32) | lengths[long])
        self._push(firsts, symbols, True)
        return True

    def _compress_pairs(self) -> None:
        now = self.symbols[-1]
        self._seed += 1
        side = (mix(now.astype(np.uint64) + np.uint64(self._seed << 40)) >> np.uint64(63)).astype(np.int8)
        side[now == 0] = 2
        here, after = side[:-1], side[1:]
        left, right = (here == 0) & (after == 1), (here == 1) & (after == 0)
        pairs = np.flatnonzero(left if left.sum() >= right.sum() else right)
        if not len(pairs):
            return
        kept = np.ones(len(now), dtype=bool)
        kept[pairs + 1] = False
        firsts = np.flatnonzero(kept)
        symbols = now.copy()
        symbols[pairs] = self._named((now[pairs].astype(np.int64) << 32) | now[pairs + 1])
        self._push(firsts, symbols[firsts], False)

    def agree(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The first places from ``x`` and ``y`` on (``back``: to the left) at which the symbols differ; x < y, in one text."""
        x, y = x.copy(), y.copy()
        level = np.zeros(len(x), dtype=np.int32)
        live = np.arange(len(x))
        way = -1 if back else 1
        for h, now in enumerate(self.symbols):
            a, b = x[live], y[live]
            same = now[a] == now[b]
            level[live[~same]] = h
            live, a, b = live[same], a[same], b[same]
            if not len(live):
                break
            first, up_a, up_b = self.first[h], self.parent[h][a], self.parent[h][b]
            if self.blocks[h]:
                left_a, left_b = _left(first, a, up_a, back), _left(first, b, up_b, back)
                apart = left_a != left_b  # the longer block goes on where the shorter one has ended
                ended, least = live[apart], np.minimum(left_a, left_b)[apart]
                x[ended], y[ended], level[ended] = a[apart] + way * least, b[apart] + way * least, h
                live, step = live[~apart], way
                x[live], y[live] = up_a[~apart] + step, up_b[~apart] + step
            else:
                inside = (_left(first, a, up_a, not back) > 1) | (_left(first, b, up_b, not back) > 1)
                x[live], y[live] = up_a + way * inside, up_b + way * inside
        for h in range(len(self.first) - 1, -1, -1):
            live = np.flatnonzero(level > h)
            if not len(live):
                continue
            first, now = self.first[h], self.symbols[h]
            up_a, up_b = x[live], y[live]
            a, b = (first[up_a + 1] - 1, first[up_b + 1] - 1) if back else (first[up_a], first[up_b])
            step = (now[a] == now[b]).astype(np.int64)
            if self.blocks[h]:
                step *= np.minimum(_left(first, a, up_a, back), _left(first, b, up_b, back))
            x[live], y[live] = a + way * step, b + way * step
        return x, y


def _left(first: np.ndarray, at: np.ndarray, parent: np.ndarray, back: bool) -> np.ndarray:
    """Symbols of the parent from this one on, itself included."""
    return at - first[parent] + 1 if back else first[parent + 1] - at


def runs_of(numbers: np.ndarray, begins: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs, by text, start and period; words as numbers above 0, and where each text begins and the last ends."""
    sizes = np.diff(begins)
    texts = np.flatnonzero(sizes >= shape.least)
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none, none, none, none
    sizes = sizes[texts]
    spots = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1  # where each text begins behind its border
    symbols = np.zeros(spots[-1], dtype=np.int64)
    inner = np.arange(int(sizes.sum())) + np.repeat(spots[:-1] - (np.cumsum(sizes) - sizes), sizes)
    symbols[inner] = numbers[np.arange(int(sizes.sum())) + np.repeat(begins[texts] - (np.cumsum(sizes) - sizes), sizes)]
    grammar = Grammar(symbols)
    found = [_extended(grammar, spots, *grid, shape) for grid in _grid(sizes, shape)]
    start, end, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the smallest period of a stretch comes first
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    owner = np.searchsorted(spots, start, side="right") - 1
    return texts[owner], start - spots[owner], end - start, period


def _grid(sizes: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid places in parts: text, place and period."""
    many = np.maximum(sizes // shape.times, 0)
    text = np.repeat(np.arange(len(sizes)), many)
    period = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + 1
    fits = shape.length(period) <= sizes[text]
    text, period = text[fits], period[fits]
    step = shape.step(period)
    places = (sizes[text] - period + step - 1) // step
    sums = np.cumsum(places)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PLACES, side="right")))
        n = places[at:end]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[at:end], n), k * np.repeat(step[at:end], n), np.repeat(period[at:end], n)
        at = end


def _extended(grammar: Grammar, spots: np.ndarray, text: np.ndarray, place: np.ndarray, period: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    x = spots[text] + place
    agree = grammar.symbols[0][x] == grammar.symbols[0][x + period]
    x, period = x[agree], period[agree]
    _, end = grammar.agree(x, x + period)
    before, _ = grammar.agree(x - 1, x + period - 1, back=True)
    start = before + 1
    long = end - start >= shape.length(period)
    return start[long], end[long], period[long]


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of consecutive texts as bytes, and where each text's words begin and the last ends."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = len(data)
    ink = ~WHITE[data]
    first = np.zeros(size + 1, dtype=bool)
    first[offsets] = True
    starts = ink & first[:-1]
    starts[1:] |= ink[1:] & ~ink[:-1]
    ends = ink & first[1:]
    ends[:-1] |= ink[:-1] & ~ink[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    spots = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=spots[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(spots), pa.py_buffer(data[ink])])
    return found, np.searchsorted(starts, offsets)


def _collapsed(found: pa.Array, begins: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    sums = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum(kept, out=sums[1:])
    of_text = pa.LargeListArray.from_arrays(pa.array(sums[begins]), found.filter(pa.array(kept)))
    return pc.binary_join(of_text, pa.scalar(b" ", pa.large_binary()))


def _chunk_runs(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[pa.Array, pa.Array, pa.Array]:
    found, begins = _words_of(data, offsets)
    numbers = found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    text, start, length, period = runs_of(numbers, begins, shape)
    dropped = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(dropped, begins[text] + start + period, 1)
    np.add.at(dropped, begins[text] + start + length, -1)
    runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(RUN))
    ends = np.searchsorted(text, np.arange(len(begins))).astype(np.int32)
    return pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(ends), runs), _collapsed(found, begins, np.cumsum(dropped[:-1]) == 0)


def periodic_runs(df: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``runs`` holds start (word number from 0), length and period in words, by start, then period; ``collapsed`` the words that no run
    contains behind its first period, joined by one space.
    """

    def scan(batches):
        for batch in batches:
            texts = batch.column("text")
            for at, end, data, offsets in text_chunks(texts, GROUP_BYTES):
                n, runs, collapsed = _chunk_runs(data, offsets, shape)
                columns = [batch.column("doc_id").slice(at, end - at), n, runs, collapsed.cast(pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return own_columns(df, "doc_id", "text").mapInArrow(scan, schema)


def looped(df: DataFrame, of: Column) -> DataFrame:
    """The table with the texts of some rows turned into loops, to give the search known runs.

    ``of`` is a hash of the row; rows with ``of % 10 = 0`` and at least one word get, from word a = g % n on (g = of / 10,
    rounded down), the words a to a + p - 1 over and over, p = 1 + (n - a) / (3 + g % 8), rounded down.
    """
    g, w = F.floor(of / 10), F.col("w")
    n = F.size(w).cast("bigint")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    spun = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    chosen = F.coalesce(of % 10 == 0, F.lit(False))
    held = df.withColumn("w", F.when(chosen, words(F.col("text"))))
    return held.withColumn("text", F.when(chosen & (n > 0), F.array_join(spun, " ")).otherwise(F.col("text"))).drop("w")
