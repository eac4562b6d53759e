"""Benchmark decontamination by SimHash windows.

Window sizes are classes of word counts. An item belongs to the largest class up to four fifths of its
words and is fingerprinted at every offset of a window of that size; a text is fingerprinted at strides
no longer than the number of those offsets, so a window of the text and one of the item always align.
Fingerprints have 64 bits in four blocks: two that differ in `RADIUS` = 11 bits at most differ in two
bits at most in one block, so the tables of all block values within two bits find every such pair.
Pairs within the radius are verified by the exact weighted similarity of their five-word shingles.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.words import scramble, shingles, text_slices, word_hashes, words

SHINGLE = 5
SIMILAR = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
ITEMS_PER_PASS = 2_000
WORDS_PER_PASS = 200_000
_SLACK = 3
_MOVE = 1 << 15
RUN_WORDS = 1 << 16
LONGEST_WINDOW = 30_000
# From this many words on, an item also gets windows of a quarter of its length at a fifth of it apart: a block
# of up to a fifth of the item edited in a row then leaves a whole aligned window outside it.
LONG_ITEM = 100
_LEAK_ARROW = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
LEAK = "array<struct<item_id:long,similarity:double,first_word:int,n_words:int>>"


def _features(hashed: np.ndarray) -> np.ndarray:
    """A hash per pair of neighbouring words; a single word stands for itself."""
    if len(hashed) < 2:
        return scramble(hashed)
    return scramble(scramble(hashed[:-1]) ^ hashed[1:])


def window_starts(lengths: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of the windows of `size` words at multiples of `stride` and at the end of every text."""
    last = lengths - size
    fits = np.flatnonzero(last >= 0)
    last = last[fits]
    n = last // stride + 1 + (last % stride > 0)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(fits, n), np.minimum(number * stride, np.repeat(last, n))


_LANES = np.uint64(0x0001000100010001)


def running_bits(hashed: np.ndarray, single: bool = False) -> np.ndarray:
    """Column k: how often each of the 64 bits is set in the first k features.

    Row j holds bits j, j + 16, j + 32 and j + 48 in four counters of 16 bits. Sums may overflow;
    a difference over fewer than 65,536 features is still exact, since it is taken modulo 2**64.
    """
    features = scramble(hashed) if single else _features(hashed)
    upto = np.zeros((16, len(features) + 1), dtype=np.uint64)
    for j in range(16):
        np.cumsum((features >> np.uint64(j)) & _LANES, out=upto[j, 1:])
    return upto


def fingerprints(upto: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` words: the majority of each bit over its features."""
    width = max(1, size - 1)
    # Added to a counter, this sets its highest bit where the count is above half of the width.
    lift = np.uint64(0x8000 - (width // 2 + 1)) * _LANES
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(16):
        ones = upto[j, starts + width] - upto[j, starts]
        out |= (((ones + lift) >> np.uint64(15)) & _LANES) << np.uint64(j)
    return out


def _sizes(most: int) -> list[int]:
    """Window sizes in words: every one up to 4, then a fifth to a third apart."""
    out = [1, 2, 3, 4]
    while (size := max(out[-1] + 1, out[-1] * 5 // 4)) <= most:
        out.append(size)
    return out


def _similarity(a: Counter, b: Counter) -> float:
    """Shared shingles over all shingles, each as often as it occurs."""
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Items:
    """A block of benchmark items with its fingerprint tables."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(i, word_hashes(words(t))) for i, t in items]
        self.items = [(i, h) for i, h in self.items if len(h)]
        self.bags = [Counter(shingles(h, SHINGLE).tolist()) for _, h in self.items]
        self.longest = max((len(h) for _, h in self.items), default=0)
        by_size, quarters, sizes = defaultdict(list), defaultdict(list), _sizes(min(self.longest, LONGEST_WINDOW))
        for k, (_, hashed) in enumerate(self.items):
            n = len(hashed)
            by_size[n if n < SHINGLE else max(s for s in sizes if s <= max(4, n * 4 // 5))].append(k)
            if n >= LONG_ITEM:
                quarters[max(s for s in sizes if s <= n // 4)].append(k)
        self.classes = [self._tables(size, members) for size, members in sorted(by_size.items())] + [
            self._tables(size, members, lambda n: max(1, n // 5)) for size, members in sorted(quarters.items())]

    def _tables(self, size: int, members: list[int], step=None):
        step = step or (lambda n: n - size + 1)
        stride = min(step(len(self.items[k][1])) for k in members)
        lengths = np.array([len(self.items[k][1]) for k in members])
        which, offset = window_starts(lengths, size, 1)
        base = np.cumsum(lengths) - lengths
        upto = running_bits(np.concatenate([self.items[k][1] for k in members]), size == 1)
        prints = fingerprints(upto, base[which] + offset, size)
        near = np.array([0] + [sum(1 << b for b in c) for r in range(1, BLOCK_RADIUS + 1)
                               for c in combinations(range(BLOCK_BITS), r)], dtype=np.int64)
        tables = []
        for b in range(BLOCKS):
            keys = (_block(prints, b)[:, None] ^ near[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            first = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
            tables.append((first, np.repeat(np.arange(len(prints)), len(near))[order]))
        return size, stride, np.array(members)[which], offset, prints, tables

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int | None, float, int, int]]]:
        """For each text (item_id, similarity, first word, words) of each item it holds, at its best place."""
        hashed = [word_hashes(words(t)) for t in texts]
        places: list[set[tuple[int, int]]] = [set() for _ in texts]
        # Texts are taken together in runs of about RUN_WORDS words; a longer one is cut, with overlaps.
        run, room = [], RUN_WORDS
        for k, h in enumerate(hashed):
            for base in range(0, max(1, len(h)), RUN_WORDS):
                run.append((k, base, h[base:base + RUN_WORDS + self.longest]))
                room -= len(run[-1][2])
                if room <= 0:
                    self._search(run, places)
                    run, room = [], RUN_WORDS
        self._search(run, places)
        return [self._verify(h, p) for h, p in zip(hashed, places, strict=True)]

    def _search(self, run, places) -> None:
        lengths = np.array([len(h) for _, _, h in run], dtype=np.int64)
        if not lengths.sum():
            return
        base = np.cumsum(lengths) - lengths
        together = np.concatenate([h for _, _, h in run])
        pairs = running_bits(together)
        for size, stride, owner, offset, prints, tables in self.classes:
            upto = running_bits(together, True) if size == 1 else pairs
            text, start = window_starts(lengths, size, stride)
            for at in range(0, len(start), _MOVE):
                part = fingerprints(upto, (base[text] + start)[at:at + _MOVE], size)
                for b, (first, entries) in enumerate(tables):
                    value = _block(part, b)
                    low, n = first[value], first[value + 1] - first[value]
                    window = np.repeat(np.arange(len(part)), n)
                    entry = entries[np.arange(len(window)) + np.repeat(low - np.cumsum(n) + n, n)]
                    close = np.flatnonzero(np.bitwise_count(part[window] ^ prints[entry]) <= RADIUS)
                    for w, e in zip((window[close] + at).tolist(), entry[close].tolist(), strict=True):
                        k, cut, _ = run[text[w]]
                        places[k].add((int(owner[e]), int(cut + start[w] - offset[e])))

    def _verify(self, hashed: np.ndarray, places: set[tuple[int, int]]) -> list[tuple[int | None, float, int, int]]:
        best: dict[int, tuple[float, int, int]] = {}
        tried = set()
        for k, start in places:
            item, bag = self.items[k][1], self.bags[k]
            for a in range(start - _SLACK, start + _SLACK + 1):
                a = min(max(a, 0), max(len(hashed) - len(item), 0))
                if (k, a) in tried:
                    continue
                tried.add((k, a))
                window = hashed[a:a + len(item)]
                score = _similarity(bag, Counter(shingles(window, SHINGLE).tolist()))
                if score >= SIMILAR and (k not in best or (score, -a) > (best[k][0], -best[k][1])):
                    best[k] = (score, a, len(window))
        return sorted(((self.items[k][0], *found) for k, found in best.items()), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def _item_blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items with a text in order, in blocks of `most` items and WORDS_PER_PASS words; the driver holds one partition and one block."""
    block, room = [], WORDS_PER_PASS
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        n = len(words(text))
        if block and (len(block) == most or n > room):
            yield block
            block, room = [], WORDS_PER_PASS
        block.append((item, text))
        room -= n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, items_per_pass: int = ITEMS_PER_PASS, column: str = "leaks") -> DataFrame:
    """`docs` with `column`: the benchmark items its whole text holds, at similarity 0.8 or more.

    `benchmark` has item_id and text. Items without a word, and null or empty texts, match nothing; an
    item shorter than five words is one shingle of all its words. An item without item_id is an item
    like any other and is listed with a null. Every row of the benchmark is searched on its own, so that
    an item_id is listed once for each of its rows that the text holds. The benchmark is read in blocks
    of `items_per_pass` items and about WORDS_PER_PASS words at most (one item at least), each block
    being the stated query set of one pass over the texts; a column of that name is replaced.
    """
    docs = docs.drop(column)
    found = F.array().cast(LEAK)
    for block in _item_blocks(benchmark, items_per_pass):
        found = F.concat(found, _pass(docs, block)(F.col("text")))
    return docs.withColumn(column, found)


def _pass(docs: DataFrame, items: list[tuple[int, str]]):
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def leaks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = Items(shared.value)
        for batch in texts:
            yield pa.array([
                [dict(zip(("item_id", "similarity", "first_word", "n_words"), x, strict=True)) for x in found]
                for part in text_slices(batch) for found in ready.leaks(part)
            ], _LEAK_ARROW)

    return F.arrow_udf(leaks, LEAK)
