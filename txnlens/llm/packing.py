"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm, run as islands.

Documents are tokenized in Arrow batches (`tokenizers`, no special tokens, then the end id); a document
longer than a sequence is cut into pieces of `length` ids, the last one shorter. Only piece lengths and
digests leave the tokenizing tasks.

Pieces are dealt to islands of about ISLAND_ITEMS by a hash of a row number fixed in a written table, so
repeated rows spread like any others. Each island evolves its own population of packings (one
`applyInPandas` group): a child is a copy of one parent into which a run of the other parent's best-filled
bins is injected whole; bins of the first parent that share an item with them go, and their other items
are put back by best fit, largest first. Mutation empties the least-filled bins and refits their items.
The fittest packing (sum of squared fills over bins) is kept from generation to generation.

Islands own disjoint pieces (a population over all pieces cannot live in one task), so migration moves
items rather than whole individuals: after an epoch, the elite bins (at least ELITE_FILL full) of every
island are final, and the items of all other bins migrate to fewer, newly dealt islands where they meet the
leftovers of other islands. The last epoch makes all its bins final.
"""

import bisect
import itertools
import json
import math
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.scratch import written

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 1
ISLAND_ITEMS = 2_000
EPOCHS = 3
ELITE_FILL = 0.99
POPULATION = 8
CHILDREN = 120
MUTATE = 0.3
_TEXTS_AT_ONCE = 256
_EPOCH_BITS, _ISLAND_BITS = 56, 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict = {}
# Unicode White_Space, what `\s` means in the tokenizer's own regexes.
_WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CACHE_PIECES = 1 << 20


class _Pieces:
    """Word or pre-token -> its ids, kept as one array of ids with the start and count of each entry."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """New entries: `counts` of `ids` go to each key in turn."""
        n, end = len(self.known), self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(end, np.uint32)])
        if n + len(keys) > len(self.start):
            more = n + len(keys)
            self.start = np.concatenate([self.start[:n], np.zeros(more, np.int64)])
            self.count = np.concatenate([self.count[:n], np.zeros(more, np.int32)])
        self.ids[self.used:end] = ids
        self.start[n:n + len(keys)] = self.used + np.cumsum(counts) - counts
        self.count[n:n + len(keys)] = counts
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.used = end

    def look_up(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys on end, and how many each has."""
        at = np.fromiter(map(self.known.__getitem__, keys), dtype=np.int64, count=len(keys))
        counts = self.count[at].astype(np.int64)
        first = self.start[at] - (np.cumsum(counts) - counts)
        return self.ids[np.repeat(first, counts) + np.arange(int(counts.sum()))], counts


class Encoder:
    """Token ids of texts. For a tokenizer built as NFC, whitespace runs to one space, lower case, then a
    regex split that keeps its matches and byte-level BPE (as word_bpe_49k), texts are normalized and split at
    whitespace here, distinct new words into the tokenizer's pre-tokens, and each distinct new pre-token is encoded
    once by the tokenizer's own model; any other tokenizer encodes whole texts. The ids are the same either way;
    tests compare them with plain `Tokenizer.encode`."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words, self.split = self._fast_split(spec)
        self.plain = self._without_normalizer(path) if self.split else None
        # Texts holding an added token's string go to the tokenizer whole, which matches those first.
        self.added = [t["content"].lower() for t in spec.get("added_tokens", []) if t["content"]]
        self.marks = {c for a in self.added for c in (a[0], a[0].upper())}
        self.pieces = _Pieces()

    @staticmethod
    def _without_normalizer(path: str):
        """The tokenizer's byte-level BPE over pre-tokens joined by spaces, which are normalized already."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tok = Tokenizer.from_file(path)
        tok.normalizer = normalizers.Sequence([])
        tok.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return tok

    @staticmethod
    def _fast_split(spec):
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [n.get("type") for n in norm.get("normalizers", [])]
        pres = pre.get("pretokenizers", [])
        if (steps != ["NFC", "Replace", "Lowercase"] or norm["normalizers"][1].get("pattern") != {"Regex": "\\s+"}
                or norm["normalizers"][1].get("content") != " " or [p.get("type") for p in pres] != ["Split", "ByteLevel"]
                or pres[0].get("behavior") != "Removed" or not pres[0].get("invert") or pres[1].get("use_regex")):
            return None, None
        pattern = pres[0]["pattern"].get("Regex")
        if pattern is None or pattern.count("\\s") != pattern.count("[^\\s"):
            return None, None
        import regex

        # ASCII texts: letters are a-z after lower case and numbers 0-9, so the standard library's engine
        # runs the same split with the classes of the tokenizer's pattern narrowed to ASCII.
        ascii_split = re.compile(pattern.replace("\\s", "\t\n\x0b\x0c\r ").replace("\\p{L}", "a-z")
                                 .replace("\\p{N}", "0-9"))
        split = regex.compile(pattern.replace("\\s", _WHITE))
        space = regex.compile(f"[{_WHITE}]+")
        separators = re.compile("[\x1c-\x1f]")  # whitespace to str.split alone

        def words(text: str) -> list[str]:
            # The tokenizer lower-cases letter by letter: a final capital sigma becomes σ, never ς.
            plain = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if separators.search(plain):
                return [w for w in space.split(plain.lower()) if w]
            return plain.lower().split()

        def pieces(word: str) -> list[str]:
            return (ascii_split if word.isascii() else split).findall(word)

        return words, pieces

    def _learn(self, words: list[str]) -> None:
        """Add the ids of all words not known yet; their new pre-tokens are encoded in one call."""
        known = self.pieces.known
        new = list(set(words).difference(known))
        parts = [self.split(w) for w in new]
        fresh = list(set(itertools.chain.from_iterable(parts)).difference(known))
        if len(known) + len(new) + len(fresh) > _CACHE_PIECES and known:
            self.pieces.clear()
            return self._learn(words)
        if fresh:
            enc = self.plain.encode(" ".join(fresh), add_special_tokens=False)
            counts = np.bincount(np.asarray(enc.word_ids, dtype=np.int64), minlength=len(fresh))
            self.pieces.add(fresh, np.asarray(enc.ids, dtype=np.uint32), counts)
        # The words that are not one pre-token.
        new, parts = [w for w in new if w not in known], [p for w, p in zip(new, parts, strict=True) if w not in known]
        if new:
            ids, counts = self.pieces.look_up(list(itertools.chain.from_iterable(parts)))
            ends = np.cumsum([len(p) for p in parts])
            self.pieces.add(new, ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])]))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of every text."""
        if self.split is None:
            return [np.asarray(e.ids, dtype=np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        whole = [any(m in t for m in self.marks) and any(a in t.lower() for a in self.added) for t in texts]
        split = [[] if w else self.words(t) for t, w in zip(texts, whole, strict=True)]
        flat = list(itertools.chain.from_iterable(split))
        self._learn(flat)
        ids, counts = self.pieces.look_up(flat)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(ws) for ws in split])]
        return [np.asarray(self.tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32) if w else o
                for t, w, o in zip(texts, whole, np.split(ids, ends[:-1]), strict=True)]


def _tokenizer(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def cut(ids, length: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of little-endian uint32 ids) of a document's ids."""
    arr = np.asarray(ids).astype("<u4", copy=False)
    return [(p, s, len(arr[s:s + length]), zlib.crc32(arr[s:s + length].tobytes()))
            for p, s in enumerate(range(0, max(len(arr), 1), length))]


def token_pieces(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id",
                 length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null text counts as empty: the end id alone.
    Repeated rows give their pieces once per row; other columns are not carried."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = _tokenizer(path)
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                chunk = [t or "" for t in texts.slice(at, _TEXTS_AT_ONCE).to_pylist()]
                doc = ids_col.slice(at, _TEXTS_AT_ONCE).to_pylist()
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for d, ids in zip(doc, encoder.ids(chunk), strict=True):
                    for piece, start, n, crc in cut(np.append(ids, np.uint32(end_id)), length):
                        for k, v in zip(out, (d, piece, start, n, crc), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, PIECES)


# ---- the genetic algorithm of one island ---------------------------------

def best_fit(bins: list[list[int]], fills: list[int], items, sizes: np.ndarray, capacity: int,
             in_order: bool = False) -> None:
    """Put `items` (largest first, or as given) into the fitting bin with the least room left, or a new bin."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills))
    for i in (items if in_order else sorted(items, key=lambda i: (-sizes[i], i))):
        s = int(sizes[i])
        at = bisect.bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
            fills[b] += s
            bisect.insort(room, (free - s, b))
        else:
            bins.append([i])
            fills.append(s)
            bisect.insort(room, (capacity - s, len(bins) - 1))


def fitness(fills: list[int], capacity: int) -> float:
    return sum((f / capacity) ** 2 for f in fills) / len(fills) if fills else 0.0


def _crossover(rng, a, b, sizes, capacity):
    """Inject a run of b's best-filled bins into a copy of a; refit the displaced items."""
    b_bins, b_fills = b
    ranked = sorted(range(len(b_bins)), key=lambda j: -b_fills[j])
    take = max(1, int(len(ranked) * rng.uniform(0.1, 0.5)))
    first = int(rng.integers(0, max(1, len(ranked) - take + 1)))
    injected = [list(b_bins[j]) for j in ranked[first:first + take]]
    moved = {i for bin_ in injected for i in bin_}
    bins, fills, displaced = [], [], []
    for bin_ in a[0]:
        if moved.isdisjoint(bin_):
            bins.append(list(bin_))
            fills.append(int(sizes[bin_].sum()))
        else:
            displaced += [i for i in bin_ if i not in moved]
    bins += injected
    fills += [int(sizes[x].sum()) for x in injected]
    best_fit(bins, fills, displaced, sizes, capacity)
    return bins, fills


def _mutate(rng, child, sizes, capacity):
    bins, fills = child
    if len(bins) < 2:
        return child
    loosest = set(sorted(range(len(bins)), key=lambda j: fills[j])[:max(2, len(bins) // 20)])
    freed = [i for j in loosest for i in bins[j]]
    bins = [x for j, x in enumerate(bins) if j not in loosest]
    fills = [f for j, f in enumerate(fills) if j not in loosest]
    rng.shuffle(freed)
    best_fit(bins, fills, freed, sizes, capacity)
    return bins, fills


def evolve(sizes: np.ndarray, capacity: int, seed: int, population: int = POPULATION,
           children: int = CHILDREN) -> list[list[int]]:
    """Bins (lists of item indices) of the fittest packing found; stops early at ceil(sum / capacity)."""
    n = len(sizes)
    if n == 0:
        return []
    rng = np.random.default_rng(seed)
    bound = math.ceil(int(sizes.sum()) / capacity)
    pool = []
    for p in range(population):
        # Best fit decreasing, then orders of sizes blurred by noise for variety.
        noise = sizes * (rng.uniform(0.7, 1.3, n) if p else 1.0)
        bins, fills = [], []
        best_fit(bins, fills, [int(i) for i in np.argsort(-noise, kind="stable")], sizes, capacity, in_order=True)
        pool.append((bins, fills))
    score = [fitness(f, capacity) for _, f in pool]
    for _ in range(children):
        best = int(np.argmax(score))
        if len(pool[best][0]) <= bound:
            break
        x, y = rng.choice(len(pool), 2, replace=False)
        child = _crossover(rng, pool[x], pool[y], sizes, capacity)
        if rng.random() < MUTATE:
            child = _mutate(rng, child, sizes, capacity)
        worst = int(np.argmin(score))
        value = fitness(child[1], capacity)
        if value > score[worst]:
            pool[worst], score[worst] = child, value
    return pool[int(np.argmax(score))][0]


def _island(capacity: int, epoch: int, final: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "_uid"], kind="stable").reset_index(drop=True)
        island = int(frame["_island"].iloc[0])
        sizes = frame["length"].to_numpy(np.int64)
        bins = evolve(sizes, capacity, seed=(epoch << 32) ^ island)
        fills = [int(sizes[b].sum()) for b in bins]
        local, offset, settled = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), np.zeros(len(frame), bool)
        for j, bin_ in enumerate(bins):
            at = 0
            for i in sorted(bin_):
                local[i], offset[i] = j, at
                at += int(sizes[i])
            settled[bin_] = final or fills[j] >= ELITE_FILL * capacity
        return pd.DataFrame({
            "_uid": frame["_uid"], "doc_id": frame["doc_id"], "piece": frame["piece"], "start": frame["start"],
            "length": frame["length"], "ids_crc32": frame["ids_crc32"],
            "sequence_id": (epoch << _EPOCH_BITS) + (island << _ISLAND_BITS) + local, "offset": offset,
            "_settled": settled})

    return run


_PLACED = PIECES + ", _uid long, sequence_id long, offset long, _settled boolean"


def pack(pieces: DataFrame, capacity: int = SEQUENCE, island_items: int = ISLAND_ITEMS,
         epochs: int = EPOCHS) -> DataFrame:
    """Every piece with sequence_id and offset (its place in the sequence, gapless from 0).

    Pieces must have `length` between 1 and `capacity`. Ties and repeated pieces are ordinary items; the
    result is the same on every run (seeds follow epoch and island). An empty input gives no rows.
    """
    left = written(pieces.select(*[c.split()[0] for c in PIECES.split(", ")])
                   .withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    done = []
    for epoch in range(epochs):
        n = left.count()
        if n == 0:
            break
        final = epoch == epochs - 1
        islands = max(1, math.ceil(n / island_items))
        dealt = left.withColumn("_island", F.pmod(F.xxhash64("_uid", F.lit(epoch)), F.lit(islands)))
        placed = written(dealt.groupBy("_island").applyInPandas(_island(capacity, epoch, final), _PLACED), "packed")
        done.append(placed.where("_settled"))
        left = placed.where("NOT _settled").select(*[c.split()[0] for c in PIECES.split(", ")], "_uid")
    if not done:
        return pieces.sparkSession.createDataFrame([], PIECES + ", sequence_id long, offset long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*[c.split()[0] for c in PIECES.split(", ")], "sequence_id", "offset")
