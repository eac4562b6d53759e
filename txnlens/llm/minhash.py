"""Near duplicates by ProbMinHash, banding and exact verification.

A text is the multiset of its five-word shingles. ProbMinHash lets every shingle arrive in a Poisson
process whose rate is its count; each arrival hits a random register, a register keeps the shingle that
came first, and a shingle is dropped once its next arrival is later than all registers. Two texts agree
in a register with the probability of their probability Jaccard similarity J. Bands of registers give
buckets; candidates of a bucket are verified by the exact J.

Texts with equal words are one node. Inside a bucket nodes are compared with the smallest node first
(stars), so a bucket of any size costs one comparison per node. What stars may miss is completed: members
of a star group that are still in different components are compared in full, in blocks.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.graph import components
from txnlens.llm.scratch import cut_lineage, written
from txnlens.llm.words import scramble, shingles, text_slices, word_hashes, words

SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND_ROWS = 24, 5
_BATCH_WORDS = 1 << 17
_ARRIVALS = 8
_SHINGLE_BYTES = 6
_CHUNK = 1024


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """An (n, registers) table of elements: the first arrival in each register of each of the n sets.

    `elements` are distinct within a set and `owner` is the set of each. A set without elements keeps zeros.
    """
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, dtype=np.uint64)
    latest = np.full(n, np.inf)
    active = np.arange(len(elements))
    clock = np.zeros(len(elements))
    step = 0
    while len(active):
        # Few sets are still open: take several arrivals at once. An arrival depends on its number alone.
        many = max(1, min(_ARRIVALS, len(elements) // len(active)))
        number = 2 * np.arange(step, step + many, dtype=np.uint64)
        held, who = elements[active], owner[active]
        draws = scramble(held[:, None] ^ scramble(number))
        waits = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active][:, None]
        times = clock[active][:, None] + np.cumsum(waits, axis=1)
        slots = who[:, None] * registers + (scramble(held[:, None] ^ scramble(number + np.uint64(1))) % np.uint64(registers)).astype(np.int64)
        early = times < latest[who][:, None]
        t, s, e = times[early], slots[early], np.broadcast_to(held[:, None], times.shape)[early]
        order = np.lexsort((t, s))
        t, s, e = t[order], s[order], e[order]
        lead = np.ones(len(s), dtype=bool)
        lead[1:] = s[1:] != s[:-1]
        t, s, e = t[lead], s[lead], e[lead]
        sooner = t < first[s]
        first[s[sooner]] = t[sooner]
        winner[s[sooner]] = e[sooner]
        touched = np.unique(who)
        latest[touched] = first.reshape(n, registers)[touched].max(axis=1)
        clock[active] = times[:, -1]
        active = active[clock[active] < latest[who]]
        step += many
    return winner.reshape(n, registers)


def weighted(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their counts."""
    return np.unique(shingles(hashed, SHINGLE), return_counts=True)


def sketch_batch(found: list[list[str]]) -> np.ndarray:
    """Band hashes of each list of words; zeros where there are no words."""
    bags = [weighted(word_hashes(w)) for w in found]
    owner = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
    table = prob_minhash(
        np.concatenate([x for x, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.float64),
        owner, len(bags), BANDS * BAND_ROWS)
    rows = table.reshape(len(bags), BANDS, BAND_ROWS)
    bands = np.broadcast_to(scramble(np.arange(BANDS, dtype=np.uint64)), rows.shape[:2]).copy()
    for r in range(BAND_ROWS):
        bands = scramble(bands ^ rows[:, :, r])
    return bands.view(np.int64)


def _sketched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        keys: list = []
        rows = np.zeros((len(batch), BANDS), dtype=np.int64)
        none = np.ones(len(batch), dtype=bool)
        group: list[tuple[int, list[str]]] = []
        size = 0
        for part in text_slices(batch):
            for text in part:
                found = words(text)
                if found:
                    none[len(keys)] = False
                    group.append((len(keys), found))
                    size += len(found)
                # Texts without words are compared as they are.
                keys.append(None if text is None else xxhash.xxh3_128_digest(" ".join(found) if found else "\0" + text))
                if size >= _BATCH_WORDS:
                    rows[[k for k, _ in group]] = sketch_batch([w for _, w in group])
                    group, size = [], 0
        if group:
            rows[[k for k, _ in group]] = sketch_batch([w for _, w in group])
        ends = np.arange(len(batch) + 1, dtype=np.int32) * BANDS
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()), mask=pa.array(none))
        yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), bands], ["key", "bands"])


def _packed_shingles(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sorted shingles of a text, each as often as it occurs, in 48 bits each."""
    for batch in texts:
        yield pa.array([_pack(np.sort(shingles(word_hashes(words(t)), SHINGLE))) for part in text_slices(batch) for t in part], pa.binary())


def _pack(hashes: np.ndarray) -> bytes:
    return (hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :_SHINGLE_BYTES].tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, _SHINGLE_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :_SHINGLE_BYTES] = raw
    return np.unique(out.view(np.uint64).ravel(), return_counts=True)


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    w, v = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    only_a, only_b = float(a[1].sum() - w.sum()), float(b[1].sum() - v.sum())
    order = np.argsort(w / v, kind="stable")
    w, v = w[order], v[order]
    above = np.cumsum(w[::-1])[::-1] + only_a
    below = np.concatenate([[0.0], np.cumsum(v)[:-1]]) + only_b
    return float((1.0 / (above / w + below / v)).sum())


def _similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    last, bag, out = None, None, []
    for a, b in zip(left, right, strict=True):
        b = b.as_py()
        if b != last:
            last, bag = b, _unpack(b)
        out.append(prob_jaccard(_unpack(a.as_py()), bag))
    return pa.array(out, pa.float64())


def _verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs; `packed` has key and shingles."""
    left = packed.select(F.col("key").alias("a"), F.col("shingles").alias("_sa"))
    right = packed.select(F.col("key").alias("b"), F.col("shingles").alias("_sb"))
    met = pairs.join(left, "a").join(right, "b")
    return cut_lineage(met.select("a", "b", F.arrow_udf(_similarity, "double")("_sa", "_sb").alias("similarity")))


def _labelled(frame: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """`frame` with the component of `column`; a node without links is its own."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return frame.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def _text_hash() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _links(docs: DataFrame, base: DataFrame) -> DataFrame:
    """Verified links (a, b, similarity) between nodes that decide all classes."""
    nodes = base.where(F.col("bands").isNotNull()).groupBy("key").agg(
        F.min(F.struct("doc_id", "t1", "t2")).alias("of"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes)
    members = nodes.select("key", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = cut_lineage(members.join(buckets, "bucket"))
    wanted = nodes.select("key", "of.*").join(stars.select("key").distinct(), "key", "left_semi").select(
        F.col("key"), F.col("doc_id").alias("_id"), F.col("t1").alias("_1"), F.col("t2").alias("_2"))
    texts = docs.select("doc_id", "text", *_text_hash()).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")))
    texts = texts.select("key", "text").dropDuplicates(["key"])
    packed = written(texts.select("key", F.arrow_udf(_packed_shingles, "binary")("text").alias("shingles")), "shingles")
    similar = F.col("similarity") >= SIMILAR

    # First one leader per node, then the leaders of its other buckets unless already connected.
    pairs = stars.where(F.col("key") != F.col("leader")).select(F.col("key").alias("a"), F.col("leader").alias("b"))
    done = _verified(pairs.groupBy("a").agg(F.min("b").alias("b")), packed)
    roots = components(done.where(similar))
    apart = _labelled(_labelled(pairs.distinct(), "a", roots, "ra"), "b", roots, "rb").where("ra != rb")
    more = _verified(apart.select("a", "b").join(done, ["a", "b"], "left_anti"), packed)
    done = done.union(more)
    roots = components(done.where(similar))

    # Star groups that still hold several components are compared in full, block by block.
    return done.where(similar).union(_across(stars, roots, packed))


def _across(stars: DataFrame, roots: DataFrame, packed: DataFrame) -> DataFrame:
    """Links (a, b, similarity) between members of one star group that lie in different components.

    The members outside the largest component of their group are compared with all others. Members go
    into chunks and pairs of chunks into tasks, so that no group meets in one task; a task multiplies
    two chunks as sparse rows and returns links that join components, never its pairs.
    """
    members = stars.select("leader", "key").distinct()
    labelled = cut_lineage(_labelled(members, "key", roots, "root"))
    counts = labelled.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("leader").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    groups = groups.where(F.col("most") < F.col("all")).select(
        "leader", "main", F.ceil(F.col("most") / _CHUNK).cast("int").alias("mains"),
        F.ceil((F.col("all") - F.col("most")) / _CHUNK).cast("int").alias("outs"))
    placed = labelled.join(groups, "leader").withColumn("out", F.col("root") != F.col("main"))
    mixed = F.pmod(F.xxhash64("key", "leader"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("mains"))).cast("int")
    row = ["leader", "key", "root", "shingles"]
    placed = written(placed.withColumn("chunk", mixed).join(packed, "key").select(*row, "out", "chunk", "mains", "outs"), "groups")
    # Chunk i of the others meets all chunks of the largest component and chunks i, i + 1, .. of the others.
    left = placed.where("out").select(*row, F.col("chunk").alias("i"), F.explode(F.concat(
        F.transform(F.sequence(F.lit(1), F.col("mains")), lambda j: -j), F.sequence(F.col("chunk"), F.col("outs") - 1))).alias("j"))
    right = placed.where("out").select(*row, F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("i"), F.col("chunk").alias("j"))
    main = placed.where("NOT out").select(*row, F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"), (-1 - F.col("chunk")).alias("j"))
    # New names on the right, as both sides come from one table.
    other = right.union(main).toDF("leader2", "key", "root", "shingles", "i2", "j2")
    found = left.groupBy("leader", "i", "j").cogroup(other.groupBy("leader2", "i2", "j2")).applyInPandas(
        _compare, "a binary, b binary, similarity double")
    return cut_lineage(found)


def _columns(sets: list[tuple[np.ndarray, np.ndarray]], common: np.ndarray):
    """(row, column, count) of the shingles that are in `common`."""
    elements = np.concatenate([e for e, _ in sets])
    counts = np.concatenate([c for _, c in sets])
    rows = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    at = np.searchsorted(common, elements).clip(0, len(common) - 1)
    held = common[at] == elements
    return rows[held], at[held], counts[held]


def _products(left, right, common: np.ndarray, weight) -> np.ndarray:
    """Sums over the common shingles of weight(row, count) of both sides, for all pairs of rows."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    sides = [(_columns(s, common), s) for s in (left, right)]
    for at in range(0, len(common), _CHUNK):
        dense = []
        for (rows, columns, counts), sets in sides:
            part = (columns >= at) & (columns < at + _CHUNK)
            table = np.zeros((len(sets), min(_CHUNK, len(common) - at)), dtype=np.float32)
            table[rows[part], columns[part] - at] = weight(sets, rows[part], counts[part])
            dense.append(table)
        out += dense[0] @ dense[1].T
    return out


def _compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A spanning set of the links between different components of two chunks."""
    links: list[tuple[bytes, bytes, float]] = []
    if len(left) and len(right):
        a, b = [_unpack(x) for x in left["shingles"]], [_unpack(x) for x in right["shingles"]]
        seen, times = np.unique(np.concatenate([e for e, _ in a]), return_counts=True)
        common = seen[times > 1] if key[1] == key[2] else np.intersect1d(seen, np.concatenate([e for e, _ in b]))
        if len(common):
            links = _spanning(left, right, a, b, common)
    return pd.DataFrame(links, columns=["a", "b", "similarity"])


def _spanning(left, right, a, b, common) -> list[tuple[bytes, bytes, float]]:
    shared = _products(a, b, common, lambda sets, rows, counts: 1.0)
    sizes = [np.array([len(e) for e, _ in s], dtype=np.float64) for s in (a, b)]
    exact = shared / (sizes[0][:, None] + sizes[1][None, :] - shared)
    heavy = [np.array([c.max() > 1 for _, c in s]) for s in (a, b)]
    either = heavy[0][:, None] | heavy[1][None, :]
    likely = ~either & (exact >= SIMILAR)
    if either.any():
        # J is the chance that two draws agree, so it is at most the affinity, the sum of sqrt(p q).
        sums = [np.array([c.sum() for _, c in s], dtype=np.float64) for s in (a, b)]
        total = {id(a): sums[0], id(b): sums[1]}
        affinity = _products(a, b, common, lambda sets, rows, counts: np.sqrt(counts / total[id(sets)][rows]))
        likely |= either & (affinity >= SIMILAR - 1e-5)
    names = [[bytes(x) for x in f["root"]] for f in (left, right)]
    keys = [[bytes(x) for x in f["key"]] for f in (left, right)]
    parent: dict[bytes, bytes] = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    links = []
    for i, j in zip(*np.nonzero(likely), strict=True):
        x, y = find(names[0][i]), find(names[1][j])
        if x == y:
            continue
        score = prob_jaccard(a[i], b[j]) if either[i, j] else float(exact[i, j])
        if score >= SIMILAR:
            parent[x] = y
            links.append((keys[0][i], keys[1][j], score))
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, root, class_id, n_links): one row per row of `docs`, which has doc_id and text.

    class_id is the smallest doc_id of all documents connected by links of similarity 0.8 or more; texts
    with equal words are copies, also if they have fewer than five words (then all words are one
    shingle). Texts without words are copies only if they are equal; a null text is alone and its
    class is its own doc_id. Rows without doc_id take part but name no class while others do.
    n_links counts the links of the row's word sequence that were verified (stars, not all pairs). t1 and t2 are hashes
    of the text, root names the class.
    """
    rows = docs.select("doc_id", "text")
    base = cut_lineage(rows.select("doc_id", *_text_hash(), F.arrow_udf(_sketched, "key binary, bands array<long>")("text").alias("s")).select("doc_id", "t1", "t2", "s.*"))
    links = cut_lineage(_links(rows, base))
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    firsts = base.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc"))
    rooted = _labelled(firsts, "key", roots, "root")
    class_of = rooted.groupBy("root").agg(F.min("doc").alias("class_id"))
    nodes = rooted.join(class_of, "root").join(degree, "key", "left").select("key", "root", "class_id", "n_links")
    return base.join(nodes, "key", "left").select(
        "doc_id", "t1", "t2", "root",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one row of each class: of its smallest doc_id, and of equal rows one.

    A class without any doc_id keeps one row, too. All rows with a null text stay.
    """
    found = near_duplicates(docs)
    kept = (
        found.where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("root").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("h"))
        .select(F.col("h.doc_id").alias("_id"), F.col("h.t1").alias("_1"), F.col("h.t2").alias("_2"))
    )
    names = [f"`{c}`" for c in docs.columns]
    hashed = docs.where(F.col("text").isNotNull()).withColumns({"_t1": _text_hash()[0], "_t2": _text_hash()[1]})
    met = hashed.join(
        kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_1")) & (F.col("_t2") == F.col("_2")))
    one = met.dropDuplicates(["doc_id", "_t1", "_t2"])
    return one.select(*names).unionAll(docs.where(F.col("text").isNull()).select(*names))


def miss_probability(similarity: float) -> float:
    """The chance that a pair of this similarity shares no bucket."""
    return math.pow(1 - similarity**BAND_ROWS, BANDS)
