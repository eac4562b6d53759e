"""Exact nearest neighbours and eps-connectivity on vectors, without all pairs.

Points are assigned to the nearest of a bounded set of pivots, and neighbouring
cells are packed into blocks. A query first meets its own block, which bounds its
k-th neighbour distance; distances to the pivots give, by the triangle inequality,
a lower bound on its distance to each cell, so it visits only the blocks that can
hold a neighbour (Lu et al., "Efficient processing of k nearest neighbor joins
using MapReduce", VLDB 2012). Blocks and the groups of queries that meet them are
bounded, and each task returns only the k best of its block. Inside a task, tiles
of rows are passed over by the distance to their box, or by the same kind of bound. Of identical
reference points, at most as many copies as can be wanted are kept; identical
queries are answered once.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from txnlens.detectors.batches import matrix
from txnlens.operators.ordered import Running, running
from txnlens.operators.ranking import uniform_sample
from txnlens.session import cut_lineage

MAX_PIVOTS = 2_048
BLOCK_ROWS = 80_000  # most rows of a block, and of the queries that meet it in one task
TILE_ROWS = 2_000  # rows compared at a time
LEAF_ROWS, BOX_WIDTH = 1_024, 32  # rows of a tile with a box, and the most columns for which boxes are used
_BATCH = 256
_SUM_TILE = 1_024
_SLACK = 1 + 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from explicit differences, in slices of bounded size."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _approximate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances through one matrix product, and a bound on their error."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    rough = a @ (-2 * b.T)
    rough += aa[:, None]
    rough += bb
    return rough, 1e-10 * (1 + aa.max() + bb.max())


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs lie within eps; those too close to call are measured exactly."""
    rough, error = _approximate(a, b)
    close, at_most = rough <= eps * eps - error, rough <= eps * eps + error
    query, row = np.nonzero(close != at_most)
    close[query, row] = _exact(a, b, query, row) <= eps
    return close


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


class _Cells:
    """Pivots, the count and radii of the points around each, and the block its points are in.

    Blocks hold `block_rows` points at most: cells near each other share one, a larger cell has several.
    """

    def __init__(self, pivots, block_rows):
        self.pivots, self.block_rows = pivots, block_rows
        self.between = _distances(pivots, pivots)
        self.count = np.zeros(len(pivots), dtype=int)
        self.low = np.full(len(pivots), np.inf)
        self.high = np.full(len(pivots), -np.inf)

    def pack(self):
        """Number the blocks along a chain from each cell to the nearest one left."""
        self.first = np.zeros(len(self.pivots), dtype=int)
        self.split = np.maximum(1, -(-self.count // self.block_rows))
        left, at, block, held = self.count > 0, int(self.count.argmax()), 0, 0
        while left.any():
            at = int(np.where(left, self.between[at], np.inf).argmin())
            left[at] = False
            if held and held + self.count[at] > self.block_rows:
                block, held = block + 1, 0
            self.first[at], held = block, held + self.count[at]
            if self.split[at] > 1:
                block, held = block + self.split[at], 0
        self.blocks = int((self.first + self.split).max())
        numbers = np.arange(self.blocks)
        self.holds = ((numbers >= self.first[:, None]) & (numbers < (self.first + self.split)[:, None])
                      & (self.count > 0)[:, None]).astype("float32")

    def place(self, vectors):
        """Distances to the pivots, the own (not empty) cell and a block of it."""
        to_pivot = _distances(vectors, self.pivots)
        own = np.where(self.count > 0, to_pivot, np.inf).argmin(axis=1)
        return to_pivot, own, self.first[own] + np.arange(len(own)) % self.split[own]

    def needed(self, to_pivot, own, reach):
        """Per query and block: may the block hold a point within `reach`?"""
        nearest = to_pivot[np.arange(len(own)), own][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to_pivot**2 - nearest**2) / (2 * self.between[own])
        plane = np.where(self.between[own] > 0, plane, 0.0)
        lower = np.maximum(np.maximum(to_pivot - self.high, self.low - to_pivot), plane)
        hit = (lower <= reach[:, None] * _SLACK + 1e-12) & (self.count > 0)
        return hit.astype("float32") @ self.holds > 0


def _choose_pivots(refs: DataFrame, rows: int) -> np.ndarray:
    wanted = int(min(MAX_PIVOTS, max(1, 2 * rows // min(TILE_ROWS, BLOCK_ROWS))))
    picked = uniform_sample(refs.select("id", "vector"), "id", wanted, seed=7).collect()
    return np.unique(np.array([r["vector"] for r in picked], dtype=float), axis=0)


def _assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (`cell`) and the distance to it (`r`)."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        for batch in batches:
            if len(batch):
                to_pivot = _distances(_stack(batch["vector"]), shared.value)
                yield batch.assign(cell=to_pivot.argmin(axis=1).astype("int32"), r=to_pivot.min(axis=1))

    ddl = _ddl(points) + ", cell int, r double"
    return points.mapInPandas(nearest, ddl)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _cell_table(placed: DataFrame, pivots: np.ndarray, rows: int) -> _Cells:
    """Counts and radii per cell, one row each, and the blocks they are packed into."""
    cells = _Cells(pivots, _share(rows, 8))
    for row in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")
    ).collect():
        cells.count[row["cell"]] = row["n"]
        cells.low[row["cell"]], cells.high[row["cell"]] = row["low"], row["high"]
    cells.pack()
    return cells


def _share(rows: int, parts: int) -> int:
    """Rows of one of `parts` groups, within the bounds of what a task holds."""
    return min(BLOCK_ROWS, max(TILE_ROWS, -(-rows // parts)))


def _indexed(refs: DataFrame) -> tuple[DataFrame, _Cells]:
    """Reference rows with their cell and block, and the table of cells."""
    rows = refs.count()
    pivots = _choose_pivots(refs, rows)
    placed = cut_lineage(_assign(refs, pivots))
    cells = _cell_table(placed, pivots, rows)
    spots = placed.sparkSession.createDataFrame(  # one row per pivot
        [(c, int(cells.first[c]), int(cells.split[c])) for c in range(len(pivots))], "cell int, _first int, _split int")
    block = (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_split"))).cast("int").alias("block")
    return placed.join(F.broadcast(spots), "cell").select(*placed.columns, block), cells


def _at_home(points: DataFrame, cells: _Cells) -> DataFrame:
    """Add the own block (`home`) and ask for that block alone."""
    shared = points.sparkSession.sparkContext.broadcast(cells)

    def place(batches):
        for batch in batches:
            for start in range(0, len(batch), _BATCH):
                part = batch.iloc[start:start + _BATCH]
                home = shared.value.place(_stack(part["vector"]))[2].astype("int32")
                yield part.assign(home=home, blocks=[[h] for h in home])

    return points.mapInPandas(place, _ddl(points) + ", home int, blocks array<int>")


def _visits(points: DataFrame, cells: _Cells, eps: float | None = None) -> DataFrame:
    """Add the blocks that may hold a row within `eps`, or within each query's own `reach` outside its `home`."""
    shared = points.sparkSession.sparkContext.broadcast(cells)

    def visit(batches):
        for batch in batches:
            for start in range(0, len(batch), _BATCH):
                part = batch.iloc[start:start + _BATCH]
                to_pivot, own, home = shared.value.place(_stack(part["vector"]))
                if eps is None:
                    wanted = shared.value.needed(to_pivot, own, part["reach"].to_numpy())
                    wanted[np.arange(len(part)), part["home"]] = False
                else:
                    wanted = shared.value.needed(to_pivot, own, np.full(len(part), eps))
                    part = part.assign(home=home.astype("int32"))
                yield part.assign(blocks=[np.flatnonzero(w).astype("int32") for w in wanted])

    if eps is not None:
        return points.mapInPandas(visit, _ddl(points) + ", home int, blocks array<int>")
    return points.drop("blocks").mapInPandas(visit, _ddl(points.drop("blocks")) + ", blocks array<int>")


_GROUP = ["home", "block", "part"]


def _grouped(queries: DataFrame, placed: DataFrame, columns: list[str] = (), extra: list[str] = ()):
    """Queries and the blocks they ask for, both keyed by (home, block, part) with bounded rows per key.

    A query travels once per block and a block once per group of queries that asks for it, so what is
    shuffled falls with the size of blocks and groups.
    """
    queries = cut_lineage(queries)
    asked = queries.select("home", F.explode("blocks").alias("block")).groupBy("home", "block").count().collect()
    size = _share(queries.count(), 24)
    pairs = F.broadcast(queries.sparkSession.createDataFrame(  # one row per pair of blocks
        [(r["home"], r["block"], -(-r["count"] // size)) for r in asked], "home int, block int, parts int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    left = queries.select("id", "vector", *columns, "home", F.explode("blocks").alias("block")).join(
        pairs, ["home", "block"]).select("id", "vector", *columns, "home", "block", part)
    right = placed.join(pairs, "block").select(
        "id", "vector", "cell", *extra, "home", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return queries, left.groupBy(*_GROUP).cogroup(right.groupBy(*_GROUP))


def _leaves(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers in groups of about `rows` rows near each other: medians of the widest column, over and over."""
    found, waiting = [], [np.arange(len(x))]
    while waiting:
        members = waiting.pop()
        if len(members) > rows:
            few = np.sort(x[members[::max(1, len(members) // 200)]], axis=0)
            edge = len(few) // 50  # a few far rows do not make a column wide
            spread = few[-1 - edge] - few[edge]
            if not spread.any():
                spread = x[members].max(axis=0) - x[members].min(axis=0)
            if spread.any():
                values = x[members, spread.argmax()]
                middle = np.median(values)
                left = values < middle if middle > values.min() else values <= middle
                waiting += [members[left], members[~left]]
                continue
        found.append(members)
    return found


class _Tiles:
    """A block in tiles of rows near each other: small ones with their boxes, or for wide vectors, where boxes say
    little, tiles of neighbouring cells, each with its centre and radius."""

    def __init__(self, vectors: np.ndarray, cell: np.ndarray):
        self.boxed = vectors.shape[1] <= BOX_WIDTH
        if self.boxed:
            self.rows = _leaves(vectors, LEAF_ROWS)
        else:
            order = np.argsort(cell, kind="stable")
            self.rows = [order[i:i + TILE_ROWS] for i in range(0, len(order), TILE_ROWS)]
        self.vectors = [vectors[r] for r in self.rows]
        if self.boxed:
            self.low = np.array([v.min(axis=0) for v in self.vectors]).T[:, :, None]
            self.high = np.array([v.max(axis=0) for v in self.vectors]).T[:, :, None]
        else:
            self.centres = np.array([v.mean(axis=0) for v in self.vectors])
            self.radius = np.array([_distances(v, c[None, :]).max() for v, c in zip(self.vectors, self.centres)])

    def visits(self, a: np.ndarray):
        """(tile, lower bound of each query's distance to it, NaN where the tile is not its turn); the nearest tile first."""
        if not self.boxed:
            lower = _distances(a, self.centres) / _SLACK - self.radius * _SLACK - 1e-12
            for tile in lower.mean(axis=0).argsort():
                yield tile, lower[:, tile]
            return
        lower = np.empty((len(self.rows), len(a)))
        for start in range(0, len(a), _BATCH):
            part = np.zeros((len(self.rows), len(a[start:start + _BATCH])))
            for x, low, high in zip(a[start:start + _BATCH].T, self.low, self.high):
                gap = np.maximum(low - x, x - high)
                np.maximum(gap, 0, out=gap)
                part += np.square(gap, out=gap)
            lower[:, start:start + _BATCH] = np.sqrt(part, out=part) / _SLACK - 1e-12
        # Each query's few nearest tiles, then every tile with all the queries that still need it.
        for near in np.argpartition(lower, range(3), axis=0)[:3] if len(self.rows) > 3 else []:
            for tile in np.unique(near):
                turn = near == tile
                yield tile, np.where(turn, lower[tile], np.nan)
                lower[tile, turn] = np.nan
        yield from enumerate(lower)


def _query_tiles(queries: pd.DataFrame, block: np.ndarray):
    """Row numbers of the queries in groups; without boxes those near each other together."""
    vectors = _stack(queries["vector"])
    if vectors.shape[1] <= BOX_WIDTH:
        return [np.arange(i, min(i + 4_000, len(vectors))) for i in range(0, len(vectors), 4_000)]
    centre = block[np.linspace(0, len(block) - 1, min(64, len(block))).astype(int)]
    order = np.argsort(_distances(vectors, centre).argmin(axis=1), kind="stable")
    return [order[i:i + 1_000] for i in range(0, len(order), 1_000)]


def _exact(a: np.ndarray, b: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty(len(query))
    for i in range(0, len(query), 100_000):
        gap = a[query[i:i + 100_000]] - b[row[i:i + 100_000]]
        out[i:i + 100_000] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _best_of_block(a: np.ndarray, reach: np.ndarray, tiles: _Tiles, k: int):
    """(query, block row, distance): the k nearest rows of the block within each query's reach."""
    best = np.full((len(a), k), np.inf)
    which = np.full((len(a), k), np.iinfo(np.int64).max)
    limit = reach.copy()
    for tile, lower in tiles.visits(a):
        asks = np.flatnonzero(lower <= limit)
        if not len(asks):
            continue
        b, rows = tiles.vectors[tile], tiles.rows[tile]
        rough, error = _approximate(a[asks], b)
        cut = limit[asks] ** 2 * _SLACK + 2 * error
        new = ~np.isfinite(cut)
        if new.any():
            nth = min(k, len(b)) - 1
            cut[new] = np.partition(rough[new], nth, axis=1)[:, nth] + 2 * error
        query, row = np.nonzero(rough <= cut[:, None])
        if not len(query):
            continue
        far = _exact(a[asks], b, query, row)
        query, row = asks[query], rows[row]
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, k)])
        row, far = np.concatenate([row, which[touched].ravel()]), np.concatenate([far, best[touched].ravel()])
        order = np.lexsort((row, far, query))
        query, row, far = query[order], row[order], far[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < k
        best[query[keep], nth[keep]], which[query[keep], nth[keep]] = far[keep], row[keep]
        limit = np.minimum(reach, best[:, -1])
    query, nth = np.nonzero(best <= reach[:, None])
    found = np.isfinite(best[query, nth])
    query, nth = query[found], nth[found]
    return query, which[query, nth], best[query, nth]


def _nearest_points(points: DataFrame, refs: DataFrame, k: int, radius: float | None) -> DataFrame:
    """(point, neighbour_id, distance): the k nearest reference rows of each point.

    Every query first meets its own block; the distance of its k-th neighbour there says which other blocks
    it still has to visit.
    """
    placed, cells = _indexed(refs)
    own, kind = dict(points.dtypes)["id"], dict(refs.dtypes)["id"]
    most = np.inf if radius is None else float(radius)

    def search(queries: pd.DataFrame, block: pd.DataFrame, reach: np.ndarray):
        block = block.sort_values("id")
        a, b, ids = _stack(queries["vector"]), _stack(block["vector"]), block["id"].to_numpy()
        tiles = _Tiles(b, block["cell"].to_numpy())
        for part in _query_tiles(queries, b):
            query, row, far = _best_of_block(a[part], reach[part], tiles, k)
            yield part, query, ids[row], far

    def start(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        queries = queries.reset_index(drop=True)
        out = queries[["id", "vector", "home"]].assign(reach=most)
        near, far = [[] for _ in range(len(out))], [[] for _ in range(len(out))]
        reach = np.full(len(out), most)
        if len(queries) and len(block):
            for part, query, ids, found in search(queries, block, reach):
                ends = np.searchsorted(query, np.arange(len(part) + 1))
                for i, at in enumerate(part):
                    near[at], far[at] = ids[ends[i]:ends[i + 1]], found[ends[i]:ends[i + 1]]
                    if ends[i + 1] - ends[i] == k:
                        reach[at] = far[at][-1]
        return out.assign(reach=reach, near=near, far=far)

    def more(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"point": [], "neighbour_id": [], "distance": []})
        ids = queries["id"].to_numpy()
        return pd.concat([
            pd.DataFrame({"point": ids[part][query], "neighbour_id": near, "distance": far})
            for part, query, near, far in search(queries, block, queries["reach"].to_numpy())])

    _, both = _grouped(_at_home(points, cells), placed)
    met = both.applyInPandas(
        start, f"id {own}, vector array<double>, home int, reach double, near array<{kind}>, far array<double>")
    met, both = _grouped(_visits(met, cells), placed, ["reach"])
    first = met.select(F.col("id").alias("point"), F.explode(F.arrays_zip("near", "far")).alias("f")).select(
        "point", F.col("f.near").alias("neighbour_id"), F.col("f.far").alias("distance"))
    pairs = first.unionByName(both.applyInPandas(more, f"point {own}, neighbour_id {kind}, distance double"))
    nearest = Window.partitionBy("point").orderBy("distance", "neighbour_id")
    return pairs.withColumn("_nth", F.row_number().over(nearest)).filter(f"_nth <= {k}").drop("_nth")


def _finite(rows: DataFrame) -> DataFrame:
    """Rows that have distances; any other would spoil the bounds of the rows it shares a block with."""
    return rows.filter(F.forall("vector", lambda x: F.abs(x) < F.lit(float("inf"))))


def _without_spare_copies(refs: DataFrame, copies: int) -> DataFrame:
    """No query can use more than `copies` identical reference points."""
    counted = running(refs.select("id", "vector"), ["vector"], ["id"], {"_copy": Running("count")})
    return counted.filter(F.col("_copy") <= copies).drop("_copy")


def nearest_neighbours(
    queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool = False, radius: float | None = None
) -> DataFrame:
    """(id, neighbour_id, distance, rank) for (id, vector) rows; ties go to the lower id.

    With `radius` neighbours farther away are left out, so rows may have fewer than k.
    """
    wanted = k + 1 if exclude_self else k
    points = queries.groupBy("vector").agg(F.min("id").alias("point"))
    kept = cut_lineage(_without_spare_copies(_finite(refs), wanted))
    found = _nearest_points(_finite(points).select(F.col("point").alias("id"), "vector"), kept, wanted, radius)
    rows = queries.join(points, "vector").select("id", "point")
    matched = rows.join(found, "point")
    if exclude_self:
        matched = matched.filter("id <> neighbour_id")
    order = Window.partitionBy("id").orderBy("distance", "neighbour_id")
    return (
        matched.select("id", "neighbour_id", "distance", F.row_number().over(order).alias("rank"))
        .filter(F.col("rank") <= k)
    )


def _joined_labels(label: np.ndarray, one: np.ndarray, two: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row of its component) after joining the close pairs of two tiles."""
    query, row = np.nonzero(close)
    u, v = label[one[query]], label[two[row]]
    while True:
        apart = u != v
        u, v = u[apart], v[apart]
        if not len(u):
            return label
        # The larger label takes the smaller one, then every row its root's.
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != root[root]).any():
            root = root[root]
        label, u, v = root[label], root[u], root[v]


def eps_links(points: DataFrame, eps: float) -> DataFrame:
    """(node, root): edges that connect exactly what pairs within eps connect.

    Each task replaces the pairs of its block by one edge per point to the
    smallest id of its local component.
    """
    distinct = points.groupBy("vector").agg(F.min("id").alias("id"))
    copies = points.join(distinct.withColumnRenamed("id", "root"), "vector").select(
        F.col("id").alias("node"), "root")
    refs = cut_lineage(_finite(distinct).select("id", "vector"))
    placed, cells = _indexed(refs)
    _, both = _grouped(_visits(refs, cells, eps), placed)

    def connect(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"node": [], "root": []})
        names = np.unique(np.concatenate([queries["id"].to_numpy(), block["id"].to_numpy()]))
        at_a, at_b = (np.searchsorted(names, x["id"].to_numpy()) for x in (queries, block))
        a, b = _stack(queries["vector"]), _stack(block["vector"])
        tiles = _Tiles(b, block["cell"].to_numpy())
        label = np.arange(len(names))
        for part in _query_tiles(queries, b):
            for tile, lower in tiles.visits(a[part]):
                one, two = at_a[part[lower <= eps]], at_b[tiles.rows[tile]]
                if not len(one) or (label[one] == label[one[0]]).all() and (label[two] == label[one[0]]).all():
                    continue  # nothing near, or connected already
                close = _within(a[part[lower <= eps]], tiles.vectors[tile], eps)
                label = _joined_labels(label, one, two, close)
        moved = label != np.arange(len(names))
        return pd.DataFrame({"node": names[moved], "root": names[label[moved]]})

    kind = dict(points.dtypes)["id"]
    local = both.applyInPandas(
        connect, f"node {kind}, root {kind}")
    return local.union(copies.filter("node <> root")).distinct()


def count_within(points: DataFrame, eps: float) -> DataFrame:
    """(id, n): how many rows lie within eps of each row, itself included."""
    distinct = points.groupBy("vector").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    refs = cut_lineage(_finite(distinct))
    placed, cells = _indexed(refs)
    _, both = _grouped(_visits(refs.select("id", "vector"), cells, eps), placed, extra=["weight"])

    def count(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"point": [], "n": []})
        a, b, weight = _stack(queries["vector"]), _stack(block["vector"]), block["weight"].to_numpy()
        tiles, n = _Tiles(b, block["cell"].to_numpy()), np.zeros(len(a), dtype=np.int64)
        for part in _query_tiles(queries, b):
            for tile, lower in tiles.visits(a[part]):
                asks = part[lower <= eps]
                if len(asks):
                    n[asks] += _within(a[asks], tiles.vectors[tile], eps) @ weight[tiles.rows[tile]]
        return pd.DataFrame({"point": queries["id"], "n": n})

    kind = dict(points.dtypes)["id"]
    found = both.applyInPandas(
        count, f"point {kind}, n long").groupBy("point").agg(F.sum("n").alias("n"))
    rows = points.join(distinct.select("vector", F.col("id").alias("point")), "vector")
    return rows.select("id", "point").join(found, "point").select("id", "n")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id each node is connected to.

    Labels spread to neighbours and then jump to their label's label; each round
    is written out, so the plan stays short and a lost executor costs one round.
    """
    both = cut_lineage(links.union(links.select("root", "node")).distinct())
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        offered = (
            both.join(labels.withColumnRenamed("id", "root"), "root")
            .groupBy("node").agg(F.min("component").alias("offer"))
            .withColumnRenamed("node", "id")
        )
        spread = labels.join(offered, "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        spread = cut_lineage(spread)
        parents = spread.select(F.col("id").alias("component"), F.col("component").alias("parent"))
        jumped = cut_lineage(
            spread.join(parents, "component", "left").select(
                "id", "old", F.coalesce("parent", "component").alias("component")))
        labels = jumped.select("id", "component")
        if jumped.filter("component <> old").isEmpty():
            return labels


def _distance_sums(one, other):
    """Distances of all pairs, summed by the members of `other` and of `one`: (rows, members), (members, rows).

    `one` and `other` are (vectors, members), members a 0/1 matrix of rows and clusters. Tiles bound what is held.
    """
    (a, in_a), (b, in_b) = one, other
    left, right = np.zeros((len(a), in_b.shape[1])), np.zeros((len(b), in_a.shape[1]))
    norms = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    for i in range(0, len(a), _SUM_TILE):
        for j in range(0, len(b), _SUM_TILE):
            u, v = a[i:i + _SUM_TILE], b[j:j + _SUM_TILE]
            scale = norms[0][i:i + _SUM_TILE, None] + norms[1][None, j:j + _SUM_TILE]
            far = u @ (-2 * v.T)
            far += scale
            # Where the product cancels the distance is measured from the differences.
            query, row = np.nonzero(~(far > 1e-4 * scale))
            np.sqrt(np.maximum(far, 0, out=far), out=far)
            far[query, row] = _exact(u, v, query, row)
            left[i:i + _SUM_TILE] += far @ in_b[j:j + _SUM_TILE]
            right[j:j + _SUM_TILE] += far.T @ in_a[i:i + _SUM_TILE]
    return left, right


def full_silhouette(points: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) of all `points`, each against all of them.

    Rows are dealt to blocks; a task meets one pair of blocks and returns each row's sum of distances per cluster
    of the other block, so memory follows the block, and the work the square of the rows. Rows alone in their
    cluster get 0, rows without a cluster null and no part in the others'; null where there is one cluster only.
    """
    kept = points.select("id", "vector", "cluster").withColumn("_row", F.monotonically_increasing_id())
    kept = cut_lineage(kept)  # the row numbers must stay the same in every later read
    known = kept.filter("cluster IS NOT NULL")
    rows = known.count()
    blocks = max(1, -(-rows // min(_share(rows, 8), BLOCK_ROWS // 2)))
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = known.select("_row", "vector", "cluster", block.alias("block"), other.alias("_other")).select(
        "_row", "vector", "cluster", "block", F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"))
    kind = points.schema["cluster"].dataType

    def meet(key, table):
        coded = table["cluster"].combine_chunks().dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        blocks_of, rows_of = table["block"].to_numpy(), table["_row"].to_numpy()
        sides = []
        for number in dict.fromkeys(k.as_py() for k in key):
            at = np.flatnonzero(blocks_of == number)
            if not len(at):
                return schema.empty_table()
            held, member = np.unique(code[at], return_inverse=True)
            vectors = matrix(table["vector"].take(pa.array(at)).combine_chunks())
            sides.append((rows_of[at], code[at], held, vectors, np.eye(len(held))[member]))
        one, two = sides[0], sides[-1]
        left, right = _distance_sums(one[3:], two[3:])
        parts = []
        for (rows, own, *_), (_, _, held, *_), sums in ((one, two, left), (two, one, right))[:len(sides)]:
            parts.append(pa.table([
                pa.array(np.repeat(rows, len(held))), names.take(pa.array(np.repeat(own, len(held)))),
                names.take(pa.array(np.tile(held, len(rows)))), pa.array(sums.ravel())], schema=schema))
        return pa.concat_tables(parts)

    named = to_arrow_type(kind)
    schema = pa.schema([("_row", pa.int64()), ("own", named), ("other", named), ("total", pa.float64())])
    sums = dealt.groupBy("one", "two").applyInArrow(
        meet, f"_row long, own {kind.simpleString()}, other {kind.simpleString()}, total double")
    sizes = known.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    per = sums.groupBy("_row", "own", "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    own, away = F.col("own") == F.col("other"), F.col("total") / F.col("size")
    found = per.groupBy("_row").agg(
        F.max(F.when(own, F.col("total") / F.nullif(F.col("size") - 1, F.lit(0)))).alias("a"),
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.min(F.when(~own, away)).alias("b"), F.max(F.when(~own, F.isnan(away))).alias("_lost"))
    a, b = F.col("a"), F.when(F.col("_lost"), F.lit(float("nan"))).otherwise(F.col("b"))
    top = F.greatest(a, b)
    width = F.when((F.col("size") == 1) | (top == 0), 0.0).when(b.isNotNull(), (b - a) / top)
    return kept.join(found.select("_row", width.alias("silhouette")), "_row", "left").select("id", "cluster", "silhouette")


def silhouette(points: DataFrame, sample: DataFrame, sample_rows: int) -> DataFrame:
    """(id, cluster, silhouette) of all `points`, each against the `sample` of them.

    The sample travels to the tasks, so more than `sample_rows` rows are refused.
    Rows alone in their cluster, or of a cluster that the sample lacks, get 0.
    """
    kept = sample.select("id", "vector", "cluster").limit(sample_rows + 1).toPandas()
    if len(kept) > sample_rows:
        raise ValueError(f"the sample has more than {sample_rows} rows")
    vectors, clusters, ids = _stack(kept["vector"]), kept["cluster"].to_numpy(), set(kept["id"])
    names = np.unique(clusters)
    if len(names) < 2:
        return points.sparkSession.createDataFrame([], _ddl(points.select("id", "cluster")) + ", silhouette double")
    members = (clusters[None, :] == names[:, None]).astype(float)
    shared = points.sparkSession.sparkContext.broadcast((vectors, names, members, ids))

    def width(batches):
        base, labels, inside, sampled = shared.value
        sizes = inside.sum(axis=1)
        for batch in batches:
            if not len(batch):
                continue
            wanted = batch["cluster"].to_numpy()
            own = np.searchsorted(labels, wanted).clip(0, len(labels) - 1)
            itself = batch["id"].isin(sampled).to_numpy()
            sums = _distances(_stack(batch["vector"]), base) @ inside.T
            rows = np.arange(len(batch))
            others = sizes[own] - itself
            alone = (others == 0) | (labels[own] != wanted)
            a = sums[rows, own] / np.maximum(others, 1)
            means = sums / sizes
            means[rows, own] = np.inf
            b = means.min(axis=1)
            top = np.maximum(a, b)
            value = np.where(alone | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))
            yield batch[["id", "cluster"]].assign(silhouette=value)

    return points.select("id", "vector", "cluster").mapInPandas(
        width, _ddl(points.select("id", "cluster")) + ", silhouette double")
