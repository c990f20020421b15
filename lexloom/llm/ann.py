"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The upper tree is fitted on a bounded sample of all vectors (SAMPLE), and every vector is put into the leaf that it descends
to. A leaf of more than GROW vectors is split by a tree of its own, fitted on a bounded sample of that leaf (SUB), in
one task a leaf; so there are up to SAMPLE / LEAST times SUB / LEAST bins, and their size stays near LEAF as the table grows.

A query walks a tree with a priority queue of nodes by the distance to their centre, and visits leaves in the order in which
they come off it; in a split leaf it does the same with the bins. How many leaves, and which share of a split leaf's bins,
is calibrated, not set: for CALIBRATION queries the true neighbours are found by brute force over all vectors, in
blocks, and the visits are widened until at least RECALL of these neighbours stand in visited bins, at the least number of
vectors to compare. However that comes out, a query visits on until its bins hold ten candidates.

Visits are made in rounds: FIRST leaves, then WIDER times as many, and so on. A query carries the ten nearest that it has
found, and the later rounds give out only rows that beat the tenth of these. As each round looks at bins further off,
about WIDER times ten such rows are to be expected, so that what is shuffled grows with the queries and the number of
rounds, and not with the leaves that are visited.

Leaves that are neighbours in the tree stand together in cells of CELL vectors, and a split leaf is a cell with ranges of
neighbouring bins. A range that a hot vector fills is cut into parts, by a vector's place in the file and not by its id or
value, and one that many queries visit is met by lots of LOT of them; so a hot vector, a repeated id or a leaf with a
third of all rows is spread like any others, and the pairs that are compared never leave a task. Only counts by leaf of the
upper tree reach the driver.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose length
is not the most common one; equal distances go to the smaller vec_id; a repeated query row is one query (of several vectors
under one id, the least in bytes), and rows that share its vec_id are not its candidates; with fewer candidates than ten all are
returned; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import cleared, dropped, mark, table, written

TOP, SAMPLE, LEAF, LEAST, BRANCH = 10, 20_000, 64, 8, 32  # neighbours; vectors fitted; rows wanted in a leaf; sampled ones it holds at least; children
CALIBRATION, RECALL = 200, 0.93
FIRST, WIDER = 4, 4  # leaves of the first round; growth from round to round
CELL, LOT = 4096, 512  # vectors of a cell, queries that meet it at a time
GROW, SUB = 4096, 2048  # vectors from which a leaf is split, and of these, fitted
SHARES = (1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12)  # of a split leaf's bins that may be visited
BINNED = "leaf int, sub int, salt int, vec_id long, v binary"
VECTORS = "leaf int, salt int, vec_id long, v binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id long, vec_id long, score double"


class Tree:
    """Arrays over nodes: centres of the children, which child nodes these are, and the leaf number or -1. Leaves are numbered in
    the tree's order, so that neighbours in it have near numbers."""

    def __init__(self, points: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 5):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self._grow(points, leaf, branch)
        del self.rng  # the tree is sent about

    def _grow(self, points: np.ndarray, leaf: int, branch: int) -> int:
        me = len(self.leaf)
        self.leaf.append(-1)
        self.centres.append(None)
        self.children.append([])
        parts = self._parts(points, min(branch, max(2, len(points) // leaf))) if len(points) > leaf else []
        if len(parts) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
            return me
        self.centres[me] = np.stack([p.mean(0) for p in parts])
        self.children[me] = [self._grow(p, leaf, branch) for p in parts]
        return me

    def _parts(self, points: np.ndarray, k: int, rounds: int = 8) -> list[np.ndarray]:
        distinct = np.unique(points, axis=0)
        if len(distinct) < 2:
            return []
        centres = distinct[self.rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(rounds):
            at = squares(points, centres).argmin(1)
            centres = np.stack([points[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        at = squares(points, centres).argmin(1)
        return [points[at == j] for j in range(len(centres)) if (at == j).any()]

    def assigned(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point descends to."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            at = squares(points[rows], self.centres[node]).argmin(1)
            todo += [(child, rows[at == j]) for j, child in enumerate(self.children[node]) if (at == j).any()]
        return out

    def leaves_by_distance(self, q: np.ndarray, visits: int, rows: dict[int, int] | None = None, enough: int = 0) -> list[int]:
        """Leaves in best-bin-first order: as many as visits says, and more until they hold `enough` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < enough):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += rows.get(self.leaf[node], 0) if rows else 0
            else:
                d = ((self.centres[node] - q) ** 2).sum(1)
                for child, x in zip(self.children[node], d.tolist()):
                    heapq.heappush(queue, (x, child))
        return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, good enough to choose a centre by."""
    return (b * b).sum(1) - 2 * (a @ b.T)


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, top: int, met: np.ndarray | None = None, bound: np.ndarray | None = None, bound_id: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of the top nearest of each query by differences in double precision, among the rows that it meets (all,
    if met is None) and that beat its bound. A product of matrices leaves only rows near the mark to be measured."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = (q * q).sum(1)[:, None] + (v * v).sum(1)
        about = size - 2 * (q @ v.T)
        slack = 1e-12 * size
    about = np.where(np.isfinite(about), about, 0.0)  # too large to tell: measured
    slack = np.where(np.isfinite(slack), slack, np.inf)
    out: list[tuple] = []
    for i, q_id in enumerate(q_ids):
        mine = ids != q_id
        if met is not None:
            mine &= met[i]
        low = about[i] - slack[i]
        if bound is not None and np.isfinite(bound[i]):
            mine &= low <= bound[i] * bound[i]
        rows = np.flatnonzero(mine)
        if len(rows) > top:
            high = about[i][rows] + slack[i][rows]
            rows = rows[low[rows] <= np.partition(high, top - 1)[top - 1]]
        if not len(rows):
            continue
        with np.errstate(over="ignore"):
            d = np.sqrt(((v[rows] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[rows], d))[:top]
        if bound is not None:
            best = best[(d[best] < bound[i]) | ((d[best] == bound[i]) & (ids[rows[best]] < bound_id[i]))]
        out.append((np.full(len(best), q_id), ids[rows[best]], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Binary vectors of doubles to rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    return v


def borders(visits: int) -> list[int]:
    """Where the rounds end in a query's order of leaves."""
    out = [min(FIRST, visits)]
    while out[-1] < visits:
        out.append(min(visits, WIDER * out[-1]))
    return out


def cells_of(by_leaf: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The cell that each leaf belongs to, and its number of ranges: neighbouring leaves as long as they are CELL rows together,
    or one leaf that is split."""
    out, cell, held = {}, 0, 0
    for leaf in sorted(by_leaf):
        n = by_leaf[leaf]
        if held and (held + n > CELL or n > GROW):
            cell, held = cell + 1, 0
        out[leaf] = (cell, -(-n // CELL) if n > GROW else 1)
        held += n
        if n > GROW:
            cell, held = cell + 1, 0
    return out


def explode_to(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def split(spark: SparkSession, index: DataFrame, grown: dict[int, int], dim: int) -> tuple[DataFrame, DataFrame]:
    """The index with each row's bin in its leaf (sub), 0 in leaves that are not split; and the split leaves' trees with their bins'
    sizes: leaf, tree, sizes."""
    sizes_ddl = "array<struct<sub:int,n:bigint>>"
    if not grown:
        return index.withColumn("sub", F.lit(0)), spark.createDataFrame([], f"leaf int, tree binary, sizes {sizes_ddl}")
    plan = F.broadcast(spark.createDataFrame([(leaf, n, -(-n // CELL)) for leaf, n in grown.items()], "leaf int, n long, chunks int"))  # at most SAMPLE / LEAST rows
    drawn = F.pmod(F.xxhash64(F.lit("sub"), "salt", "vec_id"), F.lit(1_000_003)) / 1_000_003

    def fit(t: pa.Table) -> pa.Table:
        points, n = matrix(t.column("v"), dim), t.column("n")[0].as_py()
        tree = Tree(points, max(LEAST, round(LEAF * len(points) / n)))
        return pa.table({"leaf": pa.array([t.column("leaf")[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    own = index.join(plan, "leaf")
    trees, _ = written(spark, own.where(drawn < SUB / F.col("n")).select("leaf", "n", "v").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary"), "ann-trees")

    def put(rows: pa.Table, tree: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema([("leaf", pa.int32()), ("sub", pa.int32()), ("salt", pa.int32()), ("vec_id", pa.int64()), ("v", pa.binary())]).empty_table()
        sub = pickle.loads(tree.column("tree")[0].as_py()).assigned(matrix(rows.column("v"), dim)) if tree.num_rows else np.zeros(rows.num_rows, np.int32)
        return pa.table({"leaf": rows.column("leaf"), "sub": pa.array(sub), "salt": rows.column("salt"), "vec_id": rows.column("vec_id"), "v": rows.column("v")})

    rows = own.select("leaf", F.pmod("salt", F.col("chunks")).alias("chunk"), "salt", "vec_id", "v")
    each = trees.join(plan, "leaf").select("leaf", explode_to("chunks").alias("chunk"), "tree")
    binned = rows.groupBy("leaf", "chunk").cogroup(each.groupBy("leaf", "chunk")).applyInArrow(put, BINNED)
    whole, _ = written(spark, index.join(plan, "leaf", "left_anti").withColumn("sub", F.lit(0)).unionByName(binned), "ann-bins")
    sizes = whole.join(plan, "leaf", "left_semi").groupBy("leaf", "sub").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.collect_list(F.struct("sub", "n")).cast(sizes_ddl).alias("sizes"))
    trees, _ = written(spark, trees.join(sizes, "leaf"), "ann-subtrees")
    return whole, trees


def search(spark: SparkSession, vectors: DataFrame, top: int = TOP, every: int = 100, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the vectors whose vec_id `every` divides."""
    good = usable(vectors)
    sizes = sorted(good.groupBy(F.size("embedding").alias("n")).count().collect(), key=lambda r: (-r["count"], r["n"]))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, total = int(sizes[0]["n"]), int(sizes[0]["count"])
    good = good.where(F.size("embedding") == dim)
    drawn = F.pmod(F.xxhash64(F.lit("tree"), "vec_id"), F.lit(1_000_003)) / 1_000_003
    fit = good.where(drawn < SAMPLE / total).orderBy(drawn, "vec_id").limit(2 * SAMPLE).select("embedding").toArrow()
    points = fit.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if fit.num_rows else np.zeros((0, dim))
    tree = Tree(points, max(LEAST, round(LEAF * len(points) / total)))
    shared = spark.sparkContext.broadcast(tree)
    since = mark()

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 1009
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            salt = (np.arange(at, at + len(v)) & 0x7FFFFFFF).astype(np.int32)
            at += len(v)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assigned(v)), pa.array(salt), b.column(0), pa.array([x.astype("<f8").tobytes() for x in v], pa.binary())], ["leaf", "salt", "vec_id", "v"])

    index, _ = written(spark, good.mapInArrow(leaves, VECTORS), "ann-index")
    queries = index.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"), F.count("*").alias("own"))
    by_leaf = {int(leaf): int(n) for leaf, n in index.groupBy("leaf").count().toArrow().to_pandas().itertuples(index=False)}
    grown = {leaf: n for leaf, n in by_leaf.items() if n > GROW}
    index, subtrees = split(spark, index, grown, dim)
    visits, share = calibrated(spark, tree, index, subtrees, queries, dim, top, recall, sum(grown.values()) / total)
    ends, cells = borders(visits), cells_of(by_leaf)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query, round and cell, with the leaves to visit there."""
        for b in batches:
            for q_id, raw, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                order = shared.value.leaves_by_distance(np.frombuffer(raw, "<f8"), visits, by_leaf, top + own)  # its own rows are no candidates
                asked: dict[tuple[int, int], list[int]] = {}
                for place, leaf in enumerate(order):
                    if leaf in cells:
                        turn = min(int(np.searchsorted(ends, place, side="right")), len(ends) - 1)
                        asked.setdefault((turn, cells[leaf][0]), []).append(leaf)
                turns, at = zip(*asked) if asked else ((), ())
                n = len(asked)
                yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int32()), pa.array(at, pa.int32()), pa.array([q_id] * n, pa.int64()), pa.array([raw] * n, pa.binary()), pa.array([own] * n, pa.int64()), pa.array(list(asked.values()), pa.list_(pa.int32()))], ["turn", "cell", "query_id", "q", "own", "leaves"])

    asked, _ = written(spark, queries.mapInArrow(probes, "turn int, cell int, query_id long, q binary, own long, leaves array<int>"), "ann-probes")
    asked = routed(spark, asked, subtrees, {leaf: cells[leaf] for leaf in grown}, share, top)
    subs = {int(leaf): int(n) for leaf, n in subtrees.select("leaf", F.array_max("sizes.sub") + 1).toArrow().to_pandas().itertuples(index=False)} if grown else {}
    places = F.broadcast(spark.createDataFrame([(leaf, cell, ranges, subs.get(leaf, 1)) for leaf, (cell, ranges) in cells.items()], "leaf int, cell int, ranges int, subs int"))  # at most SAMPLE / LEAST rows
    index = index.join(places, "leaf").withColumn("range", F.floor(F.col("sub") * F.col("ranges") / F.col("subs")).cast("int"))
    large = index.where("ranges > 1").groupBy("cell", "range").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL)
    parts, _ = written(spark, large.select("cell", "range", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), "ann-parts")
    found = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    path = None
    for turn in sorted(r[0] for r in asked.select("turn").distinct().collect()):  # as many as rounds
        best = ranked(found.drop("rank").unionByName(met_in(index, asked.where(F.col("turn") == turn), found.where(F.col("rank") == top), parts, dim, top)), top)
        found, new = written(spark, best, "ann-found")
        if path:
            dropped(spark, path)
        path = new
    cleared(spark, since, path or "")
    return found.select("query_id", "rank", "vec_id", "score")


def routed(spark: SparkSession, asked: DataFrame, subtrees: DataFrame, cells: dict[int, tuple[int, int]], share: float, top: int) -> DataFrame:
    """asked with range and subs: in a split leaf (cells: of these only), a row for each range that holds bins to visit, with these."""
    asked = asked.withColumns({"range": F.lit(0), "subs": F.lit(None).cast("array<int>")})
    if not cells:
        return asked
    split_cells = [cell for cell, _ in cells.values()]
    here = asked.where(F.col("cell").isin(split_cells)).drop("range", "subs").withColumn("leaf", F.col("leaves")[0])
    lots = here.groupBy("leaf").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    ddl = "turn int, cell int, query_id long, q binary, own long, leaves array<int>, range int, subs array<int>"

    def route(qs: pa.Table, tree: pa.Table) -> pa.Table:
        out: dict[str, list] = {f: [] for f in ("turn", "cell", "query_id", "q", "own", "leaves", "range", "subs")}
        if qs.num_rows and tree.num_rows:
            t, sizes = pickle.loads(tree.column("tree")[0].as_py()), {x["sub"]: x["n"] for x in tree.column("sizes")[0].as_py()}
            n, ranges = max(sizes) + 1, cells[qs.column("leaf")[0].as_py()][1]
            for r in qs.drop_columns(["leaf", "lot"]).to_pylist():
                bins: dict[int, list[int]] = {}
                for sub in t.leaves_by_distance(np.frombuffer(r["q"], "<f8"), max(1, int(np.ceil(share * t.leaves))), sizes, top + r["own"]):
                    if sub < n:
                        bins.setdefault(sub * ranges // n, []).append(sub)
                for range_, subs in bins.items():
                    for f, v in (r | {"range": range_, "subs": subs}).items():
                        out[f].append(v)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32())]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    left = here.join(lots, "leaf").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int")).drop("lots")
    right = subtrees.join(lots, "leaf").select("leaf", explode_to("lots").alias("lot"), "tree", "sizes")
    inside = left.groupBy("leaf", "lot").cogroup(right.groupBy("leaf", "lot")).applyInArrow(route, ddl)
    out, _ = written(spark, asked.where(~F.col("cell").isin(split_cells)).unionByName(inside), "ann-routed")
    return out


def met_in(index: DataFrame, asked: DataFrame, tenth: DataFrame, parts: DataFrame, dim: int, top: int) -> DataFrame:
    """query_id, vec_id, score: what the queries of one round find in the bins that they visit, if it beats their tenth."""
    lots = asked.groupBy("cell", "range").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    place = ["cell", "range"]
    n_parts = F.coalesce("parts", F.lit(1))
    left = index.join(lots, place).join(parts, place, "left").withColumn("part", F.pmod("salt", n_parts).cast("int"))
    left = left.select(*place, "part", explode_to("lots").alias("lot"), "leaf", "sub", "vec_id", "v")
    bounds = tenth.select("query_id", F.col("score").alias("bound"), F.col("vec_id").alias("bound_id"))
    right = asked.join(bounds, "query_id", "left").join(lots, place).join(parts, place, "left").withColumn("parts", n_parts)
    right = right.select(*place, explode_to("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int").alias("lot"), "query_id", "q", "leaves", "subs", "bound", "bound_id")
    key = [*place, "part", "lot"]

    def met(vs: pa.Table, qs: pa.Table) -> pa.Table:
        if not vs.num_rows or not qs.num_rows:
            return FOUND.empty_table()
        column, wanted = ("leaf", "leaves") if qs.column("subs")[0].as_py() is None else ("sub", "subs")  # the bins of one leaf, or leaves
        there, at = np.unique(vs.column(column).to_numpy(), return_inverse=True)
        visits = np.stack([np.isin(there, np.array(x, np.int64)) for x in qs.column(wanted).to_pylist()])
        some = visits.any(0)[at]
        bound = qs.column("bound").fill_null(float("inf")).to_numpy()
        bound_id = qs.column("bound_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        got = nearest(qs.column("query_id").to_numpy(), matrix(qs.column("q"), dim), vs.column("vec_id").to_numpy()[some], matrix(vs.column("v").filter(pa.array(some)), dim), top, visits[:, at[some]], bound, bound_id)
        return pa.table([pa.array(x) for x in got], schema=FOUND)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, FOUND_DDL)


def ranked(found: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("query_id", "vec_id", "score", "rank")


def brute(index: DataFrame, spark: SparkSession, q_ids: np.ndarray, q: np.ndarray, dim: int, top: int) -> DataFrame:
    """The true neighbours of a bounded set of queries: each task goes through its vectors in batches and keeps each query's
    nearest, which are then merged."""
    asked = spark.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q_id, vec_id, score in zip(*(x.tolist() for x in nearest(*asked.value, b.column(0).to_numpy(), matrix(b.column(1), dim), top))):
                best.setdefault(q_id, []).append((score, vec_id))
            for q_id, kept in best.items():
                if len(kept) > top:
                    best[q_id] = sorted(kept)[:top]
        rows = [(q_id, vec_id, score) for q_id, kept in best.items() for score, vec_id in kept]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else ((), (), ()), FOUND)], schema=FOUND)

    return ranked(index.select("vec_id", "v").mapInArrow(run, FOUND_DDL), top)


def calibrated(spark: SparkSession, tree: Tree, index: DataFrame, subtrees: DataFrame, queries: DataFrame, dim: int, top: int, recall: float, in_split: float) -> tuple[int, float]:
    """The number of leaves, and the share of a split leaf's bins, such that the recall over CALIBRATION queries is reached with the
    fewest vectors to compare. in_split: the share of all vectors that stand in split leaves."""
    chosen = queries.orderBy(F.xxhash64(F.lit("calibrate"), "query_id")).limit(CALIBRATION).toArrow()
    if not chosen.num_rows:
        return tree.leaves, 1.0
    q_ids, q = chosen.column(0).to_numpy(), matrix(chosen.column(1).combine_chunks(), dim)
    vector = {int(i): x for i, x in zip(q_ids, q)}
    true = brute(index, spark, q_ids, q, dim, top)
    true = true.join(index.select("leaf", "sub", "vec_id").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "leaf", "sub")
    rank_of = {i: {leaf: n for n, leaf in enumerate(tree.leaves_by_distance(x, tree.leaves), 1)} for i, x in vector.items()}

    def reached(found: pa.Table, subtree: pa.Table) -> pa.Table:
        """How far down its leaf's order of bins each neighbour stands."""
        shares = np.zeros(found.num_rows)
        if found.num_rows and subtree.num_rows:
            t = pickle.loads(subtree.column("tree")[0].as_py())
            for k, (i, sub) in enumerate(zip(found.column("query_id").to_pylist(), found.column("sub").to_pylist())):
                shares[k] = t.leaves_by_distance(vector[i], t.leaves).index(sub) / t.leaves
        return pa.table({"query_id": found.column("query_id"), "leaf": found.column("leaf"), "share": pa.array(shares)})

    found = true.groupBy("leaf").cogroup(subtrees.groupBy("leaf")).applyInArrow(reached, "query_id long, leaf int, share double").toArrow()
    ranks = np.array([rank_of[i][leaf] for i, leaf in zip(found.column("query_id").to_pylist(), found.column("leaf").to_pylist())])
    shares = found.column("share").to_numpy()
    if not len(ranks):
        return tree.leaves, 1.0
    wanted, ways = int(np.ceil(recall * len(ranks))), []
    for share in SHARES:
        near = np.sort(ranks[shares < share])  # the first bins, rounded up
        if len(near) >= wanted:
            ways.append((near[wanted - 1] * (1 - in_split + in_split * share), int(near[wanted - 1]), share))
    return min(ways)[1:]


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
