"""Exact top-k by inner product with dual-tree search over cover trees.

The top of the tree is a set of pivots: the vectors of a cell are those nearest to its
pivot. Below it every block of a cell is a cover tree, built in the task that holds the
block; queries have trees of the same kind. Each group of queries first searches the block
it would itself belong to, which gives every query a k-th score. Pairs of nodes, first of
query block and cell, then of nodes of both trees, are dropped if no product in them can
reach the worst k-th score of the query group:

    q.c <= Q.C + rq |C| + rc |Q| + rq rc     (centres Q, C; covering radii rq, rc)

Where a covering of half the radius would need a centre for every few vectors, as it does
for vectors without structure, the node stays a leaf and is scored as one matrix product.
Pivots are chosen from ``SAMPLE`` vectors per pivot and there are ``PIVOTS`` at most;
which they are decides speed, never results. Every vector is indexed.

Cases: vectors that are null, empty or hold null or non-finite components take no part; shorter
ones count as padded with zeros; candidates with the query's own id are left out; query
rows that repeat an id are one query, candidate rows that repeat one are each a candidate;
ties go to the smaller id; rows with a null id take no part; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwarden.llm.tables import bounded_batches, written

BLOCK = 4096
QUERY_BLOCK = 1024
PIVOTS = 1024
SAMPLE = 8
LEAF = 64
FLAT = 8  # a covering with more centres than one per so many vectors is none
NONE = -np.inf
TREES = "cell int, salt int, tree binary, centre array<double>, radius double, from_pivot double"


def scaled(vector: Column, factor: int = 64) -> Column:
    """``floor(factor * x)`` of each component as double; null unless all are finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    usable = (F.size(vector) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * factor).cast("bigint")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of float64, which holds products below 2^53 exactly."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first centres."""
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def build(points: np.ndarray, ids: np.ndarray) -> dict:
    """A cover tree: nodes with centre, covering radius, children; leaves with a range of rows."""
    order, nodes = [], []

    def grow(rows: np.ndarray, centre: np.ndarray) -> int:
        radius = float(np.linalg.norm(points[rows] - centre, axis=1).max())
        at = len(nodes)
        nodes.append(None)
        groups = net(rows, radius / 2) if radius > 0 and len(rows) > LEAF else None
        if groups is None:
            nodes[at] = centre, radius, (), len(order), len(order) + len(rows)
            order.extend(rows.tolist())
        else:
            start = len(order)
            children = tuple(grow(g, points[g[0]]) for g in groups)
            nodes[at] = centre, radius, children, start, len(order)
        return at

    def net(rows: np.ndarray, radius: float):
        """Rows by the first centre within the radius, or None where too many centres are needed."""
        left, groups = rows, []
        while len(left):
            if len(groups) >= max(2, len(rows) // FLAT):
                return None
            near = np.linalg.norm(points[left] - points[left[0]], axis=1) <= radius
            groups.append(left[near])
            left = left[~near]
        return groups

    grow(np.arange(len(ids)), points.mean(0))
    return {
        "centre": np.array([x[0] for x in nodes]), "radius": np.array([x[1] for x in nodes]),
        "norm": np.linalg.norm(np.array([x[0] for x in nodes]), axis=1), "children": [x[2] for x in nodes],
        "range": [x[3:] for x in nodes], "points": points[order], "ids": ids[order],
    }


def packed(tree: dict) -> bytes:
    p = tree["points"]
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if (abs(p) <= np.iinfo(t).max).all() or t is np.int64)
    return pickle.dumps({**tree, "points": p.astype(kind)})


def unpacked(data: bytes) -> dict:
    tree = pickle.loads(data)
    tree["points"] = tree["points"].astype(np.float64)
    return tree


def reach(q_centre, q_radius, c_centre, c_radius):
    """The largest product possible between two balls, a little above to be safe from rounding."""
    q_norm, c_norm = np.linalg.norm(q_centre, axis=-1), np.linalg.norm(c_centre, axis=-1)
    bound = q_centre @ np.transpose(c_centre) + q_radius * c_norm + c_radius * q_norm + q_radius * c_radius
    return bound + 1e-9 * np.abs(bound) + 1e-6


class Best:
    """The k best candidates of each query so far, and the score a further one must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.n = n

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[rows]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        if not len(i):
            return
        q = np.concatenate([self.q, rows[i]])
        score = np.concatenate([self.score, scores[i, j]])
        own = np.concatenate([self.id, ids[j]])
        order = np.lexsort((own, -score, q))
        q, score, own = q[order], score[order], own[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        self.q, self.score, self.id = q[keep], score[keep], own[keep]


def search(queries: dict, candidates: dict, k: int, least: np.ndarray) -> Best:
    """Dual-tree search; ``least`` has the score that each query's candidates must reach."""
    best = Best(len(queries["ids"]), k, least)

    def bounds(q: int, cs) -> np.ndarray:
        cs = list(cs)
        return reach(queries["centre"][q], queries["radius"][q], candidates["centre"][cs], candidates["radius"][cs])

    todo = [(bounds(0, [0])[0], 0, 0)]
    while todo:
        bound, q, c = todo.pop()
        q0, q1 = queries["range"][q]
        if bound < best.least[q0:q1].min():
            continue
        q_kids, c_kids = queries["children"][q], candidates["children"][c]
        if not q_kids and not c_kids:
            c0, c1 = candidates["range"][c]
            rows = np.arange(q0, q1)
            scores = queries["points"][q0:q1] @ candidates["points"][c0:c1].T
            ids = candidates["ids"][c0:c1]
            scores[queries["ids"][q0:q1][:, None] == ids[None, :]] = NONE
            best.offer(rows, scores, ids)
            continue
        # Split the wider node; the most promising pairs are searched first.
        if c_kids and (not q_kids or candidates["radius"][c] >= queries["radius"][q]):
            pairs = list(zip(bounds(q, c_kids), [q] * len(c_kids), c_kids))
        else:
            pairs = [(bounds(x, [c])[0], x, c) for x in q_kids]
        todo.extend(sorted(pairs))
    return best


def _trees(dim: int, pivots: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        vectors = pa.concat_arrays(table["v"].chunks)
        tree = build(matrix(vectors, dim), table["vec_id"].to_numpy())
        apart = np.linalg.norm(tree["centre"][0] - pivots[table["cell"][0].as_py()])
        return pa.table(
            {
                "cell": table["cell"][:1], "salt": table["salt"][:1], "tree": pa.array([packed(tree)], pa.binary()),
                "centre": pa.array([tree["centre"][0].tolist()]), "radius": tree["radius"][:1],
                "from_pivot": [float(apart + tree["radius"][0])],
            }
        )

    return run


def _searched(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                queries, candidates = unpacked(row["queries"]), unpacked(row["candidates"])
                least = np.full(len(queries["ids"]), NONE)
                for i, x in zip(row["known"] or (), row["least"] or ()):
                    least[queries["ids"] == i] = x
                best = search(queries, candidates, k, least)
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": queries["ids"][best.q], "vec_id": best.id, "score": best.score.astype(np.int64),
                        "q_cell": np.full(len(best.q), row["q_cell"], np.int32), "q_salt": np.full(len(best.q), row["q_salt"], np.int32),
                    }
                )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k best among all other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), scaled(F.col(vector)).alias("v"), is_query.alias("is_query"))
    rows = written(rows.where("vec_id is not null and v is not null"), "vectors")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    cells = min(PIVOTS, max(1, -(-n // BLOCK)))
    share = min(1.0, SAMPLE * cells / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * SAMPLE * PIVOTS)
    sample = np.array([r["v"] + [0] * (dim - len(r["v"])) for r in sample.collect()] or [[0] * dim], float)
    pivots = centres_of(sample, cells)

    def placed(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            cell = ((pivots**2).sum(1)[None, :] / 2 - x @ pivots.T).argmin(1)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    fields = "vec_id bigint, v array<bigint>, is_query boolean, cell int"
    rows = written(rows.mapInArrow(placed, fields).withColumn("at", F.monotonically_increasing_id()), "vector-cells")
    kinds = {"candidates": (rows, BLOCK), "queries": (rows.where("is_query").dropDuplicates(["vec_id"]), QUERY_BLOCK)}
    trees, salts = {}, {}
    for name, (some, size) in kinds.items():
        counts = {r["cell"]: r["count"] for r in some.groupBy("cell").count().collect()}  # a number per pivot
        salts[name] = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, -(-m // size))]) if counts else F.create_map(F.lit(0), F.lit(1))
        salted = some.withColumn("salt", F.pmod(F.xxhash64("at"), salts[name][F.col("cell")]).cast("int")).select("vec_id", "v", "cell", "salt")
        made = salted.groupBy("cell", "salt").applyInArrow(_trees(dim, pivots), TREES)
        trees[name] = written(made, f"{name}-trees")
    # A cell's ball holds the balls of its blocks.
    balls = {r["cell"]: r["r"] for r in trees["candidates"].groupBy("cell").agg(F.max("from_pivot").alias("r")).collect()}
    cell_ids = np.array(sorted(balls), np.int64)
    radii = np.array([balls[c] for c in cell_ids], float)

    sides = trees["queries"].select(F.col("cell").alias("q_cell"), F.col("salt").alias("q_salt"), F.col("tree").alias("queries"), "centre", "radius")
    # All joins that carry trees shuffle: Spark estimates their sides by the files read, which tells nothing
    # of the copies that routing makes, and would send them through the driver.
    whole = trees["candidates"].select("cell", "salt", F.col("tree").alias("candidates"))
    found = "query_id bigint, vec_id bigint, score bigint, q_cell int, q_salt int"
    home = sides.join(whole.where("salt = 0").hint("merge"), F.col("q_cell") == F.col("cell")).select(
        "q_cell", "q_salt", "queries", "candidates", F.lit(None).cast("array<bigint>").alias("known"), F.lit(None).cast("array<double>").alias("least")
    )
    first = written(home.mapInArrow(_searched(k), found), "home-hits")
    full = first.groupBy("q_cell", "q_salt", "query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low")).where(F.col("n") >= k)
    # As many as a query block has rows at most.
    known = full.groupBy("q_cell", "q_salt").agg(F.collect_list(F.struct("query_id", "low")).alias("x"))
    told = sides.join(known.hint("merge"), ["q_cell", "q_salt"], "left").select(
        "q_cell", "q_salt", "queries", "centre", "radius", F.col("x.query_id").alias("known"), F.col("x.low").alias("least")
    )

    def routed(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                count = len(unpacked(row["queries"])["ids"])
                worst = min(row["least"]) if row["least"] and len(row["least"]) == count else NONE
                bound = reach(np.array(row["centre"]), row["radius"], pivots[cell_ids], radii)
                out.append(cell_ids[bound >= worst].tolist())
            yield batch.append_column("cells", pa.array(out, pa.list_(pa.int32())))

    sent = told.mapInArrow(
        routed, "q_cell int, q_salt int, queries binary, centre array<double>, radius double, known array<bigint>, least array<double>, cells array<int>"
    )
    each = sent.withColumn("cell", F.explode("cells")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts["candidates"][F.col("cell")] - 1)))
    pairs = each.where("not (cell = q_cell and salt = 0)").join(whole.hint("merge"), ["cell", "salt"])
    rest = pairs.select("q_cell", "q_salt", "queries", "candidates", "known", "least").mapInArrow(_searched(k), found)
    every = first.unionByName(rest).select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
