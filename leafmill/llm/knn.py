"""Most similar vectors of every vector: NN-descent on Spark joins, and greedy search in the graph it makes.

1. Vectors that are copies of each other become one node, so a group of copies of any size costs one row.
2. Random projection trees, their splits fitted on a bounded sample, put near vectors into the same leaf; the best
   neighbours in the leaves of each tree are the first graph. Every vector is indexed; depth follows the row count, with
   splits not fitted to data below the depth the sample can carry, and a leaf too large is divided before it is gathered.
3. NN-descent: neighbours of neighbours, in both directions, come from joins of the graph with itself. Nodes near each
   other share most of them, so they are tried by blocks of some thousand nodes: ids are joined first, a vector goes to a
   block once, and those of the block's own nodes never. Paths of old edges only are not tried again, and a block sends back
   only edges better than a node's worst that it has not got. It ends when few edges change.

Of the edges that point to a node, the most similar ``reverse`` ones take part in making candidates, as is usual in
NN-descent: this spares hubs. It limits what is tried in one round, not the result: a node's own edges always take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.tables import settle

#: Vectors that the trees' splits are fitted on, at most.
SAMPLE = 20_000
TREES, LEAF, ROUNDS, REVERSE = 3, 800, 4, 12
#: Rounds end when less than this share of the edges is new.
ENOUGH = 0.002
#: A leaf of more vectors is divided; a block has the nodes of so many leaves; so many candidates meet a block at once.
_MAX_LEAF, _LEAVES, _AT_ONCE = 2_000, 4, 20_000


def valid_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, vec): rows with a key and exactly ``dim`` finite components, not all zero; one for each key.

    ``vec`` has the components as float32 bytes. Null keys and null, empty, short, long, all-zero and NaN- or
    infinity-bearing vectors are left out; of several vectors under one key one is taken, always the same.
    """
    own = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)
            x = flat.reshape(-1, dim).astype("<f4") + np.float32(0)  # one zero
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in x[good]], pa.binary())], ["id", "vec"])

    return own.mapInArrow(check, "id bigint, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(vecs) -> np.ndarray:
    """Rows of unit length, float64."""
    x = np.frombuffer(b"".join(vecs), dtype="<f4").astype(np.float64)
    x = x.reshape(len(vecs), -1)
    # by the largest component first, so that no square leaves the range
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """Splits of a random projection tree in heap order, and the further splits that are not fitted."""

    normal: np.ndarray
    offset: np.ndarray
    depth: int
    extra: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, seed: int, leaf: int) -> Tree:
        rng = np.random.default_rng(seed)
        depth = max(0, math.ceil(math.log2(max(1, rows / leaf))))
        fitted = min(depth, max(0, int(math.log2(max(1, len(x) / 8)))))
        dim = x.shape[1]
        normal, offset = np.zeros(((1 << fitted) - 1, dim)), np.zeros((1 << fitted) - 1)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(fitted):
            first = (1 << level) - 1
            for n in range(first, 2 * first + 1):
                own = np.flatnonzero(node == n)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    w = x[a] - x[b]
                    normal[n] = w if (w != 0).any() else rng.normal(size=dim)
                else:
                    normal[n] = rng.normal(size=dim)
                offset[n] = np.median(x[own] @ normal[n]) if len(own) else 0
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normal[node]) > offset[node])
        return cls(normal, offset, fitted, rng.normal(size=(dim, depth - fitted)))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normal[node]) > self.offset[node])
        for w in self.extra.T:
            node = 2 * node + 1 + (x @ w > 0)
        return node


def best(own: np.ndarray, own_id: np.ndarray, other: np.ndarray, other_id: np.ndarray, k: int, have: list | None = None, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other id, cosine) of the k nearest others of each own vector; ties to the smaller id. With ``have`` and
    ``worst`` only those it has not got and that are better than its worst."""
    order = np.argsort(other_id)
    other, other_id = other[order], other_id[order]
    rows, ids, cos = [], [], []

    def leave_out(s: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(other_id, wanted), len(other_id) - 1)
        here = other_id[at] == wanted
        s[row[here], at[here]] = -2

    for i in range(0, len(own), 512):
        s = own[i : i + 512] @ other.T
        n = min(k, s.shape[1])
        leave_out(s, np.arange(len(s)), own_id[i : i + 512])
        if have is not None:
            size = [len(h) for h in have[i : i + 512]]
            leave_out(s, np.repeat(np.arange(len(s)), size), np.concatenate([np.asarray(h, dtype=np.int64) for h in have[i : i + 512]]))
        top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), s.shape)
        value = np.take_along_axis(s, top, axis=1)
        keep = value > (-1.5 if worst is None else np.maximum(worst[i : i + 512], -1.5)[:, None])
        rows.append(np.broadcast_to(np.arange(i, i + len(s))[:, None], top.shape)[keep])
        ids.append(other_id[top][keep])
        cos.append(value[keep])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(cos)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges (id, nbr, cos, fresh, block, nbr_block) of each id; an edge met twice counts as the old one. Moved once."""
    one = edges.repartition("id").groupBy("id", "nbr").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"), F.first("block").alias("block"), F.first("nbr_block").alias("nbr_block"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "nbr"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


@dataclass
class Graph:
    """nodes (id, vec, leaf0, leaf1, ...), edges (id, nbr, cos) and members (id, node): every vector and its node."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    trees: list[Tree]
    k: int
    dim: int


def neighbour_graph(vectors: DataFrame, k: int, dim: int, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, sample: int = SAMPLE, reverse: int = REVERSE, least: float = -1.0) -> Graph:
    """NN-descent graph of ``vectors``, as ``valid_vectors`` gives them; with no vectors all its tables are empty.

    ``least``: only neighbours of at least this cosine are sought beyond the first graph. By the triangle inequality the
    angle at the end of a path is at least the difference of the angles of its two edges, so a path on which that is too
    wide can't lead to one and isn't tried; nor is one of two edges that are both below ``least``.
    """
    spark = vectors.sparkSession
    held = settle(vectors)
    by_vec = held.groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    node = settle(by_vec.select("node", "vec", "n"))
    n = node.count()
    x = node.select("vec").orderBy(F.xxhash64("vec")).limit(sample).toPandas()["vec"]
    matrix = _matrix(list(x)) if len(x) else np.zeros((1, dim))
    forest = [Tree.fit(matrix, n, 17 + t, leaf) for t in range(trees)]
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(t.leaves(m)) for t in shared.value)], ["id", "vec", *(f"leaf{i}" for i in range(trees))])

    routed = node.select(F.col("node").alias("id"), "vec").mapInArrow(route, "id bigint, vec binary, " + ", ".join(f"leaf{i} bigint" for i in range(trees)))
    # blocks of nodes: neighbouring leaves of the first tree, which share their first splits, in hashed parts where large
    ancestor = F.shiftright(F.col("leaf0") + 1, int(math.log2(_LEAVES)))
    routed = settle(routed.withColumn("about", ancestor))
    size = routed.groupBy("about").agg(F.ceil(F.count("*") / F.lit(_LEAVES * _MAX_LEAF)).alias("parts"))
    nodes = settle(routed.join(size, "about").withColumn("block", F.xxhash64("about", F.pmod(F.xxhash64("id"), "parts"))).drop("about", "parts"))
    twins = node.where("n > 1").select("vec", "node")
    members = held.join(twins, "vec", "left").select("id", F.coalesce("node", "id").alias("node")) if n else held.select("id", F.col("id").alias("node"))
    edge = "id bigint, nbr bigint, cos double, block bigint, nbr_block bigint"

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        m, ids, block = _matrix(list(pdf["vec"])), pdf["id"].to_numpy(), pdf["block"].to_numpy()
        row, nbr, cos = best(m, ids, m, ids, k)
        order = np.argsort(ids)
        return pd.DataFrame({"id": ids[row], "nbr": nbr, "cos": cos, "block": block[row], "nbr_block": block[order[np.searchsorted(ids[order], nbr)]]})

    first = None
    for i in range(trees):
        leaf_size = nodes.groupBy(f"leaf{i}").agg(F.ceil(F.count("*") / F.lit(_MAX_LEAF)).alias("parts"))
        own = nodes.join(leaf_size, f"leaf{i}").select("id", "vec", "block", F.col(f"leaf{i}").alias("leaf"), F.pmod(F.xxhash64("id"), "parts").alias("part"))
        e = own.groupBy("leaf", "part").applyInPandas(inside, edge)
        first = e if first is None else first.unionByName(e)
    edges = settle(_top(first.withColumn("fresh", F.lit(1)), k))

    def meet(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        """Edges of a block's nodes to candidates, and to each other, that are better than the worst they have."""
        if not len(own):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "nbr": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64"), "block": pd.Series(dtype="int64"), "nbr_block": pd.Series(dtype="int64")})
        ids, block = own["id"].to_numpy(), own["block"].iloc[0]
        m = _matrix(list(own["vec"]))
        c, cid, cb = m, ids, np.full(len(ids), block)
        if len(other):
            c, cid, cb = np.concatenate((m, _matrix(list(other["other"])))), np.concatenate((ids, other["other_id"].to_numpy())), np.concatenate((cb, other["nbr_block"].to_numpy()))
        order = np.argsort(cid)
        c, cid, cb = c[order], cid[order], cb[order]
        row, nbr, cos = best(m, ids, c, cid, k, own["have"].tolist(), own["worst"].to_numpy())
        return pd.DataFrame({"id": ids[row], "nbr": nbr, "cos": cos, "block": block, "nbr_block": cb[np.searchsorted(cid, nbr)]})

    for _ in range(rounds if n > 1 else 0):
        back = Window.partitionBy("nbr").orderBy(F.desc("cos"), "id")
        backward = edges.withColumn("r", F.row_number().over(back)).where(F.col("r") <= reverse).select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "fresh", "cos", F.col("nbr_block").alias("block"), F.col("block").alias("nbr_block"))
        near = settle(edges.select("id", "nbr", "fresh", "cos", "block", "nbr_block").unionByName(backward).groupBy("id", "nbr").agg(F.max("fresh").alias("fresh"), F.max("cos").alias("cos"), F.first("block").alias("block"), F.first("nbr_block").alias("nbr_block")))
        angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
        step = near.groupBy("block", F.col("nbr").alias("mid")).agg(F.max("fresh").alias("f1"), F.max("cos").alias("best"), F.min("cos").alias("worst"))
        onward = near.groupBy(F.col("id").alias("mid")).agg(F.max("fresh").alias("f2"), F.collect_list(F.struct("fresh", F.col("nbr").alias("id"), "nbr_block", "cos")).alias("next"))
        # a path is worth trying if one of its edges is new; nodes of the block itself are there already
        paths = step.join(onward, "mid").where("f1 + f2 > 0")

        def try_it(x):
            wide = angle(x["cos"])
            fits = (wide >= angle(F.col("best")) - math.acos(least)) & (wide <= angle(F.col("worst")) + math.acos(least))
            return (x["nbr_block"] != F.col("block")) & (F.col("f1") + x["fresh"] > 0) & ((F.greatest(F.col("best"), x["cos"]) >= least) & fits if least > -1 else F.lit(True))

        wanted = paths.select("block", F.explode(F.filter("next", try_it)).alias("x"))
        wanted = settle(wanted.select("block", "x.id", "x.nbr_block").distinct())
        parts = wanted.groupBy("block").agg(F.ceil(F.count("*") / F.lit(_AT_ONCE)).cast("int").alias("parts"))
        others = wanted.join(parts, "block").join(nodes.select("id", F.col("vec").alias("other")), "id").select("block", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.col("id").alias("other_id"), "other", "nbr_block")
        state = edges.groupBy("id").agg(F.collect_list("nbr").alias("have"), F.greatest(F.when(F.count("*") >= k, F.min("cos")).otherwise(F.lit(-2.0)), F.lit(least - 1e-12)).alias("worst"))
        own = nodes.select("id", "vec", "block").join(state, "id").join(parts, "block", "left")
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1))).drop("parts")
        found = own.groupBy("block", "part").cogroup(others.groupBy("block", "part")).applyInPandas(meet, edge)
        edges = settle(_top(edges.withColumn("fresh", F.lit(0)).unionByName(found.withColumn("fresh", F.lit(1))), k))
        good = edges.where(F.col("cos") >= least).agg(F.count("*"), F.coalesce(F.sum("fresh"), F.lit(0))).first()
        if good[1] <= ENOUGH * good[0]:
            break
    return Graph(nodes, edges.select("id", "nbr", "cos"), members, forest, k, dim)


def neighbours(graph: Graph, k: int, least: float = -1.0) -> DataFrame:
    """(id, nbr, cos): the k most similar others of every vector, copies among them, with a cosine of at least ``least``.

    Ties go to the smaller id.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    first = graph.members.withColumn("r", rank).where(F.col("r") <= k + 1).select("node", F.col("id").alias("nbr"))
    size = graph.members.groupBy("node").agg(F.count("*").alias("n"))
    alone = size.where("n > 1").select("node", F.col("node").alias("to"), F.lit(1.0).alias("cos"))
    lists = graph.edges.select(F.col("id").alias("node"), F.col("nbr").alias("to"), "cos").where(F.col("cos") >= least).unionByName(alone)
    to = lists.join(first.withColumnRenamed("node", "to"), "to").select("node", "nbr", "cos")
    # at most k + 1 for a node, as one of them may be the vector itself
    order = Window.partitionBy("node").orderBy(F.desc("cos"), "nbr")
    to = to.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    own = graph.members.join(to, "node").where("id <> nbr").select("id", "nbr", "cos")
    return own.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "nbr"))).where(F.col("r") <= k).drop("r")


def search(graph: Graph, queries: DataFrame, k: int, beam: int = 32, rounds: int = 8, entries: int = 40) -> DataFrame:
    """(query, nbr, cos, rank): greedy search of the graph for each of ``queries`` (id, vec), other than itself.

    A query starts at ``entries`` nodes of its leaf in each tree, as groups of near vectors may have no edges to others; each
    round looks at the neighbours of its best ``beam``
    nodes that it has not followed yet, until none is left or after ``rounds``.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(graph.trees)
    trees = len(graph.trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(np.stack([t.leaves(m) for t in shared.value], axis=1)), pa.list_(pa.int64()))], ["query", "qvec", "leaves"])

    asked = settle(queries.select("id", "vec").mapInArrow(route, "query bigint, qvec binary, leaves array<bigint>"))

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column(1).to_pylist()), _matrix(batch.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.einsum("ij,ij->i", a, b))], ["query", "node", "cos"])

    def score(pairs: DataFrame) -> DataFrame:
        full = pairs.join(asked.select("query", "qvec"), "query").join(graph.nodes.select(F.col("id").alias("node"), "vec"), "node")
        return full.select("query", "qvec", "node", "vec").mapInArrow(cosine, "query bigint, node bigint, cos double")

    starts = None
    for i in range(trees):
        rank = F.row_number().over(Window.partitionBy(f"leaf{i}").orderBy(F.xxhash64("id")))
        e = graph.nodes.select("id", f"leaf{i}").withColumn("r", rank).where(F.col("r") <= entries).select(F.col("id").alias("node"), F.col(f"leaf{i}").alias("leaf"))
        e = asked.select("query", F.get("leaves", F.lit(i)).alias("leaf")).join(e, "leaf").select("query", "node")
        starts = e if starts is None else starts.unionByName(e)
    seen = settle(score(starts.distinct()).withColumn("done", F.lit(False)))
    order = Window.partitionBy("query").orderBy(F.desc("cos"), "node")
    for _ in range(rounds):
        ranked = seen.withColumn("r", F.row_number().over(order))
        follow = ranked.where((F.col("r") <= beam) & ~F.col("done")).select("query", "node")
        onward = follow.join(graph.edges.select(F.col("id").alias("node"), "nbr"), "node").select("query", F.col("nbr").alias("node")).distinct()
        new = score(onward.join(seen.select("query", "node"), ["query", "node"], "left_anti")).withColumn("done", F.lit(False))
        old = ranked.select("query", "node", "cos", (F.col("done") | (F.col("r") <= beam)).alias("done"))
        seen = settle(old.unionByName(new))
        if not seen.where(~F.col("done")).limit(1).count():
            break
    top = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    first = graph.members.withColumn("m", rank).where(F.col("m") <= k + 1).select("node", F.col("id").alias("nbr"))
    out = top.join(first, "node").where("query <> nbr").select("query", "nbr", "cos")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "nbr"))).where(F.col("rank") <= k)
