"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Equal vectors are one node, so repeated vectors cost nothing and ties among them are exact. The graph starts from
random-projection cells: trees fitted on a bounded sample (SAMPLE nodes) deal every node into cells; a cell that is still
too large, as cells are when the table is much larger than the sample, is halved again and again by two of its own nodes
(plain aggregates and a join by cell), so cells don't grow with the table. The nodes of a cell are compared. Then
NN-descent: in each round every node's list of neighbours, in both directions, meets at that node by a join, the pairs
that stand in it are compared, and each node keeps its nearest. Rounds go on until no more than CHANGED of all links are
new. The reverse part of a list holds the REVERSE nearest, as the method has it. A query walks the graph greedily: it
keeps its EF nearest nodes so far, and each step fetches the neighbours of the nearest not yet expanded by a join, until
none is left.

Vectors that are null, zero, or hold null or non-finite components take no part. Distances are Euclidean, in double
precision, between vectors of equal length; those of another length have none and are searched among themselves. Ties go
to the smaller id. Rows that repeat an id, with the same vector or another, are rows of their own: each is a candidate of
the others, and each is answered if its id is a query's. Null ids take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import cut, forget, staged

SAMPLE, TREES, CELL, DEGREE, REVERSE, NEAR, CHANGED = 16_384, 4, 150, 32, 24, 12, 0.05
EF, EXPAND, ENTRIES = 192, 48, 256
#: Rows of a batch that tasks give back, about.
OUT_ROWS = 20_000


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, vec_id, vec, node, size) of the rows that take part; equal vectors have equal nodes."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    positive_zero = F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    rows = vectors.where(F.col(vec_id).isNotNull() & v.isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), positive_zero.alias("vec"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", F.xxhash64("vec").alias("node"), F.size("vec").alias("size"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def squared(v: np.ndarray) -> np.ndarray:
    """Squared distances between all rows, the diagonal infinite."""
    norms = (v * v).sum(1)
    d = np.maximum(norms[:, None] + norms - 2 * v @ v.T, 0)
    np.fill_diagonal(d, np.inf)
    return d


def planted(sample: np.ndarray, leaf: int, seed: int):
    """A random-projection tree: (direction, threshold, left, right), or a leaf's number."""
    rnd, leaves = np.random.default_rng(seed), iter(range(len(sample) + 1))

    def grow(rows: np.ndarray):
        if len(rows) > leaf:
            for _ in range(5):
                a, b = sample[rnd.choice(rows, 2, replace=False)]
                along = sample[rows] @ (a - b)
                middle = np.median(along)
                left = along <= middle
                if left.any() and not left.all():
                    return (a - b, middle, grow(rows[left]), grow(rows[~left]))
        return next(leaves)

    return grow(np.arange(len(sample)))


def leaf_of(tree, v: np.ndarray) -> np.ndarray:
    out, stack = np.zeros(len(v), dtype=np.int32), [(tree, np.arange(len(v)))]
    while stack:
        node, rows = stack.pop()
        if isinstance(node, tuple):
            left = v[rows] @ node[0] <= node[1]
            stack += [(node[2], rows[left]), (node[3], rows[~left])]
        else:
            out[rows] = node
    return out


def by_group(frame: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """`work` on the rows of each group (a table, in order), as sorted partitions stream by; it yields batches or None."""
    dealt = frame.repartition(*keys).sortWithinPartitions(*keys, *order)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last is not None and tuple(c[0] for c in columns) != last
            last = tuple(c[-1] for c in columns)
            edges = np.union1d(np.flatnonzero(new), [0, batch.num_rows]).tolist()
            for a, b in zip(edges, edges[1:]):
                if new[a] and held:
                    if (out := work(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := work(pa.Table.from_batches(held))) is not None:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What `worked` gives, a few groups' rows at a time: a batch for each group takes longer than its rows."""
        out: list[pa.RecordBatch] = []
        rows = 0
        for batch in worked(batches):
            if batch.num_rows:
                out.append(batch)
                rows += batch.num_rows
            if rows >= OUT_ROWS:
                yield pa.concat_batches(out)
                out, rows = [], 0
        if out:
            yield pa.concat_batches(out)

    return dealt.mapInArrow(run, schema)


PAIRS = "a long, b long, d double"


def _pairs(ids: np.ndarray, d: np.ndarray, most: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's `most` nearest; with `reach`, those of them that aren't farther than the row's own."""
    most = min(most, len(ids) - 1)
    near = np.argpartition(d, most - 1, axis=1)[:, :most]
    a, b, far = np.repeat(ids, most), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()
    if reach is None:
        return a, b, far
    ok = far <= np.repeat(reach * (1 + 1e-9) + 1e-9, most)  # sums may differ in their last bits
    return a[ok], b[ok], far[ok]


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["a", "b", "d"]) if parts else None


def split_cells(dealt: DataFrame, most: int) -> DataFrame:
    """(cell, node, vec) with cells of more than `most` nodes halved, by which of two of its nodes is nearer, until none is left."""
    while True:
        dealt = staged(dealt)
        large = dealt.groupBy("cell").count().where(f"count > {most}").select("cell")
        dice = F.xxhash64("cell", "node")
        ends = dealt.join(large, "cell").groupBy("cell").agg(F.min_by("vec", dice).alias("one"), F.max_by("vec", dice).alias("two"))
        ends = staged(ends)
        if ends.isEmpty():
            return dealt
        side = (distance("vec", "one") <= distance("vec", "two")).cast("int")
        dealt = dealt.join(ends, "cell", "left").select(F.when(F.col("one").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", side)).alias("cell"), "node", "vec")


def started(nodes: DataFrame, n_nodes: int, k: int = DEGREE, cell: int = CELL, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(a, b, d): each node's nearest within its cells, which have no more than four times `cell` nodes."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).toPandas()
    v = np.array(chosen["vec"].tolist(), dtype=np.float64)
    leaf = max(8, cell * len(v) // max(n_nodes, 1))
    held = nodes.sparkSession.sparkContext.broadcast([planted(v, leaf, 7 + t) for t in range(trees)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = matrix(batch.column("vec"))
                for t, tree in enumerate(held.value):
                    key = pa.array((leaf_of(tree, vecs).astype(np.int64) * trees) + t)
                    yield pa.RecordBatch.from_arrays([key, batch.column("node"), batch.column("vec")], ["cell", "node", "vec"])

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        return _batch([_pairs(rows.column("node").to_numpy(), squared(matrix(rows.column("vec"))), k)])

    dealt = split_cells(nodes.mapInArrow(deal, f"cell long, node long, vec {dict(nodes.dtypes)['vec']}"), 4 * cell)
    return nearest(by_group(dealt, ["cell"], ["node"], compare, PAIRS).withColumn("fresh", F.lit(True)), k)


def nearest(pairs: DataFrame, k: int = DEGREE) -> DataFrame:
    """(a, b, d, fresh): each a's k nearest of its distinct b; fresh if the pair was in no graph before."""
    once = pairs.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return once.withColumn("rank", rank).where(f"rank <= {k}").select("a", "b", "d", "fresh")


def descended(graph: DataFrame, nodes: DataFrame, k: int = DEGREE, reverse: int = REVERSE) -> DataFrame:
    """One round: nodes that share a list, and so are neighbours of neighbours, are compared where the list is. A node with
    `k` neighbours takes its farthest one's distance along: what is farther can't enter its list, and isn't shuffled."""
    farthest = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("reach"))
    known = nodes.join(farthest.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("m"), "vec", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))
    back = graph.withColumn("rank", rank).where(f"rank <= {reverse}").select(F.col("b").alias("at"), F.col("a").alias("m"))
    lists = graph.select(F.col("a").alias("at"), F.col("b").alias("m")).unionByName(back).distinct()
    lists = lists.join(known, "m")

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        return _batch([_pairs(rows.column("m").to_numpy(), squared(matrix(rows.column("vec"))), NEAR, rows.column("reach").to_numpy())])

    met = by_group(lists, ["at"], ["m"], compare, PAIRS).withColumn("fresh", F.lit(True))
    return nearest(graph.withColumn("fresh", F.lit(False)).unionByName(met), k)


def graph_of(nodes: DataFrame, changed: float = CHANGED) -> DataFrame:
    """(a, b, d, fresh): the neighbour graph of (node, vec)."""
    graph = staged(started(nodes, nodes.count()))
    while True:
        before, graph = graph, staged(descended(graph, nodes))
        forget(before)
        new, links = graph.agg(F.count_if("fresh"), F.count("*")).first()
        if new <= changed * links:
            return graph


def distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def searched(graph: DataFrame, nodes: DataFrame, queries: DataFrame, ef: int = EF, expand: int = EXPAND) -> DataFrame:
    """(query_id, node, d): each query's `ef` nearest nodes found. queries: (query_id, vec, own), own being its node or null."""
    spark = nodes.sparkSession
    entries = nodes.orderBy(F.xxhash64("node", F.lit("entry")), "node").limit(ENTRIES).toPandas()
    if entries.empty:
        return spark.createDataFrame([], "query_id long, node long, d double")
    held = spark.sparkContext.broadcast((entries["node"].to_numpy(dtype=np.int64), np.array(entries["vec"].tolist(), dtype=np.float64)))

    @F.pandas_udf("array<long>")
    def seeds(vecs: pd.Series) -> pd.Series:
        ids, v = held.value
        out = []
        for q in vecs:
            d = ((v - np.asarray(q, dtype=np.float64)) ** 2).sum(1)
            out.append(ids[np.argsort(d, kind="stable")[:ef]])
        return pd.Series(out)

    queries = cut(queries)
    vec = queries.select("query_id", F.col("vec").alias("q_vec"))

    def measured(found: DataFrame) -> DataFrame:
        return found.join(nodes, "node").join(vec, "query_id").select("query_id", "node", distance("vec", "q_vec").alias("d"))

    def best(found: DataFrame, most: int) -> DataFrame:
        """The nearest `most`; of those not expanded, the nearest `expand` are marked open."""
        once = found.groupBy("query_id", "node").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        by_query = Window.partitionBy("query_id").orderBy("d", "node")
        ranked = once.withColumn("rank", F.row_number().over(by_query)).where(f"rank <= {most}")
        order = F.sum((~F.col("done")).cast("int")).over(by_query)
        return ranked.withColumn("open", ~F.col("done") & (order <= expand)).select("query_id", "node", "d", "done", "open")

    start = queries.select("query_id", F.explode(F.array_union(seeds("vec"), F.array_compact(F.array(F.col("own"))))).alias("node")).distinct()
    beam = cut(best(measured(start).withColumn("done", F.lit(False)), ef))
    while True:
        frontier = beam.where("open").select("query_id", F.col("node").alias("a"))
        fresh = frontier.join(graph, "a").select("query_id", F.col("b").alias("node")).distinct()
        fresh = fresh.join(beam.select("query_id", "node"), ["query_id", "node"], "left_anti")
        old = beam.select("query_id", "node", "d", (F.col("done") | F.col("open")).alias("done"))
        beam = cut(best(old.unionByName(measured(fresh).withColumn("done", F.lit(False))), ef))
        if beam.where("open").isEmpty():
            return beam.select("query_id", "node", "d")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """What query op7 returns: the k nearest found of each row whose id is divisible by `every`."""
    rows = staged(valid(vectors))
    sizes = [r["size"] for r in rows.select("size").distinct().orderBy("size").collect()]  # one row a length of vector
    found = [_neighbours(rows.where(F.col("size") == n), every, k) for n in sizes or [0]]
    return reduce(DataFrame.unionByName, found)


def _neighbours(rows: DataFrame, every: int, k: int) -> DataFrame:
    nodes = staged(rows.groupBy("node").agg(F.first("vec").alias("vec")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("vec_id", "row"))
    members = staged(rows.select("node", "vec_id", "row", rank.alias("rank")).where(f"rank <= {k + 1}").select("node", "vec_id", "row"))
    asked = rows.where(f"vec_id % {every} = 0")
    queries = staged(asked.select(F.col("row").alias("query_id"), "vec", F.col("node").alias("own")))
    if queries.isEmpty():
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    found = searched(graph_of(nodes), nodes, queries)
    listed = found.join(members, "node").where("row <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id", "row"))
    ranked = listed.select("query_id", place.cast("int").alias("rank"), "vec_id", F.col("d").alias("score")).where(f"rank <= {k}")
    own = asked.select("row", F.col("vec_id").alias("own_id"))
    return ranked.join(own, F.col("query_id") == F.col("row")).select(F.col("own_id").alias("query_id"), "rank", "vec_id", "score")
