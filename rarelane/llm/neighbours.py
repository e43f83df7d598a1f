"""Approximate nearest neighbours by a graph that is built and searched with Spark joins.

Equal vectors are one node, named by their smallest id, so a vector that many rows
share is one place in the graph; a node remembers its ``NEAREST + 1`` smallest ids,
which are all that an answer can name.

Graph (NN-descent): two random orders give each node a first list, the best of a run
of nodes.  Then rounds of joins: the neighbours of a node, in both directions, meet,
and each pair of them that beats the worst of either list is proposed to it.  Long
meetings are held in lots, in which every neighbour takes part.

Search (greedy): a query starts from its node's list and opens all nodes of its pool
that are not open yet; their neighbours come in by a join, those better than the
pool's worst join it, until nothing is left to open.  Walks compare 8-bit codes of
directions and lengths; the pool's best are measured again on the original vectors.

Vectors that are null, empty, zero, of another length than the longest, or that hold
a null or a number that is not finite, take no part; nor do rows without an id.  Of
several vectors of one id the smallest counts.  With fewer candidates than asked for
all are returned.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rarelane.session import stage_table

#: Answers for a query, list length of a node, pool of a query, pool's best that are measured again.
NEAREST, LIST, POOL, AGAIN = 20, 32, 224, 64
#: First orders, nodes of a run, rounds of joins, nodes that meet at once.
ORDERS, RUN, ROUNDS, MEET = 2, 512, 3, 256
#: Queries searched together: what a block of them sends to all tasks is bounded.
BLOCK = 50_000
#: Rows that a task handles at once.
ROWS = 200_000

NODE = "node long, code binary, scale float, norm float"
LISTS = "node long, near array<long>, sims array<float>"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (array of double), one row an id."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    sound = F.expr(
        "vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0"
        " AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"
        " AND exists(vector, x -> x <> 0)"
    )
    rows = rows.where(sound)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    return rows.where(F.size("vector") == F.lit(longest or 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from zero, and the values of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directions as signed bytes and one scale, and lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, values = _lists(batch.column("vector"))
        x = values.reshape(batch.num_rows, -1)
        top = np.abs(x).max(axis=1)  # keeps very long and very short vectors in range
        norm = np.linalg.norm(x / top[:, None], axis=1)
        way = x / top[:, None] / norm[:, None]
        scale = np.abs(way).max(axis=1) / 127
        code = np.rint(way / scale[:, None]).astype(np.int8)
        yield pa.RecordBatch.from_pydict({
            "node": batch.column("node"), "code": pa.array([c.tobytes() for c in code], pa.binary()),
            "scale": pa.array(scale, pa.float32()), "norm": pa.array(norm * top, pa.float32()),
        })


def _whole_groups(
    batches: Iterator[pa.RecordBatch], by: str, rows: int = ROWS
) -> Iterator[pa.Table]:
    """Batches joined so that no run of equal ``by`` is torn, about ``rows`` rows each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        all_rows = pa.Table.from_batches(held).combine_chunks()
        keys = all_rows.column(by).to_numpy()
        turn = np.flatnonzero(keys[1:] != keys[:-1])
        if len(turn):
            end = int(turn[-1]) + 1
            yield all_rows.slice(0, end)
            held = all_rows.slice(end).combine_chunks().to_batches()
            size = all_rows.num_rows - end
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(u, w, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "u": pa.array(u, pa.int64()), "w": pa.array(w, pa.int64()), "sim": pa.array(sim, pa.float32())
    })


EDGES = "u long, w long, sim float"


def first_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of each node within its run of the order."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run(rows: pa.Table) -> pa.RecordBatch:
        nodes = rows.column("node").to_numpy()
        x = _matrix(rows.column("code"), "i1").astype(np.float32) * rows.column("scale").to_numpy()[:, None]
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        count = min(LIST, len(nodes) - 1)
        best = np.argpartition(-sims, count - 1, axis=1)[:, :count]
        return _edges(
            np.repeat(nodes, count), nodes[best].ravel(), np.take_along_axis(sims, best, axis=1).ravel()
        )

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        while size >= 2 * RUN:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield run(rows.slice(0, RUN).combine_chunks())
            held, size = rows.slice(RUN).combine_chunks().to_batches(), size - RUN
    if size > 1:
        yield run(pa.Table.from_batches(held).combine_chunks())


def keep_best(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[tuple]:
    """(u, w, sim, ends) of the best distinct partners of each u, of rows ordered by u."""
    for rows in _whole_groups(batches, "u"):
        u, w, sim = (rows.column(c).to_numpy() for c in ("u", "w", "sim"))
        order = np.lexsort((-sim, w, u))
        u, w, sim = u[order], w[order], sim[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        u, w, sim = u[new], w[new], sim[new]
        order = np.lexsort((w, -sim, u))
        u, w, sim = u[order], w[order], sim[order]
        begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        rank = np.arange(len(u)) - np.repeat(begin, np.diff(np.append(begin, len(u))))
        kept = rank < count
        yield u[kept], w[kept], sim[kept]


def as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, w, sim in keep_best(batches, LIST):
        begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        offsets = pa.array(np.append(begin, len(u)), pa.int32())
        yield pa.RecordBatch.from_pydict({
            "node": pa.array(u[begin], pa.int64()),
            "near": pa.ListArray.from_arrays(offsets, pa.array(w, pa.int64())),
            "sims": pa.ListArray.from_arrays(offsets, pa.array(sim, pa.float32())),
        })


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of one node that beat the worst of either's list."""
    for rows in _whole_groups(batches, "u"):
        u, w = rows.column("u").to_numpy(), rows.column("w").to_numpy()
        x = _matrix(rows.column("code"), "i1").astype(np.float32) * rows.column("scale").to_numpy()[:, None]
        worst = rows.column("worst").to_numpy()
        marks = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]]))
        found = []
        for begin, end in zip(marks[:-1].tolist(), marks[1:].tolist()):
            for at in range(begin, end, MEET):
                own = slice(at, min(end, at + MEET))
                sims = x[own] @ x[own].T
                i, j = np.nonzero(sims > worst[own][:, None])
                ids = w[own]
                apart = ids[i] != ids[j]
                i, j = i[apart], j[apart]
                found.append((ids[i], ids[j], sims[i, j]))
        a, b, s = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
        yield _edges(a[new], b[new], s[new])


def _to_lists(edges: DataFrame) -> DataFrame:
    return stage_table(
        edges.repartition("u").sortWithinPartitions("u").mapInArrow(as_lists, LISTS), "lists"
    )


def build_graph(nodes: DataFrame, length: int) -> DataFrame:
    """``node, near, sims`` of ``nodes`` (NODE), for vectors of ``length`` components."""
    ways = np.random.default_rng(11).standard_normal((ORDERS, 17, length)).astype(np.float32)
    found = None
    for order in range(ORDERS):

        def place(batches: Iterator[pa.RecordBatch], way=ways[order]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("code"), "i1").astype(np.float32) @ way.T
                    x *= batch.column("scale").to_numpy()[:, None]
                    cell = ((x[:, :16] > 0) << np.arange(16)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in ("node", "code", "scale")),
                         pa.array(cell, pa.int32()), pa.array(x[:, 16], pa.float32())],
                        ["node", "code", "scale", "cell", "at"],
                    )

        placed = nodes.mapInArrow(place, "node long, code binary, scale float, cell int, at float")
        runs = placed.repartitionByRange("cell", "at", "node").sortWithinPartitions("cell", "at", "node")
        edges = runs.mapInArrow(first_lists, EDGES)
        found = edges if found is None else found.union(edges)
    lists = _to_lists(found)
    codes = nodes.select("node", "code", "scale")
    for _ in range(ROUNDS):
        worst = F.when(F.size("near") >= LIST, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float")
        known = stage_table(lists.join(codes, "node").select("node", "near", "sims", worst.alias("worst"), "code", "scale"), "known")
        behind = known.select(F.explode("near").alias("u"), F.col("node").alias("w"), "code", "scale", "worst")
        ahead = known.select(F.col("node").alias("u"), F.explode("near").alias("w")).join(
            known.select(F.col("node").alias("w"), "code", "scale", "worst"), "w"
        ).select("u", "w", "code", "scale", "worst")
        proposed = behind.union(ahead).repartition("u").sortWithinPartitions("u").mapInArrow(meet, EDGES)
        present = known.select(F.col("node").alias("u"), F.explode(F.arrays_zip("near", "sims")).alias("e")).select(
            "u", F.col("e.near").alias("w"), F.col("e.sims").alias("sim")
        )
        lists = _to_lists(present.union(proposed))
    return lists


def search_graph(lists: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """``u, w, sim``: the pool of each start node ``u`` (column ``node`` of ``starts``)."""
    spark = lists.sparkSession
    blocks = -(-starts.count() // BLOCK)
    found = None
    for block in range(blocks):
        own = starts.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block) if blocks > 1 else starts
        heads = own.join(nodes, "node").orderBy("node").toArrow()  # a block's codes, a bounded list
        pool = _search_block(lists, nodes, heads, spark)
        found = pool if found is None else found.union(pool)
    return spark.createDataFrame([], EDGES) if found is None else found


def _search_block(lists: DataFrame, nodes: DataFrame, heads: pa.Table, spark) -> DataFrame:
    heads = heads.combine_chunks()
    ids = heads.column("node").to_numpy()
    x = _matrix(heads.column("code"), "i1")
    scale = heads.column("scale").to_numpy()
    order = spark.createDataFrame(pa.table({"u": pa.array(ids), "query": pa.array(np.arange(len(ids)), pa.int32())}))
    sent = spark.sparkContext.broadcast((ids, x, scale))
    norms = nodes.select(F.col("node").alias("w"), F.col("norm"))
    start = lists.withColumnRenamed("node", "u").join(order, "u").select(
        "u", F.explode(F.arrays_zip("near", "sims")).alias("e")
    ).select("u", F.col("e.near").alias("w"), F.col("e.sims").alias("sim"))
    # lists hold cosines; the pool is ordered by cosine times the partner's length
    start = start.join(norms, "w").select("u", "w", (F.col("sim") * F.col("norm")).cast("float").alias("sim"))
    pool = stage_table(start.withColumn("open", F.lit(False)), "pool")
    while True:
        shut = pool.where("NOT open")
        if shut.isEmpty():
            return pool.select("u", "w", "sim")
        worst = np.full(len(ids), -np.inf, np.float32)
        bounds = pool.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("worst")).where(F.col("n") >= POOL)
        bounds = bounds.select("u", "worst").toArrow()  # one number a query of the block
        worst[np.searchsorted(ids, bounds.column("u").to_numpy())] = bounds.column("worst").to_numpy()
        limits = spark.sparkContext.broadcast(worst)

        def measure(batches: Iterator[pa.RecordBatch], limits=limits) -> Iterator[pa.RecordBatch]:
            ids, x, scale = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                offsets, query = _lists(batch.column("queries"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                code, own = _matrix(batch.column("code"), "i1"), batch.column("scale").to_numpy() * batch.column("norm").to_numpy()
                node = batch.column("w").to_numpy()
                for at in range(0, len(row), ROWS):
                    q, r = query[at : at + ROWS], row[at : at + ROWS]
                    sims = np.einsum("ij,ij->i", x[q].astype(np.float32), code[r].astype(np.float32))
                    sims *= scale[q] * own[r]
                    good = (sims > limits.value[q]) & (ids[q] != node[r])
                    yield _edges(ids[q[good]], node[r[good]], sims[good])

        reached = shut.join(order, "u").select("query", F.col("w").alias("node")).join(
            lists.select("node", "near"), "node"
        ).select("query", F.explode("near").alias("w"))
        # a node's askers come together in lots of bounded size
        asked = reached.groupBy("w", F.pmod("query", F.lit(256)).alias("lot")).agg(F.collect_set("query").alias("queries"))
        new = asked.join(nodes.withColumnRenamed("node", "w"), "w").select("w", "queries", "code", "scale", "norm")
        new = new.mapInArrow(measure, EDGES)
        opened = pool.select("u", "w", "sim", F.lit(True).alias("open"))
        merged = opened.union(new.withColumn("open", F.lit(False)))
        pool = stage_table(
            merged.repartition("u").sortWithinPartitions("u").mapInArrow(best_of_pool, EDGES + ", open boolean"), "pool"
        )


def best_of_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best distinct partners of each query; one that is open stays open."""
    for rows in _whole_groups(batches, "u"):
        u, w, sim, shut = (
            rows.column("u").to_numpy(), rows.column("w").to_numpy(), rows.column("sim").to_numpy(),
            ~rows.column("open").to_numpy(),
        )
        order = np.lexsort((shut, w, u))
        u, w, sim, shut = u[order], w[order], sim[order], shut[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        u, w, sim, shut = u[new], w[new], sim[new], shut[new]
        order = np.lexsort((w, -sim, u))
        u, w, sim, shut = u[order], w[order], sim[order], shut[order]
        begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        rank = np.arange(len(u)) - np.repeat(begin, np.diff(np.append(begin, len(u))))
        kept = rank < POOL
        batch = _edges(u[kept], w[kept], sim[kept])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~shut[kept])], [*batch.schema.names, "open"])


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's nearest by inner product, best first.

    ``queries``: condition on ``vec_id`` that names the query rows.
    """
    spark = vectors.sparkSession
    rows = stage_table(usable(vectors), "vectors")
    classes = stage_table(rows.groupBy("vector").agg(F.min("vec_id").alias("node")), "classes")
    length = classes.select(F.max(F.size("vector"))).first()[0]
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nodes = stage_table(classes.mapInArrow(encode, NODE), "nodes")
    named = stage_table(rows.join(classes, "vector").select("node", "vec_id"), "named")
    first_ids = Window.partitionBy("node").orderBy("vec_id")
    members = stage_table(
        named.withColumn("place", F.row_number().over(first_ids)).where(F.col("place") <= NEAREST + 1)
        .groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "members",
    )
    asked = named.where(queries)
    starts = stage_table(asked.select("node").distinct(), "starts")
    pool = search_graph(build_graph(nodes, length), nodes, starts)
    # a query's own class is a candidate too, for its other rows
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "w")
    close = pool.withColumn("place", F.row_number().over(best)).where(F.col("place") <= AGAIN).select("u", "w")
    close = stage_table(close.union(starts.select(F.col("node"), F.col("node"))), "close")
    exact = close.join(classes.select(F.col("node").alias("w"), F.col("vector").alias("there")), "w").join(
        classes.select(F.col("node").alias("u"), F.col("vector").alias("here")), "u"
    )
    exact = exact.mapInArrow(_products, "u long, w long, score double")
    answers = exact.join(members.withColumnRenamed("node", "w"), "w").groupBy("u").agg(
        F.sort_array(F.flatten(F.collect_list(
            F.transform("ids", lambda i: F.struct((-F.col("score")).alias("down"), i.alias("vec_id")))
        ))).alias("best")
    )
    answers = stage_table(answers.select("u", F.slice("best", 1, NEAREST + 1).alias("best")), "answers")
    own = F.filter("best", lambda b: b["vec_id"] != F.col("query_id"))
    return asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("u")).join(answers, "u").select(
        "query_id", F.posexplode(F.slice(own, 1, NEAREST)).alias("at", "b")
    ).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.down")).alias("score"),
    )


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            here, there = (_lists(batch.column(c))[1].reshape(batch.num_rows, -1) for c in ("here", "there"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("w"), pa.array(np.einsum("ij,ij->i", here, there))],
                ["u", "w", "score"],
            )
