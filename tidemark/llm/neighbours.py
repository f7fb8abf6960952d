"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one node. The graph starts from nodes that lie close in a few random orders (sorted by the signs of random
projections, all pairs of some thousand consecutive ones). Each round then joins every node's neighbours with each other, and with
DEGREE of those nodes that have it as a neighbour, drawn anew in each round: neighbours of neighbours that beat a node's worst
neighbour take its place. Rounds go on until they change little. A walk has one row per query, and goes to rows that hold a node's
neighbours with their codes, so only better nodes come back. A sample of the queries is also compared with all vectors, and the
walk is widened until it finds RECALL of what they should find; once it is as wide as the table it is the exact search. Vectors
travel as 8-bit codes; what the search finds is ranked by exact products of the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, count
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, small_side, stored

#: Orders, nodes of a chunk, and those of its nodes whose products a task holds at a time.
ORDERS, CHUNK, ROWS = 8, 2048, 512
#: Neighbours of a node in the graph, and the share of new ones at which the rounds end.
DEGREE, FEW_NEW = 32, 0.01
#: Offers that a task holds to merge them, before it hands them on.
MERGED = 2_000_000
#: Candidates that a query keeps at first, and nodes that it visits in a step then.
KEPT, VISITED = 100, 32
#: Queries whose true neighbours are looked up, and the share of these that the walk has to find.
MEASURED, RECALL = 200, 0.95


def usable(column: str) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.isNotNull() & ~bad & F.exists(x, lambda c: c != 0)


def _counted(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """The stored rows and how many of them `what` holds for, counted as they are written."""
    seen = Observation()
    table = stored(df.observe(seen, F.count_if(what).alias("n")))
    return table, seen.get["n"]


def _codes(rows: DataFrame) -> DataFrame:
    """(v, code): a 32-bit scale and the components as 8-bit multiples of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                x = np.array(x, np.float32)
                scale = np.float32(np.abs(x).max() / 127)
                out.append(scale.tobytes() + np.rint(x / scale).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["v", "code"])

    return rows.select("v", "x").mapInArrow(run, "v long, code binary")


def _flat(codes: pa.Array) -> np.ndarray:
    """The bytes of codes, a row each."""
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    return np.frombuffer(codes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(codes), -1)


def _matrix(codes: pa.Array | np.ndarray | list[bytes]) -> np.ndarray:
    if isinstance(codes, list):
        codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    rows = _flat(codes) if isinstance(codes, pa.Array) else codes
    scale = np.ascontiguousarray(rows[:, :4]).view(np.float32)
    return rows[:, 4:].view(np.int8).astype(np.float32) * scale


def _edges(v, u, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(s, pa.float32())], names=["v", "u", "s"])


def _best(edges: DataFrame, degree: int, partitions: int) -> DataFrame:
    """The best `degree` different edges (v, u, s, fresh) of each node; an edge that is there as an old one is not fresh."""
    line = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    edges = edges.repartition(partitions, "v").groupBy("v", "u").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return edges.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= degree).drop("place")


def _groups(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The arrays of each run of rows that are equal in the first one."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = arrays(batch)
            held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
        elif held is None:
            return
        ends = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
        if batch is None:
            ends = np.append(ends, len(held[0]))
        start = 0
        for end in ends:
            yield [column[start:end] for column in held]
            start = end
        held = [column[start:].copy() for column in held]


def _chunks(nodes: DataFrame, n: int) -> DataFrame:
    """(chunk, v, code): each node once for each order, in chunks of CHUNK nodes or somewhat more that follow each other there.

    Nodes of a leaf are put in the leaf's places by a hash. So chunks depend on no number of partitions, and no leaf is sorted in one task.
    """
    bits, chunks = max(1, min(24, round(log2(max(2, n / 64))))), max(1, n // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            planes = [np.random.default_rng(seed).standard_normal((x.shape[1], bits)) for seed in range(ORDERS)]
            leaves = np.stack([((x @ p) > 0) @ (1 << np.arange(bits)) for p in planes], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int64()))], names=["v", "code", "leaves"])

    rows = nodes.select("v", "code").mapInArrow(run, "v long, code binary, leaves array<long>")
    rows = rows.select("v", "code", F.posexplode("leaves").alias("seed", "leaf"))
    before = Window.partitionBy("seed").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("seed", "leaf").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    drawn = F.pmod(F.xxhash64("v", "seed"), F.lit(1 << 32)) / float(1 << 32)
    place = F.col("before") + drawn * F.col("size")
    rows = rows.join(small_side(sizes, ORDERS << bits), ["seed", "leaf"])
    return rows.select((F.col("seed") * chunks + F.floor(place / n * chunks)).alias("chunk"), "v", "code")


def _first_edges(nodes: DataFrame, n: int, partitions: int) -> DataFrame:
    """Neighbours within chunks of some random orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v, codes in _groups(batches, lambda b: [b.column(0).to_numpy(), b.column(1).to_numpy(), _flat(b.column(2))]):
            if len(v) > 1:
                x, k = _matrix(codes), min(DEGREE, len(v) - 1)
                for start in range(0, len(v), ROWS):
                    own = np.arange(start, min(start + ROWS, len(v)))
                    s = x[own] @ x.T
                    s[own - start, own] = -np.inf
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    yield _edges(np.repeat(v[own], k), v[best].ravel(), np.take_along_axis(s, best, 1).ravel())

    dealt = _chunks(nodes, n).repartition(ORDERS * max(1, min(partitions, n // CHUNK)), "chunk").sortWithinPartitions("chunk", "v")
    edges = dealt.mapInArrow(run, "v long, u long, s float")
    return _best(edges.withColumn("fresh", F.lit(True)), DEGREE, partitions)


def _merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of offers (v, u, s) the best DEGREE different ones of each v; no node keeps more."""
    v, u, s = map(np.concatenate, zip(*found))
    if not len(v):
        return v, u, s
    line = np.lexsort((-s, u, v))
    v, u, s = v[line], u[line], s[line]
    new = np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]))
    v, u, s = v[new], u[new], s[new]
    line = np.lexsort((u, -s, v))
    v, u, s = v[line], u[line], s[line]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    place = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
    return v[place < DEGREE], u[place < DEGREE], s[place < DEGREE]


def _joined_neighbours(graph: DataFrame, nodes: DataFrame, partitions: int, turn: int = 0) -> DataFrame:
    """Offers (v, u, s) among the neighbours of each node that beat v's worst edge, without edges that v has.

    With a node's neighbours go DEGREE of the nodes that have it as a neighbour, fresh ones first, others drawn by turn.
    A node brings hashes of its edges, else a group of near copies would offer all its pairs again; turn salts them, so that two ids
    that are taken for one are so in one round only.
    """
    mark = F.hash("u", F.lit(turn))
    worst = graph.groupBy("v").agg(F.min("s").alias("worst"), F.count("*").alias("n"), F.collect_list(mark).alias("known"))
    worst = worst.select(
        "v", F.when(F.col("n") < DEGREE, F.lit(float("-inf"))).otherwise(F.col("worst")).alias("worst"), F.slice("known", 1, DEGREE).alias("known")
    )
    members = nodes.join(worst, "v", "left").select(
        F.col("v").alias("member"), "code", F.coalesce("worst", F.lit(float("-inf"))).cast("float").alias("worst"),
        F.hash("v", F.lit(turn)).alias("mark"), F.coalesce("known", F.array().cast("array<int>")).alias("known"),
    )
    drawn = Window.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("v", F.lit(turn)), "v")
    back = graph.withColumn("place", F.row_number().over(drawn)).filter(F.col("place") <= DEGREE + 1)
    back = back.withColumn("more", F.max("place").over(Window.partitionBy("u")) > DEGREE).filter(F.col("place") <= DEGREE)
    # where nodes are drawn, two old ones need not have met
    both = graph.select(F.col("v").alias("centre"), F.col("u").alias("member"), "fresh").unionByName(
        back.select(F.col("u").alias("centre"), F.col("v").alias("member"), (F.col("fresh") | F.col("more")).alias("fresh"))
    )
    rows = both.join(members.hint("shuffle_hash"), "member").select("centre", "member", "fresh", "worst", "mark", "code", "known")

    def offers(member, fresh, worst, mark, codes, known):
        line = np.lexsort((~fresh, member))
        line = line[np.append(True, member[line][1:] != member[line][:-1])]
        member, fresh, worst, mark, x, known = member[line], fresh[line], worst[line], mark[line], _matrix(codes[line]), known[line]
        s = x @ x.T
        if not fresh.all():
            s[~(fresh[:, None] | fresh[None, :])] = -np.inf  # two old neighbours met before
        np.fill_diagonal(s, -np.inf)
        row, col = np.nonzero(s > worst[:, None])
        new = ~(known[row] == mark[col][:, None]).any(axis=1)
        row, col = row[new], col[new]
        return member[row], member[col], s[row, col]

    def padded(lists: pa.ListArray) -> np.ndarray:
        n = lists.value_lengths().to_numpy()
        out = np.zeros((len(n), DEGREE), np.int32)
        out[np.arange(DEGREE) < n[:, None]] = lists.flatten().to_numpy()
        return out

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)] + [_flat(batch.column(5)), padded(batch.column(6))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, merged = [], 0, 0
        for group in _groups(batches, arrays):
            if len(group[0]) > 1 and group[2].any():
                found.append(offers(*group[1:]))
                size += len(found[-1][0])
            if size > merged + MERGED // 2:
                found = [_merged(found)]
                size = merged = len(found[0][0])
                if size > MERGED:
                    yield _edges(*found[0])
                    found, size, merged = [], 0, 0
        if found:
            yield _edges(*_merged(found))

    dealt = rows.repartition(partitions, "centre").sortWithinPartitions("centre")
    return dealt.mapInArrow(run, "v long, u long, s float")


def neighbour_graph(nodes: DataFrame, n: int, partitions: int) -> DataFrame:
    """(v, u, s): about the DEGREE nearest nodes of each of the n nodes (v, code)."""
    graph = stored(_first_edges(nodes, n, partitions))
    for turn in count():
        new = _joined_neighbours(graph, nodes, partitions, turn).withColumn("fresh", F.lit(True))
        old = graph
        graph, fresh = _counted(_best(graph.withColumn("fresh", F.lit(False)).unionByName(new), DEGREE, partitions), F.col("fresh"))
        dropped(old)
        if fresh <= FEW_NEW * n * DEGREE:  # edges only get better, so this comes
            return graph.select("v", "u", "s")


def _scored(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """(q, v, s) of pairs (q, v): x has (q, code), y has (v, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float32())], names=["q", "v", "s"])

    rows = pairs.join(x.withColumnRenamed("code", "cx"), "q").join(y.withColumnRenamed("code", "cy"), "v")
    return rows.select("q", "v", "cx", "cy").mapInArrow(run, "q long, v long, s float")


def _ways(graph: DataFrame, nodes: DataFrame, kept: int) -> DataFrame:
    """(v, to, codes): the ends of each node's edges, and of the ways back along edges, which become more with `kept`."""
    back = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    reverse = graph.withColumn("place", F.row_number().over(back)).filter(F.col("place") <= DEGREE * max(1, kept // KEPT))
    edges = graph.select("v", F.col("u").alias("to")).unionByName(reverse.select(F.col("u").alias("v"), F.col("v").alias("to"))).distinct()
    ends = nodes.select(F.col("v").alias("to"), F.col("code").alias("codes"))
    ends = edges.join(ends.hint("shuffle_hash"), "to")
    return stored(ends.groupBy("v").agg(F.collect_list("to").alias("to"), F.collect_list("codes").alias("codes")))


def search(queries: DataFrame, starts: DataFrame, ways: DataFrame, kept: int = KEPT) -> DataFrame:
    """(q, v, s): the `kept` best nodes that a greedy walk from the starts (q, v, s) finds for each query (q, code).

    Each step visits the best nodes of a query that it has not visited, and looks at their neighbours; a query is done when its
    `kept` best are all visited. Nodes visited in a step become more with `kept`.
    """
    visited = VISITED * max(1, kept // KEPT)

    def better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, code, worst, to, codes = batch.columns
                n = to.value_lengths().to_numpy()
                s = np.einsum("ij,ij->i", _matrix(codes.flatten()), np.repeat(_matrix(code), n, axis=0))
                good = s > np.repeat(worst.to_numpy(), n)
                columns = np.repeat(q.to_numpy(), n)[good], to.flatten().to_numpy()[good], s[good]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "v", "s"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(i) for i in range(2, 7)]
            for i in range(batch.num_rows):
                ids, s, done, v, t = (c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.empty(0) for c in columns)
                ids, s = np.append(ids, v.astype(np.int64)), np.append(s, t.astype(np.float32))
                done = np.append(done, np.zeros(len(v), bool)).astype(bool)
                line = np.lexsort((~done, ids))  # of equal ids that which is visited
                line = line[np.append(True, ids[line][1:] != ids[line][:-1])]
                line = line[np.lexsort((ids[line], -s[line]))][:kept]
                ids, s, done = ids[line], s[line], done[line]
                ahead = np.flatnonzero(~done)[:visited]
                going = ids[ahead]
                done[ahead] = True
                out.append((ids, s, done, going, s[-1] if len(s) >= kept else np.float32(-np.inf)))
            if out:
                kinds = pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.float32()
                arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["q", "code", "ids", "s", "done", "going", "worst"])

    kind = "q long, code binary, ids array<long>, s array<float>, done array<boolean>, going array<long>, worst float"

    def stepped(pool: DataFrame, met: DataFrame) -> tuple[DataFrame, int]:
        met = met.groupBy("q").agg(F.collect_list("v").alias("to"), F.collect_list(F.col("s").cast("float")).alias("t"))
        after = pool.select("q", "code", "ids", "s", "done").join(met, "q", "left").mapInArrow(merged, kind)
        return _counted(after, F.size("going") > 0)

    empty = (F.array().cast(f"array<{t}>").alias(c) for c, t in (("ids", "long"), ("s", "float"), ("done", "boolean")))
    pool, walking = stepped(queries.select("q", "code", *empty), starts)
    while walking:
        visits = pool.select("q", "code", "worst", F.explode("going").alias("v"))
        met = small_side(visits, walking * visited).join(ways, "v").select("q", "code", "worst", "to", "codes").mapInArrow(better, "q long, v long, s float")
        old = pool
        pool, walking = stepped(pool, met)
        dropped(old)
    return pool.select("q", F.explode(F.arrays_zip(F.col("ids").alias("v"), "s")).alias("end")).select("q", "end.v", "end.s")


def true_nearest(sample: list[tuple[int, list[float]]], classes: DataFrame, k: int) -> DataFrame:
    """(q, v): the k nodes of classes (v, x) with the largest products for each of a few queries (q, x). Reads every node."""
    q, y = np.array([i for i, _ in sample]), np.array([x for _, x in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = y @ np.array(batch.column(1).to_pylist()).T
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                v = batch.column(0).to_numpy()[best]
                columns = np.repeat(q, best.shape[1]), v.ravel(), np.take_along_axis(s, best, 1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "v", "s"])

    line = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    found = classes.select("v", "x").mapInArrow(run, "q long, v long, s double").withColumn("place", F.row_number().over(line))
    return found.filter(F.col("place") <= k).select("q", "v")


def _starts(queries: DataFrame, graph: DataFrame) -> DataFrame:
    """(q, v, s): each query (q, code) itself and its neighbours in the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                s = np.einsum("ij,ij->i", x, x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array(s, pa.float32())], names=["q", "v", "s"])

    own = queries.select("q", "code").mapInArrow(run, "q long, v long, s float")
    near = graph.select(F.col("v").alias("q"), F.col("u").alias("v"), F.col("s").cast("float").alias("s"))
    return own.unionByName(near.join(queries.select("q"), "q"))


def searched(queries: DataFrame, graph: DataFrame, nodes: DataFrame, n: int, truth: DataFrame) -> DataFrame:
    """(q, v, s) for queries (q, code): walks of twice the width each until they find RECALL of truth, or all n nodes.

    The width is sought with the queries of truth alone, from their starts each time; then the others walk so wide.
    """
    kept = KEPT
    if kept < n:
        measured = truth.select("q").distinct().withColumn("measured", F.lit(True))
        asked = stored(queries.select("q", "code").join(measured, "q", "left"))
        sample, others = asked.filter("measured").drop("measured"), asked.filter("measured is null").drop("measured")
        due = truth.count()
    while kept < n:
        ways = _ways(graph, nodes, kept)
        found = search(sample, _starts(sample, graph), ways, kept)
        if truth.join(found, ["q", "v"], "left_semi").count() >= RECALL * due:
            found = found.unionByName(search(others, _starts(others, graph), ways, kept))
            dropped(ways)
            return found
        dropped(ways)
        kept *= 2
    return _scored(queries.select("q").crossJoin(nodes.select("v")), queries, nodes)


def nearest(vectors: DataFrame, one_in: int = 20, k: int = 20, n_partitions: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found nearest rows of each row whose vec_id is divisible by one_in, by exact inner
    product of the vectors, ties to the smaller vec_id; the query's own id is left out.

    vectors needs vec_id and embedding (numbers, all of one length); other columns are ignored. Rows with a null id, and vectors
    that are null, zero or hold null or non-finite components, take no part. A repeated row counts once. Equal vectors are found
    together: of each such group the k + 1 smallest ids can be among the nearest.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
    )
    rows = stored(rows.distinct())
    partitions = n_partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = stored(rows.groupBy("x").agg(F.min("vec_id").alias("v")))
    members = stored(rows.join(classes, "x").select("vec_id", "v"))
    nodes, n = _counted(_codes(classes), F.col("v").isNotNull())
    partitions = max(partitions, ceil(n / 20_000))
    graph = neighbour_graph(nodes, n, partitions)
    asked = members.filter(F.col("vec_id") % one_in == 0)
    asking = asked.select(F.col("v").alias("q")).distinct()
    codes = stored(asking.join(nodes.withColumnRenamed("v", "q"), "q"))
    some = codes.orderBy(F.xxhash64("q"), "q").select("q").limit(MEASURED)
    sample = [tuple(r) for r in some.join(classes.withColumnRenamed("v", "q"), "q").select("q", "x").collect()]
    truth = stored(true_nearest(sample, classes, k + 1).filter("q <> v")) if sample else asking.select("q", F.col("q").alias("v")).limit(0)
    found = searched(codes, graph, nodes, n, truth)

    x, y = classes.select(F.col("v").alias("q"), F.col("x").alias("qx")), classes.select("v", "x")
    product = F.aggregate(F.zip_with("qx", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    exact = found.join(x, "q").join(y, "v").select("q", "v", product.alias("score"))
    line = Window.partitionBy("q").orderBy(F.desc("score"), "v")  # v is its smallest member: what follows k + 1 classes is no hit
    exact = exact.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= k + 1).drop("place")
    few = Window.partitionBy("v").orderBy("vec_id")
    few = members.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= k + 1).drop("place")
    line = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = exact.join(few, "v").withColumn("place", F.row_number().over(line)).filter(F.col("place") <= k + 1)
    near = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(near.drop("v", "place"), "q")
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
