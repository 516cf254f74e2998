"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Rows are dealt out to shards by a hash of their id. A shard's distinct vectors get random levels;
level l holds about M**-l of them. Vectors enter a level's graph in a fixed random order, a block at
a time: each is tied to the diverse ones of its nearest earlier vectors, and these back to it, and a
list that grows too long is cut down to diverse neighbours. The graph is kept as flat arrays: the
neighbours of node i of a level are one row of a table padded with -1. ``build_index`` returns the
index as rows of such arrays; ``search`` walks down the levels greedily and then widens a beam on the
lowest one, all queries of a block at a time.

Equal vectors of a shard are one node with its smallest ids, as many as an answer may need. All
distances of a result are recomputed in double precision on the original vectors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of different lengths are never compared; ties go to the smaller id; rows with equal id and
vector count once; a shard with fewer vectors gives all of them; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquant.llm.common import read_table, ship_package

NEIGHBOURS = 10
#: Vectors of a shard, about, and queries that a shard answers at a time.
SHARD, QUERY_BLOCK = 8192, 2048
#: Neighbours of a node above the lowest level and on it, and candidates while building and searching.
M, M_LOWEST, BUILD_BEAM, SEARCH_BEAM = 16, 32, 64, 128


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def diverse(x: np.ndarray, owner: np.ndarray, candidates: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none) those nearer to the owner than to any one taken before.

    Rows are sorted by distance first; free places then go to the nearest that were passed over.
    """
    distance = np.where(candidates < 0, np.inf, distance)
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
    rows, width = candidates.shape
    vectors = x[np.maximum(candidates, 0)]
    squares = (vectors * vectors).sum(2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    for j in range(width):
        near = (between[:, j, :] < distance[:, j, None]) & taken
        taken[:, j] = ~near.any(1) & np.isfinite(distance[:, j]) & (taken.sum(1) < most)
    rank = np.where(taken, 0, np.where(np.isfinite(distance), 1, 2)) * width + np.arange(width)
    first = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(np.where(np.isfinite(distance), candidates, -1), first, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def build_level(x: np.ndarray, nodes: np.ndarray, most: int, block: int = 256) -> np.ndarray:
    """A row of neighbours, padded with -1, for each of nodes, which are in the order of their entry."""
    links = np.full((len(nodes), most), -1, np.int32)
    place = np.full(len(x), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    at = 0
    while at < len(nodes):
        size = min(block, max(1, at), len(nodes) - at)
        new, earlier = nodes[at : at + size], nodes[: at + size]
        distance = _distances(x[new], x[earlier])
        distance[np.arange(size)[:, None] + at <= np.arange(len(earlier))] = np.inf  # only earlier ones
        beam = min(BUILD_BEAM, len(earlier))
        near = np.argpartition(distance, beam - 1, axis=1)[:, :beam]
        d = np.take_along_axis(distance, near, 1)
        chosen = diverse(x, new, np.where(np.isfinite(d), earlier[near], -1), d, most)
        links[at : at + size] = chosen
        # Back: lists that have room get the new node; the others are chosen anew.
        target, source = chosen[chosen >= 0], np.repeat(new, (chosen >= 0).sum(1))
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        count = np.diff(np.concatenate([first, [len(target)]]))
        if len(first):
            width = int(count.max())
            added = np.full((len(first), width), -1, np.int64)
            added[np.repeat(np.arange(len(first)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            hosts = target[first]
            for part in range(0, len(hosts), 512):
                host = hosts[part : part + 512]
                both = np.concatenate([links[place[host]].astype(np.int64), added[part : part + 512]], axis=1)
                gap = x[np.maximum(both, 0)] - x[host][:, None, :]
                links[place[host]] = diverse(x, host, both, (gap * gap).sum(2), most)
        at += size
    return links


def build_graph(x: np.ndarray, seed: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes and neighbour rows of each level, the lowest first. x: distinct vectors, float32."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(M)).astype(int)
    nodes, links = [], []
    for l in range(int(level.max()) + 1):
        nodes.append(order[level[order] >= l])
        links.append(build_level(x, nodes[-1], M_LOWEST if l == 0 else M))
    return nodes, links


def search_graph(x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """For each query the nodes of the beam, -1 where there are fewer."""
    rows = np.arange(len(queries))

    def distance(candidates: np.ndarray) -> np.ndarray:
        gap = x[np.maximum(candidates, 0)] - queries[:, None, :]
        return np.where(candidates < 0, np.inf, np.einsum("qcd,qcd->qc", gap, gap))

    at = np.full(len(queries), nodes[-1][0])
    here = distance(at[:, None])[:, 0]
    for level in range(len(nodes) - 1, 0, -1):
        place = np.full(len(x), -1, np.int64)
        place[nodes[level]] = np.arange(len(nodes[level]))
        while True:
            near = links[level][place[at]]
            d = distance(near)
            best = d.argmin(1)
            better = d[rows, best] < here
            if not better.any():
                break
            at, here = np.where(better, near[rows, best], at), np.where(better, d[rows, best], here)
    place = np.full(len(x), -1, np.int64)
    place[nodes[0]] = np.arange(len(nodes[0]))
    found = np.full((len(queries), beam), -1, np.int64)
    gap = np.full((len(queries), beam), np.inf)
    done = np.ones((len(queries), beam), bool)
    found[:, 0], gap[:, 0], done[:, 0] = at, here, False
    seen = np.zeros((len(queries), len(x)), bool)
    seen[rows, at] = True
    while True:
        open_ = np.where(done, np.inf, gap)
        pick = open_.argmin(1)
        active = np.isfinite(open_[rows, pick])
        if not active.any():
            return found
        done[rows[active], pick[active]] = True
        near = links[0][place[np.maximum(found[rows, pick], 0)]].astype(np.int64)
        near = np.where(active[:, None] & (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)], near, -1)
        r, c = np.nonzero(near >= 0)
        seen[r, near[r, c]] = True
        d = distance(near)
        found, gap = np.concatenate([found, near], 1), np.concatenate([gap, d], 1)
        done = np.concatenate([done, near < 0], 1)
        keep = np.argpartition(gap, beam - 1, axis=1)[:, :beam]
        found, gap, done = (np.take_along_axis(v, keep, 1) for v in (found, gap, done))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and components, as doubles, of the vectors that take part."""
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0)).distinct()


def build_index(vectors: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """A row for each shard: its number, dimension, and its vectors, ids and levels as flat arrays.

    vectors: id and v as from usable(), and shard.
    """
    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = np.array(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        # The smallest ids of each node: a query may be one of them itself.
        order = np.lexsort((ids, node.ravel()))
        owner = node.ravel()[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = rank <= neighbours
        nodes, links = build_graph(distinct.astype(np.float32))
        row = {
            "shard": [key[0].as_py()], "size": [x.shape[1]], "vectors": [distinct.tobytes()], "ids": [ids[order][kept].tobytes()],
            "owners": [owner[kept].astype(np.int32).tobytes()], "levels": [[n.astype(np.int32).tobytes() for n in nodes]],
            "links": [[k.tobytes() for k in links]],
        }
        return pa.table(row, schema=pa.schema([
            ("shard", pa.int64()), ("size", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("owners", pa.binary()),
            ("levels", pa.list_(pa.binary())), ("links", pa.list_(pa.binary())),
        ]))

    ship_package(vectors.sparkSession)
    schema = "shard long, size int, vectors binary, ids binary, owners binary, levels array<binary>, links array<binary>"
    return vectors.groupBy("shard").applyInArrow(build, schema)


def _answer(index: dict, ids: np.ndarray, queries: np.ndarray, neighbours: int, beam: int) -> tuple[np.ndarray, ...]:
    """Query id, found id and distance: each query's nearest in one shard."""
    x = np.frombuffer(index["vectors"], np.float64).reshape(-1, index["size"])
    known, owner = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["owners"], np.int32)
    nodes = [np.frombuffer(n, np.int32) for n in index["levels"]]
    links = [np.frombuffer(k, np.int32).reshape(len(n), -1) for n, k in zip(nodes, index["links"])]
    beam = max(min(beam, len(x)), 1)
    found = search_graph(x.astype(np.float32), nodes, links, queries.astype(np.float32), beam)
    begin, end = np.searchsorted(owner, np.arange(len(x))), np.searchsorted(owner, np.arange(len(x)), "right")
    out = [], [], []
    for q, row in enumerate(found):
        row = row[row >= 0]
        gap = x[row] - queries[q]
        d = np.sqrt((gap * gap).sum(1))
        near = np.concatenate([known[begin[n] : end[n]] for n in row])
        d = np.repeat(d, (end - begin)[row])
        other = near != ids[q]
        near, d = near[other], d[other]
        best = np.lexsort((near, d))[:neighbours]
        out[0].append(np.full(len(best), ids[q]))
        out[1].append(near[best])
        out[2].append(d[best])
    return tuple(np.concatenate(v) for v in out)


def search(index: DataFrame, queries: DataFrame, shards: int, blocks: int, neighbours: int = NEIGHBOURS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score. queries: id and v; they meet every shard in blocks."""
    names = ["shard", "block"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    asked = queries.select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), every)
    copies = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def answer(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        widths = right.column("width").to_numpy() if len(right) else np.zeros(0)
        for index in left.to_pylist():
            own = right.filter(pa.array(widths == index["size"]))
            if len(own):
                q = np.array(own.column("v").combine_chunks().flatten()).reshape(len(own), -1)
                parts.append(_answer(index, own.column("id").to_numpy(), q, neighbours, beam))
        columns = [np.concatenate(v) for v in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    schema = "query_id long, vec_id long, score double"
    near = copies.groupBy(*names).cogroup(asked.groupBy(*names)).applyInArrow(answer, schema)
    # At most neighbours rows a shard: the merge of a query is bounded.
    best = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("score", "vec_id"))), 1, neighbours).alias("best"))
    rows = best.select("query_id", F.posexplode("best").alias("place", "hit"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", neighbours: int = NEIGHBOURS, shard: int = SHARD,
) -> DataFrame:
    """The nearest vectors of each query, itself excepted. queries: rows of the same shape."""
    own = usable(vectors, key, vector)
    asked = usable(queries, key, vector)
    count = own.count()
    shards = max(1, -(-count // shard))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # A shard holds vectors of one length, the lower half of its number while it is built.
    number = F.shiftleft(F.pmod(F.xxhash64("id"), F.lit(shards)), 32) + F.size("v")
    found = build_index(own.withColumn("shard", number), neighbours).withColumn("shard", F.shiftright("shard", 32))
    return search(found, asked, shards, blocks, neighbours)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all others."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
