"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Rows are dealt to shards of about SHARD rows by a hash of their id; vectors of one dimension share shards. In each
shard equal vectors are one node. Nodes are inserted in a random order, LOT at a time: each is searched in the graph
as it stands, the nodes before it in its lot are added exactly, and of the EF_BUILD nearest found it links to LINKS
diverse ones, which link back, with at most 2 * LINKS links on the lowest level and LINKS above. Node levels are
geometric. A shard's graph is one row of flat arrays. A search goes down greedily from the top level and keeps the
EF_SEARCH best on the lowest; searches of a lot walk side by side. Every query is searched in every shard, and the
best K of all shards are its result. Building takes about n * log(n) distances, so shards may be large: SHARD bounds
a task's memory (about 1 kB a row of 64 dimensions, and LOT bytes a row while it is searched).

Distances are Euclidean, in double precision, on the original vectors. Defined cases: vectors that are null, empty,
zero, or hold null or non-finite components take no part, nor do rows with a null id; ties go to the smaller id;
rows of a repeated id are candidates each, but none for a query of that id; queries of other dimensions than a shard
are not searched in it; an empty table gives an empty result; other columns are not read. A task holds one shard and
up to CHUNK queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import keep

SHARD, LINKS, EF_BUILD, EF_SEARCH, CHUNK, K, SEED = 1 << 15, 16, 48, 320, 8192, 10, 5
#: Nodes inserted or searched side by side, and how many nodes of each search are opened at once.
LOT, WIDE = 512, 4
INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("owners", pa.binary()), ("vectors", pa.binary()), ("nodes", pa.binary()), ("links", pa.binary()), ("sizes", pa.list_(pa.int32()))])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _apart(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows a[i] and b[i]."""
    d = v[a] - v[b]
    return np.einsum("ij,ij->i", d, d)


def _diverse(v: np.ndarray, near: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (by distance d, -1 for none) those nearer to the row's node than to any chosen before,
    then the nearest of the rest: [row, most]."""
    rows, n = near.shape
    points = v[np.maximum(near, 0)]
    norm = np.einsum("ijk,ijk->ij", points, points)
    apart = norm[:, :, None] + norm[:, None] - 2 * points @ points.transpose(0, 2, 1)
    chosen, count, nearest = np.zeros((rows, n), bool), np.zeros(rows, np.int64), np.full((rows, n), np.inf, np.float32)
    for j in range(n):
        fine = (near[:, j] >= 0) & (d[:, j] <= nearest[:, j]) & (count < most)
        chosen[:, j] = fine
        count += fine
        nearest = np.where(fine[:, None], np.minimum(nearest, apart[:, j]), nearest)
    order = np.argsort(np.where(near < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def _beam(v: np.ndarray, links: np.ndarray, row: np.ndarray | None, q: np.ndarray, entry: np.ndarray, ef: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest nodes (-1 for none) that walks from the entries find for each query, and squared distances,
    nearest first. links: a level's neighbours; row: where a node's are (None: at the node)."""
    n = len(q)
    ids, d = np.full((n, ef), -1, np.int64), np.full((n, ef), np.inf, np.float32)
    done = np.ones((n, ef), bool)
    ids[:, 0], d[:, 0], done[:, 0] = entry, ((v[entry] - q) ** 2).sum(1), False
    seen = np.zeros((n, len(v)), bool)
    seen[np.arange(n), entry] = True
    live = np.arange(n)
    while len(live):
        open_ = ~done[live]
        pick = open_ & (np.cumsum(open_, 1) <= wide)
        done[live] |= pick
        at, place = np.nonzero(pick)
        who, node = live[at], ids[live[at], place]
        near = links[node if row is None else row[node]]
        who, near = np.repeat(who, near.shape[1]), near.reshape(-1).astype(np.int64)
        fresh = near >= 0
        who, near = who[fresh], near[fresh]
        fresh = ~seen[who, near]
        who, near = who[fresh], near[fresh]
        key = np.unique(who * len(v) + near)
        who, near = key // len(v), key % len(v)
        if len(key):
            seen[who, near] = True
            diff = v[near] - q[who]
            dist = np.einsum("ij,ij->i", diff, diff)
            fine = dist < d[who, -1]
            who, near, dist = who[fine], near[fine], dist[fine]
        if len(who):
            some, begin, many = np.unique(who, return_index=True, return_counts=True)
            col = np.arange(len(who)) - np.repeat(begin, many)
            spot = np.repeat(np.arange(len(some)), many)
            shape = (len(some), int(many.max()))
            new_d, new_i = np.full(shape, np.inf, np.float32), np.full(shape, -1, np.int64)
            new_d[spot, col], new_i[spot, col] = dist, near
            all_d, all_i = np.concatenate([d[some], new_d], 1), np.concatenate([ids[some], new_i], 1)
            all_done = np.concatenate([done[some], new_i < 0], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            d[some], ids[some], done[some] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_done))
        live = live[~done[live].all(1)]
    return ids, d


class Level:
    """Links of one level while it grows."""

    def __init__(self, n: int, nodes: np.ndarray, most: int):
        self.most, self.links, self.filled = most, np.full((len(nodes), most), -1, np.int32), np.zeros(len(nodes), np.int64)
        self.row = np.full(n, -1, np.int64)
        self.row[nodes] = np.arange(len(nodes))

    def add(self, v: np.ndarray, nodes: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        """Link new nodes to diverse ones of their candidates, and those back; full ones keep diverse links."""
        chosen = _diverse(v, near, d, LINKS)
        self.links[self.row[nodes], : chosen.shape[1]] = chosen
        self.filled[self.row[nodes]] = (chosen >= 0).sum(1)
        to, back = chosen.reshape(-1), np.repeat(nodes, chosen.shape[1])
        to, back = to[chosen.reshape(-1) >= 0].astype(np.int64), back[chosen.reshape(-1) >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        own, begin, many = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(begin, many)
        r = self.row[own]
        fits = self.filled[r] + many <= self.most
        each = np.repeat(fits, many)
        self.links[self.row[to[each]], (np.repeat(self.filled[r], many) + place)[each]] = back[each]
        self.filled[r[fits]] += many[fits]
        if not fits.all():
            full, more, r = own[~fits], many[~fits], r[~fits]
            all_ = np.full((len(full), self.most + int(more.max())), -1, np.int64)
            all_[:, : self.most] = self.links[r]
            all_[np.repeat(np.arange(len(full)), more), self.most + place[~each]] = back[~each]
            who, col = np.nonzero(all_ >= 0)
            dist = np.full(all_.shape, np.inf, np.float32)
            dist[who, col] = _apart(v, all_[who, col], full[who])
            order = np.argsort(dist, axis=1, kind="stable")
            kept = _diverse(v, np.take_along_axis(all_, order, 1), np.take_along_axis(dist, order, 1), self.most)
            self.links[r] = kept
            self.filled[r] = (kept >= 0).sum(1)


def _scaled(v: np.ndarray, scale: float) -> np.ndarray:
    """Vectors as the walks see them."""
    return (v / scale).astype(np.float32)


def build_shard(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """A shard's graph. owners has the node of each id; ids are in order within a node."""
    v, owner = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, owner))
    rng = np.random.default_rng(SEED)
    insert = rng.permutation(len(v))
    place = np.empty(len(v), np.int64)
    place[insert] = np.arange(len(v))
    v = np.ascontiguousarray(v[insert])
    n = len(v)
    level = np.minimum(8, np.floor(-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int)) if n else np.zeros(0, int)
    nodes = [np.arange(n)] + [np.flatnonzero(level >= k) for k in range(1, int(level.max(initial=0)) + 1)]
    levels = [Level(n, x, LINKS if k else 2 * LINKS) for k, x in enumerate(nodes)]
    w = _scaled(v, float(np.abs(v).max(initial=1e-300)))
    top = -1
    for begin in range(0, n, LOT):
        lot = np.arange(begin, min(n, begin + LOT))
        entry = np.full(len(lot), top)
        for k in range(len(nodes) - 1, -1, -1):
            here, found = level[lot] >= k, None
            if top >= 0 and level[top] >= k:
                own = levels[k]
                ids_, d_ = _beam(w, own.links, own.row, w[lot], entry, EF_BUILD if here.any() else 1, WIDE)
                entry, found = ids_[:, 0], (ids_[here], d_[here])
            some = lot[here]
            if not len(some):
                continue
            norm = (w[some] ** 2).sum(1)
            d = np.maximum(norm[:, None] + norm - 2 * w[some] @ w[some].T, 0)
            d[np.arange(len(some))[None] >= np.arange(len(some))[:, None]] = np.inf
            near = np.broadcast_to(some, d.shape)
            if found:
                near, d = np.concatenate([found[0], near], 1), np.concatenate([found[1], d], 1)
            order_ = np.argsort(d, axis=1, kind="stable")[:, :EF_BUILD]
            d = np.take_along_axis(d, order_, 1)
            levels[k].add(w, some, np.where(np.isfinite(d), np.take_along_axis(near, order_, 1), -1), d)
        best = lot[level[lot].argmax()]
        if top < 0 or level[best] > level[top]:
            top = int(best)
    owners, ids = place[owner[order]], ids[order]
    order = np.argsort(owners, kind="stable")
    return {"ids": ids[order], "owners": owners[order], "v": v, "nodes": nodes, "links": [x.links for x in levels]}


class Graph:
    """A shard's graph, ready for searching."""

    def __init__(self, made: dict):
        self.ids, self.v, self.links = made["ids"], made["v"], made["links"]
        self.first = np.searchsorted(made["owners"], np.arange(len(self.v) + 1))
        self.scale = float(np.abs(self.v).max(initial=1e-300))
        self.w = _scaled(self.v, self.scale)
        self.rows = []
        for nodes in made["nodes"]:
            row = np.full(len(self.v), -1, np.int64)
            row[nodes] = np.arange(len(nodes))
            self.rows.append(row)
        self.top = int(made["nodes"][-1][0]) if len(self.v) else -1

    def nodes(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Up to ef nodes (-1 for none) near each query, nearest first."""
        q = _scaled(q, self.scale)
        entry = np.full(len(q), self.top)
        for links, row in zip(self.links[:0:-1], self.rows[:0:-1], strict=True):
            entry = _beam(self.w, links, row, q, entry, 1, 1)[0][:, 0]
        return _beam(self.w, self.links[0], None, q, entry, ef, WIDE)[0]

    def search_all(self, query_ids: np.ndarray, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[list[tuple[int, float]]]:
        """For each query the k nearest ids found, but its own, with distances; ties by id."""
        out: list[list[tuple[int, float]]] = []
        for begin in range(0, len(q) if len(self.v) else 0, LOT):
            some = q[begin : begin + LOT]
            for query_id, x, near in zip(query_ids[begin : begin + LOT].tolist(), some, self.nodes(some, max(ef, 2 * k + 2)), strict=True):
                near = near[near >= 0]
                found: list[tuple[float, int]] = []
                for d, i in zip(np.sqrt(((self.v[near] - x) ** 2).sum(1)).tolist(), near.tolist(), strict=True):
                    own = self.ids[self.first[i] : self.first[i + 1]]
                    found += [(d, y) for y in own[own != query_id][:k].tolist()]  # the first k of equal vectors are enough
                out.append([(y, d) for d, y in sorted(found)[:k]])
        return out or [[] for _ in range(len(q))]

    def search(self, query_id: int, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[tuple[int, float]]:
        """search_all() of one query."""
        return self.search_all(np.array([query_id]), q[None], k, ef)[0]


def _numpy(table: pa.Table, ids: str) -> tuple[np.ndarray, np.ndarray]:
    vectors = table["vector"].combine_chunks()
    return table[ids].to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _to_row(dim: int, shard: int, made: dict) -> pa.Table:
    flat = lambda parts, kind: np.concatenate([p.reshape(-1) for p in parts]).astype(kind).tobytes()
    row = [dim, shard, made["ids"].astype(np.int64).tobytes(), made["owners"].astype(np.int32).tobytes(), made["v"].tobytes(), flat(made["nodes"], np.int32), flat(made["links"], np.int32), [len(x) for x in made["nodes"]]]
    return pa.table([pa.array([x], f.type) for x, f in zip(row, INDEX, strict=True)], schema=INDEX)


def _from_row(row: dict) -> Graph:
    n, links = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["links"], np.int32)
    made = {"ids": np.frombuffer(row["ids"], np.int64), "owners": np.frombuffer(row["owners"], np.int32), "v": np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]), "nodes": [], "links": []}
    at = cell = 0
    for k, size in enumerate(row["sizes"]):
        most = LINKS if k else 2 * LINKS
        made["nodes"].append(n[at : at + size])
        made["links"].append(links[cell : cell + size * most].reshape(size, most))
        at, cell = at + size, cell + size * most
    return Graph(made)


def _rows(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return df.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias(name), vector.alias("vector"), F.size(vector).alias("dim"))


def _parts(rows: DataFrame, name: str, size: int) -> Column:
    """A hash of the id modulo the number of parts of about ``size`` rows, for each dimension."""
    out = F.lit(1)
    for dim, n in rows.groupBy("dim").count().collect():
        out = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // size)))).otherwise(out)
    return out


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row for each shard: its ids, vectors and flat neighbour arrays. Kept in the shared folder."""
    rows = _rows(df, id_col, vector_col, "vec_id")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), _parts(rows, "vec_id", shard)).cast("long"))

    def run(key, table):
        return _to_row(key[0].as_py(), key[1].as_py(), build_shard(*_numpy(table, "vec_id")))

    made = dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard long, ids binary, owners binary, vectors binary, nodes binary, links binary, sizes array<int>")
    return keep(made, "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (the distance) of the k nearest found for each query."""
    rows = _rows(queries, id_col, vector_col, "query_id")
    chunks = _parts(rows, "query_id", CHUNK)
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = rows.withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks).cast("long")).join(shards, "dim").select("query_id", "vector", "dim", "chunk", F.explode("shards").alias("shard"))
    served = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks.cast("long") - 1)))

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        graph = _from_row(left.slice(0, 1).to_pylist()[0])
        ids, vectors = _numpy(right, "query_id")
        hits = [(q, i, d) for q, near in zip(ids.tolist(), graph.search_all(ids, vectors, k, ef), strict=True) for i, d in near]
        return pa.table([list(x) for x in zip(*hits, strict=True)] if hits else [[], [], []], schema=FOUND)

    key = ("dim", "shard", "chunk")
    found = served.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
