"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

SHARD = 4096
RACK, RACKS = 16, 256  # at most so many shards a task, once there are so many tasks
QUERY_BLOCK = 1 << 18
DEGREE = 24
BUILD_BEAM = 48
BEAM = 64
RELAX = 1.2
ENTRIES = 16
STEP = 256
WIDTH = 4


class Graph:
    """Directed graph over the rows of ``x``; nearness is squared distance after inner products are made distances.

    For inner product, each vector gets one more coordinate that gives all the same norm; the nearest to
    a query with 0 there is then the one of largest inner product.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX):
        x = x.astype(np.float32)
        norm = (x * x).sum(axis=1)
        extra = np.sqrt(np.maximum(norm.max() - norm, 0))[:, None] if len(x) else np.zeros((0, 1), np.float32)
        self.x = np.ascontiguousarray(np.hstack([x, extra]), np.float32)
        self.plain = np.ascontiguousarray(x)  # without the added coordinate, which is 0 in a query
        self.norm = (self.x * self.x).sum(axis=1)
        self.degree, self.beam, self.relax = degree, beam, relax
        n = len(x)
        self.out = np.full((n, 2 * degree), -1, np.int32)
        self.size = np.zeros(n, np.int64)
        self.entries = _entries(n)

    def build(self) -> Graph:
        """Insert in random order, in steps that grow: a greedy search proposes neighbours, pruning keeps diverse ones, and edges back are added."""
        n = len(self.x)
        order = np.random.default_rng(n).permutation(n)  # it begins with the entries
        done, size = 0, 64
        while done < n:
            new = order[done : done + size].astype(np.int32)
            near = self._distances(new, new)
            np.fill_diagonal(near, np.inf)
            k = min(16, len(new) - 1)
            pool = new[np.argpartition(near, k - 1, axis=1)[:, :k]] if k > 0 else np.full((len(new), 0), -1, np.int32)
            if done:
                ids, _ = self.search(self.x[new], self.beam)
                pool = np.hstack([ids, pool])
            self._link(new, pool)
            done += len(new)
            size = min(STEP, max(64, done))
        return self

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.norm[a][:, None] + self.norm[b][None] - 2 * (self.x[a] @ self.x[b].T)

    def _prune(self, points: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per point, from its pool (-1: none): take the nearest left, drop those that are nearer to it by the relaxed factor, and so on."""
        pool = np.sort(pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        pool[pool == points[:, None]] = -1
        there = pool >= 0
        v = self.x[pool]
        own = self.norm[points][:, None] + self.norm[pool] - 2 * np.einsum("pcd,pd->pc", v, self.x[points])
        own = np.where(there, own, np.inf)
        between = self.norm[pool][:, :, None] + self.norm[pool][:, None] - 2 * (v @ v.transpose(0, 2, 1))
        kept = np.full((len(points), self.degree), -1, np.int32)
        count = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.degree):
            best = own.argmin(axis=1)
            live = np.isfinite(own[rows, best])
            if not live.any():
                break
            r, b = rows[live], best[live]
            kept[r, count[r]] = pool[r, b]
            count[r] += 1
            gone = self.relax**2 * between[r, b] <= own[r]
            gone[np.arange(len(r)), b] = True
            own[r] = np.where(gone, np.inf, own[r])
        return kept, count

    def _link(self, new: np.ndarray, pool: np.ndarray) -> None:
        kept, count = self._prune(new, pool)
        self.out[new, : self.degree], self.size[new] = kept, count
        mask = kept >= 0
        to, back = kept[mask], np.repeat(new, mask.sum(axis=1))
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, more = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, more) + np.repeat(self.size[nodes], more)
        room = self.out.shape[1]
        fits = np.repeat(self.size[nodes] + more <= room, more)
        self.out[to[fits], place[fits]] = back[fits]
        calm = self.size[nodes] + more <= room
        self.size[nodes[calm]] += more[calm]
        full = nodes[~calm]
        for i in range(0, len(full), STEP):
            some = full[i : i + STEP]
            at = np.searchsorted(nodes, some)
            pool = np.full((len(some), room + int(more[at].max())), -1, np.int32)
            pool[:, :room] = self.out[some]
            for k, a in enumerate(at):
                pool[k, room : room + more[a]] = back[first[a] : first[a] + more[a]]
            kept, count = self._prune(some, pool)
            self.out[some] = -1
            self.out[some, : self.degree], self.size[some] = kept, count

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries in step: (ids, inner products), best first, -1 where fewer are reached."""
        n, m = len(self.x), len(q)
        x, half = self.plain if q.shape[1] < self.x.shape[1] else self.x, 0.5 * self.norm
        q = np.ascontiguousarray(q, np.float32)
        seen = np.zeros(m * n, bool)  # by query and node
        owner = np.empty(m * n, np.int32)
        e = self.entries
        ids = np.full((m, beam), -1, np.int32)
        key = np.full((m, beam), np.inf, np.float32)  # half the distance, less what is fixed for a query
        k = min(beam, len(e))
        d = half[e][None] - q @ x[e].T
        pick = np.argsort(d, axis=1)[:, :k]
        ids[:, :k], key[:, :k] = e[pick], np.take_along_axis(d, pick, axis=1)
        seen.reshape(m, n)[:, e] = True
        open_ = ids >= 0
        live = np.arange(m)
        while len(live):
            first = np.argsort(~open_[live], axis=1, kind="stable")[:, :WIDTH]
            usable = np.take_along_axis(open_[live], first, axis=1)
            going = usable[:, 0]
            live, first, usable = live[going], first[going], usable[going]
            if not len(live):
                break
            at = np.where(usable, np.take_along_axis(ids[live], first, axis=1), -1)
            state = open_[live]
            np.put_along_axis(state, first, False, axis=1)
            open_[live] = state
            near = np.where((at >= 0)[:, :, None], self.out[at], -1).ravel()
            row = np.repeat(live, at.shape[1] * self.out.shape[1])
            flat = (row * n + near)[near >= 0]
            flat = flat[~seen[flat]]
            turn = np.arange(len(flat), dtype=np.int32)
            owner[flat] = turn
            flat = flat[owner[flat] == turn]  # each once
            seen[flat] = True
            row, near = np.divmod(flat, n)
            d = half[near] - np.einsum("nd,nd->n", x[near], q[row])
            closer = d < key[row, -1]
            row, near, d = row[closer], near[closer], d[closer]
            if not len(row):
                continue
            count = np.bincount(row, minlength=m)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more_key = np.full((m, int(count.max())), -1, np.int32), np.full((m, int(count.max())), np.inf, np.float32)
            more_ids[row, place], more_key[row, place] = near, d
            some = np.flatnonzero(count)
            all_ids, all_key = np.hstack([ids[some], more_ids[some]]), np.hstack([key[some], more_key[some]])
            all_open = np.hstack([open_[some], more_ids[some] >= 0])
            best = np.argsort(all_key, axis=1, kind="stable")[:, :beam]
            ids[some], key[some], open_[some] = (np.take_along_axis(c, best, axis=1) for c in (all_ids, all_key, all_open))
        return np.where(np.isfinite(key), ids, -1), key


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, n) of rows that take part: id and vector not null, no null or non-finite component, not all zero; n is the vector's size."""
    kind = vectors.schema[vec_col].dataType.elementType
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(T.ArrayType(kind if isinstance(kind, T.FloatType) else T.DoubleType())).alias("vec"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return rows.where(~F.exists("vec", odd) & F.exists("vec", lambda v: v != 0)).withColumn("n", F.size("vec"))


class Rack:
    """The shards of one task: their graphs, and a number for each node that follows its smallest id."""

    def __init__(self, shards: list[pa.Table], size: int, beam: int):
        self.beam, self.graphs, self.first = beam, [], []
        self.ids = pa.concat_arrays([c for t in shards for c in t.column("ids").chunks])
        self.x = np.concatenate([_flat(t.column("vec")).reshape(-1, size) for t in shards]).astype(np.float64)
        smallest = self.ids.flatten().take(pa.array(np.asarray(self.ids.offsets)[:-1] - self.ids.offsets[0].as_py())).to_numpy(zero_copy_only=False)
        self.rank = np.empty(len(smallest), np.int64)
        self.rank[np.argsort(smallest, kind="stable")] = np.arange(len(smallest))
        at = 0
        for t in shards:
            graph = Graph(self.x[at : at + len(t)])
            edges = t.column("out").combine_chunks()
            count = np.diff(np.asarray(edges.offsets))
            graph.out[np.repeat(np.arange(len(t)), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] = np.asarray(edges.flatten())
            self.graphs.append(graph)
            self.first.append(at)
            at += len(t)

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, node, score) of the best k nodes found for each query; ties go to the smaller first id."""
        found = []
        for first, graph in zip(self.first, self.graphs):
            near, _ = graph.search(q, max(self.beam, k))
            found.append(np.where(near >= 0, near + first, -1))
        node = np.concatenate(found, axis=1)
        score = np.full(node.shape, -np.inf)
        for lo in range(0, node.shape[1], 64):  # some columns at a time, to hold few vectors
            part = node[:, lo : lo + 64]
            score[:, lo : lo + 64] = np.where(part >= 0, np.einsum("mcd,md->mc", self.x[part], q), -np.inf)
        by = np.argsort(np.where(node >= 0, self.rank[node], len(self.rank)), axis=1)
        node, score = np.take_along_axis(node, by, axis=1), np.take_along_axis(score, by, axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        node, score = np.take_along_axis(node, best, axis=1), np.take_along_axis(score, best, axis=1)
        row, place = np.nonzero(node >= 0)
        return row, node[row, place], score[row, place]


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])


def _entries(n: int) -> np.ndarray:
    return np.random.default_rng(n).permutation(n)[: min(n, ENTRIES)].astype(np.int32)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard: int = SHARD,
    degree: int = DEGREE,
    beam: int = BEAM,
) -> DataFrame:
    """(query_id, rank, id, score): for each query the ``k`` rows of largest inner product found, its own id left out.

    Equal vectors become one node with its k + 1 smallest ids, which is all that a result can show of
    them; the ranking that picks them keeps at most k + 1 rows a task before the shuffle. Nodes are
    dealt by hash into shards of about ``shard``; each shard's graph is built in one task and written.
    Every query searches each shard. Graph rows and queries meet by the rack (up to 16 shards, one where there are few) in a
    sorted stream: a task loads a rack's graphs once and lets the queries pass in batches, so that its memory does not grow
    with them, and hands on k + 1 rows a query. Graphs are copied once per 262,144 queries, queries once a rack.
    Scores are computed in double precision on the original vectors, ties go to the smaller id.

    Vectors that are null, all zero or hold a null or non-finite component take no part, on either side; nor do rows
    without an id. Vectors of different sizes have no inner product: each size is searched by itself. Fewer rows than k: all of them.
    """
    rows = usable(vectors, id_col, vec_col)
    id_type, vec_type = rows.schema["id"].dataType, rows.schema["vec"].dataType
    few = rows.withColumn("__k", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("__k") <= k + 1)
    nodes = written(few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("n").alias("n")), "vectors")
    asked = written(usable(queries, id_col, vec_col), "queries")
    shards = F.ceil(F.col("c") / shard)
    sizes = nodes.groupBy("n").agg(F.count("*").alias("c")).select("n", shards.cast("int").alias("shards"), F.least(F.lit(RACK), F.greatest(F.lit(1), F.ceil(shards / RACKS))).cast("int").alias("per"))
    blocks = asked.groupBy("n").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    sizes = sizes.join(blocks, "n")
    dealt = nodes.join(sizes, "n").withColumn("shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("shards")).cast("int"))
    keys = [T.StructField(c, T.IntegerType()) for c in ("n", "rack", "blocks", "shard", "node")]
    linked = T.StructType([*keys, T.StructField("vec", vec_type), T.StructField("ids", T.ArrayType(id_type)), T.StructField("out", T.ArrayType(T.IntegerType()))])

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.map(lambda i: i[0])).reset_index(drop=True)
        graph = Graph(np.stack(part["vec"].to_numpy()), degree).build()
        part["node"], part["out"] = np.arange(len(part), dtype=np.int32), [row[row >= 0] for row in graph.out]
        return part[linked.names]

    dealt = dealt.select("n", F.expr("cast(floor(shard / per) as int)").alias("rack"), "blocks", "shard", "vec", "ids")
    graphs = written(dealt.groupBy("n", "shard").applyInPandas(build, linked), "graphs")
    one = F.sequence(F.lit(0), F.col("blocks") - 1)
    racks = F.sequence(F.lit(0), F.expr("cast(floor((shards - 1) / per) as int)"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    left = graphs.select("n", "rack", F.explode(one).alias("block"), "shard", "node", "vec", "ids", "out")
    right = asked.join(sizes, "n").select(
        "n", F.explode(racks).alias("rack"), block.alias("block"), F.lit((1 << 31) - 1).alias("shard"), F.lit(0).alias("node"), "vec", F.array("id").alias("ids"), F.lit(None).cast("array<int>").alias("out")
    )
    order = ["n", "rack", "block", "shard", "node"]
    meet = left.union(right).repartition("n", "rack", "block").sortWithinPartitions(*order)
    found = T.StructType([T.StructField("query_id", id_type), T.StructField("ids", T.ArrayType(id_type)), T.StructField("score", T.DoubleType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rack, parts = None, None, []
        for batch in batches:
            at = np.stack([np.asarray(batch.column(i)) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (key := tuple(at[a, :3])) != now:
                    now, rack, parts = key, None, []
                here, shard_no = batch.slice(a, b - a), int(at[a, 3])
                if shard_no < (1 << 31) - 1:
                    if not parts or parts[-1][0] != shard_no:
                        parts.append((shard_no, []))
                    parts[-1][1].append(here)
                    continue
                if rack is None:
                    rack = Rack([pa.Table.from_batches(x) for _, x in parts], int(at[a, 0]), beam)
                    parts = []
                q = _flat(here.column(5)).reshape(b - a, -1).astype(np.float64)
                names = here.column(6).flatten()
                for i in range(0, len(q), STEP):
                    row, node, score = rack.nearest(q[i : i + STEP], k + 1)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row + i)), rack.ids.take(pa.array(node)), pa.array(score)], names=found.names)

    hits = meet.mapInArrow(search, found)
    hits = hits.select("query_id", F.explode("ids").alias(id_col), "score").where(F.col("query_id") != F.col(id_col))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
