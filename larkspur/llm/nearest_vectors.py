"""The k most similar vectors of every vector, by balanced posting lists searched through a centroid graph.

Centroids are trained on a bounded sample: balanced bisection, a few rounds of spherical k-means, and a split of
every list above twice the average. A graph joins each centroid to its nearest ones; it and the centroids are
small (at most ``sample_rows / 16`` lists) and broadcast. Every vector walks the graph best-first, batches of
vectors at once, to the lists near it. It is stored in all lists not much farther than its nearest (boundary
vectors are thus replicated) and searches all lists within a distance ratio of its nearest.

The lists' sizes are then counted. A list with more than ``split_rows`` vectors gets a graph of its own, trained on a
bounded sample of it, and its rows are sent on to lists within it, in as many tasks as its rows need; so the number of
lists grows with the vectors, level by level, while each graph stays small. Each list is one matrix product. A list
that stays large (vectors that hardly differ) is cut into a grid of blocks by its counted size, so a task is bounded.

Exact copies of a direction are one vector to the index, so a group of copies, however large, is never paired
with itself; its members are put back at the end.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.lineage import cut

_MEMBER, _QUERY = 1, 2


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _owners(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in blocks."""
    step = max(1, (1 << 24) // len(centroids))
    return np.concatenate([(rows[i : i + step] @ centroids.T).argmax(axis=1) for i in range(0, len(rows), step)])


class CentroidGraph:
    """Unit centroids and the graph of their nearest neighbours."""

    def __init__(self, sample: np.ndarray, lists: int, degree: int = 24, seed: int = 7) -> None:
        self.rng = np.random.default_rng(seed)
        parts = [np.arange(len(sample))]
        while len(parts) < lists:
            parts.sort(key=len)
            parts.extend(self._halves(sample, parts.pop()))
        centroids = _unit(np.stack([sample[p].mean(axis=0) for p in parts]))
        for _ in range(4):
            centroids, owner = self._moved(sample, centroids)
        # Lists above twice the average are split, to keep the work of a list even.
        large = np.nonzero(np.bincount(owner, minlength=len(centroids)) > max(2, 2 * len(sample) / len(centroids)))[0]
        halves = [sample[h].mean(axis=0) for k in large for h in self._halves(sample, np.nonzero(owner == k)[0])]
        if halves:
            centroids = np.vstack([np.delete(centroids, large, axis=0), _unit(np.stack(halves))])
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        degree = min(degree, n - 1)
        self.graph = np.zeros((n, degree), np.int32)
        for i in range(0, n, 1024):
            near = self.centroids[i : i + 1024] @ self.centroids.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
            if degree:
                self.graph[i : i + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
        self.pivots = np.sort(self.rng.permutation(n)[: max(16, 2 * math.isqrt(n))])

    def arrays(self) -> dict[str, np.ndarray]:
        """What a search needs."""
        return {"centroids": self.centroids, "graph": self.graph, "pivots": self.pivots}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> CentroidGraph:
        """A graph to search, from its arrays."""
        graph = cls.__new__(cls)
        graph.__dict__.update(arrays)
        return graph

    def _halves(self, rows: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of equal size, along the difference of two means."""
        own = rows[part]
        a, b = own[self.rng.integers(len(own))], own[self.rng.integers(len(own))]
        middle = len(own) // 2
        for _ in range(4):
            order = np.argsort(own @ (a - b), kind="stable")
            a, b = own[order[middle:]].mean(axis=0), own[order[:middle]].mean(axis=0)
        return part[order[middle:]], part[order[:middle]]

    @staticmethod
    def _moved(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = _owners(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, rows)
        used = np.bincount(owner, minlength=len(centroids)) > 0
        moved = np.where(used[:, None], _unit(sums), centroids)
        return moved, owner

    def near(self, rows: np.ndarray, breadth: int, ratio: float, expand: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """Per row the nearest centroids found (-1: none) and their distances, nearest first.

        A best-first walk from the nearest pivots; only centroids within ``ratio`` of the nearest so far, and a
        little beyond, are expanded.
        """
        n, each = len(self.centroids), np.arange(len(rows))[:, None]
        breadth = min(breadth, n)
        similar = rows @ self.centroids[self.pivots].T
        first = min(breadth, len(self.pivots))
        top = np.argpartition(-similar, first - 1, axis=1)[:, :first]
        beam = np.full((len(rows), breadth), -1, np.int64)
        score = np.full((len(rows), breadth), -np.inf, np.float32)
        beam[:, :first], score[:, :first] = self.pivots[top], np.take_along_axis(similar, top, axis=1)
        seen = np.zeros((len(rows), n), bool)
        seen[:, self.pivots] = True
        opened = np.zeros((len(rows), n), bool)
        while self.graph.shape[1]:
            distance = np.sqrt(np.maximum(2 - 2 * score, 0))
            limit = (1.1 * ratio) * distance.min(axis=1, keepdims=True) + 1e-3
            closed = (beam < 0) | (distance > limit) | np.take_along_axis(opened, np.maximum(beam, 0), axis=1)
            waiting = np.where(closed, -np.inf, score)
            pick = np.argpartition(-waiting, min(expand, breadth) - 1, axis=1)[:, : min(expand, breadth)]
            live = np.take_along_axis(waiting, pick, axis=1) > -np.inf
            active = live.any(axis=1)
            if not active.any():
                break
            rows_on = np.nonzero(active)[0]
            nodes, live = np.take_along_axis(beam, pick, axis=1)[rows_on], live[rows_on]
            opened[rows_on[:, None], np.where(live, nodes, nodes[np.arange(len(nodes)), live.argmax(axis=1)][:, None])] = True
            fresh = np.where(live[:, :, None], self.graph[np.maximum(nodes, 0)], n).reshape(len(rows_on), -1)
            fresh.sort(axis=1)
            bad = fresh == n
            bad[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
            fresh = np.where(bad, 0, fresh)
            bad |= seen[rows_on[:, None], fresh]
            seen[np.repeat(rows_on, fresh.shape[1])[~bad.ravel()], fresh.ravel()[~bad.ravel()]] = True
            found = np.matmul(self.centroids[fresh], rows[rows_on][:, :, None])[:, :, 0]
            found[bad] = -np.inf
            both = np.hstack([score[rows_on], found])
            ids = np.hstack([beam[rows_on], np.where(bad, -1, fresh)])
            best = np.argpartition(-both, breadth - 1, axis=1)[:, :breadth]
            score[rows_on], beam[rows_on] = np.take_along_axis(both, best, axis=1), np.take_along_axis(ids, best, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        score, beam = score[each, order], beam[each, order]
        return beam, np.sqrt(np.maximum(2 - 2 * score, 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Vectors of a binary column, one row each."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(-1, dimension) for c in chunks])


def _best(queries: np.ndarray, query_ids: np.ndarray, members: np.ndarray, member_ids: np.ndarray, k: int, least: float):
    """(query, member, similarity) arrays of the k best other members of each query, in blocks of queries."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    step = max(1, (1 << 22) // max(1, len(members)))
    for i in range(0, len(queries) if len(members) else 0, step):
        similar = queries[i : i + step] @ members.T
        similar[query_ids[i : i + step][:, None] == member_ids[None, :]] = -np.inf
        if k < similar.shape[1]:
            top = np.argpartition(-similar, k - 1, axis=1)[:, :k]
            similar = np.take_along_axis(similar, top, axis=1)
        else:
            top = np.broadcast_to(np.arange(similar.shape[1]), similar.shape)
        keep = similar >= least
        rows = np.nonzero(keep)[0]
        out.append((query_ids[i : i + step][rows], member_ids[top[keep]], similar[keep]))
    return [np.concatenate(x) for x in zip(*out)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, v`` with vectors scaled to length 1; without those that have none or an element that is no number."""
    for batch in batches:
        lists = batch.column(1)
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]):
            own = batch.filter(pa.array(sizes == size))
            rows = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size)).astype(np.float64)
            norm = np.sqrt((rows * rows).sum(axis=1))
            keep = np.isfinite(norm) & (norm > 0)
            units = (rows[keep] / norm[keep][:, None]).astype(np.float32)
            offsets = pa.array(np.arange(0, units.size + 1, size), pa.int32())
            yield pa.RecordBatch.from_arrays([own.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(offsets, pa.array(units.ravel()))], ["id", "v"])


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: unit vectors, without nulls, NaN or infinities."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).dropna()
    return rows.mapInArrow(_units, "id long, v array<float>")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best ``other`` of each ``id``; a pair met in several lists counts once."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("similarity", (-F.col("other")).alias("minus"))), asc=False), 1, k)
    merged = pairs.repartition("id").groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    ranked = merged.groupBy("id").agg(best.alias("best")).select("id", F.posexplode("best").alias("place", "b"))
    return ranked.select("id", (-F.col("b.minus")).alias("other"), F.col("b.similarity").alias("similarity"), "place")


_ROUTED = "list long, id long, role byte, v binary"
#: A list's children are numbered by ten more bits below its own number; the level is in the top byte.
_CHILD_BITS, _LEVELS = 10, 4


def _route(graph: CentroidGraph, data: np.ndarray, roles: np.ndarray, how: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, role) arrays: the lists that members are stored in and queries search."""
    beam, distance = graph.near(data, how["breadth"], max(how["replicate"], how["probe"]))
    bound = distance[:, :1] + 1e-6
    stored = (distance <= how["replicate"] * bound) & (beam >= 0) & ((roles & _MEMBER) > 0)[:, None]
    stored[:, how["replicas"] :] = False
    asks = (distance <= how["probe"] * bound) & (beam >= 0) & ((roles & _QUERY) > 0)[:, None]
    row, slot = np.nonzero(stored | asks)
    return row, beam[row, slot], (stored[row, slot] * _MEMBER | asks[row, slot] * _QUERY).astype(np.int8)


def _finer(routed: DataFrame, large: DataFrame, level: int, dimension: int, list_size: int, how: dict) -> DataFrame:
    """The rows of ``large`` lists (``list, members, parts``) sent on to lists within them, each by a graph of its own."""
    most = 1 << _CHILD_BITS
    mine = routed.join(F.broadcast(large), "list")
    # Sixteen members a list are drawn, so a list's sample is bounded by 16 times the most lists within it.
    lists = F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.col("members") / list_size)))
    every = F.greatest(F.lit(1), F.floor(F.col("members") / (16 * lists)))
    drawn = mine.filter((F.col("role").bitwiseAND(_MEMBER) > 0) & (F.pmod(F.xxhash64("id", F.lit(level)), every) == 0))

    def train(own: pd.DataFrame) -> pd.DataFrame:
        sample = np.frombuffer(b"".join(own["v"]), np.float32).reshape(-1, dimension)
        graph = CentroidGraph(sample, max(1, min(int(own["lists"].iat[0]), len(sample) // 8, most // 2)))
        file = io.BytesIO()
        np.savez(file, **graph.arrays())
        return pd.DataFrame({"list": own["list"].iloc[:1], "graph": [file.getvalue()]})

    graphs = cut(drawn.select("list", lists.alias("lists"), "v").groupBy("list").applyInPandas(train, "list long, graph binary"))
    salted = mine.select("list", "id", "role", "v", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    spread = graphs.join(F.broadcast(large), "list").select("list", "graph", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    # A row is in several of the lists that are split, so within each of them it need not go to as many.
    inside = how | {"breadth": max(1, how["breadth"] // 4), "replicas": max(1, how["replicas"] // 4)}

    def split(rows: pa.Table, held: pa.Table) -> pa.Table:
        if not rows.num_rows or not held.num_rows:
            return rows.select(["list", "id", "role", "v"])
        graph = CentroidGraph.of(dict(np.load(io.BytesIO(held["graph"][0].as_py()))))
        found = []
        for start in range(0, rows.num_rows, 256):
            part = rows.slice(start, 256)
            row, where, roles = _route(graph, _matrix(part["v"], dimension), part["role"].to_numpy(), inside)
            own = (rows["list"][0].as_py() & ((1 << 56) - 1)) << _CHILD_BITS | level << 56
            taken = part.take(pa.array(row))
            found.append(pa.table({"list": own | where.astype(np.int64), "id": taken["id"], "role": roles, "v": taken["v"]}))
        return pa.concat_tables(found)

    inner = salted.groupBy("list", "part").cogroup(spread.groupBy("list", "part")).applyInArrow(split, _ROUTED)
    return inner.unionByName(routed.join(F.broadcast(large), "list", "left_anti").select("list", "id", "role", "v"))


def _in_cells(routed: DataFrame, list_rows: int) -> DataFrame:
    """``list, cell, id, role, v``: a list of more than ``list_rows`` rows is a grid, with its members in all columns of their
    row and its queries in all rows of their column."""
    side = F.ceil(F.greatest(F.count_if(F.col("role").bitwiseAND(_MEMBER) > 0), F.count_if(F.col("role").bitwiseAND(_QUERY) > 0)) / list_rows)
    # At most as many as there are rows over list_rows.
    large = routed.groupBy("list").agg(side.alias("side")).filter("side > 1")
    large = routed.sparkSession.createDataFrame(large.collect(), "list long, side long")
    wide = routed.join(F.broadcast(large), "list", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    own, places = F.pmod(F.xxhash64("id", F.lit(5)), F.col("side")), F.sequence(F.lit(0).cast("long"), F.col("side") - 1)

    def takes(role: int, cell) -> Column:
        cells = F.transform(places, lambda j: F.struct(cell(j).alias("cell"), F.lit(role).cast("byte").alias("role")))
        return F.when(F.col("role").bitwiseAND(role) > 0, cells).otherwise(F.slice(cells, 1, 0))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("cell"), "role"))
    both = F.concat(takes(_MEMBER, lambda j: own * F.col("side") + j), takes(_QUERY, lambda j: j * F.col("side") + own))
    cells = F.explode(F.when(F.col("side") == 1, whole).otherwise(both)).alias("c")
    return wide.select("list", "id", "v", cells).select("list", "c.cell", "id", "c.role", "v")


def nearest_vectors(
    vectors: DataFrame,
    id_col: str = "id",
    vector_col: str = "embedding",
    k: int = 10,
    least_similarity: float = -1.0,
    list_size: int = 1000,
    sample_rows: int = 65_536,
    sample_bytes: int = 64 << 20,
    replicate: float = 1.1,
    probe: float = 1.15,
    breadth: int = 32,
    replicas: int = 8,
    split_rows: int = 16_000,
    list_rows: int = 40_000,
) -> DataFrame:
    """``id, other, similarity``: of each vector, its ``k`` most similar others, at least ``least_similarity`` alike.

    Null vectors, zero vectors and vectors with null, NaN or infinite elements or of another than the usual
    dimension take no part; a repeated row counts once; among equally similar vectors any may be given. An empty
    table gives an empty result. ``sample_rows`` and ``sample_bytes`` bound the training sample (drawn by hash of the id); all rows
    are indexed. A larger ``replicate`` or ``probe`` (distance ratios), up to ``replicas`` lists to be stored in and ``breadth``
    lists to search, raises recall and work. Trains when called, and checkpoints the lists to count them.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    lanes = [F.xxhash64("v").alias("h0"), F.xxhash64(F.lit(1), F.col("v")).alias("h1")]
    directions = rows.groupBy(*lanes).agg(F.min("id").alias("id"), F.any_value("v").alias("v"), F.count(F.lit(1)).alias("m"))
    directions = cut(directions)
    n = directions.count()
    counted = directions.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "id long, other long, similarity float")
    if n < 2 and rows.count() < 2:
        return empty
    dimension = counted["d"]
    index = directions.filter(F.size("v") == dimension)
    sample_rows = min(sample_rows, sample_bytes // (4 * dimension))
    every = max(1, n // max(1, sample_rows))
    drawn = index.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0).select("v").toArrow()["v"].combine_chunks()
    sample = np.asarray(drawn.values.to_numpy(zero_copy_only=False), np.float32).reshape(-1, dimension)
    # Few vectors have shorter lists.
    lists = max(1, min(max(n // list_size, math.isqrt(n) // 4), len(sample) // 16))
    shared = spark.sparkContext.broadcast(CentroidGraph(sample, lists).arrays())
    how = {"replicate": replicate, "probe": probe, "breadth": breadth, "replicas": replicas}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph.of(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, own = batch.column(0).slice(start, 256), batch.column(1).slice(start, 256)
                data = np.asarray(own.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dimension)
                row, where, roles = _route(graph, data, np.full(len(data), _MEMBER | _QUERY, np.int8), how)
                packed = pa.array([v.tobytes() for v in data], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), ids.take(pa.array(row)), pa.array(roles), packed], ["list", "id", "role", "v"])

    routed = cut(index.select("id", "v").mapInArrow(route, _ROUTED))
    for level in range(1, _LEVELS):
        members = F.count_if(F.col("role").bitwiseAND(_MEMBER) > 0).alias("members")
        parts = F.ceil(F.count(F.lit(1)) / 50_000).alias("parts")
        # At most as many lists as there are rows over split_rows.
        large = routed.groupBy("list").agg(members, parts).filter(F.col("members") > split_rows).collect()
        if not large:
            break
        routed = cut(_finer(routed, spark.createDataFrame(large, "list long, members long, parts long"), level, dimension, list_size, how))

    def search(table: pa.Table) -> pa.Table:
        ids, roles = table["id"].to_numpy(), table["role"].to_numpy()
        data = _matrix(table["v"], dimension)
        member, query = (roles & _MEMBER) > 0, (roles & _QUERY) > 0
        found = _best(data[query], ids[query], data[member], ids[member], k, least_similarity)
        return pa.table(dict(zip(("id", "other", "similarity"), map(pa.array, found))))

    pairs = _in_cells(routed, list_rows).groupBy("list", "cell").applyInArrow(search, "id long, other long, similarity float")
    return _with_copies(rows, directions, lanes, _top(pairs, k), k, least_similarity)


def _with_copies(rows: DataFrame, directions: DataFrame, lanes: list[Column], near: DataFrame, k: int, least: float) -> DataFrame:
    """Put the copies of each direction back: they come first among each other's neighbours, up to ``k``."""
    repeated = directions.filter("m > 1").select("h0", "h1", F.col("id").alias("direction"))
    members = rows.select("id", *lanes).join(repeated, ["h0", "h1"]).select("direction", "id").distinct()
    # Only the k + 1 first members of a direction are ever neighbours; the rank limit is applied before the shuffle, too.
    place = F.row_number().over(Window.partitionBy("direction").orderBy("id"))
    firsts = (
        members.withColumn("place", place)
        .filter(F.col("place") <= k + 1)
        .groupBy("direction")
        .agg(F.sort_array(F.collect_list("id")).alias("firsts"))
        .filter(F.size("firsts") > 1)
    )
    others = F.slice(F.filter("firsts", lambda x: x != F.col("id")), 1, k)
    copies = members.join(firsts, "direction").select("id", F.explode(others).alias("other"), F.lit(1.0).cast("float").alias("similarity"))
    mine = firsts.select(F.col("direction").alias("id"), F.col("firsts").alias("mine"))
    theirs = firsts.select(F.col("direction").alias("other"), F.col("firsts").alias("theirs"))
    wide = (
        near.join(mine, "id", "left")
        .join(theirs, "other", "left")
        .withColumn("mine", F.coalesce("mine", F.array("id")))
        .withColumn("theirs", F.coalesce("theirs", F.array("other")))
    )
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.size("theirs")).over(before), F.lit(0))
    left = F.greatest(F.lit(0), k - (F.size("mine") - 1) - taken).cast("int")
    kept = wide.withColumn("theirs", F.slice("theirs", F.lit(1), left)).filter(F.size("theirs") > 0)
    spread = kept.select(F.explode("mine").alias("id"), "theirs", "similarity").select("id", F.explode("theirs").alias("other"), "similarity")
    return spread.unionByName(copies.filter(F.col("similarity") >= least))


def brute_force(vectors: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "embedding", modulus: int = 100) -> DataFrame:
    """``id, other, similarity`` for the query set of all ids divisible by ``modulus``, against all rows, exactly.

    The queries are broadcast in blocks of a fixed size; every block is one scan of the vectors.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col).dropDuplicates(["id"])
    asked = rows.filter(F.col("id") % modulus == 0)
    blocks = max(1, -(-asked.count() // 4096))
    parts = []
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        queries = np.vstack(mine["v"].to_numpy()) if len(mine) else np.zeros((0, 1), np.float32)
        shared = spark.sparkContext.broadcast((mine["id"].to_numpy(), queries))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, queries = shared.value
            for batch in batches:
                batch = batch[batch["v"].map(len) == queries.shape[1]]
                if len(batch) and len(queries):
                    found = _best(queries, ids, np.vstack(batch["v"].to_numpy()), batch["id"].to_numpy(), k, -1.0)
                    yield pd.DataFrame(dict(zip(("id", "other", "similarity"), found)))

        parts.append(rows.mapInPandas(scan, "id long, other long, similarity float"))
    return _top(reduce(DataFrame.unionByName, parts), k).drop("place")


def recall(vectors: DataFrame, found: DataFrame, k: int = 10, least_similarity: float = -1.0) -> DataFrame:
    """``n_true, n_found, recall`` of ``found`` against brute force on the query set."""
    truth = brute_force(vectors, k).filter(F.col("similarity") >= least_similarity)
    joined = truth.join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.try_divide("n_found", "n_true"))
