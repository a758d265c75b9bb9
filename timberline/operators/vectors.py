"""Nearest vectors by cosine similarity, over an index of coarse lists.

Centroids are fitted by spherical k-means on a bounded sample; every row is then put on the list of its
nearest centroid, and a list keeps the angle of its farthest member. A search looks into the lists
nearest to a query. With ``exact=True`` a second pass looks into every other list that, by the
triangle inequality on angles, may still hold something as near as the ``k``-th found, so the result is that of
comparing with all rows. How many lists a share of the neighbours needs depends on how clustered the vectors are:
without ``probes`` that number is measured, by exact searches for ``TUNED`` of the indexed rows.

Lists and the queries that probe them are cut into blocks of bounded size, and each pair of blocks is one
matrix product in one task; a list with a great part of all rows, or one that all queries probe, becomes many
tasks. Each product gives at most ``k`` rows a query, of which the best ``k`` are merged.

What is fitted or broadcast is bounded by parameters: ``SAMPLE`` rows, and at most ``MAX_LISTS`` centroids.

Defined cases: a null, empty or zero vector, or one with a null or not finite number, has no direction; it is
on no list and finds nothing. Vectors of different lengths are an error. Similarities are rounded to ``DIGITS``
decimals; equal ones are ordered by id, null ids last. A row never finds itself, which means a row of its id;
repeated ids are found each on their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.session import materialize

SAMPLE = 20_000
MAX_LISTS = 4_096
# sampled rows that a centroid needs
PER_CENTROID = 8
ROUNDS = 10
# the share of the neighbours to be found where probes are not given, and by how many queries it is measured
RECALL, TUNED = 0.95, 256
# lists that an exact search looks into first
FIRST_PROBES = 4
DIGITS = 6
# rows of a list and queries that meet in one task
LIST_BLOCK, QUERY_BLOCK = 8_192, 4_096
_PRODUCT_ROWS = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; NaN where there is no direction."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if ((sizes != 0) & (sizes != width)).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(sizes.tolist()))}")
    out = np.full((len(sizes), width), np.nan)
    if width:
        out[sizes > 0] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _directed(units: np.ndarray) -> np.ndarray:
    return np.isfinite(units).all(axis=1) if units.shape[1] else np.zeros(len(units), bool)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over the unit rows of ``sample``, started from its first distinct rows."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centroids = sample[np.sort(first)[:lists]]
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        lengths = np.linalg.norm(sums, axis=1)
        kept = lengths > 1e-9
        centroids[kept] = sums[kept] / lengths[kept, None]
    return centroids


@dataclass
class VectorIndex:
    """``rows``: ``list, part, id, vector`` of every row with a direction."""

    rows: DataFrame
    centroids: np.ndarray
    angles: np.ndarray  # of each list's farthest member from its centroid
    parts: DataFrame  # list, parts: into how many blocks a list is cut

    def search(
        self, queries: DataFrame, k: int, id_col: str, vector_col: str, probes: int | None = None, exact: bool = False
    ) -> DataFrame:
        """``id, rank, neighbour, similarity``: the ``k`` nearest rows of every query."""
        if k < 1 or (probes is not None and probes < 1):
            raise ValueError("k and probes must be positive")
        if probes is None:
            probes = FIRST_PROBES if exact else self.probes_for(k)
        own = queries.select(queries[id_col].alias("id"), queries[vector_col].alias("vector"))
        return self._search(own, k, probes, exact).select("id", "rank", "neighbour", "similarity")

    def _search(self, own: DataFrame, k: int, probes: int, exact: bool) -> DataFrame:
        id_type = own.schema["id"].dataType.simpleString()
        # repeated queries are told apart by where they were read
        own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "queries")
        first = materialize(self._probed(own, id_type, self._nearest_lists(probes)), "probes")
        found = materialize(self._products(first, k), "found")
        if exact:
            kth = _best(found, k).where(F.col("rank") == k).select("row", F.col("similarity").alias("least"))
            more = own.join(kth, "row", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
            second = materialize(self._probed(more, id_type, self._other_lists(probes)), "probes")
            found = found.unionAll(materialize(self._products(second, k), "found"))
        return _best(found, k)

    def probes_for(self, k: int, share: float = RECALL, queries: int = TUNED) -> int:
        """How many lists hold ``share`` of the ``k`` nearest rows, by exact searches for ``queries`` indexed rows."""
        picked = materialize(self.rows.orderBy(F.xxhash64("id", "vector"), "id").limit(queries).select("id", "vector"), "tuned")
        found = self._search(picked, k, FIRST_PROBES, exact=True).groupBy("id", "list").agg(F.count("*").alias("n"))
        near = found.join(picked.dropDuplicates(["id"]), "id").select("list", "n", "vector").toArrow()
        if not near.num_rows:
            return 1
        similar = _units(_matrix(near["vector"])) @ self.centroids.T
        own = similar[np.arange(len(similar)), near["list"].to_numpy()]
        # the place of the list among those of its query
        place = 1 + (similar > own[:, None]).sum(axis=1)
        reached = np.cumsum(np.bincount(place, near["n"].to_numpy(), minlength=len(self.centroids) + 1))
        return max(1, int(np.searchsorted(reached, share * reached[-1])))

    def _nearest_lists(self, probes: int) -> Callable:
        def chosen(similar: np.ndarray, least: np.ndarray | None) -> np.ndarray:
            nth = np.argsort(np.argsort(-similar, axis=1, kind="stable"), axis=1)
            return nth < probes

        return chosen

    def _other_lists(self, probes: int) -> Callable:
        nearest, angles = self._nearest_lists(probes), self.angles

        def chosen(similar: np.ndarray, least: np.ndarray | None) -> np.ndarray:
            closest = np.maximum(np.arccos(np.clip(similar, -1, 1)) - angles, 0)
            # (a margin for rounding, of similarities and of angles)
            return ~nearest(similar, None) & (np.cos(closest) + 2e-6 >= least[:, None])

        return chosen

    def _probed(self, queries: DataFrame, id_type: str, chosen: Callable) -> DataFrame:
        """``list, row, id, vector``: a row for each list that a query looks into."""
        centroids = queries.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, _PRODUCT_ROWS):
                    batch = whole.slice(at, _PRODUCT_ROWS)
                    units = _units(_matrix(batch["vector"]))
                    some = np.flatnonzero(_directed(units))
                    if not len(some) or not len(centroids.value):
                        continue
                    least = batch["least"].to_numpy()[some] if "least" in batch.schema.names else None
                    query, to = np.nonzero(chosen(units[some] @ centroids.value.T, least))
                    picked = batch.select(["row", "id", "vector"]).take(pa.array(some[query]))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *picked.columns], ["list", "row", "id", "vector"])

        vector = queries.schema["vector"].dataType.simpleString()
        return queries.mapInArrow(run, f"list int, row bigint, id {id_type}, vector {vector}")

    def _products(self, probes: DataFrame, k: int) -> DataFrame:
        """``list, row, id, neighbour, similarity``: the best ``k`` of every pair of blocks."""
        busy = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
        cut = materialize(busy.join(self.parts, "list"), "cut")
        # as many rows as there are lists at most
        cut = F.broadcast(cut)
        left = (
            probes.join(cut, "list")
            .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            .select("list", "part", "block", "row", "id", "vector")
        )
        right = (
            self.rows.join(cut, "list")
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            .select("list", "part", "block", "id", "vector")
        )
        id_type, other = (t.schema["id"].dataType.simpleString() for t in (probes, self.rows))

        def multiplied(queries: pa.Table, rows: pa.Table) -> pa.Table:
            names = ["list", "row", "id", "neighbour", "similarity"]
            ids = rows["id"].combine_chunks()
            # ties go to the smaller id, so the rows are put in its order first
            order = pa.compute.sort_indices(ids)
            ids, units = ids.take(order), _units(_matrix(rows["vector"]))[order.to_numpy()]
            at, best, similarity = [], [], []
            own = _units(_matrix(queries["vector"])) if queries.num_rows and rows.num_rows else np.zeros((0, 0))
            places = {}
            for place, i in enumerate(ids.to_pylist()):
                places.setdefault(i, []).append(place)
            own_ids = queries["id"].to_pylist()
            for start in range(0, len(own), _PRODUCT_ROWS):
                similar = np.round(own[start : start + _PRODUCT_ROWS] @ units.T, DIGITS)
                for i in range(len(similar)):
                    similar[i, places.get(own_ids[start + i], []) if own_ids[start + i] is not None else []] = -3
                near = np.argsort(-similar, axis=1, kind="stable")[:, :k]
                near_values = np.take_along_axis(similar, near, 1)
                query, nth = np.nonzero(near_values > -3)
                at.append(query + start)
                best.append(near[query, nth])
                similarity.append(near_values[query, nth])
            at, best = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, best))
            picked = queries.select(["list", "row", "id"]).take(pa.array(at))
            # (0.0 and -0.0 are one similarity)
            values = np.concatenate([np.zeros(0), *similarity]) + 0.0
            return pa.Table.from_arrays([*picked.columns, ids.take(pa.array(best)), pa.array(values)], names)

        keys = ["list", "part", "block"]
        schema = f"list int, row bigint, id {id_type}, neighbour {other}, similarity double"
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiplied, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of a query, with their rank; partial results are cut before they are shuffled."""
    nearest = Window.partitionBy("row").orderBy(F.desc("similarity"), F.asc_nulls_last("neighbour"))
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def build_index(rows: DataFrame, id_col: str, vector_col: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Put every row with a direction on a list; ``lists`` is the root of their number if not given."""
    element = rows.schema[vector_col].dataType
    if not isinstance(element, T.ArrayType):
        raise ValueError(f"{vector_col} is no array of numbers")
    own = rows.select(rows[id_col].alias("id"), rows[vector_col].alias("vector"))
    own = own.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    total = own.count()
    if lists is None:
        lists = round(total**0.5)
    picked = own.orderBy(F.xxhash64("vector"), "id").limit(sample).select("vector").toArrow()["vector"]
    units = _units(_matrix(picked))
    units = units[_directed(units)]
    lists = max(1, min(lists, MAX_LISTS, len(units) // PER_CENTROID))
    centroids = fit_centroids(units, lists) if len(units) else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(_matrix(batch["vector"]))
            some = _directed(units)
            units = units[some]
            if not len(units):
                continue
            similar = units @ shared.value.T
            own = np.argmax(similar, axis=1)
            near = similar[np.arange(len(own)), own]
            kept = batch.filter(pa.array(some))
            columns = [pa.array(own, pa.int32()), pa.array(near), kept["id"], kept["vector"]]
            yield pa.RecordBatch.from_arrays(columns, ["list", "near", "id", "vector"])

    schema = f"list int, near double, id {own.schema['id'].dataType.simpleString()}, vector {element.simpleString()}"
    placed = materialize(own.mapInArrow(listed, schema).withColumn("_row", F.monotonically_increasing_id()), "listed")
    # one row for each list
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("parts"), F.min("near").alias("near"))
    sizes = materialize(sizes, "lists")
    angles = np.zeros(len(centroids))
    for row in sizes.collect():
        angles[row["list"]] = np.arccos(np.clip(row["near"], -1, 1))
    parts = sizes.select("list", "parts")
    cut = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")))
    return VectorIndex(materialize(cut.select("list", "part", "id", "vector"), "index"), centroids, angles, parts)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, wanted, found, recall`` of a search against an exact one."""
    own = found.select("id", "neighbour", F.lit(1).alias("hit")).distinct()
    marked = exact.join(own, ["id", "neighbour"], "left")
    return marked.agg(
        F.count_distinct("id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
