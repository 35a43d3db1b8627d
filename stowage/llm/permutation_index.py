"""Approximate nearest neighbours by largest inner product, through a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of its
first `POSTED` pivots, and a query reads the files of its first `READ` ones. What it meets there is
ranked by the footrule distance of the first `RANKED` places of both orders, and the best
`reranked(n)` are ranked again by their inner product in double precision.

The pivots are a bounded sample (`PIVOTS` distinct vectors, those of the least hash); every vector is
indexed. Inner products become angles by one more component, sqrt(largest norm^2 - norm^2), which is 0
in queries. Equal vectors are one entry that knows its least ids, as many as a query can report, so a
vector that a third of the rows share costs what any other costs.

Files and the queries that read them are cut into cells by counted sizes, so that no cell holds more
than `CELL_VECTORS` by `CELL_QUERIES`; a pair meets in the first file that both name and nowhere else.
Two passes over the cells: the first counts footrules, which gives every query the distance its
`reranked(n)` best keep within (ties included); the second takes the inner products of those. A query
that met too few entries to fill its answer is compared with all entries, in cells as well.

What has no place: vectors null, zero or with null or non-finite components. Shorter vectors count as
filled up with zeros. Rows without an id are found, last among ties, but are no queries; rows of the
query's own id are not found. Rows repeated with id and vector count once. An id that occurs with
several vectors is one query for each, and may get fewer answers. An empty table has no answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import small_batches
from stowage.session import settle, settle_observed

PIVOTS = 256
POSTED = 8
READ = 32
RANKED = 128
CELL_VECTORS = 65_536
CELL_QUERIES = 4_096
# Entries whose footrules are taken at once, so that they stay in a core's cache.
BLOCK = 1024
# Footrules are counted in steps of this size.
STEP = 128


def reranked(n: int, k: int) -> int:
    """How many entries of the least footrule are ranked again: a root of their number, 10 k at least."""
    return max(10 * k, math.ceil(12 * math.sqrt(n)))


def usable(rows: DataFrame) -> DataFrame:
    """(id, vector in doubles, squared norm) of the rows that take part."""
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # makes -0.0 zero
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    kept = rows.where(F.col("embedding").isNotNull()).where(finite)
    kept = kept.select(F.col("vec_id").cast("bigint").alias("id"), vector.alias("vector"))
    return kept.distinct().withColumn("norm2", norm2).where("norm2 > 0")


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their least ids: one more than a query reports, for its own may be among them."""
    same = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last())
    least = vectors.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return least.groupBy("vector").agg(ids.alias("ids"), F.first("norm2").alias("norm2")).select("ids", "vector", "norm2")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists as the rows of a matrix, short ones filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    filled = np.zeros((len(lengths), int(lengths.max(initial=0))))
    filled[np.arange(filled.shape[1]) < lengths[:, None]] = flat
    return filled


class Pivots:
    """The pivots with their further component, and the orders that they give."""

    def __init__(self, vectors: list[list[float]], top: float):
        self.top = top
        width = max(map(len, vectors), default=0)
        plain = np.array([[*v, *[0.0] * (width - len(v))] for v in vectors]).reshape(len(vectors), width)
        self.matrix = np.hstack([plain, self.lift(np.einsum("ij,ij->i", plain, plain))[:, None]])

    def lift(self, norm2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - norm2, 0.0))

    def orders(self, vectors: np.ndarray, norm2: np.ndarray | None) -> np.ndarray:
        """Ranked pivots of entries; of queries, if no norms are given."""
        width = min(self.matrix.shape[1] - 1, vectors.shape[1])
        near = vectors[:, :width] @ self.matrix[:, :width].T
        if norm2 is not None:
            near += self.lift(norm2)[:, None] * self.matrix[:, -1]
        return np.argsort(-near, axis=1, kind="stable")[:, :RANKED].astype("u1" if len(self.matrix) <= 256 else "<u2")


def choose(found: DataFrame, top: float, pivots: int = PIVOTS) -> Pivots:
    """The bounded sample: `pivots` entries, each a vector, on the driver."""
    by_hash = [F.xxhash64("vector"), F.col("vector")]
    return Pivots([r["vector"] for r in found.select("vector").orderBy(*by_hash).limit(pivots).collect()], top)


def represented(rows: DataFrame, pivots: Pivots, queries: bool) -> DataFrame:
    """Add `perm`, the ranked pivots in bytes, and `lists`, the files to be posted in or read."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors
    lists = READ if queries else POSTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm2 = None if queries else batch.column("norm2").to_numpy()
            orders = shared.value.orders(_matrix(batch.column("vector")), norm2)
            perm = pa.array([order.tobytes() for order in orders], pa.binary())
            files = pa.array(orders[:, :lists].astype("i4").tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, perm, files], [*batch.schema.names, "perm", "lists"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, perm binary, lists array<int>")


# ---------------------------------------------------------------- cells


def _posted(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode("lists").alias("file")).drop("lists")


def _sizes(entries_: DataFrame, queries: DataFrame) -> DataFrame:
    """Into how many parts each file and its readers are cut: a row per pivot at most."""

    def cuts(rows: DataFrame, most: int, name: str) -> DataFrame:
        cut = F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name)
        return rows.select(F.explode("lists").alias("file")).groupBy("file").agg(cut)

    return cuts(entries_, CELL_VECTORS, "v_cuts").join(cuts(queries, CELL_QUERIES, "q_cuts"), "file")


def _dealt(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Every row in its part of each file, once for each part of the other side."""
    dealt = _posted(rows).join(F.broadcast(sizes), "file")
    part = F.pmod(F.xxhash64("vector"), F.col(own)).cast("int")
    dealt = dealt.withColumn(own[0], part).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    return dealt.drop("v_cuts", "q_cuts")


def _orders(column: pa.ChunkedArray, pivots: int) -> np.ndarray:
    kind = "u1" if pivots <= 256 else "<u2"
    return np.array([np.frombuffer(x, kind) for x in column.to_pylist()]).astype("i4")


class Cell:
    """Part of a file, against one reading query after the other."""

    def __init__(self, file: int, orders: np.ndarray, pivots: int):
        self._file, self._pivots = file, pivots
        self._ranked = orders.shape[1]
        self._heads = np.ascontiguousarray(orders[:, :POSTED].T)
        # The place of every pivot in every entry's order, in bytes; rows are filled up to whole words.
        self._places = np.zeros((len(orders), -(-pivots // 8) * 8), "u1")
        self._places[:, :pivots] = self._ranked
        own = np.broadcast_to(np.arange(self._ranked, dtype="u1"), orders.shape)
        np.put_along_axis(self._places, orders, own, axis=1)

    def footrules(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries whose first common file with the query this is, their footrules).

        A pivot that one of the two does not rank counts as in place `ranked`.
        """
        ranked = self._ranked
        place = np.zeros(self._places.shape[1], "u1")
        place[: self._pivots] = ranked
        place[order] = np.arange(len(order), dtype="u1")
        read = np.where(place < READ, place, np.uint8(ranked))
        mine = np.flatnonzero(np.take(read, self._heads).min(axis=0) == place[self._file]) if self._file >= 0 else np.arange(len(self._places))
        # |x - y| is 2 max(x, y) - x - y, and all orders have the same sum of places.
        sums = np.empty(len(mine), "i4")
        for at in range(0, len(mine), BLOCK):
            sums[at : at + BLOCK] = _byte_sums(np.maximum(self._places[mine[at : at + BLOCK]], place))
        return mine, 2 * sums - 2 * (ranked * (ranked - 1) // 2 + (self._pivots - ranked) * ranked)


def _byte_sums(rows: np.ndarray) -> np.ndarray:
    """Sums of rows of up to 1024 bytes, which four 16-bit counters in a word hold."""
    pairs = rows.view("u2")
    words = ((pairs & np.uint16(255)) + (pairs >> np.uint16(8))).view("u8").sum(axis=1)
    return words.view("u2").reshape(-1, 4).sum(axis=1, dtype="i4")


def _table(columns: tuple[list, ...], **kinds: pa.DataType) -> pa.Table:
    return pa.table({name: pa.array(column, kind) for column, (name, kind) in zip(columns, kinds.items())})


def _search(sides: tuple[DataFrame, DataFrame], run, schema: str) -> DataFrame:
    entries_, queries = (side.groupBy("file", "v", "q") for side in sides)
    return queries.cogroup(entries_).applyInArrow(run, schema)


def counted(sides: tuple[DataFrame, DataFrame], pivots: int, wanted: int) -> DataFrame:
    """(query, footrule in steps, entries as far as that) per cell, until `wanted` entries are met."""

    def run(key: tuple, queries: pa.Table, entries_: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and entries_.num_rows:
            cell = Cell(key[0].as_py(), _orders(entries_["perm"], pivots), pivots)
            for query, order in zip(queries["query"].to_pylist(), _orders(queries["perm"], pivots)):
                _, footrules = cell.footrules(order)
                values, counts = np.unique(footrules // STEP, return_counts=True)
                enough = int(np.searchsorted(np.cumsum(counts), wanted)) + 1
                out[0].extend([query] * len(values[:enough]))
                out[1].extend(values[:enough].tolist())
                out[2].extend(counts[:enough].tolist())
        return _table(out, query=pa.int64(), footrule=pa.int32(), n=pa.int64())

    return _search(sides, run, "query bigint, footrule int, n bigint")


def scored(sides: tuple[DataFrame, DataFrame], pivots: int, k: int) -> DataFrame:
    """The best entries of each query within its footrule, per cell: (query, ids, score)."""

    def run(key: tuple, queries: pa.Table, entries_: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and entries_.num_rows:
            cell = Cell(key[0].as_py(), _orders(entries_["perm"], pivots), pivots)
            vectors, ids = _matrix(entries_["vector"].combine_chunks()), entries_["ids"].to_pylist()
            asked = _matrix(queries["vector"].combine_chunks())
            width = min(asked.shape[1], vectors.shape[1])
            numbers, limits = queries["query"].to_pylist(), queries["within"].to_pylist()
            for query, vector, within, order in zip(numbers, asked, limits, _orders(queries["perm"], pivots)):
                mine, footrules = cell.footrules(order)
                if within is not None:
                    mine = mine[footrules // STEP <= within]
                scores = vectors[mine, :width] @ vector[:width]
                if len(mine) > k + 1:  # ties with the last one stay, for ids decide among them
                    least = -np.partition(-scores, k)[k]
                    mine, scores = mine[scores >= least], scores[scores >= least]
                out[0].extend([query] * len(mine))
                out[1].extend(ids[i] for i in mine.tolist())
                out[2].extend(scores.tolist())
        return _table(out, query=pa.int64(), ids=pa.list_(pa.int64()), score=pa.float64())

    return _search(sides, run, "query bigint, ids array<bigint>, score double")


# ---------------------------------------------------------------- search


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best entries of each query vector, of which its own may be one."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)).asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")


def _met(best: DataFrame) -> DataFrame:
    return best.groupBy("query").agg(F.sum(F.size("ids")).alias("met"))


def nearest(rows: DataFrame, is_query: Column | str, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `is_query` holds.

    Input: vec_id, embedding; other columns are left out.
    """
    usable_rows, seen = settle_observed(usable(rows.select("vec_id", "embedding")), top=F.max("norm2"))
    if seen["top"] is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found, n = settle(entries(usable_rows, k))
    pivots = choose(found, seen["top"])
    many = len(pivots.matrix)
    index, _ = settle(represented(found, pivots, queries=False))

    asking = usable_rows.withColumnRenamed("id", "vec_id").where(is_query).where("vec_id is not null")
    asking = asking.select(F.col("vec_id").alias("id"), "vector")
    # Written before it is used, so that the numbers hold however often a task is run again.
    numbered, _ = settle(asking.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()))
    queries, _ = settle(represented(numbered, pivots, queries=True))

    sizes, _ = settle(_sizes(index, queries))
    names = ("v_cuts", "q_cuts")
    light = _dealt(index.select("vector", "perm", "lists"), sizes, *names).drop("vector")
    readers = _dealt(queries, sizes, *reversed(names))
    wanted = reranked(n, k)
    counts = counted((light, readers.drop("vector")), many, wanted)
    so_far = F.sum("n").over(Window.partitionBy("query").orderBy("footrule"))
    summed = counts.groupBy("query", "footrule").agg(F.sum("n").alias("n")).withColumn("so_far", so_far)
    # The last footrule that begins before enough entries are met.
    within = summed.where(F.col("so_far") - F.col("n") < wanted).groupBy("query").agg(F.max("footrule").alias("within"))
    limits, _ = settle(within)
    bounded = queries.join(limits, "query")
    heavy = _dealt(index.select("ids", "vector", "perm", "lists"), sizes, *names)
    best, _ = settle(_best(scored((heavy, _dealt(bounded, sizes, *reversed(names))), many, k), k))

    available = int(usable_rows.count())
    short, few = settle(
        queries.join(_met(best), "query", "left").where(
            F.coalesce("met", F.lit(0)) < F.least(F.lit(k + 1), F.lit(available))
        )
    )
    if few:
        everything = F.array(F.lit(-1))
        all_entries, all_asking = index.withColumn("lists", everything), short.withColumn("lists", everything)
        sizes, _ = settle(_sizes(all_entries, all_asking))
        asked = all_asking.drop("met").withColumn("within", F.lit(None).cast("int"))
        sides = (_dealt(all_entries.drop("norm2"), sizes, *names), _dealt(asked, sizes, *reversed(names)))
        again = _best(scored(sides, many, k), k)
        best = best.join(short.select("query"), "query", "left_anti").unionByName(again)

    lists = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("entries"))  # k + 1 at most
    answers = asking.join(numbered.hint("merge"), "vector").join(lists.hint("merge"), "query")
    answers = answers.select("id", "query", F.explode("entries").alias("entry"))
    answers = answers.select(F.col("id").alias("query_id"), "query", "entry.score", F.explode("entry.ids").alias("vec_id"))
    answers = answers.where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
