"""Exact top-k inner-product search over a vector-approximation file.

1. *File.* Every component's range within a block of vectors is cut into 256 cells. The approximation
   file is a table of blocks: the cell numbers, one byte a component, and the ranges. Exact vectors stay
   where they are.
2. *Scan.* Queries meet the file only. With c the centre of a vector's cells and w their half widths,
   its score lies within ``q.c +/- sum |q_d| w_d``. A scan keeps, for each query and block, the vectors
   whose upper bound is not below the k-th lower bound seen there.
3. *Read.* Per query, over all blocks, candidates are ordered by their upper bounds (descending: for an
   inner product the best bound comes first). The k best are read exactly; their k-th score then tells
   which of the rest can still matter, and just those are read. So the result is certain.

Distribution: blocks are packed where the vectors lie; queries are packed in chunks. Chunks and *lanes*
(a few blocks each) meet cell by cell, both of bounded size, so copies are of one-byte codes and of the
queries only, and their number falls with the sizes ``BLOCK_BYTES`` and ``CHUNK_BYTES``. Neither side is
broadcast and no table is collected. Of equal vectors only those rows go into the file that can reach a
result: the k first rows of each of the k + 1 smallest ids, found with partial limits before the shuffle, so
a vector that a third of all rows share costs no more than others.

Edge cases: rows whose id or vector is null, or whose vector is empty or holds a null or non-finite
component, take no part. Vectors meet only vectors of the same length. A row's own are all rows of its
id; rows that repeat an id are candidates, and queries, each for itself, and their results are ranked
together. Components beyond 64 bits after scaling count as the nearest 64-bit integer. Scores are exact at
any size; one beyond 64 bits is reported, and ranked, as the nearest. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.blocks import by_ids, discard, persisted, released, table

CELLS = 256
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 16 << 20
BLOCKS_A_LANE = 4
#: Vectors and queries that are compared at a time.
STRIP = 8192, 256

_MOST = (1 << 63) - 1


def to_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component) of each component, as double first; null where the vector takes no part."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = (F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = float(1 << 63)
    whole = F.transform(values, lambda x: F.greatest(F.least(x * scale, F.lit(limit)), F.lit(-limit)))
    return F.when(usable, F.transform(whole, lambda x: F.when(x >= limit, F.lit(_MOST)).when(x <= -limit, F.lit(-_MOST)).otherwise(F.floor(x))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(most: int, pack, schema: pa.Schema):
    """Rows (chunk, row, id, v) gathered by chunk and vector length, up to ``most`` bytes at 8 a component, and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, held, size = TaskContext.get().partitionId(), 0, {}, {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            parts = held.pop(key)
            size.pop(key)
            rows, ids, values = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_pylist([{"lane": key[0], "dim": key[1], "name": f"{task}-{serial}"} | pack(rows, ids, values)], schema=schema)

        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            lanes = batch.column("lane").to_numpy(zero_copy_only=False)
            for key in sorted(set(zip(lanes.tolist(), dims.tolist()))):
                own = batch.filter(pa.array((lanes == key[0]) & (dims == key[1])))
                held.setdefault(key, []).append((own.column("row").to_numpy(), own.column("id").to_numpy(), _matrix(own.column("v"), key[1])))
                size[key] = size.get(key, 0) + 8 * key[1] * own.num_rows
                if size[key] >= most:
                    yield out(key)
                    serial += 1
        for key in list(held):
            yield out(key)
            serial += 1

    return run


BLOCKS = "lane int, dim int, name string, rows binary, ids binary, low binary, width binary, cells binary"
CHUNKS = "lane int, dim int, name string, rows binary, ids binary, exact binary"


def _kind(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])


def approximate(rows: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> dict[str, bytes]:
    """A block of the approximation file."""
    values = exact.astype(np.float64)
    low, high = values.min(0), values.max(0)
    width = np.maximum((high - low) / CELLS, 1e-9)
    cells = np.clip((values - low) / width, 0, CELLS - 1).astype(np.uint8)
    return {"rows": rows.tobytes(), "ids": ids.tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": cells.tobytes()}


def scan(queries: np.ndarray, query_ids: np.ndarray, block: dict[str, bytes], k: int) -> tuple[np.ndarray, ...]:
    """(query, place in the block, lower bound, upper bound) of the candidates that the bounds leave."""
    low, width = np.frombuffer(block["low"]), np.frombuffer(block["width"])
    ids = np.frombuffer(block["ids"], np.int64)
    cells = np.frombuffer(block["cells"], np.uint8).reshape(len(ids), -1)
    found = []
    for at in range(0, len(queries), STRIP[1]):
        q, own = queries[at : at + STRIP[1]].astype(np.float64), query_ids[at : at + STRIP[1]]
        scaled, centre = q * width, q @ (low + width / 2)
        size = np.abs(q) @ (np.abs(low) + CELLS * width)
        exact = not np.isfinite(size).all() or float(size.max(initial=0)) > 1e30
        kind, error = (np.float64, 1e-11) if exact else (np.float32, 1e-5)
        # arithmetic rounds; bounds are widened by more than its error
        radius = np.abs(q) @ (width / 2) * (1 + 1e-9) + error * (1 + size)
        best, parts = np.full((len(q), k), -np.inf), []
        for a in range(0, len(cells), STRIP[0]):
            near = (scaled.astype(kind) @ cells[a : a + STRIP[0]].T.astype(kind)).astype(np.float64) + centre[:, None]
            near[own[:, None] == ids[None, a : a + STRIP[0]]] = -np.inf
            top = -np.partition(-near, k - 1, axis=1)[:, :k] if near.shape[1] > k else near
            best = -np.sort(-np.concatenate([best, top - radius[:, None]], 1), axis=1)[:, :k]
            i, j = np.nonzero((near + radius[:, None] >= best[:, -1:]) & (near > -np.inf))
            parts.append((i, j + a, near[i, j]))
        i, j, near = (np.concatenate(x) for x in zip(*parts))
        left = near + radius[i] >= best[i, -1]
        i, j, near = i[left], j[left], near[left]
        found.append((i + at, j, near - radius[i], near + radius[i]))
    return tuple(np.concatenate(x) for x in zip(*found))


FOUND = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])


def _scan_cell(k: int):
    def work(cell: pa.Table) -> pa.Table:
        rows = [cell.slice(i, 1) for i in range(cell.num_rows)]
        one = lambda r, c: r.column(c)[0].as_py()
        chunks, blocks = ([r for r in rows if one(r, "is_query") == kind] for kind in (True, False))
        out = []
        for r in chunks:
            own, ids = (np.frombuffer(one(r, c), np.int64) for c in ("rows", "ids"))
            queries = np.frombuffer(one(r, "exact"), np.int64).reshape(len(own), -1)
            for b in blocks:
                block = {c: one(b, c) for c in ("rows", "ids", "low", "width", "cells")}
                i, j, lower, upper = scan(queries, ids, block, k)
                out.append(pa.Table.from_arrays([pa.array(own[i]), pa.array(np.frombuffer(block["rows"], np.int64)[j]), pa.array(lower), pa.array(upper)], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return work


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of rows (q, query_id, vec_id, upper, qv, cv)."""
    for batch in batches:
        scores = np.zeros(batch.num_rows, np.int64)
        dims = batch.column("qv").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            x, y = (_matrix(batch.column(c).take(pa.array(own)), dim) for c in ("qv", "cv"))
            fits = np.abs(x.astype(np.float64)).max(1) * np.abs(y.astype(np.float64)).max(1) * dim < 1 << 62
            scores[own[fits]] = (x[fits] * y[fits]).sum(1)
            wide = (x[~fits].astype(object) * y[~fits].astype(object)).sum(1)
            scores[own[~fits]] = [max(-_MOST, min(_MOST, int(s))) for s in wide]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "query_id", "vec_id", "upper")), pa.array(scores)], names=["q", "query_id", "vec_id", "upper", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other vectors for each query row."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), to_integers(F.col(f"`{vector_col}`"), scale).alias("v"), is_query.alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    rows = persisted(rows, "vectors")
    alike, smallest = W.partitionBy("v", "id").orderBy("row"), W.partitionBy("v").orderBy("id")
    able = rows.select("row", "id", "v").withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= k)
    able = able.withColumn("r", F.dense_rank().over(smallest)).filter(F.col("r") <= k + 1).select(F.lit(0).alias("lane"), "row", "id", "v")
    file = persisted(able.mapInArrow(released(_packed(8 * BLOCK_BYTES, approximate, _kind(BLOCKS))), BLOCKS), "approximation")

    size = rows.filter("asked").agg(F.sum(8 * F.size("v"))).first()[0] or 0
    lanes, chunks = max(1, file.count() // BLOCKS_A_LANE), max(1, -(-size // CHUNK_BYTES))
    plain = lambda own, ids, exact: {"rows": own.tobytes(), "ids": ids.tobytes(), "exact": exact.tobytes()}
    asked = rows.filter("asked").select(F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("lane"), "row", "id", "v")
    asked = asked.repartition(min(chunks, 1 << 16), "lane").mapInArrow(released(_packed(2 * CHUNK_BYTES, plain, _kind(CHUNKS))), CHUNKS)
    # every chunk of queries visits every lane of the file
    asked = asked.withColumnRenamed("lane", "chunk").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("is_query", F.lit(True))
    blocks = file.withColumn("lane", F.pmod(F.xxhash64("name", "dim"), F.lit(lanes)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("is_query", F.lit(False))
    cells = blocks.unionByName(asked, allowMissingColumns=True)
    found = cells.groupBy("chunk", "lane", "dim").applyInArrow(_scan_cell(k), "q long, c long, lower double, upper double")
    found = persisted(found, "candidates")

    by_lower, by_upper = W.partitionBy("q").orderBy(F.desc("lower")), W.partitionBy("q").orderBy(F.desc("upper"), "c")
    sure = found.withColumn("r", F.row_number().over(by_lower)).filter(F.col("r") == k).select("q", F.col("lower").alias("sure"))
    left = found.join(sure, "q", "left").filter(F.col("sure").isNull() | (F.col("upper") >= F.col("sure")))
    left = persisted(left.withColumn("r", F.row_number().over(by_upper)).select("q", "c", "upper", "r"), "ordered")

    def read(pairs: DataFrame, name: str) -> DataFrame:
        needed = by_ids(rows.select(F.col("row").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("cv")), pairs.select("c").distinct(), "left_semi")
        queries = rows.filter("asked").select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
        joined = pairs.join(needed, "c").join(queries, "q").select("q", "query_id", "vec_id", "upper", "qv", "cv")
        return persisted(joined.mapInArrow(released(_exact), "q long, query_id long, vec_id long, upper double, score long"), name)

    first = read(left.filter(F.col("r") <= k), "read")
    kth = first.groupBy("q").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    rest = read(left.filter(F.col("r") > k).join(kth, "q").filter(F.col("upper") >= F.col("kth")).select("q", "c", "upper"), "rest")
    discard(file, found, left)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = first.union(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op1_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for every vector whose id is divisible by 50, against all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
