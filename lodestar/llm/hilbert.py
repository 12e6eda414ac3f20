"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to ``BITS`` bits each, the cell's index on the Hilbert curve is
computed, rows are sorted by that index, and the sorted run is cut into shards. Neighbours on the
curve are neighbours in every dimension, so each shard covers a small box of the metadata space and
a filter on any dimension prunes most files.

Law: ``rows`` - with N rows and S shards, the row of rank r goes to shard floor(r S / N), so counts
differ by at most one, and slots are ranks within the shard.

Dimensions of :func:`op8_hilbert`: language and source (their place among the sorted distinct values,
scaled to the axis: values share a cell where there are more than cells, and a range of the axis is a range
of values at any number) and the size in bytes on a logarithmic scale. Ties in the curve index are broken
by text checksum, id and size, so rows of one cell - even a third of the table - are spread by range over
tasks and shards. Rows equal in all of these are interchangeable; their place in the input breaks the tie.
The index is computed by bit operations on columns.

Distribution: only (id, size, checksum, index) are moved, not texts. The sorted light table is
written to the shared folder; ranks come from row positions inside the written partitions plus one
offset per partition.

Edge cases: null text has size 8 and the checksum of the empty text; null language, source or id form
a value of their own, before all others. Repeated rows each get a slot. An empty table yields no rows.
Columns of the input are carried whatever their names are; one named as a column that is added is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.blocks import BROADCAST_IDS, persisted, table

BITS = 8
SHARDS = 24


def curve_index(rows: DataFrame, cells: Sequence[Column], bits: int = BITS, name: str = "curve_index") -> DataFrame:
    """rows with the index along the curve of their cells, each below 2^bits.

    The transpose form: undo the curve's rotations and reflections from the highest bit down, Gray
    code the axes, then interleave their bits. bits * dimensions must be at most 63."""
    n = len(cells)
    if n * bits > 63:
        raise ValueError("the index must fit in 63 bits")
    axes = [f"__x{i}" for i in range(n)]
    out = rows.withColumns({x: c.cast("long") for x, c in zip(axes, cells)})
    x = [F.col(a) for a in axes]
    for b in range(bits - 1, 0, -1):
        low = F.lit((1 << b) - 1).cast("long")
        for i in range(n):
            flip = F.shiftright(x[i], b).bitwiseAND(1) == 1
            swap = F.when(flip, F.lit(0).cast("long")).otherwise(x[0].bitwiseXOR(x[i]).bitwiseAND(low))
            first = F.when(flip, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
            # a step is a projection of its own, so that expressions stay short
            out = out.withColumns({axes[0]: first} | ({axes[i]: x[i].bitwiseXOR(swap)} if i else {}))
    for i in range(1, n):
        out = out.withColumn(axes[i], x[i].bitwiseXOR(x[i - 1]))
    turn = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.shiftright(x[n - 1], b).bitwiseAND(1) == 1, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("__turn", turn)
    index = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(n):
            bit = F.shiftright(x[i].bitwiseXOR(F.col("__turn")), b).bitwiseAND(1)
            index = index.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
    return out.withColumn(name, index).drop("__turn", *axes)


def places(df: DataFrame, column: str) -> DataFrame:
    """(value, place, values): the distinct values of a column in sorted order, numbered from 0 by range and offset."""
    values = df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    ranged = persisted(values.orderBy("value").withColumn("at", F.monotonically_increasing_id()), "values")
    part, at = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    so_far = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    offsets = counts.select("part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("values"))
    return ranged.join(F.broadcast(offsets), part == F.col("part")).select("value", (F.col("before") + at).alias("place"), "values")


def with_ordinal(rows: DataFrame, column: str, name: str, bits: int = BITS) -> DataFrame:
    """rows with the cell of a categorical column: 1 + its place scaled to the axis, by one rule at any number of values. Null: 0."""
    found = persisted(places(rows, column), "places")
    cell = (1 + F.floor(F.col("place") * ((1 << bits) - 1) / F.col("values"))).cast("long")
    found = found.select(F.col("value").alias("__value"), cell.alias(name))
    small = found.count() <= BROADCAST_IDS
    joined = rows.join(F.broadcast(found) if small else found, F.col(f"`{column}`").cast("string") == F.col("__value"), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0))).drop("__value")


def magnitude(value: Column, bits: int = BITS, top: float = 40.0) -> Column:
    """Cell of a non-negative number on a logarithmic scale up to 2^top."""
    cells = 1 << bits
    return F.least(F.floor(F.log2(F.coalesce(value, F.lit(0)) + 1.0) * (cells / top)), F.lit(cells - 1)).cast("long")


def shard_by_curve(rows: DataFrame, dimensions: list[Column], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """rows with curve_index, shard (0 .. shards - 1) and slot (gapless from 0 in each shard)."""
    spark = rows.sparkSession
    indexed = curve_index(rows, dimensions, bits).withColumn("__row", F.monotonically_increasing_id())
    order = ["curve_index", *ties, "__row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = indexed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__row")
    placed = persisted(ranged.withColumn("__at", F.monotonically_increasing_id()), "curve")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("__part", part).withColumn("__at", at)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    so_far = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("__total"))
    shard = F.expr(f"CAST((__before + __at) * {shards} DIV __total AS INT)")
    first = F.expr(f"(shard * __total + {shards - 1}) DIV {shards}")  # the lowest rank of the shard
    out = placed.join(F.broadcast(offsets), "__part").withColumn("shard", shard).withColumn("slot", F.col("__before") + F.col("__at") - first)
    return out.drop("__part", "__at", "__before", "__total")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, sorted by slot, so that readers prune by min and max."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, along a curve over language, source and size."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    light = with_ordinal(with_ordinal(light, "lang", "lang_cell"), "source", "source_cell")
    dimensions = [F.col("lang_cell"), F.col("source_cell"), magnitude(F.col("size"))]
    out = shard_by_curve(light, dimensions, ["text_crc32", "doc_id", "size"])
    law = {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    return out.withColumns(law).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")
