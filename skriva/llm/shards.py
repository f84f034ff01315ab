"""Shards of a corpus in uniformly random order, by an external shuffle in two passes.

The first pass scatters records by a seeded hash into buckets that fit in memory.  The
second orders each bucket by its hashes and shuffles it by Fisher and Yates, with draws
seeded by the bucket, so that a repeated task repeats the order.  Buckets one after the other are one order
of the whole corpus; where a bucket begins in it follows from counts, by a prefix scan.
Shards are equal cuts of that order: their numbers of rows differ by one at most.
Every bucket is written to the folders of its shards as it leaves memory.

A record repeated so often that it would fill a good part of a bucket is not scattered
row by row, as equal rows hash alike: one of it and its count are kept, and its copies, numbered, hash with their number.

Cases: rows with null or repeated ids and null or empty texts are rows like others; rows equal
in all columns are interchangeable.  Fewer rows than shards leave shards empty.  An empty
table gives an empty result.  Further columns are carried; ``shard`` and ``slot`` replace columns so named.
Columns that hold maps take no part in the hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.llm.support import cut, shared_dir, small_side
from skriva.operators.scan import before

BUCKET_BYTES = 16 << 20
SHARDS = 40
#: Copies of one record that are numbered in one task.
RUN = 10_000


def size_of(text: Column) -> Column:
    """Bytes of a text in UTF-8, none for null, and 16 for the rest of a record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16


def draws(seed: int, bucket: int, n: int) -> np.ndarray:
    """A place in 0..i for each i below n: 64 bits of a counter that a finaliser spreads, scaled."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x632BE59BD9B4E019 + bucket * 0xD1342543DE82EF95) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) / 2.0**53 * np.arange(1, n + 1)).astype(np.int64)


def fisher_yates(seed: int, bucket: int, n: int) -> list[int]:
    """The order in which a bucket of n records is written."""
    order = list(range(n))
    places = draws(seed, bucket, n).tolist()
    for i in range(n - 1, 0, -1):
        j = places[i]
        order[i], order[j] = order[j], order[i]
    return order


def cut_at(position: np.ndarray, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of positions in the whole order; the first shards have one row more where it does not come out even."""
    least, more = divmod(rows, shards)
    wide = more * (least + 1)
    late = position - wide
    shard = np.where(late < 0, position // (least + 1), more + late // max(least, 1))
    return shard, position - np.where(late < 0, shard * (least + 1), wide + (shard - more) * least)


def _hash(seed: int, columns: list[str], *more: Column) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in columns), *more)


def _repeated(rows: DataFrame, hot: DataFrame, seed: int, plain: list[str]) -> DataFrame:
    """The rows of ``hot`` digests once each, then again as often as they are there, each copy hashed with its number."""
    one = rows.join(hot.select("h1", "h2", "n"), ["h1", "h2"]).groupBy("h1", "h2", "n").agg(F.first(F.struct(*(c for c in rows.columns if c not in ("h1", "h2")))).alias("r"))
    runs = one.select("r", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))).alias("run")).repartition("run")
    copies = runs.select("r.*", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, "n") - 1)).alias("_copy"))
    return copies.withColumns({"h1": F.xxhash64(_hash(seed, plain), "_copy"), "h2": F.xxhash64(_hash(seed + 1, plain), "_copy")}).drop("_copy")


def write_shards(docs: DataFrame, folder: str | None = None, shards: int = SHARDS, text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` shuffled, with shard and slot (from 0, without gaps), written to ``folder``/shard=k and read from there."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    docs = docs.drop("shard", "slot")
    names = docs.columns
    columns = [f"c{k}" for k in range(len(names))]  # nothing clashes with what is added
    plain = [c for c, f in zip(columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    rows = docs.toDF(*columns).select(*columns, _hash(seed, plain).alias("h1"), _hash(seed + 1, plain).alias("h2"))
    text = F.col(columns[names.index(text_col)])

    # what there is: digests with their number and size, then totals
    digests = cut(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum(size_of(text)).alias("size")))
    total = digests.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    n, buckets = total.n or 0, max(1, -(-(total.size or 0) // bucket_bytes))
    hot = cut(digests.where(f"n > 1 and size > {bucket_bytes // 8}"))
    any_hot = not hot.isEmpty()
    if any_hot:
        again = _repeated(rows, small_side(hot, 32), seed, plain)
        rows = rows.join(small_side(hot.select("h1", "h2"), 16), ["h1", "h2"], "left_anti").select(*columns, "h1", "h2").unionByName(again)
    bucket = F.pmod("h1", F.lit(buckets))
    rows = rows.withColumn("bucket", bucket)

    # where each bucket begins
    counted = rows.groupBy("bucket").agg(F.count("*").alias("n")) if any_hot else digests.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    starts = before(cut(counted), [], "bucket", "n", F.lit(0), lambda a, b: a + b, buckets).select("bucket", "before")

    def shuffled(records: pa.Table, start: pa.Table) -> pa.Table:
        at = np.lexsort((records.column("h2").to_numpy(), records.column("h1").to_numpy()))
        order = at[fisher_yates(seed, start.column("bucket")[0].as_py(), len(at))]
        shard, slot = cut_at(np.arange(len(order)) + start.column("before")[0].as_py(), n, shards)
        out = records.select(columns).take(pa.array(order))
        return out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema, strict=True)) + ", shard int, slot bigint"
    out = rows.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(shuffled, schema)
    out = out.sortWithinPartitions("shard", "slot").toDF(*names, "shard", "slot")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)
