"""Readings of a text column by a dictionary table (surface, reading, cost).

A dictionary is read in surface order, in blocks of DICTIONARY_ROWS.  Each block is a
double array that is sent to the tasks.  With one block a text is read in one pass; with more,
every pass adds its block's occurrences to the rows, each pass is cut, and the last one lays
the cheapest path over all of them.

Cases: a null text has no reading.  Dictionary rows with a null or an empty surface, a null
reading or a null cost are left out; of rows with one surface the cheapest counts, then the least
reading.  An empty dictionary reads digits and kana only.  A character that no word covers stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.functions import kana, lattice
from skriva.operators.lineage import cut

DICTIONARY_ROWS = 500_000
#: Bytes of an Arrow batch that are Python objects at a time.
SLICE = 1 << 18
FOUND = "array<struct<start:int,end:int,cost:bigint,reading:string>>"


def _rows(dictionary: DataFrame) -> DataFrame:
    rows = dictionary.select(F.col("surface").cast("string"), F.col("reading").cast("string"), F.col("cost").cast("bigint"))
    rows = rows.where("surface is not null and surface <> '' and reading is not null and cost is not null")
    return rows.groupBy("surface").agg(F.min(F.struct("cost", "reading")).alias("b")).select("surface", "b.reading", "b.cost")


def _blocks(dictionary: DataFrame, limit: int) -> Iterator[list[tuple[str, str, int]]]:
    block = []
    for row in _rows(dictionary).orderBy("surface").toLocalIterator():
        block.append(tuple(row))
        if len(block) == limit:
            yield block
            block = []
    if block:
        yield block


def whole_reader(dictionary: DataFrame, unknown: int = lattice.UNKNOWN, limit: int = DICTIONARY_ROWS) -> Broadcast:
    """A dictionary of at most ``limit`` surfaces, sent to every task."""
    rows = _rows(dictionary).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the dictionary has more than {limit} surfaces; with_readings takes it in blocks")
    return dictionary.sparkSession.sparkContext.broadcast(lattice.Reader([tuple(r) for r in rows], unknown))


def with_readings(rows: DataFrame, text: str, dictionary: DataFrame, out: str = "reading", read_digits: bool = False, unknown: int = lattice.UNKNOWN, block_rows: int = DICTIONARY_ROWS) -> DataFrame:
    """``rows`` with ``out``: the text's reading in hiragana where the dictionary and the kana give one."""
    spark = rows.sparkSession
    blocks = _blocks(dictionary, block_rows)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        sent = spark.sparkContext.broadcast(lattice.Reader(block, unknown))

        @F.arrow_udf("string")
        def read(texts: pa.Array) -> pa.Array:
            return by_slices(some, texts)

        def some(texts: list[str | None]) -> list[str | None]:
            said = iter(kana.to_kana_all([t for t in texts if t is not None], read_digits, sent.value))
            return [None if t is None else next(said) for t in texts]

        return rows.withColumn(out, read(F.col(text)))

    @F.arrow_udf("string")
    def digits(texts: pa.Array) -> pa.Array:
        return by_slices(lambda ts: [None if t is None else kana.read_all_digits(t) for t in ts], texts)

    @F.arrow_udf("string")
    def laid(texts: pa.Array, found: pa.Array) -> pa.Array:
        return by_slices(lambda ts, fs: [None if t is None else kana.fold(_lay(t, f or [], unknown)) for t, f in zip(ts, fs, strict=True)], texts, found)

    held = rows.withColumns({"_said": digits(F.col(text)) if read_digits else F.col(text), "_found": F.lit(None).cast(FOUND)})
    while block is not None:
        held = cut(held.withColumn("_found", F.concat(F.coalesce("_found", F.array().cast(FOUND)), _finder(spark.sparkContext.broadcast(lattice.Reader(block, unknown)))(F.col("_said")))))
        block, following = following, next(blocks, None)
    return held.withColumn(out, laid("_said", "_found")).drop("_said", "_found")


def slices(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows of about SLICE bytes; a longer row is a run of its own."""
    n = len(columns[0])
    size = np.zeros(n)
    for c in columns:
        size += 8 * np.diff(np.asarray(c.offsets)) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else np.asarray(pc.fill_null(pc.binary_length(c), 0))
    lo, held = 0, 0.0
    for k, x in enumerate((size + 16).tolist()):
        if held and held + x > SLICE:
            yield lo, k - lo
            lo, held = k, 0.0
        held += x
    if n:
        yield lo, n - lo


def by_slices(f: Callable[..., list[str | None]], *columns: pa.Array) -> pa.Array:
    """Texts made by ``f`` of the rows of an Arrow batch, of which only a slice is Python objects at a time."""
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(f(*(c.slice(lo, n).to_pylist() for c in columns)), pa.string()) for lo, n in slices(*columns))])


def _finder(sent: Broadcast):
    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        reader, rows = sent.value, []
        for text in texts.to_pylist():
            start, end, cost, reading = reader.find([text or ""])
            rows.append([dict(zip(("start", "end", "cost", "reading"), x, strict=True)) for x in zip(start.tolist(), end.tolist(), cost.tolist(), reading.tolist(), strict=True)])
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("reading", pa.string())])))

    return find


def _lay(text: str, found: list[dict], unknown: int) -> str:
    start, end, cost = (np.array([f[c] for f in found], np.int64) for c in ("start", "end", "cost"))
    return lattice.lay([text], start, end, cost, np.array([f["reading"] for f in found], object), unknown)[0]
