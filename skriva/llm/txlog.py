"""Reassembly of a log of interleaved transactions.

A log has records (at, source, op, key, value) with the operations commit, abort,
savepoint, rollback and change.  Each source runs one transaction after the other; a
commit, an abort or the end of the log (an abort) ends it.  A rollback undoes what its
transaction has changed and not undone since its latest savepoint, or since its start,
and removes that savepoint.

``resolve`` deals the log into chunks by ranges of ``at`` and reads each chunk once with a stack
of segments a source.  What is decided inside a chunk leaves it decided.  What is not
is summed up: unmatched rollbacks, open savepoints and ends of each source, and the
pending changes with their segment.  Summaries combine associatively; a prefix scan over
the chunks gives the savepoints and the transaction that each chunk starts with.  With these a pending
segment has an absolute level, and what decides it is the next chunk's rollback to that
level or end of that transaction.  A source's share of the log does not matter: chunks hold records of all
sources, and a source has at most one summary a chunk and one segment a level.

``states`` applies committed changes to one store, by blocks of epochs whose carried-in
values come from the same scan.  Nothing that grows with the log passes through one task,
the driver or a broadcast.

Cases: records without ``at`` or with an unknown operation are left out.  A null source is
one source.  Records with equal ``at`` follow each other by a hash of the rest, then by the rest; repeated records count each.
An empty log gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriva.llm.support import cut
from skriva.operators.scan import before

#: Records a chunk at most, where the session's shuffle partitions would make them larger.
CHUNK_ROWS = 500_000
#: Epochs whose changes of one key, and whose sums, are ordered in one task.
EPOCH_BLOCK = 256
OPS = ("commit", "abort", "savepoint", "rollback", "change")
_OUT = "tag string, chunk int, source string, rec bigint, at bigint, key bigint, value bigint, nth bigint, more bigint, ended boolean, fate string, by_rec bigint, by_at bigint"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


class _Source:
    """What a chunk has seen of one source."""

    __slots__ = ("ends", "first_end", "popped", "stack")

    def __init__(self):
        self.stack: list[list[tuple]] = [[]]
        self.popped, self.ends, self.first_end = 0, 0, None


def read_chunk(chunk: int, records: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of _OUT for the records (at, source, op, key, value) of one chunk in order.

    done: a change and its fate.  pop: a rollback to a segment of an earlier chunk.  commit: with its number in
    the chunk.  At the end open: a change and its level over that at which the chunk's last transaction began here.
    sum: unmatched rollbacks (nth), open savepoints (more), whether and by what the first transaction ended, number of ends (value).
    """
    seen: dict[str, _Source] = {}
    commits = 0
    for k, (at, source, op, key, value) in enumerate(records):
        rec = (chunk << 40) + k
        s = seen.get(source)
        if s is None:
            s = seen[source] = _Source()
        if op == "change":
            s.stack[-1].append((rec, at, key, value))
        elif op == "savepoint":
            s.stack.append([])
        else:
            if op == "rollback":
                undone, fate = s.stack.pop(), "rollback"
                if not s.stack:
                    s.stack.append([])
                    if s.first_end is None:
                        s.popped += 1
                        yield ("pop", chunk, source, rec, at, None, None, s.popped, None, None, None, None, None)
            else:
                undone, fate = [x for segment in s.stack for x in segment], op
                s.stack, s.ends = [[]], s.ends + 1
                s.first_end = s.first_end or (op, rec, at)
                if op == "commit":
                    yield ("commit", chunk, source, rec, at, None, None, commits, None, None, None, None, None)
                    commits += 1
            for r, a, x, v in undone:
                yield ("done", chunk, source, r, a, x, v, None, None, None, fate, rec, at)
    for source, s in seen.items():
        for level, segment in enumerate(s.stack):
            for r, a, x, v in segment:
                yield ("open", chunk, source, r, a, x, v, level, None, None, None, None, None)
        yield ("sum", chunk, source, None, None, None, s.ends, s.popped, len(s.stack) - 1, s.first_end is not None, *(s.first_end or (None, None, None)))


def _sorted(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast: all of them grow with the log."""
    return df.hint("merge")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for n, c in zip(_NAMES, _OUT.split(", "), strict=True)])
    records = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    rows: list[tuple] = []
    for row in read_chunk(TaskContext.get().partitionId(), records):
        rows.append(row)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _then(a: Column, b: Column) -> Column:
    """Two summaries, the first of what comes before: rollbacks meet the savepoints that are open there, an end forgets them."""
    return F.struct(
        (a["pops"] + F.greatest(b["pops"] - a["saves"], F.lit(0))).alias("pops"),
        (F.when(b["ends"] > 0, F.lit(0)).otherwise(F.greatest(a["saves"] - b["pops"], F.lit(0))) + b["saves"]).alias("saves"), (a["ends"] + b["ends"]).alias("ends"),
    )


def resolve(log: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(changes, commits) of ``log`` (at, source, op, key, value; whole numbers but source and op).

    changes: (rec, at, source, key, value, fate, by_rec, by_at) with the fate commit, abort or rollback and the record
    that decided it, null for the end of the log.  commits: (rec, at, number), numbered through the log from 0.
    """
    spark = log.sparkSession
    rows = log.select(
        F.col("at").cast("bigint").alias("at"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), "op", F.col("key").cast("bigint").alias("key"), F.col("value").cast("bigint").alias("value")
    ).where(F.col("at").isNotNull() & F.col("op").isin(*OPS))
    rows = cut(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // chunk_rows))
    # ranges of two numbers, as the driver gets a sample of what rows are ranged by
    rows = rows.withColumn("tie", F.xxhash64("source", "op", "key", "value"))
    lined = rows.repartitionByRange(parts, "at", "tie").sortWithinPartitions("at", "tie", "source", "op", "key", "value").drop("tie")
    read = cut(lined.mapInArrow(_read, _OUT))
    chunks = (read.agg(F.max("chunk")).first()[0] or 0) + 1

    tagged = lambda tag: read.where(F.col("tag") == tag)
    sums = tagged("sum").select("source", "chunk", F.struct(F.col("nth").alias("pops"), F.col("more").alias("saves"), F.col("value").alias("ends")).alias("s"), "ended", "fate", "by_rec", "by_at")
    zero = F.struct(F.lit(0).alias("pops"), F.lit(0).alias("saves"), F.lit(0).alias("ends"))
    # before the first chunk no savepoint is open, so pops left over meet nothing
    start = before(sums, ["source"], "chunk", "s", zero, _then, chunks).select("source", "chunk", F.col("before.saves").alias("depth"), F.col("before.ends").alias("tx"))
    placed = cut(sums.join(_sorted(start), ["source", "chunk"]).select("source", "chunk", "depth", "tx", "ended", "fate", "by_rec", "by_at", F.col("s.pops").alias("pops"), F.col("s.ends").alias("ends")))

    at_chunk = placed.select("source", "chunk", "depth", "tx", "pops", "ends", "ended")
    opened = tagged("open").select("source", "chunk", "rec", "at", "key", "value", "nth").join(_sorted(at_chunk), ["source", "chunk"])
    opened = opened.withColumns({"level": F.when(F.col("ended"), F.lit(0)).otherwise(F.greatest(F.col("depth") - F.col("pops"), F.lit(0))) + F.col("nth"), "tx": F.col("tx") + F.col("ends")})
    popped = tagged("pop").select("source", "chunk", F.struct("rec", "at").alias("pop"), "nth").join(_sorted(at_chunk), ["source", "chunk"])
    popped = popped.groupBy("source", "tx", F.greatest(F.col("depth") - F.col("nth") + 1, F.lit(0)).alias("level"), "chunk").agg(F.min("pop").alias("pop"))
    # of a level in a transaction: one segment and one rollback a chunk at most, so these lines are as long as there are chunks
    segments = opened.select("source", "tx", "level", "chunk").distinct()
    back = Window.partitionBy("source", "tx", "level").orderBy(F.desc("chunk"), F.col("pop").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    line = segments.withColumn("pop", F.lit(None).cast(popped.schema["pop"].dataType)).unionByName(popped)
    line = line.withColumn("next", F.last("pop", ignorenulls=True).over(back)).where("pop is null").drop("pop")
    ends = placed.where("ended").select("source", "tx", F.struct("fate", F.col("by_rec").alias("rec"), F.col("by_at").alias("at")).alias("end"))
    nothing = F.struct(F.lit("abort").alias("fate"), F.lit(None).cast("bigint").alias("rec"), F.lit(None).cast("bigint").alias("at"))
    rolled = F.when(F.col("next").isNotNull(), F.struct(F.lit("rollback").alias("fate"), F.col("next.rec").alias("rec"), F.col("next.at").alias("at")))
    line = line.join(_sorted(ends), ["source", "tx"], "left").select("source", "chunk", "tx", "level", F.coalesce(rolled, "end", nothing).alias("by"))
    late = opened.join(_sorted(line), ["source", "chunk", "tx", "level"]).select("rec", "at", "source", "key", "value", "by.fate", F.col("by.rec").alias("by_rec"), F.col("by.at").alias("by_at"))
    changes = tagged("done").select(*late.columns).unionByName(late)
    changes = changes.withColumn("source", F.when(F.col("source") != "", F.substr("source", F.lit(2))))

    counted = tagged("commit").groupBy("chunk").agg(F.count("*").alias("n"))
    first = before(counted, [], "chunk", "n", F.lit(0), lambda a, b: a + b, chunks)
    commits = tagged("commit").select("chunk", "rec", "at", "nth").join(_sorted(first), "chunk").select("rec", "at", (F.col("before") + F.col("nth")).alias("number"))
    return changes, commits


def states(changes: DataFrame, commits: DataFrame, every: int = 4, block: int = EPOCH_BLOCK) -> DataFrame:
    """(epoch, keys, total): after each epoch of ``every`` commits how many keys the store holds and the sum of their values.

    A committed change with a null value deletes its key.
    """
    commits = cut(commits.select("rec", (F.floor(F.col("number") / every) + 1).alias("epoch")))
    last = commits.agg(F.max("epoch")).first()[0] or 0
    blocks = last // block + 1
    applied = changes.where("fate = 'commit'").join(_sorted(commits.select(F.col("rec").alias("by_rec"), "epoch")), "by_rec")
    latest = F.max_by(F.struct("value"), F.struct("by_rec", "rec")).alias("now")
    steps = cut(applied.groupBy("key", "epoch").agg(latest).withColumn("block", F.floor(F.col("epoch") / block)))
    # the value that a key comes into a block with: the last one before it
    kept = steps.groupBy("key", "block").agg(F.max_by("now", "epoch").alias("s"))
    came = before(kept, ["key"], "block", "s", F.lit(None), lambda a, b: F.coalesce(b, a), blocks)
    inside = Window.partitionBy("key", "block").orderBy("epoch")
    moved = steps.join(_sorted(came), ["key", "block"]).withColumn("old", F.coalesce(F.lag("now").over(inside), "before"))
    held = lambda s: F.when(F.col(f"{s}.value").isNotNull(), 1).otherwise(0)
    worth = lambda s: F.coalesce(F.col(f"{s}.value"), F.lit(0))
    deltas = moved.groupBy("epoch").agg(F.sum(held("now") - held("old")).alias("keys"), F.sum(worth("now") - worth("old")).alias("total"))
    each = commits.select("epoch").distinct().join(_sorted(deltas), "epoch", "left").select("epoch", F.floor(F.col("epoch") / block).alias("block"), F.struct(F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("total", F.lit(0)).alias("total")).alias("d"))
    each = cut(each)
    summed = each.groupBy("block").agg(F.struct(F.sum("d.keys").alias("keys"), F.sum("d.total").alias("total")).alias("s"))
    both = lambda a, b: F.struct((a["keys"] + b["keys"]).alias("keys"), (a["total"] + b["total"]).alias("total"))
    start = before(summed, [], "block", "s", F.struct(F.lit(0).alias("keys"), F.lit(0).alias("total")), both, blocks)
    upto = Window.partitionBy("block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return each.join(_sorted(start), "block").select("epoch", (F.col("before.keys") + F.sum("d.keys").over(upto)).alias("keys"), (F.col("before.total") + F.sum("d.total").over(upto)).alias("total"))


def document_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents read as log records: h = crc32(decimal doc_id) says what each is; a value is the crc32 of ``key:text``, null deletes."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    kind = h % 23
    op = F.when(kind < 2, "commit").when(kind == 2, "abort").when(kind < 5, "savepoint").when(kind < 7, "rollback").otherwise("change")
    key = F.when(op == "change", F.floor(h / 100) % 300)
    value = F.when(op == "change", F.crc32(F.concat_ws(":", key.cast("string"), F.col("text")).cast("binary")))
    rows = docs.select("doc_id", "source", op.alias("op"), key.alias("key"), F.when(F.col("text").isNotNull(), value).alias("value"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("at")).distinct().withColumn("gone", F.lit(True))
    rows = rows.withColumnRenamed("doc_id", "at").join(_sorted(toxic), "at", "left")
    return rows.select("at", "source", "op", "key", F.when(F.col("gone").isNull(), F.col("value")).alias("value"))
