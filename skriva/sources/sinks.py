"""Writers: subtitle, text and JSON documents, tables as markdown."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skriva.operators import cues as C


def write_documents(cues: DataFrame, path: str, fmt: str = "all", by: str = "file_id", speech_times: bool = True, **options) -> list[str]:
    """One folder a format under ``path``, partitioned by file; Spark commits each as a whole."""
    C.check_format(fmt, speech_times)
    formats = list(C.DOCUMENTS) if fmt == "all" else [fmt]
    for f in formats:
        made = C.DOCUMENTS[f](cues, by, **{k: v for k, v in options.items() if f in ("srt", "vtt")})
        made.select(by, F.col("document").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy(by).text(f"{path}/{f}")
    return [f"{path}/{f}" for f in formats]


def markdown(rows: DataFrame, most: int = 100_000) -> str:
    """A result as a table, a blank line after it.  It is made on the driver: more than ``most`` rows raise an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write them with a sink, or raise most")
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, got)]) + "\n\n"


class _Manifest:
    """The commits of a run, numbered from 0: each names a batch of rows that is written before and moved to its place after."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def count(self) -> int:
        return len(self.fs.listStatus(self._at("manifest"))) if self.fs.exists(self._at("manifest")) else 0

    def claim(self, number: int, batch: str) -> bool:
        """Take a number, unless another writer has it."""
        try:
            out = self.fs.create(self._at(f"manifest/{number:08d}-commit"), False)
        except Py4JJavaError:
            if self.fs.exists(self._at(f"manifest/{number:08d}-commit")):
                return False
            raise
        out.write(bytearray(batch.encode()))
        out.close()
        return True

    def settle(self) -> None:
        """Move what has been committed but is not in its place: a writer ended in between."""
        for k in range(self.count()):
            if not self.fs.exists(self._at(f"results/run_commit={k}")):
                stream = self.fs.open(self._at(f"manifest/{k:08d}-commit"))
                batch = bytes(stream.readAllBytes()).decode()
                stream.close()
                if self.fs.exists(self._at(f"results/_{batch}")):
                    self.fs.rename(self._at(f"results/_{batch}"), self._at(f"results/run_commit={k}"))


def run_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The committed result rows of a run."""
    manifest = _Manifest(spark, path)
    manifest.settle()
    return spark.read.schema(schema).json(f"{path}/results").select(*schema.names) if manifest.count() else spark.createDataFrame([], schema)


def write_run(results: DataFrame, path: str, header: dict, truncated: str = "truncated", looped: str = "looped", key: str = "file") -> dict:
    """Add a run's result rows under ``path``/results and write its header beside them.

    A file that has a row there already is left as it is, so a run that was cut short goes on
    where it ended.  The header gets files_scored, complete and the files that were truncated
    or looped, ten of each by name.

    Rows are written where no reader looks, then committed by taking the next number of a manifest, and moved.  A writer
    that ends anywhere in between leaves rows that are committed (the next one moves them) or none.  One
    that finds its number taken leaves out what the other has added, so no file is added twice.
    """
    spark, manifest, names = results.sparkSession, _Manifest(results.sparkSession, path), results.columns
    batch = f"pending-{uuid.uuid4().hex}"
    while True:
        seen = manifest.count()
        done = run_rows(spark, path, results.schema).select(key).distinct()
        attempt = f"{batch}-{seen}"
        results.join(done, key, "left_anti").select(*names).dropDuplicates([key]).write.mode("overwrite").json(f"{path}/results/_{attempt}")
        if manifest.claim(seen, attempt):
            break
    manifest.settle()
    whole = run_rows(spark, path, results.schema)
    named = lambda flag: [r[0] for r in whole.where(F.col(flag)).orderBy(key).select(key).limit(10).collect()] if flag in whole.columns else []
    n = whole.select(key).distinct().count()
    header = header | {"files_scored": n, "complete": n >= header.get("files_expected", n), "truncated": named(truncated), "looped": named(looped)}
    spark.createDataFrame([(json.dumps(header, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return header
