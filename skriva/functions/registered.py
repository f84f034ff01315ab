"""Functions and table functions by name, for SQL text.

``register`` makes them known to a session.  Expressions are SQL functions, which stay in
the JVM; readings are Arrow functions; what makes rows is a table function.
``energy_chunks`` asks by itself that its table is partitioned by its first column and ordered by its second, and takes
its key's type from the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from skriva.functions import kana
from skriva.operators.chunking import EnergyChain
from skriva.sources.transcripts import CUE

_MS = "cast(bround(seconds * 1000) as bigint)"
#: Name, parameters and result of expressions in SQL.
EXPRESSIONS = {
    "cue_timestamp": (
        "seconds double, sep string", "string",
        f"format_string(concat('%02d:%02d:%02d', sep, '%03d'), {_MS} div 3600000, {_MS} div 60000 % 60, {_MS} div 1000 % 60, {_MS} % 1000)",
    ),
    "term_hits": ("said string, term string", "bigint", "case when length(term) > 0 then cast((length(said) - length(replace(said, term, ''))) div length(term) as bigint) else 0 end"),
    "plain_error_rate": ("ref string, hyp string", "double", "levenshtein(ref, hyp) / greatest(length(ref), 1)"),
}


@F.udtf(returnType="cue_idx int, start_s double, end_s double, text string")
class ParseCues:
    """The cues of one SRT or VTT text; none of a null."""

    def eval(self, raw: str) -> Iterator[tuple]:
        for k, found in enumerate(re.finditer(CUE, (raw or "").replace("\r\n", "\n"))):
            h0, m0, s0, ms0, h1, m1, s1, ms1, said = found.groups("0")
            at = lambda h, m, s, ms: int(h) * 3600 + int(m) * 60 + int(s) + int(ms) / 1000.0
            yield k, at(h0, m0, s0, ms0), at(h1, m1, s1, ms1), said.rstrip("\n")


@F.udtf(returnType="region int, first int, stop int")
class SplitRegions:
    """Truncated even regions of n units; nothing of a null or without regions."""

    def eval(self, n: int, regions: int) -> Iterator[tuple]:
        for k in range(regions if n is not None and regions else 0):
            yield k, k * n // regions, (k + 1) * n // regions


@F.udtf
class EnergyChunks:
    """Chunks of the files of a table (file, place, samples): see ``chunking.energy_chunk_rows``."""

    @staticmethod
    def analyze(blocks: AnalyzeArgument, target_s: AnalyzeArgument, search_s: AnalyzeArgument, rate: AnalyzeArgument) -> AnalyzeResult:
        if not blocks.isTable or len(blocks.dataType.fields) != 3:
            raise ValueError("energy_chunks takes a table of file, place and samples")
        file, place, _ = blocks.dataType.fields
        out = T.StructType([T.StructField(file.name, file.dataType), *(T.StructField(n, t) for n, t in (("chunk_idx", T.IntegerType()), ("start_sample", T.LongType()), ("end_sample", T.LongType())))])
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(file.name)], orderBy=[OrderingColumn(place.name)])

    def __init__(self) -> None:
        self._chain, self._file, self._number, self._begin = None, None, 0, 0

    def _cut(self, at: list[int]) -> Iterator[tuple]:
        for x in at:
            yield self._file, self._number, self._begin, x
            self._number, self._begin = self._number + 1, x

    def eval(self, block: Row, target_s: float, search_s: float, rate: int) -> Iterator[tuple]:
        if self._chain is None:
            self._chain, self._file = EnergyChain(float(target_s), float(search_s), rate), block[0]
        yield from self._cut(self._chain.add(np.asarray(block[2] or (), np.float64)))

    def terminate(self) -> Iterator[tuple]:
        if self._chain is not None:
            yield from self._cut(self._chain.end())
            yield from self._cut([self._chain.seen])


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("read_number", kana.read_number_udf)
    spark.udf.register("kana_fold", kana.kana_fold_udf)
    spark.udf.register("to_kana", kana.to_kana_udf)
    for name, function in (("parse_cues", ParseCues), ("split_regions", SplitRegions), ("energy_chunks", EnergyChunks)):
        spark.udtf.register(name, function)
