"""SimHash near-duplicates.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its
three-word shingles, repeats included; with fewer words the whole sequence is the one
shingle, with none the fingerprint is zero.  Documents link at ``radius`` or fewer
differing bits; groups are the connected components.

Linking.  Equal fingerprints are first reduced to one row with their least id.  Every
distinct fingerprint gets a table of its Hamming distances to REFERENCES fixed reference
fingerprints.  Its 64 bits are cut into 5 segments; a pair within 3 bits leaves at least
2 segments untouched, so the 10 pairs of segments are the only places where partners can
meet.  Within such a bucket the groups are grown from one member at a time: rows still
outside are discarded where any reference distance differs by more than the radius (the
triangle inequality makes that safe), and the survivors are verified by counting bits.
What has joined is not compared again, so a dense group costs little more than one pass,
and a bucket gives one edge a member and not all pairs.  A bucket of more than SPLIT
fingerprints is cut once more: the bits in which they differ are dealt into radius + 1 sets, of
which a pair within the radius has one in common.

Cases: a null text counts as empty; a null id keeps its fingerprint and has a null
component unless it shares its group with rows that have one.  Repeated rows and ties
fall together.  Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm import kernels as K
from skriva.llm.support import components, cut, small_side

SHINGLE, SEED, RADIUS = 3, 42, 3
REFERENCES = np.random.default_rng(7).integers(0, 1 << 64, 16, dtype=np.uint64, endpoint=False)
#: Bit widths of the segments; radius + 2 of them.
SEGMENTS = (13, 13, 13, 13, 12)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15
SPLIT = 1024
_WORD_BYTES = bytes(c for c in range(256) if not K.SPACE[c])


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text, in pieces of about BLOCK bytes that begin with the last words of the one before."""
    before: list[bytes] = []
    at = 0
    while at < len(text):
        top = min(len(text), at + K.BLOCK)
        while top < len(text):  # to the end of the word
            tail = text[top : top + 64]
            left = tail.lstrip(_WORD_BYTES)
            top += len(tail) - len(left)
            if left:
                break
        w = before + text[at:top].translate(_LOWER).split()  # split() takes exactly 0x20 and 0x09-0x0D
        if len(w) >= SHINGLE or top == len(text):
            yield w
            before = w[-(SHINGLE - 1) :]
        else:
            before = w
        at = top


def fingerprint(text: bytes) -> int:
    digest, ones, m = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for w in _parts(text):
        n = len(w)
        if n < SHINGLE:
            if m or not n:
                continue  # the end of a longer text: its words were counted
            return digest(b" ".join(w), SEED)
        line = b" ".join(w)
        size = np.fromiter(map(len, w), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        starts, ends = (ends - size).tolist(), ends[SHINGLE - 1 :].tolist()
        for lo in range(0, len(ends), _CHUNK):
            hi = min(len(ends), lo + _CHUNK)
            ones += _bit_counts(np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)], np.uint64))
        m += len(ends)
    bits = (2 * ones > m).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)) if m else 0


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint): the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            fp = np.array([fingerprint(t) for t in K.texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def distance_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, one row a fingerprint."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ REFERENCES[None, :])


def bucket_links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (member, least of its group) that connect the groups inside one bucket of distinct fingerprints."""
    if len(fp) > SPLIT:
        u = fp.view(np.uint64)
        varied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(u ^ u[0]).reshape(1).view(np.uint8), bitorder="little"))
        edges = []
        for part in range(radius + 1):
            key = u & np.bitwise_or.reduce(np.uint64(1) << varied[part :: radius + 1].astype(np.uint64), initial=np.uint64(0))
            order = np.argsort(key, kind="stable")
            border = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(fp[order], border):
                if len(group) > 1:
                    edges += bucket_links(group, radius) if len(group) <= len(fp) // 2 else _grown(group, radius)
        return edges
    return _grown(fp, radius)


def _grown(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    fp = np.sort(fp)
    u, table = fp.view(np.uint64), distance_table(fp).astype(np.int16)
    outside = np.arange(len(fp))
    edges: list[tuple[int, int]] = []
    while len(outside):
        root, outside = outside[0], outside[1:]
        frontier = [root]
        while frontier and len(outside):
            x = frontier.pop()
            near = outside
            for p in range(0, table.shape[1], 4):  # what the distances to four references leave is looked at by the next four
                near = near[(np.abs(table[near, p : p + 4] - table[x, p : p + 4]) <= radius).all(1)]
                if not len(near):
                    break
            near = near[np.bitwise_count(u[near] ^ u[x]) <= radius]
            if len(near):
                edges += [(int(fp[y]), int(fp[root])) for y in near]
                frontier += near.tolist()
                outside = outside[~np.isin(outside, near)]
    return edges


def _segment_keys() -> list:
    low, parts = 0, []
    for i, width in enumerate(SEGMENTS):
        parts.append(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)))
        low += width
    return [F.lit(a * 8 + b).cast("bigint") * (1 << 32) + parts[a] * (1 << 16) + parts[b] for a, b in combinations(range(len(SEGMENTS)), 2)]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints that connect everything within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # a bucket that is not yet at its end
        for batch in batches:
            key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if parts and (last or key[0] != parts[0][0][0]):
                first = int(np.searchsorted(key, parts[0][0][0], "right"))  # the rest of that bucket
                yield _buckets(*(np.concatenate(x) for x in zip(*parts, (key[:first], fp[:first]), strict=True)))
                parts = []
                key, fp, last = key[first:], fp[first:], max(0, last - first)
            if last:
                yield _buckets(key[:last], fp[:last])
            parts.append((key[last:], fp[last:]))
        if parts:
            yield _buckets(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    keyed = distinct.select("fp", F.explode(F.array(*_segment_keys())).alias("k"))
    return keyed.select("k", "fp").repartition("k").sortWithinPartitions("k").mapInArrow(run, "a bigint, b bigint")


def _buckets(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    edges: list[tuple[int, int]] = []
    border = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate(([0], border)), np.concatenate((border, [len(key)]))
    for i in np.flatnonzero(ends - starts > 1):
        edges += bucket_links(fp[starts[i] : ends[i]])
    got = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fp bigint, component_id (the least id of its group)."""
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(distinct.select("fp")))
    label = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # only groups of several fingerprints need another look; the rest keep their own least id
    several = cut(label.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    of_print = cut(label.join(small_side(several, 24), F.col("label") == F.col("l"), "left").select(F.col("fp").alias("f"), F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(of_print, prints.fp == of_print.f, "left").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the least id.

    Rows that repeat an id and a text count as one; rows without id stay.
    """
    found = cut(near_duplicates(docs, id_col, text_col))
    drop = cut(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("drop_id")))
    kept = docs.join(small_side(drop, 16), docs[id_col] == drop.drop_id, "left_anti")
    again = cut(found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("again_id")).agg(F.count("*").alias("n")).where("n > 1").select("again_id"))
    if again.isEmpty():
        return kept
    again = small_side(again, 16)
    once = kept.join(again, kept[id_col] == again.again_id, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, kept[id_col] == again.again_id, "left_anti").unionByName(once)
