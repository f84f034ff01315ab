"""Quality classifier by importance resampling.

Texts are split into words and runs of punctuation; their unigrams and bigrams are hashed
into BUCKETS.  Two generative bag models of such n-grams are estimated: the raw one from every
text of the corpus, the target one from a bounded sample of texts labelled good.  A text's
log weight is the sum of log target / raw over its n-grams, the log ratio of its likelihoods.

Documents are then drawn without replacement in proportion to their weights by Gumbel top-k:
log weight plus a standard Gumbel variate, the k greatest stay.  k is given, or the documents
times a share; the share is that of good ones among the labelled (read from at most SAMPLE_ROWS
of them) plus SLACK, as a clean document lost costs more than a poor one kept.  The noise is a
hash of id and seed, so a task that runs again decides alike.  The k-th key is found by counting
keys in ever finer bins, not by sorting.

Cases: a null or empty text has no n-grams and a log weight of zero.
Rows with equal id and text have one key, and keys tied with the k-th all stay.  With no
labelled good text nothing is known and everything stays.  Empty tables give an empty
result.  ``draw`` carries all columns as they are.  Long texts are weighed whole, in blocks;
labelled texts over SAMPLE_CHARS characters are weighed and counted like all others and only
never taken into the target model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm import kernels as K
from skriva.llm.support import cut

BUCKETS = 1 << 15
SAMPLE_ROWS, SAMPLE_CHARS = 8000, 20_000
SLACK, SEED = 0.01, 11
#: N-grams of the raw model that the target model starts from.
PRIOR = 200_000
_CLASS = np.array([0 if K.SPACE[c] else 1 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 for c in range(256)], np.uint8)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _pairs(h: np.ndarray) -> np.ndarray:
    return K.mix(h[:-1] * np.uint64(3) + h[1:])


def hashes(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word or run of punctuation of texts i..j, text of each)."""
    lo, hi = int(off[i]), int(off[j])
    part = data[lo:hi]
    c = _CLASS[part]
    start = np.ones(len(c), bool)
    start[1:] = c[1:] != c[:-1]
    border = off[i : j + 1] - lo
    start[border[1:-1][border[1:-1] < len(c)]] = True
    edge = np.flatnonzero(start)
    end = np.append(edge[1:], len(c))
    word = c[edge] > 0
    s, e = edge[word], end[word]
    return K.hash_spans(part, s, e), np.searchsorted(border, s, "right") - 1


def grams(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each) of the unigrams and bigrams of texts i..j."""
    h, of = hashes(data, off, i, j)
    same = of[:-1] == of[1:]
    return np.concatenate((_bucket(h), _bucket(_pairs(h)[same]))), np.concatenate((of, of[:-1][same]))


def pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, buckets, text of each counted from i) over a buffer; a text over a block comes in pieces that end at white space."""
    for i, j in K.blocks(off):
        if j - i == 1 and off[j] - off[i] > K.BLOCK:
            lo, before = int(off[i]), np.zeros(0, np.uint64)  # the last word, for the bigram over the border
            while lo < off[j]:
                top = min(int(off[j]), lo + K.BLOCK)
                while top < off[j] and not K.SPACE[data[top - 1]]:
                    gap = np.flatnonzero(K.SPACE[data[top : min(int(off[j]), top + K.BLOCK)]])
                    top = top + int(gap[0]) + 1 if len(gap) else min(int(off[j]), top + K.BLOCK)
                h, of = hashes(data, np.array([lo, top]), 0, 1)
                b = np.concatenate((_bucket(h), _bucket(_pairs(np.concatenate((before, h))))))
                yield i, j, b, np.zeros(len(b), np.int64)
                lo, before = top, h[-1:] if len(h) else before
        else:
            yield i, j, *grams(data, off, i, j)


@dataclass
class Model:
    ratio: np.ndarray  # log target - log raw, by bucket
    share: float = 1.0  # of documents to draw

    def weights(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log weight of each text: the sum of log ratios over its n-grams."""
        total = np.zeros(len(off) - 1)
        for i, j, b, of in pieces(data, off):
            total[i:j] += np.bincount(of, weights=self.ratio[b], minlength=j - i)
        return total


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts; each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, b, _ in pieces(*K.utf8(batch.column(0))):
                n += np.bincount(b, minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """The raw model over all of ``docs``, the target model over about ``rows`` labelled texts."""
    raw = np.ones(BUCKETS)
    for r in counts(docs, text_col).collect():  # at most BUCKETS rows
        raw[r.bucket] += r.n
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    part = F.pmod(F.xxhash64(F.lit("quality"), F.col(id_col)), F.lit(1 << 30)) < int(min(1.0, rows / max(1, marked.count())) * (1 << 30))
    chosen = marked.where(part).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("y"))  # bounded by ``rows``
    got = docs.where(part & F.col(text_col).isNotNull() & (F.length(text_col) <= chars)).join(F.broadcast(chosen), F.col(id_col) == F.col("k"))
    got = got.select(F.col(text_col).alias("t"), F.col("y").cast("int").alias("y"), F.xxhash64(F.col(text_col)).alias("h")).toArrow().sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()
    y = np.array(got.column("y").to_pylist(), float)
    data, off = K.utf8(got.column("t").combine_chunks() if len(y) else pa.array([], pa.string()))
    target = np.zeros(BUCKETS)
    for i, j, b, of in pieces(data, off):
        target += np.bincount(b[(y[i:j] > 0)[of]], minlength=BUCKETS)
    if not (y > 0).any():
        return None
    # the sample says little of rare n-grams: shrink the target towards the raw model
    raw /= raw.sum()
    return Model(np.log((target + PRIOR * raw) / (target.sum() + PRIOR)) - np.log(raw), min(1.0, float((y > 0).mean()) + SLACK))


def gumbel(ids: list, seed: int) -> np.ndarray:
    u = np.array([xxhash.xxh64_intdigest(str(i), seed) for i in ids], np.uint64)
    return -np.log(-np.log((u.astype(np.float64) + 0.5) / 2.0**64))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep``, log_weight and key (log weight with noise) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carried = list(dict.fromkeys([id_col, *keep]))
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in K.slices(batches):
            size = batch.num_rows
            w = m.weights(*K.utf8(batch.column(n))) if m and size else np.zeros(size)
            key = w + gumbel(batch.column(0).to_pylist(), seed) if size else w
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(w), pa.array(key)], [*(f"c{k}" for k in range(n)), "log_weight", "key"])

    schema = ", ".join(f"c{k} {types[c]}" for k, c in enumerate(carried)) + ", log_weight double, key double"
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carried)})


def kth_key(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th greatest of column ``key``: bins are counted, and the one that holds it is cut again."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    for _ in range(8):
        if hi <= lo:
            break
        width = (hi - lo) / bins
        bin_of = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        got = keys.where(F.col("key").between(lo, hi)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for r in sorted(got.collect(), key=lambda r: -r.bin):  # at most ``bins`` rows
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
    return float(lo)


def threshold(keys: DataFrame, model: Model | None, k: int | None = None) -> float:
    """Key that a document must reach to be among the k drawn; ``keys`` (a cut result of ``scored``) is read several times."""
    if model is None:
        return float("-inf")
    return kth_key(keys, math.ceil(model.share * keys.count()) if k is None else k)


def draw(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn; their texts are weighed again rather than shuffled."""
    least = threshold(cut(scored(docs, model, id_col, text_col, seed).select("key")), model, k)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in K.slices(batches):
            if m and batch.num_rows:
                key = m.weights(*K.utf8(batch.column(text_at))) + gumbel(batch.column(id_at).to_pylist(), seed)
                batch = batch.filter(pa.array(key >= least))
            yield batch

    return docs.mapInArrow(run, docs.schema)
