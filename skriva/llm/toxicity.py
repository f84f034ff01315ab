"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled texts is read (at most about SAMPLE_ROWS rows of at most
SAMPLE_CHARS characters).  Every word of a text counts, known or not: its weight is
(1 + log tf) x idf x rf, rf being the relevance frequency log2(2 + toxic / max(1, others))
over the examples that hold the word (1 for words that say nothing), which is the published
TF-IDF-RF weight.  Nothing is left out of the vocabulary.  Examples become unit vectors in an
inverted index: postings of a term are grouped into blocks of BLOCK neighbouring examples,
and each (term, block) keeps its largest weight.  The postings of the DENSE most frequent terms
are kept as rows of a matrix, as they name most examples anyway.

A text is a query.  The matrix gives the frequent terms' part of all cosines; with it and the
block maxima of the other terms no example of a block can score more than its bound.  Blocks
are opened from the highest bound down and the search ends when no bound beats the K-th
best cosine, so the K nearest are exact.  They vote with their cosines as weights; a part
of the sample that was kept out of the index turns votes into calibrated probabilities.
The neighbours with their labels and cosines are the evidence.

Cases: a null or empty text, and one without any word of the examples, has no neighbour and
gets the calibrated rate of such examples.  Ties of cosine go to the earlier example.
With no labels at all the score is 0.  Repeated rows are scored each by itself, empty
tables give an empty result, other columns are not read.  Several labels of one id count
as toxic if any is.  Long texts are cut into words block by block.  Labelled texts over
SAMPLE_CHARS are scored as any other and only never learnt from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm import kernels as K

SAMPLE_ROWS, SAMPLE_CHARS = 8000, 20_000
NEIGHBOURS, BLOCK, DENSE = 25, 256, 256
_TO = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def bags(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of the words of each text of a buffer."""
    data = _TO[data]
    for i, j in K.blocks(off):
        _, _, h, first = K.doc_words(data, off, i, j)
        for k in range(j - i):
            yield np.unique(h[first[k] : first[k + 1]], return_counts=True)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return next(bags(np.frombuffer(text, np.uint8), np.array([0, len(text)])))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every range one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


@dataclass
class Index:
    words: np.ndarray  # hashes of the vocabulary, ascending; a term is a place here
    weight: np.ndarray  # idf x rf of each term
    unseen: float  # weight of a word that no example holds
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each example, in index order
    ids: list = field(default_factory=list)  # of each example
    first: np.ndarray | None = None  # term: where its block entries begin, with the total last
    block: np.ndarray | None = None  # of each entry
    most: np.ndarray | None = None  # of each entry: its largest weight
    begin: np.ndarray | None = None  # of each entry: where its postings begin, with the total last
    example: np.ndarray | None = None  # of each posting
    value: np.ndarray | None = None  # of each posting
    row: np.ndarray | None = None  # of each term in the matrix, or -1
    matrix: np.ndarray | None = None  # frequent terms x examples, these filled up to whole blocks
    slope: float = 4.0
    shift: float = -2.0
    rest: float = 0.0  # rate of examples without any neighbour

    def vector(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a bag as a unit vector; words without a term count in its length only."""
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        w = 1 + np.log(n.astype(np.float64))
        w *= np.where(known, self.weight[at], self.unseen) if len(self.words) else self.unseen
        return at[known], w[known] / max(1e-12, math.sqrt(float(w @ w)))

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms add to the cosine of each query with each example."""
        q = np.zeros((len(queries), len(self.matrix)))
        for k, (t, w) in enumerate(queries):
            at = self.row[t]
            q[k, at[at >= 0]] = w[at >= 0]
        return q @ self.matrix

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine over 0: exact.  ``known``: the row of ``frequent``."""
        best_e, best_s = np.zeros(0, np.int64), np.zeros(0)
        if not len(t) or not len(self.label):
            return best_e, best_s
        known = self.frequent([(t, w)])[0] if known is None else known
        rare = self.row[t] < 0
        t, w = t[rare], w[rare]
        size = self.first[t + 1] - self.first[t]
        entry, q = _ranges(self.first[t], size), np.repeat(w, size)
        block = self.block[entry]
        bound = known.reshape(-1, BLOCK).max(1) + np.bincount(block, weights=q * self.most[entry], minlength=len(known) // BLOCK)
        order = np.argsort(-bound, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        rank = rank[block]
        done, width = 0, 8
        while done < len(order) and bound[order[done]] > 0:
            if len(best_s) >= k:  # no further than blocks that may still matter
                width = min(width, int((bound[order[done:]] >= best_s[k - 1] - 1e-9).sum()))
                if not width:
                    break
            use = np.flatnonzero((rank >= done) & (rank < done + width))
            at = self.begin[entry[use]]
            size = self.begin[entry[use] + 1] - at
            post = _ranges(at, size)
            s = np.bincount(self.example[post], weights=np.repeat(q[use], size) * self.value[post], minlength=len(known))
            opened = (order[done : done + width, None] * BLOCK + np.arange(BLOCK)).ravel()
            s = np.round(known[opened] + s[opened], 12)  # equal examples tie whatever the order of their sums
            hit = np.flatnonzero(s >= best_s[k - 1] if len(best_s) >= k else s > 0)
            if len(hit) > 4 * k:  # far fewer are sorted; ties with the k-th stay in
                hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k]]
            e, s = np.concatenate((best_e, opened[hit])), np.concatenate((best_s, s[hit]))
            top = np.lexsort((e, -s))[:k]
            best_e, best_s = e[top], s[top]
            done, width = done + width, 2 * width
        return best_e, best_s

    def votes(self, words: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """(vote, neighbours, cosines) of every bag."""
        for lo in range(0, len(words), 64):
            queries = [self.vector(*b) for b in words[lo : lo + 64]]
            known = self.frequent(queries) if len(self.label) else [None] * len(queries)
            for q, row in zip(queries, known, strict=True):
                e, s = self.nearest(*q, known=row)
                yield (float((s * self.label[e]).sum() / s.sum()) if len(e) else None), e, s

    def vote(self, words: tuple[np.ndarray, np.ndarray]) -> tuple[float | None, np.ndarray, np.ndarray]:
        return next(self.votes([words]))

    def probability(self, v: float | None) -> float:
        return self.rest if v is None else 1 / (1 + math.exp(-(self.slope * v + self.shift)))


def build(texts: list[bytes], toxic: list[int], ids: list) -> Index:
    """Index three quarters of the examples; the others calibrate the votes."""
    y = np.array(toxic, np.float64)
    counted = [bag(t) for t in texts]
    size = np.array([len(h) for h, _ in counted], np.int64)
    every = np.concatenate([h for h, _ in counted]) if counted else np.zeros(0, np.uint64)
    words, term = np.unique(every, return_inverse=True)
    seen = np.bincount(term, minlength=len(words))
    bad = np.bincount(term, weights=np.repeat(y, size), minlength=len(words))
    n = len(texts)
    weight = (np.log((1 + n) / (1 + seen)) + 1) * np.log2(2 + bad / np.maximum(1, seen - bad))
    index = Index(words, weight, math.log(1 + n) + 1)
    vectors = [index.vector(*b) for b in counted]
    # neighbours in the index share their heaviest words, so block maxima are tight
    inside = sorted((i for i in range(n) if i % 4), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist(), i))
    index.label, index.ids = y[inside], [ids[i] for i in inside]
    if inside:
        t = np.concatenate([vectors[i][0] for i in inside])
        w = np.concatenate([vectors[i][1] for i in inside])
        e = np.repeat(np.arange(len(inside)), [len(vectors[i][0]) for i in inside])
        order = np.lexsort((e, t))
        t, w, e = t[order], w[order], e[order]
        common = np.bincount(t, minlength=len(words))
        frequent = np.argsort(-common, kind="stable")[:DENSE]
        frequent = frequent[common[frequent] >= len(inside) / 16]
        index.row = np.full(len(words), -1)
        index.row[frequent] = np.arange(len(frequent))
        index.matrix = np.zeros((len(frequent), -(-len(inside) // BLOCK) * BLOCK))
        row = index.row[t]
        index.matrix[row[row >= 0], e[row >= 0]] = w[row >= 0]
        t, w, e = t[row < 0], w[row < 0], e[row < 0]
        b = e // BLOCK
        start = np.ones(len(t), bool)
        start[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(start)
        index.example, index.value, index.begin = e, w, np.append(begin, len(t))
        index.block, index.most = b[begin], np.maximum.reduceat(w, begin) if len(begin) else w
        index.first = np.searchsorted(t[begin], np.arange(len(words) + 1))
    _calibrate(index, [(v, y[4 * k]) for k, (v, _, _) in enumerate(index.votes(counted[::4]))])
    return index


def _calibrate(index: Index, seen: list[tuple[float | None, float]]) -> None:
    """A logistic curve over the votes, and the rate of texts without neighbours (both smoothed)."""
    blank = [y for v, y in seen if v is None]
    index.rest = (sum(blank) + 0.1) / (len(blank) + 1.0) if blank else float(index.label.mean()) if len(index.label) else 0.0
    v, y = np.array([v for v, _ in seen if v is not None]), np.array([y for v, y in seen if v is not None])
    a, b = 4.0, -2.0
    for _ in range(30 if len(v) else 0):  # Newton steps, held near the start by a ridge
        p = 1 / (1 + np.exp(-(a * v + b)))
        g = np.array([((p - y) * v).sum() + 0.1 * (a - 4), (p - y).sum() + 0.1 * (b + 2)])
        h = p * (1 - p)
        m = np.array([[(h * v * v).sum() + 0.1, (h * v).sum()], [(h * v).sum(), h.sum() + 0.1]])
        da, db = np.linalg.solve(m, g)
        a, b = float(a - da), float(b - db)
    index.slope, index.shift = a, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Index:
    """Read about ``rows`` labelled texts of at most ``chars`` characters, chosen by a hash of their ids, and index them."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n = marked.count()
    part = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_col)), F.lit(1 << 30)) < int(min(1.0, rows / max(1, n)) * (1 << 30))
    chosen = marked.where(part).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("y"))  # bounded by ``rows``
    got = docs.where(part & F.col(text_col).isNotNull() & (F.length(text_col) <= chars)).join(F.broadcast(chosen), F.col(id_col) == F.col("k"))
    got = got.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col("y").cast("int").alias("y"), F.xxhash64("k", text_col).alias("h")).toArrow().sort_by([("h", "ascending")]).combine_chunks()
    return build(K.texts(got.column("t").combine_chunks()), [int(y > 0) for y in got.column("y").to_pylist()], got.column("k").to_pylist())


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: int = 0) -> DataFrame:
    """One row a text: id, score and, if wanted, the first ``evidence`` neighbours (id, label and cosine)."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = list(m.votes(list(bags(*K.utf8(batch.column(1))))))
            out = [batch.column(0), pa.array([m.probability(v) for v, _, _ in found], pa.float64())]
            if evidence:
                shape = pa.list_(pa.struct([("id", batch.column(0).type), ("label", pa.int32()), ("cosine", pa.float64())]))
                out.append(pa.array([[{"id": m.ids[i], "label": int(m.label[i]), "cosine": float(c)} for i, c in zip(e[:evidence], s[:evidence], strict=True)] for _, e, s in found], shape))
            yield pa.RecordBatch.from_arrays(out, ["id", "score", *(["evidence"] if evidence else [])])

    schema = f"id {kind}, score double" + (f", evidence array<struct<id:{kind},label:int,cosine:double>>" if evidence else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
