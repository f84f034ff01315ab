"""Language identification by averaged hashed subword embeddings and a linear softmax.

Features are the hashed byte n-grams (2 to 4) of the text, A-Z lower-cased and every run
of other ASCII than letters one gap.  A text is the average of its n-grams' embeddings;
a linear layer and a softmax give the languages.  Both layers are trained by stochastic
gradient descent in numpy on the driver, on a bounded sample of labelled texts; a part
of the sample sets the softmax temperature, so scores are calibrated probabilities, and
the rejection threshold: the probability that all but REJECT of its rightly named texts reach.
Because the model is linear after averaging, embedding times layer is one table of
BUCKETS x languages (under a megabyte), which is sent to the executors, and whole texts are
scored there in numpy, block by block.

Cases: a null text or one without any letter is `und` with score 0 and rejected; a text whose
best probability is under the threshold keeps its best language and is marked ``rejected``.
With no labelled text at all, every text is `und` and rejected.  Repeated rows are scored
each by itself, empty tables give an empty result, other columns are not read.  Long texts are
walked whole in blocks whose n-grams join; labelled texts over SAMPLE_CHARS characters are
only never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm import kernels as K

BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (2, 3, 4)
#: The training sample: at most about so many labelled texts, each of at most so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
#: Share of texts of the learnt languages that the rejection threshold gives up.
REJECT = 0.01
_NORMAL = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def _gram_ids(b: np.ndarray, n: int) -> np.ndarray:
    """Bucket of every n-gram of normalised bytes."""
    h = np.full(max(0, len(b) - n + 1), n, np.uint32)
    for k in range(n):
        h = (h ^ b[k : k + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int32)


def normal(data: np.ndarray) -> np.ndarray:
    b = _NORMAL[data]
    gap = b == 32
    return b[~(gap & np.concatenate(([False], gap[:-1])))]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of one text."""
    b = normal(np.frombuffer(text, np.uint8))
    ids = np.concatenate([_gram_ids(b, n) for n in GRAMS])
    u, c = np.unique(ids, return_counts=True)
    return u, (c / max(1, c.sum())).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times layer, over the temperature
    bias: np.ndarray
    reject: float = 0.0  # a best probability under it is rejected


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 1) -> Model:
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    x, y = [features(t) for t in texts], np.array([langs.index(s) for s in labels])
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32) * 4
    out, bias = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    order = rng.permutation(len(x))
    held, learnt = (order[: len(x) // 8], order[len(x) // 8 :]) if len(x) >= 80 else (order, order)
    steps, done = epochs * len(learnt), 0
    for _ in range(epochs):
        for i in rng.permutation(learnt):
            ids, share = x[i]
            step = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            mean = share @ emb[ids]
            g = _softmax(mean @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= 0.1 * step * np.outer(mean, g)
            bias -= 0.01 * step * g
            emb[ids] -= step * share[:, None] * back[None, :] * 8
    table = emb @ out
    z = np.array([x[i][1] @ table[x[i][0]] + bias for i in held])
    losses = []
    temperatures = np.geomspace(0.2, 20, 60)
    for t in temperatures:  # the temperature with the least log loss on texts that were held back
        p = _softmax(z / t)
        losses.append(-np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-9)).mean())
    t = float(temperatures[int(np.argmin(losses))])
    p = _softmax(z / t)
    best = p.max(1)[p.argmax(1) == y[held]]
    return Model(langs, (table / t).astype(np.float32), (bias / t).astype(np.float32), float(np.quantile(best, REJECT)) if len(best) else 0.0)


def scores(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probabilities of each text of a buffer."""
    n, sums, counts = len(off) - 1, np.zeros((len(off) - 1, len(model.langs))), np.zeros(len(off) - 1)
    for i, j in K.blocks(off):
        for d in range(i, j):
            before = np.zeros(0, np.uint8)  # the end of the block before, for n-grams that run over the border
            for lo in range(int(off[d]), int(off[d + 1]), K.BLOCK):
                b = normal(data[lo : min(int(off[d + 1]), lo + K.BLOCK)])
                if len(before) and len(b) and before[-1] == 32 == b[0]:
                    b = b[1:]
                b = np.concatenate((before, b))
                for g in GRAMS:
                    ids = _gram_ids(b[max(0, len(before) - g + 1) :], g)
                    counts[d] += len(ids)
                    hist = np.bincount(ids, minlength=BUCKETS) if len(ids) > BUCKETS else None
                    sums[d] += hist @ model.table if hist is not None else model.table[ids].sum(0)
                before = b[-(max(GRAMS) - 1) :]
    return _softmax(sums / np.maximum(counts, 1)[:, None] + model.bias)


def has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore")))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Train on about ``rows`` labelled texts of at most ``chars`` characters, chosen by a hash of their ids."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= chars))
    n = known.select(id_col).count()
    part = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 30))
    got = known.where(part < int(min(1.0, rows / max(1, n)) * (1 << 30))).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(text_col).alias("h")).toArrow().sort_by([("h", "ascending"), ("l", "ascending")]).combine_chunks()
    return train(K.texts(got.column(0).combine_chunks()), got.column(1).to_pylist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: id, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            column = batch.column(1)
            letters = np.array([has_letter(t) for t in K.texts(column)], bool)
            lang, score, rejected = np.full(len(column), "und", object), np.zeros(len(column)), np.ones(len(column), bool)
            if m.langs and len(column):
                p = scores(m, *K.utf8(column))
                best = p.argmax(1)
                score = np.where(letters, p[np.arange(len(best)), best], 0.0)
                lang, rejected = np.where(letters, np.array(m.langs, object)[best], "und"), ~letters | (score < m.reject)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
