"""Substring deduplication: passages of MIN_WORDS words or more that recur in other documents.

Words (A-Z lower-cased, cut at white space) give five-word shingles.  Of a passage of
MIN_WORDS words whose shingle set has a Jaccard similarity of SIMILARITY with its copy, RUN
words in a row are unchanged, since a change takes four or five shingles.  So a text is
filed under its compact windows of RUN words: the min-hash of the grams of CONTEXT words
in every window of RUN words is a key, and two texts with such a passage have a key in common.
One hash function is enough for that.  The bounds of the windows (``compact_windows``) are not
needed: there is no join of intervals, whole texts are compared once a key meets.

Texts are read once: what moves between executors afterwards are 32 bits of a hash for every
word.  Rows of one key form a star around the one with the least id (rows
stream by in key order, no group is collected); keys that a sample shows to be hot are
dealt into as many shares as their count asks for, which learn the least id of all.  Stars are
gathered by pair of documents, the words of both are fetched and the passages verified: maximal
runs of common shingles on one diagonal, small gaps allowed, whose shingle sets have a Jaccard
similarity of SIMILARITY or more.

What members share with each other and not with the head of their star is found in a
second round.  At a key where the head lacks some window of MIN_WORDS words of two
members or more, these and the head are filed once more: under every such window around
the key, so that a star shares a whole passage and no exact one is left over; and, where a
member shares no passage with the head, under the windows of RUN words around the key,
each with the min-hash of the words on its left and on its right, for near copies.

Result: (id, partner, passages, of_text), ``partner`` being a smaller id that holds the same
passages, with word ranges on both sides, and ``of_text`` a hash of the text they were found
in.  Copies are linked to one representative and not to each other.

Cases: null ids and null or short texts have no passages.  Rows that repeat an id count
each with its own text: passages and cuts are those of the text they were found in, and what
such rows share among themselves is left.  Equal hashes within a text go to the leftmost.  Empty
tables give an empty result, other columns are not read.  Ids of another type than a whole
number raise a TypeError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm import kernels as K
from skriva.llm.support import cut, cut_by, release, small_side

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
WINDOW = MIN_WORDS - SHINGLE + 1  # in shingles
GAP = 2 * SHINGLE
#: A passage of MIN_WORDS words and SIMILARITY has this many shingles in a row unchanged: one word in the middle changed leaves 41 of 46.
SEED = (WINDOW - SHINGLE + 1) // 2
#: So it has these words in a row.  Of every window of SPREAD grams of CONTEXT words the least hash is a key: all lie in RUN words.
RUN = SEED + SHINGLE - 1
CONTEXT = 16
SPREAD = RUN - CONTEXT + 1
#: Shingles beside a window of RUN words whose min-hash tells near copies from others that share the window.
SIDE = 16
#: A key is hot with HOT rows in a sample of one document in SAMPLE; it is dealt into shares of about SHARE rows.
#: The driver holds HOT_KEYS keys at most, those with the most rows.
SAMPLE, HOT, HOT_KEYS, SHARE = 32, 8, 200_000, 512
#: A partner of more pairs than that is sent to several tasks.
HEAVY = 1000
_ANCHORS = "key bigint, salt int, id bigint"
_CODED = "id bigint, own bigint, w binary"
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_LOW = np.uint64((1 << 20) - 1)
PASSAGE = "array<struct<start:int,end:int,partner_start:int,partner_end:int,similarity:double>>"


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def minima(v: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the least value of every window of ``width`` values of one text, values as compared, text of each)."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(v), dtype=np.uint64)
    local = at - first[of].astype(np.uint64)
    packed = v & ~_LOW | local & _LOW  # equal hashes: the leftmost is least
    if len(v) < width:
        return np.zeros(0, np.int64), packed, of
    least = sliding_min(packed, width)
    i = np.flatnonzero(of[: len(least)] == of[width - 1 :])
    return np.unique(i + ((least[i] - local[i]) & _LOW).astype(np.int64)), packed, of


def compact_windows(v: np.ndarray, first: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree nodes that hold a window of ``width`` values.

    ``first`` has the first value of each text and the total.  A node at least that wide
    is the minimum of some sliding window, and so are its ancestors, which bound it.
    """
    c, packed, of = minima(v, first, width)
    if not len(c):
        return c, c, c
    doc, values = of[c], packed[c].tolist()
    l, r = first[doc].copy(), first[doc + 1] - 1
    places, owners = c.tolist(), doc.tolist()
    stack: list[int] = []
    for k, (x, d) in enumerate(zip(values, owners, strict=True)):
        while stack and (owners[stack[-1]] != d or values[stack[-1]] > x):
            j = stack.pop()
            if owners[j] == d:
                r[j] = places[k] - 1
        if stack:
            l[k] = places[stack[-1]] + 1
        stack.append(k)
    return l, c, r


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, own, w) of (id, own, text): ``w`` has 32 bits of each word's hash."""
    for batch in batches:
        data, off = K.utf8(batch.column(2))
        data = _LOWER[data]
        for i, j in K.blocks(off):
            _, _, h, first = K.doc_words(data, off, i, j)
            w = pa.py_buffer((h >> np.uint64(32)).astype(np.uint32))
            column = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(4 * first.astype(np.int64)), w]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), column], ["id", "own", "w"])


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of every text, read once and dealt by id, so that they move no more than once: (id, own, w)."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col}: ids must be whole numbers")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return cut_by(rows.mapInArrow(_codes, _CODED), "id")


def _spread(w: np.ndarray) -> np.ndarray:
    return K.mix(w.astype(np.uint64))


def _anchors(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None = None, shares: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(key, salt, id), once for each text: the least hash of a window of grams of CONTEXT words.

    Keys in ``hot`` are dealt into ``shares`` by id, all others are in share 0.
    """
    for batch in batches:
        data, off = K.utf8(batch.column(2))
        w = np.frombuffer(data, np.uint32) if len(data) else np.zeros(0, np.uint32)
        first_word = off // 4
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in K.blocks(off):
            first = first_word[i : j + 1] - first_word[i]
            h = _spread(w[first_word[i] : first_word[j]])
            of_word = np.repeat(np.arange(j - i), np.diff(first))
            g = K.rolling(h, CONTEXT)
            # grams of one text: those that do not run into the next
            word_at = np.flatnonzero(of_word[: len(g)] == of_word[CONTEXT - 1 :]) if len(g) else np.zeros(0, np.int64)
            of = of_word[word_at]
            c = minima(g[word_at], np.searchsorted(of, np.arange(j - i + 1)), SPREAD)[0]
            key, of = g[word_at[c]], of[c]
            once = np.unique(key + K.mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
            key, own = key[once].view(np.int64), ids[i:j][of[once]].astype(np.int64)
            salt = np.zeros(len(key), np.int32)
            if hot is not None and len(hot):
                place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                found = hot[place] == key
                salt[found] = 1 + (K.mix(own[found].view(np.uint64)) % shares[place[found]].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(own)], ["key", "salt", "id"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key, salt, id, each against the first of its key and salt: (id, partner, key, salt).

    In share 0 only rows of other ids are given.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        start = np.ones(len(key), bool)
        start[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        partner = ids[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))].copy()
        if last is not None and (key[0], salt[0]) == last[:2]:
            border = np.flatnonzero(start[1:])
            partner[: int(border[0]) + 1 if len(border) else len(key)] = last[2]
            start[0] = False
        last = key[-1], salt[-1], partner[-1]
        rows = np.flatnonzero((ids != partner) | (salt > 0))
        yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (ids, partner, key, salt)], ["id", "partner", "key", "salt"])


def _star(rows: DataFrame, salted: bool) -> DataFrame:
    """(id, partner, key), the partner being the least id of the key, also where a hot key is dealt into shares."""
    ordered = rows.select("key", "salt", "id").repartition("key", "salt").sortWithinPartitions("key", "salt", "id")
    out = ordered.mapInArrow(_stars, "id bigint, partner bigint, key bigint, salt int")
    if salted:
        out = cut(out)
        heads = out.where("salt > 0").groupBy("key").agg(F.min("partner").alias("head"))  # HOT_KEYS at most
        out = out.join(F.broadcast(heads.withColumnRenamed("key", "k")), F.col("key") == F.col("k"), "left").withColumn("partner", F.coalesce("head", "partner")).where("id <> partner")
    return out.select("id", "partner", "key")


def _sample(rows: DataFrame) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(SAMPLE)) == 0)


def _hot(rows: DataFrame) -> DataFrame:
    """(key, shares) of the keys that very many documents share, by a sample: a hint for dealing, without effect on the result."""
    counted = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(HOT_KEYS)
    return counted.select("key", F.ceil(F.col("n") * SAMPLE / SHARE).cast("int").alias("shares"))


def hot_keys(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, shares) of the hot keys of coded texts."""
    got = sorted((r.key, r.shares) for r in _hot(_sample(docs).mapInArrow(_anchors, _ANCHORS)).collect())
    return np.array([k for k, _ in got], np.int64), np.array([n for _, n in got], np.int64)


def _words(text: bytes) -> np.ndarray:
    data = _LOWER[np.frombuffer(text, np.uint8)]
    return _spread((K.all_words(data, 0, len(data))[2] >> np.uint64(32)).astype(np.uint32))


def _shingles(text: bytes) -> np.ndarray:
    return K.rolling(_words(text), SHINGLE)


def _extent(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many values a[i:] and b[j:] have in common from their beginning."""
    n, k, size = min(len(a) - i, len(b) - j), 0, 64
    while k < n:
        m = min(size, n - k)
        other = a[i + k : i + k + m] != b[j + k : j + k + m]
        if other.any():
            return k + int(other.argmax())
        k, size = k + m, 2 * size
    return n


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _around_end(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """a[i : i + size] and b[j : j + size] of many places; beyond an end stands what is equal to nothing."""
    k = np.arange(size)
    x, y = i[:, None] + k, j[:, None] + k
    x_in, y_in = (x >= 0) & (x < len(a)), (y >= 0) & (y < len(b))
    return np.where(x_in, a[np.clip(x, 0, len(a) - 1)], np.uint64(0)), np.where(y_in, b[np.clip(y, 0, len(b) - 1)], np.uint64(1))


def _starts(a: np.ndarray, b: np.ndarray, width: int, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Where the maximal common runs of SEED values or more begin, on every diagonal, but those that are too short and alone.

    ``seeds``: hashes of b's windows of SEED values in order, and their places.
    """
    one = K.rolling(a, SEED)
    s, order = _seeds(b) if seeds is None else seeds
    if not len(s) or not len(one):
        return
    lo, hi = np.searchsorted(s, one), np.searchsorted(s, one, "right")
    inner = np.zeros(len(one), bool)  # stands in one place, and goes on there from the value before
    j = order[np.minimum(lo, len(s) - 1)]
    inner[1:] = (hi[1:] - lo[1:] == 1) & (j[1:] > 0) & (a[: len(one) - 1] == b[j[1:] - 1])
    places = np.flatnonzero((hi > lo) & ~inner)
    total = np.cumsum(hi[places] - lo[places])
    done = 0
    while done < len(places):  # about 64K pairs of places at a time
        top = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 16))))
        at = places[done:top]
        i, j = np.repeat(at, hi[at] - lo[at]), order[_ranges(lo[at], hi[at] - lo[at])]
        done = top
        begins = (i == 0) | (j == 0)
        begins |= a[np.maximum(i - 1, 0)] != b[np.maximum(j - 1, 0)]
        i, j = i[begins], j[begins]
        for k in range(0, len(i), 2048):
            x, y = i[k : k + 2048], j[k : k + 2048]
            u, v = _around_end(a, b, x, y, width)
            differ = u != v
            n = np.where(differ.any(1), differ.argmax(1), width)
            use = n >= width
            for p, q in ((x + n, y + n), (x - GAP, y - GAP)):  # does anything follow, does anything come before
                rest = np.flatnonzero(~use)
                u, v = _around_end(a, b, p[rest], q[rest], GAP)
                use[rest] = (u[:, :, None] == v[:, None, :]).any((1, 2))
            yield from zip(x[use].tolist(), y[use].tolist(), strict=True)


def _seeds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = K.rolling(b, SEED)
    order = np.argsort(two, kind="stable")
    return two[order], order


def _onward(a: np.ndarray, b: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the common runs that follow i, j, with gaps under GAP."""
    out = []
    while True:
        di, dj = np.nonzero(a[i : i + GAP, None] == b[None, j : j + GAP])
        if not len(di):
            return out
        k = int((di + dj).argmin())
        i, j = i + int(di[k]), j + int(dj[k])
        n = _extent(a, b, i, j)
        out.append((i, j, n))
        i, j = i + n, j + n


def similar_runs(a: np.ndarray, b: np.ndarray, width: int = WINDOW, similarity: float = SIMILARITY, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, partner_start, partner_end in words, similarity) of shingle lists a and b.

    Common runs are followed on their own diagonal, so a passage is found wherever else its
    parts stand in b.  Of a chain of runs every longest part that is similar enough counts.
    """
    if len(a) >= width and _extent(a, b, 0, 0) == len(a):
        return [(0, len(a) + SHINGLE - 1, 0, len(a) + SHINGLE - 1, 1.0)]
    runs: list[tuple[int, int, int, int, float]] = []
    seen: set[tuple[int, int]] = set()
    back_a, back_b = a[::-1], b[::-1]
    reach = np.zeros(len(a), np.int64)  # the end of the passage that goes furthest over each place
    # the longest first: what lies in a passage already found adds nothing
    for n, i, j in sorted(((_extent(a, b, i, j), i, j) for i, j in _starts(a, b, width, seeds)), key=lambda r: (-r[0], r[1], r[2])):
        if (i, j) in seen:
            continue
        before = [(len(a) - x - m, len(b) - y - m, m) for x, y, m in _onward(back_a, back_b, len(a) - i, len(b) - j)]
        chain = [*before[::-1], (i, j, n), *_onward(a, b, i + n, j + n)]
        seen.update((x, y) for x, y, _ in chain)
        if reach[chain[0][0]] >= chain[-1][0] + chain[-1][2]:
            continue
        x, y, m = np.array(chain).T
        total, done = np.concatenate(([0], np.cumsum(m))), -1
        for k in range(len(chain)):
            same, one, two = total[k + 1 :] - total[k], (x + m)[k:] - x[k], (y + m)[k:] - y[k]
            for e in np.flatnonzero((one >= width) & (same >= similarity * (one + two - same)))[::-1].tolist():
                if k + e <= done:
                    break
                p, q, u, v = int(x[k]), int(x[k] + one[e]), int(y[k]), int(y[k] + two[e])
                s = 1.0
                if e:
                    p_set, u_set = np.unique(a[p:q]), np.unique(b[u:v])
                    both = len(np.intersect1d(p_set, u_set, assume_unique=True))
                    s = both / (len(p_set) + len(u_set) - both)
                if s >= similarity:
                    if q - p == len(a):
                        return [(p, q + SHINGLE - 1, u, v + SHINGLE - 1, s)]
                    if reach[p] < q:
                        runs.append((p, q + SHINGLE - 1, u, v + SHINGLE - 1, s))
                        reach[p:q] = np.maximum(reach[p:q], q)
                    done = k + e
                    break
    # as few as hold every window of every passage
    runs.sort(key=lambda r: (r[0], -r[1], -r[4]))
    out: list[tuple[int, int, int, int, float]] = []
    k = 0
    while k < len(runs):
        best = runs[k]
        k += 1
        while out and k < len(runs) and runs[k][0] <= out[-1][1] - (width + SHINGLE - 1) + 1:
            best = max(best, runs[k], key=lambda r: r[1])
            k += 1
        if not out or best[1] > out[-1][1]:
            out.append(best)
    return out


class _Side:
    """What is computed once of the words of a partner."""

    def __init__(self, w: bytes) -> None:
        self.w = w
        words = _spread(np.frombuffer(w, np.uint32))
        self.shingles = K.rolling(words, SHINGLE)
        self.seeds = _seeds(self.shingles)
        self.whole = np.sort(K.rolling(words, MIN_WORDS))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, partner, own, passages, grams) of (id, partner, own, keys, a, b).

    ``grams`` has the keys at whose places the partner does not hold every window of
    MIN_WORDS words around it word for word, and whether some of these lie in no passage.
    """
    side = _Side(b"")
    for batch in K.slices(batches):
        found: list[tuple] = []
        sizes, grams, missed, gram_sizes = [], [], [], []
        for keys, a, b in zip(batch.column(3), batch.column(4), batch.column(5), strict=True):
            a, b = a.as_py(), b.as_py()
            if a == b:
                n = len(a) // 4
                if n >= MIN_WORDS:
                    found.append((0, n, 0, n, 1.0))
                sizes.append(int(n >= MIN_WORDS))
                gram_sizes.append(0)
                continue
            if b != side.w:
                side = _Side(b)
            one = _spread(np.frombuffer(a, np.uint32))
            runs = similar_runs(K.rolling(one, SHINGLE), side.shingles, seeds=side.seeds)
            found += runs
            sizes.append(len(runs))
            contexts = K.rolling(one, CONTEXT).view(np.int64)
            places = np.flatnonzero(np.isin(contexts, keys.values.to_numpy()))
            windows = K.rolling(one, MIN_WORDS)
            held = side.whole[np.minimum(np.searchsorted(side.whole, windows), max(0, len(side.whole) - 1))] == windows if len(side.whole) else np.zeros(len(windows), bool)
            apart = np.concatenate(([0], np.cumsum(~held)))
            top = len(apart) - 1
            places = places[apart[np.minimum(places + 1, top)] > apart[np.minimum(np.maximum(places + CONTEXT - MIN_WORDS, 0), top)]]
            miss = np.ones(len(places), bool)
            for p, q, *_ in runs:
                miss &= (places < p) | (places + CONTEXT > q)
            key, at = np.unique(contexts[places], return_inverse=True)
            grams.append(key)
            missed.append(np.bincount(at, weights=miss, minlength=len(key)) > 0)
            gram_sizes.append(len(key))
        offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        names = ("start", "end", "partner_start", "partner_end", "similarity")
        passages = pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.float64() if k == 4 else pa.int32()) for k in range(5)], names)
        pairs = pa.StructArray.from_arrays([pa.array(joined(grams, np.int64)), pa.array(joined(missed, bool))], ["key", "missed"])
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(offsets(sizes), passages), pa.ListArray.from_arrays(offsets(gram_sizes), pairs)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "partner", "own", "passages", "grams"])


def _around(h: np.ndarray, grams: list[int], width: int) -> np.ndarray:
    """Where windows of ``width`` words begin that hold one of the grams."""
    at = np.flatnonzero(np.isin(K.rolling(h, CONTEXT).view(np.int64), np.array(grams, np.int64)))
    at = np.unique((at[:, None] - np.arange(width - CONTEXT + 1)[None, :]).ravel())
    return at[(at >= 0) & (at + width <= len(h))]


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, salt, id) of (id, w, grams, near): every window of MIN_WORDS words around a gram; for those in ``near`` also
    every window of RUN words, with the min-hash of the words on either side."""
    for batch in batches:
        for own, w, grams, near in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            h = _spread(np.frombuffer(w.as_py(), np.uint32))
            keys = [K.rolling(h, MIN_WORDS)[_around(h, grams, MIN_WORDS)]]
            if near and len(h) >= MIN_WORDS:
                run, side, at = K.rolling(h, RUN), sliding_min(K.mix(K.rolling(h, SHINGLE)), SIDE), _around(h, near, RUN)
                left, right = at[at >= SIDE + SHINGLE - 1], at[at + RUN < len(side)]
                keys += [K.mix(run[left] ^ K.mix(side[left - SIDE - SHINGLE + 1])), K.mix(run[right] ^ side[right + RUN])]
            key = np.unique(np.concatenate(keys)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int32)), pa.array(np.full(len(key), own, np.int64))], ["key", "salt", "id"])


def _dealt(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of ``_again``, already cut, with hot keys dealt into shares, and whether there are any."""
    hot = cut(_hot(_sample(rows)).withColumnRenamed("key", "k"))
    if hot.isEmpty():
        return rows, False
    salt = F.when(F.col("shares").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("id"), F.col("shares"))).cast("int")
    return rows.join(F.broadcast(hot), F.col("key") == F.col("k"), "left").select("key", salt.alias("salt"), "id"), True


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (id, partner, keys), already cut, with the passages that their texts really share.

    A partner of very many is dealt into shares.
    """
    heavy = small_side(cut(pairs.groupBy("partner").count().where(F.col("count") >= HEAVY).select(F.col("partner").alias("big"), F.ceil(F.col("count") / HEAVY).cast("int").alias("shares"))), 32)
    one = words.select(F.col("id").alias("i"), "own", F.col("w").alias("a"))
    two = words.select(F.col("id").alias("j"), F.col("w").alias("b"))
    held = pairs.join(heavy, pairs.partner == F.col("big"), "left").join(one, F.col("id") == F.col("i")).select("id", "partner", "own", "keys", "shares", "a")
    light = held.where("shares is null").join(two, F.col("partner") == F.col("j"))
    many = two.join(heavy, F.col("j") == F.col("big")).select("j", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = held.where("shares is not null").withColumn("of", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    dealt = dealt.join(many, (dealt.partner == many.j) & (dealt.of == many.share))
    columns = ("id", "partner", "own", "keys", "a", "b")
    both = light.select(*columns).unionByName(dealt.select(*columns))
    return both.mapInArrow(_verify, f"id bigint, partner bigint, own bigint, passages {PASSAGE}, grams array<struct<key:bigint,missed:boolean>>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, partner, passages, of_text): see the module's text."""
    words = coded(docs, id_col, text_col)
    release(docs.sparkSession)
    hot, shares = hot_keys(words)
    star = _star(words.mapInArrow(lambda batches: _anchors(batches, hot, shares), _ANCHORS), salted=len(hot) > 0)
    pairs = star.groupBy("id", "partner").agg(F.collect_set("key").alias("keys"))
    pairs, star = cut(pairs), None
    release(docs.sparkSession)
    first = cut(_verified(pairs, words))
    release(docs.sparkSession)
    # keys at which two documents or more have something that the head has not
    grams = first.select("id", "partner", F.explode("grams").alias("g")).select("id", "partner", "g.key", "g.missed")
    apart = grams.groupBy("key").agg(F.max("missed").alias("near"), F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("key").alias("k"), "near")
    apart = small_side(cut(apart), 24)
    members = grams.drop("missed").join(apart, F.col("key") == F.col("k")).select(F.explode(F.array("id", "partner")).alias("i"), "key", F.when(F.col("near"), F.col("key")).alias("near"))
    members = members.groupBy("i").agg(F.collect_set("key").alias("keys"), F.collect_set("near").alias("near"))
    filed = cut(words.join(members, F.col("id") == F.col("i")).select("id", "w", F.col("keys").alias("grams"), "near").mapInArrow(_again, _ANCHORS))
    release(docs.sparkSession)
    again = _star(*_dealt(filed)).select("id", "partner").distinct().join(pairs.select("id", "partner"), ["id", "partner"], "left_anti")
    again = cut(again.withColumn("keys", F.array().cast("array<bigint>")))
    release(docs.sparkSession)
    out = first.unionByName(_verified(again, words)).where(F.size("passages") > 0)
    # one row a pair, also where rows repeat an id
    return out.groupBy("id", "partner", F.col("own").alias("of_text")).agg(F.array_distinct(F.flatten(F.collect_list("passages"))).alias("passages")).select("id", "partner", "passages", "of_text")


def cut_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that a smaller id holds; a text of nothing else goes.

    Columns stay as they are, but for the text.
    """
    spans = found.groupBy(F.col("id").alias("cut_id"), F.col("of_text").alias("cut_text")).agg(F.flatten(F.collect_list(F.transform("passages", lambda p: F.array(p["start"], p["end"])))).alias("cut_at"))
    spans = cut(spans)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            texts, spans = batch.column(place), batch.column(batch.num_columns - 1)
            if spans.null_count < len(spans):
                new, stay = texts.to_pylist(), np.ones(len(texts), bool)
                for k, s in enumerate(spans.to_pylist()):
                    if s:
                        new[k] = without(new[k], s)
                        stay[k] = bool(new[k].strip())
                arrays = [pa.array(new, texts.type) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
                batch = pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1]).filter(pa.array(stay))
            else:
                batch = batch.select(list(range(batch.num_columns - 1)))
            yield batch

    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no clash with what is added
    same = (F.col(f"c{docs.columns.index(id_col)}") == F.col("cut_id")) & (F.xxhash64(f"c{place}") == F.col("cut_text"))
    rows = numbered.join(small_side(spans, 64), same, "left").drop("cut_id", "cut_text")
    return rows.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def without(text: str, spans: list[list[int]]) -> str:
    """The text without some ranges of words; white space around a cut becomes that before it."""
    raw = text.encode()
    s, e, _ = K.all_words(np.frombuffer(raw, np.uint8), 0, len(raw))
    out, done = [], 0
    for a, b in sorted(spans):
        begin, end = int(s[a]), int(s[b]) if b < len(s) else len(raw)
        if begin > done:
            out.append(raw[done:begin])
        done = max(done, end)
    return (b"".join(out) + raw[done:]).decode()
