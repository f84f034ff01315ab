"""Ranked lexical search over an inverted index whose posting lists are searched as treaps.

``index`` reads every text once.  Each task cuts its rows into blocks of about BLOCK_BYTES;
of a block it writes one row a term (document numbers and term frequencies) and one row
with the block's document ids and lengths.  ``search`` takes the lists of the queries'
terms from the index, brings a block's lists together and makes of each a treap: search
order by document, heap order by impact.  The treaps of a query's terms are walked at
the same time.  An interval of documents stands for one subtree of each list, and the
sum of their roots' impacts bounds every score inside; it is dropped where that cannot
enter the k best, else the document of the heaviest root is scored and splits it in two.

Intervals of all queries of a group are split a level at a time in numpy.  Best scores
from a few blocks (PROBE_BLOCKS) are lower bounds for all others, so most blocks prune
from the start; they decide nothing else.

Cases: a null text has no terms, a row without id is no document, rows that share an id
are documents each.  Queries without id are none; rows that share a query id are one
query, terms repeated.  Equal scores rank by ascending id.  Without documents or queries the result
is empty.  Only id and text columns are read.  Ids of documents are whole numbers.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skriva.llm import kernels as K
from skriva.llm.support import cut, shared_dir

BLOCK_BYTES = 16 << 20
PROBE_BLOCKS = 16
#: Rows (query, term) that are searched for at a time; more are searched for in turns.
TURN_ROWS = 200_000
#: Queries whose intervals are split together; bounds what a block's search holds.
TOGETHER = 32
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: The bytes of terms: 0-9, A-Z as a-z, a-z, and all of UTF-8 beyond ASCII.
_GAP = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])
INDEX = "block bigint, term bigint, docs bigint, total bigint, at binary, tf binary"


def terms_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms, number of terms of each row) of some rows at a time."""
    data, off = K.utf8(column)
    data, off = _LOW[data[off[0] : off[-1]]], off - off[0]
    for i, j in K.blocks(off):
        _, _, h, first = K.doc_words(data, off, i, j, _GAP)
        yield i, h, np.diff(first)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _rows(block: int, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one block; documents are numbered by id."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    order = np.argsort(ids, kind="stable")
    if not np.array_equal(order, np.arange(len(ids))):
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        moved = sizes[order]
        at = np.repeat(first[order] - np.concatenate(([0], np.cumsum(moved)[:-1])), moved) + np.arange(len(terms))
        ids, sizes, terms = ids[order], moved, terms[at]
    one = np.array([0, len(ids)])
    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.array([int((sizes > 0).sum())]), pa.array([len(terms)]), _binary(ids, one), _binary(sizes.astype(np.int32), one)], names)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.argsort(terms, kind="stable")
    terms, doc = terms[order], doc[order]
    new_term = np.concatenate(([True], terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, bool)
    start = np.flatnonzero(new_term | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(terms)])
    tf = np.diff(np.concatenate((start, [len(terms)]))).astype(np.int32)
    doc, head = doc[start], np.flatnonzero(new_term[start])
    bounds = np.concatenate((head, [len(start)]))
    df, total = np.diff(bounds), np.add.reduceat(tf, head, dtype=np.int64) if len(head) else np.zeros(0, np.int64)
    for a in range(0, len(head), 20_000):
        b = min(len(head), a + 20_000)
        lo, hi = bounds[a], bounds[b]
        parts = [np.full(b - a, block), terms[start[head[a:b]]].view(np.int64), df[a:b].astype(np.int64), total[a:b]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, parts), _binary(doc[lo:hi], bounds[a : b + 1] - lo), _binary(tf[lo:hi], bounds[a : b + 1] - lo)], names)


def index(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The inverted index of all rows, written to ``folder`` (else a new one in the shared folder) and read from there."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        ids, sizes, terms = [], [], []

        def written() -> Iterator[pa.RecordBatch]:
            if ids:
                yield from _rows(block, *map(np.concatenate, (ids, sizes, terms)))

        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i, h, n in terms_of(batch.column(1)):
                ids.append(own[i : i + len(n)])
                sizes.append(n)
                terms.append(h)
                held += 8 * len(h) + 16 * len(n)
                if held >= block_bytes:
                    yield from written()
                    block, held = block + 1, 0
                    ids, sizes, terms = [], [], []
        yield from written()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("i is not null")
    rows.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(INDEX).parquet(folder)


# -- one block: treaps and their walk


def treaps(starts: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, root of each list) of the treaps over lists laid end to end; the number of postings stands for none.

    Of equal impacts the first is above.  A node's parent is the lower one of the nearest
    posting before it that is as high and the nearest one behind it that is higher.
    """
    n = len(impact)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    before, behind = np.arange(n) - 1, np.arange(n) + 1

    def settle(at: np.ndarray, lower) -> np.ndarray:
        """Moves pointers past what is lower, along pointers that have already passed it."""
        todo = np.arange(n)
        while len(todo):
            inside = (at[todo] >= 0) & (at[todo] < n)
            todo = todo[inside]
            todo = todo[of[at[todo]] == of[todo]]
            todo = todo[lower(impact[at[todo]], impact[todo])]
            at[todo] = at[at[todo]]
        outside = (at < 0) | (at >= n)
        outside[~outside] = of[at[~outside]] != of[~outside]
        at[outside] = n
        return at

    before, behind = settle(before, np.less), settle(behind, np.less_equal)
    high = np.append(impact, -1)
    under_before = (before < n) & ((behind == n) | (high[before] < high[behind]))
    under_behind = (behind < n) & ~under_before
    left, right = np.full(n + 1, n), np.full(n + 1, n)
    right[before[under_before]] = np.flatnonzero(under_before)
    left[behind[under_behind]] = np.flatnonzero(under_behind)
    root = np.full(len(starts) - 1, n)
    top = np.flatnonzero((before == n) & (behind == n))
    root[of[top]] = top
    return left, right, root


def _best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best, best first; equal scores by document."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = rank < k
    return query[keep], doc[keep], score[keep]


class Lists:
    """The posting lists of one block, end to end, with their treaps."""

    def __init__(self, starts: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.n_docs, self.none = n_docs, len(doc)
        self.left, self.right, self.root = treaps(starts, impact)
        self.of = np.append(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), -1)
        self.doc, self.impact = np.append(doc, n_docs), np.append(impact, 0)
        self._place = self._key(self.of[:-1], doc)
        self._ends = np.append(self._place, -1)

    def _key(self, of: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return of * (self.n_docs + 1) + doc

    def of_document(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The impact of a document in the list of each node; 0 where it is not there."""
        key = self._key(self.of[node], doc)
        spot = np.searchsorted(self._place, key)
        return np.where(self._ends[spot] == key, self.impact[spot], 0)


def walk(lists: Lists, query: np.ndarray, slot: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, doc, score) of the k best of each query at least as good as its floor, and how many documents were scored.

    (query, slot, weight) says which lists a query weighs how.
    """
    left, right, none, n_docs = lists.left, lists.right, lists.none, lists.n_docs
    at_doc, high = lists.doc, lists.impact
    # entries: interval, node, weight; intervals: query, lo, hi (both outside)
    order = np.argsort(query, kind="stable")
    names, f = np.unique(query[order], return_inverse=True)
    c, w = lists.root[slot[order]], weight[order]
    of_query, lo, hi = names, np.full(len(names), -1), np.full(len(names), n_docs)
    least, last = floor.astype(np.int64).copy(), np.full(len(floor), n_docs)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    scored = 0
    while len(f):
        given = w * high[c]
        bound = np.bincount(f, given, len(of_query)).astype(np.int64)
        q = of_query
        live = (bound > least[q]) | (bound == least[q]) & (lo < last[q])
        renamed = np.cumsum(live) - 1
        keep = live[f]
        f, c, w, given = renamed[f[keep]], c[keep], w[keep], given[keep]
        of_query, lo, hi = of_query[live], lo[live], hi[live]
        if not len(f):
            break
        # the document of the heaviest root splits the interval
        head = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        most = np.maximum.reduceat(given, head)
        heaviest = np.flatnonzero(given == most[f])
        d = np.empty(len(head), np.int64)
        d[f[heaviest[::-1]]] = at_doc[c[heaviest[::-1]]]
        mid = d[f]
        score = np.bincount(f, w * lists.of_document(c, mid), len(head)).astype(np.int64)
        scored += len(head)
        found = _best(*(np.concatenate(x) for x in zip(found, (of_query, d, score), strict=True)), k)
        full = np.arange(k - 1, len(found[0]))
        full = full[found[0][full] == found[0][full - k + 1]]
        better = found[2][full] >= least[found[0][full]]
        full = full[better]
        least[found[0][full]], last[found[0][full]] = found[2][full], found[1][full]
        # the root of each side: down to the first node inside it
        sides = []
        for low, top in ((lo[f], mid), (mid, hi[f])):
            node, todo = c.copy(), np.arange(len(c))
            while len(todo):
                x = node[todo]
                here = at_doc[x]
                high_side, low_side = here >= top[todo], here <= low[todo]
                moved = (x != none) & (high_side | low_side)
                todo, x, high_side = todo[moved], x[moved], high_side[moved]
                node[todo] = np.where(high_side, left[x], right[x])
            sides.append(node)
        f2 = np.concatenate((2 * f, 2 * f + 1))
        c2, w2 = np.concatenate(sides), np.concatenate((w, w))
        keep = c2 != none
        f2, c2, w2 = f2[keep], c2[keep], w2[keep]
        order = np.argsort(f2, kind="stable")
        f2, c, w = f2[order], c2[order], w2[order]
        names, f = np.unique(f2, return_inverse=True)
        parent = names // 2
        right_side = names % 2 == 1
        of_query, lo, hi = of_query[parent], np.where(right_side, d[parent], lo[parent]), np.where(right_side, hi[parent], d[parent])
    keep = (found[2] >= floor[found[0]]) & (found[2] > 0)
    return found[0][keep], found[1][keep], found[2][keep], scored


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 25 + (75 * size.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# -- all blocks


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h, n in terms_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n) + i)), pa.array(h.view(np.int64))], ["item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("t")).where("item is not null")
    return rows.mapInArrow(run, f"item {kind}, term bigint").groupBy("item", "term").agg(F.count("*").alias("times"))


def _turn(spark: SparkSession, lists: DataFrame, terms: DataFrame, n_docs: int, n_terms: int, kind: str, k: int) -> DataFrame:
    """The k best of each query of one turn."""
    wanted = F.broadcast(terms.select("term").distinct())  # at most TURN_ROWS numbers
    own = cut(lists.where("term is not null").join(wanted, "term"))
    df = {r.term: r.df for r in own.groupBy("term").agg(F.sum("docs").alias("df")).collect()}  # as many as query terms
    rows = [(r.item, r.term, r.times * weight_of(n_docs, df[r.term])) for r in terms.collect() if r.term in df]
    items = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(items)}
    rows.sort(key=lambda r: number[r[0]])
    plan = (np.array([number[r[0]] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
    sent = spark.sparkContext.broadcast(plan)
    docs = lists.where("term is null")

    def blocks(these: DataFrame, floors) -> DataFrame:
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            query, term, weight = sent.value
            t = table.combine_chunks()
            is_doc = t.column("term").is_null().to_numpy()
            head = int(np.flatnonzero(is_doc)[0])
            ids, sizes = np.frombuffer(t.column("at")[head].as_py(), np.int64), np.frombuffer(t.column("tf")[head].as_py(), np.int32)
            own = np.flatnonzero(~is_doc)
            out = [np.zeros(0, np.int64)] * 3
            if len(own):
                got = t.column("term").take(pa.array(own)).to_numpy()
                own, got = own[np.argsort(got)], np.sort(got)
                at = [np.frombuffer(x, np.int32) for x in t.column("at").take(pa.array(own)).to_pylist()]
                tf = np.concatenate([np.frombuffer(x, np.int32) for x in t.column("tf").take(pa.array(own)).to_pylist()])
                starts, doc = np.concatenate(([0], np.cumsum([len(x) for x in at]))), np.concatenate(at).astype(np.int64)
                of_block = Lists(starts, doc, impacts(tf, sizes[doc], n_docs, n_terms), len(ids))
                slot = np.minimum(np.searchsorted(got, term), len(got) - 1)
                here = (got[slot] == term) & (weight > 0)
                floor = floors.value if floors is not None else np.zeros(int(query.max()) + 1, np.int64)
                parts = []
                for a in range(0, len(floor), TOGETHER):
                    mine = here & (query >= a) & (query < a + TOGETHER)
                    parts.append(walk(of_block, query[mine], slot[mine], weight[mine], floor, k)[:3])
                out = [np.concatenate(x) for x in zip(*parts, strict=True)]
            return pa.table({"q": pa.array(out[0], pa.int64()), "doc_id": pa.array(ids[out[1]], pa.int64()), "score": pa.array(out[2], pa.int64())})

        both = these.select("block", "term", "at", "tf").unionByName(docs.join(these.select("block").distinct(), "block", "left_semi").select("block", "term", "at", "tf"))
        return best_of(both.groupBy("block").applyInArrow(run, "q bigint, doc_id bigint, score bigint"), "q", k)

    if not rows:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    probe = [r.block for r in docs.select("block").orderBy(F.xxhash64("block")).limit(PROBE_BLOCKS).collect()]
    floor = np.zeros(len(items), np.int64)
    for r in blocks(own.where(F.col("block").isin(probe)), None).where(F.col("rank") == k).collect():  # one row a query
        floor[r.q] = r.score
    named = F.broadcast(spark.createDataFrame(list(enumerate(items)), f"q bigint, item_id {kind}"))
    return blocks(own, spark.sparkContext.broadcast(floor)).join(named, "q").select("item_id", "rank", "doc_id", "score")


def best_of(rows: DataFrame, query: str, k: int) -> DataFrame:
    """The k best rows of each query; each task hands on k of its own at most."""
    line = Window.partitionBy(query).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def search(lists: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", turn_rows: int = TURN_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of ``items`` in an index.

    Queries of more than ``turn_rows`` terms together are searched for in turns.
    """
    spark = lists.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    terms = cut(query_terms(items, id_col, text_col))
    size = lists.where("term is null").agg(F.sum("docs").alias("n"), F.sum("total").alias("l")).first()
    turns = max(1, -(-terms.count() // turn_rows))
    out = [_turn(spark, lists, terms.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn), size.n or 0, size.l or 1, kind, k) for turn in range(turns)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
