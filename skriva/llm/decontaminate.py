"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised alike (A-Z lower-cased; digits, letters
and everything beyond ASCII kept; words joined by one space).  Every window of
``window`` item words, or the whole of a shorter item, is one pattern of a single
automaton over " w1 w2 ... ".  A document's normalised text is scanned once; ends of
matches become word numbers, and these become character offsets in the original text.

The items are collected only after their size has been checked.  Items beyond
``block_chars`` are dealt into blocks of that size; each block has its own automaton
and scans the documents again, and the result of a block is cut before the next.

Cases: a null or empty text has no words and is not contaminated.  Items with a null id
or without words are ignored; items that share an id count once.  Repeated document rows
are judged each by itself.  Empty tables give an empty result, an empty benchmark hits
nothing.  Only the id and text columns are read; others may clash freely.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm import kernels as K
from skriva.llm.support import cut

WINDOW = 13
BLOCK_CHARS = 8 << 20
#: The bytes of the words: 0-9, A-Z as a-z, a-z, and all of UTF-8 beyond ASCII.
_TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAP = np.array([c == 32 for c in _TO])
_built: dict[str, tuple[ahocorasick.Automaton, list[str]]] = {}


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TO).split()


def automaton(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton:
    """Patterns are windows; a pattern's value is (its number of words, the items that hold it)."""
    held: dict[str, set[int]] = defaultdict(set)
    for k, (_, text) in enumerate(items):
        w = normal_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            held[(b" " + b" ".join(w[i : i + window]) + b" ").decode("latin-1")].add(k)
    found = ahocorasick.Automaton()
    for pattern, of in held.items():
        found.add_word(pattern, (pattern.count(" ") - 1, len(pattern), tuple(of)))
    if held:
        found.make_automaton()
    return found


def _of(items: list[tuple[str, bytes]], window: int, key: str) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = automaton(items, window)
    return _built[key]


def scan(text: bytes, words: ahocorasick.Automaton) -> tuple[int, np.ndarray, set[int]]:
    """(number of words, first and last word of each merged hit range, items)."""
    w = text.translate(_TO).split()
    none = np.zeros((0, 2), np.int64)
    if not w or not len(words):
        return len(w), none, set()
    line = " " + b" ".join(w).decode("latin-1") + " "
    spans, of = [], set()
    seen_to, seen_words = 0, 0
    for end, (n, size, items) in words.iter(line):
        begin = end - size + 1
        # words before a match: the gaps before it, counted on from the last match
        if begin >= seen_to:
            seen_words += line.count(" ", seen_to, begin)
            seen_to = begin
            first = seen_words
        else:
            first = seen_words - line.count(" ", begin, seen_to)
        spans.append((first, first + n - 1))
        of.update(items)
    if not spans:
        return len(w), none, of
    spans.sort()
    merged = [list(spans[0])]
    for a, b in spans[1:]:
        if a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return len(w), np.array(merged, np.int64), of


def offsets(text: bytes, ranges: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words as ranges of characters of the original text."""
    raw = np.frombuffer(text, np.uint8)
    s, e = K._spans(raw, ~_GAP[raw])
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(chars[s[a]]), int(chars[e[b]])) for a, b in ranges]


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.i, r.t.encode()))
        size += len(block[-1][1])
        if size >= limit:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


SPANS = "array<struct<start:int,end:int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, ``keep``, n_words, n_hit, items (ids as sorted strings), spans (characters of the original).

    ``keep`` names further columns of ``docs`` to carry, the text among them if wanted.
    """
    blocks = _item_blocks(benchmark, item_id, item_text, block_chars)
    carried = list(dict.fromkeys([id_col, *keep]))
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    read = carried if text_col in carried else [*carried, text_col]
    n, text_at = len(read), read.index(text_col)
    names = [f"c{k}" for k in range(n)]
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(read)))
    out = out.withColumns({"ranges": F.lit(None).cast("array<bigint>"), "items": F.lit(None).cast("array<string>")})
    session = docs.sparkSession
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        sent = session.sparkContext.broadcast((block, hashlib.sha256(repr((window, block)).encode()).hexdigest()))
        last = following is None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            items, key = sent.value
            words = _of(items, window, key)
            for batch in K.slices(batches):
                counts, ranges, ids, hits, spans = [], [], [], [], []
                for text, r0, i0 in zip(K.texts(batch.column(text_at)), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                    total, found, of = scan(text, words)
                    if r0:
                        found = _merge(np.concatenate((np.array(r0, np.int64).reshape(-1, 2), found)))
                    counts.append(total)
                    ranges.append(found.ravel().tolist())
                    ids.append(sorted({*(i0 or ()), *(items[k][0] for k in of)}))
                    if last:
                        hits.append(int((found[:, 1] - found[:, 0] + 1).sum()))
                        spans.append([{"start": a, "end": b} for a, b in offsets(text, found)] if len(found) else [])
                if last:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    own = [batch.column(k) for k in range(len(carried))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, kind)], [*names[: len(carried)], "n_words", "n_hit", "items", "spans"])
                else:
                    own = [batch.column(k) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(ranges, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], [*names, "ranges", "items"])

        head = ", ".join(f"c{k} {types[c]}" for k, c in enumerate(carried if last else read))
        out = out.mapInArrow(run, f"{head}, n_words bigint, n_hit bigint, items array<string>, spans {SPANS}" if last else f"{head}, ranges array<bigint>, items array<string>")
        out = out if last else cut(out)
        block = following
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carried)})


def contaminated():
    """The rule of the queries: a hit, and a twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    numbered = docs.toDF(*(f"d{k}" for k in range(len(docs.columns))))  # no clash with what is added
    at = docs.columns.index(text_col)
    found = decontaminate(numbered, benchmark, id_col="d0", text_col=f"d{at}", keep=tuple(numbered.columns), **options)
    return found.where(~contaminated()).select(*(F.col(f"d{k}").alias(c) for k, c in enumerate(docs.columns)))


def _merge(ranges: np.ndarray) -> np.ndarray:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges.tolist())):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)
