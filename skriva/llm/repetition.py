"""Quality rules by repetition coverage.

A text's words are hashed in numpy, rolling hashes give every n-gram of several
lengths, and the characters inside n-grams that occurred before in the same text are
measured against the characters of all its words; repeated lines likewise.  The first
occurrence is not held against a text, so one notice at its top and foot is no fault.

Cases: a null or empty text has no words, fails the base rule (fewer than 50 words) and
has shares of zero.  Repeated rows are judged each by itself.  An empty table gives an
empty result.  Columns other than the id and the text are ignored unless named in
``keep``.  A long text is hashed in blocks; only its word hashes stay in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skriva.llm import kernels as K

#: Length of n-gram: largest share of word characters inside repeated n-grams of that length.
NGRAM_SHARES = {5: 0.25, 7: 0.22, 10: 0.20}
#: Largest share of word characters on lines that repeat an earlier line.
LINE_SHARE = 0.30
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
_WORD_CHAR = ~K.SPACE & ((np.arange(256) & 0xC0) != 0x80)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_SHARES))


def _windows(h: np.ndarray, first: np.ndarray, n: int, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words that occur twice or more in their text, and of those that occurred before.

    A window repeats only if its first three words do, so after the shortest length only
    ``among`` is looked at.
    """
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = K.rolling(h, n)
    at = np.arange(len(g)) if among is None else among[among < len(g)]
    at = at[of[at] == of[at + n - 1]]
    key = K.mix(g[at] + of[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    found = K.repeated(key)
    at, key = at[found], key[found]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    return at, at[later]


def coverage(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text in a buffer."""
    n = len(off) - 1
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    for i, j in K.blocks(off):
        s, e, h, first = K.doc_words(data, off, i, j)
        lo, hi = off[i], off[j]
        part = data[lo:hi]
        chars = np.concatenate(([0], np.cumsum(_WORD_CHAR[part], dtype=np.int64)))
        per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[off[i : j + 1] - lo])
        out["n_words"][i:j] = np.diff(first)
        out["word_chars"][i:j] = np.diff(chars[off[i : j + 1] - lo])
        out["n_symbols"][i:j] = per(_SYMBOL[part])
        size = chars[e - lo] - chars[s - lo]
        within = lambda mask, weight: np.diff(np.concatenate(([0], np.cumsum(np.where(mask, weight, 0), dtype=np.int64)))[first])  # noqa: B023, E731
        again, _ = _windows(h, first, 3, None)
        out["n_repeat_words"][i:j] = within(K.cover(again, 3, len(s)), 1)
        for length in NGRAM_SHARES:
            if not len(again):
                break
            _, later = _windows(h, first, length, again)
            out[f"dup_{length}gram_chars"][i:j] = within(K.cover(later, length, len(s)), size)
        ls, le, lh, lfirst = K.doc_words(data, off, i, j, _LINE)
        held = chars[le - lo] - chars[ls - lo]
        of = np.repeat(np.arange(j - i), np.diff(lfirst))
        key = K.mix(lh + of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(key, kind="stable")
        dup = np.zeros(len(key), bool)
        dup[order[1:][key[order[1:]] == key[order[:-1]]]] = True
        dup &= held > 0
        of_dup = of[dup]
        out["n_dup_lines"][i:j] = np.bincount(of_dup, minlength=j - i)
        out["dup_line_chars"][i:j] = np.bincount(of_dup, weights=held[dup], minlength=j - i).astype(np.int64)
    return out


def verdict(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    good = ~failed & (c["dup_line_chars"] <= LINE_SHARE * c["word_chars"])
    for n, share in NGRAM_SHARES.items():
        good &= c[f"dup_{n}gram_chars"] <= share * c["word_chars"]
    return failed, good


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: the id, the counts of COUNTS, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = coverage(*K.utf8(batch.column(1)))
            failed, kept = verdict(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[x], pa.int64()) for x in COUNTS), pa.array(failed), pa.array(kept)], [id_col, *COUNTS, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
