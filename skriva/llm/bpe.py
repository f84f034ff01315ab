"""Byte-level BPE encoding and decoding by tree reduction.

Encoding is a fold over two trees.

*Text.*  A text is cut in halves down to leaves of LEAF characters; a leaf is split
into the matches of the pattern and each match is encoded.  To join two neighbours, the
matches of the left part whose choice could depend on what follows (they end within two
characters of its end: the pattern never looks further) are taken up again with the
first matches of the right part.  The window grows until one of its match borders,
itself settled, falls on a border of the right part: matching from one place depends on
nothing before it, so all further matches stand as they are.

*Match.*  The bytes of a match are cut at the largest power of two and encoded apart.
To join, the last token of the left and the first of the right are encoded again
together; while the window's first or last token comes out different, the window grows
on that side.  When both come out the same, every pair of neighbours, those across the
window's edges included, is one that encoding leaves alone, so the tokens outside are
final.

Decoding concatenates token bytes up a tree of the same kind.

Cases: a null text is the empty text with no tokens.  Repeated rows are encoded each by
itself, empty tables give an empty result, other columns are not read.  One match of any
length (a text of one letter repeated) costs about n log^2 n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm import kernels as K

LEAF = 1 << 15
#: Bytes below which a part of a match is merged directly; entries that the memories hold.
PART, MEMORY = 8, 250_000
_BIG = 1 << 60

#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
LETTER, NUMBER, SPACE, OTHER, BORDER = range(5)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point: letters (L*), numbers (N*), white space, others."""
    global _classes
    if _classes is None:
        every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        _classes = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                _classes[m.start() : m.end()] = kind
        _classes[[ord(c) for c in WHITE_SPACE]] = SPACE
    return _classes


def match_starts(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where the matches of the pattern begin, given code points and their classes.

    The pattern takes, in this order: one of the seven contractions; letters, numbers or
    others with at most one space before; white space up to the last before a word; white space.
    """
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = (c[1:] != c[:-1]) | (c[1:] == BORDER)
    at = np.flatnonzero(first)
    end = np.append(at[1:], n)
    kind = c[at]
    following = np.append(kind[1:], BORDER)
    # white space before a word: its last character stands alone or goes with the word
    before = (kind == SPACE) & (following < BORDER)
    last = end[before] - 1
    first[last] = True
    joined = last[u[last] == 0x20] + 1
    first[joined] = False
    # 's 't 're 've 'm 'll 'd, where the apostrophe begins a match and stands alone
    quote = at[(kind == OTHER) & (end - at == 1) & (following == LETTER) & (u[at] == 0x27)]
    quote = quote[first[quote]]
    if len(quote):
        x = u[quote + 1]
        y = u[np.minimum(quote + 2, n - 1)]
        two = ((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
        two &= quote + 2 < n
        one = np.isin(x, [0x73, 0x74, 0x6D, 0x64])
        first[quote[one | two] + 1] = False
        past = np.concatenate((quote[one] + 2, quote[two] + 3))
        first[past[past < n]] = True
    return np.flatnonzero(first)


class Bpe:
    """Encoder over ranks {token bytes: id}."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(size)]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    # -- bytes of one match

    def merge(self, b: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of least rank, the leftmost first, until none is left."""
        if len(b) > 64:
            return self._merge_long(b)
        get = self.ranks.get
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, where = _BIG, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1], _BIG)
                if rank < best:
                    best, where = rank, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_long(self, b: bytes) -> tuple[int, ...]:
        """The same through a heap of candidate pairs."""
        get, n = self.ranks.get, len(b)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(b[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := get(b[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : end[i]]])
            i = after[i]
        return tuple(out)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Tokens of the concatenation of what ``left`` and ``right`` encode."""
        if not left or not right:
            return left or right
        pair = left[-1], right[0]
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[pair] = self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
        i = j = 1
        while True:
            ok_left, ok_right = i == len(left) or found[0] == left[-i], j == len(right) or found[-1] == right[j - 1]
            if ok_left and ok_right:
                return left[: len(left) - i] + found + right[j:]
            i, j = (i if ok_left else min(len(left), 2 * i)), (j if ok_right else min(len(right), 2 * j))
            found = self.merge(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))

    def part(self, b: bytes) -> tuple[int, ...]:
        if len(b) <= PART:
            found = self.parts.get(b)
            if found is None:
                if len(self.parts) >= MEMORY:
                    self.parts.clear()
                found = self.parts[b] = self.merge(b)
            return found
        mid = 1 << (len(b) - 1).bit_length() - 1
        return self.join(self.part(b[:mid]), self.part(b[mid:]))

    def piece(self, match: str) -> tuple[int, ...]:
        b = match.encode()
        whole = self.ranks.get(b)
        return (whole,) if whole is not None else self.part(b)

    def learn(self, matches: list[str]) -> None:
        """Encode the matches that memory lacks."""
        if len(self.pieces) >= MEMORY:
            self.pieces.clear()
        pieces, piece = self.pieces, self.piece
        for m in set(matches).difference(pieces):
            pieces[m] = piece(m)

    # -- texts

    def leaf(self, text: str) -> tuple[list[int], list[tuple[int, ...]]]:
        """(start of each match, tokens of each match)."""
        if not text:
            return [], []
        u = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = match_starts(u, classes()[u]).tolist()
        return starts, [self.piece(text[a:b]) if b - a > 64 else self._known(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]

    def _known(self, match: str) -> tuple[int, ...]:
        found = self.pieces.get(match)
        if found is None:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            found = self.pieces[match] = self.piece(match)
        return found

    def tree(self, text: str, leaf: int = LEAF) -> tuple[list[int], list[tuple[int, ...]]]:
        if len(text) <= leaf:
            return self.leaf(text)
        mid = len(text) // 2
        return self.join_texts(text[:mid], self.tree(text[:mid], leaf), text[mid:], self.tree(text[mid:], leaf))

    def join_texts(self, a: str, left: tuple[list, list], b: str, right: tuple[list, list]) -> tuple[list, list]:
        (ls, lt), (rs, rt) = left, right
        keep = len(ls)
        while keep and (ls[keep] if keep < len(ls) else len(a)) + 2 > len(a):
            keep -= 1  # a match that ends this late may depend on what follows
        begin = ls[keep] if keep < len(ls) else len(a)
        take = 4
        while True:
            upto = rs[take] if take < len(rs) else len(b)
            window = a[begin:] + b[:upto]
            ws, wt = self.leaf(window)
            shift = len(a) - begin
            settled = len(window) if upto == len(b) else len(window) - 2
            known = set(rs[: take + 1])
            for k, w in enumerate(ws):
                if w > shift and w <= settled and w - shift in known:
                    at = rs.index(w - shift, 0, take + 1)
                    return ls[:keep] + [x + begin for x in ws[:k]] + [x + len(a) for x in rs[at:]], lt[:keep] + wt[:k] + rt[at:]
            if upto == len(b):
                return ls[:keep] + [x + begin for x in ws], lt[:keep] + wt
            take *= 2

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.tree(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens: concatenation is the monoid, so halves are decoded and joined."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """Tokens of short texts, whose matches are found together; a long text takes its tree."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and len(texts[j]) <= LEAF and size < 1 << 19:
                size += len(texts[j])
                j += 1
            if j == i:
                yield self.encode(texts[i])
                i += 1
                continue
            yield from self._block(texts[i:j])
            i = j

    def _block(self, texts: list[str]) -> Iterator[list[int]]:
        joined = "\0".join(texts) + "\0"
        u = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        c = classes()[u]
        border = np.cumsum([len(t) + 1 for t in texts]) - 1
        c[border] = BORDER
        starts = match_starts(u, c)
        ends = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(ends, [*ends[1:], len(joined)], strict=True)]
        stop = np.searchsorted(starts, border).tolist()
        self.learn(pieces)
        known, lo = self.pieces, 0
        for hi in stop:
            yield list(chain.from_iterable(map(known.__getitem__, pieces[lo:hi])))
            lo = hi + 1


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


_encoders: dict[str, Bpe] = {}


def _encoder(raw: bytes) -> Bpe:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Bpe(read_ranks(raw))
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """One row a text: id, ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids array<int>.

    The file of ranks (under a megabyte for 50,000 tokens) is read once and sent to every executor.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    carried = list(dict.fromkeys([id_col, *keep]))
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(sent.value)
        names = [*(f"c{k}" for k in range(len(carried))), "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
        for batch in K.slices(batches):
            column = batch.column(len(carried))
            counts, ids_sha, out_sha, flat = [], [], [], []
            for ids in bpe.encode_many([t or "" for t in column.to_pylist()]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    flat.append(np.array(ids, np.int32))
            arrays = [*(batch.column(k) for k in range(len(carried))), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names)

    head = ", ".join(f"c{k} {types[c]}" for k, c in enumerate(carried))
    schema = f"{head}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carried)})


def decode(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of token ids; a null list decodes to no bytes."""
    with open(ranks_path, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "data"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)
