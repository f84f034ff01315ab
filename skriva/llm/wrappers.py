"""HTML extraction by wrappers: union-free regular expressions inferred per host.

Learning.  A page becomes a stream of structural tokens (block tags with their first class,
and # for a text).  Runs that repeat are folded into repeated groups, so that pages of one
template with more or fewer paragraphs fold to the same stream.  The distinct streams of a
host are aligned one after the other with its wrapper: a single occurrence of a group joins
the repeated group, what only one side has becomes optional, # is a text slot.  No unions
arise; a wrapper that grows beyond LONG items has its runs of optional items written as one
repeated group of optional tokens, which takes all that the run took.  Streams are reduced to
distinct ones with counts and folded by FAN at a time, so a large host is no large group.

Then every page is matched with its host's wrapper (an automaton over the wrapper's tokens),
which puts each text in a slot.  A slot, with the containers around it, is known by how much
text it holds, how much of that in links, and whether its text is the same on all pages.

Extraction.  Of the slots whose text differs the containers that hold
the most text on the host's pages are the content; where they lie in an <article> or <main>
that is the region, else the least container that also holds the page's <h1>, else the
outermost one; beside the content, slots of links do not count.  Constant slots are the template's
and decide nothing.  Outside the region they go.  Inside it fixed headings, bylines and labels
stay, unless they are links: all of them in an <article> or <main>, else those in a container
with content, and headings and labels between content.
Before all this, as a page is read, elements (nav, footer, form, ...), roles and class names of
menus, notices, adverts and reader comments are left out; a name counts if all its words are of
that kind (related-posts and not related-work), and never on headings and paragraphs.  Character
references are decoded, white space in a block becomes one space, and blocks are joined by one newline.

Cases: a null or empty html gives an empty text; a page without host is learnt under the
empty host; one of a host that was not learnt, or that its wrapper does not match, is
extracted by its containers alone and marked.  Fewer than VARIETY pages of different titles make
no slot constant, nor do copies of one page, and a slot with MOST of a host's text never is.  An element that is never closed ends with the page, in
linear time.  Repeated rows are extracted each by itself, empty tables give an empty result,
other columns are only carried if named.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.llm.support import cut

LONGEST_GROUP, LONG, FAN, VARIETY = 12, 200, 64, 3
#: Share of a slot's text that lies in links from which it is a menu's.
LINKS = 0.7
#: A slot with this share of its host's text is no template's, even if it is constant.
MOST = 0.2
#: Blocks that an article may well have on every page.
LABELS = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "th", "caption", "figcaption"}
BROADCAST_CHARS = 8 << 20
_ATTRS = r"((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[^>=])*+)(?:>|\Z)"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg)(?=[\s/>]){_ATTRS}.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-z][^\s/>]*+){_ATTRS}",
    re.I | re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"[0-9]{3,}")
#: Fixed values of HTML: elements that begin and end a block, that may leave out their end, that are never open, that hold others.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
NO_END = frozenset("p li dt dd tr td th tbody thead tfoot option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote center details div dl fieldset figure footer form header main nav ol section table td ul".split())
#: What is not article text: elements, roles, and words of class names and ids; such a name may also hold words of place and form.
OUT_TAGS = frozenset("nav footer aside form head title button select dialog menu search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
OUT_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended recommendations related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar trending widget widgets".split()
)
FORM_WORDS = frozenset("area article articles bar block body bottom box buttons card cards col column container content desktop fixed floating footer form global grid group header icon icons info inner item items left links list main media mobile outer overlay page panel post posts primary rail reader readers right row secondary section signup site slot sticky stories strip thread title top unit user users visitor wrap wrapper".split())
OUT_ARTICLES = frozenset("ad advert advertisement comment comments reply sponsored".split())
#: Elements that no class name leaves out.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li".split())


def marks(attrs: str) -> tuple[str, bool, set[str], str]:
    """(first class, whether a name is one of OUT_WORDS, class words, role) of a tag's attributes."""
    first, out, words, role = "", False, set(), ""
    if "=" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            value = (a or b or c).lower()
            if name.lower() == "role":
                role = value.strip()
                continue
            for k, token in enumerate(value.split()):
                parts = {w for w in _WORD.split(token) if w}
                out |= not parts.isdisjoint(OUT_WORDS) and parts <= OUT_WORDS | FORM_WORDS
                if name.lower() == "class":
                    words |= parts
                    if not k:
                        first = _DIGITS.sub("0", token)
    return first, out, words, role


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw, ""), ("open", name, attributes) or ("close", name, "")."""
    done = 0
    for m in _TOKEN.finditer(page):
        if m.start() > done:
            yield "text", page[done : m.start()], ""
        done = m.end()
        if m[4]:
            yield ("close" if m[3] else "open"), m[4].lower(), m[5]
    if done < len(page):
        yield "text", page[done:], ""


@dataclass
class Page:
    """One walk over a page: its stream, and of every text block (text, characters in links, containers, element)."""

    stream: list[str] = field(default_factory=list)
    blocks: list[tuple[str, int, str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, page: str) -> Page:
        got = cls()
        if not got._walk(page, OUT_TAGS) and "<form" in page.lower():  # a form around the whole page is no form
            got = cls()
            got._walk(page, OUT_TAGS - {"form"})
        return got

    def _walk(self, page: str, out_tags: frozenset) -> bool:
        stack: list[tuple[str, bool, str]] = []  # (element, left out, container)
        text: list[str] = []
        out = inner = linked = 0
        link = False

        def flush() -> None:
            nonlocal linked
            words = " ".join(entities.unescape("".join(text)).split()) if text else ""
            text.clear()
            if words:
                name = next((e for e, _, _ in reversed(stack) if e in BLOCKS), "")
                self.stream.append("#")
                self.blocks.append((words, min(linked, len(words)), "/".join(c for _, _, c in stack if c), name))
            linked = 0

        def pop(n: int) -> None:
            nonlocal out, inner
            for e, left, _ in stack[n:]:
                out -= left
                inner -= e in ("article", "main")
            del stack[n:]

        for kind, name, attrs in tokens(page):
            if kind == "text":
                if not out:
                    text.append(name)
                    linked += len(name) if link else 0
                continue
            if name in BLOCKS:
                flush()
            elif name in ("br", "img"):
                text.append(" ")
            elif name == "a":
                link = kind == "open"
            if kind == "close":
                n = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == name), -1)
                if n >= 0:
                    pop(n)
                if name in BLOCKS and name not in NO_END:
                    self.stream.append(f"</{name}>")
                continue
            if name in VOID:
                continue
            if name == "body":
                pop(next((n for n, x in enumerate(stack) if x[0] == "head"), len(stack)))
            first, named, words, role = marks(attrs) if attrs else ("", False, set(), "")
            if name in BLOCKS:
                while stack and stack[-1][0] in NO_END and (stack[-1][0] == name or stack[-1][0] == "p"):  # a paragraph without end ends here
                    pop(len(stack) - 1)
                self.stream.append(f"<{name}.{first}>" if first else f"<{name}>")
            if name in ("html", "body"):
                left = False
            elif name in ("article", "main"):
                left = not words.isdisjoint(OUT_ARTICLES)
            else:
                left = name in out_tags or role in OUT_ROLES or name == "header" and not inner or named and name not in PROSE
            if left or name in BLOCKS:
                inside = name in CONTAINERS or role == "main"
                stack.append((name, left, (f"{name}.{first}" if first else name) + ("@main" if role == "main" else "") if inside else ""))
                out += left
                inner += name in ("article", "main")
        flush()
        return bool(self.blocks)


def stream(page: str) -> list[str]:
    """Structural tokens: <block.class>, </block> unless it may be left out, # for text."""
    return Page.of(page).stream


# -- union-free regular expressions: an item is a token, ("+", items) or ("?", items)

_REPEAT = re.compile(r"(.{1,%d}?)\1+" % LONGEST_GROUP, re.S)


def fold(seq: list) -> list:
    """Fold runs that repeat, innermost first, until nothing repeats."""
    while True:
        code: dict = {}
        text = "".join(chr(0x100 + code.setdefault(freeze(x), len(code))) for x in seq)
        out, done, changed = [], 0, False
        for m in _REPEAT.finditer(text):
            out += seq[done : m.start()]
            block = seq[m.start() : m.start() + len(m[1])]
            out.append(block[0] if len(block) == 1 and isinstance(block[0], tuple) and block[0][0] == "+" else ("+", tuple(block)))
            done, changed = m.end(), True
        if not changed:
            return seq
        seq = out + seq[done:]


def freeze(x):
    return x if isinstance(x, str) else (x[0], tuple(map(freeze, x[1])))


def absorb(seq: list, groups: set) -> list:
    """Put single occurrences of known groups in their repeated form."""
    for g in sorted(groups, key=lambda g: (-len(g), repr(g))):
        out, i = [], 0
        while i < len(seq):
            if tuple(map(freeze, seq[i : i + len(g)])) == g:
                if not (out and freeze(out[-1]) == ("+", g)):
                    out.append(("+", g))
                i += len(g)
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def groups_of(seq) -> set:
    found = set()
    for x in seq:
        if isinstance(x, tuple):
            if x[0] == "+":
                found.add(tuple(map(freeze, x[1])))
            found |= groups_of(x[1])
    return found


def align(a: list, b: list) -> list:
    """The wrapper of both: common items stay, items of one side become optional."""
    groups = groups_of(a) | groups_of(b)
    a, b = absorb(list(a), groups), absorb(list(b), groups)
    bare = lambda s: [freeze(x[1][0]) if isinstance(x, tuple) and x[0] == "?" and len(x[1]) == 1 else freeze(x) for x in s]
    ka, kb = bare(a), bare(b)
    out: list = []
    for tag, i, j, k, l in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if tag == "equal":
            for x, y in zip(a[i:j], b[k:l], strict=True):
                out.append(x if freeze(x) == freeze(y) else ("?", (bare([x])[0],)))
        else:
            for part in (a[i:j], b[k:l]):
                for x in part:
                    out.append(x if isinstance(x, tuple) and x[0] == "?" else ("?", (freeze(x),)))
    return out


def write(seq) -> str:
    """A wrapper as text: tokens apart by a space, groups as ( ... )+ and ( ... )?."""
    return " ".join(x if isinstance(x, str) else f"( {write(x[1])} ){x[0]}" for x in seq)


def read(text: str) -> list:
    stack: list[list] = [[]]
    for t in text.split(" ") if text else []:
        if t == "(":
            stack.append([])
        elif t in (")+", ")?"):
            done = stack.pop()
            stack[-1].append((t[1], tuple(done)))
        else:
            stack[-1].append(t)
    return stack[0]


def leaves(seq) -> Iterator[str]:
    for x in seq:
        if isinstance(x, str):
            yield x
        else:
            yield from leaves(x[1])


def shorten(seq: list) -> list:
    """Runs of optional items as one repeated group of optional tokens, which takes all that the run took."""
    out: list = []
    run: list = []
    for x in [*seq, None]:
        if x is not None and not isinstance(x, str) and all(not isinstance(y, str) for y in (x[1] if x[0] == "+" else ())):
            run.append(x)
            continue
        if len(run) > 1:
            out.append(("+", tuple(("?", (t,)) for t in sorted(set(leaves(run))))))
        else:
            out += run
        run = []
        if x is not None:
            out.append(x)
    return out


def infer(streams: list[str]) -> str:
    """The wrapper of folded streams (or of wrappers), aligned in the order given."""
    out: list | None = None
    for s in streams:
        out = read(s) if out is None else align(out, read(s))
        if len(out) > LONG:
            out = shorten(out)
        if len(out) > 10 * LONG:  # nothing in common: any order of the tokens
            out = [("+", tuple(("?", (t,)) for t in sorted(set(leaves(out)))))]
    return write(out or [])


class Matcher:
    """The automaton of a wrapper: its states are the wrapper's tokens, numbered in order."""

    def __init__(self, wrapper: str) -> None:
        self.token: list[str] = []
        self.follow: list[dict[str, list[int]]] = []
        self.known: dict[tuple, list[int] | None] = {}
        nullable, first, self.last = self._add(read(wrapper))
        self.start: dict[str, list[int]] = {}
        for k in first:
            self.start.setdefault(self.token[k], []).append(k)
        self.empty = nullable

    def _link(self, last: list[int], first: list[int]) -> None:
        for a in last:
            for b in first:
                to = self.follow[a].setdefault(self.token[b], [])
                if b not in to:
                    to.append(b)

    def _add(self, seq) -> tuple[bool, list[int], list[int]]:
        """(whether nothing matches it, states that begin it, states that end it)."""
        empty, first, last = True, [], []
        for x in seq:
            if isinstance(x, str):
                self.token.append(x)
                self.follow.append({})
                n, f, l = False, [len(self.token) - 1], [len(self.token) - 1]
            else:
                n, f, l = self._add(x[1])
                if x[0] == "+":
                    self._link(l, f)
                n = n or x[0] == "?"
            self._link(last, f)
            if empty:
                first = first + f
            last = last + l if n else l
            empty = empty and n
        return empty, first, last

    def match(self, stream: list[str]) -> list[int] | None:
        """The state of every token of a stream, or None; of several ways that with the earliest states."""
        key = tuple(stream)
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[key] = self._match(stream)
        return self.known[key]

    def _match(self, stream: list[str]) -> list[int] | None:
        if not stream:
            return [] if self.empty else None
        steps: list[dict[int, int]] = [dict.fromkeys(self.start.get(stream[0], ()), -1)]
        for t in stream[1:]:
            now: dict[int, int] = {}
            for a in sorted(steps[-1]):
                for b in self.follow[a].get(t, ()):
                    now.setdefault(b, a)
            if not now:
                return None
            steps.append(now)
        ends = set(self.last) & set(steps[-1])
        if not ends:
            return None
        at, out = min(ends), []
        for step in reversed(steps):
            out.append(at)
            at = step[at]
        return out[::-1]

    def slots(self, page: Page) -> list[int]:
        """The slot of every text block; -1 where the page does not match."""
        states = self.match(page.stream)
        return [-1] * len(page.blocks) if states is None else [k for k, t in zip(states, page.stream, strict=True) if t == "#"]


# -- extraction


@dataclass
class Host:
    """What is known of a host's slots: by (slot, containers), and how much text the containers hold."""

    constant: set[tuple[int, str]] = field(default_factory=set)
    chrome: set[tuple[int, str]] = field(default_factory=set)  # constant, and links
    menus: set[tuple[int, str]] = field(default_factory=set)
    mass: Counter = field(default_factory=Counter)

    @classmethod
    def of(cls, slots: list[dict]) -> Host:
        got = cls()
        most = MOST * sum(s["chars"] for s in slots)
        for s in slots:
            key = s["slot"], s["path"]
            if s["constant"] and s["variety"] >= VARIETY and s["chars"] < most:
                (got.chrome if s["linked"] >= LINKS * s["chars"] else got.constant).add(key)
            elif s["linked"] >= LINKS * s["chars"]:
                got.menus.add(key)
            else:
                got.mass[s["path"]] += s["chars"] - s["linked"]
        return got


def _within(path: str, region: str) -> bool:
    return not region or path == region or path.startswith(region + "/")


def _common(a: str, b: str) -> str:
    x, y = a.split("/"), b.split("/")
    n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return "/".join(x[:n])


def _marked(path: str, names: tuple[str, ...]) -> list[str]:
    """The containers on a path that are such elements, the outermost first."""
    parts = path.split("/")
    return ["/".join(parts[: k + 1]) for k, c in enumerate(parts) if re.split(r"[.@]", c)[0] in names or c.endswith("@main")]


def region(paths: list[str], titles: list[str], mass: Counter) -> tuple[str, str, bool]:
    """(region, containers with the most text, whether <article> or <main> gives the region).

    An <article> that holds under a fifth of the text does not.
    """
    paths = list(dict.fromkeys(paths))
    heavy = lambda of: max(of, key=lambda p: mass[p])
    mains, articles = [p for p in paths if _marked(p, ("main",))], [p for p in paths if _marked(p, ("article",))]
    if not mains and sum(mass[p] for p in articles) < 0.2 * sum(mass[p] for p in paths):
        articles = []
    best = heavy(mains or articles or paths)
    if not mains and not articles:
        return (_common(best, titles[0]) if titles else best.split("/")[0]), best, False
    where, main = _marked(best, ("article", "main"))[-1], next(iter(_marked(best, ("main",))), None)
    title = next((t for t in titles if main and _within(t, main)), None)
    return (where if title is None else _common(where, title)), best, True


def main_text(page: Page, slots: list[int], host: Host) -> str:
    keys = [(k, path) for k, (_, _, path, _) in zip(slots, page.blocks, strict=True)]
    own = [key not in host.constant and key not in host.chrome for key in keys]
    kept = [n for n, b in enumerate(page.blocks) if own[n] or b[3] == "h1"]
    if not kept:
        return ""
    mass = Counter(host.mass)
    for n in kept:  # decides where the host says nothing
        text, linked, path, _ = page.blocks[n]
        mass[path] += (len(text) - linked) * 1e-6 if host.mass else len(text) - linked
    where, best, marked = region([page.blocks[n][2] for n in kept], [page.blocks[n][2] for n in kept if page.blocks[n][3] == "h1" and own[n]], mass)
    out = {n for n in kept if _within(page.blocks[n][2], where) and (marked or _within(page.blocks[n][2], best) or keys[n] not in host.menus)}
    # what the template repeats inside the content, such as headings, bylines and labels, is the article's
    holders, content = {page.blocks[n][2] for n in out}, [n for n in out if own[n] and keys[n] not in host.menus]
    lo, hi = min(content, default=0), max(content, default=-1)
    for n, key in enumerate(keys):
        if key in host.constant and _within(page.blocks[n][2], where) and (marked or page.blocks[n][2] in holders or lo < n < hi and page.blocks[n][3] in LABELS):
            out.add(n)
    return "\n".join(page.blocks[n][0] for n in sorted(out))


def extract(page: str) -> str:
    """The main text of a page of which nothing else is known."""
    p = Page.of(page)
    return main_text(p, [-1] * len(p.blocks), Host.of([{"slot": -1, "path": b[2], "constant": False, "variety": 0, "chars": len(b[0]), "linked": b[1]} for b in p.blocks]))


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def learn_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(wrapper_host, pages, wrapper) for every host, already made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[h, tuple(stream(page or ""))] += 1
            folded: Counter = Counter()
            for (h, s), n in seen.items():
                folded[h, write(fold(list(s)))] += n
            yield _table([(*k, n) for k, n in folded.items()], ["host", "value", "n"], [pa.string(), pa.string(), pa.int64()])

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "value"], ascending=[False, True])
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "value": [infer(pdf.value.tolist())], "n": [pdf.n.sum()]})

    out = pages.select(host(f"`{url_col}`").alias("host"), F.col(f"`{html_col}`").alias("html")).mapInArrow(run, "host string, value string, n bigint")
    out = cut(out.groupBy("host", "value").agg(F.sum("n").alias("n")))
    while (most := out.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        shares = -(-most // FAN)
        out = cut(out.withColumn("share", F.pmod(F.xxhash64("value"), F.lit(shares))).groupBy("host", "share").applyInPandas(lambda pdf: share(pdf), "host string, value string, n bigint"))
    return out.select(F.col("host").alias("wrapper_host"), F.col("n").alias("pages"), F.col("value").alias("wrapper"))


def _joined(pages: DataFrame, known: DataFrame, size: str, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with what is known of their host, which is sent to all executors if it is small."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host(f"`{url_col}`").alias("host"))
    total = known.agg(F.sum(F.expr(size) + 64)).first()[0] or 0
    return rows.join(F.broadcast(known) if total <= BROADCAST_CHARS else known, rows.host == F.col("wrapper_host"), "left")


class _Matchers(dict):
    def __missing__(self, wrapper: str) -> Matcher:
        if len(self) > 1000:
            self.clear()
        self[wrapper] = m = Matcher(wrapper)
        return m


def learn(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(wrapper_host, pages, wrapper, slots) for every host, already made.

    ``slots``: each slot and the containers around it, with its characters, those in links,
    whether its text is one and the same, and on how many different pages at least (counted by
    64 bits of a hash of their <h1>, or of the first words of their longest text, so that near
    copies count once).
    """
    found = learn_wrappers(pages, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = _Matchers()
        for batch in batches:
            stats: dict[tuple, list[int]] = {}
            for h, html, wrapper in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                page = Page.of(html or "")
                if not page.blocks:
                    continue
                title = next((b[0] for b in page.blocks if b[3] == "h1"), None)
                bit = xxhash.xxh64_intdigest(title or " ".join(max((b[0] for b in page.blocks), key=lambda t: (len(t), t)).split(" ", 5)[:5])) & 63
                bit = (1 << bit) - (1 << 64 if bit == 63 else 0)
                for slot, (text, linked, path, _) in zip(matchers[wrapper].slots(page), page.blocks, strict=True):
                    x = xxhash.xxh64_intdigest(text) >> 1
                    s = stats.get((h, slot, path))
                    if s is None:
                        stats[h, slot, path] = [len(text), linked, x, x, bit]
                    else:
                        s[0] += len(text)
                        s[1] += linked
                        s[2], s[3], s[4] = min(s[2], x), max(s[3], x), s[4] | bit
            rows = [(*k, *v) for k, v in stats.items()]
            yield _table(rows, ["host", "slot", "path", "chars", "linked", "lo", "hi", "bits"], [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 5])

    rows = _joined(pages, found, "length(wrapper)", id_col, url_col, html_col).select("host", "html", "wrapper")
    stats = rows.mapInArrow(run, "host string, slot int, path string, chars bigint, linked bigint, lo bigint, hi bigint, bits bigint").groupBy("host", "slot", "path")
    stats = stats.agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.min("lo") == F.max("hi")).alias("constant"), F.bit_count(F.bit_or("bits")).alias("variety"))
    slots = stats.groupBy(F.col("host").alias("h")).agg(F.collect_list(F.struct("slot", "path", "chars", "linked", "constant", "variety")).alias("slots"))
    return cut(found.join(slots, F.col("wrapper_host") == F.col("h"), "left").drop("h"))


def extract_pages(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars, matched (its stream fits its host's wrapper)."""
    known = wrappers.select("wrapper_host", "wrapper", F.to_json("slots").alias("slots"))
    rows = _joined(pages, known, "length(wrapper) + coalesce(length(slots), 0)", id_col, url_col, html_col).select("id", "url", "html", "wrapper", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, hosts = _Matchers(), {}
        for batch in batches:
            texts, matched = [], []
            for html, wrapper, slots in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                page = Page.of(html or "")
                states = None if wrapper is None else matchers[wrapper].match(page.stream)
                matched.append(states is not None)
                if slots is None:
                    texts.append(extract(html or ""))
                    continue
                if slots not in hosts:
                    if len(hosts) > 1000:
                        hosts.clear()
                    hosts[slots] = Host.of(json.loads(slots))
                texts.append(main_text(page, matchers[wrapper].slots(page), hosts[slots]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(matched, pa.bool_())], ["id", "url", "text", "n_chars", "matched"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint, matched boolean").withColumnRenamed("id", id_col)
