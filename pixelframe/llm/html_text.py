"""Main text of web pages by wrapper induction.

A page's tree is made of its block elements; neighbouring siblings with the same label (tag, classes, id, digits dropped)
fold into one node, so a list or a run of paragraphs is one slot (bare div and section elements with blocks in them do
not). Pages of a host are aligned:

1. Each page is parsed once for its folded tree, its shape, and a digest of the text of each of its blocks; these are
   written. Shapes are counted by host (partial sums first); the most frequent one is the host's reference.
2. Every page's tree is aligned with the reference by simple tree matching: nodes with equal labels match, and among
   their children the order-preserving pairing with the most matched nodes is taken, all the way down.
3. For every reference node the pages' texts at that node are compared. A text that nearly all distinct pages have there
   is template; the rest vary, and the node is a slot.
4. The host's content node is found by where the varying text of its pages lies: from the root down, as long as one child
   holds at least DOMINANT of it. Tags and classes break ties among the nodes of that path (an article or main element, or
   a container of such a name, else the deepest), and decide where no child dominates. Parts that are menus, headers,
   footers, sidebars, notices, adverts, forms or reader comments by their tag, class, id or role hold no content; a class
   word is overruled only by an article or main element in it with most of the text.
5. Each page's text is what lies in its content node, without those parts and without template texts. A page that lacks
   the node uses the nearest node around it that it has below body, or else the same rule on its own tree.

Template texts inside the content go only with evidence: at least MIN_PAGES distinct pages, all but MAX_OTHER of which
agree, and only if they are at most MAX_CONSTANT of the content's text (else the host repeats an article, not a frame).

Text: character references are decoded; a block's white space becomes one space; blocks are joined in page order by one
space. Hosts' wrappers meet pages by a join on the host (broadcast if small by their summed bytes, else sort-merge with
AQE's splits).

Defined results: null or empty html has empty text and 0 characters; a null url is a host of its own; repeated rows give
repeated rows and count once for a wrapper; nothing here recurses, so a page may be nested to any depth, and a node of more
than WIDE children folds all those of one label (then of one tag), which changes alignment only; a raw element that closes
itself is empty, and one of NEVER_RAW that is never closed hides nothing; an empty table gives an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import bounded_arrow, by_bytes, join_small, released, scratch, written

MIN_PAGES, MAX_OTHER, MAX_CONSTANT, DOMINANT = 5, 0.1, 0.3, 0.8
WIDE, MATCHES_HELD, MATCHES_CHARS = 300, 2000, 4 << 20
SLICE_BYTES = 2 << 20
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKENS = re.compile(r"[a-z]+")
# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg object canvas select button".split())
NEVER_RAW = frozenset("svg object canvas select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover semantics annotation".split())
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
SCOPES = frozenset("ul ol dl table html body article section div td th".split())
# What is never content, by tag and by words of class, id and role.
BOILERPLATE_TAGS = frozenset("head nav footer aside form dialog menu".split())
BOILERPLATE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer footers masthead header topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments commentlist respond disqus reply replies pagination pager skip copyright legal disclaimer form".split())
INLINE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion share sharing social popup newsletter subscribe signup".split())
CONTENT_WORDS = frozenset("article content post entry story main body maincontent articlebody postbody".split())


class Node:
    """A block element, or an inline one that is no content: its label, what is in it in order (text pieces and nodes)."""

    __slots__ = ("inline", "items", "label", "tag", "words")

    def __init__(self, tag: str, label: str, words: frozenset[str], inline: bool = False) -> None:
        self.tag, self.label, self.words, self.items, self.inline = tag, label, words, [], inline

    @property
    def blocks(self) -> list[Node]:
        return [x for x in self.items if not isinstance(x, str) and not x.inline]

    @property
    def own_text(self) -> str:
        return " ".join(x for x in self.items if isinstance(x, str)).strip()


@functools.lru_cache(4096)
def boilerplate(label: str) -> str:
    """What says that a node of this label is no content: "tag", "word", or nothing."""
    tag, *words = label.split(".")
    if tag in BOILERPLATE_TAGS:
        return "tag"
    if tag in ("html", "body", "article", "main"):
        return ""
    found = BOILERPLATE_WORDS.intersection(words)
    return "word" if found and not (found <= {"header"} and CONTENT_WORDS.intersection(words)) else ""  # an article's own head is content


def standing(label: str) -> int:
    """How much a label says that its node is the content."""
    tag, *words = label.split(".")
    return 3 if tag == "article" else 2 if tag == "main" else int(tag in ("div", "section", "td") and bool(CONTENT_WORDS.intersection(words)))


@functools.lru_cache(4096)
def _described(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    words: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            words += _TOKENS.findall((m[2] or m[3] or m[4] or "").lower())
    return ".".join([tag, *words]), frozenset(words)


@functools.cache
def _close_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def parse(page: str) -> Node:
    """The page's block tree. Inline elements vanish into their block's text, but for adverts and the like; br, hr and
    images end a word."""
    root = Node("", "", frozenset())
    stack, at, end, held = [root], 0, len(page), Counter()

    def cut(k: int) -> None:
        for n in stack[k:]:
            held[n.tag] -= 1
        del stack[k:]

    def put(node: Node) -> None:
        stack[-1].items.append(node)
        stack.append(node)
        held[node.tag] += 1

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if held[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag and not (tag in INLINE and not stack[k].inline):
                    k -= 1
                if stack[k].tag == tag:
                    cut(k)
            continue
        if tag in INLINE:
            label, words = _described(tag, attributes) if "=" in attributes else (tag, frozenset())
            if words & INLINE_WORDS or stack[-1].inline:
                put(Node(tag, label, words, True))
            continue
        if tag in VOID:
            stack[-1].items.append(" ")
            continue
        if tag in RAW:
            stack[-1].items.append(" ")
            if not attributes.endswith("/"):
                close = _close_of(tag).search(page, at)
                at = close.end() if close else at if tag in NEVER_RAW else end
            continue
        if tag in ENDS_P and held["p"] and any(n.tag == "p" for n in stack[-4:]):
            cut(max(i for i, n in enumerate(stack) if n.tag == "p"))
        if tag in ENDS_SAME and any(held[t] for t in ENDS_SAME[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS_SAME[tag]:
                    cut(k)
                    break
                if stack[k].tag in SCOPES and stack[k].tag not in ("td", "th"):
                    break
        if tag in ("html", "body") and held[tag]:
            continue
        put(Node(tag, *_described(tag, attributes)))
    return root


def blocks(node: Node, skip: Callable[[Node], bool]) -> list[str]:
    """The node's blocks in page order, each with its white space folded; `skip` names the nodes left out."""
    out, run = [], []
    left = [iter(node.items)]
    while left:
        x = next(left[-1], None)
        if isinstance(x, str):
            run.append(x)
            continue
        if x is not None and x.inline:
            continue
        if run:
            out.append(html.unescape("".join(run)))
            run = []
        if x is None:
            left.pop()
        elif not skip(x):
            left.append(iter(x.items))
    return [b for x in out if (b := " ".join(x.split()))]


class Tree:
    """A page's folded tree in preorder: labels, parents, and the page's nodes folded into each."""

    __slots__ = ("labels", "members", "parents")

    def __init__(self, root: Node) -> None:
        self.labels: list[str] = []
        self.parents: list[int] = []
        self.members: list[list[Node]] = []
        left = [("", [root], -1)]
        while left:
            label, nodes, parent = left.pop()
            left += [(name, group, len(self.labels)) for name, group in reversed(_folded(nodes))]
            self.labels.append(label)
            self.parents.append(parent)
            self.members.append(nodes)

    @property
    def shape(self) -> str:
        return "\n".join(f"{p} {name}" for p, name in zip(self.parents, self.labels, strict=True))


def _folded(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    """The children of folded nodes, neighbours of one label together."""
    out: list[tuple[str, list[Node]]] = []
    alone = lambda x: x.label in ("div", "section") and x.blocks
    for n in nodes:
        for x in n.blocks:
            if out and out[-1][0] == x.label and not alone(x) and not alone(out[-1][1][-1]):
                out[-1][1].append(x)
            else:
                out.append((x.label, [x]))
    for name in (lambda x: x, lambda x: x.split(".")[0]) if len(out) > WIDE else (lambda x: x,) if len(nodes) > 1 else ():
        together: dict[str, list[Node]] = {}
        for label, group in out:
            together.setdefault(name(label), []).extend(group)
        out = list(together.items())
        if len(out) <= WIDE:
            break
    return out


def read_shape(shape: str) -> tuple[list[str], list[int]]:
    rows = [line.partition(" ") for line in shape.split("\n")]
    return [label for _, _, label in rows], [int(p) for p, _, _ in rows]


def _children(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            out[p].append(i)
    return out


_matches: dict[tuple[str, str], list[int]] = {}
_chars = [0]


def match(a: str, b: str) -> list[int]:
    """For each node of shape a, in preorder, the node of shape b that simple tree matching pairs it with, or -1. Matches
    are kept for pages of one shape, MATCHES_HELD at a time and about MATCHES_CHARS of shapes."""
    if (a, b) not in _matches:
        if len(_matches) >= MATCHES_HELD or _chars[0] > MATCHES_CHARS:
            forget()
        _matches[a, b] = _match(a, b)
        _chars[0] += len(a) + len(b)
    return _matches[a, b]


def forget() -> None:
    _matches.clear()
    _chars[0] = 0


def _match(a: str, b: str) -> list[int]:
    (la, pa_), (lb, pb) = read_shape(a), read_shape(b)
    ca, cb = _children(pa_), _children(pb)
    found = [-1] * len(la)
    if la[0] != lb[0]:
        return found
    # pairs of equal labels whose parents are such a pair, parents first; leaves count one and need no pair of their own
    pairs = [(0, 0)]
    for x, y in pairs:
        inner = [d for d in cb[y] if cb[d]]
        pairs += [(c, d) for c in ca[x] if ca[c] for d in inner if la[c] == lb[d]]
    weight: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in reversed(pairs):
        p, q = ca[x], cb[y]
        got = np.array([[weight.get((c, d), 1) if la[c] == lb[d] else 0 for d in q] for c in p], np.int32).reshape(len(p), len(q))
        best = np.zeros((len(p) + 1, len(q) + 1), np.int32)
        for i in range(len(p)):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + got[i]))
        i, j, picked = len(p), len(q), []
        while i and j:
            if got[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + got[i - 1, j - 1]:
                picked.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        weight[x, y], chosen[x, y] = 1 + int(best[len(p), len(q)]), picked
    left = [(0, 0)]
    while left:
        x, y = left.pop()
        found[x] = y
        left += chosen.get((x, y), [])
    return found


def _summed(parents: list[int], own: list[float], out: list[bool]) -> list[float]:
    """What each node holds with all below it, without the nodes left out (and what is below them)."""
    sums = [0 if o else x for x, o in zip(own, out, strict=True)]
    for i in range(len(parents) - 1, 0, -1):
        if not out[i]:
            sums[parents[i]] += sums[i]
    return sums


def _left_out(parents: list[int], why: list[str]) -> list[bool]:
    out = [bool(w) for w in why]
    for i, p in enumerate(parents):
        out[i] = out[i] or (p >= 0 and out[p])
    return out


def content_of(labels: list[str], parents: list[int], own: list[float]) -> int:
    """The content node of a tree, given the text of each node of its own; -1 if there is none."""
    why, within = [boilerplate(x) for x in labels], [False] * len(labels)
    for i, (x, p) in enumerate(zip(labels, parents, strict=True)):
        within[i] = standing(x) >= 2 or (p >= 0 and within[p])
        if x.split(".")[0] == "header" and not within[i]:  # a page header is one outside an article
            why[i] = "tag"
    out = _left_out(parents, why)
    held = _summed(parents, own, out)
    if not any(held[i] and standing(x) for i, x in enumerate(labels)):
        # a class word is overruled by an article in it that has most of the text
        tags = _left_out(parents, [w if w == "tag" else "" for w in why])
        whole = _summed(parents, own, tags)
        kept = {i for i, x in enumerate(labels) if not tags[i] and standing(x) >= 2 and not boilerplate(x.replace(x.split(".")[0], "div", 1)) and whole[i] > 0.5 * whole[0]}
        for i in sorted(kept, reverse=True):
            while i >= 0:
                why[i], i = "", parents[i]
        out = _left_out(parents, why)
        held = _summed(parents, own, out)
    if not held[0]:
        return -1
    children = _children(parents)
    path = [0]
    while below := [c for c in children[path[-1]] if not out[c] and children[c] and held[c] >= DOMINANT * held[0]]:
        path.append(max(below, key=lambda c: held[c]))
    named = max(path, key=lambda i: (standing(labels[i]), -i))
    if standing(labels[named]):
        return named
    inside = {path[-1]}
    for i, p in enumerate(parents):
        if p in inside and not out[i]:
            inside.add(i)
    named = max(inside, key=lambda i: (standing(labels[i]) if held[i] else 0, held[i], -i))
    return named if standing(labels[named]) and held[named] else path[-1]


def digest_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(page: str, shape: str | None = None, content: int | None = None, constant: frozenset[tuple[int, int]] = frozenset()) -> str:
    """The page's main text with a host's wrapper (its reference shape, content node and template texts), or without one."""
    tree = Tree(parse(page))
    aligned = match(tree.shape, shape) if shape else []
    at = -1
    if shape and content is not None and content >= 0:
        labels, parents = read_shape(shape)
        place = {k: i for i, k in enumerate(aligned) if k >= 0}
        first = content
        while at < 0 and content >= 0 and (content == first or labels[content] not in ("", "html", "body")):
            at, content = place.get(content, -1), parents[content]
    if at < 0:
        at = content_of(tree.labels, tree.parents, [sum(len(n.own_text) for n in m) for m in tree.members])
    if at < 0:
        return ""
    drop = {id(n) for m, k in zip(tree.members, aligned, strict=False) for n in m if not n.blocks and (k, digest_of(n.own_text)) in constant} if constant else set()
    outside = not standing(tree.labels[at]) >= 2
    skip = lambda x: bool(boilerplate(x.label)) or (outside and x.tag == "header") or id(x) in drop
    return " ".join(b for n in tree.members[at] for b in blocks(n, skip))


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def induced(shape: str, texts: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """(content node, template texts) of a host from what its pages have at each node: rows of node, digest, n (distinct
    pages) and chars (a page's, on average); digest null for the node as a whole."""
    labels, parents = read_shape(shape)
    pages, full = [0] * len(labels), [0.0] * len(labels)
    for t in texts:
        if t["digest"] is None:
            pages[t["node"]], full[t["node"]] = t["n"], t["chars"]
    fixed = [t for t in texts if t["digest"] is not None and t["n"] >= max(MIN_PAGES, (1 - MAX_OTHER) * pages[t["node"]])]
    varying = list(full)
    for t in fixed:
        varying[t["node"]] = max(0.0, varying[t["node"]] - t["chars"])
    content = content_of(labels, parents, varying)
    if content < 0:
        content = content_of(labels, parents, full)
    under = {content}
    for i, p in enumerate(parents):
        if p in under and not boilerplate(labels[i]):
            under.add(i)
    constant = sorted((t["node"], t["digest"]) for t in fixed if t["node"] in under - {content})
    if sum(t["chars"] for t in fixed if t["node"] in under) > MAX_CONSTANT * sum(full[i] for i in under if i >= 0):
        constant = []
    return content, constant


def parsed(pages: DataFrame) -> DataFrame:
    """(host, page, shape, nodes, digests, sizes) of every page, from one parse: its digest, its folded tree, and of each of
    its blocks with text the folded node, the text's digest and length. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for batch in by_bytes(batches, "html", SLICE_BYTES):
            cols: list[list] = [[] for _ in kinds]
            for page in batch.column("html").to_pylist():
                tree = Tree(parse(page or ""))
                found = [(k, digest_of(text), len(text)) for k, m in enumerate(tree.members) for n in m if (text := n.own_text)]
                k, digests, sizes = zip(*found, strict=True) if found else ((), (), ())
                for c, x in zip(cols, (digest_of(page or ""), tree.shape, k, digests, sizes), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("host"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["host", "page", "shape", "nodes", "digests", "sizes"])

    return written(pages.mapInArrow(released(run), "host string, page long, shape string, nodes array<int>, digests array<long>, sizes array<int>"), "parsed-pages")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, shape, content, constant) of every host; pages: host, html."""
    rows = parsed(pages)
    counted = rows.groupBy("host", "shape").agg(F.count("*").alias("n"))
    usual = written(counted.groupBy("host").agg(F.max_by("shape", F.struct("n", F.length("shape"), "shape")).alias("usual")), "shapes")
    met = join_small(rows, usual, "host", "inner", _bytes(usual, F.length("usual")), 1)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for host, page, shape, nodes, digests, sizes, usual in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                aligned, total = match(shape, usual), Counter()
                once = {(aligned[k], d): s for k, d, s in zip(nodes, digests, sizes, strict=True) if aligned[k] >= 0}
                for (k, _), s in once.items():
                    total[k] += s
                for k, d, s in [*((k, d, s) for (k, d), s in once.items()), *((k, None, s) for k, s in total.items())]:
                    for c, x in zip(out, (host, page, k, d, s), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["host", "page", "node", "digest", "size"])

    met = met.select("host", "page", "shape", "nodes", "digests", "sizes", "usual")
    texts = met.mapInArrow(released(slots, forget), "host string, page long, node int, digest long, size long")
    # copies of a page count once
    each = texts.groupBy("host", "node", "digest").agg(F.count_distinct("page").alias("n"), F.avg("size").alias("chars"))
    # of a host's texts only those that may be template, and the sums of its nodes, are gathered
    stats = each.where(F.col("digest").isNull() | (F.col("n") >= MIN_PAGES)).groupBy("host").agg(F.collect_list(F.struct("node", "digest", "n", "chars")).alias("texts"))

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("node", pa.int32()), ("digest", pa.int64())])))
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for host, shape, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content, constant = induced(shape, texts or [])
                for c, x in zip(out, (host, shape, content, [{"node": k, "digest": d} for k, d in constant]), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["host", "shape", "content", "constant"])

    joined = usual.join(stats, "host", "left").select("host", F.col("usual").alias("shape"), "texts")
    return joined.mapInArrow(released(induce), "host string, shape string, content int, constant array<struct<node: int, digest: long>>")


def _bytes(hosts: DataFrame, of: F.Column) -> int:
    """About the bytes of a table of hosts."""
    return int(hosts.agg(F.sum(F.length("host") + of + 100)).first()[0] or 0)


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrapped: bool = True) -> DataFrame:
    """Per row: the id, the url, text, n_chars. Without `wrapped` each page's own tree decides, which is for comparison."""
    bounded_arrow(df.sparkSession)
    pages = df.select(df[id_col].alias("__id"), df[url_col].alias("__url"), df[html_col].alias("html"), _host(df[url_col]).alias("host"))
    if wrapped:
        with scratch(df.sparkSession) as folder:
            found = written(wrappers(pages.select("host", "html")), "wrappers", folder)
        met = join_small(pages, found, "host", "left", _bytes(found, F.length("shape") + 16 * F.size("constant")), 1)
    else:
        met = pages.selectExpr("*", "CAST(NULL AS STRING) AS shape", "CAST(NULL AS INT) AS content", "CAST(NULL AS ARRAY<STRUCT<node: INT, digest: BIGINT>>) AS constant")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", SLICE_BYTES):
            rows = zip(*(batch.column(x).to_pylist() for x in ("html", "shape", "content", "constant")), strict=True)
            texts = [main_text(page or "", shape, content, frozenset((c["node"], c["digest"]) for c in constant or ())) for page, shape, content, constant in rows]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = met.mapInArrow(released(read, forget), f"id {pages.schema['__id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)
