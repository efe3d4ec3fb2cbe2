"""Operator 2: main text of web pages by wrapper induction.

Pages of a host share a template. A page becomes a tree of its block elements; a run of equal leaf siblings (paragraphs,
list items) is one node whose text is the sequence of theirs. Two pages of a host, those with the smallest and the
largest hash, are its pivots, and every page is aligned with both by simple tree matching: the most pairs of nodes with
equal keys (element and class, whatever numbers it has), parents with parents and children in order. Over the host's pages each node of a pivot
then gets three sums: pages with a partner for it, pages whose partner has the same text, and the text that varied. A
node that is the same on most pages is template, varying slots are content, and the narrowest element around nine tenths
of the varying text is the main region; a varying ``h1`` before it is its title.

Sums don't depend on which task read a page, so neither does the result. A wrapper is one page and its sums, whatever the
host's number of pages. Pages whose content equals the pivot's don't count, so a host that holds copies of one article
doesn't make it template, and paragraphs, headings, quotes and tables without a class are never dropped as such.

On a page the blocks of the nodes aligned with the region are its text: white space in a block becomes one space, blocks
are joined by newlines. Elements that HTML reserves for menus, footers, sidebars, forms and scripts go always. Where the
alignment leaves it open (a notice that differs from page to page, a host of one page), words in classes and ids decide, if
they are all that an element's names say (``share-price`` or ``related work`` says more) and it is no paragraph, heading,
quote or table, unless that would drop most of the page. Pages that lack the region, and hosts of fewer than three different pages, take
the narrowest element around nine tenths of their own text, without blocks that are nothing but links.

Null html is empty and gives an empty text. Pages without a host (null or relative url) are aligned with nothing. Repeated
rows give repeated results; an empty table gives an empty table; other columns are ignored. The wrappers are joined to
the pages by broadcast while they have at most ``BROADCAST`` bytes, else by host, where hosts above a 256th of all pages
are salted and pages without a host are dealt out.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, sliced

# Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg math button select textarea menu dialog object canvas audio video title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = BLOCK - HEADINGS - {"p", "hr"}
PROSE = frozenset("p li dt dd blockquote pre figcaption caption table tbody thead tfoot tr td th # html body article main".split()) | HEADINGS

# A choice: words of classes and ids that speak for something else than main text, anywhere in a name and as a whole name.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr newsletter subscribe signup login popup modal overlay disqus comments pagination pager related recommended recommendations share sharing widget widgets toolbar topbar masthead".split())
WHOLE = frozenset("nav aside side banner notice notices notification alert comment discussion reply replies respond reviews copyright disclaimer header subscription tags paging search searchform skip".split())

#: Words that may stand beside such a word in the names of an element that it speaks for; any other word takes the element out.
BESIDE = frozenset("area article articles bar block bottom box button buttons col column container content entry extra form group header holder icon icons id inner item items js label left line link links list main module outer page panel post posts primary right row secondary section site slot social small story text top ui unit view wrap wrapper zone".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
NUMBER = re.compile(r"[0-9]+")
#: Share of the varying text that the main region holds, and that must lie outside of marked elements if marks are to count.
HELD, PLAIN = 0.9, 0.1
#: Different pages beside the pivot with the same text that make a node template, in number at least; they must be most pages.
SAME = 2
#: Bytes of wrappers that are broadcast at most, copies of a hot host's wrapper, and bytes of what a task keeps at hand.
BROADCAST, SALTS, AT_HAND = 32 << 20, 256, 32 << 20


class Node:
    __slots__ = ("tag", "key", "off", "marked", "children")

    def __init__(self, tag: str, key: str, off: bool = False, marked: bool = False):
        self.tag, self.key, self.off, self.marked, self.children = tag, key, off, marked, []  # children: nodes and texts


def node(tag: str, attributes: str, stack: list[Node]) -> Node:
    off, marked, other, key = tag in DROPPED, False, False, tag
    if tag == "header":
        off = not any(x.tag in ("article", "main") for x in stack)
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            value, name = value.strip("\"'"), name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                off = True
            elif name in ("class", "id", "role"):
                names = value.split()
                if name == "class" and names:
                    key = f"{tag}.{'.'.join(sorted({NUMBER.sub('0', x) for x in names}))}"  # numbers of posts differ from page to page
                for x in names:
                    words = [w.lower() for w in NAME.findall(x)]
                    own = x.lower() in WHOLE or not MARKS.isdisjoint(words)
                    marked = marked or own
                    other = other or not own and not BESIDE.issuperset(words) or own and not (MARKS | WHOLE | BESIDE).issuperset(words)
    return Node(tag, key, off, marked and not other and tag not in PROSE)


def parse(page: str) -> Node:
    """The tree of a page, with open ends and stray ends as browsers take them."""
    root = Node("#", "#")
    stack, opened, at, n = [root], Counter(), 0, len(page)

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    last = page.rfind(">")
    while at < n:
        m = TAG.search(page, at) if at <= last else None
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if tag not in BLOCK and stack[k].tag in CONTAINER:
                        break
            continue
        if tag in BLOCK:
            close(stack, opened, tag, cut)
        own = node(tag, m[3], stack)
        stack[-1].children.append(own)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            own.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(own)
        opened[tag] += 1
    return root


#: By the start of an element: the open ones it ends, and the elements within which.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}


def close(stack: list[Node], opened: Counter, tag: str, cut) -> None:
    """End the elements that the start of a block ends: an open paragraph, and an open element of its own list."""
    if opened["p"] or tag in HEADINGS and opened[tag]:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or tag in HEADINGS and stack[k].tag == tag:
                cut(k)
                break
            if stack[k].tag in CONTAINER:
                break
    ends, within = ENDS.get(tag, ("", ""))
    if any(opened[x] for x in ends.split()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in within.split():
                break
            if stack[k].tag in ends.split():
                cut(k)
                break


class Tree:
    """A page's block elements in page order; a run of equal leaf siblings is one node. Everything is a list by node.

    ``text`` is the hash of all text at and under a node, ``shape`` that of its keys; ``prose`` and ``linked`` count the
    characters outside and inside of links at the node itself. What is always dropped isn't in the tree.
    """

    def __init__(self, root: Node):
        self.nodes: list[list[Node]] = []
        self.parent: list[int] = []
        self.marked: list[bool] = []
        self.own: list[str] = []
        self.prose: list[int] = []
        self.linked: list[int] = []
        todo: list[tuple[list[Node], int]] = [([root], -1)]
        while todo:
            run, parent = todo.pop()
            at = len(self.nodes)
            self.nodes.append(run)
            self.parent.append(parent)
            self.marked.append(run[0].marked or parent >= 0 and self.marked[parent] and run[0].tag not in ("article", "main"))
            blocks = self.read(run)
            runs: list[list[Node]] = []
            for x in blocks:
                if runs and runs[-1][0].key == x.key and x.tag not in CONTAINER | {"p"} or runs and runs[-1][0].key == x.key and leaf(x) and leaf(runs[-1][0]):
                    runs[-1].append(x)
                else:
                    runs.append([x])
            todo += [(r, at) for r in reversed(runs)]
        self.keys = [r[0].key for r in self.nodes]
        self.finish()

    def read(self, run: list[Node]) -> list[Node]:
        """Take the text of a run up to the blocks in it, and give these."""
        blocks, texts, prose, linked = [], [], 0, 0
        todo: list = [(c, False) for x in reversed(run) for c in reversed(["\n", *x.children])]
        while todo:
            x, link = todo.pop()
            if isinstance(x, str):
                texts.append(x)
                n = len(x.strip())
                prose, linked = (prose, linked + n) if link else (prose + n, linked)
            elif x.off:
                continue
            elif x.tag in BLOCK:
                blocks.append(x)
            else:
                todo += [(c, link or x.tag == "a") for c in reversed(x.children)]
        self.own.append("".join(texts).strip())
        self.prose.append(prose)
        self.linked.append(linked)
        return blocks

    def finish(self) -> None:
        n = len(self.keys)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            self.children[self.parent[k]].append(k)
        self.text, self.shape, self.size, self.shapes = [0] * n, [0] * n, [1] * n, {}
        digest = xxhash.xxh3_64_intdigest
        for k in range(n - 1, -1, -1):
            own, kids = digest(self.own[k].encode("utf-8", "replace")), self.children[k]
            shapes = tuple(self.shape[c] for c in kids)
            self.text[k] = digest(repr((own, *(self.text[c] for c in kids)))) if kids else own
            self.shape[k] = digest(repr((self.keys[k], shapes)))
            self.size[k] += sum(self.size[c] for c in kids)
            self.shapes[self.shape[k]] = (self.keys[k], shapes, self.size[k])

    def main(self) -> int:
        """The hash of the text that isn't marked; pages that share it are copies."""
        return xxhash.xxh3_64_intdigest("\n".join(x for x, m in zip(self.own, self.marked, strict=True) if not m).encode("utf-8", "replace"))


def leaf(x: Node) -> bool:
    """Whether an element that repeats holds no blocks but text."""
    if x.tag not in ("p", "li", "dt", "dd", "blockquote", "pre"):
        return False
    todo = list(x.children)
    while todo:
        c = todo.pop()
        if not isinstance(c, str):
            if c.tag in BLOCK:
                return False
            todo += c.children
    return True


class Matching:
    """Simple tree matching of two trees: the most pairs of nodes with equal keys, parents with parents, children in order.

    Scores are kept by pair of shapes, so equal subtrees are compared once; the children's order is aligned by divide and
    conquer over rows of scores, so memory grows with their number and not with its square.
    """

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        self.shapes = a.shapes | b.shapes
        self.scores: dict[tuple[int, int], int] = {}

    def known(self, x: int, y: int) -> int | None:
        """The score of two shapes if it is clear or known. Equal ones match whole: no other pairing has more pairs."""
        if x == y:
            return self.shapes[x][2]
        return 0 if self.shapes[x][0] != self.shapes[y][0] else self.scores.get((x, y))

    def score(self, x: int, y: int) -> int:
        todo = [(x, y)]
        while todo:
            p, q = todo[-1]
            if self.known(p, q) is not None:
                todo.pop()
                continue
            first, last, (c, d) = trimmed(self.shapes[p][1], self.shapes[q][1])
            need = [(u, v) for u in set(c) for v in set(d) if self.known(u, v) is None]
            if need:
                todo += need
                continue
            same = sum(self.shapes[u][2] for u in (*first, *last))
            self.scores[p, q] = 1 + same + (int(self.row(c, d)[-1]) if c and d else 0)
            todo.pop()
        return self.known(x, y)

    def row(self, c: tuple[int, ...], d: tuple[int, ...]) -> np.ndarray:
        """The best scores of all of ``c`` with the first 0, 1, ... of ``d``."""
        kinds, place = np.unique(np.array(d, np.uint64), return_inverse=True)
        kinds, best, gains = kinds.tolist(), np.zeros(len(d) + 1, np.int64), {}
        for u in c:
            if u not in gains:
                gains[u] = np.array([self.score(u, v) for v in kinds], np.int64)[place]
            best[1:] = np.maximum(best[1:], best[:-1] + gains[u])
            np.maximum.accumulate(best, out=best)
        return best

    def order(self, c: list[int], d: list[int]) -> list[tuple[int, int]]:
        """Which children of ``a`` go with which of ``b``, by place."""
        pairs: list[tuple[int, int]] = []
        todo = [(0, len(c), 0, len(d))]
        while todo:
            i, j, k, m = todo.pop()
            while i < j and k < m and c[i] == d[k]:
                pairs.append((i, k))
                i, k = i + 1, k + 1
            while i < j and k < m and c[j - 1] == d[m - 1]:
                j, m = j - 1, m - 1
                pairs.append((j, m))
            if i == j or k == m:
                continue
            if j - i == 1:
                gains = [self.score(c[i], y) for y in d[k:m]]
                if max(gains):
                    pairs.append((i, k + gains.index(max(gains))))
                continue
            h = (i + j) // 2
            ahead, back = self.row(tuple(c[i:h]), tuple(d[k:m])), self.row(tuple(c[h:j][::-1]), tuple(d[k:m][::-1]))[::-1]
            cut = k + int(np.argmax(ahead + back))
            todo += [(i, h, k, cut), (h, j, cut, m)]
        return pairs

    def pairs(self) -> list[tuple[int, int]]:
        """The matched nodes of both trees."""
        out, todo = [], [(0, 0)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            c, d = self.a.children[x], self.b.children[y]
            todo += [(c[i], d[k]) for i, k in self.order([self.a.shape[u] for u in c], [self.b.shape[v] for v in d])]
        return out


def trimmed(c: tuple[int, ...], d: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[tuple[int, ...], tuple[int, ...]]]:
    """The equal start and end of two sequences, and what lies between in each."""
    n, i = min(len(c), len(d)), 0
    while i < n and c[i] == d[i]:
        i += 1
    k = 0
    while k < n - i and c[-1 - k] == d[-1 - k]:
        k += 1
    return c[:i], c[len(c) - k :], (c[i : len(c) - k], d[i : len(d) - k])


class Wrapper(Tree):
    """A pivot as the wrapper of its host: its tree without texts, later with what is template, region and title."""

    def __init__(self, learnt: dict):
        self.keys, self.parent, self.marked, self.text, self.whole = (learnt[k] for k in ("keys", "parent", "marked", "text", "whole"))
        self.template, self.region, self.titles, self.marks = set(learnt.get("template", ())), learnt.get("region"), set(learnt.get("titles", ())), learnt.get("marks", True)
        self.own, texts = [""] * len(self.keys), self.text
        self.finish()
        self.text, self.known = texts, {}

    def aligned(self, tree: Tree) -> tuple[int, list[tuple[int, int]]]:
        """Score and pairs (node of the wrapper, node of the page). Pages of a known shape are aligned as the one before."""
        if tree.shape[0] not in self.known:
            if sum(len(x[1]) for x in self.known.values()) > 100_000:
                self.known.clear()
            if tree.shape[0] == self.shape[0]:
                found = len(self.keys), [(k, k) for k in range(len(self.keys))]
            else:
                m = Matching(self, tree)
                found = m.score(self.shape[0], tree.shape[0]), m.pairs()
            self.known[tree.shape[0]] = found
        return self.known[tree.shape[0]]


def pivot(page: str) -> dict:
    t = Tree(parse(page))
    return {"keys": t.keys, "parent": t.parent, "marked": t.marked, "text": t.text, "whole": t.main()}


def summed(tree: Tree, values: list[float]) -> list[float]:
    """Of each node the sum at and under it."""
    out = list(values)
    for k in range(len(out) - 1, 0, -1):
        out[tree.parent[k]] += out[k]
    return out


def narrowest(tree: Tree, mass: list[float]) -> int:
    """The deepest container with nine tenths of the mass; none within an article or main element."""
    below, at = summed(tree, mass), 0
    while tree.children[at] and tree.keys[at].split(".")[0] not in ("article", "main"):
        best = max(tree.children[at], key=below.__getitem__)
        if below[best] < HELD * below[0] or not below[0] or tree.keys[best].split(".")[0] not in CONTAINER:
            break
        at = best
    return at


def induced(learnt: dict, pages: int, sums: dict[int, tuple[int, int, float]]) -> dict:
    """A pivot with its wrapper: from the number of other pages, and by node the pages with the same text and the varying text."""
    if pages < SAME:
        return learnt
    w = Wrapper(learnt)
    varying = [float(sums.get(k, (0, 0, 0.0))[2]) for k in range(len(w.keys))]
    plain = [0.0 if m else v for v, m in zip(varying, w.marked, strict=True)]
    marks = sum(plain) > PLAIN * sum(varying)
    mass = plain if marks else varying
    region = narrowest(w, mass)
    template = [k for k in range(1, len(w.keys)) if sums.get(k, (0, 0, 0))[1] >= SAME and 2 * sums[k][1] > pages and w.keys[k] not in PROSE]
    titles = [k for k, x in enumerate(w.keys) if x.split(".")[0] == "h1" and k < region and mass[k]]
    return learnt | {"template": template, "region": region if sum(mass) else None, "titles": titles, "marks": marks}


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def blocks(starts: list[Node], gone: set[int], marks: bool) -> list[str]:
    """The blocks at and under some elements, without those whose id is in ``gone``."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := squeezed("".join(line)):
            out.append(text)
        line.clear()

    todo: list = list(reversed(starts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif not x.off and id(x) not in gone and not (marks and x.marked):
            if x.tag == "br":
                line.append(" ")
                continue
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def own_region(tree: Tree, gone: set[int]) -> tuple[list[Node], set[int], bool]:
    """The main region of a page by itself: where to start, what to leave out, and whether marks count."""
    template, mass = [False] * len(tree.keys), []
    for k, run in enumerate(tree.nodes):
        template[k] = any(id(x) in gone for x in run) or k > 0 and template[tree.parent[k]]
        mass.append(0.0 if template[k] else float(tree.prose[k]))
    plain = [0.0 if m else v for v, m in zip(mass, tree.marked, strict=True)]
    marks = sum(plain) > PLAIN * sum(mass)
    mass = plain if marks else mass
    region = narrowest(tree, mass)
    below, links, inside = summed(tree, [float(x) for x in tree.prose]), summed(tree, [float(x) for x in tree.linked]), [False] * len(tree.keys)
    lists = set(gone)
    for k in range(region + 1, len(tree.keys)):
        inside[k] = tree.keys[k].split(".")[0] in ("article", "main") or inside[tree.parent[k]]
        if links[k] and not below[k] and below[0] and not inside[k] and tree.keys[region].split(".")[0] not in ("article", "main"):
            lists.update(id(x) for x in tree.nodes[k])
    return tree.nodes[region], lists, marks


def main_text(page: str, wrappers: list[Wrapper]) -> str:
    tree = Tree(parse(page))
    gone: set[int] = set()
    best, pairs = None, []
    for w in wrappers:
        score, found = w.aligned(tree)
        gone.update(id(x) for k, y in found if k in w.template for x in tree.nodes[y])
        if best is None or score * (len(best[1].keys) + len(tree.keys)) > best[0] * (len(w.keys) + len(tree.keys)):
            best, pairs = (score, w), found
    if best and best[1].region is not None:
        w, partner = best[1], dict(pairs)
        if w.region in partner:
            at = [partner[k] for k in sorted(w.titles) if k in partner] + [partner[w.region]]
            found = blocks([x for k in sorted(at) for x in tree.nodes[k]], gone, w.marks)
            if found:
                return "\n".join(found)
    return "\n".join(blocks(*own_region(tree, gone)))


def host_of(url: str) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(host != "", host)


def _joined(pages: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pages`` with ``columns`` of ``table``, a checkpointed row for each host with its number of pages; null without one."""
    total = table.agg(F.sum("pages"), F.sum(sum((F.length(c) for c in columns), F.lit(0)))).first()
    if (total[1] or 0) <= BROADCAST:
        return pages.join(F.broadcast(table.select("host", *columns)), "host", "left")
    hot = F.broadcast(table.where(F.col("pages") * SALTS > total[0]).select("host", F.lit(True).alias("hot")))  # SALTS hosts at most
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copies = table.join(hot, "host", "left").select("host", *columns, F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0)))).alias("salt"))
    salted = pages.join(hot, "host", "left").withColumn("salt", F.when(F.col("hot") | F.col("host").isNull(), F.pmod(F.xxhash64("html"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    return salted.join(copies, ["host", "salt"], "left").drop("salt")


class AtHand:
    """What JSON texts stand for, kept while they have at most ``AT_HAND`` bytes."""

    def __init__(self):
        self.made, self.held = {}, 0

    def wrapper(self, text: str) -> Wrapper:
        if text not in self.made:
            if self.held + len(text) > AT_HAND:
                self.made, self.held = {}, 0
            self.made[text] = Wrapper(json.loads(text))
            self.held += 8 * len(text)
        return self.made[text]


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, a, b (the wrappers of two pivots as JSON) for each host of ``pages`` (host, html)."""
    known = pages.where("host is not null").select("host", "html", F.xxhash64("html").alias("hash"))
    chosen = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min_by("html", "hash").alias("a"), F.max_by("html", "hash").alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch):
                made = [pa.array([json.dumps(pivot(x.as_py())) for x in b.column(k)], pa.string()) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["host", "pages", "a", "b"])

    pivots = checkpoint(chosen.mapInArrow(cut, "host string, pages long, a string, b string"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand, sums = AtHand(), {}

        def out() -> pa.RecordBatch:
            rows = [(host, side, k, *own) for (host, side), by in sums.items() for k, own in by.items()]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "side", "node", "met", "same", "varying"])

        for batch in batches:
            for b in sliced(batch):
                for host, page, *sides in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    tree = Tree(parse(page.as_py()))
                    whole = tree.main()
                    for side, text in enumerate(sides):
                        w = hand.wrapper(text)
                        if w.whole == whole:
                            continue
                        own = sums.setdefault((host, side), {})
                        for k, y in w.aligned(tree)[1]:
                            same = w.text[k] == tree.text[y]
                            met = own.setdefault(k, [0, 0, 0.0])
                            met[0] += 1
                            met[1] += same
                            met[2] += 0 if same else tree.prose[y]
            if sum(map(len, sums.values())) > 100_000:
                yield out()
        if sums:
            yield out()

    met = _joined(pages.where("host is not null"), pivots, ["a", "b"]).select("host", "html", "a", "b")
    sums = met.mapInArrow(counted, "host string, side int, node long, met long, same long, varying double").groupBy("host", "side", "node").agg(F.sum("met").alias("met"), F.sum("same").alias("same"), F.sum("varying").alias("varying"))
    gathered = sums.groupBy("host").agg(F.collect_list(F.struct("side", "node", "met", "same", "varying")).alias("sums"))  # the nodes of two pages

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch):
                made: list[list[str]] = [[], []]
                for texts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    for side in (0, 1):
                        own = {r["node"]: (r["met"], r["same"], r["varying"]) for r in texts[2] or [] if r["side"] == side}
                        made[side].append(json.dumps(induced(json.loads(texts[side]), own.get(0, (0,))[0], own)))  # all pages meet the root
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in made)], ["host", "pages", "a", "b"])

    return checkpoint(pivots.join(gathered, "host", "left").mapInArrow(induce, "host string, pages long, a string, b string"))


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``df`` (page_id, url, html)."""
    pages = df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    joined = _joined(pages, wrappers(pages.select("host", "html")), ["a", "b"]).select("page_id", "url", "html", "a", "b")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand = AtHand()
        for batch in batches:
            for b in sliced(batch):
                sides = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
                out = [main_text(page.as_py(), [hand.wrapper(x) for x in dict.fromkeys(own) if x is not None]) for page, own in zip(b.column(2), sides, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {df.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.mapInArrow(texts, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
