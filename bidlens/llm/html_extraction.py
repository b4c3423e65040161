"""Main text of web pages by wrapper induction over pages of one host.

A page becomes a tree of its elements; neighbouring leaf elements of one kind are folded into a repeated node, so that lists
and paragraphs of any number align.  Numbers in classes are not told apart.  Trees align by simple tree matching: the
largest set of node pairs that keeps ancestors and the order of siblings.  All layouts of a host are united into one tree:
each is aligned with what is there and what it has beyond that is put in; nodes of one page alone are left out.  Every page
is then aligned with that tree and votes: a text that a node shows on at least half of the pages that have the node, and on
two at least, is template (with fewer than four such pages, on all); a node with varying text is a slot.  Copies prove
nothing: pages whose main element has the same longest block have one vote together, whatever menus or adverts surround it.

Of each page, nodes on template are dropped, slots are kept as content.  Slots can still be menus with changing links,
rotating adverts or comments, which the wrapper can't tell: elements that say what they are (nav, aside, footer and so on, a
role, form or dialog, or such a word in class or id) are left out.  None of these counts against what holds the page's text:
a form, a dialog, a role or a word that has other meanings too against an element with over half of it (and the page's title or
a long block, if the page has a title), such a word against any with a long block either, a plain word against an article or main with over half of the text or an element with over
four fifths of it that holds an article, main or h1.  Where a page marks its article (a single article or main that is not
left out, with over half of the text that remains), blocks outside it go only if the wrapper doesn't have their node: on
hosts without a tree, or nodes of one page alone.

Tags are cut by one scan, attributes are read in turn as name and quoted value, and what an element hands down or sums up
goes from parent to child or back, so that time and memory grow with the page, however deep or broken it is.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line break.

Null and empty pages give an empty text, broken markup is read as far as it goes.  Repeated pages are extracted each.
A page without a host is its own group with the other such pages.  Other columns are not looked at.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import Scratch

SHARE = 0.5  # of the pages with a node, that show the same text
SURE_VOTES = 4  # with fewer pages all must show it
UNIONS = 64  # parts in which the layouts of a host are united first
TABLE_CELLS = 1_000_000  # of one table in memory; larger ones are halved first
DEEP = 200_000  # nested elements that the recursion over a tree allows for
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
OPENED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']\S*+))?)?""")
NUMBERS = re.compile(r"[0-9]+")
# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "dialog"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
NEVER = frozenset(
    "head script style noscript template textarea title xmp iframe noembed noframes object embed svg canvas audio video map nav aside footer button "
    "select option input menu".split()
)
SPEAKING = frozenset(
    "advert adverts advertisement sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside cookie cookies "
    "consent popup modal overlay subscribe newsletter signup login sharing comment comments replies disqus respond widget toolbar pagination pager".split()
)
AMBIGUOUS = frozenset("ad ads banner notice alert share social related recommended discussion search hidden".split())  # words an article's own part may go by
SOFT = frozenset("form dialog".split())
WORD, UNSEEN, MAYBE, ROLE = 1, 2, 3, 4  # why an element is no content: a word, hidden for certain, an ambiguous word, a role or a form
LONG_BLOCK = 200  # characters of a block that no advert, notice or link list has
MARKS = ("article", "main")
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())


class Node:
    __slots__ = ("tag", "mark", "drop", "parent", "holder", "unseen", "blocks", "length", "longest", "titled", "flags", "shapes")

    def __init__(self, tag: str, parent: Node | None = None, mark: str = "", drop: int = 0):
        self.tag, self.mark, self.drop, self.parent = tag, mark, drop, parent
        never, page = tag in NEVER, tag in ("body", "html")
        self.holder = self if parent is None or tag in BLOCK or drop or never else parent.holder  # the element whose blocks its text makes
        self.unseen = parent is not None and (parent.unseen or never or drop == UNSEEN and not page)  # for certain, or stands in such
        self.blocks: list[list[str]] = []  # text of the node's own blocks, in pieces
        self.shapes: list[Shape] = []
        self.length = self.longest = self.flags = 0
        self.titled = False


def attributes(tag: str, raw: str) -> tuple[str, int]:
    """(class, why the element says that it is no content, 0 if it doesn't)."""
    found: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, double, single, bare in ATTRIBUTE.findall(raw):
            found.setdefault(name.lower(), (double or single or bare).lower())
    if "hidden" in found or found.get("aria-hidden") == "true":
        return found.get("class", ""), UNSEEN
    tokens = set(re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}"))
    drop = WORD if tokens & SPEAKING else ROLE if found.get("role", "") in ROLES or tag in SOFT else MAYBE if tokens & AMBIGUOUS else 0
    return found.get("class", ""), drop


def parse(page: str) -> tuple[list[Node], list[tuple[Node, list[str]]]]:
    """The elements, parents first, and the page's blocks in order: (element, pieces of text)."""
    root = Node("#page")
    nodes, path, blocks, current = [root], [root], [], None
    opened: Counter[str] = Counter()  # elements on the path
    at, n, last_end, quoted = 0, len(page), page.rfind(">"), True

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = []
            blocks.append((path[-1].holder, current))
        current.append(html.unescape(raw))

    def close(down_to: int) -> None:
        nonlocal current
        for x in path[down_to:]:
            opened[x.tag] -= 1
            if x.holder is x:
                current = None
        del path[down_to:]

    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last_end:
            text(page[at:])
            break
        if page.startswith("<!--", start):
            text(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page[start + 1] in "!?":
            text(page[at:start])
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        m = OPENED.match(page, start)
        if not m:
            text(page[at:start + 1])
            at = start + 1
            continue
        text(page[at:start])
        whole = TAG.match(page, start) if quoted else None
        if whole:
            raw, at = whole[3], whole.end()
        else:  # a quote never closes: from here on a tag ends at the next >
            quoted = False
            end = page.find(">", start)
            raw, at = page[m.end():end], end + 1
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                current = None
            if opened[tag]:
                for i in range(len(path) - 1, 0, -1):
                    if path[i].tag == tag:
                        close(i)
                        break
                    if path[i].tag in ("td", "th", "article", "main") and tag not in ("table", "tr", "body", "html", "article", "main", "tbody", "thead"):
                        break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(path) - 1, 0, -1):
                if path[i].tag == "p":
                    close(i)
                    break
                if path[i].tag in BLOCK:
                    break
        if tag in SIBLING and any(opened[other] for other in SIBLING[tag]):
            for i in range(len(path) - 1, 0, -1):
                if path[i].tag in SIBLING[tag]:
                    close(i)
                    if tag != "tr":
                        break
                elif path[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "select", "menu"):
                    break
        if raw.rstrip().endswith("/") and tag not in BLOCK:
            continue
        node = Node(tag, path[-1], *attributes(tag, raw))
        if node.holder is node:
            current = None
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            current = None
            at = end.end() if end else n
        else:
            path.append(node)
            opened[tag] += 1
    for holder, pieces in blocks:
        holder.blocks.append(pieces)
    return nodes, blocks


def summed(nodes: list[Node], lines: list[tuple[Node, str]]) -> int:
    """Sets every element's length, longest block and whether it holds a title (an article, main or h1 with text); all text."""
    for x in nodes:
        x.length, x.longest, x.titled = 0, 0, False
    for holder, line in lines:
        holder.length += len(line)
        holder.longest = max(holder.longest, len(line))
    for x in reversed(nodes):
        x.titled = x.titled or x.length > 0 and (x.tag in MARKS or x.tag == "h1")
        if x.parent is not None:
            x.parent.length += x.length
            x.parent.longest = max(x.parent.longest, x.longest)
            x.parent.titled = x.parent.titled or x.titled
    return nodes[0].length


def squeeze(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


class Shape:
    """A tree for alignment: block elements only, equal leaf neighbours folded into one."""

    __slots__ = ("key", "tag", "text", "children", "nodes", "number", "form", "count")

    def __init__(self, key: str, text: int, children: list[Shape], nodes: list[Node]):
        self.key, self.text, self.children, self.nodes, self.number = key, text, children, nodes, -1
        self.tag = key.partition(".")[0]
        self.seal()

    def seal(self) -> None:
        """Digest of the keys of this tree, and its size."""
        self.form = hash((self.key, *[c.form for c in self.children]))
        self.count = 1 + sum(c.count for c in self.children)


def shape_of(nodes: list[Node]) -> Shape:
    """The page's tree for alignment; inline elements belong to the block around them."""
    for node in reversed(nodes):
        if node.holder is not node:
            continue
        children: list[Shape] = []
        for shape in reversed(node.shapes):
            last = children[-1] if children else None
            if last is not None and last.key == shape.key and not last.children and not shape.children:
                last.nodes += shape.nodes
                last.text = zlib.crc32(shape.text.to_bytes(4, "big"), last.text)
            else:
                children.append(shape)
        own = zlib.crc32("\n".join(squeeze(b) for b in node.blocks).encode("utf-8", "replace"))
        made = Shape(f"{node.tag}.{NUMBERS.sub('0', node.mark)}", own, children, [node])
        node.shapes = []
        if node.parent is not None:
            node.parent.holder.shapes.append(made)
    return made


def numbered(root: Shape) -> list[Shape]:
    out, waiting = [], [root]
    while waiting:
        shape = waiting.pop()
        shape.number = len(out)
        out.append(shape)
        waiting += reversed(shape.children)
    return out


def packed(root: Shape) -> str:
    """A reference tree as text: its nodes in page order, each with its number of children."""
    return json.dumps([[s.key, s.text, len(s.children)] for s in numbered(root)], ensure_ascii=False, separators=(",", ":"))


def unpacked(raw: str) -> Shape:
    rows = json.loads(raw)
    shapes = [Shape(key, text, [], []) for key, text, _ in rows]
    open_: list[list] = []  # nodes that still wait for children
    for number, (shape, (_, _, n)) in enumerate(zip(shapes, rows)):
        shape.number = number
        if open_:
            open_[-1][0].children.append(shape)
            open_[-1][1] -= 1
        while open_ and not open_[-1][1]:
            open_.pop()
        if n:
            open_.append([shape, n])
    for shape in reversed(shapes):
        shape.seal()
    return shapes[0]


def size_of(a: Shape, b: Shape, known: dict[tuple[int, int], int]) -> int:
    """Size of the largest matching that maps the roots onto each other."""
    if a.tag != b.tag:
        return 0
    if a.form == b.form:
        return a.count
    at = a.form, b.form
    if at not in known:
        head, tail, worth, rows, columns = siblings(a, b, known)
        inner = sum(x.count for x in a.children[:head]) + sum(x.count for x in a.children[len(a.children) - tail:]) + int(last_row(worth, rows, columns)[-1])
        # an element whose class differs is no match of its own, but what it holds may be
        known[at] = inner + (a.key == b.key) if inner or a.key == b.key else 0
    return known[at]


def siblings(a: Shape, b: Shape, known: dict) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Children that are equal from the start and from the end, then sizes by kind of child, and the kinds of those between.

    Equal trees at an end can always be paired in a largest matching.
    """
    x, y = [c.form for c in a.children], [c.form for c in b.children]
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i] != y[i]), least)
    tail = next((i for i in range(least - head) if x[-1 - i] != y[-1 - i]), least - head)
    of_a, of_b = a.children[head:len(x) - tail], b.children[head:len(y) - tail]
    kinds_a, kinds_b = {c.form: c for c in of_a}, {c.form: c for c in of_b}
    worth = np.array([[size_of(p, q, known) for q in kinds_b.values()] for p in kinds_a.values()], np.int64).reshape(len(kinds_a), len(kinds_b))
    number_a, number_b = {f: i for i, f in enumerate(kinds_a)}, {f: i for i, f in enumerate(kinds_b)}
    return head, tail, worth, np.array([number_a[c.form] for c in of_a], np.int64), np.array([number_b[c.form] for c in of_b], np.int64)


def last_row(worth: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the largest matchings of all rows with the first 0, 1, 2 and more columns."""
    best = np.zeros(len(columns) + 1, np.int64)
    if len(columns):
        for i in rows:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + worth[i][columns]))
    return best


def chosen(worth: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Places (row, column) of a largest matching; a large table is halved by rows first (Hirschberg), which is as exact."""
    out, waiting = [], [(0, len(rows), 0, len(columns))]
    while waiting:
        top, bottom, left, right = waiting.pop()
        m, n = bottom - top, right - left
        if not m or not n:
            continue
        x, y = rows[top:bottom], columns[left:right]
        if m > 1 and m * n > TABLE_CELLS:
            half = m // 2
            cut = int(np.argmax(last_row(worth, x[:half], y) + last_row(worth, x[half:][::-1], y[::-1])[::-1]))
            waiting += [(top, top + half, left, left + cut), (top + half, bottom, left + cut, right)]
            continue
        best = np.zeros((m + 1, n + 1), np.int64)
        for i in range(m):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + worth[x[i]][y]))
        i, j = m, n
        while i and j:
            gain = worth[x[i - 1], y[j - 1]]
            if gain and best[i, j] == best[i - 1, j - 1] + gain:
                out.append((top + i - 1, left + j - 1))
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return out


def match(a: Shape, b: Shape, known: dict[tuple[int, int], int]) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: size and pairs of the largest matching that maps the roots onto each other."""
    size = size_of(a, b, known)
    pairs, waiting = [], [(a, b)] if size else []
    while waiting:
        x, y = waiting.pop()
        pairs.append((x, y))
        if x.form == y.form:
            waiting += zip(x.children, y.children)
            continue
        head, tail, worth, rows, columns = siblings(x, y, known)
        waiting += zip(x.children[:head], y.children[:head])
        if tail:
            waiting += zip(x.children[-tail:], y.children[-tail:])
        waiting += [(x.children[head + i], y.children[head + j]) for i, j in chosen(worth, rows, columns)]
    return size, pairs


def reseal(root: Shape) -> None:
    for shape in reversed(numbered(root)):
        shape.seal()


def grow(union: Shape, tree: Shape) -> None:
    """Adds what ``tree`` has beyond ``union``, next to the sibling before it; ``text`` of either counts pages."""
    partner = {}
    for u, t in match(union, tree, {})[1]:
        u.text += t.text
        partner[id(t)] = u
    if len(partner) == tree.count:
        return
    for t in numbered(tree):
        u = partner.get(id(t))
        if u is None:
            continue
        after: dict[int, list[Shape]] = {}
        before = 0
        for child in t.children:
            if id(child) in partner:
                before = id(partner[id(child)])
            else:
                after.setdefault(before, []).append(child)
        if after:
            old, u.children = u.children, list(after.get(0, []))
            for child in old:
                u.children += [child, *after.get(id(child), [])]
    reseal(union)


def pruned(union: Shape) -> Shape | None:
    """Without nodes of a single page: they can't repeat."""
    stays: set[int] = set()
    for shape in reversed(numbered(union)):
        shape.children = [c for c in shape.children if id(c) in stays]
        if shape.text > 1 or shape.children:
            stays.add(id(shape))
    reseal(union)
    return union if id(union) in stays else None


class Wrapper:
    """The tree of a host, and where the nodes of layouts that were met lie in it."""

    def __init__(self, raw: str):
        self.tree, self.known, self.met = unpacked(raw), {}, {}

    def places(self, root: Shape) -> list[int]:
        """Of every node of a page, in order: number of the node that it aligns with, or -1."""
        if root.form not in self.met:
            if len(self.met) > 1000:
                self.met, self.known = {}, {}
            out = [-1] * len(numbered(root))
            for w, p in match(self.tree, root, self.known)[1]:
                out[p.number] = w.number
            self.met[root.form] = out
        return self.met[root.form]


def content_of(nodes: list[Node], blocks: list[tuple[Node, list[str]]]) -> int | None:
    """Digest of the longest block in the element that holds most of the text; pages that share it are copies.

    Elements that say that they are no content do not count, unless there is nothing else.
    """
    lines = [(holder, squeeze(pieces)) for holder, pieces in blocks]
    lines = [(holder, line) for holder, line in lines if line]
    if not lines:
        return None
    seen = [(holder, line) for holder, line in lines if not holder.unseen]
    summed(nodes, seen)
    for x in nodes:
        x.flags = int(x.parent is not None and (x.parent.flags or says_no(x, nodes[0])))
    lines = [(holder, line) for holder, line in seen if not holder.flags] or lines
    total = summed(nodes, lines)
    main = [x for x in nodes if 2 * x.length > total][-1]  # such elements stand in each other
    if main.tag in ("#page", "html", "body"):  # no element holds most: the largest below
        below = [x for x in nodes if x.parent is main and x.length]
        main = max(below, key=lambda x: x.length) if below else main
    for x in nodes:
        x.flags = int(x is main or x.parent is not None and x.parent.flags)
    longest = max((line for holder, line in lines if holder.flags), key=lambda line: (len(line), line))
    return xxhash.xxh3_64_intdigest(longest.encode("utf-8", "replace")) - (1 << 63)


def says_no(x: Node, page: Node) -> bool:
    """Whether what an element says of itself leaves it out; it says nothing against what holds the page's text."""
    if not x.drop or x.tag in ("body", "html"):
        return False
    most, long = 2 * x.length > page.length, x.longest >= LONG_BLOCK
    if x.tag in MARKS:
        return not most
    if x.drop == WORD:
        return not (x.titled and 5 * x.length > 4 * page.length)
    # beside a short article an advert can be most of the text, but it has neither the title nor a long block
    return not (most and (x.titled or long or not page.titled) or x.drop == MAYBE and long)


OUT, MARKED, HEADED = 1, 2, 4  # left out; below an article or main; in its header


def extract(page: str | None, wrapper: Wrapper | None, template: frozenset[tuple[int, int]]) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    fixed, judged = aligned(nodes, wrapper, template) if wrapper is not None and template else (set(), None)
    lines = [(holder, squeeze(pieces)) for holder, pieces in blocks if id(holder) not in fixed and not holder.unseen]
    lines = [(holder, line) for holder, line in lines if line]
    summed(nodes, lines)
    mark_of: dict[int, Node] = {}
    for x in nodes:
        if x.parent is None:
            x.flags = 0
            continue
        above = x.parent.flags
        marked = above & MARKED or (MARKED if x.parent.tag in MARKS else 0)
        header = x.tag == "header"
        out = above & OUT or int(header and not marked) or int(says_no(x, nodes[0]))
        x.flags = out | marked | (above & HEADED or (HEADED if header else 0))
        mark = mark_of.get(id(x.parent)) or (x if x.tag in MARKS else None)
        if mark is not None:
            mark_of[id(x)] = mark
    lines = [(holder, line) for holder, line in lines if not holder.flags & OUT and (not holder.flags & HEADED or holder.tag in HEADINGS)]
    marks = {id(mark_of[id(holder)]) for holder, _ in lines if id(holder) in mark_of}
    if len(marks) == 1:
        within = [id(holder) in mark_of for holder, _ in lines]
        if not all(within) and 2 * sum(len(line) for (_, line), w in zip(lines, within) if w) > sum(len(line) for _, line in lines):
            if judged is None:
                judged = aligned(nodes, wrapper, template)[1] if wrapper is not None else set()
            lines = [(holder, line) for (holder, line), w in zip(lines, within) if w or id(holder) in judged]
    return "\n".join(line for _, line in lines)


def aligned(nodes: list[Node], wrapper: Wrapper, template: frozenset[tuple[int, int]]) -> tuple[set[int], set[int]]:
    """Nodes on template, and all nodes that the wrapper has."""
    shape = shape_of(nodes)
    fixed, judged = set(), set()
    for at, p in zip(wrapper.places(shape), numbered(shape)):
        if at >= 0:
            ids = [id(node) for node in p.nodes]
            judged.update(ids)
            if (at, p.text) in template:
                fixed.update(ids)
    return fixed, judged


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Wrappers(dict):
    """Packed tree -> wrapper, for as many hosts as a task meets in a row."""

    def __missing__(self, raw: str) -> Wrapper:
        if len(self) > 500:
            self.clear()
        self[raw] = wrapper = Wrapper(raw)
        return wrapper


def united(layouts: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """One tree for all layouts (``tree``) of a key; rows stream in order, a task holds one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        at, union = None, None

        def made() -> Iterator[pa.RecordBatch]:
            tree = pruned(union) if last else union
            if tree is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([packed(tree)], pa.string())], names=["host", "tree"])

        for batch in batches:
            for *key, raw in zip(*[batch.column(c).to_pylist() for c in (*keys, "tree")]):
                if key != at:
                    if union is not None:
                        yield from made()
                    at, union = key, unpacked(raw)
                else:
                    grow(union, unpacked(raw))
        if union is not None:
            yield from made()

    return layouts.select(*keys, "tree").repartition(*keys).sortWithinPartitions(*keys, "tree").mapInArrow(run, "host string, tree string")


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, tree, template): the tree of each host, and its template as (node, text)."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        for batch in batches:
            hosts, layouts, texts, contents = [], [], [], []
            for host, page in zip(*[c.to_pylist() for c in batch.columns]):
                nodes, blocks = parse(page)
                content = content_of(nodes, blocks)
                if content is None:
                    continue
                shape = shape_of(nodes)
                parts = numbered(shape)
                texts.append([x.text for x in parts])
                for x in parts:
                    x.text = 1
                hosts.append(host)
                layouts.append(packed(shape))
                contents.append(content)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(layouts, pa.string()), pa.array(texts, pa.list_(pa.int64())), pa.array(contents, pa.int64())],
                names=["host", "layout", "texts", "content"]
            )

    said = scratch.keep(pages.filter(F.length("html") > 0).select("host", "html").mapInArrow(shapes, "host string, layout string, texts array<long>, content long"), "shapes")
    voters = scratch.keep(said.groupBy("host", "content").agg(F.min(F.struct("layout", "texts")).alias("v")).select("host", "v.layout", "v.texts"), "voters")
    scratch.drop("shapes")
    # a layout of many pages counts twice: what is on two pages may be template
    layouts = voters.groupBy("host", "layout").agg(F.least(F.count("*"), F.lit(2)).alias("n"))
    twice = layouts.select("host", F.pmod(F.xxhash64("layout"), F.lit(UNIONS)).alias("part"), F.explode(F.array_repeat("layout", F.col("n").cast("int"))).alias("tree"))
    trees = scratch.keep(united(united(twice, ["host", "part"], False), ["host"], True), "trees")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        known, met, votes = Wrappers(), {}, Counter()

        def counted() -> pa.RecordBatch:
            keys = list(votes)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()),
                 pa.array([votes[k] for k in keys], pa.int64())], names=["host", "node", "text", "pages"]
            )

        for batch in batches:
            for host, layout, texts, raw in zip(*[c.to_pylist() for c in batch.columns]):
                if layout not in met:
                    if len(met) > 1000:
                        met.clear()
                    met[layout] = unpacked(layout)
                for at, text in zip(known[raw].places(met[layout]), texts):
                    if at >= 0:
                        votes[host, at, text] += 1
                if len(votes) > 100_000:
                    yield counted()
                    votes.clear()
        if votes:
            yield counted()

    ballots = voters.join(trees, "host").select("host", "layout", "texts", "tree").mapInArrow(vote, "host string, node int, text long, pages long")
    counts = scratch.keep(ballots.groupBy("host", "node", "text").agg(F.sum("pages").alias("same")), "counts")
    having = counts.groupBy("host", "node").agg(F.sum("same").alias("pages"))
    often = counts.filter((F.col("same") > 1) & (F.col("text") != 0)).join(having, ["host", "node"])  # 0: no text
    often = often.filter((F.col("same") >= F.col("pages") * SHARE) & ((F.col("pages") >= SURE_VOTES) | (F.col("same") == F.col("pages"))))
    template = often.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("node", "text"))).alias("template"))
    return scratch.keep(trees.join(template, "host", "left"), "wrappers")  # a host's nodes bound each list


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row."""
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    known = rows.join(wrappers(rows, scratch), "host", "left").select("page_id", "url", "html", "tree", "template")
    schema = rows.select("page_id", "url", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        known = Wrappers()
        for batch in batches:
            texts = []
            for page, raw, template in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                texts.append(extract(page, known[raw] if raw else None, frozenset((t["node"], t["text"]) for t in template or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return known.mapInArrow(run, schema)


def page_table(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
