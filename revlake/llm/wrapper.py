"""Main text of pages by wrappers that are induced from the pages of a host.

A page becomes a tree of its blocks; neighbours of equal shape are one repeated
node. The commonest tree of a host is its wrapper, and every other page's tree
is laid over it by simple tree matching: nodes of equal label match, children
in order, as many as possible. A node that shows the same text on nearly all
pages of the host is template; a node whose text varies is a slot.

Menus, adverts and footers vary as well, so slots are told apart by what they
stand in: by element, ``role``, class and id names, and outside an article by
links. Of a page that marks an article or a main part only that counts.

Each page is compared with one tree, and texts are counted by node as
aggregates, so a host with a third of all pages is no group in any task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.tables import parts, written
from revlake.operators.joins import lookup_join

#: A text is template where this share of a host's different pages has it, and this number at least.
SHARE, PAGES = 0.9, 5
#: Deeper blocks count as text of the block at this depth.
DEEPEST = 200

# Fixed values of HTML: elements that are blocks, that hold no mark-up, that never stand for an article.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript object ol optgroup option p pre section select summary "
    "svg table tbody td template tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NO_ARTICLE = frozenset("aside button dialog footer form head header menu nav noscript object option optgroup select svg template title".split())
_CLOSES_P = _BLOCKS - frozenset("button caption head html body object option optgroup svg tbody td tfoot th thead tr title template noscript".split())
_CLOSES = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES |= {name: ("tbody thead tfoot", "table") for name in ("tbody", "thead", "tfoot")} | {f"h{i}": ("h1 h2 h3 h4 h5 h6", "") for i in range(1, 7)}
_CLOSES = {name: (frozenset(a.split()), frozenset(b.split())) for name, (a, b) in _CLOSES.items()}
#: Words of class and id names of what stands around an article.
_AROUND = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead sidebar aside cookie cookies consent notice notices gdpr popup modal newsletter subscribe share sharing social comment comments "
    "reply replies respond disqus related recommended widget pagination pager toolbar login signup".split()
)
_OUTER = frozenset("header footer topbar copyright".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert form".split())

_MARK = re.compile(r"<(?:!--|([!?])|(/?)([A-Za-z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^"'>])*+>""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Blocks of a page in preorder (parent, label) and its texts (block, text, all in links)."""

    def __init__(self, source: str) -> None:
        self.parents, self.labels = [-1], ["html"]
        self.texts: list[tuple[int, str, bool]] = []
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._said: list[str] = []
        self._linked, self._plain, self._links = False, False, 0
        self._inside = 0  # open article and main elements
        self._deeper: list[tuple[str, bool]] = []  # open blocks below the deepest
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            mark = _MARK.search(source, at)
            if not mark:
                self._say(source[at:])
                return
            self._say(source[at : mark.start()])
            bogus, closing, name = mark.groups()
            if name is None:
                end = source.find(">" if bogus else "-->", mark.end())
                at = n if end < 0 else end + (1 if bogus else 3)
                continue
            rest = _ATTRIBUTES.match(source, mark.end())
            at = rest.end() if rest else source.find(">", mark.end()) + 1
            if not at:  # cut inside a tag
                return
            name = name.lower()
            if closing:
                self._close(name)
                continue
            self._open(name, source[mark.end() : at])
            if name in _RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                at = end.start() if end else n

    def _say(self, text: str) -> None:
        if text and not any(around for _, around in self._deeper):
            if self._stack[-1][0] == "head" and not text.isspace():
                self._flush()
                self._stack.pop()
            self._said.append(text)
            if not text.isspace():
                self._linked |= self._links > 0
                self._plain |= not self._links

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._said)).split())
        if text:
            self.texts.append((self._stack[-1][1], text, self._linked and not self._plain))
        self._said, self._linked, self._plain = [], False, False

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._said.append(" ")
        elif name == "a":
            self._links += 1
        elif name == "hr":
            self._flush()
        if name not in _BLOCKS or name in _RAW or name == "html" or name == "body" and any(x == "body" for x, _ in self._stack):
            return
        self._flush()
        if self._stack[-1][0] == "head" and name not in ("title", "noscript", "template"):
            self._stack.pop()
        if name in _CLOSES_P and self._stack[-1][0] == "p":
            self._stack.pop()
        if name in _CLOSES:
            same, within = _CLOSES[name]
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] in same:
                    self._drop(i)
                if self._stack[min(i, len(self._stack) - 1)][0] in within or not within:
                    break
        self._push(name, self._label(name, attributes))

    def _label(self, name: str, attributes: str) -> str:
        if name in ("html", "body"):
            return name
        found = {a.lower(): x or y or z for a, x, y, z in _NAMES.findall(attributes)}
        role = found.get("role", "").lower()
        classes = [w for w in found.get("class", "").split() if not any(c.isdigit() for c in w)]
        words = {w.lower() for value in (found.get("class", ""), found.get("id", "")) for w in _WORD.findall(value)}
        around = name in _NO_ARTICLE - ({"header"} if self._inside else set()) or role in _ROLES
        around |= name != "main" and bool(words & (_AROUND if self._inside else _AROUND | _OUTER))
        main = name in ("article", "main") or role in ("main", "article")
        return ("!" if around else "*" if main else "") + ".".join([name, *classes])

    def _push(self, name: str, label: str) -> None:
        self._flush()
        if len(self._stack) >= DEEPEST:
            self._deeper.append((name, label[0] == "!"))
            return
        self._stack.append((name, len(self.labels)))
        self.parents.append(self._stack[-2][1])
        self.labels.append(label)
        self._inside += label[0] == "*"
        if label[0] == "!":
            self._links = 0

    def _drop(self, upto: int) -> None:
        for _, node in self._stack[upto:]:
            self._inside -= self.labels[node][0] == "*"
        del self._stack[upto:]

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = max(0, self._links - 1)
        if name in ("html", "body") or name not in _BLOCKS or name in _RAW:
            return
        for i in range(len(self._deeper) - 1, -1, -1):
            if self._deeper[i][0] == name:
                self._flush()
                del self._deeper[i:]
                return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                self._flush()
                self._drop(i)
                return

    def marked(self, sign: str) -> list[bool]:
        """Which blocks have a label with the sign, or stand in one that has it."""
        out: list[bool] = []
        for parent, label in zip(self.parents, self.labels, strict=True):
            out.append(label.startswith(sign) or parent >= 0 and out[parent])
        return out


def skeleton(page: Page) -> tuple[str, list[int]]:
    """The tree with neighbours of equal shape as one node, a line "depth label" a node, and each block's node."""
    n = len(page.labels)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parents[i]].append(i)
    shapes: dict[tuple, int] = {}
    shape, ordinal = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        kinds: list[int] = []
        for c in children[i]:
            if not kinds or kinds[-1] != shape[c]:
                kinds.append(shape[c])
            ordinal[c] = len(kinds) - 1
        shape[i] = shapes.setdefault((page.labels[i], *kinds), len(shapes))
    node, known, lines, depths = [0] * n, {}, [f"0 {page.labels[0]}"], [0]
    for i in range(1, n):
        up = node[page.parents[i]]
        new = known.setdefault((up, ordinal[i]), len(lines))
        if new == len(lines):
            depths.append(depths[up] + 1)
            lines.append(f"{depths[new]} {page.labels[i]}")
        node[i] = new
    return "\n".join(lines), node


def _tree(text: str) -> tuple[list[str], list[list[int]]]:
    labels, children, path = [], [], []
    for i, line in enumerate(text.split("\n")):
        depth, label = line.split(" ", 1)
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(i)
        path.append(i)
    return labels, children


def matched(wrapper: str, other: str) -> list[int]:
    """For each node of the other tree the node of the wrapper that it matches, or -1, by simple tree matching."""
    if wrapper == other:
        return list(range(other.count("\n") + 1))
    (la, ca), (lb, cb) = _tree(wrapper), _tree(other)
    ways: dict[tuple[int, int], list[list[int]]] = {}
    weights: dict[tuple[int, int], int] = {}

    def weight(a: int, b: int) -> int:
        if la[a] != lb[b]:
            return 0
        if (a, b) not in weights:
            best = [[0] * (len(cb[b]) + 1)]
            for x in ca[a]:
                row, above = [0], best[-1]
                for j, y in enumerate(cb[b]):
                    w = weight(x, y)
                    row.append(max(above[j + 1], row[j], above[j] + w) if w else max(above[j + 1], row[j]))
                best.append(row)
            ways[a, b], weights[a, b] = best, 1 + best[-1][-1]
        return weights[a, b]

    out = [-1] * len(lb)
    left = [(0, 0)] if weight(0, 0) else []
    while left:
        a, b = left.pop()
        out[b] = a
        best, i, j = ways[a, b], len(ca[a]), len(cb[b])
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                left.append((ca[a][i], cb[b][j]))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _slots(page: Page) -> list[tuple[int, str, bool]]:
    """The texts that may be content: outside what stands around, and inside the article where one is marked."""
    around, inside = page.marked("!"), page.marked("*")
    free = [t for t in page.texts if not around[t[0]]]
    article = [t for t in free if inside[t[0]]]
    return [(b, t, False) for b, t, _ in article] or free


def _shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high in parts(b.column(1)):
            rows = []
            for host, source in zip(b.column(0).slice(low, high - low).to_pylist(), b.column(1).slice(low, high - low).to_pylist(), strict=True):
                page = Page(source)
                lines, node = skeleton(page)
                slots = _slots(page)
                texts = [_hash(t) for _, t, _ in slots]
                rows.append((host, lines, _hash("\n".join(t for _, t, _ in slots)), [node[b] for b, _, _ in slots], texts))
            types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "skeleton", "page", "nodes", "texts"])


class _Matches(dict):
    """Matches of the trees a task has met; emptied when they grow many."""

    def __missing__(self, pair: tuple[str, str]) -> list[int]:
        if len(self) > 1000:
            self.clear()
        self[pair] = out = matched(*pair)
        return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, node and text of each text that stands in a wrapper's node, once a page; without a text for the node itself."""
    known = _Matches()
    for b in batches:
        rows: list[tuple] = []
        for host, lines, nodes, texts, wrapper in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            place = known[wrapper, lines]
            found = {(place[n], t) for n, t in zip(nodes, texts, strict=True) if place[n] >= 0}
            rows += [(host, n, t) for n, t in found | {(n, None) for n, _ in found}]
        if rows:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "node", "text"])


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, skeleton (its commonest tree) and constant: nodes and hashes of texts that are template."""
    shapes = pages.filter(F.col("html").isNotNull()).select(_host().alias("host"), "html")
    shapes = shapes.mapInArrow(_shapes, "host string, skeleton string, page long, nodes array<int>, texts array<long>")
    # A page that stands in several places says nothing new about its host.
    shapes = written(shapes.dropDuplicates(["host", "page"]), "page-shapes")
    trees = shapes.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    trees = written(trees.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("skeleton")), "host-trees")
    both = shapes.select("host", F.col("skeleton").alias("lines"), "nodes", "texts", "page")
    both = lookup_join(both, trees, "host", F.col("page")).select("host", "lines", "nodes", "texts", "skeleton")
    counts = both.mapInArrow(_counted, "host string, node int, text long").groupBy("host", "node", "text").agg(F.count("*").alias("n"))
    counts = written(counts.filter(F.col("n") >= PAGES), "node-texts")
    every = counts.filter("text is null").select("host", "node", F.col("n").alias("every"))
    constant = counts.filter("text is not null").join(every, ["host", "node"]).filter(F.col("n") >= SHARE * F.col("every"))
    # Of one node no more texts pass than stand there on 0.9 of the pages.
    constant = constant.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("constant"))
    return written(trees.join(constant, "host", "left"), "wrappers")


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Matches()
    for b in batches:
        for low, high in parts(b.column(2)):
            out = []
            rows = b.slice(low, high - low)
            for source, wrapper, constant in zip(*(rows.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                page = Page(source or "")
                lines, node = skeleton(page)
                place = known[wrapper, lines] if wrapper else None
                template = {(c["node"], c["text"]) for c in constant or ()}
                slots = _slots(page)
                if template:
                    slots = [s for s in slots if (place[node[s[0]]], _hash(s[1])) not in template]
                out.append("\n".join(t for _, t, linked in slots if not linked))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    The text are the blocks of the article in page order, one a line, with
    character references decoded and white space as one space. Left out are
    template, and menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, comments and, where no article is marked, blocks that are
    links alone. Template is what nine of ten different pages of a host, and
    five at least, show in the same node; a host with fewer pages has none.
    A null or empty page has an empty text; a page without mark-up is its text.
    A null url has a host of its own. Rows are treated one by one, so repeated
    rows and null ids each keep a row; an empty table gives none. Extra columns
    are ignored.
    """
    every = pages.select("page_id", "url", "html", _host().alias("host"))
    # Equal pages of a hot host are spread by their url.
    joined = lookup_join(every, wrappers(pages), "host", F.struct("page_id", "url"))
    id_type = pages.schema["page_id"].dataType.simpleString()
    texts = joined.select("page_id", "url", "html", "skeleton", "constant").mapInArrow(_texts, f"page_id {id_type}, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
