"""Main texts of web pages by site style trees.

The pages of a host are merged into one tree of styles: a node is a path of elements with their
classes, its presentations are the sequences of children it comes with, its contents the texts
below it. What looks and reads the same on many pages matters little: importance is an entropy
over a host's pages, and leans on a middle value where pages are few. What the markup says of
itself is a bounded prior that it is weighed against, and branches of low importance are cut
from each page. Trees are counted by grouped aggregation, never built in
one task, and each page is cut by itself.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchwell.llm.common import written
from patchwell.llm.language import host_of, markup_language

#: A branch below this importance is cut.
THRESHOLD = 0.25
#: Share of a node's importance that comes from below if it has one child; to the power of their number.
GAMMA = 0.9
#: Importance of a path that nothing is known of, and the pages that it counts for.
UNKNOWN = 0.5
PRIOR_PAGES = 4.0
#: Share of a path's pages from which on a text has an importance of its own.
COMMON = 0.5
#: Measured importance speaks with at most log odds of this value.
SUREST = 0.98
#: Log odds that the markup adds: inside an article; outside the articles of a page that has some;
#: of a frame, which a frame with the bulk of the text has less against it.
INSIDE, OUTSIDE, FRAMED, FRAMED_SMALL = 0.5, -1.2, -1.5, -6.0
#: Characters from which on a branch can be the bulk of a page.
BULK_CHARS = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video".split())
SKIPPED = RAW | frozenset("head title button select option textarea datalist dialog input label fieldset legend".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
#: Elements that neither end a paragraph nor a block.
INSIDE_TEXT = INLINE | RAW | VOID | {"button", "label", "select", "textarea", "input"}
#: Elements whose name says that they frame the page.
FRAME = frozenset("nav footer header aside form menu".split())
CONTENT = frozenset("article main".split())
#: Words of a class, an id or a role that say the same.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies"
    " consent copyright disqus footer form gdpr header login masthead menu menus modal nav navbar navigation"
    " newsletter notice notices notification pagination pager popup promo promos promotion related replies reply"
    " search share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar"
    " widget widgets alert complementary contentinfo discussion respond".split()
)
#: Elements that end an open element of the given names when they start.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: An open element of these names is not closed from inside by CLOSES or by a stray end.
FENCES = frozenset("ul ol dl table article main section div body nav aside header footer form blockquote".split())

#: A whole tag of usual size (so that looking for one costs a bounded time), or how others start.
_USUAL = r"(/?)([a-zA-Z][a-zA-Z0-9]{0,15}+)(?=[\s/>])((?:[^<>\"']{0,64}+(?:\"[^\"]{0,256}+\"|'[^']{0,256}+')){0,16}+[^<>\"']{0,64}+)>"
_START = re.compile(rf"<(?:{_USUAL}|(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
#: Open elements from which on closing one takes their places instead of walking over them.
DEEP = 64
_QUOTE_OR_END = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|[\s/'])hidden(?:[\s/=]|$)", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    name: str
    style: str = ""
    frames: bool = False
    children: list = field(default_factory=list)  # of nodes and texts
    path: int = 0


class _Tags:
    """Ends of tags that are not of usual size, in linear time for a page: how a tag ends depends on
    the next quote or angle alone, which is looked for once, and what follows from a quote is kept."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.known: dict[int, int] = {}  # by an opening quote the end of its tag, -1 for none
        self.ahead = -1  # the next quote or angle as last looked for

    def _end(self, at: int) -> int:
        html, known = self.html, self.known
        if self.ahead < at:
            found = _QUOTE_OR_END.search(html, at)
            self.ahead = found.start() if found else len(html)
        k, passed = self.ahead, []
        while True:
            if k >= len(html) or html[k] == ">":
                end = k if k < len(html) else -1
                break
            if k in known:
                end = known[k]
                break
            passed.append(k)
            close = html.find(html[k], k + 1)
            found = _QUOTE_OR_END.search(html, close + 1) if close >= 0 else None
            if not found:
                end = -1
                break
            k = found.start()
        for k in passed:
            known[k] = end
        return end

    def read(self, found: re.Match) -> tuple[int, str, str, str]:
        """End, slash, name and attributes of what ``found`` starts; comments and declarations have no
        name. A tag whose quotes or angle are not closed is text: then the end is one less than the
        negated place from which to look on."""
        html, start = self.html, found.start()
        if found[4]:
            end = html.find("-->", found.end())
            return end + 3 if end >= 0 else len(html), "", "", ""
        if start > self.last:  # nothing but comments can follow
            comment = html.find("<!--", start)
            return -1 - (comment if comment >= 0 else len(html)), "", "", ""
        if found[5]:
            return html.find(">", start) + 1, "", "", ""
        end = self._end(found.end())
        if end < 0:  # nor does any tag end that starts in this name
            inner = [k for k in (html.find(x, start + 1, found.end()) for x in ("<!", "<?")) if k >= 0]
            return -1 - min(inner, default=found.end()), "", "", ""
        return end + 1, found[6], found[7], html[found.end() : end]


class _Open:
    """The open elements of a deep page, with the places of each name, of fences and of what is not
    inline, so that nothing is searched. It closes what the functions for pages that are not deep do."""

    def __init__(self, stack: list[Node]) -> None:
        self.stack = stack
        self.places: dict[str, list[int]] = {}
        self.fences = [0]
        self.solid = [0]
        for k in range(1, len(stack)):
            self.note(k)

    def note(self, k: int) -> None:
        name = self.stack[k].name
        self.places.setdefault(name, []).append(k)
        if name in FENCES:
            self.fences.append(k)
        if name not in INLINE:
            self.solid.append(k)

    def cut(self, k: int) -> None:
        """Closes the k-th open element and all in it."""
        while len(self.stack) > k:
            self.places[self.stack.pop().name].pop()
        while self.fences[-1] >= k:
            self.fences.pop()
        while self.solid[-1] >= k:
            self.solid.pop()

    def close(self, name: str) -> None:
        """An end tag; one whose element is outside a fence is stray."""
        places = self.places.get(name)
        if places and (name in FENCES or name == "html" or self.fences[-1] < places[-1]):
            self.cut(places[-1])

    def close_paragraph(self) -> None:
        """A block inside an open paragraph ends it, and the inline elements open in it."""
        k = self.solid[-1]
        if k and self.stack[k].name == "p":
            self.cut(k)

    def close_any(self, names: set[str]) -> None:
        k = max((self.places[x][-1] for x in names if self.places.get(x)), default=0)
        if k and self.fences[-1] < k:
            self.cut(k)


def parse(html: str) -> Node:
    """The page as a tree. Unclosed and stray tags are taken as browsers take them, roughly: a block
    ends an open paragraph, an end tag closes what is open inside its element. Linear in the page."""
    root = Node("root")
    stack = [root]
    deep: _Open | None = None
    tags = _Tags(html)
    at = look = 0
    size = len(html)
    while found := _START.search(html, look):
        slash, name, attributes = found.group(1, 2, 3)
        if name:
            end = found.end()
        else:
            end, slash, name, attributes = tags.read(found)
            if end < 0:
                look = -1 - end
                continue
        start = found.start()
        if start > at:
            stack[-1].children.append(html[at:start])
        at = look = end
        if not name:
            continue
        name = name.lower()
        if slash:
            if deep:
                deep.close(name)
            else:
                _close(stack, name)
            continue
        if name == "hr" or name not in INSIDE_TEXT:
            if deep:
                deep.close_paragraph()
            else:
                _close_paragraph(stack)
        if name in CLOSES:
            if deep:
                deep.close_any(CLOSES[name])
            else:
                _close_open(stack, CLOSES[name])
        node = _node(name, attributes) if attributes else Node(name)
        stack[-1].children.append(node)
        if name in RAW and not attributes.endswith("/"):
            close = _RAW_END[name].search(html, at, tags.last + 1)
            at = look = close.end() if close else size
        elif name not in VOID and not (attributes.endswith("/") and name not in INLINE and name not in FENCES):
            stack.append(node)
            if deep:
                deep.note(len(stack) - 1)
            elif len(stack) > DEEP:
                deep = _Open(stack)
    if at < size:
        stack[-1].children.append(html[at:])
    return root


def _node(name: str, attributes: str) -> Node:
    if not attributes.strip():
        return Node(name)
    words: list[str] = []
    frames = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role"):
            text = next(filter(None, values), "")
            if key == "class":
                words = sorted(set(text.lower().split()))
            frames |= not FRAME_WORDS.isdisjoint(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower()))
        elif key == "aria-hidden":
            frames |= "true" in values
        elif key == "style":
            frames |= any(map(_NOT_SHOWN.search, values))
    if "hidden" in attributes.lower():
        frames |= _HIDDEN.search(_QUOTED.sub("''", attributes)) is not None
    return Node(name, ".".join(words), frames)


def _close(stack: list[Node], name: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            del stack[k:]
            return
        if stack[k].name in FENCES and name not in FENCES and name != "html":
            return  # a stray end


def _close_paragraph(stack: list[Node]) -> None:
    """A block inside an open paragraph ends it, and the inline elements open in it."""
    k = len(stack) - 1
    while k > 0 and stack[k].name in INLINE:
        k -= 1
    if k > 0 and stack[k].name == "p":
        del stack[k:]


def _close_open(stack: list[Node], names: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in names:
            del stack[k:]
            return
        if stack[k].name in FENCES:
            return


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, decoded, white space made single."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [("in", node)]
    while todo:
        what, x = todo.pop()
        if what == "end":
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.name in SKIPPED:
            continue
        elif x.name == "br":
            run.append(" ")
        else:
            if x.name == "hr" or x.name not in INSIDE_TEXT:
                end()
                todo.append(("end", None))
            todo += [("in", c) for c in reversed(x.children)]
    end()
    return out


def _walk(root: Node) -> Iterator[Node]:
    """All block elements that may hold text, parents first, with their paths as 64-bit numbers."""
    todo = [(root, 0)]
    while todo:
        node, above = todo.pop()
        node.path = _number(f"{above}/{node.name}.{node.style}")
        yield node
        todo += [(c, node.path) for c in _own_children(node)]


def _number(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 | zlib.crc32(raw, 0x9E3779B9) >> 1


def _look(node: Node) -> int:
    """The node's presentation: its children's names and classes in order, repeats made one."""
    looks: list[str] = []
    for c in node.children:
        look = f"{c.name}.{c.style}" if isinstance(c, Node) else "text" if c.strip() else ""
        if look and (not looks or looks[-1] != look):
            looks.append(look)
    return _number(" ".join(looks))


def _own_children(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.name not in SKIPPED and c.name not in INLINE]


# --- a host's style tree --------------------------------------------------------------------


def observe(pages: DataFrame) -> DataFrame:
    """``host, path, kind, feature, n``: presentations (kind 0), texts (kind 1) and pages (kind 2) of each
    path, counted once a page and added up over the batches of a task."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                own = set()
                for node in _walk(parse(html or "")):
                    own.add((node.path, 0, _look(node)))
                    own.add((node.path, 2, 0))
                    if not _own_children(node):
                        own.update((node.path, 1, _number(x)) for x in blocks(node))
                for x in own:
                    seen[(host, *x)] = seen.get((host, *x), 0) + 1
            columns = list(zip(*((*k, n) for k, n in seen.items()))) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return pages.select("host", "html").mapInArrow(run, "host string, path long, kind int, feature long, n long")


def importances(observed: DataFrame) -> DataFrame:
    """``host, path, text, looks, reads``: of each path on two pages or more the importance of its
    presentations and of its texts, from 0 (all pages alike) to 1 (no two alike); in rows with a
    ``text`` that of one text on at least half of the path's pages, which ``reads`` of the path leaves
    to them.

    The entropy of the presentations to the base of their number, and one less the mean entropy of
    a text's pages, log n / log m for a text on n of m pages. Each is drawn to ``UNKNOWN`` as if by
    ``PRIOR_PAGES`` pages more."""
    features = written(observed.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n")), "features")
    number, log = F.col("n").cast("double"), F.log(F.col("n").cast("double"))
    look, text = F.col("kind") == 0, F.col("kind") == 1

    def total(value: F.Column, when: F.Column) -> F.Column:
        return F.sum(F.when(when, value).otherwise(0.0))

    paths = features.groupBy("host", "path").agg(
        total(number, F.col("kind") == 2).alias("m"),
        total(number, look).alias("all_looks"),
        total(number * log, look).alias("look_logs"),
        total(number, text).alias("texts"),
        total(number * log, text).alias("text_logs"),
    )
    paths = written(paths.where("m >= 2"), "paths")
    repeated = features.where(text & (F.col("n") >= 2)).withColumnRenamed("feature", "text")
    common = repeated.join(paths.select("host", "path", "m"), ["host", "path"]).where(F.col("n") >= COMMON * F.col("m"))
    common = written(common.select("host", "path", "text", "n", "m"), "common")
    of_common = common.groupBy("host", "path").agg(
        F.sum("n").cast("double").alias("common_texts"), F.sum(number * log).alias("common_logs")
    )
    size = F.log("m")

    def drawn(value: F.Column) -> F.Column:
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
        return ((value * F.col("m") + UNKNOWN * PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES)).cast("float")

    joined = paths.join(of_common, ["host", "path"], "left").na.fill(0.0, ["common_texts", "common_logs"])
    rest = F.col("texts") - F.col("common_texts")
    reads = 1 - (F.col("text_logs") - F.col("common_logs")) / (rest * size)
    measured = joined.select(
        "host",
        "path",
        F.lit(None).cast("long").alias("text"),
        drawn(1 - F.col("look_logs") / (F.col("all_looks") * F.log("all_looks"))).alias("looks"),
        F.when(rest > 0, drawn(reads)).alias("reads"),
    )
    own = drawn(1 - log / size)
    return measured.union(common.select("host", "path", "text", F.lit(None).cast("float"), own))


#: By path the importance of looks and of texts, and by path and text that of common texts.
Tree = dict[int | tuple[int, int], tuple[float | None, float | None]]


def _leaf(node: Node, tree: Tree) -> float:
    looks, reads = tree.get(node.path, (UNKNOWN, UNKNOWN))
    other = UNKNOWN if reads is None else reads
    texts = [tree.get((node.path, _number(x)), (None, other))[1] for x in blocks(node)] if node.path in tree else []
    return sum(texts) / len(texts) if texts else looks if reads is None else reads


def _composite(order: list[Node], tree: Tree) -> dict[int, float]:
    """Importance of each node by its identity: the mean of its children's and, more so the more
    children it has, that of its own presentations."""
    out: dict[int, float] = {}
    for node in reversed(order):
        children = [out[id(c)] for c in _own_children(node)]
        if not children:
            out[id(node)] = _leaf(node, tree)
        else:
            own = 1 - GAMMA ** len(children)
            out[id(node)] = own * tree.get(node.path, (UNKNOWN,))[0] + (1 - own) * sum(children) / len(children)
    return out


def _odds(value: float) -> float:
    value = min(SUREST, max(1 - SUREST, value))
    return math.log(value / (1 - value))


def _sizes(order: list[Node]) -> dict[int, int]:
    """Characters of text below each node."""
    out: dict[int, int] = {}
    for node in reversed(order):
        size = sum(out[id(c)] for c in _own_children(node))
        todo = [c for c in node.children if isinstance(c, str) or c.name in INLINE]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                size += len(c.strip())
            elif c.name not in SKIPPED and c.name not in VOID:
                todo += c.children
        out[id(node)] = size
    return out


def main_text(html: str, tree: Tree, threshold: float = THRESHOLD) -> str:
    """The page without branches of low importance.

    A branch stays if it or a branch in it has an importance, weighed by what the markup says, of
    at least the threshold: inside articles more easily, in framing elements and words less, and so
    outside the articles of a page that has some. Enough evidence outvotes each of these. What holds
    the bulk of a page's text has less against it. An article that would go as a whole, such as a
    copied one, is kept by the markup alone."""
    root = parse(html)
    order = list(_walk(root))
    importance, size = _composite(order, tree), _sizes(order)
    top = {id(root)}
    inside: dict[int, bool] = {id(root): False}
    framed: dict[int, bool] = {}
    articles: list[Node] = []
    for node in order:
        within = inside[id(node)]
        framed[id(node)] = node.frames or (node.name in FRAME and not (within and node.name == "header"))
        if node.name in ("html", "body"):
            top.add(id(node))
        if node.name in CONTENT and not node.frames:
            articles.append(node)
        for c in _own_children(node):
            inside[id(c)] = within or node.name in CONTENT or c.name in CONTENT

    prior: dict[int, float] = {id(root): 0.0}
    score: dict[int, float] = {}
    for node in order:
        bulk = min(size[id(node)] / max(1, size[id(root)]), size[id(node)] / (size[id(node)] + BULK_CHARS))
        above = prior[id(node)]
        if framed[id(node)] and id(node) not in top:
            above = min(above, FRAMED + FRAMED_SMALL * (1 - bulk))
        for c in _own_children(node):
            prior[id(c)] = above
        own = above
        if above > FRAMED:  # in no frame
            own = INSIDE if inside[id(node)] else OUTSIDE * (1 - bulk) if articles else 0.0
        score[id(node)] = _odds(importance[id(node)]) - _odds(threshold) + own

    def pruned(kept: set[int]) -> tuple[dict[int, bool], dict[int, bool]]:
        """Which nodes stay, and which of them hold text that stays."""
        stays: dict[int, bool] = {}
        text: dict[int, bool] = {}
        for node in reversed(order):
            own = _own_children(node)
            stays[id(node)] = id(node) in top or id(node) in kept or score[id(node)] >= 0 or any(stays[id(c)] for c in own)
            beside = size[id(node)] > sum(size[id(c)] for c in own)
            text[id(node)] = any(text[id(c)] for c in own) or (stays[id(node)] and beside)
        return stays, text

    stays, text = pruned(set())
    floor: set[int] = set()
    for article in articles:
        if not text[id(article)] and prior[id(article)] > FRAMED:
            todo = [article]
            while todo:
                node = todo.pop()
                if not framed[id(node)] or node is article:
                    floor.add(id(node))
                    todo += _own_children(node)
    if floor:
        stays, text = pruned(floor)

    out = Node(root.name, root.style)
    todo = [(root, out)]
    while todo:
        node, copy = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                copy.children.append(c)
            elif c.name in SKIPPED:
                continue
            elif stays.get(id(c), not (c.frames or c.name in FRAME)):  # inside lines the markup alone says
                copy.children.append(Node(c.name, c.style))
                todo.append((c, copy.children[-1]))
            else:
                copy.children.append(Node("hr"))  # a rule marks where a branch stood
    return "\n".join(blocks(out))


def extract(pages: DataFrame, threshold: float = THRESHOLD, declared: bool = False) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, and ``declared``, the language that its markup
    declares, if asked for.

    Null and empty pages have an empty text; pages with a null url or one without a host are one
    host; repeated rows each get theirs and count each in their host's tree; an empty table gives no
    rows; other columns are ignored."""
    rows = pages.select("page_id", "url", "html", F.coalesce(host_of("url"), F.lit("")).alias("host"))
    paths = importances(observe(rows))
    trees = written(
        paths.groupBy("host").agg(F.collect_list(F.struct("path", "text", "looks", "reads")).alias("tree")), "trees"
    )  # a host's paths: its templates, not its pages
    if declared:
        rows = rows.withColumn("declared", markup_language("html"))
    joined = rows.join(trees.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").drop("_host")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, {}
        for batch in batches:
            texts = []
            hosts, trees = batch.column("host").to_pylist(), batch.column("tree")
            for k, html in enumerate(batch.column("html").to_pylist()):
                if hosts[k] != last:
                    last = hosts[k]
                    tree = {
                        x["path"] if x["text"] is None else (x["path"], x["text"]): (x["looks"], x["reads"])
                        for x in trees[k].as_py() or ()
                    }
                texts.append(main_text(html or "", tree, threshold))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes)]
            names = ["page_id", "url", "text", "n_chars"]
            if declared:
                columns.append(batch.column("declared"))
                names.append("declared")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    page_id = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {page_id}, url string, text string, n_chars long" + (", declared string" if declared else ""))
