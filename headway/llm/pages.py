"""Main text of web pages by site style trees.

1. Each page is parsed to a DOM of block elements.  Pages of one host are merged: a node of the site's style tree is
   the path of tags and classes that leads to it (digits of a class do not count), and it holds how often each
   presentation (the sequence of its block children) and each feature of its own content (terms, links, images) occurs
   on the host's pages; copies of a page count once.
2. A feature of c of a node's m pages has the importance 1 - log c / log m: 0 where every page has it, 1 where one has.
   A leaf's importance is the mean over all features of its pages, by what they show of it: a term weighs its letters,
   so that short words which all texts share say little, a link or image weighs one.  That of an inner node is composed bottom-up: the entropy of its
   presentations and the importance of its children, the more of the former the more presentations it has.  What a
   branch carries is the sum of importance times words over its nodes.
3. The main branch of a page is found from the root down, by following the one child that carries most of what its
   parent does.  What lies beside the way is removed, but for a heading that leads to the main branch; inside, branches
   whose importance is below a quarter of the main branch's are removed, so the floor is the host's own.

Elements that hold no text of the page (scripts, styles, forms, media) go first, and so do branches that say in their
tag or class that they are menus, adverts or comments: comments of readers vary like an article does, and no entropy
tells them apart.  Pages of hosts with too few pages for a tree rely on those words and on article and main elements.

The tree's rows are counts that are added up before the shuffle, one for each feature of a node; the features of a
large host's node are dealt to several tasks.  A host's tree comes back to its pages by a broadcast
where all trees together are within a checked size, and otherwise by a join whose key also holds a part of the host, so
pages of a large host never meet in one task.
"""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import may_be_among, slices, store

#: Elements whose text is never the page's.
NEVER = frozenset("script style noscript template head title form button select option textarea iframe object embed svg canvas audio video map input label fieldset".split())
#: Elements that by their name are other parts than the article.
ASIDE = frozenset("nav header footer aside dialog menu menuitem".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text; a line break is white space inside one.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark other parts than the article.
MARKED = re.compile(r"(?:^|[\s_\-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|related|replies|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_\-])", re.I)
#: An open element that the start of another one closes.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
# A quote counts only after an equals sign; nothing is given back, so a page is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
#: Features that a task holds before it hands on their counts.
HELD = 1 << 21
#: Parts of a node's features, by their hash; the parts of a node meet in tasks of their own.
PARTS = 32
#: How much of an inner node's importance is that of its children, to the power of its number of presentations.
GAMMA = 0.9
#: A child that carries this share of its parent leads to the main branch.
LEADS = 0.6
#: Trees of more bytes than this are joined with the pages by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Pages of a host that share a part of the host's key.
PART_PAGES = 20_000
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Node:
    tag: str
    mark: str = ""
    path: int = 0
    parent: Node | None = None
    items: list = field(default_factory=list)  # child nodes and text pieces in page order
    refs: list = field(default_factory=list)  # what it links to or shows


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(page: str | None) -> Node:
    """The tree of a page; unclosed and stray tags are borne, the text of raw elements stays out.  Linear in the page."""
    root = Node("#root")
    page = page or ""
    at, text, node, last, open_tags, open_blocks = 0, 0, root, page.rfind(">"), {}, [root]

    def leave(to: Node) -> None:
        """Closes open elements up to and without ``to``."""
        nonlocal node
        while node is not to:
            open_tags[node.tag] -= 1
            if node.tag in BLOCK:
                open_blocks.pop()
            node = node.parent

    while at <= last and (m := _TOKEN.search(page, at)):
        if m.start() > text:
            node.items.append(page[text : m.start()])
        at = text = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if open_tags.get(tag):  # else a stray end
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            elif tag == "p":
                node.items.append(Node("p", parent=node, path=_hash(f"{node.path}/p")))
            continue
        while node.tag in CLOSES and tag in CLOSES[node.tag]:
            leave(node.parent)
        # an inline element left open does not swallow the blocks that follow
        if tag in BLOCK and (block := open_blocks[-1]).tag in CLOSES and tag in CLOSES[block.tag]:
            leave(block.parent)
        child = Node(tag, parent=node)
        if "=" in m.group(3):
            style = ""
            for name, *values in _ATTR.findall(m.group(3)):
                value, name = next(filter(None, values), ""), name.lower()
                if name in ("href", "src"):
                    child.refs.append(value)
                else:
                    child.mark = f"{child.mark} {value}".strip()
                    style += f".{_DIGITS.sub('#', value)}" if name == "class" else ""
            child.path = _hash(f"{node.path}/{tag}{style}")
        else:
            child.path = _hash(f"{node.path}/{tag}")
        node.items.append(child)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = text = end.end() if end else len(page)
        elif tag not in VOID and not m.group(3).rstrip().endswith("/"):
            node = child
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in BLOCK:
                open_blocks.append(child)
    if text < len(page):
        node.items.append(page[text:])
    return root


def blocks(node: Node, keep) -> list[str]:
    """Text blocks below ``node`` in page order, without branches that ``keep`` refuses."""
    out, part = [], []

    def end() -> None:
        if part:
            line = _SPACE.sub(" ", html.unescape("".join(part))).strip()
            if line:
                out.append(line)
            part.clear()

    stack = [iter(node.items)]
    tags = [node.tag]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                part.append(item)
            elif keep(item):
                if item.tag in BLOCK:
                    end()
                elif item.tag == "br":
                    part.append(" ")
                stack.append(iter(item.items))
                tags.append(item.tag)
                break
        else:
            stack.pop()
            if tags.pop() in BLOCK:
                end()
    end()
    return out


def is_marked(node: Node, words: bool = True) -> bool:
    """Whether an element holds no text of the page or, with ``words``, says that it is not of the article."""
    if node.tag in NEVER:
        return True
    return words and (node.tag in ASIDE or bool(node.mark and node.tag not in ("html", "body", "article", "main") and MARKED.search(node.mark)))


@dataclass
class Branch:
    """What the nodes of one path have on one page."""

    tag: str
    parent: int | None
    nodes: int = 0
    words: int = 0
    terms: set = field(default_factory=set)
    refs: set = field(default_factory=set)
    shape: list = field(default_factory=list)
    children: dict = field(default_factory=dict)  # paths in page order


def branches(root: Node) -> dict[int, Branch]:
    """The block elements of a page by path, parents first; text and references belong to the nearest block."""
    out: dict[int, Branch] = {0: Branch("#root", None, 1)}
    stack = [(root, 0)]
    while stack:
        node, at = stack.pop()
        if node.tag in BLOCK and node.path:
            if node.path not in out:
                out[node.path] = Branch(node.tag, at)
                out[at].children[node.path] = None
            out[at].shape.append(node.tag)
            at = node.path
            out[at].nodes += 1
            out[at].shape.append("(")
        b = out[at]
        b.refs.update(node.refs)
        for i in node.items:
            if isinstance(i, str):
                found = i.split()
                b.words += len(found)
                b.terms.update(found)
        stack.extend((i, at) for i in reversed(node.items) if isinstance(i, Node) and i.tag not in NEVER)
    return out


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", url or "")
    return m.group(1).rpartition("@")[2].lower() if m else ""


def _url_host() -> Column:
    """``host`` as a column expression."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1), "^.*@", ""))


def named_branch(root: Node) -> Node:
    """The branch that holds the main text by its name: the article or main element with most text, else all."""
    named, stack = [], [root]
    while stack:
        n = stack.pop()
        if is_marked(n):
            continue
        if n.tag in ("article", "main"):
            named.append(n)
        stack.extend(i for i in reversed(n.items) if isinstance(i, Node))
    articles = [n for n in named if n.tag == "article"] or named
    if len(articles) > 1:
        return max(articles, key=lambda n: sum(map(len, blocks(n, lambda i: not is_marked(i)))))
    return articles[0] if articles else root


@dataclass
class Stat:
    """What a host's pages say of a path: its pages, its presentations and their entropy, its content's importance, words a page."""

    pages: int
    styles: int
    presentation: float
    content: float
    words: float


def judged(root: Node, tree: dict[int, Stat], floor: float, words: bool) -> tuple[int, set[int]] | None:
    """(path of the main branch, paths to remove) of a page by its site's tree; None where the tree says nothing of it.

    ``words``: whether marked branches are left out of account."""
    found = branches(root)
    marked: set[int] = set()
    if words:
        stack = [root]
        while stack:
            n = stack.pop()
            if is_marked(n):
                marked.add(n.path)
            else:
                stack.extend(i for i in n.items if isinstance(i, Node))
    importance: dict[int, float] = {}
    carries: dict[int, float] = {}
    for path in reversed(found):  # children before their parents
        b, s = found[path], tree.get(path)
        if path in marked or s is None and path:
            importance[path], carries[path] = 1.0, 0.0
            continue
        inner = [c for c in b.children if carries[c] > 0]
        below = sum(carries[c] for c in inner)
        own = s.content * s.words if s else 0.0
        mean = (sum(importance[c] * carries[c] for c in inner) + (s.content if s else 0.0) * own) / (below + own) if below + own else 0.0
        part = GAMMA**s.styles if s and inner else 1.0
        importance[path] = (1 - part) * (s.presentation if s else 0.0) + part * mean
        carries[path] = own + below
    at = 0
    while carries[at]:
        best = max(found[at].children, key=lambda c: carries[c], default=None)
        if best is None or carries[best] < LEADS * carries[at] or found[best].nodes > 1 or not found[best].children:
            break
        at = best
    if at == 0:
        return None
    low = set()
    below = list(found[at].children)
    while below:
        c = below.pop()
        if c in tree and importance[c] < floor * importance[at]:
            low.add(c)
        else:
            below.extend(found[c].children)
    return at, low


def extract(page: str | None, tree: dict[int, Stat] | None = None, *, floor: float = 0.25, words: bool = True) -> str:
    """The main text of a page, given what the site's pages say of its nodes (nothing for a site without a tree)."""
    root = parse(page)
    verdict = judged(root, tree, floor, words) if tree else None
    if verdict is None:
        return "\n".join(blocks(named_branch(root), lambda n: not is_marked(n)))
    at, low = verdict
    top, stack = None, [root]
    while stack and top is None:
        n = stack.pop()
        if n.path == at:
            top = n
        stack.extend(i for i in reversed(n.items) if isinstance(i, Node))
    leading, n = [], top
    while n.parent is not None:
        before = n.parent.items[: next(k for k, i in enumerate(n.parent.items) if i is n)]
        leading = [i for i in before if isinstance(i, Node) and i.tag in HEADINGS] + leading
        n = n.parent
    keep = lambda n: n.path not in low and not is_marked(n, words)
    out = [line for h in leading if keep(h) and not _under_marked(h, words) for line in blocks(h, keep)]
    return "\n".join(out + blocks(top, keep))


def _under_marked(n: Node | None, words: bool) -> bool:
    while n is not None:
        if is_marked(n, words):
            return True
        n = n.parent
    return False


def different_pages(pages: DataFrame) -> DataFrame:
    """``host, html``: each host's pages, copies of a page once.  Only pages that may have copies are shuffled."""
    rows = pages.select(_url_host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("page", F.xxhash64("host", "html"))
    copied = store(rows.groupBy("page").count().filter("count > 1").select("page"), "pages-copied")
    once = may_be_among(rows, "page", copied, "page", inside=False).select("host", "html")
    return once.unionByName(may_be_among(rows, "page", copied, "page").groupBy("host", "page").agg(F.first("html").alias("html")).select("host", "html"))


def _counts(held: dict[tuple[str, int], tuple[dict[int, list[int]], array, array]]) -> Iterator[pa.RecordBatch]:
    """The counts of ``features`` from what a task holds: by node its presentations, the features of all pages and what these weigh."""
    keys, lists, size = [], [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.bool_()))]
        ends = pa.array(np.cumsum([0] + [len(x[0]) for x in lists]), pa.int32())
        columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in lists]), pa.int64())) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["host", "path", "part", "shape", "feature", "n", "weight"])

    for (host, path), (shapes, terms, sizes) in held.items():
        kinds = [(True, *np.array([(s, *n) for s, n in shapes.items()], np.int64).T)]
        if terms:
            feature, at, n = np.unique(np.frombuffer(terms, np.int64), return_index=True, return_counts=True)
            kinds.append((False, feature, n, n * np.frombuffer(sizes, np.int64)[at]))
        for shape, feature, n, weight in kinds:
            part = feature & (PARTS - 1)
            order = np.lexsort((weight, n, part))  # equal values side by side take little room
            starts = np.flatnonzero(np.diff(part[order], prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                keys.append((host, path, int(part[order[a]]), shape))
                lists.append((feature[order[a:b]], n[order[a:b]], weight[order[a:b]]))
            size += len(order)
        if size >= 1 << 18:
            yield batch()
            keys, lists, size = [], [], 0
    if keys:
        yield batch()


def features(pages: DataFrame) -> DataFrame:
    """``host, path, part, shape, feature, n, weight``: every presentation (``shape``) and every feature of the content
    of each node, and on how many of the host's different pages it is; with the words of these pages' nodes, or with
    what the feature weighs on all of them."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in (part for whole in batches for part in slices(whole, 1)):
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p, x in branches(parse(page)).items():
                    if not p:
                        continue
                    if (h, p) not in held:
                        held[h, p] = {}, array("q"), array("q")
                    shapes, terms, sizes = held[h, p]
                    n = shapes.setdefault(_hash(",".join(x.shape)), [0, 0])
                    n[0] += 1
                    n[1] += x.words
                    terms.extend(map(_hash, x.terms))
                    sizes.extend(map(len, x.terms))
                    terms.extend(~_hash(r) for r in x.refs)  # no term
                    sizes.extend([1] * len(x.refs))
                    size += len(x.terms) + len(x.refs) + 8
                if size >= HELD:
                    yield from _counts(held)
                    held, size = {}, 0
        yield from _counts(held)

    part = ["host", "path", "part"]
    found = different_pages(pages).mapInArrow(nodes, "host string, path long, part int, shape boolean, feature array<long>, n array<long>, weight array<long>")
    # packed until they are where they are counted
    each = found.repartition(*part).select(*part, "shape", F.explode(F.arrays_zip("feature", "n", "weight")).alias("f")).select(*part, "shape", "f.*")
    return each.groupBy(*part, "shape", "feature").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def site_trees(pages: DataFrame) -> DataFrame:
    """``host, path, pages, styles, presentation, content, words``: the nodes of each host's merged tree."""
    node = ["host", "path"]
    of_shapes = lambda c: F.sum(F.when(F.col("shape"), c))
    of_terms = lambda c: F.sum(F.when(~F.col("shape"), c))
    n, weight = F.col("n"), F.col("weight")
    tree = features(pages).groupBy(*node).agg(of_shapes(n).alias("pages"), of_shapes(F.lit(1)).alias("styles"), of_shapes(weight).alias("w"), of_shapes(n * F.ln(n)).alias("nl"), of_terms(weight).alias("c"), of_terms(weight * F.ln(n)).alias("cl")).filter("pages > 1")
    content = F.coalesce(F.lit(1.0) - F.col("cl") / (F.col("c") * F.ln("pages")), F.lit(0.0))
    return tree.select(*node, "pages", "styles", (F.lit(1.0) - F.col("nl") / (F.col("pages") * F.ln("pages"))).alias("presentation"), content.alias("content"), (F.col("w") / F.col("pages")).alias("words"))


def main_text(pages: DataFrame, *, floor: float = 0.25, least_pages: int = 8, words: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars``, one row out for each row in.

    Nodes seen on fewer than ``least_pages`` different pages of a host are not part of its tree.  ``words=False``
    leaves out the words by which elements name themselves, so that trees decide alone.  Null and empty pages give
    an empty text, pages without a url share a nameless host.  Repeated rows give repeated results; other columns
    are ignored; an empty table gives an empty result.
    """
    tree = site_trees(pages).filter(F.col("pages") >= least_pages)
    by_host = store(tree.groupBy("host").agg(F.max("pages").alias("most"), F.sort_array(F.collect_list(F.struct("path", "pages", "styles", "presentation", "content", "words"))).alias("tree")), "pages-trees")
    size = by_host.agg(F.coalesce(F.sum(F.size("tree") * 64 + 200), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", _url_host().alias("host"))
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(by_host.drop("most")), "host", "left")
    else:
        hot = by_host.filter(F.col("most") >= PART_PAGES).select("host", (F.col("most") / PART_PAGES).cast("int").alias("parts"))
        # one host for each PART_PAGES pages at most; of more than fit, Spark splits what is skewed
        rows = rows.join(F.broadcast(hot), "host", "left") if hot.count() <= BROADCAST_BYTES // 64 else rows.withColumn("parts", F.lit(0))
        rows = rows.withColumn("part", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("url", "html"), F.col("parts") + 1)).otherwise(F.lit(0)).cast("int"))
        copies = by_host.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("most") / PART_PAGES).cast("int"))))
        met = rows.join(copies.select("host", "part", "tree"), ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, Stat]] = {}
        for b in (part for whole in batches for part in slices(whole, 2)):
            texts = []
            for i, (page, h) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if h not in known:
                    if len(known) >= 200:
                        known.clear()
                    known[h] = {x["path"]: Stat(x["pages"], x["styles"], x["presentation"], x["content"], x["words"]) for x in b.column(4)[i].as_py() or ()}
                texts.append(extract(page, known[h], floor=floor, words=words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    met = met.select("page_id", "url", "html", "host", "tree")
    kind = met.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
