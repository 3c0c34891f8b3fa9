"""Main text of web pages by wrapper induction.

Every distinct page of a host is parsed into a DOM tree. Its shape is the tree of its distinct element
paths; shapes of a host that simple tree matching (the largest order-preserving matching of equally
labelled nodes) finds alike are one template. Over all distinct pages of a template, paths and texts
are counted: a text that most pages with its path have is template, others are slots. Elements of navigation,
advert and similar roles are boilerplate; of the rest, the container with the most varying text is the
content region. The wrapper of a host is, for each template, that region's path and the constant texts.

Every page is then read whole: all content regions by the wrapper (else, or where that is only the body, an article
or main elements, else the body), but for comments and teasers, without elements of a boilerplate role and without the template's
constant texts. Character references are decoded, white space in a block becomes one
space, blocks are joined by an empty line.

Nothing is sampled and no page's text is capped. Pages with equal texts count once, and a text is template only
over pages whose other texts differ. The distinct shapes of a host meet in tasks of ``SHAPES_PER_TASK``, then
what leads the templates found in these does. Wrappers are broadcast only
under ``BROADCAST_BYTES``; beyond it they are joined by host. Null pages and pages without text give
an empty text; rows without url share one host; repeated rows are each reported.
"""

from __future__ import annotations

import functools
import hashlib
import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import ident, saved

#: A text is template if this share of a template's distinct pages with its path has it, and at least so many pages.
SHARE = 0.8
LEAST_PAGES = 3
#: Only pages count whose other texts make up this share, so that copies can't erase each other.
DIFFERS, DIFFERS_INSIDE = 0.25, 0.5
#: Shapes are one template if tree matching pairs this share of their nodes.
ALIKE = 0.7
#: Distinct shapes of a host that one task compares at first.
SHAPES_PER_TASK = 4_096
BROADCAST_BYTES = 8_000_000
#: Elements nested deeper are read as if they stood at this depth, as browsers do.
DEEPEST = 256

# HTML element classes and the names that mark boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe xmp noembed noframes template svg math canvas object video audio".split())
ESCAPED = set("title textarea".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body caption html tbody td tfoot th thead tr dd dt li figcaption summary".split()) | {"li", "dd", "dt"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("article aside blockquote body button div dialog dl fieldset figure footer form header html main nav ol section table td th ul".split())
DROP_TAGS = set("head title nav footer aside form button select textarea label menu dialog input link meta".split()) | RAW
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar sidenav menu menubar nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription "
    "comment comments commentlist disqus reply replies respond related recommended share sharing social widget pagination pager login signup search "
    "toolbar copyright legal disclaimer alert".split()
)
HEADER_NAMES = {"header"}
#: Names of other people's or other pages' texts: dropped wherever they stand, articles inside them too.
OTHER_NAMES = set("comment comments commentlist disqus reply replies respond related recommended".split())
TEASER_NAMES = set("teaser teasers preview excerpt".split())
PAID_NAMES = set("ad ads advert adverts advertisement sponsored promo promotion".split())
#: Names that blocks of a text have as well: inside an article only the template's counts drop them.
MILD_NAMES = set("alert banner copyright disclaimer legal notice search share sharing social".split())
#: Parts of compound names that say where on the site a thing is.
PLACES = set("site page global top bottom primary secondary".split())
CONTENT_NAMES = set("article content post entry story main body text".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | set("p li dd dt td th caption figcaption blockquote pre".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|[^<]+|<""", re.S)
#: A tag whose quotes don't pair up ends at the next bracket.
_LOOSE = re.compile(r"()<(/?)([A-Za-z][^\s/>]*)([^<>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Za-z0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "parts", "key", "drop", "parent", "depth", "code", "named", "leads")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []  # texts and nodes in page order
        self.key = tag + "".join(sorted("." + c for c in attrs.get("class", "").lower().split()))
        #: digest of the path
        self.code = _digest(b"%d " % parent.code + self.key.encode("utf-8", "surrogatepass")) if parent else 0
        names = boilerplate_names(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()) if "class" in attrs or "id" in attrs else frozenset()
        self.named = frozenset() if tag in ("html", "body", "article", "main") else names & DROP_NAMES
        self.leads = 0
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
        header = tag == "header" or bool(names & HEADER_NAMES)
        always = hidden or tag in RAW or self.named & OTHER_NAMES
        # "role" and "header" are settled by settle_roles once the page's tree is known
        self.drop = "all" if always else "role" if tag in DROP_TAGS or attrs.get("role", "").lower() in DROP_ROLES else "name" if self.named else "header" if header and tag not in HEADINGS else ""

    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


@functools.lru_cache(4096)
def boilerplate_names(classes: str) -> frozenset[str]:
    """The boilerplate names among class tokens: whole ones, and compounds of nothing but such names and places on a site."""
    out: set[str] = set()
    for token in classes.split():
        parts = set(_NAME.findall(token))
        own = parts & (DROP_NAMES | HEADER_NAMES)
        if own and parts <= own | PLACES:
            out |= own
    return frozenset(out)


def settle_roles(nodes: list[Node]) -> None:
    """Decides which elements are dropped by role or name. nodes: all of a page, in page order.

    An element that holds all of the page's article and main elements isn't boilerplate. Inside of these, a name drops
    containers only, and no mild name does. Where nothing would be left of a page without them, names drop nothing.
    """
    gone: dict[int, bool] = {}
    inside: dict[int, bool] = {}
    for c in nodes:
        up = c.parent
        gone[id(c)] = gone.get(id(up), False) or c.drop == "all"
        inside[id(c)] = inside.get(id(up), False) or c.tag in ("article", "main")
    for c in reversed(nodes):
        c.leads += c.tag in ("article", "main") and not gone[id(c)]
        c.parent.leads += c.leads
    total = nodes[0].parent.leads if nodes else 0
    left: dict[int, bool] = {}
    some = False
    for c in nodes:
        if c.drop in ("role", "name", "header"):
            if total and c.leads == total:
                c.drop = ""
            elif c.drop == "name" and inside[id(c)] and (c.tag not in BLOCK or c.tag in TEXTUAL or c.named <= MILD_NAMES):
                c.drop = ""
            elif c.drop == "role":
                c.drop = "all"
        left[id(c)] = left.get(id(c.parent), True) and c.drop not in ("all", "name")
        some = some or left[id(c)] and any(isinstance(x, str) and not x.isspace() for x in c.parts)
    some = some or not nodes or any(isinstance(x, str) and not x.isspace() for x in nodes[0].parent.parts)
    for c in nodes:
        if c.drop == "name":
            c.drop = "all" if some or total else ""


@functools.cache
def _end_tag(tag: str) -> re.Pattern:
    """The end tag of a raw element, letters in either case as ASCII has them: offsets stay those of the page."""
    return re.compile(f"</{tag}(?=[\\s/>]|$)", re.I | re.A)


def parse(page: str) -> Node:
    root = top = Node("#", {}, None)
    nodes: list[Node] = []
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        closing, tag, given = m.groups()
        if m[0] == "<" and (loose := _LOOSE.match(page, at)):
            m = loose
            closing, tag, given = m.groups()[1:]
        at = m.end()
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                top.parts.append(htmllib.unescape(m[0]))
            continue
        tag = tag.lower()
        if closing:
            node = top
            while node is not root and node.tag != tag:
                # an inline or paragraph end tag doesn't close the container around it
                node = root if node.tag in SCOPE and tag not in BLOCK else node.parent
            if node is not root:
                top = node.parent
            continue
        attrs = {a[0].lower(): htmllib.unescape(a[1] or a[2] or a[3]) for a in reversed(_ATTRIBUTE.findall(given))} if given else {}
        if tag in CLOSES_P:
            top = _closed(top, root, {"p"})
        if tag in SIBLING:
            top = _closed(top, root, SIBLING[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE - SIBLING[tag])
        node = Node(tag, attrs, top)
        top.parts.append(node)
        nodes.append(node)
        if tag in VOID or given.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW or tag in ESCAPED:
            end = _end_tag(tag).search(page, at)
            end = end.start() if end else size
            if tag in ESCAPED:
                node.parts.append(htmllib.unescape(page[at:end]))
            close = page.find(">", end)
            at = size if close < 0 else close + 1
            continue
        if node.depth < DEEPEST:
            top = node
    settle_roles(nodes)
    return root


def _closed(top: Node, root: Node, tags: set[str], scope: set[str] = SCOPE) -> Node:
    """The open node once an open one of tags, within the scope, has been closed."""
    node = top
    while node is not root and node.tag not in tags:
        if node.tag in scope:
            return top
        node = node.parent
    return node.parent if node is not root else top


def match(a: Node, b: Node) -> tuple[int, list]:
    """Simple tree matching: the size of the largest matching of two trees with equal roots, and its pairs as nested lists.

    Siblings are aligned by the heaviest chain of equally labelled pairs that keeps both orders. Only such pairs are
    visited, and the best chain below a place is read off a tree of prefix maxima, so siblings of distinct labels
    (those of shapes) take n log n steps.
    """
    x, y = [c for c in a.children() if c.tag not in RAW], [c for c in b.children() if c.tag not in RAW]
    places: dict[str, list[int]] = {}
    for j, q in enumerate(y):
        places.setdefault(q.key, []).append(j)
    size = len(y) + 1
    best: list[tuple[int, tuple | None]] = [(0, None)] * (size + 1)  # maxima of chains that end in a stretch of places
    for p in x:
        found = []
        for j in places.get(p.key, ()):
            q, k, before = y[j], j, (0, None)
            while k > 0:
                if best[k][0] > before[0]:
                    before = best[k]
                k &= k - 1
            sub = match(p, q) if p.parts and q.parts else (1, [(p, q)])
            found.append((j + 1, (before[0] + sub[0], (sub[1], before[1]))))
        for k, chain in found:  # after all places were read: p is matched once
            while k <= size:
                if chain[0] > best[k][0]:
                    best[k] = chain
                k += k & -k
    top, k = (0, None), len(y)
    while k > 0:
        if best[k][0] > top[0]:
            top = best[k]
        k &= k - 1
    subs, link = [], top[1]
    while link:
        subs.append(link[0])
        link = link[1]
    return top[0] + 1, [(a, b), *reversed(subs)]


def _flat(pairs: list) -> Iterator[tuple[Node, Node]]:
    stack = [pairs]
    while stack:
        for p in stack.pop():
            if isinstance(p, list):
                stack.append(p)
            else:
                yield p


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _code(data: str | list) -> int:
    return _digest(json.dumps(data).encode())


class Outline:
    """What induction needs of a page: its shape, the digest of its texts, and their paths."""

    __slots__ = ("shape", "page", "skeleton", "texts")

    def __init__(self, root: Node):
        #: (place of the parent, path below the parent, path code) of the distinct paths of block elements, in page order
        self.skeleton: list[tuple[int, str, int]] = []
        places: dict[tuple[int, str], int] = {}
        stack = [(c, -1, "") for c in reversed(root.children())]
        while stack:
            node, up, below = stack.pop()
            if node.drop == "all":
                continue
            below = f"{below}/{node.key}" if below else node.key
            if node.tag in BLOCK:
                at = places.setdefault((up, below), len(places))
                if at == len(self.skeleton):
                    self.skeleton.append((up, below, node.code))
                up, below = at, ""
            stack.extend((c, up, below) for c in reversed(node.children()))
        self.shape = _code([x[2] for x in self.skeleton])
        #: text code: [path code, length on the page, inside an article or main element]
        self.texts: dict[int, list] = {}
        order = []
        for owner, text in _blocks(root):
            t = text_code(owner, text)
            order.append(t)
            own = self.texts.setdefault(t, [owner.code, 0, _semantic(owner)])
            own[1] += len(text)
        self.page = _code(order)


def text_code(owner: Node, text: str) -> int:
    return _digest(b"%d " % owner.code + text.encode("utf-8", "surrogatepass"))


def _semantic(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _tree(skeleton: list) -> tuple[Node, int]:
    nodes = [Node("#", {}, None)]
    for up, below, _ in skeleton:
        node = Node("div", {}, None)
        node.key = below
        nodes[up + 1].parts.append(node)
        nodes.append(node)
    return nodes[0], len(nodes)


def templates(shapes: list[tuple[int, int, list]]) -> dict[int, int]:
    """shapes: (shape, pages, skeleton). The template of each shape, named by its leading shape: the first larger one whose tree matches it by ``ALIKE``, else its own.

    Matched nodes have equal paths, so the number of common paths bounds a matching and spares most of them.
    """
    leaders: list[tuple[int, Node, int, set[int]]] = []
    out = {}
    for shape, _, skeleton in sorted(shapes, key=lambda x: (-x[1], x[0])):
        tree, size = _tree(skeleton)
        codes = {x[2] for x in skeleton}
        for leader, other, n, had in leaders:
            need = ALIKE * (size + n)
            if 2 * min(size, n) >= need and 2 * (len(codes & had) + 1) >= need and 2 * match(other, tree)[0] >= need:
                out[shape] = leader
                break
        else:
            out[shape] = shape
            leaders.append((shape, tree, size, codes))
    return out


def content_region(shapes: list[tuple[int, list]], sizes: dict[int, int]) -> tuple[str, int]:
    """shapes: (pages, skeleton) of a template; sizes: varying text by path code. Path and path code of the content region."""
    pages = sum(n for n, _ in shapes)
    had: Counter = Counter()
    known: dict[int, tuple[str, str, frozenset]] = {}  # path, tag, codes of the container and those above it
    for n, skeleton in shapes:
        line: list[tuple[str, frozenset]] = []
        for up, below, code in skeleton:
            above = line[up] if up >= 0 else ("", frozenset())
            here = (f"{above[0]}/{below}" if above[0] else below, above[1] | {code})
            line.append(here)
            known[code] = (here[0], re.split("[.]", below.rsplit("/", 1)[-1])[0], here[1])
            had[code] += n
    weight: Counter = Counter()
    for code, (_, _, above) in known.items():
        for up in above:
            weight[up] += sizes.get(code, 0)
    everything = max(weight.values(), default=0)
    # an article (or main) element that holds most is the region if it has nearly all that such elements have
    alike = {tag: sum(weight[c] for c, (_, t, above) in known.items() if t == tag and not any(known[u][1] == tag for u in above - {c})) for tag in ("article", "main")}
    best = ("", 0)
    for code in sorted(known, key=lambda c: (known[c][0].count("/"), known[c][0])):
        where, tag, _ = known[code]
        if everything and had[code] >= SHARE * pages and (weight[code] >= 0.9 * everything or tag in alike and weight[code] >= max(0.5 * everything, 0.9 * alike[tag])) and tag in BLOCK - {"p", "li", "td", "th"} - HEADINGS:
            best = (where, code)
    return best


def host_wrapper(parts: list[tuple[list, dict[int, int], list[int]]]) -> dict:
    """parts: of each template the shapes (shape, pages, skeleton), varying sizes by path and constant texts."""
    fitted = []
    for shapes, sizes, constant in sorted(parts, key=lambda x: (-sum(n for _, n, _ in x[0]), min(x[0])[0])):
        single = sum(n for _, n, _ in shapes) < 2
        where, code = ("", 0) if single else content_region([x[1:] for x in shapes], sizes)
        fitted.append({"content": where, "region": code, "constant": sorted(constant), "shapes": sorted(x[0] for x in shapes)})
    return fitted[0] | {"others": fitted[1:]} if fitted else {"content": "", "region": 0, "constant": [], "shapes": [], "others": []}


def induce(pages: list[str]) -> dict:
    """The wrapper of a host from its pages in memory, as host_wrappers does it over a table."""
    outlines = {(o.shape, o.page): o for o in (Outline(parse(p)) for p in pages)}.values()
    skeletons = {o.shape: o.skeleton for o in outlines}
    counts = Counter(o.shape for o in outlines)
    of = templates([(s, counts[s], k) for s, k in skeletons.items()])
    parts = []
    for k in sorted(set(of.values())):
        own = [o for o in outlines if of[o.shape] == k]
        with_path = Counter(p for o in own for p in {x[0] for x in o.texts.values()})
        with_text = Counter(t for o in own for t in o.texts)
        often = {t for o in own for t, x in o.texts.items() if with_text[t] >= max(LEAST_PAGES, SHARE * with_path[x[0]])}
        shown: Counter = Counter()
        for o in own:
            every, other = sum(x[1] for x in o.texts.values()), sum(x[1] for t, x in o.texts.items() if t not in often)
            shown.update(t for t, x in o.texts.items() if t in often and other >= (DIFFERS_INSIDE if x[2] else DIFFERS) * every)
        constant = {t for o in own for t, x in o.texts.items() if t in often and shown[t] >= max(LEAST_PAGES, SHARE * with_path[x[0]])}
        sizes: Counter = Counter()
        for o in own:
            for t, x in o.texts.items():
                sizes[x[0]] += 0 if t in constant else x[1]
        parts.append(([(s, counts[s], skeletons[s]) for s in skeletons if of[s] == k], sizes, list(constant)))
    return host_wrapper(parts)


def template_of(root: Node, wrapper: dict) -> dict:
    """The part of a host's wrapper that covers a page."""
    if not wrapper.get("others"):
        return wrapper
    if "of" not in wrapper:
        wrapper["of"] = {s: w for w in (wrapper, *wrapper["others"]) for s in w["shapes"]}
    return wrapper["of"].get(Outline(root).shape, {})


def _regions(root: Node, wrapper: dict) -> list[Node]:
    """Nodes to read, in page order: all at the wrapper's path, else all outermost article (or main) elements, but for comments and teasers."""
    at, semantic = [], []
    stack = [(c, False) for c in reversed(root.children())]
    while stack:
        c, inside = stack.pop()
        if c.drop:
            continue
        if c.code == wrapper.get("region"):
            at.append(c)
        names = set(_NAME.findall(c.attrs.get("itemprop", "").lower()))
        if not inside and (c.tag == "article" or "articlebody" in names):
            semantic.append((2, c))
        elif not inside and (c.tag == "main" or c.attrs.get("role", "").lower() == "main"):
            semantic.append((1, c))
        inside = inside or c.tag == "article"
        stack.extend((x, inside) for x in reversed(c.children()))
    top = max((k for k, _ in semantic), default=0)
    best = _outermost([c for k, c in semantic if k == top])
    # html and body say no more than that the page has a text: there an article or main element is narrower
    if best and not any(n.tag not in ("html", "body") for n in at):
        at = best
    return [n for n in at if not _other(n)] or at or [root]


def _outermost(nodes: list[Node]) -> list[Node]:
    own = set(map(id, nodes))

    def within(node: Node | None) -> bool:
        while node is not None and id(node) not in own:
            node = node.parent
        return node is not None

    return [n for n in nodes if not within(n.parent)]


def _other(node: Node) -> bool:
    """Whether a region is marked as a comment or as a teaser of another page."""
    names = boilerplate_names(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower())
    kinds = set(_NAME.findall(f"{node.attrs.get('itemtype', '')} {node.attrs.get('itemprop', '')}".lower()))
    tokens = set(node.attrs.get("class", "").lower().split())
    return bool(names & (OTHER_NAMES | PAID_NAMES) or kinds & {"comment"} or tokens & TEASER_NAMES)


def blocks(top: Node, constant: set[int]) -> list[str]:
    """The texts of a region's blocks in page order."""
    return [text for owner, text in _blocks(top) if not constant or text_code(owner, text) not in constant]


def _blocks(top: Node) -> list[tuple[Node, str]]:
    """Owner and text of each block of a region in page order."""
    out, run = [], []
    kept = _semantic(top)

    def flush(owner: Node) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append((owner, text))

    # an explicit stack: pages may nest deeper than Python's calls may
    stack: list[tuple[Node, Iterator, bool]] = [(top, iter(top.parts), False)]
    while stack:
        node, parts, headings = stack[-1]
        for p in parts:
            if isinstance(p, str):
                if not headings or any(n.tag in HEADINGS for n, _, _ in stack):
                    run.append(p)
            elif p.tag == "br":
                run.append(" ")
            elif p.drop == "all":
                if p.tag in BLOCK:
                    flush(node)
            elif p.drop == "header" and not (kept or any(n.tag in ("article", "main") for n, _, _ in stack)):
                flush(node)
            else:
                if p.tag in BLOCK:
                    flush(node)
                stack.append((p, iter(p.parts), headings or p.drop == "header"))
                break
        else:
            stack.pop()
            if node.tag in BLOCK or node is top:
                flush(node)
    return out


def extract(page: str, wrapper: dict) -> str:
    root = parse(page)
    wrapper = template_of(root, wrapper)
    constant = set(wrapper.get("constant", ()))
    return "\n\n".join(b for region in _regions(root, wrapper) for b in blocks(region, constant))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """pages: host, html. Returns host, wrapper (JSON)."""

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vectide.llm.wrappers import Outline as Own
        from vectide.llm.wrappers import parse as read

        seen, shown = set(), set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, flat, offsets = [], [], [0]
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    o = Own(read(page))
                    if (host, o.shape, o.page) in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    if len(shown) > 20_000:
                        shown.clear()
                    seen.add((host, o.shape, o.page))
                    new = (host, o.shape) not in shown
                    shown.add((host, o.shape))
                    rows.append((host, o.shape, o.page, json.dumps(o.skeleton) if new else None))
                    # a row without text for each path: its count is the number of pages with the path
                    flat += [(p, None, 0, False) for p in sorted({x[0] for x in o.texts.values()})]
                    flat += [(x[0], t, x[1], x[2]) for t, x in o.texts.items()]
                    offsets.append(len(flat))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    p, t, n, inside = zip(*flat, strict=True) if flat else ((), (), (), ())
                    items = pa.StructArray.from_arrays([pa.array(p, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(inside, pa.bool_())], ["p", "t", "n", "inside"])
                    texts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), texts], ["host", "shape", "page", "skeleton", "texts"])

    def group(rows: pa.Table) -> pa.Table:
        from vectide.llm.wrappers import templates as own

        shapes, pages, skeletons = (rows.column(c).to_pylist() for c in ("shape", "pages", "skeleton"))
        of = own([(s, n, json.loads(k)) for s, n, k in zip(shapes, pages, skeletons, strict=True)])
        return pa.table({"host": rows.column("host"), "shape": rows.column("shape"), "template": pa.array([of[s] for s in shapes], pa.int64()), "pages": rows.column("pages"), "skeleton": rows.column("skeleton")})

    def fit(rows: pa.Table) -> pa.Table:
        from vectide.llm.wrappers import host_wrapper as own

        parts = []
        for r in rows.to_pylist():
            shapes = [(x["shape"], x["pages"], json.loads(x["skeleton"])) for x in r["shapes"]]
            parts.append((shapes, {x["p"]: x["size"] for x in r["sizes"] or ()}, r["constant"] or []))
        return pa.table({"host": [rows.column("host")[0].as_py()], "wrapper": [json.dumps(own(parts))]})

    key = ["host", "template"]
    kinds = "host string, shape long, page long, skeleton string, texts array<struct<p:long,t:long,n:long,inside:boolean>>"
    found = pages.filter("html is not null").select("host", "html").mapInArrow(outlines, kinds)
    found = saved(found.groupBy("host", "shape", "page").agg(F.first("texts").alias("texts"), F.max("skeleton").alias("skeleton")))
    shapes = found.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.max("skeleton").alias("skeleton"))
    shapes = _templates(shapes, group)
    found = found.drop("skeleton").join(shapes.select("host", "shape", "template"), ["host", "shape"]).select(*key, "texts")

    counts = saved(found.select(*key, F.explode("texts").alias("x")).groupBy(*key, "x.p", "x.t").agg(F.count(F.lit(1)).alias("pages"), F.sum("x.n").alias("size")))
    paths = counts.groupBy(*key, "p").agg(F.max(F.when(F.col("t").isNull(), F.col("pages"))).alias("with_path"), F.sum("size").alias("whole"))
    enough = F.greatest(F.lit(float(LEAST_PAGES)), SHARE * F.col("with_path"))
    often = counts.filter((F.col("pages") >= LEAST_PAGES) & F.col("t").isNotNull()).join(paths.drop("whole"), [*key, "p"]).filter(F.col("pages") >= enough)
    often = saved(often.select(*key, "p", "t", "size", "with_path"))

    # of the frequent texts those on enough pages whose other texts outweigh the frequent ones
    lists = often.groupBy(*key).agg(F.collect_set("t").alias("often"))
    known = lambda x: F.coalesce(F.array_contains("often", x["t"]), F.lit(False))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    shown = found.join(lists, key).withColumn("every", total(F.col("texts"))).withColumn("texts", F.filter("texts", known))
    other = F.col("every") - total(F.col("texts"))
    shown = shown.withColumn("other", other).withColumn("texts", F.filter("texts", lambda x: F.col("other") >= F.when(x["inside"], DIFFERS_INSIDE).otherwise(DIFFERS) * F.col("every")))
    shown = shown.select(*key, F.explode("texts.t").alias("t")).groupBy(*key, "t").agg(F.count(F.lit(1)).alias("shown"))
    constant = saved(often.join(shown, [*key, "t"]).filter(F.col("shown") >= enough).select(*key, "p", "t", "size"))

    fixed = constant.groupBy(*key, "p").agg(F.sum("size").alias("fixed"))
    sizes = paths.join(fixed, [*key, "p"], "left").select(*key, F.struct("p", (F.col("whole") - F.coalesce("fixed", F.lit(0))).alias("size")).alias("x")).groupBy(*key).agg(F.collect_list("x").alias("sizes"))
    parts = shapes.groupBy(*key).agg(F.collect_list(F.struct("shape", "pages", "skeleton")).alias("shapes"))
    parts = parts.join(sizes, key, "left").join(constant.groupBy(*key).agg(F.collect_list("t").alias("constant")), key, "left")
    return parts.groupBy("host").applyInArrow(fit, "host string, wrapper string")


def _templates(shapes: DataFrame, group) -> DataFrame:  # noqa: ANN001
    """shapes: host, shape, pages, skeleton. Adds template. Shapes of a host meet in parts of about ``SHAPES_PER_TASK``; then the parts' leading shapes meet."""
    kinds = "host string, shape long, template long, pages long, skeleton string"
    shapes = saved(shapes)
    parts = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHAPES_PER_TASK).alias("parts"))
    dealt = shapes.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.col("parts"))).drop("parts")
    first = dealt.groupBy("host", "part").applyInArrow(group, kinds)
    if parts.filter("parts > 1").isEmpty():
        return saved(first)
    first = saved(first)
    leaders = first.groupBy("host", "template").agg(F.sum("pages").alias("pages")).select("host", F.col("template").alias("shape"), "pages").join(shapes.select("host", "shape", "skeleton"), ["host", "shape"])
    merged = leaders.groupBy("host").applyInArrow(group, kinds).select("host", F.col("shape").alias("template"), F.col("template").alias("merged"))
    return saved(first.join(merged, ["host", "template"]).select("host", "shape", F.col("merged").alias("template"), "pages", "skeleton"))


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(F.col(ident(id_col)).alias("page_id"), F.col(ident(url_col)).alias("url"), F.col(ident(html_col)).alias("html"), host_of(F.col(ident(url_col))).alias("host"))
    wrappers = saved(host_wrappers(rows))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 32)).first()[0] or 0
    known = wrappers.select(F.col("host").alias("of"), "wrapper")
    rows = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "wrapper")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vectide.llm.wrappers import extract as own

        read: dict[str | None, dict] = {None: {}}
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                texts = []
                for page, w in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                    if w not in read:
                        if len(read) > 1000:
                            read = {None: {}}
                        read[w] = json.loads(w)
                    texts.append(own(page, read[w]) if page else "")
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
