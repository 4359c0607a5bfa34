"""Main text of web pages by wrappers: union-free regular expressions of a host's token streams.

A page's block tags and texts are a stream of tokens. Streams of one host are aligned one after another; where they
differ, a group becomes optional (`?`), equal neighbours become a repeated group (`+`), and a text becomes a slot (`#`)
once two pages differ in it. What stays the same on all pages is template. The article is the group that holds most
of the slots' text outside links; a page is read through its host's wrapper. Nothing here recurses, so pages may nest
to any depth, and no group keeps more than WIDTH groups in it, so a wrapper doesn't grow with the pages.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Tags of HTML, and words of class, id and role names that say what a group is.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = set("head script style title noscript template iframe svg canvas audio video select textarea option".split())
SKIPPED = UNSEEN | set("button dialog nav aside footer form menu fieldset".split())
SKIPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login comment comments reply replies respond disqus "
    "popup modal pagination pager toolbar complementary contentinfo".split()
)
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table select".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | set("# p blockquote pre ul ol dl table".split())

#: Groups that a group may hold before odd ones are folded together.
WIDTH = 64
#: A text is template if it is the same on all pages of its group, and these are so many at least.
TEMPLATE_PAGES = 5
#: How much more a slot's text counts towards the article within such a tag.
EVIDENCE = {"article": 8.0, "main": 4.0}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_REST = re.compile(r"[^<]+|<")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CASED = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """A block of a page; children are blocks, and texts as (text, characters in links)."""

    __slots__ = ("children", "key", "skip", "tag")

    def __init__(self, tag: str, key: str, skip: bool):
        self.tag, self.key, self.skip, self.children = tag, key, skip, []


def _named(tag: str, attrs: str) -> tuple[str, bool]:
    """The token of a start tag (digits in names as 0), and whether it is no part of an article."""
    if not attrs:
        return tag, tag in SKIPPED
    names, skip = [], tag in SKIPPED
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            skip = skip or tag != "math"
        elif value and name in ("class", "id", "role"):
            words = set(_SPLIT.split(_CASED.sub("-", value).lower()))
            skip |= bool(words & SKIPPED_WORDS) and tag not in ("body", "html", "article", "main")
            names.append(re.sub(r"\d+", "0", " ".join(sorted(value.lower().split()))))
        elif value:
            names.append(value.lower())
    return f"{tag}.{'.'.join(names)}" if names else tag, skip


class _Page:
    """The parser's state: open tags as (tag, block or None where nothing is kept, within a link), and the open text."""

    def __init__(self):
        self.root = Node("", "", False)
        self.stack = [("", self.root, False)]
        #: Places in the stack of the open tags by name, of all that end inline tags, and of lists.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.lists: list[int] = []
        self.run: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        block = self.stack[-1][1]
        if self.run and block is not None and (text := " ".join(html.unescape("".join(self.run)).split())):
            block.children.append((text, min(self.linked, len(text))))
        if block is not None:
            self.run.clear()
            self.linked = 0

    def push(self, tag: str, block: Node | None, link: bool) -> None:
        for places in (self.open[tag], *self._kinds(tag)):
            places.append(len(self.stack))
        self.stack.append((tag, block, link))

    def _kinds(self, tag: str) -> Iterator[list[int]]:
        if tag not in INLINE:
            yield self.blocks
        if tag in LISTS:
            yield self.lists

    def close(self, tags: set[str], stops: list[int]) -> None:
        """Closes the innermost of the tags, if it is open and none of the tags at the places `stops` is further in."""
        at = max((self.open[t][-1] for t in tags if self.open[t]), default=0)
        if not at or stops and stops[-1] > at:
            return
        if self.stack[at][0] not in INLINE and self.stack[-1][1] is not None:
            self.flush()
        for gone, *_ in self.stack[at:]:
            for places in (self.open[gone], *self._kinds(gone)):
                places.pop()
        del self.stack[at:]


def parse(page: str | None) -> Node:
    """The page's blocks, nested; unclosed and misplaced tags are closed as browsers do, more or less."""
    text = page or ""
    p = _Page()
    at, n, last = 0, len(text), text.rfind(">")
    while at < n:
        # Beyond the last tag's end there is text alone, and no tag is looked for.
        m = _TOKEN.match(text, at) if at <= last or text.startswith(("<!--", "<![CDATA["), at) else _REST.match(text, at)
        at = m.end()
        tag = m.re is _TOKEN and (m[2] or m[5])
        _, block, link = p.stack[-1]
        if not tag:
            data = m[0]
            if data.startswith("<![CDATA["):
                data = html.escape(data[9:].removesuffix("]]>"), quote=False)
            elif data[0] == "<" and len(data) > 1:
                continue
            if block is not None:
                p.run.append(data)
                p.linked += len(data.strip()) * link
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            p.close({tag}, p.blocks if tag in INLINE else [])
            continue
        if tag in ENDS_P:
            p.close({"p"}, p.blocks)
        elif tag in SIBLINGS:
            p.close(SIBLINGS[tag], p.lists)
        _, block, link = p.stack[-1]
        attrs = m[3] or m[6] or ""
        key, skip = _named(tag, attrs)
        inner = block
        if block is not None and tag in INLINE:
            inner = None if skip else block
            if tag == "br":
                p.run.append(" ")
        elif block is not None and not (skip and tag in UNSEEN):
            p.flush()
            inner = Node(tag, key, skip)
            block.children.append(inner)
            inner = None if skip else inner
        elif skip:
            inner = None
        if tag in RAW:
            at = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(text, at).end()
        elif tag not in VOID and not attrs.endswith("/"):
            p.push(tag, inner, link or tag == "a")
    p.flush()
    while len(p.stack) > 1 and p.stack[-1][1] is None:
        p.stack.pop()
    p.flush()
    return p.root


class Group:
    """A group of a wrapper.

    token: `#` for texts, else a tag with its names (after ! if it is no part of an article); pages: pages that have
    it, fewer than its parent's where it is optional; many: whether it is repeated; chars and linked: characters of
    texts, and of those in links; text: a text's hash while all pages agree in it, None for slots.
    """

    __slots__ = ("chars", "children", "linked", "many", "pages", "text", "token")

    def __init__(self, token: str, pages: int = 1, many: bool = False, chars: int = 0, linked: int = 0, text: int | None = None):
        self.token, self.pages, self.many, self.chars, self.linked, self.text, self.children = token, pages, many, chars, linked, text, []

    def row(self) -> list:
        return [self.token, self.pages, int(self.many), self.chars, self.linked, self.text]

    def tag(self) -> str:
        return self.token.split(".")[0]

    def preorder(self) -> Iterator[tuple[int, Group]]:
        todo = [(0, self)]
        while todo:
            depth, g = todo.pop()
            yield depth, g
            todo += [(depth + 1, c) for c in reversed(g.children)]


def _token(node: Node) -> str:
    return f"!{node.key}" if node.skip else node.key


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) >> 1


def expression(node: Node) -> Group:
    """The wrapper of one page (or of a part of it)."""
    top = Group(_token(node))
    todo, order = [(node, top)], []
    while todo:
        of, group = todo.pop()
        order.append(group)
        for c in of.children:
            if isinstance(c, tuple):
                group.children.append(Group("#", chars=len(c[0]), linked=c[1], text=_hash(c[0])))
            else:
                group.children.append(Group(_token(c)))
                todo.append((c, group.children[-1]))
    for group in reversed(order):
        if len(group.children) > 1:
            _work([(group, group.children)])
    return top


def merge(a: Group, b: Group) -> Group:
    """Aligns b, of other pages, with a, which becomes the wrapper of both.

    Equal tokens are aligned, others become optional groups in the order of the streams, equal neighbours a repeated
    group.
    """
    _work([(a, b, False)])
    return a


def _work(todo: list[tuple]) -> None:
    """Does alignments (a, b, whether both are of the same pages) and foldings (group, children), the last one first.

    A folding is put below the alignments of the children, so it finds them done.
    """
    while todo:
        task = todo.pop()
        if len(task) == 2:
            group, children = task
            group.children, like = _folded(children)
            todo += [(x, y, True) for x, y in reversed(like)]
            continue
        a, b, same = task
        a.pages = max(a.pages, b.pages) if same else a.pages + b.pages
        a.many |= b.many or (same and a.token != "#")
        a.chars += b.chars
        a.linked += b.linked
        if a.text != b.text:
            a.text = None
        left, right = [c.token for c in a.children], [c.token for c in b.children]
        if left == right:
            todo += [(x, y, same) for x, y in zip(a.children, b.children)]
            continue
        children, pairs = [], []
        for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
            children += a.children[i:j]
            if kind == "equal":
                pairs += [(x, y, same) for x, y in zip(a.children[i:j], b.children[k:m])]
            else:
                children += b.children[k:m]
        todo.append((a, children))
        todo += pairs


def _folded(children: list[Group]) -> tuple[list[Group], list[tuple[Group, Group]]]:
    """The children that stay, and pairs of which the second becomes part of the first.

    Equal neighbours are folded; beyond WIDTH, names are given up first, then the order, then tags.
    """
    like: list[tuple[Group, Group]] = []

    def gathered(items: list[Group], anywhere: bool) -> list[Group]:
        out: list[Group] = []
        where: dict[str, Group] = {}
        for c in items:
            first = where.get(c.token) if anywhere else out[-1] if out and out[-1].token == c.token else None
            if first is None:
                out.append(c)
                where[c.token] = c
            else:
                like.append((first, c))
        return out

    out = gathered(children, False)
    for give_up in ("names", "order", "tags"):
        if len(out) <= WIDTH:
            break
        if give_up != "order":
            for c in out:
                if c.token != "#":
                    c.token = c.tag() if give_up == "names" else "!*" if c.token[0] == "!" else "*"
        out = gathered(out, give_up != "names")
    return out, like


def dumped(wrapper: Group) -> str:
    """The wrapper as JSON: its groups in preorder, each with its depth."""
    return json.dumps([[depth, *g.row()] for depth, g in wrapper.preorder()])


def loaded(text: str) -> Group:
    above: list[Group] = []
    for depth, token, pages, many, chars, linked, hashed in json.loads(text):
        g = Group(token, pages, bool(many), chars, linked, hashed)
        del above[depth:]
        if above:
            above[-1].children.append(g)
        above.append(g)
    return above[0]


def shown(wrapper: Group) -> str:
    """The union-free regular expression as text; template texts are shown as `=`."""
    out: list[str] = []
    todo: list = [(wrapper, wrapper.pages)]
    while todo:
        g = todo.pop()
        if isinstance(g, str):
            out.append(g)
            continue
        g, pages = g
        mark = "+" * g.many + "?" * (g.pages < pages)
        inner = ["#" if g.text is None else "="] if g.token == "#" else [f"<{g.token}>", *((c, g.pages) for c in g.children), f"</{g.token}>"]
        todo += reversed(["(", *inner, f"){mark}"] if mark else inner)
    return "".join(out)


def rule(wrapper: Group) -> dict:
    """How pages of this wrapper are read: path (tokens down to the article's group), and template texts below it.

    From the root down, the group with most of the article's text is taken: characters of slots outside links, which
    count more within tags of EVIDENCE. It ends where no group holds 60 % of the page's, beside slots of paragraphs or
    headings (below the body), at a repeated or a text's own group, or at an `article`. Texts that stay the same on all
    of TEMPLATE_PAGES pages or more count only where nothing varies, and are left out of the article (headings are not)
    as hashes of their place and text.
    """
    groups = [g for _, g in wrapper.preorder()]
    varies = any(g.token == "#" and _slot(g) and g.chars > g.linked for g in groups)
    weight, mass = {id(wrapper): 1.0}, dict.fromkeys(map(id, groups), 0.0)
    for g in groups:
        for c in g.children:
            weight[id(c)] = 0.0 if c.token[0] == "!" else max(weight[id(g)], EVIDENCE.get(c.tag(), 0.0)) if weight[id(g)] else 0.0
    for g in reversed(groups):
        if g.token == "#":
            mass[id(g)] = weight[id(g)] * (g.chars - g.linked) * (_slot(g) or not varies)
        else:
            mass[id(g)] = sum(mass[id(c)] for c in g.children)
    path, at = [], wrapper
    while at.tag() != "article":
        top = max((c for c in at.children if c.token != "#" and c.tag() != "header"), key=lambda c: mass[id(c)], default=None)
        if top is None or mass[id(top)] <= 0 or mass[id(top)] < 0.6 * mass[id(wrapper)]:
            break
        if top.tag() not in EVIDENCE and (top.many or top.tag() in ENDS_P - {"div", "section", "table"} or at.tag() not in ("", "html", "body") and any(mass[id(c)] for c in at.children if c.tag() in TEXTS)):
            break
        path.append(top.token)
        at = top
    template, todo = [], [(at, 0)]
    while todo and varies:
        g, place = todo.pop()
        for c in g.children:
            if c.token == "#":
                if not _slot(c) and g.tag() not in HEADINGS:
                    template.append(_hash(place, c.text))
            elif c.token[0] != "!":
                todo.append((c, _hash(place, c.token)))
    return {"path": path, "template": sorted(template)}


def _slot(g: Group) -> bool:
    return g.text is None or g.pages < TEMPLATE_PAGES


def blocks(node: Node, inside: bool, template: set[int]) -> list[str]:
    """Texts of the blocks below the node in page order; skipped groups, template texts and, outside articles, page headers left out."""
    out: list[str] = []
    todo: list = [(node, 0)]
    while todo:
        c, place = todo.pop()
        if isinstance(c, tuple):
            if not template or _hash(place, _hash(c[0])) not in template:
                out.append(c[0])
        elif c is node or not (c.skip or (not inside and c.tag == "header")):
            if template and c is not node:
                place = _hash(place, c.key)
            todo += [(x, place) for x in reversed(c.children)]
    return out


def extract(page: str | None, path: list[str] | None, template=()) -> str:
    """The main text of one page by the rule of its host's wrapper; by its own wrapper where the path leads nowhere."""
    root = parse(page)
    nodes = _found(root, path) if path is not None else []
    texts = _texts(nodes, path, set(template)) if nodes else []
    if not texts:
        path = rule(expression(root))["path"]
        texts = _texts(_found(root, path), path, set())
    return "\n\n".join(texts)


def _found(root: Node, path: list[str]) -> list[Node]:
    nodes = [root]
    for token in path:
        nodes = [c for n in nodes for c in n.children if not isinstance(c, tuple) and not c.skip and (token in (c.key, c.tag, "*"))]
    return nodes


def _texts(nodes: list[Node], path: list[str], template: set[int]) -> list[str]:
    inside = bool(path) and path[-1].split(".")[0] in EVIDENCE
    return [b for n in nodes for b in blocks(n, inside, template)]


def host_of(url: str) -> F.col:
    """Lower-case host of a URL column; the empty host for null and odd URLs."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html", fan_in: int = 32) -> DataFrame:
    """(host, wrapper as JSON, path, template): one wrapper per host, of all its pages.

    Pages are merged within a task first (one partial wrapper per host and 4,096 pages), then `fan_in` partial wrappers
    of a host at a time, level by level, so that a hot host never ends in one task. Which streams are aligned first
    depends on how the pages lie in tasks; the article's group follows from sums that don't. Pages without a usable URL
    have no wrapper.
    """

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Group] = {}
        seen = 0

        def out() -> pd.DataFrame:
            rows = [(h, dumped(w)) for h, w in sorted(held.items())]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "wrapper"])

        for part in batches:
            for host, text in zip(part["host"], part["html"]):
                w = expression(parse(text))
                held[host] = merge(held[host], w) if host in held else w
                seen += 1
            if seen >= 4096:
                yield out()
                seen = 0
        if held:
            yield out()

    def together(group: pd.DataFrame) -> pd.DataFrame:
        items = sorted(group["wrapper"])
        first = loaded(items[0])
        for w in items[1:]:
            merge(first, loaded(w))
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [dumped(first)]})

    def final(group: pd.DataFrame) -> pd.DataFrame:
        one = together(group)
        found = rule(loaded(one["wrapper"].iloc[0]))
        return one.assign(path=[found["path"]], template=[found["template"]])

    rows = pages.select(host_of(url).alias("host"), F.col(page).alias("html")).where("host <> ''")
    parts = written(rows.mapInPandas(within, "host string, wrapper string"), "partial_wrappers")
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // fan_in)
    while salts > 1:
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInPandas(together, "host string, wrapper string")
        salts = -(-salts // fan_in)
    return parts.groupBy("host").applyInPandas(final, "host string, wrapper string, path array<string>, template array<bigint>")


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", broadcast_bytes: int = 16_000_000) -> DataFrame:
    """One row per page: id_col, url, text (blocks joined by two \\n, empty if none), n_chars (code points).

    Null and empty pages have an empty text; pages without a usable URL are read by their own wrapper; repeated rows
    stay; an empty table gives an empty result; other columns are not returned. The rules of all hosts are broadcast up
    to broadcast_bytes, else joined by host.
    """
    rules = written(infer_wrappers(pages, url, page), "wrappers").select(F.col("host"), F.struct("path", "template").alias("rule"))
    size = F.length("host") + F.length(F.concat_ws(",", "rule.path")) + 8 * F.size("rule.template") + 64
    few = (rules.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(page).alias("_html"), host_of(url).alias("host"))
    rows = rows.join(F.broadcast(rules) if few else rules, "host", "left")

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths, templates in batches:
            yield pd.Series([extract(t, None if p is None else list(p), () if s is None else s) for t, p, s in zip(texts, paths, templates)], dtype=object)

    out = rows.select(F.col("_id").alias(id_col), F.col("_url").alias(url), text("_html", "rule.path", "rule.template").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
