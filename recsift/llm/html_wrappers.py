"""Main-text extraction by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and texts.  A wrapper is a union-free expression over such
streams: tags, constant texts, text slots, optional groups ``( )?`` and repeated groups
``( )+``.  It is inferred by alignment:

- runs of the same element inside one page are folded into a repeated group, whose body is
  the alignment of all members;
- two expressions are aligned along their tags (longest common subsequence of the groups on
  each level).  Text against other text becomes a slot; a group that only one side has
  becomes optional; groups on both sides are aligned inside.  (A constant member of a repeated group
  is one of its members, not template text.)

Alignment has no order, so every task aligns the pages of a host that it holds, and the
partial wrappers of a host (one per task) are aligned afterwards.  Every distinct page of a
host takes part once, however often its row is repeated; a host with a third of all pages
costs one partial wrapper per task.

The wrapper tells what varies.  Its content region is the article or main element where it
has one, else the deepest group that holds most of the characters in text slots.  Left out
are elements that are never content (navigation, headers, footers, asides, forms, scripts,
styles ...), groups whose class or id says so (menus, adverts, notices, comments ...), and,
where the region was found by slots alone, texts that are constant over several pages of
different content.  Where such texts are most of the host's text, its pages are near copies
and none counts as constant; one that is most of a page's text stays in that page.
Wrappers are joined to the pages by host, as a broadcast while their checked size allows.

Text: blocks in page order joined by newlines, white space inside a block as one space,
character references decoded.

Defined cases: null and empty html give an empty text; a page without url or host belongs
to the empty host; a page whose host's wrapper names a region that the page lacks falls
back to its own structure; unclosed and stray tags are closed where their parent ends;
repeated rows are extracted each on their own; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsift.session import materialize
from recsift.sources.tables import read_table

#: Tokens of a page up to its last ">".  Repeats are possessive, so no place is read again when a tag fails; a
#: raw element or comment that never ends takes the rest (group "cut").
_TOKEN = (r"<!--.*?(?:-->|(?P<cut1>\Z))"
          r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|math|object)\b[^>]*+(?:(?<=/)>|>.*?(?:</(?P=raw)\s*+>|(?P<cut2>\Z)))"
          r"|<[!?][^>]*+>|</(?P<close>[a-zA-Z][^\s/>]*+)[^>]*+>|<(?P<open>[a-zA-Z][^\s/>]*+)(?P<marks>%s)>"
          r"|(?P<broken><[a-zA-Z])|</[^>]*+>|(?P<text>[^<]++|<)")
TOKEN = re.compile(_TOKEN % r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", re.S | re.I)
#: the same where a quote of a tag never ends: tags end at their first ">"
UNQUOTED = re.compile(_TOKEN % "[^>]*+", re.S | re.I)
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that are part of a line; all others begin and end a block
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img".split())
#: a new one of these ends an open one of the same set
PARAGRAPH_ENDS = frozenset("p div ul ol li dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 pre "
                           "blockquote hr figure address fieldset".split())
NEVER = frozenset("head title nav header footer aside form script style noscript template button select menu dialog iframe svg "
                  "object input textarea".split())
SAYS = re.compile(r"(?<![a-z])(ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|login|masthead|"
                  r"menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo\w*|related|remarks?|repl(?:y|ies)|"
                  r"share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?![a-z])", re.I)
#: class and id words of content; no other words enter a label, so wrappers have few kinds of groups
CONTENT = re.compile(r"(?<![a-z])(article|body|content|entry|main|post|story|text)(?![a-z])", re.I)
#: pages of different content over which a text of the template is constant
CONSTANT_PAGES = 3
#: levels of a wrapper; what lies deeper is one text slot
DEPTH = 40
#: children of a group that are told apart by their order; more of them are told apart by label
KINDS = 64
#: partial wrappers kept in a task, and bytes up to which wrappers are broadcast
HOSTS_HELD, BROADCAST_BYTES = 500, 16 << 20
TEXT = "#"


# ---- pages -----------------------------------------------------------------------

class Node:
    """An element (``label`` tag and marks) with its children: elements and texts."""
    __slots__ = ("tag", "label", "children")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []


def tokens(page: str):
    """(tag that closes, tag that opens, its attributes, text) in page order, in time proportional to the page."""
    stop = page.rfind(">") + 1
    at, pattern, cut = 0, TOKEN, False
    while at < stop:
        for m in pattern.finditer(page, at, stop):
            if m["broken"] and pattern is TOKEN:
                at, pattern = m.start(), UNQUOTED
                break
            cut = m["cut1"] is not None or m["cut2"] is not None
            if m["close"] or m["open"] or m["text"] or m["broken"]:
                yield m["close"], m["open"], m["marks"], m["text"] or m["broken"]
        else:
            at = stop
    if not cut and stop < len(page):
        yield None, None, None, page[stop:].split("<!--", 1)[0]


def parse(page: str | None) -> Node:
    """The element tree of a page; broken nesting is closed, never dropped."""
    root = Node("", "")
    stack, block = [root], [0]  # block: for each open element, the nearest one at or above it that is no part of a line
    opens: dict[str, int] = {}

    def close_from(k: int) -> None:
        for n in stack[k:]:
            opens[n.tag] -= 1
        del stack[k:], block[k:]

    for close, opened, attributes, text in tokens(page or ""):
        if text:
            stack[-1].children.append(text)
        elif opened:
            tag = opened.lower()
            if tag in PARAGRAPH_ENDS and stack[block[-1]].tag == "p":
                # an open paragraph ends, with what is open inside it, unless a container was opened in it
                close_from(block[-1])
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
                close_from(len(stack) - 1)
            marks = " ".join(x for m in MARK.findall(attributes or "") for x in m if x)
            says = sorted({x.lower() for x in SAYS.findall(marks) + CONTENT.findall(marks)}) if marks else None
            node = Node(tag, f"{tag}.{' '.join(says)}" if says else tag)
            stack[-1].children.append(node)
            if tag not in VOID and not (attributes or "").endswith("/"):
                stack.append(node)
                block.append(block[-1] if tag in INLINE else len(stack) - 1)
                opens[tag] = opens.get(tag, 0) + 1
        elif close and opens.get(close.lower()):
            k, tag = len(stack) - 1, close.lower()
            while stack[k].tag != tag:
                k -= 1
            close_from(k)
    return root


def boilerplate(node: Node) -> bool:
    return node.tag in NEVER or ("." in node.label and node.tag not in ("html", "body", "article", "main")
                                 and bool(SAYS.search(node.label.split(".", 1)[1])))


# ---- wrappers --------------------------------------------------------------------
# A group: [label, how, children, pages, characters in slots]; ``how`` is "1", "?" or "+".
# A text: [TEXT, how, constant or None, pages, characters].
# Pages: the smallest ``CONSTANT_PAGES`` digests of the contents of the pages that have it.

def content_digest(root: Node) -> int:
    """Digest of a page's texts outside of boilerplate."""
    text = "\n".join(blocks(root, frozenset()))
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest())


def fold(node: Node, level: int = 0, page: int | None = None) -> list:
    """The expression of one page's element: equal neighbours become repeated groups."""
    if page is None:
        page = content_digest(node)
    if level == DEPTH:
        inside = sum(map(len, blocks(node, frozenset())))
        return [node.label, "1", [[TEXT, "1", None, [page], inside]] if inside else [], [page], inside]
    children: list = []
    chars = 0
    for c in node.children:
        if isinstance(c, str):
            value = " ".join(html.unescape(c).split())
            if not value:
                continue
            item = [TEXT, "1", value, [page], len(value)]
        else:
            item = fold(c, level + 1, page)
        chars += item[4]
        k = next((k for k in range(len(children) - 1, max(-1, len(children) - 4), -1) if children[k][0] == item[0]), None)
        if k is not None:
            children[k] = _repeated(children[k], item)
        else:
            children.append(item)
    return [node.label, "1", children if len(children) <= KINDS else _kinds(children), [page], chars]


def _repeated(a: list, b: list) -> list:
    merged = align(a, b)
    merged[1] = "+"
    return merged


def _kinds(children: list) -> list:
    """One group of each label, in the order of their first places."""
    out: dict = {}
    for c in children:
        out[c[0]] = _repeated(out[c[0]], c) if c[0] in out else c
    return list(out.values())


def _how(a: str, b: str) -> str:
    return "+" if "+" in (a, b) else "?" if "?" in (a, b) else "1"


def align(a: list, b: list) -> list:
    """The expression that covers both; they have the same label."""
    pages = a[3] if a[3] == b[3] else sorted({*a[3], *b[3]})[:CONSTANT_PAGES]
    if a[0] == TEXT:
        return [TEXT, _how(a[1], b[1]), a[2] if a[2] == b[2] else None, pages, a[4] + b[4]]
    x, y = a[2], b[2]
    n, m = len(x), len(y)
    if n * m > KINDS * KINDS:  # too many kinds of groups for their order to matter
        both, mine = {c[0]: c for c in _kinds(y)}, _kinds(x)
        out = [align(c, both.pop(c[0])) if c[0] in both else _optional(c) for c in mine] + [_optional(c) for c in both.values()]
        return [a[0], _how(a[1], b[1]), out, pages, a[4] + b[4]]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            out.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(x[i]))
            i += 1
        else:
            out.append(_optional(y[j]))
            j += 1
    return [a[0], _how(a[1], b[1]), _compact(out), pages, a[4] + b[4]]


def _optional(g: list) -> list:
    return [g[0], "?" if g[1] == "1" else g[1], *g[2:]]


def _compact(children: list) -> list:
    """Groups of the same label that ended up near each other become one repeated group, so that the
    size of an expression depends on the kinds of elements, not on the pages."""
    out: list = []
    for c in children:
        k = next((k for k in range(len(out) - 1, max(-1, len(out) - 4), -1) if out[k][0] == c[0]), None)
        if k is None:
            out.append(c)
        else:
            out[k] = _repeated(out[k], c)
    return out


def expression(g: list) -> str:
    """The wrapper in regular-expression form."""
    if g[0] == TEXT:
        body = "#text" if g[2] is None else html.escape(g[2][:40])
    else:
        body = f"<{g[0]}>" + "".join(map(expression, g[2])) + f"</{g[0].split('.')[0]}>"
    return body if g[1] == "1" else f"({body}){g[1]}"


def _probe(g: list) -> Node:
    return Node(g[0].split(".")[0], g[0])


def region(wrapper: list) -> dict:
    """{path: labels down to the content region, constant: texts that are part of the template}."""
    found: list = []

    def repeated(g) -> bool:
        return g[2] is not None and len(g[3]) >= CONSTANT_PAGES

    def chars(g, of) -> int:
        if g[0] == TEXT:
            return g[4] if of(g) else 0
        return 0 if boilerplate(_probe(g)) else sum(chars(c, of) for c in g[2])

    # pages that have most of their text in common are near copies, not a template
    template = 2 * chars(wrapper, repeated) <= chars(wrapper, lambda g: True)

    def named(g, path):
        if g[0] == TEXT or (path and boilerplate(_probe(g))):
            return
        if g[0].split(".")[0] in ("article", "main") and slots(g):
            found.append(path + [g[0]])
            return
        for c in g[2]:
            named(c, path + [g[0]])

    def slots(g) -> int:
        return chars(g, lambda t: not (template and repeated(t)))

    named(wrapper, [])
    if found:
        return {"path": found[0][1:], "constant": []}
    path, at = [], wrapper
    while at[0] != TEXT:
        inner = [c for c in at[2] if c[0] != TEXT and c[0].split(".")[0] not in INLINE and c[1] != "+"
                 and slots(c) > 0.6 * max(1, slots(at))]
        if len(inner) != 1 or inner[0][0].split(".")[0] == "p":
            break
        at = inner[0]
        path.append(at[0])
    constant: list = []

    def texts(g):
        if g[0] == TEXT:
            if template and repeated(g):
                constant.append(g[2])
        else:
            for c in g[2]:
                texts(c)

    texts(at)
    return {"path": path, "constant": sorted(set(constant))}


# ---- extraction ------------------------------------------------------------------

def _at(root: Node, path: list[str]) -> list[Node]:
    now = [root]
    for label in path:
        now = [c for n in now for c in n.children if isinstance(c, Node) and c.label == label]
    return now


def blocks(node: Node, constant: frozenset) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush():
        value = " ".join(html.unescape("".join(line)).split())
        if value and value not in constant:
            out.append(value)
        line.clear()

    # a stack of its own: nesting may be deeper than Python's
    todo: list = [node]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            line.append(c)
        elif c is node or not boilerplate(c):
            if c.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(c.children))
        elif c.tag not in INLINE:
            flush()
    flush()
    return out


def extract(page: str | None, found: dict | None) -> str:
    root = parse(page)
    if found is None or not (nodes := _at(root, found["path"])):
        found = region(fold(root))
        nodes = _at(root, found["path"])
    out = [b for n in nodes for b in blocks(n, frozenset())]
    if found["constant"]:
        constant, most = frozenset(found["constant"]), sum(map(len, out)) / 2
        out = [b for b in out if b not in constant or len(b) > most]
    return "\n".join(out)


# ---- tables ----------------------------------------------------------------------

def host_column(url: Column) -> Column:
    """Host of a url in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _distinct_pages(batches):
    """Each page of a host once per task, so that copies are not dealt to one task."""
    seen = set()
    for pdf in batches:
        new = []
        for host, key in zip(pdf["host"], pdf["key"], strict=True):
            new.append((host, key) not in seen)
            seen.add((host, key))
        yield pdf[new]


def _align_pages(batches):
    """Partial wrappers: one per host and task (more where a task holds very many hosts)."""
    held: dict[str, list] = {}

    def out():
        rows = pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})
        held.clear()
        return rows

    for pdf in _distinct_pages(batches):
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            w = fold(parse(page))
            held[host] = align(held[host], w) if host in held else w
            if len(held) >= HOSTS_HELD:
                yield out()
    if held:  # a task may have no pages
        yield out()


def _align_partials(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for w in map(json.loads, sorted(pdf["wrapper"])):
        whole = w if whole is None else align(whole, w)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(whole)]})


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host and wrapper (JSON) of every host."""
    rows = pages.select(host_column(F.col(url)).alias("host"), F.col(page).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)))
    # equal pages of a host come to one task, which takes them once
    once = rows.mapInPandas(_distinct_pages, rows.schema).repartition("host", "key")
    partial = once.mapInPandas(_align_pages, "host string, wrapper string") \
        .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = partial.groupBy("host", "part").applyInPandas(lambda pdf: _align_partials(pdf), "host string, wrapper string")
    return some.groupBy("host").applyInPandas(lambda pdf: _align_partials(pdf), "host string, wrapper string")


@F.pandas_udf(T.StringType())
def region_of(wrapper: pd.Series) -> pd.Series:
    return wrapper.map(lambda w: json.dumps(region(json.loads(w))))


@F.pandas_udf(T.StringType())
def extract_text(page: pd.Series, found: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for p, r in zip(page, found, strict=True):
        if r is not None and r not in known:
            known[r] = json.loads(r)
        out.append(extract(p, known.get(r)))
    return pd.Series(out, dtype=object)


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", page: str = "html") -> DataFrame:
    """``keep`` columns and the main text of every row."""
    regions = materialize(wrappers(pages, url, page).select("host", region_of("wrapper").alias("region")), "html-regions")
    size = regions.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("region")), F.lit(0))).first()[0]
    side = F.broadcast(regions) if size <= BROADCAST_BYTES else regions
    rows = pages.select(*keep, host_column(F.col(url)).alias("host"), F.col(page).alias("_html"))
    return rows.join(side, "host", "left").select(*keep, extract_text("_html", "region").alias("text"))


def op9_page_text(spark, sf_dir):
    """Main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op9_page_text": op9_page_text}
