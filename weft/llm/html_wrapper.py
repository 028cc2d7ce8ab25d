"""HTML extraction by wrapper induction over the pages of a host."""

from __future__ import annotations

import heapq
import html as htmllib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import checked, stored, tidy

#: HTML elements without content, those whose content is no markup, and those that are blocks of text.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"])
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul optgroup option".split()
)
#: Elements that are no text at all, by HTML's own rules.
NEVER = frozenset("head script style noscript template button select option input textarea iframe svg canvas object embed audio video title link meta".split())
#: Elements that stand beside a page's text, by HTML's own rules.
BESIDE = frozenset("nav header footer aside form dialog menu fieldset label".split())
#: Elements that HTML has for text; code points of theirs count PROSE times.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th caption figcaption summary address".split())
HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Words of a class, id or role that mark boilerplate where no other words but these and the neutral ones stand beside them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar "
    "footer bottombar copyright sidebar aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login searchbox comment comments commentlist disqus replies pagination pager toolbar "
    "complementary contentinfo skip disclaimer paywall".split()
)
NEUTRAL = frozenset("site page top bottom left right box area list section wrapper container block bar link links item items inner outer user reader form thread the my and js".split())
#: Elements that can hold a page's main text.
CONTAINER = frozenset(["#root", "html", "body", "div", "section", "center", "main", "article", "td", "table", "tbody", "tr"])
#: Elements whose names say nothing of what they are.
UNNAMED = frozenset(["html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"])
#: An open element that ends where one of these begins.
ENDS = {
    "p": BLOCK - frozenset(["html", "body", "head"]),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "head": frozenset(["body"]),
}
#: What an end tag or an implied end can't reach across.
FENCE = frozenset("table td th ul ol dl article section main aside nav header footer div blockquote form button object body html".split())
#: A node that fewer than one page in RARE has is no template.
RARE = 50
#: Neighbours with one mark are one run if their trees match by this share of their nodes.
ALIKE = 0.6
#: How many times a code point of a textual element, and one that no name tells to stand beside the text, counts.
PROSE = 4

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+)>|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAME = re.compile(r"[a-z]+|\d+")
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"[\s\xa0]+")


class Node:
    """An element: tag, its mark (tag with class and id), the words of its names, children (elements and pieces of text), and off: 2 if
    it is no text at all, 1 if its tag or names tell that it stands beside a text."""

    __slots__ = ("tag", "mark", "names", "kids", "up", "off")

    def __init__(self, tag: str, up: Node | None, mark: str = "", names: str = "", off: int = 0):
        self.tag, self.up, self.mark, self.names, self.off = tag, up, mark or tag, names, off
        self.kids: list[Node | str] = []


def parse(page: str) -> Node:
    """The tree of a page, with what is no text of it marked. Unclosed, misnested and unknown elements are mended as browsers
    roughly do; nothing raises."""
    root = node = Node("#root", None)
    named: list[Node] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            node.kids.append(page[at:])
            break
        if m.start() > at:
            node.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue  # a comment or declaration
        tag = m[2].lower()
        if m[1]:
            up = node
            while up.up and up.tag != tag:
                if up.tag in FENCE and tag not in FENCE:
                    break
                up = up.up
            if up.tag == tag and up.up:
                node = up.up
            continue
        if node.tag in ENDS or tag in ("li", "dt", "dd", "tr", "td", "th", "p") or tag in BLOCK:
            up = node
            while up.up and (up.tag not in FENCE or up.tag in ENDS):
                if tag in ENDS.get(up.tag, ()):
                    node = up.up
                    break
                up = up.up
        attrs: dict[str, str] = {}
        if m[3] and not m[3].isspace():
            for a in _ATTR.finditer(m[3]):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        names = " ".join([attrs[k] for k in ("class", "id", "role") if attrs.get(k)]).lower() if attrs else ""
        words = sorted({x for x in _NAME.findall(names) if not x.isdigit()}) if names else ()
        child = Node(tag, node, f"{tag}.{'.'.join(words)}" if words else tag, names)
        never = tag in NEVER or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        child.off = 2 if never else int(tag in BESIDE)
        node.kids.append(child)
        if names and not child.off and tag not in UNNAMED and telling(names):
            named.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            node = child
        elif tag not in VOID and tag in BLOCK:
            node = child  # <div/> opens a div
    if named:
        most = weight(root)
        for x in named:
            x.off = int(weight(x) * 2 < most)  # what holds most of the page is not beside its text
    return root


@lru_cache(maxsize=10_000)
def telling(names: str) -> bool:
    """Whether one of the names between blanks marks boilerplate: site-footer does, social-history doesn't."""
    for name in names.split():
        words = _WORD.findall(name)
        if any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in NEUTRAL or w.isdigit() for w in words):
            return True
    return False


def weight(node: Node) -> int:
    """Code points of text below node, without what is no text or beside it."""
    n, work = 0, [node]
    while work:
        for x in work.pop().kids:
            if isinstance(x, str):
                n += len(x)
            elif not x.off:
                work.append(x)
    return n


def own_text(node: Node, linked: list[int] | None = None) -> str:
    """The text of a block without that of the blocks in it; white space is one blank, ends are trimmed. linked gets the code points
    of each link."""
    out: list[str] = []
    work: list[Node | str] = list(reversed(node.kids))
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.off > 1 or x.tag in BLOCK:
            continue
        elif x.tag == "br":
            out.append(" ")
        else:
            if linked is not None and x.tag == "a":
                linked.append(len(own_text(x)))
            work += reversed(x.kids)
    return _SPACE.sub(" ", "".join(out)).strip()


def inner_blocks(node: Node) -> list[Node]:
    """The blocks directly in a block, those within its inline elements included."""
    out: list[Node] = []
    work: list[Node | str] = list(reversed(node.kids))
    while work:
        x = work.pop()
        if isinstance(x, str) or x.off > 1:
            continue
        if x.tag in BLOCK:
            out.append(x)
        else:
            work += reversed(x.kids)
    return out


def blocks(node: Node, template: dict[str, frozenset[int]] | None = None, beside: bool = False) -> list[str]:
    """The texts of the blocks below node in page order; white space is one blank, ends are trimmed.

    template: texts that go, as hashes by the marks from node down. beside: with what names tell to stand beside a text.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _SPACE.sub(" ", htmllib.unescape("".join(run)) if any("&" in r for r in run) else "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

    work: list[tuple[Node | str | None, str, bool]] = [(node, "", False)]
    while work:
        x, path, gone = work.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if not gone:
                run.append(x)
        elif x.off > beside and x is not node:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCK or x is node:
                flush()
                work.append((None, "", False))
                if template:
                    path = f"{path}/{x.mark}" if x is not node else ""
                    gone = path in template and hash_text(own_text(x)) in template[path]
            work += [(k, path, gone) for k in reversed(x.kids)]
    flush()
    return out


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else 0


class Part:
    """A node of a wrapper: its mark, the hash of its own text, pages, pages whose text differs from the first's, the weight of
    its own text over all pages, whether it is a run, the hashes of the run's texts while all pages agree, and its children."""

    __slots__ = ("mark", "text", "n", "v", "chars", "run", "texts", "kids")

    def __init__(self, mark: str, text: int, n: int, v: int, chars: int, run: int, texts: list[int], kids: list[Part]):
        self.mark, self.text, self.n, self.v, self.chars, self.run, self.texts, self.kids = mark, text, n, v, chars, run, texts, kids


def preorder(top: Part) -> list[tuple[int, Part]]:
    """All nodes with their depths, each before its children."""
    out, work = [], [(0, top)]
    while work:
        d, x = work.pop()
        out.append((d, x))
        work += [(d + 1, k) for k in reversed(x.kids)]
    return out


def skeleton(root: Node) -> Part:
    """The tree of a page's blocks, as a wrapper of one page. Neighbours with one mark whose trees are alike are one node, a run."""
    top = _part(root, root.off)
    work = [(root, top, root.off)]
    order: list[Part] = []
    while work:
        node, part, beside = work.pop()
        order.append(part)
        for x in inner_blocks(node):
            if x.tag != "hr":
                part.kids.append(_part(x, beside or x.off))
                work.append((x, part.kids[-1], beside or x.off))
    for part in reversed(order):  # children first
        if len({k.mark for k in part.kids}) < len(part.kids):
            kids = part.kids[:1]
            for k in part.kids[1:]:
                if kids[-1].mark == k.mark and alike(kids[-1], k):
                    kids[-1] = _same_page(kids[-1], k)
                else:
                    kids.append(k)
            part.kids = kids
    return top


def _part(node: Node, beside: int) -> Part:
    """A node of one page. Its weight: code points outside links, PROSE times each for an element that HTML has for text, and for one
    that nothing tells to stand beside it."""
    linked: list[int] = []
    text = own_text(node, linked)
    h = hash_text(text)
    w = max(0, len(text) - sum(linked)) * (PROSE if node.tag in TEXTUAL else 1) * (1 if beside else PROSE)
    return Part(node.mark, h, 1, 0, w, 0, [h] if h else [], [])


def _same_page(a: Part, b: Part) -> Part:
    """Two neighbours of one page as one node: their texts together are its text."""
    out = merge(a, b, one_page=True)
    out.run = 1
    return out


def alike(a: Part, b: Part) -> bool:
    """Whether simple tree matching pairs at least ALIKE of the nodes of both trees."""
    if not a.kids and not b.kids:
        return True
    size = len(preorder(a)) + len(preorder(b))
    return 2 * match(a, b)[id(a), id(b)][0] >= ALIKE * size


def match(a: Part, b: Part) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching of two nodes with one mark. For each pair of nodes that may be paired: the number of pairs in the largest
    order-keeping matching of their trees, and which children are paired. Without recursion: children's pairs come first."""
    found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    order, work = [], [(a, b)]
    while work:
        x, y = work.pop()
        order.append((x, y))
        if _plain(x, y):
            work += zip(x.kids, y.kids, strict=True)
        else:
            work += [(p, q) for p in x.kids for q in y.kids if p.mark == q.mark]
    for x, y in reversed(order):
        if _plain(x, y):  # the only largest matching
            found[id(x), id(y)] = 1 + sum([found[id(p), id(q)][0] for p, q in zip(x.kids, y.kids, strict=True)]), [(i, i) for i in range(len(x.kids))]
            continue
        wide = len(y.kids)
        best = [[0] * (wide + 1)]
        for p in x.kids:
            row, last = [0], best[-1]
            for j, q in enumerate(y.kids):
                w = found[id(p), id(q)][0] if p.mark == q.mark else 0
                row.append(max(last[j + 1], row[j], last[j] + w))
            best.append(row)
        pairs, i, j = [], len(x.kids), wide
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        found[id(x), id(y)] = 1 + best[-1][wide], pairs[::-1]
    return found


def _plain(x: Part, y: Part) -> bool:
    """Whether both have the same children's marks, each once."""
    marks = [k.mark for k in x.kids]
    return marks == [k.mark for k in y.kids] and len(set(marks)) == len(marks)


def merge(a: Part, b: Part, one_page: bool = False) -> Part:
    """The wrapper of both: matched nodes are one, the others are put in, in order. Of one page: what is joined are neighbours."""
    found = match(a, b)
    top = _joined(a, b, one_page)
    work = [(a, b, top)]
    while work:
        x, y, out = work.pop()
        i = j = 0
        for p, q in [*found[id(x), id(y)][1], (len(x.kids), len(y.kids))]:
            out.kids += x.kids[i:p] + y.kids[j:q]
            if p < len(x.kids):
                out.kids.append(_joined(x.kids[p], y.kids[q], one_page))
                work.append((x.kids[p], y.kids[q], out.kids[-1]))
            i, j = p + 1, q + 1
    return top


def _joined(a: Part, b: Part, one_page: bool) -> Part:
    if one_page:
        return Part(a.mark, (a.text * 31 + b.text) & 0xFFFFFFFF, 1, 0, a.chars + b.chars, a.run | b.run, a.texts + b.texts, [])
    v = a.v + b.v + (b.n - b.v if a.text != b.text else 0)
    return Part(a.mark, a.text, a.n + b.n, v, a.chars + b.chars, a.run | b.run, [] if v else a.texts, [])


def merged(parts: list[Part]) -> Part:
    """The wrapper of many: always the two of the fewest pages are merged. Nodes that fewer than one page in RARE of these has
    are no template and go."""
    heap = [(p.n, i, p) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    count = len(parts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        out = merge(a[2], b[2])
        least = out.n // RARE
        if least > 1:
            for _, x in preorder(out):
                x.kids = [k for k in x.kids if k.n >= least]
        heapq.heappush(heap, (out.n, count, out))
        count += 1
    return heap[0][2]


def to_json(top: Part) -> str:
    return json.dumps([[d, x.mark, x.text, x.n, x.v, x.chars, x.run, x.texts] for d, x in preorder(top)], separators=(",", ":"))


def from_json(text: str) -> Part:
    above: list[Part] = []
    for d, *fields in json.loads(text):
        x = Part(*fields, [])
        del above[d:]
        if above:
            above[-1].kids.append(x)
        above.append(x)
    return above[0]


def slots(top: Part) -> dict[int, int]:
    """For each node (by id) the weight below it in slots: nodes whose text varies between pages. Of a wrapper of one page,
    or of copies of one, all text is."""
    order = preorder(top)
    varies = any(x.v for _, x in order)
    found: dict[int, int] = {}
    for _, x in reversed(order):
        own = x.chars if not varies or x.n == 1 or x.v * 4 >= x.n else 0
        found[id(x)] = own + sum([found[id(k)] for k in x.kids])
    return found


def content(top: Part) -> dict:
    """path: the marks from the root to the node that holds the host's main text. among: by the place in path, where several neighbours
    have that mark, their trees and which of them it is. template: below it, the hashes of constant texts by the marks from there down.

    From the root down, the container with most weight in slots is entered while it holds 7 tenths of it. A run of like neighbours
    ends the search, for these are the text's blocks, and so does a varying heading beside the container, for it is the text's.
    Constant is what at least three pages, and half of those with the slot, have with one text, unless no text varies at all.
    """
    found, path, among = slots(top), [top.mark], {}
    varies = any(x.v for _, x in preorder(top))
    while found[id(top)]:
        down = [k for k in top.kids if not k.run and k.mark.split(".")[0] in CONTAINER and found[id(k)] * 10 >= found[id(top)] * 7]
        if not down or any(found[id(k)] and k.n * 2 >= top.n and k.mark.split(".")[0] in HEADING for k in top.kids):
            break
        like = [k for k in top.kids if k.mark == down[0].mark]
        top = down[0]
        if len(like) > 1:
            among[str(len(path))] = [[k is top for k in like].index(True), [[[d, x.mark] for d, x in preorder(k)] for k in like]]
        path.append(top.mark)
    template: dict[str, list[int]] = {}
    work = [(top, "")] if varies else []
    while work:
        x, at = work.pop()
        if x.n >= 3 and x.n * 2 >= top.n and x.v == 0 and x.texts:
            template.setdefault(at, []).extend(x.texts)
        work += [(k, f"{at}/{k.mark}") for k in x.kids]
    return {"path": path, "among": among, "template": template}


def shape(nodes: list[list]) -> Part:
    """A tree of marks alone, from its nodes in preorder with their depths."""
    above: list[Part] = []
    for d, mark in nodes:
        x = Part(mark, 0, 1, 0, 0, 0, [], [])
        del above[d:]
        if above:
            above[-1].kids.append(x)
        above.append(x)
    return above[0]


def find(root: Node, wrapper: dict) -> Node | None:
    """The page's node for the wrapper's path. Among children with one mark it is the one that simple tree matching pairs with the
    wrapper's node, where the wrapper has neighbours with that mark too; or else the one with most text."""
    node = root
    for i, mark in enumerate(wrapper["path"][1:], 1):
        some = [k for k in inner_blocks(node) if k.mark == mark]
        if not some:
            return None
        if str(i) in wrapper["among"]:
            at, trees = wrapper["among"][str(i)]
            ours, theirs = Part(mark, 0, 1, 0, 0, 0, [], [skeleton(k) for k in some]), Part(mark, 0, 1, 0, 0, 0, [], [shape(t) for t in trees])
            paired = [p for p, q in match(ours, theirs)[id(ours), id(theirs)][1] if q == at]
            if not paired:
                return None
            node = some[paired[0]]
        else:
            node = some[0] if len(some) == 1 else max(some, key=weight)
    return node


def main_text(root: Node, wrapper: dict | None) -> list[str]:
    """The blocks of the page's main text: those of the slot that the host's wrapper found, without the template's texts.

    A page that doesn't fit its host's wrapper is a host of its own: its slot is that of the wrapper of this page. Without any wrapper, all blocks of
    the page are its text.
    """
    if wrapper is None:
        return blocks(root, beside=True)
    slot = find(root, wrapper)
    if slot is None:
        alone = content(skeleton(root))
        return blocks(find(root, alone) or root)
    return blocks(slot, wrapper["template"]) or blocks(slot)


def host_of(url: str) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def induce(pages: DataFrame, url: str = "url", html: str = "html", each: int = 64, salts: int = 256) -> DataFrame:
    """(host, wrapper): one row for each host, its wrapper as JSON, induced from all its pages.

    Each task merges its pages' trees by host, so many at a time; what tasks found is merged in two steps, so a host with a third of
    all pages is merged by many tasks. What a wrapper holds is bounded by RARE times the nodes of a page.
    """

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list[Part]] = {}
        held = 0

        def rows(hosts: list[str]) -> pa.RecordBatch:
            out = [to_json(merged(trees.pop(h))) for h in hosts]
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.string())], ["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = trees.setdefault(host, [])
                own.append(skeleton(parse(page.as_py() or "")))
                if len(own) >= 2 * each:  # few wrappers of about as many pages each
                    own[-each:] = [merged(own[-each:])]
                held += 1
                if held >= 2000:
                    yield rows(list(trees))
                    held = 0
        yield rows(list(trees))

    def up(table):
        return pd.DataFrame({"host": [table.host.iloc[0]], "wrapper": [to_json(merged([from_json(w) for w in sorted(table.wrapper)]))]})

    parts = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(read, "host string, wrapper string")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    return parts.groupBy("host", "salt").applyInPandas(up, "host string, wrapper string").groupBy("host").applyInPandas(up, "host string, wrapper string")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text: the main text of each whole page, its blocks in page order joined by a line feed.

    A wrapper is induced for each host from all its pages: their trees of block elements are aligned by simple tree
    matching; nodes whose text is the same on all pages are template, those whose text varies are slots, and
    the node around most of their weight is where the main text is. A code point in a link has no weight; one in an element for text (p, h1, li ...) has PROSE
    times that of bare text, and one that a tag or whole names tell to stand beside the text has a PROSEth. Each page is then parsed again and aligned with the wrapper: the blocks of that node,
    without the template's texts and what its tags and names tell to stand beside them, are its text. Elements that are never text by HTML's rules don't take part. Character
    references are decoded, white space inside a block is one blank, ends are trimmed; nothing else is dropped or shortened.

    Null and empty pages have the empty text. A null address, or one without a host, belongs to the host without name. Repeated rows
    get the same text; an empty table gives an empty one; a column named text is replaced.
    """
    checked(pages, url, html)
    pages = pages.drop("text") if "text" not in (url, html) else pages

    def content_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(content(from_json(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["__weft_host", "__weft_path"])

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            out = []
            for page, found in zip(batch.column(at), batch.column(last).to_pylist(), strict=True):
                if found not in known:
                    if len(known) > 10_000:
                        known.clear()
                        known[None] = None
                    known[found] = json.loads(found)
                    known[found]["template"] = {k: frozenset(v) for k, v in known[found]["template"].items()}
                out.append("\n".join(main_text(parse(page.as_py() or ""), known[found])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(out, pa.string())], names)

    paths = stored(induce(pages, url, html).mapInArrow(content_of, "__weft_host string, __weft_path string"), "wrappers")
    joined = pages.withColumn("__weft_host", host_of(url)).join(paths, "__weft_host", "left").drop("__weft_host")
    at, last, names = pages.columns.index(html), len(pages.columns), [*pages.columns, "text"]
    return joined.mapInArrow(read, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())]))
