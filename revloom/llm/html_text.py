"""Main text of web pages with site style trees.

A page becomes a tree of elements; a node is known by its path of tag and class names. The trees of a host
are merged: a node's *presentation* is its path, its *content* the text below it. Over the pages of the host,

* content importance is the entropy of the node's texts, to the base of the number of pages that have it:
  1 where every page says something else, 0 where all say the same;
* presentation importance is the entropy of the shapes (sequences of child paths) that occur there.

Both are taken relative to the entropy of whole pages, so copies of one page do not make it boilerplate. They are
multiplied by the node's *weight*, the mean over its pages of the largest weight of a block in it:

* ``main`` and a single ``article`` weigh 1; articles that repeat a path are cards and say nothing;
* what stands outside them weighs its share of the page's text: 1 on a page without them, little beside a long article,
  much when the body is a ``div`` beside a small article;
* menus, page headers, footers, asides, forms, hidden elements and code weigh 0;
* a noise word in a class or id is evidence only: the element weighs its share of the text times the share outside main,
  unless it holds ``main``, all articles of the page (with a share of ``THRESHOLD``) or, with no main text apart from
  it, most of the text.

A branch of low importance on its host is cut from each page of the host, in ``article`` and ``main`` too, and a block of
low weight from its own page, so hosts of one or two pages lose their menus as well. A page that would lose everything
keeps its main text, else what its own weights keep, else all but menus and code.

Hosts may be hot: statistics are counted per (host, node, text) and then per (host, node), and what a host cuts is
attached per salt, so no task gets a whole host.

Null html, and html without text, gives an empty text. Null urls form one host. Repeated rows give repeated
results. Pages are parsed in full length; other columns are ignored.
"""

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revloom.llm.words import text_of
from revloom.plans.runtime import Scratch
from revloom.plans.skew import attach

LEAST_PAGES = 4
THRESHOLD = 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([A-Za-z][^\s/>]*)[^>]*>"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_NAME = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math",
                 "xmp", "noembed", "noframes"))
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul caption optgroup option select").split())
# an opening tag ends an open element of these names
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option",
                   "optgroup", "legend"}
SCOPE = frozenset("table td th body html ul ol dl div article main section aside header footer nav form".split())
# weight 0 by element, ARIA role, or word of a class or id
NOISE_TAGS = frozenset((
    "nav footer aside form menu button select input dialog script style noscript template textarea title iframe "
    "svg math head object canvas audio video search datalist label xmp noembed noframes").split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar "
                        "toolbar alertdialog".split())
NOISE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav "
    "navbar navigation menu topbar breadcrumb breadcrumbs footer masthead sidebar sidenav aside widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription "
    "newsletter signup login share sharing social related recommended recommendations comment comments reply "
    "replies disqus respond pagination pager skip toolbar copyright disclaimer tracking hidden").split())
HEADER_WORDS = frozenset(("header",))
MAIN_TAGS = frozenset(("article", "main"))
# never text of a page, even where nothing else is left
BARE_TAGS = NOISE_TAGS - {"form", "aside", "label", "dialog", "search"}


_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)"


def host_of(url: str | None) -> str:
    m = re.match(_HOST, url or "")
    return m[1].lower() if m else ""


def _host(url: str):
    """SQL twin of :func:`host_of`."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _NAME.finditer(text)}


def _words(attrs: dict[str, str]) -> set[str]:
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}")
    return set(re.split(r"[^a-z]+", names.lower()))


class _Node:
    __slots__ = ("tag", "path", "parent", "main", "hard", "soft", "own", "noise", "bare", "chars")

    def __init__(self, tag, attrs, parent):
        shape = f"{tag}.{'.'.join(sorted(attrs.get('class', '').split()))}" if attrs.get("class") else tag
        self.tag, self.parent, self.chars = tag, parent, 0
        self.path = f"{parent.path}/{shape}" if parent else shape
        inside = bool(parent and (parent.main or parent.tag in MAIN_TAGS))
        self.main = bool(parent and parent.main) or tag in MAIN_TAGS or attrs.get("role") == "main"
        hard = self._is_hard(tag, attrs, inside)
        # a noise word is evidence only; a page is never noise as a whole
        self.soft = not hard and tag not in ("html", "body") and self._is_soft(tag, attrs, inside)
        self.own = hard or self.soft
        self.hard = hard or bool(parent and parent.hard)
        self.noise = self.own or bool(parent and parent.noise)
        self.bare = tag in BARE_TAGS or bool(parent and parent.bare)

    @staticmethod
    def _is_hard(tag, attrs, inside) -> bool:
        if tag in NOISE_TAGS or attrs.get("role") in NOISE_ROLES or "hidden" in attrs:
            return True
        if attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
            return True
        return tag == "header" and not inside

    @staticmethod
    def _is_soft(tag, attrs, inside) -> bool:
        words = _words(attrs)
        if words & NOISE_WORDS:
            return True
        plain = tag in MAIN_TAGS or tag in ("p", "h1", "h2", "h3")
        return not plain and not inside and bool(words & HEADER_WORDS)

    def line(self):
        """The node and its ancestors."""
        node = self
        while node:
            yield node
            node = node.parent


def _weighted(blocks: list, starts: list) -> list[tuple[str, str, float, bool, bool]]:
    """(path, text, weight, inside main, bare) of blocks (path, text, node); ``starts`` are the nodes that may hold main."""
    total = 0
    for _, text, node in blocks:
        if not (node and node.bare):
            total += len(text)
            for n in node.line() if node else ():
                n.chars += len(text)
    total = max(total, 1)
    # articles that repeat a path are cards
    plain = [n for n in starts if not n.hard and not n.soft]
    times: dict[str, int] = {}
    for n in plain:
        times[n.path] = times.get(n.path, 0) + 1
    sure = {id(n) for n in plain if n.tag != "article" or times[n.path] == 1}
    held: dict[int, list] = {}
    for n in plain:
        for above in n.line():
            held.setdefault(id(above), []).append(n)

    def is_noise(n) -> bool:
        below = held.get(id(n), ())
        around = {id(m) for m in n.line()}
        # a long advert beside an article stays one
        apart = any(id(m) in sure and id(m) not in around and m not in below for m in plain)
        if 2 * n.chars > total and not apart:
            return False
        if any(m.tag != "article" for m in below):
            return False
        return not (below and len(below) == len(plain) and n.chars >= THRESHOLD * total)

    noise: dict[int, float] = {}
    facts = []
    for path, text, node in blocks:
        share, main = 1.0, False
        for n in node.line() if node else ():
            if n.soft:
                if id(n) not in noise:
                    noise[id(n)] = n.chars / total if is_noise(n) else 1.0
                share = min(share, noise[id(n)])
            # an article that is most of the page is main, whatever its class
            main = main or id(n) in sure or n.soft and n.tag in MAIN_TAGS and 2 * n.chars > total
        facts.append((path, text, share, main, bool(node and node.hard), bool(node and node.bare)))
    clean = [(len(text), main) for _, text, share, main, hard, _ in facts if share == 1.0 and not hard]
    outside = sum(n for n, main in clean if not main) / max(sum(n for n, _ in clean), 1) if clean else 1.0
    if not any(main for _, main in clean):
        outside = 1.0
    return [(path, text, 0.0 if hard else share * (1.0 if main and share == 1.0 else outside), main and share == 1.0, bare)
            for path, text, share, main, hard, bare in facts]


def page_blocks(source: str | None) -> list[tuple[str, str, float, bool, bool]]:
    """(path, text, weight, inside main, in a menu or code) of every block of a page in order."""
    source = source or ""
    stack: list[_Node] = []
    blocks: list[tuple[str, str, _Node | None]] = []
    starts: list[_Node] = []
    parts: list[str] = []

    def flush():
        # a reference may not span a tag, so each piece of text is decoded by itself
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            # the block's node: inline elements do not count
            node = next((n for n in reversed(stack) if n.tag in BLOCKS or n.own), None)
            blocks.append((node.path if node else "", text, stack[-1] if stack else None))

    def close(names, limit):
        """End the nearest open element of these names, unless a limiting element stands before it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                flush()
                del stack[k:]
                return
            if stack[k].tag in limit:
                return

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            parts.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(source[at:m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                parts.append(" ")
            elif any(n.tag == tag for n in stack):
                was_noise = stack[-1].noise
                cut = max(k for k, n in enumerate(stack) if n.tag == tag)
                if tag in BLOCKS or any(n.tag in BLOCKS for n in stack[cut:]):
                    # an inline end tag does not end blocks that stand inside it
                    if tag in BLOCKS:
                        flush()
                        del stack[cut:]
                else:
                    if was_noise != (stack[cut - 1].noise if cut else False):
                        flush()
                    del stack[cut:]
            elif tag == "p":
                flush()
        elif m[2]:
            tag = m[2].lower()
            attrs = _attributes(m[3]) if m[3].strip(" /") else {}
            if tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
                continue
            if tag in ENDS_P:
                close({"p"}, SCOPE)
            if tag in CLOSES:
                close(CLOSES[tag], {"ul", "ol", "table", "dl", "select"})
            if tag in BLOCKS:
                flush()
            if tag in VOID:
                continue
            if tag in RAW:
                # no tags inside; the text is code or a title
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(source, at)
                at = stop.start() if stop else end
                shut = source.find(">", at)
                at = shut + 1 if stop and shut >= 0 else end
                continue
            node = _Node(tag, attrs, stack[-1] if stack else None)
            if node.noise and not (stack and stack[-1].noise):
                flush()
            stack.append(node)
            if node.main and not (node.parent and node.parent.main and tag not in MAIN_TAGS):
                starts.append(node)
    flush()
    return _weighted(blocks, starts)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _branches(path: str):
    """The path and its ancestors, body and html left out."""
    parts = path.split("/")
    for k in range(len(parts), 0, -1):
        if parts[k - 1] not in ("html", "body"):
            yield "/".join(parts[:k])


def _host_nodes(batches):
    """(host, node, content, shape, page, weight): nodes of each page, with hashes of their text, of the paths below
    them and of the page's text."""
    for batch in batches:
        rows = []
        for url, source in zip(text_of(batch, "url"), text_of(batch, "html")):
            host = host_of(url)
            below: dict[str, list] = {}
            blocks = page_blocks(source)
            for path, text, weight, _, _ in blocks:
                for branch in _branches(path):
                    below.setdefault(branch, []).append((path, text, weight))
            page = _hash("\n".join(b[1] for b in blocks))
            rows += [(host, _hash(branch), _hash("\n".join(t for _, t, _ in found)),
                      _hash("\n".join(p for p, _, _ in found)), page, max(w for _, _, w in found))
                     for branch, found in below.items()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (
                pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
            names=["host", "node", "content", "shape", "page", "weight"])


def kept_text(source: str | None, cut: frozenset) -> str:
    """Main text of a page, given the nodes that its host cuts."""
    blocks = page_blocks(source)
    kept = [text for path, text, weight, _, _ in blocks
            if weight >= THRESHOLD and not any(_hash(b) in cut for b in _branches(path))]
    # a page that would lose everything
    kept = kept or [text for _, text, weight, main, _ in blocks if main and weight > 0]
    kept = kept or [text for _, text, weight, _, _ in blocks if weight >= THRESHOLD]
    return "\n".join(kept or [text for _, text, _, _, bare in blocks if not bare])


def _extract(batches):
    for batch in batches:
        texts = [kept_text(source, frozenset(cut or ())) for source, cut in zip(
            text_of(batch, "html"), text_of(batch, "cut"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _entropy(rows: DataFrame, value: str) -> DataFrame:
    """(host, node, pages, entropy of ``value``), from counts of equal values."""
    counts = rows.groupBy("host", "node", value).agg(F.sum("n").alias("n"))
    total, inside = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    # -sum p log p = log N - sum n log n / N, to the base N
    return counts.groupBy("host", "node").agg(
        total.alias("pages"),
        F.when(total > 1, (F.log(total) - inside / total) / F.log(total)).otherwise(1.0).alias("e"))


def node_importance(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, node, pages, importance) of pages (url, html): the larger of content and presentation entropy, where
    presentation counts half, since a list of varying length may still say the same; relative to the entropy of the
    pages that have the node, and times its mean weight. The counts are settled: they are read four times, the pages
    are parsed once for them."""
    nodes = pages.select("url", "html").mapInArrow(
        _host_nodes, "host string, node long, content long, shape long, page long, weight double")
    counts = scratch.settle(nodes.groupBy("host", "node", "content", "shape", "page").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")))
    content = _entropy(counts, "content")
    shape = _entropy(counts, "shape").select("host", "node", F.col("e").alias("shape"))
    whole = _entropy(counts, "page").select("host", "node", F.col("e").alias("whole"))
    weight = counts.groupBy("host", "node").agg((F.sum("weight") / F.sum("n")).alias("weight"))
    varied = F.when(F.col("whole") > 1e-9, F.greatest("e", F.col("shape") / 2) / F.col("whole")).otherwise(1.0)
    return content.join(shape, ["host", "node"]).join(whole, ["host", "node"]).join(weight, ["host", "node"]).select(
        "host", "node", "pages", (F.least(varied, F.lit(1.0)) * F.col("weight")).alias("importance"))


def main_text(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Pages are parsed twice, for the statistics and for the text, so that no parsed copy of them is stored. What
    the hosts cut is settled when called; it is small, and the planner sees its size: either it goes to the pages
    or the pages are dealt by host and salt.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        rated = scratch.settle(node_importance(pages, scratch))
        low = scratch.settle(rated.filter(
            (F.col("importance") < threshold) & (F.col("pages") >= least_pages)).groupBy("host").agg(
            F.collect_set("node").alias("cut")), keep=True)
    # the host by the same rule as in the first pass
    own = pages.select("page_id", "url", "html", _host("url").alias("host"))
    joined = attach(own, low, ["host"], spread=["url", "page_id"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "cut").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars long")
