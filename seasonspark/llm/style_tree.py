"""Main text of pages by site style trees.

All pages of a host are merged into one tree whose nodes are paths of block elements. A node's presentation
importance is the entropy of the child sets its pages show, its content importance the entropy of its texts
against that of its parent's: a block that stays the same while the page around it varies is a template. Tags, class
names, the share of link text and of the host's text raise or lower a node's importance, none of them decides alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonspark.llm.scratch import Scratch

#: What HTML names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
NO_TEXT = frozenset("head script style noscript template textarea select option button svg iframe form input object canvas noembed noframes xmp title".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
FRAME_TAGS = frozenset("nav aside footer menu dialog".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
LANDMARKS = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
LISTS = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th figure caption hgroup".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer masthead topbar ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent notice notices gdpr popup modal overlay comment comments respond disqus discussion replies share sharing social related recommended newsletter subscribe subscription "
    "signup login widget toolbar pagination pager form search skip hidden".split()
)
#: Words of names that say nothing about what an element holds.
NEUTRAL_WORDS = frozenset("site page main box list area wrap wrapper container block section top bottom left right inner outer content item items bar links article articles post posts entry row col the and of for js".split())

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|$))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<(?:[!?]|/(?![a-zA-Z]))[^>]*>|<(?=[!?]|/?[a-zA-Z]).*""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+", re.I)
#: Least importance of a node that is kept; weight of content against presentation; pages by which evidence is shrunk.
LEAST, CONTENT, FEW = 0.3, 0.81, 4
#: What names and places add to or take from an importance of 0 to 1.
FRAME, NAMED, LANDMARK, IN_ARTICLE, LINKED, MASS = -1.0, -0.8, 0.5, 0.35, -0.9, 0.6
_MASK = (1 << 64) - 1


def _parse(tag: str, attributes: str) -> tuple[str, float, bool, bool]:
    """Name of an element in a path, share of noise words in its names, whether it frames the page, whether it is hidden."""
    names, words, hidden, role = set(), [], False, ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names.update(w.lower() for w in value.split())
            words += (_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", w)) for w in value.split())
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    share = 0.0
    for one in words:
        telling = [w for w in map(str.lower, one) if w not in NEUTRAL_WORDS]
        share = max(share, sum(w in NOISE_WORDS for w in telling) / len(telling) if telling else 0.0)
    name = ".".join([tag, *sorted({re.sub(r"\d+", "0", n) for n in names}), *([f"role={role}"] if role else [])])
    return name, share, tag in FRAME_TAGS or role in FRAME_ROLES, hidden


_parsed = lru_cache(4096)(_parse)


@lru_cache(65536)
def _path(up: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{up}/{name}")


def _prior(tag: str, share: float, frame: bool, inside: bool) -> float:
    """What an element's tag, names and place add to its importance; ``inside``: within an article or main element."""
    if tag in ("html", "body"):
        return LANDMARK
    if frame or (tag == "header" and not inside):  # a header within an article holds its title
        return FRAME
    if tag in LANDMARKS:
        return LANDMARK + NAMED * share
    if inside and (tag in PROSE or tag in INLINE):
        return IN_ARTICLE + NAMED / 2 * share
    return NAMED * share if share else IN_ARTICLE if inside and tag in LISTS else 0.0


class Element:
    """An open element; an inline one shares the path and node of the block around it."""

    __slots__ = ("tag", "up", "node", "path", "prior", "silent", "inside", "link", "noise", "digest", "chars", "links")

    def __init__(self, tag: str, up: Element | None, path: int, prior: float, silent: bool, inside: bool):
        self.tag, self.up, self.path, self.prior, self.silent, self.inside = tag, up, path, prior, silent, inside
        self.node = up.node if up is not None and tag in INLINE else self
        self.link = up is not None and (up.link or tag == "a")
        self.noise, self.digest, self.chars, self.links = False, 0, 0, 0


#: Path of a page's root.
ROOT = 0


def walk(html: str) -> Iterator[tuple[str, Element, str]]:
    """Events of a page: ``open`` with the element, ``text`` with its text, ``break`` between blocks."""
    stack, at, lower = [Element("", None, ROOT, LANDMARK, False, False)], 0, None
    while True:
        m = _TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            yield "text", stack[-1], html[at:end]
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            yield "break", stack[-1], ""
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        close = ("p",) if tag in CLOSES_P else SAME.get(tag, ())
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in close:
                    del stack[i:]
                    break
                if stack[i].tag in LIMITS.get(tag, ()) or (tag in CLOSES_P and stack[i].tag not in INLINE):
                    break
        # Long strings are read whole, but not remembered.
        name, share, frame, hidden = (_parsed if len(m[3]) < 500 else _parse)(tag, m[3].strip())
        up = stack[-1]
        path = up.path if tag in INLINE else _path(up.path, name)
        element = Element(tag, up, path, _prior(tag, share, frame, up.inside), up.silent or hidden or tag in NO_TEXT, up.inside or tag in LANDMARKS)
        yield "open", element, ""
        if tag in RAW:
            lower = lower or html.lower()
            stop = lower.find(f"</{tag}", at) if len(lower) == len(html) else re.compile(f"</{tag}", re.I).search(html, at)
            stop = stop if isinstance(stop, int) else stop.start() if stop else -1
            at = stop if stop >= 0 else len(html)
            continue_at = html.find(">", at)
            at = continue_at + 1 if continue_at >= 0 else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(element)


def nodes(html: str) -> dict[int, tuple[int, float, int, int, int, int]]:
    """For each path of a page: its parent's path, prior, hash of its children's paths, hash of its text, characters, those in links."""
    elements: list[Element] = []
    for kind, element, text in walk(html):
        if not elements:
            root = element
            while root.up is not None:
                root = root.up
            elements.append(root)
        if kind == "open":
            if element.node is element and not element.silent:
                elements.append(element)
        elif kind == "text" and not element.silent and (text := text.strip()):
            node = element.node
            node.digest = (node.digest * 31 + xxhash.xxh3_64_intdigest(text)) & _MASK
            node.chars += len(text)
            node.links += len(text) if element.link else 0
    children: dict[int, set[int]] = {}
    found: dict[int, list] = {}
    for e in reversed(elements):  # children come before their parents
        if e.up is not None:
            up = e.up.node
            up.digest = (up.digest * 31 + e.digest) & _MASK
            up.chars += e.chars
            up.links += e.links
            children.setdefault(up.path, set()).add(e.path)
        here = found.setdefault(e.path, [e.up.path if e.up is not None else ROOT, e.prior, 0, 0, 0])
        here[2] = (here[2] + (xxhash.xxh3_64_intdigest(e.digest.to_bytes(8, "little")) if e.chars else 0)) & _MASK
        here[3] += e.chars
        here[4] += e.links
    return {p: (up, prior, sum(children.get(p, ())) & _MASK, content, chars, links) for p, (up, prior, content, chars, links) in found.items()}


def named_noise(prior: float) -> bool:
    """The verdict of names alone, as on a page without a tree: even the highest importance is too low."""
    return 1 + prior < LEAST


def main_text(html: str, flips: frozenset[int] = frozenset()) -> str:
    """The page without noise: on the paths of ``flips`` the tree overrules what tags and names say."""
    blocks, runs = [], []

    def flush() -> None:
        text = " ".join("".join(runs).split())
        runs.clear()
        if text:
            blocks.append(text)

    for kind, element, value in walk(html):
        if kind == "open":
            flipped = element.node is element and element.path in flips
            element.noise = element.up.noise or element.silent or named_noise(element.prior) != flipped
        elif kind == "text" and not element.noise:
            runs.append(unescape(value))
        elif kind == "break":
            flush()
    flush()
    return " ".join(blocks)


_NODES = "host string, path long, parent long, prior double, style long, content long, n long, chars long, links long"


def _emit_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    for batch in batches:
        out: dict[tuple, list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for path, (parent, prior, style, content, chars, links) in nodes(page.as_py() or "").items():
                sums = out.setdefault((host, sign(path), sign(parent), prior, sign(style), sign(content)), [0, 0, 0])
                for i, x in enumerate((1, chars, links)):
                    sums[i] += x
        rows = [(*k, *v) for k, v in out.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "path", "parent", "prior", "style", "content", "n", "chars", "links"])


def importance(merged: DataFrame) -> DataFrame:
    """``(host, path, pages, prior, importance)`` of merged nodes.

    Entropies are to the base of the number of pages, content's a share of the parent's; what they lack to 1 is shrunk
    while pages are few. To this come the prior of tag and names, less the share of link text outside of
    articles, and for a named block that holds most of its host's text a part of that share.
    """

    def entropy(column: str, name: str) -> DataFrame:
        per = merged.groupBy("host", "path", column).agg(F.sum("n").alias("c"))
        sums = per.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        value = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), (F.log("m") - F.col("s") / F.col("m")) / F.log("m"))).otherwise(1.0)
        return sums.select("host", "path", F.col("m").alias("pages"), value.alias(name))

    facts = merged.groupBy("host", "path").agg(*(F.min(c).alias(c) for c in ("parent", "prior")), *(F.sum(c).alias(c) for c in ("chars", "links")))
    here = facts.join(entropy("style", "presentation").drop("pages"), ["host", "path"]).join(entropy("content", "content"), ["host", "path"])
    above = here.select("host", F.col("path").alias("parent"), F.col("content").alias("around"))
    root = here.where(F.col("path") == ROOT).select("host", F.col("chars").alias("all"))
    at = here.join(above, ["host", "parent"], "left").join(root, "host", "left")
    lack = 1 - CONTENT * F.least(F.lit(1.0), F.coalesce(F.try_divide("content", "around"), F.lit(1.0))) - (1 - CONTENT) * F.col("presentation")
    shrunk = 1 - lack * F.col("pages") / (F.col("pages") + FEW)
    unnamed, named = F.col("prior") == 0, (F.col("prior") < 0) & (F.col("prior") > FRAME)
    links = F.when(unnamed & (F.col("links") > 0), LINKED * F.greatest(F.lit(0.0), 2 * F.col("links") / F.col("chars") - 1)).otherwise(0.0)
    mass = F.when(named & (F.col("all") > 0), MASS * F.greatest(F.lit(0.0), 2 * F.col("chars") / F.col("all") - 1)).otherwise(0.0)
    return at.select("host", "path", "pages", "prior", (shrunk + F.col("prior") + links + mass).alias("importance"))


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_paths: int = 100_000, salts: int = 32, host: Column | None = None
) -> DataFrame:
    """``(page_id, url, text)`` of every row: the main text of each whole page.

    Character references are decoded, white space within a block becomes one space, blocks are joined in
    page order by one space. Forms, scripts, styles and hidden elements hold no text. Every other block is kept if
    its importance in its host's style tree reaches ``LEAST``: what entropy it has, raised in an article or
    main element, lowered by tags and names of menus, headers, footers, sidebars, notices, adverts and comments and by
    link text. So a block that stays the same within articles that vary goes, a paragraph with an odd name stays, and
    text beside an article is judged like any other. Prose of an article stays although many articles share it.
    Inline elements are part of their block. On a host's first pages names weigh more, as evidence is shrunk.

    Style nodes are counted per batch before the shuffle, so that one host may hold any part of the rows. Paths on
    which the tree overrules the names are broadcast up to ``broadcast_paths``, beyond that joined by salted host.
    Null or empty html: empty text. Null or odd urls share one host. Equal ids are pages of their own. Unclosed and
    cut tags are closed as browsers do. Nesting and length have no limit: a task holds one page's elements. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "style")
    host = host if host is not None else F.lower(F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit("")))
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"), host.alias("host"))
    merged = rows.select("host", "html").mapInArrow(_emit_nodes, _NODES)
    keys = ("host", "path", "parent", "prior", "style", "content")
    merged = scratch.table(merged.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "chars", "links"))), "nodes")
    judged = importance(merged).where((F.col("importance") < LEAST) != (1 + F.col("prior") < LEAST))
    flips = scratch.table(judged.select("host", "path"), "flips")
    per_host = flips.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    if flips.count() <= broadcast_paths:
        rows = rows.join(F.broadcast(per_host), "host", "left")
    else:
        salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.col(id_col), "html"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset[int]] = {}
        for batch in batches:
            out = []
            for page, paths in zip(batch.column(2), batch.column(3), strict=True):
                key = tuple(paths.as_py()) if paths.is_valid else ()
                if key not in known:
                    known[key] = frozenset(p & _MASK for p in key)
                out.append(main_text(page.as_py() or "", known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    made = rows.select(F.col(id_col), F.col(url_col), "html", "paths").mapInArrow(run, f"id {types[id_col]}, url {types[url_col]}, text string")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
