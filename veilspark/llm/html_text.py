"""Main text of pages by site style trees.

The DOMs of one host are merged by style nodes: the path of block elements
with their classes and ids, digits left out. A node's measured importance is
composed of its presentation (how varied the runs of child elements are over
the host's pages, as an entropy) and its content (how few pages share a text: 1
less the entropy of the pages of each text, averaged).

What markup says of a node is its prior: PRIOR for the class and id words of
menus, adverts, comments and the like and, where a page names its article, for
what stands outside of it; 0 for the elements and roles that mean such things;
else 1. Few pages say little, so the measured importance is averaged with
PRIOR_PAGES pages of importance 1, and that of the paragraphs, headings, lists
and cells of a named article with ARTICLE_PAGES. The importance of a node is
the product; branches below IMPORTANCE go from every page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise, released
from .url_filter import url_host

IMPORTANCE = 0.3
#: Share of a branch's importance that its own presentation has.
PRESENTATION = 0.1
#: Pages of importance 1 that count besides those of the host.
PRIOR_PAGES, ARTICLE_PAGES = 2, 200
#: Importance of what is named as other than the main text, at most.
PRIOR = 0.2
#: Lists of low branches are broadcast up to so many bytes; beyond, they are
#: joined by host, each host in SALTS parts.
BROADCAST_BYTES = 16 << 20
SALTS = 64

#: Element names by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg select canvas audio video".split())
#: RAW elements whose content is text, not markup.
PLAIN = frozenset("script style textarea title iframe xmp noembed noframes".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter object output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside menu button dialog head".split())
#: Controls as a rule, but text may stand in them: some pages are one form.
DOUBTFUL = frozenset("fieldset form".split())
MAIN = frozenset("article main".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that name what isn't the main text.
CUES = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar side aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist reply replies respond "
    "disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search form pagination pager toolbar skip hidden paywall".split()
)
#: Of these, what an id alone says of a section in an article; other ids there are anchors of chapters.
READERS = frozenset("comment comments commentlist respond disqus".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body div section article main aside nav header footer form table td th ul ol dl blockquote figure fieldset dialog button details".split())

_TAG = re.compile(r"<(?:!--|(?P<decl>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>)")
_ATTR = re.compile(r"""([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))|\b(hidden)\b""")
_SHUT = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I | re.A) for name in RAW}
#: Where markup goes on after an element of PLAIN that is never closed.
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(SCOPE | TEXTUAL | DROPPED | MAIN))})(?=[\s/>])", re.I | re.A)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _cue(token: str) -> bool:
    """Whether a class or id is a cue word, or made of such words only."""
    words = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", token))]
    return bool(words) and ("".join(words) in CUES or all(w in CUES for w in words))


def _style(name: str, raw: str, article: bool) -> tuple[str, bool, bool]:
    """Style label of an element, whether its attributes rule it out, and
    whether its class or id does. An id of a heading, paragraph, list item or
    cell is an anchor and says nothing, nor does most of a section's in an
    ``article``."""
    if not raw.strip() or "=" not in raw and "hidden" not in raw:
        return name, False, False
    label, out, cued = [name], False, False
    for k, a, b, c, bare in _ATTR.findall(raw):
        k, v = k.lower(), a or b or c
        if k in ("class", "id"):
            v = html.unescape(v)
            label += [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", v))]
            anchor = k == "id" and (name in TEXTUAL or name == "section" and article and v.strip().lower() not in READERS)
            cued |= name not in ("html", "body", "main") and not anchor and any(map(_cue, v.split()))
        elif k == "role":
            out |= v.lower() in ROLES
        elif k == "aria-hidden" or bare:
            out |= bool(bare) or v.lower() == "true"
        elif k == "style":
            out |= "display:none" in v.replace(" ", "").lower()
    return ".".join(label), out, cued


class Block(NamedTuple):
    """Text of one block element. named: it, or what it stands in, is named as
    other than the main text. inside: the page's article or main holds it.
    textual: it is a paragraph, heading, list item or cell."""

    path: str
    text: str
    inside: bool
    textual: bool
    named: bool


class _Open(NamedTuple):
    """An element whose end hasn't come. out: 2 where nothing in it is text of
    the page, 1 where class words say so; tag: where it starts, if its own
    class words do; block: it ends a block."""

    name: str
    path: str
    out: int
    inside: bool
    textual: bool
    children: list[str]
    tag: int
    article: bool
    block: bool


def blocks(page: str | None) -> tuple[list[Block], list[tuple[str, str]]]:
    """The blocks of a page in order, and the runs of children of its nodes as
    (path, names of the child elements, repeats once).

    What elements and roles rule out, and what isn't shown, is left out. Class
    words never say anything about an article or main, nor about what holds
    one; but in an article they do, as articles there are comments. Forms are
    like class words, and where all of a page without article stands in forms
    they say nothing.
    """
    page = page or ""
    found, runs, holders, forms = _parse(page, frozenset())
    if forms and all(x.named and not x.inside for x in found):
        holders |= forms
    return _parse(page, holders)[:2] if holders else (found, runs)


def _parse(page: str, spared: frozenset[int]) -> tuple[list[Block], list[tuple[str, str]], frozenset[int], frozenset[int]]:
    """blocks() where class words don't count for the tags at ``spared``, the
    tags that they rule out though they hold an article or main, and those of
    forms."""
    found: list[Block] = []
    runs: list[tuple[str, str]] = []
    stack = [_Open("", "", 0, False, False, [], -1, False, True)]
    parts: list[str] = []
    holders: set[int] = set()
    forms: set[int] = set()
    open_ended: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = next(x for x in reversed(stack) if x.block)
                found.append(Block(top.path, text, top.inside, top.textual, top.out > 0))
            parts.clear()

    def pop(to: int) -> None:
        while len(stack) > to:
            x = stack.pop()
            if x.children and x.out < 2:
                runs.append((x.path, ">".join(dict.fromkeys(x.children))))

    at = 0
    while True:
        m = _TAG.search(page, at)
        if stack[-1].out < 2:
            text = page[at : m.start() if m else len(page)]
            if text:
                parts.append(text)
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            stop = "-->" if m["decl"] is None else ">"
            k = page.find(stop, at)
            at = len(page) if k < 0 else k + len(stop)
            continue
        name = name.lower()
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k:
                if any(x.block for x in stack[k:]):
                    flush()
                pop(k)
            elif name not in INLINE:
                flush()
            continue
        if name in RAW and not m["attrs"].endswith("/"):
            shut = None if name in open_ended else _SHUT[name].search(page, at)
            if shut is not None:
                at = shut.end()
                continue
            # never closed: the page goes on at the next block, or inside where it holds markup
            open_ended.add(name)
            if name in PLAIN:
                block = _BLOCK.search(page, at)
                at = len(page) if block is None else block.start()
            continue
        if name in VOID:
            if name in ("br", "hr") and stack[-1].out < 2:
                parts.append(" ")
                if name == "hr":
                    flush()
            continue
        top = stack[-1]
        label, gone, cued = _style(name, m["attrs"], top.inside)
        cued = (cued and not (name == "article" and not top.article) or name in DOUBTFUL) and m.start() not in spared
        tag = m.start() if cued and not top.article else -1
        if name == "form":
            forms.add(m.start())
        if name in MAIN and not top.article:
            holders.update(x.tag for x in stack if x.tag >= 0)
        if name in INLINE and not cued:
            if m["attrs"].endswith("/"):
                continue
            if gone and top.out < 2:
                parts.append(" ")
            stack.append(_Open(name, top.path, 2 if gone else top.out, top.inside, top.textual, [], tag, top.article, False))
            continue
        flush()
        if name not in INLINE:
            shut = ("p",) if name not in CLOSES else ("p", *CLOSES[name])
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in shut:
                    pop(k)
                    if stack[-1].name in INLINE or name not in CLOSES:
                        break
                elif stack[k].name in SCOPE and stack[k].name not in shut:
                    break
        top = stack[-1]
        gone |= name in DROPPED and not (name == "header" and top.inside)
        if top.out < 2:
            top.children.append(label)
        stack.append(_Open(name, f"{top.path}/{label}", 2 if gone else max(top.out, int(cued)), top.inside or name in MAIN, name in TEXTUAL, [], tag, top.article or name == "article", True))
    flush()
    pop(1)
    return found, runs, frozenset(holders), frozenset(forms)


def priors(found: list[Block]) -> list[float]:
    """What markup says of each block of a page: PRIOR or 1.

    Names don't count where nothing else is left: not in an article that is
    named throughout, nor on a page without one if paragraphs stand in what is
    named.
    """
    article = any(x.inside for x in found)
    own = [x for x in found if x.inside == article]
    trusted = not all(x.named for x in own) or not (article or any(x.textual for x in own))
    return [PRIOR if x.inside != article or x.named and trusted else 1.0 for x in found]


def _hashes(texts: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)


def _nodes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content (kind 0) and presentation (kind 1) of each style node of each
    page, each value of a node once a page; copy is the hash of what the
    markup's names leave of the page."""
    for frame in frames:
        host, copy, kind, path, value = [], [], [], [], []
        for h, page in zip(frame["host"].to_pylist(), frame["html"].to_pylist(), strict=True):
            found, runs = blocks(page)
            rows = list(dict.fromkeys([(0, x.path, x.text) for x in found] + [(1, p, r) for p, r in runs]))
            host += [h] * len(rows)
            copy += ["\n".join(x.text for x, w in zip(found, priors(found), strict=True) if w == 1)] * len(rows)
            kind += [r[0] for r in rows]
            path += [r[1] for r in rows]
            value += [r[2] for r in rows]
        yield pa.RecordBatch.from_pydict({"host": pa.array(host, pa.string()), "copy": pa.array(_hashes(copy), pa.int64()), "kind": pa.array(kind, pa.int32()), "path": pa.array(path, pa.string()), "value": pa.array(_hashes(value), pa.int64())})


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the merged style nodes with text;
    pages: (host, html).

    For a value on k of a node's m occurrences: content 1 - mean(log k / log
    m), presentation the entropy of the runs of the parent's children over
    log m; both 1 where m is 1. Pages of a host with the same text, but for
    what is named as other than the main text, count once.
    """
    met = pages.select("host", "html").mapInArrow(released(_nodes), "host string, copy long, kind int, path string, value long").distinct()
    counted = materialise(met.groupBy("host", "kind", "path", "value").agg(F.count("*").alias("k")), "nodes")
    merged = counted.groupBy("host", "kind", "path").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("s"))
    h = F.when(F.col("m") > 1, 1 - F.col("s") / F.col("m") / F.log("m")).otherwise(1.0)
    merged = merged.withColumn("i", h)
    own = merged.where("kind = 0").select("host", "path", F.col("m").alias("pages"), F.col("i").alias("content"), F.regexp_replace("path", "/[^/]*$", "").alias("up"))
    shape = merged.where("kind = 1").select(F.col("host").alias("h"), F.col("path").alias("up"), F.col("i").alias("shape"))
    met = own.join(shape, (own["host"] == F.col("h")) & (own["up"] == shape["up"]), "left")
    return met.select("host", "path", "pages", (PRESENTATION * F.coalesce("shape", F.lit(1.0)) + (1 - PRESENTATION) * F.col("content")).alias("importance"))


def low_branches(pages: DataFrame, importance: float = IMPORTANCE) -> DataFrame:
    """(site, low, lowest): paths of each host that the tree takes out, and of
    those the ones that it takes out of a named article too. A host without
    such paths has no row."""
    measured = F.col("importance") * F.col("pages")
    low, lowest = ((measured + n) / (F.col("pages") + n) < importance for n in (PRIOR_PAGES, ARTICLE_PAGES))
    listed = node_importance(pages).where(low).withColumn("lowest", lowest)
    return listed.groupBy(F.col("host").alias("site")).agg(F.sort_array(F.collect_list("path")).alias("low"), F.sort_array(F.collect_list(F.when(F.col("lowest"), F.col("path")))).alias("lowest"))


def main_text(page: str | None, low: frozenset[str] = frozenset(), lowest: frozenset[str] = frozenset()) -> str:
    """The main text of one page, given its host's paths of low importance."""
    found, _ = blocks(page)
    return " ".join(x.text for x, w in zip(found, priors(found), strict=True) if w == 1 and x.path not in (lowest if x.inside and x.textual else low))


def _extract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts = [main_text(page, *(frozenset(p or ()) for p in paths)) for page, *paths in zip(*(frame[c].to_pylist() for c in ("html", "low", "lowest")), strict=True)]
        yield pa.RecordBatch.from_pydict({"page_id": frame["page_id"], "url": frame["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract_main_text(pages: DataFrame, importance: float = IMPORTANCE) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url,
    html).

    Character references are decoded after the markup is gone; white space
    inside a block becomes one space; blocks are joined in page order by one
    space. Branches of an importance below ``importance`` are left out.

    Null and empty pages give an empty text; pages without host (null URL)
    form one site. Unclosed and misnested elements are closed where their
    parents end. Repeated rows give their text again. An empty table gives an
    empty one; other columns are ignored. ``importance`` lies above PRIOR, so
    what is named as other than the main text is out whatever its content.
    """
    if not PRIOR < importance <= 1:
        raise ValueError(f"importance must be above {PRIOR} and at most 1")
    bounded_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    base = base.withColumn("host", url_host(F.col("url")))
    low = materialise(low_branches(base, importance), "low")
    size = low.agg(F.sum(F.length("site") + F.length(F.concat_ws("", "low", "lowest")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = base.join(F.broadcast(low), F.col("host") == F.col("site"), "left")
    else:
        dealt = base.withColumn("part", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
        each = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.join(each, (F.col("host") == F.col("site")) & (F.col("part") == F.col("salt")), "left")
    return met.select("page_id", "url", "html", "low", "lowest").mapInArrow(released(_extract), "page_id long, url string, text string, n_chars long")
