"""Main text of web pages by a conditional random field over leaf blocks of the DOM.

A page is read into leaf blocks: runs of text between block-level tags, with the tags and class words of all
elements around them. Features are tags, name words and letter runs of names of ancestors and shape of the text
(length, links, punctuation, place). A linear-chain CRF, trained on labelled pages, labels blocks by Viterbi; blocks
of the article are joined in page order.

Some elements say by their kind that they are no part of an article: what lies in a form, aside, nav or footer, with
no article or main element between, is label 0 whatever else speaks for it, and Viterbi finds the best labelling of
those that keep to that. A form around a whole page without article and main elements is none in this sense.

Text inside a block: character references are decoded, white space becomes one space, ends are trimmed;
<br> is white space. Nothing else is dropped or cut.

Defined cases: a null or empty page has empty text; broken markup is read as far as it goes; a very long page is
read whole, in time proportional to its length, however it is broken; elements nested deeper than DEPTH count as
siblings; where two labellings are equally probable, a block is left out; repeated rows are read one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import table
from tidechart.llm.crf import Crf, fit_crf
from tidechart.llm.labelled_pages import training_pages

#: Elements whose content is no text of the page.
RAW = {t: re.compile(rf"</{t}\s{{0,99}}>", re.I) for t in "script style noscript template svg iframe object textarea select title".split()}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN = re.compile(r"[^'\">]*")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta q s samp small source span strike strong sub sup time track tt u var wbr br picture".split())
VOID = set("img input br hr meta link source wbr area base col embed param track".split())
CLOSES = {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
SCOPE = set("table ul ol dl article section div body main nav aside header footer form".split())
#: Elements that are no part of an article, and those inside of which an article begins anew.
APART, WITHIN = {"form", "aside", "nav", "footer"}, {"article", "main"}
#: A form with so much of a page's text is the page.
WHOLE = 0.8
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


#: Elements deeper than this are read, but count as siblings of those at this depth, as browsers have it.
DEPTH = 512


@lru_cache(maxsize=1 << 16)
def _of_name(word: str) -> tuple[str, ...]:
    """A name's word, and its runs of three letters, by which words that training lacks are like others."""
    edged = f"^{word[:40]}$"
    return (f"name:{word}", *(f"part:{edged[i : i + 3]}" for i in range(len(edged) - 2)))


class Open:
    """An open element: its and its ancestors' features, how much text lies in it outside links, up to three deep, and
    which of the elements apart it lies in, if any."""

    __slots__ = ("tag", "parent", "features", "weight", "depth", "apart")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Open | None, known: dict | None):
        self.tag, self.parent, self.weight = tag, parent, 0
        self.depth = parent.depth + 1 if parent else 1
        above = parent.apart if parent else ""
        self.apart = "" if tag in WITHIN else above if above and above != "form" else tag if tag in APART else above
        own = [f for f in (f"in:{tag}", *(f for w in names for f in _of_name(w))) if known is None or f in known]
        above = parent.features if parent else frozenset()
        # the same set where nothing is new: depth costs nothing
        self.features = above if above.issuperset(own) else above.union(own)


@dataclass
class Block:
    """A leaf block: its text, where in the page it begins, the innermost open element, characters inside links, and
    the inline element that its text begins in."""

    text: str
    at: int
    inside: Open | None
    linked: int
    lead: str


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "" or "/", tag, attributes) of all tags; comments and raw elements are one token without a tag.

    Every character is passed a bounded number of times. A quote that never closes is no quote; from the first such
    tag on, tags end at their first ">".
    """
    at, n, quotes = page.find("<"), len(page), True
    last = page.rfind(">")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", "", ""
        elif at > last:
            end = at + 1
        elif m := TAG.match(page, at):
            end, j = -1, m.end()
            while quotes:
                j = PLAIN.match(page, j).end()
                if j >= n:
                    quotes = False
                elif page[j] == ">":
                    end = j + 1
                    break
                else:
                    j = page.find(page[j], j + 1) + 1
                    quotes = j > 0
            if end < 0:
                end = page.find(">", m.end()) + 1
            tag = m[2].lower()
            if tag in RAW and not m[1]:
                close = RAW[tag].search(page, end)
                yield at, (close.end() if close else n), "", tag, ""
                end = close.end() if close else n
            else:
                yield at, end, m[1], tag, page[m.end() : end - 1]
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at) + 1
            yield at, end, "", "", ""
        else:
            end = at + 1
        at = page.find("<", end)


def blocks(page: str, known: dict | None = None) -> Iterator[Block]:
    """The leaf blocks of a page. known: the features that are kept of open elements, all if None."""
    top: Open | None = None
    run: list[str] = []
    at, begin, links, linked, lead = 0, -1, 0, 0, ""
    open_: Counter[str] = Counter()

    def leaf() -> Block | None:
        nonlocal begin, linked, lead
        text = " ".join(html.unescape("".join(run)).split())
        out = Block(text, begin, top, linked, lead) if text else None
        node = top
        for _ in range(3 if out else 0):
            if node is not None:
                node.weight += max(0, len(text) - linked)
                node = node.parent
        run.clear()
        begin, linked, lead = -1, 0, ""
        return out

    def add(piece: str, where: int) -> None:
        nonlocal begin, linked
        if begin < 0 and not piece.isspace():
            begin = where + len(piece) - len(piece.lstrip())
        run.append(piece)
        linked += len(piece) if links else 0

    def close(until: Open | None) -> None:
        """End all elements above and with `until`."""
        nonlocal top, links
        while top is not None:
            gone, top = top, top.parent
            open_[gone.tag] -= 1
            if gone is until:
                break

    for start, end, slash, tag, attributes in tokens(page):
        if start > at:
            add(page[at:start], at)
        at = end
        if not tag:
            continue
        if tag in RAW:
            if tag == "title" and (done := leaf()):
                yield done
            continue
        if tag == "a":
            links = 0 if slash else 1
        if tag in INLINE:
            if tag == "br":
                add(" ", start)
            elif begin < 0:
                lead = "" if slash else tag
            continue
        if done := leaf():
            yield done
        if slash:
            group = HEADINGS if tag in HEADINGS else {tag}
            if any(open_[t] > 0 for t in group):
                node = top
                while node.tag not in group:
                    node = node.parent
                close(node)
                links = 0
            continue
        if tag in CLOSES and any(open_[t] > 0 for t in CLOSES[tag]):
            node, last = top, None
            while node is not None and (node.tag in CLOSES[tag] or node.tag not in SCOPE):
                last = node if node.tag in CLOSES[tag] else last
                node = node.parent
            if last is not None:
                close(last)
        if tag not in VOID and not attributes.rstrip().endswith("/") and (top is None or top.depth < DEPTH):
            names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)) if "=" in attributes else ""
            words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
            top = Open(tag, tuple(w for w in words if w), top, known)
            open_[tag] += 1
    if at < len(page):
        add(page[at:], at)
    if done := leaf():
        yield done


#: A name of one to three words before a colon, as before what readers say.
SPEAKER = re.compile(r"\w+(?: \w+){0,2}:\s")


def _bucket(part: float) -> int:
    return min(4, int(part * 5))


def _features(found: list[Block]) -> list[list[str]]:
    n = len(found)
    shape = [(min((b.text.count(" ") + 1).bit_length(), 7), min(4, b.linked * 4 // max(len(b.text), 1))) for b in found]
    total = max(1, sum(len(b.text) - min(len(b.text), b.linked) for b in found))
    marked = any(b.inside and not b.inside.features.isdisjoint(("in:article", "in:main")) for b in found)
    out = []
    for k, b in enumerate(found):
        own = b.inside.features if b.inside else frozenset()
        item = [*own, f"leaf:{b.inside.tag if b.inside else ''}"]
        item += [f"words:{shape[k][0]}", f"linked:{shape[k][1]}"]
        for name, other in (("before", k - 1), ("after", k + 1)):
            item.append(f"{name}:{shape[other][0]}" if 0 <= other < n else f"{name}:none")
            item.append(f"{name} linked:{shape[other][1]}" if 0 <= other < n else f"{name} linked:none")
        if not marked:
            # the share of the page's text that lies in the innermost element, and in the one around it
            around = b.inside.parent if b.inside else None
            box = _bucket(b.inside.weight / total) if b.inside else "none"
            outer = _bucket(around.weight / total) if around else "none"
            item += [f"box:{box}", f"around:{outer}", f"leaf:{b.inside.tag if b.inside else ''} {box} {outer}"]
        if b.text[-1] in ".!?…:;":
            item.append("ends")
        if "©" in b.text or b.text.lower().startswith("copyright"):
            item.append("copyright")
        if b.lead:
            item.append(f"lead:{b.lead}")
            if any(0 <= other < n and found[other].lead == b.lead for other in (k - 1, k + 1)):
                item.append(f"leads:{b.lead}")
        if SPEAKER.match(b.text):
            item.append("speaker")
        item.append(f"place:{k * 4 // n}")
        inside = not own.isdisjoint(("in:article", "in:main"))
        item.append("page without article" if not marked else "inside" if inside else "outside")
        out.append(item)
    return out


def labelled(parts: list[tuple[str, bool]]) -> tuple[list[Block], list[int]]:
    """The blocks of a page given as parts, and whether each begins in a part of the article."""
    ends, found = np.cumsum([len(h) for h, _ in parts]), list(blocks("".join(h for h, _ in parts)))
    return found, [int(parts[int(np.searchsorted(ends, b.at, side="right"))][1]) for b in found]


@lru_cache(maxsize=1)
def trained() -> Crf:
    """The model of this module's labelled pages."""
    data = []
    for parts in training_pages():
        found, labels = labelled(parts)
        data.append((_features(found), labels))
    return fit_crf(data, ridge=5e-4)


def barred(found: list[Block]) -> list[bool]:
    """Which blocks lie in elements that are no part of an article."""
    apart = [b.inside.apart if b.inside else "" for b in found]
    if not any(b.inside and not b.inside.features.isdisjoint(("in:article", "in:main")) for b in found):
        size = {kind: sum(len(b.text) for b, a in zip(found, apart) if a == kind) for kind in ("form", "")}
        if size["form"] > WHOLE * max(1, sum(size.values())):
            apart = ["" if a == "form" else a for a in apart]
    return [a != "" for a in apart]


def main_text(page: str | None, model: Crf) -> str:
    found = list(blocks(page or "", model.index))
    return "\n".join(b.text for b, keep in zip(found, model.decode(_features(found), barred(found)), strict=True) if keep)


def extracted(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row of `pages`."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return own.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extracted(table(spark, sf_dir, "pages"), trained())
    return done.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
