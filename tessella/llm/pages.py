"""Main text of web pages by line-block distribution.

Markup is turned into lines, one for each block element. Each line has a size, and the sizes of a sliding
window of lines make a curve: where it surges over a level the article begins, where it dives the article
ends, and all text between the first surge and the last dive is kept, lists of links included. The level
is the smaller of `surge` and half the curve's peak, so a short page has a surge too. A line's size is its
letters less those of links. In a page with an <article> or <main> element lines in it are raised by the
level and lines outside it have size zero. What stands in elements that are never article (menus, headers,
footers, sidebars, forms, scripts, readers' comments, adverts, notices) has size zero and is left out
wherever it stands.

Edges: null and empty html give an empty text; unclosed and stray tags, quotes and links are tolerated, and
any page is read whole in time linear in its length; repeated rows give equal rows; further columns are
left alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches

NAME = re.compile(r"[A-Za-z][^\s/<>]*")
#: What may end a tag, and a quote that begins a value.
STOP = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[\s\xa0]+")
#: Elements whose text is never read, as browsers treat it (fixed values).
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title")
#: Elements that hold no article text.
OUTSIDE = frozenset("nav header footer aside form button select dialog menu head fieldset label input option".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class, id or role that mark what is not article, and words that say nothing beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promotions comment comments reply replies respond discussion disqus sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal newsletter subscribe signup login share sharing social related recommended recommendations widget widgets pager pagination tags toolbar copyright legal".split())
PLAIN = frozenset("area bar block body bottom box button buttons col column container content cta feed form global group head icon icons inner item items left link links list main outer page post posts primary right row secondary section site slot text title top unit wrap wrapper".split())
PART = re.compile(r"[A-Za-z]+")
#: A start tag that ends open elements of these names, without an end tag.
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def marked(names: str) -> bool:
    """Does one of the names (a class, id or role) consist of marks and plain words, with a mark at least?"""
    for name in names.split():
        parts = [x.lower() for x in PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
        if any(x in MARKS for x in parts) and all(x in MARKS or x in PLAIN for x in parts):
            return True
    return False


class _Tags:
    """Finds the ends of tags, comments and raw elements; what is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.lower, self.gone = page, None, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Place behind the > of a tag; -1 if there is none. A quote after = holds a value, unless it is never closed."""
        if self.find(">", at) < 0:
            return -1
        while m := STOP.search(self.page, at):
            at = m.end()
            if m.group() == ">":
                return at
            k = self.find(m.group()[-1], at)
            at = k + 1 if k >= 0 else at
        return -1

    def raw_end(self, name: str, at: int) -> int:
        """Place behind the end tag of a raw element, or the end of the page."""
        if self.lower is None:
            self.lower = self.page.lower() if len(self.page.lower()) == len(self.page) else self.page.translate({c: c + 32 for c in range(65, 91)})
        k = at
        while (k := self.lower.find(f"</{name}", k)) >= 0:
            k += len(name) + 2
            if k >= len(self.page) or not (self.page[k].isalnum() or self.page[k] in "-_"):
                end = self.find(">", k)
                return end + 1 if end >= 0 else len(self.page)
        return len(self.page)


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, letters in links, marked off, inside an article element) of each block, in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, marked off, within an article
    open_: Counter[str] = Counter()
    tags, parts = _Tags(page), []
    linked = 0
    link = -1  # height of the stack where the open link began
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                away, within = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((text, min(linked, len(text)), away, within))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if link >= 0:
            linked += len(piece.strip())

    def pop() -> None:
        nonlocal link
        open_[stack.pop()[0]] -= 1
        if len(stack) < link:
            link = -1

    while at < n:
        k = page.find("<", at)
        if k < 0:
            add(page[at:])
            break
        if k > at:
            add(page[at:k])
        after = page[k + 1 : k + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", k):
                end = tags.find("-->", k + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", k) and (end := tags.find("]]>", k)) >= 0:
                add(entities.unescape(page[k + 9 : end].replace("&", "&amp;")))
                at = end + 3
            else:
                end = tags.find(">", k)
                at = end + 1 if end >= 0 else n
            continue
        closing = after == "/"
        found = NAME.match(page, k + 1 + closing)
        end = tags.tag_end(found.end()) if found else -1
        if end < 0:  # no tag: the sign itself
            add("<")
            at = k + 1
            continue
        name, inner, at = found[0].lower(), page[found.end() : end - 1], end
        alone = inner.endswith("/")
        if name in RAW and not closing and not alone:
            at = tags.raw_end(name, at)
            continue
        if name == "a":
            link = -1 if closing or not any(g[0].lower() == "href" for g in ATTRIBUTE.findall(inner)) else len(stack)
            continue
        if name in BLOCK or name in OUTSIDE:
            flush()
        if closing:
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID and not alone and (name in BLOCK or name in OUTSIDE or name == "span"):
            if name in BLOCK and stack and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in SIBLING.get(name, ()):
                pop()
            away, within = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if not away:
                names = [" ".join(g[1:]) for g in ATTRIBUTE.findall(inner) if g[0].lower() != "href"]
                away = (name in OUTSIDE and not (name == "header" and within)) or (name not in ("body", "html", "article", "main") and any(map(marked, names)))
            stack.append((name, away, within or name in ("article", "main")))
            open_[name] += 1
    flush()
    return out


def curve(sizes: list[int], width: int) -> list[int]:
    """Sum of the `width` sizes from each line on."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    return [total[min(i + width, len(sizes))] - total[i] for i in range(len(sizes))]


def article(sizes: list[int], width: int = 3, surge: int = 60, dive: int = 1, share: float = 0.2) -> tuple[int, int]:
    """First line and the line behind the last one of the text between surge and dive.

    A run begins at a line of some size where the curve reaches the level and ends at the first line after it
    where the curve is below `dive`; runs with less than `share` of the largest run's letters don't count.
    """
    sums = curve(sizes, width)
    level = min(surge, max(sums, default=0) / 2)
    runs: list[tuple[int, int, int]] = []
    i = 0
    while level > 0 and i < len(sums):
        if sums[i] >= level and sizes[i]:
            j = i + 1
            while j < len(sums) and sums[j] >= dive:
                j += 1
            runs.append((i, j, sum(sizes[i:j])))
            i = j
        else:
            i += 1
    least = share * max((w for _, _, w in runs), default=0)
    runs = [r for r in runs if r[2] >= least]
    return (runs[0][0], runs[-1][1]) if runs else (0, 0)


def main_text(page: str | None, width: int = 3, surge: int = 60, dive: int = 1) -> str:
    """Lines between the surge and the dive, joined by line ends.

    A line counts with its letters outside links, a marked-off one with none. In a page with an article element
    its lines count half a surge more and all others half a surge less, so short lines of an article hold
    together, but no line reaches the level by its place alone and long text elsewhere is kept.
    """
    if not page:
        return ""
    found = lines(page)
    bounded = any(w and not away for _, _, away, w in found)
    plain = [max(0, len(t) - 2 * linked) for t, linked, _, _ in found]
    sizes = [0 if away else p + surge // 2 if w else max(0, p - surge // 2) if bounded else p for p, (_, _, away, w) in zip(plain, found, strict=True)]
    begin, end = article(sizes, width, surge, dive)
    return "\n".join(t for t, _, away, _ in found[begin:end] if not away)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every page."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in batches(frames, html):
            texts = [main_text(x) for x in sources]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    frame = pages.select(*keep, html)
    return frame.mapInArrow(run, frame.select(*keep).schema.add("text", "string").add("n_chars", "long"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
