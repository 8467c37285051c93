"""Main text of web pages by composite text density.

Every element of the page's tree gets a density: its characters for each tag,
weighed down by the share of characters and tags that are links. The element
whose children have the largest sum of densities is the core of the page; the
least density on the path from body to it is the threshold. Below every element
that reaches the threshold, with all that contain it, the subtree with the largest
sum is content.

Menus, notices, adverts and the like are marked by their tag, role or a word of
their name. A mark does not drop an element: its characters and tags count as
links, so its density falls to nothing and that of all around it falls too. Marks
that would leave next to no text of a page belong to wrappers; they are taken
back, the largest element first. Only what a reader cannot see as text (scripts,
styles, controls of forms, embedded media) goes by its tag alone.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm.common import arrow_rows, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html dd dt li option optgroup td th tr tbody thead tfoot".split())
#: An opening tag ends open elements of these names, up to the nearest of the scope.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}

#: Elements without text to read: code, embedded media and the controls of forms.
NEVER_TAG = frozenset("button select textarea script style noscript template iframe svg canvas object audio video head title".split())
#: Marks, by tag, role, or a word of a class or id.
MARK_TAG = frozenset("nav footer aside form menu dialog".split())
MARK_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MARK_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments cookie cookies consent gdpr notice notices popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login pagination pager toolbar widget disqus respond replies".split()
)
#: Names with one of these words tell how a page is laid out, not what an element is.
STATE_WORD = frozenset("no not non has with without free open closed enabled disabled is".split())
#: These mark only outside an article: inside it they hold its title.
MARK_OUTSIDE = frozenset(("header", "masthead"))
MAIN = frozenset(("article", "main"))
#: Marks are taken back until at least this share of the text outside links is unmarked.
LEAST_UNMARKED = 0.05
#: Elements that can hold an article; paragraphs, headings, items and inline elements only add to their densities.
CONTAINER = frozenset("article blockquote body center details div form main section table tbody td".split())


class Page:
    """The tree of a page: for each element its parent, tag and counts, and the texts in page order."""

    def __init__(self, source: str, marks: bool = True) -> None:
        self.parent, self.tag, self.dropped, self.in_main, self.marked = [-1], [""], [False], [False], [False]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.texts: list[tuple[int, int, str]] = []  # element, block, text
        self.body = 0
        self._parse(source)
        self._settle_marks(marks)
        for i in range(len(self.parent) - 1, 0, -1):  # children stand after their parents
            p = self.parent[i]
            if not self.dropped[i]:
                self.chars[p] += self.chars[i]
                self.tags[p] += self.tags[i] + 1
                self.link_chars[p] += self.link_chars[i]
                self.link_tags[p] += self.link_tags[i] + (self.marked[i] or self.tag[i] == "a")
        self.all_chars, self.all_link_chars = self.chars[0], self.link_chars[0]

    def _settle_marks(self, marks: bool) -> None:
        """Take back the marks of wrappers, then count all below a mark as links."""
        n = len(self.parent)
        plain = [c - lc for c, lc in zip(self.chars, self.link_chars, strict=True)]
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                plain[self.parent[i]] += plain[i]
        own = self.marked if marks else [False] * n
        while True:
            below, outer = [False] * n, []
            for i in range(1, n):
                up = below[self.parent[i]]
                below[i] = up or own[i]
                if own[i] and not up and plain[i] and not self.dropped[i]:
                    outer.append(i)
            if not outer or plain[0] - sum(plain[i] for i in outer) >= LEAST_UNMARKED * plain[0]:
                break
            own[max(outer, key=lambda i: (plain[i], -i))] = False
        self.marked = below
        for i in range(1, n):
            if below[i]:
                self.link_chars[i] = self.chars[i]

    def _add(self, tag: str, attrs: str, up: int) -> int:
        self.parent.append(up)
        self.tag.append(tag)
        self.in_main.append(self.in_main[up] or tag in MAIN)
        self.dropped.append(self.dropped[up] or tag in NEVER_TAG)
        self.marked.append(self._mark(tag, attrs, self.in_main[up]))
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
            counts.append(0)
        return len(self.parent) - 1

    @staticmethod
    def _mark(tag: str, attrs: str, in_main: bool) -> bool:
        if tag in MARK_TAG or (tag in MARK_OUTSIDE and not in_main):
            return True
        if not attrs or tag in ("body", "html", "article", "main"):
            return False
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                for one in value.split():
                    words = set(re.split(r"[^a-z]+", one))
                    if not words & STATE_WORD and (words & MARK_WORD or (not in_main and words & MARK_OUTSIDE)):
                        return True
            elif (name == "role" and value in MARK_ROLE) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return True
        return False

    def _parse(self, source: str) -> None:
        stack, links, block, at, lower = [0], 0, 0, 0, None
        tag_of = self.tag
        while True:
            m = _TAG.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                here = stack[-1]
                if "&" in text:
                    text = html.unescape(text)
                n = len(text.strip())
                if not self.dropped[here]:
                    self.chars[here] += n
                    self.link_chars[here] += n if links else 0
                    self.texts.append((here, block, text))
            if not m:
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, attrs = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:  # an end
                block += tag in BLOCK
                for depth in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[depth]] == tag:
                        links -= sum(tag_of[i] == "a" for i in stack[depth:])
                        del stack[depth:]
                        break
                continue
            if tag in BLOCK:
                block += 1
            elif tag == "br" and not self.dropped[stack[-1]]:
                self.texts.append((stack[-1], block, " "))
            if tag in ENDS or tag in CLOSES_P:
                ends, scope = ENDS.get(tag, ({"p"}, BLOCK - {"p"}))
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = tag_of[stack[depth]]
                    if open_tag in scope:
                        break
                    if open_tag in ends:
                        links -= sum(tag_of[i] == "a" for i in stack[depth:])
                        del stack[depth:]
                        if tag not in ENDS:
                            break
            node = self._add(tag, attrs, stack[-1])
            if tag == "body":
                self.body = node
            if tag in RAW:
                lower = lower if lower is not None else source.lower()
                end = lower.find(f"</{tag}", at)
                at = len(source) if end < 0 else end
                if end >= 0:
                    close = source.find(">", end)
                    at = len(source) if close < 0 else close + 1
            elif tag not in VOID and not attrs.rstrip().endswith("/") or tag == "a":
                stack.append(node)
                links += tag == "a"

    def densities(self) -> list[float]:
        share = self.all_link_chars / self.all_chars if self.all_chars else 0.0
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            plain = c / (t or 1)
            if not c or not self.all_link_chars:
                out.append(plain)
                continue
            base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
            out.append(plain * math.log(max(1.0, c / (lc or 1) * (t or 1) / (lt or 1))) / math.log(base))
        return out

    def main_text(self) -> str:
        density = self.densities()
        n = len(density)
        sums = [0.0] * n
        for i in range(1, n):
            if not self.dropped[i]:
                sums[self.parent[i]] += density[i]
        for i in range(1, n):
            if self.tag[i] not in CONTAINER:
                sums[i] = 0.0
        best = list(range(n))  # the element with the largest sum at or below each; the outermost among equals
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.dropped[i] and p >= 0 and sums[best[i]] > sums[best[p]]:
                best[p] = best[i]
        root = self.body
        core = best[root]
        threshold, i = density[root], core
        while i != root and i > 0:
            threshold = min(threshold, density[i])
            i = self.parent[i]
        reached, content = [False] * n, [False] * n
        for i in range(root, n):
            if self.dropped[i] or self.marked[i] or (i != root and not reached[self.parent[i]] and not content[self.parent[i]]):
                continue
            if i == root or reached[self.parent[i]]:
                reached[i] = density[i] >= threshold and self.chars[i] > 0
                if reached[i]:
                    content[best[i]] = True
            content[i] = content[i] or content[max(self.parent[i], 0)]
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.texts:
            if content[node] and not self.marked[node]:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
        return "\n\n".join(x for x in joined if x)


def main_text(source: str | None) -> str:
    """The main text of one page; null, empty or textless pages have none."""
    return Page(source).main_text() if source else ""


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text. Null html counts as empty, with empty text; repeated rows each
    give a row; other columns are ignored; pages are parsed whole."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_rows(pages.select("page_id", "url", "html"), 500).mapInArrow(extract_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
