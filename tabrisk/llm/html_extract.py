"""Main text of HTML pages by tree scoring.

A tolerant scan of the tags builds the page's tree; menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out: by their element as they are met, by their class, id or role when the
tree shows that they don't hold the main text.  Each paragraph passes points for its length and commas to its ancestors, less with
every level; an element's points are discounted by its link density.  The best
container is kept, with siblings that score well or hold text of few links, and
their blocks are joined in page order.

Pages are independent rows: one map over the table, no shuffle.
"""

from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element names of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
OUT = frozenset("head nav footer aside button select menu dialog template svg canvas object audio video math "
                "script style textarea title noscript iframe xmp noembed noframes fieldset label".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
                  "table tbody td tfoot th thead tr ul caption".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre td th dt dd blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag ends when they are open (up to the given barrier).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Words of a class, id or role that mark an element that is no main text:
#: things that never are, and places of a page that seldom hold it.
NEVER = re.compile(
    r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|comments?|commentlist|disqus|replies|respond|menus?|nav|navbar|"
    r"navigation|breadcrumbs?|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|share|sharing|pagination|"
    r"pager|contentinfo|outbrain|taboola|dialog|alertdialog", re.I)
PLACES = re.compile(
    r"promo(?:tion)?s?|banner|sidebar|side|aside|footer|foot|header|masthead|topbar|notices?|alert|popup|modal|overlay|social|"
    r"related|recommended|recommendations|widgets?|toolbar|complementary|search", re.I)
#: Parts of a compound name that leave its sense, and first parts of a layout flag.
PLAIN = frozenset("area bar bottom box block buttons container global group inner item items left links list outer right section "
                  "site slot text thread top unit wrap wrapper zone".split()) | {""}
#: Parts that, like numbers, don't weaken the name of a thing that never is main text.
KINDRED = frozenset("body content author meta text form item items entry entries reply date avatar header title".split())
FLAGS = frozenset("with without no not has have is hide show js".split())
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)

#: Characters of a block that passes points; levels that it reaches; points of a sibling that is kept.
MIN_CHARS, LEVELS, LEAST = 25, 5, 2.0


def name_says(token: str) -> str:
    """"never" or "place" for a class, id or role that names such an element as
    a whole, "part" if one of its parts does, else nothing."""
    parts = re.split(r"[-_]+", token.lower())
    never, place = (any(kind.fullmatch(x) for x in parts) for kind in (NEVER, PLACES))
    if parts[0] in FLAGS or not (never or place):
        return ""
    if all(x in PLAIN or NEVER.fullmatch(x) or PLACES.fullmatch(x) for x in parts):
        return "never" if never else "place"
    if never and all(x in PLAIN or x in KINDRED or x.isdigit() or NEVER.fullmatch(x) or PLACES.fullmatch(x) for x in parts):
        return "never"
    return "part"


class Page:
    """The tree of one page: for each node its parent, name, points, own
    characters and link characters; and the blocks of text in order."""

    def __init__(self, source: str):
        self.parent, self.name, self.points = [-1], ["#page"], [0.0]
        self.chars, self.linked = [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.marks: dict[int, str] = {}
        self.owners: list[int] | None = None
        self.open = [0]
        #: Depths of the open elements, by name; those of blocks other than paragraphs.
        self.at: dict[str, list[int]] = {}
        self.block_depths: list[int] = []
        self.parts: list[str] = []
        self.link_parts = 0
        self.links = 0
        self.scan(source)

    def scan(self, source: str):
        at, skip = 0, None  # skip: (depth of the left-out element)
        low = None
        while True:
            m = TOKEN.search(source, at)
            if skip is None:
                self.text(source[at: m.start() if m else len(source)])
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing = name.lower(), bool(m[1] or m[4])
            if closing:
                skip = self.close(name, skip)
                continue
            if name in RAW:
                low = low or source.lower()
                end = low.find("</" + name, at) if len(low) == len(source) else \
                    (x.start() if (x := re.compile("</" + name, re.I).search(source, at)) else -1)
                if end < 0:
                    at = len(source)
                else:
                    at = source.find(">", end) + 1 or len(source)
                continue
            attributes = m[3] if m[3] is not None else m[6]
            skip = self.start(name, attributes or "", skip)
        self.flush()

    def text(self, piece: str):
        if piece:
            self.parts.append(piece)
            if self.links:
                self.link_parts += len(piece.split()) and len(piece.strip())

    def flush(self):
        """End the block in progress."""
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((self.open[-1], text, min(self.link_parts, len(text))))
            self.parts.clear()
        self.link_parts = 0

    def start(self, name, attributes, skip):
        if name == "br" or name in VOID and name != "hr":
            if skip is None:
                self.parts.append(" ")
            return skip
        if name in BLOCK:
            if skip is None:
                self.flush()
            skip = self.close_open({"p"}, {"table", "td", "th", "button", "object"}, skip)
        if name in ENDS:
            skip = self.close_open(*ENDS[name], skip)
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name != "a":
            return skip
        self.parent.append(self.open[-1])
        self.name.append(name)
        self.points.append(0.0)
        self.chars.append(0)
        self.linked.append(0)
        self.at.setdefault(name, []).append(len(self.open))
        if name in BLOCK and name != "p":
            self.block_depths.append(len(self.open))
        self.open.append(len(self.name) - 1)
        if skip is None:
            mark = "" if name in ("html", "body") or name in OUT else self.marked(name, attributes)
            if name in OUT or mark == "hidden":
                self.flush()
                return len(self.open)
            if mark:
                self.flush()
                self.marks[self.open[-1]] = mark
            if name == "a":
                self.links += 1
        return skip

    def marked(self, name, attributes):
        """What an element's attributes say: "hidden", "never" or "place" (a
        whole name says that it is no main text), "part" (a part of a name
        does), or nothing.  ``left_out`` decides.  A header inside an article
        keeps its headings, see ``main_text``."""
        if name == "header":
            return "" if self.at.get("article") or self.at.get("main") else "place"
        if name == "form":
            return "form"
        if not attributes or name in HEADINGS:
            return ""
        found = set()
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and NOT_SHOWN.search(value):
                return "hidden"
            if key not in ("class", "id", "role") or name in ("article", "main", "b", "i", "em", "strong"):
                continue
            for token in value.split():
                if name == "p":
                    if key != "role" and name_says(token) == "never" and re.search(r"\b(?:ads?|advert\w*|cookie\w*|comment)\b", token.replace("_", "-"), re.I) \
                            or key != "role" and token.lower() == "notice":
                        found.add("never")
                else:
                    found.add(name_says(token))
        kind = next((k for k in ("never", "place", "part") if k in found), "")
        return kind if kind != "part" or name in BLOCK else ""

    def left_out(self) -> list[bool]:
        """Whether each element is left out for its marks.  A marked element
        stays if it holds the page's article or main; a place also if it holds
        most of the paragraph points, as does a form round a page or its article;
        any if the page has no text beside it.
        Where only a part of a name is marked, links and points decide."""
        n = len(self.name)
        points, chars, linked, main, head = ([0.0] * n for _ in range(5))
        for node, text, links in self.blocks:
            own = self.owner(node)
            chars[own] += len(text)
            linked[own] += links
            if self.name[own] in HEADINGS:
                head[own] = 1.0
            elif len(text) >= MIN_CHARS:
                points[own] += self.worth(text, links)
        named = [self.name[k] in ("article", "main") for k in range(n)]
        under = [False] * n  # inside an article or main
        for k in range(1, n):
            under[k] = named[k] or under[self.parent[k]]
            main[k] = chars[k] - linked[k] if under[k] else 0.0
        for k in range(n - 1, 0, -1):
            for x in (points, chars, linked, main, head):
                x[self.parent[k]] += x[k]
        out = [False] * n
        for k in range(1, n):
            out[k] = out[self.parent[k]]
            mark = self.marks.get(k)
            if out[k] or not mark:
                continue
            holds = not under[k] and 2 * main[k] > main[0]
            if mark == "part":
                out[k] = not holds and (3 * linked[k] > chars[k] or not points[k] and not head[k])
                continue
            alone = chars[0] - linked[0] - (chars[k] - linked[k]) < MIN_CHARS
            if mark == "form":
                out[k] = not (holds or 2 * points[k] > points[0] or not main[0] and alone and head[k])
                continue
            most = mark == "place" and 2 * points[k] > points[0]
            # a page with an article or main has its text there
            out[k] = not (holds or not main[0] and (alone or most))
        return out

    def innermost(self, names) -> int:
        """Depth of the innermost open element of ``names``, 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close_open(self, names, barriers, skip):
        """Close the innermost open element of ``names``, if no barrier is above it."""
        if "p" in names:
            barriers = barriers | {"article", "section", "main", "div", "body"}
        depth = self.innermost(names)
        return self.cut(depth, skip) if depth > self.innermost(barriers - names) else skip

    def close(self, name, skip):
        depth = self.innermost((name,))
        if not depth:
            if name in ("br", "p") and skip is None:
                self.flush()
            return skip
        if name not in BLOCK and self.block_depths and self.block_depths[-1] > depth:
            return skip  # an inline end tag doesn't end the blocks inside
        return self.cut(depth, skip)

    def cut(self, depth, skip):
        if skip is None and any(self.name[n] in BLOCK or n in self.marks for n in self.open[depth:]):
            self.flush()
        if skip is None:
            self.links -= sum(self.name[n] == "a" for n in self.open[depth:])
            self.links = max(self.links, 0)
        for n in self.open[depth:]:
            self.at[self.name[n]].pop()
        while self.block_depths and self.block_depths[-1] >= depth:
            self.block_depths.pop()
        del self.open[depth:]
        return None if skip is not None and len(self.open) < skip else skip

    def owner(self, node):
        """The element that holds a block as a whole: out of inline elements,
        then out of the paragraph itself."""
        if self.owners is None:  # parents come before their children
            self.owners = []
            for n, name in enumerate(self.name):
                self.owners.append(n if not n or name in BLOCK else self.owners[self.parent[n]])
        return self.owners[node]

    @staticmethod
    def worth(text: str, linked: int) -> float:
        """Points of a paragraph."""
        return (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked / len(text))

    def score(self):
        for node, text, linked in self.blocks:
            own = self.owner(node)
            self.chars[own] += len(text)
            self.linked[own] += linked
            if len(text) < MIN_CHARS or self.name[own] in HEADINGS:
                continue
            points = self.worth(text, linked)
            up = self.parent[own] if self.name[own] in LEAVES else own
            for level in range(LEVELS):
                if up < 0:
                    break
                self.points[up] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up = self.parent[up]
        for n in range(len(self.name) - 1, 0, -1):  # children come after their parents
            self.chars[self.parent[n]] += self.chars[n]
            self.linked[self.parent[n]] += self.linked[n]
        return [p * (1 - k / c) if c else 0.0 for p, k, c in zip(self.points, self.linked, self.chars)]

    def main_text(self) -> str:
        """The kept blocks, joined."""
        if self.marks:
            out = self.left_out()
            self.blocks = [b for b in self.blocks if not out[b[0]]]
        if not self.blocks:
            return ""
        scores = self.score()
        best = max(range(len(scores)), key=lambda n: (scores[n], -n))
        if scores[best] <= 0:  # no paragraph: the most text that is not linked, article or main first
            named = [n for n, name in enumerate(self.name) if name in ("article", "main")]
            best = max(named, key=lambda n: self.chars[n] - self.linked[n], default=0)
        up, whole = best, False
        while up > 0:  # an article is whole
            if self.name[up] == "article" or self.name[up] == "main" and not any(
                    name == "article" for name in self.name):
                best, whole = up, True
                break
            up = self.parent[up]
        kept, opened = self.around(best, scores, whole)
        inside = [False] * len(self.name)
        header = [False] * len(self.name)
        for n in range(len(self.name)):
            up = self.parent[n]
            inside[n] = n in kept or up >= 0 and inside[up]
            header[n] = self.name[n] == "header" or up >= 0 and header[up]
        return "\n\n".join(text for node, text, _ in self.blocks
                           if (inside[node] or self.owner(node) in opened)
                           and (not header[node] or self.name[self.owner(node)] in HEADINGS))

    def around(self, best: int, scores: list[float], whole: bool) -> tuple[set[int], set[int]]:
        """The best container with those siblings that are kept, and the
        containers above it whose own text is.  Beside an article only strong
        siblings and long text are kept.  On other pages every sibling of few
        links is (on the body's level if it has a paragraph, list or heading);
        and where a container has several kept parts, or no
        other text, the siblings of the container too."""
        children: dict[int, list[int]] = {}
        for n in range(1, len(self.name)):
            children.setdefault(self.parent[n], []).append(n)
        texts = {self.parent[0]}
        own = set()
        for node, text, linked in self.blocks:
            up = self.owner(node)
            if 4 * linked < len(text):
                own.add(up)
            if len(text) >= MIN_CHARS or self.name[up] in HEADINGS:
                while up not in texts:
                    texts.add(up)
                    up = self.parent[up]
        kept, opened = {best}, set()
        enough = max(LEAST, 0.2 * scores[best])
        while True:
            up = self.parent[best]
            top = up <= 0 or self.name[up] in ("html", "body")
            more = []
            for n in children.get(up, ()):
                if n == best or not self.chars[n]:
                    continue
                plain = self.linked[n] < 0.25 * self.chars[n]
                if whole:
                    plain = plain and self.name[n] in LEAVES and self.chars[n] > 80
                elif top:
                    plain = plain and (n in texts or self.name[n] in LEAVES or self.name[n] in ("ul", "ol", "dl"))
                if plain or scores[n] >= enough:
                    more.append(n)
            kept.update(more)
            if whole or top or not more and up not in own and self.chars[up] > self.chars[best]:
                return kept, opened
            opened.add(up)
            best = up


def main_text(source: str | None) -> str:
    """The main text of one page; empty if there is none."""
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    A null or empty page has the empty text.  Broken markup is read as far as
    it goes and never fails.  Repeated rows each get a row; extra columns are
    ignored; an empty table gives no row; a very long page is read whole, in
    time linear in its tags.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, batch.schema.field(2).type), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return (pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
                 .mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
                 .withColumnsRenamed({"id": id_col, "url": url_col}))
