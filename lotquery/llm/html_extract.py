"""Main text of web pages by consensus host paths.

1. Every page's containers are scored by the plain text below them; the page
   votes for the generalised tag-class path of its main container.
2. Spark counts the votes per host; the path with the most votes wins.
3. Every page is extracted again below the elements on its host's winning path.
   A page without such an element uses its own main container, and so does one
   whose winning path holds less text than is left, if its container's path is
   voted for more often than it stands beside a container that won its page.

Left out everywhere: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments, known by tag, role, class or id;
inside an article a class must name nothing else, and words that articles use
too need links or controls as a second sign.  Marks hold for each piece of
text, so a block keeps what stands around an advert in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import map_texts, stored

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'>/=]+)""")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section
    summary table tbody tfoot thead tr ul caption hr option select""".split())
SPACE = set("br td th img".split())
#: Start tags that end an open element of the same family.
FAMILY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: A family's open element is looked for up to these.
FENCE = set("table td th button object caption ul ol dl select".split())
NOT_IN_P = BLOCK - {"body", "html", "option", "caption", "tbody", "tfoot", "thead", "tr"}

#: Never main text.
OUT_TAGS = set("nav footer aside form button select dialog menu search svg math canvas audio video object head".split())
OUT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Words of a class or id.
OUT_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted
    promotion comment comments commentlist disqus replies respond sidebar sidebars cookie cookies consent gdpr
    newsletter subscribe subscription signup login breadcrumb breadcrumbs nav navbar navigation menu menus footer
    pagination pager share sharing related popup modal""".split())
#: Words of article elements that aren't the page's own.
OUT_ARTICLES = set("comment comments replies related promo promoted sponsor sponsored ad ads advert advertisement".split())
#: Words that also name wrappers of main text: out, unless a page's article is inside.
WEAK_WORDS = set("""header masthead topbar toolbar banner notice notices alert alerts announcement widget widgets side
    social search form forms discussion feedback reply legal copyright disclaimer recommended overlay""".split())
#: Inside an article a class counts only if all its words are such, or these, which name a part of a page.
PARTS = set("""box block blocks list item items section wrapper wrap container content area inner outer unit slot panel
    bar row column col group links link buttons button icons icon posts post articles article site page main top bottom
    left right big small wide mobile desktop js is the and of for text title""".split())
#: Of these words an article's own sections make use: out only with links or form controls for text.
SECOND_SIGN = set("""menu menus related share sharing replies discussion feedback reply legal copyright disclaimer recommended
    side search form forms announcement masthead topbar""".split())
CONTROLS = set("form button select input textarea option label fieldset".split())
#: A class with such a word tells what a wrapper holds, not what it is.
WRAPS = set("with without has no".split())
#: A wrapper by these tags, or one with this share of a page's text, stays.
KEEP_TAGS = set("html body main article".split())
MOST = 0.5
#: Without an article or main inside, an element named in OUT_WORDS stays if plain text that nothing leaves out
#: is at most this share of its own: it is a wrapper then.  These tags have no such exception.
AROUND = 0.1
OUT_WHOLE = set("nav footer header aside button select dialog menu search svg math canvas audio video object head".split())
#: Such an element is readers' or a notice, and a wrapper only if it holds an h1 too.
OWN_WORDS = set("comment comments commentlist disqus replies respond cookie cookies consent gdpr".split())
#: Without an article or main, a container may leave out this share of a page's text, and no heading.
NOISE = 0.05
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A list or box with links for this share of its text, and so many links, is a menu, but in an article, a main
#: or the container, from the box with most of the text on.
LINK_SHARE, MENU_LINKS = 0.8, 3


class Page:
    """Elements of a page in document order, and its text in pieces."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#"]
        self.name: list[str] = [""]
        self.parent: list[int] = [-1]
        self.last: list[int] = [0]  # the last element below
        #: 1: left out unless it wraps a page; 2: unless it has most text; 3: as 1, OWN_WORDS; 4: if it is links or controls
        self.out: list[int] = [0]
        self.links: list[int] = [0]
        self.controls: list[int] = [0]
        self.block: list[int] = [0]  # the nearest block element
        self.route: list[int] = [0]  # number of the path
        self.routes: dict[tuple[int, str], int] = {}  # from a parent's path and a name
        self.pieces: list[tuple[int, int, str, int, bool]] = []  # block number, element, text, characters, in a link
        self._parse(source)
        self._weigh()

    def _parse(self, source: str) -> None:
        stack = [0]
        places: dict[str, list[int]] = {}  # depths of the open elements of a tag
        blocks, fences = [0], [-1]  # depths of open block and FENCE elements
        links, inside, number = 0, 0, 0
        pending = False

        def flush():
            nonlocal number, pending
            number += pending
            pending = False

        def put(text: str):
            nonlocal pending
            size = len(" ".join(text.split()))
            if size or pending:
                self.pieces.append((number, stack[-1], text, size, links > 0))
                pending = True

        def close(depth: int):
            nonlocal links, inside
            for d in range(len(stack) - 1, depth - 1, -1):
                e = stack[d]
                tag = self.tag[e]
                self.last[e] = len(self.tag) - 1
                links -= tag == "a"
                inside -= tag in {"article", "main"}
                if e:
                    places[tag].pop()
                for open_ones in (blocks, fences):
                    if open_ones[-1] == d and d:
                        open_ones.pop()
            del stack[depth:]

        def deepest(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        low = None
        position, end = 0, len(source)
        while position < end:
            m = MARKUP.search(source, position)
            upto = m.start() if m else end
            if upto > position:
                put(source[position:upto])
            if not m:
                break
            position = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag in BLOCK:
                    flush()
                depth = deepest((tag,))
                if depth and (tag in BLOCK or depth > blocks[-1]):  # an inline end tag doesn't end blocks
                    close(depth)
                continue
            if tag in BLOCK:
                flush()
            elif tag in SPACE:
                put(" ")
            if tag in NOT_IN_P and (depth := deepest("p")) and depth >= max(blocks[-1], fences[-1]):
                close(depth)
            if (family := FAMILY.get(tag)) and (depth := deepest(family)) and depth >= fences[-1]:
                close(depth)
            if tag in CONTROLS:
                self.controls[stack[-1]] += 1
            if tag in VOID:
                continue
            if tag in RAW:
                if not m["rest"].endswith("/"):
                    if low is None:
                        low = source.lower()
                    found = low.find(f"</{tag}", position)
                    position = end if found < 0 else found
                    position = end if (shut := low.find(">", position)) < 0 else shut + 1
                continue
            if m["rest"].endswith("/") and tag in {"svg", "path", "use", "g"}:
                continue
            e = len(self.tag)
            at = stack[-1]
            name, out = _look(tag, m["rest"], inside > 0)
            self.tag.append(tag)
            self.name.append(name)
            self.parent.append(at)
            self.last.append(e)
            self.out.append(out)
            self.links.append(int(tag == "a"))
            self.controls.append(0)
            self.block.append(e if tag in BLOCK else self.block[at])
            self.route.append(self.routes.setdefault((self.route[at], name), len(self.routes) + 1))
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            if tag in FENCE:
                fences.append(len(stack))
            stack.append(e)
            inside += tag in {"article", "main"}
            links += tag == "a"
        close(0)

    def _weigh(self) -> None:
        """Text below each element, and what is left out."""
        n = len(self.tag)
        chars, link, clean, self.inside = [0] * n, [0] * n, [0] * n, [0] * n
        for _, e, _, size, in_link in self.pieces:
            chars[e] += size
            link[e] += size * in_link
            clean[e] += size * (not in_link)
        for e in range(n - 1, 0, -1):
            at = self.parent[e]
            chars[at] += chars[e]
            link[at] += link[e]
            self.links[at] += self.links[e]
            self.controls[at] += self.controls[e]
            if self.tag[e] in {"article", "main"} or self.inside[e]:
                self.inside[at] = 1
        plain = [c - k for c, k in zip(chars, link, strict=True)]
        article, holds, h1 = [0] * n, [0] * n, [0] * n
        for e in range(1, n):  # a mark that needs a second sign
            if self.out[e] == 4:
                self.out[e] = int(not self.inside[e] and chars[e] > 0 and (link[e] >= LINK_SHARE * chars[e] or self.controls[e] > 0))
        for e in range(n - 1, 0, -1):  # below each: text that no mark leaves out, the largest article, a main, an h1
            at, own = self.parent[e], self.tag[e] in {"article", "main"} and not self.out[e]
            clean[at] += 0 if self.out[e] in {1, 3} else clean[e]
            if not (self.tag[e] == "article" and self.out[e]):
                article[at] = max(article[at], article[e], plain[e] if own else 0)
                holds[at] |= holds[e] or own and self.tag[e] == "main"
            h1[at] |= h1[e] or self.tag[e] == "h1"
        scope = [clean[0]] * n  # text that stays around an element
        marked, within, menus = [False] * n, [False] * n, []
        for e in range(1, n):
            out, at = self.out[e], self.parent[e]
            scope[e] = scope[at]
            if out == 2 and (self.inside[e] or chars[e] > MOST * chars[0]):
                out = 0
            if out in {1, 3} and not marked[at] and self.tag[e] != "article" and (out == 1 or h1[e]) and (
                    holds[e] or article[e] > scope[at] or self.tag[e] not in OUT_WHOLE
                    and plain[e] > MOST * plain[0] and scope[at] <= AROUND * plain[e]):
                out = 0
                scope[e] += clean[e]
            within[e] = within[at] or self.tag[e] in {"article", "main"} and not out
            if (self.links[e] >= MENU_LINKS and self.tag[e] in {"ul", "ol", "div", "section", "table", "p"} and not within[e]
                    and link[e] >= LINK_SHARE * chars[e] and not self.inside[e]):
                menus.append(e)
            marked[e] = bool(out) or marked[at]
        self._leave_out(marked, [])
        if menus:
            core, box = self._down(False), self._down(True)
            if self.tag[box] in {"#", "html", "body"}:
                box = core
            if self.tag[box] not in {"#", "html", "body"}:  # lists in the text, or below it in its container, stay
                menus = [e for e in menus if not core < e <= self.last[box]]
            self._leave_out(marked, menus)

    def _leave_out(self, marked: list[bool], menus: list[int]) -> None:
        n = len(marked)
        gone = marked[:]
        for e in menus:
            gone[e] = True
        for e in range(1, n):
            gone[e] = gone[e] or gone[self.parent[e]]
        self.gone = gone
        self.plain, self.heads, self.articles = [0] * n, [0] * n, [0] * n
        for _, e, _, size, in_link in self.pieces:
            if not gone[e] and not in_link:
                self.plain[e] += size
                if size and self.tag[self.block[e]] in HEADINGS:
                    self.heads[self.block[e]] = 1
        for e in range(n - 1, 0, -1):  # below each: characters that stay, without links; headings; the largest article
            at = self.parent[e]
            self.plain[at] += self.plain[e]
            self.heads[at] += self.heads[e]
            if self.tag[e] in {"article", "main"} and not gone[e]:
                self.articles[e] = max(self.articles[e], self.plain[e])
            self.articles[at] = max(self.articles[at], self.articles[e])

    def path(self, e: int) -> str:
        names = []
        while e > 0:
            names.append(self.name[e])
            e = self.parent[e]
        return ">".join(reversed(names))

    def container(self) -> int:
        """The main container: down from the top, into the child with most of
        the text; an article or main element with most of it ends the way.
        Without one below, only while what is left outside is noise."""
        return self._down(True)

    def _down(self, whole: bool) -> int:
        e = 0
        children: dict[int, list[int]] = {}
        for x in range(1, len(self.tag)):
            if not self.gone[x] and self.tag[x] in BLOCK:
                children.setdefault(self.parent[x], []).append(x)
        while self.tag[e] not in {"article", "main"}:
            best = max(children.get(e, []), key=lambda x: (self.plain[x], -x), default=None)
            if best is None or self.plain[best] <= MOST * self.plain[e]:
                break
            if self.tag[best] in HEADINGS or self.tag[best] in {"p", "li", "pre", "blockquote", "ul", "ol", "table", "dl"}:
                break
            if whole and self.articles[best] <= MOST * self.plain[best]:
                if self.plain[best] < (1 - NOISE) * self.plain[0] or self.heads[e] > self.heads[best]:
                    break
            e = best
        return e

    def places(self, e: int) -> tuple[int, list[int]]:
        """64-bit hashes of an element's path, and of the paths of the blocks with
        text that stand beside it or beside an element around it."""
        hashes = [0] * len(self.tag)
        for x in range(1, len(hashes)):
            hashes[x] = xxhash.xxh3_64_intdigest(self.name[x].encode(), hashes[self.parent[x]])
        chain, own = set(), hashes[e]
        while e >= 0:
            chain.add(e)
            e = self.parent[e]
        beside = {hashes[x] for x in range(1, len(hashes)) if self.parent[x] in chain and x not in chain
                  and self.plain[x] and not self.gone[x] and self.tag[x] in BLOCK}
        return own - (1 << 63), sorted(h - (1 << 63) for h in beside)

    def _on(self, path: str) -> list[int]:
        """The elements on a path that hold text, the outermost ones."""
        if path == "":
            return [0]
        route = 0
        for name in path.split(">"):
            route = self.routes.get((route, name), -1)
        found, upto = [], -1
        for e in range(1, len(self.tag)):
            if self.route[e] == route and e > upto and self.plain[e] and not self.gone[e]:
                found.append(e)
                upto = self.last[e]
        return found

    def text(self, path: str | None, own: bool = False) -> str:
        """The blocks below the elements on ``path``, or the page's own container
        if there are none or, with ``own``, if that holds more than twice their text."""
        chosen = [] if path is None else self._on(path)
        if not chosen or own:
            box = self.container()
            if not chosen or sum(self.plain[e] for e in chosen) < MOST * self.plain[box]:
                chosen = [box]
        below = [False] * len(self.tag)
        for e in chosen:
            below[e] = True
        for e in range(1, len(below)):
            below[e] = below[e] or below[self.parent[e]]
        blocks: dict[int, list[str]] = {}
        for number, e, text, _, _ in self.pieces:
            if below[e] and not self.gone[e]:
                blocks.setdefault(number, []).append(text)
        lines = ("".join(b) for b in blocks.values())
        return "\n".join(x for x in (" ".join((html.unescape(b) if "&" in b else b).split()) for b in lines) if x)


def _marks(token: str) -> set[str]:
    """The words of a class or id inside an article, if it names a part of a page and nothing else."""
    own = WORD.findall(CAMEL.sub(" ", token).lower())
    known = {w for w in own if w in OUT_WORDS or w in WEAK_WORDS}
    return known if all(w in known or w in PARTS for w in own) else set()


def _look(tag: str, rest: str, in_article: bool) -> tuple[str, int]:
    """The generalised name of an element, and whether it is left out."""
    name, out = tag, int(tag in OUT_TAGS or tag == "header" and not in_article)
    if not rest or rest == "/":
        return name, out
    words: set[str] = set()
    classes: list[str] = []
    for key, a, b, c, bare in ATTRIBUTE.findall(rest):
        key, value = (key or bare).lower(), a or b or c
        if key in {"class", "id"}:
            for token in html.unescape(value).split():
                own = WORD.findall(CAMEL.sub(" ", token).lower())
                if in_article and tag != "article":
                    words |= _marks(token)
                elif not WRAPS.intersection(own):
                    words.update(own)
            if key == "class":
                classes = sorted({x for x in (re.sub(r"\d+", "#", v).replace(">", "") for v in value.lower().split()) if x})
        elif key == "role" and value.lower() in OUT_ROLES:
            out = 1
    if classes:
        name = tag + "." + ".".join(classes)
    if tag == "article":
        return name, int(bool(out or words & OUT_ARTICLES))
    if not out and tag not in KEEP_TAGS:
        if in_article:
            words.discard("header")  # an article's own heading
            out = 3 if words & OWN_WORDS else 1 if words - SECOND_SIGN else 4 if words else 0
        else:
            out = 3 if words & OWN_WORDS else 1 if words & OUT_WORDS else 2 if words & WEAK_WORDS else 0
    return name, out


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, chars, places = [], [], []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            e = page.container()
            paths.append(page.path(e) if page.plain[e] else None)
            chars.append(page.plain[e])
            places.append(page.places(e) if page.plain[e] else (0, []))
        yield pa.record_batch([batch.column("host"), batch.column("page"), pa.array(paths, pa.string()), pa.array(chars, pa.int64()),
                               pa.array([p for p, _ in places], pa.int64()), pa.array([b for _, b in places], pa.list_(pa.int64()))],
                              names=["host", "page", "path", "chars", "place", "beside"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source or "").text(path, own) for source, path, own in
                 zip(*(batch.column(c).to_pylist() for c in ("html", "path", "own")), strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                               pa.array([len(t) for t in texts], pa.int64())],
                              names=["page_id", "url", "text", "n_chars"])


def _rows(pages: DataFrame) -> DataFrame:
    """The pages with their host and a number that equal rows share."""
    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"),
                        F.xxhash64("page_id", "url", "html").alias("page"))


def page_votes(pages: DataFrame) -> DataFrame:
    """host, page, path of the page's main container, characters in it, the path's
    hash and those of the blocks beside it; pages without text have no vote."""
    return map_texts(_rows(pages).select("host", "page", "html"), _vote,
                     "host string, page long, path string, chars long, place long, beside array<long>", "html").filter("path IS NOT NULL")


def _won(votes: DataFrame) -> DataFrame:
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"))
    return (counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), "path")).alias("w"))
            .select("host", "w.path", (-F.col("w.v")).alias("votes")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes: the path with most votes; of equal ones that with
    most text, then the first in order."""
    return _won(page_votes(pages))


def _own_pages(votes: DataFrame, winners: DataFrame) -> DataFrame:
    """Pages (their numbers) whose container's path lost, but has more votes than
    it stands beside the containers of other pages of the host."""
    lost = votes.select("host", "page", "path", "place").join(winners, ["host", "path"], "left_anti")
    said = lost.groupBy("host", "place").agg(F.count(F.lit(1)).alias("n"))
    passed = (votes.select("host", F.explode("beside").alias("place")).groupBy("host", "place").agg(F.count(F.lit(1)).alias("m")))
    good = said.join(passed, ["host", "place"], "left").filter(F.col("n") > F.coalesce("m", F.lit(0)))
    return lost.join(good, ["host", "place"], "left_semi").select("page").distinct()


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html, ...): page_id, url,
    text, n_chars.

    Character references are decoded, white space inside a block is one space,
    blocks stand in page order, one line each.  Null html counts as empty and
    gives an empty text; a null or odd url belongs to the host ''.  Repeated
    rows vote each.  Markup that never ends runs to the end of the page.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    votes = stored(page_votes(pages), "page-votes")
    winners = stored(_won(votes), "host-paths").select("host", "path")
    own = stored(_own_pages(votes, winners), "own-pages").withColumn("own", F.lit(True))
    # Stored tables of known size: Spark broadcasts them where small, and splits a large host's pages elsewhere.
    rows = _rows(pages).join(winners, "host", "left").join(own, "page", "left")
    return map_texts(rows.select("page_id", "url", "html", "path", F.coalesce("own", F.lit(False)).alias("own")), _extract,
                     "page_id long, url string, text string, n_chars long", "html")
