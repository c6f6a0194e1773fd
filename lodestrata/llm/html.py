"""Main text of web pages by equivalence-class template deduction (operator 3).

A page is a sequence of tokens: tags and text runs, each told apart by its
role, the path of the containers that it stands in.  Over the pages of a host,
tokens with the same occurrence vector (their count in every page) form an
equivalence class; classes of two tokens or more that are frequent are valid.
Valid classes nest, each in the slot behind the token of another class that
opens its innermost container, and so make up the host's template.

What a template leaves open are its slots.  A slot holds the article if its
text differs from page to page and isn't made of links; the article's
container is the deepest one that holds most of such text of the host.  Text
in it that the template repeats, and containers in it that hold mostly
repeated text or links, are frame, as is all text outside.  Marks and names of
containers (aside, class "advert") only tell further boilerplate apart inside
of it; they don't find it.  Pages of hosts with few pages, and pages without
their template's container, are read as a host of one page.
"""
from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, ship

SALTS = 32
#: Share of a host's pages in which a template token stands, and the fewest pages to deduce from.
SUPPORT, MIN_PAGES = 0.5, 3
#: Share of pages from which a repeated text is frame within the article too, and the fewest pages for that.
CONSTANT, CONSTANT_PAGES = 0.8, 5
#: A text found on up to this share of a host's pages, or on one, is fresh.
FRESH = 0.05
#: The article's container holds this share of the fresh text; a container around it may add half of that to be taken for it.
MOST, EXTRA = 0.6, 0.5
#: Templates of up to so many tokens in all (some 16 MB) are broadcast; more meet their pages in a join.
BROADCAST_TOKENS = 200_000

_ATTRS = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?>"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|"[^"<]*+"(?=[a-zA-Z-]+=)|'[^'<]*+'(?=[a-zA-Z-]+=)|[^\s>]*+))?+|=)*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<(noscript|template|textarea|svg|math|iframe|select|title|object|canvas)\b{_ATTRS}>.*?</\2\s*>|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})>|</?[a-zA-Z][^>]*\Z|[^<]+|<",
    re.S | re.I,
)
ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements that are containers with or without marks; others are with marks.
SECTIONS = frozenset("html head body nav header footer main article section aside div form ul ol dl table title button label dialog menu details fieldset".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 div li ul ol dl dt dd table tr td th section article main blockquote pre hr figure figcaption address details summary fieldset aside nav header footer form body title caption dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings that an article begins with.
TITLES = frozenset(("h1", "h2"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Blocks that a block of the same kind, or the end of the list or row around it, closes.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
MAIN = ("article", "main")
#: Names and marks of boilerplate inside of an article.  A mark counts if all its words are among these and the neutral ones.
DROP = frozenset("head nav footer aside form title button label dialog menu".split())
DROP_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
NEUTRAL = frozenset("area article articles bar body bottom box button buttons col column container content form global group icons inner item items left links list main outer page post posts primary right row secondary section signup site slot stories text top unit wrap wrapper".split())

TAG, CONTAINER, TEXT, HEADING = 0, 1, 2, 3
_CLOSED = 0x2AAAAAAAAAAAAAAA
_WORDS = re.compile(r"[a-z]+|[0-9]+")


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) >> 1


def marks(attrs: str) -> tuple[str, bool]:
    """The class, id and role of a tag as one string, numbers of three digits or more made alike; and whether one of them names boilerplate."""
    out, cue = [], False
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                words = ["0" if len(w) > 2 and w[0].isdigit() else w for w in _WORDS.findall(token)]
                out.append("-".join(words) or token)
                hit = [w for w in words if w in DROP_WORDS]
                cue = cue or bool(hit) and all(w in DROP_WORDS or w in NEUTRAL or w[0].isdigit() for w in words)
    return ".".join(out), cue


class Page:
    """A page's containers and events.

    Container 0 is the page.  Parallel lists tell of each: its name, role,
    parent and whether it is marked as boilerplate.  Events are (kind, container,
    token or text, in a link): kind is TAG for the borders of blocks, HEADING
    for those of headings, CONTAINER for the borders of containers (the token
    is 0 where one ends without its tag) and TEXT; "br" is a TAG of token -1."""

    _roles: dict = {}

    def __init__(self, page: str):
        self.names, self.roles, self.parents, self.cues, self.keys = [""], [0], [-1], [False], [""]
        self.events: list[tuple] = []
        self.titles: set[int] = set()
        self._read(page)

    def _role(self, parent: int, key: str) -> int:
        if len(self._roles) > 100_000:
            self._roles.clear()
        if (got := self._roles.get((parent, key))) is None:
            got = self._roles[parent, key] = _hash(f"{parent:x}>{key}")
        return got

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # name, container, whether it lies within a block
        add, known, link, inner = self.events.append, {}, 0, 0
        here = lambda: stack[-1][1] if stack else 0

        def drop(to: int) -> None:
            nonlocal inner
            while len(stack) > to:
                _, c, within = stack.pop()
                inner -= within
                add((CONTAINER, c, 0, False))

        def push(name: str, attrs: str, within: bool, mark: str, cue: bool) -> None:
            nonlocal inner
            key, at = f"{name}.{mark}", here()
            self.names.append(name)
            self.keys.append(key)
            self.roles.append(self._role(self.roles[at], key))
            self.parents.append(at)
            self.cues.append(cue or name in DROP)
            stack.append((name, len(self.names) - 1, within))
            inner += within
            add((CONTAINER, stack[-1][1], self.roles[-1], False))

        for m in TOKEN.finditer(page):
            name = m.group(4)
            if name is None:
                s = m.group()
                if s[0] != "<" or s == "<":
                    add((TEXT, here(), s, link > 0))
                continue
            name = name.lower()
            block = name in BLOCKS
            if block and inner:  # what lies within a block ends with it
                drop(next(i for i, x in enumerate(stack) if x[2]))
            if m.group(3):
                if name == "a":
                    link = 0
                at = len(stack) - 1
                if name in SECTIONS or stack and (inner or name in known):
                    while at >= 0 and stack[at][0] != name and (block or stack[at][2]):
                        at -= 1
                    if at >= 0 and stack[at][0] == name:
                        c = stack[at][1]
                        add((CONTAINER, c, self.roles[c] ^ _CLOSED, False)) if self.names[c] == name else None
                        drop(at)
                if block:
                    add((TAG, here(), known.get((name, here())) or known.setdefault((name, here()), self._role(self.roles[here()], "/" + name)), False))
                continue
            if name not in IN_HEAD and stack and stack[-1][0] in ("head", "title"):
                drop(next(i for i, x in enumerate(stack) if x[0] in ("head", "title")))
            if name in ITEMS:
                at = len(stack) - 1
                if at >= 0 and stack[at][0] in ITEMS[name]:
                    drop(at)
            if name in MAIN:  # an article doesn't stand in a menu: that menu was left open
                bad = next((i for i, x in enumerate(stack) if self.cues[x[1]]), None)
                if bad is not None:
                    drop(bad)
            attrs = m.group(5)
            mark, cue = marks(attrs) if attrs and not attrs.isspace() else ("", False)
            if name == "a":
                link = 1
            if name in VOID:
                if name == "br":
                    add((TAG, here(), -1, False))
                elif block:
                    add((TAG, here(), 0, False))
                continue
            if name in SECTIONS or mark and name != "a":
                known[name] = True
                push(name, attrs, name not in SECTIONS and (not block or name[0] in "ph"), mark, cue)
            elif inner and any(x[2] and x[0] == name for x in stack):
                stack.append((name, here(), True))
                inner += 1
            if block and name not in SECTIONS:
                key = ("+" + name, here())
                token = known.get(key) or known.setdefault(key, self._role(self.roles[here()], "+" + name))
                add((HEADING if name in HEADINGS else TAG, here(), token, False))
                if name in TITLES:
                    self.titles.add(token)
        drop(0)

    def up(self, c: int) -> list[int]:
        """Roles of a container and those around it."""
        out = []
        while c > 0:
            out.append(self.roles[c])
            c = self.parents[c]
        return out

    def text_token(self, c: int, text: str) -> int:
        return _hash(f"{self.roles[c]:x}={text}")

    def tokens(self) -> dict[int, list]:
        """Of each token: its count, first place, kind, the containers around it (roles, the innermost first), characters, those in links, and flags.

        A container's flags are 1 if it is marked as boilerplate, 2 for an article's tag, 4 for the whole page's; those of a title are 8."""
        out: dict[int, list] = {}
        ups: dict[int, list] = {}
        for i, (kind, c, token, link) in enumerate(self.events):
            if kind == TEXT:
                token = " ".join(token.split())
                if not token:
                    continue
                chars, flags, token = len(token), 0, self.text_token(c, token)
            else:
                if token in (0, -1):
                    continue
                chars = flags = 0
                if kind == CONTAINER:
                    flags = self.cues[c] | (self.names[c] in MAIN) << 1 | (self.names[c] in ("html", "body")) << 2
                elif kind == HEADING:
                    flags = (token in self.titles) << 3
            got = out.get(token)
            if got is None:
                if c not in ups:
                    ups[c] = self.up(c)
                out[token] = [1, i, kind if kind != CONTAINER or token == self.roles[c] else TAG, ups[c], chars, chars * link, flags]
            else:
                got[0] += 1
        return out


class Template:
    """What a host's pages have in common: valid classes, their nesting, and which of their slots hold the article."""

    def __init__(self, n_pages: int, rows: list[tuple]):
        """rows: (token, kind, pages, v1, v2, at, up, flags, fresh, pooled, fixed, link).

        The last four count the characters of a container's own text: of texts
        on a page or few, on several, on CONSTANT of the pages; in links."""
        by: dict[tuple, list[tuple]] = {}
        for r in rows:
            by.setdefault((r[2], r[3], r[4]), []).append(r)
        #: valid classes, their tokens by mean place
        self.classes = [sorted(c, key=lambda r: r[5]) for c in by.values() if len(c) > 1]
        valid = [r for c in self.classes for r in c]
        self.containers = {0: (0, 0, 4)} | {r[0]: (next((u for u in r[6][1:]), 0), r[2], r[7]) for r in valid if r[1] == CONTAINER}
        place = {r[0]: r[5] for r in valid} | {0: -1.0}
        around = {r[0]: r[6] for r in valid if r[1] == CONTAINER}
        #: of each valid container the one around it
        self.parent = {c: next((u for u in around[c][1:] if u in self.containers), 0) for c in self.containers if c}
        self.order = sorted(self.parent, key=lambda c: len(around[c]))
        #: nesting: of each class the container in whose slot it lies, the innermost around its tokens that is of another class
        self.slot_of = []
        for c in self.classes:
            own, inner = {r[0] for r in c}, min(c, key=lambda r: (len(r[6]), r[5]))
            self.slot_of.append(next((u for u in inner[6] if u in self.containers and u not in own), 0))
        text = {c: [0, 0, 0, 0] for c in self.containers}
        for r in rows:
            if r[1] == CONTAINER and any(r[8:11]):
                c = r[0] if r[0] in self.containers else next((u for u in r[6] if u in self.containers), 0)
                text[c] = [a + b for a, b in zip(text[c], r[8:12])]
        whole = {c: list(t) for c, t in text.items()}
        for c in reversed(self.order):
            whole[self.parent[c]] = [a + b for a, b in zip(whole[self.parent[c]], whole[c])]
        repeats = lambda t: n_pages >= MIN_PAGES and (t[1] > t[0] or not t[0] or 2 * t[3] > sum(t[:3]))
        #: containers of mostly repeated text or links, and those marked as boilerplate
        self.frame = {c for c in self.parent if self.containers[c][2] & 1 or any(whole[c]) and repeats(whole[c])}
        weight = {c: 0 if repeats(t) else max(0, t[0] - t[3]) for c, t in text.items()}
        for c in reversed(self.order):
            if c not in self.frame:
                weight[self.parent[c]] += weight[c]
        self.main = self._article(n_pages, weight, {r[6][0] for r in valid if r[7] & 8 and r[6]})
        self.inside = {c for c in self.parent if self._within(c)}
        #: texts in the article that the template repeats; a block of nothing else, if no heading, is a notice
        self.constants = {r[0] for r in valid if r[1] == TEXT and n_pages >= CONSTANT_PAGES and r[2] >= CONSTANT * n_pages and (not r[6] or r[6][0] in self.inside or r[6][0] in self.main)}
        self.place = place

    def _within(self, c: int) -> bool:
        while c:
            c = self.parent[c]
            if c in self.main:
                return True
        return False

    def _article(self, n_pages: int, weight: dict, headed: set) -> set:
        """The article's containers: the deepest that holds MOST of the fresh text, or one around it with the heading; empty if there is no fresh text."""
        total = weight[0]
        if not total:
            return set()
        marked = {c for c in self.parent if self.containers[c][2] & 2 and weight[c] and not self._marked(c)}
        if n_pages < MIN_PAGES and marked:
            return marked
        at = 0
        children: dict[int, list] = {}
        for c, p in self.parent.items():
            if c not in self.frame:
                children.setdefault(p, []).append(c)
        while best := max(children.get(at, ()), key=lambda c: (weight[c], c), default=None):
            if weight[best] < MOST * total:
                break
            at = best
        if self.containers[at][2] & 4 and marked:  # no container holds most of it: go by the article's tag
            return marked
        under = lambda c, top: c == top or c in self.parent and under(self.parent[c], top)
        has = lambda top: any(under(c, top) for c in headed if c in self.containers)
        a, best, need = self.parent.get(at, 0), at, not has(at)
        while a and not self.containers[a][2] & 4 and weight[a] <= (1 + EXTRA) * weight[at]:
            if self.containers[a][2] & 2 or need and has(a):
                best, need = a, need and not has(a)
            a = self.parent[a]
        return {best}

    def _marked(self, c: int) -> bool:
        while c:
            if self.containers[c][2] & 1:
                return True
            c = self.parent[c]
        return False

    def states(self, page: Page) -> list[bool] | None:
        """Of each of a page's containers whether its own text is the article's; None if the page lacks the article's container."""
        n = len(page.names)
        if not self.main or 0 not in self.main and not self.main.intersection(page.roles):
            return None
        wide = any(m == 0 or self.containers[m][2] & 4 for m in self.main)
        IN, OUT, GONE = 1, 0, 2
        out = [IN if 0 in self.main else OUT] + [OUT] * (n - 1)
        for c in range(1, n):
            role, p = page.roles[c], page.parents[c]
            if role in self.main and out[p] != GONE:
                out[c] = IN
            elif out[p] != IN:
                out[c] = out[p]
            elif page.cues[c] or role in self.frame or wide and page.names[c] == "header":
                out[c] = GONE
            else:
                out[c] = IN if role in self.containers or not self._beyond(page, c) else OUT
        return [x == IN for x in out]

    def _beyond(self, page: Page, c: int) -> bool:
        """Whether a container is the template's behind the article, which its page left open."""
        a = page.parents[c]
        while a > 0:
            out = page.roles[page.parents[a]]
            r = page._role(out, page.keys[c])
            if r in self.containers and r not in self.inside and r not in self.main and any(self.place[r] > self.place[m] for m in self.main if m in self.place):
                return True
            if page.roles[a] in self.main:
                return False
            a = page.parents[a]
        return False


def _alone(page: Page) -> Template:
    """The template of a page by itself."""
    own: dict[int, list] = {}
    tokens = page.tokens()
    for n, _, kind, up, chars, link, _ in tokens.values():
        if kind == TEXT:
            t = own.setdefault(up[0] if up else 0, [0, 0, 0, 0])
            t[0] += n * chars
            t[3] += n * link
    rows = [(t, kind, 1, 0, 0, at, up, flags, *(own.get(t, (0, 0, 0, 0)) if kind == CONTAINER else (0, 0, 0, 0))) for t, (n, at, kind, up, _, _, flags) in tokens.items()]
    return Template(1, rows + [(0, CONTAINER, 1, 0, 0, -1, [0], 4, *own.get(0, (0, 0, 0, 0)))])


def extract(page: str | None, template: Template | None = None) -> str:
    """The article's blocks, one a line; empty for null and for pages without text."""
    if not page:
        return ""
    p = Page(page)
    kept = template.states(p) if template else None
    constants = template.constants if kept and template else ()
    if kept is None:
        kept = _alone(p).states(p)
        if kept is None:
            return ""
    out: list[str] = []
    part: list[str] = []
    own = heading = False  # whether the block has text that the template doesn't repeat, or is a heading

    def flush() -> None:
        nonlocal own
        text = " ".join(html.unescape("".join(part)).split())
        if text and (own or heading):
            out.append(text)
        part.clear()
        own = False

    for kind, c, token, _ in p.events:
        if kind == TEXT:
            if kept[c]:
                part.append(token)
                own = own or not token.isspace() and not (constants and p.text_token(c, " ".join(token.split())) in constants)
        elif kind == CONTAINER and p.names[c] not in BLOCKS:
            continue
        elif token == -1:
            part.append(" ")
        else:
            if part:
                flush()
            heading = kind == HEADING
    flush()
    return "\n".join(out)


def host_of(url):
    """The url's host in lower case; empty for null and for what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, support: float = SUPPORT, least: int = MIN_PAGES) -> DataFrame:
    """(host, n_pages, template): the host's frequent tokens with their occurrence vectors' digests and their containers' text.

    The vectors are folded into two order-free sums, so that a host with any
    number of pages is aggregated in parts.  What is gathered per host are
    tokens found in the share `support` of its pages: no more than 1/support
    times a page's own."""

    def emit(batches):
        names = ("host", "token", "n", "at", "kind", "up", "chars", "link", "flags", "key")
        kinds = dict(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int64())))
        for b in batches:
            cols: dict[str, list] = {n: [] for n in names}
            for host, page, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = Page(page or "").tokens()
                own[-1] = [1, 0, TAG, [], 0, 0, 0]
                n = len(own)
                cols["host"] += [host] * n
                cols["token"] += own
                cols["key"] += [key] * n
                for name, values in zip(("n", "at", "kind", "up", "chars", "link", "flags"), zip(*own.values())):
                    cols[name] += values
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], kinds[n]) for n in names], list(names))

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").alias("page"), F.xxhash64("page_id", "url", "html").alias("key"))
    rows = rows.mapInArrow(emit, "host string, token long, n long, at long, kind int, up array<long>, chars long, link long, flags int, key long")
    h = F.xxhash64("key", "n")
    per = rows.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum(F.shiftrightunsigned(h, 32)).alias("v1"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v2"), F.avg("at").alias("at"), F.max("kind").alias("kind"),
        F.min("up").alias("up"), F.max("flags").alias("flags"), F.sum(F.col("n") * F.col("chars")).alias("chars"), F.sum(F.col("n") * F.col("link")).alias("link"))
    per = cut(per)
    n = per.where("token = -1").select("host", F.col("pages").alias("n_pages")).where(F.col("n_pages") >= least)
    # a host's tokens are spread; its number of pages goes to each part
    salted = n.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = per.where("token <> -1").withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    often = known.where((F.col("pages") > 1) & (F.col("pages") >= support * F.col("n_pages")))
    fresh = (F.col("pages") == 1) | (F.col("pages") <= FRESH * F.col("n_pages"))
    fixed = ~fresh & (F.col("pages") >= CONSTANT * F.col("n_pages"))
    total = lambda c, name: F.sum(F.when(c, F.col("chars")).otherwise(0)).alias(name)
    text = known.where(F.col("kind") == TEXT).groupBy("host", "up").agg(total(fresh, "fresh"), total(~fresh & ~fixed, "pooled"), total(fixed, "fixed"), F.sum("link").alias("link"))
    # a text counts for the innermost frequent container around it
    box = often.where(F.col("kind") == CONTAINER).select("host", F.col("token").alias("box"))
    text = text.select("*", F.posexplode(F.concat("up", F.array(F.lit(0).cast("long")))).alias("i", "box")).join(box.union(n.select("host", F.lit(0).cast("long"))), ["host", "box"])
    text = text.groupBy("host", "up", "fresh", "pooled", "fixed", "link").agg(F.min_by("box", "i").alias("token"))
    text = text.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("fresh", "pooled", "fixed", "link")])
    often = often.select("host", "n_pages", "token", "kind", "pages", "v1", "v2", "at", "up", "flags")
    root = n.select("host", "n_pages", F.lit(0).cast("long"), F.lit(CONTAINER), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(-1.0), F.array(F.lit(0).cast("long")), F.lit(4))
    zero = F.lit(0).cast("long")
    both = often.union(root).join(text, ["host", "token"], "left").select("host", "n_pages", F.struct("token", "kind", "pages", "v1", "v2", "at", "up", "flags", *[F.coalesce(c, zero).alias(c) for c in ("fresh", "pooled", "fixed", "link")]).alias("t"))
    return both.groupBy("host", "n_pages").agg(F.collect_list("t").alias("template"))


def extract_pages(pages: DataFrame, salts: int = SALTS, most: int = BROADCAST_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    Null and empty html give empty text; a null url is a host of its own.
    Hosts of fewer than MIN_PAGES pages have no template; their pages are read
    by themselves.  Rows with equal page_id each give a row; other columns are
    ignored; an empty table gives an empty table.  Templates of up to `most`
    tokens in all are broadcast, so that no html is shuffled; with more, pages
    meet their host's template by (host, salt), so that a host with many pages
    is spread."""
    t = cut(templates(pages))
    size = t.agg(F.sum(F.size("template"))).first()[0] or 0
    slim = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    shared = ship(pages.sparkSession, {r["host"]: (r["n_pages"], [tuple(x) for x in r["template"]]) for r in t.collect()}) if size <= most else None
    if not shared:
        salted = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        slim = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "host", "n_pages", "template")

    def run(batches):
        known: dict[str, Template | None] = {}
        for b in batches:
            text = []
            for i, host in enumerate(b.column(3).to_pylist()):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    got = shared().get(host) if shared else (b.column(4)[i].as_py(), [tuple(x.values()) for x in b.column(5)[i].as_py()]) if b.column(4)[i].is_valid else None
                    known[host] = Template(*got) if got else None
                text.append(extract(b.column(2)[i].as_py(), known[host]))
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(text, pa.string()), "n_chars": np.array([len(x) for x in text], np.int64)})

    kinds = dict(pages.dtypes)
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


#: For pages whose article closes and holds paragraphs and headings only: a check that knows no templates.
SQL = r"""
WITH cut AS (SELECT page_id, url, string_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '</?(?:p|h[1-6])>') AS parts FROM pages),
bare AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS parts FROM cut),
texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS text FROM bare)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
