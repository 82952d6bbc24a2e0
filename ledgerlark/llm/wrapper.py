"""Main text of web pages by wrapper induction.

The DOM trees of all pages of each host are aligned by simple tree matching
into one wrapper: a node whose text is the same on most of its pages is
template, text that varies is content, and the element that holds most of the
varying text is the host's main region.  Every page is then aligned with its
host's wrapper.  Wrappers of parts of a host are trees too, so they are matched
and added up in the same way, part by part, until a host has one.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .urls import url_host

PART = 1_000_000            # characters of pages that one task makes a wrapper of
FAN = 16                    # wrappers of one host that one task adds up
ALIKE = 3                   # different pages that must show a text before it is template
RARE = 0.01                 # a node on fewer of its parent's pages is no part of the wrapper
TRIM = 200                  # pages after which a growing wrapper is trimmed of rare nodes
MAJOR = 0.6                 # share of the varying text that makes a child the main region

# HTML elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike "
             "strong sub sup tt u var wbr time data".split())
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
             "p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
          "th": {"table", "tr"}, "option": {"select"}}
NOISE_TAGS = set("head script style noscript template nav header footer aside form button select textarea "
                 "input iframe object svg canvas menu dialog title xmp noembed noframes".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
NOISE_WORDS = set("nav navbar menu ad ads advert adverts advertisement sponsor sponsored promo promotion banner "
                  "sidebar cookie cookies consent notice popup modal newsletter subscribe signup comment comments "
                  "reply replies share sharing social related breadcrumb breadcrumbs header footer masthead "
                  "disqus widget".split())
# words that say where or how a block stands, not what it is
PLACE_WORDS = set("site page main global top bottom left right inner outer first last wrap wrapper container content "
                  "box block bar area section list item items links link row col column group panel inline "
                  "text body title button buttons icon icons thread primary secondary small large the of "
                  "and js ui".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


class Text(str):
    """Text of a page; every piece is an object of its own."""


def names_noise(names: str) -> bool:
    """Whether a class or id is that of a menu, notice, advert or the like: all
    its words say so, or where it stands (``site-header``, not ``share-price-story``)."""
    for name in names.split():
        words = set(re.findall(r"[a-z]+", name))
        if not NOISE_WORDS.isdisjoint(words) and words <= NOISE_WORDS | PLACE_WORDS:
            return True
    return False


class Node:
    """An element; its kids are elements and text.  ``flat``: no blocks inside."""
    __slots__ = ("tag", "sig", "noise", "kids", "flat")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids = tag, []
        self.flat = tag in INLINE or tag in VOID
        self.sig, self.noise = tag, tag in NOISE_TAGS
        if attrs:
            found = {k.lower(): v.strip("\"'").lower() for k, v in ATTR.findall(attrs)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            words = [w for w in re.split(r"[^a-z]+", names) if w]
            if words:
                self.sig = f"{tag}.{'.'.join(sorted(set(words)))}"
            self.noise = (self.noise or names_noise(names) or found.get("role") in NOISE_ROLES
                          or "hidden" in found or found.get("aria-hidden") == "true"
                          or "display:none" in found.get("style", "").replace(" ", ""))


def parse(page: str) -> Node:
    """The DOM tree, tolerant of unclosed and stray tags."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text:
            stack[-1].kids.append(Text(entities.unescape(text)))
        if not m:
            break
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPES[tag]:
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if not node.flat or (node.noise and tag not in VOID):
            node.flat = False
            for k in range(len(stack) - 1, 0, -1):
                if not stack[k].flat:
                    break
                stack[k].flat = False
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            node.kids.append(Text(page[at:end.start() if end else size]))
            at = page.find(">", end.start()) + 1 if end else size
            at = at or size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def plain(kids, out: list[str], skip: set[int] = frozenset()) -> None:
    """Text of ``kids`` without noise elements; blocks stand apart."""
    work = [iter(kids)]
    tails = [""]
    while work:
        kid = next(work[-1], None)
        if kid is None:
            work.pop()
            out.append(tails.pop())
        elif id(kid) in skip:
            out.append(" ")
        elif isinstance(kid, str):
            out.append(kid)
        elif not kid.noise:
            edge = "" if kid.tag in INLINE else " "
            out.append(edge)
            work.append(iter(kid.kids))
            tails.append(edge)


def tidy(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Fold:
    """A tree for matching.  Runs of siblings of one kind become at most three
    nodes, the first, the last and those between, so that what stands at either
    end of a run can be aligned; text and inline elements side by side are one
    node.  Only a single member's blocks are matched further."""
    __slots__ = ("sig", "members", "kids", "noise", "tag")

    def __init__(self, members: list, sig: str, depth: int = 0):
        first = members[0]
        self.members, self.kids, self.sig = members, [], sig
        self.tag = "#text" if sig == "#text" else first.tag
        self.noise = sig != "#text" and first.noise
        if len(members) > 1 or sig == "#text" or self.noise or depth >= 60:
            return
        runs: list = []
        for kid in first.kids:
            if isinstance(kid, str) and not kid.strip():
                continue
            kind = "#text" if isinstance(kid, str) or kid.flat else kid.sig
            if runs and kind == runs[-1][0]:
                runs[-1][1].append(kid)
            else:
                runs.append((kind, [kid]))
        if any(kind != "#text" for kind, _ in runs):
            for kind, run in runs:
                if len(run) == 1 or kind == "#text":
                    self.kids.append(Fold(run, kind, depth + 1))
                else:
                    self.kids.append(Fold(run[:1], kind + "^", depth + 1))
                    if len(run) > 2:
                        self.kids.append(Fold(run[1:-1], kind + "*", depth + 1))
                    self.kids.append(Fold(run[-1:], kind + "$", depth + 1))

    def text(self) -> str:
        if self.noise:
            return ""
        parts: list[str] = []
        plain(self.members, parts)
        return tidy(parts)


def match(a, b) -> tuple[int, list]:
    """Simple tree matching: the largest order-keeping alignment of two trees
    whose roots have one signature, as (size, matched pairs)."""
    rows, cols = a.kids, b.kids
    if not rows or not cols:
        return 1, [(a, b)]
    best = [[0] * (len(cols) + 1) for _ in range(len(rows) + 1)]
    sub: dict = {}
    for i, x in enumerate(rows, 1):
        for j, y in enumerate(cols, 1):
            most = max(best[i - 1][j], best[i][j - 1])
            if x.sig == y.sig:
                sub[i, j] = match(x, y)
                most = max(most, best[i - 1][j - 1] + sub[i, j][0])
            best[i][j] = most
    pairs, i, j = [(a, b)], len(rows), len(cols)
    while i and j:
        if (i, j) in sub and best[i][j] == best[i - 1][j - 1] + sub[i, j][0]:
            pairs += sub[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], pairs


class Slot:
    """A node of a wrapper: on how many pages it was seen, with how much text,
    and the text that may be on most of them.

    ``digest`` and ``votes`` are a majority vote: a page with that text adds a
    vote, another one takes it away, and two votes are added up alike.  More
    votes than half of ``seen`` prove that most pages show the text; a text on
    three quarters of them or more always has that many."""
    __slots__ = ("sig", "tag", "noise", "seen", "digest", "votes", "mass", "kids", "main", "fixed")

    def __init__(self, sig, tag="", noise=False, seen=1, digest=0, votes=1, mass=0, kids=(), main=False):
        self.sig, self.tag, self.noise, self.seen, self.digest = sig, tag, noise, seen, digest
        self.votes, self.mass, self.kids, self.main, self.fixed = votes, mass, list(kids), main, False

    @classmethod
    def of(cls, fold: Fold) -> "Slot":
        text = "" if fold.kids else fold.text()
        return cls(fold.sig, fold.tag, fold.noise, 1, zlib.crc32(text.encode("utf-8", "replace")), 0 if fold.kids else 1,
                   len(text), [cls.of(k) for k in fold.kids])

    def steady(self) -> bool:
        """Whether most pages of the node show one text in all that is below it."""
        if not self.kids:
            return self.votes >= ALIKE and 2 * self.votes > self.seen
        return all(2 * k.seen > self.seen and k.steady() for k in self.kids)

    def settle(self, parent: int) -> None:
        """Marks the template: steady nodes that most pages of their parent have."""
        if self.steady():
            work = [self] if 2 * self.seen > parent else []
            while work:
                s = work.pop()
                s.fixed = not s.kids
                work += s.kids
        else:
            for k in self.kids:
                k.settle(self.seen)

    def add(self, other: "Slot") -> None:
        """Adds a tree of the same signature: matched nodes add up, new ones are put
        behind their matched neighbour."""
        pairs = match(other, self)[1]
        to = {id(x): y for x, y in pairs}
        for x, y in pairs:
            y.seen += x.seen
            y.mass += x.mass
            if x.digest == y.digest:
                y.votes += x.votes
            elif x.votes > y.votes:
                y.digest, y.votes = x.digest, x.votes - y.votes
            else:
                y.votes -= x.votes
            place = 0
            for kid in x.kids:
                known = to.get(id(kid))
                if known is not None:
                    place = next(k for k, s in enumerate(y.kids) if s is known) + 1
                else:
                    y.kids.insert(place, kid)
                    place += 1

    def trim(self) -> None:
        """Leaves out nodes that are rare on their parent's pages; their text is content."""
        self.kids = [k for k in self.kids if k.seen >= RARE * self.seen]
        for k in self.kids:
            k.trim()

    def dump(self) -> list:
        return [self.sig, self.tag, int(self.noise), self.seen, self.digest, self.votes, self.mass,
                [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, packed: list) -> "Slot":
        *own, kids = packed
        return cls(*own, [cls.load(k) for k in kids])

    def pack(self) -> list:
        return [self.sig, int(self.main), self.digest if self.fixed else None, [k.pack() for k in self.kids]]

    @classmethod
    def unpack(cls, packed: list) -> "Slot":
        sig, main, digest, kids = packed
        return cls(sig, digest=digest, main=bool(main), kids=[cls.unpack(k) for k in kids])


def induce(pages: list[str]) -> str:
    """The wrapper of the different pages of a part of a host, as JSON."""
    return gather(Slot.of(Fold([parse(p)], "#root")) for p in sorted(set(pages)))


def gather(trees) -> str:
    """One wrapper of several trees."""
    wrapper, since = None, 0
    for tree in trees:
        if wrapper is None:
            wrapper = tree
            continue
        wrapper.add(tree)
        since += tree.seen
        if since >= TRIM:
            wrapper.trim()
            since = 0
    return json.dumps(wrapper.dump(), separators=(",", ":"))


def finish(packed: str) -> str:
    """A host's whole wrapper with its template text and main region only."""
    wrapper = Slot.load(json.loads(packed))

    def varying(s: Slot) -> int:
        own = 0 if s.noise or s.fixed else s.mass
        s.mass = 0 if s.noise else own + sum(varying(k) for k in s.kids)
        return s.mass

    wrapper.settle(wrapper.seen)
    varying(wrapper)
    main = wrapper
    while main.tag not in ("article", "main"):
        inner = [k for k in main.kids if k.kids and k.sig[-1] not in "^*$" and k.tag not in INLINE
                 and k.mass >= MAJOR * main.mass]
        if not inner or not main.mass:
            break
        main = max(inner, key=lambda k: k.mass)
    main.main = True
    return json.dumps(wrapper.pack(), separators=(",", ":"))


def extract(page: str | None, wrapper: Slot | None) -> str:
    """Main text of one page, by its host's wrapper."""
    if not page:
        return ""
    tree = parse(page)
    parts: list[str] = []
    region, skip = tree, set()
    if wrapper is not None:
        pairs = match(Fold([tree], "#root"), wrapper)[1]
        region = next((x.members[0] for x, y in pairs if y.main), tree)
        for x, y in pairs:                                  # template text in its place
            if not x.kids and y.digest is not None and zlib.crc32(x.text().encode("utf-8", "replace")) == y.digest:
                skip.update(id(m) for m in x.members)
    plain(region.kids, parts, skip)
    text = tidy(parts)
    if not text and skip:                                   # a page of template only is kept as it is
        parts = []
        plain(region.kids, parts)
        text = tidy(parts)
    return text


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              part: int = PART) -> DataFrame:
    """Main text of every page: page_id, url, text and n_chars (code points).

    All pages of a host give its wrapper, equal ones once: pages are dealt by
    host and hash into parts of about ``part`` characters, however large the
    host, and the parts' wrappers are added up FAN at a time.  Every page is
    then aligned with its host's wrapper (one row per host).  A null url or one
    without a host belongs to the empty host; a null or empty html gives an
    empty text.  A host of fewer than ALIKE pages has no template text.
    Elements that are navigation, headers, footers, sidebars, notices, adverts,
    forms, scripts or comments by element, role or a whole class or id name go
    also where their text varies.  Repeated rows stay; other columns are
    ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("host", url_host(F.col("url")))
    some = rows.where("html is not null").withColumn("at", F.xxhash64("html"))
    sizes = materialize(some.groupBy("host").agg(
        F.ceil(F.sum(F.length("html")) / part).cast("int").alias("parts")), "host-sizes")
    dealt = some.join(sizes.where("parts > 1"), "host", "left").select(
        "host", "html", F.pmod("at", F.coalesce("parts", F.lit(1))).cast("int").alias("part"))

    def learn(key, frame):
        return pd.DataFrame({"host": [key[0]], "part": [key[1]], "wrapper": [induce(list(frame["html"]))]})

    def add(key, frame):
        packed = [w for _, w in sorted(zip(frame["part"], frame["wrapper"]))]
        return pd.DataFrame({"host": [key[0]], "part": [key[1]],
                             "wrapper": [gather(Slot.load(json.loads(w)) for w in packed)]})

    kind = "host string, part int, wrapper string"
    wrappers = materialize(dealt.groupBy("host", "part").applyInPandas(learn, kind), "wrappers")
    most = sizes.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        several = wrappers.groupBy("host", F.floor(F.col("part") / FAN).cast("int").alias("part"))
        wrappers = materialize(several.applyInPandas(add, kind), "wrappers")
        most = -(-most // FAN)
    whole = F.pandas_udf(lambda ws: ws.map(finish), "string")
    wrappers = materialize(wrappers.select("host", whole("wrapper").alias("wrapper")), "wrappers")

    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Slot] = {}
        for html, wrapper in batches:
            out = []
            for page, packed in zip(html, wrapper):
                if packed is not None and packed not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[packed] = Slot.unpack(json.loads(packed))
                out.append(extract(page, known.get(packed)))
            yield pd.Series(out, dtype=object)

    reader = F.pandas_udf(read, "string").asNondeterministic()
    told = rows.join(wrappers, "host", "left").select("page_id", "url", reader("html", "wrapper").alias("text"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
