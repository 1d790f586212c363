"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template.  A token is an element's path together with the
path that came before it on the page, so a token has one role in the order of the page;
a block's text under its path is a token too.  Tokens with the same occurrence vector
over the host's pages (how often each page has them) form an equivalence class.  A vector
is represented by its size and a random projection modulo 2**64, which is a sum over
pages: classes of a host of any size come from one aggregation that combines before the
shuffle, and no task sees a host's pages together.

Classes that enough pages have are valid; their element paths nest into the host's
template, and a block of text belongs to the slot of its path.  Text that is constant
over the host and slots that hold hardly any other are template.  Pages that are copies
of one another also share text: it is content if no element of its own came and went
with it and its class makes up more than a small part of a page (``copy_share``).

What varies is content: the main container is the deepest template path that holds most
of the host's varying text, and its remaining slots are extracted.  In the container a
slot that most pages have and whose texts occur once each on the host is content whatever
its name (adverts and teasers come from a stock, so their texts repeat).  Names decide
for the other slots; elements and roles that are no text of an article (forms, menus,
scripts), hidden ones and names of reader comments, which vary as the article does, always
go.  Where no container holds most of the text, and for hosts with too few pages for a
template, elements and names decide.

Scanning is linear in the page's length, broken markup included.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

# Element and attribute names with a fixed meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
FURNITURE_TAGS = frozenset("head nav aside footer form script style noscript template button select textarea input iframe svg canvas dialog menu object audio video title".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer notice notices "
    "alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond discussion disqus form search pagination pager toolbar masthead copyright hidden".split()
)
#: Of these, the names of what readers write: it varies as the article does.
READER_NAMES = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
ARTICLE_TAGS = frozenset(("article", "main"))

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DEEPEST = 256  # elements nested deeper belong to the path at this depth
OPEN = 2048  # most open elements that are told apart
_NAME = re.compile(r"[a-z]+")


class Node:
    """An open element; ``block`` is the nearest that its text belongs to.  ``furniture`` tells
    whether elements or names speak against it, ``surely`` whether more than a name does."""

    __slots__ = ("tag", "path", "depth", "furniture", "surely", "article", "block")

    def __init__(self, tag: str, path: str, depth: int, furniture: bool, surely: bool, article: bool, parent: Node | None = None):
        self.tag, self.path, self.depth, self.furniture, self.surely, self.article = tag, path, depth, furniture, surely, article
        self.block = self if parent is None or tag not in INLINE or furniture else parent.block


def _child(parent: Node, tag: str, attrs: str) -> Node:
    furniture, surely, article, name = parent.furniture, parent.surely, parent.article, tag
    if attrs.strip(" /\t\r\n"):
        a = {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "" for m in _ATTR.finditer(attrs)}
        label = f"{a.get('class', '')} {a.get('id', '')}".strip().lower()
        if label:
            name = f"{tag}.{'.'.join(label.replace('/', ' ').split())}"
            words = set(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()))
            furniture |= bool(words & FURNITURE_NAMES) and tag not in ("html", "body", "article", "main")
            surely |= bool(words & READER_NAMES) and tag not in ("html", "body", "article", "main")
            furniture |= "header" in words and not article and tag not in ("html", "body", "article", "main")
        role = a.get("role", "").lower()
        surely |= role in FURNITURE_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
        article |= role in ("main", "article")
    surely |= tag in FURNITURE_TAGS or tag == "header" and not parent.article
    path = f"{parent.path}/{name}" if parent.depth < DEEPEST else parent.path
    return Node(tag, path, parent.depth + 1, furniture or surely, surely, article or tag in ARTICLE_TAGS, parent)


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, closing) of each tag; name is empty for comments and
    declarations.  A tag or comment that does not end takes the rest of the page."""
    at, n, closed = 0, len(page), {'"': True, "'": True}
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", "", False
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            yield start, at, "", "", False
            continue
        closing = page.startswith("/", start + 1)
        name = _TAG_NAME.match(page, start + 1 + closing)
        if name is None:  # a sign in the text
            at = start + 1
            continue
        pos = end = name.end()
        while True:
            stop = _TAG_STOP.search(page, pos)
            if stop is None:
                end = at = n
                break
            pos = stop.end()
            if stop[0] == ">":
                end, at = stop.start(), pos
                break
            # A quote opens a value only after an equals sign, and only if it is closed.
            if closed[stop[0]] and page[max(name.end(), stop.start() - 64) : stop.start()].rstrip().endswith("="):
                other = page.find(stop[0], pos)
                closed[stop[0]] = other >= 0
                pos = other + 1 if other >= 0 else pos
        yield start, at, name[0].lower(), page[name.end() : end], closing
        if not closing and name[0].lower() in RAW and at < n:  # its content is no markup
            stop = re.compile(rf"</{name[0]}\s*>", re.I).search(page, at)
            at = stop.start() if stop else n


def blocks(page: str) -> tuple[list[tuple[Node, str]], list[str]]:
    """Text blocks (innermost block element, text) in page order, and the distinct element
    paths in the order in which they open."""
    root = Node("", "", 0, False, False, False)
    stack, out, opened = [root], [], {}
    count: Counter[str] = Counter()  # open elements
    beyond: Counter[str] = Counter()  # elements opened past the bound
    text: list[str] = []
    owner = root

    def flush():
        nonlocal text
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((owner, joined))
            text = []

    def add(piece: str):
        nonlocal owner
        if not piece:
            return
        top = stack[-1].block
        if top is not owner:
            flush()
            owner = top
        text.append(entities.unescape(piece))  # a reference does not cross a tag

    def pop(to: int):
        if any(n.tag not in INLINE for n in stack[to:]):
            flush()
        count.subtract(n.tag for n in stack[to:])
        del stack[to:]

    at, raw = 0, None
    for start, end, tag, attrs, closing in tags(page):
        if raw is None:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if raw is not None and closing and tag == raw:
            raw = None
            continue
        raw = None
        if closing:
            if beyond[tag]:
                beyond[tag] -= 1
            elif count[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE:
                        break
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and count["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SIBLING and any(count[t] > 0 for t in SIBLING[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPE[tag]:
                    break
                if stack[i].tag in SIBLING[tag]:
                    pop(i)
                    break
        if tag == "br":
            add(" ")
        if len(stack) >= OPEN and tag not in VOID and tag not in RAW:
            beyond[tag] += 1
            continue
        node = _child(stack[-1], tag, attrs)
        opened.setdefault(node.path)
        if tag in VOID or attrs.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            raw = tag
            continue
        stack.append(node)
        count[tag] += 1
    if raw is None:
        add(page[at:])
    flush()
    return out, list(opened)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without its user; empty without one."""
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")), F.lit(""))


def _text_token(node: Node, text: str) -> str:
    return f"text {node.path} {xxhash.xxh64_hexdigest(text)}"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: pages, projection of the occurrence vector, characters."""
    for batch in batches:
        found: dict[tuple[str, str], list[int]] = {}
        for page, url, source, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got, opened = blocks(source or "")
            counts: dict[str, list[int]] = {"page": [1, 0]}
            before = ""
            for path in opened:
                counts[f"path {before} > {path}"] = [1, 0]
                before = path
            for node, text in got:
                for token in (_text_token(node, text), f"slot {node.path}"):
                    held = counts.setdefault(token, [0, 0])
                    held[0], held[1] = held[0] + 1, held[1] + len(text)
            weight = xxhash.xxh64_intdigest(f"{page} {url}")
            for token, (n, chars) in counts.items():
                s = found.setdefault((host, token), [0, 0, 0])
                s[0] += 1
                s[1] = (s[1] + n * weight) & 0xFFFFFFFFFFFFFFFF
                s[2] += chars
        keys = list(found)
        cols = list(zip(*found.values(), strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(cols[0], pa.int64()), pa.array(np.array(cols[1], np.uint64) >> np.uint64(32), pa.uint64()).cast(pa.int64()), pa.array(np.array(cols[1], np.uint64) & np.uint64(0xFFFFFFFF), pa.uint64()).cast(pa.int64()), pa.array(cols[2], pa.int64())],
            names=["host", "token", "pages", "high", "low", "chars"],
        )


def _by_host(rows: DataFrame, small: DataFrame, bound: int) -> DataFrame:
    """Joined on the host with one small row a host, broadcast up to ``bound`` hosts so that a
    host with most rows is not gathered."""
    return rows.join(F.broadcast(small) if small.count() <= bound else small, "host")


def deduce_templates(pages: DataFrame, support: float = 0.5, least_pages: int = 3, least_tokens: int = 3, constant_share: float = 0.9, main_share: float = 0.6, copy_share: float = 0.25, host_bound: int = 200_000) -> DataFrame:
    """``host, template`` (JSON: nested element paths, constant texts and slots, slots of
    content, main container) of ``page_id, url, html, host``.

    A class is valid with at least ``least_tokens`` tokens that at least ``support`` of
    the host's pages have; a constant text is valid alone, with ``least_pages`` pages that
    have it (two pages may quote the same).  Texts of a class without their own element's
    path that are at least ``copy_share`` of what varies on an average page are what copies
    of a page share, no template.  A slot is constant when constant texts are
    ``constant_share`` of its characters, and content when texts of a single page are.  The
    main container is the deepest path of the template below which ``main_share`` of the
    characters that are not constant lie.  Hosts with fewer than ``least_pages`` pages have
    no template."""
    stats = pages.select("page_id", "url", "html", "host").mapInArrow(_statistics, "host string, token string, pages long, high long, low long, chars long")
    # The halves of the projection are summed apart, so sums stay below 2**63.
    stats = saved(stats.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("chars").alias("chars")))
    n = saved(stats.where("token = 'page'").select("host", F.col("pages").alias("n")).where(F.col("n") >= least_pages))
    own = _by_host(stats.where("token <> 'page'"), n, host_bound)
    kind = F.split("token", " ").getItem(0)
    path = F.regexp_extract("token", r"^text (.*) [0-9a-f]{16}$", 1)
    tokens = own.where((F.col("pages") >= support * F.col("n")) & ((kind == "path") | (kind == "text") & (F.col("pages") >= least_pages)))
    # A class of template tokens, with the characters of its texts on a page.
    classes = tokens.groupBy("host", "pages", "high", "low").agg(F.collect_list("token").alias("tokens"), (F.sum(F.when(kind == "text", F.col("chars")).otherwise(0)) / F.first("pages")).alias("a_page"))
    every = own.where((kind == "slot")).groupBy("host").agg(F.sum("chars").alias("all_chars"), F.first("n").alias("n"))
    shared = tokens.where(kind == "text").groupBy("host").agg(F.sum("chars").alias("shared"))
    mean = saved(every.join(shared, "host", "left").select("host", ((F.col("all_chars") - F.coalesce("shared", F.lit(0))) / F.col("n")).alias("mean")))
    valid = _by_host(classes.where((F.size("tokens") >= least_tokens) | F.exists("tokens", lambda t: t.startswith("text "))), mean, host_bound)
    ends = F.transform(F.filter("tokens", lambda t: t.startswith("path ")), lambda t: F.regexp_extract(t, r" > (.*)$", 1))
    listed = valid.select("host", "a_page", "mean", ends.alias("ends"), F.explode("tokens").alias("token"))
    copies = (kind == "text") & ~F.array_contains("ends", path) & (F.col("a_page") >= copy_share * F.col("mean"))
    paths = saved(listed.where(~copies).select("host", "token"))
    # Slots whose text is constant, or found on one page only, by nearly all its characters.
    constant = own.where(kind == "text").join(paths.where(kind == "text"), ["host", "token"], "left_semi")
    held = constant.groupBy("host", path.alias("path")).agg(F.sum("chars").alias("held"))
    lone = own.where((kind == "text") & (F.col("pages") == 1)).groupBy("host", path.alias("path")).agg(F.sum("chars").alias("lone"))
    slots = own.where(kind == "slot").select("host", "n", "pages", F.expr("substring(token, 6)").alias("path"), "chars").join(held, ["host", "path"], "left").join(lone, ["host", "path"], "left")
    slots = saved(slots.withColumns({"held": F.coalesce("held", F.lit(0)), "lone": F.coalesce("lone", F.lit(0))}))
    still = slots.where((F.col("held") > 0) & (F.col("held") >= constant_share * F.col("chars"))).select("host", F.concat(F.lit("slot "), "path").alias("token"))
    content = slots.where((F.col("pages") >= support * F.col("n")) & (F.col("lone") >= constant_share * F.col("chars"))).select("host", F.concat(F.lit("content "), "path").alias("token"))
    # The container: varying characters below each path above a slot.
    varying = slots.select("host", F.split("path", "/").alias("steps"), (F.col("chars") - F.col("held")).alias("chars")).where("chars > 0 and size(steps) > 2")
    above = varying.select("host", "chars", F.explode(F.transform(F.sequence(F.lit(2), F.size("steps") - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("steps", 1, i), "/").alias("path")))).alias("up"))
    mass = above.groupBy("host", F.col("up.path").alias("path"), F.col("up.depth").alias("depth")).agg(F.sum("chars").alias("chars"))
    whole = slots.groupBy("host").agg(F.sum(F.col("chars") - F.col("held")).alias("whole"))
    template = paths.where(F.col("token").startswith("path ")).select("host", F.regexp_extract("token", r" > (.*)$", 1).alias("path")).distinct()
    most = mass.join(whole, "host").where(F.col("chars") >= main_share * F.col("whole")).join(template, ["host", "path"], "left_semi")
    main = most.groupBy("host").agg(F.max(F.struct("depth", "chars", "path")).alias("main"))
    names = paths.unionByName(still).unionByName(content).groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    both = names.join(main, "host", "full")
    return both.select("host", F.to_json(F.struct(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.col("main.path").alias("main"))).alias("template"))


def _step(path: str) -> str:
    """The element of a path's last step."""
    return path.rpartition("/")[2].partition(".")[0]


class Template:
    """Constant texts and slots of a host, and its main container."""

    def __init__(self, source: str | None):
        spec = json.loads(source) if source else {"tokens": []}
        self.constant = {t for t in spec["tokens"] if t.startswith("text ")}
        self.still = {t.partition(" ")[2] for t in spec["tokens"] if t.startswith("slot ")}
        self.content = {t.partition(" ")[2] for t in spec["tokens"] if t.startswith("content ")}
        self.main = spec.get("main")
        if self.main and _step(self.main) in ("html", "body"):
            self.main = None  # no container holds most of the text
        # Inside an article element the whole of it is the container.
        up = self.main
        while up:
            if _step(up) in ARTICLE_TAGS:
                self.main = up
                break
            up = up.rpartition("/")[0]

    def fixed(self, node: Node, text: str) -> bool:
        """The block's text, or all its slot holds, is constant over the host."""
        return node.path in self.still or _text_token(node, text) in self.constant

    def goes(self, node: Node) -> bool:
        """Elements or names speak against the block and its slot does not speak for it."""
        return node.surely or node.furniture and node.path not in self.content

    def inside(self, node: Node) -> bool:
        """In the main container, or a heading right beside it."""
        above = self.main.rpartition("/")[0]
        return f"{node.path}/".startswith(f"{self.main}/") or node.path.rpartition("/")[0] == above and _step(node.path) in ("h1", "h2")


def main_text(page: str | None, template: Template) -> str:
    """The blocks of the remaining slots, one line each."""
    got, _ = blocks(page or "")
    left = [(node, text) for node, text in got if not template.fixed(node, text)]
    named = [(node, text) for node, text in got if not node.furniture]
    varying = [(node, text) for node, text in left if not node.furniture]
    if template.main:
        inside = [(node, text) for node, text in left if template.inside(node) and not template.goes(node)]
        if inside:
            return "\n".join(text for _, text in inside)
    # No container, or none on this page: elements decide.
    if any(node.article for node, _ in named):
        # An article that is constant whole is a page the host has many times, no template.
        inside = [text for node, text in varying if node.article]
        return "\n".join(inside or (text for node, text in named if node.article))
    mass: dict[str, int] = {}
    rest = varying or named
    for node, text in rest:
        up = node.path.rpartition("/")[0]
        mass[up] = mass.get(up, 0) + len(text)
    if not mass:
        return ""
    best = max(mass, key=lambda k: mass[k])
    return "\n".join(text for node, text in rest if f"{node.path}/".startswith(f"{best}/"))


def extract_text(pages: DataFrame, template_bytes: int = 32 << 20, salts: int = 32, **options) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null page has an empty text, a null url has the empty host, null ids stay; rows
    that repeat give repeated results; other columns are ignored; an empty table gives
    an empty result.  Character references are decoded once, white space in a block
    becomes one space, blocks are joined by a line break.  A tag, comment or script that
    does not end takes the rest of its page.  Templates are broadcast up to
    ``template_bytes`` in all; beyond it pages are joined with them by host and one of
    ``salts`` parts, so that a large host is not one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    templates = saved(deduce_templates(rows, **options))
    size = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    if size <= template_bytes:
        joined = rows.join(F.broadcast(templates), "host", "left")
    else:
        part = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("part")
        spread = templates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.select("*", part).join(spread, ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Template] = {}
        for batch in batches:
            texts = []
            for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if template not in known:
                    known.clear() if len(known) > 1000 else None
                    known[template] = Template(template)
                texts.append(main_text(source, known[template]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
