"""Main text of web pages by site template removal.

Method.  Each page is parsed into a tree, and every element subtree with text gets
two hashes: of its content (tag, class, id, text and the hashes below it) and of its
frame (the same with every text masked, repeated parts counted once and numbers in
names left out), since a site fills one and the same menu, advert or footer with other
words on each page.  Spark counts, for each host, on how many different pages a hash
occurs; subtrees whose hash is on at least ``MIN_PAGES`` pages, however many the host
has, are the site's template and are deleted from its pages.  Only then, for what is
left (small hosts, parts that occur once), roles count: an element, or a whole class,
id or role of a known form, names navigation, header, footer, sidebar, notice, advert,
form or reader comments; within an article ids, often made from headings, and words
that content has too do not count; text outside the ``main`` and ``article`` elements
goes if these hold ``MOST_TEXT`` of what is left.  What is or holds the main element or
the longest article, or most of the page's text, never goes by name.  ``roles=False``
leaves this second step out: then only markup that is never text and templates go.

An article repeated within a site is no template: only different pages count, what
is or contains an ``article`` or ``main`` is never deleted, nor a subtree with
most of the text of its article (of the page, where there is none), and nothing is
deleted from an article, or from a run of paragraphs, most of whose text recurs.
Within an article or a run of paragraphs only the content of boxes counts: paragraphs,
lists and headings are what texts are made of, and texts quote one another.
Frames count outside articles only, for boxes and lists that hold neither most of the
page's text nor paragraphs with ``RUN_TEXT`` of it; on a page without article, only
if links are most of their text.

A page gets the templates it holds itself, not all of its host, so no row grows with
the host, and no group is a host: hashes are counted by (host, hash).  Up to ``SENT``
template hashes are sent to the workers, which look a page's subtrees up; beyond that,
subtrees and template hashes meet by (host, hash), pages and their templates by (host,
page), in shuffles.  Both ways have the same result.

Text: character references decoded, white space in a block made one space,
trimmed, blocks in page order joined by an empty line.

Defined cases: null html is an empty page with empty text; a null or odd url has
host ''; unclosed and stray tags are mended as browsers do in the common cases; a tag
that no ``>`` follows is text; from the first tag whose quotes never close, a tag ends
at its first ``>``; the work is linear in the page's length; repeated rows give
repeated results; an empty table gives an empty result; clashing extra columns are
ignored; nothing is shortened.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, pick

MIN_PAGES = 5
#: A subtree with more than this of the text of its article (of the page, without one) is no template.
MOST_TEXT = 0.5
#: Paragraphs together are guarded as one if they hold this share of the page's text.
RUN_TEXT = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
#: Template hashes (of eight bytes) up to which they are sent to the workers.
SENT = 1 << 22
#: Elements that set parts of a page apart.
BOX = frozenset("address aside blockquote center details dialog dir div dl fieldset figure footer form header menu nav ol p pre section table ul".split())
#: Elements whose frame may be template.
FRAME = BOX - frozenset("blockquote figure p pre table".split())
#: Elements whose content may be template within an article.
INNER = FRAME - frozenset("dl ol ul".split())
CLOSES_P = BLOCK - {"html", "body", "legend", "summary", "tbody", "tfoot", "thead", "tr"}
#: opening tag -> (open tags it ends, tags that stop the search)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Markup whose content is never text of a page.
NO_TEXT = frozenset("head title script style noscript template iframe noembed noframes xmp svg math object embed canvas audio video map".split())
#: Elements that are no main text by their role.
DROP_TAGS = frozenset("nav footer aside form button select textarea input dialog menu".split())
ROLE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar skip "
    "sidebar sidenav aside rail widget widgets related recommended recirc "
    "footer masthead cookie cookies consent gdpr notice notification alert popup modal overlay paywall subscribe subscription newsletter signup login "
    "comment comments disqus respond replies share sharing social search searchbox contentinfo complementary".split()
)
#: Those that name no content; only they count within an article.
CLEAR_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menubar breadcrumb breadcrumbs pagination pager toolbar topbar sidebar sidenav recirc "
    "cookie cookies consent gdpr paywall subscribe subscription newsletter signup "
    "comment comments disqus share sharing social searchbox contentinfo".split()
)
HEADER_WORDS = frozenset(("header", "topheader", "siteheader", "banner"))
#: Words that may follow, or go before, a word above in a class or id of a known form.
PARTS = frozenset(
    "area author bar block body box boxes button buttons card cards column consent container footer form group header heading icon icons inner item items label "
    "link links list media menu meta module nav navigation notice panel popup posts primary respond secondary section signup slot space stories "
    "text thread title toggle tools trail unit widget widgets wrap wrapper zone".split()
)
PLACES = frozenset("article blog bottom desktop entry floating footer global header left main mobile page post primary reader right secondary site sticky sub top user".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)""", re.DOTALL)
ATTRS = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LONG_REFERENCE = re.compile(r"(&#[xX]?)([0-9a-fA-F]{9,})")
NUMBER = re.compile(r"\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    """The host of a url column, '' if it has none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.", ""), F.lit(""))


def unescape(text: str) -> str:
    """Character references decoded; a number of any length is beyond the last character."""
    if "&#" in text:
        text = LONG_REFERENCE.sub(lambda m: m[1] + (m[2].lstrip("0")[:9] or "0"), text)
    return _html.unescape(text)


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "frame", "size", "paras", "links", "main", "keep", "ask")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.kids, self.hash, self.frame, self.size, self.paras, self.links = tag, attrs, [], 0, 0, 0, 0, 0
        self.main = self.keep = False
        #: hashes by which the subtree is deleted if they are template
        self.ask: tuple = ()


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and decoded text."""
    root = Node("#root", "")
    stack, at, n = [root], 0, len(page)
    last, quotes = page.rfind(">"), True
    opened: dict[str, list[int]] = {}  # tag -> its places in the stack

    def text(a, b):
        if a < b:
            stack[-1].kids.append(unescape(page[a:b]))

    def close(tags, stops):
        k = max([opened[t][-1] for t in tags if opened.get(t)], default=0)
        if k and k >= max([opened[t][-1] for t in stops if opened.get(t)], default=0):
            for x in stack[k:]:
                opened[x.tag].pop()
            del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        if m is None or (m[2] and m.start() > last):
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        rest = ATTRS.match(page, at) if quotes else None
        if rest is None:
            quotes = False
            end = page.index(">", at)
            attrs, at = page[at:end], end + 1
        else:
            attrs, at = rest[1], rest.end()
        tag = m[2].lower()
        if m[1]:
            close((tag,), ("table",) if tag not in ("table", "body", "html") and tag in BLOCK | CELL else ())
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object"))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("html", "body") and opened.get(tag):
            continue
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID or (attrs.endswith("/") and tag not in BLOCK):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            if tag in ("title", "textarea"):
                node.kids.append(unescape(page[at:stop]))
            at = n if end is None else (page.find(">", stop) + 1 or n)
            continue
        opened.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    return out[::-1]


def _roles(node: Node) -> list[tuple[str, str]]:
    got = ROLE.findall(node.attrs) if node.attrs else ()
    return sorted((k.lower(), v.strip(chr(34) + chr(39))) for k, v in got)


def _names(node: Node) -> str:
    return " ".join(f"{k}={v}" for k, v in _roles(node))


def named(token: str, words: frozenset) -> bool:
    """Whether a class, id or role is one of ``words``, or one with words that go with it."""
    got = [w.lower() for w in WORDS.findall(token)]
    if "".join(got) in words:
        return True
    return len(got) > 1 and (
        (got[0] in words and all(w in PARTS or w in words or w.isdigit() for w in got[1:])) or (got[-1] in words and all(w in PLACES or w in words for w in got[:-1]))
    )


def _hash(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


#: The frame of text, whatever it is and with whatever inline elements.
TEXT_FRAME = 1


def hash_tree(root: Node) -> list[Node]:
    """Set hashes, sizes, what protects every subtree and what may delete it; nodes in post-order."""
    nodes = post_order(root)
    for node in nodes:
        parts, size, paras, links, frames = [f"<{node.tag} {_names(node)}>" if node.attrs else f"<{node.tag}>"], 0, 0, 0, []
        for k in node.kids:
            if isinstance(k, Node):
                parts.append(f"<#{k.hash}>")
                size += k.size
                paras += k.paras
                links += k.links
                if k.frame and k.frame not in frames[-1:]:
                    frames.append(k.frame)
            elif t := " ".join(k.split()):
                parts.append(t)
                size += len(t)
                if frames[-1:] != [TEXT_FRAME]:
                    frames.append(TEXT_FRAME)
        node.size, node.paras, node.links = size, size if node.tag == "p" else paras, size if node.tag == "a" else links
        node.hash = _hash(parts)
        if node.tag in BLOCK:
            node.frame = _hash(["[" + NUMBER.sub("", parts[0]), *map(str, frames)])
        elif size or not frames:
            node.frame = TEXT_FRAME if size else 0
        node.main = _is_main(node) or any(k.main for k in node.kids if isinstance(k, Node))
    longest = max((x.size for x in nodes if x.tag == "article"), default=-1)
    for node in nodes:
        node.keep = (
            (node.size if node.tag == "article" else -1) == longest >= 0
            or (_is_main(node) and node.tag != "article")
            or node.size > MOST_TEXT * root.size
            or (node.main and any(k.keep and k.main for k in node.kids if isinstance(k, Node)))
        )
    _set_ask(root)
    return nodes


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or (bool(node.attrs) and 'role="main"' in node.attrs.replace("'", '"').lower())


def dropped(node: Node, in_article: bool) -> bool:
    """Whether an element's role tells that it is not part of the main text."""
    if node.tag in NO_TEXT:
        return True
    if (node.tag in DROP_TAGS and not (node.tag == "form" and node.keep)) or (node.tag == "header" and not in_article and not (node.main and node.keep)):
        return True
    if not node.attrs or node.keep:
        return False
    if HIDDEN.search(node.attrs):
        return True
    if node.tag in ("html", "body"):
        return False
    for kind, value in _roles(node):
        for token in value.split():
            if in_article:
                if kind != "id" and named(token, CLEAR_WORDS):
                    return True
            elif named(token, DROP_WORDS) or named(token, HEADER_WORDS):
                return True
    return False


def _set_ask(root: Node) -> None:
    """By which hashes each subtree would be deleted (none: it can't be template)."""
    any_main, todo = False, [root]
    while todo:  # whether a main element counts at all
        x = todo.pop()
        if not dropped(x, False):
            if any_main := _is_main(x):
                break
            todo += [k for k in x.kids if isinstance(k, Node) and k.main]
    most, run = MOST_TEXT * root.size, RUN_TEXT * root.size
    todo = [(root, None)]
    while todo:
        x, region = todo.pop()
        if _is_main(x) and (region is not None or not dropped(x, False)):
            if x.tag == "article" or not any(k.main for k in x.kids if isinstance(k, Node)):  # a main element around articles is no text itself
                region = x
        elif x.size and not x.main and x.tag not in ("#root", "html", "body", "head", "title"):
            if region is not None:
                if x.tag in INNER and x.size <= MOST_TEXT * region.size:
                    x.ask = (x.hash,)
            else:
                if any_main or x.size <= most:
                    x.ask = (x.hash,)
                if x.tag in FRAME and x.size <= most and x.paras < run and (any_main or x.links >= MOST_TEXT * x.size):
                    x.ask += (x.frame,)
        if region is None and not any_main and _is_run(x, root):
            region = x
        todo += [(k, region) for k in x.kids if isinstance(k, Node)]


def candidates(nodes: list[Node]) -> list[int]:
    """Hashes by which subtrees of a hashed tree may be the site's template, each once a page."""
    return sorted({h for x in nodes for h in x.ask})


def _is_template(x: Node, template: frozenset) -> bool:
    return any(h in template for h in x.ask)


def _recurs(top: Node, template: frozenset, article: bool) -> bool:
    """Whether most of a region's text is template: a copied text.  What lies in articles within it counts as its own."""
    size, gone, todo = 0, 0, [(top, False)]
    while todo:
        x, within = todo.pop()
        if x is not top:
            if dropped(x, article):
                continue
            if not within and x.hash in template and x.ask:
                gone += x.size
                size += x.size
                continue
            within = within or _is_main(x)
        size += x.size - sum(k.size for k in x.kids if isinstance(k, Node))
        todo += [(k, within) for k in x.kids if isinstance(k, Node)]
    return gone > MOST_TEXT * size


def _is_run(x: Node, root: Node) -> bool:
    """Whether an element outside articles consists of paragraphs that hold much of the page's text."""
    return not x.main and x.size >= RUN_TEXT * root.size and sum(k.size for k in x.kids if isinstance(k, Node) and k.tag == "p") >= MOST_TEXT * x.size


def _roots(root: Node, template: frozenset) -> list[Node]:
    """The outermost main and article elements."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x is not root and (dropped(x, False) or _is_template(x, template)):
            continue
        if _is_main(x):
            found.append(x)
        else:
            todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return found


def main_text(root: Node, template: frozenset = frozenset(), roles: bool = True) -> tuple[str, int, int]:
    """The text of a hashed tree without the subtrees of ``template``, and how many subtrees went as template and by role."""
    whole = _text([root], root, template, roles)
    outer = _roots(root, template) if roles else []
    if not outer:
        return whole
    inner = _text(outer, root, template, roles)
    return (inner[0], whole[1], whole[2]) if len(inner[0]) >= MOST_TEXT * len(whole[0]) else whole


def _text(tops: list[Node], root: Node, template: frozenset, roles: bool) -> tuple[str, int, int]:
    blocks: list[str] = []
    run: list[str] = []
    by_count = by_role = 0

    def flush():
        if t := " ".join("".join(run).split()):
            blocks.append(t)
        run.clear()

    for top in tops:
        todo: list = [(top, False, False, template)]  # node, its end, whether in an article, templates to delete
        while todo:
            x, end, article, gone = todo.pop()
            if isinstance(x, str):
                run.append(x)
                continue
            if end:
                flush()
                continue
            copied = bool(gone) and not article and _is_run(x, root) and x is not root and _recurs(x, gone, False)
            if x is not top:
                templated = not copied and bool(gone) and _is_template(x, gone)
                if templated or x.tag in NO_TEXT or (roles and dropped(x, article)):
                    by_count += templated
                    by_role += not templated and x.size > 0 and x.tag not in NO_TEXT
                    if x.tag in BLOCK:
                        flush()
                    continue
            if _is_main(x):
                copied = not article and bool(template) and _recurs(x, template, True)
                gone = gone if article else template
                article = True
            if copied:
                gone = frozenset()
            if x.tag in BLOCK or x is top:
                flush()
                todo.append((x, True, article, gone))
            elif x.tag == "br" or x.tag in CELL:
                run.append(" ")
            todo += [(k, False, article, gone) for k in reversed(x.kids)]
    flush()
    return "\n\n".join(blocks), by_count, by_role


def _keyed(df: DataFrame, url_col: str, html_col: str, **columns: str) -> DataFrame:
    """Pages with their host and a hash of their html."""
    rows = pick(df, url=url_col, html=html_col, **columns)
    return rows.withColumn("host", host_of(F.col("url"))).withColumn("page", F.xxhash64(F.coalesce("html", F.lit(""))))


def _seen(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, page, parts): the candidates of each different page."""

    def start():
        def f(batch):
            return [batch.column("host"), batch.column("page"), [candidates(hash_tree(parse(p or ""))) for p in batch.column("html").to_pylist()]]

        return f

    seen = arrow_map(_keyed(df, url_col, html_col).select("host", "page", "html"), "host string, page long, parts array<long>", start)
    # equal pages of a host count once; what they hold is equal too
    return materialize(seen.groupBy("host", "page").agg(F.first("parts").alias("parts")), "pages")


def _often(pages: DataFrame) -> DataFrame:
    """(host, part): the template subtrees."""
    return pages.select("host", F.explode("parts").alias("part")).groupBy("host", "part").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select("host", "part")


def templates(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): the hashes of each host's template subtrees."""
    return _often(_seen(df, url_col, html_col)).groupBy("host").agg(F.sort_array(F.collect_list("part")).alias("template"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roles: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, and how many subtrees went as template and how many by role."""
    kinds = {a: df.schema[c].dataType.simpleString() for a, c in (("page_id", id_col), ("url", url_col))}
    pages = _seen(df, url_col, html_col)
    often = materialize(_often(pages), "templates")
    rows = _keyed(df, url_col, html_col, page_id=id_col)
    keys = None
    if often.count() <= SENT:
        salted = often.select(F.col("part").bitwiseXOR(F.xxhash64("host")).alias("key")).toArrow()
        keys = df.sparkSession.sparkContext.broadcast(np.sort(salted.column("key").to_numpy()))
        joined = rows.select("page_id", "url", "html", F.xxhash64("host").alias("salt"))
    else:
        held = pages.select("host", "page", F.explode("parts").alias("part")).join(often, ["host", "part"])
        gone = materialize(held.groupBy("host", "page").agg(F.collect_list("part").alias("template")), "gone")
        joined = rows.join(gone, ["host", "page"], "left").select("page_id", "url", "html", "template")

    def found(nodes: list[Node], salt: int) -> frozenset:
        own = np.array(candidates(nodes), np.int64)
        if not len(own) or not len(keys.value):
            return frozenset()
        at = np.searchsorted(keys.value, own ^ salt)
        return frozenset(own[keys.value[np.minimum(at, len(keys.value) - 1)] == own ^ salt].tolist())

    def start():
        def f(batch):
            out = []
            for page, t in zip(batch.column("html").to_pylist(), batch.column(3).to_pylist()):
                root = parse(page or "")
                nodes = hash_tree(root)
                out.append(main_text(root, frozenset(t or ()) if keys is None else found(nodes, t), roles))
            text = [o[0] for o in out]
            return [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), [len(x) for x in text], [o[1] for o in out], [o[2] for o in out]]

        return f

    return arrow_map(joined, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_template long, n_role long", start)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
