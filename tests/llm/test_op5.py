import html
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

from quillfact.llm import op5_html as m


def text(page, template=frozenset()):
    root = m.parse(page)
    m.hash_tree(root)
    return m.main_text(root, template)[0]


def test_blocks_and_white_space():
    assert text("<p>a\n b&nbsp;&amp;c<br>d<b>e</b>f<p>g<div>h<ul><li>i<li>j</ul></div>") == "a b &c def\n\ng\n\nh\n\ni\n\nj"
    assert text("<p>x &lt;b&gt; 1 < 2 &copy;</p>") == "x <b> 1 < 2 ©"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b\n\nc"
    assert text("") == "" and text("plain") == "plain" and text("<!-- a > b -->x<!-- open") == "x"
    assert text('<p title="a>b">c</p></div></p>d') == "c\n\nd"
    assert text("<script>var t='</p>';if(a<b){}</script>a<style>p{}</style><textarea>no</textarea>b") == "ab"


def test_roles():
    page = (
        '<html><head><title>T</title></head><body><header>H</header><nav>N</nav><div class="cookie-notice">C</div><div id="SideBar">S</div>'
        '<main><article><header><h1>Title</h1></header><p>one</p><div class="ad-box">AD</div><form>F</form><p>two<p hidden>z</p>'
        '<section class="comments"><p>first!</p></section></article><aside>A</aside></main><footer>F</footer></body></html>'
    )
    assert text(page) == "Title\n\none\n\ntwo"
    assert text('<body class="with-sidebar"><div class="headline">x</div></body>') == "x"
    assert text("<article>a</article><div>b</div><article>c</article>") == "a\n\nc"


def test_names_are_whole_and_wrappers_stay():
    for tag in ("<div class='content-sidebar-wrap'><article>%s</article></div>", "<div class='sidebar'><article>%s</article></div>", "<article class='post format-aside comments-open'>%s</article>", "<div id='search'><main>%s</main></div>", "<form><article>%s</article></form>", "<div class='has-sidebar'><p>%s</div>", "<div class='comments'><p>%s</div><p>x"):
        assert "the main text of it" in text(tag % "<p>the main text of it</p>"), tag
    for part in ("section id='related-work'", "section id='search-api'", "section id='menu-commands'", "section id='search'", "div class='alert'", "div class='headline-share-price'"):
        assert text(f"<article><p>{'one ' * 9}</p><{part}>two</{part.split()[0]}></article>").endswith("two"), part
    for part in ("newsletter-box", "post-comments", "adBox", "share-buttons", "site_nav", "ad-1"):
        assert text(f"<article><p>{'one ' * 9}</p><div class='x {part}'>two</div></article>").endswith("one"), part
        assert text(f"<p>{'one ' * 9}</p><div id='{part}'>two</div>").endswith("one"), part
    assert text(f"<article>{'one ' * 9}</article><div class='comments'><article class='comment'>two</article></div>").endswith("one")


def host_of(url):
    got = re.match(m.HOST, url or "")
    return re.sub(r"^www\.", "", got[1].lower()) if got else ""


class Outline(HTMLParser):
    """Every element of a well-formed page as its source text, the source without texts, and the place in the page."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.found = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag != "br":
            self.stack.append([tag, [f"<{tag} {sorted(attrs)}>"], [re.sub(r"\d", "", f"<{tag} {sorted(attrs)}>")], any(x[0] in ("article", "main") for x in self.stack), []])

    def handle_data(self, data):
        if self.stack and data.strip():
            self.stack[-1][1].append(" ".join(data.split()))
            self.stack[-1][4].append(" ".join(data.split()))
            if self.stack[-1][2][-1] != "*":
                self.stack[-1][2].append("*")

    def handle_endtag(self, tag):
        t, content, frame, inner, text = self.stack.pop()
        self.found.append((t, "".join(content), "".join(frame), inner, " ".join(text)))
        if self.stack:
            up = self.stack[-1]
            up[1].append("".join(content))
            up[4].extend(text)
            if up[2][-1] != "".join(frame):
                up[2].append("".join(frame))


def brute_templates(pages):
    """Host -> the boxes that recur on five pages, by content or, outside articles, by frame."""
    boxes = ("div", "nav", "aside", "footer", "header", "section", "form")
    by = defaultdict(set)
    for u, p in pages:
        by[host_of(u)].add(p or "")
    out = {}
    for h, ps in by.items():
        n = Counter()
        seen = [(p, Outline(p).found) for p in sorted(ps)]
        for _, found in seen:
            n.update({("c", c) for t, c, f, i, x in found if x} | {("f", f) for t, c, f, i, x in found if x and not i})
        out[h] = {(c, i) for _, found in seen for t, c, f, i, x in found if t in boxes and "<article" not in c and (n["c", c] >= 5 or (not i and n["f", f] >= 5))}
    return out


def test_templates_are_removed(spark):
    site = lambda k: f"<div><div>Our shop sells things</div><div>{'word ' * 5}unique {k} {'tail ' * 9}</div><div>All rights reserved</div></div>"
    rows = [(k, f"http://www.a.org/{k}", site(k)) for k in range(8)]
    rows += [(20 + k, f"http://b.org/{k}", site(k)) for k in range(3)]  # too few pages to tell
    rows += [(40 + k, f"http://c.org/{k}", "<article><p>same article</p></article>") for k in range(9)]
    rows += [(60 + k, f"http://d.org/{k}", "<p>" + "copied " * 30 + f"</p><i>{k}</i>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in m.extract(df).collect()}
    body = lambda k: f"{'word ' * 5}unique {k} {'tail ' * 9}".strip()
    assert all(got[k] == body(k) for k in range(8))
    assert all(got[20 + k] == f"Our shop sells things\n\n{body(k)}\n\nAll rights reserved" for k in range(3))
    assert all(got[40 + k] == "same article" for k in range(9))
    assert all(got[60 + k].startswith("copied") for k in range(9))
    assert {r.host for r in m.templates(df).collect()} == {"a.org"}


def test_templates_against_brute_force(spark):
    """What goes is exactly the boxes that a plain count over outlines finds; roles are off."""
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(10**6))
    sentence = lambda n: " ".join(word() for _ in range(n))
    shared = [sentence(4) for _ in range(9)]
    rows = []
    for k in range(160):
        host = rng.choice(["a.org", "b.org", "c.org", "d.org"] + ["few.org"] * (k < 4))
        parts = [f"<div class='x{rng.randrange(3)}'>{sentence(3)}</div>", f"<nav><a>{word()}</a><a>{word()}</a></nav>", f"<section class='once{'i' * k}'>{sentence(3)}</section>", f"<div class='z{'i' * k}'>{rng.choice(shared)}</div>"]
        rng.shuffle(parts)
        inner = "".join(f"<p>{sentence(9)}</p>" for _ in range(3)) + f"<div class='in'>{rng.choice(shared)}</div>" + f"<p>{rng.choice(shared)}</p>"
        rows.append((k, f"http://{host}/{k}", f"<html><body>{parts[0]}{parts[1]}<article><h1>{sentence(2)}</h1>{inner}</article>{parts[2]}{parts[3]}</body></html>"))
    gone = brute_templates([(u, p) for _, u, p in rows])
    got = {r.page_id: r for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), roles=False).collect()}
    counted = 0
    for k, u, p in rows:
        parts = [(t, (c, i), x) for t, c, f, i, x in Outline(p).found if x and t in ("div", "nav", "section", "h1", "p")]
        kept = Counter(x.replace(" ", "") if t == "nav" else x for t, c, x in parts if c not in gone[host_of(u)])
        assert Counter(got[k].text.split("\n\n")) == kept, k
        counted += got[k].n_template
    assert counted > 200


def test_templates_decide_on_whole_table(spark):
    """Templates alone give every article of a host with five pages or more, without them no page is right."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    hosts = Counter(host_of(r.url) for r in rows.values())
    assert min(hosts.values()) >= m.MIN_PAGES
    alone = m.extract(pages, roles=False).collect()
    assert all(r.text == plain(rows[r.page_id].html) for r in alone)
    assert all(r.n_template >= 3 for r in alone)
    changed = sum(text_without_roles(r.html) != plain(r.html) for r in rows.values())
    assert changed == len(rows) == 2500
    both = m.op5_html_extract(spark, "/root/testdata/sf0.1").collect()
    assert all(r.text == plain(rows[r.page_id].html) and r.n_role == 0 for r in both)


def text_without_roles(page):
    root = m.parse(page)
    m.hash_tree(root)
    return m.main_text(root, roles=False)[0]


def test_broken_pages_take_linear_time():
    long = ["<a " * 400_000, '<a title="' * 100_000, '<a ">" ' * 100_000 + "'", "<p><table><td>" + "<div>" * 100_000, "<article>" * 20_000 + "x", "<li>" * 100_000, "<!--" * 100_000, "<script>" * 50_000, "<p" * 100_000 + ">"]
    for page in long:
        began = time.perf_counter()
        text(page)
        assert time.perf_counter() - began < 20, page[:20]
    assert text("a <b c") == "a <b c" and text("<p title='x>a</p><p>b</p>") == "a\n\nb"
    assert text("&#" + "1" * 6000 + ";x&#x0000000000000041;&#00000000000065;") == "\ufffdxAA"


def test_frames():
    frame = lambda p: m.hash_tree(m.parse(p))[-2].frame
    assert frame("<nav><ul><li><a>x</a><li><a>y</a></ul></nav>") == frame("<nav><ul><li><a>z</a></ul></nav>") != frame("<nav class=a><ul><li><a>z</a></ul></nav>")
    assert frame("<div id='post-12'>one <b>two</b></div>") == frame("<div id='post-7'>three</div>")
    shared = "<p>a passage that many pages share</p>"
    root = m.parse(f"<body><div>{'<p>own words of this page</p>' * 3}{shared}</div></body>")
    assert not any(x.ask for x in m.hash_tree(root) if x.tag == "p")


def test_templates_within_articles(spark):
    box = "<div>Sign up and get our letter every week</div>"
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, f"http://a.org/{k}", f"<main><p>Read this and that</p><article><h2>News</h2><p>{words(k, 30)} <b>and</b> {words(-k, 9)}</p>{box}</article></main>") for k in range(8)]
    copied = f"<article><p>{words('a', 20)}</p><p>{words('b', 20)}</p></article>"
    rows += [(20 + k, f"http://b.org/{k}", f"<i>{k}</i>{copied}") for k in range(8)]
    rows += [(40 + k, f"http://c.org/{k}", f"<div>Our shop</div><article>Teaser {k}</article><div><p>{words(k, 40)}</p></div>") for k in range(8)]
    rows += [(60 + k, f"http://d.org/{k}", f"<div>Our shop</div><div>{'<p>' + words('a', 20)}<p>{words('b', 20)}</p></div><p>page {k}</p>") for k in range(8)]
    got = {r.page_id: r.text for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == f"News\n\n{words(k, 30)} and {words(-k, 9)}"
        assert got[20 + k] == f"{words('a', 20)}\n\n{words('b', 20)}"
        assert got[40 + k] == f"Teaser {k}\n\n{words(k, 40)}"
        assert got[60 + k] == f"{words('a', 20)}\n\n{words('b', 20)}\n\npage {k}"


def test_templates_of_sections_of_a_large_host(spark, monkeypatch):
    page = lambda k: f"<div>Menu of section {k % 10}</div><div><p>{' '.join(f'w{k}x{j}' for j in range(30))}</p></div>"
    rows = [(k, f"http://a.org/{k}", page(k)) for k in range(60)] + [(99, "http://a.org/99", page(11)), (100, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in m.extract(df).collect()}
    assert len(got) == 62 and got[100] == "" and got[99] == got[11]
    assert all("Menu" not in t for t in got.values()) and all(got[k].startswith(f"w{k}x0 ") for k in range(60))
    monkeypatch.setattr(m, "SENT", 0)
    assert {r.page_id: r.text for r in m.extract(df).collect()} == got


def plain(page):
    art = re.search(r"<article>(.*)</article>", page, re.S)[1]
    art = re.sub(r"<(/?)(b|br)>", lambda x: " " if x[2] == "br" else "", art)
    return "\n\n".join(t for b in re.split(r"</?(?:p|h1)>", art) if (t := " ".join(html.unescape(b).split())))


def test_query_on_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = m.op5_html_extract(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_cases(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "no url", "<p>a", 2), (1, "no url", "<p>a", 2)], "page_id long, url string, html string, text int")
    assert sorted((tuple(r)[:4] for r in m.extract(df).collect()), key=str) == sorted([(None, None, "", 0), (1, "no url", "a", 1), (1, "no url", "a", 1)], key=str)
    assert m.extract(df.limit(0)).count() == 0
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert text(deep) == "x"
