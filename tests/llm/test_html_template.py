import html
import re

from tiermark.llm import html_template
from tiermark.llm.html_template import extracted, main_text, op4, templates


def plain(page):
    """For pages of the given shape: what stands between <article> and </article>, tags by tags."""
    page = re.sub(r"<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", page or "", flags=re.S)
    m = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1|br|li|ul)[^>]*>", m[1]) if m else []
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
    return " ".join(x for x in blocks if x)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = op4(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(pages)
    for r in rows:
        p = pages[r["page_id"]]
        assert r["url"] == p["url"] and r["text"] == plain(p["html"]) and r["n_chars"] == len(r["text"])


def test_page():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="ad">
    <header>no</header><nav><a href='x>y'>no</a></nav><div class="cookie-notice">no</div><div id=sideBar>no</div>
    <article class="post"><h1>A &amp; B</h1><p>one <b>t</b>wo<br>three<p>fo&#117;r &nbsp; &lt;p&gt;<script>var x = "</p>";</script>
    <form>no<input></form><section class="reader comments"><p>no</p></section><aside>no</aside><p>five</article>
    <footer>&copy; no</footer></body>"""
    assert main_text(page, frozenset()) == "A & B one two three four <p> five"
    assert main_text("<p>a < b<p>c", frozenset()) == "a < b c"
    assert main_text("<article><p>cut of", frozenset()) == "cut of"
    assert main_text("<!-- never closed <p>a", frozenset()) == main_text(None, frozenset()) == main_text("<script>x", frozenset()) == ""


def test_template_texts_go(spark):
    rows = [(i, f"http://h.org/{i}", f"<html><body><div>Our site</div><div><p>story {i}</p><p>both</p></div><p>Legal &amp; terms</p></body></html>") for i in range(4)]
    rows += [(9, "http://other.org/", rows[0][2]), (10, "http://h.org/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["row"]["page_id"]: r["text"] for r in extracted(pages.where("page_id != 10")).collect()}
    assert found == {**{i: f"story {i}" for i in range(4)}, 9: "Our site story 0 both Legal & terms"}
    assert {r["row"]["page_id"]: r["text"] for r in extracted(pages).collect()}[10] == ""
    assert templates(pages.selectExpr("xxhash64(url) host", "page_id", "html")).collect() == []


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "http://a/", "", "x"), (2, "", "<article>" + "<p>long text " * 20000, "x"), (2, "u", "<p>a", "x"), (2, "u", "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    made = extracted(pages).collect()
    assert sorted(len(r["text"]) for r in made) == [0, 0, 1, 1, 20000 * 10 - 1] and all(r["row"]["text"] == "x" for r in made)
    assert extracted(pages.where("false")).collect() == []


def test_other_pages_do_not_undo_a_template(spark):
    page = "<html><body><div>Our site</div>{}<div><p>story {}</p></div><p>Legal &amp; terms</p></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format("<div>more</div>" * (i % 2), i)) for i in range(6)]
    rows += [(10, "http://h.org/a", None), (11, "http://h.org/b", " "), (12, "http://h.org/c", "<html><body><h1>Not found</h1></body></html>"), (13, "http://h.org/d", "<script>x")]
    made = extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["row"]["page_id"]: r["text"] for r in made}
    assert got == {**{i: "more " * (i % 2) + f"story {i}" for i in range(6)}, 10: "", 11: "", 12: "Not found", 13: ""}


def by_hand(rows, least=3):
    """Constant texts of each host by the rule, page by page, over pages whose elements are all different in name or class."""
    hosts = {}
    for _, url, page in rows:
        hosts.setdefault(url.split("/")[2], set()).add(page or "")
    found = {}
    for h, pages in hosts.items():
        on, around, inside = {}, {}, {}
        for k, page in enumerate(sorted(pages)):
            stack = []
            for m in re.finditer(r"<(/?)([^>]*)>|([^<]+)", page):
                if m[3]:
                    t = ("text", "/".join(stack), " ".join(m[3].split()))
                    if t[2]:
                        on.setdefault(t, set()).add(k)
                        around[t], inside[t] = ("tag", "/".join(stack)), "article" in stack
                elif m[1]:
                    stack.pop()
                else:
                    around["tag", "/".join([*stack, m[2]])] = ("tag", "/".join(stack))
                    stack.append(m[2])
                    on.setdefault(("tag", "/".join(stack)), set()).add(k)
            if page:
                on.setdefault(("tag", ""), set()).add(k)
        good = {}
        for t, ks in on.items():
            if t != ("tag", "") and len(ks) >= least:
                good.setdefault(frozenset(ks), set()).update([] if 2 * len(ks) > len(on[around[t]]) else [around[t] if t[0] == "tag" else "loose"])
        found[h] = {t[2] for t, ks in on.items() if t[0] == "text" and len(good.get(frozenset(ks), "no")) < 2 and "loose" not in good[frozenset(ks)] and len(ks) >= least and (not inside[t] or 2 * len(ks) > len(on["tag", ""]))}
    return found


ARTICLE = "<html><body><div>Site name</div><article><h1>Title {0}</h1><div class=bar>Send to a friend</div><p>Text {0} of the page</p><em>{1}</em></article></body></html>"
LAYOUT = "<html><body><div>Site name</div><section><h2>{0}</h2><b>Read this next</b></section></body></html>"


def test_the_template_decides_in_articles_and_layouts(spark, monkeypatch):
    rows = [(i, f"http://h.org/{i}", ARTICLE.format(i, "shared by three" if i < 3 else f"own {i}")) for i in range(8)]
    rows += [(20 + i, f"http://h.org/l{i}", LAYOUT.format(f"part {i}")) for i in range(4)]
    rows += [(40 + i, f"http://copies.org/{i}", ARTICLE.format(1, "one page many times")) for i in range(9)]
    rows += [(60 + i, f"http://few.org/{i}", ARTICLE.format(i, i)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["row"]["page_id"]: r["text"] for r in extracted(pages).collect()}
    constant = by_hand(rows)
    assert constant["h.org"] == {"Site name", "Send to a friend", "Read this next"} and not constant["copies.org"] | constant["few.org"]
    for i in range(8):
        assert got[i] == f"Title {i} Text {i} of the page " + ("shared by three" if i < 3 else f"own {i}")
    assert [got[20 + i] for i in range(4)] == [f"part {i}" for i in range(4)]
    assert all(got[40 + i] == "Title 1 Send to a friend Text 1 of the page one page many times" for i in range(9))
    monkeypatch.setattr(html_template, "templates", lambda pages: pages.selectExpr("host", "array(1L) constant").where("false"))
    without = {r["row"]["page_id"]: r["text"] for r in extracted(pages).collect()}
    assert all("Send to a friend" in without[i] and got[i] != without[i] for i in range(8))


def test_templates_of_the_tables_hosts(spark):
    """The tables' hosts, some of them with a constant bar put into each article: the query's own pages by the same rule."""
    bar = "<span class='x-note'>Please share this page</span>"
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    hosts = sorted({r["url"].split("/")[2] for r in pages if r["url"] and "//" in r["url"]}, key=lambda h: sum(h in (r["url"] or "") for r in pages))[-1:]
    rows = [(r["page_id"], r["url"], (r["html"] or "").replace("</h1>", f"</h1>{bar}") if r["url"] and any(h in r["url"] for h in hosts) else r["html"]) for r in pages]
    got = {r["row"]["page_id"]: r["text"] for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for r in pages:
        assert got[r["page_id"]] == plain(r["html"]) and "Please share" not in got[r["page_id"]]


def test_comments_in_articles_of_their_own_go():
    page = '<article><h1>Title</h1><p>story</p><article class="comment"><p>reader says</p></article><article id="reply-4">again</article></article>'
    assert main_text(page, frozenset()) == "Title story"
    assert main_text('<main class="comments"><p>a</p></main>', frozenset()) == ""


def test_broken_pages_take_linear_time():
    """Each took a quadratic time or path before: a megabyte would not have ended."""
    import time

    n = 1 << 16
    pages = ['<a "' * n, "<a '>" * n, '<a ">"' * n + '"', "<a<a" * n, "<!" * n, "</" * n, "<" * n, "<p>" * n, "<div>" * n, "<div><b>" * n, "<b>" * n + "<hr>" * n, "<b>" * n + "</i>" * n, "<a " * n + ">", "<p><b>" * n, "<script>" * n, "<!-- " * n, "<a \"'" * n + ">"]
    for page in pages:
        start = time.process_time()
        list(html_template.scanned(page))
        assert time.process_time() - start < 5, page[:20]
    for page in pages:
        start = time.process_time()
        main_text(page, frozenset())
        html_template.counted(page)
        assert time.process_time() - start < 30, page[:20]


OLD = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""", re.S)


def by_pattern(page):
    """The same rules as one pattern, which takes quadratic time."""
    out = []
    for m in OLD.finditer(page):
        name = m[2] or m[5]
        if m[7] is not None:
            out.append(("text", m[7], ""))
        elif name:
            out.append(("close" if m[1] or m[4] else "open", name.lower(), m[3] if m[2] else m[6]))
    return out


def test_scanner_equals_the_pattern():
    import random

    made = random.Random(2)
    parts = ["<", ">", "<a ", "</a ", "<p>", "</p>", '"', "'", "x", " ", "<!", "<!--", "-->", "<?", "=", "/", "<b x='1'>", '<i y="2>3">', "text", "<7", "</"]
    for _ in range(20_000):
        page = "".join(made.choice(parts) for _ in range(made.randrange(14)))
        assert list(html_template.scanned(page)) == by_pattern(page), page
