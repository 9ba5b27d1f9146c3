import hashlib
import random
import time

from pyspark.sql import functions as F

from quern.llm import html_extract, warc

LONG = "<p>" + "text " * 40 + "</p>"


def test_url_keys():
    assert warc.url_key("http://Blog.Example.com:80/en/7#top") == "com,example,blog)/en/7"
    assert warc.url_key("https://a.b:8080") == "b,a:8080)/"
    assert warc.url_key(None) == "" and " " not in warc.url_key("no host at all")
    assert sorted(map(warc.url_key, ["http://b.x.org/", "http://a.y.org/", "http://x.org/z"]))[0] == "org,x)/z"


def test_archives(spark):
    rows = [(3, "http://a.org/x", LONG, "e"), (1, "http://a.org/y?q=1 2", LONG, "e"), (2, None, "short", "e"), (4, "http://b.org/\r\n", "short", "e"), (5, "http://c.org/", None, "e"), (1, "http://a.org/y?q=1 2", LONG, "e"), (None, "http://d.org", LONG, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = warc.new_folder(spark)
    captures = warc.write_archives(pages, folder)
    directory = warc.write_index(captures, folder, lines=2)
    got = warc.read_records(warc.find(directory, pages)).collect()
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        r = next(r for r in got if r["page_id"] == page)
        data = (html or "").encode()
        again = html == LONG and page != 1
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if again else ("response", None))
        assert r["payload"] is None if again else bytes(r["payload"]) == data
    found = warc.lookup(directory, "http://a.org/x")
    assert [(c.page_id, c.refers_to) for c in found] == [(3, 1)] and warc.lookup(directory, "http://none.org") == []
    assert len(warc.lookup(directory, "http://a.org/y?q=1%202")) == 2


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    captures = warc.write_archives(pages, folder)
    assert warc.read_records(warc.find(warc.write_index(captures, folder), pages)).count() == 0
    assert html_extract.extract(pages).count() == 0


def page(i, body):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p><b>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
{body}<aside>aside {i}</aside><div id="comments"><article class="comment"><p>nice {i}</p></article></div><form><label>Mail</label><input></form>
<!-- <p>hidden</p> --><footer>&copy; {i}</footer></body></html>"""


def test_many_captures_of_a_url(spark):
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", f"page {i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = warc.new_folder(spark)
    directory = warc.write_index(warc.write_archives(pages, folder), folder, lines=6)
    assert sorted(r["page_id"] for r in warc.find(directory, pages).collect()) == list(range(400))
    some = spark.createDataFrame([("http://h1.org/2",), ("http://h1.org:80/2",), ("http://h9.org/",), (None,)], "url string")
    assert sorted(r["page_id"] for r in warc.find(directory, some).collect()) == [i for i in range(400) if i % 7 == 1 and i % 3 == 2]


def test_main_text(spark):
    bodies = [f'<article><header><h1>Head {i}</h1><span>by x</span></header><p>First&nbsp;&amp; <b>bold{i}<p>Second<br>line {i}  x<div class="ad-slot">Buy</div><p class="notice">Notice</p><p>Subscribe now</p></article>' for i in range(8)]
    rows = [(i, "http://h.org/%d" % i, page(i, b), "m") for i, b in enumerate(bodies)] + [(90, "http://h.org/0", page(0, bodies[0]), "m"), (91, None, None, "m"), (92, "x", "", "m"), (93, "http://one.org", "<div>plain</div>tail &lt;", "m")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text_host string")
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(pages).collect()}
    for i in range(8):
        assert got[i] == f"Head {i}\n\nFirst & bold{i}\n\nSecond line {i} x", got[i]
    assert got[90] == got[0] and got[91] == "" and got[92] == "" and got[93] == "plain\n\ntail <"


def text_of(source):
    return html_extract.main_text(html_extract.read(source), [], set()).split("\n\n")


def test_names_in_an_article_are_no_evidence():
    source = '<article><h2 id="share-prices">Share prices</h2><h2 id="comments-on-war">War</h2><p class="search">Search</p><div class="feature-alert">Alert</div><table><caption>All</caption><tr><td>one</td><td>two</td></table><math><mi>x</mi></math><xmp><b>raw</b></xmp><p hidden>no</p><div class="comment-list">no</div><ul class="share"><li>no</ul></article><p>no'
    assert text_of(source) == ["Share prices", "War", "Search", "Alert", "All", "one", "two", "x", "<b>raw</b>"]
    assert text_of('<div id="comments">no</div><div>a < b <!-- c --><script>d</script>e<nav>f</nav></div><p>g<p>h') == ["a < b e", "g", "h"]


def test_deep_and_broken_pages():
    began = time.time()
    deep = "<div class='x'>" * 100_000 + "text" + "</p></i></div>" * 100_000
    assert text_of(deep) == ["text"] and text_of("<b>" * 50_000 + "<li>a" * 50_000)[:2] == ["a", "a"]
    for broken in ('<a "' * 250_000, '<a ="' * 200_000, "<a '> " * 150_000, '<p title="x>' * 80_000, "<" * 1_000_000, "<!--" * 250_000, "<a b=c" * 150_000, "</" * 400_000, "<script>" * 100_000, "<i " + "a " * 500_000 + ">z"):
        html_extract.read(broken)
    assert time.time() - began < 60 and text_of("<p>" + "word " * 400_000)[0].count(" ") == 399_999


def test_recurring_parts_of_articles_stay(spark):
    rows = [(i, f"http://h.org/{i}", f"<article><h1>T{i}</h1><h2>Summary</h2><p>Own {i}.</p><table><tr><th>Price</th><td>{i}</td></tr></table><p>Read our newsletter.</p></article>") for i in range(12)]
    rows += [(50 + i, f"http://two.org/{i}", f"<article><p>Own {i}.</p><p>The same.</p></article>") for i in range(2)]
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\n\nSummary\n\nOwn 3.\n\nPrice\n\n3" and got[50] == "Own 0.\n\nThe same."


def test_classes_equal_brute_force(spark):
    rng, rows = random.Random(6), []
    for host in range(6):
        parts = [f"<div class='c{j}'><p>Part {j}</p></div>" for j in range(6)]
        for i in range(rng.choice([2, 5, 14])):
            body = "".join(p for p in parts if rng.random() < 0.75) + f"<p>Own {rng.randint(0, 5)}</p>"
            rows.append((len(rows), f"http://h{host}.org/{rng.choice(['', 'a/', 'b/'])}{i}", body))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    host, section = html_extract.places_of(F.col("url"))
    got = {r["host"]: {frozenset(c) for c in r["classes"] or []} for r in html_extract.templates(pages).collect()}
    held, texts = {}, set()
    for r in pages.select(host.alias("host"), section.alias("section"), "html").collect():
        page = html_extract.read(r["html"])
        texts |= {b.token for b in page.blocks}
        for place in {r["host"], r["section"]}:
            held.setdefault(place, set()).add(tuple(page.tokens))
    for place, found in held.items():
        vectors = {}
        for number, tokens in enumerate(found):
            for token in set(tokens):
                vectors.setdefault(token, []).append((number, tokens.count(token)))
        most = max(map(len, vectors.values()))
        classes = {}
        for token, vector in vectors.items():
            if len(vector) >= html_extract.SUPPORT and len(vector) >= html_extract.SHARE * most:
                classes.setdefault(tuple(vector), set()).add(token)
        want = {frozenset(c) for c in classes.values() if c & texts}
        assert got.get(place, set()) == want


def test_copies_are_not_template(spark):
    body = "<article><h1>Same</h1><p>One story that was copied.</p></article>"
    pages = spark.createDataFrame([(i, "http://h.org/%d" % i, f"<html><title>Same</title>{body}</html>") for i in range(20)], "page_id long, url string, html string")
    assert {r["main_text"] for r in html_extract.extract(pages).collect()} == {"Same\n\nOne story that was copied."}


def test_a_quoted_line_is_not_template(spark):
    rows = [(i, f"http://h.org/{i}", f"<title>T{i}</title><article><h1>T{i}</h1><p>Own {i}.</p>{'<p>Quoted.</p>' if i < 8 else ''}</article>") for i in range(60)]
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\n\nOwn 3.\n\nQuoted." and got[30] == "T30\n\nOwn 30."


def test_pages_without_article(spark):
    links = "".join(f'<div class="x"><a href="/{j}">Section {j}</a></div>' for j in range(5))
    rows = [(i, f"http://h.org/{i}", f'<title>T{i}</title>{links}<div class="body"><p>Story number {i} goes on here.</p></div><div>Always the same</div>') for i in range(9)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["main_text"] for r in got} == {f"Story number {i} goes on here." for i in range(9)}


def test_pages_of_one_title_and_small_sections(spark):
    rows = [(i, f"http://h.org/{i}", f"<title>Site</title><div><p>Story number {i} goes on.</p></div><div>Call us now</div>") for i in range(40)]
    rows += [(100 + i, f"http://h.org/shop/{i}", f"<title>Site</title><div><p>Item {i} is sold here.</p></div><div>Only while stocks last</div>") for i in range(8)]
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3 goes on." and got[104] == "Item 4 is sold here."


def test_nesting_of_classes():
    p = html_extract.read("<div><ul><li>a</li><li>b</li></ul></div>")
    tokens = p.tokens
    outer, inner = [tokens[0], tokens[-1]], [tokens[2], tokens[4]]
    assert html_extract.template_tokens(p, [outer, inner]) == {*outer, *inner}
    assert html_extract.template_tokens(p, [outer[::-1]]) == set()
