"""Operators on pages and crawl records."""

import re

import pytest

from cohortline.llm import host_suffix, revisits, url_filter
from cohortline.llm.queries import ALLOW, BLOCK

ROW = "page_id long, url string, html string, host string, key long"


def text_of(spark, pages):
    rows = [(i, url, page, "clash", 0) for i, (url, page) in enumerate(pages)]
    return {r.page_id: r for r in host_suffix.main_text(spark.createDataFrame(rows, ROW)).collect()}


def test_article_markup(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy<article>"
        "<h1>Title &amp;  more</h1><p>One<b>two</b>\n three<br>four<p>Five &lt;six&gt;<aside>Side</aside><form>F</form><div id=\"user-comments\"><p>Comment</div>"
        "<script>if (a</b) x</script><!-- <p>no</p> --><p title='a>b'>Seven</p></article><footer>Foot</footer>"
    )
    got = text_of(spark, [("http://a.b/1", page), (None, None), ("x", ""), ("x", "<p>plain &eacute"), ("x", "<article><p>cut &am")])
    assert got[0].text == "Title & more\n\nOnetwo three four\n\nFive <six>\n\nSeven" and got[0].n_chars == len(got[0].text)
    assert [got[i].text for i in (1, 2)] == ["", ""] and got[3].text == "plain é" and got[4].text == "cut &am"


def test_class_words_do_not_take_article_text(spark):
    """A part of a name says nothing inside an article, and a heading or paragraph stays whatever its class."""
    page = (
        '<nav class="top">Menu</nav><article><div class="entry-header"><h1>Title</h1></div><p class="share-price">Shares rose</p><h2 id="comments-on-law">Comments on law</h2>'
        '<div class="notice-period"><p class="notice">A month</p></div><div class="share-buttons">Share this</div><div class="ad">Buy</div><section id="reader-comments"><p>First!</p></section>'
        '<ul class="comment-list"><li>Second</li></ul><div role="search">Find</div><div hidden>Old</div><p>Body</p></article><div class="sidebar-left">Side</div>'
    )
    open_page = '<h1 id="comments-on-law">Comments on law</h1><div class="sidebar-left">Side</div><p class="share-price">Shares rose</p>'
    got = text_of(spark, [("http://a.b/1", page), ("http://c.d/1", open_page)])
    assert got[0].text == "Title\n\nShares rose\n\nComments on law\n\nA month\n\nBody"
    assert got[1].text == "Comments on law\n\nShares rose"


def test_repeated_runs_go_from_open_blocks(spark):
    line = "this site uses small files to remember what you did"
    pages = [("http://h.x/1", f"<p>{line}</p><p>alpha beta gamma</p>"), ("http://h.x/2", f"<p>delta epsilon</p><p>{line} and more</p>")]
    pages += [("http://other.x/1", f"<p>{line}</p>"), ("http://h.x/3", "<article><p>copy of an article with words</p></article>"), ("http://h.x/4", "<article><p>copy of an article with words</p></article>")]
    got = text_of(spark, pages + pages[:1])
    assert got[0].text == "alpha beta gamma" and got[1].text == "delta epsilon\n\nand more" and got[2].text == line
    assert got[3].text == got[4].text == "copy of an article with words" and got[5].text == got[0].text


def test_near_copies_and_quotations_on_unmarked_pages_stay(spark):
    def words(i, n):
        return " ".join(f"w{i}x{k}" for k in range(n))

    notice, quote = words("notice", 14), words("quote", 20)
    article = [words("a", 40), words("b", 30), words("c", 25)]
    copy = [article[0].replace("wax20", "other"), *article[1:]]
    # Two near copies alone, and among other pages; a quotation, a heading and a common phrase on two of them; the notice on all.
    pages = [("http://two.x/1", article), ("http://two.x/2", copy)]
    expected = [article, copy]
    for i, own in enumerate([article, copy, *([f"{words(i, 12)} {quote} {words(i + 50, 12)}", "A shared heading", words(i + 90, 15)] for i in (1, 2)), *([words(i, 35)] for i in range(3, 9))]):
        pages.append((f"http://many.x/{i}", [*own, notice]))
        expected.append(own)
    got = text_of(spark, [(url, "".join(f"<p>{x}</p>" for x in own)) for url, own in pages])
    assert [got[i].text for i in range(len(pages))] == ["\n\n".join(x) for x in expected]


def test_no_pages(spark):
    assert host_suffix.main_text(spark.createDataFrame([], ROW)).count() == 0


def plain_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in (*ALLOW, *BLOCK) if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len) if fits else None


@pytest.mark.parametrize("bytes_allowed", [url_filter.MAX_BYTES, 0])
def test_cascade_is_exact(spark, monkeypatch, bytes_allowed):
    monkeypatch.setattr(url_filter, "MAX_BYTES", bytes_allowed)
    if not bytes_allowed:  # a level too large is never built
        monkeypatch.setattr(url_filter, "Level", None)
    urls = [f"http://h{i}.org/p{i % 3}" for i in range(400)] + ["HTTP://WWW.Example.COM/en/x?q#f", "https://a.net/es/1", "https://a.net", "no url", "", None, "x://É.com#://y/"]
    urls += urls[:3]
    listed = {f"h{i}.org" for i in range(0, 400, 7)} | {"absent.org"}
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r.page_id: r for r in url_filter.judge(df, "url", ALLOW, BLOCK, spark.createDataFrame([(x,) for x in listed], "key string"), keep=["page_id"]).collect()}
    for i, u in enumerate(urls):
        host, path, rule = plain_url(u)
        verdict = ("allow" if rule in ALLOW else "block") if rule else ("block" if host in listed else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u


def test_cascade_without_keys(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert url_filter.judge(empty, "url", ALLOW, BLOCK, none, keep=["page_id"]).count() == 0


def test_revisits_against_a_loop(spark):
    url = "http://A.com:80/x?b=2&utm_x=1&a=1#f"
    rows = []
    for i in range(300):
        kind = "response" if i % 3 == 0 else "revisit"
        headers = {"ETag": f'"{i // 50}"', "Server": "a"} if kind == "response" else {"etag": f'W/"{i // 60}"', "Date": str(i), "server": "b"}
        rows.append((f"id{i}", kind, url if i % 4 else "http://a.com/x?a=1&b=2", 10 * (i // 2), headers, "clash"))
    rows += [("n1", "revisit", None, 5, {}, ""), ("n2", "revisit", url, None, None, ""), ("n3", "response", url, None, {}, ""), ("n4", "revisit", "http://b.com", 5, {}, ""), (None, None, None, None, None, None)]
    rows += [("d1", "response", "http://c.com/", 1, {"Last-Modified": "x", "Content-Type": "t"}, ""), ("d2", "revisit", "http://c.com", 2, {"LAST-MODIFIED": "x", "Expires": "e", "content-type": "no"}, "")]
    rows += [("u", "revisit", "http://c.com", 3, {}, ""), rows[1]]
    got = revisits.resolve(spark.createDataFrame(rows, "record_id string, kind string, url string, ts long, headers map<string,string>, slice string")).collect()
    assert len(got) == sum(1 for r in rows if r[1] == "revisit")
    for g in got:
        if not g.record_id.startswith("id"):
            continue
        earlier = [r for r in rows if r[1] == "response" and r[0].startswith("id") and r[3] < g.ts]
        if not earlier:
            assert g.outcome == "no_response" and g.response_id is None
            continue
        best = max(earlier, key=lambda r: (r[3], r[0]))
        own = next(r for r in rows if r[0] == g.record_id)
        agrees = own[4]["etag"].removeprefix("W/") == best[4]["ETag"]
        assert (g.response_id, g.outcome) == (best[0], "verified" if agrees else "mismatch")
        assert g.headers == ({"etag": own[4]["etag"], "date": own[4]["Date"], "server": "a"} if agrees else {"etag": own[4]["etag"], "date": own[4]["Date"], "server": "b"})
    other = {g.record_id: g for g in got}
    assert [other[x].outcome for x in ("n1", "n2", "n4")] == ["no_response"] * 3
    assert other["d2"].headers == {"last-modified": "x", "expires": "e", "content-type": "t"} and other["d2"].outcome == "verified" and other["u"].outcome == "unverified"


def test_captures_have_every_outcome(spark):
    """Several fetches of a url, and revisits before, between and after them, one of them at a wild time."""
    pages = spark.createDataFrame([(i, f"http://www.example.org/p{i}", f"<p>{i}</p>") for i in range(60)], "page_id long, url string, html string")
    records = revisits.captures(pages)
    wild = spark.createDataFrame([("w", "revisit", "http://www.example.org/p1", 1 << 62, {}), ("w2", "revisit", "http://www.example.org/p1", -(1 << 62), {})], records.schema)
    got = {r.record_id: r for r in revisits.resolve(records.union(wild)).collect()}
    assert len(got) == 60 + 60 + 12 + 2 and {r.outcome for r in got.values()} == {"verified", "mismatch", "unverified", "no_response"}
    for i in range(60):
        last = f"r{i}b" if i % 3 else f"r{i}a"
        assert (got[f"v{i}a"].response_id, got[f"v{i}a"].outcome) == (f"r{i}a", "verified") and got[f"v{i}b"].response_id == last
        changed = i % 3 > 0
        assert got[f"v{i}b"].outcome == ("verified", "mismatch" if changed else "verified", "mismatch" if changed else "verified", "unverified")[i % 4]
        if i % 5 == 0:
            assert (got[f"v{i}c"].response_id, got[f"v{i}c"].outcome) == (None, "no_response")
    assert (got["w"].response_id, got["w2"].outcome) == ("r1b", "no_response")
    assert revisits.resolve(records.limit(0)).count() == 0


def test_suffix_array_judges_articles(spark):
    """Unmarked notices inside article markup go; what fewer pages share, copies of articles and blocks with words of their own stay."""
    def words(i, n):
        return " ".join(f"w{i}x{k}" for k in range(n))

    def article(own):
        return "<nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in own) + "</article><footer>Foot</footer>"

    notice, line, quote = words("n", 34), "Read more here", words("q", 25)
    base = [words("title", 5), *[words(f"copy{k}", 30) for k in range(4)]]
    pages, expected = [], []
    for i in range(14):
        # The notice stands first, last or inside; twice a block has it beside words of its own.
        own = [words(f"h{i}", 6), words(f"a{i}", 40), *([quote] if i < 7 else []), f"{words(f'b{i}', 3)} {notice}" if i == 5 else words(f"b{i}", 20), f"{notice} more" if i == 9 else words(f"c{i}", 12)]
        at = (0, 2, len(own))[i % 3]
        pages.append(("http://site.x/%d" % i, article([*own[:at], notice, *own[at:], line])))
        expected.append(own)
        # Changed copies of one article, each with another block changed, and pages that would lose nearly all.
        changed = [*base]
        changed[i % 5] = words(f"new{i}", 40)
        pages.append(("http://copies.x/%d" % i, article(changed)))
        expected.append(changed)
        short = [words(f"s{i}", 2), words(f"t{i}", 3), notice]
        pages.append(("http://short.x/%d" % i, article(short)))
        expected.append(short)
        # Fewer articles than it takes.
        if i < 9:
            few = [words(f"f{i}", 6), words(f"g{i}", 30), notice]
            pages.append(("http://few.x/%d" % i, article(few)))
            expected.append(few)
    got = text_of(spark, pages + pages[:5])
    assert [got[i].text for i in range(len(pages))] == ["\n\n".join(x) for x in expected]
    assert all(got[len(pages) + i].text == got[i].text for i in range(5))
