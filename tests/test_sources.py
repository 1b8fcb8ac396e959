import pytest
from pyspark.sql import functions as F

from fernglass.sources import article, codec, discovery, feeds, opml, robots

RSS = b"""<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:sy="http://purl.org/rss/1.0/modules/syndication/" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>A site</title><link>https://site.example/</link><ttl>45</ttl><sy:updatePeriod>hourly</sy:updatePeriod><generator>Gen</generator>
<atom:link rel="hub" href="https://hub.example/"/><image><url>https://site.example/i.png</url></image><category> b </category><category>a</category>
<item><title>One</title><link>/one?utm_source=x</link><guid isPermaLink="false">g1</guid><content:encoded><![CDATA[<p>Full &amp; long</p>]]></content:encoded><description>Short</description>
<pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><dc:creator>Ann</dc:creator><comments>/one#c</comments><enclosure url="/a.mp3" type="audio/mpeg" length="3"/></item>
<item><title>Two</title><link>https://site.example/two</link></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title>At</title><subtitle>Sub</subtitle><icon>i.png</icon><link href="https://at.example/"/>
<entry><id>urn:uuid:1</id><title>E</title><link href="e1"/><updated>2024-01-02T00:00:00Z</updated><content type="html">&lt;b&gt;x&lt;/b&gt;</content><summary>s</summary></entry></feed>"""
BROKEN = b"<rss><channel><title>B & C</title><item><title>Alive & well</title><guid>1</guid></item><item><title>Too</title></item>"


def test_feeds():
    f = feeds.parse_feed(RSS, "https://site.example/feed")
    assert (f["title"], f["ok"], f["note"], f["hub_url"], f["platform"], f["categories"], f["icon_url"]) == ("A site", True, "", "https://hub.example/", "Gen", ["a", "b"], "https://site.example/i.png")
    one, two = f["items"]
    assert (one["guid"], one["url"], one["content"], one["summary"], one["author"], one["comments_url"]) == ("g1", "https://site.example/one?utm_source=x", "<p>Full &amp; long</p>", "Short", "Ann", "https://site.example/one#c")
    assert one["enclosures"] == [{"url": "https://site.example/a.mp3", "type": "audio/mpeg", "length": "3"}] and one["updated_at"] == "" and two["guid"] == ""
    a = feeds.parse_feed(ATOM, "https://at.example/feed")
    assert (a["description"], a["items"][0]["guid"], a["items"][0]["content"], a["items"][0]["url"], a["items"][0]["published_at"]) == ("Sub", "urn:uuid:1", "<b>x</b>", "https://at.example/e1", "")
    b = feeds.parse_feed(BROKEN)
    assert b["ok"] and b["note"] and [i["title"] for i in b["items"]] == ["Alive & well", "Too"]
    assert not feeds.parse_feed(b"")["ok"] and not feeds.parse_feed(None)["ok"] and not feeds.parse_feed(b"nothing at all")["ok"]


def test_feeds_as_rows(spark):
    df = spark.createDataFrame([(1, "https://site.example/feed", RSS, "x"), (2, None, None, "y")], "id long, url string, body binary, extra string")
    parsed = feeds.parsed_feeds(df, keep=["id"])
    assert {r.id: r.ok for r in parsed.collect()} == {1: True, 2: False}
    assert [(r.id, r.item_no, r.guid) for r in feeds.items(parsed, ["id"]).orderBy("item_no").collect()] == [(1, 0, "g1"), (1, 1, "")]


def test_opml(spark):
    doc = b'<opml><body><outline text="News"><outline title="A &amp; B" xmlUrl="https://a/f" htmlUrl="https://a"/><outline><outline text="Deep" xmlurl="https://d/f"/></outline></outline><outline text="Site" htmlUrl="https://s"/></body></opml>'
    assert opml.outlines(doc) == [("A & B", "https://a/f", "https://a", "News", False), ("Deep", "https://d/f", "", "News", False), ("Site", "https://s", "https://s", "", True)]
    for bad in (b'<!DOCTYPE x [<!ENTITY a "b">]><opml/>', b"<opml>", b"x" * (opml.MAX_BYTES + 1)):
        with pytest.raises(ValueError):
            opml.outlines(bad)
    subs = spark.createDataFrame([("b", "https://b", "", "X & Y"), ("A", "https://a", "", "X & Y"), ('q"<', "https://q", "s", "")], "title string, url string, site_url string, category string")
    one, two = opml.rendered(subs).collect()[0].opml, opml.rendered(subs.orderBy("url").repartition(3)).collect()[0].opml
    assert one == two
    assert [(t, c) for t, _, _, c, _ in opml.outlines(one.encode())] == [('q"<', ""), ("A", "X & Y"), ("b", "X & Y")]


def test_discovery(spark):
    page = '<link rel="alternate" type="application/rss+xml" href="/f"><LINK href=/g rel="ALTERNATE feed" type=application/atom+xml><link rel="alternate" type="application/rss+xml" href="/f"><link rel=stylesheet href=x>'
    assert discovery.feeds_in(page, "https://a.b/c") == ["https://a.b/f", "https://a.b/g"]
    df = spark.createDataFrame([(b"<?xml version='1.0'?><rss/>", "https://a.b/f"), (None, "x")], "p binary, b string")
    assert [r[0] for r in df.select(discovery.announced("p", "b")).collect()] == [["https://a.b/f"], []]


def test_robots(spark):
    r = robots.parse("User-agent: *\nDisallow: /\n\nUser-agent: fernglass\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow: /q?x=\nCrawl-delay: 500")
    ok = {"/": True, "/private": False, "/private/open/x": True, "/a.pdf": False, "/a.pdfx": True, "/q?x=1": False, "/robots.txt": True}
    assert {p: r.allows("https://h" + p) for p in ok} == ok and r.crawl_delay() == 120.0 and not r.blocks_everything()
    assert robots.parse("User-agent: *\nDisallow: /").blocks_everything() and robots.may_poll(robots.parse("User-agent: *\nDisallow: /"), "https://h/f")
    assert robots.parse("").allows("https://h/x") and robots.parse("Disallow: /x").allows("https://h/x")
    tie = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a")
    assert tie.allows("https://h/a")
    u = spark.createDataFrame([("h", "https://h/x"), ("i", "https://i/x")], "host_name string, url string")
    b = spark.createDataFrame([("h", b"User-agent: *\nDisallow: /x")], "host_name string, body binary")
    assert {x.url: (x.known, x.allowed) for x in robots.verdicts(u, b).collect()} == {"https://h/x": (True, False), "https://i/x": (False, None)}


def test_article(spark):
    page = """<html lang="en"><head><title>T - S</title><meta property="og:site_name" content="S"><meta name="author" content="Ann"><meta property="og:image" content="/lead.png">
    <script>var x = "<p>no</p>"</script></head><body><nav><a href="/n">Nav</a></nav><article><h1>Head</h1><p>First <a href="/l">link</a>.</p><img src="/lead.png"><img src="b.png" alt="B"><ul><li>one</li><li>two</li></ul></article><footer>Foot</footer></body></html>"""
    a = article.extract(page, "https://s.io/a/")
    assert a["body"] == "# Head\n\nFirst [link](https://s.io/l).\n\n- one\n- two" and (a["title"], a["byline"], a["site_name"], a["language"]) == ("T - S", "Ann", "S", "en")
    assert a["images"] == [{"url": "https://s.io/lead.png", "alt": "", "role": "lead"}, {"url": "https://s.io/a/b.png", "alt": "B", "role": "body"}] and a["links"] == [{"anchor": "link", "url": "https://s.io/l"}]
    assert article.extract("")["body"] == "" and article.extract("<p>a<p>b", fragment=True)["body"] == "a\n\nb"
    df = spark.createDataFrame([(1, page.encode(), "https://s.io/"), (2, None, None), (3, "<p>caf\xe9</p>".encode("latin-1"), None)], "id long, body binary, final_url string")
    assert {r.id: r.body for r in article.extracted(df, "id").collect()}[3] == "café"


def test_codec(spark):
    samples = [(f"<html><head><title>{i}</title></head><body>" + "the same words again and again " * 30 + str(i * 7919) + "</body></html>").encode() for i in range(60)]
    t = codec.train(samples, ladder=(1024, 4096))
    assert t is not None and codec.train(samples[:10]) is None
    frame = codec.compress(samples[0], t.body)
    assert codec.expand(frame, {t.dict_id: t.body}) == samples[0] and codec.expand(b"plain") == b"plain"
    with pytest.raises(KeyError):
        codec.expand(frame, {})
    df = spark.createDataFrame([(1, b"x" * 100), (2, None)], "id long, body binary")
    got = {r.id: r for r in codec.compressed(df, "id").collect()}
    assert codec.expand(bytes(got[1].frame)) == b"x" * 100 and got[2].frame is None
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(samples)] + [(2, 1, b"x")], "k long, o long, body binary")
    assert [(r.k, r.sample_count) for r in codec.trained(rows, "k", ["o"]).where(F.col("k") > 0).collect()] in ([(1, 59)], [])


def test_a_ban_on_everything_beside_an_allowed_feed():
    r = robots.parse("User-agent: *\nDisallow: /\nAllow: /own/list.rss")
    assert r.blocks_everything() and r.allows("http://w/own/list.rss") and robots.may_poll(r, "http://w/own/list.rss") and robots.may_poll(r, "http://w/other")
    assert not robots.may_poll(robots.parse("User-agent: *\nDisallow: /own/"), "http://w/own/list.rss")


def test_redirects(spark):
    rules = spark.createDataFrame([("b.w", b"User-agent: *\nDisallow: /no\n")], "host_name string, body binary")
    visits = [(1, "a.w", "a.w", "http://a.w/x"), (2, "a.w", "b.w", "http://b.w/yes"), (3, "a.w", "b.w", "http://b.w/no"), (4, "a.w", "c.w", "http://c.w/x"), (5, None, None, None)]
    df = spark.createDataFrame(visits, "visit_id int, requested_host string, host_name string, url string")
    assert {r.visit_id: r.may_keep for r in robots.redirect_verdicts(df, rules).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_lists_without_body_and_below_feeds():
    with pytest.raises(ValueError):
        opml.outlines(b"<opml><outline xmlUrl='https://w/f'/></opml>")
    assert [u for _, u, *_ in opml.outlines(b"<opml><body><outline text='A' xmlUrl='https://w/f'><outline xmlUrl='https://w/g'/></outline></body></opml>")] == ["https://w/f"]


def test_an_entry_without_content_has_its_summary():
    doc = b"<rss><channel><item><title>T</title><description>Short words</description></item></channel></rss>"
    assert feeds.parse_feed(doc)["items"][0]["content"] == "Short words"
