import math
import os

import duckdb
import pytest

from lumenfold.functions import net, text, urls
from lumenfold.plans import catalog
from lumenfold.sources import feeds


@pytest.fixture(scope="session")
def db(data):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(data):
        c.sql(f"create view {f[:-8]} as from '{data}/{f}'")
    return c


def norm(v):
    return "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    rel = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(map(norm, r)) for r in rel.select(",".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_canonical_matches_the_tables(spark, data):
    items = spark.read.parquet(f"{data}/items.parquet")
    from pyspark.sql import functions as F

    assert items.filter(~urls.canonical_url(F.col("url")).eqNullSafe(F.col("canonical_url"))).count() == 0


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://News.Harbour.example/notes/tide/", "https://news.harbour.example/notes/tide"),
        ("https://harbour.example:443/tide#high", "https://harbour.example/tide"),
        ("http://harbour.example/t?z=2&b=1", "https://harbour.example/t?b=1&z=2"),
        ("https://harbour.example", "https://harbour.example/"),
        ("https://quay.blogspot.com/2026/07/a.html?m=1", "https://quay.blogspot.com/2026/07/a.html"),
        ("https://harbour.example/find?m=1", "https://harbour.example/find?m=1"),
        ("https://harbour.example/t?id=9&UTM_medium=x&gclid=q", "https://harbour.example/t?id=9"),
        ("https://[2001:DB8::1]:8443/x?b=2&a=1", "https://[2001:db8::1]/x?a=1&b=2"), ("https://harbour.example/a/../b/./c/", "https://harbour.example/b/c"),
        ("https://harbour.example/high tide?q=a b", "https://harbour.example/high%20tide?q=a+b"), ("https://harbour.example/港?utm_source=x", "https://harbour.example/%E6%B8%AF"),
        ("https://köln.example/x", "https://xn--kln-sna.example/x"), ("https://harbour.example/%2e%2e/x", "https://harbour.example/x"),
        ("data:text/plain,x", None), ("tel:1", None), ("", None), ("no address", None), ("https://", None), ("https://[::g]/", None), (None, None),
    ],
)
def test_canonical(spark, url, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical_url(F.col("u"))).head()[0] == want


def test_resolve(spark):
    rows = [
        ("/notes/tide", "https://quay.example/rss"), ("http://quay.example/a", "x"), ("data:x", "https://quay.example"), (None, None), ("  ", "https://quay.example"),
        ("../b?utm_source=q&k=v%20w", "https://quay.example/x/y/z"), ("https://quay.example/a b/./c#d e", None), ("//o.example", "http://quay.example/"), ("/rel", None),
        ("https://quay.example/p?k=v%20w", None),
    ]
    got = urls.with_resolved(spark.createDataFrame(rows, "h string, b string"), "h", "b").select("resolved").collect()
    assert [r[0] for r in got] == [
        "https://quay.example/notes/tide", "http://quay.example/a", None, None, None, "https://quay.example/x/b?k=v+w", "https://quay.example/a%20b/c#d%20e", "http://o.example/", None,
        "https://quay.example/p?k=v%20w",
    ]


def test_absolutize():
    base = "https://quay.example/notes/tide"
    assert urls.absolutize('<a href="/low"><img src="pics/b.png">', base) == '<a href="https://quay.example/low"><img src="https://quay.example/notes/pics/b.png">'
    assert urls.absolutize("<video poster='//cdn.quay.example/v.jpg'>", base) == "<video poster='https://cdn.quay.example/v.jpg'>"
    for same in ('<a href="#high">', '<img src="data:y">', '<a href="https://z.example/">'):
        assert urls.absolutize(same, base) == same


def test_snippet_marks_before_it_escapes(spark):
    from pyspark.sql import functions as F

    rows = [("Salt & amp sizes <b>",), ("scamper and camp",), ("a \"Quay\" by the quay",), ("港の新しい船",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(text.snippet(F.col("t"), ["amp", "quay", "新しい", "(x"])).collect()]
    mark = '<span class="keyword">{}</span>'
    assert got[0] == f"Salt &amp; {mark.format('amp')} sizes &lt;b&gt;" and got[1] is None
    assert got[2] == f"a &quot;{mark.format('Quay')}&quot; by the {mark.format('quay')}" and got[3] == f"港の{mark.format('新しい')}船"
    assert [r[0] for r in df.select(text.snippet(F.col("t"), [])).collect()] == [None] * 4


def test_snippet_text():
    for s, want in [("salt &amp; pepper", "salt & pepper"), ("&#28207;&#21475;", "港口"), ("&amp;gt;", "&gt;"), ("&amp;#62;", "&#62;"), ("5 &pound;", "5 &pound;"), ("&#88888888;", "&#88888888;"), (None, "")]:
        assert text.snippet_to_text(s) == want
    assert len(text.search_terms(" ".join(["w"] * 100))) == 32


def test_addresses():
    assert net.blocked("169.254.169.254", True) and net.blocked("127.0.0.1") and not net.blocked("127.0.0.1", True)
    assert net.blocked("fe90::1") and net.blocked("febf::1") and not net.blocked("2606:2800:220:1:248:1893:25c8:1946")


def test_malformed_feeds():
    assert feeds.parse_xml("<rss") is None and feeds.parse_json("{") is None and feeds.parse_json("[]") is None


def test_search_plan_stays_in_the_jvm(spark, data):
    plan = catalog.hybrid_search(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "TakeOrderedAndProject" in plan


def test_a_short_text_beats_a_long_one(spark):
    from lumenfold.operators import search

    rows = [("short", "Zig tides. New Zig build, with notes on Zig memory.", "2026-07-09"), ("long", "nothing to see in this line. " * 40 + "Zig " * 5, "2026-07-08"), ("ja", "港の天気予報について書いた。", "2026-07-07")]
    df = spark.createDataFrame(rows, "id string, search_text string, p string").selectExpr("id", "search_text", "to_timestamp(p) published_at")
    assert [r["id"] for r in search.text_arm(df, ["Zig"], 10).orderBy("text_rank").collect()] == ["short", "long"]
    assert [r["id"] for r in search.text_arm(df, ["天気予報"], 10).collect()] == ["ja"]
    assert search.text_arm(df, ["(AND)", "-Zig", "'quoted'", "\\Q"], 10).count() == 0


def test_an_empty_query_has_no_hits_and_its_mode(spark, data):
    from lumenfold.operators import search

    items = catalog._items(spark, data)
    both, alone = search.search(items, [], catalog._distances(spark, data)), search.search(items, [])
    assert (both.mode, alone.mode) == ("hybrid", "text-only") and both.hits.count() == alone.hits.count() == 0
    assert both.hits.columns == alone.hits.columns == list(search.HIT_COLUMNS)


def test_requests():
    import datetime as dt

    from lumenfold.operators import requests

    now = dt.datetime(2026, 8, 10, tzinfo=dt.timezone.utc)
    assert requests.list_request() == requests.ListRequest(True, 50, None) and requests.list_request("false", "500", "s") == requests.ListRequest(False, 500, "s")
    got = requests.search_request(" tide  high ", now, since="2d")
    assert got.terms == ["tide", "high"] and got.limit == 20 and got.since == now - dt.timedelta(days=2) and not got.unread_only
    for bad in (lambda: requests.list_request(limit=0), lambda: requests.list_request(limit=501), lambda: requests.list_request(limit="1.5"), lambda: requests.list_request(unread="maybe"),
                lambda: requests.search_request("  ", now), lambda: requests.search_request("x", now, limit=101), lambda: requests.search_request("x", now, since="soon")):
        with pytest.raises(ValueError):
            bad()


def test_feed_names_and_labels():
    rss = """<rss xmlns:media="http://m.example/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pod="http://p.example/"><channel>
    <item><media:title>cover</media:title><title>Low <b>x</b>tide</title><link>https://quay.example/1</link><pod:summary>not this</pod:summary><dc:creator>Rin</dc:creator><author>other</author></item>
    <item><title>No link</title><url>https://quay.example/2</url></item><item><title>Nothing</title></item></channel></rss>"""
    one, two = feeds.parse_xml(rss)
    assert (one["title"], one["author"], one["content_html"], one["summary"]) == ("Low tide", "Rin", None, None) and two["url"] == "https://quay.example/2"
    for raw, label, want in ((b"\x93t\x94\x81", "iso-8859-1", "“t”\x81"), (b"\xe9", "us-ascii", "é"), ("港".encode("euc_jp"), "x-euc-jp", "港"), ("囧".encode("gbk"), "gb2312", "囧"), ("港".encode("cp932"), "Windows-31J", "港")):
        assert feeds.decode_bytes(raw, f"text/html; charset={label}") == want


def test_markdown():
    body = '<h2>Tide</h2><p>Some <strong>high</strong> <a href="/l">link</a><br>next</p><ol><li>one</li><li>two</li></ol><blockquote><p>said</p></blockquote><pre><code>a\n  b</code></pre><script>x</script>'
    assert text.to_markdown(body) == "## Tide\n\nSome **high** [link](/l)  \nnext\n\n1. one\n2. two\n\n> said\n\n```\na\n  b\n```"
    assert text.to_markdown(None) is None and text.to_markdown("") == ""


def test_stream(spark, tmp_path):
    from lumenfold.streaming.poll import poll_files

    (tmp_path / "in").mkdir()
    sources = spark.createDataFrame([("quay", "https://quay.example/rss", None, '{"tz": "Asia/Tokyo"}')], "id string, url string, site_url string, config string")
    feed = '<rss><channel><item><title>{0}</title><link>/{0}</link><pubDate>2026-07-09 12:00</pubDate><description>&lt;img src="a.png"&gt;</description></item></channel></rss>'
    for name, n in (("quay", 1), ("quay", 1), ("quay", 2), ("other", 3)):
        (tmp_path / "in" / f"{name}.xml").write_text(feed.format(n))
        q = poll_files(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / f"ckpt{n}"), sources)
        q.awaitTermination(90)
    got = {r["url"]: r for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    # the file of a source that is not known has no base for its link
    assert sorted(got) == ["https://quay.example/1", "https://quay.example/2"]
    one = got["https://quay.example/1"]
    assert str(one["published_at"]) == "2026-07-09 03:00:00" and one["content_html"] == '<img src="https://quay.example/a.png">'


def test_a_broken_store_is_no_empty_store(spark, tmp_path):
    from lumenfold.streaming.poll import ingest_batch

    (tmp_path / "store" / "part=00").mkdir(parents=True)
    (tmp_path / "store" / "part=00" / "x.parquet").write_text("no parquet")
    files = spark.createDataFrame([("/a/quay.xml", bytearray(catalog.RSS.encode()))], "path string, content binary")
    # a store that cannot be read must not look empty: the batch fails, or its parts prove the item new without it
    items = ingest_batch(files, str(tmp_path / "store"))
    parts = {r["part"] for r in ingest_batch(files, str(tmp_path / "none")).collect()}
    if "00" in parts:
        with pytest.raises(Exception):
            items.count()
    else:
        assert items.count() == 1


def test_outcomes_states_and_versions(spark, tmp_path):
    from pyspark.sql import functions as F

    from lumenfold.operators import embeddings, ingest

    rows = [(304, None, "a"), (200, "a", "a"), (200, "b", "a"), (200, "b", None), (404, None, "a"), (503, None, "a"), (429, None, "a")]
    df = spark.createDataFrame(rows, "status int, h string, last string")
    got = [r[0] for r in df.select(ingest.fetch_outcome(F.col("status"), F.col("h"), F.col("last"))).collect()]
    assert got == ["unchanged", "unchanged", "fetched", "fetched", "failed", "retry", "retry"]
    assert [embeddings.model_state(*x) for x in [(None, None), (("p", "m"), None), (("p", "m"), ("p", "m")), (("p", "m"), ("p", "n"))]] == ["disabled", "uninitialised", "ready", "mismatch"]
    v = spark.createDataFrame([("i", [1.0])], "item_id string, embedding array<float>")
    for n in (1, 2):
        embeddings.reindex(v, str(tmp_path / "s"), n)
    assert embeddings.current_vectors(spark, str(tmp_path / "s")).count() == 1
    with pytest.raises(ValueError):
        embeddings.check_width(2001)


def test_embed_pass_splits_failing_batches(spark):
    from lumenfold.operators import embeddings

    def provider(texts):
        if any("bad" in t for t in texts):
            raise embeddings.Rejected("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "xyz")], "item_id string, text string")
    got = {r["item_id"]: (r["embedding"], r["error"]) for r in embeddings.embed_pass(df.coalesce(1), provider).collect()}
    assert got == {"a": ([1.0], None), "b": (None, "no"), "c": ([3.0], None)}
    assert embeddings.pass_totals(embeddings.embed_pass(df, provider)).head() == (2, 1, False)
    assert embeddings.pass_totals(embeddings.embed_pass(df.limit(0), provider)).head()["idle"]


def test_an_outage_blames_no_text(spark):
    from lumenfold.operators import embeddings

    def down(texts):
        raise RuntimeError("outage")

    df = spark.createDataFrame([("a", "x"), ("b", "y")], "item_id string, text string")
    with pytest.raises(Exception, match="outage"):
        embeddings.embed_pass(df, down).collect()
    waits, idle = [], iter([False, True])
    assert embeddings.embed_loop(lambda: next(idle), lambda: len(waits) >= 3, waits.append) == 3 and waits == [0.25, 30.0, 30.0]


def test_reindex_needs_the_model_name(spark, tmp_path):
    from lumenfold.operators import embeddings

    v = spark.createDataFrame([("i", [1.0]), ("j", [1.0, 2.0])], "item_id string, embedding array<float>")
    for bad in (lambda: embeddings.reindex(v.limit(1), str(tmp_path), 1, "a", "b"), lambda: embeddings.reindex(v, str(tmp_path), 1)):
        with pytest.raises(ValueError):
            bad()


def test_state_patch(spark):
    from lumenfold.operators import timeline

    log = spark.createDataFrame([("u", "i", "2026-01-01", None, "2026-01-01")], "user_id string, item_id string, r string, s string, w string").selectExpr(
        "user_id", "item_id", "to_timestamp(r) read_at", "to_timestamp(s) starred_at", "to_timestamp(w) updated_at")
    patch = spark.createDataFrame([("u", "i", False, True), ("u", "j", None, True)], "user_id string, item_id string, read_at boolean, starred_at boolean")
    got = {r["item_id"]: r for r in timeline.latest_state(timeline.patch_state(log, patch, "2026-02-01 00:00:00")).collect()}
    assert got["i"]["read_at"] is None and got["i"]["starred_at"] is not None and got["j"]["starred_at"] is not None and got["j"]["read_at"] is None
