"""The feeds data source: partitions, filters that open fewer documents, polls as offsets."""

from pyspark.sql import functions as F

from quillspark.sources.feed_source import Document, FeedSource, register, shares
from quillspark.streaming.runs import drain

RSS = "<rss><channel>{}</channel></rss>"
ITEM = "<item><guid>{0}</guid><title>T {0}</title><link>/{0}</link><description>&lt;p&gt;x&lt;/p&gt;</description></item>"


def store(path, poll, feeds, whole=True):
    for feed, text in feeds.items():
        at = path / f"poll={poll}" / f"feed_id={feed}"
        at.mkdir(parents=True)
        (at / "doc.xml").write_text(text)
        (at / ".doc.xml.crc").write_text("?")
    if whole:
        (path / f"poll={poll}" / "_SUCCESS").touch()


def feed(*guids):
    return RSS.format("".join(ITEM.format(g) for g in guids))


def load(spark, path):
    return register(spark).read.format("feeds").option("base", "https://h.org/").load(str(path))


def test_batch_read(spark, tmp_path):
    store(tmp_path, 0, {1: feed("a", "b"), 2: "<broken", 3: '{"items": [{"id": "j", "url": "https://k.org/j", "content_text": "t"}]}', 4: RSS.format("")})
    rows = load(spark, tmp_path)
    assert rows.rdd.getNumPartitions() == 4
    got = {(r.feed_id, r.guid): (r.position, r.url, r.inline_html) for r in rows.filter("error IS NULL").collect()}
    assert got == {(1, "a"): (0, "https://h.org/a", "<p>x</p>"), (1, "b"): (1, "https://h.org/b", "<p>x</p>"), (3, "j"): (0, "https://k.org/j", "t")}
    assert [r.feed_id for r in rows.filter("error IS NOT NULL").collect()] == [2]


def test_filters_choose_documents(spark, tmp_path):
    store(tmp_path, 0, {k: feed(f"a{k}") for k in range(6)})
    store(tmp_path, 1, {k: feed(f"b{k}") for k in range(6)})
    rows = load(spark, tmp_path)
    for condition, n in (("feed_id = 2", 2), ("feed_id IN (1, 4) AND poll = 1", 2), ("feed_id = 2 AND feed_id = 3", 0), ("guid = 'a1'", 12), ("poll = 1 AND title = 'T b3'", 6)):
        chosen = rows.filter(condition)
        want = [r.guid for r in rows.collect() if (r.feed_id, r.poll, r.guid, r.title) in {tuple(x) for x in rows.select("feed_id", "poll", "guid", "title").filter(condition).collect()}]
        assert sorted(r.guid for r in chosen.collect()) == sorted(want)
        opened = chosen.rdd.getNumPartitions()
        assert opened == n, (condition, opened)


def test_polls_are_read_once(spark, tmp_path):
    path, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    make = lambda: register(spark).readStream.format("feeds").option("base", "https://h.org/").load(str(path)).select("poll", "feed_id", "guid")
    read = lambda: sorted((r.poll, r.guid) for r in drain(make(), out, check).collect())
    store(path, 0, {1: feed("a"), 2: feed("b", "c")})
    store(path, 1, {1: feed("a", "d")}, whole=False)
    assert read() == [(0, "a"), (0, "b"), (0, "c")]
    (path / "poll=1" / "_SUCCESS").touch()
    assert read() == read() == [(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "d")]


def test_nothing_there(spark, tmp_path):
    assert load(spark, tmp_path / "none").count() == 0 and FeedSource({"path": "x"}).schema().startswith("poll int")
    assert load(spark, tmp_path / "none").select(F.col("feed_id")).dtypes == [("feed_id", "bigint")]


def test_many_documents_share_partitions(spark, tmp_path):
    store(tmp_path, 0, {k: feed(f"a{k}") for k in range(300)})
    rows = load(spark, tmp_path)
    assert 90 <= rows.rdd.getNumPartitions() <= 100
    assert sorted(r.guid for r in rows.collect()) == sorted(f"a{k}" for k in range(300))
    large = [Document(str(k), 0, k, 40 << 20 if k == 7 else 1 << 20) for k in range(2000)]
    dealt = [p.held for p in shares(large)]
    assert [d for held in dealt for d in held] == large and [len(h) for h in dealt if large[7] in h] == [1] and max(map(len, dealt)) == 15
