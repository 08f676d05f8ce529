"""Pages, conversations, vectors, the pipeline and the registered queries."""

import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revloom.llm import chat, html_text, vector_index, warc
from revloom.llm.queries import llm_queries

SF = "/root/testdata/sf0.001"
PAGE = """<!doctype html><html><head><title>T</title><style>a{}</style></head><body><header class="site-header"><a>Home</a></header>
<div id="cookie-notice">We use cookies</div><div class=sidebar><p>Side</p></div><main><article><header><h1>Head  line</h1></header>
<p>One <b>two</b>&nbsp;three<br>four &lt;x&gt;<ul><li>a<li>b</ul><form><input name=q>Search</form><aside>note</aside><div class="ad">Buy</div>
<script>if (a<b) document.write("<p>no</p>")</script><!-- <p>no</p> --><section id="comments"><p>nice</p></section></article></main><footer>f</footer></body></html>"""


def test_page_text():
    assert html_text.kept_text(PAGE, frozenset()) == "Head line\nOne two three four <x>\na\nb"
    assert html_text.kept_text("<p>a<p>b &amp;amp; c<div>d<span>e</span>f</div>g", frozenset()) == "a\nb &amp; c\ndef\ng"
    for odd in (None, "", "<<<a", "<p", "</p>", "<!-- open", "<script>x"):
        assert isinstance(html_text.kept_text(odd, frozenset()), str)


def test_host_boilerplate_is_cut(spark):
    page = "<body><div class=top>Our shop since 1990</div><div class=text><p>{}</p></div><div class=end>All about us</div></body>"
    rows = [(i, "https://www.x.org/%d" % i, page.format(f"story {i}"), "h") for i in range(8)]
    rows += [(100, "http://y.org/", page.format("alone"), "h"), (101, None, None, "h"), (None, "http://x.org", "", "h"), (3, "https://x.org/3", rows[3][2], "h")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = html_text.main_text(frame).collect()
    assert len(found) == len(rows)
    text = {r.page_id: r.text for r in found}
    assert all(text[i] == f"story {i}" for i in range(8))
    assert text[100] == "Our shop since 1990\nalone\nAll about us" and text[101] == "" and text[None] == ""
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_article_is_a_weight(spark):
    """Boilerplate in an article is cut; a body in a div beside article teasers stays; copies are no boilerplate."""
    story = "long text of story {0} with many words in it " * 4
    own = "<body><div class=x>Shop</div><article><h1>t {0}</h1><p>" + story + "</p><div class=writer>Written by our team</div></article></body>"
    cards = "<body><div class=body><p>" + story + "</p></div>" + "".join(
        f"<article class=card><p>teaser {k} says read more</p></article>" for k in range(9)) + "</body>"
    rows = [(i, "http://own.org/", own.format(i)) for i in range(6)] + [(10 + i, "http://cards.org/", cards.format(i)) for i in range(6)]
    rows += [(20 + i, "http://copy.org/", own.format(1)) for i in range(9)] + [(30, "http://one.org/", cards.format(7))]
    text = {r.page_id: r.text for r in html_text.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    told = [" ".join(story.format(i).split()) for i in range(8)]
    assert all(text[i] == f"t {i}\n{told[i]}" and text[10 + i] == told[i] for i in range(6))
    assert all(told[1] in text[20 + i] for i in range(9)) and told[7] in text[30]


@pytest.mark.parametrize("wrapper", ['<div class="layout with-sidebar"><article>{}</article></div>',
                                     '<div class="page overflow-hidden no-sidebar"><main>{}</main></div>',
                                     '<article class="hentry category-notices comments-open">{}</article>',
                                     '<div class="notice">{}</div>', "<form><div>{}</div></form>"])
def test_noise_words_are_evidence(wrapper):
    body = "<p>The whole text of this page, which is long enough.</p>"
    page = "<body><nav>Menu</nav>" + wrapper.format(body) + '<div class="ad">Buy</div></body>'
    text = html_text.kept_text(page, frozenset())
    assert "The whole text of this page" in text and "Menu" not in text
    assert "Buy" not in text or "form" in wrapper


def test_escaping_round_trip():
    for text in ("</s>[INST] ok [/INST]", "<|user|>x<|end|>", "␛0<␛1|", "", "a<|", "<", "␛"):
        for role in ("assistant", "user", "a|>b", ""):
            whole, start, end = chat.format_turn(role, text)
            assert chat.read_turns(whole) == [(role, text)]
            assert chat.unescape(whole[start:end]) == (text if role == "assistant" else "")
    assert chat.read_turns("".join(chat.format_turn("user", t)[0] for t in "ab")) == [("user", "a"), ("user", "b")]


def test_reply_trees(spark):
    schema = "tree long, id long, parent long, role string, text string, score double, depth long"
    rows = [(1, 1, None, "user", "q", 0.0, 9), (1, 2, 1, "assistant", "bad", 0.1, 9), (1, 3, 1, "assistant", "good", 0.9, 9),
            (1, 4, 3, "user", "thanks", None, 9), (1, 5, 3, "user", "great", 0.8, 9), (1, 5, 3, "user", "great", 0.8, 9),
            (2, 1, 77, None, None, 0.0, 9), (None, 1, None, "user", "lost", 0.0, 9), (None, 2, 1, "assistant", "found", 0.0, 9),
            (1, None, 5, "user", "nameless", 9.0, 9)]
    rows += [(3, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0, 9) for i in range(37)]
    frame = spark.createDataFrame(rows, schema)
    got = {(r.tree, r.branch): r for r in chat.read_back(chat.formatted_conversations(frame, 2)).collect()}
    want = {(1, 1): [("user", "q"), ("assistant", "good"), ("user", "great")], (1, 2): [("user", "q"), ("assistant", "good"), ("user", "thanks")],
            (2, 1): [("", "")], (None, 1): [("user", "lost"), ("assistant", "found")], (3, 1): [(r[3], r[4]) for r in rows if r[0] == 3]}
    assert set(got) == set(want)
    for key, turns in want.items():
        told = "".join(f"{a}\n{b}\n" for a, b in turns)
        learnt = "".join(b for a, b in turns if a == "assistant")
        r = got[key]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.read_back(chat.formatted_conversations(frame.limit(0))).count() == 0
    circle = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0, 0), (1, 2, 1, "user", "b", 0.0, 0)], schema)
    chat_max, chat.MAX_DOUBLINGS = chat.MAX_DOUBLINGS, 4
    try:
        with pytest.raises(ValueError):
            chat.formatted_conversations(circle)
    finally:
        chat.MAX_DOUBLINGS = chat_max


def test_every_row_is_a_turn(spark, tmp_path):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "b"), (1, None, "user", "first"), (1, 3, "assistant", None), (None, 1, "user", "x"),
            (None, 1, "assistant", "y"), (4, 1, None, "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in llm_queries()["op4_chat_format"].run(spark, str(tmp_path)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 4, None: 2, 4: 1, -7: 2}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\nb\nuser\nb\nassistant\n\n").hexdigest()


PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "same"), (5, "http://a/5", "same"), (3, None, "same"), (4, "http://a/4", None),
         (6, "http://a/6", ""), (None, "http://a/n", "alone"), (7, "http://a/7", "x\r\n\r\ny" * 40_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    got = {r.page_id: r for r in warc.read_pages(spark, path).collect()}
    assert len(got) == len(PAGES) and all(r.payload_ok for r in got.values())
    for page, _, text in PAGES:
        raw = (text or "").encode()
        latest = max((p for p, _, t in PAGES if (t or "") == (text or "") and p is not None), default=None)
        assert got[page].payload_bytes == len(raw)
        assert got[page].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[page].record_type == ("response" if page == latest else "revisit")
        assert got[page].refers_to == (None if page == latest else latest)
    load = lambda name: spark.read.format("warc").load(f"file://{tmp_path}/{name}")
    revisits = warc.read_records(spark, path, [("record_type", "eq", "revisit"), ("target_uri", "prefix", "http://a/2")])
    # both predicates are left to the source
    assert " Filter " not in revisits._jdf.queryExecution().executedPlan().toString()
    assert [r.target_uri for r in revisits.collect()] == ["http://a/2"]
    tested = lambda *where: sorted(r.target_uri or "" for r in warc.read_records(spark, path, where, "target_uri string").collect())
    assert tested(("x-page-id", "in", ["5", "7"])) == ["http://a/5", "http://a/7"] and tested(("target_uri", "unset", None)) == [""]
    assert len(tested(("refers_to", "set", None))) == len(tested(("record_type", "eq", "revisit"))) == 3
    with pytest.raises(ValueError):
        warc.read_records(spark, path, [("payload", "eq", "x")])
    # one loaded table, used over and over: no query changes what another one reads
    once = load("w")
    responses, others = once.filter(F.col("record_type") == "response"), once.filter(F.col("record_type") == "revisit")
    assert (once.count(), responses.count(), others.count(), once.count()) == (8, 5, 3, 8)
    assert responses.union(others).count() == 8
    narrow = spark.read.format("warc").schema("record_type string, target_uri string").load(path)
    assert narrow.count() == len(PAGES)
    # members are plain gzip, and an archive without lengths or packing reads the same
    parts = [f for f in os.listdir(tmp_path / "w") if f.endswith(".gz")]
    plain = b"".join(gzip.open(tmp_path / "w" / f).read() for f in parts)
    single = gzip.compress(warc.record_bytes({"record_type": "response", "record_id": "<a>", "payload": b"q"}))
    for name, data in (("plain/x.warc", plain), ("one/x.warc.gz", single)):
        os.makedirs(os.path.dirname(tmp_path / name))
        (tmp_path / name).write_bytes(data)
    plainly = lambda df: sorted((r.record_id, r.record_type, r.payload, sorted(r.headers.items())) for r in df.collect())
    assert plainly(load("plain")) == plainly(load("w"))
    assert [bytes(r.payload) for r in load("one").collect()] == [b"q"]
    empty = f"file://{tmp_path}/empty"
    warc.write_pages(pages.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_skipped_payloads_are_not_read():
    class Counting:
        def __init__(self, raw):
            self.raw, self.at, self.read_bytes = raw, 0, 0

        def read(self, n):
            out = self.raw[self.at:self.at + n]
            self.at += len(out)
            self.read_bytes += len(out)
            return out

        def seek(self, at):
            self.at = at

        def tell(self):
            return self.at

    noise = np.random.default_rng(0).integers(0, 256, 2_000_000, dtype=np.uint8).tobytes()
    make = lambda kind, payload: warc.record_bytes({"record_type": kind, "record_id": "<a>", "payload": payload})
    for packed in (True, False):
        raw = b"".join((warc.gzip_member(r) if packed else r) for r in (make("response", noise), make("warcinfo", b"hi")))
        stream = Counting(raw)
        found = list(warc.records(stream, packed, lambda h: h["warc-type"] == "warcinfo"))
        assert [p for _, p in found] == [b"hi"] and stream.read_bytes < 300_000


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = np.vstack([centres[i % 12] + rng.normal(size=24) * .6 for i in range(900)] + [np.ones(24)] * 60)
    rows = [(i, [float(v) for v in x[i]], "r") for i in range(len(x))]
    odd = [(2000, None, "r"), (2020, [0.0] * 24, "r"), (2040, [float("nan")] * 24, "r"), (2060, [None] * 24, "r"), (None, [1.0] * 24, "r"), rows[20]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in vector_index.nearest(frame, frame.filter("vec_id % 20 = 0"), block=256).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    assert set(got) == set(range(0, len(x), 20))
    for q, found in got.items():
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - score[f[1]]) < 1e-9 for f in found)
        assert [(-round(f[2], 9), f[1]) for f in found] == sorted((-round(f[2], 9), f[1]) for f in found)
        hits += len({f[1] for f in found} & set(order))
        total += 20
    assert hits / total >= 0.9
    few = frame.filter("vec_id < 3")
    assert vector_index.nearest(few, few.filter("vec_id % 20 = 0")).count() == 2
    assert vector_index.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_codes_within_radius_are_all_found():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    for radius in (0, 1, 3, 7):
        coder = vector_index.Coder(x, 5)
        coder.radius = radius
        block = vector_index.Block(np.arange(500), x, coder)
        for code in coder.codes(x[:40]):
            apart = np.bitwise_count(block.codes ^ code).sum(axis=1)
            assert block.within(code).tolist() == np.flatnonzero(apart <= radius).tolist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids
        docs, ids = spark.createDataFrame(docs.collect(), docs.schema), kept
    mixed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in mixed} == ids and len(mixed) == len(ids)


def test_one_query_per_operator():
    keys = llm_queries()
    assert {int(k[2:].split("_")[0]) for k in keys if k.startswith("op")} == set(range(1, 14)) and "pipeline" in keys
