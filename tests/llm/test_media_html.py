"""Media columns and HTML extraction: round trips and hand-written pages."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import op8_media as o8, op10_html as o10

from .helpers import DOCS, documents, words


def test_media_round_trip(spark, tmp_path):
    texts = [None, "", "a", "é漢\U0001f600", "x" * 191, "x" * 192, "x" * 193, "same", "same", "P6\n1 1\n255\n", "long " * 200_000]
    df = documents(spark, list(enumerate(texts))).withColumn("media", F.lit("mine")).withColumn("n_bytes", F.lit("mine"))
    got = {x.doc_id: x for x in o8.media_features(o8.media_columns(df)).collect()}
    stored = {x.doc_id: bytes(x.media) for x in o8.media_columns(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        x, raw = got[k], (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (x.media_bytes, x.media_sha256) == (len(stored[k]), hashlib.sha256(stored[k]).hexdigest())
        assert o8.decode(stored[k]).tobytes() == payload and len(x.feature) == 16
    assert got[7][1:] == got[8][1:]
    o8.write_tiles(df, str(tmp_path / "tiles"))
    import io

    tile = np.load(io.BytesIO(spark.read.parquet(str(tmp_path / "tiles")).where("doc_id = 4").first().tile))
    assert tile.shape == (o8.HASH_ROWS, o8.HASH_COLUMNS) and tile.dtype == np.uint8
    assert o8.media_columns(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("h", "w"), [(1, 1), (3, 5), (8, 4), (17, 33)])
def test_bmp_and_netpbm_decode_alike(h, w):
    pixels = np.random.default_rng(h).integers(0, 256, (h, w, 3), dtype=np.uint8)
    assert (o8.decode(o8.encode_bmp(pixels)) == pixels).all()
    assert (o8.decode(b"P6 # made by hand\n%d\n%d 255\n" % (w, h) + pixels.tobytes()) == pixels).all()
    assert (o8.decode(b"P5\n%d %d\n255\n" % (w, h) + pixels[:, :, 0].tobytes())[:, :, 0] == pixels[:, :, 0]).all()
    with pytest.raises(ValueError, match="neither"):
        o8.decode(b"GIF89a")


@pytest.mark.parametrize(("h", "w", "rows", "columns"), [(16, 18, 8, 9), (1, 1, 8, 9), (5, 7, 8, 9), (100, 64, 8, 9)])
def test_area_means(h, w, rows, columns):
    a = np.random.default_rng(1).integers(0, 256, (h, w), dtype=np.uint8)
    fine = np.kron(a.astype(float), np.ones((rows, columns)))
    want = fine.reshape(rows, h, columns, w).mean(axis=(1, 3))
    assert np.allclose(o8.area_resize(a[:, :, None], rows, columns), want)


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("__n", F.lit(1))
    got = {x.page_id: x for x in o10.extract(df).collect()}
    assert len(got) == len(pages) and all(x.n_chars == len(x.text) for x in got.values())
    return [got[i].text for i in range(len(pages))]


EXTRACTED = [
    (None, ""),
    ("", ""),
    ("plain  text", "plain text"),
    ("<p>a&amp;b &eacute;&#233;&#x1F600;&nbsp;c</p>", "a&b éé\U0001f600 c"),
    ("<article><h1>T</h1><p>one<br>two <b>th</b>ree\n<p>next</article><footer>gone</footer>", "T\n\none two three\n\nnext"),
    ("<nav>x</nav><main><p>body</p><aside>x</aside></main>", "body"),
    ("<script>var a='</p>x<p>';</script><style>p{}</style><p>kept</p><!-- <p>no</p> -->", "kept"),
    ("<article><p>kept</p><div class='comments'><p>reader</p></div><form><input>x</form></article>", "kept"),
    ("<div class=cookie-notice>x</div><article><p title='a > b'>kept</p></article>", "kept"),
    ("<article><p>open <b>never closed<p>more", "open never closed\n\nmore"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    ("<p>1 < 2 & 3", "1 < 2 & 3"),
    ("<header>site</header><article><header><h1>T</h1></header><p>x</p></article>", "T\n\nx"),
    ("<article><p class='ad'>gone<p>kept2<p>kept3</article>", "kept2\n\nkept3"),
    ("<ul><li class=ad>x<li>kept</ul>", "kept"),
    ("<h1 class='page-header'>Title</h1><p>x</p>", "Title\n\nx"),
    ("<div class='content with sidebar'><p>the article</p></div>", "the article"),
    ("<div class='sidebar layout'><main><p>the article</p></main><p>links</p></div>", "the article"),
    ("<p>an article that is short</p><div class='comments'><p>reader comments that are much longer than the article</p></div>", "an article that is short"),
    ("<article><div class='share-box'><p>all of the text</p></div><div class=related>x</div></article>", "all of the text"),
    ("<table><tr><td class=ad>x<td>a<tr><td>b</table><dl><dt class=promo>x<dd>c</dl>", "a\n\nb\n\nc"),
    ("<div class=ad><p>x</div></div></p>kept", "kept"),
]


@pytest.mark.parametrize(("html", "want"), EXTRACTED)
def test_main_text_of_a_page(html, want):
    assert o10.main_texts([o10.blocks(html)]) == [want]


def test_main_text_of_pages(spark):
    assert texts_of(spark, [(f"http://h{i}/", html) for i, (html, _) in enumerate(EXTRACTED)]) == [want for _, want in EXTRACTED]


def test_text_repeated_over_a_host_is_boilerplate_where_no_article_is_marked(spark):
    menu = " ".join(words(12, 5))
    bodies = [" ".join(words(40, 100 + i)) for i in range(200)]
    pages = [(f"http://hot.example/{i}", f"<div>{menu}</div><div>{b}</div>") for i, b in enumerate(bodies)]
    pages += [("http://one.example/", f"<div>{menu}</div><div>own</div>"), (None, None), ("odd", "<p>x</p>")]
    got = texts_of(spark, pages)
    assert got[:200] == bodies and got[200:] == [f"{menu}\n\nown", "", "x"]


def test_long_repeated_runs_inside_a_block_go_and_unique_runs_stay(spark):
    run, bodies = " ".join(words(15, 5)), [" ".join(words(60, 100 + i, 10**6)) for i in range(5)]
    pages = [(f"http://h.example/{i}", f"<div>{b[:200]} {run} {b[200:]}</div>") for i, b in enumerate(bodies)]
    assert texts_of(spark, pages) == [" ".join(f"{b[:200]} {b[200:]}".split()) for b in bodies]
    # Without the suffix array nothing is known to repeat, and the run stays.
    assert all(run in o10.main_texts([o10.blocks(html)])[0] for _, html in pages)


def test_repeated_pages_and_no_pages(spark):
    page = ("http://h/", "<div>" + " ".join(words(30, 1)) + "</div>")
    got = texts_of(spark, [page] * 5)
    assert len(set(got)) == 1 and got[0] == " ".join(words(30, 1))
    assert o10.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_covered_by_brute_force():
    r = random.Random(3)
    for _ in range(30):
        streams = [np.array([r.randrange(3) for _ in range(r.randrange(25))], dtype=np.int64) for _ in range(r.randrange(1, 7))]
        got = o10.covered(streams, run=4, pages=2)
        for s, g in zip(streams, got, strict=True):
            want = np.zeros(len(s), dtype=bool)
            for i in range(len(s) - 3):
                part = s[i : i + 4].tolist()
                if sum(any(t[j : j + 4].tolist() == part for j in range(len(t) - 3)) for t in streams) >= 2:
                    want[i : i + 4] = True
            assert (g == want).all()


def test_suffix_array():
    s = np.array([ord(c) for c in "mississippi"])
    order, rank = o10.suffix_array(s)
    assert order.tolist() == sorted(range(11), key=lambda i: "mississippi"[i:]) and (rank[order] == np.arange(11)).all()


def test_very_long_pages_take_linear_time():
    assert len(o10.blocks("<p>x" * 100_000)) == 100_000
    o10.blocks("<div " * 50_000), o10.blocks("<!-- " * 50_000), o10.blocks("<a href='" * 50_000)


def test_a_block_on_few_pages_of_a_hot_host_goes_from_all_of_them(spark):
    menu = " ".join(words(12, 5))
    bodies = [" ".join(words(40, 100 + i, 10**6)) for i in range(640)]
    pages = [(f"http://hot.example/{i}", f"<div>{menu}</div><div>{b}</div>" if i % 50 == 0 else f"<div>{b}</div>") for i, b in enumerate(bodies)]
    twice = " ".join(words(12, 6))
    # On two distinct pages only, one of them repeated: stays.
    pages += [("http://hot.example/a", f"<div>{twice}</div><div>own</div>")] * 3 + [("http://hot.example/b", f"<div>{twice}</div><div>other</div>")]
    got = texts_of(spark, pages)
    assert got[:640] == bodies and got[640:] == [f"{twice}\n\nown"] * 3 + [f"{twice}\n\nother"]
