import gzip
import hashlib
import math
import random
import time

import pytest

from spanmill.llm import embed_join, html_extract, warc

PAGES = "page_id long, url string, html string, text string, host string, payload string"


def page(body, k):
    return f'<html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><nav>Menu</nav><div class="site-note">Read our terms, dear reader</div>{body}<footer>&copy; x</footer><script>var t="</p>"</script></body></html>'


def test_main_text(spark):
    rows = [(k, f"https://Site.example:80/{k}", page(f"<div><h1>Title {k}</h1><p>Body&nbsp;of <b>p</b>age {k}<br>line &lt;2&gt;<p>more\n text {k}</div>", k), "", "", "") for k in range(8)]
    rows += [(90, None, None, "", "", ""), (91, "x", "", "", "", ""), (92, "http://o/", "plain & simple", "", "", ""), rows[0]]
    rows += [(93, "http://o/2", "<article><header><h1>H</h1></header><p>a<ul><li>1<li>2</ul><form>f</form><section id='comments'>c</section></article><p>outside</p>", "", "", "")]
    got = {r.id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "Title 3 Body of page 3 line <2> more text 3"
    assert got[90] == "" and got[91] == "" and got[92] == "plain & simple" and got[93] == "H a 1 2"
    lone = html_extract.extract(spark.createDataFrame(rows[:1], PAGES)).first()
    assert "Read our terms" in lone.text  # one page has no template
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_main_text_of_copies(spark):
    body = [f"Paragraph {k} tells of the river and the stone." for k in range(6)]
    article = lambda k, own: f"<article><h1>Flood</h1>{''.join(f'<p>{own if j == k else t}</p>' for j, t in enumerate(body))}</article>"
    rows = [(k, "http://copy/", page(article(-1, ""), k), "", "", "") for k in range(8)]
    rows += [(100 + k, None, page(article(k % 6, f"Edited {k}."), k), "", "", "") for k in range(12)]
    rows += [(200 + k, "odd", page(f"<div><h1>Flood</h1>{''.join(f'<p>{t}</p>' for t in body)}<p>Edited {k}.</p></div>", k), "", "", "") for k in range(12)]
    rows += [(300 + k, "http://own/", page(f"<article><p>Own text of the page with number {k}</p><p>Shared line</p></article>", k), "", "", "") for k in range(6)]
    got = {r.id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[k] for k in range(8)} == {" ".join(["Flood", *body])}
    assert all(got[100 + k] == " ".join(["Flood", *body[: k % 6], f"Edited {k}.", *body[k % 6 + 1 :]]) for k in range(12))
    assert all(" ".join(["Flood", *body, f"Edited {k}."]) in got[200 + k] for k in range(12))
    assert all(got[300 + k] == f"Own text of the page with number {k}" for k in range(6))


def test_main_text_by_joined_templates(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", -1)
    rows = [(k, "http://s/", page(f"<article>own {k}</article><p>x", k), "", "", "") for k in range(6)]
    assert {r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()} == {f"own {k}" for k in range(6)}


def test_warc_round_trip(spark):
    big = "é<p>" * 400
    rows = [(1, "http://a/%41 b\r\nX: y", big, "", "", ""), (5, None, big, "", "", ""), (3, "u", big, "", "", ""), (7, "u", "small", "", "", ""), (8, "u", "small", "", "", ""), (9, "u", None, "", "", "")]
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None)}
    assert got[1].url == rows[0][1] and got[5].url is None
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_filters_with_and_without_index(spark, tmp_path):
    rows = [(k, f"u{k}", f"text {k} " * (200 if k % 2 else 1), "", "", "") for k in range(20)] + [(50, "v", "text 1 " * 200, "", "", "")]
    path = str(tmp_path / "w")
    warc.archive(spark.createDataFrame(rows, PAGES), path)
    for _ in range(2):
        records = warc.read(spark, path)
        assert records.count() == 21
        assert [r.page_id for r in records.where("record_type = 'revisit'").collect()] == [1]
        assert sorted(r.payload for r in records.where("page_id in (2, 4) and url = 'u4'").collect()) == ["text 4 "]
        assert {r.payload for r in warc.read(spark, path, payload="digest").collect()} == {None}
        for f in (tmp_path / "w").glob("*.idx"):
            f.unlink()
    for f in (tmp_path / "w").glob("*.warc.gz"):  # plain files, and one member for all records
        raw = gzip.decompress(f.read_bytes())
        f.unlink()
        (tmp_path / "w" / f.name.removesuffix(".gz")).write_bytes(raw)
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / f.name).write_bytes(gzip.compress(raw))
    for folder in ("w", "one"):
        records = warc.read(spark, str(tmp_path / folder))
        assert records.count() == 21 and [r.page_id for r in records.where("record_type = 'revisit'").collect()] == [1]
        assert [r.payload for r in records.where("page_id = 4").collect()] == ["text 4 "]
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), "x")]))
    assert len(left) == 1 and reader.tests == [("record_type", "EqualTo", "revisit")]


VECTORS = "vec_id long, embedding array<float>, label int, id long, n long, key string"


def vectors():
    rng = random.Random(1)
    rows = []
    for c in range(12):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        rows += [[x + rng.gauss(0, 0.22) for x in centre] for _ in range(15)]
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [None] + [1.0] * 7]
    return [(k, v, 0, 1, 2, "z") for k, v in enumerate(rows)]


def brute(rows, least=0.9):
    import numpy as np

    good = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: set() for i, *_ in rows}
    for a, x in good.items():
        near[a] = {b for b, y in good.items() if a != b and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least}
    label = {i: i for i in near}
    moved = True
    while moved:
        moved = False
        for a in near:
            m = min([label[a], *(label[b] for b in near[a])])
            moved |= m != label[a]
            label[a] = m
    return sorted((i, len(near[i]), label[i], label[i] == i) for i in near)


def test_embedding_join(spark, monkeypatch):
    rows = vectors()
    table = spark.createDataFrame(rows, VECTORS)
    expected = brute(rows)
    assert sorted(map(tuple, embed_join.near_duplicates(table).collect())) == expected
    assert 0 < sum(r[3] for r in expected) < len(expected)
    monkeypatch.setattr(embed_join, "BLOCK", 16)  # many cells, blocks and guests
    assert sorted(map(tuple, embed_join.near_duplicates(table).collect())) == expected
    assert embed_join.near_duplicates(table.limit(0)).collect() == []


def test_embedding_join_of_doubles_ragged_vectors_and_odd_ids(spark):
    near = math.sqrt(1 - 0.9**2)
    rows = [("b", [1.0, 0.0, 0.0]), ("a", [0.9 + 1e-12, near, 0.0]), ("c", [0.9 - 1e-9, -near, 0.0]), ("tiny", [1e-300, 0.0, 0.0]), ("two", [1.0, 0.0]), ("pair", [2.0, 0.0]), ("four", [1.0, 0.0, 0.0, 0.0])]
    rows += [(None, [1.0, 0.0, 0.0]), (None, None), ("two", [0.0, 0.0, 5.0]), ("z", [0.0, 0.1, 5.0]), ("b", [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted(map(tuple, embed_join.near_duplicates(table).collect()), key=str)
    # b twice, tiny and a are linked; c is just below; two joins its vectors of two lengths, and z
    assert got == sorted([("b", 3, "a", False), ("b", 3, "a", False), ("a", 3, "a", True), ("c", 0, "c", True), ("tiny", 3, "a", False), ("two", 1, "pair", False), ("pair", 1, "pair", True), ("four", 0, "four", True),
                          (None, 0, None, True), (None, 0, None, True), ("two", 1, "pair", False), ("z", 1, "pair", False)], key=str)


def test_names_inside_an_article():
    page = "<html><body><article><h1>T</h1><p>One.</p>{}<p>Two.</p></article></body></html>"
    kept = ['<section id="discussion"><h2>Heard</h2><p>here.</p></section>', '<div class="market-share">Heard here.</div>', '<div class="tasting-menu">Heard here.</div>', '<h2 id="related-work">Heard here.</h2>', '<p class="banner-year">Heard here.</p>']
    gone = ["share-buttons", "social-share", "ad", "comments", "related-posts", "newsletter-signup", "advertisement inline", "navbarmenu", "adSlot top"]
    assert {html_extract.Page(page.format(part)).text() for part in kept} == {"T One. Heard here. Two."}
    assert {html_extract.Page(page.format(f'<div class="{name}">Heard here.</div>')).text() for name in gone} == {"T One. Two."}
    assert html_extract.Page('<body><div id="navbarmenu">Home</div><p>Body</p>').text() == "Body"


def test_pages_without_tags_or_ends():
    for source, text in [("Only text", "Only text"), ("<p>One</p> two & three &amp; <", "One two & three & <"), ("a < b <c", "a < b <c"), ("<p>x</p><!-- open", "x"), ("<p>x</p><!-- a <b", "x"), ("<div>x</span></b></i>y</div>z", "xy z")]:
        assert html_extract.Page(source).text() == text


@pytest.mark.parametrize("source", ["<a " * 160_000, "<div>" * 40_000 + "</x></span>" * 40_000, "<b><div>" + "<i>" * 40_000 + "</b>" * 40_000, "<!x " * 120_000, '<a "' * 120_000 + ">", "<p><b>" * 40_000, "<li>" + "<b>" * 60_000 + "<li>"])
def test_malformed_pages_cost_their_length(source):
    began = time.perf_counter()
    html_extract.Page(source).text()
    assert time.perf_counter() - began < 10
