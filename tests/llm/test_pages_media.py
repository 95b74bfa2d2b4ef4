import collections
import hashlib
import zlib

import numpy as np
import pytest

from keyloom.llm import html_extract as H
from keyloom.llm import media as M


def test_extraction():
    page = """<!DOCTYPE html><html><head><title>t</title></head><body class="x-sidebar"><header>H</header><nav><a href=/>m</a></nav>
    <div class="cookie-notice">c</div><main><h1>T &amp; t</h1><p><b>one  two&#33;<p>three<br>four<ul><li>a<li>b</ul>
    <div class=comments><p>bad bad bad bad bad</div><!-- no --><p title="a>b">fi<i>ve</i></main><aside>z</aside><form>q</form>
    <script>if (a<b) {"</p>"}</script><footer>f</footer>"""
    assert H.extract(page, None) == "T & t one two! three four a b five"
    assert H.extract("", None) == "" and H.extract("just text", "nothing") == "just text"
    assert H.extract("<div class='ad'>only this</div>", None) == "only this"
    assert H.extract("<p>unclosed <b>bold <i>x</p><p>next", None) == "unclosed bold x next"
    assert H.extract("a < b & c <3", None) == "a < b & c <3"
    assert H.extract("<p>x" * 3000, None).count("x") == 3000


def test_consensus(spark, scratch):
    good = '<div class="teaser{0}"><p>{1}</p></div><div class="story{0}"><p>{2}</p><p>{2}</p></div>'
    pages = [(i, f"http://a.example/{i}", good.format(i, "short", "a long line of the story itself")) for i in range(8)]
    # one page's teaser is longer than its story: the host's path decides
    pages += [(8, "http://A.example:80/8", good.format(8, "a very long teaser that goes on and on and on " * 3, "story")), (9, None, "<p>alone</p>"), (10, "http://b.example/", None), (9, None, "<p>alone</p>")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in H.extracted(df, scratch).collect()}
    assert got[8] == "story story" and got[0].startswith("a long line") and got[9] == "alone" and got[10] == ""
    assert H.extracted(df, scratch).count() == 12 and H.extracted(df.where("false"), scratch).collect() == []


def feature_by_loops(full):
    """The feature of a payload 64 samples wide, area by area."""
    from fractions import Fraction
    import io

    height, width = len(full) // 64, 64

    def resized(rows, columns):
        spans = lambda n, parts: [[(k, min(k + 1, Fraction(n * (i + 1), parts)) - max(k, Fraction(n * i, parts))) for k in range(n * i // parts, -(-n * (i + 1) // parts))] for i in range(parts)]
        cell = Fraction(height, rows) * Fraction(width, columns)
        down = [[sum(full[y * width + x] * part for y, part in ys) for x in range(width)] for ys in spans(height, rows)]
        return [[sum(line[x] * part for x, part in xs) / cell for xs in spans(width, columns)] for line in down]

    small = np.array([[int(float(v) + 0.5) for v in line] for line in resized(*M.TILE)], np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, small, version=(1, 0))
    bits = "".join("01"[float(b) > float(a) + 1e-6] for line in resized(8, 9) for a, b in zip(line, line[1:]))
    return f"{int(bits, 2):016x}:{zlib.crc32(out.getvalue()):08x}"


def test_stored_texts(documents, none, scratch):
    got = M.stored_texts(documents, scratch).collect()
    want = collections.Counter()
    for r in documents.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        full = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        media = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        want[r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_by_loops(full)] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert len({r.feature for r in got if r.doc_id in (3, 4)}) == 1 and M.stored_texts(none, scratch).collect() == []


@pytest.mark.parametrize(("height", "width"), [(1, 64), (5, 64), (40, 7), (8, 9), (3, 3), (9000, 64)])
def test_area_resize(height, width):
    image = np.random.default_rng(height).integers(0, 256, (height, width), dtype=np.uint8)
    got = M.area_resize(image, (8, 9))[0]
    fine = np.repeat(np.repeat(image.astype(float), 8, axis=0), 9, axis=1)  # every cell is whole samples of this
    assert np.allclose(got, fine.reshape(8, height, 9, width).mean((1, 3)))


def test_decoding(spark):
    image = np.arange(30, dtype=np.uint8).reshape(5, 6)
    assert (M.decode(M.encode_pgm(image)) == image).all() and (M.decode(M.encode_bmp(image)) == image).all()
    assert (M.decode(b"P2 # note\n3 1\n9\n0 9 3\n") == [[0, 255, 85]]).all()
    assert (M.decode(b"P1\n2 2\n1 0\n0 1\n") == [[0, 255], [255, 0]]).all()
    assert (M.decode(b"P4\n9 1\n\x80\x80") == [[0, *[255] * 7, 0]]).all()
    assert M.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"", b"GIF89a", b"P5\n5 5\n255\nxx", b"BM123", b"P5\n0 1\n255\n", b"P3\n1 1\n"):
        with pytest.raises(M.NotAnImage):
            M.decode(bad)
    df = spark.createDataFrame([(1, M.encode_pgm(image)), (2, None), (3, b"nothing"), (1, M.encode_bmp(image))], "id int, image binary")
    got = M.tiles(df).collect()
    assert [(r.id, r.height) for r in got] == [(1, 5), (2, None), (3, None), (1, 5)] and got[0].npy == got[3].npy
    tile = np.lib.format.read_array(__import__("io").BytesIO(got[0].npy))
    assert tile.shape == M.TILE and len(got[0].dhash) == 16
    with pytest.raises(ValueError):
        M.tiles(df.withColumnRenamed("id", "width"))


def bmp(depth, body, width, height, table=b"", packing=0, size=40, colours=0, masks=b""):
    import struct

    if size == 12:
        head = struct.pack("<IHHHH", 12, width, height, 1, depth)
    else:
        head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, packing, len(body), 0, 0, colours, 0) + masks
    offset = 14 + len(head) + len(table)
    return struct.pack("<2sIHHI", b"BM", offset + len(body), 0, 0, offset) + head + table + body


def test_forms_of_bmp():
    grey = b"".join(bytes([v, v, v, 0]) for v in (10, 20, 30, 40))
    two = [[10, 20, 10], [20, 20, 10]]  # first row first
    assert M.decode(bmp(1, b"\xc0\0\0\0\x40\0\0\0", 3, 2, grey[:8])).tolist() == two
    assert M.decode(bmp(4, b"\x11\0\0\0\x01\0\0\0", 3, 2, grey)).tolist() == two
    assert M.decode(bmp(8, b"\1\1\0\0\0\1\0\0", 3, 2, grey, colours=4)).tolist() == two
    assert M.decode(bmp(8, b"\0\1\0\0\1\1\0\0", 3, -2, grey, colours=4)).tolist() == two
    small = b"".join(bytes([v] * 3) for v in (10, 20)) + bytes(254 * 3)
    assert M.decode(bmp(8, b"\1\1\0\0\0\1\0\0", 3, 2, small, size=12)).tolist() == two
    # runs, samples as they are, a move, ends of row and image
    assert M.decode(bmp(8, b"\2\1\1\0\0\0" b"\0\3\0\1\0\0\0\1", 3, 2, grey, packing=1, colours=4)).tolist() == two
    assert M.decode(bmp(8, b"\0\2\1\1\2\1\0\1", 3, 2, grey, packing=1, colours=4)).tolist() == [[10, 20, 20], [10, 10, 10]]
    assert M.decode(bmp(4, b"\3\x01\0\0\0\3\x11\0\0\1", 3, 2, grey, packing=2)).tolist() == [[20, 20, 10], [10, 20, 10]]
    red, green = [255, 0, 0], [0, 255, 0]
    assert M.decode(bmp(16, b"\0\x7c\xe0\3", 2, 1)).tolist() == [[red, green]]
    masks = b"\0\xf8\0\0\xe0\7\0\0\x1f\0\0\0"
    assert M.decode(bmp(16, b"\0\xf8\xe0\7", 2, 1, packing=3, masks=masks)).tolist() == [[red, green]]
    assert M.decode(bmp(24, b"\0\0\xff\0\xff\0\0\0", 2, 1)).tolist() == [[red, green]]
    assert M.decode(bmp(32, b"\0\0\xff\0\0\xff\0\0", 2, 1)).tolist() == [[red, green]]


def test_hostile_images(spark):
    """Bytes that are no image give nulls, in linear time and without a crash."""
    import random
    import time

    began = time.time()
    bad = [
        b"P5" + b" " * 100_000 + b"x", b"P5 " + b"#\n" * 50_000, b"P5\n#" + b"x" * 100_000, b"P2\n2 1\n9\n1 x\n", b"P2\n1 1\n9\n300\n", b"P2\n1 1\n9\n1_0\n", b"P2\n2 1\n9\n-1 2\n",
        b"P5\n1 1\n9\n\xff", b"P5\n99999999999999999999 1\n255\n", b"P5\n999999999 999999999\n255\n", b"P1\n999999999 999999999\n1", b"P1\n2 1\n1 7\n", b"P4\n9 9\n", b"P6\n1 1", b"P6\n1 1\n0\nabc",
        b"P5\n1 1\n99999\nab", b"P7\n1 1\n1\na", b"P", b"BM", bmp(8, b"\0" * 3, 3, 2), bmp(3, b"\0" * 64, 3, 2), bmp(8, b"\1", 30_000, 30_000, packing=1), bmp(24, b"\0" * 64, -3, 2), bmp(8, b"\0" * 64, 3, 0), bmp(16, b"\0\0", 1, 1, packing=3),
    ]
    for data in bad:
        with pytest.raises(M.NotAnImage):
            M.decode(data)
    rng = random.Random(6)
    whole = [M.encode_bmp(np.arange(30, dtype=np.uint8).reshape(5, 6)), bmp(8, b"\2\1\1\0\0\0\0\3\0\1\0\0\0\1", 3, 2, b"\0" * 16, packing=1, colours=4), b"P2 # note\n3 1\n9\n0 9 3\n", b"P6\n1 1\n255\n\x01\x02\x03"]
    for _ in range(3000):  # a few bytes changed, or the end cut
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        del data[rng.randint(1, 2 * len(data)) :]
        try:
            assert M.decode(bytes(data)).size
        except M.NotAnImage:
            bad.append(bytes(data))
    assert time.time() - began < 30
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(bad[:40])], "id int, image binary")
    assert all(r.npy is None and r.height is None for r in M.tiles(df).collect())
    # a palette shorter than its colours: those it lacks are black
    assert M.decode(bmp(8, b"\0\1\0\0", 2, 1, b"\7\7\7\0", colours=200)[:-4] + b"\0\5\0\0").shape[:2] == (1, 2)


# ---- extraction against a model: pages are made as trees, and their text is read off the tree

def made_page(rng):
    """(html, text): a random page and the text of its article."""
    from html import escape

    def words(n):
        return " ".join(rng.choice(("one", "two &", "três", "<four>", "5%", "six six", "seven")) for _ in range(n))

    def inline(depth):
        """(html, text) of running text; text keeps its blanks."""
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5 or depth > 2:
                text = words(rng.randint(1, 6)) + rng.choice((" ", "\n\t", ""))
                raw = escape(text, quote=False).replace("ê", rng.choice(("ê", "&ecirc;", "&#234;", "&#xEA;"))).replace(" ", rng.choice((" ", "&nbsp;")))
                out.append((raw, text))
            elif kind < 0.6:
                out.append((rng.choice(("<br>", "<br/>", "<img src='a>b.png' alt=x>")), " "))
            elif kind < 0.7:
                out.append((rng.choice(("<!-- no > text -->", "<script>if (a<b) x('</p>')</script>", "<style>p{}</style>", '<span class="ad">buy</span>', "<button>press</button>", '<i hidden>unseen</i>')), ""))
            else:
                tag = rng.choice(("b", "i", "em", "span", "code"))
                raw, text = inline(depth + 1)
                out.append((f'<{tag} title="x > y" class="c{rng.randint(0, 9)}">{raw}</{tag}>', text))
        return "".join(r for r, _ in out), "".join(t for _, t in out)

    def blocks(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5 or depth > 3:
                raw, text = inline(0)
                tag = rng.choice(("p", "h2", "pre", "blockquote"))
                out.append((f"<{tag}>{raw}" + ("" if tag == "p" and rng.random() < 0.5 else f"</{tag}>"), [text]))
            elif kind < 0.65:
                items = [inline(1) for _ in range(rng.randint(1, 3))]
                out.append(("<ul>" + "".join(f"<li>{r}" for r, _ in items) + "</ul>", [t for _, t in items]))
            elif kind < 0.8:
                noise = rng.choice(('<div class="ad">buy this</div>', "<nav><a href=/>menu</a></nav>", '<div class="reader comments"><p>first</p></div>', "<aside>side</aside>", "<form><input><p>mail</p></form>", '<ul class="related"><li><a href=/x>more stories</a></ul>', "<footer>end</footer>"))
                out.append((noise, []))
            else:
                tag = rng.choice(("div", "section", "div class='part7 related-work'"))
                raw, texts = blocks(depth + 1)
                out.append((f"<{tag}>{raw}</{tag.split()[0]}>", texts))
        return "".join(r for r, _ in out), [t for _, ts in out for t in ts]

    raw, texts = blocks(0)
    title, long = words(4), "the long first paragraph of this article " * 12
    head = f"<h1>{escape(title)}</h1>"
    if rng.random() < 0.5:
        head = f"<header>{head}</header>"
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body class='has-sidebar'><header><a href=/>site</a></header><div class='cookie-notice'>cookies</div><div class='layout with-menu'><article>{head}<p>{long}</p>{raw}</article></div><div class=sidebar><p>aside</p></div><footer>foot</footer></body></html>"
    kept = (" ".join(t.split()) for t in (title, long, *texts))
    return page, " ".join(t for t in kept if t)


def test_extraction_against_trees():
    import random

    rng = random.Random(12)
    for _ in range(400):
        page, text = made_page(rng)
        assert H.extract(page, None) == text, page


def test_class_words_do_not_remove_an_article():
    long = "<p>" + "a long line of text " * 20 + "</p>"
    text = " ".join(["a long line of text"] * 20)
    assert H.extract(f'<div class="page has-sidebar"><article>{long}</article></div><p>tiny</p>', None) == text
    assert H.extract(f'<div class="page sidebar"><article>{long}</article></div><p>tiny</p>', None) == text
    assert H.extract(f'<article><header><h1>Title</h1></header>{long}<div class="related-work">{long}</div></article>', None) == f"Title {text} {text}"
    assert H.extract(f'<article>{long}<div class="related"><a href=/>some other story</a></div><div class=comments>{long}</div></article>', None) == text
    assert H.extract(f"<form>{long}</form><p>tiny</p>", None) == f"{text} tiny"
    assert H.extract("<div class=ad>one</div><div class=share>two</div>", None) == ""
    assert H.extract("<header><h1>Site</h1></header><main>text</main>", None) == "text"
    assert H.extract("a\u0085b\u001cc&nbsp;d e", None) == "a b c d e"


def test_hostile_pages_take_linear_time():
    import time

    n = 20_000
    pages = [
        "<a " * n, "<b>" * n + "</i>" * n, "<div>" * n + "x", '<a "x>y" ' * n, "<div>" * n + "<li></li>" * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<title></title " * n, "<table>" + "<td>" * n,
        "<div>" + "<b>" * n + "<div></div>" * n, "<!--" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<form class=ad>" * n, "&" * n, "<a href='" * n + ">", "<p>" * n + "</p>" * n, "<" * n, "<script>" * n, "</div>" * n,
    ]
    for page in pages:
        began = time.time()
        H.votes(page)
        assert time.time() - began < 5, page[:40]
    deep = H.parse("<div class=x>" * 30_000 + "end")
    assert max(len(c.path) for c in deep.containers) < 40 and H.extract("<div>" * 30_000 + "end", None) == "end"


def test_long_and_repeated_pages(spark, scratch):
    long = "<article>" + "<p>word &amp; <b>more</b></p>" * 40_000 + "</article>"
    df = spark.createDataFrame([(1, "http://x.example/1", long), (1, "http://x.example/1", long), (2, "http://x.example/2", ""), (3, "", "<p>ok")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, r.text[:20]) for r in H.extracted(df, scratch).collect())
    assert got == [(1, 12 * 40_000 - 1, "word & more word & m")] * 2 + [(2, 0, ""), (3, 2, "ok")]
