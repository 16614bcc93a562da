"""Main text of whole hosts, long pages and deep pages."""

import html
import random
import re

from conftest import SMALL

from tidemark.llm import html_extract, html_tree


def test_every_page_of_a_host_has_a_group(spark):
    page = "<body><div><p>Our site, since ever</p></div><div><p>Text {i} tells of {i} things.</p><p>And more of {i}.</p></div><div><p>Made by us</p></div></body>"
    rows = [(i, f"http://h{n}.example/{i}", page.format(i=i * 7)) for n in (3, 48, 49, 50, 97, 98, 145) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((u, f"Text {i * 7} tells of {i * 7} things.\n\nAnd more of {i * 7}.") for i, u, _ in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted((r.url, r.text) for r in html_extract.main_text(pages.repartition(n)).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_lists_are_aligned():
    def rows(i):
        return "".join(f"<p class=c{k % 7}>Item {k} of {i}</p>" + (f"<h4>Part {k // 50} of the catalogue</h4>" if k % 50 == 0 else "") for k in range(300))

    # a label that the first page has early and the others late
    pages = ["<body>" + ("<hr class=x>" if i == 0 else "") + rows(i) + ("" if i == 0 else "<hr class=x>") + "</body>" for i in range(6)]
    for i, text in enumerate(html_extract.extract(pages)):
        assert text == "\n\n".join(f"Item {k} of {i}" for k in range(300))


def test_long_and_short_lists_have_the_same_pairs():
    rng = random.Random(4)
    for n, m in ((5, 7), (40, 3), (60, 90), (150, 150)):
        a, b = (html_tree.parse("".join(rng.choice(("<p>", "<h2>", "<div><b></b></div>", "<div><i></i><b></b></div>")) for _ in range(k))) for k in (n, m))
        shapes = html_tree.Shapes()
        shapes.add(a)
        shapes.add(b)
        xs, ys = ([shapes.of[id(c)] for c in t.elements()] for t in (a, b))
        long = shapes._long_pairs(tuple(xs), tuple(ys))
        before, html_tree._LONG = html_tree._LONG, 10**9
        try:
            assert long == shapes.pairs(tuple(xs), tuple(ys))
        finally:
            html_tree._LONG = before


def test_pairs_are_those_of_all_rows():
    def plain(shapes, xs, ys):
        rows = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                rows[i + 1][j + 1] = max(rows[i + 1][j], rows[i][j + 1], rows[i][j] + shapes.size(x, y))
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        assert sum(shapes.size(xs[i], ys[j]) for i, j in out) == rows[-1][-1]
        return out

    rng = random.Random(5)
    kinds = ("<p>", "<h2>", "<div><b></b></div>", "<div><i></i><b></b></div>", "<div><i></i><i></i><b></b></div>")
    for _ in range(400):
        start, end = ("".join(rng.choice(kinds) for _ in range(rng.randint(0, 4))) for _ in range(2))
        a, b = (html_tree.parse(start + "".join(rng.choice(kinds) for _ in range(rng.randint(0, 6))) + end) for _ in range(2))
        shapes = html_tree.Shapes()
        shapes.add(a)
        shapes.add(b)
        xs, ys = (tuple(shapes.of[id(c)] for c in t.elements()) for t in (a, b))
        assert shapes.pairs(xs, ys) == plain(shapes, xs, ys)
        root = 1 + sum(shapes.size(xs[i], ys[j]) for i, j in plain(shapes, xs, ys))
        assert shapes.size(shapes.of[id(a)], shapes.of[id(b)]) == root == len(html_tree.align(a, b))


def test_what_is_alike_is_not_compared():
    def page(middle):
        return "<body><div>" + "".join(f"<p>{'<b></b>' * k}</p>" for k in range(30)) + middle + "".join(f"<p>{'<i></i>' * k}</p>" for k in range(30)) + "</div></body>"

    shapes = html_tree.Shapes()
    a, b = html_tree.parse(page("<h2><b></b></h2>")), html_tree.parse(page("<h2><i></i></h2>"))
    assert shapes.size(*(shapes.add(t) or shapes.of[id(t)] for t in (a, b))) == len(html_tree.align(a, b)) == 2 * (30 + 435) + 4
    assert len(shapes.sizes) < 10


def test_deep_elements_are_closed():
    for depth in (100, 200, 5000):
        page = "<html><body><div><article><p>Begin {i}</p>" + "<div>" * depth + "<p>Deep {i}</p><aside>Menu {i}</aside>" + "</div>" * depth + "<p>End {i}</p></article></div><div>Other {i}</div></body></html>"
        assert html_extract.extract([page.format(i=i) for i in range(4)]) == [f"Begin {i}\n\nDeep {i}\n\nEnd {i}" for i in range(4)]


def test_head_ends_without_its_tag():
    for start in ("<head><title>t</title><meta charset=utf-8><body>", "<head><title>t</title>", "<head><link rel=x href=y>\n"):
        for text in ("<p>All of it</p>", "All of it"):
            assert html_extract.extract([start + text]) == ["All of it"]


def _neutral(page):
    """A page without any mark-up that tells its main text."""
    page = re.sub(r"<(/?)(?:article|nav|aside|header|footer|section|form|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|\S+)""", "", page)


def _article(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " "))).strip() for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_alignment_finds_the_text_without_mark_up(spark, monkeypatch):
    hosts = {}
    for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").collect():
        hosts.setdefault(r.url.split("/")[2].lower(), []).append(r.html)
    hosts = {h: pages for h, pages in hosts.items() if len(pages) >= 3}
    assert sum(map(len, hosts.values())) > 200

    def right():
        return sum(text == _article(p) for pages in hosts.values() for p, text in zip(pages, html_extract.extract([_neutral(p) for p in pages]), strict=True))

    assert right() == sum(map(len, hosts.values()))
    monkeypatch.setattr(html_extract, "align", lambda a, b, shapes=None: [(a, b)])
    assert right() == 0


def test_constant_blocks_go_wherever_they_stand():
    page = "<body><div><p>Since 1900 at your service</p></div>{late}<div><h1>Title {i}</h1><p>Text {i} tells of {i} things.</p><p>Read all of it as often as you like</p><p>And more of {i}, so that there is enough to read.</p></div></body>"
    late = "<table><tr><td>Now open on Sundays</td></tr></table>"
    # the first page lacks a part that most others have
    pages = [page.format(i=i * 7, late=late if i else "") for i in range(6)]
    for i, text in enumerate(html_extract.extract(pages)):
        assert text == f"Title {i * 7}\n\nText {i * 7} tells of {i * 7} things.\n\nAnd more of {i * 7}, so that there is enough to read."


def test_alignment_against_all_matchings():
    rng = random.Random(8)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<div class={rng.choice('ab')}>{kids}</div>"

    def size(a, b):
        return 1 + best(a.elements(), b.elements()) if a.label == b.label else 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), size(xs[0], ys[0]) + best(xs[1:], ys[1:]))

    for _ in range(150):
        a, b = html_tree.parse(tree(3)), html_tree.parse(tree(3))
        pairs = html_tree.align(a, b)
        assert len(pairs) == size(a, b)
        assert all(x.label == y.label for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
