import pytest
from conftest_llm import empty_like

from tillwatch.llm import html_text
from tillwatch.llm.html_text import Reader

NONE = frozenset()


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain  text &amp; more", "plain text & more"),
        ("<nav>menu</nav><article><h1>Title &#38; x</h1><p>one\n two<p><b>three</b>four<br>five</article><footer>f</footer>",
         "Title & x\none two\nthreefour five"),
        ("<article><p>a</p><aside>side</aside><div class='ad'>buy</div><form>in</form><div id='comments'>c</div><p>b</article>", "a\nb"),
        ("<script>var t=\"</p><p>no\";</script><style>p{}</style><p>yes</p><!-- <p>not</p> -->", "yes"),
        ("<article><p>kept</p></div></section><p>also</p></article>", "kept\nalso"),
        ("<p>a <i class=x>b</i></p><div class='cookie-notice'>ok?</div><header>h</header>", "a b"),
        ("<p>before<p unfinished", "before"), ("<script>never ends", ""), ("<p class=\"x>odd</p><p>quote</p>", "odd\nquote"), ("<ul><li>a<li>b</ul>", "a\nb"),
        ("<p title=\"a > b\">1 < 2</p>", "1 < 2"),
    ],
)
def test_text_of_a_page(html, text):
    assert Reader(html).text(NONE) == text


def _pages(spark):
    frame = "<html><body><div id='top'>Home Shop Help</div><div class='x'>{}</div><div id='end'>All rights reserved</div></body></html>"
    rows = [(n, f"http://A.example/{n}", frame.format(f"story number {n} " + "word " * n), 1) for n in range(1, 9)]
    rows += [(20, None, "<p>no host</p>", 1), (21, "http://a.example/x", None, 1), (None, "not a url", "", 1), (1, *rows[0][1:])]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int")


def test_template_of_a_host_is_left_out(spark):
    pages = _pages(spark)
    rows = html_text.extract(pages).collect()
    assert len(rows) == pages.count()
    texts = {r["page_id"]: r["text"] for r in rows}
    assert texts[3] == "3 word word word"  # every story starts with the same two words
    assert texts[20] == "no host" and texts[21] == "" and texts[None] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.extract(empty_like(spark, pages)).count() == 0


def test_classes_need_one_order(spark):
    from pyspark.sql import functions as F

    rows = [("h", f"<div><p>{' '.join(w)}</p></div> x{n}") for n, w in enumerate([("b", "c", "d"), ("b", "c", "d"), ("d", "c", "b"), ("b", "c", "d")])]
    found = html_text.templates(spark.createDataFrame(rows, "host string, html string")).collect()
    roles = {r for row in found for r in row["roles"]}
    # tags and words share one vector here, and the words change places, so the class is no template
    assert not roles
    same = spark.createDataFrame([("h", "<div><p>b c d</p></div> x"), ("h", "<div><p>b c d</p></div> y")] * 2, "host string, html string")
    assert html_text._number("/div/p b") in html_text.templates(same).select(F.explode("roles")).toPandas()["col"].tolist()


def test_copies_of_a_page_are_no_template(spark):
    story = "every word of this story stands once"
    rows = [(n, "http://h.example/a", f"<div><p>{story}</p></div>") for n in range(5)]
    rows += [(5, "http://h.example/m", f"<script>{n}</script><div><p>{story}</p></div>") for n in range(3)]
    rows += [(6, "http://h.example/b", "<div><p>another text</p></div>"), (7, "http://h.example/c", "<div><p>a third one</p></div>")]
    texts = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in texts) == sorted(
        [(n, story) for n in range(5)] + [(5, story)] * 3 + [(6, "another text"), (7, "a third one")]
    )


def _classes(frame):
    """Host to its classes, each as the sequence of its tokens."""
    found = {}
    for row in frame.collect():
        by_class = {}
        for role, name, place, size in zip(row["roles"], row["names"], row["places"], row["sizes"]):
            by_class.setdefault(name, {})[place] = role
            assert place < size
        found[row["host"]] = {tuple(c[n] for n in range(len(c))) for c in by_class.values()}
    return found


def _brute(pages):
    rows = [Reader(h).roles() for h in pages]
    classes = {}
    for token in sorted({t for r in rows for t in r}):
        classes.setdefault(tuple(r.count(token) for r in rows), set()).add(token)
    ordered = []
    for vector, tokens in classes.items():
        met = sum(n > 0 for n in vector)
        seen = [[t for t in r if t in tokens] for r in rows]
        base = next(r[: len(tokens)] for r in seen if r)
        whole = all(r == base * (len(r) // len(tokens)) for r in seen) and len(set(base)) == len(tokens)
        if len(tokens) >= html_text.TOKENS and met >= html_text.PAGES and met >= len(rows) * html_text.SHARE and whole:
            ordered.append((-met, -len(tokens), tuple(base)))

    def spans(row, base):
        at = [n for n, t in enumerate(row) if t in base]
        return [at[n : n + len(base)] for n in range(0, len(at), len(base))]

    def nests(inner, outer):
        places = set()
        for row in rows:
            gaps = {n: (o, k) for o, span in enumerate(spans(row, outer)) for k in range(len(outer) - 1) for n in range(span[k], span[k + 1])}
            for span in spans(row, inner):
                inside = {gaps.get(n) for n in span}
                if len(inside) > 1 and not any(span[0] < s[0] and s[-1] < span[-1] for s in spans(row, outer)):
                    return False
                where = gaps.get(span[0])
                if where != gaps.get(span[-1]):
                    return False
                places.add(where and where[1])
        return len(places) <= 1

    kept = []
    for _, _, base in sorted(ordered):
        if all(nests(base, other) and nests(other, base) for other in kept):
            kept.append(base)
    return set(kept)


def _host(rng):
    """Pages of one host: a frame, a list of entries inside, classes that overlap, one that changes its parent."""
    pages = []
    for n in range(8):
        entries = "".join(f"<div class='entry'><h4>entry {rng.random()}</h4><p>by someone</p></div>" for _ in range(rng.randint(0, 3)))
        cross = "x1 y1 x2 y2 x3 y3 x4 " + "y1 y2 y3 " * (n % 2) if n else ""
        mover = "<table><tr><td>m</td></tr></table>"
        top, low = (mover, "") if n % 2 else ("", mover * 2)
        text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 30)))
        pages.append(
            f"<html><body><div id='top'>Home Shop Help {top}</div><div class='t'>{text}</div><div id='low'>Low {low}</div>"
            f"<section>{entries}</section><div class='x'>{cross}</div><div id='end'>All rights reserved</div></body></html>"
        )
    return pages


def test_templates_are_those_of_plain_python(spark):
    import random

    rng = random.Random(5)
    hosts = {f"h{n}": _host(rng) for n in range(4)}
    # classes that move between places of the frame have one path here
    hosts["moves"] = [f"<div>a {'m n o' if n % 2 else ''} b {'' if n % 2 else 'm n o m n o'} c {n}</div>" for n in range(6)]
    hosts["list"] = [f"<div>a b c {'<b>i j k</b> ' * n} d</div>" for n in range(6)]
    rows = [(host, page) for host, pages in hosts.items() for page in pages]
    found = _classes(html_text.templates(spark.createDataFrame(rows, "host string, html string")))
    expected = {host: _brute(pages) for host, pages in hosts.items()}
    assert found == expected
    words = lambda host, *ws: {_number("/div " + w) for w in ws}
    _number = html_text._number
    assert not any(words("moves", "m") & set(c) for c in found["moves"])  # ordered, but at two places
    assert any(words("list", "i", "j", "k") == set(c) for c in found["list"])  # nested
    for n in range(4):
        tokens = {t for c in found[f"h{n}"] for t in c}
        assert {_number(f"/html/body/div.x x{k}") for k in (1, 2, 3, 4)} <= tokens
        assert _number("/html/body/div.x y1") not in tokens  # overlaps with the larger class


def test_slots_of_a_page():
    template = {html_text._number(t): (1, n, 4) for n, t in enumerate(["<div", "/div a", "/div b", "/div>"])}
    template |= {html_text._number(t): (2, n, 3) for n, t in enumerate(["/div<p", "/div/p by", "/div/p>"])}
    found = [(slot, text.strip()) for slot, _, text in Reader("<div>a one <p>by me</p> two<p>by you</p> b three</div>four").slots(template) if text.strip()]
    slots = dict((text, slot) for slot, text in found)
    assert [text for _, text in found] == ["one", "me", "two", "you", "three", "four"]
    assert slots["one"] == slots["two"] and slots["me"] == slots["you"]
    assert len(set(slots.values())) == 4


def test_slots_are_chosen_by_their_content(spark):
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in "one two three four".split())
    frame = (
        "<html><body><div id='a'>{}</div><{tag}><h1>Same heading</h1><div class='k'>{}</div><div class='l'>{links}</div></{tag}>"
        "<div id='b'>{}</div><div id='c'>{only}</div></body></html>"
    )
    pages = []
    for tag in ("article", "div"):
        for n in range(6):
            story = " ".join(f"word{n}x{k}" for k in range(30))
            menu = "".join(f"<a>{w}{n}</a> " for w in ("go", "to"))
            pages.append((n, f"http://{tag}.example/{n}", frame.format(f"call now {n % 2}", story, menu, tag=tag, links=links, only=f"aside{n}")))
    rows = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for row in rows:
        n = row["page_id"]
        story = " ".join(f"word{n}x{k}" for k in range(30))
        # links that repeat go even from an article, all else of it stays
        assert row["text"] == (f"Same heading\n{story}" if "article" in row["url"] else f"{story}\naside{n}")


def test_template_decides_where_tags_do_not(spark, monkeypatch):
    """Given pages whose elements and classes name nothing have the text of the pages as given; without the template they have not."""
    from pyspark.sql import functions as F

    given = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("url LIKE '%//blog.tionsh.example.com/%'")
    nameless = F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer)>", "<$1div>"), 'class="ad"', 'class="k"')
    texts = lambda pages: {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    whole = texts(given)
    assert len(whole) == 320 and texts(given.withColumn("html", nameless)) == whole
    plain = html_text.templates
    monkeypatch.setattr(html_text, "templates", lambda pages: plain(pages).filter("false"))
    without = texts(given.withColumn("html", nameless))
    assert all(without[n] != whole[n] for n in whole)
