"""Preference formatting and page text."""

import re

import pytest
from pyspark.sql import functions as F

from hireplane.llm import preferences, wrappers

TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 2, "user", None),
        (3, 0, "system", "s"), (4, 0, None, "hi"), (4, None, "user", "first"), (4, 1, "assistant", "good"), (4, 1, "assistant", "good"),
    ]
    return spark.createDataFrame(rows, TURNS)


def test_pairs(spark, turns):
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 1, 99), (4, 3, 1)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    got = {r["pair_id"]: r for r in preferences.format_pairs(preferences.pair_up(turns, pairs)).collect()}
    one = got[1]
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and one["n_prompt_turns"] == 1 and not one["identical"]
    assert one["chosen_texts"] == ["<|im_start|>assistant\n", "good<|im_end|>\n"] and one["chosen_masks"] == [0, 1]
    assert one["rejected_masks"] == [0, 1, 0, 0] and one["rejected_texts"][3] == "<|im_end|>\n"
    assert got[2]["identical"] and got[2]["chosen_texts"] == [] and got[2]["n_prompt_turns"] == 2
    assert got[3]["prompt"] == "" and got[3]["rejected_texts"] == [] and len(got[3]["chosen_texts"]) == 4
    assert got[4]["n_prompt_turns"] == 0


def test_swapped_replies(spark, turns):
    got = {r["pair_id"]: r for r in preferences.format_pairs(preferences.swapped_replies(turns)).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["chosen_texts"][1] == "good<|im_end|>\n" and got[1]["rejected_texts"][1] == "bad<|im_end|>\n"
    assert got[2]["rejected_texts"] == []
    assert got[4]["n_prompt_turns"] == 3 and got[4]["prompt"].startswith("<|im_start|>user\nfirst")
    extra = turns.select("*", F.lit(1).alias("turns"), F.lit(2).alias("pair_id"))
    assert preferences.format_pairs(preferences.swapped_replies(extra)).count() == 3
    assert preferences.format_pairs(preferences.swapped_replies(turns.limit(0))).count() == 0
    plan = preferences.format_pairs(preferences.swapped_replies(turns.coalesce(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def text_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}


PAGE = """<html><head><title>T</title></head><body><div class="top-menu"><a href="/">Home</a></div><nav><ul>{links}</ul></nav>
<!-- x --><div class="ad">Buy &amp; buy</div><article><header><h1>Head {n}</h1></header>{body}<aside>Also</aside><form>Mail</form>
<div class="comments"><p>First!</p></div></article><footer>&copy; x</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_article_text(spark):
    bodies = ["<p>One &lt;b&gt;<br>two\n  three<p>Four <b>five</b>", "<p>Only", "<p>A</p><ul><li>B<li>C</ul><p>D</p>", ""]
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i, body=b, links="<li><a href=x>l</a></li>" * (i + 1))) for i, b in enumerate(bodies)]
    got = text_of(spark, rows)
    assert got[0] == "Head 0\nOne <b> two three\nFour five"
    assert got[1] == "Head 1\nOnly" and got[2] == "Head 2\nA\nB\nC\nD" and got[3] == "Head 3"


def test_pages_without_article_lose_what_is_alike(spark):
    page = "<body><div>Site name</div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div class=x><p>{}</p><p>{}</p></div><div>Read on at our site</div></body>"
    rows = [(i, "http://k.example/" + str(i), page.format(f"text {i}", f"more {i}")) for i in range(5)]
    rows += [(9, "http://lone.example/", page.format("a", "b"))]
    got = text_of(spark, rows)
    assert got[3] == "text 3\nmore 3"
    assert got[9] == "Site name\na\nb\nRead on at our site"


def test_awkward_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "x", "<"), (4, "http://a", "<!-- never closed <p>x</p>"), (5, "http://a", "<script>open <p>x"),
        (6, "http://a", "plain &eacute; &#x41; &nbsp; text"), (7, "http://a", "<article><p title='a>b'>y" + "<div>" * 300 + "z"), (7, "http://a", "<p>twice"),
        (8, "http://b", "</div></p><main>m</main>" + "<p>word</p>" * 2000),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("mine")).withColumn("host", F.lit(1))
    got = [(r["page_id"], r["text"]) for r in wrappers.extract(pages).collect()]
    assert len(got) == len(rows)
    texts = dict(got[:6] + got[7:])
    assert texts[1] == texts[2] == texts[4] == texts[5] == ""
    assert texts[6] == "plain é A text" and texts[8] == "m" and ("7", "y\nz") in [(str(i), t) for i, t in got]
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_join_gives_the_same_as_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", PAGE.format(n=i, body=f"<p>b{i}" * (i % 4), links="")) for i in range(12)]
    want = text_of(spark, rows)
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", 0)
    assert text_of(spark, rows) == want


def test_wrapper_inference():
    stream = lambda text: [["t", x] if x[0].islower() or x[0] == "/" else ["#", hash(x) % 1000] for x in text.split()]
    a, b = wrappers.fold_repeats(stream("ul li A li B li C /ul p X")), wrappers.fold_repeats(stream("ul li D li E /ul hr p Y"))
    both = wrappers.align(a, b)
    assert wrappers.shape(both) == ("ul", (True, ("li", "#")), "/ul", (False, ("hr",)), "p", "#")
    assert both[3][2] and both[-1][1] is None
    one = wrappers.align(stream("li A"), wrappers.fold_repeats(stream("li A li B")))
    assert all(x[0] == "g" for x in one)


def test_long_streams_align_in_bounded_time(monkeypatch):
    import random

    rng = random.Random(4)
    for size in (40, 300, 20_000):
        a = [["t", rng.choice("abcdefgh") + str(i % 50)] for i in range(size)]
        b = [x for x in a if rng.random() > 0.1] + [["t", "z"]]
        b[size // 3 : size // 3] = [["t", "q"]] * 30
        pairs = wrappers.matched(a, b)
        assert pairs == sorted(pairs) and all(a[i][1] == b[j][1] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) >= len(b) - 31 if size < 500 else len(pairs) > 0.5 * size
    unique = [["t", f"n{i}"] for i in range(3000)]
    assert len(wrappers.matched(unique, unique[:900] + unique[1500:] + unique[1000:1100])) == 2400
    assert wrappers.matched([], unique) == wrappers.matched(unique, []) == []


def test_long_pages_without_repeats(spark):
    tags = ["p", "h2", "h3", "dd", "pre", "section"]
    page = lambda n: "<main>" + "".join(f"<{tags[(i * i + i // 7 * n) % 6]}>w{i}" for i in range(6000)) + "</main>"
    got = text_of(spark, [(n, "http://long.example/", page(n)) for n in range(3)])
    assert all(t.split("\n") == [f"w{i}" for i in range(6000)] for t in got.values())


def test_every_page_of_the_tables_equals_a_plain_parser(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_the_wrapper_decides_on_a_page_without_article(spark):
    page = "<body><div>Site name</div>{}<p>{}</p><p>{}</p>{}<div>Read on</div></body>"
    sources = [page.format("<article>", f"a{i}", f"b{i}", "</article>") for i in range(3)] + [page.format("<section>", "a3", "b3", "</section>")]
    got = text_of(spark, [(i, "http://w.example/" + str(i), x) for i, x in enumerate(sources)] + [(9, "http://lone.example/", sources[3])])
    assert got == {0: "a0\nb0", 1: "a1\nb1", 2: "a2\nb2", 3: "a3\nb3", 9: "Site name\na3\nb3\nRead on"}
    last = wrappers.Page(sources[3])
    assert wrappers.main_text(last, wrappers.Slots([], 4)) == got[9]
    marked = wrappers.Page("<body><article><p>t</article><section><p>more</section></body>")
    both = wrappers.Slots(wrappers.fold_repeats(wrappers.Page("<body><article><p>t</article><article><section><p>more</section></article></body>").tokens), 1)
    assert wrappers.main_text(marked, both) == "t\nmore"
    alone = wrappers.Slots(wrappers.fold_repeats(marked.tokens), 1)
    assert wrappers.main_text(marked, alone) == "t" and wrappers.main_text(marked, wrappers.Slots([], 1)) == "t\nmore"


def test_an_empty_wrapper_gives_other_texts_than_the_inferred_one(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    none = {r["page_id"]: wrappers.main_text(wrappers.Page(r["html"]), wrappers.Slots([], 1)) for r in pages.collect()}
    assert all(got[k] and got[k] != none[k] for k in got)


def test_article_text_is_not_lost(spark):
    body = (
        "<p class='ad-hoc'>ad hoc</p><p class='social-science'>science</p><p id='notice-period'>period</p><p>E = <math><mi>m</mi><mo>&sup2;</mo></math> holds</p>"
        "<p title='it's'>one</p><p>two's</p><p><a href=x>all link</a></p><p class='cookie-notice'>cookies</p><div id='ad-slot-3'>buy</div>"
    )
    want = "Head {n}\nad hoc\nscience\nperiod\nE = m² holds\none\ntwo's\nall link"
    got = text_of(spark, [(n, f"http://l.example/{n}", PAGE.format(n=n, body=body, links="")) for n in range(4)])
    assert got == {n: want.format(n=n) for n in range(4)}
    unmarked = "<body><div>Site</div><ul><li><a href=a>Menu</a></ul><div class=x><h1>{}</h1>{}</div></body>"
    pages = [unmarked.format(f"t{n}", f"<p>{'<a href=x>' * (n == 2)}p{n}</a></p>") for n in range(5)]
    assert text_of(spark, list(zip(range(5), ["http://u.example/"] * 5, pages))) == {n: f"t{n}\np{n}" for n in range(5)}


def test_the_order_of_the_pages_changes_nothing(spark):
    import random

    rng = random.Random(11)
    parts = ["<p>{}</p>", "<div class='promo'>{}</div>", "<ul><li>{}</li><li>x</li></ul>", "<h2>{}</h2>", "<section><p>{}</p></section>", "<div><a href=y>{}</a></div>"]
    rows = []
    for host in range(20):
        for _ in range(6):
            inside, before, after = ("".join(rng.choice(parts).format(rng.randrange(9)) for _ in range(rng.randrange(5))) for _ in range(3))
            frame = "<article>{}</article>" if rng.random() < 0.7 else "<section>{}</section>"
            rows.append((len(rows), f"http://h{host}.example/", f"<body>{before}{frame.format(inside)}{after}</body>"))
    want = text_of(spark, rows)
    for _ in range(2):
        rng.shuffle(rows)
        assert text_of(spark, rows) == want


def test_blocks_of_one_page_alone_stay(spark):
    bodies = ["<p>a</p>", "<p>b</p>", "<p>c</p><h2>sub</h2><blockquote>more</blockquote>"]
    rows = [(i, f"http://o.example/{i}", f"<body><h1>Site</h1><div>{b}</div></body>") for i, b in enumerate(bodies)]
    assert text_of(spark, rows) == {0: "a", 1: "b", 2: "c\nsub\nmore"}
    assert text_of(spark, rows[1:]) == {1: "Site\nb", 2: "Site\nc\nsub\nmore"}
    alike = [(i, f"http://o.example/{i}", rows[2][2]) for i in range(3)]
    assert set(text_of(spark, alike).values()) == {"Site\nc\nsub\nmore"}


def test_long_repeated_records(spark):
    tags = ["h2", "h3", "h4", "dl", "dt", "dd", "pre", "p"]
    record = lambda k: "".join(f"<{t}>{t} {k}" for t in tags)
    page = lambda n: "<body><h1>Site</h1><ul>" + "".join(record(k) for k in range(n)) + "</ul></body>"
    folded = wrappers.fold_repeats(wrappers.Page(page(7)).tokens)
    assert [x[1] for x in folded if x[0] == "g"] == [True] and len(folded) == 8
    got = text_of(spark, [(n, f"http://r.example/{n}", page(n)) for n in (3, 4, 5)])
    assert got == {n: "\n".join(f"{t} {k}" for k in range(n) for t in tags) for n in (3, 4, 5)}
