"""Text nodes against the standard library's parser."""

import random
from html.parser import HTMLParser

import pytest

from hireplane.functions import text


class Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found = []

    def handle_data(self, data):
        self.found.append(data)


def nodes(raw):
    parser = Nodes()
    parser.feed(raw)
    parser.close()
    return "".join(parser.found)


def attribute(rng):
    # Names do not begin with a quote or an equals sign.
    name = rng.choice(["title", "x", "data-a", "o'k", 'q"q'])
    inside = "".join(rng.choice("ab c'>=/") for _ in range(rng.randint(0, 6)))
    blank = rng.choice(["", "", " "])
    kind = rng.randrange(4)
    if kind == 0:
        return f'{name}{blank}={blank}"{inside}"'
    if kind == 1:
        return f"{name}={blank}'{inside.replace(chr(39), chr(34))}'"
    if kind == 2:
        bare = "".join(rng.choice("abc'\"=") for _ in range(rng.randint(1, 5))).lstrip("'\"=")
        return f"{name}={bare or 'v'}"
    return name


def page(rng):
    out = []
    for _ in range(rng.randint(1, 8)):
        out.append("".join(rng.choice("uvw '\"=") for _ in range(rng.randint(0, 5))))
        if rng.random() < 0.7:
            out.append("<" + " ".join([rng.choice(["a", "b", "p", "h1"]), *[attribute(rng) for _ in range(rng.randint(0, 3))]]) + rng.choice([">", " >"]))
        else:
            out.append(f"</{rng.choice(['a', 'b', 'p'])}>")
    return "".join([*out, "end"])


def test_random_quotes_equal_the_parser(rows):
    rng = random.Random(8)
    pages = [page(rng) for _ in range(800)]
    got = rows(pages, text.text_nodes)
    assert [g.replace("\n", "") for g in got] == [nodes(p) for p in pages]


@pytest.mark.parametrize(("raw", "want"), [
    ("<a title='it's'>one</a> and <b>two's</b> end", "one and two's end"),
    ("""<article><p title='it's'>one</p><p>two's</p><p>three</p>""", "onetwo'sthree"),
    ('<a href="x>y">in</a> out', "in out"), ("<a b = 'c>d' e>f", "f"), ("1 < 2 and <i>3</i>", "1 < 2 and 3"),
    ("<p x=it's>a</p>b's", "ab's"), (None, ""),
])
def test_known_rows(rows, raw, want):
    assert rows([raw], text.text_nodes)[0].replace("\n", "") == want
    assert raw is None or nodes(raw) == want


def test_long_tags_and_many_open_ones(rows):
    raw = ["<a " + "x='y' " * 60_000 + ">t", "<a " * 20_000 + "t", "<a b='" + "c" * 300_000 + "'>t"]
    got = rows(raw, text.text_nodes)
    assert got[0] == "\nt" and got[2] == "\nt" and got[1] == raw[1]
