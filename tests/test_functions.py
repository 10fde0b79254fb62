"""Scalar rules against values worked out by hand."""

from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hireplane.functions import dates, numbers, signals, text
from hireplane.operators import filings, matching, scoring


def test_employer_names(rows):
    names = ["Acme Technologies, Inc.", "Global Systems Inc", None, "Café Müller GmbH & Co", "U.S. Bank"]
    assert rows(names, text.normalize_company) == ["acme", "", "", "café müller gmbh", "u s bank"]


def test_us_locations(rows):
    places = [
        "San Francisco, CA", "Remote", " remote ", "Remote - Australia", "Remote - Germany",
        "Toronto, Canada", "London, UK", "Austin/TX.", "", None, "Berlin, Germany | Ohio",
    ]
    assert rows(places, text.is_us_location) == [
        True, True, True, True, False, False, False, True, False, False, True,
    ]


def test_target_roles(rows):
    assert rows(["Senior DATA Engineer II", "Engineer", None], text.is_target_role) == [True, False, False]


def test_html_to_text(spark):
    html = [
        "<html><!-- c --><style>p{}</style><p>One &amp; two<b>three</b></p>\n\n\n\n<script>x='</p>'</script>end&nbsp;</html>",
        "caf&eacute; &amp;lt; &#8364;", "&amp;eacute; stays", None, "<p></p>" * 20000 + "x",
    ]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, h string")
    got = [r.t for r in text.add_html_text(df, "h", "t").orderBy("i").collect()]
    assert got == ["One & two\nthree\n\nend", "café &lt; €", "&eacute; stays", "", "x"]


def test_fiscal_years(rows):
    days = [date(2024, 9, 30), date(2024, 10, 1), None]
    assert rows(days, dates.fiscal_year, "date") == [2024, 2025, None]
    assert dates.current_fiscal_year("2001-12-31 00:00:00") == 2002


@pytest.mark.parametrize("age,score", [(0, 1.0), (3, 1.0), (4, 0.85), (7, 0.85), (8, 0.70), (30, 0.5), (61, 0.1)])
def test_recency(rows, age, score):
    as_of = datetime(2024, 3, 31, 12)
    posted = date.fromordinal(as_of.date().toordinal() - age).isoformat()
    assert rows([posted], lambda c: dates.days_since(c, as_of)) == [age]
    assert rows([age], dates.recency, "int") == [score]


def test_unknown_dates_are_neutral(rows):
    days = rows(["", "n/a", None, "2099-01-01"], lambda c: dates.days_since(c, "2024-01-01 00:00:00"))
    assert days == [-1, -1, -1, 0]
    assert rows([-1], dates.recency, "int") == [0.5]


def test_epoch(rows):
    assert rows([0, None, 1700000000000, 1700000000123], dates.epoch_ms_to_iso, "bigint") == [
        "", "", "2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20.123000+00:00",
    ]


def test_signals(rows):
    texts = [
        "We will  sponsor visas", "we are unable to sponsor visas", "No sponsorship.", "open to sponsorship",
        "must be authorized to work", "nothing here", None, "require a long\ntext sponsorship to work",
        "you require employer sponsorship to work",
    ]
    assert rows(texts, signals.sponsorship_signal) == [
        "positive", "positive", "negative", "likely_positive", "likely_negative", "unknown", "unknown",
        "unknown", "negative",
    ]
    guarded = rows(texts[:2], lambda c: signals.sponsorship_signal(c, negation_guard=True))
    assert guarded == ["positive", "negative"]


def test_trend(spark):
    data = {
        "up": {2020: 10, 2021: 10, 2025: 12}, "gone": {2019: 10, 2020: 10, 2021: 10},
        "short": {2024: 5, 2025: 9}, "new": {2025: 1, 2026: 2, 2027: 3},
        "from_zero": {2020: 0, 2021: 0, 2026: 1}, "flat": {2020: 10, 2021: 10, 2025: 9},
        "down": {2020: 10, 2021: 10, 2025: 6},
    }
    rows_ = [(n, y, c, 0) for n, ys in data.items() for y, c in ys.items()]
    df = spark.createDataFrame(rows_, "company_name_norm string, fiscal_year int, certified bigint, denied bigint")
    got = {r[0]: r[1] for r in filings.trends(df, 2026).collect()}
    assert got == {
        "up": "increasing", "gone": "decreasing_sharply", "short": "insufficient_data",
        "new": "insufficient_data", "from_zero": "increasing", "flat": "stable", "down": "decreasing",
    }


def test_employer_base(spark):
    df = spark.createDataFrame(
        [(87, 20, "stable", 0.82), (0, 0, None, None), (0, 500, None, None), (250, 0, "increasing", 1.0)],
        "c int, p int, t string, f double",
    )
    got = [r[0] for r in df.select(scoring.employer_base(*[F.col(x) for x in "cptf"])).collect()]
    assert got == pytest.approx([0.61268, 0.135, 0.3825, 0.95])


def test_contradictions(spark):
    cases = [
        ("positive", 0, "stable", -0.10), ("negative", 100, "stable", 0.05),
        ("positive", 5, "decreasing_sharply", -0.08), ("negative", 5, "increasing", 0.0), ("unknown", 0, "x", 0.0),
    ]
    df = spark.createDataFrame(cases, "s string, p int, t string, want double")
    for r in df.select("*", scoring.contradiction(F.col("s"), F.col("p"), F.col("t")).alias("c")).collect():
        assert r.c.adjustment == r.want
        assert (r.c.note == "") == (r.s == "unknown")


def test_final_scores(spark):
    df = spark.createDataFrame([(0.835, 0.61, 0.85, True), (0.85, None, 1.0, False)], "m double, v double, r double, i boolean")
    got = [r[0] for r in df.select(scoring.final_score(*[F.col(x) for x in "mvri"])).collect()]
    assert got == [0.76, 0.895]


def test_role_and_location(spark):
    df = spark.createDataFrame(
        [("ML Engineer", ["ML Engineer"], "Remote", []), ("Data Engineering Lead", ["Data Engineer"], "Los Angeles", ["la"]),
         ("Chef de Partie", ["chef"], "New York", ["York, PA"]), (None, [], None, ["Remote"])],
        "t string, r array<string>, l string, p array<string>",
    )
    got = df.select(matching.role_match(F.col("t"), F.col("r")), matching.location_match(F.col("l"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (True, True), (False, False)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(
    st.floats(-1, 2, allow_nan=False),
    st.integers(-9999, 19999).map(lambda n: (2 * n + 1) / 20000),
    st.integers(0, 64).map(lambda n: n / 64),
), min_size=1, max_size=200))
def test_rounding_is_exact(spark, values):
    import numpy as np

    want = [round(v, 4) for v in values]
    assert (numbers.scaled4(np.array(values)) / 10_000).tolist() == want
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.r for r in df.select("i", numbers.round4(F.col("v")).alias("r")).orderBy("i").collect()] == want


def test_text_of_odd_markup(spark):
    cases = {
        '<a title="x>y">z</a>': "z", '<?xml version="1.0"?>t': "t", "a<script>var x": "a", "<p title=\'a>b\'>k": "k",
        "<p " + 'x="1" ' * 2000 + ">ok": "ok", "a < b > c": "a < b > c",
    }
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    got = {r.h: r.t for r in text.add_html_text(df, "h", "t").collect()}
    assert got == cases


def test_title_letters_are_in_every_match(spark):
    """The letters asked for before a title pattern runs leave no match out, whatever characters it is written with."""
    from hireplane import constants as K
    from hireplane.operators import profiles

    texts = [
        "senior  DATA engineering", "Data\u00a0scienti\u017ft", "data analy\u017ft", "ANALYTIC\u017f engineer", "ml eng\u0131neer", "Machine Learning ENG\u0130NEER",
        "\u017foftware engineer", "Platform engineer", "bac\u212aend engineer", "data arch\u0131tect", "no title", "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = F.array_compact(F.array(*[F.nullif(F.regexp_extract("text", "(?iU)" + p, 0), F.lit("")) for p in K.JOB_TITLES]))
    got = rows.select(F.size(profiles.job_titles(F.col("text"), F.lower("text"))).alias("n"), F.size(plain).alias("m"), "text").collect()
    assert [(r.text, r.n) for r in got] == [(r.text, r.m) for r in got]
    assert sum(r.n for r in got) >= 8
