"""Employer lookup against a brute-force search."""

import random

from hireplane.functions.text import normalize_company  # noqa: F401
from hireplane.operators import resolve

HISTORY = (
    "company_name_norm string, total_perm_certified bigint, uscis_total_approvals bigint,"
    " trend_direction string, data_freshness_score double"
)


def brute(key, names, both):
    ranked = sorted(names, key=lambda n: (-n[1], n[0]))
    for n, _ in ranked:
        if n == key:
            return 1, n
    for n, _ in ranked:
        if n.startswith(key) or (both and key.startswith(n)):
            return 2, n
    if len(key) > 4:
        for n, _ in ranked:
            if key in n:
                return 3, n
    return None


def make_names():
    rng = random.Random(5)
    words = ["tech", "acme", "data", "nova", "s", "blue sky", "techno", "mega corp"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)}
    # One beginning shared by most names.
    names |= {f"techno {i}" for i in range(200)}
    return [(n, rng.randint(0, 5)) for n in sorted(names)]


def test_tiers_match_brute_force(spark):
    names = make_names()
    history = spark.createDataFrame([(n, v, 0, None, None) for n, v in names], HISTORY)
    keys = ["tech", "techno", "techno 7", "techno 77 labs", "acme", "ech", "echno", "nova data", "sky", "blue sky nova data s",
            "zzz", "x", "a", "mega corp", "ta no", "data acme tech", ""]
    for both in (True, False):
        df = spark.createDataFrame([(k,) for k in keys], "key string")
        got = {r.key: (r.tier, r.company_name_norm) for r in resolve.resolve_names(df, history, both).collect()}
        for key in keys:
            assert got.get(key) == brute(key, names, both), key


def test_coverage_audit_takes_any_length(spark):
    names = make_names()
    history = spark.createDataFrame([(n, v, 0, None, None) for n, v in names], HISTORY)
    displays = ["S", "Sky", "Techno", "Nothing Like It", "Mega Corp", "Inc", "Blue Sky Nova"]
    df = spark.createDataFrame([(d.lower(), d, None) for d in displays], "slug string, display_name string, ats string")
    got = {r.display_name: r.company_name_norm for r in resolve.coverage_audit(df, history).collect()}
    ranked = sorted(names, key=lambda n: (-n[1], n[0]))
    for d in displays:
        key = "" if d == "Inc" else {"Mega Corp": "mega"}.get(d, d.lower())
        assert got[d] == next((n for n, _ in ranked if key in n), None), d


def test_unknown_employers_are_neutral(spark):
    history = spark.createDataFrame([("acme", 10, 0, "stable", 1.0)], HISTORY)
    slugs = spark.createDataFrame([("acme",), ("zzz",), (None,)], "company_slug string")
    got = {r.company_slug: (r.base_score, r.perm_total, r.trend) for r in resolve.company_evidence(slugs, history).collect()}
    assert got == {"acme": (0.44, 10, "stable"), "zzz": (0.40, 0, "unknown")}
