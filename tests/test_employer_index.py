"""Lookups in the stored employer index against the search over the whole history."""

import re

import pytest
from pyspark.sql import functions as F
from test_resolve import HISTORY, brute, make_names

from hireplane.operators import resolve, serving
from hireplane.operators.employer_index import EmployerIndex, write_index

KEYS = ["tech", "techno", "techno 7", "techno 77 labs", "acme", "ech", "echno", "nova data", "sky", "blue sky nova data s",
        "zzz", "x", "a", "mega corp", "ta no", "data acme tech", "", None, "techno"]


@pytest.fixture(scope="module")
def names():
    return make_names()


@pytest.fixture(scope="module")
def history(spark, names):
    return spark.createDataFrame([(n, v, 0, None, None) for n, v in names], HISTORY)


@pytest.fixture(scope="module")
def index(spark, history, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("employers"))
    write_index(history, path, buckets=37)
    return EmployerIndex(spark, path)


@pytest.mark.parametrize("both", [True, False])
def test_same_rows_as_the_whole_history(spark, names, history, index, both):
    df = spark.createDataFrame([(k,) for k in KEYS], "key string")
    got = {r.key: (r.tier, r.company_name_norm) for r in index.resolve(df, both).collect()}
    assert got == {k: brute(k, names, both) for k in KEYS if k is not None and brute(k, names, both)}
    assert sorted(got) == sorted(r.key for r in resolve.resolve_names(df, history, both).collect())
    assert index.resolve(df.where("key = 'nobody'"), both).count() == 0


def test_a_lookup_reads_the_folders_of_its_keys(spark, names, history, tmp_path):
    write_index(history, str(tmp_path), buckets=37)
    asked = {
        "starts": ["techno 7"], "pieces": ["techn"], "names": ["techno 7"[:n] for n in range(1, 9)],
    }
    for table, keys in asked.items():
        rows = spark.createDataFrame([(k,) for k in keys], "k string")
        mine = {r[0] for r in rows.select(F.pmod(F.xxhash64("k"), F.lit(37)).cast("int")).collect()}
        # No other folder can be read.
        for folder in (tmp_path / "of-37" / table).glob("bucket=*"):
            if int(folder.name.split("=")[1]) not in mine:
                for file in folder.glob("part-*"):
                    file.write_text("not a table")
    df = spark.createDataFrame([("techno 7",)], "key string")
    out = EmployerIndex(spark, str(tmp_path)).resolve(df, True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    # Only the key is taken apart, not the names of the history.
    assert plan.count("Generate explode") == 1
    assert [(r.tier, r.company_name_norm) for r in out.collect()] == [brute("techno 7", names, True)]


def test_history_response(spark, tmp_path):
    columns = ("total_perm_denied", "recent_perm_certified", "recent_perm_denied", "uscis_total_approvals", "uscis_total_denials")
    rows = [("acme labs", "Acme Labs, Inc.", 12), ("acme", "ACME", 7), ("blue sky", "Blue Sky LLC", 3)]
    history = spark.createDataFrame(rows, "company_name_norm string, company_name_raw string, total_perm_certified bigint")
    history = history.withColumns({c: F.lit(2) for c in columns}).withColumns({
        "perm_approval_rate": F.lit(0.5), "recent_approval_rate": F.lit(None).cast("double"), "trend_direction": F.lit("stable"),
        "data_freshness_score": F.lit(1.0), "perm_by_year": F.create_map(F.lit("2024"), F.struct(F.lit(1).alias("certified"))),
    })
    write_index(history, str(tmp_path / "i"))
    asked = spark.createDataFrame([("Acme, Inc.",), ("sky blue",), ("e sky",), (None,), ("Blue",)], "name string")
    whole = serving.employer_history(asked, history)
    got = serving.employer_history_by_index(asked, EmployerIndex(spark, str(tmp_path / "i")))
    assert got.columns == whole.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert {r.name: r.company_name_raw for r in got.collect()}["e sky"] == "Blue Sky LLC"


def test_a_rerun_replaces_and_missing_indexes_are_told(spark, history, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError, match="no employer index"):
        EmployerIndex(spark, path)
    write_index(history, path, 5)
    write_index(history.where("company_name_norm = 'acme'"), path, 5)
    df = spark.createDataFrame([("techno 7",), ("acm",)], "key string")
    left = brute("acm", [(n, v) for n, v in make_names() if n == "acme"], False)
    assert [tuple(r)[1:] for r in EmployerIndex(spark, path).resolve(df, False).collect()] == ([left] if left else [])
    write_index(history, path, 7)
    with pytest.raises(ValueError, match="several"):
        EmployerIndex(spark, path)


def test_empty_history(spark, history, tmp_path):
    write_index(history.where("company_name_norm = ''"), str(tmp_path / "i"), 3)
    assert EmployerIndex(spark, str(tmp_path / "i")).resolve(spark.createDataFrame([("a",)], "key string"), True).count() == 0
