"""Registered queries next to their DuckDB SQL at the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry
import check
from hireplane import catalog
from hireplane.catalog.bindings import DuckDB, with_inputs
from hireplane.catalog.registry import DERIVED

SF = "/root/testdata/sf0.001"
NAMES = [
    "p6_all_providers", "j7_provider_fallback", "t1_silver_jobs", "t2_sponsorship_history", "j5_resolve_slugs",
    "t3_employer_history", "x12_summary", "x14_prefer_extracted", "m8_match_candidates", "e10_score_library",
    "t7_rank_profiles", "g14_result_summary", "t5_browse_jobs",
]


def test_every_query_has_sql():
    queries, oracles = catalog.all_queries(), catalog.all_oracles()
    assert set(queries) == set(oracles) <= set(entry.queries())
    assert len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got)
    assert check.compare(got, check.duck(SF).execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_skill_overlap_covers_every_pair(spark):
    got = entry.queries()["m3_skill_overlap"](spark, SF).toPandas()
    assert check.compare(got, check.duck(SF).execute(entry.oracle_sql()["m3_skill_overlap"]).df()) is None
    told, people, jobs = (got[got.kind == kind] for kind in ("overlap", "candidate", "job"))
    count = "SELECT (SELECT count(*) FROM candidates), (SELECT count(*) FROM index_table)"
    sizes = check.duck(SF).execute(with_inputs(DuckDB(), ["candidates", "index_table"], count, DERIVED)).fetchone()
    assert (len(people), len(jobs)) == sizes
    pairs = {(int(c), j) for c, j in zip(told.candidate_id, told.job_id)}
    assert pairs == {(int(c), j) for c in people.same_as for j in jobs.same_as} and len(pairs) == len(told)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_stored_ranks_hold_no_texts(spark):
    """Serving queries read ranks from a file; the text of a job is in the index, once."""
    from hireplane.catalog import q_scoring, registry
    from hireplane.catalog.bindings import Inputs

    q_scoring.results(Inputs(spark, SF))
    _, schema = registry._STORED[(spark.sparkContext.applicationId, SF, "ranked")]
    assert "description_text" not in schema.names and {"reasoning", "matched_skills", "rank"} <= set(schema.names)
