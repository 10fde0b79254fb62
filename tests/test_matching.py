"""Block-wise matching against scoring every pair in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hireplane.functions.numbers import scaled4
from hireplane.operators import matching

PROFILES = (
    "candidate_id bigint, technical_skills array<string>, target_roles array<string>,"
    " best_fit_roles array<string>, preferred_locations array<string>, embedding array<float>"
)
JOBS = (
    "job_id string, company_slug string, title string, location string, apply_url string,"
    " posted_at string, is_active boolean, description_clean string, embedding array<float>"
)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-0.5, 0.0, 0.5, 1.0]) for _ in range(4)]
    skills = ["Python", "SQL", "R", "Go", "dbt"]
    people = [
        (i, rng.sample(skills, rng.randint(0, 4)), rng.choice([[], ["Data Engineer"], ["chef"]]), ["Data Analyst"],
         rng.choice([[], ["Remote"], ["New York, NY"]]), None if i == 4 else vec())
        for i in range(12)
    ]
    jobs = [
        (f"j{i}", "acme", rng.choice(["Data Engineer", "Data Analyst II", "Chef", None]),
         rng.choice(["Remote", "New York", "Paris", None]), "u", "2024-01-01", True,
         rng.choice(["python and sql", "go get it", "", "dbt, SQL; R"]), None if i == 7 else vec())
        for i in range(90)
    ]
    return people, jobs, spark.createDataFrame(people, PROFILES).cache(), spark.createDataFrame(jobs, JOBS).cache()


def every_pair(people, jobs, n):
    words = {"Data Engineer": ["data engineer", "data engineering"], "Data Analyst": ["data analyst"]}
    out = {}
    for cid, skills, target, best, places, v in people:
        rows = []
        for j in jobs:
            sem = sum(a * b for a, b in zip(v, j[8])) if v and j[8] else 0.0
            hit = [s for s in skills if s.lower() in j[7].lower()]
            skill = len(hit) / len(skills) if skills else 0.0
            title, place = (j[2] or "").lower(), (j[3] or "").lower()
            role = any(w in title for r in (target or best) for w in words.get(r, [r.lower()]))
            loc = bool(places) and ("remote" in place or any(
                w in place for p in places for w in p.lower().replace(",", " ").split() if len(w) > 2))
            rows.append((round(0.5 * sem + 0.3 * skill + 0.1 * role + 0.1 * loc, 4), j[0], hit))
        out[cid] = sorted(rows, key=lambda r: (-r[0], r[1]))[:n]
    return out


@pytest.mark.parametrize("blocks", [(1, 1), (3, 2), (2, 7), (5, 1)])
@pytest.mark.parametrize("top_n", [1, 10, 200])
def test_equals_every_pair(tables, blocks, top_n):
    people, jobs, c, x = tables
    got = {}
    for r in matching.match_candidates(c, x, top_n, *blocks).orderBy("candidate_id", "match_rank").collect():
        got.setdefault(r.candidate_id, []).append((r.match_score, r.job_id, r.matched_skills))
    assert got == every_pair(people, jobs, top_n)


def test_small_batches_and_compaction(tables, monkeypatch):
    people, jobs, c, x = tables
    monkeypatch.setattr(matching._Block, "BATCH_CELLS", 20)
    got = {}
    task = matching._block_task(5)
    for batch in matching.block_rows(c, x, 2, 1).toArrow().to_batches(max_chunksize=7):
        got.setdefault("rows", []).append(batch)
    rows = [r for out in task(iter(got["rows"])) for r in out.to_pylist()]
    want = every_pair(people, jobs, 5)
    for p in people:
        mine = sorted(((r["match_score"], r["job_id"]) for r in rows if r["candidate_id"] == p[0]), key=lambda r: (-r[0], r[1]))
        assert mine == [(s, j) for s, j, _ in want[p[0]]]


@pytest.mark.parametrize("blocks", [(1, 1), (6, 1), (2, 7)])
def test_vectors_of_another_length_are_an_error(tables, spark, blocks):
    people, jobs, c, x = tables
    odd = spark.createDataFrame([(*p[:5], [0.5] * 3 if p[0] == 2 else p[5]) for p in people], PROFILES)
    with pytest.raises(Exception, match="the vector of candidate_id 2 has another length: 3"):
        matching.match_candidates(odd, x, 3, *blocks).collect()
    odd_jobs = spark.createDataFrame([(*j[:8], [0.5] * 3 if j[0] == "j3" else j[8]) for j in jobs], JOBS)
    with pytest.raises(Exception, match="the vector of job_id j3 has another length: 3"):
        matching.match_candidates(c, odd_jobs, 3, *blocks).collect()


@pytest.mark.parametrize(("blocks", "most_scanned"), [((1, 1), 5000), ((6, 1), 100), ((2, 7), 0)])
def test_many_terms_in_any_blocks_scanned_or_indexed(tables, spark, blocks, most_scanned):
    people, jobs, _, x = tables
    many = [(p[0], [f"term{(p[0] * 31 + k) % 350}" for k in range(60)] + ["python", "SQL", "SQL"], *p[2:]) for p in people]
    texts = [(*j[:7], j[7] + f" term{i * 4} and term{i * 7 % 350}", j[8]) for i, j in enumerate(jobs)]
    want = every_pair(many, texts, 6)
    table, index = spark.createDataFrame(many, PROFILES), spark.createDataFrame(texts, JOBS)
    got = {}
    scores = matching.score_pairs(table, index, 6, *blocks, most_scanned=most_scanned)
    for r in matching.top_matches(scores, 6).orderBy("candidate_id", "match_rank").collect():
        got.setdefault(r.candidate_id, []).append((r.match_score, r.job_id))
    assert got == {c: [(s, j) for s, j, _ in rows] for c, rows in want.items()}


def test_texts_do_not_go_to_the_blocks(tables):
    _, _, c, x = tables
    assert set(matching.block_rows(c, x, 2, 2).columns) == {
        "candidate_id", "job_id", "embedding", "skills", "roles", "places", "has_place", "remote", "is_job", "block",
    }


def test_plan_has_no_pair_join(tables):
    _, _, c, x = tables
    plan = matching.match_candidates(c, x, 5, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(matching.unit_vector(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0], None]


def test_documented_score_terms(spark):
    rows = spark.createDataFrame([
        ("Senior Data Engineer", "Mid", ["Data Engineer"], 1, False), ("Principal Data Engineer", "Mid", ["Data Engineer"], 3, False),
        ("Data Scientist", "Senior", ["Data Engineer"], 0, True), ("Lead International Chef", "Entry", ["Data Engineer"], 2, False),
        (None, None, ["Data Engineer"], 0, False), ("Data Scientist", "Guru", [], 0, False), ("Intern, Data Analyst", "Entry", None, 0, False),
    ], "title string, level string, roles array<string>, gap int, off boolean")
    title, roles = F.col("title"), F.col("roles")
    got = rows.select("gap", "off", matching.seniority_gap(title, F.col("level")).alias("g"), matching.off_target(title, roles).alias("o")).withColumns({
        "low": matching.documented_score(F.lit(0.1), F.lit(0.0), F.lit(False), F.lit(False), F.col("g"), F.col("o")),
        "high": matching.documented_score(F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(True), F.col("g"), F.col("o")),
    }).collect()
    for r in got:
        assert (r["g"], r["o"]) == (r["gap"], r["off"])
        less = 0.08 * (r["gap"] == 1) + 0.15 * r["off"]
        want = (None, None) if r["gap"] >= 2 else (round(max(0.0, 0.05 - less), 4), round(1 - less, 4))
        assert (r["low"], r["high"]) == want


def test_job_texts_come_in_last(tables, spark):
    """The rows that hold a text are not dealt again: the job is the last to be joined."""
    _, _, profiles, index = tables
    plan = matching.match_candidates(profiles, index, 3)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "job_id" in joins[0] and "candidate_id" in joins[1]


@pytest.mark.parametrize(("candidates", "jobs", "top_n"), [(10_000, 1_000_000, 150), (250_000, 1_000_000, 20), (250_000, 1_000_000, 150), (15_000_000, 58_000_000, 20)])
def test_blocks_copy_few_bytes_and_stay_within_bounds(candidates, jobs, top_n):
    cb, jb = matching.block_counts(candidates, jobs, 64, top_n, 6, 100)
    # A job is copied to every candidate block, a candidate and its results to every job block.
    copied = lambda cb, jb: cb * jobs * 316 + jb * candidates * (406 + 12 * top_n)
    before = max(1, -(-candidates // 4096))
    assert copied(cb, jb) < 0.6 * copied(before, max(-(-100 // before), -(-jobs // 200_000)))
    assert candidates / cb <= matching.MOST_PER_BLOCK and candidates / cb * top_n * 102 <= matching.BLOCK_BYTES
    assert jobs / jb <= matching.JOBS_PER_BLOCK and candidates * jobs / (cb * jb) <= matching.PAIRS_PER_TASK


def test_blocks_of_small_tables():
    for candidates, jobs in ((0, 0), (1, 0), (0, 5), (1, 1), (3, 10**6)):
        cb, jb = matching.block_counts(candidates, jobs, 0, 20, 4, 4)
        assert 1 <= cb <= max(1, candidates) and jb >= 1


def test_pairs_that_cannot_count_are_not_scored_exactly(monkeypatch):
    """Similar scores, ties and long vectors: the best are those of scoring every pair exactly, of which few are."""
    rng = np.random.default_rng(5)
    n, m, width, top_n = 40, 3000, 16, 5
    people, jobs = rng.standard_normal((n, width)), np.round(rng.standard_normal((m, width)) * 4) * 2
    jobs[500:900] = jobs[100]
    lists = lambda count, most: [[int(x) for x in rng.choice(8, rng.integers(0, most), replace=False)] for _ in range(count)]
    c = {k: lists(n, 5) for k in ("skills", "roles", "places")}
    x = {k: lists(m, 5) for k in ("skills", "roles", "places")}
    remote, has_place = rng.random(m) < 0.1, [bool(v) for v in c["places"]]
    hits = lambda kind: np.array([[len(set(a) & set(b)) for a in c[kind]] for b in x[kind]])
    skill = hits("skills") / np.maximum([len(v) for v in c["skills"]], 1)
    place = (hits("places") > 0) | (remote[:, None] & np.array(has_place)[None, :])
    total = 0.5 * (jobs @ people.T) + 0.3 * skill + 0.1 * (hits("roles") > 0) + 0.1 * place
    table = pa.table({
        "candidate_id": pa.array(range(n)), "embedding": pa.array(people.tolist(), pa.list_(pa.float64())),
        **{k: pa.array(v, pa.list_(pa.int64())) for k, v in c.items()}, "has_place": pa.array(has_place),
    })
    batch = pa.RecordBatch.from_pydict({
        "job_id": pa.array([f"j{i:05}" for i in range(m)]), "embedding": pa.array(jobs.tolist(), pa.list_(pa.float64())),
        **{k: pa.array(v, pa.list_(pa.int64())) for k, v in x.items()}, "remote": pa.array(remote),
    })
    monkeypatch.setattr(matching._Block, "BATCH_CELLS", 2000)
    exact = []
    semantic = matching._Block._semantic
    monkeypatch.setattr(matching._Block, "_semantic", lambda self, v, j, k: exact.append(len(j)) or semantic(self, v, j, k))
    block = matching._Block(table, top_n)
    block.add(batch)
    got = {}
    for out in block.result():
        for r in out.to_pylist():
            got.setdefault(r["candidate_id"], []).append((r["match_score"], r["job_id"]))
    scores = scaled4(total) / 10_000
    for i in range(n):
        want = sorted(((scores[k, i], f"j{k:05}") for k in range(m)), key=lambda r: (-r[0], r[1]))[:top_n]
        assert sorted(got[i], key=lambda r: (-r[0], r[1])) == want
    assert sum(exact) < n * m / 4
