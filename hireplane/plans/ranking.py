"""Rank jobs for a table of candidates, from profiles or from résumés."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane.operators import matching, profiles as prof, resolve, scoring
from hireplane.session import stored

HANDOFF, TOP_N = 150, 30


def enrich_index(index: DataFrame, history: DataFrame, negation_guard: bool = False) -> DataFrame:
    """Signal and employer evidence on the job side.

    Both depend on the job alone, so they are computed once per job and once
    per distinct employer, before any candidate is looked at.
    """
    return with_employers(scoring.with_signals(index, "description_clean", negation_guard), history)


def with_employers(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Jobs with the evidence of their employers."""
    return scoring.with_evidence(jobs, resolve.company_evidence(jobs.select("company_slug"), history))


def score_given_matches(
    matches: DataFrame, profiles: DataFrame, history: DataFrame, as_of: datetime | str,
    audit: bool = False, jobs: DataFrame | None = None,
) -> DataFrame:
    """Score matches that carry no signal or evidence yet.

    With ``jobs`` (job_id, description_clean) each text is read once per job;
    without it once per match. Matches without description_text get it from
    ``jobs``, after all other joins.
    """
    texts = None
    if jobs is None:
        rows = scoring.with_signals(matches)
    else:
        wanted = jobs.join(matches.select("job_id").distinct(), "job_id", "left_semi").select("job_id", "description_clean")
        rows = matches.join(scoring.with_signals(wanted, "description_clean").drop("description_clean"), "job_id")
        if "description_text" not in matches.columns:
            texts = jobs.select("job_id", F.col("description_clean").alias("description_text"))
    return scoring.score_matches(with_employers(rows, history), profiles, as_of, audit, texts)


def rank_profiles(
    profiles: DataFrame, index: DataFrame, history: DataFrame, as_of: datetime | str,
    top_n: int = TOP_N, candidate_top_n: int = HANDOFF, candidate_blocks: int | None = None,
) -> DataFrame:
    """Match, score with the audit rules, keep the best ``top_n`` per candidate.

    Hand-off rows are scored on short columns only. Job texts, matched skills
    and explanations are added to the rows that remain.
    """
    pairs = matching.score_pairs(profiles, index, candidate_top_n, candidate_blocks)
    need = profiles.select("candidate_id", F.coalesce("requires_sponsorship", F.lit(False)).alias("requires_sponsorship"))
    handed = matching.top_matches(pairs, candidate_top_n).join(need, "candidate_id")
    facts = enrich_index(index, history).select(
        "job_id", "posted_at", "signal", "signal_delta", "base_score", "perm_total", "trend"
    )
    # Who needs no sponsorship skips the sponsorship joins.
    asking = handed.where("requires_sponsorship").join(facts, "job_id")
    skipping = handed.where("NOT requires_sponsorship").join(index.select("job_id", "posted_at"), "job_id")
    rows = asking.unionByName(skipping, allowMissingColumns=True)
    best = scoring.top_ranked(scoring.add_scores(rows, as_of), top_n)

    jobs = index.select(
        "job_id", "company_slug", "title", "location", "apply_url",
        F.col("description_clean").alias("description_text"),
    )
    asked = profiles.select("candidate_id", "technical_skills", "target_roles", "best_fit_roles")
    # Whoever asks comes first, so the rows do not move again once they hold a text.
    full = best.join(asked, "candidate_id").join(jobs, "job_id").withColumn(
        "matched_skills",
        matching.matched_skills(F.col("technical_skills"), F.col("description_text")),
    )
    return scoring.present(full, extra=("rank",))


def profiles_from_resumes(
    resumes: DataFrame, inputs: DataFrame, vectors: DataFrame, extracted: DataFrame | None = None
) -> DataFrame:
    """Profiles with user inputs and unit vectors (``vectors``: candidate_id, embedding)."""
    found = prof.extract_profiles(prof.usable_resumes(resumes))
    if extracted is not None:
        found = prof.prefer_extracted(found, prof.sanitise_extracted(extracted))
    full = prof.with_user_inputs(found, inputs)
    unit = vectors.select(
        "candidate_id", matching.unit_vector(vectors["embedding"]).cast("array<float>").alias("embedding")
    )
    return full.join(unit, "candidate_id", "left")


def rank_resumes(
    resumes: DataFrame, inputs: DataFrame, vectors: DataFrame, index: DataFrame,
    history: DataFrame, as_of: datetime | str, top_n: int = TOP_N, candidate_top_n: int = HANDOFF,
) -> DataFrame:
    """From résumé texts to ranked jobs."""
    # Matching reads the profiles for blocks, terms and scores; extraction runs once.
    profiles = stored(profiles_from_resumes(resumes, inputs, vectors), "profiles")
    return rank_profiles(profiles, index, history, as_of, top_n, candidate_top_n)
