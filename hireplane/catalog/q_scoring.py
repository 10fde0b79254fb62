"""Queries over matches: scoring, ranking, serving and the full refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireplane import constants as K
from hireplane import schemas as S
from hireplane.catalog import sqltext as q
from hireplane.catalog.bindings import FILINGS_AS_OF, POSTINGS_AS_OF, Inputs
from hireplane.catalog.q_candidates import candidate_table, index_table, job_index, top20
from hireplane.catalog.q_filings import history_table, uscis_raw
from hireplane.catalog.q_postings import raw_postings, silver
from hireplane.catalog.registry import DERIVED, register, stored
from hireplane.functions import dates
from hireplane.operators import resolve, scoring, serving
from hireplane.plans import ranking
from hireplane.plans.refresh import refresh
from hireplane.session import scratch_path
from hireplane.sources import readers


def silver_table(i: Inputs) -> DataFrame:
    """Silver jobs without their texts, which no serving query reads."""
    return stored(i, "silver", lambda x: silver(x, ()))


# --- scalars -----------------------------------------------------------------------

_DAYS = q.days_since("posted_at", POSTINGS_AS_OF)


@register("d8_recency", (["silver"], f"""
    SELECT job_id, posted_at, {_DAYS} AS days, {q.recency(_DAYS)} AS recency FROM silver"""))
def _(i):
    days = dates.days_since(F.col("posted_at"), POSTINGS_AS_OF)
    return silver_table(i).select("job_id", "posted_at", days.alias("days")).withColumn(
        "recency", dates.recency(F.col("days"))
    )


_DELTA = q.lookup("signal", {k: f"{v}::DOUBLE" for k, v in K.SIGNAL_DELTAS.items()}, "0.0")
DERIVED["signals"] = (["index_table"], f"""
    SELECT *, {_DELTA} AS signal_delta FROM (
      SELECT *, {q.signal('description_clean')} AS signal FROM index_table)""")


def signal_table(i: Inputs) -> DataFrame:
    """Signals of the jobs of the index; each text is read where the index is made, so neither texts nor vectors are written for it."""
    told = lambda x: scoring.with_signals(job_index(x), "description_clean")
    return stored(i, "signals", lambda x: told(x).select("job_id", "company_slug", "signal", "signal_delta"))


@register("e1_sponsorship_signal", (["signals"], "SELECT job_id, signal, signal_delta FROM signals"))
def _(i):
    return signal_table(i).select("job_id", "signal", "signal_delta")


@register("e1_guarded_signal", (["index_table"], f"""
    SELECT job_id, {q.signal('description_clean', True)} AS signal FROM index_table"""))
def _(i):
    return scoring.with_signals(job_index(i), "description_clean", True).select("job_id", "signal")


@register("g12_signal_distribution", (["signals"], "SELECT signal, count(*) AS n FROM signals GROUP BY ALL"))
def _(i):
    return serving.signal_distribution(signal_table(i))


DERIVED["enriched"] = (["signals", "evidence"], """
    SELECT s.*, e.base_score, e.perm_total, e.trend, e.freshness FROM signals s JOIN evidence e USING (company_slug)""")


def enriched(i: Inputs) -> DataFrame:
    return ranking.with_employers(signal_table(i), history_table(i))


@register("j10_attach_signals", (["enriched"], """
    SELECT job_id, company_slug, signal, signal_delta, round(base_score, 6) AS base_score, perm_total, trend, freshness
    FROM enriched"""))
def _(i):
    return enriched(i).select(
        "job_id", "company_slug", "signal", "signal_delta", "base_score", "perm_total", "trend", "freshness"
    )


_NOTE, _ADJUST = q.contradiction("signal", "perm_total", "trend")


@register("e4_contradiction", (["enriched"], f"""
    SELECT job_id, {_NOTE} AS note, {_ADJUST} AS adjustment FROM enriched"""))
def _(i):
    check = scoring.contradiction(F.col("signal"), F.col("perm_total"), F.col("trend"))
    return enriched(i).select("job_id", check.alias("c")).select("job_id", "c.note", "c.adjustment")


@register("e5_visa_confidence", (["enriched"], f"""
    SELECT job_id, round({q.clamp('base_score + signal_delta')}, 6) AS confidence FROM enriched"""))
def _(i):
    return enriched(i).select(
        "job_id", scoring.clamp(F.col("base_score") + F.col("signal_delta")).alias("confidence")
    )


@register("e6_audited_confidence", (["enriched"], f"""
    SELECT job_id, round({q.clamp(f'base_score + signal_delta + ({_ADJUST})')}, 6) AS confidence FROM enriched"""))
def _(i):
    check = scoring.contradiction(F.col("signal"), F.col("perm_total"), F.col("trend"))
    total = F.col("base_score") + F.col("signal_delta") + check["adjustment"]
    return enriched(i).select("job_id", scoring.clamp(total).alias("confidence"))


# --- scored rows -------------------------------------------------------------------

def _opening() -> str:
    fit = "CASE " + " ".join(f"WHEN match_score >= {v} THEN {q.quote(t)}" for v, t in K.FIT_LABELS) + f" ELSE {q.quote(K.FIT_WEAK)} END"
    return (
        f"{fit} || ' for ' || CASE WHEN len(target_roles) > 0 THEN array_to_string(target_roles, ', ')"
        " WHEN len(best_fit_roles) > 0 THEN array_to_string(best_fit_roles, ', ') ELSE 'your target role' END || '.'"
    )


_TOP = "array_to_string(matched_skills[1:5], ', ') || CASE WHEN len(matched_skills) > 5 THEN ', ...' ELSE '' END"
_TOTAL = "greatest(len(technical_skills), 1)"
_VISA = "CASE WHEN requires_sponsorship THEN {} END"
_LIBRARY = [
    _opening(),
    f"""CASE WHEN len(matched_skills) > 0 THEN len(matched_skills) || ' of your ' || {_TOTAL}
      || ' skills matched in the job description (' || {_TOP} || ').'
      ELSE 'None of your listed skills appeared directly in the job description.' END""",
    "CASE WHEN role_match THEN 'Job title aligns with your target roles.' END",
    """CASE WHEN location_match THEN 'Location matches your preferences.'
      WHEN contains(lower(location), 'remote') THEN 'Remote position.' END""",
    """CASE WHEN days < 0 THEN 'Posting date unknown.' WHEN days = 0 THEN 'Posted today.' WHEN days = 1 THEN 'Posted yesterday.'
      WHEN days <= 7 THEN 'Posted ' || days || ' days ago.'
      WHEN days <= 30 THEN 'Posted about ' || (days // 7) || CASE WHEN days // 7 > 1 THEN ' weeks' ELSE ' week' END || ' ago.'
      ELSE 'Posted ' || days || ' days ago — may be an older listing.' END""",
    _VISA.format(q.lookup("signal", K.LIBRARY_SIGNAL_TEXT, text=True)),
    _VISA.format("""CASE WHEN perm_total = 0 THEN 'No PERM sponsorship history found for this company.'
      WHEN perm_total < 5 THEN 'Company has minimal PERM history (' || perm_total || CASE WHEN perm_total <> 1 THEN ' certified cases).' ELSE ' certified case).' END
      WHEN perm_total < 20 THEN 'Company has filed ' || perm_total || ' PERM certifications (limited history).'
      WHEN perm_total < 100 THEN 'Company has ' || perm_total || ' PERM certifications on record.'
      ELSE 'Company has a strong PERM history (' || perm_total || '+ certifications).' END"""),
    _VISA.format(q.lookup("trend", K.LIBRARY_TREND_TEXT, text=True)),
]
_AUDIT = [
    _opening(),
    f"""CASE WHEN len(matched_skills) > 0 THEN len(matched_skills) || '/' || {_TOTAL} || ' skills matched (' || {_TOP} || ').'
      ELSE 'No listed skills found directly in job description.' END""",
    "CASE WHEN role_match THEN 'Job title aligns with target roles.' END",
    "CASE WHEN location_match OR contains(lower(location), 'remote') THEN 'Remote or preferred location.' END",
    """CASE WHEN days < 0 THEN 'Posting date unknown.' WHEN days = 0 THEN 'Posted today.' WHEN days = 1 THEN 'Posted yesterday.'
      WHEN days <= 7 THEN 'Posted ' || days || 'd ago.' WHEN days <= 30 THEN 'Posted ~' || (days // 7) || 'w ago.'
      ELSE 'Posted ' || days || 'd ago — may already be filled.' END""",
    _VISA.format(q.lookup("signal", K.AUDIT_SIGNAL_TEXT, text=True)),
    _VISA.format("""CASE WHEN perm_total = 0 THEN 'No PERM history found.'
      WHEN perm_total < 5 THEN 'Minimal PERM history (' || perm_total || ' cases).'
      WHEN perm_total < 20 THEN 'Limited PERM history (' || perm_total || ' certifications).'
      WHEN perm_total < 100 THEN perm_total || ' PERM certifications on record.'
      ELSE 'Strong PERM history (' || perm_total || '+ certifications).' END"""),
    _VISA.format(q.lookup("trend", K.AUDIT_TREND_TEXT, text=True)),
    _VISA.format(f"nullif({_NOTE}, '')"),
]


_FINAL = (
    "CASE WHEN requires_sponsorship THEN 0.40::DOUBLE * match_score + 0.35::DOUBLE * confidence + 0.25::DOUBLE * recency"
    " ELSE 0.70::DOUBLE * match_score + 0.30::DOUBLE * recency END"
)


def _scored(matches: str, audit: bool) -> tuple[list[str], str]:
    confidence = q.clamp(f"base_score + signal_delta + ({_ADJUST})" if audit else "base_score + signal_delta")
    reasoning = "concat_ws(' ', " + ", ".join(_AUDIT if audit else _LIBRARY) + ")"
    return [matches, "enriched", "candidates"], f"""
    SELECT candidate_id, job_id, company_slug, title, location, apply_url, posted_at, description_clean AS description_text,
      match_score, semantic_score, skill_overlap_score, role_match, location_match, matched_skills,
      recency AS recency_score, days AS days_since_posted, {q.round4('confidence')} AS visa_confidence,
      CASE WHEN requires_sponsorship THEN signal ELSE 'n/a' END AS sponsorship_signal,
      CASE WHEN requires_sponsorship THEN perm_total ELSE 0 END AS perm_filings_total,
      CASE WHEN requires_sponsorship THEN trend ELSE 'n/a' END AS sponsorship_trend,
      {q.round4(_FINAL)} AS final_score,
      {reasoning} AS reasoning, requires_sponsorship
    FROM (SELECT *, CASE WHEN requires_sponsorship THEN {confidence} END AS confidence, CAST({q.recency('days')} AS DOUBLE) AS recency
      FROM (SELECT *, {q.days_since('posted_at', POSTINGS_AS_OF)} AS days
        FROM {matches} JOIN enriched USING (job_id)
        JOIN (SELECT candidate_id, requires_sponsorship, technical_skills, target_roles, best_fit_roles FROM candidates) USING (candidate_id)))"""


DERIVED["scored_library"] = _scored("top20", False)
DERIVED["scored_audit"] = _scored("top150", True)
DERIVED["ranked"] = (["scored_audit"], """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
      ORDER BY final_score DESC, match_score DESC, job_id) AS rank FROM scored_audit) WHERE rank <= 30""")
_SCORED_OUT = ", ".join(q.joined(c) + f" AS {c}" if c == "matched_skills" else c for c in scoring.SCORED_COLUMNS)


def scored_library(i: Inputs) -> DataFrame:
    return ranking.score_given_matches(
        top20(i).drop("match_rank"), candidate_table(i), history_table(i), POSTINGS_AS_OF, jobs=index_table(i)
    )


def ranked(i: Inputs) -> DataFrame:
    return ranking.rank_profiles(candidate_table(i), index_table(i), history_table(i), POSTINGS_AS_OF)


def results(i: Inputs) -> DataFrame:
    """Ranked rows with the candidate's need, as the serving queries see them, without the text of their job, which the index holds once."""
    need = candidate_table(i).select("candidate_id", "requires_sponsorship")
    return stored(i, "ranked", lambda x: ranked(x).drop("description_text")).join(need, "candidate_id")


@register("e7_final_score", (["scored_library"], """
    SELECT candidate_id, job_id, visa_confidence, final_score FROM scored_library"""))
def _(i):
    return scored_library(i).select("candidate_id", "job_id", "visa_confidence", "final_score")


@register("e8_library_explanation", (["scored_library"], "SELECT candidate_id, job_id, reasoning FROM scored_library"))
def _(i):
    return scored_library(i).select("candidate_id", "job_id", "reasoning")


@register("e10_score_library", (["scored_library"], f"SELECT {_SCORED_OUT} FROM scored_library"))
def _(i):
    return scored_library(i)


@register("e9_audit_explanation", (["ranked"], "SELECT candidate_id, job_id, reasoning FROM ranked"))
def _(i):
    return ranked(i).select("candidate_id", "job_id", "reasoning")


@register("e11_score_audit", (["ranked"], f"SELECT {_SCORED_OUT}, rank FROM ranked"))
def _(i):
    return ranked(i)


@register("k2_top_ranked", (["ranked"], "SELECT candidate_id, job_id, final_score, rank FROM ranked"))
def _(i):
    return ranked(i).select("candidate_id", "job_id", "final_score", "rank")


@register("k6_top_skills", (["scored_library"], f"""
    SELECT candidate_id, job_id, {q.joined('matched_skills[1:5]')} AS top_skills FROM scored_library"""))
def _(i):
    return top20(i).select("candidate_id", "job_id", F.slice("matched_skills", 1, 5).alias("top_skills"))


@register("f9_domestic_skipped", (["ranked"], """
    SELECT requires_sponsorship, sponsorship_signal, visa_confidence IS NULL AS no_confidence, count(*) AS n
    FROM ranked GROUP BY ALL"""))
def _(i):
    return results(i).groupBy(
        "requires_sponsorship", "sponsorship_signal", F.col("visa_confidence").isNull().alias("no_confidence")
    ).agg(F.count("*").alias("n"))


@register("t7_rank_profiles", (["ranked"], f"SELECT {_SCORED_OUT}, rank FROM ranked"))
def _(i):
    return ranked(i)


@register("t6_rank_resumes", (["ranked"], f"SELECT {_SCORED_OUT}, rank FROM ranked"))
def _(i):
    return ranking.rank_resumes(
        i.resumes, i.user_inputs, i.candidate_vectors, index_table(i), history_table(i), POSTINGS_AS_OF
    )


# --- serving -----------------------------------------------------------------------

_BUCKET = """CASE WHEN NOT requires_sponsorship THEN 'not_needed'
  WHEN sponsorship_signal IN ('positive', 'likely_positive') OR (sponsorship_signal NOT IN ('negative', 'likely_negative')
    AND coalesce(visa_confidence, 0) >= 0.65) THEN 'likely'
  WHEN sponsorship_signal IN ('negative', 'likely_negative') THEN 'may_not' ELSE 'unknown' END"""


@register("e12_sponsor_bucket", (["ranked"], f"SELECT candidate_id, job_id, {_BUCKET} AS bucket FROM ranked"))
def _(i):
    bucket = scoring.sponsor_bucket(
        F.col("sponsorship_signal"), F.col("visa_confidence"), F.col("requires_sponsorship")
    )
    return results(i).select("candidate_id", "job_id", bucket.alias("bucket"))


@register("e13_badge", (["ranked"], """
    SELECT candidate_id, job_id, CASE WHEN NOT requires_sponsorship THEN 'domestic' WHEN visa_confidence IS NULL THEN 'unknown'
      WHEN sponsorship_signal = 'positive' THEN 'confirmed' WHEN sponsorship_signal = 'likely_positive' THEN 'suggested'
      WHEN sponsorship_signal = 'negative' THEN 'refused' WHEN sponsorship_signal = 'likely_negative' THEN 'authorization_required'
      WHEN visa_confidence >= 0.65 THEN 'history_likely' WHEN visa_confidence >= 0.45 THEN 'history_uncertain'
      ELSE 'history_unlikely' END AS badge FROM ranked"""))
def _(i):
    badge = scoring.badge(
        F.col("sponsorship_signal"), F.col("visa_confidence"), F.col("requires_sponsorship")
    )
    return results(i).select("candidate_id", "job_id", badge.alias("badge"))


@register("e14_score_band", (["ranked"], """
    SELECT candidate_id, job_id, CASE WHEN final_score >= 0.70 THEN 'high' WHEN final_score >= 0.45 THEN 'medium'
      ELSE 'low' END AS band FROM ranked"""))
def _(i):
    return results(i).select("candidate_id", "job_id", scoring.score_band(F.col("final_score")).alias("band"))


@register("f7_browse_filter", (["silver"], """
    SELECT job_id, company_slug, is_target_role FROM silver
    WHERE is_active AND regexp_matches(company_slug, '(?i)acme[0-9]*') AND is_target_role"""))
def _(i):
    jobs = serving.browse_filter(silver_table(i), company="acme[0-9]*", target_role=True)
    return jobs.select("job_id", "company_slug", "is_target_role")


@register("k4_page_slice", (["silver"], """
    SELECT job_id, company_slug, title, location, apply_url, posted_at, is_active, is_target_role,
      (SELECT count(*) FROM silver) AS total FROM silver ORDER BY job_id LIMIT 25 OFFSET 50"""))
def _(i):
    return serving.page_slice(silver_table(i), page=3)


@register("t5_browse_jobs", (["silver"], """
    SELECT job_id, company_slug, title, location, apply_url, posted_at, is_active, is_target_role,
      (SELECT count(*) FROM silver WHERE is_active) AS total FROM silver WHERE is_active ORDER BY job_id LIMIT 25"""))
def _(i):
    return serving.browse_jobs(silver_table(i))


@register("f8_result_filter", (["ranked"], f"""
    SELECT candidate_id, job_id, final_score FROM ranked
    WHERE (NOT requires_sponsorship OR ({_BUCKET}) = 'likely') AND role_match"""))
def _(i):
    rows = serving.filter_results(results(i), "likely", role_only=True)
    return rows.select("candidate_id", "job_id", "final_score")


@register("k3_user_sort", (["ranked"], """
    SELECT candidate_id, job_id, recency_score,
      row_number() OVER (PARTITION BY candidate_id ORDER BY recency_score DESC, rank) AS position FROM ranked"""))
def _(i):
    return serving.sort_results(results(i), "recency_score").select("candidate_id", "job_id", "recency_score", "position")


@register("g14_result_summary", (["ranked"], f"""
    SELECT candidate_id, count(*) AS total, round(avg(final_score), 6) AS avg_final_score,
      count(*) FILTER (WHERE bucket = 'likely') AS likely_sponsors,
      count(*) FILTER (WHERE bucket IN ('unknown', 'may_not')) AS unknown_or_at_risk,
      count(*) FILTER (WHERE role_match) AS role_matches, count(*) FILTER (WHERE location_match) AS location_matches
    FROM (SELECT *, {_BUCKET} AS bucket FROM ranked) GROUP BY ALL"""))
def _(i):
    return serving.result_summary(results(i))


# --- refresh -----------------------------------------------------------------------

DERIVED["refreshed"] = (["chosen"], f"""
    SELECT * FROM chosen WHERE {q.us_location('location')}""")
_TIES = ["source_ats", "company_slug", "apply_url", "departments", "is_target_role", "location", "posted_at", "title"]
DERIVED["refreshed_jobs"] = (["refreshed"], f"""
    SELECT job_id, arg_max(title, k) FILTER (WHERE title IS NOT NULL) AS title,
      arg_max(is_target_role, k) FILTER (WHERE is_target_role IS NOT NULL) AS is_target_role,
      arg_max(company_slug, k) FILTER (WHERE company_slug IS NOT NULL) AS company_slug,
      arg_max(source_ats, k) FILTER (WHERE source_ats IS NOT NULL) AS source_ats, max(scraped_at) AS last
    FROM (SELECT *, strftime(scraped_at, '%Y%m%d%H%M%S') || lpad(CAST(CAST('0x' || substr(
      md5(array_to_string([{', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _TIES)}], chr(31))), 1, 15) AS BIGINT) AS VARCHAR), 19, '0') AS k
      FROM refreshed) GROUP BY job_id""")


@register("t9_refresh", (["refreshed", "refreshed_jobs", "history"], f"""
    SELECT 'bronze' AS table_name, job_id AS key, company_slug || '|' || source_ats || '|' || {q.ts('scraped_at')} AS detail FROM refreshed UNION ALL
    SELECT 'csv', job_id, company_slug || '|' || source_ats || '|' || coalesce(title, '') FROM refreshed UNION ALL
    SELECT 'jobs', job_id, concat_ws('|', title, is_target_role, company_slug, source_ats, {q.ts('last')}) FROM refreshed_jobs UNION ALL
    SELECT 'sponsorship', company_name_norm, CAST(total_perm_certified AS VARCHAR) FROM history UNION ALL
    SELECT 'index', job_id, company_slug FROM refreshed_jobs WHERE is_target_role UNION ALL
    SELECT 'manifest', strftime(scraped_at, '%Y-%m-%d'), CAST(count(*) AS VARCHAR) FROM refreshed GROUP BY scraped_at"""))
def _(i):
    """Runs twice; the second run has to leave all tables as they are."""
    vectors = i.job_vectors.withColumn("job_id", F.substring("job_id", 2, 100))
    out = scratch_path(i.spark, "refresh")
    for _ in range(2):
        paths = refresh(
            i.spark, raw_postings(i), i.companies, [i.perm_old, i.perm_new], uscis_raw(i), vectors, out, POSTINGS_AS_OF, FILINGS_AS_OF,
        )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    joined = lambda *cols: F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols])
    bronze = readers.read_bronze(i.spark, paths["bronze"] + "/json")
    reduced = T.StructType([f for f in T.StructType.fromDDL(S.JOBS_BRONZE).fields if f.name not in ("raw_json", "description_html")])
    sheet = readers.read_csv_table(i.spark, paths["bronze"] + "/csv", reduced)
    jobs, history, index = (i.spark.read.parquet(paths[n]) for n in ("jobs", "sponsorship", "index"))
    manifest = i.spark.read.schema(S.RUN_MANIFEST).json(paths["bronze"] + "/manifest")
    parts = [
        ("bronze", bronze, "job_id", joined("company_slug", "source_ats", stamp("scraped_at"))),
        ("csv", sheet, "job_id", joined("company_slug", "source_ats", F.coalesce("title", F.lit("")))),
        ("jobs", jobs, "job_id", joined("title", F.col("is_target_role").cast("string"), "company_slug", "source_ats", stamp("last_seen"))),
        ("sponsorship", history, "company_name_norm", F.col("total_perm_certified").cast("string")),
        ("index", index, "job_id", F.col("company_slug")),
        ("manifest", manifest, "run_date", F.col("total_jobs").cast("string")),
    ]
    rows = [df.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), detail.alias("detail")) for name, df, key, detail in parts]
    table = rows[0]
    for part in rows[1:]:
        table = table.unionByName(part)
    return table
