"""Employer base score, contradiction check, visa confidence, final score, explanations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane.functions import dates
from hireplane.functions.numbers import round4
from hireplane.functions.signals import by_label, signal_delta, sponsorship_signal


def clamp(col: Column) -> Column:
    return F.greatest(F.lit(K.CONFIDENCE_FLOOR), F.least(F.lit(K.CONFIDENCE_CEIL), col))


def employer_base(certified: Column, petitions: Column, trend: Column, freshness: Column) -> Column:
    """Filing volume, trend and freshness as one score; missing freshness counts as 0."""
    volume = F.greatest(F.coalesce(certified, F.lit(0)), F.coalesce(petitions, F.lit(0)))
    band = None
    for limit, value in K.VOLUME_BANDS:
        band = F.when(volume >= limit, value) if band is None else band.when(volume >= limit, value)
    band = band.otherwise(K.VOLUME_NONE)
    adjusted = band + by_label(trend, K.TREND_ADJUSTMENT, 0.0)
    return clamp(adjusted * (F.lit(0.45) + F.lit(0.55) * F.coalesce(freshness, F.lit(0.0))))


def contradiction(signal: Column, perm_total: Column, trend: Column) -> Column:
    """Struct of note and adjustment; the first rule that applies wins."""
    def outcome(note: str, adjustment: float) -> Column:
        return F.struct(F.lit(note).alias("note"), F.lit(adjustment).alias("adjustment"))

    notes = K.CONTRADICTION_NOTES
    return (
        F.when((signal == "positive") & (perm_total == 0), outcome(notes["no_history"], -0.10))
        .when((signal == "negative") & (perm_total >= 100), outcome(notes["strong_history"], 0.05))
        .when(
            signal.isin("positive", "likely_positive") & (trend == "decreasing_sharply"),
            outcome(notes["dropped"], -0.08),
        )
        .when((signal == "negative") & (trend == "increasing"), outcome(notes["increasing"], 0.0))
        .otherwise(outcome("", 0.0))
    )


def final_score(match: Column, visa: Column, recency: Column, international: Column) -> Column:
    return round4(
        F.when(
            international,
            K.W_INT_MATCH * match + K.W_INT_VISA * visa + K.W_INT_RECENCY * recency,
        ).otherwise(K.W_DOM_MATCH * match + K.W_DOM_RECENCY * recency)
    )


def with_signals(jobs: DataFrame, text_column: str = "description_text", negation_guard: bool = False) -> DataFrame:
    """Sponsorship signal and its score change, once per row of ``jobs``."""
    return jobs.withColumn(
        "signal", sponsorship_signal(F.col(text_column), negation_guard)
    ).withColumn("signal_delta", signal_delta(F.col("signal")))


def with_evidence(jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Attach the evidence of each row's employer (one row per slug)."""
    return (
        jobs.join(evidence, "company_slug", "left")
        .withColumn("base_score", F.coalesce("base_score", F.lit(K.UNKNOWN_EMPLOYER_BASE)))
        .withColumn("perm_total", F.coalesce("perm_total", F.lit(0)))
        .withColumn("trend", F.coalesce("trend", F.lit("unknown")))
        .withColumn("freshness", F.coalesce("freshness", F.lit(0.0)))
    )


def _text(col: Column) -> Column:
    return col.cast("string")


def _fit(match: Column) -> Column:
    out = None
    for limit, label in K.FIT_LABELS:
        out = F.when(match >= limit, label) if out is None else out.when(match >= limit, label)
    return out.otherwise(K.FIT_WEAK)


def _opening(match: Column, target: Column, best_fit: Column) -> Column:
    roles = (
        F.when(F.size(target) > 0, F.array_join(target, ", "))
        .when(F.size(best_fit) > 0, F.array_join(best_fit, ", "))
        .otherwise("your target role")
    )
    return F.concat(_fit(match), F.lit(" for "), roles, F.lit("."))


def _top_skills(matched: Column) -> Column:
    return F.concat(
        F.array_join(F.slice(matched, 1, 5), ", "), F.when(F.size(matched) > 5, ", ...").otherwise("")
    )


def library_explanation() -> Column:
    """Long wording. Reads the columns of a scored row."""
    matched, days = F.col("matched_skills"), F.col("days_since_posted")
    n_matched, n_total = F.size(matched), F.greatest(F.size("technical_skills"), F.lit(1))
    perm, weeks = F.col("perm_total"), F.floor(days / 7)
    visa = F.col("requires_sponsorship")
    posted = (
        F.when(days < 0, "Posting date unknown.")
        .when(days == 0, "Posted today.")
        .when(days == 1, "Posted yesterday.")
        .when(days <= 7, F.concat(F.lit("Posted "), _text(days), F.lit(" days ago.")))
        .when(
            days <= 30,
            F.concat(
                F.lit("Posted about "), _text(weeks), F.when(weeks > 1, " weeks").otherwise(" week"),
                F.lit(" ago."),
            ),
        )
        .otherwise(
            F.concat(F.lit("Posted "), _text(days), F.lit(" days ago — may be an older listing."))
        )
    )
    history = (
        F.when(perm == 0, "No PERM sponsorship history found for this company.")
        .when(
            perm < 5,
            F.concat(
                F.lit("Company has minimal PERM history ("), _text(perm),
                F.when(perm != 1, " certified cases).").otherwise(" certified case)."),
            ),
        )
        .when(
            perm < 20,
            F.concat(
                F.lit("Company has filed "), _text(perm),
                F.lit(" PERM certifications (limited history)."),
            ),
        )
        .when(
            perm < 100,
            F.concat(F.lit("Company has "), _text(perm), F.lit(" PERM certifications on record.")),
        )
        .otherwise(
            F.concat(
                F.lit("Company has a strong PERM history ("), _text(perm), F.lit("+ certifications).")
            )
        )
    )
    return F.concat_ws(
        " ",
        _opening(F.col("match_score"), F.col("target_roles"), F.col("best_fit_roles")),
        F.when(
            n_matched > 0,
            F.concat(
                _text(n_matched), F.lit(" of your "), _text(n_total),
                F.lit(" skills matched in the job description ("), _top_skills(matched), F.lit(")."),
            ),
        ).otherwise("None of your listed skills appeared directly in the job description."),
        F.when(F.col("role_match"), "Job title aligns with your target roles."),
        F.when(F.col("location_match"), "Location matches your preferences.").when(
            F.contains(F.lower("location"), F.lit("remote")), "Remote position."
        ),
        posted,
        F.when(visa, by_label(F.col("signal"), K.LIBRARY_SIGNAL_TEXT)),
        F.when(visa, history),
        F.when(visa, by_label(F.col("trend"), K.LIBRARY_TREND_TEXT)),
    )


def audit_explanation() -> Column:
    """Short wording, with the contradiction note. Reads the columns of a scored row."""
    matched, days = F.col("matched_skills"), F.col("days_since_posted")
    n_matched, n_total = F.size(matched), F.greatest(F.size("technical_skills"), F.lit(1))
    perm, visa = F.col("perm_total"), F.col("requires_sponsorship")
    posted = (
        F.when(days < 0, "Posting date unknown.")
        .when(days == 0, "Posted today.")
        .when(days == 1, "Posted yesterday.")
        .when(days <= 7, F.concat(F.lit("Posted "), _text(days), F.lit("d ago.")))
        .when(days <= 30, F.concat(F.lit("Posted ~"), _text(F.floor(days / 7)), F.lit("w ago.")))
        .otherwise(F.concat(F.lit("Posted "), _text(days), F.lit("d ago — may already be filled.")))
    )
    history = (
        F.when(perm == 0, "No PERM history found.")
        .when(perm < 5, F.concat(F.lit("Minimal PERM history ("), _text(perm), F.lit(" cases).")))
        .when(perm < 20, F.concat(F.lit("Limited PERM history ("), _text(perm), F.lit(" certifications).")))
        .when(perm < 100, F.concat(_text(perm), F.lit(" PERM certifications on record.")))
        .otherwise(F.concat(F.lit("Strong PERM history ("), _text(perm), F.lit("+ certifications).")))
    )
    return F.concat_ws(
        " ",
        _opening(F.col("match_score"), F.col("target_roles"), F.col("best_fit_roles")),
        F.when(
            n_matched > 0,
            F.concat(
                _text(n_matched), F.lit("/"), _text(n_total), F.lit(" skills matched ("),
                _top_skills(matched), F.lit(")."),
            ),
        ).otherwise("No listed skills found directly in job description."),
        F.when(F.col("role_match"), "Job title aligns with target roles."),
        F.when(
            F.col("location_match") | F.contains(F.lower("location"), F.lit("remote")),
            "Remote or preferred location.",
        ),
        posted,
        F.when(visa, by_label(F.col("signal"), K.AUDIT_SIGNAL_TEXT)),
        F.when(visa, history),
        F.when(visa, by_label(F.col("trend"), K.AUDIT_TREND_TEXT)),
        F.when(visa & (F.col("contradiction.note") != ""), F.col("contradiction.note")),
    )


SCORED_COLUMNS = [
    "candidate_id", "job_id", "company_slug", "title", "location", "apply_url", "posted_at",
    "description_text", "match_score", "semantic_score", "skill_overlap_score", "role_match",
    "location_match", "matched_skills", "recency_score", "days_since_posted", "visa_confidence",
    "sponsorship_signal", "perm_filings_total", "sponsorship_trend", "final_score", "reasoning",
]


def add_scores(rows: DataFrame, as_of: datetime | str, audit: bool = True) -> DataFrame:
    """Recency, confidence and final score.

    Needs posted_at, match_score, signal, signal_delta, base_score, perm_total,
    trend and requires_sponsorship; no text column is touched. ``audit`` checks
    signals against the filing history.
    """
    visa = F.col("requires_sponsorship")
    rows = rows.withColumn("days_since_posted", dates.days_since(F.col("posted_at"), as_of))
    rows = rows.withColumn("recency_score", dates.recency(F.col("days_since_posted")))
    confidence = F.col("base_score") + F.col("signal_delta")
    if audit:
        rows = rows.withColumn(
            "contradiction", contradiction(F.col("signal"), F.col("perm_total"), F.col("trend"))
        )
        confidence = confidence + F.col("contradiction.adjustment")
    rows = rows.withColumn("raw_confidence", F.when(visa, clamp(confidence)))
    return rows.withColumn(
        "final_score",
        final_score(F.col("match_score"), F.col("raw_confidence"), F.col("recency_score"), visa),
    )


def present(rows: DataFrame, audit: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Output columns and explanation of scored rows joined with job and candidate columns.

    Candidates who need no sponsorship get NULL confidence and 'n/a' labels.
    """
    visa = F.col("requires_sponsorship")
    explanation = audit_explanation() if audit else library_explanation()
    return rows.select(
        *SCORED_COLUMNS[:14],
        "recency_score", "days_since_posted",
        round4(F.col("raw_confidence")).alias("visa_confidence"),
        F.when(visa, F.col("signal")).otherwise("n/a").alias("sponsorship_signal"),
        F.when(visa, F.col("perm_total")).otherwise(F.lit(0)).alias("perm_filings_total"),
        F.when(visa, F.col("trend")).otherwise("n/a").alias("sponsorship_trend"),
        "final_score",
        explanation.alias("reasoning"),
        *extra,
    )


def score_matches(
    matches: DataFrame, profiles: DataFrame, as_of: datetime | str, audit: bool = True, texts: DataFrame | None = None,
) -> DataFrame:
    """Scored and explained rows from matches that carry signal and evidence columns; ``texts`` (job_id, description_text) come in last."""
    asked = profiles.select(
        "candidate_id", "requires_sponsorship", "technical_skills", "target_roles", "best_fit_roles"
    )
    scored = add_scores(matches.join(asked, "candidate_id"), as_of, audit)
    return present(scored if texts is None else scored.join(texts, "job_id"), audit)


def top_ranked(scored: DataFrame, top_n: int = 30) -> DataFrame:
    """The best ``top_n`` rows per candidate."""
    w = Window.partitionBy("candidate_id").orderBy(
        F.desc("final_score"), F.desc("match_score"), "job_id"
    )
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def sponsor_bucket(signal: Column, confidence: Column, requires: Column) -> Column:
    negative = signal.isin("negative", "likely_negative")
    likely = signal.isin("positive", "likely_positive") | (
        ~negative & (F.coalesce(confidence, F.lit(0.0)) >= K.LIKELY_SPONSOR_CONFIDENCE)
    )
    return (
        F.when(~requires, "not_needed")
        .when(likely, "likely")
        .when(negative, "may_not")
        .otherwise("unknown")
    )


def badge(signal: Column, confidence: Column, requires: Column) -> Column:
    return (
        F.when(~requires, "domestic")
        .when(confidence.isNull(), "unknown")
        .when(signal == "positive", "confirmed")
        .when(signal == "likely_positive", "suggested")
        .when(signal == "negative", "refused")
        .when(signal == "likely_negative", "authorization_required")
        .when(confidence >= 0.65, "history_likely")
        .when(confidence >= 0.45, "history_uncertain")
        .otherwise("history_unlikely")
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 0.70, "high").when(score >= 0.45, "medium").otherwise("low")
