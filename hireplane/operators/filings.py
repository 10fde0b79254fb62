"""Labour-certification cases and petition counts to one history row per employer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane.functions import dates, text
from hireplane.session import stored

EMPLOYER = "company_name_norm"


def perm_cases(raw: DataFrame) -> DataFrame:
    """One file's rows in canonical columns; the header tells the layout."""
    mapping = K.PERM_NEW_COLUMNS if K.PERM_NEW_HEADER in raw.columns else K.PERM_OLD_COLUMNS
    columns = [
        (F.col(source).cast("string") if source in raw.columns else F.lit(None).cast("string")).alias(name)
        for name, source in mapping.items()
    ]
    cases = raw.select(
        *columns,
        F.col("CASE_STATUS").alias("case_status"),
        dates.lenient_timestamp(F.col("DECISION_DATE")).alias("decision_date"),
        F.col("JOB_TITLE").alias("job_title"),
    )
    named = text.computed_once(cases, EMPLOYER, text.normalize_company(F.col("company_name")))
    return named.filter(F.col(EMPLOYER) != "").select(
        EMPLOYER,
        F.col("company_name").alias("company_name_raw"),
        "state", "naics", "fein", "case_status", "decision_date", "job_title",
        dates.fiscal_year(F.col("decision_date")).alias("fiscal_year"),
        F.coalesce(F.col("case_status").isin(K.APPROVED_STATUSES), F.lit(False)).alias("is_approved"),
        F.coalesce(F.col("case_status").isin(K.DENIED_STATUSES), F.lit(False)).alias("is_denied"),
    )


def union_cases(parts: list[DataFrame]) -> DataFrame:
    out = perm_cases(parts[0])
    for part in parts[1:]:
        out = out.unionByName(perm_cases(part))
    return out


def yearly_counts(cases: DataFrame) -> DataFrame:
    return (
        cases.filter(F.col("fiscal_year").isNotNull())
        .groupBy(EMPLOYER, "fiscal_year")
        .agg(F.count_if("is_approved").alias("certified"), F.count_if("is_denied").alias("denied"))
    )


def year_map(yearly: DataFrame) -> DataFrame:
    """Year to counts, as a map; one entry per fiscal year of an employer."""
    entry = F.struct(
        F.col("fiscal_year").cast("string").alias("key"),
        F.struct("certified", "denied").alias("value"),
    )
    return yearly.groupBy(EMPLOYER).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("perm_by_year")
    )


def compact_cases(cases: DataFrame) -> DataFrame:
    """Counts per (employer, year, name, state, industry code), then laid out by employer.

    The first, finest grouping has no hot key and combines before its shuffle.
    After it the rows are few, and later groupings by employer combine most of
    them before their shuffle, as they are laid out by it.
    """
    return (
        cases.groupBy(EMPLOYER, "fiscal_year", "company_name_raw", "state", "naics")
        .agg(
            F.count("*").alias("n"),
            F.count_if("is_approved").alias("certified"),
            F.count_if("is_denied").alias("denied"),
            F.max("decision_date").alias("last_date"),
        )
        .repartition(EMPLOYER)
    )


def most_common(compact: DataFrame, names: list[str]) -> DataFrame:
    """Most frequent non-null value per attribute; the smallest wins a tie."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("value")) for c in names])
    counted = (
        compact.select(EMPLOYER, "n", F.explode(pairs).alias("p"))
        .select(EMPLOYER, "n", "p.attr", "p.value")
        .filter("value IS NOT NULL")
        .groupBy(EMPLOYER, "attr", "value")
        .agg(F.sum("n").alias("n"))
    )
    best = F.struct((-F.col("n")).alias("neg"), "value")
    return counted.groupBy(EMPLOYER).agg(
        *[F.min(F.when(F.col("attr") == c, best))["value"].alias(c) for c in names]
    )


def trend_label(n_years, recent_avg, older_avg):
    """Order of the rules matters; no recent year counts as an average of 0."""
    recent = F.coalesce(recent_avg, F.lit(0.0))
    ratio = F.try_divide(recent, older_avg)
    return (
        F.when((n_years < 3) | older_avg.isNull(), "insufficient_data")
        .when((older_avg == 0) & (recent > 0), "increasing")
        .when(older_avg == 0, "insufficient_data")
        .when(ratio >= 1.2, "increasing")
        .when(ratio <= 0.4, "decreasing_sharply")
        .when(ratio <= 0.75, "decreasing")
        .otherwise("stable")
    )


def trends(yearly: DataFrame, current_fy: int, recent_years: int = K.RECENT_YEARS) -> DataFrame:
    cutoff = current_fy - recent_years
    fy, n = F.col("fiscal_year"), F.col("certified")
    return yearly.groupBy(EMPLOYER).agg(
        trend_label(
            F.count("fiscal_year"), F.avg(F.when(fy > cutoff, n)), F.avg(F.when(fy <= cutoff, n))
        ).alias("trend_direction")
    )


def perm_history(
    cases: DataFrame, as_of: datetime | str, recent_years: int = K.RECENT_YEARS
) -> DataFrame:
    """One row per employer from case rows."""
    current_fy = dates.current_fiscal_year(as_of)
    cutoff = current_fy - recent_years
    # Written, as two aggregations read it: planned twice, each would read and shuffle all cases.
    compact = stored(compact_cases(cases), "cases")

    by_year = compact.groupBy(EMPLOYER, "fiscal_year").agg(
        F.sum("certified").alias("certified"), F.sum("denied").alias("denied"),
        F.max("last_date").alias("last_date"),
    )
    fy, certified, denied = F.col("fiscal_year"), F.col("certified"), F.col("denied")
    entry = F.struct(
        fy.cast("string").alias("key"), F.struct("certified", "denied").alias("value")
    )
    totals = by_year.groupBy(EMPLOYER).agg(
        F.sum("certified").alias("total_perm_certified"),
        F.sum("denied").alias("total_perm_denied"),
        F.max("last_date").alias("last_perm_date"),
        F.coalesce(F.sum(F.when(fy > cutoff, certified)), F.lit(0)).alias("recent_perm_certified"),
        F.coalesce(F.sum(F.when(fy > cutoff, denied)), F.lit(0)).alias("recent_perm_denied"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(fy.isNotNull(), entry)))
        ).alias("perm_by_year"),
        trend_label(
            F.count("fiscal_year"),
            F.avg(F.when(fy > cutoff, certified)), F.avg(F.when(fy <= cutoff, certified)),
        ).alias("trend_direction"),
    )
    modes = most_common(compact, ["company_name_raw", "state", "naics"])
    total = F.col("total_perm_certified") + F.col("total_perm_denied")
    recent = F.col("recent_perm_certified") + F.col("recent_perm_denied")
    return totals.join(modes, EMPLOYER, "left").select(
        EMPLOYER, "total_perm_certified", "total_perm_denied", "last_perm_date",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("company_name_raw", "state", "naics")],
        "perm_by_year", "recent_perm_certified", "recent_perm_denied",
        approval_rate(F.col("total_perm_certified"), total).alias("perm_approval_rate"),
        approval_rate(F.col("recent_perm_certified"), recent).alias("recent_approval_rate"),
        "trend_direction",
        dates.freshness(F.col("last_perm_date"), current_fy).alias("data_freshness_score"),
    )


def approval_rate(certified, decided):
    """NULL where nothing was decided."""
    return F.try_divide(certified, decided)


def uscis_totals(raw: DataFrame) -> DataFrame:
    """Petition counts per employer over all years; headers may be padded."""
    raw = raw.toDF(*[c.strip() for c in raw.columns])

    def row_total(outcome: str):
        present = [f"{k} {outcome}" for k in K.USCIS_KINDS if f"{k} {outcome}" in raw.columns]
        total = F.lit(0).cast("bigint")
        for name in present:
            total = total + F.coalesce(F.col(f"`{name}`").try_cast("double"), F.lit(0.0)).cast("bigint")
        return total

    # Sums per written name first: names are normalised once each, not once per row.
    written = (
        raw.select(
            F.col(f"`{K.USCIS_NAME}`").alias("name"),
            F.col(f"`{K.USCIS_YEAR}`").try_cast("double").cast("int").alias("fiscal_year"),
            row_total("Approval").alias("approvals"),
            row_total("Denial").alias("denials"),
        )
        .groupBy("name")
        .agg(
            F.sum("approvals").alias("approvals"), F.sum("denials").alias("denials"),
            F.max("fiscal_year").alias("fiscal_year"),
        )
    )
    named = text.computed_once(written, EMPLOYER, text.normalize_company(F.col("name")))
    return named.filter(F.col(EMPLOYER) != "").groupBy(EMPLOYER).agg(
        F.sum("approvals").alias("uscis_total_approvals"),
        F.sum("denials").alias("uscis_total_denials"),
        F.max("fiscal_year").alias("uscis_last_fiscal_year"),
    )


# --- fixed values: counts that are 0 for an employer known to one source only
COUNT_COLUMNS = [
    "uscis_total_approvals", "uscis_total_denials", "total_perm_certified", "total_perm_denied",
    "recent_perm_certified", "recent_perm_denied",
]


def merge_sources(perm: DataFrame, uscis: DataFrame) -> DataFrame:
    return perm.join(uscis, EMPLOYER, "full").fillna(0, subset=COUNT_COLUMNS)


def sponsorship_history(cases: DataFrame, uscis_raw: DataFrame, as_of: datetime | str) -> DataFrame:
    return merge_sources(perm_history(cases, as_of), uscis_totals(uscis_raw))


def by_volume(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc_nulls_last("total_perm_certified"), EMPLOYER)
