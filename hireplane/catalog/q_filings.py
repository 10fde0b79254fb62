"""Queries over filings: cases, petitions, employer history and employer lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane.catalog import sqltext as q
from hireplane.catalog.bindings import FILINGS_AS_OF, Inputs
from hireplane.catalog.registry import DERIVED, register, stored
from hireplane.functions import dates, text
from hireplane.operators import filings, resolve, serving
from hireplane.operators.employer_index import EmployerIndex, write_index
from hireplane.operators.filings import EMPLOYER
from hireplane.session import scratch_path
from hireplane.sources import readers, writers

FY = dates.current_fiscal_year(FILINGS_AS_OF)
CUTOFF = FY - K.RECENT_YEARS
N = EMPLOYER


def cases(i: Inputs) -> DataFrame:
    return filings.union_cases([i.perm_old, i.perm_new])


def uscis_raw(i: Inputs) -> DataFrame:
    """Petition rows under their published headers, some padded as in the files."""
    names = [f"{k} Approval" for k in K.USCIS_KINDS] + [f" {k} Denial " for k in K.USCIS_KINDS]
    columns = [f"a{j}" for j in range(6)] + [f"d{j}" for j in range(6)]
    return i.uscis_rows.select(
        F.col("employer").alias(K.USCIS_NAME), F.col("fiscal_year").alias(K.USCIS_YEAR + " "),
        *[F.col(c).alias(n) for c, n in zip(columns, names)],
    )


def history(i: Inputs) -> DataFrame:
    return filings.sponsorship_history(cases(i), uscis_raw(i), FILINGS_AS_OF)


def history_table(i: Inputs) -> DataFrame:
    return stored(i, "history", history)


_CASE = f"""
    SELECT {q.employer('EMPLOYER_NAME')} AS {N}, EMPLOYER_NAME AS company_name_raw,
      EMPLOYER_STATE_PROVINCE AS state, NAICS_CODE AS naics, CAST(NULL AS VARCHAR) AS fein,
      CASE_STATUS AS case_status, DECISION_DATE AS decision_date, JOB_TITLE AS job_title FROM perm_old
    UNION ALL
    SELECT {q.employer('EMP_BUSINESS_NAME')}, EMP_BUSINESS_NAME, EMP_STATE, EMP_NAICS, EMP_FEIN,
      CASE_STATUS, DECISION_DATE, JOB_TITLE FROM perm_new"""
DERIVED["cases"] = (["perm_old", "perm_new"], f"""
    SELECT *, {q.fiscal_year('decision_date')} AS fiscal_year,
      case_status IN ('Certified', 'Certified-Expired') AS is_approved, case_status = 'Denied' AS is_denied
    FROM ({_CASE}) WHERE {N} <> ''""")
_CASE_OUT = (
    f"{N}, company_name_raw, state, naics, fein, case_status, strftime(decision_date, '%Y-%m-%d %H:%M:%S')"
    " AS decision_date, job_title, fiscal_year, is_approved, is_denied"
)
DERIVED["yearly"] = (["cases"], f"""
    SELECT {N}, fiscal_year, count(*) FILTER (WHERE is_approved) AS certified,
      count(*) FILTER (WHERE is_denied) AS denied
    FROM cases WHERE fiscal_year IS NOT NULL GROUP BY ALL""")
DERIVED["year_maps"] = (["yearly"], f"""
    SELECT {N}, '{{' || string_agg('"' || fiscal_year || '":{{"certified":' || certified || ',"denied":' || denied || '}}',
      ',' ORDER BY fiscal_year) || '}}' AS perm_by_year FROM yearly GROUP BY ALL""")
DERIVED["totals"] = (["cases"], f"""
    SELECT {N}, count(*) FILTER (WHERE is_approved) AS total_perm_certified,
      count(*) FILTER (WHERE is_denied) AS total_perm_denied, max(decision_date) AS last_perm_date,
      count(*) FILTER (WHERE is_approved AND fiscal_year > {CUTOFF}) AS recent_perm_certified,
      count(*) FILTER (WHERE is_denied AND fiscal_year > {CUTOFF}) AS recent_perm_denied
    FROM cases GROUP BY ALL""")


def _mode(column: str) -> str:
    return f"""SELECT {N}, {column} FROM (
        SELECT {N}, {column}, row_number() OVER (PARTITION BY {N} ORDER BY count(*) DESC, {column}) AS rn
        FROM cases WHERE {column} IS NOT NULL GROUP BY {N}, {column}) WHERE rn = 1"""


for _c in ("company_name_raw", "state", "naics"):
    DERIVED[f"mode_{_c}"] = (["cases"], _mode(_c))
DERIVED["trends"] = (["yearly"], f"""
    SELECT {N}, CASE WHEN n < 3 OR older IS NULL THEN 'insufficient_data'
        WHEN older = 0 THEN CASE WHEN recent > 0 THEN 'increasing' ELSE 'insufficient_data' END
        WHEN recent / older >= 1.2 THEN 'increasing' WHEN recent / older <= 0.4 THEN 'decreasing_sharply'
        WHEN recent / older <= 0.75 THEN 'decreasing' ELSE 'stable' END AS trend_direction
    FROM (SELECT {N}, count(*) AS n, coalesce(avg(certified) FILTER (WHERE fiscal_year > {CUTOFF}), 0.0::DOUBLE) AS recent,
        avg(certified) FILTER (WHERE fiscal_year <= {CUTOFF}) AS older FROM yearly GROUP BY ALL)""")
_FRESH = (
    "CASE WHEN last_perm_date IS NULL THEN 0.0 ELSE "
    + q.steps(f"({FY} - {q.fiscal_year('last_perm_date')})", K.FRESHNESS_STEPS, K.FRESHNESS_OLD) + " END"
)


def _rate(c: str, d: str) -> str:
    return f"CASE WHEN {c} + {d} > 0 THEN CAST({c} AS DOUBLE) / ({c} + {d}) END"


DERIVED["perm_history"] = (
    ["totals", "year_maps", "trends", "mode_company_name_raw", "mode_state", "mode_naics"], f"""
    SELECT t.*, coalesce(r.company_name_raw, '') AS company_name_raw, coalesce(s.state, '') AS state,
      coalesce(i.naics, '') AS naics, coalesce(y.perm_by_year, '{{}}') AS perm_by_year,
      {_rate('t.total_perm_certified', 't.total_perm_denied')} AS perm_approval_rate,
      {_rate('t.recent_perm_certified', 't.recent_perm_denied')} AS recent_approval_rate,
      coalesce(x.trend_direction, 'insufficient_data') AS trend_direction, CAST({_FRESH} AS DOUBLE) AS data_freshness_score
    FROM totals t LEFT JOIN year_maps y USING ({N}) LEFT JOIN trends x USING ({N})
    LEFT JOIN mode_company_name_raw r USING ({N}) LEFT JOIN mode_state s USING ({N})
    LEFT JOIN mode_naics i USING ({N})""")
DERIVED["uscis_totals"] = (["uscis_rows"], f"""
    SELECT {q.employer('employer')} AS {N},
      CAST(sum({' + '.join(f'coalesce(a{j}, 0)' for j in range(6))}) AS BIGINT) AS uscis_total_approvals,
      CAST(sum({' + '.join(f'coalesce(d{j}, 0)' for j in range(6))}) AS BIGINT) AS uscis_total_denials,
      max(try_cast(fiscal_year AS INTEGER)) AS uscis_last_fiscal_year
    FROM uscis_rows GROUP BY ALL HAVING {q.employer('employer')} <> ''""".replace(
    "GROUP BY ALL HAVING " + q.employer("employer") + " <> ''", "WHERE " + q.employer("employer") + " <> '' GROUP BY 1"))
_COUNTS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in filings.COUNT_COLUMNS)
DERIVED["history"] = (["perm_history", "uscis_totals"], f"""
    SELECT {N}, {_COUNTS}, last_perm_date, company_name_raw, state, naics, perm_by_year,
      perm_approval_rate, recent_approval_rate, trend_direction, data_freshness_score, uscis_last_fiscal_year
    FROM perm_history FULL JOIN uscis_totals USING ({N})""")
_PERM_OUT = (
    "* REPLACE (strftime(last_perm_date, '%Y-%m-%d %H:%M:%S') AS last_perm_date,"
    " round(perm_approval_rate, 6) AS perm_approval_rate, round(recent_approval_rate, 6) AS recent_approval_rate)"
)


# --- sources ------------------------------------------------------------------

@register("s2_perm_files", (["cases"], f"SELECT {_CASE_OUT} FROM cases"))
def _(i):
    path = scratch_path(i.spark, "perm")
    i.perm_old.write.parquet(f"{path}/old")
    i.perm_new.write.parquet(f"{path}/new")
    return readers.read_perm(i.spark, [f"{path}/old", f"{path}/new"])


_KINDS = [f'"{k}"' for k in K.USCIS_KINDS]


@register("s3_uscis_file", (["uscis_rows"], """
    SELECT employer, fiscal_year, count(*) AS n, CAST(sum(coalesce(a0, 0)) AS BIGINT) AS new_approvals,
      CAST(sum(coalesce(d5, 0)) AS BIGINT) AS amended_denials FROM uscis_rows GROUP BY ALL"""))
def _(i):
    path = scratch_path(i.spark, "uscis")
    uscis_raw(i).write.option("header", True).csv(path, sep="\t", encoding="UTF-16")
    rows = readers.read_uscis(i.spark, path)
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0)))
    return rows.groupBy(
        F.col(f"`{K.USCIS_NAME}`").alias("employer"), F.col(f"`{K.USCIS_YEAR}`").alias("fiscal_year")
    ).agg(
        F.count("*").alias("n"), total("New Employment Approval").alias("new_approvals"),
        total("Amended Denial").alias("amended_denials"),
    )


_HISTORY_OUT = f"SELECT {_PERM_OUT} FROM history"


@register("s10_history_sink", (["history"], _HISTORY_OUT))
def _(i):
    path = scratch_path(i.spark, "history")
    writers.write_history(history(i), path)
    return readers.read_table(i.spark, f"{path}/parquet")


# --- scalars --------------------------------------------------------------------

@register("d1_normalize_company", (["perm_rows"],
    f"SELECT DISTINCT employer, {q.employer('employer')} AS norm FROM perm_rows"))
def _(i):
    return i.perm_rows.select("employer", text.normalize_company(F.col("employer")).alias("norm")).distinct()


@register("d2_fiscal_year", (["perm_rows"],
    f"SELECT case_key, {q.fiscal_year('decision_date')} AS fiscal_year FROM perm_rows"))
def _(i):
    return i.perm_rows.select("case_key", dates.fiscal_year(F.col("decision_date")).alias("fiscal_year"))


@register("d3_filing_age", (["perm_rows"], f"""
    SELECT {FY} - {q.fiscal_year('decision_date')} AS age, count(*) AS n FROM perm_rows GROUP BY ALL"""))
def _(i):
    age = F.lit(dates.current_fiscal_year(FILINGS_AS_OF)) - dates.fiscal_year(F.col("decision_date"))
    return i.perm_rows.select(age.alias("age")).groupBy("age").agg(F.count("*").alias("n"))


@register("d4_lenient_dates", (["jobs_bronze"], """
    SELECT posted_at, strftime(try_cast(posted_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed, count(*) AS n
    FROM jobs_bronze GROUP BY ALL"""))
def _(i):
    return i.jobs_bronze.groupBy("posted_at").agg(F.count("*").alias("n")).withColumn(
        "parsed", dates.lenient_timestamp(F.col("posted_at"))
    )


@register("d5_approval_rates", (["perm_history"], f"""
    SELECT {N}, round(perm_approval_rate, 6) AS perm_approval_rate,
      round(recent_approval_rate, 6) AS recent_approval_rate FROM perm_history"""))
def _(i):
    return filings.perm_history(cases(i), FILINGS_AS_OF).select(
        N, "perm_approval_rate", "recent_approval_rate"
    )


@register("d6_trend", (["trends"], f"SELECT {N}, trend_direction FROM trends"))
def _(i):
    return filings.trends(filings.yearly_counts(cases(i)), FY)


@register("d7_freshness", (["totals"], f"SELECT {N}, CAST({_FRESH} AS DOUBLE) AS freshness FROM totals"))
def _(i):
    last = cases(i).groupBy(N).agg(F.max("decision_date").alias("last"))
    return last.select(N, dates.freshness(F.col("last"), FY).alias("freshness"))


# --- filters and aggregations ------------------------------------------------------

@register("f4_named_employers", (["cases"], f"SELECT {N}, count(*) AS n FROM cases GROUP BY ALL"))
def _(i):
    return cases(i).groupBy(N).agg(F.count("*").alias("n"))


@register("f5_recent_years", (["totals"], f"SELECT {N}, recent_perm_certified, recent_perm_denied FROM totals"))
def _(i):
    return filings.perm_history(cases(i), FILINGS_AS_OF).select(
        N, "recent_perm_certified", "recent_perm_denied"
    )


@register("f6_outcome_flags", (["cases"],
    "SELECT case_status, is_approved, is_denied, count(*) AS n FROM cases GROUP BY ALL"))
def _(i):
    return cases(i).groupBy("case_status", "is_approved", "is_denied").agg(F.count("*").alias("n"))


@register("u1_union_case_years", (["cases"],
    "SELECT fiscal_year, count(*) AS n, count(fein) AS with_fein FROM cases GROUP BY ALL"))
def _(i):
    return cases(i).groupBy("fiscal_year").agg(F.count("*").alias("n"), F.count("fein").alias("with_fein"))


@register("g3_yearly_counts", (["yearly"], f"SELECT {N}, fiscal_year, certified, denied FROM yearly"))
def _(i):
    return filings.yearly_counts(cases(i))


@register("g4_year_map", (["year_maps"], f"SELECT {N}, perm_by_year FROM year_maps"))
def _(i):
    return filings.year_map(filings.yearly_counts(cases(i)))


@register("g5_totals", (["totals"], f"""
    SELECT {N}, total_perm_certified, total_perm_denied,
      strftime(last_perm_date, '%Y-%m-%d %H:%M:%S') AS last_perm_date FROM totals"""))
def _(i):
    return filings.perm_history(cases(i), FILINGS_AS_OF).select(
        N, "total_perm_certified", "total_perm_denied", "last_perm_date"
    )


@register("g6_most_common", (["mode_company_name_raw", "mode_state", "mode_naics"], f"""
    SELECT {N}, company_name_raw, state, naics FROM mode_company_name_raw
    JOIN mode_state USING ({N}) JOIN mode_naics USING ({N})"""))
def _(i):
    return filings.most_common(
        filings.compact_cases(cases(i)), ["company_name_raw", "state", "naics"]
    )


@register("g7_recent_totals", (["cases"], f"""
    SELECT {N}, count(*) FILTER (WHERE is_approved) AS certified, count(*) FILTER (WHERE is_denied) AS denied
    FROM cases WHERE fiscal_year > {CUTOFF} GROUP BY ALL"""))
def _(i):
    recent = filings.yearly_counts(cases(i)).filter(F.col("fiscal_year") > CUTOFF)
    return recent.groupBy(N).agg(F.sum("certified").alias("certified"), F.sum("denied").alias("denied"))


@register("g8_uscis_totals", (["uscis_totals"],
    f"SELECT {N}, uscis_total_approvals, uscis_total_denials, uscis_last_fiscal_year FROM uscis_totals"))
def _(i):
    return filings.uscis_totals(uscis_raw(i))


@register("j2_perm_history", (["perm_history"], f"SELECT {_PERM_OUT} FROM perm_history"))
def _(i):
    return filings.perm_history(cases(i), FILINGS_AS_OF)


@register("j3_merge_sources", (["history"], f"""
    SELECT {N}, total_perm_certified, uscis_total_approvals, trend_direction, data_freshness_score FROM history"""))
def _(i):
    return history(i).select(
        N, "total_perm_certified", "uscis_total_approvals", "trend_direction", "data_freshness_score"
    )


@register("k5_by_volume", (["history"], f"SELECT {N}, total_perm_certified FROM history ORDER BY 2 DESC, 1"))
def _(i):
    return filings.by_volume(history(i)).select(N, "total_perm_certified")


@register("t2_sponsorship_history", (["history"], _HISTORY_OUT))
def _(i):
    return history(i)


# --- lookup ---------------------------------------------------------------------------

DERIVED["slugs"] = (["jobs_bronze"], "SELECT DISTINCT company_slug AS key FROM jobs_bronze")


def _tiers(keys: str, both: bool) -> str:
    back = f" OR starts_with(k.key, h.{N})" if both else ""
    return f"""
    SELECT key, tier, {N} FROM (
      SELECT k.key, h.{N}, CASE WHEN h.{N} = k.key THEN 1
          WHEN starts_with(h.{N}, k.key){back} THEN 2
          WHEN length(k.key) > 4 AND contains(h.{N}, k.key) THEN 3 END AS tier,
        row_number() OVER (PARTITION BY k.key ORDER BY tier, h.total_perm_certified DESC, h.{N}) AS rn
      FROM {keys} k, history h WHERE tier IS NOT NULL) WHERE rn = 1"""


DERIVED["resolved"] = (["slugs", "history"], _tiers("slugs", True))
DERIVED["asked"] = (["employer_names"], f"SELECT DISTINCT name, {q.employer('name')} AS key FROM employer_names")
DERIVED["asked_keys"] = (["asked"], "SELECT DISTINCT key FROM asked")
DERIVED["asked_hits"] = (["asked_keys", "history"], _tiers("asked_keys", False))
_BASE = q.base_score("total_perm_certified", "uscis_total_approvals", "trend_direction", "data_freshness_score")
DERIVED["evidence"] = (["slugs", "resolved", "history"], f"""
    SELECT s.key AS company_slug, CASE WHEN h.{N} IS NULL THEN 0.40::DOUBLE ELSE {_BASE} END AS base_score,
      coalesce(h.total_perm_certified, 0) AS perm_total,
      CASE WHEN h.{N} IS NULL THEN 'unknown' ELSE coalesce(h.trend_direction, 'insufficient_data') END AS trend,
      coalesce(h.data_freshness_score, 0.0) AS freshness
    FROM slugs s LEFT JOIN resolved r USING (key) LEFT JOIN history h USING ({N})""")


@register("j4_exact_lookup", (["slugs", "history"], f"""
    SELECT key AS company_slug, {N} FROM slugs LEFT JOIN history ON key = {N}"""))
def _(i):
    slugs = i.jobs_bronze.select("company_slug").distinct()
    names = history_table(i).select(N)
    return slugs.join(names, F.col("company_slug") == F.col(N), "left")


@register("j5_resolve_slugs", (["resolved"], f"SELECT key AS company_slug, tier, {N} FROM resolved"))
def _(i):
    return resolve.resolve_slugs(i.jobs_bronze.select("company_slug"), history_table(i))


@register("w2_best_employer", (["resolved", "history"], f"""
    SELECT key AS company_slug, tier, {N}, total_perm_certified FROM resolved JOIN history USING ({N})"""))
def _(i):
    h = history_table(i)
    return resolve.resolve_slugs(i.jobs_bronze.select("company_slug"), h).join(
        h.select(N, "total_perm_certified"), N
    )


@register("j6_resolve_names", (["asked", "asked_hits"], f"""
    SELECT name, key, tier, {N} FROM asked LEFT JOIN asked_hits USING (key)"""))
def _(i):
    return resolve.resolve_queries(i.employer_names, history_table(i))


@register("u2_distinct_slugs", (["slugs"], "SELECT key AS company_slug FROM slugs"))
def _(i):
    return i.jobs_bronze.select("company_slug").distinct()


_EVIDENCE = "SELECT company_slug, round(base_score, 6) AS base_score, perm_total, trend, freshness FROM evidence"


@register("j9_company_evidence", (["evidence"], _EVIDENCE))
def _(i):
    return resolve.company_evidence(i.jobs_bronze.select("company_slug"), history_table(i))


@register("g13_evidence_coverage", (["evidence"], """
    SELECT count(*) FILTER (WHERE perm_total > 0) AS found, count(*) AS companies FROM evidence"""))
def _(i):
    return serving.evidence_coverage(
        resolve.company_evidence(i.jobs_bronze.select("company_slug"), history_table(i))
    )


@register("e2_employer_base", (["history"], f"SELECT {N}, round({_BASE}, 6) AS base_score FROM history"))
def _(i):
    from hireplane.operators.scoring import employer_base

    return history_table(i).select(N, employer_base(
        F.col("total_perm_certified"), F.col("uscis_total_approvals"),
        F.col("trend_direction"), F.col("data_freshness_score"),
    ).alias("base_score"))


@register("e3_unknown_employers", (["evidence"], """
    SELECT trend = 'unknown' AS is_unknown, count(*) AS n, round(min(base_score), 6) AS least,
      round(max(base_score), 6) AS most FROM evidence GROUP BY ALL"""))
def _(i):
    rows = resolve.company_evidence(i.jobs_bronze.select("company_slug"), history_table(i))
    return rows.groupBy((F.col("trend") == "unknown").alias("is_unknown")).agg(
        F.count("*").alias("n"), F.min("base_score").alias("least"), F.max("base_score").alias("most")
    )


_HISTORY_RESPONSE = (["asked", "asked_hits", "history"], f"""
    SELECT a.name, r.tier, r.{N}, h.company_name_raw,
      {', '.join(f'coalesce(h.{c}, 0) AS {c}' for c in filings.COUNT_COLUMNS)},
      round(h.perm_approval_rate, 6) AS perm_approval_rate, round(h.recent_approval_rate, 6) AS recent_approval_rate,
      h.trend_direction, h.data_freshness_score, h.perm_by_year, r.{N} IS NOT NULL AS found
    FROM asked a LEFT JOIN asked_hits r USING (key) LEFT JOIN history h ON h.{N} = r.{N}""")


@register("t3_employer_history", _HISTORY_RESPONSE)
def _(i):
    return serving.employer_history(i.employer_names, history_table(i))


def employer_index(i: Inputs) -> EmployerIndex:
    path = scratch_path(i.spark, "employers")
    write_index(history_table(i), path)
    return EmployerIndex(i.spark, path)


@register("t3_employer_index", _HISTORY_RESPONSE)
def _(i):
    return serving.employer_history_by_index(i.employer_names, employer_index(i))


@register("j5_resolve_by_index", (["resolved"], f"SELECT key AS company_slug, tier, {N} FROM resolved"))
def _(i):
    keys = i.jobs_bronze.select(F.col("company_slug").alias("key"))
    return employer_index(i).resolve(keys, True).withColumnRenamed("key", "company_slug")


DERIVED["audit"] = (["companies", "history"], f"""
    SELECT slug, display_name, {N} IS NOT NULL AS found, {N}, coalesce(total_perm_certified, 0) AS certified,
      trend_direction, coalesce(data_freshness_score, 0.0) AS freshness FROM (
      SELECT c.slug, c.display_name, h.*, row_number() OVER (PARTITION BY c.slug, c.display_name
        ORDER BY h.total_perm_certified DESC NULLS LAST, h.{N}) AS rn
      FROM companies c LEFT JOIN history h ON contains(h.{N}, {q.employer('c.display_name')})) WHERE rn = 1""")


@register("t4_coverage_audit", (["audit"], "SELECT * FROM audit"))
def _(i):
    return resolve.coverage_audit(i.companies, history_table(i))
