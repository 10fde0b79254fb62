"""Queries over postings: parsing, tracking, silver jobs, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane import schemas as S
from hireplane.catalog import sqltext as q
from hireplane.catalog.bindings import POSTINGS_AS_OF, TEXTS, Inputs
from hireplane.catalog.registry import DERIVED, register
from hireplane.functions import dates, text
from hireplane.operators import postings
from hireplane.plans import incremental
from hireplane.session import scratch_path
from hireplane.sources import readers, writers
from hireplane.streaming import tracking


# --- raw postings, packed per provider ---------------------------------------

def raw_postings(i: Inputs) -> DataFrame:
    """Posting fields packed the way each provider sends them."""
    f = i.posting_fields
    paragraph = F.concat(F.lit("<p>"), F.col("phrase"), F.lit("</p>"))
    content = F.concat(F.col("html"), paragraph)
    place = F.struct("city", "region", "country")
    even = F.col("event_id") % 2 == 0
    packed = {
        "greenhouse": F.struct(
            "id", "title", F.struct(F.col("place").alias("name")).alias("location"),
            F.array(F.struct(F.col("department").alias("name")), F.struct(F.col("team").alias("name"))).alias("departments"),
            F.col("day").alias("updated_at"), content.alias("content"), F.col("url").alias("absolute_url"),
        ),
        "lever": F.struct(
            "id", F.col("title").alias("text"),
            F.struct(
                F.when(even, F.col("place")).otherwise("").alias("location"),
                F.array(F.col("place"), F.lit("Elsewhere")).alias("allLocations"),
                "department", "team",
            ).alias("categories"),
            F.col("created_ms").alias("createdAt"), F.col("html").alias("description"),
            F.array(
                F.struct(F.lit("Stack").alias("text"), F.array("stack", "phrase").alias("content"))
            ).alias("lists"),
            F.col("url").alias("hostedUrl"),
        ),
        "ashby": F.struct(
            "id", "title", F.col("place").alias("locationName"), F.col("day").alias("publishedDate"),
            content.alias("descriptionHtml"), F.struct(F.col("department").alias("name")).alias("department"),
            F.struct(F.col("team").alias("name")).alias("team"), F.col("url").alias("applicationFormUrl"),
        ),
        "smartrecruiters": F.struct(
            "id", F.col("title").alias("name"), place.alias("location"), F.col("day").alias("releasedDate"),
            F.struct(F.col("team").alias("label")).alias("department"), F.col("url").alias("ref"),
        ),
        "workable": F.struct(
            F.when(even, F.concat(F.lit("s"), F.col("id"))).alias("shortcode"), "id", "title",
            place.alias("location"), F.col("day").alias("published_on"),
            F.col("team").alias("department"), F.col("url"),
        ),
    }
    raw = None
    for provider, fields in packed.items():
        cond = F.col("source_ats") == provider
        raw = F.when(cond, F.to_json(fields)) if raw is None else raw.when(cond, F.to_json(fields))
    return f.select("source_ats", "company_slug", F.explode(F.array(raw)).alias("raw"), "scraped_at")


_PLACE = "array_to_string(list_filter([city, region, country], lambda p: p <> ''), ', ')"
_CREATED = (
    "CASE WHEN created_ms = 0 THEN '' ELSE strftime(make_timestamp(created_ms * 1000), '%Y-%m-%dT%H:%M:%S')"
    " || CASE WHEN created_ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(created_ms % 1000 AS VARCHAR), 3, '0') || '000' END"
    " || '+00:00' END"
)
_P = "'<p>' || phrase || '</p>'"
_FIELDS = {
    "greenhouse": dict(job_id="id", location="place", posted_at="day",
                       html=f"html || {_P}", departments="department || ', ' || team"),
    "lever": dict(job_id="id", location="place", posted_at=_CREATED,
                  html="html || '<h3>Stack</h3><ul><li>' || stack || '</li><li>' || phrase || '</li></ul>'",
                  departments="CASE WHEN department = '' THEN team ELSE department END"),
    "ashby": dict(job_id="id", location="place", posted_at="day", html=f"html || {_P}",
                  departments="CASE WHEN department = '' THEN team ELSE department END"),
    "smartrecruiters": dict(job_id="id", location=_PLACE, posted_at="day", html="''", departments="team"),
    "workable": dict(job_id="CASE WHEN event_id % 2 = 0 THEN 's' || id ELSE id END", location=_PLACE,
                     posted_at="day", html="''", departments="team"),
}
DERIVED["parsed"] = (["posting_fields"], " UNION ALL ".join(
    f"""SELECT {v['job_id']} AS job_id, company_slug, title, {q.target_role('title')} AS is_target_role,
      {v['location']} AS location, {v['posted_at']} AS posted_at, scraped_at, {v['html']} AS description_html,
      {v['departments']} AS departments, url AS apply_url, source_ats
    FROM posting_fields WHERE source_ats = '{provider}'"""
    for provider, v in _FIELDS.items()
))
_POSTING = (
    "job_id, company_slug, title, is_target_role, location, posted_at, "
    f"{q.ts('scraped_at')} AS scraped_at, description_html, {q.page_text('description_html')} AS description_text, "
    "departments, apply_url, source_ats"
)


def _provider_query(name: str, provider: str) -> None:
    @register(name, (["parsed"], f"SELECT {_POSTING} FROM parsed WHERE source_ats = '{provider}'"))
    def _(i: Inputs) -> DataFrame:
        raw = raw_postings(i).filter(F.col("source_ats") == provider)
        return postings.parse_postings(raw, us_only=False).drop("raw_json")


for _name, _provider in (
    ("p1_greenhouse", "greenhouse"), ("p2_lever", "lever"), ("p3_ashby", "ashby"),
    ("p4_smartrecruiters", "smartrecruiters"), ("p5_workable", "workable"),
):
    _provider_query(_name, _provider)


@register("p6_all_providers", (["parsed"], f"SELECT {_POSTING} FROM parsed"))
def _(i):
    return postings.parse_postings(raw_postings(i), us_only=False).drop("raw_json")


@register("p7_target_role", (["jobs_bronze"],
    f"SELECT title, {q.target_role('title')} AS is_target, count(*) AS n FROM jobs_bronze GROUP BY ALL"))
def _(i):
    flag = text.is_target_role(F.col("title")).alias("is_target")
    return i.jobs_bronze.select("title", flag).groupBy("title", "is_target").agg(F.count("*").alias("n"))


DERIVED["places"] = (["parsed"], "SELECT DISTINCT location FROM parsed")


@register("p8_us_location", (["places"], f"SELECT location, {q.us_location('location')} AS is_us FROM places"))
def _(i):
    rows = postings.parse_postings(raw_postings(i), us_only=False).select("location").distinct()
    return rows.select("location", text.is_us_location(F.col("location")).alias("is_us"))


@register("p9_html_to_text", ([], f"SELECT page_id, {q.page_text('html')} AS text FROM pages"))
def _(i):
    pages = i.spark.read.parquet(f"{i.dialect.sf_dir}/pages.parquet")
    return text.add_html_text(pages, "html", "text").select("page_id", "text")


@register("p10_strip_markup", (["jobs_bronze"],
    f"SELECT DISTINCT job_id, {q.without_markup('description_html')} AS text FROM jobs_bronze"))
def _(i):
    # A job meets the same page in many snapshots: it is stripped once.
    pages = i.jobs_by_source.select("job_id", "description_html").distinct()
    return i.with_texts(pages, TEXTS[1:]).select(
        "job_id", text.strip_markup(F.col("description_html")).alias("text")
    ).distinct()


# --- filters, dates, provider choice -----------------------------------------

@register("f1_us_postings", (["parsed"],
    f"SELECT {_POSTING} FROM parsed WHERE {q.us_location('location')}"))
def _(i):
    return postings.parse_postings(raw_postings(i)).drop("raw_json")


@register("d9_epoch_to_iso", (["posting_fields"],
    f"SELECT event_id, {_CREATED} AS created_at FROM posting_fields"))
def _(i):
    return i.posting_fields.select("event_id", dates.epoch_ms_to_iso(F.col("created_ms")).alias("created_at"))


_RANK = "list_position(" + q.listing(K.PROVIDERS) + ", {})"
DERIVED["chosen"] = (["parsed", "companies"], f"""
    SELECT p.* FROM parsed p
    LEFT JOIN companies c ON c.slug = p.company_slug AND c.ats IN {tuple(K.PROVIDERS)}
    JOIN (SELECT company_slug, scraped_at, min({_RANK.format('source_ats')}) AS first_rank
          FROM parsed GROUP BY ALL) f USING (company_slug, scraped_at)
    WHERE {_RANK.format('p.source_ats')} = coalesce({_RANK.format('c.ats')}, f.first_rank)""")


@register("j7_provider_fallback", (["chosen"],
    f"SELECT company_slug, {q.ts('scraped_at')} AS scraped_at, source_ats, count(*) AS n FROM chosen GROUP BY ALL"))
def _(i):
    chosen = postings.choose_provider(raw_postings(i), i.companies)
    return chosen.groupBy("company_slug", "scraped_at", "source_ats").agg(F.count("*").alias("n"))


# --- tracking and silver ------------------------------------------------------

DERIVED["tracked"] = (["jobs_bronze"], """
    SELECT job_id, min(scraped_at) AS first_seen, max(scraped_at) AS last_seen,
      count(scraped_at) AS times_seen FROM jobs_bronze WHERE job_id IS NOT NULL GROUP BY job_id""")
_TRACKED = f"SELECT job_id, {q.ts('first_seen')} AS first_seen, {q.ts('last_seen')} AS last_seen, times_seen FROM tracked"
_VALUE_COLUMNS = [
    "company_slug", "title", "is_target_role", "location", "posted_at", "description_html",
    "description_text", "departments", "apply_url", "source_ats",
]
DERIVED["latest"] = (["jobs_bronze"], f"""
    SELECT job_id, {', '.join(f'arg_max({c}, scraped_at) AS {c}' for c in _VALUE_COLUMNS)},
      max(scraped_at) AS scraped_at FROM jobs_bronze WHERE job_id IS NOT NULL GROUP BY job_id""")
DERIVED["silver"] = (["latest", "tracked"], f"""
    SELECT l.*, t.first_seen, t.last_seen, t.times_seen,
      t.last_seen >= TIMESTAMP '{POSTINGS_AS_OF}' - INTERVAL {K.ACTIVE_DAYS} DAY AS is_active
    FROM latest l JOIN tracked t USING (job_id)""")
_SILVER = (
    f"job_id, {', '.join(_VALUE_COLUMNS)}, {q.ts('scraped_at')} AS scraped_at, {q.ts('first_seen')} AS first_seen, "
    f"{q.ts('last_seen')} AS last_seen, times_seen, is_active"
)


def sources_of(i: Inputs, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """Bronze rows with the sources of ``texts``; the other texts are left out."""
    return i.jobs_by_source.drop(*[t for t in TEXTS if t not in texts])


def silver_sources(i: Inputs, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    return postings.silver_jobs(sources_of(i, texts), POSTINGS_AS_OF)


def silver_flags(i: Inputs, *columns: str) -> DataFrame:
    """Silver jobs with their tracking and the named columns only."""
    return postings.silver_jobs(sources_of(i, ()), POSTINGS_AS_OF, columns=list(columns))


def silver(i: Inputs, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """Silver jobs with the texts that are asked for; the jobs are made first, then their texts are brought in."""
    return i.with_texts(silver_sources(i, texts), texts)


@register("g1_job_tracking", (["tracked"], _TRACKED))
def _(i):
    return postings.track_jobs(i.jobs_bronze)


@register("g2_latest_values", (["latest"],
    f"SELECT job_id, {', '.join(_VALUE_COLUMNS)}, {q.ts('scraped_at')} AS scraped_at FROM latest"))
def _(i):
    return i.with_texts(postings.latest_values(sources_of(i).drop("raw_json")))


@register("w1_latest_rows", (["jobs_bronze"], f"""
    SELECT job_id, {', '.join(_VALUE_COLUMNS)}, {q.ts('scraped_at')} AS scraped_at, raw_json FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC) AS rn FROM jobs_bronze
    ) WHERE rn = 1"""))
def _(i):
    return i.with_texts(postings.latest_rows(sources_of(i)))


@register("j1_join_tracking", (["latest", "tracked"], f"""
    SELECT job_id, title, {q.ts('scraped_at')} AS scraped_at, {q.ts('first_seen')} AS first_seen,
      {q.ts('last_seen')} AS last_seen, times_seen FROM latest LEFT JOIN tracked USING (job_id)"""))
def _(i):
    slim = i.jobs_bronze.select("job_id", "title", "scraped_at")
    return postings.join_tracking(
        postings.latest_values(slim), postings.track_jobs(slim)
    )


@register("f3_active_flag", (["silver"], "SELECT is_active, count(*) AS n FROM silver GROUP BY ALL"))
def _(i):
    return silver_flags(i).groupBy("is_active").agg(F.count("*").alias("n"))


@register("t1_silver_jobs", (["silver"], f"SELECT {_SILVER} FROM silver"))
def _(i):
    return silver(i)


@register("g9_counts_by_provider", (["jobs_bronze"],
    "SELECT source_ats, count(*) AS n_jobs FROM jobs_bronze GROUP BY ALL"))
def _(i):
    return postings.counts_by_provider(i.jobs_bronze)


@register("g10_company_summary", (["parsed"], f"""
    SELECT company_slug, count(*) AS us_jobs, count(*) FILTER (WHERE is_target_role) AS target_jobs
    FROM parsed WHERE {q.us_location('location')} GROUP BY ALL"""))
def _(i):
    return postings.company_summary(postings.parse_postings(raw_postings(i)))


@register("g11_silver_summary", (["silver"], """
    SELECT count(*) AS unique_jobs, count(*) FILTER (WHERE is_active) AS active_jobs,
      count(*) FILTER (WHERE is_target_role) AS target_jobs FROM silver"""))
def _(i):
    return postings.silver_summary(silver_flags(i, "is_target_role"))


@register("r1_stream_tracking", (["tracked"], _TRACKED))
def _(i):
    """Every day as its first run, then the even days again: a second run replaces the first."""
    path = scratch_path(i.spark, "tracking")
    rows = i.jobs_bronze.drop("raw_json")
    rows.withColumn("run", F.lit(1)).write.option("compression", "zstd").parquet(f"{path}/in/1")
    first = i.spark.read.parquet(f"{path}/in/1")
    schema = first.schema
    first.where(F.dayofmonth("scraped_at") % 2 == 0).withColumn("run", F.lit(2)).write.option("compression", "zstd").parquet(f"{path}/in/2")
    stream = i.spark.readStream.schema(schema).option("maxFilesPerTrigger", 32).parquet(f"{path}/in/*")
    tracking.start_tracking(
        stream, f"{path}/out", f"{path}/checkpoint", "run", fold_every=2, availableNow=True
    ).awaitTermination()
    return tracking.latest_tracking(tracking.tracking_rows(i.spark, f"{path}/out"))


@register("t1_incremental_silver", (["silver"], f"SELECT {_SILVER} FROM silver"))
def _(i):
    """Silver jobs of the first days, then of the later days and one day again, each from the stored state."""
    path = scratch_path(i.spark, "days")
    bronze = i.jobs_bronze
    days = [r[0] for r in bronze.select(F.date_format("scraped_at", "yyyy-MM-dd").alias("d")).distinct().orderBy("d").collect()]
    half = days[: len(days) // 2] or days
    early = F.date_format("scraped_at", "yyyy-MM-dd") <= half[-1]
    writers.write_bronze(bronze.where(early), path)
    incremental.update_state(i.spark, f"{path}/json", f"{path}/state", half)
    writers.write_bronze(bronze.where(~early), path)
    later = [d for d in days if d not in half]
    incremental.update_state(i.spark, f"{path}/json", f"{path}/state", later)
    return incremental.update_silver(i.spark, f"{path}/json", f"{path}/state", later[-1:], POSTINGS_AS_OF)


# --- sources and sinks ---------------------------------------------------------

_BRONZE = (
    f"job_id, {', '.join(_VALUE_COLUMNS)}, {q.ts('scraped_at')} AS scraped_at"
)


@register("s1_bronze_snapshots", (["jobs_bronze"], f"SELECT {_BRONZE}, raw_json FROM jobs_bronze"))
def _(i):
    path = scratch_path(i.spark, "bronze")
    writers.write_bronze(i.jobs_bronze, path)
    return readers.read_bronze(i.spark, f"{path}/json")


@register("s8_manifest_reading", (["jobs_bronze"], f"""
    SELECT {_BRONZE}, raw_json FROM jobs_bronze WHERE scraped_at >= (
      SELECT max(scraped_at) FROM jobs_bronze)::DATE - INTERVAL 9 DAY"""))
def _(i):
    """The postings of the last ten days, by way of the manifest; a stray folder beside them is not read."""
    path = scratch_path(i.spark, "bronze")
    bronze = i.jobs_bronze
    writers.write_bronze(bronze, path)
    writers.append_manifest(readers.read_bronze(i.spark, f"{path}/json"), path)
    bronze.limit(1).select("job_id").write.text(f"{path}/json/scrape_date=2999-01-01")
    since = bronze.agg(F.date_format(F.date_sub(F.max("scraped_at"), 9), "yyyy-MM-dd")).first()[0]
    return readers.read_runs(i.spark, path, readers.manifest_runs(i.spark, path, since))


@register("s4_silver_columns", (["silver"], "SELECT job_id, title, is_active FROM silver"))
def _(i):
    path = scratch_path(i.spark, "silver")
    writers.write_silver(silver(i), path)
    return readers.read_table(i.spark, f"{path}/parquet", ["job_id", "title", "is_active"])


@register("s5_companies", (["companies"], "SELECT slug, display_name, ats FROM companies"))
def _(i):
    path = scratch_path(i.spark, "companies")
    i.companies.write.json(path)
    return readers.read_companies(i.spark, path)


@register("s7_bronze_sink", (["jobs_bronze"], f"""
    SELECT strftime(scraped_at, '%Y-%m-%d') AS scrape_date, count(*) AS n,
      count(DISTINCT job_id) AS jobs FROM jobs_bronze GROUP BY ALL"""))
def _(i):
    path = scratch_path(i.spark, "bronze")
    writers.write_bronze(i.jobs_bronze, path)
    stored = i.spark.read.schema(S.JOBS_BRONZE).json(f"{path}/json")
    return stored.groupBy(F.col("scrape_date").cast("string").alias("scrape_date")).agg(
        F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs")
    )


DERIVED["runs"] = (["chosen"], f"""
    SELECT scraped_at, source_ats, count(*) AS n, count(*) FILTER (WHERE is_target_role) AS t,
      list(DISTINCT company_slug) AS slugs
    FROM chosen WHERE {q.us_location('location')} GROUP BY ALL""")


@register("s8_run_manifest", (["runs"], """
    SELECT strftime(scraped_at, '%Y-%m-%d') AS run_date, strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at,
      CAST(sum(n) AS BIGINT) AS total_jobs, CAST(sum(t) AS BIGINT) AS target_jobs,
      len(list_distinct(flatten(list(slugs)))) AS companies_hit,
      '{' || string_agg('"' || source_ats || '":' || n, ',' ORDER BY source_ats) || '}' AS by_ats
    FROM runs GROUP BY ALL"""))
def _(i):
    path = scratch_path(i.spark, "runs")
    bronze = postings.parse_postings(postings.choose_provider(raw_postings(i), i.companies))
    writers.append_manifest(bronze, path)
    stored = i.spark.read.schema(S.RUN_MANIFEST).json(f"{path}/manifest")
    return stored.drop("csv_path", "json_path", "day")


@register("s9_silver_sink", (["silver"], f"""
    SELECT job_id, title, {q.ts('last_seen')} AS last_seen, times_seen, is_active FROM silver"""))
def _(i):
    path = scratch_path(i.spark, "silver")
    writers.write_silver(silver(i), path)
    return readers.read_table(
        i.spark, f"{path}/parquet", ["job_id", "title", "last_seen", "times_seen", "is_active"]
    )


@register("u1_union_snapshots", (["parsed"],
    "SELECT source_ats, count(*) AS n, count(DISTINCT job_id) AS jobs FROM parsed GROUP BY ALL"))
def _(i):
    raw = raw_postings(i)
    parts = [
        postings.parse_postings(raw.filter(F.col("source_ats") == p), us_only=False)
        for p in K.PROVIDERS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("source_ats").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))
