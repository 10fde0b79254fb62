"""Table schemas. Production reads never infer."""

from __future__ import annotations

RAW_POSTINGS = "source_ats STRING, company_slug STRING, raw STRING, scraped_at TIMESTAMP"
JOBS_BRONZE = (
    "job_id STRING, company_slug STRING, title STRING, is_target_role BOOLEAN, location STRING,"
    " posted_at STRING, scraped_at TIMESTAMP, description_html STRING, description_text STRING,"
    " departments STRING, apply_url STRING, source_ats STRING, raw_json STRING"
)
JOBS_BRONZE_COLUMNS = [field.split()[0] for field in JOBS_BRONZE.split(",")]
RUN_MANIFEST = (
    "run_date STRING, scraped_at STRING, csv_path STRING, json_path STRING, total_jobs BIGINT,"
    " target_jobs BIGINT, companies_hit BIGINT, by_ats MAP<STRING, BIGINT>"
)
COMPANIES = "slug STRING, display_name STRING, ats STRING"
PROFILE = {
    "name": "STRING", "email": "STRING", "technical_skills": "ARRAY<STRING>",
    "soft_skills": "ARRAY<STRING>", "years_of_experience": "DOUBLE",
    "job_titles": "ARRAY<STRING>", "industries": "ARRAY<STRING>", "highest_degree": "STRING",
    "field_of_study": "STRING", "university": "STRING", "best_fit_roles": "ARRAY<STRING>",
    "seniority_level": "STRING", "profile_summary": "STRING",
}

# --- fixed values: fields read from each provider's raw posting --------------
GREENHOUSE = (
    "id STRING, title STRING, location STRING, departments ARRAY<STRUCT<name: STRING>>,"
    " updated_at STRING, content STRING, absolute_url STRING"
)
LEVER = (
    "id STRING, text STRING, categories STRUCT<location: STRING, allLocations: ARRAY<STRING>,"
    " department: STRING, team: STRING>, createdAt BIGINT, description STRING,"
    " lists ARRAY<STRUCT<text: STRING, content: STRING>>, hostedUrl STRING"
)
ASHBY = (
    "id STRING, title STRING, locationName STRING, publishedDate STRING, descriptionHtml STRING,"
    " department STRUCT<name: STRING>, team STRUCT<name: STRING>, applicationFormUrl STRING"
)
SMARTRECRUITERS = (
    "id STRING, name STRING, location STRUCT<city: STRING, region: STRING, country: STRING>,"
    " releasedDate STRING, department STRUCT<label: STRING>, ref STRING"
)
WORKABLE = (
    "shortcode STRING, id STRING, title STRING,"
    " location STRUCT<city: STRING, region: STRING, country: STRING>, published_on STRING,"
    " department STRING, url STRING"
)
