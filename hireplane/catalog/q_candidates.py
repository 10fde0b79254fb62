"""Queries over résumés and candidates: extraction, index, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane.catalog import sqltext as q
from hireplane.catalog.bindings import TEXTS, Inputs
from hireplane.catalog.q_postings import silver, silver_sources
from hireplane.catalog.registry import DERIVED, register, stored
from hireplane.functions import text
from hireplane.functions.numbers import round4
from hireplane.operators import matching, profiles, ranks, term_index
from hireplane.plans import ranking
from hireplane.session import scratch_path, stored as stored_scratch
from hireplane.sources import readers, writers

# --- profile extraction ---------------------------------------------------------

# Word edge as in a Unicode \b; RE2's own \b knows ASCII only.
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _escaped(skill: str) -> str:
    return "".join("\\" + c if c in "+#./" else c for c in skill)


def _skill_case(skill: str) -> str:
    if skill in K.SHORT_SKILLS:
        pattern = f"(?:^|[^A-Za-z]){_escaped(skill)}(?:$|[^A-Za-z])"
    else:
        # A trailing \b after a sign asks for a word character.
        right = r"[\p{L}\p{N}_]" if not skill[-1].isalnum() else _R
        pattern = f"(?i){_L}{_escaped(skill)}{right}"
    return (
        f"CASE WHEN contains(lowered, {q.quote(skill.lower())}) AND regexp_matches(text, {q.quote(pattern)})"
        f" THEN {q.quote(skill)} END"
    )


DERIVED["skill_lists"] = (["resumes"], f"""
    SELECT candidate_id, list_filter([{', '.join(_skill_case(s) for s in K.ALL_SKILLS)}], lambda x: x IS NOT NULL) AS technical_skills
    FROM (SELECT *, lower(text) AS lowered FROM resumes)""")
DERIVED["skill_hits"] = (["skill_lists"], "SELECT candidate_id, unnest(technical_skills) AS skill FROM skill_lists")


def _labels(column: str, patterns: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({column}, {q.quote('(?i)' + p)}) THEN {q.quote(label)}" for p, label in patterns
    ) + " END"


_DEGREE = [
    (rf"{_L}(ph\.?d|doctor(?:ate)?){_R}", "PhD"),
    (rf"{_L}(m\.?s|master(?:'?s)?|m\.?eng){_R}", "Master's"),
    (rf"{_L}(b\.?s|b\.?e|bachelor(?:'?s)?|b\.?tech){_R}", "Bachelor's"),
]
_FIELD = [(p.replace("\\b", _R), label) for p, label in K.FIELDS]
_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]')"
_NAME = rf"^[A-Za-z\-''.]+(?:{q.SPACE}+[A-Za-z\-''.]+){{1,3}}$"
_RANGE = K.DATE_RANGE
_YEARS = (
    f"list_concat(regexp_extract_all(text, {q.quote('(?i)' + _RANGE)}, 1), regexp_extract_all(text, {q.quote('(?i)' + _RANGE)}, 2))"
)
_STATED = f"try_cast(regexp_extract(text, {q.quote('(?i)' + K.EXPERIENCE)}, 1) AS DOUBLE)"
DERIVED["read"] = (["resumes"], f"""
    SELECT candidate_id, lower(text) AS lowered,
      list_filter(list_transform(({_LINES})[1:4], lambda l: {q.stripped('l')}),
        lambda l: regexp_matches(l, '{_NAME}'))[1] AS name,
      nullif(regexp_extract(text, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.]+'), '') AS email,
      {_labels('text', _DEGREE)} AS highest_degree, {_labels('text', _FIELD)} AS field_of_study,
      list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '(?i){_L}(university|institute of technology|college){_R}')),
        lambda l: left({q.stripped('l')}, {K.UNIVERSITY_CHARS}))[1] AS university,
      {_STATED} AS stated,
      list_min(list_transform({_YEARS}, lambda y: coalesce(try_cast(y AS INTEGER), {K.PRESENT_YEAR}))) AS earliest,
      [{', '.join(f"regexp_extract(text, {q.quote('(?i)' + p)})" for p in K.JOB_TITLES)}] AS raw_titles
    FROM resumes""")
DERIVED["read2"] = (["read", "skill_lists"], f"""
    SELECT r.candidate_id, r.lowered, r.name, r.email, s.technical_skills, r.highest_degree, r.field_of_study, r.university,
      coalesce(stated, CAST(greatest(0, least({K.PRESENT_YEAR} - earliest, {K.MAX_EXPERIENCE})) * CASE WHEN earliest IS NULL THEN NULL ELSE 1 END AS DOUBLE)) AS years_of_experience,
      list_transform(list_filter(raw_titles, lambda t: t <> ''), lambda t: array_to_string(list_transform(
        string_split({q.collapsed('t')}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')) AS titles_all,
      list_filter([{', '.join(f"CASE WHEN {q.any_contains('lowered', words)} THEN {q.quote(label)} END" for label, words in K.INDUSTRIES.items())}],
        lambda x: x IS NOT NULL) AS industries
    FROM read r JOIN skill_lists s USING (candidate_id)""")
_SIGNALS = " UNION ALL ".join(
    f"SELECT {n} AS ord, {q.quote(role)} AS role, unnest({q.listing([s.lower() for s in signals])}) AS signal"
    for n, (role, signals) in enumerate(K.ROLE_SIGNALS.items())
)
DERIVED["role_signals"] = ([], _SIGNALS)
DERIVED["scores_by_role"] = (["skill_hits", "role_signals"], """
    SELECT candidate_id, ord, role, count(DISTINCT signal) AS score
    FROM skill_hits JOIN role_signals ON lower(skill) = signal GROUP BY ALL""")
DERIVED["best_roles"] = (["scores_by_role"], """
    SELECT candidate_id, list(role ORDER BY score DESC, ord) AS best_fit_roles
    FROM scores_by_role WHERE score >= 2 GROUP BY ALL""")
_SENIORITY = "CASE " + " ".join(
    f"WHEN {q.any_contains('lowered', words)} THEN {q.quote(level)}" for level, words in K.SENIORITY
) + " WHEN years_of_experience < 2 THEN 'Entry' WHEN years_of_experience < 5 THEN 'Mid' WHEN years_of_experience IS NOT NULL THEN 'Senior' END"
DERIVED["rule_profiles"] = (["read2", "best_roles"], f"""
    SELECT *, coalesce(name, 'The candidate') || ' is a '
        || CASE WHEN len(best_fit_roles) > 0 THEN array_to_string(best_fit_roles[1:2], ' and ') ELSE 'data' END
        || ' professional with ' || CASE WHEN coalesce(years_of_experience, 0) <> 0
          THEN CAST(CAST(floor(years_of_experience) AS BIGINT) AS VARCHAR) || ' years of experience' ELSE 'professional experience' END
        || '. Core skills include ' || CASE WHEN len(technical_skills) > 0 THEN array_to_string(technical_skills[1:5], ', ')
          ELSE 'various technical skills' END || '.'
        || coalesce(' Holds a ' || highest_degree || '.', '') AS profile_summary
    FROM (SELECT candidate_id, name, email, technical_skills, CAST([] AS VARCHAR[]) AS soft_skills, years_of_experience,
        list_filter(titles_all, lambda t, n: list_position(titles_all, t) = n) AS job_titles, industries,
        highest_degree, field_of_study, university,
        coalesce(best_fit_roles, CAST([] AS VARCHAR[])) AS best_fit_roles, {_SENIORITY} AS seniority_level
      FROM read2 LEFT JOIN best_roles USING (candidate_id))""")
_LISTS = profiles.LIST_FIELDS


def _profile_out(names=profiles.FIELD_NAMES) -> str:
    return ", ".join(f"{q.joined(c)} AS {c}" if c in _LISTS else c for c in names)


def resumes(i: Inputs) -> DataFrame:
    return profiles.usable_resumes(i.resumes)


def rule_profiles(i: Inputs) -> DataFrame:
    return profiles.extract_profiles(resumes(i))


@register("s6_resume_texts", (["resumes"], """
    SELECT candidate_id, length(text) AS n_chars FROM resumes WHERE trim(text) <> ''"""))
def _(i):
    path = scratch_path(i.spark, "resumes")
    i.resumes.write.parquet(path)
    stored_ = readers.read_resumes(i.spark, path)
    return profiles.usable_resumes(stored_).select("candidate_id", F.length("text").alias("n_chars"))


for _name, _field in (
    ("x1_skills", "technical_skills"), ("x2_email", "email"), ("x3_name", "name"),
    ("x4_degree", "highest_degree"), ("x5_field_of_study", "field_of_study"),
    ("x6_university", "university"), ("x7_years_of_experience", "years_of_experience"),
    ("x8_job_titles", "job_titles"), ("x9_industries", "industries"),
    ("x10_best_fit_roles", "best_fit_roles"), ("x11_seniority", "seniority_level"),
    ("x12_summary", "profile_summary"),
):
    @register(_name, (["rule_profiles"], f"SELECT candidate_id, {_profile_out([_field])} FROM rule_profiles"))
    def _(i, field=_field):
        return rule_profiles(i).select("candidate_id", field)


@register("g15_role_scores", (["resumes", "scores_by_role"], f"""
    SELECT candidate_id, role, coalesce(score, 0) AS score FROM resumes
    CROSS JOIN (SELECT unnest({q.listing(K.ROLE_SIGNALS)}) AS role) LEFT JOIN scores_by_role USING (candidate_id, role)"""))
def _(i):
    scores = profiles.role_scores(F.col("technical_skills"))
    return rule_profiles(i).select("candidate_id", F.explode(scores).alias("s")).select(
        "candidate_id", "s.role", "s.score"
    )


def _json_list(field: str) -> str:
    path = f"'$.{field}'"
    # Of the items' JSON texts, all but the empty text, zeros, false, null, and empty lists and objects.
    keep = "lambda x: x NOT IN ('\"\"', '0', '0.0', '-0', '-0.0', 'false', 'null', '[]', '{}')"
    show = "lambda x: CASE x WHEN 'true' THEN 'True' ELSE coalesce(x ->> '$', x) END"
    return (
        f"CASE WHEN json_type(extracted, {path}) = 'ARRAY' THEN list_transform(list_filter("
        f"CAST(json_extract(extracted, '$.{field}[*]') AS VARCHAR[]), {keep}), {show})"
        " ELSE CAST([] AS VARCHAR[]) END"
    )


def _json_text(field: str) -> str:
    value = f"nullif(json_extract_string(extracted, '$.{field}'), '')"
    if field == "seniority_level":
        return f"CASE WHEN {value} IN {tuple(K.SENIORITY_LEVELS)} THEN {value} END"
    if field == "profile_summary":
        return f"coalesce(trim({value}), '')"
    if field == "years_of_experience":
        return f"try_cast({value} AS DOUBLE)"
    return f"trim({value})"


DERIVED["sanitised"] = (["extracted"], f"""
    SELECT candidate_id, {', '.join(f"{_json_list(c) if c in _LISTS else _json_text(c)} AS {c}" for c in profiles.FIELD_NAMES)}
    FROM (SELECT candidate_id, CASE WHEN json_valid(extracted) THEN extracted END AS extracted FROM extracted)
    WHERE json_type(extracted) = 'OBJECT'""")


@register("x13_sanitise_extracted", (["sanitised"], f"SELECT candidate_id, {_profile_out()} FROM sanitised"))
def _(i):
    return profiles.sanitise_extracted(i.extracted)


DERIVED["preferred"] = (["rule_profiles", "sanitised"], f"""
    SELECT candidate_id, {', '.join(profiles.FIELD_NAMES)} FROM sanitised UNION ALL
    SELECT candidate_id, {', '.join(profiles.FIELD_NAMES)} FROM rule_profiles
    WHERE candidate_id NOT IN (SELECT candidate_id FROM sanitised)""")


@register("x14_prefer_extracted", (["preferred"], f"SELECT candidate_id, {_profile_out()} FROM preferred"))
def _(i):
    return profiles.prefer_extracted(rule_profiles(i), profiles.sanitise_extracted(i.extracted))


DERIVED["full_profiles"] = (["rule_profiles", "user_inputs"], """
    SELECT p.*, u.visa_status, u.requires_sponsorship,
      CASE WHEN len(u.target_roles) > 0 THEN u.target_roles ELSE p.best_fit_roles END AS target_roles,
      u.preferred_locations, u.open_to_relocation
    FROM rule_profiles p JOIN user_inputs u USING (candidate_id)""")


@register("x15_user_inputs", (["full_profiles"], f"""
    SELECT candidate_id, name, visa_status, requires_sponsorship, {q.joined('target_roles')} AS target_roles,
      {q.joined('preferred_locations')} AS preferred_locations, open_to_relocation FROM full_profiles"""))
def _(i):
    return profiles.with_user_inputs(rule_profiles(i), i.user_inputs).select(
        "candidate_id", "name", "visa_status", "requires_sponsorship", "target_roles",
        "preferred_locations", "open_to_relocation",
    )


def _split(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"


@register("x16_split_lists", (["user_inputs"], f"""
    SELECT candidate_id, {q.joined(_split('roles_text'))} AS roles, {q.joined(_split('places_text'))} AS places
    FROM user_inputs"""))
def _(i):
    return i.user_inputs.select(
        "candidate_id", profiles.split_list(F.col("roles_text")).alias("roles"),
        profiles.split_list(F.col("places_text")).alias("places"),
    )


# --- index -------------------------------------------------------------------------

_UNIT = "list_transform({0}, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))))"
DERIVED["index_table"] = (["silver", "job_vectors"], f"""
    SELECT s.job_id, s.company_slug, s.title, s.location, s.apply_url, s.posted_at, s.is_active,
      {q.without_markup('s.description_text')} AS description_clean, CAST({_UNIT.format('v.embedding')} AS FLOAT[]) AS embedding
    FROM silver s LEFT JOIN job_vectors v USING (job_id) WHERE s.is_target_role""")
_INDEX = "job_id, company_slug, title, location, apply_url, posted_at, is_active, description_clean"


def job_index(i: Inputs) -> DataFrame:
    words = TEXTS[:1]
    return matching.build_index(silver_sources(i, words), i.job_vectors, texts=lambda jobs: i.with_texts(jobs, words))


def index_table(i: Inputs) -> DataFrame:
    return stored(i, "index", job_index)


@register("f2_target_jobs", (["silver"], "SELECT job_id, title FROM silver WHERE is_target_role"))
def _(i):
    return silver(i, ()).filter("is_target_role").select("job_id", "title")


@register("p11_job_text", (["silver"], f"""
    SELECT job_id, coalesce(title, '') || ' at ' || company_slug || '. ' || {q.without_markup('description_text')} AS job_text,
      coalesce(title, '') || ' at ' || company_slug || '. ' || left({q.without_markup('description_text')}, 1500) AS short_text
    FROM silver"""))
def _(i):
    args = F.col("title"), F.col("company_slug"), F.col("description_text")
    return silver(i, TEXTS[:1]).select(
        "job_id", text.job_text(*args).alias("job_text"), text.job_text(*args, 1500).alias("short_text")
    )


@register("p12_candidate_text", (["full_profiles"], """
    SELECT candidate_id, array_to_string(target_roles, ' ') || ' ' || array_to_string(job_titles, ' ') || ' '
      || CASE WHEN coalesce(years_of_experience, 0) <> 0 THEN CAST(CAST(floor(years_of_experience) AS BIGINT) AS VARCHAR)
        || ' years experience' ELSE '' END || ' ' || coalesce(highest_degree, '') || ' '
      || array_to_string(technical_skills, ' ') || ' ' || profile_summary AS candidate_text FROM full_profiles"""))
def _(i):
    p = profiles.with_user_inputs(rule_profiles(i), i.user_inputs)
    return p.select("candidate_id", text.candidate_text(
        F.col("technical_skills"), F.col("job_titles"), F.col("target_roles"), F.col("best_fit_roles"),
        F.col("years_of_experience"), F.col("highest_degree"), F.col("profile_summary"),
    ).alias("candidate_text"))


@register("p13_scan_text", (["silver"], f"""
    SELECT job_id, {q.without_markup('description_text')} AS scan_text,
      left({q.without_markup('description_text')}, 3000) AS short_text FROM silver"""))
def _(i):
    clean = text.strip_markup(F.col("description_text"))
    return silver(i, TEXTS[:1]).select(
        "job_id", clean.alias("scan_text"), text.head(clean, 3000).alias("short_text")
    )


@register("m1_unit_vectors", (["candidate_vectors"], f"""
    SELECT candidate_id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest({_UNIT.format('embedding')}), 6) AS x
    FROM candidate_vectors"""))
def _(i):
    return i.candidate_vectors.select(
        "candidate_id", F.posexplode(matching.unit_vector(F.col("embedding"))).alias("pos", "x")
    )


@register("m7_job_index", (["index_table"], f"""
    SELECT {_INDEX}, round(CAST(embedding[1] AS DOUBLE), 5) AS first_value,
      round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS length FROM index_table"""))
def _(i):
    v = F.col("embedding")
    return job_index(i).withColumns({
        "first_value": F.round(v[0].cast("double"), 5), "length": F.round(matching.cosine(v, v), 5),
    }).drop("embedding")


@register("s11_index_sink", (["index_table"], f"""
    SELECT {_INDEX}, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x, k: CAST(x AS DOUBLE) * k)), 4) AS weighted
    FROM index_table"""))
def _(i):
    path = scratch_path(i.spark, "index")
    writers.write_index(job_index(i), path)
    stored_index = readers.read_table(i.spark, path, [*_INDEX.split(", "), "embedding"])
    weighted = F.aggregate(
        F.transform("embedding", lambda x, k: x.cast("double") * (k + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return stored_index.withColumns({
        "n": F.when(F.col("embedding").isNotNull(), F.size("embedding")), "weighted": F.round(weighted, 4),
    }).drop("embedding")


# --- matching ------------------------------------------------------------------------

DERIVED["candidates"] = (["full_profiles", "candidate_vectors"], f"""
    SELECT p.*, CAST({_UNIT.format('v.embedding')} AS FLOAT[]) AS embedding
    FROM full_profiles p LEFT JOIN candidate_vectors v USING (candidate_id)""")


def candidates(i: Inputs) -> DataFrame:
    return ranking.profiles_from_resumes(i.resumes, i.user_inputs, i.candidate_vectors)


def candidate_table(i: Inputs) -> DataFrame:
    return stored(i, "candidates", candidates)


_KEYWORDS = "MAP {" + ", ".join(f"{q.quote(r)}: {q.listing(w)}" for r, w in K.ROLE_KEYWORDS.items()) + "}"
DERIVED["skill_pairs"] = (["candidates", "index_table"], """
    SELECT s.skill, j.job_id FROM (SELECT DISTINCT unnest(technical_skills) AS skill FROM candidates) s, index_table j
    WHERE contains(lower(j.description_clean), lower(s.skill))""")
DERIVED["skill_counts"] = (["candidates", "skill_pairs"], """
    SELECT c.candidate_id, p.job_id, count(*) AS n, list(c.skill ORDER BY c.pos) AS matched
    FROM (SELECT candidate_id, unnest(technical_skills) AS skill, generate_subscripts(technical_skills, 1) AS pos FROM candidates) c
    JOIN skill_pairs p USING (skill) GROUP BY ALL""")
DERIVED["role_pairs"] = (["candidates", "index_table"], f"""
    SELECT DISTINCT t.roles, j.title FROM (SELECT DISTINCT target_roles AS roles FROM candidates) t,
      (SELECT DISTINCT coalesce(title, '') AS title FROM index_table) j
    WHERE len(list_filter(flatten(list_transform(t.roles, lambda r: coalesce({_KEYWORDS}[r], [lower(r)]))),
      lambda k: contains(lower(j.title), k))) > 0""")
DERIVED["place_pairs"] = (["candidates", "index_table"], f"""
    SELECT DISTINCT t.places, j.location FROM (SELECT DISTINCT preferred_locations AS places FROM candidates) t,
      (SELECT DISTINCT coalesce(location, '') AS location FROM index_table) j
    WHERE len(t.places) > 0 AND (contains(lower(j.location), 'remote') OR len(list_filter(flatten(list_transform(t.places,
      lambda p: regexp_split_to_array(lower(replace(p, ',', ' ')), '\\s+'))),
      lambda w: length(w) > 2 AND contains(lower(j.location), w))) > 0)""")
DERIVED["pairs"] = (["candidates", "index_table", "skill_counts", "role_pairs", "place_pairs"], """
    SELECT c.candidate_id, j.job_id,
      coalesce(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(j.embedding AS DOUBLE[])), 0.0::DOUBLE) AS semantic,
      coalesce(CAST(s.n AS DOUBLE) / len(c.technical_skills), 0.0) AS skill,
      coalesce(s.matched, CAST([] AS VARCHAR[])) AS matched_skills,
      r.title IS NOT NULL AS role_match, p.location IS NOT NULL AS location_match
    FROM candidates c CROSS JOIN index_table j
    LEFT JOIN skill_counts s ON s.candidate_id = c.candidate_id AND s.job_id = j.job_id
    LEFT JOIN role_pairs r ON r.roles = c.target_roles AND r.title = coalesce(j.title, '')
    LEFT JOIN place_pairs p ON p.places = c.preferred_locations AND p.location = coalesce(j.location, '')""")


def _matches(n: int) -> str:
    return f"""
    SELECT candidate_id, job_id, match_score, {q.round4('semantic')} AS semantic_score, {q.round4('skill')} AS skill_overlap_score,
      role_match, location_match, matched_skills, match_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY match_score DESC, job_id) AS match_rank FROM (
        SELECT *, {q.round4("0.50::DOUBLE * semantic + 0.30::DOUBLE * skill + 0.10::DOUBLE * role_match::INT + 0.10::DOUBLE * location_match::INT")}
          AS match_score FROM pairs)) WHERE match_rank <= {n}"""


DERIVED["top20"] = (["pairs"], _matches(20))
DERIVED["top150"] = (["pairs"], _matches(150))


@register("k1_top_matches", (["top20"], "SELECT candidate_id, job_id, match_score, match_rank FROM top20"))
def _(i):
    scores = matching.score_pairs(candidate_table(i), index_table(i), 20)
    return matching.top_matches(scores, 20).select("candidate_id", "job_id", "match_score", "match_rank")


@register("j8_score_join", (["top150"], """
    SELECT candidate_id, count(*) AS n, round(max(match_score), 6) AS best, round(min(match_score), 6) AS last
    FROM top150 GROUP BY ALL"""))
def _(i):
    scores = matching.score_pairs(candidate_table(i), index_table(i), 150)
    return matching.top_matches(scores, 150).groupBy("candidate_id").agg(
        F.count("*").alias("n"), F.max("match_score").alias("best"), F.min("match_score").alias("last")
    )


DERIVED["job_terms"] = (["index_table"], """
    SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark
    UNION SELECT DISTINCT lower(p_name) FROM part
    UNION SELECT DISTINCT lower(company_slug) FROM index_table""")
DERIVED["index_texts"] = (["index_table"], "SELECT DISTINCT lower(coalesce(description_clean, '')) AS body FROM index_table")


@register("j8_term_index", (["index_table", "job_terms", "index_texts"], """
    SELECT j.job_id, count(*) AS n_terms, md5(string_agg(p.term, '|' ORDER BY p.term)) AS terms
    FROM index_table j JOIN (SELECT t.term, x.body FROM job_terms t JOIN index_texts x ON contains(x.body, t.term)) p
      ON p.body = lower(coalesce(j.description_clean, ''))
    GROUP BY j.job_id"""))
def _(i):
    index = index_table(i)
    table = lambda name: i.spark.read.parquet(f"{i.dialect.sf_dir}/{name}.parquet")
    terms = (
        table("benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term"))
        .unionAll(table("part").select(F.lower("p_name"))).unionAll(index.select(F.lower("company_slug")))
    )
    texts = index.select("job_id", F.lower("description_clean").alias("body"))
    pairs = term_index.contained_terms(texts, terms, "job_id", "body")
    listed = F.array_join(F.sort_array(F.collect_set("term")), "|")
    return pairs.groupBy(F.col("id").alias("job_id")).agg(F.count("*").alias("n_terms"), F.md5(listed).alias("terms"))


# Every candidate with a few jobs, whatever they score: the next ones in the order of ids, round and round.
_FEW = 5
DERIVED["few_ids"] = (["candidates", "index_table"], f"""
    SELECT c.candidate_id, j.job_id FROM (
      SELECT candidate_id, unnest(range(0, {_FEW})) + {_FEW} * (row_number() OVER (ORDER BY candidate_id) - 1) AS slot FROM candidates) c
    JOIN (SELECT job_id, row_number() OVER (ORDER BY job_id) - 1 AS place, count(*) OVER () AS n FROM index_table) j
      ON c.slot % j.n = j.place""")
DERIVED["few"] = (["pairs", "few_ids"], f"""
    SELECT *, {q.round4('semantic')} AS semantic_score, {q.round4('skill')} AS skill_overlap_score,
      {q.round4("0.50::DOUBLE * semantic + 0.30::DOUBLE * skill + 0.10::DOUBLE * role_match::INT + 0.10::DOUBLE * location_match::INT")} AS match_score
    FROM pairs SEMI JOIN few_ids USING (candidate_id, job_id)""")


def few_pairs(i: Inputs) -> DataFrame:
    """Candidate and job columns side by side, scored by the column functions of the matching module."""
    people = ranks.ranked(candidate_table(i).withColumnRenamed("embedding", "c"), ["candidate_id"])
    jobs = ranks.ranked(index_table(i).withColumnRenamed("embedding", "j"), ["job_id"], "_place")
    n_jobs = jobs.count()
    slots = F.transform(F.sequence(F.lit(0), F.lit(_FEW - 1)), lambda k: F.pmod(F.col("rank") * _FEW + k, F.lit(max(1, n_jobs))))
    # Fewer jobs than slots: each job once.
    people = people.withColumn("_place", F.explode(F.array_distinct(slots)))
    rows = people.join(jobs, "_place").withColumn(
        "matched_skills", matching.matched_skills(F.col("technical_skills"), F.col("description_clean"))
    )
    return rows.withColumns({
        "semantic": F.coalesce(matching.cosine(F.col("c"), F.col("j")), F.lit(0.0)),
        "skill": matching.skill_overlap(F.col("technical_skills"), F.col("matched_skills")),
        "role_match": matching.role_match(F.col("title"), matching.wanted_roles(F.col("target_roles"), F.col("best_fit_roles"))),
        "location_match": matching.location_match(F.col("location"), F.col("preferred_locations")),
    })


@register("m2_semantic_score", (["few"], "SELECT candidate_id, job_id, semantic_score FROM few"))
def _(i):
    return few_pairs(i).select("candidate_id", "job_id", round4(F.col("semantic")).alias("semantic_score"))


DERIVED["matched20"] = (["top20", "index_table"], """
    SELECT t.*, j.company_slug, j.title, j.location, j.apply_url, j.posted_at, j.description_clean AS description_text
    FROM top20 t JOIN index_table j USING (job_id)""")


def top20(i: Inputs) -> DataFrame:
    """Matches without the text of their job, which the index holds once."""
    return stored(
        i, "matches20", lambda x: matching.match_candidates(candidate_table(x), index_table(x), 20).drop("description_text")
    )


DERIVED["list_classes"] = (["candidates"], "SELECT candidate_id, min(candidate_id) OVER (PARTITION BY technical_skills) AS same_as FROM candidates")
DERIVED["job_classes"] = (["index_table", "skill_pairs"], """
    SELECT job_id, min(job_id) OVER (PARTITION BY found) AS same_as FROM (
      SELECT j.job_id, list_sort(list(DISTINCT lower(p.skill)) FILTER (WHERE p.skill IS NOT NULL)) AS found
      FROM index_table j LEFT JOIN skill_pairs p USING (job_id) GROUP BY j.job_id)""")


@register("m3_skill_overlap", (["pairs", "list_classes", "job_classes"], f"""
    SELECT 'overlap' AS kind, candidate_id, job_id, CAST(NULL AS VARCHAR) AS same_as,
      {q.joined('matched_skills')} AS matched_skills, {q.round4('skill')} AS skill_overlap_score FROM pairs
    WHERE candidate_id IN (SELECT same_as FROM list_classes) AND job_id IN (SELECT same_as FROM job_classes)
    UNION ALL SELECT 'candidate', candidate_id, NULL, CAST(same_as AS VARCHAR), NULL, NULL FROM list_classes
    UNION ALL SELECT 'job', NULL, job_id, same_as, NULL, NULL FROM job_classes"""))
def _(i):
    """All candidates against all jobs: the overlap of one candidate of every list of skills with one job of every
    set of named skills that a text holds, and for each candidate and job the one that stands for it (``same_as``)."""
    people, index = candidate_table(i), index_table(i)
    lists = people.groupBy("technical_skills").agg(F.min("candidate_id").alias("candidate_id"))
    named = lists.select(F.explode("technical_skills").alias("skill")).select(F.lower("skill").alias("term")).distinct()
    texts = index.select(F.col("job_id").alias("id"), F.lower(F.coalesce("description_clean", F.lit(""))).alias("body"))
    n_terms = named.count()
    few = n_terms <= matching.TERMS_PER_SCAN
    hits = term_index.scanned(texts, named, n_terms) if few else term_index.contained_terms(texts, named, "id", "body")
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("found"))
    sets = stored_scratch(index.select("job_id").join(found.withColumnRenamed("id", "job_id"), "job_id", "left"), "skill_sets")
    firsts = sets.groupBy("found").agg(F.min("job_id").alias("first"))
    bodies = index.join(firsts.select(F.col("first").alias("job_id")), "job_id").select("job_id", "description_clean")
    overlap = lists.crossJoin(bodies).withColumn(
        "matched_skills", matching.matched_skills(F.col("technical_skills"), F.col("description_clean"))
    ).select(
        F.lit("overlap").alias("kind"), "candidate_id", "job_id", F.lit(None).cast("string").alias("same_as"), "matched_skills",
        round4(matching.skill_overlap(F.col("technical_skills"), F.col("matched_skills"))).alias("skill_overlap_score"),
    )
    of_lists = lists.select(F.col("candidate_id").cast("string").alias("same_as"), F.col("technical_skills").alias("mine"))
    candidates_told = people.join(of_lists, people["technical_skills"].eqNullSafe(of_lists["mine"])).select(
        F.lit("candidate").alias("kind"), "candidate_id", "same_as"
    )
    of_sets = firsts.withColumnRenamed("found", "mine")
    jobs_told = sets.join(of_sets, sets["found"].eqNullSafe(of_sets["mine"])).select(
        F.lit("job").alias("kind"), "job_id", F.col("first").alias("same_as")
    )
    told = overlap.unionByName(candidates_told, allowMissingColumns=True)
    return told.unionByName(jobs_told, allowMissingColumns=True)


def _jobs_told(i: Inputs, lists: DataFrame, terms: str, field: str) -> DataFrame:
    """``list`` and the number of jobs whose ``field`` contains one of the terms of the list.

    Works on the distinct lists, terms and field values, which meet by the index
    of the terms; jobs come in as counts.
    """
    values = index_table(i).groupBy(F.lower(F.coalesce(field, F.lit(""))).alias("value")).agg(F.count("*").alias("n"))
    wanted = lists.select("list", F.explode(terms).alias("term")).distinct()
    hits = term_index.contained_terms(values, wanted, "value", "value").withColumnRenamed("id", "value")
    pairs = wanted.join(hits, "term").select("list", "value")
    return pairs.distinct().join(values, "value").groupBy("list").agg(F.sum("n").alias("n_jobs"))


@register("m4_role_match", (["candidates", "index_table", "role_pairs"], """
    SELECT c.candidate_id, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS n_jobs FROM candidates c
    LEFT JOIN role_pairs r ON r.roles = c.target_roles
    LEFT JOIN (SELECT coalesce(title, '') AS title, count(*) AS n FROM index_table GROUP BY ALL) t ON t.title = r.title
    GROUP BY c.candidate_id"""))
def _(i):
    """For every candidate the number of jobs whose title names a wanted role."""
    people = candidate_table(i).select("candidate_id", matching.wanted_roles(F.col("target_roles"), F.col("best_fit_roles")).alias("list"))
    lists = people.select("list").distinct().withColumn("terms", matching.role_terms(F.col("list")))
    told = _jobs_told(i, lists, "terms", "title")
    return people.join(told, "list", "left").select("candidate_id", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


@register("m5_location_match", (["candidates", "index_table", "place_pairs"], """
    SELECT c.candidate_id, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS n_jobs FROM candidates c
    LEFT JOIN place_pairs p ON p.places = c.preferred_locations
    LEFT JOIN (SELECT coalesce(location, '') AS location, count(*) AS n FROM index_table GROUP BY ALL) t ON t.location = p.location
    GROUP BY c.candidate_id"""))
def _(i):
    """For every candidate the number of jobs at a wanted place."""
    people = candidate_table(i).select("candidate_id", F.col("preferred_locations").alias("list"))
    lists = people.select("list").where(F.size("list") > 0).distinct().select("list", F.array_append(matching.location_terms(F.col("list")), F.lit("remote")).alias("terms"))
    told = _jobs_told(i, lists, "terms", "location")
    return people.join(told, "list", "left").select("candidate_id", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


@register("m6_match_score", (["few"], "SELECT candidate_id, job_id, match_score FROM few"))
def _(i):
    score = matching.match_score(F.col("semantic"), F.col("skill"), F.col("role_match"), F.col("location_match"))
    return few_pairs(i).select("candidate_id", "job_id", score.alias("match_score"))


_ANY_ROLE = q.quote("|".join(w for words in K.ROLE_KEYWORDS.values() for w in words))
DERIVED["documented"] = (["few", "candidates", "index_table"], f"""
    SELECT f.*, CASE WHEN c.place > 0 THEN greatest(0, j.level - c.place) ELSE 0 END AS seniority_gap,
      len(c.roles) > 0 AND NOT f.role_match AND regexp_matches(j.name, {_ANY_ROLE}) AS off_target
    FROM few f JOIN (
      SELECT candidate_id, coalesce(CASE WHEN len(target_roles) > 0 THEN target_roles ELSE best_fit_roles END, []) AS roles,
        coalesce(list_position(['Entry', 'Mid', 'Senior', 'Staff', 'Principal'], seniority_level), 0) AS place FROM candidates) c USING (candidate_id)
    JOIN (
      SELECT job_id, lower(coalesce(title, '')) AS name, CASE WHEN regexp_matches(name, '\\bprincipal\\b') THEN 5
        WHEN regexp_matches(name, '\\bstaff\\b') THEN 4 WHEN regexp_matches(name, '\\b(senior|lead)\\b') THEN 3
        WHEN regexp_matches(name, '\\b(junior|intern)\\b') THEN 1 ELSE 2 END AS level FROM index_table) j USING (job_id)""")


@register("m9_documented_score", (["documented"], f"""
    SELECT candidate_id, job_id, CAST(seniority_gap AS BIGINT) AS seniority_gap, off_target, CASE WHEN seniority_gap < 2 THEN {q.round4(
        "greatest(0.0::DOUBLE, 0.50::DOUBLE * semantic + 0.30::DOUBLE * skill + 0.10::DOUBLE * role_match::INT + 0.10::DOUBLE * location_match::INT"
        " - (CASE WHEN seniority_gap = 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN off_target THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END))")} END
      AS documented_score FROM documented"""))
def _(i):
    roles = matching.wanted_roles(F.col("target_roles"), F.col("best_fit_roles"))
    rows = few_pairs(i).withColumns({
        "seniority_gap": matching.seniority_gap(F.col("title"), F.col("seniority_level")),
        "off_target": matching.off_target(F.col("title"), roles),
    })
    score = matching.documented_score(*[F.col(c) for c in ("semantic", "skill", "role_match", "location_match", "seniority_gap", "off_target")])
    return rows.select("candidate_id", "job_id", "seniority_gap", "off_target", score.alias("documented_score"))


@register("m8_match_candidates", (["matched20"], f"""
    SELECT candidate_id, job_id, company_slug, title, location, apply_url, posted_at, description_text, match_score,
      semantic_score, skill_overlap_score, role_match, location_match, {q.joined('matched_skills')} AS matched_skills, match_rank
    FROM matched20"""))
def _(i):
    return matching.match_candidates(candidate_table(i), index_table(i), 20)
