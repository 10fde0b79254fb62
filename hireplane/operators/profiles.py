"""Résumé texts to candidate profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane import schemas as S
from hireplane.functions import text
from hireplane.functions.text import contains_any

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
FIELD_NAMES = list(S.PROFILE)
LIST_FIELDS = [name for name, kind in S.PROFILE.items() if kind.startswith("ARRAY")]


def usable_resumes(resumes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Résumés with text; the whole text unless a limit is asked for."""
    return resumes.filter(text.strip(F.coalesce("text", F.lit(""))) != "").withColumn(
        "text", text.head(F.col("text"), max_chars)
    )


def rejected_resumes(resumes: DataFrame) -> DataFrame:
    return resumes.filter(text.strip(F.coalesce("text", F.lit(""))) == "").select("candidate_id")


def _skill_pattern(skill: str) -> str:
    quoted = "\\Q" + skill + "\\E"
    if skill in K.SHORT_SKILLS:
        return f"(?<![A-Za-z]){quoted}(?![A-Za-z])"
    return rf"(?iU)\b{quoted}\b"


def skills(body: Column, lowered: Column) -> Column:
    """Taxonomy skills in taxonomy order.

    A plain substring test comes first, so a regular expression only runs for
    skills whose letters do occur.
    """
    taxonomy = text.literal(
        [{"skill": s, "needle": s.lower(), "pattern": _skill_pattern(s)} for s in K.ALL_SKILLS],
        "array<struct<skill: string, needle: string, pattern: string>>",
    )
    hits = F.filter(
        taxonomy, lambda s: F.contains(lowered, s["needle"]) & F.regexp_like(body, s["pattern"])
    )
    return F.transform(hits, lambda s: s["skill"])


def email(body: Column) -> Column:
    return text.blank_to_null(F.regexp_extract(body, "(?U)" + K.EMAIL, 0))


def name(body: Column) -> Column:
    """First of the first four lines made of two to four alphabetic words."""
    lines = F.transform(F.slice(F.split(body, LINE_BREAK, 5), 1, 4), text.strip)
    word = r"[A-Za-z\-'.]+"
    pattern = f"^{word}(?:(?U:{text.WS_CLASS})+{word}){{1,3}}$"
    return F.get(F.filter(lines, lambda line: line.rlike(pattern)), F.lit(0))


def _first_label(body: Column, patterns: list[tuple[str, str]]) -> Column:
    out = None
    for pattern, label in patterns:
        hit = body.rlike("(?iU)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def degree(body: Column) -> Column:
    return _first_label(body, K.DEGREES)


def field_of_study(body: Column) -> Column:
    return _first_label(body, K.FIELDS)


def university(body: Column) -> Column:
    lines = F.filter(F.split(body, LINE_BREAK), lambda line: line.rlike(f"(?iU){K.UNIVERSITY}"))
    return text.blank_to_null(F.substring(text.strip(F.get(lines, F.lit(0))), 1, K.UNIVERSITY_CHARS))


def years_of_experience(body: Column, present_year: int = K.PRESENT_YEAR) -> Column:
    """Stated years, else the span since the earliest year of any date range."""
    stated = F.regexp_extract(body, "(?iU)" + K.EXPERIENCE, 1).try_cast("double")
    ranges = "(?iU)" + K.DATE_RANGE
    years = F.concat(
        F.regexp_extract_all(body, F.lit(ranges), F.lit(1)),
        F.regexp_extract_all(body, F.lit(ranges), F.lit(2)),
    )
    earliest = F.array_min(
        F.transform(years, lambda y: F.coalesce(y.try_cast("int"), F.lit(present_year)))
    )
    span = F.greatest(F.lit(0), F.least(F.lit(present_year) - earliest, F.lit(K.MAX_EXPERIENCE)))
    return F.coalesce(stated, F.when(earliest.isNotNull(), span).cast("double"))


def job_titles(body: Column, lowered: Column) -> Column:
    """A pattern only runs on texts that hold the letters of ``K.JOB_TITLE_LETTERS``, which all its matches have."""
    found = F.array(*[
        F.when(text.contains_all(lowered, letters), F.regexp_extract(body, "(?iU)" + p, 0)).otherwise("")
        for p, letters in zip(K.JOB_TITLES, K.JOB_TITLE_LETTERS, strict=True)
    ])
    return F.array_distinct(
        F.transform(
            F.filter(found, lambda t: t != ""), lambda t: F.initcap(F.lower(text.collapse(t)))
        )
    )


def industries(lowered: Column) -> Column:
    labels = [F.when(contains_any(lowered, words), label) for label, words in K.INDUSTRIES.items()]
    return F.array_compact(F.array(*labels))


def role_scores(found: Column) -> Column:
    """Per role the number of its signal skills among the skills found."""
    roles = text.literal(
        [
            {"role": role, "signals": [s.lower() for s in signals], "ord": i}
            for i, (role, signals) in enumerate(K.ROLE_SIGNALS.items())
        ],
        "array<struct<role: string, signals: array<string>, ord: int>>",
    )
    return text.bind(
        F.transform(found, F.lower),
        lambda lowered: F.transform(
            roles,
            lambda r: F.struct(
                r["role"].alias("role"),
                F.size(F.array_intersect(lowered, r["signals"])).alias("score"),
                r["ord"].alias("ord"),
            ),
        ),
    )


def best_fit_roles(scores: Column) -> Column:
    ranked = F.array_sort(
        F.transform(
            F.filter(scores, lambda s: s["score"] >= 2),
            lambda s: F.struct((-s["score"]).alias("neg"), s["ord"].alias("ord"), s["role"].alias("role")),
        )
    )
    return F.transform(ranked, lambda s: s["role"])


def seniority(lowered: Column, years: Column) -> Column:
    out = None
    for level, words in K.SENIORITY:
        hit = contains_any(lowered, words)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.when(years < 2, "Entry").when(years < 5, "Mid").when(years.isNotNull(), "Senior")


def summary(who: Column, roles: Column, years: Column, found: Column, degree_: Column) -> Column:
    role_text = F.when(F.size(roles) > 0, F.array_join(F.slice(roles, 1, 2), " and ")).otherwise("data")
    years_text = F.when(
        F.coalesce(years, F.lit(0.0)) != 0,
        F.concat(years.cast("long").cast("string"), F.lit(" years of experience")),
    ).otherwise("professional experience")
    skill_text = F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, 5), ", ")).otherwise(
        "various technical skills"
    )
    return F.concat(
        F.coalesce(who, F.lit("The candidate")), F.lit(" is a "), role_text,
        F.lit(" professional with "), years_text, F.lit(". Core skills include "), skill_text,
        F.lit("."),
        F.coalesce(F.concat(F.lit(" Holds a "), degree_, F.lit(".")), F.lit("")),
    )


def extract_profiles(resumes: DataFrame, present_year: int = K.PRESENT_YEAR) -> DataFrame:
    """Rule-based profile of every résumé (``candidate_id, text``)."""
    body, lowered = F.col("text"), F.col("lowered")
    once = text.computed_once
    rows = once(resumes.select("candidate_id", "text"), "lowered", F.lower("text"))
    rows = once(rows, "technical_skills", skills(body, lowered))
    rows = once(rows, "years_of_experience", years_of_experience(body, present_year))
    read = rows.select(
        "candidate_id",
        name(body).alias("name"),
        email(body).alias("email"),
        "technical_skills",
        F.array().cast("array<string>").alias("soft_skills"),
        "years_of_experience",
        job_titles(body, lowered).alias("job_titles"),
        industries(lowered).alias("industries"),
        degree(body).alias("highest_degree"),
        field_of_study(body).alias("field_of_study"),
        university(body).alias("university"),
        seniority(lowered, F.col("years_of_experience")).alias("seniority_level"),
        best_fit_roles(role_scores(F.col("technical_skills"))).alias("best_fit_roles"),
    )
    return read.withColumn(
        "profile_summary",
        summary(
            F.col("name"), F.col("best_fit_roles"), F.col("years_of_experience"),
            F.col("technical_skills"), F.col("highest_degree"),
        ),
    ).select("candidate_id", *FIELD_NAMES)


def sanitise_extracted(raw: DataFrame) -> DataFrame:
    """Profiles from externally produced JSON (``candidate_id, extracted``).

    Rows whose JSON is broken or no object are left out; a field of the wrong
    type becomes NULL or an empty list.
    """
    parsed = raw.select("candidate_id", F.try_parse_json("extracted").alias("v")).filter(
        F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    )
    v = F.col("v")

    def scalar(field: str) -> Column:
        return F.try_variant_get(v, f"$.{field}", "string")

    def truthy(item: Column) -> Column:
        """Not null, and no empty text, zero, false, empty list or empty object; the texts "0" and "false" count."""
        kind, shown = F.schema_of_variant(item), F.try_variant_get(item, "$", "string")
        return item.isNotNull() & (kind != "VOID") & F.when(kind == "STRING", shown != "").when(
            kind == "BOOLEAN", shown == "true"
        ).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(item, "$", "double") != 0).otherwise(
            ~F.to_json(item).isin("[]", "{}")
        )

    def shown(item: Column) -> Column:
        """As text; a boolean is capitalised."""
        plain = F.try_variant_get(item, "$", "string")
        return F.when(F.schema_of_variant(item) == "BOOLEAN", F.initcap(plain)).otherwise(F.coalesce(plain, F.to_json(item)))

    def listed(field: str) -> Column:
        items = F.try_variant_get(v, f"$.{field}", "array<variant>")
        return F.coalesce(F.transform(F.filter(items, truthy), shown), F.array().cast("array<string>"))

    columns = []
    for field in FIELD_NAMES:
        if field in LIST_FIELDS:
            column = listed(field)
        elif field == "years_of_experience":
            column = F.try_variant_get(v, f"$.{field}", "double")
        elif field == "seniority_level":
            column = F.when(scalar(field).isin(K.SENIORITY_LEVELS), scalar(field))
        else:
            item = F.try_variant_get(v, f"$.{field}", "variant")
            column = F.when(truthy(item), text.strip(shown(item)))
            if field == "profile_summary":
                column = F.coalesce(column, F.lit(""))
        columns.append(column.alias(field))
    return parsed.select("candidate_id", *columns)


def prefer_extracted(rules: DataFrame, extracted: DataFrame) -> DataFrame:
    """The external profile where there is one, else the rule-based one, as a whole."""
    packed = extracted.select("candidate_id", F.struct(*FIELD_NAMES).alias("x"))
    return (
        rules.select("candidate_id", F.struct(*FIELD_NAMES).alias("r"))
        .join(packed, "candidate_id", "left")
        .select("candidate_id", F.coalesce("x", "r").alias("p"))
        .select("candidate_id", "p.*")
    )


def split_list(col: Column) -> Column:
    """Comma-separated text to a trimmed list without blanks."""
    items = F.transform(F.split(F.coalesce(col, F.lit("")), ","), text.strip)
    return F.filter(items, lambda i: i != "")


def with_user_inputs(profiles: DataFrame, inputs: DataFrame) -> DataFrame:
    """Add what the user states; target roles default to the best-fit roles."""
    joined = profiles.join(inputs, "candidate_id")
    empty = F.array().cast("array<string>")
    return joined.select(
        *profiles.columns,
        "visa_status", "requires_sponsorship",
        F.when(F.size("target_roles") > 0, F.col("target_roles"))
        .otherwise(F.col("best_fit_roles")).alias("target_roles"),
        F.coalesce("preferred_locations", empty).alias("preferred_locations"),
        "open_to_relocation",
    )
