"""Raw postings of five providers to one schema, snapshot tracking, run summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireplane import constants as K
from hireplane import schemas as S
from hireplane.functions import dates, text
from hireplane.session import stored

FIELDS = ["job_id", "title", "location", "posted_at", "description_html", "departments", "apply_url"]


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _fields(*columns: Column) -> Column:
    return F.struct(*[_text(c).alias(name) for c, name in zip(columns, FIELDS)])


def _place(location: Column) -> Column:
    parts = F.array(location["city"], location["region"], location["country"])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ", ")


def greenhouse_fields(r: Column) -> Column:
    # The location is an object with a name, or a plain string.
    location = F.when(
        F.startswith(r["location"], F.lit("{")), F.get_json_object(r["location"], "$.name")
    ).otherwise(r["location"])
    departments = F.array_join(F.transform(r["departments"], lambda d: _text(d["name"])), ", ")
    return _fields(
        r["id"], r["title"], location, r["updated_at"], r["content"], departments,
        r["absolute_url"],
    )


def lever_fields(r: Column) -> Column:
    cats = r["categories"]
    location = F.coalesce(
        text.blank_to_null(cats["location"]), F.get(cats["allLocations"], F.lit(0))
    )

    def bullets(content: Column) -> Column:
        # A list of items, or one item given as plain text.
        items = F.when(
            F.startswith(content, F.lit("[")), F.from_json(content, "array<string>")
        ).when(content.isNotNull(), F.array(content))
        tagged = F.transform(items, lambda i: F.concat(F.lit("<li>"), _text(i), F.lit("</li>")))
        return _text(F.array_join(tagged, ""))

    sections = F.transform(
        r["lists"],
        lambda s: F.concat(
            F.lit("<h3>"), _text(s["text"]), F.lit("</h3><ul>"), bullets(s["content"]),
            F.lit("</ul>"),
        ),
    )
    body = F.concat(_text(r["description"]), _text(F.array_join(sections, "")))
    department = F.coalesce(text.blank_to_null(cats["department"]), cats["team"])
    return _fields(
        r["id"], r["text"], location, dates.epoch_ms_to_iso(r["createdAt"]), body, department,
        r["hostedUrl"],
    )


def ashby_fields(r: Column) -> Column:
    department = F.coalesce(text.blank_to_null(r["department"]["name"]), r["team"]["name"])
    return _fields(
        r["id"], r["title"], r["locationName"], r["publishedDate"], r["descriptionHtml"],
        department, r["applicationFormUrl"],
    )


def smartrecruiters_fields(r: Column) -> Column:
    return _fields(
        r["id"], r["name"], _place(r["location"]), r["releasedDate"], F.lit(""),
        r["department"]["label"], r["ref"],
    )


def workable_fields(r: Column) -> Column:
    return _fields(
        F.coalesce(r["shortcode"], r["id"]), r["title"], _place(r["location"]),
        r["published_on"], F.lit(""), r["department"], r["url"],
    )


PARSERS = {
    "greenhouse": (S.GREENHOUSE, greenhouse_fields),
    "lever": (S.LEVER, lever_fields),
    "ashby": (S.ASHBY, ashby_fields),
    "smartrecruiters": (S.SMARTRECRUITERS, smartrecruiters_fields),
    "workable": (S.WORKABLE, workable_fields),
}


def _parsed(raw: Column, schema: str, fields) -> Column:
    """One-element list; the lambda argument keeps the JSON from being parsed per field."""
    return F.transform(F.array(F.from_json(raw, schema)), fields)


def parse_postings(raw_postings: DataFrame, us_only: bool = True) -> DataFrame:
    """All providers in one scan: each row goes through its own provider's parser."""
    fields = None
    for provider, (schema, parse) in PARSERS.items():
        cond, value = F.col("source_ats") == provider, _parsed(F.col("raw"), schema, parse)
        fields = F.when(cond, value) if fields is None else fields.when(cond, value)
    parsed = raw_postings.filter(F.col("source_ats").isin(K.PROVIDERS)).select(
        "company_slug", "source_ats", "scraped_at", F.col("raw").alias("raw_json"),
        F.inline(fields),
    )
    if us_only:
        parsed = parsed.filter(text.is_us_location(F.col("location")))
    flagged = parsed.withColumn("is_target_role", text.is_target_role(F.col("title")))
    return text.add_html_text(flagged, "description_html", "description_text").select(
        *S.JOBS_BRONZE_COLUMNS
    )


def choose_provider(raw_postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company and run, the postings of its pinned provider or else of the first with any.

    The choice is made on pre-aggregated (company, run) rows, so a company with
    very many postings is never gathered in one task.
    """
    order = F.array(*[F.lit(p) for p in K.PROVIDERS])
    rank = F.array_position(order, F.col("source_ats"))
    pinned = companies.select(
        F.col("slug").alias("company_slug"),
        F.array_position(order, F.col("ats")).alias("pinned"),
    ).filter("pinned > 0").dropDuplicates(["company_slug"])
    postings = raw_postings.withColumn("provider_rank", rank).filter("provider_rank > 0")
    chosen = (
        postings.groupBy("company_slug", "scraped_at")
        .agg(F.min("provider_rank").alias("first_rank"))
        .join(pinned, "company_slug", "left")
        .select(
            "company_slug", "scraped_at",
            F.coalesce("pinned", "first_rank").alias("provider_rank"),
        )
    )
    return postings.join(
        chosen, ["company_slug", "scraped_at", "provider_rank"], "left_semi"
    ).drop("provider_rank")


def track_jobs(bronze: DataFrame) -> DataFrame:
    """First seen, last seen and times seen per job."""
    return (
        bronze.filter(F.col("job_id").isNotNull())
        .groupBy("job_id")
        .agg(
            F.min("scraped_at").alias("first_seen"),
            F.max("scraped_at").alias("last_seen"),
            F.count("scraped_at").alias("times_seen"),
        )
    )


_KEY, _ROWS = "_order", "_winners"
_TOLD = ["source_ats", "company_slug", "apply_url", "departments", "is_target_role", "location", "posted_at", "title"]


def order_key(columns: list[str]) -> Column:
    """One number that orders the rows of a job: scrape time, a digest of provider, company and the other short columns, one of the rest.

    Postings of one run have the same time and may share an id across providers,
    so equal times are the rule; one order for all columns keeps a row whole.
    Rows with one number are copies, but for rare clashes of the digests.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _TOLD if c in columns]
    short = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 10), 16, 10).cast("bigint")
    rest = [F.col(c) for c in columns if c not in (*_TOLD, "job_id", "scraped_at")]
    wide = F.pmod(F.xxhash64(*rest), F.lit(1 << 23)) if rest else F.lit(0)
    digest = (F.shiftleft(short, 23) + wide).cast("decimal(19,0)")
    micros = F.coalesce(F.unix_micros(F.col("scraped_at").cast("timestamp")), F.lit(-(10**17)))
    key = (micros.cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + digest).cast("decimal(38,0)")
    # Marked as never null, for the same reason as the places of ``_listed``.
    return F.coalesce(key, F.lit("-" + "9" * 38).cast("decimal(38,0)"))


_MAP = 32768  # places in one bitmap of bitmap_construct_agg
_MOST_PLACES = 1 << 29


def _listed(rows: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """``rows`` without most of those whose ``by`` is not in ``keys``, left out before any shuffle.

    The bitmaps take 2 to 4 bytes per key (64 MB at most, as one broadcast) and
    let some 1 in 16 of the other rows pass, so the caller compares for himself.
    """
    places = min(_MOST_PLACES, max(_MAP, 1 << (16 * keys.count()).bit_length()))
    # Never null, unlike pmod: a join by what may be null asks first whether it is, and works out the keys of all rows for that.
    placed = F.xxhash64(*by).bitwiseAND(F.lit(places - 1).cast("bigint"))
    maps = stored(keys.select(placed.alias("_place")).groupBy(F.shiftright("_place", 15).alias("_map")).agg(
        F.bitmap_construct_agg(F.col("_place") % _MAP).alias("_bits")
    ), "listed")
    byte = F.substring("_bits", F.shiftright(F.col("_place") % _MAP, 3).cast("int") + 1, F.lit(1))
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, int(_place % 8))"))
    told = rows.withColumn("_place", placed).withColumn("_map", F.shiftright("_place", 15))
    return told.join(F.broadcast(maps), "_map").where(bit != 0).select(*rows.columns)


def _winners(bronze: DataFrame, conditions: dict[str, Column], columns: list[str], *more: Column) -> DataFrame:
    """Per job: the greatest order key among the rows that meet each condition, ``more``, the rows of these keys and what they hold in ``columns``.

    The keys are fixed-width numbers, so their maxima are hash aggregates that
    combine before the shuffle. They are written once, as two passes read them.
    Wide columns come in afterwards: most rows that did not win are left out
    where they are read, the others are shuffled once, to their job, and only
    with the columns that are asked for.
    """
    keyed = bronze.filter(F.col("job_id").isNotNull()).withColumn(_KEY, order_key(bronze.columns))
    named = {name: f"_k_{name}" for name in conditions}
    # The greatest key of all wins too, so every job meets a row.
    tops = keyed.groupBy("job_id").agg(
        *[F.max(F.when(c, F.col(_KEY))).alias(named[name]) for name, c in conditions.items()], F.max(_KEY).alias("_top"), *more
    )
    # Most columns are won by the top row: they are written as nulls, and no row at all as a key that no row has.
    none = F.lit("-" + "9" * 38).cast("decimal(38,0)")
    short = {k: F.when(F.col(k).isNull(), none).when(F.col(k) != F.col("_top"), F.col(k)).alias(k) for k in named.values()}
    whole = {k: F.when(F.col(k).isNull(), F.col("_top")).when(F.col(k) != none, F.col(k)).alias(k) for k in named.values()}
    written = stored(tops.select(*[short.get(c, F.col(c)) for c in tops.columns]), "winners")
    tops = written.select(*[whole.get(c, F.col(c)) for c in written.columns])
    won = F.array_distinct(F.array_compact(F.array(*named.values(), "_top")))
    keys = tops.select("job_id", F.explode(won).alias(_KEY))
    # A digest makes the choice among different rows with one key repeatable and keeps a row whole.
    rows = keyed.select("job_id", _KEY, F.xxhash64(*[c for c in bronze.columns if c != "job_id"]).alias("_tie"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    # By a merge, as the keys are far more than their file is long.
    met = _listed(rows, keys, "job_id", _KEY).join(tops.hint("merge"), "job_id").where(F.array_contains(won, F.col(_KEY)))

    def held(c: str) -> Column:
        known = (F.col(_KEY) == F.col(named[c])) & F.col(f"_c_{c}").isNotNull() if c in named else F.lit(True)
        return F.collect_set(F.when(known, F.struct(_KEY, "_tie", F.col(f"_c_{c}").alias("value")))).alias(f"_v_{c}")

    told = [F.any_value(c).alias(c) for c in tops.columns if c not in ("job_id", "_top")]
    return met.groupBy("job_id").agg(*told, F.collect_set(F.struct(_KEY, "_tie")).alias(_ROWS), *[held(c) for c in columns])


def _won(name: str, column: str) -> Column:
    rows = F.sort_array(F.filter(f"_v_{column}", lambda r: r[_KEY] == F.col(f"_k_{name}")))
    return F.get(rows, F.lit(0))["value"].alias(column)


def latest_values(bronze: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per job the last non-null value of each column, by one order of rows for all columns."""
    names = columns or [c for c in bronze.columns if c != "job_id"]
    found = _winners(bronze, {c: F.col(c).isNotNull() for c in names}, names)
    return found.select("job_id", *[_won(c, c) for c in names])


def latest_rows(bronze: DataFrame) -> DataFrame:
    """Per job the whole most recent row, NULLs kept; of equal times the one latest_values prefers."""
    others = [c for c in bronze.columns if c != "job_id"]
    found = _winners(bronze, {"row": F.lit(True)}, others)
    return found.select("job_id", *[_won("row", c) for c in others]).select(*bronze.columns)


def silver_jobs(
    bronze: DataFrame, as_of: datetime | str, active_days: int = K.ACTIVE_DAYS, columns: list[str] | None = None,
) -> DataFrame:
    """Latest values (of ``columns`` only, if given) and tracking of every job.

    Columns of fixed width are found in the same hash aggregate as their keys; with others a second pass brings the values in.
    """
    kept = [c for c in bronze.columns if c not in ("job_id", "scraped_at", "raw_json") and (columns is None or c in columns)]
    cutoff = dates.as_of_column(as_of) - F.expr(f"INTERVAL {int(active_days)} DAYS")
    seen = F.min("scraped_at").alias("first_seen"), F.max("scraped_at").alias("last_seen"), F.count("scraped_at").alias("times_seen")
    known = {c: F.col(c).isNotNull() for c in kept}
    if all(isinstance(bronze.schema[c].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for c in kept):
        keyed = bronze.filter(F.col("job_id").isNotNull()).withColumn(_KEY, order_key(bronze.columns))
        latest = keyed.groupBy("job_id").agg(*[F.max_by(c, F.when(known[c], F.col(_KEY))).alias(c) for c in kept], *seen)
    else:
        found = _winners(bronze, known, kept, *seen)
        latest = found.select("job_id", *[_won(c, c) for c in kept], *_SEEN)
    return (
        latest
        .withColumn("scraped_at", F.col("last_seen"))
        .withColumn("is_active", F.coalesce(F.col("last_seen") >= cutoff, F.lit(False)))
    )


# --- silver jobs kept up to date without old snapshots --------------------------

_SEEN = ["first_seen", "last_seen", "times_seen"]


def kept_columns(bronze: DataFrame) -> list[str]:
    return [c for c in bronze.columns if c not in ("job_id", "scraped_at", "raw_json", "scrape_date")]


def job_state(bronze: DataFrame) -> DataFrame:
    """What silver jobs are made from: per job and column the last non-null value with its order key, and the tracking.

    States of different snapshots merge to the state of all of them, so old
    snapshots need not be read again.
    """
    kept = kept_columns(bronze)
    found = _winners(
        bronze, {c: F.col(c).isNotNull() for c in kept}, kept,
        F.min("scraped_at").alias("first_seen"), F.max("scraped_at").alias("last_seen"), F.count("scraped_at").alias("times_seen"),
    )

    def told(c: str) -> Column:
        return F.when(F.col(f"_k_{c}").isNotNull(), F.struct(F.col(f"_k_{c}").alias("key"), _won(c, c).alias("value"))).alias(c)

    return found.select("job_id", *[told(c) for c in kept], *_SEEN)


def merge_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of the snapshots behind ``a`` and ``b``, which must not overlap; the order of the two does not matter.

    Each side has one row per job, so the join has no hot key.
    """
    kept = [c for c in a.columns if c not in ("job_id", *_SEEN)]
    a, b = a.alias("a"), b.alias("b")
    later = [F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in kept]
    times = (F.coalesce("a.times_seen", F.lit(0)) + F.coalesce("b.times_seen", F.lit(0))).alias("times_seen")
    return a.join(b, "job_id", "full").select(
        "job_id", *later, F.least("a.first_seen", "b.first_seen").alias("first_seen"),
        F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), times,
    )


def silver_from_state(state: DataFrame, as_of: datetime | str, active_days: int = K.ACTIVE_DAYS) -> DataFrame:
    """The rows of ``silver_jobs`` over all snapshots of the state."""
    kept = [c for c in state.columns if c not in ("job_id", *_SEEN)]
    cutoff = dates.as_of_column(as_of) - F.expr(f"INTERVAL {int(active_days)} DAYS")
    return (
        state.select("job_id", *[F.col(c)["value"].alias(c) for c in kept], *_SEEN)
        .withColumn("scraped_at", F.col("last_seen"))
        .withColumn("is_active", F.coalesce(F.col("last_seen") >= cutoff, F.lit(False)))
    )


def join_tracking(latest: DataFrame, tracking: DataFrame) -> DataFrame:
    """The plain two-table form of the same result."""
    return latest.join(tracking, "job_id", "left")


def counts_by_provider(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("source_ats").agg(F.count("*").alias("n_jobs"))


def company_summary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("company_slug").agg(
        F.count("*").alias("us_jobs"), F.count_if("is_target_role").alias("target_jobs")
    )


def silver_summary(silver: DataFrame) -> DataFrame:
    return silver.agg(
        F.count("*").alias("unique_jobs"),
        F.count_if("is_active").alias("active_jobs"),
        F.count_if("is_target_role").alias("target_jobs"),
    )


def run_summary(bronze: DataFrame) -> DataFrame:
    """One row per run: totals, companies and the count map by provider.

    Rows shrink to (run, provider, company) before the per-run step.
    """
    small = bronze.groupBy("scraped_at", "source_ats", "company_slug").agg(
        F.count("*").alias("n"), F.count_if("is_target_role").alias("t")
    )
    per_provider = small.groupBy("scraped_at", "source_ats").agg(F.sum("n").alias("n"))
    totals = small.groupBy("scraped_at").agg(
        F.sum("n").alias("total_jobs"), F.sum("t").alias("target_jobs"),
        F.count_distinct("company_slug").alias("companies_hit"),
    )
    by_ats = per_provider.filter("source_ats IS NOT NULL").groupBy("scraped_at").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_ats", "n")))).alias("by_ats")
    )
    return totals.join(by_ats, "scraped_at", "left")
