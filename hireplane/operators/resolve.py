"""Employer lookup by exact, prefix and contained name.

Every tier is an equi-join. Name pieces are exploded and reduced to the best
employer per piece before they meet the asked-for keys, so no pairs of keys and
employers are ever formed and a piece shared by very many employers combines
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane.functions import text
from hireplane.operators import scoring
from hireplane.operators.filings import EMPLOYER

ANCHOR = 5
#: Keys of fewer characters are not looked for inside names.
LEAST_CONTAINED = 5


def _names(history: DataFrame) -> DataFrame:
    """Names with their sort key: most certifications first, then the name."""
    volume = F.coalesce(F.col("total_perm_certified"), F.lit(-1))
    return history.select(EMPLOYER, F.struct((-volume).alias("neg"), F.col(EMPLOYER)).alias("best"))


def start_rows(names: DataFrame) -> DataFrame:
    """Per beginning of a name (the empty one and the whole name included) the best employer: tier 1 is the name itself, else 2."""
    return names.select(
        EMPLOYER, "best", F.explode(F.sequence(F.lit(0), F.length(EMPLOYER))).alias("n")
    ).select(
        F.substring(F.col(EMPLOYER), F.lit(1), F.col("n")).alias("key"),
        F.struct(
            F.when(F.col("n") == F.length(EMPLOYER), 1).otherwise(2).alias("tier"), "best"
        ).alias("hit"),
    ).groupBy("key").agg(F.min("hit").alias("hit"))


def names_starting_with(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Best employer that is the key (tier 1) or starts with it (tier 2; the empty key included).

    One pass over all name prefixes, reduced to one row per prefix before the join.
    """
    return start_rows(names).join(keys, "key", "left_semi")


def names_that_start(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Best employer whose name is a prefix of the key."""
    return key_starts(keys).join(names, EMPLOYER).groupBy("key").agg(F.min("best").alias("best"))


def key_starts(keys: DataFrame) -> DataFrame:
    """The beginnings of every key, under the name of the employer that they may be."""
    return keys.filter("key <> ''").select(
        "key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")
    ).select("key", F.substring(F.col("key"), F.lit(1), F.col("n")).alias(EMPLOYER))


def piece_rows(names: DataFrame, shortest: int) -> DataFrame:
    """The pieces of all names that are as long as an anchor, ``shortest`` to ``ANCHOR`` characters, with their place."""
    sizes = F.array(*[F.lit(s) for s in range(min(shortest, ANCHOR), ANCHOR + 1)])
    return (
        names.select(EMPLOYER, "best", F.explode(sizes).alias("size"))
        .filter(F.length(EMPLOYER) >= F.col("size"))
        .select(
            EMPLOYER, "best", "size",
            F.explode(
                F.sequence(
                    F.lit(1),
                    F.when(F.col("size") == 0, 1).otherwise(F.length(EMPLOYER) - F.col("size") + 1),
                )
            ).alias("pos"),
        )
        .select(
            EMPLOYER, "best", "pos",
            F.substring(F.col(EMPLOYER), F.col("pos"), F.col("size")).alias("piece"),
        )
    )


def key_anchors(keys: DataFrame) -> DataFrame:
    """The distinct (first characters, length) of the keys."""
    size = F.least(F.length("key"), F.lit(ANCHOR))
    return keys.select(
        F.substring(F.col("key"), F.lit(1), size).alias("piece"), F.length("key").alias("n")
    ).distinct()


def best_containing(keys: DataFrame, pieces: DataFrame) -> DataFrame:
    return (
        pieces.join(key_anchors(keys), "piece")
        .filter(F.col("pos") + F.col("n") - 1 <= F.length(EMPLOYER))
        .select(F.substring(F.col(EMPLOYER), F.col("pos"), F.col("n")).alias("key"), "best")
        .groupBy("key").agg(F.min("best").alias("best"))
        .join(keys, "key", "left_semi")
    )


def names_containing(keys: DataFrame, names: DataFrame, shortest: int) -> DataFrame:
    """Best employer whose name contains the key, for keys of ``shortest`` characters or more.

    A key's first characters (its anchor) meet the same-sized pieces of the
    names; a hit is then cut to the key's length and compared as a whole. The
    join carries one row per distinct (anchor, length), not per key.
    """
    return best_containing(keys.filter(F.length("key") >= shortest), piece_rows(names, shortest))


def first_tier(hits: DataFrame, tiered: dict[int, DataFrame]) -> DataFrame:
    """Per key the best of ``hits`` and of the employers found in further tiers."""
    for tier, found in tiered.items():
        hits = hits.unionByName(
            found.select("key", F.struct(F.lit(tier).alias("tier"), "best").alias("hit"))
        )
    return (
        hits.groupBy("key")
        .agg(F.min("hit").alias("hit"))
        .select("key", "hit.tier", F.col(f"hit.best.{EMPLOYER}").alias(EMPLOYER))
    )


def resolve_names(keys: DataFrame, history: DataFrame, both_directions: bool) -> DataFrame:
    """Per key the first tier that hits: 1 exact, 2 prefix, 3 contained (more than 4 characters).

    Within a tier the employer with most certifications wins, then the name.
    """
    keys = keys.select("key").filter("key IS NOT NULL").distinct()
    names = _names(history)
    tiered = {3: names_containing(keys, names, LEAST_CONTAINED)}
    if both_directions:
        tiered[2] = names_that_start(keys, names)
    return first_tier(names_starting_with(keys, names), tiered)


def resolve_slugs(slugs: DataFrame, history: DataFrame) -> DataFrame:
    """Scoring variant: the slug as it stands, prefixes in both directions."""
    keys = slugs.select(F.col("company_slug").alias("key"))
    return resolve_names(keys, history, True).withColumnRenamed("key", "company_slug")


def asked_names(queries: DataFrame) -> DataFrame:
    return queries.select("name", text.normalize_company(F.col("name")).alias("key")).distinct()


def resolve_queries(queries: DataFrame, history: DataFrame) -> DataFrame:
    """Query variant: ``name`` is normalised first and prefixes go one way."""
    asked = asked_names(queries)
    return asked.join(resolve_names(asked, history, False), "key", "left")


def company_evidence(slugs: DataFrame, history: DataFrame) -> DataFrame:
    """One evidence row per distinct slug; unknown employers get neutral evidence."""
    slugs = slugs.select("company_slug").filter("company_slug IS NOT NULL").distinct()
    facts = history.select(
        EMPLOYER,
        scoring.employer_base(
            F.col("total_perm_certified"), F.col("uscis_total_approvals"),
            F.col("trend_direction"), F.col("data_freshness_score"),
        ).alias("base_score"),
        F.coalesce("total_perm_certified", F.lit(0)).cast("bigint").alias("perm_total"),
        F.coalesce("trend_direction", F.lit("insufficient_data")).alias("trend"),
        F.coalesce("data_freshness_score", F.lit(0.0)).alias("freshness"),
    )
    found = resolve_slugs(slugs, history).join(facts, EMPLOYER)
    return slugs.join(found, "company_slug", "left").select(
        "company_slug",
        F.coalesce("base_score", F.lit(K.UNKNOWN_EMPLOYER_BASE)).alias("base_score"),
        F.coalesce("perm_total", F.lit(0)).alias("perm_total"),
        F.coalesce("trend", F.lit("unknown")).alias("trend"),
        F.coalesce("freshness", F.lit(0.0)).alias("freshness"),
    )


def coverage_audit(companies: DataFrame, history: DataFrame) -> DataFrame:
    """Scraped companies against the history: best employer containing the display name."""
    asked = companies.select(
        "slug", "display_name", text.normalize_company(F.col("display_name")).alias("key")
    )
    keys = asked.select("key").distinct()
    hits = names_containing(keys, _names(history), 0).select(
        "key", F.col(f"best.{EMPLOYER}").alias(EMPLOYER)
    )
    facts = history.select(
        EMPLOYER, "total_perm_certified", "trend_direction", "data_freshness_score"
    )
    return (
        asked.join(hits.join(facts, EMPLOYER), "key", "left")
        .select(
            "slug", "display_name", F.col(EMPLOYER).isNotNull().alias("found"), EMPLOYER,
            F.coalesce("total_perm_certified", F.lit(0)).alias("certified"), "trend_direction",
            F.coalesce("data_freshness_score", F.lit(0.0)).alias("freshness"),
        )
    )
