"""Poisson replication: sources are mixed to target weights by a random number of copies per document.

A source with target weight w, of W in total, should give w / W of the output.
With N documents in all and n in the source its mean repetition rate is
``w / W * size * N / n``. A document's count of copies is the inverse Poisson
distribution at a number in [0, 1) hashed from seed and id, so a rerun and any
partitioning give the same copies.

Null sources form one source. Documents with a null id share one hash. Sources
without a target weight take ``default_weight``; a weight of 0 drops a source.
Repeated rows with the same id get the same count. An empty table stays empty.
Rates may be large (one document of a source with a large weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies carry these columns beside those of the document.
COPY, ORDER = "copy", "shuffle_key"
BROADCAST_SOURCES = 2000
SALTS = 64


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def least_count(rate: Column) -> Column:
    """A count so far below the rate that the distribution up to it is nothing; 0 for rates up to 216."""
    return F.greatest(F.lit(0), F.floor(rate - 12 * F.sqrt(rate) - 40)).cast("bigint")


def poisson_cdf(rate: Column, least: Column) -> Column:
    """P(least <= X <= k) for k = least, least + 1, ... as far as a double below 1 can reach.

    The first term is exp(-rate) at 0, and else taken from its logarithm
    (Stirling's series), as exp(-rate) is 0 for rates over 745.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("bigint")
    k0 = least.cast("double")
    factorial = k0 * F.log(k0) - k0 + 0.5 * F.log(2 * F.pi() * k0) + 1 / (12 * k0) - 1 / (360 * F.pow(k0, F.lit(3.0)))
    first = F.when(least == 0, F.exp(-rate)).otherwise(F.exp(k0 * F.log(rate) - rate - factorial))
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(least + 1, last), start, step)["cdf"]


def rates(
    docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0,
    source_col: str = "source",
) -> DataFrame:
    """source, n, rate and Poisson distribution per source; counted over all documents with map-side sums."""
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("_source") == name, F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    all_n, all_weight = counts.select(F.sum("n")).scalar(), counts.select(F.sum("weight")).scalar()
    out = counts.withColumn("all_n", all_n).withColumn("all_weight", all_weight)
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    out = out.withColumn("rate", share * F.lit(float(size)) * F.col("all_n") / F.col("n"))
    out = out.withColumn("_least", least_count(F.col("rate")))
    return out.select("_source", "n", "rate", "_least", F.explode(F.array(poisson_cdf(F.col("rate"), F.col("_least")))).alias("_cdf"))


def counted(
    docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0,
    seed: int = 17, id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """The documents with their number of copies in the last column, ``_count`` (with more ``_`` if that is taken).

    Up to ``BROADCAST_SOURCES`` rows of rates (counted, about 1 kB each) are
    broadcast, so no text is shuffled by source; beyond, the join is salted.
    """
    by_source = rates(docs, weights, default_weight, size, source_col)
    if docs.select(source_col).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(by_source), docs[source_col].eqNullSafe(by_source["_source"]), "left")
    else:
        salt = F.pmod(F.xxhash64(docs[id_col]), F.lit(SALTS)).cast("int")
        by_source = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(by_source, docs[source_col].eqNullSafe(by_source["_source"]) & (salt == by_source["_salt"]), "left")
    u = unit(seed, docs[id_col])
    count = (by_source["_least"] + F.size(F.filter(by_source["_cdf"], lambda c: c <= u))).cast("int")
    name = "_count"
    while name in docs.columns:
        name = "_" + name
    return joined.select(*[docs[c] for c in docs.columns], count.alias(name))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0,
    seed: int = 17, id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """Copies of the documents in a global random order, with ``copy`` (from 1) and ``shuffle_key``.

    Input columns named like these two are replaced.
    """
    keep = [c for c in docs.columns if c not in (COPY, ORDER)]
    copies = counted(docs.select(*keep), weights, default_weight, size, seed, id_col, source_col)
    count = F.col(copies.columns[-1])
    copies = copies.where(count > 0).select(*keep, F.explode(F.sequence(F.lit(1), count)).alias(COPY))
    copies = copies.withColumn(ORDER, unit(seed + 1, F.col(id_col), F.col(COPY)))
    return copies.orderBy(ORDER, id_col, COPY)
