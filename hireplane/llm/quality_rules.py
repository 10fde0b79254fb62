"""Rule bitmask ledger: every rule is evaluated once per document and leaves a bit; policies are masks.

The ledger holds the measurements and one long ``failed`` whose bit i is set
when rule i fails. A policy is a versioned list of rules, so its verdict is
``failed & mask = 0`` and no text is read again. Ablations come from counts per
distinct ``failed`` value, of which there are at most 2 ** number of rules.

Null text counts as empty. Empty and null texts have no words, so ``min_words``
fails. Repeated rows are separate rows. Columns of the input that share a name
with a measurement are left out; the id column is kept under its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireplane.functions.text import bind

SPACE = " \t\n\x0b\f\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs",
    "n_bars",
]


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements."""

    name: str
    fails: str


#: A rule's place is its bit. New rules go to the end; old bits keep their meaning.
RULES = [
    Rule("min_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("exclamations", "10 * n_bangs > n_words"),
    Rule("bars", "100 * n_bars > 10 * n_words"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
    Rule("repeated_most", "100 * n_repeat_words > 30 * n_words"),
]
POLICIES = {
    "base": ["min_words", "repeated_words"],
    "v1": ["min_words", "repeated_words", "symbols", "shouting", "exclamations", "bars", "word_length"],
    "v2": [
        "min_words", "repeated_words", "symbols", "shouting", "exclamations", "bars", "word_length",
        "repeated_lines", "repeated_most",
    ],
}


def mask(names: list[str], rules: list[Rule] = RULES) -> int:
    places = {rule.name: i for i, rule in enumerate(rules)}
    return sum(1 << places[name] for name in names)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    A window becomes one long, hash above position, so one sort brings equal
    windows together; neighbours with the same hash part are compared by their
    words. The position takes only the bits that the text needs.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("bigint")))

    def windows(bits: Column) -> Column:
        packed = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("bigint")),
        )
        return bind(F.sort_array(packed), lambda s: covered(s, bits))

    def covered(s: Column, bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        at = lambda j: F.get(s, j).bitwiseAND(low).cast("int")
        high = lambda j: F.call_function("shiftright", F.get(s, j), bits)

        def same(j: Column) -> Column:
            words_equal = (F.get(words, at(j)) == F.get(words, at(j - 1))) & (
                F.get(words, at(j) + 1) == F.get(words, at(j - 1) + 1)
            ) & (F.get(words, at(j) + 2) == F.get(words, at(j - 1) + 2))
            return (high(j) == high(j - 1)) & words_equal

        pairs = F.filter(F.when(F.size(s) > 1, F.sequence(F.lit(1), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), same)
        places = bind(pairs, lambda js: F.sort_array(F.array_union(F.transform(js, at), F.transform(js, lambda j: at(j - 1)))))
        return bind(places, total)

    def total(p: Column) -> Column:
        gaps = F.aggregate(
            F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(3).cast("bigint"),
            lambda acc, j: acc + F.least(F.lit(3), F.get(p, j) - F.get(p, j - 1)),
        )
        return F.when(F.size(p) == 0, F.lit(0).cast("bigint")).otherwise(gaps)

    return F.when(n < 3, F.lit(0).cast("bigint")).otherwise(bind(bits, windows))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its id and all measurements; no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("bigint")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        )

    once = docs.select(
        F.col(id_col),
        F.explode(F.array(F.struct(
            bind(_words(text), of_words).alias("w"),
            bind(lines, of_lines).alias("l"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            count(r"\p{Lu}").alias("n_upper"),
            count(r"!").alias("n_bangs"),
            count(r"\|").alias("n_bars"),
        ))).alias("m"),
    )
    places = {"n_words": "m.w", "word_chars": "m.w", "n_repeat_words": "m.w", "n_lines": "m.l", "n_dup_lines": "m.l"}
    return once.select(id_col, *[F.col(f"{places.get(m, 'm')}.{m}").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and the long ``failed`` with one bit per failed rule."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, rule in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(docs, id_col, text_col).withColumn("failed", failed)


def passes(policy: list[str], rules: list[Rule] = RULES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("bigint")) == 0


def apply_policies(entries: DataFrame, policies: dict[str, list[str]] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """The ledger with one boolean column ``kept_<version>`` per policy."""
    return entries.select("*", *[passes(names, rules).alias(f"kept_{version}") for version, names in policies.items()])


def ablations(entries: DataFrame, policies: dict[str, list[str]] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """Per policy and left-out rule: documents kept with all rules and without that one.

    Works on counts per distinct ``failed`` value. A ledger without rows gives zeros.
    """
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))
    wanted = [
        F.struct(
            F.lit(version).alias("policy"), F.lit(left_out).alias("without"),
            F.lit(mask(names, rules)).cast("bigint").alias("full"),
            F.lit(mask([x for x in names if x != left_out], rules)).cast("bigint").alias("rest"),
        )
        for version, names in policies.items() for left_out in names
    ]
    spark = entries.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*wanted)).alias("w")).select("w.*")
    hit = lambda m: F.sum(F.when(F.col("failed").bitwiseAND(F.col(m)) == 0, F.col("n")).otherwise(0))
    found = counts.withColumn("w", F.explode(F.array(*wanted))).select("failed", "n", "w.*")
    sums = found.groupBy("policy", "without").agg(hit("full").alias("kept"), hit("rest").alias("kept_without"))
    return (
        grid.select("policy", "without").join(sums, ["policy", "without"], "left")
        .select("policy", "without", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("kept_without", F.lit(0)).alias("kept_without"))
        .withColumn("rejected_only_by", F.col("kept_without") - F.col("kept"))
    )
