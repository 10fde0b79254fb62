"""Job index and candidate-to-job matching.

Every candidate is scored against every job, so the work is the product of the
two tables, but the pairs are never materialised. Both sides are cut into
blocks by a hash of their unique ids, each task takes one (candidate block, job
block), streams the jobs in Arrow batches past the block's candidates, and
keeps the best ``top_n`` per candidate. Only those rows are shuffled again.

Job texts are searched once per job, before the blocks, by a term index if there
are many terms: a job goes to the blocks as its id, its vector and the hashes of
the skills, roles and places it names. All
vectors must have one length; another one is an error, a missing one scores 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane.functions import text
from hireplane.functions.numbers import round4, scaled4
from hireplane.operators import term_index

INDEX_COLUMNS = [
    "job_id", "company_slug", "title", "location", "apply_url", "posted_at", "is_active",
]
SCORES = (
    "candidate_id BIGINT, job_id STRING, match_score DOUBLE, semantic_score DOUBLE,"
    " skill_overlap_score DOUBLE, role_match BOOLEAN, location_match BOOLEAN"
)


TERMS_PER_SCAN = 5000
#: Rows that one task sorts, and pairs that it scores.
JOBS_PER_BLOCK = 500_000
PAIRS_PER_TASK = 10_000_000_000
#: Candidates of one task: so many at most, and so many bytes of vectors and results.
MOST_PER_BLOCK = 32_768
BLOCK_BYTES = 240_000_000


def unit_vector(vector: Column) -> Column:
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def build_index(
    silver: DataFrame, vectors: DataFrame, max_chars: int | None = None, active_only: bool = False,
    texts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Target-role jobs with their scan text and unit vector (``vectors``: job_id, embedding).

    Where ``silver`` has the source of a text in place of it, ``texts`` brings the texts in;
    that comes last, so only target-role jobs get theirs and it need not move again.
    """
    jobs = silver.filter("is_target_role")
    if active_only:
        jobs = jobs.filter("is_active")
    jobs = jobs.join(vectors, "job_id", "left")
    return (texts(jobs) if texts else jobs).select(
        *INDEX_COLUMNS,
        text.head(text.strip_markup(F.col("description_text")), max_chars).alias("description_clean"),
        unit_vector(F.col("embedding")).cast("array<float>").alias("embedding"),
    )


def wanted_roles(target: Column, best_fit: Column) -> Column:
    return F.when(F.size(target) > 0, target).otherwise(best_fit)


def role_terms(roles: Column) -> Column:
    """Title keywords of the roles; an unknown role stands for itself."""
    known = text.literal(K.ROLE_KEYWORDS, "map<string, array<string>>")
    return F.flatten(
        F.transform(roles, lambda r: F.coalesce(F.try_element_at(known, r), F.array(F.lower(r))))
    )


def location_terms(preferred: Column) -> Column:
    """Words of the preferred places with more than two characters."""
    words = F.transform(
        preferred, lambda p: F.split(F.lower(F.replace(p, F.lit(","), F.lit(" "))), f"(?U){text.WS_CLASS}+")
    )
    return F.filter(F.flatten(words), lambda w: F.length(w) > 2)


def role_match(title: Column, roles: Column) -> Column:
    lowered = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(F.exists(role_terms(roles), lambda k: F.contains(lowered, k)), F.lit(False))


def location_match(location: Column, preferred: Column) -> Column:
    lowered = F.lower(F.coalesce(location, F.lit("")))
    return (F.size(preferred) > 0) & (
        F.contains(lowered, F.lit("remote"))
        | F.exists(location_terms(preferred), lambda w: F.contains(lowered, w))
    )


def matched_skills(skills: Column, description: Column) -> Column:
    return text.bind(
        F.lower(F.coalesce(description, F.lit(""))),
        lambda lowered: F.filter(skills, lambda s: F.contains(lowered, F.lower(s))),
    )


def skill_overlap(skills: Column, matched: Column) -> Column:
    return F.when(F.size(skills) > 0, F.size(matched) / F.size(skills)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, for a few pairs; matching uses matrix products."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def match_score(semantic: Column, skill: Column, role: Column, location: Column) -> Column:
    return round4(
        K.W_SEMANTIC * semantic + K.W_SKILL * skill + K.W_ROLE * role.cast("double")
        + K.W_LOCATION * location.cast("double")
    )


# --- score terms that are only documented, off by default --------------------

def title_level(title: Column) -> Column:
    """Seniority of a job title, 1 to 5, by whole words; the highest word wins, no word is mid level."""
    lowered = F.lower(F.coalesce(title, F.lit("")))
    out = None
    for level, words in K.TITLE_LEVELS:
        hit = lowered.rlike(rf"\b({'|'.join(words)})\b")
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise(K.TITLE_LEVEL_DEFAULT)


def seniority_gap(title: Column, candidate: Column) -> Column:
    """Levels that the job stands above the candidate, 0 if none or if the candidate's level is unknown."""
    place = F.array_position(F.array(*[F.lit(x) for x in K.SENIORITY_LEVELS]), candidate).cast("int")
    return F.when(place > 0, F.greatest(F.lit(0), title_level(title) - place)).otherwise(0)


def off_target(title: Column, roles: Column) -> Column:
    """The title names a known role, and none that the candidate wants; false without wanted roles."""
    known = F.array(*[F.lit(r) for r in K.ROLE_KEYWORDS])
    return F.coalesce((F.size(roles) > 0) & role_match(title, known) & ~role_match(title, roles), F.lit(False))


def documented_score(
    semantic: Column, skill: Column, role: Column, location: Column, gap: Column, off: Column,
) -> Column:
    """Match score with both penalties and a floor of 0; null for a job two or more levels above the candidate."""
    penalty = F.when(gap == 1, K.SENIORITY_PENALTY).otherwise(0.0) + F.when(off, K.OFF_TARGET_PENALTY).otherwise(0.0)
    score = (
        K.W_SEMANTIC * semantic + K.W_SKILL * skill + K.W_ROLE * role.cast("double")
        + K.W_LOCATION * location.cast("double") - penalty
    )
    return F.when(gap < 2, round4(F.greatest(F.lit(0.0), score)))


# --- the block task ----------------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a missing vector scores 0 everywhere."""
    good = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if width:
        out[good] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _term_matrix(term_lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and a terms-by-candidates matrix of counts."""
    owner, values = _flat(term_lists)
    terms, place = np.unique(values, return_inverse=True)
    out = np.zeros((len(terms), len(term_lists)))
    np.add.at(out, (place, owner), 1)
    return terms, out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every item."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _classes(*columns: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold each distinct combination of values first, and for every row the number of its combination."""
    numbers: dict[str, int] = {}
    first, of = [], []
    for k, row in enumerate(zip(*[column.to_pylist() for column in columns])):
        n = numbers.setdefault(repr(row), len(numbers))
        if n == len(first):
            first.append(k)
        of.append(n)
    return np.array(first, dtype=np.int64), np.array(of, dtype=np.int64)


def _hits(found: pa.ListArray, terms: np.ndarray) -> np.ndarray:
    """Jobs-by-terms 0/1 matrix of the terms that each job names."""
    out = np.zeros((len(found), len(terms)))
    owner, values = _flat(found)
    if len(terms) and len(values):
        at = np.minimum(np.searchsorted(terms, values), len(terms) - 1)
        known = terms[at] == values
        out[owner[known], at[known]] = 1
    return out


class _Block:
    """The candidates of one block and their best jobs so far.

    Every pair is scored, but exactly only where it may count: single precision and a bound on
    its error tell which pairs cannot beat a candidate's ``top_n``-th score so far.
    """

    BATCH_CELLS = 2_000_000

    def __init__(self, rows: pa.Table, top_n: int):
        self.top_n = top_n
        self.ids = np.array(rows["candidate_id"].to_pylist(), dtype=np.int64)
        vectors = rows["embedding"].combine_chunks()
        self.width = pc.max(pc.list_value_length(vectors)).as_py() or 0
        self.vectors = _matrix(vectors, self.width)
        self.near = (K.W_SEMANTIC * self.vectors).astype(np.float32).T.copy()
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        # Candidates of the same terms are told against a job once.
        skills, self.skill_of = _classes(rows["skills"])
        roles, self.role_of = _classes(rows["roles"])
        places, self.place_of = _classes(rows["places"], rows["has_place"])
        self.skills, self.skill_count = _term_matrix(rows["skills"].combine_chunks().take(skills))
        self.n_skills = np.maximum(self.skill_count.sum(0), 1)
        self.roles, self.role_count = _term_matrix(rows["roles"].combine_chunks().take(roles))
        self.places, self.place_count = _term_matrix(rows["places"].combine_chunks().take(places))
        self.has_place = np.array(rows["has_place"].take(places).to_pylist(), dtype=bool)
        told = np.stack([self.skill_of, self.role_of, self.place_of], axis=1)
        (self.told, self.told_of) = np.unique(told, axis=0, return_inverse=True)
        self.told_of = self.told_of.ravel()
        self.floor = np.full(len(self.ids), np.iinfo(np.int64).min)
        self.bound = np.full(len(self.ids), -np.inf)
        self.seen = 0
        self.jobs: dict[int, str] = {}
        self.best: list[np.ndarray] = []
        self.pending = 0

    def add(self, jobs: pa.RecordBatch) -> None:
        step = max(1, self.BATCH_CELLS // max(1, len(self.ids)))
        for start in range(0, jobs.num_rows, step):
            self._score(jobs.slice(start, step))

    def _score(self, jobs: pa.RecordBatch) -> None:
        vectors = _matrix(jobs["embedding"], self.width)
        skill = _hits(jobs["skills"], self.skills) @ self.skill_count / self.n_skills
        role = _hits(jobs["roles"], self.roles) @ self.role_count > 0
        place = _hits(jobs["places"], self.places) @ self.place_count > 0
        place |= jobs["remote"].to_numpy(zero_copy_only=False).astype(bool)[:, None] & self.has_place[None, :]
        rest = (
            K.W_SKILL * skill[:, self.told[:, 0]] + K.W_ROLE * role[:, self.told[:, 1]] + K.W_LOCATION * place[:, self.told[:, 2]]
        ).astype(np.float32)
        near = np.take(rest, self.told_of, axis=1)
        if self.width:
            near += vectors.astype(np.float32) @ self.near
        longest = np.sqrt((vectors * vectors).sum(1).max(initial=0))
        # Rounding in single precision, of the products and of the sums, and of the bound itself.
        error = (self.width + 16) * 2.0**-23 * (1 + K.W_SEMANTIC * longest * self.norms)
        j, c = np.nonzero(~(near <= (self.bound - error).astype(np.float32)[None, :]))
        semantic = self._semantic(vectors, j, c)
        skill, role, place = skill[j, self.skill_of[c]], role[j, self.role_of[c]], place[j, self.place_of[c]]
        total = (
            K.W_SEMANTIC * semantic + K.W_SKILL * skill + K.W_ROLE * role + K.W_LOCATION * place
        )
        # Rounded score first, then arrival order: jobs arrive by ascending id.
        seq = self.seen + j
        key = (scaled4(total) << 40) - seq
        kept = key > self.floor[c]
        found = np.rec.fromarrays(
            [x[kept] for x in (c.astype(np.int32), key, seq.astype(np.int32), semantic, skill, role, place)], names="c,key,seq,semantic,skill,role,place"
        )
        self.best.append(found)
        ids = jobs["job_id"]
        for i in np.unique(j[kept]).tolist():
            self.jobs[self.seen + i] = ids[i].as_py()
        self.seen += jobs.num_rows
        self.pending += len(found)
        if self.pending > max(self.BATCH_CELLS, 2 * self.top_n * len(self.ids)):
            self._compact()

    def _semantic(self, vectors: np.ndarray, j: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Similarity of the pairs (j, c); of few pairs without the whole product."""
        if not self.width:
            return np.zeros(len(j))
        if 16 * len(j) > len(vectors) * len(self.ids):
            return (vectors @ self.vectors.T)[j, c]
        step = max(1, self.BATCH_CELLS // self.width)
        parts = [np.einsum("ij,ij->i", vectors[j[k:k + step]], self.vectors[c[k:k + step]]) for k in range(0, len(j), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _compact(self) -> np.ndarray:
        rows = np.concatenate(self.best)
        rows = rows[np.lexsort((-rows["key"], rows["c"]))]
        first = np.searchsorted(rows["c"], np.arange(len(self.ids)))
        rank = np.arange(len(rows)) - first[rows["c"]]
        last = rows[rank == self.top_n - 1]
        self.floor[last["c"]] = last["key"]
        # What rounds to the last score or less comes after it: its job arrives later.
        self.bound[last["c"]] = (((last["key"] + last["seq"]) >> 40) + 0.499) / 10_000
        kept = rows[rank < self.top_n]
        self.best, self.pending = [kept], 0
        self.jobs = {s: self.jobs[s] for s in np.unique(kept["seq"]).tolist()}
        return kept

    def result(self) -> Iterator[pa.RecordBatch]:
        if not self.best:
            return
        rows = self._compact()
        score = ((rows["key"] + rows["seq"]) >> 40) / 10_000
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[rows["c"]]),
                pa.array([self.jobs[s] for s in rows["seq"].tolist()], type=pa.string()),
                pa.array(score),
                pa.array(scaled4(rows["semantic"]) / 10_000),
                pa.array(scaled4(rows["skill"]) / 10_000),
                pa.array(rows["role"]),
                pa.array(rows["place"]),
            ],
            names=[
                "candidate_id", "job_id", "match_score", "semantic_score", "skill_overlap_score",
                "role_match", "location_match",
            ],
        )


def _block_task(top_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by block, candidates before jobs, jobs by id.
        current, waiting, block = None, [], None
        for batch in batches:
            ids = batch["block"].to_numpy(zero_copy_only=False)
            is_job = batch["is_job"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(is_job.astype(int)) != 0)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if ids[start] != current:
                    if block is not None:
                        yield from block.result()
                    current, waiting, block = ids[start], [], None
                if not is_job[start]:
                    waiting.append(part)
                elif waiting or block is not None:
                    if block is None:
                        block, waiting = _Block(pa.Table.from_batches(waiting), top_n), []
                    block.add(part)
        if block is not None:
            yield from block.result()

    return run


def block_counts(n_candidates: int, n_jobs: int, width: int, top_n: int, parallelism: int, partitions: int) -> tuple[int, int]:
    """Candidate blocks and job blocks, so that tasks stay within bounds and few bytes are copied.

    A job is copied to every candidate block, a candidate and its ``top_n`` results to every job block. For a
    number of tasks (some per core; more where one would have over ``PAIRS_PER_TASK`` pairs) their product is
    given, and the copies are fewest where both sides come to the same bytes.
    """
    per_block = max(1, min(MOST_PER_BLOCK, BLOCK_BYTES // (8 * width + 102 * top_n + 500)))
    fewest = max(1, math.ceil(n_candidates / per_block))
    job_blocks = max(1, math.ceil(n_jobs / JOBS_PER_BLOCK))
    tasks = max(min(partitions, 4 * parallelism), math.ceil(n_candidates * n_jobs / PAIRS_PER_TASK), fewest * job_blocks)
    job_bytes = n_jobs * (60 + 4 * width)
    candidate_bytes = n_candidates * (150 + 4 * width + 12 * top_n)
    even = round(math.sqrt(tasks * candidate_bytes / max(1, job_bytes)))
    candidate_blocks = min(max(fewest, even), max(fewest, tasks // job_blocks), max(1, n_candidates))
    return candidate_blocks, max(job_blocks, math.ceil(tasks / candidate_blocks))


def one_width(profiles: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with their vectors checked, while they are read, against the index's one length."""
    width = index.agg(F.max(F.size("embedding"))).scalar()

    def checked(df: DataFrame, key: str) -> DataFrame:
        n = F.size("embedding")
        bad = F.raise_error(F.concat(F.lit(f"the vector of {key} "), F.col(key).cast("string"), F.lit(" has another length: "), n.cast("string")))
        vector = F.when(F.col("embedding").isNull(), None).when((width < 0) | (n == width), F.col("embedding")).otherwise(bad.cast("array<float>"))
        return df.withColumn("embedding", vector.cast("array<float>"))

    return checked(profiles, "candidate_id"), checked(index, "job_id")


def _hashes(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


FIELDS = {"skills": "description_clean", "roles": "title", "places": "location"}


def named_terms(index: DataFrame, candidates: DataFrame, most_scanned: int = TERMS_PER_SCAN) -> DataFrame:
    """job_id with ``skills``, ``roles``, ``places``: hashes of the candidates' distinct terms that the job names.

    ``candidates`` has arrays of lower-case terms under the same names. Up to
    ``most_scanned`` terms are searched one by one in the row of the job; more go
    through a term index, whose cost does not grow with their number.
    """
    terms = None
    for kind in FIELDS:
        part = candidates.select(F.lit(kind).alias("kind"), F.explode(kind).alias("term")).distinct()
        terms = part if terms is None else terms.unionAll(part)
    if terms.count() > most_scanned:
        return indexed_terms(index, terms)
    wanted = {
        kind: terms.where(F.col("kind") == kind).agg(F.sort_array(F.collect_set("term"))).scalar() for kind in FIELDS
    }
    beside = index.select("job_id", *FIELDS.values(), *[w.alias(kind) for kind, w in wanted.items()])

    def found(kind: str, field: str) -> Column:
        return text.bind(
            F.lower(F.coalesce(field, F.lit(""))),
            lambda body: _hashes(F.filter(kind, lambda t: F.contains(body, t))),
        )

    return beside.select("job_id", *[found(kind, field).alias(kind) for kind, field in FIELDS.items()])


def indexed_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``named_terms`` by term index; each kind's texts are read once."""
    pairs = None
    for kind, field in FIELDS.items():
        texts = index.select("job_id", F.lower(field).alias("body"))
        part = term_index.contained_terms(texts, terms.where(F.col("kind") == kind), "job_id", "body")
        part = part.select(F.col("id").alias("job_id"), F.lit(kind).alias("kind"), F.xxhash64("term").alias("h"))
        pairs = part if pairs is None else pairs.unionAll(part)
    lists = pairs.groupBy("job_id").agg(
        *[F.collect_set(F.when(F.col("kind") == kind, F.col("h"))).alias(kind) for kind in FIELDS]
    )
    none = F.array().cast("array<bigint>")
    return index.select("job_id").join(lists, "job_id", "left").select(
        "job_id", *[F.coalesce(kind, none).alias(kind) for kind in FIELDS]
    )


def score_pairs(
    profiles: DataFrame, index: DataFrame, top_n: int, candidate_blocks: int | None = None,
    job_blocks: int | None = None, most_scanned: int = TERMS_PER_SCAN,
) -> DataFrame:
    """Best ``top_n`` jobs of every candidate within each (candidate block, job block)."""
    rows = block_rows(profiles, index, candidate_blocks, job_blocks, most_scanned, top_n)
    return rows.mapInArrow(_block_task(top_n), SCORES)


def block_rows(
    profiles: DataFrame, index: DataFrame, candidate_blocks: int | None = None, job_blocks: int | None = None,
    most_scanned: int = TERMS_PER_SCAN, top_n: int = 20,
) -> DataFrame:
    """Slim rows of both tables, one copy for each block they meet in, sorted by block.

    Blocks are measured where they are not given: by the rows of both tables, the
    length of the vectors and ``top_n``.
    """
    spark = profiles.sparkSession
    if candidate_blocks is None or job_blocks is None:
        people = profiles.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        counted = block_counts(
            people.n, index.count(), max(0, people.width or 0), top_n, spark.sparkContext.defaultParallelism, partitions
        )
        candidate_blocks = candidate_blocks or counted[0]
        job_blocks = job_blocks or counted[1]
    roles = wanted_roles(F.col("target_roles"), F.col("best_fit_roles"))
    profiles, index = one_width(profiles, index)

    def block_of(name: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    asked = profiles.select(
        "candidate_id", "embedding",
        F.coalesce(F.transform("technical_skills", F.lower), F.array().cast("array<string>")).alias("skills"),
        F.coalesce(role_terms(roles), F.array().cast("array<string>")).alias("roles"),
        F.coalesce(location_terms(F.col("preferred_locations")), F.array().cast("array<string>")).alias("places"),
        F.coalesce(F.size("preferred_locations") > 0, F.lit(False)).alias("has_place"),
    )
    named = named_terms(index, asked, most_scanned)
    candidates = asked.select(
        "candidate_id", "embedding", *[_hashes(F.col(c)).alias(c) for c in ("skills", "roles", "places")], "has_place",
        block_of("candidate_id", candidate_blocks).alias("cb"), every(job_blocks).alias("jb"),
    ).withColumn("is_job", F.lit(False))
    jobs = index.select(
        "job_id", "embedding", F.contains(F.lower(F.coalesce("location", F.lit(""))), F.lit("remote")).alias("remote"),
    ).join(named, "job_id").select(
        "job_id", "embedding", "remote", "skills", "roles", "places",
        block_of("job_id", job_blocks).alias("jb"), every(candidate_blocks).alias("cb"),
    ).withColumn("is_job", F.lit(True))
    block = (F.col("cb") * F.lit(job_blocks) + F.col("jb")).cast("int")
    return (
        candidates.unionByName(jobs, allowMissingColumns=True)
        .withColumn("block", block)
        .drop("cb", "jb")
        .repartitionById(candidate_blocks * job_blocks, F.col("block"))
        .sortWithinPartitions("block", "is_job", "job_id")
    )


def top_matches(scores: DataFrame, top_n: int) -> DataFrame:
    w = Window.partitionBy("candidate_id").orderBy(F.desc("match_score"), "job_id")
    return scores.withColumn("match_rank", F.row_number().over(w)).filter(F.col("match_rank") <= top_n)


def match_candidates(
    profiles: DataFrame, index: DataFrame, top_n: int = 20,
    candidate_blocks: int | None = None, job_blocks: int | None = None,
) -> DataFrame:
    """The best ``top_n`` jobs of every candidate, with job columns and matched skills.

    ``profiles`` needs candidate_id, technical_skills, target_roles,
    best_fit_roles, preferred_locations and a unit vector ``embedding``.
    Further columns of ``index`` are carried along.
    """
    scores = score_pairs(profiles, index, top_n, candidate_blocks, job_blocks)
    best = top_matches(scores, top_n)
    jobs = index.drop("embedding").withColumnRenamed("description_clean", "description_text")
    extra = [c for c in jobs.columns if c not in INDEX_COLUMNS and c != "description_text"]
    # The skills come before the texts: rows that hold a text do not move again.
    return (
        best.join(profiles.select("candidate_id", "technical_skills"), "candidate_id")
        .join(jobs, "job_id")
        .select(
            "candidate_id", "job_id", "company_slug", "title", "location", "apply_url", "posted_at",
            "description_text", "match_score", "semantic_score", "skill_overlap_score",
            "role_match", "location_match",
            matched_skills(F.col("technical_skills"), F.col("description_text")).alias("matched_skills"),
            "match_rank", *extra,
        )
    )
