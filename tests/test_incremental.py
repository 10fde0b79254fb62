"""Silver jobs and tracking kept up to date day by day, against all snapshots at once."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_tables import bronze, one_run

from hireplane.operators import postings
from hireplane.plans import incremental
from hireplane.session import written_folders
from hireplane.sources import readers, writers
from hireplane.streaming import tracking

AS_OF = "2024-01-31 00:00:00"


def day_rows(spark, days, seed=1, jobs=30):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.3 else v
    return bronze(spark, [
        dict(job_id=None if rng.random() < 0.02 else f"j{rng.randrange(jobs)}", scraped_at=datetime(2024, 1, d, rng.choice([0, 6])),
             title=maybe(f"T{rng.randrange(4)}"), location=maybe(f"L{rng.randrange(4)}"), is_target_role=maybe(rng.random() < 0.5),
             description_html=maybe(f"<p>{rng.random()}"), description_text=maybe(f"{rng.random()}"), company_slug=rng.choice(["a", "b"]))
        for d in days for _ in range(40)
    ])


def listed(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def whole(spark, path):
    return postings.silver_jobs(readers.read_bronze(spark, f"{path}/json"), AS_OF)


def test_states_of_parts_merge_to_the_state_of_all(spark):
    rows = day_rows(spark, range(1, 9)).unionAll(one_run(spark))
    want = listed(postings.silver_jobs(rows, AS_OF))
    assert listed(postings.silver_from_state(postings.job_state(rows), AS_OF)) == want
    part = F.pmod(F.xxhash64("scraped_at"), F.lit(3))
    a, b, c = (postings.job_state(rows.where(part == k)) for k in range(3))
    for merged in (postings.merge_states(postings.merge_states(a, b), c), postings.merge_states(c, postings.merge_states(b, a))):
        assert listed(postings.silver_from_state(merged, AS_OF)) == want


def test_empty_states(spark):
    rows = day_rows(spark, [1, 2])
    none = postings.job_state(rows.where("job_id = 'nobody'"))
    some = postings.job_state(rows)
    assert listed(postings.merge_states(none, some)) == listed(postings.merge_states(some, none)) == listed(some)
    assert postings.merge_states(none, none).count() == 0


def test_new_days_and_days_that_ran_again(spark, tmp_path):
    path, state = str(tmp_path / "b"), str(tmp_path / "state")
    json = f"{path}/json"
    writers.write_bronze(day_rows(spark, range(1, 5)), path)
    first = incremental.update_silver(spark, json, state, [f"2024-01-0{d}" for d in range(1, 5)], AS_OF)
    assert listed(first) == listed(whole(spark, path))
    for d in (5, 6, 7):
        writers.write_bronze(day_rows(spark, [d], seed=d), path)
        got = incremental.update_silver(spark, json, state, [f"2024-01-0{d}"], AS_OF)
        assert listed(got) == listed(whole(spark, path))
    assert incremental.versions(spark, state) == ["2024-01-04", "2024-01-05", "2024-01-06", "2024-01-07"]
    # The 6th runs again with other jobs: its old rows are forgotten, the 7th is merged again.
    writers.write_bronze(day_rows(spark, [6], seed=99, jobs=8), path)
    got = incremental.update_silver(spark, json, state, ["2024-01-06"], AS_OF)
    assert listed(got) == listed(whole(spark, path))
    assert incremental.versions(spark, state) == ["2024-01-04", "2024-01-05", "2024-01-07"]
    assert listed(incremental.update_silver(spark, json, state, [], AS_OF)) == listed(got)
    # The very first day runs again: there is no version before it, all days are read.
    writers.write_bronze(day_rows(spark, [1], seed=98), path)
    assert listed(incremental.update_silver(spark, json, state, ["2024-01-01"], AS_OF)) == listed(whole(spark, path))


def test_days_between_a_version_and_a_day_that_ran_again(spark, tmp_path):
    path, state = str(tmp_path / "b"), str(tmp_path / "state")
    writers.write_bronze(day_rows(spark, range(1, 7)), path)
    for days in (["2024-01-01", "2024-01-02"], ["2024-01-06"], ["2024-01-05"], ["2024-01-06"]):
        got = incremental.update_silver(spark, f"{path}/json", state, days, AS_OF)
        assert listed(got) == listed(whole(spark, path))


def test_old_snapshots_are_not_read(spark, tmp_path):
    path, state = str(tmp_path / "b"), str(tmp_path / "state")
    writers.write_bronze(day_rows(spark, [1, 2, 3]), path)
    incremental.update_state(spark, f"{path}/json", state, ["2024-01-01", "2024-01-02"])
    writers.write_bronze(day_rows(spark, [4], seed=4), path)
    want = listed(whole(spark, path))
    for old in ("01", "02", "03"):
        for file in (tmp_path / "b" / "json" / f"scrape_date=2024-01-{old}").glob("part-*"):
            file.write_text("not a posting\n" * 50)
        for file in (tmp_path / "b" / "json" / f"scrape_date=2024-01-{old}").glob(".part-*.crc"):
            file.unlink()
    got = incremental.update_silver(spark, f"{path}/json", state, ["2024-01-04"], AS_OF)
    assert listed(got) == want


def test_unfinished_and_old_versions(spark, tmp_path):
    path, state = str(tmp_path / "b"), str(tmp_path / "state")
    for d in (1, 2, 3, 4):
        writers.write_bronze(day_rows(spark, [d], seed=d), path)
        incremental.update_state(spark, f"{path}/json", state, [f"2024-01-0{d}"], keep=2)
    assert incremental.versions(spark, state) == ["2024-01-03", "2024-01-04"]
    (tmp_path / "state" / "upto=2024-01-04" / "_SUCCESS").unlink()
    assert incremental.versions(spark, state) == ["2024-01-03"]
    got = incremental.update_silver(spark, f"{path}/json", state, ["2024-01-04"], AS_OF)
    assert listed(got) == listed(whole(spark, path))
    with pytest.raises(ValueError, match="no state"):
        incremental.update_state(spark, f"{path}/json", str(tmp_path / "none"), [])


# --- the stream --------------------------------------------------------------------

def feed(spark, tmp_path, parts, **options):
    """Each part is one file of the stream, read by a micro-batch of its own."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    schema = parts[0].schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    tracking.start_tracking(stream, out, str(tmp_path / "cp"), availableNow=True, **options).awaitTermination()
    return out


def run(rows, number):
    return rows.withColumn("run", F.lit(number))


@pytest.mark.parametrize("fold_every", [1, 2, 100])
def test_a_day_that_runs_again_counts_once(spark, tmp_path, fold_every):
    first, second = day_rows(spark, [1, 2, 3], seed=1), day_rows(spark, [2], seed=7, jobs=5)
    split = F.pmod(F.xxhash64("job_id", "scraped_at"), F.lit(2))
    parts = [run(first.where(split == 0), 1), run(second.where(split == 0), 2), run(first.where(split == 1), 1), run(second.where(split == 1), 2)]
    out = feed(spark, tmp_path, parts, run_col="run", fold_every=fold_every)
    counted = first.where("day(scraped_at) <> 2").unionAll(second)
    want = listed(postings.track_jobs(counted))
    assert listed(tracking.latest_tracking(tracking.tracking_rows(spark, out))) == want
    folders = written_folders(spark, out), written_folders(spark, out + ".bases")
    assert (len(folders[0]), len(folders[1])) == {1: (0, 1), 2: (0, 1), 100: (4, 0)}[fold_every]
    tracking.fold(spark, out)
    tracking.fold(spark, out)
    assert listed(tracking.latest_tracking(tracking.tracking_rows(spark, out))) == want


def test_a_stream_that_goes_on(spark, tmp_path):
    rows = day_rows(spark, [1, 2, 3, 4])
    feed(spark, tmp_path, [rows.where("day(scraped_at) = 1"), rows.where("day(scraped_at) = 2")], fold_every=2)
    for d in (3, 4):
        rows.where(f"day(scraped_at) = {d}").coalesce(1).write.parquet(str(tmp_path / "in" / f"9{d}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    tracking.start_tracking(stream, out, str(tmp_path / "cp"), fold_every=2, availableNow=True).awaitTermination()
    assert listed(tracking.latest_tracking(tracking.tracking_rows(spark, out))) == listed(postings.track_jobs(rows))
    assert written_folders(spark, out + ".bases") == ["upto=3"]


def test_a_fold_that_broke_off_changes_nothing(spark, tmp_path):
    rows = day_rows(spark, [1, 2])
    out = feed(spark, tmp_path, [rows.where("day(scraped_at) = 1"), rows.where("day(scraped_at) = 2")])
    want = listed(postings.track_jobs(rows))
    unfinished = tmp_path / "out.bases" / "upto=1"
    tracking.latest_runs(tracking.tracking_rows(spark, out)).write.parquet(str(unfinished))
    (unfinished / "_SUCCESS").rename(unfinished / "_later")
    assert listed(tracking.latest_tracking(tracking.tracking_rows(spark, out))) == want
    (unfinished / "_later").rename(unfinished / "_SUCCESS")  # finished, its batches not yet removed
    assert listed(tracking.latest_tracking(tracking.tracking_rows(spark, out))) == want


def test_no_batches_yet(spark, tmp_path):
    assert tracking.latest_tracking(tracking.tracking_rows(spark, str(tmp_path / "none"))).count() == 0
