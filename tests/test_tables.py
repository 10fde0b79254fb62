"""Tracking, history, sources and sinks on small tables."""

import json
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireplane import schemas as S
from hireplane.catalog import bindings
from hireplane.operators import filings, postings, profiles, serving
from hireplane.sources import readers, writers
from hireplane.streaming import tracking


def bronze(spark, rows):
    base = dict(company_slug="a", title="Data Engineer", is_target_role=True, location="Remote", posted_at="", description_html="",
                description_text="", departments="", apply_url="", source_ats="lever", raw_json="{}")
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in S.JOBS_BRONZE_COLUMNS) for r in full], S.JOBS_BRONZE)


def snapshots(spark):
    d = lambda n: datetime(2024, 1, n)
    return bronze(spark, [
        dict(job_id="j1", scraped_at=d(1), title="Old"), dict(job_id="j1", scraped_at=d(3), title=None, location="NY"),
        dict(job_id="j2", scraped_at=d(20)), dict(job_id=None, scraped_at=d(2)),
    ])


def test_silver_keeps_last_known_values(spark):
    got = {r.job_id: r for r in postings.silver_jobs(snapshots(spark), "2024-01-31 00:00:00").collect()}
    assert set(got) == {"j1", "j2"}
    assert (got["j1"].title, got["j1"].location, got["j1"].times_seen) == ("Old", "NY", 2)
    assert (got["j1"].is_active, got["j2"].is_active) == (False, True)
    whole = {r.job_id: r.title for r in postings.latest_rows(snapshots(spark)).collect()}
    assert whole["j1"] is None


def shuffled_bytes(df):
    """Bytes that the stages of ``df`` wrote for shuffles, from the metrics of the plan that ran."""
    df.collect()

    def add_up(node):
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            return add_up(node.executedPlan())
        if "QueryStage" in kind:
            return add_up(node.plan())
        told = node.metrics().get("shuffleBytesWritten")
        below = node.children()
        return (told.get().value() if told.isDefined() else 0) + sum(add_up(below.apply(k)) for k in range(below.size()))

    return add_up(df._jdf.queryExecution().executedPlan())


def test_only_winning_texts_are_shuffled(spark):
    """40 jobs in 30 snapshots, 12 MB of texts that do not compress: only the last snapshot's texts move, once, and none if none is asked for."""
    rows = [dict(job_id=f"j{k}", scraped_at=datetime(2024, 1, n + 1)) for k in range(40) for n in range(30)]
    texts = F.concat_ws("", *[F.sha2(F.concat_ws("-", "job_id", "scraped_at", F.lit(k)), 512) for k in range(40)])
    all_rows = bronze(spark, rows).withColumn("description_text", texts).withColumn("description_html", F.reverse("description_text"))
    silver = postings.silver_jobs(all_rows, "2024-01-31 00:00:00")
    whole, short = shuffled_bytes(silver), shuffled_bytes(silver.select("job_id", "title"))
    assert whole < 1_500_000 and short < 400_000
    last = {r.job_id: r.description_text for r in all_rows.where("scraped_at = '2024-01-30 00:00:00'").collect()}
    assert {r.job_id: r.description_text for r in silver.collect()} == last


def test_texts_move_before_their_join_only(spark, tmp_path):
    """1,200 events of 10 users, 2.4 MB of texts that do not compress: the rows are those of the plain joins, and no event moves with its texts."""
    event = F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") - 40)
    user = F.when(F.col("id") % 70 == 0, F.lit(None)).otherwise(F.col("id") % 10 - 1)
    text = lambda name: F.concat_ws("", *[F.sha2(F.concat_ws("-", F.lit(name), "id", F.lit(k)), 512) for k in range(300)])
    spark.range(1200).select(event.alias("event_id"), user.alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    docs = spark.range(-9, 40).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), text("d").alias("text"))
    docs.unionAll(docs.where("doc_id = 12")).repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    pages = spark.range(-2, 8).select(F.col("id").alias("page_id"), text("p").alias("html"))
    pages.unionAll(pages.where("page_id = 2")).repartition(1).write.parquet(f"{tmp_path}/pages.parquet")
    dialect, doc_id = bindings.Spark(spark, str(tmp_path)), "e.user_id * 6 + (e.event_id % 23) % 6"
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        select = "SELECT e.event_id, e.user_id, md5(x.text) AS x, md5(p.html) AS p FROM "
        got = spark.sql(select + dialect.bronze_from(doc_id))
        assert shuffled_bytes(got) < 9_000_000
        plain = spark.sql(select + bindings.DuckDB.bronze_from(dialect, doc_id))
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_no_winner_is_left_out(spark):
    """More keys than fit one bitmap; every job is met, jobs without any value too."""
    rows = spark.range(30_000).select(
        F.concat(F.lit("j"), F.col("id") % 10_000).alias("job_id"), F.timestamp_seconds(F.col("id") * 7).alias("scraped_at"),
        F.when(F.col("id") % 10_000 != 5, F.col("id").cast("string")).alias("title"),
    )
    got = postings.latest_values(rows, ["title"])
    assert got.count() == 10_000 and got.where("title IS NULL").count() == 1
    assert got.where("int(title) != 20000 + int(substring(job_id, 2, 9))").count() == 0


def test_bronze_sink_replaces_a_day(spark, tmp_path):
    path = str(tmp_path / "bronze")
    writers.write_bronze(snapshots(spark), path)
    writers.write_bronze(snapshots(spark).filter("job_id = 'j2'"), path)
    got = readers.read_bronze(spark, path + "/json")
    assert got.count() == 4
    assert got.schema.names == S.JOBS_BRONZE_COLUMNS


def test_bronze_sink_is_packed(spark, tmp_path):
    path, long = tmp_path / "bronze", "<p>A long text of a posting. " * 4000
    rows = bronze(spark, [dict(job_id=f"j{n}", scraped_at=datetime(2024, 1, n), description_html=long, description_text=long) for n in range(1, 9)])
    writers.write_bronze(rows, str(path))
    files = [f for kind in ("json", "csv") for f in (path / kind).rglob("part-*")]
    assert len(files) >= 16 and sum(f.stat().st_size for f in files) < 8 * len(long) / 10
    got = readers.read_bronze(spark, str(path / "json"))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    sheet = readers.read_csv_table(spark, str(path / "csv"), T.StructType([f for f in rows.schema if f.name not in ("raw_json", "description_html")]))
    assert sheet.count() == 8 and {r.description_text.strip() for r in sheet.collect()} == {long.strip()}


def test_array_snapshots(spark, tmp_path):
    rows = [dict(job_id=str(i), scraped_at="2024-01-01T00:00:00+00:00", title="T") for i in range(3)]
    (tmp_path / "jobs_2024-01-01.json").write_text(json.dumps(rows, indent=1))
    got = readers.read_bronze(spark, str(tmp_path / "jobs_*.json"), array_files=True)
    assert sorted(r.job_id for r in got.collect()) == ["0", "1", "2"]


def test_utf16_petitions(spark, tmp_path):
    head = "Employer (Petitioner) Name \tFiscal Year\tNew Employment Approval\tAmended Denial "
    (tmp_path / "u.csv").write_bytes(f"{head}\r\nAcme, Inc.\t2024\t3\t\r\nCafé LLC\tx\t\t2\r\n".encode("utf-16"))
    got = filings.uscis_totals(readers.read_uscis(spark, str(tmp_path / "u.csv")))
    assert sorted(tuple(r) for r in got.collect()) == [("acme", 3, 0, 2024), ("café", 0, 2, None)]


def test_history_of_one_hot_employer(spark):
    rows = [("Hot, Inc.", "TX" if i % 3 else "CA", None, "Certified" if i % 4 else "Denied", "2024-05-01", "x") for i in range(3000)]
    rows += [("Cold LLC", None, "5", "Withdrawn", "nope", "x"), ("Global Inc", "TX", "1", "Certified", "2024-01-01", "x")]
    old = spark.createDataFrame(rows, "EMPLOYER_NAME string, EMPLOYER_STATE_PROVINCE string, NAICS_CODE string,"
                                      " CASE_STATUS string, DECISION_DATE string, JOB_TITLE string")
    uscis = spark.createDataFrame([("Third Co", "2023", 7)], "`Employer (Petitioner) Name` string, `Fiscal Year` string, `New Employment Approval` int")
    got = {r.company_name_norm: r for r in filings.sponsorship_history(filings.union_cases([old]), uscis, "2024-12-31 00:00:00").collect()}
    assert set(got) == {"hot", "cold", "third"}
    assert (got["hot"].total_perm_certified, got["hot"].total_perm_denied, got["hot"].state) == (2250, 750, "TX")
    assert got["hot"].perm_by_year["2024"].certified == 2250
    assert (got["cold"].perm_approval_rate, got["cold"].data_freshness_score, got["cold"].naics) == (None, 0.0, "5")
    assert (got["third"].uscis_total_approvals, got["third"].total_perm_certified) == (7, 0)


def test_providers(spark):
    raw = [
        ("greenhouse", {"id": 7, "title": "Data Analyst", "location": "Boston, MA", "departments": [{"name": "A"}, {"name": "B"}], "content": "&lt;p&gt;"}),
        ("lever", {"id": "x", "text": "T", "categories": {"location": "", "allLocations": ["Austin, TX"], "team": "Core"}, "createdAt": 0,
                   "description": "<p>d</p>", "lists": [{"text": "L", "content": "<li>one</li>"}]}),
        ("workable", {"shortcode": "S1", "id": 3, "title": "T", "location": {"city": "Reno", "region": "", "country": "United States"}}),
    ]
    df = spark.createDataFrame([(p, "c", json.dumps(r), datetime(2024, 1, 1)) for p, r in raw], S.RAW_POSTINGS)
    got = {r.source_ats: r for r in postings.parse_postings(df).collect()}
    assert (got["greenhouse"].job_id, got["greenhouse"].location, got["greenhouse"].departments) == ("7", "Boston, MA", "A, B")
    assert got["greenhouse"].description_text == "<p>"
    assert (got["lever"].location, got["lever"].departments, got["lever"].posted_at) == ("Austin, TX", "Core", "")
    assert got["lever"].description_html == "<p>d</p><h3>L</h3><ul><li><li>one</li></li></ul>"
    assert (got["workable"].job_id, got["workable"].location) == ("S1", "Reno, United States")


def test_texts_are_made_only_where_they_are_read(spark):
    raw = spark.createDataFrame([("ashby", "c", '{"id": "1", "locationName": "Remote", "descriptionHtml": "<p>a &amp; b &eacute;</p>"}', datetime(2024, 1, 1))], S.RAW_POSTINGS)
    rows = postings.parse_postings(raw, us_only=False)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "<(script" not in plan(rows.select("location").distinct())
    assert plan(rows).count("<(script") == 1
    assert [r.description_text for r in rows.collect()] == ["a & b é"]


def test_resume_rules(spark):
    text_ = ("Jane Doe\r\njane@x.org\nPh.D., computer science, Some University\nML engineer 2015 – present\n"
             "python, C++17, SQL Server, Golang, Go, R&D, bi-weekly BI; apache spark")
    df = spark.createDataFrame([(1, text_), (2, "x" * 50_000 + " tableau"), (3, " ")], "candidate_id bigint, text string")
    got = {r.candidate_id: r for r in profiles.extract_profiles(profiles.usable_resumes(df)).collect()}
    r = got[1]
    assert (r.name, r.email, r.highest_degree, r.field_of_study) == ("Jane Doe", "jane@x.org", "PhD", "Computer Science")
    assert r.university == "Ph.D., computer science, Some University"
    assert (r.years_of_experience, r.job_titles) == (11.0, ["Ml Engineer"])
    assert r.technical_skills == ["Python", "SQL", "R", "Go", "C++", "Apache Spark", "Spark", "SQL Server", "BI"]
    assert got[2].technical_skills == ["Tableau"] and 3 not in got
    assert [x.candidate_id for x in profiles.rejected_resumes(df).collect()] == [3]


def test_stream_equals_batch(spark, tmp_path):
    rows = snapshots(spark).filter("job_id IS NOT NULL").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracking.start_tracking(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = tracking.latest_tracking(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, postings.track_jobs(rows).collect()))
    assert got.filter(F.col("times_seen") > 1).count() == 1


def one_run(spark):
    """Two postings of one run under one id, and a later run that leaves some fields out."""
    d = lambda n: datetime(2024, 1, n)
    return bronze(spark, [
        dict(job_id="j1", scraped_at=d(5), company_slug="a", source_ats="lever", title="Data Engineer", description_html="<p>a", location="A"),
        dict(job_id="j1", scraped_at=d(5), company_slug="b", source_ats="ashby", title="Chef", description_html="<p>b", location="B"),
        dict(job_id="j2", scraped_at=d(5), company_slug="c", source_ats="lever", title="One", description_html="<p>c"),
        dict(job_id="j2", scraped_at=d(6), company_slug="c", source_ats="lever", title=None, description_html=None),
        dict(job_id="j2", scraped_at=d(6), company_slug="c", source_ats="lever", title=None, description_html=None),
    ])


def test_equal_times_never_mix_rows(spark):
    rows = one_run(spark)
    want = {("a", "lever", "Data Engineer", "<p>a", "A"), ("b", "ashby", "Chef", "<p>b", "B")}
    names = ["company_slug", "source_ats", "title", "description_html", "location"]
    for got in (postings.latest_values(rows), postings.latest_rows(rows), postings.silver_jobs(rows, "2024-01-31 00:00:00")):
        assert tuple(got.filter("job_id = 'j1'").select(*names).first()) in want
        assert got.count() == 2
    kept = {tuple(g.filter("job_id = 'j1'").select(*names).first()) for g in (postings.latest_values(rows), postings.latest_rows(rows.repartition(5)))}
    assert len(kept) == 1
    assert tuple(postings.latest_values(rows).filter("job_id = 'j2'").select("title", "description_html").first()) == ("One", "<p>c")
    assert tuple(postings.latest_rows(rows).filter("job_id = 'j2'").select("title", "description_html").first()) == (None, None)


def test_latest_values_do_not_sort_wide_rows(spark):
    for got in (postings.latest_values(one_run(spark)), postings.silver_jobs(one_run(spark), "2024-01-31 00:00:00")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_copies_and_tied_texts_are_gathered_once(spark):
    d = datetime(2024, 1, 5)
    texts = [dict(job_id="j1", scraped_at=d, description_html=f"<p>{i}", description_text=str(i)) for i in range(50)]
    copies = [dict(job_id="j2", scraped_at=None, description_html="<p>copy", raw_json="{1}")] * 500
    rows = bronze(spark, texts + copies).repartition(5)
    others = [c for c in rows.columns if c != "job_id"]
    for conditions in ({"row": F.lit(True)}, {c: F.col(c).isNotNull() for c in others}):
        found = postings._winners(rows, conditions, others)
        assert {r.job_id: r.n for r in found.select("job_id", F.size("_winners").alias("n")).collect()} == {"j1": 1, "j2": 1}
    got = {r.job_id: r for r in postings.latest_values(rows).collect()}
    assert got["j1"].description_html == "<p>" + got["j1"].description_text and got["j2"].description_html == "<p>copy"
    assert sorted(map(str, postings.latest_rows(rows).select(*rows.columns).collect())) == sorted(map(str, postings.latest_values(rows).select(*rows.columns).collect()))


def test_sheets_are_read_back_whole(spark, tmp_path):
    nasty = 'He said "no", then\nleft; 100% \\ done,'
    rows = bronze(spark, [dict(job_id="j1", scraped_at=datetime(2024, 1, 5), title=nasty, description_text=nasty)])
    path = str(tmp_path / "b")
    writers.write_bronze(rows, path)
    reduced = T.StructType([f for f in T.StructType.fromDDL(S.JOBS_BRONZE).fields if f.name not in ("raw_json", "description_html")])
    got = readers.read_csv_table(spark, path + "/csv", reduced).first()
    assert (got.title, got.description_text, got.job_id) == (nasty, nasty, "j1")
    writers.write_silver(postings.silver_jobs(rows, "2024-01-31 00:00:00"), path + "/silver")
    silver = spark.read.parquet(path + "/silver/parquet")
    sheet = readers.read_csv_table(spark, path + "/silver/csv", T.StructType([f for f in silver.schema if f.name != "description_html"]))
    assert sheet.first().title == nasty and sheet.first().times_seen == 1


def test_manifest_is_safe_to_repeat(spark, tmp_path):
    path = str(tmp_path / "m")
    writers.append_manifest(snapshots(spark), path)
    writers.append_manifest(snapshots(spark).filter("job_id = 'j2'"), path)
    got = {r.run_date: r.total_jobs for r in spark.read.schema(S.RUN_MANIFEST).json(path + "/manifest").collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 1, "2024-01-20": 1}


def test_only_runs_of_the_manifest_are_read(spark, tmp_path):
    path = str(tmp_path / "b")
    writers.write_bronze(snapshots(spark).filter("job_id IS NOT NULL"), path)
    bronze_rows = readers.read_bronze(spark, path + "/json")
    writers.append_manifest(bronze_rows, path)
    (tmp_path / "b" / "json" / "scrape_date=2024-01-02").mkdir()
    (tmp_path / "b" / "json" / "scrape_date=2024-01-02" / "stray.json").write_text('{"job_id": "stray", "scraped_at": "2024-01-02T00:00:00Z"}')
    (tmp_path / "b" / "json" / "scrape_date=2024-01-01" / "late.json").write_text('{"job_id": "late", "scraped_at": "2024-01-01T09:00:00Z"}')
    read = lambda *days: readers.read_runs(spark, path, readers.manifest_runs(spark, path, *days))
    assert sorted(r.job_id for r in read().collect()) == ["j1", "j1", "j2"]
    some = read("2024-01-02", "2024-01-10")
    assert [(r.job_id, r.location) for r in some.collect()] == [("j1", "NY")]
    assert {f.split("/json/")[1][:22] for f in some.inputFiles() if "/json/" in f} == {"scrape_date=2024-01-03"}
    none = read("2025-01-01")
    assert none.count() == 0 and none.columns == S.JOBS_BRONZE_COLUMNS


def test_company_lists(spark, tmp_path):
    rows = [dict(slug="a", display_name="A", ats="lever"), dict(slug="b", display_name="B", ats=None)]
    (tmp_path / "c.json").write_text(json.dumps(rows, indent=1))
    assert [r.slug for r in readers.read_companies(spark, str(tmp_path / "c.json"), array_file=True).collect()] == ["a", "b"]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    assert readers.read_companies(spark, str(tmp_path / "lines.json")).count() == 2


def test_pages_by_key_equal_pages_by_number(spark):
    rows = bronze(spark, [dict(job_id=f"j{i:02d}", scraped_at=datetime(2024, 1, 30)) for i in range(23)])
    silver, last = postings.silver_jobs(rows, "2024-01-31 00:00:00"), None
    for page in range(1, 5):
        by_key = serving.browse_jobs(silver, per_page=7, last_id=last).collect()
        assert by_key == serving.browse_jobs(silver, page, 7).collect()
        last = by_key[-1].job_id if by_key else last


def test_user_sort_keeps_the_rank_inside_ties(spark):
    rows = spark.createDataFrame([(1, "b", 1.0, 1), (1, "a", 1.0, 2), (1, "c", 2.0, 3)], "candidate_id int, job_id string, recency_score double, rank int")
    got = serving.sort_results(rows, "recency_score").collect()
    assert [(r.job_id, r.position) for r in got] == [("c", 1), ("b", 2), ("a", 3)]


def test_scratch_folder(spark, monkeypatch):
    from hireplane import session

    before = spark.conf.get("spark.checkpoint.dir", None)
    path = session.scratch_path(spark, "x")
    assert spark.conf.get("spark.checkpoint.dir", None) == before and "/x-" in path

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "a"})

    import pytest

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Cluster, "x")


def test_extracted_scalars(spark):
    raw = '{"name": "0", "email": 0, "university": true, "technical_skills": ["0", 0, false, true, "", null, 7, "false"]}'
    got = profiles.sanitise_extracted(spark.createDataFrame([(1, raw)], "candidate_id bigint, extracted string")).first()
    assert (got.name, got.email, got.university) == ("0", None, "True")
    assert got.technical_skills == ["0", "True", "7", "false"]


def test_university_line_ends(spark):
    df = spark.createDataFrame([("Jane Doe\fMIT College\x1cx",), ("a\x0bState University \r\nz",), ("none",)], "b string")
    got = [r[0] for r in df.select(profiles.university(F.col("b"))).collect()]
    assert got == ["MIT College", "State University", None]


def test_texts_come_last(spark, tmp_path):
    """Jobs chosen from short sources get the texts that their bronze rows hold; nulls, repeated ids and far pages included."""
    from datetime import datetime

    from hireplane.catalog import all_queries
    from hireplane.catalog.bindings import Inputs

    at = str(tmp_path)
    ids = [(1, 1), (24, 1), (2, 1), (3, 2), (26, 2), (5, None), (6, 4), (-1, 3)]
    events = [(e, datetime(2024, 1, 1 + n), u, "click", 1.0, "{}") for n, (e, u) in enumerate(ids)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    docs = [(d, None if d == 8 else f"words {d}") for d in range(0, 24)] + [(7, "words 7"), (13, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    pages = [(1, "<b>one</b>"), (2, None), (3, "<i>three</i>"), (1, "<b>one</b>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{at}/pages.parquet")
    for table in ("orders", "customer", "nation", "lineitem", "embeddings"):  # named by other inputs
        spark.range(1).write.parquet(f"{at}/{table}.parquet")
    i, names = Inputs(spark, at), ["job_id", "description_text", "description_html"]
    bronze = {tuple(r) for r in i.jobs_bronze.where("job_id IS NOT NULL").select(*names).collect()}
    assert {tuple(r) for r in i.with_texts(i.jobs_by_source.where("job_id IS NOT NULL")).select(*names).collect()} == bronze
    assert i.jobs_bronze.count() == i.jobs_by_source.count()
    for query in ("g2_latest_values", "w1_latest_rows", "t1_silver_jobs"):
        got = all_queries()[query](spark, at).select(*names).collect()
        assert len(got) == len({r.job_id for r in got}) == len({b[0] for b in bronze})
        assert {tuple(r) for r in got} <= bronze
    # No text is read, let alone moved, where none is asked for.
    for query in ("f2_target_jobs", "g11_silver_summary"):
        plan = all_queries()[query](spark, at)._jdf.queryExecution().executedPlan().toString()
        assert "html:string" not in plan and "text:string" not in plan


def test_flags_of_silver_jobs_need_one_pass(spark):
    """Columns of fixed width come with their keys: the same values, no second pass."""
    rows = snapshots(spark).unionByName(one_run(spark).select(*snapshots(spark).columns), allowMissingColumns=True)
    names = ["job_id", "is_target_role", "first_seen", "last_seen", "times_seen", "is_active"]
    flags = postings.silver_jobs(rows, "2024-01-31 00:00:00", columns=["is_target_role"])
    whole = postings.silver_jobs(rows, "2024-01-31 00:00:00")
    assert sorted(map(repr, flags.select(*names).collect())) == sorted(map(repr, whole.select(*names).collect()))
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_keys_of_the_top_row_are_not_written(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(postings, "stored", lambda df, name, real=postings.stored: kept.append((name, real(df, name))) or kept[-1][1])
    got = {r.job_id: r for r in postings.silver_jobs(snapshots(spark), "2024-01-31 00:00:00").collect()}
    written = dict(kept)["winners"]
    keys = [c for c in written.columns if c.startswith("_k_")]
    assert any(r[c] is None for r in written.collect() for c in keys) and got
    assert not any(r[c] == r["_top"] for r in written.collect() for c in keys)


def test_history_reads_the_cases_once(spark, monkeypatch):
    from hireplane.operators import filings

    kept = []
    monkeypatch.setattr(filings, "stored", lambda df, name: kept.append(name) or df)
    cases = spark.createDataFrame([], f"{filings.EMPLOYER} string, fiscal_year int, company_name_raw string, state string, naics string, is_approved boolean, is_denied boolean, decision_date timestamp")
    filings.perm_history(cases, "2001-12-31 00:00:00")
    assert kept == ["cases"]


def test_texts_and_vectors_move_once(spark, tmp_path):
    """Texts are dealt once on their way to the jobs; a job's vectors are those of the plain statement, nulls and repeats included."""
    from datetime import datetime

    from hireplane.catalog import q_candidates, q_scoring
    from hireplane.catalog.bindings import Inputs

    at = str(tmp_path)
    events = [(e, datetime(2024, 1, 1 + n), u, "click", 1.0, "{}") for n, (e, u) in enumerate([(1, 1), (24, 1), (2, 1), (3, 2), (5, None), (None, 2), (6, 9)])]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame([(d, f"words {d}") for d in range(24)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "<b>one</b>")], "page_id long, html string").write.parquet(f"{at}/pages.parquet")
    vectors = [(1, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.0, 3.0, 4.0]), (1, [4.0, 2.0, 3.0, 1.0]), (2, None), (2, [5.0, 6.0, 7.0, 8.0]), (3, [0.0] * 4)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    for table in ("orders", "customer", "nation", "lineitem"):  # named by other inputs
        spark.range(1).write.parquet(f"{at}/{table}.parquet")
    i = Inputs(spark, at)
    for name in ("events", "embeddings"):
        spark.read.parquet(f"{at}/{name}.parquet").createOrReplaceTempView(f"plain_{name}")
    want = spark.sql(f"""SELECT DISTINCT 'j' || CAST(e.user_id * 100 + e.event_id % 23 AS STRING) AS job_id,
        {i.dialect.rotate("v.embedding", "(e.event_id % 23)")} AS embedding FROM plain_events e JOIN plain_embeddings v ON v.vec_id = e.user_id""")
    assert sorted(map(repr, i.job_vectors.collect())) == sorted(map(repr, want.collect())) and i.job_vectors.schema == want.schema
    plan = i.with_texts(i.jobs_by_source.where("job_id IS NOT NULL"))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(_place" in line]
    assert dealt and not any("_key" in line for line in dealt)
    told = q_scoring.signal_table(i)
    assert told.columns == ["job_id", "company_slug", "signal", "signal_delta"]
    want = q_scoring.scoring.with_signals(q_candidates.index_table(i), "description_clean").select(*told.columns)
    assert sorted(map(repr, told.collect())) == sorted(map(repr, want.collect()))


def test_order_keys_are_worked_out_once(spark):
    """No filter asks whether an order key is null, which would work out all its digests again."""
    rows = one_run(spark)
    plan = postings.silver_jobs(rows, "2024-01-31 00:00:00")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
