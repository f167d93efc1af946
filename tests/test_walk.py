"""A walk with failing pages that is stopped and taken up again is complete."""

from pyspark.sql import functions as F

from termloom.sources.walk import Walk, fetch_by


def test_walk_is_taken_up_again(spark, tmp_path):
    pages = {f"p{i}": "".join(f'<a class="x" href="p{j}">x</a>' for j in (i + 3, i + 1)) for i in range(100)}
    starts = spark.createDataFrame([("p0",), ("p0",), (None,)], "url string")

    def get(url):
        if url not in pages:
            raise KeyError(url)
        return pages[url]

    stopped = Walk(spark, str(tmp_path / "w"), retries=2)
    assert stopped.run(starts, fetch_by(get), most_rounds=5) is False
    some = stopped.pages().count()
    assert 0 < some < 100
    again = Walk(spark, str(tmp_path / "w"), retries=2)
    assert again.run(starts, fetch_by(get)) is True
    assert {r["url"] for r in again.pages().collect()} == set(pages) and again.pages().count() == 100
    assert {(r["url"], r["tries"]) for r in again.failed().collect()} == {("p100", 2), ("p101", 2), ("p102", 2)}
    before = again._rounds()
    assert again.run(starts, fetch_by(get)) and again._rounds() == before  # nothing is left to do


def test_failed_pages_are_tried_again(spark, tmp_path):
    def flaky(frontier):
        ok = F.col("tries") >= 1
        return frontier.select("url", F.when(ok, "<p>x</p>").alias("html"), F.when(~ok, "later").alias("error"))

    walk = Walk(spark, str(tmp_path / "w"))
    assert walk.run(spark.createDataFrame([("a",), ("b",)], "url string"), flaky)
    assert {(r["url"], r["tries"]) for r in walk.pages().collect()} == {("a", 2), ("b", 2)} and walk.failed().count() == 0


def test_a_round_takes_few_jobs_and_skips_older_pages(spark, tmp_path):
    def fetch(frontier):
        i = F.substring("url", 2, 9).cast("int")
        return frontier.select("url", F.when(i < 7, F.format_string('<a href="p%d">x</a><a href="p0">x</a>', i + 1)).otherwise("<p>").alias("html"), F.lit(None).cast("string").alias("error"), "tries")

    walk, context = Walk(spark, str(tmp_path / "w")), spark.sparkContext
    context.setJobGroup("walk", "eight rounds")
    assert walk.run(spark.createDataFrame([("p0",)], "url string"), fetch)
    context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("walk"))
    assert {(r["url"], r["tries"]) for r in walk.pages().collect()} == {(f"p{i}", 1) for i in range(8)}
    assert jobs <= 8 * 4, jobs
    # Pages before the last round are not searched again: what they link to has been asked for.
    rows = lambda url, to: spark.createDataFrame([(url, f'<a href="{to}">x</a>', None, 1)], "url string, html string, error string, tries int")
    rows("a", "old").write.parquet(f"{tmp_path}/v/round=1")
    rows("b", "new").write.parquet(f"{tmp_path}/v/round=2")
    assert [(r["url"], r["tries"]) for r in Walk(spark, str(tmp_path / "v"))._next([1, 2]).collect()] == [("new", 0)]


def test_pages_that_a_fetch_leaves_out_are_asked_for_again(spark, tmp_path):
    """A fetch may answer for a part only, and need not pass the tries on."""
    walk = Walk(spark, str(tmp_path / "w"))

    def fetch(frontier):
        late = F.lit(len(walk._rounds()) < 2) & (F.col("url") == "b")
        return frontier.where(~late).select("url", F.lit('<a href="c">x</a>').alias("html"), F.lit(None).cast("string").alias("error"))

    assert walk.run(spark.createDataFrame([("a",), ("b",)], "url string"), fetch)
    assert {(r["url"], r["tries"]) for r in walk.pages().collect()} == {("a", 1), ("b", 1), ("c", 1)}
