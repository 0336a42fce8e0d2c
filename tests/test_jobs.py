"""The jobs: as registered against SQL, over growing input, with nulls, repeated rows, late files and a batch taken twice."""

import datetime
import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import citation_review, daily_observations, queries
from tests.oracle import connect, rows_of_duckdb, rows_of_spark

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, name):
    before = {k: v for k, v in spark.conf.getAll.items()}
    assert rows_of_spark(queries.QUERIES[name](spark, SF_DIR)) == rows_of_duckdb(connect(SF_DIR), queries.SQL[name])
    assert {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}


def daily(spark, folder):
    """Names and rows of the daily figures."""
    return rows_of_spark(spark.read.schema(daily_observations.DAILY).parquet(f"{folder}/out/daily"))


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    """Files that come between runs, some for days of the first, give what one run over all of them gives; only they are read."""
    caplog.set_level(logging.INFO)
    config = queries.config_of(daily_observations)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").cache()
    parts = [events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)]
    go = lambda where, source: daily_observations.run(spark, f"{where}/{source}", f"{where}/out", f"{where}/checkpoint", config)
    step, once = tmp_path / "step", tmp_path / "once"
    for part in parts[:2]:
        part.write.mode("append").parquet(f"{step}/in")
    (first,) = go(step, "in")
    assert first["n_accepted"] == sum(p.count() for p in parts[:2])
    assert go(step, "in") == []
    unchanged = daily(spark, step)
    parts[2].write.mode("append").parquet(f"{step}/in")
    (second,) = go(step, "in")
    assert second["n_accepted"] == parts[2].count() and second["batch"] == 1
    events.write.parquet(f"{once}/in")
    go(once, "in")
    assert daily(spark, step) == daily(spark, once) != unchanged
    runs = [json.loads(line) for f in sorted((step / "out" / "runs").rglob("*.json")) for line in f.read_text().splitlines()]
    assert [r["n_accepted"] for r in runs] == [first["n_accepted"], second["n_accepted"]]
    assert any("reports read and written" in m for m in caplog.messages)


def test_a_batch_taken_again_leaves_the_same(spark, tmp_path):
    """As after a failure half-way: the batch's number decides its partitions."""
    config, at = queries.config_of(daily_observations), datetime.datetime(2024, 1, 1, 5)
    rows = [(1, at, 7, "rain", 2.0, "x"), (1, at, 7, "rain", 2.0, "x"), (2, at, 7, "rain", float("nan"), "x"), (3, None, 7, "rain", 1.0, "x"), (4, at, None, "rain", 1.0, "x"), (5, None, None, None, None, None), (6, at, 7, None, None, "x")]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, day string")
    out = f"{tmp_path}/out"
    numbers = [daily_observations.take(batch, 0, out, config["columns"]) for _ in range(2)]
    assert numbers[0] == numbers[1] == {"batch": 0, "n_accepted": 4, "n_rejected": 3, "n_days": 1}
    got = daily(spark, tmp_path)
    assert got == rows_of_spark(spark.createDataFrame([("7", "rain", 2, 1, 2.0, 2.0, 2.0, "1", "2024-01-01"), ("7", None, 1, 1, None, None, None, "1", "2024-01-01")], daily_observations.DAILY))
    reasons = spark.read.schema(daily_observations.REJECTED).parquet(f"{out}/rejected").groupBy("reason").count().collect()
    assert {tuple(r) for r in reasons} == {("missing-station", 2), ("missing-time", 1)}
    assert daily_observations.take(batch.limit(0), 1, out, config["columns"])["n_days"] == 0 and daily(spark, tmp_path) == got


def test_review_follows_changed_texts(spark, tmp_path):
    config = queries.config_of(citation_review)
    old = "SITE NAME: ASH WOOD\nDate Notified (Under 1949 Act): 1965"
    texts = [(1, old, "Ash Wood SSSI"), (2, old.replace("1965", "1980"), "ASH WOOD"), (3, None, "Bere"), (4, "", None), (None, old, "Ash Wood"), (5, "SITE NAME: BERE\nFirst Notified: 1990\n" + "word " * 50_000, "Bere")]

    def review(rows):
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{tmp_path}/in")
        return citation_review.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)

    read = lambda name, schema: spark.read.schema(schema).parquet(f"{tmp_path}/out/{name}")
    numbers = review(texts)
    assert numbers == {"ok": 3, "fetch-failed": 1, "no-original-date": 1, "no-citation-key": 1} and review(texts) == numbers
    sites = {r.site_name: (r.n_citations, r.n_admitted, r.first_notified_year, r.status) for r in read("register", citation_review.REGISTER).collect()}
    assert sites == {"ASH WOOD": (3, 2, 1965, "conflicting"), "BERE": (2, 1, 1990, "later"), "": (1, 0, None, "unresolved")}
    assert read("citations", citation_review.CITATIONS).where("key = '5'").first().n_chars > 250_000
    assert review(texts[:1]) == {"ok": 1}
    assert [p.name for p in sorted((tmp_path / "out" / "register").iterdir()) if p.is_dir()] == ["status=admitted"]
    assert review([]) == {} and read("citations", citation_review.CITATIONS).count() == 0


@pytest.mark.parametrize("job", ["daily_observations", "citation_review"])
def test_command_line_names_its_paths(job, monkeypatch, capsys):
    from importlib import import_module

    monkeypatch.setattr("sys.argv", [job, "--help"])
    with pytest.raises(SystemExit):
        import_module(f"jobs.{job}").main()
    assert "--out" in capsys.readouterr().out


def test_a_run_that_failed_half_way_is_taken_up(spark, tmp_path, monkeypatch):
    """The batch is laid down, its days aren't made yet: the next run takes the same batch again and leaves what one sound run leaves."""
    config = queries.config_of(daily_observations)
    for where in ("broken", "sound"):
        spark.read.parquet(f"{SF_DIR}/events.parquet").write.parquet(f"{tmp_path}/{where}/in")
    go = lambda where: daily_observations.run(spark, f"{tmp_path}/{where}/in", f"{tmp_path}/{where}/out", f"{tmp_path}/{where}/checkpoint", config)

    def broken(observations):
        raise RuntimeError("lost on the way")

    with monkeypatch.context() as m:
        m.setattr(daily_observations, "daily_figures", broken)
        with pytest.raises(Exception, match="lost on the way"):
            go("broken")
    assert spark.read.schema(daily_observations.OBSERVATIONS).parquet(f"{tmp_path}/broken/out/observations").count() > 0
    (again,), (once,) = go("broken"), go("sound")
    assert again == once and daily(spark, tmp_path / "broken") == daily(spark, tmp_path / "sound")


def test_nothing_but_rejected_reports(spark, tmp_path):
    config = queries.config_of(daily_observations)
    spark.createDataFrame([(1, None, 7, "rain", 2.0)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/in")
    (numbers,) = daily_observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", config)
    assert numbers == {"batch": 0, "n_accepted": 0, "n_rejected": 1, "n_days": 0} and daily(spark, tmp_path)[1] == []
