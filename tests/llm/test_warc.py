import base64
import gzip
import hashlib
import json
import tempfile
from pathlib import Path

import pytest

from isohyet.llm import warc

FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
PAGES = [(5, "http://a/", "<p>ü</p>"), (1, "u", "same"), (2, None, None), (3, "u\r\nInjected: x", "same"), (4, "u", ""), (9, "u", "b\r\n\r\n" * 5000), (7, "u", "same"), (7, "u", "same"), (None, "u", "same"), (None, "u", "alone")]


def brute(pages):
    order = sorted(range(len(pages)), key=lambda i: (pages[i][0] is None, pages[i][0] or 0))
    first, out = {}, []
    for i in order:
        page, _, html = pages[i]
        data = (html or "").encode()
        seen = data in first
        first.setdefault(data, page)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if seen else "response", first[data] if seen else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("roll,broadcast", [(warc.ROLL_BYTES, 50_000), (300, 0)])
def test_round_trip(spark, monkeypatch, roll, broadcast):
    from isohyet.session import shared_dir

    shared_dir(spark)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in PAGES], "page_id long, url string, html string, digest string, first string")
    folder = Path(tempfile.mkdtemp())
    entries = warc.write_warc(df, f"file://{folder}", roll=roll)
    assert sum(e["records"] for e in entries) == len(PAGES) and json.loads((folder / "manifest.json").read_text())["files"] == entries
    assert {p.name for p in folder.iterdir()} == {e["name"] for e in entries} | {"manifest.json"}
    for e in entries:
        data = (folder / e["name"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (e["bytes"], e["sha256"])
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    got = warc.read_warc(spark, f"file://{folder}")
    assert sorted(map(tuple, got.select(*FIELDS).collect()), key=repr) == brute(PAGES)
    html = {r.page_id: bytes(r.html) for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert all(html[i] == (dict((p, h) for p, _, h in PAGES)[i] or "").encode() for i in html)


def test_reruns_write_the_same_bytes_and_small_payloads(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    a, b = (warc.write_warc(df, f"file://{tempfile.mkdtemp()}") for _ in range(2))
    assert a == b
    folder = f"file://{tempfile.mkdtemp()}"
    warc.write_warc(df, folder, least=5)
    assert {r.record_type for r in warc.read_warc(spark, folder).where("payload_bytes < 5").collect()} == {"response"}


def test_empty_table(spark):
    folder = f"file://{tempfile.mkdtemp()}"
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder) == []
    assert warc.read_warc(spark, folder).count() == 0


def test_damage_is_noticed(spark):
    folder = Path(tempfile.mkdtemp())
    (entry,) = warc.write_warc(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), f"file://{folder}")
    raw = gzip.decompress((folder / entry["name"]).read_bytes()).replace(b"payload\r\n", b"PAYLOAD\r\n")
    (folder / entry["name"]).write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="differs from its headers"):
        warc.read_warc(spark, f"file://{folder}").collect()


def test_files_do_not_depend_on_partitions(spark):
    """More rows than a range exchange samples, under two numbers of partitions and two dealings of the input."""
    n = 20_000
    pages = spark.range(n).selectExpr("(id * 7919) % 20000 - 5 AS page_id", "concat('http://h/', id % 977) AS url", "repeat(concat('text ', id % 3000), 1 + cast(id % 41 AS int)) AS html")
    made = []
    for partitions, dealt in (("4", 3), ("9", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        made.append(warc.write_warc(pages.repartition(dealt, "html"), f"file://{tempfile.mkdtemp()}", roll=100_000, ranges=(8, (1_000, 1 << 30))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1] and len(made[0]) > 8 and sum(e["records"] for e in made[0]) == n


def test_bounds_are_exact_quantiles(spark):
    rows = spark.createDataFrame([(False, i, 5, 6, 10) for i in range(100)] + [(True, 0, 1, 2, 10)], "none boolean, page long, digest_hash long, url_hash long, bytes long")
    assert warc.record_bounds(rows, (4, (1, 1 << 30))) == [(False, 26, 5, 6), (False, 51, 5, 6), (False, 76, 5, 6)]


def test_missing_ids_and_one_page_spread_over_files(spark):
    """Half of the rows have no id, a quarter is one page, and of each a part has one payload: files are of even size all the same."""
    n = 12_000
    pages = spark.range(n).selectExpr(
        "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 4 = 1 THEN 7 ELSE id END AS page_id", "concat('http://h/', id) AS url",
        "CASE WHEN id % 3 = 0 THEN 'the same payload of some length, again and again' ELSE sha2(cast(id AS string), 512) END AS html",
    )
    folder = f"file://{tempfile.mkdtemp()}"
    entries = warc.write_warc(pages, folder, ranges=(10, (1_000, 1 << 30)))
    sizes = [e["records"] for e in entries]
    assert len(sizes) == 10 and sum(sizes) == n and max(sizes) < 1.5 * n / 10
    got = warc.read_warc(spark, folder)
    kinds = {(r.page_id, r.record_type): r.n for r in got.where("payload_bytes < 100").groupBy("page_id", "record_type").count().withColumnRenamed("count", "n").collect()}
    # the smallest page among equal payloads has the only response
    assert [k for k in kinds if k[1] == "response"] == [(3, "response")] and kinds[3, "response"] == 1 and sum(kinds.values()) == n // 3
    assert got.where("payload_bytes >= 100 and record_type <> 'response'").count() == 0


def test_equal_rows_of_a_page_have_one_response(spark):
    rows = [(None, "b", "x"), (None, "a", "x"), (None, "a", "x"), (None, None, "x"), (None, None, "x")]
    for ranges in ((64, (8 << 20, 1 << 30)), (5, (1, 1 << 30))):
        folder = f"file://{tempfile.mkdtemp()}"
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, ranges=ranges)
        assert sorted(r.record_type for r in warc.read_warc(spark, folder).collect()) == ["response"] + ["revisit"] * 4


def test_long_payloads(spark):
    """Payloads of some megabytes, longer than a range, a roll and a read: whole records, each in a file of its own."""
    rows = [(i, "u", f"<p>\u00e9 {i}</p>" * (400_000 + i)) for i in range(4)] + [(9, "u", "short")]
    folder = f"file://{tempfile.mkdtemp()}"
    entries = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, roll=10_000, ranges=(64, (1_000, 1 << 30)))
    got = {r.page_id: bytes(r.html).decode() for r in warc.read_warc(spark, folder).collect()}
    assert got == {i: html for i, _, html in rows} and len(entries) >= 4
