import math

import pytest
from pyspark.sql import functions as F

from isohyet.functions import geo, textrules
from isohyet.operators import analysis, audit, entity, inference, joins, rings, synth, timeline, trend
from isohyet.streaming import incremental


def segs(spark, years, aws=None):
    df = spark.createDataFrame([(1, y, aws) for y in years], "station int, year int, aws int")
    return [(r.start_year, r.end_year, r.break_reason, r.era) for r in timeline.segments(df, aws="aws").orderBy("segment").collect()]


def test_segments(spark):
    assert segs(spark, [1972, 1973, 1974, 1974]) == [(1972, 1974, "open", "unknown")]
    assert [s[:3] for s in segs(spark, [1904, 1905, 1913, 1916, 1917, 1918])] == [(1904, 1905, "open"), (1913, 1913, "resumed-after-gap"), (1916, 1918, "resumed-after-gap")]
    assert segs(spark, range(1990, 2005), 1999) == [(1990, 1998, "open", "manual"), (1999, 2004, "aws-transition", "aws")]
    assert segs(spark, [2000, 2001], 2000) == [(2000, 2001, "open", "aws")]
    assert segs(spark, [1990, 1995, 1996], 1995)[1][2] == "resumed-after-gap"


def test_clusters_of_relocations(spark):
    rows = [(4101, "norbeck", 52.400, -1.900), (4102, "norbeck-no-2", 52.400, -1.860), (9007, "norbeck-mill", 52.362, -1.915), (9113, "norbeck-top", 52.397, -1.868), (4200, "ludham", 52.420, -1.300), (300, "skarra", 57.100, -3.100)]
    s = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    links = entity.related_names(s, "id", "name").join(entity.neighbours(s, "id", "lat", "lon", 5.0), ["a", "b"]).select("a", "b")
    (c,) = entity.clusters(s, links, "id", "lat", "lon", "name").collect()
    assert c.cluster_id == "cluster-4101" and c.n == 4 and c.members == "4101;4102;9007;9113"


def test_neighbours_by_brute_force(spark):
    pts = [(i, 75.0 * math.sin(i * 1.7), 60.0 * math.sin(i * 2.3)) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, x)))
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a, b) <= 300}
    assert {(r.a, r.b) for r in entity.neighbours(df, "id", "lat", "lon", 300.0).collect()} == want


def test_circle_areas(spark):
    r = F.lit(1.0)
    rect = lambda *c: geo.rectangle_in_circle(*map(F.lit, map(float, c)), r)
    tri = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 0.0), (0.0, 3.0))])
    got = spark.range(1).select(rect(-2, -2, 2, 2), rect(0, -2, 2, 2), rect(-0.5, -0.5, 0.5, 0.5), rect(0, 0, 2, 2), rect(3, 3, 4, 4), rect(0.9, -2, 2, 2), geo.polygon_in_circle(tri, r)).first()
    cap = math.acos(0.9) - 0.9 * math.sqrt(1 - 0.81)
    assert list(got) == pytest.approx([math.pi, math.pi / 2, 1, math.pi / 4, 0, cap, math.pi / 4], abs=1e-9)


def test_ring_reasons(spark):
    rows = [("full", 1.0, 10.0, 10.0, True), ("half", 0.5, 4.0, 8.0, True), ("half", 0.5, 4.0, 8.0, True), ("sea", 1.0, 0.0, 0.0, True), ("gap", 1.0, 5.0, 5.0, True), ("gap", 1.0, None, None, False)]
    df = spark.createDataFrame(rows, "id string, w double, b double, l double, c boolean")
    got = {r.id: (r.fraction, r.reason) for r in rings.ring_fraction(df, ["id"], "b", "l", "c").collect()}
    assert got == {"full": (1.0, None), "half": (0.5, None), "sea": (None, "no-land-in-ring"), "gap": (None, "no-coverage")}


CITATIONS = [
    # text, first year, field, seen, renotified, revision, note
    ("SITE NAME: A\nDate Notified (Under 1949 Act): 1955\nDate Notified (Under 1981 Act): 1985", 1955, "1949-act", True, 1985, None, None),
    ("SITE NAME: A\nDate Notified (Under 1981 Act): 1985", None, None, False, 1985, None, None),
    ("SITE NAME: A\nDate Notified (Under 1949 Act):\nDate Notified (Under 1981 Act): 1985", None, None, True, 1985, None, None),
    ("NORTH: B\nDate  Notified (Under 1949 Act): \u2013\nFirst Notified:\n 1984", 1984, "first-notified", True, None, None, None),
    ("SITE NAME: A\nFirst Notified: 1960 Date of Last Revision: 1985\nSee boundary map overleaf", 1960, "first-notified", True, None, 1985, None),
    ("SITE NAME: A\nFirst Notified: 1960\nThe site was formerly part of B.\nEnd", 1960, "first-notified", True, None, None, "The site was formerly part of B."),
    ("SITE NAME: A\nDate of Renotification: 1986\n1949 Act", None, None, False, 1986, None, None),
    # spaces of other scripts than ASCII, as page layouts leave them, and letters that end a word only in ASCII
    ("SITE\u00a0NAME:\u2003\u00c9a\u00a0\nDate\u00a0Notified (Under\u20091949 Act):\u00a01960\nDate\u3000of Revision:\x1c\u00e91970 1971", 1960, "1949-act", True, None, 1971, None),
    ("SITE NAME: A\nFirst Notified: \U0001f600 1961\n\U0001f600\U0001f600 \u00e9extension no\nan\u00a0Extension\u00a0here \nEnd", 1961, "first-notified", True, None, None, "an\u00a0Extension\u00a0here"),
]


def test_citation_fields(spark):
    rows = textrules.citation_fields(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CITATIONS)], "i int, t string"), "t").orderBy("i").collect()
    for r, want in zip(rows, CITATIONS, strict=True):
        assert (r.first_notified_year, r.original_field, r.original_field_seen, r.renotified_year, r.revision_year, r.boundary_note) == want[1:], want[0]
    assert [r.citation_site_name for r in rows] == ["A", "A", "A", "B", "A", "A", "A", "\u00c9a", "A"]


def test_admission_order(spark):
    cases = [
        ("A", True, True, CITATIONS[0][0], ("ok", None, 1955, True)),
        ("A", True, True, CITATIONS[1][0], ("no-original-date", "renotification-only", None, None)),
        ("A", True, True, CITATIONS[2][0], ("no-original-date", "original-field-blank", None, None)),
        ("B SSSI", True, True, CITATIONS[3][0], ("ok", None, 1984, False)),
        ("A", True, True, CITATIONS[4][0], ("boundary-history-unresolved", None, 1960, None)),
        ("A", True, True, CITATIONS[5][0], ("boundary-history-unresolved", None, 1960, None)),
        ("Z", True, True, CITATIONS[0][0], ("identity-unverified", None, None, None)),
        ("Z", True, True, "nothing here", ("identity-unverified", None, None, None)),
        ("A", True, True, "SITE NAME: A\nno date", ("no-original-date", "original-field-absent", None, None)),
        ("A", True, True, " \n", ("no-original-date", "no-text", None, None)),
        ("A", True, True, None, ("no-original-date", "no-text", None, None)),
        ("A", False, True, CITATIONS[0][0], ("fetch-failed", None, None, None)),
        ("A", False, False, CITATIONS[0][0], ("no-citation-key", None, None, None)),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, site string, fetched boolean, key boolean, t string")
    got = textrules.admission(df, "t", has_key="key").orderBy("i").collect()
    for r, c in zip(got, cases, strict=True):
        assert (r.reason, r.reason_detail, r.first_notified_year, r.admitted_pre_1975) == c[4], c


def test_tag_kinds_are_the_four(spark):
    from isohyet.operators import features

    tags = [{"aeroway": "helipad"}, {"aeroway": "airstrip"}, {"aeroway": "runway"}, {"disused:aeroway": "apron"}, {"aeroway": "gate", "abandoned:aeroway": "taxiway"}, {}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t map<string,string>")
    assert [r.k for r in df.select("i", features.tag_kind(F.col("t")).alias("k")).orderBy("i").collect()] == [None, None, "runway", "disused:apron", "abandoned:taxiway", None]


def test_agreement(spark):
    rows = [(1, True, True, None), (2, True, False, None), (3, None, None, False), (4, False, False, True), (5, False, False, False)]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean, c boolean")
    got = {r.id: (r.status, r.voters, r.disagreeing) for r in inference.agreement(df, ["a", "b", "c"], ["c"]).collect()}
    assert got == {1: ("confirmed", 2, ""), 2: ("disputed", 2, "b"), 3: ("unclassified", 0, ""), 4: ("disputed", 3, "c"), 5: ("confirmed", 2, "")}


def test_trend_against_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    t = np.arange(120)
    y = 0.004 * t + 1.5 * (t >= 50) + rng.normal(0, 0.3, 120)
    x = np.column_stack([np.ones(120), t / 120, t >= 50, t >= 50])  # two breaks in one month: rank-deficient
    want = np.linalg.lstsq(x, y, rcond=None)[0][1]
    df = spark.createDataFrame([("s", int(i), float(v)) for i, v in zip(t, y)], "series string, month long, value double")
    b = spark.createDataFrame([("s", [50.0, 49.5, -3.0, 500.0])], "series string, months array<double>")
    r = trend.break_trend(df, b, value="value").first()
    assert r.slope == pytest.approx(want, abs=1e-9) and r.n_breaks == 2 and r.stderr > 0
    short = trend.break_trend(df.where("month < 20"), value="value").first()
    assert short.slope is None and short.stderr is None


@pytest.mark.parametrize("name", ["signal", "null", "killer_breaks", "killer_missing"])
def test_worlds(spark, name):
    world = synth.preset(name, stations=120)
    w = synth.make_world(spark, world)
    series = w["series"].cache()
    pairs = trend.make_pairs(w["stations"].where("urban").select("station"), w["stations"].where("not urban").select("station"))
    m = trend.pair_mean(trend.paired_difference(series, pairs, w["breaks"].select("station", "months"))).first()
    assert m.n_pairs == 60
    if name == "signal":
        assert abs(m.mean_slope - 0.30) < 0.05 and m.mean_slope / m.se > 5
    else:
        assert abs(m.mean_slope) < 2.5 * m.se
    steps = [x for r in w["breaks"].collect() for x in r.steps]
    if name == "killer_breaks":
        assert len(steps) == 120 and 0.2 < (sum(x * x for x in steps) / 120) ** 0.5 < 0.3
        near = w["breaks"].join(w["stations"], "station").groupBy("urban").agg(F.avg(F.col("months")[0] / 12 + 1975).alias("y")).collect()
        assert {r.urban: round(r.y) for r in near} == {True: 1992, False: 2002}
    else:
        assert not steps
    gaps = {r.urban: r.g for r in series.join(w["stations"], "station").groupBy("urban").agg(F.avg(F.col("value").isNull().cast("double")).alias("g")).collect()}
    assert (0.03 < gaps[True] < 0.06 and 0.17 < gaps[False] < 0.23) if name == "killer_missing" else gaps == {True: 0.0, False: 0.0}


def test_averaging_segment_slopes_is_fooled(spark):
    """The trap that the paired difference avoids: breaks at other times in an accelerating world make a difference between cohorts."""
    w = synth.make_world(spark, synth.preset("killer_breaks", stations=120, seed=15))
    series = trend.monthly_anomalies(w["series"], "station").join(w["breaks"].select("station", F.col("months")[0].alias("at")), "station")
    slopes = trend.split_slopes(series, F.col("at"), "station", value="anomaly").join(w["stations"], "station")
    by = {r.urban: r.s for r in slopes.groupBy("urban").agg(F.avg("naive_slope").alias("s")).collect()}
    assert abs(by[True] - by[False]) > 0.05


def test_incremental_ingest(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(5).write.parquet(src)
    incremental.ingest_new(spark, src, "id long", out, check)
    spark.range(5, 8).write.mode("append").parquet(src)
    incremental.ingest_new(spark, src, "id long", out, check)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_relations_join_at_their_ends(spark):
    from isohyet.operators import features

    p = lambda *xy: [{"lat": float(a), "lon": float(b)} for a, b in xy]
    rows = [("ring", 1, p((0, 0), (0, 1))), ("ring", 2, p((1, 1), (0, 1))), ("ring", 3, p((1, 1), (1, 0), (0, 0))), ("open", 1, p((5, 5), (6, 6))), ("open", 2, p((6, 6), (7, 5)))]
    df = spark.createDataFrame(rows, "feature string, way int, points array<struct<lat:double,lon:double>>")
    got = {r.feature: (r["shape"], len(r.points)) for r in features.assemble(df).collect()}
    assert got == {"ring": ("polygon", 5), "open": ("line", 3)}


def test_cover_fails_loudly(spark):
    from isohyet.operators import analysis

    a = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, digest string")
    analysis.require_cover(a, a)
    with pytest.raises(ValueError, match="missing"):
        analysis.require_cover(a, a.where("name = 'x'"))


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_components(spark, one_task):
    links = [(i + 1, i) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200)]
    got = dict(map(tuple, entity.components(spark.createDataFrame(links, "a long, b long"), one_task).collect()))
    assert got == {n: 0 if n <= 30 else 100 if n < 200 else 200 for p in links for n in p}


NAN, INF = float("nan"), float("inf")


def test_missing_p_is_no_test(spark):
    """Neither null nor NaN has a rank or counts among the tests of its family."""
    rows = [("a", 1, 0.01), ("a", 2, None), ("a", 3, 0.5), ("a", 4, NAN), ("b", 5, None), ("c", 6, 0.04), ("c", 7, NAN)]
    tests = spark.createDataFrame(rows, "f string, k int, p double")
    got = {r.k: (r["rank"], r.significant) for r in inference.benjamini_hochberg(tests, "k", "p", 0.05, "f").collect()}
    assert got == {1: (1, True), 2: (None, False), 3: (2, False), 4: (None, False), 5: (None, False), 6: (1, True), 7: (None, False)}


def test_spans_with_fractional_ends(spark):
    points = spark.createDataFrame([("a", i, t) for i, t in enumerate((0.0, 7199.9, 7200.0, 7200.2, 7200.5, -0.5, 14_400.0, None, NAN))], "by string, i int, t double")
    spans = spark.createDataFrame([("a", 0.0, 7200.5), ("a", -1.25, -0.25), ("a", 7200.2, 14_400.25), ("a", 5.0, 5.0), ("a", None, 9.0), ("a", 1.0, None), ("a", 1.0, NAN)], "by string, s double, e double")
    got = {(r.i, r.s) for r in joins.within_spans(points, spans, "by", "t", "s", "e", 7200).collect()}
    assert got == {(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0), (3, 7200.2), (4, 7200.2), (5, -1.25), (6, 7200.2)}
    with pytest.raises(Exception, match="no end"):
        joins.within_spans(points, spans.limit(1).withColumn("e", F.lit(INF)), "by", "t", "s", "e", 7200).collect()


def test_values_created_and_deleted_by_control(spark):
    rows = lambda *v: spark.createDataFrame(list(enumerate(v)), "k int, v double").withColumn("o", F.lit(0))
    before, after = rows(None, 3.0, 1.0, 2.0, None, NAN).where("k < 6"), rows(5.0, None, 1.0, 2.5, None, 4.0, 9.0)
    got = {r.k: (r.matched, r.outcome, r.delta, r.changed, r.band) for r in audit.qc_effects(before, after, ["k"], "v", ["o"]).collect()}
    assert got == {
        0: (True, "created", None, False, None), 1: (True, "deleted", None, False, None), 2: (True, "unchanged", 0.0, False, None), 3: (True, "changed", 0.5, True, "0.2-1"),
        4: (True, "unchanged", 0.0, False, None), 5: (True, "created", None, False, None), 6: (False, "unmatched", 0.0, False, None),
    }
    (t,) = audit.two_part(audit.qc_effects(before, after, ["k"], "v", ["o"]).withColumn("g", F.lit("x")), "g").collect()
    assert (t.n, t.n_created, t.n_deleted, t.n_changed, t.p_changed, t.mean_when_changed, t.mean_delta) == (4, 2, 1, 1, 0.25, 0.5, 0.125)


def test_trends_take_finite_values_alone(spark):
    clean = [("s", m, float(m % 5) + m / 120) for m in range(40)]
    dirty = [*clean, ("s", 50, NAN), ("s", 51, None), ("s", 52, INF), ("s", 53, -INF)]
    frames = [spark.createDataFrame(x, "series string, month int, value double") for x in (clean, dirty)]
    for fit in (trend.theil_sen, lambda d: trend.break_trend(d, value="value"), lambda d: trend.split_slopes(d, 20.0), lambda d: trend.break_trend(trend.monthly_anomalies(d))):
        a, b = (fit(d).collect() for d in frames)
        assert [tuple(r) for r in a] == [tuple(r)[:1] + tuple(pytest.approx(v, rel=1e-9) for v in r[1:]) for r in b]
    fits = spark.createDataFrame([(1.0,), (2.0,), (NAN,), (None,)], "slope double")
    assert tuple(trend.pair_mean(fits).first()) == (2, 1.5, pytest.approx(0.5))


def test_years_unknown_make_no_segment(spark):
    years = spark.createDataFrame([("a", 1990), ("a", None), ("a", 1991), ("b", None)], "station string, year int")
    assert [(r.station, r.start_year, r.end_year, r.n_segments) for r in timeline.segments(years).collect()] == [("a", 1990, 1991, 1)]


@pytest.mark.parametrize("most,broadcast", [(2_000_000, 50_000), (10, 50_000), (10, 0)])
def test_as_of_over_ranges(spark, monkeypatch, most, broadcast):
    """A hot key, dealt by ranges of time, gives what one sort gives; ties, missing keys and times among the rows."""
    import random

    monkeypatch.setattr(joins, "ONE_TASK_ROWS", most)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    lefts = [(i, key(), rng.choice([*range(400), None])) for i in range(600)]
    rights = [(key() if i % 3 else "hot", rng.choice([*range(100, 400), None]), i % 50, None if i % 7 == 0 else i) for i in range(300)]
    left, right = spark.createDataFrame(lefts, "i int, k string, t int"), spark.createDataFrame(rights, "k string, t int, v int, w int")
    low = lambda t: float("-inf") if t is None else t
    want = []
    for i, k, t in lefts:
        held = [r for r in rights if r[0] == k and low(r[1]) <= low(t)]
        last = max(held, key=lambda r: (low(r[1]), r[2], low(r[3])), default=(None,) * 4)
        want.append((i, k, t, last[2], last[3]))
    assert sorted(map(tuple, joins.as_of(left, right, "k", "t", ["v", "w"]).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rows", [50_000, 1])
def test_grid_of_axes(spark, monkeypatch, rows):
    monkeypatch.setattr(rings, "AXIS_ROWS", rows)
    axis = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    facts = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "s string, e string, n int")
    got = {tuple(r) for r in rings.complete_grid([axis("s", "a", "b"), axis("e", "x", "x", None)], facts, ["s", "e"]).collect()}
    assert got == {("a", "x", 1), ("a", None, None), ("b", "x", None), ("b", None, 2)}
    assert rings.complete_grid([axis("s", "a"), axis("e", "x").limit(0)], facts, ["s", "e"]).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_widest_pair(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    n = (1, 2, 3, 50, 400, 900, 300, 300)[seed]
    lat, lon = (rng.normal(52, 3, n), rng.normal(-2, 4, n)) if seed < 5 else (rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)) if seed == 5 else (np.full(n, 52.0), np.full(n, -1.0)) if seed == 6 else (52 + np.sin(np.arange(n)), -2 + np.cos(np.arange(n)))
    a, b = np.radians(lat)[:, None], np.radians(lon)[:, None]
    all_pairs = 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, np.sin((a - a.T) / 2) ** 2 + np.cos(a) * np.cos(a.T) * np.sin((b - b.T) / 2) ** 2)))
    assert entity.widest_km(lat, lon) == pytest.approx(all_pairs.max(), abs=1e-6)


def test_matched_effect_weighs_shared_controls(spark):
    import numpy as np

    pairs = [("t1", "a"), ("t2", "a"), ("t3", "b"), ("t4", "c"), ("t5", "c"), ("t6", "gone"), ("t7", "b")]
    value = {"t1": 3.0, "t2": 5.0, "t3": 1.0, "t4": 2.0, "t5": 2.5, "t6": 9.0, "t7": NAN, "a": 1.0, "b": 0.5, "c": 4.0, "gone": None}
    frame = spark.createDataFrame(list(value.items()), "id string, value double")
    got = analysis.matched_effect(spark.createDataFrame(pairs, "treated string, control string"), frame).first()
    d = {"a": [2.0, 4.0], "b": [0.5], "c": [-2.0, -1.5]}
    effect = np.mean([np.mean(v) for v in d.values()])
    scores = [sum((x - effect) / len(v) for x in v) for v in d.values()]
    assert got.effect == pytest.approx(effect) and got.stderr == pytest.approx(np.sqrt(sum(s * s for s in scores) * 3 / 2) / 3) and (got.n_pairs, got.n_controls) == (5, 3)
    alone = analysis.matched_effect(spark.createDataFrame(pairs[:2], "treated string, control string"), frame).first()
    assert tuple(alone) == (3.0, None, 2, 1)
    assert tuple(analysis.matched_effect(spark.createDataFrame([], "treated string, control string"), frame).first()) == (None, None, 0, 0)


def test_quick_search_misses_nothing(spark):
    """What the quick search leaves out, the patterns wouldn't find: letters of other cases and scripts, labels cut short, in capitals and across lines."""
    labels = ["Date Notified (Under 1949 Act): 1955", "FIRST NOTIFIED 1960", "f\u0131rst not\u0131fied: 1961", "F\u0130RST NOT\u0130FIED: 1962", "\u017fite name: x\nFir\u017ft Notified 1963", "date of revi\u017fion 1964", "DATE OF LAST REVISION: 1965"]
    labels += ["date notified (under 1981 act) 1986", "Date of Renotification 1987", "formerly\npart of y", "De-Notified", "an exten\u017fion", "EXTENSION", "sitename: z", "Site\u00a0Name q", "notif", "first", "1949", "", " ", "date  of\nrevision\n1990"]
    texts = [*labels, *(f"{a}\n{b}" for a in labels for b in labels[::3]), None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    quick = {r.i: r for r in textrules.citation_fields(df, "t").collect()}
    t = F.col("t")
    years = lambda *patterns: F.coalesce(*[textrules.first_year(textrules.field_value(t, p)) for p in patterns])
    plain = df.select(
        "i", textrules.cited_site(t).alias("citation_site_name"), years(*[p for _, p in textrules.ORIGINAL_FIELDS]).alias("first_notified_year"), years(*textrules.RENOTIFIED_FIELDS).alias("renotified_year"),
        years(textrules.REVISION_FIELD).alias("revision_year"), textrules.boundary_note(t).alias("boundary_note"),
    )
    for r in plain.collect():
        assert all(quick[r.i][c] == r[c] for c in r.asDict()), (texts[r.i], r)
    found = [r for r in quick.values() if r.first_notified_year]
    assert len(found) > 20 and {1961, 1962, 1963} & {r.first_notified_year for r in found}
