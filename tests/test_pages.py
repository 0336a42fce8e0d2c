import json

import pytest

from isohyet.sources import pages


def put(root, n, rows, following=True):
    folder = root / f"page={n}"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"id": r}) for r in rows] + [json.dumps({"next": n + 1})] * following
    half = len(lines) // 2
    (folder / "part-0.json").write_text("\n".join(lines[:half]))
    (folder / "part-1.json").write_text("\n".join(lines[half:]) + "\n")
    (folder / "_SUCCESS").write_text("")


def ids(spark, root):
    return sorted((r.page, json.loads(r.value)["id"]) for r in pages.fetched(spark, f"{root}/out").collect())


@pytest.mark.parametrize("a_batch", [2, 20])
def test_runs_go_on_where_the_last_ended(spark, tmp_path, a_batch):
    """Stopped for want of page 4, then at a page without a next one, then at an empty one: nothing is taken twice, nothing left out."""
    run = lambda: pages.fetch_new(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", a_batch)
    for n in (1, 2, 3):
        put(tmp_path / "in", n, [n * 10, n * 10 + 1])
    run()
    want = [(n, n * 10 + i) for n in (1, 2, 3) for i in (0, 1)]
    assert ids(spark, tmp_path) == want
    run()
    assert ids(spark, tmp_path) == want
    put(tmp_path / "in", 4, [40])
    put(tmp_path / "in", 5, [50], following=False)
    put(tmp_path / "in", 6, [60])
    run()
    want += [(4, 40), (5, 50)]
    assert ids(spark, tmp_path) == want
    put(tmp_path / "in", 5, [50, 999])  # has grown: it is taken already, page 6 isn't
    put(tmp_path / "in", 7, [], following=False)
    run()
    assert ids(spark, tmp_path) == [*want, (6, 60)]


def test_a_batch_is_read_again_alike(tmp_path):
    for n in range(1, 6):
        put(tmp_path, n, range(n))
    reader = pages.PageReader({"path": str(tmp_path), "pages_a_batch": "2"})
    at, taken = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, end))
        if end == at:
            break
        taken += rows
        at = end
    assert at == {"page": 5} and [r[:2] for r in taken] == [(n, i) for n in range(1, 6) for i in range(n)]
    assert pages.PageReader({"path": f"{tmp_path}/nowhere"}).read({"page": 0})[1] == {"page": 0}


def batches(mark):
    return sorted(int(p.name) for p in (mark / "commits").iterdir() if p.name.isdigit())


def test_all_pages_are_one_batch_of_many_tasks(spark, tmp_path):
    """Batches don't grow in number with pages; pages without elements end nothing; what was taken isn't looked at again."""
    run = lambda: pages.fetch_new(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", 2)
    for n in range(1, 76):
        put(tmp_path / "in", n, [] if 10 <= n < 20 else [n], following=n < 75)
    run()
    want = [(n, n) for n in range(1, 76) if not 10 <= n < 20]
    assert ids(spark, tmp_path) == want and batches(tmp_path / "mark") == [0]
    put(tmp_path / "in", 3, [3], following=False)  # is taken: where it leads no longer matters
    put(tmp_path / "in", 75, [75])
    put(tmp_path / "in", 76, [76], following=False)
    run()
    assert ids(spark, tmp_path) == [*want, (76, 76)] and batches(tmp_path / "mark") == [0, 1]


@pytest.mark.parametrize("line", ['{"next": 2}', '{"\\u006eext": 2}', '{"next": null}', '{"next": 2, "id": 1}', '{"id": "next"}', '["next"]', ""])
def test_what_is_told_of_a_page(tmp_path, line):
    put(tmp_path, 1, [5], following=False)
    (tmp_path / "page=1/part-2.json").write_text(line)
    reader = pages.PageReader({"path": str(tmp_path)})
    assert reader.told(1) == (True, any(map(pages.follows, reader.page(1)))) and reader.told(2) == (False, False)
