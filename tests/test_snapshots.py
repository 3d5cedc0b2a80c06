"""Snapshots: pages equal slices of the order and read no other files; owners, expiry, cursors."""

import datetime

import pytest

from gleaner.operators import snapshots

NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)


def rows(spark, n=500):
    return spark.createDataFrame([(f"g{i * 7 % 10}" if i % 50 else None, i * 37 % n, i) for i in range(n)], "g string, score int, id int")


def test_pages(spark, tmp_path):
    data = sorted([tuple(r) for r in rows(spark).collect()], key=lambda r: (-r[1], r[2]))
    snap = snapshots.create(rows(spark), ["-score", "id"], f"file://{tmp_path}", "me", NOW, files=7)
    assert snap.total == 500
    seen, handle = [], snapshots.cursor(snap, 0)
    while handle:
        found, position = snapshots.resolve(spark, f"file://{tmp_path}", "me", handle, NOW)
        page, links = snapshots.page(spark, found, position, 60)
        got = [tuple(r) for r in page.collect()]
        assert got == [(position + i, *r) for i, r in enumerate(data[position : position + 60])]
        assert len(page.inputFiles()) <= 2 and links["total"] == 500
        assert (links["previous"] is None) == (position == 0)
        seen += got
        handle = links["next"]
    assert len(seen) == 500
    assert snapshots.page(spark, snap, 499, 10)[0].count() == 1 and snapshots.page(spark, snap, 500, 10)[0].collect() == [] and snapshots.page(spark, snap, 5, 0)[0].collect() == []


def test_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 30)
    snap = snapshots.create(rows(spark), ["id"], f"file://{tmp_path}", "me", NOW, files=3)
    page, _ = snapshots.page(spark, snap, 95, 60)
    assert [r["id"] for r in page.collect()] == list(range(95, 155)) and len(page.inputFiles()) <= 4


def test_members(spark, tmp_path):
    snap = snapshots.create(rows(spark), ["g", "id"], f"file://{tmp_path}", "me", NOW, files=8)
    data = [tuple(r) for r in rows(spark).collect()]
    for g in ["g3", "g0", None]:
        ids = sorted(r[2] for r in data if r[0] == g)
        page = snapshots.members(spark, snap, g, 2, 5)
        assert [r["id"] for r in page.collect()] == ids[2:7] and len(page.inputFiles()) <= 3
        assert [r["id"] for r in snapshots.members(spark, snap, g, len(ids) - 1, 9).collect()] == ids[-1:]
    assert snapshots.members(spark, snap, "none", 0, 5).collect() == [] and snapshots.members(spark, snap, "g3", 10_000, 5).collect() == []


def test_owners_expiry_and_limits(spark, tmp_path):
    root = f"file://{tmp_path}"
    some = rows(spark, 10)
    snaps = [snapshots.create(some, ["id"], root, "me", NOW, files=1) for _ in range(5)]
    with pytest.raises(snapshots.SnapshotError, match="RATE_LIMITED"):
        snapshots.create(some, ["id"], root, "me", NOW, files=1)
    other = snapshots.create(some, ["id"], root, "you", NOW, files=1)
    with pytest.raises(snapshots.SnapshotError, match="INVALID_CURSOR"):
        snapshots.get(spark, root, "me", other.id, NOW)
    with pytest.raises(snapshots.SnapshotError, match="INVALID_CURSOR"):
        snapshots.resolve(spark, root, "me", "no cursor", NOW)
    late = NOW + datetime.timedelta(minutes=30)
    with pytest.raises(snapshots.SnapshotError, match="SNAPSHOT_EXPIRED"):
        snapshots.get(spark, root, "me", snaps[0].id, late)
    snapshots.create(some, ["id"], root, "me", late, files=1)  # the expired ones went
    assert len(snapshots.live(spark, root, "me", late)) == 1
    with pytest.raises(snapshots.SnapshotError, match="SNAPSHOT_EXPIRED"):
        snapshots.get(spark, root, "me", snaps[0].id, NOW)


def test_empty(spark, tmp_path):
    snap = snapshots.create(rows(spark, 10).limit(0), ["id"], f"file://{tmp_path}", "me", NOW)
    page, links = snapshots.page(spark, snap, 0, 10)
    assert page.collect() == [] and links == {"previous": None, "next": None, "total": 0}
