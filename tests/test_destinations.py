"""Mappings, links on sheets, migrations and run inventories."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import destinations

NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)
SHAPE = "name string, client_id string, destination_id string, spreadsheet_id string, sheet_id int, tab_name string, header array<string>, column_mapping map<string,string>, config_sha256 string, logical_uri string"


def destination(name, header=("A", "Link ü"), mapping=None, sha=None, **more):
    known = {"client_id": "c", "destination_id": name, "spreadsheet_id": "s", "sheet_id": 7, "tab_name": 'T"'} | more
    mapping = {"Job Link": "Link ü", "Title": "A"} if mapping is None else mapping
    digest = hashlib.sha256(json.dumps(known | {"header": list(header), "column_mapping": mapping}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return (name, *known.values(), list(header), mapping, sha or digest, f"sheet:{name}")


def test_mappings(spark):
    rows = [destination("ok"), destination("no_header", header=()), destination("unknown_field", mapping={"Job Link": "A", "X": "B"}), destination("no_link", mapping={"Title": "A"}), destination("target_twice", mapping={"Job Link": "A", "Title": "A"}),
            destination("target_not_once", header=("A", "A", "Link ü")), destination("digest_differs", sha="0")]
    got = spark.createDataFrame(rows, SHAPE).select("name", destinations.mapping_problem(["Job Link", "Title"]).alias("p")).collect()
    assert {r["name"]: r["p"] for r in got} == {r[0]: None if r[0] == "ok" else r[0] for r in rows}


def test_links_on_sheets(spark):
    known = spark.createDataFrame([destination("d1"), destination("d2")], SHAPE)
    sheet = lambda rows: spark.createDataFrame(rows, "destination_id string, rows array<array<string>>")
    head = ["A", "Link ü"]
    links = destinations.sheet_links(sheet([("d1", [head, ["x", " https://a.org/1?utm_source=z "], ["y"], ["z", ""], ["w", "https://a.org/1"]]), ("d2", [head])]), known)
    assert sorted(tuple(r) for r in links.collect()) == [("c", "sheet:d1", "https://a.org/1"), ("c", "sheet:d1", "https://a.org/1?utm_source=z")]
    for rows in ([["A"]], [head, ["1", "2", "3"]], []):
        with pytest.raises(Exception, match="header differs|longer than"):
            destinations.sheet_links(sheet([("d1", rows)]), known).collect()
    stored = spark.createDataFrame([("c", "sheet:d1", "https://a.org/9", "old")], "client_id string, destination string, normalized_url string, first_observed_at string")
    more = links.union(spark.createDataFrame([("c", "sheet:d1", "https://a.org/9")], links.schema))
    new, counts = destinations.observe_links(more, stored, F.lit("now"))
    assert [tuple(r) for r in new.collect()] == [("c", "sheet:d1", "https://a.org/1", "now")] and tuple(counts.first()) == ("c", "sheet:d1", 2, 1)
    with pytest.raises(Exception, match="no web address"):
        destinations.observe_links(spark.createDataFrame([("c", "d", "nowhere")], links.schema), stored, F.lit("now"))


def test_migration_and_inventory(spark):
    rows = spark.createDataFrame([("g1", "c", "old:1", 1), ("g2", "c", "old:1", 2), ("g2", "c", "new:1", 3), ("g3", "c", "other", 4)], "group_id string, client_id string, destination string, at int")
    moved = destinations.migrated(rows, spark.createDataFrame([("old:1", "new:1")], "legacy string, logical string"), ["group_id", "client_id", "destination"])
    assert sorted(tuple(r) for r in moved.collect()) == sorted([*map(tuple, rows.collect()), ("g1", "c", "new:1", 1)])
    ago = lambda h: None if h is None else NOW - datetime.timedelta(hours=h)
    members = spark.createDataFrame([("r", "t1", "j1"), ("r", "t2", "j1"), ("r", "t1", "j2"), ("r", "t1", "j3"), ("r", "t1", "j4"), ("r", "t1", "j5"), ("r", "t1", "lost")], "run_id string, target string, job_id string")
    jobs = spark.createDataFrame([("j1", "seen", ago(1)), ("j2", "closed", ago(1)), ("j3", "new", None), ("j4", "seen", ago(99)), ("j5", None, None)], "job_id string, lifecycle string, posted_at timestamp")
    known = spark.createDataFrame([("j3", ago(200)), ("j1", ago(500))], "job_id string, posted_at timestamp")
    got = destinations.run_inventory(members, jobs, known, F.lit(NOW), 72).collect()
    assert {r["job_id"]: r["active"] for r in got} == {"j1": True, "j3": False, "j4": False, "j5": True} and len(got) == 4
