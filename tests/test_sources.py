import json

import pytest

from cellspark.sources import readers


def test_triangulations(spark, tmp_path):
    path = tmp_path / "manifolds.json"
    path.write_text(json.dumps([{"name": "S^2", "genus": 0, "triangulation": [[1, 2, 3], [1, 2, 4], [1, 3, 4], [4, 3, 2]]}]))
    graphs, cells = readers.triangulations(spark, str(path))
    assert [r["name"] for r in graphs.collect()] == ["S^2"]
    assert {r["rank"]: r["count"] for r in cells.groupBy("rank").count().collect()} == {0: 4, 1: 6, 2: 4}


def test_counties(spark):
    row = lambda fips, dem, gop, income, birth: (fips, dem, gop, income, "1", birth, "2", "3", "4")
    stats = spark.createDataFrame([row("10", "6", "2", "1,5", "7"), row("20", "1", "3", "2.5", "bad"), row("30", "1", "1", "9", "9"), row("x", "1", "1", "1", "1")], readers.COUNTY)
    links = spark.createDataFrame([(10, 20), (20, 10), (10, 10), (20, 99), (30, 10)], "SRC long, DST long")  # 30 is the end of none
    nodes, edges = readers.counties(stats, links)
    got = {r["node"]: (r["x"], r["y"]) for r in nodes.collect()}
    assert got[0] == ([1.5, 1.0, 7.0, 2.0, 3.0, 4.0], 0.5)
    assert got[1][0][2] == pytest.approx((7 + 9 + 1) / 3) and got[1][1] == -0.5
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0)]
    nodes, _ = readers.counties(stats, links, "BirthRate")
    got = {r["node"]: (r["x"], r["y"]) for r in nodes.collect()}
    assert got[0] == ([1.5, 1.0, 2.0, 3.0, 4.0, 0.5], 7.0)


def test_hypergraph(spark, tmp_path):
    (tmp_path / "a.content").write_text("0 1 0 3\n1 0 1 4\n2 1 1 3\n")
    (tmp_path / "a.edges").write_text("0 7\n1 7\n0 7\n")
    nodes, members = readers.hypergraph_content(spark, str(tmp_path / "a.content"), str(tmp_path / "a.edges"))
    assert {r["node"]: (r["x"], r["y"]) for r in nodes.collect()} == {0: ([1.0, 0.0], 0), 1: ([0.0, 1.0], 1), 2: ([1.0, 1.0], 0)}
    assert sorted((r["he"], r["node"]) for r in members.collect()) == [(7, 0), (7, 1), (10, 2)]


def test_drive_links():
    assert readers.drive_file_id("https://host/uc?id=ab") == readers.drive_file_id("https://host/file/d/ab/view") == "ab"
    with pytest.raises(ValueError, match="no file id"):
        readers.drive_file_id("https://host/other")
