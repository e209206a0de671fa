"""Pairs of people of very common names are made block by block, in an order that is stored in little room."""

from pathlib import Path

from pitchside.operators import resolution


def test_pairs_are_whole_and_small(spark, tmp_path):
    n = 1200  # six hundred people of either name, whose ids are in no order
    people = spark.range(n).selectExpr("id * 7919 % 1200 AS id", "1L AS team_id", "IF(id % 2 = 0, 'Peirce SMALL', 'Pierce SMALL') AS name").repartition(7)
    stats = spark.range(3 * n).selectExpr("id AS game_id", "pmod(hash(id), 1200) AS id")
    pairs = resolution.fuzzy_candidates(people, stats)
    pairs.coalesce(1).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == (n // 2) ** 2 == got.select("left_id", "right_id").distinct().count() and got.filter("left_id >= right_id").isEmpty()
    counts = {r.id: r["count"] for r in stats.groupBy("id").count().collect()}
    ends = {(r.left_id, r.left_stats) for r in got.select("left_id", "left_stats").distinct().collect()} | {(r.right_id, r.right_stats) for r in got.select("right_id", "right_stats").distinct().collect()}
    assert ends == {(i, counts.get(i, 0)) for i in range(n)}
    assert sum(p.stat().st_size for p in Path(tmp_path).glob("pairs/*.parquet")) < 0.9 * (n // 2) ** 2  # bytes a row
