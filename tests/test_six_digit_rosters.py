"""Athletes whose keys are shifts of each other stay apart, so that the SQL's answer is the only one."""

from oracle import compare

from pitchside.plans import registry

SHIFTED = [(100233, 23301), (100808, 80801), (100618, 61801), (100483, 48301), (100488, 48801), (100683, 68301), (100798, 79801)]


def test_shifted_keys(spark, tmp_path):
    keys = [k for pair in SHIFTED for k in pair] + list(range(100200, 100250)) + list(range(23300, 23340)) + [483, 5, 7_100_483]
    spark.createDataFrame([(k,) for k in sorted(set(keys))], "p_partkey long").selectExpr("p_partkey", "'Brand#11' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    assert compare(spark, "d20_roster_matches", registry.queries()["d20_roster_matches"], registry.oracle_sql()["d20_roster_matches"], str(tmp_path)) == ""
