"""Queries on people with stat rows take all line items."""

import pytest
from oracle import connect

from pitchside.plans import registry

SF = "/root/testdata/sf0.001"


def test_redirect_takes_every_line(spark):
    rows = registry.queries()["d06_redirected_stats"](spark, SF)
    assert rows.select("game_id").distinct().count() == connect(SF).execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0]


@pytest.mark.parametrize("name", ["j15_pair_rows", "d05_same_team_candidates", "d07_cross_team_merge", "d06_redirected_stats", "d12_junk_people"])
def test_only_the_unnamed_query_keeps_its_filter(name):
    assert ("l_quantity" in registry.oracle_sql()[name]) == (name == "d12_junk_people")
