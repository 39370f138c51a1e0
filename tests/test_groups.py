"""Groups of claims at size."""

from __future__ import annotations

from assaykit.plans import queries


def test_groups_of_two_documents_that_share_a_short_hash(spark, tmp_path):
    """Two claims of the line items at 60 times sf0.1 whose keys agree in 12 digits of their SHA-1, and a pair that is one group."""
    rows = [(94185 * 50, 639517, 1, 17.0), (150561 * 50, 1005111, 1, 12.0), (150561 * 50, 7, 2, 5.0), (150561 * 50 + 1, 7, 2, 5.0)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.metric: (r.groups, r.members) for r in queries.duplicate_groups(spark, str(tmp_path)).collect()}
    assert found == {"yield": (1, 2), "temperature": (1, 2)}
