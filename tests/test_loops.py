"""Loop ranges are joined without moving the cells."""

from seqloom.operators.positions import loop_residues


def test_ranges_made_in_python_are_broadcast(spark):
    cells = spark.createDataFrame([("imgt", "H", 27, "A"), ("imgt", "H", 38, "C"), ("imgt", "H", 39, "D"), ("imgt", None, 30, "E"), (None, "H", 30, "F"), ("imgt", "L", 30, "G"), ("imgt", "H", None, "K")], "scheme string, chain_class string, position int, amino_acid string")
    ranges = spark.createDataFrame([("imgt", "H", "cdr1", 27, 38), ("imgt", "H", "cdr2", 30, 40)], "scheme string, chain_class string, cdr string, first int, last int")
    got = loop_residues(cells, ranges)
    assert sorted((r.cdr, r.amino_acid) for r in got.collect()) == [("cdr1", "A"), ("cdr1", "C"), ("cdr2", "C"), ("cdr2", "D")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
