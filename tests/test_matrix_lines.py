"""Matrix lines in blocks: how often a class is sent, and every line's text."""

import numpy as np

from seqloom.sinks import exports
from seqloom.sinks.exports import identity_csv


def inputs(spark, n, letters):
    v = spark.range(n).selectExpr("IF(id % 5 = 0, 'L', 'H') AS chain_class", "id AS member", letters, "1 AS width")
    order = v.selectExpr("chain_class", "member", "CAST(row_number() OVER (PARTITION BY chain_class ORDER BY member DESC) - 1 AS INT) AS place", "concat('r,', member) AS label")
    return order, v


def test_lines_of_any_block(spark, monkeypatch):
    monkeypatch.setattr(exports, "LINES_A_TASK", 3)
    monkeypatch.setattr(exports, "PAIRS_AT_ONCE", 20)
    order, v = inputs(spark, 40, "CAST(concat(chr(id % 3), chr(id % 2), chr(id % 4)) AS BINARY) AS codes")
    got = {(r.class_no, r.place): r.line for r in identity_csv(order, v).collect()}
    want = {}
    for no, klass in enumerate("LH"):
        m = [k for k in reversed(range(40)) if ("L" if k % 5 == 0 else "H") == klass]
        g = np.array([[k % 3, k % 2, k % 4] for k in m])
        if no:
            want[no, -3] = ""
        want[no, -2] = f"# Chain: {klass} | Scope: Full sequence | Scheme: imgt | N={len(m)}"
        want[no, -1] = ",".join(["", *(f'"r,{k}"' for k in m)])
        for i, a in enumerate(g):
            cells = ["100.00" if i == j else "%.2f" % (sum(x == y > 0 for x, y in zip(a, b)) / max(1, sum(x > 0 or y > 0 for x, y in zip(a, b))) * 100.0) for j, b in enumerate(g)]
            want[no, i] = ",".join([f'"r,{m[i]}"', *cells])
    assert got == want


def test_a_class_is_sent_to_few_blocks(spark):
    """Copies of a class follow the cores, not its size."""
    order, v = inputs(spark, 10000, "CAST(concat(chr(1 + id % 20), chr(1 + id % 7)) AS BINARY) AS codes")
    sent = identity_csv(order, v)._jdf.queryExecution().optimizedPlan().children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent).count()
    assert rows == 10000 * 8


def test_labels_are_sent_where_they_are_needed(spark):
    order, v = inputs(spark, 10000, "CAST(concat(chr(1 + id % 20), chr(1 + id % 7)) AS BINARY) AS codes")
    sent = identity_csv(order, v)._jdf.queryExecution().optimizedPlan().children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent)
    assert rows.filter("label IS NOT NULL").count() < 10000 * 2


def test_the_order_is_made_once(spark):
    from seqloom.api import compute_pim

    rows = [(k, f"r{k}", [("H", [(p, " ", "ACD"[(k + p) % 3]) for p in range(1, 4)])]) for k in range(3)]
    df = spark.createDataFrame(rows, "key long, id string, domains array<struct<chain_class string, numbering array<struct<position int, insertion string, amino_acid string>>>>")
    lines = compute_pim(df)
    assert "FlatMapGroupsInPandas" not in lines._jdf.queryExecution().optimizedPlan().toString() and lines.count() == 5
