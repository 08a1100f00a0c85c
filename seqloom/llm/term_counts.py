"""Occurrences and records of every distinct term, by recursive radix partitioning.

The terms of all rows are cut out once and written to disk with their hashes; the leading
hash bits choose a partition.  A bucket that holds more rows than a partition should is split by further
bits, again and again; a bucket that holds a single hot term is split by the bits of the record
instead (of the occurrence where the record is null), whose distinct counts add up because
the splits share no record.  The rows of each partition go to one task, where DuckDB aggregates
them under a memory limit.

Out of core: where the shared folder is a plain file system, DuckDB spills into it.  On any
other file system (object stores, HDFS), into which it cannot write, Spark's external sort orders a
partition by hash, spilling where Spark is told to, and DuckDB gets one run of hash values after the
other, none larger than a run should be but for a single term's rows, which the plan bounds.

The plan of the partitions is a bounded table (at most ``MAX_LEAVES`` leaves and what hot terms
add); the counts behind it come from all rows.

Defined results: a field may hold several names; null, empty and ``-`` are no names; a name
counts once per (record, occurrence key), so redelivered rows change nothing; a null record
counts as no record; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, qualified

BLANKS = " \t\r\n\f\v "
FIRST_BITS, MORE_BITS, MAX_LEAVES = 12, 6, 65_536
#: Rows that one DuckDB aggregation takes in at best.
PARTITION_ROWS = 250_000
MEMORY_LIMIT = "400MB"


def explode_terms(df: DataFrame, fields: list[str], record: str, occurrence: str) -> DataFrame:
    """``f`` (place in ``fields``), ``term``, ``rec``, ``occ`` and the term's hash ``h``."""
    def names(k: int, column: str) -> Column:
        parts = F.split(F.coalesce(F.col(column).cast("string"), F.lit("")), "[,;|]")
        return F.transform(parts, lambda x: F.struct(F.lit(k).cast("tinyint").alias("f"), F.upper(F.btrim(x, F.lit(BLANKS))).alias("term")))

    rows = df.select(F.col(record).alias("rec"), F.col(occurrence).alias("occ"), F.explode(F.concat(*[names(k, c) for k, c in enumerate(fields)])).alias("x"))
    return rows.select("x.f", "x.term", "rec", "occ").filter(~F.col("term").isin("", "-")).withColumn("h", F.xxhash64("f", "term"))


def _bits(done: int, more: int) -> Column:
    """``more`` bits of the hash after the first ``done``, as an int."""
    return F.shiftrightunsigned(F.shiftleft(F.col("h"), done), 64 - more).cast("int")


def _array(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<int>")


def plan_partitions(rows: DataFrame, partition_rows: int = PARTITION_ROWS) -> tuple[Column, int, int]:
    """(partition of a row, number of partitions, rounds of splitting that were needed)."""
    first = {r[0]: r for r in rows.groupBy(_bits(0, FIRST_BITS).alias("b")).agg(F.count("*").alias("n"), F.min("h"), F.max("h")).collect()}
    total = sum(r[1] for r in first.values())
    most = max(partition_rows, total // (MAX_LEAVES // 2))
    base, splits, load = [], [], []  # per leaf: its first partition, how many by record; per open partition: rows

    def leaf(n: int, by_record: bool) -> int:
        k = -(-n // most) if by_record else 1
        if k == 1 and load and load[-1] + n <= most:
            load[-1] += n
            base.append(len(load) - 1)
        else:
            base.append(len(load))
            load.extend([n] if k == 1 else [most] * k)
        splits.append(k)
        return len(base) - 1

    levels: list[list[int]] = [[]]
    big: list[int] = []
    for b in range(1 << FIRST_BITS):
        r = first.get(b)
        if r is None or r[1] <= most or r[2] == r[3]:
            levels[0].append(leaf(r[1] if r else 0, bool(r) and r[1] > most))
        else:
            big.append(b)
            levels[0].append(-len(big))
    done, index = FIRST_BITS, F.element_at(_array(levels[0]), _bits(0, FIRST_BITS) + 1)
    while big:
        sub = rows.withColumn("v", index).filter("v < 0").groupBy((-F.col("v") - 1).alias("o"), _bits(done, MORE_BITS).alias("b"))
        found = {(r[0], r[1]): r for r in sub.agg(F.count("*").alias("n"), F.min("h"), F.max("h")).collect()}
        table, nxt = [], 0
        for o in range(len(big)):
            for b in range(1 << MORE_BITS):
                r = found.get((o, b))
                if r is None or r[2] <= most or r[3] == r[4] or done + 2 * MORE_BITS > 64:
                    table.append(leaf(r[2] if r else 0, bool(r) and r[2] > most))
                else:
                    nxt += 1
                    table.append(-nxt)
        index = F.when(index >= 0, index).otherwise(F.element_at(_array(table), (-index - 1) * (1 << MORE_BITS) + _bits(done, MORE_BITS) + 1))
        levels.append(table)
        big, done = list(range(nxt)), done + MORE_BITS
    first_of, ways = F.element_at(_array(base), index + 1), F.element_at(_array(splits), index + 1)
    own = F.when(F.col("rec").isNull(), F.xxhash64(F.lit("occ"), "occ")).otherwise(F.xxhash64("rec"))
    part = F.when(ways == 1, first_of).otherwise(first_of + F.pmod(own, ways).cast("int"))
    return part, max(1, len(load)), len(levels)


_COUNT = """
SELECT f, term, count(*)::BIGINT AS occurrences, count(DISTINCT rec)::BIGINT AS records
FROM (SELECT DISTINCT f, term, rec, occ FROM rows_in) GROUP BY f, term"""


def _counted(batches, schema: pa.Schema, memory: str, spill: str):
    import duckdb

    con = duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False})
    try:
        con.register("rows_in", pa.RecordBatchReader.from_batches(schema, batches))
        yield from con.execute(_COUNT).to_arrow_reader(20_000)
    finally:
        con.close()


def _runs(batches, rows: int):
    """Lists of batches, sorted by ``h``, that hold at least ``rows`` rows and end with a hash value's last row."""
    held, n = [], 0
    for b in batches:
        if b.num_rows and n >= rows:
            h = b.column(4).to_numpy()
            cut = int(np.searchsorted(h, held[-1].column(4)[-1].as_py(), "right"))
            if cut < b.num_rows:
                yield [*held, b.slice(0, cut)]
                held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield held


def _aggregate(spill: str | None, memory: str, run_rows: int):
    schema = pa.schema([("f", pa.int8()), ("term", pa.string()), ("rec", pa.int64()), ("occ", pa.int64())])

    def cast(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int8()), b.column(1).cast(pa.string()), b.column(2), b.column(3)], schema=schema)

    def run(batches):
        if spill is None:
            for held in _runs(batches, run_rows):
                yield from _counted(cast(held), schema, memory, "")
            return
        own = f"{spill}/{uuid.uuid4().hex}"
        os.makedirs(own)
        try:
            yield from _counted(cast(batches), schema, memory, own)
        finally:
            shutil.rmtree(own, ignore_errors=True)

    return run


def _local(path: str) -> str | None:
    """The plain path of a folder on a ``file:`` system, None on any other."""
    url = urlparse(path)
    return unquote(url.path) if url.scheme == "file" else None


def term_counts(
    df: DataFrame, fields: list[str], record: str, occurrence: str, partition_rows: int = PARTITION_ROWS, memory: str = MEMORY_LIMIT, spill_by_sort: bool = False
) -> DataFrame:
    """``field_name, term, occurrences, records`` of every distinct term of each field.

    ``spill_by_sort`` takes the way of file systems that DuckDB cannot spill to, wherever the shared folder is.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "terms")
    rows = explode_terms(df.select(*{record: 0, occurrence: 0, **dict.fromkeys(fields)}), fields, record, occurrence)
    rows = scratch.table(rows.withColumns({"rec": F.col("rec").cast("bigint"), "occ": F.col("occ").cast("bigint")}), "terms")
    part, n, _ = plan_partitions(rows, partition_rows)
    spill = None if spill_by_sort else _local(qualified(spark, f"{scratch.base}/spill"))
    placed = rows.select(part.alias("part"), "f", "term", "rec", "occ", "h").repartitionById(n, "part").drop("part")
    placed = placed.sortWithinPartitions("h") if spill is None else placed.drop("h")
    counted = placed.mapInArrow(_aggregate(spill, memory, partition_rows), "f tinyint, term string, occurrences bigint, records bigint")
    whole = counted.groupBy("f", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    names = F.array(*[F.lit(x) for x in fields])
    return whole.select(F.element_at(names, F.col("f") + 1).alias("field_name"), "term", "occurrences", "records")


def marked_terms(counts: DataFrame, total_records: int, rare: int = 2, common: float = 0.1) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` (at most ``rare`` records), else ``common`` (more than that share of them), else null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common * total_records), "common")
    return counts.withColumn("mark", mark)
