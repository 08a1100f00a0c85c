"""Numbered positions across domains: unions, wide rows, alignments, gap filling."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import position_label
from ..functions.sequence import let
from ..runtime import maybe_broadcast

KEYS = ("result_no", "domain_pos")


def residue_rows(results: DataFrame, key: str = "result_no") -> DataFrame:
    """``result_no, domain_pos, scheme, chain_class, idx, position, insertion, amino_acid`` of every numbered position."""
    d = results.select(F.col(key).alias("result_no"), F.posexplode("domains").alias("domain_pos", "d")).filter("d is not null")
    scheme = F.col("d.scheme") if "scheme" in results.schema["domains"].dataType.elementType.names else F.lit(None).cast("string")
    d = d.select("result_no", "domain_pos", scheme.alias("scheme"), F.col("d.chain_class").alias("chain_class"), F.posexplode("d.numbering").alias("idx", "r"))
    return d.filter("r is not null").select(
        "result_no", "domain_pos", "scheme", "chain_class", "idx", F.col("r.position").alias("position"), F.when(F.trim("r.insertion") == "", F.lit(" ")).otherwise(F.coalesce("r.insertion", F.lit(" "))).alias("insertion"), F.col("r.amino_acid").alias("amino_acid")
    )


def run_ranks(rows: DataFrame) -> DataFrame:
    """Adds ``run_rank``: place inside a run of consecutive residues at one position (gaps and islands)."""
    by_domain = Window.partitionBy(*KEYS).orderBy("idx")
    by_position = Window.partitionBy(*KEYS, "position").orderBy("idx")
    island = rows.withColumn("_island", F.row_number().over(by_domain) - F.row_number().over(by_position))
    return island.withColumn("run_rank", (F.row_number().over(Window.partitionBy(*KEYS, "position", "_island").orderBy("idx")) - 1).cast("int")).drop("_island")


def position_union(rows: DataFrame) -> DataFrame:
    """Every (position, insertion) once, with the highest rank and the first record that has it.

    ``max`` and ``min`` of plain columns: map-side partial aggregation leaves a few hundred rows to shuffle.
    """
    return run_ranks(rows).groupBy("position", "insertion").agg(F.max("run_rank").alias("max_rank"), F.min(F.struct("result_no", "domain_pos", "idx")).alias("first_seen"))


def _domain_arrays(results: DataFrame, key: str) -> DataFrame:
    """One row a domain with its positions, insertions and residues as arrays."""
    d = results.select(F.col(key).cast("bigint").alias("result_no"), F.posexplode("domains").alias("domain_pos", "d")).filter("d is not null and size(d.numbering) > 0")
    return d.select("result_no", "domain_pos", F.col("d.numbering.position").alias("p"), F.col("d.numbering.insertion").alias("i"), F.col("d.numbering.amino_acid").alias("a"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """(domain row, place, position, insertion, residue) of all cells of a batch; cells without a position are left out."""
    lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    idx = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    pos = batch.column(2).flatten()
    live = np.flatnonzero(pc.is_valid(pos).to_numpy(zero_copy_only=False))
    take = pa.array(live)
    ins = pc.fill_null(batch.column(3).flatten().take(take), " ")
    ins = pc.if_else(pc.equal(pc.utf8_trim_whitespace(ins), ""), " ", ins)
    return row[live], idx[live], pos.take(take).to_numpy(zero_copy_only=False), ins, batch.column(4).flatten().take(take)


def position_union_of(results: DataFrame, key: str = "result_no") -> DataFrame:
    """:func:`position_union` straight from the nested documents.

    A domain's numbering lies whole in its row, so runs are ranked and positions gathered
    inside the map stage; what is shuffled is a few hundred rows a task.
    """

    def run(batches):
        for batch in batches:
            row, idx, pos, ins, _ = _flat(batch)
            fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] != pos[:-1]))) if len(row) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0)) if len(row) else idx
            cells = pd.DataFrame({"position": pos, "insertion": ins.to_pandas(), "rank": np.arange(len(row)) - start})
            cells["r"] = batch.column(0).to_numpy(zero_copy_only=False)[row]
            cells["d"], cells["i"] = batch.column(1).to_numpy(zero_copy_only=False)[row], idx
            first = cells.sort_values(["r", "d", "i"], kind="stable").drop_duplicates(["position", "insertion"])
            out = first.drop(columns="rank").merge(cells.groupby(["position", "insertion"], as_index=False)["rank"].max(), on=["position", "insertion"])
            yield pa.RecordBatch.from_pandas(out.astype({"position": "int32", "rank": "int32", "d": "int32", "i": "int32"})[["position", "insertion", "rank", "r", "d", "i"]], preserve_index=False)

    part = _domain_arrays(results, key).mapInArrow(run, "position int, insertion string, rank int, r bigint, d int, i int")
    seen = F.struct(F.col("r").alias("result_no"), F.col("d").alias("domain_pos"), F.col("i").alias("idx"))
    return part.groupBy("position", "insertion").agg(F.max("rank").alias("max_rank"), F.min(seen).alias("first_seen"))


def grid_texts(rows: int, width: int, row: np.ndarray, at: np.ndarray, values: pa.Array, filler: str = "-") -> pa.Array:
    """One text a row of ``width`` places; ``values`` go to (row, at), later ones over earlier ones; null is the filler."""
    coded = pc.fill_null(values, filler).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    letters = [filler, *words.to_pylist()]
    if all(len(x) == 1 and x.isascii() for x in letters):
        grid = np.full((rows, width), ord(filler), np.uint8)
        grid[row, at] = np.array([ord(x) for x in letters[1:]], np.uint8)[code] if len(code) else 0
        off = np.arange(rows + 1, dtype=np.int64) * width
        return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(off), pa.py_buffer(grid)).cast(pa.string())
    grid = np.zeros((rows, width), np.int64)
    grid[row, at] = code + 1
    return pa.array(["".join([letters[k] for k in g]) for g in grid.tolist()], pa.string())


def _labels(pos: np.ndarray, ins: pa.Array) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """(label of each cell, the distinct (position, insertion))."""
    coded = ins.dictionary_encode()
    words = coded.dictionary.to_pylist()
    key = pos.astype(np.int64) * max(1, len(words)) + coded.indices.to_numpy(zero_copy_only=False)
    uniq, label = np.unique(key, return_inverse=True)
    return label, [(k // len(words), words[k % len(words)]) for k in uniq.tolist()]


def aligned_texts_of(results: DataFrame, key: str = "result_no", filler: str = "-") -> DataFrame:
    """:func:`aligned_texts` of residues straight from the nested documents, without a shuffle of cells.

    The union of positions is bounded by the scheme's labels and travels with the tasks.
    """
    union = position_union_of(results, key).orderBy("position", "max_rank", "first_seen").select("position", "insertion").collect()
    place = {(r[0], r[1]): k for k, r in enumerate(union)}

    def run(batches):
        for batch in batches:
            row, _, pos, ins, aa = _flat(batch)
            label, names = _labels(pos, ins)
            at = np.array([place[k] for k in names], np.int64)[label] if names else label
            # of cells with one label the least residue stays, whatever their order
            order = pc.sort_indices(aa, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()[::-1]
            text = grid_texts(batch.num_rows, len(place), row[order], at[order], aa.take(pa.array(order)), filler)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["result_no", "domain_pos", "aligned"])

    return _domain_arrays(results, key).mapInArrow(run, "result_no bigint, domain_pos int, aligned string")


def label_columns(domains: DataFrame, labels: list[str], *keep: str, numbering: str = "numbering") -> DataFrame:
    """``keep`` and one column a label of the residues of each domain's numbering, ``-`` where it has none.

    A domain's numbering lies whole in its row, so nothing is shuffled.  Of several residues at one label the first counts;
    labels that are not asked for are left out.
    """
    place = {x: k for k, x in enumerate(labels)}
    kept = [f"`{c}` {domains.schema[c].dataType.simpleString()}" for c in keep]
    names = [*keep, *labels]

    def run(batches):
        for batch in batches:
            cells = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), pa.nulls(batch.num_rows), *batch.columns[len(keep) :]], names=list("rdpia"))
            row, _, pos, ins, aa = _flat(cells)
            label, seen = _labels(pos, ins)
            at = np.array([place.get(f"{p}{i.strip(' ')}", -1) for p, i in seen], np.int64)[label] if seen else label
            live = np.flatnonzero(at >= 0)[::-1]
            coded = pc.fill_null(aa, "-").dictionary_encode()
            code = np.zeros((batch.num_rows, len(labels)), np.int32)
            code[row[live], at[live]] = coded.indices.to_numpy(zero_copy_only=False)[live] + 1
            words = pa.array(["-", *coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(words.take(pa.array(np.ascontiguousarray(code[:, k]))) for k in range(len(labels)))], names=names)

    n = F.coalesce(F.col(numbering), F.from_json(F.lit("[]"), domains.schema[numbering].dataType))
    source = domains.select(*keep, n.alias("_n")).select(*keep, F.col("_n.position").alias("_p"), F.col("_n.insertion").alias("_i"), F.col("_n.amino_acid").alias("_a"))
    return source.mapInArrow(run, ", ".join([*kept, *(f"`{x}` string" for x in labels)]))


def state_texts_of(domains: DataFrame, *keep: str, numbering: str = "numbering") -> DataFrame:
    """``keep, state_sequence``: the 128 states of imgt-numbered domains; of several residues at a state the first counts.

    A domain without a plain position from 1 to 128 gives no row.
    """
    kept = ", ".join(f"{c} {domains.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            p, i, a = (batch.column(len(keep) + k) for k in range(3))
            size = pc.list_value_length(p).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            pos, aa = p.flatten(), a.flatten()
            plain = pc.equal(pc.utf8_trim(pc.fill_null(i.flatten(), ""), " "), "")
            live = np.flatnonzero(pc.and_(pc.and_(plain, pc.is_valid(aa)), pc.fill_null(pc.and_(pc.greater_equal(pos, 1), pc.less_equal(pos, 128)), False)).to_numpy(zero_copy_only=False))[::-1]
            take = pa.array(live)
            text = grid_texts(batch.num_rows, 128, row[live], pos.take(take).to_numpy(zero_copy_only=False) - 1, aa.take(take))
            some = pa.array(np.unique(row[live]))
            if len(some):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(some) for k in range(len(keep))), text.take(some)], names=[*keep, "state_sequence"])

    n = F.col(numbering)
    cells = domains.filter(F.size(n) > 0).select(*keep, n.alias("_n"))
    return cells.select(*keep, F.col("_n.position").alias("_p"), F.col("_n.insertion").alias("_i"), F.col("_n.amino_acid").alias("_a")).mapInArrow(run, f"{kept}, state_sequence string")


def union_order(union: DataFrame) -> list[str]:
    """Labels of the union's columns in order; the union is bounded by the scheme, not by the data."""
    ordered = union.orderBy("position", "max_rank", "first_seen").select(position_label(F.col("position"), F.col("insertion")).alias("l"))
    return [r[0] for r in ordered.collect()]


def wide_positions(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row a domain, one column a position, ``-`` where it has none."""
    labels = labels or union_order(position_union(rows))
    labelled = rows.withColumn("label", position_label(F.col("position"), F.col("insertion")))
    return labelled.groupBy(*KEYS).pivot("label", labels).agg(F.first("amino_acid")).na.fill("-")


def aligned_texts(rows: DataFrame, filler: str = "-", value: str = "amino_acid", union: DataFrame | None = None) -> DataFrame:
    """``aligned`` text of every domain over a union of positions (its own by default), all of one length."""
    union = position_union(rows) if union is None else union
    order = union.select("position", "insertion", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("position", "max_rank", "first_seen")) - 1).alias("place"))
    width = union.count()
    placed = rows.join(maybe_broadcast(order, width), ["position", "insertion"])
    cells = placed.groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct("place", F.col(value).alias("v")))).alias("cells"))

    def piece(all_cells):
        before = lambda i: F.when(i > 0, F.get(all_cells, i - 1)["place"]).otherwise(-1)
        return lambda x, i: F.when(x["place"] > before(i), F.concat(F.repeat(F.lit(filler), x["place"] - before(i) - 1), F.coalesce(x["v"], F.lit(filler)))).otherwise("")

    text = let(F.col("cells"), lambda c: F.concat(F.array_join(F.transform(c, piece(c)), ""), F.repeat(F.lit(filler), F.lit(width - 1) - F.element_at(c, -1)["place"])))
    return cells.select(*KEYS, text.alias("aligned"))


def filled_gaps(rows: DataFrame) -> DataFrame:
    """Rows with ``-`` added for skipped positions from 1 up to the last one of each domain."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    lagged = rows.withColumn("_before", F.coalesce(F.lag("position").over(w), F.lit(0)))
    missing = (
        lagged.filter("position > _before + 1")
        .withColumn("position", F.explode(F.sequence(F.col("_before") + 1, F.col("position") - 1)))
        .withColumns({"insertion": F.lit(" "), "amino_acid": F.lit("-")})
    )
    return lagged.drop("_before").unionByName(missing.drop("_before"))


def loop_residues(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows inside the loop ranges (``scheme, chain_class, cdr, first, last``) of their scheme and class.

    The ranges are counted: Catalyst has no size for rows that come from Python, and a shuffle join would
    move every cell to the few tasks of the schemes' classes.
    """
    r = ranges.withColumnsRenamed({"scheme": "_s", "chain_class": "_k"})
    cond = (F.col("scheme") == F.col("_s")) & (F.col("chain_class") == F.col("_k")) & F.col("position").between(F.col("first"), F.col("last"))
    return rows.join(maybe_broadcast(r, ranges.count()), cond).drop("_s", "_k")
