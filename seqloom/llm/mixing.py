"""A mix of sources at target shares of the corpus, sized in tokens.

Each source's budget is its share of all tokens.  Documents are counted by exact token
length; whole repeats of the source fill what they can, and the remaining budget is met by
a subset of documents: in proportion to the length counts at first, then corrected by a
bounded-knapsack program over additions and removals, which hits the budget exactly wherever
the lengths allow it (else the nearest total below; see :data:`PROGRAM_SUMS`).  Which documents
of a length are taken is decided by a seeded hash.

The program sees counts by length only, never documents, one source to a task.  A hot
(source, length) group is chosen by hash bucket; only the bucket at the boundary is ranked.

Defined results: null text or no tokens: never taken; a null source counts to the total
only; a target without documents or with share 0 takes nothing; a target beyond
``max_repeats`` whole repeats takes them all and is reported as not met; targets that name
the same source in two spellings are added up; rows with a null document key are ranked
among themselves by text hash.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, maybe_broadcast

#: Sums that the program looks at around its first choice, at most: 4 bytes each.  They prove the choice best for lengths
#: up to 2,895 tokens; beyond, a budget that is met is exact and another is the nearest of these sums.
PROGRAM_SUMS = 1 << 25
BUCKETS = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of each whole text (null for null)."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)


def source_key(c: Column) -> Column:
    """One spelling of a source: case, outer blanks and ``-`` for ``_`` do not matter."""
    return F.nullif(F.lower(F.translate(F.btrim(c, F.lit(" \t\r\n")), "-", "_")), F.lit(""))


def fill_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, program_sums: int = PROGRAM_SUMS) -> np.ndarray:
    """How many documents of each length to take (at most ``counts``) for the total nearest to ``budget`` from below.

    A first choice takes all lengths in proportion (in the order of length, so that rounding adds up to
    less than a document) and is corrected by long documents until less than the longest length D is left.  The program then adds and gives back documents: a best choice differs from
    any such first choice by sums that stay within 2 D^2 + 2 D either way (of more single steps, in an
    order that keeps their running sum within D of zero, two would reach the same sum, and what lies
    between them could be left out).  It stops as soon as the budget is met.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    order = np.argsort(lengths, kind="stable")
    upto = [0, *accumulate(int(c) for c in counts[order])]
    take = np.zeros_like(counts)
    take[order] = np.diff(np.array([c * budget // total for c in upto]))
    rest = budget - int((take * lengths).sum())
    for k in order[::-1]:
        more = min(int(counts[k] - take[k]), rest // int(lengths[k])) if rest >= 0 else -min(int(take[k]), -(rest // int(lengths[k])))
        take[k] += more
        rest -= more * int(lengths[k])
    if not rest:
        return take
    longest = int(lengths.max())
    reach = min(2 * longest * (longest + 1), program_sums // 2)
    low, high = min(reach, budget - rest), min(reach, total - budget + rest)
    # bounded knapsack over sums -low..high: first[s] is the stage at which the sum s was first reached
    first = np.full(low + high + 1, -1, np.int32)
    first[low] = 0
    stages = [(0, 0)]
    for k in np.argsort(lengths, kind="stable"):
        for sign, spare in ((1, int(counts[k] - take[k])), (-1, int(take[k]))):
            unit = 1
            while spare and first[low + rest] < 0:
                n = min(unit, spare)
                size = n * int(lengths[k])
                if size >= len(first):
                    break
                stages.append((int(k), sign * n))
                before, after = (first[:-size], first[size:]) if sign > 0 else (first[size:], first[:-size])
                new = (before >= 0) & (after < 0)
                after[new] = len(stages) - 1
                spare, unit = spare - n, unit * 2
    s = int(np.flatnonzero(first[: low + rest + 1] >= 0)[-1])
    while first[s]:
        k, n = stages[first[s]]
        take[k] += n
        s -= n * int(lengths[k])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of every document (``base``) and documents with one copy more (``extra``), by length."""
    lengths, counts = pdf["tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    budget, repeats, total = int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0]), int((lengths * counts).sum())
    base = min(repeats, budget // total) if total else 0
    extra = fill_budget(lengths, counts, budget - base * total) if base < repeats else np.zeros(len(counts), np.int64)
    return pd.DataFrame({"source": pdf["source"], "tokens": lengths, "n": counts, "base": base, "extra": extra})


class Mix:
    """The chosen documents (``documents``: doc_id, source, tokens, copies) and ``shares`` by target."""

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 1, key: str = "doc_id"):
        self._scratch = scratch = Scratch(docs.sparkSession, "mix")
        tokenizer = tokenizer or default_tokenizer()
        sized = docs.select(
            F.col(key).alias("doc_id"), source_key(F.col("source")).alias("source"), count_tokens(F.col("text"), tokenizer).alias("tokens"), F.xxhash64(F.lit(seed), key, "text").alias("h")
        )
        sized = scratch.table(sized.filter("tokens > 0"), "sizes")
        self.total = int(sized.agg(F.sum("tokens")).first()[0] or 0)
        self.targets = (
            targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
            .filter("source is not null")
            .groupBy("source")
            .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
            .withColumn("budget", F.floor(F.col("target_share") * F.lit(self.total) + 1e-6).cast("bigint"))
        )
        wanted = sized.join(maybe_broadcast(self.targets.select("source")), "source", "left_semi")
        counts = wanted.groupBy("source", "tokens").agg(F.count("*").alias("n")).join(maybe_broadcast(self.targets), "source")
        plan = counts.groupBy("source").applyInPandas(_plan, "source string, tokens bigint, n bigint, base bigint, extra bigint")
        plan = scratch.table(plan, "plan")
        rows = wanted.join(maybe_broadcast(plan), ["source", "tokens"])

        bucket = F.pmod("h", F.lit(BUCKETS))
        partial = rows.filter("extra > 0 and extra < n").withColumn("bucket", bucket)
        upto = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = partial.groupBy("source", "tokens", "extra", "bucket").agg(F.count("*").alias("c")).withColumn("cum", F.sum("c").over(upto))
        need = cum.select("source", "tokens", "bucket", F.least("c", F.greatest(F.col("extra") - F.col("cum") + F.col("c"), F.lit(0))).alias("need"), "c").filter("need > 0")
        need = scratch.table(need, "need")
        inside = partial.join(maybe_broadcast(need), ["source", "tokens", "bucket"])
        rank = Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id")
        edge = inside.filter("need < c").withColumn("rn", F.row_number().over(rank)).filter("rn <= need").select("doc_id", "source", "tokens", "base")
        chosen = inside.filter("need = c").select("doc_id", "source", "tokens", "base").unionByName(edge).withColumn("copies", F.col("base") + 1).drop("base")
        # documents at the base count alone: those of lengths where none or all get one more, and the ones not chosen
        even = rows.filter("extra = 0 or extra = n").select("doc_id", "source", "tokens", (F.col("base") + (F.col("extra") == F.col("n")).cast("bigint")).alias("copies"))
        others = partial.filter("base > 0").join(need.withColumnRenamed("need", "k"), ["source", "tokens", "bucket"], "left")
        whole_out = others.filter("k is null").select("doc_id", "source", "tokens", F.col("base").alias("copies"))
        rest = inside.filter("need < c and base > 0").withColumn("rn", F.row_number().over(rank)).filter("rn > need").select("doc_id", "source", "tokens", F.col("base").alias("copies"))
        self.documents = even.filter("copies > 0").unionByName(chosen).unionByName(whole_out).unionByName(rest)
        self._plan = plan

    def close(self) -> None:
        """Remove the written tables; neither documents nor shares can be read afterwards."""
        self._scratch.close()

    def shares(self) -> DataFrame:
        """``source, target_share, actual_share, used_tokens, documents, met`` for every target."""
        used = self._plan.groupBy("source").agg(F.sum(F.expr("tokens * (n * base + extra)")).alias("used"), F.sum("n").alias("documents"))
        total = F.lit(float(max(1, self.total)))
        return (
            self.targets.join(used, "source", "left")
            .withColumn("used_tokens", F.coalesce("used", F.lit(0)))
            .select(
                "source", "target_share", (F.col("used_tokens") / total).alias("actual_share"), "used_tokens", F.coalesce("documents", F.lit(0)).alias("documents"), (F.col("used_tokens") == F.col("budget")).alias("met")
            )
        )
