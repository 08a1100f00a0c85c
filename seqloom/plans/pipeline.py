"""From records to numbered result documents.

    records -> peptides (six frames for DNA) -> profile hits -> species and overlap choice
            -> best frame -> J rescue -> numbering -> germline genes -> nested documents

Search and numbering are map stages; the shuffles are the choice of hits and frames per
record and the final nesting, all keyed by the record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.labels import allowed_chains, class_of_chain, profile_chain, profile_species
from ..numbering.kernels import reach
from ..numbering.tables import resolve_scheme
from ..numbering.udf import number_domains
from ..operators.germline import assign_germlines, model_lengths
from ..operators.hits import best_apart, best_frame
from ..operators.translate import six_frames_of
from ..runtime import Scratch, maybe_broadcast
from ..search.profile_search import find_hits
from ..sources.profiles import Profile

#: Part number of a protein, which has no frames.
WHOLE = -1
RESCUE_BITS, RESCUE_REST, DEFAULT_THRESHOLD = 10.0, 30, 120.0


def parse_input_type(name: str | None) -> str:
    return "dna" if (name or "").strip().lower() == "dna" else "protein"


def peptides(records: DataFrame) -> DataFrame:
    """``key, part, sequence, stops, nt_offset, is_reverse, label, dna_length``: a protein as it is, DNA in six frames; invalid records give none."""
    clean = records.select("key", S.normalise(F.col("sequence")).alias("s"), F.coalesce(F.lower(F.trim("input_type")) == "dna", F.lit(False)).alias("dna"))
    none = F.lit(None)
    protein = clean.filter(~F.col("dna") & S.valid_protein(F.col("s")) & (F.col("s") != "")).select(
        "key", F.lit(WHOLE).alias("part"), F.col("s").alias("sequence"), F.array().cast("array<int>").alias("stops"), none.cast("int").alias("nt_offset"), none.cast("boolean").alias("is_reverse"), F.lit("").alias("label"), none.cast("int").alias("dna_length")
    )
    frames = clean.filter(F.col("dna") & S.valid_dna(F.col("s"))).select("key", F.length("s").alias("dna_length"), "s")
    frames = six_frames_of(frames, "key", "dna_length")
    frames = frames.select("key", F.col("frame_no").alias("part"), "sequence", F.col("stop_positions").alias("stops"), "nt_offset", "is_reverse", "label", "dna_length")
    return protein.unionByName(frames.filter(S.valid_protein(F.col("sequence"))))


def _kept(hits: DataFrame, species: list[str] | None) -> DataFrame:
    """One row per searched text: its hits that do not overlap, in order of start."""
    names = [s.strip().lower() for s in species or [] if s.strip()]
    h = F.struct(
        (-F.col("bit_score")).alias("rank"), F.col("profile_ordinal").alias("ordinal"), F.col("seq_start").alias("start"), F.col("seq_end").alias("end"), "hmm_name", "bit_score", "evalue", "evalue_text", "hmm_start", "hmm_end", "path"
    )
    per_part = hits.groupBy("key", "part").agg(F.collect_list(h).alias("hits"))
    if names:
        asked = F.filter("hits", lambda x: F.lower(profile_species(x["hmm_name"])).isin(*names))
        per_part = per_part.withColumn("hits", F.when(F.size(asked) > 0, asked).otherwise(F.col("hits")))
    return per_part.select("key", "part", best_apart(F.col("hits")).alias("kept"))


def choose(kept: DataFrame) -> DataFrame:
    """The best part of every record; ``kept`` are its parts' chosen hits."""
    judged = kept.withColumns(
        {
            "n_domains": F.size("kept"),
            "total_score": F.aggregate("kept", F.lit(0.0), lambda a, x: a + x["bit_score"]),
            "first_score": F.element_at("kept", 1)["bit_score"],
            "frame_no": F.col("part"),
        }
    )
    return best_frame(judged, "key").select("key", "part", "kept", "n_domains")


def searched_texts(pep: DataFrame, profiles: list[Profile], threshold: float, species: list[str] | None = None) -> DataFrame:
    """``key, part, kept`` of every peptide with hits; equal texts are searched once.

    A text goes by 96 bits of hash.  The join back has one row a text on its side, so a text that very
    many records share is left to the adaptive skew join.
    """
    ids = pep.select("key", "part", F.xxhash64("sequence").alias("h"), F.hash("sequence").alias("g"), "sequence")
    texts = ids.groupBy("h", "g").agg(F.first("sequence").alias("sequence"))
    kept = _kept(find_hits(texts, profiles, threshold, "h", "g"), species).toDF("h", "g", "kept")
    return ids.drop("sequence").join(kept, ["h", "g"]).select("key", "part", "kept")


J_REGION = "struct<first:int,states:array<int>,kinds:string>"


def _rescued(domains: DataFrame, profiles: list[Profile], lengths: DataFrame) -> DataFrame:
    """``key, part, j_region`` of lone domains cut off after their second cysteine, where a J region lies behind it.

    ``j_region``: its first sequence index, and states and kinds of its residues.
    """
    # the kinds' text holds the states: each match and delete moves on, so state 104 is behind a known number of them
    moved = F.length(F.translate("path", "i", ""))
    last_seat = F.col("hmm_start") + moved - 1 - F.length(F.regexp_extract("path", "(d*)$", 1))
    until = F.concat(F.lit("^((?:i*[md]){"), F.greatest(F.lit(0), 104 - F.col("hmm_start")).cast("string"), F.lit("}i*)m"))
    seats = F.length(F.translate(F.call_function("regexp_extract", F.col("path"), until, F.lit(1)), "d", ""))
    cut = domains.filter((F.col("n_domains") == 1) & (F.col("hmm_start") <= 104) & (F.col("seq_end") - 1 + RESCUE_REST < F.length("sequence")) & (last_seat < 120) & F.rlike("path", until))
    asked = cut.withColumn("cys", F.col("seq_start") + seats).select("key", "part", "cys", F.substr("sequence", F.col("cys") + 2).alias("rest"))
    best = _kept(find_hits(asked, profiles, RESCUE_BITS, text="rest"), None).select("key", "part", F.size("kept").alias("n_domains"), F.element_at("kept", 1).alias("h"))
    rows = best.join(asked.select("key", "part", "cys", F.length("rest").alias("n")), ["key", "part"]).withColumns({"species": profile_species(F.col("h.hmm_name")), "chain_type": profile_chain(F.col("h.hmm_name"))})
    rows = rows.join(maybe_broadcast(lengths), ["species", "chain_type"], "left").select(
        "key", "part", "cys", "n", "n_domains", F.coalesce("model_length", F.lit(128)).alias("model_length"), F.col("h.start").alias("s"), F.col("h.end").alias("e"), F.col("h.hmm_start").alias("a"), F.col("h.hmm_end").alias("z"), F.col("h.path").alias("path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            cys, n, count, model, s, e, a, z = (col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cys", "n", "n_domains", "model_length", "s", "e", "a", "z"))
            front, behind = reach(0 * n, count, s, e, a, z, model, n)
            at, found = [], []
            for r, path in enumerate(col["path"].to_pylist()):
                kinds = "m" * int(front[r]) + path + "m" * int(behind[r])
                code = np.frombuffer(kinds.encode(), np.uint8)
                state = a[r] - front[r] - 1 + np.cumsum(code != ord("i"))
                state[len(kinds) - int(behind[r]) :] = z[r] + 1 + np.arange(int(behind[r]))
                index = s[r] - front[r] - 1 + np.cumsum(code != ord("d")) + cys[r] + 1
                own = np.flatnonzero((state >= 117) & (code != ord("d")))
                if len(own) and state[0] <= 117 and state[-1] >= 126:
                    at.append(r)
                    found.append({"first": int(index[own[0]]), "states": state[own].tolist(), "kinds": code[own].tobytes().decode()})
            take = pa.array(at, pa.int64())
            kind = pa.struct([("first", pa.int32()), ("states", pa.list_(pa.int32())), ("kinds", pa.string())])
            yield pa.RecordBatch.from_arrays([col["key"].take(take), col["part"].take(take), pa.array(found, kind)], names=["key", "part", "j_region"])

    return rows.mapInArrow(run, f"key bigint, part int, j_region {J_REGION}")


def numbered_domains(
    records: DataFrame, profiles: list[Profile], germlines: DataFrame, scheme: str = "imgt", threshold: float = DEFAULT_THRESHOLD, species: list[str] | None = None, restrict: str = "", rescue: bool = True
) -> DataFrame:
    """One row per numbered domain with the document's fields and ``key``.

    ``records``: ``key`` (long, in input order), ``sequence``, ``input_type``.
    """
    name = resolve_scheme(scheme)
    if name is None:
        raise ValueError(f"unknown scheme {scheme!r}")
    chains = allowed_chains(restrict, name)
    # frames, hits and numberings are each read by several later steps: they are written once
    scratch = Scratch(records.sparkSession, "numbering")
    pep = scratch.table(peptides(records), "peptides")
    searched = [p for p in profiles if (p.name.split("_", 1) + ["H"])[1] in chains]
    chosen = choose(scratch.table(searched_texts(pep, searched, threshold, species), "kept"))
    lengths = model_lengths(germlines)
    d = chosen.select("key", "part", "n_domains", F.posexplode("kept").alias("domain_index", "h")).select(
        "key", "part", "n_domains", "domain_index", F.col("h.start").alias("seq_start"), F.col("h.end").alias("seq_end"), "h.hmm_name", "h.bit_score", "h.evalue", "h.evalue_text", "h.hmm_start", "h.hmm_end", "h.path"
    )
    d = d.withColumns({"species": profile_species(F.col("hmm_name")), "chain_type": profile_chain(F.col("hmm_name"))})
    d = d.join(maybe_broadcast(lengths), ["species", "chain_type"], "left").withColumn("model_length", F.coalesce("model_length", F.lit(128)))
    d = scratch.table(d.join(pep, ["key", "part"]), "domains")
    if rescue:
        j = scratch.table(_rescued(d, profiles, lengths), "j_regions")
        d = d.join(maybe_broadcast(j), ["key", "part"], "left")
    ids = ["key", "domain_index"]
    numbered = scratch.table(number_domains(d, name, rescue), "numbered")
    genes = assign_germlines(numbered.join(d.select(*ids, "chain_type"), ids), germlines, ids, species)
    full = numbered.join(d.select(*ids, "hmm_name", "species", "chain_type", "bit_score", "evalue", "evalue_text", "sequence", "stops", "nt_offset", "is_reverse", "label", "dna_length"), ids)
    full = full.join(genes, ids, "left")
    start, end = F.col("seq_start"), F.col("seq_end")
    nt_start, nt_end = S.nt_range(F.col("nt_offset"), F.col("is_reverse"), F.col("dna_length"), start, end)
    framed = F.col("part") != WHOLE
    return full.select(
        "key", "domain_index", "species", "chain_type", class_of_chain(F.col("chain_type")).alias("chain_class"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("identity_species", "v_gene")],
        F.coalesce("v_identity", F.lit(0.0)).alias("v_identity"), F.coalesce("j_gene", F.lit("")).alias("j_gene"), F.coalesce("j_identity", F.lit(0.0)).alias("j_identity"),
        F.lit(name).alias("scheme"), "bit_score", "evalue", "evalue_text", "seq_start", "seq_end", F.col("label").alias("translation_frame"),
        nt_start.cast("int").alias("nt_start"), nt_end.cast("int").alias("nt_end"), S.stops_inside(F.col("stops"), start, end).alias("stop_positions"),
        F.when(framed, S.flank_before(F.col("sequence"), start)).otherwise("").alias("flank_before"),
        F.when(framed, S.flank_after(F.col("sequence"), end, F.col("stops"))).otherwise("").alias("flank_after"),
        "numbering",
    )


def with_totals(documents: DataFrame) -> tuple[DataFrame, Observation]:
    """The documents, and what a run over them counts in passing: ``sequences``, ``domains`` and ``without_domain``.

    ``observation.get`` has the totals once an action has read all documents; no pass of its own is made.
    """
    seen = Observation()
    n = F.greatest(F.size("domains"), F.lit(0))
    return documents.observe(seen, F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(n), F.lit(0)).alias("domains"), F.count_if(n == 0).alias("without_domain")), seen


def number_sequences(records: DataFrame, profiles: list[Profile], germlines: DataFrame, **options) -> DataFrame:
    """Result documents ``key, id, sequence, input_type, domains`` for every record, none dropped.

    Options are those of :func:`numbered_domains`.  Records without a domain have an empty array.
    """
    d = numbered_domains(records, profiles, germlines, **options)
    fields = [c for c in d.columns if c != "key"]
    nested = d.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["domain_index"] - b["domain_index"]).alias("domains"))
    empty = F.from_json(F.lit("[]"), nested.schema["domains"].dataType)
    return records.join(nested, "key", "left").withColumn("domains", F.coalesce("domains", empty)).select("key", "id", S.normalise(F.col("sequence")).alias("sequence"), F.when(F.lower(F.trim("input_type")) == "dna", "dna").otherwise("protein").alias("input_type"), "domains")
