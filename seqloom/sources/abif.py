"""Chromatogram files (ABIF): bases, peak places, channels and qualities."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, bases string, peak_locations array<int>, channels map<string, array<int>>, quality array<int>, base_order string, trace_length int, source_file string"
)
_DIRECTORY = struct.Struct(">4siHHii4sI")


class Abif:
    """The tagged directory of one file."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"ABIF":
            raise ValueError("not ABIF")
        self.raw, self.tags = raw, {}
        *_, count, _, where, _ = _DIRECTORY.unpack_from(raw, 6)
        start = struct.unpack(">I", where)[0]
        for k in range(count):
            name, number, _, width, n, size, where, _ = _DIRECTORY.unpack_from(raw, start + _DIRECTORY.size * k)
            at = start + _DIRECTORY.size * k + 20 if size <= 4 else struct.unpack(">I", where)[0]
            self.tags[name.decode("latin-1"), number] = (at, n, size)

    def first(self, name: str, *numbers: int) -> tuple[int, int, int] | None:
        return next((self.tags[name, k] for k in numbers if (name, k) in self.tags), None)

    def text(self, name: str, *numbers: int) -> str | None:
        t = self.first(name, *numbers)
        return None if t is None else self.raw[t[0] : t[0] + t[2]].decode("latin-1").rstrip("\0")

    def shorts(self, name: str, *numbers: int) -> list[int] | None:
        t = self.first(name, *numbers)
        return None if t is None else list(struct.unpack_from(f">{t[1]}h", self.raw, t[0]))

    def octets(self, name: str, *numbers: int) -> list[int] | None:
        t = self.first(name, *numbers)
        return None if t is None else list(self.raw[t[0] : t[0] + t[1]])


def encode_abif(bases: str, quality: list[int], channels: list[list[int]], peaks: list[int], order: str = "GATC") -> bytes:
    """A trace as ABIF bytes, with the tags that :func:`parse_abif` reads."""
    shorts = lambda v: struct.pack(f">{len(v)}h", *v)
    blocks = [(b"PBAS", 2, 2, 1, bases.encode("latin-1")), (b"PLOC", 2, 4, 2, shorts(peaks)), (b"FWO_", 1, 2, 1, order.encode()), (b"PCON", 2, 2, 1, bytes(quality))]
    blocks += [(b"DATA", 9 + k, 4, 2, shorts(v)) for k, v in enumerate(channels)]
    body, entries, at = [], [], 128
    for name, number, kind, width, raw in blocks:
        inside = len(raw) <= 4
        where = raw.ljust(4, b"\0") if inside else struct.pack(">I", at)
        entries.append(_DIRECTORY.pack(name, number, kind, width, len(raw) // width, len(raw), where, 0))
        if not inside:
            body.append(raw)
            at += len(raw)
    head = b"ABIF" + struct.pack(">h", 101) + _DIRECTORY.pack(b"tdir", 1, 1023, 28, len(blocks), 28 * len(blocks), struct.pack(">I", at), 0)
    return head.ljust(128, b"\0") + b"".join(body) + b"".join(entries)


def parse_abif(raw: bytes) -> dict | None:
    """The trace of a file, or None if it is no ABIF file or lacks bases or a channel."""
    try:
        f = Abif(bytes(raw))
        bases = f.text("PBAS", 2, 1)
        order = (f.text("FWO_", 1) or "GATC").upper()
        channels = {base: f.shorts("DATA", 9 + k) for k, base in enumerate(order[:4])}
    except (ValueError, struct.error, UnicodeDecodeError):
        return None
    if not bases or len(channels) < 4 or any(v is None for v in channels.values()):
        return None
    return {
        "bases": bases.upper(),
        "peak_locations": f.shorts("PLOC", 2, 1) or [],
        "channels": channels,
        "quality": f.octets("PCON", 2, 1) or [],
        "base_order": order,
        "trace_length": len(channels[order[0]]),
    }


def traces_of(files: DataFrame) -> DataFrame:
    """The readable traces among ``id, source_file, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, file, raw in zip(pdf["id"], pdf["source_file"], pdf["content"]):
                trace = parse_abif(raw)
                if trace:
                    rows.append({"id": name, **trace, "source_file": file})
            yield pd.DataFrame(rows, columns=["id", "bases", "peak_locations", "channels", "quality", "base_order", "trace_length", "source_file"])

    return files.select("id", "source_file", "content").mapInPandas(run, SCHEMA)


def read_abif(spark: SparkSession, path: str) -> DataFrame:
    """One row a readable ``.ab1`` file; the id is its name without the suffix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[aA][bB]1").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.ab1$", "")
    return traces_of(files.select(name.alias("id"), F.col("path").alias("source_file"), "content"))


def as_records(traces: DataFrame) -> DataFrame:
    """Traces as DNA records."""
    return traces.select("id", F.translate("bases", "-.", "").alias("sequence"), F.lit("dna").alias("input_type"))


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Every FASTA and trace file of a folder as records ``id, sequence, input_type``."""
    from .fasta import read_fasta

    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath()) for s in fs.listStatus(p) if s.isFile()]
    texts = [n for n in names if not n.lower().endswith(".ab1")]
    parts = []
    if texts:
        parts.append(read_fasta(spark, *texts).select("id", "sequence", F.lit(None).cast("string").alias("input_type")))
    if len(texts) < len(names):
        parts.append(as_records(read_abif(spark, path)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    # one trace makes the whole input DNA
    return out.withColumn("input_type", F.lit("dna")) if len(texts) < len(names) else out
