"""Nested result documents as flat tables that keep their parent.

Linked rows: ``parent_no``, ``domain_pos`` (place in the domains array), ``item``
(``domain``, ``stop`` or ``residue``) and ``item_pos`` (place in that array).  Value tables: the fields of
documents, domains, numbered residues and stops, with the parent's key and places.  Both come from the
spans that :class:`JsonIndex` finds in JSON text.  A typed nested column takes the same way for
linked rows: the two arrays that they need are written as text, null elements in their places.
Every document is handled on its own inside a map stage, so nothing is shuffled and no group is ever gathered.

Defined results: null or empty arrays give no rows; a null domain element gives no row
but keeps its place; a stop counts even if it is null; a residue counts if its insertion
is present and not blank; a lone object or number is an array of one; a payload that is
null, empty or not valid JSON gives no row; a null parent key is carried as null; a missing value, or one
that its type cannot read, is null; numbers given as text are numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .json_index import OPEN_OBJ, STRING, JsonIndex
from .spans import chunks, text_buffers

LINKS = "parent_no bigint, domain_pos int, item string, item_pos int"
_SCHEMA = pa.schema([("parent_no", pa.int64()), ("domain_pos", pa.int32()), ("item", pa.string()), ("item_pos", pa.int32())])
#: Bytes of JSON text that are indexed at a time in a Python worker.
CHUNK_BYTES = 4 << 20


def _rows(parent: pa.Array, take: np.ndarray, domain_pos, item: str, item_pos) -> pa.RecordBatch:
    n = len(take)
    words = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([item])).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [parent.take(pa.array(take)), pa.array(np.asarray(domain_pos, np.int32)), words, pa.array(np.asarray(item_pos, np.int32))], schema=_SCHEMA
    )


def _present(index: JsonIndex, tokens: np.ndarray) -> np.ndarray:
    """Values that are neither null nor blank text."""
    out = ~index.is_null(tokens)
    text = np.flatnonzero(index.kind[tokens] == STRING)
    start, length = index.pos[tokens[text]] + 1, index.end[tokens[text]] - index.pos[tokens[text]] - 2
    out[text[length == 0]] = False
    one = length == 1
    out[text[one]] = index.buf[start[one]] != 32
    for i in np.flatnonzero(length > 1):
        out[text[i]] = bool(index.text(tokens[text[i]]).strip())
    return out


def _json_links(parent: pa.Array, payload: pa.Array) -> Iterator[pa.RecordBatch]:
    buf, offsets = text_buffers(payload)
    index = JsonIndex(buf, offsets)
    roots = index.roots()
    roots = roots[index.kind[roots] == OPEN_OBJ]
    row, value = index.members(roots, "domains")
    r, element, domain_pos = index.elements(value)
    doc = index.doc[roots[row[r]]]
    live = ~index.is_null(element)
    doc, element, domain_pos = doc[live], element[live], domain_pos[live]
    yield _rows(parent, doc, domain_pos, "domain", np.zeros(len(doc)))
    objects = np.flatnonzero(index.kind[element] == OPEN_OBJ)
    row, value = index.members(element[objects], "stop_positions")
    r, _, place = index.elements(value)
    owner = objects[row[r]]
    yield _rows(parent, doc[owner], domain_pos[owner], "stop", place)
    row, value = index.members(element[objects], "numbering")
    r, residue, place = index.elements(value)
    owner = objects[row[r]]
    keep = np.flatnonzero(index.kind[residue] == OPEN_OBJ)
    row, value = index.members(residue[keep], "insertion")
    keep = keep[row[_present(index, value)]]
    yield _rows(parent, doc[owner[keep]], domain_pos[owner[keep]], "residue", place[keep])
    for d in np.flatnonzero(index.deep):
        yield from _deep_links(parent, int(d), buf[offsets[d] : offsets[d + 1]].tobytes())


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_NAMES = {"true": True, "false": False, "null": None}


def parsed(text: str):
    """JSON of any depth without recursion; numbers are given as text, text that is not JSON raises ValueError."""
    skip = lambda k: _SPACE.match(text, k).end()

    def name(k: int) -> tuple[str, int]:
        if text[k : k + 1] != '"':
            raise ValueError(k)
        key, k = scanstring(text, k + 1, True)
        k = skip(k)
        if text[k : k + 1] != ":":
            raise ValueError(k)
        return key, skip(k + 1)

    root: list = []
    open_, keys = [root], [None]
    k = skip(0)
    while True:
        c, opened = text[k : k + 1], False
        if c in ("{", "["):
            value = {} if c == "{" else []
            k = skip(k + 1)
            opened = text[k : k + 1] != ("}" if c == "{" else "]")
            k += not opened
        elif c == '"':
            value, k = scanstring(text, k + 1, True)
        elif m := _NUMBER.match(text, k):
            value, k = m.group(), m.end()
        else:
            word = next((w for w in _NAMES if text.startswith(w, k)), None)
            if word is None:
                raise ValueError(k)
            value, k = _NAMES[word], k + len(word)
        if isinstance(open_[-1], dict):
            open_[-1][keys[-1]] = value
        else:
            open_[-1].append(value)
        if opened:
            open_.append(value)
            keys.append(None)
            if c == "{":
                keys[-1], k = name(k)
            continue
        while True:
            k = skip(k)
            if len(open_) == 1:
                if k != len(text):
                    raise ValueError(k)
                return root[0]
            own = isinstance(open_[-1], dict)
            c = text[k : k + 1]
            if c == ",":
                k = skip(k + 1)
                if own:
                    keys[-1], k = name(k)
                break
            if c != ("}" if own else "]"):
                raise ValueError(k)
            open_.pop()
            keys.pop()
            k += 1


def _deep(raw: bytes) -> dict | None:
    """A document nested beyond the index's levels, by the standard parser, or :func:`parsed` beyond its depth; numbers as text."""
    try:
        try:
            tree = json.loads(raw, parse_float=str, parse_int=str, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
        except RecursionError:
            tree = parsed(raw.decode(json.detect_encoding(raw), "surrogatepass"))
    except ValueError:
        return None
    return tree if isinstance(tree, dict) else None


def _many(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _deep_domains(tree: dict | None) -> list[tuple[int, object]]:
    return [(p, d) for p, d in enumerate(_many(tree.get("domains") if tree else None)) if d is not None]


def _deep_links(parent: pa.Array, doc: int, raw: bytes) -> Iterator[pa.RecordBatch]:
    filled = lambda x: isinstance(x, (dict, list)) or x is not None and bool(str(x).strip())
    found = []
    for p, d in _deep_domains(_deep(raw)):
        found.append((p, "domain", 0))
        if isinstance(d, dict):
            found += [(p, "stop", k) for k, _ in enumerate(_many(d.get("stop_positions")))]
            for k, x in enumerate(_many(d.get("numbering"))):
                if isinstance(x, dict) and filled(x.get("insertion")):
                    found.append((p, "residue", k))
    for p, item, k in found:
        yield _rows(parent, np.array([doc]), [p], item, [k])


def link_json(df: DataFrame, key: str = "doc_no", text: str = "payload") -> DataFrame:
    """Linked rows of JSON documents in ``df[text]``."""

    def run(batches):
        for batch in batches:
            parent, payload = batch.column(0), batch.column(1)
            for at, to in chunks(payload, CHUNK_BYTES):
                for out in _json_links(parent.slice(at, to - at), payload.slice(at, to - at)):
                    if out.num_rows:
                        yield out

    return df.select(F.col(key).cast("bigint").alias("parent_no"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, LINKS)


def link_typed(df: DataFrame, key: str = "result_no", domains: str = "domains") -> DataFrame:
    """Linked rows of the typed nested column ``df[domains]``."""
    residue = lambda r: F.struct(r["insertion"].alias("insertion"))
    kept = lambda d: F.when(d.isNotNull(), F.struct(d["stop_positions"].alias("stop_positions"), F.transform(d["numbering"], residue).alias("numbering")))
    text = F.to_json(F.struct(F.transform(domains, kept).alias("domains")))
    return link_json(df.select(F.col(key).alias("_key"), text.alias("_text")), "_key", "_text")


# -- values -------------------------------------------------------------------------------------

DOMAIN_FIELDS = {
    "domain_index": "int", "species": "string", "chain_type": "string", "chain_class": "string", "identity_species": "string", "v_gene": "string", "v_identity": "double", "j_gene": "string", "j_identity": "double",
    "scheme": "string", "bit_score": "double", "evalue": "double", "evalue_text": "string", "seq_start": "int", "seq_end": "int", "translation_frame": "string", "nt_start": "int", "nt_end": "int", "flank_before": "string", "flank_after": "string",
}
#: The value tables: their places and their fields.
TABLES = {
    "documents": ((), {"id": "string", "sequence": "string", "input_type": "string"}),
    "domains": (("domain_pos",), DOMAIN_FIELDS),
    "numbering": (("domain_pos", "item_pos"), {"position": "int", "insertion": "string", "amino_acid": "string"}),
    "stop_positions": (("domain_pos", "item_pos"), {"stop_position": "int"}),
}


def _found(index: JsonIndex, name: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, bool]:
    """(document, places, token, whether fields are the token's members) of a table's rows."""
    roots = index.roots()
    roots = roots[index.kind[roots] == OPEN_OBJ]
    if name == "documents":
        return index.doc[roots], [], roots, True
    row, value = index.members(roots, "domains")
    r, element, place = index.elements(value)
    live = np.flatnonzero(~index.is_null(element))
    element, place, doc = element[live], place[live], index.doc[roots[row[r[live]]]]
    if name == "domains":
        return doc, [place], element, True
    objects = np.flatnonzero(index.kind[element] == OPEN_OBJ)
    row, value = index.members(element[objects], name)
    r, item, item_pos = index.elements(value)
    owner = objects[row[r]]
    return doc[owner], [place[owner], item_pos], item, name == "numbering"


def _json_values(parent: pa.Array, payload: pa.Array, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    buf, offsets = text_buffers(payload)
    index = JsonIndex(buf, offsets)
    doc, places, token, by_member = _found(index, name)
    columns = []
    objects = np.flatnonzero(index.kind[token] == OPEN_OBJ) if by_member and len(token) else np.zeros(0, np.int64)
    for field in TABLES[name][1]:
        at = token
        if by_member:
            at = np.full(len(token), -1)
            row, value = index.members(token[objects], field)
            at[objects[row]] = value
        columns.append(index.values(at))
    yield pa.RecordBatch.from_arrays([parent.take(pa.array(doc)), *(pa.array(p.astype(np.int32)) for p in places), *columns], schema=schema)
    for d in np.flatnonzero(index.deep):
        rows = list(_deep_values(_deep(buf[offsets[d] : offsets[d + 1]].tobytes()), name))
        if rows:
            texts = [pa.array([None if x is None else x if isinstance(x, str) else json.dumps(x) for x in c], pa.string()) for c in zip(*(r[1] for r in rows))]
            yield pa.RecordBatch.from_arrays([parent.take(pa.array(np.full(len(rows), d))), *(pa.array(c, pa.int32()) for c in zip(*(r[0] for r in rows))), *texts], schema=schema)


def _deep_values(tree: dict | None, name: str) -> Iterator[tuple[tuple, list]]:
    """(places, values) of a table's rows in a parsed document."""
    of = lambda x: [x.get(f) if isinstance(x, dict) else None for f in TABLES[name][1]]
    if name == "documents":
        if tree is not None:
            yield (), of(tree)
        return
    for p, d in _deep_domains(tree):
        if name == "domains":
            yield (p,), of(d)
        elif isinstance(d, dict):
            for k, x in enumerate(_many(d.get(name))):
                yield (p, k), of(x) if name == "numbering" else [x]


def json_tables(df: DataFrame, key: str = "doc_no", text: str = "payload") -> dict[str, DataFrame]:
    """JSON documents in ``df[text]`` as four related tables: ``documents``, ``domains``, ``numbering`` and ``stop_positions``.

    Each row carries the parent's key (``parent_no``) and its 0-based places, so that joins on (parent_no, domain_pos)
    rebuild the document.
    """
    source = df.select(F.col(key).cast("bigint").alias("parent_no"), F.col(text).alias("text")).filter("text is not null")

    def reader(name: str, columns: list[str], places: tuple[str, ...]):
        schema = pa.schema([("parent_no", pa.int64()), *((p, pa.int32()) for p in places), *((c, pa.string()) for c in columns)])

        def run(batches):
            for batch in batches:
                parent, payload = batch.column(0), batch.column(1)
                for at, to in chunks(payload, CHUNK_BYTES):
                    for out in _json_values(parent.slice(at, to - at), payload.slice(at, to - at), name, schema):
                        if out.num_rows:
                            yield out

        return run

    out = {}
    for name, (places, fields) in TABLES.items():
        kinds = ", ".join(["parent_no bigint", *(f"{p} int" for p in places), *(f"{c} string" for c in fields)])
        rows = source.mapInArrow(reader(name, list(fields), places), kinds)
        out[name] = rows.select("parent_no", *places, *[F.col(c) if t == "string" else F.col(c).try_cast(t).alias(c) for c, t in fields.items()])
    return out


def child_tables(df: DataFrame, key: str = "result_no", domains: str = "domains") -> dict[str, DataFrame]:
    """The typed document column as three related tables: ``domains``, ``numbering`` and ``stop_positions``.

    Each child row carries the parent's key and its 0-based places, so that joins on
    (key, domain_pos) rebuild the document.
    """
    d = df.select(key, F.posexplode(domains).alias("domain_pos", "d")).filter("d is not null")
    fields = [f.name for f in df.schema[domains].dataType.elementType.fields if f.name not in ("numbering", "stop_positions")]
    taken = {key.lower(), "domain_pos"}
    head = d.select(key, "domain_pos", *[F.col(f"d.{f}").alias(f if f.lower() not in taken else f"domain_{f}") for f in fields])
    numbering = d.select(key, "domain_pos", F.posexplode("d.numbering").alias("item_pos", "r")).select(key, "domain_pos", "item_pos", "r.*")
    stops = d.select(key, "domain_pos", F.posexplode("d.stop_positions").alias("item_pos", "stop_position"))
    return {"domains": head, "numbering": numbering, "stop_positions": stops}
