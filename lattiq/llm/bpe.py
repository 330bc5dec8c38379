"""Byte-level BPE encoding and decoding of documents.

Short texts are encoded where they are read. A text of more than ``chunk_chars`` code points is cut into overlapping
chunks. The chunks are pre-tokenised in parallel; the chunk after a cut may start inside a pre-token, so its boundaries
can be wrong at first, but as the pattern only looks ahead, both sides agree from the first boundary on that they share.
Cutting there gives pieces that are encoded in parallel and whose ids, put together, are those of the whole text. Where no
boundary is shared inside the overlap (a very long run of white space, say) no cut is made: the two chunks stay one piece.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import partitions, ready, record, texts

#: The last code points of a chunk do not vote: a contraction or a run might go on behind its end.
GUARD = 8


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a vocabulary file (ranks in tiktoken's text form, or a byte-level tokenizer's JSON) and its tokens."""
    with open(path, "rb") as f:
        if path.endswith(".json"):
            ranks = json_ranks(json.load(f))
        else:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tiktoken.Encoding("lattiq", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokens


def json_ranks(tokenizer: dict) -> dict[bytes, int]:
    """Ranks of a byte-level BPE tokenizer whose ids are in the order of its merges. Its vocabulary spells bytes as
    printable characters: those that are printable stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in tokenizer.get("added_tokens", [])}
    return {bytes(spelt[c] for c in token): rank for token, rank in tokenizer["model"]["vocab"].items() if token not in special}


def encode_text(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of one text; strings that look like special tokens are ordinary text, lone surrogates become U+FFFD."""
    try:
        ids = encoding.encode_ordinary(text)
    except UnicodeEncodeError:
        ids = encoding.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    return np.array(ids, dtype="<u4")


def boundaries(pattern: regex.Pattern, text: str, offset: int, low: int, high: int) -> list[int]:
    """Ends of pre-tokens of ``text`` (which starts at ``offset``) in [low, high) whose last character is not white space.

    A piece that ends behind white space could be split otherwise than in its context, so such places are left out."""
    return [end for m in pattern.finditer(text) if low <= (end := offset + m.end()) < high and not text[m.end() - 1].isspace()]


def cut(rows: Iterator[pa.RecordBatch], chunk: int, overlap: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for key, name, text, copies in zip(*(batch.column(n).to_pylist() for n in ("key", "name", "text", "copies"))):
            starts = range(0, len(text), chunk)
            for lo in range(0, len(starts), 64):
                some = starts[lo : lo + 64]
                yield record(schema, [key] * len(some), [name] * len(some), [len(text)] * len(some), [copies] * len(some), list(some), [text[s : s + chunk + overlap] for s in some])


def pretokenise(rows: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    compiled = regex.compile(pattern)
    for batch in rows:
        heads, tails = [], []
        for start, total, body in zip(batch.column("start").to_pylist(), batch.column("n_chars").to_pylist(), batch.column("body").to_pylist()):
            found = boundaries(compiled, body, start, start, start + len(body) - GUARD)
            heads.append([b for b in found if b < start + overlap] if start else [])
            tails.append([b for b in found if b >= start + chunk] if start + chunk < total else [])
        yield record(schema, *(batch.column(n) for n in ("key", "name", "n_chars", "copies", "start", "body")), heads, tails)


def stitched(chunks: list[tuple[int, str, list[int], list[int]]], pattern: regex.Pattern, chunk: int) -> list[str]:
    """Pieces of one text from its chunks (start, body, boundaries in the first and in the last overlap), by start."""
    text = "".join(body[:chunk] for _, body, _, _ in chunks)
    cuts, sure = [0], chunks[0][3]
    for start, body, head, tail in chunks[1:]:
        shared = set(sure).intersection(head)
        if shared:
            cuts.append(min(shared))
            sure = tail
        else:  # no common boundary: the piece goes on, its true boundaries near the next cut are found from its start
            end = start + len(body)
            sure = boundaries(pattern, text[cuts[-1] : end], cuts[-1], start + chunk, end - GUARD)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def stitch(group: pa.Table, pattern: str, chunk: int, schema: pa.Schema) -> pa.Table:
    group = group.sort_by("start")
    columns = [group.column(n).to_pylist() for n in ("start", "body", "head", "tail")]
    pieces = stitched(list(zip(*columns)), regex.compile(pattern), chunk)
    n = len(pieces)
    return pa.Table.from_batches([record(schema, [group.column("key")[0].as_py()] * n, [group.column("name")[0].as_py()] * n, [group.column("copies")[0].as_py()] * n, list(range(n)), pieces)])


def encode_rows(rows: Iterator[pa.RecordBatch], path: str, pattern: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoding, _ = codec(path, pattern)
    for batch in rows:
        keep = [batch.column(n) for n in schema.names[:-1]]
        yield record(schema, *keep, [encode_text(encoding, t).tobytes() for t in texts(batch, "text")])


def decode_rows(rows: Iterator[pa.RecordBatch], path: str, pattern: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    _, tokens = codec(path, pattern)
    for batch in rows:
        keep = [batch.column(n) for n in schema.names[:-1]]
        yield record(schema, *keep, [b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column("ids").to_pylist()])


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", chunk_chars: int = 32768, overlap: int = 512) -> DataFrame:
    """(id, ids): the ids of each row's text as little-endian unsigned 32-bit integers.

    One row comes out for each row that goes in; nulls and empty texts give no ids, repeated rows repeat, a null id stays
    null. Other columns are not looked at. Rows that are long and equal are encoded once and repeated.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType

    def stitch_group(group: pa.Table) -> pa.Table:
        return stitch(group, pattern, chunk_chars, piece_schema)

    rows = docs.select(F.col(id_column).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    key, out = f"key {kind.simpleString()}", pa.schema([("key", _arrow(kind)), ("ids", pa.binary())])
    near = rows.where(F.length("text") <= chunk_chars).mapInArrow(partial(encode_rows, path=path, pattern=pattern, schema=out), f"{key}, ids binary")

    # The text's hash keeps apart texts that share an id.
    name, key = [("key", _arrow(kind)), ("name", pa.int64())], f"{key}, name long"
    chunk_schema = pa.schema([*name, ("n_chars", pa.int64()), ("copies", pa.int64()), ("start", pa.int64()), ("body", pa.string())])
    bound_schema = chunk_schema.append(pa.field("head", pa.list_(pa.int64()))).append(pa.field("tail", pa.list_(pa.int64())))
    piece_schema = pa.schema([*name, ("copies", pa.int64()), ("piece", pa.int64()), ("text", pa.string())])
    ids_schema = pa.schema([*name, ("copies", pa.int64()), ("piece", pa.int64()), ("ids", pa.binary())])
    n = partitions(docs.sparkSession)
    far = rows.where(F.length("text") > chunk_chars).groupBy("key", "text").agg(F.count("*").alias("copies")).withColumn("name", F.xxhash64("text"))
    far = far.mapInArrow(partial(cut, chunk=chunk_chars, overlap=overlap, schema=chunk_schema), f"{key}, n_chars long, copies long, start long, body string")
    far = far.repartition(n, "key", "name", "start")
    far = far.mapInArrow(partial(pretokenise, pattern=pattern, chunk=chunk_chars, overlap=overlap, schema=bound_schema), f"{key}, n_chars long, copies long, start long, body string, head array<long>, tail array<long>")
    far = far.groupBy("key", "name", "n_chars").applyInArrow(stitch_group, f"{key}, copies long, piece long, text string")
    far = far.repartition(n, "key", "name", "piece").mapInArrow(partial(encode_rows, path=path, pattern=pattern, schema=ids_schema), f"{key}, copies long, piece long, ids binary")
    far = far.groupBy("key", "name", "copies").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY piece)").alias("ids"))
    far = far.select("key", "ids", F.explode(F.sequence(F.lit(1), "copies"))).select("key", "ids")
    return near.unionByName(far).withColumnRenamed("key", id_column)


def decode(coded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, bytes): the bytes that the ids stand for; not always valid UTF-8 if ids were cut.

    Null ids of tokens give no bytes, a null id of a row stays null, repeated rows repeat."""
    ready(coded.sparkSession)
    kind = coded.schema[id_column].dataType
    out = pa.schema([(id_column, _arrow(kind)), ("ids", pa.binary()), ("bytes", pa.binary())])
    return coded.select(id_column, "ids").mapInArrow(partial(decode_rows, path=path, pattern=pattern, schema=out), f"{id_column} {kind.simpleString()}, ids binary, bytes binary")


def sha256_hex(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
