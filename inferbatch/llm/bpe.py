"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before they are encoded, at places no match of the pattern can span: before a
white-space run that follows another character. Each match is then encoded as in one whole call.
One call sees about `PIECE_CHARS` characters, and more only as far as no white space follows: a text
without any is one call. Decoding joins the raw bytes of the ids,
so ids that split a character give its bytes back unchanged.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens do not
exist, their strings are ordinary text; a null list of ids decodes to no bytes; rows are independent
of each other, so repeated rows and ids give equal results; an empty table gives an empty result;
other columns
pass unchanged, but one named like the new column is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tiktoken import registry

PIECE_CHARS = 50_000
# White space in any sense before the cut would be part of the same run; after it, only characters
# that every definition of white space holds.
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, built once for each Python process."""
    name = f"{rank_path}\n{pattern}"
    if name not in registry.ENCODINGS:
        lines = (line.split() for line in Path(rank_path).read_bytes().splitlines())
        ranks = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[name]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text into pieces of about `most` characters whose encodings can be joined."""
    start = 0
    while len(text) - start > most:
        cut = SAFE_CUT.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(
    docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", most: int = PIECE_CHARS
) -> DataFrame:
    """Replace the text by its token ids (array of int); other columns stay."""
    columns = [c for c in docs.columns if c not in (text_col, ids_col)]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            ids, offsets = [], [0]
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py() or ""
                n = 0
                for piece in pieces(text, most):
                    got = enc.encode_ordinary(piece)
                    ids.append(pa.array(got, pa.int32()))
                    n += len(got)
                offsets.append(offsets[-1] + n)
            flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*columns, ids_col])

    return docs.select(*columns, text_col).mapInArrow(run, schema)


def decode(docs: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes the ids stand for; other columns stay."""
    docs = docs.drop(bytes_col)
    columns = docs.columns
    at = columns.index(ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            found = [enc.decode_bytes(v.as_py() or []) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*columns, bytes_col])

    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the number of tokens, and digests of the decimal ids and of the decoded bytes."""
    ids = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rank_path, pattern)
    both = decode(ids, rank_path, pattern)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
