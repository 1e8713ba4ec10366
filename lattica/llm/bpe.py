"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Every pattern match is merged separately, so a text may be cut between matches without changing its ids. Long texts
are cut at single spaces between two visible characters, where a match always begins, and the pieces are encoded one
after the other; a run without such a space is one piece. Ids are joined and decoded from their raw bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Code points that a piece has at least before it may be cut.
PIECE = 50_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def encoding(ranks: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once in each worker. ranks: a path, or the name of a file sent by SparkContext.addFile."""
    import os

    import tiktoken

    with open(ranks if os.path.exists(ranks) else SparkFiles.get(os.path.basename(ranks)), "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in parts whose encodings, joined, are the encoding of text."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, ranks: str, pattern: str) -> np.ndarray:
    """Token ids as unsigned 32-bit integers; none for a null or empty text."""
    ids: list[int] = []
    for piece in pieces(text or ""):
        ids += encoding(ranks, pattern).encode_ordinary(piece)
    return np.array(ids, dtype="<u4")


def decode(ids: np.ndarray, ranks: str, pattern: str) -> bytes:
    return encoding(ranks, pattern).decode_bytes(ids.tolist())


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, and ids as array<int> if asked for), one row for each row of docs.

    A null or empty text has no tokens. Repeated rows are encoded each for itself, and texts of any length whole; an empty
    table gives an empty one. Other columns are not read. The rank file is sent to the executors.
    """
    docs.sparkSession.sparkContext.addFile(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, first, second, all_ids = [], [], [], []
                for value in part.column(1):
                    got = encode(value.as_py(), ranks, pattern)
                    n.append(len(got))
                    first.append(hashlib.sha256(got.tobytes()).hexdigest())
                    second.append(hashlib.sha256(decode(got, ranks, pattern)).hexdigest())
                    if ids:
                        all_ids.append(got.astype(np.int32))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(key, text).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes): the raw bytes that the ids of each row stand for; a null list gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(np.array(x.as_py() or [], np.int64), ranks, pattern) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "bytes"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, bytes binary")
