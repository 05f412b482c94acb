"""Operator 6, token ids as ORC: run-length encoded integers, stripes, row indexes and Bloom filters on document ids.

Texts are tokenised by a byte-level BPE vocabulary that is read, never trained; its path is a parameter. ORC's writer
encodes the integers (run-length version 2), keeps a row index of ``STRIDE`` rows and a Bloom filter on doc_id in each
stripe. Stripes are read in parallel, one Spark split or more for a stripe; a lookup by doc_id is pushed to the files' and stripes'
metadata, so that stripes and row groups without the id are skipped.

Defined results: a null text has null tokens and n_tokens, an empty one no tokens; texts of any length are encoded whole;
repeated rows and null ids are written as they are; an empty table gives an empty file; other columns aren't written.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
STRIPE_BYTES, STRIDE = 16 << 20, 1000
_ENCODERS: dict = {}


def encoder(path: str):
    """The encoder of a vocabulary file, one for each Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("quern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def encode_batch(texts: pa.Array, path: str) -> pa.Array:
    """Lists of ids of a string array."""
    enc = encoder(path)
    none = np.zeros(0, np.uint32)
    parts = [enc.encode_to_numpy(t) if t else none for t in texts.to_pylist()]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    ids = pa.array(np.concatenate([none, *parts]).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(offs), ids, mask=pc.is_null(texts))


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                ids = encode_batch(part["text"], vocabulary)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pc.list_value_length(ids), ids], ["doc_id", "n_tokens", "tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens int, tokens array<int>")


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> None:
    """Write the token ids of ``docs`` as ORC files under ``path``."""
    out = tokenize(docs, doc_id, text, vocabulary).write.format("orc")
    for k, v in (("orc.stripe.size", stripe_bytes), ("orc.row.index.stride", stride), ("orc.create.index", "true"), ("orc.bloom.filter.columns", "doc_id"), ("orc.bloom.filter.fpp", 0.01)):
        out = out.option(k, v)
    out.save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows, stripe by stripe in parallel."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents, files and stripes pruned by their metadata."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def detokenize(vocabulary: str = VOCABULARY) -> Callable[[list[int]], str]:
    """Ids -> text."""
    return encoder(vocabulary).decode
