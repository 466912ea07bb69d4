"""Byte-level BPE encoding and decoding by a rank file.

Nulls encode as the empty text: no ids. Texts of any length are taken whole. Repeated rows and equal ids give one
output row per input row; columns besides the two named are not read, so clashing names do no harm; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import rank_encoder
from .common import map_rows, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids array<int>) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        coder = rank_encoder(path, pattern)
        for keys, texts in batches:
            yield {id_col: keys, "ids": [coder.encode(t or "").tolist() for t in texts]}

    return map_rows(docs, [id_col, text_col], f"{id_col} {kind}, ids array<int>", work)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, data binary) of every row: the bytes that the ids stand for; null ids decode as no bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def work(batches):
        coder = rank_encoder(path, pattern)
        for keys, ids in batches:
            yield {id_col: keys, "data": [coder.decode(x or []) for x in ids]}

    return map_rows(encoded, [id_col, ids_col], f"{id_col} {kind}, data binary", work)


def round_trip_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode, decode and digest in one pass, so that no ids leave the worker."""

    def work(batches):
        coder = rank_encoder(path, pattern)
        for keys, texts in batches:
            out = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                ids = coder.encode(text or "").tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(coder.decimal(ids)).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield out

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
