"""Token counts by byte-pair merging with a heap over a linked list: initial symbols minus merges, no ids made.

Nulls count as the empty text (0 tokens, 0 bytes). Every row of the input gives one row; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import word_encoder
from .common import map_rows, table

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        coder = word_encoder(path)
        for keys, texts in batches:
            texts = [t or "" for t in texts]
            counts = [coder.count(t) for t in texts]
            yield {id_col: keys, "n_bytes": [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_rows(docs, [id_col, text_col], f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean", work)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
