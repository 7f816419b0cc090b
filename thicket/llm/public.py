"""The operators of this folder with files of the public tokenizers package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from thicket.llm import alignment, bpe


def encoded_digests(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``bpe.round_trip`` with a rank file of that package, which every node has installed.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row. Null and empty texts
    have no tokens and the digests of nothing; repeated rows are encoded each for itself;
    other columns are ignored; an empty table gives no rows.
    """
    return bpe.round_trip(docs, public_tokenizers.path(name), public_tokenizers.PATTERN)


def aligned_tokens(
    docs: DataFrame, side_a: str = "byte_bpe_50k.json", side_b: str = "piece_bpe_32k.model"
) -> DataFrame:
    """``alignment.align`` with two tokenizers of that package."""
    return alignment.align(docs, public_tokenizers.path(side_a), public_tokenizers.path(side_b))
