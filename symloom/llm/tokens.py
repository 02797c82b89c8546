"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame

from symloom.llm import common

#: Where the rank file of the tokenizer lies; an argument of every operator that counts tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(ranks_path: str):
    """The tokenizer, once a Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, text: str, ranks_path: str = RANKS) -> DataFrame:
    """``rows`` with the column ``text`` replaced by ``tokens`` (long): null texts have null, empty ones 0."""
    rest = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*rest).dtypes)

    def make():
        encode = encoding(ranks_path).encode_ordinary

        def f(*row):
            yield *row[:-1], None if row[-1] is None else len(encode(row[-1]))

        return f

    return common.map_rows(rows.select(*rest, text), f"{schema}, tokens long", make, scan=True)
