"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from presswell.tables import public_tokenizer, spread

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken vocabulary file, built once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _counter(path: str, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sizes, pa.int64())], [*kept, "tokens"])

    return count


def token_counts(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and `tokens` of each document; a null or empty text has 0 tokens. Whole texts are read."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens long"
    return spread(documents.select(*keep, "text")).mapInArrow(_counter(public_tokenizer(vocabulary), keep), schema)
