"""Token counts by a public byte-level BPE tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latentia.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging; a property of the vocabulary, to be given with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MADE: dict = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """One encoder per worker process."""
    if (vocabulary, pattern) not in _MADE:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _MADE[vocabulary, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[vocabulary, pattern]


def n_tokens(text: str | None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> int:
    """Tokens of the whole text; the strings of special tokens are ordinary text; 0 for null and empty texts."""
    return len(encoder(vocabulary, pattern).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text: str, keep: dict[str, str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns of ``keep`` (new name: expression) and ``n_tokens``; texts do not leave their task."""
    ship(df.sparkSession)
    kept = df.select(*[F.expr(e).alias(n) for n, e in keep.items()], F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    return kept.mapInArrow(run, f"{schema}, n_tokens long")
