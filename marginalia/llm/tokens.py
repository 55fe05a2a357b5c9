"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the rank file used by default. Both are parameters of every operator.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest text handed to the tokenizer in one call; longer ones are encoded in such parts, cut at line ends if there are any.
PART = 200_000


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = f"{FOLDER}/{VOCABULARY}") -> int:
    """Tokens of a whole text. Special-token strings count as ordinary text; null and empty texts have none."""
    encode = _encoding(path).encode_ordinary
    total, at = 0, 0
    text = text or ""
    while at < len(text):
        end = at + PART
        if end < len(text):
            end = text.rfind("\n", at, end) + 1 or end
            end = end if end > at else at + PART
        total += len(encode(text[at:end]))
        at = end
    return total


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its text column and with ``out``, the size of each text; nulls have size 0. One Arrow pass, no shuffle."""
    keep = [c for c in df.columns if c not in (text, out)]
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [count_tokens(t, path) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, out])

    source = df.select(*keep, F.col(text))
    schema = source.drop(text).schema.add(out, "long") if keep else None
    return source.mapInArrow(run, schema)
