"""Byte-level BPE tokens of texts, with a vocabulary file that travels with the job.

The vocabulary is a parameter, a file of ``base64 rank`` lines. It is added to the application's files,
so executors need no copy of their own.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import tiktoken
from pyspark import SparkFiles
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The tokenizer's pattern backtracks over runs of white space; longer ones are taken out before.
LONG_SPACE = 4096
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}")
_shared: set[tuple[str, str]] = set()


def share(spark: SparkSession, path: str) -> None:
    """Adds the vocabulary to the application's files, once for each application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _shared:
        spark.sparkContext.addFile(path)
        _shared.add(key)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    own = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
    with open(own if os.path.exists(own) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Ordinary tokens of a whole text.

    A run of white space is one piece, but for its last character where something follows: that one
    belongs to the next piece or is one by itself. So cutting there changes no token.
    """
    enc = encoding(path)
    if len(text) < LONG_SPACE:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _SPACE.finditer(text):
        begin, end = m.start(), m.end() - (m.end() < len(text))
        if end - begin >= LONG_SPACE:
            out += enc.encode_ordinary(text[at:begin])
            out += enc._encode_single_piece(text[begin:end].encode())
            at = end
    return out + enc.encode_ordinary(text[at:])
