"""The byte-level BPE vocabulary that token counts use, read once on the driver and handed to the workers."""

from __future__ import annotations

import base64
import os

from pyspark.sql import SparkSession

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def broadcast(spark: SparkSession, folder: str = FOLDER, ranks: str = RANKS):
    """The rank file (under 1 MB) as a broadcast of its bytes."""
    with open(os.path.join(folder, ranks), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoding(data: bytes):
    """The encoding of a rank file; kept on the tiktoken module, since functions that travel by value keep nothing."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_kept_encodings", {})
    if (key := hash(data)) not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        kept[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]
