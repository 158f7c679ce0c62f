"""A public tokenizer's ranks, loaded once per Python worker."""

from __future__ import annotations

import base64
import os

TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges, as published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[int, tuple] = {}


class Vocabulary:
    """The ranks of a tokenizer as a broadcast; the file is under 1 MB whatever the corpus."""

    def __init__(self, spark, name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS):
        with open(f"{folder}/{name}", "rb") as lines:
            data = lines.read()
        if len(data) > 16 << 20:
            raise ValueError(f"{name} is too large to broadcast")
        self.data = spark.sparkContext.broadcast(data)

    def get(self):
        """(tiktoken encoding, list of the bytes of each token id)"""
        key = hash(self.data.value)
        if key not in _loaded:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.value.splitlines())}
            encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            table = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            _loaded[key] = encoding, table
        return _loaded[key]
