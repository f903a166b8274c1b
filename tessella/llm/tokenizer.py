"""A public byte-level BPE vocabulary, loaded once in each Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files; they are never copied into the repository.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def load(folder: str = VOCABULARIES, name: str = BYTE_BPE):  # noqa: ANN201
    """The encoding, and of each id its number of bytes."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = [0] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
