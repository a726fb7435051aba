"""Public tokenizer files, opened once in each process that needs them."""

from __future__ import annotations

import base64
import functools
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=8)
def library(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


@functools.lru_cache(maxsize=4)
def byte_ranks(path: str, pattern: str):
    """The same byte-level vocabulary as ranks, in the library that merges faster."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("draftlens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
