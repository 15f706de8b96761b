"""Token ids of public vocabularies inside tasks.

The vocabulary's own library decides. For the byte-level BPE the same vocabulary also exists as
ranks, read by a library several times faster; it is used for texts made only of characters
whose splitting both libraries agree on (ASCII and the Latin letters up to U+024F), which the
tests compare, and all other texts go to the vocabulary's library.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np

from tallycast.llm.shared import vocabulary

BYTE_BPE = "byte_bpe_50k.json"
_SHARED_CHARACTERS = re.compile("[\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]*")


class Encoder:
    """``ids(text)`` as a numpy array, without added special tokens or truncation."""

    def __init__(self, name: str):
        path = vocabulary(name)
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow = model.encode
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.slow = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        if ranks := _ranks_of(path):
            self.fast = _ranked(ranks, tokenizer.token_to_id("<|endoftext|>"))

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _SHARED_CHARACTERS.fullmatch(text):
            return self.fast(text)
        return np.asarray(self.slow(text), dtype=np.uint32)


def _ranked(path: str, end_of_text: int):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": end_of_text}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One per Python worker."""
    return Encoder(name)


@lru_cache(maxsize=8)
def version(name: str) -> str:
    """Digest of all that decides a count: the vocabulary file, the library that reads it and, where a
    second reader is used, its ranks, pattern and library."""
    path = vocabulary(name)
    parts = [_content(path)]
    if path.endswith(".model"):
        import sentencepiece
        parts.append(sentencepiece.__version__.encode())
    else:
        import tokenizers
        parts.append(tokenizers.__version__.encode())
        if ranks := _ranks_of(path):
            import public_tokenizers
            import tiktoken
            parts += [_content(ranks), public_tokenizers.PATTERN.encode(), tiktoken.__version__.encode()]
    return hashlib.sha256(b"\0".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ranks_of(path: str) -> str | None:
    """The rank file of the second reader, for the vocabulary it is used with."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    return ranks if os.path.basename(path) == BYTE_BPE and os.path.exists(ranks) else None
