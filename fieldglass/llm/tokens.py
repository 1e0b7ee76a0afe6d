"""Byte-level BPE ids from public vocabulary files; vocabularies are never trained or copied here."""

from __future__ import annotations

import base64
import os

#: Vocabulary that the queries use: the two files hold the same ids.
NAME = "byte_bpe_50k"
END_OF_TEXT = "<|endoftext|>"


class Tokens:
    """Ids as ``tokenizers`` gives them for ``NAME``.json without added special tokens.

    The rank file of the same vocabulary gives the same ids several times
    faster; texts that spell the special token take the JSON file.
    """

    def __init__(self, folder: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        self.at = (lambda name: os.path.join(folder, name)) if folder else public_tokenizers.path
        with open(self.at(f"{NAME}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(NAME, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if END_OF_TEXT in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.at(f"{NAME}.json"))
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
