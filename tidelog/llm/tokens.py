"""Byte-level BPE encoding in Python workers, from the JSON file of a public tokenizer.

`tokenizers` and `tiktoken` give the same ids for one vocabulary; `tiktoken` takes about a quarter of
the CPU time, so an Encoder reads the vocabulary from the `tokenizers` file and encodes with it. Texts
with the file's special tokens, which `tokenizers` cuts out first, and huge texts, whose white space
runs could exceed the limits of tiktoken's regex engine, go to `tokenizers` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Texts over this many characters are encoded by `tokenizers`.
HUGE = 400_000
# Fixed value: the pre-tokenisation pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, as characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.path, self.special = path, [t["content"] for t in spec.get("added_tokens", [])]
        to_byte = byte_of_character()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.size = 1 + max(spec["model"]["vocab"].values())
        self.width = np.zeros(self.size + len(self.special), dtype=np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        for t in spec.get("added_tokens", []):
            self.width[t["id"]] = len(t["content"].encode())
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._whole = None

    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def ids(self, text: str) -> list[int]:
        if len(text) > HUGE or any(s in text for s in self.special):
            return self.whole().encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
