"""Place and reading of the public tokenizer files (a parameter, never copied here)."""

from __future__ import annotations

import base64
import os

TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the split pattern that belongs to the byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(name: str = "byte_bpe_50k", folder: str | None = None) -> dict[bytes, int]:
    """Byte string -> id of a byte-level BPE vocabulary."""
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
