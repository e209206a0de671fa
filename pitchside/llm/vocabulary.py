"""Where the public tokenizer files are: a parameter, by default the installed package's own path."""

from __future__ import annotations

import os


def default_vocabulary(name: str = "word_bpe_49k.json") -> str:
    if folder := os.environ.get("PITCHSIDE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))
