"""Where the public tokenizers' files are."""

from __future__ import annotations

#: Folder of the files; None: where the package public_tokenizers is installed.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))
