"""Where the public vocabularies lie. They are read on the driver and never copied here."""

from __future__ import annotations

FOLDER = "/opt/tokenizers"  # used where the package that installs them is absent

# The pattern of the rank files' vocabularies: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_file(name: str, folder: str = FOLDER) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"{folder}/{name}"
    return public_tokenizers.path(name)
