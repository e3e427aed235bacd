"""Vocabulary files of public tokenizers, found where they are installed."""

from __future__ import annotations

import public_tokenizers


def vocabulary(name: str) -> str:
    """The place of a vocabulary file; every machine has its own copy of the package."""
    return public_tokenizers.path(name)


PATTERN = public_tokenizers.PATTERN
