"""Parameters that the registered queries and the pipeline share."""

from __future__ import annotations

# Fixed values of the URL query: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def source_weights(names: list) -> dict:
    """1, 2, 3, repeating, by code point."""
    return {name: k % 3 + 1 for k, name in enumerate(names)}


def source_schedules(names: list) -> dict:
    """Some sources grow in weight over training, some shrink, some stay."""
    return {name: [(0.0, 1.0 + k % 3), (1.0, 3.0 - k % 3)] for k, name in enumerate(names)}


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
