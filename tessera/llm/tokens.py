"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re

#: The vocabulary used by problems 6 and 7: byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for texts of the characters below, by the quicker engine.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on which both engines agree: Latin letters, ASCII digits, and signs that neither takes for a letter or number.
_UNSAFE = re.compile("[^\\t\\n\\r\\x0c -~\\xa0-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac\\u2116\\u2588\\u2026]")


def ranks_of(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary, read by the driver: it travels to the workers as a broadcast (about 50,000 short pieces), so they needn't have the file."""
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter_:
    """Counts tokens; splits as the tokenizer does and remembers the size of each piece."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self.encoding.encode_ordinary

        class Sizes(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) > 1_000_000:  # pieces of a stream never end
                    self.clear()
                n = self[piece] = len(encode(piece))
                return n

        self.sizes = Sizes()

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if _UNSAFE.search(text):
            return len(self.encoding.encode_ordinary(text))
        return sum(map(self.sizes.__getitem__, _QUICK.findall(text)))
