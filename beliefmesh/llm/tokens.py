"""Pre-token splitting shared by token counting and packing.

Texts of common characters are split here with the tokenizers' own patterns (their normal form is plain). Of any other
text, `Splitter` takes the pre-tokens from the library's own pre-tokenizer, so that its Unicode tables decide; special
strings are pre-tokens of their own.
"""

from __future__ import annotations

import re
import unicodedata

# characters whose NFC form, lower case and class are the same in every library: printable ASCII, tab, line ends,
# and Latin letters and signs up to U+024F without no-break space, next line and soft hyphen
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ſƒ]*").fullmatch
_LATIN = [chr(c) for c in range(0xA1, 0x250)]
_LETTERS = "a-zA-Z" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "0-9" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
# fixed values: the public patterns of the two vocabularies' pre-tokenizers, over plain characters
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"
BYTE_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"


def is_plain(text: str) -> bool:
    return "<|" not in text and PLAIN(text) is not None


class Splitter:
    """The pre-tokens of whole texts of a byte-level tokenizer without a normalizer, each of which it encodes alone as it
    does in the text."""

    def __init__(self, tokenizer):
        added = list(tokenizer.get_added_tokens_decoder().values())
        if tokenizer.normalizer is not None or any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("pre-tokens of this tokenizer can't be counted one by one")
        # the longest first, as the library prefers it where two begin at one place
        strings = sorted((t.content for t in added), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, strings)) + ")").split if strings else lambda text: [text]
        self.common, self.library = re.compile(BYTE_PIECES).findall, tokenizer.pre_tokenizer.pre_tokenize_str

    def __call__(self, text: str) -> list[str]:
        if is_plain(text):
            return self.common(text)
        out = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.common(part) if is_plain(part) else [part[a:b] for _, (a, b) in self.library(part)]
        return out


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
