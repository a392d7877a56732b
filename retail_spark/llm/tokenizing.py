"""Exact encoding with the tokenizers library, piece by piece: the same ids as for whole texts, without encoding a word twice."""

from __future__ import annotations

import os
import re
from array import array

from retail_spark.llm.common import per_worker

#: Unicode white space: what the tokenizers' patterns call \s. Python's own split() takes \x1c-\x1f as well.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_WHITE = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(f"[^{WHITE}]+")


#: Characters for which Python's classes and case agree with the libraries', and that no normal form changes.
PLAIN = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\u024f]+")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE_CHARACTERS = {b: c for c, b in byte_values().items()}


def byte_level(word: str) -> str:
    """A word as byte-level models take it: a character for each byte."""
    return word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; loaded once per Python worker."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return made

    return per_worker(f"tokenizer:{path}", load)


def special_cut(tok) -> re.Pattern | None:
    """A pattern whose split() gives texts and special strings in turn; None if there are none."""
    contents = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None


def white_words(text: str) -> list[str]:
    """The runs of a text between white space."""
    return _WORDS.findall(text) if _ODD_WHITE.search(text) else text.split()


class WordIds(dict):
    """Ids of a word as bytes of little-endian unsigned 32-bit numbers, for tokenizers that drop white space and case.

    Holds two generations of at most ``most`` words: when the young one is full it
    becomes the old one, and words asked for again move back. A word that ends
    in a stop after a letter is its parts' ids. A word of plain letters is one piece to the normalizer and
    the pre-tokenizer, so it goes to the merges directly.
    """

    def __init__(self, tok, most: int = 600_000):
        super().__init__()
        self.tok, self.model, self.most, self.old = tok, tok.model, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if len(word) > 1 and word[-1] in ",.!?;:" and word[-2].isascii() and word[-2].isalpha():
                ids = self[word[:-1]] + self[word[-1]]
            elif word.islower() and _LETTERS.fullmatch(word):
                ids = array("I", [t.id for t in self.model.tokenize(byte_level(word))]).tobytes()
            else:
                ids = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def word_ids(path: str) -> WordIds:
    return per_worker(f"words:{path}", lambda: WordIds(tokenizer(path)))


def encode_words(text: str, ids: WordIds, cut: re.Pattern | None) -> bytes:
    """The ids of a whole text, special strings in it included, as bytes."""
    parts = cut.split(text) if cut is not None else [text]
    out = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(ids.tok.token_to_id(part).to_bytes(4, "little"))
        else:
            out += map(ids.__getitem__, white_words(part if PLAIN.search(part) else part.lower()))
    return b"".join(out)
