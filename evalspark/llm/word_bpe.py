"""Words of a tokenizers file: its normaliser and pattern applied word by word.

Shared by the token counts (which merge on their own) and by packing (which asks the library's model for ids). A word between
white space never depends on its neighbours under this file's rules, so workers remember words, not texts. Plain Latin words
are cut here; what lies in other alphabets is normalised and split by the library, whose Unicode tables then decide.
"""
from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: White space for Python's split() but not for the file's pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters below are single code points whose lower case and bytes don't depend on their neighbours.
LATIN = "\u0250"


class WordRules:
    """What the file says about texts before any merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.end = self.model["end_of_word_suffix"]

        # lower case and byte letters of single Latin letters, as the library has them
        self.latin = {c: self._split(chr(c))[0] for c in range(ord(LATIN)) if chr(c).isalpha() and len(self._split(chr(c))) == 1}

    def _split(self, part: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]

    def words(self, text: str) -> list[str]:
        return regex.split(r"\s+", text) if ODD_SPACE.search(text) else text.split()

    def pieces(self, word: str) -> list[str | int]:
        """Pieces of a word in the letters that stand for its bytes; the id of a special string that stands in it."""
        if word and max(word) < LATIN and "\u0130" not in word:
            if word.isalpha():
                return [word.translate(self.latin)]
            if word[-1] in (".", ",") and word[:-1].isalpha():
                return [word[:-1].translate(self.latin), word[-1]]
        out: list[str | int] = []
        for part in self.cut.split(word):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self._split(part)
        return out


@lru_cache(4)
def rules(path: str) -> WordRules:
    return WordRules(path)
