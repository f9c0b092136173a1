"""What a byte-pair vocabulary file says: merge ranks, ids, byte alphabet and special strings.

The file is read once on the driver and travels as a broadcast, whose size is that of the fixed vocabulary.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

from tokenizers import Regex, pre_tokenizers

#: Unicode White_Space, spelled out because engines disagree on what a backslash-s means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next free one above 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


@dataclass
class BpeTables:
    ids: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    special: dict[str, int]
    alphabet: list[str] = field(default_factory=byte_alphabet)

    @classmethod
    def read(cls, path: str) -> BpeTables:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        return cls(model["vocab"], merges, model.get("end_of_word_suffix") or "", special)

    def special_pattern(self) -> re.Pattern:
        """Matches a special string; the longest first. Never matches where there are none."""
        names = sorted(self.special, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else r"((?!))")


def pieces(text: str, size: int):
    """Slices of at least ``size`` characters that end before white space (or at the end), so that no word is cut."""
    at, n = 0, len(text)
    space = re.compile(f"[{SPACE}]")
    while at < n:
        found = space.search(text, min(at + size, n))
        end = found.start() if found else n
        yield text[at:end]
        at = end


class Splitter:
    """Words of a text by a pattern. ``ascii_words`` and ``words`` say the same as ``pattern`` with tables of their own; a
    text with code points that these don't know is split with the tokenizers library's tables."""

    def __init__(self, pattern: str, ascii_words, words):
        self.ascii, self.words = ascii_words, words
        self.theirs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [w for w, _ in self.theirs.pre_tokenize_str(text)]
        return self.words.findall(text)
