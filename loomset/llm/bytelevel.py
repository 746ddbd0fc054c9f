"""Byte-level BPE vocabulary files: symbols, merge ranks, special strings and the pre-tokeniser."""

from __future__ import annotations

import json
import unicodedata

import regex

#: The byte-level pre-tokeniser's pattern (contractions, letters, numbers, other, white space).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
GENERAL = regex.compile(
    CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Texts whose code points all lie below this take a pattern with spelled-out classes, which ``re`` runs several times faster.
NARROW_END = 0x250


def _narrow_pattern():
    import re

    def members(test) -> str:
        return "".join(re.escape(chr(c)) for c in range(NARROW_END) if test(chr(c)))

    letters = members(lambda c: unicodedata.category(c)[0] == "L")
    numbers = members(lambda c: unicodedata.category(c)[0] == "N")
    blanks = members(lambda c: bool(regex.match(r"\p{White_Space}", c)))
    return re.compile(
        f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )


NARROW = _narrow_pattern()


def byte_symbols() -> dict[int, str]:
    """Byte -> the printable character that stands for it in vocabulary files: itself if visible Latin-1, else the next from U+0100."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


#: Ids stay below 2 to this power.
PAIR_SHIFT = 21


class Vocabulary:
    """A byte-level BPE file (``tokenizers`` JSON): ``id_of`` bytes, ``bytes_of`` ids, merge ranks by pair, ``special`` ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_symbols().items()}
        raw = {token: bytes(to_byte[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id: list[int] = [ids[c] for _, c in sorted(byte_symbols().items())]
        self.rank_of: dict[int, int] = {}  # left id << PAIR_SHIFT | right id -> rank of the merge
        self.merged: list[int] = []  # by rank: the id that the merge makes
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank_of[ids[left] << PAIR_SHIFT | ids[right]] = rank
            self.merged.append(ids[left + right])
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pretokens(self, text: str) -> list[str]:
        """The text cut into pre-tokens; a special token's string stands by itself. Joined, they give the text back."""
        if self._special_split is None or not any(s in text for s in self.special):
            return words(text)
        out: list[str] = []
        for part in self._special_split.split(text):
            out += [part] if part in self.special else words(part)
        return out


def words(text: str) -> list[str]:
    narrow = text.isascii() or (text and max(text) < chr(NARROW_END))
    return (NARROW if narrow else GENERAL).findall(text)


class Bounded(dict):
    """A mapping filled by ``make`` on a miss; emptied when it holds ``limit`` entries, so its memory is bounded."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
