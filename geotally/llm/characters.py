"""Character classes as the tokenizer libraries know them.

Their Unicode tables are older or newer than Python's, so the classes of all code points are asked of the libraries themselves
once, on the driver, and go to the workers as explicit ranges.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

#: Every code point of the planes that have or may get characters with properties; the other planes are private or empty.
EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]))
CLASS = re.compile(r"\\(?:[sS]|p\{[A-Z][a-z]?\})")


@cache
def of_tiktoken(name: str) -> str:
    """The members of a class (as in a pattern) in tiktoken: what isn't matched by a pattern is left out of its encoding."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(EVERY)).decode()


@cache
def of_tokenizers(name: str) -> str:
    """The members of a class in tokenizers."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return "".join(piece for piece, _ in Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(EVERY))


def ranges(members: str) -> str:
    """Members (in order) as the inside of a character set."""
    points = np.frombuffer(members.encode("utf-32-le"), np.uint32).astype(np.int64)
    cuts = np.flatnonzero(np.diff(points, prepend=-2, append=1 << 22) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[cuts[:-1]].tolist(), points[cuts[1:] - 1].tolist(), strict=True))


def explicit(pattern: str, members) -> str:
    """A split pattern with every class written out as members(name) knows it, for Python's re."""
    out, at, inside = [], 0, False
    for m in CLASS.finditer(pattern):
        plain = pattern[at : m.start()]
        for c in plain:
            inside = c == "[" or inside and c != "]"
        negated = "^" * (m[0] == r"\S")
        known = ranges(members(r"\s" if negated else m[0]))
        if inside and negated:
            raise ValueError("a negated class inside a set can't be written out")
        out += [plain, known if inside else f"[{negated}{known}]"]
        at = m.end()
    return "".join([*out, pattern[at:]])


class Normalizer:
    """What a tokenizers normalizer of NFC, white space and lower case does, character by character, by Python's faster functions
    where they agree with the library; texts with a character on which they may not go through the library's own."""

    def __init__(self, strange: str, spec: str):
        """strange: see strange(); spec: the normalizer as the library's JSON."""
        self.strange, self.spec, self._library = strange, spec, None
        self.unlike = np.zeros(0x110000, bool)
        self.unlike[np.frombuffer(strange.encode("utf-32-le"), np.uint32)] = True

    def __reduce__(self):
        return Normalizer, (self.strange, self.spec)

    def library(self, text: str) -> str:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec).normalizer
        return self._library.normalize_str(text)

    def __call__(self, text: str) -> str:
        if not text.isascii():
            if self.unlike[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                return self.library(text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # a final one too
        return text.lower()


@cache
def strange() -> str:
    """The characters on which Python's lower case, composition or order of marks may differ from the library's, and those that Python doesn't know."""
    from tokenizers import normalizers as N

    def asked(normalizer, before: str, after: str) -> list[str]:
        return normalizer.normalize_str("\0".join(before + c + after for c in EVERY[1:])).split("\0")

    found = {c for c in EVERY if unicodedata.category(c) == "Cn"}
    found |= {c for c, x in zip(EVERY[1:], asked(N.Lowercase(), "", ""), strict=True) if x != c.lower() and c != "Σ"}
    for c, x in zip(EVERY[1:], asked(N.NFD(), "", ""), strict=True):
        if x != (y := unicodedata.normalize("NFD", c)):
            found |= {c, *x, *y}
    for before, after in (("x\u0315", ""), ("x", "\u0334"), ("", "")):  # marks of the classes 232 and 1 show where c is put
        for c, x in zip(EVERY[1:], asked(N.NFC(), before, after), strict=True):
            if x != unicodedata.normalize("NFC", before + c + after):
                found.add(c)
    return "".join(sorted(found))
