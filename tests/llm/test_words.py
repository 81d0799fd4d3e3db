"""Operator 4's ids: texts are coded together, each distinct word once, and equal the library's whatever the white space."""

import random
from array import array

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from geotally.llm import characters, op1_bpe, op4_packing, word_coder

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
R = random.Random(5)
GAPS = [" ", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", " ", "  ", "\x1c ", "\xa0 ", "\x85", "   ", "<|endoftext|>", " <|endoftext|> "]


def words(n):
    return ["".join(R.choice(["th", "e", "ing", "aa", "x", "é", "ß", "中文", "12", "'s", "#", ".", ",", "🙂"]) for _ in range(R.randint(1, 9))) for _ in range(n)]


KNOWN = words(200)
TEXTS = ["", " ", "  ", "\n", "a ", " a", "a  b", "a   b\n", "a \n b", *("".join(x for w in R.choices(KNOWN, k=R.randint(1, 60)) for x in (w, R.choice(GAPS))) for _ in range(400)), "a" * 3000 + " " + "ab" * 90]


def coder():
    pairs, special = op4_packing.json_coder(PATH)
    return word_coder.WordCoder(pairs, op1_bpe.split_by(P.PATTERN, characters.of_tokenizers), characters.ranges(characters.of_tokenizers(r"\s")), special)


def ids(own, texts):
    return [list(array("I", x)) for x in own.packed(texts)]


@pytest.mark.parametrize(("together", "most", "step", "widest"), [(500_000, 400_000, 200_000, 64), (40, 30, 12, 3), (700, 100, 50, 8)])
def test_ids_equal_the_library(monkeypatch, together, most, step, widest):
    for name, value in (("TOGETHER", together), ("MOST", most), ("STEP", step), ("WIDEST", widest)):
        monkeypatch.setattr(word_coder, name, value)
    assert ids(coder(), TEXTS) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_ids_over_all_code_points():
    texts = ["".join(f"{a}{c}{b}" for c in characters.EVERY[i : i + 5000]) for a, b in (("a", "a"), ("#", " 7"), (" ", "")) for i in range(0, len(characters.EVERY), 5000)]
    assert ids(coder(), texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_pieces():
    texts = ["".join(R.choices(letters, k=R.randint(1, 70))) for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éèàüß", "0123456789", "=-*#") for _ in range(3000)]
    assert ids(coder(), texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_split_once(monkeypatch):
    """Before, the pattern ran over whole texts, and each new piece was coded by itself."""
    own, seen, alone = coder(), [], []
    split, encode = own.texts.ascii, own.merges.coder.encode

    class Counted:
        def findall(self, text):
            seen.append(text)
            return split.findall(text)

    own.texts.ascii = Counted()
    monkeypatch.setattr(own.merges.coder, "encode", lambda piece: alone.append(piece) or encode(piece))
    texts = [" ".join(R.choices(["the", "thing,", "ends.", "here"], k=500)) for _ in range(100)]
    assert ids(own, texts + texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts] * 2
    assert len(seen) <= 9 and not alone  # four words with a space before them, up to four first words, the first word of none


def test_memos_stay_small(monkeypatch):
    monkeypatch.setattr(word_coder, "MOST", 500)
    monkeypatch.setattr(word_coder, "TOGETHER", 1000)
    own = coder()
    for _ in own.packed(" ".join([*words(100), "x" * 10_000]) for _ in range(60)):
        assert sum(map(len, (*own.known, *own.older))) < 2 * (500 + 400)
    assert all(len(w) <= word_coder.LONGEST_KEPT for memo in (*own.known, *own.older) for w in memo)
