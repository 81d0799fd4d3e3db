"""Operators 1, 4 and 9 split texts where the libraries do, over all code points."""

import random
import re
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from geotally.llm import characters, op1_bpe, op4_packing, op9_token_counts

ALL = [*characters.EVERY, *(chr(c) for c in range(0x40000, 0x110000, 4099))]


def beside(before, after):
    """Texts that hold every code point once, between these."""
    return ["".join(before + c + after for c in ALL[i : i + 5000]) for i in range(0, len(ALL), 5000)]


BESIDE = [t for x in ("a", "7", "#") for t in beside(x, x)]
R = random.Random(11)
ODD = ["₞ן", "Ɤa", *("".join(R.choice([*"aé1 '#\n", *ALL[0x550:0x5f0], *ALL[0x20a0:0x20d0], *R.sample(ALL[:0x3000], 20), *characters.strange()[:400]]) for _ in range(R.randint(1, 30))) for _ in range(500))]


def test_byte_bpe_over_all_code_points():
    ranks = op1_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = op1_bpe.TextCoder(op1_bpe.PairCoder.from_ranks(ranks), op1_bpe.split_by(P.PATTERN))
    for t in [*BESIDE, *ODD]:
        assert list(array("I", own.packed(t))) == library.encode_ordinary(t)


def test_packing_ids_over_all_code_points():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder, special = op4_packing.json_coder(P.path("byte_bpe_50k.json"))
    own = op1_bpe.TextCoder(coder, op1_bpe.split_by(P.PATTERN, characters.of_tokenizers), special)
    for t in [*BESIDE, *ODD]:
        assert list(array("I", own.packed(t))) == library.encode(t, add_special_tokens=False).ids


def test_token_counts_over_all_code_points():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    compiled = op9_token_counts.Compiled(P.path("word_bpe_49k.json"))
    machine, normalised = compiled.machine, compiled.normalised
    texts, gap = [*BESIDE, *ODD], re.compile(f"[{characters.ranges(characters.of_tokenizers(chr(92) + 's'))}]+")
    assert [gap.sub(" ", normalised(t)) for t in texts] == [library.normalizer.normalize_str(t) for t in texts]
    assert machine.counts([normalised(t) for t in texts]).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_explicit_patterns():
    assert re.findall(characters.explicit(r" ?\p{L}+|\s+(?!\S)|[^\s\p{L}]", characters.of_tiktoken), "ab  c1") == ["ab", " ", " c", "1"]
    with pytest.raises(ValueError, match="negated"):
        characters.explicit(r"[\S]", characters.of_tiktoken)
