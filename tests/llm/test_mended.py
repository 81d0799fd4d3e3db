"""Very long lines, words and labelled texts; packing against an exact solver; state maps that are composed."""

import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from geotally.llm import op3_quality_classifier, op4_packing, op9_token_counts


def test_a_long_labelled_text_changes_no_other_weight(spark):
    r = random.Random(1)
    good = [(i, "\n".join(" ".join(r.choice(["calm", "words", "in", "a", "row"]) for _ in range(12)) + "." for _ in range(5)), 1) for i in range(0, 60, 2)]
    bad = [(i, "\n".join("BUY!! $$$ " * 6 for _ in range(5)), 0) for i in range(1, 60, 2)]
    plain = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    long = spark.createDataFrame([(1001, "one long line of many\n" * 500_000, 0)], "doc_id long, text string, quality int")
    first = op3_quality_classifier.fit(plain.select("doc_id", "text"), plain.select("doc_id", "quality"))
    both = plain.unionByName(long)
    second = op3_quality_classifier.fit(both.select("doc_id", "text"), both.select("doc_id", "quality"))
    assert (first.weights == second.weights).all() and (first.moves == second.moves).all() and np.abs(first.weights).max() > 0.1
    scored = {v["doc_id"]: v["score"] for v in op3_quality_classifier.classified(both.select("doc_id", "text"), both.select("doc_id", "quality")).collect()}
    assert min(scored[i] for i, _, _ in good) > 0.5 > max(scored[i] for i, _, _ in bad)


def exact(sizes, capacity):
    """The fewest sequences, by trying every place for every piece."""
    sizes = sorted(sizes, reverse=True)
    best, low = len(sizes), -(-sum(sizes) // capacity)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best or best == low:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms) if room >= sizes[i]}.values():
            rooms[j] -= sizes[i]
            place(i + 1, rooms)
            rooms[j] += sizes[i]
        rooms.append(capacity - sizes[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best


def test_packing_equals_an_exact_solver():
    r = random.Random(4)
    cases = [({8: 2, 3: 2, 10: 1, 4: 2}, 20), ({13: 2, 14: 4, 20: 2, 30: 2, 9: 2}, 50)]
    for _ in range(1000):
        capacity, h = r.randint(20, 100), {}
        for _ in range(r.randint(1, 14)):
            s = r.randint(max(1, capacity // 10), capacity // 2) if r.random() < 0.7 else r.randint(1, capacity)
            h[s] = h.get(s, 0) + 1
        cases.append((h, capacity))
    for h, capacity in cases:
        found, proved = op4_packing.search(h, capacity, 100_000)
        held = {}
        for filling, times in found:
            assert sum(s * n for s, n in filling) <= capacity
            for s, n in filling:
                held[s] = held.get(s, 0) + n * times
        assert held == h and proved and sum(t for _, t in found) == exact([s for s, n in h.items() for _ in range(n)], capacity), (h, capacity)


def test_a_search_that_was_cut_proves_nothing():
    h = {s: 3 for s in range(21, 60)}
    found, proved = op4_packing.search(h, 100, 1)
    assert proved == (sum(t for _, t in found) == op4_packing.least(h, 100))
    many = {s: 40 for s in range(1, 2049, 3)}
    assert sum(t for _, t in op4_packing.plan(many, 2048)) <= sum(t for _, t in op4_packing.best_fit(many, 2048))


def test_token_counts_of_long_words(monkeypatch):
    path, r = P.path("word_bpe_49k.json"), random.Random(1)
    library, compiled = Tokenizer.from_file(path), op9_token_counts.Compiled(path)
    monkeypatch.setattr(op9_token_counts, "BITS", 12)
    monkeypatch.setattr(op9_token_counts, "BYTES", 2000)

    def same(text, most):
        machine = compiled.machine
        return sum(int(machine.counts([compiled.normalised(p)])[0]) for p in op9_token_counts.pieces(text, most)) == len(library.encode(text, add_special_tokens=False).ids)

    for n in (3500, 4500, 60_000):  # the table starts with room for 4,096 transitions
        assert same("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n)), 1000)
        assert same("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), 1000)
    for text in ("one\ttwo's\t'll12½ " * 3000, "1" * 5000, "!?" * 5000, "a" * 5000, "'ve" * 3000, "é" * 3000, "漢字。" * 3000):
        assert same(text, 700)
    for _ in range(150):
        text = "".join(r.choice(["a", "b", "'s", "'", "ll", "'ve", " ", "\t", "1", "½", "é", "漢", "_", ".", "!!", "\n", "re", "́"]) for _ in range(r.randint(0, 300)))
        assert same(text, 50), text


def test_maps_are_composed_in_few_rounds(monkeypatch):
    """A word of hundreds of chunks takes a few passes, not one a chunk."""
    path, calls = P.path("word_bpe_49k.json"), []
    compiled = op9_token_counts.Compiled(path)
    run = op9_token_counts.Transducer.run
    monkeypatch.setattr(op9_token_counts.Transducer, "run", lambda self, *a: calls.append(1) or run(self, *a))
    r = random.Random(2)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(256 * 200))
    assert compiled.machine.counts([word])[0] == len(Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids) and len(calls) <= 8
