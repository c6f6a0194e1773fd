"""Planted passages just over the bound of op8_substrings."""
import random

from lodestrata.llm import substrings


def test_short_planted_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 11)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, long = [], set()
    for i in range(800):
        n = 51 if i % 2 else 45
        shared = text(n)
        for doc in (2 * i, 2 * i + 1):
            rows.append((doc, f"{text(40)} {shared} {text(40)}"))
            long |= {doc} if n > 50 else set()
    got = {r.doc_id for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= long and len(long - got) <= 0.01 * len(long)


def test_shared_words():
    assert substrings.shared_words(b"\na b ", b"c d", b" e f\n", b"x b c d e g") == 4
    assert substrings.shared_words(b"\nab ", b"c", b"d\n", b"xab ce") == 0
