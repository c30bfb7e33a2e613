import random

import public_tokenizers
import pytest

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ["doc_id", "text", "lang", "source", "n_chars", "TEXT", "kept", "node", "maybe", "key", "label", "starts", "sequence_id", "_0", "fp"]


def frame(spark, rows, extra=True):
    """(doc_id, text) rows as a documents table, with further columns whose names clash with inner and result names."""
    wide = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * (len(CLASHING) - 5 if extra else 0)) for i, t in rows]
    names = CLASHING if extra else CLASHING[:5]
    schema = ", ".join(f"c{k} {'long' if k in (0, 4) else 'string'}" for k in range(len(names)))
    return spark.createDataFrame(wide, schema).toDF(*names)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["thing", "over", "leaf", "of", "the", "er", "mont", "ció"]) + rng.choice(["", "a", "er", "ing", "x", "on"]) + rng.choice(["", "s", "t", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in either column, empty and white texts, ties, repeated rows, long words and texts, junk."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (None, None), (5, ""), (6, " \n\t "), (None, prose(2, 80)), (7, prose(3, 40) + " " + " ".join(base.split()[:50])),
        (8, "x" * 30_000), (9, "€😀 <|endoftext|> ﬁ ſ \x00 " * 9), (10, "w " * 4000), (11, "a\nb\na\n" * 40), (12, prose(4, 6000)), (12, prose(5, 30)), (-3, "one two three"), (13, "one two three"),
    ]
