"""Documents with everything awkward, shared by the tests."""

from __future__ import annotations

import random

LONG = " ".join(f"w{k % 977}" for k in range(12_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, node string, size int, hits int"


def texts(seed: int = 5, n: int = 40) -> list[str]:
    """Invented prose with copies, near copies and shared passages."""
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(2, 7))) for _ in range(400)]
    passage = " ".join(pick.choice(words) for _ in range(60))
    out = []
    for k in range(n):
        own = [pick.choice(words) for _ in range(pick.randint(20, 150))]
        if k % 4 == 1:
            own = out[-1].split(" ")
            own[len(own) // 2] = "changed"
        if k % 7 == 2:
            own[5:5] = passage.split(" ")
        out.append(" ".join(own))
    return [*out, out[3], out[3], out[8]]


def documents(spark, extra: list[tuple] = ()):
    rows = [(k, t) for k, t in enumerate(texts())]
    rows += [(1000, None), (1001, ""), (1002, "  \n "), (1003, "one two"), (1004, "one two"), (None, "lost words here"), (None, None)]
    rows += [(1005, LONG), (1006, LONG + " end"), (1007, "aaaa" * 300), (3, rows[3][1]), (3, rows[3][1]), (5, "other text with id five"), *extra]
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
