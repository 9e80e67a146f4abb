"""Small texts with every awkward case, and plain re-computations to compare with."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, k int, h string, key string, text_hash int, size int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"{rng.choice('bdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bdglmnrst')}{''.join(chr(97 + int(c, 16)) for c in f'{i:x}')}o" for i in rng.choices(range(vocabulary), k=n)]
    out = []
    for k, w in enumerate(words):
        out.append(w + (".\n" if k % 37 == 36 else " "))
    return "".join(out)


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"zz{seed}q{k}" if rng.random() < share else w for k, w in enumerate(text.split(" ")))


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a long word, a long text, clashing extra columns."""
    long = prose(5, 30_000)
    rows = [(None, None), (1, ""), (2, " \n\t\x0b "), (3, "one"), (4, "one two three four"), (5, prose(1, 120)), (5, prose(1, 120)),
            (5, prose(2, 90)), (None, prose(1, 120)), (6, "x" * 5000), (7, long), (8, prose(1, 120) + "tail"), (9, None), (9, None),
            (10, "Ünï <|endoftext|> ça va là İSTANBUL don't 42%%% !!"), (11, "a b c\na b c\na b c d")]
    extra = [(None, None, None)] * 3 + [("en", "s1", 3), ("de", None, None), (None, "s1", 1)] * 5
    return spark.createDataFrame([(i, t, *e, "r", 1, "h", "key", 2, 3) for (i, t), e in zip(rows, extra)], SCHEMA)


def words(text):
    return WORD.findall(text or "")
