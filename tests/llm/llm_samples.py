"""Small tables that several tests share."""

import random

from pyspark.sql import types as T

#: Column names that the operators use inside.
CLASHING = ["_text", "score", "runs", "text_key", "secrets", "d", "t", "h", "bands", "_scanned", "component", "cell", "i", "l", "hits"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeghilmnorstu", k=rng.randint(2, 7))) for _ in range(n))


#: Null and empty texts, a null id, repeated rows, long and odd texts.
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (None, words(40, 1)), (5, words(30, 2)), (5, words(30, 2)), (6, words(30, 2)),
    (7, words(4000, 3)), (8, "é ß 漢字 😀 " * 30), (9, "a" * 3000), (10, "be " * 700), (11, "x"), (12, words(30, 2).upper()),
    (13, "a  b \n c   d e f \x1cg <|endoftext|> h"), (2**40, words(50, 4) + " " + words(3, 5)),
]
