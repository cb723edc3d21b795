import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SYLLABLES = "an the er ti on re st ing ed ou le ver mi ra do ci que ent".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


SHARED = prose(60, "shared")
LONG = prose(6000, "long")

# Null and repeated ids, null and empty texts, equal and nearly equal texts, a shared passage, a word without end.
EDGE_ROWS = [
    (1, prose(90, 1)),
    (2, prose(90, 1)),
    (2, prose(90, 1)),
    (3, prose(45, 3) + " " + SHARED + " " + prose(50, 4)),
    (4, prose(20, 5) + "\n" + SHARED + "\t" + prose(30, 6)),
    (5, ""),
    (6, None),
    (None, "Alone. With No id"),
    (None, None),
    (7, " \t\n "),
    (8, "x" * 50_000 + " end"),
    (9, LONG),
    (10, LONG + " tail"),
    (11, "one"),
    (12, "ÜBER Öl   naïve <|endoftext|> it's 12,5 don't İ"),
    (13, (prose(7, 13) + ". ") * 30),
    (-5, "mail a.b+c@x-y.example.org, call +1 (555) 010-9999 or 10.0.0.256 and 192.168.001.7 card 4111 1111-1111 1111"),
    (14, "bad card 4111 1111 1111 1112; iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789 no 12.34.56.78.9.10.11.12"),
    (15, "+1234567 +12 345 678 90 1 2 3 4 5 " + "7" * 3000 + " a@b a@b.c@d.e_f@g.hi"),
]


def frame(spark, rows):
    """A documents table with further columns under names that operators use themselves."""
    full = [(d, t, "en", "src", len(t or ""), 1, "x", 2.0, [3]) for d, t in rows]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "rid int, fp string, score double, at array<int>"
    )
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE_ROWS).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
