import random

import numpy as np
import pandas as pd
import pytest


def syllables(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(("an", "the", "ou", "er", "ti", "ß", "wh", "Re"), k=rng.randint(1, 4))) + rng.choice(("", "", "", ",", ".", "\n")) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows and doc_ids."""
    rng = random.Random(3)
    base = [syllables(rng, rng.randint(30, 160)) for _ in range(25)]
    passage = syllables(rng, 60)
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(6)]                                               # copies
    rows += [(200 + i, base[i].replace(" ", "  ", 1) + " tail", "s1") for i in range(8)]               # near copies
    rows += [(300 + i, syllables(rng, 20) + " " + passage + " " + syllables(rng, 20), None) for i in range(6)]
    rows += [(400, None, "s1"), (401, "", None), (None, base[2], "s2"), (None, None, None), (402, " \n\t ", "s2"), (403, "one", "s2"),
             (404, "One", "s3"), (405, "  two words ", "s3"), (7, "another text of the same number " * 4, "s0"), (3, base[3], "s3"), (3, base[3], "s3"),
             (406, syllables(rng, 6000), "s2"), (407, "the " * 3000, "s2"), (408, "a" * 5000, "s1"), (409, "password = abcdef12 " * 3, "s1")]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """The messy rows with further columns, some named like columns that operators make."""
    pdf = pd.DataFrame(messy_rows(), columns=["doc_id", "text", "source"], dtype=object)
    df = spark.createDataFrame([(None if pd.isna(a) else int(a), b, c, 1, "x", 2.0, 9, 8) for a, b, c in pdf.itertuples(index=False)],
                               "doc_id long, text string, source string, n int, key string, size double, _row long, h long")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


def vectors(n: int = 400, dim: int = 16) -> list[tuple]:
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[0:40] + rng.normal(size=(40, dim)) * 0.12
    x[100:120] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, [1.0] * (dim - 1) + [float("inf")]), (904, [None] + [1.0] * (dim - 1)),
                   (905, []), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, x[3].tolist()), (5, x[5].tolist())]


@pytest.fixture(scope="session")
def messy_vectors(spark):
    return spark.createDataFrame([(*r, 1, "k") for r in vectors()], "vec_id long, embedding array<float>, label int, k1 string")
