import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves, as extra columns of the input.
CLASHES = "score string, node bigint, shingles string, spans string, a bigint, b bigint, fp string, own_licence string, path string"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text) or (doc_id, text, lang) rows, with columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, f"src{i % 3}", None if r[1] is None else len(r[1]), "x", 1, "y", "z", 2, 3, "w", "v", "u") for i, r in enumerate(rows)]
        return spark.createDataFrame(full, f"{DOC}, {CLASHES}")

    return make


@pytest.fixture
def words():
    rnd = random.Random(7)
    pool = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: (lambda r: [r.choice(pool) for _ in range(n)])(random.Random(seed))
