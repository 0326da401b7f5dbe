import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use, or used, inside.
CLASHING = "_spans pii_id pii_hash pii_spans _pii_id gone_id gone_text _gone twice_id _twice bad_id bad_hash _bad_id text_hash ids decoded spans bucket rid sid c0".split()


@pytest.fixture
def prose():
    """Deterministic made-up prose: prose(seed, words)."""

    def make(seed: int, words: int) -> str:
        rng = random.Random(seed)
        parts = ["th", "an", "er", "on", "re", "he", "in", "ed", "nd", "ha", "é", "ß", "to"]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return make


@pytest.fixture
def docs_of(spark):
    """A documents table with clashing extra columns: docs_of([(doc_id, text), ...])."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, result string, score double")
        return df.withColumns({name: F.lit(k) for k, name in enumerate(CLASHING)})

    return make
