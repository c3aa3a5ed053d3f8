import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, wordless and long texts, repeated rows, and columns whose names clash with those the operators use inside."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
    rows = [
        (1, base * 3), (2, base * 3), (2, base * 3), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "one two"), (8, "x" * 50_000), (9, "w " * 20_000), (None, base * 3),
        (10, "Ünï cödé Ünï × 日本語　テキスト é à"), (11, base * 3 + "changed"), (12, " ".join(f"tok{i}" for i in range(300))), (13, " ".join(f"tok{i}" for i in range(40, 340))),
    ]
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "h", 1, "b") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, bucket int, data string")
