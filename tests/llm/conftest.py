import pytest

from peakweave.session import ship

LONG = "word " * 4000 + "x" * 3000 + " 12 34"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, odd characters, and extra columns whose names clash with inner ones."""
    ship(spark)
    rows = [
        (1, "Plain text here, one sentence long."),
        (1, "Plain text here, one sentence long."),
        (2, None),
        (3, ""),
        (4, LONG),
        (5, "Straße 🙂 İstanbul é \u0085  end"),
        (6, "  \n\t "),
        (7, "<|endoftext|> in a <|startoftext|> text"),
        (8, "mail a.b@c.example.org, call +1 (988) 555-2485 at 10.0.0.1, pay 4111 1111 1111 1111 or 4111-1111-1111-1112."),
        (None, "No id here."),
    ]
    names = ["fp", "id", "hash", "found", "score", "digest", "row", "all", "terms", "lower", "component_id"]
    return spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
