import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture()
def docs(spark):
    """Ordinary, null, empty, blank, long, repeated and near-equal texts; a null source; an id twice."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \n ", prose(2, 20_000), "one two", "one two", "ONE two", "one", prose(3, 80) + "\nfooter line", prose(4, 80) + "\nfooter line", "ÀÉ naïve ça   x́ Σ"]
    rows = [(i, t, "en", None if i == 3 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (10, "one", "en", "s0", 3), (None, base, "en", "s1", 5)], DOC)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture()
def clashing(docs):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("bl_host", "bl_lines", "bl_salt", "bl_salt_", "n", "rep", "component_id", "score", "bl_score", "line", "key", "kept", "grp", "ids", "start")})
