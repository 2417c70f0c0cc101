import pytest

CLASH = {"score": 7, "_row": 1, "sig": "x", "digest": 3, "lang_pred": "q", "size": 9}


@pytest.fixture(scope="session")
def with_clashes():
    """Adds columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items() if k not in df.columns])
