import pytest


@pytest.fixture(scope="session")
def clash():
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        for c in ("k", "id", "rep", "h", "lo", "hi", "m", "doc", "host", "a", "b", "s", "key", "word", "n"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return add
