import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Builds a DataFrame from tuples and a DDL schema, spread over a few partitions."""

    def build(data, ddl, parts=3):
        return spark.createDataFrame(data, ddl).repartition(parts)

    return build
