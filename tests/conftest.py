import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans are read as text
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Sparse records as a DataFrame of texts; a missing key is NULL, row ids stay numbers."""
    def build(*records):
        names = list(dict.fromkeys(k for r in records for k in r))
        kinds = ", ".join(f"`{n}` {'bigint' if n == '_Row' else 'string'}" for n in names)
        data = [tuple(None if r.get(n) is None else (r[n] if n == "_Row" else str(r[n])) for n in names) for r in records]
        return spark.createDataFrame(data, kinds)
    return build
