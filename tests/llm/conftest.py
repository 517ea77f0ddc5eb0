import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def given(sf_dir):
    """(doc_id, text, lang, source) of the given documents."""
    sql = f"select doc_id, text, lang, source from '{sf_dir}/documents.parquet' order by doc_id"
    return duckdb.connect().execute(sql).fetchall()
