import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Columns of documents with others whose names clash with those that operators make.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id long, rank long, key string, n long, kept boolean, component string, size string, shard string"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def table(spark):
    """Rows (doc_id, text) as a documents table with clashing columns, over several partitions."""

    def make(rows, parts=3):
        wide = [(d, t, "en", f"s{(d or 0) % 3}", len(t) if t is not None else None, 7, 8, "k", 9, False, "c", "z", "q") for d, t in rows]
        return spark.createDataFrame(wide, CLASHING).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty and blank texts, few words, long texts without white space, ties, many bytes a character."""
    return [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "One TWO"), (905, "x" * 50_000), (906, "é" * 3_000), (907, "ab " * 9_000), (908, "a\0b   c\x85d"), (909, "😀 " * 400)]
