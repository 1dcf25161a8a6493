import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
#: rows with nulls, blanks, ties, repeats and clashing extra columns
ODD = [(1, "one two three four five six", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", None, 4), (5, "one two three four five six", "en", "a", 3),
       (5, "one two three four five six", "en", "a", 3), (None, "no id at all here", "fr", "b", 9), (7, "ÄÖ é́ 漢字 word, 😀 x", "de", "b", 1), (8, "word " * 30_000, "en", "a", 150_000), (9, "one  two   three\nfour \n five\tsix", "en", "a", 2)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def clashing():
    """Adds columns whose names are those that an operator adds or uses inside, in other cases too."""
    from pyspark.sql import functions as F

    def add(df, *names):
        for n in names:
            df = df.withColumn(n, F.lit("clash"))
        return df
    return add
