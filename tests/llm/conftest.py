import pytest
from pyspark.sql import types as T

#: Columns whose names an operator might use for itself.
CLASHING = ("score", "hits", "mix", "shard", "n_words", "n_tokens", "features", "spans", "hash", "group", "size", "target", "set_key", "part")

LONG = " ".join(f"word{i % 977} other{i % 131}" for i in range(60_000))
LINE = "Released under the MIT License."
BASE = [
    "The quick brown fox jumps over the lazy dog and then runs away from the barking dogs of the old farm house near a lake",
    "",
    "   \n\t ",
    "one",
    "All rights reserved. CC BY and cc-by! General Public License\nLicensed under CC BY-NC 4.0.",
    "x" * 1000,
    "é" * 900,
    LINE,
]


@pytest.fixture(scope="session")
def make_docs(spark):
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]

    def make(rows, extra=False):
        """rows: (doc_id, text, source)."""
        schema = T.StructType([T.StructField(n, t) for n, t in fields])
        data = [(i, t, None, s, None if t is None else len(t)) for i, t, s in rows]
        # a table on disk, as the operators read it: the same partitions each time
        df = spark.createDataFrame(data, schema).coalesce(3) if data else spark.createDataFrame([], schema)
        for name in CLASHING if extra else ():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("mine"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(BASE)]
    rows += [(100, None, "s1"), (None, BASE[0], "s1"), (None, None, None), (101, BASE[0], None), (101, BASE[0], None), (102, LONG, "s0"), (103, LONG, "s0")]
    return rows + [(104, BASE[0].replace("lazy", "idle"), "s2")]
