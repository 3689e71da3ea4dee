import pytest
from pyspark.sql import functions as F

AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "no id here at all, none"),
    (6, "word " * 30000), (7, "\x00\x01 odd bytes ﻿ \U0001f600"), (8, "Licensed under CC BY-NC 4.0."), (9, "a b c d e f g h i j k l m n"), (10, "A B C D E F G H I J K L M N"),
]


@pytest.fixture
def awkward(spark):
    """Nulls, blanks, ties, repeated rows, a very long text, and columns whose names operators also use."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    extra = {"lang": None, "source": "s", "n_chars": None, "score": 1.0, "kept": False, "ids": "x", "sig": "x", "g": 3, "n": 1, "label": "l", "quality": 2, "_id": 1, "y": 0, "h": 1, "guest": True, "_kept_id": 5}
    return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


@pytest.fixture
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, 1, 0), (10, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
