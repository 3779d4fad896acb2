"""Arrow functions that hold little: NFC and model calls."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from hexapla.functions import text as tx
from hexapla.operators.providers import Providers


def test_nfc_copies_only_what_it_changes():
    texts = ["plain", None, "é", "é", "", "x" * 9 + "̈́"]
    s = pa.array(texts)
    assert tx.nfc.func(s).to_pylist() == [None if x is None else unicodedata.normalize("NFC", x) for x in texts]
    same = pa.array(["plain", None, "é"])
    assert tx.nfc.func(same) is same


def test_model_calls_take_nulls_and_give_lists(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    p = Providers()
    got = rows.select("i", p.chat(lambda x: None if x is None else x + "!", F.col("t")).alias("c"), p.embedding(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.c for r in got] == ["a!", None] and [len(r.v) for r in got] == [64, 64]
