"""Pipeline stages on tables whose other columns have names that need quoting, on nulls and on empty tables."""

import pytest

from tidemark.llm import quality_rules, secret_scan, simhash, toxicity

ODD = ["my col", "a-b", "a.b", "_row", "Text "]


def odd(spark):
    text = "the cat sat on the mat and looked at the moon for a very long while"
    rows = [(1, text, 7, "x", 1.5, 2, None), (2, text, 8, "y", None, 3, "t"), (3, "token = abcdefgh12345678 and the other words of this line are here to be read", 9, "z", 0.5, 4, "u"),
            (None, None, 1, "n", 0.0, 5, "v"), (4, "", 2, "e", 0.0, 6, "w"), (4, "", 2, "e", 0.0, 6, "w")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, `my col` int, `a-b` string, `a.b` double, `_row` int, `Text ` string")


STAGES = {"quality": quality_rules.apply_rules, "toxicity": lambda d: toxicity.drop_toxic(d, None), "near copies": simhash.one_of_each, "secrets": lambda d: secret_scan.redact(d, None)}


@pytest.mark.parametrize("name", STAGES)
def test_names_and_rows_stay(spark, name):
    df = odd(spark)
    out = STAGES[name](df)
    assert out.columns == df.columns
    kept = {tuple(r) for r in out.select("doc_id", "`a.b`", "`my col`").collect()}
    assert kept <= {tuple(r) for r in df.select("doc_id", "`a.b`", "`my col`").collect()}
    assert (1, 1.5, 7) in kept
    if name == "near copies":
        assert (2, None, 8) not in kept and (None, 0.0, 1) in kept
    assert STAGES[name](df.where("false")).collect() == []
