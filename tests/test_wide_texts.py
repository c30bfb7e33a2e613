"""Queries on whole texts make each pass over a text once."""

from palimpsest import registry
from palimpsest.functions import text as T


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_of_a_text_are_kept_once(spark, sf):
    assert optimized(registry.queries()["T35_script_family"](spark, sf)).count("p{L}") == 1


def test_script_needs_four_fifths_of_the_letters(spark):
    rows = [("abcd я", "latin"), ("abc яя", "mixed"), ("яяяя a 12", "cyrillic"), ("12 ?!", "unknown"), ("", "unknown")]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", T.script_family(T.F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
