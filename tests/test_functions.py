import pytest
from pyspark.sql import functions as F

from termweave.functions import dates, numbers, text


def values(spark, f, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_dates(spark):
    given = ["20240131", "20240231", "18991231", "2024-1-2", "2024/01/02", "02-01-2024", "02/01/2024", "2024-13-01", "2024-01-01 00:00:00", "2024-02-31", "", "NULL", None, "nan", " 20240131 "]
    want = ["20240131", "20240231", None, "20240102", "20240102", "20240102", "20240102", None, None, None, None, None, None, None, "20240131"]
    assert values(spark, dates.normalize_date, *given) == want


def test_null_tokens(spark):
    assert values(spark, text.null_if, "", "None", "NA", "nan", "  ", " a ", None) == [None, None, "NA", None, None, "a", None]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (text.normalize_query, ["\t A b\n", None], ["a b", None]),
        (text.entity_alias, ["Glucose (24)", "(x)", "a (b) (c)", "a(b) c"], ["Glucose", "(x)", "a (b)", "a(b) c"]),
        (text.normalize_concept, ["Name A (12) ", " Plain ", "x (y)"], ["name a(12)", "plain", "x (y)"]),
        (text.parse_concept_id, ["12.0", " 7 ", "x", None], ["12", "7", None, None]),
        (text.strip_fence, ['```json\n{"a": 1}\n```', '{"a": 1}', "```\nx\n```"], ['{"a": 1}', '{"a": 1}', "x"]),
        (text.split_synonyms, ["a; b/a / c;;", None], [["a", "b", "c"], None]),
        (text.tokens, ["Straße 24-h, Été!", ""], [["straße", "24", "h", "été"], []]),
        (text.ngrams, ["abcdef xy"], [["abcd", "bcde", "cdef", "abcde", "bcdef"]]),
        (text.null_display, ["", " ", None, " a "], ["NULL", "NULL", "NULL", "a"]),
    ],
)
def test_text(spark, f, given, want):
    assert values(spark, f, *given) == want


def test_least_matches(spark):
    assert values(spark, text.least_matches, 1, 2, 3, 5, 10, kind="int") == [1, 1, 1, 3, 6]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(numbers.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 2**-0.5) < 1e-12 and got[1:] == [None, None, None]
    assert values(spark, numbers.vector_of, "[1, 2.5]", "x") == [[1.0, 2.5], None]


def test_numbers(spark):
    assert values(spark, numbers.confidence, 0.95, 0.85, 0.7, 0.5, 0.49, kind="double") == ["very_high", "high", "medium", "low", "very_low"]
    assert values(spark, lambda c: numbers.or_else(c, F.lit(9.0)), 0.0, 1.0, None, kind="double") == [9.0, 1.0, 9.0]
    assert values(spark, numbers.sigmoid, 3.0, kind="double") == [0.5]


def test_template(spark):
    assert values(spark, lambda c: text.fill_template('{name}: {"a": 1} {name}', name=c), "x", None) == ['x: {"a": 1} x', ': {"a": 1} ']


def test_template_values_are_not_filled_again(spark):
    assert values(spark, lambda c: text.fill_template("{a} {b}", a=c, b=F.lit("x")), "{b}") == ["{b} x"]
