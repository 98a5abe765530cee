import random

from pyspark.sql import functions as F

from quire.functions import metadata as M, text as T

ODD = ["", " ", "a", "a  b\tc", " x y\x1cz ", "one\n\n\n\ntwo  \n", "x\r\ny\rz\x0bw v", "é é", "  lead and trail \n", "\n", "a\n", "12 34"]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["o"] for r in df.select("i", f(F.col("c")).alias("o")).orderBy("i").collect()]


def test_blanks_words_and_lines_are_those_of_python(spark):
    rng = random.Random(1)
    values = ODD + ["".join(rng.choice("ab \n\t\r \x1d\x85é") for _ in range(30)) for _ in range(60)]
    assert column(spark, values, T.word_count) == [len(v.split()) for v in values]
    assert column(spark, values, T.strip) == [v.strip() for v in values]
    assert column(spark, values, T.collapse) == [" ".join(v.split()) for v in values]
    assert column(spark, values, T.lines) == [v.splitlines() for v in values]


def test_null_stays_null(spark):
    for f in (T.word_count, T.strip, T.lines, T.normalise_text, T.line_key):
        assert column(spark, [None], f) == [None]


def test_normalise_text(spark):
    assert column(spark, ["é  \n\n\n\n b \r\nc\n"], T.normalise_text) == ["é\n\n b\nc"]


def test_letters_and_snippet(spark):
    assert column(spark, ["a1é 2b", ""], T.letter_count) == [3, 0]
    assert column(spark, ["a \n b" * 100], T.snippet)[0] == ("a b" * 100)[:120]


def test_years_in_names(spark):
    cases = {"exam_2023-24.pdf": "2023-24", "exam 2023_2024": "2023-24", "2023-25.pdf": None, "IS2425-p": "2024-25", "x9900": None, "a2526b2324": "2025-26", "12345678": None, "2023-25 2526": "2025-26", "no": None}
    assert column(spark, list(cases), M.year_from_filename) == list(cases.values())
    assert column(spark, ["2023-24", "2023-25", "1999-00", "23-24"], M.is_academic_year) == [True, False, True, False]


def test_folder_hints(spark):
    df = spark.createDataFrame([("s/exams/x/f.pdf",), ("s/f.pdf",), ("f.pdf",)], "p string")
    subject, kind, name = M.folder_hint(F.col("p"))
    assert [tuple(r) for r in df.select(subject, kind, name).collect()] == [("s", "exams", "f.pdf"), (None, None, "f.pdf"), (None, None, "f.pdf")]
