"""Normalizer cases worked out by hand, edit distances, and the native steps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sonoquery.functions import numbers, text

SPELLING = {"colour": "color", "realised": "realized", "theatre": "theater", "programme": "program"}
CASES = [
    ("MM hmm uh um mhm mmm", ""),
    ("mm", ""),
    ("He realised the COLOUR of the theatre programme.", "he realized the color of the theater program"),
    ("Mr. Smith and Dr. Jones met St. Paul's", "mister smith and doctor jones met saint paul is"),
    ("It cost $20 million and 5 percent", "it cost $20000000 5%"),
    ("twenty three thousand four hundred and fifty six", "23456"),
    ("one oh one", "101"),
    ("double oh seven", "007"),
    ("three point one four", "3.14"),
    ("The 1960s, the 274th, the 32nd", "the 1960s the 274th the 32nd"),
    ("I'd been there, she's gone, they'd done it", "i had been there she has gone they had done it"),
    ("won't can't let's ain't y'all wanna gotta gonna", "will not can not let us aint you all want to got to going to"),
    ("[laughter] some words (aside) more", "some words more"),
    ("naïve café résumé", "naive cafe resume"),
    ("1,234,567", "1234567"),
    ("two and a half million", "2500000"),
    ("minus five degrees", "-5 degrees"),
    ("twenty pounds and fifty cents", "£20.50"),
    ("ninety nine percent", "99%"),
    ("", ""),
    ("   ", ""),
    ("...", "."),
    ("A", "a"),
    ("THE QUICK BROWN FOX JUMPED OVER THE LAZY DOG", "the quick brown fox jumped over the lazy dog"),
    ("The cause seems superfluous on first sight.", "the cause seems superfluous on 1st sight"),
    ("kinda sorta dunno", "kinda sorta dunno"),
]


@pytest.mark.parametrize(("case", "wanted"), CASES)
def test_normalize(case, wanted):
    assert text.normalize(case, SPELLING) == wanted


@pytest.mark.parametrize(
    ("words", "wanted"),
    [
        ("eleven", "11"), ("twenty eleven", "2011"), ("one hundred eleven", "111"), ("nineteen twenty", "1920"), ("two thousands", "2000s"), ("twenty first", "21st"), ("nineteen eighties", "1980s"),
        ("one", "one"), ("ones", "ones"), ("negative two", "-2"), ("minus sign", "minus sign"), ("five per cent", "5%"), ("per hour", "per hour"), ("five per hour", "5 per hour"), ("three and four", "3 and 4"),
        ("triple nine", "999"), ("double trouble", "double trouble"), ("point taken", "point taken"), ("three point", "3 point"), ("point five", ".5"), ("zero point five", "0.5"), ("dollars", "dollars"), ("5 dollars", "$5"),
        ("one decillion", str(10**33)), ("1.5 million", "1500000"), ("$3 and ¢7", "$3.07"), ("sixes", "6s"),
    ],
)
def test_numbers(words, wanted):
    assert numbers.standardized(words) == wanted


def test_spelling_map_must_be_named():
    with pytest.raises(ValueError, match="spelling"):
        text.normalized(None, None)


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_word_errors():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert text.word_errors(a, b) == naive(a, b) == text.word_errors(b, a)
        assert text.word_errors(a, a) == 0


def test_native_steps_equal_the_whole_normalizer_without_numbers(spark):
    cases = ["I'd been there, she's gone", "won't can't ain't", "[x] some (y) more uh words", "Mr. Smith met St. Paul's", "naïve Straße café", "a ... b"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i").select(text.native(F.col("t"))).collect()]
    assert got == [text.normalize(c, {}) for c in cases]


def test_native_steps_equal_the_patterns_one_by_one(spark):
    """The Spark forms of the patterns against Python's, on texts full of openers, blanks and marks."""
    rng = random.Random(1)
    pieces = ["<", "[", ">", "]", "(", ")", "()", " ", "  ", "\t", "\n", " \n", "'", "'s", "'s been", "n't", "won't", "ma'am", "i'ma", "mr", "mrs", "st", "col", "um", "hum", "uh", "mhm", ".", "..", "!", ",", "1", "2,3", "%", "$", "a", "b c", "1 %", "wanna"]
    cases = ["".join(rng.choices(pieces, k=rng.randint(0, 24))) for _ in range(3000)]
    steps = [(re.compile(p), new) for p, new in (*text.BEFORE, (r"[^a-z0-9\s.%$]", " "), *text.AFTER)]
    wanted = []
    for case in cases:
        for pattern, new in steps:
            case = pattern.sub(new, case)
        wanted.append(case.strip(" "))
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.native(F.col("t")).alias("t")).orderBy("i")
    assert [r["t"] for r in rows.collect()] == wanted


def test_native_steps_on_long_runs_and_nulls(spark):
    """Time in proportion to the text: a quadratic pattern takes minutes on these."""
    n = 500_000
    rows = spark.createDataFrame([(0, "<" * n), (1, "(" * n), (2, "'" + " " * n + "a"), (3, "> ) <" + "[(" * n), (4, None), (5, "")], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(text.native(F.col("t"))).collect()]
    assert got == ["", "", "a", "", None, ""]


def test_arrow_functions_keep_nulls(spark):
    df = spark.createDataFrame([(None, None), ("Uh colour", "b c")], "a string, b string")
    rows = df.select(text.normalized(F.col("a"), SPELLING).alias("n"), text.edit_distance(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(None, None), ("color", 2)]
