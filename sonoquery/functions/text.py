"""Text normalization and word errors.

:func:`native` covers the steps that are regular expressions as a Column (Latin
letters); :func:`normalized` is the whole normalizer as a vectorized Arrow function.
The spelling map is an input: none is part of the library, and a call must name
one or say that there is none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache, reduce
from itertools import groupby
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers

# Fillers and rewrites of spoken English, applied in this order.
FILLERS = ("hmm", "mm", "mhm", "mmm", "uh", "um")
REWRITES = (
    # common contractions
    (r"\bwon't\b", "will not"),
    (r"\bcan't\b", "can not"),
    (r"\blet's\b", "let us"),
    (r"\bain't\b", "aint"),
    (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"),
    (r"\bgotta\b", "got to"),
    (r"\bgonna\b", "going to"),
    (r"\bi'ma\b", "i am going to"),
    (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"),
    (r"\bcoulda\b", "could have"),
    (r"\bshoulda\b", "should have"),
    (r"\bma'am\b", "madam"),
    # titles
    (r"\bmr\b", "mister "),
    (r"\bmrs\b", "missus "),
    (r"\bst\b", "saint "),
    (r"\bdr\b", "doctor "),
    (r"\bprof\b", "professor "),
    (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "),
    (r"\bald\b", "alderman "),
    (r"\bgen\b", "general "),
    (r"\bsen\b", "senator "),
    (r"\brep\b", "representative "),
    (r"\bpres\b", "president "),
    (r"\brev\b", "reverend "),
    (r"\bhon\b", "honorable "),
    (r"\basst\b", "assistant "),
    (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "),
    (r"\bcol\b", "colonel "),
    (r"\bjr\b", "junior "),
    (r"\bsr\b", "senior "),
    (r"\besq\b", "esquire "),
    # perfect tenses
    (r"'d been\b", " had been"),
    (r"'s been\b", " has been"),
    (r"'d gone\b", " had gone"),
    (r"'s gone\b", " has gone"),
    (r"'d done\b", " had done"),
    (r"'s got\b", " has got"),
    # general contractions
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'s\b", " is"),
    (r"'d\b", " would"),
    (r"'ll\b", " will"),
    (r"'t\b", " not"),
    (r"'ve\b", " have"),
    (r"'m\b", " am"),
)
# Letters that don't decompose.
LETTERS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}

KEPT = ".%$¢€£"

# Patterns that results depend on.
#: Steps before symbols are stripped: (pattern, replacement), the same for Java, Python and RE2 on ASCII letters.
BEFORE: tuple[tuple[str, str], ...] = (
    (r"[<\[][^>\]]*[>\]]", ""),
    (r"\(([^)]+?)\)", ""),
    (r"\b(" + "|".join(FILLERS) + r")\b", ""),
    (r"\s+'", "'"),
    *REWRITES,
    (r"(\d),(\d)", r"\1\2"),
    (r"\.([^0-9]|$)", r" \1"),
)
#: Steps after numbers and spellings.
AFTER: tuple[tuple[str, str], ...] = ((r"[.$¢€£]([^0-9])", r" \1"), (r"([^0-9])%", r"\1 "), (r"\s+", " "))


# Patterns that give what those above give, without starting anew at each opener, blank or end of a word.
LINEAR = {
    r"[<\[][^>\]]*[>\]]": (r"[<\[][^>\]]*+[>\]]|([<\[][^>\]]*+\z)", "$1"),
    r"\(([^)]+?)\)": (r"\([^)]++\)|(\([^)]*+\z)", "$1"),
    r"\b(" + "|".join(FILLERS) + r")\b": (r"(?=[hmu])\b(?:" + "|".join(FILLERS) + r")\b", ""),
    r"\s+'": (r"(?<!\s)\s++'", "'"),
    r"\s+": (r"[\t\n\x0B\f\r]\s*+| \s++", " "),
}
#: What a text must contain, one of them, for a pattern to be found in it; rewrites need their own letters.
NEEDED = {
    r"[<\[][^>\]]*[>\]]": "<[",
    r"\(([^)]+?)\)": "(",
    r"\s+'": "'",
    r"(\d),(\d)": ",",
    r"\.([^0-9]|$)": ".",
    r"[.$¢€£]([^0-9])": ".$¢€£",
    r"([^0-9])%": "%",
} | {pattern: (pattern.replace(r"\b", ""),) for pattern, _ in REWRITES}


def _java(pattern: str, new: str) -> tuple[str, str]:
    """Pattern and replacement for Spark; a word is looked for by its letters before its start is checked."""
    if pattern in LINEAR:
        return LINEAR[pattern]
    word = re.fullmatch(r"\\b([a-z']+)\\b", pattern)
    if word:
        pattern = rf"{word[1]}\b(?<=\b{word[1]})"
    return pattern, re.sub(r"\\(\d)", r"$\1", new)


def _step(pattern: str, new: str) -> Callable[[Column], Column]:
    java, needed = _java(pattern, new), NEEDED.get(pattern)

    def step(t: Column) -> Column:
        done = F.regexp_replace(t, *java)
        return F.when(reduce(or_, map(t.contains, needed)), done).otherwise(t) if needed else done

    return step


def replaced(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """``text`` after all steps.  A step, or a run of steps on apostrophes, scans only texts that contain what it needs.

    Each step takes the text as the element of an array, so that the plan has it once.
    """
    one = F.array(text)
    for apostrophes, group in groupby(steps, lambda step: all("'" in x for x in NEEDED.get(step[0], [""]))):
        own = [_step(*step) for step in group]
        if apostrophes:
            one = F.transform(one, lambda t: F.when(t.contains("'"), F.get(reduce(F.transform, own, F.array(t)), F.lit(0))).otherwise(t))  # noqa: B023
        else:
            one = reduce(F.transform, own, one)
    return F.get(one, F.lit(0))


def _folded_letters() -> tuple[str, str]:
    """Latin letters of one mark or more, and the ASCII letters they are made of."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and b[0].isalpha() and all(unicodedata.category(c) == "Mn" for c in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def native(text: Column) -> Column:
    """The regular steps on text in Latin letters, without numbers and spellings.

    Marks are taken off first, so that word boundaries are those of ASCII.
    """

    def folded(t: Column) -> Column:
        done = F.lower(F.translate(t, *_folded_letters()))
        for letter, new in LETTERS.items():
            if letter.islower():
                done = F.replace(done, F.lit(letter), F.lit(new))
        return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(done)

    # one blank for a run of marks is enough: the last step makes runs of blanks one
    return F.trim(replaced(F.get(F.transform(F.array(text), folded), F.lit(0)), (*BEFORE, (r"[^a-z0-9\s.%$]+", " "), *AFTER)))


def native_sql(column: str) -> str:
    """DuckDB SQL of :func:`native`."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sql = "lower(translate({}, {}, {}))".format(column, *map(quoted, _folded_letters()))
    for letter, new in LETTERS.items():
        if letter.islower():
            sql = f"replace({sql}, {quoted(letter)}, {quoted(new)})"
    for pattern, new in (*BEFORE, (r"[^a-z0-9\s.%$]", " "), *AFTER):
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"trim({sql}, ' ')"


@lru_cache(maxsize=1)
def _compiled() -> tuple[list, list]:
    return [(re.compile(p), r) for p, r in BEFORE], [(re.compile(p), r) for p, r in AFTER]


def stripped(text: str, keep: str = KEPT) -> str:
    """Letters without diacritics; a space for each other mark, symbol or punctuation."""
    out = []
    for c in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(c)
        if c in keep:
            out.append(c)
        elif c in LETTERS:
            out.append(LETTERS[c])
        elif kind != "Mn":
            out.append(" " if kind[0] in "MSP" else c)
    return "".join(out)


def normalize(text: str, spelling: Mapping[str, str]) -> str:
    """The whole normalizer on one text."""
    before, after = _compiled()
    text = text.lower()
    for pattern, new in before:
        text = pattern.sub(new, text)
    words = numbers.standardized(stripped(text)).split()
    text = " ".join(spelling.get(w, w) for w in words)
    for pattern, new in after:
        text = pattern.sub(new, text)
    return " ".join(text.split())


def normalized(text: Column, spelling: Mapping[str, str] | None) -> Column:
    """Normalized text; ``spelling`` maps words, ``{}`` says that no map is wanted."""
    if spelling is None:
        raise ValueError("name a spelling map, or {} for none")
    spelling = dict(spelling)

    def work(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize(t, spelling) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(work, "string")(text)


def word_errors(reference: Sequence[str], hypothesis: Sequence[str]) -> int:
    """Word-level edit distance, a column of the table at a time in the bits of integers."""
    n = len(reference)
    if not n:
        return len(hypothesis)
    places: dict[str, int] = {}
    for i, word in enumerate(reference):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << n - 1
    up, down, errors = full, 0, n
    for word in hypothesis:
        same = places.get(word, 0)
        diagonal = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        errors += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(diagonal | rise) & full, rise & diagonal
    return errors


def edit_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two ``array<string>``; null if one is null."""

    def work(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else word_errors(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(work, "bigint")(reference, hypothesis)


def tokens(text: Column) -> Column:
    """Words between white space, none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def respelled(words: Column, spelling: Column) -> Column:
    """Words through a ``map<string,string>``; others stay."""
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(spelling, w), w))


def room_type(description: Column) -> Column:
    return F.regexp_replace(description, r"\d+$", "")


def room_description(room: Column) -> Column:
    return F.regexp_replace(room, r"_idx_\d+$", "")
