"""Text rules on columns.

Normalising goes through Python many texts at a time; the rest is built-in expressions, some with a twin on
lists of words for rows that are in Python anyway.  Patterns are the fixed values that decide what counts as
unrelated text in an answer line.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values -----------------------------------------------------------
ROMAN_NUMERALS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]

STOP_WORDS = (
    "the a an of in on at to for and or is was are were be by with as that this it its from his her their who which what"
).split()

TITLES = ["sir", "dr", "mr", "mrs", "ms", "prof", "professor", "lord", "lady", "dame", "the", "a", "an", "saint", "st", "jr", "sr"]

FUNCTION_WORDS = """
i me my mine you your yours he him his she her hers it its we us our ours they them their theirs myself yourself himself herself itself
ourselves themselves this that these those here there the a an and or but nor of to in on at for from by with as into onto than
is am are was were be been being do does did has have had will would shall should can could may might must not no yes ok okay
what who whom whose which when where why how
""".split()

KIN_RELATIONS = ["father", "mother"]

AROUND_NAMES = " .\"'"

EMPTY_REPLIES = ["no", "none", "nobody", "nothing"]

LEAK_PATTERN = r"(?iU)question:|answer:|direct answer|\buser:|\bassistant:"
WEB_PATTERN = (
    r"Take the 2-minute tour|You are here|Skip to main content|The Interview Process|The Executive Committee"
)
MATH_PATTERN = r"(?U)What is the (?:sum|value|product)|equation|\$|\bSolve\b|\bFind the\b"
MATH_PARTS = ["What is the ", "equation", "$", "Solve", "Find the"]
GLUED_WORDS = "What|Who|Which|When|Where|How|The|This|It|In|You|Take|Skip|Find|Let|Solve|Question|Answer"
GLUED_PATTERN = rf"(?U)[a-z0-9)][.!?](?=(?:{GLUED_WORDS})\b)"
GLUED_PARTS = [".", "!", "?"]
REFUSAL_PATTERN = (
    r"\b(not specified|no information|not provided|not mentioned|don t know|do not know|unknown|cannot|can t|unclear|no answer|"
    r"not available|not given|not known|not sure|there is no|n a|not explicitly|not stated|not named|not recognized|not a real|not identified)\b"
)

_STOP_SET, _STOP_TITLE_SET, _FUNCTION_SET = (frozenset(x) for x in (STOP_WORDS, STOP_WORDS + TITLES, FUNCTION_WORDS))
_REFUSAL_STARTS = frozenset(x.split()[0] for x in REFUSAL_PATTERN.removeprefix(r"\b(").removesuffix(r")\b").split("|"))

# every character a Unicode-aware strip removes
_SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


# ---- trimming and normalising ----------------------------------------------
def strip_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}+", ""), rf"{_SPACE}+\z", "")


def first_line(text: Column) -> Column:
    """Leading white space of any kind off, cut at the first line feed, strip."""
    started = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SPACE}+", "")
    return strip_space(F.substring_index(started, "\n", 1))


_SEPARATOR = "\x1f"  # never part of a normalised text
_TOGETHER = 1 << 18  # characters normalised at a time


@cache
def _kept() -> np.ndarray:
    """What normalising makes of a character: itself, nothing (0) of a combining mark, a line feed of the separator, else a blank."""
    kept = np.full(0x110000, ord(" "), np.uint8)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        kept[ord(c)] = ord(c)
    kept[[i for i in range(len(kept)) if unicodedata.combining(chr(i))]] = 0
    kept[ord(_SEPARATOR)] = ord("\n")
    return kept


def _lines(texts: pa.Array) -> str:
    """The texts, none of them missing, with a separator between them that none of them holds."""
    def joined(x: pa.Array) -> str:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), _SEPARATOR)[0].as_py()

    lines = joined(texts)
    return lines if lines.count(_SEPARATOR) < len(texts) else joined(pc.replace_substring(texts, _SEPARATOR, " "))


def _normalised_together(texts: pa.Array) -> pa.Array:
    low = _lines(texts).lower()
    if low.isascii():
        plain = np.frombuffer(low.encode().translate(_kept()[:256].tobytes()), np.uint8)
    else:  # neither lower case nor decomposition looks past the separator
        plain = _kept()[np.frombuffer(unicodedata.normalize("NFKD", low).encode("utf-32-le"), np.uint32)]
        plain = plain[plain != 0]
    blank = plain == ord(" ")
    plain = plain[~(blank & np.concatenate([[True], (blank | (plain == ord("\n")))[:-1]]))]
    plain = plain[~((plain == ord(" ")) & np.concatenate([plain[1:] == ord("\n"), [True]])[:len(plain)])]
    feed = plain == ord("\n")
    ends = np.flatnonzero(feed) - np.arange(len(texts) - 1)
    plain = plain[~feed]
    starts = np.concatenate([[0], ends, [len(plain)]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(starts), pa.py_buffer(plain))


def normalised(texts: pa.Array) -> pa.Array:
    """Normalised form of each text, a missing one taken as empty; some characters at a time."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // _TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
    return pa.concat_arrays([pa.array([], pa.string()), *(_normalised_together(texts.slice(i, j - i)) for i, j in zip(cuts, cuts[1:]))])


def words_of(normalised_texts: pa.Array) -> list[list[str]]:
    return [t.split() for t in normalised_texts.to_pylist()]


@F.arrow_udf(StringType())
def _normalised(texts: pa.Array) -> pa.Array:
    return normalised(texts)


def normalise(text: Column) -> Column:
    """Comparable form, a-z 0-9 and single spaces only.

    Lower case, compatibility decomposition, combining marks dropped, everything else a blank.
    """
    return _normalised(text)


def words(normalised: Column) -> Column:
    """Words of a normalised text; no words for an empty one."""
    return F.filter(F.split(normalised, " "), lambda w: w != "")


# ---- unrelated text ---------------------------------------------------------
def bind(value: Column, body) -> Column:
    """``body(v)`` with ``v`` computed once per row, however often ``body`` uses it.

    A column used inside a lambda is computed again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeats(ordered: Column, times: int) -> Column:
    """Whether a sorted array holds some value ``times`` times: compare at a distance."""
    last = F.size(ordered) - times
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.get(ordered, i) == F.get(ordered, i + (times - 1)))


def is_looping(normalised: Column) -> Column:
    """A word pair three times or a longer content word four times, in four words or more.

    Sorting the pairs and the words keeps this n log n on texts of any length.
    """
    def pairs_of(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))

    def check(w: Column) -> Column:
        longer = F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS))
        return bind(F.sort_array(pairs_of(w)), lambda s: _repeats(s, 3)) | bind(F.sort_array(longer), lambda s: _repeats(s, 4))

    return bind(words(normalised), lambda w: (F.size(w) >= 4) & check(w))


def loops(w: Sequence[str]) -> bool:
    """G02 on the words of one text; most texts repeat too few words to be counted."""
    if len(w) < 4 or len(w) - len(set(w)) < 2:
        return False
    return max(Counter(zip(w, w[1:])).values()) >= 3 or any(n >= 4 and len(x) >= 3 and x not in _STOP_SET for x, n in Counter(w).items())


def _holds(text: Column, parts: Sequence[str]) -> Column:
    hit = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def _length_before(text: Column, pattern: str, parts: Sequence[str]) -> Column:
    """Characters before the first match; every match holds one of ``parts``, which are found without a pattern."""
    before = F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)
    return F.when(_holds(text, parts) & text.rlike(pattern), F.length(before))


def continuation_start(text: Column) -> Column:
    """Characters kept before unrelated text starts, NULL when there is none.

    A glued sentence counts from after its full stop, the two others from their first character.
    """
    return F.least(
        _length_before(text, WEB_PATTERN, WEB_PATTERN.split("|")),
        _length_before(text, MATH_PATTERN, MATH_PARTS),
        _length_before(text, GLUED_PATTERN, GLUED_PARTS) + 2,
    )


def has_leak(text: Column) -> Column:
    """A prompt or chat marker inside the answer.

    All markers but one hold a colon; letters beyond ASCII may stand for ASCII ones where case is ignored.
    """
    possible = F.contains(text, F.lit(":")) | F.contains(F.lower(text), F.lit("direct answer")) | (F.octet_length(text) != F.char_length(text))
    return possible & text.rlike(LEAK_PATTERN)


def junk_kind(text: Column, normalised: Column, looping: Column | None = None) -> Column:
    """Leak, loop, continuation, or NULL, in that order; ``looping`` is G02 where it is known already."""
    return (
        F.when(has_leak(text), "leak")
        .when(is_looping(normalised) if looping is None else looping, "loop")
        .when(continuation_start(text).isNotNull(), "continuation")
    )


# ---- answer shape -----------------------------------------------------------
def numerals(normalised: Column) -> Column:
    """The regnal numerals of a text, as a comparable sorted set."""
    known = F.array(*[F.lit(x) for x in ROMAN_NUMERALS])
    return F.sort_array(F.array_intersect(words(normalised), known))


def numeral_bits(normalised_texts: pa.Array) -> np.ndarray:
    """The regnal numerals of each text, a bit for each."""
    lines = np.frombuffer(_lines(normalised_texts).encode("ascii") + b" " * 8, np.uint8)
    apart = lines <= ord(" ")
    first = np.flatnonzero(np.isin(lines[1:], [ord(c) for c in "ivx"]) & apart[:-1]) + 1
    first = np.concatenate([[0], first]) if len(first) == 0 or first[0] != 0 else first
    found, open_word, key = np.zeros(len(normalised_texts), np.int64), np.ones(len(first), bool), np.zeros(len(first), np.int64)
    for k in range(5):  # the longest numeral has four letters
        open_word &= ~apart[first + k]
        key = np.where(open_word, key * 256 + lines[first + k], key)
    row = np.searchsorted(np.flatnonzero(lines == ord(_SEPARATOR)), first)
    for bit, numeral in enumerate(ROMAN_NUMERALS):
        hit = key == int.from_bytes(numeral.encode())
        np.bitwise_or.at(found, row[hit], 1 << bit)
    return found


def sorted_words(normalised: Column) -> Column:
    """Words in order, joined again."""
    return F.array_join(F.sort_array(words(normalised)), " ")


def is_refusal(normalised: Column) -> Column:
    """C02 on a normalised head: a short refusal, or an empty reply."""
    short = (normalised != "") & (F.size(words(normalised)) <= 14)
    return short & (normalised.rlike(REFUSAL_PATTERN) | normalised.isin(EMPTY_REPLIES))


def refuses(w: Sequence[str]) -> bool:
    """C02 on the words of one head."""
    if not 0 < len(w) <= 14:
        return False
    head = " ".join(w)
    return head in EMPTY_REPLIES or (not _REFUSAL_STARTS.isdisjoint(w) and re.search(REFUSAL_PATTERN, head) is not None)


def is_invalid_shape(normalised: Column) -> Column:
    """Digits only, one character, or one function word."""
    solid = F.replace(normalised, F.lit(" "), F.lit(""))
    return (normalised != "") & (
        solid.rlike("^[0-9]+$") | (F.length(solid) == 1) | normalised.isin(FUNCTION_WORDS)
    )


def has_invalid_shape(w: Sequence[str]) -> bool:
    """C06 on the words of one text."""
    solid = "".join(w)
    return solid.isdigit() or len(solid) == 1 or (len(w) == 1 and solid in _FUNCTION_SET)


def content_words(normalised: Column) -> Column:
    """Words that are neither stop words nor titles."""
    return F.filter(words(normalised), lambda w: ~w.isin(STOP_WORDS + TITLES))


def content_of(w: Sequence[str]) -> list[str]:
    """C07 on the words of one text."""
    return [x for x in w if x not in _STOP_TITLE_SET]


def bare_name(text: Column) -> Column:
    """The answer without surrounding blanks, full stops and quotes."""
    return F.btrim(text, F.lit(AROUND_NAMES))


def raw_word_count(text: Column) -> Column:
    """Words between white space of any kind, on the text as written."""
    stripped = strip_space(text)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, f"{_SPACE}+")))


def spelling_variants(name: Column) -> Column:
    """As written, lower case, and first letter upper with the rest lower; distinct, in that order."""
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 2**31 - 1)))
    return F.array_distinct(F.array(name, F.lower(name), capital))
