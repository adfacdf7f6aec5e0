"""Text column expressions: cleaning, the conservative name key, word rules, name shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space besides the plain blank, no-break and
# other Unicode spaces included.
SPACES = ("\t\n\x0b\x0c\r\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
          + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# Fixed values of the name key: the abbreviation folds and the punctuation that becomes a space.
# Company suffixes are kept on purpose.
FOLDS = {"LTD": "LIMITED", "INCORPORATED": "INC"}
PUNCTUATION = ".,'\u2019\"()-/"


def _blanks(x: Column, characters: str) -> Column:
    """Turn the characters into blanks, collapse every run of blanks and trim.

    One table lookup a character; the pattern then looks at runs of blanks alone, which is
    several times cheaper than one large character class.
    """
    plain = F.translate(x, characters, " " * len(characters))
    return F.trim(F.regexp_replace(plain, "  +", " "))


def clean_spaces(x: Column) -> Column:
    """Collapse every run of white space, no-break spaces included, and trim."""
    return _blanks(x, SPACES)


def without_spaces(x: Column) -> Column:
    return F.translate(x, " " + SPACES, "")


def whole_words(words: Sequence[str]) -> str:
    """A pattern that finds any of ``words`` as a whole ASCII word (in upper-case text)."""
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])"


def name_key(x: Column, folds: Mapping[str, str] = FOLDS) -> Column:
    """Upper-case key of a name: & spelt out, folds applied, punctuation dropped, spaces single.

    A fold costs a plain search on the rows that do not have the word at all.
    """
    key = F.replace(F.upper(x), F.lit("&"), F.lit(" AND "))
    for word, short in folds.items():
        key = F.when(key.contains(word), F.regexp_replace(key, whole_words([word]), short)).otherwise(key)
    return _blanks(key, SPACES + PUNCTUATION)


def personal_shape(key: Column, not_words: Sequence[str] = (), joiner: str = " AND ",
                   max_words: int = 4, max_letters: int = 15, max_parts: int = 3) -> Column:
    """Does a name key look like a person, or like a few persons joined by AND?

    No word of ``not_words`` and no digit; two to ``max_words`` bare words of at
    most ``max_letters`` letters, or up to ``max_parts`` joined parts of one word or more.
    """
    word = f"[A-Z']{{1,{max_letters}}}"
    single = f"^{word}( {word}){{1,{max_words - 1}}}$"
    part = f"^ *{word}( +{word}){{0,{max_words - 1}}} *$"
    parts = F.split(key, joiner)
    joined = (F.size(parts) <= max_parts) & F.forall(parts, lambda p: p.rlike(part))
    shape = F.when(key.contains(joiner), joined).otherwise(key.rlike(single))
    clean = (key != "") & ~key.rlike("[0-9]")
    if not_words:
        clean = clean & ~key.rlike(whole_words(not_words))
    return F.coalesce(clean & shape, F.lit(False))


def first_rule(key: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Class of the first rule whose pattern is found in ``key``; the order of rules decides."""
    if not rules:
        return F.lit(default)
    chain = F
    for pattern, name in rules:
        chain = chain.when(key.rlike(pattern), F.lit(name))
    return chain.otherwise(F.lit(default))


def ordered_code(x: Column, levels: Sequence[str]) -> Column:
    """0 for the first level, 1 for the second, ...; len(levels) for anything else."""
    code = F.lit(len(levels))
    for i, level in reversed(list(enumerate(levels))):
        code = F.when(x == level, F.lit(i)).otherwise(code)
    return code


def any_contains(columns: Sequence[Column], piece: str) -> Column:
    """True when any of the columns contains ``piece``; missing columns do not count."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.contains(piece), F.lit(False)) for c in columns])
