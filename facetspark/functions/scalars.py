"""Text, date, hash and rounding functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ARTICLES = "the|an|a"
_MARKS = "[\\p{M}]+"


@F.pandas_udf(StringType())
def _nfd(s: pd.Series) -> pd.Series:
    """Decomposed text; Spark has no function for it."""
    return s.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")


def fold(c):
    """Decompose, drop combining marks, lower-case, ``&`` to `` and `` (F1). Text of ASCII alone,
    nearly all of it, never leaves the JVM."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.lower(F.replace(F.when(plain, c).otherwise(F.regexp_replace(_nfd(F.when(~plain, c)), _MARKS, "")), F.lit("&"), F.lit(" and ")))


def fold_ascii(c):
    """:func:`fold` for text known to be ASCII."""
    return F.lower(F.replace(c, F.lit("&"), F.lit(" and ")))


def trigrams(c):
    """Distinct trigrams of a text without its white space (F2)."""
    s = F.regexp_replace(c, "\\s+", "")
    n = F.char_length(s)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3)))))


def name_key(c):
    """Words of letters and digits, lower-case, separated by one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def tight_key(c):
    """A name without anything but letters and digits (F3's other key)."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")


def without_article(c):
    return F.regexp_replace(c, f"^({ARTICLES}) ", "")


def title_similarity(a, b):
    """Of trigram sets: 1 if equal; else, with at least 0.6 of a's covered, 0.5 (0.5 coverage +
    0.5 Dice); else 0 (F6)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    cover = both / F.nullif(F.size(a), F.lit(0))
    dice = 2 * both / F.nullif(F.size(a) + F.size(b), F.lit(0))
    equal = F.array_sort(a) == F.array_sort(b)
    return F.when(equal, 1.0).when(cover >= 0.6, 0.5 * (0.5 * cover + 0.5 * dice)).otherwise(0.0)


def popularity(p, top: float = 50.0):
    return F.least(F.lit(1.0), F.log1p(p.cast("double")) / F.log1p(F.lit(top)))


def title_score(coverage, pop, exact, prefix):
    """0.6 coverage + 0.4 popularity, with a boost for an exact or a prefix match."""
    boost = F.when(exact, 0.5).when(prefix, 0.15).otherwise(0.0)
    return 0.6 * coverage + 0.4 * pop + boost * pop


# What may stand before or after a character's name.
STAGES = ["young", "younger", "old", "older", "teen", "teenage", "adult", "little", "baby", "kid", "child", "elderly", "middle aged", "the voice of", "voice of"]
HONORIFICS = ["dr", "mr", "mrs", "ms", "miss", "sir", "mister"]
ENDINGS = ["voice", "s voice", "narrator", "uncredited", "archive footage"]


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no function for it."""
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def character_name(c):
    """One character's name: notes in brackets dropped, marks and case folded, punctuation to spaces,
    a number at the end, then twice a word for an age, an honorific before and a word for a voice
    after it dropped (F28). Pure numbers and nothing become null."""
    return character_name_plain(_without_marks(c))


def _without_marks(c):
    """A text decomposed and without its marks; what is ASCII passes as it is."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, c).otherwise(F.regexp_replace(_nfkd(F.when(~plain, c)), _MARKS, ""))


def character_names(c):
    """All names of a credit, each once: marks and case folded, split at slashes and at hyphens between spaces."""
    parts = F.split(_without_marks(c), "/|(?<=\\s)-(?=\\s)")  # marks go first: no Python function runs within a lambda
    return F.array_distinct(F.filter(F.transform(parts, character_name_plain), lambda x: x.isNotNull()))


def character_name_plain(c):
    """:func:`character_name` for text without marks, which may stand within a lambda."""
    out = F.lower(F.regexp_replace(c, "\\([^)]*\\)|\\[[^\\]]*\\]", " "))
    out = F.trim(F.regexp_replace(F.replace(out, F.lit("'s voice"), F.lit("")), "[^\\p{L}\\p{N}_#]+", " "))
    out = F.regexp_replace(out, " ?# ?\\p{N}+$| \\p{N}+$", "")
    stages, honorifics, endings = "|".join(STAGES), "|".join(HONORIFICS), "|".join(sorted(ENDINGS, key=len, reverse=True))
    for _ in range(2):
        out = F.regexp_replace(F.regexp_replace(out, f"^({stages}) ", ""), f"^({honorifics}) ", "")
        out = F.regexp_replace(out, f" ({endings})$", "")
    out = F.trim(out)
    return F.when(out.rlike("^\\p{N}*$"), None).otherwise(out)


def percent_encoded(c):
    """Percent coding of all but unreserved characters (F30). Spark's own function codes forms: a space
    is a plus there, a tilde is coded and an asterisk is not."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decoded(c):
    """The text behind percent coding; a plus stays a plus."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def century(day):
    return F.ceil(F.year(day) / 100)


def partial_date(text):
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` to (first day, days); null if it is none."""
    n = F.char_length(text)
    ok = text.rlike("^\\d{4}(-\\d{2}(-\\d{2})?)?$")
    first = F.try_to_date(F.when(n == 4, F.concat(text, F.lit("-01-01"))).when(n == 7, F.concat(text, F.lit("-01"))).otherwise(text), "yyyy-MM-dd")
    last = F.when(n == 4, F.add_months(first, 12)).when(n == 7, F.add_months(first, 1)).otherwise(F.date_add(first, 1))
    return F.when(ok & first.isNotNull(), F.struct(first.alias("first"), F.datediff(last, first).alias("days")))


def source_mask(names, known: list[str]):
    """Names of sources to a bit mask."""
    out = F.lit(0)
    for i, k in enumerate(known):
        out = out.bitwiseOR(F.when(F.array_contains(names, k), 1 << i).otherwise(0))
    return out


def mask_names(mask, known: list[str]):
    return F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(known)]), lambda x: x.isNotNull())


def order_fingerprint(rows, group: list[str], place: str, column: str):
    """``fingerprint, n`` of each group's ordered ids: the sum, modulo 2^48, of 48 bits of the MD5 of
    every ``place:id`` (A24). A place is hashed with its id, so an id that moves changes the sum, which
    any order of adding gives; no list is ever collected."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", place, column)), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*group).agg((F.sum(part) % F.lit(2**48)).cast("bigint").alias("fingerprint"), F.count("*").alias("n"))


def entity_key(c):
    """The number that ``Q12``, ``q012`` and ``12`` name, as text; null for what names none."""
    digits = F.regexp_extract(c, "^\\s*[Qq]?0*([0-9]+)\\s*$", 1)
    return F.when(digits != "", digits)


def decade_key(c):
    """A year's decade, as text; null for what is no number."""
    year = F.regexp_extract(c, "^\\s*([0-9]{1,9})\\s*$", 1)
    return F.when(year != "", (F.floor(year.cast("bigint") / 10) * 10).cast("string"))


def label_key(c):
    """A label in lower case, its words one blank apart; null if it has none."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, "\\s+", " "))), F.lit(""))
