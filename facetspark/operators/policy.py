"""Eligibility policies, applied before anything is ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """``ceiling``: the oldest minimum age allowed; ``allow_unknown``: whether a title without
    an age passes; ``kids``: only titles made for children, or of a known low age."""

    ceiling: int = 18
    allow_unknown: bool = True
    kids: bool = False

    @staticmethod
    def parse(text: str) -> Policy:
        """``age=12,unknown=block,kids`` in any order."""
        ceiling, unknown, kids = 18, True, False
        for part in filter(None, (p.strip() for p in text.split(","))):
            k, _, v = part.partition("=")
            if k == "age":
                ceiling = max(0, min(18, int(v)))
            elif k == "unknown" and v in ("allow", "block"):
                unknown = v == "allow"
            elif k == "kids" and not v:
                kids = True
            else:
                raise ValueError(f"not a policy: {part!r}")
        return Policy(ceiling, unknown, kids)

    def __str__(self) -> str:
        return f"age={self.ceiling},unknown={'allow' if self.allow_unknown else 'block'}" + ",kids" * self.kids


def allowed(policy: Policy, age):
    return F.coalesce(age <= policy.ceiling, F.lit(policy.allow_unknown))


def kid_relevant(age, made_for, warning, floor: float = 0.5):
    """Made for children, or of a known age; a serious warning rules out what is not made for them."""
    child = F.coalesce(made_for >= floor, F.lit(False))
    return (child | age.isNotNull()) & ~(F.coalesce(warning >= floor, F.lit(False)) & ~child)


@dataclass(frozen=True)
class Hide:
    """What a viewer doesn't want to see: years before ``min_year``, genres, languages, anime."""

    min_year: int | None = None
    genres: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    anime: bool = False


def hidden(rules: Hide, adult, year, genres, language, series, composites: dict[str, tuple[str, ...]], animation: str, anime_language: str):
    """Is a title hidden (P16)? Adult ones always are; an unknown year or language hides nothing. A
    hidden composite genre also hides the series that carry one of its members."""
    known = lambda x: F.coalesce(x, F.lit(False))
    out = known(adult)
    if rules.min_year is not None:
        out = out | known(year < rules.min_year)
    if rules.genres:
        members = [m for g in rules.genres for m in composites.get(g, ())]
        out = out | known(F.arrays_overlap(genres, F.array(*[F.lit(g) for g in rules.genres])))
        if members:
            out = out | known(series & F.arrays_overlap(genres, F.array(*[F.lit(m) for m in members])))
    if rules.languages:
        out = out | known(F.lower(language).isin(*[x.lower() for x in rules.languages]))
    if rules.anime:
        out = out | known(F.array_contains(genres, animation) & (language == anime_language))
    return out


def newness(first, span, ended, ended_span, series, arriving, now, behind: int = 90, arrival_behind: int = 365, ahead: int = 30, dated: int = 31):
    """``title``, ``season`` or null: why a title is new (P18). A date is new if the middle of the span it
    may lie in is at most ``behind`` days ago (``arrival_behind`` for a film that has just arrived), or if
    it is due within ``ahead`` days and known to ``dated`` days. An older series is a new season if its end
    is new, or if it has arrived and no end is on record."""

    def within(day, days, back):
        gone = F.datediff(now, day)
        return F.coalesce(F.when(gone < 0, (days <= dated) & (-gone <= ahead)).otherwise(gone - days / 2 <= back), F.lit(False))

    back = F.when(~series & arriving, arrival_behind).otherwise(behind)
    season = F.when(ended.isNotNull(), within(ended, ended_span, F.lit(behind))).otherwise(first.isNotNull() & arriving)
    return F.when(within(first, span, back), "title").when(series & season, "season")


def folded_genres(titles: DataFrame, folds: dict[str, tuple[str, ...]]) -> DataFrame:
    """titles (media, id, genre) with series' genres as those of films they stand for (P14): a genre that
    stands for several gives a row each, one that stands for none stays."""
    table = F.create_map(*[x for g, to in folds.items() for x in (F.lit(g), F.array(*[F.lit(t) for t in to]))])
    to = F.when(F.col("media") == 1, F.coalesce(F.try_element_at(table, F.col("genre")), F.array("genre"))).otherwise(F.array("genre"))
    return titles.withColumn("genre", F.explode(to))
