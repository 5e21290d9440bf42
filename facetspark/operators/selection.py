"""The selection grammar and what a selection means for a title.

``[-]kind:id[|id...]`` items, separated by commas, are all required. Values of one item are
alternatives. An excluded item (``-``) asks for titles known not to carry any of its values:
a title with nothing on record for the kind satisfies neither the value nor its exclusion.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_VALUES, MAX_BYTES = 16, 2048
KEY = ["media", "id"]


@dataclass(frozen=True)
class Kind:
    """``single``: picks of the kind replace each other, so its own picks don't narrow its
    counts; otherwise they add up and only positive groups are left out of its own counts."""

    name: str
    single: bool = False
    normal: Callable[[str], str] = str.strip


@dataclass(frozen=True, order=True)
class Item:
    kind: str
    exclude: bool
    ids: tuple[str, ...]

    def __str__(self) -> str:
        return f"{'-' if self.exclude else ''}{self.kind}:{'|'.join(self.ids)}"


def whole_number(s: str) -> str:
    return str(int(s))


def decade(s: str) -> str:
    return str(int(s) // 10 * 10)


def entity_id(s: str) -> str:
    """``Q12`` and ``12`` name the same entity."""
    m = re.fullmatch(r"\s*[Qq]?(\d+)\s*", s)
    if not m:
        raise ValueError(f"not an entity: {s!r}")
    return str(int(m[1]))


def parse(text: str, kinds: dict[str, Kind]) -> list[Item]:
    """Items in canonical order (sorted, values sorted and distinct); ValueError if malformed."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("selection too long")
    items, n = set(), 0
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, colon, ids = part.removeprefix("-").partition(":")
        if not colon or name not in kinds:
            raise ValueError(f"unknown kind in {part!r}")
        values = sorted({kinds[name].normal(v) for v in ids.split("|") if v.strip()})
        n += len(values)
        if not values or n > MAX_VALUES:
            raise ValueError(f"no value, or over {MAX_VALUES} values: {part!r}")
        items.add(Item(name, part.startswith("-"), tuple(values)))
    return sorted(items)


def canonical(items: list[Item]) -> str:
    """The selection's canonical form, which is also its cache key."""
    return ",".join(map(str, sorted(items)))


def once(bridge: DataFrame) -> DataFrame:
    """The bridge with each title's value of a kind once, at its best tier."""
    return bridge.groupBy(*KEY, "kind", "value").agg(F.max("p").alias("p"))


def item_columns(items: list[Item]) -> tuple:
    """Of a row of the bridge: the bits of the items whose value it is, of those for which it is that for
    certain, and of those whose kind it makes known."""
    sure = some = known = F.lit(0).cast("bigint")
    for k, i in enumerate(items):
        mine = F.col("kind") == i.kind
        has = mine & F.col("value").isin(*i.ids)
        on = F.lit(1 << k).cast("bigint")
        some = some.bitwiseOR(F.when(has, on).otherwise(0))
        sure = sure.bitwiseOR(F.when(has & (F.col("p") >= 1), on).otherwise(0))
        known = known.bitwiseOR(F.when(mine & (F.col("p") >= 1), on).otherwise(0))
    return some, sure, known


def item_bits(bridge: DataFrame, items: list[Item]) -> DataFrame:
    """Per title with anything relevant: ``sure`` and ``some`` (bits of the items whose values it
    carries for certain, or at all) and ``known`` (bits of the items whose kind it knows). Only rows
    of kinds in the selection are read, and each is summed up before the shuffle."""
    some, sure, known = item_columns(items)
    return bridge.where(F.col("kind").isin(*sorted({i.kind for i in items}))).groupBy(KEY).agg(F.bit_or(sure).alias("sure"), F.bit_or(some).alias("some"), F.bit_or(known).alias("known"))


def failing(rows: DataFrame, items: list[Item]) -> DataFrame:
    """rows with ``sure, some, known`` to rows with ``fails`` and ``fails_any``: the bits of the items
    failed confidently and when tentative values count too. Exclusions read confident values only."""
    want = sum(1 << k for k, i in enumerate(items) if not i.exclude)
    avoid = sum(1 << k for k, i in enumerate(items) if i.exclude)
    not_ruled = F.lit(avoid).cast("bigint").bitwiseAND(F.bitwise_not(F.col("known")).bitwiseOR(F.col("sure")))
    failed = lambda c: F.lit(want).cast("bigint").bitwiseAND(F.bitwise_not(F.col(c))).bitwiseOR(not_ruled)
    return rows.withColumns({"fails": failed("sure"), "fails_any": failed("some")}).drop("sure", "some", "known")


def failed_bits(titles: DataFrame, bridge: DataFrame, items: list[Item]) -> DataFrame:
    """Titles with ``fails`` and ``fails_any``, those without any row of the bridge too."""
    if not items:
        return titles.withColumns({"fails": F.lit(0).cast("bigint"), "fails_any": F.lit(0).cast("bigint")})
    return failing(titles.join(item_bits(bridge, items), KEY, "left").na.fill(0, ["sure", "some", "known"]), items)


def own_mask(kind: Kind, items: list[Item]) -> int:
    """Bits of the items that the counts of ``kind`` leave out: of a single kind all its own, of
    another its positive groups of alternatives."""
    return sum(1 << k for k, i in enumerate(items) if i.kind == kind.name and (kind.single or (not i.exclude and len(i.ids) > 1)))


def matched(titles: DataFrame, bridge: DataFrame, items: list[Item]) -> DataFrame:
    """Titles that the selection matches, with ``confident``: at the confident tier."""
    out = failed_bits(titles, bridge, items).where("fails_any = 0")
    return out.withColumn("confident", F.col("fails") == 0).drop("fails", "fails_any")
