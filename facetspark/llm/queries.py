"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import codes, collocations, decontaminate, linededup, negatives, ngramjoin, packing, quality, rules, sharding, suffixes, toxicity, urlfilter

_modules = (codes, collocations, decontaminate, linededup, negatives, ngramjoin, packing, quality, rules, sharding, suffixes, toxicity, urlfilter)


def queries() -> dict:
    found = {n: f for m in _modules for n, f in vars(m).items() if n.startswith("op") and n[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules for k, v in getattr(m, "SQL", {}).items()}
