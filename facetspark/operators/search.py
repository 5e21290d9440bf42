"""Free-text search.

The query's text, one string, is parsed on the driver; everything that touches titles is a
DataFrame. Titles are proposed by lanes: names and other names by trigrams, years, countries and other
named sets by votes, labels and plot facets by confidence, people by their credits, and two vector
spaces by cosine. What the query rules out is gone before a lane is cut. The candidates of all lanes,
a bounded number but for the credits of named people, are then scored together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold_ascii, popularity, title_score, title_similarity, trigrams, without_article
from ..sources.shared import kept
from .recommend import attention
from .vectors import scan

NEGATIONS = {"not", "no", "without"}
JOINERS = {"and", "or", "the", "a", "of", "in"}

# Fixed values of the score.
W_TITLE, W_SEMANTIC, W_LABEL, W_PLOT, W_PERSON, W_POPULARITY = 2.0, 0.6, 0.25, 0.10, 0.8, 0.15
UNKNOWN_FACET, WRONG_FACET, EXACT_TITLE, EXACT_POPULAR, OTHER_ROLE = 0.6, 0.15, 0.6, 0.25, 0.9
LABEL_FLOOR, MIN_COVERAGE, STRENGTH_FLOOR, STRENGTH_SPAN = 0.55, 0.6, 2.5, 3.5
TITLE_LANE, FACET_LANE, LANE, PHRASE = 50, 500, 200, 5
RECENT_SINCE, CLASSIC_UNTIL = 2021, 1979
SETTINGS = ("set in", "set on", "takes place in", "takes place on", "take place in", "taking place in")


@dataclass(frozen=True)
class Vocabulary:
    """What words of a query may name, each a value of the bridge: labels and genres (kind by name), plot
    facets, countries (value by word); other named sets, such as sources and broadcasters (kind and value by
    phrase), and places, which count only after words of setting. Keys are words or phrases of up to ``PHRASE``
    words. People are too many to be listed here; they are looked up."""

    labels: dict[str, str] = field(default_factory=dict)
    plot: dict[str, str] = field(default_factory=dict)
    countries: dict[str, str] = field(default_factory=dict)
    sets: dict[str, tuple[str, str]] = field(default_factory=dict)
    places: dict[str, str] = field(default_factory=dict)
    recent: int = RECENT_SINCE
    classic: int = CLASSIC_UNTIL


@dataclass(frozen=True)
class Parsed:
    text: str = ""  # all words that are not ruled out
    words: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    plot: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    decade: int | None = None
    year_min: int | None = None
    year_max: int | None = None
    media: int | None = None
    rest: str = ""  # words left for names and vectors: all but those of time, place and media
    share: float = 0.0  # of the words, how many are left
    unread: float = 0.0  # and how many no list has
    sets: tuple[tuple[str, str], ...] = ()  # kinds and values of named sets and places
    people: tuple[str, ...] = ()  # names of several words
    contested: bool = False  # what the words name is also a popular title's name


def folded_words(text: str) -> list[str]:
    return re.findall(r"[\w'#]+", text.lower().replace("&", " and "))


def phrases_of(words: list[str]) -> list[str]:
    """All runs of at most ``PHRASE`` words."""
    return sorted({" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + PHRASE) + 1)})


def _settings(words: list[str], known: Vocabulary) -> tuple[list[str], list[tuple[str, str]]]:
    """The words without "set in" and the like with the longest name of a place behind them, and these places."""
    kept, places, at = [], [], 0
    while at < len(words):
        opens = next((s.split() for s in SETTINGS if words[at : at + len(s.split())] == s.split()), None)
        end = 0
        if opens:
            start = at + len(opens)
            for span in range(min(PHRASE, len(words) - start), 0, -1):
                name = words[start : start + span]
                found = next((known.places[x] for x in (" ".join(name), " ".join(name[1:]) if name[0] == "the" else "") if x in known.places), None)
                if found:
                    places.append(("place", found))
                    end = start + span
                    break
        kept += [] if end else [words[at]]
        at = end or at + 1
    return kept, places


def parse(text: str, known: Vocabulary, people: frozenset[str] = frozenset(), titled: bool = False, popular: bool = False) -> Parsed:
    """Facet words out of a query (P20): labels, plot facets, countries, other named sets, people, a decade
    (``80s``, ``1990s``), a media (``movies``, ``series``), ``recent`` and ``classics``. What follows a negation
    in the middle of the query is avoided; one at the very end, or at the start, is an ordinary word, and so is one
    in the name of a title (``titled``); joiners at the end are dropped (P19).

    Phrases are read from left to right, the longest first. One that decides which titles are eligible (a country,
    a set, a place, a person's name of several words, of those in ``people``) takes its words; one that only lifts
    a title (a label, a plot facet) is read and leaves them. If the query is also a ``popular`` title's name,
    what decides is contested: its words are given back, and it only lifts."""
    words = folded_words(text)
    while words and words[-1] in JOINERS:
        words.pop()
    avoid: list[str] = []
    for i, w in enumerate(words):
        if w in NEGATIONS and 0 < i < len(words) - 1 and not titled:
            avoid, words = [x for x in words[i + 1 :] if x not in JOINERS], words[:i]
            break
    tokens, sets = _settings(words, known)
    labels, plot, countries, named, rest, unread = [], [], [], [], [], 0
    found: dict[str, int | None] = {"decade": None, "year_min": None, "year_max": None, "media": None}
    at = read_until = 0
    while at < len(tokens):
        w = tokens[at]
        taken = 1
        if m := re.fullmatch(r"(\d{2}|\d{4})s", w):
            y = int(m[1])
            found["decade"] = (y if y >= 100 else (2000 if y < 30 else 1900) + y) // 10 * 10
        elif w in ("movie", "movies", "films", "film"):
            found["media"] = 0
        elif w in ("series", "shows", "show"):
            found["media"] = 1
        elif w == "recent":
            found["year_min"] = known.recent
        elif w == "classics":
            found["year_max"] = known.classic
        else:
            taken = 0
            for span in range(min(PHRASE, len(tokens) - at), 0, -1):
                phrase = " ".join(tokens[at : at + span])
                if phrase in known.countries:
                    countries.append(known.countries[phrase])
                    taken = span
                elif phrase in known.sets:
                    sets.append(known.sets[phrase])
                    taken = span
                elif span > 1 and phrase in people:
                    named.append(phrase)
                    taken = span
                elif phrase in known.labels or phrase in known.plot:
                    lifts = labels if phrase in known.labels else plot
                    lifts += [] if phrase in lifts else [phrase]
                    read_until = max(read_until, at + span)
                if taken:
                    break
        if not taken:
            if at < read_until:
                rest.append(w)
            elif w not in JOINERS:
                rest.append(w)
                unread += 1
        at += taken or 1
    contested = popular and bool(countries or sets or named or found["decade"] is not None)
    if contested:
        rest = [w for w in words if w not in JOINERS]
    n = max(1, len(words))
    return Parsed(" ".join(words), tuple(words), tuple(labels), tuple(plot), tuple(avoid), tuple(countries), **found, rest=" ".join(rest), share=len(rest) / n, unread=unread / n, sets=tuple(dict.fromkeys(sets)), people=tuple(named), contested=contested)


def title_matches(names: DataFrame, query: str, limit: int, floor: float = 0.6) -> DataFrame:
    """``id, score, coverage``: names by trigram coverage of the query, popularity and exactness
    (M8). Two characters are a prefix; fewer find nothing. names: (id, name, pop).

    Each distinct name is cut into trigrams once; only the query's own trigrams are joined."""
    q = " ".join(query.lower().split())
    bare = q.replace(" ", "")
    grams = sorted({bare[i : i + 3] for i in range(len(bare) - 2)})
    folded = fold_ascii(F.col("name"))
    if len(bare) < 2:
        return names.where("false").select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage"))
    if len(bare) == 2:
        return names.where(F.startswith(folded, F.lit(q))).orderBy(F.desc("pop"), "id").limit(limit).select("id", F.round(popularity(F.col("pop")), 6).alias("score"), F.lit(1.0).alias("coverage"))
    have = F.array_intersect(trigrams(folded), F.array(*[F.lit(g) for g in grams]))
    out = names.select("id", "pop", folded.alias("f"), (F.size(have) / F.lit(float(len(grams)))).alias("coverage")).where(F.col("coverage") >= floor)
    s = title_score(F.col("coverage"), popularity(F.col("pop")), F.col("f") == q, F.startswith("f", F.lit(q)))
    return out.select("id", F.round(s, 6).alias("score"), F.round("coverage", 6).alias("coverage"), "pop").orderBy(F.desc("score"), F.desc("pop"), "id").limit(limit).drop("pop")


def facet_lane(pool: DataFrame, found: DataFrame, limit: int = FACET_LANE) -> DataFrame:
    """``id``: of the pool's titles that ``found`` (id) names, those with most votes (M10): a facet names a
    set, and no order in it."""
    return pool.join(found.select("id").distinct(), "id", "left_semi").orderBy(F.desc("votes"), "id").limit(limit).select("id")


def semantic_scan(vectors: DataFrame, query: list[int], column: str = "vec", pool: DataFrame | None = None, limit: int = LANE) -> DataFrame:
    """``id, z, strength``: the rows nearest to a query vector (of ``pool``, if given), with how many
    deviations above the mean of all rows their dot product lies, clamped to a strength (M9, F25)."""
    dots = scan(vectors, query, column)
    stats = dots.agg(F.avg("dot").alias("m"), F.stddev_pop("dot").alias("sd"))  # one row
    near = dots.join(pool.select("id"), "id", "left_semi") if pool is not None else dots
    z = (F.col("dot") - F.col("m")) / F.col("sd")
    best = near.orderBy(F.desc("dot"), "id").limit(limit).join(F.broadcast(stats.where("sd > 0")), F.lit(True))
    return best.select("id", F.round(z, 6).alias("z"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (z - STRENGTH_FLOOR) / STRENGTH_SPAN)), 6).alias("strength"))


def people_named(people: DataFrame, p: Parsed) -> DataFrame:
    """``entity``: people whose folded name is a run of at most ``PHRASE`` words of the query, or was read there."""
    phrases = sorted({*phrases_of(p.rest.split()), *p.people})
    return people.where(fold_ascii(F.col("name")).isin(*phrases) if phrases else F.lit(False)).select("entity")


def answer(titles: DataFrame, bridge: DataFrame, text: str, known: Vocabulary, limit: int = 40, names: DataFrame | None = None, people: DataFrame | None = None, credits: DataFrame | None = None, vectors: DataFrame | None = None, vector: list[int] | None = None, index=None, other_index=None) -> DataFrame:
    """``id, score, exact, place`` (M7). titles: (media, id, title, votes, year); names: (id, name),
    further names; people: (entity, name); credits: (id, entity, role); vectors: (id, vec, half), of which
    ``vector`` is the query's in the first space and, its beginning, in the second; index, other_index: stored
    :class:`~facetspark.operators.nameindex.NameIndex` of titles' and of further names, read instead of these.

    A title on record as of another decade, year or country than the query's words say is discounted to
    ``WRONG_FACET``, one of which nothing is on record to ``UNKNOWN_FACET``; a title whose name is the query
    is not. A title that carries a value to avoid is out; one of which that is not known stays (P21).
    Popularity counts as far as a title is relevant. A title whose name is the query, if it comes out
    first, leads those that match by name, and these the others (T8)."""
    words = folded_words(text)
    several = [x for x in phrases_of(words) if " " in x]
    # of each phrase of the query: is there a person of that name?
    people_read = frozenset(r[0] for r in people.where(fold_ascii(F.col("name")).isin(*several)).select(fold_ascii(F.col("name"))).distinct().collect()) if people is not None and several else frozenset()
    same = titles.where(fold_ascii(F.col("title")) == " ".join(words)).agg(F.count("*").alias("n"), F.max("votes").alias("votes")).select("n", attention(F.coalesce("votes", F.lit(0))).alias("pop")).first()
    p = parse(text, known, people_read, titled=same.n > 0, popular=same.n > 0 and same.pop >= EXACT_POPULAR)
    pool = titles if p.media is None else titles.where(F.col("media") == p.media)
    if p.avoid:
        # whatever the words to avoid name: values, countries, sets, places and people
        ruled = phrases_of(list(p.avoid))
        values = [known.countries[w] for w in ruled if w in known.countries] + [known.places[w] for w in ruled if w in known.places]
        out = F.lower("value").isin(*ruled) | F.col("value").isin(*values)
        for kind, value in (known.sets[w] for w in ruled if w in known.sets):
            out = out | (F.col("kind") == kind) & (F.col("value") == value)
        gone = bridge.where(out).select("id")
        if people is not None and credits is not None:
            gone = gone.unionByName(credits.join(people.where(fold_ascii(F.col("name")).isin(*ruled)).select("entity"), "entity").select("id"))
        pool = pool.join(gone.distinct(), "id", "left_anti")
        for w in p.avoid:  # a decade to avoid; a title of which no year is known stays
            if m := re.fullmatch(r"(\d{2}|\d{4})s", w):
                y = int(m[1])
                pool = pool.where(F.col("year").isNull() | (F.floor(F.col("year") / 10) * 10 != (y if y >= 100 else (2000 if y < 30 else 1900) + y) // 10 * 10))
    pool = kept(pool.select("id", F.col("title").alias("name"), "votes", "year"), "pool")  # every lane reads it
    all_names = pool.select("id", "name", F.col("votes").alias("pop"))
    best = lambda met: met.join(pool.select("id"), "id", "left_semi").orderBy(F.desc("score"), F.desc("pop"), "id").limit(TITLE_LANE).select("id")
    lanes = [best(index.matches(p.text, MIN_COVERAGE)) if index else title_matches(all_names, p.text, TITLE_LANE, MIN_COVERAGE).select("id")]
    if other_index is not None:
        lanes.append(best(other_index.matches(p.text, MIN_COVERAGE)).distinct())
    elif names is not None:
        other = names.join(pool.select("id", F.col("votes").alias("pop")), "id").select("id", "name", "pop")
        lanes.append(title_matches(other, p.text, TITLE_LANE, MIN_COVERAGE).select("id").distinct())
    year, named = F.col("year"), []
    in_time = [c for c in (p.decade is not None and (F.floor(year / 10) * 10 == p.decade), p.year_min and year >= p.year_min, p.year_max and year <= p.year_max) if c is not False and c is not None]
    asked_of: dict[str, list[str]] = {"country": list(p.countries)} if p.countries else {}
    for kind, value in p.sets:
        asked_of.setdefault(kind, []).append(value)
    of_kind = {k: bridge.where((F.col("kind") == k) & F.col("value").isin(*x)).select("id").distinct() for k, x in asked_of.items()}
    if in_time or of_kind:
        strong = pool
        for c in in_time:
            strong = strong.where(c)
        for members in of_kind.values():
            strong = strong.join(members, "id", "left_semi")
        lanes.append(strong.orderBy(F.desc("votes"), "id").limit(FACET_LANE).select("id"))
        named.append(strong.select("id"))
    genres = [w for w in p.labels if known.labels[w] == "genre"]
    if genres:
        of_genre = bridge.where((F.col("kind") == "genre") & F.lower("value").isin(*genres)).select("id")
        lanes.append(facet_lane(pool, of_genre))
        named.append(lanes[-1])
    moods = [w for w in p.labels if known.labels[w] != "genre"]
    carried = bridge.where(F.col("kind").isin(*sorted({known.labels[w] for w in moods})) & F.lower("value").isin(*moods) & (F.col("p") >= LABEL_FLOOR)) if moods else None
    if moods:
        lanes.append(carried.groupBy("id").agg(F.max("p").alias("p")).join(pool, "id").orderBy(F.desc("p"), F.desc("votes"), "id").limit(LANE).select("id"))
    plot = bridge.where(F.col("kind").isin(*sorted({known.plot[w] for w in p.plot})) & F.lower("value").isin(*p.plot)) if p.plot else None
    if p.plot:
        lanes.append(plot.join(pool, "id", "left_semi").select("id").distinct())
    role = None
    if people is not None and credits is not None:
        own = kept(credits.join(people_named(people, p), "entity"), "credits")
        main = own.groupBy("entity", "role").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "role"))).where("r = 1").select("entity", F.col("role").alias("main"))
        role = own.join(main, "entity").groupBy("id").agg(F.max(F.when(F.col("role") == F.col("main"), 1.0).otherwise(OTHER_ROLE)).alias("person"))
        lanes.append(role.join(pool, "id", "left_semi").select("id"))
    sem = None
    if vectors is not None and vector is not None:
        bound = pool if p.contested or not named[:1] or not (in_time or of_kind) else pool.join(named[0].distinct(), "id", "left_semi")
        spaces = [semantic_scan(vectors, vector, "vec", bound), semantic_scan(vectors, vector[: len(vector) // 2], "half", bound)]
        sem = spaces[0].unionByName(spaces[1]).groupBy("id").agg(F.max("strength").alias("sem"))
        lanes.append(sem.select("id"))
    found = lanes[0]
    for lane in lanes[1:]:
        found = found.unionByName(lane)
    found = kept(pool.join(found.distinct(), "id"), "found")
    asked = re.sub("^(the|an|a) ", "", p.text)
    bare = asked.replace(" ", "")
    grams = F.array(*[F.lit(g) for g in sorted({bare[i : i + 3] for i in range(len(bare) - 2)})]).cast("array<string>")
    each = found.select("id", "name") if names is None else found.select("id", "name").unionByName(names.join(found.select("id"), "id", "left_semi").select("id", "name"))
    theirs = each.select("id", without_article(fold_ascii(F.col("name"))).alias("f")).withColumn("g", trigrams(F.col("f")))
    both = F.size(F.array_intersect("g", grams)).cast("double")
    cover, dice = both / F.nullif(F.size(grams), F.lit(0)), 2 * both / F.nullif(F.size(grams) + F.size("g"), F.lit(0))
    near = F.when(F.col("f") == asked, 1.0).when(cover >= MIN_COVERAGE, 0.5 * (0.5 * cover + 0.5 * dice)).otherwise(0.0)
    by_name = theirs.groupBy("id").agg(F.max(near).alias("near"), F.max(F.col("f") == asked).alias("exact"))
    out = found.join(by_name, "id")
    for column, part in (("lab", carried.groupBy("id").agg(F.max("p").alias("lab")) if moods else None), ("pf", plot.groupBy("id").agg(F.max("p").alias("pf")) if p.plot else None), ("person", role), ("sem", sem)):
        out = out.join(part, "id", "left") if part is not None else out.withColumn(column, F.lit(None).cast("double"))
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    for name, parts in (("in_genre", named[-1:] if genres else []), ("named", named), *((f"in_{k}", [x]) for k, x in of_kind.items()), *((f"has_{k}", [bridge.where(F.col("kind") == k)]) for k in of_kind)):
        rows = None
        for x in parts:
            rows = x.select("id") if rows is None else rows.unionByName(x.select("id"))
        out = out.join(flag(rows, name), "id", "left") if rows is not None else out.withColumn(name, F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    wrong = F.when(F.col("exact"), 1.0).otherwise(WRONG_FACET)
    phi = F.lit(1.0)
    for k in of_kind:
        phi = phi * F.when(~yes(f"has_{k}"), UNKNOWN_FACET).when(yes(f"in_{k}"), 1.0).otherwise(wrong)
    for c in in_time:
        phi = phi * F.when(year.isNull(), UNKNOWN_FACET).when(c, 1.0).otherwise(wrong)
    phi = F.lit(1.0) if p.contested else phi  # a contested facet lifts and rules nothing down
    out = out.na.fill(0.0, ["lab", "pf", "person", "sem"]).withColumns({"phi": phi, "pop": attention(F.col("votes"))})
    share = F.when((F.col("lab") > 0) | (F.col("pf") > 0), p.share).otherwise(p.unread)
    out = out.withColumns({"t": F.when(F.col("exact"), EXACT_TITLE + 0.4 * F.col("pop")).otherwise(F.col("near") * share), "lab": F.when(yes("in_genre"), 1.0).otherwise(F.col("lab"))})
    out = kept(out, "candidates")  # what follows asks of them three times; no window is over all of them
    answered = bool(out.where(F.col("exact") & (F.col("pop") >= EXACT_POPULAR)).limit(1).count())
    w_sem = W_SEMANTIC * (0.3 + 0.7 * p.share) * (0.3 if answered else 1.0)
    relevance = F.least(F.lit(1.0), F.greatest(F.col("t") / EXACT_TITLE, "sem", "lab", "pf", "person", F.when(yes("named"), 1.0).otherwise(0.0)))
    score = F.col("phi") * (W_TITLE * F.col("t") + w_sem * F.col("sem") + W_LABEL * F.col("lab") + W_PLOT * F.col("pf") + W_PERSON * F.col("person") + W_POPULARITY * F.col("pop") * relevance)
    out = out.withColumn("score", F.round(score, 6)).where("score > 0")
    order = [F.desc("score"), F.desc("votes"), F.asc("id")]
    first = out.orderBy(*order).select("id", "exact").first()
    tier = F.lit(0) if first is None or not first.exact else F.when(F.col("id") == first.id, 0).when(F.col("t") > 0, 1).otherwise(2)
    page = out.withColumn("tier", tier).orderBy("tier", *order).limit(limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy("tier", *order))).select("id", "score", "exact", "place")


def similar_names(names: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """``a, b, sim`` of the pairs of distinct names, a before b or equal, whose similarity (F6) is above 0. At
    least ``least`` of a's trigrams must be b's, so one of a's rarest, all but that share of them and one, is:
    only pairs that meet there are looked at, never all. names: (name)."""
    g = names.select("name").distinct().select("name", trigrams(F.col("name")).alias("g"))
    each = g.select("name", F.explode("g").alias("gram"))
    df = each.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = each.join(df, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("by"))
    n = F.size("by")
    rare = ranked.select("name", F.explode(F.slice("by", F.lit(1), F.greatest(F.lit(1), n - F.ceil(least * n) + 1).cast("int"))).alias("x")).select(F.col("name").alias("a"), "x.gram")
    pairs = rare.join(each.select(F.col("name").alias("b"), "gram"), "gram").where("a <= b").select("a", "b").distinct()
    met = pairs.join(g.select(F.col("name").alias("a"), F.col("g").alias("ga")), "a").join(g.select(F.col("name").alias("b"), F.col("g").alias("gb")), "b")
    return met.select("a", "b", F.round(title_similarity(F.col("ga"), F.col("gb")), 6).alias("sim")).where("sim > 0")
