"""URL filters with trust and distrust over the host graph (operator 1). DataFrame functions only.

A rule is a host and a path; it fits urls of the host and its subdomains whose path starts
with the rule's. Urls that no rule fits are judged by their host: trust flows along links
from hosts that the rules mostly allow (personalised PageRank), distrust flows against the
links from hosts that they mostly block, and a host with more distrust than trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stored, read_table, stored

LITERAL_RULES = 1000


def split_url(url) -> tuple:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def domains(host: str) -> str:
    """SQL: a host and all domains above it."""
    return f"transform(array(split({host}, '[.]')), p -> transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p)), '.')))[0]"


def match_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add ``rule`` (the longest that fits, else null) and ``ruled`` (its verdict); of rules of
    equal length a blocking one wins. A short list is a map in the plan; a long one is a table
    joined by domain, which Spark broadcasts only below its own size limit."""
    parsed = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in dict(rules).items()]
    if len(parsed) <= LITERAL_RULES:
        by: dict[str, list] = {}
        for d, p, r, v in parsed:
            by.setdefault(d, []).append((p, r, v))
        pairs = [x for d, rs in by.items() for x in (F.lit(d), F.array(*[F.struct(F.lit(p).alias("p"), F.char_length(F.lit(r)).alias("n"), F.lit(v).alias("v"), F.lit(r).alias("r")) for p, r, v in rs]))]
        if not pairs:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
        table = F.create_map(*pairs)
        hits = F.flatten(F.filter(F.transform(F.expr(domains("host")), lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull()))
        best = F.array_max(F.transform(F.filter(hits, lambda x: F.startswith(F.col("path"), x["p"])), lambda x: F.struct(x["n"].alias("n"), x["v"].alias("v"), x["r"].alias("r"))))
        return urls.withColumn("best", best).withColumns({"rule": F.col("best.r"), "ruled": F.col("best.v")}).drop("best")
    spark = urls.sparkSession
    table = spark.createDataFrame(parsed, "domain string, p string, r string, v string")
    places = urls.select("host", "path").distinct()
    hits = places.withColumn("domain", F.explode(F.expr(domains("host")))).join(table, "domain").where(F.startswith("path", "p"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("r").alias("n"), F.col("v"), F.col("r"))).alias("best"))
    return urls.join(best.select("host", "path", F.col("best.r").alias("rule"), F.col("best.v").alias("ruled")), ["host", "path"], "left")


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: how many links of each host's pages lead to each other host.
    Relative links stay within their host and are no edge."""
    host, _ = split_url(F.col("url"))
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(?i)href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"), F.lit(1))
    links = pages.select(host.alias("src"), F.explode(found).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, rounds: int = 1000) -> DataFrame:
    """Personalised PageRank: ``host, mass``, from equal mass on the seeds, until a round neither
    moves more than ``tolerance`` of the mass nor reaches a new host. Mass that is not passed on, that
    of hosts without links included, returns to the seeds in the same round. The links with their
    shares are written once; of each round the passed mass is; the driver sees three numbers. It is an
    error not to settle in ``rounds`` rounds."""
    n = seeds.count()
    start = seeds.select("host", F.lit(1.0 / max(n, 1)).alias("mass"))
    if not n or edges.isEmpty():
        return start
    out = stored(edges.join(edges.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")), "shares")
    of_seeds = stored(seeds.join(out, seeds.host == out.src).groupBy(F.col("dst").alias("host")).agg((F.sum("share") / n).alias("passed")), "of_seeds")
    now, back, reached = None, 1.0, 0
    for _ in range(rounds):
        step = of_seeds.select("host", (F.col("passed") * back).alias("passed"))
        if now is not None:
            step = step.unionByName(now.join(out, now.host == out.src).select(F.col("dst").alias("host"), (F.col("passed") * F.col("share")).alias("passed")))
        step = step.groupBy("host").agg(F.sum("passed").alias("passed"))
        if now is not None:
            step = step.join(now.select("host", F.col("passed").alias("was")), "host", "left")
        after = stored(step.select("host", "passed", F.abs(F.col("passed") - (F.coalesce("was", F.lit(0.0)) if now is not None else 0.0)).alias("change")), "passed")
        total, change, hosts = after.agg(F.sum("passed"), F.sum("change"), F.count("*")).first()
        if now is not None:
            drop_stored(now)
        now, back, before = after, 1.0 - (total or 0.0), reached
        reached = hosts
        if (change or 0.0) <= tolerance and hosts == before:
            drop_stored(out)
            return now.select("host", F.col("passed").alias("mass")).unionByName(start.withColumn("mass", F.col("mass") * back)).groupBy("host").agg(F.sum("mass").alias("mass"))
    raise RuntimeError(f"masses have not settled in {rounds} rounds")


def judge(pages: DataFrame, rules: list[tuple[str, str]], seed_share: float = 0.5, ratio: float = 1.0, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Judge every page's url: ``page_id, host, path, rule, verdict, trust, distrust``.

    Seeds are the hosts of which at least ``seed_share`` of the pages have a rule of the one
    verdict. Trust and distrust are each counted in seeds' worth (mass times the number of seeds), so
    that neither list outweighs the other by being short. A host is blocked if its distrust exceeds
    ``ratio`` times its trust; hosts that neither reaches, and ties, are allowed. A null url, or one without ``://``, has an empty host, which
    takes no part in the graph and is allowed; very long urls and pages are read whole; repeated pages
    are judged each, and their links counted each; without links only seeds have mass; an empty
    table gives no rows; other columns are not read.
    """
    host, path = split_url(F.col("url"))
    urls = match_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = stored(urls.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    edges = stored(host_links(pages), "host_links")
    good, bad = (hosts.where(F.col(c) >= seed_share).select("host") for c in ("allowed", "blocked"))
    in_seeds = lambda ranks, seeds: ranks.select("host", (F.col("mass") * seeds.count()).alias("mass"))
    trust = in_seeds(propagate(edges, good, damping, tolerance), good)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = in_seeds(propagate(back, bad, damping, tolerance), bad)
    scored = hosts.select("host").join(trust.withColumnRenamed("mass", "trust"), "host", "left").join(distrust.withColumnRenamed("mass", "distrust"), "host", "left").na.fill(0.0)
    scored = scored.withColumn("by_host", F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow"))
    out = urls.join(stored(scored, "host_scores"), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")
