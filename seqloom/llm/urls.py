"""URL filters: rules by host and path, and trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.plans.session import drop_table, join_sized, write_table

# Verdict, host and path of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Share of a host's score that it passes on along its links, and what may still move, for each unit of seeds, at the end.
DAMPING = 0.85
TOLERANCE = 1e-6

#: A host is blocked by propagation where its distrust reaches this and exceeds its trust. A seed itself has 1 - DAMPING.
DISTRUST_AT = 0.005

#: Share of a host's pages that rules must block for it to be a blocked seed.
SEED_SHARE = 0.5

_ABSOLUTE_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    got = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, weight): links between different hosts; the weights of a host's links sum to 1."""
    target = F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_ABSOLUTE_LINK), 1))
    absolute = F.regexp_replace("link", r"^//", "http://")
    links = pages.select(host.alias("src"), target.alias("link")).select("src", host_of(absolute).alias("dst"))
    counted = links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return write_table(counted, "urls-links")


def propagate(links: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """Personalised PageRank from ``seeds`` (host, seed) along links from column ``source`` to column ``target``.

    Scores (host, score) start at the seeds; each round a host passes DAMPING
    of its score on, by the share of each of its links, and a seed gets
    1 - DAMPING of its own weight again. Rounds end when no more than TOLERANCE
    times the weight of the seeds moves: that falls by DAMPING a round at least,
    so about 85 rounds do for any graph, fewer where paths are short. Every
    round reads written tables: the join by host of links and scores can be
    split where one host has very many links.
    """
    out = links.groupBy(F.col(source).alias("host")).agg(F.sum("n").alias("total"))
    edges = links.select(F.col(source).alias("host"), F.col(target).alias("to"), "n").join(out, "host")
    edges = write_table(edges.select("host", "to", (F.col("n") / F.col("total")).alias("share")), "urls-edges")
    scores = write_table(seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("score"), "seed"), "urls-scores")
    weight = scores.agg(F.coalesce(F.sum("seed"), F.lit(0.0))).first()[0]
    if weight and edges.limit(1).count():
        while True:
            passed = edges.join(scores.select("host", "score"), "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
            both = scores.join(passed, "host", "full")
            seed, was = F.coalesce("seed", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
            fresh = (1 - DAMPING) * seed + DAMPING * F.coalesce("got", F.lit(0.0))
            new = write_table(both.select("host", fresh.alias("score"), seed.alias("seed"), F.abs(fresh - was).alias("moved")), "urls-scores")
            moved = new.agg(F.sum("moved")).first()[0] or 0.0
            drop_table(scores)
            scores = new
            if moved <= TOLERANCE * weight:
                break
    drop_table(edges)
    found = scores.select("host", "score")
    found._written_at = scores._written_at
    return found


def judge(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    id_col: str = "page_id",
    rules: tuple[tuple[str, str, str], ...] = RULES,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of each page.

    Pages that a rule fits have its verdict. For the others their host decides:
    distrust spreads from hosts of whose pages rules block over SEED_SHARE,
    against the links, to those who link there; trust spreads along links from
    the other hosts with pages that a rule allows. A seed weighs the share of
    its judged pages that are blocked, or allowed, so that scores mean the same
    at any number of hosts and pages. A host is blocked where distrust reaches
    DISTRUST_AT and exceeds trust.

    Links are the absolute ``href`` of ``a`` elements of the whole html, summed
    by pair of hosts before they are shuffled; the graph is of hosts. Scores go
    back to pages by a join that is broadcast only where their count is small.
    A null url, or one without ``://``, has empty host and path, fits no rule
    and is allowed; null html has no links. Repeated rows give repeated rows;
    equal scores of trust and distrust allow.
    """
    view = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    view = view.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    links = host_links(view, F.col("host"), F.col("html"))
    told = view.select("id", "host", "path").withColumn("rule", rule).withColumn("told", verdict)
    hosts = told.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("told") == "allow").alias("good"), F.count_if(F.col("told") == "block").alias("bad")
    )
    hosts = write_table(hosts, "urls-hosts")
    blocked = F.col("bad") > SEED_SHARE * F.col("pages")
    share = lambda of: (F.col(of) / (F.col("good") + F.col("bad"))).alias("seed")
    trust = propagate(links, hosts.where(~blocked & (F.col("good") > 0)).select("host", share("good")), "src", "dst")
    distrust = propagate(links, hosts.where(blocked).select("host", share("bad")), "dst", "src")
    scores = write_table(
        trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full"), "urls-host-scores"
    )
    for table in (links, hosts, trust, distrust):
        drop_table(table)
    joined = join_sized(told, scores, ["host"]).fillna(0.0, ["trust", "distrust"])
    spread = F.when((F.col("distrust") >= DISTRUST_AT) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return joined.select("id", "host", "path", "rule", F.coalesce("told", spread).alias("verdict"), "trust", "distrust")
