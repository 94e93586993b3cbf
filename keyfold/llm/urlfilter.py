"""Url filter: host and path rules, then trust propagated over host edges.

Pages that a rule fits get the rule's verdict. Their hosts are the seeds:
personalised PageRank spreads trust along host edges from hosts with allowed
pages, and distrust against the edges from hosts with blocked pages (a host
that points at a blocked one is suspect). A host is blocked when its share of
distrust passes a threshold; pages without a rule follow their host.

Host edges: every absolute link of a page to another host, and each host with
its parent domain (down to two labels) in both directions. Pages are reduced to
distinct edges with counts before any join, so a host that holds a third of
the pages is one row; the edges of a hub are dealt over salts. After k rounds a
rank is at most DAMPING ** k from its limit, so rounds go on until no host's
verdict can change any more, or that bound is below TOLERANCE (hosts whose trust
and distrust are nearer to the threshold than that are judged as they stand).
Main path: DataFrame functions only.

Defined cases: a null url, or one without ``://``, has empty host and path and
fits no rule; an empty host is allowed; hosts that no trust or distrust reaches
are allowed; null html has no links; repeated rows each get a verdict.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_groups, stage

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: How far from its limit a rank (they sum to 1 at most) may be.
TOLERANCE = 1e-6
STAGE_EVERY = 8
#: Edges of a host that one salt holds.
FAN = 10_000
BLOCK_SHARE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    host = lower_ascii(F.regexp_extract(url, URL, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null: none fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = url_parts(F.col("url"))
    df = pages.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return df.withColumn("rule", name).withColumn("ruled", verdict)


def linked_hosts(html: Column) -> Column:
    """Hosts of the absolute links of a page."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), 1),
                       lambda u: lower_ascii(F.regexp_extract(u, r"//([^/?#]*)", 1)))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) between distinct hosts; ``pages``: host and links."""
    linked = (pages.filter("host <> ''").select("host", F.explode("links").alias("dst"))
              .filter("dst <> '' AND dst <> host").groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("w")))
    linked = stage(linked, "url-links")
    hosts = pages.select("host").unionByName(linked.select(F.col("dst").alias("host"))).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    ups = F.expr("transform(sequence(1, greatest(size(labels) - 1, 1)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    chain = hosts.withColumn("labels", labels).withColumn("ups", ups)
    steps = chain.select(F.explode(F.expr("arrays_zip(ups, slice(ups, 2, size(ups)))")).alias("e")).select(
        F.col("e.ups").alias("low"), F.col("e.1").alias("high")).filter("high IS NOT NULL").distinct()
    both = steps.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")),
                                          F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))).alias("e"))
    parents = both.select("e.src", "e.dst", F.lit(1).cast("long").alias("w"))
    return linked.unionByName(parents).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def most_rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which every rank of any graph is within the tolerance."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def by_host(ranks: DataFrame) -> DataFrame:
    """(host, trust, distrust) of (kind, host, p)."""
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("p"))), F.lit(0.0)).alias(k)
    return ranks.groupBy("host").agg(pick("trust"), pick("distrust"))


def _standing(ranks: DataFrame, share: float, error: float) -> tuple[int, int]:
    """How many ranks are positive, and how many hosts that both kinds have
    reached may yet change sides if ranks are within ``error``."""
    ranks = ranks.filter("p > 0")
    both = by_host(ranks).filter("trust > 0 AND distrust > 0")
    open_ = F.abs(F.col("distrust") * (1 - share) - F.col("trust") * share) <= error
    return ranks.count(), both.filter(open_).count()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              tolerance: float = TOLERANCE, fan: int = FAN, share: float | None = None) -> DataFrame:
    """(kind, host, p): personalised PageRank of each kind of seed. ``edges``
    (staged): kind, src, dst, w; ``seeds``: kind, host, s (sums to 1 a kind). Mass
    of hosts without edges is not carried on. Runs for ``rounds`` rounds, or until
    the ranks are within the tolerance, or, with ``share``, until all hosts are
    reached and none can pass that share of distrust any more.

    A host's edges are dealt over salts of about ``fan`` edges and its rank is
    sent to each, so no task holds all edges of a hub; what meets at a hub is
    summed in the sending tasks first."""
    out = stage(edges.groupBy("kind", "src").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("n")), "url-out")
    salts = F.ceil(F.col("n") / fan).cast("int")
    met = join_groups(edges, out.withColumn("salts", salts), ["kind", "src"], "n", edges.count())
    flow = stage(met.select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst",
                            (F.col("w") / F.col("all")).alias("f")), "url-flow")
    seeds = stage(seeds, "url-seeds")
    hubs = stage(out.withColumn("salts", salts).filter("salts > 1").select("kind", F.col("src").alias("host"), F.lit(0.0).alias("p"), "salts"), "url-hubs")
    given = lambda share: seeds.select("kind", "host", (F.col("s") * share).alias("p"), F.lit(1).alias("salts")).unionByName(hubs)
    total = lambda rows: rows.groupBy("kind", "host").agg(F.sum("p").alias("p"), F.max("salts").alias("salts"))
    state = stage(total(given(1.0)), "url-rank")
    most, reached = rounds or most_rounds(damping, tolerance), 0
    for i in range(1, most + 1):
        sent = (state.select("kind", F.col("host").alias("src"), "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
                .join(flow, ["kind", "src", "salt"])
                .select("kind", F.col("dst").alias("host"), (F.col("p") * F.col("f") * damping).alias("p"), F.lit(1).alias("salts")))
        state = total(sent.unionByName(given(1 - damping)))
        if i % STAGE_EVERY == 0 or i == most:
            state = stage(state, "url-rank")
            if share is not None and i < most:
                now, undecided = _standing(state, share, damping ** i)
                # hosts reached grow every round until there are no more
                if now == reached and not undecided:
                    break
                reached = now
    return state.filter("p > 0").select("kind", "host", "p")


def host_scores(pages: DataFrame, damping: float = DAMPING, rounds: int | None = None, share: float | None = None) -> DataFrame:
    """(host, trust, distrust); ``pages``: host, links, ruled; with ``share`` only
    as exact as verdicts at that share need."""
    edges = stage(host_edges(pages), "url-edges")
    kinds = [edges.select(F.lit("trust").alias("kind"), "src", "dst", "w"),
             edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")]
    counted = pages.filter("host <> '' AND ruled IS NOT NULL").groupBy("ruled", "host").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("ruled").agg(F.sum("n").alias("all"))
    seeds = counted.join(totals, "ruled").select(
        F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host",
        (F.col("n") / F.col("all")).alias("s"))
    both = stage(reduce(DataFrame.unionByName, kinds), "url-both")
    return by_host(propagate(both, seeds, damping, rounds, share=share))


def filter_urls(pages: DataFrame, rules=RULES, block_share: float = BLOCK_SHARE) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, host_verdict."""
    found = judged(pages.select("page_id", "url", "html"), rules).withColumn("links", linked_hosts(F.col("html")))
    found = stage(found.drop("url", "html"), "url-pages")
    scores = host_scores(found, share=block_share)
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    bad = scores.filter(share > block_share).select(F.col("host").alias("h"))
    rows = found.select("page_id", "host", "path", "rule", "ruled")
    rows = rows.join(bad, rows["host"] == bad["h"], "left")
    method = F.when(F.col("h").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
                       method.alias("host_verdict"))


def _sql_rule(field: int) -> str:
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[field]}'"
             for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return f"CASE {' '.join(cases)} END"


def _sql() -> str:
    """The same judgement with as many rounds written out as may be needed."""
    href = HREF.replace("'", "''")
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    head = f"""WITH parts AS MATERIALIZED (
      SELECT page_id, coalesce({low(f"regexp_extract(url, '{URL}', 1)")}, '') AS host,
             coalesce(regexp_extract(url, '{URL}', 2), '') AS path, html FROM pages),
    ruled AS MATERIALIZED (SELECT page_id, host, path, html, {_sql_rule(0)} AS rule, {_sql_rule(1)} AS ruled FROM parts),
    links AS (SELECT host AS src, {low("regexp_extract(u, '//([^/?#]*)', 1)")} AS dst
              FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS u FROM ruled WHERE host <> '')),
    linked AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM links WHERE dst <> '' AND dst <> src GROUP BY src, dst),
    hosts AS (SELECT DISTINCT host FROM (SELECT host FROM ruled UNION ALL SELECT dst FROM linked) WHERE host <> ''),
    cut AS (SELECT host, string_split(host, '.') AS l FROM hosts),
    steps AS (SELECT DISTINCT array_to_string(l[i:], '.') AS low, array_to_string(l[i + 1:], '.') AS high
              FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM cut WHERE len(l) > 2)),
    edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM linked
              UNION ALL SELECT low, high, 1 FROM steps UNION ALL SELECT high, low, 1 FROM steps) GROUP BY src, dst),
    both_ways AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
    flow AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS f FROM both_ways),
    seeds AS MATERIALIZED (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host,
              count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS s FROM ruled WHERE host <> '' AND ruled IS NOT NULL GROUP BY ruled, host),
    r0 AS (SELECT kind, host, s AS p FROM seeds)"""
    rounds = [f"""r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(p) AS p FROM (
      SELECT r.kind, f.dst AS host, r.p * f.f * {DAMPING} AS p FROM r{i} r JOIN flow f ON f.kind = r.kind AND f.src = r.host
      UNION ALL SELECT kind, host, s * {1 - DAMPING} FROM seeds) GROUP BY kind, host)""" for i in range(most_rounds())]
    tail = f"""bad AS (SELECT host FROM (SELECT host, coalesce(sum(p) FILTER (kind = 'trust'), 0) AS t,
      coalesce(sum(p) FILTER (kind = 'distrust'), 0) AS d FROM r{most_rounds()} GROUP BY host) WHERE d / (t + d) > {BLOCK_SHARE})
    SELECT page_id, host, path, rule, coalesce(ruled, m) AS verdict, m AS host_verdict FROM (
      SELECT *, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS m FROM ruled)"""
    return ",\n".join([head, *rounds, tail])


SQL = _sql()
