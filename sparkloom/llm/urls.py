"""URL filter: fixed rules by host and path, and for the rest trust and distrust spread over the graph of hosts.

Trust is personalised PageRank from trusted hosts along links; distrust is the same from blocked hosts against the
links (who links to a bad host is suspect). What a round brings to a host is passed on in the next, until whole-number
division leaves nothing to pass on: no number of rounds cuts a chain short, and their number grows as the logarithm of MASS
alone. Rank is a whole number, so sums don't depend on their order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import few, listed, settle, table

#: (verdict, host, path); fixed by the contract of op10.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The seeds of a kind have this rank together; of each hundred parts that a host gets it passes DAMPING on.
MASS = 10**12
DAMPING = 50
#: Rounds of a job.
ROUNDS = 8
#: A host is blocked if distrust makes up at least so many hundredths of its trust and distrust.
BLOCK_FROM = 50
#: More rules than this are joined by host instead of standing in one expression.
MOST_INLINE = 100
#: Where too many hosts are judged for a broadcast, a host's pages are spread over so many keys.
SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"""//([^/?#"'\\\x00-\x20<>]+\.[^/?#"'\\\x00-\x20<>]+)"""
_NOT_NAME = r"[^A-Za-z0-9.\-]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def under(host: Column, name: str) -> Column:
    """Whether a host is this name or below it; a name that ends in .* stands for any top-level domain."""
    if name.endswith(".*"):
        return host.rlike(rf"(^|\.){re.escape(name[:-2])}\.[^.]+$")
    return (host == name) | host.endswith(f".{name}")


def suffixes(host: Column) -> Column:
    """A host and the domains above it, to the last label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """pages (host, path, ...) with rule and said (allow or block) of the longest rule that fits, of equally long ones the
    last by text; null where none fits."""
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]))
    if len(rules) <= MOST_INLINE:
        text = said = F.lit(None).cast("string")
        for verdict, name, start in ordered:
            fits = under(F.col("host"), name) & F.col("path").startswith(start)
            text, said = F.when(fits, F.lit(name + start)).otherwise(text), F.when(fits, F.lit(verdict)).otherwise(said)
        return pages.withColumns({"rule": text, "said": said})
    wanted = listed(pages.sparkSession, [(k, *r) for k, r in enumerate(ordered)], ["nth", "said", "name", "start"], ["bigint", "string", "string", "string"])
    asked = pages.select("host", "path").distinct().withColumn("name", F.explode(suffixes(F.col("host"))))
    hits = asked.join(few(wanted), "name").where("startswith(path, start)").groupBy("host", "path").agg(F.max(F.struct("nth", F.concat("name", "start").alias("rule"), "said")).alias("hit"))
    return pages.join(hits, ["host", "path"], "left").select(*pages.columns, "hit.rule", "hit.said")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts: every address in html to another host, every name in html of a host
    that has pages or of a domain above one, and between each host and the domain above it, that one and its own, and so on
    down to two labels, both ways. pages: host, html (null: no links)."""
    some = pages.where("host <> ''")
    html, lower = F.coalesce("html", F.lit("")), lambda h: F.translate(h, _UPPER, _LOWER)
    found = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_ADDRESS), F.lit(1)), lower))
    addresses = some.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    named = F.transform(F.filter(F.split(html, _NOT_NAME), lambda x: x.contains(".")), lambda x: F.btrim(lower(x), F.lit(".")))
    names = some.select(F.col("host").alias("src"), F.explode(F.array_distinct(named)).alias("dst")).distinct()
    hosts = some.select("host").distinct()
    chain = F.when(F.col("host").rlike(r"^[0-9.]+(:[0-9]*)?$"), F.array("host")).otherwise(F.slice(suffixes(F.col("host")), 1, F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1))))
    chains = hosts.select(chain.alias("names"))
    known = chains.select(F.explode("names").alias("dst")).distinct()
    up = chains.select(F.explode(F.arrays_zip(F.slice("names", 1, F.size("names") - 1).alias("src"), F.slice("names", 2, F.size("names")).alias("dst"))).alias("e")).select("e.src", "e.dst")
    return addresses.union(names.join(known, "dst", "left_semi").select("src", "dst")).union(up).union(up.select("dst", "src")).where("src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, mass: int = MASS, damping: int = DAMPING) -> DataFrame:
    """(kind, host, rank) of hosts that rank reaches. seeds: kind ('trust' or 'distrust'), host.

    A round passes on only what the round before it brought, divided among a host's edges; a host without edges in the
    kind's direction keeps it. Every host has an edge to itself that carries what it has so far, so that a round is one join
    and one aggregate by host; ROUNDS of them are settled together. Rounds end when nothing is left to pass on."""
    tagged = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    tagged = tagged.join(tagged.groupBy("kind", "src").agg(F.count("*").alias("out")), ["kind", "src"])
    hosts = edges.select(F.explode(F.array("src", "dst")).alias("src")).union(seeds.select("host")).distinct()
    itself = hosts.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), "src", F.col("src").alias("dst"), F.lit(0).cast("bigint").alias("out"))
    tagged = few(settle(tagged.union(itself), "host-edges").withColumnRenamed("src", "host"))
    state = seeds.join(F.broadcast(seeds.groupBy("kind").agg(F.count("*").alias("n"))), "kind").select("kind", "host", F.expr(f"{mass} div n").alias("fresh"), F.expr(f"{mass} div n").alias("rank"))
    while True:
        for _ in range(ROUNDS):
            own = F.col("out") == 0
            flow = state.join(tagged, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.when(own, 0).otherwise(F.expr(f"{damping} * (fresh div nullif(out, 0))")).alias("part"), F.when(own, F.col("rank")).otherwise(0).alias("rank"))
            state = flow.groupBy("kind", "host").agg(F.expr("sum(part) div 100").alias("fresh"), F.sum("rank").alias("rank")).withColumn("rank", F.col("rank") + F.col("fresh")).where("rank > 0")
        state = settle(state, "host-rank")
        if state.where("fresh > 0").isEmpty():
            return state.drop("fresh")


def _by_host(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """pages with the columns of judged (host, ...), null where it lacks the host. A host may have any number of pages."""
    judged = settle(judged, "host-verdicts")
    small = few(judged)
    if small is not judged:
        return pages.join(small, "host", "left")
    salted = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = (), url: str = "url", html: str = "html", id: str = "page_id", mass: int = MASS) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    Seeds come from the rules: a host most of whose pages block rules decide is blocked; one of the others, of which allow
    rules decide more pages than block rules do, is trusted. Hosts of the graph under a name of `blocked` (from a list that the caller keeps; a name
    may end in .* for any top-level domain) are blocked seeds too, never trusted ones. Without a rule the verdict is the
    host's: block if distrust reaches BLOCK_FROM hundredths of its rank, else allow; a host that neither rank reaches is
    allowed, and so is an empty host. Null urls have an empty host and path; repeated rows are judged each and null ids
    stay; other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    base = pages.select(F.col(f"`{id}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{html}`").alias("html"))
    ruled = with_rules(base.select("page_id", "host", "path"), rules)
    bad = reduce(lambda a, b: a | b, [under(F.col("host"), h) for h in blocked], F.lit(False))
    n = lambda said: F.count_if(F.col("said") == said)
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), n("allow").alias("allowed"), n("block").alias("blocked"))
    seeds = seeds.select("host", F.when(bad | (2 * F.col("blocked") > F.col("pages")), "distrust").when(F.col("allowed") > F.col("blocked"), "trust").alias("kind")).where("kind is not null")
    edges = settle(host_edges(base), "host-links")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("host")).where(bad).select("host", F.lit("distrust").alias("kind"))
    rank = propagate(edges, settle(seeds.union(nodes).distinct(), "host-seeds"), mass)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0))
    score = rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    score = score.where(f"distrust > 0 and distrust * 100 >= {BLOCK_FROM} * (trust + distrust)").select("host", F.lit("block").alias("judged"))
    return _by_host(ruled, score).select("page_id", "host", "path", "rule", F.coalesce("said", "judged", F.lit("allow")).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fits = lambda n, p: f"((host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(n, p)} THEN '{pick(v, n, p)}'" for v, n, p in longest) + " END"
    found = f"translate(unnest(regexp_extract_all(coalesce(html, ''), '{_ADDRESS.replace(chr(39), chr(39) * 2)}', 1)), '{_UPPER}', '{_LOWER}')"
    named = f"trim(translate(unnest(list_filter(string_split_regex(coalesce(html, ''), '{_NOT_NAME}'), lambda x: contains(x, '.'))), '{_UPPER}', '{_LOWER}'), '.')"
    return f"""
WITH RECURSIVE split AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), base AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM split
), ruled AS (SELECT page_id, host, path, {case(lambda v, n, p: n + p)} AS rule, {case(lambda v, n, p: v)} AS said FROM base
), chains AS (SELECT list_transform(range(1, CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]*)?$') THEN 2 ELSE greatest(len(l), 2) END), lambda k: CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]*)?$') THEN host ELSE array_to_string(l[k:], '.') END) AS names
  FROM (SELECT DISTINCT host, string_split(host, '.') AS l FROM base WHERE host <> '')
), up AS (SELECT names[k] AS src, names[k + 1] AS dst FROM (SELECT names, unnest(range(1, len(names))) AS k FROM chains)
), edges AS (SELECT DISTINCT src, dst FROM (
    SELECT host AS src, {found} AS dst FROM base WHERE host <> ''
    UNION ALL SELECT * FROM (SELECT host AS src, {named} AS dst FROM base WHERE host <> '') WHERE dst IN (SELECT unnest(names) FROM chains)
    UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> dst
), directed AS (SELECT 'trust' AS kind, src, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges
), tagged AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS n FROM directed
), seeds AS (SELECT host, CASE WHEN 2 * count(*) FILTER (said = 'block') > count(*) THEN 'distrust' WHEN count(*) FILTER (said = 'allow') > count(*) FILTER (said = 'block') THEN 'trust' END AS kind
  FROM ruled WHERE host <> '' GROUP BY host
), flow AS (SELECT kind, host, {MASS} // count(*) OVER (PARTITION BY kind) AS rank, 0 AS k FROM seeds WHERE kind IS NOT NULL
  UNION ALL SELECT * FROM (SELECT f.kind, t.dst, (sum({DAMPING} * (f.rank // t.n)) // 100)::BIGINT AS rank, f.k + 1 FROM flow f JOIN tagged t ON t.kind = f.kind AND t.src = f.host GROUP BY f.kind, t.dst, f.k) WHERE rank > 0
), score AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM flow GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN s.distrust > 0 AND s.distrust * 100 >= {BLOCK_FROM} * (s.trust + s.distrust) THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN score s USING (host)
"""


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES = {"op10_url_filters": _oracle()}
