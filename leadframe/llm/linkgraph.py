"""URL verdicts from rules and from trust and distrust propagated over the host graph, in DataFrame operations only.

A rule is a host, a path prefix and a verdict; it fits the host and its subdomains if the url's path starts with the
prefix, and the longest rule that fits decides its page. Hosts get the shares of their pages that rules allow and block as
seeds. Trust is a personalised PageRank from the allowed seeds along links; distrust runs the same way against the links
from the blocked seeds, so whoever links to a blocked host is suspect. A page without a rule is blocked if its host has
more distrust than trust.

Propagation goes on until at most RESIDUAL of each seed's mass is still under way: a round passes on the damping's part of
it, so the number of rounds follows from the two (29 for 1 % at 0.85). Hosts within that many links of a seed are reached.

Links are absolute or scheme-relative href targets in the html, and a host is also linked, both ways, with the nearest
enclosing host that occurs (www.a.org with a.org). A host without links passes nothing on.

Defined cases: host and path are empty where the url is null or has no "://"; such pages count as the host "", which has no
links. Null html has no links. Repeated rows are judged each and weigh each in the seeds. An empty table gives an empty
result. Pages and urls of any length are read whole, in linear time. Of rules of equal length, block wins, then the smaller text. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Possessive, so that no page takes more than linear time; nothing that follows a repetition can begin with what it repeats.
LINK = r"(?i)href\s*+=\s*+[\"']?+\s*+(?:[a-z][a-z0-9+.\-]*+:)?//([^/?#\"'\s<>]++)"
#: Fixed value: the most bytes of a host name in the DNS. A longer one encloses no host and is enclosed by none.
LONGEST_NAME = 253
DAMPING, RESIDUAL, DIGITS, SALTS = 0.85, 0.01, 12, 32
#: The links of a host with more than this many are dealt over several tasks in every round.
HUB = 100_000

Rule = tuple[str, str, str]  # host, path prefix, "allow" or "block"


def located(url: Column) -> tuple[Column, Column]:
    """(host, path): empty where the url is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text or null, its verdict or null). The list of rules is code, not data: it is meant to be short."""

    def fits(rule: Rule) -> Column:
        return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))

    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    first = lambda value: F.coalesce(F.lit(None).cast("string"), *(F.when(fits(r), F.lit(value(r))) for r in order))
    return first(lambda r: r[0] + r[1]), first(lambda r: r[2])


def host_links(pages: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts, with their number of pages."""
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))))
    found = pages.where(F.col("host") != "").select(F.col("host").alias("src"), target.alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").count().withColumnRenamed("count", "n")
    hosts = pages.select("host").where(F.col("host") != "").distinct()
    label = F.split("host", r"\.")
    outer = F.explode(F.transform(F.sequence(F.lit(2), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), ".")))
    enclosed = hosts.where((F.octet_length("host") <= LONGEST_NAME) & (F.size(label) > 1)).select(F.col("host").alias("inner"), outer.alias("host")).join(hosts, "host")
    nearest = enclosed.groupBy("inner").agg(F.max_by("host", F.length("host")).alias("outer"))
    both = F.explode(F.array(F.struct(F.col("inner").alias("src"), F.col("outer").alias("dst")), F.struct(F.col("outer").alias("src"), F.col("inner").alias("dst"))))
    related = nearest.select(both.alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("n"))
    return found.unionByName(related).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def rounds_for(damping: float, residual: float) -> int:
    """Rounds after which at most `residual` of the seeds' mass hasn't come to rest."""
    return max(1, math.ceil(math.log(residual) / math.log(damping)))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL, hub: int = HUB) -> DataFrame:
    """(kind, host, score) from links (src, dst, n) and seeds (kind, host, score): trust along links, distrust against them.

    A host's links are parted by a hash of their other end, in as many parts as its number of links asks for; its score is
    copied to those parts only."""
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    steps = forward.unionByName(backward)
    total = durable(steps.groupBy("kind", "host").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / hub).alias("parts")))
    part = F.pmod(F.xxhash64("to"), F.col("parts")).alias("part")
    steps = durable(steps.join(total, ["kind", "host"]).select("kind", "host", part, "to", (F.lit(damping) * F.col("n") / F.col("all")).alias("share")))
    parts = total.select("kind", "host", "parts")
    seeds = durable(seeds)
    base = seeds.withColumn("score", F.lit(1 - damping) * F.col("score"))
    now = seeds
    for round_ in range(1, rounds_for(damping, residual) + 1):
        copies = now.join(parts, ["kind", "host"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        passed = copies.join(steps, ["kind", "host", "part"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        now = passed.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if round_ % 5 == 0:
            now = durable(now)
    return now


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, by_rule)."""
    host, path = located(F.col("_url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    placed = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).withColumns({"host": host, "path": path})
    marked = placed.select("_id", "host", "path", rule.alias("rule"), verdict.alias("by"))

    shares = marked.groupBy("host").agg(*(F.avg((F.coalesce("by", F.lit("")) == v).cast("double")).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))))
    seed = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col("host"), F.col(k).alias("score")) for k in ("trust", "distrust"))))
    seeds = shares.where(F.col("host") != "").select(seed.alias("s")).select("s.*").where("score > 0")
    reached = propagate(host_links(placed, "_html"), seeds)
    of = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)), DIGITS)
    suspects = reached.groupBy("host").agg((of("distrust") > of("trust")).alias("suspect")).where("suspect")

    # A host may hold a third of all pages: its pages are dealt over SALTS partitions, and each host copied to all of them.
    dealt = marked.withColumn("salt", F.pmod(F.xxhash64("_id", "path"), F.lit(SALTS)))
    copies = suspects.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    judged = dealt.join(copies, ["host", "salt"], "left")
    return judged.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("by", F.when(F.col("suspect"), "block").otherwise("allow")).alias("verdict"),
        F.col("by").isNotNull().alias("by_rule"),
    )


def oracle(rules: list[Rule], damping: float = DAMPING, residual: float = RESIDUAL) -> str:
    """The same in DuckDB SQL over a table `pages`."""
    rounds = rounds_for(damping, residual)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    case = lambda value: "case " + " ".join(f"when (host = {quote(h)} or ends_with(host, {quote('.' + h)})) and starts_with(path, {quote(p)}) then {quote(value((h, p, v)))}" for h, p, v in order) + " end"
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    step = lambda now: f"""(select kind, host, sum(score) as score from (
        select s.kind, s."to" as host, n.score * s.share as score from {now} n join steps s on s.kind = n.kind and s.host = n.host
        union all select kind, host, {1 - damping!r}::double * score from seeds) u group by kind, host)"""  # noqa: E731
    link = LINK.replace("*+", "*").replace("?+", "?").replace("++", "+").replace("'", "''")  # this engine never backtracks
    ctes = [
        "split as (select page_id, html, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages)",
        f"placed as (select page_id, html, {lower("regexp_extract(rest, '^[^/?#]*', 0)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split)",
        f'marked as (select page_id, host, path, {case(lambda r: r[0] + r[1])} as rule, {case(lambda r: r[2])} as "by" from placed)',
        """shares as (select host, avg(case when "by" = 'allow' then 1.0::double else 0.0::double end) as trust, avg(case when "by" = 'block' then 1.0::double else 0.0::double end) as distrust from marked group by host)""",
        "seeds as (select 'trust' as kind, host, trust as score from shares where host <> '' and trust > 0 union all select 'distrust', host, distrust from shares where host <> '' and distrust > 0)",
        f"targets as (select host as src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) as dst from placed where host <> '')",
        f"found as (select src, dst, count(*) as n from (select src, {lower('dst')} as dst from targets) t where src <> dst group by src, dst)",
        "hosts as (select distinct host from placed where host <> '')",
        f"enclosed as (select i.host as inner_host, o.host as outer_host, row_number() over (partition by i.host order by length(o.host) desc) as k from hosts i join hosts o on ends_with(i.host, '.' || o.host) where strlen(i.host) <= {LONGEST_NAME})",
        "links as (select src, dst, sum(n) as n from (select * from found union all select inner_host, outer_host, 1 from enclosed where k = 1 union all select outer_host, inner_host, 1 from enclosed where k = 1) l group by src, dst)",
        "ways as (select 'trust' as kind, src as host, dst as \"to\", n from links union all select 'distrust', dst, src, n from links)",
        f'steps as (select kind, host, "to", {damping!r}::double * n / sum(n) over (partition by kind, host) as share from ways)',
        "r0 as (select * from seeds)",
        *(f"r{i} as materialized {step(f'r{i - 1}')}" for i in range(1, rounds + 1)),
        f"suspects as (select host from r{rounds} group by host having round(sum(case when kind = 'distrust' then score else 0 end), {DIGITS}) > round(sum(case when kind = 'trust' then score else 0 end), {DIGITS}))",
    ]
    body = "select page_id, host, path, rule, coalesce(\"by\", case when host in (select host from suspects) then 'block' else 'allow' end) as verdict, \"by\" is not null as by_rule from marked"
    return "with " + ",\n".join(ctes) + "\n" + body
