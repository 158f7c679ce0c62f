"""Which links are crawled next, and why the others are not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import Scope
from skein.functions.ids import address_id, host_of
from skein.schemas import URL_CLASSES


def _any(column: Column, patterns: tuple[str, ...], prefix: str) -> Column:
    """Whether one of the patterns matches; a pattern is kept together, whatever alternatives it has."""
    return column.rlike("|".join(f"^{prefix}(?:{p})" for p in patterns)) if patterns else F.lit(False)


def scope_class(url: Column, scope: Scope) -> Column:
    """Class of a URL by the scope lists.

    An included address is taken even from an excluded domain, but an excluded address of an included domain is not
    taken back by it. Other schemes than http and https are out of scope; null is null.
    """
    address = address_id(url)
    host = host_of(address)
    in_domain, out_domain = _any(host, scope.include_domains, ".*"), _any(host, scope.exclude_domains, ".*")
    in_url, out_url = _any(address, scope.include_urls, ""), _any(address, scope.exclude_urls, "")
    of = lambda name: F.lit(URL_CLASSES[name])
    known = F.when(out_domain, F.when(in_url, of("InScope")).otherwise(of("ExcludedDomain"))).when(out_url, of("ExcludeUrl")).otherwise(of("InScope"))
    return (
        F.when(url.isNull(), F.lit(None).cast("int"))
        .when(~url.startswith("http"), of("OutOfScope"))
        .when(in_domain, known)
        .when(in_url, of("InScope"))
        .otherwise(of("OutOfScope"))
    )


def scope_hits(urls: DataFrame, scope: Scope) -> DataFrame:
    """(url, section, pattern): each pattern that matches each URL; the lists are short, so each is one column."""
    address = address_id(F.col("url"))
    host = host_of(address)
    parts = []
    for section, patterns, column, prefix in (
        ("IncludeDomains", scope.include_domains, host, ".*"), ("IncludeUrls", scope.include_urls, address, ""),
        ("ExcludeDomains", scope.exclude_domains, host, ".*"), ("ExcludeUrls", scope.exclude_urls, address, ""),
    ):
        parts += [F.when(column.rlike(f"^{prefix}(?:{p})"), F.struct(F.lit(section).alias("section"), F.lit(p).alias("pattern"))) for p in patterns]
    return urls.select("url", F.explode(F.array_compact(F.array(*parts))).alias("hit")).select("url", "hit.section", "hit.pattern")


def is_spider_trap(address: Column, repeats: int = 3, depth: int = 20) -> Column:
    """A path with more than ``depth`` segments or one segment ``repeats`` times."""
    path = F.regexp_extract(address, "^[^/?#]*/([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    most = F.array_max(F.transform(segments, lambda s: F.size(F.filter(segments, lambda t: t == s))))
    return F.coalesce((F.size(segments) > depth) | (most >= repeats), F.lit(False))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, strict: bool = False) -> DataFrame:
    """The rows with ``allowed``: the longest matching rule of the group that holds for the agent decides, allow wins ties.

    ``urls`` has id and domain, ``rules`` (domain, agent, rule, path) with rule allow or disallow; ``*`` and a final
    ``$`` in paths work as patterns. A group counts if its agent is part of ours, in any letter case, else the group
    ``*``. No group, no matching rule or an empty path allow everything. Not ``strict``: paths in any letter case.
    """
    name = F.lower("agent")
    own = rules.filter((name == "*") | F.lit(agent.lower()).contains(name))
    named = F.max(F.when(name != "*", F.length("agent")).otherwise(0)).over(Window.partitionBy("domain"))
    held = own.withColumn("named", named).filter(F.when(F.col("named") > 0, (name != "*") & (F.length("agent") == F.col("named"))).otherwise(name == "*"))
    path = F.col("path") if strict else F.lower("path")
    ended = path.endswith("$")
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1"), r"\*", ".*")
    rule = F.struct(
        F.concat(F.lit("^"), pattern, F.when(ended, F.lit("$")).otherwise(F.lit(""))).alias("pattern"), F.length("path").alias("weight"), (F.lower("rule") == "allow").alias("allow")
    )
    # the rules of a domain are one file; they meet the rows in one join, and no row is multiplied
    ruled = held.filter("path <> ''").groupBy(F.col("domain").alias("_domain")).agg(F.collect_list(rule).alias("_rules"))
    rest = F.regexp_replace("id", "^[^/?]*", "")
    target = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    target = target if strict else F.lower(target)
    hits = F.filter("_rules", lambda r: F.rlike(target, r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["weight"], r["allow"].alias("allow"))))
    joined = urls.join(ruled, F.col("domain") == F.col("_domain"), "left")
    return joined.withColumn("allowed", F.coalesce(best.getField("allow"), F.lit(True))).drop("_domain", "_rules")


def robots_reasons(urls: DataFrame, rules: DataFrame, agent: str, strict: bool = False) -> DataFrame:
    """Adds robots.txt to robot_exclusion_reasons and, for GoogleBot, to googlebot_exclusion_reasons where a rule forbids the page."""
    for column, name in (("robot_exclusion_reasons", agent), ("googlebot_exclusion_reasons", "GoogleBot")):
        urls = robots_allowed(urls, rules, name, strict)
        held = F.coalesce(F.col(column), F.array().cast("array<string>"))
        urls = urls.withColumn(column, F.when(F.col("allowed"), held).otherwise(F.array_union(held, F.array(F.lit("robots.txt"))))).drop("allowed")
    return urls


def robot_excluded(standard: bool, google: bool) -> Column:
    """Whether a page is left out by the standards the job follows."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return (F.lit(google) & size("googlebot_exclusion_reasons")) | (F.lit(standard) & size("robot_exclusion_reasons"))


def first_reason(*reasons: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds, else null."""
    return reduce(lambda chain, r: chain.when(r[0], r[1]), reasons[1:], F.when(*reasons[0])).otherwise(F.lit(None))


def admit(links: DataFrame, seen: DataFrame, scope: Scope, rules: DataFrame | None = None, agent: str = "", standard: bool = True) -> DataFrame:
    """Each link id once, with ``reason``: null if it is admitted, 0 if seen before, else its class; -8 stands for a spider trap.

    The cheap test comes first: seen, scope, robots, trap. ``seen`` has a column id.
    """
    ids = links.select("id", "link").groupBy("id").agg(F.min("link").alias("link"))
    marked = ids.join(seen.select("id").distinct().withColumn("seen", F.lit(True)), "id", "left")
    marked = marked.withColumn("scope", scope_class(F.col("link"), scope)).withColumn("domain", host_of(F.col("id")))
    if rules is not None:
        marked = robots_allowed(marked, rules, agent)
    allowed = F.col("allowed") if rules is not None else F.lit(True)
    reason = first_reason(
        (F.col("seen").isNotNull(), F.lit(URL_CLASSES["Crawled"])),
        (F.col("scope") != URL_CLASSES["InScope"], F.col("scope")),
        (F.lit(standard) & ~allowed, F.lit(URL_CLASSES["RobotExclusionStandard"])),
        (is_spider_trap(F.col("id")), F.lit(-8)),
    )
    return marked.select("id", "link", "domain", reason.cast("int").alias("reason"))


def skip_redundant(frontier: DataFrame, probed: DataFrame) -> DataFrame:
    """Frontier rows with ``reason``: that a row's id is redundant (id, redundant) comes before any other."""
    joined = frontier.join(probed.filter("redundant").select("id", "redundant"), "id", "left")
    return joined.withColumn("reason", F.when(F.col("redundant"), F.lit(URL_CLASSES["Redundant"])).otherwise(F.col("reason"))).drop("redundant")


def recheck(frontier: DataFrame, scope: Scope, rules: DataFrame, agent: str, filter_all: bool = False) -> DataFrame:
    """Frontier rows with ``reason``: seeds (or all) are held against scope and robots rules again, not against seen or traps.

    ``frontier`` has url and is_seed.
    """
    rows = frontier.withColumn("id", address_id(F.col("url"))).withColumn("domain", host_of(address_id(F.col("url"))))
    rows = robots_allowed(rows, rules, agent)
    scoped = scope_class(F.col("url"), scope)
    tested = F.lit(filter_all) | F.col("is_seed")
    reason = first_reason(
        (tested & (scoped != URL_CLASSES["InScope"]), scoped),
        (tested & ~F.col("allowed"), F.lit(URL_CLASSES["RobotExclusionStandard"])),
    )
    return rows.withColumn("reason", reason.cast("int")).drop("allowed")
