"""URL filter: configured rules first, then an empirical-Bayes reputation of the host.

Labelled pages are successes and failures. The bad rate of a suffix is shrunk towards that of all
pages, of a registered domain towards its suffix, and of a host towards its domain, by beta-binomial
priors whose strengths are moment estimates from the groups of each level. A host is blocked if the
lower bound of its posterior bad rate is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.sources.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second labels under which two-letter countries register names: with the country they are the suffix.
SECOND = "ac|co|com|edu|gen|go|gob|gouv|gov|govt|gv|id|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch|web"
#: Bounds on a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: A host is blocked if mean - Z standard deviations of its posterior exceeds LIMIT.
Z, LIMIT = 1.645, 0.5
#: Blocked hosts up to this many (about 50 bytes each) are broadcast; beyond, they are joined by shuffle.
MOST_BROADCAST = 500_000


def with_host(pages: DataFrame, url: str) -> DataFrame:
    """Adds host (lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1),
        }
    )


def by_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, ``host/path``) pairs, and its verdict; else nulls.

    A rule fits its host and subdomains if the path starts with the rule's. The list is configured
    by hand; each rule is one branch of an expression, so it should have hundreds of rules at most.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _levels(host: Column, suffixes: list[str] | tuple = ()) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user, port and final dots. An address is its own domain, with no suffix.

    The suffix is the last label, or the last two under a country's SECOND label. ``suffixes`` are rules
    that come before these: ``a.b``, ``*.b`` (any label before) and ``!a.b`` (not a suffix, whatever
    ``*.b`` says). An exception wins, then the longest; each is one branch of an expression.
    """
    name = F.regexp_replace(host, r"\A.*@", "")
    name = F.when(name.startswith("["), F.regexp_extract(name, r"\A\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(name, r":[0-9]*\z", ""))
    name = F.regexp_replace(name, r"\.+\z", "")
    address = name.contains(":") | name.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    labels = F.when(name.rlike(rf"(\A|\.)({SECOND})\.[a-z]{{2}}\z"), F.lit(2)).otherwise(F.lit(1))
    for rule in sorted(suffixes, key=lambda r: (r.startswith("!"), r.count("."), r)):
        plain = rule.lstrip("!").removeprefix("*.")
        many = plain.count(".") + (1 if rule[0] not in "!*" else 2 if rule[0] == "*" else 0)
        fits = name.endswith(f".{plain}") if rule[0] == "*" else (name == plain) | name.endswith(f".{plain}")
        labels = F.when(fits, F.lit(many)).otherwise(labels)
    last = lambda n: F.call_function("substring_index", name, F.lit("."), -n)
    return F.when(address, name).otherwise(last(labels + 1)), F.when(address, F.lit("")).otherwise(last(labels))


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the mean bad rate and the prior's strength, from groups with n and bad."""
    seen = groups.filter("n > 0")
    total = seen.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("K"), F.sum(F.col("n") * F.col("n")).alias("Q"))
    total = total.withColumn("m", F.coalesce(F.try_divide("B", "N"), F.lit(0.0)))
    spread = seen.join(F.broadcast(total.select("m"))).agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("S"))
    v = F.col("m") * (1 - F.col("m"))
    rho = F.try_divide(F.col("S") - (F.col("K") - 1) * v, v * (F.col("N") - F.try_divide("Q", "N") - (F.col("K") - 1)))
    strength = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))
    return total.join(spread).select("m", strength.alias("s"))


def _shrunk(groups: DataFrame, parent: DataFrame | None, key: str | None) -> DataFrame:
    """groups with ``mean`` and ``weight`` of their posteriors; ``parent`` gives prior means by ``key``."""
    s = _strength(groups)
    if parent is None:
        rows = groups.join(F.broadcast(s)).withColumn("prior", F.col("m"))
    else:
        rows = groups.join(parent.select(key, F.col("mean").alias("prior")), key).join(F.broadcast(s.select("s")))
    weight = F.col("s") + F.col("n")
    rows = rows.withColumn("mean", (F.col("prior") * F.col("s") + F.col("bad")) / weight).withColumn("weight", weight)
    return rows.drop("prior", "m", "s")


def host_reputation(pages: DataFrame, suffixes: list[str] | tuple = ()) -> DataFrame:
    """host, n, bad, mean, lower for every host; ``pages`` has host, and n and bad of each page."""
    domain, suffix = _levels(F.col("host"), suffixes)
    hosts = pages.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = materialise(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = _shrunk(suffixes, None, None)
    mid = _shrunk(domains, top, "suffix").drop("suffix")
    low = _shrunk(hosts, mid, "domain")
    lower = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return low.withColumn("lower", lower)


def url_filter(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", suffixes: list[str] | tuple = ()
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    ``labels``: page_id and bad (true or false); null ids and null outcomes don't count, several
    outcomes of a page all do. A page without a host takes part like a host named ''. Repeated
    rows are each judged alone. ``suffixes``: rules as of _levels. Without any label nothing is blocked by reputation. The HTML and
    other columns aren't read.
    """
    rows = with_host(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), "url").drop("url")
    known = labels.filter("page_id is not null and bad is not null").groupBy("page_id")
    known = known.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    # Outcomes are summed by host before anything is dealt by host.
    seen = rows.join(known, "page_id", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    blocked = materialise(host_reputation(seen, suffixes).filter(F.col("lower") > LIMIT).select("host", F.lit(True).alias("blocked")), "blocked")
    if blocked.count() <= MOST_BROADCAST:
        blocked = F.broadcast(blocked)
    rule, verdict = by_rule(rules)
    learned = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    judged = rows.join(blocked, "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))
