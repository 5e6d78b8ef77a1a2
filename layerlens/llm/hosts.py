"""Host reputation by empirical Bayes, and url rules.

Labelled pages are good or bad. The rate of good pages is estimated per suffix, registered
domain and host, each level shrunk towards the one above by a beta prior. How strong the prior
is follows from the data: by the method of moments, from how much more the groups of a level
differ from their parents than chance allows. A host is blocked when even an upper bound of its
posterior rate lies below the threshold; a host without labels inherits its parent's posterior.

Counts are partial aggregates, so a hot host is one row before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from layerlens.llm.common import fresh

THRESHOLD = 0.5
BOUND = 1.645
#: Limits of the correlation within a group, from which the prior's strength 1 / c - 1 follows.
LEAST, MOST = 0.001, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (verdict, rule) of the longest rule that fits, null where none does.

    A rule is ("allow" or "block", "host/path"). The rules are part of the plan: a list that a
    person keeps, not data. Of two verdicts for one rule the first stands.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


# Public suffixes of two names, under which domains are registered, by country.
_SECOND = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt net org school",
    "br": "com edu gov mil net org art blog eco ind inf", "jp": "ac ad co ed go gr lg ne or", "za": "ac co edu gov law net org web",
    "in": "ac co edu firm gen gov ind net nic org res", "kr": "ac co go ne or pe re", "cn": "ac com edu gov net org",
    "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per", "my": "com edu gov net org",
    "mx": "com edu gob net org", "ar": "com edu gob gov net org", "co": "com edu gov net org", "pe": "com edu gob net org",
    "tr": "av bel com edu gov k12 net org web", "il": "ac co gov k12 muni net org", "th": "ac co go in net or",
    "id": "ac co go net or sch web", "ph": "com edu gov net org", "vn": "com edu gov net org", "ua": "com edu gov in net org",
    "pl": "com edu gov net org", "pk": "com edu gov net org", "eg": "com edu gov net org", "ng": "com edu gov net org",
    "ke": "ac co go ne or", "sa": "com edu gov net org",
}
SUFFIXES = [f"{name}.{country}" for country, names in _SECOND.items() for name in names.split()]
ADDRESS = r"^([0-9]+([.][0-9]+){3}|\[.*)$"


def levels(host: Column) -> tuple[Column, Column]:
    """The suffix and the registered domain of a host without its port.

    The suffix is one of SUFFIXES or else the last name; the domain has one name more. An IP
    address is its own domain, below one suffix for all of them.
    """
    name = F.regexp_replace(host, ":[0-9]*$", "")
    address, long = name.rlike(ADDRESS), F.substring_index(name, ".", -2).isin(SUFFIXES)
    last = [F.substring_index(name, ".", -n) for n in (1, 2, 3)]
    suffix = F.when(address, F.lit("[ip]")).when(long, last[1]).otherwise(last[0])
    return suffix, F.when(address, name).when(long, last[2]).otherwise(last[1])


def _shrunk(groups: DataFrame, keys: list[str], parent: DataFrame, on: list[str]) -> DataFrame:
    """(keys, a, b): posterior counts of every group, from (keys, n, y) and the parents' a, b."""
    up = parent.select(*on, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    rows = groups.join(up, on) if on else groups.crossJoin(F.broadcast(up))  # one row: the root
    chance = F.col("n") * F.col("m") * (1 - F.col("m"))
    excess = F.sum((F.col("y") - F.col("n") * F.col("m")) ** 2) - F.sum(chance)
    room = F.sum(chance * (F.col("n") - 1))
    fit = rows.where("n > 0").agg(
        F.least(F.greatest(F.coalesce(F.try_divide(excess, room), F.lit(MOST)), F.lit(LEAST)), F.lit(MOST)).alias("c")
    )
    rows = rows.crossJoin(F.broadcast(fit))  # one row
    strength = 1 / F.col("c") - 1
    return rows.select(
        *keys,
        (strength * F.col("m") + F.col("y")).alias("a"),
        (strength * (1 - F.col("m")) + F.col("n") - F.col("y")).alias("b"),
    )


def reputations(pages: DataFrame, outcomes: DataFrame, host: str = "host", page_id: str = "page_id") -> DataFrame:
    """(host, a, b) for every host of the pages; outcomes are (page_id, good 0/1).

    Outcomes of pages that are not there or not labelled 0 or 1 are left out; a page counts as
    often as it is labelled.
    """
    marks = outcomes.where("good in (0, 1)").select(F.col("page_id").alias("marked"), "good")
    per_page = marks.groupBy("marked").agg(F.count("*").alias("n"), F.sum("good").alias("y"))
    rows = pages.select(F.col(page_id).alias("marked"), F.col(host).alias("host")).join(per_page, "marked", "left")
    hosts = rows.groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")
    )
    suffix, domain = levels(F.col("host"))
    hosts = hosts.select("*", suffix.alias("suffix"), domain.alias("domain"))
    total = [F.sum("n").alias("n"), F.sum("y").alias("y")]
    domains = hosts.groupBy("suffix", "domain").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    root = suffixes.agg((F.coalesce(F.sum("y"), F.lit(0)) + 1.0).alias("a"),
                        (F.coalesce(F.sum(F.col("n") - F.col("y")), F.lit(0)) + 1.0).alias("b"))
    of_suffix = _shrunk(suffixes, ["suffix"], root, [])
    of_domain = _shrunk(domains, ["suffix", "domain"], of_suffix, ["suffix"])
    return _shrunk(hosts, ["host"], of_domain, ["suffix", "domain"])


def upper_bound(a: Column, b: Column, width: float = BOUND) -> Column:
    """An upper bound of a beta posterior's rate: mean and `width` deviations."""
    return a / (a + b) + width * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url: str = "url",
          page_id: str = "page_id", threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """All columns and a struct (host, path, rule, bound, verdict) under the returned name.

    A rule that fits decides; else the host's posterior bound does. Null urls and urls without
    `://` have an empty host, judged like any other. Repeated rows are judged alike.
    """
    name, own, parts = fresh(pages, "judged", "own", "parts")
    rows = pages.withColumn(parts, F.struct(host(F.col(url)).alias("host"), path(F.col(url)).alias("path")))
    slim = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"))
    found = reputations(slim, outcomes).select(F.col("host").alias(own), upper_bound(F.col("a"), F.col("b")).alias("bound"))
    joined = rows.join(found.select(own, F.struct("bound").alias(name)), F.col(f"{parts}.host") == F.col(own))
    rule = matching_rule(F.col(f"{parts}.host"), F.col(f"{parts}.path"), rules)
    method = F.when(F.col(f"{name}.bound") < threshold, "block").otherwise("allow")
    verdict = F.struct(
        F.col(f"{parts}.host").alias("host"), F.col(f"{parts}.path").alias("path"), rule["rule"].alias("rule"),
        F.col(f"{name}.bound").alias("bound"), F.coalesce(rule["verdict"], method).alias("verdict"),
    )
    return joined.select(*[f"`{c}`" for c in pages.columns], verdict.alias(name)), name
