"""URLs cited in a text, and the hosts and tiers of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a URL ends at white space, a closing parenthesis or a quote.
URL = r"""(?U)https?://[^\s)"']+"""


def normalize_url(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def cited_urls(text: Column) -> Column:
    """Distinct URLs of a text in sorted order, without closing punctuation or slashes."""
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    clean = F.transform(found, lambda u: normalize_url(F.rtrim(u, F.lit(".,)"))))
    return F.when(text.contains("http"), F.array_sort(F.array_distinct(clean))).when(
        text.isNotNull(), F.array().cast("array<string>")
    )


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def all_domains(domains: dict[str, list[str]]) -> list[str]:
    """Every listed domain, tier by tier."""
    return [n for names in domains.values() for n in names]


def domain_tier(host: Column, domains: dict[str, list[str]]) -> Column:
    """(domain, tier) of the longest listed domain that is the host or a parent of it, or NULL.

    The list is configuration of a few names, so it is held in the expression: each parent of the host,
    longest first, is looked up in it. No join and no comparison of every host with every name.
    """
    listed = F.create_map(*[F.lit(x) for tier, names in domains.items() for n in names for x in (n, tier)])
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    match = F.get(F.filter(parents, lambda p: F.map_contains_key(listed, p)), F.lit(0))
    return F.struct(match.alias("domain"), F.try_element_at(listed, match).alias("tier"))
