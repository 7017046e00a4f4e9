"""Cleaning of news and narrative text."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that try to instruct the reader's model, English and Portuguese.
INJECTION_ENGLISH = [
    r"\b(ignore|disregard)\s+(previous|all)\s+instructions\b",
    r"\bact\s+as\b",
    r"\byou\s+are\s+now\b",
    r"\bdisregard\s+the\s+previous\b",
    r"\boverride\s+(previous\s+)?instructions\b",
]
INJECTION_PORTUGUESE = [
    r"\b(?:ignore|desconsidere|desobede[çc]a)\s+(?:todas\s+as\s+|as\s+)?(?:instru[çc][õo]es|regras|ordens)\s+"
    r"(?:anteriores|pr[ée]vias|previas|acima|do\s+sistema)\b",
    r"\bdesconsidere\s+(?:tudo\s+)?o\s+(?:que\s+foi\s+dito|texto|conte[úu]do)\s+(?:acima|anterior)\b",
    r"\baja\s+como\b",
    r"\bassuma\s+o\s+papel\b",
    r"\bvoc[êe]\s+[ée]\s+agora\b",
]
# The first two letters of the phrases.
INJECTION_LETTERS = "[adiovy][cegijosv]"
# Markers around the news block.
BLOCK_START = "{{NEWS_CONTENT_START}}"
BLOCK_END = "{{NEWS_CONTENT_END}}"


NUMBER_RUN = r"\p{Nd}[\p{Nd}.,%]*"

# White space of every script, from the character properties.
WHITE_SPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_injection(text: Column) -> Column:
    """Whether a text holds any of the phrases, in either language and any case."""
    # Every phrase starts at a word boundary, so that is tested once and not once per phrase, and only where two letters stand
    # that may begin one.
    phrases = [p.removeprefix(r"\b") for p in INJECTION_ENGLISH + INJECTION_PORTUGUESE]
    return text.rlike(rf"(?iU)(?={INJECTION_LETTERS})\b(?:{'|'.join(phrases)})")


def strip_injection(text: Column) -> Column:
    """Take the phrases out one pattern after another, then tidy the white space."""
    removed = reduce(
        lambda t, p: F.regexp_replace(t, f"(?iU){p}", ""), INJECTION_ENGLISH + INJECTION_PORTUGUESE, text
    )
    collapsed = strip_space(F.regexp_replace(removed, r"(?U)\s{2,}", " "))
    return F.regexp_replace(collapsed, r"(?U)\s+([.,;])", "$1")


def strip_markers(text: Column) -> Column:
    bare = F.replace(text, F.lit(BLOCK_START), F.lit(""))
    return F.replace(bare, F.lit(BLOCK_END), F.lit(""))


def variant_text(value: Column) -> Column:
    """A JSON value as text: an explicit null reads None, truth values True and False. NULL for a missing value."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.is_variant_null(value), "None").when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def content_text(content: Column) -> Column:
    """Text of a model answer: plain, or a JSON list of blocks joined by line breaks.

    An object block gives its `text`, or its own JSON where it has none; a string block gives itself.
    """
    parsed = F.when(content.startswith("["), F.try_parse_json(content))
    blocks = F.variant_get(parsed, "$", "array<variant>")

    def block_text(block: Column) -> Column:
        kind = F.schema_of_variant(block)
        inner = F.try_variant_get(block, "$.text", "variant")
        spelled = variant_text(inner)
        return F.when(kind == "STRING", F.variant_get(block, "$", "string")).otherwise(
            F.coalesce(spelled, F.to_json(block))
        )

    joined = F.array_join(F.transform(blocks, block_text), "\n")
    return F.when(parsed.isNotNull(), joined).otherwise(content)


def _without_urls(text: Column, urls: Column) -> Column:
    """Delete `urls` one after another, each wherever it stands; a slash after it stays.

    A URL stands only where `http://` or `https://` does, so the text is cut there once, and the beginning of each piece, as
    long as some URL is, is looked up among them. They lie in as many buckets as the root of their number, by hash. If more
    than one begins a piece, the first of the list is deleted. A URL with another one inside would be cut itself; lists with
    such a one go over the text once per URL.
    """
    def bound(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def looked_up(x: Column) -> Column:
        slot = lambda u: F.pmod(F.xxhash64(u), x["n"]).cast("int")
        numbered = F.transform(x["urls"], lambda u, k: F.struct(k.alias("k"), u.alias("u"), slot(u).alias("slot")))
        lengths = F.array_distinct(F.transform(x["urls"], F.length))

        def piece(c: Column, y: Column) -> Column:
            found = lambda m: F.get(F.filter(F.get(y["buckets"], slot(m)), lambda e: e["u"] == m), F.lit(0))
            first = F.array_min(F.filter(F.transform(y["lengths"], lambda n: found(F.left(c, n))), lambda e: e.isNotNull()))
            return bound(first, lambda e: F.when(e.isNull(), c).otherwise(F.substring(c, F.length(e["u"]) + 1, F.length(c))))

        def in_buckets(of: Column) -> Column:
            buckets = F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda b: F.filter(of, lambda e: e["slot"] == b))
            pieces = lambda y: F.transform(F.split(x["t"], "(?=https?://)", -1), lambda c: F.when(c.startswith("http"), piece(c, y)).otherwise(c))
            return bound(F.struct(buckets.alias("buckets"), lengths.alias("lengths")), lambda y: F.array_join(pieces(y), ""))

        return bound(numbered, in_buckets)

    def one_by_one(t: Column, url: Column) -> Column:
        return F.replace(t, url, F.lit(""))

    nested = F.exists(urls, lambda u: F.substring(u, 2, 1 << 30).rlike("https?://"))
    start = F.struct(text.alias("t"), F.ceil(F.sqrt(F.size(urls))).cast("int").alias("n"), urls.alias("urls"))
    return F.when(nested, F.aggregate(urls, text, one_by_one)).otherwise(bound(start, looked_up))


def strip_mismatches(text: Column, raws: Column, urls: Column) -> Column:
    """Delete flagged numbers and URLs wherever they occur, then tidy spaces and line breaks.

    A number is deleted only where no digit touches it; every copy goes, whether or not that copy was flagged.
    A deletion cannot put a new copy together, since no digit stood on either side, so each spelling is
    deleted once. A spelling lies within one run of digits, points, commas and percent signs, so the text is
    cut at these runs once, and each run only meets the spellings it contains.
    """

    def without(run: Column, found: Column) -> Column:
        return F.aggregate(
            F.filter(found, lambda raw: F.contains(run, raw)), run,
            lambda t, raw: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{Nd})\Q"), raw, F.lit(r"\E(?!\p{Nd})")), F.lit("")))

    def joined(cut: Column) -> Column:
        return F.array_join(F.transform(cut["gaps"], lambda g, i: F.concat(g, F.coalesce(without(F.get(cut["runs"], i), cut["raws"]), F.lit("")))), "")

    # bound once, as a lambda's variable, or the text would be cut again for each of its pieces
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(NUMBER_RUN), F.lit(0)).alias("runs"), F.split(text, NUMBER_RUN, -1).alias("gaps"),
        F.array_distinct(raws).alias("raws"))
    cleaned = F.when(F.size(raws) > 0, F.get(F.transform(F.array(cut), joined), F.lit(0))).otherwise(text)

    without_urls = F.when(F.size(urls) > 0, _without_urls(cleaned, urls)).otherwise(cleaned)
    spaced = F.regexp_replace(F.regexp_replace(without_urls, " {2,}", " "), r"\n{3,}", "\n\n")
    return strip_space(spaced)
