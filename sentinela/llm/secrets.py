"""Secret scans: three fixed shapes, and strings that a primed compressor cannot predict.

A candidate of the novelty scan is a long run of key characters with a letter, after a word that announces something
sensitive. The text around it is compressed by zstandard with a dictionary of common code and identifiers, once with the
candidate and once without; the difference is what the candidate itself costs. Strings made of known words and of what
stands beside them cost little. What a random string costs depends on its alphabet and length, so random strings of the
candidate's own are measured in its place, and a candidate that costs at least `NOVELTY` of their mean is reported, unless
its pairs of characters are those of words: names that no dictionary holds cost as much as short random strings.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.license_scan import TEMPLATES

KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|credential|auth|bearer|private|signature|login|salt", re.IGNORECASE | re.ASCII)
AROUND = 96
NOVELTY = 0.75
# Random strings that a candidate is compared with; of a longer candidate than LONGEST, strings of LONGEST.
RIVALS = 6
LONGEST = 2048
# Standard deviations below the mean of random strings from which pairs of characters are those of words.
WORDLIKE = 3.0

# Identifiers and lines that are common in source code and settings.
COMMON = """
import os import sys import json import re from typing import Any Dict List Optional def __init__(self, return None True False
public static void main(String[] args) private final class interface extends implements package throws Exception new
function const let var export default require module.exports async await promise console.log document window undefined null
#include <stdio.h> #include <stdlib.h> int main(int argc, char **argv) struct typedef unsigned long size_t sizeof malloc free
SELECT FROM WHERE GROUP BY ORDER BY INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE PRIMARY KEY NOT NULL DEFAULT
username user_name password passwd secret token api_key apikey access_key access_token refresh_token client_id client_secret
authorization bearer basic credential credentials private_key public_key session_id request response headers content-type
application/json text/html charset=utf-8 http://localhost:8080/ https://www.example.com/index.html /usr/local/bin /etc/config
connection_string database hostname localhost port timeout max_connections retry_count default_value configuration settings
environment development production staging version description repository dependencies license author maintainer
getElementById addEventListener querySelector innerHTML className onclick background-color font-size margin padding border
placeholder example changeme your_api_key_here INSERT_TOKEN_HERE xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef 127.0.0.1 0.0.0.0 255.255.255.0 2001-01-01T00:00:00Z
""".encode()

SPANS = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"


def novelty_meter():
    """A function from (text before, candidate, text after) to the candidate's marginal compressed bytes per character."""
    packer = zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(COMMON, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=12,
        write_checksum=False, write_content_size=False, write_dict_id=False)

    @lru_cache(maxsize=1)
    def alone(context: bytes) -> int:
        """The rivals of a candidate are measured in its own context."""
        return len(packer.compress(context))

    def novelty(before: str, candidate: str, after: str) -> float:
        context = (before + " " + after + " ").encode()
        return (len(packer.compress(context + candidate.encode())) - alone(context)) / len(candidate)

    return novelty


def alphabet(value: str) -> str:
    """The characters that a string like `value` is drawn from: digits and a to f of one case, or all classes it has."""
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if not set(value) - set(digits):
            return digits
    classes = [c for c in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if not set(c).isdisjoint(value)]
    return "".join(classes + sorted(c for c in set(value) if not c.isalnum()))


@lru_cache(maxsize=512)
def _rivals(letters: str, size: int) -> list[str]:
    return ["".join(random.Random(f"{letters} {size} {i}").choices(letters, k=size)) for i in range(RIVALS)]


def share_of_random(novelty, before: str, value: str, after: str) -> float:
    """The novelty of `value` as a share of the mean novelty of random strings of its alphabet and length."""
    rivals = _rivals(alphabet(value), min(len(value), LONGEST))
    return novelty(before, value, after) * len(rivals) / sum(novelty(before, x, after) for x in rivals)


def _folded(character: str) -> str:
    return "0" if character.isdigit() else character.lower()


@lru_cache(maxsize=1)
def _pair_bits() -> dict[str, float]:
    """Bits of the second of two letters or digits after the first, in common code and prose; digits count as one."""
    text = "".join(_folded(c) for c in " ".join([COMMON.decode(), *TEMPLATES.values()]))
    symbols = string.ascii_lowercase + "0"
    counts = {a + b: 0.1 for a in symbols for b in symbols}
    for a, b in zip(text, text[1:]):
        if a + b in counts:
            counts[a + b] += 1
    sums = {a: sum(counts[a + b] for b in symbols) for a in symbols}
    return {pair: -math.log2(n / sums[pair[0]]) for pair, n in counts.items()}


@lru_cache(maxsize=512)
def _random_pairs(letters: str) -> tuple[float, float]:
    """Mean and standard deviation of the bits of a random pair of letters or digits of an alphabet."""
    known = [_folded(c) for c in letters if c.isalnum()]
    bits = [_pair_bits()[a + b] for a in known for b in known]
    mean = sum(bits) / len(bits)
    return mean, math.sqrt(sum((x - mean) ** 2 for x in bits) / len(bits))


def wordlike(value: str) -> bool:
    """Whether the pairs of characters of `value` are far likelier in words than those of random strings are."""
    folded = [_folded(c) if c.isalnum() else "" for c in value]
    bits = [_pair_bits()[a + b] for a, b in zip(folded, folded[1:]) if a and b]
    mean, deviation = _random_pairs(alphabet(value))
    return sum(bits) - mean * len(bits) < -WORDLIKE * deviation * math.sqrt(len(bits))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three fixed shapes; leftmost and non-overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)])


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty) -> list[tuple[int, int, int]]:
    """(start, end, 3) of candidates beside a sensitive word that touch no base span and that the meter cannot predict.

    `base` is sorted. Among the spans that start before a candidate ends, the one that reaches furthest tells if any touches it.
    """
    found = []
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        value = m[0]
        if not any(c.isalpha() for c in value):
            continue
        before = text[max(0, begin - AROUND) : begin]
        earlier = bisect_left(starts, end)
        if not SENSITIVE.search(before) or (earlier and reach[earlier - 1] > begin):
            continue
        if not wordlike(value) and share_of_random(novelty, before, value, text[end : end + AROUND]) >= NOVELTY:
            found.append((begin, end, 3))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = novelty_meter()
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            rows, spans = batch.slice(begin, 1000), []
            for text in rows.column("text").to_pylist():
                base = base_spans(text or "")
                every = sorted(base + novel_spans(text or "", base, novelty))
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"),
                pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of `docs` (doc_id, text; other columns are ignored), spans by start, then kind.

    A span is (kind, start, end) in code points, end exclusive. Null and empty texts have no spans, repeated rows are scanned
    each, null ids stay null, an empty table gives an empty one. A text is scanned whole, in time linear in its length.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, SPANS)


def _redact(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = novelty_meter()
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    parts, done = [], 0
                    for a, b, k in sorted(base + novel_spans(text, base, novelty)):
                        if b > done:
                            parts += [text[done:a], mark.format(KINDS[k])] if a >= done else []
                            done = b
                    text = "".join(parts) + text[done:]
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
    return run


def redact_secrets(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """`docs` with each span of its texts, or each stretch of overlapping spans, replaced by `mark` with the kind that
    begins it. Other columns and their order stay; null texts stay null."""
    return docs.mapInArrow(_redact(mark), docs.schema)
