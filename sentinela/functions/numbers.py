"""Numbers in Brazilian Portuguese text: tokens, values, and which of them are no quantities.

A text is cut once at its number tokens into gaps and tokens. What lies around a token (the characters
before it, the text after it) is read from the pieces next to it, so the work grows with the text length and
not with tokens times length. The expressions are SQL text: as columns they would be some thousand calls to
the JVM each time one is built.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela.functions.text import WHITE_SPACE, strip_space

# One number token with at most one separator group, no digit on either side. A run of digits
# always matches from its first digit, so nothing need be said about the character before.
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?%?(?!\p{Nd})"
THOUSANDS = r"^\d{1,3}(\.\d{3})+\z"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
CONTEXT_CHARS = 48
YEAR_FIRST, YEAR_LAST = 1900, 2100
WINDOW_DAYS = [7, 14, 30]

# Month names and short forms that make the number before them a day.
MONTH_WORDS = [
    "janeiro", "fevereiro", "março", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro",
    "dezembro", "jan", "fev", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez",
]
# Words before a number of days that make it a window of observation.
ANCHOR_WORDS = [
    "últimos", "últimas", "ultimos", "próximos", "próximas", "proximos", "período de", "periodo de", "período", "periodo",
    "janela de", "janela",
]

# What a gap between two numbers says. A word that ends a gap is followed by the first character of the next number, so
# that it only ends where a word does.
NAMES_MONTH = rf"(?iU)^\s*(?:de\s+)?(?:{'|'.join(MONTH_WORDS)})\b"
JOINS_DAYS = r"(?iU)^\s*[ae]\s+\z"
NAMES_DAYS = r"(?iU)^\s*dias?\b"
JOINS_RANGE = r"(?iU)^\s*[aàe~–—-]+\s*\z"
_ANCHOR = "|".join(w.replace(" ", r"\s+") for w in ANCHOR_WORDS)
ENDS_IN_ANCHOR = rf"(?iU)(?:{_ANCHOR})\s*[~–—-]*\s*\z"
ANCHORS_RANGE = rf"(?iU)(?:{_ANCHOR})\s*~?\s*\z"
CONTINUES_RANGE = r"(?iU)^\s*[aàe~–—-]+\s*[~–—-]*\s*\z"
# What follows the days of a window: its first two words, and the phrase up to a stop.
TWO_WORDS = r"(?isU)^.*?dias?\b\W*(\w*)\W*(\w*)"
PHRASE = r"(?isU)^.*?dias?\b\s*([^.,;]*)"

# Words that make a duration a clinical claim.
CLINICAL_WORDS = [
    "internação", "internacao", "internações", "internacoes",
    "internado", "internados", "internada", "internadas",
    "hospitalização", "hospitalizacao", "hospitalizações", "hospitalizacoes",
    "hospitalizado", "hospitalizados", "hospitalizada", "hospitalizadas",
    "febre", "tratamento", "tratamentos", "sintomas", "sintoma",
    "doença", "doenca", "doenças", "doencas", "enfermaria", "uti", "utis", "estadia",
    "permanência", "permanencia", "recuperação", "recuperacao", "isolamento", "isolamentos",
    "quarentena", "quarentenas", "ventilação", "ventilacao", "ventilacoes", "ventilacões",
]
# Words that make a duration a description of the method.
METHOD_WORDS = [
    "observação", "observacao", "observações", "observacoes", "análise", "analise", "análises", "analises",
    "coleta", "estudo", "estudos", "monitoramento", "vigilância", "vigilancia", "notificação", "notificacao",
    "acompanhamento", "avaliação", "avaliacao", "período", "periodo", "janela",
]
# Words that tie what follows to the duration.
LINKING_WORDS = [
    "de", "da", "do", "das", "dos", "na", "no", "nas", "nos", "em", "com", "para", "por",
    "pelo", "pela", "pelos", "pelas", "e",
]

# Decimal digits of every script but ASCII, from the Unicode category.
_OTHER_DIGITS = [
    c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
]
_DIGITS_FROM = "".join(_OTHER_DIGITS)
_DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)

TOKEN_TYPE = "array<struct<raw:string,value:double,start:int,context:string>>"
# How far into the pieces after a number the words are read that say what its days are; see `_RANGE`.
NEAR = 4


def _let(name: str, value: str, body: str) -> str:
    """SQL of `body` with `name` standing for `value`, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _apply(body: str, text: Column) -> Column:
    """A SQL expression in `t`, of a text column."""
    return F.get(F.call_function("transform", F.array(text), F.expr(f"t -> {body}")), F.lit(0))


def _ascii_digits(text: str) -> str:
    """Digits of other scripts as 0-9; texts without any pass through untouched."""
    return rf"CASE WHEN {text} RLIKE r'[^\x00-\x7F]' THEN translate({text}, '{_DIGITS_FROM}', '{_DIGITS_TO}') ELSE {text} END"


def _plain_spelling(bare: str) -> str:
    """A number without its percent sign, with a decimal point and no grouping."""
    return f"""CASE WHEN contains({bare}, ',') THEN translate({bare}, ',.', '.')
        WHEN contains({bare}, '.') AND NOT startswith({bare}, '0.') AND {bare} RLIKE r'{THOUSANDS}' THEN replace({bare}, '.', '')
        ELSE {bare} END"""


_VALUE = _let(
    "s", _ascii_digits("t"),
    _let("b", f"CASE WHEN endswith(s, '%') THEN rtrim('{WHITE_SPACE}', left(s, length(s) - 1)) ELSE s END",
         _let("n", _plain_spelling("b"), f"CASE WHEN n RLIKE r'{DECIMAL}' THEN try_cast(n AS DOUBLE) END")),
)


def parse_number(text: Column) -> Column:
    """Value of a number written the Brazilian way, or NULL.

    One trailing percent sign is ignored, and white space before it. With a comma, dots group thousands and the comma is the decimal
    mark. Without one, `7.485` is a grouped count unless it starts with a lone zero.
    """
    return _apply(_VALUE, strip_space(text))


def _word_list(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


# A window's days are named in the gap after it or the next one. Two words follow within NEAR gaps, unless letters and numbers
# run on without a break; then, and only then, the whole rest is put together.
_RANGE = ", ".join(f"coalesce(get(q.gaps, v.i + {k}), ''), coalesce(get(q.raws, v.i + {k}), '')" for k in range(1, NEAR))
_NEAR_REST = f"concat({_RANGE}, coalesce(get(q.gaps, v.i + {NEAR}), ''))"
_WHOLE_REST = "array_join(transform(sequence(v.i + 1, size(q.raws)), k -> concat(get(q.gaps, k), coalesce(get(q.raws, k), ''))), '')"
_MORE = f"v.i + {NEAR} < size(q.raws)"
_REST = _let("near", _NEAR_REST, rf"""CASE WHEN {_MORE} AND near RLIKE r'(?isU)^(?>.*?dias?\b)\W*\w*\W*\w*\z' THEN {_WHOLE_REST} ELSE near END""")
# What a token is: a quantity, a window, or a window or not by what a phrase says beyond the near pieces; in the
# last case it has said that the duration belongs to the method, or nothing yet.
QUANTITY, WINDOW, OPEN, OPEN_METHOD = 0, 1, 2, 3


def _window_state() -> str:
    """The state of a number that names a span of days, from the text after it.

    The first two words count even across punctuation; a linked phrase ends at the next `.`, `,` or `;`.
    """
    clinical, method = _word_list(CLINICAL_WORDS), _word_list(METHOD_WORDS)
    direct = " OR ".join(
        f"array_contains({clinical}, lower(regexp_extract(rest, r'{TWO_WORDS}', {i})))" for i in (1, 2)
    )
    linked = "phrase RLIKE '^(?:" + "|".join(LINKING_WORDS) + ") '"
    # a phrase that is cut at a number ends within a word, if a letter stands there
    whole = r"regexp_replace(phrase, r'(?U)\w+\z', '')"
    words = _let(
        "words", rf"regexp_extract_all(CASE WHEN open THEN {whole} ELSE phrase END, r'(?U)\b\w+\b', 0)",
        f"""CASE WHEN arrays_overlap(words, {clinical}) THEN {QUANTITY} WHEN open AND arrays_overlap(words, {method}) THEN {OPEN_METHOD}
            WHEN open THEN {OPEN} WHEN arrays_overlap(words, {method}) THEN {WINDOW} ELSE {QUANTITY} END""",
    )
    judged = _let(
        "phrase", f"lower(regexp_extract(rest, r'{PHRASE}', 1))", f"CASE WHEN {linked} THEN {words} ELSE {WINDOW} END"
    )
    is_open = rf"{_MORE} AND rest RLIKE r'(?isU)^(?>.*?dias?\b)[^.,;]*\z' AND length(rest) = length({_NEAR_REST})"
    return _let("rest", _REST, _let("open", is_open, f"CASE WHEN {direct} THEN {QUANTITY} ELSE {judged} END"))


def _joined(pairs: int) -> str:
    """Up to 48 characters before token `i`, from as many (gap, token) pairs and the gap at the token."""
    pieces = f"""transform(sequence(greatest(i - {pairs}, 0), i),
                           j -> concat(get(q.near, j), CASE WHEN j < i THEN get(q.raws, j) ELSE '' END))"""
    return f"right(array_join({pieces}, ''), {CONTEXT_CHARS})"


def _widened(text: str, pairs: int, wider: str) -> str:
    return f"CASE WHEN i <= {pairs} OR length({text}) = {CONTEXT_CHARS} THEN {text} ELSE {wider} END"


# Mostly the gap alone, or two pairs with it, is long enough. A pair holds two characters at least, so 25 of
# them always are.
_BEFORE = _widened("get(q.near, i)", 0, _let("b", _joined(2), _widened("b", 2, _joined(25))))
_AROUND = f"""named_struct('i', i, 'raw', get(q.raws, i), 'bare', rtrim('%', {_ascii_digits("get(q.raws, i)")}),
                           'before', {_BEFORE}, 'gap', get(q.gaps, i + 1), 'second', coalesce(get(q.raws, i + 1), ''),
                           'beyond', concat(coalesce(get(q.gaps, i + 2), ''), left(coalesce(get(q.raws, i + 2), ''), 1)))"""
_PLAIN = rf"""NOT endswith(w.before, '/') AND NOT startswith(w.gap, '/') AND NOT startswith(w.gap, 'º')
    AND NOT right(w.before, 2) RLIKE r'\p{{L}}-?\z'
    AND NOT (length(w.bare) = 4 AND NOT endswith(w.raw, '%') AND w.bare RLIKE r'^\d{{4}}\z'
             AND try_cast(w.bare AS INT) BETWEEN {YEAR_FIRST} AND {YEAR_LAST})"""
# Adding zero keeps a signed zero from being told apart from zero.
_VALUED = f"""named_struct('raw', w.raw, 'value',
    try_cast(concat(CASE WHEN endswith(w.before, '-') THEN '-' ELSE '' END, {_plain_spelling("w.bare")}) AS DOUBLE) + 0.0D,
    'context', lower(w.before), 'i', w.i, 'gap', w.gap, 'second', w.second, 'beyond', w.beyond)"""
_NEXT = "concat(v.gap, left(v.second, 1))"
_IS_DAY = rf"""({_NEXT} RLIKE r'{NAMES_MONTH}'
    OR v.gap RLIKE r'{JOINS_DAYS}' AND v.second RLIKE r'^\p{{Nd}}{{1,2}}\z' AND v.beyond RLIKE r'{NAMES_MONTH}')"""
_IS_SPAN = rf"""({_NEXT} RLIKE r'{NAMES_DAYS}'
    OR v.gap RLIKE r'{JOINS_RANGE}' AND v.second RLIKE r'^\p{{Nd}}+\z' AND v.beyond RLIKE r'{NAMES_DAYS}')"""
# Words count within the characters before a token that its context holds.
_ROOM = f"right(get(q.near, v.i - 1), {CONTEXT_CHARS} - length(get(q.raws, v.i - 1)) - length(get(q.near, v.i)))"
_ANCHORED = rf"""(get(q.near, v.i) RLIKE r'{ENDS_IN_ANCHOR}'
    OR v.i > 0 AND get(q.near, v.i) RLIKE r'{CONTINUES_RANGE}' AND get(q.raws, v.i - 1) RLIKE r'^\p{{Nd}}+\z'
       AND {_ROOM} RLIKE r'{ANCHORS_RANGE}')"""
_STATE = f"""CASE WHEN abs(v.value) IN ({", ".join(f"{d}D" for d in WINDOW_DAYS)}) AND {_IS_SPAN} AND {_ANCHORED} THEN {_window_state()} ELSE {QUANTITY} END"""
_JUDGED = f"""transform(
    filter(transform(filter(transform(sequence(0, size(q.raws) - 1), i -> {_AROUND}), w -> {_PLAIN}), w -> {_VALUED}),
           v -> v.value IS NOT NULL AND NOT {_IS_DAY}),
    v -> named_struct('raw', v.raw, 'value', v.value, 'context', v.context, 'i', v.i, 'state', {_STATE}))"""

# What phrases say beyond the near pieces. Each number with the gap after it is a letter: a to d go on, e to h end the phrase,
# b, d, f, h name a clinical word, c, d, g, h a word of method. Letters up to an end are one stretch, and from any
# place in it to its end there is such a word if the last one of the stretch comes later: all places in one pass.
_CLINICAL, _METHOD = _word_list(CLINICAL_WORDS), _word_list(METHOD_WORDS)
_INNER = r"""CASE WHEN NOT stop AND j + 1 < size(q.raws) THEN regexp_replace(tail, r'(?U)\w+\z', '') ELSE tail END"""
_LETTER = f"""substring('abcdefgh', 1 + CASE WHEN arrays_overlap(ws, {_CLINICAL}) THEN 1 ELSE 0 END
    + CASE WHEN arrays_overlap(ws, {_METHOD}) THEN 2 ELSE 0 END + CASE WHEN stop THEN 4 ELSE 0 END, 1)"""
_LETTERS = "array_join(transform(q.raws, (r, j) -> CASE WHEN r RLIKE '[.,]' THEN 'e' ELSE " + _let(
    "head", "regexp_extract(get(q.gaps, j + 1), '^[^.,;]*', 0)", _let(
        "stop", "length(head) < length(get(q.gaps, j + 1))", _let(
            "tail", r"CASE WHEN endswith(r, '%') THEN head ELSE regexp_replace(head, r'(?U)^\w+', '') END", _let(
                "ws", rf"regexp_extract_all(lower({_INNER}), r'(?U)\b\w+\b', 0)", _LETTER)))) + " END), '')"
_LAST = "length(s) - length(regexp_extract(reverse(s), '^[^{}]*', 0))"
_FAR = "flatten(transform(regexp_extract_all(" + _LETTERS + ", '[a-d]*[e-h]|[a-d]+', 0), s -> " + _let(
    "lc", _LAST.format("bdfh"), _let(
        "lm", _LAST.format("cdgh"),
        "transform(sequence(1, length(s)), k -> named_struct('clinical', k <= lc, 'method', k <= lm))")) + "))"
_STANDS = f"NOT get(far, x.i + {NEAR}).clinical AND (x.state = {OPEN_METHOD} OR get(far, x.i + {NEAR}).method)"
_KEPT = f"""CASE WHEN exists(judged, x -> x.state >= {OPEN})
    THEN {_let("far", _FAR, f"filter(judged, x -> CASE WHEN x.state >= {OPEN} THEN NOT ({_STANDS}) ELSE x.state = {QUANTITY} END)")}
    ELSE filter(judged, x -> x.state = {QUANTITY}) END"""
# Lengths run up in two levels, blocks and within them, so that no array grows by one element per token.
_SUM = "(s, n) -> s + n"
_BASES = f"""aggregate(transform(sequence(0, (size(l) - 1) div z), b -> aggregate(slice(l, b * z + 1, z), 0, {_SUM})),
    named_struct('at', 0, 'bases', CAST(array() AS ARRAY<INT>)),
    (acc, n) -> named_struct('at', acc.at + n, 'bases', array_append(acc.bases, acc.at)), acc -> acc.bases)"""
_WITH_STARTS = _let(
    "l", "transform(q.raws, (r, i) -> length(get(q.gaps, i)) + length(r))", _let(
        "z", "greatest(16, size(l) div 4096)", _let(
            "bases", _BASES, f"""transform(kept, x -> named_struct('raw', x.raw, 'value', x.value, 'start',
                get(bases, x.i div z) + aggregate(slice(l, x.i - x.i % z + 1, x.i % z + 1), 0, {_SUM}) - length(x.raw), 'context', x.context))""")))
_WITHOUT_STARTS = "transform(kept, x -> named_struct('raw', x.raw, 'value', x.value, 'context', x.context))"
_CUT = f"named_struct('raws', regexp_extract_all(t, r'{NUMBER}', 0), 'gaps', split(t, r'{NUMBER}', -1))"
_PIECES = f"named_struct('raws', p.raws, 'gaps', p.gaps, 'near', transform(p.gaps, g -> right(g, {CONTEXT_CHARS})))"


def _tokens(result: str, kind: str) -> str:
    found = _let("p", _CUT, _let("q", _PIECES, _let("judged", _JUDGED, _let("kept", _KEPT, result))))
    return rf"CASE WHEN t RLIKE r'\p{{Nd}}' THEN {found} WHEN t IS NOT NULL THEN CAST(array() AS {kind}) END"


def number_tokens(text: Column) -> Column:
    """Quantities in a text, in order: array of (raw, value, start, context).

    `start` counts characters from 0; `context` is the lower-cased text of up to 48 characters before the
    token. Left out are parts of slash dates, ordinals, codes such as COVID-19 or g1, plain years, numbers
    before a month name, and documented observation windows ("últimos 7 dias").
    """
    return _apply(_tokens(_WITH_STARTS, TOKEN_TYPE), text)


def number_values(text: Column) -> Column:
    """`number_tokens` without their places: array of (raw, value, context)."""
    return _apply(_tokens(_WITHOUT_STARTS, "array<struct<raw:string,value:double,context:string>>"), text)
