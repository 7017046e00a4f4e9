"""Number tokens and their values, all cases in one DataFrame."""

import re
import time

from pyspark.sql import functions as F

from sentinela.functions.numbers import number_tokens, number_values, parse_number
from sentinela.functions.rounding import round_exact
from sentinela.functions.text import strip_mismatches

PARSED = [
    ("15.5", 15.5), ("15,5", 15.5), ("15.5%", 15.5), ("abc", None), ("7.485", 7485.0), ("129.373", 129373.0),
    ("0.154", 0.154), ("0.0579", 0.0579), ("1.234,56", 1234.56), ("1.234.567", 1234567.0), (" 12% ", 12.0),
    ("1,2,3", None), ("", None), ("12.34.5", None), ("1d", None), ("٣,٥", 3.5), ("00.123", 123.0),
]

# text, raw tokens expected
TOKENS = [
    ("dados dos últimos 14 dias.", []),
    ("previsão para os próximos 7 dias.", []),
    ("no período de 7 dias.", []),
    ("janela de 14 dias.", []),
    ("nas ULTIMOS 30 DIAS houve queda", []),
    ("últimos ~7–14 dias sem dados", []),
    ("últimos 7 a 14 dias sujeitos a atraso", []),
    ("últimos 7-14 dias sujeitos a atraso", []),
    ("últimos 7 a 14 dias com atraso", ["7", "14"]),
    ("período de 7 dias de internação", ["7"]),
    ("período de 7 dias na UTI", ["7"]),
    ("período de 7 dias de longa internação", ["7"]),
    ("período de 7 dias de isolamento", ["7"]),
    ("período de 7 dias de observação", []),
    ("período de 7 dias de observação, internações subiram", []),
    ("período de 7 dias de observação em internação", ["7"]),
    ("período de 7 dias de chuva", ["7"]),
    ("período de 7 dias muito internado", ["7"]),
    ("últimos 7 dias, internações aumentaram", ["7"]),
    ("últimos 7 dias, segundo o boletim, internações aumentaram", []),
    ("nos últimos 30 dias, 7 dias de internação", ["7"]),
    ("no período de estudo, 7 dias de febre", ["7"]),
    ("internação média de 7 dias", ["7"]),
    ("hospitalizados durante 7 dias", ["7"]),
    ("observado durante 14 dias na coorte", ["14"]),
    ("internação média de 999 dias", ["999"]),
    ("variando de 3 a 5 dias", ["3", "5"]),
    ("Em 1º de janeiro e 20 de julho de 2026, a COVID-19 recuou nos últimos 7 dias.", []),
    ("segundo o g1, cenário de 2026", []),
    ("entre 13 e 20 de julho de 2026", []),
    ("de 13 a 20 de julho", []),
    ("em 5 DE MARÇO e 6 marco", []),
    ("12 julhos", ["12"]),
    ("em 20/07/2026 houve 12", ["12"]),
    ("H3N2 e 3 casos", ["3"]),
    ("1899 e 2101, mas não 1900 nem 2100", ["1899", "2101"]),
    ("2000% e 2000", ["2000%"]),
    ("1.234,56", ["1.234", "56"]),
    ("5%3", ["5", "3"]),
    ("a\n5", ["5"]),
    ("- 5 e A-5", ["5"]),
    ("", []),
    ("sem números", []),
]


def test_parse_number(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSED)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", parse_number(F.col("t")).alias("v")).collect()}
    assert {PARSED[i][0]: v for i, v in got.items()} == dict(PARSED)


def test_number_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    rows = df.select("i", "t", number_tokens(F.col("t")).alias("k")).collect()
    got = {r.t: [k.raw for k in r.k] for r in rows}
    assert got == dict(TOKENS)
    for r in rows:
        for k in r.k:
            assert r.t[k.start:k.start + len(k.raw)] == k.raw


def test_offsets_context_and_sign(spark):
    long_text = "😀 " * 40 + "queda de -78,12% em 7,5 é 3 " + "x 9 " * 40
    df = spark.createDataFrame([(long_text,)], "t string")
    tokens = df.select(F.inline(number_tokens(F.col("t")))).collect()
    assert [t.value for t in tokens[:3]] == [-78.12, 7.5, 3.0]
    assert len(tokens) == 43
    for t in tokens:
        assert long_text[t.start:t.start + len(t.raw)] == t.raw
        assert t.context == long_text[max(0, t.start - 48):t.start].lower()


def test_null_text_has_no_tokens(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(number_tokens(F.col("t")).alias("k")).first().k is None


def test_round_exact_equals_python(spark):
    values = [n / 20000 for n in range(3000)] + [n / 160 for n in range(400)] + [2.675, 3.125, -78.125, 1e6 / 3, -0.004]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", round_exact(F.col("x"), 4).alias("a"), round_exact(F.col("x"), 2).alias("b")).collect():
        assert (r.a, r.b) == (round(r.x, 4), round(r.x, 2)), r.x


def test_white_space_before_the_percent_sign(spark):
    rows = spark.createDataFrame([("15 %",), ("15,5 %",), (" 7 ",), ("% 7",), ("1 5%",)], "t string")
    assert [r.v for r in rows.select(parse_number(F.col("t")).alias("v")).collect()] == [15.0, 15.5, 7.0, None, None]


def test_time_grows_with_the_number_of_tokens(spark):
    def seconds(n):
        row = spark.createDataFrame([(" e ".join(f"{i},5" for i in range(1, n + 1)),)], "t string").cache()
        row.count()
        begin = time.perf_counter()
        starts = row.select(F.transform(number_tokens(F.col("t")), lambda x: x["start"]).alias("s")).first().s
        assert len(starts) == n and starts[-1] == sum(len(str(i)) + 5 for i in range(1, n))
        return time.perf_counter() - begin

    seconds(1000)
    few, many = seconds(20_000), seconds(80_000)
    assert many < max(8 * few, 3)


WINDOWS = [
    # a linked phrase that runs on over numbers to its end, or to a stop in a gap or in a number
    ("últimos 7 dias de coleta em 3 salas e 4 casos de 5 na uti, fim", ["7", "3", "4", "5"]),
    ("últimos 7 dias de coleta em 3 salas e 4 casos de 5 sem uti2 e 6", ["3", "4", "5", "6"]),
    ("últimos 7 dias de 1, e 2 dias de 3 e 4 e 5 e análise", ["7", "1", "2", "3", "4", "5"]),
    ("últimos 7 dias muito 1, dias e 2 dias 3 internado", ["1", "2", "3"]),
    ("últimos 7 dias de 1 e 2 e 3 e 4 e 5 para análise", ["1", "2", "3", "4", "5"]),
    ("últimos 7 dias de 1 e 2 e 3 e 4 e 5 para chuva", ["7", "1", "2", "3", "4", "5"]),
    ("últimos 7 dias de 1 e 2 e 3 e 4 e 5,5 para análise", ["7", "1", "2", "3", "4", "5,5"]),
    ("últimos 7 dias de 1 e 2 e 3 e 4 e análise. 5 uti", ["1", "2", "3", "4", "5"]),
    ("últimos 7 dias de 1 e 2 e 3 e 4 e 5% uti e 6 análise", ["7", "1", "2", "3", "4", "5%", "6"]),
    ("últimos 7 dias de 1 e 2 e 3 e 4 e 5uti e 6 análise", ["1", "2", "3", "4", "5", "6"]),
    ("últimos 7 a 14 dias de 1 e 2 e 3 e 4 e estudo", ["1", "2", "3", "4"]),
    # the two words after the days, over numbers and letters that run on
    ("últimos 7 dias 1 internado", ["7", "1"]),
    ("últimos 7 dias 1a2a3a4a5a6 internado", ["7", "1"]),
    ("últimos 7 dias 1a2a3a4a5a6 ontem internado", ["1"]),
]


def test_what_follows_a_window(spark):
    df = spark.createDataFrame([(t,) for t, _ in WINDOWS], "t string")
    rows = df.select("t", number_tokens(F.col("t")).alias("k"), number_values(F.col("t")).alias("v")).collect()
    assert {r.t: [k.raw for k in r.k] for r in rows} == dict(WINDOWS)
    for r in rows:
        assert [(k.raw, k.value, k.context) for k in r.k] == [(v.raw, v.value, v.context) for v in r.v]


def seconds_of(spark, text, expression):
    row = spark.createDataFrame([(text,)], "t string").cache()
    row.count()
    begin = time.perf_counter()
    found = row.select(expression.alias("x")).first().x
    return time.perf_counter() - begin, found


def test_time_grows_with_the_number_of_windows(spark):
    for phrase in ("nos últimos 7 dias de observação. ", "nos últimos 7 dias de observação ", "nos últimos 7 dias de chuva ", "últimos 7 dias "):
        seconds_of(spark, phrase * 500, number_tokens(F.col("t")))
        few, _ = seconds_of(spark, phrase * 4000, number_tokens(F.col("t")))
        many, found = seconds_of(spark, phrase * 16_000, number_tokens(F.col("t")))
        assert len(found) == (16_000 if "chuva" in phrase else 0) and many < max(8 * few, 4), phrase


def test_urls_are_deleted_by_looking_them_up(spark):
    urls = [f"https://a.br/{i}" for i in range(4000)]
    text = "Ver " + ", ".join(f"{u}/ e {u}x" for u in urls) + " fim"
    gone = sorted(urls[::2])
    want = text
    for u in gone:
        want = want.replace(u, "").replace(u + "/", "")
    strip = strip_mismatches(F.col("t"), F.array().cast("array<string>"), F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(3999), F.lit(2)), lambda i: F.concat(F.lit("https://a.br/"), i.cast("string")))))
    took, got = seconds_of(spark, text, strip)
    assert got == want and took < 4


def test_urls_within_and_before_others(spark):
    cases = [
        ("x https://a.br e https://a.br/c fim", ["https://a.br"]), ("https://a.br/c https://a.br", ["https://a.br/c", "https://a.br"]),
        ("https://a.br/c https://a.br", ["https://a.br", "https://a.br/c"]), ("(http://b.br/?u=https://a.br/d) https://a.br/d", ["http://b.br/?u=https://a.br/d"]),
        ("(http://b.br/?u=https://a.br/d) https://a.br/d", ["https://a.br/d"]), ("https://a.br", ["https://a.br"]), ("sem", ["https://a.br"]), ("https://a.br/", ["https://a.br"]),
        ("https://a.br/1 https://a.br/12 https://a.br/123", ["https://a.br/12", "https://a.br/1"]),
    ]
    df = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(cases)], "i int, t string, u array<string>")
    got = {r.i: r.x for r in df.select("i", strip_mismatches(F.col("t"), F.array().cast("array<string>"), F.col("u")).alias("x")).collect()}
    for i, (text, urls) in enumerate(cases):
        for u in urls:
            text = text.replace(u, "").replace(u + "/", "")
        assert got[i] == re.sub(" {2,}", " ", text).strip(), i


def test_mismatches_of_a_long_text_are_deleted_run_by_run(spark):
    n = 4000
    text = " ".join(f"{i},5 {i}.{i + 1}" for i in range(n))
    raws = [f"{i},5" for i in range(0, n, 2)]
    want = text
    for raw in raws:
        want = re.sub(rf"(?<!\d){re.escape(raw)}(?!\d)", "", want)
    want = re.sub(r"\n{3,}", "\n\n", re.sub(" {2,}", " ", want)).strip()
    df = spark.createDataFrame([(text, raws)], "t string, r array<string>")
    assert df.select(strip_mismatches(F.col("t"), F.col("r"), F.array().cast("array<string>")).alias("x")).first().x == want
