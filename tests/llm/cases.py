"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, part int, label int, `class` bigint, pass int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.25, 3, 9, 7, 2)


ODD = [
    row(1, None), row(2, ""), row(3, " \t\n\x0b\x0c\r "), row(4, "one"), row(5, "Só três palavras"), row(6, LONG), row(7, LONG),
    row(8, "repeated row of eleven words that is here two whole times"), row(8, "repeated row of eleven words that is here two whole times"),
    row(None, "no id but words enough for a shingle"), row(None, None), row(9, "12 34 !! 56"), row(10, "é" * 300, None, None),
    row(11, "no break space \U0001F600 emoji \u0000 zero", "pt", "b"), row(12, "a" * 5000, "xx", "b"),
    row(13, "\n\n".join(["line of text", "line of text", "", " other "]), "en", "c"),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")
