"""Files, snapshots, provenance and news responses."""

import gzip
import hashlib
import json
import random

import pyarrow as pa
import pytest

from sentinela.operators import quality as q
from sentinela.schema import PII_COLUMNS, SELECTED_COLUMNS
from sentinela.sources import cases as c
from sentinela.sources import hashing
from sentinela.sources import news as n
from sentinela.sources import snapshots as sn

ROW = ["2026-01-01", "2026-01-02", "2026-01-03", "", "", "", "", "1", "1", "2", "4", "1", "2", "SP", "SP", "30", "3", "M", "1", "1"]


@pytest.fixture()
def folder(tmp_path):
    plain = tmp_path / "INFLUD26-20-07-2026.csv"
    plain.write_text(";".join(SELECTED_COLUMNS) + "\n" + ";".join(ROW) + "\n", encoding="latin-1")
    private = tmp_path / "private" / "casos.csv"
    private.parent.mkdir()
    names = ["NM_PACIENT", *SELECTED_COLUMNS[:8], "NU_CPF", "OUTRA"]
    private.write_text(";".join(names) + "\n" + ";".join(['"José; ""Zé"""', *ROW[:8], "1", "x"]) + "\n"
                       + ";".join(["Conceição", *ROW[:8], "2", "y"]) + "\n", encoding="latin-1")
    return tmp_path


def test_load(spark, folder):
    cases = c.load_cases(spark, str(folder / "INFLUD26-20-07-2026.csv"))
    assert cases.columns == SELECTED_COLUMNS and dict(cases.dtypes)["DT_SIN_PRI"] == "date" and dict(cases.dtypes)["UTI"] == "int"
    row = spark.sql("SELECT * FROM srag").first()
    assert str(row.DT_DIGITA) == "2026-01-03" and row.DT_EVOLUCA is None and row.NU_IDADE_N == 30 and row.CS_SEXO == "M"


def test_missing_file(spark, folder):
    with pytest.raises(FileNotFoundError, match="CSV not found: "):
        c.read_case_csv(spark, str(folder / "nowhere.csv"))


def test_personal_data_is_dropped_and_reported(spark, folder):
    raw = c.read_case_csv(spark, str(folder / "private"))
    assert {r.NM_PACIENT for r in raw.collect()} == {'José; "Zé"', "Conceição"}
    assert c.clean_cases(raw).columns == SELECTED_COLUMNS[:8]
    status = {r.column: r.status for r in q.pii_report(raw).collect()}
    assert list(status) == PII_COLUMNS
    assert {k for k, v in status.items() if v == "present_and_stripped"} == {"NM_PACIENT", "NU_CPF"}
    log = {(r.section, r.name): r.status for r in q.exclusion_log(raw).collect()}
    assert log["input", "rows"] == log["output", "rows"] == "2"
    assert ("input", "OUTRA") in log and ("output", "OUTRA") not in log
    assert sum(k[0] == "columns_not_found" for k in log) == 12


def test_columns_not_found_only_if_any(spark):
    full = spark.createDataFrame([tuple(ROW)], SELECTED_COLUMNS)
    assert not [r for r in q.exclusion_log(full).collect() if r.section == "columns_not_found"]
    kept, missing = q.select_columns(spark.createDataFrame([(1,)], "unknown int"))
    assert kept.columns == [] and missing == SELECTED_COLUMNS


def test_files_of_another_layout_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DT_SIN_PRI;EVOLUCAO\n2026-01-01;1\n")
    (tmp_path / "b.csv").write_text("NM_PACIENT;DT_SIN_PRI\nAna;2026-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        c.read_case_csv(spark, str(tmp_path)).collect()


def test_strict_dates_and_the_report_on_them(spark):
    raw = spark.createDataFrame([("20/07/2026", "1"), ("2026-07-20", "x"), (None, None)], "DT_SIN_PRI string, UTI string")
    assert {(r.column, r.malformed, r.example) for r in c.malformed_values(raw).collect()} == {
        ("DT_SIN_PRI", 1, "20/07/2026"), ("UTI", 1, "x")}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        c.clean_cases(raw).collect()


def test_missing_spellings_and_whole_decimals(spark):
    raw = spark.createDataFrame([("2026-07-20", "1.0", "NA"), ("N/A", "NaN", "2"), ("null", "", "9.00"), (None, None, "<NA>")],
                                "DT_SIN_PRI string, EVOLUCAO string, UTI string")
    assert [(r.EVOLUCAO, r.UTI) for r in c.clean_cases(raw).collect()] == [(1, None), (None, 2), (None, 9), (None, None)]
    assert sum(r.malformed for r in c.malformed_values(raw).collect()) == 0
    for bad in ("1.5", "x", "1e12"):
        with pytest.raises(Exception, match="no whole number in UTI"):
            c.clean_cases(spark.createDataFrame([(bad,)], "UTI string")).collect()


def test_lines(spark):
    lines = spark.createDataFrame([(7, '2026-07-20;"a;b";"q""r"'), (8, ";;")], "id int, line string")
    got = c.parse_case_lines(lines, ["DT_SIN_PRI", "SG_UF", "CS_SEXO"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(7, "2026-07-20", "a;b", 'q"r'), (8, None, None, None)]


def test_fingerprints(spark, folder):
    path = folder / "INFLUD26-20-07-2026.csv"
    want = hashlib.sha256(path.read_bytes()).hexdigest()
    row = c.source_files(spark, str(path)).first()
    assert (row.sha256, row.extraction_date, row.valid_utf8, row.encoding) == (want, "2026-07-20", True, "ISO-8859-1")
    row = c.source_files(spark, str(folder / "private" / "casos.csv")).first()
    assert (row.extraction_date, row.valid_utf8) == ("unknown", False)


def test_large_files_are_hashed_in_steps(spark, tmp_path):
    """Files of some 40 KB in splits of 3 KB and steps of 8 KB: no task gets a whole one, and none is opened as one value."""
    rng = random.Random(5)
    lines = "\r\n".join("ação;" * rng.randrange(30) for _ in range(400)).encode()
    files = {
        "texto.csv": lines, "fim 100%.csv": lines + b"\n", "marca.csv": b"\xef\xbb\xbf" + lines, "marca fim.csv": b"\xef\xbb\xbf" + lines + b"\n\n",
        "vazias.csv": b"\n" * 40_000, "bytes.bin": rng.randbytes(40_000), "uma.csv": b"x" * 40_000, "cortado.csv": lines + "ç".encode()[:1],
        "longa.csv": b"a\n" + b"y" * 30_000 + b"\n" + lines, "igual.csv": lines, "pequeno.csv": b"a;b\n", "pacote.csv.gz": gzip.compress(rng.randbytes(20_000)),
    }
    folder = tmp_path / "mês"
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    splits = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = c.source_files(spark, f"{folder}/*", whole=10_000, step_bytes=8_000)
        got = {r.file_name: (r.length, r.sha256, r.valid_utf8) for r in found.collect()}
        read = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", splits)

    def valid(data: bytes) -> bool:
        return data.decode("utf-8", "replace").encode() == data

    assert got == {k: (len(v), hashlib.sha256(v).hexdigest(), valid(v)) for k, v in files.items()}
    assert not got["cortado.csv"][2] and got["marca.csv"][2] and read.count("sha2(content") == 1
    assert found.count() == len(files)


def test_a_hash_goes_on_from_its_state():
    data = pa.py_buffer(random.Random(6).randbytes(1000))
    for cut in (0, 1, 63, 64, 65, 500, 1000):
        first = hashing.Sha256()
        first.update(data.slice(0, cut))
        second = hashing.Sha256(first.state())
        second.update(data.slice(cut))
        assert first.hexdigest() == hashlib.sha256(data.slice(0, cut)).hexdigest() and second.hexdigest() == hashlib.sha256(data).hexdigest()


def test_cleaned_table_is_stored_by_month(spark, tmp_path):
    cases = spark.range(300).selectExpr("date_add(DATE'2026-01-01', CAST(IF(id < 100, 40, id) AS INT)) AS DT_SIN_PRI", "1 AS EVOLUCAO")
    c.write_cases(cases, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 300
    assert back.filter("onset_month = '2026-02'").count() == cases.filter("month(DT_SIN_PRI) = 2 AND year(DT_SIN_PRI) = 2026").count()


REMOTE = "url string, mode string, pinned_filename string, head_ok boolean, download_ok boolean, etag string, last_modified string, failure string"
CACHED = "url string, etag string, last_modified string, filename string, file_exists boolean"


def test_sync_actions(spark):
    cases = [
        # mode, pinned, head, download, etag, modified, cached (etag, modified, filename, exists) -> action, filename, error
        ("pinned", "p.csv", True, True, "a", "m", None, "pinned_snapshot", "p.csv", None),
        ("pinned", None, True, True, "a", "m", ("a", "m", "c.csv", True), None, None, sn.NO_PINNED),
        ("live", None, True, True, "a", "m", ("a", "m", "c.csv", True), "cached_up_to_date", "c.csv", None),
        ("live", None, True, True, "a", "m", ("a", "m", "c.csv", False), "cached_up_to_date", "c.csv", None),
        ("live", None, True, True, "a", "", ("b", "", "c.csv", True), "downloaded", None, None),
        ("live", None, True, True, "", "", ("", "", "c.csv", True), "downloaded", None, None),
        ("live", None, True, True, "a", "m", ("b", "m", "c.csv", True), "cached_up_to_date", "c.csv", None),
        ("live", None, True, True, "a", "m", ("a", "m", "", True), "downloaded", None, None),
        ("live", None, True, True, "a", "m", None, "downloaded", None, None),
        ("live", None, False, True, "", "", ("a", "m", "c.csv", True), "used_cache_after_error", "c.csv", "boom"),
        ("live", None, False, True, "", "", ("a", "m", "c.csv", False), None, None, sn.NO_CACHE),
        ("live", None, False, True, "", "", None, None, None, sn.NO_CACHE),
        ("live", None, True, False, "a", "m", ("b", "n", "c.csv", True), "used_cache_after_error", "c.csv", "boom"),
        ("live", None, True, False, "a", "m", None, None, None, sn.NO_CACHE),
    ]
    remote = spark.createDataFrame([(str(i), *k[:6], "boom") for i, k in enumerate(cases)], REMOTE)
    cached = spark.createDataFrame([(str(i), *k[6]) for i, k in enumerate(cases) if k[6]], CACHED)
    got = {int(r.url): (r.action, r.filename, r.error) for r in sn.sync_actions(remote, cached).collect()}
    assert got == {i: (k[7], k[8], k[9]) for i, k in enumerate(cases)}


def test_metadata_round_trip(spark, folder, tmp_path):
    store = str(tmp_path / "meta")
    assert sn.read_metadata(spark, store).count() == 0
    path = str(folder / "private" / "casos.csv")
    meta = sn.snapshot_metadata(c.read_case_csv(spark, path), c.source_files(spark, path), "u", "e", "m", "2026-07-20T00:00:00")
    sn.write_metadata(meta, store)
    row = sn.read_metadata(spark, store).first()
    assert (row.url, row.filename, row.rows, row.etag) == ("u", "casos.csv", 2, "e") and len(row.sha256) == 64


def test_news_responses(spark):
    item = {"title": "T", "url": "https://x/", "source": "s", "published_date": "2026", "content": "texto"}
    cases = [
        ({"results": [item]}, [("T", "https://x/", "s", "2026", "texto")]),
        ({"results": [{}]}, [("", "", "", "", "")]),
        ({"results": ["a", 5, None, ["b"], item]}, [("T", "https://x/", "s", "2026", "texto")]),
        ({"results": {"title": "x"}}, []), ({"results": []}, []), ({"results": None}, []), ({}, []),
        ({"results": [{"title": 7, "content": None}]}, [("7", "", "", "", "None")]),
    ]
    responses = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(99, "not json")], "report_id int, response string")
    got = {}
    for r in n.extract_news(responses).orderBy("report_id", "pos").collect():
        got.setdefault(r.report_id, []).append((r.title, r.url, r.source, r.published_date, r.snippet))
    assert got == {i: rows for i, (_, rows) in enumerate(cases) if rows}
    available = n.news_availability(responses, n.extract_news(responses))
    assert {r.report_id: r.news_source for r in available.collect()} == {
        **{i: "tavily" if rows else "unavailable" for i, (_, rows) in enumerate(cases)}, 99: "unavailable"}


def test_first_items_of_a_hot_report(spark):
    news = spark.range(5000).selectExpr("IF(id % 3 = 0, 0, id % 40) AS report_id", "5000 - id AS pos")
    got = {}
    for r in n.top_news(news).collect():
        got.setdefault(r.report_id, {})[r.rank] = r.pos
    rows = [(0 if i % 3 == 0 else i % 40, 5000 - i) for i in range(5000)]
    want = {k: dict(enumerate(sorted(p for r, p in rows if r == k)[:5], 1)) for k in range(40)}
    assert got == want
