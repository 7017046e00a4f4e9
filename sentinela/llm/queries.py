"""The registered queries of this package: each applies one operator to a whole table; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm import language_id, quality_mil, quality_rules
from sentinela.llm.common import crc_of_id
from sentinela.llm.conversation_repair import damaged, repair, transcript_hashes
from sentinela.llm.fingerprints import compare_with_next
from sentinela.llm.license_scan import TEMPLATES, THRESHOLD, scan_licenses
from sentinela.llm.minhash_join import near_duplicates
from sentinela.llm.mixing import BLOCK_TOKENS, ENTROPY, MAX_PASSES, STEPS, mix_sources
from sentinela.llm.packing import pack
from sentinela.llm.periodic_runs import detect_runs
from sentinela.llm.secrets import KINDS, find_secrets
from sentinela.llm.substring_dedup import remove_repeated_passages
from sentinela.llm.vector_packing import pack_best_fit


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    model = language_id.learn(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_next(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = quality_mil.learn(docs, labels.filter(~held_out))
    scored = quality_mil.score_texts(docs, model, ["doc_id", "text"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["kind"] != KINDS[3])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "pass", "n_tokens", "start", "block", "slot")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tenth of the texts made periodic from some word on; rows without id are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " "))

    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))  # cut once, then looked up
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(F.transform(words, planted)[0], F.col("text"))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_runs(with_planted_runs(documents(spark, sf_dir)))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    found = found.withColumn("most", F.aggregate("runs", none, better))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "most.start", "most.length", "most.period",
        F.expr("1000 * most.length div most.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"), "n_words", "n_dropped")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    solved, repaired = repair(damaged(rows))
    found = rows.select("conv_id").distinct()
    for one in (solved.drop("n_rows"), transcript_hashes(repaired)):
        one = one.withColumnRenamed("conv_id", "_conv")
        found = found.join(one, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_best_fit(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "sequence_tokens", "sequence_documents")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_substring_dedup, op3_fingerprints, op4_quality_classifier, op5_license_scan, op6_secret_scan,
    op7_quality_rules, op8_minhash_dedup, op9_packing, op10_mixing, op11_periodic_runs,
    op12_conversation_repair, op13_best_fit_packing)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# crc32 of a text of plain characters; the table of the 256 remainders comes from its rule.
CRC_TABLE = """(SELECT list(c ORDER BY i) AS remainders FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) AS r(i)))"""


def _crc_sql(text: str) -> str:
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(remainders[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"



def _entropy_sql(exponent: str) -> str:
    powers = f"list_transform(q, lambda x: pow(x, {exponent}))"
    return (f"(CASE WHEN len(q) < 2 THEN 1.0 ELSE -list_sum(list_transform({powers}, "
            f"lambda y: (y / list_sum({powers})) * ln(y / list_sum({powers})))) / ln(len(q)) END)")


ORACLES = {
    "op2_substring_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS x
                    FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        repeated AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, i + j AS i FROM windows JOIN repeated USING (x), range(35) AS t(j)),
        removed AS (SELECT r, list(i) AS places FROM gone GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
               sha256(array_to_string([x FOR x, i IN w IF places IS NULL OR NOT list_contains(places, i)], ' ')) AS kept_sha256
        FROM d LEFT JOIN removed USING (r)""",
    "op5_license_scan": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT r, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
        words AS (SELECT r, i, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM lines),
        cut AS (SELECT r, i, w, count(*) FILTER (len(w) = 0) OVER (PARTITION BY r ORDER BY i) AS g FROM words),
        passages AS (
            SELECT r, 'l' || i AS p, w FROM words
            UNION ALL SELECT r, 'g' || g, flatten(list(w ORDER BY i)) FROM cut GROUP BY r, g
            UNION ALL SELECT r, 't', flatten(list(w ORDER BY i)) FROM words GROUP BY r),
        sets AS (SELECT r, p, list_distinct([w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))]) AS b FROM passages WHERE len(w) > 1),
        templates AS (
            SELECT name, list_distinct([w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))]) AS t
            FROM (SELECT name, regexp_extract_all(lower(x), '[a-z0-9]+') AS w FROM (VALUES {", ".join("('" + n + "', '" + x.replace("'", "''") + "')" for n, x in TEMPLATES.items())}) AS v(name, x))),
        alike AS (SELECT r, name, 2 * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice FROM sets JOIN templates
                  ON len(t) * (2 - {THRESHOLD}) >= {THRESHOLD} * len(b) AND len(t) * {THRESHOLD} <= (2 - {THRESHOLD}) * len(b)),
        best AS (SELECT r, name, max(dice) AS dice FROM alike WHERE dice >= {THRESHOLD} GROUP BY r, name),
        of AS (SELECT r, list(name ORDER BY dice DESC, name)[1] AS license, max(dice) AS score, string_agg(name, ',' ORDER BY name) AS licenses FROM best GROUP BY r)
        SELECT doc_id, license, coalesce(round(score, 6), 0) AS score, coalesce(licenses, '') AS licenses FROM d LEFT JOIN of USING (r)""",
    "op8_minhash_dedup": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]
                                             ELSE [array_to_string(w, ' ') || ' .'] END) AS x FROM d WHERE len(w) > 0),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
        least AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d JOIN least USING (r) LEFT JOIN n USING (r)""",
    "op10_mixing": rf"""
        WITH RECURSIVE c AS (SELECT doc_id, coalesce(source, '') AS source, len({WORDS}) AS n_tokens FROM documents),
        src AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM c GROUP BY source HAVING sum(n_tokens) > 0),
        q AS (SELECT list(tokens / (SELECT sum(tokens) FROM src) ORDER BY source) AS q FROM src),
        flat(k, lo, hi) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
            FROM (SELECT k, lo, hi, mid, {{e_mid}} >= {ENTROPY} AS ok
                  FROM (SELECT *, (lo + hi) / 2 AS mid FROM flat WHERE k < {STEPS}), q)),
        steep(k, lo, hi) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
            FROM (SELECT k, lo, hi, mid, pow(list_max(q) / list_min(q), mid) <= {MAX_PASSES} AS ok
                  FROM (SELECT *, (lo + hi) / 2 AS mid FROM steep WHERE k < {STEPS}), q)),
        e AS (SELECT greatest(
                  (SELECT CASE WHEN {{e_one}} >= {ENTROPY} THEN 1.0 ELSE (SELECT lo FROM flat WHERE k = {STEPS}) END FROM q),
                  (SELECT CASE WHEN list_max(q) / list_min(q) <= {MAX_PASSES} THEN 0.0 ELSE 1 - (SELECT lo FROM steep WHERE k = {STEPS}) END FROM q)) AS a),
        w AS (SELECT source, tokens, pow(tokens / (SELECT sum(tokens) FROM src), a) AS raw FROM src, e),
        weighed AS (SELECT source, tokens, raw / (SELECT sum(raw) FROM w) AS weight FROM w),
        plan AS (SELECT source, tokens, round(weight / (SELECT min(weight / tokens) FROM weighed))::BIGINT AS budget FROM weighed),
        shown AS (
            SELECT c.*, tokens, budget, unnest(range(0, (budget + tokens - 1) // tokens)) AS pass FROM c JOIN plan USING (source)),
        placed AS (SELECT *, ('0x' || substr(md5('pass:' || coalesce(doc_id::VARCHAR, '') || ':' || pass), 1, 15))::BIGINT AS place FROM shown),
        started AS (
            SELECT *, pass * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY place, doc_id, n_tokens
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM placed),
        blocked AS (
            SELECT *, least(floor(start / budget * n)::BIGINT, n - 1) AS block
            FROM started, (SELECT greatest(1, ceil(sum(budget) / {BLOCK_TOKENS}.0))::BIGINT AS n FROM plan)
            -- every document of a pass that the budget covers, and of the one it cuts what begins within
            WHERE (pass + 1) * tokens <= budget OR start < budget)
        SELECT doc_id, source, pass, n_tokens, start, block,
               row_number() OVER (PARTITION BY block ORDER BY ('0x' || substr(md5('block:' || coalesce(doc_id::VARCHAR, '') || ':' || pass), 1, 15))::BIGINT,
                                  doc_id, source, pass, start) - 1 AS slot
        FROM blocked""".replace("{e_mid}", _entropy_sql("mid")).replace("{e_one}", _entropy_sql("1.0")),
    # A stretch of 16 equal words or more at lag q is as many equal 16-word windows, less 15, one after the other.
    "op11_periodic_runs": rf"""
        WITH crc AS {CRC_TABLE},
        d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w, len({WORDS}) AS n, {_crc_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
        a AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM d),
        made AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
                     lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
        windows AS (SELECT r, n, i, array_to_string(w[i + 1:i + 16], ' ') AS x
                    FROM (SELECT r, n, w, unnest(range(n - 15)) AS i FROM made WHERE n >= 24)),
        alike AS (SELECT a.r, a.i, b.i - a.i AS q FROM windows a JOIN windows b ON a.r = b.r AND a.x = b.x AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
        grouped AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM alike),
        stretches AS (SELECT r, q, min(i) AS start, count(*) + 15 + q AS length FROM grouped GROUP BY r, q, part),
        runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
        listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line FROM runs GROUP BY r),
        most AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
        gone AS (SELECT r, list(DISTINCT i) AS places FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               sha256(coalesce(line, '')) AS runs_sha256, n AS n_words, coalesce(len(places), 0) AS n_dropped,
               sha256(array_to_string([x FOR x, i IN w IF places IS NULL OR NOT list_contains(places, i - 1)], ' ')) AS collapsed_sha256
        FROM made LEFT JOIN listed USING (r) LEFT JOIN most USING (r) LEFT JOIN gone USING (r)""",
    # Every state of the repaired roles so far, row by row; up to two insertions before a row or the end, as more lead back.
    "op12_conversation_repair": rf"""
        WITH RECURSIVE crc AS {CRC_TABLE},
        plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                         {_crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, crc),
        damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM plain),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(md5(role) || md5(text))) AS i FROM damaged),
        judged AS (SELECT *, left(role, 1) AS x, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                          NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM numbered),
        faulty AS (SELECT *, CASE WHEN blank THEN 'b' WHEN again THEN 'd' WHEN cut THEN 't' ELSE '' END AS fault FROM judged),
        -- from, to, insertions
        fills(q, p, letters, lines) AS (VALUES ('', '', '', []), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
            ('', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('a', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']),
            ('', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])),
        edits(p, letter, x, to_state, price) AS (VALUES
            ('', 'D', '*', '', 4), ('s', 'D', '*', 's', 4), ('u', 'D', '*', 'u', 4), ('a', 'D', '*', 'a', 4),
            ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('a', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0),
            ('', 'R', '*', 'u', 3), ('s', 'R', '*', 'u', 3), ('a', 'R', '*', 'u', 3), ('u', 'R', '*', 'a', 3)),
        walk(conv_id, i, q, best) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} FROM faulty
            UNION ALL
            SELECT w.conv_id, w.i + 1, e.to_state, min({{
                       'cost': (w.best.cost + 3 * len(f.letters) + e.price + CASE WHEN e.letter <> 'D' AND r.fault = 't' THEN 3 ELSE 0 END)::BIGINT,
                       'audit': w.best.audit || f.letters || e.letter,
                       'lines': list_concat(w.best.lines, f.lines, CASE e.letter WHEN 'D' THEN []
                           WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE e.to_state WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END)}})
            FROM walk w JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN fills f ON f.q = w.q JOIN edits e ON e.p = f.p
            WHERE e.letter = 'D' OR (r.fault IN ('', 't') AND e.x IN ('*', r.x))
            GROUP BY w.conv_id, w.i, e.to_state),
        ends AS (SELECT w.conv_id, min({{'cost': (w.best.cost + 3 * len(f.letters))::BIGINT, 'audit': w.best.audit || f.letters, 'lines': list_concat(w.best.lines, f.lines)}}) AS best
                 FROM walk w JOIN (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id) t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = t.n
                 JOIN fills f ON f.q = w.q WHERE f.p IN ('', 'a') GROUP BY w.conv_id),
        counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                           count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal
                    FROM (SELECT *, coalesce(lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x NOT IN ('su', 'ua', 'au'), false) AS bad FROM faulty) GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
               sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
