"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.llm.chat import digests, format_conversations
from fanplume.llm.class_lm import score_documents
from fanplume.llm.common import table
from fanplume.llm.conversation_repair import digests as repair_digests
from fanplume.llm.conversation_repair import repair_conversations
from fanplume.llm.decontaminate import find_benchmark
from fanplume.llm.language_id import identify, learn_languages
from fanplume.llm.line_dedup import dedup_lines
from fanplume.llm.near_dedup import near_duplicates
from fanplume.llm.packing import pack_documents
from fanplume.llm.periodic_runs import find_runs
from fanplume.llm.quality import BASE, apply_quality, learn_quality
from fanplume.llm.secrets import find_secrets
from fanplume.llm.substring_dedup import dedup_substrings
from fanplume.llm.url_filter import LINK, UNIT, Rule, judge_urls

#: A conversation whose texts look like the marks of a template, in both roles.
TRICKY = r"\### Assistant: </turn> ok"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return digests(format_conversations(turns.unionByName(tricky)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return apply_quality(docs, learn_quality(docs, labels)).select("doc_id", *BASE, "base_failed", "kept")


def held_out(parts: int, part: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.filter(~held_out(4, 2)))
    told = identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), train=~held_out(10, 0))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
ROUNDS = 20


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES, rounds=ROUNDS)
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults by the checksum of conversation and turn: rows that go (`dropped`), are emptied, lose
    their full stops, come twice, or become the user's. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    k, text = F.col("kind"), F.col("text")
    rows = rows.withColumn("copies", F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("dropped"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(repair_conversations(damaged(table(spark, sf_dir, "conversations")), present=~F.col("dropped")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text, by the checksum of its id, gets words that repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    some = some.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("n", F.size("w"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    words = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(again)), F.lit(1), F.col("n"))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_repeats(table(spark, sf_dir, "documents")))
    rank = lambda r: F.struct(-r["length"], r["start"], r["period"])
    longest = F.array_min(F.transform("runs", rank))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), "runs", "collapsed")
    start, length, period = F.col("r.start"), -F.col("r.col1"), F.col("r.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[n].cast("string") for n in ("start", "length", "period"))), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_packing": op3_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_secret_scans": op7_secret_scans,
    "op8_class_lm": op8_class_lm,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}


def _crc32(text: str) -> str:
    """The checksum of ASCII text as a DuckDB expression, bit by bit."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda k: CAST((ord(substr({text}, k // 8 + 1, 1)) >> (k % 8)) & 1 AS BIGINT))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _rule_fits(rule: Rule) -> str:
    return f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"


_LONGEST_FIRST = sorted(URL_RULES, key=lambda r: -len(r.text))
_RULE = "CASE " + " ".join(f"WHEN {_rule_fits(r)} THEN '{r.text}'" for r in _LONGEST_FIRST) + " END"
_SAID = "CASE " + " ".join(f"WHEN {_rule_fits(r)} THEN '{r.verdict}'" for r in _LONGEST_FIRST) + " END"
_LINK = LINK.replace("'", "''")
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_EACH_ROUND = ", ".join(
    f"""m{k} AS MATERIALIZED (
            SELECT side, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
                SELECT side, host, CAST(floor((1 - CAST(0.85 AS DOUBLE)) * mass) AS BIGINT) AS mass FROM m0
                UNION ALL SELECT s.side, s.dst, CAST(floor(m.mass * s.share) AS BIGINT) FROM shares s JOIN m{k - 1} m ON s.side = m.side AND s.src = m.host
            ) GROUP BY side, host
        )"""
    for k in range(1, ROUNDS + 1)
)

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, s, array_to_string(w[s : s + 34], ' ') AS seq
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35)
        ), repeated AS (
            SELECT doc_id, s FROM windows WHERE seq IN (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1)
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM repeated
        ), each AS (
            SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM words
        ), marked AS (
            SELECT e.*, c.p IS NOT NULL AS gone FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.p = c.p
        ), counted AS (
            SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN counted USING (doc_id)
    """,
    "op2_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, t, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
        ), said AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
                   sum(length('### ' || role || ':  </turn>' || chr(10)) + length(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '#', chr(92) || 'h'), '<', chr(92) || 'l'))) AS formatted_chars
            FROM turns GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
               CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM said
    """,
    "op4_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), rare AS (
            SELECT s.* FROM shingles s JOIN (SELECT g FROM shingles GROUP BY g HAVING count(*) > 1) USING (g)
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c)
        ), reach(x, y) AS (
            SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), classed AS (
            SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS class_id FROM documents d LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
        )
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows, text_id, count(*) FILTER (doc_id = text_id) OVER (PARTITION BY class_id) AS class_texts
        FROM classed JOIN (SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) ELSE doc_id END AS text_id FROM words) USING (doc_id)
    """,
    "op9_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), shared AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first AS lost FROM keyed k LEFT JOIN shared s ON k.key = s.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    # Trust along links, distrust against them, round by round.
    "op11_url_filter": rf"""
        WITH parts AS (
            SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), hosts AS (
            SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), told AS MATERIALIZED (
            SELECT *, {_RULE} AS rule, {_SAID} AS said FROM hosts
        ), links AS (
            SELECT host AS src, translate(dst, {_AZ}) AS dst, count(*) AS weight FROM (SELECT host, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS dst FROM told WHERE host <> '') GROUP BY 1, 2
        ), named AS (
            SELECT host, string_split(host, '.') AS l FROM (SELECT host FROM told WHERE host <> '' UNION SELECT dst FROM links)
        ), steps AS (
            SELECT DISTINCT array_to_string(l[k:], '.') AS a, array_to_string(l[k + 1 :], '.') AS b
            FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM named WHERE len(l) > 2 AND NOT regexp_full_match(host, '[0-9.:]*'))
        ), edges AS (
            SELECT src, dst, sum(weight) AS weight FROM (FROM links UNION ALL SELECT a, b, 1 FROM steps UNION ALL SELECT b, a, 1 FROM steps) WHERE src <> dst GROUP BY 1, 2
        ), sided AS (
            SELECT 'trust' AS side, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges
        ), shares AS MATERIALIZED (
            SELECT side, src, dst, CAST(0.85 AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY side, src) AS DOUBLE) AS share FROM sided
        ), m0 AS MATERIALIZED (
            SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS side, host, count(*) * {UNIT} AS mass FROM told WHERE said IS NOT NULL GROUP BY 1, 2
        ), {_EACH_ROUND}, scores AS (
            SELECT host, sum(mass) FILTER (side = 'trust') AS trust, sum(mass) FILTER (side = 'distrust') AS distrust FROM m{ROUNDS} GROUP BY host
        )
        SELECT page_id, t.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) > 2 * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
               CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
        FROM told t LEFT JOIN scores s ON t.host = s.host
    """,
    # Costs and audits from the last row to the first: e, s, u, a are what is cheapest from each state on.
    "op12_conversation_repair": rf"""
        WITH RECURSIVE marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
            FROM conversations
        ), rows AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM marked WHERE kind <> 0)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                   rtrim(text, {_SPACES}) AS bare
            FROM rows
        ), told AS (
            SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS c
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed)
        ), back(conv_id, i, e, s, u, a) AS (
            SELECT conv_id, max(i) + 1, {{'c': 0, 'w': ''}}, {{'c': 4, 'w': 'II'}}, {{'c': 2, 'w': 'I'}}, {{'c': 0, 'w': ''}} FROM told GROUP BY conv_id
            UNION ALL
            SELECT conv_id, i, list_min([e, {{'c': 2 + u.c, 'w': 'I' || u.w}}]), list_min([s, {{'c': 2 + u.c, 'w': 'I' || u.w}}]), u, list_min([a, {{'c': 2 + u.c, 'w': 'I' || u.w}}])
            FROM (
                SELECT conv_id, i, e, s, list_min([u, {{'c': 2 + a.c, 'w': 'I' || a.w}}]) AS u, a
                FROM (
                    SELECT b.conv_id, t.i,
                           list_min([{{'c': 3 + e.c, 'w': 'D' || e.w}}, CASE WHEN keep THEN {{'c': 2 + late + u.c, 'w': 'R' || u.w}} END, CASE WHEN keep AND c = 'u' THEN {{'c': late + u.c, 'w': 'K' || u.w}} WHEN keep AND c = 's' THEN {{'c': late + s.c, 'w': 'K' || s.w}} END]) AS e,
                           list_min([{{'c': 3 + s.c, 'w': 'D' || s.w}}, CASE WHEN keep THEN {{'c': 2 + late + u.c, 'w': 'R' || u.w}} END, CASE WHEN keep AND c = 'u' THEN {{'c': late + u.c, 'w': 'K' || u.w}} END]) AS s,
                           list_min([{{'c': 3 + u.c, 'w': 'D' || u.w}}, CASE WHEN keep THEN {{'c': 2 + late + a.c, 'w': 'R' || a.w}} END, CASE WHEN keep AND c = 'a' THEN {{'c': late + a.c, 'w': 'K' || a.w}} END]) AS u,
                           list_min([{{'c': 3 + a.c, 'w': 'D' || a.w}}, CASE WHEN keep THEN {{'c': 2 + late + u.c, 'w': 'R' || u.w}} END, CASE WHEN keep AND c = 'u' THEN {{'c': late + u.c, 'w': 'K' || u.w}} END]) AS a
                    FROM back b JOIN (SELECT *, NOT (blank OR duplicate) AS keep, CAST(truncated AS INTEGER) AS late FROM told) t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = b.i - 1
                )
            )
        ), audits AS (
            SELECT conv_id, e.c AS cost, e.w AS audit FROM back WHERE i = 1
        ), steps AS (
            SELECT conv_id, pos, edit, sum(CAST(edit <> 'I' AS INTEGER)) OVER w AS i, sum(CAST(edit <> 'D' AS INTEGER)) OVER w AS m
            FROM (SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS pos, unnest(string_split(audit, '')) AS edit FROM audits)
            WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
        ), said AS (
            SELECT s.conv_id, s.pos, s.edit, m, t.role, t.text, coalesce(max(CAST(m = 1 AND edit = 'K' AND c = 's' AS INTEGER)) OVER (PARTITION BY s.conv_id), 0) AS lead
            FROM steps s LEFT JOIN told t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.i = t.i AND s.edit <> 'I' WHERE s.edit <> 'D'
        ), repaired AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS every FROM said GROUP BY conv_id
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                   count(*) FILTER (i > 1 AND earlier || c NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM told) GROUP BY conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(every, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits x ON o.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
    """,
    # A run of 12 words or more repeats 6 words in a row at the distance of its period, from its start on.
    "op13_periodic_runs": rf"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents
        ), drawn AS (
            SELECT doc_id, o, h, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM split
        ), words AS (
            SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w
            FROM drawn
        ), grams AS (
            SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM words)
        ), twins AS (
            SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i
        ), parts AS (
            SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM twins) GROUP BY doc_id, q, part
        ), long AS (
            SELECT * FROM parts WHERE length >= greatest(12, 2 * q)
        ), runs AS (
            SELECT doc_id, start, length, q AS period FROM long r
            WHERE NOT EXISTS (FROM long s WHERE s.doc_id = r.doc_id AND s.q < r.q AND r.q % s.q = 0 AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
        ), told AS (
            SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, {{'l': -length, 's': start, 'p': period}}) AS r,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
            FROM runs GROUP BY doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
        ), kept AS (
            SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS collapsed
            FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM words) e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
        )
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period, r.length * 1000 // r.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN told t USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """,
}
