"""Queries of the text operators with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, exact_dedup, html_text, line_dedup, line_quality, near_dedup, secret_scan, spelling, token_files, toxicity, turn_repair, warc
from .common import new_folder, table, written

#: The id that ends a document in the token files.
END_ID = 2


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_tables", "text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.archive(table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"), "n_words")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), new_folder(spark, "tokens"), END_ID)
    return token_files.read_tokens(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        spans.alias("removal_spans"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_AT).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def turn_repair_of(conversations: DataFrame) -> DataFrame:
    rows = turn_repair.damaged(conversations)
    plans = written(turn_repair.plans(rows), "turn-plans")
    done = turn_repair.repaired_digests(rows, plans).withColumnRenamed("conv_id", "done_id")
    return plans.join(done, F.col("conv_id").eqNullSafe(F.col("done_id"))).drop("done_id")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair_of(table(spark, sf_dir, "conversations"))


LINES_SQL = r"""
lines AS (
  SELECT doc_id, source, md5(text) AS tx, i, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS nl
  FROM (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS host_docs FROM documents GROUP BY source),
counts AS (
  SELECT l.source, nl, n_docs, host_docs
  FROM (SELECT source, nl, count(DISTINCT tx) AS n_docs FROM lines GROUP BY source, nl) l JOIN hosts h USING (source))
"""

OP8_SQL = (
    r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
k AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM g),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
"""
    + LINES_SQL
    + r""",
gone AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n
  FROM lines JOIN (SELECT source, nl FROM counts WHERE n_docs > 10 AND n_docs > 0.002 * host_docs) USING (source, nl) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND removed_words < 0.7 * n_words AS kept, removed_words
FROM f
"""
)

OP9_SQL = (
    "WITH "
    + LINES_SQL
    + r""",
boiler AS (SELECT source, nl FROM counts WHERE n_docs >= 5 AND n_docs > 0.01 * host_docs),
dropped AS (SELECT doc_id, list(i) AS drop_i FROM lines JOIN boiler USING (source, nl) GROUP BY doc_id),
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, coalesce(drop_i, []) AS drop_i FROM documents LEFT JOIN dropped USING (doc_id))
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(len(drop_i) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string([ls[j + 1] FOR j IN range(len(ls)) IF NOT list_contains(drop_i, j)], chr(10)), '')) AS text_sha256
FROM parts
"""
)

OP12_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

#: The CRC-32 table, and the CRC of a text of ASCII and À-ÿ as UTF-8.
CRC_TABLE = "crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc_sql(text: str) -> str:
    utf8 = f"flatten([CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(c) - 64] END FOR c IN string_split({text}, '')])"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {utf8}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5),
per AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
h AS (SELECT run, k, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM per, crcs),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cuts c ON c.head || c.tail = w.word UNION SELECT c.word, w.word, w.n FROM words w JOIN cuts c ON c.head || c.tail = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, min(near) AS form, min(near_n) AS form_n FROM words w LEFT JOIN best b USING (word) LEFT JOIN near ON near.word = w.word AND near_n = b.top AND b.top >= 2 * w.n GROUP BY ALL),
way AS (SELECT word, form AS upto FROM forms WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.upto WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN (SELECT way.word, upto AS root FROM way JOIN forms e ON e.word = way.upto WHERE e.form IS NULL) r ON r.word = f.word
"""


def edit_sql() -> str:
    """Cheapest edits by the turns of a list: a state's best is its cost in six digits before its audit, so the least text is best. s2
    and s3 take what an insertion leads to."""
    more = lambda s, k, letter: f"lpad(CAST(CAST(left({s}, 6) AS BIGINT) + {k} AS VARCHAR), 6, '0') || substr({s}, 7) || '{letter}'"
    s, t = [f"s[{i}]" for i in (1, 2, 3, 4)], "(CASE WHEN c IN ('S', 'U', 'A', 'O') THEN 1 ELSE 0 END)"
    into = lambda letter, when, k, froms: ", ".join(f"CASE WHEN {when} THEN {more(s[f], f'{k} + {t}', letter)} END" for f in froms)
    gone = [more(x, turn_repair.DELETE, "D") for x in s]
    stays = "c <> 'x'"
    turn = [
        gone[0],
        f"least({gone[1]}, {into('K', 'lower(c) = ' + chr(39) + 's' + chr(39), 0, [0])})",
        f"least({gone[2]}, {into('K', 'lower(c) = ' + chr(39) + 'u' + chr(39), 0, [0, 1, 3])}, {into('R', stays, turn_repair.REROLE, [0, 1, 3])})",
        f"least({gone[3]}, {into('K', 'lower(c) = ' + chr(39) + 'a' + chr(39), 0, [2])}, {into('R', stays, turn_repair.REROLE, [2])})",
    ]
    insert = lambda x: more(x, turn_repair.INSERT, "I")
    two = f"[s[1], s[2], least(s[3], {insert('s[1]')}, {insert('s[2]')}, {insert('s[4]')}), s[4]]"
    three = f"[s[1], s[2], s[3], least(s[4], {insert('s[3]')})]"
    steps = "[['2'], ['3']] || flatten([[[c], ['2'], ['3']] FOR c IN turns])"
    return f"list_reduce([['000000', NULL, NULL, NULL]] || ({steps}), lambda s, one: CASE one[1] WHEN '2' THEN {two} WHEN '3' THEN {three} ELSE [{', '.join(x.replace(' c ', ' one[1] ').replace('(c)', '(one[1])') for x in turn)}] END)"


SPACES = r"[\x20\x09-\x0D]"
OP13_SQL = f"""
WITH {CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, crcs),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM r WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, regexp_replace(text, '{SPACES}+$', '') AS said FROM m),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
l AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN upper(left(role, 1)) ELSE 'O' END WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS letter FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (illegal) AS illegal, list(letter ORDER BY i) AS turns FROM l GROUP BY conv_id),
e AS (SELECT * EXCLUDE (turns), {edit_sql()} AS s FROM c),
a AS (SELECT * EXCLUDE (s), CAST(left(least(s[1], s[4]), 6) AS BIGINT) AS cost, substr(least(s[1], s[4]), 7) AS audit FROM e),
k AS (SELECT conv_id, p, audit[p] AS edit, sum(CASE WHEN audit[p] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM a)),
t AS (SELECT k.conv_id, k.p, k.edit, CASE WHEN edit <> 'I' THEN l.text ELSE '' END AS text, l.role, row_number() OVER w AS place, first(edit = 'K' AND left(l.role, 1) = 's') OVER w AS has_s FROM k LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM k.conv_id AND l.i = k.i AND k.edit <> 'I' WHERE edit <> 'D' WINDOW w AS (PARTITION BY k.conv_id ORDER BY k.p)),
d AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CAST(coalesce(has_s, false) AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS said FROM t GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM q.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_warc": op2_warc,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_near_dedup": op4_near_dedup,
        "op5_token_files": op5_token_files,
        "op6_decontamination": op6_decontamination,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_line_dedup": op9_line_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_turn_repair": op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_turn_repair": OP13_SQL}
