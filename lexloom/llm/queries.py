"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import chatfsm, ctph, fim, fm_index, html_text, line_windows, prefix_trie, quality, secret_cnn, simhash, spm_sample, url_lm, warc
from lexloom.session import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    """The model file; the driver alone reads it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return spm_sample.encode(docs, tokenizer_path())


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def contamination_digest(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(fm_index.contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chatfsm.digests(turns.unionByName(probe)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", fim.restored(F.col("output"), F.col("form"))["sha256"].alias("restored_sha256"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.with_next(_read(spark, sf_dir, "documents").select("doc_id", "text"), ctph.edit_report, ctph.EDIT_FIELDS)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, with the piece ids of each segmentation."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc": op5_warc,
        "op6_html_text": op6_html_text,
        "op7_secret_scan": op7_secret_scan,
        "op8_decontaminate": op8_decontaminate,
        "op9_line_dedup": op9_line_dedup,
        "op10_chat_format": op10_chat_format,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_document_fingerprints": op12_document_fingerprints,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": pipeline,
    }


_SPACE = r"[\x20\x09-\x0D]"

_STOP = ", ".join(f"'{w}'" for w in sorted(set(" ".join(quality.STOP_WORDS.values()).split())))

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, text,
         list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         list_filter(string_split_regex(translate(lower(text), '.,;:!?|()[]{{}}"''', '               '), '{_SPACE}+'), lambda x: x <> '') AS pw
  FROM d),
win AS (
  SELECT doc_id, i, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a1, a2, a3) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
s AS (
  SELECT a.doc_id, len(w) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(pw, lambda x: x IN ({_STOP}))) AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '^{_SPACE}*[-*•]'))) AS bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){_SPACE}*$'))) AS ellipsis
  FROM a LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND word_chars::DOUBLE / n_words >= 2.5 AND word_chars::DOUBLE / n_words <= 12.0
       AND n_symbols::DOUBLE / n_words <= 0.1::DOUBLE AND n_stop::DOUBLE / n_words >= 0.05::DOUBLE
       AND n_dup_lines::DOUBLE / n_lines <= 0.5 AND bullet::DOUBLE / n_lines <= 0.9::DOUBLE AND ellipsis::DOUBLE / n_lines <= 0.3::DOUBLE AS kept
FROM s
"""

_LINES = rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
f AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, pos AS first, lead(pos, 2) OVER o AS last, s AS a, lead(s, 1) OVER o AS b, lead(s, 2) OVER o AS c
      FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, first, last FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS n FROM w WHERE last IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT x.doc_id, x.pos FROM x JOIN later ON x.doc_id = later.doc_id AND x.pos BETWEEN later.first AND later.last),
kept AS (SELECT x.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY x.pos) AS text,
                count(CASE WHEN g.pos IS NOT NULL AND regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 END) AS n_removed,
                count(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 END) AS n_lines
         FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM kept
"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT) >> {shift}) & 31)::INT + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM asked),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT place.doc_id, place.i, place.n, asked.item_id FROM place JOIN asked ON place.n = asked.n AND place.phrase = asked.phrase),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CONTROLS = "(" + "|".join("".join("[" + c + "]" if c in "[]()<>/" and c not in "[]" else "\\" + c if c in "[]" else c for c in m) for m in chatfsm.INSTRUCT.controls) + ")"

_CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '{_CONTROLS}'))
               + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 ELSE 9 END AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars,
       regexp_matches(string_agg(role, ',' ORDER BY turn, role, text), '^(system,)?user,assistant(,user,assistant)*$') AS valid
FROM e GROUP BY conv_id
"""


_FIM = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS g FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             ('0x' || substr(g, 1, 8))::BIGINT AS h1, ('0x' || substr(g, 9, 8))::BIGINT AS h2, ('0x' || substr(g, 17, 8))::BIGINT AS h3, ('0x' || substr(g, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:n], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE x || y || z END) AS restored_sha256
FROM p
"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)"""

_TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
c AS (SELECT l.conv_id, l.conv_id - l.conv_id % 100 AS base, {_CRC32.replace("conv_id", "l.conv_id")} % 6 AS h FROM l),
g AS (SELECT c.conv_id, base, h, least(h, coalesce(l.own, 0)) AS given FROM c LEFT JOIN l ON l.conv_id = c.base),
r AS (SELECT g.conv_id, t.pos AS depth, role, text FROM g JOIN t ON t.conv_id = g.base AND t.pos <= g.h
      UNION ALL SELECT g.conv_id, t.pos - h + given, role, text FROM g JOIN t ON t.conv_id = g.conv_id AND t.pos > g.h),
m AS (SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM l),
n AS (SELECT depth, k, min(conv_id) AS node, count(*) AS n_convs, max(chars) AS chars FROM m GROUP BY depth, k),
e AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id) USING (conv_id, depth) GROUP BY depth, k),
up AS (SELECT n.depth, n.k, pn.k AS parent_k, pn.node AS parent FROM n JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1 JOIN n pn ON pn.depth = m.depth AND pn.k = m.k),
kids AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n FROM up GROUP BY ALL),
below AS (SELECT m.depth, m.k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
          FROM n JOIN m ON m.conv_id = n.node AND m.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k GROUP BY m.depth, m.k)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, up.parent AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN below USING (depth, k) LEFT JOIN up USING (depth, k) LEFT JOIN kids USING (depth, k) LEFT JOIN e USING (depth, k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": _QUALITY,
        "op5_warc": _WARC,
        "op8_decontaminate": _LEAKS,
        "op9_line_dedup": _LINES,
        "op10_chat_format": _CHAT,
        "op11_fill_in_middle": _FIM,
        "op13_prefix_trie": _TRIE,
    }
