"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.chat import chat_lines
from millrace.llm.decontaminate import decontaminate
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.filter_audit import filter_audit
from millrace.llm.html_extract import main_text
from millrace.llm.importance import importance_resample
from millrace.llm.lang_id import language_id
from millrace.llm.ngram_join import ngram_join
from millrace.llm.packing import pack
from millrace.llm.token_count import token_counts
from millrace.llm.token_store import token_ids
from millrace.llm.toxicity import fit as fit_toxicity
from millrace.llm.toxicity import toxicity
from millrace.llm.warc import warc_archive

#: Target shares of the packed sources are their tokens to this power: large sources are held back.
MIXTURE_TEMPERATURE = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048, temperature=MIXTURE_TEMPERATURE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive(_table(spark, sf_dir, "pages"))


#: The schemas that calls are checked against, as ``conversations`` carries none: tool, parameter, JSON type, required.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("calculate", "expression", "string", True), ("calculate", "digits", "number", False), ("clock", None, None, False)]


def _values(rows: list[tuple]) -> str:
    """Rows of strings, truth values and nulls as SQL writes them."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def op10_chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.sql(f"SELECT * FROM VALUES {_values(TOOLS)} AS t(name, parameter, type, required)")
    return chat_lines(_table(spark, sf_dir, "conversations"), tools)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least=20, buckets=10_000, seed=2024)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_main_text": op6_main_text,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_chat_lines": op10_chat_lines,
    "op11_importance": op11_importance,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}

#: Two marks between which numbers are strings, as in the operator, and a number in JSON.
_A, _B, _NUMBER = "beginofnumber", "endofnumber", r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _marked(text: str) -> str:
    both = rf"""regexp_replace({text}, '("(?:[^"\\]|\\.)*")|({_NUMBER})', '\1{_A}\2{_B}', 'g')"""
    return rf"""regexp_replace(replace({both}, '{_A}{_B}', ''), '{_A}({_NUMBER}){_B}', '"{_A}\1{_B}"', 'g')"""


def _plain(value: str) -> str:
    return rf"regexp_replace({value}, '^{_A}({_NUMBER}){_B}$', '\1')"


_CHAT = f"""
    WITH t(tool, parameter, kind, required) AS (VALUES {_values(TOOLS)}),
    m AS (SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rid, conv_id, turn, role, text,
          CASE WHEN ltrim(text) LIKE '{{%' AND json_valid(text) THEN CAST({_marked("text")} AS JSON) END AS raw FROM conversations),
    k AS (SELECT *, len(json_keys(raw)) <> list_unique(json_keys(raw)) OR (role = 'assistant' AND json_type(raw, '$.tool_calls') = 'ARRAY'
                    AND len(list_filter(CAST(raw->'$.tool_calls' AS JSON[]), lambda c: {" OR ".join(f"(json_type(c, '{x}') = 'OBJECT' AND len(json_keys(c, '{x}')) <> list_unique(json_keys(c, '{x}')))" for x in ("$", "$.arguments", "$.function", "$.function.arguments"))})) > 0) AS twice FROM m),
    p0 AS (SELECT rid, conv_id, turn, role, text, coalesce(twice, false) AND role IN ('assistant', 'tool') AS twice, CASE WHEN NOT twice THEN raw END AS v FROM k),
    p AS (SELECT *, CASE WHEN role = 'assistant' AND json_type(v, '$.tool_calls') = 'ARRAY' THEN CAST(v->'$.tool_calls' AS JSON[]) END AS calls,
          CASE WHEN role = 'tool' THEN {_plain("v->>'$.tool_call_id'")} END AS answers FROM p0),
    e AS (SELECT rid, conv_id, turn, unnest(calls) AS c, generate_subscripts(calls, 1) - 1 AS place FROM p WHERE calls IS NOT NULL),
    e2 AS (SELECT *, CASE WHEN json_type(c, '$.arguments') IS NULL THEN c->'$.function.arguments' ELSE c->'$.arguments' END AS given FROM e),
    c AS (SELECT rid, conv_id, turn, place, {_plain("c->>'$.id'")} AS call_id, {_plain("coalesce(c->>'$.name', c->>'$.function.name')")} AS name,
          CASE WHEN json_type(given) = 'VARCHAR' AND json_valid(given->>'$') THEN CAST({_marked("given->>'$'")} AS JSON) ELSE given END AS args FROM e2),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS FIRST, rid, place) AS nth FROM c WHERE call_id IS NOT NULL) WHERE nth = 1),
    l AS (SELECT p.rid, f.turn AS call_turn, f.rid AS call_rid, f.place AS call_place FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.answers = f.call_id),
    g AS (SELECT rid, place, name, key, CASE WHEN json_extract_string(args, '$."' || key || '"') SIMILAR TO '{_A}-?[0-9]+{_B}' THEN 'BIGINT' WHEN json_extract_string(args, '$."' || key || '"') LIKE '{_A}%' THEN 'DOUBLE' ELSE json_type(args, '$."' || key || '"') END AS seen FROM (SELECT *, unnest(json_keys(args)) AS key FROM c WHERE json_type(args) = 'OBJECT')),
    bad AS (
        SELECT rid, place, 'unknown tool' AS error FROM c WHERE name IS NULL OR name NOT IN (SELECT tool FROM t)
        UNION SELECT rid, place, 'arguments are no object' FROM c WHERE coalesce(json_type(args), '') <> 'OBJECT'
        UNION SELECT rid, place, 'type of ' || key FROM g JOIN t ON name = tool AND key = parameter
              WHERE NOT list_contains(CASE kind WHEN 'string' THEN ['VARCHAR'] WHEN 'integer' THEN ['BIGINT', 'UBIGINT'] WHEN 'number' THEN ['BIGINT', 'UBIGINT', 'DOUBLE'] WHEN 'boolean' THEN ['BOOLEAN'] WHEN 'object' THEN ['OBJECT'] WHEN 'array' THEN ['ARRAY'] WHEN 'null' THEN ['NULL'] ELSE [seen] END, seen)
        UNION SELECT rid, place, 'unexpected ' || key FROM g WHERE name IN (SELECT tool FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE tool = name AND parameter = key)
        UNION SELECT rid, place, 'missing ' || parameter FROM c JOIN t ON name = tool WHERE required AND NOT EXISTS (SELECT 1 FROM g WHERE g.rid = c.rid AND g.place = c.place AND g.key = parameter)),
    per AS (SELECT rid, count(*) AS n_calls, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.call_rid = c.rid AND l.call_place = c.place) THEN 0 ELSE 1 END) AS BIGINT) AS n_open,
            string_agg(regexp_replace('{{"arguments":' || CASE WHEN json_type(args) = 'OBJECT' THEN '{{' || coalesce((SELECT string_agg(CAST(to_json(k) AS VARCHAR) || ':' || CAST(json_extract(args, '$."' || k || '"') AS VARCHAR), ',' ORDER BY k) FROM (SELECT unnest(json_keys(args)) AS k)), '') || '}}' ELSE coalesce(CAST(args AS VARCHAR), 'null') END
                       || ',"id":' || coalesce(CAST(to_json(call_id) AS VARCHAR), 'null') || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || '}}', '"{_A}({_NUMBER}){_B}"', '\\1', 'g'), ',' ORDER BY place) AS made FROM c GROUP BY rid),
    wrong AS (SELECT rid, string_agg(error, '; ' ORDER BY error) AS errors FROM bad GROUP BY rid),
    a AS (SELECT p.*, n_calls, n_open, made, errors AS said_wrong, call_turn, call_rid, call_place,
          CAST(to_json(struct_pack(content := CASE WHEN calls IS NOT NULL OR answers IS NOT NULL THEN {_plain("v->>'$.content'")} ELSE text END, role := role)) AS VARCHAR) AS plain
          FROM p LEFT JOIN per ON p.rid = per.rid LEFT JOIN wrong ON p.rid = wrong.rid LEFT JOIN l ON p.rid = l.rid)
    SELECT conv_id, turn, role,
           row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN call_rid IS NOT NULL THEN call_turn ELSE turn END NULLS FIRST, coalesce(call_place, -1), turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, rid) - 1 AS position,
           coalesce(n_calls, 0) AS n_calls, coalesce(n_open, 0) AS n_open, call_turn,
           CASE WHEN call_rid IS NOT NULL THEN 'linked' WHEN answers IS NOT NULL THEN 'orphan' WHEN said_wrong IS NOT NULL THEN 'invalid' WHEN calls IS NOT NULL THEN 'call' WHEN twice THEN 'ambiguous' ELSE 'message' END AS status,
           coalesce(said_wrong, '') AS errors,
           CASE WHEN calls IS NOT NULL THEN plain[:-2] || ',"tool_calls":[' || coalesce(made, '') || ']}}' WHEN answers IS NOT NULL THEN plain[:-2] || ',"tool_call_id":' || CAST(to_json(answers) AS VARCHAR) || '}}' ELSE plain END AS line
    FROM a"""

ORACLES: dict[str, str] = {
    "op11_importance": r"""
        WITH ab AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, ab),
        i AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark, ab),
        dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
        steps AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM i)),
        crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(w))), lambda k: CAST('0x' || substr(hex(encode(w)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
                  lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket FROM words, steps),
        s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
        t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM i JOIN crc USING (w) GROUP BY bucket),
        sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
        g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
        v AS (SELECT doc_id, sum(n * gain) AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY doc_id),
        h AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) AS h FROM d LEFT JOIN v USING (doc_id)),
        c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM c WHERE n_features >= 20)
        SELECT c.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM c LEFT JOIN r USING (doc_id)""",
    "op13_filter_audit": r"""
        WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
              CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 65 * len(w) THEN 'B' ELSE '' END
              || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 'C' ELSE '' END
              || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
              FROM d LEFT JOIN l USING (doc_id)),
        n AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o)),
        y AS (SELECT *, contains(fails, letter) AS here, length(translate(fails, before, '')) < length(fails) AS earlier FROM n, s),
        z AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
              sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
              sum(CASE WHEN here AND NOT earlier AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier AND toxic THEN n ELSE 0 END) AS toxic_lost FROM y GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_decontaminate": r"""
        WITH ab AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, ab),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, ab),
        win AS (SELECT item_id, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM win),
        dw AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS t
               FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
        occ AS (SELECT doc_id, item_id, s, dw.size FROM dw JOIN win ON dw.t = win.t AND dw.size = win.size),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op10_chat_lines": _CHAT,
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
    "op9_warc": """
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || rpad(substr(s, 1 + i * 5 // 4, 2), 2, '0') AS INTEGER) >> (3 - i * 5 % 4)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
}
