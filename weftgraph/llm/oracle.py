"""DuckDB SQL for the training-data queries that SQL can say. It works from the contracts, not from the operators' code.

The ids of the tables are taken to be unique. Left out: fingerprints need XXH64, packing and binary output a
tokenizer, the classifier a fitted model, and PII matches positions that DuckDB's regular expressions don't give.
"""

from __future__ import annotations

from weftgraph.llm import decontaminate, quality_rules, sharding

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"


def low(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def quality_sql(lost_share: float = quality_rules.LOST_SHARE) -> str:
    width, rules = quality_rules.WINDOW, quality_rules
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS words FROM documents),
    lines AS (SELECT doc_id, text, ln, line, regexp_extract_all(line, '{SPACED}') AS words, translate(line, '{UPPER}0123456789', '{LOWER}0000000000') AS normal
              FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d)),
    wordy AS (SELECT *, lag(normal) OVER (PARTITION BY doc_id ORDER BY ln) AS above, lead(normal) OVER (PARTITION BY doc_id ORDER BY ln) AS below FROM lines WHERE len(words) > 0),
    common AS (SELECT normal FROM (SELECT normal, above, below, count(DISTINCT text) AS n FROM wordy WHERE len(words) >= {rules.LINE_WORDS} GROUP BY ALL)
               GROUP BY normal HAVING sum(n) >= {rules.LINE_TEXTS} AND count(*) >= {rules.LINE_SPREAD} * sum(n)),
    told AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY ln) > 1 AS again, len(words) AS n, normal IN (SELECT normal FROM common) AND len(words) >= {rules.LINE_WORDS} AS known,
                    len(list_filter(words, lambda w: list_contains({quoted(rules.NAVIGATION)}, w))) AS marks,
                    len(list_filter(words, lambda w: regexp_matches(w, '[!?][!?]$'))) AS shouts,
                    len(list_filter({quoted(rules.ENDS)}, lambda e: ends_with(words[-1], e))) AS ends,
                    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
                    length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper_n, length(regexp_replace(line, '[^a-z]', '', 'g')) AS lower_n
             FROM wordy),
    judged AS (SELECT doc_id, n, again, CASE WHEN known THEN 'b' WHEN marks >= 2 AND 3 * marks >= n THEN 'n'
                      WHEN n >= 5 AND (ends = 0 OR 4 * symbols > n OR 2 * shouts > n OR 5 * upper_n > 4 * (upper_n + lower_n)) THEN 'p' END AS fault FROM told),
    per_line AS (SELECT doc_id, count(*) FILTER (again) AS dups, coalesce(sum(n) FILTER (fault IS NOT NULL), 0) AS lost,
                        count(*) FILTER (fault = 'b') AS b, count(*) FILTER (fault = 'n') AS nav, count(*) FILTER (fault = 'p') AS p FROM judged GROUP BY doc_id),
    spots AS (SELECT doc_id, unnest(range(1, len(words) - {width - 2})) AS i, words FROM d WHERE len(words) >= {width}),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + {width - 1}], ' ')) AS times FROM spots),
    repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range({width}) AS r(k) WHERE times > 1 GROUP BY doc_id),
    base AS (SELECT d.doc_id, len(d.words) AS n_words, length(array_to_string(d.words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                    coalesce(dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words, coalesce(b, 0) AS b, coalesce(nav, 0) AS nav, coalesce(p.p, 0) AS p
             FROM d LEFT JOIN per_line p ON d.doc_id = p.doc_id LEFT JOIN repeats r ON d.doc_id = r.doc_id),
    failed AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_SHARE} * n_words AS base_failed FROM base)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT base_failed AND n_lost_words <= {lost_share} * n_words AS kept, CAST(n_lost_words AS BIGINT) AS n_lost_words,
           CAST(b AS BIGINT) AS n_boilerplate, CAST(nav AS BIGINT) AS n_navigation, CAST(p AS BIGINT) AS n_punctuation
    FROM failed"""


def repeats_sql(width: int = 100) -> str:
    return f"""
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
    sized AS (SELECT doc_id, raw, octet_length(raw) AS n FROM d),
    spots AS (SELECT doc_id, i, raw[i:i + {width - 1}] AS w FROM (SELECT doc_id, raw, unnest(range(1, n - {width - 2})) AS i FROM sized WHERE n >= {width})),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM spots) WHERE r > 1),
    steps AS (SELECT doc_id, i, CAST(i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{width + 1}) + {width} AS INT) AS starts FROM again),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + {width} AS z FROM (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps) GROUP BY doc_id, run),
    cut AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
    edges AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS first, a - 1 AS last FROM runs
              UNION ALL SELECT s.doc_id, coalesce(max(r.z), 1), any_value(s.n) FROM sized s LEFT JOIN runs r ON s.doc_id = r.doc_id GROUP BY s.doc_id),
    kept AS (SELECT e.doc_id, string_agg(CASE WHEN first <= last THEN hex(raw[first:last]) ELSE '' END, '' ORDER BY first, last) AS bytes
             FROM edges e JOIN sized s ON e.doc_id = s.doc_id GROUP BY e.doc_id)
    SELECT s.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(bytes)) AS kept_sha256
    FROM sized s JOIN kept k ON s.doc_id = k.doc_id LEFT JOIN cut c ON s.doc_id = c.doc_id"""


CHATS = """
    WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    inner_ones AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
    ends AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns)
    SELECT conv_id, len(turns) AS n_turns, n_copies,
           array_to_string(list_transform(turns, lambda t: '<|' || coalesce(nullif(t.role, ''), 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '') AS rendered
    FROM ends e WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.turns = e.turns)"""


def contamination_sql(width: int = decontaminate.WINDOW) -> str:
    words = rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, {words}) AS words FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({low("coalesce(text, '')")}, {words}) AS words FROM benchmark WHERE item_id IS NOT NULL),
    parts AS (SELECT item, words, least(len(words), {width}) AS m, unnest(range(1, greatest(len(words) - {width - 1}, 1) + 1)) AS i FROM b WHERE len(words) > 0),
    patterns AS (SELECT DISTINCT item, m, array_to_string(words[i:i + m - 1], ' ') AS w FROM parts),
    lengths AS (SELECT DISTINCT m FROM patterns),
    spots AS (SELECT doc_id, m, i, array_to_string(words[i:i + m - 1], ' ') AS w
              FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d JOIN lengths ON len(words) >= m)),
    found AS (SELECT s.doc_id, s.i, s.m, p.item FROM spots s JOIN patterns p ON s.m = p.m AND s.w = p.w),
    hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS spot FROM found) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id"""


def sharding_sql(shards: int, grown: int, buckets: int = sharding.SLOT_BUCKETS) -> str:
    def winner(n: int) -> str:
        drawn = "(CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"
        return f"(SELECT doc_id, CAST(arg_min(s, -ln({drawn})) AS INT) AS shard FROM documents, range({n}) AS r(s) GROUP BY doc_id)"

    return f"""
    WITH crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) AS r(b)),
    raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    bytes AS (SELECT doc_id, length(h) // 2 + 1 AS size, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)) AS b FROM raw),
    summed AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc),
    dealt AS (SELECT s.doc_id, size, text_crc32, a.shard, g.shard AS grown_shard, CAST('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 6) AS BIGINT) % {buckets} AS bucket
              FROM summed s JOIN {winner(shards)} a ON s.doc_id = a.doc_id JOIN {winner(grown)} g ON s.doc_id = g.doc_id)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot, grown_shard FROM dealt"""
