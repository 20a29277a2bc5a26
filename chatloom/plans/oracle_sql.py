"""DuckDB SQL that recomputes each registered query from the raw driver tables.

The SQL is written independently of the Spark plans: it works on long (one row per
turn / token / paragraph) tables with window functions and recursive CTEs. Shared input
derivations mirror ``chatloom.sources.derived``.
"""

from __future__ import annotations

from chatloom.schema import WS_CLASS

WS = WS_CLASS + "+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def norm_sql(x: str) -> str:
    s = strip_sql(f"lower({x})")
    return f"(CASE {s} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {s} END)"


def repr_sql(x: str) -> str:
    return f"('''' || {x} || '''')"


def canon_md5(role: str, content: str, order: str) -> str:
    return f"md5(coalesce(string_agg({role} || chr(1) || {content}, chr(0) ORDER BY {order}), ''))"


SAMPLE_TURNS = "SELECT conv_id AS ord, turn, role, text AS content FROM conversations"

DIRTY_TURNS = """
SELECT conv_id AS ord, turn,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN 'tool'
       WHEN role = 'user' THEN ['user', 'human', ' User ', 'USER'][((conv_id + turn) % 4) + 1]
       WHEN role = 'assistant' THEN ['assistant', 'GPT', 'bot', 'Assistant'][((conv_id + turn) % 4) + 1]
       ELSE role END AS role,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN CASE WHEN turn % 2 = 0 THEN '' ELSE '   ' END
       WHEN turn % 3 = 0 THEN '  ' || text || chr(160)
       ELSE text END AS content
FROM conversations"""

DOC_TURNS = """
SELECT doc_id AS ord, 0 AS turn, 'user' AS role, source AS content FROM documents
UNION ALL
SELECT doc_id AS ord, 1 AS turn, 'assistant' AS role, text AS content FROM documents"""

# Repair of the dirty turns: annotated messages, kept messages, first failing rule.
def repair_ctes(turns_sql: str) -> str:
    """``turns_sql`` yields (ord, turn, role, content)."""
    return REPAIR_CTES_TEMPLATE.replace("@TURNS@", turns_sql)


REPAIR_CTES_TEMPLATE = f"""
dt AS (@TURNS@),
ann AS (
  SELECT ord, turn, (row_number() OVER (PARTITION BY ord ORDER BY turn) - 1) AS pos,
         role AS raw_role, content AS raw, {strip_sql('content')} AS stripped, {norm_sql('role')} AS norm
  FROM dt),
k AS (
  SELECT ord, pos, norm AS role, stripped AS content FROM ann
  WHERE stripped <> '' AND norm IN ('system', 'user', 'assistant')),
ns AS (
  SELECT ord, role, (row_number() OVER (PARTITION BY ord ORDER BY pos) - 1) AS nspos FROM k WHERE role <> 'system'),
nsl AS (SELECT ord, role, nspos, lag(role) OVER (PARTITION BY ord ORDER BY nspos) AS prev FROM ns),
kstat AS (SELECT ord, count(*) AS n, bool_or(role = 'user') AS hu, bool_or(role = 'assistant') AS ha FROM k GROUP BY ord),
first_ns AS (SELECT ord, role AS frole FROM ns WHERE nspos = 0),
firstrep AS (SELECT ord, min(nspos) AS rep FROM nsl WHERE role = prev GROUP BY ord),
reason0 AS (
  SELECT s.ord, f.frole, fr.rep,
    CASE WHEN coalesce(ks.n, 0) = 0 THEN 'no_messages'
         WHEN NOT ks.hu THEN 'no_user'
         WHEN NOT ks.ha THEN 'no_assistant'
         WHEN f.frole <> 'user' THEN 'first_not_user'
         WHEN fr.rep IS NOT NULL THEN 'consecutive_roles' END AS code
  FROM (SELECT DISTINCT ord FROM dt) s
  LEFT JOIN kstat ks ON ks.ord = s.ord LEFT JOIN first_ns f ON f.ord = s.ord LEFT JOIN firstrep fr ON fr.ord = s.ord),
reason AS (
  SELECT r.ord, r.code,
    CASE r.code
      WHEN 'no_messages' THEN 'Dropped sample: no messages remaining after cleanup.'
      WHEN 'no_user' THEN 'Dropped sample: no ''user'' turn after repair.'
      WHEN 'no_assistant' THEN 'Dropped sample: no ''assistant'' turn after repair.'
      WHEN 'first_not_user' THEN 'Dropped sample: first non-system turn is ' || {repr_sql('r.frole')} || ', expected ''user''.'
      WHEN 'consecutive_roles' THEN 'Dropped sample: consecutive ' || {repr_sql('(SELECT role FROM ns WHERE ns.ord = r.ord AND ns.nspos = r.rep)')}
           || ' turns at positions ' || (r.rep - 1) || ',' || r.rep || '.'
    END AS detail
  FROM reason0 r)"""

REPAIR_CTES = REPAIR_CTES_TEMPLATE.replace("@TURNS@", DIRTY_TURNS)


def q(sql: str) -> str:
    return sql.strip()


ORACLES: dict[str, str] = {}

ORACLES["nest_turns"] = q(f"""
WITH t AS ({SAMPLE_TURNS})
SELECT ord, count(*) AS n_messages, {canon_md5('role', 'content', 'turn')} AS canon_md5 FROM t GROUP BY ord""")

ORACLES["first_qa"] = q(f"""
WITH t AS ({SAMPLE_TURNS})
SELECT ord,
  coalesce(arg_min(content, turn) FILTER (WHERE role = 'user'), '') AS question,
  coalesce(arg_min(content, turn) FILTER (WHERE role = 'assistant'), '') AS answer
FROM t GROUP BY ord""")

ORACLES["assistant_chars"] = q(f"""
WITH t AS ({SAMPLE_TURNS})
SELECT ord, coalesce(sum(length(content)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS assistant_chars FROM t GROUP BY ord""")

ORACLES["render_chat"] = q(f"""
WITH t AS ({SAMPLE_TURNS}),
r AS (SELECT ord, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
      FROM t GROUP BY ord)
SELECT ord, md5(chat) AS chat_md5, length(chat)::BIGINT AS chat_len FROM r""")

ORACLES["min_answer_filter"] = q(f"""
WITH t AS ({SAMPLE_TURNS}),
a AS (SELECT ord, coalesce(sum(length(content)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS assistant_chars FROM t GROUP BY ord)
SELECT ord, assistant_chars FROM a WHERE assistant_chars >= 50""")

ORACLES["normalize_roles"] = q(f"""
WITH dt AS ({DIRTY_TURNS})
SELECT role, {norm_sql('role')} AS normalized_role, count(*)::BIGINT AS n FROM dt GROUP BY role""")

ORACLES["repair_messages"] = q(f"""
WITH {REPAIR_CTES}
SELECT s.ord, s.n_in, coalesce(kk.n_out, 0)::BIGINT AS n_out, coalesce(kk.canon_md5, md5('')) AS canon_md5
FROM (SELECT ord, count(*)::BIGINT AS n_in FROM dt GROUP BY ord) s
LEFT JOIN (SELECT ord, count(*)::BIGINT AS n_out, {canon_md5('role', 'content', 'pos')} AS canon_md5 FROM k GROUP BY ord) kk
  ON kk.ord = s.ord""")

ORACLES["validate_and_repair"] = q(f"""
WITH {REPAIR_CTES}
SELECT k.ord, count(*)::BIGINT AS n_messages, {canon_md5('k.role', 'k.content', 'k.pos')} AS canon_md5
FROM k JOIN reason r ON r.ord = k.ord WHERE r.code IS NULL GROUP BY k.ord""")

ORACLES["drop_reasons"] = q(f"""
WITH {REPAIR_CTES}
SELECT ord, code, detail FROM reason WHERE code IS NOT NULL""")

ORACLES["repair_warnings"] = q(f"""
WITH {REPAIR_CTES},
w AS (
  SELECT ord, pos AS msg_pos, 0 AS sub, 'empty_content' AS code,
         'Removed message with empty content (role=' || {repr_sql('raw_role')} || ')' AS detail
  FROM ann WHERE stripped = ''
  UNION ALL
  SELECT ord, pos, 0, 'stripped_whitespace',
         'Stripped whitespace from message content (role=' || {repr_sql('raw_role')} || ')'
  FROM ann WHERE stripped <> '' AND stripped <> raw
  UNION ALL
  SELECT ord, pos, 1, 'unknown_role',
         'Removed message with unknown role ' || {repr_sql('raw_role')} || ' (normalized: ' || {repr_sql('norm')} || ')'
  FROM ann WHERE stripped <> '' AND norm NOT IN ('system', 'user', 'assistant')
  UNION ALL
  SELECT ord, pos, 1, 'normalized_role', 'Normalized role ' || {repr_sql('raw_role')} || ' -> ' || {repr_sql('norm')}
  FROM ann WHERE stripped <> '' AND norm IN ('system', 'user', 'assistant') AND norm <> raw_role
  UNION ALL
  SELECT ord, NULL, 2, code, detail FROM reason WHERE code IS NOT NULL)
SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY coalesce(msg_pos, 1000000000), sub) - 1)::INTEGER AS seq,
       coalesce(msg_pos, -1)::INTEGER AS msg_pos, code, 'Sample ' || ord || ': ' || detail AS message
FROM w""")

ORACLES["validate_strict"] = q(f"""
WITH dt AS ({DIRTY_TURNS}),
m AS (SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY turn) - 1) AS pos, role, content, {norm_sql('role')} AS norm FROM dt),
s AS (SELECT ord, bool_or(norm = 'user') AS hu, bool_or(norm = 'assistant') AS ha FROM m GROUP BY ord),
e AS (
  SELECT ord, NULL AS msg_pos, 0 AS k, 'missing_user' AS code, 'Sample ' || ord || ': missing ''user'' turn.' AS message FROM s WHERE NOT hu
  UNION ALL
  SELECT ord, NULL, 1, 'missing_assistant', 'Sample ' || ord || ': missing ''assistant'' turn.' FROM s WHERE NOT ha
  UNION ALL
  SELECT ord, pos, 2 + 2 * pos, 'empty_content', 'Sample ' || ord || ', message ' || pos || ': empty content.'
  FROM m WHERE {strip_sql('content')} = ''
  UNION ALL
  SELECT ord, pos, 3 + 2 * pos, 'unknown_role', 'Sample ' || ord || ', message ' || pos || ': unknown role ' || {repr_sql('role')} || '.'
  FROM m WHERE norm NOT IN ('system', 'user', 'assistant'))
SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY k) - 1)::INTEGER AS seq, coalesce(msg_pos, -1)::INTEGER AS msg_pos, code, message FROM e""")

ORACLES["assign_ids"] = q(f"""
WITH {REPAIR_CTES},
kept AS (SELECT ord FROM reason WHERE code IS NULL)
SELECT ord, (row_number() OVER (ORDER BY ord) - 1)::BIGINT AS pos,
       printf('sample_%04d', row_number() OVER (ORDER BY ord) - 1) AS id
FROM kept""")

ORACLES["train_eval_split"] = q(f"""
WITH {REPAIR_CTES},
kept AS (SELECT ord, (row_number() OVER (ORDER BY ord) - 1)::BIGINT AS pos FROM reason WHERE code IS NULL),
n AS (SELECT count(*) AS n FROM kept)
SELECT ord, pos, pos < floor(n * 0.9::DOUBLE) AS is_train, pos >= n - greatest(1, floor(n * 0.1::DOUBLE)) AS is_eval FROM kept, n""")

ORACLES["exact_dedup"] = q(f"""
WITH t AS ({DOC_TURNS}),
c AS (SELECT ord, {canon_md5('role', 'content', 'turn')} AS canon_md5,
             string_agg(role || chr(1) || content, chr(0) ORDER BY turn) AS canon FROM t GROUP BY ord)
SELECT min(ord) AS ord, any_value(canon_md5) AS canon_md5 FROM c GROUP BY canon""")


# ---------------------------------------------------------------------------
# Near duplicates: token sets, identical-set collapse, all-pairs Jaccard, greedy scan
# ---------------------------------------------------------------------------

def _perm_values(num_perm: int = 128) -> str:
    from chatloom.operators.minhash import perm_params

    a, b = perm_params(num_perm)
    return ", ".join(f"({i}, {int(a[i])}, {int(b[i])})" for i in range(num_perm))


def token_ctes(docs_sql: str) -> str:
    """``docs_sql`` yields (ord, text). Defines tl (token lists), toks, sizes, reps, members."""
    return f"""
docs AS ({docs_sql}),
tl AS (SELECT ord, list_distinct(list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> '')) AS tl FROM docs),
toks AS (SELECT ord, unnest(tl) AS tok FROM tl),
sizes AS (SELECT ord, len(tl)::BIGINT AS n FROM tl),
setkey AS (SELECT ord, CASE WHEN len(tl) = 0 THEN 'empty:' || ord ELSE md5(array_to_string(list_sort(tl), ' ')) END AS k FROM tl),
reps AS (SELECT min(ord) AS rep FROM setkey GROUP BY k),
rtok AS (SELECT t.ord, t.tok FROM toks t SEMI JOIN reps r ON r.rep = t.ord)"""


def greedy_ctes(pairs: str = "pairs") -> str:
    return f"""
gnodes AS (SELECT x, row_number() OVER (ORDER BY x) AS rn FROM (SELECT DISTINCT b AS x FROM {pairs})),
rec(rn, dropped) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT o.rn, CASE WHEN EXISTS (SELECT 1 FROM {pairs} p WHERE p.b = o.x AND NOT list_contains(r.dropped, p.a))
                    THEN list_append(r.dropped, o.x) ELSE r.dropped END
  FROM rec r JOIN gnodes o ON o.rn = r.rn + 1),
gdropped AS (SELECT unnest(dropped) AS x FROM rec WHERE rn = (SELECT coalesce(max(rn), 0) FROM gnodes)),
gkept AS (SELECT rep AS ord FROM reps WHERE rep NOT IN (SELECT x FROM gdropped))"""


def jaccard_pairs_cte(threshold: float = 0.85) -> str:
    return f"""
inter AS (SELECT a.ord AS a, b.ord AS b, count(*) AS i FROM rtok a JOIN rtok b ON a.tok = b.tok AND a.ord < b.ord GROUP BY ALL),
pairs AS (
  SELECT a, b, i / (sa.n + sb.n - i) AS jaccard FROM inter
  JOIN sizes sa ON sa.ord = a JOIN sizes sb ON sb.ord = b
  WHERE i / (sa.n + sb.n - i) >= {threshold})"""


def minhash_ctes(num_perm: int = 128) -> str:
    return f"""
perm(i, a, b) AS (VALUES {_perm_values(num_perm)}),
htl AS (SELECT ord, CASE WHEN len(tl) = 0 THEN ['__empty__' || ord] ELSE tl END AS tl FROM tl),
hh AS (SELECT ord, ('0x' || substr(md5(unnest(tl)), 1, 8))::BIGINT % 2147483647 AS h FROM htl),
mh AS (SELECT hh.ord, p.i, min((p.a * hh.h + p.b) % 2147483647) AS m FROM hh CROSS JOIN perm p GROUP BY ALL)"""


DOC_TEXT = "SELECT doc_id AS ord, text FROM documents"
DOC_CANON = ("SELECT doc_id AS ord, 'user' || chr(1) || source || chr(0) || 'assistant' || chr(1) || text AS text "
             "FROM documents WHERE length(text) >= 50")

ORACLES["token_sets"] = q(f"""
WITH {token_ctes(DOC_TEXT)}
SELECT ord, len(tl)::BIGINT AS n_tokens, md5(array_to_string(list_sort(tl), ' ')) AS tokens_md5 FROM tl""")

ORACLES["identical_sets"] = q(f"""
WITH {token_ctes(DOC_TEXT)}
SELECT s.ord, min(s2.ord)::BIGINT AS rep FROM setkey s JOIN setkey s2 ON s2.k = s.k GROUP BY s.ord""")

ORACLES["minhash_signatures"] = q(f"""
WITH {token_ctes(DOC_TEXT)}, {minhash_ctes()}
SELECT ord, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS sig_md5 FROM mh GROUP BY ord""")

ORACLES["near_dup_pairs"] = q(f"""
WITH {token_ctes(DOC_TEXT)}, {jaccard_pairs_cte()}
SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs""")

ORACLES["near_dedup"] = q(f"""
WITH RECURSIVE {token_ctes(DOC_TEXT)}, {jaccard_pairs_cte()}, {greedy_ctes()}
SELECT ord FROM gkept""")

ORACLES["dedup_and_filter"] = q(f"""
WITH RECURSIVE {token_ctes(DOC_CANON)}, {jaccard_pairs_cte()}, {greedy_ctes()}
SELECT ord FROM gkept""")


def _lsh_pairs_cte(bands: int = 8, rows: int = 16) -> str:
    return f"""
bandkey AS (SELECT mh.ord, mh.i // {rows} AS band, string_agg(m::VARCHAR, ',' ORDER BY i) AS key
            FROM mh SEMI JOIN reps r ON r.rep = mh.ord WHERE mh.i < {bands * rows} GROUP BY ALL),
pairs AS (SELECT DISTINCT x.ord AS a, y.ord AS b FROM bandkey x JOIN bandkey y
          ON x.band = y.band AND x.key = y.key AND x.ord < y.ord)"""


ORACLES["lsh_candidates"] = q(f"""
WITH {token_ctes(DOC_TEXT)}, {minhash_ctes()}, {_lsh_pairs_cte()}
SELECT a, b FROM pairs""")

ORACLES["near_dedup_lsh"] = q(f"""
WITH RECURSIVE {token_ctes(DOC_TEXT)}, {minhash_ctes()}, {_lsh_pairs_cte()}, {greedy_ctes()}
SELECT ord FROM gkept""")


# ---------------------------------------------------------------------------
# Replies: expected outcomes straight from the conversations and the damage rules
# ---------------------------------------------------------------------------

def _json_str(x: str) -> str:
    return f"replace({x}, chr(10), '\\n')"


REPLY_CTES = f"""
rt AS (SELECT conv_id AS c, turn, role, text FROM conversations),
conv AS (SELECT DISTINCT c FROM rt),
att AS (
  SELECT c AS batch_id, 1 AS attempt, 'call_failed' AS kind FROM conv WHERE c % 13 = 12
  UNION ALL SELECT c, 1, 'no_json' FROM conv WHERE c % 13 <> 12 AND c % 5 = 4
  UNION ALL SELECT c, 2, CASE WHEN c % 3 = 0 THEN 'non_object' ELSE 'damaged' END FROM conv WHERE c % 13 <> 12 AND c % 5 = 4
  UNION ALL SELECT c, 1, 'damaged' FROM conv WHERE c % 13 <> 12 AND c % 5 <> 4),
astat AS (
  SELECT batch_id, attempt, kind,
    CASE kind WHEN 'call_failed' THEN 'call_failed' WHEN 'no_json' THEN 'no_array' WHEN 'non_object' THEN 'non_object_items'
              ELSE CASE WHEN batch_id % 8 = 6 THEN 'salvaged' ELSE 'ok' END END AS status
  FROM att),
orig AS (
  SELECT c, count(*)::BIGINT AS n,
    md5(string_agg(role || chr(1) || text, chr(0) ORDER BY turn)) AS m,
    md5(string_agg(role || chr(1) || '\\p' || text, chr(0) ORDER BY turn)) AS m7,
    '{{"messages":[' || string_agg('{{"role":"' || role || '","content":"' || {_json_str('text')} || '"}}', ',' ORDER BY turn) || ']}}' AS sj,
    '[' || string_agg('{{"role":"' || role || '","content":"' || {_json_str('text')} || '"}}', ',' ORDER BY turn) || ']' AS flat
  FROM rt GROUP BY c),
fl AS (
  SELECT c, turn, role, text, lag(role) OVER w AS prev, lead(role) OVER w AS nxt, lead(text) OVER w AS ntext
  FROM rt WHERE c % 8 = 4 WINDOW w AS (PARTITION BY c ORDER BY turn)),
grp AS (
  SELECT c, turn AS start,
    CASE WHEN role = 'user' AND nxt = 'assistant' THEN 2 ELSE 1 END::BIGINT AS n_messages,
    md5(CASE WHEN role = 'user' AND nxt = 'assistant' THEN role || chr(1) || text || chr(0) || nxt || chr(1) || ntext
             ELSE role || chr(1) || text END) AS canon_md5
  FROM fl WHERE role = 'user' OR (role = 'assistant' AND coalesce(prev, '') <> 'user')),
wrapped AS (SELECT c, start, (row_number() OVER (PARTITION BY c ORDER BY start) - 1)::INTEGER AS pos, n_messages, canon_md5 FROM grp),
items AS (
  SELECT a.batch_id, a.attempt, 0 AS pos, o.n AS n_messages,
         CASE WHEN a.batch_id % 8 = 7 THEN o.m7 ELSE o.m END AS canon_md5, true AS valid
  FROM att a JOIN orig o ON o.c = a.batch_id WHERE a.kind = 'damaged' AND a.batch_id % 8 <> 4
  UNION ALL
  SELECT a.batch_id, a.attempt, 1, 0::BIGINT, '', false
  FROM att a WHERE a.kind = 'damaged' AND a.batch_id % 8 = 0 AND a.batch_id % 3 = 0
  UNION ALL
  SELECT a.batch_id, a.attempt, w.pos, w.n_messages, w.canon_md5, true
  FROM att a JOIN wrapped w ON w.c = a.batch_id WHERE a.kind = 'damaged'),
merged AS (
  SELECT c AS batch_id,
    coalesce((SELECT min(s.attempt) FROM astat s WHERE s.batch_id = conv.c AND s.status IN ('ok', 'salvaged')
              AND NOT EXISTS (SELECT 1 FROM astat f WHERE f.batch_id = conv.c AND f.status = 'call_failed')), -1)::INTEGER AS used_attempt
  FROM conv),
acct AS (
  SELECT m.batch_id, count(i.pos)::BIGINT AS n_items, count(i.pos) FILTER (WHERE i.valid)::BIGINT AS n_valid
  FROM merged m LEFT JOIN items i ON i.batch_id = m.batch_id AND i.attempt = m.used_attempt GROUP BY m.batch_id)"""

ORACLES["reply_parse"] = q(f"""
WITH {REPLY_CTES}
SELECT s.batch_id, s.attempt::INTEGER AS attempt, s.status,
       (SELECT count(*) FROM items i WHERE i.batch_id = s.batch_id AND i.attempt = s.attempt)::BIGINT AS n_items
FROM astat s""")

ORACLES["reply_wrap_flat"] = q(f"""
WITH {REPLY_CTES}
SELECT batch_id, attempt::INTEGER AS attempt, pos::INTEGER AS pos, n_messages, canon_md5, valid FROM items""")

ORACLES["reply_salvage"] = q(f"""
WITH {REPLY_CTES}
SELECT i.batch_id, i.attempt::INTEGER AS attempt, i.pos::INTEGER AS pos, i.canon_md5
FROM items i JOIN astat s ON s.batch_id = i.batch_id AND s.attempt = i.attempt WHERE s.status = 'salvaged'""")

ORACLES["reply_clean"] = q(f"""
WITH {REPLY_CTES},
arr AS (SELECT c, '[' || sj || CASE WHEN c % 8 = 0 AND c % 3 = 0 THEN ',{{"messages":[{{"role":"user","content":5}}]}}' ELSE '' END || ']' AS arr,
               flat FROM orig)
SELECT a.batch_id, a.attempt::INTEGER AS attempt,
  md5(CASE a.kind WHEN 'call_failed' THEN '' WHEN 'no_json' THEN '' WHEN 'non_object' THEN '[1, 2]'
    ELSE CASE a.batch_id % 8
      WHEN 2 THEN x.arr || chr(10) || 'Hope this helps!'
      WHEN 4 THEN x.flat
      WHEN 5 THEN '[ ' || chr(10) || substr(x.arr, 2)
      WHEN 6 THEN substr(x.arr, 1, length(x.arr) - 1) || ',{{"messages":[{{"role":"user","content":"cut off'
      WHEN 7 THEN replace(x.arr, '"content":"', '"content":"\\\\p')
      ELSE x.arr END END) AS cleaned_md5
FROM att a JOIN arr x ON x.c = a.batch_id""")

ORACLES["reply_retry_merge"] = q(f"""
WITH {REPLY_CTES}
SELECT batch_id, used_attempt, CASE WHEN used_attempt > 0 THEN 'ok' ELSE 'failed' END AS status FROM merged""")

ORACLES["batch_accounting"] = q(f"""
WITH {REPLY_CTES}
SELECT batch_id, n_items, n_valid, n_items - n_valid AS n_dropped FROM acct""")

ORACLES["first_n_samples"] = q(f"""
WITH {REPLY_CTES}
SELECT i.batch_id, i.pos::INTEGER AS pos, i.canon_md5
FROM items i JOIN merged m ON m.batch_id = i.batch_id AND m.used_attempt = i.attempt
WHERE i.valid ORDER BY i.batch_id, i.pos LIMIT 60""")

ORACLES["stall_runs"] = q(f"""
WITH {REPLY_CTES},
tb AS (SELECT 'topic-' || (batch_id % 4) AS topic, batch_id, n_valid = 0 AS empty FROM acct),
isl AS (SELECT topic, batch_id, empty,
          row_number() OVER (PARTITION BY topic ORDER BY batch_id) - row_number() OVER (PARTITION BY topic, empty ORDER BY batch_id) AS island
        FROM tb)
SELECT topic, min(batch_id) AS run_start, max(batch_id) AS run_end, count(*)::BIGINT AS run_len, count(*) >= 5 AS stalled
FROM isl WHERE empty GROUP BY topic, island""")


# ---------------------------------------------------------------------------
# Chunking (recursive over paragraph lengths), requests, judge
# ---------------------------------------------------------------------------

def fill_sql(template: str, **exprs: str) -> str:
    """SQL concatenation for a ``str.format`` template; literals quoted, fields as SQL."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field is not None:
            parts.append(f"CAST({exprs[field]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def chunk_ctes(docs_sql: str, c: int = 3000) -> str:
    """``docs_sql`` yields (doc_id, text); defines ``chunks(doc_id, chunk_idx, n_chunks, chunk)``."""
    sep = "chr(10) || chr(10)"
    return f"""
cd AS ({docs_sql}),
cp AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, {sep}), lambda x: {strip_sql('x')}), lambda x: x <> '') AS ps FROM cd),
prl AS (SELECT doc_id, i, p, length(p)::BIGINT AS l FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM cp)),
cr(doc_id, i, k, op, cur_no, clen, assign_no, big) AS (
  SELECT doc_id, 0, 0::BIGINT, false, -1::BIGINT, 0::BIGINT, -1::BIGINT, false FROM cp
  UNION ALL
  SELECT r.doc_id, r.i + 1,
    CASE WHEN x.l > {c} THEN r.k + ceil(x.l / {c})::BIGINT WHEN r.clen + x.l > {c} AND r.op THEN r.k + 1
         WHEN r.op THEN r.k ELSE r.k + 1 END,
    x.l <= {c},
    CASE WHEN x.l > {c} THEN -1 WHEN r.clen + x.l > {c} AND r.op THEN r.k WHEN r.op THEN r.cur_no ELSE r.k END,
    CASE WHEN x.l > {c} THEN 0 WHEN r.clen + x.l > {c} AND r.op THEN x.l WHEN r.op THEN r.clen + x.l ELSE x.l END,
    CASE WHEN x.l > {c} THEN r.k WHEN r.clen + x.l > {c} AND r.op THEN r.k WHEN r.op THEN r.cur_no ELSE r.k END,
    x.l > {c}
  FROM cr r JOIN prl x ON x.doc_id = r.doc_id AND x.i = r.i + 1),
asg AS (SELECT r.doc_id, r.i, r.assign_no, r.big, x.p, x.l FROM cr r JOIN prl x ON x.doc_id = r.doc_id AND x.i = r.i),
cparts AS (
  SELECT doc_id, assign_no AS chunk_no, string_agg(p, {sep} ORDER BY i) AS chunk FROM asg WHERE NOT big GROUP BY ALL
  UNION ALL
  SELECT doc_id, assign_no + j AS chunk_no, substr(p, (j * {c} + 1)::BIGINT, {c}) AS chunk
  FROM (SELECT doc_id, assign_no, p, unnest(range(0, ceil(l / {c})::BIGINT)) AS j FROM asg WHERE big)
  UNION ALL
  SELECT doc_id, 0, substr(text, 1, {c}) FROM cp WHERE len(ps) = 0),
chunks AS (SELECT doc_id, chunk_no::INTEGER AS chunk_idx, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS n_chunks, chunk FROM cparts)"""


DOCS_RAW = "SELECT doc_id, text FROM documents"
DOCS_PARAS = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"

ORACLES["chunk_text"] = q(f"""
WITH RECURSIVE {chunk_ctes(DOCS_RAW)}
SELECT doc_id, chunk_idx, n_chunks, length(chunk)::BIGINT AS chunk_len, md5(chunk) AS chunk_md5 FROM chunks""")

ORACLES["chunk_text_paragraphs"] = q(f"""
WITH RECURSIVE {chunk_ctes(DOCS_PARAS)}
SELECT doc_id, chunk_idx, n_chunks, length(chunk)::BIGINT AS chunk_len, md5(chunk) AS chunk_md5 FROM chunks""")


def _structure_requests_sql() -> str:
    from chatloom.operators.prompts import EXTRACT_USER

    per = "greatest(1, 50 // n_chunks)"
    return f"""
sreq AS (SELECT doc_id, chunk_idx, n_chunks, {per}::INTEGER AS per_chunk, greatest(2048, {per} * 300)::INTEGER AS max_tokens,
                {fill_sql(EXTRACT_USER, n=per, chunk='chunk')} AS prompt, chunk FROM chunks)"""


ORACLES["structure_requests"] = q(f"""
WITH RECURSIVE {chunk_ctes(DOCS_RAW)}, {_structure_requests_sql()}
SELECT doc_id, chunk_idx, per_chunk, max_tokens, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_len FROM sreq""")

ECHO_OK = "length(chunk) % 7 <> 2 AND length(chunk) % 5 <> 3"
ECHO_REPLY = ("""'[{"messages": [{"role": "user", "content": "What does this passage say?"}, {"role": "assistant", "content": ' """
              """|| to_json(chunk)::VARCHAR || '}]}]'""")

ORACLES["inference_hook"] = q(f"""
WITH RECURSIVE {chunk_ctes(DOCS_RAW)},
r AS (SELECT doc_id, chunk_idx, CASE WHEN length(chunk) % 7 = 2 THEN NULL WHEN length(chunk) % 5 = 3 THEN 'Sorry, no pairs for this passage.'
                                     ELSE {ECHO_REPLY} END AS reply FROM chunks)
SELECT doc_id, chunk_idx, coalesce(md5(reply), '') AS reply_md5, coalesce(length(reply), 0)::BIGINT AS reply_len,
       CASE WHEN reply IS NULL THEN 'RuntimeError: model not reached' ELSE '' END AS error FROM r""")

ORACLES["structure_collect"] = q(f"""
WITH RECURSIVE {chunk_ctes(DOCS_RAW)},
ok AS (SELECT doc_id, chunk_idx, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS rn
       FROM chunks WHERE {ECHO_OK})
SELECT doc_id, chunk_idx, 0 AS pos,
  md5('user' || chr(1) || 'What does this passage say?' || chr(0) || 'assistant' || chr(1) || chunk) AS canon_md5
FROM ok WHERE rn <= 50""")


def _generation_sql() -> str:
    from chatloom.operators.prompts import GENERATE_USER

    return f"""
tp AS (SELECT source || '/' || lang AS topic, count(*) AS n FROM documents GROUP BY ALL),
greq AS (SELECT topic, i::INTEGER AS call_idx, least(10, n - i * 10)::INTEGER AS batch_size
         FROM (SELECT topic, n, unnest(range(0, ceil(n / 10)::BIGINT)) AS i FROM tp)),
greqp AS (SELECT topic, call_idx, batch_size, {fill_sql(GENERATE_USER, batch_size='batch_size', topic='topic')} AS prompt FROM greq)"""


ORACLES["generation_requests"] = q(f"""
WITH {_generation_sql()}
SELECT topic, call_idx, batch_size, md5(prompt) AS prompt_md5 FROM greqp""")


def _judge_requests_sql() -> str:
    from chatloom.operators.prompts import JUDGE_GROUNDED, JUDGE_SELF

    return f"""
jreq AS (
  SELECT doc_id AS ord, 0 AS mode, {fill_sql(JUDGE_SELF, scale="'5'", q='source', a='text')} AS prompt FROM documents
  UNION ALL
  SELECT doc_id, 1, {fill_sql(JUDGE_GROUNDED, scale="'5'", source='substr(text, 1, 3000)', q='source', a='text')} FROM documents)"""


ORACLES["judge_requests"] = q(f"""
WITH {_judge_requests_sql()}
SELECT ord, mode, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_len FROM jreq""")

ORACLES["request_cost"] = q(f"""
WITH RECURSIVE {chunk_ctes(DOCS_RAW)}, {_structure_requests_sql()}, {_generation_sql()}, {_judge_requests_sql()},
allr AS (
  SELECT 'extraction' AS kind, length(prompt) AS chars FROM sreq
  UNION ALL SELECT 'generation', length(prompt) FROM greqp
  UNION ALL SELECT 'judge', length(prompt) FROM jreq WHERE mode = 0)
SELECT kind, count(*)::BIGINT AS n_calls, sum(chars)::BIGINT AS prompt_chars,
       round(sum(chars) / 3.8, 3) AS est_tokens, round(sum(chars) / 3.8 / 1000 * 0.0001, 9) AS est_cost
FROM allr GROUP BY kind""")

JUDGE_REPLIES = """
SELECT doc_id AS ord, quality, toxic,
  CASE doc_id % 5 WHEN 0 THEN 'No score given.'
    WHEN 1 THEN 'Score: ' || (1 + quality * 4 - toxic)
    WHEN 2 THEN (1 + quality * 4 - toxic) || '/5'
    WHEN 3 THEN 'I rate it -' || (1 + quality * 4 - toxic)
    ELSE 'score' || (1 + quality * 4 - toxic) || '0' END AS reply,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 4 THEN least(5.0, greatest(1.0, (1 + quality * 4 - toxic) * 10.0))
    ELSE least(5.0, greatest(1.0, (1 + quality * 4 - toxic) * 1.0)) END AS parsed
FROM labels"""

ORACLES["judge_scores"] = q(f"""
WITH jr AS ({JUDGE_REPLIES})
SELECT ord, coalesce(parsed, -1.0)::DOUBLE AS score FROM jr""")

ORACLES["quality_gate"] = q(f"""
WITH jr AS ({JUDGE_REPLIES}),
sc AS (SELECT d.doc_id AS ord, coalesce(jr.parsed, 3.0)::DOUBLE AS score FROM documents d LEFT JOIN jr ON jr.ord = d.doc_id)
SELECT ord, score FROM sc WHERE score >= 3.0""")

ORACLES["quality_drops"] = q(f"""
WITH jr AS ({JUDGE_REPLIES}),
sc AS (SELECT d.doc_id AS ord, coalesce(jr.parsed, 3.0)::DOUBLE AS score FROM documents d LEFT JOIN jr ON jr.ord = d.doc_id)
SELECT ord, score, 'Sample ' || ord || ': dropped, quality score ' || printf('%.1f', score) || '/5 < 3.0' AS message
FROM sc WHERE score < 3.0""")

EVAL_REPLIES = """
SELECT t.trial_id, l.doc_id AS ord,
  (2 + l.quality * 5 - l.toxic + t.trial_id) AS s, (l.doc_id + t.trial_id) % 5 AS k
FROM labels l CROSS JOIN (SELECT unnest([0, 1, 2]) AS trial_id) t"""

ORACLES["eval_scores"] = q(f"""
WITH er AS ({EVAL_REPLIES})
SELECT trial_id::INTEGER AS trial_id, ord,
  CASE WHEN k IN (0, 3) THEN -1.0 WHEN k = 4 THEN least(10.0, greatest(1.0, s + 0.5))
       ELSE least(10.0, greatest(1.0, s * 1.0)) END::DOUBLE AS score FROM er""")

def _eval_prompt() -> str:
    from chatloom.operators.judge import EVAL_PROMPT

    return fill_sql(EVAL_PROMPT, q="substr(source, 1, 300)", ref="substr(text, 1, 300)", gen="substr(generated, 1, 300)")


ORACLES["eval_judge_requests"] = q(f"""
WITH g AS (SELECT d.doc_id, d.source, d.text, t.trial_id,
             CASE WHEN (d.doc_id + t.trial_id) % 7 = 3 THEN '' ELSE 'trial ' || t.trial_id || ': ' || d.text END AS generated
           FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id CROSS JOIN (SELECT unnest([0, 1, 2]) AS trial_id) t WHERE d.source <> ''),
p AS (SELECT trial_id, doc_id, {_eval_prompt()} AS prompt FROM g)
SELECT trial_id::INTEGER AS trial_id, doc_id AS ord, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_len FROM p""")

ORACLES["judge_mean"] = q(f"""
WITH er AS ({EVAL_REPLIES}),
lastn AS (SELECT d.doc_id AS ord FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id WHERE d.source <> ''
          ORDER BY d.doc_id DESC LIMIT 20),
sc AS (SELECT trial_id, CASE WHEN k IN (0, 3) THEN NULL WHEN k = 4 THEN least(10.0, greatest(1.0, s + 0.5))
                               ELSE least(10.0, greatest(1.0, s * 1.0)) END AS score
       FROM er SEMI JOIN lastn ON lastn.ord = er.ord),
tr AS (SELECT DISTINCT trial_id FROM er)
SELECT tr.trial_id::INTEGER AS trial_id, coalesce(count(sc.score), 0)::BIGINT AS n_scored, coalesce(avg(sc.score), 5.0)::DOUBLE AS mean_score
FROM tr LEFT JOIN sc ON sc.trial_id = tr.trial_id GROUP BY tr.trial_id""")


# ---------------------------------------------------------------------------
# Trial log from events
# ---------------------------------------------------------------------------

TRIAL_CTES = """
tl0 AS (
  SELECT 'run-' || user_id AS run_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS trial_id,
         event_type, (props::JSON ->> 'k')::INTEGER AS k, value,
         CASE WHEN event_type = 'error' THEN 'inf'::DOUBLE ELSE value END AS bpb
  FROM events),
tl1 AS (
  SELECT *,
    CASE WHEN event_type = 'view' AND k % 10 = 0 THEN '{}'
         WHEN event_type = 'view' THEN '{"lora_rank": ' || k || '}'
         WHEN event_type = 'click' THEN '{"learning_rate": ' || printf('%.4f', k / 10000.0) || '}'
         WHEN event_type = 'purchase' THEN '{"scheduler": "linear", "lora_alpha": ' || (k * 11) || '}'
         WHEN event_type = 'signup' AND k % 3 = 0 THEN '{"lora_rank": true}'
         WHEN event_type = 'signup' AND k % 3 = 1 THEN '{"target_modules": []}'
         WHEN event_type = 'signup' THEN '{"scheduler": "step"}'
         ELSE '{"dropout": 0.' || k || '}' END AS recipe_diff,
    coalesce(min(bpb) OVER (PARTITION BY run_id ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS best_before
  FROM tl0),
tl AS (SELECT *, bpb < best_before AS kept FROM tl1),
bt AS (
  SELECT r.run_id, coalesce(b.trial_id, -1)::INTEGER AS best_trial_id, coalesce(b.bpb, 'inf'::DOUBLE) AS best_bpb,
         coalesce(b.recipe_diff, '{}') AS best_recipe_diff
  FROM (SELECT DISTINCT run_id FROM tl) r
  LEFT JOIN (SELECT run_id, arg_min(trial_id, (bpb, trial_id)) AS trial_id, min(bpb) AS bpb,
                    arg_min(recipe_diff, (bpb, trial_id)) AS recipe_diff
             FROM tl WHERE bpb < 'inf'::DOUBLE GROUP BY run_id) b ON b.run_id = r.run_id)"""

ORACLES["running_best"] = q(f"""
WITH {TRIAL_CTES}
SELECT run_id, trial_id, round(best_before, 6) AS best_before, kept FROM tl""")

ORACLES["best_trial"] = q(f"""
WITH {TRIAL_CTES}
SELECT run_id, best_trial_id, round(best_bpb, 6) AS best_bpb, best_recipe_diff FROM bt""")

ORACLES["top_k_trials"] = q(f"""
WITH {TRIAL_CTES},
rk AS (SELECT run_id, trial_id, bpb, row_number() OVER (PARTITION BY run_id ORDER BY bpb, trial_id) AS rank FROM tl WHERE kept)
SELECT run_id, rank::INTEGER AS rank, trial_id, round(bpb, 6) AS eval_bpb FROM rk WHERE rank <= 3""")

ORACLES["run_summary"] = q(f"""
WITH {TRIAL_CTES},
agg AS (SELECT run_id, count(*)::BIGINT AS trials_logged, count(*) FILTER (WHERE kept)::BIGINT AS kept_count,
               count(*) FILTER (WHERE bpb = 'inf'::DOUBLE)::BIGINT AS failed_count, (max(trial_id) + 1)::INTEGER AS next_trial
        FROM tl GROUP BY run_id)
SELECT a.run_id, a.trials_logged, a.kept_count, a.failed_count, a.next_trial, b.best_trial_id, round(b.best_bpb, 6) AS best_bpb,
       (a.next_trial - a.trials_logged)::BIGINT AS trial_gaps, round(a.failed_count / a.trials_logged, 6) AS failure_rate
FROM agg a JOIN bt b ON b.run_id = a.run_id""")

ORACLES["failed_trials"] = q(f"""
WITH {TRIAL_CTES}
SELECT run_id, trial_id FROM tl WHERE bpb = 'inf'::DOUBLE""")

ORACLES["recipe_diff_audit"] = q(f"""
WITH {TRIAL_CTES},
au AS (
  SELECT run_id, trial_id, event_type, k,
    CASE WHEN event_type = 'view' THEN NULL
         WHEN event_type = 'click' THEN CASE WHEN k = 0 THEN 'out_of_bounds' END
         WHEN event_type = 'purchase' THEN CASE WHEN k * 11 < 1 OR k * 11 > 1024 THEN 'out_of_bounds' END
         WHEN event_type = 'signup' THEN ['out_of_bounds', 'empty_target_modules', 'bad_scheduler'][k % 3 + 1]
         ELSE 'unknown_knob' END AS reason,
    CASE WHEN event_type = 'view' THEN NULL
         WHEN event_type = 'click' THEN CASE WHEN k = 0 THEN 'learning_rate' END
         WHEN event_type = 'purchase' THEN CASE WHEN k * 11 < 1 OR k * 11 > 1024 THEN 'lora_alpha' END
         WHEN event_type = 'signup' THEN ['lora_rank', 'target_modules', 'scheduler'][k % 3 + 1]
         ELSE 'dropout' END AS knob
  FROM tl)
SELECT run_id, trial_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status,
  coalesce(reason, '') AS reason, coalesce(knob, '') AS knob,
  CASE WHEN reason IS NOT NULL THEN -1 WHEN event_type = 'view' AND k % 10 <> 0 THEN k ELSE 16 END::BIGINT AS applied_lora_rank,
  CASE WHEN reason IS NOT NULL THEN -1.0 WHEN event_type = 'click' THEN round(k / 10000.0, 6) ELSE 0.0002 END::DOUBLE AS applied_learning_rate,
  CASE WHEN reason IS NOT NULL THEN '' WHEN event_type = 'purchase' THEN 'linear' ELSE 'cosine' END AS applied_scheduler,
  CASE WHEN reason IS NOT NULL THEN -1 WHEN event_type = 'purchase' THEN k * 11 ELSE 16 END::BIGINT AS applied_lora_alpha,
  CASE WHEN reason IS NOT NULL THEN '' ELSE 'q_proj,v_proj' END AS applied_target_modules,
  CASE WHEN reason IS NOT NULL THEN -1 ELSE 10 + 1 + 200 + 2 + 4 END::BIGINT AS applied_rest
FROM au""")

ORACLES["loop_checkpoints"] = q(f"""
WITH {TRIAL_CTES},
agg AS (SELECT run_id, count(*)::BIGINT AS n, max(trial_id)::INTEGER AS last FROM tl GROUP BY run_id)
SELECT a.run_id, a.last AS current_trial, b.best_trial_id, round(b.best_bpb, 6) AS best_bpb, coalesce(b.best_recipe_diff ->> '$.scheduler', '') AS best_scheduler,
       coalesce((b.best_recipe_diff ->> '$.lora_alpha')::INTEGER, -1) AS best_lora_alpha, a.n AS total_trials_run
FROM agg a JOIN bt b ON b.run_id = a.run_id
WHERE regexp_extract(a.run_id, '(\\d+)$', 1)::BIGINT % 11 <> 3 AND regexp_extract(a.run_id, '(\\d+)$', 1)::BIGINT % 7 <> 2""")

ORACLES["read_raw_text"] = q("""
SELECT doc_id, length(text || chr(10))::BIGINT AS n_chars, md5(text || chr(10)) AS text_md5 FROM documents""")

ORACLES["bits_per_byte"] = q("""
SELECT user_id AS trial_id, sum(event_id % 50)::BIGINT AS n_tokens,
  round(CASE WHEN sum(event_id % 50) > 0 THEN sum(value / 100 * (event_id % 50)) / sum(event_id % 50) / ln(2) / 3.8
        ELSE 'inf'::DOUBLE END, 6) AS bpb
FROM events GROUP BY user_id""")

ORACLES["trial_log_roundtrip"] = q(f"""
WITH {TRIAL_CTES}
SELECT run_id, trial_id, round(bpb, 6) AS eval_bpb, kept, k AS steps FROM tl""")

ORACLES["trial_log_read"] = q(f"""
WITH {TRIAL_CTES}
SELECT run_id, trial_id, round(bpb, 6) AS eval_bpb, kept, k AS steps FROM tl
WHERE trial_id % 17 <> 5 AND trial_id % 19 <> 7""")

ORACLES["run_states"] = q(f"""
WITH {TRIAL_CTES}
SELECT b.run_id, 'final' AS phase, b.best_trial_id::BIGINT AS best_trial_id, round(b.best_bpb, 6) AS best_bpb,
       (SELECT count(*) FROM tl WHERE tl.run_id = b.run_id)::BIGINT AS total_trials
FROM bt b""")


# ---------------------------------------------------------------------------
# Sources, golden parsing, record conversion
# ---------------------------------------------------------------------------

ORIG = f"""
orig AS (SELECT conv_id AS c, count(*)::BIGINT AS n, {canon_md5('role', 'text', 'turn')} AS canon_md5 FROM conversations GROUP BY conv_id)"""

ORACLES["parse_samples"] = q(f"""
WITH {ORIG}
SELECT c AS ord, (c % 9) NOT IN (3, 4, 5, 6) AS valid,
  CASE c % 9 WHEN 3 THEN 'bad_message' WHEN 4 THEN 'bad_message' WHEN 5 THEN 'messages_not_list' WHEN 6 THEN 'messages_empty' ELSE '' END AS reason,
  CASE WHEN c % 9 IN (0, 7, 8) THEN 'conv-' || c ELSE '' END AS id,
  CASE WHEN c % 9 IN (3, 4, 5, 6) THEN 0 WHEN c % 9 = 8 THEN 0 ELSE n END::BIGINT AS n_messages,
  CASE WHEN c % 9 IN (3, 4, 5, 6) THEN '' WHEN c % 9 = 8 THEN md5('') ELSE canon_md5 END AS canon_md5
FROM orig""")

ORACLES["parse_reject_reasons"] = q("""
SELECT CASE conv_id % 9 WHEN 5 THEN 'messages_not_list' WHEN 6 THEN 'messages_empty' ELSE 'bad_message' END AS reason,
       count(*)::BIGINT AS n
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 9 IN (3, 4, 5, 6) GROUP BY 1""")

ORACLES["read_jsonl"] = q(f"""
WITH {ORIG},
flat AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = 2 AND arg_min(role, turn) = 'user' AND arg_max(role, turn) = 'assistant' AND conv_id % 3 <> 0)
SELECT CASE WHEN c % 4 = 2 OR c IN (SELECT conv_id FROM flat) THEN '' ELSE 'conv-' || c END AS id, n AS n_messages, canon_md5 FROM orig""")

ORACLES["read_json_array"] = ORACLES["read_jsonl"]

ORACLES["write_jsonl_roundtrip"] = q(f"""
WITH {REPAIR_CTES},
kept AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS pos FROM reason WHERE code IS NULL),
lines AS (
  SELECT printf('sample_%04d', kp.pos) AS id, count(*)::BIGINT AS n_messages, {canon_md5('k.role', 'k.content', 'k.pos')} AS canon_md5,
    md5('{{"id": "' || printf('sample_%04d', kp.pos) || '", "messages": ['
        || string_agg('{{"role": "' || k.role || '", "content": "' || replace(k.content, chr(10), '\\n') || '"}}', ', ' ORDER BY k.pos)
        || ']}}') AS line_md5
  FROM k JOIN kept kp ON kp.ord = k.ord GROUP BY kp.pos)
SELECT id, n_messages, canon_md5, line_md5 FROM lines""")

RECORDS_EXPECTED = """
rec AS (
  SELECT doc_id AS ord, doc_id % 7 AS k, source, text, lang,
    CASE doc_id % 7 WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' WHEN 2 THEN 'instruction'
      WHEN 3 THEN 'prompt_response' WHEN 4 THEN 'prompt_completion' WHEN 5 THEN 'question_answer' ELSE 'unrecognized' END AS source_format
  FROM documents),
recm AS (
  SELECT ord, source_format,
    CASE WHEN k = 6 THEN 0 WHEN k = 1 AND ord % 5 = 0 THEN 3 ELSE 2 END::BIGINT AS n_messages,
    CASE WHEN k = 6 THEN ''
      WHEN k = 2 THEN md5('user' || chr(1) || source || CASE WHEN ord % 2 = 0 THEN chr(10) || chr(10) || lang ELSE '' END
                          || chr(0) || 'assistant' || chr(1) || text)
      WHEN k = 1 AND ord % 5 = 0 THEN md5('user' || chr(1) || source || chr(0) || 'assistant' || chr(1) || text
                                          || chr(0) || 'narrator' || chr(1) || lang)
      ELSE md5('user' || chr(1) || source || chr(0) || 'assistant' || chr(1) || text) END AS canon_md5
  FROM rec)"""

ORACLES["convert_records"] = q(f"""
WITH {RECORDS_EXPECTED}
SELECT ord, source_format, n_messages, canon_md5 FROM recm""")

ORACLES["convert_census"] = q(f"""
WITH {RECORDS_EXPECTED}
SELECT source_format, count(*)::BIGINT AS n FROM recm GROUP BY 1""")

ORACLES["sharegpt_to_messages"] = q(f"""
WITH {RECORDS_EXPECTED}
SELECT ord, n_messages, canon_md5 FROM recm WHERE source_format = 'conversations'""")

ORACLES["format_census"] = q("""
SELECT count(*)::BIGINT AS n_records, count(*) FILTER (WHERE doc_id % 7 = 1)::BIGINT AS n_conversations_only,
  count(*) > 0 AND count(*) FILTER (WHERE doc_id % 7 = 1) = count(*) AS all_conversations,
  count(*) FILTER (WHERE doc_id % 7 = 1) > 0 AND count(*) FILTER (WHERE doc_id % 7 = 1) < count(*) AS mixed
FROM documents""")

SOURCES = """
src AS (
  SELECT url AS source FROM pages
  UNION SELECT source || '/' || lang FROM documents
  UNION SELECT source || '/' || lang || '/validation' FROM documents
  UNION SELECT source || '.jsonl' FROM documents)"""

ORACLES["classify_source"] = q(f"""
WITH {SOURCES}
SELECT source, CASE WHEN starts_with(source, 'http://') OR starts_with(source, 'https://') THEN 'url'
                    WHEN regexp_matches(source, '^[A-Za-z0-9_\\-.]+/[A-Za-z0-9_\\-.]+$') THEN 'hf' ELSE 'local' END AS source_type
FROM src""")

ORACLES["source_cache_name"] = q(f"""
WITH {SOURCES},
p AS (SELECT source, string_split(source, '/') AS parts FROM src)
SELECT source,
  coalesce(nullif(list_last(string_split(regexp_replace(split_part(source, '?', 1), '/+$', ''), '/')), ''), 'dataset.jsonl') AS cache_name,
  CASE WHEN len(parts) = 3 THEN parts[1] || '/' || parts[2] ELSE source END AS repo_id,
  CASE WHEN len(parts) = 3 THEN parts[3] ELSE 'train' END AS split,
  replace(source, '/', '__') || '_' || CASE WHEN len(parts) = 3 THEN parts[3] ELSE 'train' END || '.jsonl' AS staged_name
FROM p""")

ORACLES["warning_summary"] = q(f"""
WITH {REPAIR_CTES},
w AS (
  SELECT 'empty_content' AS code FROM ann WHERE stripped = ''
  UNION ALL SELECT 'stripped_whitespace' FROM ann WHERE stripped <> '' AND stripped <> raw
  UNION ALL SELECT 'unknown_role' FROM ann WHERE stripped <> '' AND norm NOT IN ('system', 'user', 'assistant')
  UNION ALL SELECT 'normalized_role' FROM ann WHERE stripped <> '' AND norm IN ('system', 'user', 'assistant') AND norm <> raw_role
  UNION ALL SELECT code FROM reason WHERE code IS NOT NULL)
SELECT code, count(*)::BIGINT AS n FROM w GROUP BY code""")

ORACLES["stage_funnel"] = q(f"""
WITH RECURSIVE {token_ctes(DOC_CANON)}, {jaccard_pairs_cte()}, {greedy_ctes()},
jr AS ({JUDGE_REPLIES}),
gated AS (SELECT g.ord FROM gkept g LEFT JOIN jr ON jr.ord = g.ord WHERE coalesce(jr.parsed, 3.0) >= 3.0),
st AS (
  SELECT 0 AS stage_no, 'acquired' AS stage, (SELECT count(*) FROM documents) AS n
  UNION ALL SELECT 1, 'length_filter', (SELECT count(*) FROM documents WHERE length(text) >= 50)
  UNION ALL SELECT 2, 'dedup', (SELECT count(*) FROM gkept)
  UNION ALL SELECT 3, 'quality_gate', (SELECT count(*) FROM gated)
  UNION ALL SELECT 4, 'validated', (SELECT count(*) FROM gated g JOIN documents d ON d.doc_id = g.ord
                                    WHERE {strip_sql('d.text')} <> '' AND {strip_sql('d.source')} <> ''))
SELECT stage_no::INTEGER AS stage_no, stage, n::BIGINT AS n FROM st""")

ORACLES["mode_bring_your_own"] = q(f"""
WITH {RECORDS_EXPECTED},
kept AS (
  SELECT ord, 2::BIGINT AS n_messages,
    CASE WHEN k = 2 THEN md5('user' || chr(1) || source || CASE WHEN ord % 2 = 0 THEN chr(10) || chr(10) || lang ELSE '' END
                             || chr(0) || 'assistant' || chr(1) || text)
         ELSE md5('user' || chr(1) || source || chr(0) || 'assistant' || chr(1) || text) END AS canon_md5
  FROM rec WHERE source_format <> 'unrecognized')
SELECT ord, printf('sample_%04d', row_number() OVER (ORDER BY ord) - 1) AS id, n_messages, canon_md5 FROM kept""")

ORACLES["stream_trial_tail"] = q(f"""
WITH {TRIAL_CTES}
SELECT run_id, round(min(bpb), 6) AS best_bpb, coalesce(arg_min(trial_id, (bpb, trial_id)) FILTER (WHERE bpb < 'inf'::DOUBLE), -1)::INTEGER AS best_trial_id,
       count(*)::BIGINT AS trials_logged, max(trial_id)::INTEGER AS last_trial
FROM tl WHERE trial_id % 17 <> 5 AND trial_id % 19 <> 7 GROUP BY run_id""")

#: Messages of the samples of all used batches.
IMSG = """imsg AS (
  SELECT t.c AS batch_id, 0 AS pos, t.turn AS mpos, t.role,
         CASE WHEN t.c % 8 = 7 THEN '\\p' || t.text ELSE t.text END AS content
  FROM rt t WHERE t.c IN (SELECT batch_id FROM used) AND t.c % 8 <> 4
  UNION ALL
  SELECT w.c, w.pos, 0, f.role, f.text FROM wrapped w JOIN fl f ON f.c = w.c AND f.turn = w.start
  WHERE w.c IN (SELECT batch_id FROM used)
  UNION ALL
  SELECT w.c, w.pos, 1, f.nxt, f.ntext FROM wrapped w JOIN fl f ON f.c = w.c AND f.turn = w.start
  WHERE w.c IN (SELECT batch_id FROM used) AND w.n_messages = 2)"""

ORACLES["stream_reply_ingest"] = q(f"""
WITH {REPLY_CTES},
used AS (SELECT batch_id FROM att WHERE kind = 'damaged'),
{IMSG},
am AS (SELECT batch_id * 1000 + pos AS ord, mpos, role, content FROM imsg),
{repair_ctes("SELECT ord, mpos AS turn, role, content FROM am")},
fin AS (SELECT k.ord, count(*)::BIGINT AS n_messages, {canon_md5('k.role', 'k.content', 'k.pos')} AS canon_md5
        FROM k JOIN reason r ON r.ord = k.ord WHERE r.code IS NULL GROUP BY k.ord)
SELECT DISTINCT n_messages, canon_md5 FROM fin""")

def _judge_ok(prompt: str) -> str:
    """The stand-in judge's gate: 1 + length mod 5 reaches 3."""
    return f"1 + length({prompt}) % 5 >= 3"


def _mode_prompts() -> tuple[str, str]:
    from chatloom.operators.prompts import JUDGE_GROUNDED, JUDGE_SELF

    asked = "'What does this passage say?'"
    return (fill_sql(JUDGE_GROUNDED, scale="'5'", source="a.ans", q=asked, a="a.ans"), fill_sql(JUDGE_SELF, scale="'5'", q="q", a="a"))


GROUNDED_PROMPT, SELF_PROMPT = _mode_prompts()

ORACLES["mode_structure"] = q(f"""
WITH RECURSIVE {chunk_ctes(DOCS_RAW)},
okc AS (SELECT doc_id, chunk_idx, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS rn
        FROM chunks WHERE {ECHO_OK}),
acq AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS ord, chunk AS ans FROM okc WHERE rn <= 50),
{token_ctes("SELECT ord, 'user' || chr(1) || 'What does this passage say?' || chr(0) || 'assistant' || chr(1) || ans AS text FROM acq WHERE length(ans) >= 50")},
{jaccard_pairs_cte()}, {greedy_ctes()},
fin AS (SELECT a.ord, {strip_sql('a.ans')} AS ans FROM acq a SEMI JOIN gkept g ON g.ord = a.ord
        WHERE {_judge_ok(GROUNDED_PROMPT)})
SELECT ord, printf('sample_%04d', row_number() OVER (ORDER BY ord) - 1) AS id, 2::BIGINT AS n_messages,
       md5('user' || chr(1) || 'What does this passage say?' || chr(0) || 'assistant' || chr(1) || ans) AS canon_md5
FROM fin""")

ORACLES["mode_bring_your_own_files"] = q(f"""
WITH fin AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, {strip_sql('text')} AS text, {strip_sql('source')} AS source FROM documents),
kept AS (SELECT p AS ord, source, text FROM fin WHERE text <> '' AND source <> '')
SELECT ord, printf('sample_%04d', row_number() OVER (ORDER BY ord) - 1) AS id, 2::BIGINT AS n_messages,
       md5('user' || chr(1) || source || chr(0) || 'assistant' || chr(1) || text) AS canon_md5 FROM kept""")

ORACLES["mode_generate"] = q(f"""
WITH RECURSIVE {REPLY_CTES},
used AS (SELECT a.batch_id FROM att a JOIN merged m ON m.batch_id = a.batch_id AND m.used_attempt = a.attempt
         WHERE a.kind = 'damaged'),
{IMSG},
acq AS (SELECT batch_id, pos, row_number() OVER (ORDER BY batch_id, pos) - 1 AS ord FROM (SELECT DISTINCT batch_id, pos FROM imsg)),
am AS (SELECT a.ord, i.mpos, i.role, i.content FROM acq a JOIN imsg i ON i.batch_id = a.batch_id AND i.pos = a.pos),
lenok AS (SELECT ord FROM am GROUP BY ord HAVING coalesce(sum(length(content)) FILTER (WHERE role = 'assistant'), 0) >= 50),
{token_ctes("SELECT ord, string_agg(role || chr(1) || content, chr(0) ORDER BY mpos) AS text FROM am WHERE ord IN (SELECT ord FROM lenok) GROUP BY ord")},
{jaccard_pairs_cte()}, {greedy_ctes()},
qa AS (SELECT ord, coalesce(arg_min(content, mpos) FILTER (WHERE role = 'user'), '') AS q,
              coalesce(arg_min(content, mpos) FILTER (WHERE role = 'assistant'), '') AS a FROM am GROUP BY ord),
judged AS (SELECT g.ord FROM gkept g JOIN qa ON qa.ord = g.ord WHERE {_judge_ok(SELF_PROMPT)}),
{repair_ctes("SELECT ord, mpos AS turn, role, content FROM am WHERE ord IN (SELECT ord FROM judged)")},
keptids AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS p FROM reason WHERE code IS NULL)
SELECT k.ord, printf('sample_%04d', any_value(ki.p)) AS id, count(*)::BIGINT AS n_messages,
       {canon_md5('k.role', 'k.content', 'k.pos')} AS canon_md5
FROM k JOIN keptids ki ON ki.ord = k.ord GROUP BY k.ord""")
