"""The same queries as DuckDB SQL, stated from the table columns and not from log text."""

from __future__ import annotations

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")

# what parsing each rendered line must give
ENTRIES = """
WITH ev AS (
  SELECT event_id AS e, user_id AS u, event_type AS kind, date_trunc('second', ts) AS sec,
         event_id % 4 AS shape, event_id % 11 = 3 AS no_level, event_id % 13 = 5 AS no_time,
         event_id % 8 = 1 AS has_pri, 'web-' || (user_id % 7) AS host
  FROM events),
base AS (
  SELECT *, CASE WHEN kind = 'error' AND u % 5 = 0 THEN 'FATAL' WHEN kind = 'error' THEN 'ERROR'
                 WHEN kind = 'signup' THEN 'WARN' WHEN kind = 'view' THEN 'DEBUG' ELSE 'INFO' END AS lvl,
         'user ' || u || ' ' ||
         CASE kind WHEN 'signup' THEN 'registered account' WHEN 'purchase' THEN 'bought item'
                   WHEN 'view' THEN 'viewed page' WHEN 'click' THEN 'clicked banner' ELSE 'failed on node' END
         || ' ' || (e % 97) || ' from 10.0.' || (u % 256) || '.' || (e % 256)
         || ' session s' || (u % 40) || ' took ' || (e % 500) || ' ms' AS msg,
         CASE WHEN no_level THEN '101' WHEN kind = 'signup' THEN '404' WHEN kind = 'purchase' THEN '201'
              WHEN kind = 'view' THEN '200' WHEN kind = 'click' THEN '302' ELSE '500' END AS status
  FROM ev),
entries AS (
  SELECT e, u, shape, no_level, no_time, has_pri, status, host,
    'f' || (e % 3) || '.log' AS file, e + 1 AS line, (e % 3) * 1099511627776 + e + 1 AS seq,
    CASE shape
      WHEN 0 THEN '{' || CASE WHEN no_time THEN '' ELSE '"time":"' || strftime(sec, '%Y-%m-%dT%H:%M:%SZ') || '",' END
        || CASE WHEN no_level THEN '' ELSE '"level":"' || lower(lvl) || '",' END
        || '"msg":"' || msg || '",' || CASE WHEN e % 3 = 0 THEN '"source":"' || host || '",' ELSE '' END
        || '"user_id":' || u || '}'
      WHEN 1 THEN CASE WHEN has_pri THEN CASE lvl WHEN 'DEBUG' THEN '<15>' WHEN 'INFO' THEN '<14>'
          WHEN 'WARN' THEN '<12>' WHEN 'ERROR' THEN '<11>' ELSE '<10>' END ELSE '' END
        || strftime(sec, '%b ') || lpad(CAST(day(sec) AS VARCHAR), 2, ' ') || strftime(sec, ' %H:%M:%S ')
        || host || ' app[' || u || ']: '
        || CASE WHEN has_pri OR no_level THEN '' ELSE lvl || ': ' END || msg
      WHEN 2 THEN '10.1.0.' || (u % 256) || ' - ' || CASE WHEN u % 2 = 0 THEN 'u' || u ELSE '-' END
        || strftime(sec, ' [%d/%b/%Y:%H:%M:%S +0000] ') || '"GET /item/' || (e % 97) || ' HTTP/1.1" '
        || status || ' ' || (e % 5000) || ' "-" "agent/' || (u % 3) || '"'
      ELSE CASE WHEN no_time THEN '' ELSE strftime(sec, '%Y-%m-%d %H:%M:%S ') END
        || CASE WHEN no_level THEN '' ELSE lvl || ' ' END || msg END AS raw,
    CASE shape WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'apache' ELSE 'generic' END AS format,
    CASE WHEN shape IN (0, 3) AND no_time THEN NULL ELSE sec END AS ts,
    CASE WHEN shape = 2 THEN CASE status[1] WHEN '2' THEN 'INFO' WHEN '3' THEN 'INFO' WHEN '4' THEN 'WARN'
                                            WHEN '5' THEN 'ERROR' ELSE 'UNKNOWN' END
         WHEN no_level AND NOT has_pri THEN 'UNKNOWN' WHEN no_level AND shape <> 1 THEN 'UNKNOWN'
         ELSE lvl END AS level,
    CASE WHEN shape = 2 THEN 'GET /item/' || (e % 97) || ' HTTP/1.1 -> ' || status
         WHEN shape = 1 AND NOT has_pri AND NOT no_level THEN lvl || ': ' || msg ELSE msg END AS message,
    CASE shape WHEN 0 THEN CASE WHEN e % 3 = 0 THEN host ELSE '' END WHEN 1 THEN host
               WHEN 2 THEN '10.1.0.' || (u % 256) ELSE '' END AS source
  FROM base)
"""
LINE = "file, line, level, message"
ORDINAL = "array_position(['DEBUG','INFO','WARN','ERROR','FATAL','UNKNOWN'], level) - 1"
LEVEL_MAP = " || ".join(
    f"CASE WHEN count(*) FILTER (level = '{x}') > 0 THEN ',{x}=' || count(*) FILTER (level = '{x}') ELSE '' END"
    for x in sorted(LEVELS)
)

# token classes, one anchored pattern each
VARIABLE = (
    r"(regexp_full_match(t, '-?\d+(\.\d+)?') OR regexp_full_match(t, '0[xX][0-9a-fA-F]+')"
    r" OR regexp_full_match(t, '\d{1,3}(\.\d{1,3}){3}')"
    r" OR regexp_full_match(t, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')"
    r" OR regexp_matches(t, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}')"
    r" OR (starts_with(t, '/') AND strlen(t) > 20))"
)


def tokens(column: str) -> str:
    return rf"regexp_extract_all({column}, '[^\t\n\f\r ]+')"


def masked(column: str, mark: str = "<*>") -> str:
    return f"array_to_string(list_transform({tokens(column)}, lambda t: CASE WHEN {VARIABLE} THEN '{mark}' ELSE t END), ' ')"


def kept(condition: str) -> str:
    return f"{ENTRIES} SELECT {LINE} FROM entries WHERE {condition}"


# windows are aligned to the year 1; 1970-01-01 minus 719162 days
def window_sql(seconds: int) -> str:
    offset = (-719162 * 86400) % seconds
    return f"""{ENTRIES},
w AS (SELECT CAST(floor((epoch(ts) - {offset}) / {seconds}) AS BIGINT) AS i, level FROM entries WHERE ts IS NOT NULL),
c AS (SELECT i, count(*) AS n, count(*) FILTER (level IN ('ERROR','FATAL','UNKNOWN')) AS errs,
             ltrim({LEVEL_MAP}, ',') AS lc FROM w GROUP BY i),
g AS (SELECT unnest(range((SELECT min(i) FROM c), (SELECT max(i) + 1 FROM c))) AS i),
f AS (SELECT g.i, coalesce(n, 0) AS n, coalesce(errs, 0) AS errs, coalesce(lc, '') AS lc,
             lag(coalesce(n, 0)) OVER (ORDER BY g.i) AS p FROM g LEFT JOIN c ON g.i = c.i)
SELECT make_timestamp((i * {seconds} + {offset}) * 1000000) AS start,
       make_timestamp(((i + 1) * {seconds} + {offset}) * 1000000) AS "end",
       n AS count, lc AS level_counts, errs AS error_count,
       round(CASE WHEN n > 0 THEN errs * 100.0 / n ELSE 0 END, 6)::DOUBLE AS error_percent,
       round(CASE WHEN p > 0 THEN (n - p) * 100.0 / p ELSE 0 END, 6)::DOUBLE AS change_percent
FROM f"""


def group_sql(key: str, n: int) -> str:
    return f"""{ENTRIES} SELECT {key} AS key, count(*) AS count,
round(count(*) * 100.0 / (SELECT count(*) FROM entries), 6)::DOUBLE AS percent
FROM entries GROUP BY 1 ORDER BY count DESC, key LIMIT {n}"""


# -- redaction, in the RE2 dialect

# The patterns, as RE2 writes them.
REGEX = {
    "ipv4": ("IPV4", r"\b(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    "ipv6": (
        "IPV6",
        r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,7}:"
        r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
        r"|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}"
        r"|:(?::[0-9a-fA-F]{1,4}){1,7}"
        r"|::(?:[fF]{4}(?::0{1,4}){0,1}:){0,1}(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
        r"|(?:[0-9a-fA-F]{1,4}:){1,4}:(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
    ),
    "email": ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    "api_key": (
        "SECRET",
        r'(?i)(?:api[_-]?key|apikey|token|secret|password|passwd|pwd)["\s]*[:=]["\s]*[a-zA-Z0-9_\-]{8,}',
    ),
    "aws_key": ("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    "jwt": ("JWT", r"\beyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\b"),
    "private_key": ("PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    "mac_address": ("MAC", r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b"),
    "credit_card": ("CC", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    "uuid": ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
}


def redaction_steps(source: str, key: str, column: str, names) -> str:
    """CTEs s0..sN: the text after each pattern, the running count and the values found."""
    out = [
        f"s0 AS (SELECT {key}, {column} AS t, 0::BIGINT AS n,"
        " CAST([] AS STRUCT(o INT, kind VARCHAR, v VARCHAR)[]) AS found"
        f" FROM {source})"
    ]
    for i, name in enumerate(names):
        kind, regex = REGEX[name]
        out.append(
            f"m{i} AS (SELECT *, regexp_extract_all(t, '{regex}') AS m,"
            f" string_split_regex(t, '{regex}') AS p FROM s{i})"
        )
        out.append(
            f"s{i + 1} AS (SELECT {key}, CASE WHEN len(m) = 0 THEN t ELSE array_to_string("
            "list_transform(p, lambda x, j: x || CASE WHEN j <= len(m) THEN"
            f" '[{kind}:' || sha256(m[j])[1:4] || ']' ELSE '' END), '') END AS t,"
            f" n + len(m) AS n, list_concat(found, list_transform(m,"
            f" lambda v: {{'o': {i}, 'kind': '{kind}', 'v': v}})) AS found FROM m{i})"
        )
    return ", ".join(out)


DEFAULTS = ("ipv4", "ipv6", "email", "api_key", "aws_key", "jwt", "private_key")
REDACTED = DEFAULTS + ("credit_card",)
DOC_STEPS = redaction_steps("documents", "doc_id", "text", REDACTED)
VALUES = f"""WITH {DOC_STEPS},
f AS (SELECT unnest(found) AS x FROM s{len(REDACTED)}),
v AS (SELECT x.v AS value, arg_min(x.kind, x.o) AS type FROM f GROUP BY 1)"""


ALL_PATTERNS = (*REGEX,)
PLANTED = """'from 10.' || (c_custkey % 250) || '.0.7 and 2001:db8::' || (c_custkey % 99 + 1) || ' by u' || c_custkey || '@example.org token=abcdefgh'
|| c_custkey || ' AKIA' || lpad(c_custkey::VARCHAR, 16, '0') || ' eyJ' || c_custkey || '.eyJ' || c_custkey || '.sig -----BEGIN EC PRIVATE KEY----- 00:1b:44:11:3a:'
|| lpad((c_custkey % 90 + 10)::VARCHAR, 2, '0') || ' 4000-1234-5678-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' 123e4567-e89b-12d3-a456-' || lpad(c_custkey::VARCHAR, 12, '0')"""


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Mining line by line: in every leaf, one step for each message, with the leaf's templates as state.
# '#' is a variable token; a token of a message is never '<*>' here.
def mining(
    suffix: str = "", keep: str = "true", source: str = "entries", by: str = "", threshold: float = 0.5, routed: str | None = None
) -> str:
    own = f"{by} || '|' || " if by else ""
    routed = routed or f"""
routed{suffix} AS (
  SELECT *, {own}len(words) || ' ' || array_to_string(list_transform(words[1:3], lambda x: CASE WHEN x = '#' THEN '<*>' ELSE x END), ' ') AS leaf
  FROM w{suffix}),"""
    return f"""
w{suffix} AS (SELECT *, string_split({masked("message", "#")}, ' ') AS words FROM {source} WHERE message <> '' AND {keep}),{routed}
rows_{suffix} AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY seq) AS r FROM routed{suffix}),
step{suffix} AS (
  SELECT DISTINCT leaf, 0::BIGINT AS r, NULL::BIGINT AS seq, NULL::BIGINT AS hit, CAST([] AS VARCHAR[][]) AS tpl FROM rows_{suffix}
  UNION ALL
  SELECT leaf, r, seq, coalesce(hit, len(tpl) + 1),
         CASE WHEN hit IS NULL THEN list_append(tpl, list_transform(words, lambda x: CASE WHEN x = '#' THEN '<*>' ELSE x END))
              ELSE list_transform(tpl, lambda t, i: CASE WHEN i = hit
                     THEN list_transform(t, lambda x, j: CASE WHEN x = words[j] THEN x ELSE '<*>' END) ELSE t END) END
  FROM (
    SELECT s.leaf, n.r, n.seq, n.words, s.tpl,
           list_position(list_transform(s.tpl, lambda t:
             len(list_filter(t, lambda x, j: x = '<*>' OR x = n.words[j])) >= {threshold} * len(t)), true) AS hit
    FROM step{suffix} s JOIN rows_{suffix} n ON s.leaf = n.leaf AND n.r = s.r + 1)),
final{suffix} AS (
  SELECT leaf, unnest(tpl) AS tokens, generate_subscripts(tpl, 1) AS hit
  FROM (SELECT leaf, arg_max(tpl, r) AS tpl FROM step{suffix} GROUP BY leaf)),
hits{suffix} AS (SELECT s.leaf, s.hit, s.seq, n.message FROM step{suffix} s JOIN rows_{suffix} n ON s.leaf = n.leaf AND s.r = n.r),
counted{suffix} AS (SELECT leaf, hit, count(*) AS count, min(seq) AS first FROM hits{suffix} GROUP BY leaf, hit),
mined{suffix} AS (
  SELECT c.*, tokens, 'T_' || row_number() OVER (ORDER BY first) AS template_id, array_to_string(tokens, ' ') AS pattern
  FROM counted{suffix} c JOIN final{suffix} f ON c.leaf = f.leaf AND c.hit = f.hit)"""


RECURSIVE = ENTRIES.replace("WITH ev", "WITH RECURSIVE ev", 1)
MINED = f"{RECURSIVE},{mining()}"

# templates of two halves, and the pairs that agree wherever both have a token
ALIGNED = f"""{RECURSIVE.replace("SELECT event_id AS e,", "SELECT ts AS moment, event_id AS e,", 1).replace("SELECT e, u, shape,", "SELECT moment, e, u, shape,", 1)},
{mining("_b", "moment < TIMESTAMP '2024-01-16'")},
{mining("_a", "moment >= TIMESTAMP '2024-01-16'")},
b AS (SELECT pattern, tokens, count, count / (SELECT sum(count) FROM mined_b)::DOUBLE AS share FROM mined_b),
a AS (SELECT pattern, tokens, count, count / (SELECT sum(count) FROM mined_a)::DOUBLE AS share FROM mined_a),
pairs AS (
  SELECT b.pattern AS bp, a.pattern AS ap, b.count AS bc, a.count AS ac, b.share AS bs, a.share AS s,
         len(list_filter(b.tokens, lambda x, i: x <> '<*>' AND a.tokens[i] <> '<*>')) AS agreed
  FROM b JOIN a ON len(b.tokens) = len(a.tokens)
  WHERE len(list_filter(b.tokens, lambda x, i: x <> '<*>' AND a.tokens[i] <> '<*>' AND x <> a.tokens[i])) = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bp ORDER BY bp = ap DESC, agreed DESC, ac DESC, ap) AS of_b,
         row_number() OVER (PARTITION BY ap ORDER BY bp = ap DESC, agreed DESC, bc DESC, bp) AS of_a
  FROM pairs WHERE agreed > 0 OR bp = ap),
aligned AS (SELECT * FROM ranked WHERE of_b = 1 OR of_a = 1)"""


# routing where a full node sends further tokens to its wildcard child
def crowded_sql(depth: int, most: int) -> str:
    out = "\nleaf0 AS (SELECT *, len(words)::VARCHAR AS leaf FROM w),"
    for k in range(1, depth):
        token = f"CASE WHEN words[{k}] = '#' THEN '<*>' ELSE words[{k}] END"
        out += f"""
child{k} AS (SELECT *, {token} AS child FROM leaf{k - 1}),
seen{k} AS (
  SELECT leaf, child, row_number() OVER (PARTITION BY leaf ORDER BY min(seq)) AS nth FROM child{k} WHERE child IS NOT NULL GROUP BY leaf, child),
leaf{k} AS (
  SELECT c.* EXCLUDE (child) REPLACE (c.leaf || CASE WHEN c.child IS NULL THEN '' WHEN nth <= {most} THEN ' ' || c.child ELSE ' <*>' END AS leaf)
  FROM child{k} c LEFT JOIN seen{k} s ON s.leaf = c.leaf AND s.child = c.child),"""
    return out + f"\nrouted AS (SELECT * FROM leaf{depth - 1}),"


# compression of the redacted lines, a document for each value of ``by``: mining, then each message key's most
# frequent template for levels and times, then the three sections one after the other, while the budget lasts
def compress_sql(by: str, limit: int) -> str:
    titles = ("=== Error Summary ===", "=== Warning Summary ===", "=== Top Info Patterns ===")
    sections = []
    for k, title in enumerate(titles):
        last = "body0" if k == 0 else f"body{k}"
        opened = "n IS NOT NULL" if k == 0 else f"n IS NOT NULL AND used < {limit - 200}"
        sections.append(f"""
taken{k} AS (
  SELECT d.grp, count(*) AS n, count(*) FILTER (d.used + s.cum <= {limit - 200}) AS took,
         coalesce(max(s.cum) FILTER (d.used + s.cum <= {limit - 200}), 0) AS cost,
         coalesce(string_agg(s.text, '' ORDER BY s.nth) FILTER (d.used + s.cum <= {limit - 200}), '') AS texts,
         list(s.level) FILTER (d.used + s.cum <= {limit - 200}) AS levels
  FROM {last} d JOIN ranked s ON s.grp = d.grp AND s.section = {k} GROUP BY d.grp),
body{k + 1} AS (
  SELECT d.* REPLACE (
    CASE WHEN {opened} THEN body || '{title}' || chr(10) || texts || chr(10) ELSE body END AS body,
    CASE WHEN {opened} THEN used + cost ELSE used END AS used,
    CASE WHEN {opened} THEN included + took ELSE included END AS included,
    CASE WHEN {opened} THEN list_concat(d.shown, coalesce(t.levels, [])) ELSE d.shown END AS shown)
  FROM {last} d LEFT JOIN taken{k} t USING (grp))""")
    footer = f"'Token Count: ~' || ((size + strlen((size // 4)::VARCHAR)) // 4) || ' / {limit}' || chr(10)"
    return f"""{RECURSIVE},
redacted AS (
  SELECT * REPLACE (replace(message, '10.0.' || (u % 256) || '.' || (e % 256),
                    '[IPV4:' || sha256('10.0.' || (u % 256) || '.' || (e % 256))[1:4] || ']') AS message),
         {by} AS grp, CASE WHEN shape = 2 THEN 1 WHEN raw = message THEN 1 ELSE 2 END AS hidden,
         CASE WHEN level <> 'UNKNOWN' THEN {ORDINAL} END AS known
  FROM entries),
{mining(source="redacted", by="grp")},
keys AS (SELECT grp, words, max(known) AS known, min(ts) AS first_ts, max(ts) AS last_ts FROM w GROUP BY grp, words),
tpl AS (SELECT string_split(leaf, '|')[1] AS grp, leaf, hit, pattern, tokens, count, first FROM mined),
best AS (
  SELECT k.grp, k.words, any_value(known) AS known, arg_min((leaf, hit), (-count, first)) AS best
  FROM keys k JOIN tpl t ON t.grp = k.grp AND len(t.tokens) = len(k.words)
       AND len(list_filter(t.tokens, lambda x, i: x <> '<*>' AND x <> k.words[i])) = 0
  GROUP BY k.grp, k.words),
levels AS (SELECT grp, best, max(known) AS known FROM best GROUP BY grp, best),
early AS (SELECT leaf, hit, message, row_number() OVER (PARTITION BY leaf, hit ORDER BY seq) AS k FROM hits),
examples AS (
  SELECT leaf, hit, string_agg('    - ' || CASE WHEN strlen(message) > 120 THEN message[1:117] || '...' ELSE message END || chr(10), '' ORDER BY k) AS examples
  FROM early WHERE k <= 3 GROUP BY leaf, hit),
listed AS (
  SELECT t.*, CASE WHEN l.known IS NULL THEN 'UNKNOWN' ELSE ['DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][l.known + 1] END AS level,
         CASE WHEN l.known >= 3 THEN 0 WHEN l.known = 2 THEN 1 ELSE 2 END AS section, coalesce(l.known, -1) * 1000 + t.count AS score, x.examples
  FROM tpl t JOIN levels l ON l.grp = t.grp AND l.best = (t.leaf, t.hit) JOIN examples x ON x.leaf = t.leaf AND x.hit = t.hit),
written AS (
  SELECT *, '[' || level || '] ' || pattern || ' (' || count || ' occurrences)' || chr(10) || '  Examples:' || chr(10) || examples AS text,
         row_number() OVER (PARTITION BY grp, section ORDER BY score DESC, first) AS nth
  FROM listed),
ranked AS (SELECT *, sum(strlen(text) // 4) OVER (PARTITION BY grp, section ORDER BY nth) AS cum FROM written),
totals AS (
  SELECT grp, count(*) AS total_lines, min(ts) AS start, max(ts) AS "end", sum(hidden)::BIGINT AS redacted_count FROM redacted GROUP BY grp),
heads AS (
  SELECT t.*, (SELECT count(*) FROM listed l WHERE l.grp = t.grp) AS total_templates, 0 AS included, []::VARCHAR[] AS shown FROM totals t),
body AS (
  SELECT *, '=== Log Analysis Summary ===' || chr(10) || chr(10)
    || 'Time Range: ' || strftime(start, '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime("end", '%Y-%m-%dT%H:%M:%SZ') || chr(10)
    || 'Total Lines: ' || total_lines || chr(10) || 'Unique Patterns: ' || total_templates || chr(10)
    || 'Sensitive Values Redacted: ' || redacted_count || chr(10) || chr(10) AS body
  FROM heads),
body0 AS (SELECT *, strlen(body) // 4 AS used FROM body),{",".join(sections)},
sized AS (SELECT *, strlen(body) + strlen('Token Count: ~ / {limit}') + 1 AS size FROM body3),
doc AS (SELECT *, body || {footer} AS summary FROM sized)"""


# what a stream keeps: the entries with a time that did not come too late
IN_TIME = f"""{RECURSIVE},
intime AS (
  SELECT * REPLACE (row_number() OVER (ORDER BY ts, message) AS seq) FROM entries
  WHERE ts IS NOT NULL AND NOT (e % 50 = 0 AND ts < TIMESTAMP '2024-01-11'))"""


def rate_sql(key: str, hours: int) -> str:
    return f"""{ENTRIES},
c AS (
  SELECT pattern, i, count(*) AS n
  FROM (SELECT {key} AS pattern, floor(epoch(ts) / {hours * 3600})::BIGINT AS i FROM entries WHERE ts IS NOT NULL)
  WHERE pattern <> '' GROUP BY pattern, i),
g AS (
  SELECT p.pattern, i.i, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT pattern FROM c) p, (SELECT unnest(range((SELECT min(i) FROM c), (SELECT max(i) + 1 FROM c))) AS i) i
  LEFT JOIN c ON c.pattern = p.pattern AND c.i = i.i),
m AS (
  SELECT *, median(n) OVER before AS median, mad(n::DOUBLE) OVER before AS apart, sum(n) OVER before AS past, i - min(i) OVER () AS known
  FROM g WINDOW before AS (PARTITION BY pattern ORDER BY i ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
scores AS (
  SELECT pattern, make_timestamp(i * {hours * 3600} * 1000000) AS start, make_timestamp((i + 1) * {hours * 3600} * 1000000) AS "end", n AS count,
         median, greatest(apart * 1.4826, sqrt(median), 1) AS spread, (n - median) / greatest(apart * 1.4826, sqrt(median), 1) AS score
  FROM m WHERE known >= 6 AND (n > 0 OR past > 0))"""


# what the system turn of each task says
PROMPT_TEXTS = """WITH hand AS (SELECT 'The input is a digest of log lines: message patterns with counts, levels and a few examples. '
  || '<*> stands for a part that varied. Lines that are not in the digest are unknown to you.' || chr(10) || chr(10) AS start),
system AS (SELECT task, start || wanted AS content FROM hand, (VALUES
  ('summarize', 'Tell an on-call engineer in at most 200 words what this system was doing, which of it deserves attention, and the one thing to do next.'),
  ('root_cause', 'State the most likely cause of the trouble in your first sentence. Follow with the chain of patterns that supports it, each with its count, and with a second candidate if the digest allows one. Close with the single log line that would settle the question.'),
  ('anomaly_detection', 'List patterns whose count or level does not fit the rest, one per line, the oddest first, as: pattern | why it is odd | how sure you are (0-100). Write ''none'' if there are none.'),
  ('natural_language_query', 'Reply to the question from the digest alone, in one or two sentences, naming the patterns you relied on. If they do not answer it, reply ''not in these logs''.'),
  ('structured_output', 'First discuss the digest freely. Once asked for JSON, send a single object with the keys summary (text), severity (info, warning, error or critical), key_findings (list of texts), timeline (list of {timestamp, event}), root_cause (text or null), anomalies (list of {description, severity, evidence}) and recommendations (list of texts).')
) AS t(task, wanted))"""

CONTEXT_POS = f"""{ENTRIES},
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS pos FROM entries)"""

# ranges around anchors: consecutive positions within reach of one are a chunk
def anchored_sql(before: int, after: int, anchor: str) -> str:
    return f"""{CONTEXT_POS},
near AS (
  SELECT *, {anchor} AS anchor, max(({anchor})::INT) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN {after} PRECEDING AND {before} FOLLOWING) = 1 AS inside FROM p),
runs AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY file ORDER BY pos), false) AS starts FROM near),
chunked AS (
  SELECT *, (sum(starts::INT) OVER (PARTITION BY file ORDER BY pos))::BIGINT AS chunk_id FROM runs QUALIFY inside)"""


HOURS = f"""{CONTEXT_POS},
known AS (
  SELECT *, last_value(date_trunc('hour', ts) IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS earlier,
         first_value(date_trunc('hour', ts) IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later,
         min(date_trunc('hour', ts)) OVER (PARTITION BY file) AS least
  FROM p),
chunked AS (SELECT *, (epoch(coalesce(earlier, later)) - epoch(least))::BIGINT // 3600 + 1 AS chunk_id FROM known)"""


def packed_sql(chunked: str, least: int, largest: int) -> str:
    piece = (largest - least) // 2
    return f"""{chunked},
nth AS (
  SELECT *, row_number() OVER (PARTITION BY file, chunk_id ORDER BY pos) - 1 AS k,
         row_number() OVER (PARTITION BY file ORDER BY chunk_id, pos) - 1 AS place FROM chunked),
packed AS (SELECT *, (place - k % {piece}) // {largest - piece} + 1 AS pack_id FROM nth)"""


ORACLE = {
    "parse_entries": f"{ENTRIES} SELECT file, line, raw, format, ts, level, message, source FROM entries",
    "parse_fields": f"""{ENTRIES},
kv AS (
  SELECT line, 'user_id' AS key, CAST(u AS VARCHAR) AS value FROM entries WHERE shape = 0
  UNION ALL SELECT line, 'process', 'app' FROM entries WHERE shape = 1
  UNION ALL SELECT line, 'pid', CAST(u AS VARCHAR) FROM entries WHERE shape = 1
  UNION ALL SELECT line, 'method', 'GET' FROM entries WHERE shape = 2
  UNION ALL SELECT line, 'path', '/item/' || (e % 97) FROM entries WHERE shape = 2
  UNION ALL SELECT line, 'protocol', 'HTTP/1.1' FROM entries WHERE shape = 2
  UNION ALL SELECT line, 'status_code', status FROM entries WHERE shape = 2
  UNION ALL SELECT line, 'size', CAST(e % 5000 AS VARCHAR) FROM entries WHERE shape = 2
  UNION ALL SELECT line, 'user_agent', 'agent/' || (u % 3) FROM entries WHERE shape = 2
  UNION ALL SELECT line, 'user', 'u' || u FROM entries WHERE shape = 2 AND u % 2 = 0)
SELECT line, key, value FROM kv""",
    "format_counts": f"{ENTRIES} SELECT format, count(*) AS count FROM entries GROUP BY format",
    "level_spellings": """SELECT CASE event_id % 16 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'INFO'
  WHEN 4 THEN 'WARN' WHEN 5 THEN 'WARN' WHEN 6 THEN 'ERROR' WHEN 7 THEN 'ERROR' WHEN 8 THEN 'FATAL' WHEN 9 THEN 'FATAL'
  WHEN 10 THEN 'FATAL' ELSE 'UNKNOWN' END AS level, event_id % 16 AS spelling, count(*) AS count FROM events GROUP BY 1, 2""",
    "json_times": """SELECT event_id AS line, CASE event_id % 8
  WHEN 0 THEN (1700000000 + event_id) * 1000000 WHEN 1 THEN (1700000000000 + event_id) * 1000
  WHEN 2 THEN (500000000000 + event_id) * 1000000 WHEN 3 THEN 1000000000000 * 1000000
  WHEN 4 THEN -(300000000000 + event_id) * 1000000 WHEN 5 THEN (1000000000001 + event_id) * 1000
  WHEN 6 THEN (1600000000 + event_id) * 1000000 ELSE NULL END::BIGINT AS micros FROM events""",
    "generic_times": """SELECT event_id AS line, CASE event_id % 7
  WHEN 0 THEN epoch_us(date_trunc('second', ts) + INTERVAL 5 HOUR)
  WHEN 1 THEN epoch_us(date_trunc('second', ts))
  WHEN 2 THEN epoch_us(date_trunc('second', ts)) + 250000
  WHEN 3 THEN epoch_us(date_trunc('second', ts))
  WHEN 5 THEN epoch_us(date_trunc('second', ts) - INTERVAL 90 MINUTE)
  WHEN 6 THEN epoch_us(date_trunc('second', ts)) END AS micros FROM events""",
    "read_files": f"""{ENTRIES} SELECT count(*) AS total_lines, count(*) AS distinct_lines, 1::BIGINT AS first_line,
0::BIGINT AS missing_lines, count(*) AS equal_positions, count(*) FILTER (level = 'ERROR') AS errors FROM entries""",
    "read_glob": f"{ENTRIES} SELECT level, count(*) AS count FROM entries WHERE file IN ('f0.log', 'f1.log') GROUP BY level",
    "search_pattern": kept("shape <> 2 AND e % 500 >= 400"),
    "search_inverted": kept("shape = 2"),
    "search_level": kept("level = 'WARN'"),
    "search_combined": kept(
        "shape <> 2 AND message LIKE '%bought item%' AND level = 'INFO' AND (ts IS NULL OR "
        "(ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'))"
    ),
    "time_range": kept(
        "ts IS NULL OR (ts >= TIMESTAMP '2024-01-14 12:00:00' AND ts <= TIMESTAMP '2024-01-18 06:00:00')"
    ),
    "min_level": kept("level IN ('ERROR', 'FATAL', 'UNKNOWN')"),
    "exact_level": kept("level = 'FATAL' AND NOT (shape <> 2 AND u % 40 IN (5) )"),
    "tail_level": kept(
        r"level IN ('WARN', 'ERROR', 'FATAL', 'UNKNOWN') AND regexp_matches(raw, '10.0.')"
    ),
    "count_matches": f"""{ENTRIES} SELECT file, count(*) FILTER (shape <> 2 AND e % 500 >= 400) AS count
FROM entries GROUP BY file""",
    "search_context": f"""{CONTEXT_POS},
h AS (SELECT *, shape <> 2 AND e % 500 >= 490 AS matched FROM p),
c AS (SELECT *, bool_or(matched) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM h)
SELECT {LINE}, matched FROM c WHERE near""",
    "context_groups": f"""{CONTEXT_POS},
h AS (SELECT *, level = 'FATAL' AS matched FROM p),
c AS (SELECT *, max(CASE WHEN matched THEN pos END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
       min(CASE WHEN matched THEN pos END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM h),
s AS (SELECT *, CASE WHEN matched AND (prev IS NULL OR pos - prev > 3) THEN 1 ELSE 0 END AS opens FROM c),
r AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY pos) AS running FROM s)
SELECT file, line, matched,
       CAST(CASE WHEN matched OR pos - prev <= 3 THEN running ELSE running + 1 END AS BIGINT) AS group_id
FROM r WHERE matched OR pos - prev <= 3 OR next - pos <= 3""",
    "last_entries": f"""{ENTRIES},
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line DESC) AS k FROM entries
      WHERE level IN ('WARN', 'ERROR', 'FATAL', 'UNKNOWN') AND contains(raw, 'user'))
SELECT {LINE} FROM r WHERE k <= 25""",
    "last_many_entries": f"""{ENTRIES},
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line DESC) AS k FROM entries)
SELECT {LINE} FROM r WHERE k <= 1500""",
    "total_lines": "SELECT count(*) AS total_lines FROM events",
    "level_counts": f"""{ENTRIES} SELECT level, count(*) AS count,
round(count(*) * 100.0 / (SELECT count(*) FROM entries), 6)::DOUBLE AS percent FROM entries GROUP BY level""",
    "time_span": f"""{ENTRIES} SELECT min(ts) AS first_entry, max(ts) AS last_entry,
epoch(max(ts))::DOUBLE - epoch(min(ts))::DOUBLE AS duration_seconds FROM entries""",
    "error_rate": f"""{ENTRIES} SELECT round(count(*) FILTER (level IN ('ERROR', 'FATAL')) * 1.0 / count(*), 6)::DOUBLE
AS error_rate FROM entries""",
    "top_messages": f"""{ENTRIES} SELECT message, count(*) AS count FROM entries GROUP BY message
ORDER BY count DESC, message LIMIT 20""",
    "compute_stats": f"""{ENTRIES},
top AS (SELECT message, count(*) AS n FROM entries GROUP BY message ORDER BY n DESC, message LIMIT 5)
SELECT count(*) AS total_lines, ltrim({LEVEL_MAP}, ',') AS level_counts,
       min(ts) AS first_entry, max(ts) AS last_entry,
       round(count(*) FILTER (level IN ('ERROR', 'FATAL')) * 1.0 / count(*), 6)::DOUBLE AS error_rate,
       (SELECT string_agg(message || '=' || n, '|' ORDER BY n DESC, message) FROM top) AS top_messages
FROM entries""",
    "group_by_level": group_sql("level", 3),
    "group_by_message": group_sql("message", 15),
    "group_by_source": group_sql("CASE WHEN source = '' THEN '(unknown)' ELSE source END", 10),
    "hourly_windows": window_sql(3600),
    "weekly_windows": window_sql(7 * 86400),
    "minute_windows": window_sql(60),
    "window_levels": f"""{ENTRIES} SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start,
level, count(*) AS count FROM entries WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "text_lines": f"{ENTRIES} SELECT file || ':' || raw AS value FROM entries",
    "entry_json": f"""{ENTRIES} SELECT '{{"raw":' || CAST(to_json(raw) AS VARCHAR) || ',"timestamp":"'
|| coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '0001-01-01T00:00:00Z') || '","level":"' || level
|| '","message":"' || message || '"' || CASE WHEN source = '' THEN '' ELSE ',"source":"' || source || '"' END
|| CASE shape WHEN 0 THEN ',"fields":{{"user_id":' || u || '}}'
     WHEN 1 THEN ',"fields":{{"pid":"' || u || '","process":"app"}}'
     WHEN 2 THEN ',"fields":{{"method":"GET","path":"/item/' || (e % 97) || '","protocol":"HTTP/1.1","size":"'
       || (e % 5000) || '","status_code":"' || status || '"' || CASE WHEN u % 2 = 0 THEN ',"user":"u' || u || '"' ELSE '' END
       || ',"user_agent":"agent/' || (u % 3) || '"}}'
     ELSE '' END || ',"line":' || line || '}}' AS value FROM entries""",
    "table_rows": f"""{ENTRIES} SELECT line, level, coalesce(strftime(ts, '%H:%M:%S'), '') AS timestamp,
CASE WHEN strlen(message) > 80 THEN message[1:77] || '...' ELSE message END AS message FROM entries""",
    "redact_documents": f"WITH {DOC_STEPS} SELECT doc_id, t AS text, n AS redacted_count FROM s{len(REDACTED)}",
    "sensitive_documents": "SELECT doc_id, "
    + " OR ".join(f"regexp_matches(text, '{REGEX[x][1]}')" for x in REDACTED)
    + " AS is_sensitive, len(list_distinct(list_concat("
    + ", ".join(f"regexp_extract_all(text, '{REGEX[x][1]}')" for x in REDACTED)
    + "))) AS sensitive_values FROM documents",
    "redacted_values": f"""{VALUES} SELECT value, type, '[' || type || ':' || sha256(value)[1:4] || ']' AS placeholder FROM v""",
    "redacted_types": f"{VALUES} SELECT type, count(*) AS count FROM v GROUP BY type",
    "redact_entries": f"""{ENTRIES},
r AS (SELECT *, sha256('10.0.' || (u % 256) || '.' || (e % 256))[1:4] AS h0, sha256('10.1.0.' || (u % 256))[1:4] AS h1 FROM entries)
SELECT file, line, replace(message, '10.0.' || (u % 256) || '.' || (e % 256), '[IPV4:' || h0 || ']') AS message,
  CASE WHEN shape = 2 THEN '[IPV4:' || h1 || ']' || raw[strlen('10.1.0.' || (u % 256)) + 1:]
       ELSE replace(raw, '10.0.' || (u % 256) || '.' || (e % 256), '[IPV4:' || h0 || ']') END AS raw,
  CAST(CASE WHEN shape = 2 THEN 1 WHEN raw = message THEN 1 ELSE 2 END AS BIGINT) AS redacted_count FROM r""",
    "redact_all_patterns": f"""WITH planted AS (SELECT c_custkey, {PLANTED} AS text FROM customer),
{redaction_steps("planted", "c_custkey", "text", ALL_PATTERNS)}
SELECT s.c_custkey, s.t AS text, s.n AS redacted_count, p.text AS switched_off
FROM s{len(ALL_PATTERNS)} s JOIN planted p ON s.c_custkey = p.c_custkey""",
    "redact_pages": f"""WITH {redaction_steps("pages", "page_id", "html", ("email", "ipv4"))}
SELECT page_id, n AS redacted_count, sha256(t) AS html_hash FROM s2""",
    "token_estimates": f"""WITH x AS (SELECT *, array_to_string({tokens("text")}, ' ') AS plain FROM conversations)
SELECT conv_id, turn, strlen(text) // 4 AS tokens, len({tokens("text")}) AS words,
CASE WHEN strlen(plain) > 60 THEN plain[1:57] || '...' ELSE plain END AS short_text FROM x""",
    "template_frequency": f"""{ENTRIES} SELECT {masked("message")} AS pattern, count(*) AS count FROM entries GROUP BY 1""",
    "document_frequency": f"""WITH x AS (SELECT {masked("text")} AS pattern FROM documents)
SELECT pattern, count(*) AS count FROM x WHERE pattern <> '' GROUP BY 1""",
    "turn_similarity": f"""WITH t AS (SELECT conv_id, turn, {tokens("text")} AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b, greatest(len(a.w), len(b.w)) AS longest
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT *, CASE WHEN longest = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
        ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i] OR a[i] = '<*>' OR b[i] = '<*>'))::DOUBLE / longest END AS s FROM p)
SELECT conv_id, turn, round(s, 6)::DOUBLE AS similarity, s >= 0.5 AS matches,
  array_to_string(list_transform(range(1, longest + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE '<*>' END), ' ') AS merged FROM q""",
    "short_hashes": """SELECT c_custkey, sha256(c_name)[1:4] AS hash4, lower(c_name) AS normalized,
'[EMAIL:' || sha256(lower(c_name))[1:4] || ']' AS placeholder FROM customer""",
    "mine_templates": f"""{MINED},
early AS (SELECT *, row_number() OVER (PARTITION BY leaf, hit ORDER BY seq) AS k FROM hits)
SELECT template_id, pattern, count, string_agg(message, '|' ORDER BY seq) AS examples
FROM mined m JOIN early e ON m.leaf = e.leaf AND m.hit = e.hit WHERE k <= 3 GROUP BY ALL""",
    "template_assignments": f"""{MINED} SELECT seq, template_id, pattern
FROM hits h JOIN mined m ON m.leaf = h.leaf AND m.hit = h.hit""",
    "template_totals": f"""{MINED} SELECT count(*) AS template_count, sum(count)::BIGINT AS total_log_count FROM mined""",
    "first_match": f"""{ENTRIES},
t AS (SELECT {masked("message")} AS pattern, count(*) AS n, min(seq) AS first_seq FROM entries GROUP BY 1),
k AS (SELECT DISTINCT {masked("message", "#")} AS key FROM entries),
tw AS (SELECT *, string_split(pattern, ' ') AS w FROM t), kw AS (SELECT *, string_split(key, ' ') AS w FROM k),
m AS (SELECT key, pattern, n, first_seq FROM kw JOIN tw ON len(kw.w) = len(tw.w)
      AND len(list_filter(range(1, len(kw.w) + 1), lambda i: NOT (tw.w[i] = '<*>' OR tw.w[i] = kw.w[i]))) = 0)
SELECT key, arg_min(pattern, (-n, first_seq)) AS pattern FROM m GROUP BY key""",
    "template_priority": f"""{ENTRIES},
g AS (SELECT {masked("message")} AS pattern, count(*) AS n,
        max(CASE WHEN level <> 'UNKNOWN' THEN {ORDINAL} END) AS k FROM entries GROUP BY 1),
l AS (SELECT *, CASE WHEN k IS NULL THEN 'UNKNOWN' ELSE ['DEBUG','INFO','WARN','ERROR','FATAL'][k + 1] END AS level FROM g)
SELECT pattern, level, CAST(coalesce(k, -1) * 1000 + n AS BIGINT) AS score,
  CASE WHEN k >= 3 THEN 0 WHEN k = 2 THEN 1 ELSE 2 END AS section,
  '[' || level || '] ' || pattern || ' (' || n || ' occurrences)' || chr(10) || '  Examples:' || chr(10) || '    - '
  || CASE WHEN strlen(pattern) > 120 THEN pattern[1:117] || '...' ELSE pattern END || chr(10) AS formatted,
  round(n / 4.0, 6)::DOUBLE AS ratio FROM l""",
    "crowded_templates": f"""{RECURSIVE},{mining(threshold=0.8, routed=crowded_sql(4, 2))} SELECT template_id, pattern, count FROM mined""",
    "template_lookup": f"""{MINED} SELECT template_id, pattern, count FROM mined WHERE template_id = 'T_2'""",
    "templates_by_level": compress_sql("file", 4000) + """
SELECT s.grp AS file, pattern, count, level FROM body0 d JOIN ranked s ON s.grp = d.grp AND section = 0
WHERE used + cum <= 3800 AND level = 'ERROR'""",
    "template_lineage": f"""{RECURSIVE},
redacted AS (
  SELECT * REPLACE (replace(message, '10.0.' || (u % 256) || '.' || (e % 256),
                    '[IPV4:' || sha256('10.0.' || (u % 256) || '.' || (e % 256))[1:4] || ']') AS message) FROM entries),
{mining(source="redacted", by="file")}
SELECT string_split(leaf, '|')[1] AS file, 'T_' || row_number() OVER (PARTITION BY string_split(leaf, '|')[1] ORDER BY first) AS template_id,
       pattern, count FROM mined""",
    "compress_all": compress_sql("'all'", 8000) + """
SELECT summary, total_templates, included::BIGINT AS included_templates, strlen(summary) // 4 AS token_count FROM doc""",
    "compress_by_file": compress_sql("file", 4000) + """
SELECT grp AS file, summary, start, "end", total_lines, total_templates, included::BIGINT AS included_templates, redacted_count,
       strlen(summary) // 4 AS token_count, 4000::BIGINT AS token_limit FROM doc""",
    "compress_stats": compress_sql("level", 8000) + f"""
SELECT grp AS level, total_lines AS input_lines, included::BIGINT AS output_templates, redacted_count, strlen(summary) // 4 AS token_count,
       8000::BIGINT AS token_limit, round(CASE WHEN total_templates > 0 THEN total_lines / total_templates ELSE 1 END, 6)::DOUBLE AS compression_ratio,
       strlen(summary) // 4 <= 8000 AS within_budget,
       {", ".join(f"len(list_filter(shown, lambda x: x = '{x}')) AS {x.lower()}_count" for x in LEVELS[:-1])}
FROM doc""",
    "compress_redacted_types": f"""{ENTRIES},
v AS (SELECT '10.0.' || (u % 256) || '.' || (e % 256) AS ip FROM entries WHERE shape <> 2
      UNION SELECT '10.1.0.' || (u % 256) FROM entries WHERE shape = 2)
SELECT 'IPV4' AS type, count(*) AS count FROM v""",
    "prompts": f"""{PROMPT_TEXTS} SELECT doc_id, 0 AS n, 'system' AS role, content FROM documents, system WHERE task = 'root_cause'
UNION ALL SELECT doc_id, 1, 'user', 'Perform a root cause analysis on the following log summary:' || chr(10) || chr(10)
|| 'Source file: ' || source || chr(10) || chr(10)
|| text || chr(10) || chr(10) || 'Note: Filtered by level: error; Time window applied: 5m.' || chr(10) FROM documents""",
    "task_prompts": f"""{PROMPT_TEXTS},
turns AS (
  SELECT conv_id, turn, task, content, text,
    CASE task WHEN 'root_cause' THEN 'Perform a root cause analysis on the following log summary:'
              WHEN 'anomaly_detection' THEN 'Identify anomalies in the following log summary:'
              ELSE 'Analyze the following log summary:' END || chr(10) || chr(10) || 'Source files (2): a.log, b.log' || chr(10) || chr(10)
      || text || chr(10) || chr(10) AS asked
  FROM conversations, system WHERE text <> '')
SELECT conv_id, turn, task, 0 AS n, 'system' AS role, content FROM turns
UNION ALL SELECT conv_id, turn, task, 1, 'user', CASE task WHEN 'natural_language_query' THEN
  'Question: Why?' || chr(10) || chr(10) || 'Log Summary:' || chr(10) || text ELSE asked END FROM turns
UNION ALL SELECT conv_id, turn, task, 2, 'assistant', role_ FROM (SELECT *, 'It is ' || turn AS role_ FROM turns) WHERE task = 'structured_output'
UNION ALL SELECT conv_id, turn, task, 3, 'user', 'JSON, please: the object with the seven keys, and no text around it.' FROM turns
WHERE task = 'structured_output'""",
    "question_prompts": """SELECT conv_id, turn, 'Question: What failed?' || chr(10) || chr(10) || 'Log Summary:' || chr(10)
|| text || 'Note: Filtered by pattern: ' || turn || '.' || chr(10) AS content FROM conversations""",
    "chunk_errors": anchored_sql(20, 10, "level IN ('ERROR', 'FATAL')") + " SELECT file, line, anchor, chunk_id FROM chunked",
    "chunk_sliding": f"""{CONTEXT_POS},
sized AS (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM p),
k AS (SELECT file, unnest(range(0, greatest(max(n) - 30 + 19, 0) // 20 + 1)) AS k FROM sized GROUP BY file)
SELECT file, line, k + 1 AS chunk_id FROM sized JOIN k USING (file) WHERE pos BETWEEN k * 20 + 1 AND k * 20 + 30""",
    "chunk_hours": HOURS + " SELECT file, line, chunk_id FROM chunked",
    "chunk_packs": packed_sql(anchored_sql(4, 2, "level = 'FATAL'"), 25, 60) + " SELECT file, line, chunk_id, pack_id FROM packed",
    "chunk_texts": packed_sql(HOURS, 20, 100) + f""",
said AS (SELECT file, pack_id, message, count(*) AS n, min(pos) AS first FROM packed GROUP BY ALL),
bodies AS (SELECT file, pack_id, string_agg(CASE WHEN n > 1 THEN n || 'x ' ELSE '' END || message, chr(10) ORDER BY first) AS body FROM said GROUP BY ALL),
heads AS (
  SELECT file, pack_id, min(line) AS first_line, max(line) AS last_line, count(*) AS n_lines, count(*) FILTER (level = 'FATAL') AS n_fatal,
         file || ', lines ' || min(line) || ' to ' || max(line)
         || coalesce(', ' || strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ'), '') || ': '
         || concat_ws(', ', {", ".join(f"CASE WHEN count(*) FILTER (level = '{x}') > 0 THEN '{x} ' || count(*) FILTER (level = '{x}') END" for x in reversed(LEVELS))})
         || chr(10) AS head
  FROM packed GROUP BY file, pack_id)
SELECT file, pack_id, first_line, last_line, n_lines, n_fatal, head || body AS text, strlen(head || body) // 4 AS tokens
FROM heads JOIN bodies USING (file, pack_id)""",
    "rate_scores": rate_sql("regexp_extract(message, '^user [0-9]+ ([a-z ]+) [0-9]', 1)", 4)
    + """ SELECT pattern, start, "end", count, round(median, 6) AS median, round(spread, 6) AS spread, round(score, 6) AS score FROM scores""",
    "rate_anomalies": rate_sql(masked("message"), 12)
    + """ SELECT pattern, start, "end", count, round(median, 6) AS median, round(spread, 6) AS spread, round(score, 6) AS score,
CASE WHEN abs(score) >= 13 THEN 'CRITICAL' WHEN abs(score) >= 8 THEN 'HIGH' WHEN abs(score) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
CASE WHEN score > 0 THEN 'spike' ELSE 'drop' END AS direction FROM scores WHERE abs(score) >= 3""",
    "template_diff": f"""{ALIGNED}
SELECT CASE WHEN bp <> ap OR s / bs >= 2 OR s / bs * 2 <= 1 THEN 'changed' ELSE 'same' END AS status, bp AS before_pattern, ap AS after_pattern,
       bc AS before_count, ac AS after_count, round(bs, 6) AS before_share, round(s, 6) AS after_share, round(s / bs, 6) AS change FROM aligned
UNION ALL SELECT 'gone', pattern, NULL, count, NULL, round(share, 6), NULL, NULL FROM b WHERE pattern NOT IN (SELECT bp FROM aligned)
UNION ALL SELECT 'new', NULL, pattern, NULL, count, NULL, round(share, 6), NULL FROM a WHERE pattern NOT IN (SELECT ap FROM aligned)""",
    "stream_windows": f"""{IN_TIME}
SELECT time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 2 HOURS AS "end",
       count(*) AS count, ltrim({LEVEL_MAP}, ',') AS level_counts, count(*) FILTER (level IN ('ERROR', 'FATAL', 'UNKNOWN')) AS error_count,
       round(count(*) FILTER (level IN ('ERROR', 'FATAL', 'UNKNOWN')) * 100.0 / count(*), 6)::DOUBLE AS error_percent
FROM intime GROUP BY ALL""",
    "stream_templates": f"""{IN_TIME},{mining(source="intime")},
firsts AS (SELECT leaf, hit, min(i.ts) AS first_ts FROM hits JOIN intime i USING (seq) GROUP BY leaf, hit)
SELECT pattern, count, first_ts FROM mined JOIN firsts USING (leaf, hit)""",
    "follow_appended": f"""{ENTRIES},
arrived AS (
  SELECT *, 'app' || (line % 64) || '.log' AS name,
         row_number() OVER (PARTITION BY line % 64 ORDER BY line % 5 = 0, line) AS nth FROM entries)
SELECT name AS file, nth AS line, level, message FROM arrived WHERE level IN ('WARN', 'ERROR', 'FATAL', 'UNKNOWN')""",
    "vector_top_k": """SELECT vec_id, place, neighbour, similarity FROM (
  SELECT q.vec_id, e.vec_id AS neighbour, similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id)::INT AS place
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id,
       LATERAL (SELECT round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity)
  WHERE q.vec_id % 20 = 0) WHERE place <= 10""",
    "tail_then_follow": f"""{ENTRIES},
found AS (SELECT *, line % 5 = 0 AS later FROM entries WHERE level IN ('ERROR', 'FATAL', 'UNKNOWN')),
r AS (SELECT *, row_number() OVER (PARTITION BY file, later ORDER BY line DESC) AS k FROM found)
SELECT level, message, later AS followed FROM r WHERE later OR k <= 25""",
    "follow_stream": f"""{ENTRIES} SELECT format, ts, level, message, source FROM entries
WHERE level IN ('ERROR', 'FATAL', 'UNKNOWN') AND contains(raw, '10.0.')""",
}
