"""SQL fragments for DuckDB that the queries' oracle statements share."""

AS_OF = "2025-06-01 00:00:00"

SCOPE = "to_json([coalesce(tenant_id, ''), coalesce(user_id, ''), coalesce(agent_id, '')])::VARCHAR"

REC = f"""rec AS (
  SELECT *, {SCOPE} AS scope FROM memory_record QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at) = 1)"""

EXT = "ext AS (SELECT * FROM extracted_memory QUALIFY row_number() OVER (PARTITION BY extract_id ORDER BY ingested_at) = 1)"

JOB = f"job AS (SELECT *, {SCOPE} AS scope FROM memory_job QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ingested_at) = 1)"

QRY = f"qry AS (SELECT *, {SCOPE} AS scope FROM query_fixture QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ingested_at) = 1)"

VALID = f"(valid_from IS NULL OR valid_from <= TIMESTAMPTZ '{AS_OF}+00') AND (valid_until IS NULL OR valid_until > TIMESTAMPTZ '{AS_OF}+00')"

RECALLABLE = f"status = 'active' AND visibility = 'recallable' AND {VALID}"

CHANNEL = "CASE WHEN layer IN ('l0_basic_info', 'l4_identity') THEN 'profile' ELSE 'normal' END"

BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def tags(x: str) -> str:
    """Trimmed, lower-case, distinct tags in order."""
    clean = f"list_filter(list_transform(coalesce({x}, []), lambda g: lower({trim('g')})), lambda g: g IS NOT NULL AND g <> '')"
    return f"list_slice(list_filter({clean}, lambda g, i: list_position({clean}, g) = i), 1, 32)"


def tokens(x: str) -> str:
    runs = f"regexp_extract_all(coalesce({x}, ''), '[a-zA-Z0-9]+|[\\x{{3400}}-\\x{{9fff}}]+')"
    one = "CASE WHEN regexp_matches(r, '^[a-zA-Z0-9]') THEN [lower(r)] WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i:i+1]) END"
    return f"flatten(list_transform({runs}, lambda r: {one}))"


def runs(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z0-9]+|[\\x{{3400}}-\\x{{9fff}}]+'), lambda r: lower(r))"


def feature_hashes(x: str) -> str:
    feats = f"flatten(list_transform({runs(x)}, lambda r: list_concat(['t:' || r], list_transform(range(1, length(r)), lambda i: 'b:' || r[i:i+1]))))"
    fnv = "list_reduce(list_transform(string_split(f, ''), lambda c: unicode(c)::BIGINT), lambda h, p: (xor(h, p) * 16777619) & 4294967295, 2166136261::BIGINT)"
    return f"list_transform({feats}, lambda f: {fnv})"


# The intent patterns and terms, and the hash parameters above.
INTENT = """CASE
  WHEN regexp_matches({x}, '`[^`]+`|"[^"]{{2,}}"|''[^'']{{2,}}''')
    OR regexp_matches({x}, '[/\\\\][A-Za-z0-9_.-]+[/\\\\]|https?://\\S+')
    OR regexp_matches({x}, '(^|[^A-Za-z0-9_])([a-z][a-z0-9]*_[a-z0-9_]+|[A-Za-z][a-z0-9]+[A-Z][A-Za-z0-9]*)($|[^A-Za-z0-9_])')
    OR regexp_matches({x}, '(^|[^A-Za-z0-9_])[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}($|[^A-Za-z0-9_])') THEN 'navigational'
  WHEN regexp_matches(lower({x}), 'how|why|explain|approach|strategy|tend|overall|pattern|怎么|为什么|如何|倾向|风格|整体|通常|模式') THEN 'conceptual'
  ELSE 'factual' END"""


def intent(x: str) -> str:
    return INTENT.format(x=x)


def _fused(extra_tie: str, channel_limit: str) -> str:
    """CTEs sem(query_id, channel, memory_id, s) and lex(..., s) to hits; needs ask(query_id, intent) and rec."""
    return f"""
lexr AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY s DESC, memory_id) AS r FROM lex),
semr AS (SELECT sem.*, row_number() OVER (PARTITION BY sem.query_id, sem.channel ORDER BY sem.s DESC, {extra_tie} sem.memory_id) AS r
  FROM sem LEFT JOIN lexr l ON l.query_id = sem.query_id AND l.channel = sem.channel AND l.memory_id = sem.memory_id),
met AS (
  SELECT query_id, channel, memory_id, max(sr) AS sr, max(lr) AS lr FROM (
    SELECT query_id, channel, memory_id, r AS sr, NULL AS lr FROM semr UNION ALL SELECT query_id, channel, memory_id, NULL, r FROM lexr) GROUP BY 1, 2, 3),
scored AS (
  SELECT m.*, rec.updated_at,
    round(coalesce(CASE intent WHEN 'navigational' THEN 0.4 WHEN 'conceptual' THEN 1.1 ELSE 1.0 END::DOUBLE / (60 + sr), 0)
      + coalesce(CASE intent WHEN 'navigational' THEN 1.4 WHEN 'conceptual' THEN 0.5 ELSE 0.8 END::DOUBLE / (60 + lr), 0), 12) AS score
  FROM met m JOIN ask USING (query_id) JOIN rec USING (memory_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, updated_at DESC NULLS LAST, coalesce(sr, 1099511627776 + lr), memory_id) AS fused_rank FROM scored),
hits AS (SELECT * FROM ranked WHERE fused_rank <= {channel_limit})"""


def _scores(tokens_of) -> str:
    """CTEs ask(query_id, pool, body) and doc(pool, channel, memory_id, body, content) to lex and sem."""
    return f"""
dt AS (SELECT pool, channel, memory_id, {tokens_of('body')} AS toks FROM doc),
size AS (SELECT pool, channel, count(*) AS n, avg(len(toks)) AS mean FROM dt GROUP BY 1, 2),
post AS (SELECT pool, channel, memory_id, len(toks) AS dl, unnest(toks) AS term FROM dt),
tf AS (SELECT pool, channel, term, memory_id, count(*) AS f, first(dl) AS dl FROM post GROUP BY 1, 2, 3, 4),
df AS (SELECT pool, channel, term, count(*) AS df FROM tf GROUP BY 1, 2, 3),
qt AS (SELECT DISTINCT query_id, pool, unnest({tokens_of('body')}) AS term FROM ask),
lex AS (
  SELECT * FROM (
    SELECT qt.query_id, tf.channel, tf.memory_id,
      round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / CASE WHEN mean > 0 THEN mean ELSE 1 END))), 9) AS s
    FROM qt JOIN tf USING (pool, term) JOIN df USING (pool, channel, term) JOIN size USING (pool, channel) GROUP BY 1, 2, 3) WHERE s > 0),
dc AS (SELECT memory_id, (h % 256)::INT AS dim, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS v FROM (SELECT memory_id, unnest({feature_hashes('content')}) AS h FROM (SELECT DISTINCT memory_id, content FROM doc)) GROUP BY 1, 2),
dn AS (SELECT memory_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY memory_id)) AS v FROM dc WHERE v <> 0),
qc AS (SELECT query_id, (h % 256)::INT AS dim, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS v FROM (SELECT query_id, unnest({feature_hashes('body')}) AS h FROM ask) GROUP BY 1, 2),
qn AS (SELECT query_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS v FROM qc WHERE v <> 0),
sem AS (
  SELECT * FROM (
    SELECT ask.query_id, doc.channel, doc.memory_id, round(sum(qn.v * dn.v), 9) AS s
    FROM ask JOIN doc USING (pool) JOIN dn ON dn.memory_id = doc.memory_id JOIN qn ON qn.query_id = ask.query_id AND qn.dim = dn.dim GROUP BY 1, 2, 3) WHERE s >= 0.08)"""


def search(tokens_of=tokens, recall: int = 8, profile: int = 4) -> str:
    """WITH ... hits(query_id, channel, memory_id, score, fused_rank, sr, lr)."""
    return f"""WITH {REC}, {QRY},
ask AS (
  SELECT query_id, query_text AS body, scope || '#' || CASE WHEN session_only THEN 's:' || coalesce(session_id, '') ELSE '*' END AS pool, {intent('query_text')} AS intent FROM qry),
doc AS (
  SELECT scope || '#' || part AS pool, {CHANNEL} AS channel, memory_id, coalesce(content, '') AS content,
    coalesce(content, '') || chr(10) || array_to_string(list_transform(coalesce(tags, []), lambda g: lower({trim("coalesce(g, '')")})), ' ') AS body
  FROM (SELECT *, unnest(['*', 's:' || coalesce(source_session_id, '')]) AS part FROM rec WHERE {RECALLABLE})
  WHERE scope || '#' || part IN (SELECT pool FROM ask)),
{_scores(tokens_of)},
{_fused('', f"CASE channel WHEN 'profile' THEN {profile} ELSE {recall} END")}
"""


def shortlist() -> str:
    return f"""WITH {REC}, {EXT},
ask AS (
  SELECT extract_id AS query_id, ext.content AS body, rec.scope || '#' || ext.layer AS pool, {intent('ext.content')} AS intent
  FROM ext JOIN rec ON rec.memory_id = ext.raw_memory_id WHERE ext.layer IN ('l2_fact', 'l4_identity')),
doc AS (
  SELECT scope || '#' || layer AS pool, 'all' AS channel, memory_id, coalesce(content, '') AS content,
    coalesce(content, '') || chr(10) || array_to_string(list_transform(coalesce(tags, []), lambda g: lower({trim("coalesce(g, '')")})), ' ') AS body
  FROM rec WHERE {RECALLABLE} AND layer IN ('l2_fact', 'l4_identity') AND scope || '#' || layer IN (SELECT pool FROM ask)),
{_scores(tokens)},
{_fused('l.r NULLS LAST,', '12')}
"""
