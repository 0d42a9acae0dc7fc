"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz, pii, quality_classifier
from .chat_format import format_chats, parameter_table
from .decontamination import contamination
from .divergence import LEAST_DOCS, PARTS, SMOOTH, TOP, divergence
from .jaccard_join import jaccard_components
from .language_id import held_out, identify, learn
from .packing import pack
from .quality_rules import COMMON, COMMON_LEAST, MOST_LOST, SHORT, line_rules
from .shared import table
from .spelling import DOMINATES, LEAST_COUNT, LEAST_LETTERS, SLIPS, spelling_variants
from .token_counts import token_counts
from .url_filters import LINK, MENU, filter_urls, rule_table

#: The tools that conversations may call: kind of each parameter, and whether it must be given.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True), "timeout": ("number", False)},
    "calculate": {"expression": ("string", True)},
}
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


#: A text as a JSON string, in the SQL of the two engines.
_SPARK_STRING, _DUCK_STRING = "regexp_extract(to_json(named_struct('v', {})), r'(?s)^.\"v\":(.*).$', 1)", "CAST(to_json({}) AS VARCHAR)"


def _tool_messages(string: str) -> list[tuple[str, str, str, str]]:
    """(condition, turn, role, text) of the messages that a row of conversations (turn t, n = 31 * conv_id + t) gives, in SQL
    that both engines read; ``string`` writes a text as a JSON string. The given conversations hold no tool calls, so each
    assistant turn also gives a message of one or two calls and their results, the second call's first. Calls name the call
    of two turns before, where there may be one. Some are wrong: tools, kinds and parameters that are not known, missing
    parameters and identifiers, repeated identifiers, and results of no call."""
    text = string.format("text")
    given = f"""CASE WHEN t >= 3 AND n % 3 <> 0 THEN '"$a' || (t - 2) || '"' ELSE {text} END"""
    search = f"""'{{"query": ' || {given} || ', "limit": ' || CASE WHEN n % 5 = 0 THEN '"many"' ELSE '' || t END || '}}'"""
    fetch = f"""CASE WHEN n % 7 = 0 THEN '{{"timeout": 2.50}}' ELSE '{{"url": ' || {given} || ', "timeout": 2.50}}' END"""
    sum_ = f"""'{{"precision": 3, "expression": ' || {given} || '}}'"""
    name = "CASE n % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'fetch' WHEN 2 THEN 'calculate' ELSE 'lookup' END"
    id_ = """CASE WHEN n % 17 = 0 THEN '' WHEN n % 13 = 0 THEN '"id": "again", ' ELSE '"id": "a' || t || '", ' END"""
    first = f"""'{{"name": "' || {name} || '", ' || {id_} || '"arguments": ' || CASE n % 4 WHEN 1 THEN {fetch} WHEN 2 THEN {sum_} ELSE {search} END || '}}'"""
    second = """CASE WHEN n % 2 = 0 THEN ', {"name": "calculate", "id": "b' || t || '", "arguments": {"expression": "$a' || t || '"}}' ELSE '' END"""
    of = """CASE WHEN n % 19 = 0 THEN 'none' WHEN n % 13 = 0 THEN 'again' ELSE 'a' || t END"""
    return [
        ("true", "4 * t", "role", "text"),
        ("role = 'assistant'", "4 * t + 1", "'assistant'", f"""'{{"tool_calls": [' || {first} || {second} || ']}}'"""),
        ("role = 'assistant' AND n % 2 = 0", "4 * t + 2", "'tool'", """'{"tool_call_id": "b' || t || '", "content": {"z": ' || t || ', "at": 1.0}}'"""),
        ("role = 'assistant'", "4 * t + 3", "'tool'", f"""'{{"tool_call_id": "' || {of} || '", "content": ' || {text} || '}}'"""),
    ]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls, from all rows of conversations (conv_id, turn, role, text)."""
    rows = conversations.selectExpr("conv_id", "turn AS t", "31 * conv_id + turn AS n", "role", "text")
    each = [f"CASE WHEN {c} THEN named_struct('turn', {t}, 'role', {r}, 'text', {x}) END" for c, t, r, x in _tool_messages(_SPARK_STRING)]
    return rows.select("conv_id", F.explode(F.array(*map(F.expr, each))).alias("m")).where("m is not null").select("conv_id", "m.*")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(tool_messages(table(spark, sf_dir, "conversations")), parameter_table(spark, TOOLS))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"), with_text=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(docs["doc_id"])))
    return identify(docs, model, with_spans=False, keep=[held_out(docs["doc_id"]).alias("held_out")])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.grade(docs, quality_classifier.learn(docs, quality_classifier.grades_of(table(spark, sf_dir, "labels"))))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES)).drop("trust", "distrust")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = katz.score(docs, katz.learn(docs.where(~katz.held_out(docs["doc_id"]))))
    return scored.withColumn("held_out", katz.held_out(scored["doc_id"]))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_url_filters": op10_url_filters,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_source_divergence": op12_source_divergence,
    "op13_spelling_variants": op13_spelling_variants,
}

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


#: A JSON value as text, numbers without trailing zeros.
_NUMBER = r"regexp_replace(CAST({} AS VARCHAR), '^(-?[0-9]+)(?:\.0+|(\.[0-9]*[1-9])0*)$', '\1\2')"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The letters U+00C0 to U+00FF, and ASCII characters that no lower-cased word has, as the edit distance counts bytes.
_WIDE, _NARROW = "".join(map(chr, range(0xC0, 0x100))), "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).islower() and chr(i) not in "'\\")[:64]
SQL: dict[str, str] = {
    "op3_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
dw AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) l WHERE len(w) >= m) y),
occ AS (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON bw.m = dw.m AND bw.win = dw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM occ) z GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ WHERE item IS NOT NULL) u GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
    # pairs of hosts may be formed here: the hosts of small tables are few
    "op10_url_filters": f"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS k, page_id, {_FOLDED.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, coalesce(html, '') AS html FROM pages),
rl(verdict, rule_host, rule_path) AS (VALUES {", ".join(map(str, URL_RULES))}),
fit AS (SELECT k, arg_min(rule_host || rule_path, (-length(rule_host || rule_path), rule_host || rule_path)) AS rule, arg_min(verdict, (-length(rule_host || rule_path), rule_host || rule_path)) AS told FROM p JOIN rl ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k),
sd AS (SELECT host, count(*) FILTER (told = 'allow') AS allowed, count(*) FILTER (told = 'block') AS blocked FROM p JOIN fit USING (k) GROUP BY host),
tot AS (SELECT sum(allowed) AS good, sum(blocked) AS bad FROM sd),
lk AS (SELECT src, dst, count(*) AS w FROM (SELECT host AS src, {_FOLDED.format("d")} AS dst FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{_quoted(LINK)}', 1))) AS d FROM p WHERE host <> '') a) b WHERE src <> dst GROUP BY src, dst),
mn AS (SELECT host, path, count(*) AS w FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{_quoted(MENU)}', 1))) AS path FROM p WHERE host <> '') a GROUP BY host, path),
pt AS (SELECT mn.*, s.whole FROM mn JOIN (SELECT path, sum(w) AS whole FROM mn GROUP BY path HAVING count(*) > 1) s USING (path)),
su AS (SELECT host, sum(a) AS ahead, sum(b) AS back FROM (SELECT src AS host, w AS a, 0 AS b FROM lk UNION ALL SELECT dst, 0, w FROM lk UNION ALL SELECT host, w, w FROM pt) x GROUP BY host),
mt AS (SELECT src, dst, sum(t) AS t, sum(d) AS d FROM (SELECT src, dst, CAST(w AS DOUBLE) / ahead AS t, 0 AS d FROM lk JOIN su ON su.host = src UNION ALL SELECT dst, src, 0, CAST(w AS DOUBLE) / back FROM lk JOIN su ON su.host = dst
  UNION ALL SELECT a.host, b.host, CAST(a.w AS DOUBLE) / ahead * b.w / a.whole, CAST(a.w AS DOUBLE) / back * b.w / a.whole FROM pt a JOIN pt b USING (path) JOIN su ON su.host = a.host) x GROUP BY src, dst),
base AS (SELECT host, allowed / (good + bad) AS t, blocked / (good + bad) AS d FROM sd, tot),
nodes AS (SELECT host FROM su UNION SELECT host FROM base),
ranks AS (SELECT 0 AS k, host, t, d FROM base
  UNION ALL SELECT k + 1, host, sum(t), sum(d) FROM (SELECT r.k, m.dst AS host, 0.85 * r.t * m.t AS t, 0.85 * r.d * m.d AS d FROM ranks r JOIN mt m ON m.src = r.host
    UNION ALL SELECT n.k, base.host, 0.15 * base.t, 0.15 * base.d FROM base, (SELECT DISTINCT k FROM ranks) n) x WHERE k < 30 GROUP BY k, host)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(told, CASE WHEN good > 0 AND bad > 0 AND r.d * good > 1.2 * bad * r.t THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN fit USING (k) LEFT JOIN (SELECT * FROM ranks WHERE k = 30) r ON r.host = p.host, tot""",
    "op2_chat_formatting": f"""
WITH RECURSIVE src AS (SELECT conv_id, turn AS t, 31 * conv_id + turn AS n, role, text FROM conversations),
m AS ({" UNION ALL ".join(f"SELECT conv_id, {t} AS turn, {r} AS role, {x} AS text FROM src WHERE {c}" for c, t, r, x in _tool_messages(_DUCK_STRING))}),
js AS (SELECT *, role = 'assistant' AND starts_with(text, '{{') AS calling, role = 'tool' AS told FROM m),
ca AS (SELECT conv_id, turn, place - 1 AS place, json_extract(text, '$.tool_calls[' || (place - 1) || ']') AS c FROM (SELECT *, unnest(range(1, json_array_length(text, '$.tool_calls')::BIGINT + 1)) AS place FROM js WHERE calling) x),
cl AS (SELECT conv_id, turn, place, json_extract_string(c, '$.id') AS call_id, json_extract_string(c, '$.name') AS name, json_extract(c, '$.arguments') AS args FROM ca),
fs AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, place) AS r FROM cl WHERE call_id IS NOT NULL),
fi AS (SELECT * FROM fs WHERE r = 1),
nd AS (SELECT DISTINCT a.conv_id, a.call_id, a.needed FROM (SELECT conv_id, call_id, unnest(regexp_extract_all(CAST(args AS VARCHAR), '"\\$([^"]+)"', 1)) AS needed FROM fi) a JOIN fi b ON b.conv_id = a.conv_id AND b.call_id = a.needed WHERE a.needed <> a.call_id),
dp AS (SELECT conv_id, call_id, 0 AS depth FROM fi UNION SELECT nd.conv_id, nd.call_id, depth + 1 FROM dp JOIN nd ON nd.conv_id = dp.conv_id AND nd.needed = dp.call_id),
dm AS (SELECT conv_id, call_id, max(depth) AS depth FROM dp GROUP BY ALL),
pr(tool, parameter, kind, required) AS (VALUES {", ".join(str((t, p, k, r)) for t, ps in TOOLS.items() for p, (k, r) in ps.items())}),
ck AS (SELECT cl.conv_id, cl.turn, cl.place, sum(CASE WHEN json_extract(args, '$.' || parameter) IS NULL THEN required::INT ELSE (CASE kind WHEN 'string' THEN json_type(args, '$.' || parameter) <> 'VARCHAR' WHEN 'integer' THEN json_type(args, '$.' || parameter) NOT LIKE '%BIGINT' ELSE json_type(args, '$.' || parameter) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') END)::INT END) AS wrong,
  count(json_extract(args, '$.' || parameter)) AS known FROM cl JOIN pr ON pr.tool = cl.name GROUP BY ALL),
er AS (SELECT cl.conv_id, cl.turn, cl.place, cl.call_id, fi.call_id IS NOT NULL AS is_first, CASE WHEN ck.turn IS NULL THEN 1 ELSE wrong + len(json_keys(cl.args)) - known END + (fi.call_id IS NULL)::INT AS errors FROM cl LEFT JOIN ck USING (conv_id, turn, place) LEFT JOIN fi ON fi.conv_id = cl.conv_id AND fi.turn = cl.turn AND fi.place = cl.place),
pm AS (SELECT er.conv_id, er.turn, CAST(sum(errors) AS BIGINT) AS n_errors, count(*) AS n_calls, coalesce(max(depth) FILTER (is_first), 0) AS deepest FROM er LEFT JOIN dm ON dm.conv_id = er.conv_id AND dm.call_id = er.call_id GROUP BY ALL),
ar AS (SELECT conv_id, turn, string_agg('{{"arguments":{{' || body || '}}' || CASE WHEN call_id IS NULL THEN '' ELSE ',"id":' || to_json(call_id) END || ',"name":' || to_json(name) || '}}', ',' ORDER BY place) AS listed FROM (SELECT conv_id, turn, place, call_id, name,
  (SELECT string_agg(to_json(k) || ':' || {_NUMBER.format("json_extract(args, '$.' || k)")}, ',' ORDER BY k) FROM (SELECT unnest(json_keys(args)) AS k) z) AS body FROM cl) y GROUP BY ALL),
rs AS (SELECT conv_id, turn, json_extract_string(text, '$.tool_call_id') AS call_id, CASE WHEN json_type(text, '$.content') = 'OBJECT' THEN '{{"at":' || {_NUMBER.format("json_extract(text, '$.content.at')")} || ',"z":' || json_extract(text, '$.content.z') || '}}' ELSE CAST(json_extract(text, '$.content') AS VARCHAR) END AS content FROM js WHERE told)
SELECT js.conv_id, js.turn, js.role, CASE WHEN calling THEN '{{"role":"assistant","tool_calls":[' || listed || ']}}' WHEN told THEN '{{"content":' || content || ',"role":"tool","tool_call_id":' || to_json(rs.call_id) || '}}' ELSE '{{"content":' || to_json(text) || ',"role":' || to_json(js.role) || '}}' END AS message,
  CASE WHEN calling THEN n_calls ELSE 0 END AS n_calls, CASE WHEN calling THEN n_errors WHEN told AND fi.turn IS NULL THEN 1 ELSE 0 END AS n_errors, CAST(CASE WHEN told THEN coalesce(dm.depth, 0) WHEN calling THEN deepest ELSE 0 END AS INT) AS depth,
  rs.call_id, CASE WHEN told THEN fi.turn IS NOT NULL END AS linked, coalesce(fi.turn, js.turn) AS order_turn, CAST(CASE WHEN fi.turn IS NULL THEN 0 ELSE coalesce(dm.depth, 0) END AS INT) AS order_depth, CAST(coalesce(1 + fi.place, 0) AS INT) AS order_step
FROM js LEFT JOIN pm USING (conv_id, turn) LEFT JOIN ar USING (conv_id, turn) LEFT JOIN rs USING (conv_id, turn) LEFT JOIN fi ON fi.conv_id = rs.conv_id AND fi.call_id = rs.call_id LEFT JOIN dm ON dm.conv_id = rs.conv_id AND dm.call_id = rs.call_id""",
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
ed AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
bo AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
re AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT bo.b, re.root FROM re JOIN bo ON bo.a = re.doc_id WHERE re.root < bo.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(root) AS root FROM re GROUP BY doc_id) r ON r.doc_id = d.doc_id""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) x),
rp AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) y WHERE c > 1) z GROUP BY doc_id),
sp AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM d),
ln AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, text, k, parts[k] AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM sp) x) y),
ls AS (SELECT doc_id, text, line, regexp_extract(line, '(?s)[^\x20\x09-\x0D](.*[^\x20\x09-\x0D])?', 0) AS body, len(lw) AS n, lw[-1] AS final, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS later FROM ln WHERE len(lw) > 0),
short AS (SELECT body, count(DISTINCT text) AS n FROM ls WHERE n <= {SHORT} GROUP BY body),
common AS (SELECT body FROM short WHERE n >= greatest({COMMON_LEAST}, {COMMON}::DOUBLE * (SELECT count(DISTINCT text) FROM ls WHERE n <= {SHORT}))),
nn AS (SELECT *, len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, len(regexp_replace(line, '[^|<>]', '', 'g')) AS bars, len(regexp_replace(line, '[^!]', '', 'g')) AS shouts, len(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper, len(regexp_replace(line, '[^a-z]', '', 'g')) AS lower FROM ls),
jd AS (SELECT doc_id, later, length(line) AS size, NOT (NOT regexp_matches(final, '[.!?:;"'')\]]$|[^\x00-\x7F]$') AND n >= 3 OR shouts * 4 > n AND shouts >= 2 OR symbols * 4 > n OR upper > 2 * lower AND upper >= 10
  OR bars >= 2 AND bars * 6 >= n OR n <= {SHORT} AND body IN (SELECT body FROM common) OR later AND n >= 3) AS stays FROM nn),
pl AS (SELECT doc_id, count(*) FILTER (later) AS dup, sum(size) AS whole, coalesce(sum(size) FILTER (stays), 0) AS stay FROM jd GROUP BY doc_id),
al AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(whole, 0) AS whole, coalesce(stay, 0) AS stay
  FROM d LEFT JOIN rp ON rp.doc_id = d.doc_id LEFT JOIN pl ON pl.doc_id = d.doc_id),
bs AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM al)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * stay >= {100 - MOST_LOST} * whole AS kept, CASE WHEN whole > 0 THEN CAST(stay AS DOUBLE) / whole ELSE 0 END AS share_left FROM bs""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k, regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, k, unnest(w) AS term FROM d),
kp AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
gr AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kp GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kp USING (lang, term) GROUP BY ALL),
tt AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT gr.lang, gr.source, kp.term, coalesce(c.n, 0) AS n, 1 + {PARTS} * (coalesce(c.n, 0) + {SMOOTH}) // (coalesce(tt.n, 0) + {SMOOTH} * v.v) AS p, 1 + {PARTS} * (kp.n + {SMOOTH}) // (v.n + {SMOOTH} * v.v) AS q
  FROM gr JOIN kp USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gr.lang AND c.source = gr.source AND c.term = kp.term LEFT JOIN tt ON tt.lang = gr.lang AND tt.source = gr.source),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
al AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pr.value, 0) AS BIGINT) AS value FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM al) WHERE part = 'pair' OR rank <= {TOP}""",
    # crc32 by its table; words meet by common deletions here
    "op13_spelling_variants": rf"""
WITH RECURSIVE cr AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
rn AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
ct AS (SELECT doc_id, r, count(*) AS n FROM rn WHERE length(r) >= {LEAST_LETTERS} GROUP BY ALL),
bt AS (SELECT r, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)) AS b FROM ct),
ha AS (SELECT r, n, xor(list_reduce(list_transform(list_prepend(4294967295, b), lambda x: CAST(x AS BIGINT)), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bt, cr),
wd AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM ha),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_WIDE}', '{_NARROW}') AS k FROM wd WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
dl AS (SELECT word, n, k, k AS s FROM w UNION SELECT word, n, k, left(k, i) || substr(k, i + 2) FROM (SELECT *, unnest(range(length(k))) AS i FROM w) x),
nr AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM dl a JOIN dl b ON a.s = b.s AND a.k <> b.k WHERE levenshtein(a.k, b.k) = 1),
fm AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM nr GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {DOMINATES} * n THEN form END AS form, CASE WHEN form_n >= {DOMINATES} * n THEN form_n END AS form_n FROM w LEFT JOIN fm ON fm.word = w.word),
rt AS (SELECT word, word AS at, form FROM f UNION ALL SELECT rt.word, f.word, f.form FROM rt JOIN f ON f.word = rt.form)
SELECT f.word, f.form, rt.at AS root, f.n, f.n_near, f.form_n FROM f JOIN rt ON rt.word = f.word AND rt.form IS NULL""",
}
