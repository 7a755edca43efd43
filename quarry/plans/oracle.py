"""DuckDB SQL for the rows of the queries in ``queries``."""

from __future__ import annotations

import hashlib
import json

from quarry.functions.fixed import DECLARED_VARIABLES, MANUAL_FIELDS, MAX_CATEGORIES, PROMPT_MARGIN, SIMILARITY, STOP_WORDS, TOP_LEVEL_CONCEPTS, TURTLE_HEADER, VARIABLES_PROMPT
from quarry.plans.queries import GAZETTEER, MODEL, MOJIBAKE, NEAR, OPTIONS, PROFILES, SHAPES, SYSTEM


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def one_of(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def rows(table) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in table)


STOP = one_of(STOP_WORDS)
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
BARE = r"regexp_replace(regexp_replace({0}, '^[\s\v]+', ''), '[\s\v]+$', '')"
NL, CR = "chr(10)", "chr(13)"

def cleaned(noisy: str) -> str:
    return rf"""
WITH n AS (SELECT doc_id, {noisy} AS t FROM documents),
h AS (SELECT doc_id, regexp_replace(replace(t, chr(173), ''), '-\n *([a-záéíóúüñ])', '\1', 'g') AS t FROM n),
w AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', {NL}, 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', {NL}, 'g'), '\n\n\n+', {NL} || {NL}, 'g') AS t FROM h)
SELECT doc_id, {BARE.format('t')} AS text FROM w"""


CLEAN = cleaned(f"replace(replace(replace(text, ' ', '  '), {NL}, ' ' || {CR} || {NL} || {CR} || {NL} || ' ' || {CR} || {NL}), 'ation', 'a-' || {NL} || 'tion')")
SOFT = cleaned("replace(replace(text, 'a', 'a' || chr(173)), ' ', ' ' || chr(9))")


def mojibake() -> str:
    noisy = "text"
    for good, bad in MOJIBAKE.items():
        noisy = f"replace({noisy}, {quoted(good)}, {quoted(bad)})"
    other = f"regexp_matches(text, '[^\\x00-\\x7F{''.join(MOJIBAKE)}]')"
    return f"SELECT doc_id, CASE WHEN {other} THEN {noisy} ELSE text END AS text FROM documents"


TAGGED = f"""t AS (SELECT doc_id, source, lang, {WORDS.format('text')} AS w FROM documents),
e AS (SELECT *, list_filter(list_transform(w, lambda x: CASE lower(x) {' '.join(f"WHEN {quoted(k)} THEN {v[1]}::DOUBLE" for k, v in GAZETTEER.items() if v[1] >= 0.1)} END), lambda x: x IS NOT NULL) AS s FROM t),
f AS (SELECT *, CASE WHEN len(s) > 0 THEN list_sum(s) / len(s) ELSE 0 END AS score, CASE WHEN len(w) > 0 THEN len(s) / len(w) ELSE 0 END AS density FROM e)"""

SPLIT = rf"""p AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)"""

_JUNK = r"""
WITH t AS (SELECT DISTINCT unnest({words}) AS term FROM documents UNION VALUES {shapes}),
b AS (SELECT term, {bare} AS b FROM t),
n AS (SELECT *, lower(b) AS l FROM b),
f AS (SELECT term, regexp_replace(l, '\s+', ' ', 'g') AS normal, regexp_matches(b, '^[^\p{{L}}\p{{N}}]*$') AS punctuation, contains(b, '___') OR regexp_matches(b, '^_+$') AS anonymised,
  regexp_matches(l, '^[a-z]+$') AND l IN {stop} AS stop_word, regexp_matches(b, '^\p{{Nd}}+$') AS digits,
  regexp_matches(l, '^[a-z]{{2,10}}-\p{{Nd}}+\.?\p{{Nd}}*$') OR regexp_matches(l, '^[a-z]{{1,6}}-[a-z]{{1,6}}-\p{{Nd}}+\.?\p{{Nd}}*$') AS lab_value, l IN ('of', 'und') AS blacklisted FROM n)
"""
JUNK = _JUNK.format(words=WORDS.format("text"), shapes=", ".join(f"({quoted(s)})" for s in SHAPES), bare=BARE.format("term"), stop=STOP)
IS_JUNK = "punctuation OR anonymised OR stop_word OR digits OR blacklisted OR lab_value"


def _is_junk(x: str) -> str:
    """Junk tests of a normal form, without a blacklist."""
    return (
        rf"(regexp_matches({x}, '^[^\p{{L}}\p{{N}}]*$') OR contains({x}, '___') OR (regexp_matches({x}, '^[a-z]+$') AND {x} IN {STOP}) OR regexp_matches({x}, '^\p{{Nd}}+$')"
        rf" OR regexp_matches({x}, '^[a-z]{{2,10}}-\p{{Nd}}+\.?\p{{Nd}}*$') OR regexp_matches({x}, '^[a-z]{{1,6}}-[a-z]{{1,6}}-\p{{Nd}}+\.?\p{{Nd}}*$'))"
    )


def _truncated(words: str, n: int) -> str:
    return rf"CASE WHEN len({words}) <= {n} THEN array_to_string({words}, ' ') ELSE regexp_replace(array_to_string({words}[1:{n}], ' '), '[,;:]+$', '') || '.' END"


# What the parser should find in the answers that are made of documents: kinds 3 (a list), 4 (broken), 5 (no id) and 6 (unknown category) give nothing;
# kind 4 is read on the second try, since it only has a brace too many at its end.
CONCEPTS = rf"""{SPLIT},
a AS (SELECT doc_id, doc_id % 8 AS kind, w, ' id' || doc_id AS item, coalesce(w[1], '') AS w1, array_to_string(w[1:30], ' ') AS ev,
  array_to_string(list_filter([w[1], array_to_string(list_filter([w[2], w[3]], lambda x: x IS NOT NULL), '_'), '12'], lambda x: x IS NOT NULL), ', ') AS whole FROM p),
g AS (SELECT *, lower(replace(whole, '_', ' ')) AS nwhole, lower(replace(w1, '_', ' ')) AS target, {_truncated(WORDS.format('ev'), 25)} AS evidence FROM a WHERE kind NOT IN (3, 4, 5, 6) AND len(w) > 0),
s AS (SELECT *, list_filter(['low mood', 'low mood', lower(replace(coalesce(w[4], ''), '_', ' '))], lambda x: x <> '' AND x <> nwhole AND NOT {_is_junk('x')}) AS syn FROM g),
x AS (SELECT *, unnest(string_split(whole, ',')) AS part, generate_subscripts(string_split(whole, ','), 1) - 1 AS place FROM s),
y AS (SELECT *, regexp_replace(lower({BARE.format("replace(part, '_', ' ')")}), '\s+', ' ', 'g') AS concept, kind = 7 AND NOT {_is_junk('target')} AS rel FROM x),
c AS (SELECT doc_id, place::INTEGER AS place, trim(item) AS item_id, concept, 'finding' AS category, CASE WHEN rel AND target <> concept THEN 'is_a' ELSE '' END AS predicate,
  CASE WHEN rel AND target <> concept THEN target ELSE '' END AS target, evidence,
  array_to_string(CASE WHEN len(syn) > 1 AND syn[1] = syn[2] THEN list_filter(syn, lambda z, i: i = 1 OR (i > 2 AND z <> syn[1])) ELSE syn END, '; ') AS synonyms FROM y WHERE concept <> '' AND NOT {_is_junk('concept')})"""

TREE = """r AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
tree AS (SELECT a.vec_id AS code, b.vec_id AS parent, a.v FROM r a LEFT JOIN r b ON a.label = b.label AND b.rn = a.rn // 2 AND a.rn > 1)"""

DESCENT = f"""WITH RECURSIVE {TREE},
d AS (SELECT q.vec_id AS key, t.parent, t.code, list_dot_product(q.v, t.v) AS score FROM r q, tree t),
best AS (SELECT key, parent, arg_max(code, struct_pack(s := score, p := -code)) AS code, max(score) AS score FROM d GROUP BY key, parent),
walk AS (SELECT key, code, score, 0 AS steps FROM best WHERE parent IS NULL
  UNION ALL SELECT w.key, b.code, b.score, w.steps + 1 FROM walk w JOIN best b ON b.key = w.key AND b.parent = w.code AND b.score > w.score)
SELECT key AS vec_id, arg_max(code, steps) AS code, round(arg_max(score, steps), 6) AS score, max(steps)::INTEGER AS steps, arg_max(score, steps) >= 0.3 AS accepted FROM walk GROUP BY key"""

GREEDY = f"""WITH RECURSIVE r AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
k AS (SELECT DISTINCT label, 0::BIGINT AS rn, []::DOUBLE[][] AS kept, NULL::BIGINT AS last FROM embeddings
  UNION ALL SELECT r.label, r.rn, CASE WHEN len(list_filter(k.kept, lambda x: list_dot_product(x, r.v) > {NEAR})) = 0 THEN list_append(k.kept, r.v) ELSE k.kept END,
    CASE WHEN len(list_filter(k.kept, lambda x: list_dot_product(x, r.v) > {NEAR})) = 0 THEN r.vec_id END
  FROM k JOIN r ON r.label = k.label AND r.rn = k.rn + 1)
SELECT last AS vec_id, label FROM k WHERE last IS NOT NULL"""

VERIFIED = f"""WITH RECURSIVE {DESCENT.removeprefix('WITH RECURSIVE ').replace('SELECT key AS vec_id', ', descent AS (SELECT key AS vec_id', 1)}),
n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
v AS (SELECT p_partkey, p_size, CASE WHEN lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size <= 10) THEN 1 ELSE 0 END AS found FROM part),
t AS (SELECT v.*, CASE WHEN found = 1 THEN 'n/a' WHEN accepted THEN '1' ELSE '0' END AS semantic FROM v CROSS JOIN n LEFT JOIN descent ON vec_id = p_partkey % n.n)"""

ITEMS = """i AS (SELECT 'q' || conv_id AS questionnaire, conv_id || '-' || turn AS item_id, text AS question, 'open' AS response_type, '0-3' AS scale,
  'Questionnaire: q' || conv_id || chr(10) || 'Item ID: ' || conv_id || '-' || turn || chr(10) || 'Item text: "' || text || '"' || chr(10) || 'Response type: open' || chr(10) || 'Response scale: 0-3' AS prompt
  FROM conversations)"""

SIGNATURE = hashlib.sha256((SYSTEM + MODEL + json.dumps(OPTIONS, sort_keys=True)).encode()).hexdigest()

ALIGNED = r"""a AS (SELECT p_partkey AS seq, p_brand AS variable, p_name || ' "x" \ ' || chr(10) AS normalized_concept, p_type AS semantic_category, ['is a', '', NULL][p_size % 3 + 1] AS relation,
  'size ' || p_size AS evidence, ['label', '', NULL, ''][p_size % 4 + 1] AS preferred_label, ['http://example.org/1', ''][p_size % 2 + 1] AS identifier_uri,
  ['Exact', 'Broader', 'Narrower', 'No Match', NULL][p_size % 5 + 1] AS match, ['Correct', 'Incorrect', NULL, 'Correct', 'Odd'][p_size % 5 + 1] AS validation_status FROM part)"""

TRIPLES = ALIGNED + r""",
m AS (SELECT *, 'proj:' || regexp_replace(normalized_concept, '[^A-Za-z0-9]', '', 'g') AS s, '"' || replace(replace(replace(normalized_concept, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' AS name,
  coalesce(relation, '') <> '' AS has_relation, CASE match WHEN 'Exact' THEN 'skos:exactMatch' WHEN 'Broader' THEN 'skos:broadMatch' WHEN 'Narrower' THEN 'skos:narrowMatch' END AS mapped FROM a WHERE validation_status = 'Correct'),
u AS (SELECT seq, 0 AS k, 0 AS block, s, 'rdfs:subClassOf' AS p, 'proj:' || regexp_replace(semantic_category, '[^A-Za-z0-9]', '', 'g') AS o FROM m
  UNION ALL SELECT seq, 1, 0, s, 'rdfs:label', name FROM m
  UNION ALL SELECT seq, 2, 0, s, 'rdfs:comment', '"' || evidence || '"' FROM m WHERE has_relation
  UNION ALL SELECT seq, 3, 0, s, 'proj:' || replace(relation, ' ', ''), 'proj:' || regexp_replace(variable, '[^A-Za-z0-9]', '', 'g') FROM m WHERE has_relation
  UNION ALL SELECT seq, 4, 1, s, mapped, '<' || identifier_uri || '>' FROM m WHERE mapped IS NOT NULL AND identifier_uri <> ''
  UNION ALL SELECT seq, 5, 2, '<' || identifier_uri || '>', 'rdfs:label', '"' || preferred_label || '"' FROM m WHERE mapped IS NOT NULL AND identifier_uri <> '' AND coalesce(preferred_label, '') <> ''),
t AS (SELECT *, (row_number() OVER (PARTITION BY seq ORDER BY k) - 1)::INTEGER AS place FROM u)"""


def profile(name: str, columns: list[tuple[str, bool]], order: list[str]) -> str:
    """``columns``: (name, whether numeric) in order."""
    parts = []
    for i, (c, numeric) in enumerate(columns):
        decimal = f"coalesce(bool_or({c} % 1 <> 0), false)" if numeric else "false"
        parts.append(
            f"SELECT {i}::INTEGER AS pos, '{c}' AS name, {'true' if numeric else 'false'} AS numeric, count(DISTINCT {c}) AS n, count(*) AS total, {decimal} AS dec,"
            f" arg_min({c}::VARCHAR, ({', '.join(order)})) FILTER ({c} IS NOT NULL) AS example, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high,"
            f" CASE WHEN count(DISTINCT {c}) <= {MAX_CATEGORIES} THEN array_to_string(list_transform(list_sort(list(DISTINCT {c})), lambda x: x::VARCHAR), '|') END AS listed FROM {name}"
        )
    return f"""WITH f AS ({' UNION ALL '.join(parts)}),
k AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n = total AND NOT dec THEN 'identifier' WHEN n = 2 AND numeric THEN 'binary numeric' WHEN n = 2 THEN 'binary text'
  WHEN dec THEN 'decimal' WHEN numeric THEN 'integer' WHEN n <= {MAX_CATEGORIES} THEN 'categorical text' ELSE 'free text' END AS type FROM f),
v AS (SELECT *, CASE WHEN n > 0 AND n <= {MAX_CATEGORIES} AND type <> 'identifier' THEN listed END AS "values" FROM k)
SELECT pos, name, type, example, n AS n_distinct, "values", CASE WHEN "values" IS NULL AND type IN ('integer', 'decimal') THEN 'any value between ' || low || ' and ' || high END AS range FROM v"""


COLUMNS = {
    "customer": [("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0)],
    "part": [("p_partkey", 1), ("p_name", 0), ("p_brand", 0), ("p_type", 0), ("p_size", 1), ("p_retailprice", 1)],
    "lineitem": [("l_orderkey", 1), ("l_partkey", 1), ("l_suppkey", 1), ("l_linenumber", 1), ("l_quantity", 1), ("l_extendedprice", 1), ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 0), ("l_linestatus", 0), ("l_shipdate", 0)],
    "nation": [("n_nationkey", 1), ("n_name", 0), ("n_regionkey", 1)],
    "events": [("event_id", 1), ("ts", 0), ("user_id", 1), ("event_type", 0), ("value", 1), ("props", 0)],
}


def _enrich() -> str:
    declared = rows([v for v in DECLARED_VARIABLES])
    manual = ", ".join(f"{quoted(v)} AS {k if k != 'match' else chr(34) + k + chr(34)}" for k, v in MANUAL_FIELDS.items())
    return f"""WITH d(name, type, example, description) AS ({declared}), r(variable, normalized_concept) AS (VALUES ('Age', 'age'), ('BMI', 'body mass index'), ('Unknown', 'x'))
SELECT variable, normalized_concept, 'type: ' || coalesce(type, '?') || ' | example: ' || coalesce(example, '?') || ' | description: ' || coalesce(description, '?') AS evidence, {manual} FROM r LEFT JOIN d ON name = variable"""


def _prompt() -> str:
    lines = "\n".join(f"- {n} | type: {t} | example: {e} | description: {d}" for n, t, e, d in DECLARED_VARIABLES)
    prompt = VARIABLES_PROMPT.format(n=len(DECLARED_VARIABLES), variables=lines)
    return f"SELECT {quoted(prompt)} AS prompt, {quoted(hashlib.sha1(prompt.encode()).hexdigest()[:8])} AS prompt_id"


def _vector(text: str) -> str:
    """The unit vector of a text's trigrams: each adds or takes one at a place that its code points give."""
    padded = f"(' ' || replace({text}, '_', ' ') || ' ')"
    codes = f"list_append(list_transform(string_split({padded}, ''), lambda c: unicode(c)), 0)"
    hashes = f"list_transform(range(1, length({padded})), lambda i: ({codes})[i] * 961 + ({codes})[i + 1] * 31 + ({codes})[i + 2])"
    sums = f"list_transform(range(0, 64), lambda b: coalesce(list_sum(list_transform(list_filter({hashes}, lambda h: h % 64 = b), lambda h: CASE WHEN (h // 64) % 2 = 1 THEN 1 ELSE -1 END)), 0)::DOUBLE)"
    return f"list_transform([{sums}], lambda s: list_transform(s, lambda x: x / CASE WHEN list_dot_product(s, s) > 0 THEN sqrt(list_dot_product(s, s)) ELSE 1 END))[1]"


# Texts that pass the filter, the two longest words of each as concepts, once a source, and none that is near an earlier one.
TEXT_TRACK = rf"""WITH RECURSIVE {TAGGED},
k AS (SELECT f.source, f.doc_id AS doc, CASE WHEN len(w) <= {3000 - PROMPT_MARGIN} THEN text ELSE array_to_string(w[1:{3000 - PROMPT_MARGIN}], ' ') END AS text
  FROM f JOIN documents USING (doc_id) WHERE score >= 0.15 AND density >= 0.05),
l AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(text, '\p{{L}}{{4,}}')), lambda x: struct_pack(n := -length(x), w := x)))[1:2], lambda x: x.w) AS longest FROM k),
c AS (SELECT source, doc, place::INTEGER AS place, lower(longest[place + 1]) AS concept, 'finding' AS category, {_truncated(WORDS.format('substr(text, 1, 200)'), 25)} AS evidence
  FROM (SELECT *, unnest(range(0, len(longest))) AS place FROM l)),
o AS (SELECT *, row_number() OVER (PARTITION BY source, concept ORDER BY doc, place) AS again FROM c WHERE NOT {_is_junk('concept')}),
r AS (SELECT *, {{vector}} AS v, row_number() OVER (PARTITION BY source ORDER BY doc, place) AS rn FROM o WHERE again = 1),
g AS (SELECT DISTINCT source, 0::BIGINT AS rn, []::DOUBLE[][] AS kept, NULL::BIGINT AS doc, NULL::INTEGER AS place FROM r
  UNION ALL SELECT r.source, r.rn, CASE WHEN len(list_filter(g.kept, lambda x: list_dot_product(x, r.v) > {SIMILARITY})) = 0 THEN list_append(g.kept, r.v) ELSE g.kept END,
    CASE WHEN len(list_filter(g.kept, lambda x: list_dot_product(x, r.v) > {SIMILARITY})) = 0 THEN r.doc END, r.place
  FROM g JOIN r ON r.source IS NOT DISTINCT FROM g.source AND r.rn = g.rn + 1)
SELECT r.source, r.doc, r.place, r.concept, r.category, r.evidence FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source AND g.rn = r.rn WHERE g.doc IS NOT NULL""".replace("{vector}", _vector("concept"))


# The two longest words of the prompts of items without a cached answer; the second goes if it equals or is near the first.
QUESTIONNAIRE_TRACK = rf"""WITH {ITEMS},
l AS (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(prompt, '\p{{L}}{{4,}}')), lambda x: struct_pack(n := -length(x), w := x)))[1:2], lambda x: x.w) AS longest
  FROM i WHERE length(question) % 3 <> 2),
c AS (SELECT item_id, place, lower(longest[place + 1]) AS concept FROM (SELECT *, unnest(range(0, len(longest))) AS place FROM l)),
v AS (SELECT *, {{vector}} AS v FROM c WHERE NOT {_is_junk('concept')})
SELECT item_id, concept, 'finding' AS category FROM v
WHERE NOT EXISTS (SELECT 1 FROM v AS a WHERE a.item_id = v.item_id AND a.place < v.place AND (a.concept = v.concept OR list_dot_product(a.v, v.v) > {SIMILARITY}))""".replace("{vector}", _vector("concept"))


# Token vectors of part names, pooled over the tokens that count.
POOLED = """WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
c AS (SELECT p_partkey, i, length(w)::DOUBLE AS x, ascii(w)::DOUBLE AS y, i::DOUBLE AS z FROM t WHERE (i - 1) % 3 <> 0),
p AS (SELECT p_partkey, 'mean' AS pooling, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c GROUP BY p_partkey UNION ALL SELECT p_partkey, 'first', arg_min(x, i), arg_min(y, i), arg_min(z, i) FROM c GROUP BY p_partkey),
n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM p),
k AS (SELECT p_partkey, pooling FROM part, (VALUES ('mean'), ('first')) AS v(pooling))
SELECT p_partkey, pooling, round(x / n, 6) AS x, round(y / n, 6) AS y, round(z / n, 6) AS z FROM k LEFT JOIN n USING (p_partkey, pooling)"""

# One scan of all vectors in order; a row goes if it is near an earlier one that stays.
GREEDY_ALL = f"""WITH RECURSIVE n AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
near AS (SELECT b.i, list(a.i) AS earlier FROM n a JOIN n b ON a.i < b.i AND list_dot_product(a.v, b.v) > {NEAR} GROUP BY b.i),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
  UNION ALL SELECT s.i + 1, CASE WHEN list_has_any(coalesce(near.earlier, []), s.kept) THEN s.kept ELSE list_append(s.kept, s.i + 1) END FROM s LEFT JOIN near ON near.i = s.i + 1 WHERE s.i < (SELECT count(*) FROM n))
SELECT vec_id FROM n WHERE list_contains((SELECT arg_max(kept, i) FROM s), i)"""

BALLS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_concat(embedding[2:64], embedding[1:1])::DOUBLE[] AS t FROM embeddings),
d AS (SELECT q.vec_id, c.vec_id AS code, list_dot_product(q.t, c.v) AS score FROM v q, v c)
SELECT vec_id, arg_max(code, struct_pack(s := score, p := -(code % 10), c := code)) AS code, round(max(score), 6) AS score FROM d GROUP BY vec_id"""

LOOKUPS = "SELECT p_partkey, (length(p_name) % 8 >= 6)::INTEGER AS found, ['throttled', 'refused', 'unreachable', 'unreadable', 'absent', 'absent', 'found', 'found'][length(p_name) % 8 + 1] AS lookup_status FROM part"


VARIABLES = f"v AS (SELECT pos, name, type, example, coalesce(range, replace(values, '|', ', '), 'any') AS description FROM ({profile('customer', COLUMNS['customer'], PROFILES['customer'])}))"


def _table_prompt() -> str:
    lines = "string_agg('- ' || name || ' | type: ' || type || ' | example: ' || example || ' | description: ' || description, chr(10) ORDER BY pos)"
    prompt = f"(SELECT replace(replace({quoted(VARIABLES_PROMPT)}, '{{n}}', count(*)::VARCHAR), '{{variables}}', {lines}) FROM v)"
    return f"WITH {VARIABLES}, p AS (SELECT {prompt} AS prompt) SELECT prompt, sha1(prompt)[1:8] AS prompt_id FROM p"


# Part names that aren't those of small parts go down the hierarchy by the vector of their trigrams.
VERIFICATION = f"""WITH RECURSIVE {TREE},
q AS (SELECT p_partkey AS key, {_vector("upper(replace(p_name, ' ', '_'))")} AS v FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size <= 10)),
d AS (SELECT q.key, t.parent, t.code, list_dot_product(q.v, t.v) AS score FROM q, tree t),
best AS (SELECT key, parent, arg_max(code, struct_pack(s := score, p := -code)) AS code, max(score) AS score FROM d GROUP BY key, parent),
walk AS (SELECT key, code, score, 0 AS steps FROM best WHERE parent IS NULL
  UNION ALL SELECT w.key, b.code, b.score, w.steps + 1 FROM walk w JOIN best b ON b.key = w.key AND b.parent = w.code AND b.score > w.score),
s AS (SELECT key, arg_max(score, steps) >= 0.3 AS accepted FROM walk GROUP BY key)
SELECT p_partkey, (key IS NULL)::INTEGER AS found, CASE WHEN key IS NULL THEN 'n/a' WHEN accepted THEN '1' ELSE '0' END AS semantic FROM part LEFT JOIN s ON key = p_partkey"""


def oracle_sql() -> dict[str, str]:
    words = WORDS.format("text")
    concept_columns = "item_id, concept, category, predicate, target, evidence, synonyms"
    return {
        "clean_text": CLEAN,
        "clean_soft_hyphens": SOFT,
        "corpus_stream": f"SELECT doc_id, text, len({words}) AS n_words FROM ({SOFT})",
        "concept_terms": f"WITH {CONCEPTS} SELECT concept AS term FROM c WHERE target <> '' UNION SELECT target FROM c WHERE target <> ''",
        "pooled_tokens": POOLED,
        "input_report": " UNION ALL ".join(f"SELECT '{n}' AS name, true AS found, (SELECT count(*) FROM {n}) AS n_rows" for n in [*PROFILES, "documents", "benchmark"]) + " UNION ALL SELECT 'lost', false, NULL",
        "nfc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
        "mojibake": mojibake(),
        "word_counts": f"WITH {SPLIT} SELECT doc_id, len(w)::INTEGER AS n_words, len(list_filter(w, lambda x: lower(x) NOT IN {STOP}))::INTEGER AS n_content_words FROM p",
        "semantic_filter": f"WITH {TAGGED} SELECT doc_id, round(score, 9) AS score, round(density, 9) AS density, score >= 0.15 AND density >= 0.05 AS keep FROM f",
        "density_by_source": f"WITH {TAGGED} SELECT source, lang, count(*) AS n_texts, round(avg(density), 6) AS mean_density FROM f WHERE score >= 0.15 AND density >= 0.05 GROUP BY source, lang",
        "limit_then_filter": f"SELECT text FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500) WHERE len({words}) > 100",
        "junk_flags": f"{JUNK} SELECT *, {IS_JUNK} AS junk FROM f",
        "truncate_words": f"WITH p AS (SELECT doc_id, text, {words} AS w FROM documents) SELECT doc_id, {_truncated('w', 25)} AS evidence, CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(w[1:200], ' ') END AS fitted FROM p",
        "concept_parse": f"WITH {CONCEPTS} SELECT doc_id, place, {concept_columns} FROM c",
        "concept_csv": f"WITH {CONCEPTS} SELECT item_id, concept AS concept_proposed, category, CASE WHEN predicate <> '' THEN predicate || ' -> ' || target ELSE '' END AS relation, evidence, synonyms FROM c",
        "answers_without_concept": f"WITH {CONCEPTS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)",
        "exact_dedup_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang",
        "greedy_near_dup": GREEDY,
        "greedy_near_dup_native": GREEDY,
        "nearest_root": f"WITH {TREE}, d AS (SELECT q.vec_id, t.code, list_dot_product(q.v, t.v) AS score FROM r q, tree t WHERE t.parent IS NULL) SELECT vec_id, arg_max(code, struct_pack(s := score, p := -code)) AS code, round(max(score), 6) AS score FROM d GROUP BY vec_id",
        "hierarchical_descent": DESCENT,
        "hierarchy_children": f"WITH {TREE} SELECT parent AS parent_code, min(code) AS code FROM tree WHERE parent IS NOT NULL GROUP BY parent",
        "hierarchy_descendants": f"WITH RECURSIVE {TREE}, d AS (SELECT parent AS ancestor, code, 1 AS depth FROM tree WHERE parent IS NOT NULL UNION ALL SELECT d.ancestor, t.code, d.depth + 1 FROM d JOIN tree t ON t.parent = d.code) SELECT * FROM d",
        "nearest_descendants": f"""WITH RECURSIVE {TREE}, d AS (SELECT parent AS ancestor, code, 1 AS depth FROM tree WHERE parent IS NOT NULL UNION ALL SELECT d.ancestor, t.code, d.depth + 1 FROM d JOIN tree t ON t.parent = d.code)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ancestor ORDER BY depth, code) <= 5""",
        "nearest_in_balls": BALLS,
        "greedy_near_dup_cells": GREEDY_ALL,
        "rejected_answers": f"WITH {CONCEPTS} SELECT 'documents' AS step, (SELECT count(*) FROM documents) AS n_answers, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)) AS n_rejected",
        "lookup_statuses": LOOKUPS,
        "memo_answers": f"WITH {ITEMS} SELECT item_id AS key, CASE WHEN length(question) % 2 = 0 THEN 'first ' ELSE 'second ' END || length(question) AS answer FROM i",
        "verification_csv": f"{VERIFIED} SELECT 'part' AS dataset, t.p_partkey::VARCHAR AS item_id, upper(replace(p_name, ' ', '_')) AS concept, found::VARCHAR AS found, semantic FROM t JOIN part USING (p_partkey)",
        "lexical_match": f"{VERIFIED} SELECT p_partkey, found::INTEGER AS found FROM t",
        "verify_tristate": f"{VERIFIED} SELECT p_partkey, found::INTEGER AS found, semantic FROM t",
        "verify_summary": f"{VERIFIED} SELECT count(*) AS total, count(*) FILTER (found = 1) AS found, count(*) FILTER (found = 1 OR semantic = '1') AS found_or_accepted FROM t",
        "dataset_ids": " UNION ALL ".join(f"SELECT '{n}' AS name, sha1((SELECT string_agg(column_name, ',') FROM (DESCRIBE {n})))[1:8] AS dataset_id" for n in PROFILES),
        "questionnaire_flatten": f"WITH {ITEMS} SELECT questionnaire, item_id, question, response_type, scale FROM i",
        "item_prompts": f"WITH {ITEMS} SELECT item_id, prompt, '{SIGNATURE}' AS signature FROM i",
        "chat_prompts": """SELECT item_id, '[{"role":"system","content":"sys"},{"role":"user","content":' || to_json('Read: ' || text || '.')::VARCHAR || '}]' AS prompt FROM benchmark""",
        "verification_jobs": f"SELECT 'set' || item_id AS dataset, item_id::VARCHAR AS item_id, ({words})[1] AS concept FROM benchmark UNION ALL SELECT 'default', item_id::VARCHAR, ({words})[1] FROM benchmark",
        "cache_hits": f"WITH {ITEMS} SELECT item_id, CASE WHEN length(question) % 3 = 2 THEN 'r' || item_id ELSE '' END AS raw, length(question) % 3 = 2 AS hit FROM i",
        "cache_misses": f"WITH {ITEMS} SELECT item_id FROM i WHERE length(question) % 3 <> 2",
        "triples": f"WITH {TRIPLES} SELECT seq, place, s, p, o FROM t",
        "turtle_blocks": f"WITH {TRIPLES} SELECT seq, block, string_agg(CASE WHEN k IN (0, 4, 5) THEN s || ' ' || p || ' ' || o ELSE '    ' || p || ' ' || o END, ' ;' || chr(10) ORDER BY k) || ' .' AS text FROM t GROUP BY seq, block",
        "status_histogram": f"WITH {ALIGNED} SELECT status, sum(n)::BIGINT AS n FROM (SELECT coalesce(validation_status, 'Uncertain') AS status, 1 AS n FROM a UNION ALL SELECT * FROM (VALUES ('Correct', 0), ('Incorrect', 0), ('Uncertain', 0))) GROUP BY status",
        "enrich": _enrich(),
        "variables_prompt": _prompt(),
        "table_prompt": _table_prompt(),
        "tabular_track": f"WITH {VARIABLES} SELECT name AS variable, lower(name) AS normalized_concept, 'Finding' AS semantic_category, 'is a' AS relation, "
        "'type: ' || type || ' | example: ' || example || ' | description: ' || description AS evidence, 'Uncertain' AS validation_status FROM v",
        "verification_track": VERIFICATION,
        "terminology_roots": "SELECT * FROM (" + rows([(c, d, i) for i, (c, d) in enumerate(TOP_LEVEL_CONCEPTS)]) + ") AS t(code, display, pos)",
        "group_result": f"WITH {CONCEPTS} SELECT doc_id AS source, string_agg(concept, '|' ORDER BY place) AS members, string_agg(item_id, '|' ORDER BY place) AS items FROM c GROUP BY doc_id",
        "text_files": "SELECT 'item-' || item_id || '.txt' AS source, text FROM benchmark",
        "csv_file": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "turtle_file": f"WITH {TRIPLES}, b AS (SELECT string_agg(CASE WHEN k IN (0, 4, 5) THEN s || ' ' || p || ' ' || o ELSE '    ' || p || ' ' || o END, ' ;' || chr(10) ORDER BY k) || ' .' AS text FROM t GROUP BY seq, block UNION ALL SELECT {quoted(TURTLE_HEADER)})"
        " SELECT * FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM b) WHERE line <> ''",
        "results_file": f"WITH {ALIGNED} SELECT 'the prompt' AS prompt, seq, variable, relation, match FROM a",
        "profile_file": f"SELECT 'nation.parquet' AS dataset, sha1((SELECT string_agg(column_name, ',') FROM (DESCRIBE nation)))[1:8] AS dataset_id, name, type, n_distinct FROM ({profile('nation', COLUMNS['nation'], PROFILES['nation'])})",
        "triple_counts": f"WITH {TRIPLES} SELECT p, count(*) AS n FROM t GROUP BY p",
        "subjects_and_objects": "SELECT n_name AS term FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "embedded_terms": f"""WITH e AS (SELECT p_partkey, {_vector('p_name')} AS v FROM part)
            SELECT p_partkey, len(v)::INTEGER AS size, round(list_dot_product(v, v), 6) AS norm, round(list_dot_product(v, range(1, 65)::DOUBLE[]), 6) + 0.0 AS moment FROM e""",
        "text_track": TEXT_TRACK,
        "questionnaire_track": QUESTIONNAIRE_TRACK,
        "text_stream": f"SELECT doc_id, text, len({words}) AS n_words FROM documents",
        **{f"profile_{n}": profile(n, COLUMNS[n], o) for n, o in PROFILES.items()},
    }


