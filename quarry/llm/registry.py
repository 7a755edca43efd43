"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from quarry.llm import bpe, pii, secrets
from quarry.llm.common import new_path, read
from quarry.llm.decontaminate import SLOP, WINDOW, decontaminate
from quarry.llm.importance import importance
from quarry.llm.licenses import license_scan
from quarry.llm.line_dedup import MIN_SITES, line_dedup
from quarry.llm.mixing import mix
from quarry.llm.quality_rules import BASE_LEAST_WORDS, BASE_REPEAT_PERCENT, RULES, STOP_WORDS, quality_rules
from quarry.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED, resample
from quarry.llm.runs import periodic_runs
from quarry.llm.simhash import fingerprint_hex, near_duplicates
from quarry.llm.tokens import read_tokens, write_tokens


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_licenses(spark, sf_dir):
    """Documents as files in the folders of their source and language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return license_scan(read(spark, sf_dir, "documents"), path)


def op2_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"))


def op3_importance(spark, sf_dir):
    return importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup(read(spark, sf_dir, "documents"))


LINE_DEDUP_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS filled FROM l),
s AS (SELECT line FROM m WHERE filled GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES})
SELECT doc_id, count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE s.line IS NOT NULL) AS n_removed,
       coalesce(string_agg(m.line, chr(10) ORDER BY i) FILTER (WHERE s.line IS NULL), '') AS text
FROM m LEFT JOIN s USING (line) GROUP BY doc_id"""


def op5_decontamination(spark, sf_dir):
    rows = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def _ascii_words(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ascii_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_ascii_words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + {WINDOW - 1}] AS k FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 2}) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(k) AS n FROM win),
dw AS (SELECT rid, n, i, w[i:i + n - 1] AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN win USING (k)),
place AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
item AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY rid),
phrase AS (SELECT k, k[1] AS first FROM (SELECT DISTINCT k FROM win)),
token AS (SELECT rid, p, w[p] AS first, w[greatest(1, p - 2 * {SLOP}):p + {WINDOW} - 1 + 2 * {SLOP}] AS c, least(p, 2 * {SLOP} + 1) AS o
          FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE w[p] IN (SELECT first FROM phrase)),
begun AS MATERIALIZED (SELECT rid, c, k, o FROM token JOIN phrase USING (first) WHERE list_contains(c, k[-1]) AND list_contains(c, k[(len(k) + 1) // 2])),
near AS (SELECT DISTINCT rid, k FROM (SELECT rid, c, k, unnest(range(o - {SLOP}, o + {SLOP} + 1)) AS s FROM begun)
         WHERE len(list_filter(range(0, len(k)), lambda j: NOT list_contains(c[greatest(1, s + j - {SLOP}):greatest(0, s + j + {SLOP})], k[j + 1]))) = 0),
near_item AS (SELECT rid, count(DISTINCT item_id) AS n FROM near JOIN win USING (k) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(near_item.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN place USING (rid) LEFT JOIN item USING (rid) LEFT JOIN near_item USING (rid)"""


def op6_simhash(spark, sf_dir):
    rows = near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_pii(spark, sf_dir):
    rows = pii.find_pii(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_secrets(spark, sf_dir):
    rows = secrets.scan(read(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    return rows.select(
        "doc_id", *(secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in kinds),
        F.sha2(secrets.rendered(F.col("spans"), kinds), 256).alias("base_sha256"), secrets.rendered(F.col("spans")).alias("spans"),
    )


def _secrets_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, own FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS own, string_split_regex(t, '{p}') AS g FROM d)"
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.RULES))
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    listed = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    counts = ", ".join(f"(count(*) FILTER (kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT rid, rank, kind, ({total('g[1:i]')} + {total('m[1:i - 1]')})::BIGINT AS a, length(m[i]) AS n FROM m WHERE length(own[i]) >= CASE rank {least} END),
f AS (SELECT rid, rank, kind, a, a + n AS b FROM s)
SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({listed} FILTER (kind IS NOT NULL), '') AS spans FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""


def op10_tokens(spark, sf_dir):
    folder = new_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_tokens(spark, folder)


def op7_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"))


def _rule_sql(rule) -> str:
    parts = []
    if rule.least is not None:
        parts.append(f"{rule.over} * 1000 >= {rule.under} * {rule.least}")
    if rule.most is not None:
        parts.append(f"{rule.over} * 1000 <= {rule.under} * {rule.most}")
    ok = " AND ".join(parts)
    return f"({ok} OR n_words < {rule.after})" if rule.after else f"({ok})"


def quality_rules_sql(table: str = "documents", columns: str = "") -> str:
    """DuckDB SQL for the quality rules' rows over ``table``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = ", ".join(f"CASE WHEN NOT {_rule_sql(r)} THEN '{r.name}' END" for r in RULES)
    return rf"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt FROM {table}),
d AS (SELECT rid, doc_id, txt,
        list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM src),
win AS (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i+4]) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT i + o.o) AS n FROM rep, range(5) AS o(o) WHERE c >= 2 GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(ln)::BIGINT AS n_lines,
        len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
        (length(txt) - length(replace(txt, '!', '')))::BIGINT AS n_exclamations
      FROM d LEFT JOIN cov USING (rid)),
v AS (SELECT *, (n_words < {BASE_LEAST_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words) AS base_failed,
        array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM v"""


def planted(doc_id, n: int):
    """Where the words of a document begin to repeat and with which period, in the documents that get a repetition."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op11_runs(spark, sf_dir):
    rows = periodic_runs(read(spark, sf_dir, "documents"), rewrite=planted)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = rows.select("*", best.alias("best"), F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")).alias("listed"))
    length = -F.col("best.less")
    return rows.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", length.alias("length"), "best.period",
        F.floor((1000 * length - F.pmod(1000 * length, "best.period")) / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_bpe(spark, sf_dir):
    path = tokenizer_path()
    rows = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_resampling(spark, sf_dir):
    rows = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte with a table of 256 values, once for each different word.
RESAMPLING_SQL = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_ascii_words('text')} AS w FROM documents),
b AS (SELECT unnest({_ascii_words('text')}) AS word FROM benchmark),
dw AS (SELECT rid, unnest(w) AS word FROM d),
word AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM b)),
bytes AS (SELECT word, list_transform(range(0, length(hex(word)) // 2), lambda i: ('0x' || hex(word)[2 * i + 1:2 * i + 2])::BIGINT) AS l FROM word),
crc AS (SELECT word, xor(list_reduce(l, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN crc USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::BIGINT AS s, (SELECT coalesce(sum(n), 0) FROM t)::BIGINT AS t),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (total.s + {BUCKETS}))::DOUBLE / ((s.n + 1) * (total.t + {BUCKETS}))::DOUBLE))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), total),
weighed AS (SELECT rid, sum(g)::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weighed USING (rid)),
able AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n >= {LEAST_WORDS})
SELECT doc_id, scored.n::BIGINT AS n_features, weight, score, CASE WHEN place <= {PERCENT} * able.n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN able USING (rid)"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_licenses, op2_mixing, op3_importance, op4_line_dedup, op5_decontamination,
        op6_simhash, op7_quality_rules, op8_pii, op9_secrets, op10_tokens, op11_runs, op12_bpe, op13_resampling,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINE_DEDUP_SQL, "op5_decontamination": DECONTAMINATION_SQL, "op7_quality_rules": quality_rules_sql(), "op9_secrets": _secrets_sql(), "op13_resampling": RESAMPLING_SQL}
