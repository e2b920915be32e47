"""The registry of this subpackage: one query for each operator over its whole table, and the SQL that equals it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import byte_pairs, decontaminate, filter_audit, fingerprints, html_text, language, manifest, near_dedup, packing, private_data, secret_scan, substrings, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.pseudonymised(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), shingle_words=3, threshold=0.85)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_html_text": op7_html_text,
    "op8_near_dedup": op8_near_dedup,
    "op9_private_data": op9_private_data,
    "op10_substrings": op10_substrings,
    "op11_filter_audit": op11_filter_audit,
    "op12_manifest": op12_manifest,
    "op13_byte_pairs": op13_byte_pairs,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT bid, item_id, n, t, array_to_string(w[t:t + n - 1], ' ') AS g
        FROM (SELECT bid, item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t FROM b WHERE len(w) > 0)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS w FROM d),
g1 AS (SELECT rid, p, {", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(10))} FROM word WINDOW o AS (PARTITION BY rid ORDER BY p)),
runs AS ({" UNION ALL ".join(f"SELECT rid, p, {n} AS n, {" || ' ' || ".join(f"w{i}" for i in range(n))} AS g FROM g1 WHERE w{n - 1} IS NOT NULL" for n in range(1, 11))}),
hits AS (SELECT rid, p, t, runs.n, bid, item_id FROM runs JOIN win ON runs.n = win.n AND runs.g = win.g),
hit AS (SELECT DISTINCT rid, unnest(range(p, p + n)) AS q FROM hits),
island AS (SELECT rid, min(q) - 1 AS a, max(q) AS z, count(*) AS n FROM (SELECT rid, q, q - row_number() OVER (PARTITION BY rid ORDER BY q) AS k FROM hit) GROUP BY rid, k),
covered AS (SELECT rid, sum(n) AS n_hit, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM island GROUP BY rid),
diagonal AS (SELECT rid, max(m) AS longest FROM (SELECT rid, count(*) + any_value(n) - 1 AS m FROM (SELECT rid, bid, n, p - t AS k, p - row_number() OVER (PARTITION BY rid, bid, n, p - t ORDER BY p) AS i FROM hits) GROUP BY rid, bid, k, i) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match, coalesce(spans, '') AS spans
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid) LEFT JOIN diagonal USING (rid)
"""

_OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM win JOIN again USING (h)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS w FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

def _either_case(word: str) -> str:
    """A pattern of both cases of ASCII letters: RE2's own folding takes other letters too."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: kind, pattern, checked group, least characters, whether the group is the span; as in ``secret_scan.RULES``.
_OP6_RULES = [
    ("assign", "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6, False),
    ("access", "AKIA[A-Z0-9]+", 0, 20, False),
    ("hex", "[0-9a-f]+", 0, 24, False),
    *((r.kind, r.pattern, r.group, r.least, r.own) for r in secret_scan.RULES if not r.base),
]
_OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(f"SELECT rid, {rank} AS rank, '{kind}' AS kind, {least} AS least, {own} AS own, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS checked FROM d WHERE regexp_matches(t, '{p}')" for rank, (kind, p, group, least, own) in enumerate(_OP6_RULES))}),
parts AS (SELECT rid, rank, kind, least, own, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, length(checked[i]) AS n FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
placed AS (SELECT *, sum(gap + hit) OVER (PARTITION BY rid, rank ORDER BY i) AS z FROM parts),
s AS (SELECT rid, rank, kind, a, kind || ':' || a || ':' || CAST(z AS BIGINT) AS name FROM (SELECT *, CAST(z - CASE WHEN own THEN n ELSE hit END AS BIGINT) AS a FROM placed WHERE n >= least)),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))}, string_agg(name, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base, string_agg(name, ',' ORDER BY a, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in ("assign", "access", "hex"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""

_OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] FOR p IN range(1, len(w) - 1)]) END AS s FROM d),
named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '\n')) AS h, s FROM sets),
node AS (SELECT h, min(doc_id) AS least, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY h),
one AS (SELECT h, n, hash(unnest(s)) AS x FROM node),
link AS (SELECT a.h AS u, b.h AS v FROM one a JOIN one b USING (x) WHERE a.h < b.h AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.h, b.h, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT h AS u, h AS v FROM node UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
part AS (SELECT r.u AS h, min(least) AS component_id FROM reach r JOIN node ON r.v = node.h GROUP BY r.u)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM named LEFT JOIN part USING (h)
"""

_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS own, CAST(coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[:step - 1], '') IF x <> '']), 0) AS INTEGER) AS before
          FROM orders, range(1, 6) t(step)),
whole AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE mask & (own + before) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0) AS removed,
          coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
          coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0) AS toxic_lost
          FROM n, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM whole
"""

#: Levels of the trees in SQL, so for up to 16 to the power of so many rows of a source.
_OP12_LEVELS = 7
_OP12_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_OP12_LEAF = "sha256(" + " || ".join(_OP12_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: list_reduce(list_prepend(xor(c, x), [k::BIGINT FOR k IN range(8)]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"


def _op12_sql() -> str:
    """The tree of each source, then that of the sources: level by level, a group's only node stays as it is."""

    def level(k: int, name: str, keys: str) -> str:
        on = f"{keys}, i // 16" if keys else "i // 16"
        lead = f"{keys}, " if keys else ""
        match = " AND ".join([f"r.{keys} = x.{keys}"] * bool(keys) + ["r.j = x.i // 16"])
        one = f"(SELECT {lead}count(*) AS size FROM {name}{k} {'GROUP BY ' + keys if keys else ''})"
        return f"""{name}r{k} AS (SELECT {lead}i // 16 AS j, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY {on}),
{name}{k + 1} AS (SELECT {lead}j AS i, CASE WHEN size = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k} {'JOIN ' + one + f' USING ({keys})' if keys else ', ' + one}),
{name}p{k + 1} AS (SELECT x.* REPLACE (x.i // 16 AS i, CASE WHEN size = 1 THEN x.proof ELSE x.proof || array_to_string(hs[:x.i % 16] || hs[x.i % 16 + 2:], '') END AS proof,
  CASE WHEN size = 1 THEN x.fold ELSE sha256(array_to_string(hs[:x.i % 16] || [x.fold] || hs[x.i % 16 + 2:], '')) END AS fold)
  FROM {name}p{k} x JOIN {name}r{k} r ON {match} {'JOIN ' + one + f' s ON s.{keys} = x.{keys}' if keys else ', ' + one})"""

    n = _OP12_LEVELS
    return f"""
WITH leaves AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_OP12_LEAF.format(text="text")} AS leaf,
  CASE WHEN {_CRC32} % 5 = 0 THEN {_OP12_LEAF.format(text="lowered")} ELSE {_OP12_LEAF.format(text="text")} END AS tampered
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, leaf AS h, rid FROM leaves),
ap0 AS (SELECT a0.g, a0.i, a0.rid, doc_id, leaf, '' AS proof, tampered AS fold FROM a0 JOIN leaves USING (rid)),
{", ".join(level(k, "a", "g") for k in range(n))},
b0 AS (SELECT row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, g FROM a{n}),
bp0 AS (SELECT b0.i, b0.g, b0.h AS subroot, doc_id, leaf, proof, fold FROM ap{n} JOIN b0 USING (g)),
{", ".join(level(k, "b", "") for k in range(n))}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM bp{n}, (SELECT h FROM b{n})
"""


ORACLE_SQL: dict[str, str] = {"op11_filter_audit": _OP11_SQL, "op12_manifest": _op12_sql(), "op4_decontaminate": _OP4_SQL, "op6_secrets": _OP6_SQL, "op8_near_dedup": _OP8_SQL, "op10_substrings": _OP10_SQL}
