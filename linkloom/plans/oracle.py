"""The same queries in SQL that DuckDB runs, written from the definitions: no caps are moved, the
name route has none, policies are spelled out."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the operators shows.
ROUTES = {"name": (5.0, None), "prefix": (3.5, 40), "trigram": (2.5, 30), "token": (2.5, 35), "postal": (4.0, 30), "addrnum": (2.5, 25)}
LEXICAL = ("name", "prefix", "token", "postal", "addrnum")
SEGMENT_GRID = [(us, other) for us in (0.60, 0.65, 0.70, 0.75) for other in (0.50, 0.55, 0.60, 0.65, 0.70)]
RANK_GRID = [(least, ratio, keep) for least in (0.45, 0.50, 0.55, 0.60) for ratio in (0.60, 0.70, 0.80) for keep in (3, 5, 8, 15)]
THRESHOLDS = [0.50 + 0.05 * i for i in range(8)]
SUFFIXES = {
    "private limited": "PVT_LTD", "pvt ltd": "PVT_LTD", "pvt limited": "PVT_LTD", "private ltd": "PVT_LTD", "praivet limited": "PVT_LTD",
    "piraivet limitet": "PVT_LTD", "praivet limitet": "PVT_LTD", "pra li": "PVT_LTD", "pte ltd": "PVT_LTD", "prvt ltd": "PVT_LTD",
    "limited": "LTD", "limitet": "LTD", "ltd": "LTD", "corporation": "CORP", "corp": "CORP", "incorporated": "INC", "inc": "INC",
    "llc": "LLC", "l l c": "LLC", "llp": "LLP", "sarl": "SARL", "s a r l": "SARL", "sas": "SAS", "s a s": "SAS", "sasu": "SASU", "s a s u": "SASU",
    "sci": "SCI", "s c i": "SCI", "sa": "SA", "s a": "SA", "eurl": "EURL", "snc": "SNC",
}
ORDERED_SUFFIXES = sorted(SUFFIXES, key=len, reverse=True)

_words = "list_filter(string_split({}, ' '), lambda x: length(x) >= {})"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(replace(replace(lower({c}), 'œ', 'oe'), 'ß', 'ss')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_ladder = "CASE " + " ".join(f"WHEN regexp_matches(clean_name, '\\b{s}\\b') THEN '{s}'" for s in ORDERED_SUFFIXES) + " END"
_category = "CASE pat " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in SUFFIXES.items()) + " ELSE '' END"

ENTITIES = """
b AS (SELECT doc_id, 1 + (CAST(substr(source, 4) AS INT) % 3) AS bucket, lang, n_chars, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS t FROM documents),
p AS (SELECT *, CASE lang WHEN 'en' THEN lpad(CAST(n_chars AS VARCHAR), 5, '0') WHEN 'fr' THEN lpad(CAST(n_chars AS VARCHAR), 5, '0') WHEN 'es' THEN CAST(100000 + n_chars AS VARCHAR) ELSE '' END AS postal FROM b),
e AS (SELECT 'S' || bucket || '-' || doc_id AS entity_id, array_to_string(list_slice(t, 1, 6), ' ') AS business_name,
  trim(n_chars || ' ' || array_to_string(list_slice(t, 7, 18), ' ') || ' ' || postal) AS business_address,
  CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' WHEN 'es' THEN 'India' ELSE 'Germany' END AS country,
  CAST(bucket AS BIGINT) * 1000000000 + doc_id AS seq, bucket FROM p),
s1 AS (SELECT entity_id AS s1_id, * FROM e WHERE bucket = 1),
truth AS (SELECT a.entity_id AS s1_id, c.entity_id AS tid FROM e a JOIN e c USING (country, business_name) WHERE a.bucket = 1 AND c.bucket > 1)"""

NORMAL = f"""{ENTITIES},
n1 AS (SELECT *, {_clean("business_name")} AS clean_name, {_clean("business_address")} AS clean_address FROM e),
n2 AS (SELECT *, {_ladder} AS pat FROM n1),
n3 AS (SELECT *, {_category} AS legal_suffix, CASE WHEN pat IS NULL THEN clean_name ELSE coalesce(nullif(trim(regexp_replace(regexp_replace(clean_name, '\\b' || pat || '\\b', ' ', 'g'), '\\s+', ' ', 'g')), ''), clean_name) END AS root_name FROM n2),
n4 AS (SELECT *, regexp_extract_all(clean_address, '\\b[0-9]+\\b') AS address_numbers,
  nullif(CASE WHEN lower(country) LIKE '%india%' THEN regexp_extract(business_address, '\\b[1-9][0-9]{{5}}\\b') WHEN lower(country) LIKE '%us%' THEN substr(regexp_extract(business_address, '\\b[0-9]{{5}}(-[0-9]{{4}})?\\b'), 1, 5)
   WHEN lower(country) LIKE '%france%' THEN regexp_extract(business_address, '\\b[0-9]{{5}}\\b') END, '') AS postal_code,
  regexp_matches(regexp_replace(business_name || business_address, '[A-Za-z]', '', 'g'), '\\p{{L}}') AS is_non_latin,
  trim(regexp_replace(regexp_replace(root_name, '[^a-z0-9\\s]', '', 'g'), '[aeiouy]', '', 'g')) AS skeleton FROM n3),
n5 AS (SELECT *, regexp_replace(skeleton, '\\s+', '', 'g') AS sk, {_words.format("root_name", 1)} AS toks, {_words.format("root_name", 2)} AS t2, {_words.format("clean_address", 4)}[1:3] AS addr_words FROM n4),
n AS (SELECT *, CASE WHEN length(sk) = 0 THEN [] WHEN length(sk) < 3 THEN [sk] ELSE list_transform(range(1, length(sk) - 1), lambda i: substr(sk, i, 3)) END AS skeleton_3grams,
  list_distinct(CASE WHEN len(t2) >= 2 THEN list_concat([t2[1] || '_' || t2[2], array_to_string(list_sort(t2[1:2]), '_'), substr(t2[1], 1, 4) || '_' || substr(t2[2], 1, 4), array_to_string(list_sort([substr(t2[1], 1, 4), substr(t2[2], 1, 4)]), '_')],
    CASE WHEN len(t2) >= 3 THEN [substr(t2[1], 1, 4) || '_' || substr(t2[3], 1, 4)] ELSE [] END) WHEN len(t2) = 1 AND length(t2[1]) >= 5 THEN [substr(t2[1], 1, 5)] ELSE [] END) AS pkeys FROM n5)"""

_KEYS = {
    "name": "SELECT country, 'name' AS route, root_name AS key, entity_id, seq FROM n WHERE length(root_name) >= 3",
    "prefix": "SELECT country, 'prefix', unnest(pkeys), entity_id, seq FROM n",
    "trigram": "SELECT country, 'trigram', unnest(skeleton_3grams), entity_id, seq FROM n",
    "token": "SELECT country, 'token', unnest(list_distinct(list_filter(toks, lambda x: length(x) >= 3))), entity_id, seq FROM n",
    "postal": "SELECT country, 'postal', postal_code || ' ' || substr(toks[1], 1, 4), entity_id, seq FROM n WHERE postal_code IS NOT NULL AND length(substr(toks[1], 1, 4)) >= 3",
    "addrnum": "SELECT country, 'addrnum', num || ' ' || w, entity_id, seq FROM (SELECT *, unnest(addr_words) AS w FROM (SELECT *, unnest(address_numbers[1:2]) AS num FROM n))",
}


def blocked(routes: tuple[str, ...] = tuple(ROUTES), name: str = "c", base: str = NORMAL, most: int = 20) -> str:
    union = " UNION ALL ".join(_KEYS[r] for r in routes)
    caps = " ".join(f"WHEN '{r}' THEN {ROUTES[r][1] or 10**9}" for r in routes)
    weights = " ".join(f"WHEN '{r}' THEN {ROUTES[r][0]}" for r in routes)
    return f"""{base},
k_{name} AS ({union}),
df_{name} AS (SELECT country, key, count(*) AS df FROM k_{name} WHERE route = 'token' AND entity_id NOT LIKE 'S1-%' GROUP BY ALL),
t_{name} AS (SELECT *, row_number() OVER (PARTITION BY country, route, key ORDER BY seq) AS place FROM k_{name} WHERE entity_id NOT LIKE 'S1-%'),
w_{name} AS (SELECT a.entity_id AS s1_id, t.entity_id AS tid, t.seq AS tseq, CASE WHEN route = 'token' AND df >= 100 THEN 1.5 ELSE CASE route {weights} END END AS w
 FROM k_{name} a JOIN t_{name} t USING (country, route, key) LEFT JOIN df_{name} d ON route = 'token' AND d.country = a.country AND d.key = a.key
 WHERE a.entity_id LIKE 'S1-%' AND place <= CASE route {caps} END AND (df IS NULL OR df <= 1500)),
a_{name} AS (SELECT s1_id, tid, tseq, CAST(sum(w) AS DOUBLE) AS score FROM w_{name} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, tseq) AS rank FROM a_{name}) WHERE rank <= {most})"""


BLOCKED = blocked()
SCORED = f"""{BLOCKED},
sc AS (SELECT s1_id, tid, tseq, s1.seq AS sseq, s1.country, score / (score + 5.0) AS prob, max(score / (score + 5.0)) OVER (PARTITION BY s1_id) AS top, rank FROM c JOIN s1 USING (s1_id)),
cut AS (SELECT *, CASE country WHEN 'US' THEN 0.70 WHEN 'India' THEN 0.65 ELSE 0.70 END::DOUBLE AS th FROM sc),
mn AS (SELECT * FROM cut WHERE top >= th - 0.10::DOUBLE AND (prob >= th AND prob >= 0.75::DOUBLE * top OR prob >= 0.85::DOUBLE))"""

_f05 = "CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN n_pred = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END::DOUBLE"
EVALUATED = f"""{SCORED},
ev0 AS (SELECT s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = s1.s1_id)::DOUBLE AS n_true, (SELECT count(*) FROM mn m WHERE m.s1_id = s1.s1_id)::DOUBLE AS n_pred,
 (SELECT count(*) FROM mn m JOIN truth t ON t.s1_id = m.s1_id AND t.tid = m.tid WHERE m.s1_id = s1.s1_id)::DOUBLE AS tp FROM s1),
ev AS (SELECT *, {_f05} AS f05 FROM ev0)"""

PAIRED = f"{BLOCKED}, pr AS (SELECT c.s1_id, c.tid, a AS l, t AS r FROM c JOIN n a ON a.entity_id = c.s1_id JOIN n t ON t.entity_id = c.tid)"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _grid(kept: str, ctes: str = "") -> str:
    """kept: SELECT idx, s1_id, tid. Every record is scored under every policy."""
    return f"""
kept AS ({kept}),
pol AS (SELECT DISTINCT idx FROM kept),
g0 AS (SELECT pol.idx, s1.s1_id, coalesce(t.n, 0)::DOUBLE AS n_true, coalesce(k.n, 0)::DOUBLE AS n_pred, coalesce(h.n, 0)::DOUBLE AS tp FROM pol CROSS JOIN s1
 LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) t ON t.s1_id = s1.s1_id LEFT JOIN (SELECT idx, s1_id, count(*) AS n FROM kept GROUP BY ALL) k ON k.idx = pol.idx AND k.s1_id = s1.s1_id
 LEFT JOIN (SELECT idx, kept.s1_id, count(*) AS n FROM kept JOIN truth USING (s1_id, tid) GROUP BY ALL) h ON h.idx = pol.idx AND h.s1_id = s1.s1_id)"""


_scores = f"CAST(idx AS BIGINT) AS idx, round(avg({_f05}), 6) AS macro_f05, round(sum(n_pred) / count(*), 6) AS avg_links, CAST(count(*) FILTER (n_pred = 0) AS BIGINT) AS empty FROM g0 GROUP BY idx"


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join([str(i), *(f'{v!r}::DOUBLE' if isinstance(v, float) else str(v) for v in r)]) + ')' for i, r in enumerate(rows))}) g({names})"


_apart = "len({a}.address_numbers) > 0 AND len({b}.address_numbers) > 0 AND NOT list_has_any({a}.address_numbers, {b}.address_numbers)"
_post = "country = 'US' AND coalesce({a}.postal_code <> {b}.postal_code, false)"


def _consistent(source: str) -> str:
    return f"""
m0 AS (SELECT x.*, a AS l, t AS r, count(*) OVER (PARTITION BY x.s1_id) AS cnt FROM {source} x JOIN n a ON a.entity_id = x.s1_id JOIN n t ON t.entity_id = x.tid),
m1 AS (SELECT * FROM m0 WHERE cnt <= 1 OR NOT ({_post.format(a="l", b="r")} AND prob < 0.85) AND NOT ({_apart.format(a="l", b="r")} AND prob < 0.88)),
m2 AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, tseq) AS pos, first(r) OVER (PARTITION BY s1_id ORDER BY prob DESC, tseq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM m1),
m3 AS (SELECT * FROM m2 WHERE cnt <= 1 OR pos = 1 OR NOT (({_apart.format(a="best", b="r")} OR {_post.format(a="best", b="r")}) AND prob < 0.85))"""


def _lengths(c: str) -> str:
    return f"SELECT '{c}' AS field, round(avg(x), 1) AS mean, CAST(list_sort(list(x))[CAST(floor(0.5 * (count(*) - 1)) AS INT) + 1] AS BIGINT) AS p50, CAST(list_sort(list(x))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] AS BIGINT) AS p95, CAST(max(x) AS BIGINT) AS max FROM (SELECT length({c}) AS x FROM e)"


_b = "CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE"
_s = "CASE WHEN {k} THEN CASE WHEN {c} THEN 1.0 ELSE -1.0 END ELSE 0.0 END::DOUBLE"
_both = "len(l.address_numbers) > 0 AND len(r.address_numbers) > 0"
_seg = "SELECT {d} AS dimension, {s} AS segment, count(*) AS links, round(100.0 * count(in_c) / count(*), 6) AS candidate_recall, round(100.0 * count(in_p) / count(*), 6) AS final_recall, round(100.0 * count(in_c) / count(*) - 100.0 * count(in_p) / count(*), 6) AS loss FROM links GROUP BY ALL"
_norm = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"

ORACLE = {
    "block_candidates": _with(BLOCKED, "SELECT s1_id, tid, score, rank FROM c"),
    "block_lexical5": _with(blocked(LEXICAL), "SELECT s1_id, tid, score, rank FROM c"),
    "norm_clean_text": _with(NORMAL, "SELECT entity_id, clean_name, clean_address FROM n"),
    "norm_strip_accents": _with(ENTITIES, "SELECT entity_id, strip_accents(replace(replace(lower(business_name), 'œ', 'oe'), 'ß', 'ss')) AS folded FROM e"),
    "norm_legal_suffix": _with(NORMAL, "SELECT entity_id, root_name, legal_suffix FROM n"),
    "norm_numbers": _with(NORMAL, "SELECT entity_id, array_to_string(address_numbers, ',') AS address_numbers FROM n"),
    "norm_postal": _with(NORMAL, "SELECT entity_id, postal_code FROM n"),
    "norm_non_latin": _with(NORMAL, "SELECT entity_id, is_non_latin FROM n"),
    "norm_skeleton": _with(NORMAL, "SELECT entity_id, skeleton FROM n"),
    "norm_trigrams": _with(NORMAL, "SELECT entity_id, array_to_string(skeleton_3grams, ',') AS skeleton_3grams FROM n"),
    "prefix_keys": _with(NORMAL, "SELECT entity_id, array_to_string(list_sort(pkeys), ',') AS keys FROM n"),
    "indic_flag": _with(ENTITIES, "SELECT entity_id, regexp_matches(business_name, '[\\x{0900}-\\x{0D7F}]') AS indic FROM e"),
    "id_list_parse": _with(ENTITIES, "SELECT s1.s1_id, count(tid) AS n, coalesce(string_agg(tid, ',' ORDER BY tid), '') AS ids FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY ALL"),
    "token_df": _with(NORMAL, f"SELECT country, key, count(*) AS df FROM ({_KEYS['token'].replace(', entity_id', ' AS key, entity_id')}) WHERE entity_id NOT LIKE 'S1-%' GROUP BY ALL"),
    "hub_addresses": _with(ENTITIES, "SELECT country, business_name, count(*) AS n FROM e WHERE bucket > 1 AND business_name <> '' GROUP BY ALL HAVING count(*) >= 20"),
    "pair_labels": _with(BLOCKED, "SELECT c.s1_id, c.tid, CASE WHEN t.tid IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM c LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.tid = c.tid"),
    "needed_targets": _with(ENTITIES, "SELECT entity_id, seq FROM e WHERE bucket > 1 AND entity_id IN (SELECT tid FROM truth) UNION ALL SELECT entity_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS i FROM e WHERE bucket > 1 AND entity_id NOT IN (SELECT tid FROM truth)) WHERE i <= 50"),
    "hard_negatives": _with(
        NORMAL,
        """SELECT entity_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS i FROM n WHERE bucket > 1 AND entity_id NOT IN (SELECT tid FROM truth)
 AND (postal_code IN (SELECT postal_code FROM n WHERE bucket = 1 AND postal_code IS NOT NULL) OR list_has_any(pkeys, (SELECT list(DISTINCT k) FROM (SELECT unnest(pkeys) AS k FROM n WHERE bucket = 1))))) WHERE i <= 100""",
    ),
    "id_coverage": _with(ENTITIES, "SELECT CASE WHEN seq % 7 <> 0 THEN 'missing' ELSE 'extra' END AS kind, s1_id FROM s1 WHERE (seq % 7 <> 0) <> (seq % 5 <> 0)"),
    "audit_countries": _with(ENTITIES, "SELECT country, count(*) AS n FROM e GROUP BY ALL"),
    "audit_missing": _with(ENTITIES, "SELECT count(*) FILTER (business_name = '') AS business_name, count(*) FILTER (business_address = '') AS business_address, count(*) FILTER (country = '') AS country FROM e"),
    "audit_lengths": _with(ENTITIES, f"{_lengths('business_name')} UNION ALL {_lengths('business_address')}"),
    "truth_summary": _with(
        ENTITIES,
        "SELECT n_links, count(*) AS entities, CAST(sum(s2) AS BIGINT) AS s2_links, CAST(sum(s3) AS BIGINT) AS s3_links FROM (SELECT s1.s1_id, count(tid) AS n_links, count(*) FILTER (tid LIKE 'S2-%') AS s2, count(*) FILTER (tid LIKE 'S3-%') AS s3 FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY 1) GROUP BY 1",
    ),
    "feat_length": _with(PAIRED, "SELECT s1_id, tid, abs(length(l.root_name) - length(r.root_name))::DOUBLE AS len_diff, round(least(length(l.root_name), length(r.root_name))::DOUBLE / greatest(length(l.root_name), length(r.root_name), 1), 6) AS len_ratio FROM pr"),
    "feat_suffix": _with(PAIRED, f"SELECT s1_id, tid, {_b.format(c='length(l.legal_suffix) > 0 AND l.legal_suffix = r.legal_suffix')} AS suf_match, {_b.format(c='length(l.legal_suffix) > 0 AND length(r.legal_suffix) > 0 AND l.legal_suffix <> r.legal_suffix')} AS suf_conflict FROM pr"),
    "feat_numeric": _with(
        PAIRED,
        f"SELECT s1_id, tid, {_s.format(k=_both, c='list_has_any(l.address_numbers, r.address_numbers)')} AS num_score, {_s.format(k=_both, c='l.address_numbers[1] = r.address_numbers[1]')} AS first_num_match, {_s.format(k='l.postal_code IS NOT NULL AND r.postal_code IS NOT NULL', c='l.postal_code = r.postal_code')} AS post_score FROM pr",
    ),
    "feat_token_overlap": _with(PAIRED, "SELECT s1_id, tid, len(list_intersect(l.toks, r.toks))::DOUBLE AS shared_name_tokens, len(list_intersect(string_split(l.clean_address, ' '), string_split(r.clean_address, ' ')))::DOUBLE AS shared_addr_tokens FROM pr"),
    "feat_jaro_winkler": _with(PAIRED, "SELECT s1_id, tid, round(jaro_winkler_similarity(l.root_name, r.root_name), 6) AS name_jw FROM pr"),
    "context_features": _with(
        SCORED,
        """SELECT s1_id, tid, rank AS ctx_rank, round(top, 6) AS ctx_max, round(top - prob, 6) AS ctx_gap_max,
 round(CASE WHEN rank = 1 THEN prob - coalesce(nth_value(prob, 2) OVER (PARTITION BY s1_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), top) ELSE prob - top END, 6) AS ctx_gap_second FROM sc""",
    ),
    "policy_flat": _with(SCORED, "SELECT s1_id, tid FROM sc WHERE prob >= 0.70::DOUBLE"),
    "policy_segment": _with(SCORED, "SELECT s1_id, tid FROM cut WHERE prob >= th"),
    "policy_main": _with(SCORED, "SELECT s1_id, tid FROM mn"),
    "policy_arbiter": _with(SCORED, "SELECT s1_id, tid FROM sc WHERE prob >= 0.65::DOUBLE"),
    "policy_rank_prefix": _with(SCORED, "SELECT s1_id, tid FROM sc WHERE top >= CASE country WHEN 'US' THEN 0.65 ELSE 0.55 END::DOUBLE AND rank <= 8 AND prob >= 0.50::DOUBLE AND prob >= 0.70::DOUBLE * top"),
    "policy_hybrid": _with(f"{SCORED}, hy AS (SELECT * FROM (SELECT * EXCLUDE th, CASE country WHEN 'India' THEN 0.65 ELSE 0.70 END::DOUBLE AS th FROM cut) WHERE top >= th - 0.10::DOUBLE AND (prob >= th AND prob >= 0.75::DOUBLE * top OR prob >= 0.85::DOUBLE)), {_consistent('hy')}", "SELECT s1_id, tid FROM m3"),
    "consistency_filter": _with(f"{SCORED}, {_consistent('mn')}", "SELECT s1_id, tid FROM m3"),
    "exclusive_assignment": _with(
        f"""{SCORED},
ex AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY prob DESC, sseq) AS i FROM sc WHERE prob >= CASE WHEN country = 'India' THEN CASE WHEN tid LIKE 'S3-%' THEN 0.72 ELSE 0.68 END WHEN country = 'France' THEN CASE WHEN tid LIKE 'S3-%' THEN 0.70 ELSE 0.65 END
 ELSE CASE WHEN tid LIKE 'S3-%' THEN 0.75 ELSE 0.70 END END::DOUBLE)""",
        "SELECT s1_id, tid FROM ex WHERE i = 1",
    ),
    "macro_f05": _with(
        EVALUATED,
        "SELECT round(avg(f05), 6) AS macro_f05, count(*) AS entities, count(*) FILTER (tp = n_true AND n_pred = n_true) AS exact_lists, count(*) FILTER (n_true = 0) AS true_singletons, count(*) FILTER (n_true = 0 AND n_pred = 0) AS correct_singletons, count(*) FILTER (n_true = 0 AND n_pred > 0) AS false_merges FROM ev",
    ),
    "score_buckets": _with(EVALUATED, "SELECT CASE WHEN f05 = 0 THEN 'zero' WHEN f05 = 1 THEN 'one' ELSE 'between' END AS bucket, count(*) AS n FROM ev GROUP BY 1"),
    "singleton_stats": _with(
        EVALUATED,
        """SELECT *, round(correct_singletons / greatest(1, predicted_singletons), 6) AS singleton_precision, round(correct_singletons / greatest(1, true_singletons), 6) AS singleton_recall FROM (
SELECT count(*) FILTER (n_true = 0) AS true_singletons, count(*) FILTER (n_pred = 0) AS predicted_singletons, count(*) FILTER (n_true = 0 AND n_pred = 0) AS correct_singletons, count(*) FILTER (n_true = 0 AND n_pred > 0) AS false_merges, count(*) FILTER (n_true > 0 AND n_pred = 0) AS false_singletons FROM ev)""",
    ),
    "cap_hits": _with(EVALUATED, "SELECT count(*) AS entities, count(*) FILTER ((SELECT count(*) FROM c WHERE c.s1_id = ev.s1_id) >= 15) AS at_cap FROM ev WHERE n_true >= 6"),
    "segment_recall": _with(
        f"""{SCORED},
links AS (SELECT e.country, CASE WHEN regexp_matches(e.business_name, '[\\x{{0900}}-\\x{{0D7F}}]') THEN 'Indic' ELSE 'Latin' END AS script, CASE WHEN t.tid LIKE 'S2-%' THEN 'Source 2' ELSE 'Source 3' END AS target,
 CASE WHEN k = 1 THEN '1_match' WHEN k = 2 THEN '2_matches' WHEN k <= 5 THEN '3-5_matches' ELSE '6-11_matches' END AS bucket, c.tid AS in_c, mn.tid AS in_p
 FROM (SELECT *, count(*) OVER (PARTITION BY s1_id) AS k FROM truth) t JOIN e ON e.entity_id = t.tid LEFT JOIN c ON c.s1_id = t.s1_id AND c.tid = t.tid LEFT JOIN mn ON mn.s1_id = t.s1_id AND mn.tid = t.tid)""",
        " UNION ALL ".join(_seg.format(d=f"'{d}'", s=s) for d, s in (("overall", "'all'"), ("country", "country"), ("script", "script"), ("target", "target"), ("multiplicity", "bucket"))),
    ),
    "tune_grid": _with(
        SCORED,
        "SELECT * FROM (WITH "
        + _grid(f"SELECT idx, s1_id, tid FROM sc, {_values(SEGMENT_GRID, 'idx, us, other')} WHERE prob >= CASE country WHEN 'US' THEN us ELSE other END")
        + f" SELECT 'segment' AS grid, {_scores}) UNION ALL SELECT * FROM (WITH "
        + _grid(f"SELECT idx, s1_id, tid FROM sc, {_values(RANK_GRID, 'idx, least, ratio, keep')} WHERE top >= CASE country WHEN 'US' THEN 0.65 ELSE 0.55 END::DOUBLE AND rank <= keep AND prob >= least AND prob >= ratio * top")
        + f" SELECT 'rank' AS grid, {_scores})",
    ),
    "threshold_scan": _with(SCORED + "," + _grid(f"SELECT idx, s1_id, tid FROM sc, {_values([(t,) for t in THRESHOLDS], 'idx, t')} WHERE prob >= t"), f"SELECT {_scores}"),
    "dense_topk": f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / {_norm.format(v="embedding")}) AS u FROM embeddings)
SELECT s1_id, tid, round(sim, 5) AS dense_sim, rank FROM (SELECT q.vec_id AS s1_id, t.vec_id AS tid, list_dot_product(q.u, t.u) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, t.u) DESC, t.vec_id) AS rank FROM v q JOIN v t USING (label) WHERE q.vec_id % 2 = 0 AND t.vec_id % 2 = 1) WHERE rank <= 5""",
    "rrf_merge": _with(
        blocked(LEXICAL, "d", blocked()),
        "SELECT s1_id, tid, round(s, 6) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY s DESC, tid) AS i FROM (SELECT s1_id, tid, sum(1.0::DOUBLE / (59 + rank)) AS s FROM (SELECT s1_id, tid, rank FROM c UNION ALL SELECT s1_id, tid, rank FROM d) GROUP BY ALL)) WHERE i <= 20",
    ),
    "validate_findings": _with(
        f"""{ENTITIES},
lists AS (SELECT s1_id, seq, coalesce((SELECT string_agg(tid, ',' ORDER BY tid) FROM truth t WHERE t.s1_id = s1.s1_id), '') AS ids FROM s1),
r0 AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN 'S1-extra' ELSE s1_id END AS s1_id, s1_id AS was, concat_ws(',', nullif(ids, ''), CASE WHEN seq % 13 = 0 THEN 'S1-1' END, CASE WHEN seq % 17 = 0 THEN 'X-9' END, CASE WHEN seq % 19 = 0 THEN 'S2-none' END, CASE WHEN seq % 23 = 0 THEN 'S3-5,S3-5' END) AS ids FROM lists WHERE seq % 7 <> 0),
r AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE seq % 31 = 0),
good AS (SELECT *, CASE WHEN ids = '' THEN [] ELSE string_split(ids, ',') END AS l FROM r WHERE seq % 29 <> 0),
each AS (SELECT DISTINCT s1_id, unnest(l) AS tid FROM good),
f AS (SELECT 'malformed_row' AS rule, 'line ' || seq AS o FROM r WHERE seq % 29 = 0
 UNION ALL SELECT 'duplicate_row', s1_id FROM good GROUP BY s1_id HAVING count(*) > 1
 UNION ALL SELECT DISTINCT 'duplicate_in_list', s1_id FROM good WHERE len(l) <> len(list_distinct(l))
 UNION ALL SELECT DISTINCT 'self_match', tid FROM each WHERE tid LIKE 'S1-%'
 UNION ALL SELECT DISTINCT 'wrong_prefix', tid FROM each WHERE NOT regexp_matches(tid, '^S[123]-')
 UNION ALL SELECT 'missing_row', s1_id FROM s1 WHERE s1_id NOT IN (SELECT s1_id FROM good)
 UNION ALL SELECT DISTINCT 'unexpected_row', s1_id FROM good WHERE s1_id NOT IN (SELECT s1_id FROM s1)
 UNION ALL SELECT DISTINCT 'unknown_id', tid FROM each WHERE regexp_matches(tid, '^S[23]-') AND tid NOT IN (SELECT entity_id FROM e WHERE bucket > 1)
 UNION ALL SELECT DISTINCT 'match_not_candidate', s1_id FROM each WHERE (s1_id, tid) NOT IN (SELECT (s1_id, tid) FROM truth))""",
        "SELECT rule, count(*) AS n, array_to_string(list_sort(list(o))[1:5], ',') AS examples FROM f GROUP BY rule",
    ),
}
ORACLE["stream_candidates"] = ORACLE["block_candidates"]
ORACLE["needed_targets_full"] = ORACLE["needed_targets"].replace("i <= 50", "i <= 250000")
ORACLE["hard_negatives_full"] = ORACLE["hard_negatives"].replace("i <= 100", "i <= 150000")
ORACLE["predict_by_rule"] = _with(
    f"""{SCORED}, {_consistent("mn")},
ex AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY prob DESC, sseq) AS i FROM m3 WHERE prob >= CASE WHEN country = 'India' THEN CASE WHEN tid LIKE 'S3-%' THEN 0.72 ELSE 0.68 END WHEN country = 'France' THEN CASE WHEN tid LIKE 'S3-%' THEN 0.70 ELSE 0.65 END
 ELSE CASE WHEN tid LIKE 'S3-%' THEN 0.75 ELSE 0.70 END END::DOUBLE)""",
    "SELECT s1_id, tid, prob FROM ex WHERE i = 1",
)

# Planted words in other scripts: what they become, and the scripts' names.
_PLANTED = (("ram", "DEVANAGARI"), ("maturai", "TAMIL"), ("privet", "CYRILLIC"), ("omega", "GREEK"), ("punjab", "GURMUKHI"), ("lodz", "LATIN"), ("123", ""), ("fin", "LATIN"))
ORACLE["norm_states"] = _with(NORMAL, "SELECT entity_id, trim(CASE country WHEN 'India' THEN 'maharashtra ' ELSE '' END || clean_address) AS clean_address FROM n1")
ORACLE["norm_transliterate"] = _with(NORMAL, f"SELECT entity_id, trim([{', '.join(repr(w) for w, _ in _PLANTED)}][seq % 8 + 1] || ' ' || clean_name) AS clean_name FROM n1")
_scripts = "SELECT g AS script_group, count(*) AS n FROM (SELECT coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter([{planted}, CASE WHEN regexp_matches(regexp_replace(business_name, '[ªº]', '', 'g'), '\\p{{Latin}}') THEN 'LATIN' ELSE '' END, CASE WHEN contains(business_name, 'ª') THEN 'FEMININE' ELSE '' END, CASE WHEN contains(business_name, 'º') THEN 'MASCULINE' ELSE '' END], lambda x: x <> ''))), '+'), ''), 'None') AS g FROM e) GROUP BY g"
ORACLE["audit_script_group"] = _with(ENTITIES, _scripts.format(planted="''"))
ORACLE["script_groups"] = _with(ENTITIES, _scripts.format(planted=f"[{', '.join(repr(s) for _, s in _PLANTED)}][seq % 8 + 1]"))
ORACLE["link_clusters"] = _with(
    SCORED.replace("WITH ", "", 1) + ", edges AS (SELECT s1_id AS a, tid AS b FROM mn UNION SELECT tid, s1_id FROM mn)",
    "SELECT node, min(other) AS cluster FROM (WITH RECURSIVE reach(node, other) AS (SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other) SELECT * FROM reach) GROUP BY node",
)
ORACLE["validation_pairs"] = _with(BLOCKED, "SELECT c.s1_id, c.tid, CASE WHEN t.tid IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM c JOIN s1 ON s1.s1_id = c.s1_id LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.tid = c.tid WHERE s1.seq > (SELECT floor(quantile_cont(seq, 0.75)) FROM s1)")
ORACLE["emission_report"] = _with(
    SCORED,
    "SELECT n AS entities, nc AS candidates, nm AS matches, round(nc / n, 6) AS avg_candidates, round(nm / n, 6) AS avg_matches FROM (SELECT (SELECT count(*) FROM s1) AS n, (SELECT count(*) FROM sc) AS nc, (SELECT count(*) FROM mn) AS nm)",
)
ORACLE["features_native"] = _with(
    f"{PAIRED}, hub AS (SELECT country, clean_name FROM n WHERE bucket > 1 AND clean_name <> '' GROUP BY ALL HAVING count(*) >= 20)",
    f"""SELECT pr.s1_id, pr.tid, abs(length(l.root_name) - length(r.root_name))::DOUBLE AS len_diff, round(least(length(l.root_name), length(r.root_name))::DOUBLE / greatest(length(l.root_name), length(r.root_name), 1), 6) AS len_ratio,
 {_b.format(c='length(l.legal_suffix) > 0 AND l.legal_suffix = r.legal_suffix')} AS suf_match, {_b.format(c='length(l.legal_suffix) > 0 AND length(r.legal_suffix) > 0 AND l.legal_suffix <> r.legal_suffix')} AS suf_conflict,
 {_s.format(k=_both, c='list_has_any(l.address_numbers, r.address_numbers)')} AS num_score, {_s.format(k=_both, c='l.address_numbers[1] = r.address_numbers[1]')} AS first_num_match, {_s.format(k='l.postal_code IS NOT NULL AND r.postal_code IS NOT NULL', c='l.postal_code = r.postal_code')} AS post_score,
 len(list_intersect(l.toks, r.toks))::DOUBLE AS shared_name_tokens, len(list_intersect(string_split(l.clean_address, ' '), string_split(r.clean_address, ' ')))::DOUBLE AS shared_addr_tokens, c.score AS retrieval_score,
 {_b.format(c="pr.tid LIKE 'S2-%'")} AS is_s2, {_b.format(c="pr.tid LIKE 'S3-%'")} AS is_s3, {_b.format(c='l.is_non_latin OR r.is_non_latin')} AS has_non_latin, {_b.format(c='(l.country, r.clean_name) IN (SELECT (country, clean_name) FROM hub)')} AS is_domiciliation_hub
FROM pr JOIN c ON c.s1_id = pr.s1_id AND c.tid = pr.tid""",
)


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of names of up to 126 letters, a row of bits at a time."""
    masks = f"list_transform(string_split({b}, ''), lambda ch: coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, CAST(i AS INT), 1) = ch THEN 1::HUGEINT << CAST(i - 1 AS INT) ELSE 0::HUGEINT END))::HUGEINT, 0::HUGEINT))"
    full = f"((1::HUGEINT << length({a})) - 1)"
    return f"(length({a}) - bit_count(list_reduce(list_concat([{full}], {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 2.0 * {_lcs(a, b)} / (length({a}) + length({b})) END::DOUBLE"


def _sorted_tokens(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda x: x <> '')), ' ')"


def _token_set(k: str) -> str:
    common = f"CASE WHEN {k}_both = '' THEN 0.0 ELSE 2.0 * length({k}_both) / (length({k}_both) + length({{}})) END"
    return f"CASE WHEN len({k}_x) = 0 OR len({k}_y) = 0 THEN 0.0 WHEN {k}_both <> '' AND ({k}_l = {k}_both OR {k}_r = {k}_both) THEN 1.0 ELSE greatest({_ratio(k + '_l', k + '_r')}, {common.format(k + '_l')}, {common.format(k + '_r')}) END::DOUBLE"


def _tokens_of(k: str, c: str) -> str:
    words = "list_distinct(list_filter(string_split({}, ' '), lambda x: x <> ''))"
    return f"{words.format('l.' + c)} AS {k}_x, {words.format('r.' + c)} AS {k}_y, {_sorted_tokens('l.' + c)} AS {k}_sl, {_sorted_tokens('r.' + c)} AS {k}_sr"


def _sides_of(k: str) -> str:
    both = f"array_to_string(list_sort(list_intersect({k}_x, {k}_y)), ' ')"
    rest = "concat_ws(' ', nullif({both}, ''), nullif(array_to_string(list_sort(list_filter({a}, lambda w: NOT list_contains({b}, w))), ' '), ''))"
    return f"{both} AS {k}_both, {rest.format(both=both, a=k + '_x', b=k + '_y')} AS {k}_l, {rest.format(both=both, a=k + '_y', b=k + '_x')} AS {k}_r"


ORACLE["features_ratios"] = _with(
    f"""{PAIRED},
q0 AS (SELECT s1_id, tid, l.root_name AS lr, r.root_name AS rr, l.skeleton AS ls, r.skeleton AS rs, {_tokens_of("n", "clean_name")}, {_tokens_of("o", "root_name")} FROM pr),
q1 AS (SELECT *, {_sides_of("n")}, {_sides_of("o")} FROM q0)""",
    f"""SELECT s1_id, tid, round({_ratio("n_sl", "n_sr")}, 6) AS name_sort, round({_token_set("n")}, 6) AS name_set, round({_ratio("o_sl", "o_sr")}, 6) AS root_sort, round({_token_set("o")}, 6) AS root_set, round({_ratio("lr", "rr")}, 6) AS root_ratio,
 round(jaro_winkler_similarity(lr, rr), 6) AS name_jw, round(jaro_winkler_similarity(ls, rs), 6) AS skeleton_jw FROM q1""",
)
_unit = f"list_transform(embedding, lambda x: x::DOUBLE / {_norm.format(v='embedding')})"
ORACLE["dense_search"] = f"""
WITH v AS (SELECT vec_id, label, {_unit} AS u FROM embeddings)
SELECT s1_id, tid, round(sim, 5) AS dense_sim, rank FROM (SELECT q.vec_id AS s1_id, t.vec_id AS tid, list_dot_product(q.u, t.u) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, t.u) DESC, t.vec_id) AS rank FROM v q JOIN v t USING (label) WHERE q.vec_id % 50 = 0) WHERE rank <= 35"""
ORACLE["hybrid_merge"] = _with(
    f"""{blocked(LEXICAL, "d", NORMAL, 35)},
vec AS (SELECT entity_id, country, bucket, {_unit} AS u FROM e JOIN embeddings ON vec_id = CAST(split_part(entity_id, '-', 2) AS BIGINT)),
dn AS (SELECT * FROM (SELECT q.entity_id AS s1_id, t.entity_id AS tid, list_dot_product(q.u, t.u) AS sim, row_number() OVER (PARTITION BY q.entity_id ORDER BY list_dot_product(q.u, t.u) DESC, t.entity_id) AS rank FROM vec q JOIN vec t USING (country) WHERE q.bucket = 1 AND t.bucket > 1) WHERE rank <= 35),
fu AS (SELECT s1_id, tid, sum(1.0::DOUBLE / (59 + rank)) AS s FROM (SELECT s1_id, tid, rank FROM d UNION ALL SELECT s1_id, tid, rank FROM dn) GROUP BY ALL)""",
    "SELECT f.s1_id, f.tid, round(s, 6) AS rrf_score, coalesce(round(sim, 5), 0.0) AS dense_sim FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY s DESC, tid) AS i FROM fu) f LEFT JOIN dn ON dn.s1_id = f.s1_id AND dn.tid = f.tid WHERE i <= 35",
)
