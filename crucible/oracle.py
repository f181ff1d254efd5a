"""DuckDB SQL for the queries of crucible.queries, over the same tables."""

MEMBERS = """
members AS (
  SELECT l_orderkey AS record_id, CASE WHEN l_returnflag = 'R' THEN 'reactant' ELSE 'product' END AS side, l_linenumber, l_partkey,
         p_brand AS compound_id, p_name AS original, p_type AS canonical, CASE WHEN p_size % 7 = 0 THEN 'unsanitized' ELSE 'sanitized' END AS status, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

COEFFICIENTS = (
    MEMBERS
    + """,
coefs AS (
  SELECT record_id, compound_id, side, CAST(count(*) AS BIGINT) * CASE WHEN side = 'reactant' THEN -1 ELSE 1 END AS coefficient
  FROM members GROUP BY record_id, compound_id, side),
divisors AS (SELECT record_id, list_reduce(list(abs(coefficient)), lambda a, b: gcd(a, b)) AS divisor FROM coefs GROUP BY record_id),
reduced AS (SELECT record_id, compound_id, CAST(coefficient // divisor AS BIGINT) AS coefficient FROM coefs JOIN divisors USING (record_id)),
loose_divisors AS (
  SELECT record_id, list_reduce(list(abs(coefficient)), lambda a, b: gcd(a, b)) AS divisor FROM coefs
  WHERE compound_id NOT IN ('Brand#1', 'Brand#2') GROUP BY record_id),
loose_reduced AS (
  SELECT record_id, compound_id, CAST(coefficient // divisor AS BIGINT) AS coefficient FROM coefs JOIN loose_divisors USING (record_id)
  WHERE compound_id NOT IN ('Brand#1', 'Brand#2'))"""
)

KEYS = (
    COEFFICIENTS
    + """,
strict AS (
  SELECT record_id, sha256('{"direction":"undefined","participants":[' ||
    string_agg('["' || compound_id || '",' || coefficient || ',null]', ',' ORDER BY compound_id, coefficient) || ']}') AS strict_key
  FROM reduced GROUP BY record_id),
loose AS (
  SELECT s.record_id, sha256('{"participants":[' ||
    coalesce(string_agg('["' || compound_id || '",' || coefficient || ']', ',' ORDER BY compound_id, coefficient), '') || ']}') AS loose_key
  FROM strict s LEFT JOIN loose_reduced l ON s.record_id = l.record_id GROUP BY s.record_id)"""
)

RESOLVED = (
    KEYS
    + """,
joined AS (
  SELECT s.record_id, strict_key, loose_key, o_orderstatus AS status, o_orderpriority AS label
  FROM strict s JOIN loose l ON s.record_id = l.record_id JOIN orders ON o_orderkey = s.record_id),
facts AS (
  SELECT strict_key, min(record_id) AS winner, count(*) AS group_size, count(DISTINCT status) AS states FROM joined GROUP BY strict_key),
resolved AS (
  SELECT record_id, strict_key, loose_key, status, label, group_size,
    CASE WHEN group_size > 1 AND states > 1 THEN record_id ELSE winner END AS canonical_id,
    CASE WHEN group_size > 1 AND states > 1 THEN 'kept_conflict' WHEN record_id = winner THEN 'kept' ELSE 'merged_strict_exact' END AS dedup_status
  FROM joined JOIN facts USING (strict_key))"""
)

EVIDENCE = """
evidence AS (
  SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 'left_to_right' WHEN 'view' THEN 'right_to_left' WHEN 'purchase' THEN 'reversible' ELSE 'undefined' END AS direction,
    'db' || (CAST(json_extract(props, '$.k') AS INTEGER) % 3) AS database, event_id AS value
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup'))"""

VARIANTS = (
    EVIDENCE
    + """,
masters AS (SELECT c_custkey - c_custkey % 3 AS canonical_id, c_custkey AS user_id FROM customer),
counted AS (SELECT canonical_id, direction, database, count(DISTINCT value) AS n FROM masters JOIN evidence USING (user_id) GROUP BY 1, 2, 3),
by_direction AS (
  SELECT canonical_id, direction, CAST(sum(n) AS BIGINT) AS n, '{' || string_agg('"' || database || '":' || n, ',' ORDER BY database) || '}' AS j FROM counted GROUP BY 1, 2),
wanted AS (SELECT * FROM (SELECT DISTINCT canonical_id FROM masters), (VALUES ('left_to_right'), ('right_to_left'), ('reversible')) v(direction)),
variants AS (
  SELECT w.canonical_id, w.direction, w.canonical_id || '|' || w.direction AS variant_id, w.direction = 'right_to_left' AS swap_sides,
    w.direction = 'reversible' AS symmetrized, coalesce(b.n, 0) AS evidence_count, coalesce(b.n, 0) > 0 AS has_evidence,
    coalesce(b.j, '{}') AS evidence_by_database, coalesce(u.n, 0) AS undefined_count,
    CASE w.direction WHEN 'left_to_right' THEN 'net_flux_left_to_right' WHEN 'right_to_left' THEN 'net_flux_right_to_left' ELSE 'equilibrium_bidirectional' END AS semantics
  FROM wanted w LEFT JOIN by_direction b ON w.canonical_id = b.canonical_id AND w.direction = b.direction
  LEFT JOIN by_direction u ON w.canonical_id = u.canonical_id AND u.direction = 'undefined')"""
)


def _neighbours(name: str, vector: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT query, neighbour, cosine, rank FROM (
    SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity({vector.format('a')}, {vector.format('b')}) AS cosine,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity({vector.format('a')}, {vector.format('b')}) DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= {k})"""


FULL = "CAST({}.embedding AS DOUBLE[])"
TOP10, TOP1 = _neighbours("top10", FULL, 10), _neighbours("top1", FULL, 1)
SHORT1 = _neighbours("short1", "CAST({}.embedding[1:16] AS DOUBLE[])", 1)

TOKENS = """
ec AS (
  SELECT vec_id, label AS x FROM embeddings WHERE vec_id % 5 <> 4
  UNION ALL SELECT vec_id, (label + 1) % 10 FROM embeddings WHERE vec_id % 5 <> 4 AND vec_id % 7 = 0),
tokens AS (
  SELECT DISTINCT level, vec_id, CASE level WHEN '1' THEN '' || x % 2 WHEN '2' THEN x % 2 || '.' || x % 5 ELSE x % 2 || '.' || x % 5 || '.' || x END AS token
  FROM ec, (VALUES ('1'), ('2'), ('3'), ('exact')) v(level)),
annotated AS (SELECT DISTINCT level, vec_id FROM tokens),
matches AS (
  SELECT q.level, q.vec_id, count(DISTINCT b.vec_id) AS matches
  FROM annotated q JOIN tokens a ON a.level = q.level AND a.vec_id = q.vec_id LEFT JOIN tokens b ON b.level = a.level AND b.token = a.token AND b.vec_id <> a.vec_id
  GROUP BY 1, 2)"""

VIEWS = """
views AS (
  SELECT vec_id - vec_id % 8 AS batch, vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings),
long AS (
  SELECT batch, vec_id, 'a' AS view, unnest(range(32)) AS dim, unnest(a) AS x FROM views
  UNION ALL SELECT batch, vec_id, 'b', unnest(range(32)), unnest(b) FROM views)"""

QUANTISED = """
quantised AS (
  SELECT vec_id, label, array_to_string(list_transform(range(4), lambda i: CAST(sign(list_sum(CAST(embedding[16 * i + 1:16 * i + 16] AS DOUBLE[]))) AS INTEGER)), ',') AS k FROM embeddings),
grouped AS (
  SELECT k, count(*) AS n, min(vec_id) AS first_id, count(DISTINCT label) AS labels, count(DISTINCT label % 2) AS parities, max(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS zero
  FROM quantised GROUP BY k)"""

PAIRED = f"""
WITH {TOP1}, {SHORT1}, {TOKENS},
hit AS (
  SELECT q.level, q.vec_id,
    max(CASE WHEN EXISTS (SELECT 1 FROM tokens a JOIN tokens b ON a.token = b.token AND a.level = b.level WHERE a.level = q.level AND a.vec_id = q.vec_id AND b.vec_id = t.neighbour) THEN 1.0 ELSE 0.0 END) AS x,
    max(CASE WHEN EXISTS (SELECT 1 FROM tokens a JOIN tokens b ON a.token = b.token AND a.level = b.level WHERE a.level = q.level AND a.vec_id = q.vec_id AND b.vec_id = s.neighbour) THEN 1.0 ELSE 0.0 END) AS y
  FROM annotated q JOIN top1 t ON t.query = q.vec_id JOIN short1 s ON s.query = q.vec_id GROUP BY 1, 2),
d AS (SELECT level, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(y - x AS DOUBLE) AS d FROM hit)
SELECT level, count(*) AS annotated_query_count, round(avg(x), 6) AS first_precision, round(avg(y), 6) AS second_precision, round(avg(d), 6) AS delta,
  round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS high,
  count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS worsened, count(*) FILTER (d = 0) AS unchanged
FROM d GROUP BY level"""

def _metrics(neighbours: str, name: str) -> str:
    return f"""WITH {neighbours}, {TOKENS}, ks AS (SELECT * FROM (VALUES (1), (5), (10)) v(k)),
hit AS (
  SELECT q.level, q.vec_id, t.rank, max(CASE WHEN b.vec_id IS NOT NULL THEN 1 ELSE 0 END) AS hit
  FROM annotated q JOIN {name} t ON t.query = q.vec_id JOIN tokens a ON a.level = q.level AND a.vec_id = q.vec_id
  LEFT JOIN tokens b ON b.level = a.level AND b.token = a.token AND b.vec_id = t.neighbour GROUP BY 1, 2, 3),
own AS (SELECT level, k, vec_id, sum(hit) AS n, max(hit) AS any_hit FROM hit, ks WHERE rank <= k GROUP BY 1, 2, 3),
found AS (SELECT level, k, sum(n) AS n, sum(any_hit) AS h FROM own GROUP BY 1, 2),
total AS (SELECT CAST(count(*) - 1 AS DOUBLE) AS c FROM embeddings),
chance AS (
  SELECT level, k, count(*) AS q, avg(matches / c) AS rp, avg(1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(k), lambda d: (c - matches - d) / (c - d))), lambda x, y: x * y)) AS rh
  FROM matches, ks, total GROUP BY 1, 2)
SELECT level, CAST(k AS INTEGER) AS k, q AS annotated_query_count, round(n / (q * k), 6) AS precision, round(h / q, 6) AS hit_rate, round(rp, 6) AS random_precision, round(rh, 6) AS random_hit_rate, round(n / (q * k) / rp, 6) AS lift
FROM chance JOIN found USING (level, k)"""


PUBLISHED = (
    RESOLVED
    + """,
whole AS (SELECT *, CASE WHEN record_id % 3 <> 0 THEN label END AS lab FROM resolved),
kept AS (SELECT canonical_id, string_agg(CAST(record_id AS VARCHAR), ';' ORDER BY record_id) AS ids, string_agg(DISTINCT lab, ';' ORDER BY lab) AS labs, max(CASE WHEN record_id = canonical_id THEN status END) AS status FROM whole GROUP BY 1),
participants AS (
  SELECT record_id, side, compound_id, canonical, max(members.status) AS status FROM members WHERE record_id IN (SELECT canonical_id FROM kept) GROUP BY 1, 2, 3, 4)"""
)

SHORT10 = _neighbours("short10", "CAST({}.embedding[1:16] AS DOUBLE[])", 10)

SQL = {
    "scan_project_cast": "SELECT 'ORD:' || o_orderkey AS order_id, o_orderkey AS order_number, CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS priority FROM orders WHERE o_totalprice > 100000",
    "filter_prefix_exists": f"WITH {MEMBERS} SELECT record_id, CAST(count(*) AS INTEGER) AS n FROM members GROUP BY record_id HAVING max(CASE WHEN compound_id LIKE 'Brand#1%' THEN 1 ELSE 0 END) = 1",
    "enum_recode": "SELECT CASE event_type WHEN 'click' THEN 'left_to_right' WHEN 'view' THEN 'right_to_left' WHEN 'purchase' THEN 'reversible' ELSE 'undefined' END AS direction, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type <> 'error' GROUP BY 1",
    "participants_agg": f"""WITH {MEMBERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id, side, compound_id, canonical ORDER BY l_linenumber, l_partkey) AS r FROM members)
SELECT record_id, side, compound_id, canonical, CAST(count(*) * CASE WHEN side = 'reactant' THEN -1 ELSE 1 END AS DOUBLE) AS coefficient,
  max(CASE WHEN r = 1 THEN original END) AS original, max(status) AS status, false AS missing FROM ranked GROUP BY 1, 2, 3, 4""",
    "record_fields": f"""WITH {PUBLISHED}, i AS (SELECT canonical_id, string_agg(DISTINCT 'ORD:' || (record_id * 10 + n), ';' ORDER BY 'ORD:' || (record_id * 10 + n)) AS source_ids FROM whole, range(4) r(n) GROUP BY 1),
c AS (SELECT record_id, CAST(count(*) AS INTEGER) AS n FROM participants GROUP BY 1)
SELECT canonical_id AS record_id, 'ORD_EQ:' || canonical_id * 10 AS equivalence_group_id, source_ids, ids AS members, ids AS provenance, labs AS labels, labs IS NULL AS labels_missing,
  canonical_id % 2 <> 0 AND canonical_id % 3 <> 0 AND canonical_id % 5 <> 0 AS direction_missing, 'ORD:' || (canonical_id * 10 + 3) AS reversible, c.n AS n_participants
FROM kept JOIN i USING (canonical_id) JOIN c ON c.record_id = canonical_id""",
    "record_fields_rest": f"""WITH {PUBLISHED}, p AS (
  SELECT record_id, side, compound_id, CASE canonical WHEN 'ECONOMY' THEN 'CCO' WHEN 'STANDARD' THEN 'CC=O' WHEN 'SMALL' THEN 'O' WHEN 'MEDIUM' THEN 'CC(=O)O' WHEN 'LARGE' THEN 'c1ccccc1O' WHEN 'PROMO' THEN '[NH4+]' END AS canonical, count(*) AS n, arg_min(original, struct_pack(a := l_linenumber, b := l_partkey)) AS original, max(members.status) AS status
  FROM members WHERE record_id IN (SELECT canonical_id FROM kept) GROUP BY 1, 2, 3, 4),
o AS (SELECT *, CASE WHEN side = 'reactant' THEN 0 ELSE 1 END AS side_order, CASE WHEN side = 'reactant' THEN -n ELSE n END AS coefficient,
  CASE WHEN canonical IS NULL THEN 'failed' ELSE status END AS state FROM p),
t AS (SELECT record_id,
  string_agg(concat_ws(',', compound_id, original, canonical, state, CAST(canonical IS NULL AS VARCHAR), '-', coefficient, coefficient, side, '-', CASE WHEN compound_id = 'Brand#3' THEN compound_id ELSE '-' END,
    CAST(compound_id <> 'Brand#3' AS VARCHAR), 'true', 'true'), ';' ORDER BY side_order, compound_id, canonical NULLS FIRST, coefficient) AS participants,
  coalesce(string_agg(coalesce(canonical, ''), '.' ORDER BY compound_id, canonical NULLS FIRST, coefficient) FILTER (side = 'reactant'), '') || '>>' || coalesce(string_agg(coalesce(canonical, ''), '.' ORDER BY compound_id, canonical NULLS FIRST, coefficient) FILTER (side = 'product'), '') AS reaction_smiles
  FROM o GROUP BY 1)
SELECT k.canonical_id AS canonical_reaction_id, 'ORD:' || k.canonical_id * 10 AS master, 'ORD:' || (k.canonical_id * 10 + 1) AS left_to_right, 'ORD:' || (k.canonical_id * 10 + 2) AS right_to_left, participants, reaction_smiles,
  CAST(NULL AS VARCHAR) AS source_reaction_smiles, CAST(NULL AS VARCHAR) AS atom_mapped_reaction_smiles, 'undefined' AS direction, CAST(NULL AS VARCHAR) AS reaction_type,
  concat_ws(';', CASE WHEN k.canonical_id % 2 = 0 THEN 'left_to_right' END, CASE WHEN k.canonical_id % 3 = 0 THEN 'right_to_left' END, CASE WHEN k.canonical_id % 5 = 0 THEN 'reversible' END) AS supported_directions,
  k.canonical_id % 2 <> 0 AND k.canonical_id % 3 <> 0 AND k.canonical_id % 5 <> 0 AS direction_missing, '{{}}' AS direction_evidence_summary_json,
  k.status = 'F' AS is_balanced, CASE k.status WHEN 'F' THEN 'balanced' WHEN 'O' THEN 'imbalanced' ELSE 'unknown' END AS balance_check_status, CAST(NULL AS VARCHAR) AS balance_element_delta_json,
  CAST(0 AS BIGINT) AS balance_charge_delta, CAST(0 AS BIGINT) AS balance_unknown_atom_count, CAST(NULL AS VARCHAR) AS context, '{{"cust":["' || o_custkey % 3 || '"]}}' AS external_xrefs_json,
  r.strict_key AS canonical_key_sha256, r.loose_key AS loose_key_sha256
FROM kept k JOIN t ON t.record_id = k.canonical_id JOIN resolved r ON r.record_id = k.canonical_id JOIN orders ON o_orderkey = k.canonical_id""",
    "source_table": f"""WITH {RESOLVED} SELECT o_orderkey AS source_reaction_id, canonical_id AS canonical_reaction_id, canonical_id IS NOT NULL AS embedding_included,
  coalesce(dedup_status, 'excluded_missing_rxn') AS deduplication_status, CASE WHEN canonical_id IS NULL THEN 'rxn_lookup' ELSE 'parsed' END AS parse_status, CASE WHEN canonical_id IS NULL THEN 'no lines' END AS parse_error,
  concat_ws(';', 'ORD:' || o_orderkey * 10, 'ORD:' || (o_orderkey * 10 + 1), 'ORD:' || (o_orderkey * 10 + 2), 'ORD:' || (o_orderkey * 10 + 3)) AS direction_variant_ids,
  o_orderpriority AS ec_numbers, '{{"cust":["' || o_custkey || '"]}}' AS external_xrefs_json
FROM orders LEFT JOIN resolved ON record_id = o_orderkey""",
    "variant_table": f"""WITH {VARIANTS}, n AS (SELECT * FROM (VALUES ('left_to_right', 1), ('right_to_left', 2), ('reversible', 3)) v(direction, i)),
ids AS (SELECT canonical_id, direction, string_agg('CUS:' || (user_id * 10 + i), ';' ORDER BY 'CUS:' || (user_id * 10 + i)) AS directional_ids FROM masters, n GROUP BY 1, 2)
SELECT variant_id AS direction_variant_id, canonical_id AS canonical_reaction_id, direction, directional_ids, swap_sides, symmetrized AS reversible_symmetrization, evidence_count AS directional_evidence_count,
  has_evidence AS has_directional_evidence, evidence_by_database AS evidence_by_database_json, undefined_count AS undefined_evidence_count, semantics
FROM variants JOIN ids USING (canonical_id, direction)""",
    "coverage_full": f"""WITH {PUBLISHED}, p AS (SELECT avg(CASE WHEN compound_id = 'Brand#3' THEN 1.0 ELSE 0.0 END) AS cofactor FROM participants)
SELECT 1.0::DOUBLE AS reaction_smiles, 0.0::DOUBLE AS direction_defined, round(avg(CASE WHEN canonical_id % 2 = 0 OR canonical_id % 3 = 0 OR canonical_id % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS direction_evidence_available,
  round(avg(CASE WHEN labs IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ec_numbers, 0.0::DOUBLE AS reaction_type, 0.0::DOUBLE AS atom_map, 0.0::DOUBLE AS context,
  1.0::DOUBLE AS participant_compound_id, 1.0::DOUBLE AS participant_canonical_smiles, 0.0::DOUBLE AS participant_compartment, 0.0::DOUBLE AS participant_role, (SELECT round(cofactor, 6) FROM p) AS participant_cofactor_role FROM kept""",
    "report_counts": f"""WITH {PUBLISHED} SELECT count(*) AS reaction_count, CAST(0 AS BIGINT) AS failed_smiles_count, (SELECT count(*) FROM participants WHERE status = 'unsanitized') AS unsanitized_smiles_count,
  count(*) FILTER (status = 'O') AS imbalanced_reaction_count, count(*) FILTER (status NOT IN ('O', 'F')) AS unknown_balance_count FROM kept""",
    "corpus_index": f"""WITH {PUBLISHED}, l AS (SELECT DISTINCT canonical_id, lab FROM whole WHERE lab IS NOT NULL), v AS (SELECT lab, row_number() OVER (ORDER BY lab) AS i FROM (SELECT DISTINCT lab FROM l)),
n AS (SELECT canonical_id, string_agg(CAST(i AS VARCHAR), ';' ORDER BY i) AS label_index FROM l JOIN v USING (lab) GROUP BY 1), c AS (SELECT record_id, count(*) FILTER (compound_id = 'Brand#3') AS n FROM participants GROUP BY 1)
SELECT kept.canonical_id AS record_id, coalesce(label_index, '') AS label_index, CAST(c.n AS INTEGER) AS n_cofactors FROM kept LEFT JOIN n USING (canonical_id) JOIN c ON c.record_id = kept.canonical_id""",
    "vocab_sizes": f"""WITH {PUBLISHED} SELECT 'role' AS vocabulary, CAST(1 AS BIGINT) AS size UNION ALL SELECT 'compartment', 1 UNION ALL SELECT 'reaction_type', 1
UNION ALL SELECT 'cofactor', 1 + count(DISTINCT compound_id) FILTER (compound_id = 'Brand#3') FROM participants UNION ALL SELECT 'label', 1 + count(DISTINCT lab) FROM whole UNION ALL SELECT 'molecule', 1 + count(DISTINCT canonical) FROM participants""",
    "group_numbers": f"WITH {QUANTISED} SELECT row_number() OVER (ORDER BY n DESC, first_id) AS group_id, k AS vector_key, n AS group_size, first_id FROM grouped WHERE n > 1",
    "encoded_signatures": f"""WITH {MEMBERS}, p AS (
  SELECT record_id, CASE WHEN side = 'reactant' THEN 0 ELSE 1 END AS side, CAST(count(*) * CASE WHEN side = 'reactant' THEN -1 ELSE 1 END AS DOUBLE) AS c,
    sha256(CASE canonical WHEN 'ECONOMY' THEN 'CCO' WHEN 'STANDARD' THEN 'CC=O' WHEN 'SMALL' THEN 'O' WHEN 'MEDIUM' THEN 'CC(=O)O' WHEN 'LARGE' THEN 'c1ccccc1O' WHEN 'PROMO' THEN '[NH4+]' ELSE '*' END) AS m
  FROM members WHERE record_id IN (SELECT o_orderkey FROM orders) GROUP BY record_id, members.side, compound_id, canonical),
d AS (SELECT *, CASE WHEN record_id % 5 = 0 OR record_id % 6 = 0 THEN 2 WHEN record_id % 2 = 0 THEN 0 WHEN record_id % 3 = 0 THEN 1 ELSE 3 END AS direction FROM p),
l AS (SELECT record_id, direction, list(struct_pack(side := side, c := c, m := m) ORDER BY side, c, m) AS there, list(struct_pack(side := 1 - side, c := -c, m := m) ORDER BY 1 - side, -c, m) AS back FROM d GROUP BY 1, 2),
k AS (SELECT record_id, direction, CASE WHEN direction = 1 OR direction = 2 AND back < there THEN back ELSE there END AS core FROM l)
SELECT record_id, sha256('{{"direction_index":' || direction || ',"ec_indices":[],"participants":[' ||
  list_aggregate(list_transform(core, lambda x: '[' || x.side || ',' || CAST(x.c AS VARCHAR) || ',"' || x.m || '",0,0,0]'), 'string_agg', ',') || '],"reaction_type_index":0}}') AS signature FROM k""",
    "positional_zip": """WITH a AS (SELECT doc_id, string_split(text, ' ') AS l, string_split(source, 'c') AS r FROM documents),
e AS (SELECT doc_id, unnest(range(len(l))) AS p, l, r FROM a)
SELECT doc_id, CAST(p AS INTEGER) AS pos, l[p + 1] AS left_part, r[p + 1] AS right_part FROM e""",
    "change_log": f"WITH {MEMBERS} SELECT compound_id, 'high' AS confidence, count(*) AS n FROM members WHERE original IS DISTINCT FROM canonical GROUP BY 1",
    "coef_reduce_gcd": f"WITH {COEFFICIENTS} SELECT record_id, compound_id, coefficient FROM reduced",
    "canonical_keys": f"WITH {KEYS} SELECT record_id, strict_key FROM strict",
    "loose_keys": f"WITH {KEYS} SELECT record_id, loose_key FROM loose",
    "dedup_winners": f"""WITH {RESOLVED} SELECT canonical_id AS record_id, max(CASE WHEN record_id = canonical_id THEN group_size END) AS group_size,
  string_agg(CAST(record_id AS VARCHAR), ';' ORDER BY record_id) AS equivalent_ids, string_agg(DISTINCT label, ';' ORDER BY label) AS labels FROM resolved GROUP BY canonical_id""",
    "dedup_conflicts": f"WITH {RESOLVED} SELECT record_id, strict_key, group_size FROM resolved WHERE dedup_status = 'kept_conflict'",
    "dedup_idmap": f"""WITH {RESOLVED} SELECT o_orderkey AS source_id, canonical_id, coalesce(dedup_status, 'excluded_missing_rxn') AS status
FROM orders LEFT JOIN resolved ON record_id = o_orderkey""",
    "dedup_stats": f"""WITH {RESOLVED}, g AS (SELECT strict_key, count(*) AS n, count(DISTINCT label) AS labels, count(DISTINCT o_custkey % 3) AS refs, max(CASE WHEN dedup_status = 'kept_conflict' THEN 1 ELSE 0 END) AS clash FROM resolved JOIN orders ON o_orderkey = record_id GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS record_count, CAST(sum(CASE WHEN clash = 1 THEN n ELSE 1 END) AS BIGINT) AS retained_count, count(*) FILTER (n > 1) AS duplicate_group_count,
  count(*) FILTER (n > 1 AND labels > 1) AS label_conflict_group_count, count(*) FILTER (n > 1 AND refs > 1) AS xref_conflict_group_count, count(*) FILTER (clash = 1) AS conflict_group_count,
  CAST(sum(CASE WHEN clash = 1 THEN 0 ELSE n - 1 END) AS BIGINT) AS merged_count FROM g""",
    "loose_candidates": f"""WITH {RESOLVED} SELECT loose_key, string_agg(CAST(record_id AS VARCHAR), ';' ORDER BY record_id) AS record_ids, count(*) AS candidate_count, 'report_only_not_merged' AS action
FROM resolved WHERE record_id = canonical_id GROUP BY loose_key HAVING count(*) > 1""",
    "balance_status": f"""WITH {MEMBERS}, m AS (SELECT record_id, CASE WHEN side = 'reactant' THEN -1 ELSE 1 END AS sign, compound_id = 'Brand#25' OR p_size = 49 AS generic, p_size = 50 AS failed, p_size FROM members),
s AS (SELECT record_id, bool_or(generic) AS generic, bool_or(failed) AS failed, CAST(sum(sign * (p_size % 2)) AS BIGINT) AS charge,
  CAST(sum(CASE WHEN failed THEN 0 ELSE sign * p_size END) AS BIGINT) AS c, CAST(sum(CASE WHEN failed THEN 0 ELSE sign * (p_size % 3) END) AS BIGINT) AS h FROM m GROUP BY 1)
SELECT record_id, CASE WHEN NOT generic AND NOT failed THEN c = 0 AND h = 0 AND charge = 0 END AS is_balanced,
  CASE WHEN generic OR failed THEN 'unknown' WHEN c = 0 AND h = 0 AND charge = 0 THEN 'balanced' ELSE 'imbalanced' END AS status,
  CASE WHEN generic THEN 'generic_or_polymeric_participant' WHEN failed THEN 'smiles_parse_failure' END AS reason,
  CASE WHEN NOT generic AND NOT failed THEN charge END AS charge_delta,
  CASE WHEN NOT generic AND NOT failed THEN '{{' || concat_ws(',', CASE WHEN c <> 0 THEN '"C":' || c END, CASE WHEN h <> 0 THEN '"H":' || h END) || '}}' END AS element_delta FROM s""",
    "field_coverage": f"""WITH {MEMBERS}, o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT record_id FROM members)), m AS (SELECT * FROM members WHERE record_id IN (SELECT o_orderkey FROM orders))
SELECT (SELECT round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) FROM o) AS finished, (SELECT round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6) FROM o) AS urgent, CAST(0.0 AS DOUBLE) AS nothing,
  (SELECT round(avg(CASE WHEN compound_id <> '' THEN 1.0 ELSE 0.0 END), 6) FROM m) AS compound, (SELECT round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 6) FROM m) AS large,
  (SELECT round(avg(CASE WHEN canonical = 'ECONOMY' THEN 1.0 ELSE 0.0 END), 6) FROM m) AS economy""",
    "index_values": "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types FROM events GROUP BY 1",
    "index_xrefs": """WITH e AS (SELECT DISTINCT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
l AS (SELECT user_id, event_type, '"' || event_type || '":[' || string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) || ']' AS j FROM e GROUP BY 1, 2)
SELECT user_id, '{' || string_agg(j, ',' ORDER BY event_type) || '}' AS xrefs FROM l GROUP BY 1""",
    "direction_evidence": f"WITH {EVIDENCE} SELECT user_id, direction, database, count(*) AS n, min(value) AS first_id FROM evidence GROUP BY 1, 2, 3",
    "direction_variants": f"WITH {VARIANTS} SELECT * FROM variants",
    "direction_policy": f"""WITH {VARIANTS}, s AS (SELECT canonical_id, bool_or(direction = 'left_to_right' AND has_evidence) AS l, bool_or(direction = 'right_to_left' AND has_evidence) AS r, bool_or(direction = 'reversible' AND has_evidence) AS b FROM variants GROUP BY 1)
SELECT canonical_id, concat_ws(';', CASE WHEN l THEN 'left_to_right' END, CASE WHEN r THEN 'right_to_left' END, CASE WHEN b THEN 'reversible' END) AS directions,
  CASE WHEN b OR (l AND r) THEN 'reversible' WHEN l THEN 'left_to_right' WHEN r THEN 'right_to_left' ELSE 'undefined' END AS policy FROM s""",
    "direction_support_stats": f"""WITH {VARIANTS} SELECT count(DISTINCT canonical_id) AS record_count, count(DISTINCT canonical_id) FILTER (has_evidence) AS with_evidence,
  count(*) FILTER (has_evidence AND direction = 'left_to_right') AS left_to_right, count(*) FILTER (has_evidence AND direction = 'right_to_left') AS right_to_left, count(*) FILTER (has_evidence AND direction = 'reversible') AS reversible FROM variants""",
    "failures_left_join": """WITH b AS (SELECT DISTINCT 'm' || s_suppkey % 90 AS member FROM supplier), c AS (SELECT c_custkey AS record_id, 'm' || c_custkey % 120 AS member FROM customer)
SELECT record_id, CASE WHEN b.member IS NOT NULL THEN record_id END AS canonical_id, b.member IS NOT NULL AS included,
  CASE WHEN b.member IS NOT NULL THEN 'parsed' ELSE 'rxn_lookup' END AS parse_status, CASE WHEN b.member IS NULL THEN 'no member ' || c.member END AS parse_error
FROM c LEFT JOIN b ON b.member = c.member""",
    "semi_anti_split": "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'seen' ELSE 'held_out' END AS part FROM orders",
    "knn_top10": f"WITH {TOP10} SELECT query AS query_id, CAST(rank AS INTEGER) AS rank, neighbour AS neighbour_id, round(cosine, 6) AS cosine FROM top10",
    "knn_pivots": f"WITH {TOP10} SELECT query AS query_id, CAST(rank AS INTEGER) AS rank, neighbour AS neighbour_id, round(cosine, 6) AS cosine FROM top10",
    "rows_tree": """WITH r AS (SELECT sha256(CAST(json_object('o_custkey', o_custkey, 'o_orderkey', o_orderkey, 'o_orderpriority', o_orderpriority, 'o_orderstatus', o_orderstatus) AS VARCHAR)) AS d FROM orders),
c AS (SELECT d, count(*) AS n FROM r GROUP BY 1),
l2 AS (SELECT d[1:2] AS prefix, CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(d || ':' || n, ',' ORDER BY d)) AS digest FROM c GROUP BY 1),
l1 AS (SELECT prefix[1:1] AS prefix, CAST(sum(row_count) AS BIGINT) AS row_count, sha256(string_agg(l2.prefix || '=' || l2.digest, ',' ORDER BY l2.prefix)) AS digest FROM l2 GROUP BY l2.prefix[1:1]),
l0 AS (SELECT '' AS prefix, CAST(sum(row_count) AS BIGINT) AS row_count, sha256(string_agg(l1.prefix || '=' || l1.digest, ',' ORDER BY l1.prefix)) AS digest FROM l1)
SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1 AS level, * FROM l1 UNION ALL SELECT 0 AS level, * FROM l0""",
    "knn_top1": f"WITH {TOP1} SELECT query AS query_id, neighbour AS neighbour_id, round(cosine, 6) AS cosine FROM top1",
    "knn_global_top20": f"WITH {TOP10} SELECT query AS query_id, neighbour AS neighbour_id, round(cosine, 6) AS cosine FROM top10 ORDER BY round(top10.cosine, 12) DESC, query, neighbour LIMIT 20",
    "neighbour_labels": f"""WITH {TOP10} SELECT query AS query_id, CAST(rank AS INTEGER) AS rank, a.label % 2 = b.label % 2 AS level1_match, a.label = b.label AS exact_match
FROM top10 JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = neighbour""",
    "neighbour_table": f"""WITH {TOP10}, e AS (
  SELECT vec_id, CASE WHEN vec_id % 5 = 4 THEN [] WHEN vec_id % 7 = 0 THEN [label, (label + 1) % 10] ELSE [label] END AS x FROM embeddings),
t AS (SELECT vec_id, array_to_string(list_transform(x, lambda y: (y % 2) || '.' || (y % 5) || '.' || y), ';') AS ec, list_transform(x, lambda y: '' || (y % 2)) AS one, list_transform(x, lambda y: (y % 2) || '.' || (y % 5)) AS two, x FROM e)
SELECT query AS query_reaction_id, CAST(rank AS INTEGER) AS rank, neighbour AS neighbor_reaction_id, round(cosine, 6) AS cosine_similarity, coalesce(a.ec, '') AS query_ec, coalesce(b.ec, '') AS neighbor_ec,
  list_has_any(a.one, b.one) AS ec_level1_match, list_has_any(a.two, b.two) AS ec_level2_match, list_has_any(a.x, b.x) AS exact_ec_match
FROM top10 JOIN t a ON a.vec_id = query JOIN t b ON b.vec_id = neighbour""",
    "retrieval_metrics": _metrics(TOP10, "top10"),
    "ablation_metrics": f"""SELECT level, k, a.precision AS first_precision, b.precision AS second_precision, round(b.rp - a.rp, 6) AS precision_delta,
  a.hit_rate AS first_hit_rate, b.hit_rate AS second_hit_rate, round(b.rh2 - a.rh2, 6) AS hit_rate_delta
FROM ({_metrics(TOP10, "top10").replace("round(n / (q * k), 6) AS precision", "n / (q * k) AS rp, h / q AS rh2, round(n / (q * k), 6) AS precision")}) a
JOIN ({_metrics(SHORT10, "short10").replace("round(n / (q * k), 6) AS precision", "n / (q * k) AS rp, h / q AS rh2, round(n / (q * k), 6) AS precision")}) b USING (level, k)""",
    "ordered_ids_check": """SELECT 'same' AS rule, CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'shorter', count(*) FILTER (c_custkey IS NULL OR s_suppkey IS NULL) FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
    "random_baseline": f"WITH {TOKENS} SELECT level, vec_id, matches FROM matches",
    "ec_tokens": f"WITH {TOKENS} SELECT level, vec_id, string_agg(token, ';' ORDER BY token) AS tokens FROM tokens GROUP BY 1, 2",
    "paired_delta_ci": PAIRED,
    "vector_duplicates": f"WITH {QUANTISED} SELECT k AS vector_key, n AS group_size, first_id FROM grouped WHERE n > 1",
    "dup_histogram": f"WITH {QUANTISED} SELECT n AS group_size, count(*) AS groups FROM grouped WHERE n > 1 GROUP BY 1",
    "dup_excess": f"WITH {QUANTISED} SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_excess FROM grouped",
    "dup_diagnosis": f"""WITH {QUANTISED} SELECT count(*) AS group_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess, count(*) FILTER (labels = 1) AS groups_same_label, count(*) FILTER (parities = 1) AS groups_same_parity,
  CAST(coalesce(sum(CASE WHEN labels = 1 THEN n - 1 END), 0) AS BIGINT) AS excess_same_label, CAST(coalesce(sum(CASE WHEN parities = 1 THEN n - 1 END), 0) AS BIGINT) AS excess_same_parity, count(*) FILTER (zero = 1) AS groups_with_zero_label FROM grouped WHERE n > 1""",
    "text_exact_duplicates": """SELECT sha256(coalesce(text, '')) AS text_key, count(*) AS group_size, min(doc_id) AS first_id, count(DISTINCT source) = 1 AS same_source, count(DISTINCT lang) = 1 AS same_lang, bool_or(n_chars > 1000) AS has_long
FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "shared_identity": "SELECT p_name, count(DISTINCT p_brand) AS identity_count FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "norm_stats": """WITH n AS (SELECT sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)
SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS non_finite_count, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std FROM n""",
    "dim_std": """WITH e AS (SELECT unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM e GROUP BY 1""",
    "cosine_quantiles": f"""WITH {TOP1} SELECT round(min(cosine), 6) AS min, round(avg(cosine), 6) AS mean, round(max(cosine), 6) AS max, round(stddev_pop(cosine), 6) AS std, round(quantile_cont(cosine, 0.05), 6) AS p05,
  round(quantile_cont(cosine, 0.5), 6) AS p50, round(quantile_cont(cosine, 0.95), 6) AS p95, round(quantile_cont(cosine, 0.99), 6) AS p99, count(*) FILTER (cosine >= 0.5) AS count_ge_0_5 FROM top1""",
    "segment_sum": """WITH e AS (SELECT label, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(x), 6) AS x FROM e GROUP BY 1, 2""",
    "segment_softmax": """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, exp(l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY l_orderkey)) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(e / greatest(sum(e) OVER (PARTITION BY l_orderkey), 1e-12), 6) AS weight FROM e""",
    "segment_weighted_mean": "SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS DOUBLE) * CAST(l_quantity AS DOUBLE)) / greatest(sum(CAST(l_quantity AS DOUBLE)), 1) AS cents FROM lineitem GROUP BY 1",
    "segment_counts": "SELECT c_custkey, greatest(count(o_orderkey), 1) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "variance_loss": f"""WITH {VIEWS}, s AS (SELECT batch, view, dim, sqrt(var_pop(x) + 1e-4) AS s FROM long GROUP BY 1, 2, 3), p AS (SELECT batch, view, avg(greatest(1.0 - s, 0)) AS l FROM s GROUP BY 1, 2)
SELECT batch, round(avg(l), 6) AS loss FROM p GROUP BY 1""",
    "covariance_loss": f"""WITH {VIEWS}, c AS (SELECT p.batch, p.view, p.dim AS i, q.dim AS j, covar_samp(p.x, q.x) AS c FROM long p JOIN long q ON p.batch = q.batch AND p.view = q.view AND p.vec_id = q.vec_id GROUP BY 1, 2, 3, 4),
p AS (SELECT batch, view, sum(CASE WHEN i <> j THEN c * c ELSE 0 END) / 32 AS l FROM c GROUP BY 1, 2) SELECT batch, round(avg(l), 6) AS loss FROM p GROUP BY 1""",
    "info_nce": f"""WITH {VIEWS}, s AS (SELECT p.batch, p.vec_id AS i, q.vec_id AS j, list_inner_product(p.a, q.b) / 0.1 AS s FROM views p JOIN views q ON p.batch = q.batch),
r AS (SELECT batch, i, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY 1, 2 UNION ALL SELECT batch, j, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) FROM s GROUP BY 1, 2)
SELECT batch, round(avg(l), 6) AS loss FROM r GROUP BY 1""",
    "label_loss": f"""WITH {VIEWS}, x AS (SELECT batch, vec_id, x AS l, CASE WHEN dim = vec_id % 8 THEN 1.0 ELSE 0.0 END AS t FROM long WHERE view = 'a' AND vec_id % 3 <> 0)
SELECT batch, round(avg(greatest(l, 0) - l * t + ln(1 + exp(-abs(l)))), 6) AS loss FROM x GROUP BY 1""",
    "vocab_index": """WITH p AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS name FROM part), v AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT DISTINCT name FROM p WHERE name IS NOT NULL))
SELECT p_partkey, coalesce(i, 0) AS name_index FROM p LEFT JOIN v USING (name)""",
    "csr_pointers": """WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, n, CAST(sum(n) OVER (ORDER BY l_orderkey) AS BIGINT) AS e FROM g)
SELECT l_orderkey, n, e - n AS row_begin, e AS row_end FROM r""",
    "cumulative_share": """WITH g AS (SELECT p_brand, CAST(sum(p_size) AS DOUBLE) / (SELECT sum(p_size) FROM part) AS share FROM part GROUP BY 1)
SELECT row_number() OVER (ORDER BY share DESC, p_brand) AS position, p_brand, round(share, 6) AS share, round(sum(share) OVER (ORDER BY share DESC, p_brand ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM g""",
    "split_train_val": """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256(o_orderkey || '|42'), o_orderkey) AS position, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, position, CASE WHEN position <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'validation' ELSE 'train' END AS split FROM p""",
    "rank_monotone_check": f"""WITH {TOP10}, w AS (SELECT query, rank, cosine, lag(rank) OVER (PARTITION BY query ORDER BY rank) AS r, lag(cosine) OVER (PARTITION BY query ORDER BY rank) AS s FROM top10),
p AS (SELECT query, count(*) FILTER (rank <> coalesce(r, 0) + 1) AS a, count(*) FILTER (cosine > s) AS b, count(*) AS n FROM w GROUP BY 1)
SELECT CAST(sum(a) AS BIGINT) AS rank_violations, CAST(sum(b) AS BIGINT) AS score_violations, count(*) FILTER (n <> 10) AS incomplete_queries FROM p""",
    "constraint_suite": """SELECT 'quantity_positive' AS rule, count(*) FILTER (NOT l_quantity > 0) AS violations FROM lineitem
UNION ALL SELECT 'discount_small', count(*) FILTER (NOT l_discount <= 0.05) FROM lineitem
UNION ALL SELECT 'known_flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem
UNION ALL SELECT 'order_unique', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'line_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'three_variants', CAST(0 AS BIGINT)
UNION ALL SELECT 'line_has_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'all_finished', count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') FROM orders""",
    "embedding_wide": "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS embedding_{i}" for i in range(64)) + " FROM embeddings",
    "direction_counts": f"""WITH {MEMBERS}, r AS (SELECT DISTINCT record_id FROM members WHERE record_id IN (SELECT o_orderkey FROM orders)),
c AS (SELECT CASE WHEN record_id % 5 = 0 OR record_id % 6 = 0 THEN 'reversible' WHEN record_id % 2 = 0 THEN 'left_to_right' WHEN record_id % 3 = 0 THEN 'right_to_left' ELSE 'undefined' END AS direction FROM r)
SELECT v.direction, count(c.direction) AS n FROM (VALUES ('left_to_right'), ('right_to_left'), ('reversible'), ('undefined')) v(direction) LEFT JOIN c ON c.direction = v.direction GROUP BY 1""",
    "record_signatures": f"""WITH {MEMBERS}, p AS (
  SELECT record_id, side, CAST(count(*) * CASE WHEN side = 'reactant' THEN -1 ELSE 1 END AS DOUBLE) AS c,
    CASE canonical WHEN 'ECONOMY' THEN 'CCO' WHEN 'STANDARD' THEN 'CC=O' WHEN 'SMALL' THEN 'O' WHEN 'MEDIUM' THEN 'CC(=O)O' WHEN 'LARGE' THEN 'c1ccccc1O' WHEN 'PROMO' THEN '[NH4+]' END AS s
  FROM members WHERE record_id IN (SELECT o_orderkey FROM orders) GROUP BY record_id, side, compound_id, canonical),
d AS (SELECT *, CASE WHEN record_id % 5 = 0 OR record_id % 6 = 0 THEN 'reversible' WHEN record_id % 2 = 0 THEN 'left_to_right' WHEN record_id % 3 = 0 THEN 'right_to_left' ELSE 'undefined' END AS direction FROM p),
t AS (SELECT record_id, direction, CASE WHEN direction = 'right_to_left' THEN CASE side WHEN 'reactant' THEN 'product' ELSE 'reactant' END ELSE side END AS side, CASE WHEN direction = 'right_to_left' THEN -c ELSE c END AS c, s FROM d),
l AS (
  SELECT record_id, direction, list(struct_pack(side := side, c := c, s := s) ORDER BY side, c, s) AS there,
    list(struct_pack(side := CASE side WHEN 'reactant' THEN 'product' ELSE 'reactant' END, c := -c, s := s) ORDER BY CASE side WHEN 'reactant' THEN 'product' ELSE 'reactant' END, -c, s) AS back FROM t GROUP BY 1, 2),
k AS (SELECT record_id, direction, CASE WHEN direction = 'reversible' AND back < there THEN back ELSE there END AS core FROM l),
j AS (
  SELECT record_id, direction, '{{"direction":"' || direction || '","participants":[' || list_aggregate(list_transform(core, lambda x: '["' || x.side || '",' || CAST(x.c AS VARCHAR) || ',' || coalesce('"' || x.s || '"', 'null') || ',null]'), 'string_agg', ',') || ']' AS head,
    '[' || list_aggregate(list_transform(core, lambda x: 'true'), 'string_agg', ',') || ']' AS missing FROM k)
SELECT record_id, direction, sha256(head || '}}') AS structure, sha256(head || ',"cofactor_missing":' || missing || '}}') AS main, sha256(head || ',"labels":["' || o_orderpriority || '"]}}') AS legacy FROM j JOIN orders ON o_orderkey = record_id""",
    "cosine_histogram": f"""WITH {TOP1}, b AS (SELECT CAST(least(greatest(floor((cosine + 1.0) / 0.05), 0), 39) AS BIGINT) AS bin FROM top1)
SELECT bin, -1.0 + bin * CAST(0.05 AS DOUBLE) AS low, -1.0 + (bin + 1) * CAST(0.05 AS DOUBLE) AS high, count(*) AS n FROM b GROUP BY 1""",
    "one_hot": "SELECT vec_id, CASE label WHEN 0 THEN '1000' WHEN 1 THEN '0100' WHEN 2 THEN '0010' ELSE '0001' END AS hot FROM embeddings",
    "stage_ranges": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS given FROM embeddings),
t AS (
  SELECT label, 'given' AS stage, given AS x FROM v UNION ALL SELECT label, 'rounded', list_transform(given, lambda x: round(x, 1)) FROM v
  UNION ALL SELECT label, 'signs', list_transform(given[1:4], lambda x: CAST(sign(x) AS DOUBLE)) FROM v UNION ALL SELECT label, 'length', [CAST(len(given) AS DOUBLE)] FROM v),
u AS (SELECT label, stage, count(DISTINCT x) AS n FROM t GROUP BY ALL),
e AS (SELECT label, stage, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM t),
r AS (SELECT label, stage, max(w) AS w FROM (SELECT label, stage, i, max(c) - min(c) AS w FROM e GROUP BY ALL) GROUP BY ALL)
SELECT label, (SELECT count(*) FROM v WHERE v.label = u.label) AS group_size,
  max(n) FILTER (stage = 'given') AS given_unique, max(n) FILTER (stage = 'rounded') AS rounded_unique, max(n) FILTER (stage = 'signs') AS signs_unique, max(n) FILTER (stage = 'length') AS length_unique,
  max(w) FILTER (stage = 'given') AS given_range, max(w) FILTER (stage = 'rounded') AS rounded_range, max(w) FILTER (stage = 'signs') AS signs_range, max(w) FILTER (stage = 'length') AS length_range,
  CASE WHEN given_unique = 1 THEN 'given' WHEN rounded_unique = 1 THEN 'rounded' WHEN signs_unique = 1 THEN 'signs' WHEN length_unique = 1 THEN 'length' ELSE 'not_exact_before_output' END AS first_collapsed
FROM u JOIN r USING (label, stage) GROUP BY label""",
}
