"""DuckDB SQL for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

from ..functions.scalars import DECOY_PREFIXES, RESIDUE_COEFFICIENTS
from .views import SQL

ORACLES: dict[str, str] = {}

DECOY = "'(?i)^(" + "|".join(DECOY_PREFIXES) + ")'"


def _with(view: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}psm AS MATERIALIZED ({SQL[view]}\n){body}"


def _q(source: str, keys: str = "", pi0: str | None = None) -> str:
    """CTEs ending in q, which has all of source and q."""
    part = f"PARTITION BY {keys} " if keys else ""
    pi0 = pi0 or f"(CASE WHEN sum((label > 0)::INT) OVER ({part}) > 0 THEN least(sum((label < 0)::INT) OVER ({part})::DOUBLE / sum((label > 0)::INT) OVER ({part}), 1.0) ELSE 1.0 END)"
    return f""", run AS (
  SELECT *, sum((label > 0)::INT) OVER ({part}ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) AS t,
    sum((label < 0)::INT) OVER ({part}ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) AS d, {pi0} AS pi0 FROM {source}
), fdr AS (
  SELECT *, CASE WHEN t > 0 THEN least(pi0 * d / t, 1.0) ELSE 1.0 END AS f FROM run
), q AS (
  SELECT *, min(f) OVER ({part}ORDER BY score, row_id DESC ROWS UNBOUNDED PRECEDING) AS q FROM fdr
)"""


def oracle(name: str, view: str, body: str, recursive: bool = False) -> None:
    ORACLES[name] = _with(view, body, recursive)


YIELD = "count(*) FILTER (WHERE label > 0 AND q < 0.01)"
CORE = "CASE WHEN length(peptide) - length(replace(peptide, '.', '')) >= 2 THEN regexp_extract(peptide, '^[^.]*\\.(.*)\\.[^.]*$', 1, 's') ELSE peptide END"
RT = " + ".join(f"({k})::DOUBLE * (length(core) - length(replace(core, '{a}', '')))" for a, k in RESIDUE_COEFFICIENTS.items() if k)
NAMES = "list_filter(string_split_regex({0}, '[\t ;]'), lambda x: x <> '')"
PI0 = "CASE WHEN count(*) FILTER (WHERE label > 0) > 0 THEN least(count(*) FILTER (WHERE label < 0)::DOUBLE / count(*) FILTER (WHERE label > 0), 1.0) ELSE 1.0 END"

oracle("label_counts_pi0", "psm_events", f" SELECT count(*) FILTER (WHERE label > 0) AS targets, count(*) FILTER (WHERE label < 0) AS decoys, {PI0} AS pi0 FROM psm")
for _name in ("psm_qvalues", "psm_qvalues_two_pass"):
    oracle(_name, "psm_events", _q("psm") + " SELECT row_id, label, score, q FROM q")
oracle("psm_qvalues_per_source", "psm_events", _q("psm", "source") + " SELECT row_id, source, q FROM q")
oracle("psm_accepted_q01", "psm_events", _q("psm") + " SELECT row_id, score, q, peptide, proteins FROM q WHERE label > 0 AND q < 0.01")
oracle("yield_sweep", "psm_events", _q("psm") + " SELECT c::DOUBLE AS cut, (SELECT count(*) FROM q WHERE label > 0 AND q < c) AS targets FROM (SELECT unnest([0.001, 0.005, 0.01, 0.02, 0.05, 0.1]::DOUBLE[]) AS c)")
# each edge of the lower hull of the running decoys goes to the point of the least slope, the farthest of equals
oracle(
    "psm_pep_isotonic", "psm_events",
    """, pts AS MATERIALIZED (
    SELECT row_id, row_number() OVER w AS i, sum((label < 0)::INT) OVER w AS d FROM psm WINDOW w AS (ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)
  ), hull(a, i, d, slope) AS (
    SELECT 0::BIGINT, 0::BIGINT, 0::HUGEINT, 0::DOUBLE
    UNION ALL
    SELECT h.i, x.n.i, x.n.d, (x.n.d - h.d)::DOUBLE / (x.n.i - h.i)
    FROM (SELECT h.i AS at, arg_min({'i': p.i, 'd': p.d}, ((p.d - h.d)::DOUBLE / (p.i - h.i), -p.i)) AS n FROM hull h JOIN pts p ON p.i > h.i GROUP BY h.i) x
    JOIN hull h ON h.i = x.at
  ) SELECT row_id, round(least(2 * (SELECT """ + PI0 + """ FROM psm) * slope, 1), 6) AS pep FROM pts JOIN hull ON pts.i > hull.a AND pts.i <= hull.i""",
    recursive=True,
)
oracle(
    "bayes_qvalues", "psm_events",
    """, b AS (SELECT row_id, label < 0 AS is_decoy, round(1 / (1 + abs(score) / 100), 2) AS pep FROM psm)
  SELECT row_id, is_decoy, pep, round(sum(pep) OVER w / count(*) OVER w, 6) AS q FROM b WINDOW w AS (PARTITION BY is_decoy ORDER BY pep RANGE UNBOUNDED PRECEDING)""",
)
BEST = f""", core AS (SELECT *, {CORE} AS core FROM psm), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, core ORDER BY score DESC, row_id) AS r FROM core) WHERE r = 1)"""
oracle("peptide_rollup", "psm_events", BEST + " SELECT label, core, row_id, score FROM best")
oracle("peptide_qvalues", "psm_events", BEST + _q("best") + " SELECT label, core, row_id, score, q FROM q")
oracle("candidate_best", "psm_lines", " SELECT scan, label, peptide, row_id, score, source FROM psm QUALIFY row_number() OVER (PARTITION BY scan, label, peptide ORDER BY score DESC, row_id) = 1")
SUPPORT = """, s AS (SELECT scan, count(DISTINCT source) AS scan_engines FROM psm GROUP BY scan),
  c AS (SELECT scan, label, peptide, count(DISTINCT source) AS candidate_engines FROM psm GROUP BY scan, label, peptide),
  e AS (SELECT psm.*, scan_engines, candidate_engines FROM psm JOIN s USING (scan) JOIN c USING (scan, label, peptide))"""
oracle("engine_support", "psm_lines", SUPPORT + " SELECT row_id, scan_engines, candidate_engines FROM e")
BLOCKS = ", ".join(f"CASE WHEN source = '{e}' THEN features ELSE [0.0, 0.0, 0.0, 0.0]::DOUBLE[] END" for e in "ANR")
oracle(
    "ensemble_features", "psm_lines",
    SUPPORT + f""", f AS (SELECT row_id, list_concat([{', '.join(f"(source = '{e}')::INT::DOUBLE" for e in 'ANR')}], {BLOCKS}, [scan_engines::DOUBLE, candidate_engines::DOUBLE]) AS x FROM e)
  SELECT row_id, {', '.join(f'x[{k + 1}] AS f{k}' for k in range(17))} FROM f""",
)
oracle("join_pool_yield_per_source", "psm_events", _q("psm") + f" SELECT source, {YIELD} AS accepted FROM q GROUP BY source")
oracle(
    "size_interleaved_order", "psm_events",
    """, s AS (SELECT scan::VARCHAR AS name, count(*) AS size FROM psm GROUP BY scan), d AS (SELECT *, row_number() OVER (ORDER BY size DESC, name) AS d, count(*) OVER () AS n FROM s)
  SELECT name, size, CAST(CASE WHEN d * 2 - 1 <= n THEN d * 2 - 1 ELSE (n - d + 1) * 2 END AS BIGINT) AS position FROM d""",
)
FOLDS = ", folds AS (SELECT *, CAST((row_number() OVER (ORDER BY md5('1:fold:' || row_id), row_id) - 1) % 3 AS INT) AS fold FROM psm)"
oracle("fold_assignment", "psm_events", FOLDS + " SELECT row_id, fold FROM folds")
oracle(
    "grouped_folds", "psm_events",
    """, g AS (SELECT DISTINCT scan, label, peptide FROM psm),
  h AS (SELECT *, CAST((row_number() OVER (ORDER BY md5('1:fold:' || scan || ':' || label || ':' || peptide), scan, label, peptide) - 1) % 3 AS INT) AS fold FROM g)
  SELECT row_id, fold FROM psm JOIN h USING (scan, label, peptide)""",
)
oracle(
    "train_cap_sample", "psm_events",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1:cap:' || row_id), row_id) AS r, least(sum((label > 0)::INT) OVER (), 500) AS pos FROM psm)
  SELECT row_id, label FROM r WHERE CASE WHEN label > 0 THEN r <= 500 ELSE r <= 1000 - pos END""",
)
oracle(
    "permute_feature", "psm_events",
    FOLDS + """, a AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('1:score:to:' || row_id), row_id) AS k FROM folds),
  b AS (SELECT fold, score AS permuted, row_number() OVER (PARTITION BY fold ORDER BY md5('1:score:' || row_id), row_id) AS k FROM folds)
  SELECT row_id, fold, permuted FROM a JOIN b USING (fold, k)""",
)
# a Feistel network of six turns over the ranks of a fold; what isn't under the fold's rows is put in again
_TURN = "(((r + ((key >> (6 * turn)::INT) & 1073741823)) * (1 + (key >> (4 * turn)::INT) % 2147483646)) % 2147483647)"
oracle(
    "permuted_features", "psm_lines",
    FOLDS + f""", k AS (
    SELECT folds.*, psm.features, row_number() OVER (PARTITION BY fold ORDER BY md5('1:features:' || row_id), row_id) - 1 AS k, count(*) OVER (PARTITION BY fold) AS n
    FROM folds JOIN psm USING (row_id)
  ), b AS MATERIALIZED (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE CAST(ceil(len(bin(n - 1)) / 2.0) AS INT) END AS half FROM k),
  f AS MATERIALIZED (
    SELECT fold, k, n, half, CAST(unnest(range(len(features))) AS INT) AS feature, unnest(features) AS x,
      ('0x' || substr(md5('1:' || CAST(unnest(range(len(features))) AS INT) || ':,1:' || fold), 1, 15))::BIGINT AS key FROM b
  ), w AS (
    SELECT fold, feature, k, n, half, key, x, k >> half AS l, k & ((1 << half) - 1) AS r, 0 AS turn, FALSE AS done FROM f WHERE n > 1
    UNION ALL
    SELECT fold, feature, k, n, half, key, x, CASE WHEN turn = 6 THEN ((l << half) | r) >> half ELSE r END,
      CASE WHEN turn = 6 THEN ((l << half) | r) & ((1 << half) - 1) ELSE xor(l, xor({_TURN}, {_TURN} >> 11) & ((1 << half) - 1)) END,
      CASE WHEN turn = 6 THEN 0 ELSE turn + 1 END, turn = 6 AND ((l << half) | r) < n
    FROM w WHERE NOT done
  ), sent AS (
    SELECT fold, feature, (l << half) | r AS k, x AS permuted FROM w WHERE done
    UNION ALL SELECT fold, feature, k, x FROM f WHERE n <= 1
  ) SELECT row_id, fold, feature, features[feature + 1] AS x, permuted FROM b JOIN sent USING (fold, k)""",
    recursive=True,
)
LONG = ", long AS (SELECT row_id, label, unnest(features) AS x, CAST(unnest(range(len(features))) AS INT) AS feature FROM psm)"
STATS = LONG + ", stats AS (SELECT feature, avg(x) AS mean, CASE WHEN stddev_pop(x) <= 1e-12 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM long GROUP BY feature)"
oracle("feature_stats", "psm_lines", STATS + " SELECT feature, round(mean, 6) AS mean, round(sd, 6) AS sd FROM stats")
_Z = ", ".join(f"round(max((x - mean) / sd) FILTER (WHERE feature = {k}), 5) AS z{k}" for k in range(4))
oracle("zscore", "psm_lines", STATS + f", n AS (SELECT *, row_number() OVER () AS u FROM psm), l AS (SELECT u, row_id, unnest(features) AS x, unnest(range(len(features))) AS feature FROM n) SELECT any_value(row_id) AS row_id, {_Z}, 1.0::DOUBLE AS z4 FROM l JOIN stats USING (feature) GROUP BY u")
oracle(
    "label_correlation", "psm_lines",
    LONG + """ SELECT feature, round(covar_pop(x, label) / greatest((CASE WHEN stddev_pop(x) <= 1e-12 THEN 1 ELSE stddev_pop(x) END) *
    (CASE WHEN stddev_pop(label) <= 1e-12 THEN 1 ELSE stddev_pop(label) END), 1e-12), 6) AS correlation FROM long GROUP BY feature""",
)
SINGLE = LONG + ", signed AS (SELECT row_id, label, feature, sign, x * sign AS score FROM long, (SELECT unnest([1, -1]) AS sign))" + _q("signed", "feature, sign") + f", y AS (SELECT feature, sign, {YIELD} AS n FROM q GROUP BY feature, sign)"
oracle("single_feature_yield", "psm_lines", SINGLE + " SELECT feature, sign, n FROM y")
oracle("initial_direction", "psm_emb", SINGLE + " SELECT feature, sign, n FROM y ORDER BY n DESC, feature, sign DESC LIMIT 1")
oracle(
    "top_k_features", "psm_emb",
    SINGLE + """, b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, sign DESC) = 1)
  SELECT feature, sign, n, CAST(row_number() OVER (ORDER BY n DESC, feature) AS INT) AS rank FROM b QUALIFY rank <= 8""",
)
oracle("linear_score_fixed_weights", "psm_lines", " SELECT row_id, round(0.0 + features[1] * 0.5 + features[2] * 0.0001 + features[3] * -2.0 + features[4] * 3.0, 6) AS score FROM psm")
oracle(
    "decoy_standardised_scores", "psm_events",
    FOLDS + """, s AS (SELECT avg(score) AS m, greatest(stddev_pop(score), 1e-12) AS s FROM folds WHERE fold <> 0 AND label < 0)
  SELECT row_id, round((score - m) / s, 6) AS standard FROM folds, s""",
)
oracle("rt_predict", "psm_docs", f", c AS (SELECT row_id, {CORE} AS core FROM psm) SELECT row_id, round({RT}, 6) AS rt FROM c")
FIT = f""", c AS (SELECT *, {CORE} AS core FROM psm), x AS (SELECT *, {RT} AS x, scan::DOUBLE AS y FROM c),
  g AS (SELECT source, count(*) FILTER (WHERE label > 0) AS nt FROM x GROUP BY source), u AS (SELECT x.* FROM x JOIN g USING (source) WHERE label > 0 OR nt = 0),
  s AS (SELECT source, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy FROM u GROUP BY source),
  f AS (SELECT source, n, mx, my, CASE WHEN n < 2 THEN 1.0 WHEN n * n * vx < 1e-9 THEN 0.0 ELSE cxy / vx END AS slope FROM s),
  fit AS (SELECT source, slope, CASE WHEN n < 2 THEN 0.0 ELSE my - slope * mx END AS intercept FROM f)"""
oracle("rt_fit", "psm_docs", FIT + " SELECT source, round(slope, 6) AS slope, round(intercept, 5) AS intercept FROM fit")
oracle("rt_features", "psm_docs", FIT + " SELECT row_id, round(abs(y - (slope * x + intercept)), 4) AS rt_abs_error, round((y - (slope * x + intercept)) * (y - (slope * x + intercept)), 1) AS rt_sq_error FROM x JOIN fit USING (source)")
oracle("core_peptide", "psm_events", f" SELECT row_id, {CORE} AS core FROM psm")
oracle("split_proteins", "psm_events", f", n AS (SELECT row_id, {NAMES.format('concat_ws(chr(9), proteins, concat(chr(82) || chr(69) || chr(86) || chr(95), proteins), chr(32) || chr(88) || chr(59) || chr(89))')} AS names FROM psm) SELECT row_id, array_to_string(names, '|') AS names, len(names)::BIGINT AS n FROM n")
oracle("decoy_flag_strip", "psm_events", f" SELECT row_id, regexp_matches(proteins, {DECOY}) AS is_decoy, regexp_replace(proteins, {DECOY}, '') AS stripped FROM psm")
oracle("pairing_key", "psm_events", f", n AS (SELECT row_id, [proteins, 'rev_P' || (scan % 5)] AS names FROM psm) SELECT row_id, array_to_string(list_sort(list_distinct(list_transform(names, lambda x: regexp_replace(x, {DECOY}, '')))), '|') AS key FROM n")
oracle("target_decoy_split", "psm_events", " SELECT CASE WHEN label > 0 THEN 'target' ELSE 'decoy' END AS kind, source, count(*) AS rows FROM psm GROUP BY 1, 2")
oracle(
    "odds_and_emission", "psm_events",
    """, p AS (SELECT row_id, scan, least(greatest(1 - least(greatest(round(1 / (1 + abs(score) / 100), 4), 1e-12), 1 - 1e-12), 1e-12), 1 - 1e-12) AS post FROM psm)
  SELECT row_id, round(least(greatest((post / (1 - post)) / (0.1::DOUBLE / 0.9::DOUBLE), 1e-12), 1e12), 4) AS lr, round(1 - 0.99::DOUBLE * pow(0.9::DOUBLE, scan % 4), 6) AS emission FROM p""",
)
oracle(
    "binomial_priors", "psm_events",
    """, n AS (SELECT row_id, scan % 5 + 1 AS n FROM psm), k AS (SELECT row_id, n, unnest(range(n + 1)) AS k FROM n)
  SELECT row_id, CAST(k AS INT) AS k, round((factorial(CAST(n AS INT)) / factorial(CAST(k AS INT)) / factorial(CAST(n - k AS INT)))::DOUBLE * pow(0.3::DOUBLE, k) * pow(0.7::DOUBLE, n - k), 6) AS p FROM k""",
)
oracle("fixed_point_text", "psm_events", " SELECT row_id, printf('%.6f', score) AS score FROM psm")
oracle("derived_ms_features", "psm_events", " SELECT row_id, round(0 - log10(greatest(abs(score), 1e-300)), 6) AS minus_log, repeat('0', CAST(scan % 7 AS INT)) || '1' || repeat('0', CAST(6 - scan % 7 AS INT)) AS charge FROM psm")
oracle(
    "lenient_numbers", "psm_events",
    """ SELECT row_id, CASE WHEN row_id % 3 = 0 THEN -1 ELSE 1 END * (scan * 10 + row_id % 10) AS n, CASE WHEN row_id % 4 = 0 THEN 0.0 ELSE scan::DOUBLE END AS x,
    CASE WHEN CASE WHEN row_id % 3 = 0 THEN -1 ELSE 1 END * (scan * 10 + row_id % 10) > 0 THEN 1 ELSE -1 END AS label FROM psm""",
)

EDGES = f""", ent AS (SELECT *, {NAMES.format('proteins')} AS names FROM psm), edges AS (SELECT DISTINCT row_id, unnest(names) AS protein FROM ent)"""
oracle("protein_edges", "graph_lines", f", ent AS (SELECT *, {NAMES.format('proteins')} AS names FROM psm) SELECT row_id, unnest(list_distinct(names)) AS protein FROM ent")
#: Orders link to the next only, so the first name of each component comes by walking links from each protein.
COMP = EDGES + """, lk AS (SELECT DISTINCT names[1] AS a, names[2] AS b FROM ent WHERE len(names) > 1), sym AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
  reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
  comp AS (SELECT p.protein, least(p.protein, coalesce(min(r.b), p.protein)) AS component FROM (SELECT DISTINCT protein FROM edges) p LEFT JOIN reach r ON p.protein = r.a GROUP BY p.protein)"""
oracle("protein_components", "graph_lines", COMP + " SELECT protein, component FROM comp", True)
GROUPS = COMP + f""", lead AS (SELECT component, score, least(greatest(pep, 1e-12), 1.0) AS pep FROM ent JOIN comp ON ent.names[1] = comp.protein),
  ev AS (SELECT component, min(pep) AS pep, arg_min(score, (pep, -score)) AS score, count(*) AS n_peptides FROM lead GROUP BY component),
  mem AS (SELECT component, list_sort(list(protein)) AS proteins, bool_or(regexp_matches(protein, {DECOY})) AS is_decoy FROM comp GROUP BY component),
  grp AS (SELECT ev.*, proteins, is_decoy, component AS row_id, CASE WHEN is_decoy THEN -1 ELSE 1 END AS label,
    array_to_string(list_sort(list_distinct(list_transform(proteins, lambda x: regexp_replace(x, {DECOY}, '')))), '|') AS key FROM ev JOIN mem USING (component)),
  pick AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, is_decoy, component) = 1 AS picked FROM grp)"""
oracle("group_evidence", "graph_lines", GROUPS + " SELECT component, array_to_string(proteins, ',') AS proteins, score, round(pep, 6) AS pep, n_peptides, is_decoy FROM grp", True)
oracle("picked_pairs", "graph_lines", GROUPS + " SELECT component, key, is_decoy, score, picked FROM pick", True)
oracle("picked_qvalues", "graph_lines", GROUPS + ", won AS (SELECT * FROM pick WHERE picked)" + _q("won", pi0="1.0") + " SELECT p.component, p.is_decoy, p.score, p.picked, coalesce(q.q, 1.0) AS q FROM pick p LEFT JOIN q ON p.component = q.component", True)
oracle("classic_count", "graph_lines", GROUPS + _q("grp", pi0="1.0") + f" SELECT {YIELD} AS accepted FROM q", True)
CLUSTERS = EDGES + f""", seen AS (SELECT protein, regexp_matches(protein, {DECOY}) AS is_decoy, list_sort(list(row_id)) AS peps, count(*) AS n_peptides FROM edges GROUP BY protein),
  clu AS (SELECT protein, is_decoy, min(protein) OVER w AS cluster, count(*) OVER w AS size, n_peptides FROM seen WINDOW w AS (PARTITION BY is_decoy, peps)),
  ce AS (SELECT DISTINCT row_id, cluster, size FROM edges JOIN clu USING (protein)), ne AS (SELECT row_id, count(*) AS parents FROM ce GROUP BY row_id)"""
oracle("protein_clusters", "graph_lines", CLUSTERS + " SELECT protein, is_decoy, cluster, size, n_peptides FROM clu")
oracle(
    "graph_diagnostics", "graph_lines",
    CLUSTERS + """, f AS (SELECT row_id, min(cluster) AS a FROM ce GROUP BY row_id), lk AS (SELECT DISTINCT a, cluster AS b FROM ce JOIN f USING (row_id) WHERE a <> cluster),
  sym AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
  cc AS (SELECT c.cluster, least(c.cluster, coalesce(min(r.b), c.cluster)) AS component FROM (SELECT DISTINCT cluster FROM ce) c LEFT JOIN reach r ON c.cluster = r.a GROUP BY c.cluster),
  per AS (SELECT component, count(*) AS e, count(DISTINCT cluster) + count(DISTINCT row_id) AS n FROM ce JOIN cc USING (cluster) GROUP BY component)
  SELECT count(*) AS components, count(*) FILTER (WHERE e + 1 = n) AS tree_components, count(*) FILTER (WHERE e + 1 <> n) AS loopy_components FROM per""",
    True,
)
oracle(
    "bayes_tree_posterior", "graph_lines",
    CLUSTERS + """, single AS (SELECT ce.* FROM ce WHERE cluster NOT IN (SELECT cluster FROM ce JOIN ne USING (row_id) WHERE parents > 1)),
  ev AS (SELECT cluster, size, least(greatest(1 - least(greatest(pep, 1e-12), 1 - 1e-12), 1e-12), 1 - 1e-12) AS post FROM single JOIN ent USING (row_id)),
  lr AS (SELECT cluster, size, least(greatest((post / (1 - post)) / (0.1::DOUBLE / 0.9::DOUBLE), 1e-12), 1e12) AS lr FROM ev),
  st AS (SELECT cluster, size, lr, unnest(range(size + 1)) AS k FROM lr),
  lg AS (SELECT cluster, k, sum(ln(greatest(1 + (lr - 1) * least(greatest(1 - 0.99::DOUBLE * pow(0.9::DOUBLE, k), 0), 1), 1e-300)))
    + ln((factorial(CAST(any_value(size) AS INT)) / factorial(CAST(k AS INT)) / factorial(CAST(any_value(size) - k AS INT)))::DOUBLE * pow(0.5::DOUBLE, any_value(size))) AS l FROM st GROUP BY cluster, k),
  w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY cluster)) AS w FROM lg)
  SELECT cluster, round(sum(w) FILTER (WHERE k = 0) / sum(w), 6) AS pep FROM w GROUP BY cluster""",
)

oracle("null_calibration", "psm_events", ", n AS (SELECT row_id, score, CASE WHEN substr(md5('1:null:' || row_id), 1, 1) IN ('8','9','a','b','c','d','e','f') THEN 1 ELSE -1 END AS label FROM psm WHERE label < 0)" + _q("n") + f" SELECT count(*) AS rows, {YIELD} AS accepted FROM q")
_W = "(p + {s} * 1.959963984540054 * sqrt(p * (1 - p) / accepted + 3.841458820694124 / (4 * accepted * accepted)) + 3.841458820694124 / (2 * accepted)) / (1 + 3.841458820694124 / accepted)"
oracle(
    "entrapment_fdp", "psm_events",
    _q("psm") + """, c AS (SELECT unnest([0.001, 0.005, 0.01, 0.02, 0.05, 0.1]::DOUBLE[]) AS cut),
  k AS (SELECT *, source AS method, scan % 3 = 0 AS pure, scan % 3 <> 0 AND scan % 5 = 0 AS mix FROM q),
  a AS (SELECT method, cut, count(*) FILTER (WHERE label > 0 AND q <= cut) AS accepted, count(*) FILTER (WHERE label > 0 AND q <= cut AND pure) AS "foreign", count(*) FILTER (WHERE label > 0 AND q <= cut AND mix) AS mixed,
    count(*) FILTER (WHERE label < 0 AND q <= cut AND NOT mix)::DOUBLE AS decoys, count(*) FILTER (WHERE label < 0 AND q <= cut AND NOT mix AND pure)::DOUBLE AS fd FROM k, c GROUP BY method, cut),
  b AS (SELECT *, CASE WHEN decoys > 0 THEN fd / decoys ELSE 0.5 END AS share, "foreign"::DOUBLE / nullif(accepted, 0) AS p FROM a)
  SELECT method, cut, accepted, "foreign", mixed, round(share, 6) AS foreign_share, CASE WHEN accepted = 0 THEN 0 ELSE round(p / nullif(share, 0), 6) END AS fdp,
    CASE WHEN accepted = 0 THEN 0 ELSE round(greatest(""" + _W.format(s="-1") + ", 0) / nullif(share, 0), 6) END AS fdp_low, CASE WHEN accepted = 0 THEN 0 ELSE round(least(" + _W.format(s="1") + ", 1) / nullif(share, 0), 6) END AS fdp_high FROM b",
)
oracle("residue_budget", "psm_docs", ", b AS (SELECT row_id, length(peptide) AS n, coalesce(sum(length(peptide)) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM psm) SELECT row_id, n::BIGINT AS residues FROM b WHERE before < 200000")
RUNS = """, base AS (SELECT scan::VARCHAR AS input, round(sum(score), 6) AS wall_s, count(*) FILTER (WHERE label > 0 AND score > 300) AS good, max(scan) AS m FROM psm GROUP BY scan),
  a AS (SELECT input, wall_s, good + m % 2 AS psms, good AS peptides, m AS rss_kb FROM base), b AS (SELECT input, wall_s, good + m % 3 AS psms, good AS peptides, m * 2 AS rss_kb FROM base)"""
oracle("run_totals", "psm_events", RUNS + " SELECT round(sum(wall_s), 6) AS wall_s, CAST(sum(psms) AS BIGINT) AS psms, CAST(sum(peptides) AS BIGINT) AS peptides, max(rss_kb) AS rss_kb, CAST(0 AS BIGINT) AS failed FROM a")
oracle(
    "run_comparison", "psm_events",
    RUNS + """, d AS (SELECT a.psms - b.psms AS d FROM a JOIN b USING (input)),
  t AS (SELECT (SELECT sum(wall_s) FROM b) / (SELECT sum(wall_s) FROM a) AS speed_up, (SELECT max(rss_kb) FROM a)::DOUBLE / (SELECT max(rss_kb) FROM b) AS memory_ratio,
    ((SELECT sum(psms) FROM a) - (SELECT sum(psms) FROM b))::DOUBLE * 100 / (SELECT sum(psms) FROM b) AS psm_change, 0.0::DOUBLE AS peptide_change)
  SELECT round(any_value(speed_up), 6) AS speed_up, round(any_value(memory_ratio), 6) AS memory_ratio, round(any_value(psm_change), 6) AS psm_change, any_value(peptide_change) AS peptide_change,
    count(*) FILTER (WHERE d > 0)::DOUBLE AS wins, count(*) FILTER (WHERE d = 0)::DOUBLE AS ties, count(*) FILTER (WHERE d < 0)::DOUBLE AS losses,
    median(d)::DOUBLE AS median_difference, min(d) FILTER (WHERE d < 0)::DOUBLE AS worst, max(d) FILTER (WHERE d > 0)::DOUBLE AS best FROM d, t""",
)
oracle(
    "unmatched_inputs", "psm_events",
    RUNS + """, x AS (SELECT DISTINCT input FROM a WHERE input NOT LIKE '1%'), y AS (SELECT DISTINCT input FROM b WHERE input NOT LIKE '%7')
  SELECT * FROM (SELECT input, 'candidate' AS only_in FROM x WHERE input NOT IN (SELECT input FROM y) ORDER BY input LIMIT 3)
  UNION ALL SELECT * FROM (SELECT input, 'baseline' AS only_in FROM y WHERE input NOT IN (SELECT input FROM x) ORDER BY input LIMIT 3)""",
)
oracle("duplicate_inputs", "psm_lines", " SELECT scan || '-' || peptide AS input, count(*) AS count FROM psm GROUP BY 1 HAVING count(*) > 1")
oracle("median_of_repeats", "psm_events", " SELECT scan, quantile_disc(score, 0.5) AS score FROM psm GROUP BY scan")
oracle(
    "results_class", "psm_events",
    """, c AS (SELECT scan % 4 = 0 AS a, scan % 3 = 0 AS b FROM psm), d AS (SELECT a AS pure, b AND NOT a AS mixed FROM c) SELECT pure, mixed, count(*) AS rows FROM d GROUP BY 1, 2""",
)
oracle(
    "parsed_lines", "psm_events",
    " SELECT row_id::VARCHAR AS spec_id, label, scan, peptide, proteins || CASE WHEN scan % 2 = 0 THEN chr(9) || 'Q2' ELSE '' END AS proteins, 0.0::DOUBLE AS f1, (scan % 50)::DOUBLE AS f2 FROM psm",
)
oracle(
    "repeated_lines_rescored", "psm_events",
    " SELECT row_id::BIGINT AS spec_id, label, scan, CAST(CASE WHEN scan % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS rows, CAST(CASE WHEN scan % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS ids FROM psm",
)
