"""One query for each operator over the projected tables, with SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .model import Graph
from .functions import scores
from .operators import activity, build, impact, rules, search, structure
from .sources.links import page_links
from .sources.tables import call_lines, project

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GRAPH_SQL = """
WITH RECURSIVE imported AS (SELECT DISTINCT s_nationkey AS nation, p_name AS module FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
files AS (SELECT 'file:' || n_nationkey AS id, n_name AS name, r_name || '/' || n_name AS rel_path,
    (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS functions_count, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS classes_count,
    (SELECT count(*) FROM imported WHERE nation = n_nationkey) AS imports_count FROM nation JOIN region ON n_regionkey = r_regionkey),
functions AS (SELECT 'func:' || s_suppkey AS id, s_name AS name, 'file:' || s_nationkey AS file_id FROM supplier),
methods AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
classes AS (SELECT 'class:' || c_custkey AS id, c_name AS name, 'file:' || c_nationkey AS file_id, coalesce(n, 0) AS methods_count FROM customer LEFT JOIN methods ON c_custkey = k),
imports AS (SELECT 'import:' || nation || ':' || module AS id, module, 'file:' || nation AS file_id FROM imported),
nodes AS (
    SELECT 'repo:' || r_regionkey AS id, 'Repository' AS label, r_name AS name, NULL AS rel_path, NULL AS module, NULL AS file_id, NULL::BIGINT AS functions_count, NULL::BIGINT AS classes_count, NULL::BIGINT AS imports_count, NULL::BIGINT AS methods_count, r_name AS shown FROM region
    UNION ALL SELECT id, 'File', name, rel_path, NULL, NULL, functions_count, classes_count, imports_count, NULL, rel_path FROM files
    UNION ALL SELECT id, 'Function', name, NULL, NULL, file_id, NULL, NULL, NULL, NULL, name FROM functions
    UNION ALL SELECT id, 'Class', name, NULL, NULL, file_id, NULL, NULL, NULL, methods_count, name FROM classes
    UNION ALL SELECT id, 'Import', NULL, NULL, module, file_id, NULL, NULL, NULL, NULL, module FROM imports),
calls AS (SELECT DISTINCT 'func:' || a.l_suppkey AS src, 'func:' || b.l_suppkey AS dst, 'FUNCTION_CALLS_FUNCTION' AS rel_type FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey),
inherits AS (SELECT 'class:' || c_custkey AS src, 'class:' || (c_custkey // 2) AS dst, 'CLASS_INHERITS_CLASS' AS rel_type FROM customer WHERE c_custkey >= 2),
contains_class AS (SELECT file_id AS src, id AS dst, 'FILE_CONTAINS_CLASS' AS rel_type FROM classes),
edges AS (
    SELECT 'repo:' || n_regionkey AS src, 'file:' || n_nationkey AS dst, 'REPOSITORY_CONTAINS_FILE' AS rel_type FROM nation
    UNION ALL SELECT file_id, id, 'FILE_CONTAINS_FUNCTION' FROM functions UNION ALL SELECT * FROM contains_class
    UNION ALL SELECT file_id, id, 'FILE_IMPORTS_MODULE' FROM imports UNION ALL SELECT * FROM inherits UNION ALL SELECT * FROM calls),
arcs AS (SELECT src AS a, dst AS b, src || '|' || rel_type || '|' || dst AS eid FROM edges),
both_ways AS (SELECT a, b, eid FROM arcs UNION ALL SELECT b, a, eid FROM arcs),
walk2 AS (SELECT a AS node, b AS target FROM arcs UNION SELECT x.a, y.b FROM arcs x JOIN arcs y ON x.b = y.a AND x.eid <> y.eid),
call_arcs AS (SELECT src AS a, dst AS b, src || '|' || dst AS eid FROM calls), call_ways AS (SELECT a, b, eid FROM call_arcs UNION ALL SELECT b, a, eid FROM call_arcs),
commits AS (SELECT o_orderkey::VARCHAR AS sha, c_name AS author_name, upper(c_name) || '@example.com' AS author_email, lower(upper(c_name) || '@example.com') AS email, o_orderdate AS committed_at, o_orderstatus = 'P' AS is_merge FROM orders JOIN customer ON o_custkey = c_custkey),
commit_files AS (SELECT DISTINCT l_orderkey::VARCHAR AS sha, p_brand || '/' || p_name AS path FROM lineitem JOIN part ON l_partkey = p_partkey),
contributor_files AS (SELECT email, path, count(*) AS n, max(committed_at) AS last_touch FROM commits JOIN commit_files USING (sha) WHERE NOT is_merge GROUP BY 1, 2),
modules AS (SELECT split_part(rel_path, '/', 1) AS module_name, count(*) AS file_count, sum(functions_count)::BIGINT AS functions_total, sum(classes_count)::BIGINT AS classes_total, sum(imports_count)::BIGINT AS imports_total FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a Graph as a query."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(project(spark, sf_dir))
        if sql is not None:
            SQL[name] = GRAPH_SQL + ("" if sql.startswith(",") else "\n") + sql
        return f

    return add


query("q1_nodes", "SELECT id, shown AS label, lower(label) AS type, functions_count, classes_count, imports_count FROM nodes")(structure.nodes_scan)
query("q2_edges", "SELECT src || '-' || rel_type || '-' || dst AS id, src AS source, dst AS target, rel_type AS type FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")(structure.edges_scan)
query("q3_graph", "SELECT 'node' AS kind, id, lower(label) AS type FROM nodes UNION ALL SELECT 'edge', src || '-' || rel_type || '-' || dst, rel_type FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")(structure.whole_graph)
query("q4_find_target", "SELECT id, shown AS label, lower(label) AS type FROM nodes WHERE coalesce(contains(name, '00007'), false) OR coalesce(contains(rel_path, '00007'), false) OR coalesce(contains(module, '00007'), false) ORDER BY id LIMIT 1")(lambda g: structure.find_target(g, "00007"))
query("q5_upstream", "SELECT f.id AS target, x.n AS id FROM functions f JOIN (SELECT a, b AS n FROM arcs UNION SELECT x.a, y.b FROM arcs x JOIN arcs y ON x.b = y.a AND x.eid <> y.eid) x ON x.a = f.id")(lambda g: structure.upstream(g, "Function"))
query("q6_downstream", "SELECT target, node AS id FROM walk2 JOIN functions ON target = id")(lambda g: structure.downstream(g, "Function"))
query("q7_neighbour_files", "SELECT DISTINCT a AS id, rel_path AS value FROM both_ways JOIN files ON b = files.id")(lambda g: structure.neighbours(g, "File", "rel_path"))
query("q8_neighbour_functions", "SELECT DISTINCT a AS id, name AS value FROM both_ways JOIN functions ON b = functions.id")(lambda g: structure.neighbours(g, "Function", "name"))
CALL_FAR = """, far AS (
    SELECT DISTINCT x.a AS id, y.b AS node FROM call_ways x JOIN call_ways y ON x.b = y.a AND x.eid <> y.eid
    UNION SELECT x.a, z.b FROM call_ways x JOIN call_ways y ON x.b = y.a AND x.eid <> y.eid JOIN call_ways z ON y.b = z.a AND z.eid <> y.eid AND z.eid <> x.eid)"""
query("q9_call_neighbourhood", CALL_FAR + "SELECT DISTINCT far.id, name AS value FROM far JOIN functions f ON f.id = node")(structure.call_neighbourhood)
CLASS_NEAR = """, parts AS (SELECT * FROM inherits UNION ALL SELECT * FROM contains_class UNION ALL SELECT * FROM calls), part_arcs AS (SELECT src AS a, dst AS b, src || '|' || rel_type || '|' || dst AS eid FROM parts),
    part_ways AS (SELECT a, b, eid FROM part_arcs UNION ALL SELECT b, a, eid FROM part_arcs),
    class_near AS (SELECT a AS id, b AS node FROM part_ways UNION SELECT x.a, y.b FROM part_ways x JOIN part_ways y ON x.b = y.a AND x.eid <> y.eid)"""
query("q10_class_neighbourhood", CLASS_NEAR + "SELECT DISTINCT n.id, c.name AS value FROM class_near n JOIN files f ON n.id = f.id JOIN classes c ON c.id = node")(structure.class_neighbourhood)
query("q12_non_empty_names", "SELECT id, name AS value FROM nodes WHERE name IS NOT NULL AND name <> ''")(lambda g: g.nodes().filter("name is not null and name <> ''").select("id", F.col("name").alias("value")))
query("q13_overview", "SELECT " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x.lower()}_count" for x in ("Repository", "File", "Function", "Class", "Import")) + " FROM nodes")(structure.overview)
query("q14_totals", "SELECT count(DISTINCT id) AS total_nodes, count(DISTINCT eid) AS total_edges FROM nodes LEFT JOIN arcs ON id = a")(structure.totals)
# Chains of four calls over all lines are too many for plain SQL (3 * 10**9 on sf0.01): tests/test_graph.py has the brute force.
query("q15_call_chains")(lambda g: structure.call_chains(g, g.nodes("File").filter(F.col("rel_path").contains("/NATION_1"))))
query("q16_properties", "SELECT id, label, shown, functions_count, classes_count, imports_count, methods_count FROM nodes WHERE label <> 'Repository'")(structure.properties)
query("q17_focus", "SELECT b AS id FROM both_ways WHERE a = 'file:3' UNION SELECT id FROM nodes WHERE id = 'file:3'")(lambda g: structure.focus(g, "file:3"))
query("q18_sidebar", "SELECT id, shown AS label, lower(label) AS type FROM nodes WHERE label = 'Function' AND contains(lower(shown), 'r#00000001')")(lambda g: structure.sidebar(g, "function", "R#00000001"))
query("q19_node_types", "SELECT DISTINCT lower(label) AS type FROM nodes")(structure.node_types)
query("q20_type_counts", "SELECT lower(label) AS type, count(*) AS n FROM nodes GROUP BY 1")(structure.type_counts)
query("q21_palette", """, hit AS (SELECT lower(label) AS type, shown, id, row_number() OVER (PARTITION BY label ORDER BY shown, id) AS place FROM nodes WHERE contains(lower(shown), 'r'))
    SELECT type, count(*) AS n, string_agg(shown, ',' ORDER BY place) FILTER (place <= 3) AS first_three FROM hit GROUP BY 1""")(lambda g: structure.palette(g, "R"))
query("a1_major_modules", "SELECT * FROM modules")(structure.major_modules)
HOT = """SELECT id, name, dependency_count, complexity, round(dependency_count / greatest(1, max(dependency_count) OVER ()), 6) AS criticality FROM (
    SELECT n.id, shown AS name, count(*) AS dependency_count, max({})::BIGINT AS complexity FROM walk2 JOIN nodes n ON target = n.id WHERE label = '{}' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5)"""
query("a2_file_hotspots", HOT.format("functions_count + classes_count", "File"))(structure.file_hotspots)
query("a3_function_hotspots", HOT.format("0", "Function"))(structure.function_hotspots)
query("a4_class_hotspots", HOT.format("methods_count", "Class"))(structure.class_hotspots)
FAN = "SELECT node, incoming_degree, CASE WHEN incoming_degree > 20 THEN 'critical' WHEN incoming_degree > 12 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT target AS node, count(*) AS incoming_degree FROM walk2 WHERE target IN (SELECT id FROM {}) GROUP BY 1 HAVING count(*) > 8 ORDER BY 2 DESC, 1 LIMIT 5)"
query("a5_excess_fan_in", FAN.format("files"))(structure.excess_fan_in)
query("a5_excess_fan_in_functions", FAN.format("functions"))(lambda g: structure.excess_fan_in(g, "Function"))
CHAINS = ", chain AS (SELECT 1::BIGINT AS depth, src AS start, dst AS node, src || '>' || dst AS path FROM inherits UNION ALL SELECT depth + 1, start, i.dst, path || '>' || i.dst FROM chain JOIN inherits i ON node = i.src)"
query("a6_inheritance_chains", CHAINS + "SELECT depth, start, path, CASE WHEN max(depth) OVER () > 5 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT depth, start, path FROM chain WHERE depth >= 3 ORDER BY depth DESC, path LIMIT 3)")(structure.inheritance_chains)
CLOSED = """, closed AS (SELECT x.a AS node, 2::BIGINT AS cycle_length FROM both_ways x JOIN both_ways y ON x.b = y.a AND y.b = x.a AND x.eid <> y.eid
    UNION SELECT x.a, 3 FROM both_ways x JOIN both_ways y ON x.b = y.a AND x.eid <> y.eid JOIN both_ways z ON y.b = z.a AND z.b = x.a AND z.eid <> y.eid AND z.eid <> x.eid)"""
query("a7_closed_trails", CLOSED + "SELECT * FROM closed ORDER BY node, cycle_length LIMIT 5")(structure.closed_trails)
query("a7_closed_trails_all", CLOSED + "SELECT * FROM closed")(lambda g: structure.closed_trails(g, None))
query("a8_coupled_files", "SELECT rel_path AS file, imports_count AS coupling_score FROM files WHERE imports_count > 5 ORDER BY 2 DESC, 1 LIMIT 5")(structure.coupled_files)
query("a9_degree_hotspots", "SELECT id, shown AS name, (SELECT count(*) FROM both_ways WHERE a = id) + coalesce(functions_count, 0) + coalesce(imports_count, 0) AS score FROM nodes WHERE label IN ('File', 'Function', 'Class') ORDER BY 3 DESC, 1 LIMIT 6")(structure.degree_hotspots)
query("a10_fallback_modules", "SELECT split_part(rel_path, '/', 1) AS module, count(*) AS files FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")(structure.fallback_modules)
COUNTS = ", counts AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM imports) AS imports, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM files) AS files)"
query("a11_density", COUNTS + "SELECT nodes, edges, round(edges / (nodes * (nodes - 1)), 9) AS density FROM counts")(structure.density)
query("a12_primary_language", "SELECT regexp_extract(rel_path, '[._]([^._/]+)$', 1) AS language, count(*) AS files FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(lambda g: structure.primary_language(g, r"[._]([^._/]+)$"))
ONBOARD = """, hot_files AS (SELECT n.id, rel_path AS name, count(*) AS d FROM walk2 JOIN files n ON target = n.id GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 3), hot_functions AS (SELECT n.id, name, count(*) AS d FROM walk2 JOIN functions n ON target = n.id GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 3)"""
query("a13_onboarding", ONBOARD + """SELECT 1 AS step, row_number() OVER (ORDER BY file_count DESC, module_name)::INT AS place, module_name AS item FROM (SELECT * FROM modules ORDER BY file_count DESC, module_name LIMIT 3)
    UNION ALL SELECT 2, row_number() OVER (ORDER BY d DESC, id)::INT, name FROM hot_files UNION ALL SELECT 3, row_number() OVER (ORDER BY d DESC, id)::INT, name FROM hot_functions UNION ALL SELECT 4, 1, 'tests/'""")(structure.onboarding)
IMPACT = """, sides AS (SELECT DISTINCT f.id AS target, 'up' AS side, x.n AS id FROM functions f JOIN (SELECT a, b AS n FROM arcs UNION SELECT x.a, y.b FROM arcs x JOIN arcs y ON x.b = y.a AND x.eid <> y.eid) x ON x.a = f.id
    UNION ALL SELECT target, 'down', node FROM walk2 JOIN functions ON target = functions.id), shown_sides AS (SELECT target, side, s.id, shown, lower(label) AS type FROM sides s JOIN nodes n ON s.id = n.id),
    scored AS (SELECT target, count(*) FILTER (side = 'up') AS upstream_count, count(*) FILTER (side = 'down') AS downstream_count, count(DISTINCT id) AS total_impacted, count(*) FILTER (type = 'file') AS files_, count(*) FILTER (type = 'class') AS classes_, count(*) FILTER (type = 'function') AS functions_ FROM shown_sides GROUP BY 1),
    risk AS (SELECT target, upstream_count, downstream_count, total_impacted, least(100, 20 + least(4 * upstream_count, 25) + least(5 * downstream_count, 35) + 2 * files_ + least(3 * classes_, 10) + least(2 * functions_, 8))::BIGINT AS risk_score FROM scored),
    leveled AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS level FROM risk)"""
query("r1_impact_scores", IMPACT + "SELECT * FROM leveled")(lambda g: impact.impact_scores(g, "Function"))
query("r20_impact_lists", IMPACT + "SELECT target, coalesce(string_agg(DISTINCT shown, ',' ORDER BY shown) FILTER (type = 'file'), '') AS files, coalesce(string_agg(DISTINCT shown, ',' ORDER BY shown) FILTER (type = 'function'), '') AS functions FROM shown_sides GROUP BY 1")(lambda g: impact.impact_lists(g, "Function"))
query("r21_explanations", IMPACT + """, named AS (SELECT target, side, shown, row_number() OVER (PARTITION BY target, side ORDER BY shown) AS k FROM (SELECT DISTINCT target, side, shown FROM shown_sides))
    SELECT l.target, level || ' risk; uses ' || coalesce(string_agg(shown, ', ' ORDER BY shown) FILTER (side = 'up'), '') || '; used by ' || coalesce(string_agg(shown, ', ' ORDER BY shown) FILTER (side = 'down'), '') AS explanation FROM leveled l JOIN named n ON l.target = n.target WHERE k <= 3 GROUP BY l.target, level""")(lambda g: impact.explanations(g, "Function"))
CHANGE = CALL_FAR + CLASS_NEAR + """, change AS (SELECT f.id, 'file' AS part, x.rel_path AS value FROM functions f JOIN both_ways w ON w.a = f.id JOIN files x ON x.id = w.b UNION SELECT f.id, 'function', x.name FROM functions f JOIN both_ways w ON w.a = f.id JOIN functions x ON x.id = w.b
    UNION SELECT far.id, 'indirect', f.name FROM far JOIN functions f ON f.id = node UNION SELECT n.id, 'class', c.name FROM class_near n JOIN functions f ON n.id = f.id JOIN classes c ON c.id = n.node)"""
query("r2_r3_change_simulation", CHANGE + """SELECT id, count(DISTINCT value) FILTER (part IN ('file', 'function')) AS direct, count(*) FILTER (part = 'indirect') AS indirect, count(DISTINCT value) AS total,
    least(100, greatest(20, 8 * count(*) FILTER (part = 'file') + 7 * count(*) FILTER (part = 'function') + 4 * count(*) FILTER (part = 'indirect') + 5 * count(*) FILTER (part = 'class') + 15))::BIGINT AS risk_score FROM change GROUP BY 1""")(lambda g: impact.change_simulation(g, "Function"))
RISK = CLOSED + CHAINS + """, top_files AS (SELECT target, count(*) AS d FROM walk2 WHERE target IN (SELECT id FROM files) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
    risks AS (SELECT least(100, 30 + CASE WHEN (SELECT count(*) FROM files) / (SELECT count(*) FROM modules) > 20 THEN 20 WHEN (SELECT count(*) FROM files) / (SELECT count(*) FROM modules) > 10 THEN 10 ELSE 0 END + CASE WHEN EXISTS (SELECT * FROM top_files) THEN 15 ELSE 0 END
      + coalesce((SELECT CASE WHEN max(d) > 20 THEN 25 WHEN max(d) > 12 THEN 15 WHEN max(d) > 8 THEN 10 ELSE 0 END FROM top_files), 0) + coalesce((SELECT CASE WHEN max(depth) > 5 THEN 15 WHEN max(depth) >= 3 THEN 10 ELSE 0 END FROM chain), 0) + CASE WHEN EXISTS (SELECT * FROM closed) THEN 25 ELSE 0 END)::BIGINT AS risk_score)"""
query("r4_architecture_risk", RISK + "SELECT * FROM risks")(structure.architecture_risk)
query("r23_summary", RISK + """SELECT (SELECT count(*) || ' modules, ' || min_by(module_name, (-file_count, module_name)) FROM modules) || ' the largest; ' || (SELECT name FROM top_files JOIN files ON target = files.id ORDER BY d DESC, target LIMIT 1)
    || ' most depended on; risk ' || CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'moderate' ELSE 'low' END || ' (' || risk_score || ' of 100)' AS summary FROM risks""")(structure.summary)
query("r9_health", RISK + COUNTS + """SELECT round(100 - least(greatest(round(edges / (nodes * (nodes - 1)), 9) * 40, 0), 30) - least(greatest((SELECT avg(c) FROM (SELECT round(d / max(d) OVER (), 6) AS c, target FROM top_files ORDER BY 1 DESC, target LIMIT 3)) * 20, 0), 20) - least(greatest((SELECT risk_score FROM risks) / 2, 0), 30), 3) AS health FROM counts""")(structure.health)
query("r10_complexity", COUNTS + ", s AS (SELECT 0.3::DOUBLE * nodes + 0.4::DOUBLE * edges + 0.2::DOUBLE * imports + 0.1::DOUBLE * functions / greatest(files, 1) AS score FROM counts) SELECT round(score, 3) AS score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 30 THEN 'Moderate' ELSE 'Low' END AS level FROM s")(structure.complexity)


def _like(column: str, how: str, keys: list[str]) -> str:
    test = {"contains": "contains(lower({c}), '{k}')", "ends": "ends_with(lower({c}), '{k}')", "starts": "starts_with(lower({c}), '{k}')", "equals": "lower({c}) = '{k}'"}[how]
    return "(" + " OR ".join(test.format(c=column, k=k) for k in keys) + ")"


FEATURES_SQL = ", features AS (SELECT DISTINCT 'import' AS kind, module AS text FROM imports UNION ALL SELECT 'path', rel_path FROM files UNION ALL SELECT 'function', name FROM functions)"
#: Signals whose words occur in the tables, so that scores differ from zero there.
TABLE_SIGNALS = [("colours", "import", "contains", ["red", "blue"], 30), ("colours", "import", "contains", ["violet"], 20), ("tools", "import", "ends", ["anvil", "gear", "bolt"], 40), ("tools", "function", "contains", ["supplier"], 10), ("regions", "path", "contains", ["asia/", "europe/"], 25), ("regions", "path", "contains", ["atlantis"], 35)]


def _domain_sql(signals: list[tuple[str, str, str, list[str], int]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{d}' AS domain, CASE WHEN EXISTS (SELECT * FROM features WHERE kind = '{kind}' AND {_like('text', how, keys)}) THEN {w} ELSE 0 END AS got, {w} AS w" for d, kind, how, keys, w in signals)
    return FEATURES_SQL + f", rows_ AS ({rows}), scores AS (SELECT domain, sum(got)::BIGINT AS score, sum(w)::BIGINT AS max_score, least(97, sum(got) * 100 // sum(w))::BIGINT AS confidence FROM rows_ GROUP BY 1) "


BEST = "SELECT CASE WHEN confidence >= 50 THEN domain ELSE 'Unknown' END AS domain, CASE WHEN confidence >= 50 THEN confidence ELSE 0 END AS confidence, CASE WHEN confidence >= 70 THEN 'definite' WHEN confidence >= 50 THEN 'tentative' ELSE 'uncertain' END AS language FROM (SELECT * FROM scores ORDER BY score DESC, domain LIMIT 1)"
query("r5_domain_scores", _domain_sql(rules.DOMAIN_SIGNALS) + "SELECT * FROM scores")(lambda g: rules.domain_scores(rules.graph_features(g)))
query("r5_signal_scores", _domain_sql(TABLE_SIGNALS) + "SELECT * FROM scores")(lambda g: rules.domain_scores(rules.graph_features(g), TABLE_SIGNALS))
query("r5_best_domain", _domain_sql(TABLE_SIGNALS) + BEST)(lambda g: rules.best_domain(rules.domain_scores(rules.graph_features(g), TABLE_SIGNALS)))


@query("r6_libraries", """, known AS (SELECT DISTINCT split_part(module, ' ', 1) AS key FROM imports UNION SELECT DISTINCT module FROM imports WHERE ends_with(module, 'ring')),
    found AS (SELECT module, arg_max(key, length(key)) AS key FROM (SELECT DISTINCT module FROM imports) JOIN known ON module = key OR starts_with(module, key || ' ') GROUP BY 1),
    used AS (SELECT DISTINCT key, rel_path FROM imports i JOIN found USING (module) JOIN files f ON f.id = i.file_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rel_path) AS place FROM used)
    SELECT key, count(*) AS files, string_agg(rel_path, ',' ORDER BY rel_path) FILTER (place <= 3) AS evidence FROM ranked GROUP BY 1""")
def _libraries(g: Graph) -> DataFrame:
    modules = g.nodes("Import").select("module")
    known = modules.select(F.split_part("module", F.lit(" "), F.lit(1)).alias("key")).unionByName(modules.filter(F.endswith("module", F.lit("ring"))).select(F.col("module").alias("key"))).distinct()
    return rules.library_evidence(g, known)


TOKENS_SQL = ", tokens AS (SELECT DISTINCT module AS token FROM imports UNION ALL SELECT module_name FROM modules UNION ALL SELECT name FROM files UNION ALL SELECT name FROM functions)"


def _pattern_sql(patterns: list[tuple[str, list[str]]]) -> str:
    return TOKENS_SQL + " UNION ALL ".join(f"SELECT {i} AS place, '{p}' AS pattern, (" + " + ".join(f"(EXISTS (SELECT * FROM tokens WHERE contains(lower(token), '{k}')))::BIGINT" for k in keys) + ") AS score" for i, (p, keys) in enumerate(patterns)).replace("SELECT 0 AS", " SELECT 0 AS", 1)


query("r8_architecture_patterns", _pattern_sql(rules.PATTERNS))(lambda g: rules.architecture_pattern(rules.tokens(g)))
TABLE_LAYERS = [("Oceans", ["africa", "america"]), ("Lands", ["asia", "nation_1"]), ("Even", ["_2", "_4", "europe"]), ("None", ["nowhere"])]
LAYER_SQL = ", shown_ AS (SELECT 0 AS part, module_name AS item, lower(module_name) AS text FROM modules UNION ALL SELECT 1, name, lower(rel_path) FROM files), found AS (" + " UNION ALL ".join(f"SELECT DISTINCT {i} AS place, '{n}' AS layer, part, item FROM shown_ WHERE {_like('text', 'contains', keys)}" for i, (n, keys) in enumerate(TABLE_LAYERS)) + """),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY place, part ORDER BY item) AS r FROM found), few AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY part, item) AS k FROM ranked WHERE part = 0 OR r <= 3)
    SELECT layer, string_agg(item, ',' ORDER BY k) FILTER (k <= 4) AS components FROM few GROUP BY place, layer ORDER BY place LIMIT 6"""
query("r15_layers", LAYER_SQL)(lambda g: rules.layers(g, TABLE_LAYERS))
query("r12_critical_files", ONBOARD.replace("LIMIT 3", "LIMIT 5") + """, s AS (SELECT name, d, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM functions) AS fns FROM hot_files)
    SELECT name, least(fns, (d * fns) // files)::BIGINT AS affected_functions, least(d, files)::BIGINT AS affected_modules, CASE WHEN least(99, d * 100 // files) > 0 THEN least(99, d * 100 // files)::BIGINT END AS execution_pct FROM s""")(impact.critical_files)
query("r13_onboarding_minutes", "SELECT least(greatest(5 + 3 * least(8, (SELECT count(*) FROM modules) + 2) + 2 * least(10, (SELECT count(*) FROM files) // 20), 10), 90)::BIGINT AS minutes")(rules.onboarding_minutes)
query("r16_start_here", ONBOARD + "SELECT name FROM hot_files")(lambda g: rules.start_here(g).select("name"))
TABLE_RESPONSIBILITIES = [("name", ["nation_1"], "first ten"), ("name", ["nation_2"], "twenties"), ("function", ["0000007", "0000003"], "serves thirty or seventy")]
query("r17_responsibilities", """SELECT id, CASE WHEN contains(lower(name), 'nation_1') THEN 'first ten' WHEN contains(lower(name), 'nation_2') THEN 'twenties' WHEN EXISTS (SELECT * FROM functions x WHERE x.file_id = f.id AND (contains(x.name, '0000007') OR contains(x.name, '0000003'))) THEN 'serves thirty or seventy' ELSE 'holds core logic' END AS responsibility FROM files f""")(lambda g: rules.responsibilities(g, TABLE_RESPONSIBILITIES))
query("r22_module_roles", "SELECT module_name, CASE WHEN module_name = 'ASIA' THEN 'eastern code' ELSE 'code about ' || module_name END AS role FROM modules")(lambda g: rules.module_roles(g, {"asia": "eastern code"}))
RANK = """, hits AS (SELECT id, 'function' AS type, name, CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN starts_with(lower(name), '{q}') THEN 0.9 WHEN contains(lower(name), '{q}') THEN 0.7 END::DOUBLE AS s, 4 AS p FROM functions
    UNION ALL SELECT id, 'class', name, (CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN starts_with(lower(name), '{q}') THEN 0.9 WHEN contains(lower(name), '{q}') THEN 0.7 END)::DOUBLE * 0.95::DOUBLE, 3 FROM classes
    UNION ALL SELECT id, 'file', rel_path, (CASE WHEN lower(rel_path) = '{q}' THEN 1.0 WHEN starts_with(lower(rel_path), '{q}') THEN 0.85 WHEN contains(lower(rel_path), '{q}') THEN 0.65 END)::DOUBLE * 0.9::DOUBLE, 2 FROM files
    UNION ALL SELECT id, 'import', module, (CASE WHEN lower(module) = '{q}' THEN 1.0 WHEN starts_with(lower(module), '{q}') THEN 0.8 WHEN contains(lower(module), '{q}') THEN 0.6 END)::DOUBLE * 0.8::DOUBLE, 1 FROM imports),
    ranked AS (SELECT id, type, name, round(s, 4) AS score, p FROM hits WHERE s IS NOT NULL)"""
for _n, _label, _q in (("t1_function_search", "Function", "supplier#0000000"), ("t2_class_search", "Class", "00001"), ("t3_file_search", "File", "asia"), ("t4_import_search", "Import", "ring")):
    query(_n, RANK.format(q=_q) + f"SELECT id, type, name, score, p AS priority FROM ranked WHERE type = '{_label.lower()}'")(lambda g, q=_q, label=_label: search.branch(g, q, label))
query("t5_ranked_search", RANK.format(q="r") + "SELECT id, type, name, least(1.0::DOUBLE, score) AS score FROM ranked ORDER BY p DESC, score DESC, name, id LIMIT 50")(lambda g: search.search(g, "R"))
query("t8_answer", RANK.format(q="blue") + ", top AS (SELECT * FROM ranked ORDER BY p DESC, score DESC, name, id LIMIT 50) SELECT count(*) AS hits, (SELECT string_agg(name, ', ' ORDER BY score DESC, name, id) FROM (SELECT * FROM top ORDER BY score DESC, name, id LIMIT 3)) AS top FROM top")(lambda g: search.answer(g, "blue"))
query("g1_overview", "SELECT count(*) AS total_commits, max(committed_at) AS last_commit, count(DISTINCT author_email) AS contributors FROM commits")(activity.overview)
query("g2_recent", "SELECT substring(sha, 1, 12) AS sha, author_name AS author, committed_at FROM commits WHERE NOT is_merge ORDER BY committed_at DESC, commits.sha LIMIT 50")(activity.recent)
query("g3_recent_files", ", r AS (SELECT sha, committed_at FROM commits WHERE NOT is_merge ORDER BY committed_at DESC, sha LIMIT 50) SELECT r.sha, committed_at, coalesce(string_agg(path, ',' ORDER BY path), '') AS files FROM r LEFT JOIN commit_files f ON r.sha = f.sha GROUP BY 1, 2")(activity.recent_files)
query("g4_contributors", "SELECT email, count(*) AS commit_count, max(committed_at) AS last_commit, max(author_name) AS name FROM commits WHERE NOT is_merge GROUP BY 1")(activity.contributors)
query("g5_contributor_files", "SELECT * FROM contributor_files")(activity.contributor_files)
query("g6_file_totals", "SELECT path, sum(n)::BIGINT AS total FROM contributor_files GROUP BY 1")(activity.file_totals)
query("g7_ownership", "SELECT email, path, n, round(n / sum(n) OVER (PARTITION BY path), 3) AS share FROM contributor_files")(activity.ownership)
TOP20 = ", top20 AS (SELECT * FROM (SELECT email, path, n, row_number() OVER (PARTITION BY email ORDER BY n DESC, path)::INT AS place FROM contributor_files) WHERE place <= 20)"
AREAS = TOP20 + ", areas AS (SELECT email, split_part(path, '/', 1) AS area, count(*) AS files FROM top20 GROUP BY 1, 2), top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY files DESC, area) AS place FROM areas) WHERE place <= 5), joined AS (SELECT email, string_agg(area, ',' ORDER BY place) AS areas FROM top5 GROUP BY 1)"
query("g8_top_files", TOP20 + "SELECT * FROM top20")(activity.top_files)
query("g9_primary_areas", AREAS + "SELECT * FROM joined")(activity.primary_areas)
query("g10_ranking", "SELECT email, count(*) AS commit_count, max(committed_at) AS last_commit, max(author_name) AS name FROM commits WHERE NOT is_merge GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")(activity.ranking)
query("g11_profiles", AREAS + ", c AS (SELECT email, count(*) AS commit_count FROM commits WHERE NOT is_merge GROUP BY 1), f AS (SELECT email, count(*) AS files FROM contributor_files GROUP BY 1) SELECT c.email, commit_count, coalesce(files, 0) AS files, coalesce(areas, '') AS areas FROM c LEFT JOIN f ON c.email = f.email LEFT JOIN joined j ON c.email = j.email")(activity.profile)
query("g12_panel", "SELECT sha, committed_at FROM commits WHERE email = 'customer#000000007@example.com' OR author_name = 'Customer#000000011'")(lambda g: activity.panel(g, "Customer#000000007@example.com", "Customer#000000011"))
query("g13_average_ownership", "SELECT email, (2 * sum(round(1000 * share)::BIGINT) + 10 * count(*))::BIGINT // (20 * count(*)) AS average_pct FROM (SELECT email, round(n / sum(n) OVER (PARTITION BY path), 3) AS share FROM contributor_files) GROUP BY 1")(activity.average_ownership)
query("g14_ages", """, m AS (SELECT sha, floor((epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(committed_at)) / 60)::BIGINT AS m FROM commits)
    SELECT sha, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 43200 THEN (m // 1440) || 'd ago' ELSE (m // 43200) || 'mo ago' END AS age FROM m""")(lambda g: activity.ages(g, "1999-01-01 00:00:00"))
query("b5_telemetry", "SELECT event_type AS action, count(*) AS n, count(*) FILTER (event_type <> 'error') AS successes, round(avg(value), 3) AS mean_ms FROM events GROUP BY 1")(activity.telemetry)
query("x_directed_cycles", "SELECT x.a AS node, 2::BIGINT AS cycle_length FROM call_arcs x JOIN call_arcs y ON x.b = y.a AND y.b = x.a UNION SELECT x.a, 3 FROM call_arcs x JOIN call_arcs y ON x.b = y.a JOIN call_arcs z ON y.b = z.a AND z.b = x.a")(structure.directed_cycles)
query("x_unresolved_parents", "SELECT src, dst FROM inherits WHERE dst NOT IN (SELECT id FROM classes)")(structure.unresolved_parents)
query("q2_edges_by_type", "SELECT rel_type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1")(
    lambda g: g.edges().groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets")))
query("c6_edge_diagnostics", ", raw AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey) SELECT count(*) AS total, count(DISTINCT (src, dst)) AS unique_edges, count(*) - count(DISTINCT (src, dst)) AS removed FROM raw")(
    lambda g: build.edge_diagnostics(call_lines(g.tables("lineitem")).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("call").alias("rel_type"))))
query("page_links", "SELECT page_id, k::INT AS place, links[k] AS link FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS links FROM pages))")(lambda g: page_links(g.tables("pages")))
query("s10_statement", "SELECT label, count(*) AS n FROM nodes WHERE id IN (SELECT dst FROM edges WHERE rel_type = 'FUNCTION_CALLS_FUNCTION') GROUP BY 1")(
    lambda g: g.sql("SELECT label, count(*) AS n FROM {nodes} WHERE id IN (SELECT dst FROM {edges} WHERE rel_type = :relation) GROUP BY label", {"relation": model.CALLS}))
query("r14_understanding", ONBOARD + "SELECT least(greatest(45 + 10 * count(*), 50), 90)::BIGINT AS percent FROM hot_files")(
    lambda g: rules.start_here(g).agg(scores.understanding(F.count(F.lit(1))).cast("long").alias("percent")))


#: Names of files and functions of the tables, in place of those that programs have.
TABLE_ENTRIES, TABLE_ROUTES, TABLE_MODELS = [("nation_3", "main"), ("nation_7", "cli"), ("nation_12", "scheduler"), ("nation_14", "worker")], ["0000007", "0000003"], ("nation_2",)


def _decorated(g: Graph) -> Graph:
    """The graph with each function's name as its decorator, as the tables have none."""
    return Graph(g.node_parts | {"Function": lambda: g.nodes("Function").withColumn("decorators", F.array("name"))}, g.edge_parts, tables=g.tables, ends=g.ends)


TABLE_DECORATORS = [("served", "decorator", "contains", ["0000007", "0000003"], 30), ("served", "decorator", "equals", ["nothing"], 15), ("served", "path", "contains", ["asia/"], 20), ("other", "decorator", "ends", ["0000011"], 10)]
query("r5_decorator_scores", _domain_sql(TABLE_DECORATORS).replace("SELECT 'function', name FROM functions", "SELECT 'function', name FROM functions UNION SELECT 'decorator', name FROM functions") + "SELECT * FROM scores")(
    lambda g: rules.domain_scores(rules.graph_features(_decorated(g)), TABLE_DECORATORS))
ENTRY_SQL = ", mains AS (SELECT CASE lower(name) " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in TABLE_ENTRIES) + " END AS type, lower(name) AS name, rel_path AS path FROM files), " + f"""
    handlers AS (SELECT f.name AS path, min(x.name) AS name FROM functions x JOIN files f ON x.file_id = f.id WHERE {_like("x.name", "contains", TABLE_ROUTES)} GROUP BY 1 ORDER BY 1 LIMIT 3),
    found AS (SELECT 1 AS part, * FROM (SELECT * FROM mains WHERE type IS NOT NULL ORDER BY path LIMIT 10) UNION ALL SELECT 2, 'route', name, path FROM handlers), entries AS (SELECT * FROM found ORDER BY part, path LIMIT 10)"""
query("r7_entry_points", ENTRY_SQL + "SELECT type, name, path FROM entries")(lambda g: rules.graph_entry_points(_decorated(g), TABLE_ENTRIES, TABLE_ROUTES))
GUIDE = ONBOARD + ENTRY_SQL + f""", e AS (SELECT 1 AS part, row_number() OVER (ORDER BY path) AS place, 'entry' AS source, path FROM entries WHERE type IN ('main', 'cli', 'worker') ORDER BY path LIMIT 2),
    h AS (SELECT 2 AS part, row_number() OVER (ORDER BY d DESC, id) AS place, 'central' AS source, name AS path FROM (SELECT h.name, h.d, f.id FROM hot_files h JOIN files f ON f.rel_path = h.name WHERE h.name NOT IN (SELECT path FROM e))),
    b AS (SELECT * FROM e UNION ALL SELECT * FROM h WHERE place + (SELECT count(*) FROM e) <= 4),
    m AS (SELECT 3 AS part, 1 AS place, 'model' AS source, rel_path AS path FROM files WHERE contains(lower(name), '{TABLE_MODELS[0]}') AND rel_path NOT IN (SELECT path FROM b) ORDER BY rel_path LIMIT 1),
    guide AS (SELECT * FROM b UNION ALL SELECT * FROM m) """
query("r16_reading_guide", GUIDE + "SELECT row_number() OVER (ORDER BY part, place)::INT AS step, source, path FROM guide")(lambda g: rules.reading_guide(_decorated(g), TABLE_ENTRIES, TABLE_ROUTES, TABLE_MODELS))
query("r14_guide_understanding", GUIDE + "SELECT least(greatest(45 + 10 * count(*), 50), 90)::BIGINT AS percent FROM guide")(
    lambda g: rules.reading_guide(_decorated(g), TABLE_ENTRIES, TABLE_ROUTES, TABLE_MODELS).agg(scores.understanding(F.count(F.lit(1))).cast("long").alias("percent")))


#: Clauses that hold and clauses that don't, of each kind of signal; words of the tables.
TABLE_OBSERVATIONS = [
    ("decision", "cold things, nothing purple and hot", [("library", "equals", ["cold", "hot"], 1, True), ("library", "equals", ["purple-hot"], 1, False)]),
    ("decision", "cold things are missing", [("library", "equals", ["cold"], 1, False)]),
    ("decision", "regions of two names", [("module", "contains", ["asia"], 2, True), ("module", "contains", ["eur"], 1, True)]),
    ("observation", "in a circle", [("cycle", "contains", [""], 2, True)]),
    ("observation", "much depends on one", [("dependents", "contains", ["nation"], 6, True)]),
    ("observation", "functions and classes", [("count", "equals", ["functions"], 3, True), ("count", "equals", ["classes"], 1, True), ("path", "contains", ["_3"], 1, True)]),
    ("observation", "many for a class", [("count", "equals", ["functions for a class"], 2, True)]),
    ("observation", "two ways in", [("entry", "equals", ["route"], 1, True), ("entry", "equals", ["cli"], 1, True)]),
    ("observation", "nothing to read", [("path", "starts", ["readme", "sia/"], 1, False), ("path", "starts", ["asia/"], 1, True)]),
]


def _clause_sql(kind: str, how: str, keys: list[str], least: int) -> str:
    return f"kind = '{kind}' AND {_like('text', how, keys)} AND n >= {least}"


def _observation_sql(rules_: list) -> str:
    rows = []
    for topic, name, clauses in rules_:
        holds = " AND ".join(("" if c[4] else "NOT ") + f"EXISTS (SELECT * FROM signals WHERE {_clause_sql(*c[:4])})" for c in clauses)
        wanted = " OR ".join(f"({_clause_sql(*c[:4])})" for c in clauses if c[4]) or "false"
        rows.append(f"SELECT '{topic}' AS topic, '{name}' AS rule, count(DISTINCT path) AS n, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT DISTINCT path FROM signals WHERE path IS NOT NULL AND ({wanted}) ORDER BY path LIMIT 3)), '') AS evidence FROM signals WHERE {wanted} HAVING {holds}")
    return " UNION ALL ".join(rows)


query("r18_observations", CLOSED.split("SELECT node, cycle_length FROM")[0] + ENTRY_SQL + """, hot_one AS (SELECT rel_path AS name, count(*) AS d, n.id FROM walk2 JOIN files n ON target = n.id GROUP BY 1, 3 ORDER BY 2 DESC, 3 LIMIT 1), n_ AS (SELECT (SELECT count(*) FROM functions) AS f, (SELECT count(*) FROM classes) AS c),
    signals AS (SELECT DISTINCT 'library' AS kind, split_part(lower(module), ' ', 1) AS text, rel_path AS path, 1 AS n FROM imports i JOIN files f ON i.file_id = f.id UNION ALL SELECT 'module', module_name, module_name, file_count FROM modules
    UNION ALL SELECT 'entry', type, path, 1 FROM entries UNION ALL SELECT 'path', rel_path, rel_path, 1 FROM files UNION ALL (SELECT 'cycle', node, node, cycle_length FROM closed ORDER BY node, cycle_length LIMIT 5) UNION ALL SELECT 'dependents', name, name, d FROM hot_one
    UNION ALL SELECT 'count', 'functions', NULL, f FROM n_ UNION ALL SELECT 'count', 'classes', NULL, c FROM n_ UNION ALL SELECT 'count', 'functions for a class', NULL, ceil(f / greatest(c, 1))::BIGINT FROM n_) """ + _observation_sql(TABLE_OBSERVATIONS))(lambda g: _observations(g))


def _observations(g: Graph) -> DataFrame:
    first = F.split_part(F.lower("module"), F.lit(" "), F.lit(1))
    known = g.nodes("Import").select(first.alias("key"), first.alias("category")).distinct()
    return rules.observations(rules.signals(_decorated(g), known, TABLE_ENTRIES, TABLE_ROUTES), TABLE_OBSERVATIONS)


@query("r19_relative_paths", r""", asked AS (SELECT p_brand, p_partkey, p_size, CASE p_type WHEN 'ECONOMY' THEN '/srv/clone/' || p_brand || '/x/' WHEN 'PROMO' THEN '/tmp/q/T/clone/' ELSE 'D:\work\' END || p_name || ' ' || p_partkey AS path FROM part),
    plain AS (SELECT path, p_partkey, p_size, replace(path, '\', '/') AS p FROM asked),
    known AS (SELECT DISTINCT '/srv/clone/' || p_brand AS r, 'of/' || lower(p_brand) AS rel FROM part WHERE p_size > 10 UNION ALL SELECT p, 'part/' || p_partkey FROM plain WHERE p_size > 40),
    held AS (SELECT path, arg_max(r, (length(r), r)) AS r FROM plain JOIN known ON contains(p, r) GROUP BY 1)
    SELECT path, CASE WHEN p_size > 40 THEN 'part/' || p_partkey WHEN r IS NOT NULL THEN ltrim(replace(p, r, rel), '/') WHEN contains(p, '/T/') THEN split_part(p, '/', 6) ELSE p END AS relative
    FROM plain LEFT JOIN held USING (path) LEFT JOIN known USING (r)""")
def _relative_paths(g: Graph) -> DataFrame:
    part = g.tables("part")
    folder = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("/srv/clone/"), "p_brand", F.lit("/x/"))).when(F.col("p_type") == "PROMO", "/tmp/q/T/clone/").otherwise("D:\\work\\")
    paths = part.select("p_partkey", "p_size", F.concat(folder, "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("path"))
    exact = paths.filter("p_size > 40").select("path", F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("rel_path"))
    roots = part.filter("p_size > 10").select(F.concat(F.lit("/srv/clone/"), "p_brand").alias("path"), F.concat(F.lit("of/"), F.lower("p_brand")).alias("rel_path")).distinct()
    return rules.relative_paths(paths, roots.unionByName(exact))


@query("c5_compatible_calls", """, called AS (SELECT DISTINCT p_brand AS path, 'Supplier#' || lpad((p_size)::VARCHAR, 9, '0') AS name FROM part), owned AS (SELECT id, name, 'Brand#' || (substring(id, 6)::BIGINT % 40) AS path FROM functions)
    SELECT DISTINCT s.id AS src, d.id AS dst FROM called c JOIN owned d ON d.name = c.name JOIN owned s ON contains(s.path || ':' || s.name, c.path) WHERE s.id <> d.id""")
def _compatible_calls(g: Graph) -> DataFrame:
    """Files are brands: Brand#1 calls for functions of Brand#1 and Brand#10 to Brand#19."""
    called = g.tables("part").select(F.col("p_brand").alias("path"), F.concat(F.lit("Supplier#"), F.lpad(F.col("p_size").cast("string"), 9, "0")).alias("name"))
    owned = g.nodes("Function").select("id", "name", F.concat(F.lit("Brand#"), (F.substring("id", 6, 20).cast("long") % 40).cast("string")).alias("path"))
    return build.resolve_calls_compat(called, owned)
