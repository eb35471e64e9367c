"""Queries over references between tables and the hierarchy of prerequisites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.operators import hierarchy, references
from lessonloom.runtime import materialize, tables


def _prerequisites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return hierarchy.links(tables(spark, d)("atom_plans"), node="atom_id", parents="prerequisite_ids", arrival="ingested_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(_prerequisites(spark, d)[1]).select(F.col("v").alias("atom_id"), "cycle_id")


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = materialize(hierarchy.hierarchy(*_prerequisites(spark, d)), "tree")
    tree = tree.join(hierarchy.paths(tree), "v", "left")
    return tree.select(F.col("v").alias("atom_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", "path", "descendants", "enter", "leave", "cycle_id")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(materialize(hierarchy.hierarchy(*_prerequisites(spark, d)), "tree"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    R, P = references.Reference, references.Parent
    refs = [
        R("learning_pairs", t("learning_pairs"), "pair_id", "question_ids", "questions"),
        R("atom_plans", t("atom_plans"), "atom_id", "source_ref_ids", "source_refs"),
        R("illustration_assets", t("illustration_assets"), "illustration_id", "source_ref_id", "source_refs"),
        R("atom_plans", t("atom_plans"), "atom_id", "prerequisite_ids", "atom_plans"),
    ]
    parents = [
        P("questions", t("questions"), F.col("question_id")),
        P("source_refs", t("document_chunks"), F.col("source_ref.source_ref_id")),
        P("atom_plans", t("atom_plans"), F.col("atom_id")),
    ]
    return references.orphans(refs, parents)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(p4_found(spark, d))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """What of the hierarchy SQL can state too: parent, root, depth, the path written out, and the number of descendants."""
    return p3_hierarchy(spark, d).select("atom_id", "parent_id", "root_id", "depth", F.array_join("path", ">").alias("path"), "descendants", "cycle_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_paths, p3_descendants, p4_found, p4_report)}

_NODES = """
nodes AS (SELECT atom_id AS v, arg_min(prerequisite_ids, ingested_at) AS ps FROM atom_plans WHERE atom_id IS NOT NULL GROUP BY atom_id),
edges AS (SELECT DISTINCT v, p FROM (SELECT v, unnest(ps) AS p FROM nodes) WHERE p IN (SELECT v FROM nodes))
"""
_P4 = """
refs0 AS (
  SELECT 'learning_pairs' AS table_name, 'question_ids' AS ref_field, 'questions' AS target, pair_id AS record_id, unnest(question_ids) AS ref_id, ingested_at AS arr FROM learning_pairs
  UNION ALL SELECT 'atom_plans', 'source_ref_ids', 'source_refs', atom_id, unnest(source_ref_ids), ingested_at FROM atom_plans
  UNION ALL SELECT 'illustration_assets', 'source_ref_id', 'source_refs', illustration_id, source_ref_id, ingested_at FROM illustration_assets
  UNION ALL SELECT 'atom_plans', 'prerequisite_ids', 'atom_plans', atom_id, unnest(prerequisite_ids), ingested_at FROM atom_plans),
refs AS (SELECT table_name, ref_field, target, record_id, ref_id, min(arr) AS arr FROM refs0 WHERE ref_id IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL),
parents AS (
  SELECT target, ref_id, min(arr) AS since, bool_or(gone) AS gone FROM (
    SELECT 'questions' AS target, question_id AS ref_id, ingested_at AS arr, deleted_at IS NOT NULL AS gone FROM questions
    UNION ALL SELECT 'source_refs', source_ref.source_ref_id, ingested_at, deleted_at IS NOT NULL FROM document_chunks
    UNION ALL SELECT 'atom_plans', atom_id, ingested_at, deleted_at IS NOT NULL FROM atom_plans) GROUP BY ALL),
found AS (
  SELECT table_name, ref_field, record_id, ref_id, CASE WHEN gone IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN since > arr THEN 'late' END AS reason, strftime(arr, '%Y-%m') AS ref_month
  FROM refs LEFT JOIN parents USING (target, ref_id))
"""

_TREE = f"""{_NODES},
pos AS (SELECT v, p, min(k) AS k FROM (SELECT v, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM nodes) WHERE p IN (SELECT v FROM nodes) GROUP BY v, p),
par AS (SELECT v, arg_min(p, k) AS p FROM pos GROUP BY v),
down AS (SELECT v, v AS root, 0::BIGINT AS depth, v AS path FROM nodes WHERE v NOT IN (SELECT v FROM par) UNION ALL SELECT par.v, down.root, down.depth + 1, down.path || '>' || par.v FROM down JOIN par ON par.p = down.v),
under AS (SELECT p AS a, v AS b, 1::BIGINT AS distance FROM par WHERE p IN (SELECT v FROM down) UNION ALL SELECT under.a, par.v, distance + 1 FROM under JOIN par ON par.p = under.b)
"""

SQL = {
    "p3_descendants": f"WITH RECURSIVE {_TREE} SELECT a AS ancestor, b AS descendant, distance FROM under",
    "p3_paths": f"""WITH RECURSIVE {_TREE},
reach AS (SELECT v, p FROM edges UNION SELECT reach.v, edges.p FROM reach JOIN edges ON reach.p = edges.v),
loops AS (SELECT a.v, least(a.v, min(a.p)) AS cycle_id FROM reach a JOIN reach b ON a.v = b.p AND a.p = b.v GROUP BY a.v),
kids AS (SELECT a, count(*) AS n FROM under GROUP BY a)
SELECT nodes.v AS atom_id, par.p AS parent_id, down.root AS root_id, down.depth, down.path, CASE WHEN down.v IS NOT NULL THEN coalesce(kids.n, 0) END AS descendants, loops.cycle_id
FROM nodes LEFT JOIN par ON par.v = nodes.v LEFT JOIN down ON down.v = nodes.v LEFT JOIN kids ON kids.a = nodes.v LEFT JOIN loops ON loops.v = nodes.v""",
    "p3_found": f"""WITH RECURSIVE {_NODES},
reach AS (SELECT v, p FROM edges UNION SELECT reach.v, edges.p FROM reach JOIN edges ON reach.p = edges.v),
mutual AS (SELECT a.v, a.p FROM reach a JOIN reach b ON a.v = b.p AND a.p = b.v)
SELECT v AS atom_id, least(v, min(p)) AS cycle_id FROM mutual GROUP BY v""",
    "p4_found": f"WITH {_P4} SELECT * FROM found WHERE reason IS NOT NULL",
    "p4_report": f"WITH {_P4} SELECT table_name, ref_field, ref_month, reason, count(*) AS orphan_refs, count(DISTINCT record_id) AS records FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
