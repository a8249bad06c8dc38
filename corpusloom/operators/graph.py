"""A typed property graph as two DataFrames: nodes (id, type, name, service, file) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut

HOPS = 10


def build(repositories: DataFrame, files: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of services, files and incidents; edges CONTAINS, AFFECTS and, from an incident's service to those it affects, CALLS. Repeated rows count once."""
    svc = F.concat(F.lit("svc:"), F.col("name"))
    nodes = repositories.where("name IS NOT NULL").select(svc.alias("id"), F.lit("Service").alias("type"), "name", F.col("name").alias("service"), F.lit(None).cast("string").alias("file"))
    f = files.where("file_id IS NOT NULL AND rel_path IS NOT NULL")
    fid = F.concat(F.lit("file:"), F.col("file_id").cast("string"))
    nodes = nodes.unionByName(f.select(fid.alias("id"), F.lit("File").alias("type"), F.regexp_extract("rel_path", r"([^/]*)$", 1).alias("name"), F.col("repo").alias("service"), F.col("rel_path").alias("file")).distinct())
    i = incidents.where("id IS NOT NULL")
    iid = F.concat(F.lit("inc:"), F.col("id"))
    nodes = nodes.unionByName(i.select(iid.alias("id"), F.lit("Incident").alias("type"), F.col("id").alias("name"), F.col("service_name").alias("service"), F.lit(None).cast("string").alias("file")).distinct())
    out = i.where("service_name IS NOT NULL").select("id", "service_name", F.explode("affected_services").alias("other")).where("other IS NOT NULL")
    to = F.concat(F.lit("svc:"), F.col("other"))
    edges = out.select(F.concat(F.lit("inc:"), F.col("id")).alias("src"), to.alias("dst"), F.lit("AFFECTS").alias("type"))
    edges = edges.unionByName(out.where("service_name <> other").select(F.concat(F.lit("svc:"), F.col("service_name")).alias("src"), to.alias("dst"), F.lit("CALLS").alias("type")))
    edges = edges.unionByName(f.where("repo IS NOT NULL").select(F.concat(F.lit("svc:"), F.col("repo")).alias("src"), fid.alias("dst"), F.lit("CONTAINS").alias("type")))
    return nodes.distinct(), edges.distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, start: str, types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(direction, edge_type, id, type, name) of the nodes one hop away."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    parts = []
    if direction in ("out", "both"):
        parts.append(e.where(F.col("src") == start).select(F.lit("out").alias("direction"), F.col("type").alias("edge_type"), F.col("dst").alias("id")))
    if direction in ("in", "both"):
        parts.append(e.where(F.col("dst") == start).select(F.lit("in").alias("direction"), F.col("type").alias("edge_type"), F.col("src").alias("id")))
    near = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return near.join(nodes.select("id", "type", "name"), "id").select("direction", "edge_type", "id", "type", "name")


def impacted(edges: DataFrame, start: str, hops: int = 3, types: list[str] | None = None) -> DataFrame:
    """(id, level): all that reaches ``start`` within ``hops`` edges, each at the level where it is first seen.

    Each level is one join of the last frontier with the edges and an anti join with what was seen; lineage is cut a level at a time.
    """
    if not 1 <= hops <= HOPS:
        raise ValueError(f"hops must lie between 1 and {HOPS}")
    e = (edges.where(F.col("type").isin(types)) if types else edges).select("src", "dst").distinct()
    seen = frontier = edges.sparkSession.createDataFrame([(start, 0)], "id string, level int")
    for level in range(1, hops + 1):
        step = e.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level")))
        seen = seen.unionByName(frontier)
    return seen.where("level > 0")


def simple_paths(edges: DataFrame, start: str, goal: str, cutoff: int = 3, most: int = 10, types: list[str] | None = None) -> DataFrame:
    """(hops, path): the shortest ``most`` paths without a repeated node, of up to ``cutoff`` edges; equal lengths in order of their nodes."""
    e = (edges.where(F.col("type").isin(types)) if types else edges).select("src", "dst").distinct()
    paths = edges.sparkSession.createDataFrame([([start], start)], "path array<string>, end string")
    found = None
    for _ in range(cutoff):
        nxt = paths.join(e, paths["end"] == e["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        nxt = cut(nxt)
        hit = nxt.where(F.col("end") == goal)
        found = hit if found is None else found.unionByName(hit)
        paths = nxt.where(F.col("end") != goal)
    return found.select((F.size("path") - 1).alias("hops"), F.array_join("path", " > ").alias("path")).orderBy("hops", "path").limit(most)


def service_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(service, depends_on): CALLS and DEPENDS_ON edges lifted to pairs of services, without pairs of one service."""
    s = nodes.select("id", "service")
    p = edges.where("type IN ('CALLS', 'DEPENDS_ON')").join(s.select(F.col("id").alias("src"), F.col("service").alias("service")), "src").join(s.select(F.col("id").alias("dst"), F.col("service").alias("depends_on")), "dst")
    return p.where("service <> depends_on").select("service", "depends_on").distinct()


def find_nodes(nodes: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(id, name, score): 100 for an equal name, 60 for one that contains the query, 30 for a file that does; case ignored."""
    q = query.lower()
    score = F.when(F.lower("name") == q, 100).when(F.lower("name").contains(q), 60).when(F.lower("file").contains(q), 30).otherwise(0)
    return nodes.select("id", "name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): counts of nodes and edges by type."""
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), F.col("type").alias("kind"), "n")
    return n.unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), F.col("type").alias("kind"), "n"))
