"""Impact of changes: configured relationships, roots of a change, plans, reports, and stages for DVC.

Graphs are tables: nodes id, kind, name, path, metadata (JSON) and edges source, target, kind, where an edge points from
a consumer to what it needs.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .dependencies import closure, predecessors, recommendations

NODES = "id string, kind string, name string, path string, metadata string"
EDGES = "source string, target string, kind string"
#: The sections of a configuration, the kinds of their entries, and the members that name what an entry
#: needs, with the kind that a bare name has there.
SECTIONS = {"datasets": "dataset", "features": "feature", "models": "model"}
NEEDS = {"inputs": None, "depends_on": None, "dependencies": None, "uses": None, "features": "feature", "uses_features": "feature", "feature_inputs": "feature", "datasets": "dataset", "dataset_inputs": "dataset"}
#: What a changed file that no node knows may be, by the ending of its name; kinds of nodes that such a
#: change may concern.
ENDINGS = {"notebook": (".ipynb",), "configuration": (".toml", ".yaml", ".yml", ".json", ".ini", ".cfg"), "data": (".csv", ".parquet", ".sql", ".dvc"), "generated": (".lock", ".generated")}
EXPOSED = ("file", "module", "dataset", "feature", "model")
#: Kinds of nodes that are stages, and of those that only declare them.
STAGES, DECLARATIONS = ("pipeline_stage", "dvc_stage", "stage"), ("dvc", "pipeline", "config")


def _names(value: Any) -> list[str]:
    items = value if isinstance(value, list | tuple) else [] if value is None else [value]
    return [str(x["name"]) if isinstance(x, Mapping) and "name" in x else str(x) for x in items if isinstance(x, str | int) or (isinstance(x, Mapping) and "name" in x)]


def _entries(section: Any) -> list[tuple[str, Mapping[str, Any]]]:
    if isinstance(section, Mapping):
        return [(str(k), v if isinstance(v, Mapping) else {"depends_on": v}) for k, v in section.items()]
    return [(str(x.get("name")), x) for x in section or [] if isinstance(x, Mapping) and x.get("name") is not None] if isinstance(section, list) else []


def relationships(spark: SparkSession, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the datasets, features, models and relationships that a configuration names.

    Entries that can't be read are left out. The configuration is a file's content, so it is worked on here.
    """
    nodes: dict[str, tuple] = {}
    edges: dict[tuple[str, str, str], None] = {}

    def node(name: str, kind: str, path: Any = None, metadata: Mapping[str, Any] | None = None) -> str:
        known = f"{kind}:{name}" if ":" not in name else name
        if known not in nodes or metadata is not None:
            nodes[known] = (known, known.partition(":")[0], known.partition(":")[2], None if path is None else str(path), json.dumps(metadata or {}, sort_keys=True, default=str))
        return known

    for section, kind in SECTIONS.items():
        for name, entry in _entries(config.get(section)):
            node(name, kind, entry.get("path") or entry.get("source"), entry)
    for section, kind in SECTIONS.items():
        for name, entry in _entries(config.get(section)):
            consumer = node(name, kind)
            for target in _names(entry.get("implemented_by") or entry.get("path")):
                edges[consumer, target if target.startswith(("file:", "module:")) else f"file:{target}", "implemented_by"] = None
            for field, plain in NEEDS.items():
                for needed in _names(entry.get(field)):
                    edges[consumer, node(needed, plain or ("dataset" if kind == "feature" else "feature")), "configured"] = None
            for made in _names(entry.get("produces")):
                edges[node(made, "feature" if kind == "dataset" else "model"), consumer, "configured"] = None
    for link in config.get("relationships") or [] if isinstance(config.get("relationships"), list) else []:
        if isinstance(link, Mapping) and link.get("source") is not None and link.get("target") is not None:
            ends = [next((f"{k}:{x}" for k in SECTIONS.values() if f"{k}:{x}" in nodes), x) if x not in nodes else x for x in (str(link["source"]), str(link["target"]))]
            edges[ends[0], ends[1], str(link.get("kind", "configured"))] = None
    return spark.createDataFrame(sorted(nodes.values()), NODES), spark.createDataFrame(sorted(edges), EDGES)


def load_graph(rows: DataFrame, json_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs written as JSON objects with lists of nodes and edges; malformed items are left out.

    Ids, kinds and ends that are given under their other names (node_id, relation) count as well.
    """
    items = lambda key: rows.select(F.explode(F.from_json(F.get_json_object(json_col, f"$.{key}"), "array<string>")).alias("x"))
    at = lambda *keys: F.coalesce(*[F.get_json_object("x", f"$.{k}") for k in keys])
    nodes = items("nodes").select(at("id", "node_id").alias("id"), F.coalesce(at("kind"), F.lit("unknown")).alias("kind"), at("name").alias("name"), at("path").alias("path"), F.coalesce(at("metadata"), F.lit("{}")).alias("metadata")).where("id IS NOT NULL")
    edges = items("edges").select(at("source").alias("source"), at("target").alias("target"), F.coalesce(at("kind", "relation"), F.lit("depends_on")).alias("kind"))
    return nodes.dropDuplicates(["id"]), edges.where("source IS NOT NULL AND target IS NOT NULL").distinct()


def plain_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def module_of(path: Column) -> Column:
    """module:a.b of a path a/b.py or a/b/__init__.py; null for others."""
    name = F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")
    return F.when(path.endswith(".py"), F.concat(F.lit("module:"), name))


def roots(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots id, matched_by; further edges) of changed files: path, line (null for the whole file).

    A changed line is its functions and classes. A path is the nodes of that path or of one that ends with it, and its
    module; a module brings the symbols below its id and a file those that it contains. A path that no node knows may
    concern anything: it is a root of its own, matched_by unknown:kind, with an edge from every file, module, dataset,
    feature and model.
    """
    files = checkpointed(changes.select(plain_path(F.col("path")).alias("path"), "line").distinct())
    paths, lines = files.select("path").distinct(), files.where("line IS NOT NULL")
    # a node's path and all its ends behind a slash, so that "ends with" is an equality
    parts = F.split(plain_path(F.col("path")), "/")
    ends = nodes.where("path IS NOT NULL").withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))))
    inner = ends.where("kind IN ('function', 'class')")
    ranged = lines.join(inner, "path").where(F.col("line").between(F.col("line_from"), F.col("line_to"))).select("id", F.lit("range").alias("matched_by"), "path") if {"line_from", "line_to"} <= set(nodes.columns) else None
    missed_lines = lines.select("path").distinct() if ranged is None else lines.select("path").distinct().join(ranged.select("path").distinct(), "path", "left_anti")
    whole = files.where("line IS NULL").select("path").distinct()
    by_path = ends.join(whole, "path", "left_semi").unionByName(ends.where("kind IN ('file', 'module')").join(missed_lines, "path", "left_semi")).select("id", F.lit("path").alias("matched_by"), "path")
    aliases = paths.select("path", F.explode(F.array_compact(F.array(module_of(F.col("path")), F.when(F.col("path").endswith(".py"), F.concat(F.lit("module:"), "path"))))).alias("id"))
    by_module = aliases.join(nodes.select("id"), "id", "left_semi").select("id", F.lit("module").alias("matched_by"), "path")
    found = by_path.unionByName(by_module)
    if ranged is not None:
        found = found.unionByName(ranged)
    found = checkpointed(found.distinct())
    prefixes = nodes.where("id LIKE 'module:%:%'").select(F.col("id").alias("symbol"), F.concat(F.lit("module:"), F.split("id", ":")[1]).alias("id"))
    symbols = found.join(prefixes, "id").select(F.col("symbol").alias("id"), F.lit("symbol").alias("matched_by"))
    inside = edges.where("kind = 'contains'").join(found.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("id"), F.lit("contained").alias("matched_by"))
    missed = checkpointed(paths.join(found.select("path").distinct(), "path", "left_anti").select("path", F.concat(F.lit("unknown:change:"), "path").alias("id")))
    unknown = missed.select("id", F.concat(F.lit("unknown:"), change_kind(F.col("path"))).alias("matched_by"))
    exposed = nodes.where(F.col("kind").isin(*EXPOSED)).select("id")
    one = missed.agg(F.min("id").alias("target")).where("target IS NOT NULL")  # of the unknown paths, any one reaches all exposed nodes
    further = exposed.join(F.broadcast(one), F.lit(True)).select(F.col("id").alias("source"), "target", F.lit("conservative").alias("kind"))
    return found.select("id", "matched_by").unionByName(symbols).unionByName(inside).unionByName(unknown).distinct(), further


def change_kind(path: Column) -> Column:
    """What a changed file that no node knows may be."""
    out = F.lit("unknown")
    for kind, endings in reversed(ENDINGS.items()):
        test = F.lit(False)
        for e in endings:
            test = test | path.endswith(e)
        out = F.when(test, kind).otherwise(out)
    return out


def plan(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, distance of everything that a change of files can affect, its roots at distance 0."""
    starts, further = roots(changes, nodes, edges)
    return closure(edges.select("source", "target", "kind").unionByName(further), starts.select("id").distinct())


def configured_targets(affected: DataFrame, nodes: DataFrame, paths: Sequence[str], mappings: Mapping[str, Any]) -> DataFrame:
    """kind, name of datasets and models that are affected, or whose configured dependency is an affected node or a
    part of a changed path."""
    own = nodes.join(affected.select("id"), "id", "left_semi").where("kind IN ('dataset', 'model')").select("kind", F.coalesce("name", F.regexp_replace("id", "^[^:]*:", "")).alias("name"))
    wanted = [(SECTIONS[s], str(name), str(dep)) for s in ("datasets", "models") for name, entry in (mappings.get(s) or {}).items() for dep in (entry if isinstance(entry, list) else entry.get("depends_on", []) if isinstance(entry, Mapping) else [entry])]
    named = own.sparkSession.createDataFrame(wanted, "kind string, name string, dep string")
    by_node = named.join(affected.select(F.col("id").alias("dep")), "dep", "left_semi").select("kind", "name")
    by_path = [(k, n) for k, n, dep in wanted if any(dep in p for p in paths)]
    return own.unionByName(by_node).unionByName(own.sparkSession.createDataFrame(by_path, "kind string, name string")).distinct()


def report(changes: DataFrame, nodes: DataFrame, edges: DataFrame, mappings: Mapping[str, Any] | None = None, max_paths: int = 10_000) -> dict[str, DataFrame]:
    """The tables of an impact report: roots, affected (id, distance), direct, targets (kind, name), validations (name),
    skipped (models that need no validation).

    Changed paths are a change set, not a corpus: more than max_paths of them are an error. Validations are those that
    the kinds of affected nodes ask for and those whose configured globs match a changed path.
    """
    mappings = mappings or {}
    spark = nodes.sparkSession
    listed = changes.select(plain_path(F.col("path")).alias("path")).distinct().limit(max_paths + 1).collect()
    if len(listed) > max_paths:
        raise ValueError(f"more than {max_paths} changed paths")
    paths = sorted(r.path for r in listed)
    starts, further = roots(changes, nodes, edges)
    starts = checkpointed(starts)
    every = edges.select("source", "target", "kind").unionByName(further)
    affected = checkpointed(closure(every, starts.select("id").distinct()))
    targets = checkpointed(configured_targets(affected, nodes, paths, mappings))
    by_glob = [(str(name),) for name, globs in (mappings.get("validations") or {}).items() if any(fnmatch.fnmatch(p, g) for p in paths for g in (globs if isinstance(globs, list) else [globs]))]
    validations = recommendations(affected.select("id"), nodes).select(F.col("check").alias("name")).unionByName(spark.createDataFrame(by_glob, "name string")).distinct()
    models = spark.createDataFrame([(str(m),) for m in (mappings.get("models") or {})], "name string")
    skipped = models.join(targets.where("kind = 'model'").select("name"), "name", "left_anti")
    direct = predecessors(every, starts.select("id")).select(F.col("neighbour").alias("id")).distinct()
    return {"roots": starts, "affected": affected.orderBy("distance", "id"), "direct": direct, "targets": targets, "validations": validations, "skipped": skipped}


def dvc_stages(nodes: DataFrame, edges: DataFrame, ids: Iterable[str] | None = None) -> DataFrame:
    """stage, cmd, deps, outs: each stage with the sorted paths that it needs and that need it.

    Other stages are neither, and a file that only declares the stage is no output.
    """
    is_stage = lambda p: F.col(f"{p}kind").isin(*STAGES) | F.col(f"{p}id").startswith("pipeline:")
    stages = nodes.where(is_stage(""))
    if ids is not None:
        stages = stages.where(F.col("id").isin(*ids))
    named = stages.select(F.col("id").alias("stage_id"), F.coalesce("name", "id").alias("stage"), F.nullif(F.trim(F.get_json_object("metadata", "$.cmd")), F.lit("")).alias("cmd"))
    other = nodes.select(F.col("id").alias("o_id"), F.col("kind").alias("o_kind"), F.coalesce("path", "name").alias("o_path")).where(~is_stage("o_") & F.col("o_path").isNotNull())
    needs = edges.select(F.col("source").alias("stage_id"), F.col("target").alias("o_id"), F.lit(True).alias("dep"))
    gives = edges.select(F.col("target").alias("stage_id"), F.col("source").alias("o_id"), F.lit(False).alias("dep"))
    sides = needs.unionByName(gives).join(named.select("stage_id"), "stage_id", "left_semi").join(other, "o_id").where(F.col("dep") | ~F.col("o_kind").isin(*DECLARATIONS))
    paths = lambda wanted: F.array_sort(F.collect_set(F.when(wanted, F.col("o_path"))))
    gathered = sides.groupBy("stage_id").agg(paths(F.col("dep")).alias("deps"), paths(~F.col("dep")).alias("outs"))
    none = F.array().cast("array<string>")
    return named.join(gathered, "stage_id", "left").select("stage", "cmd", F.coalesce("deps", none).alias("deps"), F.coalesce("outs", none).alias("outs"))


def dvc_text(stages: DataFrame, kind: str = "yaml") -> str:
    """The stages as the text of a pipeline file; a stage's own row is bounded, and so is a pipeline file."""
    rows = {r.stage: {k: v for k, v in (("cmd", r.cmd), ("deps", r.deps), ("outs", r.outs)) if v} for r in stages.orderBy("stage").collect()}
    if kind == "json":
        return json.dumps({"stages": rows}, indent=2, sort_keys=True) + "\n"
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    out = ["stages:"]
    for name, body in rows.items():
        out.append(f"  {name}:")
        for key, value in body.items():
            out += [f"    {key}:", *(f"      - {quoted(v)}" for v in value)] if isinstance(value, list) else [f"    {key}: {quoted(value)}"]
    return "\n".join(out) + "\n"
