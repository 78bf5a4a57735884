"""Design specs (YAML of pages with groups, nodes and edges) as DataFrames, and all faults of one as rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import graph

#: The taxonomies of version 1.1.
TAXONOMIES = {
    "criticality": ("CORE", "CONDITIONAL", "OPTIONAL", "DEFERRED"),
    "maturity": ("CURRENT_TEMPLATE", "PLANNED", "BASELINE", "EXPERIMENTAL", "SELECTED", "VALIDATED"),
    "source_basis": ("BTC_CONFIRMED", "TEAM_DECISION", "RESEARCH_CANDIDATE", "SOFTWARE_TEMPLATE"),
    "type": ("process", "store", "artifact", "decision", "control", "graph_node", "note", "offpage"),
    "flow_type": ("data", "control", "optional", "fallback", "evidence", "artifact", "match"),
}
#: The keys that the parts of a spec have.
KEYS = {
    "spec": ("project", "criticalities", "maturities", "source_bases", "owners", "styles", "models", "pages"),
    "page": ("id", "title", "description", "direction", "mermaid_file", "detail_level", "layout", "groups", "nodes", "edges", "notes"),
    "group": ("id", "title", "layer", "geometry"),
    "node": ("id", "number", "title", "subtitle", "layer", "type", "criticality", "criticality_scope", "maturity", "source_basis", "architecture_owner", "implementation_owner", "reviewers", "responsibility", "non_responsibility", "inputs", "processing", "implementations", "outputs", "artifacts", "metrics", "failure_modes", "fallback", "dependencies", "next_modules", "geometry"),
    "edge": ("id", "source", "target", "label", "flow_type"),
    "model": ("interface", "current_template", "baseline", "candidates", "selected", "validation_status", "source_basis", "maturity"),
}
#: What the page of the event graph holds, phrases that stand for no contract, titles of modules that are no
#: decision or no graph node, and the modules that a spec has, some with their criticality and scope.
GRAPH_PAGE, FULL_PAGE, FULL_PAGE_NODES = "PAGE_04", "PAGE_01", 24
GRAPH_NODE_TYPES = ("QueryEvent", "Video", "SegmentEvent", "Entity", "SemanticMoment", "EvidenceRef")
GRAPH_RELATIONS = ("BEFORE", "CONTAINS", "PARTICIPATES_IN", "POSSIBLE_SAME_ENTITY", "ANCHORS", "SUPPORTS", "MATCH")
PLACEHOLDERS = ("typed upstream contract", "typed downstream contract", "architecture contract; implementation selected by validation status", "deterministic contract fallback.")
NO_DECISION = ("frame bank", "evidence verifier", "answer type router", "task policy")
NO_GRAPH_NODE = ("query event graph", "candidate graph builder", "graph semantics")
SCOPED = (("Semantic Moment Localizer", "CORE", "TRAKE"), ("Q&A Answer Extractor", "CORE", "Q&A"), ("Team Visual Encoder", "CONDITIONAL", "Team Frame Bank enabled"), ("Bounded Agent Planner", "OPTIONAL", "Control bus"))
TITLES = ("Application Backend / Orchestrator", "Interactive UI / Operator Console", "Automatic Mode", "Agent Control Bus")
_LISTS = ("architecture_owner", "implementation_owner", "reviewers", "responsibility", "non_responsibility", "inputs", "processing", "implementations", "outputs", "artifacts", "metrics", "failure_modes", "dependencies", "next_modules")
_TEXTS = ("title", "subtitle", "layer", "type", "criticality", "criticality_scope", "maturity", "source_basis", "fallback", "group", "graph_node_type")
NODE = "page_id string, node_id string, " + ", ".join(f"`{c}` string" for c in _TEXTS) + ", " + ", ".join(f"`{c}` array<string>" for c in _LISTS) + ", x double, y double, w double, h double"
EDGE = "page_id string, edge_id string, source string, target string, label string, flow_type string"


def load(path: str | Path) -> dict[str, Any]:
    spec = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(spec, dict):
        raise ValueError(f"{path} holds no mapping")
    return spec


def _place(item: Mapping[str, Any]) -> tuple:
    g = item.get("geometry") or {}
    return tuple(float(g[k]) if isinstance(g.get(k), int | float) else None for k in ("x", "y", "width", "height"))


def frames(spark: SparkSession, spec: Mapping[str, Any]) -> dict[str, DataFrame]:
    """pages, groups, nodes and edges of a spec."""
    pages = spec.get("pages") or []
    text = lambda v: None if v is None else str(v)
    nodes = [(p.get("id"), n.get("id"), *(text(n.get(c)) for c in _TEXTS), *([str(x) for x in n.get(c) or []] for c in _LISTS), *_place(n)) for p in pages for n in p.get("nodes", [])]
    edges = [(p.get("id"), *(text(e.get(c)) for c in ("id", "source", "target", "label", "flow_type"))) for p in pages for e in p.get("edges", [])]
    groups = [(p.get("id"), g.get("id"), text(g.get("title")), text(g.get("layer")), *_place(g)) for p in pages for g in p.get("groups", [])]
    heads = [(p.get("id"), text(p.get("title")), text(p.get("direction")), text(p.get("detail_level")), text(p.get("mermaid_file")), float((p.get("layout") or {}).get("max_width", 10_000)), float((p.get("layout") or {}).get("max_aspect_ratio", 3.5))) for p in pages]
    return {
        "pages": spark.createDataFrame(heads, "page_id string, title string, direction string, detail_level string, mermaid_file string, max_width double, max_aspect double"),
        "groups": spark.createDataFrame(groups, "page_id string, group_id string, title string, layer string, x double, y double, w double, h double"),
        "nodes": spark.createDataFrame(nodes, NODE),
        "edges": spark.createDataFrame(edges, EDGE),
    }


def _lacks(kind: str, item: Mapping[str, Any], page: str | None, name: object) -> Iterator[tuple]:
    lacking = [k for k in KEYS[kind] if k not in item]
    if lacking:
        yield f"{kind} lacks keys", page, f"{name}: {', '.join(lacking)}"


def _form(spec: Mapping[str, Any], pages: int) -> Iterator[tuple]:
    """check, page_id and subject of what only the mapping itself shows: absent and old keys, registries, fonts, models."""
    yield from _lacks("spec", spec, None, "spec")
    version = str((spec.get("project") or {}).get("version"))
    if version != "1.1":
        yield "version", None, version
    if "statuses" in spec:
        yield "old key", None, "statuses"
    for registry, field in (("criticalities", "criticality"), ("maturities", "maturity"), ("source_bases", "source_basis")):
        if set(spec.get(registry) or ()) != set(TAXONOMIES[field]):
            yield "registry", None, registry
    styles = spec.get("styles") or {}
    for name, held in (("owners", spec.get("owners")), ("layers", styles.get("layers"))):
        if not held:
            yield "nothing registered", None, name
    fonts = styles.get("fonts") or {}
    least = dict.fromkeys(fonts, 10) | {"page_title": 24, "group_title": 18}
    for name, size in least.items():
        if fonts.get(name, 0) < size:
            yield "small font", None, name
    ids = [p.get("id") for p in spec.get("pages") or []]
    if ids != [f"PAGE_{k:02d}" for k in range(pages)]:
        yield "pages or their order", None, ", ".join(map(str, ids))
    for page in spec.get("pages") or []:
        at, file = page.get("id"), page.get("mermaid_file")
        yield from _lacks("page", page, at, at)
        if not file or Path(file).name != file:
            yield "file name", at, str(file)
        for kind in ("group", "node", "edge"):
            for item in page.get(f"{kind}s") or []:
                yield from _lacks(kind, item, at, item.get("id"))
        for node in page.get("nodes") or []:
            if old := [k for k in ("status", "owner") if k in node]:
                yield "old key", at, f"{node.get('id')}: {', '.join(old)}"
            for field in _LISTS:
                held = node.get(field, [])
                if not isinstance(held, list) or any(not isinstance(x, str) for x in held):
                    yield f"{field} is no list of texts", at, node.get("id")
        for edge in page.get("edges") or []:
            if any(set(point) != {"x", "y"} for point in edge.get("waypoints") or []):
                yield "waypoint", at, edge.get("id")
    for name, model in (spec.get("models") or {}).items():
        yield from _lacks("model", model, None, name)
        for field in ("source_basis", "maturity"):
            if model.get(field) not in TAXONOMIES[field]:
                yield f"model {field}", None, name
        chosen = model.get("selected")
        if chosen is not None and model.get("validation_status") == "UNSELECTED":
            yield "unselected model with a selection", None, name
        if chosen and model.get("source_basis") != "BTC_CONFIRMED" and model.get("maturity") not in ("SELECTED", "VALIDATED"):
            yield "selection without a decision", None, name


def faults(spark: SparkSession, spec: Mapping[str, Any], whole_pages: int | None = None, modules: bool = False) -> DataFrame:
    """check, page_id and subject of every rule that the spec breaks; a sound spec has no row.

    whole_pages: how many pages a whole spec has, whose keys, registries, fonts and models are checked too; None for a part of
    one. modules: whether the modules, the graph's types and its relations must all be there.
    """
    f = frames(spark, spec)
    pages, groups, nodes, edges = (f[k] for k in ("pages", "groups", "nodes", "edges"))
    found: list[DataFrame] = []

    def add(check: str, rows: DataFrame, subject) -> None:
        found.append(rows.select(F.lit(check).alias("check"), "page_id", subject.cast("string").alias("subject")))

    node, edge = F.col("node_id"), F.col("edge_id")
    add("repeated page", graph.repeated(pages, "page_id"), F.col("page_id"))
    add("page direction", pages.where(~F.coalesce(F.col("direction").isin("LR", "TD"), F.lit(False))), F.col("direction"))
    add("detail level", pages.where(~F.coalesce(F.col("detail_level").isin("overview", "compact", "full"), F.lit(False))), F.col("detail_level"))
    add("repeated file", graph.repeated(pages, "mermaid_file").withColumn("page_id", F.lit(None).cast("string")), F.col("mermaid_file"))
    add("repeated group", graph.repeated(groups, "page_id", "group_id"), F.col("group_id"))
    add("repeated node", graph.repeated(nodes, "page_id", "node_id"), node)
    add("node id", nodes.where(~F.coalesce(node.rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.lit(False))), node)
    add("repeated edge", graph.repeated(edges, "page_id", "edge_id"), edge)
    for column in ("criticality", "maturity", "source_basis", "type"):
        add(column, nodes.where(~F.coalesce(F.col(column).isin(*TAXONOMIES[column]), F.lit(False))), node)
    add("flow type", edges.where(~F.coalesce(F.col("flow_type").isin(*TAXONOMIES["flow_type"]), F.lit(False))), edge)
    layers, owners = list((spec.get("styles") or {}).get("layers") or {}), list(spec.get("owners") or {})
    add("layer", nodes.where(~F.coalesce(F.col("layer").isin(layers), F.lit(False))), node)
    add("group layer", groups.where(~F.coalesce(F.col("layer").isin(layers), F.lit(False))), F.col("group_id"))
    grouped = nodes.where(F.col("group").isNotNull()).join(groups.select("page_id", F.col("group_id").alias("group")), ["page_id", "group"], "left_anti")
    add("unknown group", grouped, node)
    known = F.array(*map(F.lit, owners)).cast("array<string>")
    for column in ("architecture_owner", "implementation_owner", "reviewers"):
        add(f"unknown {column}", nodes.where(F.size(F.array_except(column, known)) > 0), node)
    for column in _LISTS:
        if column not in ("reviewers", "dependencies", "next_modules"):
            add(f"empty {column}", nodes.where((F.size(column) < 1) | F.exists(column, lambda x: F.trim(x) == "")), node)
    add("empty fallback", nodes.where(F.trim(F.coalesce("fallback", F.lit(""))) == ""), node)
    for name, rows, key in (("node", nodes, node), ("group", groups, F.col("group_id"))):
        add(f"{name} geometry", rows.where(~F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull(), F.lit(False))), key)
    orphans = graph.orphan_edges(nodes, edges)
    add("orphan edge", orphans, F.concat_ws(" > ", "source", "target"))
    add("dependencies and edges differ", graph.dependency_faults(nodes, edges), node)
    add("label without an interface", graph.unsupported_labels(nodes, edges), F.concat_ws(" > ", "source", "target"))
    add("overlap", graph.overlaps(nodes), F.concat_ws(" & ", "a", "b"))
    boxes = nodes.select("page_id", "node_id", "x", "y", "w", "h").union(groups.select("page_id", "group_id", "x", "y", "w", "h"))
    wide = graph.page_bounds(boxes).join(pages, "page_id")
    add("page too wide", wide.where((F.col("width") > F.col("max_width")) | (F.col("aspect") > F.col("max_aspect"))), F.col("width"))
    add("long decision", nodes.where((F.col("type") == "decision") & (F.length("title") > 32)), node)
    names = lambda column, parts: F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(F.lower(column), x))
    add("module as a decision", nodes.where((F.col("type") == "decision") & names("title", NO_DECISION)), node)
    add("module as a graph node", nodes.where((F.col("type") == "graph_node") & names("title", NO_GRAPH_NODE)), node)
    contract = F.lower(F.concat_ws(" ", *(c for c in _LISTS if c not in ("architecture_owner", "implementation_owner", "reviewers")), "fallback"))
    add("placeholder", nodes.where(names(contract, PLACEHOLDERS) | contract.rlike("execute bounded .+ policy")), node)
    actual = nodes.where("type = 'graph_node'")
    add("graph node on another page", actual.where(F.col("page_id") != GRAPH_PAGE), node)
    add("graph node type", actual.where(~F.coalesce(F.col("graph_node_type").isin(*GRAPH_NODE_TYPES), F.lit(False))), node)
    busy = nodes.where((F.col("page_id") == FULL_PAGE) & F.col("type").isin("process", "decision", "control")).groupBy("page_id").agg(F.count("*").alias("n"))
    add("too many processing nodes", busy.where(F.col("n") > FULL_PAGE_NODES), F.col("n"))
    if modules:
        wanted = lambda values, ddl: spark.createDataFrame(values, ddl)
        on_page = F.col("page_id") == GRAPH_PAGE
        types, relations = (wanted([(GRAPH_PAGE, x) for x in v], "page_id string, subject string") for v in (GRAPH_NODE_TYPES, GRAPH_RELATIONS))
        add("missing graph node type", types.join(nodes.where(on_page).select(F.col("graph_node_type").alias("subject")), "subject", "left_anti"), F.col("subject"))
        add("missing graph relation", relations.join(edges.where(on_page).select(F.element_at(F.split(F.trim("label"), r"\s+"), 1).alias("subject")), "subject", "left_anti"), F.col("subject"))
        scoped = wanted([(None, *x) for x in SCOPED], "page_id string, title string, criticality string, scope string").alias("s")
        own = nodes.select("title", "criticality", "criticality_scope").alias("n")
        fits = (F.col("s.title") == F.col("n.title")) & (F.col("s.criticality") == F.col("n.criticality")) & F.contains(F.lower("n.criticality_scope"), F.lower("s.scope"))
        add("missing criticality", scoped.join(own, fits, "left_anti"), F.col("title"))
        add("missing module", wanted([(None, x) for x in TITLES], "page_id string, title string").join(nodes.select("title"), "title", "left_anti"), F.col("title"))
    if whole_pages is not None:
        form = [(check, page, None if subject is None else str(subject)) for check, page, subject in _form(spec, whole_pages)]
        found.append(spark.createDataFrame(form, "check string, page_id string, subject string"))
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out


def summary(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """field, value and nodes: how many nodes have each state, and each owner by role."""
    nodes = frames(spark, spec)["nodes"]
    out = graph.label_counts(nodes, "criticality", "maturity", "source_basis", "type")
    for role in ("architecture_owner", "implementation_owner", "reviewers"):
        out = out.union(nodes.select(F.lit(role).alias("field"), F.explode(role).alias("value")).groupBy("field", "value").agg(F.count("*").alias("nodes")))
    return out


def flowcharts(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    f = frames(spark, spec)
    return graph.mermaid(f["nodes"], f["edges"])


def generate(spark: SparkSession, path: str | Path, root: str | Path, whole_pages: int = 9, modules: bool = True) -> dict[str, Any]:
    """Check the spec of a file, then write each page's flowchart, a summary (with the file's sha256) and a report on quality
    below root; a spec with faults, or a file that would lie elsewhere, is an error."""
    spec, root = load(path), Path(root).resolve()
    if bad := faults(spark, spec, whole_pages, modules).orderBy("check", "page_id", "subject").limit(20).collect():
        raise ValueError("the spec has faults: " + "; ".join(f"{r.check} ({r.page_id}, {r.subject})" for r in bad))
    texts = {r.page_id: r.text for r in flowcharts(spark, spec).collect()}
    f = frames(spark, spec)
    states: dict[str, dict[str, int]] = {}
    for r in summary(spark, spec).orderBy("field", "value").collect():
        states.setdefault(r["field"], {})[r["value"]] = r["nodes"]
    per_page = [{"id": p["id"], "title": p["title"], "nodes": len(p["nodes"]), "edges": len(p["edges"])} for p in spec["pages"]]
    gaps = [f"{r.page_id}: {r.a}, {r.b}" for r in graph.tight_gaps(f["nodes"]).orderBy("page_id", "a", "b").collect()]
    out = {
        "spec_sha256": hashlib.sha256(Path(path).read_bytes()).hexdigest(), "page_count": len(per_page), "node_count": sum(p["nodes"] for p in per_page),
        "edge_count": sum(p["edges"] for p in per_page), "pages": per_page, "states": states, "tight_gaps": gaps,
    }
    lines = ["# Quality report", "", f"{out['page_count']} pages, {out['node_count']} nodes, {out['edge_count']} edges; no faults.", "", "## Pages", ""]
    lines += [f"- {p['id']} {p['title']}: {p['nodes']} nodes, {p['edges']} edges" for p in per_page]
    lines += ["", "## Nodes that lie close together", "", *([f"- {g}" for g in gaps] or ["- none"])]
    for field, values in states.items():
        lines += ["", f"## {field}", "", *(f"- {k}: {n}" for k, n in values.items())]
    files = {f"mermaid/{p['mermaid_file']}": texts.get(p["id"], "") + "\n" for p in spec["pages"]}
    files |= {"generated/summary.json": json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True) + "\n", "generated/quality_report.md": "\n".join(lines) + "\n"}
    targets = {(root / name).resolve(): text for name, text in files.items()}
    if outside := [str(t) for t in targets if not t.is_relative_to(root)]:
        raise ValueError(f"outside of {root}: {', '.join(outside)}")
    for target, text in targets.items():
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8", newline="\n")
    return out
