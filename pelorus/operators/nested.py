"""Deeply nested JSON turned into flat tables that keep parent-child links.

The payload is parsed once into a VARIANT. Nested ``transform`` calls carry the ancestor's path and the
position into each array, ``flatten`` joins the levels, and one ``inline`` per target emits the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "array<struct<kind:string,path:string,parent:string,node:variant>>"
KINDS = ("task", "source", "ext_source", "nested", "component")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def children(parent: Column, path: Column, field: str, kind: str) -> Column:
    """The objects in ``field`` of a variant as nodes; an object in place of an array is its element 0.

    Positions count null and non-object elements, which are no nodes.
    """
    value = F.try_variant_get(parent, f"$.{field}", "variant")
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<variant>"))

    def node(v: Column, i: Column) -> Column:
        where = F.concat(F.when(path == "", F.lit("")).otherwise(F.concat(path, F.lit("."))), F.lit(field + "["), i.cast("string"), F.lit("]"))
        return F.struct(F.lit(kind).alias("kind"), where.alias("path"), path.alias("parent"), v.alias("node"))

    return F.filter(F.transform(items, node), lambda n: _is_object(n["node"]))


def _each(nodes: Column, field: str, kind: str) -> Column:
    return F.flatten(F.transform(nodes, lambda n: children(n["node"], n["path"], field, kind)))


def _components(nodes: Column) -> Column:
    """The fit components of sources: their array lies one object deeper, but their parent is the source."""
    def of(n: Column) -> Column:
        value = F.try_variant_get(n["node"], "$.m_fitPars.pars", "variant")
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<variant>"))
        return F.filter(
            F.transform(items, lambda v, i: F.struct(F.lit("component").alias("kind"), F.concat(n["path"], F.lit(".m_fitPars.pars["), i.cast("string"), F.lit("]")).alias("path"), n["path"].alias("parent"), v.alias("node"))),
            lambda c: _is_object(c["node"]),
        )

    return F.flatten(F.transform(nodes, of))


def node_arrays(collections: DataFrame, payload: str = "payload") -> DataFrame:
    """Add an array of nodes for each kind: task, source, ext_source, nested, component.

    The depth of nested sources is found first, by one aggregation for eight levels at a time; there is no limit to it.
    """
    root = F.try_parse_json(payload)
    d = collections.withColumn("_root", root).withColumn("task", F.when(F.col("_root").isNotNull(), children(F.col("_root"), F.lit(""), "tasks", "task")).otherwise(F.array().cast(NODE)))
    d = d.withColumns({"source": _each(F.col("task"), "sources", "source"), "ext_source": _each(F.col("task"), "ext_sources", "ext_source")})
    levels, found = 0, 8
    d = d.withColumn("_level0", F.concat("source", "ext_source"))
    while found:
        for _ in range(8):
            d = d.withColumn(f"_level{levels + 1}", _each(F.col(f"_level{levels}"), "m_NestedSources", "nested"))
            levels += 1
        sizes = d.agg(*(F.max(F.size(f"_level{k}")).alias(str(k)) for k in range(levels - 7, levels + 1))).first()
        found = sizes[-1] or 0
    depth = max((int(k) for k, v in sizes.asDict().items() if v), default=max(0, levels - 8))
    kept = [f"_level{k}" for k in range(1, depth + 1)]
    nested = F.flatten(F.array(*kept)) if kept else F.array().cast(NODE)
    d = d.withColumn("nested", nested)
    d = d.withColumn("component", _components(F.flatten(F.array("source", "ext_source", "nested"))))
    return d.drop("_root", *(f"_level{k}" for k in range(levels + 1)))


def node_table(collections: DataFrame, key: str = "coll_id", payload: str = "payload") -> DataFrame:
    """key, kind, node_path, parent_path of every node of every kind, in one pass.

    Null, blank and malformed payloads, and payloads without tasks, give no rows; empty objects are nodes.
    """
    d = node_arrays(collections.select(key, payload), payload)
    slim = F.transform(F.flatten(F.array(*KINDS)), lambda n: F.struct(n["kind"].alias("kind"), n["path"].alias("node_path"), n["parent"].alias("parent_path")))
    return d.select(key, F.inline(slim))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get(F.col("node"), path, kind)


# the typed fields of each flat table; a value of another type becomes null, or is cast where it can be
FIELDS = {
    "task": {"job_id": ("$.jobId", "string"), "worker_id": ("$.workerId", "bigint"), "task_id": ("$.taskId", "bigint"), "ix_min": ("$.ix_min", "double"), "ix_max": ("$.ix_max", "double"), "iy_min": ("$.iy_min", "double"), "iy_max": ("$.iy_max", "double")},
    "source": {"source_id": ("$.blob.Id", "bigint"), "name": ("$.blob.Name", "string"), "n_pix": ("$.blob.NPix", "bigint"), "x0": ("$.blob.X0", "double"), "y0": ("$.blob.Y0", "double"), "s": ("$.blob.m_S", "double"), "morph_id": ("$.MorphId", "int")},
    "component": {"bmaj": ("$.m_bmaj", "double"), "bmin": ("$.m_bmin", "double"), "selected": ("$.m_selected", "boolean")},
}
FIELDS["ext_source"] = FIELDS["nested"] = FIELDS["source"]


def flat_tables(collections: DataFrame, key: str = "coll_id", payload: str = "payload") -> dict[str, DataFrame]:
    """One frame per kind: key, node_path, parent_path and the typed fields of the kind."""
    d = node_arrays(collections.select(key, payload), payload)
    return {
        kind: d.select(key, F.inline(kind)).select(key, F.col("path").alias("node_path"), F.col("parent").alias("parent_path"), *(_get(p, t).alias(n) for n, (p, t) in FIELDS[kind].items()))
        for kind in KINDS
    }
