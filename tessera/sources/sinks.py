"""Sinks for tables, graphs and models. Graph files are text that executors build; single files are written in one part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAPHML = {"double": "double", "float": "double", "bigint": "long", "int": "long", "boolean": "boolean"}


def write_table(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv",)) -> None:
    """Parquet always, and CSV or JSON on request."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    saved = df.sparkSession.read.parquet(f"{path}.parquet")
    if "csv" in formats:
        saved.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    if "json" in formats:
        saved.write.mode("overwrite").json(f"{path}.json")


def sanitise(df: DataFrame) -> DataFrame:
    """Graph attributes without missing values: empty text, 0 for numbers that are missing or not finite, false."""
    fill = {}
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            fill[c] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).otherwise(0.0)
        else:
            fill[c] = F.coalesce(F.col(c), F.lit(False) if kind == "boolean" else F.lit("") if kind == "string" else F.lit(0))
    return df.withColumns(fill)


def _escaped(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _with_ends(head: list[str], *bodies: DataFrame, tail: list[str]) -> DataFrame:
    """Lines in the order head, bodies, tail; each body has a column `line` and is sorted by it."""
    spark = bodies[0].sparkSession
    out = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, at long, line string")
    for k, b in enumerate(bodies):
        out = out.union(b.select(F.lit(k + 1), F.lit(0).cast("long"), "line"))
    out = out.union(spark.createDataFrame([(len(bodies) + 1, i, x) for i, x in enumerate(tail)], "part int, at long, line string"))
    return out.orderBy("part", "at", "line").select(F.col("line").alias("value"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GraphML file."""
    nodes, edges = sanitise(nodes), sanitise(edges)
    keys, made = [], []
    for tag, df, ids in (("node", nodes, ["gene"]), ("edge", edges, ["gene_a", "gene_b"])):
        data = []
        for c, kind in df.dtypes:
            if c not in ids:
                keys.append(f'<key id="{tag}_{c}" for="{tag}" attr.name="{c}" attr.type="{_GRAPHML.get(kind, "string")}"/>')
                data += [F.lit(f'<data key="{tag}_{c}">'), _escaped(F.col(c).cast("string")), F.lit("</data>")]
        i = [_escaped(F.col(x).cast("string")) for x in ids]
        opening = [F.lit('<node id="'), i[0]] if tag == "node" else [F.lit('<edge source="'), i[0], F.lit('" target="'), i[1]]
        made.append(df.select(F.concat(*opening, F.lit('">'), *data, F.lit(f"</{tag}>")).alias("line")))
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="undirected">']
    return _with_ends(head, *made, tail=["</graph>", "</graphml>"])


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GML file; spaces in names become underscores and booleans 0 or 1."""
    nodes, edges = sanitise(nodes), sanitise(edges)
    name = lambda c: F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("_"))
    made = []
    for tag, df, ids in (("node", nodes, ["gene"]), ("edge", edges, ["gene_a", "gene_b"])):
        parts = [F.lit('node [ label "'), name("gene"), F.lit('"')] if tag == "node" else [F.lit('edge [ source "'), name("gene_a"), F.lit('" target "'), name("gene_b"), F.lit('"')]
        for c, kind in df.dtypes:
            if c not in ids:
                value = F.concat(F.lit('"'), _escaped(F.col(c)), F.lit('"')) if kind == "string" else F.col(c).cast("int").cast("string") if kind == "boolean" else F.col(c).cast("string")
                parts += [F.lit(f" {c.replace('_', '')} "), value]
        made.append(df.select(F.concat(*parts, F.lit(" ]")).alias("line")))
    return _with_ends(["graph ["], *made, tail=["]"])


def edge_list(edges: DataFrame) -> DataFrame:
    """Edges with weights rounded to 6 places."""
    return edges.withColumns({c: F.round(c, 6) for c in ("weight", "abs_weight") if c in edges.columns})


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document of nodes and links. An exported subgraph is small; for a whole network write edge lists."""
    n = sanitise(nodes).withColumnRenamed("gene", "id")
    e = sanitise(edges).withColumnsRenamed({"gene_a": "source", "gene_b": "target"})
    left = n.agg(F.array_sort(F.collect_list(F.struct("id", *(c for c in n.columns if c != "id")))).alias("nodes"))
    right = e.agg(F.array_sort(F.collect_list(F.struct("source", "target", *(c for c in e.columns if c not in ("source", "target"))))).alias("links"))
    graph = F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")
    return left.crossJoin(right).select(F.to_json(graph).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML, GML, node-link JSON, and TSV lists of edges and nodes under one folder; nothing for a graph without edges."""
    if not edges.head(1):
        return
    write_lines(graphml_lines(nodes, edges), f"{path}/graphml")
    write_lines(gml_lines(nodes, edges), f"{path}/gml")
    write_lines(node_link_json(nodes, edges), f"{path}/json")
    for name, df in (("edges", edge_list(edges)), ("nodes", nodes)):
        df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{name}")
