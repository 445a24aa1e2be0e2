"""Writers and renderers: interval tables, sequence text, patterns and rules, statistics, reports.

Parquet is canonical; text and CSV are for exchange. Writers never coalesce to
one file unless asked to.
"""

from __future__ import annotations

import json
from itertools import islice
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.functions import exprs
from chronosift.operators import rules as rule_ops
from chronosift.shipping import ship
from chronosift.sources.readers import RDF

ORDER = ["client_id", "start_time", "end_time", "state"]


def intervals_csv(intervals: DataFrame, path: str, one_file: bool = False) -> None:
    """client_id, state, start_time, end_time in order of client, start, end and state."""
    rows = intervals.select("client_id", "state", "start_time", "end_time").orderBy(*ORDER)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True)


def sequence_lines(intervals: DataFrame) -> DataFrame:
    """value: one text a client, its head and rows, an empty line at the end."""
    row = F.struct("start_time", "end_time", "state")
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat_ws(" ", x["state"], x["start_time"].cast("string"), x["end_time"].cast("string")))
    return intervals.groupBy("client_id").agg(lines.alias("rows")).select("client_id", F.concat(F.lit("SEQUENCE "), "client_id", F.lit("\n"), F.array_join("rows", "\n"), F.lit("\n")).alias("value"))


def sequence_text(intervals: DataFrame, path: str) -> None:
    sequence_lines(intervals).orderBy("client_id").select("value").write.mode("overwrite").text(path)


def save_results(patterns: DataFrame, rules: DataFrame, folder: str, top: int = 1000) -> None:
    """Patterns, and the top rules by confidence and support, as Parquet, JSON and CSV."""
    text = patterns.withColumn("description", exprs.pattern_text(F.col("states"), F.col("relations")))
    best = rule_ops.top_rules(rules, top)
    flat = text.select("grp", "size", F.array_join("states", ", ").alias("states"), F.array_join("relations", ", ").alias("relations"), "support", "support_count", "description")
    for name, full, plain in (("patterns", text, flat), ("rules", best, best.select("grp", "antecedent", "consequent", "confidence", "lift", "support"))):
        full.write.mode("overwrite").parquet(f"{folder}/{name}")
        full.write.mode("overwrite").json(f"{folder}/{name}_json")
        plain.write.mode("overwrite").csv(f"{folder}/{name}_csv", header=True)


def partitioned(features: DataFrame, path: str) -> None:
    """Feature rows by data set and participant."""
    features.write.mode("overwrite").partitionBy("dataset", "participant_id").parquet(path)


def statistics_csv(summary: DataFrame, path: str) -> None:
    """metric, value."""
    summary.select("metric", "value").coalesce(1).write.mode("overwrite").csv(path, header=True)


def triples_text(triples: DataFrame, path: str) -> None:
    """N-Triples; objects without a scheme are literals."""
    o = F.when(F.col("o").rlike("^[a-z]+://|^_:"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value")).write.mode("overwrite").text(path)


#: Triples in an RDF/XML document, some 4 MB, which one task reads.
RDF_DOCUMENT = 20_000


def rdf_xml(triples: DataFrame, path: str) -> None:
    """RDF/XML: documents of at most RDF_DOCUMENT triples, an element for each; objects with a scheme or a # are resources, others literals."""
    ship(triples.sparkSession)
    size = RDF_DOCUMENT

    def documents(batches):
        import pyarrow as pa

        elements = (rdf_element(*(x.as_py() for x in t)) for b in batches for t in zip(*b.columns, strict=True))
        while lines := list(islice(elements, size)):
            text = "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', f'<rdf:RDF xmlns:rdf="{RDF}">', *lines, "</rdf:RDF>"])
            yield pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])

    triples.select("s", "p", "o").mapInArrow(documents, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def rdf_element(s: str, p: str, o: str) -> str:
    """One triple; a predicate's name is what follows its last # or /."""
    at = max(p.rfind("#"), p.rfind("/")) + 1
    head = f"<rdf:Description rdf:about={quoteattr(s)}><p:{p[at:]} xmlns:p={quoteattr(p[:at])}"
    if "#" in o or "://" in o:
        return f"{head} rdf:resource={quoteattr(o)}/></rdf:Description>"
    return f"{head}>{escape(o)}</p:{p[at:]}></rdf:Description>"


def table_markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a small frame as a Markdown table."""
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in df.limit(rows).collect())])


def report(title: str, parameters: dict, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A Markdown report: parameters, then a table a section, of its first rows."""
    out = [f"# {title}", "", "## Parameters", "", *(f"- {k}: {v}" for k, v in parameters.items())]
    for name, df in sections.items():
        out += ["", f"## {name}", "", table_markdown(df, rows)]
    return "\n".join(out) + "\n"


def experiment_report(title: str, summary: dict, patterns: DataFrame, rules: DataFrame, top: int = 15) -> str:
    """A Markdown report of six sections from experiment_json's summary and the patterns and rules common to all data sets.

    patterns: pattern and avg_support; rules: signature, avg_confidence and
    avg_support; both with any other columns, shown as they are. The top ones
    by the average of support, or of confidence, are listed.
    """
    table = lambda rows: ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(str(r.get(c, "")) for c in rows[0]) + " |" for r in rows)] if rows else ["None."]
    parameters = [{"parameter": k, "value": v} for k, v in summary.get("parameters", {}).items()]
    filters = [f"- {k}: {'on' if v else 'off'}" for k, v in summary.get("filters", {}).items()]
    n = {"patterns": patterns.count(), "rules": rules.count()}
    common = [f"- {k} common to all data sets: {v}" for k, v in n.items()]
    best = {"patterns": patterns.orderBy(F.desc("avg_support"), "pattern"), "rules": rules.orderBy(F.desc("avg_confidence"), F.desc("avg_support"), "signature")}
    listed = {k: [table_markdown(df, top)] if n[k] else [f"No {k} are common to all data sets."] for k, df in best.items()}
    found = f"Of {len(summary.get('datasets', []))} data sets, {n['patterns']} patterns and {n['rules']} rules are common to all."
    sections = {"Methodology": [*table(parameters), "", *filters], "Data sets": table(summary.get("datasets", [])), "Similarity": common, "Common patterns": listed["patterns"], "Common rules": listed["rules"], "Conclusions": [found]}
    return "\n".join([f"# {title}", *(line for name, body in sections.items() for line in ("", f"## {name}", "", *body))]) + "\n"


def experiment_json(parameters: dict, filters: dict, counts: DataFrame) -> str:
    """Parameters, filters and a row of counts for each data set, as JSON."""
    return json.dumps({"parameters": parameters, "filters": filters, "datasets": [r.asDict() for r in counts.collect()]}, sort_keys=True)
