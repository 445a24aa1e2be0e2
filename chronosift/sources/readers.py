"""Readers of the engine's inputs: interval tables, sequence text, feature files, signals, demographics, graphs, pages.

Schemas are given, never inferred. File names carry identifiers; they are read
from the file metadata, so that one scan covers many files.
"""

from __future__ import annotations

import csv
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce
from io import BytesIO
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronosift import schema
from chronosift.functions import exprs
from chronosift.shipping import ship

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Triples in a batch that a parser hands on.
RDF_ROWS = 10_000


def csv_by_header(spark: SparkSession, path: str | list[str], columns: list[str], renames: dict[str, str] | None = None, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of CSV files, each read by its own header.

    rows: the columns, as text, and ``_path`` of the file; a column that a file
    lacks is null there, of repeated names the first counts. renames: other names
    of columns. skipped: path and reason of the files that could not be read,
    have no header, or lack a required column; files of no bytes are not listed.

    A first scan finds the files' headers, a row for each file; then the files of
    one header are one scan, so that there are as many scans as headers.
    """
    option = {"ignoreCorruptFiles": "true"}
    lines = spark.read.options(**option).text(path).filter("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("no"))
    found = lines.groupBy("path").agg(F.min_by("value", "no").alias("header")).collect()  # a row for each file, which the driver lists anyway
    listed = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    groups: dict[str, list[str]] = {}
    for r in found:
        groups.setdefault(r.header, []).append(unquote(r.path))  # the metadata's paths are encoded
    read = {_plain(p) for ps in groups.values() for p in ps}
    skipped = [(p, "no header could be read") for p in listed if _plain(p) not in read]
    parts = []
    for header, paths in sorted(groups.items()):
        names = [(renames or {}).get(n.strip(), n.strip()) for n in next(csv.reader([header]), [])]
        if not any(names):
            skipped += [(p, "no header could be read") for p in paths]
            continue
        lacking = [c for c in required or [] if c not in names]
        if lacking:
            skipped += [(p, "lacks " + ", ".join(lacking)) for p in paths]
            continue
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.options(**option).csv([re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths], header=True, schema=fields, enforceSchema=True)
        parts.append(raw.select(*[(F.col(f"c{names.index(c)}") if c in names else F.lit(None).cast("string")).alias(c) for c in columns], F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("_path")))
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_path"]]))
    return reduce(lambda a, b: a.unionByName(b), parts, empty), spark.createDataFrame(sorted(skipped), "path string, reason string")


def _plain(path: str) -> str:
    """A path without the scheme's slashes, which listings write in different ways."""
    return re.sub("^file:/*", "/", path)


#: Older names of the interval table's columns.
LEGACY = {"ClientID": "client_id", "State": "state", "StartTime": "start_time", "EndTime": "end_time"}


def intervals_csv(spark: SparkSession, path: str, renames: dict[str, str] | None = None) -> DataFrame:
    """client_id, state, start_time, end_time of CSV files with a header, whatever the order of each one's columns; files without one of them are left out. renames: legacy column names."""
    names = schema.INTERVALS.names
    rows, _ = csv_by_header(spark, path, names, renames or LEGACY, names)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.INTERVALS])


def sequence_text(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of sequence text: ``SEQUENCE <id>`` heads the rows ``state start end`` below it.

    Rows before a head or of fewer than three words are ignored; a repeated
    identifier replaces its former sequence. The order of lines matters, so a
    file is one row; many files are read in parallel.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    lines = files.select("file", F.posexplode("lines").alias("no", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("file").orderBy("no")
    head = F.when(F.col("line").startswith("SEQUENCE"), F.struct(F.col("no").alias("at"), F.trim(F.expr("substring(line, 9)")).alias("id")))
    marked = lines.withColumn("head", head).withColumn("cur", F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.split("line", r"\s+")
    rows = marked.filter(F.col("head").isNull() & F.col("cur").isNotNull() & (F.size(words) >= 3)).select("file", "no", F.col("cur.at").alias("at"), F.col("cur.id").alias("client_id"), words[0].alias("state"), words[1].try_cast("double").alias("start_time"), words[2].try_cast("double").alias("end_time"))
    heads = marked.filter(F.col("head").isNotNull()).groupBy("file", F.col("head.id").alias("client_id")).agg(F.max("head.at").alias("at"))
    return rows.join(heads, ["file", "client_id", "at"], "left_semi").select("client_id", "state", "start_time", "end_time")


def feature_files(spark: SparkSession, glob: str, dataset: str, columns: list[str], suffix: str = "_merged") -> DataFrame:
    """Window features of many CSV files, each by its own header; the participant is the file name before the suffix. Columns a file lacks are null, unreadable files are left out (``csv_by_header`` lists them)."""
    raw, _ = csv_by_header(spark, glob, columns)
    name = F.regexp_extract(F.col("_path"), f"([^/]*?){suffix}[^/]*$", 1)
    out = raw.select(F.lit(dataset).alias("dataset"), name.alias("participant_id"), *[F.col(c) if c in ("window_type", "gender", "age_group") else exprs.known(F.col(c)).alias(c) for c in columns])
    return out.withColumn("client_id", F.concat_ws("_", "dataset", "participant_id"))


def union_datasets(frames: dict[str, DataFrame | None], name: str = "dataset") -> DataFrame:
    """All tables there are, tagged with their names; missing ones are left out."""
    tagged = [df.withColumn(name, F.lit(k)) for k, df in frames.items() if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def tsv_signals(spark: SparkSession, path: str, fields: T.StructType = schema.WIDE_SIGNALS) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=fields)


def signal_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("timestamp", "value")) -> DataFrame:
    """Columns of signal files by each one's header, as doubles, with the folder above the file as participant; missing ones are null."""
    raw, _ = csv_by_header(spark, path, list(columns))
    return raw.select(F.regexp_extract("_path", "([^/]+)/[^/]+$", 1).alias("participant"), *[exprs.known(F.col(c)).alias(c) for c in columns])


def annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    """seconds, arousal, valence of annotation files, by each one's header."""
    names = ["seconds", "arousal", "valence"]
    raw, _ = csv_by_header(spark, path, names)
    return raw.select(*[exprs.known(F.col(c)).alias(c) for c in names])


def csv_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns asked for, as text, by each file's header; those that are missing are null."""
    return csv_by_header(spark, path, columns)[0].drop("_path")


_SAMPLE = "array<struct<TimeStamp:double,%s>>"
#: Arrays of the signal files and the values of their samples.
JSON_SIGNALS = {"ACC_RawData": ("ACC_X", "ACC_Y", "ACC_Z"), "EDA_RawData": ("EDA",), "SKT_RawData": ("SKT",), "BVP_RawData": ("BVP",), "IBI_RawData": ("IBI",)}


def json_signals(spark: SparkSession, path: str, arrays: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """file, video, signal, ts, value of nested signal files: the first record's videos, each with an array for each modality. Files are read once for all modalities."""
    arrays = arrays or JSON_SIGNALS
    video = ", ".join(["VideoID: string", *(f"{k}: {_SAMPLE % ','.join(f'{v}:double' for v in vs)}" for k, vs in arrays.items())])
    raw = spark.read.json(path, schema=f"Physio_RawData array<struct<Video_Physio_RawData: array<struct<{video}>>>>", multiLine=True)
    videos = raw.select(F.col("_metadata.file_name").alias("file"), F.explode(F.try_element_at("Physio_RawData", F.lit(1))["Video_Physio_RawData"]).alias("v")).select("file", "v.*")
    sample = lambda key, v: F.transform(key, lambda x: F.struct(F.lit(v).alias("signal"), x["TimeStamp"].alias("ts"), exprs.known(x[v]).alias("value")))
    none = F.array().cast("array<struct<signal:string,ts:double,value:double>>")
    samples = F.concat(*[F.coalesce(sample(key, v), none) for key, values in arrays.items() for v in values])
    return videos.select("file", F.col("VideoID").alias("video"), F.explode(samples).alias("x")).select("file", "video", "x.*")


def json_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, video, ts, valence, arousal of nested annotation files; of repeated videos the first."""
    sample = "array<struct<TimeStamp:double,X_Value:double,Y_Value:double>>"
    raw = spark.read.json(path, schema=f"ContinuousAnnotation_RawData array<struct<Video_Annotation_RawData: array<struct<VideoID: string, TimeStamp_Xvalue_Yvalue: {sample}>>>>", multiLine=True)
    v = raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.try_element_at("ContinuousAnnotation_RawData", F.lit(1))["Video_Annotation_RawData"]).alias("at", "v"))
    first = v.groupBy("file", F.col("v.VideoID").alias("video")).agg(F.min_by("v.TimeStamp_Xvalue_Yvalue", "at").alias("xs"))
    return first.select("file", "video", F.explode("xs").alias("x")).select("file", "video", F.col("x.TimeStamp").alias("ts"), F.col("x.X_Value").alias("valence"), F.col("x.Y_Value").alias("arousal"))


def file_names(spark: SparkSession, glob: str) -> DataFrame:
    """path and name of the files, without reading them."""
    return spark.read.format("binaryFile").load(glob).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"))


def file_pairs(names: DataFrame, pattern: str = r"^(.+?)_S(\d+)_C(\d+)_(input|BORIS_method_II)\.csv$", kinds: tuple[str, str] = ("input", "BORIS_method_II")) -> DataFrame:
    """sub, subject, clip and the two paths of files that are there in both kinds."""
    part = lambda i: F.regexp_extract("name", pattern, i)
    m = names.filter(F.col("name").rlike(pattern)).select("path", part(1).alias("sub"), part(2).alias("subject"), part(3).alias("clip"), part(4).alias("kind"))
    both = m.groupBy("sub", "subject", "clip").agg(*[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(a) for k, a in zip(kinds, ("signals", "ratings"), strict=True)])
    return both.filter(F.col("signals").isNotNull() & F.col("ratings").isNotNull()).withColumn("client_id", F.format_string("%s_S%s_C%s", "sub", "subject", "clip"))


def emotion_files(names: DataFrame, method: str | None = None, variant: str | None = None) -> DataFrame:
    """method, participant, video, emotion, path of files ``ts<method>P<n>V<m><emotion>[<variant>].csv``; without a variant those of GTE02 and LE02 are left out. A file in the method's own folder is preferred to one of the root."""
    pattern = r"^ts(FR|Exp3)P(\d+)V(\d+)(.+?)(GTE02|LE02)?\.csv$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    m = names.filter(F.col("name").rlike(pattern)).select("path", part(1).alias("method"), part(2).alias("participant"), part(3).alias("video"), part(4).alias("emotion"), part(5).alias("variant"))
    m = m.filter(F.col("variant") == (variant or ""))
    m = m.filter(F.col("method") == method) if method else m
    best = F.min(F.struct((~F.col("path").contains(F.concat(F.lit("/extracted/"), F.col("method"), F.lit("/")))).alias("other"), "path"))
    return m.groupBy("method", "participant", "video", "emotion").agg(best.alias("b")).select("method", "participant", "video", "emotion", F.col("b.path").alias("path"))


def emotion_states(rows: DataFrame, by: str, start: str, end: str, order: str, prefix: str = "EmotionRange") -> DataFrame:
    """client_id, position, state, start_time, end_time: each row's emotion columns as states ``<Emotion>_<value>``, in the order of rows and columns."""
    cols = [c for c in rows.columns if c.startswith(prefix)]
    states = F.array(*[F.struct(F.lit(i).alias("c"), F.when(F.col(c).isNotNull(), F.concat_ws("_", F.lit(c.removeprefix(prefix)), F.col(c).cast("string"))).alias("state")) for i, c in enumerate(cols)])
    long = rows.select(F.col(by).cast("string").alias("client_id"), F.col(order).alias("_o"), F.col(start).cast("double").alias("start_time"), F.col(end).cast("double").alias("end_time"), F.explode(states).alias("x")).filter("x.state IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("_o", "x.c")) - 1
    return long.select("client_id", place.alias("position"), F.col("x.state").alias("state"), "start_time", "end_time")


def of_gender(rows: DataFrame, by: str, order: str, gender: str, column: str = "Gender") -> DataFrame:
    """The rows of files whose first row has the gender; files without the column have none."""
    if column not in rows.columns:
        return rows.limit(0)
    first = rows.groupBy(by).agg(F.min_by(column, order).alias("_g")).filter(F.col("_g") == gender).select(by)
    return rows.join(first, by, "left_semi")


def demographics_csv(spark: SparkSession, path: str, dataset: str, participant: str, age: str | None, gender: str | None, sep: str = ",") -> DataFrame:
    """Canonical demographics of a CSV file; bands of ages become their midpoints."""
    raw = spark.read.csv(path, header=True, sep=sep)
    years = F.coalesce(F.col(age).try_cast("double"), exprs.band_midpoint(F.col(age))) if age else F.lit(None).cast("double")
    return demographics(raw.select(F.col(participant).cast("string").alias("participant_id"), years.alias("age"), (F.col(gender) if gender else F.lit(None)).cast("string").alias("gender")), dataset)


def demographics(rows: DataFrame, dataset: str) -> DataFrame:
    """dataset, participant_id, client_id, gender, age, age_group, binary_age_group of (participant_id, age, gender)."""
    return rows.select(F.lit(dataset).alias("dataset"), "participant_id", F.concat_ws("_", F.lit(dataset), "participant_id").alias("client_id"), exprs.clean_gender(F.col("gender")).alias("gender"), "age", exprs.age_group(F.col("age")).alias("age_group"), exprs.young_or_old(F.col("age")).alias("binary_age_group"))


def demographics_xlsx(spark: SparkSession, path: str, dataset: str, participant: str, age: str, gender: str) -> DataFrame:
    """Demographics of a workbook: one sheet, small by nature, read on the driver; needs an installed workbook reader."""
    import pandas as pd

    raw = spark.createDataFrame(pd.read_excel(path, dtype=str)[[participant, age, gender]].where(lambda d: d.notna(), None), "p string, a string, g string")
    return demographics(raw.select(F.col("p").alias("participant_id"), F.coalesce(F.col("a").try_cast("double"), exprs.band_midpoint(F.col("a"))).alias("age"), F.col("g").alias("gender")), dataset)


def rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """Triples (s, p, o) of RDF/XML files; each file is parsed by one task, many files in parallel. Of a file only its bytes and one node of its top level are held."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ["s", "p", "o"]

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(0):
                found = rdf_triples(content.as_py()) if len(content.as_py()) else iter(())
                while rows := list(islice(found, RDF_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in zip(*rows, strict=True)], names=names)

    return files.mapInArrow(parse, "s string, p string, o string").distinct()


def parse_rdf(content: bytes) -> list[tuple[str, str, str]]:
    """Triples of one RDF/XML document: typed nodes, property attributes, references, nested nodes and literals."""
    return list(rdf_triples(content))


def rdf_triples(content: bytes) -> Iterator[tuple[str, str, str]]:
    """The triples of parse_rdf, node by node of the top level; a node is dropped when its triples are out."""
    about, ident, resource, base = f"{{{RDF}}}about", f"{{{RDF}}}ID", f"{{{RDF}}}resource", "{http://www.w3.org/XML/1998/namespace}base"
    prefix, out, blanks = "", [], 0
    full = lambda u: u if "://" in u or not prefix else prefix + u if u.startswith("#") else f"{prefix}#{u}"
    name = lambda tag: tag[1:].replace("}", "") if tag.startswith("{") else tag

    def node(e: ET.Element) -> str:
        nonlocal blanks
        s = e.get(about) if e.get(about) is not None else f"#{e.get(ident)}" if e.get(ident) else None
        if s is None:
            blanks += 1
            s = f"_:b{blanks}"
        else:
            s = full(s)
        if name(e.tag) != f"{RDF}Description":
            out.append((s, f"{RDF}type", name(e.tag)))
        for k, v in e.attrib.items():
            if not k.startswith(f"{{{RDF}}}") and not k.startswith("{http://www.w3.org/XML"):
                out.append((s, name(k), v))
        for p in e:
            if p.get(resource) is not None:
                out.append((s, name(p.tag), full(p.get(resource))))
            elif len(p):
                out.extend((s, name(p.tag), o) for o in [node(c) for c in p])
            else:
                out.append((s, name(p.tag), (p.text or "").strip()))
        return s

    root, depth = None, 0
    for event, e in ET.iterparse(BytesIO(content), ("start", "end")):
        if event == "start":
            if root is None:
                root, prefix = e, e.get(base, "")
            depth += 1
            continue
        depth -= 1
        if depth == 1:
            node(e)
            yield from out
            out.clear()
            root.clear()


def href_links(pages: DataFrame, html: str, base: str = "", pattern: str = 'href="([^"]*\\.csv)"') -> DataFrame:
    """Distinct links of pages that match a pattern, relative ones after base."""
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("link"))
    return found.select(F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit(base), "link")).alias("link")).distinct()


def emotion_series(spark: SparkSession, path: str, emotion: str) -> DataFrame | None:
    """FrameMillis and EmotionRange<Emotion> of a series file; None if it lacks FrameMillis or Value."""
    raw = spark.read.csv(path, header=True)
    if not {"FrameMillis", "Value"} <= set(raw.columns):
        return None
    keep = [F.col("FrameMillis").cast("double")]
    if "EmotionRange" in raw.columns:
        keep.append(F.col("EmotionRange").alias(f"EmotionRange{emotion.capitalize()}"))
    return raw.select(*keep)


def results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(patterns, rules) that ``sinks.save_results`` wrote."""
    return spark.read.parquet(f"{folder}/patterns"), spark.read.parquet(f"{folder}/rules")


def cached_csv(spark: SparkSession, path: str, fields: T.StructType, make: Callable[[], DataFrame]) -> DataFrame:
    """The finished CSV at path; where there is none, what make returns, written there first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not (files.exists(done) or files.exists(place) and files.getFileStatus(place).isFile()):
        make().select(*fields.names).write.mode("overwrite").csv(path, header=True)
    return spark.read.csv(path, header=True, schema=fields)
