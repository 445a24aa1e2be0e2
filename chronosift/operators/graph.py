"""Metadata graphs as triples (s, p, o): cleaning, basic patterns, bounded subgraphs, contexts.

Resources are compared whole; predicates by their local name, the text after
the last ``#``, so that no namespace is built in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.lineage import cut

EMOTIONS = ("anger", "disgust", "fear", "happiness", "neutral", "sadness", "surprise")


def local(c: Column | str) -> Column:
    return F.regexp_replace(c if isinstance(c, Column) else F.col(c), "^.*#", "")


def objects(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    """s and the object of a predicate, as name."""
    return triples.filter(local("p") == predicate).select("s", F.col("o").alias(name))


def of_type(triples: DataFrame, kind: str) -> DataFrame:
    return triples.filter((local("p") == "type") & (local("o") == kind)).select("s").distinct()


def without_resources(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Triples whose subject and object are not in gone (s)."""
    g = gone.select(F.col("s").alias("gone")).distinct()
    return triples.join(g, triples["s"] == g["gone"], "left_anti").join(g, triples["o"] == g["gone"], "left_anti")


def clean_series(triples: DataFrame, links: DataFrame, kind: str = "TimeSeries", source: str = "timeSeriesSource") -> DataFrame:
    """The triples without series whose source is not among links (link); series without a source stay."""
    first = of_type(triples, kind).join(objects(triples, source, "source").groupBy("s").agg(F.min("source").alias("source")), "s")
    return without_resources(triples, first.join(links.select(F.col("link").alias("source")), "source", "left_anti"))


def csv_objects(triples: DataFrame) -> DataFrame:
    """Distinct objects that end in .csv, as link."""
    return triples.filter(F.lower("o").endswith(".csv")).select(F.col("o").alias("link")).distinct()


def compare_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """link, where: both, or only the first or second."""
    x, y = a.select("link").distinct().withColumn("_a", F.lit(True)), b.select("link").distinct().withColumn("_b", F.lit(True))
    both = x.join(y, "link", "full")
    return both.select("link", F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_first").otherwise("only_second").alias("where"))


def series_metadata(triples: DataFrame, kind: str = "TimeSeries") -> DataFrame:
    """s, source, key, value, measure of each series: optional parts null, one row for each combination."""
    ts = of_type(triples, kind)
    prop = objects(triples, "hasProperty", "_p").join(objects(triples, "hasKey", "key").withColumnRenamed("s", "_p"), "_p").join(objects(triples, "hasValue", "value").withColumnRenamed("s", "_p"), "_p").select("s", "key", "value")
    measure = objects(triples, "hasMeasure", "_m").join(objects(triples, "hasMeasureName", "measure").withColumnRenamed("s", "_m"), "_m").select("s", "measure")
    return ts.join(objects(triples, "timeSeriesSource", "source"), "s", "left").join(prop, "s", "left").join(measure, "s", "left")


def series_summary(triples: DataFrame) -> DataFrame:
    """series, source, measure and method names taken from the local names of linked resources; unknown where there is none."""
    src = objects(triples, "timeSeriesSource", "source").groupBy("s").agg(F.max("source").alias("source"))
    measure = objects(triples, "hasMeasure", "m").groupBy("s").agg(F.max(F.replace(local("m"), F.lit("Measure"), F.lit(""))).alias("measure"))
    prop = objects(triples, "hasProperty", "x").filter(F.lower(local("x")).contains("method")).groupBy("s").agg(F.max(F.replace(local("x"), F.lit("method"), F.lit(""))).alias("method"))
    return src.join(measure, "s", "left").join(prop, "s", "left").select(local("s").alias("series"), "source", F.coalesce("measure", F.lit("unknown")).alias("measure"), F.coalesce("method", F.lit("unknown")).alias("method"))


def distributions(series: DataFrame, names: tuple[str, ...] = EMOTIONS) -> DataFrame:
    """kind, name, n, percent: series by the first emotion in their name, and by their method and quadrant (key, value)."""
    ids = series.select("s").distinct()
    total = ids.agg(F.count("*").alias("total"))
    first = None
    for e in names:
        first = F.when(F.col("s").contains(e), e) if first is None else first.when(F.col("s").contains(e), e)
    emotions = ids.select(F.lit("emotion").alias("kind"), first.alias("name")).filter(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.count("*").alias("n"))
    props = series.filter(F.col("key").isin("method", "quadrant")).select("s", "key", "value").distinct().groupBy(F.col("key").alias("kind"), F.col("value").alias("name")).agg(F.count("*").alias("n"))
    return emotions.unionByName(props).join(F.broadcast(total)).select("kind", "name", "n", (F.col("n") / F.col("total") * 100).alias("percent"))


def contexts(triples: DataFrame) -> DataFrame:
    """participant, age, panas, personality, gender from the properties of ``P<id>State`` and the sex of ``P<id>``. Male is tried before Female, letter for letter."""
    states = triples.filter(local("p") == "hasParticipant").select(local("s").alias("state")).filter(F.col("state").endswith("State")).distinct()
    ids = states.select(F.regexp_replace(F.replace("state", F.lit("State"), F.lit("")), "P", "").alias("participant"))
    p = triples.filter(local("p") == "hasProperty").select(F.regexp_extract(local("s"), "^P(.*)State$", 1).alias("participant"), local("o").alias("name")).filter("participant <> ''")
    age, panas = F.col("name").startswith("age"), F.col("name").contains("PANAS")
    own = p.groupBy("participant").agg(
        F.max(F.when(age, F.replace("name", F.lit("age"), F.lit("")))).alias("age"),
        F.max(F.when(~age & panas, F.replace("name", F.lit("dominantPANAS"), F.lit("")))).alias("panas"),
        F.max(F.when(~age & ~panas & F.col("name").contains("Personality"), F.replace("name", F.lit("dominantPersonality"), F.lit("")))).alias("personality"),
    )
    sex = triples.filter(local("p") == "hasSex").select(F.regexp_extract(local("s"), "^P(.*)$", 1).alias("participant"), F.when(local("o").contains("Male"), "Male").when(local("o").contains("Female"), "Female").alias("g")).groupBy("participant").agg(F.max("g").alias("gender"))
    return ids.join(own, "participant", "left").join(sex, "participant", "left")


def with_context(series: DataFrame, context: DataFrame, name: str) -> DataFrame:
    """Rows with the context of the participant in the file name (``P<id>V``)."""
    return series.withColumn("participant", F.regexp_extract(name, r"P(\d+)V", 1)).join(context, "participant", "left")


def subgraph(triples: DataFrame, start: str, depth: int = 2, hub: str = "#exp") -> DataFrame:
    """Triples met from a resource: those from and to it, and to what has it as object, for depth steps.

    Only edges towards visited resources are followed, and nodes ending in hub
    are taken but not left. A step is one semi join; the steps are few.
    """
    t = triples.select("s", "p", "o")
    front = t.sparkSession.createDataFrame([(start,)], "node string")
    visited, found = front, None
    for step in range(depth + 1):
        out = t.join(front, t["s"] == front["node"], "left_semi")
        into = t.join(front, t["o"] == front["node"], "left_semi")
        found = out.unionByName(into) if found is None else found.unionByName(out).unionByName(into)
        if step < depth:
            front = into.filter(~F.col("s").endswith(hub)).select(F.col("s").alias("node")).distinct().join(visited, "node", "left_anti")
            visited = visited.unionByName(front)
    return found.distinct()


def subgraphs(triples: DataFrame, starts: DataFrame, depth: int = 2, hub: str = "#exp") -> DataFrame:
    """subgraph() of many resources at once: label, s, p, o for starts (label, s).

    The front is a set of (node, labels): the labels of all starts that reach a
    node travel along an edge together, so that each step is one join of the
    triples with the front and one aggregation by node, whatever the number of
    starts. A node is left once for each label.
    """
    t = triples.select("s", "p", "o").distinct()
    gathered = lambda df: df.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    front = cut(gathered(starts.select(F.col("s").alias("node"), F.col("label").cast("string").alias("label"))))
    visited, found = front, []
    for step in range(depth + 1):
        out = t.join(front, t["s"] == front["node"]).select("s", "p", "o", "labels")
        into = t.join(front, t["o"] == front["node"]).select("s", "p", "o", "labels")
        found += [out, into]
        if step < depth:
            reached = gathered(into.filter(~F.col("s").endswith(hub)).select(F.col("s").alias("node"), F.explode("labels").alias("label")))
            before = visited.select(F.col("node").alias("n"), F.col("labels").alias("seen"))
            new = reached.join(before, F.col("node") == F.col("n"), "left").select("node", F.array_except("labels", F.coalesce("seen", F.expr("cast(array() as array<string>)"))).alias("labels"))
            front = cut(new.filter(F.size("labels") > 0))
            both = visited.unionByName(front)
            visited = cut(both.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))) if step + 1 < depth else visited
    return reduce(DataFrame.unionByName, found).select(F.explode("labels").alias("label"), "s", "p", "o").distinct()


def activities(triples: DataFrame, video: int | None = None) -> DataFrame:
    """label (``P<n>V<m>``) and s of each activity's resource ``actExecP<n>V<m>``, of one video if it is given."""
    found = triples.select("s", F.regexp_extract(local("s"), r"^actExec(P\d+V\d+)$", 1).alias("label")).filter("label <> ''").distinct()
    return found.filter(F.regexp_extract("label", r"V(\d+)$", 1) == str(video)) if video is not None else found


def named_nodes(triples: DataFrame, target: str) -> DataFrame:
    """Triples around resources whose local name holds target, not followed by a digit: theirs, those to them, and those of what points to them."""
    own = triples.filter(local("s").contains(target) & F.regexp_like(local("s"), F.lit(f"{target}(?![0-9])"))).select(F.col("s").alias("n")).distinct()
    a, b = triples.join(own, triples["s"] == own["n"], "left_semi"), triples.join(own, triples["o"] == own["n"], "left_semi")
    pointing = b.select(F.col("s").alias("n")).distinct()
    return a.unionByName(b).unionByName(triples.join(pointing, triples["s"] == pointing["n"], "left_semi")).distinct()


def only_scenario(triples: DataFrame, text: str, hub: str = "exp", predicate: str = "hasScenario") -> DataFrame:
    """The triples without the hub's scenarios whose object does not hold text."""
    return triples.filter(~((local("s") == hub) & (local("p") == predicate) & ~F.col("o").contains(text)))


def participant_video(triples: DataFrame, participant: int, video: int) -> DataFrame:
    """The subgraph of one activity, with nodes and series named after it, without other scenarios."""
    name = f"P{participant}V{video}"
    starts = triples.filter(local("s") == f"actExec{name}").select("s").first()
    if starts is None:
        return triples.limit(0)
    obs = triples.filter((local("p") == "hasObservableInformation") & (local("o") == f"obsInf{name}")).select(F.col("s").alias("n")).distinct()
    series = triples.join(obs, triples["s"] == obs["n"], "left_semi")
    return only_scenario(subgraph(triples, starts["s"]).unionByName(named_nodes(triples, name)).unionByName(series).distinct(), f"{participant}V{video}")


def videos_by_participant(names: DataFrame, name: str) -> DataFrame:
    """participant, videos (sorted texts) of names with ``P<n>V<m>``."""
    found = names.select(F.regexp_extract(name, r"P(\d+)V(\d+)", 1).alias("participant"), F.regexp_extract(name, r"P(\d+)V(\d+)", 2).alias("video")).filter("participant <> ''")
    return found.groupBy("participant").agg(F.array_sort(F.collect_set("video")).alias("videos"))
