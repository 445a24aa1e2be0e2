import json
import tracemalloc

from pyspark.sql import functions as F

from chronosift.operators import graph
from chronosift.plans import catalogue, exchange
from chronosift.sources import readers, sinks
from chronosift.streaming import windows as streams

ROWS = [("c1", "hr_low", 0.0, 5.0), ("c1", "eda_high", 0.0, 7.5), ("c2", "hr_low", 1.0, 2.0)]
SCHEMA = "client_id string, state string, start_time double, end_time double"


def tuples(df):
    return sorted(map(tuple, df.select("client_id", "state", "start_time", "end_time").collect()))


def test_interval_csv_and_sequence_text_round_trips(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    sinks.intervals_csv(df, f"{tmp_path}/csv", one_file=True)
    assert tuples(readers.intervals_csv(spark, f"{tmp_path}/csv")) == sorted(ROWS)
    sinks.sequence_text(df, f"{tmp_path}/seq")
    assert tuples(readers.sequence_text(spark, f"{tmp_path}/seq")) == sorted(ROWS)


def test_sequence_text_oddities(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x 1 2\nSEQUENCE a b\ns 0 1\nshort 1\n\nSEQUENCE z\nt 5 6\nSEQUENCE a b\nu 2 3 more\n")
    assert tuples(readers.sequence_text(spark, f"{tmp_path}/a.txt")) == [("a b", "u", 2.0, 3.0), ("z", "t", 5.0, 6.0)]


def test_feature_files_and_json(spark, tmp_path):
    (tmp_path / "p1_merged.csv").write_text("seconds,eda_mean,window_type\n5,1.5,fast\n10,,fast\n")
    (tmp_path / "p2_merged.csv").write_text("seconds,eda_mean,window_type\n5,nan,slow\n")
    got = sorted((r.client_id, r.seconds, r.eda_mean) for r in readers.feature_files(spark, f"{tmp_path}/*_merged.csv", "D", ["seconds", "eda_mean", "missing"]).collect())
    assert got == [("D_p1", 5.0, 1.5), ("D_p1", 10.0, None), ("D_p2", 5.0, None)]
    sample = {"Physio_RawData": [{"Video_Physio_RawData": [{"VideoID": "V1", "EDA_RawData": [{"TimeStamp": 1.0, "EDA": 2.0}], "ACC_RawData": [{"TimeStamp": 1.0, "ACC_X": 1, "ACC_Y": 2, "ACC_Z": 3}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(sample))
    got = {(r.video, r.signal): r.value for r in readers.json_signals(spark, f"{tmp_path}/s.json").collect()}
    assert got == {("V1", "EDA"): 2.0, ("V1", "ACC_X"): 1.0, ("V1", "ACC_Y"): 2.0, ("V1", "ACC_Z"): 3.0}
    notes = {"ContinuousAnnotation_RawData": [{"Video_Annotation_RawData": [{"VideoID": "V1", "TimeStamp_Xvalue_Yvalue": [{"TimeStamp": 1.0, "X_Value": 0.5, "Y_Value": -0.5}]}, {"VideoID": "V1", "TimeStamp_Xvalue_Yvalue": []}]}]}
    (tmp_path / "n.json").write_text(json.dumps(notes))
    assert [(r.ts, r.valence, r.arousal) for r in readers.json_annotations(spark, f"{tmp_path}/n.json").collect()] == [(1.0, 0.5, -0.5)]


def test_file_names(spark):
    names = spark.createDataFrame([(f"/d/{n}", n) for n in ("a_S1_C2_input.csv", "a_S1_C2_BORIS_method_II.csv", "a_S1_C3_input.csv", "x.csv")], "path string, name string")
    assert [r.client_id for r in readers.file_pairs(names).collect()] == ["a_S1_C2"]
    files = [("/d/extracted/FR/tsFRP1V2anger.csv",), ("/d/tsFRP1V2anger.csv",), ("/d/tsFRP1V2fearLE02.csv",), ("/d/tsExp3P1V2fear.csv",)]
    df = spark.createDataFrame(files, "path string").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    assert sorted((r.method, r.emotion, r.path) for r in readers.emotion_files(df).collect()) == [("Exp3", "fear", files[3][0]), ("FR", "anger", files[0][0])]
    assert [r.emotion for r in readers.emotion_files(df, "FR", "LE02").collect()] == ["fear"]


def test_emotion_states_and_gender(spark):
    rows = spark.createDataFrame([("f", 0, 0, 5, "low", "high", "Male"), ("f", 1, 5, 9, None, "low", "Male")], "file string, n int, StartTime int, EndTime int, EmotionRangeFear string, EmotionRangeAnger string, Gender string")
    got = [(r.position, r.state, r.start_time) for r in readers.emotion_states(rows, "file", "StartTime", "EndTime", "n").orderBy("position").collect()]
    assert got == [(0, "Fear_low", 0.0), (1, "Anger_high", 0.0), (2, "Anger_low", 5.0)]
    assert readers.of_gender(rows, "file", "n", "Male").count() == 2 and readers.of_gender(rows, "file", "n", "Female").count() == 0


RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="urn:x#" xml:base="urn:b">
<c:TimeSeries rdf:about="urn://b#ts1"><c:timeSeriesSource>http://h/a.CSV</c:timeSeriesSource><c:hasMeasure rdf:resource="urn://b#angerMeasure"/></c:TimeSeries>
<rdf:Description rdf:about="urn://b#P1State"><c:hasProperty rdf:resource="urn://b#age23"/><c:hasProperty rdf:resource="urn://b#dominantPANASx"/></rdf:Description>
<rdf:Description rdf:about="urn://b#P1State"><c:hasParticipant rdf:resource="urn://b#P1"/></rdf:Description>
<rdf:Description rdf:about="urn://b#P1"><c:hasSex rdf:resource="urn://b#Female"/></rdf:Description></rdf:RDF>"""


def test_graphs(spark, tmp_path):
    (tmp_path / "g.rdf").write_bytes(RDF)
    t = readers.rdf_xml(spark, f"{tmp_path}/g.rdf").cache()
    assert [r.link for r in graph.csv_objects(t).collect()] == ["http://h/a.CSV"]
    assert [tuple(r) for r in graph.series_summary(t).collect()] == [("ts1", "http://h/a.CSV", "anger", "unknown")]
    (c,) = graph.contexts(t).collect()
    assert (c.participant, c.age, c.panas, c.gender) == ("1", "23", "x", "Female")
    assert graph.clean_series(t, spark.createDataFrame([("other",)], "link string")).filter(F.col("s").endswith("ts1")).count() == 0
    a, b = spark.createDataFrame([("x",), ("y",)], "link string"), spark.createDataFrame([("y",), ("z",)], "link string")
    assert {r.link: r["where"] for r in graph.compare_links(a, b).collect()} == {"x": "only_first", "y": "both", "z": "only_second"}


def test_report(spark):
    text = sinks.report("T", {"minsup": 0.3}, {"Rules": spark.createDataFrame([("a", 0.5)], "rule string, confidence double")})
    assert "- minsup: 0.3" in text and "| a | 0.5000 |" in text


def test_streams(spark, tmp_path):
    rows = [("c", "v", 0.0, "low"), ("c", "v", 5.0, "low"), ("c", "v", 10.0, "high"), ("c", "v", 12.0, None), ("c", "v", 20.0, "low")]
    spark.createDataFrame(rows, "client_id string, var string, seconds double, level string").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timeouts of processing time give batches for ever
    stream = spark.readStream.schema("client_id string, var string, seconds double, level string").parquet(f"{tmp_path}/in")
    q = streams.state_runs(stream).writeStream.format("memory").queryName("runs_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        assert sorted((r.state, r.start_time, r.end_time) for r in spark.table("runs_out").collect()) == [("high", 10.0, 12.0), ("low", 0.0, 10.0)]
    finally:
        q.stop()


def test_rdf_elements_are_read_as_written():
    triples = [("urn://a#s", "urn://a#p", 'x < "y" & z'), ("urn#C1", "urn#hasNation", "urn#N2"), ("urn://a#s", "http://h/q/p", "http://h/o")]
    document = f'<rdf:RDF xmlns:rdf="{readers.RDF}">{"".join(sinks.rdf_element(*t) for t in triples)}</rdf:RDF>'
    assert readers.parse_rdf(document.encode()) == triples


def test_six_section_report(spark):
    summary = json.loads(sinks.experiment_json({"minsup": 0.3}, {"bvp_only": True}, spark.createDataFrame([("d1", 4), ("d2", 5)], "dataset string, patterns long")))
    patterns = spark.createDataFrame([("(a)", 0.4), ("(b)", 0.9)], "pattern string, avg_support double")
    rules = spark.createDataFrame([], "signature string, avg_confidence double, avg_support double")
    text = sinks.experiment_report("T", summary, patterns, rules, top=1)
    heads = [x[3:] for x in text.split("\n") if x.startswith("## ")]
    assert heads == ["Methodology", "Data sets", "Similarity", "Common patterns", "Common rules", "Conclusions"]
    assert "| minsup | 0.3 |" in text and "| d2 | 5 |" in text and "- bvp_only: on" in text and "- patterns common to all data sets: 2" in text
    assert "| (b) | 0.9000 |" in text and "(a)" not in text and "No rules are common to all data sets." in text
    empty = sinks.experiment_report("T", {}, patterns.limit(0), rules)
    assert "No patterns are common" in empty and "Of 0 data sets" in empty


def test_cached_csv_is_made_once(spark, tmp_path):
    fields = spark.createDataFrame([], "s string, n long").schema
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1, "a", 0), (2, None, 0)], "n long, s string, other int")

    for _ in range(2):
        found = readers.cached_csv(spark, f"{tmp_path}/c", fields, make)
        assert sorted(map(tuple, found.collect()), key=str) == [("a", 1), (None, 2)]
    assert calls == [1]


def test_graphs_are_written_in_bounded_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "RDF_DOCUMENT", 10)
    t = spark.range(25, numPartitions=1).selectExpr("concat('urn#a', id) AS s", "'urn#p' AS p", "concat('x < ', id, '\n&') AS o")
    sinks.rdf_xml(t, f"{tmp_path}/g")
    assert len(list((tmp_path / "g").glob("part-*"))) == 3
    assert sorted(map(tuple, readers.rdf_xml(spark, f"{tmp_path}/g").collect())) == sorted((r.s, r.p, r.o.strip()) for r in t.collect())
    sinks.rdf_xml(t.limit(0), f"{tmp_path}/none")
    assert readers.rdf_xml(spark, f"{tmp_path}/none").count() == 0


def test_graph_is_parsed_node_by_node():
    nodes = "".join(f'<rdf:Description rdf:about="urn://a#s{i}"><c:p>v{i}</c:p></rdf:Description>' for i in range(20000))
    document = f'<rdf:RDF xmlns:rdf="{readers.RDF}" xmlns:c="urn:x#">{nodes}</rdf:RDF>'.encode()
    tracemalloc.start()
    assert sum(1 for _ in readers.rdf_triples(document)) == 20000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_nested_signals_are_one_scan_of_few_files(spark, tmp_path):
    rows = [{"VideoID": "v", "EDA_RawData": [{"TimeStamp": 1.0, "EDA": 2.0}, {"TimeStamp": 2.0}], "ACC_RawData": [{"TimeStamp": 3.0, "ACC_X": 4.0, "ACC_Y": 5.0, "ACC_Z": 6.0}]}, {"VideoID": "w"}]
    (tmp_path / "a.json").write_text(json.dumps({"Physio_RawData": [{"Video_Physio_RawData": rows}]}))
    found = readers.json_signals(spark, f"{tmp_path}/a.json")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan json") == 1
    got = sorted((r.video, r.signal, r.ts, r.value) for r in found.collect() if r.value is not None)
    assert got == [("v", "ACC_X", 3.0, 4.0), ("v", "ACC_Y", 3.0, 5.0), ("v", "ACC_Z", 3.0, 6.0), ("v", "EDA", 1.0, 2.0)]
    assert found.count() == 5


def test_nested_files_hold_several_users(spark, tmp_path):
    ts = F.timestamp_seconds(F.col("id"))
    spark.range(130).select(F.col("id").alias("event_id"), ts.alias("ts"), F.col("id").alias("user_id"), F.when(F.col("id") > 0, "a:b").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    path = exchange._nested(spark, str(tmp_path), F.struct(F.col("seconds").alias("TimeStamp"), F.col("value").alias("EDA")), "EDA_RawData", "Video_Physio_RawData", "Physio_RawData", "n.json")
    assert readers.file_names(spark, f"{path}/*.json").count() == 3
    for name in ("json_signals", "json_annotations"):
        got = sorted((str(r.video), r.ts) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted([("None", 0.0), *(("a:b", float(i)) for i in range(1, 130))])
