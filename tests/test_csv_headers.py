"""Files of one scan whose headers differ."""

import os

from chronosift.sources import readers


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + ("\n" if lines else ""))


def test_columns_in_different_orders_are_not_swapped(spark, tmp_path):
    write(f"{tmp_path}/a/p1/x.csv", "timestamp,value", "1,10", "2,20")
    write(f"{tmp_path}/a/p2/x.csv", "value,other,timestamp", "30,z,3")
    got = sorted(map(tuple, readers.signal_csv(spark, f"{tmp_path}/a/*").collect()))
    assert got == [("p1", 1.0, 10.0), ("p1", 2.0, 20.0), ("p2", 3.0, 30.0)]
    write(f"{tmp_path}/b/1.csv", "client_id,state,start_time,end_time", "c1,x,1,2")
    write(f"{tmp_path}/b/2.csv", "State,EndTime,ClientID,StartTime", "y,4,c2,3")
    assert sorted(map(tuple, readers.intervals_csv(spark, f"{tmp_path}/b").collect())) == [("c1", "x", 1.0, 2.0), ("c2", "y", 3.0, 4.0)]
    write(f"{tmp_path}/c/1.csv", "seconds,arousal,valence", "1,2,3")
    write(f"{tmp_path}/c/2.csv", "valence,arousal,seconds", "6,5,4")
    assert sorted(map(tuple, readers.annotations_csv(spark, f"{tmp_path}/c").collect())) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_missing_columns_are_null_and_unreadable_files_listed(spark, tmp_path):
    write(f"{tmp_path}/P1_merged.csv", "seconds,eda_mean,gender", "5,0.5,F")
    write(f"{tmp_path}/P2_merged.csv", "gender,seconds", "M,6")
    write(f"{tmp_path}/P3_merged.csv", "eda_mean,seconds", '"0.7",nan')
    write(f"{tmp_path}/P4_merged.csv", "")
    with open(f"{tmp_path}/P5_merged.csv.gz", "wb") as f:
        f.write(b"not compressed at all")
    got = sorted(((r.client_id, r.seconds, r.eda_mean, r.gender) for r in readers.feature_files(spark, f"{tmp_path}/*_merged.csv*", "D", ["seconds", "eda_mean", "gender"]).collect()))
    assert got == [("D_P1", 5.0, 0.5, "F"), ("D_P2", 6.0, None, "M"), ("D_P3", None, 0.7, None)]
    rows, skipped = readers.csv_by_header(spark, f"{tmp_path}/*", ["seconds", "eda_mean"], required=["eda_mean"])
    assert rows.count() == 2
    assert [(os.path.basename(r.path), r.reason) for r in skipped.collect()] == [("P2_merged.csv", "lacks eda_mean"), ("P4_merged.csv", "no header could be read"), ("P5_merged.csv.gz", "no header could be read")]


def test_names_that_look_like_patterns(spark, tmp_path):
    write(f"{tmp_path}/a [1]{{x}}.csv", "k,v", "1,2")
    write(f"{tmp_path}/b c.csv", "v,k,k", "4,3,9")
    assert sorted(map(tuple, readers.csv_columns(spark, str(tmp_path), ["k", "v", "none"]).collect())) == [("1", "2", None), ("3", "4", None)]
