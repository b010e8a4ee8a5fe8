import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from earshot.operators import abr, sessions
from earshot.sources import readers

DAY = dt.date(2022, 4, 20)
FILE = "4-32kHz_MIXdB_50ms_4s"
GOOD = f"./data/20220420/export/Orange5_Orange5_{FILE}_20220420-130546_BOX#001_raw_data.csv"


def test_path_checks(spark):
    paths = [GOOD, GOOD.replace("/data/20220420", "/data/20220421"), GOOD.replace("export/Orange5", "export/Green5"),
             GOOD.replace("/data/20220420", "/data/20220421").replace("export/Orange5", "export/Green5"), None,
             GOOD.replace("/export/", "/export//")]
    df = spark.createDataFrame([(i, DAY, "Orange 5", p) for i, p in enumerate(paths)], "i int, Date date, ID string, path string")
    got = sessions.check_names(df, "path").orderBy("i").collect()
    assert [r.File_Match for r in got] == ["Good", "ISSUE", "ISSUE", None, None, "Good"]
    assert [r.both_bad for r in got] == [False, False, False, True, False, False]
    assert got[0].ActualFile == f"Orange5_{FILE}" and got[0].ID2 == "Orange 5" and got[0].Date2 == DAY


LOG = "Date date, File string, Trials string, Hit string, FA string, Thresholds string, Phase string, ID string"


def log(spark, *rows):
    return spark.createDataFrame([(DAY, f, "100", "x", "5", t, p, i) for f, t, p, i in rows], LOG)


def test_prepare(spark):
    df = sessions.prepare(log(
        spark, (FILE, "12, 15.5, 20, 22", "BBN, post-HL", "Green 1"), ("Did not run", None, "BBN", "Green 1"),
        (None, None, "BBN", "Green 1"), (FILE, None, None, "Green 1"), (FILE, None, "Post ABR", "Green 1"),
        ("BBN_30-90dB_50ms_4s", "25", "BBN", "Orange 1")))
    got = {r.ID: r for r in df.collect()}
    assert set(got) == {"Green 1", "Orange 1"} and df.count() == 2
    g, o = got["Green 1"], got["Orange 1"]
    assert (g.Condition, g.Sex, g.Trials, g.Hit, g["8_TH"], g.BBN_TH) == ("Post HHL", "Male", 100.0, None, 16.0, None)
    assert (o.Condition, o.Sex, o.BBN_TH, o["4_TH"]) == ("Baseline", "Female", 25.0, None)


def test_files(spark):
    df = sessions.prepare(log(spark, (FILE, "25", "BBN", "Orange 5"), (FILE, "25", "BBN", "Orange 6")))
    other = GOOD.replace("MIXdB", "60dB")
    listing = spark.createDataFrame([(GOOD,), (other,)], "path string")
    expected = {(r.ID, r.FileName_expected) for r in sessions.expected_files(df, listing).collect()}
    assert expected == {("Orange 5", GOOD), ("Orange 6", None)}
    matched = sessions.match_files(df, listing)
    assert {(r.ID, r.FileName_complete) for r in matched.collect()} == {("Orange 5", GOOD), ("Orange 5", other), ("Orange 6", None)}
    assert [r.ID for r in sessions.missing_files(df, listing).collect()] == ["Orange 6"]
    assert sessions.missing_files(df, listing, before=DAY).count() == 0
    assert sessions.file_report(matched).count() == 2


def test_subjects(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "ID string")
    assert {r.ID for r in sessions.drop_subjects(df, ["a"]).collect()} == {"b", None}
    assert {r.ID for r in sessions.drop_subjects(df, df.where("ID = 'a'")).collect()} == {"b", None}
    assert {r.ID for r in sessions.keep_subjects(df, ["a"]).collect()} == {"a"}


def test_counts(spark):
    df = log(spark, (FILE, "25", "BBN", "Orange 5"), (FILE, "25", "BBN", "Orange 6"))
    trials = spark.createDataFrame([(DAY, "Orange 5")] * 99 + [(DAY, "Orange 6")] * 100, "Date date, ID string")
    got = sessions.count_mismatches(sessions.numeric_counts(df), trials).collect()
    assert [(r.ID, r.Trials, r.n) for r in got] == [("Orange 5", 100.0, 99)]


def test_abr_labels(spark):
    sheet = lambda rows: spark.createDataFrame(rows, "ID string, Condition string, Freq string, Inten double, RMS double, W1 double")
    rows = abr.combine(sheet([("a", "4 week", "0", 80.0, 1.0, 1.0)]), sheet([("b", "4-5 week", "48", 80.0, 1.0, None), ("b", "5 week", "8", 80.0, 1.0, None), ("b", "5 week", "8", 80.0, 3.0, 1.0)]))
    assert {(r.ID, r.Condition, r.Freq) for r in rows.collect()} == {("a", "4-5 week", "BBN"), ("b", "4-5 week", "8")}
    cell = abr.cell_means(rows).where("ID = 'b'").first()
    assert (cell.RMS, cell.W1) == (2.0, None)


HEADER = ["Trial", "Stim Source", "Type", "Freq (kHz)", "Inten (dB)", "Dur (ms)", "Response", "R Time (ms)", "Time (s)", "extra 1", "extra 2"]


def test_trial_files(spark, tmp_path):
    folder = tmp_path / "data" / "20220420" / "export"
    folder.mkdir(parents=True)
    name = GOOD.rsplit("/", 1)[1]
    lines = [",".join(HEADER)] + [f"{i},tone,1,4,{10 * i},50,Hit,{200 + i}.5,{i}.0,x,y" for i in range(5)]
    (folder / name).write_text("\n".join(lines) + "\n")
    listing = readers.list_files(spark, str(tmp_path / "data"))
    assert listing.count() == 1
    df = sessions.prepare(log(spark, (FILE, "25", "BBN", "Orange 5")))
    files = sessions.match_files(df, listing)
    got = readers.read_trials(spark, files, str(folder), HEADER).orderBy("row").collect()
    assert [(r.ID, r.Stim, r.Type, r.Inten, r.RTime, r.Time, r.File_Match) for r in got] == [
        ("Orange 5", "tone", 1, 10.0 * i, 200.5 + i, f"{i}.0", "Good") for i in range(5)]


def test_order_of_trials_over_two_runs_of_a_day(spark, tmp_path):
    folder = tmp_path / "data" / "20220420" / "export"
    folder.mkdir(parents=True)
    name = GOOD.rsplit("/", 1)[1]
    morning, evening = (re.sub(r"-\d{6}_", f"-{t}_", name) for t in ("080000", "140000"))
    for run, n in ((morning, 3), (evening, 12)):  # the longer file comes second
        lines = [",".join(HEADER)] + [f"{i},tone,1,4,{i},50,Hit,200.5,{i}.0,x,y" for i in range(n)]
        (folder / run).write_text("\n".join(lines) + "\n")
    got = readers.read_trials(spark, None, str(folder), HEADER).orderBy("path", "block", "row").collect()
    assert [r.Inten for r in got] == [float(i) for i in [*range(3), *range(12)]]
    assert [r.path.rsplit("/", 1)[1].count("-080000_") for r in got] == [1] * 3 + [0] * 12


def test_two_sessions_of_a_day_keep_their_own_files(spark, tmp_path):
    folder = tmp_path / "data" / "20220420" / "export"
    folder.mkdir(parents=True)
    quiet, pink = FILE, "BBN_30-90dB_50ms_BG_PNK_50dB_4s"
    for run in (quiet, pink):
        lines = [",".join(HEADER)] + [f"{i},tone,1,4,{i},50,Hit,200.5,{i}.0,x,y" for i in range(8)]
        (folder / f"Orange5_Orange5_{run}_20220420-130546_BOX#001_raw_data.csv").write_text("\n".join(lines) + "\n")
    df = sessions.prepare(log(spark, (quiet, "25", "BBN", "Orange 5"), (pink, "25", "BBN", "Orange 5")))
    files = sessions.match_files(df, readers.list_files(spark, str(tmp_path / "data")))
    own = readers.read_trials(spark, files, str(folder), HEADER).groupBy("path", "BG_Type").count().collect()
    assert sorted((r.BG_Type, "PNK" in r.path, r["count"]) for r in own) == [("NA", False, 8), ("PNK", True, 8)]
    assert readers.read_trials(spark, files, str(folder), HEADER, match="subject_day").count() == 32


def test_logs_sheets_and_results(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    cells = ["" for _ in range(24)]
    cells[0], cells[1], cells[5], cells[20], cells[23] = "2022-04-20", FILE, "120", '"12, 15, 20, 22"', "BBN"
    for subject in ("Green 1", "Orange 5"):
        (folder / f"{subject}.csv").write_text(",".join(f"h{i}" for i in range(24)) + "\n" + ",".join(cells) + "\n")
    log_rows = readers.read_logs(spark, str(folder))
    assert {(r.ID, r.Date, r.Trials, r.Thresholds, r.Phase) for r in log_rows.collect()} == {
        (s, DAY, 120.0, "12, 15, 20, 22", "BBN") for s in ("Green 1", "Orange 5")}
    with_type = readers.with_genotype(log_rows, spark.createDataFrame([("Green 1", "WT")], "ID string, Genotype string"))
    assert {(r.ID, r.Genotype) for r in with_type.collect()} == {("Green 1", "WT"), ("Orange 5", None)}
    (tmp_path / "sheet.csv").write_text("ID,RMS,BG\na,NA,NA\nb,2.5,PNK\n")
    sheet = readers.read_sheet(spark, str(tmp_path / "sheet.csv"), "ID string, RMS double, BG string")
    assert [(r.RMS, r.BG) for r in sheet.orderBy("ID").collect()] == [(None, None), (2.5, "PNK")]
    readers.write_report(sheet, str(tmp_path / "report"), "csv")
    readers.write_report(sheet, str(tmp_path / "report"), "csv")
    readers.save_tables({"one": sheet, "two": log_rows}, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results" / "two")).count() == 2
    readers.write_trials(log_rows, str(tmp_path / "trials"))
    pruned = spark.read.parquet(str(tmp_path / "trials")).where(F.col("Date") == DAY)
    assert "PartitionFilters: [isnotnull(Date" in pruned._jdf.queryExecution().toString()
    assert readers.select_positions(sheet, [1, 0], ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError):
        readers.select_positions(sheet, [1, 0], ["x"])
