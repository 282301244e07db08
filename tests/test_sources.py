"""Files of each format, written here and read back."""

import io
import json
import zipfile

import pytest

from viewspan.operators import factors as V
from viewspan.plans import queries as Q
from viewspan.sources import delimited as D
from viewspan.sources import sinks
from viewspan.sources.files import read_any, read_studies
from viewspan.sources.kenq import deck_from_multipliers
from viewspan.sources.xlsx import read_workbook, write_workbook

ROWS = [[1, -1, 0, 2, -2, 0], [0, 1, -1, 0, 1, -1], [-1, 0, 1, -2, 2, 0]]
NAMES = ["KAE-001", "KAE-002", "KAE-003"]


def values(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["participant"], {})[r["stmt_num"]] = r["value"]
    return {p: [v[k] for k in sorted(v)] for p, v in out.items()}


WANT = {n: [float(v) for v in r] for n, r in zip(NAMES, ROWS)}


def test_wide_long_transposed(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("﻿participant,note,s1,s2,s3,s4,s5,s6\n" + "\n".join(f"{n},x,{','.join(map(str, r))}" for n, r in zip(NAMES, ROWS)))
    (tmp_path / "long.csv").write_text("participant,statement,value\n" + "\n".join(f"{n},{j},{v}" for n, r in zip(NAMES, ROWS) for j, v in enumerate(r, 1)))
    (tmp_path / "across.csv").write_text("statement,qsort1,qsort2,qsort3\n" + "\n".join(f"text {j},{','.join(str(r[j - 1]) for r in ROWS)}" for j in range(1, 7)))
    (tmp_path / "htmlq.csv").write_text("uid,datetime,s1,s2,s3,s4,s5,s6\n" + "\n".join(f"{n},2024-01-01,{','.join(map(str, r))}" for n, r in zip(NAMES, ROWS)))
    for name in ("wide", "long", "htmlq"):
        assert values(read_any(spark, str(tmp_path / f"{name}.csv"))) == WANT, name
    assert list(values(read_any(spark, str(tmp_path / "across.csv"))).values()) == list(WANT.values())
    assert [D.layout(c) for c in (["id", "time", "s1"], ["statement", "qsort1", "qsort2"], ["a", "b"])] == ["flashq", "transposed", "wide"]


def test_lines_before_the_header_and_cells_that_are_no_numbers(spark, tmp_path):
    from pyspark.sql import Observation

    file = tmp_path / "skipped.csv"
    file.write_text("\ufeffA study, of 2024\n\nuid,datetime,\"note, long\",s1,s2,s3\n" + "\n".join(f'{n},2024,"a, b",{"x" if k == 1 else 1}, NA,{k}' for k, n in enumerate(NAMES)) + "\n\n")
    lost = Observation()
    got = values(D.read_sorts(spark, str(file), skip=2, lost=lost))
    assert got == {NAMES[0]: [1, None, 0], NAMES[1]: [None, None, 1], NAMES[2]: [1, None, 2]}
    assert lost.get == {"filled": 6, "lost": 1, "lost in s1": 1, "lost in s2": 0, "lost in s3": 0}
    with pytest.raises(ValueError):
        D.read_sorts(spark, str(file), skip=40)


def test_lost_cells_of_a_split_file(spark, tmp_path):
    from pyspark.sql import Observation

    file = tmp_path / "long.csv"
    file.write_text("participant,statement,value\n" + "\n".join(f"P{i},{j},{'?' if (i * 7 + j) % 50 == 0 else j % 3}" for i in range(400) for j in range(1, 11)))
    want = sum((i * 7 + j) % 50 == 0 for i in range(400) for j in range(1, 11))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lost = Observation("cells")
        out = D.read_sorts(spark, str(file), lost=lost)
        assert len([r for r in out.collect() if r["value"] is None]) == want > 0
        assert lost.get == {"filled": 4000, "lost": want, "lost in value": want}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_and_repeated_ids(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,a,b,c\nA,1,NA,0\nA,.,2,1\nB,1,1,-1\n")
    assert values(D.read_sorts(spark, str(tmp_path / "w.csv"))) == {"A": [1, None, 0], "A_1": [None, 2, 1], "B": [1, 1, -1]}


def test_pqmethod(spark, tmp_path):
    (tmp_path / "a.dat").write_text("3 6 title\n-2 2 1 1 2 1 1\n" + "\n".join(f"{n:<10}" + "".join(f"{v:2d}" for v in r) for n, r in zip(NAMES, ROWS)) + "\n")
    assert values(read_studies(spark, str(tmp_path / "a.dat"))) == WANT


def test_json(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"qSorts": ROWS, "participantNames": NAMES, "statements": list("abcdef")}))
    (tmp_path / "f.json").write_text(json.dumps({f"key{i}": {"name": n, "sort": "|".join(f"+{v}" if v > 0 else str(v) for v in r)} for i, (n, r) in enumerate(zip(NAMES, ROWS))}))
    df = read_studies(spark, str(tmp_path))
    for study in "kf":
        assert values(df.where(f"study_id = '{study}'")) == WANT
    assert {r["statement"] for r in df.where("study_id = 'k'").collect()} == set("abcdef")


def test_kade_and_workbooks(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("sorts.csv", "\n".join(f"{n};{';'.join(map(str, r))}" for n, r in zip(NAMES, ROWS)))
        z.writestr("statements.txt", "\n".join(f"st {k}" for k in range(6)))
    (tmp_path / "kade.zip").write_bytes(b.getvalue())
    assert values(read_studies(spark, str(tmp_path / "kade.zip"))) == WANT
    order = [3, 1, 2, 6, 4, 5]
    sheets = {"Data": [["Statement Num.", *NAMES], *[[j, *[r[j - 1] for r in ROWS]] for j in range(1, 7)]], "Statements": [["id", "text"], *[[k, f"statement number {k}"] for k in order]]}
    (tmp_path / "t.xlsx").write_bytes(write_workbook(sheets))
    df = read_studies(spark, str(tmp_path / "t.xlsx"))
    assert values(df) == WANT
    assert [r["statement"] for r in df.where("p_idx = 1").orderBy("stmt_num").collect()] == [f"statement number {k}" for k in range(1, 7)]
    assert read_workbook(write_workbook({"a": [["x & <y>", 1.5, None, 2]]}))["a"][0] == ["x & <y>", 1.5, None, 2.0]


def test_statements_attributes_and_errors(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1. First one\n\n2) Second\n third ")
    assert [r["statement"] for r in D.read_statements(spark, str(tmp_path / "s.txt")).orderBy("stmt_num").collect()] == ["First one", "Second", "third"]
    (tmp_path / "at.csv").write_text("Record ID,age\nKK01,18-30\nKK02,NA\n")
    assert {(r["row"], r["attribute"], r["raw"]) for r in D.read_attributes(spark, str(tmp_path / "at.csv")).collect()} == {(1, "Record ID", "KK01"), (1, "age", "18-30"), (2, "Record ID", "KK02"), (2, "age", None)}
    (tmp_path / "x.sta").write_text("a")
    with pytest.raises(Exception, match="statements"):
        read_studies(spark, str(tmp_path / "x.sta")).collect()
    assert deck_from_multipliers([0, 0, 1, 2, 0, 3, 0]) == [1, 2, 0, 3]


def test_sinks(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    tables = sinks.factor_tables(Q.sorts(spark, d), Q.flags(spark, d), Q.DECK)
    sinks.save_session(tables, str(tmp_path / "session"), k=3)
    back, settings = sinks.load_session(spark, str(tmp_path / "session"))
    assert settings == {"k": 3} and list(back) == list(tables) and back["Q sorts"].count() == 250
    sheets = read_workbook(sinks.workbook({k: back[k] for k in ("Factor characteristics", "Distinguishing")}))
    assert sheets["Factor characteristics"][0][:3] == ["study_id", "factor", "n_flagged"] and len(sheets["Factor characteristics"]) == 4
    with pytest.raises(ValueError):
        sinks.workbook({"Q sorts": back["Q sorts"]}, most_rows=10)
    assert V.factor_array(V.factor_scores(Q.sorts(spark, d), Q.flags(spark, d), Q.DECK)).count() > 0


def test_workbooks_of_priorities_and_posteriors(spark):
    from viewspan.operators import bayes as B
    from viewspan.operators import priorities as R

    d = "/root/testdata/sf0.001"
    s = Q.sorts(spark, d).cache()
    ranked = R.ranked_table(s, Q.DECK)
    tables = sinks.priorities_tables(ranked, top=R.top_n(s, Q.groups(spark, d)), figures={"ranking": ranked.select("stmt_num", "mean")})
    assert list(tables) == ["Ranked", "Top by group", "Figure ranking"]
    assert len(read_workbook(sinks.workbook(tables))["Ranked"]) == 26
    draws = B.draws(s, [2], iterations=120, burn=40, thin=4).cache()
    own = sinks.bayesian_tables(draws, 2, s, Q.DECK)
    assert len(own) == 11 and len(sinks.bayesian_tables(draws, 2, s, Q.DECK, ladder=B.ladder(draws))) == 12
    assert own["Loadings & Flags"].count() == 20 and own["Person Check"].count() == 10 and own["Overview"].count() == 1


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from viewspan.streaming.ingest import sort_stream, statement_sums, upsert_sorts

    src = str(tmp_path / "in")
    s = Q.sorts(spark, "/root/testdata/sf0.001").where("p_idx <= 3").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    s.union(s.where("p_idx = 1")).coalesce(1).write.parquet(src)
    q = statement_sums(sort_stream(spark, src)).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = {r["stmt_num"]: (r["n"], r["mean"]) for r in spark.table("sums").collect()}
    want = {r["stmt_num"]: (r["n"], r["mean"]) for r in s.groupBy("stmt_num").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).collect()}
    assert got == want
    w = upsert_sorts(sort_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    w.processAllAvailable()
    w.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(src).count()
