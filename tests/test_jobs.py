"""The jobs: runs over growing input, repeated and broken runs, odd rows, the command line, and their SQL."""

import json
import os
import subprocess
import sys
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from crucible.functions.tables import join_facts
from crucible.operators.evidence import direction_evidence, direction_variants
from crucible.operators.records import resolve_duplicates
from jobs import evidence_upkeep, text_catalogue
from jobs import queries as Q

FOLDER = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
MEMBERS = "c_custkey long, c_name string"
CONFIG = json.loads(evidence_upkeep.CONFIG.read_text())


def events(spark, path, first, n, users=40):
    kinds = ["click", "view", "purchase", "signup", "error", None]
    rows = [(i, datetime(2024, 1, 1), None if i % 31 == 0 else i * 7 % users, kinds[i % 6], 1.0, None if i % 17 == 0 else json.dumps({"k": i % 5})) for i in range(first, first + n)]
    spark.createDataFrame(rows + rows[:5], EVENTS).coalesce(1).write.mode("append").parquet(path)


def members(spark, path, n):
    spark.createDataFrame([(i, "x") for i in range(n)] + [(None, "y"), (0, "again")], MEMBERS).write.mode("overwrite").parquet(path)


def batch_plan(spark, at):
    """The same table from one plan over everything."""
    e = spark.read.parquet(f"{at}/events").withColumn("_db", F.coalesce(F.expr(CONFIG["database"]), F.lit("unknown")))
    m = spark.read.parquet(f"{at}/members").select((F.col("c_custkey") - F.col("c_custkey") % 3).alias("canonical_id"), F.col("c_custkey").alias("user_id")).dropna().distinct()
    return sorted(map(tuple, direction_variants(m, direction_evidence(e, "user_id", "event_type", "event_id", database="_db", codes=CONFIG["codes"]), "user_id").collect()))


def upkeep(spark, at, **config):
    said = evidence_upkeep.run(spark, f"{at}/events", f"{at}/members", f"{at}/out", f"{at}/mark", {"parts": 8} | config)
    return said, sorted(map(tuple, spark.read.parquet(f"{at}/out/variants").drop("part", "through").collect()))


def test_evidence_keeps_up_with_growing_input(spark, tmp_path):
    at = f"file://{tmp_path}"
    events(spark, f"{at}/events", 0, 200)
    members(spark, f"{at}/members", 36)
    said, rows = upkeep(spark, at)
    used = spark.read.parquet(f"{at}/out/variants").select("part").distinct().count()
    assert (said["events_read"], said["parts_written"]) == (205, used) and rows == batch_plan(spark, at)
    said, again = upkeep(spark, at)
    assert (said["events_read"], said["batches"], said["parts_written"]) == (0, 0, 0) and again == rows
    events(spark, f"{at}/events", 150, 300)  # 50 of them known already
    members(spark, f"{at}/members", 45)  # users 36 to 39 have waiting evidence
    said, rows = upkeep(spark, at, files_per_batch=1)
    assert said["events_read"] == 305 and rows == batch_plan(spark, at)
    events(spark, f"{at}/events", 7 * 1000, 1, users=1)
    said, rows = upkeep(spark, at)
    assert said["parts_written"] <= 2 and rows == batch_plan(spark, at)


def test_evidence_heals_a_broken_run(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}"
    events(spark, f"{at}/events", 0, 100)
    members(spark, f"{at}/members", 40)
    upkeep(spark, at)
    events(spark, f"{at}/events", 100, 100)
    with monkeypatch.context() as m:
        m.setattr(evidence_upkeep, "direction_variants", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upkeep(spark, at)
    said, rows = upkeep(spark, at)
    assert said["events_read"] == 0 and said["parts_written"] > 0 and rows == batch_plan(spark, at)
    # A batch that runs again, as after a failure before its commit, changes nothing.
    last = max(int(f) for f in os.listdir(tmp_path / "mark" / "commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if (tmp_path / "mark" / "commits" / f).exists():
            (tmp_path / "mark" / "commits" / f).unlink()
    said, again = upkeep(spark, at)
    assert said["events_read"] == 105 and again == rows


def test_evidence_refuses_moved_members(spark, tmp_path):
    at = f"file://{tmp_path}"
    events(spark, f"{at}/events", 0, 20)
    members(spark, f"{at}/members", 9)
    upkeep(spark, at)
    with pytest.raises(ValueError, match="moved"):
        upkeep(spark, at, member_record="c_custkey - c_custkey % 2")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def catalogue(spark, at, docs, labels):
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(f"{at}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{at}/labels")
    said, rows = text_catalogue.run(spark, f"{at}/documents", f"{at}/labels", f"{at}/out")
    return said, {r.doc_id: r for r in rows.collect()}


def test_catalogue_of_odd_rows_and_reruns(spark, tmp_path):
    at = f"file://{tmp_path}"
    docs = [(1, "same", "en", "a", 4), (2, "same", "en", "b/c", 4), (3, None, "en", None, 0), (4, "", "en", "", 0), (5, "two langs", "en", "a", 9), (6, "two langs", "de", "a", 9), (7, "long " * 50_000, "en", "a", 1)]
    docs += [(100 + i, "hot", "fr", "hot", 3) for i in range(300)]
    said, got = catalogue(spark, at, docs, [(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1), (99, 1, 1)])
    assert said == {"documents_read": 307, "labels_read": 3, "catalogue": 307, "texts": 6, "groups": 4}
    assert [(got[i].canonical_id, got[i].dedup_status) for i in (1, 2, 3, 4, 5, 6, 399)] == [
        (1, "kept"), (1, "merged_strict_exact"), (3, "kept"), (3, "merged_strict_exact"), (5, "kept_conflict"), (6, "kept_conflict"), (100, "merged_strict_exact")]
    assert (got[1].quality, got[1].toxic, got[2].quality, got[5].toxic) == (1, 1, 0, None) and (got[3].source, got[4].source, got[2].source) == (None, "", "b/c")
    texts = spark.read.parquet(f"{at}/out/texts")
    assert {r.doc_id for r in texts.collect()} == {1, 3, 5, 6, 7, 100} and texts.filter("doc_id = 7").first().text == "long " * 50_000
    groups = {r.first_id: r for r in spark.read.parquet(f"{at}/out/groups").collect()}
    assert groups[1].same_status and not groups[1].same_source and not groups[1].same_quality and not groups[5].same_status and groups[100].group_size == 300
    again, same = catalogue(spark, at, docs, [(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1), (99, 1, 1)])
    assert again == said and same == got
    assert catalogue(spark, at, [], [])[0]["catalogue"] == 0


def test_large_groups_are_dealt_out(spark):
    """A key with half of all rows goes to many parts without adaptive execution."""
    rows = spark.range(4000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 200 == 1, None).otherwise(F.col("id").cast("string")).alias("k"), F.lit("s").alias("status"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("false", "32", "-1"), strict=True):
            spark.conf.set(k, v)
        out = join_facts(rows, facts, "k", "n", F.col("record_id"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 500
        done = resolve_duplicates(rows, key="k", number=F.col("record_id"))
        assert {(r.canonical_id, r["count"]) for r in done.groupBy("canonical_id").count().filter("count > 1").collect()} == {(0, 2000), (1, 20)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_command_line(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS).write.parquet(f"{at}/documents")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels")
    done = subprocess.run([sys.executable, "-m", "jobs.text_catalogue", "--documents", f"{at}/documents", "--labels", f"{at}/labels", "--out", f"{at}/out"], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(__file__)), env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[1] --conf spark.sql.shuffle.partitions=1 --conf spark.ui.enabled=false pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1 documents" in done.stderr and spark.read.parquet(f"{at}/out/catalogue/origin=s").count() == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    cursor = con.execute(Q.SQL[name])
    names = [d[0] for d in cursor.description]
    df = Q.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, cursor.fetchall()))
