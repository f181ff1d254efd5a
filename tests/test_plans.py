import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.operators import validate as V
from crucible.plans import analyse as A
from crucible.plans import prepare as P
from crucible.sources import readers, sinks
from crucible.streaming.evidence import evidence_counts, evidence_stream


def molblock(name, atoms, bonds):
    out = [name, "", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    out += [f"    0.0000    0.0000    0.0000 {a:<3} 0  0" for a in atoms]
    out += [f"{a:3d}{b:3d}{o:3d}  0" for a, b, o in bonds]
    return [*out, "M  END"]


ETHANOL, WATER, ETHANAL = ("CHEBI:1", ["C", "C", "O"], [(1, 2, 1), (2, 3, 1)]), ("CHEBI:15377", ["O"], []), ("CHEBI:2", ["C", "C", "O"], [(1, 2, 1), (2, 3, 2)])


def rxn(left, right):
    lines = ["$RXN", "", "", "RHEA:release=141", f"{len(left):3d}{len(right):3d}"]
    for m in [*left, *right]:
        lines += ["$MOL", *molblock(*m)]
    return "\n".join(lines) + "\n"


def archive(path, files):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in files.items():
            raw = text if isinstance(text, bytes) else text.encode()
            info = tarfile.TarInfo("folder/" + name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))


def make(tmp_path):
    tsv = lambda rows: "\n".join("\t".join(r) for r in rows) + "\n"
    archive(tmp_path / "tables.tar.gz", {
        "rhea-directions.tsv": tsv([P.DIRECTION_COLUMNS, ["20", "21", "22", "23"], ["3", "4", "5", "6"], ["40", "41", "42", "43"], ["50", "51", "52", "53"], ["60", "61", "62", "63"]]),
        "rhea2ec.tsv": tsv([["RHEA_ID", "DIRECTION", "MASTER_ID", "ID"], ["21", "LR", "20", "1.1.1.1"], ["21", "LR", "20", "1.1.1.1"]]),
        "rhea2xrefs.tsv": tsv([["RHEA_ID", "DIRECTION", "MASTER_ID", "ID", "DB"], ["21", "LR", "20", "x1", "db"], ["4", "LR", "3", "x1", "db"], ["4", "RL", "3", "x2", "db"], ["41", "??", "40", "x3", "db"]]),
        "rhea2uniprot_sprot.tsv": tsv([["RHEA_ID", "DIRECTION", "MASTER_ID", "ID"], ["21", "LR", "20", "P1"]]),
        "rhea-reaction-smiles.tsv": tsv([["21", "OLD>>OLD"], ["21", "OCC>>CC=O"], ["4", "OCC>>CC=O"], ["41", "OCC.O>>CC=O"]]),
    })
    archive(tmp_path / "rxn.tar.gz", {
        "21.rxn": rxn([ETHANOL], [ETHANAL]), "4.rxn": rxn([ETHANOL, ETHANOL], [ETHANAL, ETHANAL]), "41.rxn": rxn([ETHANOL, WATER], [ETHANAL]),
        "51.rxn": "no header RHEA:release=141", "4.txt": "other",
    })
    return P.Config(str(tmp_path / "tables.tar.gz"), str(tmp_path / "rxn.tar.gz"), "141", ["CHEBI:15377"])


def test_prepare_end_to_end(spark, tmp_path):
    corpus = P.prepare(spark, make(tmp_path))
    kept = {r.record_id: r for r in corpus.records.collect()}
    assert set(kept) == {"RHEA:3", "RHEA:40"}
    three = kept["RHEA:3"]
    assert three.equivalent_ids == ["RHEA:3", "RHEA:20"] and three.labels == ["1.1.1.1"]
    assert [p.coefficient for p in three.participants] == [-2.0, 2.0]  # the winner keeps its own scale
    assert three.xrefs == {"db": ["x1", "x2"]} and three.supported_directions == ["left_to_right", "right_to_left"]
    status = {r.source_id: (r.canonical_id, r.status) for r in corpus.id_map.collect()}
    assert status["RHEA:20"] == ("RHEA:3", "merged_strict_exact") and status["RHEA:60"] == (None, "excluded_missing_rxn")
    failures = {r.record_id: r.stage for r in corpus.failures.collect()}
    assert failures == {"RHEA:50": "rxn_parse", "RHEA:60": "rxn_lookup"}
    parse = {r.record_id: r.parse_status for r in corpus.source_records.collect()}
    assert parse == {"RHEA:3": "parsed", "RHEA:20": "parsed", "RHEA:40": "parsed", "RHEA:50": "rxn_parse", "RHEA:60": "rxn_lookup"}
    v = {(r.canonical_id, r.direction): r for r in corpus.variants.collect()}
    assert v["RHEA:3", "left_to_right"].evidence_count == 2 and v["RHEA:3", "left_to_right"].directional_ids == ["RHEA:21", "RHEA:4"]
    assert not v["RHEA:40", "left_to_right"].has_evidence and len(v) == 6
    assert [(r.record_ids, r.candidate_count) for r in corpus.loose.collect()] == [(["RHEA:3", "RHEA:40"], 2)]  # water is ignored
    states = {r.record_id: r.status for r in corpus.balance.collect()}
    assert set(states.values()) == {"imbalanced"}
    V.require(P.constraints(corpus))
    report = P.quality_report(corpus)
    assert report["dedup"]["retained_count"] == 2 and report["failures"] == 2
    manifest = P.write(corpus, str(tmp_path / "out"))
    back = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in corpus.tables()}
    assert sinks.verify_manifest(back, manifest) == []
    assert sinks.verify_manifest({"failures": back["failures"].limit(1)}, manifest) == ["failures"]


def test_wrong_release_is_refused(spark, tmp_path):
    config = make(tmp_path)
    config.release = "140"
    try:
        P.prepare(spark, config)
    except ValueError as e:
        assert "one_release" in str(e)
    else:
        raise AssertionError


def test_readers(spark, tmp_path):
    archive(tmp_path / "a.tar.gz", {"x.tsv": 'a\tb\n1\t"q""t"\n2\t\n', "bad.bin": b"\xff\xfeok"})
    got = readers.tsv_from_tar(spark, str(tmp_path / "a.tar.gz"), "x.tsv", ["b", "a"]).collect()
    assert [tuple(r) for r in got] == [('q"t', "1"), ("", "2")]
    assert readers.tsv_from_tar(spark, str(tmp_path / "a.tar.gz"), "none.tsv", ["a"]).count() == 0
    text = readers.decoded(readers.tar_members(spark, str(tmp_path / "a.tar.gz"), ".bin")).first().text
    assert text == "��ok"
    (tmp_path / "t.tsv").write_text("k\tv\n1\t\n1\tlast\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "t.tsv")).collect()] == [("1", ""), ("1", "last")]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.vector for r in readers.npy_rows(spark, str(tmp_path / "m.npy")).orderBy("row_index").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    assert readers.yaml_config(spark, str(tmp_path / "c.yaml")) == {"a": [1, 2]}


@pytest.mark.parametrize("name", ["a.tar.gz", "a.tar.bz2", "a.tar", "a.tgz", "a.tar.xz"])
def test_archives_are_streamed(spark, tmp_path, name):
    """Any bytes, long names, several archives, and splits within members."""
    rng = random.Random(4)
    want = []
    for k in range(2):
        folder = tmp_path / str(k)
        folder.mkdir()
        with tarfile.open(folder / name, {"gz": "w:gz", "gz2": "w:gz", "bz2": "w:bz2", "tar": "w", "tgz": "w:gz", "xz": "w:xz"}[name.rsplit(".", 1)[-1]]) as tar:
            for i in range(40):
                content = rng.choice([b"", b"\n", b"\r\n\xff\xfe\n\n", b"\n" * 700, rng.randbytes(rng.randrange(5000)), b"line of text\r\n" * rng.randrange(300)])
                info = tarfile.TarInfo(f"{'long' * 40}/{k}/{i}.{'bin' if i % 3 else 'txt'}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
                if i % 3:
                    want.append((f"{i}.bin", i, content))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = readers.tar_members(spark, f"{tmp_path}/*/{name}", ".bin").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((r.basename, r.ordinal, bytes(r.content)) for r in got) == sorted(want)
    assert len({r.archive for r in got}) == 2


def test_unreadable_cache_is_rebuilt(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.cached_table(spark, str(tmp_path), "f", 1, build).count() == 3
    assert len(calls) == 1
    readers.cached_table(spark, str(tmp_path), "f", 2, build)
    assert len(calls) == 2
    bad = tmp_path / "g-v1"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not parquet")
    assert readers.cached_table(spark, str(tmp_path), "g", 1, build).count() == 3


def test_kept_tables_are_checked(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(1000).withColumn("x", F.col("id") * 2).repartition(3)

    members = spark.createDataFrame([("a",), ("b",)], "s string")
    ask = lambda **more: readers.cached_table(spark, str(tmp_path), "k", 1, build, **more)
    assert ask(members=members).count() == 1000 and ask(members=members.orderBy(F.desc("s")), whole=True).count() == 1000 and len(calls) == 1
    reader = ask(members=members)
    assert ask(members=members.union(members)).count() == 1000 and len(calls) == 2  # other members
    assert reader.count() == 1000  # what was read before is still there
    ask(members=members)
    assert len(calls) == 3
    data = sorted((tmp_path / "k-v1").glob("data-*"), key=lambda p: p.stat().st_mtime)[-1]
    parts = sorted(data.glob("part-*"))
    parts[0].unlink()  # rows are missing
    assert ask(members=members).count() == 1000 and len(calls) == 4
    data = sorted((tmp_path / "k-v1").glob("data-*"), key=lambda p: p.stat().st_mtime)[-1]
    other = spark.range(1000).withColumn("x", F.col("id") * 3)
    for p in data.glob("*"):
        p.unlink()
    for p in data.glob(".*"):
        p.unlink()
    other.write.mode("append").parquet(str(data))  # as many rows, but others
    assert ask(members=members).count() == 1000 and len(calls) == 4
    assert ask(members=members, whole=True).agg(F.sum("x")).first()[0] == 999000 and len(calls) == 5
    for p in (tmp_path / "k-v1" / "manifest").glob("*"):
        p.unlink()  # a build that broke off
    assert ask(members=members).count() == 1000 and len(calls) == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None, "é", 0.123456789)], "z int, l array<string>, n string, a string, x double")
    sinks.json_lines(df.coalesce(1), str(tmp_path / "j"))
    line = next(p for p in (tmp_path / "j").iterdir() if p.name.startswith("part")).read_text()
    assert list(json.loads(line)) == ["a", "l", "n", "x", "z"] and "é" in line and json.loads(line)["n"] is None
    sinks.delimited(df, str(tmp_path / "d"), single=True, decimals={"x": 8})
    assert "a;b" in next(p for p in (tmp_path / "d").iterdir() if p.name.startswith("part")).read_text()
    v = spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0])], "id int, v array<float>")
    assert sinks.matrix_files(v, "id", "v", str(tmp_path / "m")) == 2
    assert np.load(tmp_path / "m" / "vectors.npy").tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert sinks.checksum(v) == sinks.checksum(v.orderBy("id").repartition(3)) != sinks.checksum(v.limit(1))
    assert sinks.checksum(v.limit(0)).startswith("0-")
    assert "| a |" in sinks.markdown("t", {"s": [{"a": 1.5}]})
    h = sinks.histogram(spark.createDataFrame([(0.1,), (0.9,), (5.0,), (None,)], "x double"), "x", 0.0, 1.0, 2).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in h] == [(0, 1), (1, 2)]


def test_signatures_and_diagnosis(spark):
    kind = "record_id string, participants array<struct<side:string,coefficient:double,canonical:string>>, supported_directions array<string>, labels array<string>"
    a, b = [("reactant", -1.0, "CCO"), ("product", 1.0, "CC=O")], [("product", 1.0, "CCO"), ("reactant", -1.0, "CC=O")]
    rows = [("1", a, ["reversible"], ["x"]), ("2", b, ["reversible"], ["y"]), ("3", a, ["left_to_right"], []), ("4", b, ["right_to_left"], None)]
    df = A.model_rows(spark.createDataFrame(rows, kind))
    s = {r.record_id: r for r in df.select("record_id", *(c.alias(n) for n, c in A.signatures(F.col("participants"), F.col("direction"), F.col("labels")).items())).collect()}
    assert s["1"].structure == s["2"].structure and s["1"].main == s["2"].main and s["1"].legacy != s["2"].legacy
    assert s["3"].structure != s["1"].structure
    vectors = spark.createDataFrame([("1", [1.0]), ("2", [1.0]), ("3", [1.0]), ("4", [2.0])], "record_id string, embedding array<float>")
    shared = spark.createDataFrame([("CCO", 2)], "canonical string, identity_count int")
    _, groups, summary = A.diagnose(vectors, spark.createDataFrame(rows, kind), shared)
    g = groups.first()
    assert g.group_size == 3 and not g.same_main and g.has_shared_identity and not g.has_wildcard
    assert summary.first().excess == 2 and summary.first().excess_same_main == 0


def test_quality_report(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(f"r{i}", rng.normal(size=24).tolist(), [f"1.{i % 3}"]) for i in range(60)], "record_id string, embedding array<double>, labels array<string>")
    r = A.quality_report(df, df, n_pairs=200)
    assert len(r["retrieval"]) == 9 and r["ranks"][0]["rank_violations"] == 0  # labels have two parts: levels 1, 2 and exact
    split = df.limit(10)
    assert A.holdout(df, split).count() == 50
    assert all(x.violations == 0 for x in A.check_export(df, df, 24).collect())


def test_evidence_stream(spark, tmp_path):
    rows = [(1, "click", 10, "2024-01-01 00:00:00"), (1, "click", 10, "2024-01-01 00:10:00"), (2, "error", 11, "2024-01-01 00:20:00"), (2, "view", 12, "2024-01-01 00:30:00")]
    df = spark.createDataFrame(rows, "user_id int, event_type string, event_id int, t string").select("user_id", "event_type", "event_id", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = evidence_stream(stream, {"click": "left_to_right", "view": "right_to_left"}).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user_id, r.direction) for r in spark.table("seen").collect()) == [(1, "left_to_right"), (2, "right_to_left")]
    assert evidence_counts(df.withColumn("direction", F.lit("x")), "1 hour").first().n == 4
