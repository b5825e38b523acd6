"""Readers, writers, evaluation fixtures and streams."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from ferrule import sources as S
from ferrule import streaming
from ferrule.functions import scalars
from ferrule.operators import evaluation as E
from ferrule.operators import memory as M
from ferrule.operators import payloads as Y
from ferrule.plans.registry import QUERIES


def test_json_case_and_validation(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"case_id": "c1", "report_text": "x", "imaging": [{"study_id": "s", "modality": "CR"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"report_text": ""}))
    rows = {r.case_id: r for r in S.known_modalities(S.validated(S.read_cases(spark, str(tmp_path)))).collect()}
    assert rows["c1"].valid and rows["c1"].modality_ok and not rows["c1"].warnings
    assert rows[None].errors and rows[None].warnings
    assert not S.known_modalities(S.read_cases(spark, str(tmp_path)).where("case_id = 'c1'"), ["ct_3d"]).first().modality_ok


def test_csv_loaders(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Image Index,Finding Labels,Patient ID,Patient Age\n00000001_000.png,Effusion|Mass,7,58\n,,,\n')
    rows = S.read_csv(spark, str(tmp_path / "c.csv")).withColumn("row_index", F.monotonically_increasing_id())
    got = S.cxr_cases(rows).collect()
    assert [r.case_id for r in got] == ["cxr14-00000001_000", "cxr14-cxr-row-1"] and "Effusion|Mass" in got[0].report_text
    assert S.read_csv(spark, str(tmp_path / "c.csv"), 1).count() == 1
    (tmp_path / "o.csv").write_text("uid,image,indication,findings,impression,problems\n1,i.png,cough,,clear lungs,\n")
    r = S.openi_cases(S.read_csv(spark, str(tmp_path / "o.csv")).withColumn("row_index", F.lit(0))).first()
    assert r.case_id == "openi-1" and r.report_text == "Indication: cough Impression: clear lungs" and r.patient_complaints == "cough"


def test_benchmark_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"case_id":"a","gold_labels":["X ",""]}\n\n{"case_id":"b","gold_label":"Y"}\nnot json\n{"case_id":"c"}\n')
    good, bad = S.read_benchmark(spark, str(tmp_path / "b.jsonl"))
    assert {r.case_id: r.gold_labels for r in good.collect()} == {"a": ["x"], "b": ["y"], "c": []}
    assert [(r.line, r.value) for r in bad.collect()] == [(4, "not json")]


def test_json_lines_are_canonical(spark):
    df = spark.createDataFrame([(1, {"b": 1, "a": 2}, [(3, "y")], "raw")], "z int, m map<string,int>, l array<struct<q:int,a:string>>, raw_result string").withColumn("t", F.lit("2020-01-02").cast("date"))
    assert S.canonical_lines(df).first().value == '{"l":[{"a":"y","q":3}],"m":{"a":2,"b":1},"t":"2020-01-02","z":1}'
    assert '"raw_result":"raw"' in S.canonical_lines(df, raw=True).first().value


def test_lists_of_one(spark):
    df = spark.createDataFrame([("x", ["a"]), (None, None)], "s string, l array<string>")
    got = df.select(scalars.as_list(F.col("s"), False).alias("s"), scalars.as_list(F.col("l"), True).alias("l")).collect()
    assert [tuple(r) for r in got] == [(["x"], ["a"]), ([], [])]


def test_registry_round_trip(spark, tmp_path):
    assert S.read_registry(spark, str(tmp_path / "none")).count() == 0
    p = spark.createDataFrame([("c", "p1", 1.0, "h", "x", True, ["x"], 2.0)], S.REGISTRY_SCHEMA)
    S.write_json(p, str(tmp_path / "reg"))
    assert S.read_registry(spark, str(tmp_path / "reg")).collect() == p.collect()


def test_texts_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"ab\xffc")
    assert S.read_texts(spark, str(tmp_path / "t.txt")).first().text == "abc"


def test_calibration_fixture(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0)], "confidence double, correct int")
    bins = E.calibration_bins(rows, 5)
    assert {r.bin: r.n for r in bins.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}
    s = E.calibration_summary(bins).first()
    assert s.brier == 0.18 and 0 <= s.ece <= s.mce <= 1
    empty = E.calibration_summary(E.calibration_bins(rows.limit(0))).first()
    assert (empty.n, empty.ece, empty.brier) == (0, 0.0, 0.0)
    assert E.suggested_threshold(E.calibration_bins(rows.limit(0))).first().status == "no_threshold_suggested"


def test_chunks_cover_the_text(spark):
    texts = ["", " ", "a" * 1, "word " * 700, "é" * 2500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ids = df.select(scalars.chunk_id("bounded", F.lit("/a.b/c.d.txt"), F.lit(0)), scalars.chunk_id("sliding", F.lit("/a.b/c.d.txt"), F.lit(0)), scalars.chunk_id("collapsed", F.lit("/a.b/c.d.txt"), F.lit(0))).first()
    assert tuple(ids) == ("c.d-chunk-1", "doc:c.d.txt:0", "c.d-chunk-0")
    for cut, size in ((scalars.chunks_sliding, 1200), (scalars.chunks_bounded, 1200), (scalars.chunks_collapsed, 900)):
        for text, r in zip(texts, df.select(cut(F.col("t")).alias("c")).collect()):
            assert all(len(x.chunk) <= size for x in r.c)
            if len(text) > 1:
                assert all(x.chunk.strip() in " ".join(text.split()) or x.chunk.strip() in text for x in r.c)
    assert [len(r.c) for r in df.select(scalars.chunks_collapsed(F.col("t")).alias("c")).collect()][:2] == [1, 1]
    assert [len(r.c) for r in df.select(scalars.chunks_bounded(F.col("t")).alias("c")).collect()][:2] == [0, 0]


def test_embedding_is_normal(spark):
    docs = spark.createDataFrame([(1, "hello wörld"), (2, "")], "i int, text string")
    rows = sorted(M.embedded(docs, M.embed).collect())
    assert len(rows) == 2 and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-4
    assert rows[1].vector == [0.0] * 128  # an empty text has a vector of zeros
    assert M.embedded(docs, lambda t: F.array(F.char_length(t).cast("double"))).collect()[0].vector == [11.0]  # any embedding can stand in
    assert {r.i for r in M.embedding_sums(docs, ["i"]).collect()} == {1}


def test_memory_replay(spark):
    m, none = {"k": "1"}, None
    rows = [
        (1, "promote", "a", none, none, none, "early"), (2, "upsert", "a", "one", m, "candidate", none), (3, "promote", "a", none, none, none, "good"), (4, "upsert", "a", "two", m, "rejected", none),
        (5, "upsert", "b", "x", m, "candidate", none), (6, "promote", "b", none, none, none, "why"), (7, "promote", "gone", none, none, none, "no"), (8, "upsert", none, "nameless", none, "candidate", none), (9, "upsert", "", "nameless", none, "rejected", none),
    ]
    log = spark.createDataFrame(rows, "ts int, event string, record_id string, text string, metadata map<string,string>, status string, reason string").withColumns({"event_id": F.col("ts"), "modality": F.lit("text"), "source": F.lit("s")})
    records, rejected = M.replay(log)
    got = {r.text: r for r in records.collect()}
    assert set(got) == {"two", "x", "nameless"}
    assert (got["two"].learning_status, got["two"].metadata, got["two"].created_at, got["two"].updated_at) == ("promoted", m, 2, 4)  # sticky; the reason went with the old metadata
    assert (got["x"].learning_status, got["x"].metadata, got["x"].updated_at) == ("promoted", {"k": "1", "promotion_reason": "why"}, 6)
    assert (got["nameless"].learning_status, got["nameless"].record_id) == ("rejected", hashlib.sha256(b"memory:nameless").hexdigest()[:24])
    assert sorted((r.record_id, r.ts) for r in rejected.collect()) == [("a", 1), ("gone", 7)]


def test_numbered_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN_ROWS", 7)
    ids = [5, 1, 900, 3, -4, 10**12, 77, *range(100, 150)]
    got = {r.i: r.place for r in M.numbered(spark.createDataFrame([(i,) for i in ids], "i long"), "i").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids), 1)}
    assert M.numbered(spark.createDataFrame([], "i long"), "i").count() == 0


def test_canonical_hash_equals_json_dumps(spark):
    values = [{"b": [1, None, {"z": "é\n\"", "a": 1.5}], "a": "😀"}, {}, [1, 2], "x"]
    rows = spark.createDataFrame([(json.dumps(v, ensure_ascii=False),) for v in values] + [("{broken",), (None,)], "j string")
    got = [r.h for r in rows.select(scalars.canonical_hash(F.col("j")).alias("h")).collect()]
    assert got == [hashlib.sha256(json.dumps(v, sort_keys=True).encode()).hexdigest() for v in values] + [None, None]


def test_streams_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    log = lambda e: e.select(F.col("user_id").alias("record_id"), "ts", "event_id", "value", F.when(F.col("event_type") == "purchase", "promoted").otherwise("candidate").alias("status"))
    stream = streaming.memory_state(log(streaming.read_events(spark, str(tmp_path / "in"), 1)))
    run = stream.writeStream.format("memory").queryName("memory_state").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    assert sorted(spark.table("memory_state").collect()) == sorted(M.fold(log(events)).collect())
    firsts = streaming.first_outcomes(streaming.read_events(spark, str(tmp_path / "in")).withColumn("prediction_id", F.col("user_id")), "1000 days")
    run = firsts.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    run.awaitTermination(120)
    assert spark.table("firsts").count() == events.select("user_id").distinct().count()


def test_late_events_are_dropped(spark, tmp_path):
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    at = lambda day, n: [(i, datetime.datetime(2024, 1, day), 1, "view", 0.0, "") for i in range(n)]
    (tmp_path / "in").mkdir()
    read = streaming.read_events(spark, str(tmp_path / "in")).withColumn("status", F.col("event_type"))
    for day, n in ((10, 3), (20, 2), (1, 5), (21, 1)):  # the third file is far behind the watermark
        spark.createDataFrame(at(day, n), kind).write.mode("append").parquet(str(tmp_path / "in"))
        run = streaming.status_by_window(read).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = {r.window.start.day: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[10] == 3 and 1 not in got


def test_points_take_the_whole_text(spark):
    tail = "Wörter " * 30
    texts = [tail + "one", tail + "two two", "", None, tail + "one", "a" * 70_000 + " Zß é"]
    docs = spark.createDataFrame([(min(i, 3), t) for i, t in enumerate(texts)], "i int, text string")
    own = Y.point(F.col("i").cast("string"), F.col("text"), F.create_map(F.lit("k"), F.lit("v")), F.lit("here"))
    got = [r.p for r in docs.select(own.alias("p")).collect()]
    assert len(got) == len(texts) and got[0].vector.text_dense != got[1].vector.text_dense
    for t, p in zip(texts, got):
        sums, counts = [0] * 128, {}
        for i, b in enumerate((t or "").encode()):
            sums[(b + i) % 128] += b % 31 + 1
        norm = sum(x * x for x in sums) ** 0.5 or 1.0
        for token in (t or "").lower().split():
            counts[sum(map(ord, token)) % 100_000] = counts.get(sum(map(ord, token)) % 100_000, 0) + 1
        assert p.vector.text_dense == [round(x / norm, 6) for x in sums]
        assert dict(zip(p.vector.text_sparse.indexes, p.vector.text_sparse["values"])) == counts and p.vector.text_sparse.indexes == sorted(counts)
        assert (p.payload.text, p.payload.metadata, p.payload.source, p.payload.memory_type) == (t or "", {"k": "v"}, "here", "clinical_semantic_memory")


def test_memory_documents_with_one_opening_stay_apart(spark, tmp_path):
    head = "The same opening of sixty characters and some more of it, as boilerplate has. "
    rows = [(1, head + "one", "en", "s"), (2, head + "two", "en", "s"), (3, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["memory_documents"](spark, str(tmp_path)).collect()}
    assert got[1].sha != got[2].sha and [got[i].focus for i in (1, 2, 3)] == ["base", "base", "override"]
    assert all((got[i].n, got[i].sha) == (len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
