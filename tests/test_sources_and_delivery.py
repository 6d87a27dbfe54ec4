from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.operators import exports, index, ordering, parallel, retrieval
from philolog.sources import importers, intake, sinks
from philolog.streaming import delivery


def test_decoding():
    assert intake.decode_bytes(b"plain words") == ("plain words", "utf-8-sig")
    assert intake.decode_bytes("中文文本".encode("gb18030"))[0] == "中文文本"
    assert intake.decode_bytes(b"\xff\xfea\x00") == ("a", "utf-16")


def test_scan_and_classify(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"a.txt": "Plain english words for the classifier to see.", "b.txt": "The_DT cat_NN sat_VBD on_IN the_DT mat_NN", "~$c.txt": "x", "d.tsv": "zh\ten\n未来\tfuture\n", "e.txt": " ", "f.md": "no"}
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    rows = intake.scan(spark, str(tmp_path / "in")).withColumn("d", intake.decoded("content")).select("filename", F.col("d.text").alias("text"))
    found = {r["filename"]: (r["detected_type"], r["confidence"]) for r in intake.classify(rows).collect()}
    assert found == {"a.txt": ("raw_en", 0.78), "b.txt": ("tagged_en", 0.9), "d.tsv": ("aligned_tsv", 0.95), "e.txt": ("unknown", 0.1)}


def test_pairs_of_files(spark):
    rows = [("x/a中文.txt", "raw_zh", "zh"), ("x/a英文.txt", "raw_en", "en"), ("x/b.txt", "raw_en", "en"), ("12 - q.txt", "tagged_zh", "zh"), ("12.txt", "tagged_en", "en")]
    manifest = spark.createDataFrame([(*r, 0.5) for r in rows], "original_path string, detected_type string, detected_language string, confidence double")
    found = {r["original_path"]: (r["probable_pair_id"], r["detected_type"], r["confidence"]) for r in intake.detect_pairs(manifest).collect()}
    assert found["x/a中文.txt"] == found["x/a英文.txt"] == ("pair-0001", "paired_raw_zh_en", 0.86)
    assert found["12.txt"] == ("pair-0002", "paired_tagged_zh_en", 0.95) and found["x/b.txt"][0] is None


def test_importers(spark):
    files = spark.createDataFrame([("s", "f", "en", "The_DT cat_NN <head>x junk\n\nGo_VB")], "source_id string, filename string, language string, text string")
    rows = importers.tagged(files).orderBy("sentence_no").collect()
    assert [(r["sentence"], r["skipped"]) for r in rows] == [("The cat", 2), ("Go", 0)] and [t["pos"] for t in rows[0]["tokens"]] == ["DT", "NN"]
    xml = files.withColumn("text", F.lit("<head>T</head><p><s>One.</s><s>Two.</s></p><p>Three. Four.</p>"))
    assert [r["sentence"] for r in importers.xml_like(xml).orderBy("sentence_no").collect()] == ["One.", "Two.", "Three.", "Four."]
    raw = files.withColumn("text", F.lit("A b. C.\n\nD e"))
    assert [(r["paragraph_no"], r["sentence_no"]) for r in importers.raw_mono(raw).orderBy("sentence_no").collect()] == [(1, 1), (1, 2), (2, 3)]
    lines = spark.createDataFrame([(1, "zh\ten"), (2, "未来\tA future"), (3, "x")], "line_no long, line string")
    assert [(r["a_text"], r["is_error"]) for r in importers.aligned_table(lines).orderBy("pair_no").collect()] == [("未来", False), ("x", True)]


def test_alignment_keeps_gaps(spark):
    pairs = spark.createDataFrame([(1, "一二三四五六\n\n七八\n\n九十一二三四", "one two three four five\n\nnine ten eleven twelve")], "pair_id long, a_text string, b_text string")
    rows = importers.paired_paragraphs(pairs).orderBy("pair_no").collect()
    assert all(r["a_text"] and r["confidence"] < 1 for r in rows) and "".join(r["a_text"].replace("\n", "") for r in rows) == "一二三四五六七八九十一二三四"
    assert importers.align_lengths([10, 10], [10, 10]) == [(0, 1, 0, 1, 0.95), (1, 2, 1, 2, 0.95)]


def test_structure(spark):
    pairs = spark.createDataFrame([(1, '<s n="1">甲<s n="1">乙<s n=3>丙', '<s n="1">a< /s><s n="1">b<s n="2">c')], "pair_id long, a_text string, b_text string")
    assert [(r["a_text"], r["b_text"]) for r in importers.paired_structure(pairs).orderBy("pair_no").collect()] == [("甲", "a"), ("乙", "b")]


def test_audit(spark):
    rows = [(1, "你好世界", "hello big world", 0.9), (2, "你好世界", "Hello  big world", 0.4), (3, "你好世界", "another thing here", 1.2), (4, "", "x", 0.9)]
    audited = parallel.audit(spark.createDataFrame(rows, "pair_no long, a_text string, b_text string, confidence double"))
    assert {r["pair_no"]: r["reasons"] for r in audited.collect()} == {1: [], 2: ["duplicate_pair", "low_confidence"], 3: ["source_translation_variant", "invalid_confidence"], 4: ["empty_side"]}
    summary = parallel.audit_summary(audited, 2).first()
    assert (summary["total_pairs"], summary["written_anomalies"], summary["suppressed_anomalies"], summary["mean_confidence"]) == (4, 2, 1, 0.733333)


def test_pair_search(spark):
    rows = [(1, "the cat and the dog", "x"), (2, "then", "y"), (3, "none", "z")]
    pairs = spark.createDataFrame([(*r, "sentence", "f.tsv", 0.5) for r in rows], "pair_no long, a_text string, b_text string, alignment_unit string, filename string, confidence double")
    assert parallel.occurrences(pairs, parallel.PairQuery("the")).count() == 3
    assert parallel.occurrences(pairs, parallel.PairQuery("the", whole_words=True)).count() == 2
    assert parallel.occurrences(pairs, parallel.PairQuery("the", every=2)).count() == 2
    assert parallel.occurrences(pairs, parallel.PairQuery(a_lacks="the")).count() == 1
    q = parallel.PairQuery("cat", context=1)
    (row,) = parallel.with_context(parallel.occurrences(pairs, q), q).collect()
    assert (row["left"], row["keyword"], row["right"], row["L1"], row["L2"], row["R2"]) == ("the", "cat", "and…", "the", None, "the")


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, "public policy and governance"), (2, "queue concurrency"), (3, "policy policy")], "doc_id long, text string")
    ranked = [r["id"] for r in retrieval.bm25(chunks, "governance policy").orderBy(F.desc("score")).collect()]
    assert ranked[0] == 1 and set(ranked) == {1, 3}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [r["id"] for r in retrieval.dense_search(vectors, [1.0, 0.1], 2).collect()] == [1, 2]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("=a", 1), ("b", 2)], "t string, n long")
    assert sinks.export_table(rows.coalesce(1), str(tmp_path / "out")) == 2
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*"))
    assert text.split("\r\n")[:3] == ["\ufefft\tn", "'=a\t1", "b\t2"]
    with pytest.raises(ValueError):
        sinks.export_table(rows, str(tmp_path / "out2"), 1)


def test_publish_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.publish(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert len(list(tmp_path.iterdir())) == 1
    assert sinks.missing_columns(spark, path, {"id": "bigint", "x": "string"}) == ["x"]


def test_retries(spark):
    delays = spark.range(1, 14).select(delivery.retry_delay(F.col("id"))).collect()
    assert [r[0] for r in delays[:4]] == [5, 10, 20, 40] and delays[-1][0] == 3600
    now = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, "pending", 0, now - timedelta(1), None), (2, "publishing", 11, now, now - timedelta(1)), (3, "pending", 0, now + timedelta(1), None)], "id long, status string, attempt_count int, available_at timestamp, locked_until timestamp")
    assert {r["id"] for r in delivery.claimable(events, F.lit(now)).collect()} == {1, 2}
    failed = {r["id"]: (r["status"], r["attempt_count"]) for r in delivery.after_failure(events, F.lit(now)).collect()}
    assert failed[1] == ("pending", 1) and failed[2] == ("dead", 12)


def test_projection_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "p")
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "message_id long, payload string")
    assert delivery.project_once(batch, path).count() == 0
    assert delivery.project_once(batch, path).count() == 0
    assert spark.read.parquet(path).count() == 2
    assert delivery.project_once(spark.createDataFrame([(1, "z")], "message_id long, payload string"), path).count() == 1


def test_job_states(spark):
    rows = [(1, 1, "running"), (1, 2, "succeeded"), (1, 3, "running"), (2, 1, "succeeded"), (2, 2, "cancelled")]
    states = {r["job_id"]: r["state"] for r in delivery.job_states(spark.createDataFrame(rows, "job_id long, seq long, wanted string"), F.floor(F.col("seq") / 2)).collect()}
    assert states == {1: "succeeded", 2: "cancelled"}


def test_streaming_dedup_and_windows(spark, tmp_path):
    source = str(tmp_path / "s")
    base = datetime(2024, 1, 1)
    spark.createDataFrame([(1, base), (1, base), (2, base + timedelta(minutes=5)), (3, base + timedelta(hours=9))], "k long, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k long, ts timestamp").parquet(source)
    for name, frame, n in (("dedup", delivery.deduplicated(stream, "k", "ts"), 3), ("counted", delivery.windowed_counts(stream), 1)):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == n


def test_export_quotes_and_marks(spark, tmp_path):
    rows = spark.createDataFrame([('say "no"\tnow', "=1"), ("", None)], "a string, b string").coalesce(1)
    assert sinks.export_table(rows, str(tmp_path / "out")) == 2
    (file,) = (tmp_path / "out").glob("part-*")
    assert file.read_bytes().decode("utf-8-sig").split("\r\n")[:2] == ["a\tb", '"say ""no""\tnow"\t\'=1']
    with pytest.raises(ValueError):
        sinks.export_table(rows, str(tmp_path / "out"), 1)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1 and not list(tmp_path.glob("*.new-*"))


def test_scan_takes_any_case_and_order(spark, tmp_path):
    for name in ("b/X.TXT", "a.tsv", "~$a.txt", "c.md", "B/a.Tsv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r["relative_path"] for r in intake.scan(spark, str(tmp_path)).orderBy("scan_order").collect()] == ["a.tsv", "B/a.Tsv", "b/X.TXT"]


def test_manifest_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "raw_en", "en", 0.78, "p1", 10, ["x", "y"]), ("b.txt", "tagged_zh", "zh", 0.9, None, 5, [])], "filename string, detected_type string, detected_language string, confidence double, probable_pair_id string, size_bytes long, notes array<string>")
    sinks.write_manifest(rows.coalesce(1), str(tmp_path))
    (file,) = (tmp_path / "csv").glob("part-*")
    assert file.read_bytes().startswith(b"\xef\xbb\xbffilename,") and "x;y" in file.read_text()
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    found = {r["detected_type"]: (r["files"], r["pairs"], r["bytes"]) for r in intake.summary(rows).collect()}
    assert found == {"raw_en": (1, 1, 10), "tagged_zh": (1, 0, 5)}
    assert [r["filename"] for r in intake.mismatched(rows, "tagged", "zh_en").collect()] == ["a.txt"]
    assert [r["filename"] for r in intake.mismatched(rows, "raw_mono", "zh").collect()] == ["a.txt", "b.txt"]


def test_index_health(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert sinks.index_health(spark, folder)[0] == "missing"
    docs = spark.createDataFrame([(1, "One thing. Two.", "en"), (9_000_000_000, "Trois.", "fr")], "doc_id long, text string, lang string")
    index.write_index(docs, folder)
    assert sinks.index_health(spark, folder) == ("ready", "") and sinks.index_health(spark, folder, "2")[0] == "outdated"
    stored = spark.read.parquet(f"{folder}/tokens")
    assert sorted((r["document_id"], r["global_position"]) for r in stored.collect()) == [(1, k) for k in range(1, 6)] + [(9_000_000_000, 6), (9_000_000_000, 7)]
    stored.drop("lemma").write.mode("overwrite").parquet(f"{folder}/word_totals")
    assert sinks.index_health(spark, folder)[0] == "corrupt"


def test_lines_of_interchange(spark, tmp_path):
    sinks.write_lines({"documents": spark.createDataFrame([(1, "é")], "id long, text string")}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "documents")).first().asDict() == {"id": 1, "text": "é"}


def test_delivery_of_dead_and_old_events(spark):
    now = datetime(2024, 1, 10)
    rows = [(1, "dead", 12, now, 0, None), (2, "published", 1, now, 0, now - timedelta(days=8)), (3, "published", 1, now, 0, now - timedelta(days=6)), (4, "pending", 0, now, 0, None)]
    frame = spark.createDataFrame(rows, "id long, status string, attempt_count int, available_at timestamp, replay_count int, published_at timestamp")
    again = {r["id"]: (r["status"], r["attempt_count"], r["replay_count"]) for r in delivery.replayed(frame, F.lit(now)).collect()}
    assert again[1] == ("pending", 0, 1) and again[4] == ("pending", 0, 0)
    assert sorted(r["id"] for r in delivery.kept(frame, F.lit(now)).collect()) == [1, 3, 4]
    jobs = spark.createDataFrame([(1, "running"), (2, "failed")], "job_id long, state string")
    assert [r["state"] for r in delivery.restored(jobs).orderBy("job_id").collect()] == ["queued", "failed"]
    ends = spark.createDataFrame([(1, now - timedelta(1)), (2, now + timedelta(1)), (3, None)], "id long, expires_at timestamp")
    assert [r["id"] for r in delivery.expired(ends, F.lit(now)).collect()] == [1]
    sums = spark.createDataFrame([(3, 1, 1.5, 2)], "pairs long, anomalies long, confidence_sum double, confidence_count long")
    assert delivery.merged_summary(sums, sums).first()["pairs"] == 6
    times = spark.createDataFrame([("a", now), ("a", now + timedelta(minutes=10)), ("a", now + timedelta(hours=2))], "key string, ts timestamp")
    assert sorted(r["n"] for r in delivery.sessions(times, "key").collect()) == [1, 2]


def test_chunks_of_pairs_and_their_vectors(spark):
    pairs = spark.createDataFrame([(1, "甲", "a"), (2, "乙", "b")], "pair_no long, a_text string, b_text string")
    chunks = retrieval.pair_chunks(pairs)
    assert [r["text"] for r in chunks.orderBy("chunk_id").collect()] == ["[ZH] 甲\n[EN] a", "[ZH] 乙\n[EN] b"]
    stored = chunks.where("chunk_id = 'pair:1'").select("chunk_id", "text_sha256").union(spark.createDataFrame([("pair:2", "old")], "chunk_id string, text_sha256 string"))
    assert [r["chunk_id"] for r in retrieval.stale(chunks, stored).collect()] == ["pair:2"]
    vectors = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],)], "v array<double>")
    assert [r[0] for r in vectors.select(retrieval.valid_vector(F.col("v"), 2)).collect()] == [True, False, False, False]


def test_first_anomalies(spark):
    rows = spark.createDataFrame([(k, ["x"] if k % 2 else [], 0.5) for k in range(10)], "pair_no long, reasons array<string>, confidence double")
    assert [r["pair_no"] for r in parallel.first_anomalies(rows, 3).collect()] == [1, 3, 5]


def test_token_borders_of_spans():
    assert X.literal_spans("state-of-the-art the", "the", False, True) == [(9, 12), (17, 20)]
    assert X.literal_spans("state-of-the-art the", "the", False, True, True) == [(17, 20)]


def test_bounded_maps(spark):
    (row,) = spark.range(1).select(X.bounded(F.create_map(F.lit("b"), F.lit("xyz"), F.lit("a"), F.lit("q"), F.lit("c"), F.lit("r")), 2, 2).alias("m")).collect()
    assert row["m"] == {"a": "q", "b": "xy"}


def test_audit_files(spark, tmp_path):
    (tmp_path / "pairs.jsonl").write_text('{"pair_no": 1, "a_text": "x", "b_text": "y", "confidence": 0.9}\n{"pair_no": 2, "a_text": "", "b_text": "y", "confidence": 2}\n')
    audited = parallel.audit(parallel.read_pairs(spark, str(tmp_path / "pairs.jsonl")))
    parallel.write_report(audited, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first()["empty_side_pairs"] == 1
    assert spark.read.json(str(tmp_path / "report" / "anomalies")).count() == 1
    (tmp_path / "pairs.jsonl").write_text("no pair\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        parallel.write_report(parallel.audit(parallel.read_pairs(spark, str(tmp_path / "pairs.jsonl"))), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first()["total_pairs"] == 2


def test_selected_and_merged(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    assert [r["t"] for r in index.selected(rows, spark.createDataFrame([(3,), (3,), (9,)], "id long"), "id").collect()] == ["c"]
    docs = spark.createDataFrame([(1, "The cat. The dog", "en"), (2, "the Cat", "en")], "doc_id long, text string, lang string")
    of = lambda d: index.word_totals(index.token_table(d))
    merged = index.merged_totals(of(docs.where("doc_id = 1")), of(docs.where("doc_id = 2")))
    columns = sorted(merged.columns)
    assert sorted(map(tuple, merged.select(*columns).collect())) == sorted(map(tuple, of(docs).select(*columns).collect()))


def test_dense_search_by_language(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "en"), (2, [1.0, 0.0], "zh"), (3, [1.0, 0.1], "zh_en")], "vec_id long, embedding array<double>, language string")
    assert [r["id"] for r in retrieval.dense_search(vectors, [1.0, 0.0], 5, language="en").collect()] == [1, 3]


def test_exports(spark):
    q = parallel.PairQuery("the", filename_has="x", min_confidence=0.5, context=9)
    assert exports.remembered(q, ["R1"]) | {} == {"q": "the", "side": "a", "a_has": "", "b_has": "", "a_lacks": "", "b_lacks": "", "alignment_unit": "", "whole_words": False, "case_sensitive": False, "every": 1, "sort_1": "R1", "sort_2": "", "sort_3": ""}
    pairs = spark.createDataFrame([(1, "the b the a", "x", "sentence", "f", 1.0), (2, "the a", "y", "sentence", "f", 1.0)], "pair_no long, a_text string, b_text string, alignment_unit string, filename string, confidence double")
    assert [(r["pair_no"], r["occurrence_ordinal"]) for r in exports.occurrence_rows(pairs, parallel.PairQuery("the"), ["R1"]).collect()] == [(1, 2), (2, 1), (1, 1)]
    for bad in (ordering.collocates, ordering.keywords, ordering.runs, ordering.clusters, ordering.plots):
        with pytest.raises(ValueError):
            bad("nothing")
    with pytest.raises(ValueError):
        ordering.occurrences(["L1", "L2", "L3", "R1"])
