import json

from loomgraph.sources import readers, writers
from loomgraph.streaming.ingest import ingest_stream, ledger, progress, read_mail_stream


def test_csv_and_count(spark, tmp_path):
    (tmp_path / "m.csv").write_text('file,message\na/1,"Subject: x\n\nsaid ""hi"""\nb/2,y\n')
    df = readers.mail_csv(spark, str(tmp_path / "m.csv"))
    assert [r["message"] for r in df.collect()] == ['Subject: x\n\nsaid "hi"', "y"] and readers.mail_count(spark, str(tmp_path / "m.csv")) == 2
    writers.subset_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out")).count() == 2


def test_extraction_documents(spark, tmp_path):
    doc = {"artifact_id": "1", "entities": [{"name": "A", "entity_type": "person", "aliases": []}], "claims": [{"claim_type": "decided", "subject": "A", "object": "A", "confidence": 0.9}]}
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "skip.txt").write_text("x")
    m, c = readers.flatten_extractions(readers.extractions(spark, str(tmp_path)))
    assert m.first()["name"] == "A" and c.first()["claim_type"] == "decided" and m.count() == 1


def test_graph_tables_and_cache(spark, tmp_path):
    import pytest

    nodes = spark.createDataFrame([("a", "A", 1)], "id string, canonical_name string, mention_count long")
    edges = spark.createDataFrame([("a", "a", "DECIDED")], "src string, dst string, rel_type string")
    writers.graph_tables(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).where("rel_type = 'DECIDED'").count() == 1
    with pytest.raises(ValueError):
        writers.graph_tables(nodes.union(nodes), edges, str(tmp_path / "g2"))
    assert readers.cached(spark, str(tmp_path / "none"), lambda: nodes).count() == 1


def test_stream_resumes_and_repeats_safely(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "file string, message string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    mail = lambda i, body: (f"b/{i}", f"Message-ID: <{i}>\n\n{body}")
    put(1, [mail(1, "x"), mail(2, "x"), mail(3, "y")])
    run = lambda: ingest_stream(read_mail_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"))
    q = run()
    q.awaitTermination()
    assert sum(p["rows"] for p in progress(q)) == 3
    put(2, [mail(4, "y"), mail(5, "z"), mail(1, "other")])
    run().awaitTermination()
    assert sorted(r["message_id"] for r in ledger(spark, str(tmp_path / "t")).collect()) == ["<1>", "<3>", "<5>"]


def test_stream_keeps_the_first_file_in_any_range(spark, tmp_path):
    """Copies in several ranges, the first of them slow to write; ids that several files share."""
    import hashlib
    import random

    from loomgraph.plans.catalogue import stream_ingest

    rnd = random.Random(1)
    rows = [(1000 + i, 0, "a", rnd.randbytes(100_000).hex()) for i in range(100)]
    rows += [(c + i, k, r, f"{k} {i}") for c, r in ((1000, "a"), (2000, "b"), (3000, "c")) for k in (1, 2) for i in range(100)]
    rows += [(1000 + i, 1, "z", f"own {i}") for i in range(100)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    first = {}
    for _, c, k, t in sorted((f"{r}/sent/{c}.{k}", c, k, t) for c, k, r, t in rows):
        first.setdefault(hashlib.sha256(t.encode()).hexdigest(), f"<{c}.{k}@example.com>")
    got = stream_ingest(spark, str(tmp_path)).collect()
    assert sorted((r["body_hash"], r["message_id"]) for r in got) == sorted(first.items())


def test_batch_keeps_one_row_a_body(spark, tmp_path):
    from loomgraph.streaming.ingest import ingest_batch

    mail = lambda f, i, body: (f, f"Message-ID: <{i}>\n\n{body}")
    rows = [mail("f", 1, "x"), mail("f", 1, "x"), mail("f", 2, "y"), mail("e", 3, "y")]
    ingest_batch(spark.createDataFrame(rows, "file string, message string"), 0, str(tmp_path / "t"))
    assert sorted(r["message_id"] for r in ledger(spark, str(tmp_path / "t")).collect()) == ["<1>", "<3>"]


def test_entry_without_llm(tmp_path):
    """The rest works when the llm parts are gone."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "loomgraph"), tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'er_fuzzy' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_resolved_graph_and_page(spark, tmp_path):
    entities = spark.createDataFrame([("a", "A <b>", "person", 3)], "id string, canonical_name string, entity_type string, mention_count long")
    claims = spark.createDataFrame([("c", "decided")], "id string, claim_type string")
    stats = spark.createDataFrame([(5, 1)], "raw_entities long, entities long")
    writers.graph_document(entities, claims, stats, str(tmp_path / "g"))
    e, c, head = readers.resolved_graph(spark, str(tmp_path / "g"))
    assert e.first() == entities.first() and c.first() == claims.first()
    assert head.first()["schema_version"] == "v1.0" and head.first()["stats"]["raw_entities"] == 5
    page = writers.graph_page(entities.selectExpr("id", "canonical_name AS label", "20 AS size"), claims.selectExpr("id AS src", "id AS dst", "1.0 AS width"), "T & t").first()["html"]
    assert "<title>T &amp; t</title>" in page and "A \\u003cb>" in page and '"src":"c"' in page
    one = {"schema_version": "v1.0", "entities": [{"id": "x", "canonical_name": "X"}], "claims": [{"id": "k", "claim_type": "decided"}]}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1))
    e, c = readers.graph_document(spark, str(tmp_path / "one.json"))
    assert e.first()["canonical_name"] == "X" and c.first()["claim_type"] == "decided"


def test_checkpoint_falls_back(spark, tmp_path):
    path = tmp_path / "c.json"
    assert readers.checkpoint(spark, str(path)).count() == 0
    path.write_text('{"processed_ids": ["1"')
    assert readers.checkpoint(spark, str(path)).count() == 0
    (tmp_path / "c.json.bak").write_text('{"processed_ids": ["1"], "failed_ids": ["2"]}')
    assert sorted(map(tuple, readers.checkpoint(spark, str(path)).collect())) == [("1", "processed"), ("2", "failed")]
    path.write_text('{"processed_ids": ["9"]}')
    assert [tuple(r) for r in readers.checkpoint(spark, str(path)).collect()] == [("9", "processed")]


def test_failed_messages_are_done(spark, tmp_path):
    import signal

    from loomgraph.streaming import ingest

    def flaky(prompt):
        if "bad" in prompt:
            raise ConnectionError("lost")
        return '{"entities": [], "claims": []}'

    def put(rows):
        spark.createDataFrame(rows, "file string, message string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    run = lambda: ingest_stream(read_mail_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), flaky, lambda e, n: 0.0)
    put([("b/1", "Message-ID: <1>\n\nbad"), ("b/2", "Message-ID: <2>\n\ngood")])
    run().awaitTermination()
    put([("b/3", "Message-ID: <1>\n\nnow good"), ("b/4", "Message-ID: <4>\n\nmore")])
    q = run()
    q.awaitTermination()
    want = [("<1>", "failed", 4), ("<2>", "processed", 1), ("<4>", "processed", 1)]
    assert sorted((r["message_id"], r["status"], r["attempts"]) for r in ledger(spark, str(tmp_path / "t")).collect()) == want
    ingest.compact(spark, str(tmp_path / "t"), str(tmp_path / "t2"))
    assert sorted((r["message_id"], r["status"], r["attempts"]) for r in ledger(spark, str(tmp_path / "t2")).collect()) == want
    old = [signal.getsignal(s) for s in (signal.SIGINT, signal.SIGTERM)]
    try:
        handle = ingest.stop_gracefully(q)
        handle(2, None)
        import pytest

        with pytest.raises(KeyboardInterrupt):
            handle(2, None)
    finally:
        for s, h in zip((signal.SIGINT, signal.SIGTERM), old, strict=True):
            signal.signal(s, h)
