"""Queries cover whole tables: checked against the tables themselves, not against shared SQL."""

import re
from collections import Counter

from conftest import SF

from loomgraph.operators import extract, graph
from loomgraph.plans import fixtures as fx


def test_every_capitalised_word_is_a_mention(spark):
    docs = fx.table(spark, SF, "documents").collect()
    want = sorted((r["doc_id"], k, w) for r in docs for k, w in enumerate(re.findall("[A-Z][a-z]{3,}", r["text"] or "")))
    assert max(k for _, k, _ in want) > 15
    assert sorted(map(tuple, fx.tok(spark, SF).select("doc_id", "idx", "name").collect())) == want
    assert fx.mentions(spark, SF).count() == fx.raw_claims(spark, SF).count() == len(want)


def test_mentions_of_long_texts_keep_their_order(spark, tmp_path):
    text = " ".join("Name" + "abcdefghij"[i % 10] for i in range(2500))
    spark.createDataFrame([(0, text), (1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for df in (fx.mentions(spark, str(tmp_path)), fx.raw_claims(spark, str(tmp_path))):
        by_ord = [r["artifact_id"] for r in df.orderBy("ord").collect()]
        assert by_ord == [0] * 2500 + [1] * 2500 and df.select("ord").distinct().count() == 5000


def test_rule_extractor_names_all(spark):
    names = [f"Topic{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60)]
    got = extract.valid_entities(extract.parse_answers(spark.createDataFrame([("1", extract.rule_extractor("h\n\n" + ". ".join(names)))], "id string, raw string")))
    assert [r["name"] for r in got.orderBy("pos").collect()] == names


def test_graph_holds_all_parts_and_lineitems(spark):
    customer = {r["o_orderkey"]: r["o_custkey"] for r in fx.table(spark, SF, "orders").collect()}
    lines = fx.table(spark, SF, "lineitem").select("l_orderkey", "l_suppkey").collect()
    want = Counter((f"customer:{customer[r['l_orderkey']]}", f"supplier:{r['l_suppkey']}") for r in lines if r["l_orderkey"] in customer)
    nodes, edges = fx.graph(spark, SF)
    got = {(r["src"], r["dst"]): r["mention_count"] for r in edges.where("rel_type = 'COMMUNICATED_WITH'").collect()}
    assert got == want
    parts = {f"part:{r['p_partkey']}" for r in fx.table(spark, SF, "part").collect()}
    assert {r["id"] for r in nodes.where("id LIKE 'part:%'").collect()} == parts
    assert {r["id"] for r in graph.isolated(nodes, edges).collect()} >= parts
