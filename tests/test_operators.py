import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import mail, text
from loomgraph.operators import content, extract, graph, render, resolve, retrieval, selection
from loomgraph.operators.components import connected_components
from loomgraph.operators.facade import GraphService
from loomgraph.operators.skew import lookup_join


def union_find(edges):
    at = {}

    def find(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            at[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in at}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 5), (3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 200)], [(999, i) for i in range(200)]])
def test_components_shapes(spark, ws, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, ws).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_components_random(spark, ws):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_lookup_join_with_hot_key(spark, ws):
    left = ws.save(spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id"), "left")
    right = ws.save(left.groupBy("k").agg(F.count("*").alias("n")), "right")
    out = lookup_join(left, right, ["k"], "n")
    assert out.count() == 3000 and out.where("k = 7 AND n = 2000").count() == 2000


names = st.text(alphabet="abcd é", min_size=0, max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(names, names), min_size=1, max_size=30))
def test_lcs_matches_table(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.lcs_native(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        assert r["n"] == text.lcs_plain(r["a"], r["b"])


def test_long_names_are_compared(spark):
    a = "x" * 70 + " bb"
    df = spark.createDataFrame([(a, "x" * 69 + " bb"), (a, "y" * 70)], "a string, b string")
    assert [r[0] for r in df.select(text.similar_long(F.col("a"), F.col("b"))).collect()] == [True, False]


@pytest.mark.parametrize("raw,want", [("  'Ann  Lee' ", "ann lee"), ('"Bob"', "bob"), (" X y", "x y"), ("' a '", " a ")])
def test_normalize_name(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(text.normalize_name(F.col("n"))).first()[0] == want


def plain_similar(groups, threshold):
    """Every pair of one type and start, by the table recurrence."""
    out = set()
    for i, (g, t, n) in enumerate(groups):
        for h, u, m in groups[:i]:
            if t == u and n[:3] == m[:3] and min(len(n), len(m)) >= 4 and not n.isdigit() and not m.isdigit():
                x, y = " ".join(sorted(n.split())), " ".join(sorted(m.split()))
                if 1 - (len(x) + len(y) - 2 * text.lcs_plain(x, y)) / (len(x) + len(y)) >= threshold - 1e-12:
                    out.add((min(g, h), max(g, h)))
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.75, 1.0])
def test_similar_pairs_are_those_of_all_pairs(spark, threshold):
    r = random.Random(5)
    names = []
    for _ in range(60):
        base = "abc" + "".join(r.choice("ab c") for _ in range(r.choice([2, 5, 9, 20, 40, 90]))).replace("  ", " ").rstrip()
        for _ in range(4):
            k = r.randrange(3, len(base) + 1)
            names.append((base[:k] + r.choice(["", "b", "x", "cc"]) + base[k + r.choice([0, 1]) :]).strip())
    groups = [(i, r.choice(["person", "topic"]), " ".join(n.split())) for i, n in enumerate(names)] + [(900, "person", "abc 12"), (901, "person", "abc")]
    df = spark.createDataFrame(groups, "gid long, entity_type string, canonical_name string")
    got = [tuple(x) for x in resolve.similar_pairs(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_similar(groups, threshold)


MAILS = [
    ("box/a/1", "Message-ID: <1>\r\nFrom: A@X.com \r\nTo: b@x.com,\r\n C@x.com, ,\r\nSubject: FW: hi\r\nDate: Mon, 14 May 2001 16:39:00 -0700 (PDT)\r\n\r\nbody\r\n\r\nmore"),
    ("box/a/2", "Message-ID: <2>\nFrom: a@x.com\nSubject: fw: none\nDate: nonsense\n\n"),
    ("box/a/3", "Message-ID: <3>\nSubject: Re: x\n\n--- Forwarded by"),
    ("box/a/4", None),
]


def test_mail(spark):
    got = {r["message_id"]: r for r in mail.parse_mail(spark.createDataFrame(MAILS, "file string, message string")).collect()}
    assert set(got) == {"<1>", "<2>", "<3>"}
    assert got["<1>"]["recipients"] == ["b@x.com", "c@x.com"] and got["<1>"]["sender"] == "a@x.com"
    assert str(got["<1>"]["date"]).startswith("2001-05-14 2") and got["<1>"]["body"] == "body\n\nmore" and got["<1>"]["is_forward"]
    assert not got["<2>"]["is_forward"] and got["<2>"]["body_hash"] == "" and got["<2>"]["date"] is None
    assert got["<3>"]["is_forward"] and got["<3>"]["is_reply"] and got["<3>"]["mailbox"] == "box"


def test_dedup_and_resume(spark):
    df = spark.createDataFrame([(1, "h"), (2, "h"), (3, ""), (4, "")], "id long, body_hash string")
    assert sorted(r["id"] for r in content.dedup(df).collect()) == [1, 3]
    assert sorted(map(tuple, content.duplicate_pairs(df).collect())) == [(2, 1), (4, 3)]
    assert content.not_done(df, spark.createDataFrame([(2,)], "id long"), "id").count() == 3


def mentions(spark, rows):
    return spark.createDataFrame([(i, f"a{i % 3}", n, t, al) for i, (n, t, al) in enumerate(rows)], "ord long, artifact_id string, name string, entity_type string, aliases array<string>")


def by_name(groups):
    return {r["canonical_name"]: r for r in groups.collect()}


def test_exact_pass(spark):
    g, n = resolve.exact_pass(mentions(spark, [("ann lee", "topic", None), ("Ann Lee", "person", ["AL", " "]), (" Ann Lee ", "person", []), ("B", "person", []), ("al", "person", [])]))
    got = by_name(g)
    assert set(got) == {"Ann Lee", "al"} and got["Ann Lee"]["aliases"] == ["AL", "ann lee"] and got["Ann Lee"]["entity_type"] == "person"
    assert {r["norm"]: r["gid"] for r in n.collect()} == {"ann lee": 0, "al": 4}


def test_alias_pass_is_a_star_to_the_first_holder(spark, ws):
    g, n = resolve.exact_pass(mentions(spark, [("Robert", "person", ["Bob"]), ("Bobby", "person", ["Bob"]), ("Bobo", "topic", ["Bob"])]))
    g, n = resolve.alias_pass(ws.save(g, "g"), ws.save(n, "n"), ws)
    got = by_name(g)
    assert set(got) == {"Robert", "Bobo"} and got["Robert"]["mention_count"] == 2
    # After a merge the group whose first member comes last has an ambiguous alias.
    assert {r["norm"]: r["gid"] for r in n.collect()}["bob"] == 2


def test_map_stays_without_a_merge(spark, ws):
    g, n = resolve.exact_pass(mentions(spark, [("Robert", "person", ["Bob"]), ("Bobo", "topic", ["Bob"])]))
    g, n = resolve.alias_pass(ws.save(g, "g"), ws.save(n, "n"), ws)
    assert {r["norm"]: r["gid"] for r in n.collect()}["bob"] == 0


def test_fuzzy_pass(spark, ws):
    rows = [("Chris Foster", "person", []), ("Chris Foster Jr", "person", []), ("Jonathan Smithe", "person", []), ("Jonathan Smith", "person", []), ("smith jonathan", "person", []), ("12345", "person", []), ("12346", "person", [])]
    g, n = resolve.exact_pass(mentions(spark, rows))
    g, _ = resolve.fuzzy_pass(ws.save(g, "g"), ws.save(n, "n"), ws)
    assert set(by_name(g)) == {"Chris Foster Jr", "Jonathan Smithe", "smith jonathan", "12345", "12346"}


def test_consolidate(spark, ws):
    g, n = resolve.exact_pass(mentions(spark, [("Ann", "person", []), ("Bob", "person", [])]))
    raw = spark.createDataFrame([(0, "a", None, "decided", "Ann", "Bob", "first", "x", 0.6), (1, "a", None, "decided", "ann", "bob", "second", "y", 0.9), (2, "a", None, "decided", "Ann", "", None, "z", 0.5), (3, "a", None, "decided", "Nobody", "Bob", None, "", 0.5), (4, "a", None, "decided", "Ann", "Nobody", None, "", 0.5)], "ord long, artifact_id string, date string, claim_type string, subject string, object string, detail string, excerpt string, confidence double")
    got = {(r["subject_name"], r["object_name"]): r for r in resolve.consolidate(raw, n, g).collect()}
    assert set(got) == {("Ann", "Bob"), ("Ann", "Ann")}
    r = got["Ann", "Bob"]
    assert r["detail"] == "first" and r["confidence"] == 0.9 and [e["excerpt"] for e in r["evidence"]] == ["x", "y"]


NODES = [("a", "Alpha", "person", 5, ["Al"]), ("b", "Beta", "topic", None, None), ("c", "Alphabet", "topic", 2, []), ("d", "Delta", "topic", 1, []), ("e", "Eps", "topic", 1, []), ("z", "Zed", "topic", 1, [])]
EDGES = [("a", "b", "DECIDED", 0.9, 1), ("a", "b", "PART_OF", 0.8, 1), ("b", "c", "DECIDED", None, 1), ("c", "d", "DECIDED", 0.7, 1), ("b", "d", "DECIDED", 0.7, 2), ("e", "e", "DECIDED", 0.5, 1)]


@pytest.fixture(scope="module")
def kg(spark):
    return spark.createDataFrame(NODES, "id string, canonical_name string, entity_type string, mention_count long, aliases array<string>"), spark.createDataFrame(EDGES, "src string, dst string, rel_type string, confidence double, mention_count long")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_degrees_and_isolated(kg):
    nodes, edges = kg
    assert {r["id"]: r["degree"] for r in graph.degrees(edges).collect()} == {"a": 2, "b": 4, "c": 2, "d": 2, "e": 1}
    assert ids(graph.isolated(nodes, edges)) == ["z"]


def test_context_counts_self_loops_twice(kg):
    assert retrieval.entity_context(*kg, "e").first()["degree"] == 2
    assert retrieval.entity_context(*kg, "z").first()["degree"] == 0


def test_search_and_lookup(kg):
    nodes, _ = kg
    assert [r["id"] for r in retrieval.search(nodes, "AL").collect()] == ["a", "c"]
    assert [r["id"] for r in retrieval.search(nodes, "bet").collect()] == ["b", "c"]
    assert retrieval.by_name(nodes, "al").first()["rank"] == 2 and retrieval.by_name(nodes, "lph").first()["id"] == "a"
    with pytest.raises(retrieval.BadRequest):
        retrieval.search(nodes, "")


def test_circles(spark, kg):
    _, edges = kg
    at = lambda x: spark.createDataFrame([(x,)], "id string")
    assert [retrieval.circle(edges, at(x), 3) for x in "abcdez"] == [2, 2, 3, 3, 1, None]
    assert retrieval.circle(edges, at("c"), 2) is None


def test_neighbourhood(spark, kg):
    nodes, edges = kg
    at = lambda x: nodes.where(F.col("id") == x)
    assert ids(retrieval.neighbourhood(nodes, edges, at("a"), 1)[0]) == ["a", "b"]
    assert ids(retrieval.neighbourhood(nodes, edges, at("a"), 9)[0]) == ["a", "b", "c", "d"]
    assert ids(retrieval.neighbourhood(nodes, edges, at("z"), 2)[0]) == ["z"]
    assert ids(retrieval.neighbourhood(nodes, edges, at("a"), 0)[0]) == ["a"]
    assert ids(retrieval.neighbourhood(nodes, edges, at("a"), 2, cap=1)[0]) == ["a", "b"]


def test_paths(kg):
    assert [r["id"] for r in retrieval.shortest_path(*kg, "alpha", "delta").orderBy("step").collect()] == ["a", "b", "d"]
    assert retrieval.shortest_path(*kg, "alpha", "zed").count() == 0
    assert retrieval.shortest_path(*kg, "alpha", "delta", 1).count() == 0
    assert render.path_text(retrieval.shortest_path(*kg, "alpha", "beta")).first()["path"].startswith("**Alpha** (person) —[DECIDED]→ ")


def test_structured_query(kg):
    with pytest.raises(retrieval.BadRequest):
        retrieval.structured_query(*kg)
    with pytest.raises(retrieval.NotFound):
        retrieval.structured_query(*kg, entity="nobody")
    with pytest.raises(retrieval.BadRequest):
        retrieval.claims_by_type(*kg, "x' OR 1=1")
    assert retrieval.structured_query(*kg, entity="beta", claim_type="decided").count() == 3
    assert retrieval.structured_query(*kg, entity="beta", claim_type="decided", min_confidence=0.1).count() == 2
    assert [r["confidence"] for r in retrieval.structured_query(*kg, claim_type="decided").collect()].count(None) == 0


def test_greedy_cluster(spark):
    pairs = spark.createDataFrame([("a", "b", 50), ("b", "c", 9), ("a", "c", 3), ("a", "d", 5)], "a string, b string, score long")
    assert selection.greedy_cluster(pairs) == ["a", "b", "c"]
    assert selection.greedy_cluster(pairs.limit(0)) == []


def test_extractor_retries(spark):
    calls = []

    def flaky(_):
        import os

        return "no" if os.urandom(1) is None else '{"entities": [], "claims": []}'

    df = spark.createDataFrame([("1", "h\n\n" + "x" * 200), ("2", "h\n\nshort")], "id string, prompt string")
    got = {r["id"]: (r["attempts"], r["error"]) for r in extract.extract(df, flaky, retries=2, wait=lambda e, n: 0.0).collect()}
    assert got == {"1": (3, "empty"), "2": (1, None)} and not calls


def test_null_placeholders_and_styles(kg):
    nodes, edges = kg
    size = {r["id"]: r["size"] for r in render.nodes_interactive(nodes).collect()}
    assert size["b"] == 10 and size["a"] == 10
    assert min(r["width"] for r in render.edges_interactive(edges).collect()) >= 1


def test_service(spark, kg, tmp_path):
    service = GraphService(*kg)
    assert service.health()["status"] == "ok"
    s = service.stats().first()
    assert (s["total_nodes"], s["total_relationships"], s["isolated_nodes"]) == (6, 6, 1)
    assert s["node_types"] == {"topic": 5, "person": 1} and s["rel_types"] == {"DECIDED": 5, "PART_OF": 1} and s["top_connected"][0]["name"] == "Beta"
    service.stats().write.parquet(f"{tmp_path}/stats")
    stored = GraphService(kg[0].limit(0), kg[1].limit(0), f"{tmp_path}/stats")
    assert stored.overview().first()["nodes"] == 6 and GraphService(*kg, f"{tmp_path}/none").overview().first()["edges"] == 6
    assert graph.full_stats(kg[0].limit(0), kg[1].limit(0)).first()["total_nodes"] == 0
    assert [r["id"] for r in service.search("al").collect()] == ["a", "c"] and service.entity("al").first()["degree"] == 2
    assert service.path("alpha", "delta").count() == 3 and ids(service.neighbourhood("alpha", 1)[0]) == ["a", "b"]
    assert service.query(claim_type="part_of").count() == 1
    for call in (lambda: service.search("nobody"), lambda: service.entity("nobody"), lambda: service.path("alpha", "zed"), lambda: service.neighbourhood("nobody"), lambda: service.query("nobody")):
        with pytest.raises(retrieval.NotFound):
            call()
    with pytest.raises(retrieval.BadRequest):
        service.query()


def test_display_slices(kg):
    shown = retrieval.display(retrieval.entity_context(*kg, "b"), 1, 2).first()
    assert (shown["n_aliases"], shown["n_relationships"], len(shown["relationships"])) == (0, 4, 2)
    assert retrieval.display(retrieval.entity_context(*kg, "z")).first()["n_relationships"] == 0


def test_claims_that_are_skipped(spark):
    g, n = resolve.exact_pass(mentions(spark, [("Ann", "person", ["A."]), ("Ann", "person", []), ("Bob", "person", [])]))
    raw = spark.createDataFrame([(0, "a", "Ann", "Bob"), (1, "a", "Ann", ""), (2, "a", "Nobody", "Bob"), (3, "a", "Ann", "Nobody")], "ord long, artifact_id string, subject string, object string")
    assert tuple(resolve.skipped_claims(raw, n).first()) == (4, 2)
    assert [(r["canonical_name"], r["aliases"]) for r in resolve.top_entities(g, 1).collect()] == [("Ann", ["A."])]
    claims = spark.createDataFrame([("1", "decided", "x", "y"), ("2", "decided", "x", "gone"), ("3", "rules", "x", "y")], "id string, claim_type string, subject_id string, object_id string").withColumns({"confidence": F.lit(0.5), "mention_count": F.lit(1), "detail": F.lit(""), "evidence": F.array(F.struct(F.lit("e" * 300).alias("excerpt")))})
    nodes = spark.createDataFrame([("x",), ("y",)], "id string")
    assert tuple(graph.edge_counts(claims, nodes).first()) == (1, 1)
    assert [len(r["excerpts"][0]) for r in graph.edge_table(claims, nodes).collect()] == [200]


def test_network_map_and_headers(spark):
    raw = spark.createDataFrame([("m/1", "From: A@x.com\nTo: b@x.com, nobody\nCc: B@x.com ,c@x.com\nX-Origin: O\n\nhi"), ("m/2", "To: b@x.com\n\nno sender"), ("n/3", None)], "file string, message string")
    m = mail.parse_mail(raw)
    assert sorted(map(tuple, selection.network_edges(selection.network_rows(m)).collect())) == [("a@x.com", "b@x.com", 2), ("a@x.com", "c@x.com", 1)]
    assert [tuple(r) for r in selection.mailbox_counts(m).collect()] == [("m", 1, 1)]
    heads = {r["file"]: r for r in mail.header_projection(raw).collect()}
    assert heads["m/1"]["x_origin"] == "O" and heads["m/1"]["bcc"] == "" and heads["m/1"]["error"] is None and heads["n/3"]["error"] == "no message" and heads["n/3"]["from"] is None
    with pytest.warns(UserWarning):
        selection.trim_subset(m)


def test_waits_by_kind():
    assert [extract.wait_for("connection", 2), extract.wait_for("rate limit", 1), extract.wait_for("ValueError", 3)] == [5.0, 20.0, 8.0]


def test_claims_of_a_popular_name(spark):
    """A name that holds nearly all claims is split; null, empty and unknown names are told apart."""
    names = spark.createDataFrame([("ann", 1), ("bob", 2), ("cy", 3)], "norm string, gid long")
    odd = [(None, "Bob"), ("", "Bob"), ("Nobody", "Bob"), ("Cy", None), ("Cy", ""), ("Bob", "Nobody")]
    rows = [("Ann", "Bob" if i % 2 else "Cy", i) for i in range(500)] + [(*p, 500 + i) for i, p in enumerate(odd)]
    raw = spark.createDataFrame(rows, "subject string, object string, ord long")
    got = {r["ord"]: (r["s"], r["o"], r["skipped"]) for r in resolve.place_claims(raw, names).collect()}
    assert len(got) == 506
    assert all(got[i] == (1, 2 if i % 2 else 3, False) for i in range(500))
    assert [got[500 + i][2] for i in range(6)] == [True, True, True, False, False, True]
    assert got[503] == got[504] == (3, 3, False)
