"""Cases in which the llm operators once did less than the whole job."""

import gzip
import hashlib
import io
import json
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import bpe, exact_dedup, gif, jaccard_join, license_scan, packing, quality, sieve, tool_calls, url_filter, warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "base,target,want",
    [
        ("http://a/b/c/d?q#f", "g", "http://a/b/c/g"),
        ("http://a/b/c/d?q", "../g", "http://a/b/g"),
        ("http://a/b/c/d", "../../../g", "http://a/g"),
        ("http://a/b/c/d", "./", "http://a/b/c/"),
        ("http://a/b/c/d", "..", "http://a/b/"),
        ("http://a/b/c/d?q", "?id=3", "http://a/b/c/d?id=3"),
        ("http://a/b/c/d?q", "#x", "http://a/b/c/d?q"),
        ("http://a/b/c/d", "/x/./y/../z?u=../v", "http://a/x/z?u=../v"),
        ("http://a/b", "/go?u=http://x", "http://a/go?u=http://x"),
        ("http://a", "g", "http://a/g"),
        ("http://a?q=/b/", "g", "http://a/g"),
        ("https://a/b", "//c/d", "https://c/d"),
        ("http://a/b", " HTTP://c/d ", "HTTP://c/d"),
        ("http://a/b", "mailto:x@y", None),
        ("no scheme", "g", None),
    ],
)
def test_targets_are_resolved(base, target, want):
    assert url_filter.resolve_target(base, target) == want


def test_entities_of_attributes():
    assert url_filter.decode_entities("?a=1&amp;b=2&#38;c&#x3D;3&copy=4&d=5&eacute;") == "?a=1&b=2&c=3&copy=4&d=5é"


def test_all_targets_of_a_page():
    html = '<base href="/r/"><link href=one rel="x canonical"><LINK REL=\'canonical\' data-href="no" href="a b>c"><meta http-equiv=refresh content="0; URL=\'two\'"><meta content="3;/three" http-equiv="Refresh"><meta http-equiv=refresh content=9>'
    assert sorted(url_filter.page_targets("http://h/p", html)) == ["http://h/r/a b>c", "http://h/r/one", "http://h/r/two", "http://h/three"]


def test_blocks_reach_aliases_by_any_link(spark):
    link = lambda u: f"<link rel=canonical href='{u}'>"
    rows = [
        (1, "http://a.org/d/p", link("page.html")), (2, "http://a.org/d/page.html", link("http://bad.com/en/1")),
        (3, "http://b.org/d/e/p", link("../x")), (4, "http://b.org/d/x", link("http://bad.com/en/1")),
        (5, "http://c.org/p?id=1", link("?id=3")), (6, "http://c.org/p?id=3", link("http://bad.com/en/1")),
        (7, "http://e.org/p", link("/go?u=http://x")), (8, "http://e.org/go?u=http://x", link("http://bad.com/en/1")),
        (9, "http://f.org/p", link("http://f.org/?x=1&amp;y=2")), (10, "http://f.org/?x=1&y=2", link("http://bad.com/en/1")),
        (11, "http://g.org/p", link("http://g.org/q") + link("http://bad.com/en/1")), (12, "http://h.org/p", link("http://h.org/q")),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES), url_filter.RULES).collect()}
    assert got == {i: "allow" if i == 12 else "block" for i in range(1, 13)}


def brute_levels(uses):
    """Level by call; null in circles and after them. One level a pass."""
    level = {}
    while ready := {c: max((level[u] + 1 for u in us if u in uses), default=0) for c, us in uses.items() if c not in level and all(u in level for u in us if u in uses)}:
        level |= ready
    return {c: level.get(c) for c in uses}


def test_calls_of_any_depth_have_levels(spark, ws):
    r = random.Random(4)
    talks = {1: {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(1500)}}
    talks[1] |= {"fork": ["c700", "c1499", "gone"], "x": ["y"], "y": ["x", "c3"], "after": ["x", "c9"]}
    talks[2] = {f"c{i}": [f"c{i - 1}"] * (i > 0) + [f"c{i - 5}"] * (i >= 5 and i % 20 == 0) for i in range(60)}
    for k in range(3, 11):
        talks[k] = {f"c{i}": [f"c{r.randrange(40 if r.random() < 0.03 else max(i, 1))}" for _ in range(r.choice([0, 1, 1, 1, 2]))] for i in range(40)}
        talks[k] = {c: [u for u in us if u != c] for c, us in talks[k].items()}
    df = ws.save(spark.createDataFrame([(k, c, us) for k, t in talks.items() for c, us in t.items()], "conv long, call_id string, uses array<string>"), "calls")
    got = tool_calls.order_calls(df, ws)
    assert got.schema["level"].dataType.simpleString() == "int"
    want = {(k, c): v for k, t in talks.items() for c, v in brute_levels(t).items()}
    assert {(x["conv"], x["call_id"]): x["level"] for x in got.collect()} == want and want[1, "fork"] == 1500 and None in want.values()


def test_rows_without_id_stay(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (None, "a", "x"), (None, "alone", "y"), (None, "alone", "z"), (None, None, "w"), (None, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == Counter([(1, "a"), (None, "alone"), (None, "")])
    near = jaccard_join.keep_one(df)
    assert near.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter((i, t) for i, t, _ in rows if i != 2)


def test_pages_without_id_have_records(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (None, "v", "same"), (None, "v", "own"), (None, "w", "own"), (None, None, None)]
    archives, _ = warc.archive_pages(spark.createDataFrame(rows, PAGES))
    got = warc.read_records(archives).collect()
    assert Counter((r["id"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in got) == Counter(
        [("1", "revisit", "2", None), ("2", "response", None, b"same"), (None, "revisit", "2", None), (None, "response", None, b"own"), (None, "response", None, b"own"), (None, "response", None, b"")]
    )


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_regions_of_thousands_recurse_and_are_split(spark, monkeypatch):
    """One passage in all texts: large regions, several rounds, leaves of many blocks."""
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    monkeypatch.setattr(jaccard_join, "PER_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PER_SALT", 4)
    monkeypatch.setattr(jaccard_join, "HELD_ROWS", 40)
    rounds = []
    look = jaccard_join.Join.look_at_pivots
    monkeypatch.setattr(jaccard_join.Join, "look_at_pivots", lambda self, *a: (rounds.append(1), look(self, *a))[1])
    r = random.Random(8)
    passage = words(r, 60)
    rows = [(k, " ".join(passage + words(r, r.choice([2, 3, 4, 5, 8, 12])))) for k in range(1200)]
    half = words(r, 40)
    for k in range(1200, 1500):  # ever fewer words of one text
        half = [w if r.random() > 0.01 else f"x{k}" for w in half]
        rows.append((k, " ".join(half)))
    got = jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for lo, hi in ((0, 1200), (1200, 1500)):
        for a in range(lo, hi):
            for b in range(lo, a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (p := root(a)) != (q := root(b)):
                    at[max(p, q)] = min(p, q)
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: root(i) for i in sets}
    assert len(rounds) >= 2


def test_the_sieve_lets_all_its_ids_pass(spark):
    ids = spark.range(-500, 100_000, 7).unionByName(spark.range(1 << 40, (1 << 40) + 50))
    held = sieve.sieve(ids)
    assert ids.where(sieve.passes(spark, held, "id")).count() == ids.count()
    assert spark.range(1 << 50, (1 << 50) + 20_000).where(sieve.passes(spark, held, "id")).count() < 20
    assert not sieve.sieve(ids.limit(0)).any()


def test_repeated_page_ids_keep_their_own_payloads(spark):
    rows = [(1, "u", "A"), (1, "u", "B"), (1, "u", "C"), (2, "u", "B"), (3, "u", "C"), (3, "u", "C")]
    archives, _ = warc.archive_pages(spark.createDataFrame(rows, PAGES))
    got = Counter((r["id"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in warc.read_records(archives).collect())
    assert got == Counter([("1", "response", None, b"A"), ("1", "revisit", "2", None), ("1", "revisit", "3", None), ("2", "response", None, b"B"), ("3", "response", None, b"C"), ("3", "response", None, b"C")])


def test_streams_are_inflated_in_small_pieces_and_must_be_whole():
    data = b"0" * 5_000_000 + bytes(range(256)) * 40
    one = gzip.compress(data)
    pieces = list(warc.inflate(io.BytesIO(one + gzip.compress(b"end")), 1000))
    assert b"".join(pieces) == data + b"end" and max(map(len, pieces)) <= 1000
    for cut in (len(one) - 1, len(one) // 2, 15):
        with pytest.raises(ValueError):
            list(warc.inflate(io.BytesIO(one[:cut]), 1000))


def call(i, n="search", a=None):
    return "<tool_call>" + json.dumps({"id": i, "name": n, "arguments": {"query": "q"} if a is None else a}) + "</tool_call>"


def result(i):
    return "<tool_result>" + json.dumps({"id": i, "content": 1}) + "</tool_result>"


TALK = "conv_id long, turn long, role string, text string"


def test_calls_of_null_and_repeated_messages_stay(spark):
    rows = [(None, 0, "assistant", call("a")), (1, None, "assistant", "x " + call("b")), (1, 1, "tool", result("b")), (1, 1, "tool", result("b")), (2, 0, "assistant", call("c") + result("c"))]
    got = tool_calls.format_messages(spark.createDataFrame(rows, TALK), tool_calls.SCHEMAS).collect()
    told = Counter((r["conv_id"], r["turn"], r["n_calls"], r["n_results"], r["n_linked"]) for r in got)
    assert told == Counter([(None, 0, 1, 0, 0), (1, None, 1, 0, 1), (1, 1, 0, 1, 1), (1, 1, 0, 1, 0), (2, 0, 1, 1, 2)])
    one = next(r for r in got if r["turn"] is None)
    assert json.loads(one["canonical"]) == {"content": "x ", "role": "assistant", "tool_calls": [{"status": "linked", "errors": [], "call": {"id": "b", "name": "search", "arguments": {"query": "q"}}}]}


def test_lone_surrogates_and_deep_bodies_do_not_stop_a_job(spark):
    odd = '<tool_call>{"id": "\\ud800", "name": "n\\udfff", "arguments": {"\\ud801": "${\\ud802}"}}</tool_call><tool_result>{"id": "\\ud800"}</tool_result>'
    deep = '<tool_call>{"id": "d", "name": "search", "arguments": ' + "[" * 5000 + "]" * 5000 + "}</tool_call>"
    got = tool_calls.format_messages(spark.createDataFrame([(1, 0, "assistant", odd), (1, 1, "assistant", deep), (1, 2, "x", "")], TALK), tool_calls.SCHEMAS).collect()
    by = {r["turn"]: r for r in got}
    assert by[0]["n_linked"] == 2 and json.loads(by[0]["canonical"])["tool_calls"][0]["call"]["id"] == "\ud800"
    assert json.loads(by[1]["canonical"])["tool_calls"][0]["status"] == "broken" and by[2]["canonical"] == '{"content":"","role":"x"}'


def test_random_talks(spark):
    """Status, partner and level of all blocks, against one pass over each conversation."""
    r = random.Random(6)
    rows = []
    for conv in range(30):
        for turn in range(r.randint(1, 8)):
            parts = [call(f"c{i}", a={"query": " ".join(f"${{c{r.randrange(10)}}}" for _ in range(r.choice([0, 0, 1, 2]))) or "q"}) if r.random() < 0.6 else result(f"c{i}") for i in (r.randrange(10) for _ in range(r.randint(0, 4)))]
            rows.append((conv, turn, "assistant", "hi " + "".join(parts)))
    rows += [(99, k, "assistant", call("hot") + result("hot")) for k in range(200)]
    want = {}
    blocks = {}
    for conv, turn, _, text in rows:
        for at, (kind, body) in enumerate(re.findall(r"<tool_(call|result)>(.*?)</tool_", text)):
            blocks.setdefault(conv, []).append((turn, at, kind, json.loads(body)))
    for conv, bs in blocks.items():
        first = {}
        for turn, at, kind, v in sorted(bs, key=lambda b: b[:2]):
            first.setdefault((kind, v["id"]), (turn, at, v))
        uses = {i: sorted(set(re.findall(r"\$\{(.*?)\}", json.dumps(v[2]["arguments"]))) - {i}) for (k, i), v in first.items() if k == "call"}
        level = brute_levels(uses)
        for turn, at, kind, v in bs:
            own, other = first[kind, v["id"]][:2], first.get(("result" if kind == "call" else "call", v["id"]))
            if own != (turn, at):
                status = "repeated"
            elif other is None:
                status = "unanswered" if kind == "call" else "orphan"
            else:
                status = "linked" if (own < other[:2]) == (kind == "call") else "early"
            want[conv, turn, at] = (status, other[0] if status == "linked" else None, level.get(v["id"]) if kind == "call" else None)
    got = {(x["conv"], x["turn"], x["at"]): (x["status"], x["partner_turn"], x["level"]) for x in tool_calls.link_calls(spark.createDataFrame(rows, TALK), tool_calls.SCHEMAS).collect()}
    assert got == want


def test_very_long_words(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    lib = Tokenizer.from_file(bpe.public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(1_000_000)), "-" * 200_000 + "=" * 3, "漢字かな交じり文" * 12_000, "ab" * 200 + " " + "z" * 256 + " " + "z" * 257, "x" * 100_000]
    tracemalloc.start()
    got = bpe.TrieEncoder(bpe.public_tokenizers.path("word_bpe_49k.json"))
    before = tracemalloc.get_traced_memory()[0]
    for t in texts:
        assert np.frombuffer(got.encode_batch([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert tracemalloc.get_traced_memory()[1] - before < 400e6
    tracemalloc.stop()


def plain_gif(data):
    """(delay, grey samples) of each frame, code by code and bit by bit."""
    at, out, delay = 13 + 3 * 256, [], 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delay = int.from_bytes(data[at + 4 : at + 6], "little")
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
            continue
        w, h, bits, stream = int.from_bytes(data[at + 5 : at + 7], "little"), int.from_bytes(data[at + 7 : at + 9], "little"), data[at + 10], b""
        at += 11
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        clear, number, pos, width = 1 << bits, int.from_bytes(stream, "little"), 0, bits + 1
        table, last, pixels = [], None, bytearray()
        while True:
            code = number >> pos & (1 << width) - 1
            pos += width
            if code == clear:
                table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, None
                continue
            if code == clear + 1:
                break
            now = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + now[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            pixels += now
            last = now
        assert len(pixels) == w * h
        out.append((delay, bytes(pixels)))
    return out


def test_media_bytes_and_features_by_a_plain_decoder(spark):
    r = random.Random(7)
    rows = [(1, "word " * 900), (2, None), (3, "".join(chr(r.randrange(32, 600)) for _ in range(30_000))), (4, "x" * 576)]
    stored = gif.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    media = {x["doc_id"]: bytes(x["media"]) for x in stored.collect()}
    for x in gif.stored_digests(stored).collect():
        data = media[x["doc_id"]]
        frames = plain_gif(data)
        payload = b"".join(p for _, p in frames)
        text = (dict(rows)[x["doc_id"]] or "").encode()
        assert payload == text + b"\xff" * (len(payload) - len(text)) and x["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert x["media_bytes"] == len(data) and x["media_sha256"] == hashlib.sha256(data).hexdigest()
        counts = ",".join(str(sum(p // 32 == k for p in payload)) for k in range(8))
        assert x["feature"] == f"frames={len(frames)};cs={sum(d for d, _ in frames)};r={counts};g={counts};b={counts}"


def test_many_rules_are_a_table(spark, monkeypatch):
    r = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", ""]
    rules = list({(h, p): url_filter.Rule(h, p, r.choice(["allow", "block"])) for h in hosts for p in ["", "/", "/en/", "/en/1", "/e"] if r.random() < 0.7}.values())
    urls = [f"http://{h}{p}" for h in ["a.com", "b.a.com", "c.b.a.com", "com", "x.org", "y.x.org", "xa.com", "net", "com."] for p in ["", "/", "/en/", "/en/12", "/e?q", "/f#/en/"]] + [None, "no scheme"]
    link = lambda u: f"<link rel=canonical href='{u}'>"
    rows = [(k, u, link(r.choice(urls[:-2])) if r.random() < 0.4 else None) for k, u in enumerate(urls * 2)]
    df = spark.createDataFrame(rows, PAGES)
    want = Counter(map(tuple, url_filter.judge_urls(df, rules).collect()))
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    assert Counter(map(tuple, url_filter.judge_urls(df, rules).collect())) == want


def test_random_alias_graphs(spark):
    r = random.Random(10)
    urls = [f"http://h{k}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es'])}/{r.randrange(12)}" for k in range(60)]
    rows = [(k, u, "".join(f"<link rel=canonical href='{r.choice(urls)}'>" for _ in range(r.choice([0, 0, 1, 2])))) for k, u in enumerate(urls)]
    at = list(range(len(urls)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for k, _, html in rows:
        for t in re.findall("href='(.*?)'", html):
            at[root(urls.index(t))] = root(k)

    def said(u):
        host, _, path = u[7:].partition("/")
        fits = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and ("/" + path).startswith(x.path)]
        return max(fits, key=lambda x: len(x.text)).verdict if fits else None

    want = {}
    for k, u in enumerate(urls):
        all_said = {said(v) for j, v in enumerate(urls) if root(j) == root(k)}
        want[k] = said(u) or ("allow" if "allow" in all_said else "block" if "block" in all_said else "allow")
    assert {x["page_id"]: x["verdict"] for x in url_filter.judge_urls(spark.createDataFrame(rows, PAGES), url_filter.RULES).collect()} == want


LONG = "doc_id long, text string, source string, hash string, row long, n long"


def test_very_long_texts(spark):
    """Texts of millions of characters, alone and as copies, beside short ones and clashing columns."""
    r = random.Random(12)
    long = " ".join(words(r, 300_000))
    rows = [(1, long), (2, long), (3, "short text"), (4, long[: len(long) // 2]), (5, long.upper() + " end"), (None, long)]
    df = spark.createDataFrame([(i, t, "s", "h", 1, 2) for i, t in rows], LONG)
    groups = {x["doc_id"]: (x["keep_id"], x["group_size"]) for x in exact_dedup.exact_groups(df).collect() if x["doc_id"]}
    assert groups == {1: (1, 3), 2: (1, 3), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    near = {x["doc_id"]: x["component_id"] for x in jaccard_join.near_components(df).collect() if x["doc_id"]}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    mit = license_scan.NOTICES["mit-permission"]
    found = license_scan.scan(spark.createDataFrame([(1, long + " " + mit + " " + long)], "doc_id long, text string"), license_scan.NOTICES).collect()
    assert [(x["doc_id"], x["license"]) for x in found] == [(1, "mit-permission")]
    model = quality.fit([("good words here " * 20, 1), ("%% $$ " * 40, 0)] * 6)
    assert quality.score_documents(df, model).count() == len(rows)
    pieces = packing.pack_documents(df, bpe.public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(x["length"] for x in pieces if x["doc_id"] == 3) == 3 and max(x["length"] for x in pieces) == 2048
    assert {x["start"] for x in pieces if x["doc_id"] == 1} == set(range(0, sum(x["length"] for x in pieces if x["doc_id"] == 1), 2048))
