"""Toxicity, mixing, pieces, top-k, URL filter, pages, tool calls and the pipeline."""

import json
import math
import random
import re
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from nodeloom.llm import html_extract, mixing, pieces, tool_calls, topk, toxicity, url_filter
from nodeloom.llm.common import table

SF = "/root/testdata/sf0.01"


# Toxicity.


def test_forward_backward():
    """Marginals and expected transitions against all paths of short chains, over column borders too."""
    rng = np.random.default_rng(2)
    n, first = 9, np.zeros(9, bool)
    first[[0, 4]] = True
    e, trans, start = rng.normal(size=n), rng.normal(size=(2, 2)), 0.7
    p, pair = toxicity._marginals(e, first, trans, start)
    total, mass, moves = 0.0, np.zeros(n), np.zeros((2, 2))
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        s = sum(e[i] * y[i] for i in range(n)) + sum(start * y[i] if first[i] else trans[y[i - 1], y[i]] for i in range(n))
        w = math.exp(s)
        total += w
        mass += w * np.array(y)
        for i in range(1, n):
            if not first[i]:
                moves[y[i - 1], y[i]] += w
    assert np.allclose(p, mass / total) and np.allclose(pair, moves / total)
    long_e, long_first = np.tile(e, 50), np.tile(first, 50)
    assert np.allclose(toxicity._marginals(long_e, long_first, trans, start)[0], np.tile(p, 50))


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF.replace("0.01", "0.1"), "documents"), table(spark, SF.replace("0.01", "0.1"), "labels")
    got = toxicity.op2_toxicity(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert got.count() == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "idiot " * 30_000, None), (None, "plain", "s"), (4, "Ä ß 漢", "s")], "doc_id long, text string, score string")
    labels = table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(docs, labels).collect()}
    assert len(got) == 5 and got[1]["score"] == got[2]["score"] and not got[None]["held_out"] and got[1]["spans"] == []
    none = toxicity.op2_toxicity(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns and toxicity.op2_toxicity(docs.limit(0), labels).count() == 0
    model = toxicity.fit(table(spark, SF, "documents"), labels)
    hit = toxicity.score(spark.createDataFrame([("the idiot said: idiot, trash and a worthless clown.",)], "text string"), model).first()
    raw = b"the idiot said: idiot, trash and a worthless clown."
    assert hit["score"] > 0.5 and b"idiot" in {raw[s["start"] : s["end"]] for s in hit["spans"]}


# Mixing.


def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 1, "c": 1000})
    assert got["a"] == 30 and got[None] == 3 and sum(got.values()) == pytest.approx(1111) and got["b"] == 300 and got["c"] == pytest.approx(778)
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0}
    exact = mixing.targets({"a": 600, "b": 600, "c": 600})
    assert [Fraction(exact[s]).limit_denominator(10) for s in "abc"] == [300, 600, 900]


def test_split_tree():
    q = np.array([100, 7, 0, 53])
    got = mixing.split_tree(q, 8, 1)
    assert (got.sum(axis=0) == q).all() and (got >= 0).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    assert (got == mixing.split_tree(q, 8, 1)).all()
    many = np.stack([mixing.split_tree(q, 2, s)[0] for s in range(400)])
    assert abs(many[:, 0].mean() - 50) < 1 and abs(many[:, 0].var() - 80 * (100 / 160) * (60 / 160) * (80 / 159)) < 3


def test_mix(spark):
    docs = table(spark, SF, "documents")
    got = mixing.op6_mixing(docs).collect()
    text = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    taken, target = {}, {}
    for r in got:
        t, s = text[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t)) and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
    assert all(abs(taken[s] - target[s]) <= max(20, 0.01 * target[s]) for s in target)
    again = mixing.op6_mixing(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_many_blocks(spark):
    """A source of many blocks: the digits' descent finds the quota; null source, null and empty texts; clashing names."""
    rows = [(i, "w " * (i % 50), "big" if i % 3 else None, "x") for i in range(6000)] + [(-1, None, "tiny", "x"), (-2, "", "tiny", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.op6_mixing(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["g"]) <= 50 for r in got) and {r["g"] for r in got if r["source"] == "tiny"} == {0.0}
    mix = mixing.take_mix(docs)
    assert mix.columns == docs.columns and mixing.op6_mixing(docs.limit(0)).count() == 0
    placed = mixing.mixed(docs, shards=4)
    assert placed.count() == mix.count() and placed.select("_shard").distinct().count() == 4
    where = placed.select("_shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted((r["_shard"], r["p"]) for r in where) == [(i, i) for i in range(4)]


def test_mix_shuffles_and_repeats(spark):
    """Within a shard, documents are not in the order they came in; rows of one id are taken together; '' and null are two ids."""
    docs = spark.createDataFrame([(i, "w w w", "s") for i in range(3000)], "doc_id long, text string, source string")
    ids = [r["doc_id"] for r in mixing.mixed(docs, shards=2).collect()]
    assert sorted(ids) == list(range(3000)) and ids != sorted(ids) and abs(np.corrcoef(ids, range(3000))[0, 1]) < 0.1
    rows = [("", "w " * 60, "a"), (None, "w " * 40, "a"), ("x", "w " * 50, "a"), ("x", "w " * 50, "a"), ("y", "long " * 100_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = mixing.op6_mixing(docs).collect()
    assert len({tuple(r["shards"]) for r in got if r["doc_id"] == "x"}) == 1 and len(got) == 5
    assert sum(r["taken"] for r in got) <= 3 * sum(r["size"] for r in got) and max(r["size"] for r in got) == 100_000
    many = mixing.mix_plan(docs, shards=None)
    assert many.shard_count == 16


# Pieces.


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    machine = pieces.transducer(pieces.model_bytes(spark.range(1), pieces.MODEL))
    rng = random.Random(6)
    letters = "aab eei   onrst dlyTHE\n\t.,!?0123éßñ漢字🙂\u3000\x00"
    texts = ["", " ", "  a", "Hello  world\n foo", "a" * 3000, "ing" * 500, "  " * 40 + "x"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    texts += [r["text"] for r in table(spark, SF, "documents").limit(150).collect()]
    for t in texts:
        ids = machine.encode(t)
        assert ids == sp.encode(t) and machine.decode(ids) == t
    assert machine.decode(machine.encode("a▁b ▁")) == "a▁b ▁"


def test_pieces_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "y" * 200_000, 1), (None, "▁ 🙂", 1)], "doc_id long, text string, token_ids int")
    got = {r["doc_id"]: r for r in pieces.op9_sentencepiece(docs).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and all(r["round_trip"] for r in got.values()) and len(got) == 4
    back = pieces.decoded(pieces.op9_sentencepiece(docs)).select("row.doc_id", "text").collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "", 2: "", 3: "y" * 200_000, None: "▁ 🙂"}
    assert pieces.op9_sentencepiece(docs.limit(0)).count() == 0


def test_unigram_shortest_path():
    """A unigram model's path is the cheapest of all segmentations."""
    names = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -1.2, 1), ("ba", -0.5, 1), ("aba", -2.5, 1), ("▁", -1.0, 1)]
    model = b""
    for name, score, kind in names:
        body = b"\x0a" + bytes([len(name.encode())]) + name.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind])
        model += b"\x0a" + bytes([len(body)]) + body
    model += b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x00\x20\x00"
    machine = pieces.Transducer(model)
    cost = {n: -s for n, s, k in names if k == 1}

    def best(t):
        return 0 if not t else min((cost[t[:n]] + best(t[n:]) for n in range(1, len(t) + 1) if t[:n] in cost), default=1e9)

    for t in ("abab", "babaab", "aaabbb", "abaaba"):
        assert sum(-machine.scores[i] for i in machine.encode(t)) == pytest.approx(best(t))
        assert machine.decode(machine.encode(t)) == t


# Top-k.


def test_topk_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 6)).astype(np.float32)
    v[::7] = v[0]  # ties
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6)]
    got = {}
    for r in topk.op10_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    w = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    for q in range(0, 700, 100):
        s = w @ w[q]
        want = sorted((-int(s[i]), i) for i in range(700) if i != q)[:10]
        assert [got[q][k] for k in range(1, 11)] == [(-a, b) for a, b in want]
    assert set(got) == set(range(0, 700, 100))


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    rows = rng.exponential(size=(20_000, 3)).astype(np.float64)
    order = np.argsort(rows, axis=0, kind="stable")
    lists = (order, np.take_along_axis(rows, order, axis=0))
    got, scored, stopped = topk.threshold_search(np.arange(20_000), rows, np.array([1.0, 2.0, -0.1]), -1, 5, *lists)
    s = rows @ np.array([1.0, 2.0, -0.1])
    assert [i for _, i in got] == np.argsort(-s)[:5].tolist() and scored < 10_000 and stopped
    some, fewer, stopped = topk.threshold_search(np.arange(20_000), rows, np.array([1.0, 2.0, -0.1]), -1, 5, *lists, floor=float(np.sort(s)[-3]))
    assert [i for _, i in some] == [i for _, i in got[:3]] and fewer <= scored and stopped
    assert topk.threshold_search(np.arange(4), rows[:4], np.zeros(3), 1, 2, *(x[:4] for x in (np.argsort(rows[:4], axis=0), np.sort(rows[:4], axis=0))))[0] == [(0, 0), (0, 2)]


def test_topk_in_blocks(spark):
    """Several row blocks with floors, repeated rows, ids with several vectors, clashing columns, other dimensions."""
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-20, 20, 5).tolist()) for i in rng.integers(0, 150, 400)]
    rows += rows[:60] + [(1, [3, 4]), (2, [5, 6]), (10, [1, 1]), (10, []), (20, [])]
    df = spark.createDataFrame([(*r, 7, 8, True) for r in rows], "id long, vector array<long>, ask long, score long, asked boolean")
    want = []
    for i, v in {(i, tuple(v)) for i, v in rows if i % 10 == 0}:
        near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))[:4]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(near, 1)]
    for r, q in ((10_000, 10_000), (40, 5), (3, 1000)):
        assert sorted(map(tuple, topk.top_k(df, F.col("id") % 10 == 0, 4, row_block=r, query_block=q).collect())) == sorted(want)


def test_topk_blocks_and_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, 4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    one, many = (sorted(map(tuple, topk.top_k(df, F.col("id") % 10 == 0, 3, row_block=r, query_block=q).collect())) for r, q in ((10_000, 10_000), (37, 7)))
    assert one == many and len(one) == 90
    assert topk.top_k(df.limit(0), F.col("id") == 0).count() == 0 and topk.top_k(df.where("id < 3"), F.col("id") == 0, 10).count() == 2


# URLs.


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1x?q#f", "https://example.org", "http://x.com/fr/?a", "http://x.com/de/y", "http://notexample.org/es/1", "http://example.org/es/1", "ftp://u:p@h.com:80/fr/a#b", "a://b://c/d", "http://x.com#/fr/", "http://É.com/fr/É"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.op7_url_filter(pages).collect()}
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"]) == url_filter._split(u or "")
    assert [got[i]["rule"] for i in (4, 5, 6, 7, 8, 9, 10, 12)] == ["example.org/en/1", None, "com/fr/", "com/de/", "org/", "example.org/es/", None, None]
    assert (got[4]["verdict"], got[6]["verdict"], got[7]["verdict"], got[8]["verdict"]) == ("block", "allow", "block", "allow")
    assert all(r["verdict"] in ("allow", "block") for r in got.values()) and url_filter.op7_url_filter(pages.limit(0)).count() == 0
    assert url_filter.allowed(pages).columns == pages.columns


def test_url_model(spark):
    weights, bias = url_filter.train()
    seen = spark.createDataFrame(url_filter.LABELLED, "url string, label int")
    got = url_filter.judged(seen, rules=[]).select("row.label", "verdict", "score", "row.url").collect()
    assert all((r["verdict"] == "block") == (r["label"] == 1) for r in got)
    for r in got:
        x = url_filter._buckets(*url_filter._split(r["url"]))
        assert r["score"] == pytest.approx(sum(weights[i] for i in x) / math.sqrt(len(x)) + bias)
    fresh = spark.createDataFrame([("http://casino.example.net/free/bonus", 1), ("https://library.example.net/en/history", 0)], "url string, label int")
    assert [r["verdict"] for r in url_filter.judged(fresh, rules=[], labelled=seen).collect()] == ["block", "allow"]


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></ul></nav><header><h2>Site</h2></header><!-- ad --><div class="ad-box">Buy</div><div id="cookieNotice">Cookies</div>
<div>Welcome to %s</div><div>Shared line</div><article><h1>Head &amp; more</h1><p><b>One   two
three<br>four<p>Shared line</p><p>&#233;&nbsp;x &lt;b&gt;</p><section class="comments"><p>Reader</p></section><form><p>Mail</p></form></article>
<aside><p>Side</p></aside><footer>&copy; Foot</footer></body></html>"""


def test_lines():
    got = html_extract.lines_of(PAGE % "A")
    assert [t for k, t in got if k == html_extract.ARTICLE] == ["Head & more", "One two three four", "Shared line", "é x <b>"]
    assert [t for k, t in got if k == html_extract.OPEN] == ["Welcome to A", "Shared line"]
    for bad in ("", "<", "<p", "a < b", "<p>x</div></p>", "<script>", "<a href='x>y</a>", "<!-- open", "<div><div><p>deep"):
        html_extract.lines_of(bad)
    assert html_extract.lines_of("a < b <i>c</i>") == [(0, "a < b c")]


def test_common_lines():
    rng = random.Random(8)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        for cells in (html_extract.CELLS, 4):  # 4: halved down to single lines
            got = html_extract.common_lines(a, b, cells)
            assert got == sorted(set(got)) and len(got) == longest(a, b)
            it = iter(b)
            assert all(a[i] in it for i in got)
    far = html_extract.common_lines(list(range(0, 60_000, 2)), list(range(0, 60_000, 3)))
    assert far == list(range(0, 30_000, 3))


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.net/p/{i}", PAGE % i) for i in range(9)] + [(90, None, None), (91, "x", ""), (92, "http://solo.net/", "<div>Alone</div>"), (90, "http://h0.net/p/1", PAGE % "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (2000, 2):
        got = html_extract.main_text(pages, carry=["page_id"], range_rows=size).select("row.page_id", "text").collect()
        text = {}
        for r in got:
            text.setdefault(r["page_id"], []).append(r["text"])
        assert text[0] == ["Welcome to 0\nHead & more\nOne two three four\nShared line\né x <b>"]
        assert sorted(text[90])[0] == "" and text[91] == [""] and text[92] == ["Alone"] and len(got) == 13
    assert html_extract.op5_html_extract(pages.limit(0)).count() == 0
    one = html_extract.op5_html_extract(pages).where("page_id = 92").first()
    assert (one["n_chars"], one["url"]) == (5, "http://solo.net/")


BARE = "<body><div>Menu</div><div>Links %s</div>%s<div>Foot</div></body>"


def bare(article):
    return BARE % ("here", "".join(f"<p>{x}</p>" for x in article.split()))


def test_pages_with_copies(spark):
    """Templates that markup does not declare go, whatever number of copies lies beside a page; texts of copies are equal."""
    rows = [(1, "http://h/a", bare("a1 a2")), (2, "http://h/a", bare("a1 a2")), (3, "http://h/a", bare("a1 a2")), (4, "http://h/b", bare("b1"))]
    rows += [(5, "http://k/a", bare("x")), (6, "http://k/z", bare("x")), (7, None, bare("n1")), (8, None, bare("n2"))]
    rows += [(100 + i, "http://hot/%d" % (i % 7), bare("c1 c2")) for i in range(300)] + [(900, "http://hot/9", bare("d1"))]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, key int")
    for part, size in ((1, 2000), (6, 2)):
        got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages.repartition(part), carry=["page_id", "text"], range_rows=size).select("row.page_id", "text").collect()}
        assert got[1] == got[2] == got[3] == "a1\na2" and got[4] == "b1" and got[7] == "n1" and got[8] == "n2"
        assert got[5] == got[6] == "Menu\nLinks here\nx\nFoot"  # copies only: nothing to compare with
        assert {got[100 + i] for i in range(300)} == {"c1\nc2"} and got[900] == "d1"
    long = spark.createDataFrame([(i, f"http://l/{i}", bare(" ".join(f"{'x' if j % 3 else i}{j}" for j in range(30_000)))) for i in range(2)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_extract.op5_html_extract(long).collect()] == [sum(len(str(j)) + 2 for j in range(0, 30_000, 3)) - 1] * 2


def test_page_differences(spark):
    """Pairs and deleted lines of random hosts against the definition: nearest other page by path, longest common subsequence."""
    rng = random.Random(21)
    rows = []
    for i in range(120):
        url = f"http://h{rng.randrange(4)}/{rng.choice('abc')}/{rng.choice('abcdef')}{rng.randrange(5)}"
        rows.append((i, url, "".join(f"<p>l{rng.randrange(9)}</p>" for _ in range(rng.randint(0, 9)))))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 120, 5)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), carry=["page_id"], range_rows=7).select("row.page_id", "text").collect()}
    stand, by_host = {}, {}
    for i, url, page in rows:
        host, path, lines = url.split("/")[2], url.split("/", 3)[3], re.findall("l\\d", page)
        if lines:
            key = (host, tuple(lines))
            stand[key] = min(stand.get(key, (path, i)), (path, i))
    for (host, lines), (path, i) in stand.items():
        by_host.setdefault(host, []).append((path, i, list(lines)))
    want = {}
    for host, pages in by_host.items():
        pages.sort()
        for n, (path, _, lines) in enumerate(pages):
            near = [pages[m] for m in (n - 1, n + 1) if 0 <= m < len(pages)]
            best = max(near, key=lambda p: html_extract._shared("/" + path, "/" + p[0]), default=None)
            gone = set(html_extract.common_lines([int(x[1]) for x in lines], [int(x[1]) for x in best[2]])) if best else set()
            want[host, tuple(lines)] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    for i, url, page in rows:
        lines = tuple(re.findall("l\\d", page))
        assert got[i] == (want[url.split("/")[2], lines] if lines else ""), (i, url)


# Tool calls.


def test_tool_calls(spark):
    call = lambda *cs: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "after": af} for i, n, a, af in cs]})
    turns = [
        ("c", 0, "user", "hi"), ("c", 1, "assistant", call(("x", "add", '{"b":2, "a":1}', []), ("y", "add", '{"a":"no"}', ["x"]), ("z", "add", "broken", ["y", "nope"]))),
        ("c", 2, "tool", json.dumps({"tool_call_id": "x", "content": "3"})), ("c", 3, "tool", json.dumps({"tool_call_id": "q", "content": "?"})),
        ("c", 4, "assistant", call(("x", "add", "{}", []), ("l1", "add", '{"a":1,"b":1.5}', ["l2"]), ("l2", "add", '{"a":1,"b":2,"c":3}', ["l1"]))), ("d", 0, "tool", json.dumps({"tool_call_id": "x", "content": "n"})),
        (None, 0, "assistant", None), ("e", 0, "assistant", "not json {"),
    ]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    got = tool_calls.linked(tool_calls.events_of_json(df), {"add": {"a": ("integer", True), "b": ("number", True)}}).collect()
    by = {(r["conv"], r["turn"], r["call_id"]): r for r in got}
    assert len(got) == 12
    assert [(by["c", 1, i]["level"], by["c", 1, i]["status"], by["c", 1, i]["valid"]) for i in "xyz"] == [(0, "answered", True), (2, "open", False), (4, "open", False)]
    assert by["c", 1, "x"]["json"] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add"}' and by["c", 1, "x"]["linked_turn"] == 2
    assert (by["c", 2, "x"]["status"], by["c", 2, "x"]["linked_turn"], by["c", 2, "x"]["level"]) == ("linked", 1, 1) and by["c", 3, "q"]["status"] == "orphan" and by["d", 0, "x"]["status"] == "orphan"
    assert by["c", 4, "x"]["status"] == "duplicate" and by["c", 4, "l1"]["status"] == "cyclic" and by["c", 4, "l1"]["level"] is None
    assert by["c", 4, "l1"]["valid"] is True and by["c", 4, "l2"]["valid"] is False
    assert by["c", 2, "x"]["json"] == '{"content":"3","role":"tool","tool_call_id":"x"}' and tool_calls.op4_tool_calls(df.limit(0)).count() == 0


def call_turn(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": "t", "arguments": a, "after": after} for i, a, after in calls]})


def test_tool_call_edges(spark):
    """Ties within a turn, repeated rows, null turns, long texts, clashing names, the empty table."""
    big = json.dumps({"text": "x" * 300_000})
    rows = [
        ("c", 0, "assistant", call_turn(("a", "{}", []), ("a", '{"k":1}', ["b"]), ("b", big, ["a"]))), ("c", 1, "assistant", call_turn(("b", "{}", []))),
        ("d", 0, "assistant", call_turn(("r", "{}", []))), ("d", 0, "assistant", call_turn(("r", "{}", []))), ("d", None, "assistant", call_turn(("r", "{}", []))), ("d", None, "tool", json.dumps({"tool_call_id": "r", "content": None})),
        ("n", None, "assistant", call_turn((None, "{}", []))), (None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id string, turn long, role string, text string, kind string, level string")
    for part in (1, 5):
        got = tool_calls.linked(tool_calls.events_of_json(df.repartition(part)), {}).collect()
        seen = sorted((r["conv"] or "", r["call_id"] or "", r["turn"] is None, r["turn"] or 0, r["status"], str(r["level"])) for r in got)
        assert seen == sorted([
            ("c", "a", False, 0, "open", "0"), ("c", "a", False, 0, "duplicate", "0"), ("c", "b", False, 0, "open", "2"), ("c", "b", False, 1, "duplicate", "2"),
            ("d", "r", False, 0, "answered", "0"), ("d", "r", False, 0, "answered", "0"), ("d", "r", True, 0, "duplicate", "0"), ("d", "r", True, 0, "linked", "1"),
            ("n", "", True, 0, "open", "0"), ("", "", True, 0, "message", "0"),
        ])
    assert max(len(r["json"]) for r in got) > 300_000 and {r["row"]["kind"] for r in got} == {"clash"}
    same = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 2, "user", "c"), (2, None, "user", "q")]
    got = tool_calls.op4_tool_calls(spark.createDataFrame(same, "conv_id long, turn long, role string, text string"))
    assert sorted(r["status"] for r in got.where("turn = 0").collect()) in (["answered", "answered", "duplicate"], ["answered", "duplicate", "duplicate"])
    assert got.where("turn = 2").first()["level"] == 2 and got.count() == 6
    assert "ShuffledHashJoin" in got._jdf.queryExecution().toString()


def test_tool_call_order(spark):
    """Levels of chains, diamonds, random graphs and cycles, against Kahn's rounds."""
    rng = random.Random(12)
    edges = {("chain", i): [i - 1] if i else [] for i in range(300)}
    for i in range(20):
        edges |= {("diamonds", 3 * i): [3 * i - 1] if i else [], ("diamonds", 3 * i + 1): [3 * i], ("diamonds", 3 * i + 2): [3 * i, 3 * i + 1]}
    for g in range(12):
        edges |= {(f"free{g}", v): [rng.randrange(v if rng.random() < 0.97 else 30) for _ in range(rng.choice([0, 1, 1, 2, 3]))] if v else [] for v in range(30)}
    edges |= {("loop", v): w for v, w in enumerate([[1], [0], [1], [], [3, 2], [3], [5, 3], [7]])}
    want = {}
    while ready := {k: max([want[k[0], w] + 1 for w in ws], default=0) for k, ws in edges.items() if k not in want and all((k[0], w) in want for w in ws)}:
        want |= ready
    rows = [(g, str(v), [str(x) for x in w]) for (g, v), w in edges.items()]
    got = tool_calls._levels(spark.createDataFrame(rows, "conv string, call_id string, after array<string>")).collect()
    assert {(r["conv"], int(r["call_id"])): r["level"] for r in got} == {k: want.get(k) for k, w in edges.items() if w}
    assert len(want) < len(edges) and want["chain", 299] == 299


# Repeated rows, clashing names, long texts and empty tables, for the operators that have no test of these above.


def test_toxicity_repeats(spark):
    """An id with several texts and labels, and rows in any order, give one model; equal texts have equal scores."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    docs = docs.unionByName(docs.where("doc_id < 40").withColumn("text", F.concat("text", F.lit(" more")))).withColumn("spans", F.lit("clash"))
    one, two = (toxicity.fit(docs.repartition(n), labels.unionByName(labels).repartition(n)) for n in (1, 3))
    assert np.array_equal(one.hashes, two.hashes) and np.array_equal(one.own, two.own) and np.array_equal(one.scale, two.scale)
    got = toxicity.score(docs, one, carry=["doc_id", "spans"])
    assert got.count() == docs.count() and got.select("row.spans").distinct().count() == 1
    few = toxicity.fit(docs, labels, sample_bytes=50_000)
    assert 0 < len(few.hashes) < len(one.hashes)


def test_whole_texts_are_fitted(spark):
    """A toxic word far behind 20,000 characters of a labelled text is learnt."""
    plain = "some quiet words of no harm at all " * 600
    rows = [(i, plain + (f"vilest grubnik {i}" if i % 2 else f"kindest friend {i}"), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.op2_toxicity(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_fitting_takes_little_memory(monkeypatch):
    """The driver keeps a number for each token, not its hashes: 64 MB of texts are to fit beside Spark."""
    rng = np.random.default_rng(5)
    y = np.arange(1200) % 2
    texts = [" ".join(f"word{w}" for w in rng.integers(0, 3000, 500)) + " vile" * int(t) for t in y]
    monkeypatch.setattr(toxicity, "STEPS", 2)
    tracemalloc.start()
    model = toxicity._fit(pa.chunked_array([texts[:700], texts[700:]]), y, {0: 600, 1: 600})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.hashes) > 3000 and model.scale.shape == (4,)
    assert peak < 80 * 600_000  # bytes


def test_urls_repeats(spark):
    long = "http://example.org/" + "a" * 2000
    pages = spark.createDataFrame([(1, long, "x", "y"), (1, long, "x", "y"), (2, None, None, None)], "page_id long, url string, verdict string, score string")
    got = url_filter.op7_url_filter(pages).collect()
    assert len(got) == 3 and {len(r["path"]) for r in got} == {2001, 0} and len({r["verdict"] for r in got if r["page_id"] == 1}) == 1


def test_pieces_repeats(spark):
    docs = spark.createDataFrame([(1, "one text", "x")] * 3 + [(1, "other", "x")], "doc_id long, text string, n_tokens string")
    got = pieces.op9_sentencepiece(docs).collect()
    assert len(got) == 4 and len({tuple(r["token_ids"]) for r in got}) == 2 and all(r["round_trip"] for r in got)


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, repeated and long rows, a clashing column, and the empty table, through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "c"), (2, "", "en", "s", 0, "c"), (3, "same words here " * 9, "en", "s", 1, "c"), (3, "same words here " * 9, "en", "s", 1, "c"), (4, "long " * 60_000, "en", "t", 1, None), (None, "no id at all but words", "en", "t", 1, "c")]
    for n, table_rows in enumerate((rows, [])):
        where = f"{tmp_path}/{n}"
        spark.createDataFrame(table_rows, schema).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        got = corpus_pipeline.run(spark, where).collect()
        assert all(r["round_trip"] for r in got) and (bool(got) == bool(table_rows))


# The pipeline.


def test_pipeline(spark):
    docs = table(spark, SF.replace("0.01", "0.001"), "documents")
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF.replace("0.01", "0.001"))
        if name != "encoding":
            assert out.columns == docs.columns
        seen.append(out.count())
        at = out
    assert seen[0] >= seen[1] >= seen[2] and seen[3] == seen[4] and at.where("not round_trip").isEmpty()
    ids = {r["doc_id"] for r in at.select("doc_id").collect()}
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
