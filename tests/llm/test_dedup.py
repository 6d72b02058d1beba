"""Exact and near deduplication, substring deduplication and union-find against brute force, with edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nodeloom.llm import exact_dedup, near_dedup, passages, textops, union_find

EDGE = "doc_id long, text string, keep_id string, kept string, row string"


def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    rows = [(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (None, "x y z w v u", "a", "b", "c"), (3, "long " * 50_000, None, None, None), (4, "long " * 50_000, "a", "b", "c"), (5, "same one", "a", "b", "c"), (5, "same one", "a", "b", "c")]
    return spark.createDataFrame(rows, EDGE)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def closed(nodes, links):
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def variants(seed, groups=3, each=40, edits=12):
    """Copies of base texts with random edits, many of which are only just near enough."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(each):
            x = list(base)
            for _ in range(rng.randint(0, edits)):
                i, r = rng.randrange(len(x)), rng.random()
                if r < 0.6:
                    x[i] = rng.choice(words)
                elif r < 0.8:
                    x.insert(i, rng.choice(words))
                else:
                    del x[i]
            out.append(" ".join(x))
    rng.shuffle(out)
    return list(enumerate(out))


def test_exact_edges(spark):
    docs = edge_docs(spark)
    got = {r["doc_id"]: r for r in exact_dedup.op1_exact_dedup(docs).collect()}
    assert (got[1]["keep_id"], got[1]["kept"], got[2]["kept"], got[2]["group_size"]) == (2, False, True, 2)
    assert (got[3]["keep_id"], got[4]["kept"], got[5]["group_size"], got[5]["kept"]) == (4, True, 2, True)
    assert got[None]["keep_id"] is None and got[None]["kept"] and got[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "5", "5", "None"]
    assert exact_dedup.op1_exact_dedup(docs.limit(0)).count() == 0


def test_exact_compares_content(spark):
    """With a digest that everything shares, texts are still told apart, hot or not."""
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, carry=["doc_id"], digest=lambda t: F.lit("d")).select("row.doc_id", "keep_id", "group_size").collect()
    assert len(got) == 300 and all(r["keep_id"] == 297 + r["doc_id"] % 3 and r["group_size"] == 100 for r in got)


def test_near_brute_force(spark):
    rows = variants(1)
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(sets, links)
    got = {r["doc_id"]: r for r in near_dedup.op3_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert len(set(want.values())) > 10  # the case is a hard one


def test_prefix_buckets_are_lossless(spark):
    rows = variants(2, 2, 30)
    sets = {i: shingles(t, 5) for i, t in rows}
    texts = spark.createDataFrame(rows, "id long, text string")
    keys = defaultdict(set)
    for r in near_dedup.prefix_buckets(texts, 5, 80)[0].collect():
        keys[r["id"]].add(r["key"])
    for a in sets:
        for b in sets:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a] != sets[b]:
                assert keys[a] & keys[b]


def test_near_edges(spark):
    docs = edge_docs(spark)
    got = {r["doc_id"]: r for r in near_dedup.op3_near_dedup(docs).collect()}
    assert (got[1]["n_shingles"], got[1]["component_id"], got[2]["component_id"], got[2]["kept"]) == (0, 1, 2, True)
    assert (got[4]["component_id"], got[4]["n_shingles"], got[3]["kept"], got[None]["component_id"]) == (3, 1, True, None)
    assert (got[5]["n_shingles"], got[5]["component_id"]) == (1, 5)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "5", "None"]
    assert near_dedup.op3_near_dedup(docs.limit(0)).count() == 0


def test_near_bucket_of_two(spark):
    """A < C < B share bands by twos only, B fewer with A than with C: B meets C first, and A by its own bucket."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(w) for w in (base[58:], base[:-58], base)]
    ((_, n, of, got),) = textops.shingle_sets(pa.array(texts), 4)
    a, c, b = (set(x.tolist()) for x in textops.band_keys(textops.super_min_hash(of, got, n, 160), 32, 5))
    assert 0 < len(a & b) < len(c & b) and not a & c
    got = near_dedup.op3_near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 0}


def test_near_chains(spark):
    """Triples A < C < B in which B is near both others, or just not, against brute force."""
    rng = random.Random(31)
    texts = []
    for t in range(700):
        base = [f"t{t}w{i}" for i in range(rng.choice([60, 150, 420]))]
        cuts = [rng.choice([0.05, 0.09, 0.1, 0.11, 0.12]) for _ in range(2)]
        one, two = base[int(cuts[0] * 2 * len(base)) :], base[: len(base) - int(cuts[1] * 2 * len(base))]
        if t % 2:
            one, two = list(base), list(base)
            for x, c in zip((one, two), cuts, strict=True):
                for i in rng.sample(range(len(x)), max(1, int(c * len(x) / 4))):
                    x[i] = f"x{rng.random()}"
        texts += [" ".join(x) for x in (one, two, base)]
    want, hard = {}, 0
    for i in range(0, len(texts), 3):
        sets = {j: shingles(texts[j], 4) for j in range(i, i + 3)}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        hard += set(links) == {(i, i + 2), (i + 1, i + 2)}
        want |= closed(sets, links)
    got = near_dedup.op3_near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and hard > 50


def test_super_min_hash_in_parts(monkeypatch):
    """Elements of one document in several parts give the signature of all of them."""
    docs, got = np.repeat([0, 1, 2], [500, 3, 900]), textops.mix(np.arange(1403, dtype=np.uint64))
    whole = textops.super_min_hash(docs, got, 4, 160)
    monkeypatch.setattr(textops, "SKETCH_ROWS", 101)
    assert (textops.super_min_hash(docs, got, 4, 160) == whole).all()


def test_super_min_hash():
    """Places agree as often as sets do; each element's ranks are a permutation; empty sets give no value."""
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    docs = np.repeat([0, 1], 900)
    got = textops.super_min_hash(docs, textops.mix(np.concatenate([a, b])), 3, 160)
    assert abs((got[0] == got[1]).mean() - 0.8) < 0.1 and (got[2] == ~np.uint64(0)).all()
    one = textops.super_min_hash(np.zeros(1, np.int64), np.ones(1, np.uint64), 1, 64)[0]
    assert sorted((one >> np.uint64(48)).tolist()) == list(range(64))


def test_words_and_shingles():
    texts = pa.array(["A b\tC\n  d e", None, "", "x", "É é A\u00a0b c d", "a b c d a b c d"])
    for first, n, docs, _ in textops.shingle_sets(texts, 4):
        assert first == 0 and np.bincount(docs, minlength=n).tolist() == [len(shingles(t, 4)) for t in texts.to_pylist()]


def test_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(180)] + [(i, i + 1) for i in range(300, 360)]
    want = closed(range(361), links)
    df = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in union_find.components(df).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in touched}
    assert union_find.components(df.limit(0)).count() == 0


def passage_docs():
    rng = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    common, other = draw(60), draw(80)
    docs = [draw(rng.randint(20, 200)) for _ in range(40)]
    for i in (3, 9, 17, 30):
        at = rng.randrange(len(docs[i]))
        docs[i] = docs[i][:at] + common + docs[i][at:]
    near = list(other)
    near[40] = "changed"
    docs[5] += other
    docs[21] = near + docs[21]
    docs[12] += draw(10) + common[:30]  # too short a repeat
    docs[33] = ["same"] * 300
    docs[34] = docs[34] + ["same"] * 120
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_passages(spark):
    df = spark.createDataFrame(passage_docs(), "doc_id long, text string")
    got = passages.op8_substring_dedup(df).collect()
    pairs = {(r["doc_id"], r["with_id"]) for r in got}
    assert pairs >= {(9, 3), (17, 3), (30, 3), (21, 5)} and not any(12 in p for p in pairs)
    assert {x for p in pairs for x in p} <= {3, 5, 9, 17, 21, 30, 33, 34}
    text = {i: t.split() for i, t in passage_docs()}
    for r in got:
        if r["doc_id"] in (9, 17, 30):
            assert r["similarity"] == 1.0 and r["class_id"] == 3 and r["end_word"] - r["start_word"] >= 60
            assert text[r["doc_id"]][r["start_word"] : r["end_word"]] == text[3][r["with_start"] : r["with_end"]]
    clean = {r["doc_id"]: r["text"].split() for r in passages.without_repeats(df).collect()}
    assert clean[3] == text[3] and clean[12] == text[12] and len(clean[9]) == len(text[9]) - 60
    assert all(w in text[9] for w in clean[9])


def test_passages_beside_the_centre(spark):
    """Links of d2 and d3 where both (or d3 only) are in the groups of an earlier d1."""
    rng = random.Random(10)
    draw = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts, want = [], set()
    for _ in range(30):  # d1 and d2 are near d3 and not near each other
        base = draw(100)
        d1, d2 = list(base), list(base)
        d1[25], d1[75], d2[0], d2[50], d2[99] = draw(5)
        texts += [d1, d2, base]
        want |= {(len(texts) - 1, len(texts) - 3), (len(texts) - 1, len(texts) - 2)}
    for _ in range(30):  # d2 and d3 are equal, d1 is not near enough
        base = draw(50)
        d1 = list(base)
        d1[24], d1[25] = draw(2)
        texts += [d1 + draw(20), base + draw(20), base + draw(20)]
        want.add((len(texts) - 1, len(texts) - 2))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r["b"], r["a"]) for r in passages.repeated_passages(df).collect()} == want


def test_passages_that_two_functions_agree_on(spark):
    rng = random.Random(11)
    draw = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for _ in range(300):
        base = draw(50)
        texts += [base, base[:24] + draw(1) + base[25:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
    keys = defaultdict(set)
    for out in passages._window_keys(5, 46)(iter([batch])):
        for key, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            keys[i].add(key)
    two = {(i + 1, i) for i in range(0, 600, 2) if len(keys[i] & keys[i + 1]) == 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["b"], r["a"]) for r in passages.repeated_passages(df).collect()}
    assert two and two <= got and passages.HITS == 2


def test_passages_against_all_pairs(spark):
    """Passages that repeat with edits, beside a sentence that half of the texts hold, copies and repeated words: all pairs by brute force."""
    rng = random.Random(17)
    draw = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    sentence, texts = draw(13), []
    for _ in range(70):
        base = draw(rng.choice([50, 55, 70, 120, 250]))
        for _ in range(rng.randint(2, 7)):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, len(base) // 50, len(base) // 25])):
                i = rng.randrange(len(x))
                x[i : i + 1] = rng.choice([draw(1), [], draw(2)])
            texts.append(draw(rng.randint(0, 60)) + x + (sentence if rng.random() < 0.5 else []) + draw(rng.randint(0, 60)))
    texts += [["the"] * rng.randint(40, 120) + draw(5) for _ in range(20)] + [list(texts[rng.randrange(100)]) for _ in range(30)]
    rng.shuffle(texts)
    batch = pa.array([" ".join(t) for t in texts])
    ((_, n, data, at),) = textops.blocks(batch)
    docs, got = passages._ordered(data, at, n, 5)
    ends = np.searchsorted(docs, np.arange(n + 1))
    seq = [got[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
    holders = defaultdict(set)
    for i, x in enumerate(seq):
        for h in set(x.tolist()):
            holders[h].add(i)
    near = {(i, j) for held in holders.values() if len(held) < 300 for i in held for j in held if i < j}
    truth = [(i, j) for i, j in near if passages.shared_passages(seq[i], seq[j], 46, 80)]
    rows = passages.op8_substring_dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    found = closed(range(n), {(r["doc_id"], r["with_id"]) for r in rows})
    assert len(truth) > 400 and np.mean([found[i] == found[j] for i, j in truth]) >= 0.99
    assert all(passages.shared_passages(seq[r["with_id"]], seq[r["doc_id"]], 46, 80) or texts[r["with_id"]] == texts[r["doc_id"]] for r in rows)
    later = {j for _, j in truth}
    assert len(later - {r["doc_id"] for r in rows}) <= 0.01 * len(later)


def test_passages_of_many_variants(spark, monkeypatch):
    """Variants of one text need not be linked in all pairs, and have the classes of all pairs; in small buckets and blocks, too."""
    rng = random.Random(23)
    draw = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(3):
        base = draw(200)
        for _ in range(40):
            x = list(base)
            for i in rng.sample(range(200), 8):
                x[i] = draw(1)[0]
            texts.append(x)
    texts += [[w for w in rng.sample(["the", "and", "of", "in", "to", "was"], 4) for _ in range(rng.randint(25, 70))] for _ in range(40)]
    rng.shuffle(texts)
    ((_, n, data, at),) = textops.blocks(pa.array([" ".join(t) for t in texts]))
    docs, got = passages._ordered(data, at, n, 5)
    ends = np.searchsorted(docs, np.arange(n + 1))
    seq = [got[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
    truth = {(j, i) for j in range(n) for i in range(j) if passages.shared_passages(seq[i], seq[j], 46, 80)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for bucket, block in ((passages.BUCKET, passages.BLOCK), (1000, 7)):
        monkeypatch.setattr(passages, "BUCKET", bucket)
        monkeypatch.setattr(passages, "BLOCK", block)
        links = {(r["b"], r["a"]) for r in passages.repeated_passages(df).collect()}
        assert links <= truth and closed(range(n), links) == closed(range(n), truth)
        assert {j for j, _ in links} == {j for j, _ in truth}
        assert bucket == 1000 or 5 * len(links) < 4 * len(truth)


def test_sequences_made_ready():
    """What is sorted once for a text serves all its comparisons, with the same passages, repeated shingles or not."""
    rng = np.random.default_rng(8)
    seq = [rng.integers(0, high, 300).astype(np.uint64) for high in (1 << 40, 90, 20)]
    seq += [np.concatenate([s[40:120], rng.integers(0, 1 << 40, 60).astype(np.uint64), s[:200], s[40:120]]) for s in seq]
    ready = [passages._ready(s) for s in seq]
    plain = {(i, j): passages.shared_passages(seq[i], seq[j], 46, 80) for i in range(6) for j in range(6)}
    assert sum(map(bool, plain.values())) > 6  # others than each with itself
    assert all(passages.shared_passages(seq[i], seq[j], 46, 80, None, None, ready[i], ready[j]) == found for (i, j), found in plain.items())
    empty = np.zeros(0, np.uint64)
    assert passages.shared_passages(seq[0], empty, 46, 80, None, None, ready[0]) == passages.shared_passages(empty, seq[0], 46, 80, None, None, None, ready[0]) == []


def test_settled_links_add_to_what_is_known():
    """Of many variants of a text, only links that cover a place first, or join classes; with the classes and places of all pairs."""
    rng = random.Random(31)
    draw = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = draw(300), []
    for _ in range(80):
        x = list(base)
        for i in rng.sample(range(300), 9):
            x[i] = draw(1)[0]
        texts.append(x)
    ids, n = pa.array(range(80)), 80
    batch = pa.RecordBatch.from_arrays([ids, pa.array([" ".join(t) for t in texts])], ["id", "text"])
    keys = pa.Table.from_batches(list(passages._window_keys(5, 46)(iter([batch]))))
    windows = keys.append_column("block", pa.array([-1] * len(keys))).append_column("cell", pa.array([0] * len(keys)))
    ((_, _, data, at),) = textops.blocks(batch.column(1))
    docs, got = passages._ordered(data, at, n, 5)
    seq = [got[docs == i] for i in range(n)]
    none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))
    stretches = [[[0]] * n, [[len(x)] for x in seq], pa.array([x.view(np.int64).tolist() for x in seq], pa.list_(pa.int64()))]
    out = passages._settle(5, 46, 80)(windows, pa.table([ids, *map(pa.array, stretches[:2]), stretches[2], *none, ids], passages.SETTLED_TEXT)).to_pylist()
    truth = {(i, j): passages.shared_passages(seq[i], seq[j], 46, 80) for j in range(n) for i in range(j)}
    links = {(r["b"], r["a"]) for r in out}
    assert closed(range(n), links) == closed(range(n), {(j, i) for (i, j), found in truth.items() if found})
    places = [set(), set()]
    for (_, j), found in truth.items():
        places[0] |= {(j, x) for _, _, lo, hi, _ in found for x in range(lo, hi)}
    for r in out:
        places[1] |= {(r["b"], x) for x in range(r["b_start"], r["b_end"] - 4)}
    assert places[1] <= places[0] and len(places[1]) >= 0.99 * len(places[0]) and len(out) <= 8 * n < 2000 < sum(map(len, truth.values()))


def test_possible_places():
    """No place of a passage is ruled out, repeated shingles or not; two unlike texts have none."""
    rng = np.random.default_rng(12)
    seen = 0
    for high in (1 << 40, 90, 30):
        for _ in range(40):
            a = rng.integers(0, high, rng.integers(60, 300)).astype(np.uint64)
            b = np.concatenate([rng.integers(0, 1 << 40, 30).astype(np.uint64), a[rng.integers(0, 20) :], rng.integers(0, 1 << 40, 9).astype(np.uint64)])
            b[rng.integers(0, len(b), rng.integers(0, 25))] = 7
            masks = [passages._possible(np.isin(x, y)[None, :], (passages._before(None, x) >= 0)[None, :], np.zeros(len(x), int), np.arange(len(x)), 46, 80) for x, y in ((a, b), (b, a))]
            for lo, hi, blo, bhi, _ in passages.shared_passages(a, b, 46, 80):
                seen += 1
                assert masks[0][0][lo:hi].all() and masks[1][0][blo:bhi].all() and (masks[0][1][lo:hi].all() or masks[1][1][blo:bhi].all())
    x = np.arange(100)
    assert seen > 50 and not passages._possible(x[None, :] % 2 == 0, np.zeros((1, 100), bool), 0 * x, x, 46, 80)[0].any()
    assert len(passages._possible(np.ones((1, 9), bool), np.zeros((1, 9), bool), x[:9] * 0, x[:9], 46, 80)[0]) == 9


def test_passage_parts():
    """Windows of a group that a link holds on either side are one part, as are those with one partner outside."""
    key = np.array([0, 0, 0, 1, 1, 2, 2])
    text, at = np.array([0, 1, 2, 0, 1, 1, 2]), np.array([10, 10, 10, 90, 95, 50, 50])
    child, to = np.array([1, 2]), np.array([0, 0])
    spans = np.array([[0, 60, 0, 92], [40, 60, 0, 20]])  # text 2's holds the place of group 0 in text 0 only
    assert passages._parts(key, text, at, child, to, spans).tolist() == [0, 0, 0, 3, 3, 5, 5]
    assert passages._parts(key, text, at, child, to, spans - [[0, 0, 0, 3], [0, 0, 0, 10]]).tolist() == [0, 0, 2, 3, 4, 5, 5]


def test_passage_places(spark):
    """Each place of a passage that a text holds several times is found."""
    rng = random.Random(5)
    draw = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    p = draw(60)
    texts = [draw(30) + p + draw(30), draw(10) + p + draw(40) + p + draw(40) + p, p + draw(70) + p]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["b"], r["b_start"], r["b_end"]) for r in passages.repeated_passages(df).collect()}
    assert got >= {(1, 10, 70), (1, 110, 170), (1, 210, 270), (2, 0, 60), (2, 130, 190)}
    clean = {r["doc_id"]: len(r["text"].split()) for r in passages.without_repeats(df).collect()}
    assert clean == {0: 120, 1: 90, 2: 70}


def test_passage_edges(spark):
    docs = edge_docs(spark)
    got = passages.op8_substring_dedup(docs).collect()
    assert {(r["doc_id"], r["with_id"]) for r in got} == {(4, 3)}
    assert passages.without_repeats(docs).columns == docs.columns and passages.op8_substring_dedup(docs.limit(0)).count() == 0


def test_surroundings():
    """Different shingles around each place, and of the poorest window that holds it."""
    rng = np.random.default_rng(0)
    run, got = np.repeat([0, 1, 2, 3], [100, 60, 80, 9]), rng.integers(0, 30, 249).astype(np.uint64)
    before, node, n = passages._before(run, got), np.arange(249), 249
    low = passages._poorest(run, before, node, 46)
    count, fresh, _ = passages._surroundings(run, got, before, node, 57)
    for i in range(n):
        windows = [len(set(got[s : s + 46].tolist())) for s in range(max(0, i - 45), i + 1) if s + 46 <= n and run[s] == run[s + 45]]
        near = [j for j in range(max(0, i - 57), min(n, i + 58)) if run[j] == run[i]]
        assert (low[i], count[i], fresh[i]) == (min(windows, default=0), len(near), len(set(got[near].tolist())))


def test_compact_windows():
    """Each sliding window's minimum is the node of the compact window that holds it."""
    rng = np.random.default_rng(1)
    docs = np.repeat([0, 1, 2], [100, 7, 60])
    got = rng.integers(0, 2**63, len(docs)).astype(np.uint64)
    node, first, last = passages.compact_windows(docs, got, 0, 10)
    value = textops.mix(got ^ passages._FUNCTION[0]) & ~passages._INDEX
    starts = [i for i in range(len(docs) - 9) if docs[i] == docs[i + 9]]
    cover = {i: c for c, lo, hi in zip(node, first, last, strict=True) for i in range(lo, hi - 8)}
    assert sorted(cover) == starts and all(cover[i] == i + int(np.argmin(value[i : i + 10])) for i in starts)


def test_reruns_agree(spark):
    df = spark.createDataFrame(variants(3, 1, 20), "doc_id long, text string")
    for query in (exact_dedup.op1_exact_dedup, near_dedup.op3_near_dedup, passages.op8_substring_dedup):
        a, b = (sorted(map(str, query(df.repartition(n)).collect())) for n in (1, 5))
        assert a == b
