"""Similarity joins, neighbour search, encoding and mixing against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestrata.functions.html_scan import visible_text, words
from pagestrata.llm import encode, knn, mixing, near_dup


def family_texts(seed=5):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        base = [rng.choice(lexicon) for _ in range(rng.randint(24, 60))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(lexicon)
            out.append(" ".join(t))
    hot = [rng.choice(lexicon) for _ in range(40)]
    out += [" ".join(hot)] * 40  # a third of all rows is one text
    out += [" ".join(hot[:i] + ["edit"] + hot[i:]) for i in range(10, 14)]
    return out + [None, "", "too short", " ".join(rng.choice(lexicon) for _ in range(3000))]


def brute_pairs(texts, least=20, t=0.7):
    sets = {}
    for i, x in enumerate(texts):
        w = words(x)
        s = frozenset(zip(w, w[1:], w[2:]))
        if len(s) >= least:
            sets[i] = s
    return {("block", a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("hot_share", "floor", "bucket"), [(0.001, 64, 1_000_000), (0.01, 2, 300)])
def test_near_duplicates_against_brute_force(spark, hot_share, floor, bucket):
    texts = family_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")], "block_id bigint, text string, sig string").repartition(5)
    sets = near_dup.stored(near_dup.block_sets(df), "test-sets")
    got = near_dup.near_duplicates(sets, 0.7, hot_share=hot_share, hot_floor=floor, tokens_per_bucket=bucket).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_pairs(texts)


def test_large_classes_are_stars(spark):
    texts = family_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "block_id bigint, text string")
    got = {tuple(r) for r in near_dup.near_duplicates(near_dup.stored(near_dup.block_sets(df), "test-sets"), 0.7, expand=10).collect()}
    want = brute_pairs(texts)
    hot = [i for i, t in enumerate(texts) if t and texts.count(t) == 40]
    assert got <= want and {("block", hot[0], i) for i in hot[1:]} <= got
    assert {p for p in want if p[1] not in hot and p[2] not in hot} <= got
    outside = {(p[1] if p[1] not in hot else p[2]) for p in want if (p[1] in hot) != (p[2] in hot)}
    assert {("block", min(hot[0], x), max(hot[0], x)) for x in outside} <= got


def test_blocks_of_a_list_are_skipped_by_position():
    rng = np.random.default_rng(4)
    n = np.sort(rng.integers(20, 200, 3000))
    pos = (rng.random(3000) * 0.3 * n).astype(np.int64)
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    got, looked = set(), 0
    for x, y, seen in near_dup.block_pairs(n, pos, 0.7):
        got |= set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
        looked += seen
    i, j = np.triu_indices(3000, 1)
    window = n[j] * 0.7 <= n[i] + 1e-9
    want = window & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= np.ceil(0.7 / 1.7 * (n[i] + n[j]) - 1e-9))
    assert got == set(zip(i[want].tolist(), j[want].tolist())) and looked < window.sum() * 0.7
    # By position alone: sets of one size whose common shingle stands early in some and late in others.
    n, pos = np.full(2000, 100), np.repeat([0, 29], 1000)
    assert sum(seen for *_, seen in near_dup.block_pairs(n, pos, 0.7)) < 2000 * 1999 / 2 * 0.3
    group = np.repeat([5, 6], 1000)
    assert sum(seen for *_, seen in near_dup.block_pairs(np.full(2000, 100), np.zeros(2000, np.int64), 0.7, group)) < 1_100_000
    assert not any(len(x) for x, *_ in near_dup.block_pairs(n, pos, 0.7, np.zeros(2000, np.int64)))


def brute_groups(pairs, ids):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_groups_against_brute_force(spark):
    texts = family_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "block_id bigint, text string").repartition(4)
    sets = near_dup.stored(near_dup.block_sets(df), "test-sets")
    got = near_dup.near_duplicate_groups(sets, 0.7).collect()
    ids = [r["id"] for r in sets.select("id").collect()]
    want = brute_groups(brute_pairs(texts), ids)
    assert {r["id"]: r["group_id"] for r in got} == want and len(got) == len(ids)
    assert all(r["group_size"] == list(want.values()).count(r["group_id"]) for r in got)
    assert near_dup.near_duplicate_groups(near_dup.block_sets(df.limit(0))).count() == 0


def test_a_template_family_is_grouped_without_its_pairs(spark):
    body = " ".join(f"word{i}" for i in range(60))
    family = spark.range(20_000).select(F.col("id").alias("block_id"), F.concat(F.lit("headline "), F.col("id").cast("string"), F.lit(" "), F.lit(body)).alias("text"))
    sets = near_dup.stored(near_dup.block_sets(family.repartition(4), k=5), "test-sets")
    got = near_dup.near_duplicate_groups(sets, 0.8)
    assert [tuple(r) for r in got.groupBy("group_id", "group_size").agg(F.count("*")).collect()] == [(0, 20_000, 20_000)]


def test_near_duplicate_pages_and_empty(spark):
    body = " ".join(f"слово{i}" for i in range(200))
    pages = [(1, f"<p>{body}</p>"), (2, f"<script>x</script><p>{body} кінець</p><!-- c -->"), (3, None)]
    df = spark.createDataFrame(pages, "page_id bigint, html string")
    assert [tuple(r) for r in near_dup.near_duplicates(near_dup.page_sets(df)).collect()] == [("page", 1, 2)]
    assert near_dup.near_duplicates(near_dup.page_sets(df.limit(0))).count() == 0
    assert "x" not in visible_text(pages[1][1])


def vector_rows(seed=6, n=700, dim=64):
    rng = np.random.default_rng(seed)
    rows = [(f"v{i:05d}", rng.standard_normal(dim)) for i in range(n)]
    for c in range(12):
        centre = rng.standard_normal(dim)
        rows += [(f"c{c:02d}-{i}", centre + 0.1 * rng.standard_normal(dim)) for i in range(9)]
    same = rng.standard_normal(dim)
    rows += [(f"s{i:04d}", same) for i in range(350)]  # a third is one vector
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    return rows, [("n1", None), ("n2", [1.0] * 63), ("n3", [0.0] * 64), ("n4", [float("nan")] + [1.0] * 63), ("n5", [])]


def brute_neighbours(rows, k=5):
    ids = sorted(i for i, _ in rows)
    x = np.array([dict(rows)[i] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(ids[a], ids[b]): s[a, b] for a in range(len(ids)) for b in top[a]}


def test_neighbours_against_brute_force(spark):
    rows, odd = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:20]], "id string, embedding array<float>, cell int")
    want = brute_neighbours(rows)
    got = {(r["id"], r["neighbour"]) for r in knn.most_similar(df, 5, cell_size=60, tile=100).collect()}
    assert len(got & want.keys()) / len(want) >= 0.9
    near = {(min(p), max(p)) for p, s in want.items() if s >= 0.9}
    pairs = [tuple(r) for r in knn.similar_pairs(df, 5, 0.9, cell_size=60, tile=100).collect()]
    assert set(pairs) == near and len(pairs) == len(near)


def test_neighbours_small(spark):
    df = spark.createDataFrame([("a", [1.0] + [0.0] * 63), ("b", [0.0, 1.0] + [0.0] * 62)], "id string, embedding array<float>")
    assert {(r["id"], r["neighbour"], round(r["cosine"], 6)) for r in knn.most_similar(df).collect()} == {("a", "b", 0.0), ("b", "a", 0.0)}
    assert knn.most_similar(df.limit(0)).count() == 0 and knn.similar_pairs(df.limit(1)).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_in_many_cells_reach_the_target(spark, clustered):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    if clustered:
        x = rng.standard_normal((60, 64))[rng.integers(0, 60, 6000)] + 0.3 * x
    rows = [(i * 3, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(4)
    ids, s = np.array([i for i, _ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 20 == 0)
    cos = s[asked] @ s.T
    cos[np.arange(len(asked)), asked] = -9
    want = {(int(ids[a]), int(ids[b])) for a, row in zip(asked, cos) for b in np.argsort(-row)[:5]}
    for options, least in (({"cell_size": 100, "tile": 300}, 0.9), ({"cell_size": 500, "fine": 3}, 0.9), ({"cell_size": 500, "exact": True}, 0.9999)):
        got = {(r["id"], r["neighbour"]) for r in knn.most_similar(df, 5, **options).filter("id % 20 = 0").collect()}
        assert len(got) == len(want) and len(got & want) / len(want) >= least


def test_bounds_hold():
    rng = np.random.default_rng(1)
    base, queries = rng.standard_normal((300, 64)), rng.standard_normal((40, 64))
    base, queries = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (base, queries))
    centre = base.mean(axis=0).astype(np.float32)
    low, high = knn.Codes(base, centre, knn.rotation(64)).bounds(queries, centre, knn.rotation(64))
    true = queries @ base.T
    assert ((low <= true + 1e-6) & (true <= high + 1e-6)).mean() > 0.97 and np.median(high - low) < 0.8


TOKENIZER = encode.DEFAULT_PATH
needs_vocabulary = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary here")


@needs_vocabulary
def test_encoding_round_trip(spark):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in encode.load() if x.strip())}
    text_of = {r: t for t, r in ranks.items()}
    texts = [None, "", " ", "Hello  world\r\n\n don't", "Громада 😀 ฿ 公开", "a" * 5000, "é" * 700 + " x", "<|endoftext|>", "\x00​"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_texts(df).collect()}
    assert got[0] is None and got[1] == []
    for i, t in enumerate(texts[1:], 1):
        assert b"".join(text_of[x] for x in got[i]).decode() == t
    tiktoken = pytest.importorskip("tiktoken")
    reference = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(got[i] == reference.encode_ordinary(t) for i, t in enumerate(texts) if t is not None)
    sizes = {r["doc_id"]: r["n_tokens"] for r in encode.token_lengths(df, ["doc_id"]).collect()}
    assert all(sizes[i] == len(got[i] or []) for i in got)


@needs_vocabulary
def test_short_and_long_merges_agree():
    v = encode.Vocabulary(encode.load())
    rng = random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"abcehinorst ") for _ in range(rng.randint(1, 60)))
        assert encode.merge_short(word, v) == encode.merge_long(word, v)


@needs_vocabulary
def test_both_merges_agree_on_long_words():
    v = encode.Vocabulary(encode.load())
    rng = random.Random(3)
    for size in (191, 192, 193, 194, 250, 400, 1000):
        for letters in (b"abcehinorst", b"aab", " громада".encode(), bytes(range(256))):
            word = bytes(rng.choice(letters) for _ in range(size))
            assert encode.merge_short(word, v) == encode.merge_long(word, v)
    assert encode.merge_short(b"a" * 500, v) == encode.merge_long(b"a" * 500, v)


def test_shares_meet_their_targets_within_the_caps(spark):
    rng = random.Random(8)
    rows = [(i, "abcd"[i % 4], rng.randint(1, 50)) for i in range(8000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    goals = {"a": 0.5, "b": 0.25, "c": 0.15, "d": 0.1}
    targets = spark.createDataFrame([(s, x, 3) for s, x in goals.items()], "source string, target_share double, max_repeats int")
    for total in (50_000, 120_000, None):
        got = {r["source"]: r for r in mixing.report_mix(sizes, targets, total).collect()}
        assert all(abs(r["actual_share"] - goals[s]) < 0.005 and r["repeats"] <= 3 for s, r in got.items())
    capped = {r["source"]: r for r in mixing.report_mix(sizes, targets.withColumn("max_repeats", F.when(F.col("source") == "a", 1).otherwise(3))).collect()}
    assert capped["a"]["repeats"] == 1 and capped["a"]["sampled_tokens"] == capped["a"]["tokens_available"]
    rest = sum(r["sampled_tokens"] for s, r in capped.items() if s != "a")
    assert all(abs(r["sampled_tokens"] / rest - goals[s] / 0.5) < 0.01 for s, r in capped.items() if s != "a")


def test_water_fill():
    got = mixing.water_fill({"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 2, "c": 1}, 300)
    assert got["b"] == 20 and got["a"] == pytest.approx(200) and got["c"] == pytest.approx(80) and sum(got.values()) == pytest.approx(300)
    assert mixing.water_fill({"a": 5}, {"a": 1.0, "x": 0.5}, {"a": 1, "x": 3}, 100) == {"a": 5.0, "x": 0.0}
    assert mixing.water_fill({}, {}, {}) == {}


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["big"] * 6 + ["mid", "mid", None, "other"]), rng.randint(0, 200)) for i in range(3000)] + [(9001, "tiny", 50)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("tiny", 0.1, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in mixing.report_mix(sizes, targets, 50_000).collect()}
    assert rep["tiny"]["repeats"] == 4 and rep["tiny"]["sampled_tokens"] == 200 and rep["absent"]["sampled_tokens"] == 0 and rep["other"]["repeats"] == 0 and None in rep
    assert abs(rep["big"]["actual_share"] - rep["mid"]["actual_share"]) < 0.01 and sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    assert sum(r["sampled_tokens"] for r in rep.values()) <= 50_000 and sum(r["sampled_tokens"] for r in rep.values()) > 49_000
    taken = mixing.sample_mix(sizes, targets, 50_000)
    assert {r["source"]: r["t"] for r in taken.groupBy("source").agg(F.sum(F.expr("n_tokens * copies")).alias("t")).collect()} == {k: r["sampled_tokens"] for k, r in rep.items() if r["sampled_tokens"]}
    assert sorted(map(tuple, taken.collect())) == sorted(map(tuple, mixing.sample_mix(sizes, targets, 50_000).collect()))
    assert mixing.report_mix(sizes.limit(0), targets.limit(0)).count() == 0
