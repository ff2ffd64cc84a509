import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostride.llm import embeddings, graph, ngram_join, shingles, signature_tree, skew
from geostride.session import materialize

from .cases import SCHEMA, empty, odd_documents, save


def plain_components(texts, percent=80):
    """doc_id -> (set size, component), every pair compared."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    comp = {k: k for k in texts}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def families(seed=1, groups=14, copies=9, passage=40):
    """Texts with exact copies, near copies in chains, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    shared = [word() for _ in range(passage)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(6, 160))]
        if r.random() < 0.6:
            at = r.randint(0, len(base))
            base[at:at] = shared
        for _ in range(r.randint(1, copies)):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                base[r.randrange(len(base))] = word()
            if r.random() < 0.2:
                base += [word() for _ in range(len(base) // 8)]
    r.shuffle(out)
    return dict(enumerate([*out, None, "", "one two", "One  two", "one two three"]))


def run_join(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs.repartition(3)).collect()}


def test_ngram_join_equals_every_pair(spark):
    texts = families()
    assert run_join(spark, texts) == plain_components(texts)


def test_ngram_join_in_small_chunks(spark, monkeypatch):
    """Blocks cut into many chunks, joined over chunks and by residual pairs, give the same components."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    texts = families(seed=7, groups=5, copies=25)
    assert run_join(spark, texts) == plain_components(texts)


def test_ngram_join_with_hot_tokens(spark, monkeypatch):
    """Tokens held by many sets are dealt over several tasks, with the same components."""
    monkeypatch.setattr(skew, "LEAST_HOT", 2)
    texts = families(seed=5, groups=4, copies=20)
    assert run_join(spark, texts) == plain_components(texts)


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 10)
    rows = spark.range(1000).selectExpr("id as s", "if(id % 3 = 0, 7, id) as token")
    facts = materialize(rows.groupBy("token").agg(F.count("*").alias("held"), F.min("s").alias("least")), "t")
    joined = skew.join_facts(rows, facts, "token", "s")
    want = {(r.s, r.token, r.least) for r in rows.join(facts, "token").select("s", "token", "least").collect()}
    assert {(r.s, r.token, r.least) for r in joined.collect()} == want and joined.columns == ["token", "s", "least"] and joined.count() == 1000


def test_ngram_join_takes_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    docs = docs.unionByName(docs.filter("doc_id in (3, 17)")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = ngram_join.query(spark, save(docs, tmp_path)).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = plain_components(texts)
    assert len(got) == docs.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = ngram_join.representatives(docs)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert ngram_join.query(spark, empty(spark, tmp_path / "none")).count() == 0


def test_rows_that_repeat_a_key_go_by_their_own_text(spark):
    one, two, three = ("the quick brown fox jumps over it", "some other words that nothing else has in it", "a third text of seven words here")
    rows = [(2, one), (5, one.upper()), (5, two), (5, two), (5, None), (6, three), (6, one), (7, three), (8, "plain words")]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(2, one), (5, ""), (5, two), (6, three), (8, "plain words")]


def test_shingle_sets_are_those_of_words():
    texts = ["A b c d e f", "a  B\tc d e f\n", "a b c d", "a b c d ", "", None, "é ü ß x y z é ü ß x y z"]
    s = shingles.shingle_sets(texts)
    assert [len(x) for x in s] == [2, 2, 1, 1, 0, 0, 6]
    assert (s[0] == s[1]).all() and (s[2] == s[3]).all() and all((np.diff(x.astype(object)) > 0).all() for x in s)


def test_nul_is_part_of_a_word(spark):
    texts = dict(enumerate(["a\0b c d e f g", "a b c d e f g", "a\0 b c d e f", "\0", "\0 \0", "a c d e f\0", "a c d e f", "a\x01b c d e f g"]))
    assert [len(s) for s in shingles.shingle_sets(list(texts.values()))] == [2, 3, 2, 1, 1, 1, 1, 2]
    assert run_join(spark, texts) == plain_components(texts)


def test_signature_tree_equals_pairs():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = r.integers(0, 1 << 62, r.integers(5, 200)).astype(np.uint64)
        for _ in range(r.integers(1, 5)):
            s = base.copy()
            at = r.integers(0, len(s), r.integers(0, max(1, len(s) // 8) + 1))
            s[at] = r.integers(0, 1 << 62, len(at)).astype(np.uint64)
            sets.append(np.unique(s))
    forest = graph.UnionFind(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if signature_tree.links(sets[i], sets[j], 80):
                forest.union(i, j)
    assert (signature_tree.Tree(sets).link() == forest.roots()).all()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(500, 500), (41, 42), (42, 41)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 40)} | {41: 41, 42: 41}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows(seed=2, n=400, d=16):
    r = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        v = r.standard_normal(d)
        label = int(r.integers(0, 3))
        for _ in range(r.integers(1, 4)):
            rows.append((len(rows), [float(x) for x in np.float32(v + 0.05 * r.standard_normal(d))], label))
        rows.append((len(rows), rows[-1][1], label))
    rows.append((len(rows), [2 * x for x in rows[0][1]], rows[0][2]))
    bad = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] * d, [None] * d, [1.0] * (d + 1)]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(bad)]
    rows.append((len(rows), rows[1][1], None))
    return rows


def plain_links(rows, least=0.98):
    sound = {k: np.array(v, float) for k, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {k: lab for k, _, lab in rows}
    forest, links = {k: k for k, _, _ in rows}, dict.fromkeys((k for k, _, _ in rows), 0)

    def find(k):
        while forest[k] != k:
            k = forest[k]
        return k

    keys = sorted(sound)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if label[a] == label[b] and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                forest[y] = x
    return {k: (links[k], find(k)) for k in links}


@pytest.mark.parametrize("block", [1500, 20])
def test_embeddings_equal_every_pair(spark, block):
    rows = near_rows()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()
    want = plain_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_of_many_lengths_equal_every_pair(spark):
    r = np.random.default_rng(6)
    vectors = [np.float32(v + 0.01 * r.standard_normal(d)) for d in range(2, 72) for v in r.standard_normal((3, d)) for _ in range(2)]
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(vectors)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=4).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(rows)


@pytest.mark.parametrize(("bits", "block"), [(3, 1500), (6, 1500), (6, 8)])
def test_embeddings_in_bands_equal_every_pair(spark, monkeypatch, bits, block):
    """Buckets of several bands, whole and cut into chunks, with extra columns whose names clash."""
    fixed = F.struct(F.lit(1).alias("copies"), F.lit(bits).alias("bits"), F.lit(embeddings.bands_of(bits, 0.98)).alias("bands"))
    monkeypatch.setattr(embeddings, "banding", lambda rows, block, least: fixed)
    rows = near_rows(seed=bits, n=500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as g", "'x' as key", "2 as h", "3 as n", "4 as band")
    got = embeddings.near_duplicates(df, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(rows)


def test_bands_follow_the_number_of_vectors(spark):
    got = spark.range(1).select(*(embeddings.banding(F.lit(n), 1500, 0.98).alias(f"n{n}") for n in (10, 20_000, 10**6, 10**9, 10**12))).first()
    assert got["n10"].bits == got["n20000"].bits == 0 and got["n20000"].copies == 14
    assert got["n1000000"].copies < 50 and got["n1000000000"].copies < 200 and got["n1000000000000"].bits == embeddings.MOST_BITS
    # a pair at the threshold agrees in a sign with a chance of 1 - angle / pi
    r = np.random.default_rng(3)
    a = embeddings.unit(r.standard_normal((4000, 32)))
    b = r.standard_normal((4000, 32))
    b = embeddings.unit(b - (b * a).sum(1, keepdims=True) * a)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    same = embeddings.band_keys(a, 4, 10) == embeddings.band_keys(near, 4, 10)
    assert abs(same.mean() - (1 - np.arccos(0.98) / np.pi) ** 4) < 0.01


def test_embeddings_of_nothing(spark, tmp_path):
    assert embeddings.query(spark, empty(spark, tmp_path, "embeddings", "vec_id long, embedding array<float>, label int")).count() == 0


def test_code_bounds_hold_and_estimates_are_unbiased():
    r = np.random.default_rng(1)
    u = embeddings.unit(r.standard_normal((600, 64)))
    codes, factor = embeddings.encode(u)
    rotated = u @ embeddings.rotation(64).T
    upper = embeddings.upper_bounds(codes, factor, rotated)
    assert (upper >= u @ u.T - 1e-6).all()
    error = embeddings.BOUND * np.sqrt((1 - factor**2) / factor**2 / 63)
    off = ~np.eye(600, dtype=bool)
    assert abs((upper - error[:, None] - u @ u.T)[off].mean()) < 2e-3
    assert (upper >= embeddings.LEAST)[off].mean() < 0.2
