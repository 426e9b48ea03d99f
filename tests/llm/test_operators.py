"""Each operator against brute force, and on awkward tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm import words
from keyfold.llm import components, decontamination, importance, jaccard_join, license_scan, packing, selection, sharding, suffix_tree, token_files, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def make(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = ["w" + "".join(r.choice("abcdé") for _ in range(r.randrange(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(vocabulary, k=r.randrange(1, 80)))
        if i % 6 == 5:
            words = r.choice(rows)[1].split(" ")
            words[r.randrange(len(words))] = "edit"
            text = " ".join(words)
        if i % 11 == 10:
            text = r.choice(rows)[1]
        rows.append((i, text or "x", r.choice(["en", "fr"]), "s", len(text)))
    return rows


ODD = [(1000, None, "en", "s", None), (1001, "", None, None, 0), (1002, "  \n", "fr", "s", 3), (1003, "one", "en", "s", 3), (1004, "one", "en", "s", 3), (1004, "one", "en", "s", 3), (1005, "long " * 30_000, "en", "s", 150_000), (1006, "a b", "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make() + ODD, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(100)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def clashing(df):
    for c in ("score", "row", "toxic", "leaks", "sum", "log_weight", "bucket", "shard", "key", "n", "sig"):
        df = df.withColumn(c, F.lit("mine"))
    return df


# ---- all


def test_rows_without_ids_and_with_shared_ids(spark, labels):
    """Every operator takes rows without an id, rows that share an id with other texts or their own, empty and very long texts, beside columns of any name."""
    texts = [(None, "no id here at all"), (None, None), (None, "no id here at all"), (5, "five has this text"), (5, "and this other one"), (5, "five has this text"), (6, ""), (7, "long " * 60_000), (8, " ")]
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS)).repartition(2)
    words = collections.Counter((i, len(split(t))) for i, t in texts)
    ids = collections.Counter(i for i, _ in texts)

    def of(rows, *names):
        return collections.Counter(tuple(r[n] for n in names) for r in rows.collect())

    every = importance.resample(df, labels, k=100)
    assert collections.Counter(r.row.doc_id for r in every.collect()) == ids and importance.quality_report(df, labels).columns == ["doc_id", "log_weight", "perturbed"]
    assert of(packing.pack(df, 3, 50), "doc_id", "n_tokens") == words
    assert of(suffix_tree.score_report(df), "doc_id", "n_tokens") == collections.Counter({(i, n + 1): c for (i, n), c in words.items()})
    assert sum(of(toxicity.toxicity_report(df, labels), "doc_id").values()) == len(texts)
    assert of(sharding.shard_report(df), "doc_id", "size") == collections.Counter((i, len((t or "").encode()) + 8) for i, t in texts)
    items = spark.createDataFrame([(1, "five has this text"), (2, "long " * 30)], "item_id long, text string")
    assert decontamination.leaks(df, items).count() == 1 and decontamination.without_leaks(df, items).count() == len(texts) - 1
    found = license_scan.scan(df, spark.createDataFrame([("F", "and this other one"), ("N", "no id here at all")], "template_id string, text string"))
    assert of(found, "doc_id", "template_id") == collections.Counter([(5, "F"), (None, "N")])
    got = of(jaccard_join.link_components(df, 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == collections.Counter([(None, 3, None), (None, 3, None), (None, 0, None), (5, 2, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6), (7, 1, 7), (8, 0, 8)])
    left = collections.Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect())
    assert left == collections.Counter({**collections.Counter(texts), (5, "five has this text"): 1})


# ---- 1


def test_resampling_keeps_good_and_drops_junk(spark):
    r = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        words = [r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "&&&" if bad and j % 2 else w for j, w in enumerate(words)), "en", "s", 1))
        marks.append((i, int(not bad), 0))
    out = importance.without_poor(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert {x.doc_id for x in out.collect()} == {i for i in range(400) if i % 5}


def test_log_weights_are_the_models(spark, docs):
    pdf = docs.toPandas()

    def grams(t):
        (_, _, w), = importance.words_of(pa.array([t], pa.string()), importance.WORD_PUNCT)
        return importance.ngrams(w)[0]

    raw = np.zeros(1 << importance.BITS)
    for t in pdf["text"]:
        np.add.at(raw, grams(t), 1)
    assert np.array_equal(importance.counts(docs), raw)
    ratio = importance.log_ratio(raw * (np.arange(len(raw)) % 7), raw)
    got = importance.weigh(docs, ratio).select("row.doc_id", "row.text", "log_weight").toPandas()
    for x in got.itertuples():
        g = grams(x.text)
        assert x.log_weight == pytest.approx(ratio[g].sum() * min(1, importance.LENGTH / len(g)) if len(g) else 0.0, abs=1e-6)


def test_sample_by_brute_force(spark, docs, labels):
    """Buckets by plain integers, counts by dictionaries, weights and Gumbel numbers by math, and a sort."""
    whole = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & whole
        return x ^ (x >> 31)

    def hashed(token):
        total = 0
        for i, byte in enumerate(token):
            total += int(words._BYTE[byte]) * pow(words._BASE, i, 1 << 64)
        return mixed(total & whole)

    def grams(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        h = [hashed(t) for t in re.findall(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\x20\x09-\x0d]+", raw)]
        return [x >> 48 for x in [*h, *(mixed((3 * a + 0x9E3779B97F4A7C15 * b) & whole) for a, b in zip(h, h[1:]))]]

    rows = docs.collect()
    good = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(grams(r.text))
        target.update(grams(r.text) if good.get(r.doc_id) == 1 else [])
    n, t = sum(raw.values()), sum(target.values())
    u = docs.select("doc_id", "text", importance.gumbel(F.lit(importance.SEED), "doc_id", "text").alias("g")).collect()
    sums = []
    for r in u:
        g = grams(r.text)
        w = sum(math.log(target[x] + 5) - math.log(t * raw[x] / n + 5) for x in g) * min(1, importance.LENGTH / max(1, len(g)))
        sums.append((math.floor((w + r.g) * importance.FIXED), r.doc_id))
    k = math.ceil(len(rows) * sum(good[r.doc_id] for r in rows if r.doc_id in good) / sum(r.doc_id in good for r in rows))
    least = sorted(sums, reverse=True)[k - 1][0]
    got = importance.resample(clashing(docs), labels).select("row.doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for s, i in sums if s >= least)


def test_draws_follow_the_weights(spark):
    """With k = 1 a text is drawn as often as the softmax of the log weights says."""
    weights = [0.0, 0.5, 1.0, 2.0, -1.0, 1.5]
    df = spark.createDataFrame(list(enumerate(weights)), "doc_id long, w double").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(5999))))
    top = df.groupBy("seed").agg(F.max_by("doc_id", F.col("w") + importance.gumbel(F.col("seed"), "doc_id")).alias("d")).groupBy("d").count().collect()
    share = np.exp(weights) / np.exp(weights).sum()
    for r in top:
        assert abs(r["count"] / 6000 - share[r["d"]]) < 4 * (share[r["d"]] / 6000) ** 0.5


def test_resampling_of_k_is_the_top_k(spark, docs, labels):
    every = importance.resample(docs, labels, k=10_000).select("row.doc_id", "sum").toPandas()
    assert len(every) == docs.count()
    some = importance.resample(docs, labels, k=20).select("row.doc_id", "sum").toPandas()
    least = sorted(every["sum"], reverse=True)[19]
    assert sorted(some["sum"]) == sorted(x for x in every["sum"] if x >= least)
    assert importance.resample(docs, labels, k=0).isEmpty()


def test_kth(spark):
    values = [random.Random(1).randrange(-(10**12), 10**12) for _ in range(500)] + [5] * 20
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    for k in (1, 7, 300, 520, 9999):
        assert selection.kth_highest(df, "v", k) == sorted(values, reverse=True)[min(k, 520) - 1]
    assert selection.kth_highest(df.where("v is null"), "v", 3) is None


# ---- 2


def brute_padding(lengths, k):
    distinct = sorted(set(lengths))
    best = None
    for m in range(1, min(k, len(distinct)) + 1):
        for cut in itertools.combinations(distinct[:-1], m - 1):
            bounds = [*cut, distinct[-1]]
            pad = sum(min(b for b in bounds if b >= n) - n for n in lengths)
            best = pad if best is None else min(best, pad)
    return best


def test_buckets_are_optimal():
    r = random.Random(4)
    for k in (1, 2, 3, 4):
        lengths = [r.randrange(40) for _ in range(60)]
        values, counts = np.unique(lengths, return_counts=True)
        bounds = packing.boundaries(values, counts, k)
        assert len(bounds) <= k and bounds == sorted(set(bounds))
        assert sum(min(b for b in bounds if b >= n) - n for n in lengths) == brute_padding(lengths, k)
    assert packing.boundaries(np.array([]), np.array([]), 4) == []


def test_packing(spark, docs, empty):
    out = packing.pack(clashing(docs), buckets=4, budget=200).toPandas()
    want = {r.doc_id: len(split(r.text)) for r in docs.collect()}
    assert len(out) == docs.count() and all(want[x.doc_id] == x.n_tokens for x in out.itertuples())
    for (_, pad), b in out.groupby(["bucket", "padded_to"]):
        cap = max(1, 200 // max(1, pad))
        sizes = b.groupby("batch").size()
        assert (b["n_tokens"] <= pad).all() and sizes.max() <= cap and (sizes.sort_index()[:-1] == cap).all()
        assert sorted(b["batch"].unique()) == list(range(-(-len(b) // cap)))
        assert all(sorted(g["place"]) == list(range(len(g))) for _, g in b.groupby("batch"))
    assert packing.pack(empty).isEmpty()


def test_long_lengths_are_exact(spark):
    r = random.Random(6)
    lengths = [r.randrange(4_000, 20_000) for _ in range(120)] + [r.randrange(50) for _ in range(300)]
    values, counts = np.unique(lengths, return_counts=True)

    def padding(bounds):
        return int(sum((bounds[np.searchsorted(bounds, n)] - n) for n in lengths))

    for k in (1, 2, 7, 16):
        rows, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * values)])
        best = np.full(len(values) + 1, 1 << 60)
        best[0] = 0
        for _ in range(k):  # the plain quadratic program
            best = np.array([0, *(min(best[i] + values[j - 1] * (rows[j] - rows[i]) - (total[j] - total[i]) for i in range(j)) for j in range(1, len(values) + 1))])
        bounds = packing.boundaries(values, counts, k)
        assert padding(np.array(bounds)) == best[-1] and bounds[-1] == max(lengths) and len(bounds) == k
    many = np.arange(1, 200_001)
    assert len(packing.boundaries(many, np.ones_like(many), 16)) == 16


def test_rows_of_one_id_are_spread(spark):
    same = spark.createDataFrame([(None, "a b")] * 400 + [(1, "a b")] * 400, "doc_id long, text string")
    out = packing.pack(same, 2, 10).toPandas()
    assert len(out) == 800 and out.groupby("batch").size().max() == 5 and not out.duplicated(["batch", "place"]).any()
    slots = sharding.shard_report(same).toPandas()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in slots.groupby("shard"))


# ---- 3


def test_base_scores_and_counts(spark, docs):
    out = suffix_tree.score_report(clashing(docs)).toPandas()
    rows = docs.collect()
    c = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            c.update([*split(r.text), "\0end"])
    n, v = sum(c.values()), len(c)
    want = {r.doc_id: [*split(r.text), "\0end"] for r in rows}
    assert len(out) == len(rows)
    for x in out.itertuples():
        w = want[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(c[y] > 0 for y in w), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[y] + 0.5) / (n + 0.5 * (v + 1))) for y in w))
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 1)


def test_few_table_words_change_nothing_in_the_base(spark, docs):
    parts = [suffix_tree.score(docs, *suffix_tree.fit(docs, limit=n), [F.col("doc_id")]).toPandas().sort_values(["doc_id"]) for n in (5, 1 << 19)]
    assert np.allclose(parts[0]["base_score"], parts[1]["base_score"]) and (parts[0]["n_known"].to_numpy() == parts[1]["n_known"].to_numpy()).all()


def test_distributions_sum_to_one(spark):
    r = random.Random(9)
    chain = {w: r.sample("a b c d e f g h".split(), 2) for w in "abcdefgh"}
    texts = []
    for _ in range(300):
        w = [r.choice("abcdefgh")]
        for _ in range(30):
            w.append(r.choice(chain[w[-1]]))
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tree, table, counts = suffix_tree.fit(df, gain=3.0)
    assert tree.kept[0].sum() >= 8
    root = np.log(tree.count + 0.5) - np.log(tree.total + 0.5 * (tree.distinct + 1))
    for context in itertools.product(range(len(tree.words)), repeat=2):
        base = [suffix_tree.END, *tree.words[list(context)]]
        seqs = np.concatenate([np.array([*base, w], np.uint64) for w in [*tree.words, np.uint64(7)]])
        gain = np.concatenate([[0.0], suffix_tree.gains(tree, seqs)]).reshape(-1, 4)[:, -1]
        total = np.exp(root + gain[:-1]).sum() + np.exp(gain[-1]) * (1 - np.exp(root).sum())
        assert total == pytest.approx(1)
    scored = suffix_tree.score(df, tree, table, counts, [F.col("doc_id")]).toPandas()
    assert scored["score"].sum() > 0.75 * scored["base_score"].sum()  # each word has two successors of eight


def brute_tree_scores(training, texts, least, gain, depth=3):
    """log10 scores by dictionaries and recursion over contexts as tuples of words."""
    end = "\0end"
    seqs = [[end, *split(t), end] for t in training]
    c1 = collections.Counter(w for q in seqs for w in q[1:])
    n, v = sum(c1.values()), len(c1)
    least = max(3.0, least * n)
    often = {w for w, c in c1.items() if c >= least}
    lists, counts = [], {(w,): c1[w] for w in often}
    for length in range(1, depth + 1):
        c = collections.Counter()
        for q in seqs:
            for i in range(max(length, 1), len(q)):
                ctx = tuple(q[i - length : i])
                if q[i] in often and ctx in counts and (length == 1 or end not in ctx):
                    c[(*ctx, q[i])] += 1
        level = {k: x for k, x in c.items() if x >= least and (length == 1 or k[1:] in lists[-1])}
        lists.append(level)
        counts.update(level)
    root = {w: (c1[w] + 0.5) / (n + 0.5 * (v + 1)) for w in c1}
    unknown = 0.5 / (n + 0.5 * (v + 1))
    kept, p, rest = set(), {}, {}

    def prob(ctx, w):
        if not ctx:
            return root.get(w, unknown)
        if ctx not in kept:
            return prob(ctx[1:], w)
        return p[ctx, w] if (ctx, w) in p else rest[ctx] * prob(ctx[1:], w)

    for level in lists:
        by = collections.defaultdict(dict)
        for k, x in level.items():
            by[k[:-1]][k[-1]] = x
        new = []
        for ctx, symbols in by.items():
            mass = sum(symbols.values())
            seen = max(counts[ctx], mass)
            own = {w: (x - 0.5) / seen for w, x in symbols.items()}
            left = (1 - sum(own.values())) / (1 - sum(prob(ctx[1:], w) for w in symbols))
            better = sum(x * math.log(own[w] / prob(ctx[1:], w)) for w, x in symbols.items()) + (seen - mass) * math.log(left)
            if better > gain:
                new.append((ctx, own, left))
        for ctx, own, left in new:
            kept.add(ctx)
            rest[ctx] = left
            p.update({(ctx, w): x for w, x in own.items()})
    out = []
    for t in texts:
        q = [end, *split(t), end]
        total = 0.0
        for i in range(1, len(q)):
            ctx = next((tuple(q[i - k : i]) for k in range(min(depth, i), 0, -1) if tuple(q[i - k : i]) in kept and (k == 1 or end not in q[i - k : i])), ())
            total += math.log10(prob(ctx, q[i]))
        out.append(total)
    return out, len(kept)


def test_scores_by_brute_force_whatever_the_layout(spark, monkeypatch):
    """Rows sorted by language, in one partition and in sixteen, with small flushes: the same scores, and those of dictionaries."""
    r = random.Random(10)
    rows = []
    for lang in "abc":
        words = [f"{lang}{i}" for i in range(25)]
        follow = {w: r.sample(words, 3) for w in words}
        for _ in range(60):
            t = [r.choice(words)]
            for _ in range(r.randrange(40)):
                t.append(r.choice(follow[t[-1]]) if r.random() < 0.9 else r.choice(words))
            rows.append((len(rows), " ".join(t)))
    rows += [(900, None), (901, "never seen words"), (902, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id")
    want, kept = brute_tree_scores([t for _, t in rows], [t for _, t in rows], 0.002, 4.0)
    assert kept > 30
    monkeypatch.setattr(suffix_tree, "FLUSH", 300)
    for parts in (1, 16):
        some = df.coalesce(1) if parts == 1 else df.repartitionByRange(parts, "doc_id")
        got = suffix_tree.score(some, *suffix_tree.fit(some, least=0.002, gain=4.0), [F.col("doc_id")]).toPandas().sort_values("doc_id")
        assert np.allclose(got["score"], want, rtol=1e-9)


def test_few_broadcast_values_change_no_score(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(12)]
    follow = {w: r.sample(words, 2) for w in words}
    texts = ["", "w1"]
    for _ in range(80):
        t = [r.choice(words)]
        for _ in range(r.randrange(30)):
            t.append(r.choice(follow[t[-1]]))
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, kept = brute_tree_scores(texts, texts, 0.0, 4.0)
    assert kept > 10
    for head in (0, 20):
        tree, table, counts = suffix_tree.fit(df, gain=4.0, head=head)
        assert len(tree.keys) <= head and tree.far.count() > 20
        got = suffix_tree.score(df, tree, table, counts, [F.col("doc_id")]).toPandas().sort_values("doc_id")
        assert np.allclose(got["score"], want, rtol=1e-9)


def test_three_occurrences_do_in_a_large_corpus(spark):
    """Two million tokens hold a sequence three times: it is listed, whatever its share."""
    rows = [(0, "a b " * 1_000_000), *((i, "p q r s") for i in (1, 2, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_tree.score(df, *suffix_tree.fit(df), [F.col("doc_id")]).where("doc_id = 1").first()
    assert out.score - out.base_score > 15


def test_sequences_seen_too_seldom_are_ruled_out(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    times = np.where(np.arange(3000) < 200, 3, 1 + (np.arange(3000) % 2))
    df = spark.createDataFrame([(str(x),) for x in rng.permutation(np.repeat(keys, times))], "text string").repartition(7)

    def places(b):
        yield [None, np.array([int(x) for x in b.column(0).to_pylist()], np.uint64)], np.arange(b.num_rows)

    there = suffix_tree.maybe(suffix_tree.repeated(df, "text", places, 1, 3), keys)
    assert there[:200].all() and not there[200:].any()


def test_far_values_by_range(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    asked = [(i << 36, [int(x) for x in rng.choice(keys, i % 40)]) for i in range(300)]
    value = {int(k): float(i) for i, k in enumerate(keys[:400])}
    got = suffix_tree.far_sums(spark.createDataFrame(asked, "uid long, far array<long>").repartition(5), spark.createDataFrame(list(value.items()), "key long, value double"))
    want = {u: sum(value.get(k, 0.0) for k in ks) for u, ks in asked if ks}
    assert {r["uid"]: r["added"] for r in got.collect()} == want


def rows_made(df, name):
    """How many rows the nodes of a name in the plan of a collected frame have made."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("pythonNumRowsReceived").value() if kind == name else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_far_values_give_no_row_for_each_text_and_range(spark, monkeypatch):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    asked = [(i, [int(x) for x in rng.choice(keys, 100)]) for i in range(400)]
    value = {int(k): float(i) for i, k in enumerate(keys)}
    monkeypatch.setattr(suffix_tree, "written", lambda df, _: df)
    monkeypatch.setattr(suffix_tree, "ranges", lambda _: 6)
    parts = spark.createDataFrame(asked, "uid long, far array<long>").coalesce(2)
    got = suffix_tree.far_sums(parts, spark.createDataFrame(list(value.items()), "key long, value double"))
    assert {r["uid"]: r["added"] for r in got.collect()} == {u: sum(value[k] for k in ks) for u, ks in asked}
    assert 0 < rows_made(got, "FlatMapCoGroupsInArrowExec") <= 2 * 64


def test_words_and_sequences_move_as_runs_and_not_as_rows(spark, monkeypatch):
    r = random.Random(15)
    texts = [" ".join(r.choices("abcdefghijklmnopqrst", k=200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    write, moved = suffix_tree.written, []

    def written(df, name):
        if name in ("words", "listed"):
            df.collect()
            moved.append(rows_made(df, "MapInArrowExec"))
        return write(df, name)

    monkeypatch.setattr(suffix_tree, "written", written)
    monkeypatch.setattr(suffix_tree, "ranges", lambda _: 3)
    tree, _, counts = suffix_tree.fit(df, gain=1.0)
    assert len(moved) == 4 and all(0 < n <= 2 * 8 for n in moved)
    assert sorted(x["n"] for x in counts.collect()) == sorted(collections.Counter(w for t in texts for w in [*t.split(), "end"]).values())


def test_far_values_are_asked_for_by_a_slice_of_the_texts_at_a_time(spark, monkeypatch):
    there, most, rows = {}, [0], [0]
    write, drop = suffix_tree.written, suffix_tree.discard

    def written(df, name):
        out = write(df, name)
        if name == "asking":
            there[out.written_to] = out.count()
            most[0], rows[0] = max(most[0], sum(there.values())), rows[0] + there[out.written_to]
        return out

    def discard(*tables):
        drop(*tables)
        for t in tables:
            there.pop(getattr(t, "written_to", None), None)

    monkeypatch.setattr(suffix_tree, "written", written)
    monkeypatch.setattr(suffix_tree, "discard", discard)
    texts = [f"a b c d e{i % 40} f{i % 40} g" for i in range(300)] + [f"h{i} a b c" for i in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = suffix_tree.fit(df, gain=1.0, head=5)
    scored = [suffix_tree.score(df, *fitted, [F.col("doc_id")], once=once).toPandas().sort_values("doc_id") for once in (False, True)]
    assert rows[0] == 2 * len(texts) and most[0] < 0.6 * len(texts) and not there
    assert np.allclose(scored[0]["score"], scored[1]["score"])
    want = suffix_tree.score(df, *suffix_tree.fit(df, gain=1.0), [F.col("doc_id")]).toPandas().sort_values("doc_id")
    assert np.allclose(scored[0]["score"], want["score"], rtol=1e-9)


def test_bit_tables_leave_no_shuffle_files(spark):
    def left():
        tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in tops for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = left()
    keys = np.random.default_rng(6).integers(-(1 << 63), (1 << 63) - 1, 5000)
    table = suffix_tree.bit_table(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert suffix_tree.maybe(table, keys.view(np.uint64)).all()
    assert sum(int(x).bit_count() for x in table[table > 0]) <= len(keys)
    assert left() <= before


def test_suffix_tree_on_nothing(spark, empty):
    assert suffix_tree.score_report(empty).isEmpty()
    one = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    out = suffix_tree.score(one, *suffix_tree.fit(one.where("false")), [F.col("doc_id")]).toPandas()
    assert np.isfinite(out["score"]).all() and sorted(out["n_tokens"]) == [1, 2]


# ---- 4


def test_classifier_learns(spark):
    r = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        words = ["".join(r.choice("aeioubcdlmnst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[r.randrange(len(words))] = r.choice(["vilewordone", "vilewordtwo", "nastything,"])
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", "s", 1))
        marks.append((i, 1, int(bad)))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_report(df, lab).toPandas()
    held = out[out["held_out"]]
    assert 200 < len(held) < 400
    truth = held["doc_id"] % 4 == 0
    assert ((held["predicted"] == 1) == truth).mean() > 0.95 and (held["toxic"] == truth).mean() > 0.95
    again = toxicity.toxicity_report(df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), lab).toPandas()
    assert again["score"].between(0, 1).all()


def test_toxicity_on_awkward_tables(spark, docs, labels, empty):
    out = toxicity.toxicity_report(clashing(docs), labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all() and not out["held_out"].isna().any()
    assert toxicity.toxicity_report(empty, labels).isEmpty()
    none = toxicity.toxicity_report(docs, labels.where("false")).toPandas()
    assert (none["score"] == 0.5).all()


def test_nothing_is_toxic_without_both_classes(spark, docs, labels):
    for lab in (labels.where("false"), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("toxic", F.lit(1)), labels.withColumn("toxic", F.lit(0))):
        assert toxicity.without_toxic(docs, lab).count() == docs.count()
        out = toxicity.toxicity_report(docs, lab).toPandas()
        assert not out["toxic"].any() and not out["predicted"].any()


def test_few_labels_of_one_class_first(spark):
    """However the ids' hashes fall, a model isn't learnt from one class alone."""
    docs = spark.createDataFrame([(i, f"{'vileword' if i % 5 == 0 else 'fine'} text {i}", "en", "s", 1) for i in range(40)], DOCS)
    for ids in itertools.combinations((0, 1, 5, 10), 2):
        lab = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in ids], "doc_id long, quality int, toxic int")
        m = toxicity.fit(docs, lab)
        assert (m.threshold > 1) == (1 not in ids) and (m.out.any() or m.threshold > 1)
        if 1 not in ids:
            assert toxicity.without_toxic(docs, lab).count() == 40


def test_large_rows_do_not_end_the_sample(spark):
    texts = ["x " * 3000 if i < 30 else "y " * 700 if i < 35 else f"small {i}" for i in range(80)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    lab = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    got = [t for t, _, _ in toxicity.sample(docs, lab, F.lit(True), most=4000)]
    assert sorted(t for t in got if t.startswith("small")) == sorted(texts[35:]) and sum(t.startswith("y") for t in got) == 2 and len(got) == 47


def test_pooling_is_the_maximum():
    r = np.random.default_rng(0)
    e, off = r.normal(size=(20, 3)).astype(np.float32), np.array([0, 0, 1, 3, 11, 20])
    filters = [r.normal(size=(w, 3, 2)).astype(np.float32) for w in (1, 2, 3)]
    got = toxicity.pooled(e, off, filters)
    for i, (a, b) in enumerate(zip(off, off[1:])):
        for c, f in enumerate(filters):
            room = [sum(e[p + j] @ f[j] for j in range(len(f))) for p in range(a, b - len(f) + 1)]
            assert np.allclose(got[i, 2 * c : 2 * c + 2], np.max(room, 0) if room else -1e9, atol=1e-5)


# ---- 5


def xx(shard, key):
    import struct

    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<i", sharding.SEED), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
    return xxhash.xxh64_intdigest(key.encode(), h)


def test_sharding_law(spark, docs, empty):
    out = sharding.shard_report(clashing(docs)).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(out) == docs.count()
    for x in out.itertuples():
        assert x.size == len(texts[x.doc_id].encode()) + 8 and x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) and x.law == "key"
        bids = [-1 / math.log(((xx(s, str(x.doc_id)) >> 11) + 0.5) / 2**53) for s in range(25)]
        assert x.shard == int(np.argmax(bids[:24])) and x.grown_shard == int(np.argmax(bids))
        assert x.grown_shard in (x.shard, 24)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard_report(empty).isEmpty()


def test_weights(spark):
    df = spark.range(20_000).select(sharding.shard_of(F.col("id"), [1.0, 0.0, 3.0]).alias("s"), sharding.shard_of(F.col("id"), [1.0, 1.0, 3.0]).alias("t"))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert set(n) == {0, 2} and 2.7 < n[2] / n[0] < 3.3
    assert df.where("s <> t AND t <> 1").isEmpty()
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [0.0])


def test_shard_files(spark, docs, tmp_path):
    sharding.write_shards(docs, "doc_id", [1.0] * 3, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# ---- 6


def test_leaks(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(800)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(15, 50)))) for i in range(20)] + [(90, "six words that stand quite alone"), (91, "too short"), (92, None), (93, "")]
    rows, want = [], set()
    for i in range(300):
        words = r.choices(vocabulary, k=r.randrange(30, 120))
        if i % 5 == 0:
            k = r.randrange(20)
            passage = items[k][1].split()
            for _ in range(len(passage) // 12):  # substitutions, some way apart
                passage[r.randrange(len(passage))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = [w.upper() if i % 2 else w + "!!" for w in passage]
            want.add((i, k))
        rows.append((i, " ".join(words)))
    rows += [(900, "He said: six words that stand quite alone."), (901, None), (902, ""), (903, "too short"), (904, rows[0][1]), (904, rows[0][1])]
    want |= {(900, 90), *((904, k) for d, k in want if d == 0)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(clashing(df), bench).toPandas()
    found = set(zip(got["doc_id"], got["item_id"]))
    assert not found - want and len(want - found) <= 0.03 * len(want)
    assert (got["n_same"] >= 0.8 * got["n_words"]).all()
    kept = decontamination.without_leaks(clashing(df), bench)
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in rows} - {d for d, _ in found} and kept.columns == clashing(df).columns
    assert decontamination.leaks(df, bench.where("false")).isEmpty() and decontamination.without_leaks(df.where("false"), bench).isEmpty()


def test_items_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(20))) for i in range(9)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("begin here "), "text").alias("text"))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 50)
    assert len(list(decontamination.blocks(items, "item_id", "text"))) == 5
    got = decontamination.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in got) == [(i, i, 2, 0, 20) for i in range(9)]


def test_long_texts_of_few_words_leak_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "CHUNK", 1 << 14)
    items = spark.createDataFrame([(1, "x " * 400), (2, "x y " * 100), (3, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 20_000), (2, "x y " * 10_000), (3, "z " * 30_000 + " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_word, r.n_words, r.n_same) for r in decontamination.leaks(docs, items).collect()}
    assert got[1, 1][1:] == (400, 400) and got[2, 2][1:] == (200, 200) and got[3, 3] == (30_000, 30, 30)


def test_all_diagonals_by_brute_force(spark):
    """Few words, so that hits abound: the leaks are those of a search of every diagonal."""
    r = random.Random(4)
    items = [(i, [r.choice("abcdefgh") for _ in range(r.randrange(5, 30))]) for i in range(12)]
    docs = []
    for i in range(40):
        words = [r.choice("abcdefghijkl") for _ in range(r.randrange(0, 60))]
        part = list(r.choice(items)[1])
        for _ in range(r.randrange(4)):
            part[r.randrange(len(part))] = "z"
        docs.append((i, words[:20] + part + words[20:]))
    want = set()
    for i, t in docs:
        for j, own in items:
            least = min(decontamination.LEAST, len(own))
            for d in range(-len(own), len(t)):
                same = [t[a + d] == own[a] for a in range(max(0, -d), min(len(own), len(t) - d))]
                if any(5 * sum(same[a:b]) >= 4 * (b - a) for a in range(len(same)) for b in range(a + least, len(same) + 1)):
                    want.add((i, j))
    got = decontamination.leaks(*(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{key} long, text string") for rows, key in ((docs, "doc_id"), (items, "item_id")))).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(want) > 20


def test_any_stretch_with_four_fifths_leaks(spark):
    """Every way to substitute a fifth of short items, and the same of some places in longer ones; one word more is no leak."""
    rng = random.Random(8)
    items, docs, want = [], [], set()

    def put(n, places, leak):
        words = [f"i{len(items)}x{j}" for j in range(n)]
        text = [f"other{j}" if j in places else w for j, w in enumerate(words)]
        if leak:
            want.add(len(items))
        docs.append((len(items), f"before it {' '.join(text)} after it"))
        items.append((len(items), " ".join(words)))

    put(16, {3, 12}, True)
    for n, k in ((5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (15, 3)):
        for places in itertools.combinations(range(n), k):
            put(n, places, True)
    for n, k in ((18, 3), (20, 4), (24, 4), (30, 6), (60, 12)):
        for _ in range(60):
            put(n, set(rng.sample(range(n), k)), True)
    for n, k in ((5, 2), (9, 2), (11, 3), (12, 3)):
        for places in itertools.combinations(range(n), k):
            put(n, places, False)
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.item_id for r in got} == want and all(r.doc_id == r.item_id for r in got)
    assert all(5 * r.n_same >= 4 * r.n_words for r in got)


# ---- 7


def test_licenses(spark, docs, empty):
    lines = [t for _, t in license_scan.TEMPLATES]
    rows = [(i, f"{' '.join(f'pre{j}' for j in range(i % 9))}\n({lines[i % len(lines)].upper()})\n{' '.join(f'post{j}' for j in range(i % 7))}") for i in range(300)]
    rows += [(900, None), (901, ""), (902, "the MIT License"), (903, "a " * 20_000 + lines[4]), (904, lines[0] + " " + lines[3]), (904, lines[0])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.template_id) for r in license_scan.scan(df, license_scan.default_templates(spark)).collect()}
    names = [n for n, _ in license_scan.TEMPLATES]
    want = {(i, names[i % len(lines)]) for i in range(300)} | {(903, names[4]), (904, names[0]), (904, names[3])}
    assert got == want
    assert license_scan.scan(empty, license_scan.default_templates(spark)).isEmpty()
    assert license_scan.scan(docs, spark.createDataFrame([("x", "too short"), (None, "y")], "template_id string, text string")).isEmpty()


def test_licence_bodies_and_short_notices(spark):
    body = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    bsd = next(t for n, t in license_scan.TEMPLATES if n == "BSD")
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    texts = {
        1: ("(c) 2020 A. Author\n\n" + body, {"MIT"}),
        2: ("x " * 500 + body.replace("persons", "people").replace("AUTHORS", "MAKERS") + " y" * 500, {"MIT"}),
        3: (body[: len(body) // 2], set()),
        4: ("Some text. This software is licensed under the MIT License.", {"MIT"}),
        5: ("(c) Them. ALL RIGHTS\n reserved", {"All-rights-reserved"}),
        6: ("overall rights reserved, all rights are reserved", set()),
        7: ("one two // SPDX-License-Identifier: MIT", {"MIT"}),
        8: (f"All rights reserved. {bsd} Neither the name of the Firm nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"All-rights-reserved", "BSD", "BSD-3-Clause"}),
        9: (gpl.format("", 2), {"GPL-2.0"}),
        10: (gpl.format("", 3), {"GPL-3.0"}),
        11: (gpl.format("Lesser ", "2.1"), {"LGPL-2.1"}),
        12: (gpl.format("Affero ", 3), {"AGPL-3.0"}),
        13: ("A Creative Commons word: this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"CC-BY-NC-4.0"}),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = license_scan.scan(df, license_scan.default_templates(spark)).collect()
    assert {(r.doc_id, r.template_id) for r in got} == {(i, n) for i, (_, names) in texts.items() for n in names}
    assert {r.doc_id: r.first_word for r in got if r.doc_id in (5, 7)} == {5: 2, 7: 2}


def test_containment_by_brute_force(spark):
    """Every stretch of three template lengths around each place of a text, held against each template, with words left out, put in and changed."""
    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    templates = [(f"t{i}", r.choices(vocabulary, k=n)) for i, n in enumerate((5, 6, 8, 11, 15, 16, 17, 20, 30, 60, 150))]
    docs = []
    for i in range(50):
        words = list(r.choice(templates)[1])
        for _ in range(r.choice((0, 0, 1, 1, len(words) // 20, len(words) // 8))):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = [f"x{i}"] * r.randrange(2)
        docs.append((i, r.choices(vocabulary, k=r.randrange(40)) + words + r.choices(vocabulary, k=r.randrange(40))))

    def grams(w):
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    best = {(i, n): max((len(grams(own) & grams(w[max(0, at) : at + 3 * len(own)])) / len(grams(own)) for at in range(-len(own), len(w))), default=0) for i, w in docs for n, own in templates}
    whole = {(i, n): len(grams(own) & grams(w)) / len(grams(own)) for i, w in docs for n, own in templates}
    got = {(x.doc_id, x.template_id): x.containment for x in license_scan.scan(*(spark.createDataFrame([(a, " ".join(w)) for a, w in rows], f"{key}, text string") for rows, key in ((docs, "doc_id long"), (templates, "template_id string")))).collect()}
    assert {x for x, c in best.items() if c >= 0.8} <= set(got) and all(0.8 <= c <= whole[x] for x, c in got.items()) and len(got) > 25


def test_templates_of_thousands_of_words(spark):
    r = random.Random(13)
    body = [r.choice("the of licence work party grant notice") + str(r.randrange(900)) for _ in range(5_600)]
    other = [f"q{r.randrange(5_000)}" for _ in range(20_000)]
    worn = [w if r.random() > 0.02 else "gone" for w in body]
    docs = spark.createDataFrame([(1, " ".join(other + body + other)), (2, " ".join(other[:77] + worn)), (3, " ".join(body[:4_000])), (4, " ".join(other))], "doc_id long, text string")
    plan = license_scan.scan(docs, spark.createDataFrame([("L", " ".join(body))], "template_id string, text string"))
    assert {x.doc_id: x.template_id for x in plan.collect()} == {1: "L", 2: "L"}
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


def test_edited_notice(spark):
    text = "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in it without restriction and so on"
    t = spark.createDataFrame([("P", text)], "template_id string, text string")
    edited = text.replace("restriction", "limit")
    gone = " ".join(w if i % 4 else "other" for i, w in enumerate(text.split()))
    df = spark.createDataFrame([(1, "x y z " + edited), (2, gone), (3, text[: len(text) // 2])], "doc_id long, text string")
    got = license_scan.scan(df, t).collect()
    assert [r.doc_id for r in got] == [1] and 0.8 <= got[0].containment < 1


# ---- 8


def brute_top(rows, k):
    out = set()
    q = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for i in q:
        if i % 5 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i])))[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_exact_top_k(spark, block, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)] + [(100 + i, [0.5] * 8) for i in range(40)]
    rows += [(200, None), (205, [1.0, None] + [0.0] * 6), (210, [math.nan] * 8), (215, [math.inf] * 8), (220, [1.0, 2.0]), (221, [3.0, 1.0]), (222, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine")).repartition(4)
    monkeypatch.setattr(topk, "BINS", 7)
    got = topk.top_k(df, "vec_id % 5 = 0", 5, block=block)
    assert {tuple(x) for x in got.collect()} == brute_top([x for x in rows if x[0] != 222], 5)
    assert topk.top_k(df.where("false"), "true", 5).isEmpty()


def test_huge_components_keep_their_order(spark):
    rows = [(i, [float(2**40 + i), float(-i)]) for i in range(12)] + [(20, [1e18, 3.0]), (21, [-1e18, 1e150]), (22, [1e160, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 5 = 0", 3).collect()
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for i in (0, 5, 10, 20):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:3]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == [(n, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(best, 1)]


# ---- 9


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_files(spark, docs, empty, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    odd = [(2000, "tabs\tand  double  spaces \n new\nlines "), (2001, " lead"), (2002, "x y 　z  w"), (2003, "<|endoftext|> stays"), (2006, "so <|endoftext|> does<|endoftext|>this <|endoftext|>"), (2004, "ñ é à ü €10 日本 語"), (2005, "don't we'll  'tis")]
    df = docs.where("doc_id <> 1004").unionByName(spark.createDataFrame([(i, x, "en", "s", 1) for i, x in odd], DOCS))
    got = token_files.token_report(clashing(df), tokenizer).toPandas().sort_values("doc_id")
    assert t.encode("<|endoftext|> stays", add_special_tokens=False).ids[0] == 50256
    start = 0
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(got) == len(texts)
    for x in got.itertuples():
        ids = np.array([*t.encode(texts[x.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_report(empty, tokenizer).isEmpty()


def test_rows_that_share_an_id_are_documents(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rows = [(3, "one text"), (3, "another text"), (3, "one text"), (None, "no id"), (None, "none here"), (1, "first")]
    got = token_files.token_report(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer).collect()
    want = collections.Counter((i, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, x in rows)
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, None, 1, 3, 3, 3] and all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))


def test_many_files_and_null_keys(spark, tokenizer, tmp_path):
    df = spark.createDataFrame([(None, "no key")] + [(i, f"text number {i} " * 5) for i in range(50)], "doc_id long, text string")
    manifest = token_files.write_tokens(df, f"file://{tmp_path}/t", tokenizer, file_ids=40)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_docs")).first()[0] == 51
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *range(50)]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_block_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 60_000, n), np.where(r.random(n) < 0.05, 2**32 - 1, r.integers(0, 9, n)), np.full(n, 7), r.integers(0, 2**32, n)):
        ids = ids.astype(np.uint32)
        sizes = np.array([n, 0])
        f = token_files.TokenFile(token_files.file_bytes(ids, np.array([5, -6]), np.array([1, 1]), sizes))
        assert np.array_equal(f.ids(), ids) and list(f.keys) == [5, -6] and list(f.sizes) == [n, 0]
        for a, b in ((0, 5), (100, 300), (n // 2, n), (n, n + 4)):
            assert np.array_equal(f.ids(a, b), ids[a:b])


# ---- 10


def brute_classes(rows, k, percent):
    s = {}
    for i, t in rows:
        w = split(t)
        s[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    top = {i: i for i in s}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(s, 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("k, percent, above, limit, crowded", [(3, 90, 12, 1 << 21, 256), (3, 90, 1, 1 << 21, 4), (5, 80, 2, 1 << 21, 4), (2, 88, 0, 1 << 21, 1), (3, 85, 1, 20, 20)])
def test_jaccard_classes(spark, docs, k, percent, above, limit, crowded):
    r = random.Random(11)
    base = " ".join(f"b{j}" for j in range(60)).split()
    near = []
    for i in range(60):  # a large group of near copies, with chains beyond one link
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"e{r.randrange(400)}"
        near.append((3000 + i, " ".join(w), "en", "s", 1))
    df = docs.unionByName(spark.createDataFrame(near, DOCS))
    got = jaccard_join.link_components(clashing(df), k, percent, above=above, limit=limit, crowded=crowded).toPandas()
    want = brute_classes([(x.doc_id, x.text) for x in df.collect()], k, percent)
    assert len(got) == df.count()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got.itertuples()} == {(i, *v) for i, v in want.items()}


def test_jaccard_on_awkward_tables(spark, empty):
    assert jaccard_join.link_components(empty, 3, 90).isEmpty()
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (4, "A B C D"), (7, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(df, 3, 90).collect()}
    assert got == {(None, 2, None), (5, 2, 4), (4, 2, 4), (7, 0, 7)}
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(df).collect()) == ["4", "7", "None"]
    with pytest.raises(ValueError):
        jaccard_join.link_components(df, 3, 50)


def test_repeated_near_copies_and_ids(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    a, b, other = " ".join(words), " ".join([*words[:39], "x"]), "none of the words above stand in here"
    df = spark.createDataFrame([(1, a), (2, b)] * 10 + [(2, other)], "doc_id long, text string")
    seen = []
    real = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda *x: seen.append(real(*x).count()) or real(*x))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(df, 3, 90).collect())
    assert got == {(1, 38, 1): 10, (2, 38, 1): 10, (2, 6, 2): 1} and sum(seen) == 1  # repeats meet once

    def left(rows):
        out = jaccard_join.one_of_each(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
        return sorted((r.doc_id, r.text) for r in out.collect())

    assert left([(4, a), (5, a), (5, other)]) == [(4, a), (5, other)]
    assert left([(4, a), (4, a)]) == [(4, a)]
    assert left([(4, a), (4, b), (3, other), (3, other)]) in ([(3, other), (4, a)], [(3, other), (4, b)])
    assert len(left([(1, ""), (1, "")])) == 2


def test_near_copies_meet_once(spark):
    """Every member of a group of near copies shares most keys with every other; pairs still meet once each."""
    r = random.Random(5)
    base = [f"b{j}" for j in range(200)]
    rows = []
    for i in range(80):
        w = list(base)
        for j in r.sample(range(200), 16):
            w[j] = f"e{i}.{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = jaccard_join.link_components(df, 3, 90).toPandas()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in linked.itertuples()} == brute_classes(rows, 3, 90)


def test_buckets_of_the_same_sets_meet_once(spark):
    """Forty buckets of the same six sets and two that hold some of them: a row for each set and different bucket, and each pair once."""
    posts = [(k, node) for k in range(-20, 20) for node in range(6)] + [(90, node) for node in range(3)] + [(91, 4), (91, 5)]
    buckets = spark.createDataFrame(posts, "key long, node long")
    classes = spark.createDataFrame([(i, i, i) for i in range(6)], "sig long, doc_id long, component long")
    sets = spark.createDataFrame([(i, 100, 100, *[0] * jaccard_join.SHORT) for i in range(6)], f"sig long, n long, m long, {', '.join(f'{q} long' for q in jaccard_join._Q)}")
    apart = jaccard_join.still_apart(buckets, classes, sets)
    assert collections.Counter(r.key for r in apart.collect()) == {-20: 6, 90: 3, 91: 2}
    pairs = jaccard_join.meeting(apart, 90)
    assert sorted((r.a, r.b) for r in pairs.collect()) == list(itertools.combinations(range(6), 2))


def test_runs_of_common_shingles_are_long_enough():
    for percent in (80, 85, 88, 90, 95, 100):
        k = jaccard_join.longest(percent)
        for n in range(1, 400):
            lacks = int(jaccard_join.slack(np.array([n]), percent)[0])
            other = n * (100 - percent) // percent  # what a linked set has besides, at most
            if lacks + other:
                assert n - lacks >= (k - 1) * (lacks + other + 1) + 1


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 48, r.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 48, r.integers(0, 40), dtype=np.uint64)]))
        if not len(b):
            continue
        x, y = jaccard_join.parity_bits(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert jaccard_join.bits_apart(x, y) <= len(np.setxor1d(a, b))


def test_runs_round_trip():
    r = np.random.default_rng(2)
    for x in (np.unique(r.integers(0, 1 << 48, 500, dtype=np.uint64)), np.arange(5, dtype=np.uint64), np.array([9], np.uint64), np.array([1, 1 << 40], np.uint64)):
        n = r.integers(1, 4, len(x))
        y, m = jaccard_join.unpack_ascending(jaccard_join.pack_ascending(x, n))
        assert np.array_equal(x, y) and np.array_equal(n, m)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    assert got == {x: find(x) for x in top}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_rounds_name_their_edges_seldom(spark, monkeypatch):
    scans = []

    def spy(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return written(df, name)

    written = components.written
    monkeypatch.setattr(components, "written", spy)
    edges = written(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), "edges")
    out = components.components(edges)
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in range(41)}
    assert max(scans) <= 2  # 12 when a round was one plan
