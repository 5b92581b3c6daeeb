import collections
import random

import numpy as np
import pytest

from selvage.llm import embedding_dedup, simhash, suffix_dedup


@pytest.mark.parametrize("words,radius", [(1, 2), (1, 5), (8, 60)])
def test_gray_index_against_all_pairs(words, radius):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 2**63, (40, words), dtype=np.uint64)
    prints = [base]
    for _ in range(6):
        flip = base.copy()
        for row in flip:
            for b in rng.integers(0, 64 * words, radius // 2 + 1):
                row[b // 64] ^= np.uint64(1 << int(b % 64))
        prints.append(flip)
    prints = np.unique(np.concatenate(prints), axis=0)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= radius
    low = np.arange(len(prints))
    while True:
        new = np.array([low[near[i]].min() for i in range(len(prints))])
        if (new == low).all():
            break
        low = new
    assert (simhash.link_forest(prints, radius) == low).all()


def test_hot_keys_are_dealt_out_without_loss(spark):
    rng = random.Random(1)
    prints = {0}
    while len(prints) < 400:
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    parts = []
    for most in (5, 10_000):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in simhash.radius_links(df, 2, most).collect():
            assert ((r["a"] ^ r["b"]) & (1 << 64) - 1) >= 0
            root[find(r["a"])] = find(r["b"])
        groups = collections.defaultdict(set)
        for x in signed:
            groups[find(x)].add(x)
        parts.append(sorted(map(sorted, groups.values())))
    assert parts[0] == parts[1]


def test_simhash_odd_rows(odd, none):
    got = [(r["id"], r["component_id"]) for r in simhash.near_components(odd).collect()]
    assert len(got) == 11 and ({c for i, c in got if i in (2, 3, 4)} == {2}) and {c for i, c in got if i in (6, 7)} == {6}
    assert simhash.near_components(none).count() == 0
    kept = simhash.drop_similar(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
    assert simhash.drop_similar(none).count() == 0


def test_drop_similar_by_jaccard(spark):
    """Copies with a few words changed go, texts that only share some passages stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, expected = [], []
    for g in range(40):
        base = [word() for _ in range(300)]
        docs.append((len(docs), " ".join(base)))
        expected.append(docs[-1][0])
        for _ in range(3):
            copy = list(base)
            for k in rng.sample(range(300), 3):
                copy[k] = word()
            docs.append((len(docs), " ".join(copy)))
        half = base[:150] + [word() for _ in range(150)]
        docs.append((len(docs), " ".join(half)))
        expected.append(docs[-1][0])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(df).collect()) == expected


def jaccard_groups(texts, width=5, least=0.8):
    """The first of each group of texts, by all pairs of their shingle sets."""
    sets = [{" ".join(t.split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return sorted(set(label))


@pytest.mark.parametrize("most", [6, 8192])
def test_drop_similar_near_the_limit(spark, most):
    """Pairs, chains and large families just below and above a similarity of 0.8 against all pairs of sets."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for g in range(120):
        n = rng.choice([4, 5, 9, 40, 104, 204])
        base = [word() for _ in range(n + 4)]
        texts.append(" ".join(base))
        last = base
        for _ in range(1 if g % 4 else 14):
            k = max(1, round(n * rng.uniform(0.14, 0.34)) // 2)
            last = (base if g % 8 else last)[k:] + [word() for _ in range(k * rng.randint(0, 1))]
            texts.append(" ".join(last if len(last) > 4 else base[1:]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(df, most=most).collect()) == jaccard_groups(texts)


@pytest.mark.parametrize("low,least,most", [(0.76, 0, 0), (0.80, 0.99, 1), (0.85, 0.99, 1), (0.90, 0.99, 1)])
def test_recall_of_near_copies_by_similarity(spark, low, least, most):
    """Pairs of texts of 300 words: of those at 0.8 and more all but some ten thousandths are found, below it none."""
    rng = random.Random(int(low * 100))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    while len(texts) < 600:
        base = [word() for _ in range(300)]
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(300)] = word()
        a, b = ({tuple(t[i : i + 5]) for i in range(296)} for t in (base, copy))
        if low <= len(a & b) / len(a | b) < low + (0.04 if low < 0.8 else 0.05):
            texts += [" ".join(base), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    gone = 600 - simhash.drop_similar(df).count()
    assert least * 300 <= gone <= most * 300


def test_drop_similar_repeated_passages(spark):
    """A passage that texts repeat counts once: it makes no near copies of clean texts and hides none."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(24)]
    texts = []
    for g in range(30):
        own = [word() for _ in range(64)]
        texts.append(" ".join(own + passage * rng.randint(5, 10)))
        if g % 3 == 0:
            texts.append(" ".join(own + passage * 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(df).collect()) == jaccard_groups(texts)


def brute(texts, length):
    count = collections.Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        on = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                on[s : s + length] = True
        out.append((int(on.sum()), np.frombuffer(t, np.uint8)[~on].tobytes() if t else b""))
    return out


@pytest.mark.parametrize("most", [2, 10_000])
def test_repeats_against_brute_force(spark, most):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = [letters(rng.randint(20, 90)) for _ in range(6)]
    texts = [None, "", "a" * 300, "ab" * 200, letters(30), letters(30)]
    for _ in range(60):
        texts.append("".join(rng.choice([letters(rng.randint(1, 40)), rng.choice(shared), rng.choice(shared)[5:], "é" * rng.randint(0, 30)]) for _ in range(5)))
    texts += texts[10:14]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["id"]: r for r in suffix_dedup.remove_repeats(df, length=40, core=12, most=most).collect()}
    for i, (n, kept) in enumerate(brute([(t or "").encode() for t in texts], 40)):
        assert (got[i]["n_removed"], bytes(got[i]["kept"])) == (n, kept), i


def test_repeats_of_one_core_in_many_surroundings(spark):
    """Thousands of surroundings of one passage: groups are cut into deeper intervals again and again."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passage = letters(36)
    texts = [letters(rng.randint(0, 12)) + passage[rng.randint(0, 4) : rng.randint(30, 36)] + letters(rng.randint(0, 12)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["id"]: r for r in suffix_dedup.remove_repeats(df, length=40, core=20, most=16).collect()}
    for i, (n, kept) in enumerate(brute([t.encode() for t in texts], 40)):
        assert (got[i]["n_removed"], bytes(got[i]["kept"])) == (n, kept), i


def test_strings_that_only_hash_alike_stay(spark):
    """Thue-Morse strings and their complements collide in polynomial hashes modulo a power of two, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(256)]
    block, other = ("".join("u'"[b ^ x] for b in bits) for x in (0, 1))
    rng = random.Random(2)
    texts = []
    for _ in range(50):
        middle = "".join(rng.choice("abcdefgh") for _ in range(128))
        texts += [block + middle + other, other + middle + block]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [n for n, _ in brute([t.encode() for t in texts], 400)]
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(df).orderBy("id").collect()] == want == [0] * 100


def test_interval_tree_is_all_intervals():
    lcp = np.array([0, 3, 3, 1, 2, 0, 4])
    assert sorted(suffix_dedup.intervals(lcp)) == sorted([(3, 0, 2), (2, 3, 4), (1, 0, 4), (4, 5, 6), (0, 0, 6)])


def test_repeats_odd_rows(odd, none):
    got = {r["id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(odd).collect()}
    assert len(got) == 10 and got[5] > 100_000 and got[2] == 0 and got[6] == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most", [8, 4096])
def test_embeddings_against_all_pairs(spark, most):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 20))
    x = np.concatenate([base, *(base + rng.normal(size=base.shape) * s for s in (0.05, 0.1, 0.2, 0.3)), base[:5]])
    label = rng.integers(0, 2, len(x))
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 20, 0), (903, [float("nan")] + [1.0] * 19, 0), (904, [None] + [1.0] * 19, 0), (905, rows[0][1], None), (None, rows[0][1], rows[0][2]), (906, [1.0] * 7, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r for r in embedding_dedup.near_components(df, most=most).collect()}
    u = np.concatenate([x, x[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.r_[label, label[0]]
    near = (u @ u.T >= 0.93) & (lab[:, None] == lab[None])
    found = sum(got[i]["n_links"] for i in range(len(x))) + got[None]["n_links"]
    true = near.sum() - len(u)
    assert 0.97 * true <= found <= true
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[0]["n_links"] >= 1 and got[None]["component_id"] == got[0]["component_id"]
    assert embedding_dedup.near_components(df.where("false")).count() == 0
