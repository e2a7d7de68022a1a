"""Toxicity and language model: exact neighbours, held-out accuracy, defined edges."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from editforge.llm import lm_score, toxicity

SCHEMA = "doc_id long, text string, score int, evidence string"


@pytest.mark.parametrize("least,common", [(0.0, 0.0), (0.0, 0.6), (0.5, 0.5), (0.9, 1.0)])
def test_nearest_equals_all_cosines(least, common):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(500):
        terms = np.unique(rng.zipf(1.5, rng.integers(1, 12)) % 60)
        w = rng.random(len(terms)) + 0.05
        rows.append((terms.astype(np.int64), w / np.sqrt(w @ w)))
    rows[40:60] = rows[:20]  # ties
    e = toxicity.Examples(list(range(500)), rng.integers(0, 2, 500).tolist(), [len(t) for t, _ in rows], np.concatenate([t for t, _ in rows]),
                          np.concatenate([w for _, w in rows]), 60, least, common)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for i in range(0, 500, 7):
        places, cosines = e.nearest(*rows[i], 16)
        cos = dense @ dense[i]
        want = sorted((-round(min(c, 1.0), 12), j) for j, c in enumerate(cos) if c > 0 and c >= least - 1e-9)[:16]
        assert [-round(c, 12) for c in cosines.tolist()] == [c for c, _ in want]
        if want:
            assert {int(e.ids[p]) for p, c in zip(places, cosines) if -round(c, 12) < want[-1][0]} == {j for c, j in want if c < want[-1][0]}


def labelled(spark, n=900):
    rng = random.Random(3)
    clean, bad = [f"clean{i}x" for i in range(300)], ["vileword", "nastier", "grossly"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [rng.choice(clean) for _ in range(rng.randint(20, 300))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", ",", "."]))
        docs.append((i, " ".join(words), 0, ""))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    docs += [(n, "", 0, ""), (n + 1, None, 0, ""), (None, docs[0][1], 0, ""), (n + 2, docs[0][1], 0, ""), (n + 3, "clean0x " * 100_000, 0, "")]
    labels += [(None, 1, 0), (1, None, 0), (10 ** 9, 1, 0)]
    return spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_held_out_accuracy_and_edges(spark):
    documents, labels = labelled(spark)
    model = toxicity.fit(documents, labels)
    got = {r["doc_id"]: r for r in toxicity.score(documents, model).collect()}
    assert len(got) == documents.count()
    for i in range(900):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            assert got[i]["predicted"] == int(i % 8 == 0), (i, got[i]["score"])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0 == got[903]["predicted"]
    assert got[None]["score"] == got[0]["score"] == got[902]["score"]
    top = got[8]["evidence"][0]
    assert top["label"] == 1 and top["cosine"] > 0.5
    learnt = {e["id"] for r in got.values() for e in r["evidence"]}
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in learnt)


def test_held_out_labels_change_nothing(spark):
    documents, labels = labelled(spark, 400)
    other = labels.where(~toxicity.held_out())
    score = lambda l: sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.score(documents, toxicity.fit(documents, l)).collect())
    assert score(labels) == score(other)


def test_balanced_labels_and_copies_without_telling_terms(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):  # half of the labelled rows are toxic
        words = [f"clean{rng.randrange(300)}x" for _ in range(rng.randint(20, 100))] + ["vileword"] * (i % 2)
        docs.append((i, " ".join(words), 0, ""))
        labels.append((i, i % 2))
    rare = lambda d: " ".join(f"rare{d}n{k}" for k in range(30))
    learnt = [d for d in range(1000, 1100) if zlib.crc32(str(d).encode()) % 4 != 2][:6]
    for n, d in enumerate(learnt):  # toxic and clean ones of words that stand nowhere else, and a copy of each
        docs += [(d, rare(d), 0, ""), (d + 1000, rare(d), 0, "")]
        labels.append((d, n % 2))
    documents, labels = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(documents, toxicity.fit(documents, labels)).collect()}
    for i in range(600):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            assert got[i]["predicted"] == i % 2, (i, got[i]["score"])
    for n, d in enumerate(learnt):
        assert got[d + 1000]["predicted"] == n % 2 and got[d + 1000]["evidence"][0]["id"] == d and got[d + 1000]["evidence"][0]["cosine"] > 0.999


def test_without_labels_or_rows(spark):
    documents, labels = labelled(spark, 20)
    assert {r["score"] for r in toxicity.score(documents, toxicity.fit(documents, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(documents.limit(0), toxicity.fit(documents.limit(0), labels)).count() == 0
    pure = toxicity.fit(documents, labels.where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score(documents, pure).collect())


def test_pseudo_likelihood_learns_order(spark):
    rng = random.Random(1)
    following = {f"a{i}": [f"a{(i * 7 + k) % 40}" for k in range(2)] for i in range(40)}

    def text(n):
        w = [f"a{rng.randrange(40)}"]
        while len(w) < n:
            w.append(rng.choice(following[w[-1]]))
        return w
    rows = [(i, " ".join(text(rng.randint(20, 400))), 0, "") for i in range(600)]
    fitted = lm_score.fit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    ordered = [text(100) for _ in range(50)]
    mixed = [rng.sample(w, len(w)) for w in ordered]
    tests = [(i, " ".join(w), 0, "") for i, w in enumerate(ordered + mixed)] + [(200, "", 0, ""), (201, None, 0, ""), (202, "zzz yyy", 0, ""), (203, " ".join(ordered[0]), 0, "")]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(tests, SCHEMA).withColumn("n_tokens", toxicity.F.lit("x")), fitted).collect()}
    assert np.mean([got[i]["mean_log_prob"] for i in range(50)]) > np.mean([got[i]["mean_log_prob"] for i in range(50, 100)]) + 0.5
    assert got[200]["n_tokens"] == 0 == got[201]["n_tokens"] and got[200]["log_prob"] == 0 and got[201]["mean_log_prob"] is None
    assert got[202]["mean_log_prob"] < got[0]["mean_log_prob"]
    assert abs(got[203]["log_prob"] - got[0]["log_prob"]) < 1e-3
    assert got[0]["log_prob"] < 0 and abs(got[0]["log_prob"] / got[0]["n_tokens"] - got[0]["mean_log_prob"]) < 1e-9
    empty = spark.createDataFrame([], SCHEMA)
    assert lm_score.score(empty, lm_score.fit(empty)).count() == 0


def plain_sum(scorer, counts, words):
    """A document's sum, token by token; ``counts`` are those of the corpus by word hash."""
    p = {k: v.astype(float) for k, v in lm_score.unpack(scorer.flat).items()}
    number = dict(zip(scorer.keys.tolist(), scorer.places.tolist()))
    rest, edge = lm_score.VOCABULARY - 1, [lm_score.VOCABULARY] * lm_score.REACH
    ids = edge + [number.get(w, rest) for w in words] + edge
    others = sum(n + 1 for w, n in counts.items() if w not in number) + 1
    total = 0.0
    for i, w in enumerate(words):
        at = i + lm_score.REACH
        around = [ids[at + o] for o in range(-lm_score.REACH, lm_score.REACH + 1) if o]
        h = np.tanh(p["bias"] + sum(p["embed"][t] * p["place"][k] for k, t in enumerate(around)))
        c, j = divmod(ids[at], lm_score.CLASSES)
        one, two = h @ p["w1"] + p["b1"], (h + p["shift"][c]) @ p["w2"] + p["b2"][c]
        total += one[c] - np.log(np.exp(one).sum()) + two[j] - np.log(np.exp(two).sum())
        if ids[at] == rest:
            total += np.log((counts.get(w, 0) + 1) / others)
    return total


@pytest.mark.parametrize("held", [1 << 19, 4500, 0])
def test_sums_equal_a_plain_recomputation(spark, monkeypatch, held):
    """Words beyond the network's vocabulary score by their own counts, seen or unseen, in copies too, held in tasks or joined."""
    monkeypatch.setattr(lm_score, "HELD", held)
    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(4200)], [f"r{i}" for i in range(3000)]
    texts = [" ".join(common) + " " + " ".join(common)]
    texts += [" ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += texts[1:40] + ["", None, "  "]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    fitted = lm_score.fit(df)
    hashes = lambda t: lm_score.words(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))((t or "").encode()))[0].tolist()
    counts = Counter(w for t in texts for w in hashes(t))
    assert len(fitted.held[0]) <= held and (held < len(counts) or len(fitted.held[0]) == len(counts))
    assert dict(zip(fitted.held[0].tolist(), fitted.held[1].tolist())).items() <= counts.items()
    asked = texts[1:] + ["unseen words " + texts[3], "r1 " * 50]
    new = spark.createDataFrame([(i if i % 9 else None, t, i, "x") for i, t in enumerate(asked)], SCHEMA).withColumnRenamed("evidence", "_digest")
    got = {r["score"]: r for r in lm_score.score(new, fitted).collect()}
    assert len(got) == len(asked) and got[0]["_digest"] == "x"
    for i, t in enumerate(asked):
        words = hashes(t)
        assert got[i]["n_tokens"] == len(words)
        assert abs(got[i]["log_prob"] - plain_sum(fitted, counts, words)) < 1e-3 * (1 + len(words))
    once, often = Counter(counts), [w for w in rare if 0 < counts[hashes(w)[0]]]
    few, many = min(often, key=lambda w: once[hashes(w)[0]]), max(often, key=lambda w: once[hashes(w)[0]])
    pair = spark.createDataFrame([(0, few, 0, ""), (1, many, 0, "")], SCHEMA)
    scores = {r["doc_id"]: r["log_prob"] for r in lm_score.score(pair, fitted).collect()}
    assert scores[1] > scores[0]   # alike in their context, told apart by the corpus


def test_probabilities_sum_to_one_and_gradient_is_right():
    rng = np.random.default_rng(0)
    flat = lm_score.start(rng.random(lm_score.VOCABULARY) * 100)
    flat += rng.standard_normal(lm_score.SIZE).astype(np.float32) * 0.1
    p = lm_score.unpack(flat)
    p["embed"][-1] = 0
    ids = np.array([lm_score.VOCABULARY] * 3 + [5, 900, 4000, 77] + [lm_score.VOCABULARY] * 3)
    total = 0.0
    for w in range(lm_score.VOCABULARY):
        ids[4] = w
        total += np.exp(lm_score.log_probabilities(p, ids)[4])
    assert abs(total - 1) < 1e-3
    ids[4] = 900
    before = lm_score.log_probabilities(p, ids).sum()
    t = lm_score.Trainer(flat)
    for _ in range(20):
        t.step(ids)
    assert lm_score.log_probabilities(t.p, ids).sum() > before


def test_terms_of_pieces(monkeypatch):
    """Counts of whole pieces equal those word by word, whatever the piece."""
    rnd = random.Random(3)
    some = ["toxic", "tox", "abc", "straße", "字字", "istanbul", "a1b2c3d4e5", "longerword"]
    texts = [" ".join(rnd.choice(some) + rnd.choice(["", ".", "_x", "字。字", "\u00a0"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += ["", "İSTANBUL ΟΔΟΣ a_b__c 12ab１２ \u3000x", "x" * 5000 + " " + "y" * 9, "toxic " * 500]
    split = [[s for token in t.lower().split() for s in toxicity.word_terms(token)] for t in texts]
    vocabulary = sorted({s for ss in split for s in ss})
    told = {t: i for i, t in enumerate(rnd.sample(vocabulary, len(vocabulary) // 3))}
    plain = [s for s in vocabulary if not s.endswith("*")][::2]
    keys = toxicity.word_keys(plain)
    number = {w: int(np.searchsorted(keys, toxicity.Found([w]).whole()[0])) for w in plain}
    assert len(keys) == len(plain)
    for piece in (1 << 19, 50):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for every in (True, False):
            telling, words = toxicity.Terms(told, keys).count(texts, every)
            for i, ss in enumerate(split):
                want = Counter(told[s] for s in ss if s in told)
                assert dict(zip(*(x.tolist() for x in telling.of(i)))) == want
                assert dict(zip(*(x.tolist() for x in words.of(i)))) == (Counter(number[s] for s in ss if s in number) if every or not want else {})
