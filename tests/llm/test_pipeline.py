"""The pipeline's stages, each against brute force on what the stage before kept."""

import functools

import numpy as np
from test_line_dedup import brute_force as repeats
from test_ngram_join import brute_force as groups
from test_texts import TOKENIZER, check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from editforge.llm import toxicity

SF = "/root/testdata/sf0.001"


def plain_scores(model, texts):
    """Scores by comparing every text with every example: by its telling terms, else by all its words."""
    def rows(e):
        out = np.zeros((len(e.ids), e.n_terms))
        for i, (a, b) in enumerate(zip(e.ends[:-1], e.ends[1:])):
            out[i, e.terms[a:b]] = e.weights[a:b]
        return out

    def nearest(e, dense, counts, idf):
        q = np.zeros(e.n_terms)
        for t, n in counts.items():
            q[t] = (1 + np.log(n)) * idf[t]
        cos = np.minimum(dense @ (q / np.sqrt(q @ q)), 1.0)
        best = [i for i in np.lexsort((e.ids, -np.round(cos, 12))) if cos[i] > 0 and cos[i] >= e.least - 1e-9][: toxicity.NEIGHBOURS]
        return cos[best] ** 2, e.labels[best]
    told, whole = rows(model.examples), rows(model.whole)
    number = {k: i for i, k in enumerate(model.words.tolist())}
    key = functools.cache(lambda word: int(toxicity.Found([word]).whole()[0]))
    out = []
    for t in texts:
        counts, words = {}, {}
        for token in (t or "").lower().split():
            for s in toxicity.word_terms(token):
                if s in model.numbers:
                    counts[model.numbers[s]] = counts.get(model.numbers[s], 0) + 1
                if not s.endswith("*") and (w := number.get(key(s))) is not None:
                    words[w] = words.get(w, 0) + 1
        if counts:
            near, label = nearest(model.examples, told, counts, model.idf)
            out.append(float(np.interp((near @ label + toxicity.PRIOR_WEIGHT * model.base) / (near.sum() + toxicity.PRIOR_WEIGHT), *model.knots)))
        elif words:
            near, label = nearest(model.whole, whole, words, model.word_idf)
            near = near / (1.01 - near)
            out.append(float((near @ label + toxicity.PRIOR_WEIGHT * model.empty) / (near.sum() + toxicity.PRIOR_WEIGHT)))
        else:
            out.append(model.empty)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    extra = [(5000, rows[1]["text"] + " tail", "en", "x", 1), (5001, None, "en", "x", 0), (None, "no key", "en", "x", 6)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    scores = dict(zip(rows, plain_scores(model, [r["text"] for r in rows.values()])))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[d] - scores[d]) < 1e-9 for d in rows)
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("toxicity", "line_dedup", "ngram_join", "packing")

    clean = corpus_pipeline.materialize(stages[0](spark, docs, SF), "t1")
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d in rows if scores[d] < toxicity.THRESHOLD}

    kept = clean.collect()
    lines = corpus_pipeline.materialize(stages[1](spark, clean, SF), "t2")
    assert lines.columns == docs.columns
    gone = {d: g for (d, _), g in repeats([(r["doc_id"], r["text"]) for r in kept]).items()}
    after = {r["doc_id"]: r for r in lines.collect()}
    for r in kept:
        words, cut = (r["text"] or "").encode().split(), gone.get(r["doc_id"], set())
        left = [w for i, w in enumerate(words) if i not in cut]
        if cut and not left:
            assert r["doc_id"] not in after
        else:
            new = after[r["doc_id"]]
            assert (new["text"] or "").encode().split() == left
            assert new == r if not cut else new["n_chars"] == len(new["text"])

    single = corpus_pipeline.materialize(stages[2](spark, lines, SF), "t3")
    assert single.columns == docs.columns
    of = {d: c for d, _, c in groups([(d, r["text"]) for d, r in after.items() if d is not None], 5, 8, 10)}
    assert sorted(r["doc_id"] for r in single.collect() if r["doc_id"] is not None) == sorted(d for d, c in of.items() if d == c)
    assert (None in after) == any(r["doc_id"] is None for r in single.collect())

    packed = stages[3](spark, single, SF).collect()
    check_packing(packed, {r["doc_id"]: r["text"] for r in single.collect()}, Tokenizer.from_file(TOKENIZER))


def test_run_and_empty(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "empty")
    assert docs.count() == 0
