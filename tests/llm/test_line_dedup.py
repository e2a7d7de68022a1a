"""Line dedup against a brute-force search for repeated runs of MIN_WORDS words."""

import random

from editforge.llm.line_dedup import MIN_WORDS, remove_repeats

SCHEMA = "doc_id long, text string, lang string"


def brute_force(rows):
    """Word positions that a run of MIN_WORDS words found at an earlier place covers, by document."""
    first, gone = {}, {}
    for doc, text in sorted((d, t) for d, t in rows if d is not None and t is not None):
        w = text.encode().split()
        hit = gone.setdefault((doc, text), set())
        for i in range(len(w) - MIN_WORDS + 1):
            key = tuple(w[i: i + MIN_WORDS])
            where = first.setdefault(key, (doc, i))
            if where[0] != doc or i - where[1] >= MIN_WORDS:
                hit.update(range(i, i + MIN_WORDS))
    return gone


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "xx") for d, t in rows], SCHEMA).repartition(3)
    return [r.asDict(recursive=True) for r in remove_repeats(df).collect()]


def spans(words):
    return {i for s in words for i in range(s["start"], s["stop"])}


def test_random_passages_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(n) for n in (50, 51, 57, 64, 80, 130, 300)] + [text(n) for n in (20, 40, 48, 49)]
    rows = []
    for d in range(60):
        parts = text(rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts += p + text(rng.randint(0, 60))
        rows.append((d, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1] + " tail"), (102, "")]
    want = brute_force(rows)
    got = run(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        original = dict(rows)[r["doc_id"]]
        gone = want[(r["doc_id"], original)]
        assert spans(r["removed"]) == gone, r["doc_id"]
        w = original.encode().split()
        assert r["n_words"] == len(w)
        assert r["text"].encode().split() == [x for i, x in enumerate(w) if i not in gone]
        if not gone:
            assert r["text"] == original


def test_documents_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in df.collect()]
    want = brute_force(rows)
    got = {r["doc_id"]: spans(r["removed"]) for r in remove_repeats(df).select("doc_id", "removed").collect()}
    assert got == {d: gone for (d, _), gone in want.items()}
    assert any(got.values())


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (1, None), (2, ""), (3, " \n\t "), (4, passage), (4, passage), (5, "a " + passage + " b"),
            (6, " ".join(["das"] * 400)), (7, "one two"), (8, passage + "\n")]
    got = run(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows)
    assert by[None][0]["text"] == passage and by[1][0]["text"] is None and by[3][0]["text"] == " \n\t "
    assert [r["text"] for r in by[4]] == [passage] * 2  # rows that repeat are one document
    assert by[5][0]["text"] == "a b" and by[8][0]["text"] == ""
    assert 32 <= len(by[6][0]["text"].split()) <= 2 * MIN_WORDS
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x y", 5, "r", 1)], "doc_id long, text string, n_words int, removed string, _doc int")
    assert remove_repeats(df).collect()[0]["n_words"] == 2


def test_earlier_places_of_part_of_a_run_hide_no_whole_one(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(32, 50):  # beginnings and ends too short to count stand before the whole passage
        p = text(52)
        rows += [(10 * k, p[:k]), (10 * k + 1, text(20) + p[-k:]), (10 * k + 2, text(5) + p + text(7)), (10 * k + 3, text(9) + p)]
    for d in range(20):  # edited copies, then two whole ones
        p = text(200)
        for i in range(4):
            q = list(p)
            for at in range(rng.randrange(40), 200, 45):
                q[at] = f"edit{i}_{at}"
            rows.append((1000 + 10 * d + 4 + i, q))
        rows += [(1000 + 10 * d + 8, p + text(10)), (1000 + 10 * d + 9, text(3) + p)]
    rows = [(d, " ".join(t)) for d, t in rows]
    for (d, t), gone in (want := brute_force(rows)).items():
        assert len(gone) >= 50 or d % 10 not in (3, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (df.coalesce(1), df.repartition(3), df.repartition(16), df.orderBy(df.doc_id.desc())):
        got = {r["doc_id"]: spans(r["removed"]) for r in remove_repeats(parts).collect()}
        assert got == {d: gone for (d, _), gone in want.items()}


def test_other_lengths_of_runs(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for least in (20, 70):
        p = text(least)
        rows = [(1, p[:-1]), (2, text(3) + p), (3, p + text(4)), (4, p[1:])]
        df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
        got = {r["doc_id"]: spans(r["removed"]) for r in remove_repeats(df, min_words=least).collect()}
        assert got == {1: set(), 2: set(), 3: set(range(least)), 4: set()}
