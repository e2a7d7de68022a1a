"""SFT assembly, sampling and JSONL sources/sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from editforge.operators import clean as K
from editforge.operators import sft as S
from editforge.sources import jsonl as J
from editforge.streaming import resume as R


def test_first_n_contracts_stops_at_next_contract(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1)], "pos bigint, original_line_no bigint")
    assert [r.pos for r in S.first_n_contracts(df, 1, ["pos"]).orderBy("pos").collect()] == [1, 2]
    assert S.first_n_contracts(df, 5, ["pos"]).count() == 4


def test_sample_exact_is_exact_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in S.sample_exact(df, 25, 42, "k").collect()]
    b = [r.k for r in S.sample_exact(df.repartition(7), 25, 42, "k").collect()]
    assert len(a) == 25 and a == b
    assert S.sample_exact(df.limit(10), 25, 42, "k").count() == 10


def test_instruction_once_and_sets(spark):
    recs = spark.createDataFrame([(5, 1, "x" * 30, "e1", 2), (5, 0, "x" * 30, "e0", 2), (6, 0, "short", "e", 1)],
                                 "original_line_no bigint, path_id bigint, final_code string, "
                                 "edit_sequence string, steps_count bigint")
    once = S.instruction_once(S.instruct_eligible(recs)).collect()
    assert [(r.original_line_no, r.path_id) for r in once] == [(5, 0)]
    resp = spark.createDataFrame([(5, "  do it \n")], "original_line_no bigint, instruction string")
    sft = S.attach_instruction(recs, resp)
    assert {r.instruction for r in sft.collect()} == {"do it"}
    tmp = tempfile.mkdtemp(prefix="editforge-test-")
    inv = S.dual_sink(sft, tmp + "/a", tmp + "/b").first()
    assert (inv.n_edit, inv.n_control, inv.key_sym_diff) == (2, 2, 0)
    msgs = json.loads(S.prompt_table(recs).first().messages)
    assert [m["role"] for m in msgs] == ["system", "user"] and msgs[1]["content"].endswith("\nInstruction:")


def test_jsonl_scan_line_numbers_across_files_and_splits(spark):
    tmp = tempfile.mkdtemp(prefix="editforge-test-")
    src_a, src_b = os.path.join(tmp, "a"), os.path.join(tmp, "b.jsonl")
    os.makedirs(src_a)
    want = []
    for i, name in enumerate(["part-0.txt", "part-1.txt"]):
        with open(os.path.join(src_a, name), "w") as f:
            for j in range(2000):
                n = i * 2000 + j + 1
                f.write("\n" if n % 97 == 0 else json.dumps({"n": n, "pad": "y" * 40}) + "\n")
                if n % 97:
                    want.append((0, n))
    with open(src_b, "w") as f:
        for n in range(1, 301):
            f.write(json.dumps({"n": n}) + "\n")
            want.append((1, n))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")   # many splits per file
    try:
        rows = J.jsonl_scan(spark, [src_a, src_b]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r.file_ord, r.line_no) for r in rows)
    assert got == sorted(want)
    for r in rows:
        if r.file_ord == 0:
            assert json.loads(r.raw)["n"] == r.line_no
    try:
        J.jsonl_scan(spark, [src_b, os.path.join(tmp, "missing")])
        raise AssertionError("missing input must fail")
    except FileNotFoundError:
        pass


def test_bad_record_route_and_merge(spark):
    raw = ['{"class_code": "a", "func_name": "f", "file_path": "p"}', '{"class_code": "b"', '[1, 2]', '',
           '{"class_code": "c", "func_name": "f", "file_path": "p"}', '{"a": 1, "a": 2}']
    scan = spark.createDataFrame([(0, i + 1, r) for i, r in enumerate(raw)], "file_ord bigint, line_no bigint, raw string")
    good, rej = K.bad_record_route(scan)
    assert sorted((r.line_no, r.reason) for r in rej.collect()) == [(2, "bad_json"), (3, "not_object"), (6, "bad_json")]
    merged = K.merge_keep(K.merge_key(K.with_fields(good)).drop("raw"))
    assert [(r.key, r.line_no) for r in merged.collect()] == [("file:p::fn:f", 1)]
    last = K.merge_keep(K.merge_key(K.with_fields(good)).drop("raw"), "last")
    assert [r.line_no for r in last.collect()] == [5]


def test_jsonl_write_keeps_nulls_and_unicode(spark):
    tmp = tempfile.mkdtemp(prefix="editforge-test-")
    df = spark.createDataFrame([(1, None, "é\"x")], "a bigint, b string, c string")
    J.jsonl_write(df, tmp + "/o")
    line = spark.read.text(tmp + "/o").first().value
    assert line == '{"a":1,"b":null,"c":"é\\"x"}'


def test_resume_stream_rerun_adds_nothing(spark):
    tmp = tempfile.mkdtemp(prefix="editforge-test-")
    spark.range(0, 50).select(F.col("id").alias("original_line_no")).write.parquet(tmp + "/in")
    kw = dict(schema="original_line_no bigint", out_dir=tmp + "/out", checkpoint=tmp + "/ck",
              transform=lambda d: d.withColumn("v", F.col("original_line_no") * 2))
    R.resume_stream(spark, tmp + "/in", **kw)
    assert spark.read.parquet(tmp + "/out").count() == 50
    R.resume_stream(spark, tmp + "/in", **kw)                       # same checkpoint: nothing new
    R.resume_stream(spark, tmp + "/in", **{**kw, "checkpoint": tmp + "/ck2"})   # fresh checkpoint: anti-join
    assert spark.read.parquet(tmp + "/out").count() == 50


def test_first_n_contracts_counts_contracts_not_rows(spark):
    df = spark.createDataFrame([(i, (i * 7) % 50) for i in range(1, 301)], "pos bigint, original_line_no bigint")
    assert sorted(r.pos for r in S.first_n_contracts(df, 20, ["pos"]).collect()) == list(range(1, 21))
    assert S.first_n_contracts(df, 50, ["pos"]).count() == 300 and S.first_n_contracts(df.limit(0), 5, ["pos"]).count() == 0


def _resume_once(spark, tmp, transform, **kw):
    R.resume_jsonl(spark, tmp + "/in", tmp + "/out", tmp + "/bad", tmp + "/state",
                   key=lambda d: K.field(F.col("v"), "id"), transform=transform, **kw)


def _lines_file(tmp, name, lines):
    os.makedirs(tmp + "/in", exist_ok=True)
    with open(f"{tmp}/in/{name}", "w") as f:
        f.write("".join(line + "\n" for line in lines))


def test_resume_jsonl_goes_on_after_a_failure_and_ignores_repeats(spark):
    tmp = tempfile.mkdtemp(prefix="editforge-test-")
    files = {f"{i}.jsonl": [json.dumps({"id": str(i * 10 + k), "x": k}) for k in range(12)] + ['{"id": ', "[1]", "[1]", '{"no": 1}', "", '{"id": null}']
             for i in range(4)}   # ids of neighbouring files overlap by two
    for name, lines in files.items():
        _lines_file(tmp, name, lines)
    calls = []

    def failing(new):
        calls.append(1)
        if len(calls) == 3:   # the rejects of this batch are written, its results are not
            raise RuntimeError("lost driver")
        return new.withColumn("n", F.length("raw"))

    try:
        _resume_once(spark, tmp, failing, files_per_batch=1)
        raise AssertionError("the third batch must fail")
    except Exception as e:
        assert "lost driver" in str(e)
    assert spark.read.parquet(tmp + "/out").count() < 42
    _lines_file(tmp, "copy.jsonl", files["0.jsonl"] + files["3.jsonl"][:3])   # a file that repeats finished keys comes in between
    _resume_once(spark, tmp, failing, files_per_batch=1)
    out = spark.read.parquet(tmp + "/out").collect()
    assert sorted(int(r.key) for r in out) == list(range(42)) and all(r.n == len(r.raw) for r in out)
    bad = [(r.reason, r.raw) for r in spark.read.parquet(tmp + "/bad").collect()]
    assert sorted(bad) == sorted(5 * [("bad_json", '{"id": '), ("not_object", "[1]"), ("not_object", "[1]"), ("no_key", '{"no": 1}'), ("no_key", '{"id": null}')])
    _resume_once(spark, tmp, failing)   # nothing new
    assert spark.read.parquet(tmp + "/out").count() == 42 and spark.read.parquet(tmp + "/bad").count() == 25


def test_resume_jsonl_does_not_read_its_output(spark):
    """Output that nobody can read any more does not stop a later batch; output without its state does."""
    tmp = tempfile.mkdtemp(prefix="editforge-test-")
    _lines_file(tmp, "a", ['{"id": "1"}', '{"id": "2"}'])
    _resume_once(spark, tmp, lambda new: new.select("key"))
    for name in os.listdir(tmp + "/out/batch=0"):
        if name.endswith(".parquet"):
            with open(f"{tmp}/out/batch=0/{name}", "wb") as f:
                f.write(b"damaged")
    _lines_file(tmp, "b", ['{"id": "2"}', '{"id": "3"}'])
    _resume_once(spark, tmp, lambda new: new.select("key"))
    assert [r.key for r in spark.read.parquet(tmp + "/out/batch=1").collect()] == ["3"]
    try:
        R.resume_jsonl(spark, tmp + "/in", tmp + "/out", tmp + "/bad", tmp + "/other", key=lambda d: K.field(F.col("v"), "id"), transform=lambda d: d)
        raise AssertionError("a new state beside old output must be refused")
    except ValueError:
        pass
