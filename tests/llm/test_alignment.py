"""Alignment and link counts against a plain pass over every document and every pair."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from editforge.llm import alignment
from editforge.llm.alignment import align, corpus_links, lanes, lockstep

SCHEMA = "doc_id long, text string, pairs string, n_a int, _row int, Times string"


def byte_values():
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(spare)): b for b in range(256)}


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.back = byte_values()

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw_a = [bytes(self.back[c] for c in self.a.id_to_token(i)) for i in a]
        pieces = [self.b.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        want = (" " + text).encode()
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            return []
        ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        out, before = [], 0
        for c in cuts:
            out.append(([i for i, e in zip(a, ends_a) if before < e <= c], [i for i, e in zip(b, ends_b) if before < e <= c]))
            before = c
        return out

    def rows(self, docs):
        grouped = [(k, self.groups(t)) for k, t in docs]
        linked = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in grouped]
        count = Counter(p for links in linked for p in links)
        most = {}
        for (x, _), n in count.items():
            most[x] = max(most.get(x, 0), n)
        for (k, g), links in zip(grouped, linked):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()),
                   sum(t for p, t in links.items() if count[p] == most[p[0]]), sum(t * count[p] for p, t in links.items()),
                   hashlib.sha256(text.encode()).hexdigest() if g else "")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "  \n\n ", "<|endoftext|> a<s>b</s><unk><0x41>", "under▁bar is not given back", "naïve café – “quotes”…", "日本語のテキスト。中文也有", "🙂🙃👩‍👩‍👧 mixed", "\x00\x01 control\t\ttabs",
       "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "don't WON'T I'll", "Ünïcödé" * 40, "ไทยภาษา", "\r\nline sep\u0085", "1234567890" * 30, "  leading", "trailing  ", "😀" * 700]


def test_every_column_equals_plain(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, ODD[6]), (100, ODD[6]), (None, ODD[7]), (101, ODD[7] + ODD[8])]
    df = spark.createDataFrame([(k, t, "p", 1, 2, "t") for k, t in docs], SCHEMA)
    want = sorted(Plain().rows(docs), key=str)
    for parts, heavy in ((1, alignment.HEAVY), (5, 8)):
        got = corpus_links(df.repartition(parts), heavy=heavy)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert corpus_links(df.limit(0)).count() == 0


def test_whole_table_equals_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op13_lockstep(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(Plain().rows(docs))


def test_groups_are_kept_on_request(spark):
    df = spark.createDataFrame([(i, t, "p", 1, 2, "t") for i, t in enumerate(ODD)], SCHEMA)
    plain = Plain()
    for r in align(df, keep_groups=True).collect():
        starts = list(zip([0, *r["ends_a"]], r["ends_a"], [0, *r["ends_b"]], r["ends_b"]))
        assert [(r["ids_a"][a:b], r["ids_b"][c:d]) for a, b, c, d in starts] == plain.groups(r["text"])


@pytest.mark.parametrize("lane", [1, 3, 50, 10_000])
def test_lanes_and_steps_give_the_common_ends(lane):
    rng = np.random.default_rng(lane)
    for _ in range(60):
        docs = []
        for _ in range(int(rng.integers(1, 12))):
            n = int(rng.integers(0, 400))
            one, two = (np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, n + 1))), n)) if n else np.zeros(0, int) for _ in "ab")
            docs.append((one, two))
        at_a, at_b = np.cumsum([0, *(len(a) for a, _ in docs)]), np.cumsum([0, *(len(b) for _, b in docs)])
        end_a, end_b = np.concatenate([a for a, _ in docs]), np.concatenate([b for _, b in docs])
        link_a, link_b, groups = lockstep(end_a, end_b, *lanes(end_a, at_a, end_b, at_b, lane))
        assert end_a[groups[1] - 1].tolist() == [c for a, b in docs for c in np.intersect1d(a, b)]
        assert end_b[groups[3] - 1].tolist() == end_a[groups[1] - 1].tolist()
        want = set()
        for d, (a, b) in enumerate(docs):
            sa, sb = np.concatenate([[0], a]), np.concatenate([[0], b])
            want |= {(int(at_a[d]) + i, int(at_b[d]) + j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(a[i], b[j])}
        assert set(zip(link_a.tolist(), link_b.tolist())) == want and len(link_a) == len(want)


def test_a_large_group_costs_its_different_ids():
    """20,000 tokens a side without a common end but the last: 4 * 10^8 links, six pairs."""
    n = 20_000
    ids_a, ids_b = np.arange(n) % 2, np.arange(n) % 3
    groups = np.array([[0], [n], [0], [n]])
    doc, pair, times = alignment.linked_pairs(ids_a, ids_b, 10, np.arange(n), np.arange(n), groups, np.zeros(1, int))
    assert pair.tolist() == [0, 1, 2, 10, 11, 12] and times.sum() == n * n and set(doc.tolist()) == {0}
