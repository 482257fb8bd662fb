import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import token_align
from tests.oracle import SF

A, B = token_align.default_models()


def by_hand(rows) -> list[tuple]:
    """Both libraries over whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte, piece = token_align.byte_of_character(), {}
    for i in range(b.get_piece_size()):
        t = b.id_to_piece(i)
        piece[i] = bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode()
    docs, count = [], Counter()
    for key, text in rows:
        ids, pairs, groups = ([], []), [], []
        if text:
            e, p, want = a.encode(" " + text, add_special_tokens=False), b.encode(text), (" " + text).encode()
            a_ids = e.ids  # a copy each time it is asked for
            sides = [(a_ids, [bytes(byte[c] for c in t) for t in e.tokens]), (p, [piece[i] for i in p])]
            if all(b"".join(raw) == want for _, raw in sides):
                ids = (a_ids, p)
                ends = [np.cumsum([len(x) for x in raw]).tolist() for _, raw in sides]
                last, at = (0, 0), {x: m for m, x in enumerate(ends[1])}
                for n, x in enumerate(ends[0]):
                    if x in at:
                        m = at[x]
                        pairs.append((a_ids[n], p[m]))
                        groups.append(",".join(map(str, a_ids[last[0] : n + 1])) + "|" + ",".join(map(str, p[last[1] : m + 1])))
                        last = (n + 1, m + 1)
        count.update(pairs)
        docs.append((key, len(ids[0]), len(ids[1]), pairs, ";".join(groups)))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((k, n, m, len(g), len(g), sum(count[p] == best[p[1]] for p in g), sum(count[p] for p in g), hashlib.sha256(t.encode()).hexdigest() if g else "") for k, n, m, g, t in docs), key=str)


def found(df) -> list[tuple]:
    return sorted(((r.key, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


ODD = [(1, None), (2, ""), (3, " "), (4, "  two  spaces   and four    "), (4, "same"), (4, "same"), (None, "no id"), (5, "a\n b\n\n  c\t \td\r\n e "), (6, "▁ is no space"), (7, "<s> </s><|endoftext|> <0x41> <unk>"), (8, "nul \0 \0\0 x"), (9, "漢字 かな \U0001f600\U0001f468‍\U0001f469 é́ 　 wide \x1c \x1d x\x1f y \xa0 z"), (10, "x" * 3000 + " " + "ab" * 3000), (11, "the " * 20_000), (12, "\n"), (13, "it's we'll 'tis 12345 3.14"), (14, " lead  line 　 ideographic ")]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000][:120] + ODD


def test_alignment_equals_the_libraries(spark, rows):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_a int")
    assert found(token_align.aligned(df)) == by_hand(rows)


def test_small_slices_calls_and_stripes(spark, rows, monkeypatch):
    for name, value in (("SLICE", 3000), ("ROWS", 7), ("CALL", 40), ("MEMO", 60), ("STRIPES", 5), ("HELD", 90), ("SALT_BYTES", 4000)):
        monkeypatch.setattr(token_align, name, value)
    some = [r for r in rows if len(r[1] or "") < 2500][-25:]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    assert found(token_align.aligned(df)) == by_hand(some)


def test_groups_counts_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "hello world hello"), ("b", "hello")], "id string, body string")
    got = {r.key: r for r in token_align.aligned(df, "id", "body", keep=True).collect()}
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.values())
    pairs = token_align.pair_counts(token_align.counts(token_align.coded(df, "id", "body"))).collect()
    assert sorted((r["count"], r.best) for r in pairs) == [(1, True), (3, True)] and got["a"].count_sum == 7
    assert {(r.other, r.own) for r in pairs} == {tuple(int(x.split(",")[-1]) for x in g.split("|")) for g in got["a"].groups.split(";")}
    assert token_align.aligned(df.limit(0), "id", "body").count() == 0
    turned = token_align.aligned(df, "id", "body", side=0).collect()
    assert {r.key: r.count_sum for r in turned} == {r.key: r.count_sum for r in got.values()}


def test_units_are_coded_as_in_their_text():
    coder = token_align.Coder(*[open(p, "rb").read() for p in (A, B)])
    rng = np.random.default_rng(6)
    letters = list("ab \n\t'é漢1.") + ["  ", "　", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choice(letters, int(rng.integers(1, 40))))
        n = coder.numbers(text)
        coder.learn()
        said = b"".join(coder.texts[i] for i in n)[:-1].decode()
        ids = [[int(x) for g in said.split(";") for x in g.split("|")[side].split(",")] for side in (0, 1)]
        assert ids == [coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)], repr(text)
