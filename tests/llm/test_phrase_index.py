import re

import numpy as np
import pytest

from tessella.llm import phrase_index

WORDS = re.compile(phrase_index.WORDS)


def cut(t) -> list[str]:
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def windows(w: list, n: int) -> list[list]:
    return [w[i : i + n] for i in range(max(1, len(w) - n + 1))] if w else []


def by_hand(docs, items, n: int) -> list:
    out = []
    for key, text in docs:
        w, hit, named = cut(text), set(), set()
        for item, t in items:
            for v in windows(cut(t), n):
                for i in range(len(w) - len(v) + 1):
                    if w[i : i + len(v)] == v:
                        hit |= set(range(i, i + len(v)))
                        named |= {item} - {None}
        out.append((str(key), len(w), len(hit), tuple(sorted(named))))
    return sorted(out)


def within(w: list, v: list, most: int) -> bool:
    """Whether w has v's words in order in a stretch of so many words at most."""
    for i in range(len(w)):
        if w[i] == v[0]:
            at, k = i, 1
            while k < len(v):
                at = next((j for j in range(at + 1, len(w)) if w[j] == v[k]), -1)
                if at < 0:
                    break
                k += 1
            if at >= 0 and at - i + 1 <= most:
                return True
    return False


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{i}" for i in rng.zipf(1.5, n) % 30]
    items = [(i, " ".join(word(int(rng.integers(1, 16))))) for i in range(14)] + [(3, "w1 w2"), (None, "w5 w6"), (50, None), (51, "?!")]
    docs = [(i, " ".join(word(int(rng.integers(0, 60))))) for i in range(40)]
    docs += [(100 + k, " ".join(word(5)) + " - " + t.upper() + ", " + " ".join(word(5))) for k, (_, t) in enumerate(items) if t]
    docs += [(7, docs[7][1]), (None, "w1 W2"), (None, None), (200, ""), (201, "..."), (202, "w1 w2 " * 5000), (203, "Ünï w1 w2x")]
    return docs, items, spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, key int"), spark.createDataFrame(items, "item_id long, text string")


def found(df) -> list:
    return sorted((str(r.key), r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in df.collect())


@pytest.mark.parametrize("size", [1, 3, 10])
def test_phrases_equal_brute_force(tables, size, monkeypatch):
    docs, items, d, i = tables
    want = by_hand(docs, items, size)
    assert found(phrase_index.contaminated(d, i, window=size)) == want
    if size == 3:
        monkeypatch.setattr(phrase_index, "BLOCK_BYTES", 2000)  # blocks of items
        monkeypatch.setattr(phrase_index, "STEP", 50)
        got = phrase_index.contaminated(d, i, window=size)
        assert found(got) == want
        assert all(a.end < b.start or a.end == b.start for r in got.collect() for a, b in zip(r.hits, r.hits[1:], strict=False))


def test_near_matches_equal_brute_force(tables):
    docs, items, d, i = tables
    for size, slack in ((4, 2), (10, 5)):
        got = {(str(r.key), r.n_words): tuple(sorted(r["items"])) for r in phrase_index.contaminated(d, i, window=size, slack=slack).collect()}
        for key, text in docs:
            w = cut(text)
            if len(w) < 1000:
                named = {item for item, t in items if item is not None and any(within(w, v, len(v) + slack) for v in windows(cut(t), size))}
                assert got[str(key), len(w)] == tuple(sorted(named)), (key, size, slack)


def test_small_segments_and_empty_tables(tables, monkeypatch):
    docs, items, d, i = tables
    assert found(phrase_index.contaminated(d.repartition(13), i, window=4)) == by_hand(docs, items, 4)
    assert phrase_index.contaminated(d.limit(0), i).count() == 0
    none = phrase_index.contaminated(d, i.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r["items"] or r.contaminated for r in none)


def test_other_kinds_of_keys(spark):
    d = spark.createDataFrame([("a", "one two three"), ("b", "two three")], "id string, body string")
    i = spark.createDataFrame([("x", "Two THREE")], "name string, body string")
    got = phrase_index.contaminated(d, i, key="id", item="name", text="body").collect()
    assert sorted((r.key, r["items"], [(h.start, h.end) for h in r.hits]) for r in got) == [("a", ["x"], [(1, 3)]), ("b", ["x"], [(0, 2)])]
