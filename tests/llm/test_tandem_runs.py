import re

import numpy as np

from tessella.llm import tandem_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(w: list, least: int) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def triples(found) -> list:
    return sorted(zip(*(x.tolist() for x in found), strict=True))


def test_repetitions_equal_brute_force():
    rng = np.random.default_rng(1)
    for turn in range(600):
        w = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(2, 60)))
        if turn % 3 == 0:  # a power with a fault
            w = np.tile(rng.integers(0, 5, int(rng.integers(1, 12))), 8)[: len(w)].copy()
            w[rng.integers(0, len(w))] = 7
        assert triples(tandem_runs.repetitions(np.unique(w, return_inverse=True)[1], 2)) == by_hand(w.tolist(), 2), w.tolist()


def test_runs_of_many_texts_in_small_steps(monkeypatch):
    monkeypatch.setattr(tandem_runs, "STEP", 7)
    rng = np.random.default_rng(2)
    for _ in range(60):
        texts = [rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 90))) for _ in range(8)]
        size = [len(x) for x in texts]
        begin = np.cumsum(size) - size
        want = sorted((int(begin[i]) + s, n, q) for i, x in enumerate(texts) for s, n, q in by_hand(x.tolist(), 12))
        assert triples(tandem_runs.runs_of(np.concatenate(texts), np.repeat(np.arange(8), size))) == want


def test_long_runs_stay_linear():
    """One word 200,000 times, a long period, and a power within a power."""
    assert triples(tandem_runs.runs_of(np.zeros(200_000, np.int64), np.zeros(200_000, np.int64))) == [(0, 200_000, 1)]
    w = np.tile(np.arange(30_000), 7)
    assert triples(tandem_runs.runs_of(w, w * 0)) == [(0, 210_000, 30_000)]
    w = np.tile(np.r_[np.tile([1, 2], 10), 3], 4)
    assert triples(tandem_runs.runs_of(w, w * 0)) == by_hand(w.tolist(), 12)


def test_texts_that_are_odd(spark):
    run = "a b c " * 5
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t ", 7), (4, "x " + run + "y", 7), (4, "x " + run + "y", 7), (None, run, 7), (5, "é 漢 " * 8, 7), (6, "w " * 50_000, 7), (7, "A a " * 3 + "a A", 7)]
    df = spark.createDataFrame([(i, t, n, t) for i, t, n in rows], "doc_id long, text string, n_runs int, _text string")
    got = tandem_runs.with_runs(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "_text", "n_words", "n_runs", "runs", "collapsed"}
    for r in got:
        w = WORD.findall(r.text or "")
        want = by_hand(w, 12) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(x) for x in r.runs] == want and (r.n_words, r.n_runs) == (len(w), len(want)) and r._text == r.text
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert tandem_runs.with_runs(df.limit(0)).count() == 0
    made = tandem_runs.with_periodic_tails(df).collect()
    assert [(r.doc_id, r.n_runs, r._text) for r in made] == [(i, n, t) for i, t, n in rows]


def test_words_are_cut_at_ascii_spaces_only(spark):
    t = "a b c　d\x1ce\x85f " * 12
    assert tandem_runs.with_runs(spark.createDataFrame([(1, t)], "doc_id int, text string")).first().n_words == 12
