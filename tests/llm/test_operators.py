import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, flac, line_dedup, lm_mix, ngram_join, pieces, quality_classifier, quality_rules, registry, secret_scan, source_mix
from tests.oracle import SF, assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\n "), (4, "short text"), (4, "short text"), (None, "no id here at all"), (5, "a long line that repeats\nb"), (6, "A LONG line that repeats \nc"), (7, "word " * 30_000), (8, "é▁漢字 \U0001f600 <s>[INST] x\\y"), (9, "tab\tand  two spaces\r\nend\n")]


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    clash = "n_lines int, ids string, secrets int, n_words int, score int, replica int, decoded int, _id int, _key int, _row int"
    return spark.createDataFrame([(i, t, "s", *range(1, 2), "x", *range(8)) for i, t in ODD], f"doc_id long, text string, source string, {clash}")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


def by_hand_components(rows):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = WORD.findall(lower(t or ""))
        sets[n] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                up[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        r = root(n)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(sets[n]), least.get(root(n)) if sets[n] else i) for n, (i, _) in enumerate(rows)), key=str)


def test_ngram_join_equals_brute_force(spark, docs, odd, monkeypatch):
    rng, words = np.random.default_rng(3), [f"w{i}" for i in range(400)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(i, t) for i, t in ODD if i != 7]
    for k, size in enumerate([5, 6, 9, 12, 25, 60, 150, 400, 900]):
        base = list(rng.choice(words, size))
        for c in range(7):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 28)))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(words))
            rows.append((10_000 + 10 * k + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == by_hand_components(rows)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    monkeypatch.setattr(ngram_join, "CELLS", 1000)
    monkeypatch.setattr(ngram_join, "MEET_BYTES", 20_000)
    some = df.filter("doc_id >= 10000")
    small = [r for r in rows if r[0] is not None and r[0] >= 10_000]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(some).collect()) == by_hand_components(small)
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    near = " ".join(f"w{i}" for i in range(40))
    shared = spark.createDataFrame([(3, near), (4, near + " more"), (4, "another text that stands alone here"), (None, near), (None, "no id and nothing like it at all")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[:7]) for r in ngram_join.one_of_each(shared).collect()) == [(0, "no id a"), (3, "w0 w1 w"), (4, "another")]
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


def test_signatures_meet(spark):
    """Every linked pair of sets agrees in more indexed segments than either may spare."""
    rng = np.random.default_rng(5)
    for n in (5, 8, 11, 20, 40, 100, 300, 1000):
        for _ in range(15):
            d = int(rng.integers(0, n // 9 + 1))
            x = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2)
            y = np.r_[x[d:], rng.integers(0, 1 << 63, d, np.int64).astype(np.uint64)]
            x, y = np.unique(x), np.unique(y)
            inter = len(np.intersect1d(x, y))
            if x.tolist() == y.tolist() or 100 * inter < 80 * (len(x) + len(y) - inter):
                continue
            sig, who, step, left = ngram_join.signatures(np.r_[x, y], np.array([0, len(x), len(x) + len(y)]))
            ok = []
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                common = set(sig[(who == 0) & (step == i)].tolist()) & set(sig[(who == 1) & (step == j)].tolist())
                ok.append(len(common) > max(left[0, i], left[1, j]))
            assert any(ok)


def test_ngram_join_finds_the_texts_of_null_and_shared_ids(spark):
    w, x, y = ([f"{c}{i}" for i in range(100)] for c in "wxy")
    rows = [(1, " ".join(w)), (None, " ".join(x[:8] + w[8:])), (2, " ".join(x[:8] + w[8:92] + y[:8]))]  # a chain by way of a null id
    other = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcdefgh"]
    rows += [(10, t) for t in other] + [(20 + k, t + " more") for k, t in enumerate(other)]  # one id for eight texts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == by_hand_components(rows) and (2, 96, 1) in got


def test_signatures_meet_near_the_threshold():
    """Small sets have many empty segments, which only one of two linked sets may index; whichever hits are passed over, one is left."""
    rng, linked = np.random.default_rng(8), 0
    for _ in range(120):
        sets = []
        for n in rng.integers(9, 41, 100):
            d = int(rng.integers(max(0, n // 9 - 1), n // 9 + 2))
            x = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2)
            sets += [np.sort(x), np.sort(np.r_[x[2 * d if rng.integers(2) else d :], rng.integers(0, 1 << 63, d * int(rng.integers(2)), np.int64).astype(np.uint64)])]
        sig, who, step, left = ngram_join.signatures(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])])
        of = [[set(), set()] for _ in sets]
        for s, w, k in zip(sig.tolist(), who.tolist(), step.tolist(), strict=True):
            of[w][k].add(s)
        for a in range(0, len(sets), 2):
            inter, both = len(np.intersect1d(sets[a], sets[a + 1])), len(sets[a]) + len(sets[a + 1])
            if inter == both - inter or 100 * inter < 80 * (both - inter):
                continue
            linked += 1
            assert any(len(of[a][i] & of[a + 1][j]) > max(left[a, i], left[a + 1, j]) for i in (0, 1) for j in (0, 1))
    assert linked > 3000


def test_lm_score(spark, docs, odd):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm_mix.score(docs).collect()}
    counts: Counter = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*WORD.findall(lower(t)), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(w in counts for w in tokens), total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens), rel_tol=1e-9)
        assert r.score < 0
    assert {r.doc_id: r.n_tokens for r in lm_mix.score(odd).collect()}[1] == 1
    assert lm_mix.score(odd).count() == len(ODD) and lm_mix.score(odd.limit(0)).count() == 0


def test_lm_score_beats_counts_on_held_out_texts(spark):
    """On a corpus of some size: the base leaves the spelling of unknown words out of its sums, which pays on a tiny one."""
    sums = lm_mix.op1_lm_score(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums.s > sums.b


def test_codes_sum_to_one():
    """The bits of all classes and hashes are a code, as are those of all bytes: whatever a node predicts, the products sum to one."""
    rng = np.random.default_rng(2)
    p = rng.random(2048)
    nodes, bits, told = lm_mix.NODES, lm_mix.BITS, lm_mix.TOLD
    each = np.where(told, np.where(bits, p[nodes], 1 - p[nodes]), 1).prod(1)
    spell, words = each[0], each[1 << lm_mix.HASH_BITS :]
    assert math.isclose(spell + words.sum(), 1) and np.ptp(each[: 1 << lm_mix.HASH_BITS]) == 0
    of = {int(n): q for n, q in zip(np.unique(lm_mix._BYTE_NODES), rng.random(255), strict=True)}
    assert math.isclose(sum(math.prod(of[int(n)] if y else 1 - of[int(n)] for n, y in zip(*x, strict=True)) for x in zip(lm_mix._BYTE_NODES, lm_mix._BYTE_BITS, strict=True)), 1)


def lm_by_hand(rows: list[tuple[int, str]]) -> dict[int, float]:
    """The score of each text, one decision after the other, with dictionaries for the tables."""
    low, parts = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
    mul_a, mul_b, mul_c = parts

    def mix(x: int) -> int:
        x &= low
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & low
        x = (x ^ x >> 27) * 0x94D049BB133111EB & low
        return x ^ x >> 31

    word_hash = lambda w: int(lm_mix.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    texts = {i: [*(w.encode() for w in WORD.findall(lower(t))), b"\n"] for i, t in rows}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in texts}
    h = {w: word_hash(w) for ws in texts.values() for w in ws}
    count = Counter(w for i, ws in texts.items() if train[i] for w in ws)
    kind = {w: 0 if count[w] < 2 else min(31, 1 + int(math.log2(count[w] - 1))) for w in h}
    cell = {w: (kind[w], h[w] >> 20 & 15) for w in h}
    cell_sum = Counter()
    for w, n in count.items():
        cell_sum[cell[w]] += n
    after: dict = {}
    for i, ws in texts.items():
        for a, b, w in zip([None, None, *ws], [None, *ws], ws, strict=False):
            if train[i]:
                after.setdefault((a, b), Counter())[w] += 1
    bits = min(21, max(14, math.ceil(math.log2(max(1, sum(count.values()))))))
    decisions = {}
    for i, ws in texts.items():
        found, answers = {"follow": [], "word": [], "spell": []}, []
        for a, b, w in zip([None, None, *ws], [None, *ws], ws, strict=False):
            seen = Counter(after.get((a, b), {}))
            seen[w] -= train[i]
            seen = +seen
            right = False
            if n := sum(seen.values()):
                top = min(seen, key=lambda x: (-seen[x], h[x] >> 44))
                often, sure = sum(n >= x for x in (2, 3, 5, 9)), (2 * seen[top] >= n) + (5 * seen[top] >= 4 * n) + (seen[top] == n)
                past = sum(x << k for k, x in enumerate(answers[-1:-4:-1]))
                right = top == w
                found["follow"].append(([[("exact", 1, often * 4 + sure)], [("exact", 2, past * 8 + often)], [("exact", 3, (kind[b] if b else 0) * 8 + often)]], [right], False, 1.0))
                answers.append(right)
            if right:
                continue
            k, f = cell[w]
            code = [(k >> (4 - j) & 1, 1 << j | k >> (5 - j)) for j in range(5)] + ([(f >> (3 - j) & 1, 32 + (k << 4) + (1 << j | f >> (4 - j))) for j in range(4)] if k else [])
            slots = [[("exact", 0, node) for _, node in code]]
            for j, c in enumerate((h[b] if b else 0, h[a] if a else 0)):
                slots.append([("word", j, ((mix(c + j + 1) ^ node * mul_a & low) * mul_b & low) >> (64 - bits)) for _, node in code])
            found["word"].append((slots, [y for y, _ in code], train[i], count[w] / cell_sum[cell[w]] if k else 1.0))
            if k:
                continue
            data, prefix = w + b" ", 0
            for at, byte in enumerate(data):
                last, contexts = 0, []
                for j in (1, 2, 3):
                    last = last << 9 | (data[at - j] + 1 if at >= j else 0)
                    contexts.append(last)
                contexts += [prefix, contexts[1] + (h[b] if b else 0) * mul_c & low]
                prefix = (prefix + mix(byte * mul_a + at * mul_c)) & low
                nodes = [1 << j | byte >> (8 - j) for j in range(8)]
                slots = [[("spell", j, ((mix(c * mul_b + j + 1) ^ node * mul_a & low) * mul_b & low) >> 46) for node in nodes] for j, c in enumerate(contexts)]
                found["spell"].append((slots, [byte >> (7 - j) & 1 for j in range(8)], train[i] and count[w] == 1, 1.0))
        decisions[i] = found
    table: Counter = Counter()
    for i in texts:
        if train[i]:
            for slots, ys, _, _ in (u for units in decisions[i].values() for u in units):
                for column in slots:
                    for slot, y in zip(column, ys, strict=True):
                        table[slot, int(y)] += 1
    out = {}
    for i in texts:
        cost = 0.0
        for name, units in decisions[i].items():
            gates, start, rate = lm_mix.KINDS[name]
            weight = [list(start) for _ in range(gates)]
            for begin in range(0, len(units), lm_mix.BLOCK):
                move = [[0.0] * len(start) for _ in range(gates)]
                for slots, ys, own, share in units[begin : begin + lm_mix.BLOCK]:
                    cost -= math.log(share)
                    for g, y in enumerate(ys):
                        x = []
                        for column in slots:
                            n = [table[column[g], v] for v in (0, 1)]
                            if own and column[g][0] != "exact":
                                n[int(y)] -= 1
                            x.append(math.log((n[1] + 0.4) / (n[0] + 0.4)))
                        z = max(-15.0, min(15.0, sum(w * v for w, v in zip(weight[g], x, strict=True))))
                        p = 1 / (1 + math.exp(-z))
                        cost -= math.log(p if y else 1 - p)
                        for k, v in enumerate(x):
                            move[g][k] += (y - p) * v
                for g in range(gates):
                    for k in range(len(start)):
                        weight[g][k] += rate * move[g][k]
        out[i] = -cost / math.log(10)
    return out


def test_lm_score_equals_brute_force_however_rows_are_dealt(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}x" for i in range(60)]
    rows = []
    for i in range(40):
        text = " ".join(str(w) for w in rng.choice(words, int(rng.integers(1, 70)), p=np.arange(60, 0, -1) / 1830))
        rows.append((i, text + (f" Only{i} é漢" if i % 3 == 0 else "")))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, ""), (201, "Alone"), (202, "the same words " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = lm_by_hand(rows)
    for parts in (1, 5):
        got = {r.doc_id: r.score for r in lm_mix.score(df.repartition(parts)).collect()}
        assert set(got) == set(want)
        for i, v in want.items():
            assert math.isclose(got[i], v, rel_tol=2e-4), (i, got[i], v)
    order = {r.doc_id: r.score for r in lm_mix.score(spark.createDataFrame([*rows, (300, " ".join(reversed(rows[3][1].split())))], df.schema)).collect()}
    assert order[300] < order[3] - 1  # the order of words counts


def test_chat_fold_and_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s>[\\/OUT]", "", "plain", "[ROLE:41] [/SYS]", "<s><s>"]
    rows = [(1, k, k, "message", ("user", "assistant", "system", "tool")[k % 4], t) for k, t in enumerate(hard)]
    rows += [(2, 0, 0, "message", "user", "hi"), (2, 1, 1, "delta", "assistant", "par"), (2, 1, 2, "delta", "", "tial"), (2, 1, 3, "regenerate", "", None), (2, 1, 4, "delta", "", "new "), (2, 1, 600, "delta", "", "end"), (2, 2, 5, "message", "user", "bye"), (2, 2, 700, "edit", "", "edited")]
    rows += [(None, 0, 0, None, None, None)]
    events = spark.createDataFrame(rows, "conv_id long, message_id long, seq long, kind string, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(events)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r[4], r[5]) for r in rows[:7]]
    assert [(t.role, t.text) for t in back[2].turns] == [("user", "hi"), ("assistant", "new end"), ("user", "edited")]
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")]
    spans = back[2].loss_spans
    assert [back[2].formatted[s.start : s.end] for s in spans] == ["new end"]
    assert chat_format.format_chats(events.limit(0)).count() == 0


def test_source_mix(spark, odd, monkeypatch):
    n = 4000
    df = spark.createDataFrame([(i, "big" if i % 4 else "small") for i in range(n)], "doc_id long, source string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    by = {r.source: r["count"] for r in source_mix.mix(df, weights).groupBy("source").count().collect()}
    assert abs(by["small"] - 3000) < 250 and abs(by["big"] - 1000) < 150
    again = source_mix.mix(df.repartition(7), weights)
    assert again.exceptAll(source_mix.mix(df, weights)).count() == 0
    out = source_mix.mixed_documents(odd)
    assert out.columns == odd.columns and source_mix.mix(odd.limit(0)).count() == 0
    monkeypatch.setattr(source_mix, "BROADCAST_SOURCES", 0)
    assert again.exceptAll(source_mix.mix(df, weights)).count() == 0 and again.count() == source_mix.mix(df, weights).count()


def test_secret_scan(spark, odd, monkeypatch):
    key = "ghp_" + "a1B2" * 10
    texts = [f"x {key} y", "PASSWORD: 'hunter22' token=abc", "é AKIA" + "Z" * 16 + " " + "0af" * 9, "api_key=\"" + "Q" * 8 + "\"", "-----BEGIN RSA PRIVATE KEY-----", "paſſword=abcdefgh", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(secret_scan.RULES[s.kind][0], s.start, s.end) for s in r.secrets} for r in secret_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        want = set()
        for kind, pattern, group, least in secret_scan.RULES:
            want |= {(kind, m.start(), m.end()) for m in re.finditer(pattern, t or "", re.ASCII) if len(m.group(group)) >= least}
        assert got[i] == want, t
    assert secret_scan.trigram_query("[0-9a-f]+") == [] and secret_scan.trigram_query("AKIA[A-Z0-9]+")
    out = secret_scan.scan(odd)
    assert out.columns == [*(c for c in odd.columns if c != "secrets"), "secrets"] and out.select("_key").first()._key == 6
    twice = spark.createDataFrame([(1, "password: abcdefgh"), (1, "nothing"), (None, "secret=abcdefgh"), (None, "none")], "doc_id long, text string")
    for most in (secret_scan.BROADCAST_IDS, 0):
        monkeypatch.setattr(secret_scan, "BROADCAST_IDS", most)
        assert sorted((r.text, len(r.secrets)) for r in secret_scan.scan(twice).collect()) == [("none", 0), ("nothing", 0), ("password: abcdefgh", 1), ("secret=abcdefgh", 1)]
    assert out.count() == len(ODD) and secret_scan.scan(odd.limit(0)).count() == 0


def test_flac(spark, docs, odd):
    rng = np.random.default_rng(1)
    loads = [bytes(64), b"hello " * 5000, rng.integers(0, 256, 9000, dtype=np.uint8).tobytes(), bytes(range(256)) * 40, (b"\0" * 500 + b"\xff") * 30]
    for lpc in (None, ([7, -3], 3, 5), "fit"):
        found = flac.decode(flac.encode(loads, lpc))
        assert [b"".join(p for _, p in x) for x in found] == loads
        assert [o for o, _ in found[1]] == list(range(0, 30000, flac.BLOCK))
    wave = ((np.sin(np.arange(30_000) / 9) * 90 + np.sin(np.arange(30_000) / 2) * 20).astype(np.int8).view(np.uint8) ^ 128).tobytes()
    alone, several = flac.encode([wave])[0], flac.encode([*loads, wave] * 3)
    assert several[len(loads)] == alone and len(alone) < 0.85 * len(flac.encode([wave], None)[0])  # LPC frames, the same in any batch
    assert b"".join(p for _, p in flac.decode([alone])[0]) == wave
    long = rng.integers(90, 120, 5 << 20, dtype=np.uint8).tobytes()  # more frames than a run has
    assert b"".join(p for _, p in flac.decode(flac.encode([long, wave]))[0]) == long
    one = flac.encode(loads[1:2])[0]
    seek = one.index(b"\x83", 42)  # after the stream information
    bare = one[:4] + b"\x80" + one[5:seek] + one[seek + 4 + int.from_bytes(one[seek + 1 : seek + 4], "big") :]
    assert b"".join(p for _, p in flac.decode([bare])[0]) == loads[1]
    broken = bytearray(one)
    broken[-10] ^= 4
    with pytest.raises((ValueError, IndexError)):
        flac.decode([bytes(broken)])
    bad = spark.createDataFrame([(1, 5, bytearray(one)), (2, 5, broken), (3, 5, bytearray(b"none")), (4, 5, None)], "doc_id long, n_bytes long, media binary")
    assert {r.doc_id: r.error is None for r in flac.decode_media(bad).collect()} == {1: True, 2: False, 3: False, 4: False}
    for df in (docs, odd):
        raw = {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}
        for r in flac.digests(flac.decode_media(flac.encode_media(df))).collect():
            b = raw[r.doc_id]
            pad = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(b), len(pad), zlib.crc32(pad[-64:]))
            import hashlib

            assert r.payload_sha256 == hashlib.sha256(pad).hexdigest()
    assert flac.encode_media(odd.limit(0)).count() == 0
    errors = {r.doc_id: (r.error is None, r.payload_bytes) for r in flac.digests(flac.decode_media(bad)).collect()}
    assert errors == {1: (True, 30_000), 2: (False, 0), 3: (False, 0), 4: (False, 0)}


def test_flac_stream_made_by_hand():
    """A stream laid out bit by bit from the format's description: a verbatim, a constant, a fixed and an LPC frame."""
    def frame(number: int, n: int, body: str) -> bytes:
        head = bytes([0xFF, 0xF8, 0x60, 0x02, number, n - 1])  # 8-bit size, 8-bit samples, mono
        crc = 0
        for byte in head:
            crc ^= byte
            for _ in range(8):
                crc = (crc << 1 ^ 0x07) & 0xFF if crc & 0x80 else crc << 1
        bits = "".join(f"{b:08b}" for b in head + bytes([crc])) + body
        bits += "0" * (-len(bits) % 8)
        data, crc = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)), 0
        for byte in data:
            crc ^= byte << 8
            for _ in range(8):
                crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        return data + crc.to_bytes(2, "big")

    low = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    rice = lambda v, k: "0" * ((2 * v if v >= 0 else -2 * v - 1) >> k) + "1" + low(2 * v if v >= 0 else -2 * v - 1, k) if k else "0" * (2 * v if v >= 0 else -2 * v - 1) + "1"
    first = [5, -7, 100, -128]
    verbatim = "0" + low(1, 6) + "0" + "".join(low(v, 8) for v in first)
    constant = "0" + low(0, 6) + "0" + low(-3, 8)
    ramp = [10, 12, 14, 17]  # order 1, residuals 2 2 3 in one partition of parameter 1
    fixed = "0" + low(9, 6) + "0" + low(10, 8) + "00" + "0000" + low(1, 4) + "".join(rice(v, 1) for v in (2, 2, 3))
    line = [1, 3, 5, 8]  # LPC order 2, 2 x[t-1] - x[t-2], shift 0, residuals 0 1
    linear = "0" + low(33, 6) + "0" + low(1, 8) + low(3, 8) + low(3 - 1, 4) + low(0, 5) + low(2, 3) + low(-1, 3) + "00" + "0000" + low(0, 4) + rice(0, 0) + rice(1, 0)
    samples = first + [-3] * 4 + ramp + line
    frames = b"".join(frame(i, 4, body) for i, body in enumerate((verbatim, constant, fixed, linear)))
    import hashlib

    info = (4).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    found = flac.decode([b"fLaC\x80\x00\x00\x22" + info + frames])[0]
    assert [o for o, _ in found] == [0, 4, 8, 12]
    assert [b - 128 for _, p in found for b in p] == samples


def test_quality_rules(spark, odd):
    out = quality_rules.judge(odd)
    got = {r.doc_id: r for r in out.collect()}
    assert got[7].n_words == 30_000 and got[7].n_repeat_words == 30_000 and got[7].base_failed and not got[1].kept
    assert quality_rules.quality_filter(odd).columns == odd.columns and quality_rules.judge(odd.limit(0)).count() == 0
    clean = spark.createDataFrame([(1, " ".join(f"the word{i} of" for i in range(60)))], "doc_id long, text string")
    assert quality_rules.quality_filter(clean).count() == 1


def test_quality_classifier(spark, odd):
    sf = "/root/testdata/sf0.1"
    out = quality_classifier.op8_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = out.join(labels, "doc_id").filter("held_out").select("score", "quality", "predicted").toPandas()
    order = both["score"].rank()
    pos = both["quality"] == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, len(quality_classifier.STATISTICS)))
    rules = [(tuple((int(f), bool(rng.integers(2)), float(rng.normal())) for f in rng.choice(x.shape[1], 2, replace=False)), float(rng.normal())) for _ in range(45)]
    z = 0.3 + sum(w * quality_classifier.holds(x, r) for r, w in rules)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, " + ", ".join(f"{c} double" for c in quality_classifier.STATISTICS))
    column = {r.i: r.s for r in rows.select("i", quality_classifier.score_column((0.3, rules)).alias("s")).collect()}
    assert all(math.isclose(column[i], 1 / (1 + math.exp(-v)), rel_tol=1e-9) for i, v in enumerate(z))
    none = labels.limit(0).select("doc_id", "quality")
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    assert quality_classifier.learn(d, none) == (0.0, [])
    model = (0.3, [(((0, True, 5.0), (2, False, 0.1)), 1.5)])
    odd_scores = quality_classifier.statistics(odd.select("doc_id", "text")).select("doc_id", quality_classifier.score_column(model).alias("s")).collect()
    assert len(odd_scores) == len(ODD) and all(0 < r.s < 1 for r in odd_scores)
    assert quality_classifier.statistics(odd.select("doc_id", "text").limit(0)).count() == 0


def test_pieces(spark, docs, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for df in (docs.select("doc_id", "text"), odd):
        n = 0
        for r in pieces.decode(pieces.encode(df)).collect():
            t = r.text or ""
            assert r.decoded == t.replace(pieces.SPACE, " ")
            if "  " not in t and pieces.SPACE not in t:
                n += 1
                assert list(r.ids) == library.encode(t)
        assert n
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(["  ", "   ", " ", pieces.SPACE, "the", "ing", "\n", "é", "x", "7"], int(rng.integers(0, 40)))) for _ in range(400)]
    runs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert all(list(r.ids) == library.encode(texts[r.doc_id]) for r in pieces.encode(runs).collect())
    assert pieces.encode(odd.limit(0)).count() == 0


def test_line_dedup(spark, odd):
    out = line_dedup.dedup_lines(odd)
    got = {r.doc_id: r for r in out.collect()}
    assert got[5].text == "a long line that repeats\nb" and got[6].text == "c" and got[6].n_dropped == 1 and (got[1].n_lines, got[1].n_dropped) == (1, 0)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == [c for c in odd.columns if c != "n_lines"] and out.first()["_id"] == 5
    assert line_dedup.without_repeats(odd).columns == odd.columns
    one_id = spark.createDataFrame([(1, "this line is known"), (5, "this line is known\na"), (5, "own words of it\nthis line is known"), (None, "nobody has this line")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(one_id).collect()) == ["a", "nobody has this line", "own words of it", "this line is known"]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    hot = spark.createDataFrame([(i, f"the very same line\nown line number {i}") for i in range(500)], "doc_id long, text string")
    assert line_dedup.dedup_lines(hot).agg(F.sum("n_dropped")).first()[0] == 499


def quality_by_hand(text: str | None) -> bool:
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, windows = len(w), Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = len({i + k for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)})
    if n < 50 or 100 * repeated > 50 * n or not 2 <= sum(map(len, w)) / n <= 15:
        return False
    return len(re.findall(r"[#*$%&|<>]", text)) <= 0.25 * n and len(lines) - len(set(lines)) <= 0.6 * len(lines) and bool(set(w) & set(quality_rules.STOP_WORDS))


def lines_by_hand(rows: list) -> list:
    """(id, text) without the lines whose key a smaller id has."""
    key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    has: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                has.setdefault(key(x), set()).add((i is not None, i or 0))
    gone = lambda i, x: len(has.get(key(x), ())) > 1 and min(has[key(x)]) != (i is not None, i or 0)
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]


def copies_by_hand(rows: list, sources: list) -> Counter:
    import hashlib

    n, out = Counter(sources), Counter()
    weight = {s: k**source_mix.TEMPERATURE for s, k in n.items()}
    for (i, t), s in zip(rows, sources, strict=True):
        rate = len(rows) * weight[s] / sum(weight.values()) / n[s]
        u = int(hashlib.md5(f"{source_mix.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        out[i, t] += k
    return +out


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    before = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*before.columns, "ids"]
    rows = before.select("doc_id", "text", "source").collect()
    kept = [r for r in rows if quality_by_hand(r.text)]
    texts = lines_by_hand([(r.doc_id, r.text) for r in kept])
    first = {i for i, _, c in by_hand_components(texts) if i == c}
    stay = [(x, r.source) for x, r in zip(texts, kept, strict=True) if x[0] in first]
    want = copies_by_hand([x for x, _ in stay], [s for _, s in stay])
    got = pieces.decode(out).collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and len(kept) < len(rows)
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert all(r.decoded == (r.text or "").replace(pieces.SPACE, " ") for r in got)


def test_pipeline_keeps_odd_columns(spark, odd):
    """Each stage on nulls, repeats, long texts and columns of the operators' own names: these come back with their values."""
    import corpus_pipeline

    good = " ".join(f"the word{i} of" for i in range(60))
    more = spark.createDataFrame([(20, good, "t", 5, "x", *range(8)), (21, good + " end", None, 6, "y", *range(8)), (None, good, "t", 7, "z", *range(8))], odd.schema)
    docs, own = odd.unionByName(more), [c for c in odd.columns if c not in ("doc_id", "text", "source")]
    held = {r.ids: tuple(r[c] for c in own) for r in more.collect()}
    # Line dedup keeps the line with the null id, so row 5 is empty then; row 7 is near row 6, which has an id.
    stays = {"quality_rules": {5, 6, 7}, "line_dedup": {5, 6, 7}, "ngram_join": {5, 6}, "source_mix": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
        rows = docs.collect()
        for r in rows:
            if r.ids in held:
                assert tuple(r[c] for c in own) == held[r.ids]
        if stays[name] is not None:
            assert {r.n_lines for r in rows if r.ids in held} == stays[name]
        docs = spark.createDataFrame(rows, odd.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(last.columns) == set(odd.columns) and dict(last.dtypes)["ids"] == "array<int>"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
