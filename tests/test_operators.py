import datetime
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions.frontmatter import parse_yaml
from tessella.functions.splitter import split_text
from tessella.functions.text import classify_strategy, frontmatter_body, frontmatter_yaml, merge_short, numbered_lines, sections
from tessella.operators import catalog, chunks, memory, retrieval, review, summaries, sync, tasks
from tessella.operators.vectors import knn, where
from tessella.sources import config, datasets, files, sinks
from tessella.streaming import jobs


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def merged_by_hand(parts, least=100):
    out, heading, body = [], "", ""
    for h, b in parts:
        s = b.strip()
        if body:
            s, h = body.rstrip() + "\n\n" + s, heading
            b = s
        if len(s.strip()) < least:
            heading, body = h, s
        else:
            out.append((h, b))
            heading, body = "", ""
    if body:
        if out:
            out[-1] = (out[-1][0], out[-1][1].rstrip() + "\n\n" + body)
        else:
            out = [(heading, body)]
    return out


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("What is a heap?", "hyde"), ("Compare A and B in depth please", "multi_query"), ("heap sort", "multi_query"), ("", "none"), ("   ", "none"), (None, "none"), ("什么是堆", "multi_query"),
        ("请问什么是二叉树以及它的遍历方法", "hyde"), ("A 和 B 的区别", "multi_query"), ("does this really work in practice?", "hyde"), ("I store all of my notes in this folder", "none"), ("Pros and cons of recursion", "multi_query"),
    ],
)
def test_strategy(spark, text, expected):
    assert one(spark, classify_strategy("t"), text) == expected


def test_frontmatter(spark):
    text = "---\r\ntitle: A\r\ntags: x\r\n---\r\nBody --- here"
    assert one(spark, frontmatter_body("t"), text) == "Body --- here"
    assert parse_yaml(one(spark, frontmatter_yaml("t"), text))["tags"] == ["x"]
    assert one(spark, frontmatter_body("t"), "no frontmatter ---\n") == "no frontmatter ---\n"
    assert one(spark, frontmatter_yaml("t"), "a\n---\nb: c\n---\n") is None
    assert parse_yaml("[1, 2") == parse_yaml("- a\n- b") == {"title": None, "category": None, "tags": [], "difficulty": None, "pack_id": None}
    assert parse_yaml("title: 5\ntags: [1, b]\nother: 3") == {"title": "5", "category": None, "tags": ["1", "b"], "difficulty": None, "pack_id": None}


def test_sections(spark):
    long = "x" * 120
    for text in (f"pre\n# A\n{long}\n## B\nshort\n### C\n{long}", "# only\n", "plain", "", f"# A\nhi\n# B\nyo\n# C\n{long}\n# D\nend", "#\n\nnext line is the heading\nbody", "####### seven\n# ok\ntext"):
        found = [tuple(x) for x in one(spark, sections("t"), text)]
        assert [tuple(x) for x in one(spark, merge_short(sections("t")), text)] == merged_by_hand(found)
    assert [tuple(x) for x in one(spark, sections("t"), "a\n# H \nb")] == [("", "a\n"), ("H", "\nb")]


def test_split():
    text = " ".join(f"word{i}" for i in range(600)) + "\n\n" + "y" * 2500
    parts = split_text(text)
    assert all(0 < len(p) <= 1000 for p in parts)
    assert all(w in " ".join(parts) for w in ("word0", "word599"))
    assert split_text(None) == split_text("") == []
    assert split_text("short") == ["short"]
    overlap = [a for a, b in zip(parts, parts[1:], strict=False) if a[-5:] in b]
    assert overlap


def test_chunks(spark):
    text = "---\ntitle: T\ntags: [a, b]\n---\n# One\n" + "a " * 900 + "\n# Two\n" + "b" * 150
    docs = spark.createDataFrame([("d.md", text), ("e.txt", "# not split\nplain"), ("f.md", ""), ("g.md", "---\ntitle: X\n---\n  ")], "file_path string, text string")
    rows = {(r.file_path, r.chunk_index): r for r in chunks.chunk_documents(docs).collect()}
    assert {p for p, _ in rows} == {"d.md", "e.txt"}
    of = [rows["d.md", i] for i in range(sum(p == "d.md" for p, _ in rows))]
    assert [r.section_heading for r in of] == ["One"] * (len(of) - 1) + ["Two"] and len(of) >= 3
    assert of[0].tags == "a,b" and of[0].chunk_strategy == "heading-aware" and rows["e.txt", 0].chunk_strategy == "fixed-split" and rows["e.txt", 0].tags is None


def test_knn_filters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    base = spark.createDataFrame([(i, x[i].tolist(), i % 3, None if i % 7 else "p") for i in range(300)], "key int, vector array<float>, label int, pack string")
    asked = base.filter("key < 5").select(F.col("key").alias("query_id"), "vector", "label")
    got = {(r.query_id, r["rank"]): r.key for r in knn(asked, base, 4).collect()}
    d = ((x[:5, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    assert got == {(q, r + 1): int(k) for q in range(5) for r, k in enumerate(np.argsort(d[q], kind="stable")[:4])}
    assert all(r.key % 7 == 0 for r in knn(asked, base, 4, condition={"pack": "p"}).collect())
    assert knn(asked, base, 4, condition={"pack": "none"}).count() == 0
    assert base.filter(where({"$or": [{"label": {"$ne": 0}}, {"key": {"$lt": 3}}]})).count() == 201
    assert knn(asked, base, 400).count() == 5 * 300
    with pytest.raises(ValueError):
        where({"label": {"$like": 1}})


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_knn_ties_by_key(spark, metric):
    """Copies of a vector, more than a batch keeps: the smallest keys are returned."""
    rng = np.random.default_rng(4)
    copy, far = rng.normal(size=8).astype(np.float32), -rng.random((100, 8)).astype(np.float32)
    keys = [f"k{i:03}" for i in rng.permutation(300)]
    rows = [(key, (copy if key < "k200" else np.sign(copy) * far[int(key[1:]) - 200]).tolist()) for key in keys]
    base = spark.createDataFrame(rows, "key string, vector array<float>")
    asked = spark.createDataFrame([(1, copy.tolist()), (2, (copy * 2).tolist())], "query_id int, vector array<float>")
    for parts in (1, 3):
        got = {(r.query_id, r["rank"]): r.key for r in knn(asked, base.repartition(parts), 5, metric).collect()}
        assert got == {(q, r + 1): f"k{r:03}" for q in (1, 2) for r in range(5)}


def test_answer_prompts(spark):
    docs = spark.createDataFrame([(f"f{i}.md", 0, f"text about topic{i} and more") for i in range(6)], "file_path string, chunk_index int, content string")
    from tessella.functions.models import embed

    held = docs.withColumn("embedding", embed(F.col("content")))
    asked = spark.createDataFrame([(1, "topic3 versus topic4"), (2, "text about topic5 and more")], "query_id int, question string")
    out = retrieval.answer_prompts(asked, held, k=2, rerank_hits=True, expand=lambda q: F.split(q, " versus "))
    hits = {(r.query_id, r.file_path) for r in out["hits"].collect()}
    assert (2, "f5.md") in hits
    assert all("Question: " in r.messages[1].content for r in out["prompts"].collect())
    assert out["sources"].filter("query_id = 2 and place = 1").first().file_path == "f5.md"


def test_sync(spark):
    now = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    row = lambda p, h, t, e=None: (p, p, 1, h, datetime.datetime(2024, 1, 1), t, e)
    kind = "file_path string, file_name string, file_size long, file_hash string, modified_at timestamp, text string, error string"
    first = spark.createDataFrame([row("a.md", "1", "alpha"), row("b.md", "2", "beta"), row("c.pdf", "3", None, "bad")], kind)
    empty = spark.createDataFrame([], schemas.DOCUMENTS)
    none = spark.createDataFrame([], schemas.CHUNKS)
    s = sync.sync(first, empty, none, now)
    docs = spark.createDataFrame(s["documents"].collect(), schemas.DOCUMENTS)
    held = spark.createDataFrame(s["chunks"].select(*schemas.CHUNKS.names).collect(), schemas.CHUNKS)
    assert {(r.file_path, r.status, r.file_hash, r.chunk_count) for r in docs.collect()} == {("a.md", "indexed", "1", 1), ("b.md", "indexed", "2", 1), ("c.pdf", "error", None, 0)}
    then = spark.createDataFrame([row("a.md", "1", "alpha"), row("b.md", "9", "beta two"), row("c.pdf", "3", "now fine")], kind).filter("file_path <> 'a.md'")
    t = sync.sync(then, docs, held, now)
    assert {(r.file_path, r.change) for r in t["diff"].collect()} == {("a.md", "deleted"), ("b.md", "modified"), ("c.pdf", "modified")}
    assert t["counters"].first().asDict() == {"new": 0, "modified": 2, "deleted": 1}
    assert {(r.file_path, r.content) for r in t["chunks"].collect()} == {("b.md", "beta two"), ("c.pdf", "now fine")}
    assert {(r.file_path, r.status, r.error_message) for r in t["documents"].collect()} == {("b.md", "indexed", None), ("c.pdf", "indexed", None)}


def test_compress_and_clear(spark):
    m = spark.createDataFrame([(i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 8)], "id long, role string, content string")
    none = spark.createDataFrame([], "id long, summary string, last_message_id long, first_message_id long")
    due = memory.compress(m, none, 5, model=lambda c: F.concat(F.lit("S:"), F.substring(c, 1, 8))).first()
    assert (due.n_messages, due.first_message_id, due.last_message_id, due.summary) == (7, 1, 7, "S:User: m1")
    assert memory.compress(m, none, 8).count() == memory.compress(m, none, 0).count() == 0
    assert memory.advance(none, memory.compress(m, none, 5)).count() == 0  # without a model a summary is blank
    kept = memory.advance(none, memory.compress(m, none, 5, model=lambda c: F.lit("x")))
    assert memory.unsummarised(m, kept).count() == 0
    assert memory.last_messages(m, 0).count() == 0
    assert [r.id for r in memory.history_page(m, 2, 3).collect()] == [4, 5]
    with pytest.raises(ValueError):
        memory.history_page(m, 501)
    assert memory.clear(m, none)[2].first().deleted == 7


def test_review(spark):
    def by_hand(grades):
        n, e, i = 0, 2.5, 1
        for q in grades:
            e = max(1.3, e + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
            n, i = (0, 1) if q < 2 else (n + 1, 1 if n == 0 else 6 if n == 1 else round(i * e))
        return n, i

    for grades in ([4, 4, 4, 4], [3, 3, 3, 0, 3, 3, 3], [2, 4, 2, 4, 2, 4], [0], [4, 1]):
        rows = spark.createDataFrame([(1, k, g) for k, g in enumerate(grades)], "item int, no int, grade int")
        r = review.replay(rows, "item", ["no"]).first()
        assert (r.repetitions, r.interval) == by_hand(grades)


def test_tree_catalog_tasks_summaries(spark):
    nodes = catalog.tree(spark.createDataFrame([("b/x.md",), ("b/a/y.md",), ("B.md",), (None,), ("",)], "file_path string"))
    rows = [(r.node_path, r.type) for r in nodes.filter("parent = ''").orderBy(*catalog.tree_order()).collect()]
    assert rows == [("b", "directory"), ("B.md", "file")]
    assert {r.node_path for r in catalog.files_of(nodes).collect()} == {"b/x.md", "b/a/y.md", "B.md"}
    packs = spark.createDataFrame([("p1", "Graphs", None, ["bfs"]), ("p2", "Heaps", "about graphs", None), ("p3", "Tries", "x", [])], "pack_id string, name string, description string, tags array<string>")
    assert catalog.search_packs(packs, "GRAPH").count() == 2 and catalog.search_packs(packs, " ").count() == 3 and catalog.search_packs(packs, "bfs").count() == 1
    log = spark.createDataFrame([("t", "b", True, "bad b"), ("t", "a", True, "bad a"), ("u", "a", True, None), ("v", "a", False, None)], "task_id string, file_path string, done boolean, error string")
    assert {(r.task_id, r.status, r.errors, r.percent) for r in tasks.roll_up(log).collect()} == {("t", "failed", "bad a\nbad b", 100), ("u", "completed", None, 100), ("v", "running", None, 0)}
    held = spark.createDataFrame([], schemas.SUMMARIES)
    docs = spark.createDataFrame([("a", "long text"), ("b", " ")], "file_path string, text string")
    assert {(r.file_path, r.summary) for r in summaries.summarise(docs, held, F.current_timestamp(), lambda c: c).collect()} == {("a", "long text")}


def test_numbered_lines(spark):
    assert one(spark, numbered_lines("t"), "intro\n1. one\n 2) two \n3 three\n- x") == ["one", "two"]


def test_files(spark, tmp_path):
    (tmp_path / "k" / "sub").mkdir(parents=True)
    (tmp_path / "k" / "a.md").write_text("# A\nä")
    (tmp_path / "k" / "sub" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "k" / "sub" / "c.md").write_bytes(b"\xff\xfe")
    (tmp_path / "k" / "d.MD").write_text("no")
    rows = {r.file_path: r for r in files.read_texts(files.discover(spark, str(tmp_path / "k"))).collect()}
    assert set(rows) == {"a.md", "sub/b.pdf", "sub/c.md"}
    assert rows["a.md"].text == "# A\nä" and rows["a.md"].error is None and rows["sub/c.md"].text is None and rows["sub/b.pdf"].error
    fine = {r.file_path: r.text for r in files.read_texts(files.discover(spark, str(tmp_path / "k")), pdf=lambda c: [("page", None)] * len(c)).collect()}
    assert fine["sub/b.pdf"] == "page"
    for path, ok in {"a/b": True, "../a": False, "a/../../b": False, "/a": False, "a/../b": True, "": False, "c:\\x": False}.items():
        assert one(spark, files.is_safe(F.col("t")), path) is ok
    packed = sinks.archives(files.discover(spark, str(tmp_path / "k")))
    assert {r.file_path for r in sinks.unpacked(packed).collect()} == set(rows)


def test_datasets_and_config(spark, tmp_path):
    rows = [{"question": "q1", "ground_truth": "a"}, {"question": "q2", "ground_truth": "b"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    for name in ("a.json", "b.jsonl"):
        assert datasets.evaluation_set(spark, str(tmp_path / name)).count() == 2
    (tmp_path / "c.jsonl").write_text('{"question": "q"}\n')
    with pytest.raises(Exception, match="required"):
        datasets.evaluation_set(spark, str(tmp_path / "c.jsonl")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "packs": [{"id": "p", "name": "n", "tags": ["t"], "file_count": 2, "size_kb": 3, "path": "p/"}]}))
    assert datasets.manifest(spark, str(tmp_path / "m.json")).first().pack_id == "p"
    (tmp_path / "f.json").write_text('["a.md", "b.md"]')
    assert datasets.pack_files(spark, str(tmp_path / "f.json")).count() == 2
    (tmp_path / "c.yaml").write_text("use_hyde: true\nk: 7\nunknown: 1\n")
    s = config.load(str(tmp_path / "c.yaml"))
    assert (s.pre_retrieval_strategy, s.k) == ("hyde", 7)
    config.save(s, str(tmp_path / "d.yaml"))
    assert config.load(str(tmp_path / "d.yaml")) == s and config.load(str(tmp_path / "none.yaml")) == config.Settings()
    with pytest.raises(ValueError):
        config.Settings(pre_retrieval_strategy="x")


def test_schemas(spark):
    old = spark.createDataFrame([("a", 1)], "file_path string, odd int")
    assert schemas.conform(old, schemas.SUMMARIES).columns == schemas.SUMMARIES.names
    assert schemas.missing_columns(old, schemas.SUMMARIES) == ["summary", "created_at", "updated_at"]
    with pytest.raises(Exception, match="grade"):
        old.select(schemas.checked(F.lit(7), schemas.GRADES, "grade")).collect()


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    kind = "conv_id long, id long, role string, content string"
    spark.createDataFrame([(c, i, "user", f"m{i}") for c in (1, 2) for i in range(1, 3 + 2 * c)], kind).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(kind).parquet(str(src))
    q = jobs.compress_stream(stream, 5).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.conv_id, r.first_message_id, r.last_message_id, r.n_messages) for r in spark.read.parquet(str(out)).collect()] == [(2, 1, 6, 6)]
    spark.createDataFrame([("x.MD", None), ("y.txt", "z.pdf"), ("q.txt", None)], "path string, destination string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    seen = []
    q = jobs.on_changes(spark.readStream.schema("path string, destination string").parquet(str(tmp_path / "ev")), lambda s, df: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp2"), every=None)
    q.awaitTermination()
    assert sorted(seen) == ["x.MD", "z.pdf"]


def test_knn_without_vectors_or_labels_and_in_blocks(spark, monkeypatch):
    """1,200 equal vectors in several partitions; null vectors and labels; more queries than are broadcast."""
    from tessella.operators import vectors

    base = spark.range(1200).select(F.col("id").alias("key"), F.when(F.col("id") % 400 != 3, F.array(F.lit(1.0), F.lit(2.0))).alias("vector"), F.when(F.col("id") % 2 == 0, "even").alias("label"))
    asked = spark.createDataFrame([(q, [1.0, float(q)], "even" if q % 2 else None) for q in range(1, 8)] + [(9, None, "even")], "query_id int, vector array<double>, label string")
    first = [k for k in range(20) if k % 400 != 3]
    for block in (4096, 3):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        for parts in (1, 5):
            rows = knn(asked, base.repartition(parts), 6).collect()
            assert {(r.query_id, r["rank"]): r.key for r in rows} == {(q, r + 1): first[r] for q in range(1, 8) for r in range(6)}
            assert {r.distance for r in rows if r.query_id == 2} == {0.0}
        same = knn(asked, base, 3, match="label").collect()
        assert {(r.query_id, r.key) for r in same} == {(q, k) for q in (1, 3, 5, 7) for k in (0, 2, 4)}
        keyed = base.withColumn("key", F.struct((F.col("key") % 2).alias("a"), F.col("key").alias("b")))
        assert [tuple(r.key) for r in knn(asked.filter("query_id = 1"), keyed, 3).orderBy("rank").collect()] == [(0, 0), (0, 2), (0, 4)]
    assert knn(asked.limit(0), base, 3).count() == 0 and knn(asked, base.limit(0), 3).count() == 0


def test_splitter_by_hand():
    assert split_text(None) == split_text("") == split_text(" \n ") == []
    assert split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert split_text("one\n\ntwo three four", 9, 0) == ["one", "two", "three", "four"]  # "\ntwo" and " three" are ten characters
    assert split_text("one\n\ntwo three four", 10, 0) == ["one", "two three", "four"]
    assert split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert split_text("short", 10, 2) == ["short"]


def test_chunks_of_long_and_blank_documents(spark):
    long = "# A\n" + "word " * 400 + "\n## B\n" + "b" * 120
    rows = [("a.md", long), ("b.md", "---\ntitle: T\n---\n \n"), ("c.txt", "plain"), ("d.md", None), ("e.MD", "# H\n")]
    docs = spark.createDataFrame(rows, "file_path string, text string")
    got = {}
    for r in chunks.chunk_documents(docs).collect():
        got.setdefault(r.file_path, []).append((r.chunk_index, r.section_heading, len(r.content), r.chunk_strategy))
    parts = [len(p) for p in split_text(("word " * 400).strip())]
    assert sorted(got["a.md"]) == [*((i, "A", n, "heading-aware") for i, n in enumerate(parts)), (len(parts), "B", 120, "heading-aware")]
    assert set(got) == {"a.md", "c.txt"} and got["c.txt"] == [(0, None, 5, "fixed-split")]


def test_rename_review_and_tasks_refuse(spark):
    docs = schemas.conform(spark.createDataFrame([("a.md", "a.md"), ("b.md", "b.md"), ("c.md", "c.md")], "file_path string, file_name string"), schemas.DOCUMENTS)
    held = schemas.conform(spark.createDataFrame([("a.md", 0)], "file_path string, chunk_index int"), schemas.CHUNKS)
    moves = spark.createDataFrame([("a.md", "x/n.md"), ("b.md", "c.md")], "file_path string, new_path string")
    out = sync.rename(docs, held, moves)
    assert {(r.file_path, r.file_name) for r in out["documents"].collect()} == {("x/n.md", "n.md"), ("b.md", "b.md"), ("c.md", "c.md")}
    assert out["chunks"].first().file_path == "x/n.md" and out["refused"].count() == 1
    items = spark.createDataFrame([(1, 0, 2.5, 1), (2, 0, 2.5, 1)], "id int, repetitions long, easiness double, interval long").withColumns({"due_date": F.lit("2024-01-01").cast("date"), "updated_at": F.current_timestamp()})
    graded = spark.createDataFrame([(1, 2, 4), (1, 1, 4), (1, 3, 0), (1, 4, None), (9, 1, 4)], "id int, no int, grade int")
    rows = {r.id: (r.repetitions, r.interval) for r in review.apply_reviews(items, graded, F.lit("2024-01-02").cast("date"), F.current_timestamp(), ["no"]).collect()}
    assert rows == {1: (0, 1), 2: (0, 1)}
    none = spark.createDataFrame([], schemas.TASKS)
    now = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    one_task = tasks.start(none, "t", 2, now)
    assert one_task.first().status == "pending"
    log = spark.createDataFrame([("t", "a", True, None), ("t", "b", True, "bad")], "task_id string, file_path string, done boolean, error string")
    after = tasks.advance(one_task, log, now)
    assert (after.first().status, after.first().processed_files, after.first().errors) == ("failed", 2, "bad")
    assert tasks.advance(after, log.withColumn("error", F.lit(None).cast("string")), now).first().status == "failed"
    with pytest.raises(Exception, match="exists"):
        tasks.start(one_task, "t", 1, now).collect()


def test_sync_keeps_metadata_of_blank_files_and_vectors(spark):
    now = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    kind = "file_path string, file_name string, file_size long, file_hash string, modified_at timestamp, text string, error string"
    disk = spark.createDataFrame([("a.md", "a.md", 1, "1", datetime.datetime(2024, 1, 1), "---\ntitle: T\ntags: x\n---\n", None), ("b.md", "b.md", 1, "2", datetime.datetime(2024, 1, 1), "some words", None)], kind)
    none = [spark.createDataFrame([], s) for s in (schemas.DOCUMENTS, schemas.CHUNKS)]
    out = sync.sync(disk, *none, now)
    assert {(r.file_path, r.title, r.tags, r.chunk_strategy, r.chunk_count) for r in out["documents"].collect()} == {("a.md", "T", "x", "fixed-split", 0), ("b.md", None, None, "heading-aware", 1)}
    assert sync.to_migrate(out["documents"]).count() == 0
    chunk = out["chunks"].first()
    assert len(chunk.embedding) == 64 and any(chunk.embedding)
    other = sync.reembed(out["chunks"], lambda c: F.array(F.lit(1.0).cast("float"))).first()
    assert other.embedding == [1.0] and other.content == chunk.content
    more = sync.saved(disk, "n/new.md", "# New\ntext", now)
    assert {r.file_path for r in sync.sync(more, out["documents"], out["chunks"], now)["diff"].filter("change = 'new'").collect()} == {"n/new.md"}
    with pytest.raises(Exception, match="leaves"):
        sync.saved(disk, "../x.md", "t", now).collect()


def test_answers_and_reports(spark, tmp_path):
    from tessella.functions.models import embed
    from tessella.operators import evaluation

    held = spark.createDataFrame([(f"f{i}.md", 0, f"text about topic{i}") for i in range(4)], "file_path string, chunk_index int, content string").withColumn("embedding", embed(F.col("content")))
    asked = spark.createDataFrame([(1, 7, "text about topic3"), (2, 8, "and that one?")], "query_id int, conv int, question string")
    talk = spark.createDataFrame([(1, 8, "user", "tell me of topic2")], "id long, conv int, role string, content string")
    told = spark.createDataFrame([], "id long, conv int, summary string, last_message_id long")
    rows = {r.query_id: r for r in retrieval.answers(asked, held, lambda m: F.when(m[1]["content"].contains("topic2"), "yes "), talk, told, 4, ["conv"], lambda p: F.lit("text about topic2"), k=1, setting="none").collect()}
    assert (rows[1].question, rows[1].sources, rows[1].answer, rows[1].error) == ("text about topic3", ["f3.md"], None, "the model gave no answer")
    assert (rows[2].question, rows[2].sources, rows[2].answer, rows[2].error) == ("text about topic2", ["f2.md"], "yes", None)
    out = spark.createDataFrame(list(rows.values()))
    sinks.write_answers(out, str(tmp_path / "chat"), F.to_timestamp(F.lit("2024-05-01 00:00:00")))
    chat = spark.read.parquet(str(tmp_path / "chat"))
    assert sorted((r.id, r.role, r.content) for r in chat.collect()) == [(2, "user", "text about topic3"), (4, "user", "text about topic2"), (5, "assistant", "yes")]
    questions = evaluation.numbered(asked.select("query_id", "question", F.lit("x").alias("ground_truth")), ["query_id"])
    scored = evaluation.evaluate(questions, out.join(questions.select("query_id", "no"), "query_id").filter("query_id = 2"))
    sinks.write_report(evaluation.report(scored, ["answered", "n_sources"]), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().answered == 0.5
    files_ = spark.createDataFrame([("a.md", b"A")], "file_path string, content binary")
    packed = {r.file_path: bytes(r.content) for r in sinks.unpacked(sinks.full_export(files_, chat, "k: 5\n")).collect()}
    assert set(packed) == {"knowledge/a.md", "config.yaml", "chat/000000000000.jsonl"} and packed["chat/000000000000.jsonl"].count(b"\n") == 2
    packs = spark.createDataFrame([("p", "n")], "pack_id string, name string")
    assert datasets.pack(packs, "p").first().name == "n"
    with pytest.raises(KeyError):
        datasets.pack(packs, "q")


def test_stream_syncs(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.md").write_text("hello there")
    spark.createDataFrame([("a.md", None)], "path string, destination string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    got = []
    read = lambda s: tuple(s.createDataFrame([], k) for k in (schemas.DOCUMENTS, schemas.CHUNKS))
    q = jobs.sync_on_changes(spark.readStream.schema("path string, destination string").parquet(str(tmp_path / "ev")), str(tmp_path / "k"), read, lambda out: got.extend((r.file_path, r.status) for r in out["documents"].collect()), str(tmp_path / "cp"), every=None)
    q.awaitTermination()
    assert got == [("a.md", "indexed")]


def test_model_registry(spark):
    from tessella.functions import models

    files_ = spark.createDataFrame([("models--all-MiniLM-L6-v2/config.json",), ("models--all-MiniLM-L6-v2/w.bin",), ("other/x",)], "file_path string")
    assert {(r.language, r.downloaded) for r in models.registry(files_).collect()} == {("english", True), ("chinese", False), ("mixed", False)}


def test_equal_queries_are_searched_for_once(spark, monkeypatch):
    from tessella.operators import vectors

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    base = spark.createDataFrame([(i, [float(i % 4), 0.5], i % 3) for i in range(60)], "key long, vector array<float>, m long")
    asked = spark.createDataFrame([(i, [float(i % 2), 0.0], i % 3) for i in range(40)], "query_id long, vector array<float>, m long")
    for match, parts in ((None, 1), ("m", 2)):
        found = vectors.knn(asked, base, 4, match=match)
        near = lambda q: sorted(((i % 4 - q % 2) ** 2 + 0.25, i) for i in range(60) if not match or i % 3 == q % 3)[:4]
        assert sorted((r.query_id, r["rank"], r.key, r.distance) for r in found.collect()) == sorted((q, n, i, d) for q in range(40) for n, (d, i) in enumerate(near(q), 1))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == parts  # of 2 and of 6 different queries


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_search_holds_little(metric):
    import tracemalloc

    from tessella.operators import vectors

    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((10_000, 64)), rng.standard_normal((1024, 64))
    tracemalloc.start()
    for _ in vectors._nearest(pa.array(range(1024)), q, None, pa.array(range(10_000)), x, None, 5, metric):
        pass
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_equal_vectors_hold_little():
    import tracemalloc

    from tessella.operators import vectors

    x = np.array([[i % 3, i % 2] for i in range(10_000)], float)
    tracemalloc.start()
    names, kept, _ = vectors._first_of_equal(pa.array(range(10_000)), x, None, 9)
    assert len(kept) == 54 and names.to_pylist()[:6] == [0, 1, 2, 3, 4, 5]
    for _ in vectors._nearest(pa.array(range(1024)), x[:1024], None, names, kept, None, 9, "l2"):
        pass
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_splitter_holds_few_strings():
    import tracemalloc

    from tessella.functions import splitter

    texts = pa.array([f"{i} " + "word and word " * 700 for i in range(2000)])
    tracemalloc.start()
    got = splitter._cut(texts)
    assert tracemalloc.get_traced_memory()[1] < 10e6  # of 20 MB of texts
    tracemalloc.stop()
    assert got[7].as_py() == splitter.split_text(texts[7].as_py())
    assert splitter.split_each.func(pa.array([["a", None], None, ["b" * 1500]])).to_pylist() == [[["a"], None], None, [splitter.split_text("b" * 1500)]]


def test_fixed_chunks_come_a_few_texts_at_a_time():
    from tessella.functions import splitter

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([None, "", *["word and word " * 700] * 998])], ["file_path", "text"])
    got = list(splitter.split_rows([batch]))
    assert len(got) > 5 and max(b.nbytes for b in got) < 3e6
    want = splitter.split_text("word and word " * 700)
    assert [r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(k, n, c) for k in range(2, 1000) for n, c in enumerate(want)]


def test_one_worker_cuts_both_kinds_of_documents(spark):
    docs = spark.createDataFrame([("a.md", "# H\n" + "word " * 900), ("b.txt", "short"), ("c.txt", None), ("d.md", "---\ntitle: x\n---\n"), ("e.txt", "many words " * 200), (None, "x")], "file_path string, text string")
    found = chunks.parsed(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split_each") > 0 and plan.count("ArrowEvalPython") == 2  # frontmatter and cuts
    got = {r.file_path: (r.chunk_strategy, [tuple(c) for c in r["_chunks"]]) for r in found.collect()}
    assert got["a.md"] == ("heading-aware", [("H", c) for c in split_text(("word " * 900).strip())])
    assert got["b.txt"] == ("fixed-split", [(None, "short")]) and got["e.txt"] == ("fixed-split", [(None, c) for c in split_text("many words " * 200)])
    assert got["c.txt"] == got["d.md"] == ("fixed-split", []) and got[None] == ("fixed-split", [(None, "x")])
