"""Queries of ingest, sync, memory, review, catalog and task operators.

Stand-ins: documents are the files, labels (with pages) the stored snapshot, conversations the chat history, events the
reviews, parts the packs and review items, page addresses the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import catalog, chunks, folders, memory, review, summaries, sync, tasks
from tessella.schemas import DOCUMENTS, conform
from tessella.sources import buckets, pdf
from tessella.sources.files import is_ingestable, is_safe
from tessella.sources.workspace import fresh


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.withColumns({"text": F.coalesce("text", F.lit("")), "file_path": F.concat(F.lit("doc/"), "doc_id", F.lit(".md"))})


def _at(moment: str):
    return F.to_timestamp(F.lit(moment))


THEN, NOW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Texts


def content_hash(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"))


def text_measures(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("doc_id", F.length(t.strip("text")).cast("long").alias("stripped_chars"), t.word_count("text").cast("long").alias("n_words"), t.cjk_count("text").cast("long").alias("n_cjk"), t.is_cjk("text").alias("is_cjk"), t.is_short_query("text").alias("is_short"))


def _markdown(spark, sf_dir) -> DataFrame:
    """Documents with frontmatter (English ones without) and a heading for each line."""
    head = F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("---\ntitle: Of "), "source", F.lit("\ncategory: "), "lang", F.lit("\ntags: [a, b]\npack_id: p1\n---\n")))
    return _documents(spark, sf_dir).withColumn("text", F.concat(head, F.lit("# First\n"), F.replace("text", F.lit("\n"), F.lit("\n\n## Next\n"))))


def frontmatter_split(spark, sf_dir):
    d = _markdown(spark, sf_dir)
    return d.select("doc_id", t.frontmatter_yaml("text").alias("yaml"), F.sha2(t.frontmatter_body("text"), 256).alias("body_sha256"))


def frontmatter_fields(spark, sf_dir):
    from tessella.functions.frontmatter import frontmatter

    d = _markdown(spark, sf_dir).select("doc_id", sync.metadata(frontmatter(F.col("text"))).alias("m"))
    return d.select("doc_id", "m.*")


def section_split(spark, sf_dir):
    s = _markdown(spark, sf_dir).select("doc_id", t.sections("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sections"), F.array_join(F.transform("s", lambda x: x["heading"]), "|").alias("headings"), F.sha2(F.array_join(F.transform("s", lambda x: x["body"]), "|"), 256).alias("bodies_sha256"))


def sections_merged(spark, sf_dir):
    s = _markdown(spark, sf_dir).select("doc_id", t.merge_short(t.sections("text")).alias("s"))
    return s.select("doc_id", F.posexplode("s").alias("no", "s")).select("doc_id", "no", "s.*")


def chunks_fixed(spark, sf_dir):
    return chunks.fixed_chunks(_documents(spark, sf_dir))


def chunks_by_heading(spark, sf_dir):
    return chunks.heading_chunks(_markdown(spark, sf_dir))


def chunks_with_metadata(spark, sf_dir):
    return chunks.chunk_documents(_markdown(spark, sf_dir))


def chunk_counts(spark, sf_dir):
    return chunks.chunk_counts(chunks_fixed(spark, sf_dir))


#: Lines on a page of the PDF files that are made of documents.
PAGE_LINES = 40


def pdf_texts(spark, sf_dir):
    """Each document made into a PDF of pages of PAGE_LINES lines, with a font whose map has all codes, and read back."""
    lines = F.split("text", "\n", -1)
    d = _documents(spark, sf_dir).select("doc_id", lines.alias("l"), F.ceil(F.size(lines) / PAGE_LINES).cast("int").alias("n"))
    shown = F.expr(f"transform(sequence(0, n - 1), p -> array_join(transform(slice(l, p * {PAGE_LINES} + 1, {PAGE_LINES}), x -> concat('<', hex(encode(x, 'UTF-16BE')), '> Tj T*\\n')), ''))")
    body = F.expr("""concat('%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [',
        array_join(transform(sequence(0, n - 1), p -> concat(5 + 2 * p, ' 0 R')), ' '), '] /Resources << /Font << /F 3 0 R >> >> >> endobj\n3 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >> endobj\n',
        '4 0 obj << /Length 56 >> stream\n1 beginbfrange\n<0000> <FFFF> <0000>\nendbfrange\n           \nendstream endobj\n',
        array_join(transform(shown, (x, p) -> concat(5 + 2 * p, ' 0 obj << /Type /Page /Contents ', 6 + 2 * p, ' 0 R >> endobj\n', 6 + 2 * p, ' 0 obj << /Length ', length(x) + 17, ' >> stream\nBT /F 9 Tf 9 TL\n', x, 'ET\nendstream endobj\n')), ''), '%%EOF')""")
    made = d.withColumn("shown", shown).select(F.concat(F.lit("doc/"), "doc_id", F.lit(".pdf")).alias("file_path"), F.encode(body, "UTF-8").alias("content"))
    return pdf.texts(made)


def section_spaces(spark, sf_dir):
    """Headings whose spaces are wide or don't break, and numbers in other digits before lines."""
    d = _documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n##\u3000Next\u00a0part\n#\u00a0Other\n####\u2003\u3000deep\n#no\n")))
    s = d.select("doc_id", t.sections("text").alias("s"), t.numbered_lines(F.concat(F.lit("1.\u3000one\n\u0662) two\n"), "text")).alias("v"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sections"), F.array_join(F.transform("s", lambda x: x["heading"]), "|").alias("headings"), F.sha2(F.array_join(F.transform("s", lambda x: x["body"]), "|"), 256).alias("bodies_sha256"), F.array_join("v", "|").alias("numbered"))


def numbered_variants(spark, sf_dir):
    """Numbered lines of each document, with its source before them."""
    d = _documents(spark, sf_dir).withColumn("text", F.concat(F.lit("intro\n1. "), F.replace("text", F.lit("\n"), F.lit("\n  2) "))))
    v = d.select("doc_id", t.with_original(t.numbered_lines("text"), "source").alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("n"), F.sha2(F.array_join("v", "|"), 256).alias("variants_sha256"))


def path_parts(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("page_id", t.basename("file_path").alias("base"), t.parent("file_path").alias("parent"), t.extension("file_path").alias("extension"), is_ingestable(F.col("file_path")).alias("ingestable"), is_safe(F.col("file_path")).alias("safe"))


# Sync


def _disk(spark, sf_dir) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("file_path", t.basename("file_path").alias("file_name"), F.octet_length("text").cast("long").alias("file_size"), F.sha2("text", 256).alias("file_hash"), _at(NOW).alias("modified_at"), "lang")


def _stored(spark, sf_dir) -> DataFrame:
    """Labelled documents, with their hash (quality 1), without one (toxic) or with another; and pages that are gone."""
    hashed = _documents(spark, sf_dir).select("doc_id", "file_path", "lang", F.sha2("text", 256).alias("_text"), F.sha2("source", 256).alias("_source"))  # no text is joined
    d = hashed.join(_read(spark, sf_dir, "labels"), "doc_id")
    known = F.when(F.col("quality") == 1, F.col("_text")).when(F.col("toxic") == 0, F.col("_source"))
    d = d.select("file_path", known.alias("file_hash"), F.when(F.col("toxic") == 1, "error").otherwise("indexed").alias("status"), F.when(F.col("toxic") == 1, "bad file").alias("error_message"), F.when(F.col("lang") == "en", "heading-aware").alias("chunk_strategy"))
    p = _read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("file_path"), F.sha2("url", 256).alias("file_hash"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit("fixed-split").alias("chunk_strategy"))
    both = d.unionByName(p).withColumns({"file_name": t.basename("file_path"), "file_size": F.lit(7), "chunk_count": F.lit(3), "modified_at": _at(THEN), "indexed_at": _at(THEN), "created_at": _at(THEN), "updated_at": _at(THEN)})
    return conform(both, DOCUMENTS)


def _shown(documents: DataFrame) -> DataFrame:
    return documents.select("file_path", "file_name", "file_size", "file_hash", "chunk_count", "status", "error_message", "chunk_strategy", *map(_time, ("modified_at", "indexed_at", "created_at", "updated_at")))


def snapshot_diff(spark, sf_dir):
    return sync.snapshot_diff(_disk(spark, sf_dir), _stored(spark, sf_dir))


def snapshot_diff_by_folder(spark, sf_dir):
    """The same, by folders."""
    return folders.diff_by_folder(_disk(spark, sf_dir), _stored(spark, sf_dir))


def sync_counters(spark, sf_dir):
    return sync.sync_counters(snapshot_diff(spark, sf_dir))


def ingest_status(spark, sf_dir):
    return sync.to_ingest(snapshot_diff(spark, sf_dir), force=True).select("file_path", sync.ingest_status(F.col("change")).alias("status"))


def document_upsert(spark, sf_dir):
    disk, stored = _disk(spark, sf_dir), _stored(spark, sf_dir)
    wanted = disk.join(sync.to_ingest(sync.snapshot_diff(disk, stored)), "file_path", "left_semi")
    done = wanted.select("file_path", "file_name", "file_size", "file_hash", "modified_at", F.lit(5).cast("long").alias("chunk_count"), F.lit("fixed-split").alias("chunk_strategy"))
    return _shown(sync.upsert_documents(stored, done, _at(NOW)))


def document_versions(spark, sf_dir):
    """The stored documents in buckets, before and after the change that document_upsert makes."""
    path, disk = fresh(spark, "documents"), _disk(spark, sf_dir)
    buckets.create(_stored(spark, sf_dir), path, "file_path")
    wanted = disk.join(sync.to_ingest(sync.snapshot_diff(disk, buckets.read(spark, path))), "file_path", "left_semi")
    done = wanted.select("file_path", "file_name", "file_size", "file_hash", "modified_at", F.lit(5).cast("long").alias("chunk_count"), F.lit("fixed-split").alias("chunk_strategy"))
    last = buckets.change(spark, path, done.select("file_path"), lambda old: sync.upsert_documents(old, done, _at(NOW)))
    return _shown(buckets.read(spark, path, 0)).withColumn("version", F.lit(0)).unionByName(_shown(buckets.read(spark, path, last)).withColumn("version", F.lit(1)))


def document_errors(spark, sf_dir):
    failed = _disk(spark, sf_dir).filter("lang = 'de'").select("file_path", "file_name", F.lit("can't be read").alias("error_message"))
    return _shown(sync.upsert_errors(_stored(spark, sf_dir), failed, _at(NOW)))


def document_delete(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    return _shown(sync.delete_files(stored, sync.snapshot_diff(_disk(spark, sf_dir), stored).filter("change = 'deleted'")))


def document_rename(spark, sf_dir):
    renames = _read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("file_path"), F.concat(F.lit("moved/"), "page_id", F.lit(".md")).alias("new_path"))
    return _shown(sync.rename_files(_stored(spark, sf_dir), renames))


def rename_conflicts(spark, sf_dir):
    """Pages to be named like documents: the target exists where the document is stored."""
    renames = _read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("file_path"), F.concat(F.lit("doc/"), "page_id", F.lit(".md")).alias("new_path"))
    return sync.rename_conflicts(_stored(spark, sf_dir), renames)


def migrate_candidates(spark, sf_dir):
    return sync.to_migrate(_stored(spark, sf_dir)).select("file_path", "status")


# Memory


def _messages(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "conv_id", "role", F.coalesce("text", F.lit("")).alias("content"))


def _told(messages: DataFrame) -> DataFrame:
    """The first two messages of conversations of six or more are summarised."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n"), (F.min("id") + 1).alias("last_message_id")).filter("n >= 6").select(F.col("last_message_id").alias("id"), "conv_id", F.concat(F.lit("told "), "conv_id").alias("summary"), "last_message_id")


def history_page(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return memory.history_page(m, 50, 25).join(F.broadcast(m.agg(F.count("*").alias("total")))).select("id", "role", "total")


def last_messages(spark, sf_dir):
    return memory.last_messages(_messages(spark, sf_dir), 3, ["conv_id"]).select("conv_id", "id", "role")


def unsummarised(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return memory.unsummarised(m, _told(m), ["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("n"))


def compress_messages(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return memory.compress(m, _told(m), 4, ["conv_id"], model=lambda c: F.sha2(c, 256))


def rewrite_prompts(spark, sf_dir):
    m = _messages(spark, sf_dir)
    asked = _read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("question", F.concat(F.lit("and "), "conv_id", F.lit("?")))
    return memory.rewrite_prompts(asked, m, _told(m), 4, ["conv_id"])


def export_chat(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("created_at", F.col("id"))
    return memory.export_rows(m).select("role", "content", F.col("created_at").alias("at"))


# Review


def _grades(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    kind = F.col("event_type")
    grade = F.when(kind == "error", 0).when(kind == "signup", 1).when(kind == "purchase", 2).when(kind == "view", 3).otherwise(4)
    return e.select("event_id", "user_id", "ts", "value", grade.alias("grade"))


def review_step(spark, sf_dir):
    g = _grades(spark, sf_dir).withColumn("s", review.step("grade", F.col("user_id") % 4, F.least(F.lit(2.5), F.lit(1.3) + F.col("value") / 100.0), F.col("user_id") + 1))
    return g.select("event_id", "s.*")


def review_replay(spark, sf_dir):
    return review.replay(_grades(spark, sf_dir), "user_id", ["ts", "event_id"])


def _items(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), (F.col("p_size") % 3).cast("long").alias("repetitions"), F.lit(2.5).alias("easiness"), F.col("p_size").cast("long").alias("interval"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("due_date"), _at(THEN).alias("updated_at"))


def _today():
    return F.lit("2024-01-20").cast("date")


def review_apply(spark, sf_dir):
    graded = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("grade"))
    out = review.apply_reviews(_items(spark, sf_dir), graded, _today(), _at(NOW))
    return out.select("id", "repetitions", "easiness", "interval", F.col("due_date").cast("string").alias("due_date"), _time("updated_at"))


def review_due(spark, sf_dir):
    return review.due(_items(spark, sf_dir), _today()).select("id", "question", F.col("due_date").cast("string").alias("due_date"))


def review_stats(spark, sf_dir):
    return review.stats(_items(spark, sf_dir), _today())


# Catalog, tree, tasks, summaries


def _paths(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("file_path"))


def knowledge_tree(spark, sf_dir):
    return catalog.tree(_paths(spark, sf_dir)).orderBy(*catalog.tree_order()).select("node_path", "parent", "name", F.col("depth").cast("long").alias("depth"), "type")


def tree_files(spark, sf_dir):
    return catalog.files_of(catalog.tree(_paths(spark, sf_dir))).select("node_path")


def catalog_search(spark, sf_dir):
    packs = _read(spark, sf_dir, "part").withColumn("tags", F.array("p_brand", F.concat(F.lit("size "), "p_size")))
    return catalog.search_packs(packs, " Size 1 ", "p_name", "p_type").unionByName(catalog.search_packs(packs, "RING", "p_name", "p_type")).select("p_partkey", "p_name")


def _imported(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "customer").filter("c_acctbal > 9970").select(F.col("c_nationkey").alias("n_nationkey"))


def catalog_imported(spark, sf_dir):
    return catalog.with_imported(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _imported(spark, sf_dir), "n_nationkey")


def catalog_import(spark, sf_dir):
    wanted = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return catalog.pack_files_to_import(wanted, _imported(spark, sf_dir), "n_nationkey")


def task_rollup(spark, sf_dir):
    d = _documents(spark, sf_dir)
    error = F.when(F.length("text") < 200, F.concat(F.lit("too short: "), "file_path"))
    log = d.select(F.col("source").alias("task_id"), "file_path", (F.col("lang") != "de").alias("done"), error.alias("error"))
    return tasks.roll_up(log)


def _summaries(spark, sf_dir) -> DataFrame:
    d = _documents(spark, sf_dir).join(_read(spark, sf_dir, "labels"), "doc_id")
    return d.select("file_path", F.concat(F.lit("about "), "source").alias("summary"), _at(THEN).alias("created_at"), _at(THEN).alias("updated_at"))


def summary_cached(spark, sf_dir):
    return summaries.cached(_documents(spark, sf_dir).filter("lang = 'en'"), _summaries(spark, sf_dir)).select("file_path", "summary")


def summary_missing(spark, sf_dir):
    return summaries.missing(_documents(spark, sf_dir), _summaries(spark, sf_dir)).select("file_path")


def summary_upsert(spark, sf_dir):
    """Two new texts for each German document; the later one stays."""
    d = _documents(spark, sf_dir).filter("lang = 'de'").select("file_path", F.posexplode(F.array(F.lit("first"), F.concat(F.lit("new "), "source"))).alias("no", "summary"))
    return summaries.upsert(_summaries(spark, sf_dir), d, _at(NOW)).select("file_path", "summary", _time("created_at"), _time("updated_at"))


def document_summaries(spark, sf_dir):
    out = summaries.summarise(_documents(spark, sf_dir), _summaries(spark, sf_dir), _at(NOW), model=lambda c: F.when(t.strip(c) != "", F.sha2(c, 256)))
    return out.select("file_path", "summary", _time("created_at"), _time("updated_at"))


QUERIES = {f.__name__: f for f in (
    content_hash, text_measures, frontmatter_split, frontmatter_fields, section_split, sections_merged, chunks_fixed, chunks_by_heading, chunks_with_metadata, chunk_counts, numbered_variants, path_parts,
    snapshot_diff, snapshot_diff_by_folder, sync_counters, ingest_status, document_upsert, document_versions, pdf_texts, section_spaces, document_errors, document_delete, document_rename, rename_conflicts, migrate_candidates,
    history_page, last_messages, unsummarised, compress_messages, rewrite_prompts, export_chat, review_step, review_replay, review_apply, review_due, review_stats,
    knowledge_tree, tree_files, catalog_search, catalog_imported, catalog_import, task_rollup, summary_cached, summary_missing, summary_upsert, document_summaries,
)}
