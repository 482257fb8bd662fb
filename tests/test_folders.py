from tessella.operators import folders
from tessella.operators.sync import snapshot_diff

KIND = "file_path string, file_hash string"


def rows(df):
    return sorted(map(str, df.select("file_path", "disk_hash", "stored_hash", "change").collect()))


def test_diff_by_folder_passes_over_what_agrees(spark):
    tree = [(f"a{i // 50}/b{i // 10}/f{i}.md", f"h{i}") for i in range(500)] + [("top.md", "t"), ("a1/x.md", None)]
    now = [(p, "new" if p.endswith("f7.md") else h) for p, h in tree if not p.endswith("f123.md")] + [("a9/new/n.md", "n"), ("a0/b3", "odd")]
    disk, stored = spark.createDataFrame(now, KIND), spark.createDataFrame(tree, KIND)
    assert rows(folders.diff_by_folder(disk, stored)) == rows(snapshot_diff(disk, stored))
    kept = folders.folder_hashes(stored)
    assert rows(folders.diff_by_folder(disk, stored, kept)) == rows(snapshot_diff(disk, stored))
    told = folders.compared(disk, stored).first()
    assert told.n_files == len(now) and told.n_compared == 22  # those in "", a0, a0/b0, a2/b12 and a9/new
    assert {r.folder: r.n_files for r in kept.collect()} == {**{"": 502}, **{f"a{i}": 51 if i == 1 else 50 for i in range(10)}, **{f"a{i // 5}/b{i}": 10 for i in range(50)}}
    assert folders.compared(stored, stored).first().n_compared == 0
    none = spark.createDataFrame([], KIND)
    assert rows(folders.diff_by_folder(none, stored)) == rows(snapshot_diff(none, stored)) and folders.folder_hashes(none).count() == 0


def test_moves_between_folders_are_seen(spark):
    before, after = ([("a/x.md", "1"), ("b/y.md", "2")], [("a/x.md", "2"), ("b/y.md", "1")])
    disk, stored = spark.createDataFrame(after, KIND), spark.createDataFrame(before, KIND)
    assert rows(folders.diff_by_folder(disk, stored)) == rows(snapshot_diff(disk, stored))
