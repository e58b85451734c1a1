"""File fingerprints, comparison and inventory."""

import hashlib
import os

from factorloom.sources import fingerprints as fp


def _root(content, block, fanout):
    level = [hashlib.sha256(content[i : i + block]).hexdigest() for i in range(0, max(len(content), 1), block)]
    while len(level) > 1:
        level = [level[i] if len(level[i : i + fanout]) == 1 else hashlib.sha256("".join(level[i : i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return level[0]


def _files(folder):
    sizes = {"empty.bin": 0, "one.bin": 10, "block.bin": 64, "over.bin": 65, "many.bin": 5000, "sub dir ü.bin": 700}
    folder.mkdir()
    out = {}
    for i, (name, n) in enumerate(sizes.items()):
        out[name] = hashlib.shake_128(str(i).encode()).digest(n) if n else b""
        (folder / name).write_bytes(out[name])
    return out


def _by_name(rows):
    from urllib.parse import unquote

    return {unquote(r.path.rsplit("/", 1)[-1]): r for r in rows}


def test_hash_trees_of_blocks(spark, tmp_path):
    contents = _files(tmp_path / "a")
    got = _by_name(fp.file_hashes(spark, str(tmp_path / "a"), block_bytes=64, fanout=3).collect())
    assert contents.pop("empty.bin") == b"" and set(got) == set(contents)
    for name, content in contents.items():
        assert got[name].size_bytes == len(content) and got[name].sha256 == _root(content, 64, 3)
    plain = _by_name(fp.file_hashes(spark, str(tmp_path / "a")).collect())
    assert all(plain[n].sha256 == hashlib.sha256(c).hexdigest() for n, c in contents.items())


def test_a_file_beyond_one_value(spark, tmp_path):
    """Three gigabytes that take no disk: a hole."""
    (tmp_path / "h").mkdir()
    with open(tmp_path / "h" / "hole.bin", "wb") as f:
        f.truncate(3 << 30)
    (r,) = fp.file_hashes(spark, str(tmp_path / "h"), block_bytes=512 << 20).collect()
    zero = hashlib.sha256()
    for _ in range(512):
        zero.update(bytes(1 << 20))
    assert r.size_bytes == 3 << 30 and r.sha256 == hashlib.sha256((zero.hexdigest() * 6).encode()).hexdigest()


def test_before_and_after(spark, tmp_path):
    _files(tmp_path / "a")
    path = str(tmp_path / "a")
    before = spark.createDataFrame(fp.file_hashes(spark, path, 64).collect())
    assert fp.protected_inputs(before, fp.file_hashes(spark, path, 64)).first().status == "PASS"
    tree = fp.tree_hash(before).first()
    assert tree.files == 5 and fp.tree_hash(before.orderBy("sha256")).first() == tree
    (tmp_path / "a" / "many.bin").write_bytes(b"x" * 5000)
    os.remove(tmp_path / "a" / "one.bin")
    (tmp_path / "a" / "new.bin").write_bytes(b"new")
    after = fp.file_hashes(spark, path, 64)
    got = {n: r.status for n, r in _by_name(fp.compare_files(before, after).collect()).items()}
    assert {n for n, s in got.items() if s != "UNCHANGED"} == {"many.bin", "one.bin", "new.bin"}
    assert (got["many.bin"], got["one.bin"], got["new.bin"]) == ("CHANGED", "REMOVED", "ADDED")
    r = fp.protected_inputs(before, after).first()
    assert (r.files_before, r.files_after, r.unchanged, r.changed, r.added, r.removed, r.status) == (5, 5, 3, 1, 1, 1, "FAIL")
    assert fp.tree_hash(after).first().tree_sha256 != tree.tree_sha256


def test_inventory_from_file_metadata(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "date_add(date'2020-01-01', cast(id as int)) as d").repartition(4).write.parquet(path)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    r = fp.dataset_files({"t": (spark.read.parquet(path), "d")}).first()
    assert r.file_count == len(files) and r.size_bytes == sum(os.path.getsize(f"{path}/{f}") for f in files)
    assert r.row_count == 100 and str(r.minimum_date) == "2020-01-01" and str(r.maximum_date) == "2020-04-09" and r.status == "PASS"
