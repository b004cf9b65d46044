from __future__ import annotations

import hashlib
import io
import zipfile

from kilnspark.sources import archives


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_extracts_sound_archives_and_names_faults(spark, tmp_path):
    sound = [("repo/a.py", "x = 1\ny = 2"), ("repo/node_modules/m.js", "no"), ("repo/lib/b.js", "one\n"), ("repo/c.exe", "no"), ("repo/bin.py", b"\x00\x01"), ("repo/e.py", ""), ("repo/bad.py", b"\xff\xfeok")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.zip").write_bytes(packed(sound))
    (tmp_path / "in" / "up.zip").write_bytes(packed([("../x.py", "1")]))
    (tmp_path / "in" / "many.zip").write_bytes(packed([(f"f{i}.py", "") for i in range(1001)]))
    (tmp_path / "in" / "no.zip").write_bytes(b"not one")
    (tmp_path / "flat.txt").write_text("left out")
    got = archives.extract(archives.read_archives(spark, str(tmp_path))).collect()
    faults = {r.archive.rsplit("/", 1)[1]: r.fault for r in got if r.fault}
    assert faults == {"up.zip": "unsafe path", "many.zip": "too many files", "no.zip": "not an archive"}
    files = {r.path: r for r in got if r.fault is None}
    assert set(files) == {"a.py", "lib/b.js", "bin.py", "e.py", "bad.py"}
    a = files["a.py"]
    assert (a.size, a.language, a.lines, a.is_binary, a.content, a.digest) == (11, "python", 2, False, "x = 1\ny = 2", hashlib.sha256(b"x = 1\ny = 2").hexdigest())
    assert files["bin.py"].is_binary and files["bin.py"].content is None and files["bin.py"].lines == 0
    assert (files["e.py"].lines, files["e.py"].content, files["lib/b.js"].lines) == (0, "", 1)
    assert files["bad.py"].content == "��ok"


def test_null_and_no_archives(spark):
    rows = spark.createDataFrame([("n", None)], "archive string, data binary")
    assert [(r.archive, r.fault) for r in archives.extract(rows).collect()] == [("n", "not an archive")]
    assert archives.extract(rows.where("archive = 'x'")).count() == 0


def test_root_is_cut_only_where_all_share_it():
    assert archives._root(["r/a", "r/b"]) == "r/" and archives._root(["r/a", "b"]) == "" and archives._root(["r/a", "s/b"]) == "" and archives._root([]) == ""
