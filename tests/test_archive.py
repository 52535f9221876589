"""The binary archive format: bytes by hand, round trips, version 1, damage."""

import random
import struct

import pytest
import zstandard

from shelfmark.sources import archive

PKG = "pkg_id long, attr string, output string, toplevel boolean, system string, store_dir string, hash string, name string"
FILE = "pkg_id long, path string, kind string, size long, target string"
SHOWN = archive.package_json({"store_dir": "/s", "hash": "h", "name": "n", "attr": "a", "output": "out", "toplevel": True})


def raw(*packages):
    coder, out = archive.FrontCoder(), b""
    for entries, shown in packages:
        out += b"".join(coder.entry(p, q) for p, q in entries) + coder.package(shown)
    return out


def test_bytes():
    got = raw(([(b"1d", b"/bin"), (b"5x", b"/bin/ls"), (b"lss", b"/b")], b"{}"), ([(b"0r", b"/b")], b"{}"))
    assert got == b"1d\0\x00/bin\n5x\0\x04/ls\nlss\0\xfe\np\0\xfe{}\n0r\0\x00/b\np\0\x00{}\n"
    long = b"/" + b"x" * 300
    got = raw(([(b"1r", long), (b"1r", long + b"y"), (b"1r", b"/z")], b"{}"))
    assert got == b"1r\0\x00" + long + b"\n1r\0\x80\x01\x2dy\n1r\0\x80\xfe\xd4z\np\0\xff{}\n"
    with pytest.raises(archive.BadArchive):
        raw(([(b"1r", b"/a\nb")], b"{}"))


def test_decodes_in_pieces_of_any_size():
    rng = random.Random(1)
    names = sorted({"/" + "".join(rng.choice("ab/") for _ in range(rng.choice((1, 3, 20, 10, 400)))) for _ in range(300)})
    entries = [(f"{i}r".encode(), n.encode()) for i, n in enumerate(names)]
    data = raw((entries[:100], b"{1}"), (entries[100:], b"{2}"))
    want = [*entries[:100], (b"p", b"{1}"), *entries[100:], (b"p", b"{2}")]
    for k in (1, 2, 7, 10, 1000, len(data)):
        assert list(archive.decoded(data[i : i + k] for i in range(0, len(data), k))) == want
    assert list(archive.decoded([])) == []


def test_damage():
    for bad in (b"1d", b"1d\0", b"1d\0\x00/a", b"1d\0\x80\x01", b"1d\0\x05/a\n", b"1d\0\xff/a\n"):
        with pytest.raises(archive.BadArchive):
            list(archive.decoded([bad]))
    for lines in (b"1r\0\x00/a\n", b"zr\0\x00/a\np\0\x00{}\n", b"1q\0\x00/a\np\0\x00{}\n"):
        with pytest.raises(archive.BadArchive):
            list(archive.frame_rows(zstandard.compress(lines)))
    head = b"NIXI" + struct.pack("<Q", 2)
    table = struct.pack("<5I", archive.TABLE_MAGIC, 12, 1, 3, 12)
    assert archive.frames_of(head + b"abc" + table) == [(12, 3)]
    assert archive.frames_of(b"NIXI" + struct.pack("<Q", 1) + b"ab") == [(12, 2)] and archive.frames_of(b"NIXI" + struct.pack("<Q", 1)) == []
    for bad in (b"", head, b"NOPE" + struct.pack("<Q", 1), b"NIXI" + struct.pack("<Q", 3), head + b"abcd" + table, head + b"abc" + table[:-4] + b"\xff\0\0\0", head + b"abc" + b"x" + table[1:]):
        with pytest.raises(archive.BadArchive):
            archive.frames_of(bad)


def test_round_trip(spark, tmp_path):
    packages = [(i * 10, f"p{i}", "out", i % 2 == 0, None if i % 3 else "sys", "/s", f"{i:032d}", f"p{i}-1") for i in range(50)]
    files = [(i * 10, f"/bin/cmd{k}", "x", k, None) for i in range(1, 50) for k in range(i)]
    files += [(10, "", "d", 1, None), (20, "/l", "s", 0, "bin/ä"), (30, "/e", "r", None, None), (40, "/a\nb", "r", 1, None), (990, "/orphan", "r", 1, None)]
    p, f = spark.createDataFrame(packages, PKG), spark.createDataFrame(files, FILE)
    folder = tmp_path / "archives"
    folder.mkdir()
    assert archive.write_archive(p, f, str(folder / "a"), frame_bytes=500) > 4
    got_p, got_f = archive.read_archives(spark, str(folder / "a"))
    # The first package has no entries, so numbers start at the second.
    want = sorted((i // 10 - 1, a, k, s or 0, t or "") for i, a, k, s, t in files if i != 990 and "\n" not in a)
    assert sorted((r.pkg_id, r.path, r.kind, r.size, r.target or "") for r in got_f.collect()) == want
    assert sorted(tuple(r) for r in got_p.select("pkg_id", "attr", "output", "toplevel", "system", "store_dir", "hash", "name").collect()) == [(i - 1, *r[1:]) for i, r in enumerate(packages) if i]
    # A second archive, of version 1; numbers go on.
    lines = raw(([(b"3x", b"/bin/one")], SHOWN.encode()), ([], SHOWN.encode()), ([(b"4r", b"/two")], SHOWN.encode()))
    (folder / "b").write_bytes(b"NIXI" + struct.pack("<Q", 1) + zstandard.compress(lines))
    got_p, got_f = archive.read_archives(spark, str(folder))
    assert got_p.count() == 51 and [(r.pkg_id, r.path) for r in got_f.where("pkg_id > 48").orderBy("pkg_id").collect()] == [(49, "/bin/one"), (50, "/two")]
    # Nothing to write gives an archive without frames.
    assert archive.write_archive(p, f.limit(0), str(tmp_path / "none")) == 0
    assert [x.count() for x in archive.read_archives(spark, str(tmp_path / "none"))] == [0, 0]
