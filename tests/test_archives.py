"""Archives byte by byte, by the plans, and with hostile input."""

import bz2
import lzma
import os
import struct
import tomllib
import zlib
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import codec
from lodestone.operators import layout, listing
from lodestone.plans import archives
from lodestone.sources import config, header
from lodestone.sources.archive import safe_name, table

GOLDEN = bytes.fromhex(
    "4454525a0300020000612e74787400622e62696e00632e74787400640000000000ffff01000100ffff01000200ffff02000300690000000300000003000000000100006c0000000000000005000000800000000000000005000000050000000001010067312e647a00616263"
)



@pytest.fixture
def golden(tmp_path):
    (tmp_path / "g.dz").write_bytes(GOLDEN)
    (tmp_path / "g1.dz").write_bytes(b"hello")
    return str(tmp_path / "g.dz")


def test_golden_header_both_ways():
    h = header.parse(BytesIO(GOLDEN))
    assert h.strings == ["a.txt", "b.bin", "c.txt", "d"] and h.volumes == ["g1.dz"] and h.header_end == 105
    assert h.files == [(0, [0]), (1, [1]), (1, [2])]
    assert h.chunks == [(105, 3, 3, 0x100, 0), (108, 0, 5, 0x80, 0), (0, 5, 5, 0x100, 1)]
    assert header.serialise(h) == GOLDEN[:105]


def test_header_with_range_settings_and_odd_names():
    h = header.Header(1, 1, 3, ["ü" * 70000], [(0, [])], 1, [(1, 2, 3, S.DZ, 0)], [], tuple(range(10)))
    again = header.parse(BytesIO(header.serialise(h)))
    assert again.strings == h.strings and again.range == h.range and again.files == [(0, [])] and again.version == 3


def test_header_errors():
    for data, kind in ((b"nope", "Io"), (b"\0" * 20, "InvalidHeader"), (GOLDEN[:40], "Io"), (GOLDEN[:9] + b"\xff\xfe\0" + GOLDEN[9:], "Utf8"), (struct.pack("<IHHB", S.MAGIC, 0, 0, 0), "InvalidHeader")):
        with pytest.raises(S.ArchiveError) as e:
            header.parse(BytesIO(data))
        assert e.value.kind == kind
    big = header.Header(1, 1, 0, ["a"], [(0, [0])], 1, [(1 << 32, 0, 0, 0, 0)])
    with pytest.raises(S.ArchiveError):
        header.serialise(big)


def test_golden_tables_report_and_extraction(spark, golden, tmp_path):
    assert table(spark, golden, "archives").first().num_chunks == 3
    assert [(r.volume_id, r.name, r["size"]) for r in table(spark, golden, "volumes").orderBy("volume_id").collect()] == [(0, "g.dz", 108), (1, "g1.dz", 5)]
    rows = archives.verify(spark, golden).orderBy("file_idx").collect()
    assert [(r.status, r["size"], r.packed, r.method, r.path, r.length_match) for r in rows] == [("OK", 3, 3, "Copy", "a.txt", True), ("OK", 5, 0, "Zero", "d/b.bin", True), ("OK", 5, 5, "Copy", "d/c.txt", True)]
    lines = [r.line for r in listing.report_text(archives.verify(spark, golden)).collect()]
    assert lines[1] == "1     | OK      | 5          | 0          | Zero     | d/b.bin"
    out = tmp_path / "out"
    got = archives.unpack(spark, golden, str(out)).orderBy("file_idx").collect()
    assert [r.failed_chunks for r in got] == [0, 0, 0]
    assert (out / "a.txt").read_bytes() == b"abc" and (out / "d/b.bin").read_bytes() == b"\0" * 5 and (out / "d/c.txt").read_bytes() == b"hello"
    made = tomllib.loads((out / "g.toml").read_text())
    assert made["archives"] == ["g.dz", "g1.dz"] and [f["compression"] for f in made["files"]] == ["Copy", "Zero", "Copy"]
    archives.pack(spark, str(out / "g.toml"), str(tmp_path / "again"))
    assert (tmp_path / "again/g.dz").read_bytes() == GOLDEN and (tmp_path / "again/g1.dz").read_bytes() == b"hello"


def test_missing_volume_and_bad_chunk_ids(spark, golden, tmp_path):
    os.remove(tmp_path / "g1.dz")
    assert [r.status for r in archives.verify(spark, golden).orderBy("file_idx").collect()] == ["OK", "OK", "FAIL"]
    t = archives.open_archives(spark, golden)
    assert {r.chunk_id: r.error_kind for r in archives.decoded(t).collect()} == {0: None, 1: None, 2: "VolumeOpenError"}
    h = header.parse(BytesIO(GOLDEN))
    h.files = [(0, [0, 77]), (9, []), (1, [1, 0])]
    h.chunks[0] = (105, 3, 3, 0x100, 5)
    (tmp_path / "x.dz").write_bytes(header.serialise(h) + b"abc")
    rows = archives.verify(spark, str(tmp_path / "x.dz")).orderBy("file_idx").collect()
    assert [(r.status, r.path, r.method) for r in rows] == [("FAIL", "a.txt", "Copy"), ("OK", "b.bin", "Unknown"), ("FAIL", "d/c.txt", "Zero")]
    t = archives.open_archives(spark, str(tmp_path / "x.dz"))
    assert {r.error_kind for r in archives.decoded(t).where("chunk_id = 0").collect()} == {"VolumeNotFound"}


def test_permissive_directory(spark, golden, tmp_path):
    (tmp_path / "bad.dz").write_bytes(b"\1" * 30)
    os.remove(tmp_path / "g1.dz")
    got = {os.path.basename(r.archive): (r.num_chunks, r.error_kind) for r in table(spark, str(tmp_path), "archives", mode="permissive").collect()}
    assert got == {"g.dz": (3, None), "bad.dz": (None, "InvalidHeader")}
    assert table(spark, str(tmp_path), "chunks", mode="permissive").count() == 3
    with pytest.raises(Exception, match="InvalidHeader"):
        table(spark, str(tmp_path), "chunks").count()


def test_corrected_sizes(spark):
    rows = [(100, 50, 200, 0x8, 0, 50), (160, 500, 500, 0x8, 0, 140), (300, 10, 10, 0x100, 0, 0), (300, 999, 5, 0x10, 0, 20), (0, 0, 64, 0x80, 0, 0), (0, 400, 400, 0x200, 1, 400), (400, 30, 30, 0x200, 1, 50), (450, 30, 30, 0x400, 1, 30), (0, 10, 20, 0x8, 2, 0), (5, 7, 7, 0x4, 3, 15), (20, 7, 9, 0x4, 3, 0)]
    chunks = spark.createDataFrame([("x", k, *r[:5]) for k, r in enumerate(rows)], S.TABLES["chunks"])
    sizes = spark.createDataFrame([("x", 0, 320), ("x", 1, 500), ("x", 3, 15)], "archive string, volume_id int, size long")
    got = layout.corrected_sizes(chunks, sizes).orderBy("chunk_id").collect()
    assert [r.compressed_length for r in got] == [r[5] for r in rows]


def test_codecs_and_fallbacks():
    text = bytes(k % 251 for k in range(20000))
    for m in S.METHODS:
        flags, stored, other = codec.encode(m, text)
        back = codec.decode(flags, len(stored), len(text), stored + b"padding" * (m in ("Zlib", "Bzip")))
        assert back.data == (bytes(len(text)) if m == "Zero" else text) and other == (m not in codec.ENCODERS)
    gz, z, bz = codec.encode("Zlib", text)[1], zlib.compress(text), bz2.compress(text)
    lz = codec.encode("Lzma", text)[1]
    d = lambda flags, data, length, n=None: codec.decode(flags, len(data) if n is None else n, length, data)
    assert d(S.ZLIB, z, len(text)).data == text
    assert d(S.ZLIB, gz[:-4], len(text)).data == text  # a missing footer is forgiven
    assert d(S.ZLIB, gz[:-30], len(text)).error_kind == "Io"
    assert d(S.ZLIB, z[:-9], len(text)).error_kind == "Io"
    assert d(S.ZLIB, gz, len(gz)).data == gz and d(S.ZLIB, gz, len(gz)).raw_fallback  # not decoded, by the format's rule
    assert d(S.ZLIB, b"\x78raw", 4).data == b"\x78raw" and d(S.ZLIB, b"", 0).raw_fallback
    assert d(S.BZIP, b"BZraw", 5).data == b"BZraw" and d(S.BZIP, b"BZhraw", 6).raw_fallback and d(S.BZIP, bz[:-9], 1).error_kind == "Io"
    assert d(S.LZMA, b"\x5d" + b"\xff" * 30, 31).raw_fallback and d(S.LZMA, b"\x41abc", 4).raw_fallback
    assert d(S.LZMA, b"\xffabc", 9).error_kind == "Io" and d(S.LZMA, b"\x5d", 1).error_kind == "Io"  # no decoder for it: no fallback
    noise = os.urandom(60000)
    packed = codec.encode("Lzma", noise)[1]
    partial = d(S.LZMA, packed[:-3000], len(noise))
    assert partial.data and noise.startswith(partial.data) and len(partial.data) > 0.8 * (len(packed) - 3000)
    assert d(S.LZMA, packed[:-3000], 5, len(packed) - 3000).data == partial.data
    assert lz[5:13] == struct.pack("<Q", len(text)) and lzma.decompress(lz, lzma.FORMAT_ALONE) == text
    for flags, kind in ((S.DZ, "UnsupportedCompression"), (S.COMBUF, "UnsupportedCompression"), (0, "UnsupportedCompression")):
        assert d(flags, b"abc", 3).error_kind == kind
    assert d(S.RANDOMACCESS, b"abc", 9).data == b"abc" and d(S.COPYCOMP | S.ZLIB, b"abc", 9).data == b"abc" and d(S.ZLIB | S.ZERO, b"abc", 2).data == b"\0\0"
    assert d(S.COPYCOMP, b"abc", 9, 5).error_kind == "Io"
    assert codec.decode(S.ZERO, 0, 100, b"", most=50).error_kind == "Io"


LINES = "\r\n".join(["# note", "archive testnew.dz", "ARCHIVE testnew1.dz", "basedir .", "file Image16b.bmp 1 dz", r"file BMP\Image16.bmp 1 dz to 25%", r"file .\BMP\\Image8.bmp 1 ZLIB", "file short 1", "", "options dz", "max_mem_usage x", "use_combuf 1", "preprocess 0", "WinSize 300", "OffsetTables 5", "BigMinMatch", "unknown 3"])


def test_line_config(tmp_path, spark):
    c = config.parse_lines(LINES)
    assert c["archives"] == ["testnew.dz", "testnew1.dz"]
    assert [(f["path"], f["compression"], f["modifiers"]) for f in c["files"]] == [("Image16b.bmp", "Dz", ""), ("BMP/Image16.bmp", "Dz", "to 25%"), ("BMP/Image8.bmp", "Zlib", "")]
    o = c["options"]
    assert (o["max_mem_usage"], o["use_combuf"], o["preprocess"], o["win_size"], o["offset_tables"], o["big_min_match"]) == (-1, True, False, 16, 5, 15)
    for bad in ("file ../x 0 copy", "file C:/x 0 copy", "file x 70000 copy", "file x -1 copy", "file x 0 rar"):
        with pytest.raises(ValueError):
            config.parse_lines(bad)
    again = config.parse_toml(config.to_toml(c | {"archives": ['q"\\\n.dz']}))
    assert again == c | {"archives": ['q"\\\n.dz']}
    assert config.config_frame(spark, c).first().files[1].modifiers == "to 25%"
    (tmp_path / "c.toml").write_text(config.to_toml(c))
    (tmp_path / "c.TOML").write_text(LINES)
    for name in ("c.toml", "c.TOML"):
        assert config.read_config(str(tmp_path / name)) == c | {"base_dir": str(tmp_path)}
    with pytest.raises(ValueError):
        config.parse_toml('archives = []\nfiles = []')
    with pytest.raises(ValueError):
        config.parse_toml('archives = []\nbase_dir = "."\n[[files]]\npath = "x"\narchive_file_index = 0\ncompression = "zlib"')


def test_pack_errors(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(k, *x) for k, x in enumerate(r)], "file_idx long, path string, volume int, method string, data binary")
    with pytest.raises(S.ArchiveError, match="No archives"):
        archives.pack_frame(rows(("a", 0, "Copy", b"x")), [], str(tmp_path / "o"))
    with pytest.raises(S.ArchiveError) as e:
        archives.pack_frame(rows(("a", 3, "Copy", b"x")), ["a.dz"], str(tmp_path / "o"))
    assert e.value.kind == "VolumeNotFound"
    (tmp_path / "c.toml").write_text(config.to_toml({"archives": ["a.dz"], "base_dir": ".", "files": [{"path": "none", "archive_file_index": 0, "compression": "Copy", "modifiers": ""}], "options": None}))
    with pytest.raises(S.ArchiveError, match="no such file"):
        archives.pack(spark, str(tmp_path / "c.toml"), str(tmp_path / "o"))
    got = archives.pack_frame(rows(("d/a", 1, "Jpeg", b"xyz"), ("d/a", 1, "Zlib", b"")), ["a.dz", "b.dz", "c.dz"], str(tmp_path / "o"))
    assert [(r.offset, r.substituted) for r in got.orderBy("file_idx").collect()] == [(0, True), (3, False)]
    assert (tmp_path / "o/c.dz").read_bytes() == b""
    assert {r.status for r in archives.verify(spark, str(tmp_path / "o/a.dz")).collect()} == {"OK"}
    archives.unpack(spark, str(tmp_path / "o/a.dz"), str(tmp_path / "u"))
    assert (tmp_path / "u/d/a").read_bytes() == b""  # the last of two with one path


def test_empty_chunk_before_the_one_at_its_offset(spark, tmp_path):
    from lodestone.sinks.volumes import write_volumes

    chunks = spark.createDataFrame([(0, 2, b"cd"), (0, 2, b""), (0, 0, b"ab")], "volume int, offset long, data binary").coalesce(1)
    write_volumes(chunks, str(tmp_path), ["v.dz"], b"")
    assert (tmp_path / "v.dz").read_bytes() == b"abcd"


def test_hostile_paths(spark, tmp_path):
    for name in ("../up", "/etc/x", "a/../../b", "c:\\x"):
        with pytest.raises(S.ArchiveError):
            safe_name(name)
    for path in ("..\\up.txt", "c:\\x", "bad.toml"):
        h = header.Header(1, 1, 0, [path], [(0, [0])], 1, [(0, 0, 1, S.ZERO, 0)])
        (tmp_path / "bad.dz").write_bytes(header.serialise(h))
        with pytest.raises(S.ArchiveError):
            archives.unpack(spark, str(tmp_path / "bad.dz"), str(tmp_path / "out"))
        assert not (tmp_path / "out").exists()


def test_landing_stream(spark, golden, tmp_path):
    from lodestone.streaming.landing import verify_landing

    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a,b.dz").write_bytes(GOLDEN)
    for name in ("g.dz", "g1.dz"):
        os.rename(tmp_path / name, tmp_path / "in" / name)
    os.rename(tmp_path / "in/g1.dz", tmp_path / "in/g1.vol")
    q = verify_landing(spark, str(tmp_path / "in"), str(tmp_path / "reports"), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "reports")).collect()) == ["FAIL", "FAIL", "OK", "OK", "OK", "OK"]


def opened_elsewhere(path):
    """A resolver."""
    return open(path, "rb")


def test_resolver_and_public_api(spark, golden):
    import lodestone

    for name in lodestone.__all__:
        assert getattr(lodestone, name)
    with open(golden, "rb") as f:
        assert lodestone.parse(f).num_user_files == 3
    got = lodestone.verify(spark, golden, resolver="tests.test_archives:opened_elsewhere")
    assert {r.status for r in got.collect()} == {"OK"}
    lodestone.set_verbosity(spark, False)
    spark.sparkContext.setLogLevel("ERROR")


def test_line_ends_and_white_space():
    c = config.parse_lines("archive a.dz\narchive b\x0bdz\r\narchive c\u2028.dz\narchive d\x1c.dz\n\u00a0archive\u00a0e.dz")
    assert c["archives"] == ["a.dz", "b", "c", "d\x1c.dz", "e.dz"]


def test_plan_of_listing(spark):
    from lodestone import queries as Q

    plan = Q.verify_listing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "text" not in plan
    assert F is not None
