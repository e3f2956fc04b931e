"""What is encoded and decoded at once is bounded by bytes, and what is stored is told from raw data."""

import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from lodestone import queries as Q
from lodestone import schema as S
from lodestone.functions import codec

from .oracle import compare


def as_long_as_its_gzip() -> bytes:
    """A text that gzip neither shortens nor lengthens."""
    for seed in range(10000):
        r = random.Random(seed)
        text = bytes(r.choice(b"abcdefgh ") for _ in range(r.randint(30, 120)))
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        if len(c.compress(text) + c.flush()) == len(text):
            return text
    raise AssertionError


class Frame:
    """Stands for a DataFrame: hands out the function that would run on batches."""

    def __init__(self, ddl: T.StructType):
        self.schema, self.sparkSession, self.conf = ddl, self, self
        self.settings = {}

    def set(self, key, value):
        self.settings[key] = value

    def mapInArrow(self, run, schema):
        return run


PLAIN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("method", T.StringType()), T.StructField("data", T.BinaryType())])
CODED = T.StructType([*PLAIN.fields, *(T.StructField(n, T.LongType()) for n in ("flags", "compressed_length", "decompressed_length"))])


def test_a_gzip_as_long_as_its_text_is_decoded():
    text = as_long_as_its_gzip()
    flags, stored, _ = codec.encode("Zlib", text)
    back = codec.decode(flags, len(stored), len(text), stored)
    assert back.data == text and not back.raw_fallback


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents whose every text is as long as its gzip, one more by another method each."""
    at = tmp_path_factory.mktemp("equal")
    text = as_long_as_its_gzip().decode()
    rows = {"doc_id": pa.array(range(12), pa.int64()), "text": [text] * 12, "lang": ["en"] * 12, "source": ["web"] * 12, "n_chars": pa.array([len(text)] * 12, pa.int64())}
    pq.write_table(pa.table(rows), at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["codec_roundtrip_zlib", "archive_extract", "pack_lines", "unpack_files"])
def test_texts_as_long_as_their_gzip(spark, folder, name):
    compare(spark, name, Q.QUERIES[name], Q.SQL[name], folder)


def test_jobs_do_not_grow_with_archives(spark, folder):
    """Twelve documents in one archive and in six."""
    jobs = []
    for most in (12, 2):
        group = f"archives of {most}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert Q.pack_toml(spark, folder, most=most).count() == 12
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    assert 0 < jobs[1] <= jobs[0] + 8, jobs


def big(ddl: T.StructType, n: int = 300, each: int = 100_000) -> pa.RecordBatch:
    values = {"doc_id": range(n), "method": ["Combuf"] * n, "data": [b"x" * each] * n, "flags": [S.COPYCOMP] * n, "compressed_length": [each] * n, "decompressed_length": [each] * n}
    kinds = {"method": pa.string(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(values[f], kinds.get(f, pa.int64())) for f in ddl.names], names=ddl.names)


@pytest.mark.parametrize("run,ddl", [(codec.encoded, PLAIN), (codec.decoded, CODED)])
def test_batches_are_bounded_by_bytes(run, ddl):
    frame = Frame(ddl)
    got = list(run(frame)(iter([big(ddl)])))
    assert sum(b.num_rows for b in got) == 300 and max(sum(map(len, b.column("data").to_pylist())) for b in got) <= 4 << 20
    assert int(frame.settings["spark.sql.execution.arrow.maxBytesPerBatch"]) <= 4 << 20


def test_odd_storage_is_bounded_by_bytes():
    got = list(Q.stored_oddly(iter([big(PLAIN)])))
    assert sum(b.num_rows for b in got) == 300 and max(sum(map(len, b.column("data").to_pylist())) for b in got) <= 4 << 20


def test_lzma_states_a_dictionary_that_fits():
    for n in (0, 1, 4096, 4097, 100_000):
        data = bytes(k % 251 for k in range(n))
        flags, stored, _ = codec.encode("Lzma", data)
        assert int.from_bytes(stored[1:5], "little") <= max(1 << 12, 2 * n) and codec.decode(flags, len(stored), n, stored).data == data
