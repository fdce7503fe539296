"""Token files and flat files in work folders whose address has no scheme, or letters that an address would escape."""

import types
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tests.conftest import SF
from tidelake.llm import files, tokencount, tokenfile

ENCODER = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})


@pytest.fixture(params=["plain", "a b%20ü#c"])
def folder(spark, tmp_path, request):
    """A path that spark.checkpoint.dir names without a scheme."""
    rejects, key = "spark.sql.legacy.setCommandRejectsSparkCoreConfs", "spark.checkpoint.dir"
    before = spark.conf.get(key)
    spark.conf.set(rejects, "false")
    spark.conf.set(key, f"{tmp_path}/{request.param}")
    yield tmp_path / request.param
    spark.conf.set(key, before)
    spark.conf.unset(rejects)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_op4_without_a_scheme(spark, folder, texts):
    from tokenizers import Tokenizer

    library, want, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i, t in texts:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfile.op4(spark, SF).collect())) == want
    assert list(folder.glob("tidelake-tokens-*/*.tlh"))  # beside Spark's own tables


def test_token_files_in_a_plain_folder(odd, tmp_path):
    own = tokenfile.write(odd, f"{tmp_path}/x/", ENCODER, 50257)
    assert tokenfile.documents(own).count() == odd.count() and len(list((tmp_path / "x").glob("*.tlh"))) == own.count()


def test_addresses_keep_their_host_and_letters(monkeypatch):
    assert files.opened("file:///a%20b c/ü")[1] == files.opened("file:/a%20b c/ü")[1] == "/a%20b c/ü"
    monkeypatch.setattr(files, "pafs", types.SimpleNamespace(FileSystem=types.SimpleNamespace(from_uri=lambda uri: uri)))
    assert files.opened("s3a://me%40x@bucket/a b") == "s3://me%40x@bucket/a%20b" and files.opened("hdfs://n:8020/x") == "hdfs://n:8020/x"


def test_op6_without_a_scheme(spark, folder, texts):
    own = files.byte_level(*ENCODER[:2], {})
    rows = tokencount.op6(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["closed"]) for r in rows) == [(i, len(own.encode(t)) + 1, True) for i, t in texts]
    assert list(folder.glob("tidelake-flat-*/flat-*.bin"))


def test_flat_files_in_a_plain_folder(spark, odd, tmp_path):
    order = tokencount.write_flat(odd, f"{tmp_path}/x/", (*ENCODER[:2], {}), 50257, 50256)
    assert tokencount.scan(spark, f"{tmp_path}/x", 50257, 50256, 1000).count() == order.count() == odd.count()
    assert tokencount.scan(spark, f"{tmp_path}/none", 50257, 50256).count() == 0
