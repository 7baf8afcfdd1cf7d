"""Digests of files that don't come as one value."""

import hashlib

from sievestone.sources import readers


def test_files_larger_than_one_value_may_be(spark, tmp_path):
    texts = {"a b%20.bin": b"x" * 5000, "é.bin": b"z", "c.bin": b"y" * 10}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        found = readers.fingerprint(spark, f"{tmp_path}/*.bin")
        assert found.columns == ["path", "bytes", "sha256"]
        assert sorted((r.bytes, r.sha256) for r in found.collect()) == sorted((len(t), hashlib.sha256(t).hexdigest()) for t in texts.values())
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
