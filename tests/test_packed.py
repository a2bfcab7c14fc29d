"""Addresses in binary, as held meta-files keep them."""

from pyspark.sql import functions as F

from doclog.functions.address import packed, unpacked


def test_packed_addresses_come_back(spark):
    full = "hash://sha256/" + "0f" * 32
    odd = ["", "/", "hash://", "hash://sha256/", "hash://sha256/abc", "hash://sha256/AB", "HASH://sha256/ab", full + "?type=x", full.upper(), "http://x/é", "hash://a/" + "00" * 200, "\0\0", full + "\n"]
    uris = [full, "hash://sha1/2f2f", "hash://x.y-z/00", "hash://sha512/" + "a1" * 64, *odd, None]
    got = spark.createDataFrame([(u,) for u in uris], "uri string").select("uri", packed(F.col("uri")).alias("p")).select("uri", "p", unpacked(F.col("p")).alias("again")).collect()
    assert [r.again for r in got] == uris and len({bytes(r.p) for r in got if r.p is not None}) == len(uris) - 1
    assert len(got[0].p) == 1 + len("sha256") + 32
