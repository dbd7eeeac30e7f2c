"""Digests of files that are read by splits."""

import gzip
import hashlib
import random

from strandwork.functions import sha256
from strandwork.sources import packages as P


def test_digests_go_on_from_their_state():
    data = random.Random(1).randbytes(100_000)
    state, at = None, 0
    for n in (0, 1, 63, 64, 65, 40_000, 59_807):
        d = sha256.resumed(state)
        d.update(data[at : at + n])
        state, at = d.state(), at + n
    assert at == len(data) and sha256.resumed(state).hexdigest() == hashlib.sha256(data).hexdigest()


def test_long_files_are_read_by_splits(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    body = r.randbytes(30_000)
    files = {"short": b"abc\n", "ends": body + b"\n", "open": body + b"x", "mark": b"\xef\xbb\xbf" + body, "both": b"\xef\xbb\xbf" + body + b"\n\n",
             "windows": b"a\r\nb\r" * 3000, "feeds": b"\n" * 9000, "bare": b"z" * 9000, "zeros": bytes(9000) + b"\n", "a b%20": body[:7000] + b"\xff\xfe"}
    # A packed file is no text of its own bytes.
    files["packed.gz"] = gzip.compress(body)
    for name, data in files.items():
        (tmp_path / (name + ".bin" * ("." not in name))).write_bytes(data)
    monkeypatch.setattr(P, "WHOLE", 5000)
    monkeypatch.setattr(P, "PIECE", 300)
    seen, old = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    many = P._long_digests
    monkeypatch.setattr(P, "_long_digests", lambda s, p, g, long: seen.extend(x.file for x in long.collect()) or many(s, p, g, long))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {x.file: (x.sha256, x.bytes) for x in P.shard_digests(spark, str(tmp_path), "*").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n + ".bin" * ("." not in n): (hashlib.sha256(b).hexdigest(), len(b)) for n, b in files.items()}
    assert sorted(seen) == sorted(f"{n}.bin" for n, b in files.items() if len(b) > 5000 and n != "packed.gz")
