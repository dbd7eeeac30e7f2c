"""Codec, counts, secrets and decontamination beside the libraries and plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from strandwork.llm import bpe, decontamination, secrets, token_counts

BYTE_BPE, PIECE_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
BITS = ["the", "ing", " ", "   ", "\n", "a", "é", "日本", "𝔘", "\0", "<|endoftext|>", "12", "\t", "'s", "'ll", "²", "\x1c", "\x85", "　", "▁", "<s>", "ab", "ł"]
MIXED = st.lists(st.sampled_from(BITS) | st.text(max_size=4), max_size=25).map("".join)


def rows_of(flat, counts):
    ends = np.cumsum(counts)
    return [flat[e - n : e].tolist() for e, n in zip(ends, counts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(MIXED, max_size=5))
def test_ids_are_those_of_the_library_and_decode_back(texts):
    coder, library = bpe.codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE) if not hasattr(test_ids_are_those_of_the_library_and_decode_back, "t") else test_ids_are_those_of_the_library_and_decode_back.t
    test_ids_are_those_of_the_library_and_decode_back.t = library
    for text, own in zip(texts, rows_of(*coder.encode(texts))):
        assert own == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(np.array(own, np.int64)) == library.decode(own, skip_special_tokens=False) == text


def test_long_words_are_encoded_in_linear_time_and_exactly():
    coder, library = bpe.codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(3)
    for text in ("a" * 30_000, " " * 30_000, "".join(rng.choice("abcdefghij") for _ in range(30_000)), "é" * 9_000):
        assert rows_of(*coder.encode([text]))[0] == library.encode(text, add_special_tokens=False).ids


def test_cut_tokens_decode_to_replacement_characters():
    coder, library = bpe.codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    ids = rows_of(*coder.encode(["日"]))[0][:1]
    assert coder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(MIXED)
def test_counts_are_those_of_the_library(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    assert token_counts.vocabulary(PIECE_BPE).counts([text]) == [len(model.encode(text))]


@pytest.mark.parametrize("text", [" " * 5000, "a" * 5000, "ab" * 4000, "x" + " " * 31, "".join(random.Random(5).choice("abcdeingst") for _ in range(6000))])
def test_counts_of_runs_and_long_words(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    assert token_counts.vocabulary(PIECE_BPE).counts([text, text]) == [len(model.encode(text))] * 2


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(text) if len(m[0]) >= 16])


SECRET_BITS = ["password", "PassWd", "secret", "tok", "token", "api_key", "apiKey", "=", ":", " ", '"', "'", "AKIA", "Z9", "0a", "ff", "deadbeef", "\n",
               "ſ", "K", "-", "A1B2C3D4E5F6", "ghp_", "日"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(SECRET_BITS), max_size=30).map("".join))
def test_secrets_are_those_of_the_plain_expressions(text):
    found = secrets.spans(text)
    assert [s for s in found if s[1] < 3] == plain_spans(text)
    clean = secrets.redact(text, found)
    assert not found or len(clean) != len(text) or clean != text


def test_checksums_decide_about_added_tokens():
    body = "a1B2c3D4e5" * 3
    good = f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()))}"
    assert secrets.spans(f"x {good} y") == [(2, 3, 2 + len(good))]
    assert secrets.spans(f"x {good[:-1]}~ y") == []
    assert secrets.redact(f"x {good} y", secrets.spans(f"x {good} y")) == "x <checked> y"
    assert secrets.redact("token = abcdef0123456789abcd", secrets.spans("token = abcdef0123456789abcd")) == "<assign>"


def test_secret_scan_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, "", None), (None, "AKIA" + "Z" * 20, None), (2, "x" * 300_000 + " AKIA" + "Q" * 16, None)],
                                 "doc_id long, text string, spans string")
    got = sorted((r.n_access, r.spans) for r in secrets.scan(docs).collect())
    assert got == [(0, ""), (0, ""), (1, "access:0:24"), (1, "access:300001:300021")]
    assert {r.base_sha256 for r in secrets.scan(docs).where("n_access = 0").collect()} == {hashlib.sha256(b"").hexdigest()}
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.where("text IS NULL").count() == 1
    assert secrets.scan(docs.limit(0)).count() == 0


def test_encoding_and_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "the the", 5), (3, "é" * 100_000, 5)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode(docs, BYTE_BPE, ids=True).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 100_000]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BYTE_BPE, ids=True), BYTE_BPE).collect()}
    assert back[None] == "the the" and back[3] == "é" * 100_000
    counts = {(r.doc_id, r.n_bytes, r.over_limit) for r in token_counts.count_tokens(docs, PIECE_BPE).collect()}
    assert counts == {(1, 0, False), (None, 7, False), (3, 200_000, True)}
    assert bpe.encode(docs.limit(0), BYTE_BPE).count() == token_counts.count_tokens(docs.limit(0), PIECE_BPE).count() == 0


def plain_report(docs, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for key, text in docs:
        own, hit, met = words(text), set(), []
        for number, (item, t) in enumerate(items):
            w = words(t)
            size = min(n, len(w))
            windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            at = [i for i in range(len(own) - size + 1) if tuple(own[i : i + size]) in windows]
            hit |= {i + k for i in at for k in range(size)}
            met += [item] if at else []
        named = ",".join(sorted(str(i) for i in met if i is not None))
        out.append((key, len(own), len(hit), len(met), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_windows_of_the_benchmark(spark, block_bytes):
    rng = random.Random(4)
    say = lambda k: " ".join(rng.choice(["Ab", "cé", "d1", "e", "f!"]) for _ in range(k))
    items = [(1, say(6)), (2, say(4)), (2, say(4)), (None, say(5)), (5, None), (6, "--"), (7, "ab"), (8, "zz yy xx ww")]
    docs = [(i % 9, say(rng.randint(0, 60))) for i in range(40)] + [(None, None), (3, ""), (4, "q ZZ yy, xx; ww q " * 3)]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontamination.report(d, b, n=4, block_bytes=block_bytes).collect()), key=repr)
    assert got == plain_report(docs, items, 4)
    kept = decontamination.cleaned(d, b, n=4, block_bytes=block_bytes)
    assert kept.columns == d.columns and kept.count() == sum(not r[5] for r in got)
    cut = decontamination.cleaned(d.where("doc_id = 4"), b.where("item_id = 8"), mode="spans", n=4)
    assert {re.sub(r"\W+", " ", r.text).strip() for r in cut.where("text LIKE 'q%'").collect()} == {"q q q q q q"}
    assert decontamination.report(d, b.limit(0), n=4).where("contaminated").count() == 0
    assert decontamination.report(d.limit(0), b, n=4).count() == 0


def test_repeated_rows_of_the_benchmark_are_one(spark):
    # 300 equal rows and two others: with a block for about two different rows, no block gets more.
    items = spark.createDataFrame([(1, "ab cd ef gh")] * 300 + [(2, "x y z w"), (3, "q r s t")], "item_id long, text string")
    blocks, every = decontamination._blocks(items, 4, "item_id", "text", 27)
    built = [b.value for b in every]
    assert blocks == 3 and sum(len(b.ids) for b in built) == 3 and sorted(n for b in built for n in b.times) == [1, 1, 300]
    docs = spark.createDataFrame([(1, "AB cd ef gh " * 20_000, 5), (2, "nothing", 5)], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in decontamination.report(docs, items, n=4, block_bytes=27).collect()}
    assert got[1].n_items == 300 and got[1].n_hit == got[1].n_words == 80_000 and not got[2].contaminated
    assert got[1].items_sha256 == hashlib.sha256(",".join(["1"] * 300).encode()).hexdigest()


def test_worker_memories_are_bounded_by_bytes(monkeypatch):
    coder = bpe.Codec(BYTE_BPE)
    monkeypatch.setattr(bpe, "REMEMBERED", 5_000)
    for k in range(20):
        assert coder.decode(coder.encode([" ".join(f"word{k}x{i}" for i in range(50))])[0]).startswith(f"word{k}x0")
        assert coder.index.held < 5_000 + 60 * 300
    own = token_counts.Vocabulary(PIECE_BPE)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5_000)
    for k in range(20):
        own.counts([" ".join(f"word{k}x{i}" for i in range(50))])
        assert own.held < 5_000 + 60 * 300 and len(own.known) <= own.held


def test_pieces_are_cut_by_bytes():
    import pyarrow as pa

    from strandwork.llm import texts

    rows = ["é" * 300_000, None, "", "x" * 900_000, "y" * 2_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows)], ["k", "text"]).slice(1)
    found = list(texts.pieces(iter([batch, batch.slice(0, 0)])))
    assert [t for _, own in found for t in own] == [t or "" for t in rows[1:]]
    assert [part.column(0).to_pylist() for part, _ in found] == [[1, 2, 3], [4], [5]]
