"""Filter orders, packed windows and source divergence beside brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandwork.llm import divergence, filter_audit, packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_merges_of_sorted_lists():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(rng.choice([12, 400])), rng.randint(0, 10))) for _ in range(rng.randint(1, 5))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        assert filter_audit.difference(lists[0], lists[-1]) == sorted(set(lists[0]) - set(lists[-1]))
    assert filter_audit.union([list(range(1000)), [500], [2000]]) == [*range(1000), 2000]
    assert filter_audit.difference(list(range(1000)), [-5, 3, 2000]) == [0, 1, 2, *range(4, 1000)]


def plain_audit(docs, labels):
    first = {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    judged = defaultdict(list)
    for key, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, bad in zip("ABCDE", [
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)), key is not None and t in first and first[t] < key]) if bad}
        judged[source or ""].append((fails, any(k == key and q == 1 for k, q, _ in labels if k is not None), any(k == key and x == 1 for k, _, x in labels if k is not None)))
    out = []
    for part, rows in judged.items():
        own, value = [], Counter()
        for way in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(way, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                value[f] += len(gone)
                own.append((part, "".join(way), step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                            sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r, value[r[1][r[2] - 1]]) for r in own]
    return sorted(out)


AUDIT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_filter_orders_are_those_of_all_documents(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeéß") for _ in range(n))
    docs = []
    for i in range(150):
        text = " ".join(word(rng.choice([1, 4])) for _ in range(rng.choice([3, 60, 80])))
        text = rng.choice([text, text.upper(), text + " 5%", text.title()])
        docs.append((i, text, rng.choice(["a", "b", "b", "b", None, ""])))
    docs += [(200 + i, docs[i][1], "copy") for i in range(12)] + [(7, "same id", "a"), (7, "same id", "a"), (None, docs[0][1], "b"), (None, "", "b")]
    docs += [(300, None, "a"), (301, "", "b"), (302, "long " * 60000, "c"), (303, "\x1c\x85\xa0 x", "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 210, 2)] + [(2, 1, 1), (None, 1, 1), (7, 1, 0)]
    df = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, source string, part string, fails boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.decisions(df, marks))
    assert got.columns == AUDIT
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(filter_audit.decisions(df.limit(0), marks)).count() == 0
    # Many small ranges and one give the same sums; a part in which nothing fails has its rows, of zeros.
    clean = " ".join(f"w{i}" for i in range(60))
    one = filter_audit.audit(filter_audit.decisions(spark.createDataFrame([(1, clean, "p")], "doc_id long, text string, source string"), marks)).collect()
    assert len(one) == 600 and all(r.kept == 1 and not any(r[4:]) for r in one)


def test_ranges_add_up(monkeypatch, spark):
    rows = [(i * 3, "p" if i % 3 else "q", random.Random(i).randrange(8), i % 2 == 0, i % 5 == 0) for i in range(300)]
    decided = spark.createDataFrame(rows, "row long, part string, fails int, good boolean, toxic boolean")
    whole = sorted(map(tuple, filter_audit.audit(decided, "XYZ").collect()))
    monkeypatch.setattr(filter_audit, "RANGE", 16)
    assert sorted(map(tuple, filter_audit.audit(decided, "XYZ").collect())) == whole
    assert len(whole) == 2 * 6 * 3


def lay_out(rows, docs, end=packing.END_ID):
    """Every id in exactly one piece, every sequence without gaps: checked against the library."""
    library = Tokenizer.from_file(BYTE_BPE)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, end] for k, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.window, r.step))
    for k, own in ids.items():
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for offset, length, _, _ in sorted(own):
            assert offset == at
            at += length
        assert {(w, s) for *_, w, s in own} == {(at, own[0][3])} and at <= 2048 and at & (at - 1) == 0
    return pieces, sequences


def test_windows_hold_every_id_once(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["wörd", "the", "of", "Zeit", "12"]) for _ in range(rng.choice([1, 20, 90, 700, 3000])))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "x" * 40000), (903, " " * 30000 + "<|endoftext|>"), (904, "Ⅷ½² x\x85"), (905, "\n" * 1_000_000)]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, window int, step string").repartition(3)
    got = packing.packed(df, BYTE_BPE, pool_tokens=6000, step_tokens=4096)
    rows = got.collect()
    _, sequences = lay_out(rows, docs)
    # Steps of full size hold the same number of ids, of windows of one length.
    steps = defaultdict(list)
    for own in sequences.values():
        steps[own[0][3]].append(own[0][2])
    assert all(len(set(s)) == 1 for s in steps.values()) and sum(sum(s) == 4096 for s in steps.values()) > 20
    assert max(map(sum, steps.values())) == 4096
    assert packing.packed(df.limit(0), BYTE_BPE).count() == 0


def test_repeated_and_null_ids_are_documents(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c"), (4, "c")], "doc_id long, text string").coalesce(1)
    rows = packing.packed(df, BYTE_BPE).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == {(None, 3): 2, (4, 2): 2}
    assert sum(r.length for r in rows) == 10


def test_packer_fills_windows_and_balances_steps():
    rng = random.Random(1)
    packer = packing.Packer(0, pool_tokens=1 << 17, step_tokens=1 << 14)
    total = 0
    for i in range(4000):
        n = rng.choice([rng.randint(1, 60), rng.randint(100, 900), rng.randint(1500, 5000)])
        total += n
        packer.add(i, np.arange(n, dtype=np.uint32))
    packer.finish()
    used, cost, window = Counter(), Counter(), {}
    for _, _, length, _, _, sequence, _, w, step in packer.rows:
        used[sequence] += length
        cost[step] += length**2
        window[sequence] = (w, step)
    assert sum(used.values()) == total and all(used[s] == w for s, (w, _) in window.items())
    # Little is in windows below the tiers, few documents are cut below the longest window, and steps of a tier cost about the same.
    assert sum(w for w, _ in window.values() if w not in packing.WINDOWS) < 256
    ids = Counter(step for _, step in window.values())
    full = [cost[s] for s, n in ids.items() if n == 8 and {w for w, t in window.values() if t == s} == {2048}]
    assert len(full) > 100 and max(full) < 1.5 * min(full)
    with pytest.raises(ValueError):
        packing.Packer(0, windows=(300, 2048))


def plain_divergence(docs, least=3, top=200):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {a for a, _ in groups}:
        kept = sorted(w for w, n in df[lang].items() if n >= least)
        own = sorted(s for a, s in groups if a == lang)

        def shares(count):
            total = sum(count[w] for w in kept)
            return [1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept]

        whole = shares(sum((counts[lang, s] for s in own), Counter()))
        p = {s: shares(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(sum((x - y) ** 2 // y for x, y in zip(p[s], p[t])), t) for t in own if t != s]
            words = [((x - y) ** 2 // y, w) for w, x, y in zip(kept, p[s], whole) if counts[lang, s][w] and x > y]
            for part, items in (("pair", pairs), ("term", words)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 64, 1024, 1024), (7, 3, 4, 6)])
def test_divergence_is_that_of_all_terms(spark, monkeypatch, blocks):
    for name, size in zip(("TERMS", "SOURCES", "SLAB", "COLUMNS"), blocks):
        monkeypatch.setattr(divergence, name, size)
    rng = random.Random(11)
    words = ["the", "The", "straße", "Éa", "éa", "x1y", "don't", "日本", "😀"] + [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    docs = [(" ".join(rng.choices(words, weights=[50] + [rng.random() * 3 for _ in words[1:]], k=rng.choice([2, 30, 90]))),
             rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b", "c", "d", "e", "f", "g", "h", None])) for _ in range(120)]
    docs += [(None, "en", "empty"), ("", "none", "a"), ("", "none", "b"), ("only once", "rare", "z"), ("hot " * 50000, "de", "a"), ("1 2 3", "", "q")]
    docs += docs[:5]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "text string, lang string, source string, n int, term string")
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(docs)
    assert divergence.audit(df.limit(0)).count() == 0


def test_large_counts_are_priced_exactly():
    counts = np.array([[10**13, 3], [0, 10**11], [5, 5]], np.int64)
    totals = counts.sum(0) + len(counts)
    want = [[0, 0], [0, 0]]
    for a in range(2):
        for b in range(2):
            for row in counts.tolist():
                p, q = (1 + 10**9 * (row[i] + 1) // int(totals[i]) for i in (a, b))
                want[a][b] += (p - q) ** 2 // q
    assert divergence.priced(counts, totals).tolist() == want
