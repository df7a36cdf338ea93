"""Every operator against brute force on small fixtures, with nulls, empty and repeated rows, empty tables and clashing names."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import decontamination, html, jaccard, licenses, lines, packing, quality, sharding, urls, warc
from lamina.llm.common import connected_components
from lamina.llm.kernels import slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed=0, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r, words = random.Random(3), vocabulary()
    rows, base = [], prose(r, words, 120)
    for i in range(60):
        rows.append((i, prose(r, words, r.randint(1, 150)) + "\n" + prose(r, words, 20), "en", f"s{i % 3}", 0))
    near = base.split(" ")
    for i in range(60, 72):
        w = list(near)
        for _ in range(2):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w), "en", "s1", 0))
    rows += [(80, None, None, None, None), (81, "", "en", "s0", 0), (82, base, "en", "s0", 0), (83, base, "en", "s0", 0), (83, base, "en", "s0", 0), (None, "lone text of a null id", "en", None, 1), (84, "x", "en", "s2", 1)]
    rows.append((85, "Äé😀 the MIT License\n" * 30 + "released Under the MIT license. " + prose(r, words, 3000), "de", "s2", 1))
    return spark.createDataFrame(rows, DOCS).withColumn("_id", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("node", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_slices_keep_every_text():
    texts = pa.array(["abc", None, "", "é" * 9, "x"])
    found = [bytes(s.data[s.offsets[i] : s.offsets[i + 1]]).decode() for s in slices(texts, 4) for i in range(s.n)]
    assert found == ["abc", "", "", "é" * 9, "x"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == got[1001] == 1000


def test_capacity_tree_is_balanced_and_exact():
    r, tree, have = random.Random(1), sharding.CapacityTree(), set()
    for i in range(2000):
        key = (r.randrange(500), i)
        tree.add(key)
        have.add(key)
        if r.random() < 0.4:
            gone = r.choice(sorted(have))
            tree.remove(gone)
            have.discard(gone)
    assert tree.root.height <= 16
    for s in range(0, 520, 7):
        assert tree.tightest(s) == min((k for k in have if k[0] >= s), default=None)


def test_best_fit_equals_one_by_one():
    r = random.Random(5)
    sizes = [r.randint(1, 60) for _ in range(300)]
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if fits:
            b = min(fits, key=lambda b: (bins[b], b))
            bins[b] -= s
        else:
            bins.append(100 - s)
    histogram = {s: sizes.count(s) for s in sizes}
    plan = sharding.best_fit_decreasing(list(histogram.items()), 100)
    used = {}
    for s, n, b in plan:
        used[b] = used.get(b, 0) + s * n
    assert len(used) == len(bins) and sorted(100 - u for u in used.values()) == sorted(bins)


def test_shards(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (82, 83)}) == 1
    assert {r["size"] for r in rows if r["doc_id"] in (80, 81)} == {1}
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 84} == {zlib.crc32(b"x")}
    assert sharding.shard(empty, 4).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::3]
    cascade = urls.build_cascade(spark.createDataFrame([(k,) for k in listed] + [(None,)], "key string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    h = spark.createDataFrame([(k,) for k in keys], "key string").select("key", *[F.xxhash64("key", F.lit(s)) for s in urls.HASH_SEEDS]).collect()
    a, b = (np.array([r[i] for r in h], np.int64).view(np.uint64) for i in (1, 2))
    assert {r["key"] for r, x in zip(h, cascade.holds(a, b), strict=True) if x} == set(listed)
    assert len(cascade.levels) > 1 and cascade.bytes < 3000


def test_url_rules(spark):
    rows = [(1, "http://A.Example.COM/en/7?x"), (2, "https://x.com/en/1"), (3, "noscheme/en/"), (4, None), (5, ""), (6, "http://a.example.net/de/81#t"), (7, "x://b.net/de/"), (7, "x://b.net/de/"), (8, "ftp://fakecom/en/7")]
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)), urls.RULES).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (2, "x.com", "/en/1", "com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "a.example.net", "/de/81", "example.net/de/8", "block"), (7, "b.net", "/de/", "net/de/", "allow"), (7, "b.net", "/de/", "net/de/", "allow"), (8, "fakecom", "/en/7", None, "allow")], key=str)
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0


def words_of(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_places(spark, docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        w = words_of(r["text"])
        places = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        row = got[(r["doc_id"], len(w))]
        assert row["n_base"] == len(places) and row["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert row["first_word"] == min((i for i, _ in places), default=None) and row["last_word"] == max((i for i, _ in places), default=None)
    assert licenses.scan(empty).count() == 0
    long = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    broken = long.replace("source and binary", "source or any binary")
    row = licenses.scan(spark.createDataFrame([(1, f"intro words here {broken} and so on")], "doc_id long, text string")).first()
    assert row["labels"] == "bsd" and 0.6 <= row["score"] < 1


def line_sets(docs):
    out = []
    for r in docs.collect():
        for i, x in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            if len(x) >= lines.MIN_CHARS:
                out.append(((r["doc_id"] is not None, r["doc_id"] or 0), i, x, {x[j : j + 5] for j in range(len(x) - 4)}))
    return out


def test_lines_against_brute_force(spark, empty):
    r, words = random.Random(9), vocabulary(4)
    base = [prose(r, words, 30) for _ in range(5)]
    rows = []
    for i in range(40):
        text = [prose(r, words, 20), r.choice(base)]
        copy = list(r.choice(base))
        copy[r.randrange(len(copy))] = "Z"
        rows.append((i, "\n".join([*text, "".join(copy), "short"]), "en", "s", 0))
    rows += [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, rows[0][1], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    found = line_sets(df)
    parent = list(range(len(found)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][3], found[b][3]
            if len(x & y) * 100 >= len(x | y) * 80:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    keep = {}
    for i, (key, line, _, _) in enumerate(found):
        keep[top(i)] = min(keep.get(top(i), (key, line)), (key, line))
    want = {}
    for i, (key, line, _, _) in enumerate(found):
        if (key, line) != keep[top(i)]:
            want.setdefault(key[1], []).append(line)
    got = {r["doc_id"]: r for r in lines.dedup_lines(df.withColumn("line", F.lit(0)).withColumn("dropped_lines", F.lit(1))).collect()}
    for i, text, *_ in rows:
        left = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in want.get(i, []))
        assert got[i]["text"] == left and got[i]["n_dropped"] == len(want.get(i, []))
    assert lines.dedup_lines(empty).count() == 0


def test_short_lines_are_deduplicated(spark):
    near = "Terms of use, 2024"
    rows = [(1, f"Menu\nHome page\n\n  \n{near}\nab", "en", "s", 0), (2, f"Home page\nMenu\n\n  \n{near}5\nac\nab", "en", "s", 0), (3, "ÄÖ\nÄÖ\nÄÖÜ", "de", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[0][1], 2: "\n  \nac", 3: "ÄÖ\nÄÖÜ"}


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bpe = packing.encoder()
    want = sorted(zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for r in docs.collect() for ids in [[*bpe.encode_ordinary(r["text"] or ""), 2]] for cuts in [packing.cut_points(len(ids))] for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True))
    assert sorted(r["ids_crc32"] for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 1024) + 2
    assert packing.pack(empty).count() == 0


def test_tokenizers_give_the_same_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "Hello  world\n\n it's 12 o'clock", "Äé😀\u3000x <|endoftext|> y", "a" * 5000, "\t\x0b\x85 \u2028 １２ ǅ\r\n  \n"):
        assert t.encode(text, add_special_tokens=False).ids == packing.encoder().encode(text, allowed_special="all")


def test_added_token_has_its_own_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "é<|endoftext|>\n<|endoftext|", "plain"]
    got = {r["doc_id"]: list(r["ids"]) for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).withColumnRenamed("_id", "doc_id").collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}


def test_jaccard_against_brute_force(docs, empty):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * 100 >= len(x | y) * 80:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[top(i)] = min(least.get(top(i), r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), len(sets[i]), str(least.get(top(i)))) for i, r in enumerate(rows))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_components(docs).collect())
    assert got == want
    assert jaccard.near_components(empty).count() == 0


def test_jaccard_of_a_very_long_text(spark):
    words = [str(i) for i in range(1_340_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], "x"])), (3, "a short text of some few words")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1_339_996, 1), 2: (1_339_988, 1), 3: (3, 3)}


def test_blocks_of_a_very_large_set():
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 1_100_000).astype(np.uint64))
    weights = np.zeros(jaccard.SLOTS, np.int8)
    n = len(h)
    _, sig = jaccard.blocks(np.array([0, n]), h, weights)
    top = 2**21 * 100 // 80 + 1
    part = (jaccard.mix(h + np.uint64(0x51)) % np.uint64(3 * (int(jaccard.most_differing(top)) + 1))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.diff(part[order], prepend=-1))
    parity = np.bitwise_xor.reduceat(jaccard.mix(h[order]), first)
    want = jaccard.mix(parity ^ jaccard.mix(np.uint64(20 << 32) + part[order][first].astype(np.uint64)))
    assert np.isin(np.sort(want)[: int(jaccard.most_differing(np.int64(n))) + 1], sig).all()


def test_sketches_rule_out_no_link(spark):
    from lamina.llm import buckets

    r = np.random.default_rng(2)
    sets, pairs = [], []
    for n in (1, 5, 60, 250, 300, 700, 1100, 5000):
        base = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        for keep in (1, 0.95, 0.9, 0.85, 0.6, 0.2):
            other = np.unique(np.concatenate([base[: int(len(base) * keep)], r.integers(0, 2**63, int(len(base) * (1 - keep)), dtype=np.uint64)])) if keep < 1 else np.append(base, base[-1] + np.uint64(1))
            pairs.append((len(sets), len(sets) + 1))
            sets += [base, other]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    columns = buckets.sketched(begins, np.concatenate(sets))
    rows = list(zip(range(len(sets)), *(c.to_pylist() for c in columns), strict=True))
    sides = spark.createDataFrame(rows, "node long, " + ", ".join(f"{c} {t}" for c, t in buckets.SKETCH))
    left = {(x["a"], x["b"]) for x in buckets.possible(spark.createDataFrame(pairs, "a long, b long"), sides, 80, 100).collect()}
    for a, b in pairs:
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        alike = len(x & y) / max(len(x | y), 1)
        assert (a, b) in left or alike < 0.8
        assert (a, b) not in left or alike >= 0.5 or len(x) <= 5


def test_meetings(spark, monkeypatch):
    from lamina.llm import buckets

    r = np.random.default_rng(4)
    rows = [(int(k) * 1_000_003, int(n)) for k, n in zip(r.integers(0, 400, 3000), r.integers(0, 60, 3000), strict=True)] + [(7, n) for n in range(500)] + [(8, 1), (8, 1), (-9, 2)]
    held = {}
    for k, n in rows:
        held.setdefault(k, set()).add(n)
    want = sorted((k, n) for k, ns in held.items() if len(ns) > 1 for n in ns)
    df = spark.createDataFrame(rows, "sig long, node long").repartition(3)
    keys = lambda b: iter([(np.asarray(b.column(0)), np.asarray(b.column(1)))])
    assert sorted(map(tuple, buckets.meetings(df, keys).collect())) == want
    monkeypatch.setattr(buckets, "HELD", 16)
    monkeypatch.setattr(buckets, "PACKED", 64)
    assert sorted(set(map(tuple, buckets.meetings(df, keys).collect()))) == want


def test_keys_of_the_same_nodes_are_one(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    from lamina.llm import buckets

    r = np.random.default_rng(6)
    rows = [(int(k) * 1_000_003, int(n)) for k, n in zip(r.integers(0, 500, 1500), r.integers(0, 12, 1500), strict=True)] + [(k, n) for k in range(-90, 0) for n in (1, 2, 3)] + [(-5, 2)]
    held = {}
    for k, n in rows:
        held.setdefault(k, set()).add(n)
    want = Counter(frozenset(ns) for ns in held.values() if len(ns) > 1)
    df = spark.createDataFrame(rows, "sig long, node long").repartition(3)
    keys = lambda b: iter([(np.asarray(b.column(0)), np.asarray(b.column(1)))])

    def found():
        got, weights = {}, {}
        for x in buckets.meeting_sets(df, keys).collect():
            got.setdefault(x["sig"], set()).add(x["node"])
            weights.setdefault(x["sig"], set()).add(x["w"])
        return got, weights

    got, weights = found()
    assert {frozenset(ns): weights[k] for k, ns in got.items()} == {ns: {w} for ns, w in want.items()}
    assert len(got) == len(want) < len(held)
    monkeypatch.setattr(buckets, "HELD", 16)
    monkeypatch.setattr(buckets, "PACKED", 64)
    pairs = lambda sets: {p for ns in sets for p in combinations(sorted(ns), 2)}
    assert pairs(found()[0].values()) == pairs(want)


def test_a_shared_passage_is_one_key(spark):
    r, words = random.Random(9), vocabulary(5, 3000)
    passage = prose(r, words, 150)
    rows = [(f"{prose(r, words, 150)} {passage} {prose(r, words, 150)}",) for _ in range(4)]
    df = spark.createDataFrame(rows, "text string")
    members = jaccard._bucketed(df, np.zeros(jaccard.SLOTS, np.int8), "text").collect()
    assert len(members) <= 4 * 11  # of four texts there are eleven sets of two and more
    assert len({(x["sig"], x["node"]) for x in members}) == len(members)
    assert sum(x["w"] for x in members) > 4 * 11


def test_keys_with_two_nodes_are_met_in_pieces():
    from lamina.llm.buckets import _met

    known, waiting, told = np.zeros(0, np.uint64), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), set()
    rows = [(5, 1), (5, 1), (6, 1), (7, 1), (5, 2), (6, 1), (7, 3), (7, 4), (5, 9), (8, 2)]
    for at in range(0, len(rows), 3):
        sig, node = (np.array(x) for x in zip(*rows[at : at + 3], strict=True))
        found = _met(np.concatenate([waiting[0], sig.astype(np.uint64)]), np.concatenate([waiting[1], node]), known)
        told |= {(int(found[3][i]), int(found[4][i])) for i in found[0]}
        waiting, known = (found[3][found[1]], found[4][found[1]]), np.union1d(known, found[2])
    assert told == {(5, 1), (5, 2), (5, 9), (7, 1), (7, 3), (7, 4)}


def test_quality(spark, docs, empty):
    got = quality.judged(docs, ["doc_id"]).collect()
    assert len(got) == docs.count() and quality.judged(empty, ["doc_id"]).count() == 0
    rows = [(1, "a b c d e f g h\na b c d e f g h\n \n#%x", "en", "bad", 0), (2, None, "en", "bad", 0), (3, " ".join(map(str, range(40))), "en", "bad", 0), (4, " ".join(map(str, range(40))), "en", "good", 0)]
    rows += [(i, "two words", "en", "bad", 0) for i in range(5, 60)] + [(i, " ".join(map(str, range(30))), "en", "good", 0) for i in range(60, 120)]
    by = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")), ["doc_id"]).collect()}
    assert (by[1]["n_words"], by[1]["word_chars"], by[1]["n_symbols"], by[1]["n_dup_lines"], by[1]["n_repeat_words"]) == (17, 19, 2, 1, 16)
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[3]["base_failed"]
    assert not by[3]["kept"] and by[4]["kept"]


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://x/1", "<p>same</p>"), (1, "http://x/2", "<p>same</p>"), (2, None, None), (5, "u\r\nv", ""), (7, "http://x", "é" * 70000), (7, "http://x", "é" * 70000), (8, "http://y", "\x1f\x8b\x08 not a member")]
    rows += [(i, "http://z", f"page {i} " * 200) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    files = warc.write_warc(df, f"file://{tmp_path}/w")
    for split in (200, 5000, 1 << 20):
        got = warc.read_warc(spark, files, split).collect()
        assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
        by = {r["page_id"]: r for r in got}
        assert by[3]["record_type"] == "revisit" and by[3]["refers_to"] == 1 and by[3]["payload_bytes"] == 11 and by[1]["payload"] == b"<p>same</p>"
        assert by[5]["refers_to"] == 2 and by[7]["record_type"] == "response" and by[7]["payload_bytes"] == 140000
        assert all(warc.digest((html_ or "").encode()) == by[i]["payload_digest"] for i, _, html_ in rows)
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == len(rows)
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_warc_of_a_long_url(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    rows = [(1, "data:" + "".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_") for _ in range(300_000)), "<p>one</p>"), (2, "http://x", "<p>two</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.read_warc(spark, warc.write_warc(spark.read.parquet(f"{tmp_path}/pages.parquet"), f"file://{tmp_path}/w"), 5000).collect()
    assert sorted((x["page_id"], x["url"]) for x in got) == [x[:2] for x in rows]
    assert warc.op8_warc_roundtrip(spark, str(tmp_path)).count() == 2
    read = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda *a, **k: read(*a, **k).where("page_id <> 2"))
    with pytest.raises(ValueError, match="2 records written, 1 read"):
        warc.op8_warc_roundtrip(spark, str(tmp_path))


def test_decontamination_of_null_and_tied_items(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma delta"), (7, "one two three four five"), (7, "red green blue nowhere"), (7, "six seven eight nine")], "item_id long, text string")
    rows = [(1, "so alpha beta gamma delta it is"), (2, "one two three four five"), (3, "the six seven eight nine"), (4, "red green blue"), (5, "alpha beta gamma delta one two three four five")]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: (4, 1, True), 2: (5, 1, True), 3: (4, 1, True), 4: (0, 0, False), 5: (9, 2, True)}


def test_decontamination_against_brute_force(spark, docs, empty):
    r, words = random.Random(8), vocabulary(7, 40)
    items = [(i, prose(r, words, r.choice([1, 2, 4, 9, 10, 25]))) for i in range(15)] + [(20, None), (21, ""), (22, "the, THE the")]
    rows = [(i, prose(r, words, r.randint(0, 60)) + " " + (items[i % 15][1] if i % 3 else "") + " tail", "en", "s", 0) for i in range(40)] + [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (3, "the the the the", "en", "s", 0)]
    windows = [(str(i), tuple(w[k : k + min(10, len(w))])) for i, t in items for w in [words_of(t)] if w for k in range(len(w) - min(10, len(w)) + 1)]
    import hashlib

    want = []
    for i, t, *_ in rows:
        w, hit, named = words_of(t), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    named.add(item)
        want.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = [tuple(r) for r in decontamination.contaminated(spark.createDataFrame(rows, DOCS).withColumn("gram", F.lit(1)), bench).collect()]
    assert sorted(got) == sorted(want)
    assert decontamination.contaminated(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contaminated(docs, bench.limit(0)).collect())


def test_html_extraction(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies on this site.</div><article><h1>Title &amp; more</h1><p><b>First   paragraph<br>of the text.</p><p>Second &lt;one&gt;, long enough to be prose.</p></article>'
        '<section class="comments"><div class="comment"><p>Nice article, thanks a lot!</p></div></section><footer>&copy; Someone</footer>'
    )
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    want = "Title & more\n\nFirst paragraph of the text.\n\nSecond <one>, long enough to be prose."
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and html.extract(df).count() == 4 and html.extract(df.limit(0)).count() == 0


def test_html_features_read_whole_blocks():
    late = [html.features([html.Block(" ".join(["word"] * 3000 + [w]), ("p",), ("p",), 0.0)])[1][0] for w in ("advertisement", "cookies")]
    assert [len(x) for x in late] == [3001, 3001] and late[0] != late[1]
    utility = " ".join("abcdefghijklmnop")
    assert ".comments" in html.blocks_of(f'<div class="{utility} comments">text</div>')[0].labels


def test_html_reads_formulas_and_fallback_text(spark):
    prose = "The area of a circle grows with the square of its radius, as was known long ago"
    page = f"<article><h1>Circles</h1><p>{prose}: <math><mi>A</mi><mo>=</mo><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup></math> holds.</p><object data='x.swf'><param name='a'><p>{prose}, says the drawing.</p></object><canvas><p>{prose} too.</p></canvas></article>"
    text = html.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    assert text == f"Circles\n\n{prose}: A=πr2 holds.\n\n{prose}, says the drawing.\n\n{prose} too."


def test_html_labeller_on_held_out_pages():
    from lamina.llm.html_training import accuracy

    assert accuracy(html.load_weights(), pages=120, seed=4711) > 0.98


def test_html_gradients():
    from lamina.llm.html_training import examples, gradients, start

    batch = [(*html.features(b), y) for b, y in examples(3, 1)]
    w = {k: v.astype(np.float64) for k, v in start().items()}
    _, g = gradients(batch, w)
    for name, at in (("uf", (2, 5)), ("wb", (0, 3)), ("out", (4, 0)), ("bf", (7,))):
        step = {k: v.copy() for k, v in w.items()}
        step[name][at] += 1e-3
        up, _ = gradients(batch, step)
        step[name][at] -= 2e-3
        down, _ = gradients(batch, step)
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3


def test_stages_remove_by_row_identity(spark, tmp_path):
    r, words = random.Random(14), vocabulary(14)
    a, b, c, d, e, passage = (prose(r, words, 40) for _ in range(6))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, c), (None, f"{d} {passage}"), (None, d), (None, e), (None, e), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    stay = lambda df: sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)
    assert stay(jaccard.jaccard_stage(spark, docs, "")) == sorted([(1, a), (2, b), (None, c), (None, f"{d} {passage}"), (None, d), (None, e), (5, ""), (5, "")], key=str)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stay(decontamination.decontamination_stage(spark, docs, str(tmp_path))) == sorted([x for x in rows if passage not in x[1]], key=str)


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    r, words = random.Random(12), vocabulary(12)
    passage = prose(r, words, 20)
    rows = [(i, prose(r, words, 80), "en", "s", 0) for i in range(20)]
    rows += [(30, rows[0][1], "en", "s", 0), (31, prose(r, words, 40) + "\n" + passage, "en", "s", 0), (32, "few words", "en", "s", 0), (33, None, "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        kept.append({r["doc_id"] for r in at.collect()})
    assert kept[0] == {*range(20), 30, 31} and kept[1] == {*range(20), 31} and kept[2] == kept[1] and kept[3] == set(range(20))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
