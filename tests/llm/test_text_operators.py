"""Edge cases and brute-force versions of the operators on documents."""

import random
import re
import string
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlake.llm import decontaminate, jaccard_join, licenses, packing, sharding, shingles, toxicity

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, set_id string, length int, shard int"


def documents(spark, rows):
    """``(id, text)`` rows with further columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", 3, 1) for i, t in rows], DOC)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = word_list(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def varied(rng, text, changes):
    words = text.split()
    for k in rng.integers(0, len(words), changes):
        words[k] = f"v{rng.integers(1e6)}"
    return " ".join(words)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one  two"), (7, "a b c d e"), (8, "a b c d e f"), (8, "a b c d e f"), (None, "A B C D E F"), (None, None), (9, "é\u00a0x é y z w"), (10, "wörter " * 3000)]


def test_jaccard_edge_cases(spark):
    got = jaccard_join.ngram_jaccard_components(documents(spark, EDGES)).collect()
    assert Counter(tuple(r) for r in got) == components(EDGES)


def test_jaccard_empty_table(spark):
    assert jaccard_join.ngram_jaccard_components(documents(spark, [])).collect() == []


def test_jaccard_families_chains_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 400)  # many blocks and chunks
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(6):
        base = prose(rng, int(rng.integers(8, 120)))
        rows += [base] * 3 + [varied(rng, base, int(rng.integers(1, 6))) for _ in range(25)]
        chain = base
        for _ in range(8):
            chain = varied(rng, chain, 2)
            rows.append(chain)
    passage = prose(rng, 60)
    rows += [prose(rng, int(rng.integers(2, 40))) + " " + passage + " " + prose(rng, int(rng.integers(2, 40))) for _ in range(40)]
    order = rng.permutation(len(rows))
    rows = [(int(k), rows[r]) for k, r in enumerate(order)]
    got = jaccard_join.ngram_jaccard_components(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == components(rows)


def test_full_filters_and_clashing_digests_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", (6, 6))
    monkeypatch.setattr(jaccard_join, "SPLIT", 4)
    rng = np.random.default_rng(2)
    base = prose(rng, 80)
    rows = list(enumerate([varied(rng, base, int(rng.integers(0, 5))) for _ in range(30)] + [prose(rng, 50) for _ in range(10)] + ["", None]))
    want = components(rows)
    assert Counter(tuple(r) for r in jaccard_join.ngram_jaccard_components(documents(spark, rows)).collect()) == want

    def narrow(h, at):  # a first digest of three bits, so that most sets share theirs
        first, second = shingles.set_digests(h, at)
        return np.where(first == 0, 0, (first & 7) + 1), second

    def ids(h, at, clashes=np.zeros(0, np.int64)):
        first, second = narrow(h, at)
        return np.where(np.isin(first, clashes), second, first)

    monkeypatch.setattr(jaccard_join, "set_digests", narrow)
    monkeypatch.setattr(jaccard_join, "set_ids", ids)
    assert Counter(tuple(r) for r in jaccard_join.ngram_jaccard_components(documents(spark, rows)).collect()) == want


def test_rows_that_share_an_id_are_judged_by_themselves(spark):
    x, y, z = "a b c d e f g", "other words stand here alone", "third text of five words"
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, x), (5, x), (5, y), (7, z), (7, z), (7, z), (8, z), (None, y), (None, z), (9, near), (3, near + " end"), (3, x + " unlike all that"), (4, ""), (4, None), (4, "")]
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(documents(spark, rows)).collect())
    assert got == Counter([(1, x), (5, y), (7, z), (3, near + " end"), (3, x + " unlike all that"), (4, ""), (4, None), (4, "")])


def test_keep_one_of_each(spark):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "other words stand here alone"), (None, "no id"), (6, None)]
    kept = jaccard_join.keep_one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 5), (False, 6), (True, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab C\tÉé\n\x0b\u00a0😀", max_size=40)), max_size=8))
def test_shingles_count_as_python_does(texts):
    h, at = shingles.shingle_sets(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [len(shingle_set(t)) for t in texts]
    ids = shingles.set_ids(h, at)
    for a in range(len(texts)):
        for b in range(a):
            assert (ids[a] == ids[b]) == (shingle_set(texts[a]) == shingle_set(texts[b]))


def test_very_long_words_hash_whole(monkeypatch):
    monkeypatch.setattr(shingles, "_CHUNK", 64)
    long = "x" * 1000
    texts = [long + "a", long + "b", long + "a", "y " + long]
    h, at = shingles.shingle_sets(pa.array(texts))
    ids = shingles.set_ids(h, at)
    assert ids[0] == ids[2] and len({int(i) for i in ids}) == 3


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), min_size=1, max_size=120))
def test_bitmap_bound_is_never_below_the_overlap(a, b):
    x, y = (np.sort(shingles.mix(np.array(sorted(s), np.uint64))) for s in (a, b))
    bits = [np.frombuffer(jaccard_join.bitmap(t), np.uint8) for t in (x, y)]
    assert jaccard_join.overlap_bound(len(x), *bits) >= len(a & b)


# --- sharding


def check_shards(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(k, 0) for k in range(shards)), default=0) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_sharding_sizes_and_edges(spark):
    rows = EDGES + [(100 + k, f"text {k}") for k in range(90)] + [(300, "same")] * 40
    measured = sharding.measured(documents(spark, rows))
    got = sharding.shuffle_into_shards(measured, ["doc_id", "size", "text_crc32"]).collect()
    assert len(got) == len(rows)
    check_shards(got, 16)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    again = sharding.shuffle_into_shards(measured, ["doc_id", "size", "text_crc32"]).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))  # a task run again deals the same


def test_sharding_deals_equal_rows_out(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.shuffle_into_shards(sharding.measured(same), ["doc_id", "size", "text_crc32"], shards=3, rows_per_block=10).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(v) for v in slots.values()) == [1333, 1333, 1334]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_empty(spark):
    assert sharding.shuffle_into_shards(sharding.measured(documents(spark, [])), ["doc_id", "size", "text_crc32"]).collect() == []


@pytest.mark.parametrize("rows", [[5, 0, 7, 3], [0, 0], [1000, 1, 999]])
def test_communication_matrix_sums(rows):
    shards = sharding.shard_sizes(sum(rows), 4)
    m = sharding.communication_matrix(rows, shards, seed=5)
    assert m.sum(1).tolist() == rows and m.sum(0).tolist() == shards


def test_communication_matrix_has_hypergeometric_means():
    m = np.mean([sharding.communication_matrix([300, 700], [250, 250, 500], seed=s) for s in range(400)], 0)
    assert np.allclose(m, [[75, 75, 150], [175, 175, 350]], atol=1.5)


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(0)
    draws = [sharding._hypergeometric(rng, 10**9, 3 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(draws) - 250) < 3 and 10 < np.std(draws) < 18


# --- decontamination


def brute_decontaminate(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(pattern, (t or "").translate(LOWER))
    grams = {}
    for item, text in items:
        w = words(text)
        for k in range(len(w) - 9) if len(w) >= 10 else range(bool(w)):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for g, own in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= own
        import hashlib

        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(k, prose(rng, n, 60)) for k, n in enumerate([30, 10, 9, 3, 12])] + [(10, None), (11, "!!"), (12, "Über-ZEUGT 7"), (13, prose(rng, 30, 60))]
    items.append((14, items[0][1]))
    docs = [(1, None), (2, ""), (3, "..."), (4, "x " + items[0][1].upper() + " y"), (5, items[1][1].replace(" ", "--")), (6, "a " + items[3][1]), (7, items[2][1] + " " + items[2][1]), (8, "über zeugt 7"), (8, "über zeugt 7"), (None, items[4][1])]
    docs += [(20 + k, prose(rng, 200, 60)) for k in range(5)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.decontaminate(documents(spark, docs), bench)
    assert Counter(tuple(r) for r in got.collect()) == brute_decontaminate(docs, items)
    clean = {r[0] for r in brute_decontaminate(docs, items) if not r[5]}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(documents(spark, docs), bench).collect()} == clean


def test_decontamination_of_long_texts_and_large_benchmarks(spark, monkeypatch):
    """Texts of many pieces with windows over every seam, and a benchmark held against the texts in several scans."""
    monkeypatch.setattr(decontaminate, "PIECES", (64, 16, 8))
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 40)
    rng = np.random.default_rng(13)
    items = [(k, prose(rng, n, 500)) for k, n in enumerate([30, 10, 9, 3, 25, 1])]
    docs = [(1, None), (2, " ".join(prose(rng, 5, 500) + " " + items[k % 5][1] for k in range(60)))]
    docs += [(10 + k, prose(rng, k, 500) + " " + items[0][1]) for k in range(0, 70)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(documents(spark, docs), bench)
    assert Counter(tuple(r) for r in got.collect()) == brute_decontaminate(docs, items)
    monkeypatch.undo()
    long = " ".join(f"w{k % 977}" for k in range(1_000_000)) + " " + items[0][1]
    got = decontaminate.decontaminate(documents(spark, [(1, long), (2, "x")]), bench.where("item_id = 0")).collect()
    assert {(r["doc_id"], r["n_words"], r["n_hit"]) for r in got} == {(1, 1_000_030, 30), (2, 1, 0)}


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(documents(spark, EDGES[:8]), none).collect()
    assert len(got) == 8 and not any(r["contaminated"] for r in got)
    assert decontaminate.decontaminate(documents(spark, []), none).collect() == []


# --- licences


def test_license_variants_match(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace(",", " ").replace("Software", '"software"')), (3, mit + " and more"), (4, None), (5, " \n"), (6, "RELEASED under the MIT Licence"), (6, "RELEASED under the MIT Licence")]
    known = spark.createDataFrame(licenses.KNOWN, "license_id string, text string")
    got = licenses.scan_licenses(documents(spark, rows), known).collect()
    assert Counter((r["doc_id"], r["license_id"]) for r in got) == Counter([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT-notice"), (6, "MIT-notice")])
    assert all(r["digest"] is None for r in got if r["doc_id"] in (4, 5))
    assert licenses.scan_licenses(documents(spark, []), known).collect() == []


def test_copyright_lines_and_neighbouring_spellings():
    form = lambda t: licenses.canonical(t).decode()
    claims = ["Copyright (c) 2020 Foo", "Copyright 2020 Foo", "(c) 2012 Bar", "© Foo", "Copyright Foo Inc. and contributors", "Copyright <YEAR> <HOLDER>", "COPYRIGHT (C) 1999 FOO", "# Copyright [yyyy] [name]", "All rights reserved.", "Portions Copyright: 2001 by Foo"]
    assert [form(f"a\n{c}\nb") for c in claims] == ["a b"] * len(claims)
    prose = ["copyright notice and this permission notice appear", "COPYRIGHT HOLDERS BE LIABLE", "(c) You must retain", "copyright license to reproduce", "All rights reserved by none"]
    assert all(len(form(f"a\n{p}\nb").split()) == len(form(p).split()) + 2 > 4 for p in prose)
    assert form("Licence, licence; LICENCE per cent per cent noncommercial") == "license license license percent percent non commercial"
    isc = dict(licenses.KNOWN)["ISC"]
    import textwrap

    assert {licenses.digest("ISC License\n\nCopyright (c) 2020, Foo\n\n" + textwrap.fill(isc, w)) for w in range(30, 120)} == {licenses.digest("ISC License " + isc)}
    assert len(licenses.canonical("word, " * 1_000_000)) == 5_000_000 - 1


def test_license_sql_has_the_same_digests(spark, sf_dir, tmp_path):
    import duckdb

    texts = ["Licence, licence\nCopyright (c) 2020 Foo\r\nAll rights reserved.\nper cent per cent", "copyright notice and\nCOPYRIGHT HOLDERS", "É Ä straße", "", None, "!!", "(c) You must\n© me", "it's per cent of non-commercial noncommercial"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute("SELECT doc_id, digest, license_id FROM (" + licenses.OP7_SQL + ")").fetchall()}
    got = {r["doc_id"]: (r["digest"], r["license_id"]) for r in licenses.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == want


# --- toxicity


def maximal_by_definition(scores):
    """Greedy definition: the best segment (shortest on ties), then left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and b + 1 - a < best[1] - best[0])):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    return maximal_by_definition(scores[:a]) + [best] + [(x + b, y + b, s) for x, y, s in maximal_by_definition(scores[b:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -2.0, -1.0, 1.5, 2.25, 4.0]), max_size=14))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in maximal_by_definition(scores)))
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    assert max((s for _, _, s in got), default=0) == pytest.approx(max((s for _, _, s in maximal_by_definition(scores)), default=0))


def test_toxicity_learns_and_generalises(spark):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for k in range(400):
        words = prose(rng, int(rng.integers(5, 120)), 3000).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[int(rng.integers(len(words)))] = rng.choice(["vileness", "vilest", "scorned", "grubworm"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic), "x"))
    docs += [(900, None), (901, ""), (902, "vilely said, grubworm and vilest " + prose(rng, 30)), (902, "vilely said, grubworm and vilest " + prose(rng, 30)), (None, "12 34")]
    truth = spark.createDataFrame(labels + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(documents(spark, docs), truth.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    scores = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, docs), model).collect()}
    unseen = [k for k in range(1, 400, 2)]
    assert np.mean([(scores[k]["score"] >= 0.7) == (k % 5 == 0) for k in unseen]) > 0.97
    assert scores[902]["score"] > 0.7 and scores[900]["score"] == scores[901]["score"] < 0.2
    text = docs[402][1]
    assert any("vil" in text[p["start"] : p["end"]] for p in scores[902]["passages"])
    left = toxicity.drop_toxic(documents(spark, docs), model)
    assert left.columns == documents(spark, []).columns and 902 not in {r["doc_id"] for r in left.collect()}


def test_toxicity_scores_by_hand(spark):
    """Scores from a given model, by the definition of maximal segments and the calibration's formula."""
    model = toxicity.Model({"vile": 3.0, "bad": 1.25, "kind": -2.0}, {"grub": 2.5, "grubworm"[:7]: 3.5}, rate=1.1, scale=0.05, slope=1.7, intercept=-3.0)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["vile", "bad", "kind", "grubs", "grubworms", "neutral", "Vile!", "12"], int(rng.integers(1, 14)))) for _ in range(60)]
    texts += ["vile " * 3 + "neutral " * 30_000 + "bad vile"]  # long: found at its end, too
    odds = {"vile": 3.0, "bad": 1.25, "kind": -2.0, "grubs": 2.5, "grubworms": 3.5, "neutral": 0.0}

    def by_hand(text):
        words = re.findall(r"[a-z]+", text.lower())
        scores = [odds[w] - 0.5 for w in words]
        runs = maximal_by_definition(scores) if len(scores) < 20 else [(0, 3, 7.5), (30_003, 30_005, 3.25)]
        evidence = [1.1 * s - np.log(0.05 * len(words)) for _, _, s in runs]
        x = -3.0 + 1.7 * np.sqrt(sum(e for e in evidence if e >= 1.0))
        return (1 / (1 + np.exp(-x)) if words else 1 / (1 + np.exp(3.0))), sum(e >= 1.0 for e in evidence)

    rows = documents(spark, list(enumerate(texts)))
    for r in toxicity.score_documents(rows, model).collect():
        value, passages = by_hand(texts[r["doc_id"]])
        assert r["score"] == pytest.approx(value, abs=1e-9) and len(r["passages"]) == passages
    left = {r["doc_id"] for r in toxicity.drop_toxic(rows, model).collect()}
    assert left == {k for k, t in enumerate(texts) if by_hand(t)[0] < 0.7}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, EDGES), none)
    assert {r["score"] for r in toxicity.score_documents(documents(spark, EDGES), model).collect()} == {0.0}
    assert toxicity.score_documents(documents(spark, []), model).collect() == []


# --- packing


def check_packing(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


@pytest.mark.parametrize("cache", [3, 100_000])
@pytest.mark.parametrize("name", sorted({packing.TOKENIZER, *(f.name for f in Path(packing.tokenizer_path()).parent.glob("*.json"))}))
def test_ids_are_the_tokenizers_own(monkeypatch, name, cache):
    ids = packing.WordIds(packing.tokenizer_path(name))
    assert ids.by_words or name != packing.TOKENIZER
    monkeypatch.setattr(packing, "CACHE", cache)
    rng = random.Random(3)
    signs = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xC0, 0x100)), *"\t\n\r\x0b\x0c\x1c\x85 \xa0", *"'sre'll²½µΣς", "<|", "</w>", " the ", "don't"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(15)))
        assert ids(text) == ids.whole(text).tobytes(), repr(text)
    assert len(ids.known) <= cache or not ids.by_words


def test_packing_pieces_and_offsets(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    odd = ["It's 1990; they're “fine” <|endoftext|> now", "a\u0301b ΑΣ Σ", "x\u2003y×z÷ İstanbul", "tab\tand\x0bmore\x1cend", "日本 語 😀"]
    rows = EDGES + [(50 + k, t) for k, t in enumerate(odd)] + [(100 + k, prose(rng, int(rng.integers(1, 900)))) for k in range(60)] + [(200, "same text here")] * 70
    got = packing.pack_documents(documents(spark, rows), path).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert check_packing(got, 2048) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack_documents(documents(spark, []), path).collect() == []


def planned(counts, capacity):
    """The lengths in each sequence, with their offsets, read off the plan piece by piece."""
    n, places = packing.plan(counts, capacity)
    out = {}
    for value, (low, base, each, start) in places.items():
        assert low[0] == 0
        for rank in range(counts[value]):
            at = int(np.searchsorted(low, rank, side="right")) - 1
            inside = rank - int(low[at])
            out.setdefault(int(base[at]) + inside // int(each[at]), []).append((int(start[at]) + inside % int(each[at]) * value, value))
    assert sorted(out) == list(range(n))
    return out


def best_fit_by_definition(counts, capacity):
    """Piece by piece: the sequence with the smallest weighted residual norm among those with room."""
    bound = np.array([capacity.tokens, capacity.documents, capacity.cost])
    bins = []
    for value in sorted(counts, reverse=True):
        demand = np.array([value, 1, value * value])
        for _ in range(counts[value]):
            room = [(float((((left - demand) / bound) ** 2 * capacity.weights).sum()), k) for k, left in enumerate(bins) if (left >= demand).all()]
            if room:
                bins[min(room)[1]] -= demand
            else:
                bins.append(bound - demand)
    return len(bins)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20), st.sampled_from([(64, 64, 4096, (1.0, 0.0, 0.0)), (64, 64, 4096, packing.WEIGHTS), (64, 5, 4096, (1.0, 0.2, 0.0)), (64, 64, 1500, (1.0, 0.0, 0.5))]))
def test_plan_respects_every_capacity(counts, limits):
    tokens, docs, cost, weights = limits
    capacity = packing.Capacity(tokens, docs, cost, weights)
    used, found = Counter(), planned(counts, capacity)
    for parts in found.values():
        at = 0
        for offset, value in sorted(parts):
            assert offset == at
            at += value
        lengths = [v for _, v in parts]
        assert at <= tokens and (len(lengths) == 1 or (len(lengths) <= docs and sum(v * v for v in lengths) <= cost))
        used.update(lengths)
    assert used == Counter(counts)
    if cost == 4096:
        assert len(found) <= 1.03 * best_fit_by_definition(counts, capacity) + 1


def test_weights_and_capacities_change_the_packing(spark):
    rng = np.random.default_rng(6)
    rows = documents(spark, [(k, prose(rng, int(rng.integers(1, 700)), 50)) for k in range(150)])
    path = packing.tokenizer_path()

    def packed(**limits):
        got = packing.pack_documents(rows, path, packing.Capacity(**limits)).collect()
        check_packing(got, 2048)
        groups = {}
        for r in got:
            groups.setdefault(r["sequence_id"], []).append(r["length"])
        return sorted(map(sorted, groups.values()))

    usual, tokens, few, cheap = packed(), packed(weights=(1.0, 0.0, 0.0)), packed(documents=2), packed(cost=2048 * 700)
    assert usual != tokens and len(usual) <= 1.01 * len(tokens) + 1
    assert max(map(len, few)) <= 2 < max(map(len, usual)) and len(few) > len(usual)
    assert all(len(g) == 1 or sum(v * v for v in g) <= 2048 * 700 for g in cheap) and len(cheap) > len(usual)
