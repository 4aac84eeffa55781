"""Edge cases and brute-force versions of the operators on pages and vectors, and of the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinlake.llm import embedding_dedup, html_extract, url_rules, warc
from kinlake.session import new_path

PAGE = "page_id long, url string, html string, payload_bytes string, record_type int, n_chars int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], PAGE)


# --- HTML


def test_extraction_on_generated_pages():
    rng, wrong, total = random.Random(123), 0, 0
    weights, words = html_extract.trained(), html_extract._Words()
    for _ in range(200):
        page, labels = html_extract.training_page(rng)
        blocks = html_extract.blocks_of(page)
        assert len(blocks) == len(labels)
        z = html_extract._scores([blocks], weights, words)[0] if blocks else np.zeros(0)
        wrong += int(((z > 0) != np.array(labels)).sum())
        total += len(labels)
    assert wrong / total < 0.02


def test_extraction_of_the_driver_pages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in table.collect()}
    import html as entities

    good = 0
    for r in html_extract.op3_html_extract(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"</?b>|<br>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", article))
        good += r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])
    assert good >= 0.98 * len(html)


def test_extraction_edge_cases(spark):
    article = "<article><h1>A &amp; B</h1><p>One&nbsp;two<br>three\n four.</p><script>if (a<b) x()</script><p>Five &lt;six&gt;</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all, just a sentence that stands here"), (4, "u", "<html><body>" + article + "<footer>&copy; me</footer>"), (4, "u", "<html><body>" + article + "<footer>&copy; me</footer>"), (5, "u", "<p"), (6, "u", "<script>var x = 1;"), (None, "u", "<style>p{}</style>")]
    got = html_extract.extract_text(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[6] == by[None] == ""
    assert by[4] == "A & B\nOne two three four.\nFive <six>"
    assert html_extract.extract_text(pages(spark, [])).collect() == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html_extract.trained().items()}
    x = rng.normal(size=(4, 2, html_extract.INPUT))
    target = rng.normal(size=(4, 2, html_extract.HIDDEN))

    def loss(weights):
        return float((html_extract._forward(x, weights, "f").astype(float) * target).sum())

    out, kept = html_extract._forward(x, w, "f", keep=True)
    grads = html_extract._backward(target, x, kept, w, "f")
    for name in ("xf", "hf", "bf"):
        at = tuple(rng.integers(s) for s in w[name].shape)
        more, less = ({**w, name: w[name].copy()} for _ in range(2))
        more[name][at] += 1e-2
        less[name][at] -= 1e-2
        assert grads[name][at] == pytest.approx((loss(more) - loss(less)) / 2e-2, rel=0.05, abs=5e-3)


def test_long_and_deep_pages_in_bounded_memory(monkeypatch):
    import resource

    rng, weights, words = random.Random(5), html_extract.trained(), html_extract._Words()
    short = [html_extract.training_page(rng)[0] for _ in range(63)]
    alone = [html_extract.extract([p], weights, words)[0] for p in short]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = html_extract.extract(["<p>a</p>" * 200_000, *short], weights, words)
    assert got[1:] == alone and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10
    html_extract.extract(["<div>" * 50_000 + "x" + "</p>" * 50_000 + "<li>a</li>" * 1000], weights, words)
    blocks = [html_extract.blocks_of(p) for p in short[:9]]
    whole = html_extract._scores(blocks, weights, words)
    monkeypatch.setattr(html_extract, "CELLS", 20)
    for a, b in zip(whole, html_extract._scores(blocks, weights, words), strict=True):
        assert a == pytest.approx(b, abs=1e-4)


def test_pages_are_grouped_by_bytes():
    sizes = [10, 0, 5_000_000, 1, 1, 9_000_000, 2] + [1] * 300
    groups = list(html_extract.page_groups(pa.array([None if n == 0 else "x" * n for n in sizes])))
    assert [k for lo, hi in groups for k in range(lo, hi)] == list(range(len(sizes)))
    assert all(hi - lo <= 256 and (hi - lo == 1 or sum(sizes[lo:hi]) <= html_extract.HTML_BYTES) for lo, hi in groups)


# --- WARC


def test_archives_read_back(spark):
    big = "<p>ä</p>" * 400_000
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "x" * 100), (4, "u", "x" * 100), (5, "u", "y" * 99), (6, "u", "y" * 99), (7, "u", big), (8, "u", big), (9, "u", "z\r\n\r\nWARC/1.1\r\n" * 20), (3, "u", "x" * 100)]
    folder = new_path(spark, "warc-test")
    chunks = warc.read_chunks(warc.archive_pages(pages(spark, rows), folder), folder).collect()
    last = [r for r in chunks if r["last"]]
    body = lambda h: (h or "").encode()
    digest = lambda h: hashlib.sha256(body(h)).hexdigest()
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    want = Counter()
    for i, _, h in rows:
        again = len(body(h)) >= 100 and i != first[h]
        want[(i, len(body(h)), digest(h), "revisit" if again else "response", first[h] if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in last) == want
    parts = sorted((r["chunk"], bytes(r["data"])) for r in chunks if r["page_id"] == 7)
    assert len(parts) > 2 and max(len(d) for _, d in parts) <= warc.CHUNK and b"".join(d for _, d in parts) == big.encode()


def test_many_repeats_are_joined_alike(spark, sf_dir):
    rows = [(i, "u", h) for i, h in [(1, "x" * 100), (2, "x" * 100), (2, "x" * 100), (None, "x" * 100), (3, "y" * 200), (4, "y" * 200), (5, "z" * 300), (6, None), (None, "w" * 150), (None, "w" * 150)]]
    few, many = (Counter(map(tuple, warc.classify(pages(spark, rows), broadcast_rows=n).collect())) for n in (100, 0))
    assert few == many and sum(few.values()) == len(rows)
    assert all((r[1] is None) == (r[4] == "revisit" or r[0] == 6) for r in few)


def test_archives_of_an_empty_table(spark):
    folder = new_path(spark, "warc-test")
    assert warc.read_chunks(warc.archive_pages(pages(spark, []), folder), folder).collect() == []


# --- URLs


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["https://Example.COM/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/q?x#y", "http://example.com", "http://b.com/en/", "ftp://x.net/es/1", "http://net/fr/", "x.net/fr/", None, "", "http://notexample.com/en/z", "http://a.net?q=/es/", "http://a.net/es", "http://é.org/#f", "http://q.org/a\nb?c", "a://b://c/d"]


def test_explicit_rules(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] + [(0, URLS[0], None)]
    none = spark.createDataFrame([], "url string, block boolean")
    got = url_rules.filter_urls(pages(spark, rows), none).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter((i, *brute_rule(u)[:3], brute_rule(u)[3] or "allow") for i, u, _ in rows)
    assert url_rules.filter_urls(pages(spark, []), none).collect() == []


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(3)
    hosts, steps, marks = ["a.org", "b.org", "c.edu"], ["buy", "news", "win"], ["", "?ref=x", "?page=2"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(steps)}/{rng.randint(1, 99)}{rng.choice(marks)}" for _ in range(300)]
    bad = lambda u: ("b.org" in u and "/win/" in u) or ("/buy/" in u and "ref=x" in u and rng.random() < 0.9)
    labelled = [(u, bad(u)) for u in urls]
    frame = spark.createDataFrame(labelled, "url string, block boolean")
    tokens = {r["url"]: frozenset(r["t"]) for r in frame.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    rules = [(frozenset(r["tokens"]), r["confidence"]) for r in url_rules.mine_rules(frame).collect()]
    assert rules
    for own, confidence in rules:
        covered = [b for u, b in labelled if own <= tokens[u]]
        assert confidence == pytest.approx(sum(covered) / len(covered)) and confidence >= url_rules.MIN_CONFIDENCE
        assert not any(other < own and c >= confidence for other, c in rules)
    got = {r["url"] for r in url_rules.matched_urls(frame, url_rules.mine_rules(frame)).collect()}
    assert got == {u for u in tokens if any(own <= tokens[u] for own, _ in rules)}
    assert {u for u in tokens if "b.org" in u and "/win/" in u} <= got


# --- vectors


def brute_vectors(rows):
    unit = []
    for i, v, label in rows:
        ok = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, n[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _, _) in enumerate(rows))


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(12):
        centre = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), (centre + rng.normal(size=32) * rng.choice([0.02, 0.08, 0.12])).astype(np.float32).tolist(), int(k % 3)))
    rows += [(1000, rows[0][1], rows[0][2])] * 3 + [(1001, [2 * x for x in rows[0][1]], rows[0][2]), (None, rows[0][1], rows[0][2]), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 32, 1), (1005, [float("nan")] + [1.0] * 31, 1), (1006, [None] + [1.0] * 31, 1), (1007, [], 1), (1008, [1.0, 0.0], 1), (1009, [1.0, 0.0], 1), (1010, [float("inf")] * 32, 1)]
    frame = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, root string")
    got = embedding_dedup.near_duplicates(frame).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == brute_vectors(rows)


def test_vectors_in_double_precision(spark):
    near = [1.0, 0.2030599]  # cosines on both sides of 0.98, told apart in double precision only
    rows = [(1, [1e-60, 0.0], 1), (2, [1e300, 0.0], 1), (3, [1e-310, 1e-312], 1), (4, [0.0, -0.0], 1), (5, [1.0, 1e-12], 1), (6, [1.0, 2e-12], 1), (7, near, 2), (8, [1.0, 0.0], 2), (9, [float("inf"), 0.0], 1), (10, [1.0, 0.2030587], 3), (11, [1.0, 0.0], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    cos = lambda v: 1 / np.hypot(1.0, v)
    assert len(got) == len(rows) and {got[i] for i in (1, 2, 3, 5, 6)} == {(4, 1)}
    assert got[4] == (0, 4) and got[9] == (0, 9)
    assert got[7][0] == int(cos(near[1]) >= 0.98) and got[10][0] == int(cos(0.2030587) >= 0.98)


def planted_vectors(n, dim=64, seed=9):
    """``n`` random vectors of one label, a fifth of them copies moved to cosines of 0.98 to 1, and a crowd of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = n // 5
    y = rng.normal(size=(m, dim))
    y -= (x[:m] * y).sum(1)[:, None] * x[:m]
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = rng.uniform(0.98, 1.0, m)[:, None]
    x[m : 2 * m] = c * x[:m] + np.sqrt(1 - c * c) * y
    crowd = x[0] + rng.normal(size=(n // 20, dim)) * 0.005
    x[2 * m : 2 * m + len(crowd)] = crowd
    return x.astype(np.float32)


def test_tree_keeps_the_links_and_cuts_the_work(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "LEAF", 128)
    x = planted_vectors(4000)
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.98
    want = linked.sum(1) - 1
    assert all(got[k] <= want[k] for k in got)  # no link is made up or counted twice
    assert sum(got.values()) >= 0.99 * want.sum()
    # recall of the pairs that cuts let meet, and how many pairs meet at all
    tree, places = embedding_dedup.Tree(), unit @ embedding_dedup.directions(64)
    tree.grow(places, 1.0)
    meeting, kept = 0, np.zeros((len(x), len(x)), dtype=np.int8)
    for _, rows, bits in tree.leaves(places):
        free = (bits[:, None] & bits[None, :]) == 0
        meeting += int(free.sum())
        kept[np.ix_(rows, rows)] += free
    assert kept.max() == 1 and kept[linked].mean() >= 0.99
    assert meeting < 0.35 * len(x) ** 2


def test_vectors_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_calibrated_count_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    d = embedding_dedup.directions(64)
    hits = (np.abs(a @ d - near @ d) <= embedding_dedup.WINDOW).sum(1)
    assert (hits >= embedding_dedup.least_collisions()).mean() > 0.998


# --- the pipeline


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline
    from kinlake.llm import toxicity
    from kinlake.session import table

    from .test_text_operators import brute_decontaminate, components

    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    model = toxicity.fit(table(spark, sf_dir, "documents"), toxicity.training_labels(spark, sf_dir))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(table(spark, sf_dir, "documents"), model).collect()}
    left = [(i, t) for i, t in docs if scores[i] < 0.7]
    first = {i for i, _, c in components(left) if i == c}
    left = [(i, t) for i, t in left if i in first]
    bad = {r[0] for r in brute_decontaminate(left, items) if r[5]}
    want = {i for i, _ in left if i not in bad}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == want
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontaminate", "packing"]
