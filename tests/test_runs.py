"""Runs, models, sources, streaming, documents and reports on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlake import registry
from kinlake.functions.similarity import jaro_winkler_value, score_pairs
from kinlake.operators import blocking, budget, metrics, retriever, segment, supervised, truth
from kinlake.plans import pipeline
from kinlake.plans.pipeline import Config, resolve
from kinlake.sources import csv, sinks
from kinlake.streaming.incremental import IncrementalResolver

TOY = [(0, "Acme Corp", "Berlin", "a"), (1, "ACME Corp ", "berlin", "a"), (2, "Acme Corp.", None, "a"), (3, "Globex", "Paris", "b"), (4, "globex", " paris", "b"), (5, "Initech", "Rome", None)]


def toy(spark):
    return spark.createDataFrame(TOY, "rid long, name string, city string, truth string")


FIELDS = {"name": "jw", "city": "jw"}


@pytest.mark.parametrize(("method", "cluster"), [("threshold", "tc"), ("threshold", "center"), ("threshold", "mc"), ("threshold", "hc"), ("gc", "tc")])
def test_toy_runs_find_the_entities(spark, method, cluster):
    result = resolve(toy(spark), Config(FIELDS, block_method="none", classify_method=method, cluster_method=cluster, threshold=0.8, truth_col="truth"))
    labels = {r["rid"]: r["label"] for r in result.labels.collect()}
    assert labels[0] == labels[1] == labels[2] and labels[3] == labels[4] and len(set(labels.values())) == 3
    q = result.quality.first()
    assert q["ari"] == q["pair_f1"] == q["b3_f1"] == pytest.approx(1.0) and q["n_truth"] == 5


def test_truth_is_no_match_field_and_names_are_checked(spark):
    assert Config({"name": "lv", "truth": "lv"}, truth_col="truth").fields == {"name": "lv"}
    with pytest.raises(ValueError):
        Config({"truth": "lv"}, truth_col="truth")
    with pytest.raises(ValueError, match="cluster"):
        Config(FIELDS, cluster_method="nothing")
    with pytest.raises(ValueError, match="truth"):
        resolve(toy(spark), Config(FIELDS, block_method="none", classify_method="lda"))
    assert "Config(" in pipeline.script(Config(FIELDS))


def entities(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(n):
        name = "".join(rng.choice(list("abcdefghijklmnop"), 10))
        for k in range(3):
            x = list(name)
            if k:
                x[int(rng.integers(10))] = "z"
            rows.append((3 * e + k, "".join(x), f"city{e % 7}", f"e{e}"))
    return spark.createDataFrame(rows, "rid long, name string, city string, truth string")


@pytest.mark.parametrize("name", sorted(registry.MODELS))
def test_pair_models_separate_entities(spark, name):
    r = entities(spark)
    result = resolve(r, Config({"name": "lv"}, block_method="standard", block_key="city", classify_method=name, truth_col="truth", held_out=True, max_pairs=None))
    assert result.quality.first()["pair_f1"] > 0.9 and not [w for w in result.warnings if "train" in w]


def test_too_little_truth_falls_back_to_the_threshold(spark):
    few = toy(spark).withColumn("truth", F.when(F.col("rid") < 4, F.col("truth")))
    result = resolve(few, Config(FIELDS, block_method="none", classify_method="logistic", threshold=0.8, truth_col="truth"))
    assert any("train" in w for w in result.warnings) and result.links.count() == 4


def test_logistic_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.random((80, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0.5).astype(int)
    frame = spark.createDataFrame([(k, k + 1000, float(a), float(b), int(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i long, j long, s1 double, s2 double, y int")
    p = np.array([r["p"] for r in supervised.logistic(frame, ["s1", "s2"])(frame).orderBy("i").collect()])
    w = np.linalg.lstsq(np.c_[x, np.ones(80)], np.log(p / (1 - p)), rcond=None)[0]
    gradient = np.c_[x, np.ones(80)].T @ (p - y) + np.array([w[0], w[1], 0])
    assert np.abs(gradient).max() < 1e-4


def test_jaro_winkler_known_values():
    for a, b, want in [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("dwayne", "duane", 0.84), ("abc", "xyz", 0.0), ("é", "é", 1.0), ("jellyfish", "smellyfish", 0.8963)]:
        assert jaro_winkler_value(a, b) == pytest.approx(want, abs=2e-4)


def test_missing_fields_are_left_out(spark):
    rows = spark.createDataFrame([(0, "ab", None), (1, "ab", "x"), (2, None, None)], "rid long, a string, b string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "i long, j long")
    got = {(r["i"], r["j"]): (r["score"], r["s_b"]) for r in score_pairs(pairs, rows, {"a": "lv", "b": "jw"}).collect()}
    assert got == {(0, 1): (1.0, None), (0, 2): (0.0, None), (1, 2): (0.0, None)}


def test_hot_blocks_are_split_without_losing_pairs(spark):
    keys = spark.createDataFrame([(k, "hot" if k % 3 else "cold") for k in range(60)], "rid long, key string")
    got = sorted(tuple(r) for r in blocking.pairs_within(keys, split=7).collect())
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if bool(a % 3) == bool(b % 3))
    assert got == want


def test_guards_refuse_before_any_pair_is_made(spark):
    with pytest.raises(blocking.PairBudgetExceeded):
        blocking.block_all(entities(spark), max_pairs=100)
    with pytest.raises(blocking.PairBudgetExceeded):
        blocking.block_standard(entities(spark), "city", max_pairs=10)


def test_canopies_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    edges = [(i, j, float(cos[i, j])) for i in range(30) for j in range(i + 1, 30)]
    gone, want = set(), set()
    for i in range(30):
        if i in gone:
            continue
        members = sorted({i} | {j for j in range(30) if j != i and cos[i, j] >= 0.5})
        want |= {(a, b) for k, a in enumerate(members) for b in members[k + 1 :]}
        gone |= {j for j in range(30) if j != i and cos[i, j] >= 0.7}
    frame = spark.createDataFrame(edges, "i long, j long, cos double")
    assert {tuple(r) for r in blocking.canopies(frame, spark.range(30).withColumnRenamed("id", "rid"), 0.7, 0.5).collect()} == want


def test_capped_sample_against_brute_force(spark):
    rows = [(k, f"e{k % 9}" if k % 4 else "big") for k in range(80)] + [(99, None)]
    frame = spark.createDataFrame(rows, "rid long, truth string")
    sizes = [(r["truth"], r["n"]) for r in frame.where("truth IS NOT NULL").groupBy("truth").agg(F.count("*").alias("n")).orderBy(truth.shuffled(42, "truth"), "truth").collect()]
    taken, total = set(), 0
    for t, n in sizes:
        if total + n > 30 and taken:
            continue
        taken.add(t)
        total += n
        if total >= 30:
            break
    assert {r["truth"] for r in truth.cluster_sample_capped(frame, 30).collect()} == taken


def test_pairs_file_truth(spark):
    ids = spark.range(6).withColumnRenamed("id", "rid")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 9), (4, 4)], "a long, b long")
    assert {r["rid"]: r["truth"] for r in truth.from_pairs(ids, pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: None, 4: None, 5: None}


def test_labels_file_last_line_wins(spark):
    ids = spark.createDataFrame([(" a",), ("b",), ("c",)], "id string")
    labels = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a ", "3", 2), ("c", " ", 3)], "k string, cluster string, line int")
    assert {r["id"]: r["truth"] for r in truth.from_labels(ids, labels, "id", "k", "cluster", "line").collect()} == {" a": "3", "b": "2", "c": None}


def test_quality_of_trivial_and_equal_partitions(spark):
    frame = lambda rows: spark.createDataFrame(rows, "rid long, truth long, label long")
    assert metrics.quality(frame([(0, 0, 5), (1, 0, 5), (2, 1, 6)])).first()["ari"] == pytest.approx(1.0)
    one = metrics.quality(frame([(0, 0, 0), (1, 0, 0)])).first()
    assert one["ari"] == 0.0 and one["pair_f1"] == 1.0
    assert metrics.quality(frame([(0, 0, 0)])).isEmpty() and metrics.quality(frame([(0, None, 0), (1, None, 1)])).isEmpty()


def test_retriever_learns_from_duplicates(spark):
    r = entities(spark, 40, seed=5)
    gold = truth.gold_pairs(r.select("rid", "truth"))
    pairs, k = retriever.block_embed(r.select("rid", F.col("name").alias("text")), "text", 300, gold)
    assert k == 5 and pairs.where("i >= j").isEmpty()
    assert budget.completeness(pairs, gold).first()["pc"] > 0.8


def test_budget_lab_arms_share_their_budget(spark):
    r = entities(spark, 40, seed=6)
    grid, perm = pipeline.budget_lab(r.select("rid", F.col("name").alias("text")), truth.from_column(r, "truth"), replicates=3, ks=(2, 4))
    rows = grid.collect()
    assert len(rows) == 10 and all(0 <= x["pc"] <= 1 for x in rows)
    assert perm["k_star"] in (2, 4) and 0 < perm["p"] <= 1 and perm["verdict"] in ("dead", "weak", "alive") and len(perm["null"]) == 3


def test_reports_and_plans_agree(spark):
    r = entities(spark, 20)
    config = Config({"name": "lv"}, block_method="standard", block_key="city", truth_col="truth")
    row = pipeline.blocking_report(r, config).first()
    assert row["n_candidate_pairs"] == pipeline.plan(r, config) and row["pair_completeness"] == 1.0
    sn = Config({"name": "lv"}, block_method="sn", block_key="name", window=5)
    assert pipeline.blocking_report(r, sn).first()["n_candidate_pairs"] == pipeline.plan(r, sn)


# --- sources


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited_text(spark, sep):
    text = sep.join(["id", "name", ""]) + "\n" + sep.join(["1", '"a ""q"" b"', "x"]) + "\n" + sep.join(["", " ", ""]) + "\n2\n"
    got = csv.read_text(spark, text)
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [("1", 'a "q" b'), ("2", "")]


def test_files_are_sniffed(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id;name\n1;"two\nlines, one cell"\n;\n2;x\n')
    got = csv.read_files(spark, f"file://{tmp_path}/t.csv")
    assert sorted(tuple(r) for r in got.collect()) == [("1", "two\nlines, one cell"), ("2", "x")]


def test_links_are_rewritten_and_checked():
    assert csv.rewrite_link("github.com/o/r/blob/main/a.csv") == "https://raw.githubusercontent.com/o/r/main/a.csv"
    assert csv.rewrite_link("https://gist.github.com/o/0a1b/") == "https://gist.github.com/o/0a1b/raw"
    with pytest.raises(csv.SourceError):
        csv.rewrite_link("ftp://x/y")


def test_sinks(spark, tmp_path):
    r = toy(spark)
    labels = r.select("rid", (F.col("rid") % 2).alias("label"))
    sinks.write_labelled(r, labels, f"file://{tmp_path}/out")
    back = spark.read.csv(f"file://{tmp_path}/out", header=True)
    assert back.columns[0] == "cluster" and back.count() == 6
    assert sinks.csv_base64(labels.limit(2)) and json.loads(sinks.result_json(None, metrics.cluster_sizes(labels), {}, ["w"]))["cluster_sizes"] == [3, 3]


# --- documents


def brute_sections(text):
    """By the rule: blank lines part blocks; header lines that open a block give its title (the
    last one), a block of headers alone titles the next; the first of several is the document's."""
    import itertools
    import re

    def header(line):
        return len(line) < 60 and re.fullmatch(segment.HEADER.strip("^$"), line) is not None

    stripped = [line.strip() for line in text.split("\n")]
    blocks = [list(lines) for full, lines in itertools.groupby(stripped, key=bool) if full]
    found, waiting = [], None
    for block in blocks:
        heads = list(itertools.takewhile(header, block))
        prose = block[len(heads) :]
        waiting = heads[-1] if heads else waiting
        if prose:
            name = "Untitled" if waiting is None else re.sub(r"^#+\s*", "", waiting)
            found.append((re.sub(r"^[0-9]+(?:\.[0-9]+)*\s*", "", name), " ".join(prose)))
            waiting = None
    return found if len(found) < 2 else found[1:]


TEXTS = ["First block\nof two lines.\n\nIntroduction\nWe say a thing.\n\n\nMethods\n\nWhat we did.\nHow.\n\n# Results\nNumbers 12.", "only one block here.", "", "\n\n", "Heading Alone\n\n", "Heading\nOther Heading\nbody text.\n\nMore text here.\nConclusion\nstill body.", "a\n\nA Header Line\n\n\nb\n\nc"]


def test_text_sections_against_brute_force(spark, sf_dir):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    want = {r["doc_id"]: brute_sections(r["text"]) for r in docs.collect()}
    got = {}
    for r in segment.text_sections(docs).orderBy("doc_id", "position").collect():
        assert r["position"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]].append((r["title"], r["body"]))
    assert got == {k: v for k, v in want.items() if v}


PAPER = """<h1 class="ltx_title ltx_title_document">On <i>Things</i></h1><div id="abstract1" class="ltx_abstract"><p>We propose.</p></div>
<section id="S1" class="ltx_section"><h2 class="x">1 Introduction</h2><p>A problem.</p></section>
<section id="S2" class="ltx_section"><h2>2.1 Our Model</h2><p>Layers.</p></section>
<section id="bibliography"><h2 class="ltx_title ltx_title_bibliography">References</h2><li>x</li></section>
<h2 class="ltx_title ltx_title_section">Appendix A</h2><p>More &amp; more.</p><h2 class="ltx_title ltx_title_section">References B</h2><p>no</p>"""


def test_papers_become_components(spark):
    pages = spark.createDataFrame([(1, PAPER), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string")
    sections = segment.html_sections(pages)
    rows = sections.orderBy("position").collect()
    assert [(r["doc_title"], r["title"]) for r in rows] == [("On Things", t) for t in ("Abstract", "Introduction", "Our Model", "Appendix A")]
    assert rows[3]["body"].startswith("More & more.")
    classified = segment.classify_sections(sections)
    assert [r["component_type"] for r in classified.orderBy("position").collect()] == ["MotivationProblem", "MotivationProblem", "MethodStrategy", "AppendicesArtifacts"]
    comps = segment.components(classified, F.lit("things"))
    assert [r["comp_id"].rsplit("/", 1)[1] for r in comps.orderBy("order").collect()] == ["a1", "a2", "c1", "f1"]
    document = json.loads(segment.json_ld(comps).first()["document"])["@graph"]
    assert document[0]["hasComponent"] == [{"@id": n["@id"]} for n in document[1:]] and [n["order"] for n in document[1:]] == [1, 2, 3, 4]


# --- streaming


def test_incremental_resolution_equals_a_batch_run(spark, tmp_path):
    r = entities(spark, 12, seed=8).drop("truth")
    source = f"file://{tmp_path}/in"
    for k in range(3):
        r.where(F.col("rid") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    resolver = IncrementalResolver(f"file://{tmp_path}/state", {"name": "lv"}, "city", 0.7)
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(source)
    resolver.start(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
    batch = resolve(r, Config({"name": "lv"}, block_method="standard", block_key="city", threshold=0.7))
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(resolver.labels(spark)) == key(batch.labels)
    assert spark.read.parquet(f"{tmp_path}/state/records").select("__batch").distinct().count() == 3
