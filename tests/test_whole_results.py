"""Whole results where the given tables don't show a loss."""

import html
import html.entities
import math
import re
from collections import Counter

import pytest

from kinlake.functions.text import strip_html
from kinlake.operators import segment
from kinlake.operators.neighbors import gram_cosines
from kinlake.plans.catalog import QUERIES


# --- html_strip


REFERENCES = "caf&eacute; &mdash; &hellip; it&#8217;s &#xE9;&#XE9; a&#160;b&nbsp;c &CounterClockwiseContourIntegral; &amp;lt; &lt;p&gt; &copy 1 &#128; &#0; &nosuch; R&D"


def test_every_character_reference_is_decoded(spark):
    def reference(s):
        s = re.sub(r"<(script|style)[^>]*>.*?</\1>", " ", s, flags=re.S | re.I)
        return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", s))).strip()

    names = " ".join(f"x&{n}y" for n in sorted(html.entities.html5) if n.endswith(";"))
    texts = [f"<p>{REFERENCES}</p>", f"<b>{names}</b>", "<script>a&eacute;b</script> &nbsp; ", ""]
    got = spark.createDataFrame(list(enumerate([*texts, None])), "n int, h string").select("n", strip_html("h").alias("t")).orderBy("n").collect()
    assert [r["t"] for r in got] == [*map(reference, texts), None]
    assert got[0]["t"].startswith("café — … it’s éé a b c ∳ &lt; <p> © 1 €")


def test_sections_decode_titles_and_bodies(spark):
    page = '<h1 class="ltx_title ltx_title_document">Na&iuml;ve&#8212;Bayes</h1><section id="S1" class="ltx_section"><h2>1 R&eacute;sum&#xE9;</h2><p>so&hellip;</p></section>'
    row = segment.html_sections(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert (row["doc_title"], row["title"]) == ("Naïve—Bayes", "Résumé") and row["body"].endswith("so…")


# --- paper_url


def test_pages_of_any_id_get_their_addresses(spark, tmp_path):
    ids = [0, 99_999, 100_000, 123_456, 10**12 + 7]
    spark.createDataFrame([(i, "https://example.org/a") for i in ids], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r["page_id"]: r for r in QUERIES["paper_url"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == ids
    for i in ids:
        n = f"{i % 10000:04}.{i % 100000:05}"
        assert rows[i][1:] == (f"https://ar5iv.org/html/{n}v2", f"https://ar5iv.org/html/{n}", f"https://ar5iv.org/html/{n}", None)


# --- n-gram cosines


@pytest.mark.parametrize(("binary", "split"), [(False, 2_000), (False, 2), (True, 3)])
def test_gram_cosines_of_all_records_against_brute_force(spark, binary, split):
    names = ["large ring", "large  ring", "hot bolt", "hot ring", "ring ring ring", "xyz", "ab", "ab", "", None, *["blue ring"] * 9, *[f"ring {k}" for k in range(12)]]
    texts = {k: " ".join((n or "").split()) for k, n in enumerate(names)}
    grams = {k: Counter([t[x : x + 3] for x in range(len(t) - 2)] if len(t) > 3 else [t] if t else []) for k, t in texts.items()}
    if binary:
        grams = {k: Counter(set(g)) for k, g in grams.items()}
    norm = {k: math.sqrt(sum(x * x for x in g.values())) for k, g in grams.items()}
    want = {(i, j): sum(grams[i][g] * grams[j][g] for g in grams[i]) / (norm[i] * norm[j]) for i in texts for j in texts if i < j and set(grams[i]) & set(grams[j])}
    rows = gram_cosines(spark.createDataFrame(list(enumerate(names)), "rid long, text string"), binary=binary, split=split).collect()
    assert len(rows) == len(want) and {(r["i"], r["j"]): r["cos"] for r in rows} == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("name", ["cosine_ngrams_parts", "cosine_ngrams_binary_parts"])
def test_every_part_has_its_cosines(spark, sf_dir, name):
    pairs = QUERIES[name](spark, sf_dir)
    ends = pairs.select("i").union(pairs.select("j")).distinct()
    assert ends.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
