import itertools

import numpy as np

from catchment.llm import page_crf as crf
from catchment.llm.page_blocks import feature, parser
from catchment.llm.page_samples import labelled_pages

TRAINED = {}


def field():
    if not TRAINED:
        TRAINED["field"] = crf.fit()
    return TRAINED["field"]


def texts(page):
    return [b.text for b, _ in parser().blocks(page)]


def main_text(page):
    found = [b for b, _ in parser().blocks(page)]
    label = crf.viterbi(field(), crf.Chains.of([[b.features for b in found]]))
    return "\n".join(b.text for b, y in zip(found, label) if y)


def test_blocks_of_broken_markup():
    assert texts("<p>a <b>b<p>c<br>d &amp; &lt;e&gt;&nbsp;f</p>g<li>h<li>i") == ["a b", "c d & <e> f", "g", "h", "i"]
    assert texts("<script>var a='</p><p>x';</script><style>p{}</style><p title='a>b'>y<!-- <p>no --></p>") == ["y"]
    assert texts("<title>t</title><textarea>z</textarea><select><option>o</select><p>1 < 2 & 3") == ["1 < 2 & 3"]
    assert texts("") == [] and texts("<div") == ["<div"] and texts("<script>never closed") == []
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert texts("x" * 100_000) == ["x" * 100_000]
    assert texts('<p class="' + "y" * 5000 + '">a<p title="b>c</p>') == ["a", "c"]
    assert texts("<div>" * 3000 + "deep") == ["deep"]


def test_quoted_values_of_any_length():
    """What stands in a quoted value is no markup, above the length of 2000 as below."""
    read = parser()
    for n in (10, 1990, 2010, 300_000):
        for value in ('"' + "x" * n + ' > y"', "'" + "x" * n + " <p>in</p> > y'", "'{" + '"a": "<b>", ' * (n // 12) + "}'"):
            found = read.blocks(f"<p>before</p><div data-state={value} class=sidebar>inside</div><p>after")
            assert [b.text for b, _ in found] == ["before", "inside", "after"], n
            assert feature("hint:sidebar") in found[1][0].features
    assert texts('<p title="' + "z" * 3000 + ">open") == ["open"]


def test_every_word_of_a_class_counts():
    few, many = (parser().blocks(f'<div class="{c}">text</div>')[0][0].features for c in ("a" * 5, " ".join("mx px col row".split() * 5) + " side-sidebar"))
    assert feature("hint:sidebar") in many and feature("hint:sidebar") not in few


def test_pairs_of_quotes_take_linear_time():
    import time

    for piece in ("<a \"<b '\" '", "<a '\"' \"<a '\"", "<a \"' <b '\" ", "\"<a '\"'", "<a x='\"'\"<\""):
        start = time.perf_counter()
        parser().blocks(piece * 20_000)
        assert time.perf_counter() - start < 20, piece


def test_hostile_markup_takes_linear_time():
    import time

    for piece in ("<a ", "<a title='", "<!", "<p", "</", "<b>", "<!-- ", '<a x="', "<div>", "<li>"):
        start = time.perf_counter()
        parser().blocks(piece * 20_000)
        assert time.perf_counter() - start < 20, piece


def test_held_out_pages():
    read, wrong, total = parser(), 0, 0
    for page in labelled_pages(150, 4711):
        blocks = read.blocks(page)
        label = crf.viterbi(field(), crf.Chains.of([[b.features for b, _ in blocks]]))
        wrong += sum(int(y) != (name == "main") for y, (_, name) in zip(label, blocks))
        total += len(blocks)
    assert wrong <= 0.02 * total


def test_article_without_what_surrounds_it():
    page = """<html><head><title>T</title></head><body><header class="site-header"><p>My site</p></header>
      <nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
      <article><h1>Head line</h1><p>First &quot;paragraph&quot; of the text, with words.</p><p>Second one is here as well. It goes on.</p>
      <div class="ad">Buy this now.</div><p>Third.</p></article>
      <aside class="sidebar"><h3>Related</h3><p>Another story that you might like.</p></aside>
      <section class="comments"><p>I liked this text a lot, thank you.</p></section>
      <form class="newsletter"><label>Mail</label><button>Go</button></form><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == 'Head line\nFirst "paragraph" of the text, with words.\nSecond one is here as well. It goes on.\nThird.'


def test_viterbi_is_the_best_path_of_all():
    random = np.random.default_rng(3)
    model = crf.Field(random.normal(size=(crf.FEATURES, 2)), random.normal(size=(2, 2)), random.normal(size=2))
    pages = [[tuple(random.integers(0, crf.FEATURES, 4).tolist()) for _ in range(n)] for n in (1, 5, 0, 8, 3)]
    got = crf.viterbi(model, crf.Chains.of(pages)).tolist()
    for page in pages:
        score = [[sum(model.weight[f, y] for f in block) for y in (0, 1)] for block in page]

        def value(path):
            return (model.start[path[0]] if path else 0) + sum(s[y] for s, y in zip(score, path)) + sum(model.change[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert abs(value(tuple(got[:len(page)])) - value(best)) < 1e-9
        got = got[len(page):]


def test_hard_rows(spark):
    rows = [(1, "u", "<p>one</p>"), (2, None, None), (None, "u", ""), (2, None, None), (3, "u", "<nav>menu</nav>"),
            (4, "u", "<article>" + "<p>A paragraph of some words, and more of them.</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars string, block int")
    got = crf.extract_text(pages, training_pages=60).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[2]["text"] == "" and by_id[2]["n_chars"] == 0 and by_id[None]["text"] == ""
    assert by_id[4]["text"].count("\n") == 19_999 and by_id[4]["n_chars"] == len(by_id[4]["text"])
    assert crf.extract_text(pages.limit(0), training_pages=60).count() == 0


def test_whole_pages_of_the_table(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in crf.extract_text(pages).collect():
        page = source[r["page_id"]]
        inside = page[page.index("<article>") + 9:page.index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in parts if x)
