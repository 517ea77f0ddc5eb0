"""Quality rules, mixing, language, neighbours, pages and quotations."""

import math
import textwrap
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, documents, rule_statistics
from pyspark.sql import functions as F

from termloom.llm import byte_cnn, mixing, page_text, quality_rules, quotations, rotated_codes
from termloom.llm.common import table

TEXTS = [
    None,
    "",
    "\n \t",
    "a b c d e f g h a b c d e f g h",
    "a b c d e f g h i a b c d e f g h",
    "one line\none line\n one line\n\n\ntwo # * $ | <x> &amp; %",
    "é ü ñ 中文 x \x1c y",
    "w " * 50,
    " ".join(f"w{i}" for i in range(40)),
]


def test_statistics_equal_brute_force(spark, given):
    rows = [*enumerate(TEXTS), *[(100 + i, t) for i, t, _, _ in given]]
    found = quality_rules.with_statistics(clashing(documents(spark, rows)), "doc_id", "text")
    by_id = {r["id"]: r for r in found.collect()}
    for i, text in rows:
        r = by_id[i]
        expected = rule_statistics(text)
        assert tuple(r[n] for n in quality_rules.STATISTICS[:5]) == expected, repr(text)[:80]
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])


def test_verdict_on_labelled_rows(spark, sf_dir):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), None
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    judged = quality_rules.judge(docs, labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.05 * len(bad)
    assert not any(r["kept"] for r in judged if r["base_failed"])
    kept = quality_rules.kept_rows(clashing(docs), labels)
    all_kept = quality_rules.judge(docs, labels).where("kept")
    assert {r[0] for r in kept.select("doc_id").collect()} == {
        r[0] for r in all_kept.select("doc_id").collect()
    }


def test_verdict_without_labels_or_rows(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, "short"), (None, text)]
    judged = quality_rules.judge(documents(spark, rows), labels).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in judged) == [
        (0, True), (1, True), (1, True), (2, False),
    ]
    assert quality_rules.judge(documents(spark, []), labels).collect() == []


def test_every_rate_is_judged(spark):
    rng = np.random.default_rng(3)

    def clean(n):
        return [f"w{rng.integers(10**6):06d}" for _ in range(n)]

    def lines(words):
        return "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))

    rows = [(i, lines(clean(60)), None) for i in range(300)]
    stuttered = [" ".join(w for w in clean(10) for _ in range(6)) for _ in range(6)]
    symbols = [" ".join(f"#{w}" if j % 12 == 0 else w for j, w in enumerate(clean(60))) for _ in range(6)]
    twice = [lines([w for j in range(9) for w in clean(6)]) + "\nx y" * 6 for _ in range(6)]
    odd = stuttered + symbols + twice + [" ".join(w * 3 for w in clean(60)), "a b c d e f g " * 2 + lines(clean(40))]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)]
    # One of each kind has no label.
    bad = [1000 + i for i in range(len(odd)) if i not in (5, 11, 17)]
    marks = [(i, 1) for i in range(300)] + [(i, 0) for i in bad]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    judged = {r["doc_id"]: r for r in quality_rules.judge(documents(spark, rows), labels).collect()}
    assert not any(judged[i]["base_failed"] for i in range(1000, 1019))
    assert [i for i in judged if i >= 1000 and judged[i]["kept"]] == []
    assert sum(judged[i]["kept"] for i in range(300)) >= 298


def test_forest_finds_what_stands_alone():
    rng = np.random.default_rng(1)
    crowd = rng.normal(0, 1, (500, 4))
    alone = np.full((5, 4), 9.0)
    forest = quality_rules.fit_forest(np.concatenate([crowd, alone]))
    scores = forest.score(np.concatenate([crowd, alone]))
    assert scores[500:].min() > np.quantile(scores[:500], 0.99)
    assert math.isclose(quality_rules._expected(256), 10.2448, rel_tol=1e-3)


def shared_out(sizes, weights, total, most):
    """Targets by sharing out the excess again and again."""
    target = {s: 0.0 for s in sizes}
    left, free = total, set(sizes)
    while free and left > 1e-9:
        weight = sum(weights[s] for s in free)
        given, excess = {s: left * weights[s] / weight for s in free}, 0.0
        for s in list(free):
            target[s] += given[s]
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
        left = excess
    return target


def test_mixing_equals_brute_force(spark, given):
    rows = [(i, t, lang, source) for i, t, lang, source in given]
    rows += [(5000 + i, "a b c", None, None) for i in range(7)] + [(6000, None, None, "zz"), (6001, "", None, "zz")]
    df = clashing(documents(spark, rows))
    taken, _ = mixing.take(df, mixing.n_words(df["text"]))
    out = {r["id"]: r for r in taken.collect()}
    sizes = defaultdict(int)
    for i, text, _, source in rows:
        n = len((text or "").encode().split())
        assert out[i]["size"] == n
        sizes[source] += n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    target = shared_out(sizes, weights, 1.5 * sum(sizes.values()), 2)
    got = defaultdict(int)
    for i, _, _, source in rows:
        r = out[i]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(target[source], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[source] += r["taken"]
    for source in sizes:
        assert abs(got[source] - target[source]) <= 0.5


def test_mixed_rows_take_what_was_decided(spark, given):
    rows = [(i, t, lang, source) for i, t, lang, source in given] + [(7000, "x y z", None, None)]
    df = clashing(documents(spark, rows))
    taken, _ = mixing.take(df, mixing.n_words(df["text"]))
    wanted = {r["id"]: r["taken"] for r in taken.collect() if r["taken"]}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    got = Counter()
    texts = {i: t for i, t, _, _ in rows}
    for r in mixed.collect():
        n = len(r["text"].encode().split())
        got[r["doc_id"]] += n
        assert r["text"].split() == texts[r["doc_id"]].split()[:n]
    assert dict(got) == wanted


@pytest.mark.parametrize("share", [0.9, 1.3])
def test_mixed_rows_of_one_id_take_what_was_decided(spark, share):
    rows = [(None, f"n{i} " * (1 + i % 5) + "end", "x", "s") for i in range(40)]
    rows += [(None, "the very same words again", "x", "s")] * 30 + [(7, "a b c", None, "t")] * 9
    df = clashing(documents(spark, rows))
    taken, _ = mixing.take(df, mixing.n_words(df["text"]), share=share)
    wanted = defaultdict(int)
    for r in taken.collect():
        wanted[r["source"], r["size"]] += r["taken"]
    sizes = {t: len(t.split()) for _, t, _, _ in rows}
    got, cut = defaultdict(int), 0
    for r in mixing.mixed_rows(df, share=share).collect():
        n = len(r["text"].split())
        source = next(t for t in sizes if t.split()[:n] == r["text"].split())
        cut += n < sizes[source]
        got[r["source"], sizes[source]] += n
    assert sum(got.values()) == sum(wanted.values())
    for source in "st":
        assert sum(v for (s, _), v in got.items() if s == source) == sum(
            v for (s, _), v in wanted.items() if s == source
        )
    assert cut <= 2  # one row of each source at most


def test_mixing_of_nothing(spark):
    df = documents(spark, [])
    taken, _ = mixing.take(df, mixing.n_words(df["text"]))
    assert taken.collect() == [] and mixing.mixed_rows(df).collect() == []


def test_language_of_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = byte_cnn.identify(clashing(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r["lang"] == r["lang_pred"] for r in found if r["held_out"]]
    assert len(held) > 200 and sum(held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_texts(spark):
    rows = [(i, "der die und das ist nicht ein " * 9, "de") for i in range(40)]
    rows += [(100 + i, "the and of that is not with " * 9, "en") for i in range(40)]
    rows += [(500, None, "en"), (501, "12 34 !", "en"), (502, "the and", None), (502, "the and", None)]
    found = byte_cnn.identify(documents(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[500]["lang_pred"], by_id[500]["score"]) == ("und", 0.0)
    assert by_id[501]["lang_pred"] == "und" and by_id[502]["lang_pred"] == "en"
    assert len(found) == len(rows)
    nothing = byte_cnn.identify(documents(spark, [(1, "some text")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert byte_cnn.identify(documents(spark, [])).collect() == []


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 256, (20, byte_cnn.WINDOW)).astype(np.uint8)
    net = byte_cnn.train(rows, np.arange(20) % 2, ["a", "b"])
    e = net.embedding[rows]
    pooled = []
    for w in byte_cnn.WIDTHS:
        span = byte_cnn.WINDOW - w + 1
        conv = sum(e[:, j : j + span] @ net.filters[w][j] for j in range(w))
        pooled.append(np.maximum(conv.max(1) + net.biases[w], 0))
    expected = byte_cnn.softmax(np.concatenate(pooled, 1) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(rows, net.tables()), expected, atol=1e-5)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def nearest(rows, k=10):
    good = [
        (i, np.array(v, np.float32).astype(np.float64))
        for i, v in rows
        if v is not None and None not in v and np.isfinite(v).all() and any(v)
    ]
    out = {}
    for i, v in good:
        if i % 100 == 0:
            near = sorted((math.dist(v, w), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (5, 24))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.3, 24)).tolist()) for i in range(900)]
    rows += [(900, rows[100][1]), (901, rows[100][1]), (902, [0.0] * 24), (903, None), (904, [])]
    rows += [(905, [float("nan")] * 24), (906, [None] * 24), (907, [float("inf")] * 24)]
    rows += [(1000 + i, rng.normal(0, 1, 3).tolist()) for i in range(5)]
    monkeypatch.setattr(rotated_codes, "BLOCK_VALUES", 24 * 128)
    monkeypatch.setattr(rotated_codes, "QUERY_VALUES", 24 * 4)
    df = clashing(vectors(spark, rows).repartition(3))
    found = rotated_codes.search(df, df.where(F.col("vec_id") % 100 == 0)).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    expected = nearest(rows)
    assert set(got) == set(expected)
    for q, near in expected.items():
        assert [j for _, j in got[q]] == [j for _, j in near]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in near], rtol=1e-12)


def test_bounds_spare_most_vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 128))
    data = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.1, (4000, 128))
    centre = data.mean(0)
    codes, length, correction = rotated_codes.encode(data, centre)
    queries = data[:20]
    signs = rotated_codes.unpacked(codes, rotated_codes.code_bits(128))
    low, high = rotated_codes.distance_bounds(signs, length, correction, queries, centre)
    true = ((queries[:, None] - data[None]) ** 2).sum(2)
    assert (low <= true + 1e-9).mean() > 0.999 and (high >= true - 1e-9).mean() > 0.999
    limit = np.partition(high, 9, axis=1)[:, 9]
    assert (low <= limit[:, None]).mean() < 0.2


def test_driver_gets_no_vectors(spark, monkeypatch):
    """The driver gets a mean per dimension, and no table with copies of the queries."""
    rows = [(i, [float(i % 7 + 1), float(i % 11), float(i % 5)][: 2 + i % 2]) for i in range(900)]
    df = vectors(spark, rows).repartition(5)
    sent = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(rotated_codes, "CENTRE_ROWS", 100)
    ids = rotated_codes._rows(df, "vec_id", "embedding")
    centres = rotated_codes.centres_of(ids)
    found = rotated_codes.search(df, df.where(F.col("vec_id") % 3 == 0), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    assert set(centres) == {2, 3} and max(map(len, sent)) <= 2
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    first = ids.orderBy(F.xxhash64("id"), "id").limit(100).collect()
    for dimension, centre in centres.items():
        part = [r["vector"] for r in first if r["dimension"] == dimension]
        assert np.allclose(centre, np.mean(part, axis=0), rtol=1e-12)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    for q, near in got.items():
        v = dict(rows)[q]
        others = [(math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v)]
        assert near == [i for _, i in sorted(others)[:4]]
    assert len(got) == 300


def test_limits_hold_over_blocks():
    """Neighbours in block after block are those of one block, with fewer pairs returned."""
    rng = np.random.default_rng(3)
    data, asked = rng.normal(0, 1, (900, 16)), rng.normal(0, 1, (70, 16))
    centre = data.mean(0)

    def block(part):
        codes, length, correction = rotated_codes.encode(data[part], centre)
        return {
            "ids": np.arange(900)[part],
            "vectors": data[part],
            "codes": codes,
            "length": length,
            "correction": correction,
        }

    queries = {"ids": np.arange(1000, 1070), "vectors": asked}
    best = np.full((70, 3), np.inf)
    found = []
    for lo in range(0, 900, 300):
        part = slice(lo, lo + 300)
        query, vector, squared = rotated_codes.nearest_in_block(block(part), queries, centre, 3, best)
        found += zip(query.tolist(), squared.tolist(), (vector + lo).tolist(), strict=True)
    query, vector, squared = rotated_codes.nearest_in_block(block(slice(0, 900)), queries, centre, 3)
    whole = sorted(zip(query.tolist(), squared.tolist(), vector.tolist(), strict=True))
    assert len(found) < 3 * len(whole)
    kept = [r for q in range(70) for r in sorted(x for x in found if x[0] == q)[:3]]
    assert kept == whole
    assert np.array_equal(np.sort(best, axis=1).ravel(), [s for _, s, _ in whole])


def test_neighbours_of_nothing(spark):
    df = vectors(spark, [])
    assert rotated_codes.search(df, df).collect() == []


PAGE = (
    '<html><head><title>t</title></head><body><div class="site-menu"><a href="/">Home</a></div>'
    '<header><h1>Site name</h1></header><div id="content"><h2>The title of it</h2>'
    "<p>One two three four five <a href=x>six seven</a> eight nine ten.</p>"
    '<div class="ad-slot">Buy this now</div><script>var x="<p>no</p>";</script>'
    "<p>More &eacute;t&eacute; words&nbsp;in   the second\nparagraph &amp; so on.<p>Third<br>line"
    ' has <b>bold</b>ness too.</div><section id="comments"><p>Nice post, I liked it a lot</p></section>'
    "<aside><p>Other things to read</p></aside><form><label>Name</label></form>"
    '<div class="cookie-notice">We use cookies on this site</div><footer>Imprint</footer></body></html>'
)


def test_page_without_label(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just some plain words"), (4, "u", "<p>x")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = page_text.extract(df).collect()
    texts = {r["page_id"]: r["text"] for r in found if r["text"] != "x"}
    assert texts[1].split("\n\n") == [
        "The title of it",
        "One two three four five six seven eight nine ten.",
        "More été words in the second paragraph & so on.",
        "Third line has boldness too.",
    ]
    assert texts[2] == texts[3] == "" and texts[4] == "just some plain words"
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(found) == len(rows)


def test_marked_names_inside_content_are_read():
    weights = dict(page_text.PRIOR)
    weights |= {f"other {m}": page_text.PRIOR_OTHER for m in page_text.MARKS | page_text.OTHER}
    prose = "<p>" + "many words of the article itself " * 5 + "</p>"
    whole = " ".join(["many words of the article itself"] * 5)

    def blocks(html):
        return page_text.Page(html).text(weights).split("\n\n")

    inside = (
        f'<h1>Title</h1>{prose}<h2 id="related-work">Related work</h2>{prose}<section id="search">'
        f'<h2 id="search">Search</h2>{prose}</section><section id="hidden-markov-models">{prose}'
        f'</section><div class="alert alert-info">{prose}</div><div class="ad">Buy {whole}</div>{prose}'
    )
    wanted = ["Title", whole, "Related work", whole, "Search", whole, whole, whole, whole]
    for html in (
        f"<body>{inside}</body>",
        f"<body><article>{inside}</article></body>",
        f'<div class="layout sidebar-left">{inside}</div><div class="sidebar">see also this</div>',
        f'<div class="widget Blog">{inside}</div><div class="widget"><a href=x>one two</a></div>',
    ):
        assert blocks(html) == wanted
    head = '<div class="entry-header"><h1>The long title of an article</h1></div>'
    assert blocks(f"<body>{head}{prose}</body>") == ["The long title of an article", whole]
    around = f'<div class="widget">{prose}</div><div id="comments">{prose * 9}</div>'
    around += f'<div class="post-comments">{prose * 9}</div>'
    assert blocks(f"<body>{prose * 2}{around}</body>") == [whole, whole]


def test_raw_elements_end_where_they_end():
    dotted = "\u0130" * 2
    for head in (f"<HEAD><title>{dotted}</title></HEAD>", f"<head><title>{dotted}</title>"):
        html = f"{head}<body><p>{dotted}stanbul one <svg><path/></SVG>two three</p>"
        page = page_text.Page(f"{html}<script>var x</script>four five</body>")
        text = page.text(dict(page_text.PRIOR))
        assert text == f"{dotted}stanbul one two three\n\nfour five"


ARTICLE = "<p>The first paragraph of the article has some words.</p><p>And a second one.</p>"
ARTICLE_TEXT = "The first paragraph of the article has some words.\n\nAnd a second one."


@pytest.mark.parametrize(
    "page",
    [
        "<div class='menu-wrapper'><article>{}</article></div>",
        "<form id=f><article>{}</article></form>",
        "<div class='menu'><div>a child</div><article>{}</article></div>",
        "<div class='sidebar'><ARTICLE>{}</ARTICLE></div>",
        "<nav><ul><li>x</ul></nav><aside><nav>y</nav><main>{}</main></aside>",
        "<form action=post.aspx>{}</form>",
        "<nav>a menu</nav><div>{}</div><form>your name</form>",
    ],
)
def test_articles_in_wrappers_of_any_name_are_found(page):
    found = page_text.Page(f"<html><body>{page.format(ARTICLE)}</body></html>")
    weights = dict(page_text.PRIOR)
    weights |= {f"other {m}": page_text.PRIOR_OTHER for m in page_text.MARKS | page_text.OTHER}
    assert ARTICLE_TEXT in found.text(weights)
    assert "your name" not in found.text(weights)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 40000 + "</b>" * 40000,
        "<div class='menu'>" * 20000 + "<article>some words here</article>",
        "<x class='menu'>a</x>" * 20000 + "<main>some words here</main>",
        "<p>word " * 200000,
    ],
)
def test_long_pages_take_time_in_proportion(page):
    start = time.process_time()
    page_text.Page(page).text(dict(page_text.PRIOR))
    assert time.process_time() - start < 20


def test_long_messages_take_time_in_proportion():
    start = time.process_time()
    assert len(quotations.levels("\n" * 300000)) == 300001
    assert len(quotations.levels("> quoted\nA wrote:\n> more\n" * 100000)) == 200001
    assert time.process_time() - start < 20


def test_languages_with_few_and_many_rows_are_learned(spark, monkeypatch):
    """A sample of fixed size per language, whatever its number of rows; none without windows."""
    monkeypatch.setattr(byte_cnn, "ROWS_PER_LANG", 5)
    rows = [(i, f"some english words {i}", "en") for i in range(300)]
    rows += [(1000 + i, f"einige deutsche Worte {i}", "de") for i in range(3)]
    rows += [(7, "another text of one id", "en"), (None, "no id", "fr")]
    labelled = documents(spark, rows).select(F.col("doc_id").alias("id"), "text", "lang")
    windows, numbers, languages = byte_cnn.sample(labelled)
    assert languages == ["de", "en", "fr"]
    counts = np.bincount(numbers, minlength=3) / byte_cnn.WINDOWS_PER_ROW
    assert counts.tolist() == [3, 5, 0] and len(windows) == len(numbers)
    monkeypatch.setattr(byte_cnn, "MAX_LANGS", 1)
    assert byte_cnn.sample(labelled)[2] == ["en"]
    windows, _, languages = byte_cnn.sample(labelled.where("id is null"))
    assert (len(windows), languages) == (0, [])


def test_given_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    pages = table(spark, sf_dir, "pages")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in page_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", sources[r["page_id"]], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        blocks = [" ".join(html.unescape(p).split()) for p in parts]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_region_is_the_best_of_all():
    rng = np.random.default_rng(9)
    page = page_text.Page("")
    for _ in range(50):
        kinds = rng.choice(["word", "tag p", "tag div", "other nav"], 30)
        page.kinds, page.counts = kinds.tolist(), rng.integers(1, 4, 30).tolist()
        weights = {"word": 1.0, "tag p": -0.4, "tag div": -1.5, "other nav": -3.0}
        value = [weights[k] * c for k, c in zip(page.kinds, page.counts, strict=True)]
        best = max(sum(value[a:b]) for a in range(31) for b in range(a, 31))
        first, end = page.region(weights)
        assert sum(value[first:end]) == pytest.approx(best)


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_quotations_are_linked(spark):
    rows = [
        (1, 0, "user", "How do I sort a table?\nIt is large."),
        (1, 1, "assistant", "Use orderBy."),
        (1, 2, "user", "On Monday A wrote:\n> How do I sort a table?\n\nI meant this one."),
        (1, 3, "assistant", "> I meant this one.\n>> How do I sort a table?\n\nI see.\n"),
        (2, 0, "user", "B said:\n> Use orderBy.\nDoes that scale?"),
        (2, 1, "assistant", "> nobody ever said that\nYes."),
        (3, 0, None, None),
        (3, 0, None, None),
    ]
    found = quotations.link_quotations(clashing(messages(spark, rows))).collect()
    by_key = {(r["conv_id"], r["turn"]): r for r in found}
    parent = {k: (r["parent_conv"], r["parent_turn"], r["linked"]) for k, r in by_key.items()}
    assert parent[1, 0] == (None, None, False)
    assert parent[1, 1] == (1, 0, False)
    assert parent[1, 2] == (1, 0, True)
    assert parent[1, 3] == (1, 2, True)
    assert parent[2, 0] == (1, 1, True)
    assert parent[2, 1] == (2, 0, False)
    assert by_key[1, 2]["text"] == "I meant this one."
    assert by_key[1, 3]["text"] == "I see."
    assert by_key[2, 0]["text"] == "Does that scale?"
    assert (by_key[1, 3]["n_quoted"], by_key[1, 3]["n_linked"]) == (2, 1)
    assert by_key[2, 1]["thread"] == by_key[1, 0]["thread"] and by_key[2, 1]["depth"] == 3
    assert len(found) == len(rows)
    for r in found:
        if r["parent_conv"] is not None and r["conv_id"] != 3:
            above = by_key[r["parent_conv"], r["parent_turn"]]
            assert above["thread"] == r["thread"] and above["position"] < r["position"]


def test_quotations_wrapped_anew_and_deeper(spark):
    long = "one paragraph that goes on for more than a line of a mail, so that " * 3 + "it is wrapped"
    wrapped = "> one paragraph that goes on\n> for more than a line of a mail, so that one\n> paragraph that"
    other = "Some first words. Then there is\na short one! The last sentence follows here."
    rows = [
        (1, 0, "user", long),
        (1, 1, "assistant", "Nothing is quoted here."),
        (1, 2, "user", other),
        (1, 3, "assistant", "Neither is it here."),
        (1, 4, "user", "> " + "\n> ".join(textwrap.wrap(long, 60)) + "\n\nI mean the first."),
        (1, 5, "user", wrapped + "\nCut in the middle."),
        (1, 6, "user", "> Then there is a\n> short one!\nThat one."),
        (1, 7, "user", ">> " + "\n>> ".join(textwrap.wrap(other, 20)) + "\nTwo levels."),
        (1, 8, "user", ">>> Then there is a short one!\nThree levels."),
        (2, 0, "user", "The question of it all"),
        (2, 1, "user", "Something else"),
        (2, 2, "user", "An answer without any quotation"),
        (2, 3, "user", "> An answer without any quotation\n>> The question of it all\nThanks."),
    ]
    found = quotations.link_quotations(clashing(messages(spark, rows))).collect()
    by_key = {(r["conv_id"], r["turn"]): r for r in found}
    parent = {k: (r["parent_conv"], r["parent_turn"], r["linked"]) for k, r in by_key.items()}
    assert parent[1, 4] == (1, 0, True)
    assert by_key[1, 4]["n_quoted"] == by_key[1, 4]["n_linked"] == 4
    assert parent[1, 5] == (1, 0, True)
    assert parent[1, 6] == (1, 2, True)
    assert parent[1, 7] == (1, 6, True)  # quotes at the first level what is here at the second
    assert parent[1, 8] == (1, 7, True)
    assert parent[2, 3] == (2, 2, True)
    assert parent[2, 2] == (2, 0, True)  # as the message behind it tells
    assert parent[1, 3] == (1, 2, False) and parent[2, 1] == (2, 0, False)


def test_common_words_meet_wherever_lines_end():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 60)]
        start = int(rng.integers(0, 49))
        part = ["x"] * int(rng.integers(0, 5)) + words[start : start + 11] + ["y"] * 3
        assert set(quotations.windows(words)[1]) & set(quotations.windows(part)[1])


def test_quotations_of_nothing(spark):
    assert quotations.link_quotations(messages(spark, [])).collect() == []


def test_mails_are_read_back(spark, sf_dir):
    plain = table(spark, sf_dir, "conversations")
    found = quotations.quoted_round_trip(spark, sf_dir).collect()
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in plain.collect()}
    assert len(found) == len(texts)
    for r in found:
        assert r["text"] == texts[r["conv_id"], r["turn"]].strip("\n \t")
        before = (r["conv_id"], r["turn"] - 1)
        if before in texts:
            assert r["linked"] and (r["parent_conv"], r["parent_turn"]) == before
