"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowloom.llm import ann, byte_bpe, exact_dedup, html_text, language_id, near_dedup, packing, pii, substring_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "Hello there, this is a plain text.", "en", "a", 34),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "a row without an id", "en", None, 3),
    (4, LONG, "en", "a", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, "Hello there, this is a plain text.", "en", "a", 34),
    (6, "Hello there, this is a plain text.", "en", "a", 34),
    (7, "12345 !!! \t\n", None, "c", 10),
    (8, "日本語 текст 😀", "xx", "c", 10),
]
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """Extra columns that are named like those operators make or use inside."""
    names = ("id", "rep", "fp", "sha", "row", "piece", "length", "block", "bits", "kept", "rule", "host", "_sha", "_swaps", "score", "key", "ids", "pii")
    return df.withColumns({n: F.lit(7) for n in names if n not in df.columns})


def test_exact(docs, none):
    out = {(r.doc_id, i): r for i, r in enumerate(exact_dedup.exact_groups(clash(docs)).collect())}
    assert len(out) == len(ROWS)
    by = {k: [r for (i, _), r in out.items() if i == k] for k in {i for i, _ in out}}
    assert by[1][0].keep_id == 6 and by[1][0].group_size == 3 and not by[1][0].kept
    assert sum(r.kept for r in by[6]) == 1
    assert by[2][0].keep_id == 3 and by[3][0].kept and by[3][0].group_size == 2
    assert by[5][0].kept and not by[4][0].kept
    assert by[None][0].keep_id is None and by[None][0].kept
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.dedup(clash(docs))
    assert kept.columns == clash(docs).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 5, 6, 7, 8]
    assert exact_dedup.dedup(none).count() == 0


def test_near(docs, none):
    out = near_dedup.near_groups(clash(docs)).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[5].component_id == 4 and not by[5].kept and by[6].component_id == 1
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[3].kept
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_groups(none).count() == 0
    assert sorted((r.doc_id or 0) for r in near_dedup.dedup(clash(docs)).collect()) == [0, 1, 2, 3, 4, 7, 8]


def test_substring(docs, none):
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(clash(docs)).collect()}
    assert out[4].n_removed == 0 and out[4].n_words == 60_000 and out[4].kept == LONG
    assert out[5].n_removed == 60_000 and out[5].kept == ""
    assert out[2].n_words == 0 and out[2].kept == "" and out[None].n_words == 5
    assert substring_dedup.remove_repeats(none).count() == 0


def test_bpe(docs, none):
    ids = byte_bpe.encode(clash(docs), RANKS, public_tokenizers.PATTERN)
    out = byte_bpe.decode(ids, RANKS).collect()
    assert len(out) == len(ROWS)
    for r in out:
        want = {k: t for k, t, *_ in ROWS}[r.doc_id] or ""
        assert r.decoded == want and (len(r.ids) > 0) == bool(want)
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(docs, none):
    pieces = packing.tokenize_pieces(clash(docs), JSON, public_tokenizers.PATTERN)
    placed = packing.place(pieces.drop("ids"))
    rows = placed.collect()
    assert {r.doc_id for r in rows} == {k for k, *_ in ROWS}
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.place(packing.tokenize_pieces(none, JSON, public_tokenizers.PATTERN).drop("ids")).count() == 0


def test_packing_of_full_pieces_and_clashing_names(spark):
    rows = [(i, 0, length, "b", "s", "r", -1) for i, length in enumerate([10] * 7 + [10, 10, 3, 7, 6, 4, 5, 5, 9])]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length int, _bucket string, _serial string, _rank string, sequence_id long")
    out = packing.place(pieces, capacity=10)
    assert out.columns == ["doc_id", "piece", "length", "_bucket", "_serial", "_rank", "sequence_id", "offset"]
    spans = {}
    for r in out.collect():
        assert (r._bucket, r._serial, r._rank) == ("b", "s", "r")
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sorted(x) for x in spans.values() if len(x) == 1) == [[(0, 9)]] + [[(0, 10)]] * 9
    assert sorted(sum(n for _, n in x) for x in spans.values()) == [9] + [10] * 12
    only = packing.place(pieces.filter("length = 10"), capacity=10).collect()
    assert len({r.sequence_id for r in only}) == len(only) == 9 and {r.offset for r in only} == {0}


def test_language(docs, none):
    samples = language_id.learn(docs)
    out = {r.doc_id: r for r in language_id.identify(clash(docs), samples).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[7].lang_pred == "und" and out[7].score == 0
    assert out[1].lang_pred == "en" and out[8].lang_pred == "xx" and 0 <= out[1].score <= 1
    assert language_id.learn(none) == () and language_id.identify(none, ()).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, ()).collect()} == {"und"}


def test_pipeline_keeps_documents_without_labels(spark, docs):
    import corpus_pipeline

    want = sorted(r[1] for r in ROWS if any(c.isalpha() for c in r[1] or ""))
    fold = language_id.fold_number(F.col("doc_id")) == 1
    assert docs.filter(fold).count()
    for lang in (F.lit(None).cast("string"), F.when(fold, "en")):
        out = corpus_pipeline.language(spark, docs.withColumn("lang", lang), "").collect()
        assert sorted(r.text for r in out) == want


def test_pii(docs, none):
    out = {r.doc_id: r for r in pii.pseudonymise(clash(docs), "k").collect()}
    assert out[2].text is None and out[2].pii == [] and out[3].text == "" and out[4].text == LONG and out[7].text == "12345 !!! \t\n"
    assert pii.pseudonymise(none, "k").count() == 0


def test_html(spark):
    schema = "page_id long, url string, html string"
    page = "<body><nav>menu</nav><article><p>one &amp; two</p></article></body>"
    rows = [(1, "http://a.b/c", page), (2, None, None), (None, "x", ""), (3, "http://a.b/d", page), (3, "http://a.b/d", page), (4, "http://a.b/e", "<p>" + "a " * 300_000)]
    out = html_text.extract_text(clash(spark.createDataFrame(rows, schema))).collect()
    assert len(out) == len(rows) and "html" not in out[0]
    by = {r.page_id: r.text for r in out}
    assert by[1] == by[3] == "one & two" and by[2] == by[None] == "" and len(by[4]) == 599_999
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("attrs", ['class="overflow-hidden"', 'style="overflow: hidden"', "class='md:hidden-xs lead'", 'data-hidden="1"', 'aria-hidden="false"', 'title="hidden display:none"', 'data-id="sidebar"'])
def test_html_that_only_looks_hidden(attrs):
    for page in (f"<body {attrs}><p>a b c</p></body>", f"<body><main {attrs}><p>a b c</p></main></body>", f"<article><div {attrs}><p>a b c</p></div></article>"):
        assert html_text.extract(page, None) == "a b c"


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", "class=x hidden", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"', "style='visibility:hidden !important'"])
def test_html_that_is_hidden(attrs):
    assert html_text.extract(f"<article><p>a</p><div {attrs}><p>b</p></div></article>", None) == "a"
    assert html_text.extract(f"<body {attrs}><p>a</p></body>", None) == "a"


LONG_BODY = "long body text " * 40


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class=post><h1>Title</h1><p>lead</p><div class=body><p>{}</p></div><p>end</p></div></body>",
        "<body><div class=post><div class=head><h1>Title</h1><p>lead</p></div><div class=body><p>{}</p></div><div>end</div></div></body>",
        "<body><h1>Title</h1><p>lead</p><div class=body><p>{}</p></div><p>end</p></body>",
        "<body><div class=top><h1>Title</h1></div><div class=lead>lead</div><div class=body><p>{}</p></div><div class=last>end</div></body>",
        "<body><div class=post><h1>Title</h1><p>lead</p><blockquote><p>{}</p></blockquote><p>end</p></div></body>",
        "<body><main><h1>Title</h1><p>lead</p><article><p>{}</p></article><p>end</p></main></body>",
        "<body><h1>Title</h1><div class=a>lead</div><article><p>{}</p></article><div class=z>end</div></body>",
    ],
)
def test_html_keeps_what_is_around_the_body(spark, page):
    page, want = page.format(LONG_BODY), f"Title\n\nlead\n\n{LONG_BODY.strip()}\n\nend"
    assert html_text.extract(page, None) == want
    out = html_text.extract_text(spark.createDataFrame([(i, "http://h.com/a", page) for i in range(3)], "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {want}


@pytest.mark.parametrize("attrs", ["class='site-content no-sidebar'", "class=has-sidebar", "class='elementor-widget-text-editor'", "id=search-result-article", "class=entry-header", "class=page-header", "class=header", "class=sidebar", "class=has-comments", "class=post-header", "class='text-without-ads'"])
def test_html_words_of_wrappers(attrs):
    whole = "Title\n\none two three"
    assert html_text.extract(f"<body><div {attrs}><h1>Title</h1><p>one two three</p></div></body>", None) == whole
    assert html_text.extract(f"<body><div {attrs}><article><h1>Title</h1><p>one two three</p></article></div><nav>menu</nav></body>", None) == whole
    if "class=sidebar" != attrs:
        assert html_text.extract(f"<article><div {attrs}><h1>Title</h1></div><p>one two three</p></article>", None) == whole


@pytest.mark.parametrize("attrs", ["class=sidebar", "class='x site-footer'", "id=cookie-banner", "class=relatedPosts", "role=search", "class='comment-list'", "class=reader-comments", "id=disqus_thread", "class=commentlist", "class='ad-slot'", "class=blog-post-comments", "class=imageNavigation", "class=legal-notice"])
def test_html_words_of_boilerplate(attrs):
    assert html_text.extract(f"<body><div class=post><p>{LONG_BODY}</p></div><div {attrs}><p>not this text</p></div></body>", None) == LONG_BODY.strip()


@pytest.mark.parametrize("name", ["post-header", "entry-header", "content-header", "section-header"])
def test_html_keeps_headers_of_parts(name):
    page = f"<body><div class=post><div class={name}><h1>Title</h1></div><p>{LONG_BODY}</p></div><div class=header>Site name</div></body>"
    assert html_text.extract(page, None) == f"Title\n\n{LONG_BODY.strip()}"


def test_html_when_all_is_boilerplate():
    assert html_text.extract("<body><div class=sidebar><p>a b c</p></div><div class=widget><p>d e f</p></div><nav>g</nav></body>", None) == "a b c\n\nd e f"
    assert html_text.extract("<body><footer><p>a b c</p></footer></body>", None) == "a b c"
    assert html_text.extract("<body><form><nav>menu</nav><div><p>a b c</p></div></form></body>", None) == "a b c"


def test_html_containers_below_long_paths(spark):
    wide = "".join(f"<div class='{' '.join(f'utility-{c}{d}' for c in 'abcdefghijklmnop')}'>" for d in "xyz")
    page = f"<body>{wide}<div class=story><p>{{}}</p></div><div class=more><p>{{}}</p></div></body>"
    _, blocks = html_text.parse(page.format("a b c", "d e f"))
    assert len({b.home.path for b in blocks}) == 2 and all(len(n.path) <= html_text.MAX_PATH for b in blocks for n in html_text._up(b.node))
    story = next(b.home.path for b in blocks if b.text == "a b c")
    assert html_text.extract(page.format("short", "other words " * 30), story) == "short"
    # by the votes of a host
    rows = [(i, "http://h.com/a", f"<body>{wide}<div class=story><p>{LONG_BODY}</p></div></body>") for i in range(3)] + [(9, "http://h.com/a", page.format("short", "other words " * 30))]
    out = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == "short"


def test_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/en", "allow"), (None, "/", "block"), ("b.net", None, "allow"), ("a.net", "/en", "allow")], "host string, path string, verdict string")
    rows = [(1, "http://x.A.NET/english"), (2, None), (3, "no scheme.net/"), (4, "http://c.net"), (5, "http://c.net/?q=://a.net/en"), (5, "http://c.net/?q=://a.net/en"), (None, "https://b.net")]
    out = url_filter.filter_urls(clash(spark.createDataFrame(rows, "page_id long, url string")), rules).collect()
    assert len(out) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert by[1] == ("x.a.net", "/english", "a.net/en", "allow") and by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("c.net", "", None, "allow") and by[5] == ("c.net", "/", "net/", "block") and by[None] == ("b.net", "", "b.net", "allow")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_ann(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], 0) for i in range(200)]
    rows += [(500, None, 1), (501, [0.0, 0.0, 0.0], 1), (502, [1.0, None, 1.0], 1), (503, [1.0, float("nan"), 1.0], 1), (504, [1.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (0, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, schema).withColumns({n: F.lit(7) for n in ("id", "v", "part", "slot", "score", "rank")})
    out = ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert {r.query_id for r in out} == set(range(0, 200, 20)) and max(r.rank for r in out) == 5
    assert all(r.vec_id != r.query_id and r.vec_id < 500 for r in out)
    tied = sorted((r.rank, r.vec_id) for r in out if r.query_id == 20)
    assert [v for _, v in tied] == sorted(v for _, v in tied)  # 20 % 7 == 6: equal scores in order of the id
    assert ann.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert ann.search(spark.createDataFrame(rows[:1], schema), F.lit(True)).count() == 0
