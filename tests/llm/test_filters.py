"""Language, toxicity, page text and vectors: held-out accuracy and brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from brimwatch.llm import density, language, toxicity, vectors


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_messy(messy, nothing):
    rows = {r.doc_id: r for r in language.identify(messy).collect()}
    for i in (6, 7, 8, 12):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[9].lang_pred in ("en", "de") and not rows[None].held_out
    assert language.identify(nothing).collect() == []


def test_bit_slices_beyond_one_word():
    """Seventy languages need two slices; each n-gram names all of its languages."""
    shape = language.Shape(sizes=(2,), slots=1 << 14)
    langs = [f"l{i:02d}" for i in range(70)]
    parts = [np.zeros(shape.slots, np.uint64) for _ in range(2)]
    for i in (3, 66):
        gram, _ = language._Text(["abc"]).grams(2)
        for slot in language._slots(gram, shape):
            parts[i // 64][slot] |= np.uint64(1 << (i % 64))
    filters = language.Filters(langs, parts, np.zeros(70), 0)
    got, score = language.decide(["abc", None, "zzz"], filters, shape)
    assert got == ["l03", "und", "l00"] and score.tolist() == [0.5, 0.0, 0.0]


def test_number_signs_are_no_letters():
    filters = language.Filters(["en"], [np.zeros(1 << 20, np.uint8)], np.zeros(1), 0)
    assert language.decide(["½ ² ③", "Ⅷ ٣", "word ½"], filters, language.Shape())[0] == ["und", "und", "en"]


def test_toxicity_catches_labelled_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    insults = ["blorfig", "snarkel", "grumpit"]
    rows, labels = [], []
    for i, r in enumerate(docs.orderBy("doc_id").collect()):
        for k in range(4):
            toxic = (i + k) % 5 == 0
            text = f"{r.text} {insults[(i + k) % 3]} {insults[k % 3]}, end" if toxic else r.text + " end"
            rows.append((4 * i + k, text))
            if (i + k) % 2 == 0:
                labels.append((4 * i + k, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, 1), (labels[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.classify(df, marks).collect()}
    want = {i: " end" in t and t.rsplit(" ", 2)[1].strip(",") in insults for i, t in rows}
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_toxicity_messy(spark, messy, nothing):
    marks = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(messy, marks).count() == messy.count()
    assert toxicity.classify(messy, marks.where("false")).where("toxic").count() == 0
    assert toxicity.classify(nothing, marks).collect() == []


def test_threshold_between_classes():
    p, y = np.array([0.9, 0.8, 0.1, 0.05]), np.array([1, 1, 0, 0])
    assert 0.1 < toxicity.best_threshold(p, y) < 0.8
    assert toxicity.best_threshold(p, np.zeros(4)) == 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>x</p>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies on this site, please accept all of them now.</p></div>
<div class="page"><div class="post"><h1>A title &amp; more</h1><div class="body">{body}</div></div></div>
<div class="sidebar"><p>Read these other stories that are of no importance at all.</p></div>
<form><p>Sign up for our letters</p><input name=q></form>
<section id="comments"><article class="comment"><p>I do not agree with a word of this article.</p></article></section>
<footer>&copy; Site</footer></body></html>"""


def test_article_without_the_rest():
    body = "".join(f"<p>Paragraph {i} has <b>bold</b> words and a <a href=x>link</a>, and goes on.</p>" for i in range(8))
    want = " ".join(["A title & more"] + [
        f"Paragraph {i} has bold words and a link, and goes on." for i in range(8)
    ])
    assert density.main_text(PAGE.replace("{body}", body)) == want


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("<nav>only</nav>", ""),
        ("plain", "plain"),
        ("<article><p><b>one<br><p>two &#x41;&amp</article>", "one two A&"),
        ("<p>a</p><![if x]><p>b", "a b"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x y 1 2"),
        ("<article><header><h1>t</h1></header>" + "<div>" * 3000 + "deep</article>", "t deep"),
    ],
)
def test_odd_pages(html, want):
    assert density.main_text(html) == want


PARAGRAPHS = "".join(f"<p>Paragraph {i} has some words, and goes on for a while.</p>" for i in range(5))
LINES = [f"Line {i} has some words, and goes on for a while." for i in range(5)]
TEXT = " ".join(f"Paragraph {i} has some words, and goes on for a while." for i in range(5))


@pytest.mark.parametrize(
    "html,want",
    [
        # Text directly in the body.
        ("<html><head><title>t</title></head><body>" + " ".join(LINES) + "</body></html>", " ".join(LINES)),
        ("<html><head></head><body>" + "<br>".join(LINES) + "<div id=footer>end</div></body></html>", " ".join(LINES)),
        ("<html><body>" + "<br><br>".join(LINES) + "<div><p>A note.</p><p>One more.</p></div></body></html>",
         " ".join([*LINES, "A note. One more."])),
        ("<body>Some <b>bold</b> text and a <a href=x>link</a> in it, and more words.</body>",
         "Some bold text and a link in it, and more words."),
        # A head that is not closed.
        ("<html><head><title>t</title><meta charset=utf-8><body>" + PARAGRAPHS + "</body></html>", TEXT),
        ("<html><head><title>t</title><div>" + PARAGRAPHS + "</div></html>", TEXT),
        ("<head><title>t</title><noscript><div>x</div></noscript><body><div>" + PARAGRAPHS + "</div>", TEXT),
        ("<head><title>t</title></title>Only text.", "Only text."),
        # A form around the whole page.
        ('<body><form id="form1"><input name=v><div><div>' + PARAGRAPHS + "</div></div></form></body>", TEXT),
        ("<body><form><nav><a href=x>Home</a></nav><article>" + PARAGRAPHS + "</article></form></body>", TEXT),
        ("<body><div>" + PARAGRAPHS + "</div><form><p>Sign up now</p><input name=q></form></body>", TEXT),
    ],
)
def test_ordinary_pages_without_article(html, want):
    assert density.main_text(html) == want


def test_pages_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    out = density.main_texts(pages.selectExpr("*", "1 text", "2 n_chars")).collect()
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in out)
    assert density.main_texts(pages.where("false")).collect() == []


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [b + rng.normal(scale=0.04, size=16) * s for b in base for s in (0, 1, 1, 2, 4)]
    rows += [base[0] + rng.normal(scale=0.03, size=16) for _ in range(300)]  # one large group
    rows += [rows[5], rows[5]]
    x = np.array(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    table = [(i, r.tolist(), 1) for i, r in enumerate(x)] + [(1000 + i, o, 2) for i, o in enumerate(odd)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, leaf int")
    shape = vectors.Forest(leaf=64, block=32, sample=512, levels=3)
    got = {r.vec_id: r for r in vectors.near_vectors(df, shape).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    true = near.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    for i in range(len(odd)):
        assert (got[1000 + i].n_links, got[1000 + i].component_id, got[1000 + i].kept) == (0, 1000 + i, True)
    assert got[len(x) - 1].component_id == got[5].component_id
    assert vectors.near_vectors(df.where("false")).collect() == []


def test_trees_are_added_for_one_tight_topic(spark):
    """Vectors of one topic, several split levels deep: six trees find two links in three."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    topic = unit(rng.normal(size=32))
    x = unit(np.sqrt(0.85) * topic + np.sqrt(0.15) * unit(rng.normal(size=(6000, 32))))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    shape = vectors.Forest(leaf=64, block=64, sample=2048)
    found = sum(r.n_links for r in vectors.near_vectors(df, shape).select("n_links").collect())
    assert 1000 < near.sum() and 0.93 * near.sum() <= found <= near.sum()


def test_language_works_on_little_text_at_a_time(monkeypatch):
    """Texts become arrays half a megabyte at a time, and a gram counts the same documents as before."""
    import pyarrow as pa

    from brimwatch.llm import common, language

    seen, read = [], language._Text
    monkeypatch.setattr(language, "_Text", lambda texts: seen.append(sum(map(len, texts))) or read(texts))
    texts = [f"wort {i} " * 8000 for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"lang": ["de"] * 20, "text": texts})
    rows = pa.Table.from_batches(list(language._counted(language.Shape())(iter([batch]))))
    assert len(seen) > 1 and max(seen) <= common.WORD_BYTES
    assert rows.column(3).to_numpy().max() <= 20 and rows.group_by(rows.column_names[:3]).aggregate(
        [(rows.column_names[3], "sum")]
    ).column(f"{rows.column_names[3]}_sum").to_numpy().max() == 20
