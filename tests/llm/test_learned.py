"""Learned operators, pieces, and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm import decontam, html, jaccard, linededup, pieces, toxicity
from tidemark.llm.common import slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n, seed=1):
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    rows = []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(10, 160))]
        bad = i % 3 == 0
        for _ in range(1 + len(w) // 40 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vexgrub", "snarfle", "Grobnik!"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_gradients_are_right():
    words = toxicity.Words(*[(d, o) for _, _, d, o in slices(pa.array(["ab cd ef gh", "ij kl " * 20], pa.string()))][0])
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    start, size, text = words.windows()
    target, weigh = np.array([1.0, 0.0, 0.0])[: len(start)], np.ones(len(start))

    def loss():
        z = net.forward(net.inputs(words), start, size)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    g, _ = net.gradients(words, start, size, target, weigh)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        flat = np.flatnonzero(g[k].ravel()) if k in ("word", "gram") else np.arange(v.size)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            old = v.ravel()[i]
            v.ravel()[i] = old + 1e-3
            up = loss()
            v.ravel()[i] = old - 1e-3
            down = loss()
            v.ravel()[i] = old
            assert abs((up - down) / 2e-3 - g[k].ravel()[i]) < 2e-4 + 0.02 * abs(g[k].ravel()[i]), k


def test_windows_cover_whole_texts():
    text = " ".join(f"w{i}" for i in range(100))
    words = toxicity.Words(*[(d, o) for _, _, d, o in slices(pa.array([text, "", "one"], pa.string()))][0])
    start, size, owner = words.windows()
    seen = {w for s, n, o in zip(start, size, owner) if o == 0 for w in range(s, s + n)}
    assert seen == set(range(100)) and (size[1:3] == toxicity.WINDOW).all()
    assert owner.tolist().count(2) == 1 and 1 not in owner


def test_toxicity_held_out(spark):
    rows = corpus(700)
    docs = spark.createDataFrame([(i, t, None, None, len(t), "clash") for i, t, _ in rows] + [(9001, None, None, None, 0, ""), (9002, " .. ", None, None, 4, "")], DOCS)
    labels = spark.createDataFrame([(i, m, None) for i, _, m in rows] + [(9003, None, 1)], "doc_id long, toxic int, quality int")
    net = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["_score"] for r in toxicity.score(docs.select("doc_id", "text"), net).collect()}
    out = [(got[i] >= 0.5) == bool(m) for i, _, m in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(out) > 0.9
    assert got[9001] == got[9002] == toxicity.EMPTY_SCORE
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r["_score"] for r in toxicity.score(docs.select("doc_id", "text"), None).collect()} == {toxicity.EMPTY_SCORE}


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li>'
    '</ul></nav><!-- x --><div class="ad">Buy &amp; go</div><article><h1>Head {0}</h1><p><b>Text&nbsp;one &lt;{0}&gt;<br>more\n text.</b></p>'
    "<p>Second paragraph here, {0}.</p></article><footer>&copy; me</footer></body></html>"
)


def test_html(spark):
    rows = [(i, f"u{i}", PAGE.format(i)) for i in range(60)] + [(90, None, None), (91, "u", ""), (92, "u", "<div class='ad'>only this</div>"), (93, "u", PAGE.format(7).split("<footer>")[0] + "<foo")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()}
    for i in range(60):
        assert got[i]["text"] == f"Head {i}\n\nText one <{i}> more text.\n\nSecond paragraph here, {i}."
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[90]["text"] == got[91]["text"] == got[92]["text"] == "" and got[90]["n_chars"] == 0
    assert got[93]["text"] == got[7]["text"]


def test_blocks_of_broken_markup():
    texts = [b.text for b in html.blocks("a<b>b</b> c<p>d<p>e<script>x<p>y</script>f<div title='>'>g</div><br>h<!-- no --")]
    assert texts == ["ab c", "d", "ef", "g", "h"]
    assert html.blocks("<style>p{}") == [] and html.blocks("<") == html.blocks("<")[:1]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces()


def brute_path(model, text):
    """Best score of any path over the pieces, by plain dynamic programming."""
    known = {model.text[i]: float(model.scores[i]) for i in model.ids.tolist()}
    best = [0.0] + [-1e300] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - model.longest), e):
            value = known.get(text[s:e])
            if value is None and e - s == 1:
                value = model.fallback
            if value is not None:
                best[e] = max(best[e], best[s] + value)
    return best[-1]


def path_score(model, text, ids):
    total, raw = 0.0, bytearray()
    for i in [*ids, None]:
        if i is not None and i in model.bytes.values():
            raw.append([b for b, x in model.bytes.items() if x == i][0])
            continue
        total += model.fallback * len(raw.decode().replace(pieces.MARK, "x"))
        raw.clear()
        if i is not None:
            total += float(model.scores[i])
    return total


TEXTS = ["hello world", "a  b\n\tc", " lead and trail ", "▁ mark ▁▁ kept", "naïve façade 梦梦 \U0001f600", "x", "  ", "tokenization of uncommonlylongwordswithoutspaces"]


def test_units_are_best_paths_and_round_trip(model):
    for t, ids in zip(TEXTS, pieces.Encoder(model).encode(TEXTS).to_pylist()):
        assert model.decode(ids) == t
        assert abs(path_score(model, pieces.marked(t), ids) - brute_path(model, pieces.marked(t))) < 1e-6, t
    assert pieces.Encoder(model).encode(["", "a"]).to_pylist()[0] == []


def test_chunks_give_the_same_score(model):
    rng = random.Random(8)
    mixed = "".join(rng.choice("the and ing tion é \n▁") for _ in range(900))
    for size, text in ((40, mixed), (257, mixed), (40, mixed.replace(" ", "x")), (200, mixed.replace(" ", "x"))):
        text = pieces.marked(text)
        cuts = list(range(0, len(text), size))
        part = [text[c : c + size + model.longest - 1] for c in cuts]
        sizes = [min(size, len(text) - c) for c in cuts]
        scorer = pieces.Encoder(model, scores=True)
        matrices = [pieces.transfer(scorer, p, n) for p, n in zip(part, sizes)]
        states = pieces.boundary_states(matrices)
        spans = [p[states[k] : n + states[k + 1]] for k, (p, n) in enumerate(zip(part, sizes))]
        ids = [i for row in pieces.Encoder(model).encode_marked(spans).to_pylist() for i in row]
        assert model.decode(ids) == text[1:].translate({ord(pieces.MARK): " ", ord(pieces.OWN_MARK): pieces.MARK})
        assert abs(path_score(model, text, ids) - brute_path(model, text)) < 1e-6


def test_encode_table(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 300)
    rng = random.Random(2)
    long = "".join(rng.choice("lorem ipsum dolor ") for _ in range(2500))
    rows = [(i, t, None, None, 1, "") for i, t in enumerate([*TEXTS, None, "", long, long])]
    got = {r["doc_id"]: r for r in pieces.encode(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows) and all(r["round_trip"] for r in got.values())
    assert got[8]["n_pieces"] == got[9]["n_pieces"] == 0 and got[10]["ids"] == got[11]["ids"]
    assert pieces.encode(spark.createDataFrame([], DOCS)).collect() == []


def test_pipeline(spark, tmp_path):
    rows = corpus(500, seed=6)
    item = " ".join(f"bench{i}" for i in range(30))
    texts = {i: t for i, t, _ in rows}
    texts[1000], texts[1001] = texts[1], f"prefix words {item} more words"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, m) for i, _, m in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1001 not in left and not {1, 1000} <= set(left)
    toxic = [i for i, _, m in rows if m]
    clean = [i for i, _, m in rows if not m]
    assert np.mean([i in left for i in clean]) > 0.9 and np.mean([i in left for i in toxic]) < 0.2
    assert all(r["round_trip"] for r in left.values())


ARTICLE = "<article><p>Hello there.</p><p>More text here.</p></article>"


@pytest.mark.parametrize("before", [
    "<datalist><option value=a>A<option value=b>B</datalist>", "<button>Menu", "<button>One <button>Two</button>",
    "<select><option>x<option>y", "<object><object>in</object>fallback</object>", "<svg><title>t</title><g><svg><path d=''/></svg>text</g></svg>",
    "<svg/>", "<template><div>t<template>u</template>v</div></template>", "<noscript><div>on</div></noscript>",
    "<button><div>Deep</div></button>", "<div><noscript>open</div>", "<script>a</script>", "<svg><circle r=1 />",
])
def test_no_element_swallows_an_article(before):
    assert [b.text for b in html.blocks(before + ARTICLE)] == ["Hello there.", "More text here."]


def test_pages_without_a_marked_container():
    net = html.train(["<div>one</div><div>two</div>"])
    assert html.main_text(net, ["<nav>Home</nav><div><p>Hello there.</p><p>Yes.</p></div>", "", "<nav>x</nav>"]) == ["Hello there.\n\nYes.", "", ""]


def test_the_space_mark_itself_comes_back():
    p = pieces.Pieces()
    encoder = pieces.Encoder(p)
    texts = ["a\U0010ffffb", "▁", " ▁ ▁▁  x", "a▁b c", "\U0010ffff\U0010fffe", "▁" * 50]
    assert [p.decode(ids) for ids in encoder.encode(texts).to_pylist()] == texts


def test_stages_tell_rows_apart(spark, tmp_path):
    """Null ids, ids that come twice, and columns of clashing names: no row is lost, none gets another's text."""
    long_ = " ".join(f"word{i}" for i in range(60))
    rows = [
        (None, "A first line that stays here.", "x", 7), (2, "Another line of its own kind.", "y", 7), (2, "A third text under the same id.", "z", 8),
        (None, long_, "n", 1), (2**60 + 1, long_ + " end", "n", 2), (5, None, "e", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string, n_chars long")
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def texts(df):
        assert df.columns == docs.columns
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["_score"]) for r in df.collect())

    want = sorted((r[0] is None, r[0] or 0, r[1] or "", r[2]) for r in rows)
    lines = texts(linededup.stage(spark, docs, str(tmp_path)))
    assert [w for w in want if w[3] != "n"] == [x for x in lines if x[3] != "n"] and 1 <= sum(x[3] == "n" for x in lines) <= 2
    near = texts(jaccard.stage(spark, docs, str(tmp_path)))
    assert len(near) == 5 and [w for w in want if w[3] != "n"] == [x for x in near if x[3] != "n"]
    assert texts(decontam.stage(spark, docs, str(tmp_path))) == [w for w in want if w[3] != "n"]
    linked = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.link(docs).collect()}
    assert linked[2**60 + 1, 58] == linked[None, 57] == 2**60 + 1 and len(linked) == 6
    assert texts(toxicity.score(docs, None, "__score").drop("__score")) == want
    empty = docs.limit(0)
    for stage in (linededup.stage, jaccard.stage, decontam.stage, pieces.stage):
        assert stage(spark, empty, str(tmp_path)).collect() == []
