import io
import json
import math
import random
import re
import time
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chat, html_text, mixing, pieces, toxicity
from test_groups import brute_components


# --- toxicity


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    trans = rng.normal(size=3)
    for n in (1, 2, 5):
        e = rng.normal(size=n)
        weight = {}
        for tags in product((0, 1), repeat=n):
            # A chain starts from a clean state.
            s = sum(x for x, t in zip(e, tags) if t)
            for a, b in zip((0, *tags), tags):
                s += trans[0] if a and b else trans[1] if a else trans[2] if b else 0
            weight[tags] = np.exp(s)
        z = sum(weight.values())
        want = [sum(w for t, w in weight.items() if t[i]) / z for i in range(n)]
        assert toxicity.marginals([e], trans)[0] == pytest.approx(want)


def test_marginals_shortcut_is_exact():
    rng = np.random.default_rng(2)
    seqs = [np.where(rng.random(n) < 0.02, rng.normal(size=n) * 4, -6.0) for n in (0, 1, 3, 50, 400, 3000, 20_000)] + [np.full(500, -6.0)]
    trans = np.array([0.7, -0.4, -0.6])
    for a, b in zip(toxicity.marginals(seqs, trans), toxicity.marginals(seqs, trans, -6.0)):
        assert np.allclose(a, b, atol=1e-13)


def test_families_are_confirmed():
    """Unlike documents that share a band stay apart; copies do not."""
    common = {f"c{i}" for i in range(20)}
    docs = [common | {f"d{n}x{i}" for i in range(40)} for n in range(200)]
    docs += [(docs[7] - {"d7x0"}) | {"new"}, set(docs[9]), set()]
    got = toxicity._families(docs, np.random.default_rng(7)).tolist()
    assert got == [*range(200), 7, 9, 202]


def labelled(n, seed=0):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vilum", "krakzot", "krakzin", "krakzer"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learns_spans_and_scores(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(5000, None, "en", "s", 0), (None, "", "en", "s", 0), (5001, "ok krakzot there", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    assert sum((got[i].score >= 0.3) == bool(y) for i, y in truth.items()) / len(truth) > 0.98
    assert got[5001].score >= 0.3 and [(s["start"], s["end"]) for s in got[5001].spans] == [(3, 10)]
    assert got[5000].score < 0.3 and got[None].score < 0.3
    stay = toxicity.reject_toxic(docs, model)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {i for i, r in got.items() if r.score < 0.3}
    assert toxicity.tag(docs.where("false"), model).count() == 0
    none = toxicity.learn(docs, labels.where("false"))
    assert all(r.score < 1e-9 for r in toxicity.tag(docs, none).collect())


def test_query_against_plain_recursions(spark, tmp_path):
    """Every column of the registered query, by sums over both states at each token of each whole text."""
    import zlib

    rows = labelled(400, 6) + [(9000, "Vilum ok krakzot", 1), (9001, "", 0), (9002, "ok " * 3000 + "krakzin", 1)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    field = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    tt, tc, ct = (math.exp(x) for x in field.trans)
    assert set(got) == {i for i, _, _ in rows}
    for i, text, _ in rows:
        emit = [math.exp(field.bias + sum(field.weights.get(f, 0.0) for f in toxicity.features(w))) for w in re.findall(r"\w+", text.lower())]
        ahead, back = [], [(1.0, 1.0)]
        for e in emit:  # weights of ending clean and toxic, from a clean start
            c, t = ahead[-1] if ahead else (1.0, 0.0)
            c, t = c + t * tc, (c * ct + t * tt) * e
            ahead.append((c / (c + t), t / (c + t)))
        for e in reversed(emit[1:]):
            c, t = back[-1]
            c, t = c + ct * e * t, tc * c + tt * e * t
            back.append((c / (c + t), t / (c + t)))
        p = [b * y / (a * x + b * y) for (a, b), (x, y) in zip(ahead, reversed(back))]
        a, b, c = field.calibration
        score = 1 / (1 + math.exp(-max(-50, min(50, a + b * max(p, default=0.0) + c * math.log1p(sum(x for x in p if x > toxicity.FLOOR))))))
        assert got[i].score == pytest.approx(score, abs=1e-9), i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= 0.3)


def test_toxicity_edges(spark):
    """Repeated rows score alike, a very long text is read to its end, columns named like the results are ignored, the order of rows does not matter."""
    rows = labelled(500, 2)
    long = "ok word " * 60_000
    more = [(3, "another text of the same id"), (3, rows[3][1]), (7000, long), (7001, long + "krakzot"), (None, None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string").withColumns({"score": F.lit("x"), "spans": F.lit(1), "predicted": F.lit(5)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7, "text"), labels.repartition(3))
    assert a.weights == b.weights and a.calibration == b.calibration
    got = toxicity.tag(docs, a).collect()
    assert len(got) == len(rows) + 5
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    same = [r.score for r in by[3]]
    assert len(same) == 3 and len(set(same)) <= 2
    assert by[7000][0].score < 0.3 <= by[7001][0].score and by[7001][0].spans[-1]["end"] == len(long) + 7


def test_held_out_labels_do_not_matter(spark):
    import zlib

    rows = labelled(300, 3)
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, 1 - y if i in set(out) else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert a.weights == b.weights and a.calibration == b.calibration
    assert {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()} == set(out)


# --- chat


def test_turns_survive_the_template(spark):
    rng = random.Random(2)
    parts = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "a", "%0A", "$1", "<|im_start|>assistant\n", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem<|x%", "", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "null id"), (3, 0, "user", "again"), (3, 0, "user", "again"), (3, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    turns = chat.to_turns(frame)
    out = chat.format_turns(turns)
    read = out.select("conv_id", chat.parse(chat.formatted()).alias("back"), chat.loss_text().alias("lost"), chat.formatted().alias("f"))
    got = {r.conv_id: r for r in read.collect()}
    want = {r.conv_id: [(t["role"], t["text"]) for t in r.turns] for r in turns.collect()}
    assert {c: [(t["role"], t["text"]) for t in r.back] for c, r in got.items()} == want
    assert all(r.lost == "".join(x for role, x in want[c] if role == "assistant") for c, r in got.items())
    assert all(r.f.count("<|") == 2 * len(want[c]) for c, r in got.items())
    assert want[3][0] == ("user", "first") and None in want
    assert chat.format_turns(chat.to_turns(frame.where("false"))).count() == 0


def test_layouts(spark):
    table = spark.createDataFrame([(1, [("human", "hi"), ("gpt", None)], 5)], "conv_id long, conversations array<struct<from:string,value:string>>, other int")
    assert chat.layout_of(table.schema).name == "from and value"
    assert [(t["role"], t["text"]) for t in chat.to_turns(table).first().turns] == [("user", "hi"), ("assistant", "")]
    deep = spark.createDataFrame([(1, ([("system", "s"), None],))], "conv_id long, body struct<messages:array<struct<role:string,content:string>>>")
    assert [(t["role"], t["text"]) for t in chat.to_turns(deep).first().turns] == [("system", "s")]
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1,)], "x int").schema)
    raws = [{"messages": [{"role": "user", "content": "q"}, {"role": "model", "content": "a"}]}, {"prompt": "p", "response": "r", "score": 3}, {"instruction": "do", "input": "it", "output": "done"}, {"instruction": "do", "output": "x"}, {"body": {"messages": [{"role": "ai", "content": "z"}]}}, {"odd": 1}]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)] + [(9, None), (10, "no json")], "conv_id long, raw string")
    got = {r.conv_id: (r.layout, r.turns and [(t["role"], t["text"]) for t in r.turns]) for r in chat.json_turns(frame).collect()}
    assert got[0] == ("messages", [("user", "q"), ("assistant", "a")]) and got[1] == ("prompt and response", [("user", "p"), ("assistant", "r")])
    assert got[2] == ("instruction and input", [("user", "do\n\nit"), ("assistant", "done")]) and got[3][1] == [("user", "do"), ("assistant", "x")]
    assert got[4] == ("nested messages", [("assistant", "z")]) and got[5] == (None, None) and got[9] == (None, None) and got[10] == (None, None)


def test_layouts_go_through_the_hash(spark, monkeypatch):
    """With a broken hash no layout is found, not even that of the registered query's table."""
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    more = spark.createDataFrame([(1, [("user", "q")], "p")], "conv_id long, messages array<struct<role:string,content:string>>, prompt string")
    monkeypatch.setattr(chat, "fingerprint", lambda paths: "0")
    for frame in (rows, more):
        with pytest.raises(ValueError):
            chat.to_turns(frame)


def test_very_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "<|x " * 20_000 if t < 2 else f"turn {t}") for t in range(3000)]
    out = chat.format_turns(chat.to_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    r = out.select(chat.parse(chat.formatted()).alias("back"), chat.loss_text().alias("lost")).first()
    assert [(t["role"], t["text"]) for t in r.back] == [x[2:] for x in rows]
    assert r.lost == "".join(x[3] for x in rows if x[2] == "assistant")


def test_layouts_among_other_paths(spark):
    """Turn rows are found by their hash; further known fields, empty arrays and messages without a key lose no conversation."""
    rows = spark.createDataFrame([(1, 0, "user", "x", 5)], "conv_id long, turn long, role string, text string, other int")
    assert chat.BY_FINGERPRINT[chat.fingerprint(set(chat.schema_paths(rows.schema)) & chat.VOCABULARY)].name == chat.layout_of(rows.schema).name == "turn rows"
    more = spark.createDataFrame([(1, [("user", "q")], "p")], "conv_id long, messages array<struct<role:string,content:string>>, prompt string")
    assert chat.layout_of(more.schema).name == "messages"
    raws = [{"messages": []}, {"messages": [{"role": "user"}, {"role": "model", "content": "a"}]}, {"messages": [{"role": "user", "content": "q"}], "prompt": "p"}, {"instruction": "do", "input": "it", "output": "done", "system": "s"}]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "conv_id long, raw string")
    got = {r.conv_id: (r.layout, r.turns and [(t["role"], t["text"]) for t in r.turns]) for r in chat.json_turns(frame).collect()}
    assert got == {0: ("messages", []), 1: ("messages", [("user", ""), ("assistant", "a")]), 2: ("messages", [("user", "q")]), 3: ("instruction and input", [("user", "do\n\nit"), ("assistant", "done")])}


# --- mixing


def test_mixing_follows_poisson(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 5000, "big").when(F.col("id") < 5900, "small").alias("source"), F.lit(1).alias("copy"))
    weights = spark.createDataFrame([("big", 0.5), ("small", 0.25), (None, 0.25)], "source string, weight double")
    got = mixing.mix_sources(frame, weights).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert n["big"] == pytest.approx(3000, abs=250) and n["small"] == pytest.approx(1500, abs=160) and n[None] == pytest.approx(1500, abs=160)
    again = mixing.mix_sources(frame, weights)
    assert sorted(r.shuffle_key for r in again.collect()) == sorted(r.shuffle_key for r in mixing.mix_sources(frame.repartition(3), weights).collect())
    counts = [r[0] for r in again.where("source is null").groupBy("doc_id").count().select("count").collect()]
    assert np.var(counts) == pytest.approx(15, rel=0.5)  # mean 15: no more and no less than Poisson
    none = mixing.mix_sources(frame, weights.where("source = 'big'"))
    assert {r.source for r in none.select("source").distinct().collect()} == {"big"}
    assert mixing.mix_sources(frame.where("false")).count() == 0


def test_mixing_large_means_and_many_sources(spark, monkeypatch):
    frame = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    total = mixing.mix_sources(frame, epochs=300).count()
    assert total == pytest.approx(12_000, rel=0.05)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert mixing.mix_sources(frame, epochs=300).count() == total


def test_mixing_repeated_and_nameless_rows(spark):
    """Rows without doc_id are drawn by their texts, each for itself; rows that repeat both get the same count each."""
    rows = [(None, f"text {i}", "s") for i in range(400)] + [(None, None, "s")] * 3 + [(7, "b", "t")] * 5 + [(8, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame)
    counts = {(r.doc_id, r.text): r["count"] for r in got.groupBy("doc_id", "text").count().collect()}
    assert counts == {(r.doc_id, r.text): r["count"] for r in mixing.mix_sources(frame.repartition(5)).groupBy("doc_id", "text").count().collect()}
    drawn = [counts.get((None, f"text {i}"), 0) for i in range(400)]
    assert np.mean(drawn) == pytest.approx(np.var(drawn), rel=0.35) and len(set(drawn)) > 1
    assert counts.get((None, None), 0) % 3 == 0 and counts.get((7, "b"), 0) % 5 == 0


# --- pages


@pytest.fixture(scope="module")
def models():
    return html_text.trained()


def blocks_found(models, pages):
    """Precision and recall of blocks on made-up pages."""
    mark = html_text._MARK
    want = [Counter(x.replace(mark, "") for x in html_text.Tree(p).text if mark in x) for p in pages]
    got = [Counter(g.split("\n\n") if g else []) for g in html_text.extract([p.replace(mark, "") for p in pages], models)]
    both = sum((a & b).total() for a, b in zip(want, got))
    return both / sum(b.total() for b in got), both / sum(a.total() for a in want)


def test_made_up_pages(models):
    rng = random.Random(77)
    assert min(blocks_found(models, [html_text.sample_page(rng, 0.0) for _ in range(150)])) > 0.99
    assert min(blocks_found(models, [html_text.sample_page(rng, 1.0) for _ in range(150)])) > 0.95  # names that mean nothing


def test_layout_not_trained_on():
    """Articles in tables and in bare bodies, left out of the training, are found all the same."""
    rng = random.Random(3)
    pages = [html_text.sample_page(rng) for _ in range(900)]
    unseen = lambda p: "<table><tr><td" in p or "<main" in p
    trees = [html_text.Tree(p) for p in pages if not unseen(p)]
    some, pure = html_text._labels(trees)
    x = html_text.node_features(trees)
    keep = x[:, 0] > 0
    models = html_text.Boosted(30).fit(x[keep], some[keep]), html_text.Boosted(30).fit(x[keep & (some > 0)], pure[keep & (some > 0)])
    assert min(blocks_found(models, [p for p in pages if unseen(p)])) > 0.85


def test_shipped_model():
    """The file belongs to this code, and loading it gives what was fitted."""
    with np.load(html_text.MODEL) as held:
        assert str(held["made_by"]) == html_text.recipe(2000, 11)
    small = html_text.fit(60, 1)
    x = html_text.node_features([html_text.Tree(html_text.sample_page(random.Random(2)))])
    with np.load(io.BytesIO(html_text.save(small, "x"))) as held:
        for i, m in enumerate(small):
            again = html_text.Boosted()
            again.start = float(held["start"][i])
            for p in html_text._PARTS:
                setattr(again, p, held[f"{p}{i}"])
            assert (again.predict(x) == m.predict(x)).all()


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    few, many = html_text.Boosted(3).fit(x[:3000], y[:3000]), html_text.Boosted(60).fit(x[:3000], y[:3000])
    right = lambda m: ((m.predict(x[3000:]) > 0.5) == y[3000:]).mean()
    assert right(many) > 0.95 and right(many) > right(few)


def test_decoding_against_all_labellings():
    """Small trees: the decoder's answer is that of the best of all consistent labellings."""
    rng = random.Random(6)
    for _ in range(60):
        page = "".join(rng.choice(["<div>", "</div>", "<ul><li>", "<p>", "x", "yy ", "</ul>"]) for _ in range(9))
        t = html_text.Tree(page)
        n = len(t.kind)
        if n > 8:
            continue
        some, pure = [rng.uniform(0.05, 0.95) for _ in range(n)], [rng.uniform(0.05, 0.95) for _ in range(n)]
        full = [sum(t.chars[j] for j in range(i, t.end[i] + 1)) for i in range(n)]
        best = None
        for states in product((0, 1, 2), repeat=n):  # none, mixed, whole
            if any(states[t.parent[i]] != 1 and states[i] != states[t.parent[i]] for i in range(1, n)) or any(s == 1 and t.kind[i] == 0 and full[i] for i, s in enumerate(states)):
                continue
            worth = 0.0
            for i, s in enumerate(states):
                if full[i]:
                    worth += math.log(1 - some[i]) if s == 0 else math.log(some[i]) + (0 if t.kind[i] == 0 else math.log(pure[i] if s == 2 else 1 - pure[i]))
            if best is None or worth > best[0]:
                best = worth, [s == 2 for s in states]
        main = html_text.decode(t, some, pure)
        assert [m for m, c in zip(main, t.chars) if c] == [m for m, c in zip(best[1], t.chars) if c], page


def test_white_space_references_and_details(models):
    said = lambda page: [x for x in html_text.Tree(page).text if x]
    assert said("<p>a\u2003b\u2009\u00a0c\u3000</p>") == ["a b c"]
    assert said("<p>&am<b>p;</b> &lt;&#x41; &am<!-- -->p;</p>") == ["&amp; <A &amp;"]
    page = "<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title of it</h1><p>First paragraph of the article, with words.</p><details><summary>More of it</summary>Hidden words, but words of the article.</details><p>Last paragraph, and it ends.</p></article><footer>&copy; x</footer>"
    assert html_text.extract([page], models) == ["Title of it\n\nFirst paragraph of the article, with words.\n\nMore of it\n\nHidden words, but words of the article.\n\nLast paragraph, and it ends."]
    assert said("<p title=don't>it's</p><p title='a>b' alt=\"<p>\">b</p>") == ["it's", "b"]


@pytest.mark.parametrize("part", ["<p ", "<title ", "<div><li>", '<p a="', "<p '", "<div>", "<svg ", "<svg><desc ", "&am", "</p ", "<li>", "<!-- ", "x<b y "])
def test_malformed_pages_take_linear_time(part):
    start = time.perf_counter()
    html_text.Tree(part * 80_000)
    assert time.perf_counter() - start < 2


def test_pages_by_hand(models):
    body = "<p>First &amp; <b>bold</b>\n\t text, with several words in it, as articles have.<br>More of it.<p>Second paragraph: it goes on for a while, and then it ends &#233;.</p>"
    page = f'<html><head><title>T</title><script>var x="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a><li><a href="/a">News</a></ul></nav><!-- <p>no</p> --><article><h1>A title of words</h1>{body}<div class="ad"><p>Buy now</p></div></article><div class="comments"><p>I liked it a lot.</p></div><footer>&copy; someone</footer>'
    want = "A title of words\n\nFirst & bold text, with several words in it, as articles have. More of it.\n\nSecond paragraph: it goes on for a while, and then it ends é."
    assert html_text.extract([page], models) == [want]
    assert html_text.extract([None, "", "<", "<p", "plain"], models)[:2] == ["", ""]
    assert html_text.extract([], models) == []


def test_optional_and_empty_tags():
    """A head without an end tag, empty and unclosed SVG and MathML, and names that only begin alike hide nothing after them."""
    kept = "<article><p>Kept words.</p></article>"
    for before in (
        "<head><meta charset=utf-8><title>no</title><style>no</style><body>",
        "<html><head><script>no</script>",
        '<svg class="x" />',
        "<p><math/></p>",
        '<div><svg viewBox="0 0 1 1"><path d="M0"></div>',
        "<svg><title>no</title><foreignObject><p>no</p></foreignObject><text>no</text></svg>",
        "<math><mtext><b>no</b></mtext><mi>no</mi></math>",
        "<svg><title>no<path></svg>",
        "<svg><path><![CDATA[<p>no]]><!-- <p>no --></svg >",
        "<svg-icon></svg-icon><object-view></object-view><title-bar></title-bar>",
    ):
        assert [x for x in html_text.Tree(before + kept).text if x] == ["Kept words."], before


def test_labelling_has_no_contradictions(models):
    rng = random.Random(5)
    for _ in range(40):
        t = html_text.Tree(html_text.sample_page(rng).replace(html_text._MARK, ""))
        n = len(t.kind)
        main = html_text.decode(t, [rng.random() for _ in range(n)], [rng.random() for _ in range(n)])
        for i in range(1, n):
            if main[t.parent[i]] and t.chars[i]:
                assert main[i]


def test_pages_table(spark):
    frame = spark.createDataFrame([(1, "u", "<article><h1>Some words here</h1><p>And a longer paragraph of words, with commas.</p></article>"), (None, None, None), (1, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_text.extract_pages(frame).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_pages(frame.where("false")).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    rows = labelled(250, 9)
    rows += [(1000 + i, rows[i][1], 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, str(tmp_path))
    lone = stage["near_duplicates"](spark, clean, str(tmp_path))
    mixed = stage["mixing"](spark, lone, str(tmp_path))
    assert clean.columns == lone.columns == mixed.columns == docs.columns
    bad = {i for i, _, y in rows if y}
    kept = {r.doc_id for r in clean.collect()}
    assert len(kept & bad) <= 2 and len(kept) >= len(rows) - len(bad) - 25
    assert not {r.doc_id for r in lone.collect()} & {i for i in range(1000, 1020) if i - 1000 in kept}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == mixed.count() and out.where("not restored").count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, further columns with clashing names, an empty table."""
    rows = [(i, t, "en", "a", 1) for i, t, _ in labelled(60, 3)] + [(None, None, None, None, None), (None, "no id at all", None, None, None), (5, "", "en", "a", 0), (900, "same words here again and again", "en", "b", 3), (900, "same words here again and again", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "near_key": F.lit("k"), "rep": F.lit(2), "copy": F.lit(0)})
    labels = spark.createDataFrame([(i, None, y) for i, _, y in labelled(60, 3)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    for name, part in (("full", docs), ("none", docs.where("false"))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == (name == "full") and all(r.restored for r in out)
    stage = dict(corpus_pipeline.STAGES)
    read = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    clean = stage["toxicity"](spark, read, f"{tmp_path}/full")
    lone = stage["near_duplicates"](spark, clean, f"{tmp_path}/full")
    assert lone.columns == stage["mixing"](spark, lone, f"{tmp_path}/full").columns == read.columns
    assert lone.where("doc_id = 900").count() == 1 and lone.where("doc_id is null").count() == 2


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's decision, row by row: scores by the field itself, groups by all pairs, copies by the rates, ids by one text at a time."""
    rows = labelled(200, 4)
    rows += [(2000 + i, rows[i][1], 0) for i in range(30)] + [(3000 + i, rows[i][1] + " two more", 0) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage, where = dict(corpus_pipeline.STAGES), str(tmp_path)
    field = toxicity.learn(docs, labels)
    score = {i: field.score(field.marginals([t])[0]) for i, t, _ in rows}
    clean = stage["toxicity"](spark, docs, where)
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {i for i, s in score.items() if s < toxicity.THRESHOLD}
    lone = {r.doc_id for r in stage["near_duplicates"](spark, clean, where).collect()}
    groups = brute_components([(i, t) for i, t, _ in rows if i in kept], 5)
    assert lone == {i for i, (n, low) in groups.items() if low == i}
    out = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in out} <= lone
    text, coder = {i: t for i, t, _ in rows}, pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(np.asarray(r.ids, "<i4").tobytes() == coder.encode([text[r.doc_id]])[0] for r in out)
    counts = Counter(r.doc_id for r in out)
    mixed = Counter(r.doc_id for r in stage["mixing"](spark, docs.where(F.col("doc_id").isin(sorted(lone))), where).collect())
    assert counts == mixed
