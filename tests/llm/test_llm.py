"""The training-data operators against brute force, exact round trips and planted cases."""

import hashlib
import math
import random
import re
import time
import zlib
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drivelens.llm import ann, bpe, dedup, html, langid, license, media, mixing, pii, toxicity
from drivelens.llm.license_texts import TEXTS
from drivelens.llm.common import connected_components, utf8_parts, word_hashes

WORDS = ["".join(p) for p in zip("abcdefghijklmnopqrst" * 30, "eiouaeioua" * 60, "nrstlmdkpb" * 60, strict=True)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "or", "en"]) + str(rng.randint(0, 99)) for _ in range(n))


def docs_of(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


AWKWARD = [None, "", " \n\t", "###", "x", "é" * 50, "a" * 40_000, "1" * 3000, "+1" * 500, "@" * 200, "word " * 9000, "\U0001f600 smile text"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "clash") for i, t in enumerate(AWKWARD * 2)]
    # extra columns whose names the operators use themselves
    return docs_of(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


# html


def test_html_default_labeller_reads_unlike_pages():
    page = """<html><head><title>no</title><script>var a="<p>no</p>"</script></head><body><div class="menu"><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></div>
    <div id="cookie-notice"><p>We use cookies.</p></div><article><h1>A  title</h1><p>First &amp; best<br>line.<p>Second <b>bold</b> text that goes on for a while.</p></article>
    <div class="comments"><h3>Comments</h3><div><p>great post</p></div></div><footer>&copy; me</footer></body></html>"""
    assert html.main_texts([page], html.default_labeller()) == ["A title\n\nFirst & best line.\n\nSecond bold text that goes on for a while."]


def test_html_held_out_accuracy():
    rng, wrong, total = np.random.default_rng(77), 0, 0
    for _ in range(60):
        blocks = html.blocks_of(html.generated_page(rng))
        truth = np.array(["\x01" in b.text for b in blocks], bool)
        clean = [replace(b, text=b.text.replace("\x01", "") or ".") for b in blocks]
        got = html.default_labeller().probabilities(html.page_inputs([clean]), np.array([len(clean)])) >= 0.5 if clean else truth
        wrong, total = wrong + int((got != truth).sum()), total + len(truth)
    assert wrong <= 0.02 * total


def test_html_gradient_is_right():
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(2, 5, html.INPUT)).astype(np.float64), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    w = {}
    for d in "fb":
        w["wx" + d], w["wh" + d], w["b" + d] = rng.normal(0, 0.1, (html.INPUT, 64)), rng.normal(0, 0.1, (16, 64)), rng.normal(0, 0.1, 64)
    w["out"], w["bias"] = rng.normal(size=32), 0.1
    y = rng.integers(0, 2, (2, 5))
    loss = lambda: (np.logaddexp(0, (z := html._forward(w, x, mask)[0])) - y * z)[mask].sum()  # noqa: E731, F841
    z, state = html._forward(w, x, mask)
    grad = html._backward(w, x, mask, np.where(mask, html._sigmoid(z) - y, 0), state)
    for key, at in (("wxf", (3, 5)), ("whb", (2, 40)), ("bf", (20,)), ("out", (7,)), ("whf", (1, 50))):
        was = w[key][at]
        w[key][at] = was + 1e-3
        up = loss()
        w[key][at] = was - 1e-3
        down = loss()
        w[key][at] = was
        assert grad[key][at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-4)


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<p a='", "<!-- never closed", "<script>", "</p></div>", "<p>" * 3000, "&#x41;&bogus;", "<a" * 2000, "<p x=\"" * 500])
def test_html_broken_pages(page):
    assert isinstance(html.main_texts([page], html.default_labeller())[0], str)


@pytest.mark.parametrize("page", ["<div>x" * 20_000, "<b>" * 20_000 + "<td>x</td>" * 20_000, "<ul><li>" * 10_000 + "x", "<span>" * 20_000 + "<p>x" * 20_000, "<div><p>x</div>" * 20_000])
def test_html_deep_pages_take_no_longer(page):
    began = time.process_time()
    blocks = html.blocks_of(page)
    assert time.process_time() - began < 3 and blocks


#: Pages by hand, unlike the generated ones: what is main text has its own list.
BY_HAND = [
    (
        """<html><head><title>x</title></head><body><div id=top><a href=/>Cooking</a> | <a href=/l>List</a> | <a href=/m>Members</a></div><main><h1>Boiling times</h1><p>How long the usual things take, from cold water.</p>
        <table><thead><tr><th>Food</th><th>Minutes</th></tr></thead><tbody><tr><td>Egg</td><td>7</td></tr><tr><td>Potato</td><td>20</td></tr></tbody></table><p>Add two minutes at height.</p></main>
        <aside class="related"><h4>See also</h4><ul><li><a href=/1>Frying</a></li><li><a href=/2>Baking</a></li></ul></aside><footer>&copy; 2020 The kitchen. All rights reserved.</footer></body></html>""",
        ["Boiling times", "How long the usual things take, from cold water.", "Food", "Minutes", "Egg", "7", "Potato", "20", "Add two minutes at height."],
    ),
    (
        """<body><nav class="navbar"><a href=/q>Questions</a><a href=/t>Tags</a><a href=/u>Users</a></nav><div id="question" class="question"><h1>Why does my bread not rise?</h1><div class="post-text"><p>I use dry yeast and warm water, and I wait for an hour.</p>
        <p>Nothing happens at all. What could be wrong with it?</p><pre><code>500 g flour, 300 g water</code></pre></div></div><div class="comments"><ul><li class="comment">Is the yeast old? <a href="#">ann</a></li><li class="comment">Try sugar.</li></ul></div>
        <div class="sidebar"><h4>Hot questions</h4><a href=/3>How hot is an oven?</a></div></body>""",
        ["Why does my bread not rise?", "I use dry yeast and warm water, and I wait for an hour.", "Nothing happens at all. What could be wrong with it?", "500 g flour, 300 g water"],
    ),
    (
        """<table width=100%><tr><td class=menu><a href=a>One</a><br><a href=b>Two</a><br><a href=c>Three</a></td><td><font size=5>My summer by the lake</font><p>We went to the lake in June and stayed for three weeks.<p>The water was cold, but we swam every day.
        <p>On the last day it rained.</td></tr></table><center><small>Copyright by me. Last changed in May.</small></center>""",
        ["My summer by the lake", "We went to the lake in June and stayed for three weeks.", "The water was cold, but we swam every day.", "On the last day it rained."],
    ),
    (
        """<html><body><div class="cookie-banner" role="dialog"><p>This site uses cookies to make it better.</p><button>Accept</button></div><header class="masthead"><span>The Daily</span><ul><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></header>
        <article class="story"><h2>Bridge is closed for repairs</h2><figure><img src=a.png><figcaption>The bridge in spring.</figcaption></figure><p>The old bridge over the river will be closed until autumn, the city said on Monday.</p><div class="ad">Buy two, get three.</div>
        <dl><dt>Detour</dt><dd>Over the new bridge.</dd><dt>Cost</dt><dd>Two million.</dd></dl><p>Buses go another way, too.</p><div class="share"><a href=#>Post</a> <a href=#>Mail</a></div></article>
        <section id="comments"><h3>3 comments</h3><div><b>Joe</b><p>At last!</p></div></section><footer><p>Imprint, contact</p></footer></body></html>""",
        ["Bridge is closed for repairs", "The bridge in spring.", "The old bridge over the river will be closed until autumn, the city said on Monday.", "Detour", "Over the new bridge.", "Cost", "Two million.", "Buses go another way, too."],
    ),
]


def test_html_pages_by_hand():
    wrong = total = 0
    for page, want in BY_HAND:
        every = [b.text for b in html.blocks_of(page)]
        got = html.main_texts([page], html.default_labeller())[0].split("\n\n")
        assert set(want) <= set(every)
        wrong, total = wrong + len(set(got) ^ set(want)), total + len(every)
    assert wrong <= 0.1 * total, (wrong, total)


def test_html_head_without_end():
    texts = lambda page: [b.text for b in html.blocks_of(page)]
    assert texts("<html><head><title>no</title><meta charset=x><style>p{}</style><body><p>One</p><p>Two</p></body></html>") == ["One", "Two"]
    assert texts("<head><title>no</title>\n<p>One <b>two</b><head><p>Three") == ["One two", "Three"]
    assert texts("<html><head><link rel=x>\nBare text<p>More") == ["Bare text", "More"]
    assert texts("<head> <script>no</script> <b>Bold</b> text") == ["Bold text"]
    assert [b.depth for b in html.blocks_of("<head> Text<p>more")] == [0, 1]


@pytest.mark.parametrize("tag", ["object", "svg", "canvas", "audio", "video", "template", "math", "noscript"])
def test_html_hidden_element_without_end(tag):
    assert [b.text for b in html.blocks_of(f"<body><p>One</p><{tag} width=3><p>Two</p><{tag}><p>Three</p>")] == ["One", "Two", "Three"]
    assert [b.text for b in html.blocks_of(f"<body><p>One</p><{tag}>no</{tag}><p>Two</p><{tag}><p>Three</p>")] == ["One", "Two", "Three"]
    assert [b.text for b in html.blocks_of("<p>One</p><script>no<p>no")] == ["One"]


def test_html_frame(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><h1>T</h1><p>Some text here.</p></article>", "x"), (3, "u", "<article><h1>T</h1><p>Some text here.</p></article>", "x")]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0), ("", 0), ("T\n\nSome text here.", 18), ("T\n\nSome text here.", 18)]


# near-duplicates


def plain_shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return pd.Series([tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []).value_counts().to_dict()


def plain_similarity(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def test_exact_similarity_and_signatures():
    rng = random.Random(3)
    base = [prose(rng, 60) + " again and again and again and again and again" for _ in range(3)]
    texts = base + [t.replace(t.split()[10], "changed") for t in base] + ["a b c", "A, b; C", ""]
    text, shingle, weight = dedup.shingle_counts(*utf8_parts(pa.array(texts)))
    part = lambda i: (shingle[text == i], weight[text == i])
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert dedup.probability_jaccard(*part(i), *part(j)) == pytest.approx(plain_similarity(plain_shingles(texts[i]), plain_shingles(texts[j])))
    got = dedup.signatures(text, shingle, weight, len(texts), 4096)
    for i in range(3):
        assert (got[i] == got[i + 3]).mean() == pytest.approx(dedup.probability_jaccard(*part(i), *part(i + 3)), abs=0.04)
    assert (got[6] == got[7]).all() and not got[8].any()


def test_horizon_does_not_change_signatures(monkeypatch):
    text, shingle, weight = dedup.shingle_counts(*utf8_parts(pa.array([prose(random.Random(5), 80)])))
    whole = dedup.signatures(text, shingle, weight, 1)
    monkeypatch.setattr(np, "log", lambda x, log=np.log: log(x) if np.ndim(x) else -5.5)  # a horizon a twentieth as far
    assert (dedup.signatures(text, shingle, weight, 1) == whole).all()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(14):
        base = prose(rng, rng.randint(5, 90)).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(copy))
    texts += ["", None, None, "###", "###", "one two", "One  two"]
    shingles = [plain_shingles(t) if t else {} for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and (texts[i] == texts[j] or plain_similarity(shingles[i], shingles[j]) >= 0.8):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = dedup.near_duplicates(docs_of(spark, list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert got["class_id"].tolist() == group
    assert got["class_size"].tolist() == [group.count(g) for g in group]


def test_blocks_find_what_the_hubs_miss():
    rng = random.Random(2)
    base = prose(rng, 100).split()
    chain = [list(base)]
    for i in range(6):
        step = list(chain[-1])
        step[5 + 14 * i] = "x%d" % i
        step[9 + 14 * i] = "y%d" % i
        chain.append(step)
    rows = []
    text, shingle, weight = dedup.shingle_counts(*utf8_parts(pa.array([" ".join(c) for c in chain])))
    for side in (0, 1):
        for i in range(len(chain)):
            rows.append({"key": 1, "block": 0, "side": side, "node": bytes([i]), "label": bytes([i]), "hashes": shingle[text == i].tobytes(), "weights": weight[text == i].astype(np.uint32).tobytes()})
    found = dedup._compare_block(pd.DataFrame(rows))
    reached = {0}
    for _ in chain:
        reached |= {x for a, b in found.itertuples(index=False) for x in (a[0], b[0]) if a[0] in reached or b[0] in reached}
    assert reached == set(range(len(chain))) and len(found) == len(chain) - 1


def test_blocks_of_texts_with_repeats_equal_all_pairs():
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = (prose(rng, 8) + " ") * rng.randint(4, 12) + prose(rng, 30)
        for _ in range(4):
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "z%d" % rng.randrange(99)
            texts.append(" ".join(words))
    text, shingle, weight = dedup.shingle_counts(*utf8_parts(pa.array(texts)))
    one = [(shingle[text == i], weight[text == i].astype(np.uint32)) for i in range(len(texts))]
    rows = [{"key": 1, "block": 0, "side": side, "node": bytes([i]), "label": bytes([i]), "hashes": h.tobytes(), "weights": w.tobytes()} for side in (0, 1) for i, (h, w) in enumerate(one)]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    plain = list(root)
    for a, b in dedup._compare_block(pd.DataFrame(rows)).itertuples(index=False):
        root[find(a[0])] = find(b[0])
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if dedup.probability_jaccard(*one[i], *one[j]) >= dedup.SIMILARITY]
    of = lambda x: x if plain[x] == x else of(plain[x])
    for i, j in linked:
        plain[of(i)] = of(j)
    same = lambda f: {frozenset(j for j in range(len(texts)) if f(j) == f(i)) for i in range(len(texts))}
    assert same(find) == same(of) and len(linked) > 10


def test_keep_one(spark, awkward):
    kept = dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    texts = [r["text"] for r in kept.collect()]
    filled = [t for t in texts if t]
    assert len(filled) == len(set(filled)) == len({t for t in AWKWARD if t}) and sum(not t for t in texts) == 4


def test_keep_one_tells_classes_apart_by_text(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(6)]
    # null ids on unlike texts; two sources that both count from 0, with a copy and a near copy under another's id
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "b"), (0, texts[2], "a"), (0, texts[3], "b"), (1, texts[4], "a"), (1, texts[5], "b"), (2, texts[5], "a"), (1, texts[4] + " end", "b")]
    kept = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(kept) == 6 and {r["text"].removesuffix(" end") for r in kept} == set(texts)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 10 <= len(digits) <= 15
            if kind == "card" and 14 <= len(digits) <= 19:
                ok = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if ok:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    pieces = ["a@b.c", "@", ".", "-", "+", " ", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "0001", "x", "é", "%", "5500005555555559", "a.b@c-d.e.f", "12", "@@", "..", "+49-30-1234567"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert [(a, k, b) for a, k, b, _ in pii.find_spans(text) if k < pii.BASE] == plain_spans(text), text


def test_added_kinds_and_masks():
    text = "Card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32 of my bank, not GB83 WEST 1234 5698 7654 32. Mail me@x.org"
    kinds = [pii.KINDS[k] for _, k, _, _ in pii.find_spans(text)]
    assert kinds == ["card", "iban", "email"]
    assert pii.mask(text, pii.find_spans(text)) == "Card <CARD>, IBAN <IBAN> of my bank, not GB83 WEST 1234 5698 7654 32. Mail <EMAIL>"


@pytest.mark.parametrize("text", ["AT61 1904 3002 3457 3201 BIC BKAU", "AT611904300234573201 EUR", "NO93 8601 1117 947 OK", "to AT61 1904 3002 3457 3201, bic", "(AT611904300234573201)"])
def test_ibans_end_where_their_country_says(text):
    (span,) = [s for s in pii.find_spans(text) if pii.KINDS[s[1]] == "iban"]
    assert pii.mod97(text[span[0] : span[2]]) and text[span[0] : span[2]].replace(" ", "") in ("AT611904300234573201", "NO9386011117947")


@pytest.mark.parametrize("text", ["AT611904300234573201EUR", "xAT611904300234573201", "AT61190430023457320", "AT621904300234573201", "ZZ611904300234573201"])
def test_what_is_no_iban(text):
    assert not [s for s in pii.find_spans(text) if pii.KINDS[s[1]] == "iban"]


def test_words_nearby_raise_and_lower_scores():
    score = lambda t: pii.find_spans(t)[0][3]
    assert score("server 10.0.0.1 up") > score("it was 10.0.0.1 there") > score("version 10.0.0.1 out")
    digest = "0123456789abcdef0123456789abcdef"
    assert pii.find_spans(f"token {digest}") and not pii.find_spans(f"commit {digest}")


def test_personal_data_frame(spark, awkward):
    found = pii.find_personal_data(awkward)
    for r in found.collect():
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(r["text"] or ""))
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    kept = pii.mask_personal_data(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


# language

TONGUES = {"aa": "the and of this that with from have were are", "bb": "le la les des une dans pour avec est qui", "cc": "der die das und nicht mit ist von auch sich"}


def sentences(rng, lang, n):
    return " ".join(rng.choice(TONGUES[lang].split()) + rng.choice(["", rng.choice(TONGUES[lang].split())]) for _ in range(n)).capitalize() + "."


def test_code_lengths_are_proper_and_held_out_texts_recognised():
    rng = random.Random(1)
    model = langid.fit_trees([(x, sentences(rng, x, 40)) for x in TONGUES for _ in range(20)], max_nodes=500)
    prob = np.exp2(-model.bits.reshape(model.child.shape[0], model.child.shape[1], -1).astype(float))
    assert np.allclose(prob.sum(1), 1, atol=1e-3)  # after every context, the bytes share probability 1
    texts = [(x, sentences(rng, x, 12)) for x in TONGUES for _ in range(30)]
    bits = model.code_lengths(*utf8_parts(pa.array([t for _, t in texts])))
    assert [model.languages[i] for i in bits.argmin(1)] == [x for x, _ in texts]


def test_code_lengths_of_pieces(monkeypatch):
    rng = random.Random(2)
    model = langid.fit_trees([(x, sentences(rng, x, 40)) for x in TONGUES for _ in range(5)])
    parts = utf8_parts(pa.array([sentences(rng, "aa", 300), "", sentences(rng, "bb", 500)]))
    whole = model.code_lengths(*parts)
    monkeypatch.setattr(langid, "_SLICE", 97)
    assert np.allclose(model.code_lengths(*parts), whole)


def test_language_of_long_texts_is_learnt(spark):
    rng = random.Random(9)
    write = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    # all texts of xx are longer than the bound; those of yy are mostly longer
    rows = [(i, write("abcdef", 400), "xx") for i in range(30)] + [(100 + i, write("uvwxyz", 400 if i % 10 else 20), "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language_model(docs, rows_per_language=4, longest=200)
    assert model.languages == ["xx", "yy"]
    got = langid.predict_language(docs, model).toPandas()
    assert langid.accuracy(got) == 1.0


def test_rejected_languages(spark):
    rng = random.Random(12)
    rows = [(i, sentences(rng, ("aa", "bb", "cc")[i % 3], 6), ("aa", "bb", "cc")[i % 3], 1) for i in range(90)]
    odd = [(500, "\u0416\u0429\u042d\u042e\u0427\u042f" * 40, None, 1), (501, None, None, 1), (502, "12 ?", None, 1), (503, sentences(rng, "bb", 5), None, 1), (503, sentences(rng, "bb", 5), None, 1), (504, "", "aa", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, `a.score` int")
    kept = langid.reject_unknown(docs)
    got = kept.collect()
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    # by brute force: letters, and fewer bits a byte than the text has
    model = langid.fit_language_model(docs)
    fits = lambda t: bool(t) and any(c.isalpha() for c in t) and model.code_lengths(*utf8_parts(pa.array([t])))[0].min() < 8 * len(t.encode())
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, t, *_ in rows + odd if fits(t))
    assert {r["lang"] for r in got if r["doc_id"] == 503} == {"bb"} and not any(r["doc_id"] == 500 for r in got)


def test_nothing_is_rejected_for_want_of_labels(spark):
    docs = spark.createDataFrame([(1, "words here", None), (2, "123 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.reject_unknown(docs).collect()) == [1, 4]


def test_language_frame(spark, awkward):
    rng = random.Random(3)
    rows = [(i, sentences(rng, x, 30), x, "s", 1) for i, x in enumerate(list(TONGUES) * 40)]
    model = langid.fit_language_model(docs_of(spark, rows))
    assert model.languages == sorted(TONGUES)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_language(docs_of(spark, held), model).collect()}
    assert got == {r[0]: r[2] for r in held} and len(held) > 5
    odd = langid.predict_language(awkward, model).collect()
    assert len(odd) == len(AWKWARD) * 2 and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in odd)
    assert all(0 <= r["score"] <= 1 for r in odd)
    nothing = langid.fit_language_model(docs_of(spark, [(1, None, "en", None, None)]))
    assert {r["lang_pred"] for r in langid.predict_language(awkward, nothing).collect()} == {"und"}


# media


def picture(seed, size=120):
    rng = np.random.default_rng(seed)
    grey = np.full((size, size), 128.0)
    for _ in range(60):
        y, x = rng.integers(0, size - 12, 2)
        h, w = rng.integers(6, 40, 2)
        grey[y : y + h, x : x + w] = rng.uniform(0, 255)
    return grey


def rows_of(images):
    return [(i, media.pgm(x) if isinstance(x, np.ndarray) else x) for i, x in enumerate(images)]


def png(grey):
    h, w = grey.shape
    lines = np.hstack([np.full((h, 1), 2, np.uint8), np.diff(np.vstack([np.zeros((1, w)), grey]).astype(np.int64), axis=0).astype(np.uint8)])
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def test_copies_are_found(spark):
    one, two = picture(1), picture(2)
    edited = np.clip(one * 0.9 + 12 + np.random.default_rng(0).normal(0, 2, one.shape), 0, 255)
    images = [one, two, one[8:112, 10:116], edited, png(np.rint(two)), one, picture(3), np.full((60, 60), 9.0), None, b"", b"junk", b"junk", b"P5 9 9 255\n"]
    got = {r["image_id"]: r for r in media.find_copies(spark.createDataFrame(rows_of(images), "image_id long, image binary")).collect()}
    assert [got[i]["class_id"] for i in range(len(images))] == [0, 1, 0, 0, 1, 0, 6, 7, 8, 9, 10, 10, 12]
    assert got[0]["class_size"] == 4 and got[6]["n_links"] == 0 and got[7]["n_corners"] == 0


def keys_shared(a, b):
    keys = media.table_keys.func(pa.array([media.features(x[None].astype(np.float32))[2].tobytes() for x in (a, b)])).to_pylist()
    return len(set(keys[0]) & set(keys[1]))


def inliers(a, b):
    (_, place_a, code_a), (_, place_b, code_b) = (media.features(x[None].astype(np.float32)) for x in (a, b))
    return media.agreeing(place_a, code_a, place_b, code_b)


def edits(grey, seed):
    """Edited, cropped and resized copies of a picture."""
    rng = np.random.default_rng(seed)
    n = len(grey)
    noise = lambda s: np.clip(grey + rng.normal(0, s, grey.shape), 0, 255)
    return {"noise": np.rint(noise(40)), "contrast": np.rint(noise(25) * 0.4 + 60), "crop": grey[n // 5 :, n // 5 :], "small crop": grey[n * 2 // 5 :, n * 2 // 5 :], "resized": np.rint(media._resize(grey[None], 0.8)[0]), "reduced": np.rint(media._resize(grey[None], 0.55)[0])}


def test_copies_that_share_two_keys_are_found(spark):
    few = []
    for seed in range(200):
        one = np.rint(picture(seed))
        two = np.rint(np.clip(one + np.random.default_rng(seed).normal(0, 80, one.shape), 0, 255))
        if keys_shared(one, two) in (2, 3) and min(inliers(one, two), inliers(two, one)) >= media.INLIERS:
            few.append((one, two))
    few = few[:3]
    assert len(few) == 3
    images = [x for p in few for x in p]
    got = {r["image_id"]: r["class_id"] for r in media.find_copies(spark.createDataFrame(rows_of(images), "image_id long, image binary")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(few)))


def test_copies_are_found_without_the_ends_of_buckets(spark, monkeypatch):
    # as where the smallest and largest images of all buckets are others, which don't agree
    monkeypatch.setattr(media, "_agreeing_pairs", lambda pairs, found: found.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b")))
    images = [x for seed in range(3) for one in [np.rint(picture(seed))] for x in (one, *edits(one, seed).values())]
    n = len(images) // 3
    expected = [n * (i // n) for i in range(3 * n)]
    for bytes_of_side in (media.REST_BYTES, 1 << 14):
        monkeypatch.setattr(media, "REST_BYTES", bytes_of_side)
        got = {r["image_id"]: r["class_id"] for r in media.find_copies(spark.createDataFrame(rows_of(images), "image_id long, image binary")).collect()}
        assert [got[i] for i in range(3 * n)] == expected


@pytest.mark.parametrize("both, most", [(False, 256), (True, 256), (False, 37), (True, 37)])
def test_only_pairs_that_may_agree_are_compared_one_by_one(monkeypatch, both, most):
    monkeypatch.setattr(media, "MOST_AT_ONCE", most)
    monkeypatch.setattr(media, "PRODUCT", 500)
    rng = np.random.default_rng(5)
    images = [media.decode_image(v) for v in media.drawn.func(pa.array(list(rng.normal(size=(70, 64))))).to_pylist()]
    images += [x for k in range(3) for x in edits(np.rint(picture(k)), k).values()] + [edits(images[k], k)["noise"] for k in range(5)] + [np.full((60, 60), 9.0)]
    (places, codes), n = zip(*[media.features(x[None].astype(np.float32))[1:] for x in images], strict=True), len(images)
    short = rng.permutation(n)
    members = pd.DataFrame({"i": 0, "j": int(both), "block": rng.integers(0, 1 + both, n), "short": short, "node": [b"%d" % k for k in range(n)], "places": [p.tobytes() for p in places], "codes": [c.tobytes() for c in codes]})
    members["root"] = members["node"]
    pairs = [(a, b) if short[a] < short[b] else (b, a) for a in range(n) for b in range(a) if not both or members["block"][a] != members["block"][b]]
    expected = [p for p in pairs if len(np.intersect1d(media._keys(codes[p[0]]), media._keys(codes[p[1]]))) >= media.VOTES and media.agreeing(*(v for k in p for v in (places[k], codes[k]))) >= media.INLIERS]
    calls, plain = [], media.agreeing
    monkeypatch.setattr(media, "agreeing", lambda *args: calls.append(1) or plain(*args))
    found = [(int(a), int(b)) for a, b in media._compare_rest(members).itertuples(index=False)]

    def classes(links):
        label = np.arange(n)
        for a, b in links:
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == k).tolist()) for k in label}

    assert len(expected) > 8 and set(found) <= set(expected) and classes(found) == classes(expected)
    assert most < 256 or len(calls) <= len(expected)


def test_keys_propose_edited_copies():
    pairs = [(one, two) for seed in range(20) for one in [np.rint(picture(seed))] for two in edits(one, seed).values()]
    agree = [p for p in pairs if inliers(*p) >= media.INLIERS]
    assert len(agree) >= 0.95 * len(pairs) and sum(keys_shared(*p) >= media.VOTES for p in agree) >= 0.98 * len(agree)


@pytest.mark.parametrize("seed", range(4))
def test_small_crops_and_strong_reductions_of_large_pictures(seed):
    one = np.kron(picture(seed, 160), np.ones((3, 3)))
    rng = np.random.default_rng(seed)
    for _ in range(400):
        y, x = rng.integers(0, 470, 2)
        one[y : y + rng.integers(6, 24), x : x + rng.integers(6, 24)] = rng.uniform(0, 255)
    small = media._resize(media._smooth(media._resize(media._smooth(one[None]), 0.55)), 0.55)[0]
    for two in (one[150:310, 200:360], np.rint(small)):
        assert keys_shared(one, two) >= media.VOTES and inliers(one, two) >= media.INLIERS


def test_png_round_trip():
    grey = np.rint(picture(4))
    assert np.array_equal(media.decode_image(png(grey)), grey.astype(np.float32)) and media.decode_image(png(grey)[:60]) is None


# byte pairs


def test_pieces_equal_the_whole():
    path, pattern = bpe.tokenizer()
    rng = random.Random(6)
    enc = bpe.encoding(path, pattern)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "don't", "éà", "123", "!?", " ", "x" * 30, "\U0001f600", " \n "]) for _ in range(rng.randint(1, 200)))
        ids = bpe.encode(text, path, pattern)
        assert ids.tolist() == enc.encode_ordinary(text) and bpe.decode(ids, path, pattern) == text.encode()


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_are_stitched(spark, seed):
    path, pattern = bpe.tokenizer()
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["word", " ", "  ", "\n", "don't", "é", "12", "?!", "   ", "run "]) for _ in range(rng.randint(50, 400))) for _ in range(6)]
    texts += ["a" * 500, " " * 300, "ab " * 200, ("x" * 90 + " ") * 5, None, "", texts[0]]
    rows = docs_of(spark, [(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(rows, path, pattern, chunk=64, overlap=24).collect()
    enc = bpe.encoding(path, pattern)
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


# licences


def test_license_places(spark, awkward):
    texts = ["Under the MIT License! under the mit license", "cc by-nc CC BY NC", "the Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3.", "mit license", "under the under the mit license", None, "", "permission is hereby granted free of charge to any person obtaining a copy"]
    got = license.scan_licenses(docs_of(spark, list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [(2, 0, 4, "mit"), (2, 0, 3, "cc-by-nc"), (1, 1, 1, "apache-2"), (0, None, None, ""), (0, None, None, ""), (1, 2, 2, "mit"), (0, None, None, ""), (0, None, None, ""), (0, None, None, "")]
    assert got[3]["labels"] == "gpl" and got[8]["labels"] == "mit" and got[6]["n_words"] == 0
    assert license.scan_licenses(awkward).count() == len(AWKWARD) * 2


def test_license_texts_are_found_whole_and_changed(spark):
    rng = random.Random(3)
    rows, want = [], []
    for label, _, text in TEXTS:
        words = license.words_in(text)
        for change in range(3):
            kept = list(words)
            if change:
                # other words here and there, but not in key phrases
                fixed = {at + j for t in license.templates() if t.words == words for at, k in t.keys for j in range(len(k))}
                for i in rng.sample(range(len(kept)), len(kept) // 8):
                    kept[i] = kept[i] if i in fixed else "other"
            rows.append((len(rows), " ".join([*prose(rng, 30).split(), *kept, *prose(rng, 20).split()])))
            want.append(label)
    rows += [(1000 + i, prose(rng, 200)) for i in range(100)]
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i]["labels"].split(",") for i, label in enumerate(want))
    assert all(got[i]["score"] == 1.0 for i in range(0, len(want), 3))
    assert not any(got[1000 + i]["labels"] for i in range(100))


def test_license_postings_are_the_rarest_words():
    form = license.templates()[3]
    idf = {w: 1.0 + (w in ("sublicense", "merge", "noninfringement")) for w in form.words}
    found = license.postings(form, idf)
    assert {"sublicense", "merge", "noninfringement"} <= {w for w, _ in found} and len({w for w, _ in found}) == license.RARE
    assert all(form.words[i] == w for w, i in found)


# neighbours


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = ann.hilbert_keys(cells, 3)
    order = np.argsort(keys)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_nearest_rows_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0]), (5100, [])]
    got = ann.nearest_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    assert set(got["query_id"]) == set(range(0, 1500, 20))
    scores = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part["score"], scores[q][part["vec_id"]])
        assert part["score"].is_monotonic_decreasing
        hits += len(set(np.lexsort((np.arange(1500), -scores[q]))[:20]) & set(part["vec_id"]))
    assert hits >= 0.9 * 20 * 75


def plain_nearest(rows, is_query):
    """Brute force over rows (id, vector): {query place: [(score, id)]}; a row leaves out itself alone."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(good):
        if is_query(i):
            near = sorted((-float(np.add.accumulate(v * w)[-1]), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))[:20]
            out.append((i, [(j, -s) for s, j in near]))
    return sorted(x for x in out if x[1])


def found_nearest(df, is_query):
    got = ann.nearest_rows(df, is_query).collect()
    lists = {}
    for r in got:
        lists.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    return lists


def test_nearest_rows_few(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.nearest_rows(rows, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2)]
    assert ann.nearest_rows(rows.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_rows_of_ties_repeats_and_widths(spark):
    rng = np.random.default_rng(3)
    hot, other = [1.0, 2.0, 0.5], [0.5, 2.0, 1.0]
    rows = [(i, hot) for i in range(0, 300, 3)] + [(i, other) for i in range(1, 120, 3)] + [(7, hot), (7, other), (0, hot), (40, [3.0]), (60, [2.0]), (61, [-1.0]), (80, [0.0, 0.0])]
    rows += [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(400, 460)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit("x"), "score": F.lit(9), "v": F.lit(None)})
    want = plain_nearest(rows, lambda i: i % 20 == 0)
    got = found_nearest(df, F.col("vec_id") % 20 == 0)
    listed = {}
    for q, near in want:
        for rank, x in enumerate(near, 1):
            listed.setdefault((q, rank), []).append(x)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in listed.items()}


@pytest.mark.parametrize("scale", [1e6, 1e200])
def test_nearest_rows_with_one_long_vector(spark, monkeypatch, scale):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    x[11] *= scale
    got = ann.nearest_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).toPandas()
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    hits = sum(len(set(np.lexsort((np.arange(3000), -scores[q]))[:20]) & set(part["vec_id"])) for q, part in got.groupby("query_id"))
    assert len(got) == 20 * 150 and hits >= 0.9 * 20 * 150


# toxicity


def test_toxic_expressions_are_learnt(spark, awkward):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        words = prose(rng, rng.randint(20, 80)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "scummy"])
        rows.append((i, " ".join(words), int(toxic)))
    model = toxicity.fit_model(spark.createDataFrame(rows[:500], "doc_id long, text string, toxic int"))
    got = toxicity.score_toxicity(spark.createDataFrame(rows[500:], "doc_id long, text string, toxic int"), model).collect()
    assert sum(r["predicted"] != r["toxic"] for r in got) <= 4
    odd = toxicity.score_toxicity(awkward, model).collect()
    assert len(odd) == 2 * len(AWKWARD) and all(0 <= r["score"] <= 1 for r in odd)
    nothing = toxicity.fit_model(spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, toxic int"))
    assert {r["predicted"] for r in toxicity.score_toxicity(awkward, nothing).collect()} == {0}


def plain_ratio(rows, shift, margin):
    """Evidence of a text by the formulas alone, over every word and bigram that the counted texts hold."""
    import math
    import re
    from collections import Counter

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    count = {c: Counter() for c in (0, 1)}
    for text, toxic in rows:
        w = words(text)
        count[toxic].update(zip([None, *w], w, strict=False))
    k = {c: Counter(b for _, b in count[c]) for c in (0, 1)}
    total = {c: sum(k[c].values()) for c in (0, 1)}
    every = set(k[0]) | set(k[1])
    scale = {c: total[c] / min(total.values()) for c in (0, 1)}
    d = {c: toxicity.DISCOUNT * scale[c] for c in (0, 1)}
    back = {c: sum(min(k[c][w], d[c]) for w in every) / total[c] for c in (0, 1)}
    shared = lambda w: (k[0][w] + k[1][w] + 1) / (sum(total.values()) + len(every) + 1)
    low = lambda c, w: max(k[c][w] - d[c], 0) / total[c] + back[c] * shared(w)
    firsts = {c: Counter() for c in (0, 1)}
    spent = {c: Counter() for c in (0, 1)}
    for c in (0, 1):
        for (a, b), n in count[c].items():
            firsts[c][a] += n
            spent[c][a] += max(n - toxicity.BIGRAM_DISCOUNT * scale[c], 0)
    left = lambda c, a: max(1 - spent[c][a] / max(firsts[c][a], 1), 1e-3)
    value = lambda c, a, b: max(count[c][a, b] - toxicity.BIGRAM_DISCOUNT * scale[c], 0) / max(firsts[c][a], 1) + left(c, a) * low(c, b)

    def evidence(text):
        w, out = words(text), 0.0
        for a, b in zip([None, *w], w, strict=False):
            gain = math.log(low(1, b) / low(0, b))
            move = math.log(value(1, a, b) / value(0, a, b)) - gain
            ratio = gain + max(-shift, min(shift, move))
            out += math.copysign(max(abs(ratio) - margin, 0), ratio)
        return out / (len(w) + toxicity.PRIOR_WORDS) if w else 0.0

    return evidence


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = [rng.choice("red blue green the a of to house tree river walk see".split()) for _ in range(rng.randint(3, 40))]
        if i % 2:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "you rat", "rotten to"]))
        rows.append((i, " ".join(words), i % 2))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_equals_the_formulas(spark, marked):
    rows, df = marked
    model = toxicity.fit_model(df)
    assert min(model.sizes.values()) > 0 and model.sizes["words"] < len({w for _, t, _ in rows for w in t.split()})
    held = {r["doc_id"] for r in df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(100)) < toxicity.CALIBRATION).collect()}
    plain = plain_ratio([(t, y) for i, t, y in rows if i not in held], model.shift, model.margin)
    asked = [(1, "you rat of the vile river"), (2, None), (3, ""), (4, "unseen words unseen"), (4, "A RED house, rotten to the river! \u00e9t\u00e9"), (5, "..."), (6, "vile " * 5000)] + [(i, t) for i, t, _ in rows[:20]]
    docs = spark.createDataFrame(asked, "doc_id long, text string").withColumns({"gain": F.lit(1), "__e2": F.lit("x"), "score": F.lit("y")})
    got = toxicity.score_toxicity(docs, model).collect()
    assert sorted((r["doc_id"], round(r["evidence"], 9)) for r in got) == sorted((i, round(plain(t or ""), 9)) for i, t in asked)


def test_toxicity_model_as_a_table(spark, marked, monkeypatch):
    _, df = marked
    docs = df.unionByName(df.limit(5)).unionByName(spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "what else", 1)], df.schema))
    scored = lambda m: sorted((r["doc_id"], round(r["evidence"], 9), round(r["score"], 9)) for r in toxicity.score_toxicity(docs, m).collect())
    small = toxicity.fit_model(df)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    large = toxicity.fit_model(df)
    assert large.small is None and (large.shift, large.margin) == (small.shift, small.margin)
    assert scored(large) == scored(small)
    assert toxicity.score_toxicity(docs.limit(0), large).count() == toxicity.score_toxicity(docs.limit(0), small).count() == 0


def test_toxic_phrases_of_ordinary_words(spark):
    rng = random.Random(9)
    plain = "get lost you are not here and we go out of town".split()
    rows = []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(30)]
        text = " ".join(words)
        for phrase in ("get lost", "go out"):
            text = text.replace(phrase, phrase.split()[0])
        if i % 4 == 0:
            at = text.split()
            for _ in range(3):
                at.insert(rng.randrange(len(at)), rng.choice(["get lost", "go out"]))
            text = " ".join(at)
        rows.append((i, text, int(i % 4 == 0)))
    schema = "doc_id long, text string, toxic int"
    model = toxicity.fit_model(spark.createDataFrame(rows[:900], schema))
    got = toxicity.score_toxicity(spark.createDataFrame(rows[900:], schema), model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)


# mixing


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 3 * sizes[s] + 1e-9}
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("a", 400), ("b", 30), ("c", 5), (None, 200), ("d", 3), ("é", 150)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.lognormvariate(3.5, 1))), s) for i in range(n)]
    rows += [(9000, None, "a"), (9000, None, "a"), (9001, "", "empty"), (9002, "x y", "a"), (9002, "x y", "a")]
    docs = docs_of(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").toPandas()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and ((got["copies"] >= 0) & (got["copies"] <= 3)).all()
    for s, part in got.groupby(got["source"].where(got["source"].notna(), "null")):
        key = None if s == "null" else s
        assert part["target"].iloc[0] == pytest.approx(want[key]) and part["source_size"].iloc[0] == sizes[key]
        assert abs(part["taken"].sum() - want[key]) <= max(0.02 * want[key], part["size"].max() if len(part) < 50 else 5)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert again[key].sort_values(key).values.tolist() == got[key].sort_values(key).values.tolist()
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == got["copies"].sum()


def test_newton_finds_the_multiplier(spark):
    rows = spark.createDataFrame([(100.0, t) for t in (0.5, 10.0, 100.0, 299.0, 300.0)], "size double, target double")
    got = rows.select("target", mixing.multiplier(F.col("size"), F.col("target")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(math.log(r["target"] / 100), abs=1e-9) for r in got)


def test_word_hashes_ignore_what_is_around():
    offsets, body = utf8_parts(pa.array(["One two", "", "xONE, TWO!", None, "one"]))
    hashes, counts = word_hashes(offsets, body)
    assert counts.tolist() == [2, 0, 2, 0, 1] and hashes[0] == hashes[4] and hashes[1] == hashes[3] and hashes[0] != hashes[2]


# the pipeline


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline(spark, tmp_path, empty):
    import corpus_pipeline

    rng = random.Random(1)
    rows = [(i, prose(rng, 30 + i % 7) + (" mail me@x.org" if i % 5 == 0 else ""), "en", f"s{i % 3}", 100) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 100) for i in range(10)] + [(200, "###", "en", "s0", 3), (201, None, None, None, None)]
    docs_of(spark, [] if empty else rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    if empty:
        assert not len(got)
        return
    assert set(got["doc_id"]) <= set(range(60)) and got["n_tokens"].min() > 0
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in stage["language"](spark, docs, "").collect()} == {r[0] for r in rows} - {200, 201}
    assert {r["doc_id"] for r in stage["near_duplicates"](spark, docs, "").collect()} == set(range(60)) | {200, 201}
    assert stage["personal_data"](spark, docs, "").filter("text like '%me@x.org%'").count() == 0


def test_pipeline_stages_equal_brute_force(spark, awkward):
    import corpus_pipeline
    import tiktoken  # noqa: F401

    stage = dict(corpus_pipeline.STAGES)
    odd = awkward.withColumns({"a.b": F.lit(1), "copies": F.lit("c"), "key": F.lit("k"), "node": F.lit("n"), "row": F.lit("r"), "n": F.lit(0)})
    for name in ("near_duplicates", "personal_data", "mixture", "language"):
        out = stage[name](spark, odd, "")
        assert out.dtypes == odd.dtypes, name
        assert stage[name](spark, odd.limit(0), "").count() == 0
    rng = random.Random(7)
    rows = [(i, prose(rng, 20 + i % 60), None, ("a", "b", "c", None)[(i * i) % 4 if i % 7 else 3], 5) for i in range(400)]
    docs = docs_of(spark, rows)
    mixed = stage["mixture"](spark, docs, "").toPandas()
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = {k: sum(size[i] for i in size if source[i] == k) for k in ("a", "b", "c", None)}
    sizes = {k: v for k, v in sizes.items() if v}
    targets = plain_targets(sizes)
    times = mixed["doc_id"].value_counts()
    assert times.max() <= 3
    for k, want in targets.items():
        taken = sum(n * size[i] for i, n in times.items() if source[i] == k)
        assert abs(taken - want) <= 0.02 * want + 80
    enc = bpe.encoding(*bpe.tokenizer())
    for r in stage["tokens"](spark, docs.limit(20), "").collect():
        ids = enc.encode_ordinary(next(t for i, t, *_ in rows if i == r["doc_id"]))
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with nulls, repeats and ties, as the queries read them."""
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(21)
    rows = [(i, sentences(rng, ("aa", "bb", "cc")[i % 3], 4) + (" vile rot" * 3 if i % 5 == 0 else "") + (" under the MIT license" if i % 9 == 0 else ""), ("aa", "bb", "cc")[i % 3], ("s", "t", None)[i % 3], 9) for i in range(150)]
    rows += [(150 + i, t, None, None, None) for i, t in enumerate(AWKWARD)] + rows[:3] + [(None, "no id here", None, "s", 1)]
    docs_of(spark, rows).withColumn("score", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(120)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "u", BY_HAND[0][0]), (1, "u", BY_HAND[0][0]), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 5000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)] + [(20, [1.0] * 8), (None, [1.0] * 8), (200, None), (220, []), (240, [0.0] * 8), (260, [float("nan")] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), rows, vectors


CONTRACT = {
    "op1_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_probminhash": {"doc_id": "bigint", "class_id": "bigint"},
    "op3_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_media": {"vec_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_license": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op8_hilbert": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_queries_return_what_they_must(spark, tables, name):
    from drivelens.llm import queries

    folder, rows, vectors = tables
    found = queries.queries()[name](spark, folder)
    assert CONTRACT[name].items() <= dict(found.dtypes).items()
    got = found.collect()
    if name == "op1_html":
        assert len(got) == 5 and [r["text"] for r in got if r["page_id"] == 1] == ["\n\n".join(BY_HAND[0][1])] * 2
    elif name == "op8_hilbert":
        want = [(i, rank, j, s) for i, near in plain_nearest([(i, [float(np.float32(c)) for c in v] if v else v) for i, v in vectors if i is not None], lambda i: i % 20 == 0) for rank, (j, s) in enumerate(near, 1)]
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(x[:3] for x in want)
        assert all(abs(r["score"] - s) < 1e-12 for r, s in zip(sorted(got, key=lambda r: (r["query_id"], r["rank"], r["vec_id"])), [x[3] for x in sorted(want)], strict=True))
    elif name == "op5_media":
        assert len(got) == len(vectors)
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    if name in ("op4_language", "op9_toxicity"):
        base, rest = (5, 0) if name == "op4_language" else (3, 1)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % base == rest) for r in got if r["doc_id"] is not None)
        assert all(0 <= r["score"] <= 1 for r in got)
    if name == "op4_language":
        text = {r[0]: r[1] for r in rows}
        assert all((r["lang_pred"] == "und") == (not text[r["doc_id"]] or not any(c.isalpha() for c in text[r["doc_id"]])) for r in got)
    if name == "op6_bpe":
        enc, text = bpe.encoding(*bpe.tokenizer()), {r[0]: r[1] for r in rows}
        for r in got:
            ids = enc.encode_ordinary(text[r["doc_id"]] or "")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()
    if name == "op10_mixing":
        assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    path, pattern = bpe.tokenizer()
    model = langid.fit_language_model(docs)
    for found in (dedup.near_duplicates(docs), pii.find_personal_data(docs), langid.predict_language(docs, model), bpe.encode_documents(docs, path, pattern), license.scan_licenses(docs), mixing.mix(docs), dedup.keep_one(docs), mixing.mixed_documents(docs)):
        assert found.count() == 0
    assert media.find_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0
