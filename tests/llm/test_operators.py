"""Operators against brute force, exact round trips and held-out accuracy; odd inputs have defined results."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parttrace.llm import common as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, a int, n int"


def frame(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, 2) for i, t, s in rows], DOCS)


def sentences(seed, n, vocabulary=400, low=5, high=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(low, high))) for _ in range(n)]


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


ODD = [(1, None, "s"), (2, "", "s"), (3, " \n\t", None), (4, "one", "s"), (5, "One", None), (6, "two words", "t"), (7, "two words", "t"), (7, "two words", "t"), (None, "two words", "t"), (8, "é ü " * 3, "t"), (9, "x" * 5000, "u")]


def test_word_hashes():
    texts = ["Hello  world\x0bfoo", None, "", "hello", " a b ", "x" * 600_000 + " y", "foo"]
    h, first, start, end = C.word_hashes(pa.array(texts), spans=True)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words] and (end - start).tolist() == [len(x) for w in words for x in w]
    flat = [x.lower() for w in words for x in w]
    assert len(set(flat)) == len(set(h.tolist())) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(h)) for j in range(len(h)))


def twins(n=1024):
    """Two words of n letters whose polynomials modulo a power of two agree."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_no_collisions(spark):
    """Such words are different words to all that tells words apart."""
    import public_tokenizers as P
    import tiktoken

    from parttrace.llm.bpe import Codec, Vocabulary, load_ranks
    from parttrace.llm.ngram_join import ngram_jaccard
    from parttrace.llm.token_counts import MARK, Automaton, counts

    one, two = twins()
    h, _ = C.word_hashes(pa.array([f"{one} {two} {one}"]))
    assert h[0] == h[2] != h[1]
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"{one} {two}", two, one]
    assert [x.tolist() for x in Codec(Vocabulary(ranks, P.PATTERN)).encode(pa.array(texts))] == [encoding.encode_ordinary(t) for t in texts]
    assert counts(Automaton([MARK, "a", "b", MARK + "a", "ab"]), pa.array([one, two]), {}).tolist() == [Automaton([MARK, "a", "b", MARK + "a", "ab"]).count(w) for w in (one, two)]
    got = ngram_jaccard(frame(spark, [(1, one, "s"), (2, two, "s"), (3, one, "s")]), n=3, percent=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_distinct_spans(monkeypatch):
    """Spans that share a hash are still told apart."""
    raw = np.frombuffer(b"abc abd abc xyzxyzxyzxyz xyzxyzxyzxyw abc", np.uint8)
    start = np.array([0, 4, 8, 12, 25, 38])
    end = np.array([3, 7, 11, 24, 37, 41])
    wanted = [raw[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    for _ in range(2):
        spans, number = C.distinct_spans(raw, start, end)
        assert [spans[k] for k in number] == wanted
        monkeypatch.setattr(C, "span_hashes", lambda raw, start, end: np.zeros(len(start), np.uint64))


def test_ngram_join_sizes(spark):
    """Sets whose parities have different lengths, and no rows at all."""
    from parttrace.llm.ngram_join import ngram_jaccard

    rnd = random.Random(31)
    rows = []
    for base in (120, 127, 250, 515, 1020):
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(base)]
        for k in range(6):
            rows.append((len(rows), " ".join(w + [f"x{rnd.randint(0, 10**6)}" for _ in range(3 * k)]), "s"))
    sets = shingle_sets(rows, 3)
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(frame(spark, rows), n=3, percent=90).collect()}
    assert got == union_find(sorted(sets), links) and links
    assert ngram_jaccard(frame(spark, [])).count() == 0 and ngram_jaccard(frame(spark, [(None, None, None), (1, "", "s")])).count() == 2
    null = ngram_jaccard(frame(spark, [(None, rows[0][1], "s"), (5, rows[0][1], "s"), (None, "else", "s")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in null) == [("5", "5"), ("None", "5"), ("None", "None")]


def shingle_sets(rows, n):
    out = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    from parttrace.llm.ngram_join import ngram_jaccard

    rnd = random.Random(n)
    rows = [(k, t, "s") for k, t in enumerate(sentences(n, 25, low=30, high=80), 100)]
    for base in list(rows)[:6]:
        for _ in range(12):
            w = base[1].split()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 50)}"
            rows.append((len(rows) + 200, " ".join(w), "s"))
    rows += [r for r in ODD if r[0] is not None]
    sets = shingle_sets(rows, n)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = {i: (len(sets[i]), c) for i, c in union_find(ids, links).items()}
    got = ngram_jaccard(frame(spark, rows), n=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected and len(got) == len(rows)
    assert len(set(c for _, c in expected.values())) < len(ids)


def test_ngram_join_turns(spark, monkeypatch):
    """The same components when leaders' turns are used up before whole lists meet."""
    from parttrace.llm import ngram_join as N

    rnd = random.Random(8)
    base = sentences(8, 1, low=60, high=61)[0].split()
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 9)}"
        rows.append((k, " ".join(w), "s"))
    plain = {tuple(r) for r in N.ngram_jaccard(frame(spark, rows), n=3, percent=90).collect()}
    monkeypatch.setattr(N, "FEW", 0)
    assert {tuple(r) for r in N.ngram_jaccard(frame(spark, rows), n=3, percent=90).collect()} == plain


def test_quality(spark):
    from parttrace.llm.quality import quality

    good = sentences(1, 120)
    poor = [" ".join(w.upper() + "!!" for w in t.split()) for t in sentences(2, 120)]
    rows = [(k, t, "s") for k, t in enumerate(good + poor, 100)]
    labels = spark.createDataFrame([(i, int(i < 220)) for i, _, _ in rows if i % 3], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality(frame(spark, rows + ODD), labels).collect()}
    held = [i for i, _, _ in rows if i % 3 == 0]
    assert np.mean([got[i]["predicted"] == (i < 220) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    none = quality(frame(spark, ODD), labels.limit(0)).collect()
    assert len(none) == len(ODD) and {r["score"] for r in none} == {0.5}
    assert quality(frame(spark, []), labels).count() == 0


def test_toxicity(spark):
    from parttrace.llm import toxicity as X

    rnd = random.Random(3)
    texts = sentences(5, 500, low=40, high=160)
    toxic = [int(rnd.random() < 0.4) for _ in texts]
    bad = ["grumbo", "snarfle", "grumbix", "snarfla"]
    for k, y in enumerate(toxic):
        if y:
            w = texts[k].split()
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", ",", "."])
            texts[k] = " ".join(w)
    net = X.train(texts[:350], np.array(toxic[:350]))
    score = net.scores(pa.array(texts[350:]))
    assert np.mean((score >= 0.5) == np.array(toxic[350:])) > 0.9
    long = " ".join(sentences(6, 30)) + " grumbo snarfle grumbo " + " ".join(sentences(7, 30))
    assert net.scores(pa.array([long, None, "", " "]))[0] >= 0.5 and (net.scores(pa.array([None, "", " "], pa.string())) == 0).all()
    got = X.toxicity(frame(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.0}


def test_toxicity_learns_whole_texts(spark, monkeypatch):
    """Passages after the 1,500th word are learned from, and whole texts reach the training."""
    from parttrace.llm import toxicity as X

    texts = [" ".join(sentences(100 + k, 1, low=1700, high=1750)) for k in range(60)]
    texts = [t + (" grumbo snarfle grumbix " + t[:50] if k % 2 else "") for k, t in enumerate(texts)]
    seen, train = [], X.train
    monkeypatch.setattr(X, "train", lambda t, y: seen.append((t, y)) or train(t, y))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in X.toxicity(frame(spark, [(k, t, "s") for k, t in enumerate(texts)]), labels).collect()}
    assert sorted(seen[0][0]) == sorted(texts[:40])
    assert np.mean([got[k] == k % 2 for k in range(40, 60)]) >= 0.9
    monkeypatch.setattr(X, "SAMPLE_BYTES", 60_000)
    X.toxicity(frame(spark, [(k, t, "s") for k, t in enumerate(texts)]), labels)
    assert 2 < len(seen[1][0]) < 40 and set(seen[1][0]) <= set(texts) and {0, 1} == set(seen[1][1].tolist())


def test_windows_cover_and_overlap():
    from parttrace.llm.toxicity import STRIDE, WINDOW, windows

    first = np.concatenate([[0], np.cumsum([0, 1, 32, 33, 100])])
    start, text = windows(first)
    for d in range(5):
        own = start[text == d]
        seen = {p for s in own for p in range(s, min(s + WINDOW, first[d + 1]))}
        assert seen == set(range(first[d], first[d + 1]))
        assert (np.diff(own) <= STRIDE).all()


def test_gradients():
    from parttrace.llm.toxicity import MET, Network, Words

    words = Words(pa.array(["a bad day", "some other words here"]))
    net = Network(words.hashes, 2)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    which = np.full((2, 32), -1)
    which[0, :3], which[1, :4] = words.index[:3], words.index[3:]
    target, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        x = net.inputs(words)[1].astype(np.float64)
        logit = net.forward(which, x)
        return float(np.mean(np.log1p(np.exp(logit)) - target * logit))

    row, x = net.inputs(words)
    g = net.gradients(which, words, row, x, target, weight)
    for name in ("Wf", "Ub", "A", "o", "a", "cb"):
        at = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 and MET


def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    from parttrace.llm.bpe import bpe, load_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    rnd = random.Random(4)
    bits = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "é", "日", "1", "²", "-", "!!", "🎉", "s", "\x1c", "_", "́", "The", " word"]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 20))), "s") for k in range(100, 500)] + ODD + [(10, "a" * 3000 + " " + "abc=-" * 500, "s")]
    got = bpe(frame(spark, rows), path, P.PATTERN).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t or "")
    for r in got:
        t = texts[r["doc_id"]]
        ids = np.array(encoding.encode_ordinary(t), "<u4")
        assert r["ids"] == ids.tolist() and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    with pytest.raises(ValueError):
        from parttrace.llm.bpe import Pieces

        Pieces(r"\w+")


def test_html(spark):
    from parttrace.llm.html_extract import extract, main_text

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name and slogan here.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies for many reasons, as you know.</p></div><article><h1>Title &amp; more</h1><p>First <b>para</b>
    graph &lt;x&gt;.<p>Second, unclosed.<div class="ad">Buy this thing now, it is a good one.</div><script>if (a<b) "</p>";</script><p>Short</p></article>
    <section id="comments"><p>I think this is a great text, thanks a lot.</p></section><aside>Related things to read.</aside><form>Your name <input></form><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == "Title & more\nFirst para graph <x>.\nSecond, unclosed.\nShort"
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, "<p>"), (None, "v", "just some words, no tags at all here.")], "page_id long, url string, html string")
    got = extract(rows.withColumn("text", F.lit(1))).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)


SENTENCES = "The first sentence of the article is here, plain and long. The second one follows it now. The third one ends the matter."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body><article><p>{}</p></article>",  # a head that isn't closed
        '<article class="overflow-hidden"><p>{}</p></article>',
        '<body><div class="content has-sidebar"><p>{}</p></div>',
        '<div class="form-text"><p>{}</p></div>',
        '<div class="post category-tags"><p>{}</p></div>',
        "<article><button>Menu<p>{}</p></article>",  # a button that isn't closed
        '<article><p class="a>{}</p><p id="b"></p></article>',  # a quote that isn't closed
        '<article><p>{}</p><div class="ad"><p>{}</p></div><p hidden>{}</p><p style="display: none">{}</p></article>',
        '<div class="notice"><p>{0}</p></div><main><p>{0}</p></main><section class="reader-comments"><article class="comment"><p>{0}</p><p>{0}</p></article></section>',
        '<form id="aspnet"><div><nav><a href="/">Home</a></nav><h1></h1><p>{}</p></div></form>' + "<footer>{}</footer>",
    ],
)
def test_html_keeps_articles(page):
    from parttrace.llm.html_extract import main_text

    assert main_text(page.replace("{0}", SENTENCES).replace("{}", SENTENCES)) == SENTENCES


def test_html_math_and_long_pages():
    from parttrace.llm.html_extract import main_text

    assert main_text(f"<article><p>{SENTENCES} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == f"{SENTENCES} So x=2 holds."
    assert main_text("<div>" * 5000 + f"<p>{SENTENCES}</p>") == SENTENCES
    many = "".join(f"<div><p>{SENTENCES} {k}</p></div>" for k in range(20_000))
    assert main_text(f"<body><article>{many}</article>").count("\n") == 19_999


def test_html_labels_come_from_the_cut():
    """Blocks whose own cost says otherwise go with their neighbours, and rightly."""
    from parttrace.llm import html_extract as H

    rnd = random.Random(9)
    differ = right = 0
    for _ in range(60):
        body, wanted = [], []
        for _ in range(rnd.randint(4, 9)):
            if rnd.random() < 0.35:
                text = rnd.choice(["By A. Writer", "Part two", "See map", "London"])
                body.append(f"<div>{text}</div>")
            else:
                text = " ".join(rnd.choice(["one", "longer", "words", "stand", "here"]) for _ in range(rnd.randint(14, 30))) + "."
                body.append(f"<div>{text}</div>")
            wanted.append(text)
        if len(wanted[0]) < 20 or len(wanted[-1]) < 20:
            continue
        links = "".join(f"<li><a href='/{k}'>Topic {k}</a></li>" for k in range(6))
        found = H.blocks(f"<body><div><ul>{links}</ul></div><div><div>{''.join(body)}</div></div><div>Copyright us</div></body>")
        cost, label = H.costs(found), H.labelled(found)
        good = [t in wanted for t, _, _ in found]
        for c, y, g in zip(cost, label, good, strict=True):
            differ += (c > 0) != y
            right += (c > 0) != y and y == g
        assert sum(y == g for y, g in zip(label, good, strict=True)) >= 0.9 * len(good)
    assert differ > 10 and right > 0.9 * differ


def test_html_fit():
    """The regression learns from pages that say what their blocks are, and nothing else moves it."""
    from parttrace.llm import html_extract as H

    pages = [f"<nav><a href='/'>Go {k}</a></nav><article><p>{SENTENCES}</p><p>Short {k}.</p></article><footer>us {k}</footer>" for k in range(30)]
    x, y = zip(*((H.looks(f), H._known(f)) for f in map(H.blocks, pages)), strict=True)
    x, y = np.concatenate(x), np.concatenate(y)
    w = H.fit(x[y >= 0], y[y >= 0])
    assert ((x[y >= 0] @ w > 0) == y[y >= 0]).all() and w[2] < 0 < w[1]
    assert (H.fit(x[y == 1], y[y == 1]) == H.START).all()


def test_minimum_cut_is_minimal():
    from itertools import product

    from parttrace.llm.html_extract import minimum_cut

    rnd = random.Random(6)
    for _ in range(60):
        n = rnd.randint(1, 8)
        cost = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = {(a, b): rnd.uniform(0, 1.5) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5}
        price = lambda label: sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(cost, label, strict=True)) + sum(w for (a, b), w in edges.items() if label[a] != label[b])  # noqa: E731, B023
        assert abs(price(minimum_cut(cost, edges)) - min(price(x) for x in product([False, True], repeat=n))) < 1e-6


def test_token_counts(spark):
    import public_tokenizers as P

    from parttrace.llm.token_counts import MARK, Automaton, load_pieces, token_counts

    def greedy(pieces, word):
        rest, n = MARK + word, 0
        while rest:
            k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces and (rest[0] == MARK) == (n == 0)), 0)
            if not k:
                return 1
            rest, n = rest[k:], n + 1
        return n

    rnd = random.Random(2)
    for _ in range(20):
        small = [MARK] * rnd.randint(0, 1) + [rnd.choice(["", MARK]) + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(8)]
        a = Automaton(small)
        for _ in range(50):
            w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
            assert a.count(w) == greedy(set(small), w), (small, w)
    path = P.path("piece_bpe_32k.model")
    pieces = set(load_pieces(path))
    got = token_counts(frame(spark, ODD + [(20, "The Quick the quick, brown-fox 日本 🎉", "s")]), path).collect()
    texts = dict((i, t) for i, t, _ in [*ODD, (20, "The Quick the quick, brown-fox 日本 🎉", "s")])
    assert all(r["n_tokens"] == sum(greedy(pieces, w) for w in re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in got)


def test_embeddings(spark, monkeypatch):
    from parttrace.llm import embed_dedup as E

    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    rows = [(k, (base[k % 40] + rng.standard_normal(24) * rng.choice([0, 0.05, 0.09])).astype(np.float32).tolist(), int(k % 40 % 3)) for k in range(400)]
    rows += [(500, rows[0][1], 1), (501, None, 0), (502, [0.0] * 24, 0), (503, [float("nan")] + [1.0] * 23, 0), (504, rows[0][1], None), (505, [], 0), (506, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("h", F.lit(1))
    got = {r["vec_id"]: r for r in E.near_duplicates(df).collect()}
    fine = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, x, p) in enumerate(fine) for b, z, q in fine[:k] if p == q and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= 0.93]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert all(got[i]["n_links"] <= n for i, n in count.items()) and sum(r["n_links"] for r in got.values()) >= 0.97 * 2 * len(links)
    component = union_find(list(count), links)
    assert np.mean([got[i]["component_id"] == c for i, c in component.items()]) > 0.97 and len(got) == len(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [0.1, 0.2, 0.26])
def test_embeddings_hot_third(spark, noise):
    """Recall against all pairs when one group of near copies holds a third of the vectors."""
    from parttrace.llm import embed_dedup as E

    rng = np.random.default_rng(int(noise * 100))
    x = rng.standard_normal((4500, 64)) / 8
    x[:1500] = x[0] + noise * rng.standard_normal((1500, 64)) / 8
    x[1500:2500] = x[3500:] + 0.2 * rng.standard_normal((1000, 64)) / 8
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(1) - 1
    count = np.array([got[k] for k in range(len(x))])
    assert (count <= true).all() and count.sum() >= 0.97 * true.sum() and count[1500:].sum() >= 0.9 * true[1500:].sum() > 0


def test_embeddings_lengths_and_ids(spark):
    """Many vector lengths, and different vectors with one id."""
    from parttrace.llm import embed_dedup as E

    rng = np.random.default_rng(5)
    rows = []
    for d in range(2, 102):
        v = rng.standard_normal(d)
        rows += [(2 * d, v.tolist(), 0), (2 * d + 1, (1.5 * v).tolist(), 0)]
    a, b = [1.0] * 150, [1.0, -1.0] * 75
    rows += [(1000, a, 0), (1000, b, 0), (1001, [2.0] * 150, 0), (1002, [3.0, -3.0] * 75, 0)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows) and {r["n_links"] for r in got} == {1}
    assert all(r["component_id"] == (r["vec_id"] // 2 * 2 if r["vec_id"] < 1000 else 1000) for r in got)


def test_license_passages(spark):
    from parttrace.llm.license_scan import TEMPLATES, scan, texts

    full = texts()
    mit = "MIT License\n\nCopyright (c) 2020 A\n\n" + "\n".join(" * " + x for x in full["mit-full"].split("\n"))
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n" + full["gpl-3-notice-full"][full["gpl-3-notice-full"].index("This program is distributed") :]
    bsd = TEMPLATES["bsd"].replace(" with or ", "\n// with or ").replace(" provided ", "\n// provided ")
    notice = "This tool was written by A in 2020 and is free. Released under the MIT License."
    prose = " ".join(sentences(12, 40))
    rows = [(20, mit, "s"), (21, gpl, "s"), (22, bsd, "s"), (23, notice, "s"), (24, prose + " " + notice + " " + prose + " " + notice, "s"), (25, prose + "\n" + full["gpl-3-full"] + "\n" + prose, "s"), (26, prose, "s"), (27, TEMPLATES["gpl-2.0"] + " " + TEMPLATES["gpl-3.0"], "s"), *ODD]
    got = {}
    for r in scan(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"], r["license"], round(r["dice"], 6)))
    words = lambda t: len(re.findall("[a-z0-9]+", t.lower()))
    assert got.pop(20) == [(6, 5 + words(full["mit-full"]), "mit-full", 1.0)]
    assert [x[2] for x in got.pop(21)] == ["gpl-3-notice-full"]
    assert got.pop(22) == [(0, words(bsd) - 1, "bsd", 1.0)]
    assert got.pop(23) == [(11, 15, "mit", 1.0)]
    n = words(prose)
    assert sorted(got.pop(24)) == [(n + 11, n + 15, "mit", 1.0), (2 * n + 27, 2 * n + 31, "mit", 1.0)]
    assert got.pop(25) == [(n, n + words(full["gpl-3-full"]) - 1, "gpl-3-full", 1.0)]
    assert [x[2:] for x in sorted(got.pop(27))] == [("gpl-2.0", 1.0), ("gpl-3.0", 1.0)]
    assert not got


def test_digest_index(spark):
    from parttrace.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, "digests_of_test", buckets=4)
    rows = [(3, "a  b", "s"), (1, "a b", "s"), (2, "a\t\nb", "s"), *ODD]
    got = index.add(frame(spark, rows)).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        t = next(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, _ in rows if hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() == r["text_sha256"])
        assert r["keep_id"] == min(i for i in groups[t] if i is not None) and r["group_size"] == len(groups[t]) and r["kept"] == (r["doc_id"] == r["keep_id"])
    later = index.add(frame(spark, [(0, "a b", "s"), (50, "new", "s"), (51, "new", "s")])).collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in later} == {0: (1, False), 50: (50, True), 51: (50, False)}
    before = index.table().count()
    assert index.add(frame(spark, [])).count() == 0 and index.table().count() == before == len(groups) + 1
    index.drop()


def test_mixing(spark):
    from parttrace.llm.mixing import mix, targets

    rows = [(k, t, ["b", "a", None, "é"][k % 7 % 4]) for k, t in enumerate(sentences(11, 300, low=1, high=90), 100)] + ODD
    out, slots = mix(frame(spark, rows), block=16, shards=5)
    got = out.collect()
    assert len(got) == len(rows) and {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    source = {i: s for i, _, s in rows}
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    goal, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * size[s]}
        if not full:
            break
        goal |= {s: 2.0 * size[s] for s in full}
        left -= sum(2.0 * size[s] for s in full)
        open_ -= full
    goal |= {s: weight[s] * share for s in open_}
    for s in order:
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert all(abs(r["target"] - goal[s]) < 1e-6 and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"] for r in mine)
        assert sum(r["taken"] for r in mine) == int(goal[s] + 1e-9)
        assert sum(r["words"] for r in slots.where(F.col("source").eqNullSafe(F.lit(s))).collect()) == int(goal[s] + 1e-9)
    # shards are of one size and draw their sources; every block of a pass is taken once
    drawn = slots.collect()
    n = {h: sum(r["shard"] == h for r in drawn) for h in range(5)}
    assert max(n.values()) - min(n.values()) <= 1
    share = {s: sum(r["source"] == s for r in drawn) / len(drawn) for s in order}
    counts = {(h, s): sum(r["shard"] == h and r["source"] == s for r in drawn) for h in range(5) for s in order}
    assert all(abs(counts[h, s] - n[h] * share[s]) <= 5 * (n[h] * share[s]) ** 0.5 + 1 for h, s in counts) and len(set(counts.values())) > len(order)
    for s in order:
        times = {}
        for r in drawn:
            if r["source"] == s:
                times[r["block"]] = times.get(r["block"], 0) + 1
        assert max(times.values()) - min(times.get(k, 0) for k in range(-(-size[s] // 16))) <= 1
    again = mix(frame(spark, rows[::-1]).repartition(3), block=16, shards=5)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(frame(spark, []))[0].count() == 0 and targets(spark.createDataFrame([], "source string, size long")).count() == 0


def test_components_and_filter(spark):
    rnd = random.Random(7)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)]
    ids = sorted({x for e in edges for x in e if e[0] != e[1]})
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in union_find(ids, [e for e in edges if e[0] != e[1]]).items()}
    some = spark.range(0, 1000, 7)
    kept = {r[0] for r in C.maybe_in(spark.range(1000), "id", C.id_filter(some)).collect()}
    assert {r[0] for r in some.collect()} <= kept and len(kept) < 200


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100, 1000])
def test_permutation(spark, n):
    """Each turn's indices are a permutation, and another one in each turn and source."""
    from parttrace.llm.mixing import _permuted

    rows = spark.range(n).selectExpr("id as place", f"{n}L as n", "explode(array(0L, 1L)) as turn", "0L as sid")
    got = {}
    for r in rows.withColumn("to", _permuted("place", "n", 7)).collect():
        got.setdefault(r["turn"], {})[r["place"]] = r["to"]
    assert all(sorted(x.values()) == list(range(n)) for x in got.values()) and (n < 8 or got[0] != got[1] != {k: k for k in range(n)})


def test_running_and_numbered(spark):
    rows = [(k % 3, k, k * k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, place long, v long")
    got = {(r["g"], r["place"]): r["base"] for r in C.running(df, ["g"], "place", "v", width=20).collect()}
    assert got == {(g, p): sum(v for h, q, v in rows if h == g and q < p) for g, p, _ in rows}
    got = {r["place"]: r["nr"] for r in C.numbered(df.repartition(7), "nr", F.col("place").desc()).collect()}
    assert got == {p: 499 - p for _, p, _ in rows}


def test_embedding_index():
    """Lists get deeper as labels grow, so that their average length stays bounded; near vectors still share one."""
    from math import comb

    from parttrace.llm import embed_dedup as E

    rng = np.random.default_rng(8)
    sample = rng.standard_normal((3000, 32))
    points = E._spread(sample, 400, 0.93)
    assert points.shape == (400, 32) and np.allclose((points**2).sum(1), 1)
    near = sample + 0.15 * rng.standard_normal(sample.shape)
    depths = []
    for largest in (5_000, 100_000, 3_000_000, 10**8):
        index = E.Index(0.93)
        index.add(32, points, largest)
        t, m = index.depth[32]
        depths.append(t)
        assert largest * comb(m, t) <= E.LIST * comb(400, t) or t == 3
        order, keys, core = index.describe(32, sample)
        assert order.shape == (3000, m) and keys.shape == (3000, comb(m, t)) and (np.sort(keys, 1) == np.sort(index.describe(32, 2.5 * sample)[1], 1)).all()
        other = index.describe(32, near)[1]
        cosine = (sample * near).sum(1) / np.linalg.norm(sample, axis=1) / np.linalg.norm(near, axis=1)
        found = np.array([len(np.intersect1d(a, b)) > 0 for a, b in zip(keys, other, strict=True)])
        assert found[cosine >= 0.93].mean() >= 0.9
        inside = core >= 0
        a, b = sample[inside][:200], core[inside][:200]
        a = a / np.linalg.norm(a, axis=1, keepdims=True)
        assert ((a @ a.T)[b[:, None] == b] >= 0.93).all()  # all of a core link with each other
    assert depths == sorted(depths) and depths[0] == 1 and depths[-1] == 3


def test_embedding_depths_agree(spark, monkeypatch):
    """Deeper lists, and blocks with cores of their own, count the same links."""
    from parttrace.llm import embed_dedup as E

    rng = np.random.default_rng(12)
    x = rng.standard_normal((900, 48)) / 7
    x[:300] = x[0] + 0.08 * rng.standard_normal((300, 48)) / 7
    x[300:600] = x[600:] + 0.15 * rng.standard_normal((300, 48)) / 7
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(None, x[5].tolist(), 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    plain = {(r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()}
    monkeypatch.setattr(E, "BLOCK", 64)
    monkeypatch.setattr(E, "PER", 4)
    for depths in (((1, 4),), ((2, 6),)):
        monkeypatch.setattr(E, "DEPTHS", depths)
        assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()} == plain


def test_digest_index_persists(spark, tmp_path):
    """A second object of that name finds the first one's digests; batches and compaction change nothing."""
    from parttrace.llm import exact_dedup as X

    texts = sentences(3, 60, vocabulary=6, low=1, high=3)
    rows = [(k * 7 % 61, t, "s") for k, t in enumerate(texts)] + [(None, texts[0], "s"), (None, "alone", "s"), (3, texts[1], "s")]
    plain = lambda df: sorted(map(str, df.collect()))
    one = X.DigestIndex(spark, "first_index", 4, str(tmp_path))
    wanted = plain(one.add(frame(spark, rows)))
    two = X.DigestIndex(spark, "second_index", 4, str(tmp_path))
    assert plain(two.add(frame(spark, rows), batches=3)) == wanted
    size = two.table().count()
    spark.sql("DROP TABLE second_index")  # as a new session: only the files are left
    again = X.DigestIndex(spark, "second_index", 4, str(tmp_path))
    assert again.table().count() == size and plain(again.add(frame(spark, rows), batches=2)) == wanted and again.table().count() == size
    again.add(frame(spark, [(k, f"new {k}", "s") for k in range(100, 140)]), batches=4)
    again.compact()
    files = again.table().inputFiles()
    assert again.version == 1 and len(files) <= 4 and again.table().count() == size + 40
    (tmp_path / "second_index.index" / "v2").mkdir()  # a version that isn't whole doesn't count
    third = X.DigestIndex(spark, "second_index", 4, str(tmp_path))
    assert third.version == 1 and plain(third.add(frame(spark, rows))) == wanted
    for index in (one, third):
        index.drop()
    assert not list(tmp_path.glob("*.index"))


def test_fingerprint_of_files(spark, tmp_path):
    from parttrace.llm.exact_dedup import fingerprint

    frame(spark, [(1, "a", "s")]).write.parquet(str(tmp_path / "t"))
    first = fingerprint(spark.read.parquet(str(tmp_path / "t")))
    assert first == fingerprint(spark.read.parquet(str(tmp_path / "t")))
    frame(spark, [(2, "b", "s")]).write.mode("append").parquet(str(tmp_path / "t"))
    assert first != fingerprint(spark.read.parquet(str(tmp_path / "t")))


def test_network_against_a_plain_loop():
    """Forward scores of every window equal those of a loop over words and units."""
    from math import exp, tanh

    from parttrace.llm import toxicity as X

    texts = ["a bad day, a BAD day!!", "some other words here " * 12, "x"]
    words = X.Words(pa.array(texts))
    net = X.Network(np.sort(words.hashes[::2]), 3)
    net.shift = 0.25
    p = {k: v.astype(float) for k, v in net.p.items()}
    _, x = net.inputs(words)
    first = words.first.tolist()
    sigmoid = lambda v: 1 / (1 + exp(-v))
    H = X.HIDDEN

    def run(seq, side):
        W, U, c = p[f"W{side}"], p[f"U{side}"], p[f"c{side}"]
        state, out = [0.0] * H, []
        for v in seq:
            g = v @ W + c
            a = np.array(state) @ U[:, : 2 * H]
            z = [sigmoid(g[k] + a[k]) for k in range(H)]
            r = [sigmoid(g[H + k] + a[H + k]) for k in range(H)]
            b = np.array([r[k] * state[k] for k in range(H)]) @ U[:, 2 * H :]
            new = [tanh(g[2 * H + k] + b[k]) for k in range(H)]
            state = [new[k] + z[k] * (state[k] - new[k]) for k in range(H)]
            out.append(state)
        return out

    scores = []
    for d in range(3):
        own = words.index[first[d] : first[d + 1]]
        starts = sorted({*range(0, max(1, len(own) - X.WINDOW + 1), X.STRIDE), max(0, len(own) - X.WINDOW)})
        best = -1e9
        for s in starts:
            seq = [x[i].astype(float) for i in own[s : s + X.WINDOW]]
            pad = [x[-1].astype(float)] * (X.WINDOW - len(seq))
            fwd, bwd = run(seq, "f"), run((seq + pad)[::-1], "b")[::-1]
            both = [np.array([*f, *b]) for f, b in zip(fwd, bwd, strict=False)]
            weight = [exp(np.tanh(h @ p["A"] + p["a0"]) @ p["a"]) for h in both]
            pooled = sum(w * h for w, h in zip(weight, both, strict=True)) / sum(weight)
            best = max(best, float(pooled @ p["o"] + p["o0"][0]))
        scores.append(1 / (1 + exp(-(best - net.shift))))
    assert np.allclose(net.scores(pa.array(texts)), scores, atol=1e-5)


def test_quality_against_a_plain_loop(monkeypatch):
    """Features of long texts in pieces, and scores from the curves one by one."""
    from parttrace.llm import quality as Q

    texts = [*sentences(1, 30), "", None, "ALL CAPS!! " * 40, "é ü " * 500, "x" * 5000, "line\nline\n" * 30]
    x = Q.features(pa.array(texts))
    monkeypatch.setattr(Q, "PIECE", 97)
    assert np.allclose(Q.features(pa.array(texts)), x)
    for t, row in zip(texts, x, strict=True):
        b = (t or "").encode()
        for k, group in enumerate(Q._GROUPS):
            assert abs(row[k] - sum(c in group for c in b) / max(1, len(b))) < 1e-12
    good = np.array([k % 2 for k in range(len(texts))])
    model = Q.Ranking(x, good)
    for row, s in zip(x, model.scores(x), strict=True):
        total = sum(model.weights[model.at[k] + sum(v >= c for c in model.cuts[k])] for k, v in enumerate(row))
        assert abs(s - 1 / (1 + np.exp(-(total - model.threshold) / model.scale))) < 1e-9


def test_quality_learns_from_all_labels(spark):
    """The poor texts are the last ones by hashed id, after 12,000 good ones."""
    from parttrace.llm.quality import quality

    ids = spark.range(12_600).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("place"))
    rows = C.stored(ids.select("doc_id", (F.col("place") <= 12_000).cast("int").alias("quality")), "ranked", 12_600)
    docs = rows.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("a plain sentence of number "), "doc_id")).otherwise(F.concat(F.lit("BUY NOW!! "), "doc_id", F.lit("$$"))).alias("text"))
    wrong = quality(docs, rows).join(rows, "doc_id").where("predicted <> quality")
    assert wrong.count() == 0


def test_quality_fit_against_all_pairs(spark, monkeypatch):
    """Loss and gradient of every pair, values at ranks against a sort; rows of several tasks give what rows in memory do."""
    from parttrace.llm import quality as Q

    monkeypatch.setattr(Q, "EACH", 40)

    rng = np.random.default_rng(1)
    steps, good, weights = rng.integers(0, 25, (Q.FEATURES, 300)).astype(np.uint8), (rng.random(300) < 0.7).astype(int), rng.normal(size=(Q.FEATURES, 25)) * 0.3
    loss, raw = Q._Loss(Q._Held(steps, good), weights), weights[np.arange(Q.FEATURES)[:, None], steps].sum(0)
    lead = raw[good == 0][None] - raw[good == 1][:, None]
    away, grad = 1 / (1 + np.exp(-lead)), Q.RIDGE * weights
    for k in range(Q.FEATURES):
        grad[k] += (np.bincount(steps[k][good == 0], away.sum(0), 25) - np.bincount(steps[k][good == 1], away.sum(1), 25)) / away.size
    assert abs(loss.value - np.logaddexp(0, lead).mean() - Q.RIDGE / 2 * (weights**2).sum()) < 1e-4 and np.abs(loss.gradient() - grad).max() < 1e-5
    values, ranks = rng.normal(size=(3, 999)).round(1), np.array([0, 5, 500, 998])
    assert (Q._at_ranks(Q._Held(values, good), lambda x: x, 3, ranks) == np.sort(values, 1)[:, ranks]).all()
    texts = sentences(1, 150) + [t.upper() + "!!" if k % 4 else t for k, t in enumerate(sentences(2, 150))]
    docs, labels = frame(spark, [(k, t, "s") for k, t in enumerate(texts)]), [int(k < 150) for k in range(300)]
    told = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    there, here = Q.fitted(Q._featured(docs, "doc_id").repartition(3), told), Q.Ranking(Q.features(pa.array(texts)).astype(np.float32), np.array(labels))
    assert all((a == b).all() for a, b in zip(there.cuts, here.cuts, strict=True))
    assert (there.weights == here.weights).all() and there.threshold == here.threshold and there.scale == here.scale


@pytest.mark.parametrize("name", ["bpe", "html", "tokens", "toxicity", "quality", "mixing", "licenses", "embeddings"])
def test_empty_tables(spark, name):
    import public_tokenizers as P

    from parttrace.llm import bpe, embed_dedup, html_extract, license_scan, mixing, quality, token_counts, toxicity

    docs = frame(spark, [])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = {
        "bpe": lambda: bpe.bpe(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "html": lambda: html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")),
        "tokens": lambda: token_counts.token_counts(docs, P.path("piece_bpe_32k.model")),
        "toxicity": lambda: toxicity.toxicity(docs, none),
        "quality": lambda: quality.quality(docs, none),
        "mixing": lambda: mixing.mix(docs)[1],
        "licenses": lambda: license_scan.scan(docs),
        "embeddings": lambda: embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    }[name]()
    assert made.count() == 0 and made.columns
