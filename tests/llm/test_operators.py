"""The operators against brute force, and their defined cases on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import common, embedding_dedup, fingerprints, html_text, language_id, mixing, ngram_join, packing, queries, substring_dedup, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
ODD = [(None, "x y z"), (-1, None), (-2, ""), (-3, " a  b \t"), (-4, "a\nb\n"), (-5, "x y z"), (-5, "x y z"), (-6, "ΑΣ <|endoftext|> x<s>y é İ"), (-7, "one two three " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return d.unionAll(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "1 as _bucket", "'x' as lang", "text as component_id")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def substrings(rows):
    """(doc_id, n_words, n_removed, kept_sha256) by brute force."""
    own = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if i is not None:
                own[k] = min(own.get(k, i), i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if i is not None and own[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = True
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(" ".join(a for a, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(want, key=repr)


def test_substring(spark, docs, rows):
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs).collect()), key=repr)
    assert got == substrings(rows)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("parts", [4096, 8])
def test_substring_hot_passages(spark, monkeypatch, parts):
    """Passages in a third of all documents and in few, alone and cut, between other words and each other."""
    monkeypatch.setattr(common, "HOT_PARTS", parts)
    rng = np.random.default_rng(5)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((50, 55, 120, 400, 49))]
    data = []
    for i in range(240):
        w = [f"d{i}_{j}" for j in range(int(rng.integers(0, 60)))]
        for k in rng.choice(5, int(rng.integers(0, 4))):
            p = passages[k]
            a = int(rng.integers(0, 3)) * 20 if len(p) > 100 and i % 2 else 0
            w += p[a:] + [f"e{i}_{j}" for j in range(int(rng.integers(0, 3)) * 10)]
        data.append((int(i // 1.05), " ".join(w)))
    data += [(500 + i, " ".join(passages[3])) for i in range(120)] + [(None, " ".join(passages[2]))] * 3
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=repr)
    assert got == substrings(data)


def test_substring_checks_words():
    """A span whose check isn't that of the words there stays."""
    real = substring_dedup.textnum.Words
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    a, b = (real([t]).runs(50) for t in texts)
    assert not set(a.tolist()) & set(b.tolist())
    second = [real([t], check=True).runs(50) for t in texts]
    spans = [{"b": 0, "e": 11, "v": int(substring_dedup._checks(second[0], np.array([0]), np.array([11])).view(np.int64)[0])}]
    import pyarrow as pa

    one = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "text_key": 0, "spans": spans} for i, t in enumerate(texts)])
    got = next(substring_dedup._cut(50)(one))
    assert got.column("n_removed").to_pylist() == [60, 0]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, monkeypatch, few):
    """Stars, a chain, a cycle and pairs, with hot vertices spread and not."""
    monkeypatch.setattr(common, "FEW_EDGES", few)
    monkeypatch.setattr(common, "HOT_PARTS", 16)
    edges = [(5000, i) for i in range(300)] + [(400, i) for i in range(401, 600)] + [(i, i + 1) for i in range(700, 760)] + [(800, 801), (801, 802), (802, 800), (900, 901), (901, 900), (950, 950)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark)).collect()}
    want = {i: 0 for i in (*range(300), 5000)} | {i: 400 for i in range(400, 600)} | {i: 700 for i in range(700, 761)} | {i: 800 for i in (800, 801, 802)} | {900: 900, 901: 900}
    assert got == want


@pytest.mark.parametrize("small", [64, 1])
def test_ngram_join(spark, docs, rows, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    base = [f"w{i}" for i in range(60)]
    near = [(1000 + i, " ".join([*base[:20], f"x{i}", f"y{i}", *base[20 : 20 + 10 * (i % 5)], *base])) for i in range(30)]
    data = [r for r in rows if r[0] is not None] + near
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(data, "doc_id long, text string"), 3, 90, 100).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in data:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())))
    comp = {i: i for i, _ in sets}
    changed = True
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 100 * len(x & y) >= 90 * len(x | y)]
    while changed:
        changed = False
        for i, j in links:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    assert got == {(i, len(x), comp[i]) for i, x in sets}
    assert ngram_join.ngram_components(empty(spark)).count() == 0


def test_fingerprints(spark, docs, rows):
    named = [r for r in rows if r[0] is not None and r[0] != -5]
    d = spark.createDataFrame(named, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(d).collect()}
    order = sorted(named, key=lambda r: -r[0])
    for n, (i, t) in enumerate(order):
        e = fingerprints.edited(t or "", order[(n + 1) % len(order)][1] or "")
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t or "")
    assert fingerprints.neighbour_fingerprints(empty(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[100:200] = x[:100] + 0.05 * rng.normal(size=(100, 16))
    x[200:210] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(400)])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_embeddings_of_two_widths(spark):
    rng = np.random.default_rng(2)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(6, 8)))] + [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [1.0, 2.01]), (13, [-2.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (10, 11, 12, 13)] == [(2, 10, True), (2, 10, False), (2, 10, False), (0, 13, True)]


def test_tokens_and_packing(spark, docs, rows):
    import sentencepiece
    from tokenizers import Tokenizer

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert got == sorted((len((t or "").encode()), len(sp.encode(t or ""))) for _, t in rows)
    tk = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    want = sorted(zlib.crc32(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows if len(tk.encode(t or "").ids) < 40)
    pieces = packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    whole = [r.ids_crc32 for r in pieces if r.length == r.doc_tokens and r.doc_tokens <= 40]
    assert set(whole) <= set(want)
    total, ends = sum(r.length for r in pieces), {}
    assert total == sum(len(tk.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n & (n - 1) == 0 and n <= 4096 for n in ends.values())


def test_packing_finds_neighbours_in_other_files(spark):
    rng = np.random.default_rng(3)
    topics = ["river water boat fish bridge", "engine wheel motor brake tyre", "bread flour oven salt yeast", "piano violin song choir drum", "tooth nurse fever blood pill", "goal player match team score", "judge court law crime prison", "star planet moon orbit comet"]
    data = [(i, " ".join(rng.choice(topics[i % 8].split(), 30))) for i in range(512)]
    path = queries.tokenizer("word_bpe_49k.json")
    packed = []
    for files, rows in ((1, data), (7, data[::-1])):
        d = spark.createDataFrame(spark.sparkContext.parallelize(rows, files), "doc_id long, text string")
        packed.append(sorted(tuple(r) for r in packing.pack(d, path, length=128, shard_docs=32).select("doc_id", "start", "length", "sequence_id", "offset").collect()))
    # which neighbours a document has doesn't depend on the files
    assert packed[0] == packed[1] and {r[0] for r in packed[0]} == set(range(512))
    found = {}
    for i, _, n, sequence, _ in packed[0]:
        found.setdefault(sequence, []).append((i % 8, n))
    full = [w for w in found.values() if sum(n for _, n in w) == 128]
    assert len(full) > 64 and sum(len({t for t, _ in w}) == 1 for w in full) >= 0.6 * len(full)  # in file order none


def test_mixing(spark):
    data = [(i, "w " * (i % 50 + 1), ["b", "a", None][i % 3]) for i in range(600)] + [(600, None, "a"), (601, "", "z")]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
        assert r.taken <= 3 * r.size
    assert abs(sum(r[1] for r in by.values()) - total) < 1e-6 and all(abs(a - b) <= 1 for a, b in by.values())
    assert by["a"][1] > by["b"][1] > 0
    assert mixing.mix(empty(spark)).count() == 0


def test_html():
    page = "<html><body><nav><a href=x>Menu</a></nav><div class=ad>Buy</div><article><h1>A &amp; B</h1><p><b>One<br><p>Two\n  lines</p><div class='comments'>me too</div></article><footer>c</footer></body></html>"
    assert html_text.main_text(page) == "A & B\n\nOne\n\nTwo lines"
    assert html_text.main_text(None) == "" == html_text.main_text("<p")


def test_html_article_is_a_feature():
    text = "This is the text of the page and it has all of the words that are frequent in it. " * 4
    list_ = "".join(f"<li><a href=/{i}>Label number {i}</a></li>" for i in range(9))
    # main text outside of the page's one article, a teaser
    page = f"<div><p>{text}</p><p>{text}</p></div><article><h3><a href=x>Another story that we have for you</a></h3><p><a href=x>Read it</a></p></article>"
    assert html_text.main_text(page) == f"{text.strip()}\n\n{text.strip()}"
    # links and long blocks without stop words inside the article, whose classes say nothing
    bare = "shoes hats coats gloves scarves boots " * 9
    page = f"<article><p>{text}</p><p>Short one.</p><p>{text}</p><div class=x1><ul>{list_}</ul><p>All prices</p><p>{bare}</p></div></article>"
    assert html_text.main_text(page) == f"{text.strip()}\n\nShort one.\n\n{text.strip()}"
    # a language that the lists don't know
    page = f"<nav><a href=x>Menu</a></nav><article><p>{bare}</p><p>{bare}</p></article>"
    assert html_text.main_text(page) == f"{bare.strip()}\n\n{bare.strip()}"


def test_language_and_toxicity(spark):
    d = spark.createDataFrame([(i, t, lang) for i in range(40) for t, lang in [("the cat and the dog are here", "en"), ("der Hund und die Katze sind da", "de")]], "doc_id long, text string, lang string")
    m = language_id.train(d)
    assert m.predict("the dog")[0] == "en" and m.predict("die Katze")[0] == "de" and m.predict("12 !")[0] == "und" == m.predict(None)[0]
    assert language_id.train(empty(spark)).predict("abc") == ("und", 0.0)
    t = spark.createDataFrame([(i, f"word{i} idiot here" if i % 2 else f"word{i} nice here", i % 2) for i in range(80)], "doc_id long, text string, toxic int")
    x = toxicity.train(t, t.select("doc_id", "toxic"))
    assert x.score("an 1d10t") > 0.5 > x.score("nice") and x.score("an іdiot") > 0.5 and 0 <= x.score(None) < 0.5
    assert toxicity.fold("Cl0wn") == toxicity.fold("clown")
