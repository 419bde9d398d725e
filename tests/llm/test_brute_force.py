"""The operators without SQL against plain versions of themselves, SQL on the smallest tables, and odd rows."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, fingerprints, html_text, language_id, mixing, ngram_join, packing, queries, substring_dedup, textnum, token_counts, toxicity

SF = "/root/testdata/sf0.001"
POOL = "abcdeEéÈüñßſİıΣςσаяЖ한ᄀ‘’“”…´¨¸`^~=<>!?.,;:'\"-_&%$#@0129½²ⅣЌ̸̧̣́̈̃ᅡᆨ​‍﻿\xad \t\n\r\x0b\x0c\x85\xa0 　\x1c🙂👍🏽ͅοÅﬁ;·▁"


def odd_strings(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        s = "".join(rng.choice(POOL) for _ in range(rng.randint(1, 14)))
        yield unicodedata.normalize("NFD", s) if i % 3 == 0 else s


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


def test_packed_ids_are_the_library_s():
    coder = packing.WordIds(queries.tokenizer("word_bpe_49k.json"))
    assert coder.direct
    for s in [*odd_strings(8000, 1), "é", "café.", "≠", "ȫx", "don't é's"]:
        assert np.frombuffer(coder.encode([s])[0], coder.kind).tolist() == coder.tokenizer.encode(s, add_special_tokens=False).ids, ascii(s)


def test_token_counts_are_the_library_s():
    path = queries.tokenizer("piece_bpe_32k.model")
    texts = list(odd_strings(8000, 2))
    got = token_counts._Lookup(path, {}).counts(texts)
    for t, n in zip(texts, got, strict=True):
        assert n == len(token_counts.model(path).encode(t)), ascii(t)


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "é äb"), (-4, "word " * 9000), (-5, "x y"), (-5, "x y"), (None, "z"), (None, "z z")], "doc_id long, text string"))
    left = {}
    for r in docs.collect():
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        left.setdefault(r.doc_id, []).append(ids)
    pieces = {}
    for r in packing.pack(docs, path).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(left)
    for i, texts in left.items():
        # each row's ids are tiled by pieces with their checksums, and no piece is left over
        own = sorted(pieces[i], key=lambda r: r.start)
        for ids in texts:
            at = 0
            while at < len(ids):
                r = next(r for r in own if r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()))
                own.remove(r)
                at += r.length
            assert at == len(ids)
        assert not own


def test_toxic_hits_by_plain_search():
    rng = random.Random(3)
    words = ["bad", "idiot", "clown car", "fool", "foolish"]
    model = toxicity.Model({toxicity.fold(w): float(i + 1) for i, w in enumerate(words)}, {toxicity.fold(p) for p in ("not bad", "bad luck", "april fool day")})
    vocabulary = ["bad", "b4d", "BAD", "bаd", "badly", "idiot", "1d10t", "clown", "car", "fool", "f00l", "foolish", "not", "luck", "april", "day", "good", "x" * 50]
    for _ in range(400):
        t = toxicity.fold(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))))

        def alone(s, e, t=t):
            return not (s and t[s - 1].isalpha()) and not (e < len(t) and t[e].isalpha())

        def found(w, t=t):
            return [(m.start(), m.start() + len(w)) for m in re.finditer(f"(?={re.escape(w)})", t) if alone(m.start(), m.start() + len(w))]

        covered = [x for p in model.exceptions for x in found(p)]
        want = sorted((s, e, x) for w, x in model.weights.items() for s, e in found(w) if not any(a <= s and e <= b for a, b in covered))
        assert sorted(model.hits(t)) == want


def test_exception_phrases_take_whole_words():
    long = "y" * 60
    t = f"{long} bad {long}2"
    s = t.index("bad")
    assert toxicity._phrases(t, s, s + 3) == [f"{long} bad", f"bad {long}"]
    assert toxicity._phrases("bad", 0, 3) == [] and toxicity._phrases("9 bad", 2, 5) == []


def test_toxicity_on_held_out_rows(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)


def test_language_by_plain_scoring(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    langs, tables, values = model.langs, model.tables, model.values

    def word(w):
        if w in tables[0]:
            return values[tables[0][w]]
        for k in range(language_id.MAX_GRAM, 0, -1):
            padded = w if k == 1 else f"\x02{w}\x03"
            known = [values[tables[k][padded[i : i + k]]] for i in range(len(padded) - k + 1) if padded[i : i + k] in tables[k]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    texts = [r.text for r in docs.limit(60).collect()] + ["unbekanntheit zzqx", "12 34", None, "", "Ünï çà", "ж"]
    for t in texts:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        lang, score = model.predict(t)
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        total = np.sum([word(w) for w in words], axis=0)
        p = np.exp((total - total.max()) / np.sqrt(len(words)))
        assert lang == langs[int(total.argmax())] and abs(score - p.max() / p.sum()) < 1e-6


def test_language_counts_and_held_out_rows(spark):
    rows = [(0, "aa bb aa", "x"), (1, "bb cc", "y"), (2, "aa", "y"), (3, None, "x"), (4, "dd", None)]
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ["x", "y"] and set(m.tables[0]) == {"aa", "bb", "cc"}
    places = sum(map(len, m.tables))
    assert np.allclose(m.values[m.tables[0]["aa"]], np.log([(2 + 0.1) / (3 + 0.1 * (places + 1)), (1 + 0.1) / (3 + 0.1 * (places + 1))]))
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)


def test_fingerprint_likeness_against_jaccard():
    rng = np.random.default_rng(4)
    off = []
    for _ in range(120):
        n, keep = int(rng.integers(20, 600)), rng.random()
        a = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        b = [w if rng.random() < 0.8 + keep / 5 else f"v{w}" for w in a]
        sa, sb = ({tuple(x[i : i + fingerprints.WORDS]) for i in range(len(x) - fingerprints.WORDS + 1)} for x in (a, b))
        pa_, pb = fingerprints.fingerprints([" ".join(a), " ".join(b)])
        off.append(fingerprints.likeness(pa_, pb) - len(sa & sb) / len(sa | sb))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08 and np.abs(off).max() < 0.3
    one, two, none = fingerprints.fingerprints(["a b", "a  b\n", ""])
    assert one == two and none == b"" and fingerprints.likeness(one, none) == 0.0 and fingerprints.likeness(none, none) == 1.0


def test_densification_is_a_plain_rule():
    """A bin holds its least hash; an empty one takes that of the first full bin among its tries."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 500):
        s = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        got = fingerprints.minhash(s)
        bins = len(got)
        own = {}
        for x in s.tolist():
            b = x >> (64 - (bins - 1).bit_length())
            own[b] = min(own.get(b, x), x)
        for b in range(bins):
            at, block = b, 0
            while at not in own:
                at = next((int(t) for t in fingerprints._probe(bins, block)[b] if int(t) in own), b)
                block += 1
            assert int(got[b]) == own[at]


@pytest.mark.parametrize(("hot", "most"), [(False, 4096), (True, 4096), (False, 5), (True, 5)])
def test_embeddings_in_many_cells(spark, monkeypatch, hot, most):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    if most == 5:  # large cells that are split once more
        monkeypatch.setattr(embedding_dedup, "MAX_CELLS", most)
        monkeypatch.setattr(embedding_dedup, "SPLIT", 300)
        monkeypatch.setattr(embedding_dedup, "PIECE", 128)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2400, 24))
    x[1200:1800] = x[:600] + 0.17 * rng.normal(size=(600, 24))  # near the threshold
    if hot:
        x[1800:2200] = x[0] + 0.02 * rng.normal(size=(400, 24))
        x[2200:2300] = x[7]
    assert len(x) // 40 >= 50
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = np.argwhere(np.triu(u @ u.T >= 0.95, 1))
    want, root = np.zeros(len(x), int), list(range(len(x)))

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in links:
        want[a] += 1
        want[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() > 0
    same = [got[i].component_id == find(i) for i in range(len(x))]
    assert np.mean(same) >= 0.99 and all(got[i].kept == (got[i].component_id == i) for i in got)


def test_mixing_repeats_and_partitionings(spark):
    rows = [(i % 37 if i % 5 else None, "w " * (i % 11), ["s", None, "t"][i % 3]) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.mix(x).collect()), key=repr) for x in (d, d.repartition(13)))
    assert a == b and len(a) == 300 and sum(r[5] for r in a) == sum(r[1] for r in a)
    assert mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).agg(F.sum("taken")).first()[0] == 0
    with pytest.raises(ValueError):
        mixing.mix(d, (1.5,))


def test_mixing_in_several_rounds(spark, monkeypatch):
    rows = [(i, "w " * (i * 7919 % 53), "abcdefg"[i % 7]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(d).collect()), key=repr)
    monkeypatch.setattr(mixing, "RANGES", 3)
    monkeypatch.setattr(mixing, "LAST", 4)
    assert sorted(map(tuple, mixing.mix(d).collect()), key=repr) == want


def test_pages_as_a_table(spark):
    deep = "<div>" * 30000 + "deep text" + "</p>" * 30000
    rows = [(1, "u", "<article><p>One &lt; two</p></article>"), (1, "u", "<article><p>One &lt; two</p></article>"), (None, None, None), (2, None, ""), (3, "v", deep), (4, "w", "plain")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars long, text string")
    got = sorted(map(tuple, html_text.extract(d).collect()), key=repr)
    assert got == sorted([(1, "u", "One < two", 9), (1, "u", "One < two", 9), (None, None, "", 0), (2, None, "", 0), (3, "v", "deep text", 9), (4, "w", "plain", 5)], key=repr)
    assert html_text.extract(d.limit(0)).count() == 0


def test_article_parts_and_frames():
    page = '<article><header class="entry-header"><h1>Title</h1></header><div class="legal-history"><p>The history of the law is long and it was hard for all.</p></div><h2 class="section-header">Part</h2><p id="search">How we search for it and what is found in the end.</p><div class="related-posts"><p>Other posts that you may like and that are good.</p></div><div class="comments"><p>I like it and so do you.</p></div></article>'
    assert html_text.main_text(page) == "Title\n\nThe history of the law is long and it was hard for all.\n\nPart\n\nHow we search for it and what is found in the end."


ODD = [(None, None, None, None), (None, "x y z", "s", None), (1, "", "s", "en"), (1, "a b c d e f g", "s", "en"), (1, "a b c d e f g", "s", "en"), (2, "a b c d e f g", None, "de"), (3, "long words here " * 20000, "t", "en"), (4, " \t\n ", "t", None), (5, "12 !?", "s", "en")]
EXTRA = "doc_id long, text string, source string, lang string, size int, key string, rows long, anchor string, _range int, tie int, component_id long, score string, held_out int, place int, n int"


def odd_calls(spark):
    none = F.lit(False)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    word, piece = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("piece_bpe_32k.model")
    return {
        "op1": lambda d: toxicity.score(d, toxicity.train(d, labels), none),
        "op2": lambda d: language_id.identify(d.select("doc_id", "text"), language_id.train(d)),
        "op3": fingerprints.neighbour_fingerprints,
        "op5": lambda d: ngram_join.ngram_components(d, 3, 90, 100),
        "op6": mixing.mix,
        "op8": lambda d: token_counts.token_counts(d, piece),
        "op9": substring_dedup.substring_dedup,
        "op10": lambda d: packing.pack(d, word),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op8", "op9", "op10"])
def test_odd_rows(spark, name):
    """Nulls, empty and long texts, repeats, clashing columns and an empty table: every row has its result."""
    call = odd_calls(spark)[name]
    odd = spark.createDataFrame([(*r, 1, "k", 2, "a", 3, 4, 5, "s", 6, 7, 8) for r in ODD], EXTRA)
    got = call(odd).collect()
    ids = sorted((r.doc_id for r in got), key=repr)
    if name == "op10":
        assert set(ids) == {r[0] for r in ODD} and sum(r.start == 0 for r in got) == len(ODD)
    else:
        assert ids == sorted((r[0] for r in ODD), key=repr)
    assert call(odd.limit(0)).count() == 0


def test_odd_vectors(spark):
    rows = [(None, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.1]), (8, [1e300, 0.0]), (9, [1.0])]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, unit string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(d).collect()}
    assert {(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 1, False), (8, 2, 1, False), (9, 0, 9, True)} <= got
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_words_split_and_hash():
    texts = ["a\x0bb\x1cc  d", "", None, " x ", "a\x0bb\x1cc  d"]
    w = textnum.Words(texts)
    assert w.counts().tolist() == [3, 0, 0, 1, 3]
    assert w.hashes[:3].tolist() == w.hashes[-3:].tolist() and w.hashes.tolist() != textnum.Words(texts, check=True).hashes.tolist()
