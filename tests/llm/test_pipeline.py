"""The stages of the pipeline, each against what it may do to the documents that it gets."""

import re

import corpus_pipeline
import pytest

from plumbline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, _cut string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "x", "y") for i, t, lang, s in rows], COLUMNS)


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


def text_rows():
    shared = words("s", 60)
    near = words("n", 120)
    return [
        (1, " ".join(near), "en", "a"),
        (2, " ".join([*near[:119], "other"]), "en", "a"),  # near copy of 1
        (3, " ".join(words("d", 80) + shared), "en", "b"),
        (4, " ".join(words("e", 80) + shared + words("f", 20)), "en", "b"),  # repeats 60 words of 3
        (5, "12345 67890", "en", None),  # no letter
        (6, None, None, None),
        (7, "", "en", "a"),
        (8, "short text here", "en", None),
        (8, "short text here", "en", None),
        (9, " ".join(words("long", 30000)), "en", "a"),
        (None, "a row without an id", "en", "b"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return made(spark, text_rows())


def test_language_stage(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    # rows without a letter go, every other row stays, repeated ones too
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, t, _, _ in text_rows() if t and re.search("[a-z]", t))


def test_language_stage_without_labels(spark):
    rows = [(i, t, None, s) for i, t, _, s in text_rows()]
    out = corpus_pipeline.language(spark, made(spark, rows), "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, t, _, _ in rows if t and re.search("[a-z]", t))


def test_near_duplicate_stage(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "5", "6", "7", "8", "9", "None"]


def test_near_duplicates_with_repeated_ids(spark):
    a, b, c = words("a", 120), words("b", 120), words("c", 120)
    rows = [
        (1, " ".join(a), "en", "x"),
        (2, " ".join([*a[:119], "other"]), "en", "x"),  # near copy of 1
        (2, " ".join(b), "en", "x"),
        (2, " ".join(c), "en", "z"),
        (2, " ".join(c), "en", "y"),
        (3, " ".join([*b[:119], "other"]), "en", "x"),  # near copy of a text of 2
    ]
    got = corpus_pipeline.near_duplicates(spark, made(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted((rows[i][0], rows[i][1], rows[i][3]) for i in (0, 2, 4))


def test_substring_stage(spark, docs):
    out = corpus_pipeline.repeated_spans(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(text_rows())
    assert WORD.findall(got[4].text) == words("e", 80) + words("f", 20)
    assert got[4].n_chars == len(got[4].text)
    assert WORD.findall(got[2].text) == ["other"]
    same = {i: t for i, t, _, _ in text_rows() if i in (1, 3, 5, 6, 7, 8, 9)}
    assert {i: got[i].text for i in same} == same


def test_mixing_stage(spark, docs):
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    rows = out.collect()
    whole = {i: WORD.findall(t or "") for i, t, _, _ in text_rows()}
    for r in rows:
        w = WORD.findall(r.text)
        assert w and w == whole[r.doc_id][: len(w)] and r.n_chars == len(r.text)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    for i, n in taken.items():
        assert sum(len(WORD.findall(r.text)) for r in rows if r.doc_id == i) == n


def test_mixing_stage_with_ties(spark):
    """Each row gets its own take, whatever ids and sizes rows share."""
    rows = [(None, f"a{i % 3} b c d e", "en", "x") for i in range(9)] + [(7, t, "en", s) for t in ("k l m", "k l m", "n o p") for s in ("x", "y", None)] + [(1, "z " * 40, "en", "y")]
    d = made(spark, rows)
    mixed = mixing.mix(d).collect()
    out = corpus_pipeline.mixture(spark, d, "").collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == sum(r.taken for r in mixed) == sum(r.size for r in mixed)
    for s in ("x", "y", None):
        assert sum(len(WORD.findall(r.text)) for r in out if r.source == s) == sum(r.taken for r in mixed if r.source == s)
        cut = [r for r in out if r.source == s and len(WORD.findall(r.text)) not in (3, 5, 40)]
        assert len(cut) <= 1  # only the document that the queue is at
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, corpus_pipeline.mixture(spark, d.repartition(5), "").collect()), key=repr)


def test_substring_stage_with_repeated_ids(spark):
    shared = words("s", 60)
    rows = [(1, " ".join(shared), "en", "a"), (2, " ".join([*words("g", 30), *shared]), "en", "b"), (2, " ".join(words("h", 70)), "en", "c"), (2, None, "en", "d")]
    got = {r.source: r.text for r in corpus_pipeline.repeated_spans(spark, made(spark, rows), "").collect()}
    assert got == {"a": rows[0][1], "b": " ".join(words("g", 30)), "c": rows[2][1], "d": None}


def test_packing_stage_and_empty_tables(spark, docs):
    out = corpus_pipeline.packed(spark, docs, "")
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids_crc32", "doc_tokens"} <= set(out.columns)
    none = made(spark, text_rows()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name


def test_run(spark):
    """All stages together on the smallest tables: pieces without gaps, and a rerun agrees."""
    key = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    one = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    a, b = (sorted(map(tuple, x.select(key).collect()), key=repr) for x in (one, corpus_pipeline.run(spark, "/root/testdata/sf0.001")))
    assert a and a == b
    spans = {}
    for r in one.collect():
        assert 0 < r.length and r.offset + r.length <= 4096
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in spans.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
