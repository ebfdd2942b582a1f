"""Texts that make polynomial hashes modulo powers of two collide, rows that repeat ids, and where tables may be kept."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from test_exact import WORD, components, docs_frame, frame, prose

from docketlake.llm import components as C
from docketlake.llm import html_text, kernels, line_dedup, ngram_join, paragraph_dedup, piece_codec, quality_rules, queries, storage, token_counts


def thue_morse(n, a, b):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_of_one_polynomial_hash(spark):
    from tokenizers import Tokenizer

    texts = [t for n in (1024, 2048) for t in thue_morse(n, "t", "h")] + [" ".join(thue_morse(2048, "t", "h"))]
    path = queries.vocabulary("word_bpe_49k.json")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(frame(spark, texts, 1), path).collect()}
    assert got == dict(enumerate(len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in texts))
    path = queries.vocabulary("piece_bpe_32k.model")
    sp = piece_codec.codec(path).library
    ids = {r["doc_id"]: r["ids"] for r in piece_codec.encode_documents(frame(spark, texts, 1), path, with_output=True).collect()}
    assert ids == {i: sp.encode(t, add_eos=True) for i, t in enumerate(texts)}


def test_lines_and_paragraphs_of_one_polynomial_hash(spark):
    lines = [x + y for n in (1024, 2048) for x, y in zip(thue_morse(n, "xy z ", "ab c "), ("1", "2"), strict=True)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, ["\n".join(lines), lines[0], lines[3]])).collect()}
    sets = [{line[k : k + 5] for k in range(len(line) - 4)} for line in lines]
    label = components(range(4), [(i, j) for i in range(4) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    assert got[0] == "\n".join(line for i, line in enumerate(lines) if label[i] == i) and got[1] == got[2] == ""
    data, offsets = kernels.buffers(pa.array([t for n in (1024, 2048) for t in thue_morse(n, "left ", "right ")]))
    units = paragraph_dedup.Units(data, offsets)
    k1, k2 = units.keys(units.words.first[:-1], units.words.first[1:])
    assert len(set(k1.tolist())) == len(set(k2.tolist())) == 4
    assert len(set(kernels.runs_hashed(data, offsets[:-1], offsets[1:]).tolist())) == 4


def test_colliding_runs_are_told_apart(monkeypatch):
    data, offsets = kernels.buffers(pa.array(["one", "two", "one", "three"]))
    monkeypatch.setattr(kernels, "runs_hashed", lambda data, starts, ends: starts.astype("uint64") * 0)
    at, inverse = kernels.distinct_runs(data, offsets[:-1], offsets[1:])
    assert inverse.tolist() == [0, 1, 0, 2] and at.tolist() == [0, 1, 3]


def test_repeated_ids(spark):
    base = prose(random.Random(3), 60)
    rows = [(1, base, "en", "s", 0), (1, "other words " * 3 + "\nx y", "en", "s", 0), (2, base + " end", "en", "s", 0), (None, base, "en", "s", 0), (3, None, "en", None, None)]
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.ngram_components(docs_frame(spark, rows)).collect()))
    assert got == [(0, 56, 1), (1, 4, 1), (1, 56, 1), (2, 57, 1), (3, 0, 3)]
    lines = sorted((r["doc_id"] or 0, r["text"] or "") for r in line_dedup.dedup_lines(docs_frame(spark, rows)).collect())
    assert lines == sorted([(1, base), (1, rows[1][1]), (2, ""), (0, base), (3, "")])
    cut = sorted((r["doc_id"] or 0, len(WORD.findall(r["text"] or ""))) for r in paragraph_dedup.remove_repeats(docs_frame(spark, rows)).collect())
    assert cut == sorted([(1, 60), (1, 8), (2, 0), (0, 60), (3, 0)])


def test_empty_texts_have_no_metrics(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([None, "", "", None])]
    assert all((r["n_words"], r["n_dup_lines"], r["base_failed"], r["kept"]) == (0, 0, True, False) for r in quality_rules.judge(docs_frame(spark, rows)).collect())


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    passages = [prose(rng, rng.randint(51, 90)) for _ in range(12)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(20, 80))]
        if i % 2:
            parts += [rng.choice(passages), prose(rng, rng.randint(5, 40))]
        texts.append(" ".join(parts))
    got = {r["doc_id"]: r for r in paragraph_dedup.repeated_spans(frame(spark, texts)).collect()}
    words, first = [WORD.findall(t.lower()) for t in texts], {}
    repeated = [set() for _ in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 50):
            run = tuple(w[k : k + 51])
            if first.setdefault(run, i) != i:
                repeated[i].update(range(k, k + 51))
    found = [{x for s in got[i]["spans"] for x in range(s["first"], s["until"])} if i in got else set() for i in range(len(texts))]
    assert sum(map(len, repeated)) > 500
    assert sum(len(a & b) for a, b in zip(repeated, found, strict=True)) >= 0.9 * sum(map(len, repeated))
    assert all(not found[i] for i in range(0, 60, 2))


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "EDGES", 50)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(120)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r["node"]: r["component"] for r in C.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for link in links for x in link}, links)
    assert got == {n: want[n] for n in got} and all(want[n] == n for n in want if n not in got)


def test_clusters_need_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(Session())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<math><mi>x</mi><annotation>no</annotation></math><svg><path/><text>label</text><title>n</title></svg>", "xlabel"),
        ('<p class="a"">Hello "quoted</p>', 'Hello "quoted'),
        ("a<![CDATA[x]]>b <!-->c <!-- d --!> e </ foo> f < g <5", "ab c e f < g <5"),
        ("<table><tr><td>" + "w" * 120 + "<td>b<tr><td>c<td>d</table>", "w" * 120 + "  b\nc" + " " * 121 + "d"),
        ('<a "' * 50_000, ""),
    ],
)
def test_pages(page, want):
    assert html_text.render(page) == want
