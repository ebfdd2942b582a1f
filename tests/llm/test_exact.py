"""Operators against brute force and the libraries, on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketlake.llm import embedding_dedup, html_text, kernels, line_dedup, minhash, mixing, ngram_join, paragraph_dedup, piece_codec, quality_rules, queries, token_counts, warc
from docketlake.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "▁", "你", "😀", "<|endoftext|>", "</s>", "'s", "ABC", "ß", " ", "　", "12", "Σ", "\r", "\x0b", "\x85", "#", "$"]


def fuzz(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "▁", "  a", " " * 50, "a" * 3000, "\n"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", "", "."]) for _ in range(n))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def frame(spark, texts, parts=3):
    return docs_frame(spark, [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]).repartition(parts)


# ---- kernels ----------------------------------------------------------------


def test_words_and_windows():
    texts = fuzz(300)
    data, offsets = kernels.buffers(pa.array(texts))
    w = kernels.Words(data, offsets)
    assert w.counts.tolist() == [len(WORD.findall(t)) for t in texts]
    raw = data.tobytes()
    seen = {}
    for h, s, e in zip(w.hashes.tolist(), w.starts.tolist(), w.ends.tolist(), strict=True):
        assert seen.setdefault(h, raw[s:e]) == raw[s:e]
    hashes, rows = kernels.windows(w.hashes, w.first, 3, short_whole=True)
    n = np.bincount(rows, minlength=len(texts))
    assert n.tolist() == [max(len(x) - 2, 1 if x else 0) for x in map(WORD.findall, texts)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 450)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for link in links for x in link}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want if n not in got)


def test_tuned_bands():
    bands, rows = minhash.tune(0.8, 0.99, 7)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands <= 7
    rng = np.random.default_rng(0)
    hit = 0
    for _ in range(200):
        common, a, b = (kernels.mix(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (80, 10, 10))
        keys = minhash.band_keys(np.concatenate([common, a, common, b]), np.array([90, 90]), bands, rows)
        hit += (keys[0] == keys[1]).any()
    assert hit >= 190


# ---- 1 ----------------------------------------------------------------------


def reference_targets(sizes):
    """Shares by weight 5, 2, 1; what is over three times a source goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice([0, 1, 3, 7, 20, 50]))), "en", rng.choice(["a", "b", "b", "b", "b", "c", None]), 0) for i in range(600)] + [(9999, None, None, "z", None)]
    df = docs_frame(spark, rows)
    got = mixing.mix(df).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(5)).collect()}
    assert {(r["doc_id"], r["taken"]) for r in got} == again and len(got) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = reference_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1.0


def test_budget_is_exact():
    rng = random.Random(5)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 6)))
        counts = [rng.randint(1, 4) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts, strict=True))
        target = rng.randint(0, 3 * total)
        whole, extra = mixing.fit_budget(np.array(sizes), np.array(counts), target)
        got = whole * total + int((extra * np.array(sizes)).sum())
        assert got <= target and all(0 <= k <= c for k, c in zip(extra, counts, strict=True)) and whole + (extra.max() > 0) <= 3
    sums = {0}
    for s, c in ((7, 3), (11, 2), (30, 5)):
        sums = {x + k * s for x in sums for k in range(c + 1)}
    for budget in range(1, 150):
        assert sum((7, 11, 30)[i] * k for i, k in mixing._knapsack([7, 11, 30], [3, 2, 5], budget)) == max(x for x in sums if x <= budget)


# ---- 2 and 10 ---------------------------------------------------------------


def test_paragraphs(spark):
    rng = random.Random(6)
    shared, other = prose(rng, 60).capitalize(), prose(rng, 40)
    near = shared.split()
    near[30] = "changed"
    texts = [prose(rng, 80) + ". " + shared + ". " + prose(rng, 30), "x " + prose(rng, 50) + ". " + shared + ". tail", other + "\n" + prose(rng, 30), prose(rng, 40), other, shared + "\n" + prose(rng, 9), " ".join(near), "", None]
    got = {r["doc_id"]: r for r in paragraph_dedup.repeated_spans(frame(spark, texts)).collect()}
    assert {1, 4} <= set(got) and not {2, 3, 7, 8} & set(got)
    words = WORD.findall(texts[1])
    for r in got.values():
        for span in r["spans"]:
            assert 0 <= span["first"] < span["until"] <= len(WORD.findall(texts[r["doc_id"]]))
    cut = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert cut[4].strip() == "" and cut[3] == texts[3] and cut[8] is None and len(WORD.findall(cut[1])) < len(words) - 20


def test_lines(spark):
    rng = random.Random(7)
    base = [prose(rng, 30) for _ in range(12)]
    edited = [b[:20] + "x" + b[21:] for b in base]
    texts = ["\n".join(rng.sample(base + edited, 5) + [rng.choice(["", "  ", "short", "hi"]), prose(rng, 12)]) for _ in range(40)] + [None, "", "\n\n", "hi"]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    first = {}
    for i, t in enumerate(texts):
        for j, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line, (i, j))
    sets = {line: {line[k : k + 10] for k in range(max(1, len(line) - 9))} for line in first}
    lines = list(first)
    links = [(first[a], first[b]) for x, a in enumerate(lines) for b in lines[x + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = components(first.values(), links)
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(line for j, line in enumerate(t.split("\n")) if not WORD.search(line) or label[first[line]] == (i, j))
        assert got[i]["text"] == want


# ---- 3 ----------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 300)] + 0.12 * rng.standard_normal((300, 16)), rng.standard_normal((200, 16))])
    rows = [(i, [float(v) for v in np.float32(v)], int(i % 3)) for i, v in enumerate(x)] + [(500, [float(v) for v in np.float32(x[0])], 0), (501, None, 0), (502, [0.0] * 16, 0), (503, [float("nan")] + [1.0] * 15, 0), (504, [1.0] * 16, None), (505, [1.0] * 8, 0), (506, [], 1), (507, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df).collect()}
    usable = {i: (np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if i <= 500}
    links = [(a, b) for a in usable for b in usable if a < b and usable[a][1] == usable[b][1] and usable[a][0] @ usable[b][0] >= 0.93]
    n = collections.Counter(x for link in links for x in link)
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and all(got[i]["n_links"] <= n[i] for i in got) and found >= 0.95 * 2 * len(links) > 0
    if found == 2 * len(links):
        assert {i: r["component_id"] for i, r in got.items()} == components(got, links)
    for i in (501, 502, 503, 504, 505, 506, 507):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_multi_sequence_order():
    rng = np.random.default_rng(9)
    grid = embedding_dedup.Grid(rng.standard_normal((7, 3)), rng.standard_normal((9, 3)))
    x = rng.standard_normal((20, 6))
    d1, d2 = grid.halves(x)
    for n in (1, 5, 20, 63):
        sums = np.sort((d1[:, :, None] + d2[:, None, :]).reshape(20, -1), axis=1)[:, :n]
        cells = grid.cells(x, n)
        got = np.take_along_axis((d1[:, :, None] + d2[:, None, :]).reshape(20, -1), cells, 1)
        assert np.allclose(got, sums)


# ---- 4 ----------------------------------------------------------------------

PAGES = [
    ("<p>One<p>Two <b>bold</b>", "One\n\nTwo bold"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol></ul>", "- a\n- b\n  1. x\n  2. y"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<head><title>t</title><style>x</style></head><body>shown<script>no()</script></body>", "shown"),
    ('<p>a<span hidden>b</span><span style="display: none">c</span><!-- d -->e', "ae"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("a &amp; b &lt;c&gt; &nbsp;", "a & b <c>"),
    ("one<br>two", "one\ntwo"),
    ("", ""),
    ("just < text & more", "just < text & more"),
    ("<p>unclosed <b>tag", "unclosed tag"),
    ("</p></div>x", "x"),
    ("<ol start=3><li>c<li value=9>i</ol>", "3. c\n9. i"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_render(page, want):
    assert html_text.render(page) == want


def test_render_keeps_all_visible_words():
    rng = random.Random(10)
    tags = ["p", "div", "li", "ul", "table", "tr", "td", "b", "span", "blockquote", "h1", "ol"]
    for _ in range(200):
        words, parts = [], []
        for i in range(rng.randrange(30)):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"</{t}>", f" w{i} ", f" w{i} ", "<script>no</script>", "<i hidden>no</i>"]))
            if parts[-1].startswith(" "):
                words.append(f"w{i}")
        out = html_text.render("".join(parts))
        assert sorted(re.findall(r"w\d+", out)) == sorted(words) and "no" not in out
    assert html_text.render("<div>" * 5000 + "deep") == "deep"


# ---- 5 ----------------------------------------------------------------------


@pytest.mark.parametrize(("size", "threshold"), [(3, (9, 10)), (5, (4, 5))])
def test_ngram_join(spark, size, threshold):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.choice([2, 8, 60, 150])).split()
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper())
    texts += [None, "", "  ", "one", "ONE", "two words"]
    got = {r["doc_id"]: r for r in ngram_join.ngram_components(frame(spark, texts), size, threshold).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    p, q = threshold
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(sets, links)


# ---- 6 ----------------------------------------------------------------------


def test_warc(spark):
    rng = random.Random(12)
    body = prose(rng, 60)
    rows = [(i, f"http://h/{i}?q=é\r\n", rng.choice([body, "short", None, prose(rng, 50)])) for i in range(60)] + [(None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    for i, _, h in rows:
        raw = (h or "").encode()
        ref = first.get(h) if first.get(h) not in (None, i) and i is not None else None
        assert tuple(got[i]) == (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if ref is not None else "response", ref)
    assert warc.archive_round_trip(pages.filter("false")).count() == 0


def test_warc_archives_are_checked():
    zstandard = pytest.importorskip("zstandard")
    record = warc.build_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None)
    words = " ".join(f"record{i} payload" for i in range(300)).encode()
    dictionary = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame_ = zstandard.ZstdCompressor(dict_data=dictionary).compress(record)
    for stored in (words, zstandard.ZstdCompressor().compress(words)):
        raw, _ = warc.load_dictionary(warc.dictionary_frame(stored))
        assert raw == words
    plain = zstandard.ZstdCompressor().compress(record)
    assert [b for _, b in warc.read_records(plain + plain)] == [b"payload"] * 2
    assert frame_
    for broken in (plain[:-3], zstandard.ZstdCompressor().compress(record[:-1]), zstandard.ZstdCompressor().compress(record.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n")), zstandard.ZstdCompressor().compress(b"nonsense")):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_records(broken))


# ---- 7, 8 and 9 -------------------------------------------------------------


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    texts = [*fuzz(1500), None]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts), path, limit=20).collect()}
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, t in enumerate(texts):
        assert tuple(got[i]) == (i, len((t or "").encode()), len(want[i]), len(want[i]) > 20)


def test_pieces(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    sp = piece_codec.codec(path).library
    texts = [*fuzz(1500, 5), None]
    got = {r["doc_id"]: r for r in piece_codec.encode_documents(frame(spark, texts), path, with_output=True).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_eos=True)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == sp.decode(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    c = piece_codec.codec(path)
    assert c.decode(c.encode("whole  text\n")) == sp.decode(sp.encode("whole  text\n"))


def test_quality_metrics(spark):
    texts = [*fuzz(400, 6), None, "a b c d e a b c d e f g h i j k", "x y\nx y\nz", "one\ntwo\none\none\n\n"]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_hosts_are_shrunk(spark):
    rows = [("bad", i < 95) for i in range(100)] + [("good", i < 2) for i in range(100)] + [("tiny", True)] + [(f"h{k}", i < 3) for k in range(8) for i in range(50)]
    got = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert got["bad"]["suspect"] and not got["good"]["suspect"] and got["tiny"]["rate"] < 1
    clean = " ".join(f"clean{i}" for i in range(40))
    junk = "### $$$ %%% " * 1 + " ".join(f"w{i}#" for i in range(30))
    texts = [(i, junk + str(i), "en", "h", 0) for i in range(50)] + [(100, clean, "en", "h", 0), (101, clean + " x", "en", "g", 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs_frame(spark, texts)).collect()}
    assert kept[100] and kept[101] and not kept[0]


# ---- all of them ------------------------------------------------------------

ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30000, "en", "s", 150000), (4, "a b c d e f g h i j k l", "en", None, 23), (4, "a b c d e f g h i j k l", "en", None, 23), (None, "a b c d e f g h i j k l", "en", "s", 23), (5, "x" * 200000, "en", "s", 200000)]
CLASHES = ["size", "extra", "skey", "n", "kept", "suspect", "host", "m", "n_lines", "spans", "id", "node", "key"]
DOC_OPERATORS = {
    "mix": mixing.mix, "judge": quality_rules.judge, "lines": line_dedup.dedup_lines, "paragraphs": paragraph_dedup.remove_repeats, "ngrams": ngram_join.ngram_components,
    "tokens": lambda d: token_counts.token_counts(d, queries.vocabulary("word_bpe_49k.json")), "pieces": lambda d: piece_codec.encode_documents(d, queries.vocabulary("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_odd_rows(spark, name):
    odd = docs_frame(spark, ODD).select("*", *[F.lit(7).alias(c) for c in CLASHES])
    assert len(DOC_OPERATORS[name](odd).collect()) == len(ODD)
    assert DOC_OPERATORS[name](odd.filter("false")).collect() == []


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, "u", "<p>x"), (2, "u", "<b>" * 50000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r["text"] for r in html_text.extract_text(pages).collect()) == ["", "", "x", "x"]
    assert html_text.extract_text(pages.filter("false")).collect() == []
    assert warc.archive_round_trip(pages).count() == 4


def test_odd_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_links(empty).collect() == []
    only = spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["n_links"]) for r in embedding_dedup.embedding_links(only).collect()} == {(1, 0), (None, 0)}
    same = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(50)], "vec_id long, embedding array<float>, label int").withColumn("copies", F.lit(1))
    assert {(r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_links(same).collect()} == {(49, 0)}
