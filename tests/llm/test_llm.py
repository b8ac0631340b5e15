"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from arraymill.llm import bpe, components, decontaminate, embeddings, html_text, licenses, secrets, simhash, substrings, token_files, toxicity
from arraymill.llm._elias_fano import View, pack
from arraymill.llm._pieces import piece_starts
from arraymill.llm._text import flat
from arraymill.llm._xxh64 import xxh64

FORM = "doc_id long, text string, id string, n long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n):
    return " ".join(rng.choice("the of and tion ing ent ver ba co du élan schön 7up no-one It's".split()) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeated rows and copies."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    shared = prose(rng, 30)
    out = [(k, t) for k, t in enumerate(base)]
    out += [(100 + k, base[k]) for k in range(10)]
    out += [(200 + k, f"{prose(rng, 5)} {shared} {prose(rng, 5)}") for k in range(8)]
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "word"), (304, "two words"), (305, prose(rng, 3000)), (306, "a" * 20000), (307, "x y " * 400), (0, base[0])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "clash", 7) for d, t in rows], FORM)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FORM)


@pytest.fixture(scope="module")
def enc():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_xxh64():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(rng.randrange(100))) for _ in range(300)]
    ends = np.cumsum([len(p) for p in parts])
    got = xxh64(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def fingerprint(text):
    w = BLANK.findall(lowered(text))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def grouped(nodes, linked):
    up = list(range(len(nodes)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, n in enumerate(nodes):
        least[root(i)] = min(n, least.get(root(i), n))
    return [least[root(i)] for i in range(len(nodes))]


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_simhash(docs, rows, parts):
    fps = [fingerprint(t) for _, t in rows]
    want = grouped([d for d, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = sorted(map(tuple, simhash.near_duplicates(docs, parts=parts).collect()))
    assert got == sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want))


def test_simhash_near_copies(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    fps = np.unique([c ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 6))) for c in centre for _ in range(60)])
    df = spark.createDataFrame([(k, int(f)) for k, f in enumerate(fps)], "id long, fp long")
    got = {tuple(sorted(r)) for r in simhash.links(df).collect()}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}


def test_simhash_edges(spark, none):
    assert simhash.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, simhash.near_duplicates(odd).select("doc_id", "component_id").collect())) == sorted(["Row(doc_id=None, component_id=7)", "Row(doc_id=7, component_id=7)", "Row(doc_id=None, component_id=None)"])


def test_one_of_each(docs, rows):
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) and not {100 + k for k in range(10)} & set(kept) and set(range(40)) <= set(kept)


def test_one_of_each_judges_rows_by_their_texts(spark):
    """Rows that share an id or have none; no text is lost, and no copy stays for want of an id."""
    rng = random.Random(21)
    a, b, c, d, e, f, g = (" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7))
    near = lambda t: t + " more"
    rows = [(1, a), (5, near(a)), (5, b), (7, b), (None, near(a)), (None, c), (None, c), (8, d), (8, d), (8, near(d)), (9, e), (9, f), (None, near(f)), (None, g), (None, ""), (None, None), (None, None), (2, ""), (3, None)]
    want = [(1, a), (2, ""), (5, b), (9, e), (9, f), (None, c), (None, g), (None, ""), (None, None), (None, None)]
    df = spark.createDataFrame([(k, t, "clash", n) for n, (k, t) in enumerate(rows)], FORM).repartition(3)
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    of_8 = [t for k, t in got if k == 8]
    assert len(of_8) == 1 and of_8[0] in (d, near(d))
    assert [x for x in got if x[0] != 8] == sorted(want, key=str)
    texts = df.where("doc_id is null or doc_id <> 8").selectExpr("concat('k', doc_id) as doc_id", "text")  # ids that are no numbers
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(texts).collect()), key=str)
    assert got == sorted([(k and f"k{k}", t) for k, t in want], key=str)


def test_one_of_each_by_overlap(spark):
    """All pairs with a Jaccard similarity of 0.8 or more of five words, and no others, against brute force."""
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(rng.choice([3, 30, 200, 400]))]
        texts.append(" ".join(w))
        for changed in (1, 3, 6, 9):
            v = list(w)
            for k in rng.sample(range(len(v)), min(changed, len(v))):
                v[k] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    texts += ["same line here again now " * 30 + f"tail{k}" for k in range(4)]
    s = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (BLANK.findall(lowered(t)) for t in texts)]
    near = lambda i, j: len(s[i] & s[j]) * 5 >= 4 * len(s[i] | s[j])
    far = [(fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 3 for i in range(len(s)) for j in range(i) if near(i, j)]
    assert sum(far) > 10
    want = {c for c in grouped(list(range(len(s))), near)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(d).collect()} == want


def test_thresholds_cover():
    for parts in (2, 3, 4):
        assert sum(simhash.allocate([[0, 1, 5, 9, 20]] * parts, 3 - parts + 1)) == 3 - parts + 1


def test_components(spark):
    path = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[k] == 1000 for k in range(1001, 1100))


def test_toxicity(spark):
    rng = random.Random(2)
    mean = "blorft grumskin vextle".split()
    made = []
    for k in range(900):
        bad = k % 3 == 0
        s = [prose(rng, 9) for _ in range(5)]
        if bad:
            s[rng.randrange(5)] += f" {rng.choice(mean)}{rng.choice(['', 'en', 'ous'])} yes"
        made.append((k, ". ".join(s), int(bad)))
    d = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.drop("toxic"), d.select("doc_id", "toxic").where(~toxicity.held_out()))
    out = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    held = [k for k, _, _ in made if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(out[k]["score"] >= 0.5) == bool(made[k][2]) for k in held]) > 0.97
    found = [o for k in held for o in out[k]["offending"]]
    assert found and np.mean([any(m in o["text"] for m in mean) for o in found]) > 0.95
    edges = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string"), model).collect()
    assert len(edges) == 3 and all(0 <= r["score"] <= 1 for r in edges)
    clean = toxicity.without_toxic(d, model)
    assert clean.columns == d.columns and clean.count() == sum(out[k]["score"] < 0.5 for k in out)
    assert toxicity.score(d.limit(5), toxicity.fit(d.limit(0).drop("toxic"), d.select("doc_id", "toxic").limit(0))).where("score > 1e-9").count() == 0


def test_toxicity_scores(spark, docs, none):
    """Scores against a noisy-or over sentences written out; the model may be any."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(np.where(rng.random(1 << toxicity.BITS) < 0.3, rng.normal(size=1 << toxicity.BITS) * 2, 0), -3.0)
    extra = [(700, "One. Two! three? four\nfive.. six"), (701, "x" * 30000 + ". y"), (None, "a.b")]
    d = docs.union(spark.createDataFrame([(k, t, "", 0) for k, t in extra], FORM))

    def weight(word):
        raw = np.frombuffer(lowered(word).encode(), np.uint8)
        own = toxicity._buckets(raw, np.array([0]), np.array([len(raw)]))[0]
        assert len(own) == 1 + max(0, len(raw) - toxicity.GRAM + 1)
        return model.weights[own].sum()

    def brute(t):
        z = []
        for s in re.split(r"[.!?\n]", t or ""):
            w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", s)
            if w:
                z.append(model.bias + sum(map(weight, w)))
        return 1 - np.prod([1 / (1 + np.exp(np.clip(x, -60, 60))) for x in z or [model.bias]])

    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(d, model).collect())
    want = sorted((str(r["doc_id"]), brute(r["text"])) for r in d.collect())
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)
    assert toxicity.score(none, model).count() == 0 and toxicity.without_toxic(none, model).count() == 0


def test_toxicity_sample_is_bounded(spark):
    d = spark.createDataFrame([(k, f"word{k % 7} " * 50, k % 2) for k in range(400)], "doc_id long, text string, toxic int")
    seen = []
    train, toxicity._train = toxicity._train, lambda w, *a: seen.append(sum(map(len, w))) or toxicity.Model(np.zeros(1 << toxicity.BITS), -60.0)
    try:
        for most in (1 << 30, 30_000):
            toxicity.fit(d.drop("toxic"), d.select("doc_id", "toxic"), max_bytes=most)
    finally:
        toxicity._train = train
    assert 0 < seen[1] < seen[0] / 3


def test_licenses(spark, docs, none):
    texts = ["CC BY cc by CC-BY 4.0", None, "", "All rights  reserved. all Rights reserved", "cc\xa0by", "Licensed under the Apache License, Version 2.0.", "released under the MIT License", "GNU General Public License, version 3 general public license", "Kelvin cc by"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def base(t):
        w = ALNUM.findall(lowered(t))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    got = {r["doc_id"]: r for r in licenses.report(licenses.scan(d)).collect()}
    assert all(tuple(got[k])[1:6] == base(t) for k, t in enumerate(texts))
    assert got[5]["labels"] == "apache-2.0" and got[6]["labels"] == "mit" and "gpl" in got[7]["labels"]
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == docs.count()


def test_licenses_at_random(spark):
    """Texts made of the words of the templates, against brute force, and 300 whole licences as templates."""
    rng = random.Random(31)
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()})
    texts = [" ".join(rng.choice(vocabulary) if rng.random() < 0.5 else rng.choice([t for _, t, _ in licenses.TEMPLATES] + list(licenses.PHRASES)) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    for k in range(0, 150, 3):  # some words of a template changed
        w = rng.choice(licenses.TEMPLATES)[1].split()
        texts[k] += " " + " ".join(rng.choice(vocabulary) if rng.random() < 0.2 else x for x in w)
    body = [" ".join(f"{rng.choice('bcdfg')}{rng.randrange(3000)}" for _ in range(200)) for _ in range(300)]
    whole = tuple((f"licence{k}", b, ((0, 6), (150, 5))) for k, b in enumerate(body))
    texts += [f"see {body[7]} and {body[200]}.", body[9].replace(" ", "\n", 50).upper(), " ".join(body[11].split()[:199]), "word " * 60_000 + body[5], None, ""]
    texts += texts[:2]

    def brute(t, templates):
        w, out = ALNUM.findall(lowered(t)), []
        for label, text, keys in templates:
            x = text.split()
            for k in range(len(w) - len(x) + 1):
                if all(w[k + a : k + a + n] == x[a : a + n] for a, n in keys) and sum(p == q for p, q in zip(w[k:], x)) >= np.ceil(licenses.AGREE * len(x) - 1e-9):
                    out.append((label, k))
        return sorted(out)

    d = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words string, places int")
    for templates in (licenses.TEMPLATES, whole):
        got = {r["doc_id"]: sorted((m["label"], m["first"]) for m in r["matches"] or []) for r in licenses.scan(d, templates=templates).collect()}
        assert got == {k: brute(t, templates) for k, t in enumerate(texts)} and any(got.values())


def test_license_report_of_edges(spark, none):
    d = spark.createDataFrame([(None, None), (1, ""), (1, "cc by"), (1, "cc by")], "doc_id long, text string")
    got = sorted(map(str, licenses.report(licenses.scan(d)).select("doc_id", "n_base", "first_word", "labels", "score").collect()))
    assert len(got) == 4 and got[1] == got[2] == "Row(doc_id=1, n_base=1, first_word=0, labels='cc-by', score=0.5)" and got[3] == "Row(doc_id=None, n_base=0, first_word=None, labels='', score=0.0)"
    assert licenses.report(licenses.scan(none)).count() == 0


def test_pieces_at_random(enc):
    rng = random.Random(9)
    alphabet = ["a", "s", "re", "ll", "'", "'s", " ", "  ", "\n", "1", "23", "!", "é", " ", "　", "日本", "😀", "́", "\x85", "S", "<|endoftext|>", "Ⅷ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    data, offs = flat(pa.array(texts))
    import regex

    want, at = [], 0
    for t in texts:
        want += [at + len(t[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, t)]
        at += len(t.encode())
    assert piece_starts(data, offs).tolist() == want


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 12), (500, 64), (64, 8)])
def test_bpe(spark, docs, rows, none, enc, chunk, overlap):
    more = [(400, "don't  stop " * 90), (401, " " * 900 + "é" * 300), (402, "日本語 テキスト\n\n\n a" * 60), (403, "ab՘c " * 80), (None, "it's ours " * 70)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    coded = bpe.encode(d, chunk=chunk, overlap=overlap)
    got = sorted((str(r["doc_id"]), r["ids"]) for r in coded.collect())
    assert got == sorted((str(k), enc.encode_ordinary(t or "")) for k, t in [*rows, *more])
    back = sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in bpe.decode(coded).collect())
    assert back == sorted((str(k), (t or "").encode()) for k, t in [*rows, *more])
    one = {r["doc_id"]: r for r in bpe.digests(coded).collect()}[303]
    ids = enc.encode_ordinary("word")
    assert one["n_tokens"] == len(ids) and one["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    once = sorted(map(str, bpe.encoded_digests(d, chunk=chunk, overlap=overlap).collect()))
    assert once == sorted(map(str, bpe.digests(coded).collect()))
    assert bpe.encode(none).count() == 0 and bpe.encoded_digests(none).count() == 0


def test_elias_fano():
    rng = random.Random(4)
    for values in ([], [0], [5, 5, 5], sorted(rng.randrange(10**6) for _ in range(3000)), list(range(700)), [2**40]):
        v = View(pack(np.array(values, dtype=np.int64)))
        assert v.all().tolist() == values and [v.select(k) for k in range(0, len(values), 7)] == values[::7]
    assert len(pack(np.arange(100_000) * 500)) < 100_000 * 12 / 8


def test_token_files(spark, docs, rows, none, enc, tmp_path):
    """Against the tokenizers library, a special token's string in a text included."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [(500, "one<|endoftext|>two"), (501, "<|endoftext|"), (502, "日本語 é\u0301 " * 40), (503, " \n\n  x\t")]
    rows = [*rows, *more]
    docs = docs.union(spark.createDataFrame([(d, t, "", 0) for d, t in more], FORM))
    token_files.write(docs, str(tmp_path / "t"), block_ids=500)
    got = token_files.checksums(token_files.read(spark, str(tmp_path / "t"))).orderBy("start").collect()
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.document(spark, str(tmp_path / "t"), 303) == [*enc.encode_ordinary("word"), 0]
    token_files.write(none, str(tmp_path / "e"))
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_html():
    r = html_text.render
    assert r("<p>a <b>b</b>c<p>d<br>e") == "a bc\n\nd\ne"
    assert r("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z") == "- x\n- y\n  1. 1\n  2. 2\n\nz"
    assert r("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>z") == "a   bbb\ncc  d\n\nz"
    assert r("a<div hidden>no</div><p style='display: none'>no<script>if(a<b)</script><style>x</style>") == "a"
    assert r("<pre> x\n\n y</pre>t") == " x\n\n y\n\nt"
    assert r("<head><title>t</title></head><body>a&amp;b") == "a&b"
    assert r(None) is None and r("") == "" and r("<!-- x") == "" and r("a<b") == "a"
    assert len(r("<div>" * 5000 + "x")) == 1


def test_html_stray_quotes():
    """Quotes open a string only right after =."""
    r = html_text.render
    assert r("<p title=Bob's>Hello <b>you</b></p><p>it's") == "Hello you\n\nit's"
    assert r("a<img alt='it's'>b<i x\">c</i>") == "abc"
    assert r("<a href=x\"y>z</a><a title = 'p>q'>w</a><a ='>v</a>") == "zwv"
    assert r("<p title='never ended>x") == "" and r("<a href=y/ title=\"a>b\"/>t") == "t"
    assert r("<div style=display:none>no</div><div x=' style='display:none'>yes") == "yes"


def test_html_foreign_and_visibility():
    """Formulas, svg labels, options and visible children of hidden elements."""
    r = html_text.render
    assert r("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> b") == "a x=1/2 b"
    assert r("a<svg><title>no</title><defs><text>no</text></defs><path d='M0'/>no<text x=1>one</text><text>two<tspan>s</tspan></text></svg>b") == "a\none\ntwos\nb"
    assert r("<svg><circle/><p>out</p>") == "out" and r("<svg><foreignObject><div>in</div></foreignObject></svg>z") == "in\nz"
    assert r("<select><option>red<option selected>blue<optgroup label=more><option label=pink>x</select>z").split() == ["red", "blue", "more", "pink", "z"]
    assert r("<div style='visibility: hidden'>no<b style='visibility:visible'>yes</b>no<div>no</div></div>") == "yes"
    assert r("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x") == "x"


def test_html_tables_and_pre():
    r = html_text.render
    assert r("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert r("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "a  b   c\nd      e\nf      g"
    assert r("<pre>\nx\n\n y</pre>") == "x\n\n y" and r("a<pre>\n\nx</pre>") == "a\n\n\nx"
    assert r("<pre><b>a</b>\nb</pre>") == "a\nb" and r("<p style='display:\n none'>no</p>a") == "a"
    assert r("<table><tr>" + "<td>x" * 3000 + "</table>").count("x") == 3000


def test_html_at_random():
    """Pages of plain blocks and inline elements, against the words put in: those outside hidden elements, in order, and a line for each block."""
    rng = random.Random(13)
    for _ in range(200):
        page, want = [], []
        for k in range(rng.randint(1, 12)):
            w, tag, hide = [f"w{k}x{i}" for i in range(rng.randint(1, 5))], rng.choice(["p", "div", "h2", "section"]), rng.random() < 0.3
            inline = [f"<{t}>{x}</{t}>" if t else x for x, t in zip(w, rng.choices(["b", "i", "span", "a", ""], k=5))]
            page.append(f"<{tag}{' hidden' if hide else ''}>{rng.choice([' ', chr(10), '  '])}{' '.join(inline)}{rng.choice(['', ' '])}" + ("" if tag == "p" and rng.random() < 0.5 else f"</{tag}>"))
            want += [] if hide else [" ".join(w)]
        assert [x for x in html_text.render("".join(page)).split("\n") if x] == want


def test_html_edges(spark, none):
    d = spark.createDataFrame([(1, "u", "<p>" + "long text " * 200_000, "clash"), (2, "u", "", "clash")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(d).collect()}
    assert len(got[1]) == 200_000 * 10 - 1 and got[2] == ""
    assert html_text.extract(d.limit(0)).count() == 0


def test_html_columns(spark):
    d = spark.createDataFrame([(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(map(str, html_text.extract(d).collect())) == sorted(["Row(page_id=1, url='u', text='x')"] * 2 + ["Row(page_id=None, url=None, text=None)"])


@pytest.mark.parametrize(("kind", "band"), [("double", 48 << 20), ("double", 2000), ("float", 2000)])
def test_embeddings(spark, kind, band):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    v = [(base[k % 20] + rng.normal(size=16) * 0.25).tolist() for k in range(150)] + [[0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, None, [], (base[0] * 3).tolist(), (base[0] * 3).tolist()]
    if kind == "float":
        v = [x and [y if y is None else float(np.float32(y)) for y in x] for x in v]
    ok = [x is not None and len(x) > 0 and all(y is not None and np.isfinite(y) for y in x) and any(x) for x in v]
    unit = [np.array(x) / np.linalg.norm(x) if good else None for x, good in zip(v, ok)]
    linked = lambda i, j: i != j and ok[i] and ok[j] and float(unit[i] @ unit[j]) >= 0.9
    group = grouped(list(range(len(v))), linked)
    want = [(i, sum(linked(i, j) for j in range(len(v))), group[i], group[i] == i) for i in range(len(v))]
    d = spark.createDataFrame([(k, x, "clash", 1, b"") for k, x in enumerate(v)], f"vec_id long, embedding array<{kind}>, id string, copies int, vec binary")
    got = embeddings.near_duplicates(d, band_bytes=band)
    assert sorted(map(tuple, got.collect())) == want


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def without_repeats(rows):
    """Brute force: a window goes if it also starts in a row with a smaller id."""
    words, first = [BLANK.findall(t or "") for _, t in rows], {}
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - 12 if d is not None else 0):
            first[tuple(w[k : k + 13])] = min(d, first.get(tuple(w[k : k + 13]), d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {k + i for k in range(len(w) - 12 if d is not None else 0) if first[tuple(w[k : k + 13])] < d for i in range(13)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_substrings(docs, rows, none):
    want = without_repeats(rows)
    got = sorted(map(tuple, substrings.without_repeats(docs).collect()), key=str)
    assert got == want and any(r[2] for r in got)
    assert substrings.without_repeats(none).count() == 0


def test_substrings_of_short_rows(spark):
    """Batches without one anchor: a single short row, and a partition of short rows only."""
    for some in ([(1, "short text")], [(k, "a b c") for k in range(50)] + [(60, None), (None, "x")]):
        d = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, substrings.without_repeats(d).collect()), key=str) == without_repeats(some)


def test_substrings_of_rows_that_share_an_id(spark):
    rng = random.Random(21)
    w = prose(rng, 40)
    some = [(0, w), (1, "zz " + w), (1, prose(rng, 20)), (1, prose(rng, 60) + " " + w), (2, prose(rng, 30)), (2, w), (2, w), (None, w), (3, prose(rng, 30) + " " + w + " end")]
    got = substrings.without_repeats(spark.createDataFrame(some, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == without_repeats(some)


def test_a_long_text_beside_short_ones(spark):
    """Texts of 1 MB and more in one partition; batches are bounded by bytes and the caller's session is left alone."""
    rng = random.Random(22)
    long = prose(rng, 200_000)
    some = [(k, f"{long[k * 1000 : k * 1000 + 1_000_000]} {k}") for k in range(4)] + [(9, "short")]
    d = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
    before = dict(spark.conf.getAll)
    from arraymill.llm._store import bounded

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert max(r["n"] for r in bounded(d).mapInArrow(rows, "n long").collect()) < 6 << 20
    assert sorted(map(tuple, substrings.without_repeats(d).collect()), key=str) == without_repeats(some)
    assert dict(spark.conf.getAll) == before


def test_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("size", [1 << 24, 0])
def test_decontamination(spark, docs, rows, none, size):
    rng = random.Random(8)
    items = [(1, rows[3][1]), (2, rows[200 - 150][1]), (3, "the of"), (4, None), (5, "--"), (6, "word"), (7, prose(rng, 40)), (3, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lowered(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for d, t in rows:
        w, hit, its = ALNUM.findall(lowered(t)), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    its |= got
        want.append((d, len(w), len(hit), sorted(its)))
    found = decontaminate.contamination(docs, bench, broadcast_bytes=size)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()) == sorted(want)
    assert decontaminate.contamination(none, bench, broadcast_bytes=size).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0), broadcast_bytes=size).where("n_hit > 0").count() == 0
    clean = decontaminate.uncontaminated(docs.dropDuplicates(), bench, broadcast_bytes=size)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _, n, _ in want if not n}


def test_secrets(spark, none):
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made, secret = [], {}
    for k in range(200):
        a, b = prose(rng, 20), prose(rng, 20)
        value = {0: f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}", 1: hexa(18), 2: hexa(40), 3: None}[k % 4]
        lead = {0: "", 1: "password=", 2: 'token = "', 3: f"commit {hexa(40)} of user.{k}@mail7.example.com"}[k % 4]
        made.append((k, f"{a} {lead}{value or ''}{chr(34) if k % 4 == 2 else ''} {b}"))
        secret[k] = value
    d = spark.createDataFrame([*made, (900, None), (901, ""), (None, "x" * 5000)], "doc_id long, text string")
    corpus = secrets.corpus_counts(d)
    forest = secrets.train(corpus)
    text = dict(made)
    found = {r["doc_id"]: [text[r["doc_id"]].encode()[f["first"] : f["past"]].decode() for f in r["findings"]] for r in secrets.findings(d, corpus, forest).collect() if r["doc_id"] in text}
    assert np.mean([v in found[k] for k, v in secret.items() if v]) > 0.97
    assert np.mean([len(found[k]) == 0 for k, v in secret.items() if v is None]) > 0.9
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(d, corpus, forest).collect()}
    assert out[900] is None and out[901] == "" and secret[1] not in out[1] and "[secret]" in out[1]
    assert secrets.findings(none, secrets.corpus_counts(none), forest).count() == 0


def test_short_secrets_behind_names(spark):
    """Values under 12 bytes and with punctuation go whole; plain words behind the same names stay."""
    rng = random.Random(16)
    lines = ["password=hunter2", "pwd: Passw0rd99", "DB_PASSWORD='xK9#mQ2$'", "apiKey: \"a8Fk20xQz1\"", "password = P@ss!w0rd#2024", "client_secret=q7Wn3Zp9", '{"token":"t0k3n-9Xz"}', "password=Tr0ub4dor&3", "access_token=b7!kP~29xQ"]
    values = ["hunter2", "Passw0rd99", "xK9#mQ2$", "a8Fk20xQz1", "P@ss!w0rd#2024", "q7Wn3Zp9", "t0k3n-9Xz", "Tr0ub4dor&3", "b7!kP~29xQ"]
    plain = ["the password: required", "login: the", "session = morning", "key: get_key()", "token: true", "access=public"]
    d = spark.createDataFrame([(k, f"{prose(rng, 20)} {x} {prose(rng, 20)}") for k, x in enumerate([*lines, *plain])], "doc_id long, text string")
    corpus = secrets.corpus_counts(d)
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(d, corpus, secrets.train(corpus)).collect()}
    assert [v for k, v in enumerate(values) if v in out[k] or "[secret]" not in out[k]] == []
    assert [x for k, x in enumerate(plain, len(lines)) if x not in out[k]] == []


def test_secrets_recall(spark):
    """Of secrets of many shapes at least nine in ten are found whole, key blocks among them; certificates and plain words stay."""
    rng = random.Random(26)
    some = lambda n, c="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(c) for _ in range(n))
    armour = lambda name: f"-----BEGIN {name}-----\n" + "".join(some(64) + "\n" for _ in range(6)) + f"{some(20)}==\n-----END {name}-----"
    shapes = [
        lambda: ("export AWS_SECRET_ACCESS_KEY=", some(40)),
        lambda: ("", "AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")),
        lambda: ("password: ", some(9)),
        lambda: ("db_password = '", some(6) + "!" + some(3)),
        lambda: ("Authorization token=", "ghp_" + some(36)),
        lambda: ("", armour("RSA PRIVATE KEY")),
        lambda: ("key file ", armour("OPENSSH PRIVATE KEY")),
    ]
    made, value, clean = [], {}, set()
    for k in range(210):
        lead, v = shapes[k % 7]()
        value[k] = v
        made.append((k, f"{prose(rng, 15)} {lead}{v}{chr(39) if lead.endswith(chr(39)) else ''} {prose(rng, 15)}", "src/app.py", 1))
    for k in range(300, 340):
        clean.add(k)
        made.append((k, f"{prose(rng, 15)} {armour(rng.choice(['CERTIFICATE', 'PUBLIC KEY'])) if k % 2 else 'the password: required'} {prose(rng, 15)}", "README.md", 1))
    d = spark.createDataFrame(made + made[:3], "doc_id long, text string, source string, findings int")
    corpus = secrets.corpus_counts(d)
    text = {k: t for k, t, *_ in made}
    rows = secrets.findings(d, corpus, secrets.train(corpus)).collect()
    found = {r["doc_id"]: [text[r["doc_id"]].encode()[f["first"] : f["past"]].decode() for f in r["findings"]] for r in rows}
    by = [np.mean([any(value[k] in f for f in found[k]) for k in value if k % 7 == s]) for s in range(7)]
    assert len(rows) == len(made) + 3 and np.mean(by) >= 0.9 and min(by) >= 0.7, by
    assert np.mean([bool(found[k]) for k in clean]) <= 0.1


def test_a_long_run_is_quick_and_sampling_is_by_hash():
    import time

    corpus = secrets.Corpus(np.full((256, 256), -5.5), np.random.default_rng(1).random(1 << 16) < 0.1)
    raw = np.frombuffer(("AbC9" * 250_000).encode(), np.uint8)
    began = time.perf_counter()
    secrets._found(raw, np.array([0, len(raw)]), [""], corpus, secrets.train(corpus, secrets.made_findings(200)), 0.5)
    assert time.perf_counter() - began < 20
    rows = secrets.made_findings(600)
    a, b = (secrets.train(corpus, x, max_findings=100) for x in (rows, rows[::-1]))
    assert str(a.trees) == str(b.trees)


def test_covered():
    frequent = np.zeros(1 << 16, bool)
    for w in ("word", "wordy", "access"):
        raw = np.frombuffer(w.encode(), np.uint8)
        frequent[int(secrets.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] >> np.uint64(48))] = True
    corpus = secrets.Corpus(np.zeros((256, 256)), frequent)
    assert [secrets._covered(t, corpus) for t in (b"xxWORDYaccess1", b"wor1d", b"", b"9wordword")[:2]] == [11 / 14, 0.0] and secrets._covered(b"9wordword", corpus) == 8 / 9


def test_forest_beats_chance_on_held_out():
    corpus = secrets.Corpus(np.full((256, 256), -5.5), np.zeros(1 << 16, bool))
    rows = secrets.made_findings(1500, seed=1)
    forest = secrets.train(corpus, rows)
    other = secrets.made_findings(500, seed=2)
    x = np.array([secrets.features(c.encode(), b.encode(), a.encode(), p, corpus) for b, c, a, p, _ in other])
    assert np.mean((forest.predict(x) >= 0.5) == [r[4] for r in other]) > 0.9


def test_pipeline(spark, enc):
    """Each stage against brute force on what the one before kept; nulls, empties, repeats and odd ids among the documents."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = docs.orderBy("doc_id").first().asDict()
    odd = [(900001, None), (900002, ""), (900003, ""), (None, "lone words here"), (None, None), (first["doc_id"], first["text"]), (900004, first["text"]), (900005, "password=hunter2x9 is all"), (900006, "x " * 30000)]
    more = spark.createDataFrame([first | {"doc_id": d, "text": t, "n_chars": len(t or "")} for d, t in odd], docs.schema)
    now = docs.union(more)
    bench = {str(r["item_id"]): ALNUM.findall(lowered(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    windows = {tuple(w[k : k + min(10, len(w))]) for w in bench.values() if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(g) for g in windows}
    whole = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        before = whole(now)
        out = spark.createDataFrame(stage(spark, now, folder).collect(), None if name == "byte_bpe" else docs.schema)
        assert name == "byte_bpe" or out.columns == docs.columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out())
            score = toxicity.score(now, toxicity.fit(now, labels)).select("doc_id", "score").collect()
            assert sorted(str(d) for d, _ in whole(out)) == sorted(str(r["doc_id"]) for r in score if r["score"] < 0.5)
        elif name == "near_duplicates":
            known = sorted({d: t for d, t in before if d is not None}.items())
            s = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := BLANK.findall(lowered(t))) else frozenset() for _, t in known]
            group = grouped([d for d, _ in known], lambda i, j: s[i] == s[j] or (s[i] and s[j] and len(s[i] & s[j]) * 5 >= 4 * len(s[i] | s[j])))
            assert whole(out) == sorted([x for x in known if x[0] in set(group)] + [x for x in before if x[0] is None], key=str)
        elif name == "decontamination":
            hit = lambda t: any(tuple(w[k : k + n]) in windows for w in [ALNUM.findall(lowered(t))] for n in sizes for k in range(len(w) - n + 1))
            assert whole(out) == [x for x in before if not hit(x[1])] and len(whole(out)) < len(before)
        elif name == "secrets":
            corpus = secrets.corpus_counts(now)
            rows = now.select("doc_id", "text").collect()
            spans = {(r["doc_id"], r["n_candidates"]): r["findings"] for r in secrets.findings(now, corpus, secrets.train(corpus)).collect()}
            after = {d: t for d, t in whole(out)}
            assert len(whole(out)) == len(rows) and after[900005] == "password=[secret] is all"
            for (d, _), fs in spans.items():
                if d is not None and not fs:
                    assert after[d] == next(r["text"] for r in rows if r["doc_id"] == d)
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
        else:
            ids = {d: enc.encode_ordinary(t or "") for d, t in before}
            want = sorted([(d, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), x in zip(before, (enc.encode_ordinary(t or "") for _, t in before))], key=str)
            assert sorted(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == want and len(ids) > 50
        now = out
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_pipeline_run(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 100 < out.count() < 200 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_one_of_each_searches_fingerprints(spark, monkeypatch):
    from arraymill.llm import overlap

    text = " ".join(f"w{k}" for k in range(400))
    d = spark.createDataFrame([(k, text.replace("w200 ", f"x{k} ")) for k in range(6)] + [(9, "other words stand in this text")], "doc_id long, text string")
    found, links = [], overlap.links

    def spy(distinct, *rest):
        out = links(distinct, *rest)
        found.extend(out.collect())
        return out

    monkeypatch.setattr(overlap, "links", spy)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(d).collect()) == [0, 9]
    assert found  # near copies met by fingerprint, before the exact search


def test_near_copies_below_the_similarity_make_few_pairs(spark, monkeypatch):
    """80 copies of a text that is not there, most of them at a similarity of some 0.7; pairs that can be no link never become rows."""
    from arraymill.llm import overlap

    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(80):
        w = list(base)
        for i in rng.sample(range(0, 200, 8), 2 if k % 20 == 0 else 4):
            w[i] = f"x{k}y{i}"
        texts.append(" ".join(w))
    s = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    near = lambda i, j: len(s[i] & s[j]) * 5 >= 4 * len(s[i] | s[j])
    want = set(grouped(list(range(80)), near))
    assert 40 < len(want) < 80
    made, apart = [], overlap._apart

    def spy(*rest):
        out = apart(*rest)
        made.append(out.count())
        return out

    monkeypatch.setattr(overlap, "_apart", spy)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(d).collect()} == want
    assert made and sum(made) < 400  # of 3160


def test_sketches_bound_the_difference():
    from arraymill.llm import overlap

    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 30, 300, 2000, 0, 310)]
    got = overlap._sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])).view(np.uint64)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert int(np.bitwise_count(got[i] ^ got[j]).sum()) <= len(np.setxor1d(x, y))
    assert got[2].any() and not got[0].any()


def test_substrings_blocks_are_few(spark, monkeypatch, tmp_path):
    """Each batch makes at most two blocks a shuffle partition, however many entries share a window."""
    rng = random.Random(31)
    line = prose(rng, 30)
    some = [(k, prose(rng, 300) + " " + line + " " + prose(rng, 300)) for k in range(64)]
    made, emit = [], substrings._emit

    def spy(*rest):
        out = emit(*rest)
        made.append(out.count())
        return out

    monkeypatch.setattr(substrings, "_emit", spy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spark.createDataFrame(some, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
        d = spark.read.parquet(f"{tmp_path}/d")  # a table whose size is known
        assert sorted(map(tuple, substrings.without_repeats(d).collect()), key=str) == without_repeats(some)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(made) == 2 and 0 < made[0] <= d.rdd.getNumPartitions() * 2 * 16


def test_small_tables_take_few_tasks_and_jobs(spark, monkeypatch):
    """A few edges are read by one task in all rounds, and a table of fixed size comes to the driver in one job, however many shuffle partitions there are."""
    from arraymill.llm import _store
    from arraymill.llm._bits import merged

    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("40", "false"), strict=True):
        spark.conf.set(k, v)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("fixed size"))
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(50)], "u long, v long").repartition(30)
        got = components.components(edges)
        assert got.rdd.getNumPartitions() == 1 and sorted(map(tuple, got.collect())) == [(k, 0) for k in range(1, 51)]
        monkeypatch.setattr(_store, "TASK_BYTES", 1 << 14)
        wide = _store.dense(spark.range(20000).repartition(40))  # a larger one by several
        assert 1 < wide.rdd.getNumPartitions() < 40 and wide.count() == 20000
        assert _store.dense(spark.createDataFrame([], "u long")).count() == 0
        spark.sparkContext.setJobGroup("fixed size", "")
        add = lambda own, b: np.add.at(own, b.column(0).to_numpy(), 1)
        counts = merged(spark.range(1 << 14).selectExpr("id * 3 % 20000 as k"), 1 << 15, np.int64, add, np.add)
        assert counts.tolist() == np.bincount(np.arange(1 << 14) * 3 % 20000, minlength=1 << 15).tolist()
        assert 0 < jobs() <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
