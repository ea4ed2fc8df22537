"""Each operator against brute force on small documents, with nulls, empty and long texts, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def text(r):
    return r["text"] or ""


def test_licenses(spark, docs, none):
    from hydrolens.llm.licenses import scan_licenses

    more = docs.unionByName(spark.createDataFrame([
        (20, "Some words.\nReleased under the MIT License.\nmore", "a", 1, ""), (21, "Licensed under CC BY-NC 4.0.", "a", 1, ""), (22, "my fishing license is old", "a", 1, "")], docs.schema))
    got = {r["doc_id"]: (r["families"], r["n_unknown"]) for r in scan_licenses(more).collect()}
    assert got[20] == ("mit", 0) and got[21] == ("cc", 0) and got[22] == ("", 1) and got[3] == ("", 0)
    assert scan_licenses(none).count() == 0


def brute_secrets(t):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, docs, none):
    from hydrolens.llm.secrets import find_secrets, redacted

    rng = random.Random(1)
    parts = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "abc", "12345678", "deadbeef" * 4, "AKIA", "ABCDEF012345", "é", "𝒳", "-", "\n"]
    odd = spark.createDataFrame([(100 + i, "".join(rng.choices(parts, k=40)), f"s{i}", 0, "") for i in range(120)], docs.schema)
    rows = find_secrets(docs.unionByName(odd)).withColumn("clean", redacted(F.coalesce("text", F.lit("")), F.col("secret_spans"))).collect()
    assert len(rows) == 130
    for r in rows:
        assert r["base_spans"] == brute_secrets(text(r))
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(list(filter(None, r["base_spans"].split(","))))
        places = set()
        for s in filter(None, r["spans"].split(",")):
            places.update(range(int(s.split(":")[1]), int(s.split(":")[2])))
        left = "".join(c for i, c in enumerate(text(r)) if i not in places)
        assert r["clean"].replace("[SECRET]", "") == left
    assert find_secrets(none).count() == 0


def test_secret_owners(spark, docs):
    from hydrolens.llm.secrets import find_secrets

    rows = [(i, "password=copied123456" if i < 6 else f"password=private{i:08d}", f"s{i}", 0, "") for i in range(9)]
    got = find_secrets(spark.createDataFrame(rows, docs.schema)).collect()
    assert sorted(r["doc_id"] for r in got if r["n_live"]) == [6, 7, 8]
    assert sorted(r["doc_id"] for r in got if r["n_example"]) == [0, 1, 2, 3, 4, 5]


def test_substrings(spark, docs, none):
    from hydrolens.llm.substrings import dedup_substrings

    rng = random.Random(2)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(30, 80))) for _ in range(6)]
    odd = [(200 + i, " ".join(rng.choices("uvwxyz", k=rng.randint(0, 30)) + [rng.choice(pool)] + rng.choices("uvwxyz", k=20)), "s", 0, "") for i in range(60)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    own = [WORD.findall(text(r)) for r in rows.collect()]
    seen = Counter(tuple(w[k:k + 35]) for w in own for k in range(len(w) - 34))
    expected = Counter()
    for w in own:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        expected[(len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert Counter((r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_substrings(rows).collect()) == expected
    assert dedup_substrings(none).count() == 0


def test_vectors(spark):
    from hydrolens.llm.vectors import nearest

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 8)), 2)
    x[300:340] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(None, [1.0] * 8), (900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (5, [float(c) for c in x[5]])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = total = 0
    for q in range(0, 600, 20):
        best = sorted((float(np.sqrt(((x[j] - x[q]) ** 2).sum())), j) for j in range(600) if j != q)[:10]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 11)) and own == [(k + 1, *p[::-1]) for k, p in enumerate(sorted((s, j) for _, j, s in own))]
        found, total = found + len({j for _, j in best} & {j for _, j, _ in own}), total + 10
    assert found / total >= 0.9
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity(spark, docs, none):
    from hydrolens.llm.toxicity import score, train

    rng = random.Random(3)
    made = [(i, " ".join(rng.choices(["river", "stone", "cloud", "field", "house", "green", "water"], k=30) + (["horridword", "vileterm"] if i % 4 == 0 else [])), "s", 0, "") for i in range(1000, 1240)]
    rows = spark.createDataFrame(made, docs.schema)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000, 1200)] + [(None, 1), (1001, None)], "doc_id long, toxic int")
    model = train(rows, labels)
    got = {r["doc_id"]: r["predicted"] for r in score(rows, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(1200, 1240))
    assert all(0 <= r["score"] <= 1 for r in score(docs, model).collect())
    misspelt = spark.createDataFrame([(1, "river stone cloud horridwort vileterms water", "s", 0, "")], docs.schema)
    assert score(misspelt, model).first()["predicted"] == 1
    assert score(none, model).count() == 0
    assert score(docs, train(docs, labels.where("false"))).agg(F.max("score")).first()[0] < 1e-9


def test_jaccard(spark, docs, none):
    from hydrolens.llm.jaccard import near_classes, one_of_each, plan

    bands, rows_ = plan()
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.9995
    rng = random.Random(4)
    base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=120) for _ in range(5)]
    odd = []
    for i in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice("ABCDE")
        odd.append((300 + i, " ".join(w), "s", 0, ""))
    rows = docs.where("doc_id is not null").unionByName(spark.createDataFrame(odd, docs.schema))
    own = [(r["doc_id"], WORD.findall(text(r))) for r in rows.collect()]
    sets = [(i, {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()) for i, w in own]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9 and (x & y):
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(sets)):
        least[find(k)] = min(least.get(find(k), sets[k][0]), sets[k][0])
    expected = Counter((sets[k][0], least[find(k)], links[k]) for k in range(len(sets)))
    assert Counter((r["key"], r["class_id"], r["n_links"]) for r in near_classes(rows).collect()) == expected
    assert sorted(r["doc_id"] for r in one_of_each(rows).collect()) == sorted(least.values())
    assert near_classes(none).count() == 0


def test_fingerprints(spark, docs, none):
    from hydrolens.llm.fingerprints import fingerprints

    rows = docs.where("doc_id is not null")
    got = sorted(fingerprints(rows).collect(), key=lambda r: (r["doc_id"], r["edited_text"]))
    order = sorted(rows.collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(order)
    expected = []
    for k, r in enumerate(order):
        t, n = text(r), text(order[(k + 1) % len(order)])
        q = len(t) // 4
        expected.append((r["doc_id"], t[:len(t) - q] + n[:q]))
    assert [(r["doc_id"], r["edited_text"]) for r in got] == sorted(expected)
    prints = {}
    for r in got:
        assert prints.setdefault(text(r), r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1.0
    assert fingerprints(docs).count() == docs.count() and fingerprints(none).count() == 0


def test_fingerprint_order(spark):
    """A text whose halves change places keeps its k-mers but loses likeness."""
    from hydrolens.llm.fingerprints import likeness, signature

    a, b = [" ".join(f"{c}{i}" for i in range(150)) for c in "xy"]
    df = spark.createDataFrame([(a + " " + b, b + " " + a, a + " z " + b)], "s string, t string, u string")
    s, t, u = (signature(F.col(c)) for c in "stu")
    moved, near, repeated = df.select(likeness(s, t), likeness(s, u), likeness(signature(F.lit("p q r " * 50)), signature(F.lit("p q r " * 10)))).first()
    assert moved < 0.8 < near and repeated < 1.0


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    from hydrolens.llm.tokens import Encoder, decode, encode, round_trip, vocabulary, with_ids

    file = path("byte_bpe_50k.json")
    public = Tokenizer.from_file(file)
    rng = random.Random(6)
    texts = ["", " ", "a  b\n\n c", "don't 'll  'r", "<|endoftext|>x <|endoftext|>", "é" * 2000, "a" * 9000, "=-_" * 3000, "日本 語" * 40, "\x1c a\x85b\xa0 c"]
    texts += ["".join(rng.choices(["a", "th", "e", " ", "  ", "\n", "'s", "ing", "1", "!!", "é", ","], k=300)) for _ in range(60)]
    for t in texts:
        ids = encode(t, file)
        assert ids.tolist() == public.encode(t, add_special_tokens=False).ids
        assert decode(ids, file) == public.decode(ids.tolist(), skip_special_tokens=False)
    v, memo = vocabulary(file)
    for t in ("abcdefgh" * 1500, "".join(rng.choices("aetinosr", k=5000))):
        stream, out, data = Encoder(v, memo), [], t.encode()
        for at in range(0, len(data), 7):
            out += stream._bytes(data[at:at + 7], at + 7 >= len(data))
            assert len(stream.open) <= 4 * v.reach + 7
        assert out == v.merge(data)
    assert {r["doc_id"]: r["n_tokens"] for r in round_trip(docs, file).collect()}[3] == 0
    assert with_ids(docs, file).where("doc_id = 4").first()["ids"] == []
    assert round_trip(none, file).count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    from hydrolens.llm.packing import WordIds, pack, sequences

    file = path("word_bpe_49k.json")
    public, own = Tokenizer.from_file(file), WordIds(file)
    rng = random.Random(7)
    for t in ["don't 'S A.B ÀÉÎ İs ŉa ſs Straße, ΣΑΣ.", "a\x85b c\xa0d", "\x1cab !\x1d! z", "<|endoftext|> a"] + ["".join(rng.choices("aÉ ,.'ſİdσΣ1\n!ß", k=100)) for _ in range(80)]:
        assert own(t, 2).tolist() == public.encode(t, add_special_tokens=False).ids + [2]
    pieces = pack(docs, file, length=64, with_ids=True)
    rows = pieces.collect()
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] for r in rows)
    whole = sum(len(public.encode(text(r), add_special_tokens=False).ids) + 1 for r in docs.collect())
    filled = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for s, o, n in filled:
        assert (s, o) == divmod(at, 64)
        at += n
    assert at == whole
    assert all(len(r["ids"]) == 64 for r in sequences(pieces).where(F.col("sequence_id") < whole // 64).collect())
    assert pack(none, file).count() == 0


def test_html(spark):
    from hydrolens.llm.html import extract

    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='sidebar'><p>Side, text, with, commas.</p></div>"
            "<article><h1>Head &amp; line</h1><p>First  paragraph, with <b>bold</b>,\n words.<p>Second one.</article><div id=comments><p>A comment, and more, and more.</p></div><footer>Foot</footer>")
    rows = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<p>cut &am", "t"), (5, "<div>" * 3000 + "deep, text", "t"), (1, page, "t")], "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in extract(rows).collect()]
    assert got.count((1, "Head & line\n\nFirst paragraph, with bold, words.\n\nSecond one.")) == 2
    assert dict(got)[2] == "" and dict(got)[3] == "" and dict(got)[4] == "cut &am" and dict(got)[5] == "deep, text"
    assert extract(rows.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert 0 < docs.count() < 200
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_html_odd_markup():
    from hydrolens.llm.html import main_text

    assert main_text("<![foo[ x ]]><p>a</p>") == "a"
    assert main_text("<p>q<!-- c --> r</p><!-- <p>never closed</p>") == "q r"
    assert main_text("<!-->x<p>b</p>") == "x\n\nb"
    assert main_text("<!--" * 50_000) == "" and main_text("<div>" * 5_000 + "x" + "</section>" * 50_000) == "x"
