"""Each operator on a small table with nulls, empty texts, repeated rows and clashing columns, against brute force."""

import base64
import hashlib
import math
import os
import random
import re
import string
import subprocess
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, components, decontamination, hamming, idstore, kernels, labelled, packing, quality, secrets, similarity, tokens, toxicity, warc
from tidewell.llm.shared import gathered, scratch
from tidewell.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [(1, "a b c d e f g"), (2, "A b  c d e\tf g"), (3, ""), (4, None), (5, "one two"), (6, "one two"), (7, LONG), (8, LONG + " end"), (9, 'token = "0123456789abcdef0123456789abcdef"'), (9, "x"), (None, "a b c d e f g"), (12, "<|endoftext|> İ ß \x1c é́")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in TEXTS], "doc_id long, text string, score string, n double")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_encoder():
    w, rng = WordEncoder(), np.random.default_rng(3)
    letters = [chr(c) for c in range(0x250)] + list("́K 　Σ中") + [" "] * 99 + ["'ll", " <|endoftext|> "]
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert w.encode(text) == w._whole(text)


def test_encoder_takes_texts_together(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 300)
    monkeypatch.setattr(tokens, "PLACED", 7)
    w, rng = WordEncoder(), np.random.default_rng(4)
    latin = [chr(c) for c in range(32, 0x250)] + [" "] * 150 + ["'ll", "'.", "...", "a-.", "don't"]
    letters = latin + list("\x1c\x85́K 　Σ中’") + [" <|endoftext|> "]
    texts = [None, "", "  a b. ", "x. " * 500, *("".join(rng.choice(letters if k % 2 else latin, rng.integers(0, 30))) for k in range(3000))]
    texts += [f"x{chr(c)}y {chr(c)}. " for c in range(0x250)]
    assert list(w.encode_all(pa.array(texts, pa.string()))) == [w._whole(t or "") for t in texts]
    assert list(w.encode_all(pa.array([], pa.string()))) == []
    w = WordEncoder()
    assert next(w.encode_all(pa.array(["The the. THE, the"]))) == w._whole("The the. THE, the") and set(w.known) == {"the", ".", ","}


def test_encoder_keeps_a_word_once_whatever_marks_follow():
    w, text = WordEncoder(), "Word### word&&& word word.*** w-w word_ 555-01"
    assert list(w.encode_all(pa.array([text]))) == [w._whole(text)]
    assert {"word", "###", "&&&", ".***", "_"} <= set(w.known) and not {"word###", "word&&&", "word.***", "word_"} & set(w.known)


def test_small_batches_are_encoded_together():
    rows = [pa.RecordBatch.from_pydict({"text": pa.array(["word " * n], pa.string())}) for n in (1, 2, 3, 400, 1, 1)]
    assert [b.column(0).to_pylist() for b in gathered(iter(rows), 1000)] == [["word ", "word " * 2, "word " * 3], ["word " * 400], ["word ", "word "]]
    assert list(gathered(iter([]), 1000)) == []


def test_chunks_of_streams_taken_together():
    rng = np.random.default_rng(11)
    streams = [rng.integers(0, 49000, n).astype("<u4") for n in (1, 5000, 63, 64, 65, 3000, 2)] + [np.full(5000, 7, "<u4")]
    at = idstore.marks(np.concatenate(streams))
    a = 0
    for ids in streams:
        b = a + len(ids)
        ends = idstore.between(at[(at > a) & (at <= b)].tolist(), a, b)
        assert [e - a for e in ends] == idstore.cuts(ids)
        a = b


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    w = WordEncoder()
    whole = sorted(w._whole(t or "") + b"\1\0\0\0" for _, t in TEXTS)
    assert sum(r["length"] for r in rows) * 4 == sum(map(len, whole))
    assert {zlib.crc32(x) for x in whole if len(x) <= 8192} <= {r["ids_crc32"] for r in rows}
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048
    assert packing.pack(none).count() == 0


def test_store(spark, docs, none):
    for sent in (1_000_000, -1):
        path = scratch(spark, "store")
        idstore.write(docs, path, most_sent=sent)
        rows = sorted(idstore.read(spark, path).collect(), key=lambda r: r["start"])
        w, at = WordEncoder(), 0
        order = sorted(range(len(TEXTS)), key=lambda i: (TEXTS[i][0] is not None, TEXTS[i][0] or 0))
        assert [r["doc_id"] for r in rows] == [TEXTS[i][0] for i in order]
        want = sorted(zlib.crc32(w._whole(t or "") + b"\2\0\0\0") for _, t in TEXTS)
        assert sorted(r["ids_crc32"] for r in rows) == want
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
    path = scratch(spark, "store")
    idstore.write(none, path)
    assert idstore.read(spark, path).count() == 0


def test_store_finds_corruption(spark, docs):
    path = scratch(spark, "store")
    idstore.write(docs, path)

    def broken(table, change):
        bad = scratch(spark, "store")
        for x in ("chunks", "recipes", "manifest", "top"):
            df = spark.read.parquet(f"{path}/{x}")
            (change(df) if x == table else df).write.parquet(f"{bad}/{x}")
        with pytest.raises(Exception, match="match|missing"):
            idstore.read(spark, bad).collect()

    broken("recipes", lambda df: df.withColumn("sizes", F.transform("sizes", lambda x: x + 1)))
    broken("recipes", lambda df: df.withColumn("digests", F.reverse("digests")))
    broken("recipes", lambda df: df.withColumn("n_tokens", F.col("n_tokens") + 1))
    broken("recipes", lambda df: df.withColumn("doc_id", F.col("doc_id") + 1))
    broken("recipes", lambda df: df.where("start > 0"))
    broken("chunks", lambda df: df.withColumn("ids", F.concat("ids", F.lit(b"\0\0"))))
    broken("chunks", lambda df: df.where("n > 5"))
    broken("manifest", lambda df: df.withColumn("root", F.lit(b"0" * 16)))
    broken("top", lambda df: df.withColumn("store", F.lit(b"0" * 16)))
    with pytest.raises(Exception, match="does not fit"):
        idstore.write(docs, scratch(spark, "store"), width=1)


def test_store_keeps_shared_passages_once():
    rng, kept, total = np.random.default_rng(7), {}, 0
    for _ in range(300):
        passage = rng.integers(0, 30000, 1200)
        for _ in range(2):
            ids, at = np.concatenate([rng.integers(0, 30000, 100), passage, rng.integers(0, 30000, 100)]).astype("<u4"), 0
            total += len(ids)
            for end in idstore.cuts(ids):
                kept[ids[at:end].tobytes()] = end - at
                at = end
            assert at == len(ids)
    assert sum(kept.values()) < 0.8 * total


def test_similarity_through_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda a, b: " ".join(words[a:b])
    bridge = [(1, text(0, 40)), (2, text(10, 50)), (None, text(5, 45)), (None, "q r s t u v"), (None, "q r s t u v"), (None, "z y x w v u"), (None, None), (7, "z y x w v u")]
    rows = [r[1:] for r in sorted((repr(x), x["doc_id"], x["component_id"]) for x in similarity.near_duplicates(spark.createDataFrame(bridge, "doc_id long, text string")).collect())]
    assert sorted(map(repr, rows)) == sorted(map(repr, [(1, 1), (2, 1), (None, 1), (None, None), (None, None), (None, 7), (7, 7), (None, None)]))
    whole = similarity.near_duplicates(spark.createDataFrame([(i if i else 3, t) for i, t in bridge[:3]], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in whole} == {(1, 1), (2, 1), (3, 1)}


def test_similarity(docs, none):
    got = similarity.near_duplicates(docs).collect()
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert len(got) == len(TEXTS)
    assert by[(2, 3)] == 1 and by[(None, 3)] == 1 and by[(6, 1)] == 5 and by[(8, 2997)] == 7 and by[(3, 0)] == 3 and by[(4, 0)] == 4
    assert similarity.near_duplicates(none).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "W5 w6, w7 w8 w9 w10"), (2, "one two"), (3, None), (4, ""), (5, "p q r s t u")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, items).collect()}
    assert got == {(7, 1), (8, 1), (5, 2), (6, 2)}
    more = docs.union(spark.createDataFrame([(None, "x p q r s t u", "y", 2.0), (None, None, "y", 2.0)], docs.schema)).withColumn("item_id", F.lit(3))
    got = decontamination.contained(more, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 5), (5, 2), (6, 2), (7, 1), (8, 1)]
    assert decontamination.contained(docs.limit(0), items).count() == decontamination.contained(docs, items.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", None), (3, 0, "u", "hi"), (3, 1, "a", ""), (4, 0, "u", "hi"), (4, 1, "a", None), (None, 0, "u", "z"), (5, 0, None, "q")]
    got = {r["conv_id"]: r["n_turns"] for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: 2, 3: 2, 5: 1}


def _nearest(rows, queries, k):
    """query_id, rank, id, distance by comparing all."""
    near = {}
    for q, c in queries:
        for i, x in rows:
            if q != i and None not in (q, c, i, x):
                d = ((c ^ x) & (2**64 - 1)).bit_count()
                near.setdefault(q, {})[i] = min(d, near.get(q, {}).get(i, 64))
    return {(q, r, i, d) for q, found in near.items() for r, (d, i) in enumerate(sorted((d, i) for i, d in found.items())[:k], 1)}


@pytest.mark.parametrize("case", ["distinct ids", "repeated ids", "one id with many codes", "shared by pairs", "few codes", "empty"])
def test_hamming(spark, case):
    rng = np.random.default_rng(5)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 200)] + [7] * 60 + [7 ^ (1 << j) for j in range(20)]
    rows = {
        "distinct ids": [*enumerate(codes), (None, 1), (900, None), (7, codes[7])],
        "repeated ids": [(int(rng.integers(0, 90)), c) for c in codes],
        "one id with many codes": [(11, c) for c in codes[:150]] + [(20, c ^ 1) for c in codes[:150]] + list(enumerate(codes)),
        "shared by pairs": [(i, c) for c in codes[:40] for i in (11, 20)] + [(i, c) for i, c in zip(range(30, 50), codes, strict=False)] + list(enumerate(codes[150:], 60)),
        "few codes": [(5, c) for c in range(18)] + [(i, 3) for i in range(20, 60, 4)],
        "empty": [],
    }[case]
    df = spark.createDataFrame([(i, c, 0) for i, c in rows], "id long, code long, distance int")
    queries = [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] == 5)]
    got = [tuple(r) for r in hamming.search(df, df.where("id % 20 = 0 or id = 5"), 3).collect()]
    assert len(got) == len(set(got)) and set(got) == _nearest(rows, queries, 3)


def test_an_id_with_many_codes_takes_one_place(spark):
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(63)) for i in range(50)] + [(7, rng.getrandbits(63)) for _ in range(300)]
    codes, places = hamming._held_alike(spark.createDataFrame(rows, "id long, code long"), 10)
    assert places == 11 and codes.select("held").distinct().count() == 50


def test_sign_code(spark):
    rows = spark.createDataFrame([(1, [1.0, -1.0, 0.0, None, 2.0]), (2, []), (3, None), (4, [-1.0] * 63 + [1.0])], "id long, v array<double>")
    got = {r["id"]: r["c"] for r in rows.select("id", hamming.sign_code("v").alias("c")).collect()}
    assert got == {1: 17, 2: 0, 3: None, 4: -(2**63)}
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(hamming.sign_code("v")).collect()


def test_archives_are_gzip(spark, tmp_path):
    big = "".join(random.Random(1).choices(string.printable, k=17 << 20))
    pages = spark.createDataFrame([(1, "u", "a", 5), (2, "v", "a", 6), (3, "w", big, 7), (4, None, None, 8)], "page_id long, url string, html string, payload_bytes int").coalesce(1)
    path = scratch(spark, "warc")
    warc.write(pages, path)
    files = [f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".warc.gz")]
    whole = b""
    for f in files:
        at = f"{path.removeprefix('file://')}/{f}"
        assert subprocess.run(["gzip", "-t", at], capture_output=True).returncode == 0
        whole += subprocess.run(["gzip", "-dc", at], capture_output=True, check=True).stdout
    assert whole.count(b"WARC/1.1\r\n") == 4
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, path).collect()}
    assert got == {1: (1, "response", None), 2: (1, "revisit", 1), 3: (len(big), "response", None), 4: (0, "response", None)}
    none = scratch(spark, "warc")
    warc.write(pages.limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_warc(spark):
    html = "<p>é" + "x" * 5000
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://a/{i} b", None if i == 4 else html if i % 2 else f"p{i}") for i in range(60)] + [(None, "u", html)], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write(pages, path)
    for split in (97, 1 << 20):
        got = warc.read(spark, path, split, with_payload=True).collect()
        assert len(got) == 61
        for r in got:
            data = ("" if r["page_id"] == 4 else html if r["page_id"] is None or r["page_id"] % 2 else f"p{r['page_id']}").encode()
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            odd = r["page_id"] is None or (r["page_id"] % 2 and r["page_id"] != 1)
            assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if odd else ("response", None))


def test_secrets(docs, none):
    found = {r["doc_id"]: r for r in secrets.scan(docs.where("n = 1"), secrets.learn(docs)).where("n_hex > 0").collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in found[9]["spans"]] == [("assign", 0, 41), ("hex", 9, 41)]
    text = secrets.redact(docs, secrets.learn(docs)).where("text like '%[secret]%'").collect()
    assert [r["text"] for r in text] == ['[secret]"'] and text[0]["score"] == "x"
    assert secrets.scan(none, secrets.learn(none)).count() == 0
    hexes = [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(300)]
    model = secrets.infer(hexes)
    assert len(model.to) < 60
    low = secrets.likelihood(model, [hexes[0], "zzzzzzzzzzzzzzzzzzzz9"])
    assert low[0] / 40 > low[1] / 21


def test_secrets_short_and_beside_base_spans(spark):
    rng = np.random.default_rng(4)
    codes = ["".join(rng.choice(list("QXZJKVWY"), 10)) + "77" for _ in range(200)]
    words = ["".join(rng.choice(["tion", "er", "lich", "ou", "ment", "re"], 4)) for _ in range(300)]
    texts = [f"the words {words[i]} of an {words[i + 50]} line {i} and token = {c}" for i, c in enumerate(codes[1:])] + [f"see {codes[0]} here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan(rows, secrets.learn(rows)).where("doc_id = 199").collect()
    assert [(s["start"], s["end"], s["added"]) for s in found[0]["spans"]] == [(4, 16, True)]
    text = f"abc_{'a1' * 12}_{codes[0]} z"
    assert secrets.candidates(text, secrets.base_spans(text), 6) == [(28, 41)]


def test_grammars_find_planted_formats():
    rng, letters = random.Random(3), string.ascii_letters + string.digits
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    ghp, key, hexes = (lambda: "ghp_" + some(letters, 36)), (lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16)), (lambda: some("0123456789abcdef", 40))
    words = [some(["the", "re", "tion", "er", "lich", "ou"], rng.randrange(2, 6)) for _ in range(4000)]
    model = secrets.Grammars(tuple(secrets.infer([make() for _ in range(300)]) for make in (ghp, key, hexes)), secrets.chain(words[:2000]), secrets.MARK)
    assert [len(k.to) for k in model.kinds] == [41, 21, 41]  # a place each, and the end
    for kind, make in enumerate((ghp, key, hexes)):
        assert sum(x == kind for x in model.judge([make() for _ in range(200)])) >= 190
    others = [some("0123456789abcdef", n) for n in (20, 23) for _ in range(100)] + [some(string.digits, 16) for _ in range(100)] + [some(string.ascii_uppercase, 8) for _ in range(100)]
    assert not any(x is not None for x in model.judge(words[2000:] + others))
    assert model.least == 20


def test_secrets_edges(spark):
    rng = random.Random(5)
    keys = ["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)) for _ in range(80)]
    bare = "ghp_" + "".join(rng.choices(string.ascii_letters + string.digits, k=36))
    made = ["ghp_" + "".join(rng.choices(string.ascii_letters + string.digits, k=36)) for _ in range(80)]
    words = ["".join(rng.choices(["tion", "er", "lich", "ou", "ment", "re"], k=4)) for _ in range(300)]
    long = " ".join(words) * 200 + " " + bare
    texts = [f"line {i} {words[i]} token = {m} and {k}" for i, (m, k) in enumerate(zip(made, keys, strict=True))] + [long, long, f"password: {bare}", f"{'0' * 24}g{made[0][4:]}", None, ""]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["added"]) for s in r["spans"]] for r in secrets.scan(rows, secrets.learn(rows)).collect()}
    at = len(long) - 40
    assert found[80] == found[81] == [("assign", at, at + 40, True)]
    assert found[82] == [("assign", 0, 50, False)] and found[84] == found[85] == []
    assert found[83] == [("hex", 0, 24, False)]  # what is left of it is no whole string of a format


@pytest.mark.parametrize(("run", "label", "mark"), [(toxicity.op3_toxicity, "toxic", 0.9), (quality.op8_quality, "quality", 0.95)])
def test_classifiers(spark, run, label, mark):
    sf = "/root/testdata/sf0.01"
    got = run(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).collect()[0][0] > mark


def test_label_model_overrules_labels():
    """Where voters agree against a label, the posterior goes with them; without votes it would stay."""
    rng = np.random.default_rng(8)
    truth = rng.random(1200) < 0.2
    votes = (rng.random((1200, 6)) < np.where(truth[:, None], 0.6, 0.01)).astype(np.float32)
    votes = np.hstack([votes, (votes.sum(axis=1, keepdims=True) == 0)]).astype(np.float32)
    labels = truth.astype(float)
    wrong = rng.choice(np.flatnonzero(truth & (votes[:, :6].sum(axis=1) >= 3)), 25, replace=False)
    labels[wrong] = 0
    labels[600:] = np.nan
    wrong = wrong[wrong < 600]
    assert len(wrong) > 5
    found = toxicity.label_model(votes, labels, 6)
    assert (found.toxic[wrong] > 0.5).all()
    assert ((found.toxic > 0.5) == truth)[600:].mean() > 0.94
    alone = toxicity.label_model(np.zeros_like(votes), labels, 6).toxic
    assert (alone[wrong] < 0.5).all()


def test_words_are_split_alike():
    voters = toxicity.Voters(("übel",), ("schli**",))
    texts = ["ein „Übel“…", "ÜBEL", "übelst", "schlimm, schlicht", "schlimm", None, "", "you are a liar", "x" * (3 << 20) + " übel"]
    got = voters.votes(toxicity.pa.array(texts))
    assert got[:, 0].tolist() == [1, 1, 0, 0, 0, 0, 0, 0, 1]
    assert got[:, 1].tolist() == [0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert got[7, 2] == 1 and got[:, -1].tolist() == [0, 0, 1, 0, 1, 1, 1, 1, 0]
    assert toxicity.terms("„Übel“…") == {"übel"}


@pytest.mark.parametrize(("run", "label", "mark"), [(toxicity.op3_toxicity, "toxic", 0.7), (quality.op8_quality, "quality", 0.5)])
def test_classifier_columns(spark, run, label, mark):
    """The bounds of the score, the threshold, who is held out, and that held-out labels are never learnt from."""
    sf = "/root/testdata/sf0.001"
    rows = run(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= mark) for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn(label, F.when(labelled.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    module = toxicity if label == "toxic" else quality
    one, two = (quality.score(docs, module.train(docs, x), mark).agg(F.sum(F.round("score", 6))).collect()[0][0] for x in (labels, turned))
    assert math.isclose(one, two, abs_tol=1e-3)


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(3, f"t{i}") for i in range(500)] + [(i, "u") for i in range(10, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (10, 1), (12, None)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", 10, unlabelled=20).collect()
    assert len([r for r in got if r["label"] is None]) == 20 and sorted((r["doc_id"], r["text"], r["label"]) for r in got if r["label"] is not None) == [(i, t, 1) for i, t in ((3, "t0"), (10, "u")) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for module in (toxicity, quality):
        model = module.train(docs, labels)
        assert quality.score(docs, model, 0.5).count() == len(TEXTS)
        assert quality.score(none, model, 0.5).count() == 0


def test_similarity_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity.op5_similarity_join(spark, SF).collect()}
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert linked
    while True:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(label[a] != label[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = [tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(label) and dict(got) == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_of_long_words(monkeypatch):
    data = np.frombuffer(b"abc " + b"x" * 5000 + b" abc " + b"x" * 5000 + b" y\n", np.uint8)
    starts, stops, _ = kernels.words(data, np.array([len(data) - 1]))
    whole = kernels.word_hashes(data, starts, stops)
    monkeypatch.setattr(kernels, "BLOCK", 1024)
    kernels._powers.cache_clear()
    assert (kernels.word_hashes(data, starts, stops) == whole).all() and whole[0] == whole[2] and whole[1] == whole[3] != whole[4]
    kernels._powers.cache_clear()


def test_sketch_never_counts_too_little():
    rng = np.random.default_rng(2)
    fine, coarse = np.zeros(1 << 10, np.uint8), np.zeros(similarity.COARSE, np.uint32)
    s = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for _ in range(3):
        similarity._count(fine, coarse, s[:300])
    similarity._count(fine, coarse, s)
    byte, shift = similarity._fine(s, 1 << 11)
    n = (fine[byte] >> shift) & 15
    assert (n[:300] >= 4).all() and (n >= 1).all() and (n == 1).any()
