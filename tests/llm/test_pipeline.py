"""The pipeline's rows against plain Python over the same documents."""

import re
import zlib

import corpus_pipeline
from tidewell.llm import quality, secrets, toxicity
from tidewell.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.01"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _runs(words, size=5):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _smallest_of_groups(texts):
    """Documents that have no smaller one in their component."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        sets[i] = _runs(w) if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    close = lambda x, y: 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y))
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and close(sets[a], sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {i for i in label if label[i] == i}


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _leaks(text, items):
    held = _runs(_words(text))
    return any(len(t & held) * 100 >= 75 * len(t) for t in items)


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in quality.score(docs, model, 0.7).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in bad}
    assert bad and len(bad) < docs.count() / 2
    kept = _smallest_of_groups(texts)
    texts = {i: t for i, t in texts.items() if i in kept}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [_runs(_words(t)) for t in items]
    assert all(items)
    leaked = {i for i, t in texts.items() if _leaks(t, items)}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    assert leaked

    left = docs.where(docs["doc_id"].isin(list(texts)))
    for r in secrets.scan(left, secrets.learn(left)).where("size(spans) > 0").collect():
        t, spans = texts[r["doc_id"]], r["spans"]
        inside = [any(s["start"] <= k < s["end"] for s in spans) for k in range(len(t))]
        begins = {s["start"] for s in spans if not any(o["start"] < s["start"] < o["end"] for o in spans)}
        texts[r["doc_id"]] = "".join(("[secret]" if k in begins else "") if inside[k] else t[k] for k in range(len(t)))
    assert any("[secret]" in t for t in texts.values())

    encode, got = WordEncoder()._whole, {}
    rows = corpus_pipeline.run(spark, SF).collect()
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert got.keys() == texts.keys()
    for i, pieces in got.items():
        ids, at = encode(texts[i]) + b"\1\0\0\0", 0
        for start, length, crc, tokens in sorted(pieces):
            assert start == at and tokens * 4 == len(ids)
            at += length
            assert crc == zlib.crc32(ids[start * 4 : at * 4])
        assert at * 4 == len(ids)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:], strict=False))
    assert all(a[1] + a[2] <= 2048 for a in places)


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    copy, leak = "a b c d e f g h", "the item p q r s t u v"
    rows = [(None, copy), (None, copy), (5, copy), (5, copy), (3, copy), (7, copy), (7, "not a copy of any other"), (8, leak), (8, "clean text of a repeated id"), (None, leak), (None, "clean"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.keep_one(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(3, copy), *rows[6:8], *rows[8:9], *rows[10:]]))
    spark.createDataFrame([(1, "p q r s t u v")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in corpus_pipeline.keep_unleaked(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [x for x in rows if x[1] != leak]))
