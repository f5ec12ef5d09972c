from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    """Every document through every order, one at a time. docs: (doc_id, text, part)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marked = {}
    for i, quality, toxic in labels:
        good, bad = marked.get(i, (False, False))
        marked[i] = (good or quality == 1, bad or toxic == 1)
    counts = Counter()
    parts = {p or "" for _, _, p in docs}
    orders = ["".join(o) for o in permutations("ABCDE")]
    for i, t, p in docs:
        t, words = t or "", WORD.findall(t or "")
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if bad}
        good, toxic = marked.get(i, (False, False)) if i is not None else (False, False)
        for order in orders:
            for step, f in enumerate(order, 1):
                early = fails & set(order[: step - 1])
                what = "redundant" if f in fails and early else "removed" if f in fails else None if early else "kept"
                key = (p or "", order, step)
                counts[*key, what] += 1
                counts[*key, "unique_fails"] += fails == {f}
                counts[*key, "good_lost"] += what == "removed" and good
                counts[*key, "toxic_lost"] += what == "removed" and toxic
                counts[p or "", f, "shapley"] += what == "removed"
    return {(p, o, s): (*(counts[p, o, s, c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), counts[p, o[s - 1], "shapley"])
            for p in parts for o in orders for s in range(1, 6)}


def run(docs, labels):
    return {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


def make_docs(rng):
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words[: rng.integers(20, 400)], rng.integers(0, 400)))
        text += rng.choice(["", " #", " SHOUTING LOUDLY IN CAPITALS " * 9, "\x0bé|"])
        docs.append((i, str(text), ["en", "de", None][i % 3]))
    docs += [(100 + i, docs[i][1], "fr") for i in range(0, 20, 2)]
    return docs + [(7, docs[7][1], "en"), (7, docs[8][1], "en"), (None, docs[3][1], "en"), (None, docs[3][1], "en"), (None, None, None),
                   (200, None, ""), (201, "", None), (202, " \n ", "en"), (203, "Aa" * 90_000 + " b" * 30_000, "en")]


@pytest.mark.parametrize("shard_bytes", [filter_audit.SHARD_BYTES, 2000])
def test_audit_equals_every_document_in_every_order(spark, docs_frame, monkeypatch, shard_bytes):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", shard_bytes)
    docs = make_docs(np.random.default_rng(6))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 1, 1), (3, 0, 0), (9, None, None), (None, 1, 1), (100, 1, 1), (999, 1, 1)]
    assert run(docs_frame(*docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == plain_audit(docs, labels)


def test_empty_tables(spark, docs_frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(docs_frame((1, "a")).limit(0), labels) == {}
    found = run(docs_frame((1, "a b", "en")), labels)
    assert len(found) == 600 and found == plain_audit([(1, "a b", "en")], [])


def test_shards_hold_the_matrix_and_one_dictionary(docs_frame, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 40)
    texts = {1: "a b a c", 2: None, 3: "b é b", 4: "c d " * 20, 5: "A a"}
    shards = stage(filter_audit.matrix(docs_frame(*texts.items())), "test-shards")
    counted, ids = {}, {}
    for s in shards.collect():
        assert len(s.starts) == len(s.rows) + 1 and len(s.words) == len(set(s.words)) == len(s.ids)
        for word, id_ in zip(s.words, s.ids, strict=True):
            assert ids.setdefault(word, id_) == id_
        for i, row in enumerate(s.rows):
            span = slice(s.starts[i], s.starts[i + 1])
            counted[row.doc_id] = {s.words[c]: n for c, n in zip(s.columns[span], s.counts[span], strict=True)}
    assert counted == {i: dict(Counter(WORD.findall(t or ""))) for i, t in texts.items()} and shards.count() > 1
    assert len(set(ids.values())) == len(ids)
    assert {(r.id, r.word) for r in filter_audit.dictionary(shards).collect()} == {(i, w) for w, i in ids.items()}


def test_words_that_share_an_id_get_another(spark, docs_frame, monkeypatch):
    real = filter_audit.word_ids

    def narrow(words, n, seed=0):
        return real(words, n, seed) % 5 if seed == 0 else real(words, n, seed)

    monkeypatch.setattr(filter_audit, "word_ids", narrow)
    shards = filter_audit.matrix(docs_frame((1, " ".join(f"w{i}" for i in range(30))))).collect()
    frame = spark.createDataFrame([(narrow([w.encode() for w in s.words], len(s.words)).tolist(), s.words) for s in shards], "ids array<long>, words array<string>")
    moved = filter_audit.moved_ids(frame)
    ids = {w: moved.get(w, i) for r in frame.collect() for i, w in zip(r.ids, r.words)}
    assert len(moved) >= 25 and len(set(ids.values())) == len(ids) == 30
    monkeypatch.setattr(filter_audit, "MOST_MOVED", 10)
    with pytest.raises(RuntimeError, match="share an id"):
        filter_audit.moved_ids(frame)


def test_only_distinct_words_and_decisions_are_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plan = filter_audit.audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "text" not in plan.replace("audit-shards", "").replace("text_", "")
    assert filter_audit.flags(docs).filter(F.col("flags") < 0).count() == 0


def test_a_row_group_of_shards_is_bounded(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(filter_audit, "stage", lambda *a: staged.append(stage(*a)) or staged[-1])
    words = "array_join(transform(sequence(1, 60000), i -> concat(id, 'x', hash(i, id))), ' ')"
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), F.expr(words).alias("text"), F.lit("en").alias("lang"))
    assert filter_audit.flags(docs).count() == 40
    (path,) = staged[0].inputFiles()
    written = pq.ParquetFile(path.removeprefix("file://")).metadata
    groups = [written.row_group(i) for i in range(written.num_row_groups)]
    assert written.num_rows > 2 and max(g.num_rows for g in groups) <= 2  # shards of some 15 MB, row groups of 16 MB
