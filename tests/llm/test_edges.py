"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns, and crowded groups."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginlens.llm import bpe, embed_dedup, langid, line_dedup, lm, mixture, pii, quality, resemblance, simhash, warc
from marginlens.llm.components import components
from marginlens.llm.queries import VOCABULARY

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [(1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", None), (4, LONG, "en", "s"), (4, LONG, "en", "s"),
        (None, "a b c", "en", "t"), (5, "  \n\t ", "de", "t"), (6, "A B C", "de", "t")]


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_simhash_edges(docs_frame):
    found = simhash.near_duplicates(docs_frame(*ROWS))
    by_id = {(r.doc_id, r.component_id) for r in found.collect()}
    assert by_id == {(1, 1), (2, 2), (3, 2), (4, 4), (None, 1), (5, 2), (6, 1)} and found.count() == len(ROWS)
    kept = simhash.first_of_each(docs_frame(*ROWS))
    assert rows(kept, "doc_id") == Counter([(1,), (2,), (4,), (None,)]) and kept.columns == docs_frame(*ROWS).columns
    assert simhash.near_duplicates(docs_frame(*ROWS).limit(0)).count() == 0


def test_unlike_texts_of_one_id_and_copies_without_id(docs_frame):
    one, other, third = ("\n".join(f"{tag}{i} " for i in range(60)) for tag in "xyz")
    docs = docs_frame((7, one), (7, other), (7, one), (8, one), (None, third), (None, third), (None, "a b c"), (None, one), (None, "A B C"))
    kept = simhash.first_of_each(docs)
    ids = Counter((r.doc_id, r.text.lower()) for r in kept.collect())
    assert ids == Counter([(7, one), (7, other), (None, third), (None, "a b c"), (None, one)]) and kept.columns == docs.columns


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("crowded", [16, 2])
def test_similar_texts_are_linked_and_others_are_not(docs_frame, monkeypatch, crowded):
    monkeypatch.setattr(resemblance, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    texts = {}
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(200)]
        texts[100 * group] = " ".join(base)
        for copy in range(1, 13):
            words = list(base)
            for at in rng.choice(200, (1, 3, 12)[copy % 3], replace=False):  # 12 words of 200 leave a similarity of about 0.6
                words[at] = f"c{group}x{copy}y{at}"
            texts[100 * group + copy] = " ".join(words)
    odd = [(900, None), (901, ""), (902, "g0w1 g0w2"), (903, "G0W1  g0w2"), (0, texts[0])]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_frame(*texts.items(), *odd), 5, 0.8).collect()}
    root = {d: d for d in texts}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    for _ in range(4):
        for a in texts:
            for b in texts:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {d: found[d] for d in texts} == root and 4 < len(set(root.values())) < len(texts)
    assert (found[900], found[901], found[902], found[903]) == (900, 900, 902, 902)
    assert simhash.near_duplicates(docs_frame((1, "a")).limit(0), 5, 0.8).count() == 0


def near_copies(count, edits, seed):
    """Copies of one text of 200 words, each with up to ``edits`` words changed, in no order."""
    rng = np.random.default_rng(seed)
    for copy in range(count):
        words = [f"e{edits}w{i}" for i in range(200)]
        for at in rng.choice(200, rng.integers(1, edits + 1), replace=False):
            words[at] = f"e{edits}c{copy}y{at}"
        yield " ".join(words)


def test_crowded_bands_connect_all_that_pairs_connect(docs_frame, monkeypatch):
    monkeypatch.setattr(resemblance, "CHUNK", 90, raising=False)
    texts = {1000 * edits + i: t for edits in (4, 8, 12) for i, t in enumerate(near_copies(400, edits, 11))}
    sets, prints = {d: shingle_set(t) for d, t in texts.items()}, {d: simhash.fingerprint(t.encode(), 5) for d, t in texts.items()}
    alike = [(a, b) for a in texts for b in range(a // 1000 * 1000, a)
             if len(common := sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(common))
             or ((prints[a] ^ prints[b]) % 2**64).bit_count() <= simhash.MAX_BITS]
    root, before = {d: d for d in texts}, None
    while root != before:
        before = dict(root)
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_frame(*texts.items()), 5, 0.8).collect()}
    parts = {e: (len({c for d, c in found.items() if d // 1000 == e}), len({c for d, c in root.items() if d // 1000 == e})) for e in (4, 8, 12)}
    assert found == root, f"components by edits, found and expected: {parts}"


def test_crowded_cells_link_like_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 3)
    rng = np.random.default_rng(1)
    centres = rng.integers(-(2**62), 2**62, 6)
    prints = sorted({int(c ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 60, k))) for c in centres for k in (1, 1, 2, 2, 3, 4) * 12})
    linked = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    found = {r.node: r.root for r in components(linked).collect()}
    root = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2 or ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[p]] == root[p] for p in prints):
            break
    assert {p: found.get(p, p) for p in prints} == root


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 50), (2, 50), (50, 3)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in (1, 2, 3, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_edges(docs_frame):
    found = mixture.mix(docs_frame(*ROWS)).collect()
    assert len(found) == len(ROWS) and sum(r.taken for r in found) == pytest.approx(1.5 * sum(r["size"] for r in found), abs=16)
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    assert mixture.mix(docs_frame(*ROWS).limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixture.mix(docs_frame((1, None), (2, ""))).collect())


def test_apportionment_equals_listing_all_quotients(spark):
    rng = np.random.default_rng(3)
    for seats in (0, 1, 7, 1000):
        votes = [0, 0, 1, 1, 5, *rng.integers(0, 400, 12).tolist()]
        parties = spark.createDataFrame([(1, p, v, seats) for p, v in enumerate(votes)], "e int, p int, v long, n long")
        found = {r.p: r.quota for r in mixture.sainte_lague(parties, ["e"], "p", "v", "n").collect()}
        best = sorted(((-v / (2 * k - 1), p, k) for p, v in enumerate(votes) if v for k in range(1, seats + 1)))[:seats]
        assert found == {p: sum(q == p for _, q, _ in best) for p in range(len(votes))}


def test_mix_of_many_shards_and_whole_documents(docs_frame, monkeypatch):
    monkeypatch.setattr(mixture, "SHARD_WORDS", 100)
    docs = docs_frame(*[(i, "w " * (i % 30), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(300)])
    found = mixture.mix(docs).collect()
    for source in ("hot", "s0", "s1", "s2", "s3"):
        own = [r for r in found if source == ("hot" if r.doc_id % 3 else f"s{r.doc_id % 4}")]
        assert abs(sum(r.taken for r in own) - own[0].target) < 4 * (own[0].source_size // 100 + 2)
    copies = Counter(r.doc_id for r in mixture.mixed(docs).collect())
    assert copies == {r.doc_id: n for r in found if r["size"] and (n := int(r.taken / r["size"] + 0.5))}


def passage(tag, words=60):
    return " ".join(f"{tag}{i}" for i in range(words))


def test_line_dedup_edges(docs_frame):
    p, q = passage("p"), "\n".join(passage(f"q{k}-", 20) for k in range(4))
    docs = docs_frame((1, f"x\n{p}\ny"), (2, f"{p}"), (3, f"z\n\n{q}\n{p}\n"), (4, f"{q}\nend"), (5, "x\ny"), (6, None), (7, ""),
                      (8, f"{q}\nmid\n{q}"), (2, p), (None, p))
    found = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.without_repeats(docs).collect()}
    assert found == {(1, 3, 0, f"x\n{p}\ny"), (2, 1, 1, ""), (3, 8, 1, f"z\n\n{q}\n"), (4, 5, 4, "end"), (5, 2, 0, "x\ny"),
                     (6, 0, 0, None), (7, 1, 0, ""), (8, 9, 8, "mid"), (None, 1, 1, "")}
    assert line_dedup.without_repeats(docs).count() == 10 and line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_line_dedup_of_a_passage_that_overlaps_itself(docs_frame):
    head, a, b = (passage(tag, 10) for tag in ("h", "a", "b"))
    found = line_dedup.without_repeats(docs_frame((1, "\n".join([head, *[a, b] * 5])))).first()
    assert (found.n_lines, found.n_removed, found.text) == (11, 8, f"{head}\n{a}\n{b}")


def test_language_edges(docs_frame):
    docs = docs_frame(*ROWS, *[(i, "the cat and the hat", "en") for i in range(10, 20)], *[(i, "der Hund und das Haus", "de") for i in range(20, 30)])
    found = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert found[2].lang_pred == found[3].lang_pred == found[5].lang_pred == "und" and found[2].score == 0
    assert {found[i].lang_pred for i in range(10, 20)} == {"en"} and {found[i].lang_pred for i in range(20, 30)} == {"de"}
    nothing = docs_frame((1, "words")).limit(0)
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    assert langid.identify(docs_frame((1, "words")), langid.fit(nothing)).first().lang_pred == "und"


def test_every_row_is_accepted_by_its_own_text(docs_frame):
    known = [(i, "the cat and the hat", "en") for i in range(10, 20)]
    odd = [(None, "the cat and the hat"), (None, "\u4f60\u597d \u4e16\u754c"), (None, None), (10, "\u4f60\u597d \u4e16\u754c"), (10, "")]
    docs = docs_frame(*known, *odd)
    kept = langid.accepted(docs)
    assert rows(kept, "doc_id", "text") == Counter([*[(i, t) for i, t, _ in known], (None, "the cat and the hat")])
    assert kept.schema == docs.schema and langid.accepted(docs.limit(0)).count() == 0


def test_encoding_edges(docs_frame):
    found = {r.doc_id: r for r in bpe.round_trip(docs_frame(*ROWS, (9, "<|endoftext|>x"), (10, "\x1c é")), VOCABULARY).collect()}
    assert found[2].ids == found[3].ids == [] and found[2].decoded == ""
    assert found[4].decoded == LONG and found[9].ids[0] == 50256 and found[10].decoded == "\x1c é"
    assert bpe.round_trip(docs_frame(*ROWS).limit(0), VOCABULARY).count() == 0


def test_long_words_are_encoded_and_not_kept():
    own = bpe.Codec(open(VOCABULARY, encoding="utf-8").read())
    text = "short " + "x" * 100_000 + " " + "q" * (bpe.KEPT_LENGTH + 5)
    assert own.decode(own.encode(text)) == text and max(map(len, own.words)) <= bpe.KEPT_LENGTH


def test_quality_edges(spark, docs_frame):
    labels = spark.createDataFrame([(1, 1), (None, 1), (1, 1), (6, None), (99, 0)], "doc_id long, quality int")
    found = rows(quality.judged(docs_frame(*ROWS), labels), "doc_id", "n_words", "base_failed", "kept")
    assert found == Counter([(1, 3, True, False), (2, 0, True, False), (3, 0, True, False), *[(4, 60_000, True, False)] * 2,
                             (None, 3, True, False), (5, 0, True, False), (6, 3, True, False)])
    assert quality.judged(docs_frame(*ROWS).limit(0), labels.limit(0)).count() == 0


def test_certified_steps_keep_the_risk():
    exact = sum(_binomial(200, i, quality.RISK) for i in range(3))
    assert quality.binomial_tail(2, 200, quality.RISK) == pytest.approx(exact)
    assert quality.certified(50, [0, 0], 6) == 0 and quality.certified(100_000, [0, 10, 6_000, 0], 6) == 2
    assert quality.certified(0, [0], 6) == 0


def _binomial(n, k, p):
    import math

    return math.comb(n, k) * p**k * (1 - p) ** (n - k)


def test_embedding_edges(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 4)
    monkeypatch.setattr(embed_dedup, "LEAF", 4)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    near = [(i, (base + 0.01 * rng.standard_normal(8)).tolist(), 1) for i in range(20, 50)]
    odd = [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [1.0, None] * 4, 1), (5, [float("nan")] * 8, 1), (6, base.tolist(), None),
           (None, base.tolist(), 1), (7, base.tolist(), 2), (8, base.tolist(), 2), (9, [1e300] * 8, 3), (10, [1e300] * 8, 3), (11, [1.0] * 7, 3)]
    vectors = spark.createDataFrame([(*r, "clash") for r in near + odd], "vec_id long, embedding array<double>, label int, id string")
    found = {r.vec_id: tuple(r)[1:] for r in embed_dedup.near_duplicates(vectors).collect()}
    assert all(found[i] == (29, 20, i == 20) for i in range(20, 50))
    assert all(found[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 11)) and found[None] == (0, None, True)
    assert found[7] == (1, 7, True) and found[8] == (1, 7, False) and found[9] == (1, 9, True) and found[10] == (1, 9, False)
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("kind, same, other", [("double", 1.2, 1.7), ("string", "a", "b"), ("decimal(4,2)", "1.20", "1.70")])
def test_labels_are_compared_as_they_are(spark, kind, same, other):
    vectors = spark.createDataFrame([(i, [1.0, 2.0], label if label is None else str(label)) for i, label in enumerate([same, same, other, other, None])], "vec_id long, embedding array<double>, label string")
    found = embed_dedup.near_duplicates(vectors.withColumn("label", F.col("label").cast(kind)))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4)}


def test_language_model_edges(docs_frame):
    docs = docs_frame(*ROWS)
    found = {r.doc_id: r for r in lm.score(docs, lm.fit(docs)).collect()}
    assert found[2].n_tokens == found[3].n_tokens == found[5].n_tokens == 1 and all(r.score <= 0 for r in found.values())
    nothing = docs.limit(0)
    assert lm.score(nothing, lm.fit(nothing)).count() == 0
    assert lm.score(docs_frame((1, "a b")), lm.fit(nothing)).first().n_known == 0


def test_personal_data_edges(docs_frame):
    found = {r.doc_id: r.spans for r in pii.find(docs_frame(*ROWS, (9, "x@y.zz"))).collect()}
    assert found[2] == found[3] == found[4] == [] and [tuple(s) for s in found[9]] == [("email", 0, 6, 1.0)]
    assert pii.find(docs_frame(*ROWS).limit(0)).count() == 0


def test_accounts_end_before_words_that_follow():
    account, second = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    assert pii.spans(f"{account} BIC DEUTDEFF") == [("iban", 0, 27)] and pii.spans(f"{account}") == [("iban", 0, 27)]
    assert pii.spans(f"{account} {second} BIC") == [("iban", 0, 27), ("iban", 28, 55)]
    assert pii.spans("GB83 WEST 1234 5698 7654 32 BIC DEUTDEFF") == []


def test_archive_edges(spark):
    pages = spark.createDataFrame(
        [(5, "u a", "<a>", 1), (3, "v", "<a>", 1), (9, None, None, 1), (2, "w", "", 1), (7, "z", "<a>", 1), (7, "z", "<a>", 1),
         (None, "k", "<a>", 1), (1, "l", "\r\n\r\nWARC/1.1\nfiledesc://\n", 1)], "page_id long, url string, html string, record int")
    found = rows(warc.archived(pages), "page_id", "record_type", "refers_to")
    assert found == Counter([(1, "response", None), (2, "response", None), (3, "response", None), (5, "revisit", 3), (7, "revisit", 3),
                             (7, "revisit", 3), (9, "revisit", 2), (None, "revisit", 3)])
    assert {r.page_id: r.payload for r in warc.archived(pages, payloads=True).collect()}[1] == bytearray(b"\r\n\r\nWARC/1.1\nfiledesc://\n")
    assert warc.archived(pages.limit(0)).count() == 0


def test_pipeline_stages_do_their_work(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language ID"](spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    cleaned = steps["line dedup"](spark, kept, "")
    assert cleaned.columns == docs.columns and cleaned.filter("n_chars <> length(text)").count() == 0
    single = steps["SimHash near-dedup"](spark, cleaned, "")
    assert single.columns == docs.columns and single.count() == single.select("doc_id").distinct().count()
    assert single.count() == simhash.near_duplicates(cleaned).select("component_id").distinct().count()
    mixed = steps["source mixing"](spark, single, "")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert all(r.decoded == texts[r.doc_id] and len(r.ids) > 0 for r in result.collect()) and result.count() == mixed.count()
