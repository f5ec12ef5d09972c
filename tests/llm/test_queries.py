"""The text queries over the smallest tables: SQL where there is some, brute force elsewhere."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from marginlens.llm import lm, pii
from marginlens.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS FROM '{SMALL}/{table}.parquet'")
    reply = connection.execute(ORACLE_SQL[name])
    columns = [c[0] for c in reply.description]
    result = QUERIES[name](spark, SMALL)
    assert sorted(result.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in result.collect()) == Counter(reply.fetchall())


def simhash(text, words=3):
    tokens = lowered(text)
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_simhash_equals_brute_force(spark, documents):
    prints = {d: simhash(t) for d, t, _ in documents}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    root = smallest_reachable(prints, linked)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op1_simhash_near_dedup")}
    assert found == {d: (f"{prints[d]:016x}", root[d]) for d in prints}


def test_embeddings_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SMALL}/embeddings.parquet'").fetchall()
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e, _ in rows}
    linked = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.98]
    links, root = Counter(i for pair in linked for i in pair), smallest_reachable(unit, linked)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, "op3_embedding_near_dedup")}
    assert found == {i: (links[i], root[i], root[i] == i) for i in unit}


def test_quality_counts_equal_brute_force(spark, documents):
    def brute(text):
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        marked = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)

    found = {r.doc_id: r for r in run(spark, "op4_quality_rules")}
    for d, t, _ in documents:
        n = brute(t or "")
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert tuple(found[d])[1:7] == (*n, failed)
        assert not (failed and found[d].kept)


def test_encoding_equals_the_tokenizers_library(spark, documents):
    library, found = Tokenizer.from_file(VOCABULARY), {r.doc_id: r for r in run(spark, "op5_bpe_round_trip")}
    for d, t, _ in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(found[d]) == (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                   hashlib.sha256(decoded.encode()).hexdigest())


def base_spans(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.findall("[0-9]", s)) <= 19 and luhn(s)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.findall("[0-9]", s)) <= 15),
    }

    def luhn(s):
        digits = [int(c) for c in re.findall("[0-9]", s)][::-1]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0

    found = [(m.start(), at, kind, m.end()) for at, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_personal_data_equals_the_plain_patterns(spark, documents):
    found = {r.doc_id: r for r in run(spark, "op6_personal_data")}
    for d, t, _ in documents:
        spans = base_spans(t or "")
        r = found[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(","))


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f a@b@c.d.e x@y ..@..", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 1.2.3", "4111 1111-1111 1111 1", "+1 (23) 456-7890.",
    "9" * 50_000, "a" * 50_000 + "@" * 50, "é+49 30 1234567 ñ@x.de",
])
def test_patterns_on_odd_texts(text):
    own = [s for s in pii.spans(text) if s[0] in pii.BASE]
    assert own == (base_spans(text) if len(text) < 1000 else [])


def test_added_kinds_need_checksum_or_context():
    kinds = lambda text: [k for k, _, _ in pii.spans(text) if k not in pii.BASE]
    assert kinds("to DE89 3704 0044 0532 0130 00 by") == ["iban"] and kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("her SSN is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("password=b7db7aa4a5fcc783") == ["secret"]


@pytest.mark.parametrize("text, kinds", [
    ("the secret: something in prose", []), ("The password: Confidential stays", []), ("secret=hunter2hunter2", ["secret"]),
    ('token = "04dbebab91ab85687d33"', ["secret"]), ("API_KEY: 'a1b2c3d4e5'", ["secret"]), ("token : short1", []),
    ("x@mail6.example.com token = abc12345678", ["secret"]), ("mytoken = a1b2c3d4e5", []),
    ("login credentials, password: correcthorse", ["secret"]), ("for example password=abc12345678, a placeholder", []),
    ("her social security number is 123-45-6789", ["ssn"]), ("her SSN is 000-45-6789", []), ("her SSN is 666-45-6789", []),
    ("her SSN is 912-45-6789", []), ("her SSN is 123-00-6789", []), ("her SSN is 123-45-0000", []), ("invoice id 123-45-6789", []),
    ("DE89 3704 0044 0532 0130 00", ["iban"]), ("DE89370400440532013000", ["iban"]), ("DE893704004405320130001", []),
    ("FR1420041010050500013M02606", ["iban"]), ("FR14 2004 1010 0505 0001 3M02", []), ("ZZ89 3704 0044 0532 0130 00", []),
    ("NO9386011117947 NO9386011117948", ["iban"]), ("DE89 3704 0044 0532 0130 0", []),
])
def test_decoys_of_the_added_kinds(text, kinds):
    found = pii.scored(text)
    assert [k for k, *_ in found if k not in pii.BASE] == kinds
    assert all(pii.NEEDED <= score <= 1 for *_, score in found)


def test_archives_keep_every_page(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall()
    first: dict[str, int] = {}
    for i, h in sorted(rows):
        first.setdefault(h or "", i)
    found = {r.page_id: tuple(r)[1:] for r in run(spark, "op7_warc_round_trip")}
    assert found == {
        i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
            "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
        for i, h in rows}


def test_languages_of_held_out_documents(spark, documents):
    found = {r.doc_id: r for r in run(spark, "op8_language_id")}
    held = [(found[d].lang_pred, lang) for d, _, lang in documents if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in documents)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_model_equals_brute_force(spark, documents):
    tokens = {d: [*lowered(t), None] for d, t, _ in documents}
    train = [w for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    words = Counter(t for w in train for t in w)
    pairs = Counter(p for w in train for p in zip(["<s>", *w[:-1]], w))
    total, size = sum(words.values()), len(words)
    mass, of_context, follows = defaultdict(float), Counter(), Counter(w for _, w in pairs)
    d2 = lm.discounts(*[sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    d1 = lm.discounts(*[sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)])
    for (v, _), c in pairs.items():
        mass[v] += d2[min(c, 3) - 1]
        of_context[v] += c
    spare = sum(d1[min(c, 3) - 1] for c in follows.values()) / len(pairs)

    def chance(v, w):
        lower = (follows[w] - d1[min(follows[w], 3) - 1] if follows[w] else 0) / len(pairs) + spare / (size + 1)
        if v not in of_context:
            return lower
        return (pairs[v, w] - d2[min(pairs[v, w], 3) - 1] if pairs[v, w] else 0) / of_context[v] + mass[v] / of_context[v] * lower

    assert sum(chance("the", w) for w in words) + spare / (size + 1) * mass["the"] / of_context["the"] == pytest.approx(1)
    for r in run(spark, "op9_lm_score"):
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(t in words for t in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((words[t] + 1) / (total + size + 1)) for t in w))
        assert r.score == pytest.approx(sum(math.log10(chance(v, x)) for v, x in zip(["<s>", *w[:-1]], w)), rel=1e-6)
