"""Queries over whole small tables against the libraries and plain re-computation, and edge cases by value."""
import base64
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from vicinal.llm import bpe, components, embedding_dedup, language, packing, pii, quality_model, quality_rules, queries, simhash, token_counts, toxicity
from vicinal.llm.common import Remembering, crc_mod, hashed_share

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tiktoken_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_shares_of_any_size(spark):
    rows = spark.range(200_000)
    assert hashed_share(rows, "id", 1e-30).count() == 0 and hashed_share(rows, "id", 1.0).count() == 200_000
    assert 150 < hashed_share(rows, "id", 1e-3).count() < 250
    plan = hashed_share(rows, "id", 1e-9)._jdf.queryExecution().toString()
    assert str(int(1e-9 * (1 << 64)) - (1 << 63)) in plan  # a share under one in a million still is a range of hashes
    from pyspark.sql import functions as F

    by_column = hashed_share(rows.withColumn("s", F.when(F.col("id") % 2 == 0, 1.0).otherwise(1e-3)), "id", F.col("s"))
    assert by_column.where("id % 2 = 0").count() == 100_000 and 60 < by_column.where("id % 2 = 1").count() < 145


def test_caches_stay_small_and_right():
    asked = []
    cache = Remembering(lambda x: asked.append(x) or len(x), base={"base": 99}, size=20_000)
    for k in range(5000):
        assert cache["often"] == 5 and cache["base"] == 99 and cache[f"word {k}"] == len(f"word {k}")
        assert sum(sys.getsizeof(x) + Remembering.ENTRY for x in (*cache, *cache.older)) < 25_000
    assert asked.count("often") == 1 and "base" not in asked
    none = Remembering(lambda x: asked.append(x))
    asked.clear()
    assert none["a"] is none["a"] is None and asked == ["a"]


def test_token_counts_whole_table(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op1_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_bpe_whole_table(spark, texts, tiktoken_encoding):
    got = queries.op8_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tiktoken_encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_joins_equal_the_library(tiktoken_encoding):
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'", "'re", "'s", "1", "é", "!", "日本", "x" * 30, "zq", "\t", "ing", "12", " the"]
    codecs = [bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), leaf_chars=n, leaf_bytes=b) for n, b in ((5, 3), (2, 2), (9, 5), (2048, 1024))]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in [*texts, "x" * 9000, "ab" * 4000, " " * 5000, "the" * 3000 + " " + "é" * 2500]:
        want = np.asarray(tiktoken_encoding.encode_ordinary(t), "<u4").tobytes()
        for codec in codecs[(len(t) > 2000) * 3 :]:
            assert codec.encode(t) == want and codec.decode(want) == t.encode()


def check_pieces(rows, texts):
    """Pieces against the library's ids; sequences without gaps, full or of a power of two."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.asarray([*library.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes() for k, t in texts.items()}
    at, sequences = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own) // 4
        assert r["ids_crc32"] == zlib.crc32(own[4 * r["start"] : 4 * (r["start"] + r["length"])])
        at[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(at[k] == len(x) // 4 for k, x in ids.items())
    for pieces in sequences.values():
        total = 0
        for offset, n in sorted(pieces):
            assert offset == total
            total += n
        assert total == packing.CAPACITY or total < packing.CAPACITY and total & (total - 1) == 0


def test_packing_whole_table(spark, texts):
    check_pieces(queries.op10_packing(spark, SF).collect(), texts)


def test_quality_model_by_plain_sums(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights, cuts = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod(5) != 4)
    assert list(cuts) == sorted(cuts)
    for r in quality_model.classify(docs.select("doc_id", "text"), (weights, cuts)).collect():
        tokens = (r["text"] or "").split()
        total = weights[0]
        if tokens:
            means = [weights[1] * sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)), weights[2] * (len(tokens) - len(set(tokens)))]
            means += [weights[3 + zlib.crc32(x.lower().encode()) % quality_model.BUCKETS] + weights[3 + zlib.crc32(b"\0" + quality_model.form(x).encode()) % quality_model.BUCKETS] for x in tokens]
            total += sum(means) / len(tokens)
        above = 1 / (1 + np.exp(cuts - total))
        assert r["expected_grade"] == pytest.approx(above.sum(), abs=1e-9) and r["tail"] == pytest.approx(above[0], abs=1e-9) and r["kept"] == (r["tail"] >= 0.5)


class PlainPpm:
    """Prediction by partial matching, straight from its definition."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            data = language.BEFORE + t
            for i in range(language.ORDER, len(data)):
                for order in range(language.ORDER + 1):
                    own = self.n.setdefault(data[i - order : i], {})
                    own[data[i]] = own.get(data[i], 0) + 1

    def probabilities(self, context):
        p = np.full(256, 1 / 256)
        for order in range(language.ORDER + 1):
            if own := self.n.get(context[len(context) - order :]):
                total, kinds = sum(own.values()), len(own)
                escape = 0 if kinds == 256 else kinds / (total + kinds)
                rest = p.copy()
                rest[list(own)] = 0
                p = escape * rest / (rest.sum() or 1)
                for b, n in own.items():
                    p[b] = (1 - escape) * n / total
        return p

    def bits(self, text):
        data = language.BEFORE + text
        return sum(-np.log2(self.probabilities(data[i - language.ORDER : i])[data[i]]) for i in range(language.ORDER, len(data)))


def test_language_lengths_by_definition(spark):
    rows = [(1, "the cat sat on the mat, the cat", "en"), (2, "hello é the", "en"), (3, "der hund und die katze und", "de"), (4, "und das " * 3, "de"), (5, "".join(map(chr, range(256))), "xx"), (6, "left out", None), (7, None, "en")]
    trees = language.fit(spark.createDataFrame(rows, DOCS + ", lang string"), crc_mod(1) == 0)
    assert trees.languages == ["de", "en", "xx"]
    plain = [PlainPpm([t.encode() for _, t, lang in rows if lang == name and t]) for name in trees.languages]
    for p in plain:
        assert all(p.probabilities(c).sum() == pytest.approx(1) for c in (b"the ", b"und ", b"\n\n\n\n", b"zzzz"))
    rng = random.Random(1)
    asked = [b"the katze sat", b"zz\x00\xff", b"", bytes(rng.randrange(256) for _ in range(200)), b"hello the der hund " * 5]
    want = np.array([[p.bits(t) for p in plain] for t in asked])
    assert trees.lengths(asked) == pytest.approx(want, rel=1e-5, abs=1e-3)
    language_slice, language.SLICE = language.SLICE, 7
    try:
        assert trees.lengths(asked) == pytest.approx(want, rel=1e-5, abs=1e-3)
    finally:
        language.SLICE = language_slice
    odd = spark.createDataFrame([(1, "the cat", "x"), (1, "the cat", "x"), (2, "123 !", "y"), (3, None, "z")], DOCS + ", lang_pred string").withColumnRenamed("lang_pred", "score")
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.identify(odd, trees).collect()), key=str)
    assert got == [(1, "en", True), (1, "en", True), (2, "und", False), (3, "und", False)]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def plain_find(word, terms):
    """The best term by comparing all of them: exact, a stem's exact beginning, or one edit for long terms (a stem's within as many characters)."""
    found = []
    for number, (term, stem) in enumerate(terms):
        if word == term or stem and word.startswith(term):
            found.append((0, number))
        elif len(term) >= toxicity.LONG and (one_edit(word, term) or stem and one_edit(word[: len(term)], term)):
            found.append((1, number))
    return min(found)[::-1] if found else None


def test_toxicity_whole_table_by_comparing_all_terms(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    terms, weights = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod(3) != 1)
    assert terms
    scorer = toxicity.Scorer(terms, weights)
    scorer.found = Remembering(lambda w: plain_find(w, terms))
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert got[k]["score"] == pytest.approx(scorer.score(t), abs=1e-12) and got[k]["predicted"] == (got[k]["score"] >= 0.7) and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)


FIELD_TEXTS = [
    "call +1 (212) 555-0199 now, order 98765432109 has 7 items for 17.50", "mail bob7@example.org about 4711 and 2024-05-06", "card 4111111111111111 paid 1234567890123456 on 3 days",
    "host 10.20.30.40 port 8080 version 1.2.3.4567 id 55501998877", "+44 20 7946 0958 or room 204, bill 20794609",
]


def test_field_adds_what_repeats_support(spark):
    weights = pii.fit(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"))
    field, alone = pii.Field(weights), pii.Field(weights)
    alone.pair = [alone.pair[0], 0 * alone.pair[1], 0 * alone.pair[2]]
    text = "call +1 (212) 555-0199 today. Again 12125550199, or (212) 555-0199; or 12125550198. Not 98765432100, nor 7."
    base, spans = field.spans(text)
    added = {text[a:b] for kind, a, b in set(spans) - set(base) if pii.KINDS[kind] == "phone"}
    # An equal number, one that ends alike, and one with an edit; nothing else.
    assert len(base) == 1 and added == {"12125550199", "(212) 555-0199", "12125550198"} and len(spans) == 4
    assert alone.spans(text) == (base, base)
    assert field.spans("12125550199 and 12125550199 and 98765432100") == ([], [])
    many = "12125550199 x " * 10_000 + "+1 (212) 555-0199 x " + "12125550199 x " * 10_000
    assert len(field.spans(many)[1]) == 20_001


def test_field_keeps_base_spans(spark):
    weights = pii.fit(spark.createDataFrame(list(enumerate(FIELD_TEXTS)), DOCS))
    for text in FIELD_TEXTS:
        base, spans = pii.Field(weights).spans(text)
        assert base == pii.base_spans(text) and set(base) <= set(spans)
    assert not pii.fit(spark.createDataFrame([], DOCS)).any()


def test_embeddings_edge_cases(spark):
    schema = "vec_id long, embedding array<double>, label string, n long, id string, part string"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    near, far = [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, near, "a"), (1, near, "a"), (2, [2.0, 0.2, 0.0], "a"), (3, near, "b"), (4, far, "a"), (4, near, "a"), (5, [1e200, 1e199, 0.0], "a"), (6, [1.0, 0.1], "a")]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(*r, 9, "x", "y") for r in rows], schema)).collect())
    # Linked are 1, 2, 5 and the second vector of 4; a repeated row counts once.
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (4, 3, 1, False), (5, 3, 1, False), (6, 0, 6, True)]


def test_trees_grow_with_the_table():
    few, many = (int(embedding_dedup.trees_of(np.array([k]), 0.98)[0]) for k in (3, 20))
    p = embedding_dedup.agreement(0.98)
    assert (1 - p**3) ** few <= embedding_dedup.MISS and (1 - p**20) ** many <= embedding_dedup.MISS and many > 4 * few


def test_pipeline_whole_run(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in queries.op9_toxicity(spark, SF).collect()}
    kept = {r["doc_id"]: r["kept"] for r in queries.op7_quality_rules(spark, SF).collect()}
    left = sorted(k for k in texts if not scores[k] and kept[k])
    prints = np.array([simhash.fingerprint(texts[k]) for k in left], np.uint64)
    u, v = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.BUDGET)
    first = [k for k, root in enumerate(components.local_labels(len(left), u, v)) if k == root]
    clean = {}
    for k in first:
        text, out, done = texts[left[k]], [], 0
        for kind, a, b in sorted(pii.base_spans(text), key=lambda s: (s[1], -s[2], s[0])):
            if a >= done:
                out += [text[done:a], f"[{pii.KINDS[kind].upper()}]"]
            done = max(done, b)
        clean[left[k]] = "".join([*out, text[done:]])
    weights = pii.fit(docs.where(f"doc_id in ({', '.join(str(left[k]) for k in first)})"))
    more = {k: pii.Field(weights).spans(texts[k]) for k in clean}
    assert all(base == spans for base, spans in more.values())  # nothing but base spans here, so the plain redaction is the whole
    check_pieces(corpus_pipeline.run(spark, SF).collect(), clean)


def test_frequent_table_survives_packing():
    assert token_counts.unpack_table(token_counts.pack_table({"a": 1, "bc": 2})) == {"a": 1, "bc": 2}


def test_equal_hashes_of_other_words_are_no_repeat(spark, monkeypatch):
    text = "a b c d e f a b c g " + " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text)], DOCS)
    assert quality_rules.quality_rules(docs).first()["n_repeat_words"] == 6
    sql = quality_rules.verdict_sql
    # With a hash that is the same for all windows only neighbours with equal words are repeats, and here there are none.
    monkeypatch.setattr(quality_rules, "verdict_sql", lambda: sql().replace("xxhash64(q_words[i], q_words[i + 1], q_words[i + 2])", "7L"))
    assert quality_rules.quality_rules(docs).first()["n_repeat_words"] == 0
