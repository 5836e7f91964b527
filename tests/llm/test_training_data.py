"""Training-data operators: brute force, round trips, held-out accuracy, and odd inputs."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from vicinal.llm import bpe, components, embedding_dedup, language, packing, pii, quality_model, quality_rules, queries, simhash, token_counts, toxicity
from vicinal.llm.common import crc_mod

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id"), (5, "word " * 3000), (6, "\x00\t \n"), (7, "x" * 50_000), (8, "é日本 😀")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns whose names the operators use themselves.
    return spark.createDataFrame([(*r, 1.5, "x", True) for r in ODD], SCHEMA + ", score double, _text string, kept boolean")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 0), (1, None, 1), (3, 0, None), (5, 7, 7)], "doc_id long, quality int, toxic int")


def test_odd_inputs(spark, odd, none, labels):
    lang = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    for docs, n in ((odd, len(ODD)), (none, 0)):
        assert token_counts.token_counts(docs).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert quality_model.classify(docs, quality_model.fit(docs, labels)).count() == n
        assert pii.find(docs, pii.fit(docs)).count() == n
        assert pii.redact(docs, pii.fit(docs)).columns == docs.columns
        assert quality_rules.quality_rules(docs).count() == n
        assert bpe.round_trip(docs).count() == n
        assert bpe.decode(bpe.encode(docs)).count() == n
        terms, weights = toxicity.fit(docs, labels, crc_mod(3) != 1)
        assert toxicity.toxicity(docs, terms, weights).where("predicted = 0 and score is not null").count() == n
        assert packing.pack(docs).select("doc_id").distinct().count() == len({i for i, _ in ODD}) * bool(n)
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(lang, crc_mod(4) != 2)).collect()} == {"und"}
    got = {r["doc_id"]: r for r in token_counts.token_counts(odd).collect()}
    assert got[1]["n_tokens"] == got[2]["n_bytes"] == 0


def test_pipeline_stages_keep_columns(spark, labels, tmp_path):
    docs = spark.createDataFrame([(*r, "en", "s", None, 9) for r in ODD], SCHEMA + ", lang string, source string, n_chars long, extra int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.count()
        stage(spark, docs.limit(0), str(tmp_path)).count()


def test_pipeline_drops_and_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert 0.5 * len(before) < len(now) <= len(before) and now.keys() <= before.keys(), name
        if name == "pii":
            assert any("[EMAIL]" in t for t in now.values()) and not any(pii.base_spans(t) for t in now.values())
        before = now


def test_pipeline_keeps_one_row_of_each_group(spark):
    def text(k):
        return " ".join(f"w{k}x{j}" for j in range(60))

    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (None, text(1)), (None, text(3)), (None, text(3)), (6, text(4)), (6, text(4)), (None, text(5)), (7, text(6)), (7, text(7))]
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, text(1)), (5, text(2)), (None, text(3)), (6, text(4)), (None, text(5)), (7, text(6)), (7, text(7))], key=str)


def test_counts_and_codes_equal_the_libraries(spark):
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'", "'re", "'s", "1", "é", "!", "日本", "<|endoftext|>", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counting = token_counts.Counting(public_tokenizers.path("byte_bpe_50k.json"), {})
    assert [counting.count(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), leaf_chars=5, leaf_bytes=3)
    whole = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), leaf_chars=1 << 30, leaf_bytes=1 << 30)
    for t in texts:
        assert codec.encode(t) == whole.encode(t) and codec.decode(codec.encode(t)) == t.encode()
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for t in [*texts, "Σίσυφος ΣΑΣ", "é ́", "a\x1cb"]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == words.encode(t, add_special_tokens=False).ids


def test_packing_is_gapless_and_full(spark):
    rng = random.Random(2)
    for _ in range(100):
        lengths = [rng.choice([1, 5, 4096, 4097, rng.randint(1, 12_000)]) for _ in range(rng.randint(1, 40))]
        sequences = {}
        for doc, n in enumerate(lengths):
            at = 0
            for _, start, size, s, offset in sorted(p for p in packing.assign(lengths) if p[0] == doc):
                assert start == at and size > 0
                at += size
                sequences.setdefault(s, []).append((offset, size))
            assert at == n
        for pieces in sequences.values():
            total = 0
            for offset, size in sorted(pieces):
                assert offset == total
                total += size
            assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)


def test_packing_cuts_only_what_has_no_room():
    lengths = np.minimum(np.random.default_rng(12).lognormal(5.5, 1.2, 4000).astype(int) + 1, 4095).tolist()
    capacity = packing.CAPACITY
    used, costs = (np.zeros(-(-sum(lengths) // capacity)) for _ in range(2))
    members, no_room = {}, 0
    for n, doc in sorted(((n, d) for d, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
        room = np.flatnonzero(used + n <= capacity)
        if not len(room):
            no_room += 1
            continue
        s = room[np.argmin(costs[room])]
        used[s], costs[s] = used[s] + n, costs[s] + packing.cost(n)
        members.setdefault(s, set()).add(doc)
    got = {}
    for doc, *_, s, _ in packing.assign(lengths):
        got.setdefault(s, set()).add(doc)
    pieces = [p[0] for p in packing.assign(lengths)]
    # Sequences that the method fills by itself come out as they are; moving the others together cuts one document for each at most.
    full = [m for s, m in members.items() if used[s] == capacity]
    assert len(full) > 50 and all(m in got.values() for m in full)
    assert len(pieces) - len(set(pieces)) <= 2 * no_room + len(got) - len(full)


def test_simhash_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        texts.append(" ".join(words))
        for _ in range(3):
            if words:
                words = list(words)
                words[rng.randrange(len(words))] = "changed"
                texts.append(" ".join(words))
    def one(t):
        w = t.encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fp = np.array([one(t) for t in texts], np.uint64)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    truth = components.local_labels(len(fp), i, j)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for hot in (20_000, 2):  # the second deals every trie by pairs of subtrees
        got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, hot_trie=hot).collect()}
        assert all(got[k]["component_id"] == truth[k] and got[k]["fp"] % (1 << 64) == int(fp[k]) for k in range(len(texts)))


def test_wide_layouts_lose_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for rows in (1, 1 << 30, 1 << 40):
        tables = simhash.layout(rows)
        for v in x[:50]:
            y = int(v)
            for b in rng.choice(64, 4, replace=False):
                y ^= 1 << int(b)
            a = np.array([v, y], np.uint64)
            assert any(np.unique(simhash.permuted(a, t[1:]) >> np.uint64(64 - int(t[0]))).size == 1 for t in tables)


def test_pipeline_finding_one_python_step_in_a_task(spark, monkeypatch):
    """Two Python steps in one task take two workers, which stay and double what an executor's workers hold in later stages."""
    docs = spark.createDataFrame([(k, f"one two three four five six seven {k // 2}") for k in range(40)], SCHEMA)
    plans, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() <= 20
    assert "MapInArrow" in plans[0] and max(part.count("MapInArrow") for part in plans[0].split("Exchange")) == 1


def test_stars_keep_components():
    rng = np.random.default_rng(11)
    e = rng.integers(0, 400, (500, 2))
    batches = [pa.RecordBatch.from_pydict({"u": e[k : k + 50, 0], "v": e[k : k + 50, 1]}) for k in range(0, 500, 50)]
    for rows in (1, 120, 10_000):
        found = np.array([(u, v) for b in components.stars(batches, rows) for u, v in zip(*b.to_pydict().values(), strict=True)])
        assert (components.local_labels(400, found[:, 0], found[:, 1]) == components.local_labels(400, e[:, 0], e[:, 1])).all()
    assert list(components.stars([])) == []


def test_components(spark):
    rng = np.random.default_rng(5)
    e = rng.integers(0, 300, (220, 2))
    truth = components.local_labels(300, e[:, 0], e[:, 1])
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame([tuple(map(int, r)) for r in e], "u long, v long")).collect()}
    assert all(truth[n] == r for n, r in got.items()) and set(got) == {int(x) for a, b in e for x in (a, b) if a != b}


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((240, 16))
    x[200:230] = x[0] + 0.02 * rng.standard_normal((30, 16))
    x[230:235] = x[1]
    rows = [(k, [float(v) for v in np.float32(x[k])], int(k % 2) if k < 200 else 0) for k in range(240)]
    rows += [(240, None, 0), (241, [0.0] * 16, 0), (242, [float("nan")] * 16, 0), (243, [1.0, None] + [0.0] * 14, 0), (244, rows[0][1], None), (None, rows[0][1], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = np.array([r[1] for r in rows[:240]], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:240]])
    near = (y @ y.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    truth = components.local_labels(240, i, j)
    assert len(got) == len(rows)
    for k in range(240):
        assert got[k]["n_links"] == near[k].sum() and got[k]["component_id"] == truth[k]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(240, 245))


def links_by_brute_force(x, threshold=0.98):
    y = np.float64(np.float32(x))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= threshold
    np.fill_diagonal(near, False)
    return near.sum(axis=1), components.local_labels(len(x), *np.nonzero(near))


def embedding_rows(spark, x):
    frame = spark.createDataFrame([(k, [float(v) for v in np.float32(r)], 0) for k, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}


def test_embeddings_link_dense_groups(spark):
    # Two groups of 40 vectors: all pairs are linked, but those inside a group are nearer than those across.
    rng = np.random.default_rng(9)
    first, second = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    centres = [first, 0.985 * first + np.sqrt(1 - 0.985**2) * second]
    x = np.concatenate([c + 0.002 * rng.standard_normal((40, 64)) for c in centres])
    degrees, truth = links_by_brute_force(x)
    assert set(degrees) == {79} and set(truth) == {0}
    assert embedding_rows(spark, x) == {k: (79, 0) for k in range(80)}


def test_embeddings_find_all_single_pairs(spark):
    # One group of 200 vectors has nearly all links; beside it are 2000 pairs just over the threshold.
    rng = np.random.default_rng(11)
    pairs = rng.standard_normal((2000, 64))
    pairs /= np.linalg.norm(pairs, axis=1, keepdims=True)
    aside = rng.standard_normal((2000, 64))
    aside -= (aside * pairs).sum(axis=1, keepdims=True) * pairs
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    near = 0.9805 * pairs + np.sqrt(1 - 0.9805**2) * aside
    x = np.concatenate([pairs, near, pairs[0] + 0.01 * rng.standard_normal((200, 64))])
    degrees, truth = links_by_brute_force(x)
    assert (degrees[1:2000] == 1).all()
    got = embedding_rows(spark, x)
    assert [k for k in range(len(x)) if got[k] != (degrees[k], truth[k])] == []


def test_embeddings_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    x = np.repeat(rng.standard_normal((150, 8)), 4, axis=0) + 0.1 * rng.standard_normal((600, 8))
    degrees, truth = links_by_brute_force(x)
    assert degrees.max() == 3 and degrees.min() == 0
    members = spark.createDataFrame([(k, 0, 1, [float(v) for v in np.float32(r)], k // 40) for k, r in enumerate(x)], "id long, p long, n long, vec array<float>, root long")
    for rows in (7, 64):
        found = embedding_dedup.compare_dense(members, 0.98, rows).collect()
        sums = np.zeros(600, int)
        for r in found:
            sums[r["id"]] += r["linked"]
        assert (sums == degrees).all()
        assert (components.local_labels(600, np.array([r["id"] for r in found]), np.array([r["star"] for r in found])) == truth).all()


def reference_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(7)
    parts = ["a@", "b.c", "1", "23", "4.5.6.7", ".", "@", "+", "-", " ", "(", "4111111111111111", "x", "+1 ", "555-1234", "٣", "0000255"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == reference_spans(t)


def test_field_spreads_labels_by_skip_edges():
    text = "call +1 (212) 555-0199 now. " * 3 + "again 12125550199 and 12125550199."
    weights = pii.fit_field(*(np.array(c) for c in zip(*[(x, y, 1.0) for x, y in pii.training_rows(text)], strict=True)))
    base, spans = pii.Field(weights).spans(text)
    assert set(base) <= set(spans) and len(base) == 3


def test_pii_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_pii(spark, SF).collect():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in reference_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in queries.op5_language(spark, SF).collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert np.mean([docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held]) > 0.95
    found = [r for r in queries.op9_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in marks]
    assert not any(r["predicted"] and not marks[r["doc_id"]]["toxic"] for r in found)
    assert np.mean([r["predicted"] == marks[r["doc_id"]]["toxic"] for r in found]) > 0.9
    graded = [r for r in queries.op3_quality_model(spark, SF).collect() if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["kept"] == (marks[r["doc_id"]]["quality"] == 1) for r in graded]) > 0.9


def test_lexicon_automaton_by_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]
    rng = random.Random(8)
    terms = [("idiot", False), ("loser", False), ("scum", False), ("moron", False)]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        base = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(base) + 1)
            base[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "t"])
        word = "".join(base)
        want = [(d, n) for n, (t, _) in enumerate(terms) if (d := distance(word, t)) == 0 or d == 1 and len(t) >= toxicity.LONG]
        assert lexicon.find(word) == (min(want)[::-1] if want else None), word
    assert toxicity.Lexicon([("lowei", True)]).find("loweischaft") == (0, 0)


def test_quality_rules_on_a_hand_made_text(spark):
    text = "a b c\nx a b c\na b c\n\n" + "z# " * 2
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text)], SCHEMA)).first()
    # Words: a b c x a b c a b c z# z#; the windows "a b c" are three times there.
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (12, 14, 2, 1, 9) and r["base_failed"] and not r["kept"]
