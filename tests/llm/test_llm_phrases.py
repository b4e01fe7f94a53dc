"""Collocations, the conversation trie and toxicity against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from odd import documents, empty, texts
from pyspark.sql import functions as F

from shelfwise.llm import collocations, prefix_trie, queries, toxicity, wordcodes

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# collocations


def brute_phrases(rows, least=10, share=50, limit=2_000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * f[q]}
        ranked = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(4)
    words = ["the", "of", "new", "york", "Ünder", "a\xa0b", "x\x1fy", "city's"]
    rows = []
    for i in range(120):
        body = " ".join(rng.choices(words, [9, 6, 3, 3, 2, 1, 1, 2], k=rng.randint(0, 40)))
        rows.append((rng.choice(["en", "fr", None, "und"]), body.replace("new", "New York city,") if i % 3 else body + "\tnew york.\r\nof the"))
    return rows + [("en", None), ("en", ""), ("fr", " ,;. \n"), ("xx", "a b c"), ("en", "very very very " * 400)]


@pytest.mark.parametrize("sizes", [{}, {"budget": 60, "chunk_words": 300}, {"budget": 8, "chunk_words": 50}])
def test_phrases_equal_counting_them_all(spark, sizes):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, n int, word string").repartition(3)
    found = collocations.collocations(docs, **sizes)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows)


def test_phrases_of_odd_rows_and_of_none(spark):
    rows = [(r["lang"], r["text"]) for r in documents(spark).collect()]
    found = collocations.collocations(documents(spark), least=2, limit=50)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, least=2, limit=50)
    assert collocations.collocations(empty(spark)).count() == 0


def test_a_group_of_prefixes_holds_no_more_suffixes_than_its_budget(spark):
    rows = [("en", " ".join(random.Random(i).choices(["a", "b", "c", "d", "e", "f"], [30, 20, 5, 3, 2, 1], k=200))) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    counted = collocations.code_words(docs, 500).filter("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    groups = collocations._groups(counted, 1_000).collect()
    whole = Counter()
    for r in groups:
        if not r["pieces"]:
            whole[r["group"]] += r["f"]
        else:
            assert r["f"] > 1_000 and r["pieces"] == -(-r["f"] // 1_000)
    assert max(whole.values()) <= 1_000 and sum(r["f"] for r in groups) == 8_000


def test_products_beyond_64_bits_are_exact(spark):
    a, left, right = 9_876_543_211_234, 9_876_543_219_999, 9_876_543_215_555
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score("a", "l", "r")).first()
    assert row[0] == 10**6 * a * a // (left * right)


def test_phrases_equal_sql(spark):
    assert compare(queries.op11_collocations(spark, SF), connect(SF), queries.ORACLES["op11_collocations"]) is None


def test_word_codes():
    table = wordcodes.fold_table(b" \t", b".\n\x0b\x0c\r")
    codes, words = wordcodes.word_codes([b"A b.a", b"", b"\xc3\xa9 .."], table)
    names = [b"<p>", b"<t>", *words.to_pylist()]
    assert [names[c] for c in codes] == [b"<t>", b"a", b"b", b"<p>", b"a", b"<t>", b"<t>", "é".encode(), b"<p>", b"<p>"]


# conversation trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[c].append((t is not None, t or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(its)] for c, its in turns.items()}
    rebuilt = {}
    for c, its in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = turns.get(base, [])[:h] + its[h:]
    members, children = defaultdict(list), Counter()
    for c, its in rebuilt.items():
        for d in range(len(its) + 1):
            members[tuple(its[:d])].append(c)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, its in members.items():
        ends = ",".join(map(str, sorted(c for c in its if len(rebuilt[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(its), len(p), parent, len(its), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(turns):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(turns).collect()), key=repr)


def turn_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        number = rng.choice([c, c, c * 7, -c]) if c % 17 else None
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((number, rng.choice([t, t, t, t, None, 0]), rng.choice(["u", None, "a"]) if t % 4 else "u", rng.choice(["x", "yé", None, ""]) if t else "start"))
    return rows + [(5, 0, "u", "start"), (5, 0, "u", "start")] + [(2_000, i, "u", "deep") for i in range(60)]


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_trie_equals_brute_force(spark):
    rows = turn_rows()
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], TURNS + ", depth int, key string").repartition(4)
    assert trie(turns) == brute_trie(rows)


def test_nodes_of_many_ranges_are_put_together(spark, many_ranges):
    rows = turn_rows(2)
    assert trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)
    # copies of one conversation, some with a turn more, fill several ranges
    rows = [(c, t, "u", "same") for c in range(300) for t in range(2 + (c % 7 == 0))]
    assert trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_the_list_of_a_node_is_cut_into_pieces(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_CHARS", 100)
    assert prefix_trie._pieces(list(range(12))) == ["0,1,2,3,4", ",5,6,7,8,9", ",10,11"]
    rows = [(c, 0, "u", "same") for c in range(400)]
    assert trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_no_conversations(spark):
    assert trie(spark.createDataFrame([], TURNS)) == []
    assert trie(spark.createDataFrame([(None, 0, "u", "x")], TURNS)) == []
    # without turns of its own beyond the head, and without a donor, only the root has it
    c = next(c for c in range(1, 1_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert trie(spark.createDataFrame([(c, 0, "u", "x")], TURNS)) == brute_trie([(c, 0, "u", "x")])


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_trie_equals_sql(spark, sf):
    assert compare(queries.op12_prefix_trie(spark, sf), connect(sf), queries.ORACLES["op12_prefix_trie"]) is None


# toxicity


def test_sentences_of_texts():
    held = toxicity.Sentences.of(["One two. !three", None, "", "...", "É.x y\nz"])
    words = [w.decode() for w in held.words.to_pylist()]
    lengths = np.diff(np.r_[held.start, len(held.word)])
    found = [(t, p, [words[i] for i in held.word[a : a + n]]) for t, p, a, n in zip(held.text.tolist(), held.place.tolist(), held.start, lengths, strict=True)]
    assert found == [(0, 0, ["one", "two"]), (0, 2, ["three"]), (4, 0, ["é"]), (4, 1, ["x", "y"]), (4, 2, ["z"])]
    assert held.texts == 5


def test_a_document_is_the_noisy_or_of_its_sentences():
    model = toxicity.Model({b"=bad": 3.0, b"4badl": 1.5}, -2.0)
    texts = ["fine words. a bad word. badly said", "", "fine"]
    held = toxicity.Sentences.of(texts)
    score = -np.expm1(held.clear(held.logits(model.word_weights()(held.words), model.bias)))
    one = [1 / (1 + np.exp(-z)) for z in (-2.0, 1.0, -0.5)]
    assert np.allclose(score, [1 - np.prod([1 - p for p in one]), 0.0, one[0]])


def planted(count=300, seed=3):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(count):
        sentences = [" ".join(rng.choices(clean, k=rng.randint(1, 15))) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        at = rng.randrange(len(sentences)) if toxic else None
        if toxic:
            sentences[at] += " " + rng.choice(["stupid", "zorble" + rng.choice(clean)]) + " x"
        rows.append((i, ". ".join(sentences), int(toxic), at))
    return rows


def test_planted_sentences_are_found_from_labels_of_documents(spark):
    rows = planted()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert sum(found[i]["predicted"] == toxic for i, _, toxic, _ in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    model = toxicity.learn(docs, labels)
    hits = {(r["doc_id"], r["sentence"]): r for r in toxicity.offending_sentences(docs, model).collect()}
    caught = [(i, at) for i, _, toxic, at in rows if toxic and (i, at) in hits]
    assert len(caught) >= 0.95 * sum(r[2] for r in rows) and len(hits) <= 1.05 * sum(r[2] for r in rows)
    for (i, _), r in hits.items():
        text = rows[i][1]
        assert text[r["start"] : r["start"] + r["length"]] == r["content"]
    assert all(found[i]["worst_sentence"] == at for i, at in caught)


def test_the_gradient_is_that_of_the_loss():
    """One pass with a tiny step goes down the loss as its numeric slope says."""
    rows = planted(80)
    texts, labels = [r[1] for r in rows], np.array([r[2] for r in rows])
    weights = np.where(labels > 0, 1.0, 2.0)

    def loss(model):
        held = toxicity.Sentences.of(texts)
        clear = held.clear(held.logits(model.word_weights()(held.words), model.bias))
        each = np.where(labels > 0, -np.log(np.maximum(-np.expm1(clear), 1e-12)), -clear)
        return float((each * weights).sum() / weights.sum()) + toxicity.PENALTY / 2 * sum(w * w for w in model.weights.values())

    losses = [loss(toxicity.train(texts, labels, weights, passes=n, rate=0.05)) for n in (0, 5, 20, 60)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] / 2


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (9, None), (None, 0), (77, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in texts() if d] * 2, "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs, both).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    by_text = defaultdict(set)
    for r in found:
        by_text[r["doc_id"]].add(r["score"])
    assert by_text[6] == {0.0} and by_text[5] == {0.0} and len(by_text[15]) == 1 and by_text[1] == by_text[3]
    assert toxicity.toxicity_scores(empty(spark), both).count() == 0
    assert toxicity.offending_sentences(empty(spark), toxicity.Model({}, 0.0)).count() == 0


def test_held_out_documents_of_the_corpus(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in queries.op13_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r for r in found if labels[r["doc_id"]] == 1]
    clean = [r for r in found if labels[r["doc_id"]] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic) > 40
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
