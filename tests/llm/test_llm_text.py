"""Tokens, packing, counts, decontamination, licences, language, quality and the pipeline against plain Python."""

import hashlib
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from odd import documents, empty, text, texts
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import decontamination, language, licenses, packing, quality, token_counts, token_files, tokens
from shelfwise.llm.corpus import read

SF = "/root/testdata/sf0.001"
FOLD = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_ids_by_words_equal_ids_of_whole_texts(name):
    encoder = tokens.TextEncoder(tokens.tokenizer_path(name), remembered=500)
    held = [t for _, t in texts()] + ["x.y, 'z it's\nIt's", " a", "a ", "a\r\nb", "end.\n\nnext", "Á B", "tail!?;:", "\x01 x \x01"]
    for _ in range(3):  # remembered, renewed, and taken over
        ids, ends = encoder.encode(pa.array(held, pa.string()))
        whole = encoder.whole([t or "" for t in held])
        for t, w, a, b in zip(held, whole, ends[:-1], ends[1:], strict=True):
            assert ids[a:b].astype("<u4").tobytes() == w, t
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 1]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_new_words_take_no_python_step_each(name):
    encoder = tokens.TextEncoder(tokens.tokenizer_path(name))
    letters = "bcdfghjklmnpqrst"
    held = [f"{a}{b}o{c}" for a in letters for b in letters for c in letters]
    text = pa.array([" ".join(w + "." * (i % 3 == 0) for i, w in enumerate(held))])
    steps = []
    sys.setprofile(lambda frame, event, arg: steps.append(event) if event in ("call", "c_call") else None)
    try:
        ids, _ = encoder.encode(text)
    finally:
        sys.setprofile(None)
    assert len(steps) < len(held)
    assert ids.astype("<u4").tobytes() == encoder.whole(text.to_pylist())[0]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_words_with_other_letters_and_marks_are_not_coded_one_by_one(name, monkeypatch):
    encoder = tokens.TextEncoder(tokens.tokenizer_path(name))
    letters = "bcdfghjklmnpqrst"
    held = [f"{a}é{b}{c}ß" for a in letters for b in letters for c in letters]
    text = pa.array([" ".join(w + ("%%%", ")", "")[i % 3] for i, w in enumerate(held))])
    single, whole = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda words: single.extend(words) or whole(words))
    ids, _ = encoder.encode(text)
    assert len(single) < len(held) / 4
    assert ids.astype("<u4").tobytes() == whole(text.to_pylist())[0]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_every_letter_and_mark_by_words(name):
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    held = [f"x{c} {c} {c}x {c}{c.lower()}" for c in letters]
    held += [f"one{a}{b} two{b} {a}three{a}" for a in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in ".'<|=\u0338"]
    encoder = tokens.TextEncoder(tokens.tokenizer_path(name))
    ids, ends = encoder.encode(pa.array(held))
    for t, w, a, b in zip(held, encoder.whole(held), ends[:-1], ends[1:], strict=True):
        assert ids[a:b].astype("<u4").tobytes() == w, t


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_ids_equal_those_of_the_library_as_it_is(name):
    from tokenizers import Tokenizer

    path, mark = tokens.tokenizer_path(name), "<|endoftext|>"
    held = [t for _, t in texts() if t and len(t) < 5000]
    held += [mark, f"one {mark} two", f"one{mark}two three", f"end.{mark}\nnext", f"{mark}{mark}. A", f"a\n{mark}\n\nb {mark}, c", mark.upper() + " x"]
    ids, ends = tokens.TextEncoder(path).encode(pa.array(held, pa.string()))
    library = Tokenizer.from_file(path)
    for t, a, b in zip(held, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, row_group_bytes=1 << 20, page_rows=4)
    found = token_files.token_digests(spark, path).orderBy("start", "n_tokens").collect()
    encoder = tokens.TextEncoder(tokens.tokenizer_path(tokens.BYTE_BPE))
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for d, t in order:
        ids = encoder.whole([t or ""])[0] + bytes(4)
        expected.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert [tuple(r) for r in found] == expected
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))

    some = token_files.read_tokens(spark, path, 8, 10).collect()
    assert sorted(r["doc_id"] for r in some) == [8, 9, 10]
    assert token_files.read_metadata(spark, path).agg(F.sum("n_tokens")).first()[0] == start
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan
    for file in (tmp_path / "files").glob("part-*.parquet"):
        group = pq.ParquetFile(file).metadata
        if group.num_rows:
            columns = {c.path_in_schema: c for c in (group.row_group(0).column(i) for i in range(group.num_columns))}
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_offset_index
            assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert token_files.token_files_round_trip(empty(spark)).count() == 0


def check_packed(rows, docs, capacity):
    encoder = tokens.TextEncoder(tokens.tokenizer_path(tokens.WORD_BPE))
    expected = []
    for d, t in docs:
        ids = np.frombuffer(encoder.whole([t or ""])[0], "<u4").tolist() + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            held = ids[at : at + capacity]
            expected.append((d, piece, at, len(held), zlib.crc32(np.array(held, "<u4").tobytes())))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(e[3] for e in expected) // capacity)


def test_packing_of_odd_rows(spark):
    for capacity in (64, 4096):
        rows = packing.pack(documents(spark), capacity=capacity).collect()
        used, least = check_packed(rows, texts(), capacity)
        assert used <= least * 1.05 + 1
    assert packing.pack(empty(spark)).count() == 0


def test_packing_of_the_documents(spark):
    docs = read(spark, SF, "documents")
    rows = packing.pack(docs).collect()
    used, least = check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 4096)
    assert used <= least * 1.02 + 1


@pytest.mark.parametrize("kind", ["uniform", "short", "half", "one", "long tail"])
def test_plan_uses_every_length_once(kind):
    rng = np.random.default_rng(1)
    lengths = {
        "uniform": rng.integers(1, 513, 5000), "short": rng.integers(1, 9, 3000), "half": np.full(1001, 300),
        "one": np.array([512]), "long tail": np.minimum(rng.lognormal(4, 1.2, 20000).astype(int) + 1, 512),
    }[kind]
    counts = np.bincount(lengths, minlength=513)
    plan = packing.make_plan(counts, size=2000)
    used = np.zeros(513, int)
    for pattern, times in zip(plan.lengths, plan.repeats, strict=True):
        assert sum(pattern) <= 512 and times > 0
        for length in pattern:
            used[length] += times
    assert (used == counts).all()
    bound = 1001 if kind == "half" else -(-lengths.sum() // 512)
    assert plan.sequences <= bound * 1.02 + 2
    assert packing.make_plan(np.zeros(513, int)).sequences == 0


def test_fit_is_close_and_never_negative():
    rng = np.random.default_rng(2)
    patterns = np.array([[3, 3, 2], [5, 3, 0], [4, 4, 0], [8, 0, 0], [2, 2, 4]])
    x = np.array([30.0, 10, 5, 7, 12])
    counts = np.zeros(9)
    for p, n in zip(patterns, x, strict=True):
        for v in p[p > 0]:
            counts[v] += n
    found = packing.fit_repeats(patterns, counts, 3000)
    assert (found >= 0).all() and np.allclose(found, x, rtol=0.05)
    left = counts.astype(int)
    repeats = packing.round_repeats(patterns, found + rng.random(5), left)
    assert (left >= 0).all() and (repeats >= 0).all()


def test_token_counts_follow_inserts_deletes_and_revisions(spark, tmp_path):
    docs = documents(spark)
    counts = token_counts.count_tokens(docs)
    encoder = tokens.TextEncoder(tokens.tokenizer_path(tokens.BYTE_BPE))
    rows = counts.collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_tokens"]) for r in rows))) == sorted(repr((d, len(encoder.whole([t or ""])[0]) // 4)) for d, t in texts())

    def totals(signed):
        sums = defaultdict(lambda: [0, 0])
        for r, sign in signed:
            key = (r["source"], r["lang"], r["tokenizer_version"])
            sums[key][0] += sign
            sums[key][1] += sign * r["n_tokens"]
        return {k: tuple(v) for k, v in sums.items() if any(v)}

    def state(rollup):
        return {(r["source"], r["lang"], r["tokenizer_version"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}

    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup")).create()
    assert state(rollup) == {} and rollup.commit("nothing", token_counts.inserts(token_counts.count_tokens(empty(spark))))
    assert rollup.commit("load", token_counts.inserts(counts))
    assert not rollup.commit("load", token_counts.inserts(counts))
    assert state(rollup) == totals([(r, 1) for r in rows])
    gone, moved = counts.filter("doc_id < 9"), counts.filter("doc_id >= 9")
    newer = moved.withColumn("n_tokens", F.col("n_tokens") + 5).withColumn("tokenizer_version", F.lit("next"))
    rollup.commit("remove", token_counts.deletes(gone))
    # a try that broke off before its name was written counts for nothing, and is overwritten
    token_counts.inserts(counts).limit(1).selectExpr("source", "lang", "tokenizer_version", "9L documents", "9L tokens").write.parquet(f"{rollup.deltas_path}/batch=revise")
    before = state(rollup)
    rollup.commit("revise", token_counts.revisions(moved, newer))
    expected = totals([(r, 1) for r in rows] + [(r, -1) for r in rows if (r["doc_id"] or 99) < 9 and r["doc_id"] is not None]
                      + [(r, -1) for r in moved.collect()] + [(r, 1) for r in newer.collect()])
    assert state(rollup) == expected != before
    assert rollup.compact() and len(rollup.committed()) == 1 and state(rollup) == expected
    assert not rollup.commit("load", token_counts.inserts(counts)) and rollup.create() and state(rollup) == expected


def test_registered_counts_are_of_both_tokenizers(spark):
    from shelfwise.llm.queries import QUERIES

    toxic = {r["doc_id"] for r in read(spark, SF, "labels").filter("toxic = 1").collect()}
    rows = [r for r in read(spark, SF, "documents").collect() if r["doc_id"] not in toxic]
    expected = defaultdict(lambda: [0, 0])
    for name in (tokens.BYTE_BPE, tokens.WORD_BPE):
        found = tokens.TextEncoder(tokens.tokenizer_path(name)).whole([r["text"] or "" for r in rows])
        for r, ids in zip(rows, found, strict=True):
            total = expected[r["source"], r["lang"], name.rsplit(".", 1)[0]]
            total[0] += 1
            total[1] += len(ids) // 4
    found = QUERIES["op3_token_counts"](spark, SF).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in found} == expected


def hits(docs, items, window=10):
    """By row: rows may share an id or have none."""
    found = []
    for d, t in docs:
        w, covered, names = words_of(t), set(), set()
        for name, item in items:
            v = words_of(item)
            n = min(window, len(v))
            held = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in held:
                    covered |= set(range(i, i + n))
                    names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((d, len(w), len(covered), len(names), digest, bool(covered)))
    return found


def test_decontamination_against_brute_force(spark):
    long = text(90, 40).split(" ")
    items = [
        (1, " ".join(long)), (2, "One, two"), (3, None), (4, "?!"), (5, " ".join(long[5:25])), (11, "one TWO"),
        (6, text(91, 9)), (7, text(92, 10)), (8, "rep " * 30), (9, "solo"), (10, text(93, 5)), (12, text(94, 3)),
    ]
    docs = [
        (1, "Before " + " ".join(long[:12]) + " between " + " ".join(long[20:31]) + "."), (2, "one two one-two"), (3, None), (4, ""),
        (5, " ".join(long[:9])), (6, " ".join(long).upper()), (7, text(91, 9) + " x " + text(91, 8)), (8, "rep " * 11 + "x " + "rep " * 9),
        (9, text(92, 9) + " y " + text(92, 10)), (10, "solo " * 3), (11, text(93, 5) + " " + text(94, 3)), (12, text(95, 20_000) + " " + " ".join(long[3:14])),
        (8, "one two"), (8, "one two"), (3, "nothing of it"), (None, "a " + " ".join(long[:11])), (None, "clean"), (None, None),
    ]
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, n long, words string")
    found = decontamination.decontaminate(documents(spark, docs), benchmark).collect()
    expected = hits(docs, items)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    kept = decontamination.drop_contaminated(documents(spark, docs), benchmark)
    clean = [d for d, e in zip(docs, expected, strict=True) if not e[-1]]
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(repr, clean)) and len(kept.columns) == 10


def test_decontamination_of_odd_rows_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, text(8, 25))], "item_id long, text string")
    docs = documents(spark)
    found = decontamination.decontaminate(docs, benchmark).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, hits(texts(), [(1, text(8, 25))])))
    assert not decontamination.drop_contaminated(docs, benchmark).filter("doc_id is null").isEmpty()
    assert decontamination.decontaminate(empty(spark), benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).filter("contaminated").isEmpty()


def test_decontamination_of_rows_without_ids(spark):
    leak, other = text(96, 14), text(97, 6)
    benchmark = spark.createDataFrame([(None, leak), (None, other), (3, other)], "item_id long, text string")
    docs = documents(spark, [(1, "a " + leak), (2, other + " b"), (3, "c d"), (None, leak + " e"), (None, "clean f"), (None, None)])
    found = decontamination.decontaminate(docs, benchmark).collect()
    # items without a name count as one, documents without an id count each
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in found if r["doc_id"] is None) == [(0, 0, 0), (2, 0, 0), (15, 14, 1)]
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in found if r["doc_id"]} == {1: (14, 1), 2: (6, 2), 3: (0, 0)}
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.schema == docs.schema
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == ["(3, 'c d')", "(None, 'clean f')", "(None, None)"]


def test_license_places_against_brute_force(spark):
    rows = [
        (1, "Released Under the MIT License. x under the mit license"), (2, "apache license, version 2.0; CC-BY-NC"), (3, None), (4, ""),
        (5, "This work is licensed under the GNU General Public License, version 3."), (6, "under the mit\nlicense " * 500), (7, "the mit license"),
        (8, "general public gnu version license 3 lesser"), (9, "Licensed under the GNU Lesser General Public License"), (10, text(3, 20_000) + " cc by nc"),
        (11, "under the mit under the mit license apache license version 2"), (11, "under the mit license"),
    ]
    found = licenses.scan_licenses(documents(spark, rows)).collect()
    expected = []
    for d, t in rows:
        w, places = words_of(t), []
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split(" ")
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        begins = [i for i, _ in places]
        expected.append((d, len(w), len(places), min(begins, default=None), max(begins, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:6]) for r in found)
    for r in found:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in found}
    assert labels[5] == "gpl-3" and labels[9] == "lgpl" and labels[7] == labels[8] == labels[4] == labels[3] == ""
    assert licenses.scan_licenses(empty(spark)).count() == 0 and licenses.scan_licenses(documents(spark)).count() == len(texts())


def test_language_of_held_out_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    found = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held_out = [r for r in found if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held_out) > 0.97 * len(held_out)


def test_language_of_odd_rows(spark):
    found = language.identify_languages(documents(spark)).collect()
    assert len(found) == len(texts())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (5, 6, 7))
    assert {r["lang_pred"] for r in found} <= {"en", "fr", "und"}
    assert language.identify_languages(empty(spark)).count() == 0
    unlabelled = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_languages(unlabelled).collect()} == {"und"}


def test_isotonic_pools_neighbours():
    values, weights = np.array([1.0, 3, 2, 2, 5, 4]), np.array([1.0, 1, 1, 2, 1, 3])
    found = quality.isotonic(values, weights)
    assert np.allclose(found, [1, 2.25, 2.25, 2.25, 4.25, 4.25])
    assert (np.diff(quality.isotonic(np.random.default_rng(0).random(200), np.ones(200))) >= -1e-12).all()
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_summed_normal_equations_equal_those_of_all_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.random(len(quality.STATISTICS)).tolist(), float(rng.integers(2))) for _ in range(200)]
    zeros = np.zeros(len(quality.STATISTICS))
    model = quality.Model(zeros, zeros + 1, np.zeros(17), np.zeros(0), np.zeros(0))
    frame = spark.createDataFrame(rows, "statistics array<double>, label double").repartition(7)
    products, target = quality.normal_equations(frame, model)
    waves = model.cosines(np.array([s for s, _ in rows]))
    assert np.allclose(products, waves.T @ waves) and np.allclose(target, waves.T @ np.array([y for _, y in rows]))


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    found = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(found) == docs.count()
    marks = [(r["quality"], found[r["doc_id"]]) for r in labels.collect()]
    held_out = [(q, r) for q, r in marks if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found.values())
    assert sum(q == r["predicted"] for q, r in held_out) > 0.93 * len(held_out)


def test_quality_of_odd_rows_and_labels(spark):
    docs = documents(spark)
    def labels(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
    few = labels([(1, 1, 0, "x"), (2, 1, 0, "x"), (7, 0, 0, "x"), (8, 0, 1, None), (8, 0, 1, None), (None, 1, 0, "x"), (9, None, 0, "x"), (77, 1, 0, "")])
    found = quality.quality_scores(docs, few).collect()
    assert len(found) == len(texts()) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in quality.quality_scores(docs, labels([])).collect()} == {0.5}
    assert {r["score"] for r in quality.quality_scores(docs, labels([(1, 1, 0, ""), (2, 1, 0, "")])).collect()} == {1.0}
    assert quality.quality_scores(empty(spark), few).count() == 0
    kept = quality.keep_quality(docs, few)
    assert kept.columns == docs.columns and not kept.filter("doc_id is null").isEmpty()


def test_pipeline_stages_take_effect(spark):
    docs = read(spark, SF, "documents")
    labels, benchmark = read(spark, SF, "labels"), read(spark, SF, "benchmark")
    rows, held = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, SF).persist()
        held[name] = (before, rows)
        if name != "packing":
            assert rows.schema == docs.schema
    before, after = held["quality"]
    bad = {r["doc_id"] for r in quality.quality_scores(before, labels).collect() if not r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
    before, after = held["line_dedup"]
    lines = [x.strip(" ") for r in after.collect() for x in (r["text"] or "").split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
    before, after = held["near_duplicates"]
    from test_llm_sets import near_components

    component, _ = near_components([(r["doc_id"], r["text"]) for r in before.collect()], corpus_pipeline.NEAR_PERCENT)
    assert {r["doc_id"] for r in after.collect()} == {d for d, c in component.items() if d == c}
    before, after = held["decontamination"]
    found = hits([(r["doc_id"], r["text"]) for r in before.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert {r["doc_id"] for r in after.collect()} == {f[0] for f in found if not f[-1]}
    before, after = held["packing"]
    check_packed(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()], 4096)


def test_pipeline_of_odd_rows_and_of_none(spark):
    for docs in (documents(spark), empty(spark)):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF).persist()
        assert (rows.count() > 0) == (docs.count() > 0)


def test_signs_that_only_look_like_letters_have_no_language():
    net = language.Network(["a", "b"], [np.zeros((w, 256, language.FILTERS), np.float32) for w in language.WIDTHS], np.zeros(36, np.float32), np.zeros((36, 2), np.float32), np.zeros(2, np.float32))
    found, scores = language.predict(net, ["\u00bd", "\u00b2 3", "\u2460!", "a", "\u00aa", "\u6f22", "", None])
    assert [f == language.UNKNOWN for f in found] == [True, True, True, False, False, False, True, True]
    assert [s == 0 for s in scores] == [f == language.UNKNOWN for f in found]
