"""Components, near duplicates, lines and fingerprints against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from odd import documents, empty, text, texts, words
from pyspark.sql import functions as F

from compare import compare, connect
from shelfwise.llm import fingerprints, graph, lines, minhash, near
from shelfwise.llm.corpus import read
from shelfwise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for n in nodes:
        least[root(n)].append(n)
    return {n: min(group) for group in least.values() for n in group}


@pytest.mark.parametrize("name", ["op2_decontamination", "op5_line_dedup", "op9_near_duplicates", "rollup_word_counts"])
def test_same_rows_as_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_components_of_paths_stars_and_random_edges(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    loose = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    edges = path + star + loose + [(7, 7)] + loose[:20]
    rng.shuffle(edges)
    found = graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r["id"]: r["component"] for r in found} == union_find(nodes, edges)
    assert len(found) == len(nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, size=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(found[i : i + size]) for i in range(max(len(found) - size + 1, 1))} if found else set()


def near_components(rows, percent):
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[:i]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return union_find(ids, links), {d: len(s) for d, s in sets.items()}


def edited(base, seed, changes):
    rng = random.Random(seed)
    held = list(base)
    for _ in range(changes):
        held[rng.randrange(len(held))] = f"edit{rng.randrange(10**6)}"
    return " ".join(held)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_in_a_crowd(spark, percent):
    """Edits of one text around the threshold: many share bands, some link only by way of others."""
    base = words(20, 150)
    rows = [(i, edited(base, i, i % 7)) for i in range(150)]
    rows += [(200 + i, " ".join(base)) for i in range(40)] + [(300 + i, text(900 + i, 60)) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "two words"), (403, "TWO words")]
    found = minhash.near_duplicates(documents(spark, rows), percent).collect()
    component, sizes = near_components(rows, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_a_crowd_over_many_cells_has_the_same_links(spark, monkeypatch):
    """Buckets of more members than a cell holds; Spark is not left to cut them into pieces that meet in pairs."""
    base = words(31, 150)
    rows = [(i, edited(base, 700 + i, 3 + i % 5)) for i in range(120)]
    skew, written, real = "spark.sql.adaptive.skewJoin.enabled", [], near.write_shared
    before = spark.conf.get(skew)
    monkeypatch.setattr(near, "write_shared", lambda df, name: written.append((name, spark.conf.get(skew))) or real(df, name))
    monkeypatch.setattr(near, "CELL_ROWS", 7)
    found = minhash.near_duplicates(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == near_components(rows, 85)[0]
    assert [on for name, on in written if name == "links"].count("false") == near.PARTS
    assert spark.conf.get(skew) == before


def test_cells_hold_every_pair_once(spark):
    rows = spark.range(50).selectExpr("id", "5 as bucket", "4 as cells")
    cells = [r.asDict() for r in near._dealt(rows).collect()]
    assert len(cells) == 200
    met = [(x["id"], y["id"]) for x in cells for y in cells
           if x["cell"] == y["cell"] and x["id"] < y["id"] and min(x["slot"], y["slot"]) * 4 + max(x["slot"], y["slot"]) == x["cell"]]
    assert len(met) == len(set(met)) == 50 * 49 // 2


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add(r["component_id"])
    assert by_id[1] == by_id[2] == by_id[3] == {1} and by_id[4] == {4}
    assert by_id[8] == by_id[9] == {8} and by_id[5] == {5} and by_id[6] == {6} and by_id[None] == {None}
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id in (2, 3, 9)").isEmpty() and not kept.filter("doc_id is null").isEmpty()
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    """Two texts of one document, with sets of equal size, and a near copy of each."""
    own = [text(97, 60), text(98, 60)]
    rows = [(1, own[0]), (1, own[1]), (2, own[0] + " more"), (3, own[1] + " more"), (4, text(99, 60))]
    found = minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_circulant_signature_estimates_similarity():
    rng = random.Random(1)
    shared = [rng.randrange(2**63) for _ in range(600)]
    own = [[rng.randrange(2**63) for _ in range(100)] for _ in range(2)]
    import numpy as np

    a, b = (minhash.signature(np.array(shared + o, np.uint64), 2048) for o in own)
    assert abs((a == b).mean() - 600 / 800) < 0.05


def line_classes(rows, percent=80, chars=8):
    """Keeper of each line that isn't blank, by brute force."""
    placed = sorted((d, i, line.strip(" ")) for d, t in rows if t is not None for i, line in enumerate(t.split("\n")) if line.strip(" "))
    first = {}
    for d, i, line in placed:
        first.setdefault(line, (d, i))
    sets = {p: {x[i : i + chars] for i in range(max(len(x) - chars + 1, 1))} for x, p in first.items()}
    places = sorted(sets)
    links = [
        (a, b) for n, a in enumerate(places) for b in places[:n]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    keeper = union_find(places, links)
    return {(d, i): keeper[first[line]] for d, i, line in placed}


def test_line_classes_of_odd_rows(spark):
    rows = [(d, t) for d, t in texts() if d not in (14, 15, None)]
    rows += [(2000 + i, text(50, 12) + f" {i}\n" + text(51, 12)) for i in range(25)]
    docs = documents(spark, rows)
    found = lines.line_classes(docs).collect()
    expected = line_classes(rows)
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in found} == expected
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["class_doc"], r["class_line"])) for r in found)

    cleaned = lines.drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.schema["n_chars"] == docs.schema["n_chars"]
    left = {r["doc_id"]: r["text"] for r in cleaned.select("doc_id", "text").collect()}
    for d, t in rows:
        if t is None:
            assert left[d] is None
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if expected.get((d, i), (d, i)) == (d, i)]
        if kept == t.split("\n"):
            assert left[d] == t
        elif any(x.strip(" ") for x in kept):
            assert left[d] == "\n".join(kept)
        else:
            assert d not in left


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    """Against the same rows under ids of their own: what is kept and cut is the same, in other rows at most."""
    own = [f"{c} {text(60 + i, 12)}" for i, c in enumerate("abcdefghij")]
    groups = {
        7: ["\n".join(own[:3]), "\n".join([own[3], own[4], own[3]])],
        8: [own[5] + "\n" + own[6], own[5] + "\n" + own[7]],
        None: [own[8] + "\n\n" + own[8], "shared\n" + own[9] + "\nshared"],
    }
    rows = [(d, t) for d, held in groups.items() for t in held]
    rows += [(d, t) for d, t in texts() if d in (14, 15, None)] + [(9, None), (9, None), (9, ""), (9, " \n")] + [(15, text(8, 25))]
    docs = documents(spark, rows)
    found = lines.line_classes(docs).collect()
    every = [x.strip(" ") for _, t in rows for x in (t or "").split("\n") if x.strip(" ")]
    assert len(found) == len(every)
    assert sum(r["kept"] for r in found) == len(set(every))

    cleaned = lines.drop_repeated_lines(docs).select("doc_id", "text").collect()
    left = sorted(x.strip(" ") for r in cleaned for x in (r["text"] or "").split("\n") if x.strip(" "))
    assert left == sorted(set(every))
    of = lambda d: sorted(r["text"] for r in cleaned if r["doc_id"] == d)
    assert of(7) == sorted([groups[7][0], "\n".join(own[3:5])])
    assert "shared\n" + own[9] in of(None) and own[8] + "\n" in of(None) and text(7, 25) in of(None)
    assert sorted(len(t) for t in of(8)) == sorted([len(groups[8][0]), len(own[7])]) or sorted(len(t) for t in of(8)) == sorted([len(groups[8][1]), len(own[6])])
    assert of(15) == [text(8, 25)] and len(of(14)) == 2
    assert sorted(map(repr, (r["text"] for r in cleaned if r["doc_id"] == 9))) == sorted(["None", "None", "''", repr(" \n")])


def test_pairs_of_lines_near_the_threshold_all_meet(spark):
    """One word of six letters replaced in lines of 137: a likeness of 0.82, and nothing else joins a pair."""
    rng = random.Random(80)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(600):
        line = letters(137)
        rows += [(2 * i, line), (2 * i + 1, line[:60] + letters(6).upper() + line[66:])]
    found = lines.line_classes(documents(spark, rows)).collect()
    assert len(found) == 1200
    assert {r["doc_id"] for r in found if r["class_doc"] != r["doc_id"] // 2 * 2} == set()


def test_coordinates_are_the_minima_over_all_shingles(spark):
    """Regions first, then all of them: as if each shingle had met all 80 constants; a region's shingles meet five."""
    line = " ".join(["some", "words", "of", "a", "line", "that", "is", "long", "enough", "for", "two", "regions", "or", "more"])
    lined = spark.createDataFrame([(1, 0, line), (1, 1, "short"), (2, 0, "ab" * 90)], "doc_id long, line_no int, line string")
    signed = lines.sign_lines(lined)
    found = {(r["doc_id"], r["line_no"]): r for r in signed.collect()}
    own = lines._constants(5)
    for d, n, x in lined.collect():
        points = x.encode("utf-32-be")
        at = range(max(len(x) - 8 + 1, 1))
        hashes = [xxhash.xxh64_intdigest(points[4 * i : 4 * i + 32], seed=42) for i in at]
        least = [min(signed64(h ^ (j // 5 << 60 | own[j % 5])) for h in hashes) for j in range(80)]
        assert found[d, n]["size"] == len(hashes)
        low = [least[j * 80 // 32] & 15 for j in range(32)]
        assert found[d, n]["sketch_a"] == signed64(sum(v << 4 * i for i, v in enumerate(low[:16])))
        assert found[d, n]["sketch_b"] == signed64(sum(v << 4 * i for i, v in enumerate(low[16:])))
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert "region" in plan and plan.count(str(own[3])) == 1


def signed64(v):
    return v - (1 << 64) if v >> 63 else v


def test_full_sets_of_a_crowd_are_shuffled_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh ") for _ in range(120)] for _ in range(4)]
    rows = [(i, "\n".join("".join(b[:k] + [rng.choice("xyz")] + b[k + 1 :]) for k in rng.sample(range(120), 2)))
            for i, b in enumerate(base * 12)]
    written = []
    real = near.write_shared
    monkeypatch.setattr(near, "write_shared", lambda df, name: written.append((name, dict(df.dtypes))) or real(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in lines.line_classes(docs).collect()}
    assert found == line_classes(rows)
    # the members of the buckets are written as lines, not as the hashes of their shingles
    assert [types["members"] for name, types in written if "members" in types] == ["string"]
    assert len([n for n, _ in written if n == "links"]) > near.PARTS


def test_marks_of_lines_rule_out_no_link(spark):
    """Every pair at or above the threshold passes, of few, many and repeated shingles; most of the others don't."""
    rng = random.Random(41)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    held = ["ab" * n for n in (20, 40, 90)] + ["ab" * 40 + "c", "abcdefghijk " * 9, "abcdefghijk " * 12, "tiny", "tiny line"]
    for size in (12, 30, 60, 140, 400):
        for _ in range(12):
            base = letters(size)
            cut = rng.randrange(size)
            held += [base, base[:cut] + letters(2) + base[cut:], base + letters(max(1, size // 12))]
    held = [x for x in dict.fromkeys(x.strip(" ") for x in held) if x]
    lined = spark.createDataFrame([(i, 0, x) for i, x in enumerate(held)], "doc_id long, line_no int, line string")
    counts = lines._hash_blocks(lined.select("doc_id", "line").repartition("doc_id"), ["doc_id"], ["line"], 8)
    marks = lines.sign_lines(lined).join(counts.selectExpr("doc_id", "size(line) as n"), "doc_id").cache()
    sets = [{x[i : i + 8] for i in range(max(len(x) - 7, 1))} for x in held]
    assert {r["doc_id"]: r["n"] for r in marks.collect()} == {i: len(s) for i, s in enumerate(sets)}
    both = marks.alias("x").crossJoin(marks.alias("y")).filter("x.doc_id < y.doc_id")
    passed = {(r[0], r[1]) for r in both.filter(lines._can_be_linked("x", "y", 80)).select("x.doc_id", "y.doc_id").collect()}
    marks.unpersist()
    every = [(a, b) for b in range(len(held)) for a in range(b)]
    linked = {(a, b) for a, b in every if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(linked) > 60 and linked <= passed
    assert len(passed - linked) < 0.1 * len(every)


def test_stages_of_lines_are_compiled(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes, which is far slower."""
    docs = read(spark, SF, "documents")
    pairs = docs.selectExpr("doc_id as a", "doc_id as b", "text as left", "text as right")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (
            lines.sign_lines(lines.split_lines(docs)),
            lines._hash_blocks(pairs, ["a", "b"], ["left", "right"], 8),
        ):
            frame.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize: *(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_pair_of_lines_is_compared_once(spark, monkeypatch):
    """What the leader met most doesn't link isn't compared again with the other leaders."""
    rng = random.Random(43)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    bases = [letters(150) for _ in range(12)]
    rows = [(20 * i + k, b[: 150 - 9 * k] + letters(9 * k)) for i, b in enumerate(bases) for k in range(8)]
    compared, real = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *a, **k: compared.append([tuple(r) for r in pairs.select("a", "b").collect()]) or real(pairs, *a, **k))
    found = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in lines.line_classes(documents(spark, rows)).collect()}
    assert found == line_classes(rows)
    first, others = compared
    assert first and others and not {*first} & {*others}


def test_lines_of_every_odd_row_and_of_none(spark):
    docs = documents(spark)
    assert lines.line_classes(docs).count() == sum(bool(x.strip(" ")) for _, t in texts() for x in (t or "").split("\n"))
    assert not lines.drop_repeated_lines(docs).filter("doc_id is null").isEmpty()
    assert lines.line_classes(empty(spark)).count() == 0
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def spark_hash(data):
    value = xxhash.xxh64(data, seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def anchor_hashes(text, inner=8, places=8):
    data, size = text.encode(), inner + places - 1
    if not text:
        return {}
    found = {}
    for i in range(max(len(data) - size, 0) + 1):
        hashes = [spark_hash(data[i + j : i + j + inner]) for j in range(places)]
        if len(data) < size or min(hashes) in (hashes[0], hashes[-1]):
            found[i] = spark_hash(data[i : i + size])
    if not found:
        least, i = min((spark_hash(data[i : i + size]), i) for i in range(len(data) - size + 1))
        found[i] = least
    return found


def test_short_texts_have_a_fingerprint_of_their_own(spark):
    rows = [(i, "".join(random.Random(i).choices("abcdefg hij", k=13 + i % 9))) for i in range(90)]
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_edits(documents(spark, rows)).collect()}
    assert found == {d: fingerprint(t) for d, t in rows}
    assert any(len(t) >= 15 and not any_edge(t) for _, t in rows) and len(set(found.values())) == len({t for _, t in rows})


def any_edge(text, inner=8, places=8):
    data, size = text.encode(), inner + places - 1
    every = [[spark_hash(data[i + j : i + j + inner]) for j in range(places)] for i in range(len(data) - size + 1)]
    return any(min(h) in (h[0], h[-1]) for h in every)


def fingerprint(text):
    found = anchor_hashes(text).values()
    if not found:
        return ""
    return "".join(f"{min(h ^ c for h in found) & 0xFFFF:04x}" for c in fingerprints._constants(64))


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64


def test_fingerprints_against_brute_force(spark):
    rows = [(d, (t or "")[:3000]) for d, t in texts() if d is not None]
    found = sorted(fingerprints.fingerprint_edits(documents(spark, rows)).collect(), key=lambda r: (-r["doc_id"], r["edited_sha256"]))
    order = sorted(rows, key=lambda r: (-r[0], spark_hash(r[1].encode())))
    expected = []
    for i, (d, t) in enumerate(order):
        following, third = order[(i + 1) % len(order)][1], len(t) // 3
        edit = t[: len(t) - third] + following[:third]
        marks = [fingerprint(x) for x in (t, edit, following)]
        expected.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), *marks[:2], likeness(*marks[:2]), likeness(marks[0], marks[2])))
    assert [tuple(r) for r in found] == sorted(expected, key=lambda r: (-r[0], r[2]))


def test_fingerprints_over_blocks_nulls_and_nothing(spark):
    rows = [(i * 37, f"{i} " + text(i, 10)) for i in range(-40, 60)] + [(2**40, "far"), (None, "no number")]
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**60)))
    for i, (d, t) in enumerate(order):
        following, third = order[(i + 1) % len(order)][1], len(t) // 3
        assert found[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0
    lone = fingerprints.fingerprint_edits(documents(spark, [(1, "abc " * 30)])).first()
    assert lone["near_next"] == 1.0


def test_equal_passages_have_equal_anchors_anywhere(spark):
    passage = text(70, 40)
    frame = documents(spark, [(1, text(71, 9) + " " + passage), (2, passage + " " + text(72, 30))])
    frame = frame.select("doc_id", F.col("text").cast("binary").alias("data"))
    found = defaultdict(dict)
    for r in fingerprints.anchors(frame, ["doc_id"]).collect():
        found[r["doc_id"]][r["position"]] = r["anchor"]
    shift = len(text(71, 9)) + 1
    inside = {p: h for p, h in found[2].items() if p + 15 <= len(passage)}
    assert inside and all(found[1][p + shift] == h for p, h in inside.items())


def test_no_python_in_native_operators(spark):
    from shelfwise.llm import decontamination

    docs, benchmark = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    for frame in (fingerprints.fingerprint_edits(docs), lines.line_classes(docs), decontamination.decontaminate(docs, benchmark)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow|Cartesian|NestedLoop", plan)
