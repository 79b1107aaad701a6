"""Vectors, URLs, lines, near copies, benchmark templates and repeated bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lamina.llm import decontaminate, fuzzy_lines, graph, probminhash, repeats, topk, url_filter


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, 0.25, 3.0, 0.1]) for _ in range(rng.choice([3, 3, 3, 2, 0]))], "z") for i in range(60)]
    rows += [(60, None, "z"), (61, [1.0, float("nan"), 2.0], "z"), (62, [float("inf")] * 3, "z"), (63, [None, 1.0, 1.0], "z"),
             (5, [9e6, 9e6, 9e6], "z"), (None, [1.0, 1.0, 1.0], "z"), *rows[:5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = dict.fromkeys(
        (i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))
    expected = []
    for q in {i for i, _ in good if i % 5 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, v)), j) for i, x in good if i == q for j, v in good if j != q)
        expected += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scores[:10])]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, 10).collect())) == sorted(expected)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0, 10).count() == 0
    assert topk.top_k(df.where("vec_id = 10"), F.col("vec_id") % 5 == 0, 10).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-900, 900, (300, 16)), rng.integers(-900, 900, (40, 16))
    low, high = v.min(axis=0), v.max(axis=0)
    step = np.maximum((high - low) // topk.CELLS + 1, 1)
    lower, upper = topk._bounds(q, np.minimum((v - low) // step, topk.CELLS - 1).astype(np.uint8), low, step)
    exact = q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_url_filter(spark):
    entries = spark.createDataFrame([
        ("bad.example", "add", "2024-01-10"), ("bad.example", "remove", "2024-02-01"), ("bad.example", "add", "2024-03-01"),
        ("bad.example", "add", "2024-01-10"), ("a.b.bad.example", "add", "2024-03-05"), ("tie.example", "add", "2024-01-01"),
        ("tie.example", "remove", "2024-01-01"), (None, "add", "2024-01-01"), ("x.example", "add", None), ("y.example", None, "2024-01-01"),
    ], "domain string, action string, dated string")
    captures = spark.createDataFrame([
        (1, "https://www.bad.example/x", "2024-01-09"), (2, "http://u:p@WWW.Bad.Example:80/x", "2024-01-10"), (3, "https://bad.example", "2024-01-31"),
        (4, "https://bad.example?q", "2024-02-01"), (5, "https://a.b.bad.example./", "2024-03-06"), (6, "https://notbad.example/", "2024-01-15"),
        (7, None, "2024-01-15"), (8, "https://bad.example/", None), (9, "no url", "2024-01-15"), (10, "https://tie.example/", "2024-05-01"),
        (3, "https://bad.example", "2024-01-31"), (11, "https://" + "a." * 300 + "bad.example/", "2024-01-15"),
    ], "page_id long, url string, fetched string").withColumn("blocked", F.lit("old")).withColumn("domain", F.lit("keep"))
    out = url_filter.judge(captures, url_filter.intervals(entries))
    rows = out.orderBy("page_id").collect()
    assert len(rows) == 12 and all(r.domain == "keep" for r in rows)
    assert sorted(r.page_id for r in rows if r.blocked) == [2, 3, 3, 5]
    five = next(r for r in rows if r.page_id == 5)
    assert (five.blocked_domain, five.blocked_since, five.blocked_until) == ("a.b.bad.example", "2024-03-05", None)
    assert not url_filter.judge(captures, url_filter.intervals(entries.limit(0))).where("blocked").count()


def test_groups(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (500, 500)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in graph.groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert graph.groups(spark.createDataFrame([], "a long, b long")).count() == 0


LONG = ("the quick brown fox jumps over the lazy dog and then runs away across the wide green field towards the old mill "
        "by the river while nobody is watching it at all today because everyone went to the market in the next town over "
        "the hill to buy bread")


def test_fuzzy_lines(spark):
    rows = [(1, "Hello World\n" + LONG + "\nunique one"), (2, "hello,  world!\nsecond\n---\n---"), (3, LONG.replace("watching it", "watching him") + "\nthird"),
            (4, None), (5, ""), (6, "hello world"), (None, "second"), (2, "hello,  world!\nsecond\n---\n---"), (7, LONG.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("line_no", F.lit(1))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in fuzzy_lines.drop_repeated(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, rows[0][1], 3, 0), (2, "---\n---", 4, 2), (2, "---\n---", 4, 2), (3, "third", 2, 1), (4, None, 0, 0), (5, "", 1, 0),
        (6, "", 1, 1), (None, "second", 1, 0), (7, "", 1, 1)], key=str)
    assert fuzzy_lines.drop_repeated(df.limit(0)).count() == 0


def test_simhash_and_pairs_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(40):
        line = list(base[i % 4])
        for _ in range(i // 10):
            line[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(line))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = fuzzy_lines.fingerprints(fuzzy_lines.lines(docs))
    hashes = {r.word: r.h & (1 << 64) - 1 for r in docs.select(F.explode(F.split("text", " ")).alias("word")).distinct()
              .select("word", F.xxhash64("word").alias("h")).collect()}

    def simhash(text):
        ws = text.split()
        return sum(1 << b for b in range(64) if 2 * sum(hashes[w] >> b & 1 for w in ws) > len(ws))

    marks = {r.doc_id: r.simhash & (1 << 64) - 1 for r in prints.collect()}
    assert marks == {i: simhash(t) for i, t in enumerate(texts)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    expected = {(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= fuzzy_lines.RADIUS
                and edits(texts[a], texts[b]) <= int((1 - fuzzy_lines.SIMILARITY) * max(len(texts[a]), len(texts[b])) + 1e-9)}
    links = {(r.a.doc_id, r.b.doc_id) for r in fuzzy_lines.fuzzy_links(docs, prints).collect()}
    assert expected and all((min(p), max(p)) in expected for p in links)

    def parts(pairs):
        root = {i: i for i in marks}
        for _ in marks:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    # Fewer links than pairs, but the same groups.
    assert parts(links) == parts(expected)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_recall_against_brute_force_edits(spark):
    rng = random.Random(12)
    syllables = ["an", "ter", "mo", "li", "sen", "ka", "ru", "best", "ion", "dra"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def changed(line, kind):
        words = line.split(" ")
        if kind == 0:
            words[rng.randrange(len(words))] = word()
        elif kind == 1:
            k = rng.randrange(len(line))
            return line[:k] + rng.choice(["x", "", line[k] + "z"]) + line[k + 1:]
        elif kind == 2:
            for _ in range(2):
                words[rng.randrange(len(words))] = word()
        else:
            letters = list(line)
            for _ in range(len(line) // 12):
                letters[rng.randrange(len(letters))] = rng.choice("xyz")
            return "".join(letters)
        return " ".join(words)

    families = [[base, *(changed(base, kind) for kind in (0, 1, 2, 3))] for n in [5, 5, 5, 6, 6, 7, *range(5, 31), *range(8, 31)]
                for base in [" ".join(word() for _ in range(n))]]
    lines = [[fuzzy_lines_norm(line) for line in family] for family in families]
    rows, short, long = [], set(), set()
    for f, family in enumerate(lines):
        for k, line in enumerate(family):
            rows.append((10 * f + k, line))
            near = [j for j in range(k) if family[j] != line and
                    10 * _distance(family[j], line) < max(len(family[j]), len(line))]
            if near:
                (short if len(line) <= 55 else long).add(10 * f + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in fuzzy_lines.repeated(docs).collect()}
    assert len(short) > 10 and len(long) > 100
    # Short lines are complete; of the longer ones a few with edits in nearly every piece may be missed.
    assert short <= got
    assert len(long & got) / len(long) >= 0.97


def test_lines_at_exactly_the_similarity(spark):
    rows = [(1, "abcdefghij"), (2, "abcdefghiX"), (3, "mnopqrstuvwxyzabcdef"), (4, "mnopqYstuvwxyzabcdeZ"), (5, "klmnopqrs"), (6, "klmnopqrX")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in fuzzy_lines.repeated(docs).collect()} == {2, 4}


def test_line_dedup_frees_what_it_wrote(spark, tmp_path):
    import os

    rows = [(i, f"{LONG} {i}\nline {i % 7}\n" + LONG.replace("mill", f"mill{i}")) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fuzzy_lines.drop_repeated(docs.limit(1)).count() == 1  # the folder exists from here on
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def own():
        # Cut here, the name goes before the random part.
        return {d for d in os.listdir(folder) if d.startswith(("line-", "distinct-lines-")) and os.listdir(f"{folder}/{d}")}

    before = own()
    out = fuzzy_lines.drop_repeated(docs)
    assert {d.rsplit("-", 1)[0] for d in own() - before} == {"line-drops"}
    assert sum(r.n_removed for r in out.collect()) == 20 * 3 - 8


def test_unlike_lines_with_a_phrase_in_common_are_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    phrase = "of the licence that comes with this work and with every copy"
    rows = []
    for i in range(600):
        before, after = ([word() for _ in range(rng.randint(0, 60))] for _ in range(2))
        line = " ".join([*before, phrase, *after])
        rows.append((3 * i, line))
        if i % 3 == 0:  # a near copy in which the place of the phrase moves
            rows.append((3 * i + 1, f"xy {line}" if len(line) >= 40 else line + "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, confirmed = [], fuzzy_lines._confirmed

    def counted(distinct, found):
        pairs.append(found.distinct().count())
        return confirmed(distinct, found)

    monkeypatch.setattr(fuzzy_lines, "_confirmed", counted)
    assert {r.doc_id for r in fuzzy_lines.repeated(docs).collect()} == {i for i, _ in rows if i % 3 == 1}
    # Every two of the lines share a block; only those with as much before and after the phrase are compared.
    assert sum(pairs) < 16 * len(rows)


def test_simhash_of_long_and_short_lines(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (1, 2, 3, 62, 63, 64, 65, 200, 3000)] + [" ".join(["same"] * n) for n in (63, 64)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = {r.word: r.h & (1 << 64) - 1 for r in docs.select(F.explode(F.split("text", " ")).alias("word")).distinct()
              .select("word", F.xxhash64("word").alias("h")).collect()}
    got = {r.doc_id: r.bits & (1 << 64) - 1 for r in docs.select("doc_id", fuzzy_lines.simhash(F.col("text")).alias("bits")).collect()}
    assert got == {i: sum(1 << b for b in range(64) if 2 * sum(hashes[w] >> b & 1 for w in t.split()) > len(t.split())) for i, t in enumerate(texts)}


def fuzzy_lines_norm(line):
    return re.sub(r"[^a-z]+", " ", line).strip()


def _naive(a, b):
    union = sorted(set(a) | set(b))
    x, y = np.array([a.get(e, 0) for e in union], float), np.array([b.get(e, 0) for e in union], float)
    return sum(1 / np.maximum(x / a[d], y / b[d]).sum() for d in a if d in b)


def test_near_groups_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(100)]

    def edit(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    texts = [edit(base, k) for k in [1] * 25 + [2] * 15 + [3] * 12]
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(8):
        chain = edit(chain, 1)
        texts.append(chain)
    texts += [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(40)] + texts[:50:7]
    rows = [(i, " ".join(w), "q") for i, w in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, "q"), (n + 1, "", "q"), (n + 2, "one two", "q"), (n + 3, "One, two!", "q"), (None, "one two", "q"), (5, rows[5][1], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(5)
    sets = {}
    for doc_id, text, _ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        if words and doc_id is not None:
            sets[doc_id] = Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))
    parent = {d: d for d, _, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a].keys() & sets[b].keys() and find(a) != find(b) and _naive(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in probminhash.classes(df).where("doc_id is not null").collect()}
    # Banding may miss a pair close to the threshold; groups held together by one such pair do not occur here.
    assert got == {d: find(d) for d in parent}
    assert probminhash.classes(df.limit(0)).count() == 0
    kept = [r.doc_id for r in probminhash.keep_one(df).collect()]
    assert sorted(d for d in set(kept) if d is not None) == sorted({find(d) for d in parent}) and None in kept


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    a = (np.unique(codes[:220]), rng.integers(1, 5, 220).astype(float))
    b = (np.unique(codes[60:]), rng.integers(1, 5, 240).astype(float))
    true = probminhash.probability_jaccard(a, b)
    naive = _naive(dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1])))
    assert abs(true - naive) < 1e-9
    seen = [(probminhash.sketch(a[0] + np.uint64(k), a[1]) == probminhash.sketch(b[0] + np.uint64(k), b[1])).mean() for k in range(80)]
    assert abs(np.mean(seen) - true) < 0.02


def test_decontamination(spark):
    items = spark.createDataFrame([
        (1, "Then Alice had 12 apples and gave Bob 5 apples; how many apples does Alice keep after 3 days?"), (2, "Short item here"), (3, None),
        (4, ""), (5, "5 6 7 8 9 10 11 12 13")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "x y z. Then Alice had 12 apples and gave Bob 5 apples; how many apples does Alice keep after 3 days? more"),
        (2, "Then Carol had 40 apples and gave Dan 9 apples; how many apples does Carol keep after 3 weeks? more"),
        (3, "Then Carol had 40 apples and gave Dan 9 apples; how many apples does Erin keep after 3 weeks? more"),
        (4, "a short item here now"), (5, None), (6, ""), (7, "apples and pears"), (1, "again"),
        (None, "Then Alice had 12 apples and gave Bob 5 apples; how many apples does Alice keep after 3 days?")],
        "doc_id long, text string").withColumn("windows", F.lit("c"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    # In document 3 one name of the question became two: the slots do not agree.
    assert got == {(1, 1), (2, 1), (4, 2)}
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, items).collect()) == ["3", "5", "6", "7", "None"]
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), items).count() == 0


def _found(spark, items, docs):
    of = lambda texts, name: spark.createDataFrame(list(enumerate(texts, 1)), f"{name} long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.matches(of(docs, "doc_id"), of(items, "item_id")).collect()}


def test_decontamination_of_numbers_and_units(spark):
    items = ["A train travels 60 km in 2 hours and 90 km in 3 hours.", "Compute 12 + 34 - 5 * 6 + 7 / 8 for x = 3 and y = 4", "5 6 7 8 9 10 11 12 13"]
    docs = [f"so it goes. {items[0]} Yes", "so it goes. A train travels 75 km in 4 hours and 80 km in 5 hours. Yes", f"see {items[1]} there",
            "see Compute 21 + 43 - 9 * 1 + 2 / 3 for x = 8 and y = 6 there", f"list {items[2]} end", "list 6 7 8 9 10 11 12 13 14 end",
            "A train travels far in 2 hours"]
    assert _found(spark, items, docs) >= {(1, 1), (2, 1), (3, 2), (5, 3)}
    assert not {d for d, i in _found(spark, items, docs) if d == 7}


def test_decontamination_wherever_a_sentence_opens(spark):
    items = ["Alice had 12 apples. Bob had 5 apples. Carol had 9 apples. How many apples are there in total?",
             "What is the capital city of France today?"]
    docs = ["Dan had 3 apples. Erin had 8 apples. Frank had 7 apples. How many apples are there in total?",
            "so here we ask What is the capital city of France today? and go on", "we ask what is the capital city of Spain today",
            "Dan had 3 apples. Dan had 8 apples. Dan had 7 apples. Nothing else is in there."]
    assert _found(spark, items, docs) == {(1, 1), (2, 2), (3, 2)}


def test_decontamination_with_repeated_items(spark):
    rows = [(1, "one two three four five six seven eight nine ten"), (2, "red green blue")] * 3 + [(2, "wholly other words"), (3, None), (3, None)]
    docs = spark.createDataFrame([(1, "so one two three four five six seven eight nine ten"), (2, "red green blue"), (3, "wholly other words here")], "doc_id long, text string")
    got = {tuple(r) for r in decontaminate.matches(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got == {(1, 1, 3, 1.0), (2, 2, 1, 1.0), (3, 2, 1, 1.0)}


def _remove(rows):
    seen, out = set(), {}
    for doc_id, text in sorted({(d, t or "") for d, t in rows}):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(raw[s:s + 100])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 30):] if rng.random() < 0.5 else "".join(
        rng.choice("abcdefgh ") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [(200, "a" * 1000), (201, "ab" * 300), (202, None), (203, ""), (204, "x" * 99), (205, "a" * 150), (206, rows[3][1]),
             (206, rows[3][1]), (207, "\0" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("q")).withColumn("mark", F.lit(1)).repartition(5)
    out = repeats.remove_repeats(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == _remove(rows)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_merge_never_loses_order():
    rng = random.Random(6)
    items = sorted((bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 12))), b"p", i, 0, 0, 1) for i in range(300))
    runs = [[] for _ in range(7)]
    for item in items:
        rng.choice(runs).append(item)
    before = b""
    merged = list(repeats.merge_runs([repeats.read_run(repeats.write_run(r)) for r in runs]))
    assert [i[0] for _, i in merged] == [i[0] for i in items]
    for same, item in merged:
        assert same == repeats.common(before, item[0], 0)
        before = item[0]
