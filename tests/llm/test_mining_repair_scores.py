"""Hard negatives, conversation repair and language-model scores against brute force."""

import hashlib
import math
import random
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from lamina.llm import attention, conversations, hard_negatives, language_model

PATH = public_tokenizers.path("byte_bpe_50k.json")


# hard negatives


def _negatives(rows, is_anchor):
    good = list(dict.fromkeys(
        (i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, y, v in rows
        if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)))
    out = []
    for i, y, v in good:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z == y) for j, z, w in good if j != i)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            far = [(n, -t) for t, n, same in scored if not same and -50 * s <= -100 * t <= -95 * s]
            out += [(i, p, r + 1, n, -s, t) for r, (n, t) in enumerate(far[:3])]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 24)
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    monkeypatch.setattr(hard_negatives, "OPENED", 2)
    monkeypatch.setattr(hard_negatives, "PAGE", 3)
    monkeypatch.setattr(hard_negatives, "MEETINGS", 2)
    rng = random.Random(3)
    # Few distinct values, so that scores tie often; label 2 holds most rows, and one vector stands many times.
    rows = [(i, rng.choice([0, 1, 2, 2, 2]), [rng.choice([-0.5, 0.25, 0.3, 1.0]) for _ in range(rng.choice([4, 4, 4, 3, 0]))]) for i in range(150)]
    rows += [(200 + i, i % 3, [0.25, 0.3, 1.0, 0.25]) for i in range(40)]
    rows += [(300, None, [1.0] * 4), (None, 1, [1.0] * 4), (301, 1, None), (305, 1, [float("nan")] * 4), (310, 1, [None, 1.0, 1.0, 1.0]),
             (315, 0, [float("-inf")] * 4), *rows[:6], (5, 1, [1.0, 1.0, 1.0, 0.25]), (320, 7, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, y, "x") for i, y, v in rows], "vec_id long, embedding array<float>, label int, score string")
    df = df.withColumn("a", F.lit(1)).withColumn("block", F.lit("z"))
    out = hard_negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, out.collect())) == _negatives(rows, lambda i: i % 5 == 0)
    for few in (df.limit(0), df.where("vec_id = 10"), df.where("label = 7"), df.where("embedding is null")):
        assert hard_negatives.mine(few, F.col("vec_id") % 5 == 0).count() == 0


def test_hard_negatives_of_large_components(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * 3e6 for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, y) for i, y, v in rows], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 4 == 0).collect())) == _negatives(rows, lambda i: i % 4 == 0)


def test_boxes_bound_scores():
    rng = np.random.default_rng(5)
    v, q = rng.integers(-300, 300, (500, 8)), rng.integers(-300, 300, (20, 8))
    cuts = hard_negatives.leaves(v, [3, 1, 0], 16)
    assert sorted(np.concatenate(cuts).tolist()) == list(range(500)) and max(map(len, cuts)) <= 16
    for rows in cuts:
        least, most = hard_negatives.intervals(q, v[rows].min(axis=0)[None], v[rows].max(axis=0)[None])
        assert (least <= q @ v[rows].T).all() and (q @ v[rows].T <= most).all()


# conversation repair


def _fits(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (len(body) > 0 and len(body) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(body)))


def _brute(rows):
    """(cost, audit, roles): every sequence of edits with up to two inserts before each row and at the end."""
    best = None
    ways = []
    for role, fault in rows:
        own = [("D", "", 4)]
        if fault != "gone":
            more = 3 if fault == "cut" else 0
            own += [("K", role[:1] or "?", more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        ways.append(own)
    adds = ["", "u", "a", "ua", "au"]
    for edits in product(*ways):
        for before in product(adds, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for i, add in enumerate(before):
                roles, audit, cost = roles + add, audit + "I" * len(add), cost + 3 * len(add)
                if i < len(edits):
                    letter, role, price = edits[i]
                    roles, audit, cost = roles + role, audit + letter, cost + price
            if (best is None or (cost, audit) < best[:2]) and _fits(roles):
                best = (cost, audit, roles)
    return best


def test_run_length_steps_against_brute_force():
    rng = random.Random(6)
    machine = conversations.Machine()
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["fine", "fine", "cut", "gone"])) for _ in range(rng.choice([0, 1, 2, 3]))]
        symbols = ["suat".index(r[0]) * 3 + ["fine", "cut", "gone"].index(f) for r, f in rows]
        audit, state = machine.unroll(symbols, [1] * len(symbols), conversations.EMPTY, conversations.TAIL)
        cost = conversations.TAIL
        for s in symbols[::-1]:
            cost = machine.advance(s, 1, cost)
        assert (int(cost[0]), audit + conversations.TAIL_LETTERS[state]) == _brute(rows)[:2]


def test_long_runs_and_stretches(monkeypatch):
    machine = conversations.Machine()
    rng = random.Random(7)
    runs = [rng.randrange(12) for _ in range(30)]
    counts = [rng.choice([1, 2, 5, 70]) for _ in runs]
    single = [s for s, n in zip(runs, counts) for _ in range(n)]
    whole = machine.unroll(single, [1] * len(single), conversations.EMPTY, conversations.TAIL)
    monkeypatch.setattr(conversations, "UNROLLED", 8)
    assert machine.unroll(runs, counts, conversations.EMPTY, conversations.TAIL) == whole
    # Two stretches, the second one's costs by its product.
    a, b = (runs[:13], counts[:13]), (runs[13:], counts[13:])
    to_come = conversations.times(machine.product(*map(np.array, b)), conversations.TAIL)
    first, state = machine.unroll(*a, conversations.EMPTY, to_come)
    second, end = machine.unroll(*b, state, conversations.TAIL)
    assert (first + second, end) == whole
    # Cut rows are cheapest deleted; every second good one becomes an answer.
    assert machine.advance(4, 10**6, conversations.TAIL)[0] == 4 * 10**6
    assert machine.advance(3, 10**6, conversations.TAIL)[0] == 3 * 10**6 // 2


def _expected(rows):
    """What ``repair`` finds for the (turn, role, text) rows of one conversation, by plain dynamic programming."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not solid else "again" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else "fine")
        seen.add((role, text))
    states = {"": (0, "", [])}
    for (_, role, text), fault in [*zip(rows, faults), ((0, "", ""), None)]:
        grown = {}

        def offer(state, value):
            if state not in grown or value[:2] < grown[state][:2]:
                grown[state] = value

        for state, (cost, audit, made) in states.items():
            for n in range(3):
                if fault is None:
                    offer(state, (cost, audit, made))
                else:
                    offer(state, (cost + 4, audit + "D", made))
                    if fault in ("cut", "fine"):
                        more = 3 if fault == "cut" else 0
                        after = "a" if state == "u" else "u"
                        offer(after, (cost + 3 + more, audit + "R", [*made, (("user", "assistant")["ua".index(after)], text)]))
                        if (role[:1], state) in (("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")):
                            offer(role[:1], (cost + more, audit + "K", [*made, (role, text)]))
                state = "a" if state == "u" else "u"
                cost, audit, made = cost + 3, audit + "I", [*made, (("user", "assistant")["ua".index(state)], "")]
        states = grown
    cost, audit, made = min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("again"), faults.count("cut"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()), made


def test_repair_against_brute_force(spark):
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Fine.", "No end", "", " \t", None, "Again!", "Ends? ", "é."]
    rows = [(i % 7, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts)) for i in range(90)]
    rows += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (100, None, "user", "x"), (101, 3, "assistant", "long " * 50_000 + ".")]
    # One conversation with most of the rows, long runs and identical rows: it reaches over partitions.
    rows += [(50, t, ("user", "assistant")[t % 2] if t < 300 else "user", f"{t}." if t % 11 else "same.") for t in range(700)]
    rows += [(50, 20, "user", "same.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("x")).withColumn("conv", F.lit(1))
    known = spark.createDataFrame([(i,) for i in [*range(7), None, 50, 100, 101, 77]], "conv_id long")
    out = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df, known).collect()}
    want = {c: _expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert out == {c: x[0] for c, x in want.items()} | {77: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    edits = conversations.plan(df.drop("audit", "conv"))
    made = {}
    for r in conversations.repaired(df.drop("audit", "conv"), edits).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert made == {c: x[1] for c, x in want.items() if x[1]}
    assert conversations.repair(df.limit(0)).count() == 0


# language model


def _texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "lo", "mi", "tre", "É", "9"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(60)]
    return [" ".join(words[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.choice([3, 30, 120]))) for _ in range(n)]


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "DICTIONARY", 20)
    monkeypatch.setattr(language_model, "SECTION", 200)
    monkeypatch.setattr(language_model, "TOGETHER", 500)
    monkeypatch.setattr(language_model, "COUNTED", 30)
    texts = _texts(60, 9)
    rows = [(i, t) for i, t in enumerate(texts)] + [
        (60, None), (61, ""), (None, "kalo KALO"), (62, " \t\n"), (63, "\x0bKA\x85b\xa0c \x1f"), (64, "w" * 900 + " " + "É" * 300),
        (3, texts[3]), (3, "mi other words"), (65, "lo " * 3000), (66, "<|endoftext|> a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("word", F.lit("y"))
    learned = F.col("doc_id") % 5 != 0
    found = language_model.score(df, learned, PATH).collect()
    split = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in rows if i is not None and i % 5 for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(split(t)), sum(c[w] > 0 for w in split(t)),
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for i, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found)
    assert got == want and {r.train_tokens for r in found} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert language_model.score(df.limit(0), learned, PATH).count() == 0
    alone = language_model.score(df.where("doc_id % 5 = 0"), learned, PATH).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in alone)


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(10)
    size = 12
    opens = np.array([True] * 4 + [False] * 8 + [True])
    model = attention.fresh(rng.integers(0, 50, size + 1), opens).fold()
    tokens = rng.integers(0, size, 70)
    logs, opening = attention.log_probs(model, tokens, np.array([70]))
    for at in (0, 5, 31, 32, 40, 69):
        every = []
        for t in range(size + 1):
            changed = tokens.copy()
            changed[at:] = t  # whatever follows may not matter to what came before, nor to this place but by its own id
            other, other_opening = attention.log_probs(model, changed, np.array([70]))
            assert np.allclose(other[:at], logs[:at], atol=1e-5)
            assert abs(other_opening[at] - opening[at]) < 1e-5
            every.append(10 ** other[at])
        assert abs(sum(every) - 1) < 1e-4
        assert abs(sum(x for x, o in zip(every, opens) if o) - 10 ** opening[at]) < 1e-4


def test_gradients_and_training():
    rng = np.random.default_rng(11)
    model = attention.fresh(np.arange(1, 22), np.ones(21, bool))
    steps = [int(x) for x in rng.permutation(20)]
    texts = [np.array([steps[(s + i) % 20] for i in range(50)]) for s in range(20)]
    w = np.concatenate([attention.windows(t, np.array([50]), model) for t in texts])
    ids, g, _ = attention._gradients(model, w[:6])
    for name, x in model.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        mine = (ids[at[0]], at[1]) if name == "e" else at
        held = x[mine]
        x[mine] = held + 1e-2
        up = attention._gradients(model, w[:6])[2]
        x[mine] = held - 1e-2
        down = attention._gradients(model, w[:6])[2]
        x[mine] = held
        assert abs((up - down) / 2e-2 - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-4
    before = attention._gradients(model, w)[2]
    attention.train(model, w, passes=30, batch=8)
    assert attention._gradients(model, w)[2] < 0.3 * before


def test_held_out_beats_the_word_model(spark):
    rows = [(i, t) for i, t in enumerate(_texts(400, 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = language_model.score(df, F.col("doc_id") % 10 != 0, PATH).where("doc_id % 10 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 1.1 * out[1]


def test_attention_learns_from_every_window(spark, monkeypatch):
    texts = [f"{t} {i}" for i, t in enumerate(_texts(40, 13) * 60)] + [" ".join(_texts(40, 14))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moves, kept = [], language_model.keep
    monkeypatch.setattr(language_model, "SHARD", 1 << 14)
    monkeypatch.setattr(language_model, "keep", lambda d, name: moves.append(kept(d, name)) or moves[-1] if name == "moves" else kept(d, name))
    learned = F.col("doc_id") % 10 != 0
    found = {r.doc_id: r.score for r in language_model.score(df.repartition(2), learned, PATH).collect()}
    ids = [language_model.pieces(t.encode().lower().split(), PATH)[1].sum() + 1 for i, t in enumerate(texts) if i % 10]
    rows = language_model._encoder(PATH).get_vocab_size() + 3  # the embeddings; what follows is moved by every window
    assert sum(m.where(F.col("id") == rows).agg(F.sum("weight")).first()[0] for m in moves) == sum(-(-n // attention.SCORED) for n in ids)
    again = {r.doc_id: r.score for r in language_model.score(df.repartition(5), learned, PATH).collect()}
    assert found.keys() == again.keys() and all(abs(found[k] - again[k]) < 1e-4 * abs(found[k]) for k in found)
