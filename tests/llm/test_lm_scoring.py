"""The language model against plain loops, numeric gradients, sums over the vocabulary, and unigrams on held-out documents."""

from __future__ import annotations

import math
import os
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agora.llm import lm_scoring as lm
from agora.llm import queries, textkernel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, word string, key long, c long, n int"


def tokens(t):
    return [*WORD.findall((t or "").translate(LOWER)), ""]


def crc(i):
    return zlib.crc32(str(i).encode()) % 7


def rows_of(n):
    """Documents of two invented languages, each a walk in which the next word depends on the one before."""
    rng = random.Random(8)
    out = []
    for i in range(n):
        at, text = rng.randrange(40), []
        for _ in range(rng.randint(0, 60)):
            at = (at * 3 + rng.choice([1, 2])) % 40
            text.append(rng.choice(["Aé", "b"])[: 1 + i % 2] + f"{i % 2}x{at}" + (f"r{rng.randrange(3000)}" if rng.random() < 0.1 else ""))
        out.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return out


@pytest.fixture(scope="module")
def rows():
    made = rows_of(700)
    return made + [(900, None), (901, ""), (902, " \n"), (None, made[3][1]), (None, None), made[5], made[5], (5, "another text of one id"), (903, "W " * 30_000), (904, "y" * 40_000)]


@pytest.fixture(scope="module")
def fitted(spark, rows):
    patch = pytest.MonkeyPatch()
    patch.setattr(lm, "HOT", 2000)  # so that some words are counted by the join
    patch.setattr(lm, "MODELLED", 60)
    patch.setattr(lm, "CLASSES", 6)
    docs = spark.createDataFrame([(*r, None, "w", 1, 2, 3) for r in rows], SCHEMA)
    model = lm.fit(docs)
    yield docs, model, lm.score(docs, model).collect()
    patch.undo()


def test_counts_and_base(rows, fitted):
    c = Counter(w for i, t in rows if i is not None and crc(i) != 2 for w in tokens(t))
    n = sum(c.values())
    assert (fitted[1].n, fitted[1].v) == (n, len(c)) and 60 < len(fitted[1].hot) < len(c)
    wanted = Counter((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in fitted[2]) == wanted


def loops(model, c, text):
    """log10 P of a text, token by token, in double precision and plain Python."""
    w, u = {k: x.astype(float) for k, x in model.net.weights.items()}, model.net.units
    place, h, total = {x.decode(): k for k, x in enumerate(model.hot[: len(model.net.counts)])}, np.zeros(u), 0.0
    rest, kinds = model.rest
    for token in tokens(text):
        k = place.get(token, len(place))
        logits = h @ w["classes"] + w["class_bias"]
        of = int(model.net.class_of[k])
        total += logits[of] - math.log(sum(math.exp(x) for x in logits))
        if k < len(place):
            a, b = model.net.edges[of], model.net.edges[of + 1]
            logits = w["words"][a:b] @ h + w["word_bias"][a:b]
            total += logits[k - a] - math.log(sum(math.exp(x) for x in logits))
        else:
            total += math.log((c[token] + 1) / (rest + kinds + 1))
        x, g = w["inputs"][k], h @ w["gates"]
        z, r = 1 / (1 + np.exp(-x[:u] - g[:u])), 1 / (1 + np.exp(-x[u : 2 * u] - g[u : 2 * u]))
        h = (1 - z) * np.tanh(x[2 * u :] + r * g[2 * u :]) + z * h
    return total / math.log(10)


def test_scores_are_those_of_the_network(rows, fitted):
    c = Counter(w for i, t in rows if i is not None and crc(i) != 2 for w in tokens(t))
    wanted = sorted((repr(i), round(loops(fitted[1], c, t), 1)) for i, t in rows if (i or 0) % 9 == 0 or (i or 0) > 890)
    got = sorted((repr(r.doc_id), round(r.score, 1)) for r in fitted[2] if (r.doc_id or 0) % 9 == 0 or (r.doc_id or 0) > 890)
    assert len(got) == len(wanted) and all(a[0] == b[0] and abs(a[1] - b[1]) <= 0.2 + 1e-4 * abs(b[1]) for a, b in zip(got, wanted))


def test_better_than_unigrams_on_held_out_documents(fitted):
    held = [r for r in fitted[2] if r.doc_id is not None and crc(r.doc_id) == 2 and r.doc_id < 700]
    n = sum(r.n_tokens for r in held)
    assert len(held) > 50 and (sum(r.score for r in held) - sum(r.base_score for r in held)) / n > 0.3


def test_probabilities_add_up_to_one(fitted):
    """All modelled words, and all others as one, after some state; the others' shares and the one of new words."""
    net = fitted[1].net
    n = len(net.counts)
    for state in np.random.default_rng(1).standard_normal((3, net.units)).astype(np.float32):
        logs, _ = net.log_probabilities(np.repeat(state[None], n + 1, 0), np.arange(n + 1))
        assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4


def test_gradients():
    rng = np.random.default_rng(4)
    net = lm.Net(np.array([90.0, 50, 30, 20, 10, 5, 2]), 40.0, units=5)
    net.weights = {k: rng.standard_normal(x.shape) * 0.5 for k, x in net.weights.items()}
    texts = [np.append(rng.integers(0, 8, n), 6).astype(np.int32) for n in (3, 9, 1, 6)]
    part, _, begins = lm.lanes(texts, 3)
    h = rng.standard_normal((part.shape[1], 5))
    _, _, grads = net.window(h, part, begins)
    some, rows = grads["inputs"]
    grads["inputs"] = np.zeros_like(net.weights["inputs"])
    grads["inputs"][some] = rows
    for k, x in net.weights.items():
        for at in [tuple(rng.integers(0, s) for s in x.shape) for _ in range(12)]:
            kept, loss = x[at], []
            for d in (1e-3, -1e-3):
                x[at] = kept + d
                loss.append(net.window(h, part, begins)[0])
            x[at] = kept
            assert abs((loss[0] - loss[1]) / 2e-3 - grads[k][at]) < 2e-3, (k, at)


def test_shares_beyond_the_range_of_numbers():
    logits = np.array([[1000, 999, -1000], [-2000, -2001, -2002], [0, 1, 2]], np.float32)
    logs, shares = lm.softmax(logits.copy(), np.arange(3), np.array([0, 1, 2]), True)
    assert np.allclose(shares.sum(1), 1) and np.allclose(logs, [np.log(1 / (1 + np.exp(-1))), np.log(np.exp(-1) / (1 + np.exp(-1) + np.exp(-2))), np.log(1 / (1 + np.exp(-1) + np.exp(-2)))], atol=1e-4)


def test_state_is_carried_from_window_to_window(monkeypatch):
    net = lm.Net(np.arange(50.0, 0, -1), 10.0)
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 51, n).astype(np.int32) for n in (1, 2, 31, 32, 33, 700, 64)]
    whole = net.score(texts)
    monkeypatch.setattr(lm, "LONG", 5)
    monkeypatch.setattr(lm, "WIDE", 2)
    assert np.allclose(net.score(texts), whole, rtol=1e-4)
    assert np.allclose([net.score([t])[0] for t in texts], whole, rtol=1e-4)


def test_lexicon_tells_misleading_hashes_apart(monkeypatch):
    real = textkernel.stretch_hashes
    monkeypatch.setattr(lm, "stretch_hashes", lambda d, a, b, turn=0: real(d, a, b, turn) % np.uint64(7) if turn > 3 else np.ones(len(a), np.uint64))
    known = lm.Lexicon([b"a", b"bb"])
    found = lm.lowered(pa.array(["A bb ccc d e f g hh a"]))
    assert known.turn > 3 and known.find(found.data, found.starts, found.ends).tolist() == [0, 1, -1, -1, -1, -1, -1, -1, 0]


def test_without_training_documents(spark, tmp_path):
    held = [i for i in range(60) if crc(i) == 2][:3]
    for rows in ([], [(held[0], "Some words"), (held[1], None), (None, "x")]):
        path = str(tmp_path / f"t{len(rows)}")
        spark.createDataFrame([(*r, None, "w", 1, 2, 3) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
        got = queries.op12_lm_scoring(spark, path).collect()
        assert sorted(((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)) == sorted((i or -1, i is not None, len(tokens(t)), 0, 0, 0.0, 0.0) for i, t in rows)


def test_sums_of_models(spark):
    rows = [(float(k), np.full(3, k, np.float32).tobytes()) for k in range(70)]
    models = lm.table(spark.createDataFrame(rows, "weight double, sums binary").repartition(70), "models")
    row = lm.summed(models).first()
    assert row.weight == sum(range(70)) and np.frombuffer(row.sums, np.float32).tolist() == [sum(range(70))] * 3
    assert lm.summed(lm.table(spark.createDataFrame([], "weight double, sums binary"), "models")).first() is None


def test_learning_rule(spark):
    ids = spark.range(200).select(lm.learns(F.col("id")).alias("a"), lm.held_out(F.col("id")).alias("b"), "id").collect()
    assert all(r.a == (crc(r.id) != 2) and r.b == (crc(r.id) == 2) for r in ids)


def test_every_training_document_trains_the_network(spark, monkeypatch, tmp_path):
    """The trainers' documents of all rounds together are the training documents, each once, the judges among them."""
    seen = str(tmp_path)
    learn = lm.Net.learn

    def noted(net, texts, squares):
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(str(len(x)) for x in texts))
        return learn(net, texts, squares)

    rows = [(k, "so it goes " * k) for k in range(1, 300)]
    texts = [np.full(3 * k + 1, 1, np.int32) for k, _ in rows]
    monkeypatch.setattr(lm.Net, "learn", noted)
    net = lm.Net(np.array([50.0, 40.0, 30.0]), 10.0)
    net.train(texts)
    read = [x for name in os.listdir(seen) for x in open(f"{seen}/{name}").read().split("\n")]
    assert {int(x) for x in read} == {len(x) for x in texts}

    def trainer(net, known, end, memory):
        def run(batches):
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    with open(f"{seen}/taken-{uuid.uuid4().hex}", "w") as f:
                        f.write(str(len(t.split()) // 3))
            yield from ()

        return run

    monkeypatch.setattr(lm, "trainer", trainer)
    model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    taken = sorted(int(open(f"{seen}/{x}").read()) for x in os.listdir(seen) if x.startswith("taken-"))
    assert taken == [k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    model.counts.count()


def test_a_long_text_is_scored_in_few_windows(monkeypatch):
    """Where few lanes are left, a window has more steps: the work beside the recurrence is done for many tokens at once."""
    calls, softmax = [], lm.softmax
    monkeypatch.setattr(lm, "softmax", lambda *args: calls.append(1) or softmax(*args))
    net = lm.Net(np.arange(50.0, 0, -1), 10.0)
    texts = [np.random.default_rng(3).integers(0, 51, n).astype(np.int32) for n in (20_000, 300, 5)]
    whole = net.score(texts)
    assert len(calls) < 300  # 417 windows of 48 steps took thousands
    monkeypatch.setattr(lm, "PIECE", 100)
    assert np.allclose(net.score(texts), whole, rtol=1e-4)


def stepwise(net, h, tokens, begins):
    """Loss, state and gradients of a window, lane by lane and token by token, in plain loops."""
    w, u, n = net.weights, net.units, int((tokens >= 0).sum())
    grads, loss, after = {k: np.zeros_like(x) for k, x in w.items()}, 0.0, h.copy()
    for lane in range(tokens.shape[1]):
        past = []
        for t in range(len(tokens)):
            s = np.zeros(u) if begins[t, lane] else after[lane].copy()
            x, g = w["inputs"][max(0, tokens[t, lane])], s @ w["gates"]
            z, r = (1 / (1 + np.exp(-x[a : a + u] - g[a : a + u])) for a in (0, u))
            new = np.tanh(x[2 * u :] + r * g[2 * u :])
            past.append((s, z, r, new, g[2 * u :]))
            after[lane] = (1 - z) * new + z * s
        dh = np.zeros(u)
        for t in range(len(tokens) - 1, -1, -1):
            s, z, r, new, q = past[t]
            da = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (s - new) * z * (1 - z), da * q * r * (1 - r)
            dg, back = np.concatenate([dz, dr, da * r]), np.zeros(u)
            grads["gates"] += np.outer(s, dg)
            if (k := tokens[t, lane]) >= 0:
                grads["inputs"][k] += np.concatenate([dz, dr, da])
                a, b = (*net.edges, len(net.counts))[net.class_of[k] :][:2]
                for name, bias, columns, chosen in (("classes", "class_bias", slice(None), net.class_of[k]), ("words", "word_bias", slice(a, b), k - a)):
                    if name == "words" and k == len(net.counts):
                        continue
                    rows = w["classes"].T if name == "classes" else w["words"][columns]
                    share = np.exp(rows @ s + w[bias][columns])
                    share /= share.sum()
                    loss -= np.log(share[chosen]) / n
                    share[chosen] -= 1
                    back += share @ rows / n
                    grads[bias][columns] += share / n
                    part = np.outer(share, s) / n
                    grads[name][columns] += part.T if name == "classes" else part
            dh = dh * z + w["gates"] @ dg + back
            if begins[t, lane]:
                dh[:] = 0
    return loss, after, grads


def test_window_is_that_of_plain_loops(monkeypatch):
    """Lanes that end early, texts that begin inside, tokens that occur often, pieces that end inside classes."""
    monkeypatch.setattr(lm, "CLASSES", 5)
    rng = np.random.default_rng(9)
    net = lm.Net(np.array([90.0, 50, 30, 20, 10, 9, 8, 7, 6, 5, 4, 2]), 40.0, units=3)
    net.weights = {k: rng.standard_normal(x.shape) * 0.7 for k, x in net.weights.items()}
    tokens, _, begins = lm.lanes([rng.integers(0, 13, n).astype(np.int32) for n in (7, 12, 1, 5, 3, 9)], 4)
    h = rng.standard_normal((tokens.shape[1], 3))
    wanted = stepwise(net, h, tokens, begins)
    for piece in (lm.PIECE, 4):
        monkeypatch.setattr(lm, "PIECE", piece)
        loss, after, grads = net.window(h, tokens, begins)
        some, rows = grads["inputs"]
        grads["inputs"] = np.zeros_like(net.weights["inputs"])
        grads["inputs"][some] = rows
        assert abs(loss - wanted[0]) < 1e-9 and np.allclose(after, wanted[1])
        assert all(np.allclose(grads[k], x, atol=1e-9) for k, x in wanted[2].items())


def test_trainers_know_the_modelled_words(monkeypatch):
    """Numbers of words are looked up in their list; all others have the next number, the end its own."""
    known, seen = [b"so", b"", "Ä".encode(), b"it"], []
    monkeypatch.setattr(lm.Net, "train", lambda net, texts, memory=None: seen.extend(texts) or np.zeros(1, np.float32))
    texts = pa.array(["So IT goes\tÄ ä", None, "", "it"])
    list(lm.trainer(lm.Net(np.array([4.0, 3, 2, 1]), 5.0), known, 1, None)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    assert [x.tolist() for x in seen] == [[0, 3, 4, 2, 4, 1], [1], [1], [3, 1]]
