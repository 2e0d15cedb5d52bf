"""The filter audit against filters applied one after the other, in every order."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa

from agora.llm import filter_audit, textkernel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, mask int, part string, n long"


def verdicts(t):
    w = WORD.findall(t)
    return [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]


def wanted(rows, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = [(i, lang or "", [*verdicts(t or ""), i is not None and least[t or ""] < i]) for i, t, lang in rows]
    out = {}
    for part in {p for _, p, _ in docs}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in docs if p == part]
            away = []
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                gone = [(i, f) for i, f in left if f[k]]
                redundant = sum(f[k] for _, f in away)
                left, away = [x for x in left if not x[1][k]], away + gone
                alone = sum(f[k] and sum(f) == 1 for _, p, f in docs if p == part)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[name] += len(gone)
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "p", 9) for r in rows], SCHEMA)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in got}


def test_audit(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcXYé") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([60, 400])]) + rng.choice(["", "", "\n", "|" if rng.random() < 0.02 else ""]) for _ in range(rng.choice([20, 99, 100, 130, 300]))) for _ in range(60)]
    texts += [None, "", " \n\t", "A", "é" * 9 + "A", "é" * 8 + "A", "$", " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k % 80}" for k in range(100)), " ".join(f"w{k % 79}" for k in range(100)), "a" * 50_000, "w " * 40_000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, "", "it"])) for i in range(400)]
    rows += [rows[3], rows[3], (3, "another text of one id", "en"), (None, rows[5][1], "en"), (None, rows[5][1], "en"), (None, None, None), (9000, None, "zz")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 410, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert found(spark, rows, labels) == wanted(rows, labels)


def test_empty_and_single(spark):
    assert found(spark, [], []) == {}
    one = [(1, None, None)]
    assert found(spark, one, []) == wanted(one, [])


def test_distinct_words_survive_misleading_hashes(monkeypatch):
    texts = pa.array(["a b a bb", "", "b b b", "aa a"])
    found = textkernel.words(texts)
    assert filter_audit.distinct_words(found).tolist() == [3, 0, 1, 2]
    real = textkernel.stretch_hashes
    monkeypatch.setattr(filter_audit, "stretch_hashes", lambda d, a, b, turn=0: real(d, a, b, turn) if turn else np.ones(len(a), np.uint64))
    assert filter_audit.distinct_words(found).tolist() == [3, 0, 1, 2]
