"""Trained language profiles against plain Python."""

import math
import re
from collections import Counter

import pytest

from cantoria.operators import language as lg

TEXTS = {"es": "el perro come la comida que le gusta y la casa es grande", "en": "the dog eats the food that it likes and the house is big",
         "fr": "le chien mange la nourriture qu'il aime et la maison est grande où ça"}


def grams(text):
    s = re.sub(r"[^a-zà-ÿ]+", " ", (text or "").lower()).strip()
    s = f" {s} "
    return [s[i:i + 3] for i in range(len(s) - 2)] if len(s) > 2 else []


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, " ".join(TEXTS[v].split()[i % 3:]) + " " + TEXTS[v], v) for i, v in enumerate(list(TEXTS) * 10)]
    data += [(100, None, "es"), (101, "", "en"), (102, "123 --", "fr"), (103, "the dog", None), (104, "zzxqj wkvvz qqxzj " * 3, None), (105, "la maison " * 20_000, None)]
    return spark.createDataFrame(data, "id int, text string, lang string").repartition(4)


def test_profiles_equal_python(rows):
    model, least = lg.learn(rows, "id", "text", "lang", top=40)
    train = [(r.text, r.lang) for r in rows.collect() if r.lang]
    counts = {v: Counter(g for t, l in train if l == v for g in grams(t)) for v in sorted(TEXTS)}
    tops = {v: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:40]) for v, c in counts.items()}
    logp = {v: {g: math.log((n + 0.5) / sum(counts[v].values())) for g, n in tops[v].items()} for v in tops}
    got = {r.id: r for r in lg.detect(rows, model, least, "id", "text").collect()}
    for r in rows.collect():
        own = grams(r.text)
        assert got[r.id].n == len(own)
        if own:
            means = {v: sum(logp[v].get(g, math.log(0.5 / sum(counts[v].values()))) for g in own) / len(own) for v in logp}
            assert got[r.id].media == pytest.approx(max(means.values()))
            best = max(sorted(means), key=means.get)
            assert got[r.id].idioma == (best if max(means.values()) >= least[best] else "desconocido")
    assert all(got[r.id].idioma == r.lang for r in rows.collect() if r.lang and grams(r.text))
    assert [got[i].idioma for i in (100, 101, 102, 104)] == ["desconocido"] * 4 and got[103].idioma == "en"


def test_edges(rows):
    model, least = lg.learn(rows, "id", "text", "lang")
    assert lg.detect(rows.limit(0), model, least, "id", "text").count() == 0
    plan = lg.detect(rows, model, least, "id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trigrams_of_a_text_are_not_shuffled(rows):
    model, least = lg.learn(rows, "id", "text", "lang", top=40)
    plan = lg.detect(rows, model, least, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
