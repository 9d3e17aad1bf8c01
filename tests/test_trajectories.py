"""Fingerprints with all their columns, ends of lineages, survival rows and rules of several corpora, against plain Python."""

import random
import statistics

import pytest

from driftloom.operators import trajectories as tr

FLAGS = "is_new boolean, is_dead boolean, reborn_after_periods int"
SCHEMA = "corpus string, lineage string, period int, " + ", ".join(f"{c} double" for c in tr.NOW) + ", " + FLAGS


def made(seed: int = 7) -> list[dict]:
    r, rows = random.Random(seed), []
    for corpus in "ab":
        for k in range(8):
            for t in range(r.randint(1, 9)):
                row = {c: (None if r.random() < 0.1 else float(r.randint(0, 9))) for c in tr.NOW}
                row |= {"corpus": corpus, "lineage": f"l{k}", "period": t, "size": float(r.randint(1, 9)), "is_new": t == 0, "is_dead": r.choice([True, False, None]), "reborn_after_periods": r.choice([None, 0, 2])}
                rows.append(row)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def test_fingerprint(spark):
    rows = made()
    df = frame(spark, rows)
    got = {(r.corpus, r.lineage): r.asDict() for r in tr.fingerprint(df).collect()}
    want = {}
    for key in {(r["corpus"], r["lineage"]) for r in rows}:
        own = [r for r in rows if (r["corpus"], r["lineage"]) == key and r["size"] >= 3 and not r["is_new"]]
        if len(own) >= 4:
            w = {c: float(own[-1][c] or 0) for c in tr.NOW}
            w |= {f"{a}_t{n}": float(own[-1 - n][c] or 0) for n, cols in tr.BEFORE.items() for a, c in cols.items()}
            want[key] = {"corpus": key[0], "lineage": key[1]} | w
    assert len(want) > 3 and got == want and len(next(iter(want.values()))) == 2 + 36


def test_fingerprint_of_nulls_ties_and_nothing(spark):
    rows = made()[:9]
    for r in rows:
        r |= {"corpus": None, "size": None}
    assert tr.fingerprint(frame(spark, rows)).count() == 0
    assert tr.fingerprint(frame(spark, [])).count() == 0
    twice = [r | {"corpus": "z", "lineage": "l", "is_new": False, "size": 5.0, "period": 1} for r in made()[:5]]
    assert tr.fingerprint(frame(spark, twice)).count() == 1
    assert tr.fingerprint(frame(spark, twice)).collect() == tr.fingerprint(frame(spark, twice[::-1])).collect()


def test_terminal_rates(spark):
    rows = made(3)
    keys = sorted({(r["corpus"], r["lineage"]) for r in rows}) + [("c", "gone")]
    kind = {k: None if k[1] == "l7" else int(k[1][-1], 36) % 3 for k in keys}
    a = spark.createDataFrame([(*k, v) for k, v in kind.items()], "corpus string, lineage string, archetype int")
    got = {r.archetype: r for r in tr.terminal_rates(a, frame(spark, rows)).collect()}
    assert set(got) == set(kind.values())
    for v, g in got.items():
        own = [k for k in keys if kind[k] == v]
        ends = [([r for r in rows if (r["corpus"], r["lineage"]) == k and r["size"] >= 3] or [None])[-1] for k in own]
        dead = [e for e in ends if e and e["is_dead"]]
        assert g.n == len(own) and g.death_rate == pytest.approx(len(dead) / len(own)) and g.survival_rate == pytest.approx(1 - g.death_rate)
        assert g.mean_drift == pytest.approx(sum((e or {}).get("drift_magnitude") or 0 for e in ends) / len(own))
        assert g.reborn_rate == pytest.approx(sum(((e or {}).get("reborn_after_periods") or 0) > 0 for e in ends) / len(own))
        assert (g.mean_age_dead is None) == (not dead) and g.examples == [k[1] for k in own[:3]]
    assert tr.terminal_rates(a.limit(0), frame(spark, rows)).count() == 0


def test_survival_rows_and_estimate(spark):
    rows = made(5)
    own = [r | {"lineage": r["corpus"] + r["lineage"]} for r in rows]
    got = {r.lineage: r for r in tr.survival_rows(frame(spark, own), ["cohesion", "jerk"]).collect()}
    by = {}
    for r in own:
        by.setdefault(r["lineage"], []).append(r)
    assert set(got) == set(by)
    for c in ("cohesion", "jerk"):
        mid = statistics.median(x[0][c] for x in by.values() if x[0][c] is not None)
        assert {k: v[f"{c}_at_entry"] for k, v in got.items()} == {k: mid if x[0][c] is None else x[0][c] for k, x in by.items()}
    assert all((got[k].duration, got[k].observed_death) == (len(x), int(any(r["is_dead"] for r in x))) for k, x in by.items())
    none = spark.createDataFrame([("x", 1, None, None), (None, 1, 2.0, True)], "lineage string, period int, jerk double, is_dead boolean")
    assert [tuple(r) for r in tr.survival_rows(none, ["jerk"]).collect()] == [("x", 1, 0, 0.0)]
    est = tr.kaplan_meier(spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1)], "duration int, observed_death int")).orderBy("t").collect()
    assert [(r.t, r.dead, r.at_risk) for r in est] == [(1, 1, 4), (2, 1, 2), (3, 1, 1)]
    assert [r.survival for r in est] == pytest.approx([0.75, 0.375, 0.0])


def test_rules_of_corpora(spark):
    r = random.Random(2)
    items, outs = [], []
    for corpus in "abc":
        for k in range(40):
            key = f"{corpus}{k}"
            own = sorted({r.choice("pqr"), r.choice("stu"), "p" if k % 3 == 0 else "q"})
            items += [(corpus, key, i) for i in own] + ([(corpus, key, own[0])] if k % 5 == 0 else [])
            if "p" in own and corpus != "c" or r.random() < 0.3:
                outs.append((corpus, key, "dies"))
    got = tr.rules_by_corpus(spark.createDataFrame(items + [(None, "x", "p"), ("a", None, "p")], "corpus string, key string, item string"), spark.createDataFrame(outs, "corpus string, key string, outcome string"), "key", support=0.05, confidence=0.5, lift=1.1)
    want = {}
    for corpus in "abc":
        keys = {k for c, k, _ in items if c == corpus}
        own = {k: {i for _, kk, i in items if kk == k} for k in keys}
        dies = {k for c, k, _ in outs if c == corpus}
        for s in [(i,) for i in "pqrstu"] + [(i, j) for i in "pqrstu" for j in "pqrstu" if i < j]:
            k = [x for x in keys if own[x] >= set(s)]
            hit = len(dies & set(k))
            if k and hit >= 0.05 * len(keys) and hit / len(k) >= 0.5 and round(hit / len(k) / (len(dies) / len(keys)), 9) >= 1.1:
                want[corpus, "+".join(s)] = (hit / len(k), hit / len(k) / (len(dies) / len(keys)))
    rows = got.collect()
    assert want and {(x.corpus, x.antecedent): (pytest.approx(x.confidence), pytest.approx(x.lift)) for x in rows} == want
    shared = tr.rule_overlap(got).collect()
    assert {x.antecedent: x.corpora for x in shared} == {s: c for s in {s for _, s in want} if len(c := sorted(c for c, t in want if t == s)) >= 2}


def test_threshold_advice(spark):
    def advice(lifts, confidence=0.5):
        rows = spark.createDataFrame([(x, x * confidence) for x in lifts], "lift double, score double")
        return tr.threshold_advice(rows).first()

    assert advice([6.0] * 60 + [1.0] * 500).advice == "lift>5"
    assert advice([4.0] * 60 + [1.0] * 500).advice == "lift>3"
    assert advice([8.0] * 300 + [12.0] * 100).advice == "score>5"
    assert advice([1.0] * 30)["advice"] == "all rules" and advice([1.0] * 300).advice == "none" and advice([4.0] * 300).advice == "lift>3"
    assert tuple(advice([])) == (0, 0, 0, 0, 0, 0, "all rules")
