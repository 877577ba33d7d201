import random

import pytest
from sparkloom.operators import pruning

STRONG = ("CALLS", "READS_FROM", "WRITES_TO")
SCHEMAS = {
    "entities": "ctx string, id string, primary boolean, candidate boolean, changed boolean, distance int, size long",
    "edges": "ctx string, id string, src string, dst string, observed boolean, rel string, size long",
    "requirements": "ctx string, id string, score int, size long",
    "targets": "ctx string, id string, entity string",
    "deltas": "ctx string, id string, place int, size long",
    "holds": "ctx string, kind string, id string, evidence string",
    "evidence": "ctx string, id string, size long",
}


def made(rng, ctx):
    n = rng.randrange(2, 9)
    names = [f"n{i}" for i in range(n)]
    entities = [(ctx, x, rng.random() < 0.3, rng.random() < 0.4, rng.random() < 0.5, rng.randrange(3), rng.randrange(1, 9)) for x in names]
    edges = [(ctx, f"e{i}", rng.choice(names), rng.choice(names), rng.random() < 0.7, rng.choice(["CALLS", "READS_FROM", "USES", None]), rng.randrange(1, 9)) for i in range(rng.randrange(0, 10))]
    requirements = [(ctx, f"r{i}", rng.randrange(3), rng.randrange(1, 9)) for i in range(rng.randrange(0, 4))]
    targets = sorted({(ctx, r[1], rng.choice(names)) for r in requirements for _ in range(2)})
    deltas = [(ctx, f"d{i}", i, rng.randrange(1, 9)) for i in range(rng.randrange(0, 4))]
    evidence = [(ctx, f"v{i}", rng.randrange(1, 20)) for i in range(8)]
    items = [("entity", e[1]) for e in entities] + [("edge", e[1]) for e in edges] + [("requirement", r[1]) for r in requirements] + [("delta", d[1]) for d in deltas]
    holds = sorted({(ctx, *rng.choice(items), rng.choice(evidence)[1]) for _ in range(12)})
    return {"entities": entities, "edges": edges, "requirements": requirements, "targets": targets, "deltas": deltas, "holds": holds, "evidence": evidence}


def plain(found, budget):
    """One item after another until the rest fits."""
    entities, edges = {e[1]: e for e in found["entities"]}, {e[1]: e for e in found["edges"]}
    requirements, deltas = {r[1]: r for r in found["requirements"]}, {d[1]: d for d in found["deltas"]}
    evidence = {v[1]: v[2] for v in found["evidence"]}
    primary = {i for i, e in entities.items() if e[2]}
    strong = {i for i, e in edges.items() if e[4] and e[5] in STRONG and {e[2], e[3]} & primary}

    def kept():
        here = {("entity", i): e[6] for i, e in entities.items()} | {("edge", i): e[6] for i, e in edges.items()} | {("requirement", i): r[3] for i, r in requirements.items()} | {("delta", i): d[3] for i, d in deltas.items()}
        return here | {("evidence", v): evidence[v] for _, kind, i, v in found["holds"] if (kind, i) in here}

    log = []
    while sum(kept().values()) > budget:
        before = kept()
        essential = primary | {t[2] for t in found["targets"] if t[1] in requirements} | {x for i in strong & set(edges) for x in edges[i][2:4]}
        linked = {x for e in edges.values() for x in e[2:4]}
        rest = [e for e in entities.values() if e[1] not in essential]
        weak, alone = [e for e in rest if e[3]], [e for e in rest if e[1] not in linked]
        loose = [e for i, e in edges.items() if i not in strong]
        if weak or alone:
            kind, item = "entity", max(weak or alone, key=lambda e: (e[5], e[1]))[1]
            del entities[item]
            for i in [i for i, e in edges.items() if item in e[2:4]]:
                del edges[i]
        elif loose:
            kind, item = "edge", max(loose, key=lambda e: (not e[4], e[5] != "CALLS", e[1]))[1]
            del edges[item]
        elif requirements:
            kind, item = "requirement", min(requirements.values(), key=lambda r: (r[2], r[1]))[1]
            del requirements[item]
        elif edges:
            kind, item = "edge", max(edges.values(), key=lambda e: (e[5] != "CALLS", e[1]))[1]
            del edges[item]
        elif entities:
            kind, item = "entity", max(entities.values(), key=lambda e: (e[5], not e[4], e[1]))[1]
            del entities[item]
        else:
            kind, item = "delta", max(deltas.values(), key=lambda d: d[2])[1]
            del deltas[item]
        now = kept()
        log.append((kind, item, sum(before.values()) - sum(now.values()), sum(now.values()), len(before) - len(now)))
    return kept(), log


@pytest.mark.parametrize("budget", [0, 20, 60, 1000])
def test_pruning_equals_plain_loop(spark, budget):
    rng = random.Random(budget)
    contexts = {f"c{i}": made(rng, f"c{i}") for i in range(25)}
    frames = {k: spark.createDataFrame([r for c in contexts.values() for r in c[k]], s).repartition(2) for k, s in SCHEMAS.items()}
    stays, log = pruning.pruned(pruning.Context(**frames), budget)
    got, steps = {}, {}
    for r in stays.collect():
        got.setdefault(r.ctx, {})[r.kind, r.id] = r.size
    for r in sorted(log.collect(), key=lambda r: r.step):
        steps.setdefault(r.ctx, []).append((r.kind, r.id, r.freed, r.left, r.gone))
    for name, c in contexts.items():
        want, want_log = plain(c, budget)
        assert steps.get(name, []) == want_log, name
        assert got.get(name, {}) == want


def test_nothing_to_prune(spark):
    frames = {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    stays, log = pruning.pruned(pruning.Context(**frames), 5)
    assert stays.count() == 0 and log.count() == 0


def test_small_and_large_contexts_agree(spark, monkeypatch):
    """Contexts of few rows are cut in one row, larger ones by joins; both are in one call."""
    rng = random.Random(5)
    contexts = {f"c{i}": made(rng, f"c{i}") for i in range(20)}
    frames = {k: spark.createDataFrame([r for c in contexts.values() for r in c[k]], s).repartition(2) for k, s in SCHEMAS.items()}
    sizes = sorted(sum(len(rows) for rows in c.values()) for c in contexts.values())
    monkeypatch.setattr(pruning, "SMALL", sizes[10])
    stays, log = pruning.pruned(pruning.Context(**frames), 20)
    got = {}
    for r in sorted(log.collect(), key=lambda r: r.step):
        got.setdefault(r.ctx, []).append((r.kind, r.id, r.freed, r.left, r.gone))
    assert {n: got.get(n, []) for n in contexts} == {n: plain(c, 20)[1] for n, c in contexts.items()}
    assert {(r.ctx, r.kind, r.id): r.size for r in stays.collect()} == {(n, *k): v for n, c in contexts.items() for k, v in plain(c, 20)[0].items()}
