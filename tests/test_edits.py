"""Edit logs against a plain replay over lists of edges, and what must hold after any edit."""

import random

from pixelmill import catalog
from pixelmill.operators.registry import EFFECTS
from pixelmill.plans import edits

TAKES = {"levels": ["in", "mask"], "invert": ["in", "mask"], "bayer-4": ["in", "mask"], "feedback": ["in", "mask", "feedback"], "gen-noise": []}


def leads(edges, start, goal):
    return start == goal or any(leads(edges, t, goal) for s, t, p in edges if s == start and p != "feedback" and t != s)


def plain(log):
    """Each edit's code and the graph after it, from lists searched anew each time."""
    out, nodes, edges, masked, output = [], [], [], set(), None
    effect = dict
    for op, a, b, port in log:
        ids, effect, code = [n for n, _ in nodes], dict(nodes), None
        if op == "connect":
            others = [e for e in edges if e[1:] != (b, port)]
            if a not in ids or b not in ids:
                code = "unknown-node"
            elif port not in TAKES[effect[b]]:
                code = "unknown-port"
            elif port == "feedback":
                code = None if a == b else "unsupported-feedback"
            elif a == b:
                code = "self-edge"
            elif port == "mask" and b not in masked:
                code = "mask-not-wanted"
            elif leads(others, b, a):
                code = "would-cycle"
            edges = edges if code else [*others, (a, b, port)]
        elif op == "disconnect":
            code = None if any(e[1:] == (b, port) for e in edges) else "nothing-connected"
            edges = [e for e in edges if e[1:] != (b, port)]
        elif op == "add":
            code = "duplicate-node-id" if a in ids else "unknown-node" if port is not None and port not in ids else None
            if code is None:
                nodes.append((a, b))
                if port is None:
                    output = output or a
                else:
                    edges = [(a if s == port and p != "feedback" else s, t, p) for s, t, p in edges] + [(port, a, "in")]
                    output = a if output == port else output
        elif op == "remove":
            code = None if a in ids else "unknown-node"
            if code is None:
                above = next((s for s, t, p in edges if (t, p) == (a, "in")), None)
                if above is None:
                    masked -= {t for s, t, p in edges if s == a and p == "mask"}
                edges = [(above if s == a else s, t, p) for s, t, p in edges if t != a and (s != a or above)]
                nodes = [n for n in nodes if n[0] != a]
                masked -= {a}
                if output == a:
                    output = above or (nodes[-1][0] if nodes else None)
        elif op == "output":
            code = None if a is None or a in ids else "unknown-node"
            output = output if code else a
        elif op == "mask":
            code = None if a in ids else "unknown-node"
            if code is None:
                masked = masked | {a} if b == "on" else masked - {a}
                edges = edges if b == "on" else [e for e in edges if e[1:] != (a, "mask")]
        else:
            code = "unknown-edit"
        shown = ",".join(f"{s}>{t}.{p}" for t, p, s in sorted((t, p, s) for s, t, p in edges))
        out.append((code, len(nodes), shown, output))
    return out


def random_log(rng, n):
    name = lambda: f"n{rng.randrange(6)}"
    kinds = {
        "connect": lambda: (name(), name(), rng.choice(["in", "in", "mask", "feedback", "x"])), "disconnect": lambda: (None, name(), rng.choice(["in", "mask"])),
        "add": lambda: (name(), rng.choice(list(TAKES)), rng.choice([None, name()])), "remove": lambda: (name(), None, None), "output": lambda: (rng.choice([None, name()]), None, None),
        "mask": lambda: (name(), rng.choice(["on", "on", "off"]), None), "paint": lambda: (None, None, None),
    }
    return [(op, *kinds[op]()) for op in rng.choices(list(kinds), [8, 2, 5, 2, 1, 2, 1], k=n)]


def test_replay(spark):
    assert all(list(edits.ports_of(e)) == p for e, p in TAKES.items() if e in EFFECTS)
    rng = random.Random(6)
    logs = {d: random_log(rng, rng.choice([1, 40, 200])) for d in range(25)}
    rows = [(d, i, *e) for d, log in logs.items() for i, e in enumerate(log)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "doc long, nth long, op string, a string, b string, port string").repartition(5)
    got = {(r.doc, r.nth): (r.code, r.nodes, r.edges, r.output) for r in edits.replay(log).collect()}
    assert got == {(d, i): x for d, own in logs.items() for i, x in enumerate(plain(own))}
    assert len({code for code, *_ in got.values()}) >= 10
    last = {r.doc: (r.edges, r.output) for r in edits.final_edges(log).collect()}
    assert last == {d: got[d, len(own) - 1][2:] for d, own in logs.items()}
    assert edits.replay(log.where("false")).count() == 0


def test_query(spark):
    """The registered log, edit by edit."""
    sf_dir = "/root/testdata/sf0.001"
    from pixelmill import files
    from pixelmill.plans.rel import Spark

    log = {}
    for r in Spark(spark, sf_dir).table("events", *files.EDIT_LOG).df.orderBy("doc", "nth").collect():
        log.setdefault(r.doc, []).append((r.nth, (r.op, r.a, r.b, r.port)))
    expect = {(d, n): x for d, own in log.items() for (n, _), x in zip(own, plain([e for _, e in own]), strict=True)}
    got = {(r.doc, r.nth): (r.code, r.nodes, r.edges, r.output) for r in catalog.queries()["graph_edits"](spark, sf_dir).collect()}
    assert got == expect and len({code for code, *_ in got.values()}) >= 6
