"""Motif operators against plain loops over random graphs, and against hand-made cases."""

import random

import pytest

from flowloom.operators import model, motifs
from flowloom.operators.ledger import first_outflows, ledger
from flowloom.plans import registry

SCHEMA = "src string, dst string, block_number long, value decimal(38,0), behaviour string, asset string, tie long"


def graph(spark, edges):
    """Edges as (src, dst, block, value[, behaviour, asset])."""
    from decimal import Decimal

    rows = [(e[0], e[1], e[2], Decimal(e[3]), *(e[4:] or ("ET", "t0")), i) for i, e in enumerate(edges)]
    return spark.createDataFrame(rows, SCHEMA)


def parse(text):
    """``a→b@1:100`` separated by commas."""
    out = []
    for part in text.split(","):
        ends, rest = part.strip().split("@")
        block, value = rest.split(":")
        out.append((*ends.split("→"), int(block), int(value)))
    return out


def members(df):
    return {(r["channel"], tuple(r["members"].split(","))) for r in df.collect()}


def native(df):
    return {m for c, m in members(df)}


# --- loops


def channels(edges):
    out = {}
    for i, e in enumerate(edges):
        behaviour, asset = e[4:] or ("ET", "t0")
        out.setdefault(asset if behaviour == "TT" else "", []).append((*e[:4], i))
    return out


def halves(edges):
    by = {}
    for s, d, b, v, i in edges:
        if v:
            by.setdefault(s, []).append((b, i, "O", d, v))
            by.setdefault(d, []).append((b, i, "I", s, v))
    return {n: sorted(h) for n, h in by.items()}


def loop_ledger(h):
    """Windows of one node in order: (senders, largest, inflow, out, before, balance)."""
    balance, before, rows = 0, -(10**9), []
    for b, _, d, _, v in [x for x in h if x[2] == "O"]:
        inside = [x for x in h if x[2] == "I" and before <= x[0] < b]
        total = sum(x[4] for x in inside)
        after = max(0, balance + total - v)
        rows.append(({x[3] for x in inside}, max((x[4] for x in inside), default=0), total, v, balance, after))
        balance, before = after, b
    return rows


def loop_relays(h, rule):
    for x, y in zip(h, h[1:], strict=False):
        if x[2] == "I" and y[2] == "O" and (x[4] == y[4] if rule == "equal" else 0 <= x[4] - y[4] and y[4] >= 10 * (x[4] - y[4])):
            yield x[3], y[3], x[4], y[4]


def loop_groups(edges):
    found = {k: set() for k in ("sg1", "sg1_loose", "deposit", "sg2", "sg2_loose", "recipient", "airdrop")}
    add = lambda k, c, m: found[k].add((c, tuple(sorted(m)))) if len(m) > 1 else None
    for c, es in channels(edges).items():
        hs = halves(es)
        relays, exact = [], []
        for n, h in hs.items():
            for senders, top, total, out, before, _ in loop_ledger(h):
                if top > 0 and top >= 10 * (total - out):
                    add("sg1", c, senders)
                    add("sg1_loose", c, senders | {n})
                if top > 0 and top >= 10 * (total + before - out):
                    add("deposit", c, senders | {n})
            relays += [(n, *r) for r in loop_relays(h, "ratio")]
            exact += [(n, *r) for r in loop_relays(h, "equal")]
        for a in relays:
            add("recipient", c, {a[0], a[2]})
            if c:
                add("airdrop", c, {a[0], a[2]})
            for b in relays:
                if a[0] != b[0] and a[1:3] == b[1:3]:
                    add("sg2", c, {a[0], b[0]})
                    add("sg2_loose", c, {a[0], b[0], a[2]})
        for a in exact:
            for b in exact:
                if c and a[0] != b[0] and a[1:] == b[1:]:
                    add("airdrop", c, {a[0], b[0]})
    return found


@pytest.mark.parametrize("seed", range(4))
def test_against_loops(spark, seed):
    """Few nodes, blocks and values: ties, self-loops, zero values, empty windows and clamped balances all occur."""
    rng = random.Random(seed)
    node = lambda: f"n{rng.randint(0, 11)}"
    edges = [(node(), node(), rng.randint(0, 60), rng.choice([0, 1, 5, 9, 10, 10, 11, 100, 110]), rng.choice(["ET", "SCC", "TT", "TT"]), rng.choice(["t0", "t1"])) for _ in range(900)]
    want, g = loop_groups(edges), graph(spark, edges)
    half = model.half_edges(g)
    slices = (1, 7, 20, 1000)[seed]
    led = ledger(half, slices)
    got = {(r["channel"], r["node"], r["out_rn"]): (set(r["senders"] or []), int(r["mx"] or 0), int(r["s_in"]), int(r["out_value"]), int(r["bal_before"]), int(r["bal"])) for r in led.collect()}
    assert got == {(c, n, i + 1): row for c, es in channels(edges).items() for n, h in halves(es).items() for i, row in enumerate(loop_ledger(h))}
    relays = motifs.relay_pairs(half, slice_blocks=slices)
    assert members(motifs.codeposit_groups(led)) == want["sg1"]
    assert members(motifs.codeposit_groups(led, strict=False)) == want["sg1_loose"]
    assert members(motifs.deposit_side_groups(led)) == want["deposit"]
    assert members(motifs.parallel_relay_groups(relays)) == want["sg2"]
    assert members(motifs.parallel_relay_groups(relays, strict=False)) == want["sg2_loose"]
    assert members(motifs.relay_recipient_groups(relays)) == want["recipient"]
    assert members(motifs.airdrop_groups(half, slices)) == want["airdrop"] and any(want.values())
    star = motifs.parallel_relay_links(relays).selectExpr("channel", "concat(a, ',', b) AS members")
    assert {tuple(r) for r in motifs.group_clusters(star).collect()} == {tuple(r) for r in motifs.group_clusters(motifs.parallel_relay_groups(relays)).collect()}


def sg1(spark, text, fn=motifs.codeposit_groups, **options):
    return native(fn(ledger(model.half_edges(graph(spark, parse(text)))), **options))


@pytest.mark.parametrize(
    ("edges", "strict", "loose"),
    [
        ("x→d@1:100, y→d@2:100, d→e@3:200", {("x", "y")}, {("d", "x", "y")}),
        ("x→d@1:100, y→d@2:100, d→e@3:190", {("x", "y")}, {("d", "x", "y")}),
        ("x→d@1:100, y→d@2:100, d→e@3:189", set(), set()),
        ("x→d@1:100, y→d@2:100, d→e@3:1000", {("x", "y")}, {("d", "x", "y")}),
        ("x→d@3:100, y→d@2:100, d→e@3:100, d→e@5:100", set(), {("d", "x"), ("d", "y")}),
        ("x→d@1:50, y→d@1:50, d→e@3:60, d→f@3:40", set(), set()),
    ],
)
def test_codeposit_cases(spark, edges, strict, loose):
    assert sg1(spark, edges) == strict
    assert sg1(spark, edges, strict=False) == loose


def test_balance_cases(spark):
    rows = ledger(model.half_edges(graph(spark, parse("x→d@1:10, d→e@2:50, x→d@3:10, d→e@4:5")))).filter("node = 'd'").orderBy("out_rn").collect()
    assert [int(r["bal"]) for r in rows] == [0, 5]
    assert ("d", "y") in sg1(spark, "x→d@1:100, d→e@2:40, y→d@3:10, d→e@4:70", motifs.deposit_side_groups)
    assert ("d", "y") not in sg1(spark, "x→d@1:100, d→e@2:40, y→d@3:10, d→e@4:10", motifs.deposit_side_groups)
    assert ("d", "y") in sg1(spark, "x→d@1:100, d→e@2:40, y→d@3:10, d→e@4:10", strict=False)


def relays(spark, text):
    return motifs.relay_pairs(model.half_edges(graph(spark, parse(text) if isinstance(text, str) else text)))


@pytest.mark.parametrize(
    ("edges", "n"),
    [
        ("s→m@1:110, m→t@2:100", 1),
        ("s→m@1:111, m→t@2:100", 0),
        ("s→m@1:100, z→m@2:1, m→t@3:100", 0),
        ("s→m@1:100, m→t@2:101", 0),
        ("s→m@1:100, q→m@1:0, m→t@2:100", 1),
        ("m→m@1:5", 1),
    ],
)
def test_relay_cases(spark, edges, n):
    assert relays(spark, edges).count() == n


def test_parallel_relays(spark):
    both = "s→m@1:110, m→t@2:100, s→n@1:50, n→t@2:50"
    assert native(motifs.parallel_relay_groups(relays(spark, both))) == {("m", "n")}
    assert native(motifs.parallel_relay_groups(relays(spark, both), strict=False)) == {("m", "n", "t")}
    assert native(motifs.relay_recipient_groups(relays(spark, both))) == {("m", "t"), ("n", "t")}
    apart = [(*e, *(("TT", "t1") if "n" in e[:2] else ("ET", "t0"))) for e in parse(both)]
    assert native(motifs.parallel_relay_groups(relays(spark, apart))) == set()


def test_airdrop_needs_a_token(spark):
    edges = parse("s→m@1:7, m→t@2:7, s→n@1:7, n→t@2:7")
    half = lambda *kind: model.half_edges(graph(spark, [(*e, *kind) for e in edges]))
    assert ("m", "n") in native(motifs.airdrop_groups(half("TT", "t0")))
    assert native(motifs.airdrop_groups(half("ET", "t0"))) == set()


@pytest.mark.parametrize(
    ("edges", "hit"),
    [
        ("d→E@1:5, x→d@3200:5", True),
        ("d→E@1:5, x→d@3201:5", False),
        ("d→E@9000:5, x→d@1:5", True),
        (f"d→E@1:1, x→d@1:{10**16 + 1}", True),
        (f"d→E@1:1, x→d@1:{10**16 + 2}", False),
        ("d→E@1:5, E→d@1:5", False),
        ("d→E@1:5, M→d@1:5", False),
        ("E→E2@1:5, x→E@1:5", False),
        ("d→f@1:5, x→d@1:5", False),
    ],
)
def test_deposit_reuse_cases(spark, edges, hit):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "address string")
    got = native(motifs.deposit_reuse_groups(graph(spark, parse(edges)), ids("E", "E2"), ids("M")))
    assert got == ({("d", "x")} if hit else set())


@pytest.mark.parametrize("slices", [1, 9, 1000])
def test_deposit_reuse_against_pairs(spark, slices):
    rng = random.Random(slices)
    node = lambda: f"n{rng.randint(0, 9)}"
    edges = [(node(), node(), rng.randint(0, 80), rng.choice([0, 1, 5, 10, 100]), rng.choice(["ET", "TT"]), "t0") for _ in range(500)]
    ex, mi = {"n0", "n1"}, {"n2"}
    want = set()
    for c, es in channels(edges).items():
        es = [e for e in es if c or e[3]]
        for x, d, b, v, _ in es:
            if x != d and d not in ex and x not in ex | mi and any(s == d and e in ex and b - ob < 7 and v - ov <= 4 for s, e, ob, ov, _ in es):
                want.add((c, tuple(sorted((x, d)))))
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "address string")
    assert members(motifs.deposit_reuse_groups(graph(spark, edges), ids(ex), ids(mi), 7, 4, slices)) == want and want


def test_deposit_reuse_zero_values(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "address string")
    edges = parse("d→E@1:0, x→d@1:0")
    for kind, want in ((("ET", "t"), set()), (("TT", "t"), {("d", "x")})):
        assert native(motifs.deposit_reuse_groups(graph(spark, [(*e, *kind) for e in edges]), ids("E"), ids("M"))) == want


def test_anchor_component(spark):
    groups = spark.createDataFrame([("a", "", "a,b"), ("a", "", "b,c"), ("a", "t", "d,e"), ("f", "", "a,g"), ("b", "", "b,x")], "anchor string, channel string, members string")
    want = {("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "x")}
    assert {tuple(r) for r in motifs.anchor_component(groups).collect()} == want
    assert motifs.anchor_component(groups.limit(0)).collect() == []
    anchors = spark.createDataFrame([("a",), ("z",), (None,)], "id string")
    assert {r["members"] for r in motifs.of_anchor(groups, anchors).collect()} == {"a,b", "a,g"}


def test_deposit_reuse_of_an_anchor_is_local(spark):
    """The anchor pays d; x pays d and d2, which the anchor does not pay."""
    edges = parse("a→d@1:5, x→d@1:5, d→E@2:5, x→d2@1:5, d2→E@2:5, a→E@1:5")
    ids = lambda name, *x: spark.createDataFrame([(i,) for i in x], f"{name} string")
    found = motifs.anchor_deposit_reuse(graph(spark, edges), ids("id", "a", "x", "z", None), ids("address", "E"), ids("address", "M"))
    assert {(r["anchor"], r["members"]) for r in found.collect()} == {("a", "a,d"), ("a", "d,x"), ("x", "a,d"), ("x", "d,x"), ("x", "d2,x")}
    assert {tuple(r) for r in motifs.anchor_component(found).collect()} == {("a", "a"), ("a", "d"), ("a", "x"), ("x", "x"), ("x", "d"), ("x", "a"), ("x", "d2")}


@pytest.mark.parametrize("seed", range(3))
def test_anchored_groups_against_all_groups(spark, seed):
    """Of all groups, those in which the anchor has its part; the parts are taken from loops over all rows."""
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}", rng.randint(1, 40), rng.choice([5, 50, 52, 100])) for _ in range(250)]
    half = model.half_edges(graph(spark, edges))
    rows, pairs = ledger(half).collect(), motifs.relay_pairs(half).collect()
    for strict in (True, False):
        want = set()
        for a in ("n1", "n4"):
            for r in rows:
                senders = set(r["senders"] or [])
                covers = lambda more, r=r: bool(r["mx"]) and r["mx"] >= 10 * (r["s_in"] + more - r["out_value"])
                if a in senders and covers(0):
                    want.add((a, frozenset(senders | (set() if strict else {r["node"]}))))
                if not strict and r["node"] == a and covers(r["bal_before"]):
                    want.add((a, frozenset(senders | {a})))
            for r in pairs:
                if not strict and r["dst"] == a:
                    want.add((a, frozenset({r["mid"], a})))
                want |= {(a, frozenset({a, q["mid"]} | (set() if strict else {q["dst"]}))) for q in pairs if r["mid"] == a != q["mid"] and (r["src"], r["dst"]) == (q["src"], q["dst"])}
        got = motifs.anchored_groups(half, spark.createDataFrame([("n1",), ("n4",), ("no",)], "id string"), strict).collect()
        assert sorted((r["anchor"], r["members"]) for r in got) == sorted((a, ",".join(sorted(m))) for a, m in want if len(m) > 1) and got


def test_motif_clusters_equal_those_of_the_groups(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}", rng.randint(1, 40), rng.choice([5, 50, 52, 100])) for _ in range(200)]
    half = model.half_edges(graph(spark, edges))
    rows, pairs = ledger(half), motifs.relay_pairs(half)
    groups = motifs.union_groups(motifs.codeposit_groups(rows), motifs.parallel_relay_groups(pairs))
    assert sorted(map(tuple, motifs.motif_clusters(rows, pairs).collect())) == sorted(map(tuple, motifs.group_clusters(groups).collect()))


def test_lookup_reports_missing_ids(spark):
    vertices = spark.createDataFrame([("a", "x"), ("b", None), ("b", "y")], "id string, node_id string")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("q",), (None,)], "id string")
    assert sorted(map(str, map(tuple, model.lookup(vertices, ids).collect()))) == sorted(map(str, [("a", "x", True), ("b", None, True), ("b", "y", True), ("q", None, False), (None, None, False)]))
    with pytest.raises(Exception, match="no vertex"):
        model.lookup(vertices, ids.filter("id <> 'b'"), required=True).collect()
    assert model.lookup(vertices, ids.filter("id = 'a'"), required=True).count() == 1


def test_oversize_values_are_rejected(spark):
    raw = spark.createDataFrame([("1" * 78,), ("12",), ("x",), (None,), ("9" * 30,)], "value string")
    assert [int(r["value"]) for r in model.accepted(raw).collect()] == [12]
    assert model.rejected(raw).count() == 4


def test_nulls_and_empty_graph(spark):
    g = spark.createDataFrame([(None, "a", 1, None, "ET", "t", 0), ("a", "b", 1, None, "ET", "t", 1), ("a", "b", 1, None, None, "t", 2)], SCHEMA)
    for df in (g, g.limit(0)):
        half = model.half_edges(df)
        assert ledger(half).collect() == [] and motifs.relay_pairs(half).collect() == []
        assert motifs.group_clusters(motifs.parallel_relay_groups(motifs.relay_pairs(half))).collect() == []


# --- shuffles


def shuffled(spark, make):
    """The rows that each stage of a query shuffles."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    gateway = spark.sparkContext._gateway

    def written():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    old = written()
    make().collect()
    return [n for k, n in written().items() if k not in old]


@pytest.mark.parametrize("name", ["motif_union_loose", "motif_clusters"])
def test_half_edges_are_shuffled_once_a_motif(spark, name):
    sf = "/root/testdata/sf0.001"
    n = registry._half(spark, sf).count()
    rows = shuffled(spark, lambda: registry.QUERIES[name](spark, sf))
    assert sum(x >= 0.45 * n for x in rows) <= 2


@pytest.mark.parametrize("seed", range(3))
def test_first_outflows_are_the_rows_of_the_ledger(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(5)}", f"n{rng.randrange(5)}", rng.randrange(30), rng.choice([0, 1, 9, 10, 100]), *rng.choice([("ET", "t0"), ("TT", "t1")])) for _ in range(150)]
    half = model.half_edges(graph(spark, edges))
    columns = ["channel", "node", "s_in", "mx", "senders", "out_value"]
    want = sorted(map(str, ledger(half, 4).filter("mx IS NOT NULL").select(columns).collect()))
    for slice_blocks in (1, 4, 7, 100):
        assert sorted(map(str, first_outflows(half, slice_blocks).select(columns).collect())) == want
    assert want


@pytest.mark.parametrize("seed", range(3))
def test_loose_union(spark, seed):
    rng = random.Random(10 + seed)
    edges = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", rng.randrange(25), rng.choice([0, 9, 10, 100]), *rng.choice([("ET", "t0"), ("TT", "t1")])) for _ in range(150)]
    found = loop_groups(edges)
    assert found["deposit"] and found["deposit"] < found["sg1_loose"]
    want = set().union(*(found[k] for k in ("sg1_loose", "deposit", "sg2_loose", "recipient")))
    got = motifs.loose_union(model.half_edges(graph(spark, edges)), 5)
    assert members(got) == want and got.count() == len(want)
