import random

import pytest

from flowloom.operators import clusters, export, metrics
from flowloom.operators.components import connected_components
from flowloom.sources import readers, writers

ROWS = "row_id long, members array<string>"


def rows_of(df):
    return {r["row_id"]: r["members"] for r in df.collect()}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(5)
    edges = {"random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)], "path": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)] + [(None, 4), (7, 7)], "none": []}[shape]
    low = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            low[b] = a
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in linked} and len(got) == len(linked)


def test_creator_merge_keeps_order_and_repeats(spark):
    c = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["z"])], ROWS)
    made = spark.createDataFrame([("a", "t2", 2), ("a", "t1", 1), ("a", "t1", 3), ("q", "x", 1)], "src string, dst string, rank long")
    assert rows_of(clusters.creator_merge(c, made)) == {1: ["a", "t1", "t2", "t1", "b", "a", "t1", "t2", "t1"], 2: ["z"]}


@pytest.mark.parametrize(("names", "n"), [(["abcd1.bnb", "abcd2.bnb"], 2), (["abcd1", "abcd1"], 0), (["abc1", "abc2"], 0), (["12341", "12342"], 0), (["abcd1", "abcd2", "abcd1"], 3), ([None, "abcdx"], 0)])
def test_name_families(spark, names, n):
    df = spark.createDataFrame(list(enumerate(names, 1)), "row_id long, name string")
    assert clusters.name_families(df).count() == n


def test_family_merge(spark):
    c = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "c"]), (3, ["b", "d"]), (4, ["e"]), (5, ["f"])], ROWS)
    f = spark.createDataFrame([("p", 1), ("p", 3), ("q", 3), ("q", 4)], "prefix string, row_id long")
    assert rows_of(clusters.family_merge(c, f)) == {1: ["a", "b", "d", "e"], 2: ["c", "c"], 5: ["f"]}


def test_entity_merge_is_transitive(spark):
    c = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["d"]), (4, ["x"])], ROWS)
    e = spark.createDataFrame([("E1", "a"), ("E1", "c"), ("E2", "c"), ("E2", "d")], "entity string, address string")
    merged = clusters.entity_merge(c, e)
    assert rows_of(merged) == {1: ["a", "b", "c", "d"], 4: ["x"]}
    assert rows_of(clusters.drop_singletons(merged)) == {1: ["a", "b", "c", "d"]}


def test_labels(spark):
    labels = spark.createDataFrame([("a", "Old: x", 1), ("a", "New Name: y", 2), ("b", "", 3), ("c", "New Name: y", 4)], "address string, name string, position long")
    ask = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "address string")
    assert [tuple(r) for r in clusters.label_lookup(ask, labels).collect()] == [("a", "New Name: y")]
    assert {r["entity"] for r in clusters.normalised_names(labels).collect()} == {"Old", "New", ""}
    e = spark.createDataFrame([("E", "New Name: y"), ("E", "none")], "entity string, name string")
    assert [tuple(r) for r in clusters.entity_addresses(e, labels).collect()] == [("E", "c")]


def test_layered_export(spark):
    edges = spark.createDataFrame([("p", "s"), ("s", "p"), ("s", "q"), ("s", "q"), ("q", "r"), ("o", "p"), ("s", "s")], "src string, dst string")
    seeds = spark.createDataFrame([("s", 0)], "id string, rank int")
    known = spark.createDataFrame([("q",)], "id string")
    nodes, links = export.layered_neighbourhood(edges, seeds, known)
    assert {tuple(r) for r in nodes.collect()} == {("s", "sourceNode", 2), ("p", "otherNode", 3), ("q", "clusterNode", 3), ("r", "otherNode", 4), ("p_1", "otherNode", 1), ("s_1", "otherNode", 1), ("o", "otherNode", 0)}
    assert {("s", "q"), ("s", "p"), ("p_1", "s"), ("o", "p_1")} <= {tuple(r) for r in links.collect()}
    top, _ = export.layered_neighbourhood(edges, seeds, known, 1, 1)
    assert {tuple(r) for r in top.collect()} == {("s", "sourceNode", 2), ("q", "clusterNode", 3), ("r", "otherNode", 4), ("p", "otherNode", 1), ("o", "otherNode", 0)}


def test_frequency_and_counts(spark):
    lines = spark.createDataFrame([("f", "a,b"), ("g", "b,,c")], "source string, members string")
    assert {tuple(r) for r in metrics.member_frequency(lines).collect()} == {("b", 2), ("a", 1), ("c", 1)}
    got = {r["source"]: (r["n_lines"], r["n_members"]) for r in metrics.distinct_member_count(lines.filter("source = 'f'")).collect()}
    assert got == {"f": (1, 2), None: (1, 2)}


def test_backup_counts(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "anchor string")
    assert tuple(metrics.nonempty_with_backup(ids("a", "b", "c"), ids("a", "a"), ids("b", "z")).first()) == (3, 1, 2)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" a \n\nb\n")
    assert [r["id"] for r in readers.address_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    (tmp_path / "ex.csv").write_text("address,label\n AB ,x\nab,y\ncd,z\n")
    assert {r["address"] for r in readers.dimension(spark, str(tmp_path / "ex.csv")).collect()} == {"ab", "cd"}
    (tmp_path / "rows.txt").write_text("a,b\n\nc\n")
    assert rows_of(readers.cluster_rows(spark, str(tmp_path / "rows.txt"))) == {1: ["a", "b"], 3: ["c"]}
    (tmp_path / "labels.json").write_text('{"a": {"name": "N"}, "b": {"name": null}}')
    assert [tuple(r) for r in readers.label_dictionary(spark, str(tmp_path / "labels.json")).orderBy("position").collect()] == [("a", "N", 0), ("b", None, 1)]
    (tmp_path / "entities.json").write_text('{"E": ["x", "y"]}')
    assert [tuple(r) for r in readers.entity_map(spark, str(tmp_path / "entities.json")).collect()] == [("E", "x"), ("E", "y")]
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "n1.txt").write_text("[1, 2]\nnot a list\n[3]\n")
    assert [tuple(r) for r in readers.result_lists(spark, str(tmp_path / "results")).collect()] == [("n1", [1, 2]), ("n1", [3])]
    groups = spark.createDataFrame([("x", "a,b"), ("x", "a,c"), ("y", "a,d")], "anchor string, members string")
    writers.group_lines(groups, str(tmp_path / "g"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()} == {"a,b", "a,c", "a,d"}
    writers.anchored_lists(groups, str(tmp_path / "h"))
    assert {(r["anchor"], r["value"]) for r in spark.read.text(str(tmp_path / "h")).collect()} == {("x", "[a, b]"), ("x", "[a, c]"), ("y", "[a, d]")}
    writers.frequency_lines(metrics.member_frequency(groups), str(tmp_path / "f"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()][0] == "a: 3"
    writers.edge_lines(spark.createDataFrame([("a", "b")], "s string, t string"), str(tmp_path / "e"))
    writers.member_lines(spark.createDataFrame([("a",)], "member string"), str(tmp_path / "m"))
    writers.csv_rows(groups, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3


def test_positions_of_labels_in_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"name": "1"}, "y": {"name": "2"}}')
    (tmp_path / "b.json").write_text('{"x": {"name": "3"}}')
    labels = readers.label_dictionary(spark, str(tmp_path))
    assert sorted(map(tuple, labels.collect())) == [("x", "1", 0), ("x", "3", 2), ("y", "2", 1)]
    tied = spark.createDataFrame([("a", "P", 1), ("a", "Q", 1), ("b", "Q", 1)], "address string, name string, position long")
    ask = spark.createDataFrame([("a",), (None,)], "address string")
    assert [tuple(r) for r in clusters.label_lookup(ask, tied).collect()] == [("a", "Q")]
    e = spark.createDataFrame([("E", "Q")], "entity string, name string")
    assert [tuple(r) for r in clusters.entity_addresses(e, tied).collect()] == [("E", "b")]


def test_dictionaries_in_several_files(spark, tmp_path):
    labels = spark.createDataFrame([(f"k{i}", None if i % 3 == 0 else f'n"{i}') for i in range(10)] + [(None, "x")], "address string, name string")
    writers.label_json(labels, str(tmp_path / "l"), per_file=2)
    assert len(list((tmp_path / "l").glob("part-*"))) > 1
    back = readers.label_dictionary(spark, str(tmp_path / "l")).collect()
    assert sorted(map(str, ((r["address"], r["name"]) for r in back))) == sorted(map(str, (tuple(r) for r in labels.filter("address IS NOT NULL").collect())))
    assert sorted(r["position"] for r in back) == list(range(10))
    entities = spark.createDataFrame([("E", "a"), ("E", "a"), ("E", "b"), ("F", None), (None, "z")], "entity string, name string")
    writers.entity_json(entities, str(tmp_path / "e"))
    assert {tuple(r) for r in readers.entity_map(spark, str(tmp_path / "e")).collect()} == {("E", "a"), ("E", "b")}
    writers.entity_json(entities.limit(0), str(tmp_path / "n"))
    assert readers.entity_map(spark, str(tmp_path / "n")).collect() == []


def test_creation_rows(spark):
    made = spark.createDataFrame([("a", "t2", 2), ("a", "t1", 1), ("q", "x", 1)], "src string, dst string, rank long")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    assert {r["id"]: r["members"] for r in clusters.creation_rows(ids, made).collect()} == {"a": ["a", "t1", "t2"], "b": ["b"]}


def test_line_numbers_across_splits(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}{i},x\n" for i in range(1, 5001)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.cluster_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == 10000 and all(r["members"][0][1:] == str(r["row_id"]) for r in rows)


def test_chat_log_round_trip(spark, tmp_path):
    lines = ["noise", "You: hi", "more", "Ollama: hello", "", "You: lost", "You: again", "Ollama: yes", "Ollama: stray"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "log long, line_no long, line string")
    turns = readers.chat_turns(df).orderBy("turn")
    assert [(r["role"], r["text"]) for r in turns.collect()] == [("user", "hi\nmore"), ("assistant", "hello\n"), ("user", "again"), ("assistant", "yes")]
    writers.chat_lines(turns, str(tmp_path / "chat"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "chat")).collect()] == ["You: hi", "more", "Ollama: hello", "", "You: again", "Ollama: yes"]
    again = readers.chat_turns(readers.log_lines(spark, str(tmp_path / "chat"))).orderBy("turn").collect()
    assert [(r["log"], r["role"], r["text"]) for r in again] == [("1", r["role"], r["text"]) for r in turns.collect()]


def test_address_extraction(spark):
    a, b = "aB" * 20, "0" * 40
    df = spark.createDataFrame([(2, f"x {a.upper()};{b} {'c' * 41}"), (1, f"{b}"), (3, None)], "position long, cell string")
    assert {tuple(r) for r in readers.extracted_addresses(df).collect()} == {(a.lower(), 2), (b, 1)}
