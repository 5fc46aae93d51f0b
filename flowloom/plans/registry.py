"""All registered queries over the test tables, and the DuckDB SQL that each must equal.

The transfer graph is derived from ``lineitem`` by the same expressions in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import clusters, export, metrics, model, motifs
from flowloom.operators.ledger import first_outflows, ledger
from flowloom.sources import readers, writers
from flowloom.storage import scratch_path

#: Parameters of the registered queries: limits that the values of the derived graph call for.
EXCHANGES, MINERS = [f"a{i}" for i in range(4)], [f"a{i}" for i in range(4, 6)]
MAX_DAYS, MAX_CENTS, SLICE_DAYS = 30, 100_000, 512
SEEDS, CLUSTERED, HOPS = ["a3", "a7", "a11"], [f"a{i}" for i in range(0, 64, 5)], (8, 16)
ANCHORS, NOBODY = ["a1", "a6", "a9"], "nobody"
#: Conversations that are written as one log.
CHATS_A_LOG = 512
#: A node's share of the keys: parts, and orders per two parts' worth; both grow with the tables, and so do the nodes.
PARTS_A_NODE = 16


# --- inputs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str, parts: int = PARTS_A_NODE) -> DataFrame:
    """The derived transfer graph: a node for every ``parts`` parts, and for the orders in proportion."""
    flag = F.col("l_returnflag")
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("a"), F.expr(f"l_partkey div {parts}")).alias("src"),
        F.concat(F.lit("a"), F.expr(f"l_orderkey * 2 div {15 * parts}")).alias("dst"),
        F.unix_date(F.col("l_shipdate").cast("date")).alias("block_number"),
        F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)").alias("value"),
        F.when(flag == "A", "TT").when(flag == "R", "SCC").otherwise("ET").alias("behaviour"),
        F.concat(F.lit("tok"), F.col("l_linenumber") % 4).alias("asset"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("tie"),
    )


def _ids(spark: SparkSession, ids: list[str], name: str = "id") -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("rank", name))


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.half_edges(transfers(spark, sf_dir))


def _relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.relay_pairs(_half(spark, sf_dir), slice_blocks=SLICE_DAYS)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(_half(spark, sf_dir), SLICE_DAYS)


def _sg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.codeposit_groups(_ledger(spark, sf_dir))


def _sg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.parallel_relay_groups(_relays(spark, sf_dir))


def _reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.deposit_reuse_groups(transfers(spark, sf_dir), _ids(spark, EXCHANGES, "address"), _ids(spark, MINERS, "address"), MAX_DAYS, MAX_CENTS, SLICE_DAYS)


def _fine_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relays with their recipients on the graph with a node for every part, which has many components."""
    return motifs.relay_recipient_groups(motifs.relay_pairs(model.half_edges(transfers(spark, sf_dir, parts=1)), slice_blocks=SLICE_DAYS))


def _customer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of unequal width: every seventh customer alone, the others by sixteens; neighbours share a member."""
    key = F.col("c_custkey")
    row = F.expr("CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 2 + 2 ELSE c_custkey div 16 * 2 + 1 END")
    rows = _table(spark, sf_dir, "customer").select(row.alias("row_id"), key, F.concat(F.lit("c"), F.expr("c_custkey div 3")).alias("m"))
    return rows.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "m"))), lambda x: x["m"]).alias("members"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("user_id").distinct().select((F.col("user_id") + 1).alias("row_id"), F.concat(F.lit("user"), F.col("user_id"), F.lit(".bnb")).alias("name"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as labels of the clusters' addresses: several per address, some empty, some names repeated."""
    key = F.col("s_suppkey")
    name = F.when(key % 5 == 0, "").otherwise(F.concat(F.regexp_extract("s_name", "^[A-Za-z]+", 0), F.expr("s_suppkey div 4"), F.lit(": hot wallet "), F.expr("s_suppkey div 2")))
    return _table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.expr("s_suppkey * 2 div 3 * 3")).alias("address"), name.alias("name"), key.alias("position"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = clusters.normalised_names(_labels(spark, sf_dir).filter("name <> ''"))
    return clusters.entity_addresses(named.select("entity", "name"), _labels(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customer_clusters(spark, sf_dir)
    return rows.select(F.concat(F.lit("s"), F.col("row_id") % 3).alias("source"), F.array_join("members", ",").alias("members"))


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.array_join("members", ",").alias("members"))


# --- queries


def relay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relays(spark, sf_dir).select("channel", "mid", "src", "dst", F.col("vin").cast("long").alias("vin"), F.col("vout").cast("long").alias("vout"))


def sg2_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sg2(spark, sf_dir)


def sg2_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.parallel_relay_groups(_relays(spark, sf_dir), strict=False)


def relay_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.parallel_relay_links(_relays(spark, sf_dir))


def relay_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.relay_recipient_groups(_relays(spark, sf_dir))


def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir)
    numbers = [F.col(c).cast("long").alias(c) for c in ("s_in", "out_value", "bal_before", "bal")]
    return rows.select("channel", "node", F.col("out_rn").cast("long").alias("out_rn"), *numbers)


def sg1_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sg1(spark, sf_dir)


def sg1_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.codeposit_groups(_ledger(spark, sf_dir), strict=False)


def deposit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.deposit_side_groups(_ledger(spark, sf_dir))


def airdrop_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.airdrop_groups(_half(spark, sf_dir), SLICE_DAYS)


def deposit_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reuse(spark, sf_dir)


def motif_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.union_groups(_sg1(spark, sf_dir), _sg2(spark, sf_dir))


def motif_union_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.loose_union(_half(spark, sf_dir), SLICE_DAYS)


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.anchored_groups(_half(spark, sf_dir), _ids(spark, ANCHORS), slice_blocks=SLICE_DAYS)


def anchor_groups_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.anchored_groups(_half(spark, sf_dir), _ids(spark, ANCHORS), strict=False, slice_blocks=SLICE_DAYS)


def _anchor_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = (_ids(spark, EXCHANGES, "address"), _ids(spark, MINERS, "address"), MAX_DAYS, MAX_CENTS, SLICE_DAYS)
    return motifs.anchor_deposit_reuse(transfers(spark, sf_dir), _ids(spark, [*ANCHORS, NOBODY]), *limits)


def deposit_reuse_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchor_reuse(spark, sf_dir)


def anchor_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.anchor_component(_anchor_reuse(spark, sf_dir))


def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.group_clusters(_fine_groups(spark, sf_dir))


def motif_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = model.half_edges(transfers(spark, sf_dir, parts=1))
    return motifs.motif_clusters(first_outflows(half, SLICE_DAYS), motifs.relay_pairs(half, slice_blocks=SLICE_DAYS))


def _export(spark: SparkSession, sf_dir: str, dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    return export.layered_neighbourhood(transfers(spark, sf_dir), _ids(spark, SEEDS), _ids(spark, CLUSTERED), *HOPS, dedup=dedup)


def layered_export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir)[0]


def layered_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir)[1]


def layered_export_dedup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir, dedup=True)[0]


def layered_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.graph_json(*_export(spark, sf_dir))


def member_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.member_frequency(_lines(spark, sf_dir))


def distinct_member_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_member_count(_lines(spark, sf_dir))


def nonempty_with_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _ids(spark, [f"a{i}" for i in range(2000)], "anchor")
    main = motifs.of_anchor(_sg2(spark, sf_dir), anchors.withColumnRenamed("anchor", "id"))
    backup = _reuse(spark, sf_dir).select(F.explode(F.split("members", ",")).alias("anchor"))
    return metrics.nonempty_with_backup(anchors, main, backup)


def anchor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transfers(spark, sf_dir)
    return metrics.anchor_sample(edges.select(F.explode(F.array("src", "dst")).alias("id")), 20)


def anchor_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.anchor_assets(transfers(spark, sf_dir), _ids(spark, ANCHORS))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.adjacency(transfers(spark, sf_dir), _ids(spark, ANCHORS))
    return rows.select("channel", "node", "dir", "other", F.col("block").cast("long").alias("block"), F.col("value").cast("long").alias("value"))


def two_hop_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.two_hop_sources(transfers(spark, sf_dir).filter("behaviour = 'SCC'"), _ids(spark, ANCHORS))


def edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.edges_of_kind(transfers(spark, sf_dir), "SCC").select("src", "dst")


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as vertices; those in debt have no label."""
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("node_id"))


def vertex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.vertices_without(_vertices(spark, sf_dir)).select("id")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lookup(_vertices(spark, sf_dir), _ids(spark, ["c1", "c7", "c7", NOBODY]))


def creation_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    made = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("k"), F.expr("o_orderkey div 3")).alias("dst"), F.col("o_orderkey").alias("rank"))
    rows = clusters.creation_rows(model.vertices_without(_vertices(spark, sf_dir)), made)
    return rows.select("id", F.array_join("members", ",").alias("members"))


# What is written and read back, each through its writer and reader.


def _round_trip(spark: SparkSession, write, read) -> DataFrame:
    path = scratch_path(spark, "round-trip")
    write(path)
    return read(path)


def address_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    rows = _table(spark, sf_dir, "customer").select(name.alias("value"))
    return _round_trip(spark, rows.write.text, lambda path: readers.address_list(spark, path))


def dimension_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), F.upper("s_name"), F.lit(" ")).alias("address"), F.col("s_nationkey").alias("label"))
    return _round_trip(spark, lambda path: writers.csv_rows(rows.union(rows), path), lambda path: readers.dimension(spark, path))


def cluster_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customer_clusters(spark, sf_dir).select(F.array_join("members", ",").alias("members"))
    return _round_trip(spark, lambda path: writers.group_lines(rows, path), lambda path: readers.cluster_rows(spark, path).select(F.array_join("members", ",").alias("members")))


def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).groupBy("address").agg(F.max_by("name", "position").alias("name"))
    return _round_trip(spark, lambda path: writers.label_json(rows, path), lambda path: readers.label_dictionary(spark, path).select("address", "name"))


def entity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.normalised_names(_labels(spark, sf_dir).filter("name <> ''")).select("entity", "name")
    return _round_trip(spark, lambda path: writers.entity_json(rows, path), lambda path: readers.entity_map(spark, path))


def group_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, lambda path: writers.group_lines(_sg2(spark, sf_dir), path), lambda path: readers.cluster_rows(spark, path).select(F.array_join("members", ",").alias("members")))


def anchored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = motifs.anchored_groups(_half(spark, sf_dir), _ids(spark, ANCHORS), slice_blocks=SLICE_DAYS)
    numbers = groups.select("anchor", F.replace("members", F.lit("a"), F.lit("")).alias("members"))
    read = lambda path: readers.result_lists(spark, path + "/*").select("anchor", F.array_join("members", ",").alias("members"))
    return _round_trip(spark, lambda path: writers.anchored_lists(numbers, path), read)


def component_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, lambda path: writers.member_lines(anchor_component(spark, sf_dir), path), lambda path: readers.address_list(spark, path))


def edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda path: readers.cluster_rows(spark, path).select(F.col("members")[0].alias("src"), F.col("members")[1].alias("dst"))
    return _round_trip(spark, lambda path: writers.edge_lines(edge_scan(spark, sf_dir), path), read)


def frequency_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, lambda path: writers.frequency_lines(member_frequency(spark, sf_dir), path), lambda path: readers.address_list(spark, path).withColumnRenamed("id", "line"))


def exchange_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda path: spark.read.csv(path, header=True, schema="address string, position long")
    return _round_trip(spark, lambda path: writers.csv_rows(address_extract(spark, sf_dir), path), read)


def chat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda path: readers.chat_turns(readers.log_lines(spark, path)).select(F.col("log").cast("long").alias("log"), "role", "text")
    logs = chat_parse(spark, sf_dir).select(F.expr(f"log div {CHATS_A_LOG}").alias("log"), F.struct("log", "turn").alias("turn"), "role", "text")
    return _round_trip(spark, lambda path: writers.chat_lines(logs, path), read)


def address_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit("x "), F.upper(F.sha1(F.concat(F.lit("k"), F.col("c_custkey") % 50).cast("binary"))), F.lit(";0"), F.sha1(F.col("c_name").cast("binary")), F.lit(" "), F.sha1(F.col("c_mktsegment").cast("binary")))
    return readers.extracted_addresses(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), cell.alias("cell")))


def creator_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    made = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("k"), F.expr("o_orderkey div 3")).alias("dst"), F.col("o_orderkey").alias("rank"))
    return _joined(clusters.creator_merge(_customer_clusters(spark, sf_dir), made))


def name_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.name_families(_names(spark, sf_dir))


def family_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = clusters.name_families(_names(spark, sf_dir))
    return _joined(clusters.family_merge(_customer_clusters(spark, sf_dir), families))


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(clusters.entity_merge(_customer_clusters(spark, sf_dir), _entities(spark, sf_dir)))


def drop_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(clusters.drop_singletons(_customer_clusters(spark, sf_dir)))


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _customer_clusters(spark, sf_dir).select(F.explode("members").alias("address"))
    return clusters.label_lookup(members, _labels(spark, sf_dir))


def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.normalised_names(_labels(spark, sf_dir))


def entity_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)


def majority_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.majority_choice(_table(spark, sf_dir, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("choice")))


def chat_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("role") == "user", "You: ").when(F.col("role") == "assistant", "Ollama: ").otherwise("")
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("log"), "turn", F.split(F.concat(mark, F.coalesce("text", F.lit(""))), "\n").alias("lines"))
    lines = turns.select("log", "turn", F.posexplode("lines").alias("n", "line")).select("log", F.struct("turn", "n").alias("line_no"), "line")
    return readers.chat_turns(lines)


_NAMES = """relay_pairs sg2_strict sg2_loose relay_links relay_recipient ledger_replay sg1_strict sg1_loose deposit_groups
airdrop_groups deposit_reuse motif_union motif_union_loose anchor_groups anchor_groups_loose
deposit_reuse_by_anchor anchor_component cluster_components motif_clusters layered_export_nodes
layered_export_edges layered_export_dedup_nodes layered_export_json member_frequency distinct_member_count
nonempty_with_backup anchor_sample anchor_assets adjacency two_hop_sources edge_scan vertex_scan address_extract
creator_merge name_families family_merge entity_merge drop_singletons label_lookup name_normalise entity_addresses
majority_choice chat_parse point_lookup creation_expansion address_list dimension_file cluster_file label_file
entity_file group_file anchored_files component_file edge_file frequency_file exchange_csv chat_file""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# --- the same in SQL


def _values(ids: list[str]) -> str:
    return ", ".join(f"('{i}')" for i in ids)


def _list(ids: list[str]) -> str:
    return ", ".join(f"'{i}'" for i in ids)


_GRAPH = f"""transfers AS (
  SELECT 'a' || (l_partkey // {PARTS_A_NODE}) AS src, 'a' || (l_orderkey * 2 // {15 * PARTS_A_NODE}) AS dst,
    datediff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS block, round(l_extendedprice * 100)::BIGINT AS value,
    CASE l_returnflag WHEN 'A' THEN 'TT' WHEN 'R' THEN 'SCC' ELSE 'ET' END AS behaviour, 'tok' || (l_linenumber % 4) AS asset,
    CASE WHEN l_returnflag = 'A' THEN 'tok' || (l_linenumber % 4) ELSE '' END AS channel,
    l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x
  FROM lineitem
), halves AS (
  SELECT channel, src AS node, 'O' AS dir, dst AS other, block, value, o, l, p, s, x FROM transfers
  UNION ALL SELECT channel, dst, 'I', src, block, value, o, l, p, s, x FROM transfers
), half AS (SELECT * FROM halves WHERE value <> 0)"""

_RELAYS = f"""{_GRAPH}, following AS (
  SELECT channel, node AS mid, dir, other AS src, value AS vin, lead(dir) OVER w AS ndir, lead(other) OVER w AS dst, lead(value) OVER w AS vout
  FROM half WINDOW w AS (PARTITION BY channel, node ORDER BY block, o, l, p, s, x, dir)
), relays AS (
  SELECT channel, mid, src, dst, vin, vout FROM following
  WHERE dir = 'I' AND ndir = 'O' AND vin >= vout AND vout >= 10 * (vin - vout)
)"""

_LEDGER = f"""{_GRAPH}, outs AS (
  SELECT *, row_number() OVER (PARTITION BY channel, node ORDER BY o0) AS out_rn FROM (
    SELECT *, row_number() OVER (PARTITION BY channel, node ORDER BY block, o, l, p, s, x) AS o0,
      row_number() OVER (PARTITION BY channel, node, block ORDER BY o, l, p, s, x) AS in_block
    FROM half WHERE dir = 'O')
), blocks AS (
  SELECT channel, node, block AS upto, coalesce(lag(block) OVER (PARTITION BY channel, node ORDER BY block), -1000000) AS since
  FROM (SELECT DISTINCT channel, node, block FROM outs)
), windows AS (
  SELECT b.channel, b.node, b.upto, sum(i.value) AS s, max(i.value) AS m, list_sort(list_distinct(list(i.other))) AS senders
  FROM blocks b JOIN half i ON i.channel = b.channel AND i.node = b.node AND i.dir = 'I' AND i.block >= b.since AND i.block < b.upto
  GROUP BY ALL
), flows AS (
  SELECT o.channel, o.node, o.out_rn, coalesce(w.s, 0) AS s_in, w.m AS mx, w.senders, o.value AS out_value
  FROM outs o LEFT JOIN windows w ON w.channel = o.channel AND w.node = o.node AND w.upto = o.block AND o.in_block = 1
), sums AS (
  SELECT *, sum(s_in - out_value) OVER (PARTITION BY channel, node ORDER BY out_rn) AS t FROM flows
), lows AS (
  SELECT *, t - least(0, min(t) OVER (PARTITION BY channel, node ORDER BY out_rn)) AS bal FROM sums
), ledger AS (
  SELECT *, coalesce(lag(bal) OVER (PARTITION BY channel, node ORDER BY out_rn), 0) AS bal_before FROM lows
)"""


def _as_groups(select: str) -> str:
    """Groups from a select of channel and m, a list."""
    return f"""SELECT DISTINCT channel, array_to_string(list_sort(list_distinct(m)), ',') AS members
FROM ({select}) WHERE len(list_distinct(m)) >= 2"""


_SG1 = _as_groups("SELECT channel, senders AS m FROM ledger WHERE mx > 0 AND mx >= 10 * (s_in - out_value)")
_SG2 = _as_groups("SELECT a.channel, [a.mid, b.mid] AS m FROM relays a JOIN relays b USING (channel, src, dst) WHERE a.mid <> b.mid")
_BOTH = f"{_LEDGER}, {_RELAYS[len(_GRAPH) + 2 :]}, sg1 AS ({_SG1}), sg2 AS ({_SG2}), groups AS (SELECT * FROM sg1 UNION SELECT * FROM sg2)"
_LOOSE1 = _SG1.replace("senders AS m", "list_append(senders, node) AS m")
_SIDE = _as_groups("SELECT channel, list_append(senders, node) AS m FROM ledger WHERE mx > 0 AND mx >= 10 * (s_in + bal_before - out_value)")
_LOOSE2 = _SG2.replace("[a.mid, b.mid]", "[a.mid, b.mid, dst]")
_TARGETS = _as_groups("SELECT channel, [mid, dst] AS m FROM relays")


def _fine(sql: str) -> str:
    """The same over the graph with a node for every part."""
    return sql.replace(f"l_partkey // {PARTS_A_NODE})", "l_partkey // 1)").replace(f"l_orderkey * 2 // {15 * PARTS_A_NODE})", "l_orderkey * 2 // 15)")


def _anchored_sql(strict: bool) -> str:
    """Groups by the part of the anchor; ``{}`` are the members that are not in every form."""
    parts = [
        f"SELECT id, channel, {'senders' if strict else 'list_append(senders, node)'} AS m FROM ledger, anchors WHERE mx > 0 AND mx >= 10 * (s_in - out_value) AND list_contains(senders, id)",
        f"SELECT id, a.channel, [a.mid, b.mid{'' if strict else ', dst'}] FROM relays a JOIN relays b USING (channel, src, dst) JOIN anchors ON a.mid = id WHERE a.mid <> b.mid",
    ]
    if not strict:
        parts.append("SELECT id, channel, list_append(senders, node) FROM ledger JOIN anchors ON node = id WHERE mx > 0 AND mx >= 10 * (s_in + bal_before - out_value)")
        parts.append("SELECT id, channel, [mid, dst] FROM relays JOIN anchors ON dst = id")
    return f"""WITH {_LEDGER}, {_RELAYS[len(_GRAPH) + 2 :]}, anchors AS (SELECT * FROM (VALUES {_values(ANCHORS)}) v(id)), found AS ({" UNION ALL ".join(parts)})
SELECT DISTINCT id AS anchor, channel, array_to_string(list_sort(list_distinct(m)), ',') AS members FROM found WHERE len(list_distinct(m)) >= 2"""


_REUSE = f"""SELECT DISTINCT i.channel, array_to_string(list_sort([i.node, i.other]), ',') AS members
FROM halves i WHERE i.dir = 'I' AND (i.channel <> '' OR i.value <> 0) AND i.node <> i.other AND i.node NOT IN ({_list(EXCHANGES)})
  AND i.other NOT IN ({_list(EXCHANGES + MINERS)})
  AND EXISTS (SELECT 1 FROM halves o WHERE o.dir = 'O' AND o.channel = i.channel AND o.node = i.node
    AND o.other IN ({_list(EXCHANGES)}) AND i.block - o.block < {MAX_DAYS} AND i.value - o.value <= {MAX_CENTS})"""
_ANCHOR_REUSE = f"""anchors AS (SELECT * FROM (VALUES {_values([*ANCHORS, NOBODY])}) v(id)
), reuse AS (
  SELECT DISTINCT i.channel, i.node AS deposit, array_to_string(list_sort([i.node, i.other]), ',') AS members
  {_REUSE[_REUSE.index("FROM halves i") :]}
), own AS (
  SELECT DISTINCT id AS anchor, r.channel, r.members FROM anchors JOIN transfers t ON t.src = id
  JOIN reuse r ON r.channel = t.channel AND r.deposit = t.dst WHERE t.channel <> '' OR t.value <> 0
)"""
_LOCAL = """ends AS (
  SELECT DISTINCT anchor, string_split(members, ',')[1] AS a, string_split(members, ',')[2] AS b FROM own
), links AS (SELECT * FROM ends UNION SELECT anchor, b, a FROM ends
), local AS (
  SELECT DISTINCT anchor, a AS member FROM links WHERE a = anchor
  UNION SELECT l.anchor, k.b FROM local l JOIN links k ON k.anchor = l.anchor AND k.a = l.member
)"""
_REACH = """links AS (
  SELECT DISTINCT string_split(members, ',')[1] AS a, unnest(string_split(members, ',')[2:]) AS b FROM groups
), ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT a, a AS b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b)"""


def _export_sql(dedup: bool, last: str) -> str:
    n = "count(DISTINCT {0})" if dedup else "count(*)"

    def hop(near: str, at: str, far: str, limit: int) -> str:
        return f"SELECT {far} AS id FROM transfers WHERE {at} IN (SELECT id FROM {near}) GROUP BY {far} ORDER BY {n.format(at)} DESC, {far} LIMIT {limit}"

    return f"""WITH {_GRAPH}, seed AS (SELECT * FROM (VALUES {_values(SEEDS)}) v(id)),
out1 AS ({hop("seed", "src", "dst", HOPS[0])}), out2 AS ({hop("out1", "src", "dst", HOPS[1])}),
in1 AS ({hop("seed", "dst", "src", HOPS[0])}), in2 AS ({hop("in1", "dst", "src", HOPS[1])}),
forward AS (SELECT id, min(layer) AS layer FROM (SELECT id, 2 AS layer FROM seed UNION ALL SELECT id, 3 FROM out1 UNION ALL SELECT id, 4 FROM out2) GROUP BY id),
backward AS (SELECT id, max(layer) AS layer FROM (SELECT id, 1 AS layer FROM in1 UNION ALL SELECT id, 0 FROM in2) GROUP BY id),
shown AS (SELECT id, CASE WHEN id IN (SELECT id FROM forward) THEN id || '_1' ELSE id END AS name, layer FROM backward),
nodes AS (
  SELECT id, CASE WHEN id = '{SEEDS[0]}' THEN 'sourceNode' WHEN id IN (SELECT id FROM seed) THEN 'imporNode'
    WHEN id IN ({_list(CLUSTERED)}) THEN 'clusterNode' ELSE 'otherNode' END AS label, layer FROM forward
  UNION ALL SELECT name, CASE WHEN id IN ({_list(CLUSTERED)}) THEN 'clusterNode' ELSE 'otherNode' END, layer FROM shown
), edges AS (
  SELECT src AS source, dst AS target FROM transfers WHERE src IN (SELECT id FROM seed) AND dst IN (SELECT id FROM out1)
  UNION SELECT src, dst FROM transfers WHERE src IN (SELECT id FROM out1) AND dst IN (SELECT id FROM out2)
  UNION SELECT a.name, dst FROM transfers JOIN shown a ON a.id = src WHERE src IN (SELECT id FROM in1) AND dst IN (SELECT id FROM seed)
  UNION SELECT a.name, b.name FROM transfers JOIN shown a ON a.id = src JOIN shown b ON b.id = dst
    WHERE src IN (SELECT id FROM in2) AND dst IN (SELECT id FROM in1)
) {last}"""


_CLUSTERS = """rows AS (
  SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 2 + 2 ELSE c_custkey // 16 * 2 + 1 END AS row_id, c_custkey, 'c' || (c_custkey // 3) AS m FROM customer
), clusters AS (
  SELECT row_id, list(m ORDER BY c_custkey) AS members FROM rows GROUP BY row_id
)"""
_LABELS = """labels AS (
  SELECT 'c' || (s_suppkey * 2 // 3 * 3) AS address,
    CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE regexp_extract(s_name, '^[A-Za-z]+') || (s_suppkey // 4) || ': hot wallet ' || (s_suppkey // 2) END AS name,
    s_suppkey AS position
  FROM supplier
)"""
_ENTITY = "string_split(string_split(name, ':')[1], ' ')[1]"
_ENTITIES = f"""{_LABELS}, entities AS (
  SELECT DISTINCT {_ENTITY} AS entity, name FROM labels WHERE name <> ''
), by_name AS (SELECT name, max_by(address, position) AS address FROM labels WHERE name <> '' GROUP BY name
), entity_addresses AS (SELECT entity, address FROM entities JOIN by_name USING (name))"""
_FAMILIES = """names AS (
  SELECT DISTINCT user_id + 1 AS row_id, 'user' || user_id || '.bnb' AS name FROM events
), bare AS (
  SELECT *, left(b, -1) AS prefix, right(b, 1) AS digit FROM (SELECT *, replace(name, '.bnb', '') AS b FROM names)
  WHERE length(b) > 4 AND regexp_matches(b, '[0-9]$') AND NOT regexp_matches(left(b, -1), '^[0-9]+$')
), families AS (
  SELECT prefix, row_id, name FROM bare WHERE prefix IN (SELECT prefix FROM bare GROUP BY prefix HAVING count(DISTINCT digit) >= 2)
)"""


def _united_sql(pairs: str) -> str:
    """Merged rows from a CTE ``pairs(g, row_id)`` of rows that belong together."""
    return f"""pairs AS ({pairs}), ends AS (
  SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM pairs a JOIN pairs b USING (g)
), reach AS (SELECT a, a AS b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b
), low AS (SELECT a AS row_id, min(b) AS target FROM reach GROUP BY a
), placed AS (
  SELECT coalesce(target, c.row_id) AS t, c.row_id, members FROM clusters c LEFT JOIN low USING (row_id)
), flat AS (
  SELECT t, count(DISTINCT row_id) OVER (PARTITION BY t) AS n, row_id, pos, m FROM (
    SELECT t, row_id, unnest(members) AS m, generate_subscripts(members, 1) AS pos FROM placed)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY t, m ORDER BY row_id, pos) AS again FROM flat
)
SELECT t AS row_id, string_agg(m, ',' ORDER BY row_id, pos) AS members FROM firsts WHERE n = 1 OR again = 1 GROUP BY t"""


_LINES = "lines AS (SELECT 's' || (row_id % 3) AS source, array_to_string(members, ',') AS members FROM clusters)"

SQL: dict[str, str] = {
    "relay_pairs": f"WITH {_RELAYS} SELECT channel, mid, src, dst, vin, vout FROM relays",
    "sg2_strict": f"WITH {_RELAYS} {_SG2}",
    "sg2_loose": f"WITH {_RELAYS} {_LOOSE2}",
    "relay_links": f"""WITH {_RELAYS}, mids AS (SELECT DISTINCT channel, src, dst, mid FROM relays),
lows AS (SELECT *, min(mid) OVER (PARTITION BY channel, src, dst) AS low FROM mids)
SELECT DISTINCT channel, low AS a, mid AS b FROM lows WHERE mid > low""",
    "relay_recipient": f"WITH {_RELAYS} {_TARGETS}",
    "ledger_replay": f"""WITH {_LEDGER} SELECT channel, node, out_rn, s_in::BIGINT AS s_in, out_value::BIGINT AS out_value,
  bal_before::BIGINT AS bal_before, bal::BIGINT AS bal FROM ledger""",
    "sg1_strict": f"WITH {_LEDGER} {_SG1}",
    "sg1_loose": f"WITH {_LEDGER} {_LOOSE1}",
    "deposit_groups": f"WITH {_LEDGER} {_SIDE}",
    "airdrop_groups": f"WITH {_RELAYS} "
    + _as_groups(
        """SELECT a.channel, [a.mid, b.mid] AS m FROM relays a JOIN relays b USING (channel, src, dst, vin)
    WHERE a.mid <> b.mid AND a.vin = a.vout AND b.vin = b.vout AND channel <> ''
    UNION ALL SELECT channel, [mid, dst] FROM relays WHERE channel <> ''"""
    ),
    "deposit_reuse": f"WITH {_GRAPH} {_REUSE}",
    "motif_union": f"WITH {_BOTH} SELECT channel, members FROM groups",
    "motif_union_loose": f"""WITH {_LEDGER}, {_RELAYS[len(_GRAPH) + 2 :]}, sg1 AS ({_LOOSE1}), side AS ({_SIDE}), sg2 AS ({_LOOSE2}), targets AS ({_TARGETS})
SELECT * FROM sg1 UNION SELECT * FROM side UNION SELECT * FROM sg2 UNION SELECT * FROM targets""",
    "anchor_groups": _anchored_sql(True),
    "anchor_groups_loose": _anchored_sql(False),
    "deposit_reuse_by_anchor": f"WITH {_GRAPH}, {_ANCHOR_REUSE} SELECT anchor, channel, members FROM own",
    "anchor_component": f"WITH RECURSIVE {_GRAPH}, {_ANCHOR_REUSE}, {_LOCAL} SELECT anchor, member FROM local",
    "cluster_components": _fine(f"WITH RECURSIVE {_RELAYS}, groups AS ({_TARGETS}), {_REACH} SELECT a AS member, min(b) AS component FROM reach GROUP BY a"),
    "motif_clusters": _fine(f"WITH RECURSIVE {_BOTH}, {_REACH} SELECT a AS member, min(b) AS component FROM reach GROUP BY a"),
    "layered_export_nodes": _export_sql(False, "SELECT id, label, layer FROM nodes"),
    "layered_export_edges": _export_sql(False, "SELECT source, target FROM edges"),
    "layered_export_dedup_nodes": _export_sql(True, "SELECT id, label, layer FROM nodes"),
    "layered_export_json": _export_sql(
        False,
        """SELECT '{"nodes":[' || (SELECT string_agg('{"id":"' || id || '","label":"' || label || '","layer":' || layer || '}', ',' ORDER BY id, label, layer) FROM nodes)
  || '],"edges":[' || (SELECT string_agg('{"source":"' || source || '","target":"' || target || '"}', ',' ORDER BY source, target) FROM edges) || ']}' AS json""",
    ),
    "member_frequency": f"WITH {_CLUSTERS}, {_LINES} SELECT m AS member, count(*) AS n FROM (SELECT trim(unnest(string_split(members, ','))) AS m FROM lines) WHERE m <> '' GROUP BY m",
    "distinct_member_count": f"""WITH {_CLUSTERS}, {_LINES} SELECT source, count(DISTINCT members) AS n_lines, count(DISTINCT m) AS n_members
FROM (SELECT source, members, unnest(string_split(members, ',')) AS m FROM lines) GROUP BY ROLLUP (source)""",
    "nonempty_with_backup": f"""WITH {_RELAYS}, main AS ({_SG2}), backup AS ({_REUSE}), anchors AS (SELECT 'a' || i AS id FROM range(2000) r(i)),
m AS (SELECT DISTINCT unnest(string_split(members, ',')) AS id FROM main), b AS (SELECT DISTINCT unnest(string_split(members, ',')) AS id FROM backup)
SELECT count(*) AS n_anchors, count(m.id) AS n_main, count(coalesce(m.id, b.id)) AS n_found
FROM anchors LEFT JOIN m USING (id) LEFT JOIN b ON b.id = anchors.id""",
    "anchor_sample": f"WITH {_GRAPH} SELECT id FROM (SELECT DISTINCT node AS id FROM halves) ORDER BY md5('0' || id), id LIMIT 20",
    "anchor_assets": f"WITH {_GRAPH} SELECT DISTINCT id, asset FROM (SELECT src AS id, asset FROM transfers UNION ALL SELECT dst, asset FROM transfers) WHERE id IN ({_list(ANCHORS)})",
    "adjacency": f"WITH {_GRAPH} SELECT channel, node, dir, other, block, value FROM halves WHERE node IN ({_list(ANCHORS)})",
    "two_hop_sources": f"""WITH {_GRAPH}, e AS (SELECT DISTINCT src, dst FROM transfers WHERE behaviour = 'SCC')
SELECT DISTINCT a.dst AS id, b.src AS source FROM e a JOIN e b ON b.dst = a.src WHERE a.dst IN ({_list(ANCHORS)})""",
    "edge_scan": f"WITH {_GRAPH} SELECT src, dst FROM transfers WHERE behaviour = 'SCC'",
    "vertex_scan": "SELECT 'c' || c_custkey AS id FROM customer WHERE CASE WHEN c_acctbal > 0 THEN c_mktsegment END IS NULL",
    "address_extract": """WITH cells AS (
  SELECT c_custkey AS position, 'x ' || upper(sha1('k' || (c_custkey % 50))) || ';0' || sha1(c_name) || ' ' || sha1(c_mktsegment) AS cell FROM customer
), found AS (SELECT position, lower(unnest(regexp_extract_all(cell, '\\b[0-9a-fA-F]{40}\\b'))) AS address FROM cells)
SELECT address, min(position) AS position FROM found GROUP BY address""",
    "creator_merge": f"""WITH {_CLUSTERS}, made AS (
  SELECT 'c' || o_custkey AS src, 'k' || (o_orderkey // 3) AS dst, o_orderkey AS rank FROM orders
), places AS (SELECT row_id, unnest(members) AS m, generate_subscripts(members, 1) AS pos FROM clusters
), all_ AS (
  SELECT row_id, pos, -1 AS rank, m FROM places UNION ALL SELECT row_id, pos, rank, dst FROM places JOIN made ON src = m
)
SELECT row_id, string_agg(m, ',' ORDER BY pos, rank, m) AS members FROM all_ GROUP BY row_id""",
    "name_families": f"WITH {_FAMILIES} SELECT prefix, row_id, name FROM families",
    "family_merge": f"WITH RECURSIVE {_CLUSTERS}, {_FAMILIES}, " + _united_sql("SELECT prefix AS g, row_id FROM families"),
    "entity_merge": f"WITH RECURSIVE {_CLUSTERS}, {_ENTITIES}, "
    + _united_sql(
        """SELECT DISTINCT entity AS g, row_id FROM (SELECT row_id, unnest(members) AS address FROM clusters)
    JOIN entity_addresses USING (address)"""
    ),
    "drop_singletons": f"WITH {_CLUSTERS} SELECT row_id, array_to_string(members, ',') AS members FROM clusters WHERE len(members) >= 2",
    "label_lookup": f"""WITH {_CLUSTERS}, {_LABELS}, known AS (SELECT address, max_by(name, position) AS name FROM labels WHERE name <> '' GROUP BY address)
SELECT DISTINCT address, name FROM (SELECT unnest(members) AS address FROM clusters) JOIN known USING (address)""",
    "name_normalise": f"WITH {_LABELS} SELECT address, name, {_ENTITY} AS entity FROM labels",
    "entity_addresses": f"WITH {_ENTITIES} SELECT entity, address FROM entity_addresses",
    "majority_choice": """SELECT question, choice, n FROM (
  SELECT user_id AS question, event_type AS choice, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
  FROM events GROUP BY user_id, event_type) WHERE r = 1""",
    "chat_parse": """WITH l AS (
  SELECT conv_id AS log, turn, unnest(string_split(CASE role WHEN 'user' THEN 'You: ' WHEN 'assistant' THEN 'Ollama: ' ELSE '' END || coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM conversations
), m AS (
  SELECT *, CASE WHEN starts_with(line, 'You: ') THEN 'user' WHEN starts_with(line, 'Ollama: ') THEN 'assistant' END AS role FROM l
), c AS (SELECT *, count(role) OVER (PARTITION BY log ORDER BY turn, n) AS t FROM m
), g AS (
  SELECT log, t AS turn, max(role) AS role, string_agg(CASE WHEN starts_with(line, 'You: ') THEN substr(line, 6) WHEN starts_with(line, 'Ollama: ') THEN substr(line, 9) ELSE line END, chr(10) ORDER BY c.turn, n) AS text
  FROM c WHERE t > 0 GROUP BY log, t
), f AS (SELECT *, lead(role) OVER w AS nxt, lag(role) OVER w AS prv FROM g WINDOW w AS (PARTITION BY log ORDER BY turn))
SELECT log, turn, role, text FROM f WHERE (role = 'user' AND nxt = 'assistant') OR (role = 'assistant' AND prv = 'user')""",
    "point_lookup": f"""SELECT v.id, c.id IS NOT NULL AS found, node_id FROM (VALUES ('c1'), ('c7'), ('{NOBODY}')) v(id)
LEFT JOIN (SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS node_id FROM customer) c USING (id)""",
    "creation_expansion": """SELECT 'c' || c_custkey AS id, 'c' || c_custkey || coalesce(',' || made, '') AS members
FROM (SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal > 0 THEN c_mktsegment END IS NULL)
LEFT JOIN (SELECT o_custkey AS c_custkey, string_agg('k' || (o_orderkey // 3), ',' ORDER BY o_orderkey) AS made FROM orders GROUP BY o_custkey) USING (c_custkey)""",
    "address_list": "SELECT trim(c_name) AS id FROM customer WHERE c_custkey % 5 <> 0",
    "dimension_file": "SELECT DISTINCT lower(trim(s_name)) AS address FROM supplier",
    "cluster_file": f"WITH {_CLUSTERS} SELECT array_to_string(members, ',') AS members FROM clusters",
    "label_file": f"WITH {_LABELS} SELECT address, max_by(name, position) AS name FROM labels GROUP BY address",
    "entity_file": f"WITH {_LABELS} SELECT DISTINCT {_ENTITY} AS entity, name FROM labels WHERE name <> ''",
    "group_file": f"WITH {_RELAYS} SELECT members FROM ({_SG2})",
    "anchored_files": f"SELECT anchor, replace(members, 'a', '') AS members FROM ({_anchored_sql(True)})",
    "component_file": f"WITH RECURSIVE {_GRAPH}, {_ANCHOR_REUSE}, {_LOCAL} SELECT member AS id FROM local",
    "edge_file": f"WITH {_GRAPH} SELECT src, dst FROM transfers WHERE behaviour = 'SCC'",
}
SQL["frequency_file"] = f"SELECT member || ': ' || n AS line FROM ({SQL['member_frequency']})"
SQL["exchange_csv"] = SQL["address_extract"]
SQL["chat_file"] = f"SELECT log // {CHATS_A_LOG} AS log, role, text FROM ({SQL['chat_parse']})"
