"""Registered queries over the test tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomslice.functions import native
from loomslice.functions.lexicon import LISTS
from loomslice.functions.registry import Transforms
from loomslice.operators import numbering, rows
from loomslice.plans.graph import Direction, Reference, Root, SchemaGraph, Table
from loomslice.plans.slicer import Slicer
from loomslice.sources import copytext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FWD, REV = Direction.FORWARD, Direction.REVERSE
_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
_REFERENCES = {
    "nation_region": ("nation n_regionkey", "region r_regionkey"),
    "customer_nation": ("customer c_nationkey", "nation n_nationkey"),
    "supplier_nation": ("supplier s_nationkey", "nation n_nationkey"),
    "orders_customer": ("orders o_custkey", "customer c_custkey"),
    "lineitem_orders": ("lineitem l_orderkey", "orders o_orderkey"),
    "lineitem_part": ("lineitem l_partkey", "part p_partkey"),
    "lineitem_supplier": ("lineitem l_suppkey", "supplier s_suppkey"),
}
_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(**ways: set[Direction]) -> SchemaGraph:
    """The test tables' graph with the references named, each in its directions."""
    refs = {}
    for k, d in ways.items():
        (a, x), (b, y) = (side.split() for side in _REFERENCES[k])
        refs[k] = Reference(k, a, (x,), b, (y,), frozenset(d))
    used = sorted({t for r in refs.values() for t in (r.table, r.to_table)})
    return SchemaGraph({t: Table(t, t, tuple(_COLUMNS[t].split())) for t in used}, refs)


def slicer(spark: SparkSession, sf_dir: str, g: SchemaGraph) -> Slicer:
    frames = {t: table(spark, sf_dir, t) if t in _KEYS else rows.scan(spark, f"{sf_dir}/{t}.parquet") for t in g.tables}
    return Slicer(g, frames, _KEYS)


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _cut(spark, sf_dir, at: str, roots: list[tuple[str, str]], **ways) -> DataFrame:
    return slicer(spark, sf_dir, graph(**ways)).run([Root(*r) for r in roots])[at]


_DOWN = {"orders_customer": {FWD, REV}, "lineitem_orders": {FWD, REV}, "customer_nation": {FWD}, "nation_region": {FWD}}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of three customers' orders."""
    return _cut(spark, sf_dir, "lineitem", [("customer", "c_custkey IN (1, 2, 3)")], **_DOWN)


# slices


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def root_filter(spark, sf_dir):
    return _cut(spark, sf_dir, "customer", [("customer", "WHERE c_acctbal > 5000")], orders_customer={FWD}).select("c_custkey", "c_name")


@query("SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def forward_slice(spark, sf_dir):
    return _cut(spark, sf_dir, "customer", [("orders", "o_totalprice > 200000")], orders_customer={FWD})


@query("SELECT * FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING')")
def reverse_slice(spark, sf_dir):
    return _cut(spark, sf_dir, "orders", [("customer", "c_mktsegment = 'BUILDING'")], orders_customer={REV})


@query("SELECT l.* FROM lineitem l WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))")
def multi_hop_down(spark, sf_dir):
    return _cut(spark, sf_dir, "lineitem", [("customer", "c_nationkey = 7")], orders_customer={REV}, lineitem_orders={REV})


@query("SELECT n.* FROM nation n WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 10 UNION SELECT s_nationkey FROM supplier WHERE s_suppkey < 10)")
def diamond_dedup(spark, sf_dir):
    return _cut(spark, sf_dir, "nation", [("customer", "c_custkey < 10"), ("supplier", "s_suppkey < 10")], customer_nation={FWD}, supplier_nation={FWD})


@query("SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def no_backtrack(spark, sf_dir):
    """An order brings its customer, and the customer doesn't bring its other orders."""
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return _cut(spark, sf_dir, "orders", [("orders", f"o_orderkey = {first}")], orders_customer={FWD, REV})


@query("SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 5))")
def direction_filter(spark, sf_dir):
    return _cut(spark, sf_dir, "region", [("customer", "c_custkey < 5")], customer_nation={FWD}, nation_region={FWD}, orders_customer={FWD})


@query("SELECT * FROM customer WHERE c_nationkey < 5 OR c_acctbal < 0")
def multi_root(spark, sf_dir):
    return _cut(spark, sf_dir, "customer", [("customer", "c_nationkey < 5"), ("customer", "c_acctbal < 0")], customer_nation={FWD})


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("l_suppkey"))
    return lines, lines.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()


_PAIR_GRAPH = SchemaGraph(
    {"line": Table("line", "line", ("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")), "partsupp": Table("partsupp", "partsupp", ("ps_partkey", "ps_suppkey"))},
    {"line_partsupp": Reference("line_partsupp", "line", ("l_partkey", "l_suppkey"), "partsupp", ("ps_partkey", "ps_suppkey"))},
)
_PAIRS = "WITH line AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS l_suppkey FROM lineitem), partsupp AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM line) "


@query(_PAIRS + "SELECT * FROM line WHERE EXISTS (SELECT 1 FROM partsupp WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND ps_partkey % 3 = 0)")
def composite_fk(spark, sf_dir):
    lines, pairs = _pairs(spark, sf_dir)
    return Slicer(_PAIR_GRAPH, {"line": lines, "partsupp": pairs}).run([Root("partsupp", "ps_partkey % 3 = 0")])["line"]


@query(_PAIRS + "SELECT * FROM partsupp WHERE EXISTS (SELECT 1 FROM line WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_quantity > 30)")
def composite_null_key(spark, sf_dir):
    """Keys with a null part match nothing, though the other side has the same null."""
    lines, pairs = _pairs(spark, sf_dir)
    return Slicer(_PAIR_GRAPH, {"line": lines, "partsupp": pairs}).run([Root("line", "l_quantity > 30")])["partsupp"]


_CLOSURE = """
WITH RECURSIVE walk(t, k, via) AS (
  SELECT 'orders', o_orderkey, '' FROM orders WHERE o_orderkey < 20
  UNION
  SELECT * FROM (
    SELECT 'customer', o.o_custkey, 'oc>' FROM walk w JOIN orders o ON w.t = 'orders' AND o.o_orderkey = w.k WHERE w.via <> 'oc<'
    UNION ALL SELECT 'orders', o.o_orderkey, 'oc<' FROM walk w JOIN orders o ON w.t = 'customer' AND o.o_custkey = w.k WHERE w.via <> 'oc>'
    UNION ALL SELECT 'nation', c.c_nationkey, 'cn>' FROM walk w JOIN customer c ON w.t = 'customer' AND c.c_custkey = w.k WHERE w.via <> 'cn<'
    UNION ALL SELECT 'customer', c.c_custkey, 'cn<' FROM walk w JOIN customer c ON w.t = 'nation' AND c.c_nationkey = w.k WHERE w.via <> 'cn>'
    UNION ALL SELECT 'supplier', s.s_suppkey, 'sn<' FROM walk w JOIN supplier s ON w.t = 'nation' AND s.s_nationkey = w.k WHERE w.via <> 'sn>'
    UNION ALL SELECT 'nation', s.s_nationkey, 'sn>' FROM walk w JOIN supplier s ON w.t = 'supplier' AND s.s_suppkey = w.k WHERE w.via <> 'sn<'
  )
) SELECT t AS table_id, k AS row_key FROM walk GROUP BY t, k
"""
_CYCLIC = {"orders_customer": {FWD, REV}, "customer_nation": {FWD, REV}, "supplier_nation": {FWD, REV}}


@query(_CLOSURE)
def full_closure_all(spark, sf_dir):
    """All references both ways: rounds until nothing is new."""
    found = slicer(spark, sf_dir, graph(**_CYCLIC)).run([Root("orders", "o_orderkey < 20")])
    parts = [df.select(F.lit(t).alias("table_id"), F.col(_KEYS[t][0]).cast("long").alias("row_key")) for t, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def full_closure_first(spark, sf_dir):
    """The same with each row expanding from its first arrival alone."""
    found = slicer(spark, sf_dir, graph(**_CYCLIC)).run([Root("orders", "o_orderkey < 20")], arrival="first")
    return rows.counts(found)


_FOLDERS = SchemaGraph({"directory": Table("directory", "directory", ("id", "parent_id"))}, {"up": Reference("up", "directory", ("parent_id",), "directory", ("id",), deferrable=True)})


def _folders(spark, sf_dir, parent: Column) -> DataFrame:
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), parent.cast("long").alias("parent_id"))
    return Slicer(_FOLDERS, {"directory": own}, {"directory": ["id"]}).run([Root("directory", "id = 3")])["directory"]


def _folders_sql(parent: str) -> str:
    return f"""WITH RECURSIVE d AS (SELECT n_nationkey::BIGINT AS id, ({parent})::BIGINT AS parent_id FROM nation), walk(id, via) AS (
      SELECT id, '' FROM d WHERE id = 3 UNION SELECT * FROM (
        SELECT p.id, '>' FROM walk w JOIN d c ON c.id = w.id JOIN d p ON p.id = c.parent_id WHERE w.via <> '<'
        UNION ALL SELECT c.id, '<' FROM walk w JOIN d c ON c.parent_id = w.id WHERE w.via <> '>'))
    SELECT * FROM d WHERE id IN (SELECT id FROM walk)"""


@query(_folders_sql("CASE WHEN n_nationkey > 0 THEN floor((n_nationkey - 1) / 2) END"))
def self_ref_tree(spark, sf_dir):
    k = F.col("n_nationkey")
    return _folders(spark, sf_dir, F.when(k > 0, F.floor((k - 1) / 2)))


@query(_folders_sql("(n_nationkey * 7 + 1) % 25"))
def self_ref_cycle(spark, sf_dir):
    return _folders(spark, sf_dir, (F.col("n_nationkey") * 7 + 1) % 25)


_SLICED = "WITH o AS (SELECT * FROM orders WHERE o_custkey IN (1, 2, 3)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), c AS (SELECT * FROM customer WHERE c_custkey IN (1, 2, 3)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)) "


@query(_SLICED + "SELECT * FROM l")
def slice_lineitems(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(_SLICED + "SELECT 'customer' AS table_id, count(*)::BIGINT AS row_count FROM c UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'region', count(*) FROM r")
def row_counts_manifest(spark, sf_dir):
    return rows.counts(slicer(spark, sf_dir, graph(**_DOWN)).run([Root("customer", "c_custkey IN (1, 2, 3)")]))


@query("SELECT 'orders' AS id, greatest((SELECT max(o_orderkey) FROM orders), 100)::BIGINT AS last_value UNION ALL SELECT 'customer', greatest((SELECT max(c_custkey) FROM customer), 1000000)")
def sequence_high_water(spark, sf_dir):
    now = spark.createDataFrame([("orders", 100), ("customer", 1000000)], "id string, last_value long")
    dumped = [table(spark, sf_dir, t).agg(F.max(k).alias("last_value")).select(F.lit(t).alias("id"), "last_value") for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"))]
    return rows.high_water(now, dumped[0].unionByName(dumped[1]))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_acctbal > 0 AND c_custkey = o_custkey)")
def orphan_check(spark, sf_dir):
    return rows.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_custkey")


# catalog queries' shapes


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey)::VARCHAR AS names, list(n_nationkey ORDER BY n_nationkey)[1]::INTEGER AS first_key, 'region.' || n_regionkey AS id FROM nation GROUP BY n_regionkey")
def schema_json(spark, sf_dir):
    """Ordered collection of structs, as the schema's column lists are built."""
    own = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    names = F.concat(F.lit("["), F.array_join(F.transform(own, lambda x: x["n_name"]), ", "), F.lit("]"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"), own[0]["n_nationkey"].cast("int").alias("first_key")).withColumn("id", F.concat(F.lit("region."), F.col("n_regionkey").cast("string")))


@query("SELECT n_regionkey, json('{' || string_agg(to_json(n_name) || ':' || n_nationkey, ',' ORDER BY n_name) || '}')::VARCHAR AS keys, json_object('id', n_regionkey, 'first', min(n_name), 'nations', count(*))::VARCHAR AS summary FROM nation GROUP BY n_regionkey")
def json_objects(spark, sf_dir):
    """Objects by key from rows, and objects built of named values."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))))
    made = F.struct(F.col("n_regionkey").alias("id"), F.min("n_name").alias("first"), F.count("*").alias("nations"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(pairs).alias("keys"), F.to_json(made).alias("summary"))


@query("SELECT * FROM (SELECT count(*)::BIGINT AS n_customers, max(c_custkey)::BIGINT AS last_customer FROM customer) CROSS JOIN (SELECT count(*)::BIGINT AS n_orders, max(o_orderkey)::BIGINT AS last_order FROM orders)")
def single_rows(spark, sf_dir):
    """A cross join of aggregates that are one row each."""
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("n_customers"), F.max("c_custkey").alias("last_customer")).crossJoin(table(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_order")))


@query("SELECT r_regionkey, pos::INTEGER AS pos, key, label FROM (SELECT r_regionkey, unnest([0, 1, 2]) AS pos, unnest([r_regionkey, r_regionkey + 10, r_regionkey + 20])::INTEGER AS key, unnest([r_name, lower(r_name), 'x']) AS label FROM region)")
def ordinality_unnest(spark, sf_dir):
    k, n = F.col("r_regionkey"), F.col("r_name")
    z = F.arrays_zip(F.array(k, k + 10, k + 20).alias("key"), F.array(n, F.lower(n), F.lit("x")).alias("label"))
    return table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(z).alias("pos", "x")).select("r_regionkey", "pos", F.col("x.key").cast("int").alias("key"), F.col("x.label").alias("label"))


@query("SELECT c_custkey, s.n AS n_orders, s.last_key FROM customer c, LATERAL (SELECT count(*)::BIGINT AS n, max(o_orderkey) AS last_key FROM orders o WHERE o.o_custkey = c.c_custkey) s")
def lateral_agg(spark, sf_dir):
    for t in ("customer", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"lateral_{t}")
    return spark.sql("SELECT c_custkey, s.n AS n_orders, s.last_key FROM lateral_customer c, LATERAL (SELECT count(*) AS n, max(o_orderkey) AS last_key FROM lateral_orders o WHERE o.o_custkey = c.c_custkey) s")


@query("SELECT o_orderkey, o_orderkey * 65536 + o_orderkey % 65536 AS place, o_orderkey AS block, (o_orderkey % 65536)::BIGINT AS at FROM orders")
def rid_pack(spark, sf_dir):
    k = F.col("o_orderkey")
    place = rows.pack_place(k, k % 65536)
    return table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place"), rows.unpack_place(place)["block"].alias("block"), rows.unpack_place(place)["offset"].alias("at"))


# codec

_ENCODED = r"replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"


@query(f"SELECT doc_id, coalesce({_ENCODED}, '\\N') AS line FROM documents")
def copy_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", copytext.encode_field(F.col("text")).alias("line"))


@query("SELECT doc_id, text, n_chars FROM documents")
def copy_decode(spark, sf_dir):
    """Whole rows as lines and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return copytext.decode_rows(copytext.encode_rows(docs), docs.columns, docs.schema)


# transforms

_CASED = "CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN left(c_mktsegment, 1) || lower(substr(c_mktsegment, 2)) WHEN 3 THEN c_name END"


def _cased(spark, sf_dir) -> DataFrame:
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    text = F.when(k % 5 == 0, m).when(k % 5 == 1, F.lower(m)).when(k % 5 == 2, F.concat(F.substr(m, F.lit(1), F.lit(1)), F.lower(F.substr(m, F.lit(2))))).when(k % 5 == 3, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("x"))


def _h(x: str, key: str) -> str:
    return f"('0x' || substr(md5({x} || '{key}'), 1, 15))::BIGINT"


def _pick(values: tuple, h: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + ({h} % {len(values)})::INTEGER]"


def _as_written(value: str, model: str) -> str:
    return f"CASE WHEN regexp_full_match({model}, '[A-Z]+') THEN upper({value}) WHEN regexp_full_match({model}, '[a-z]+') THEN lower({value}) ELSE {value} END"


def _tx(expr: str) -> str:
    return f"SELECT c_custkey, x, {expr} AS y FROM (SELECT c_custkey, {_CASED} AS x FROM customer)"


def _scrub(spark, sf_dir, f) -> DataFrame:
    return _cased(spark, sf_dir).withColumn("y", f(F.col("x")))


@query(_tx(_as_written(_pick(LISTS["given_name"], _h("upper(x)", "abcgiven")), "x")))
def tx_given_name(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.given_name(c, "abcgiven"))


@query(_tx(_as_written(_pick(LISTS["surname"], _h("upper(x)", "abcsur")), "x")))
def tx_surname(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.surname(c, "abcsur"))


@query(_tx(_as_written(_pick(LISTS["city"], _h("x", "abccity")), "x")))
def tx_city(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.city(c, "abccity"))


@query(_tx(_pick(LISTS["state"], _h("upper(x)", "abcstate"))))
def tx_state(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.us_state(c, "abcstate"))


@query(_tx(_pick(LISTS["state_abbr"], _h("upper(x)", "abcstate"))))
def tx_state_abbr(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.us_state(c, "abcstate", abbr=True))


@query(_tx(f"(1 + {_h('x', 'abcstreetnumber')} % 9999)::VARCHAR || ' ' || " + _as_written(_pick(LISTS["street"], _h("x", "abcstreet")), "regexp_replace(x, '[^a-zA-Z]', '', 'g')")))
def tx_address1(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.address_line1(c, "abcstreet"))


@query(_tx(f"'#' || (1 + {_h('x', 'abcline2')} % 999)"))
def tx_address2(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.address_line2(c, "abcline2"))


def _geozip_sql() -> str:
    groups: dict[str, list[str]] = {}
    for z in LISTS["zip"]:
        groups.setdefault(z[:3], []).append(z)
    h = _h("x", "abczip")
    whens = " ".join(f"WHEN '{k}' THEN {_pick(tuple(v), h)}" for k, v in groups.items())
    return f"SELECT p_partkey, x, CASE left(x, 3) {whens} ELSE {_pick(LISTS['zip'], h)} END AS y FROM (SELECT p_partkey, lpad((p_partkey * 37 % 99999)::VARCHAR, 5, '0') AS x FROM part)"


@query(_geozip_sql())
def tx_geozip(spark, sf_dir):
    x = F.lpad((F.col("p_partkey") * 37 % 99999).cast("string"), 5, "0")
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x")).withColumn("y", native.geozip(F.col("x"), "abczip"))


_CHAR_HASH = "('0x' || substr(md5(md5(upper(x) || 'abcalnum') || (i - 1)::VARCHAR), 1, 8))::BIGINT"


@query(_tx(f"array_to_string(list_transform(string_split(x, ''), lambda c, i: CASE WHEN regexp_full_match(c, '[A-Z]') THEN chr((65 + {_CHAR_HASH} % 26)::INTEGER) WHEN regexp_full_match(c, '[a-z]') THEN chr((97 + {_CHAR_HASH} % 26)::INTEGER) WHEN regexp_full_match(c, '[0-9]') THEN chr((48 + {_CHAR_HASH} % 10)::INTEGER) ELSE c END), '')"))
def tx_alphanumeric(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.alphanumeric(c, "abcalnum"))


def _one(kind: str, config=None, mode: str = "native") -> Transforms:
    return Transforms.load({"transforms": {"t": {"class": kind, "config": config}}, "tables": {"t": {"columns": {"y": "t"}}}}, pepper="abc", mode=mode)


@query()
def tx_alphanumeric_unique(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: _one("AlphanumericTransform", {"unique": True}).column("t", c))


_WORD_TABLE: dict[int, list[str]] = {}
for _w in LISTS["word"]:
    _WORD_TABLE.setdefault(len(_w), []).append(_w)
_WORD_HASH = "('0x' || substr(md5(md5(upper(x) || 'abcword') || (i - 1)::VARCHAR), 1, 15))::BIGINT"
_WORD_PICK = "CASE length(c) " + " ".join(f"WHEN {n} THEN {_pick(tuple(v), _WORD_HASH)}" for n, v in _WORD_TABLE.items()) + f" ELSE {_pick(tuple(_WORD_TABLE[max(_WORD_TABLE)]), _WORD_HASH)} END"
_WORD_CASE = f"CASE WHEN regexp_full_match(c, '[A-Z]+') THEN upper({_WORD_PICK}) WHEN regexp_full_match(c, '[a-z]+') THEN lower({_WORD_PICK}) WHEN regexp_full_match(c, '[A-Z][a-z]+') THEN upper(left({_WORD_PICK}, 1)) || lower(substr({_WORD_PICK}, 2)) ELSE {_WORD_PICK} END"


@query(_tx(f"array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z]+|(?s:.)'), lambda c, i: CASE WHEN regexp_full_match(c, '[A-Za-z]+') THEN {_WORD_CASE} WHEN regexp_full_match(c, '[0-9]') THEN ({_WORD_HASH} % 10)::VARCHAR ELSE c END), '')"))
def tx_word(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.words(c, "abcword"))


@query(_tx("CASE WHEN x IS NOT NULL THEN 'X' END"))
def tx_const(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.const(c, "X"))


@query(_tx("NULL::VARCHAR"))
def tx_null(spark, sf_dir):
    return _scrub(spark, sf_dir, native.null)


@query(_tx("regexp_replace(x, 'u', '[$1]', 'gi')"))
def tx_replace(spark, sf_dir):
    return _scrub(spark, sf_dir, lambda c: native.replace(c, "u", "[$1]"))


_DATE = "SELECT o_orderkey, x, strftime(make_date(year(x::DATE), 1, 1) + (" + _h("x", "abcdate") + " % dayofyear(make_date(year(x::DATE), 12, 31)))::INTEGER, '%Y-%m-%d') AS y FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders)"


@query(_DATE)
def tx_date_year(spark, sf_dir):
    x = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")).withColumn("y", native.date_year(F.col("x"), "abcdate"))


@query(_tx("CASE WHEN x IS NULL OR contains(x, 'BUILD') THEN x ELSE 'DEMO ' || sum(CASE WHEN x IS NULL OR contains(x, 'BUILD') THEN 0 ELSE 1 END) OVER (ORDER BY c_custkey) END"))
def tx_incrementing(spark, sf_dir):
    t = _one("IncrementingConstTransform", {"value": "DEMO", "exclude": "BUILD"})
    return t.apply("t", _cased(spark, sf_dir).withColumn("y", F.col("x")), order=["c_custkey"])


@query("SELECT event_id, ('{\"k\":' || (props->>'k') || ',\"who\":\"X\"}') AS y FROM events")
def tx_json_path(spark, sf_dir):
    """A number isn't changed, a string is."""
    t = Transforms.load({"transforms": {"x": {"class": "ConstTransform", "config": "X"}, "j": {"class": "JsonPathTransform", "config": [{"path": "$.k", "transform": "x"}, {"path": "$.who", "transform": "x"}]}}}, pepper="abc")
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "who": "'), F.col("event_type"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", t.column("j", doc).alias("y"))


@query(_tx("replace(CASE WHEN x IS NOT NULL THEN '#' || (1 + " + _h("x", "abca") + " % 999) END, '#', 'No ')"))
def tx_compose(spark, sf_dir):
    t = Transforms.load({"transforms": {"a": {"class": "AddressLine2Transform"}, "b": {"class": "ReplaceTransform", "config": {"old": "#", "new": "No "}}, "c": {"class": "ComposeTransform", "config": ["a", "b"]}}}, pepper="abc")
    return _scrub(spark, sf_dir, lambda c: t.column("c", c))


@query(_tx("x"))
def tx_untouched(spark, sf_dir):
    """A table that the configuration doesn't name stays as it is."""
    return _one("ConstTransform", "X").apply("other", _cased(spark, sf_dir).withColumn("y", F.col("x")))


@query("SELECT c_custkey, c_nationkey, " + _pick(LISTS["given_name"], _h("upper(c_name)", "abcgiven")) + " AS c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey < 200)")
def slice_transformed(spark, sf_dir):
    own = _cut(spark, sf_dir, "customer", [("orders", "o_orderkey < 200")], orders_customer={FWD})
    t = Transforms.load({"transforms": {"given": {"class": "GivenNameTransform"}}, "tables": {"customer": {"columns": {"c_name": "given"}}}}, pepper="abc")
    return t.apply("customer", own).select("c_custkey", "c_nationkey", "c_name")


@query()
def tx_compat(spark, sf_dir):
    """Seeded draws by value, in pandas UDFs."""
    return _scrub(spark, sf_dir, lambda c: _one("AlphanumericTransform", mode="compat").column("t", c))


@query("SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey)::BIGINT AS k FROM orders")
def running_number(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return numbering.running_count(own, F.col("o_orderstatus") == "F", ["o_orderkey"], "k").select("o_orderkey", F.col("k").cast("long").alias("k"))


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000")
def distinct_parents(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey").distinct()


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS n, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 5000)::BIGINT AS segment FROM orders")
def segments(spark, sf_dir):
    """Rows in order of key in segments of a fixed size."""
    out = numbering.running_count(table(spark, sf_dir, "orders").select("o_orderkey"), F.lit(1), ["o_orderkey"], "n")
    return out.select("o_orderkey", F.col("n").cast("long").alias("n"), F.floor((F.col("n") - 1) / 5000).cast("long").alias("segment"))
