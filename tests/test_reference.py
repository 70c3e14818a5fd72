"""The fixtures that slices, codecs, scrubbing and restoring have to get right."""

import io
import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomslice import cli
from loomslice.functions import compat, ffx, jsonpath
from loomslice.functions.registry import TransformError, Transforms
from loomslice.operators import rows
from loomslice.plans.graph import CycleError, Direction, Reference, Root, SchemaError, SchemaGraph, Table
from loomslice.plans.slicer import Slicer, automaton, topological
from loomslice.sources import archive, copytext, introspect, sqlscript
from loomslice.sources.restore import RestoreError, restore
from loomslice.streaming.scrub import scrub_stream

PEPPER = b"abc"


def family(**how):
    return SchemaGraph(
        {"parent": Table("parent", "parent", ("id",)), "child": Table("child", "child", ("id", "parent_id"))},
        {"up": Reference("up", "child", ("parent_id",), "parent", ("id",), **how)},
    )


def family_rows(spark):
    return {"parent": spark.createDataFrame([(1,), (2,)], "id int"), "child": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, parent_id int")}


def ids(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("arrival", ["all", "first"])
def test_parent_brings_children(spark, arrival):
    out = Slicer(family(), family_rows(spark)).run([Root("parent", "id = 1")], arrival=arrival)
    assert ids(out["parent"]) == [(1,)] and ids(out["child"]) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("arrival", ["all", "first"])
def test_child_brings_no_sibling(spark, arrival):
    out = Slicer(family(), family_rows(spark)).run([Root("child", "id = 1")], arrival=arrival)
    assert ids(out["parent"]) == [(1,)] and ids(out["child"]) == [(1, 1)]


@pytest.mark.parametrize("arrival", ["all", "first"])
@pytest.mark.parametrize("links", [[(1, None), (2, 1), (3, 1)], [(1, 2), (2, 3), (3, 1)]])
def test_directories(spark, links, arrival):
    g = SchemaGraph({"d": Table("d", "d", ("id", "parent_id"))}, {"up": Reference("up", "d", ("parent_id",), "d", ("id",), deferrable=True)})
    out = Slicer(g, {"d": spark.createDataFrame(links, "id int, parent_id int")}, {"d": ["id"]}).run([Root("d", "id = 1")], arrival=arrival)
    assert sorted(r["id"] for r in out["d"].collect()) == [1, 2, 3]


def test_null_key_parts_match_nothing(spark):
    df = spark.createDataFrame([(None, 1), (2, 2)], "a int, b int")
    other = df.toDF("x", "y")
    assert df.join(other, rows.keys_match(df, other, ["a", "b"], ["x", "y"]), "left_semi").count() == 1


def test_slices_are_closed_and_monotone(spark, sf):
    from loomslice.plans import catalog

    g = catalog.graph(orders_customer={Direction.FORWARD, Direction.REVERSE}, customer_nation={Direction.FORWARD}, nation_region={Direction.FORWARD})
    s = catalog.slicer(spark, sf, g)
    small, large = s.run([Root("orders", "o_orderkey < 5")]), s.run([Root("orders", "o_orderkey < 50")])
    for r in g.references.values():
        assert rows.orphans(small[r.table], small[r.to_table], list(r.columns), list(r.to_columns)).isEmpty()
    for t in small:
        assert small[t].exceptAll(large[t]).isEmpty()


def test_graph_errors_and_order():
    with pytest.raises(SchemaError, match="up"):
        SchemaGraph({"child": Table("child", "child", ("id",))}, {"up": Reference("up", "child", ("id",), "parent", ("id",))})
    with pytest.raises(SchemaError, match="lacks"):
        SchemaGraph.from_json({"tables": {"t": {"name": "t"}}})
    assert family().load_order() == ["parent", "child"]
    both = SchemaGraph(family().tables, {**family().references, "down": Reference("down", "parent", ("id",), "child", ("id",))})
    with pytest.raises(CycleError):
        both.load_order()
    loose = SchemaGraph(both.tables, {**family().references, "down": Reference("down", "parent", ("id",), "child", ("id",), deferrable=True)})
    assert loose.load_order() == ["parent", "child"]
    assert topological(automaton(family(), [Root("parent", "true")]), [Root("parent", "true")]) is not None
    assert SchemaGraph.from_json(json.dumps(family().to_json())).to_json() == family().to_json()


def test_children_filter():
    cut = family().children(["child"])
    assert cut.references["up"].directions == {Direction.FORWARD} and family().children(["parent"]).references["up"].directions == set(Direction)


HOSTILE = ["a", "\\N", "a\nb", "\t", "\\", "\\\\n", "\v\f\b\r", " \u0085", "", None, "trailing\\", "é\\t"]


def test_codec(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(HOSTILE)], "i int, x string")
    lines = copytext.encode_rows(df)
    assert all("\n" not in r[0] for r in lines.collect())
    assert ids(copytext.decode_rows(lines, ["i", "x"], df.schema).where("x is not null")) == ids(df.where("x is not null"))
    assert copytext.decode_rows(lines, ["i", "x"], df.schema).where("x is null").count() == 1
    known = spark.createDataFrame([("a",), ("\\N",), ("a\\nb",)], "x string").select(copytext.decode_field(F.col("x"))).collect()
    assert [r[0] for r in known] == ["a", None, "a\nb"]


def test_statements():
    assert list(sqlscript.statements('CREATE TABLE "a;b"();--foo;bar\nCREATE TABLE b();')) == ['CREATE TABLE "a;b"()', "--foo;bar\nCREATE TABLE b()"]
    assert list(sqlscript.statements("SELECT 'it''s; x' - 1; ;")) == ["SELECT 'it''s; x' - 1"]


@pytest.mark.parametrize(
    ("f", "text", "key", "want"),
    [
        (compat.address_line2, "Suite 101", PEPPER, "#897"), (compat.alphanumeric, "123 Main St $9.99", PEPPER, "850 Xxqy Wh $0.97"), (compat.date_year, "2005-03-09", PEPPER, "2005-08-19"),
        (compat.date_year, "9999-03-09", PEPPER, "9999-01-23"), (compat.alphanumeric, "foo", b"abcalphanumeric", "axl"), (compat.alphanumeric, "bar", b"abcalphanumeric", "fwe"),
    ],
)
def test_known_draws(f, text, key, want):
    assert f(text, key) == want


def test_fields():
    t = Transforms.load({"transforms": {"c": {"class": "ConstTransform", "config": "X"}, "r": {"class": "ReplaceTransform", "config": {"old": "a", "new": "b"}}, "n": {"class": "NullTransform"}, "i": {"class": "IncrementingConstTransform", "config": {"value": "DEMO"}}}}, pepper="abc")
    assert [t.field("c", "example"), t.field("r", "abaca"), t.field("n", "example")] == ["X", "bbbcb", ""]
    f = t.value("i")
    assert [f("foo"), f(""), f("bar")] == ["DEMO 1", "", "DEMO 2"]


def test_json_path():
    f = jsonpath.updater([("$.example1", str.upper), ("$..deep[*]", lambda x: x or "none")])
    assert f('{"example1":{"subobj":"foo"},"b":{"deep":["q",null,3]}}') == '{"example1":{"subobj":"foo"},"b":{"deep":["q","none",3]}}'
    assert f('{"example1": "é"}') == '{"example1":"\\u00c9"}' and f(None) is None
    with pytest.raises(ValueError):
        jsonpath.parse("$.a[")


@settings(max_examples=60, deadline=None)
@given(st.text("abcXYZ019", min_size=1, max_size=40), st.binary(min_size=1, max_size=8))
def test_encryption_inverts(text, key):
    alphabet = "abcXYZ0123456789"
    out = ffx.permute(key, alphabet, text)
    assert len(out) == len(text) and ffx.permute(key, alphabet, out, back=True) == text


def test_encryption_is_one_to_one():
    assert len({ffx.permute(PEPPER, "abcde", "".join(t)) for t in itertools.product("abcde", repeat=3)}) == 125


def test_registry_errors():
    with pytest.raises(TransformError, match="circle"):
        Transforms.load({"transforms": {"a": {"class": "ComposeTransform", "config": ["b"]}, "b": {"class": "ComposeTransform", "config": ["a"]}}})
    with pytest.raises(TransformError, match="no class"):
        Transforms.load({"transforms": {"a": {"class": "Nope"}}})
    with pytest.raises(TransformError, match="no transform"):
        Transforms.load({"tables": {"t": {"columns": {"c": "a"}}}})


class Shout:
    def value(self, text, key, config):
        return text and text.upper() + config


def test_plug_in(spark):
    t = Transforms.load({"transforms": {"s": {"class": "Shout", "module": __name__, "config": "!"}}, "tables": {"t": {"columns": {"x": "s"}}}}, pepper="abc")
    assert t.field("s", "hey") == "HEY!" and t.field("s", None) == ""


def test_native_and_compat_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("JANE",), ("jane",), ("Jane",)], "x string")
    for mode in ("native", "compat"):
        t = Transforms.load({"transforms": {"g": {"class": "CityTransform"}}, "tables": {"t": {"columns": {"x": "g"}}}}, pepper="abc", mode=mode)
        out = [r[0] for r in t.apply("t", df).collect()]
        assert out[:2] == [None, ""] and out[2].isupper() and out[3].islower()


def test_state_golden():
    assert Transforms.load({"transforms": {"": {"class": "UsStateTransform"}}}, pepper="abc").field("", "New York") == "Tennessee"


def test_lists_from_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("Ada\n\nBo\n")
    for mode in ("native", "compat"):
        t = Transforms.load({"transforms": {"n": {"class": "GivenNameTransform", "config": {"file": str(tmp_path / "names.txt")}}}, "tables": {"t": {"columns": {"x": "n"}}}}, pepper="abc", mode=mode)
        got = {r[0] for r in t.apply("t", spark.createDataFrame([(f"Name{i}",) for i in range(40)], "x string")).collect()}
        assert {x.title() for x in got} == {"Ada", "Bo"}
    with pytest.raises(TransformError):
        Transforms.load({"transforms": {"n": {"class": "DateYearTransform", "config": {"file": "x"}}}}, pepper="").field("n", "2020-01-01")


def test_root_condition_and_columns_named_like_where(spark):
    g = SchemaGraph({"t": Table("t", "t", ("where_flag",))})
    df = spark.createDataFrame([(1,), (2,)], "where_flag int")
    for text in ("where_flag = 1", "WHERE where_flag = 1", " where(where_flag = 1)"):
        assert [r[0] for r in Slicer(g, {"t": df}).run([Root("t", text)])["t"].collect()] == [1]


def test_repeated_rows_stay_on_all_routes(spark):
    g = SchemaGraph({"a": Table("a", "a", ("id",)), "b": Table("b", "b", ("id",)), "c": Table("c", "c", ("x", "y"))}, {"ca": Reference("ca", "c", ("x",), "a", ("id",)), "cb": Reference("cb", "c", ("y",), "b", ("id",))})
    one = spark.createDataFrame([(1,)], "id int")
    c = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "x int, y int")
    for roots in ([Root("a", "true")], [Root("a", "true"), Root("b", "true")]):
        assert Slicer(g, {"a": one, "b": one, "c": c}).run(roots)["c"].count() == 2


def test_pg_schema_and_sequences(spark):
    columns = spark.createDataFrame([("public", "child", "parent_id", 2), ("public", "child", "id", 1), ("public", "parent", "id", 1), ("public", "empty", None, None)], "schema string, name string, column string, position int")
    refs = spark.createDataFrame([("fk", "public", "child", "public", "parent", False, ["parent_id"], ["id"])], "conname string, from_schema string, from_table string, to_schema string, to_table string, condeferrable boolean, from_columns array<string>, to_columns array<string>")
    seqs = spark.createDataFrame([("public", "child_id_seq", "public", "child"), ("public", "free", None, None)], "schema string, name string, owner_schema string, owner_table string")
    g = introspect.pg_schema(refs, columns, seqs)
    assert g.tables["public.child"].columns == ("id", "parent_id") and g.tables["public.empty"].columns == ()
    assert set(g.references) == {"public.child.fk"} and g.tables["public.child"].sequences == ("public.child_id_seq",) and set(g.sequences) == {"public.child_id_seq", "public.free"}
    assert introspect.sequence_values(g, {"public.child": spark.createDataFrame([(7, 1), (9, 1)], "id int, parent_id int")}) == {"public.child_id_seq": 9}


def test_restore_creates_tables(spark, tmp_path):
    """From a slice with definitions in another dialect to tables that weren't there, and no row without its parent."""
    g = SchemaGraph({"made_p": Table("made_p", "made_p", ("id",)), "made_c": Table("made_c", "made_c", ("id", "p"))}, {"r": Reference("r", "made_c", ("p",), "made_p", ("id",))})
    p, c = spark.createDataFrame([(1,)], "id bigint"), spark.createDataFrame([(5, 1), (6, None)], "id int, p bigint")
    pre = [sqlscript.create_table("public", k, df.schema) for k, df in (("made_p", p), ("made_c", c))]
    archive.write_slice(g, {"made_p": p, "made_c": c}, f"file://{tmp_path}/s", pre=pre, post=sqlscript.add_references(g))
    assert restore(spark, g, f"file://{tmp_path}/s", include_schema=True) == ["made_p", "made_c"]
    assert spark.table("made_c").dtypes == [("id", "int"), ("p", "bigint")] and sorted(spark.table("made_c").collect()) == sorted(c.collect())
    archive.write_slice(g, {"made_c": spark.createDataFrame([(7, 99)], "id int, p bigint")}, f"file://{tmp_path}/bad")
    with pytest.raises(RestoreError):  # its parent is neither in the slice nor in the table
        restore(spark, g, f"file://{tmp_path}/bad")


def test_archive_restore(spark, tmp_path):
    g, data = family(), family_rows(spark)
    out = Slicer(g, data).run([Root("parent", "id = 1")])
    folder = f"file://{tmp_path}/slice"
    m = archive.write_slice(g, out, folder, pre=["SELECT 1"], post=["SELECT 2"])
    assert sum(s["rowCount"] for s in m["tables"]["child"]["segments"]) == 2
    archive.pack(folder, f"{tmp_path}/s.zip")
    again = archive.unpack(f"{tmp_path}/s.zip", f"file://{tmp_path}/again")
    assert archive.SliceReader(spark, again).statements("post-data") == ["SELECT 2"]
    spark.sql("CREATE TABLE parent (id int) USING parquet")
    spark.sql("CREATE TABLE child (id int, parent_id int) USING parquet")
    try:
        assert restore(spark, g, again, include_schema=True) == ["parent", "child"]
        assert ids(spark.table("parent")) == [(1,)] and ids(spark.table("child")) == [(1, 1), (2, 1)]
        spark.sql("CREATE TABLE other (id int) USING parquet")
        with pytest.raises(RestoreError, match="up"):
            only = archive.write_slice(g, {"child": data["child"], "parent": data["parent"].where("id = 9")}, f"file://{tmp_path}/bad")
            assert only["tables"]["parent"]["segments"] in ([], [{"rowCount": 0}])
            restore(spark, g, f"file://{tmp_path}/bad")
        assert set(introspect.from_catalog(spark).tables) >= {"parent", "child"} and introspect.row_estimates(spark, ["child"]) == {"child": 2}
    finally:
        for t in ("parent", "child", "other"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_script(spark):
    out = io.StringIO()
    sqlscript.write_script(family(), family_rows(spark), out, pre=["CREATE TABLE x ()"])
    text = out.getvalue()
    assert text.startswith("CREATE TABLE x ();\n") and 'COPY "parent" ("id") FROM stdin;\n1\n2\n\\.\n' in text


def test_infer(spark):
    d = family_rows(spark)
    assert introspect.infer_reference(d["child"], d["parent"], "parent_id", "id") and not introspect.infer_reference(d["parent"], d["child"], "id", "parent_id")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("Jane",)], "x string").write.parquet(f"{tmp_path}/in")
    t = Transforms.load({"transforms": {"g": {"class": "GivenNameTransform"}}, "tables": {"t": {"columns": {"x": "g"}}}}, pepper="abc")
    stream = scrub_stream(spark.readStream.schema("x string").parquet(f"{tmp_path}/in"), t, "t")
    q = stream.writeStream.format("memory").queryName("scrubbed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/at").start()
    q.awaitTermination()
    assert ids(spark.table("scrubbed")) == ids(t.apply("t", spark.createDataFrame([("Jane",)], "x string")))


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["transform-field", "--transforms", '{"a": {"class": "ConstTransform", "config": "X"}}', "--name", "a", "--pepper", "abc", "v"]) == 0
    assert capsys.readouterr().out == "X\n"
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps({"tables": {"nation": {"name": "nation", "columns": ["n_nationkey", "n_regionkey"]}, "region": {"name": "region", "columns": ["r_regionkey"]}}, "references": {"nr": {"table": "nation", "columns": ["n_regionkey"], "referenceTable": "region", "referenceColumns": ["r_regionkey"]}}}))
    cli.main(["dump", "--data", sf, "-s", str(schema), "-r", "region", "r_regionkey = 1", "-o", str(tmp_path / "x.zip"), "--output-type", "zip"])
    folder = archive.unpack(str(tmp_path / "x.zip"), str(tmp_path / "y"))
    assert archive.SliceReader(spark, f"file://{folder}").table("nation").count() == 5
    with pytest.raises(SchemaError):
        cli.main(["dump", "--data", sf, "-s", str(schema), "-r", "nowhere", "true", "-o", str(tmp_path / "z")])
