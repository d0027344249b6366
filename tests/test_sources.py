import gzip
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from lakeloom.operators import schemas
from lakeloom.operators.schemas import Field, Registry, Schema
from lakeloom.operators.store import Tables
from lakeloom.sources import formats, imports
from lakeloom.operators.catalog import ENTRIES, Filters
from lakeloom.streaming.incremental import ITEMS, REJECTED, ingest_stream


@pytest.mark.parametrize(
    "name, content, want",
    [("a.ndjson", "x", "ndjson"), ("a.json", '{"a":1}\n{"a":2}', "ndjson"), ("a.json", '[{"a":1}]', "json"), ("a.yml", "", "yaml"), ("a.csv.gz", "", "csv"), ("a", '{"a":1}\n{"b":2}\n', "ndjson"), ("a", '{"a":\n1}', "json"), ("a", "[1, 2]", "json"), ("a", "k: v", "yaml"), ("a", "a,b\n1,2", "csv"), ("a", "words", "unknown")],
)
def test_formats(spark, name, content, want):
    assert spark.range(1).select(formats.detect_format(F.lit(name), F.lit(content))).first()[0] == want


@pytest.mark.parametrize("cell, want", [("", "null"), (" 42 ", "42"), ("-1.5", "-1.5"), ("true", "true"), ("F", "false"), ('a"b', '"a\\"b"'), ("1e3", "1000.0"), ("0x1", '"0x1"')])
def test_cells(spark, cell, want):
    assert spark.range(1).select(formats.typed_cell(F.lit(cell))).first()[0] == want


def test_headers(spark):
    is_header = lambda *c: spark.range(1).select(formats.is_header(F.array(*map(F.lit, c)))).first()[0]
    assert is_header("name", "age") and not is_header("name", "3") and not is_header("---") and is_header("a", "")


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1}, {"n": 2}]')
    (tmp_path / "b.ndjson").write_text('{"n": 3}\n\nbroken\n{"n": 4}\n')
    (tmp_path / "c.yaml").write_text("n: 5\n---\n: : bad: [\n---\nn: 6\n")
    (tmp_path / "d.csv").write_text("name,age,city\nJohn, 30,NYC\nJane,25\n\"a\nb\",1,x,extra\n")
    (tmp_path / "e.txt").write_text("just words")
    (tmp_path / "f.json").write_bytes(gzip.compress(b'{"n": 7}'))
    (tmp_path / "g.json").write_bytes(zstandard.compress(b'{"n": 8}'))
    rows = formats.read_records(spark, str(tmp_path)).collect()
    good = [json.loads(r["record"]) for r in rows if r["record"]]
    assert sorted(r["n"] for r in good if "n" in r) == [1, 2, 3, 4, 5, 6, 7, 8]
    people = [r for r in good if "_row_number" in r]
    assert people[0] == {"name": "John", "age": 30, "city": "NYC", "_row_number": 1, "_column_count": 3} and people[2]["col_3"] == "extra" and people[2]["name"] == "a\nb"
    assert sum(r["error"] is not None for r in rows) == 2 and not formats.tolerable(spark.createDataFrame(rows))
    assert any(r.get("type") == "text" and r["words"] == 2 for r in good)


def test_lines(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"n":1}\n\nbad\n')
    assert formats.read_ndjson(spark, str(tmp_path), strict=False).count() == 1
    with pytest.raises(Exception, match="not JSON"):
        formats.read_ndjson(spark, str(tmp_path)).collect()


def test_envelopes_and_observations(spark):
    frame = lambda *r: spark.createDataFrame([(json.dumps(x),) for x in r], "record string")
    wrapped = frame({"schema": {"module": "m", "version": "v1", "name": "T"}, "data": {"a": 1}}, {"a": 2}).select(formats.unwrap(F.col("record")).alias("u")).select("u.*").collect()
    assert [tuple(r) for r in wrapped] == [('{"a":1}', "m@v1:T"), ('{"a": 2}', None)]
    seen = formats.observed_records(frame({"target": "//h", "current": {"records": [{"x": 1}, {"x": 2}]}}, {"target": "k", "current": {"y": 1}}, {"target": "e", "error": "down"})).collect()
    assert sorted((r["target"], r["record"] or "", r["error"] or "") for r in seen) == [("//h", '{"x":1}', ""), ("//h", '{"x":2}', ""), ("e", "", "down"), ("k", '{"y":1}', "")]
    rows = formats.manifest_rows(frame({"summary": {}, "actions": [{"target": "//a", "status": "ok"}, {"target": "b", "status": "failed"}]})).collect()
    assert [(r["entry_type"], r["target"], r["status"]) for r in rows if r["target"]] == [("action", "a", "converging"), ("action", "b", "failed")] and len(rows) == 3


@pytest.mark.parametrize("kind", ["ndjson", "csv", "yaml"])
def test_export_round_trip(spark, tmp_path, kind):
    records = spark.createDataFrame([('{"b":"x","a":1}',), ('{"a":2,"c":null}',)], "record string").coalesce(1)
    formats.export(records, str(tmp_path / "out"), kind)
    if kind == "csv":
        back = spark.read.option("header", True).csv(str(tmp_path / "out"))
        assert back.columns == ["a", "b", "c"] and sorted(r["a"] for r in back.collect()) == ["1", "2"]
    else:
        for part in (tmp_path / "out").glob("part*"):
            part.rename(part.with_suffix(f".{kind}"))
        assert sorted(json.loads(r["record"])["a"] for r in formats.read_records(spark, f"{tmp_path}/out/*.{kind}").collect()) == [1, 2]


def test_imports(spark):
    records = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate([{"id": "a", "v": 1}, {"v": 1, "id": "a"}, {"id": "a", "v": 2}, {"id": "b"}, {"x": 1}])], "seq long, record string")
    known = spark.createDataFrame([], "content_hash string, resource_id string, version int")
    items = imports.import_items(records, known, "base/x.#T", ["id"], ["seq"]).orderBy("seq").collect()
    assert [(r["seq"], r["version"]) for r in items] == [(0, 1), (2, 2), (3, 1), (4, 1)]
    assert items[0]["resource_id"] == items[1]["resource_id"] != items[2]["resource_id"] and items[3]["identity_json"] is None
    held = spark.createDataFrame([(r["content_hash"], r["resource_id"], r["version"]) for r in items], known.schema)
    assert imports.import_items(records, held, "base/x.#T", ["id"], ["seq"]).count() == 0
    more = spark.createDataFrame([(9, '{"id":"a","v":3}')], records.schema)
    assert imports.import_items(more, held, "base/x.#T", ["id"], ["seq"]).first()["version"] == 3
    places = imports.item_memberships(imports.hashed(records), "c", "seq").collect()
    assert sorted(r["item_index"] for r in places) == [0, 2, 3, 4]
    nested = spark.range(1).select(imports.identity_json(F.lit('{"m":{"n":[{"k":1}]},"z":"q"}'), ["m.n", "z"])).first()[0]
    assert json.loads(nested) == {"m.n": '{"k":1}', "z": "q"}


def registry():
    return Registry([
        Schema("base/core.#Item", schema_type="catchall"),
        Schema("aws.#Resource", {"Arn": Field("string", pattern="^arn:")}, identity=("Arn",), resource_type="aws.resource"),
        Schema("aws.#Instance", {"InstanceId": Field("string"), "State": Field("struct", fields={"Code": Field("int", least=0, most=99)}), "Type": Field("string", enum=("big", "small"), required=False)}, base="aws.#Resource", identity=("InstanceId",), tracked=("State",), resource_type="aws.ec2.instance"),
        Schema("aws.#Instances", is_list=True),
        Schema("aws.#Closed", {"a": Field("list", element=Field("number"))}, closed=True, resource_type="closed"),
    ])


def test_inference_and_chains(spark):
    reg = registry()
    good = {"Arn": "arn:1", "InstanceId": "i", "State": {"Code": 16}, "Type": "big"}
    assert reg.infer(good)[0] == "aws.#Instance" and reg.infer({"q": 1}) == ("base/core.#Item", 0.1, -1)
    assert reg.infer({"_schema": "CLOSED", "a": [1, 2.5]})[1] >= 0.9 and reg.infer([good], collection="collection")[0] == "aws.#Instances"
    assert reg.errors({"a": [1, "x"], "b": 1}, "aws.#Closed") == ["a[1]: not number", "b: not allowed"]
    assert reg.errors({**good, "State": {"Code": 100}, "Type": "odd"}, "aws.#Instance") == ["State.Code: over 99", "Type: not one of big, small"]
    assert reg.validate_chain({"Arn": "arn:1"}, "aws.#Instance")[0] == "aws.#Resource" and reg.validate_chain({"Arn": "x"}, "aws.#Instance")[0] == reg.fallback
    assert reg.score(reg.schemas["aws.#Instance"], {}, origin="aws-ec2-instances") == pytest.approx(0.15)
    assert reg.chain("aws.#Instance") == ["aws.#Instance", "aws.#Resource"] and reg.depth("aws.#Instance") == 1 and reg.most_specific_first()[0] == "aws.#Instance"
    assert "aws.#Resource" in reg.roots() and "aws.#Resource" not in reg.leaves() and reg.identity_root("aws.#Instance") == "aws.#Instance"
    records = spark.createDataFrame([(json.dumps(good), "aws.#Instance"), ('{"q":1}', "aws.#Instance"), ("{", "aws.#Instance"), (json.dumps({"Arn": "arn:2"}), "aws.#Closed")], "record string, schema string")
    assert {r["outcome"]: r["n"] for r in schemas.verify(records, reg).collect()} == {"OK": 1, "INVALID": 2, "ERROR": 1}


def test_generation(spark):
    records = spark.createDataFrame([('{"id":"a","n":1,"o":null,"l":[1]}',), ('{"id":"b","n":1.5,"s":{"k":1}}',)], "record string")
    made = schemas.generate_schema(records, "gen.#Item")
    assert made.identity == ("id",) and made.fields["id"] == Field("string") and made.fields["n"].kind == "number"
    assert made.fields["o"].nullable and not made.fields["o"].required and made.fields["l"].kind == "list" and made.fields["s"].kind == "struct"
    assert [s.name for s in schemas.generate_collection(records, registry(), "gen")] == ["gen.#Item", "gen.#Collection"]
    patterns = {"thing": (["id", "n"], ["zz"]), "other": (["q"], [])}
    best = schemas.best_pattern(records, patterns).first()
    assert best["pattern"] == "thing" and best["score"] == pytest.approx(0.8)


def test_incremental_ingest(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    (tmp_path / "in").mkdir()

    def turn(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(lines))
        q = ingest_stream(spark, source, store, checkpoint)
        q.awaitTermination(120)
        return Tables(spark, store).read("items", ITEMS)

    assert turn("a.ndjson", '{"n": 1}', '{"n":1}', '{"n":2}', "bad").count() == 2
    assert sorted(json.loads(r["record"])["n"] for r in turn("b.ndjson", '{"n":2}', "bad", "bad", "worse", " ", '{"n":3}').collect()) == [1, 2, 3]
    rejected = Tables(spark, store).read("rejected", REJECTED).collect()
    assert sorted((r["line"], r["lines"], r["batch"]) for r in rejected) == [("bad", 1, 0), ("bad", 2, 1), ("worse", 1, 1)]
    folders = Tables(spark, store).manifest()["items"][""]
    assert len(folders) == 2 and spark.read.parquet(folders[0]).count() == 2  # the second batch has not rewritten the first


def test_collections_commit_at_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "s"))
    items = spark.createDataFrame([('{"a":1}', 0), ('{"a": 1}', 1), ('{"a":2}', 2)], "record string, item_index long")
    assert imports.commit_collection(tables, "c1", items, 5) == 2 and tables.version() == 1
    assert imports.commit_collection(tables, "c2", items.limit(1), 6) == 1
    entries = tables.read("entries", ENTRIES)
    assert {(r["entry_type"], r["record_count"]) for r in entries.collect()} == {("item", 1), ("collection", 2), ("collection", 1)} and entries.count() == 4
    assert tables.read("memberships", "collection_id string, item_id string, item_index long").count() == 3
    records = spark.createDataFrame([("x", "aws.#Closed", '{"Arn":"arn:1"}')], "id string, schema string, record string")
    assert schemas.reinfer(records, registry()).first()["new_schema"] == "aws.#Resource"


def test_imported_collections_are_listed(spark, tmp_path):
    from lakeloom.api import Workspace

    w = Workspace(spark, str(tmp_path / "w"))
    items = spark.createDataFrame([('{"a":1}', 0), ('{"a":2}', 1)], "record string, item_index long")
    imports.commit_collection(w.store.tables, "c1", items, 86_400, schema="base/core.#Item", origin="here")
    imports.commit_collection(w.store.tables, "c1", items.limit(1), 86_401, schema="base/core.#Item", origin="here")
    rows = w.list_catalog(Filters(schema="core", origin="HERE", entry_types=("item",)), sort="size").collect()
    assert len(rows) == 2 and all(r["format"] == "json" and r["import_timestamp"] and r["collection_id"] == "c1" and r["size_bytes"] == 7 for r in rows)
    assert len(w.catalog().columns) == 26 and w.list_catalog(Filters(entry_types=("collection",))).first()["record_count"] == 1
    assert w.store.tables.read("payloads", imports.PAYLOADS).count() == 2


@pytest.mark.parametrize("whole", [formats.WHOLE, 0])
def test_json_files_of_any_size(spark, monkeypatch, whole):
    monkeypatch.setattr(formats, "WHOLE", whole)
    files = [("list", ' [ {"b": 1, "a": "x,]"} ,2,\n[3, [4]], null , "\u00e9" ] '), ("one", '{"b":2,"a":{"c":[]}}'), ("none", "[]"), ("bad", '[{"a":1}, {"a":}]'), ("cut", '[1, 2')]
    rows = formats.json_records(spark.createDataFrame(files, "path string, content string"), tolerant=True).collect()
    got = {p: [r["record"] for r in sorted(rows, key=lambda r: r["position"]) if r["path"] == p and not r["error"]] for p, _ in files}
    assert got["list"] == ['{"a":"x,]","b":1}', "2", "[3,[4]]", "null", '"é"'] and got["one"] == ['{"a":{"c":[]},"b":2}'] and got["none"] == []
    assert {r["path"] for r in rows if r["error"]} == {"bad", "cut"}
    with pytest.raises(Exception, match="not JSON: cut"):
        formats.json_records(spark.createDataFrame(files[4:], "path string, content string")).collect()


def test_a_json_list_of_over_128_megabytes(spark):
    files = spark.range(1).selectExpr("'big' AS path", "concat('[', array_join(transform(sequence(1, 35000), k -> concat('{\"k\":', k, ',\"v\":\"', repeat('x', 4000), '\"}')), ','), ']') AS content")
    rows = formats.json_records(files).selectExpr("position", "get_json_object(record, '$.k')::long AS k", "length(record) AS n")
    assert rows.agg(F.count("*"), F.sum("k"), F.max("position"), F.min("n")).first()[:3] == (35_000, 35_000 * 35_001 // 2, 34_999)
