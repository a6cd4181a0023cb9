"""Sources: class files assembled here byte by byte, archives, YAML, properties, the queue as a stream."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalode.operators import store
from stratalode.plans.assembler import Assembler, op, u2
from stratalode.sources import archives, config_files, extract
from stratalode.sources.class_file import java_descriptor, java_name, java_number, modified_utf8, storable
from stratalode.sources.interpreter import narrowed
from stratalode.streaming import job_tracking, outbox


def golden(data):
    """{value: usages}"""
    out = {}
    for r in extract.file_usages("X.class", data):
        assert r["error"] is None, r["error"]
        out.setdefault(r["value"], set()).add(r["structural_type"])
    return out


def test_calls_fields_and_semantics():
    a = Assembler("p/Greeter")
    code = op(
        18, a.text("SELECT 1"), 184, u2(a.ref("p/Q", "run", "(Ljava/lang/String;)V")),
        42, 18, a.text("kept"), 181, u2(a.ref("p/Greeter", "name", "Ljava/lang/String;", 9)),
        18, a.text("%s"), 179, u2(a.ref("p/Greeter", "FORMAT", "Ljava/lang/String;", 9)),
        178, u2(a.ref("p/Greeter", "FORMAT", "Ljava/lang/String;", 9)), 182, u2(a.ref("java/lang/String", "trim", "()Ljava/lang/String;")), 87, 177,
    )
    a.method("<init>", "()V", code, flags=1)
    assert golden(a.bytes()) == {"SELECT 1": {"METHOD_INVOCATION_PARAMETER"}, "kept": {"FIELD_STORE"}, "%s": {"STATIC_FIELD_STORE", "METHOD_INVOCATION_TARGET"}}
    rows = {r["value"]: r for r in extract.file_usages("X.class", a.bytes())}
    assert '"receiverKind": "THIS"' in rows["kept"]["metadata"] and rows["kept"]["line_number"] == 7 and rows["kept"]["class_name"] == "p.Greeter"


def test_rules_apply_to_calls():
    a = Assembler("p/L")
    log = a.ref("org/slf4j/Logger", "info", "(Ljava/lang/String;)V")
    error = a.ref("p/MyException", "<init>", "(Ljava/lang/String;)V")
    a.method("m", "(Lorg/slf4j/Logger;Lp/MyException;)V", op(42, 18, a.text("hello"), 185, u2(log), 1, 0, 43, 18, a.text("bad"), 183, u2(error), 177))
    got = {(r["value"], r["semantic_type"], r["confidence"]) for r in extract.file_usages("X.class", a.bytes())}
    assert got == {("hello", "LOG_MESSAGE", 0.95), ("bad", "ERROR_MESSAGE", 0.95)}


def test_loop_reaches_a_fixpoint():
    a = Assembler("p/Goto")
    use = a.ref("p/Goto", "use", "(I)V")
    # for (i = 0; i < 10; i += 3) { use(i); } use(i + 2)
    code = op(3, 59, 26, 16, 10, 162, u2(13), 26, 184, u2(use), 132, 0, 3, 167, u2(-13), 26, 5, 96, 184, u2(use), 177)
    a.method("run", "()V", code)
    assert golden(a.bytes()) == {"0": {"METHOD_INVOCATION_PARAMETER", "ARITHMETIC_OPERAND"}, "2": {"ARITHMETIC_OPERAND", "METHOD_INVOCATION_PARAMETER"}}


def test_string_concatenation():
    a = Assembler("p/Concat")
    handle = a.add(15, 6, a.ref("java/lang/invoke/StringConcatFactory", "makeConcatWithConstants", "()V"))
    recipe = a.text("Hi \x01!")
    a.attributes.append(a.attribute("BootstrapMethods", struct.pack(">HHHH", 1, handle, 1, recipe)))
    indy = a.add(18, 0, a.add(12, a.utf8("makeConcatWithConstants"), a.utf8("(I)Ljava/lang/String;")))
    a.method("m", "()V", op(8, 186, u2(indy), 0, 0, 87, 177))
    assert golden(a.bytes()) == {"Hi ": {"STRING_CONCATENATION_MEMBER"}, "!": {"STRING_CONCATENATION_MEMBER"}, "5": {"STRING_CONCATENATION_MEMBER"}}


def test_longs_shifts_and_stack_forms():
    a = Assembler("p/Sync")
    put = a.ref("p/Sync", "n", "J", 9)
    a.method("m", "()V", op(10, 9, 97, 179, u2(put), 4, 5, 120, 87, 6, 7, 92, 88, 95, 88, 177))
    got = golden(a.bytes())
    assert got["1"] == {"STATIC_FIELD_STORE", "ARITHMETIC_OPERAND"} and got["0"] == {"STATIC_FIELD_STORE", "ARITHMETIC_OPERAND"} and got["2"] == {"ARITHMETIC_OPERAND"}


def test_static_finals_annotations_and_handlers():
    a = Assembler("p/A")
    a.field("K", "Ljava/lang/String;", a.text("key"))
    a.field("D", "D", a.add(6, 1e10))
    element = struct.pack(">HB", a.utf8("value"), ord("[")) + struct.pack(">HBH", 1, ord("s"), a.utf8("/path"))
    note = struct.pack(">HHH", 1, a.utf8("Ljakarta/ws/rs/Path;"), 1) + element
    more = [a.attribute("RuntimeVisibleAnnotations", note)]
    a.method("m", "()V", op(18, a.text("in"), 87, 177, 87, 18, a.text("caught"), 184, u2(a.ref("p/A", "f", "(Ljava/lang/String;)V")), 177), handlers=[(0, 3, 4, 0)], more=more)
    rows = [(r["value"], r["value_type"], r["structural_type"], r["semantic_type"]) for r in extract.file_usages("X.class", a.bytes())]
    assert set(rows) == {
        ("key", "String", "STATIC_FIELD_STORE", "UNKNOWN"), ("1.0E10", "Double", "STATIC_FIELD_STORE", "UNKNOWN"), ("/path", "String", "ANNOTATION_VALUE", "API_ENDPOINT"), ("caught", "String", "METHOD_INVOCATION_PARAMETER", "UNKNOWN"),
    }


def test_broken_code_is_one_error():
    a = Assembler("p/Bad")
    a.method("m", "()V", op(87, 177))
    rows = list(extract.file_usages("Bad.class", a.bytes()))
    assert len(rows) == 1 and "underflow" in rows[0]["error"]
    assert "BadClass" in next(iter(extract.file_usages("x.class", b"nope")))["error"]


def test_names_and_numbers():
    assert java_name("[[Lp/A$B;") == "p.A.B[][]" and java_descriptor("(I[JLp/X;)V") == "(int,long[],p.X)void"
    assert [java_number(x) for x in (1.0, 0.1, 1e7, 1.5e-5, -0.0, float("nan"))] == ["1.0", "0.1", "1.0E7", "1.5E-5", "-0.0", "NaN"]
    assert narrowed(300, "B") == 44 and narrowed(-1, "C") == 65535 and narrowed(2**31, "I") == -(2**31) and narrowed(1e20, "I") == 2**31 - 1 and narrowed(float("nan"), "J") == 0
    assert modified_utf8(b"a\xc0\x80\xed\xa0\xbd\xed\xb8\x80") == "a\0😀" and storable("a\0\ud800") == "a\\0\\uD800"


def test_yaml_and_properties():
    text = b"server:\n  port: 8080\napp:\n  features: [one, {deep: 2}]\n  url: https://x\n  none: null\n---\n- 1\n---\non: true\n"
    assert list(config_files.yaml_values(text)) == [("server.port", 8080, "doc#0"), ("app.features[0]", "one", "doc#0"), ("app.features[1].deep", 2, "doc#0"), ("app.url", "https://x", "doc#0"), ("True", True, "doc#2")]
    assert list(config_files.properties_values(b"! c\na = b\\\n   c\nk\\ 1:\\u00e9\n\nz")) == [("a", "bc"), ("k 1", "é"), ("z", "")]
    row = next(r for r in extract.file_usages("a.yml", text) if r["value"] == "8080")
    assert (row["value_type"], row["semantic_type"], row["confidence"], row["method_descriptor"], row["line_number"]) == ("Integer", "CONFIGURATION_VALUE", 0.9, "doc#0", 0)


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives():
    deep = archive(**{"z.properties": b"z=1"})
    inner = archive(**{"n.properties": b"k=v", "lib.jar": deep})
    outer = archive(**{"application.yml": b"a: 1", "BOOT-INF/lib/n.jar": inner, "BOOT-INF/lib/same.jar": inner, "other/x.jar": inner, "BOOT-INF/lib/bad.jar": b"PK no"})
    got = [(e.container, e.depth, e.path, bool(e.error)) for e in archives.entries("o.jar", outer)]
    assert ("o.jar", 0, "/application.yml", False) in got and ("o.jar!/BOOT-INF/lib/n.jar", 1, "/n.properties", False) in got
    assert not any("same.jar" in c for c, *_ in got) and ("o.jar!/BOOT-INF/lib/bad.jar", 1, "/BOOT-INF/lib/bad.jar", True) in got
    assert {r["value"] for r in extract.file_usages("o.jar", outer) if not r["error"]} == {"1", "v"}  # one level down, not two
    assert [e.path for e in archives.entries("o.jar", outer, "/BOOT-INF")] == ["/application.yml", "/other/x.jar"]


def test_extraction_as_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.properties").write_bytes(b"url=https://x\nname=n")
    (tmp_path / "in/b.jar").write_bytes(archive(**{"c.yml": b"k: v"}))
    (tmp_path / "in/d.class").write_bytes(b"broken")
    files = extract.binary_files(spark, str(tmp_path / "in"))
    rows = extract.extract(files)
    assert {(r.value, r.semantic_type) for r in rows.where("error is null").collect()} == {("https://x", "URL_RESOURCE"), ("n", "CONFIGURATION_VALUE"), ("v", "CONFIGURATION_VALUE")}
    assert {(r.outcome, r.files) for r in extract.counters(rows).collect()} == {("processed", 2), ("BadClass", 1)}
    tables = extract.catalogue_rows(rows, "p", 1)
    assert tables["unit_constants"].count() == 3 and tables["unit_descriptors"].count() == 2
    assert extract.archive_entries(files.where(F.col("path").endswith(".jar"))).select("path").collect()[0].path == "/c.yml"
    store.write_partitioned(tables["unit_descriptors"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


QUEUE = "id long, project string, unit_path string, version int, payload_json string, attempts int, next_attempt_at timestamp"


def queue(spark):
    rows = [(i, "p", f"u{i}", 1, "{}" if i != 3 else "broken", 9 if i == 2 else 0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, project string, unit_path string, version int, payload_json string, attempts int")
    return df.withColumn("next_attempt_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def deliver(df):
    return df.select("id", (F.col("id") % 2 == 1).alias("ok"), (F.col("payload_json") == "broken").alias("corrupt"))


def test_queue_round(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    alive, dead, done = outbox.drain_once(queue(spark), now, deliver)
    assert {r.id for r in done.collect()} == {1, 5} and {r.id for r in dead.collect()} == {2, 3}
    assert {(r.id, r.attempts, str(r.next_attempt_at)) for r in alive.collect()} == {(0, 1, "2024-01-02 00:00:02"), (4, 1, "2024-01-02 00:00:02")}


def test_queue_round_of_unanswered_rows(spark):
    """A row that delivery doesn't answer has failed; it isn't lost."""
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    alive, dead, done = outbox.drain_once(queue(spark), now, lambda df: deliver(df).where("id <> 1"))
    assert {r.id for r in done.collect()} == {5} and {r.id for r in dead.collect()} == {2, 3} and {(r.id, r.attempts) for r in alive.collect()} == {(0, 1), (1, 1), (4, 1)}


def test_queue_stream(spark, tmp_path):
    """Delivered rows leave; failed and unanswered ones wait, are tried when they are due and die after ten attempts; a repeated round changes nothing."""
    queue(spark).coalesce(1).write.parquet(str(tmp_path / "q"))
    path, asked = str(tmp_path / "out"), lambda df: deliver(df).where("id <> 1")
    outbox.start(spark, str(tmp_path / "q"), QUEUE, path, str(tmp_path / "cp"), deliver=asked).awaitTermination()
    box = outbox.Outbox(spark, path, QUEUE, asked)
    read = lambda name: sorted(r.id for r in spark.read.parquet(f"{path}/{name}").collect())
    assert read("delivered") == [5] and read("dead") == [2, 3]
    assert {(r.id, r.attempts) for r in box.waiting().collect()} == {(0, 1), (1, 1), (4, 1)}
    later = "2099-01-01 00:00:00"
    box.retry("2000-01-01 00:00:00")  # nothing is due
    assert {(r.id, r.attempts) for r in box.waiting().collect()} == {(0, 1), (1, 1), (4, 1)}
    outbox.Outbox(spark, path, QUEUE, lambda df: df.select("id", F.lit(True).alias("ok"), F.lit(False).alias("corrupt")).where("id <> 4")).retry(later)
    assert read("delivered") == [0, 1, 5] and [(r.id, r.attempts) for r in box.waiting().collect()] == [(4, 2)]
    last = box.last()
    box.round(last, now=later)  # a repeat starts from the round before
    assert box.last() == last and {(r.id, r.attempts) for r in box.waiting().collect()} == {(0, 2), (1, 2), (4, 2)}


def test_job_stream(spark, tmp_path):
    """Counters go on over restarts of the stream."""
    schema, by = "job long, k string", ["job"]
    for steps in ([(1, "started"), (1, "processed"), (1, "failed"), (2, "processed")], [(2, "completed"), (1, "processed")]):
        spark.createDataFrame(steps, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        job_tracking.start(spark, str(tmp_path / "s"), schema, str(tmp_path / "jobs"), str(tmp_path / "cp"), by, "job long", F.col("k")).awaitTermination()
    got = job_tracking.Jobs(spark, str(tmp_path / "jobs"), by, "job long").table()
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, 3, "FAILED"), (2, 1, 0, 1, "COMPLETED")}
    assert [r.n for r in job_tracking.progress(spark.range(2500)).collect()] == [1000, 2000]


@pytest.mark.parametrize("name, kind", [("a.CLASS", "CLASS_FILE"), ("a.yaml", "YAML"), ("a.toml", None), ("x.zip", "JAR")])
def test_router(name, kind):
    assert extract.kind_of(name) == kind
