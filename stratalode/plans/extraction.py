"""Examples of extraction from class files, one for each kind of usage and of instruction.

Each assembles a class, extracts it and returns the usages; the SQL holds the
rows that must come out, written by hand.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import extract
from .assembler import Assembler, op, s4, u2
from .registry import example

PARAMETER, TARGET, ARITHMETIC = "METHOD_INVOCATION_PARAMETER", "METHOD_INVOCATION_TARGET", "ARITHMETIC_OPERAND"


def use(a: Assembler, descriptor: str = "I") -> bytes:
    """A call of a static method that takes the value on top of the stack."""
    return op(184, u2(a.ref("p/Q", "use", f"({descriptor})V")))


def _shown(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct usages: value, its type, the structural type and what metadata hold under the keys."""
    more = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in keys]
    return rows.select("value", "value_type", F.col("structural_type").alias("structural"), *more).distinct()


def _sql(keys: tuple[str, ...], rows: list[tuple]) -> str:
    names = ", ".join(["value", "value_type", "structural", *keys])
    if not rows:
        return f"SELECT * FROM (VALUES ({', '.join(['NULL::VARCHAR'] * (3 + len(keys)))})) t({names}) WHERE false"
    text = lambda x: "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


def method_query(name: str, rows: list[tuple], *keys: str, descriptor: str = "(I)V", flags: int = 9, cls: str = "p/T"):
    """Registers an example over the usages of one method; the function gives its code, or (code, handlers)."""

    def add(code_of: Callable[[Assembler], bytes | tuple]) -> None:
        def run(spark, sf_dir):
            a = Assembler(cls)
            made = code_of(a)
            code, handlers = made if isinstance(made, tuple) else (made, ())
            a.method("m", descriptor, code, flags=flags, handlers=handlers)
            return _shown(extract.extract(_file(spark, **{"T.class": a.bytes()})), keys)

        example(name, _sql(keys, rows))(run)

    return add


def _file(spark, **files: bytes) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


# Kinds of usage.


@method_query("E02_static_field_stores", [("%s", "String", "STATIC_FIELD_STORE", "FORMAT", "STATIC"), ("7", "Integer", "STATIC_FIELD_STORE", "N", "STATIC")], "fieldName", "receiverKind")
def _(a):
    return op(18, a.text("%s"), 179, u2(a.ref("p/T", "FORMAT", "Ljava/lang/String;", 9)), 16, 7, 179, u2(a.ref("p/T", "N", "I", 9)), 177)


@method_query(
    "E04_H10_string_concatenation",
    [("Hi ", "String", "STRING_CONCATENATION_MEMBER", "LITERAL"), ("!", "String", "STRING_CONCATENATION_MEMBER", "LITERAL"), ("5", "Integer", "STRING_CONCATENATION_MEMBER", "RESOLVED_CONSTANT")],
    "constantSource",
)
def _(a):
    handle = a.add(15, 6, a.ref("java/lang/invoke/StringConcatFactory", "makeConcatWithConstants", "()V"))
    a.attributes.append(a.attribute("BootstrapMethods", struct.pack(">HHHH", 1, handle, 1, a.text("Hi \x01!"))))
    dynamic = a.add(18, 0, a.add(12, a.utf8("makeConcatWithConstants"), a.utf8("(I)Ljava/lang/String;")))
    return op(8, 186, u2(dynamic), 0, 0, 87, 177)


@method_query("E05_H10_other_dynamic_calls", [("kept", "String", PARAMETER, "java.lang.invoke.LambdaMetafactory", "run", "STATIC")], "calleeOwner", "calleeName", "receiverKind")
def _(a):
    handle = a.add(15, 6, a.ref("java/lang/invoke/LambdaMetafactory", "metafactory", "()V"))
    a.attributes.append(a.attribute("BootstrapMethods", struct.pack(">HHH", 1, handle, 0)))
    dynamic = a.add(18, 0, a.add(12, a.utf8("run"), a.utf8("(Ljava/lang/String;)Ljava/lang/Runnable;")))
    return op(18, a.text("kept"), 186, u2(dynamic), 0, 0, 87, 177)


@method_query("E06_H08_increments", [("5", "Integer", ARITHMETIC, "+="), ("5", "Integer", PARAMETER, None)], "operator")
def _(a):  # x = 5; x += 3; use(x): the slot's constants are operands and go on; the increment is none
    return op(8, 59, 132, 0, 3, 26, use(a), 177)


@method_query("E07_H20_operands", [("2", "Integer", ARITHMETIC, "+"), ("3", "Integer", ARITHMETIC, "+"), ("4", "Integer", ARITHMETIC, "<<"), ("1", "Long", ARITHMETIC, "lcmp"), ("0", "Long", ARITHMETIC, "lcmp"), ("2.0", "Double", ARITHMETIC, "-")], "operator")
def _(a):  # 2 + 3; 5 << 4: of a shift the distance alone; 0L compared with 1L; -(2.0)
    return op(5, 6, 96, 87, 8, 7, 120, 87, 9, 10, 148, 87, 20, u2(a.add(6, 2.0)), 119, 88, 177)


@method_query(
    "E09_E01_receivers",
    [("t", "String", "FIELD_STORE", "THIS"), ("e", "String", "FIELD_STORE", "EXTERNAL_OBJECT"), ("s", "String", "STATIC_FIELD_STORE", "STATIC"), ("own", "String", PARAMETER, "THIS"), ("other", "String", PARAMETER, "EXTERNAL_OBJECT"), ("on", "String", TARGET, "EXTERNAL_OBJECT")],
    "receiverKind",
    descriptor="(Lp/T;)V",
    flags=1,
)
def _(a):
    field, fixed = u2(a.ref("p/T", "f", "Ljava/lang/String;", 9)), u2(a.ref("p/T", "F", "Ljava/lang/String;", 9))
    call, trim = u2(a.ref("p/T", "set", "(Ljava/lang/String;)V")), u2(a.ref("java/lang/String", "trim", "()Ljava/lang/String;"))
    return op(
        42, 18, a.text("t"), 181, field, 43, 18, a.text("e"), 181, field, 18, a.text("s"), 179, fixed,
        42, 18, a.text("own"), 182, call, 43, 18, a.text("other"), 182, call, 18, a.text("on"), 182, trim, 87, 177,
    )


NOTES = [
    ("/class", "String", "ANNOTATION_VALUE", "CLASS", "value"), ("${field}", "String", "ANNOTATION_VALUE", "FIELD", "value"),
    ("/method", "String", "ANNOTATION_VALUE", "METHOD", "path"), ("name", "String", "ANNOTATION_VALUE", "PARAMETER", "value"), ("hidden", "String", "ANNOTATION_VALUE", "METHOD", "name"),
]


@example("E10_annotations", _sql(("targetKind", "elementName"), NOTES))
def _(spark, sf_dir):
    a = Assembler("p/T")
    a.attributes.append(a.annotations("jakarta/ws/rs/Path", "value", "/class"))
    a.field("f", "Ljava/lang/String;", flags=2, more=[a.annotations("org/springframework/beans/factory/annotation/Value", "value", "${field}")])
    of_parameter = a.attribute("RuntimeVisibleParameterAnnotations", b"\x01" + struct.pack(">H", 1) + a.annotation("jakarta/inject/Named", "value", "name"))
    a.method("m", "(I)V", op(177), more=[a.annotations("org/springframework/web/bind/annotation/GetMapping", "path", "/method"), a.annotations("p/Note", "name", "hidden", visible=False), of_parameter])
    return _shown(extract.extract(_file(spark, **{"T.class": a.bytes()})), ("targetKind", "elementName"))


@example("E11_static_final_fields", _sql(("fieldName",), [("key", "String", "STATIC_FIELD_STORE", "K"), ("1.0E10", "Double", "STATIC_FIELD_STORE", "D"), ("-1", "Long", "STATIC_FIELD_STORE", "L")]))
def _(spark, sf_dir):
    a = Assembler("p/T")
    a.field("K", "Ljava/lang/String;", a.text("key"))
    a.field("D", "D", a.add(6, 1e10))
    a.field("L", "J", a.add(5, -1))
    a.field("NOT_FINAL", "I", a.add(3, 8), flags=8)
    return _shown(extract.extract(_file(spark, **{"T.class": a.bytes()})), ("fieldName",))


@method_query("E13_E14_E15_loop", [("0", "Integer", PARAMETER), ("0", "Integer", ARITHMETIC), ("2", "Integer", ARITHMETIC), ("2", "Integer", PARAMETER)], descriptor="()V")
def _(a):  # for (i = 0; i < 10; i += 3) use(i); use(i + 2)
    return op(3, 59, 26, 16, 10, 162, u2(13), 26, use(a), 132, 0, 3, 167, u2(-13), 26, 5, 96, use(a), 177)


@method_query("E15_stacks_of_unlike_depth", [("1", "Integer", PARAMETER)])
def _(a):  # one way leaves 1 and 2 on the stack, the other 1 alone: joined, the shorter one counts
    return op(4, 26, 153, u2(4), 5, use(a), 177)  # the jump lands on the call


@example("E16_failures_stay_in_their_file", "SELECT * FROM (VALUES ('bad.class', 0, 1), ('good.class', 1, 0), ('x.properties', 1, 0), ('y.bin', 0, 0)) t(path, n, errors) WHERE path <> 'y.bin'")
def _(spark, sf_dir):
    good, bad = Assembler("p/Good"), Assembler("p/Bad")
    good.method("m", "()V", op(8, use(good), 177))
    bad.method("m", "()V", op(8, use(bad), 177))
    bad.method("n", "()V", op(87, 177))  # takes from an empty stack
    rows = extract.extract(_file(spark, **{"good.class": good.bytes(), "bad.class": bad.bytes(), "x.properties": b"k=v", "y.bin": b"?"}))
    return rows.groupBy("path").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n"), F.count("error").alias("errors"))


@example("A13_extraction_counters", "SELECT * FROM (VALUES ('processed', 3), ('BadClass', 2), ('ValueError', 1)) t(outcome, files)")
def _(spark, sf_dir):
    good, bad = Assembler("p/Good"), Assembler("p/Bad")
    good.method("m", "()V", op(8, use(good), 177))
    bad.method("n", "()V", op(87, 177))
    files = {"a.class": good.bytes(), "b.properties": b"k=v", "c.yml": b"a: 1", "d.class": b"nothing", "e.class": b"", "f.class": bad.bytes()}
    return extract.counters(extract.extract(_file(spark, **files)))


SEEDED = "(1,'a.jar','stored'),(1,'b.jar','stored'),(2,'a.jar','stored'),(2,'b.jar','deleted'),(3,'a.jar','stored'),(3,'b.jar','stored'),(3,'c.jar','stored')"


@example("S20_S19_V10_seeding", f"SELECT * FROM (VALUES {SEEDED}) t(version, path, state)")
def _(spark, sf_dir):
    """Three folders of archives: the second lacks b.jar, the third has it again and c.jar besides."""

    def jar(**entries: str) -> bytearray:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in entries.items():
                z.writestr(zipfile.ZipInfo(f"{name}.properties"), text)
        return bytearray(out.getvalue())

    rows = [("v1/b.jar", jar(x="k=1"), 1), ("v1/a.jar", jar(x="k=1", y="l=2"), 1), ("v1/notes.txt", bytearray(b""), 1), ("v2/a.jar", jar(x="k=3"), 2)]
    rows += [(f"v3/{n}.jar", jar(x="k=4"), 3) for n in "abc"]
    tables = extract.seed(spark.createDataFrame(rows, "path string, content binary, version int"), "p")
    stored = tables["unit_descriptors"].select("version", "path", F.lit("stored").alias("state"))
    return stored.union(tables["version_deletions"].select("version", F.col("unit_path").alias("path"), F.lit("deleted").alias("state")))


# Kinds of instruction: what a call is given after them.


def _given(*values: str, kind: str = "Integer") -> list[tuple]:
    return [(v, kind, PARAMETER) for v in values]


@method_query("H01_H02_H17_H18_arrays", _given("42") + _given("in", kind="String"))
def _(a):  # new int[1] and new String[1]: what is stored anywhere in them is what is loaded
    numbers = op(4, 188, 10, 76, 43, 3, 16, 42, 79, 43, 3, 46, use(a))
    strings = op(4, 189, u2(a.cls("java/lang/String")), 77, 44, 3, 18, a.text("in"), 83, 44, 3, 50, use(a, "Ljava/lang/String;"))
    return numbers + strings + op(43, 190, use(a), 177)  # a length isn't known


@method_query("H03_H27_branches", _given("10", "20") + _given("1.0", "2.0", kind="Float"))
def _(a):  # use(x == 0 ? 20 : 10); use(o == null ? 2f : 1f)
    first = op(26, 153, u2(8), 16, 10, 167, u2(5), 16, 20, use(a))
    return first + op(1, 198, u2(7), 12, 167, u2(4), 13, use(a, "F"), 177)


@method_query(
    "H04_constants",
    _given("-1", "5", "-7", "300", "70000") + _given("1", "5000000000", kind="Long") + _given("2.0", kind="Float") + [("1.0", "Double", PARAMETER), ("text", "String", PARAMETER), ("null", "Null", PARAMETER)],
)
def _(a):
    ints = b"".join(op(x, use(a)) for x in (op(2), op(8), op(16, 256 - 7), op(17, u2(300)), op(18, a.add(3, 70000))))
    longs = op(10, use(a, "J"), 20, u2(a.add(5, 5000000000)), use(a, "J"))
    return ints + longs + op(13, use(a, "F"), 15, use(a, "D"), 18, a.text("text"), use(a, "Ljava/lang/String;"), 1, use(a, "Ljava/lang/Object;"), 177)


@method_query("H05_C16_conversions", _given("44", "65535", "2147483647", "-32768") + _given("1", "-9223372036854775808", kind="Long") + _given("3.0", kind="Double"))
def _(a):  # (byte) 300, (char) -1, (int) 1e20, (short) 32768, (long) 1, (long) -1e300, (double) 3
    narrow = op(17, u2(300), 145, use(a), 2, 146, use(a), 20, u2(a.add(6, 1e20)), 142, use(a), 18, a.add(3, 32768), 147, use(a))
    return narrow + op(4, 133, use(a, "J"), 20, u2(a.add(6, -1e300)), 143, use(a, "J"), 6, 135, use(a, "D"), 177)


@example("H06_subroutines_are_refused", "SELECT * FROM (VALUES ('T.class', 1, 0)) t(path, errors, n)")
def _(spark, sf_dir):
    a = Assembler("p/T")
    a.method("m", "()V", op(168, u2(4), 177, 75, 169, 0))
    rows = extract.extract(_file(spark, **{"T.class": a.bytes()}))
    return rows.groupBy("path").agg(F.count("error").alias("errors"), F.count("value").alias("n"))


@method_query("H07_fields", _given("kept", "shared", kind="String") + [("kept", "String", "FIELD_STORE"), ("shared", "String", "STATIC_FIELD_STORE")], descriptor="()V", flags=1)
def _(a):  # this.f = "kept"; use(this.f); F = "shared"; use(F); use(G)
    field, fixed, other = (u2(a.ref("p/T", n, "Ljava/lang/String;", 9)) for n in ("f", "F", "G"))
    s = use(a, "Ljava/lang/String;")
    return op(42, 18, a.text("kept"), 181, field, 42, 180, field, s, 18, a.text("shared"), 179, fixed, 178, fixed, s, 178, other, s, 177)


@method_query("H09_calls", [("a", "String", PARAMETER, "virtual"), ("b", "String", PARAMETER, "special"), ("c", "String", PARAMETER, "fixed"), ("d", "String", PARAMETER, "interface")], "calleeName", descriptor="(Lp/T;)V")
def _(a):  # results of calls aren't known, so the last call adds nothing
    d = "(Ljava/lang/String;)I"
    code = op(42, 18, a.text("a"), 182, u2(a.ref("p/T", "virtual", d)), 87, 42, 18, a.text("b"), 183, u2(a.ref("p/T", "special", d)), 87)
    return code + op(18, a.text("c"), 184, u2(a.ref("p/T", "fixed", d)), 87, 42, 18, a.text("d"), 185, u2(a.ref("p/T", "interface", d)), 2, 0, use(a), 177)


@method_query("H11_H23_locals", _given("9", "8", "3") + _given("4", kind="Long"))
def _(a):  # short, wide and numbered forms; a long takes two slots
    wide = op(16, 8, 196, 54, u2(300), 196, 21, u2(300), use(a))
    return op(16, 9, 54, 5, 21, 5, use(a)) + wide + op(6, 62, 29, use(a), 20, u2(a.add(5, 4)), 55, 6, 22, 6, use(a, "J"), 177)


@method_query("H12_lookup_switch", _given("11", "12", "13"))
def _(a):  # at 1, padded to 4: default 40, 2 pairs (5 -> 28, 900 -> 34)
    return op(26, 171, 0, 0, s4(39, 2, 5, 27, 900, 33), 16, 11, use(a), 177, 16, 12, use(a), 177, 16, 13, use(a), 177)


@method_query("H13_table_switch", _given("11", "12", "13"))
def _(a):  # at 1, padded to 4: default 36, from 0 to 1: 24, 30
    return op(26, 170, 0, 0, s4(35, 0, 1, 23, 29), 16, 11, use(a), 177, 16, 12, use(a), 177, 16, 13, use(a), 177)


@method_query("H14_H19_monitor_and_nop", _given("5"), descriptor="(Ljava/lang/Object;)V")
def _(a):
    return op(42, 194, 0, 8, use(a), 0, 42, 195, 177)


@method_query("H15_arrays_of_arrays", _given("6"))
def _(a):  # the sizes aren't usages
    return op(5, 6, 197, u2(a.cls("[[I")), 2, 87, 16, 6, use(a), 177)


@method_query("H16_new_objects", [("arg", "String", PARAMETER, "p.Made", "<init>")], "calleeOwner", "calleeName")
def _(a):
    return op(187, u2(a.cls("p/Made")), 89, 18, a.text("arg"), 183, u2(a.ref("p/Made", "<init>", "(Ljava/lang/String;)V")), 87, 177)


@method_query("H21_F07_returns_and_unreachable_code", _given("1"), descriptor="(I)I")
def _(a):  # what stands after the return is never reached
    return op(4, use(a), 5, 172, 6, use(a), 7, 172)


@method_query("H22_stack_forms", _given("2", "4", "5", "7") + _given("1", kind="Long"))
def _(a):
    swap = op(4, 5, 95, 87, use(a))  # 1 2 -> 2 1 -> 2
    under = op(6, 7, 90, 88, use(a))  # 3 4 -> 4 3 4 -> 4
    both = op(8, 16, 7, 92, use(a), use(a), 88)  # 5 7 -> 5 7 5 7: 7, then 5
    wide = op(10, 92, 88, use(a, "J"))  # one long is two words
    return swap + under + both + wide + op(177)


@method_query("H24_K03_throws", [("boom", "String", PARAMETER, "java.lang.IllegalStateException")], "errorClass", descriptor="()V")
def _(a):
    name = "java/lang/IllegalStateException"
    return op(187, u2(a.cls(name)), 89, 18, a.text("boom"), 183, u2(a.ref(name, "<init>", "(Ljava/lang/String;)V")), 191, 4, use(a), 177)


@method_query("H25_type_checks", _given("cast", kind="String"))
def _(a):  # a cast keeps the value, instanceof gives an unknown number
    object_ = u2(a.cls("java/lang/Object"))
    return op(18, a.text("cast"), 192, object_, use(a, "Ljava/lang/Object;"), 18, a.text("asked"), 193, object_, use(a), 177)


@method_query("H26_exception_handlers", _given("caught", "before", kind="String"), descriptor="()V")
def _(a):  # a handler begins with the exception alone; locals stored in its range may hold either value
    s = use(a, "Ljava/lang/String;")
    code = op(18, a.text("before"), 75, 18, a.text("in"), 87, 177, 87, 18, a.text("caught"), s, 42, s, 177)
    return code, [(3, 6, 7, 0)]


@method_query("H28_value_forms", [("java.lang.String", "ClassDescriptor", PARAMETER), ("(int)void", "String", PARAMETER), ("handle:STATIC:p.Q#go(int)void", "MethodHandle", PARAMETER)])
def _(a):
    handle = a.add(15, 6, a.ref("p/Q", "go", "(I)V"))
    o = use(a, "Ljava/lang/Object;")
    return op(18, a.cls("java/lang/String"), o, 18, a.add(16, a.utf8("(I)V")), o, 18, handle, o, 177)


#: Opcode and the operator it is written as.
ARITHMETIC_OPCODES = [
    (96, "+"), (97, "+"), (98, "+"), (99, "+"), (100, "-"), (101, "-"), (102, "-"), (103, "-"), (104, "*"), (105, "*"), (106, "*"), (107, "*"),
    (108, "/"), (109, "/"), (110, "/"), (111, "/"), (112, "%"), (113, "%"), (114, "%"), (115, "%"), (116, "-"), (117, "-"), (118, "-"), (119, "-"),
    (120, "<<"), (121, "<<"), (122, ">>"), (123, ">>"), (124, ">>>"), (125, ">>>"), (126, "&"), (127, "&"), (128, "|"), (129, "|"), (130, "^"), (131, "^"),
    (148, "lcmp"), (149, "fcmpl"), (150, "fcmpg"), (151, "dcmpl"), (152, "dcmpg"),
]


@example("C21_operator_symbols", "SELECT * FROM (VALUES " + ", ".join(f"({o}, '{s}')" for o, s in ARITHMETIC_OPCODES) + ") t(opcode, operator)")
def _(spark, sf_dir):
    """What the interpreter calls each arithmetic instruction, from a class that holds one method for each."""
    a = Assembler("p/T")
    push = {"I": op(5), "J": op(10), "F": op(13), "D": op(15)}
    for code, _ in ARITHMETIC_OPCODES:
        kind = "JFFDD"[code - 148] if code >= 148 else "IJ"[code % 2] if code >= 120 else "IJFD"[code % 4]
        second = b"" if 116 <= code <= 119 else op(5) if 120 <= code <= 125 else push[kind]
        a.method(f"m{code}", "()V", push[kind] + second + op(code, 177))
    rows = extract.extract(_file(spark, **{"T.class": a.bytes()}))
    return rows.select(F.substring("method_name", 2, 9).cast("int").alias("opcode"), F.get_json_object("metadata", "$.operator").alias("operator")).distinct()
