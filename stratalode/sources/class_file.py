"""Reader of JVM class files: constant pool, fields, methods, code, annotations."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


class BadClass(ValueError):
    """The bytes are no class file that can be read."""


class Input:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str):
        try:
            got = struct.unpack_from(">" + form, self.data, self.at)
        except struct.error as e:
            raise BadClass("cut short") from e
        self.at += struct.calcsize(">" + form)
        return got[0] if len(got) == 1 else got

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise BadClass("cut short")
        self.at += n
        return self.data[self.at - n : self.at]


def modified_utf8(raw: bytes) -> str:
    """Class files' UTF-8: NUL in two bytes, other planes as two surrogates; lone surrogates stay."""
    text = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


def storable(text: str) -> str:
    """NUL as backslash 0, lone surrogates as \\uXXXX."""
    return "".join("\\0" if c == "\0" else f"\\u{ord(c):04X}" if 0xD800 <= ord(c) < 0xE000 else c for c in text)


PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def java_name(descriptor: str) -> str:
    """Name of a field descriptor's type: ``[Lp/A$B;`` is p.A.B[]."""
    depth = len(descriptor) - len(descriptor.lstrip("["))
    base = descriptor[depth:]
    name = PRIMITIVES.get(base) or base.removeprefix("L").removesuffix(";").replace("/", ".").replace("$", ".")
    return name + "[]" * depth


def internal_name(name: str) -> str:
    return java_name(name if name.startswith("[") else f"L{name};")


def parameters(descriptor: str) -> list[str]:
    """Field descriptors of a method descriptor's parameters."""
    out, i = [], 1
    while descriptor[i] != ")":
        start = i
        while descriptor[i] == "[":
            i += 1
        i = descriptor.index(";", i) + 1 if descriptor[i] == "L" else i + 1
        out.append(descriptor[start:i])
    return out


def returned(descriptor: str) -> str:
    return descriptor[descriptor.index(")") + 1 :]


def java_descriptor(descriptor: str) -> str:
    """``(a,b)ret`` of a method descriptor; a field's is ``()type``."""
    if not descriptor.startswith("("):
        return "()" + java_name(descriptor)
    return f"({','.join(map(java_name, parameters(descriptor)))}){java_name(returned(descriptor))}"


@dataclass
class Constant:
    """A value that code can hold: its type tag and how it is written."""

    tag: str
    value: object


@dataclass
class Code:
    max_locals: int
    code: bytes
    handlers: list[tuple[int, int, int, str]]
    lines: list[tuple[int, int]]


@dataclass
class Member:
    flags: int
    name: str
    descriptor: str
    code: Code | None = None
    constant: Constant | None = None
    annotations: list = field(default_factory=list)
    parameter_annotations: list = field(default_factory=list)


HANDLE_KINDS = ("", "GETTER", "STATIC_GETTER", "SETTER", "STATIC_SETTER", "VIRTUAL", "STATIC", "SPECIAL", "CONSTRUCTOR", "INTERFACE_VIRTUAL")


class ClassFile:
    def __init__(self, data: bytes):
        r = Input(data)
        if r.take("I") != 0xCAFEBABE:
            raise BadClass("no class file")
        r.take("HH")
        self._pool(r)
        self.flags = r.take("H")
        self.name = self.class_name(r.take("H"))
        r.take("H")
        for _ in range(r.take("H")):
            r.take("H")
        self.bootstrap: list[tuple[int, list[int]]] = []
        self.annotations: list = []
        self.fields = [self._member(r) for _ in range(r.take("H"))]
        self.methods = [self._member(r) for _ in range(r.take("H"))]
        for name, body in self._attributes(r):
            if name == "BootstrapMethods":
                for _ in range(body.take("H")):
                    handle = body.take("H")
                    self.bootstrap.append((handle, [body.take("H") for _ in range(body.take("H"))]))
            elif name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                self.annotations += self._annotations(body)

    def _pool(self, r: Input) -> None:
        count = r.take("H")
        self.pool: list[tuple] = [()] * count
        i = 1
        while i < count:
            tag = r.take("B")
            if tag == 1:
                self.pool[i] = (1, modified_utf8(r.bytes(r.take("H"))))
            elif tag in (3, 4, 5, 6):
                self.pool[i] = (tag, r.take({3: "i", 4: "f", 5: "q", 6: "d"}[tag]))
            elif tag in (7, 8, 16, 19, 20):
                self.pool[i] = (tag, r.take("H"))
            elif tag in (9, 10, 11, 12, 17, 18):
                self.pool[i] = (tag, *r.take("HH"))
            elif tag == 15:
                self.pool[i] = (tag, *r.take("BH"))
            else:
                raise BadClass(f"constant pool tag {tag}")
            i += 2 if tag in (5, 6) else 1

    def utf8(self, i: int) -> str:
        return self.pool[i][1]

    def class_name(self, i: int) -> str:
        return self.utf8(self.pool[i][1])

    def name_and_type(self, i: int) -> tuple[str, str]:
        return self.utf8(self.pool[i][1]), self.utf8(self.pool[i][2])

    def reference(self, i: int) -> tuple[str, str, str]:
        """(owner, name, descriptor) of a field or method."""
        return self.class_name(self.pool[i][1]), *self.name_and_type(self.pool[i][2])

    def handle(self, i: int) -> tuple[str, str, str, str]:
        _, kind, ref = self.pool[i]
        return HANDLE_KINDS[kind], *self.reference(ref)

    def constant(self, i: int, depth: int = 0) -> Constant:
        """A loadable constant; method handles, types and dynamic ones are written out."""
        tag = self.pool[i][0]
        if tag in (3, 4, 5, 6):
            return Constant({3: "Integer", 4: "Float", 5: "Long", 6: "Double"}[tag], self.pool[i][1])
        if tag == 8:
            return Constant("String", self.utf8(self.pool[i][1]))
        if tag == 7:
            name = self.class_name(i)
            return Constant("ArrayDesc" if name.startswith("[") else "ClassDescriptor", internal_name(name))
        if tag == 15:
            kind, owner, name, descriptor = self.handle(i)
            return Constant("MethodHandle", f"handle:{kind}:{internal_name(owner)}#{name}{java_descriptor(descriptor)}")
        if tag == 16:
            return Constant("String", java_descriptor(self.utf8(self.pool[i][1])))
        if tag == 17:
            handle, args = self.bootstrap[self.pool[i][1]]
            name, type_ = self.name_and_type(self.pool[i][2])
            _, owner, method, _ = self.handle(handle)
            shown = ",".join(written(self.constant(a, depth + 1)) for a in args) if depth < 20 else "..."
            return Constant("DynamicConstant", f"condy:{name}:{java_name(type_)}@{internal_name(owner)}#{method}({shown})")
        raise BadClass(f"constant pool tag {tag} can't be loaded")

    def _attributes(self, r: Input):
        for _ in range(r.take("H")):
            name, size = self.utf8(r.take("H")), r.take("I")
            yield name, Input(r.bytes(size))

    def _member(self, r: Input) -> Member:
        flags, name, descriptor = r.take("HHH")
        m = Member(flags, self.utf8(name), self.utf8(descriptor))
        for attribute, body in self._attributes(r):
            if attribute == "Code":
                m.code = self._code(body)
            elif attribute == "ConstantValue":
                m.constant = self.constant(body.take("H"))
            elif attribute in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                m.annotations += self._annotations(body)
            elif attribute in ("RuntimeVisibleParameterAnnotations", "RuntimeInvisibleParameterAnnotations"):
                for _ in range(body.take("B")):
                    m.parameter_annotations += self._annotations(body)
        return m

    def _code(self, r: Input) -> Code:
        _, max_locals, size = r.take("HHI")
        code = r.bytes(size)
        handlers = []
        for _ in range(r.take("H")):
            start, end, target, kind = r.take("HHHH")
            handlers.append((start, end, target, self.class_name(kind) if kind else "java/lang/Throwable"))
        lines = [(body.take("H"), body.take("H")) for name, body in self._attributes(r) if name == "LineNumberTable" for _ in range(body.take("H"))]
        return Code(max_locals, code, handlers, sorted(lines))

    def _annotations(self, r: Input) -> list[tuple[str, str, Constant]]:
        """(annotation, element, constant) of all constants, those of nested arrays and annotations too."""
        out: list[tuple[str, str, Constant]] = []
        for _ in range(r.take("H")):
            self._annotation(r, out)
        return out

    def _annotation(self, r: Input, out: list) -> None:
        kind = java_name(self.utf8(r.take("H")))
        for _ in range(r.take("H")):
            self._element(r, kind, self.utf8(r.take("H")), out)

    def _element(self, r: Input, kind: str, element: str, out: list) -> None:
        tag = chr(r.take("B"))
        if tag in "BCDFIJSZ":
            value = self.pool[r.take("H")][1]
            value = bool(value) if tag == "Z" else chr(value) if tag == "C" else value
            name = {"B": "Byte", "C": "Character", "D": "Double", "F": "Float", "I": "Integer", "J": "Long", "S": "Short", "Z": "Boolean"}[tag]
            out.append((kind, element, Constant(name, value)))
        elif tag == "s":
            out.append((kind, element, Constant("String", self.utf8(r.take("H")))))
        elif tag == "e":
            r.take("HH")
        elif tag == "c":
            r.take("H")
        elif tag == "@":
            self._annotation(r, out)
        elif tag == "[":
            for _ in range(r.take("H")):
                self._element(r, kind, element, out)
        else:
            raise BadClass(f"annotation element {tag!r}")


def java_number(x: float, single: bool = False) -> str:
    """A floating-point value as Java writes it."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    import numpy as np

    digits = str(np.float32(x)) if single else repr(float(x))
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return np.format_float_positional(np.float32(x) if single else np.float64(x), unique=True, trim="0")
    mantissa, _, exponent = f"{np.format_float_scientific(np.float32(x) if single else np.float64(x), unique=True, trim='0')}".partition("e")
    return f"{mantissa}E{int(exponent)}" if exponent else digits


def written(c: Constant) -> str:
    """How a constant is stored."""
    if c.tag == "Null":
        return "null"
    if c.tag == "Boolean":
        return "true" if c.value else "false"
    if c.tag in ("Float", "Double"):
        return java_number(c.value, c.tag == "Float")
    return storable(str(c.value))
