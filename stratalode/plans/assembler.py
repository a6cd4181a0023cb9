"""A small class-file writer, for the queries and tests that show extraction."""

from __future__ import annotations

import struct

FORMS = {3: ">Bi", 4: ">Bf", 5: ">Bq", 6: ">Bd", 7: ">BH", 8: ">BH", 9: ">BHH", 10: ">BHH", 12: ">BHH", 15: ">BBH", 16: ">BH", 17: ">BHH", 18: ">BHH"}


class Assembler:
    def __init__(self, name: str):
        self.pool, self.at, self.wide = [], {}, 0
        self.name, self.fields, self.methods, self.attributes = name, [], [], []

    def add(self, tag: int, *body) -> int:
        """Place of a constant in the pool."""
        key = (tag, body)
        if key not in self.at:
            self.pool.append(struct.pack(">BH", 1, len(body[0])) + body[0] if tag == 1 else struct.pack(FORMS[tag], tag, *body))
            self.at[key] = len(self.pool) + self.wide
            self.wide += tag in (5, 6)
        return self.at[key]

    def utf8(self, s: str) -> int:
        return self.add(1, s.encode())

    def cls(self, n: str) -> int:
        return self.add(7, self.utf8(n))

    def text(self, s: str) -> int:
        return self.add(8, self.utf8(s))

    def ref(self, owner: str, name: str, descriptor: str, tag: int = 10) -> int:
        return self.add(tag, self.cls(owner), self.add(12, self.utf8(name), self.utf8(descriptor)))

    def attribute(self, name: str, body: bytes) -> bytes:
        return struct.pack(">HI", self.utf8(name), len(body)) + body

    def method(self, name: str, descriptor: str, code: bytes, flags: int = 9, handlers=(), locals_: int = 8, more=()) -> None:
        lines = self.attribute("LineNumberTable", struct.pack(">HHH", 1, 0, 7))
        body = struct.pack(">HHI", 9, locals_, len(code)) + code + struct.pack(">H", len(handlers)) + b"".join(struct.pack(">HHHH", *h) for h in handlers)
        attributes = [self.attribute("Code", body + struct.pack(">H", 1) + lines), *more]
        self.methods.append(struct.pack(">HHHH", flags, self.utf8(name), self.utf8(descriptor), len(attributes)) + b"".join(attributes))

    def field(self, name: str, descriptor: str, constant: int | None = None, flags: int = 0x18, more=()) -> None:
        attributes = [self.attribute("ConstantValue", struct.pack(">H", constant))] if constant else []
        attributes += more
        self.fields.append(struct.pack(">HHHH", flags, self.utf8(name), self.utf8(descriptor), len(attributes)) + b"".join(attributes))

    def annotation(self, kind: str, element: str, value: str) -> bytes:
        """One annotation of one string element."""
        return struct.pack(">HHHBH", self.utf8(f"L{kind};"), 1, self.utf8(element), ord("s"), self.utf8(value))

    def annotations(self, kind: str, element: str, value: str, visible: bool = True) -> bytes:
        """The attribute of one annotation."""
        return self.attribute("RuntimeVisibleAnnotations" if visible else "RuntimeInvisibleAnnotations", struct.pack(">H", 1) + self.annotation(kind, element, value))

    def bytes(self) -> bytes:
        this, parent = self.cls(self.name), self.cls("java/lang/Object")
        tail = struct.pack(">HHHH", 1, this, parent, 0)
        for part in (self.fields, self.methods, self.attributes):
            tail += struct.pack(">H", len(part)) + b"".join(part)
        return struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(self.pool) + self.wide + 1) + b"".join(self.pool) + tail


def op(*parts) -> bytes:
    """Code of opcodes, small operands and bytes."""
    return b"".join(bytes([p]) if isinstance(p, int) else p for p in parts)


def u2(n: int) -> bytes:
    return struct.pack(">h", n)


def s4(*numbers: int) -> bytes:
    return struct.pack(f">{len(numbers)}i", *numbers)
