"""Abstract interpretation of method code: which constants may be in each slot, and what becomes of them.

A slot holds a set of entities, ("C", type, value) for a constant and
("R" or "P", type, site) for an object or a primitive of unknown value. A
worklist carries states along the flow graph and joins them, slot by slot,
until nothing grows; then every reached instruction is asked which constants it
uses, and how.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass, field

from .class_file import ClassFile, Code, Constant, Member, internal_name, java_descriptor, java_name, parameters, returned

MOST_ENTITIES = 32
LEAST_ROUNDS, ROUNDS_PER_INSTRUCTION = 25_000, 50
CONCAT_FACTORY = "java/lang/invoke/StringConcatFactory"
NUMERIC = {"Integer": "I", "Long": "J", "Float": "F", "Double": "D"}
OF_LETTER = {v: k for k, v in NUMERIC.items()}
WIDE = "JD"
Slot = tuple[frozenset, bool]


@dataclass
class Usage:
    constant: Constant
    structural: str
    context: dict
    offset: int
    line: int | None
    callee: tuple[str, str] | None = None


@dataclass
class State:
    stack: list[Slot]
    locals: dict[int, Slot]
    heap: dict[tuple, frozenset] = field(default_factory=dict)

    def copy(self) -> State:
        return State(list(self.stack), dict(self.locals), dict(self.heap))

    def join(self, other: State) -> bool:
        """Grows by another state; stacks of unlike depth shrink to the shorter one."""
        grown = False
        if len(self.stack) > len(other.stack):
            del self.stack[len(other.stack) :]
        for i in range(len(self.stack)):
            both = capped(self.stack[i][0] | other.stack[i][0])
            if both != self.stack[i][0]:
                self.stack[i], grown = (both, self.stack[i][1]), True
        for mine, theirs in ((self.locals, other.locals),):
            for k, (s, w) in theirs.items():
                have = mine.get(k, (frozenset(), w))
                both = capped(have[0] | s)
                if both != have[0] or k not in mine:
                    mine[k], grown = (both, w), True
        for k, s in other.heap.items():
            both = capped(self.heap.get(k, frozenset()) | s)
            if both != self.heap.get(k):
                self.heap[k], grown = both, True
        return grown


def capped(s: frozenset) -> frozenset:
    return s if len(s) <= MOST_ENTITIES else frozenset(sorted(s, key=repr)[:MOST_ENTITIES])


def unknown(descriptor: str, site: str) -> Slot:
    reference = descriptor[0] in "L["
    return frozenset([("R" if reference else "P", java_name(descriptor), site)]), descriptor in WIDE


def constant(c: Constant) -> Slot:
    return frozenset([("C", c.tag, c.value)]), NUMERIC.get(c.tag, "") in ("J", "D")


def narrowed(value, letter: str):
    """A number as the given type holds it."""
    if letter in "FD":
        if letter == "F":
            try:
                return struct.unpack(">f", struct.pack(">f", value))[0]
            except OverflowError:
                return float("inf") if value > 0 else float("-inf")
        return float(value)
    bits = {"B": 8, "S": 16, "C": 16, "I": 32, "J": 64}[letter]
    if isinstance(value, float):  # from floating point: no number is 0, the rest stops at the ends
        if value != value:
            value = 0
        else:
            top = 63 if letter == "J" else 31
            value = int(max(-(2.0**top), min(2.0**top, value)))
            value = max(-(1 << top), min((1 << top) - 1, value))
    value &= (1 << bits) - 1
    return value if letter == "C" or value < 1 << (bits - 1) else value - (1 << bits)


@dataclass
class Instruction:
    at: int
    op: int
    args: tuple
    next: int


def decode(code: bytes) -> list[Instruction]:
    out, i = [], 0
    u1 = lambda k: code[k]
    s1 = lambda k: struct.unpack_from(">b", code, k)[0]
    u2 = lambda k: struct.unpack_from(">H", code, k)[0]
    s2 = lambda k: struct.unpack_from(">h", code, k)[0]
    s4 = lambda k: struct.unpack_from(">i", code, k)[0]
    while i < len(code):
        op, start = code[i], i
        if op in (16, 188):
            args, i = (s1(i + 1),), i + 2
        elif op in (18, 169) or 21 <= op <= 25 or 54 <= op <= 58:
            args, i = (u1(i + 1),), i + 2
        elif op == 17:
            args, i = (s2(i + 1),), i + 3
        elif op == 132:
            args, i = (u1(i + 1), s1(i + 2)), i + 3
        elif 153 <= op <= 168 or op in (198, 199):
            args, i = (start + s2(i + 1),), i + 3
        elif op in (200, 201):
            args, i = (start + s4(i + 1),), i + 5
        elif op in (19, 20, 187, 189, 192, 193) or 178 <= op <= 184:
            args, i = (u2(i + 1),), i + 3
        elif op in (185, 186):
            args, i = (u2(i + 1),), i + 5
        elif op == 197:
            args, i = (u2(i + 1), u1(i + 3)), i + 4
        elif op == 170:
            p = (i + 4) & ~3
            low, high = s4(p + 4), s4(p + 8)
            args, i = tuple(start + s4(p + 4 * k) for k in (0, *range(3, 3 + high - low + 1))), p + 12 + 4 * (high - low + 1)
        elif op == 171:
            p = (i + 4) & ~3
            n = s4(p + 4)
            args, i = tuple(start + s4(q) for q in (p, *(p + 12 + 8 * k for k in range(n)))), p + 8 + 8 * n
        elif op == 196:
            op = code[i + 1]
            args, i = ((u2(i + 2), s2(i + 4)), i + 6) if op == 132 else ((u2(i + 2),), i + 4)
        else:
            args, i = (), i + 1
        out.append(Instruction(start, op, args, i))
    return out


ARRAY_TYPES = {4: "Z", 5: "C", 6: "F", 7: "D", 8: "B", 9: "S", 10: "I", 11: "J"}
BINARY = ("+", "-", "*", "/", "%")
CONVERSIONS = "JFDIFDIJDIJFBCS"  # of opcodes 133 and on
SHIFTS = ("<<", "<<", ">>", ">>", ">>>", ">>>", "&", "&", "|", "|", "^", "^")  # of opcodes 120 and on


class Method:
    """The analysis of one method."""

    def __init__(self, cf: ClassFile, member: Member):
        self.cf, self.m, self.code = cf, member, member.code
        self.instructions = decode(self.code.code)
        self.index = {x.at: k for k, x in enumerate(self.instructions)}
        self.truncated = False

    def successors(self, k: int) -> list[int]:
        x = self.instructions[k]
        op = x.op
        jumps = [self.index[t] for t in x.args] if 153 <= op <= 167 or op in (170, 171, 198, 199, 200) else []
        ends = op in (167, 169, 170, 171, 191, 200) or 172 <= op <= 177
        return jumps if ends or k + 1 >= len(self.instructions) else [*jumps, k + 1]

    def run(self) -> dict[int, State]:
        """The state before each instruction that is reached."""
        first: dict[int, Slot] = {}
        at = 0
        if not self.m.flags & 8:
            first[0] = (frozenset([("R", internal_name(self.cf.name), f"{self.cf.name}::<this>")]), False)
            at = 1
        for p in parameters(self.m.descriptor):
            first[at] = unknown(p, f"Param#{at}")
            at += 2 if p in WIDE else 1
        before = {0: State([], first)}
        after: dict[int, State] = {}
        work, rounds, most = deque([0]), 0, max(LEAST_ROUNDS, ROUNDS_PER_INSTRUCTION * len(self.instructions))
        while work:
            rounds += 1
            if rounds > most:
                self.truncated = True
                break
            k = work.popleft()
            now = before[k].copy()
            self.transfer(self.instructions[k], now)
            if k in after:
                after[k].join(now)
            else:
                after[k] = now
            here = self.instructions[k].at
            onward = [(s, after[k]) for s in self.successors(k)]
            for start, end, target, kind in self.code.handlers:
                if start <= here < end:  # a handler starts with the exception alone on the stack
                    for was in (before[k], after[k]):
                        caught = was.copy()
                        caught.stack = [(frozenset([("R", internal_name(kind), f"catch@{target}")]), False)]
                        onward.append((self.index[target], caught))
            for s, state in onward:
                if s not in before:
                    before[s] = state.copy()
                    work.append(s)
                elif before[s].join(state):
                    work.append(s)
        return before

    def transfer(self, x: Instruction, s: State) -> None:
        op, stack, site = x.op, s.stack, f"{self.m.name}@{x.at}"

        def pop(n: int = 1):
            if len(stack) < n:
                raise ValueError(f"stack underflow at {x.at}")
            got = stack[-n:]
            del stack[-n:]
            return got[0] if n == 1 else got

        push = stack.append
        fresh = lambda d: push(unknown(d, site))
        if op == 0 or op == 167 or op == 177 or op == 192 or op == 200:
            return
        if op == 1:
            push(constant(Constant("Null", None)))
        elif 2 <= op <= 8:
            push(constant(Constant("Integer", op - 3)))
        elif op in (9, 10):
            push(constant(Constant("Long", op - 9)))
        elif 11 <= op <= 13:
            push(constant(Constant("Float", float(op - 11))))
        elif op in (14, 15):
            push(constant(Constant("Double", float(op - 14))))
        elif op in (16, 17):
            push(constant(Constant("Integer", x.args[0])))
        elif 18 <= op <= 20:
            c = self.cf.constant(x.args[0])
            slot = constant(c)
            push((slot[0], op == 20))
        elif 21 <= op <= 45:
            n = x.args[0] if op <= 25 else (op - 26) % 4
            letter = "IJFDA"[op - 21 if op <= 25 else (op - 26) // 4]
            push(s.locals.get(n) or unknown("Ljava/lang/Object;" if letter == "A" else letter, site))
        elif 46 <= op <= 53:
            array = pop(2)[0]
            held = frozenset().union(*(s.heap.get(("array", e), frozenset()) for e in array[0]))
            letter = "IJFDABCS"[op - 46]
            push((capped(held), letter in WIDE) if held else unknown("Ljava/lang/Object;" if letter == "A" else letter, site))
        elif 54 <= op <= 78:
            n = x.args[0] if op <= 58 else (op - 59) % 4
            s.locals[n] = pop()
        elif 79 <= op <= 86:
            array, _, value = pop(3)
            for e in array[0]:  # whatever the place
                s.heap["array", e] = capped(s.heap.get(("array", e), frozenset()) | value[0])
        elif 87 <= op <= 95:
            self._shuffle(op, stack, x.at)
        elif 96 <= op <= 115:
            a, b = pop(2)
            letter = "IJFD"[op % 4]
            known = frozenset(e for e in a[0] | b[0] if e[0] == "C")
            rest = frozenset() if all(e[0] == "C" for e in a[0] | b[0]) and known else unknown(letter, site)[0]
            push((capped(known | rest), letter in WIDE))  # either operand's constants go on
        elif 116 <= op <= 119:
            pass
        elif 120 <= op <= 131:
            pop(2)
            fresh("IJ"[op % 2])
        elif op == 132:
            held = s.locals.get(x.args[0], unknown("I", site))
            s.locals[x.args[0]] = (frozenset(e if e[0] == "C" else ("P", "int", site) for e in held[0]), False)
        elif 133 <= op <= 147:
            letter = CONVERSIONS[op - 133]
            held = pop()[0]
            stored = letter if letter in "IJFD" else "I"
            push((frozenset(("C", OF_LETTER[stored], narrowed(e[2], letter)) if e[0] == "C" else ("P", java_name(letter), site) for e in held), stored in WIDE))
        elif 148 <= op <= 152:
            pop(2)
            fresh("I")
        elif 153 <= op <= 158 or op in (170, 171, 191, 194, 195, 198, 199) or 172 <= op <= 176:
            pop()
        elif 159 <= op <= 166:
            pop(2)
        elif op in (168, 169, 201):
            raise ValueError(f"subroutines are out of use (at {x.at})")
        elif op in (178, 180):
            owner, name, descriptor = self.cf.reference(x.args[0])
            held = frozenset()
            if op == 180:
                held = frozenset().union(*(s.heap.get((e, owner, name), frozenset()) for e in pop()[0]))
            else:
                held = s.heap.get(("static", owner, name), frozenset())
            push((held, descriptor in WIDE) if held else unknown(descriptor, f"{owner}.{name}"))
        elif op == 179:
            owner, name, _ = self.cf.reference(x.args[0])
            key = ("static", owner, name)
            s.heap[key] = capped(s.heap.get(key, frozenset()) | pop()[0])
        elif op == 181:
            owner, name, _ = self.cf.reference(x.args[0])
            target, value = pop(2)
            for e in target[0]:
                key = (e, owner, name)
                s.heap[key] = capped(s.heap.get(key, frozenset()) | value[0])
        elif 182 <= op <= 186:
            descriptor = self.cf.name_and_type(self.cf.pool[x.args[0]][2])[1]
            n = len(parameters(descriptor)) + (op not in (184, 186))
            if n:
                pop(n)
            if returned(descriptor) != "V":
                fresh(returned(descriptor))
        elif op == 187:
            name = self.cf.class_name(x.args[0])
            fresh(f"L{name};")
        elif op == 188:
            pop()
            fresh("[" + ARRAY_TYPES.get(x.args[0], "I"))
        elif op == 189:
            pop()
            name = self.cf.class_name(x.args[0])
            fresh("[" + (name if name.startswith("[") else f"L{name};"))
        elif op in (190, 193):
            pop()
            fresh("I")
        elif op == 197:
            pop(x.args[1])
            fresh(self.cf.class_name(x.args[0]))
        else:
            raise ValueError(f"unknown opcode {op} at {x.at}")

    @staticmethod
    def _shuffle(op: int, stack: list[Slot], at: int) -> None:
        """POP, DUP and SWAP forms; one entry is a value, which counts as two words if it is wide."""

        def words(n: int) -> list[Slot]:
            got, size = [], 0
            while size < n:
                if not stack:
                    raise ValueError(f"stack underflow at {at}")
                got.insert(0, stack.pop())
                size += 2 if got[0][1] else 1
            if size > n:
                raise ValueError(f"half of a wide value at {at}")
            return got

        if op in (87, 88):
            words(op - 86)
        elif op == 95:
            b, a = words(1), words(1)
            stack += b + a
        else:
            top = words(1 if op <= 91 else 2)
            under = words((op - 89) % 3) if (op - 89) % 3 else []
            stack += top + under + top

    def usages(self) -> list[Usage]:
        out: list[Usage] = []
        reached = self.run()
        starts = [p for p, _ in self.code.lines]
        for k, x in enumerate(self.instructions):
            if k in reached:
                place = bisect_right(starts, x.at) - 1
                self._asked(x, reached[k], self.code.lines[place][1] if place >= 0 else None, out)
        return out

    def _asked(self, x: Instruction, s: State, line: int | None, out: list[Usage]) -> None:
        op = x.op

        def top(n: int) -> Slot | None:
            return s.stack[-n] if n <= len(s.stack) else None

        def use(slot: Slot | None, structural: str, context: dict, callee=None) -> None:
            for e in sorted(slot[0], key=repr) if slot else ():
                if e[0] == "C":
                    out.append(Usage(Constant(e[1], e[2]), structural, context, x.at, line, callee))

        def receiver(slot: Slot | None) -> str:
            return "THIS" if slot and any(e[0] == "R" and e[2].endswith("::<this>") for e in slot[0]) else "EXTERNAL_OBJECT"

        if op in (179, 181):
            owner, name, descriptor = self.cf.reference(x.args[0])
            kind = "STATIC" if op == 179 else receiver(top(2))
            context = {"fieldOwner": internal_name(owner), "fieldName": name, "fieldDescriptor": java_name(descriptor), "receiverKind": kind}
            use(top(1), "STATIC_FIELD_STORE" if op == 179 else "FIELD_STORE", context)
        elif 182 <= op <= 185:
            owner, name, descriptor = self.cf.reference(x.args[0])
            n = len(parameters(descriptor))
            kind = "STATIC" if op == 184 else receiver(top(n + 1))
            context = {"calleeOwner": internal_name(owner), "calleeName": name, "calleeDescriptor": java_descriptor(descriptor), "receiverKind": kind}
            if op != 184:
                use(top(n + 1), "METHOD_INVOCATION_TARGET", context)
            for i in range(1, n + 1):
                use(top(i), "METHOD_INVOCATION_PARAMETER", context, (internal_name(owner), name))
        elif op == 186:
            boot, at = self.cf.pool[x.args[0]][1:3]
            name, descriptor = self.cf.name_and_type(at)
            handle, args = self.cf.bootstrap[boot]
            owner = self.cf.handle(handle)[1]
            n = len(parameters(descriptor))
            if name == "makeConcatWithConstants" and owner == CONCAT_FACTORY:
                recipe = str(self.cf.constant(args[0]).value) if args else ""
                for piece in dict.fromkeys(recipe.split("\x01")):
                    use(constant(Constant("String", piece)), "STRING_CONCATENATION_MEMBER", {"constantSource": "LITERAL"})
                for i in range(1, n + 1):
                    use(top(i), "STRING_CONCATENATION_MEMBER", {"constantSource": "RESOLVED_CONSTANT"})
            else:
                context = {"calleeOwner": internal_name(owner), "calleeName": name, "calleeDescriptor": java_descriptor(descriptor), "receiverKind": "STATIC"}
                for i in range(1, n + 1):
                    use(top(i), "METHOD_INVOCATION_PARAMETER", context, (internal_name(owner), name))
        elif op == 132:
            use(s.locals.get(x.args[0]), "ARITHMETIC_OPERAND", {"operator": "+="})
        elif 96 <= op <= 131 or 148 <= op <= 152:
            if op <= 115:
                symbol = BINARY[(op - 96) // 4]
            elif op <= 119:
                symbol = "-"
            elif op <= 131:
                symbol = SHIFTS[op - 120]
            else:
                symbol = ("lcmp", "fcmpl", "fcmpg", "dcmpl", "dcmpg")[op - 148]
            use(top(1), "ARITHMETIC_OPERAND", {"operator": symbol})
            if not 116 <= op <= 131:  # of negations, shifts and bit operations the top alone
                use(top(2), "ARITHMETIC_OPERAND", {"operator": symbol})


def method_usages(cf: ClassFile, member: Member) -> tuple[list[Usage], bool]:
    """(usages, whether the analysis was stopped before it settled) of a method with code."""
    m = Method(cf, member)
    return m.usages(), m.truncated


__all__ = ["Code", "Method", "Usage", "decode", "method_usages", "narrowed"]
