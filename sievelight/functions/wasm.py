"""Bytes of WebAssembly modules to nested rows. The only row-wise Python of the engine; everything after it is native.

Bodies are read by one loop over the bytes that counts opcodes and keeps what control flow needs; operands are only read
where a listing is asked for.
"""

from __future__ import annotations

import bisect
import struct
from decimal import Decimal
from functools import lru_cache

# Fixed values of the binary format.
MAGIC, VERSION = b"\0asm", b"\x01\0\0\0"
EXTERN_KINDS = ("func", "table", "memory", "global")
VALUE_TYPES = {0x7F: "i32", 0x7E: "i64", 0x7D: "f32", 0x7C: "f64", 0x7B: "v128", 0x70: "funcref", 0x6F: "externref"}
_LOADS = "i32.load i64.load f32.load f64.load i32.load8_s i32.load8_u i32.load16_s i32.load16_u i64.load8_s i64.load8_u i64.load16_s i64.load16_u i64.load32_s i64.load32_u"
_STORES = "i32.store i64.store f32.store f64.store i32.store8 i32.store16 i64.store8 i64.store16 i64.store32"
_INT_TESTS = "eqz eq ne lt_s lt_u gt_s gt_u le_s le_u ge_s ge_u"
_FLOAT_TESTS = "eq ne lt gt le ge"
_INT_OPS = "clz ctz popcnt add sub mul div_s div_u rem_s rem_u and or xor shl shr_s shr_u rotl rotr"
_FLOAT_OPS = "abs neg ceil floor trunc nearest sqrt add sub mul div min max copysign"
_CONVERSIONS = """i32.wrap_i64 i32.trunc_f32_s i32.trunc_f32_u i32.trunc_f64_s i32.trunc_f64_u i64.extend_i32_s i64.extend_i32_u
i64.trunc_f32_s i64.trunc_f32_u i64.trunc_f64_s i64.trunc_f64_u f32.convert_i32_s f32.convert_i32_u f32.convert_i64_s f32.convert_i64_u
f32.demote_f64 f64.convert_i32_s f64.convert_i32_u f64.convert_i64_s f64.convert_i64_u f64.promote_f32 i32.reinterpret_f32 i64.reinterpret_f64
f32.reinterpret_i32 f64.reinterpret_i64 i32.extend8_s i32.extend16_s i64.extend8_s i64.extend16_s i64.extend32_s"""
_PLAIN = {0x00: "unreachable", 0x01: "nop", 0x05: "else", 0x0B: "end", 0x0F: "return", 0x1A: "drop", 0x1B: "select", 0xD1: "ref.is_null"}
_INDEXED = {0x0C: "br", 0x0D: "br_if", 0x10: "call", 0x20: "local.get", 0x21: "local.set", 0x22: "local.tee", 0x23: "global.get", 0x24: "global.set",
            0x25: "table.get", 0x26: "table.set", 0xD2: "ref.func"}
_BULK = ("i32.trunc_sat_f32_s i32.trunc_sat_f32_u i32.trunc_sat_f64_s i32.trunc_sat_f64_u i64.trunc_sat_f32_s i64.trunc_sat_f32_u i64.trunc_sat_f64_s i64.trunc_sat_f64_u "
         "memory.init data.drop memory.copy memory.fill table.init elem.drop table.copy table.grow table.size table.fill").split()
_BULK_OPERANDS = {8: 2, 9: 1, 10: 2, 11: 1, 12: 2, 13: 1, 14: 2, 15: 1, 16: 1, 17: 1}
_SIMD = {0: "v128.load", 11: "v128.store", 12: "v128.const", 13: "i8x16.shuffle", 14: "i8x16.swizzle", 15: "i8x16.splat", 16: "i16x8.splat",
    17: "i32x4.splat", 18: "i64x2.splat",
         19: "f32x4.splat", 20: "f64x2.splat", 77: "v128.not", 78: "v128.and", 80: "v128.or", 81: "v128.xor", 92: "v128.load32_zero",
         93: "v128.load64_zero"}
_ATOMIC = {0: "memory.atomic.notify", 1: "memory.atomic.wait32", 2: "memory.atomic.wait64", 3: "atomic.fence", 16: "i32.atomic.load",
    17: "i64.atomic.load",
           30: "i32.atomic.store", 31: "i64.atomic.store", 36: "i32.atomic.rmw.add", 37: "i64.atomic.rmw.add", 72: "i32.atomic.rmw.cmpxchg",
           73: "i64.atomic.rmw.cmpxchg"}


def opcode_table() -> dict[int, tuple[str, str]]:
    """Opcode to (name, immediate shape)."""
    out = {c: (n, "none") for c, n in _PLAIN.items()} | {c: (n, "u32") for c, n in _INDEXED.items()}
    out |= {0x02: ("block", "block"), 0x03: ("loop", "block"), 0x04: ("if", "block"), 0x0E: ("br_table", "br_table"),
        0x11: ("call_indirect", "u32u32"), 0x1C: ("select", "select_t"),
            0x3F: ("memory.size", "byte"), 0x40: ("memory.grow", "byte"), 0x41: ("i32.const", "i32"), 0x42: ("i64.const", "i64"),
            0x43: ("f32.const", "f32"), 0x44: ("f64.const", "f64"),
            0xD0: ("ref.null", "byte")}
    for i, n in enumerate(f"{_LOADS} {_STORES}".split()):
        out[0x28 + i] = (n, "memarg")
    numeric = [f"{t}.{o}" for t, ops in (("i32", _INT_TESTS), ("i64", _INT_TESTS), ("f32", _FLOAT_TESTS), ("f64", _FLOAT_TESTS),
        ("i32", _INT_OPS), ("i64", _INT_OPS),
                                         ("f32", _FLOAT_OPS), ("f64", _FLOAT_OPS)) for o in ops.split()] + _CONVERSIONS.split()
    return out | {0x45 + i: (n, "none") for i, n in enumerate(numeric)}


OPCODES = opcode_table()
#: Instructions of a module that are decoded, functions whose rows are stored, open frames that a branch can name.
MAX_INSTRUCTIONS, MAX_FUNCTIONS, MAX_OPEN = 2_000_000, 2_000, 256
CATEGORIES = ("control", "call", "variable", "memory", "integer", "bitwise", "float", "simd", "atomic", "reference", "other")
# Integer operations that count as bitwise, and what names of vectors begin with.
BITWISE = ("and", "or", "xor", "shl", "shr_s", "shr_u", "rotl", "rotr", "clz", "ctz", "popcnt")
VECTORS = ("v128.", "i8x16.", "i16x8.", "i32x4.", "i64x2.", "f32x4.", "f64x2.")


def category(name: str) -> str:
    """First match decides; constants, compares and conversions of integers are integer operations."""
    kind, _, op = name.partition(".")
    tests = (("simd", name.startswith(VECTORS)), ("atomic", "atomic" in name), ("reference", kind == "ref" and op),
        ("call", name in ("call", "call_indirect")),
             ("variable", kind in ("local", "global") and op),
             ("memory", kind in ("memory", "data", "table", "elem") and op or ".load" in name or ".store" in name),
             ("bitwise", kind in ("i32", "i64") and op.split(".")[0] in BITWISE), ("integer", kind in ("i32", "i64") and op),
             ("float", kind in ("f32", "f64")), ("other", not name))
    return next((c for c, holds in tests if holds), "control")


class Bad(Exception):
    pass


class Bytes:
    """Bounds-checked cursor."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Bad(f"needs {n} bytes at {self.at}, {len(self.data) - self.at} left")
        self.at += n
        return self.data[self.at - n:self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def _leb(self, most: int) -> tuple[int, int, int]:
        value = shift = 0
        for _ in range(most):
            b = self.byte()
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value, shift, b
        raise Bad(f"number longer than {most} bytes at {self.at}")

    def u32(self) -> int:
        return self._leb(5)[0] & 0xFFFFFFFF

    def signed(self, bits: int) -> int:
        value, shift, last = self._leb(5 if bits == 32 else 10)
        value -= (1 << shift) if last & 0x40 else 0
        value &= (1 << bits) - 1
        return value - (1 << bits) if value >> (bits - 1) else value

    def name(self) -> str:
        return self.take(self.u32()).decode("utf-8", "replace").removeprefix("\ufeff")

    def count(self) -> int:
        n = self.u32()
        if n > len(self.data) - self.at:
            raise Bad(f"vector of {n} in {len(self.data) - self.at} bytes")
        return n

    def vector(self, read) -> list:
        return [read() for _ in range(self.count())]

    def value_type(self) -> str:
        return VALUE_TYPES.get(self.byte(), "?")

    def limits(self) -> dict:
        flags = self.byte()
        return {"min": self.u32(), "max": self.u32() if flags & 1 else None, "shared": bool(flags & 2)}


def number(x: float) -> str:
    """The shortest text of a double that reads back the same, in the style of scripts: whole ones without a point, exponents
    from 1e21 and below 1e-6."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if not x:
        return "0"
    negative, figures, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, figures)).rstrip("0")
    point = len(figures) + exponent  # digits before the point
    if len(digits) <= point <= 21:
        out = digits.ljust(point, "0")
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{digits}"
    else:
        out = f"{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{point - 1:+d}"
    return "-" * negative + out


def instruction(r: Bytes) -> tuple[str, list[str]]:
    """Name and operands, as text."""
    code = r.byte()
    if code == 0xFC:
        sub = r.u32()
        if sub >= len(_BULK):
            raise Bad(f"unknown 0xfc sub-opcode {sub}")
        return _BULK[sub], [str(r.u32()) for _ in range(_BULK_OPERANDS.get(sub, 0))]
    if code == 0xFD:
        sub, args = r.u32(), []
        if sub <= 11 or 84 <= sub <= 93:
            args = _memarg(r)
        if sub in (12, 13):
            r.take(16)
        elif 21 <= sub <= 34 or 84 <= sub <= 91:
            args.append(str(r.byte()))
        return _SIMD.get(sub, f"v128.op_{sub}"), args
    if code == 0xFE:
        sub = r.u32()
        if sub == 3:
            r.byte()
            return _ATOMIC[sub], []
        return _ATOMIC.get(sub, f"atomic.op_{sub}"), _memarg(r)
    if code not in OPCODES:
        raise Bad(f"unknown opcode 0x{code:02x} at {r.at - 1}")
    name, kind = OPCODES[code]
    return name, [] if kind == "none" else _IMMEDIATES[kind](r)


def _memarg(r: Bytes) -> list[str]:
    align = r.u32()
    return [str(x) for x in (align, r.u32(), *([r.u32()] if align & 0x40 else []))]


def _block_type(r: Bytes) -> list[str]:
    if r.at >= len(r.data):
        raise Bad("the module ends in a block type")
    first = r.data[r.at]
    return [str(r.byte() if first == 0x40 or 0x6F <= first <= 0x7F else r.signed(32))]


_IMMEDIATES = {
    "u32": lambda r: [str(r.u32())], "u32u32": lambda r: [str(r.u32()), str(r.u32())], "block": _block_type,
    "byte": lambda r: [str(r.byte())], "memarg": _memarg,
    "br_table": lambda r: [str(r.u32()) for _ in range(r.count() + 1)], "select_t": lambda r: [str(b) for b in r.take(r.count())],
    "i32": lambda r: [str(r.signed(32))], "i64": lambda r: [str(r.signed(64))],
    "f32": lambda r: [number(struct.unpack("<f", r.take(4))[0])], "f64": lambda r: [number(struct.unpack("<d", r.take(8))[0])],
}


def listing(data: bytes, at: int, end: int, most: int) -> list[tuple[str, list[str]]]:
    """The instructions that `scan` counts, with their operands."""
    r, out, depth = Bytes(data, at), [], 0
    try:
        while r.at < end and len(out) < most:
            out.append(instruction(r))
            if out[-1][0] in ("block", "loop", "if"):
                depth += 1
            elif out[-1][0] == "end":
                if not depth:
                    break
                depth -= 1
    except Bad:
        pass
    return out


def indented(ops: list[tuple[str, list[str]]]) -> list[dict]:
    """Instructions with the depth at which each is written; what closes or parts a block stands where the block does."""
    out, depth = [], 0
    for name, operands in ops:
        depth -= name == "end"
        out.append({"name": name, "operands": " ".join(operands), "depth": max(depth - (name == "else"), 0)})
        depth += name in ("block", "loop", "if")
    return out


# What follows an opcode, as the loop of `scan` asks for it.
_NONE, _ONE, _TWO, _BYTE, _MEMARG, _TYPES, _LONG, _FOUR, _EIGHT, _BLOCK, _CONTROL, _BRANCH, _TABLE, _PREFIX, _UNKNOWN = range(15)
_SHAPES = {"none": _NONE, "u32": _ONE, "i32": _ONE, "u32u32": _TWO, "byte": _BYTE, "memarg": _MEMARG, "select_t": _TYPES, "i64": _LONG,
    "f32": _FOUR, "f64": _EIGHT, "block": _BLOCK, "br_table": _TABLE}
_SHAPE_OF = [_SHAPES[OPCODES[c][1]] if c in OPCODES else _UNKNOWN for c in range(256)]
for _c in (0x00, 0x05, 0x0B, 0x0F):
    _SHAPE_OF[_c] = _CONTROL
_SHAPE_OF[0x0C] = _SHAPE_OF[0x0D] = _BRANCH
_SHAPE_OF[0xFC] = _SHAPE_OF[0xFD] = _SHAPE_OF[0xFE] = _PREFIX
_IF, _LOOP, _ELSE, _END, _BR, _BR_IF, _BR_TABLE = 0x04, 0x03, 0x05, 0x0B, 0x0C, 0x0D, 0x0E
_NAME_OF = [OPCODES[c][0] if c in OPCODES else "" for c in range(256)]
_CATEGORY_OF = {n: CATEGORIES.index(category(n)) for n in {*_NAME_OF, *_BULK, *_SIMD.values(), *_ATOMIC.values()}}


def _over(data: bytes, at: int, most: int) -> int:
    """Where a number ends whose first byte, before `at`, said that it goes on."""
    for _ in range(most - 1):
        at += 1
        if data[at - 1] < 0x80:
            return at
    raise Bad(f"number longer than {most} bytes at {at}")


def _value(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    for _ in range(5):
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & 0xFFFFFFFF, at
        shift += 7
    raise Bad(f"number longer than 5 bytes at {at}")


def scan(data: bytes, at: int, end: int, most: int) -> tuple[int, dict[str, int], list[tuple], str | None]:
    """(instructions, count of each name, control instructions as (place, opcode, labels), why decoding stopped early) of a body.

    It ends at the `end` that closes it, where its bytes end, at the first thing that can't be read, or after `most`. An
    operand may reach past the body's end, not past the module's.
    """
    counts, more, control = [0] * 256, {}, []
    n = depth = 0
    shapes, size, why = _SHAPE_OF, len(data), None
    try:
        while at < end:
            if n >= most:
                why = f"exceeded {most} instructions in a single function"
                break
            code = data[at]
            at += 1
            shape = shapes[code]
            if shape == _NONE:
                pass
            elif shape == _ONE:
                at += 1
                if data[at - 1] > 0x7F:
                    at = _over(data, at, 5)
            elif shape == _MEMARG:
                align, at = _value(data, at)
                at = _value(data, at)[1]
                if align & 0x40:
                    at = _value(data, at)[1]
            elif shape == _BLOCK:
                at += 1
                if data[at - 1] > 0x7F:
                    at = _over(data, at, 5)
                depth += 1
                control.append((n, code, ()))
            elif shape == _CONTROL:
                control.append((n, code, ()))
                if code == _END:
                    if not depth:
                        counts[code] += 1
                        n += 1
                        break
                    depth -= 1
            elif shape == _BRANCH:
                label, at = _value(data, at)
                control.append((n, code, (label,)))
            elif shape == _LONG:
                at += 1
                if data[at - 1] > 0x7F:
                    at = _over(data, at, 10)
            elif shape == _BYTE:
                data[at]
                at += 1
            elif shape == _TWO:
                at = _value(data, _value(data, at)[1])[1]
            elif shape in (_FOUR, _EIGHT):
                at += 4 if shape == _FOUR else 8
                if at > size:
                    raise IndexError
            elif shape == _PREFIX:
                name, at = _prefixed(data, code, at)
                more[name] = more.get(name, 0) + 1
                n += 1
                continue
            elif shape == _UNKNOWN:
                raise Bad(f"unknown opcode 0x{code:02x} at {at - 1}")
            else:
                items, at = _value(data, at)
                if items > size - at:
                    raise Bad(f"vector of {items} in {size - at} bytes")
                if shape == _TYPES:
                    at += items
                else:
                    labels = []
                    for _ in range(items + 1):
                        label, at = _value(data, at)
                        labels.append(label)
                    control.append((n, code, labels))
            counts[code] += 1
            n += 1
    except IndexError:
        why = "the module ends in an instruction"
    except Bad as e:
        why = str(e)
    for code, k in enumerate(counts):
        if k:
            more[_NAME_OF[code]] = more.get(_NAME_OF[code], 0) + k
    return n, more, control, why


def _prefixed(data: bytes, code: int, at: int) -> tuple[str, int]:
    r = Bytes(data, at - 1)
    name, _ = instruction(r)
    return name, r.at


def control_flow(n: int, control: list[tuple]) -> dict:
    """Loops (header, end, depth, size), number of basic blocks, edges and back edges, nesting, and whether a branch could not
    be resolved, of a body of n instructions."""
    if not n:
        return {"loops": [], "blocks": 0, "edges": 0, "back_edges": 0, "max_nesting": 0, "approximate": False}
    # frames: opcode, start, end, depth, place of its else; the first is the function
    frames, stack, nesting, approximate = [[0, -1, n - 1, 0, -1]], [0], 0, False
    leaders, branches = {0}, []
    for i, code, labels in control:
        if code in (_BR, _BR_IF, _BR_TABLE):
            open_ = min(len(stack), MAX_OPEN)
            to = [stack[-1 - label] if label < open_ else None for label in labels]
            approximate |= None in to
            branches.append((i, code, to))
        elif code == _ELSE:
            if stack and frames[stack[-1]][0] == _IF and frames[stack[-1]][4] < 0:
                frames[stack[-1]][4] = i
        elif code == _END:
            if stack:
                frames[stack.pop()][2] = i
        elif code in (0x02, _LOOP, _IF):
            frames.append([code, i, n - 1, len(stack) - 1, -1])
            stack.append(len(frames) - 1)
            nesting = max(nesting, len(stack) - 1)
            if code == _IF:
                branches.append((i, code, [len(frames) - 1]))
        else:
            branches.append((i, code, []))
        if code not in (_BR, _BR_IF, _BR_TABLE, 0x00, 0x0F):
            leaders.add(i)
        if i + 1 < n:
            leaders.add(i + 1)

    def target(f: int | None) -> int:
        """Where a branch to a frame goes on; -1: out of the function."""
        if not f:
            return -1
        kind, start, end, _, _ = frames[f]
        return start if kind == _LOOP else end + 1 if end + 1 < n else -1
    for _, code, to in branches:
        if code in (_BR, _BR_IF, _BR_TABLE):
            leaders.update(t for t in map(target, to) if t >= 0)
    starts = sorted(leaders)
    # all blocks but those that a terminator closes go on with the next one
    edges, back = len(starts) - 1, 0
    for i, code, to in branches:
        begin = starts[bisect.bisect_right(starts, i) - 1]
        goes_on = i + 1 < n
        if code == _IF:
            if not goes_on:
                continue
            _, _, end, _, other = frames[to[0]]
            aims = [other + 1 if other >= 0 else end + 1]
        else:
            aims = [t for t in map(target, to) if t >= 0]
            if code != _BR_IF:
                edges -= goes_on
        known = {t for t in aims if t < n}
        approximate |= len(known) < len(set(aims))
        if code in (_BR_IF, _IF):
            known.discard(i + 1)
        edges += len(known)
        back += sum(t <= begin for t in aims)
    loops = [{"header": s, "end": e, "depth": d, "size": e - s} for k, s, e, d, _ in frames if k == _LOOP]
    return {"loops": loops, "blocks": len(starts), "edges": edges, "back_edges": back, "max_nesting": nesting, "approximate": approximate}


def parse(data: bytes | None, budget: int = MAX_INSTRUCTIONS, listings: bool = False) -> dict:
    """Total: a bad input is a row with ok = false, a bad section a warning and nothing of it, a bad body a truncated function."""
    row = {"ok": False, "reason": None, "byte_length": len(data or b""), "version": None, "types": [], "imports": [], "exports": [],
        "tables": [], "memories": [], "globals": [], "customs": [],
           "data_segments": 0, "data_bytes": 0, "elements": 0, "start": None, "declared": [], "function_count": 0, "skipped": 0, "ops": {},
           "warnings": [], "functions": []}
    if data is None or data[:4] != MAGIC:
        return row | {"reason": "not a WebAssembly module"}
    if len(data) < 8:
        return row | {"reason": "the header ends early"}
    row["ok"], row["version"] = True, int.from_bytes(data[4:8], "little")
    r, bodies = Bytes(data, 8), []
    while r.at < len(data):
        try:
            kind, size = r.byte(), r.u32()
        except Bad as e:
            row["warnings"].append(f"malformed section header: {e}")
            break
        end = r.at + size
        if end > len(data):
            row["warnings"].append(f"section {kind} claims {size} bytes past end of module")
            break
        try:
            _section(kind, r, end, row, bodies)
        except Bad as e:
            row["warnings"].append(f"section {kind}: {e}")
        r.at = end
    left, totals = budget, row["ops"]
    row["function_count"] = len(bodies)
    for k, (start, stop, n_locals) in enumerate(bodies):
        if left <= 0:
            row["skipped"] += 1
            continue
        n, ops, control, why = scan(data, start, stop, left)
        cats = [0] * len(CATEGORIES)
        for name, c in ops.items():
            totals[name] = totals.get(name, 0) + c
            cats[_CATEGORY_OF[name] if name in _CATEGORY_OF else CATEGORIES.index(category(name))] += c
        row["functions"].append({
            "func_idx": k, "type_idx": row["declared"][k] if k < len(row["declared"]) else -1, "locals": n_locals, "n": n, "cats": cats,
            "indirect": ops.get("call_indirect", 0), "truncated": why,
            **control_flow(n, control), "listing": indented(listing(data, start, stop, left)) if listings else None})
        left -= n
    return row


def _section(kind: int, r: Bytes, end: int, row: dict, bodies: list) -> None:
    """Reads what the section declares; nothing of it counts unless all of it can be read."""
    def func_type() -> dict:
        if (form := r.byte()) != 0x60:
            raise Bad(f"function type 0x{form:x}")
        return {"params": r.vector(r.value_type), "results": r.vector(r.value_type)}

    def entry() -> dict:
        out = {"module": r.name(), "name": r.name(), "kind": _extern(r, "import"), "type_idx": None, "limits": None, "val_type": None,
            "mutable": None}
        if out["kind"] == "func":
            out["type_idx"] = r.u32()
        elif out["kind"] == "global":
            out["val_type"], out["mutable"] = r.value_type(), r.byte() == 1
        else:
            out["val_type"] = r.value_type() if out["kind"] == "table" else None
            out["limits"] = r.limits()
        return out

    def global_() -> dict:
        out = {"val_type": r.value_type(), "mutable": r.byte() == 1}
        depth = 0
        while r.at < end:
            name = instruction(r)[0]
            if name == "end" and not depth:
                return out
            depth += (name in ("block", "loop", "if")) - (name == "end")
        raise Bad("constant expression is not terminated")

    if kind == 0:
        row["customs"].append(r.name())
    elif kind == 1:
        row["types"] = r.vector(func_type)
    elif kind == 2:
        row["imports"] = r.vector(entry)
    elif kind == 3:
        row["declared"] = r.vector(r.u32)
    elif kind == 4:
        row["tables"] = r.vector(lambda: {"ref_type": r.value_type(), "limits": r.limits()})
    elif kind == 5:
        row["memories"] = r.vector(r.limits)
    elif kind == 6:
        row["globals"] = r.vector(global_)
    elif kind == 7:
        row["exports"] = r.vector(lambda: {"name": r.name(), "kind": _extern(r, "export"), "index": r.u32()})
    elif kind == 8:
        row["start"] = r.u32()
    elif kind == 9:
        row["elements"] = r.u32()
    elif kind == 10:
        for k in range(r.count()):
            size = r.u32()
            stop = r.at + size
            if stop > len(r.data):
                row["warnings"].append(f"function body {k} runs past end of module")
                return
            n = sum(r.vector(lambda: (r.u32(), r.byte())[0]))
            bodies.append((r.at, stop, n))
            r.at = stop
    elif kind == 11:
        row["data_segments"] = r.u32()
        row["data_bytes"] = end - r.at
    elif kind == 12:
        r.u32()
    else:
        row["warnings"].append(f"unknown section id {kind}")


def _extern(r: Bytes, what: str) -> str:
    kind = r.byte()
    if kind >= len(EXTERN_KINDS):
        raise Bad(f"unknown {what} kind 0x{kind:x}")
    return EXTERN_KINDS[kind]


def uleb(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | 0x80 * (n > 0))
        if not n:
            return bytes(out)


def sleb(n: int) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        done = n == -(low >> 6)
        out.append(low | 0x80 * (not done))
        if done:
            return bytes(out)


def section(kind: int, *items: bytes, counted: bool = True) -> bytes:
    payload = (uleb(len(items)) if counted else b"") + b"".join(items)
    return bytes([kind]) + uleb(len(payload)) + payload


def text(value: str) -> bytes:
    data = value.encode()
    return uleb(len(data)) + data


def assemble(*sections: bytes) -> bytes:
    return MAGIC + VERSION + b"".join(sections)


@lru_cache(1_024)
def parametric_module(rounds: int, shared: bool) -> bytes:
    """One import, one export, one loop of `rounds` rotate-and-xor rounds after an atomic load."""
    ops = b"\x41\x00\xfe\x10\x02\x00\x1a\x03\x40" + b"".join(b"\x20\x00\x41" + sleb(i * 7 % 31) + b"\x77\x20\x00\x73\x21\x00" for i in range(rounds)) + b"\x20\x00\x41\x00\x4a\x0d\x00\x0b\x20\x00\x0b"
    code = uleb(1) + uleb(1) + b"\x7f" + ops
    return assemble(section(1, b"\x60\x00\x00", b"\x60\x00\x01\x7f"), section(2, text("pool") + text("websocket_send") + b"\x00\x00"),
        section(3, uleb(1)),
                    section(5, bytes([3 if shared else 1]) + uleb(16) + uleb(32)), section(7, text("run") + b"\x00\x01"),
                    section(10, uleb(len(code)) + code))


def function_body(ops: bytes, locals_: bytes = b"\x00") -> bytes:
    code = locals_ + ops
    return uleb(len(code)) + code


#: What `shaped_module` makes, in order.
SHAPES = ("nested", "table", "many", "broken", "overlong", "foreign", "declared", "kernels")


@lru_cache(1_024)
def shaped_module(shape: int, size: int) -> bytes:
    """Modules of other shapes than one loop. size: how often the part that gives a shape its name is repeated."""
    name = SHAPES[shape]
    get, end = b"\x20\x00", b"\x0b"
    plain = section(1, b"\x60\x00\x00")
    code = lambda *bodies: section(10, *bodies)
    declared = lambda n: section(3, *[uleb(0)] * n)
    if name == "nested":  # block, loop, if with else, branches to each; then an if without else
        one = b"\x02\x40\x03\x40" + get * size + b"\x04\x40\x0c\x01\x05\x0d\x02\x0b\x0b\x0b" + get + b"\x04\x40\x01" + end + end
        return assemble(plain, declared(2), code(function_body(one, b"\x01\x01\x7f"), function_body(end)))
    if name == "table":  # a loop that only the 301st label of a table names
        one = b"\x03\x40\x02\x40" + get + b"\x0e" + uleb(300) + b"\x00" * 300 + b"\x01" + end + end + b"\x01" * size + end
        return assemble(plain, declared(1), code(function_body(one, b"\x01\x01\x7f")))
    if name == "many":  # more functions than rows are stored of
        return assemble(plain, declared(2_500), code(*[function_body(b"\x41\x00\x1a" + end)] * 2_499,
            function_body(b"\x03\x40" + (get + b"\x45\x1a" + get + get + b"\x73\x1a") * size + end + end, b"\x01\x01\x7f")))
    if name == "broken":  # an unknown opcode, then a sound function; an export of an unknown kind takes its section along
        bad = section(7, text("f") + b"\x00\x00", text("g") + b"\x09\x00")
        return assemble(plain, declared(2), bad, code(function_body(b"\x01" * size + b"\xf1" + end), function_body(b"\x01" + end)))
    if name == "overlong":  # a section longer than the module
        return assemble(plain, declared(1), code(function_body(end)), b"\x0b" + uleb(1_000) + b"\x00" * size)
    if name == "foreign":
        return b"<html>" + b" " * size
    if name == "declared":  # every kind of section
        parts = [section(1, b"\x60\x02\x7f\x7e\x01\x7d", b"\x60\x00\x00"),
            section(2, text("env") + text("f") + b"\x00\x01", text("env") + text("t") + b"\x01\x70\x00\x05",
                text("env") + text("g") + b"\x03\x7c\x01"),
                 section(3, uleb(1)), section(4, b"\x70\x01\x01\x02"), section(5, b"\x00" + uleb(size)),
                 section(6, b"\x7f\x01\x41\x05\x0b", b"\x7b\x00\xfd\x0c" + b"\x00" * 16 + b"\x0b"),
                 section(7, text("m") + b"\x02\x00", text("f") + b"\x00\x01"), section(8, uleb(1), counted=False),
                 section(9, b"\x00\x41\x00\x0b\x01\x00"), section(12, uleb(1), counted=False),
                 code(function_body(b"\x44" + struct.pack("<d", 0.5) + b"\x1a\x42\x7f\x1a\xfe\x03\x00\x40\x00\x1a" + end)),
                 section(11, b"\x00\x41\x00\x0b" + text("x" * size)), section(0, text("name"), b"\x00", counted=False), section(30, b"")]
        return assemble(*parts)
    # two kernels alike, of which the first counts; a third has a larger loop but calls too often
    turn = lambda n, more=b"": b"\x03\x40" + (get + get + b"\x73\x1a") * n + more + end + end
    local = b"\x01\x01\x7f"
    return assemble(plain, declared(3), code(function_body(turn(10 + size), local), function_body(turn(10 + size), local),
        function_body(turn(20 + size, b"\x10\x00" * (2 + size)), local)))
