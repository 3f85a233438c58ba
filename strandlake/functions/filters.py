"""A filter language for records, compiled to Spark columns.

Grammar, loosest first: && and || (equal, left to right); == != =~ !~ (to the right); >= > <= < (to
the right); | ; ^ ; & ; + - ; * / % ; unary + - ! ~ ; brackets, numbers, "strings", symbols and functions.

A value is a number or a string, and may be undefined, which isn't SQL's NULL: a comparison with an
undefined value is undefined, ``a && b`` with an undefined side is false, ``!undefined`` is true, and any
defined string is true, the empty one included. So each node is compiled to a number column, a string
column, whether it is a string, and its truth; NULL in the first two stands for undefined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A malformed filter; ``at`` is the place in its text."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


@dataclass(frozen=True)
class Node:
    kind: str  # number string symbol tag call unary binary
    value: object
    inner: tuple[Node, ...] = ()
    at: int = 0


#: Binary operators by level, loosest first; whether the level chains to the right. Fixed values.
LEVELS = [(("&&", "||"), False), (("==", "!=", "=~", "!~"), True), ((">=", ">", "<=", "<"), True), (("|",), False), (("^",), False), (("&",), False), (("+", "-"), False), (("*", "/", "%"), False)]
FUNCTIONS = {"avg": 1, "default": 2, "exists": 1, "exp": 1, "length": 1, "log": 1, "max": 1, "min": 1, "pow": 2, "sqrt": 1}

_TOKEN = re.compile(
    r"""[ \t]*(?:(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>"(?:\\.|[^"\\])*")|\[(?P<tag>[^\]]{2})\]|(?P<name>[A-Za-z_][A-Za-z0-9_.*-]*)
    |(?P<op>&&|\|\||==|!=|=~|!~|>=|<=|[><|^&+*/%!~()\-,]))""",
    re.X,
)


class Parser:
    """``names``: the symbols there are; the longest one that a name starts with is meant."""

    def __init__(self, text: str, names: set[str]):
        self.tokens, at = [], 0
        while text[at:].strip(" \t"):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterError("unknown text", at)
            kind, value, end = m.lastgroup, m[m.lastgroup], m.end()
            if kind == "name":
                known = [n for n in (*names, *FUNCTIONS) if value.startswith(n)]
                if not known:
                    raise FilterError(f"unknown symbol {value}", m.start(kind))
                longest = max(known, key=len)
                end -= len(value) - len(longest)
                value = longest
            self.tokens.append((kind, value, m.start(kind)))
            at = end
        self.i = 0

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "", -1)

    def take(self, *ops: str) -> str | None:
        kind, value, _ = self.peek()
        if kind == "op" and value in ops:
            self.i += 1
            return value
        return None

    def parse(self) -> Node:
        node = self.level(0)
        if self.peek()[0] != "end":
            raise FilterError("unexpected text", self.peek()[2])
        return node

    def level(self, n: int) -> Node:
        if n == len(LEVELS):
            return self.unary()
        ops, to_right = LEVELS[n]
        node = self.level(n + 1)
        at = self.peek()[2]
        while op := self.take(*ops):
            node = Node("binary", op, (node, self.level(n if to_right else n + 1)), at)
            if to_right:
                break
            at = self.peek()[2]
        return node

    def unary(self) -> Node:
        at = self.peek()[2]
        if op := self.take("+", "-", "!", "~"):
            return Node("unary", op, (self.unary(),), at)
        kind, value, at = self.peek()
        self.i += 1
        if kind == "number":
            return Node("number", float(int(value, 16)) if value[:2].lower() == "0x" else float(value), at=at)
        if kind == "string":
            # \" \\ \t \n \r are known; before anything else the backslash stays.
            known = {'"': '"', "\\": "\\", "t": "\t", "n": "\n", "r": "\r"}
            return Node("string", re.sub(r"\\(.)", lambda m: known.get(m[1], m[0]), value[1:-1], flags=re.S), at=at)
        if kind == "tag":
            return Node("tag", value, at=at)
        if kind == "name" and value in FUNCTIONS and self.take("("):
            inner = [self.level(0)]
            while self.take(","):
                inner.append(self.level(0))
            if not self.take(")") or len(inner) != FUNCTIONS[value]:
                raise FilterError(f"{value} takes {FUNCTIONS[value]} values", at)
            return Node("call", value, tuple(inner), at)
        if kind == "name":
            return Node("symbol", value, at=at)
        if kind == "op" and value == "(":
            node = self.level(0)
            if not self.take(")"):
                raise FilterError("missing )", at)
            return node
        raise FilterError("a value is missing", at)


@dataclass
class Value:
    """is_str: True or False where the type is known beforehand, else a column. forced: true even if undefined."""

    number: Column
    string: Column
    is_str: bool | Column = False
    forced: Column | None = None

    def _flag(self) -> Column:
        return F.lit(self.is_str) if isinstance(self.is_str, bool) else self.is_str

    @property
    def exists(self) -> Column:
        if self.is_str is True:
            return self.string.isNotNull()
        if self.is_str is False:
            return self.number.isNotNull()
        return F.when(self.is_str, self.string.isNotNull()).otherwise(self.number.isNotNull())

    @property
    def exists_true(self) -> Column:
        return self.exists if self.forced is None else self.forced | self.exists

    @property
    def truth(self) -> Column:
        number = F.coalesce(self.number != 0, F.lit(False))
        own = self.string.isNotNull() if self.is_str is True else number if self.is_str is False else F.when(self.is_str, self.string.isNotNull()).otherwise(number)
        return own if self.forced is None else self.forced | own



def number(c: Column) -> Value:
    """NaN is undefined. nanvl names the column once, so that nested sums don't double in size at each level."""
    return Value(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(None).cast("string"))


def string(c: Column) -> Value:
    return Value(F.lit(None).cast("double"), c.cast("string"), True)


def boolean(c: Column) -> Value:
    return Value(c.cast("double"), F.lit(None).cast("string"))


def dynamic(number_: Column, string_: Column, is_str: Column) -> Value:
    return Value(number_, string_, is_str)


def _integer(c: Column) -> Column:
    """Truncated and clamped to 64 bits."""
    return F.when(c >= 9223372036854775807.0, F.lit(2**63 - 1)).when(c <= -9223372036854775808.0, F.lit(-(2**63))).otherwise(F.when(F.abs(c) < 9.2e18, c).cast("long"))


def _numeric(v: Value, what: str, at: int) -> Column:
    if v.is_str is True:
        raise FilterError(f"{what} needs numbers", at)
    if v.is_str is False:
        return v.number
    return F.when(v.is_str, F.raise_error(F.lit(f"{what} needs numbers")).cast("double")).otherwise(v.number)


def _text(v: Value, what: str, at: int) -> Column:
    if v.is_str is False:
        raise FilterError(f"{what} needs strings", at)
    if v.is_str is True:
        return v.string
    return F.when(~v.is_str, F.raise_error(F.lit(f"{what} needs strings")).cast("string")).otherwise(v.string)


def _bytes(s: Column) -> Column:
    """The bytes of a string as an array of numbers: as Latin-1 each byte is a character."""
    characters = F.split(F.decode(s.cast("binary"), "ISO-8859-1"), "")
    return F.transform(F.filter(characters, lambda c: F.length(c) > 0), F.ascii)


class Compiler:
    """symbols: name -> Value (or a function that makes it); tags: what [XX] means."""

    def __init__(self, symbols: Mapping[str, Value | Callable[[], Value]], tags: Callable[[str], Value] | None = None):
        self.symbols, self.tags = symbols, tags

    def __call__(self, text: str) -> Value:
        return self.compile(Parser(text, set(self.symbols)).parse())

    def condition(self, text: str) -> Column:
        """The rows that pass."""
        return self(text).truth

    def compile(self, n: Node) -> Value:
        return getattr(self, f"_{n.kind}")(n)

    def _number(self, n: Node) -> Value:
        return number(F.lit(n.value))

    def _string(self, n: Node) -> Value:
        return string(F.lit(n.value))

    def _symbol(self, n: Node) -> Value:
        if n.value not in self.symbols:
            raise FilterError(f"unknown symbol {n.value}", n.at)
        v = self.symbols[n.value]
        return v() if callable(v) else v

    def _tag(self, n: Node) -> Value:
        if self.tags is None:
            raise FilterError("there are no tags here", n.at)
        return self.tags(n.value)

    def _unary(self, n: Node) -> Value:
        v = self.compile(n.inner[0])
        if n.value == "!":
            if v.is_str is True:
                return boolean(~v.exists_true if v.forced is None else F.lit(False))
            whole = F.when(v.number.isNull(), True).otherwise(_integer(v.number) == 0)
            own = whole if v.is_str is False else F.when(v.is_str, v.string.isNull()).otherwise(whole)
            return boolean(own if v.forced is None else ~v.forced & own)
        x = _numeric(v, n.value, n.at)
        return number(x if n.value == "+" else -x if n.value == "-" else F.bitwise_not(_integer(x)))

    def _binary(self, n: Node) -> Value:
        a, b = (self.compile(x) for x in n.inner)
        op = n.value
        if op == "&&":
            return boolean(a.exists_true & b.exists_true & a.truth & b.truth)
        if op == "||":
            # An undefined side counts as false, so the other side decides.
            return boolean(a.truth | b.truth)
        if op in ("==", "!=", ">=", ">", "<=", "<"):
            return self._compare(op, a, b)
        if op in ("=~", "!~"):
            x, p = _text(a, op, n.at), n.inner[1]
            if p.kind == "string":
                try:
                    re.compile(p.value)
                except re.error as e:
                    raise FilterError(f"not a regular expression: {e}", p.at) from e
                if re.search(r"\\\d|\(\?[=!<]", p.value):
                    raise FilterError("back references and look-around aren't known here", p.at)
            found = F.coalesce(F.regexp_like(x, _text(b, op, n.at)), F.lit(False))
            return boolean(found if op == "=~" else ~found)
        x, y = _numeric(a, op, n.at), _numeric(b, op, n.at)
        if op == "+":
            return number(x + y)
        if op == "-":
            return number(x - y)
        if op == "*":
            return number(x * y)
        if op == "/":
            by_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf"))
            return number(F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)))
        i, j = _integer(x), _integer(y)
        if op == "%":
            return number(F.when(j == 0, None).otherwise(F.try_mod(i, j)))
        return number({"|": i.bitwiseOR, "^": i.bitwiseXOR, "&": i.bitwiseAND}[op](j))

    @staticmethod
    def _compare(op: str, a: Value, b: Value) -> Value:
        test = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, ">=": lambda x, y: x >= y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, "<": lambda x, y: x < y}[op]
        mixed = F.lit(op == "!=")
        if isinstance(a.is_str, bool) and isinstance(b.is_str, bool):
            out = mixed if a.is_str != b.is_str else test(a.string, b.string) if a.is_str else test(a.number, b.number)
        else:
            x, y = a._flag(), b._flag()
            out = F.when(x != y, mixed).when(x, test(a.string, b.string)).otherwise(test(a.number, b.number))
        return boolean(F.when(a.exists & b.exists, out))

    def _call(self, n: Node) -> Value:
        name, v = n.value, [self.compile(x) for x in n.inner]
        a = v[0]
        if name == "exists":
            return boolean(a.exists_true)
        if name == "default":
            b = v[1]
            pick = lambda x, y: F.when(a.exists_true, x).otherwise(y)
            kind = a.is_str if isinstance(a.is_str, bool) and a.is_str == b.is_str and isinstance(b.is_str, bool) else pick(a._flag(), b._flag())
            return Value(pick(a.number, b.number), pick(a.string, b.string), kind)
        if name in ("length", "avg", "min", "max"):
            s = _text(a, name, n.at)
            if name == "length":
                return number(F.octet_length(s))
            if name == "avg":
                total = F.aggregate(_bytes(s), F.lit(0).cast("long"), lambda x, y: x + y)
                return number(F.when(F.octet_length(s) == 0, 0.0).otherwise(F.try_divide(total, F.octet_length(s))))
            return number((F.array_min if name == "min" else F.array_max)(_bytes(s)))
        x = _numeric(a, name, n.at)
        if name == "log":
            return number(F.when(x == 0, float("-inf")).otherwise(F.ln(x)))
        if name == "pow":
            return number(F.pow(x, _numeric(v[1], name, n.at)))
        return number((F.exp if name == "exp" else F.sqrt)(x))


#: Flag names and bits. Fixed values.
FLAGS = {"paired": 1, "proper_pair": 2, "unmap": 4, "munmap": 8, "reverse": 16, "mreverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qcfail": 512, "dup": 1024, "supplementary": 2048}
#: CIGAR operators that use the reference, and those that use the read. Fixed values.
ON_REFERENCE, ON_READ = "MDN=X", "MIS=X"


def cigar_parts(cigar: Column) -> Column:
    """'5S30M' -> [(len 5, op S), (len 30, op M)]; '*' and NULL -> []."""
    ops, lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    pairs = F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))
    return F.coalesce(pairs, F.array().cast("array<struct<len:int,op:string>>"))


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Total length of the given operators; 0 for '*' and NULL."""
    lens = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.coalesce(F.aggregate(lens, F.lit(0).cast("long"), lambda s, n: s + n.cast("long")), F.lit(0).cast("long"))


def soft_clip(cigar: Column) -> Column:
    """Terminal S, also just inside a terminal H, at both ends."""
    first = F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1)
    last = F.regexp_extract(cigar, r"(?:[MIDNHP=X]|^\d+H)(\d+)S(?:\d+H)?$", 1)
    one = lambda s: F.coalesce(F.try_to_number(F.nullif(s, F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))
    return one(first) + one(last)


def hard_clip(cigar: Column) -> Column:
    """Terminal H at both ends; a single H counts for both."""
    one = lambda s: F.coalesce(F.try_to_number(F.nullif(s, F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))
    return one(F.regexp_extract(cigar, r"^(\d+)H", 1)) + one(F.regexp_extract(cigar, r"(\d+)H$", 1))


def raw_qualities(qual: Column) -> Column:
    """Printed qualities as a string of the qualities themselves, one character each; empty where there are none."""
    # Quality 0 is printed as '!', which stands for quality 33 afterwards; translate() would drop U+0000.
    kept = F.replace(F.coalesce(qual, F.lit("")), F.lit("!"), F.lit("\ue000"))
    lower = F.translate(kept, "".join(map(chr, range(34, 127))), "".join(map(chr, range(1, 94))))
    return F.replace(lower, F.lit("\ue000"), F.lit("\0"))


#: Symbols that are worked out from a CIGAR.
OF_CIGAR = ("endpos", "qlen", "rlen", "ncigar", "sclen", "hclen")


def read_symbols() -> dict[str, Value | Callable[[], Value]]:
    """Symbols over the columns of an alignments table (see plans.views)."""
    c = F.col
    rlen = lambda: cigar_sum(c("cigar"), ON_REFERENCE)
    out: dict[str, Value | Callable[[], Value]] = {
        "qname": lambda: string(c("qname")), "rname": lambda: string(c("rname")), "cigar": lambda: string(c("cigar")), "seq": lambda: string(c("seq")),
        "rnext": lambda: string(F.coalesce(c("rnext"), F.lit("*"))), "mrname": lambda: string(F.coalesce(c("rnext"), F.lit("*"))),
        "library": lambda: string(F.coalesce(c("library"), F.lit(""))), "qual": lambda: string(raw_qualities(c("qual"))),
        "pos": lambda: number(c("pos")), "endpos": lambda: number(c("pos") + F.greatest(rlen() - 1, F.lit(0))),
        "pnext": lambda: number(F.coalesce(c("pnext"), F.lit(0))), "mpos": lambda: number(F.coalesce(c("pnext"), F.lit(0))),
        "flag": lambda: number(c("flag")), "mapq": lambda: number(c("mapq")), "tlen": lambda: number(c("tlen")),
        "refid": lambda: number(F.coalesce(c("ref_id"), F.lit(-1))), "mrefid": lambda: number(F.coalesce(c("next_ref_id"), F.lit(-1))),
        "qlen": lambda: number(F.when(F.length("seq") > 0, F.length("seq")).otherwise(cigar_sum(c("cigar"), ON_READ))),
        "rlen": lambda: number(rlen()), "ncigar": lambda: number(F.size(cigar_parts(c("cigar")))),
        "sclen": lambda: number(soft_clip(c("cigar"))), "hclen": lambda: number(hard_clip(c("cigar"))),
    }
    for name, bit in FLAGS.items():
        out[f"flag.{name}"] = lambda bit=bit: number(c("flag").bitwiseAND(bit))
    return out


def read_tags(tag: str) -> Value:
    """[XX]: a number for integer and float types, a string for A, Z and H, undefined for arrays and where it is missing."""
    return _tag_value(F.col("aux")[tag])


def _tag_value(v: Column) -> Value:
    is_number = F.coalesce(v["type"].isin("c", "C", "s", "S", "i", "I", "f"), F.lit(True))
    is_string = F.coalesce(v["type"].isin("A", "Z", "H"), F.lit(False))
    return dynamic(F.when(is_number, v["value"].try_cast("double")), F.when(is_string, v["value"]), is_string)


def read_filter(text: str) -> Column:
    """A filter over an alignments table as a condition. What a CIGAR must be taken apart for, and each tag, is looked up once a row, however often the filter names it."""
    symbols = read_symbols()
    used = [n for n in OF_CIGAR if re.search(rf"\b{n}\b", text)]
    tags = sorted(set(re.findall(r"\[([^\]]{2})\]", text)))
    if not used and not tags:
        return Compiler(symbols, read_tags).condition(text)
    once = F.array(F.struct(*[symbols[n]().number.alias(n) for n in used], *[F.col("aux")[t].alias(f"tag{i}") for i, t in enumerate(tags)]))
    return F.exists(once, lambda s: Compiler(symbols | {n: number(s[n]) for n in used}, lambda t: _tag_value(s[f"tag{tags.index(t)}"])).condition(text))


def flag_filter(flag: Column, require: int = 0, exclude_any: int = 0, exclude_all: int = 0) -> Column:
    """Flag masks; a mask of 0 doesn't count."""
    out = F.lit(True)
    if require:
        out = out & (flag.bitwiseAND(require) == require)
    if exclude_any:
        out = out & (flag.bitwiseAND(exclude_any) == 0)
    if exclude_all:
        out = out & (flag.bitwiseAND(exclude_all) != exclude_all)
    return out
