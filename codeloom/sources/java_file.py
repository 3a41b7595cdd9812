"""One Java source at a time: its headers, calls and brackets in order, and what these declare and call.

Patterns take words, spaces and ends of lines as java.util.regex does: words and spaces are
ASCII, a boundary of a word is not, and a line may end in other characters than a line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

#: Fixed values of the language: modifiers, and words before a parenthesis or a name that declare nothing.
MODIFIERS = "public protected private static final abstract default synchronized native strictfp sealed transient volatile".split()
CONTROL = frozenset("if for while switch catch synchronized try super this return assert".split())
NO_TYPES = "return new throw else case assert yield instanceof do if for while switch catch try synchronized import package extends implements".split()
_ENDS = r"\n\r\u0085\u2028\u2029"
_EDGE = r"(?u:\b)"
_LAST = rf"(?=(?:\r\n|[{_ENDS}])?\Z)"
_LITERAL = rf'"""(?s:.*?)"""|"(?:[^"\\\n]++|\\[^{_ENDS}])*+"|\'(?:[^\'\\\n]++|\\[^{_ENDS}])*+\'|/\*(?s:.*?)\*/|//[^\n]*+'
_MODS = rf"((?:(?:{'|'.join(MODIFIERS)}|non-sealed)\s+)*+)"
# Type arguments, three deep.
_ARGUMENTS = reduce(lambda inside, _: rf"<(?:[^<>(){{}};=]++|{inside})*+>", range(2), r"<[^<>(){};=]*+>")
_GENERIC = rf"(?:{_ARGUMENTS})?"
_PARAMS = r"((?:[^(){};]|\([^(){};]*\))*)"
_TYPE = rf"(?<![\w.]){_MODS}(@interface|interface|class|enum|record)\s+(\w+)\s*{_GENERIC}\s*(?:\([^){{}};]*\)\s*)?([^{{}};()]*)\{{"
_METHOD = rf"(?<![\w.]){_MODS}(?:{_ARGUMENTS}\s*)?(?!(?:{'|'.join(NO_TYPES)}){_EDGE})([\w.]+{_GENERIC}(?:\s*\[\])*)\s+(\w+)\s*\({_PARAMS}\)\s*(?:throws\s+[\w.,\s]+?|default\s[^;{{}}]*)?\s*([{{;])"
_CONSTRUCTOR = rf"(?<![\w.])(?<!new\s){_MODS}(?!(?:{'|'.join(NO_TYPES)}|super|this){_EDGE})(\w+)\s*\({_PARAMS}\)\s*(?:throws\s+[\w.,\s]+?)?\s*\{{"
_CALL = rf"(?<!\w)(?:new\s+)?(?:[\w.]+\.)?(\w+)\s*{_GENERIC}\s*\("
LITERAL, METHOD = (re.compile(p, re.ASCII) for p in (_LITERAL, _METHOD))
# No header or call starts inside a word or with another character: that is looked at first.
TOKEN = re.compile(rf"(?<!\w)(?=[\w@<.])(?:{_TYPE}|{_METHOD}|{_CONSTRUCTOR}|{_CALL})|[(){{}}\[\],]", re.ASCII)
#: Last groups of a match, by what it is, and the groups of a method's and a constructor's parts.
TYPE_AT, METHOD_AT, CONSTRUCTOR_AT, CALL_AT = 4, 9, 12, 13
PACKAGE, IMPORT = (re.compile(rf"(?:\A|(?<=[{_ENDS}]))\s*{word}\s+([\w.]+)\s*;", re.ASCII) for word in ("package", "import"))
_BASES = {word: re.compile(rf"{_EDGE}{word}\s+((?:(?!{_EDGE}(?:extends|implements|permits){_EDGE})[\s\S])*)", re.ASCII) for word in ("extends", "implements")}
_INNERMOST = re.compile(r"<[^<>]*>")
_BEFORE_TYPE = re.compile(r"\A(?:final\s+|@[\w.]+(?:\([^)]*\))?\s+)+", re.ASCII)
_PARAMETER = re.compile(rf"\s+(\w+)((?:\[\])*){_LAST}", re.ASCII)
_LAST_PARAMETER = re.compile(rf"(\w+)\s*{_LAST}", re.ASCII)
_SPACES = re.compile(r"\s", re.ASCII)
_SPACE = " \t\n\r\f\v"
#: Characters of sources whose rows are held at once.
HELD_CHARACTERS = 2**22

#: Columns of a file, and of what it holds: a name and a type of Spark for each.
FIELDS = {
    "types": "i int, close int, name string, qualified string, unitType string, modifiers array<string>, extends array<string>, implements array<string>, startLine int, endLine int",
    "methods": "i int, close int, qualified string, unitType string, isConstructor boolean, name string, returnType string, modifiers array<string>, args array<string>, last_parameter string, startLine int, endLine int, body string, signature string, full string, n_args int",
    # The first call of each method by name, arguments and `new`; near: a type around it that the file declares has such a method, callee: the one that it has.
    "calls": "full string, qualified string, line int, name string, creates boolean, n_args int, near boolean, callee string",
    # Named supertypes; target: the type of this file that x means, imports: those that end in x.
    "bases": "qualified string, up boolean, x string, target string, imports array<string>",
}
SCHEMA = "projectName string, file string, package string, imports array<string>, owners array<string>, outside array<string>, " + ", ".join(f"{k} array<struct<{', '.join(': '.join(f.rsplit(' ', 1)) for f in v.split(', '))}>>" for k, v in FIELDS.items())


def blanked(source: str) -> str:
    """The source with comments as a space and literals as two quotes; line ends stay."""
    return LITERAL.sub(lambda m: (" " if m[0][0] == "/" else '""') + "\n" * m[0].count("\n"), source)


def tokens(text: str) -> list[list]:
    """[token, line, owner, close, end_line, gap, match] of each header, call, bracket and comma of a blanked source.

    owner: number of the bracket it lies in; close and end_line: where the bracket that it
    opens closes; gap: what stands between it and the token before.
    """
    out: list[list] = []
    level, line, end, owner, waiting = 0, 1, 0, {}, {}
    for i, m in enumerate(TOKEN.finditer(text)):
        token, gap = m[0], text[end : m.start()]
        end = m.end()
        line += gap.count("\n")
        out.append([token, line, owner.get(level), None, None, gap, m])
        last = token[-1]
        if last in "({[":
            line += token.count("\n")
            level += 1
            owner[level] = waiting[level] = i
        elif last in ")}]":
            if (opened := waiting.pop(level, None)) is not None:
                out[opened][3:5] = i, line
            level -= 1
        else:
            line += token.count("\n")
    return out


@lru_cache(2**12)
def _words(text: str) -> list[str]:
    return text.split()


def _flat(text: str) -> str:
    for _ in range(4 if "<" in text else 0):
        text = _INNERMOST.sub("", text)
    return text


def _listed(bases: str, word: str) -> list[str]:
    """The simple names of the types after a word, without type arguments."""
    m = _BASES[word].search(bases)
    return [x for x in (x.strip(" ").split(".")[-1] for x in _flat(m[1]).split(",")) if x] if m else []


@lru_cache(2**12)
def _arguments(parameters: str) -> list[str]:
    """Parameter types, without annotations, modifiers, names and type arguments."""
    each = (p.strip(" ") for p in _flat(parameters).split(","))
    return [_SPACES.sub("", _PARAMETER.sub(r"\2", _BEFORE_TYPE.sub("", p))) for p in each if p]


def _around(qualified: str) -> Iterator[str]:
    """A type's qualified name and what is around it, innermost first."""
    while qualified:
        yield qualified
        qualified = qualified.rpartition(".")[0]


def scan(source: str) -> dict:
    """package, imports, types, methods, calls and supertypes of a source, rows as tuples in the order of FIELDS."""
    text = blanked(source)
    m = PACKAGE.search(text)
    package, imports = m[1] if m else "", IMPORT.findall(text)
    every = tokens(text)
    commas, content = {}, set()
    for token, _, owner, _, _, gap, _ in every:
        if owner is not None:
            if token == ",":
                commas[owner] = commas.get(owner, 0) + 1
            if token not in ")]}" or gap.strip(_SPACE):
                content.add(owner)
    types, methods, found = {}, [], {}
    own: dict = {}
    current = None
    for i, (token, line, owner, close, end_line, _, m) in enumerate(every):
        kind = m.lastindex
        if kind is None:
            continue
        if kind == CALL_AT:
            if current is not None and current[0] > i and (name := m[CALL_AT]) not in CONTROL:
                n_args = commas.get(i, 0) + 1 if i in content else 0
                found.setdefault((current[1], current[2], name, token.startswith("new") and token[3:4] in _SPACE, n_args), line)
            continue
        outer = types.get(owner) if owner is not None else None
        if kind == TYPE_AT:
            if owner is None or outer:
                unit = {"enum": "enum", "@interface": "annotation", "interface": "interface"}.get(m[2], "class")
                qualified = f"{outer[3]}.{m[3]}" if outer else f"{package}.{m[3]}" if package else m[3]
                types[i] = (i, close, m[3], qualified, unit, _words(m[1]), _listed(m[4], "extends"), _listed(m[4], "implements"), line, end_line)
            parts = METHOD.fullmatch(token) if outer else None  # a record's header
            parts = parts and parts.groups()
        else:
            parts = m.groups()[TYPE_AT:METHOD_AT] if kind == METHOD_AT else None
        if not outer:
            continue
        if parts:
            words, returns, name, parameters, _ = parts
            returns, made = _SPACES.sub("", returns), False
        elif kind == CONSTRUCTOR_AT and m[11] == outer[2]:
            words, name, parameters = m.groups()[METHOD_AT:CONSTRUCTOR_AT]
            returns, made = None, True
        else:
            continue
        args = _arguments(parameters)
        signature = f"{name}({','.join(args)})"
        full = f"{outer[3]}.{signature}"
        p = _LAST_PARAMETER.search(parameters)
        body = every[close][5].strip(" ") if close == i + 1 else None
        methods.append((i, close, outer[3], outer[4], made, name, returns, _words(words), args, p[1] if p else "", line, line if token[-1] == ";" else end_line, body, signature, full, len(args)))
        if not made:
            held = own.setdefault((outer[3], name, len(args)), [full, 0])
            held[0], held[1] = min(held[0], full), held[1] + 1
        if close is not None:
            current = (close, full, outer[3])
    owners = {of for of, _, _ in own}
    calls, asked = [], {}
    around = {of: tuple(_around(of)) for of in {qualified for _, qualified, _, creates, _ in found if not creates}}
    outside = set().union(*around.values()) - owners
    for (full, qualified, name, creates, n_args), line in found.items():
        best = None
        if not creates:
            ask = (qualified, name, n_args)
            if ask not in asked:
                asked[ask] = next((b for of in around[qualified] if (b := own.get((of, name, n_args)))), None)
            best = asked[ask]
        calls.append((full, qualified, line, name, creates, n_args, best is not None, best[0] if best and best[1] == 1 else None))
    simple: dict = {}
    for t in types.values():
        simple[t[2]] = min(simple.get(t[2], t[3]), t[3])
    bases = [(t[3], up, x, simple.get(x), sorted({y for y in imports if y.rpartition(".")[2] == x})) for t in types.values() for up, names in ((True, t[6]), (False, t[7])) for x in names]
    return {"package": package, "imports": imports, "owners": sorted(owners), "outside": sorted(outside), "types": list(types.values()), "methods": methods, "calls": calls, "bases": bases}


def scanned(batches: Iterator) -> Iterator:
    """Arrow batches of (projectName, file, source) as SCHEMA."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = {k: [tuple(f.rsplit(" ", 1)) for f in v.split(", ")] for k, v in FIELDS.items()}

    def nested(rows: list[list[tuple]], of: list[tuple]):
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(of)
        values = pa.StructArray.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, of, strict=True)], names=[n for n, _ in of])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    for batch in batches:
        begin, held, rows = 0, 0, []
        for i, source in enumerate(batch.column(2)):
            text = source.as_py() or ""
            rows.append(scan(text))
            held += len(text)
            if held >= HELD_CHARACTERS or i + 1 == batch.num_rows:
                part = batch.slice(begin, len(rows))
                flat = [pa.array([r[k] for r in rows], kinds[kind]) for k, kind in (("package", "string"), *((k, "array<string>") for k in ("imports", "owners", "outside")))]
                lists = [nested([r[k] for r in rows], of) for k, of in fields.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *flat, *lists], names=["projectName", "file", "package", "imports", "owners", "outside", *fields])
                begin, held, rows = i + 1, 0, []
