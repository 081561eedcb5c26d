"""Symbols, calls and imports of source files, as plain Python over one file at a time."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple


class Symbol(NamedTuple):
    name: str
    type: str
    line: int
    content: str
    calls: list[str]


# Built-ins that count as no call.
_PY_BUILTINS = frozenset("super isinstance type len range list dict set tuple str int float bool open vars dir hasattr getattr".split())
_PY_KEYWORDS = _PY_BUILTINS | frozenset("if elif else for while with return print def class and or not in is lambda except raise assert del yield await async from import pass break continue global nonlocal try finally".split())


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def python_symbols(source: str) -> list[Symbol]:
    """class, def and async def by line scan: decorators lead, the body follows by indentation."""
    lines, out, decorators = source.split("\n"), [], []
    for n, line in enumerate(lines):
        text = line.strip()
        if text.startswith("@"):
            decorators.append(text)
            continue
        m = re.match(r"(class|def|async\s+def)\s+([^\s(:]+)", text)
        if not m:
            if text:
                decorators = []
            continue
        depth, body = _indent(line), []
        for k in range(n + 1, len(lines)):
            if lines[k].strip() and _indent(lines[k]) <= depth:
                break
            body.append(lines[k])
        calls = [] if m[1] == "class" else python_calls("\n".join(body))
        out.append(Symbol(m[2], "class" if m[1] == "class" else "function", n + 1, "\n".join([*decorators, text]), calls))
        decorators = []
    return out


def python_calls(body: str) -> list[str]:
    """Names before an opening bracket, the last part of dotted ones; definitions and keywords are not calls."""
    found: dict[str, None] = {}
    for line in body.split("\n"):
        if re.match(r"\s*(async\s+def|def|class)\b", line) or line.strip().startswith("#"):
            continue
        for m in re.finditer(r"([A-Za-z_]\w*)[ \t]*\(", line):
            if m[1] not in _PY_KEYWORDS:
                found.setdefault(m[1])
    return list(found)


def python_precise(source: str) -> list[Symbol]:
    """The same from the syntax tree: top-level and class members, calls sorted and distinct; none if it fails to parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, out = source.split("\n"), []

    def visit(nodes) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                out.append(Symbol(node.name, "class", node.lineno, lines[node.lineno - 1].strip(), []))
                visit(node.body)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                names = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)}
                out.append(Symbol(node.name, "function", node.lineno, lines[node.lineno - 1].strip(), sorted(names)))

    visit(tree.body)
    return out


def python_imports(source: str) -> list[str]:
    out = []
    for line in source.split("\n"):
        text = line.strip()
        if m := re.match(r"from\s+(\S+)", text):
            out.append(m[1])
        elif text.startswith("import "):
            out += [p.strip() for p in text[7:].split(",") if p.strip()]
    return out


def blank_noise(source: str, quotes: str = "\"'`", line_mark: str = "//") -> str:
    """The source with comments and the insides of literals as spaces; lines and offsets stay."""
    out, i, n = [], 0, len(source)
    while i < n:
        c = source[i]
        if source.startswith("/*", i):
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append(re.sub(r"[^\n]", " ", source[i:end]))
            i = end
        elif source.startswith(line_mark, i):
            end = source.find("\n", i)
            end = n if end < 0 else end
            out.append(" " * (end - i))
            i = end
        elif c in quotes:
            j = i + 1
            while j < n and source[j] != c and (c == "`" or source[j] != "\n"):
                j += 2 if source[j] == "\\" and c != "`" else 1
            j = min(j, n)
            out.append(c + re.sub(r"[^\n]", " ", source[i + 1 : j]) + (c if j < n and source[j] == c else ""))
            i = j + (1 if j < n and source[j] == c else 0)
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _balanced(plain: str) -> bool:
    depth = 0
    for c in plain:
        depth += (c in "{([") - (c in "})]")
        if depth < 0:
            return False
    return depth == 0


def _block_end(plain: str, at: int) -> int:
    """Just behind the brace block that opens at or after `at`, or the end of the line without one."""
    line = plain.find("\n", at)
    line = len(plain) if line < 0 else line
    opened = plain.find("{", at, line)
    if opened < 0:
        return line
    depth = 0
    for i in range(opened, len(plain)):
        depth += (plain[i] == "{") - (plain[i] == "}")
        if not depth:
            return i + 1
    return len(plain)


def _statement_end(plain: str, at: int, end: int) -> int:
    """Where a statement that begins at `at` ends: at a semicolon, before a bracket that it did not open, or at `end`."""
    depth = 0
    for i in range(at, end):
        depth += (plain[i] in "({[") - (plain[i] in ")}]")
        if depth < 0 or not depth and plain[i] == ";":
            return i
    return end


def _lines_of(text: str) -> Callable[[int], int]:
    """Tells the line, from 1, of a place in the text."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(ends, at) + 1


_GO_WORDS = frozenset("func if for switch select go defer return range case interface struct map chan type var const".split())


def go_symbols(source: str) -> list[Symbol]:
    """func (methods by bare name), type and each var or const name, local ones too; none if brackets do not balance."""
    plain = blank_noise(source)
    if not re.search(r"^\s*package\s+\w+", plain, re.M) or not _balanced(plain):
        return []
    out, line_of = [], _lines_of(plain)
    for m in re.finditer(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", plain, re.M):
        end = _block_end(plain, m.end())
        brace = plain.find("{", m.end(), end)
        calls = go_calls(plain[brace:end]) if brace >= 0 else []
        out.append(Symbol(m[1], "function", line_of(m.start()), source[m.start() : end], calls))
    for m in re.finditer(r"(?:^|[{;])[ \t]*(type|var|const)\b[ \t]*(\(?)", plain, re.M):
        kind = "type" if m[1] == "type" else "variable"
        if m[2]:
            depth, end = 1, m.end()
            while end < len(plain) and depth:
                depth += (plain[end] in "({") - (plain[end] in ")}")
                end += 1
            inner, at, level = plain[m.end() : end - 1], m.end(), 0
            for text in inner.split("\n"):
                if not level and (x := re.match(r"\s*(\w+(?:\s*,\s*\w+)*)", text)):
                    out += [Symbol(name.strip(), kind, line_of(at), text.strip(), []) for name in x[1].split(",")]
                level += sum((c in "({[") - (c in ")}]") for c in text)
                at += len(text) + 1
        elif x := re.compile(r"(\w+(?:\s*,\s*\w+)*)").match(plain, m.end()):
            end = _statement_end(plain, m.end(), _block_end(plain, m.end()))
            out += [Symbol(name.strip(), kind, line_of(m.start(1)), source[m.start(1) : end].strip(), []) for name in x[1].split(",")]
    return sorted(out, key=lambda s: (s.line, s.name))


def go_calls(body: str) -> list[str]:
    """Distinct unqualified names called; x.F() is not one."""
    found: dict[str, None] = {}
    for m in re.finditer(r"(?<![\w.])([A-Za-z_]\w*)\(", body):
        if m[1] not in _GO_WORDS:
            found.setdefault(m[1])
    return list(found)


def go_imports(source: str) -> list[str]:
    found = []
    for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", source, re.M):
        found += re.findall(r"\"([^\"]+)\"", m[1]) if m[1] is not None else [m[2]]
    return found


_TS = [
    (re.compile(r"^(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), "function"),
    (re.compile(r"^(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), "class"),
    (re.compile(r"^interface\s+([A-Za-z_$][\w$]*)"), "interface"),
    (re.compile(r"^type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="), "type_alias"),
    (re.compile(r"^(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"), "function"),
]


def ts_symbols(source: str) -> list[Symbol]:
    out = []
    for n, line in enumerate(source.split("\n")):
        text = re.sub(r"^(?:(?:export|default|declare)\s+)*", "", line.strip())
        for pattern, kind in _TS:
            if m := pattern.match(text):
                out.append(Symbol(m[1], kind, n + 1, line.strip(), []))
                break
    return out


def ts_imports(source: str) -> list[str]:
    """Quoted specifiers of import, export, require and from lines, outside comments and template literals."""
    plain = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    plain = re.sub(r"(?<!:)//[^\n]*", "", plain)
    plain = re.sub(r"`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), plain, flags=re.S)
    found: dict[str, None] = {}
    for line in plain.split("\n"):
        if re.match(r"\s*(import|export)\b", line) or "require(" in line or re.search(r"\bfrom\s*[\"']", line):
            for m in re.finditer(r"(?:\bfrom\s*|\brequire\(\s*|\bimport\s*\(?\s*)([\"'])([^\"'\s]+)\1", line):
                found.setdefault(m[2])
    return list(found)


_RUST = [(re.compile(rf"^{head}\s+([A-Za-z_]\w*)"), kind) for head, kind in ((r"(?:const\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*(?:async\s+)?fn", "function"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"))]


def rust_symbols(source: str) -> list[Symbol]:
    out = []
    for n, line in enumerate(source.split("\n")):
        text = re.sub(r"^pub(?:\([^)]*\))?\s+", "", line.strip())
        found = next(((m[1], kind) for p, kind in _RUST if (m := p.match(text))), None)
        if found is None and (m := re.match(r"^impl\b(?:<[^>]*>)?\s+(.*?)\s*(?:\{|where\b|$)", text)):
            found = (m[1].strip(), "impl")
        if found and found[0]:
            out.append(Symbol(found[0], found[1], n + 1, line.strip(), []))
    return out


def go_outline(source: str, most: int = 60) -> str:
    """Package, imports, signatures and declarations; the first lines where the file does not parse."""
    plain = blank_noise(source)
    lines = source.split("\n")
    cut = lambda xs: xs if len(xs) <= most else [*xs[:most], f"... ({len(xs) - most} lines omitted)"]
    package = re.search(r"^\s*package\s+\w+", plain, re.M)
    if not package or not _balanced(plain):
        return "\n".join(cut(lines))
    out = [package[0].strip(), *(f'import "{i}"' for i in go_imports(source))]
    for m in re.finditer(r"^(func|type|var|const)\b", plain, re.M):
        end = _block_end(plain, m.start())
        text = source[m.start() : end]
        brace = plain.find("{", m.start(), end)
        out.append((source[m.start() : brace] if m[1] == "func" and brace >= 0 else text.split("{\n")[0]).rstrip())
    return "\n".join(cut("\n".join(out).split("\n")))


# precise forms: nested declarations of the languages, without what function bodies hold


def _closing(plain: str, at: int) -> int:
    """Just behind the bracket that closes the one at `at`, or the end."""
    depth = 0
    for m in _BRACKET.finditer(plain, at):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.end()
    return len(plain)


_BRACKET = re.compile(r"[()\[\]{}]")
_TS_WORDS = frozenset("if for while switch catch return function typeof await async new super import constructor do else in of delete void yield case throw".split())
_NAME = r"([A-Za-z_$][\w$]*)"
_TS_DECLARATION = re.compile(
    rf"(?<![\w$.])(?:(?P<fn>(?:async\s+)?function\s*\*?\s*{_NAME})|(?P<cls>(?:abstract\s+)?class\s+{_NAME})|(?P<face>interface\s+{_NAME})|(?P<alias>type\s+{_NAME}\s*(?:<[^=;]*>)?\s*=(?!=))"
    rf"|(?P<enum>(?:const\s+)?enum\s+{_NAME})|(?P<arrow>(?:const|let|var)\s+{_NAME}\s*(?::[^=;]+)?=\s*(?:async\s*)?(?=\(|{_NAME}\s*=>)))"
)
_TS_METHOD = re.compile(rf"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*(#?{_NAME[1:-1]}|constructor)\s*(?:<[^>(]*>)?(?=\()")


def _first_line(source: str, at: int, end: int) -> str:
    line = source.find("\n", at, end)
    return source[at : end if line < 0 else line].strip()


def _ts_calls(plain: str) -> list[str]:
    """Sorted distinct names called, the last part of dotted ones."""
    found = {m[2] for m in re.finditer(r"(\bnew\s+|\bfunction\s+)?([A-Za-z_$][\w$]*)\s*\(", plain) if not m[1] and (m[2] not in _TS_WORDS or plain[m.start() - 1 : m.start()] == ".")}
    return sorted(found)


def ts_precise(source: str, typed: bool = True) -> list[Symbol]:
    """Functions, classes, their methods and single arrow functions at any level outside function bodies; with `typed`
    interfaces, type aliases and enums too. Calls are those of the whole body."""
    plain, out = blank_noise(source), []
    line_of, at = _lines_of(plain), 0

    def add(name: str, kind: str, begin: int, end: int, calls: list[str]) -> None:
        out.append(Symbol(name, kind, line_of(begin), _first_line(source, begin, end), calls))

    def expression(i: int) -> int:
        """Where an expression ends: before a comma, semicolon or line break outside brackets."""
        while i < len(plain) and plain[i] not in ",;\n)]}":
            i = _closing(plain, i) if plain[i] in "([{" else i + 1
        return i

    def body(after: int, stop: str = ";") -> tuple[int, int]:
        """The braces behind a head, past its brackets; empty where the statement ends before."""
        i = after
        while i < len(plain) and plain[i] not in "{" + stop:
            i = _closing(plain, i) if plain[i] in "([" else i + 1
        return (i, _closing(plain, i)) if i < len(plain) and plain[i] == "{" else (i, i)

    def methods(begin: int, end: int) -> None:
        i = begin + 1
        while i < end - 1:
            if (m := _TS_METHOD.match(plain, i)) and (i == begin + 1 or not re.match(r"[\w$.]", plain[i - 1])):
                low, high = body(_closing(plain, m.end()))
                if high > low:
                    add(m[1], "method", i + len(m[0]) - len(m[0].lstrip()), high, _ts_calls(plain[low:high]))
                i = max(high, i + 1)
            elif plain[i] in "([{":
                i = _closing(plain, i)
            elif plain[i] == "=":
                i = next((j for j in range(i, end) if plain[j] in ";\n{(["), end)
            else:
                i += 1

    while m := _TS_DECLARATION.search(plain, at):
        kind, name = m.lastgroup, next(x for x in m.groups()[1:] if x and re.fullmatch(_NAME, x) and x not in ("async", "function"))
        begin, at = m.start(), m.end()
        if kind in ("face", "alias", "enum"):
            at = body(at)[1] if kind != "alias" else expression(at)
            if typed:
                add(name, {"face": "interface", "alias": "type_alias", "enum": "enum"}[kind], begin, at, [])
        elif kind == "fn":
            low, at = body(at)
            add(name, "function", begin, at, _ts_calls(plain[low:at]))
        elif kind == "cls":
            low, high = body(at)
            add(name, "class", begin, high, [])
            methods(low, high)
            at = high
        else:
            head = _closing(plain, at) if plain[at] == "(" else re.compile(_NAME).match(plain, at).end()
            if arrow := re.compile(r"\s*(?::[^=;{]+)?=>\s*").match(plain, head):
                end = expression(arrow.end())
                if plain[end : end + 1] != ",":
                    add(name, "function", begin, end, _ts_calls(plain[at:end]))
                at = end
    return out


_RUST_DECLARATION = re.compile(
    r"(?<![\w.])(?:(?P<fn>(?:const\s+|unsafe\s+|async\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<fname>\w+))|(?P<struct>struct\s+(?P<sname>\w+))|(?P<enum>enum\s+(?P<ename>\w+))|(?P<trait>(?:unsafe\s+)?trait\s+(?P<tname>\w+))"
    r"|(?P<impl>(?:unsafe\s+)?impl\b)|(?P<alias>type\s+(?P<aname>\w+)\s*(?:<[^=;]*>)?\s*=))"
)
_RUST_WORDS = frozenset("if for while match return loop fn in let else move unsafe async await where impl as mut ref dyn".split())


def rust_precise(source: str) -> list[Symbol]:
    """fn with a body, struct, enum, trait, impl and type items, those of traits and impls too, but not of function bodies."""
    held = re.sub(r"r(#+)\".*?\"\1|'(?:\\[^'\n]+|[^'\\\n])'", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    plain, out, at = blank_noise(held, quotes='"'), [], 0
    line_of = _lines_of(plain)

    def add(name: str, kind: str, begin: int, end: int, calls: list[str]) -> None:
        out.append(Symbol(name, kind, line_of(begin), _first_line(source, begin, end), calls))

    while m := _RUST_DECLARATION.search(plain, at):
        begin, at = m.start(), m.end()
        brace = next((j for j in range(at, len(plain)) if plain[j] in "{;"), len(plain))
        if m["fn"]:
            if plain[brace : brace + 1] == "{":
                at = _closing(plain, brace)
                calls = {x[2] for x in re.finditer(r"(\bfn\s+)?\b([A-Za-z_]\w*)\s*\(", plain[brace:at]) if not x[1] and x[2] not in _RUST_WORDS}
                add(m["fname"], "function", begin, at, sorted(calls))
            else:
                at = brace
        elif m["impl"]:
            head = plain[at:brace]
            if head.startswith("<"):
                depth = 0
                for k, c in enumerate(head):
                    depth += (c == "<") - (c == ">" and head[k - 1] != "-")
                    if not depth:
                        head = head[k + 1 :]
                        break
            name = re.split(r"\bwhere\b", re.split(r"\bfor\b(?!\s*<)", head)[-1])[0].strip()
            if name and plain[brace : brace + 1] == "{":
                add(" ".join(name.split()), "impl", begin, _closing(plain, brace), [])
            at = brace
        elif m["trait"]:
            add(m["tname"], "trait", begin, _closing(plain, brace) if plain[brace : brace + 1] == "{" else brace, [])
            at = brace
        elif m["alias"]:
            while at < len(plain) and plain[at] != ";":
                at = _closing(plain, at) if plain[at] in "([{" else at + 1
            add(m["aname"], "type_alias", begin, at, [])
        else:
            at = _closing(plain, brace) if plain[brace : brace + 1] == "{" else brace
            add(m["sname"] or m["ename"], "struct" if m["struct"] else "enum", begin, at, [])
    return out


PRECISE = {".py": python_precise, ".ts": ts_precise, ".tsx": ts_precise, ".js": lambda s: ts_precise(s, False), ".jsx": lambda s: ts_precise(s, False), ".rs": rust_precise}
SYMBOLS = {".go": go_symbols, ".py": python_symbols, ".ts": ts_symbols, ".tsx": ts_symbols, ".js": ts_symbols, ".jsx": ts_symbols, ".rs": rust_symbols}
IMPORTS = {".go": go_imports, ".py": python_imports, ".ts": ts_imports, ".tsx": ts_imports, ".js": ts_imports, ".jsx": ts_imports}


def parse(path: str, source: str, precise: bool = False) -> tuple[list[Symbol], list[str]]:
    extension = (re.search(r"\.[^./]*$", path) or [""])[0].lower()
    symbols = PRECISE.get(extension) if precise else None
    symbols = symbols or SYMBOLS.get(extension)
    imports = IMPORTS.get(extension)
    return symbols(source) if symbols else [], imports(source) if imports else []
