"""Code to symbols, imports and call sites.

Python is parsed by its own ``ast``. Java, TypeScript and JavaScript go through a scanner that blanks strings and
comments and follows braces. Parsing is the one step built-in functions cannot do; it runs in ``mapInPandas``.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "repo string, path string, parse_error boolean, "
    "symbols array<struct<fqname:string,name:string,kind:string,signature:string,line_start:int,line_end:int,"
    "visibility:string,modifiers:array<string>,return_type:string,params_json:string,deprecated:boolean,ord:int>>, "
    "imports array<string>, calls array<struct<name:string,line:int>>"
)


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    error: bool = False


def _symbol(path: str, name: str, kind: str, lines: list[str], first: int, last: int, owner: str | None = None, **more) -> dict:
    out = {
        "fqname": "::".join([path, *([owner] if owner else []), name]), "name": name, "kind": kind,
        "signature": (lines[first - 1].strip() if first <= len(lines) else "")[:200], "line_start": first, "line_end": last,
        "visibility": "public", "modifiers": [], "return_type": None, "params_json": "[]", "deprecated": False, "ord": 0,
    }
    return out | more


def _visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


def parse_python(path: str, source: str) -> Parsed:
    """Direct children of the module and of classes; decorated and nested functions are not symbols."""
    out, lines = Parsed(), source.split("\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Parsed(error=True)
    found: dict[str, list[dict]] = {"class": [], "method": [], "function": []}

    def function(node, kind: str, owner: str | None) -> None:
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        params = [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else ""} for a in args if a.arg not in ("self", "cls")]
        found[kind].append(_symbol(
            path, node.name, kind, lines, node.lineno, node.end_lineno, owner, visibility=_visibility(node.name),
            modifiers=["async"] if isinstance(node, ast.AsyncFunctionDef) else [], return_type=ast.unparse(node.returns) if node.returns else None,
            params_json=json.dumps(params, separators=(",", ":")),
        ))

    def visit(body, owner: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not node.decorator_list:
                function(node, "method" if owner else "function", owner)
            elif isinstance(node, ast.ClassDef) and not node.decorator_list:
                found["class"].append(_symbol(path, node.name, "class", lines, node.lineno, node.end_lineno, visibility=_visibility(node.name)))
                visit(node.body, owner or node.name)

    visit(tree.body, None)
    out.symbols = [*found["class"], *found["method"], *found["function"]]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.imports.append("." * node.level + (node.module or ""))
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                out.calls.append({"name": name, "line": node.func.end_lineno if isinstance(node.func, ast.Attribute) else node.lineno})
    out.imports = list(dict.fromkeys(x for x in out.imports if x))
    out.calls.sort(key=lambda c: c["line"])
    return out


_QUIET = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_TYPE = re.compile(r"^[ \t]*((?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|sealed|export|default|declare)\s+)*)(class|interface|enum|record|@interface)\s+(\w+)", re.MULTILINE)
_MODS = r"(?:public|private|protected|static|final|abstract|synchronized|native|default|async|export|readonly|override|get|set)"
_JAVA_METHOD = re.compile(rf"^[ \t]*((?:@\w+(?:\([^)]*\))?\s+)*(?:{_MODS}\s+)*)(?:<[^>]+>\s+)?(?:([\w.<>\[\], ?]+?)\s+)?(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*([{{;])", re.MULTILINE)
_JAVA_FIELD = re.compile(rf"^[ \t]*((?:@\w+(?:\([^)]*\))?\s+)*(?:{_MODS}\s+)*)([\w.<>\[\], ?]+?)\s+(\w+)\s*(?:=[^;]*)?;", re.MULTILINE)
_TS_METHOD = re.compile(rf"^[ \t]*((?:{_MODS}\s+)*)(\w+)\s*(?:<[^>]+>)?\(([^)]*)\)\s*(?::\s*([^{{;]+?))?\s*\{{", re.MULTILINE)
_TS_FUNCTION = re.compile(r"^[ \t]*((?:export\s+|default\s+|async\s+)*)function\s*\*?\s+(\w+)\s*(?:<[^>]+>)?\(([^)]*)\)\s*(?::\s*([^{;]+?))?\s*\{", re.MULTILINE)
_TS_ARROW = re.compile(r"^[ \t]*((?:export\s+)?)(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[^=]+)?=>", re.MULTILINE)
_CALL = re.compile(r"(?<![\w$])(new\s+)?(?:[\w$]+\s*\.\s*)*([A-Za-z_$][\w$]*)\s*\(")
_WORDS = frozenset("if for while switch catch return new throw else do try synchronized super this function typeof await import assert class constructor".split())


def _blank(source: str) -> str:
    """Strings and comments as blanks, lines kept."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def _depths(code: str) -> list[int]:
    out, depth = [], 0
    for ch in code:
        depth -= ch == "}"
        out.append(depth)
        depth += ch == "{"
    return out


def _close(code: str, at: int) -> int:
    """Where the block that opens at or after ``at`` closes."""
    start = code.find("{", at)
    depth = 0
    for i in range(start, len(code)) if start >= 0 else ():
        depth += (code[i] == "{") - (code[i] == "}")
        if depth == 0:
            return i
    return len(code) - 1


def _params(text: str, typed_first: bool) -> str:
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if typed_first:
            kind, _, name = re.sub(r"@\w+(\([^)]*\))?\s+|\bfinal\s+", "", part).rpartition(" ")
        else:
            name, _, kind = part.split("=")[0].partition(":")
        out.append({"name": name.strip(), "type": kind.strip()})
    return json.dumps(out, separators=(",", ":"))


def parse_braces(path: str, source: str, lang: str) -> Parsed:
    """Java, TypeScript or JavaScript: types, then members, then functions outside any type."""
    code, lines, out = _blank(source), source.split("\n"), Parsed()
    if not code.strip():
        return out
    depth = _depths(code)
    line = lambda at: code.count("\n", 0, at) + 1
    java = lang == "java"
    types, members, functions = [], [], []
    kinds = {"record": "class", "@interface": "annotation"} | ({} if java else {"interface": "class"})
    order = ["class", "interface", "enum", "annotation"]
    for m in _TYPE.finditer(code):
        end = _close(code, m.end())
        kind = kinds.get(m[2], m[2])
        words = re.findall(rf"\b{_MODS}\b", m[1])
        seen = [w for w in words if w in ("public", "private", "protected")]
        s = _symbol(path, m[3], kind, lines, line(m.start(2)), line(end), modifiers=words, visibility=seen[0] if seen else ("" if java and not words else "package" if java else "public"), deprecated="@Deprecated" in m[1])
        types.append((m.start(2), end, m[3], s, depth[m.start(2)]))
    types.sort(key=lambda t: (order.index(t[3]["kind"]), t[0]))

    def owner(at: int):
        return next((t for t in types if t[0] < at <= t[1]), None)

    def level(at: int):
        inside = [t for t in types if t[0] < at <= t[1]]
        return max((t[4] for t in inside), default=-1) + 1

    def member(m, mods: str, kind: str, name: str, first: int, end: int, returns: str | None, params: str) -> None:
        t = owner(first)
        words = re.findall(rf"\b{_MODS}\b", mods)
        seen = [w for w in words if w in ("public", "private", "protected")]
        s = _symbol(path, name, kind, lines, line(first), line(end), t[2] if t else None, modifiers=words, return_type=returns, params_json=params, visibility=seen[0] if seen else ("" if java and not words else "package" if java else "public"), deprecated="@Deprecated" in mods)
        (members if t else functions).append((["method", "field", "function"].index(kind), first, s))

    if java:
        for m in _JAVA_METHOD.finditer(code):
            at = m.start(3)
            t = owner(at)
            if t is None or depth[at] != level(at) or m[3] in _WORDS or (not m[2] and m[3] != t[2]) or (m[2] or "").split(" ")[0] in _WORDS:
                continue
            member(m, m[1], "method", m[3], at, _close(code, m.end() - 1) if m[5] == "{" else m.end(), (m[2] or "").strip() or None, _params(source[m.start(4) : m.end(4)], True))
        for m in _JAVA_FIELD.finditer(code):
            at = m.start(3)
            if owner(at) and depth[at] == level(at) and m[2].split(" ")[0] not in _WORDS | {"package", "import"}:
                member(m, m[1], "field", m[3], at, m.end() - 1, m[2].strip(), "[]")
        out.imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", code, re.MULTILINE)
    else:
        for m in _TS_METHOD.finditer(code):
            at = m.start(2)
            if owner(at) and depth[at] == level(at) and m[2] not in _WORDS - {"constructor"}:
                member(m, m[1], "method", m[2], at, _close(code, m.end() - 1), (m[4] or "").strip() or None, _params(source[m.start(3) : m.end(3)], False))
        for m in _TS_FUNCTION.finditer(code):
            if owner(m.start(2)) is None:
                member(m, m[1], "function", m[2], m.start(2), _close(code, m.end() - 1), (m[4] or "").strip() or None, _params(source[m.start(3) : m.end(3)], False))
        for m in _TS_ARROW.finditer(code):
            if owner(m.start(2)) is None and depth[m.start(2)] == 0:
                brace = re.match(r"\s*\{", code[m.end() :])
                member(m, m[1], "function", m[2], m.start(2), _close(code, m.end()) if brace else m.end(), None, "[]")
        out.imports = re.findall(r"""(?:^|\n)\s*(?:import|export)\b[^'"\n;]*?["']([^"']+)["']|\brequire\s*\(\s*["']([^"']+)["']""", source)
        out.imports = [a or b for a, b in out.imports]
    out.symbols = [t[3] for t in types] + [s for *_, s in sorted([*members, *functions], key=lambda x: x[:2])]
    definitions = {(s["name"], s["line_start"]) for s in out.symbols if s["kind"] in ("method", "function")}
    for m in _CALL.finditer(code):
        at = line(m.start(2))
        if not m[1] and m[2] not in _WORDS and (m[2], at) not in definitions and not code[max(0, m.start() - 9) : m.start()].rstrip().endswith(("function", "@")):
            out.calls.append({"name": m[2], "line": at})
    out.imports = list(dict.fromkeys(out.imports))
    return out


def parse_source(path: str, source: str | None, lang: str) -> Parsed:
    if source is None:
        return Parsed(error=True)
    if lang == "python":
        out = parse_python(path, source)
    elif lang in ("java", "typescript", "javascript"):
        out = parse_braces(path, source, lang)
    else:
        out = Parsed()
    for k, s in enumerate(out.symbols):
        s["ord"] = k
    return out


def parse(files: DataFrame) -> DataFrame:
    """``files(repo, path, lang, content)`` to one row a file with its symbols, imports and call sites."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, lang, content in zip(batch["repo"], batch["path"], batch["lang"], batch["content"]):
                p = parse_source(path, content, lang)
                rows.append((repo, path, p.error, p.symbols, p.imports, p.calls))
            yield pd.DataFrame(rows, columns=["repo", "path", "parse_error", "symbols", "imports", "calls"])

    return files.select("repo", "path", "lang", "content").mapInPandas(run, SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    """One row a symbol; of equal names in a file the last one stays."""
    rows = parsed.select("repo", F.col("path").alias("file_path"), F.inline("symbols"))
    best = rows.groupBy("repo", "fqname").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("repo", "fqname")]), "ord").alias("s"))
    return best.select("repo", "fqname", "s.*")


def call_sites(parsed: DataFrame) -> DataFrame:
    """``(call_id, repo, file, name, line)``; the id is the file and the place in it."""
    rows = parsed.select("repo", F.col("path").alias("file"), F.posexplode("calls").alias("i", "c"))
    return rows.select(F.concat_ws("#", "repo", "file", "i").alias("call_id"), "repo", "file", "c.name", "c.line")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", F.col("path").alias("file"), F.posexplode("imports").alias("pos", "name"))
