"""Parsers from source text to symbols and sections, one table function for all languages.

Python uses the ast module; JSON and TOML their parsers; brace languages share declaration patterns and a brace
matcher that skips strings and comments; the rest goes by lines. A file that does not parse yields no rows. Java and
Ruby are covered by declarations only (no receiver types, no mixins).
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, name string, qualified_name string, start_line int, end_line int, level int, parameters array<string>, extends array<string>, calls array<string>"

#: File types by extension and by base name.
EXTENSIONS = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cs": "csharp", "java": "java", "rb": "ruby", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "properties": "ini", "env": "env", "tf": "hcl", "hcl": "hcl", "conf": "conf", "md": "text", "txt": "text", "prisma": "prisma", "gradle": "gradle", "xml": "xml"}
NAMES = {"Dockerfile": "dockerfile", ".env": "env"}

Row = tuple


def file_type(path: Column) -> Column:
    """The type by base name, then by extension; generic otherwise."""
    base = F.element_at(F.split(path, "/"), -1)
    out = F.when(base.startswith(".env"), "env").when(base.startswith("Dockerfile"), "dockerfile")
    for ext, kind in EXTENSIONS.items():
        out = out.when(F.lower(base).endswith("." + ext), kind)
    return out.otherwise("generic")


def _row(kind, name, start, end, level=0, qualified=None, parameters=(), extends=(), calls=()) -> Row:
    return kind, name, qualified or name, start, end, level, list(parameters), list(extends), list(calls)


def python(text: str) -> Iterator[Row]:
    def calls(node: ast.AST) -> list[str]:
        return sorted({n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))})

    def walk(body: list, outer: str, level: int) -> Iterator[Row]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = node.args
                names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                yield _row("method" if outer else "function", node.name, first, node.end_lineno, level, outer + node.name, names, (), calls(node))
            elif isinstance(node, ast.ClassDef):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                yield _row("class", node.name, first, node.end_lineno, level, outer + node.name, (), [ast.unparse(b) for b in node.bases])
                yield from walk(node.body, outer + node.name + ".", level + 1)
            elif isinstance(node, ast.Import):
                for x in node.names:
                    yield _row("import", x.name, node.lineno, node.end_lineno, level, parameters=[x.asname] if x.asname else [])
            elif isinstance(node, ast.ImportFrom):
                yield _row("import", "." * node.level + (node.module or ""), node.lineno, node.end_lineno, level, parameters=[x.name for x in node.names])

    yield from walk(ast.parse(text).body, "", 0)


#: Declarations of brace languages: kind and pattern with the group name (and args, bases).
_DECLARATIONS = {
    "typescript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+))?"), ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)"), ("function", r"^\s*(?:export\s+)?const\s+(?P<name>\w+)\s*=\s*(?:async\s*)?\((?P<args>[^)]*)\)[^=]*=>")],
    "go": [("class", r"^type\s+(?P<name>\w+)\s+struct"), ("interface", r"^type\s+(?P<name>\w+)\s+interface"), ("method", r"^func\s+\(\w+\s+\*?(?P<owner>\w+)\)\s+(?P<name>\w+)\((?P<args>[^)]*)\)"), ("function", r"^func\s+(?P<name>\w+)\((?P<args>[^)]*)\)")],
    "rust": [("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<bases>\w+)\s+for\s+)?(?P<name>\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)")],
    "c": [("class", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)\s*\{"), ("function", r"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w*\s]+?\b(?P<name>\w+)\s*\((?P<args>[^;{]*)\)\s*\{?\s*$")],
    "csharp": [("class", r"^\s*(?:(?:public|internal|private|protected|abstract|sealed|static|partial)\s+)*(?:class|struct|interface|record)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w.,\s]+))?"), ("method", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\],?]+\s+(?P<name>\w+)\s*\((?P<args>[^)]*)\)")],
    "java": [("class", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+))?"), ("method", r"^\s*(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+(?:<[^>]+>\s+)?[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\((?P<args>[^)]*)\)")],
    "prisma": [("class", r"^\s*(?:model|enum|type)\s+(?P<name>\w+)\s*\{")],
    "gradle": [("section", r"^\s*(?P<name>[\w.]+)\s*(?:\([^)]*\))?\s*\{")],
}
_IMPORTS = {"typescript": r"""^\s*import\b.*?['"](?P<name>[^'"]+)['"]""", "go": r"""^\s*(?:import\s+)?(?:\w+\s+)?"(?P<name>[\w./-]+)"\s*$""", "rust": r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+)", "c": r"""^\s*#\s*include\s*[<"](?P<name>[^>"]+)[>"]""", "csharp": r"^\s*using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;", "java": r"^\s*import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;"}


def closing(lines: list[str], start: int) -> int:
    """The line (from 0) of the brace that closes the first one at or after start; start if none opens before a semicolon ends the statement."""
    depth, quote, comment = 0, "", False
    for k in range(start, len(lines)):
        line, i = lines[k], 0
        while i < len(line):
            two, c = line[i : i + 2], line[i]
            if comment:
                comment, i = two != "*/", i + (two == "*/")
            elif quote:
                i += c == "\\"
                quote = "" if c == quote and line[i] == c else quote
            elif two == "/*":
                comment, i = True, i + 1
            elif two == "//":
                break
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth <= 0:
                    return k
            elif c == ";" and not depth:
                return k
            i += 1
        quote = quote if quote == "`" else ""
    return len(lines) - 1 if depth else start


def braces(language: str):
    rules = [(kind, re.compile(p)) for kind, p in _DECLARATIONS[language]]
    imports = re.compile(_IMPORTS[language]) if language in _IMPORTS else None

    def parse(text: str) -> Iterator[Row]:
        lines = text.split("\n")
        owners: list[tuple[str, int]] = []
        for k, line in enumerate(lines):
            owners = [o for o in owners if o[1] >= k]
            if imports and (m := imports.match(line)):
                yield _row("import", m["name"], k + 1, k + 1)
                continue
            for kind, rule in rules:
                if m := rule.match(line):
                    got, end = m.groupdict(), closing(lines, k)
                    owner = got.get("owner") or (owners[-1][0] if owners else "")
                    args = [a.strip() for a in (got.get("args") or "").split(",") if a.strip()]
                    bases = [b.strip() for b in (got.get("bases") or "").split(",") if b.strip()]
                    kind = "method" if kind == "function" and owner else kind
                    yield _row(kind, m["name"], k + 1, end + 1, len(owners), f"{owner}.{m['name']}" if owner else m["name"], args, bases)
                    if kind in ("class", "impl", "interface", "section"):
                        owners.append((m["name"], end))
                    break

    return parse


def ruby(text: str) -> Iterator[Row]:
    stack, lines = [], text.split("\n")
    for k, line in enumerate(lines, 1):
        if m := re.match(r"\s*(class|module|def)\s+([\w.:?!=]+)(?:\s*<\s*([\w:]+))?(?:\(([^)]*)\))?", line):
            stack.append((m[1], m[2], k, m[3], m[4]))
        elif re.match(r"\s*(if|unless|while|until|case|begin|for)\b", line) or re.search(r"\bdo\b(\s*\|[^|]*\|)?\s*$", line):
            stack.append(("", "", k, None, None))
        elif re.match(r"\s*end\b", line) and stack:
            word, name, start, base, args = stack.pop()
            if word:
                outer = ".".join(x[1] for x in stack if x[0] in ("class", "module"))
                yield _row({"def": "method" if outer else "function"}.get(word, word), name, start, k, len(stack), f"{outer}.{name}" if outer else name, [a.strip() for a in (args or "").split(",") if a.strip()], [base] if base else [])


def keyed(load, limit: int = 4):
    """Sections for the keys of a parsed document, level by depth; the line is the first after the parent's that names the key."""

    def parse(text: str) -> Iterator[Row]:
        lines = text.split("\n")

        def walk(value, level: int, after: int) -> Iterator[Row]:
            for key, inner in value.items() if isinstance(value, dict) else ():
                at = next((k for k in range(after, len(lines)) if re.search(rf"(?<![\w.-])[\"']?{re.escape(str(key))}[\"']?\s*[:=\].]", lines[k])), after)
                yield _row("section", str(key), at + 1, at + 1, level)
                if level < limit:
                    yield from walk(inner, level + 1, at)

        yield from walk(load(text), 1, 0)

    return parse


def _toml(text: str):
    import tomllib

    return tomllib.loads(text)


def yaml(text: str) -> Iterator[Row]:
    """Keys by indentation; block scalars and flow values are not entered."""
    indents: list[int] = []
    for k, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"(\s*)(?:-\s+)?([\w.\-/]+)\s*:(?:\s|$)", line):
            while indents and indents[-1] >= len(m[1]):
                indents.pop()
            indents.append(len(m[1]))
            yield _row("section", m[2], k, k, len(indents))


def ini(text: str) -> Iterator[Row]:
    level = 1
    for k, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*\[([^\]]+)\]\s*$", line):
            level = 2
            yield _row("section", m[1], k, k, 1)
        elif m := re.match(r"\s*([^#;=:\s][^=:]*?)\s*[=:]", line):
            yield _row("section", m[1], k, k, level)


def env(text: str) -> Iterator[Row]:
    for k, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", line):
            yield _row("section", m[1], k, k, 1)


def dockerfile(text: str) -> Iterator[Row]:
    for k, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*([A-Za-z]+)\s+\S", line):
            title = re.sub(r"\s+", " ", line.strip())
            yield _row("section", title if len(title) <= 60 else title[:57] + "...", k, k, 1 if m[1].upper() == "FROM" else 2)


def nested(pattern: str, limit: int = 4):
    """Blocks and assignments at their brace depth."""

    def parse(text: str) -> Iterator[Row]:
        depth = 0
        for k, line in enumerate(text.split("\n"), 1):
            bare = re.sub(r"#.*|//.*", "", line)
            if (m := re.match(pattern, bare)) and depth < limit:
                yield _row("section", re.sub(r"\s+", " ", m["name"].replace('"', "")).strip(), k, k, depth + 1)
            depth = max(0, depth + bare.count("{") - bare.count("}"))

    return parse


def text(content: str) -> Iterator[Row]:
    """Headings: #, underlines, numbers and capitals; a section ends before the next heading of its level or less."""
    lines, found = content.split("\n"), []
    for k, line in enumerate(lines):
        bare = line.strip()
        below = lines[k + 1].strip() if k + 1 < len(lines) else ""
        if m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", line):
            found.append((k, len(m[1]), m[2]))
        elif bare and re.fullmatch(r"=+|-+", below) and len(below) >= 3 and not re.fullmatch(r"[=-]+", bare):
            found.append((k, 1 if below[0] == "=" else 2, bare))
        elif m := re.match(r"(\d+(?:\.\d+)*)\.?\s+([A-Z].*)$", bare):
            found.append((k, m[1].count(".") + 1, bare))
        elif bare.isupper() and len(bare.split()) >= 4:
            found.append((k, 1, bare))
    for n, (k, level, title) in enumerate(found):
        end = next((j for j, other, _ in found[n + 1 :] if other <= level), len(lines))
        yield _row("section", title, k + 1, end, level)


def xml(content: str) -> Iterator[Row]:
    depth = 0
    for m in re.finditer(r"<!--.*?-->|<(/?)(?:[\w.-]+:)?([\w.-]+)[^<>]*?(/?)>", content, re.S):
        if m[2]:
            depth -= bool(m[1])
            if not m[1]:
                line = content.count("\n", 0, m.start()) + 1
                yield _row("section", m[2], line, line, depth + 1)
                depth += not m[3]


PARSERS = {
    "python": python, **{k: braces(k) for k in _DECLARATIONS}, "ruby": ruby, "json": keyed(json.loads), "toml": keyed(_toml), "yaml": yaml, "ini": ini, "env": env, "dockerfile": dockerfile,
    "hcl": nested(r'\s*(?P<name>[\w-]+(?:\s+"[^"]*")*)\s*[={]'), "conf": nested(r"\s*(?P<name>[\w.-]+)\s*(?:[=:{]|\s\S)"), "text": text, "xml": xml,
}


def annotate(files: DataFrame) -> DataFrame:
    """Symbols, imports and sections of files (path, content), in batches of files; types that have no parser give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, kind in zip(batch["path"], batch["content"], batch["kind"]):
                try:
                    out += [(path, *r) for r in PARSERS[kind](content or "")] if kind in PARSERS else []
                except (SyntaxError, ValueError, RecursionError):
                    pass
            yield pd.DataFrame(out, columns=["path", "kind", "name", "qualified_name", "start_line", "end_line", "level", "parameters", "extends", "calls"])

    return files.select("path", "content", file_type(F.col("path")).alias("kind")).mapInPandas(run, SCHEMA)


def scan_files(spark, root: str, exclude: tuple[str, ...] = (".git", "__pycache__", "node_modules"), most: int = 500_000, limit: int = 10_000) -> DataFrame:
    """(path, content) of the text files below root: sorted before the limit is taken; bytes that are no UTF-8 are read as Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = raw.where(F.col("length") <= most).where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in exclude])))
    text_ = F.when(F.is_valid_utf8(F.col("content")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return kept.orderBy("path").limit(limit).select("path", text_.alias("content"))
