"""Queries of the code index over a literal source tree; expected rows are derived by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as K
from ..operators import search as S
from ..sources import annotate as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PY = "import os\nfrom lib.util import c, d as e\n\n@dec\ndef f(x, *y, z=1):\n    return g(x)\n\ndef g(x):\n    if x:\n        return x\n\nclass K(Base):\n    def m(self):\n        self.n()\n"
UTIL = "import app\n\ndef c(a):\n    if a:\n        return a\n\ndef test_c():\n    c(1)\n"
TREE = {
    "app.py": PY, "src/lib/util.py": UTIL, "broken.py": "def (:\n",
    "a.ts": "import x from './y'\nexport class A extends B {\n  run() { }\n}\nexport function f(a: string, b) {\n  return '}'\n}\nconst g = (q) => {\n}\n",
    "b.go": 'package p\nimport "fmt"\ntype T struct {\n a int\n}\nfunc (t *T) Run(x int) {\n}\nfunc Main() {\n if x { }\n}\n',
    "c.rs": "use a::b;\npub struct S { x: i32 }\nimpl Tr for S {\n    pub fn go(&self, y: u8) {\n    }\n}\n",
    "d.java": "import a.b.C;\npublic class K extends L {\n  public void run(int a) {\n  }\n}\n",
    "e.c": "#include <stdio.h>\nstruct p {\n int x;\n};\nint main(int a)\n{\n return 0;\n}\n",
    "f.rb": "class A < B\n  def go(x)\n    if x\n    end\n  end\nend\n",
    "g.json": '{"a": {"b": 1}, "c": 2}', "h.toml": "[a]\nb = 1\n", "i.yaml": "a:\n  b: 1\n  c:\n    d: 2\ne: 3\n", "j.ini": "x=1\n[s]\nk = v\ntimeout = 1\ntimeuot = 2\nk = w\n",
    ".env": "export A=1\n# c\nB=2\npassword=hunter22\nURL=http://u:p@h/\nKEY=AKIAAAAA\nTOKEN=${X}\n", "Dockerfile": "FROM x:1\nRUN apt\n", "k.tf": 'resource "a" "b" {\n  k = 1\n}\n', "l.conf": "a {\n  b = 1\n}\n",
    "m.md": "# T\nx\n## U\ny\n# V\n", "n.xml": "<a>\n <b c='1'/>\n</a>", "o.cs": "using System;\npublic class Q : R {\n  public int Go(int a) {\n  }\n}\n", "p.prisma": "model User {\n  id Int\n}\n", "q.gradle": "plugins {\n}\n",
}
#: (kind, qualified name, first line, last line, level) by file.
EXPECTED = {
    "app.py": [("import", "os", 1, 1, 0), ("import", "lib.util", 2, 2, 0), ("function", "f", 4, 6, 0), ("function", "g", 8, 10, 0), ("class", "K", 12, 14, 0), ("method", "K.m", 13, 14, 1)],
    "a.ts": [("import", "./y", 1, 1, 0), ("class", "A", 2, 4, 0), ("function", "f", 5, 7, 0), ("function", "g", 8, 9, 0)],
    "b.go": [("import", "fmt", 2, 2, 0), ("class", "T", 3, 5, 0), ("method", "T.Run", 6, 7, 0), ("function", "Main", 8, 10, 0)],
    "c.rs": [("import", "a::b", 1, 1, 0), ("class", "S", 2, 2, 0), ("impl", "S", 3, 6, 0), ("method", "S.go", 4, 5, 1)],
    "d.java": [("import", "a.b.C", 1, 1, 0), ("class", "K", 2, 5, 0), ("method", "K.run", 3, 4, 1)],
    "e.c": [("import", "stdio.h", 1, 1, 0), ("class", "p", 2, 4, 0), ("function", "main", 5, 8, 0)],
    "f.rb": [("class", "A", 1, 6, 0), ("method", "A.go", 2, 5, 1)],
    "g.json": [("section", "a", 1, 1, 1), ("section", "b", 1, 1, 2), ("section", "c", 1, 1, 1)], "h.toml": [("section", "a", 1, 1, 1), ("section", "b", 2, 2, 2)],
    "i.yaml": [("section", "a", 1, 1, 1), ("section", "b", 2, 2, 2), ("section", "c", 3, 3, 2), ("section", "d", 4, 4, 3), ("section", "e", 5, 5, 1)],
    "j.ini": [("section", "x", 1, 1, 1), ("section", "s", 2, 2, 1), ("section", "k", 3, 3, 2), ("section", "timeout", 4, 4, 2), ("section", "timeuot", 5, 5, 2), ("section", "k", 6, 6, 2)],
    ".env": [("section", n, k, k, 1) for n, k in (("A", 1), ("B", 3), ("password", 4), ("URL", 5), ("KEY", 6), ("TOKEN", 7))],
    "Dockerfile": [("section", "FROM x:1", 1, 1, 1), ("section", "RUN apt", 2, 2, 2)], "k.tf": [("section", "resource a b", 1, 1, 1), ("section", "k", 2, 2, 2)], "l.conf": [("section", "a", 1, 1, 1), ("section", "b", 2, 2, 2)],
    "m.md": [("section", "T", 1, 4, 1), ("section", "U", 3, 4, 2), ("section", "V", 5, 6, 1)], "n.xml": [("section", "a", 1, 1, 1), ("section", "b", 2, 2, 2)],
    "o.cs": [("import", "System", 1, 1, 0), ("class", "Q", 2, 5, 0), ("method", "Q.Go", 3, 4, 1)], "p.prisma": [("class", "User", 1, 3, 0)], "q.gradle": [("section", "plugins", 1, 2, 0)],
}


def tree(spark):
    return spark.createDataFrame(sorted(TREE.items()), "path string, content string")


def values(columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "[" + ", ".join(map(cell, v)) + "]" if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def add(name: str, query, columns: str | None = None, rows: list[tuple] | None = None) -> None:
    QUERIES[name] = lambda spark, d: query(spark)
    if rows:
        ORACLES[name] = values(columns, rows)


def parsed(spark):
    return A.annotate(tree(spark))


def one_file(path: str):
    return lambda s: A.annotate(tree(s).where(F.col("path") == path)).select("kind", "qualified_name", "start_line", "end_line", "level")


for path, rows in EXPECTED.items():
    language = {"app.py": "python", "a.ts": "typescript", "b.go": "go", "c.rs": "rust", "d.java": "java", "e.c": "c", "f.rb": "ruby", "g.json": "json", "h.toml": "toml", "i.yaml": "yaml", "j.ini": "ini", ".env": "env", "k.tf": "hcl", "l.conf": "conf", "m.md": "text", "n.xml": "xml", "o.cs": "csharp", "p.prisma": "prisma", "q.gradle": "gradle"}.get(path, path.lower())
    add(f"annotate_{language}", one_file(path), "kind, qualified_name, start_line, end_line, level", rows)

py = lambda s: parsed(s).where(F.col("path").endswith(".py"))
add("file_types", lambda s: tree(s).select("path", A.file_type(F.col("path")).alias("file_type")).where("path IN ('app.py', 'a.ts', '.env', 'Dockerfile', 'broken.py')"), "path, file_type", [("app.py", "python"), ("a.ts", "typescript"), (".env", "env"), ("Dockerfile", "dockerfile"), ("broken.py", "python")])
add("symbol_table", lambda s: K.symbol_table(py(s).where("kind <> 'import'")), "name, path", [("f", "app.py"), ("g", "app.py"), ("K", "app.py"), ("K.m", "app.py"), ("m", "app.py"), ("c", "src/lib/util.py"), ("test_c", "src/lib/util.py")])
add("find_symbol", lambda s: K.find_symbol(py(s).where("kind <> 'import'"), "TestC"), "path, qualified_name, kind, start_line, rank", [("src/lib/util.py", "test_c", "function", 7, 2)])
add("import_resolve", lambda s: K.resolve_imports(py(s).where("kind = 'import'"), tree(s)), "src, dst", [("app.py", "src/lib/util.py"), ("src/lib/util.py", "app.py")])
add("call_edges", lambda s: K.call_edges(py(s)), "src, dst", [("f", "g"), ("test_c", "c")])
add("dead_code", lambda s: K.dead_code(py(s), K.call_edges(py(s))), "path, qualified_name", [("app.py", "f"), ("app.py", "K.m")])
bodies = lambda s: K.symbol_bodies(tree(s), py(s).where("kind <> 'import'"))
add("function_source", lambda s: bodies(s).where("qualified_name = 'g'").select("qualified_name", "body"), "qualified_name, body", [("g", "def g(x):\n    if x:\n        return x")])
add("complexity", lambda s: K.complexity(bodies(s)), "qualified_name, lines, branches, nesting, score", [("f", 3, 0, 1, 2.4), ("g", 3, 1, 2, 5.9), ("K.m", 2, 0, 1, 2.1), ("c", 3, 1, 2, 5.9), ("test_c", 2, 0, 1, 2.1)])
add("code_duplicates", lambda s: K.duplicates(s.createDataFrame([("a", 1, 3, "x = 1  # one\ny"), ("b", 5, 7, "x = 1\n  y"), ("c", 9, 9, "x = 1 y")], "qualified_name string, start_line int, end_line int, body string")).select("n", F.array_join("members", ",").alias("members")), "n, members", [(2, "a,b")])
OLD = [("a", ["x"], ["x"], "1"), ("b", ["x", "y"], ["x"], "1"), ("c", ["x"], ["x"], "1"), ("d", [], [], "1"), ("e", [], [], "1"), ("g", [], [], "1")]
NEW = [("a", ["x", "z"], ["x", "z"], "1"), ("b", ["x"], ["x"], "1"), ("c", ["x", "k"], ["x"], "1"), ("d", [], [], "2"), ("f", [], [], "1"), ("g", [], [], "1")]
SNAP = "symbol string, parameters array<string>, required array<string>, body string"
add("breaking_changes", lambda s: K.breaking_changes(s.createDataFrame(OLD, SNAP), s.createDataFrame(NEW, SNAP)), "symbol, change, breaking", [("a", "required parameter added", True), ("b", "parameter removed", True), ("c", "optional parameter added", False), ("d", "body only", False), ("e", "removed", True), ("f", "added", False)])
add("config_duplicates", lambda s: K.config_duplicates(parsed(s).where("path = 'j.ini'")), "path, a, b, distance", [("j.ini", "k", "k", 0), ("j.ini", "timeout", "timeuot", 2)])
add("config_secrets", lambda s: K.config_secrets(S.lines(tree(s).where("path = '.env'").select("path", F.col("content").alias("text")))), "path, line_no, engine", [(".env", 4, "key"), (".env", 5, "url"), (".env", 6, "prefix")])
add("cross_project", lambda s: K.cross_project(s.createDataFrame([("p", "q.core.io"), ("p", "os"), ("q", "q.core"), ("r", "qq.x")], "project string, module string"), s.createDataFrame([("q", "q.core"), ("p", "p")], "project string, namespace string")), "project, uses", [("p", "q")])
add("code_search_in_symbols", lambda s: S.enclosing(S.lines(tree(s).where("path = 'app.py'").select("path", F.col("content").alias("text"))).where("line RLIKE 'return|self.n'").select("path", "line_no"), py(s).where("kind <> 'import'").select("path", F.col("qualified_name").alias("name"), "start_line", "end_line")), "path, line_no, symbol", [("app.py", 6, "f"), ("app.py", 10, "g"), ("app.py", 14, "K.m")])
add("structure_summary", lambda s: parsed(s).groupBy("path").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions")).where("path LIKE '%.py'"), "path, classes, functions", [("app.py", 1, 3), ("src/lib/util.py", 0, 2)])
