"""Queries of project listings and reports; expected rows are derived by hand, or given by SQL on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as K
from ..operators import memory as M
from ..operators import project as P
from ..operators import search as S
from .bindings import NOW, OBS, observations, table
from .code_queries import TREE, parsed, py, tree, values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, columns: str | None = None, rows: list[tuple] | None = None, sql: str | None = None) -> None:
    QUERIES[name] = query
    if rows or sql:
        ORACLES[name] = sql or values(columns, rows)


def frame(s, rows, schema):
    return s.createDataFrame(rows, schema)


def lines_of(s, path=None):
    t = tree(s) if path is None else tree(s).where(F.col("path") == path)
    return S.lines(t.select("path", F.col("content").alias("text")))


PATHS = [("src/a.py",), ("src/deep/b.py",), ("node_modules/x/c.py",), ("d.txt",), ("src/gen/e.min.py",)]
add("include_exclude", lambda s, d: frame(s, PATHS, "path string").where(P.included(F.col("path"), ["**/*.py"], ["node_modules", "*.min.py"])), "path", [("src/a.py",), ("src/deep/b.py",)])
add("ignore_globs", lambda s, d: P.ignore_globs(frame(s, [("# c",), ("dist/",), ("!keep",), ("",), ("*.log",)], "line string")), '"glob"', [("**/dist/**",), ("dist/**",), ("*.log",)])
add("incremental_reindex", lambda s, d: P.reindex(frame(s, [("a", "1"), ("b", "1"), ("c", "1")], "symbol string, hash string"), frame(s, [("a", "1"), ("b", "2"), ("d", "1")], "symbol string, hash string")), "symbol, status", [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")])
add("env_usage", lambda s, d: P.env_usage(frame(s, [("a", 1, "export HOST=1"), ("a", 2, "x = os.getenv('HOST')"), ("b", 3, "const h = process.env.HOST"), ("b", 4, "echo ${HOST}"), ("b", 5, "# HOST"), ("b", 6, "none")], "path string, line_no int, line string"), "HOST"), "path, line_no, usage", [("a", 1, "definition"), ("a", 2, "read"), ("b", 3, "read"), ("b", 4, "expansion"), ("b", 5, "mention")])
add("routes", lambda s, d: P.routes(frame(s, [("app/users/page.tsx",), ("app/api/x/route.ts",), ("lib/z.ts",)], "path string"), frame(s, [("C.java", '@GetMapping("/v1/a")'), ("C.java", "@Override")], "path string, decorator string")), "route, method, path", [("/users", "PAGE", "app/users/page.tsx"), ("/api/x", "ROUTE", "app/api/x/route.ts"), ("/v1/a", "GET", "C.java")])
add("entry_points", lambda s, d: P.entry_points(py(s), K.call_edges(py(s))), "qualified_name, score", [("f", 0.4), ("g", 0.2), ("K.m", 0.4), ("test_c", 0.2)])
add("impacted_tests", lambda s, d: P.impacted_tests(frame(s, [("test_x", "x"), ("test_y", "y")], "src string, dst string"), frame(s, [("src/a.py", "x"), ("src/b.py", "y"), ("tests/test_a.py", "test_x"), ("tests/test_b.py", "test_y")], "path string, qualified_name string"), ["src/a.py"]), "test, reasons", [("tests/test_a.py", "caller,name")])
add("context_pack", lambda s, d: P.context_pack(frame(s, [(1, 10.0, 50), (2, 9.0, 20), (3, 5.0, 60), (4, 1.0, 30)], "id long, value double, cost long"), 100), "place, id", [(0, 2), (1, 1), (2, 4)])
add("backward_slice", lambda s, d: P.backward_slice(frame(s, [(1, "def f(a):\n    b = a + 1\n    c = 5\n    if b:\n        d = b * 2\n    e = c\n    return d\n", "d", 7)], "id long, source string, variable string, line int")), "id, line", [(1, 2), (1, 4), (1, 5), (1, 7)])
add("tool_router", lambda s, d: P.tool_router("find dead code", frame(s, [("a", "Find dead code in a project"), ("b", "find files"), ("c", "other")], "name string, doc string"), 2), "name, score", [("a", 1.0), ("b", 0.333333)])
add("java_hotspots", lambda s, d: P.java_hotspots(frame(s, [("K.a", 'new Foo(); x.stream(); String s = a + "b";'), ("K.b", "return 1;"), ("K.c", "new ArrayList<String>(); new int[3]; String.format(x); Optional.of(x); Integer.valueOf(x); Pattern.compile(x); throw new FooException(x);")], "qualified_name string, body string")), "qualified_name, score", [("K.a", 10.0), ("K.c", 43.0)])
add("docker_analysis", lambda s, d: P.docker_report(frame(s, [("Dockerfile", 1, "FROM a:latest"), ("Dockerfile", 2, "FROM b AS c"), ("Dockerfile", 3, "FROM d:1"), ("Dockerfile", 4, "RUN x")], "path string, line_no int, line string")), "path, line_no, issue", [("Dockerfile", 1, "latest"), ("Dockerfile", 2, "untagged")])
add("config_orphans", lambda s, d: P.config_orphans(frame(s, [("HOST",), ("UNUSED",)], "key string"), frame(s, [("os.getenv('HOST')",), ("process.env.GHOST",)], "line string")), "key, kind", [("UNUSED", "orphan"), ("GHOST", "ghost")])
SQLS = [("m", "m/1.sql", "CREATE TABLE a (id INT PRIMARY KEY, n VARCHAR(10)); CREATE TABLE b (x INT);"), ("m", "m/2.sql", "ALTER TABLE a ADD COLUMN t TEXT; -- note\nDROP TABLE b; ALTER TABLE a DROP COLUMN n;")]
add("db_schema", lambda s, d: P.migrations(frame(s, SQLS, "folder string, path string, content string")), '"table", "column", "type"', [("a", "id", "INT"), ("a", "t", "TEXT")])
add("summary_parse", lambda s, d: P.summary_bullets(frame(s, [(1, "# Done\n- a\n* b\n## Next\n- c\ntext")], "id long, text string")), "id, heading, bullet", [(1, "Done", "a"), (1, "Done", "b"), (1, "Next", "c")])
add("extractions", lambda s, d: P.extractions(frame(s, [(1, '[{"type":"note","title":"x","content":"y"},{"type":"bad","title":"z"},{"type":"note","title":" "}]'), (2, "{broken")], "id long, raw string"), ["note"]), "id, type, title, content", [(1, "note", "x", "y")])
add("contradictions", lambda s, d: P.contradictions(frame(s, [(1, "Always use tabs"), (2, "never use tabs"), (3, "nothing")], "id long, content string"), "always indent", [("\\balways\\b", "\\bnever\\b")]), "id, term", [(2, "\\bnever\\b")])
add("capture_get", lambda s, d: P.capture_range(frame(s, [(1, "a\nb\nc\nd"), (2, "x")], "id long, output string"), 2, 3), "id, part", [(1, "b\nc"), (2, "")])
add("replace_symbol", lambda s, d: P.splice(frame(s, [(1, "a"), (2, "b"), (3, "c"), (4, "d")], "line_no int, line string"), 2, 3, ["X"]), "line_no, line", [(1, "a"), (2, "X"), (3, "d")])
add("get_lines", lambda s, d: lines_of(s, "app.py").where("line_no BETWEEN 8 AND 9").select("line_no", "line"), "line_no, line", [(8, "def g(x):"), (9, "    if x:")])
add("get_functions", lambda s, d: py(s).where("kind IN ('function', 'method')").select("path", "qualified_name", F.array_join("parameters", ",").alias("parameters")), "path, qualified_name, parameters", [("app.py", "f", "x,y,z"), ("app.py", "g", "x"), ("app.py", "K.m", "self"), ("src/lib/util.py", "c", "a"), ("src/lib/util.py", "test_c", "")])
add("get_classes", lambda s, d: parsed(s).where("kind = 'class' AND path LIKE '%.py'").select("path", "name", F.array_join("extends", ",").alias("extends")), "path, name, extends", [("app.py", "K", "Base")])
add("get_imports", lambda s, d: py(s).where("kind = 'import'").select("path", F.col("name").alias("module"), F.array_join("parameters", ",").alias("names")), "path, module, names", [("app.py", "os", ""), ("app.py", "lib.util", "c,d"), ("src/lib/util.py", "app", "")])
add("project_summary", lambda s, d: tree(s).agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n", -1))).alias("lines")), "files, lines", [(len(TREE), sum(c.count("\n") + 1 for c in TREE.values()))])
add("content_chunks", lambda s, d: P.chunks(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")))
add("chunk_registry", lambda s, d: P.chunk_registry(P.chunks(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))))
add("bus_list", lambda s, d: observations(s, d).where(f"expires_at_epoch >= {NOW}").orderBy(F.desc("created_at_epoch"), "id").limit(20).select("id", "created_at_epoch"), sql=f"WITH {OBS} SELECT id, created_at_epoch FROM obs WHERE expires_at_epoch >= {NOW} ORDER BY created_at_epoch DESC, id LIMIT 20")
add("injection_stats", lambda s, d: M.session_budget(observations(s, d), 50_000).where("tokens > 0").agg(F.count("*").alias("sessions"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("mean_tokens")), sql=f"WITH {OBS} SELECT count(*) AS sessions, sum(t)::BIGINT AS tokens, round(avg(t), 4) AS mean_tokens FROM (SELECT session_id, sum(length(content) // 4) AS t FROM obs GROUP BY 1) WHERE t > 0")
add("observations_by_symbol", lambda s, d: observations(s, d).where("symbol = 'sym9'").orderBy(F.desc("importance"), F.desc("created_at_epoch"), "id").limit(10).select("id", "importance"), sql=f"WITH {OBS} SELECT id, importance FROM obs WHERE symbol = 'sym9' ORDER BY importance DESC, created_at_epoch DESC, id LIMIT 10")
add("linked_observations", lambda s, d: M.symbol_links(observations(s, d)).where("source_id = 3 OR target_id = 3").select(F.when(F.col("source_id") == 3, F.col("target_id")).otherwise(F.col("source_id")).alias("other")), sql=f"WITH {OBS}, l AS (SELECT id, min(id) OVER (PARTITION BY project_root, symbol) AS hub FROM obs) SELECT CASE WHEN hub = 3 THEN id ELSE hub END AS other FROM l WHERE id <> hub AND (hub = 3 OR id = 3)")
