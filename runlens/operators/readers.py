"""Dependency readers for source texts: Python, notebooks, shell, pipeline and DVC files.

All are lexical: nothing is executed, imported or followed. A text that can't be read gives one row with the
relation `unreadable` rather than an error.
"""

from __future__ import annotations

import ast
import json
import re
import shlex
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import spread
from .lineage import reader_of, sql_lineage

EDGES = "id string, reader string, name string, relation string, confidence string"
Edge = tuple[str, str, str]

#: Suffixes that make a word of a command a file.
FILE_SUFFIXES = (".csv", ".tsv", ".json", ".jsonl", ".parquet", ".txt", ".yaml", ".yml", ".toml", ".py", ".sh", ".sql", ".ipynb", ".pkl", ".pt", ".onnx", ".npz", ".npy", ".zip", ".gz")


def is_path(value: str) -> bool:
    """A URI, something with a slash, or a name with a known suffix."""
    return bool(re.match(r"^[a-z][a-z0-9+.-]*://", value)) or "/" in value.strip("/") or value.lower().endswith(FILE_SUFFIXES)


def is_dynamic(value: str) -> bool:
    return bool(re.search(r"[${}<>*]", value))


def _edge(name: str, relation: str) -> Edge:
    return name, relation, "dynamic" if is_dynamic(name) else "static"


class _Python(ast.NodeVisitor):
    """Imports, definitions, base classes, decorators, and literal paths given to reading and writing calls."""

    def __init__(self) -> None:
        self.edges: list[Edge] = []
        self.scope: list[str] = []

    def visit_Import(self, node: ast.Import) -> None:
        self.edges += [(a.name, "imports", "static") for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        self.edges += [(base if a.name == "*" else f"{base}.{a.name}" if base.strip(".") else f"{base}{a.name}", "imports", "static") for a in node.names]

    def _define(self, node: Any, kind: str) -> None:
        self.scope.append(node.name)
        self.edges.append((".".join(self.scope), f"defines_{kind}", "static"))
        self.edges += [(ast.unparse(d), "decorated_by", "static") for d in node.decorator_list]
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node: Any) -> None:
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.edges += [(ast.unparse(b), "inherits", "static") for b in node.bases]
        self._define(node, "class")

    def visit_Call(self, node: ast.Call) -> None:
        called = ast.unparse(node.func)
        last = called.rpartition(".")[2]
        first = node.args[0] if node.args else None
        literal = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
        if called in ("importlib.import_module", "__import__"):
            self.edges.append((literal or ast.unparse(first) if first is not None else called, "imports", "static" if literal else "dynamic"))
        elif last == "sql" and literal:
            self.edges += [_edge(n, r) for n, r, _ in sql_lineage(literal)]
        elif re.match(r"(read_|load|scan_|open$)", last) or re.match(r"(to_|save|write|dump)", last):
            mode = next((a.value for a in node.args[1:2] if isinstance(a, ast.Constant) and isinstance(a.value, str)), "")
            writes = not re.match(r"(read_|load|scan_|open$)", last) or (last == "open" and set(mode) & set("wax"))
            if literal and is_path(literal):
                self.edges.append(_edge(literal, "writes" if writes else "reads"))
            elif isinstance(first, ast.JoinedStr):
                self.edges.append((ast.unparse(first), "writes" if writes else "reads", "dynamic"))
        self.generic_visit(node)


def read_python(text: str) -> list[Edge]:
    visitor = _Python()
    visitor.visit(ast.parse(text))
    return visitor.edges


def shell_words(line: str) -> list[str]:
    """The words and runs of punctuation of a line without its comment. Only quotes and backslashes need a lexer's states."""
    if not re.search(r"[\\'\"]", line):
        return re.findall(r"[|&;<>()]+|[^ \t\r\n|&;<>()]+", line.partition("#")[0])
    lexer = shlex.shlex(line, posix=True, punctuation_chars="|&;<>()")
    lexer.whitespace_split = True
    return list(lexer)


def read_shell(text: str) -> list[Edge]:
    """Redirections, scripts that are run, options and words that name files; DVC stages by their flags."""
    out: list[Edge] = []
    for line in re.sub(r"\\\n", " ", text).split("\n"):
        try:
            words = shell_words(line)
        except ValueError:
            continue
        dvc = words[:2] in (["dvc", "run"], ["dvc", "stage"])
        skip = False
        for i, w in enumerate(words):
            before = words[i - 1] if i else ""
            if skip:
                skip = False
            elif before in (">", ">>"):
                out.append(_edge(w, "writes"))
            elif before == "<":
                out.append(_edge(w, "reads"))
            elif dvc and before in ("-d", "--deps", "-p", "--params"):
                out.append(_edge(w, "reads"))
            elif dvc and before in ("-o", "-O", "-m", "-M", "--outs", "--metrics", "--plots"):
                out.append(_edge(w, "writes"))
            elif before in ("python", "python3", "bash", "sh", "source", ".") and not w.startswith("-"):
                out.append(_edge(w, "runs"))
            elif w.startswith("--") and "=" in w and is_path(w.partition("=")[2]):
                option, _, value = w.partition("=")
                out.append(_edge(value, "writes" if re.search(r"out|dest|save", option) else "reads"))
            elif before.startswith("-") and is_path(w):
                out.append(_edge(w, "writes" if re.search(r"^-o$|out|dest|save", before) else "reads"))
            elif i and is_path(w) and not w.startswith("-"):
                out.append(_edge(w, "reads"))
    return out


def read_notebook(text: str) -> list[Edge]:
    """Code cells as Python, also timed ones; %%sql cells and %sql lines as SQL; %%bash cells and ! lines as shell; %run."""
    out: list[Edge] = []
    for cell in json.loads(text).get("cells", []):
        if cell.get("cell_type") != "code":
            continue
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        head, _, body = source.partition("\n")
        if head.startswith("%%sql"):
            out += [_edge(n, r) for n, r, _ in sql_lineage(body)]
        elif re.match(r"%%(bash|sh)\b", head):
            out += read_shell(body)
        elif not head.startswith("%%") or re.match(r"%%(time|timeit|capture|prun)\b", head):
            lines = source.split("\n")
            for line in map(str.lstrip, lines):
                if line.startswith("!"):
                    out += read_shell(line[1:])
                elif line.startswith("%sql "):
                    out += [_edge(n, r) for n, r, _ in sql_lineage(line[5:])]
                elif line.startswith("%run "):
                    out.append(_edge(line[5:].split()[0], "runs"))
            try:
                out += read_python("\n".join("pass" if x.lstrip()[:1] in ("!", "%") else x for x in lines))
            except SyntaxError:
                out.append(("cell", "unreadable", "static"))
    return out


def yaml_subset(text: str) -> Any:
    """Nested mappings, lists and scalars by indentation; flow lists; block text. Enough for pipeline files."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.strip().startswith("#") and x.strip() != "---"]

    def scalar(s: str) -> Any:
        s = re.sub(r"\s+#.*$", "", s).strip()
        if s[:1] == "[" and s[-1:] == "]":
            return [scalar(x) for x in re.findall(r"""'[^']*'|"[^"]*"|[^,\s][^,]*""", s[1:-1])]
        if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s in ("", "~", "null"):
            return None
        if s in ("true", "false"):
            return s == "true"
        return int(s) if re.fullmatch(r"-?\d+", s) else float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s

    def block(i: int, indent: int) -> tuple[Any, int]:
        out: Any = None
        while i < len(lines) and lines[i][0] == indent:
            s = lines[i][1]
            if s.startswith("- ") or s == "-":
                out = [] if out is None else out
                item = s[2:].strip()
                if not isinstance(out, list):
                    raise ValueError("a list item in a mapping")
                if re.match(r"[^\s'\"\[{][^:]*:(\s|$)", item):
                    inner = indent + len(s) - len(item)
                    lines[i] = (inner, item)
                    value, i = block(i, inner)
                elif item:
                    value, i = scalar(item), i + 1
                else:
                    value, i = block(i + 1, lines[i + 1][0]) if i + 1 < len(lines) and lines[i + 1][0] > indent else (None, i + 1)
                out.append(value)
                continue
            m = re.match(r"""("[^"]*"|'[^']*'|[^:]+?)\s*:(?:\s+(.*))?$""", s)
            if not m or isinstance(out, list):
                raise ValueError(f"not a mapping: {s}")
            out = {} if out is None else out
            key, rest = m.group(1).strip("'\""), (m.group(2) or "").strip()
            if rest in ("|", ">", "|-", ">-"):
                i, parts = i + 1, []
                while i < len(lines) and lines[i][0] > indent:
                    parts.append(lines[i][1])
                    i += 1
                out[key] = ("\n" if rest[0] == "|" else " ").join(parts)
            elif rest and not rest.startswith("#"):
                out[key], i = scalar(rest), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > indent or (lines[i + 1][0] == indent and lines[i + 1][1].startswith("-"))):
                out[key], i = block(i + 1, lines[i + 1][0])
            else:
                out[key], i = None, i + 1
        return out, i

    if not lines:
        return None
    value, end = block(0, lines[0][0])
    if end != len(lines):
        raise ValueError("the indentation does not fit")
    return value


def _names(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        own = [value[k] for k in ("path", "name", "uri") if isinstance(value.get(k), str)]
        return own or [k for k in value if isinstance(k, str)]
    return [n for v in value or () for n in _names(v)] if isinstance(value, list) else []


#: Members of a stage that name what it reads, writes and runs.
READS, WRITES, RUNS = ("deps", "inputs", "input", "needs", "depends_on", "params"), ("outs", "outputs", "output", "metrics", "plots"), ("cmd", "command", "script", "run")


def load_structured(text: str, name: str = "") -> Any:
    """The value of a JSON, JSON-lines, TOML or simple YAML text, by its name or else by what it looks like."""
    ending = name.lower().rpartition(".")[2]
    if ending == "toml":
        import tomllib

        return tomllib.loads(text)
    if ending in ("jsonl", "ndjson"):
        return [json.loads(line) for line in text.split("\n") if line.strip()]
    if ending == "json" or text.lstrip()[:1] in ("{", "["):
        return json.loads(text)
    return yaml_subset(text)


def structured_or_reason(text: str, name: str = "") -> tuple[Any, str | None]:
    """(value, None), or (None, why it can't be read)."""
    try:
        return load_structured(text, name), None
    except (ValueError, RecursionError, IndexError, TypeError) as e:
        return None, f"{type(e).__name__}: {e}"


def read_pipeline(text: str) -> list[Edge]:
    """Stages, steps or jobs of a YAML or JSON pipeline (DVC files too): what each reads, writes and runs."""
    data = load_structured(text)
    out: list[Edge] = []
    stages: list[Any] = []
    for key in ("stages", "steps", "jobs", "tasks"):
        found = (data or {}).get(key) if isinstance(data, dict) else None
        stages += list(found.values()) if isinstance(found, dict) else found if isinstance(found, list) else []
    while stages:
        stage = stages.pop(0)
        if not isinstance(stage, dict):
            continue
        inner = stage.get("steps")
        stages += inner if isinstance(inner, list) else []
        for keys, relation in ((READS, "reads"), (WRITES, "writes")):
            out += [_edge(n, relation) for k in keys for n in _names(stage.get(k))]
        for k in RUNS:
            commands = stage.get(k)
            for c in [commands] if isinstance(commands, str) else commands if isinstance(commands, list) else []:
                out += read_shell(c) if isinstance(c, str) else []
    return out


def read_sql_edges(text: str) -> list[Edge]:
    return [_edge(n, r) for n, r, _ in sql_lineage(text)]


#: Characters of texts, and their number, whose edges a task remembers, for texts that occur again.
REMEMBERED_CHARS, REMEMBERED = 8_000_000, 20_000


READERS: dict[str, Callable[[str], list[Edge]]] = {"python": read_python, "notebook": read_notebook, "shell": read_shell, "pipeline": read_pipeline, "dvc": read_pipeline, "sql": read_sql_edges}


#: Readers that a caller has registered: name, (priority, test of a path, reader).
REGISTERED: dict[str, tuple[int, Callable[[str], bool], Callable[[str], list[Edge]]]] = {}


def register_reader(name: str, can_read: Callable[[str], bool], read: Callable[[str], list[Edge]], priority: int = 0, replace: bool = False) -> None:
    """A reader of the caller's: (name, relation, confidence) of a text, for the paths that can_read is true of.

    Registered readers come before the built-in ones, by falling priority and then by name.
    """
    if name in REGISTERED and not replace:
        raise ValueError(f"a reader is registered as {name}")
    REGISTERED[name] = (priority, can_read, read)


def readers_in_order() -> list[str]:
    return sorted(REGISTERED, key=lambda n: (-REGISTERED[n][0], n))


def read_sources(files: DataFrame, id_col: str = "path", text_col: str = "text", reader_col: str | None = None) -> DataFrame:
    """id, reader, name, relation, confidence for whole files, each by the first registered reader that takes its path,
    else by the one that its name suggests. A reader that fails gives an edge that says so.

    Files are dealt out to all cores, and a text that a task has met before isn't read again by a built-in reader, which
    sees nothing else of a file.
    """
    own = [(n, *REGISTERED[n][1:]) for n in readers_in_order()]

    failures = (ValueError, SyntaxError, RecursionError, AttributeError, TypeError, IndexError, OSError)

    def chosen(path: str, reader: str) -> tuple[str, Callable[[str], list[Edge]] | None]:
        for name, can_read, read in own:
            try:
                if can_read(path):
                    return name, read
            except (AttributeError, TypeError, ValueError, OSError):
                continue
        return reader, READERS.get(reader)

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        schema = pa.schema([(c.split()[0], pa.string()) for c in EDGES.split(", ")])
        met: dict[tuple[str, str], list[Edge] | None] = {}
        chars = 0
        for batch in source:
            rows = []
            for name, reader, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, read = chosen(name or "", reader)
                if read is None or text is None:
                    continue
                key, built_in = (reader, text), read is READERS.get(reader)
                if built_in and key in met:
                    edges = met[key]
                else:
                    try:
                        edges = list(dict.fromkeys(read(text)))
                    except failures:
                        edges = None
                    if built_in:
                        if chars + len(text) > REMEMBERED_CHARS or len(met) >= REMEMBERED:
                            met, chars = {}, 0
                        met[key], chars = edges, chars + len(text)
                rows += [(name, reader, *e) for e in edges] if edges is not None else [(name, reader, name or "", "unreadable", "static")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.string()) for i in range(5)], schema=schema)

    path = F.col(id_col).cast("string")
    reader = F.col(reader_col) if reader_col else reader_of(path)
    return spread(files.select(path.alias("id"), reader.alias("reader"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, EDGES)


def resolve_modules(edges: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """id, target: imports joined to the files that define the module, by full name or by its parent module."""
    from .lineage import module_name

    modules = files.select(F.col(path_col).alias("target"), module_name(F.col(path_col)).alias("module"))
    wanted = edges.where("relation = 'imports'").select("id", F.explode(F.array("name", F.regexp_replace("name", r"\.[^.]*$", ""))).alias("module"))
    return wanted.join(modules, "module").select("id", "target").distinct()
