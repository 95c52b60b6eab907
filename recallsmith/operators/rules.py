"""Rules over files, dependency audits, intent routing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Own rules (id, glob, regex, severity, message).
PRESET = [
    ("no-print", "**/*.py", r"(?m)^\s*print\(", "warn", "use a logger"),
    ("no-secret", "**/*", r"(?i)(token|password)\s*=\s*\"[^\"]{8,}\"", "block", "secret in a file"),
    ("no-todo", "**/*", r"\bTODO\b", "warn", "open task"),
]
#: Words that route a request, in order of priority; a word may be part of another.
INTENTS = [
    ("DREAM", "dream insight idea sogno intuizione synthesize synthesis".split()),
    ("ALIGNMENT", ["align", "check goal", "evaluate", "alignment", "allinea", "valuta", "verify"]),
    ("ADD", "remember save store capture ricorda salva nota memorizza add".split()),
    ("LIST", ["list", "show", "tutte", "elenca", "mostra", "tutti", "lista", "all memories"]),
    ("SEARCH", "how find search what where cerca trova come dove cosa chi when".split()),
]
#: Words of trouble in a memory, and phrases of work still to do.
WARNINGS = ["bug", "error", "problem", "fail", "issue", "time", "broken"]
LATENT = ["refactor", "to do", "must fix", "should rewrite", "idea"]


def glob_regex(glob: str) -> str:
    """A glob as an anchored regex; `**/` also stands for no folder."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def violations(files: DataFrame, rules: list[tuple], override: str = "rule:allow") -> DataFrame:
    """(path, rule_id, severity, message) of files (path, content). Rules are literals of the plan, so nothing is joined."""
    found = []
    for rid, glob, pattern, severity, message in rules:
        if len(pattern) > 1024:
            raise ValueError(f"pattern of {rid} is too long")
        re.compile(pattern)
        hit = F.col("path").rlike(glob_regex(glob)) & F.col("content").rlike(pattern) & ~F.contains("content", F.lit(f"{override} {rid}"))
        found.append(F.when(hit, F.struct(F.lit(rid).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))))
    return files.select("path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")).select("path", "v.*")


def upsert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules (id, ...) with new ones in the place of those with the same id; of new ones with one id the last by `seq`."""
    last = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), "seq").alias("x")).select("id", "x.*").drop("seq")
    return rules.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)


def remove_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Rules without those of some ids."""
    return rules.join(ids.select("id"), "id", "left_anti")


#: Import names whose package has another name.
PACKAGES = {"bs4": "beautifulsoup4", "cv2": "opencv-python", "dateutil": "python-dateutil", "dotenv": "python-dotenv", "git": "gitpython", "jwt": "pyjwt", "PIL": "pillow", "sklearn": "scikit-learn", "yaml": "pyyaml"}


def imports(files: DataFrame) -> DataFrame:
    """(path, package) of the top-level packages that Python sources (path, content) import absolutely, wherever the import stands.

    Sources are parsed by Python's own parser; one that it can't read imports nothing.
    """
    import pyarrow as pa

    def found(source: str | None) -> list[str]:
        import ast

        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        out: dict[str, None] = {}
        for node in ast.walk(tree):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module] if isinstance(node, ast.ImportFrom) and not node.level and node.module else []
            out.update(dict.fromkeys(n.split(".")[0] for n in names))
        return list(out)

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([found(x) for x in b.column(1).to_pylist()], pa.list_(pa.string()))], ["path", "packages"])

    return files.select("path", "content").mapInArrow(run, "path string, packages array<string>").select("path", F.explode("packages").alias("package"))


def used_packages(found: DataFrame, project: str | None = None, local: tuple[str, ...] = (), packages: dict[str, str] = PACKAGES) -> DataFrame:
    """Imports (path, package) by the names of the packages that hold them, without the standard library, local modules and the project itself."""
    import sys

    names = F.create_map(*(F.lit(x) for kv in packages.items() for x in kv))
    other = found.where(~F.col("package").isin(sorted({*sys.stdlib_module_names, *local})))
    mapped = other.withColumn("package", F.lower(F.coalesce(F.element_at(names, F.col("package")), F.col("package"))))
    own = (project or "").lower()
    return mapped.where(~F.col("package").isin(own, own.replace("-", "_")))


def import_index(found: DataFrame) -> DataFrame:
    """(package, files): the files that import a package, sorted."""
    return found.groupBy("package").agg(F.sort_array(F.collect_set("path")).alias("files"))


def manifest_packages(kind: str, content: Column) -> Column:
    """Package names of a manifest's text: pyproject, package.json, Cargo.toml or go.mod."""
    if kind == "package.json":
        j = lambda k: F.coalesce(F.map_keys(F.from_json(F.get_json_object(content, f"$.{k}"), "map<string,string>")), F.array().cast("array<string>"))
        return F.array_distinct(F.concat(j("dependencies"), j("devDependencies")))
    if kind == "go.mod":
        return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+v[0-9]"), F.lit(1)))
    if kind == "Cargo.toml":
        body = F.regexp_extract(content, r"(?s)\[dependencies\]\s*(.*?)(?:\n\[|$)", 1)
        return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?m)^\s*([A-Za-z0-9_-]+)\s*="), F.lit(1)))
    body = F.regexp_extract(content, r"""(?s)dependencies\s*=\s*\[((?:[^\]"']|"[^"]*"|'[^']*')*)\]""", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)), lambda p: F.lower(F.trim(F.split(p, r"[<>=!~\[ ]")[0]))))


def audit(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(package, finding): declared but not used (orphan), used but not declared (ghost)."""
    d, u = declared.select("package").distinct(), used.select("package").distinct()
    return d.join(u, "package", "left_anti").withColumn("finding", F.lit("orphan")).unionByName(u.join(d, "package", "left_anti").withColumn("finding", F.lit("ghost")))


def intent(said: Column) -> Column:
    """The first intent one of whose words is in what was said, else UNKNOWN."""
    out = F.lit("UNKNOWN")
    for name, words in reversed(INTENTS):
        out = F.when(has_any(said, words), name).otherwise(out)
    return out


def has_any(said: Column, words: list[str]) -> Column:
    """Whether a text has one of some lower-case words or phrases, as part of others too."""
    low = F.lower(said)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def warnings(results: DataFrame) -> DataFrame:
    """Those results (id, text) that tell of trouble."""
    return results.where(has_any(F.col("text"), WARNINGS))


def latent_tasks(memories: DataFrame) -> DataFrame:
    """(task) of the distinct memories that speak of work still to do, as items of a list."""
    return memories.where(has_any(F.col("text"), LATENT)).select(F.concat(F.lit("- [ ] "), "text").alias("task")).distinct()
