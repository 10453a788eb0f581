"""Source trees: scanning, pruning, languages, repository overview."""

from __future__ import annotations

import os
import subprocess
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.scalars import cases
from evidentia.scratch import Scratch

# Folders that are never read, languages by extension, and the names that give tools and frameworks away.
IGNORED = [
    ".git", "target", "node_modules", "dist", "build", ".next", ".svelte-kit", ".cache", "coverage", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache",
    ".pytest_cache", ".terraform", ".gradle",
]
EXTENSIONS = {
    "py": "python", "pyi": "python", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "rs": "rust", "go": "go", "ts": "typescript", "tsx": "tsx",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "php": "php", "phtml": "php",
}
OVERVIEW_LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go"}
MANAGERS = {
    "pyproject.toml": "pip", "setup.py": "pip", "setup.cfg": "pip", "requirements.txt": "pip", "Pipfile": "pipenv", "poetry.lock": "poetry", "package.json": "npm",
    "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "Cargo.toml": "cargo", "go.mod": "go", "composer.json": "composer", "composer.lock": "composer",
}
PYTHON_MANIFESTS = ["pyproject.toml", "requirements.txt", "setup.py", "Pipfile"]
FRAMEWORKS = [
    (PYTHON_MANIFESTS, "flask", "flask"), (PYTHON_MANIFESTS, "django", "django"), (PYTHON_MANIFESTS, "fastapi", "fastapi"), (["package.json"], '"express"', "express"),
    (["package.json"], '"next"', "nextjs"), (["Cargo.toml"], "axum", "axum"), (["Cargo.toml"], "actix", "actix"), (["go.mod"], "github.com/gin-gonic/gin", "gin"),
    (["composer.json"], "laravel/framework", "laravel"), (["composer.json"], "symfony/", "symfony"), (["composer.json"], "drupal/", "drupal"),
    (["wp-config.php", "wp-load.php"], "", "wordpress"),
]
ENTRYPOINTS = [
    "main.py", "app.py", "__main__.py", "wsgi.py", "asgi.py", "main.rs", "server.rs", "main.go", "server.go", "server.ts", "server.js", "index.ts", "index.js", "index.php",
]
IAC_NAMES = [
    "terraform.lock.hcl", "template.yaml", "template.yml", "samconfig.toml", "chart.yaml", "values.yaml", "values.yml", "dockerfile", "docker-compose.yaml",
    "docker-compose.yml", "compose.yaml", "compose.yml", "docker-compose.override.yaml", "docker-compose.override.yml",
]
IAC_FOLDERS = r"^(k8s|kubernetes|helm|manifests|\.github/workflows)/|/(k8s|kubernetes|helm)/"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Names and lengths of the files below a root (a URI): ``path`` (relative), ``length``.

    Folders are listed by tasks, a level of the tree at a time; ignored ones
    are left out before they are entered. The driver sees a number a level."""
    import pyarrow as pa
    from pyarrow import fs

    ignored = frozenset(IGNORED)

    def below(batches):
        store, base = fs.FileSystem.from_uri(root)
        base, local = base.rstrip("/"), isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                found = [f for f in found if f.base_name not in ignored and f.type in (fs.FileType.File, fs.FileType.Directory)]
                found = [f for f in found if f.type == fs.FileType.File or not (local and os.path.islink(f.path))]  # links may lead back up
                yield pa.RecordBatch.from_arrays([
                    pa.array([f.path[len(base) + 1 :] for f in found], pa.string()), pa.array([f.size or 0 for f in found], pa.int64()),
                    pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                ], names=["path", "length", "folder"])

    scratch = Scratch(spark, "listing")
    folders, n, parts = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        told = Observation()
        level = folders.repartition(max(1, min(n // 64, 1000))).mapInArrow(below, "path string, length long, folder boolean")
        level = scratch.keep(level.observe(told, F.count_if("folder").alias("n")), f"level_{len(parts)}")
        parts.append(level.where(~F.col("folder")).select("path", "length"))
        folders, n = level.where("folder").select("path"), told.get["n"] or 0
    return reduce(DataFrame.unionByName, parts)


def scan(spark: SparkSession, root: str, bytes_a_task: int = 64 << 20) -> DataFrame:
    """Files below a root (a path or URI): ``path`` (relative), ``content``, ``length``.

    Ignored folders are pruned. Spark's own file sources hide names that begin
    with ``_`` or ``.``, which source trees need, so names are listed by
    :func:`listed` and tasks read the files of their share."""
    import pyarrow as pa
    from pyarrow import fs

    uri = root if "://" in root else f"file://{os.path.abspath(root)}"
    names = listed(spark, uri)
    n, size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, -(-size // bytes_a_task)))

    def read(batches):
        own, at = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with own.open_input_stream(f"{at.rstrip('/')}/{path}", compression=None) as f:
                    yield pa.RecordBatch.from_pydict({"path": [path], "content": [f.read()], "length": [length]})

    return names.repartition(tasks).mapInArrow(read, "path string, content binary, length long")


def pruned(files: DataFrame) -> DataFrame:
    """Files without those in or named like an ignored folder."""
    return files.where(~F.exists(F.split("path", "/"), lambda p: p.isin(IGNORED)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """Language by name, then by lower-cased extension; null where there is none."""
    name = F.lower(basename(path))
    docker = (name == "dockerfile") | name.endswith(".dockerfile")
    extension = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    return F.when(docker, "dockerfile").otherwise(cases(extension, EXTENSIONS, F.lit(None).cast("string")))


def texts(files: DataFrame) -> DataFrame:
    """Files with ``text`` and ``language``; what is not UTF-8 has no text and goes, as do blank files."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    out = files.select("path", language(F.col("path")).alias("language"), text.alias("text"))
    return out.where(F.col("text").isNotNull() & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))


def is_iac(path: Column) -> Column:
    """Infrastructure files: by name anywhere, YAML only in tell-tale folders."""
    name = F.lower(basename(path))
    named = name.isin(IAC_NAMES) | name.rlike(r"\.tf$|\.tfvars$|^dockerfile\.|\.dockerfile$")
    return named | (name.rlike(r"\.ya?ml$") & path.rlike(IAC_FOLDERS))


def overview(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sorted sets of languages, frameworks, package managers and entrypoints, of all files
    or of each ``by``. ``files`` has ``path`` and ``text`` (null where unreadable)."""
    by = by or []
    name, lower = basename(F.col("path")), F.lower(F.coalesce("text", F.lit("")))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    langs = F.array(language(F.col("path")), cases(extension, OVERVIEW_LANGUAGES, F.lit(None).cast("string")), F.when(is_iac(F.col("path")), "iac"))
    works = F.array(*(F.when(name.isin(files_) & lower.contains(word), F.lit(found)) for files_, word, found in FRAMEWORKS))
    entry = F.when(name.isin(ENTRYPOINTS) | (F.col("path") == "app/__init__.py"), F.col("path"))
    rows = files.select(*by, langs.alias("l"), works.alias("f"), cases(name, MANAGERS, F.lit(None).cast("string")).alias("m"), entry.alias("e"))
    sets = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(c)))))
    return rows.groupBy(*by).agg(
        sets("l").alias("languages"), sets("f").alias("frameworks"), F.array_sort(F.collect_set("m")).alias("package_managers"),
        F.array_sort(F.collect_set("e")).alias("entrypoints"),
    )


def facts(overviews: DataFrame, engagement_id: str) -> DataFrame:
    """Overview rows as repo_facts: one fact for each name."""
    kinds = {"language": "languages", "framework": "frameworks", "package_manager": "package_managers", "entrypoint": "entrypoints"}
    def each(kind: str, column: str) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(v.alias("name"))).alias("json")))

    every = F.flatten(F.array(*(each(k, c) for k, c in kinds.items())))
    return overviews.select(F.explode(every).alias("f")).select(F.lit(engagement_id).alias("engagement_id"), "f.kind", "f.json")


def in_scope(rows: DataFrame, include: list[str], exclude: list[str], column: str = "file_path") -> DataFrame:
    """Rows whose path begins with an included prefix (all, if none is given) and with no excluded one."""
    begins = lambda ps: reduce(lambda a, p: a | F.col(column).startswith(p), ps, F.lit(False))
    return rows.where((begins(include) if include else F.lit(True)) & ~begins(exclude))


def resolve_within(root: str, path: str) -> str:
    """The real path of ``path`` below ``root``; ValueError if it leads outside."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} lies outside {root}")
    return full


def target_tree(explicit: str | None, recorded: str | None) -> str:
    return explicit or recorded or "."


def git_facts(root: str) -> dict[str, str | None]:
    """Remote and head of a work tree, as far as git tells."""
    def ask(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() or None if done.returncode == 0 else None

    return {"remote": ask("remote", "get-url", "origin"), "head": ask("rev-parse", "HEAD")}
