"""Source files as tables: globs, ignore rules, modification times."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The endings and ignore globs that an index must agree on.
EXTENSIONS = ("py", "rs", "ts", "tsx", "js", "jsx", "go", "java", "cpp", "c", "h", "hpp", "rb", "php", "swift", "kt", "scala", "md", "mdx")
IGNORED = (
    "**/.git/**", "**/.svn/**", "**/.hg/**",
    "**/__pycache__/**", "**/*.pyc", "**/.venv/**", "**/venv/**", "**/*.egg-info/**", "**/.eggs/**", "**/site-packages/**", "**/dist-packages/**", "**/.tox/**", "**/.nox/**", "**/.pytest_cache/**", "**/.mypy_cache/**", "**/.ruff_cache/**",
    "**/node_modules/**",
    "**/target/**", "**/dist/**", "**/build/**", "**/out/**",
    "**/.idea/**", "**/.vscode/**", "**/*.swp", "**/*.swo", "**/*~",
    "**/.cache/**", "**/*.log",
)
IGNORE_FILE = ".gitignore"


def glob_of(line: str) -> str | None:
    """An ignore line as a glob; None for blanks, comments and negations."""
    line = line.strip()
    if not line or line[0] in "#!":
        return None
    anchored = line.startswith("/") or "/" in line.strip("/")
    body = line.strip("/") + ("/**" if line.endswith("/") else "")
    return body if anchored or body.startswith("**/") else f"**/{body}"


def regex_of(glob: str) -> str:
    """A glob over relative paths as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}(?:/.*)?$"


def safe_relative(path: str) -> bool:
    """Whether a path stays below its root: relative and without ``..``."""
    return bool(path) and not path.startswith(("/", "\\")) and not re.match(r"[A-Za-z]:", path) and ".." not in re.split(r"[/\\]", path)


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED, only: list[str] | None = None) -> DataFrame:
    """``(filename, content, mtime)`` below ``root``, of files ``only`` if
    given.  Names are filtered before any content is read or decoded."""
    base = root.rstrip("/")
    paths = base if only is None else [f"{base}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", name) for name in only]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    name = F.substring(bare, F.lit(len(re.sub("^[a-z0-9]+:/*", "/", base)) + 2), F.length(bare))
    found = raw.select(name.alias("filename"), "content", F.col("modificationTime").alias("mtime"))
    found = found.filter(F.lower(F.regexp_extract("filename", r"\.([^./]+)$", 1)).isin(*extensions))
    globs = [regex_of(g) for g in map(glob_of, ignored) if g]
    if globs:
        found = found.filter(~F.col("filename").rlike("|".join(globs)))
    return found.withColumn("content", F.col("content").cast("string"))


def ignore_lines(spark: SparkSession, root: str, name: str = IGNORE_FILE) -> tuple[str, ...]:
    """The lines of the root's ignore file, none without one.  It is small and
    hidden, so it is read as a stream, from any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    stream = fs.open(path)
    try:
        return tuple(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines())
    finally:
        stream.close()


def modified(files: DataFrame, since: datetime | None) -> DataFrame:
    """Files that changed after a naive UTC time; all without one.  A file of
    unknown time counts as changed."""
    return files if since is None else files.filter(F.col("mtime").isNull() | (F.col("mtime") > F.lit(since)))
