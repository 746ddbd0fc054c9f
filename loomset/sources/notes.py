"""A folder tree of note files, one row per file.

``pathGlobFilter`` applies the extension filter to the listing, so other files
are never opened (S4); ``recursiveFileLookup`` walks every depth; unreadable
files are skipped (S6) and counted in the run summary; invalid UTF-8 bytes are
dropped (S5). Spark's listing is the driver's, which holds every file, so the
same files are listed and read by tasks (:mod:`loomset.sources.note_tree`);
Spark's reader is left for paths that Arrow's file systems do not open. Names
that start with ``_`` or ``.`` are passed over by Spark: notes of such names
make the read fail, unless they are to be skipped, or read with all others. A
note is read whole, one file per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.sources import note_tree


def extension_glob(extensions: tuple[str, ...] = rules.NOTE_EXTENSIONS) -> str:
    return "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"


def hidden_notes(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Note files that Spark's listing leaves out: their name, or that of a folder above them, starts with ``_`` or ``.``.

    Each folder is asked for such names alone, and looked through for folders only if it has any: the names of its
    notes stay in the JVM. Only folders found in this way are listed whole.
    """
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    unseen = jvm.org.apache.hadoop.fs.GlobFilter("{_,.}*")
    found: list[str] = []
    for top in [path] if isinstance(path, str) else path:
        root = jvm.org.apache.hadoop.fs.Path(top)
        fs = root.getFileSystem(conf)
        if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
            continue
        folders = [root]
        while folders:
            folder = folders.pop()
            for status in fs.listStatus(folder, unseen):
                if status.isDirectory():
                    below = fs.listFiles(status.getPath(), True)
                    while below.hasNext():
                        found.append(below.next().getPath().toString())
                else:
                    found.append(status.getPath().toString())
            if fs.getContentSummary(folder).getDirectoryCount() > 1:
                inner = (status.getPath() for status in fs.listStatus(folder) if status.isDirectory())
                folders += [p for p in inner if p.getName()[0] not in "_."]
    return sorted(f for f in found if f.endswith(rules.NOTE_EXTENSIONS))


def _check_mode(hidden: str) -> None:
    if hidden not in ("error", "skip"):
        raise ValueError(f"hidden must be 'error' or 'skip' (in batch also 'read'), got {hidden!r}")


def _refuse(number: int, names: list[str]) -> None:
    raise ValueError(
        f"{number} notes have names that start with '_' or '.', or lie in such a folder, and would not be read: "
        f"{', '.join(names)}. Rename them, or pass hidden='skip' to leave them out (in batch also 'read')."
    )


def refuse_hidden(spark: SparkSession, path: str | list[str], hidden: str = "error") -> None:
    """Fail if Spark would pass over notes for their names (``hidden="skip"``: let it)."""
    _check_mode(hidden)
    if hidden == "error" and (names := hidden_notes(spark, path)):
        _refuse(len(names), names[:5])


GLOB = set("{}[]?*\\")  # characters that make a path a pattern for Spark's readers


def listed_notes(spark: SparkSession, path: str | list[str], hidden: str = "error") -> DataFrame | None:
    """The notes that Spark's reader finds under ``path``, listed by tasks, each file once (:func:`note_tree.list_notes`);
    fails as :func:`refuse_hidden` does. None where only Spark's own listing will do (:func:`note_tree.spark_listed`)."""
    _check_mode(hidden)
    listed = note_tree.spark_listed(spark, path, hidden == "error")
    if listed is None:
        return None
    paths = [path] if isinstance(path, str) else path
    named = [p for p in paths if not GLOB & set(p)]  # patterns are not looked through
    if hidden == "error" and named:
        unseen = listed.where("hidden")
        if len(named) < len(paths):
            unseen = unseen.where(F.col("root").isin(note_tree.roots(spark, named)))
        if number := unseen.count():
            path_of = note_tree.path_column()
            _refuse(number, [r.path for r in unseen.select(path_of.alias("path")).orderBy("path").limit(5).collect()])
    found = listed.where("NOT passed AND size > 0")
    if len(paths) == 1 and named:
        return found
    return found.withColumn("path", note_tree.path_column()).dropDuplicates(["path"]).drop("path")


def note_options(reader, skip_unreadable: bool = True):
    """The options that batch and stream share."""
    return (
        reader.option("recursiveFileLookup", True)
        .option("pathGlobFilter", extension_glob())
        .option("ignoreCorruptFiles", skip_unreadable)
        .option("ignoreMissingFiles", skip_unreadable)
    )


def note_rows(raw: DataFrame) -> DataFrame:
    """``file_path`` as Spark tells it (an encoded URI), ``file_name`` as the file is called, ``text``."""
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file_name"),
        T.clean_utf8(F.col("value")).alias("text"),
    )


def read_notes(spark: SparkSession, path: str | list[str], skip_unreadable: bool = True, hidden: str = "error") -> DataFrame:
    """``file_path``, ``file_name``, ``text`` of every note file under ``path``.

    ``hidden`` says what becomes of names that start with ``_`` or ``.``, or lie in such a folder: ``"error"``, ``"skip"``
    or ``"read"``. Empty files are rows of the last form only (they give no sample in any).
    """
    if hidden == "read":
        return note_tree.note_rows(note_tree.read_listed(note_tree.list_notes(spark, path), skip_unreadable))
    if (listed := listed_notes(spark, path, hidden)) is not None:
        return note_tree.note_rows(note_tree.read_listed(listed, skip_unreadable), encoded=True)
    refuse_hidden(spark, path, hidden)
    return note_rows(note_options(spark.read, skip_unreadable).text(path, wholetext=True))


def count_note_files(spark: SparkSession, path: str | list[str], hidden: str = "error") -> int:
    """Note files in the listing (no file is opened), to set against the notes read."""
    if hidden == "read":
        return note_tree.list_notes(spark, path).count()
    if (found := listed_notes(spark, path, "skip")) is not None:
        return found.count()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", extension_glob())
    return listed.load(path).select("path").count()
