"""S3-S6 over whole folder trees: every name is read, and executors do the listing.

Spark's file sources list on the driver, which then holds every file and plans a task for every few of them, and pass over
names that start with ``_`` or ``.``. Here the folders of each level are listed by tasks (:func:`list_notes`; one small job
per level, the result checkpointed in the shared folder), and the files found are read by tasks, as many as
``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes`` ask for, within a bound (:func:`read_listed`): the driver
holds nothing per file. Python only moves bytes, through Arrow's file systems (local and mounted paths, ``hdfs``, ``s3``,
``gs``); decoding and everything after it are Spark expressions.

Defined cases: a folder without notes gives no rows; an empty file is a row with an empty text; a link to a folder is not
followed unless asked for, one to a file is read; a folder that goes away while it is listed counts as empty; a file that
cannot be read has no content but an ``error``. One folder is listed by one task, and one note must fit into one row.
:func:`spark_listed` gives the files that Spark's readers find, by the same jobs.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.session import shared_dir

LISTED = "root string, inner string, is_folder boolean, size long, hidden boolean, passed boolean"
READ = "root string, inner string, uri string, content binary, error string"
SLICE = 4096  # listed names per Arrow batch
BATCH_BYTES = 16 << 20  # bytes of notes per Arrow batch, but for one larger note
FILES_PER_TASK = 4096  # of small files; as many tasks more than this and the bytes ask for are left out
TASKS_PER_CORE = 16


def _roots(spark: SparkSession, path: str | list[str]) -> list[tuple]:
    """One row for each file or folder that ``path`` names (glob patterns as in Spark's readers)."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for top in [path] if isinstance(path, str) else path:
        pattern = jvm.org.apache.hadoop.fs.Path(top)
        found = list(pattern.getFileSystem(conf).globStatus(pattern) or [])
        if not found:
            raise FileNotFoundError(f"path does not exist: {top}")
        for status in found:
            uri = status.getPath().toString()
            uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
            is_folder = bool(status.isDirectory())
            passed = not is_folder and _passing()(status.getPath().getName(), False)
            rows.append((uri, "", is_folder, int(status.getLen()), False, passed))
    return rows


def roots(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files and folders that ``path`` names, as the ``root`` of what lies in them."""
    return [root for root, *_ in _roots(spark, path)]


def _passing():
    """Whether Spark's readers pass over a file or folder for its name. A closure, so that workers need not have this package."""

    def passed_over(name, is_folder):
        if is_folder and name.startswith(("_metadata", "_common_metadata")):
            return False
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    return passed_over


def _lister(like_spark: bool, hidden: bool):
    """Folders -> what lies in them, one level. A closure, as above."""
    passed_over = _passing()

    def in_local(folder):  # one by one: a folder of any size takes little memory
        import os
        import stat

        try:
            entries = os.scandir(folder)
        except FileNotFoundError:
            return
        with entries:
            for entry in entries:
                try:
                    status = entry.stat()  # of what a link leads to
                    if like_spark:
                        entry.name.encode()
                except FileNotFoundError:
                    continue
                except (OSError, UnicodeEncodeError):
                    if like_spark or entry.is_symlink():  # for Java's file classes there is no such file
                        continue
                    raise
                is_folder = stat.S_ISDIR(status.st_mode)
                if is_folder and not like_spark and entry.is_symlink():
                    continue
                if is_folder or stat.S_ISREG(status.st_mode):
                    yield entry.name, is_folder, status.st_size

    def in_store(fs, folder):
        from pyarrow.fs import FileSelector, FileType

        for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
            if info.type in (FileType.Directory, FileType.File):
                yield info.base_name, info.type == FileType.Directory, info.size or 0

    def list_folders(batches):
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow.fs import FileSystem, LocalFileSystem

        systems = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                root, above = row["root"], row["inner"]
                if root not in systems:
                    systems[root] = FileSystem.from_uri(quote(root, safe="/:@"))
                fs, top = systems[root]
                folder = f"{top.rstrip('/')}/{above}".rstrip("/") or "/"
                for name, is_folder, size in in_local(folder) if isinstance(fs, LocalFileSystem) else in_store(fs, folder):
                    found = {
                        "root": root,
                        "inner": f"{above}/{name}".lstrip("/"),
                        "is_folder": is_folder,
                        "size": size,
                        "hidden": row["hidden"] or name[0] in "_.",
                        "passed": row["passed"] or passed_over(name, is_folder),
                    }
                    if found["passed"] and not hidden:
                        continue
                    rows.append(found)
                    if len(rows) == SLICE:
                        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return list_folders


def _reader(skip_unreadable: bool):
    """Listed notes -> their bytes, or why they could not be read. A closure, as above."""

    def read(batches):
        import re
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        schema = pa.schema([("root", pa.string()), ("inner", pa.string()), ("uri", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        # what Java's URIs encode
        unsafe = re.compile("[^A-Za-z0-9_!.~'()*:@&=+$,;/\x80-\U0010ffff-]|[\x80-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        systems = {}
        for batch in batches:
            rows, held = [], 0
            for root, inner in zip(batch["root"].to_pylist(), batch["inner"].to_pylist()):
                content, error = None, None
                try:
                    if root not in systems:
                        systems[root] = FileSystem.from_uri(quote(root, safe="/:@"))
                    fs, top = systems[root]
                    with fs.open_input_stream(f"{top.rstrip('/')}/{inner}".rstrip("/"), compression=None) as source:
                        content = source.read()
                except OSError as failure:
                    if not skip_unreadable:
                        raise
                    error = str(failure)
                uri = unsafe.sub(lambda c: quote(c[0]), f"{root.rstrip('/')}/{inner}" if inner else root)
                uri = "file:" + uri[7:] if uri.startswith("file://") else uri
                rows.append({"root": root, "inner": inner, "uri": uri, "content": content, "error": error})
                held += len(content or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def path_column() -> Column:
    """The path of a listed note."""
    return F.when(F.col("inner") == "", F.col("root")).otherwise(F.concat_ws("/", F.rtrim("root", F.lit("/")), "inner"))


def list_notes(
    spark: SparkSession,
    path: str | list[str],
    extensions: tuple[str, ...] = rules.NOTE_EXTENSIONS,
    like_spark: bool = False,
    hidden: bool = True,
) -> DataFrame:
    """Every note file under ``path``: ``root``, ``inner`` (its path below the root, empty if it is the root), ``size``,
    ``hidden`` (its name, or that of a folder between it and the root, starts with ``_`` or ``.``) and ``passed`` (Spark's
    readers pass over one of these names).

    ``like_spark`` follows links to folders and leaves out what Java's file classes do not see; without ``hidden`` no folder
    that Spark's readers pass over is opened.
    """
    shared_dir(spark)
    level = spark.createDataFrame(_roots(spark, path), LISTED)
    notes = level.where(~F.col("is_folder"))
    width = 4 * spark.sparkContext.defaultParallelism
    while folders := level.where("is_folder").count():
        below = level.where("is_folder").repartition(min(folders, width)).mapInArrow(_lister(like_spark, hidden), LISTED)
        level = below.checkpoint(eager=True)
        notes = notes.unionAll(level.where(~F.col("is_folder")))
    is_note = F.lit(False)
    for extension in extensions:
        is_note = is_note | path_column().endswith(extension)
    return notes.where(is_note).drop("is_folder")


def spark_listed(spark: SparkSession, path: str | list[str], hidden: bool = True) -> DataFrame | None:
    """:func:`list_notes` as Spark's reader lists: the notes that it finds are those not ``passed`` that are not empty.

    None where only Spark's own listing will do: no such path, one that Arrow does not open or that a file sink keeps its
    log in, or no shared folder.
    """
    try:
        shared_dir(spark)
        tops = roots(spark, path)
    except (FileNotFoundError, ValueError):
        return None
    if not tops:
        return None
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{tops[0].rstrip('/')}/_spark_metadata")
    if not all(map(_opens, tops)) or log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
        return None
    return list_notes(spark, path, like_spark=True, hidden=hidden)


def _opens(root: str) -> bool:
    try:
        from pyarrow.fs import FileSystem

        FileSystem.from_uri(quote(root, safe="/:@"))
    except (ImportError, ValueError, NotImplementedError, OSError):  # Arrow's own errors are of these kinds
        return False
    return True


def reading_tasks(spark: SparkSession, files: int, size: int) -> int:
    """Tasks for so many files of so many bytes: as Spark's readers plan them, but that the cost of opening a file does not
    ask for more than one task for ``FILES_PER_TASK`` files, or ``TASKS_PER_CORE``; Spark has one for each 32 small files."""
    per_file, most = (_bytes(spark, f"spark.sql.files.{name}") for name in ("openCostInBytes", "maxPartitionBytes"))
    cores = spark.sparkContext.defaultParallelism
    weight = size + files * per_file
    planned = -(-weight // min(most, max(per_file, weight // cores, 1)))
    return max(1, min(files, planned, max(-(-size // most), -(-files // FILES_PER_TASK), TASKS_PER_CORE * cores)))


def deal_names(listed: DataFrame, tasks: int) -> DataFrame:
    return listed.select("root", "inner").repartition(tasks)


def read_names(names: DataFrame, skip_unreadable: bool = True) -> DataFrame:
    """The notes named by ``root`` and ``inner``, batch or stream, with their bytes (:func:`read_listed`)."""
    return names.mapInArrow(_reader(skip_unreadable), READ)


def read_listed(listed: DataFrame, skip_unreadable: bool = True) -> DataFrame:
    """The listed notes with their bytes: ``root``, ``inner``, ``uri`` (as Spark tells their path), ``content``, ``error``
    (null where the note was read). Their names are dealt out first, into the shared folder: what reads them has no shuffle."""
    files, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    names = deal_names(listed, reading_tasks(listed.sparkSession, files, size)).checkpoint(eager=True)
    return read_names(names, skip_unreadable)


def _bytes(spark: SparkSession, setting: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)))


def note_rows(read: DataFrame, encoded: bool = False) -> DataFrame:
    """``file_path`` (``encoded``: as Spark's readers tell it, a URI), ``file_name``, ``text`` of the notes that were read;
    bytes that are not UTF-8 are dropped."""
    path = path_column()
    return read.where(F.col("error").isNull()).select(
        (F.col("uri") if encoded else path).alias("file_path"),
        F.substring_index(path, "/", -1).alias("file_name"),
        T.clean_utf8(F.col("content").cast("string")).alias("text"),
    )


def unreadable_notes(spark: SparkSession, path: str | list[str], hidden: bool = True) -> DataFrame:
    """``file_path`` and ``error`` of the notes that cannot be read, by reading all of them again."""
    listed = list_notes(spark, path)
    read = read_listed(listed if hidden else listed.where("not hidden"))
    return read.where(F.col("error").isNotNull()).select(path_column().alias("file_path"), "error")
