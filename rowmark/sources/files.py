"""Small file-system steps through Hadoop, so that any storage Spark reads works."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def is_directory(spark: SparkSession, path: str) -> bool:
    return exists(spark, path) and _system(spark, path).getFileStatus(_path(spark, path)).isDirectory()


def glob(spark: SparkSession, pattern: str) -> list[str]:
    found = _system(spark, pattern).globStatus(_path(spark, pattern)) or []
    return sorted(status.getPath().toString() for status in found)


def child_names(spark: SparkSession, path: str) -> list[str]:
    return sorted(s.getPath().getName() for s in _system(spark, path).listStatus(_path(spark, path)))


def make_directory(spark: SparkSession, path: str) -> None:
    _system(spark, path).mkdirs(_path(spark, path))


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it exists; of several writers one succeeds."""
    system = _system(spark, path)
    try:
        system.create(_path(spark, path), False).close()
    except Py4JJavaError:
        if system.exists(_path(spark, path)):
            return False
        raise
    return True


def rename(spark: SparkSession, old: str, new: str) -> bool:
    return _system(spark, old).rename(_path(spark, old), _path(spark, new))


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def read_small_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def write_small_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a small file in one step: readers see the old file or the new one, whole.

    With `replace` off an existing file stays; of several writers one succeeds.
    """
    temporary = f"{path}.{uuid.uuid4().hex}.writing"
    stream = _system(spark, path).create(_path(spark, temporary), True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    try:
        _rename_whole(spark, temporary, path, replace)
    except Py4JJavaError as error:
        if replace or "AlreadyExists" not in str(error.java_exception.toString()):
            raise
        delete(spark, temporary)
        return False
    return True


def _rename_whole(spark: SparkSession, old: str, new: str, replace: bool) -> None:
    """Rename a file onto another name, atomically where the storage can do so."""
    jvm = spark._jvm
    choice = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(choice, 1)
    options[0] = choice.OVERWRITE if replace else choice.NONE
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, new).toUri(), conf)
    except Py4JJavaError:  # a storage that knows plain renames only
        if replace and exists(spark, new):
            delete(spark, new)
        if not rename(spark, old, new):
            raise
        return
    context.rename(_path(spark, old), _path(spark, new), options)
