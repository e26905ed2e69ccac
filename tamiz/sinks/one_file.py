"""Many part files put together as one, each by a task of its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CHUNK = 1 << 22


def join_files(spark: SparkSession, folders: list[str], path: str) -> None:
    """The part files of ``folders`` one after another as the file ``path``; the parts are deleted.

    Folders come in their order, a folder's files in that of their names; one that isn't there is empty. In a mounted
    folder every part is copied to its place in the file by a task of its own, so neither a
    task nor the driver sees the whole. Other stores must be able to put files together
    themselves (``concat``, as HDFS does).
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    system = target.getFileSystem(conf)
    places = [hadoop.Path(f) for f in folders]
    listed = [sorted(system.listStatus(p), key=lambda s: s.getPath().getName()) for p in places if system.exists(p)]
    found = [s for some in listed for s in some if s.getPath().getName().startswith("part-") and s.getLen()]
    if system.getScheme() == "file":
        _copy(spark, [(s.getPath().toUri().getPath(), s.getLen()) for s in found], target.toUri().getPath())
    else:
        system.create(target).close()
        array = spark.sparkContext._gateway.new_array(hadoop.Path, len(found))
        for n, status in enumerate(found):
            array[n] = status.getPath()
        system.concat(target, array)
    for place in places:
        system.delete(place, True)


def _copy(spark: SparkSession, parts: list[tuple[str, int]], path: str) -> None:
    """Every part to its place; a task that runs again writes the same bytes there."""
    places, end = [], 0
    for part, size in parts:
        places.append((part, end, size))
        end += size

    def copy(batches):
        for batch in batches:
            for n in batch["id"]:
                part, start, size = places[n]
                with open(part, "rb") as source, os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as out:
                    out.seek(start)
                    left = size
                    while left:
                        data = source.read(min(CHUNK, left))
                        if not data:
                            raise EOFError(f"{part} is shorter than it was")
                        out.write(data)
                        left -= len(data)
            yield batch

    os.makedirs(os.path.dirname(path), exist_ok=True)
    os.close(os.open(path, os.O_WRONLY | os.O_CREAT, 0o644))
    if places:
        tasks = spark.range(0, len(places), 1, len(places))
        tasks.mapInPandas(copy, "id bigint").write.format("noop").mode("overwrite").save()
