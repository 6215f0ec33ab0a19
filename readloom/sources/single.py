"""One file under one name, as other programs expect it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.scratch import scratch_path


def write_text_file(lines: DataFrame, path: str, header: str | None = None) -> None:
    """The column value of lines, in their order, as one text file.

    Tasks write parts in the shared folder; the driver joins them through
    Spark's own file systems, a few MB at a time, whatever their size.
    """
    spark = lines.sparkSession
    parts = scratch_path(spark)
    lines.select("value").write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(parts)
    files = at.getFileSystem(conf)
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        if header is not None:
            out.write(bytearray((header + "\n").encode("utf-8")))
        for name in sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("part-")):
            part = files.open(jvm.org.apache.hadoop.fs.Path(at, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 22, False)
            finally:
                part.close()
    finally:
        out.close()
    files.delete(at, True)
