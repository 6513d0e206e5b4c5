"""Cutting lineage in iterative jobs.

A step is written as a parquet table in the shared checkpoint folder and read
back.  Unlike ``checkpoint()`` this runs the plan once, and the table it
leaves behind carries size statistics, so Spark can pick join strategies for
the next round.  The table outlives any executor.
"""

import os
import uuid

_MARKED = set()


def shared_folder(spark):
    """The folder of ``spark.checkpoint.dir``; in local mode, if unset, one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_steps")


def steps_folder(spark):
    """The application's own part of the shared folder; it goes when the application ends."""
    top = os.path.join(shared_folder(spark), spark.sparkContext.applicationId)
    if top not in _MARKED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _MARKED.add(top)
    return top


def clear_steps(spark):
    """Remove the steps of this application; frames built on them are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(steps_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df):
    """Materialise ``df`` in the shared folder and read it back."""
    spark = df.sparkSession
    path = os.path.join(steps_folder(spark), "step-" + uuid.uuid4().hex)
    df.write.parquet(path)
    step = spark.read.schema(df.schema).parquet(path)
    step._step = path
    return step


def drop(*steps):
    """Remove the tables of frames made by ``cut``, once nothing reads them or frames built on them; others stay."""
    for step in steps:
        if "_step" in vars(step):
            context = step.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(step._step)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
