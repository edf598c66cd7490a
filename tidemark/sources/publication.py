"""Results of many tables that appear at once or not at all.

A job writes below a new run folder. Only when it has ended is a numbered commit record
created that names the run; creating a record that exists fails, so of two jobs that end
together one takes the next number. Readers follow the newest record and never see a run
that was cut off. Nothing is renamed, so object stores serve as well as file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..session import remove

RUNS, RECORDS = "runs", "_published"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def listed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders below ``path`` that were written to the end, ascending."""
    fs, _ = _file_system(spark, path)
    done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    return sorted(int(n) for n in _names(spark, path) if n.isdigit() and done(n))


def records(spark: SparkSession, target: str) -> dict[int, str]:
    """Run folders by the number of their commit record, ascending."""
    found = (n.split("-", 1) for n in _names(spark, f"{target}/{RECORDS}") if n[:1].isdigit())
    return {int(k): f"{target}/{RUNS}/{run}" for k, run in sorted(found)}


def publish(spark: SparkSession, target: str, job: Callable[[str], object]) -> str:
    """Run ``job`` on a new folder and publish it; returns the folder.

    If the job fails its folder stays unread until ``prune``, and the last published run
    stays the current one.
    """
    run = uuid.uuid4().hex
    folder = f"{target}/{RUNS}/{run}"
    job(folder)
    while True:
        number = _next_free(spark, target)
        # Creating the claim without overwriting decides between jobs that end together. One
        # whose job ended before its record is only a gap in the numbers.
        try:
            _create(spark, f"{target}/{RECORDS}/claim-{number:012d}")
        except Py4JJavaError:
            if _next_free(spark, target) == number:
                raise
            continue
        _create(spark, f"{target}/{RECORDS}/{number:012d}-{run}")
        return folder


def _create(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.create(target, False).close()


def _next_free(spark: SparkSession, target: str) -> int:
    claims = [n.removeprefix("claim-") for n in _names(spark, f"{target}/{RECORDS}") if n.startswith("claim-")]
    return max(map(int, claims), default=0) + 1


def current(spark: SparkSession, target: str) -> str:
    """Folder of the newest published run."""
    found = records(spark, target)
    if not found:
        raise FileNotFoundError(f"nothing is published below {target}")
    return found[max(found)]


def prune(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Delete all runs but the ``keep`` newest published ones. Call it when no job writes."""
    found = records(spark, target)
    kept = {found[k] for k in sorted(found)[-keep:]}
    for name in _names(spark, f"{target}/{RUNS}"):
        if f"{target}/{RUNS}/{name}" not in kept:
            remove(spark, f"{target}/{RUNS}/{name}")
