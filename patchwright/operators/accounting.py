"""What tasks have used: CPU, run and collection time, rows and bytes, summed by a listener of the application.

Spark's own record of stages is bounded (`spark.ui.retainedStages`), so a sum over it falls when stages are evicted. The
listener adds each stage's task metrics when the stage ends, failed attempts included, and keeps totals only. It has
a queue of its own on the listener bus, which is drained before totals are read. Tasks of stages that are still
running are not in yet; tasks that end after their stage (speculative copies) are not counted.

Energy is an estimate by a stated formula: kWh = core-seconds x watts per core x facility factor / 3,600,000;
grams of CO2e = kWh x grams per kWh. The constants are assumptions and parameters.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from py4j.java_gateway import JavaObject
from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Assumptions: 120 W of a package over 8 cores, no overhead of the building, 400 g of CO2e a kWh.
WATTS_PER_CORE, FACILITY, GRAMS_PER_KWH = 15.0, 1.0, 400.0


@dataclass(frozen=True)
class Usage:
    """Totals of ended stages."""

    stages: int = 0
    tasks: int = 0
    failed_stages: int = 0
    cpu_seconds: float = 0.0
    run_seconds: float = 0.0
    gc_seconds: float = 0.0
    rows_read: int = 0
    bytes_read: int = 0
    bytes_shuffled: int = 0
    bytes_spilled: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(Usage)))

    def __sub__(self, other: Usage) -> Usage:
        return Usage(*(getattr(self, f.name) - getattr(other, f.name) for f in fields(Usage)))

    def energy_kwh(self, watts: float = WATTS_PER_CORE, facility: float = FACILITY) -> float:
        return self.cpu_seconds * watts * facility / 3_600_000

    def co2e_grams(self, grams: float = GRAMS_PER_KWH, **assumed: float) -> float:
        return self.energy_kwh(**assumed) * grams


class _Listener:
    """Called by the listener bus. All events but the end of a stage pass."""

    def __init__(self) -> None:
        self.lock, self.total = threading.Lock(), Usage()

    def onStageCompleted(self, event: JavaObject) -> None:  # noqa: N802  (the name is Spark's)
        info = event.stageInfo()
        m = info.taskMetrics()
        if m is None:
            return
        own = Usage(
            1,
            info.numTasks(),
            int(info.failureReason().isDefined()),
            m.executorCpuTime() / 1e9,
            m.executorRunTime() / 1e3,
            m.jvmGCTime() / 1e3,
            m.inputMetrics().recordsRead(),
            m.inputMetrics().bytesRead(),
            m.shuffleWriteMetrics().bytesWritten(),
            m.diskBytesSpilled(),
        )
        with self.lock:
            self.total += own

    def __getattr__(self, name: str):
        if name.startswith("on"):
            return lambda *_: None
        raise AttributeError(name)

    class Java:
        implements = ["org.apache.spark.scheduler.SparkListenerInterface"]


_listeners: dict[str, _Listener] = {}
_registering = threading.Lock()


def _listener(spark: SparkSession) -> _Listener:
    """The application's listener; the first call adds it, so totals start there."""
    sc = spark.sparkContext
    with _registering:
        if sc.applicationId not in _listeners:
            ensure_callback_server_started(sc._gateway)
            _listeners[sc.applicationId] = own = _Listener()
            sc._jsc.sc().listenerBus().addToQueue(own, "patchwright")
        return _listeners[sc.applicationId]


def usage(spark: SparkSession) -> Usage:
    """Totals of this application's stages since the first call. They never fall."""
    own = _listener(spark)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    with own.lock:
        return own.total


@dataclass
class Measured:
    """What a block has used; filled when it ends. Stages of other threads in that time are in it."""

    used: Usage = Usage()
    wall_seconds: float = 0.0


@contextmanager
def measured(spark: SparkSession) -> Iterator[Measured]:
    out, before, began = Measured(), usage(spark), time.time()
    try:
        yield out
    finally:
        out.used, out.wall_seconds = usage(spark) - before, time.time() - began


def per_cpu_hour(value: Column, cpu_seconds: Column) -> Column:
    """A quality figure by CPU hours; null without CPU time."""
    return value * 3600.0 / F.nullif(cpu_seconds.cast("double"), F.lit(0.0))
