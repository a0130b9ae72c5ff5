"""Schemas of the tables that operators exchange, and the settings of a run.

Scorer results are a long table, one row per case and scorer; they are nested only at sinks.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field, fields, replace
from functools import cache

from pyspark.sql import SparkSession

ITEMS = "data_index bigint, input_item map<string,string>, extra map<string,string>"
API_RESULTS = "data_index bigint, result_item map<string,string>, start_time bigint, end_time bigint, time_cost bigint, success boolean"
SCORER_RESULTS = (
    "data_index bigint, scorer_pos int, metric string, score double, total_score double, score_rate double, threshold double, "
    "star boolean, pass boolean, success boolean, reason string, extra map<string,string>, start_time bigint, end_time bigint, time_cost bigint"
)
EVAL_RESULTS = "data_index bigint, score double, reason string, start_time bigint, end_time bigint, time_cost bigint, success boolean, pass boolean, threshold double, strategy string"
CHECK_ITEMS = (
    "data_index bigint, checker string, checker_star boolean, name string, score double, total_score double, weight double, "
    "star boolean, support boolean, executed boolean, check_method string, reason string"
)
LLM_CALLS = "data_index bigint, model string, in_tokens bigint, out_tokens bigint, success boolean"


@cache
def _local_scratch() -> str:
    path = tempfile.mkdtemp(prefix="scorelake-run-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, in spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_scratch()
    return f"{base}/scorelake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def jdbc_connection(spark: SparkSession, url: str, properties: dict[str, str]):
    """A connection of the driver's, with user, password and whatever else the properties say; driver names its class."""
    known = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        if k != "driver":
            known.setProperty(k, str(v))
    if "driver" in properties:
        made = spark._jvm.org.apache.spark.util.Utils.classForName(properties["driver"], True, False).getDeclaredConstructor(spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Class, 0))
        connection = made.newInstance(spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 0)).connect(url, known)
        if connection is not None:
            return connection
    return spark._jvm.java.sql.DriverManager.getConnection(url, known)


def environment_info() -> dict[str, str]:
    """Where a run takes place: host, address, process, user, system, Python, memory and processors; empty where unknown."""
    import getpass
    import platform
    import socket

    def known(f) -> str:
        try:
            return str(f())
        except (OSError, KeyError, ValueError, AttributeError):
            return ""

    return {
        "host": known(socket.gethostname), "address": known(lambda: socket.gethostbyname(socket.gethostname())), "pid": str(os.getpid()), "user": known(getpass.getuser), "directory": known(os.getcwd),
        "system": platform.system(), "release": platform.release(), "machine": platform.machine(), "python": platform.python_version(),
        "cpus": str(os.cpu_count() or ""), "memory": known(lambda: os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")),
    }


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; an environment variable or Spark setting wins where it is not empty and not zero."""

    task_name: str = "evaluation"
    offset: int = 0
    limit: int = -1
    thread_num: int = 1
    pass_score: float = 0.0
    strategy: str = "sum"
    batch_size: int = 10
    report_interval: int = 30
    receive_timeout: int = 10
    message_process_max_time: int = 60
    enable_resume: bool = True
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.task_name.strip():
            raise ValueError("task_name must not be blank")
        if self.thread_num < 1:
            raise ValueError("thread_num must be at least 1")
        if self.offset < 0 or self.batch_size < 1:
            raise ValueError("offset must not be negative, and batch_size must be at least 1")

    def overridden(self, spark: SparkSession | None = None, environment: dict | None = None) -> "RunConfig":
        """With values of SCORELAKE_<NAME> variables or scorelake.<name> settings in place of those given.

        A positive offset, a limit from 0 and a batch size over 1 count; other numbers must be positive.
        """
        environment = os.environ if environment is None else environment
        found = {}
        for f in fields(self):
            raw = environment.get(f"SCORELAKE_{f.name.upper()}") or (spark.conf.get(f"scorelake.{f.name}", "") if spark else "")
            if not raw or f.name == "settings":
                continue
            if f.type == "bool":
                found[f.name] = raw.strip().lower() == "true"
            elif f.type in ("int", "float"):
                value = (int if f.type == "int" else float)(raw)
                least = {"limit": 0, "batch_size": 2}.get(f.name)
                if value >= least if least is not None else value > 0:
                    found[f.name] = value
            else:
                found[f.name] = raw
        return replace(self, **found)
