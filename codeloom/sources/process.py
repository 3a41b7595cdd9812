"""Deltas from external parser processes, one child for each task.

A parser reads one JSON request a line and writes one JSON answer a line, or, started
once for each request, reads one request and writes one answer. Requests are rows, so
Spark deals them over tasks; answers are rows again and are parsed by from_json. A
request that fails gives a diagnostic row, not a failed job.
"""

from __future__ import annotations

import json
import os
import select
import shlex
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TIMEOUT = 60
ANSWER = "request string, answer string, code string, message string"


@dataclass(frozen=True)
class Config:
    """command: as typed in a shell (quotes and backslashes understood)."""

    command: str
    languages: tuple[str, ...] = ()
    timeout: int = DEFAULT_TIMEOUT
    streaming: bool = False

    @property
    def arguments(self) -> list[str]:
        return shlex.split(self.command)

    @property
    def streams(self) -> bool:
        return self.streaming or "--stdio-stream" in self.arguments

    @classmethod
    def from_conf(cls, spark, prefix: str = "spark.codeloom.parser") -> Config:
        """From session settings, else environment variables of the same name in capitals."""
        def get(key: str, default: str) -> str:
            return spark.conf.get(f"{prefix}.{key}", None) or os.environ.get(f"{prefix}.{key}".upper().replace(".", "_"), default)

        languages = tuple(x.strip().lower() for x in get("languages", "").split(",") if x.strip())
        return cls(get("command", ""), languages, max(1, int(get("timeout", str(DEFAULT_TIMEOUT)))), get("streaming", "false").lower() == "true")


class Registry:
    """Parser configurations by language, case-insensitive; the first one registered wins."""

    def __init__(self, configs: list[Config] = ()):
        self.by: dict[str, Config] = {}
        for c in configs:
            for language in c.languages:
                self.by.setdefault(language.lower(), c)

    def find(self, language: str) -> Config | None:
        return self.by.get((language or "").lower())

    def languages(self) -> list[str]:
        return sorted(self.by)


def _once(config: Config, request: str) -> tuple[str | None, str | None, str | None]:
    try:
        done = subprocess.run(config.arguments, input=request, capture_output=True, text=True, timeout=config.timeout)
    except OSError as e:
        return None, "process.start", str(e)
    except subprocess.TimeoutExpired:
        return None, "process.timeout", f"no answer in {config.timeout} s"
    if done.returncode:
        return None, "process.exit", f"exit code {done.returncode}: {done.stderr.strip()[-2000:]}"
    return _checked(done.stdout)


def _checked(text: str) -> tuple[str | None, str | None, str | None]:
    try:
        if isinstance(json.loads(text), dict):
            return text, None, None
    except ValueError:
        pass
    return None, "process.protocol", f"the answer is no JSON object: {text[:200]!r}"


class _Session:
    """A child that answers line by line; it is started anew after a failure."""

    def __init__(self, config: Config):
        self.config, self.child, self.rest = config, None, b""

    def ask(self, request: str) -> tuple[str | None, str | None, str | None]:
        try:
            if self.child is None or self.child.poll() is not None:
                self.child, self.rest = subprocess.Popen(self.config.arguments, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL), b""
            self.child.stdin.write(request.replace("\n", " ").encode() + b"\n")
            self.child.stdin.flush()
        except OSError as e:
            self.close()
            return None, "process.start", str(e)
        end = time.monotonic() + self.config.timeout
        while b"\n" not in self.rest:
            ready = select.select([self.child.stdout], [], [], max(0.0, end - time.monotonic()))[0]
            data = os.read(self.child.stdout.fileno(), 1 << 16) if ready else b""
            if not data:
                code = self.child.poll() if ready else None
                self.close()
                return (None, "process.exit", f"exit code {code}") if ready else (None, "process.timeout", f"no answer in {self.config.timeout} s")
            self.rest += data
        line, _, self.rest = self.rest.partition(b"\n")
        return _checked(line.decode())

    def close(self) -> None:
        if self.child:
            self.child.kill()
            self.child.wait(min(self.config.timeout, 5))
            self.child = None


def answers(requests: DataFrame, config: Config, column: str = "request") -> DataFrame:
    """(request, answer, code, message) of each request: a JSON delta, or what went wrong."""

    def run(batches: Iterator) -> Iterator:
        session = _Session(config) if config.streams else None
        try:
            for rows in batches:
                got = [session.ask(r) if session else _once(config, r) for r in rows["request"]]
                yield rows.assign(answer=[g[0] for g in got], code=[g[1] for g in got], message=[g[2] for g in got])
        finally:
            if session:
                session.close()

    return requests.select(F.col(column).alias("request")).mapInPandas(run, ANSWER)


def deltas(found: DataFrame) -> DataFrame:
    """Answers that are deltas, with their scope filled in; blank projects take the request's."""
    from codeloom.sources.delta_json import _RAW, with_scope

    parsed = found.filter("answer is not null").select(F.get_json_object("request", "$.projectName").alias("_p"), F.from_json("answer", _RAW).alias("d"), F.col("request").alias("delta_id"))
    rows = parsed.select("delta_id", "d.*", "_p").withColumn("projectName", F.coalesce("_p", "projectName")).drop("_p")
    return with_scope(rows)
