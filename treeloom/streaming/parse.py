"""Parse requests as streams and batches: stateless maps that never fail a job.

A request line is JSON with ``content`` and, if it is not plain text, its
``encoding``.  Each task runs its parser - a Python callable, or a process that
answers one JSON line per request - over its rows; a bad request or a broken
parser makes an answer with an error, and the next request goes on.
"""

from __future__ import annotations

import json
import select
import subprocess
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tree as T
from ..plans.pipeline import ANNOTATED, DEFAULT, NATIVE, Driver, join_errors
from ..sources.codecs import decode_bytes, dump_json, legacy

CLOSE_TIMEOUT = 5.0


class NativeProcess:
    """A parser process: one request in flight; restarted once it has died, killed if it won't end."""

    def __init__(self, command: Sequence[str], timeout: float | None = None):
        self.command, self.timeout, self.process = list(command), timeout, None

    def start(self) -> None:
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __call__(self, code: str) -> dict:
        if self.process is None or self.process.poll() is not None:
            self.start()
        try:
            self.process.stdin.write(json.dumps({"content": code}).encode() + b"\n")
            self.process.stdin.flush()
            ready, _, _ = select.select([self.process.stdout], [], [], self.timeout)
            if not ready:
                self.process.kill()  # its late answer must not meet the next request
                self.process.wait()
                raise TimeoutError("the parser took too long")
            line = self.process.stdout.readline()
        except BrokenPipeError:
            line = b""
        if not line:
            self.process.wait()
            self.start()
            raise RuntimeError("the parser died")
        try:
            return json.loads(line)
        except ValueError:
            raise RuntimeError("malformed answer") from None

    def close(self) -> None:
        if self.process is None:
            return
        self.process.stdin.close()
        try:
            self.process.wait(CLOSE_TIMEOUT)
        except subprocess.TimeoutExpired:
            self.process.kill()
            self.process.wait()
        self.process = None


def answer(driver: Driver, line: str, mode: int = DEFAULT) -> dict:
    """The answer to one request line."""
    try:
        request = json.loads(line)
        content = decode_bytes(request["content"], request.get("encoding", "utf8")).decode()
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return {"language": driver.language, "ast": None, "status": "fatal", "errors": [f"bad request: {e}"]}
    if not driver.accepts(request.get("language", "")):
        return {"language": driver.language, "ast": None, "status": "fatal", "errors": [f"unsupported language {request['language']}"]}
    return driver.parse(content, mode)


def serve(driver: Driver, lines: Iterator[str], mode: int = DEFAULT) -> Iterator[str]:
    """The request loop of a single process: one JSON line in, one out."""
    for line in lines:
        own = answer(driver, line, mode)
        yield json.dumps(own | {"ast": T.native(own["ast"])}, ensure_ascii=False)


V1 = "request string, status string, errors array<string>, elapsed bigint, language string, filename string, uast string, ast string"


def answer_v1(driver: Driver, line: str, native: bool = False) -> dict:
    """The answer of the first protocol version to a request line {content, language, filename}.

    ``uast`` is the annotated tree as flat nodes, ``ast`` the native one as JSON; of a request
    that fails neither is there, and the errors are one text.  The language must be the driver's, by name or alias.
    ``elapsed`` is the time of the call in nanoseconds.
    """
    start = time.perf_counter_ns()
    own: dict[str, Any] = {"request": line, "status": "fatal", "errors": [], "language": None, "filename": None, "uast": None, "ast": None}
    try:
        request = json.loads(line)
        language = request.get("language") or ""
        if not language or not driver.accepts(language):
            raise ValueError(f"unsupported language: {language!r}")
        made = driver.parse(request["content"], NATIVE if native else ANNOTATED)
        if made["status"] != "ok":
            own["errors"] = [join_errors(made["errors"])]
        else:
            tree = {"ast": dump_json(made["ast"])} if native else {"uast": json.dumps(legacy(made["ast"]), ensure_ascii=False, sort_keys=True)}
            own |= {"status": "ok", "language": language, "filename": request.get("filename"), **tree}
    except Exception as e:  # noqa: BLE001 - whatever is wrong with a request is its answer
        own["errors"] = [str(e)]
    return own | {"elapsed": time.perf_counter_ns() - start}


def parse_v1(requests: DataFrame, make: Callable[[], Driver], native: bool = False, column: str = "value") -> DataFrame:
    """``answer_v1`` over a batch or a stream of request lines."""
    kinds = pa.schema([("request", pa.string()), ("status", pa.string()), ("errors", pa.list_(pa.string())), ("elapsed", pa.int64()), *((k, pa.string()) for k in ("language", "filename", "uast", "ast"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        driver = make()
        try:
            for b in batches:
                yield pa.RecordBatch.from_pylist([answer_v1(driver, line or "", native) for line in b.column(0).to_pylist()], kinds)
        finally:
            if hasattr(driver.parser, "close"):
                driver.parser.close()

    return requests.select(F.col(column)).mapInArrow(run, V1)


_OUT = "request string, language string, status string, doc string, error string"


def parse(requests: DataFrame, make: Callable[[], Driver], mode: int = DEFAULT, column: str = "value") -> DataFrame:
    """Answers to a batch or a stream of request lines; ``make`` builds the driver in each task.

    The map keeps no state, so a stream needs no watermark and restarts from its
    sources' offsets alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        driver = make()
        try:
            for b in batches:
                rows: list[dict[str, Any]] = []
                for line in b.column(0).to_pylist():
                    own = answer(driver, line or "", mode)
                    rows.append({"request": line, "language": own["language"], "status": own["status"], "doc": None if own["ast"] is None else dump_json(own["ast"]), "error": join_errors(own["errors"]) or None})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.string()) for k in ("request", "language", "status", "doc", "error")]))
        finally:
            if hasattr(driver.parser, "close"):
                driver.parser.close()

    return requests.select(F.col(column)).mapInArrow(run, _OUT)
