"""Transform pipelines: stages, modes, and their runs over DataFrames of documents.

A pipeline has preprocessing stages, stages that see the source text, semantic
rules, annotation rules, and a namespace.  The mode says how far a tree goes.
Rules of any depth run document by document in Arrow batches; a document whose
rules fail keeps its partly rewritten tree and carries the errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.nodes import parse_json
from ..operators.rewrite import DefaultNamespace, Mappings, Transformers, multi_error
from ..sources.codecs import dump_json

# Modes are bits; 0 stands for the default.
NATIVE, PREPROCESSED, ANNOTATED, SEMANTIC = 1, 2, 4, 8
DEFAULT = SEMANTIC
_MODES = {"native": NATIVE, "annotated": ANNOTATED, "semantic": SEMANTIC}


def parse_mode(name: str) -> int:
    if name not in _MODES:
        raise ValueError(f"unsupported mode: {name!r}")
    return _MODES[name]


class JoinedErrors(Exception):
    """No error or several as one; the text has a line for each, line ends included."""

    def __init__(self, errors: list[Exception]):
        self.errors = list(errors)
        super().__init__("".join(f"{e}\n" for e in self.errors))


def join(errors: list[Exception]) -> Exception:
    """A single error as it is; no error or several as ``JoinedErrors``."""
    return errors[0] if len(errors) == 1 else JoinedErrors(errors)


def join_errors(errors: list[str]) -> str:
    """The text of ``join`` for errors that are texts."""
    return errors[0] if len(errors) == 1 else "".join(f"{e}\n" for e in errors)


def joined_errors(errors: Column) -> Column:
    """The same of an array column."""
    return F.when(F.size(errors) == 1, F.get(errors, F.lit(0))).otherwise(F.array_join(F.transform(errors, lambda e: F.concat(e, F.lit("\n"))), ""))


@dataclass
class Transforms:
    """``namespace``: for types without one.  ``code`` stages have ``on_code(text)``."""

    namespace: str = ""
    preprocess: list = field(default_factory=list)
    code: list = field(default_factory=list)
    normalize: list = field(default_factory=list)
    annotate: list = field(default_factory=list)

    def stages(self, mode: int, code: str | None = None) -> list:
        """What is done up to a mode, in order; stages that see the source need ``code``."""
        mode = mode or DEFAULT
        if mode > SEMANTIC:
            raise ValueError(f"unsupported mode: {mode}")
        if mode == NATIVE:
            return []
        out = [*Transformers(*self.preprocess), *((c.on_code(code) for c in self.code) if code is not None else ())]
        late = [*(self.normalize if mode >= SEMANTIC else ()), *(self.annotate if mode >= ANNOTATED else ())]
        if mode >= SEMANTIC and self.namespace:
            late.append(DefaultNamespace(self.namespace))
        return [*out, *Transformers(*late)]

    def run(self, mode: int, code: str, tree: Any) -> tuple[Any, list[Exception]]:
        """(tree, errors).  The first stage that fails ends the run."""
        for stage in self.stages(mode, code):
            tree, errors = stage.run(tree)
            if errors:
                return tree, errors
        return tree, []

    def do(self, mode: int, code: str, tree: Any) -> Any:
        out, errors = self.run(mode, code, tree)
        if errors:
            raise multi_error(errors)
        return out


def _mapped(trees: DataFrame, f: Callable[[Any, str], tuple[Any, list[Exception]]], code: str | None, doc: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for text, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if text is None:
                    out.append(None)
                    errors.append([])
                    continue
                try:
                    tree, bad = f(parse_json(text), source or "")
                    out.append(dump_json(tree))
                    errors.append([str(e) for e in bad])
                except Exception as e:  # noqa: BLE001 - whatever a document or a rule raises is that document's error
                    out.append(text)
                    errors.append([str(e) or type(e).__name__])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.list_(pa.string()))], ["doc_id", "doc", "errors"])

    source = F.col(code) if code else F.lit(None).cast("string")
    own = trees.select(F.col("doc_id").cast("bigint"), F.col(doc).alias("doc"), source.alias("code"))
    return own.mapInArrow(run, "doc_id bigint, doc string, errors array<string>")


def rewrite(trees: DataFrame, *stages: Any, doc: str = "doc") -> DataFrame:
    """(doc_id, doc, errors): stages or single rules applied to every document."""
    own = [s if hasattr(s, "run") else Mappings(s) for s in Transformers(*stages)]

    def f(tree: Any, _: str) -> tuple[Any, list[Exception]]:
        for s in own:
            tree, errors = s.run(tree)
            if errors:
                return tree, errors
        return tree, []

    return _mapped(trees, f, None, doc)


def matching(trees: DataFrame, selector: Any, doc: str = "doc") -> DataFrame:
    """(doc_id, matched): whether a selector holds for the root of each document; an error is no match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                try:
                    out.append(text is not None and selector.matches(parse_json(text)))
                except Exception:  # noqa: BLE001 - as above
                    out.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_())], ["doc_id", "matched"])

    return trees.select(F.col("doc_id").cast("bigint"), F.col(doc)).mapInArrow(run, "doc_id bigint, matched boolean")


def transform(trees: DataFrame, pipeline: Transforms, mode: int = DEFAULT, doc: str = "doc", code: str | None = None) -> DataFrame:
    """(doc_id, doc, errors): the pipeline up to a mode."""
    if mode > SEMANTIC:
        raise ValueError(f"unsupported mode: {mode}")
    return _mapped(trees, lambda tree, source: pipeline.run(mode, source, tree), code, doc)


@dataclass
class Driver:
    """A parser, a manifest and transforms as one service; none may be missing."""

    parser: Callable[[str], dict]
    manifest: dict
    transforms: Transforms

    def __post_init__(self):
        if self.parser is None or self.manifest is None or self.transforms is None:
            raise ValueError("a driver needs a parser, a manifest and transforms")

    @property
    def language(self) -> str:
        return self.manifest.get("language", "")

    def accepts(self, language: str) -> bool:
        """By name or alias; no language is any."""
        return not language or language in (self.language, *self.manifest.get("aliases", []))

    def parse(self, code: str, mode: int = DEFAULT) -> dict:
        """{ast, status, errors, language}: a syntax error keeps a partial tree, a failure has none."""
        own = {"language": self.language, "ast": None, "errors": []}
        try:
            answer = self.parser(code)
        except Exception as e:  # noqa: BLE001 - whatever a parser raises is its failure
            return own | {"status": "fatal", "errors": [str(e)]}
        status, errors = str(answer.get("status", "")).lower(), list(answer.get("errors") or [])
        if status == "fatal" or status not in ("ok", "error"):
            return own | {"status": "fatal", "errors": errors or [f"unexpected status {status}"]}
        tree, bad = self.transforms.run(mode, code, answer.get("ast"))
        if bad:
            return own | {"ast": tree, "status": "transform", "errors": [str(e) for e in bad]}
        return own | {"ast": tree, "status": "ok" if status == "ok" else "syntax", "errors": errors}
