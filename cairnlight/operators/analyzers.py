"""Analyzers: a small interface, a registry, and four that are built in."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, rag


class Phase(Enum):
    PRE_PROCESS = "PreProcess"
    POST_FILE_EXTRACT = "PostFileExtract"
    POST_PROJECT = "PostProject"
    PRE_FORMAT = "PreFormat"
    POST_FORMAT = "PostFormat"


class AnalyzerError(Exception):
    """An analyzer failed or can't be registered."""


@dataclass
class Context:
    phase: Phase
    elements: DataFrame
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Output:
    """Tables by name; values are long rows, so nothing overwrites anything."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    messages: list[str] = field(default_factory=list)


@dataclass
class Analyzer:
    name: str
    run: Callable[[Context, dict], Output]
    phases: tuple[Phase, ...] = (Phase.POST_PROJECT,)
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    """Runs analyzers in the order of registration, those they need first."""

    continue_on_error: bool = True
    analyzers: dict[str, Analyzer] = field(default_factory=dict)
    configs: dict[str, dict] = field(default_factory=dict)
    enabled: set[str] = field(default_factory=set)
    disabled: set[str] = field(default_factory=set)
    stats: dict[str, dict[str, float]] = field(default_factory=dict)

    def register(self, analyzer: Analyzer, config: dict | None = None) -> None:
        if analyzer.name in self.analyzers:
            raise AnalyzerError(f"{analyzer.name} is registered already")
        missing = [n for n in analyzer.needs if n not in self.analyzers]
        if missing:
            raise AnalyzerError(f"{analyzer.name} needs {', '.join(missing)}")
        self.analyzers[analyzer.name] = analyzer
        self.configs[analyzer.name] = config or {}

    def unregister(self, name: str) -> None:
        if self.analyzers.pop(name, None) is None:
            raise AnalyzerError(f"no analyzer {name}")

    def is_enabled(self, name: str) -> bool:
        """Disabled wins; without an enabled list all others run."""
        return name not in self.disabled and (not self.enabled or name in self.enabled)

    def active(self, phase: Phase) -> list[str]:
        return [n for n, a in self.analyzers.items() if phase in a.phases and self.is_enabled(n)]

    def execute(self, context: Context) -> Output:
        merged = Output()
        for name in self.active(context.phase):
            began, failed = time.monotonic(), 0
            try:
                out = self.analyzers[name].run(context, self.configs[name])
                merged.tables |= {f"{name}.{k}": v for k, v in out.tables.items()}
                merged.messages += out.messages
            except Exception as e:
                failed = 1
                if not self.continue_on_error:
                    raise AnalyzerError(f"{name}: {e}") from e
                merged.messages.append(f"error: {name}: {e}")
            s = self.stats.setdefault(name, {"runs": 0, "failures": 0, "ms": 0.0})
            s["runs"] += 1
            s["failures"] += failed
            s["ms"] += (time.monotonic() - began) * 1000
        return merged


def _complexity(ctx: Context, config: dict) -> Output:
    return Output({"levels": metrics.complexity_report(ctx.elements), "smells": metrics.smells(ctx.elements), "refactorings": metrics.refactorings(ctx.elements)})


def _optimizer(ctx: Context, config: dict) -> Output:
    tokens = F.greatest(F.floor(F.octet_length("name") / 4) + 10, F.lit(10))
    return Output({"summaries": rag.summaries(ctx.elements), "packing": rag.pack(ctx.elements, tokens, int(config.get("max_tokens", 1000)), "relative_path", "ordinal")})


def _documentation(ctx: Context, config: dict) -> Output:
    return Output({"by_type": metrics.documentation_by_type(ctx.elements), "missing": metrics.missing_documentation(ctx.elements), "quality": metrics.documentation_quality(ctx.elements)})


def _metrics(ctx: Context, config: dict) -> Output:
    return Output({"values": metrics.long_metrics(ctx.elements), "summary": metrics.summary(ctx.elements)})


def default_registry() -> Registry:
    registry = Registry()
    for name, run in (("complexity", _complexity), ("llm-optimizer", _optimizer), ("doc-enhancer", _documentation), ("metrics", _metrics)):
        registry.register(Analyzer(name, run))
    return registry
