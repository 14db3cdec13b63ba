"""Enrichment steps: a small graph of DataFrame transformations, built lazily into one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from docsieve.operators.grouped import tag_inputs

PREVIOUS = "$previous"
INPUTS = "$inputs"

DYNAMIC = "?"

Transform = Callable[..., DataFrame]


@dataclass(frozen=True)
class Step:
    """A named transformation. ``dependencies`` default to the step before; several are united with ``__input``.

    With ``grouping_fields`` the transformation is called as ``transform(df, fields)``; ``("?",)`` stands for the group the step
    before assigned (``__group``).
    """

    name: str
    transform: Transform
    dependencies: tuple[str, ...] = (PREVIOUS,)
    enabled: bool = True
    grouping_fields: tuple[str, ...] = field(default=())


def _resolve(steps: Sequence[Step]) -> dict[str, tuple[Step, tuple[str, ...]]]:
    """Steps with their dependencies by name; a disabled step takes everything that needs it out."""
    resolved: dict[str, tuple[Step, tuple[str, ...]]] = {}
    dropped: set[str] = set()
    previous = INPUTS
    for step in steps:
        needs = tuple(previous if name == PREVIOUS else name for name in step.dependencies) or (INPUTS,)
        unknown = [name for name in needs if name != INPUTS and name not in resolved and name not in dropped]
        if unknown:
            raise ValueError(f"step {step.name} depends on unknown or later steps: {unknown}")
        previous = step.name
        if not step.enabled or any(name in dropped for name in needs):
            dropped.add(step.name)
            continue
        resolved[step.name] = (step, needs)
    return resolved


def run_steps(inputs: Mapping[str, DataFrame], steps: Sequence[Step]) -> dict[str, DataFrame]:
    """Output DataFrame of every step that runs. Nothing is executed here; unused steps cost nothing."""
    resolved = _resolve(steps)
    source = next(iter(inputs.values())) if len(inputs) == 1 else tag_inputs(inputs)
    outputs: dict[str, DataFrame] = {INPUTS: source}
    for name, (step, needs) in resolved.items():
        given = outputs[needs[0]] if len(needs) == 1 else tag_inputs({need: outputs[need] for need in needs})
        fields = ["__group" if item == DYNAMIC else item for item in step.grouping_fields]
        outputs[name] = step.transform(given, fields) if fields else step.transform(given)
    return {name: df for name, df in outputs.items() if name != INPUTS}


def last_outputs(inputs: Mapping[str, DataFrame], steps: Sequence[Step]) -> dict[str, DataFrame]:
    """Outputs no other step consumes: what the job writes."""
    consumed = {need for _, needs in _resolve(steps).values() for need in needs}
    return {name: df for name, df in run_steps(inputs, steps).items() if name not in consumed}
