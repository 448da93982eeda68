"""Settings of a run as dataclasses, from command lines."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, dataclass, field, fields
from typing import Any, get_type_hints


@dataclass
class DataConfig:
    catalog: str = ""
    datasets: list[str] = field(default_factory=list)
    max_packed_length: int = -100
    pack_interval: int = 64
    min_pixels: int | None = None
    max_pixels: int | None = None
    seed: int = 42


@dataclass
class EvalConfig:
    model: str = "echo"
    benchmarks: list[str] = field(default_factory=list)
    prompt_type: str = "json"
    batch_size: int = 32
    max_new_tokens: int = 16384
    output: str = "results"
    force: bool = False


def value_of(text: str) -> Any:
    """A leftover's value: true, false, none, a number, or the text."""
    if text.lower() in ("true", "false", "none"):
        return {"true": True, "false": False, "none": None}[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(kind: type, args: list[str]) -> tuple[Any, dict[str, Any]]:
    """(settings, what is left over): ``--name value`` and ``--flag`` of the dataclass; lists take several values. Other options are kept by
    name, with no value as True, for the model or operator they are meant for; a value without an option is an error."""
    parser, hints = argparse.ArgumentParser(allow_abbrev=False), get_type_hints(kind)
    for f in fields(kind):
        default = f.default if f.default is not MISSING else f.default_factory()
        names = {f"--{f.name}", f"--{f.name.replace('_', '-')}"}
        if hints[f.name] is bool:
            parser.add_argument(*names, dest=f.name, action=argparse.BooleanOptionalAction, default=default)
        elif hints[f.name] == list[str]:
            parser.add_argument(*names, dest=f.name, nargs="*", default=default)
        else:
            parser.add_argument(*names, dest=f.name, type=int if hints[f.name] in (int, int | None) else hints[f.name], default=default)
    known, rest = parser.parse_known_args(args)
    extra: dict[str, Any] = {}
    while rest:
        name = rest.pop(0)
        if not name.startswith("--"):
            raise ValueError(f"a value without an option: {name}")
        name, given, value = name[2:].partition("=")
        has = given or (rest and not rest[0].startswith("--"))
        extra[name.replace("-", "_")] = value_of(value if given else rest.pop(0)) if has else True
    return kind(**vars(known)), extra
