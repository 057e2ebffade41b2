"""Guards around functions that read and write: suffixes and paths of parameters, retries."""

from __future__ import annotations

import functools
import inspect
import time
from collections.abc import Callable, Sequence
from pathlib import Path


class WrongSuffix(ValueError):
    """A parameter's file name has none of the suffixes that are allowed."""


def _given(function: Callable, parameter: str, args: tuple, kwargs: dict) -> Path:
    bound = inspect.signature(function).bind(*args, **kwargs)
    bound.apply_defaults()
    if parameter not in bound.arguments:
        raise ValueError(f"{function.__name__} has no parameter {parameter}")
    value = bound.arguments[parameter]
    if not isinstance(value, str | Path):
        raise TypeError(f"{parameter} must be a path, not {type(value).__name__}")
    return Path(value)


def suffix(parameter: str, *allowed: str, exact_case: bool = False) -> Callable[[Callable], Callable]:
    """Calls go on only where the parameter's file name ends in one of the suffixes (with or without the dot)."""
    fold = (lambda x: x) if exact_case else str.lower
    wanted = {fold("." + a.lstrip(".")) for a in allowed}

    def around(function: Callable) -> Callable:
        @functools.wraps(function)
        def call(*args, **kwargs):
            path = _given(function, parameter, args, kwargs)
            if fold(path.suffix) not in wanted:
                raise WrongSuffix(f"{parameter} is {path.name}; it must end in {' or '.join(sorted(wanted))}")
            return function(*args, **kwargs)

        return call

    return around


def path(parameter: str, exists: bool = False, create: bool = False, kind: str | None = None) -> Callable[[Callable], Callable]:
    """Calls go on only where the parameter is a path that is there (exists), is a "file" or a "folder" (kind); create makes a missing folder first."""

    def around(function: Callable) -> Callable:
        @functools.wraps(function)
        def call(*args, **kwargs):
            at = _given(function, parameter, args, kwargs)
            if create and not at.exists():
                at.mkdir(parents=True)
            if (exists or kind) and not at.exists():
                raise FileNotFoundError(f"{parameter}: {at} is not there")
            if kind == "file" and not at.is_file() or kind == "folder" and not at.is_dir():
                raise ValueError(f"{parameter}: {at} is no {kind}")
            return function(*args, **kwargs)

        return call

    return around


def retry(times: int = 3, wait: float = 1.0, factor: float = 2.0, on: Sequence[type[BaseException]] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Callable[[Callable], Callable]:
    """Calls that raise one of the errors are made again, up to times in all, after waits that grow by factor; the last error goes on."""

    def around(function: Callable) -> Callable:
        @functools.wraps(function)
        def call(*args, **kwargs):
            pause = wait
            for attempt in range(times):
                try:
                    return function(*args, **kwargs)
                except tuple(on):
                    if attempt + 1 == times:
                        raise
                    sleep(pause)
                    pause *= factor

        return call

    return around
