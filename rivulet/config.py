"""Settings from the environment: a value that can't be read leaves the default."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def _read(text: str, default):
    try:
        if isinstance(default, bool):
            return {"true": True, "false": False}[text.strip().lower()]
        if isinstance(default, int):
            return int(text)
        if isinstance(default, float):
            value = float(text)
            return value if math.isfinite(value) else default
    except (ValueError, KeyError):
        return default
    return text if text.strip() else default


class FromEnv:
    """A dataclass whose fields are read from PREFIX_FIELD; `floors` names the least value of a field, below which the default holds."""

    PREFIX = ""
    FLOORS: Mapping[str, float] = {}

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None):
        env = os.environ if env is None else env
        got = {}
        for f in fields(cls):
            name = f"{cls.PREFIX}{f.name.upper()}"
            value = _read(env[name], f.default) if name in env else f.default
            least = cls.FLOORS.get(f.name)
            got[f.name] = f.default if least is not None and value < least else value
        return cls(**got)


@dataclass(frozen=True)
class PolicyConfig(FromEnv):
    """Group-relative policy optimisation. A wrong sign would learn the worst policy and look healthy, so it is never taken."""

    temperature: float = 1.0
    clip_epsilon: float = 0.2
    kl_beta: float = 0.02
    learning_rate: float = 0.01
    inner_epochs: int = 4

    PREFIX = "GRPO_"
    FLOORS = {"temperature": 1e-12, "clip_epsilon": 1e-12, "kl_beta": 0.0, "learning_rate": 1e-12, "inner_epochs": 2}


@dataclass(frozen=True)
class StreamConfig(FromEnv):
    """A micro-batch job."""

    max_offsets: int = 5000
    trigger_seconds: int = 10
    watermark: str = "10 minutes"
    wait: str = "30 minutes"
    retries: int = 2
    fail_on_data_loss: bool = True

    PREFIX = "STREAM_"
    FLOORS = {"max_offsets": 1, "trigger_seconds": 0, "retries": 0}

    def problems(self) -> list[str]:
        """All that is wrong, not just the first."""
        from rivulet.functions.columns import cutoff_ms

        found = [f"{name} must be {least} or more" for name, least in self.FLOORS.items() if getattr(self, name) < least]
        for name in ("watermark", "wait"):
            try:
                cutoff_ms(0, getattr(self, name))
            except ValueError as e:
                found.append(f"{name}: {e}")
        return found
