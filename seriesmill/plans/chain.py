"""Chains of frame-to-frame steps; everything stays one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


class Chain:
    """``Chain().apply(f).apply_to_each(g, h)(a, b)`` is ``g(f(a)), h(f(b))``."""

    def __init__(self, steps: tuple = ()):
        self._steps = tuple(steps)

    def apply(self, step: Step) -> "Chain":
        """Run one step on every frame."""
        return Chain((*self._steps, step))

    apply_to_all = apply

    def apply_to_each(self, *steps: Step) -> "Chain":
        """Run the n-th step on the n-th frame; the numbers must match."""
        return Chain((*self._steps, tuple(steps)))

    def __call__(self, *frames: DataFrame, intermediate: bool = False):
        history = []
        for step in self._steps:
            if isinstance(step, tuple):
                if len(step) != len(frames):
                    raise ValueError(f"{len(step)} steps for {len(frames)} frames")
                frames = tuple(s(frame) for s, frame in zip(step, frames))
            else:
                frames = tuple(frame.transform(step) for frame in frames)
            history.append(frames[0] if len(frames) == 1 else frames)
        if intermediate:
            return history
        return frames[0] if len(frames) == 1 else frames

    def __str__(self) -> str:
        names = [[getattr(s, "__name__", "step") for s in step] if isinstance(step, tuple) else getattr(step, "__name__", "step") for step in self._steps]
        return str(names)
