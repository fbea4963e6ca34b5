"""All effects: importing this module registers them, on the driver and in workers alike."""

from pixelmill.operators import compositing, diffusion, dithers, generators, pointwise, spatial, waves  # noqa: F401
from pixelmill.operators.registry import EFFECTS

__all__ = ["EFFECTS"]
