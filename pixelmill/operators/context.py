"""What effects need besides a raster and parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pixelmill.operators.palettes import Palette


@dataclass
class Context:
    src: object
    palette: Palette = field(default_factory=lambda: Palette.of("gameboy-dmg"))
    tile: object = None
    tile_size: tuple[int, int] = (0, 0)
    frames: int = 1
