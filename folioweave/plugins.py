"""Plugins: named functions from frames to frames, which anyone may register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Plugin = Callable[..., DataFrame]


class Plugins:
    """An open registry; a name is given once, unless it is replaced on purpose."""

    def __init__(self) -> None:
        self._known: dict[str, Plugin] = {}

    def register(self, name: str, plugin: Plugin, replace: bool = False) -> Plugin:
        if name in self._known and not replace:
            raise ValueError(f"there is a plugin {name}")
        self._known[name] = plugin
        return plugin

    def names(self) -> list[str]:
        return sorted(self._known)

    def apply(self, df: DataFrame, *names: str, **options: object) -> DataFrame:
        """``df`` through the plugins in the order given. ``options`` go to each of them."""
        for name in names:
            if name not in self._known:
                raise KeyError(f"no plugin {name}; there are {', '.join(self.names()) or 'none'}")
            df = self._known[name](df, **options)
            if not isinstance(df, DataFrame):
                raise TypeError(f"plugin {name} gave no frame")
        return df
