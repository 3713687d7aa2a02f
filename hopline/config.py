"""Project defaults from a TOML file: where the graph and its texts are, and short names for queries."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from hopline.errors import HoplineError

NAME = "hopline.toml"


@dataclass(frozen=True)
class Alias:
    """A short name: a query of a file, and which parameters the words behind it fill."""

    query: str
    name: str | None = None
    args: tuple[str, ...] = ()
    format: str | None = None


@dataclass
class Config:
    folder: Path
    graph: str | None = None
    schema: str | None = None
    roots: tuple[str, ...] = (".",)
    format: str = "table"
    width: int = 80
    aliases: dict[str, Alias] = field(default_factory=dict)

    def find(self, file: str) -> Path:
        """A query file by its path, or below one of the roots."""
        for root in ("", *self.roots):
            path = self.folder / root / file
            if path.is_file():
                return path
        raise HoplineError(f"there is no query file {file}")

    def params(self, alias: Alias, words: list[str]) -> dict[str, str]:
        if len(words) > len(alias.args):
            raise HoplineError(f"the alias takes {len(alias.args)} words, not {len(words)}")
        return dict(zip(alias.args, words))


def load(path: str | Path = NAME) -> Config:
    """The settings of a file; the defaults if there is none."""
    path = Path(path)
    if not path.is_file():
        return Config(path.parent)
    try:
        raw = tomllib.loads(path.read_text())
    except tomllib.TOMLDecodeError as e:
        raise HoplineError(f"{path}: {e}") from None
    cli = raw.get("cli", {})
    aliases = {k: Alias(v["query"], v.get("name"), tuple(v.get("args", ())), v.get("format")) for k, v in raw.get("query_aliases", {}).items()}
    return Config(
        path.parent,
        raw.get("db", {}).get("default_path"),
        raw.get("schema", {}).get("default_path"),
        tuple(raw.get("query", {}).get("roots", (".",))),
        cli.get("output_format", "table"),
        cli.get("table_max_column_width", 80),
        aliases,
    )
