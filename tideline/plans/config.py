"""Which model serves which task, and switches from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from ..errors import ScoringFault
from . import validate as V

STRICT = "TIDELINE_STRICT"


def strict_by_default() -> bool:
    return os.environ.get(STRICT, "") not in ("", "0", "false")


@dataclass(frozen=True)
class ModelConfig:
    """Places of models: one for numbers, one for classes. ``embedding`` names the text model that a scorer has to share."""

    regressor: str | None = None
    classifier: str | None = None
    embedding: str | None = None

    def uri_for(self, task: str) -> str | None:
        return self.regressor if task in (V.REGRESSION, V.FORECASTING) else self.classifier

    def check_embedding(self, name: str | None) -> None:
        if self.embedding is not None and name is not None and name != self.embedding:
            raise ScoringFault(f"the model reads text by {self.embedding}, the scorer by {name}")


@dataclass(frozen=True)
class Artefact:
    """A model's place: a local path, or a repository and a file in it."""

    scheme: str
    place: str
    file: str | None = None


def artefact(uri: str, quantised: str | None = None) -> Artefact:
    """``hf://owner/name/file`` or a path; with ``quantised`` (such as "int8") a sibling file of that kind is taken where it is there."""
    if uri.startswith("hf://"):
        owner, _, rest = uri[5:].partition("/")
        name, _, file = rest.partition("/")
        if not owner or not name:
            raise ScoringFault(f"{uri} names no repository")
        return Artefact("hf", f"{owner}/{name}", file or None)
    if "://" in uri and not uri.startswith("file://"):
        raise ScoringFault(f"no way to read {uri}")
    path = Path(uri.removeprefix("file://"))
    other = path.with_name(f"{path.stem}.{quantised}{path.suffix}") if quantised else path
    return Artefact("file", str(other if other.exists() else path))
