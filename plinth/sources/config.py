"""Project configuration."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from plinth.functions.boxes import Thresholds

LOG = logging.getLogger(__name__)
# Fixed value: the versions that are understood; any other becomes the first.
VERSIONS = ["2.0", "3.0"]


@dataclass(frozen=True)
class Config:
    name: str = "plinth"
    version: str = VERSIONS[0]
    input_path: str = ""
    output_path: str = ""
    enable_relations: bool = True
    thresholds: Thresholds = field(default_factory=Thresholds)
    batch_size: int = 5000


def normalise_version(version: object) -> str:
    text = str(version).strip()
    return text if text in VERSIONS else VERSIONS[0]


def load(path: str | None) -> Config:
    """Configuration of a YAML file, each key with its default; unreadable thresholds become the defaults."""
    if not path:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    section = lambda name, of=raw: of.get(name) if isinstance(of.get(name), dict) else {}
    project, pipeline = section("project"), section("pipeline")
    return Config(
        name=str(project.get("name", "plinth")),
        version=normalise_version(project.get("citygml_version", VERSIONS[0])),
        input_path=str(pipeline.get("input_path", "")),
        output_path=str(pipeline.get("output_path", "")),
        enable_relations=bool(pipeline.get("enable_relations", True)),
        thresholds=_thresholds(section("spatial") or section("spatial_relations")),
        batch_size=max(1, int(section("neo4j").get("batch_size", 5000) or 5000)),
    )


def _thresholds(raw: dict) -> Thresholds:
    d = Thresholds()
    try:
        return Thresholds(*(float(raw.get(k, v)) for k, v in (("touch_epsilon", d.touch), ("adjacent_epsilon", d.adjacent), ("intersection_epsilon", d.intersection))))
    except (TypeError, ValueError) as e:
        LOG.warning("spatial thresholds are not numbers (%s); the defaults hold", e)
        return d
