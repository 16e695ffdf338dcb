"""Settings with their ranges, from a JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Where settings are found if nobody says where.
VARIABLE, DEFAULT = "SPEECHGRAIN_CONFIG", ".config/speechgrain/config.json"


def _only(kind, found: dict) -> dict:
    """The keys of ``found`` that ``kind`` knows; others are ignored."""
    if not isinstance(found, dict):
        raise ValueError(f"{kind.__name__} must be an object")
    return {f.name: found[f.name] for f in fields(kind) if found.get(f.name) is not None}


def _require(good: bool, name: str, rule: str, value) -> None:
    if not good:
        raise ValueError(f"{name} must be {rule}, not {value!r}")


@dataclass(frozen=True)
class Matching:
    """Thresholds of speaker matching; values out of range raise ``ValueError`` with the setting's name."""

    provider: str = "bands"
    threshold: float = 0.78
    margin: float = 0.05
    min_speech_s: float = 8.0
    enabled: bool = False

    #: Names of the settings in files.
    KEYS = {"matchThreshold": "threshold", "matchMargin": "margin", "minimumSpeechSeconds": "min_speech_s"}

    def __post_init__(self) -> None:
        _require(0 <= self.threshold <= 1, "threshold", "between 0 and 1", self.threshold)
        _require(self.margin >= 0, "margin", "at least 0", self.margin)
        _require(self.min_speech_s > 0, "min_speech_s", "above 0", self.min_speech_s)

    @classmethod
    def read(cls, path: str | Path | None) -> Matching:
        """From a JSON object; a missing file or key means the default, other keys are ignored."""
        if path is None or not Path(path).exists():
            return cls()
        return cls.of(json.loads(Path(path).read_text()))

    @classmethod
    def of(cls, found: dict) -> Matching:
        if not isinstance(found, dict):
            raise ValueError("speaker identification must be an object")
        return cls(**_only(cls, {cls.KEYS.get(k, k): v for k, v in found.items()}))


@dataclass(frozen=True)
class Export:
    """Copying of artifacts to a folder, and a command after it, which is only parsed here."""

    enabled: bool = False
    targetDir: str | None = None  # noqa: N815
    includeAudio: bool = False  # noqa: N815
    overwrite: bool = False
    hookTimeoutSeconds: float = 30.0  # noqa: N815
    postPipelineCommand: dict | None = None  # noqa: N815

    def __post_init__(self) -> None:
        _require(self.targetDir != "" and not (self.enabled and not self.targetDir), "targetDir", "a folder", self.targetDir)
        _require(self.hookTimeoutSeconds > 0, "hookTimeoutSeconds", "above 0", self.hookTimeoutSeconds)
        command = self.postPipelineCommand
        _require(command is None or bool(command.get("executable")), "postPipelineCommand.executable", "a program", command)


@dataclass(frozen=True)
class Settings:
    """All settings: matching, export, and where profiles are."""

    speakerProfilesDir: str | None = None  # noqa: N815
    matching: Matching = field(default_factory=Matching)
    export: Export = field(default_factory=Export)

    def __post_init__(self) -> None:
        _require(self.speakerProfilesDir != "", "speakerProfilesDir", "a folder", self.speakerProfilesDir)

    @classmethod
    def path(cls, explicit: str | None = None, environment: dict[str, str] | None = None) -> tuple[Path, bool]:
        """Where the settings are, and whether that was asked for: explicitly, by the environment, else in the home folder."""
        env = os.environ if environment is None else environment
        asked = explicit or env.get(VARIABLE)
        return (Path(asked), True) if asked else (Path(env.get("HOME") or Path.home()) / DEFAULT, False)

    @classmethod
    def read(cls, explicit: str | None = None, environment: dict[str, str] | None = None) -> Settings:
        """The settings; a file that was asked for must exist, and any file that exists must be right."""
        at, asked = cls.path(explicit, environment)
        if not at.exists():
            if asked:
                raise ValueError(f"no settings at {at}")
            return cls()
        try:
            found = json.loads(at.read_text())
        except ValueError as error:
            raise ValueError(f"{at} isn't JSON: {error}") from error
        known = _only(cls, found)
        if "speakerIdentification" in found:
            known["matching"] = Matching.of(found["speakerIdentification"])
        if "artifactExport" in found:
            known["export"] = Export(**_only(Export, found["artifactExport"]))
        return cls(**known)

    def chosen(self, **given) -> dict:
        """Values given on the spot before those of the settings: for each name the first that isn't None."""
        own = {"provider": self.matching.provider, "threshold": self.matching.threshold, "margin": self.matching.margin, "min_speech_s": self.matching.min_speech_s, "profiles": self.speakerProfilesDir}
        return {k: given[k] if given.get(k) is not None else v for k, v in own.items()}
